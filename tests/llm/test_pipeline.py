"""The pipeline against brute force on the smallest tables, and with awkward rows."""

import collections
import re

import pytest

import corpus_pipeline as P
from gridforge.llm import quality
from gridforge.llm.queries import part_of

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = "[ \t\n\x0b\x0c\r]+"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_run_is_brute_force(spark, tables):
    fitted = quality.train(tables["documents"], tables["labels"].filter(part_of(3) != 1))
    good = {r.doc_id for r in fitted.score_frame(tables["documents"]).filter("predicted = 1").collect()}
    left = {r.doc_id: r.text for r in tables["documents"].collect() if r.doc_id in good}
    seen = {}
    for i in sorted(left):
        seen.setdefault(re.sub(SPACE, " ", left[i] or ""), i)
    left = {i: left[i] for i in seen.values()}
    sets = {}
    for i, t in left.items():
        w = [x for x in re.split(SPACE, (t or "").translate(LOWER)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {i for i in left if find(i) == i}
    word = lambda t: " ".join(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.lower()))
    items = [f" {word(r.text)} " for r in tables["benchmark"].collect()]
    texts = {r.doc_id: f" {word(r.text or '')} " for r in tables["documents"].collect()}
    left = {i for i in left if not any(x in texts[i] for x in items)}
    got = P.run(spark, SF).collect()
    assert {r.doc_id for r in got} == left and len(got) == len(left)


def test_stages_take_awkward_rows(spark, tables):
    rows = [(None, "some clean words of text here", None, None, None), (7, None, "en", None, 0), (7, "", None, "s", 0), (8, "x " * 30_000, "en", "s", None), (8, "x " * 30_000, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("KEPT", part_of(2))
    for name, stage in P.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0, name
        out = stage(spark, docs, SF)
        if stage is not P.encode_stage:
            assert out.columns == list(P.COLUMNS), name
        out.count()


def left(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)


def test_exact_dedup_stage_decides_by_row(spark):
    rows = [(1, "a"), (5, "a"), (5, "b"), (5, "b"), (None, "a"), (None, "c"), (None, "c"), (7, "d"), (7, "e"), (None, "e")]
    assert left(spark, P.exact_dedup_stage, rows) == sorted([(1, "a"), (5, "b"), (None, "c"), (7, "d"), (7, "e")], key=str)
    hot = [(k % 40 or None, "hot  text") for k in range(400)] + rows
    assert left(spark, P.exact_dedup_stage, hot) == sorted([(1, "hot  text"), (1, "a"), (5, "b"), (None, "c"), (7, "d"), (7, "e")], key=str)


def test_near_dedup_stage_decides_by_row(spark):
    near = lambda name, k: " ".join(f"{name}{j}" for j in range(60)) + f" end{k}"
    rows = [(3, near("x", 0)), (3, "other text of id three"), (8, near("x", 1)), (8, "unique text of id eight"), (None, near("x", 2))]
    rows += [(None, near("y", 0)), (None, near("y", 1)), (4, near("z", 0)), (4, near("z", 0)), (None, None), (None, "")]
    got = left(spark, P.near_dedup_stage, rows)
    one = [x for x in got if x[0] is None and x[1] and x[1].startswith("y0")]
    assert len(one) == 1
    assert sorted(set(got) - set(one), key=str) == sorted([(3, near("x", 0)), (3, "other text of id three"), (8, "unique text of id eight"), (4, near("z", 0)), (None, None), (None, "")], key=str)
    assert len(got) == 7


def test_decontaminate_stage_decides_by_row(spark, tables):
    item = tables["benchmark"].orderBy("item_id").first().text
    rows = [(7, f"before {item} after"), (7, "clean text of id seven"), (None, item), (None, "clean text without id"), (7, "clean text of id seven")]
    assert left(spark, P.decontaminate_stage, rows) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_stage_names():
    assert collections.Counter(len(s) for s in P.STAGES) == {2: 5} and P.ORACLE_SQL is None
