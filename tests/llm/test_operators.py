"""Each operator against a plain version on small rows: nulls, empty and long texts, ties, repeats."""

import collections
import hashlib
import math
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gridforge.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, ngram_lm, quality, substring_dedup, url_filter
from gridforge.llm.queries import RULES, op2_ngram_lm, vocabulary

SPACE = "[ \t\n\x0b\x0c\r]+"
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string"


def toks(text):
    return [w for w in re.split(SPACE, (text or "").translate(LOWER)) if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(50)] + ["été", "Zoë", "日本"]
    base = [rng.choice(words) for _ in range(80)]
    out = []
    for i in range(120):
        kind = i % 4
        w = list(base) if kind == 0 else [rng.choice(words) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(0, 3) if kind == 0 else 0):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        text = "".join(x + rng.choice([" ", " ", " ", "\n", "  "]) for x in w)
        out.append((1000 - i, text))
    out += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "A b"), (2004, "a  B"), (2005, out[1][1]), (2006, out[1][1].replace(" ", "\t")), (2007, "y" * 200_000 + " z"), (2008, out[1][1].upper())]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash and a null in the others."""
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], "doc_id long, text string, TEXT string, score string, keep_id int").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_url_filter(spark):
    urls = [None, "", "example.org/x", "http://EXAMPLE.org/es/a", "https://m.example.org/en/12?x#y", "http://org/", "http://org", "http://a.com/fr/", "http://a.com/de/x.org/", "http://xorg/es", "x://b.org?q", "http://notcom/de/", "ftp://é.com/de/#", "http://x.example.org/en/2", "http://x.example.org:80/en/1"] * 2
    got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        url = urls[r.page_id]
        host, path = "", ""
        if url and "://" in url:
            rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
            host, path = rest.split("/")[0].translate(LOWER), rest[len(rest.split("/")[0]) :]
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.text, best.verdict if best else "allow"), url
    many = [url_filter.Rule("block", f"h{k}.com", f"/p{k}/") for k in range(40)]
    one = url_filter.url_filter(spark.createDataFrame([(1, "http://a.h39.com/p39/q")], "page_id long, url string"), many).first()
    assert one.rule == "h39.com/p39/" and url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def plain_kneser_ney(train, order):
    """Dictionaries, straight from the definition."""
    sequences = [["<s>"] * (order - 1) + toks(t) + ["</s>"] for t in train]
    top = collections.Counter(tuple(s[k - order + 1 : k + 1]) for s in sequences for k in range(order - 1, len(s)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    words = {g[-1] for g in counts[1]}
    discounts = {n: ngram_lm._discounts(np.array([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])) for n, c in counts.items()}

    def prob(gram):
        p = 1.0 / (len(words) + 1)
        for n in range(1, order + 1):
            g = gram[len(gram) - n :]
            same = {k: v for k, v in counts[n].items() if k[:-1] == g[:-1]}
            total = sum(same.values())
            if total:
                d = (0.0, *discounts[n])
                c = counts[n].get(g, 0)
                p = max(c - d[min(c, 3)], 0) / total + sum(d[min(v, 3)] for v in same.values()) / total * p
        return p

    def score(text):
        s = ["<s>"] * (order - 1) + toks(text) + ["</s>"]
        return sum(math.log10(prob(tuple(s[k - order + 1 : k + 1]))) for k in range(order - 1, len(s)))

    return score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, rows, order):
    small = [(i, t and t[:150]) for i, t in rows[:30]] + rows[-9:-5]
    train = small[: len(small) * 2 // 3]
    model = ngram_lm.train(spark.createDataFrame(train, SCHEMA).repartition(3), order)
    score = plain_kneser_ney([t for _, t in train], order)
    counts = collections.Counter(w for _, t in train for w in [*toks(t), "</s>"])
    assert (model.tokens, model.vocabulary) == (sum(counts.values()), len(counts))
    for r in model.score_frame(spark.createDataFrame(small, SCHEMA)).collect():
        words = [*toks(dict(small)[r.doc_id]), "</s>"]
        base = sum(math.log10((counts[w] + 0.5) / (model.tokens + 0.5 * (len(counts) + 1))) for w in words)
        assert (r.n_tokens, r.n_known) == (len(words), sum(w in counts for w in words))
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(score(dict(small)[r.doc_id]), abs=1e-6)


def test_language_model_probabilities_add_up(spark, rows):
    model = ngram_lm.train(spark.createDataFrame(rows[:40], SCHEMA), 2)
    words = sorted({w for _, t in rows[:40] for w in toks(t)})
    texts = [(k, f"w1 {w}") for k, w in enumerate([*words, "never-seen"])]
    base = model.score_frame(spark.createDataFrame([(0, "w1")], SCHEMA)).first().score
    got = model.score_frame(spark.createDataFrame(texts, SCHEMA)).collect()
    reader = ngram_lm.Reader(model)
    total = 0.0
    for _, t in texts:
        _, p, _ = reader.logs(*ngram_lm.with_ends(pa.array([t])))
        total += 10 ** p[1]
    _, p, _ = reader.logs(*ngram_lm.with_ends(pa.array(["w1"])))
    assert total + 10 ** p[1] == pytest.approx(1.0, abs=1e-6) and len(got) == len(texts) and base < 0


def test_registered_language_model_is_of_order_three(spark, tmp_path, rows):
    orders = []
    with pytest.MonkeyPatch.context() as patch:
        train = ngram_lm.train
        patch.setattr(ngram_lm, "train", lambda df, order=2, **more: orders.append(order) or train(df, order, **more))
        spark.createDataFrame(rows[:40], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
        assert op2_ngram_lm(spark, str(tmp_path)).count() == 40
    assert orders[0] >= 3


def test_packed_grams_and_tables_give_back_what_went_in():
    rng = np.random.default_rng(5)
    for top in (50, 1 << 20, 1 << 40):  # packed into one number, and ordered by columns
        columns = [rng.integers(0, top, 5000, np.uint64) for _ in range(3)]
        count = rng.choice([1, 2, 300, 1 << 40], 5000)
        plain = collections.Counter()
        for *gram, c in zip(*(x.tolist() for x in columns), count.tolist(), strict=True):
            plain[tuple(gram)] += c
        columns, (count,) = ngram_lm.summed(columns, [count], top)
        assert list(zip(*(c.tolist() for c in columns), strict=True)) == sorted(plain) and count.tolist() == [plain[k] for k in sorted(plain)]
        bucket = rng.integers(0, 4, len(count))
        for k, blob in ngram_lm.by_bucket(bucket, 6, [*columns, count]):
            *got, many = ngram_lm.unpacked(blob, 4)
            assert all(np.array_equal(g, c[bucket == k]) for g, c in zip(got, columns, strict=True)) and np.array_equal(many, count[bucket == k])
        key = ngram_lm.fold(columns)
        arrays = ngram_lm.table(key, [count, count % 7])
        got = ngram_lm.find(arrays, np.r_[key, key ^ np.uint64(0x5555555555555555)])
        for g, c in zip(got, (count, count % 7), strict=True):
            assert np.array_equal(g[: len(key)], c) and not g[len(key) :].any()
    assert len(ngram_lm.packed([np.sort(rng.integers(0, 1 << 20, 5000, np.uint64)), np.ones(5000, np.int64)])) < 15_000
    empty = ngram_lm.table(np.zeros(0, np.uint64), [np.zeros(0, np.int64)])
    assert not ngram_lm.find(empty, np.arange(9, dtype=np.uint64))[0].any()


def test_empty_tables(spark, none):
    assert ngram_lm.train(none).score_frame(none).count() == 0
    for df in (line_dedup.line_dedup(none), exact_dedup.exact_dedup(none), substring_dedup.substring_dedup(none), jaccard_join.jaccard_components(none), bpe.bpe_round_trip(none, vocabulary())):
        assert df.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(none, labels).score_frame(none).count() == 0
    assert language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string")).predict_frame(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0


def test_model_of_nothing(spark):
    one = spark.createDataFrame([(1, "a b")], SCHEMA)
    got = ngram_lm.train(one.limit(0)).score_frame(one).first()
    assert got.n_known == 0 and got.score == pytest.approx(0.0)  # a vocabulary of the unknown word alone


def test_line_dedup(docs, rows, spark):
    extra = [(1, "Abcdefghijk\n\n x"), (2, " abcdefghijK \r\nabcdefghijk\néééééééééé"), (3, "éééééééééé\nq\n" + "l" * 100_000), (4, "l" * 100_000)]
    everything = rows + extra
    first, n = {}, collections.Counter()
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate(LOWER)
    for i, t in everything:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 10:
                first[k] = min(first.get(k, i), i)
                n[k] += 1
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(everything, SCHEMA).repartition(6)).collect()}
    for i, t in everything:
        lines = (t or "").split("\n")
        kept = "\n".join(x for x in lines if n[key(x)] < 2 or first[key(x)] == i)
        assert (got[i].n_lines, got[i].kept, got[i].kept_sha256) == (len(lines), kept, hashlib.sha256(kept.encode()).hexdigest())
        assert got[i].n_dropped == sum(n[key(x)] >= 2 and first[key(x)] != i for x in lines)
    null_id = spark.createDataFrame([(None, "same line of text"), (7, "same line of text")], SCHEMA)
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(null_id).collect()} == {(None, 1), (7, 0)}


@pytest.mark.parametrize("copies", [0, 300])
def test_exact_dedup(spark, rows, docs, copies):
    everything = rows + [(9000 + k, "hot  text") for k in range(copies)]
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(SPACE, " ", t or "")
    for i, t in everything:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_dedup(spark.createDataFrame(everything, SCHEMA).repartition(5)).collect()
    assert len(got) == len(everything)
    text = dict(everything)
    for r in got:
        g = groups[norm(text[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), r.doc_id == min(g), hashlib.sha256(norm(text[r.doc_id]).encode()).hexdigest())
    repeated = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], SCHEMA)
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(repeated).collect()) == [(0, 1, True), (1, 3, False), (1, 3, False), (1, 3, True)]


def test_exact_dedup_takes_one_exchange(spark, docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [8_000, 200])
def test_jaccard_components(spark, rows, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "LEAST_BLOCK", block)
    rng = random.Random(9)
    base = [f"q{k}" for k in range(60)]
    everything = list(rows)
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        everything.append((5000 + k, " ".join(w)))
    sets = {}
    for i, t in everything:
        w = toks(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = [i for i, _ in everything]
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(links, ids)
    got = jaccard_join.jaccard_components(spark.createDataFrame(everything, SCHEMA).repartition(6)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in ids}


def test_substring_dedup(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(100, 200))) for _ in range(40)]
    for k in range(0, 12):
        texts[k] = texts[k][: 37 * k] + passage + texts[k][37 * k :]
    texts += ["", None, "z" * 150_000, "\n".join(["one short line"] * 3)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == list(range(12))
    for r in got:
        assert 0 in r.first_ids and r.repeated_bytes > len(passage.encode()) // 2
        assert (r.removed_bytes == 0) == (r.doc_id == 0)
        assert len(r.kept.encode()) == len(texts[r.doc_id].encode()) - r.removed_bytes
        assert r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()


def test_substring_dedup_leaves_stitched_phrases(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    phrases = [[word() for _ in range(4)] for _ in range(10)]
    docs = [[w for _ in range(60) for w in rng.choice(phrases)] for _ in range(30)]
    passage = [word() for _ in range(60)]
    docs += [[word() for _ in range(30)] + passage, passage + [word() for _ in range(30)]]
    held = collections.defaultdict(set)
    for k, w in enumerate(docs):
        for j in range(len(w) - 18):
            held[tuple(w[j : j + 19])].add(k)
    # a word may be cut on either side, so 19 whole ones are the least that 20 begun ones hold
    shared = [{j + x for j in range(len(w) - 18) if len(held[tuple(w[j : j + 19])]) > 1 for x in range(19)} for w in docs]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], SCHEMA).repartition(3)).collect()}
    assert {30, 31} <= set(got) and any(not x for x in shared)
    for k, r in got.items():
        for a, b in r.passages:
            # whole words of the passage are in a sequence that another document has
            assert set(range(-(-a // 10), (b + 1) // 10)) <= shared[k]
        assert (r.removed_bytes == 0) == (r.first_ids == [k])


@pytest.mark.parametrize("least", [1, 4, 9])
def test_sequences_cover_runs(least):
    rng = np.random.default_rng(least)
    seen = rng.random(300) < 0.9
    rows = np.array([0, 0, 90, 200, 300])
    after = np.cumsum(rng.integers(0, 4, 300))
    before = np.r_[0, after[:-1]]
    start, end = substring_dedup.sequences(seen, rows, before, after, least)
    assert np.all(np.diff(start) >= 0) and np.all(np.diff(end) >= 0) and np.all(after[end - 1] - before[start] >= least)
    covered = np.zeros(300, bool)
    for a, b in zip(start, end, strict=True):
        assert seen[a:b].all() and np.searchsorted(rows, a, "right") == np.searchsorted(rows, b - 1, "right")
        covered[a:b] = True
    want = np.zeros(300, bool)
    for a, b in zip(*substring_dedup.spans(seen, rows), strict=True):
        want[a:b] = after[b - 1] - before[a] >= least
    assert (covered == want).all()
    low = rng.integers(0, 250, 50)
    high = low + rng.integers(0, 40, 50)
    assert substring_dedup.least_of(after, low, high).tolist() == [min(after[a:b], default=substring_dedup.NO_ID) for a, b in zip(low, high, strict=True)]


def test_gear_hash_and_chunks():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    h, plain = 0, []
    for b in data:
        h = ((h << 1) + int(substring_dedup.GEAR[b])) & 0xFFFF
        plain.append(h)
    assert substring_dedup.gear_hashes(data).tolist() == plain
    starts, ends, rows = substring_dedup.chunks(data % 128, np.array([0, 0, 700, 5000]))
    assert starts[0] == 0 and ends[-1] == 5000 and (starts[1:] == ends[:-1]).all() and rows[0] == rows[1] == 0 and starts[rows[2]] == 700


def test_decontaminate(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [[word() for _ in range(rng.randint(16, 40))] for _ in range(15)] + [["tiny", "item", "of", "six", "whole", "words"], ["a", "b"]]
    clean = [" ".join(word() for _ in range(300)) for _ in range(20)]
    docs = list(clean)
    for k, w in enumerate(items[:15]):
        changed = [x if j % 9 else "CHANGED" for j, x in enumerate(w)]
        docs.append(f"{clean[k % 20][:200]} {' '.join(changed).upper()}!! {clean[k % 20][200:]}")
    docs += ["so tiny item of six whole words here", "a b", None, "", " ".join(items[0][:14]), "p " * 50_000 + " ".join(items[1])]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(spark.createDataFrame(list(enumerate(docs)), SCHEMA).repartition(3), bench).collect()}
    assert set(got) == {(20 + k, k) for k in range(15)} | {(35, 15), (36, 16), (39, 0), (40, 1)}  # an item of two words where it is the whole text
    assert got[40, 1].doc_word == 50_000 and got[40, 1].similarity == 1.0


def test_decontaminate_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "some words " + " ".join(f"i{k}x{j}" for j in range(20))) for k in range(9)], SCHEMA)
    monkeypatch.setattr(decontaminate, "BLOCK", 500)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()} == {(k, k) for k in range(9)}


@pytest.mark.parametrize("size", [5, 6, 7, 8, 9, 10, 12, 13, 16, 17, 18])
def test_seeds_hit_every_run_that_counts(size):
    need = decontaminate.least_match(size, 13, 75)
    masks = [int(m, 2) << k for m in decontaminate.masks_of(size, 13, 75) for k in range(size - len(m) + 1)]
    for same in range(1 << size):
        text = f"{same:0{size}b}".strip("0")
        if text.count("1") >= need and 4 * text.count("1") >= 3 * len(text):
            assert any(same & m == m for m in masks), f"{same:0{size}b}"


@pytest.mark.parametrize("size", [5, 6, 8, 20, 40])
@pytest.mark.parametrize("step", [5, 7])
def test_decontaminate_finds_spaced_substitutions(spark, size, step):
    items = [[f"i{k}x{j}" for j in range(size)] for k in range(step)]
    docs = [" ".join(["before", "it", *(w if j % step != k else "CHANGED" for j, w in enumerate(item)), "after"]) for k, item in enumerate(items)]
    match = {k: sum(j % step != k for j in range(size)) for k in range(step)}
    want = {(k, k) for k, m in match.items() if m >= min(13, -(-75 * size // 100))}
    got = decontaminate.contamination(spark.createDataFrame(list(enumerate(docs)), SCHEMA), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want


def test_longest_runs_are_brute_force():
    rng = np.random.default_rng(1)
    parts = [rng.random(rng.integers(1, 40)) < share for share in (0.0, 0.3, 0.6, 0.75, 0.9, 1.0) for _ in range(40)]
    edge = np.cumsum([0, *map(len, parts)])
    for part, start, end, most in zip(parts, *decontaminate.longest_runs(np.concatenate(parts), edge, 75), strict=True):
        runs = [(a, b) for b in range(1, len(part) + 1) for a in range(b) if 4 * part[a:b].sum() >= 3 * (b - a)]
        assert most == max((part[a:b].sum() for a, b in runs), default=0) == part[start:end].sum()
        assert not most or ((start, end) in runs and part[start] and part[end - 1])


def test_decontaminate_is_brute_force(spark):
    rng = random.Random(8)
    items, docs = [[f"i{k}x{j}" for j in range(rng.choice([5, 6, 8, 12, 17, 20, 40]))] for k in range(60)], []
    changes = [lambda j, n: j % 4 == 3, lambda j, n: j % 5 == 2, lambda j, n: rng.random() < 0.2, lambda j, n: rng.random() < 0.3, lambda j, n: 2 * n // 5 <= j < 3 * n // 5]
    for k, item in enumerate(items):
        docs.append([*["before"] * rng.randint(0, 3), *("CHANGED" if changes[k % 5](j, len(item)) else w for j, w in enumerate(item)), *["after"] * rng.randint(0, 3)])
    want = {}
    for k, (doc, item) in enumerate(zip(docs, items, strict=True)):
        most = 0
        for at in range(-len(item), len(doc)):
            same = [doc[at + j] == w for j, w in enumerate(item) if 0 <= at + j < len(doc)]
            most = max([most, *(sum(same[a:b]) for b in range(len(same) + 1) for a in range(b) if 4 * sum(same[a:b]) >= 3 * (b - a))])
        if most >= min(13, -(-75 * len(item) // 100)):
            want[k, k] = most
    got = decontaminate.contamination(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], SCHEMA).repartition(3), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.n_match for r in got} == want and 10 < len(want) < 60
    assert all(4 * r.n_match >= 3 * r.n_words for r in got)


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe(vocabulary())


def test_bpe_is_the_library(model):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rng = random.Random(5)
    letters = "aeiou thrnst'ldmrev.,!\n\t  éè日本🙂0123½²\x1c\x85\xa0\u2003\u0301"
    texts = ["", " ", "  a", "don't we'll 'tis ''s !'s I'VE", "a" * 5000, " " * 3000 + "x", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [f"a{chr(c)} {chr(c)}b  {chr(c)}1" for c in range(0x3100)]
    flat, rows = model.encode_rows(pa.array(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [flat[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)] == [e.ids for e in want]
    assert model.decode_rows(flat, rows) == [library.decode(e.ids, skip_special_tokens=False) for e in want]


def test_pair_test_is_its_definition(model):
    rng = random.Random(6)
    ids = sorted(model.ids_of)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)] + rng.sample(sorted(model.rank), 1000)
    want = [model.merged(model.bytes_of[a] + model.bytes_of[b]) == [a, b] for a, b in pairs]
    assert [model.fits(a, b) for a, b in pairs] == want
    assert model.fits_all(np.array([a << 20 | b for a, b in pairs])).tolist() == want


HELD = """
import re, sys
import pyarrow as pa
from gridforge.llm import bpe
def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
bpe.classes(), pa.array(["x"]).to_pylist()
before = held()
model = bpe.load(sys.argv[1])
flat, _ = model.encode_rows(pa.array(["some words", "a" * 100]))
print(held() - before, len(flat))
"""


def test_bpe_worker_holds_little():
    """Workers keep a vocabulary through all later stages: by dictionaries and a dense table it took over 150 MB."""
    said = subprocess.run([sys.executable, "-c", HELD, vocabulary()], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True).stdout.split()
    assert float(said[0]) < 80 and int(said[1]) > 2


def test_bpe_automaton_is_its_definition():
    rng = random.Random(9)
    tokens = sorted({bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(2, 9))) for _ in range(300)})
    ids = np.array(rng.sample(range(1000), len(tokens)), np.int32)
    auto = bpe.Automaton(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)]), ids)
    id_of = dict(zip(tokens, ids.tolist(), strict=True))
    texts = [bytes(rng.choice(b"abc\xffd") for _ in range(40)) for _ in range(200)]
    state = np.zeros(len(texts), np.int32)
    for end in range(1, 41):
        state = auto.step(state, np.array([t[end - 1] for t in texts], np.uint8))
        for t, at in zip(texts, state.tolist(), strict=True):
            got, at = [], auto.near[at]
            while at:
                got.append((int(auto.token[at]), int(auto.length[at])))
                at = auto.link[at]
            assert got == [(id_of[t[k:end]], end - k) for k in range(end) if t[k:end] in id_of]


def test_bpe_frame(spark, docs, rows):
    got = bpe.bpe_round_trip(docs, vocabulary()).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert r.decoded == text and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_quality_learns_and_passes_odd_rows(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "plain", "words", "of", "a", "text", "go", "on"]) for _ in range(rng.randint(5, 60)))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW$$$", "CLICK***", "HERE&&&"]) for _ in range(rng.randint(5, 60)))
    texts = [(k, good() if k % 2 else bad()) for k in range(400)]
    docs = spark.createDataFrame([*texts, (500, None), (501, ""), (None, good()), (501, "w " * 60_000)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(300, None), (None, 1)], "doc_id long, quality int")
    fitted = quality.train(docs, labels)
    got = fitted.score_frame(docs).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and 300 <= r.doc_id < 400)
    assert [r.score for r in got if r.doc_id == 500] == [0.5]
    assert fitted.keep(docs).count() == sum(r.predicted for r in got)


def test_language_chain_is_plain_forward_backward():
    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien"] * 20
    fitted = language_id.fit(texts, [0, 1, 2] * 20, ["en", "de", "fr"], length=8, rounds=40, batch=32)
    column = pa.array(["the dog und die katze", "", None, "12 --", "le chat " * 500, "the"])
    chain = language_id.Chain.of(column)
    got = fitted.posteriors(chain)
    for k in range(len(column)):
        a, b = chain.rows[k], chain.rows[k + 1]
        if a == b:
            continue
        e = np.exp(fitted.emissions(chain.data, chain.starts[a:b], chain.ends[a:b], chain.hashes[a:b]).astype(float))
        move, alpha, beta = np.exp(fitted.transitions), [np.exp(fitted.begin) * e[0]], [np.ones(3)]
        for t in range(1, b - a):
            v = alpha[-1] @ move * e[t]
            alpha.append(v / v.sum())
        for t in range(b - a - 1, 0, -1):
            v = move @ (e[t] * beta[-1])
            beta.append(v / v.sum())
        p = np.array(alpha) * np.array(beta[::-1])
        assert np.abs(p / p.sum(1, keepdims=True) - got[a:b]).max() < 1e-3
    names, score, _ = fitted.predict(column)
    assert names[1:4] == ["und"] * 3 and names[4] == "fr" and names[5] == "en" and (score[1:4] == 0).all()
    mixed = got[: chain.rows[1]].argmax(1).tolist()
    assert mixed == [0, 0, 1, 1, 1]


def test_language_frame(spark):
    rng = random.Random(1)
    kinds = {"aa": ["ka", "kori", "kim"], "bb": ["lo", "lusta", "lent"]}
    data = [(k, " ".join(rng.choice(kinds[n]) for _ in range(20)), n) for k, n in enumerate(["aa", "bb"] * 30)]
    data += [(100, None, "aa"), (101, "", None), (102, "99 !!", "aa"), (None, "kori ka", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = language_id.train(docs).predict_frame(docs).collect()
    assert len(got) == 64 and {r.lang_pred for r in got if r.doc_id in (100, 101, 102)} == {"und"}
    assert all(r.lang_pred == data[r.doc_id][2] for r in got if r.doc_id is not None and r.doc_id < 60)


def test_language_sample_is_of_the_smallest_hashes(spark, monkeypatch):
    """One language holds most rows; of each the same number is learnt, repeated rows with their ids."""
    data = [(k, f"text{k}", "aa" if k % 10 else "bb") for k in range(400)] + [(3, "again", "aa"), (None, "x", "aa"), (5, None, "aa"), (6, "x", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(7)
    seen = {}
    monkeypatch.setattr(language_id, "fit", lambda texts, labels, names, length, rounds: seen.update(texts=texts, labels=labels, names=names))
    language_id.train(docs, sample=60)
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    want = []
    for label, name in enumerate(["aa", "bb"]):
        ids = sorted({i for i, t, n in data if n == name and i is not None and t is not None}, key=lambda i: (hashes[i], i))[:30]
        want += sorted((label, t) for i, t, n in data if n == name and i in ids and t is not None)
    assert seen["names"] == ["aa", "bb"] and list(zip(seen["labels"], seen["texts"], strict=True)) == want
