"""Operators against plain versions, hash faults, awkward rows and the work of linked chains."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridforge.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, ngram_lm, quality, substring_dedup, url_filter
from gridforge.llm._text import same_spans, span_hashes, words
from gridforge.llm.queries import OP9_SQL, vocabulary

SCHEMA = "doc_id long, text string"
SPACE = "[ \t\n\x0b\x0c\r]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def toks(text):
    return [w for w in re.split(SPACE, (text or "").translate(LOWER)) if w]


def parity(size):
    """A word by the parity of the bits of its places, and its complement: their polynomial hashes modulo 2**64 agree."""
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(size))
    return word, word.translate({97: 98, 98: 97})


def clash(spark, rows):
    """The rows in a frame whose other columns have the same names in another case, or those of results."""
    return spark.createDataFrame([(i, t, None, 5, "x") for i, t in rows], "doc_id long, text string, TEXT string, score int, keep_id string").repartition(3)


@pytest.mark.parametrize("size", [8, 64, 256, 1024, 2048])
def test_words_of_complementary_parity_differ(spark, size):
    a, b = parity(size)
    w = words(pa.array([a, b]))
    assert w.hashes[0] != w.hashes[1]
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    at = np.array([0, size, 2 * size])
    assert same_spans(data, at, at[[1, 2, 0]], np.full(3, size)).tolist() == [False, False, True]
    if size < 1024:
        return
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(vocabulary()), bpe.load(vocabulary())
    flat, rows = model.encode_rows(pa.array([a, b, f"x {b} {a}"]))
    assert [flat[s:e].tolist() for s, e in zip(rows[:-1], rows[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in (a, b, f"x {b} {a}")]
    df = spark.createDataFrame([(1, a), (2, b)], SCHEMA)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: r.n_known for r in ngram_lm.train(df.filter("doc_id = 1")).score_frame(df).collect()} == {1: 2, 2: 1}
    assert substring_dedup.substring_dedup(df, least_words=1).count() == 0


def test_hashes_of_random_spans_differ():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 40_000, dtype=np.uint8)
    starts = rng.integers(0, 39_000, 3000)
    ends = starts + rng.integers(0, 900, 3000)
    hashes = span_hashes(data, starts, ends)
    plain = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(hashes.tolist())) == len(set(plain)) == len({(h, p) for h, p in zip(hashes.tolist(), plain, strict=True)})


def test_url_globs(spark):
    rules = [url_filter.Rule("block", "com", ""), url_filter.Rule("block", "*.shop.example", "/a?c/*/end"), url_filter.Rule("allow", "n?t", "/"), url_filter.Rule("block", "x.org", "/p*.html")]
    cases = {
        "http://a.community.org/": None, "http://com.evil.org/": None, "http://a.com": "com", "http://com/x": "com", "http://m.shop.example/abc/d/end": "*.shop.example/a?c/*/end", "http://shop.example/abc/d/end": None,
        "http://m.shop.example/aéc/d/e/endx": "*.shop.example/a?c/*/end", "http://m.shop.example/ac/d/end": None, "http://a.net/": "n?t/", "http://nt/": None, "http://x.org/p/q.html": "x.org/p*.html", "http://x.org/p.html": "x.org/p*.html", "http://x.org/ptml": None, "http://x.org/q.html": None,
    }
    rows = [(None if k % 5 == 0 else k, url, None, "r") for k, url in enumerate([*cases, *cases, None, "no scheme"])]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, HOST string, rule string"), rules, default="allow").collect()
    want = collections.Counter((i, cases.get(u)) for i, u, *_ in rows)
    assert collections.Counter((r.page_id, r.rule) for r in got) == want
    assert all(r.verdict == ("allow" if r.rule in (None, "n?t/") else "block") for r in got)
    empty = url_filter.url_filter(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), []).first()
    assert (empty.host, empty.path, empty.rule, empty.verdict) == ("a.b", "/c", None, "allow")


def test_language_model_takes_awkward_rows(spark):
    rows = [(None, "a b a b"), (1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "c " * 20_000), (5, "A\tB")]
    model = ngram_lm.train(clash(spark, rows), 3)
    got = model.score_frame(clash(spark, rows)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert model.tokens == sum(len(toks(t)) + 1 for _, t in rows) and model.vocabulary == 4
    ones = [r for r in got if r.doc_id == 1]
    assert ones[0].score == ones[1].score and {r.doc_id: r.score for r in got}[5] == pytest.approx(ones[0].score)
    assert {r.doc_id: r.n_tokens for r in got}[4] == 20_001 and all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in got)


def test_line_and_exact_dedup_ignore_clashing_columns(spark):
    rows = [(1, "a long enough line\nx"), (2, "A long enough line \ny"), (None, "a long enough line"), (2, "z")]
    plain, other = spark.createDataFrame(rows, SCHEMA), clash(spark, rows)
    for run in (line_dedup.line_dedup, exact_dedup.exact_dedup):
        assert collections.Counter(run(plain).collect()) == collections.Counter(run(other).collect())
    kept = {(r.doc_id, r.kept) for r in line_dedup.line_dedup(other).collect()}
    assert kept == {(1, "a long enough line\nx"), (2, "y"), (None, ""), (2, "z")}


def test_first_copies_keep_all_columns(spark):
    rows = [(2, "a  b"), (1, "a b"), (None, "a\nb"), (None, None), (None, ""), (7, "c")]
    got = exact_dedup.first_copies(clash(spark, rows))
    assert got.columns == ["doc_id", "text", "TEXT", "score", "keep_id"]
    found = collections.Counter((r[0], r[1]) for r in got.collect())
    assert found[(1, "a b")] == found[(7, "c")] == 1 and found[(None, None)] + found[(None, "")] == 1 and sum(found.values()) == 3


def test_language_id_without_labels(spark):
    rows = [(1, "some words"), (1, "some words"), (None, "des mots"), (2, None), (3, "42")]
    unlabelled = clash(spark, rows).toDF("doc_id", "text", "lang", "score", "keep_id")
    model = language_id.train(unlabelled)
    got = model.predict_frame(unlabelled).collect()
    assert len(got) == 5 and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert language_id.fit([], [], []).predict(pa.array(["abc def"]))[0] == ["und"]
    taught = language_id.fit(["the cat and the dog"] * 5 + ["le chat et le chien"] * 5, [0] * 5 + [1] * 5, ["en", "fr"], rounds=20)
    got = {(r.doc_id, r.lang_pred) for r in taught.predict_frame(clash(spark, [(1, "the dog"), (1, "the dog"), (None, "le chien"), (2, " 1 "), (3, None)])).collect()}
    assert got == {(1, "en"), (None, "fr"), (2, "und"), (3, "und")}


def test_bpe_takes_awkward_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rows = [(None, "a b"), (4, "x" * 5000 + " " + "é" * 1500), (4, "a b"), (4, "a b"), (5, None), (6, "\n \t"), (7, "0" * 1300 + "!" * 1200)]
    got = bpe.bpe_round_trip(clash(spark, rows), vocabulary()).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.decoded) for r in got) == collections.Counter((i, t or "") for i, t in rows)


def test_quality_is_plain_ftrl(spark):
    rng = random.Random(3)
    texts = [(" ".join(rng.choice(["good", "fine", "text", "Well"] if k % 2 else ["bad", "JUNK", "buy!!", "text"]) for _ in range(rng.randint(1, 30))), k % 2) for k in range(60)]
    index, value, edge = quality.features(pa.array([t for t, _ in texts]))
    rows = [(index[edge[k] : edge[k + 1]], value[edge[k] : edge[k + 1]], y) for k, (_, y) in enumerate(texts)]
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.01, 0.02

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for ids, values, y in rows:
            w = {int(i): weight(int(i)) for i in ids}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * float(v) for i, v in zip(ids, values, strict=True))))
            for i, v in zip(ids.tolist(), values.tolist(), strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    model = quality.follow_the_leader(rows)
    assert np.allclose([model.weights[i] for i in z], [weight(i) for i in z], atol=1e-4)
    assert set(np.flatnonzero(model.weights)) <= set(z)
    got = model.scores(pa.array([t for t, _ in texts] + [None, ""]))
    plain = [1 / (1 + math.exp(-sum(weight(int(i)) * float(v) for i, v in zip(a, b, strict=True)))) for a, b, _ in rows]
    assert np.allclose(got[:-2], plain, atol=1e-4) and got[-2:].tolist() == [0.5, 0.5]
    two = spark.createDataFrame([(1, "good fine text", 2), (None, "bad JUNK buy!!", 3), (1, None, 4)], "doc_id long, text string, more long").toDF("doc_id", "text", "text")
    assert [tuple(r) for r in model.keep(two).collect()] == [(1, "good fine text", 2), (1, None, 4)]


def plain_chunks(data, mean):
    edges = [0]
    for p in range(substring_dedup.WINDOW, len(data)):
        h = sum(int(substring_dedup.GEAR[data[p - 1 - k]]) << k for k in range(substring_dedup.WINDOW)) % 65536
        if h < 65536 // mean and data[p] & 0xC0 != 0x80:
            edges.append(p)
    return [*edges, len(data)] if data else [0]


def plain_substrings(rows, least, mean):
    """(doc_id, passages, first ids, kept) of each row that has a passage, on the bytes themselves."""
    texts = [((2**63 - 1 if i is None else i), (t or "").encode()) for i, t in rows]
    cut = [plain_chunks(d, mean) for _, d in texts]
    spans = [[m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", d)] for _, d in texts]
    owners = collections.defaultdict(set)
    for (i, d), e in zip(texts, cut, strict=True):
        for a, b in zip(e, e[1:], strict=False):
            owners[d[a:b]].add(i)
    found, holders = [], collections.defaultdict(set)
    for (i, d), e, w in zip(texts, cut, spans, strict=True):
        n = len(e) - 1
        seen = [len(owners[d[e[k] : e[k + 1]]]) > 1 for k in range(n)]
        over = lambda a, b: sum(s < e[b] and t > e[a] for s, t in w)  # noqa: B023, E731  words over chunks a to b - 1
        ranges = set()
        for k in range(n):
            if not seen[k]:
                continue
            b = next((b for b in range(k + 1, n + 1) if over(k, b) >= least), None)
            if b and all(seen[k:b]):
                ranges.add((k, b))
            a = next((a for a in range(k, -1, -1) if over(a, k + 1) >= least), None)
            if a is not None and all(seen[a : k + 1]):
                ranges.add((a, k + 1))
        found.append(ranges)
        for a, b in ranges:
            holders[tuple(d[e[k] : e[k + 1]] for k in range(a, b))].add(i)
    out = []
    for (own, _), (i, d), e, w, ranges in zip(rows, texts, cut, spans, found, strict=True):
        first = {}
        for a, b in ranges:
            who = holders[tuple(d[e[k] : e[k + 1]] for k in range(a, b))]
            if len(who) > 1:
                for k in range(a, b):
                    first[k] = min(first.get(k, 2**63), min(who))
        runs, k, n = [], 0, len(e) - 1
        while k < n:
            if k in first:
                b = k
                while b in first:
                    b += 1
                if sum(e[k] <= s < e[b] for s, _ in w) >= least:
                    runs.append((k, b))
                k = b
            k += 1
        if runs:
            inside = [k for a, b in runs for k in range(a, b)]
            kept = b"".join(d[e[k] : e[k + 1]] for k in range(n) if k not in inside or first[k] == i)
            out.append((own, tuple((e[a], e[b]) for a, b in runs), tuple(sorted({first[k] for k in inside})), kept.decode("utf-8", "replace")))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_is_plain(spark, seed):
    rng = random.Random(seed)
    vocabulary_ = [f"w{k}" for k in range(60)] + ["été", "日本", "longerword"]
    line = lambda n: [rng.choice(vocabulary_) for _ in range(n)]
    shared = [line(rng.randint(10, 60)) for _ in range(4)]
    rows = []
    for k in range(25):
        parts = [line(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), line(rng.randint(0, 15))]
        rows.append((rng.choice([None, k, k, 3]), " ".join(x for p in parts for x in p)))
    rows += [(900, None), (901, ""), rows[0], rows[1], (902, rows[1][1])]
    got = substring_dedup.substring_dedup(clash(spark, rows), least_words=12, mean=24).collect()
    want = plain_substrings(rows, 12, 24)
    assert want and collections.Counter((r.doc_id, tuple(map(tuple, r.passages)), tuple(r.first_ids), r.kept) for r in got) == collections.Counter(want)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)


def test_substring_recall_by_length(spark):
    """Passages of n words in two documents, put in other surroundings. Edge chunks differ, so a passage is
    sure to be found a chunk or two above the least length."""
    rng = random.Random(8)
    rows, lengths = [], {}
    for k in range(240):
        n = (20, 25, 30, 40)[k % 4]
        passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(n))
        for half in (0, 1):
            around = [" ".join(f"s{rng.randrange(10**6)}" for _ in range(15)) for _ in range(2)]
            rows.append((2 * k + half, f"{around[0]} {passage} {around[1]}"))
        lengths[k] = n
    found = {r.doc_id // 2 for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    recall = {n: sum(k in found for k, m in lengths.items() if m == n) / 60 for n in (20, 25, 30, 40)}
    print(recall)
    assert recall[40] == 1.0 and recall[20] <= recall[25] <= recall[30] and recall[30] >= 0.7


def plain_leaks(docs, items, least, percent):
    word = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower())
    out = collections.Counter()
    for i, text in docs:
        a = word(text)
        for item, other in items:
            b = word(other)
            if len(b) < decontaminate.LEAST_ITEM:
                out[(i, item, len(b), len(b), 0, 0)] += bool(b) and a == b
                continue
            need, best = decontaminate.least_match(len(b), least, percent), None
            for shift in range(-len(b) + 1, len(a)):
                low, high = max(0, shift), min(len(a), shift + len(b))
                same = [a[k] == b[k - shift] for k in range(low, high)]
                total = [0]
                for s in same:
                    total.append(total[-1] + s)
                top = None
                for e in range(1, len(same) + 1):
                    s = next((s for s in range(e) if 100 * (total[e] - total[s]) >= percent * (e - s)), None)
                    if s is not None and total[e] - total[s] >= need and (top is None or total[e] - total[s] > top[0]):
                        top = (total[e] - total[s], s, e)
                if top:
                    m, s, e = top
                    while not same[s]:
                        s += 1
                    found = (m, -(low + s), -(low + s - shift), e - s)
                    best = found if best is None or found[:3] > best[:3] else best
            if best:
                out[(i, item, best[3], best[0], -best[1], -best[2])] += 1
    return +out


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_is_plain(spark, seed):
    rng = random.Random(seed)
    vocabulary_ = [f"v{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary_) for _ in range([3, 5, 6, 8, 11, 14, 25, 40][k % 8]))) for k in range(14)] + [(50, None), (51, ""), (None, " ".join(f"u{k}" for k in range(16)))]
    docs = []
    for k in range(30):
        w = (rng.choice(items)[1] or "").split()
        w = [f"z{rng.randrange(99)}" if rng.random() < rng.choice([0, 0.1, 0.25]) else x for x in w]
        before, after = ([rng.choice(vocabulary_) for _ in range(rng.randint(0, 12))] for _ in range(2))
        docs.append((rng.choice([None, k, 3]), " ".join([*before, *w, *after])))
    short = next(t for _, t in items if t and len(t.split()) == 3)
    docs += [docs[0], docs[0], (70, None), (71, ""), (73, short.upper()), (74, f"a {short}"), (72, " ".join(f"U{k}!" for k in range(16)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(clash(spark, docs), bench, least_words=13, percent=75).collect()
    want = plain_leaks(docs, items, 13, 75)
    assert want and collections.Counter((r.doc_id, r.item_id, r.n_words, r.n_match, r.doc_word, r.item_word) for r in got) == want
    assert any(r.item_id is None for r in got)
    dirty = {i for i, *_ in want}
    clean = collections.Counter((r[0], r[1]) for r in decontaminate.clean(clash(spark, docs), bench).collect())
    rows = collections.Counter(docs)
    assert all(rows[x] == n for x, n in clean.items()) and all(i not in dirty for i, _ in clean if i is not None and sum(j == i for j, _ in docs) == 1)
    bad = {x for x in rows if plain_leaks([x], items, 13, 75)}
    assert clean == collections.Counter({x: n for x, n in rows.items() if x not in bad})


def test_decontamination_recall_at_the_stated_agreement(spark):
    """Runs that just meet 75 per cent are found however the replaced words lie."""
    rng = random.Random(5)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate([20, 24, 40, 60] * 15)]
    docs = []
    for k, text in items:
        w = text.split()
        gone = set(rng.sample(range(len(w)), len(w) // 4)) if k % 3 else set(range(3, len(w), 4))
        docs.append((k, " ".join(f"r{rng.randrange(10**6)}" if j in gone else x for j, x in enumerate(w))))
    got = decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    want = {i for i, item, *_ in plain_leaks_own(docs, items)}
    assert {r.doc_id for r in got.collect()} == want and len(want) >= 0.9 * len(items)


def plain_leaks_own(docs, items):
    """plain_leaks() of each document with its own item only."""
    return [x for d, i in zip(docs, items, strict=True) for x in plain_leaks([d], [i], 13, 75)]


def components_of(rows, n=5, percent=75):
    sets = []
    for _, t in rows:
        w = toks(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_jaccard_takes_awkward_rows(spark):
    near = lambda name, k: " ".join(f"{name}{j}" for j in range(50)) + f" end{k}"
    rows = [(5, near("x", 0)), (5, near("x", 1)), (None, near("x", 2)), (None, near("y", 0)), (None, near("y", 1)), (9, None), (9, ""), (None, " "), (4, "A b"), (3, "a B"), (7, near("x", 0)), (7, near("x", 0)), (1, "lone words are here today")]
    got = jaccard_join.jaccard_components(clash(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(components_of(rows))


def test_chain_of_links_is_linear_work(spark, monkeypatch):
    """Each text links with its neighbours alone; all are one component, and the pairs that are counted grow with the texts."""
    def chain(n):
        return [(k, " ".join(f"c{j}" for j in range(8 * k, 8 * k + 104))) for k in range(n)]

    rows = chain(300)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 300

    def work(n):
        """Pairs that stars() counts over all tiles, tiles made as the operator makes them."""
        sets = [np.sort(words(pa.array([t])).hashes[:-4]) for _, t in chain(n)]
        posted, tiles = collections.defaultdict(list), collections.defaultdict(set)
        for k, s in enumerate(sets):
            for g in s[: len(s) - -(-75 * len(s) // 100) + 1].tolist():
                posted[g].append(k)
        for members in posted.values():
            tiles[min(members)].update(members)
        return sum(jaccard_join.stars([sets[k] for k in sorted(m)], 75)[1] for m in tiles.values() if len(m) > 1)

    assert work(400) < 2.3 * work(200)


def test_stars_of_random_sets_are_all_components():
    rng = np.random.default_rng(6)
    for _ in range(20):
        base = [np.sort(rng.choice(400, 40, replace=False)) for _ in range(4)]
        arrays = []
        for _ in range(40):
            a = base[rng.integers(4)].copy()
            a[rng.integers(0, 40, rng.integers(0, 9))] = rng.integers(400, 10_000, 1)
            arrays.append(np.unique(a).astype(np.uint64))
        labels, pairs = jaccard_join.stars(arrays, 75)
        sets = [set(a.tolist()) for a in arrays]
        want = list(range(40))
        for a in range(40):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((want[a], want[b]))
                    want = [x if w == y else w for w in want]
        assert labels.tolist() == want and pairs <= 40 * 40
    assert jaccard_join.stars([np.array([1], np.uint64)], 75)[0].tolist() == [0]


def test_jaccard_blocks_of_one_tile(spark, monkeypatch):
    """Tiles of several blocks, with rows outside of the largest component."""
    monkeypatch.setattr(jaccard_join, "LEAST_BLOCK", 300)
    monkeypatch.setattr(jaccard_join, "MOST_BLOCK", 400)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rng = random.Random(2)
    common = [f"t{j}" for j in range(40)]
    rows = []
    for k in range(120):
        w = list(common)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(8)}"
        rows.append((k, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(components_of(rows))


def test_jaccard_is_sql(spark):
    import duckdb

    place = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{place}'")
    want = collections.Counter(con.execute(OP9_SQL).fetchall())
    assert collections.Counter(map(tuple, jaccard_join.jaccard_components(spark.read.parquet(place)).collect())) == want
