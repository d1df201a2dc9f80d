"""Interpolated modified Kneser-Ney language model, counted in Spark and mapped by workers.

Words. A first pass counts the words by hash and numbers them, frequent ones first, in each shard by
itself; from then on grams are arrays of word numbers.

Counting. Each task sorts the n-grams of its rows, adds up equal ones and sends packed arrays, one for
each bucket, so a frequent n-gram travels once for each task; numbers in order are sent as differences,
by byte planes and compressed. A bucket is chosen by the n-gram's context, so that what a context needs
lies in one place; contexts whose last word has more than a quarter of a shard's share of all tokens (at
most 4 x shards words) are dealt out by the whole n-gram instead, and their parts are added up. A shard
works off one bucket after the other. Each bucket's grams become a sorted hash array in the shared
folder; the next lower order gets the distinct words in front of each n-gram (continuation counts) in
the same way, after which what was written for that is removed.

Storage. Of a hash the array's index has the first bits and the array the next 32, so a lookup takes an
absent key for another one about once in 2**28 times. A count takes one byte, larger ones stand in a
list of their own; counts have 64 bits everywhere else.

Scoring. Workers map the files into memory and look up a batch's hashes; no table of the model's size is
broadcast or held by the driver.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import Folder, blob_batches, buckets_of, by_shard, exchange, lookup, pick, shard_of, shards_of, unpack
from ._text import mix, slices, words

END = np.uint64(0x243F6A8885A308D3)
CHUNK = 1 << 20
#: Bytes of text that a worker holds the lookups of.
SLICE = 4 << 20
#: Numbers of the place before a text and of words that training lacks.
BEGIN, UNKNOWN = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
#: A stored count that stands in the list of large ones; keys a cell of a table's index.
LARGE, CELL = 255, 4


def with_ends(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row edges) of the rows' words, each row followed by one end."""
    w = words(column)
    rows = w.rows + np.arange(len(w.rows))
    out = np.full(rows[-1], END, np.uint64)
    out[np.arange(len(w.hashes)) + w.row_of()] = w.hashes
    return out, rows


def grams(tokens: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """n columns: the numbers of the n-gram that ends at each token; BEGIN stands before a row."""
    place = np.arange(len(tokens)) - np.repeat(rows[:-1], np.diff(rows))
    columns = []
    for back in range(n - 1, 0, -1):
        c = np.full(len(tokens), BEGIN, tokens.dtype)
        c[back:] = np.where(place[back:] >= back, tokens[: len(tokens) - back], c[back:])
        columns.append(c)
    return [*columns, tokens]


def longer(key, c: np.ndarray) -> np.ndarray:
    """The key of a gram with one more word, which has nothing to do with the key without it."""
    return mix(key ^ c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One key of a gram's columns."""
    total = np.uint64(0x452821E638D01377)
    for c in columns:
        total = longer(total, c)
    return total


def distinct(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values in order, each token's place among them), found by hashing; only distinct values are sorted."""
    found = pa.array(tokens).dictionary_encode()
    kinds, codes = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(kinds)
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds))
    return kinds[order], place[codes]


def summed(columns: list[np.ndarray], counts: list[np.ndarray], top: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Equal grams of numbers up to ``top`` with their counts added up, in order."""
    if not len(columns[0]):
        return columns, counts
    bits = max(1, int(top).bit_length())
    if bits * len(columns) <= 64:
        code = columns[0].astype(np.uint64)
        for c in columns[1:]:
            code = code << np.uint64(bits) | c.astype(np.uint64)
        order = np.argsort(code)
        new = np.diff(code[order], prepend=~code[order[:1]]) != 0
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        for c in columns:
            new |= np.diff(c[order], prepend=~c[order[:1]]) != 0
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], [np.add.reduceat(x[order], first) for x in counts]


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts as the smallest unsigned type that holds them all."""
    return x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))


def packed(columns: list[np.ndarray], ordered: bool = True) -> bytes:
    """Columns of one length, compressed by byte planes; the first one, if in order, as differences."""
    if ordered:
        columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    columns = [narrow(c) for c in columns]
    planes = b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)
    head = np.array([len(columns[0]), ordered, *(c.itemsize for c in columns)], np.int64)
    return head.tobytes() + pa.Codec("zstd", compression_level=3).compress(planes, asbytes=True)


def unpacked(blob: bytes, width: int) -> list[np.ndarray]:
    """The columns of packed(), with 64 bits each."""
    size, ordered, *kinds = np.frombuffer(blob, np.int64, width + 2).tolist()
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8 * (width + 2) :], size * sum(kinds)), np.uint8)
    columns, at = [], 0
    for kind in kinds:
        plane = raw[at : at + kind * size].reshape(kind, size).T
        columns.append(np.ascontiguousarray(plane).view(f"u{kind}").ravel().astype(np.uint64))
        at += kind * size
    if ordered:
        columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


def parted(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places that have it, in order) of each bucket that occurs."""
    if n <= 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(bucket, kind="stable")
    edge = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n))))
    for k in np.flatnonzero(np.diff(edge)):
        yield int(k), order[edge[k] : edge[k + 1]]


def by_bucket(bucket: np.ndarray, n: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, its rows of the columns) of each bucket that has some; the rows are in order of the first column."""
    for k, mine in parted(bucket, n):
        yield k, packed([c[mine] for c in columns])


def joined(blobs, width: int) -> list[np.ndarray]:
    """The columns of packed() blobs, one after another."""
    parts = [unpacked(b, width) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * width


def turned(key: np.ndarray) -> np.ndarray:
    """The key with its first 16 bits last, as keys of a bucket are alike in these."""
    return key << np.uint64(16) | key >> np.uint64(48)


def table(key: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays of a sorted hash table: index, next 32 bits of each key, and for each value bytes, places and values of large ones."""
    key = turned(key)
    order = np.argsort(key)
    key = key[order]
    bits = max(1, (len(key) // CELL).bit_length())
    cells = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    out = [cells.astype(np.uint32), (key >> np.uint64(32 - bits)).astype(np.uint32)]
    for v in values:
        v = v[order]
        large = np.flatnonzero(v >= LARGE)
        out += [np.minimum(v, LARGE).astype(np.uint8), large.astype(np.uint32), v[large].astype(np.uint64)]
    return out


def find(arrays: list[np.ndarray], key: np.ndarray) -> list[np.ndarray]:
    """Values of the keys in a table(), 0 where absent."""
    cells, low, *values = arrays
    key = turned(key)
    bits = int(len(cells) - 1).bit_length() - 1
    cell = key >> np.uint64(64 - bits)
    want = (key >> np.uint64(32 - bits)).astype(np.uint32)
    at, stop = cells[cell].astype(np.int64), cells[cell + np.uint64(1)].astype(np.int64)
    live = np.flatnonzero(at < stop)
    first, end, mine = at[live], stop[live], want[live]
    while len(live):  # the first place that isn't smaller, of all keys at once
        middle = (first + end) >> 1
        less = low[middle] < mine
        first, end = np.where(less, middle + 1, first), np.where(less, end, middle)
        done = first >= end
        if done.any():
            at[live[done]] = first[done]
            go = ~done
            live, first, end, mine = live[go], first[go], end[go], mine[go]
    hit = np.flatnonzero(at < stop)
    hit = hit[low[at[hit]] == want[hit]]
    out = []
    for small, place, large in zip(*[iter(values)] * 3, strict=True):
        v = np.zeros(len(key), np.int64)
        v[hit] = small[at[hit]]
        more = hit[v[hit] == LARGE]
        v[more] = large[np.searchsorted(place, at[more])]
        out.append(v)
    return out


class Vocabulary:
    """A worker's view of the words: hashes in order, number and count of each."""

    def __init__(self, folder: Folder, shards: int):
        self.shards = [folder.unpack(f"words-{k}") for k in range(shards)]

    def find(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of the distinct words, which are in order; UNKNOWN and 0 where absent."""
        number, count = np.full(len(kinds), UNKNOWN), np.zeros(len(kinds), np.int64)
        edge = np.searchsorted(shard_of(kinds, len(self.shards)), np.arange(len(self.shards) + 1))
        for k in np.flatnonzero(np.diff(edge)):
            key, place, many = self.shards[k]
            at, found = lookup(key, kinds[edge[k] : edge[k + 1]])
            mine = edge[k] + np.flatnonzero(found)
            number[mine] = place[at[found]].astype(np.uint64) * np.uint64(len(self.shards)) + np.uint64(k + 1)
            count[mine] = many[at[found]]
        return number, count


@dataclass
class Level:
    """What the driver keeps of an order: discounts, tokens, kinds seen once, twice and more often."""

    n: int
    discounts: tuple[float, float, float]
    total: int
    seen: tuple[int, int, int]


@dataclass
class NgramModel:
    order: int
    shards: int
    fine: int
    folder: Folder
    levels: list[Level]
    frequent: np.ndarray
    tokens: int
    vocabulary: int

    def score_frame(self, df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score, perplexity of every whole text (see train)."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(model)
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    tokens, rows = with_ends(part.column(1))
                    base, score, known = reader.logs(tokens, rows)
                    n = np.diff(rows)
                    add = lambda x: np.add.reduceat(x, rows[:-1])  # noqa: E731  each row has its end, so none is empty
                    total = add(score)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(total), pa.array(10.0 ** (-total / n))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

        return pick(df, id_column, text_column).toDF("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


class Reader:
    """A worker's view of the model: mapped tables of every bucket."""

    def __init__(self, model: NgramModel):
        self.model = model
        self.words = Vocabulary(model.folder, model.shards)
        read = lambda name, values: [x for k in range(model.shards) for x in self._tables(model.folder.unpack(f"{name}-{k}"), values)]
        self.grams = {level.n: read(f"grams-{level.n}", 1) for level in model.levels}
        self.contexts = {level.n: read(f"contexts-{level.n}", 4) for level in model.levels if level.n > 1}
        self.dealt = {level.n: read(f"dealt-{level.n}", 4) for level in model.levels if level.n > 1}

    def _tables(self, arrays: list[np.ndarray], values: int) -> list[list[np.ndarray]]:
        width = 2 + 3 * values
        return [arrays[k : k + width] for k in range(0, len(arrays), width)]

    def find(self, tables, key: np.ndarray, by: np.ndarray, width: int) -> np.ndarray:
        """[keys, width] values (0 where absent) of keys, which may repeat, each in the table that ``by`` chooses."""
        out = np.zeros((len(key), width), np.int64)
        for k, mine in parted(shard_of(by, len(tables)), len(tables)):
            for j, v in enumerate(find(tables[k], key[mine])):
                out[mine, j] = v
        return out

    def _contexts(self, n: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, whether it was dealt out, [contexts, 4] counts) of contexts of an order."""
        key = fold(columns)
        hot = lookup(self.model.frequent, columns[-1])[1]
        stats = np.empty((len(key), 4), np.int64)
        for which, tables in ((hot, self.dealt), (~hot, self.contexts)):
            stats[which] = self.find(tables[n], key[which], key[which], 4)
        return key, hot, stats

    def logs(self, tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: log10 of the base and of the model, and whether training has it."""
        model = self.model
        kinds, back = distinct(tokens)
        number, c = self.words.find(kinds)
        base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))[back]
        known = (c > 0)[back]
        p = np.full(len(tokens), 1.0 / (model.vocabulary + 1))
        for level in reversed(model.levels):
            d = np.array([0.0, *level.discounts])
            if level.n == 1:
                key = fold([number])
                count = self.find(self.grams[1], key, key, 1)[:, 0][back]
                total, spare = max(level.total, 1), float(d[1:] @ np.array(level.seen, np.float64))
                p = np.where(level.total > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / total + (spare / total) * p, p)
                continue
            columns = grams(number[back], rows, level.n)
            if level.n == 2:  # the context is a word: each is looked up once
                before = np.append(0, back[:-1] + 1)
                before[rows[:-1]] = 0
                single = np.append(BEGIN, number)
                context, hot, stats = (x[before] for x in self._contexts(2, [single]))
            else:
                context, hot, stats = self._contexts(level.n, columns[:-1])
            key = longer(context, columns[-1])
            count = self.find(self.grams[level.n], key, np.where(hot, key, context), 1)[:, 0]
            total, ones, twos, more = stats.T
            safe = np.maximum(total, 1)
            spare = (d[1] * ones + d[2] * twos + d[3] * more) / safe
            p = np.where(total > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / safe + spare * p, p)
        return base, np.log10(p), known


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of the numbers of grams seen 1 to 4 times; small tables that
    lack one of these get the usual half, one and one and a half, scaled below the count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.1), k - 0.05) for k, x in enumerate(d, 1))


def train(df: DataFrame, order: int = 3, id_column: str = "doc_id", text_column: str = "text") -> NgramModel:
    """Count the n-grams of all rows and write the model to the shared folder.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; each text ends with one end token, so a
    null or empty text counts as that token alone. Words are known by a 64-bit hash. Repeated rows
    count as often as they occur. An empty table gives a model in which every token has the same
    probability. Texts may be of any length. Only the text column is read; clashing or extra columns
    and null or repeated ids don't matter.
    """
    spark = df.sparkSession
    texts = pick(df, text_column).toDF("text")
    (n, fine), folder = shards_of(texts), Folder(spark)

    def tokens(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield with_ends(part.column(0))

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            (key,), (count,) = summed([np.concatenate([k for k, _ in waiting])], [np.concatenate([c for _, c in waiting])], 1 << 63)
            return key, count

        def out(key, count):
            yield from blob_batches(by_shard(shard_of(key, n * fine), n * fine, key, count.astype(np.uint64)))

        for tokens_, _ in tokens(batches):
            kinds, back = distinct(tokens_)
            waiting.append((kinds, np.bincount(back, minlength=len(kinds))))
            if sum(len(k) for k, _ in waiting) > CHUNK:
                waiting[:] = [merged()]
                if len(waiting[0][0]) > CHUNK // 2:
                    yield from out(*waiting.pop())
        if waiting:
            yield from out(*merged())

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for bucket, blobs in buckets_of(batches, fine):
            (key,), (count,) = summed([(got := unpack(blobs, (np.uint64, np.uint64)))[0]], [got[1]], 1 << 63)
            keys.append(key)
            counts.append(count)
        key, count, shard = np.concatenate(keys), np.concatenate(counts), bucket // fine
        place = np.empty(len(key), np.uint64)
        place[np.argsort(-count.astype(np.int64), kind="stable")] = np.arange(len(key), dtype=np.uint64)
        with folder.pack(f"words-{shard}") as add:
            add(key, narrow(place), narrow(count))
        often = np.flatnonzero(count > count.sum() // np.uint64(4 * n))
        rows = [(len(key), int(count.sum()), None, None), *((0, 0, int(place[k]) * n + shard + 1, int(count[k])) for k in often)]
        yield next(blob_batches(rows, ("kinds", "total", "number", "count"), (pa.int64(),) * 4))

    found = folder.save(exchange(texts.mapInArrow(unigrams, "bucket int, blob binary"), n, fine).mapInArrow(write_words, "kinds long, total long, number long, count long"), "tokens")
    vocabulary, total, most = found.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.max("kinds"), F.lit(0))).first()
    # at most 4 x n tokens can have more than a 4 x n th of all
    hot = found.filter(F.col("count") > max(64, total // (4 * n))).select("number").collect()
    frequent = np.sort(np.array([r.number for r in hot] + [int(BEGIN)], np.uint64))
    counter = _Counter(folder, n, fine, order, frequent, n * (most + 1))
    counter.train(texts, tokens)
    return NgramModel(order, n, fine, folder, counter.levels, frequent, total, vocabulary)


class _Counter:
    """Counts order by order, from the highest one down."""

    def __init__(self, folder: Folder, n: int, fine: int, order: int, frequent: np.ndarray, top: int):
        self.folder, self.n, self.fine, self.order, self.frequent, self.top = folder, n, fine, order, frequent, top
        self.levels: list[Level] = []

    def bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        """By the context, or by the whole gram if there is none or its last word is frequent; its count is at most that word's."""
        buckets = self.n * self.fine
        if len(columns) == 1:
            return shard_of(fold(columns), buckets)
        context = fold(columns[:-1])
        return shard_of(np.where(lookup(self.frequent, columns[-2])[1], longer(context, columns[-1]), context), buckets)

    def train(self, texts: DataFrame, tokens) -> None:
        kind = np.uint32 if self.top < 1 << 32 else np.uint64

        def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Vocabulary(self.folder, self.n)
            held: list[list[np.ndarray]] = []

            def out():
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
                columns, (count,) = summed(columns, [np.ones(len(columns[0]), np.int64)], self.top)
                yield from blob_batches(by_bucket(self.bucket(columns), self.n * self.fine, [*columns, count]))

            for t, rows in tokens(batches):
                kinds, back = distinct(t)
                held.append(grams(known.find(kinds)[0].astype(kind)[back], rows, self.order))
                if sum(len(c[0]) for c in held) > CHUNK:
                    yield from out()
            if held:
                yield from out()

        grown, spark = texts.mapInArrow(count_texts, "bucket int, blob binary"), texts.sparkSession
        for size in range(self.order, 0, -1):
            done = self._level(grown, size)
            if size < self.order:
                self.folder.drop(spark, f"level-{size + 1}")
            # exchanges of a level are of no use once it is written; Spark removes them when nothing refers to them
            grown = done.filter(F.col("kind") == 2).select("bucket", "blob")
            del done
            gc.collect()
            spark._jvm.System.gc()

    def _level(self, grown: DataFrame, size: int) -> DataFrame:
        """Write the grams of ``size`` words; the rows that are of use further on, by kind: 0 counts of
        counts, 1 parts of contexts that were dealt out, 2 grams of the next lower order."""
        folder, n, fine, buckets = self.folder, self.n, self.fine, self.n * self.fine

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            shard = TaskContext.get().partitionId()
            names, kinds = ("kind", "bucket", "blob"), (pa.int32(), pa.int32(), pa.binary())
            seen = np.zeros(6, np.int64)
            with folder.pack(f"grams-{size}-{shard}") as add, folder.pack(f"contexts-{size}-{shard}") as add_contexts:
                for _, blobs in buckets_of(batches, fine):
                    *columns, count = joined(blobs, size + 1)
                    columns, (count,) = summed(columns, [count], self.top)
                    add(*table(fold(columns), [count]))
                    seen += [*(np.count_nonzero(count == k) for k in (1, 2, 3, 4)), np.count_nonzero(count >= 3), int(count.sum())]
                    if size == 1:
                        continue
                    stats = [count, count == 1, count == 2, count >= 3]
                    contexts, stats = summed(columns[:-1], [x.astype(np.int64) for x in stats], self.top)
                    hot = lookup(self.frequent, contexts[-1])[1]
                    key = fold(contexts)
                    add_contexts(*table(key[~hot], [x[~hot] for x in stats]))
                    out = by_bucket(shard_of(key[hot], buckets), buckets, [*(c[hot] for c in contexts), *(x[hot] for x in stats)])
                    yield from blob_batches(((1, *x) for x in out), names, kinds)
                    lower, (many,) = summed(columns[1:], [np.ones(len(count), np.int64)], self.top)
                    yield from blob_batches(((2, *x) for x in by_bucket(self.bucket(lower), buckets, [*lower, many])), names, kinds)
            yield from blob_batches([(0, shard * fine, seen.tobytes())], names, kinds)

        def write_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            shard, contexts = TaskContext.get().partitionId(), 0
            with folder.pack(f"dealt-{size}-{shard}") as add:
                for _, blobs in buckets_of(batches, fine):
                    got = joined(blobs, size + 3)
                    columns, stats = summed(got[: size - 1], got[size - 1 :], self.top)
                    add(*table(fold(columns), stats))
                    contexts += len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array([contexts], pa.int64())], names=["kinds"])

        done = folder.save(exchange(grown, n, fine).mapInArrow(write, "kind int, bucket int, blob binary"), f"level-{size}")
        seen = sum((np.frombuffer(r.blob, np.int64) for r in done.filter("kind = 0").select("blob").collect()), np.zeros(6, np.int64))
        if size > 1:
            exchange(done.filter("kind = 1").select("bucket", "blob"), n, fine).mapInArrow(write_dealt, "kinds long").agg(F.sum("kinds")).first()
        self.levels.append(Level(size, _discounts(seen[:4]), int(seen[5]), (int(seen[0]), int(seen[1]), int(seen[4]))))
        return done
