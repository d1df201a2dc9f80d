"""Line deduplication with two Bloom filters: keys seen once and keys seen in a second document.

1. Each task reduces its lines to distinct (document, key) pairs and sends its filter in sparse
   form, packed 32-bit values by filter slice (a slice has a fixed number of bits). The owner of a
   slice sets the once-seen bits, and, where all bits of a value were set before, the twice-seen
   bits. Only the twice-seen slices are written to the shared folder, where workers map them. A
   shard has one slice or, of a very large input, several, which it works off one by one.
2. Lines that the twice-seen filter knows are suspects. Only they are shuffled: grouped by the whole
   key, added up in each task first, so a key that a third of all documents hold is one row a task.
   Keys of two or more documents are confirmed with their smallest document id and written as
   sorted arrays of a 128-bit digest.
3. Each task reads its texts again and drops the confirmed lines of other documents. No text is
   ever shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import Folder, blob_batches, buckets_of, by_shard, exchange, pick, shard_of, shards_of, unpack
from ._text import LOWER, WHITE, mix, slices, span_hashes, utf8

BITS_A_KEY = 16
PROBES = 4
CHUNK = 1 << 20
NO_ID = np.iinfo(np.int64).max


class Lines:
    """Lines of a string column: spans, spans of their keys, and which keys count."""

    def __init__(self, column, least: int):
        data, offsets = utf8(column)
        size = len(data)
        newline = np.flatnonzero(data == 0x0A)
        self.starts = np.sort(np.r_[offsets[:-1], newline + 1], kind="stable")
        self.rows = np.searchsorted(newline, offsets) + np.arange(len(offsets))  # first line of each row
        ends = np.r_[self.starts[1:], size]
        last = self.rows[1:] - 1
        ends -= 1
        ends[last] += 1  # a row's last line has no newline
        self.ends = ends
        solid = np.flatnonzero(~WHITE[data])
        at = np.searchsorted(solid, self.starts)  # the first solid byte at or after a line's start
        until = np.searchsorted(solid, ends)
        full = until > at
        self.key_starts, self.key_ends = ends.copy(), ends.copy()
        self.key_starts[full], self.key_ends[full] = solid[at[full]], solid[until[full] - 1] + 1
        self.points = np.zeros(len(ends), np.int64)
        if full.any():
            edges = np.stack([self.key_starts[full], self.key_ends[full]], 1).ravel()
            lead = np.append((data & 0xC0) != 0x80, False)  # so that a key may end where the data does
            self.points[full] = np.add.reduceat(lead, edges, dtype=np.int64)[::2]
        self.data = LOWER[data]
        self.keyed = np.flatnonzero(self.points >= least)
        self.row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.key_starts[self.keyed], self.key_ends[self.keyed])

    def key(self, line: int) -> bytes:
        return self.data[self.key_starts[line] : self.key_ends[line]].tobytes()


class Filter:
    """The twice-seen filter: slices of bits, chosen by the hash's high half, probed by its low half."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    @staticmethod
    def places(value: np.ndarray, slice_bits: int) -> np.ndarray:
        """[values, PROBES] bit numbers in the slice."""
        h = mix(value.astype(np.uint64) + np.uint64(1))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * step) % np.uint64(slice_bits) for k in range(PROBES)], 1)

    @staticmethod
    def has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
        return ((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(1)

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        shard = shard_of(hashes, len(self.parts))
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(len(self.parts) + 1))
        for k in np.flatnonzero(np.diff(edge)):
            mine = order[edge[k] : edge[k + 1]]
            if len(self.parts[k]):
                out[mine] = self.has(self.parts[k], self.places(hashes[mine].astype(np.uint32), 8 * len(self.parts[k])))
        return out


def set_bits(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, places >> np.uint64(3), (np.uint8(1) << (places & np.uint64(7)).astype(np.uint8)))


def line_dedup(df: DataFrame, least: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without the dropped lines), kept_sha256.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of
    at least ``least`` code points in two or more documents stay only in the smallest doc_id that
    holds them (there as often as they stand). A null or empty text is one empty line and stays as
    it is. Rows that share a doc_id are one document, rows without one count as the largest. Lines may
    be of any length; an empty table gives an empty result. Only the two named columns are read.
    """
    docs = pick(df, id_column, text_column).toDF("doc_id", "text")
    (n, fine), folder = shards_of(docs), Folder(df.sparkSession)
    buckets = n * fine

    def parts(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pc.fill_null(part.column(0), NO_ID).to_numpy(zero_copy_only=False), part, Lines(part.column(1), least)

    def distinct(ids: np.ndarray, lines: Lines) -> np.ndarray:
        """Hash of each key once a document, in order of hash."""
        h = lines.hashes()
        owner = ids[lines.row[lines.keyed]]
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        return h[np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]] if len(h) else h

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            h, count = np.unique(np.concatenate(held), return_counts=True)
            bucket = shard_of(h, buckets)
            low, back = np.unique(bucket.astype(np.uint64) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF)), return_inverse=True)
            seen = np.minimum(np.bincount(back, count, len(low)), 2).astype(np.uint8)  # values that agree count together
            yield from by_shard((low >> np.uint64(32)).astype(np.int32), buckets, low.astype(np.uint32), seen)

        for ids, _, lines in parts(batches):
            held.append(distinct(ids, lines))
            if sum(map(len, held)) > CHUNK:
                yield from blob_batches(out())
                held = []
        if held:
            yield from blob_batches(out())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, slices_ = TaskContext.get().partitionId(), 0
        with folder.pack(f"twice-{shard}") as add:
            for _, blobs in buckets_of(batches, fine):
                bits = 1 << max(10, int(BITS_A_KEY * sum(len(b) for b in blobs) / 5).bit_length())
                once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                for blob in blobs:
                    value, count = unpack([blob], (np.uint32, np.uint8))
                    places = Filter.places(value, bits)
                    again = Filter.has(once, places) | (count > 1)
                    set_bits(twice, places[again])
                    set_bits(once, places)
                add(twice if blobs else twice[:0])
                slices_ += 1
        yield pa.RecordBatch.from_arrays([pa.array([slices_], pa.int32())], names=["slices"])

    exchange(docs.mapInArrow(sparse, "bucket int, blob binary"), n, fine).mapInArrow(build, "slices int").agg(F.sum("slices")).first()

    def known() -> Filter:
        return Filter([x for k in range(n) for x in folder.unpack(f"twice-{k}")])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = known()
        for ids, _, lines in parts(batches):
            rows = lines.keyed[seen.knows(lines.hashes())]
            pairs = {(int(ids[lines.row[k]]), lines.key(k)) for k in rows}
            yield from blob_batches(pairs, ("doc_id", "line"), (pa.int64(), pa.binary()))

    found = docs.mapInArrow(suspects, "doc_id long, line binary").groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    confirmed = found.filter("last > first").select("line", "first")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, check = _digests(batch.column(0).to_pylist())
            yield from blob_batches(by_shard(shard_of(key, buckets), buckets, key, check, batch.column(1).to_numpy()))

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, lines = TaskContext.get().partitionId(), 0
        with folder.pack(f"lines-{shard}") as add:
            for _, blobs in buckets_of(batches, fine):
                key, check, first = unpack(blobs, (np.uint64, np.uint64, np.int64))
                order = np.lexsort((check, key))
                add(key[order], check[order], first[order])
                lines += len(key)
        yield pa.RecordBatch.from_arrays([pa.array([lines], pa.int64())], names=["lines"])

    exchange(confirmed.mapInArrow(digests, "bucket int, blob binary"), n, fine).mapInArrow(table, "lines long").agg(F.sum("lines")).first()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = known()
        tables = [x for k in range(n) for x in zip(*[iter(folder.unpack(f"lines-{k}"))] * 3, strict=True)]
        for ids, part, lines in parts(batches):
            rows = lines.keyed[seen.knows(lines.hashes())]
            drop = np.zeros(len(lines.starts), bool)
            if len(rows):
                key, check = _digests([lines.key(k) for k in rows])
                first = _firsts(tables, key, check, buckets)
                drop[rows] = (first != np.iinfo(np.int64).min) & (first != ids[lines.row[rows]])
            dropped = np.add.reduceat(drop.astype(np.int64), lines.rows[:-1])
            texts = []
            for k, text in enumerate(part.column(1).to_pylist()):
                if dropped[k]:
                    gone = drop[lines.rows[k] : lines.rows[k + 1]]
                    text = "\n".join(x for x, g in zip(text.split("\n"), gone, strict=True) if not g)
                texts.append(text or "")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(lines.rows)), pa.array(dropped), pa.array(texts, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"])

    return docs.mapInArrow(keep, "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string")


def _digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _firsts(tables, key: np.ndarray, check: np.ndarray, n: int) -> np.ndarray:
    """The smallest document of each digest; the least integer where it isn't confirmed."""
    out = np.full(len(key), np.iinfo(np.int64).min)
    shard = shard_of(key, n)
    for k in np.unique(shard):
        keys, checks, firsts = tables[k]
        mine = np.flatnonzero(shard == k)
        at = np.searchsorted(keys, key[mine])
        while len(keys):  # equal first halves stand side by side
            inside = at < len(keys)
            same = inside & (keys[np.minimum(at, len(keys) - 1)] == key[mine])
            hit = same & (checks[np.minimum(at, len(keys) - 1)] == check[mine])
            out[mine[hit]] = firsts[at[hit]].view(np.int64)
            mine, at = mine[same & ~hit], at[same & ~hit] + 1
            if not len(mine):
                break
    return out
