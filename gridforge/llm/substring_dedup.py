"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's bytes: ``h = (h << 1) + gear[byte]`` in 16 bits, so it sees the last
16 bytes only. A chunk ends where the hash is under a limit; places depend on content alone, there is
no least or largest size, and so a passage that is moved or has something put in front of it is cut
the same way again after 16 bytes. Chunks are known by digest: each task sends its distinct digests
with their smallest and largest document, packed, and each shard writes the digests of two or more
documents, sorted, to the shared folder, from which workers map them. Runs of neighbouring repeated
chunks are candidates only, as each chunk may stand in another document. Inside them the shortest
sequences of chunks of ``least_words`` words, from every first and to every last chunk, are digested
and sent in the same way, with their smallest document; a sequence is known by a digest of its chunks'
digests and one of its bytes, 128 bits in all. What sequences of two or more documents cover are
repeated passages. No text is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import Folder, blob_batches, buckets_of, by_shard, exchange, lookup, pick, shard_of, shards_of, unpack
from ._text import WHITE, mix, slices, span_hashes, spans, utf8

WINDOW = 16
MEAN = 24
#: The gear table is made from its index.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
CHUNK = 1 << 20
NO_ID = np.iinfo(np.int64).max


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sums over 1, 2, 4, 8 and 16 bytes, each from the one before."""
    h = GEAR[data]
    for size in (1, 2, 4, 8):
        h[size:] += h[:-size] << np.uint16(size)
    return h


def chunks(data: np.ndarray, offsets: np.ndarray, mean: int = MEAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, each row's first chunk and the end). Chunks cover each row; an empty row has none."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = gear_hashes(data) < (1 << 16) // mean
    cut[:-1] &= (data & 0xC0) != 0x80  # never inside a character
    size = np.diff(offsets)
    # within a row's first bytes the window would reach into the row before
    for k in range(WINDOW):
        cut[offsets[:-1][size > k] + k] = False
    cut[offsets] = True
    edge = np.flatnonzero(cut)
    if not len(data):
        return edge[:0], edge[:0], np.zeros(len(offsets), np.int64)
    return edge[:-1], edge[1:], np.searchsorted(edge[:-1], offsets)


def sequences(seen: np.ndarray, rows: np.ndarray, before: np.ndarray, after: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the shortest sequences of seen chunks with so many words, from each first and to each last chunk.

    ``before`` and ``after`` count words up to a chunk's start, a word that it cuts not among them, and
    up to its end, so equal chunks have equal sequences. Every run of seen chunks with enough words is
    covered, and neither starts nor ends ever decrease.
    """
    run_start, run_end = spans(seen, rows)
    mine = np.flatnonzero(seen)
    low, high = np.repeat(run_start, run_end - run_start), np.repeat(run_end, run_end - run_start)
    last = np.maximum(np.searchsorted(after, before[mine] + least_words), mine)
    first = np.minimum(np.searchsorted(before, after[mine] - least_words, "right") - 1, mine)
    ahead, back = last < high, first >= low
    code = np.unique(np.r_[mine[ahead] * len(seen) + last[ahead], first[back] * len(seen) + mine[back]])
    return code // max(len(seen), 1), code % max(len(seen), 1) + 1


def least_of(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair; NO_ID where there are none."""
    out, size, width = np.full(len(low), NO_ID), high - low, 1
    while np.any(size >= width):
        at = np.flatnonzero((size >= width) & (size < 2 * width))
        out[at] = np.minimum(values[low[at]], values[high[at] - width])
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return out


def substring_dedup(df: DataFrame, least_words: int = 20, mean: int = MEAN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents that share a passage of at least ``least_words`` words in whole chunks with another one.

    doc_id, n_chunks, n_passages, repeated_bytes, removed_bytes, first_ids (the documents that hold
    the passages first), passages (byte start and end of each), kept (the text without the
    passages' chunks that stand there in a smaller doc_id) and kept_sha256. Documents without such a
    passage give no row. A passage stands chunk by chunk in another document, or is made of such
    passages that touch or overlap; the smallest doc_id that holds one keeps it. Rows that
    share a doc_id are one document, rows without one count as the largest. Null and empty texts
    have no chunks. Texts are cut whole, however long; an empty table gives an empty result; only the
    two named columns are read.
    """
    docs = pick(df, id_column, text_column).toDF("doc_id", "text")
    (n, fine), folder = shards_of(docs), Folder(df.sparkSession)
    buckets = n * fine

    def tables(name: str, width: int) -> list[tuple[np.ndarray, ...]]:
        return [x for k in range(n) for x in zip(*[iter(folder.unpack(f"{name}-{k}"))] * width, strict=True)]

    def parts(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids = pc.fill_null(part.column(0), NO_ID).to_numpy(zero_copy_only=False)
                data, offsets = utf8(part.column(1))
                starts, ends, rows = chunks(data, offsets, mean)
                yield part, ids, data, offsets, starts, ends, rows, span_hashes(data, starts, ends)

    def owned(batches):
        for _, ids, _, _, _, _, rows, key in parts(batches):
            yield key, np.zeros(len(key), np.uint8), np.repeat(ids, np.diff(rows))

    def candidates(batches):
        """The parts with words up to each byte, and sequences of repeated chunks with their digests."""
        repeated = [x[0] for x in tables("key", 3)]
        for part, ids, data, offsets, starts, ends, rows, key in parts(batches):
            seen = find(repeated, key)[1]
            solid = ~WHITE[data]
            word = solid.copy()
            word[1:] &= ~solid[:-1]
            word[offsets[:-1][np.diff(offsets) > 0]] = solid[offsets[:-1][np.diff(offsets) > 0]]
            count = np.concatenate(([0], np.cumsum(word)))
            begin, end = sequences(seen, rows, count[starts] - (solid & ~word)[starts], count[ends], least_words)
            check = span_hashes(data, starts[begin], ends[end - 1], 2)
            yield part, ids, data, offsets, starts, ends, rows, count, begin, end, span_hashes(key.view(np.uint8), 8 * begin, 8 * end, 1), check

    def owned_sequences(batches):
        for _, ids, *_, rows, _, begin, _, key, check in candidates(batches):
            yield key, check, ids[np.searchsorted(rows, begin, "right") - 1]

    def find(shards, key):
        """(position in its bucket's table, found) of each key; the tables are sorted."""
        kinds, back = np.unique(key, return_inverse=True)
        edge = np.searchsorted(shard_of(kinds, buckets), np.arange(buckets + 1))
        at, found = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), bool)
        for k in np.flatnonzero(np.diff(edge)):
            at[edge[k] : edge[k + 1]], found[edge[k] : edge[k + 1]] = lookup(shards[k], kinds[edge[k] : edge[k + 1]])
        return at[back], found[back]

    def digests(source, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out():
            columns = reduce(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            yield from blob_batches(by_shard(shard_of(columns[0], buckets), buckets, *columns))

        for key, check, owner in source(batches):
            held.append(reduce(key, check, owner, owner))
            if sum(len(x[0]) for x in held) > CHUNK:
                yield from out()
        if held:
            yield from out()

    def reduce(key, check, low, high):
        if not len(key):
            return key, check, low, high
        order = np.lexsort((check, key)) if check.any() else np.argsort(key)
        key, check = key[order], check[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
        return key[first], check[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)

    def table(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, kinds = TaskContext.get().partitionId(), 0
        with folder.pack(f"{name}-{shard}") as add:
            for _, blobs in buckets_of(batches, fine):
                key, check, low, high = reduce(*unpack(blobs, (np.uint64, np.uint8 if name == "key" else np.uint64, np.int64, np.int64)))
                again = low < high
                kinds += len(key)
                if name == "key":
                    add(key[again], key[:0], key[:0])
                    continue
                key, check, low = key[again], check[again], low[again]
                # of two sequences of one digest, which are hardly ever there, only the first could be found
                alone = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                add(key[alone], check[alone], low[alone])
        yield pa.RecordBatch.from_arrays([pa.array([kinds], pa.int64())], names=["kinds"])

    for name, source in (("key", owned), ("sequence", owned_sequences)):
        exchange(docs.mapInArrow(partial(digests, source), "bucket int, blob binary"), n, fine).mapInArrow(partial(table, name), "kinds long").agg(F.sum("kinds")).first()

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = tables("sequence", 3)
        keys = [x[0] for x in sequence]
        names = ("doc_id", "n_chunks", "n_passages", "repeated_bytes", "removed_bytes", "first_ids", "passages", "kept", "kept_sha256")
        types = (pa.int64(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.string(), pa.string())
        for part, ids, data, offsets, starts, ends, rows, count, begin, end, key, check in candidates(batches):
            at, hit = find(keys, key)
            low, bucket = np.zeros(len(key), np.int64), shard_of(key, buckets)
            for k in np.unique(bucket[hit]):
                mine = np.flatnonzero(hit & (bucket == k))
                _, checks, firsts = sequence[k]
                hit[mine] = checks[at[mine]] == check[mine]
                low[mine] = firsts[at[mine]].view(np.int64)
            begin, end, low = begin[hit], end[hit], low[hit]
            # starts and ends are in order, so the sequences over a chunk are neighbours
            chunk = np.arange(len(starts))
            first = least_of(low, np.searchsorted(end, chunk, "right"), np.searchsorted(begin, chunk, "right"))
            seen = np.searchsorted(end, chunk, "right") < np.searchsorted(begin, chunk, "right")
            run_start, run_end = spans(seen, rows)
            long = count[ends[run_end - 1]] - count[starts[run_start]] >= least_words if len(run_start) else np.zeros(0, bool)
            run_start, run_end = run_start[long], run_end[long]
            owner = np.searchsorted(rows, run_start, "right") - 1
            out = []
            for row in np.unique(owner):
                mine = np.flatnonzero(owner == row)
                inside = np.concatenate([np.arange(run_start[k], run_end[k]) for k in mine])
                gone = inside[first[inside] != ids[row]]
                size = ends - starts
                base = offsets[row]
                stays = np.ones(rows[row + 1] - rows[row], bool)
                stays[gone - rows[row]] = False
                kept = b"".join(data[starts[c] : ends[c]].tobytes() for c in np.flatnonzero(stays) + rows[row]).decode("utf-8", "replace")
                out.append((part.column(0)[int(row)].as_py(), len(stays), len(mine), int(size[inside].sum()), int(size[gone].sum()), np.unique(first[inside]).tolist(), [[int(starts[run_start[k]] - base), int(ends[run_end[k] - 1] - base)] for k in mine], kept, hashlib.sha256(kept.encode()).hexdigest()))
            yield from blob_batches(out, names, types)

    return docs.mapInArrow(passages, "doc_id long, n_chunks long, n_passages long, repeated_bytes long, removed_bytes long, first_ids array<long>, passages array<array<long>>, kept string, kept_sha256 string")
