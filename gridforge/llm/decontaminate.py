"""Benchmark decontamination with seeds that no leak can miss.

A run of m matching words with s replaced ones has m / (s + 1) neighbouring matches at least, rounded
up. For each length of an item the least of these over all runs that count is the length of its seeds,
three words for nearly all at 75 percent; short items for which it is less have spaced seeds for the
patterns without three neighbours too. Seeds of all items are sorted arrays; each task looks up the
seeds at every word of its texts, turns hits into diagonals (item, place in the text less place in the
item) and compares the words along each diagonal once, many diagonals at a time. Where enough words
match in all, the run with most matches of those that agree in ``percent`` must have enough of them.

The benchmark is worked off in blocks of at most ``BLOCK`` bytes of text, which is what a worker
holds; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import blob_batches, lookup, numbered, pick
from ._text import BASE, mix, slices, span_hashes, spans, utf8

#: Words of a seed that is sure to hit, where runs allow so many; items up to SHORT words have spaced seeds for SEED neighbours or more.
SEED, MOST_SEED, SHORT = 3, 8, 12
#: Items of fewer words are compared with whole texts.
LEAST_ITEM = 5
#: Hits, and words along diagonals, that are worked off at a time.
PIECE = 1 << 18
BLOCK = 32 << 20
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row edges); words are runs of letters, digits and characters beyond ASCII, all lower-cased."""
    data, offsets = utf8(pc.utf8_lower(column))
    starts, ends = spans(WORD[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def seeds(hashes: np.ndarray, rows: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) at every place from which the mask stays within its row."""
    span = len(mask)
    size = max(0, len(hashes) - span + 1)
    total = np.zeros(size, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = total * BASE + hashes[k : k + size]
    left = np.repeat(rows[1:], np.diff(rows))[:size] - np.arange(size)
    at = np.flatnonzero(left >= span)
    return mix(total[at] ^ np.uint64(sum(1 << k for k, b in enumerate(mask) if b == "1"))), at


def least_match(size: int, least_words: int, percent: int) -> int:
    """Matching words that a run needs in an item of so many words."""
    return max(1, min(least_words, -(-percent * size // 100)))


def masks_of(size: int, least_words: int, percent: int) -> set[str]:
    """Masks of which one hits in every run of ``percent`` agreement and enough matches in an item of ``size`` words."""
    need = least_match(size, least_words, percent)
    match = np.arange(need, size + 1)
    other = np.minimum(match * (100 - percent) // percent, size - match)
    sure = int((-(-match // (other + 1))).min())
    if sure >= SEED or size > SHORT:
        return {"1" * min(sure, MOST_SEED)}
    run = "1" * SEED
    every = ("".join("01"[k in at] for k in range(size)) for at in map(set, combinations(range(size), need)))
    return {run} | {mask.strip("0") for mask in every if run not in mask}


class Index:
    """Seeds of a block of items by mask, sorted, with their places."""

    def __init__(self, ids: list, texts: list[str | None], least_words: int, percent: int):
        self.ids = ids
        self.hashes, self.rows = word_hashes(pa.array(texts, pa.large_string()))
        size = np.diff(self.rows)
        self.need = np.zeros(len(ids), np.int64)
        owners: dict[str, np.ndarray] = {}
        for n in np.unique(size[size >= LEAST_ITEM]).tolist():
            self.need[size == n] = least_match(n, least_words, percent)
            for mask in masks_of(n, least_words, percent):
                owners[mask] = owners.get(mask, False) | (size == n)
        item_of = np.repeat(np.arange(len(ids)), size)
        self.short: dict[bytes, list[int]] = {}
        for k in np.flatnonzero((size > 0) & (size < LEAST_ITEM)).tolist():
            self.short.setdefault(self.hashes[self.rows[k] : self.rows[k + 1]].tobytes(), []).append(k)
        self.tables = []
        for mask, own in owners.items():
            key, at = seeds(self.hashes, self.rows, mask)
            mine = own[item_of[at]]
            key, at = key[mine], at[mine]
            order = np.argsort(key, kind="stable")
            self.tables.append((mask, key[order], at[order]))

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, row, where the item's first word would stand), distinct for each piece of hits."""
        for mask, keys, at in self.tables:
            mine, place = seeds(hashes, rows, mask)
            low, some = lookup(keys, mine)
            some = np.flatnonzero(some)
            low, place = low[some], place[some]
            many = np.searchsorted(keys, mine[some], "right") - low
            edge = np.concatenate(([0], np.cumsum(many)))
            k = 0
            while k < len(some):
                stop = max(k + 1, int(np.searchsorted(edge, edge[k] + PIECE, "right")) - 1)
                n = many[k:stop]
                word = at[np.arange(n.sum()) + np.repeat(low[k:stop] - (edge[k:stop] - edge[k]), n)]
                yield self._diagonals(np.repeat(place[k:stop], n), word, hashes, rows)
                k = stop

    def _diagonals(self, place, word, hashes, rows):
        code = np.sort((place - word + len(self.hashes)) * len(hashes) + place)
        shift, place = code // len(hashes) - len(self.hashes), code % len(hashes)
        row = np.searchsorted(rows, place, "right") - 1
        item = np.searchsorted(self.rows, place - shift, "right") - 1
        new = np.ones(len(code), bool)
        new[1:] = (np.diff(shift) != 0) | (np.diff(row) != 0) | (np.diff(item) != 0)
        return item[new], row[new], (shift + self.rows[item])[new]

    def compared(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(item, row, where the item begins, first word compared, edges, agreement of each word) of diagonals with enough matches in all."""
        for item, row, at in self.hits(hashes, rows):
            low = np.maximum(at, rows[row])
            size = np.minimum(at + self.rows[item + 1] - self.rows[item], rows[row + 1]) - low
            some = np.flatnonzero(size >= self.need[item])
            item, row, at, low, size = (x[some] for x in (item, row, at, low, size))
            total = np.concatenate(([0], np.cumsum(size)))
            k = 0
            while k < len(some):
                stop = max(k + 1, int(np.searchsorted(total, total[k] + PIECE, "right")) - 1)
                n, edge = size[k:stop], total[k : stop + 1] - total[k]
                word = np.arange(edge[-1]) + np.repeat(low[k:stop] - edge[:-1], n)
                same = hashes[word] == self.hashes[word - np.repeat((at - self.rows[item])[k:stop], n)]
                enough = np.add.reduceat(same, edge[:-1], dtype=np.int64) >= self.need[item[k:stop]]
                if enough.any():
                    yield *(x[k:stop][enough] for x in (item, row, at, low)), np.concatenate(([0], np.cumsum(n[enough]))), same[np.repeat(enough, n)]
                k = stop

    def leaks(self, column, percent: int) -> dict[tuple[int, int], tuple]:
        """(words, matches, similarity, place in the text, place in the item) of each (row, item) that has a run that counts."""
        hashes, rows = word_hashes(column)
        best: dict[tuple[int, int], tuple] = {}
        for item, row, at, low, edge, same in self.compared(hashes, rows):
            start, end, most = longest_runs(same, edge, percent)
            some = np.flatnonzero(most >= self.need[item])
            columns = (item, row, start, end, most, low - rows[row] + start, low - at + start)
            for i, r, start_, end_, match, word, place in zip(*(x[some].tolist() for x in columns), strict=True):
                found = (end_ - start_, match, match / (end_ - start_), word, place)
                if (r, i) not in best or (match, -word, -place) > (best[r, i][1], -best[r, i][3], -best[r, i][4]):
                    best[r, i] = found
        size = np.diff(rows)
        for r in np.flatnonzero((size > 0) & (size < LEAST_ITEM)).tolist() if self.short else ():
            for i in self.short.get(hashes[rows[r] : rows[r + 1]].tobytes(), ()):
                best[r, i] = (int(size[r]), int(size[r]), 1.0, 0, 0)
        return best


def longest_runs(same: np.ndarray, edge: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, matches) of the run with most matches and ``percent`` agreement in each of the parts, of equal ones the first.

    For an end the best start is the first one whose prefix sum (a match adds 100 - percent, a
    substitution takes percent) isn't larger than the end's.
    """
    parts, size = len(edge) - 1, np.diff(edge) + 1
    of = np.repeat(np.arange(parts), size)
    place = np.arange(len(of)) - of
    score = np.concatenate(([0], np.cumsum(np.where(same, 100 - percent, -percent))))
    # parts lie below one another, so no start is found in a part before
    total = (score[place] - np.repeat(score[edge[:-1]], size)) - of * (200 * int(size.max()))
    start = place[np.searchsorted(-np.minimum.accumulate(total), -total)]
    match = np.concatenate(([0], np.cumsum(same)))
    many = match[place] - match[start]
    most = np.maximum.reduceat(many, edge[:-1] + np.arange(parts))
    first = np.flatnonzero(many == np.repeat(most, size))
    first = first[np.searchsorted(of[first], np.arange(parts))]
    # a run begins with a match
    hit = np.append(np.flatnonzero(same), len(same))
    begin = np.minimum(hit[np.searchsorted(hit, start[first])], place[first])
    return begin - edge[:-1], place[first] - edge[:-1], most


def contamination(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, percent: int = 75, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_words, n_match, similarity, doc_word, item_word of every leak.

    A leak is a run of words of a text, word by word beside an item, of which at least ``percent``
    agree and at least ``least_words`` match (for shorter items that share of their words). Of several runs of an item in a text the one with most matches counts, of equal
    ones the first. Items of fewer than 5 words are leaks where they are a text's only words, as such
    a run stands in many clean texts; null or empty texts and items have no words. Rows without doc_id are searched and reported without one; repeated rows report
    each, repeated items once; an empty table gives an empty result; only the named columns are read.
    Words are compared by 64-bit hashes.
    """
    texts = pick(docs, id_column, text_column).toDF("doc_id", "text")
    names = ("doc_id", "item_id", "n_words", "n_match", "similarity", "doc_word", "item_word")
    types = (*[pa.int64()] * 4, pa.float64(), pa.int64(), pa.int64())
    out = None
    for sent in _blocks(docs, benchmark, item_column, text_column):

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(*(list(c) for c in zip(*sent.value, strict=True)), least_words, percent) if sent.value else None
            for batch in batches if index else ():
                for part in slices(batch, "text", 4 << 20):
                    found = sorted(index.leaks(part.column(1), percent).items())
                    yield from blob_batches(((part.column(0)[r].as_py(), index.ids[item], *x) for (r, item), x in found), names, types)

        leaks = texts.mapInArrow(find, "doc_id long, item_id long, n_words long, n_match long, similarity double, doc_word long, item_word long")
        out = leaks if out is None else out.unionByName(leaks)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, percent: int = 75, text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """The rows without a leak as contamination() finds them, with all columns and as they are. They pass
    through the search, so nothing is joined and null or repeated ids need no rule."""
    names, at = docs.columns, docs.columns.index(text_column)
    sent_blocks, docs = _blocks(docs, benchmark, item_column, text_column), numbered(docs)
    for sent in sent_blocks:

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(*(list(c) for c in zip(*sent.value, strict=True)), least_words, percent) if sent.value else None
            for batch in batches:
                for part in slices(batch, at, 4 << 20):
                    stays = np.ones(part.num_rows, bool)
                    if index:
                        stays[[r for r, _ in index.leaks(part.column(at), percent)]] = False
                    yield part.filter(pa.array(stays))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.toDF(*names)


def _blocks(docs: DataFrame, benchmark: DataFrame, item_column: str, text_column: str) -> list:
    """The distinct items in broadcast blocks of at most BLOCK bytes each, or of one item that is larger."""
    items = pick(benchmark, item_column, text_column).toDF("item_id", "text").distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    blocks = max(1, -(-int(items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) // (BLOCK // 2)))
    of = lambda: F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    while blocks > 1 and not items.groupBy(of().alias("b")).agg(F.sum(size).alias("s"), F.count("*").alias("n")).filter((F.col("s") > BLOCK) & (F.col("n") > 1)).isEmpty():
        blocks *= 2
    sent = []
    for b in range(blocks):
        mine = items if blocks == 1 else items.filter(of() == b)
        sent.append(docs.sparkSession.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in mine.collect()), key=str)))
    return sent
