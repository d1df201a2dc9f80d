"""Quality classifier: hashed word n-gram logistic regression, learnt by follow-the-regularised-leader.

Every word gives three hashed tokens: itself, its shape (what it has besides letters, its case, its
length class) and whether it repeats the word before. Features are single tokens and pairs of
neighbours, hashed into 2**20 weights; a text's vector has their counts, scaled to length one, so
its score is one sparse dot product. A bounded sample of labelled rows (``sample``, the smallest
hashes of doc_id) is learnt in one place; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import numbered, pick
from ._text import ngrams, slices, span_hashes, words

BITS = 20


def _shapes(w, raw: np.ndarray) -> np.ndarray:
    """A hash of each word with letters and digits reduced to classes."""
    classes = np.arange(256, dtype=np.uint8)
    classes[0x61:0x7B] = classes[0x80:] = 0
    classes[0x41:0x5B] = 1
    classes[0x30:0x3A] = 2
    kind = classes[raw]
    edge = np.concatenate(([0], np.cumsum(kind > 2)))
    marks = edge[w.ends] - edge[w.starts]
    count = lambda c: (lambda e: e[w.ends] - e[w.starts])(np.concatenate(([0], np.cumsum(kind == c))))
    upper, digits, length = count(1), count(2), w.ends - w.starts
    tail = span_hashes(np.where(kind > 2, kind, 0).astype(np.uint8), np.maximum(w.starts, w.ends - 3), w.ends) if len(w.starts) else np.zeros(0, np.uint64)
    form = np.minimum(marks, 4) + 5 * np.where(upper == 0, 0, np.where(upper + marks + digits >= length, 2, 1)) + 15 * (digits > 0) + 30 * np.minimum(np.log2(length + 1).astype(np.int64), 6)
    return tail * np.uint64(0x100000001B3) + form.astype(np.uint64)


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, row edges): the rows' sparse vectors of length one; empty texts have none."""
    w = words(column)
    raw = words(column, lower=False).data
    n = len(w.hashes)
    row = w.row_of()
    shape = _shapes(w, raw)
    new = np.r_[True, row[1:] != row[:-1]] if n else np.zeros(0, bool)
    repeats = np.where(new, 2, np.r_[0, w.hashes[1:] == w.hashes[:-1]] if n else np.zeros(0)).astype(np.uint64)
    tokens = [w.hashes, shape * np.uint64(3), repeats + np.uint64(0x51ED270B)]
    keys, rows = [], []
    for k, t in enumerate(tokens):
        keys.append(ngrams(t + np.uint64(k), 1))
        rows.append(row)
        if k < 2 and n > 1:
            keys.append(ngrams(t + np.uint64(k + 7), 2)[~new[1:]])
            rows.append(row[1:][~new[1:]])
    at = (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64) | np.concatenate(rows).astype(np.int64) << BITS
    at, count = np.unique(at, return_counts=True)
    owner, index = at >> BITS, (at & ((1 << BITS) - 1)).astype(np.int32)
    edge = np.searchsorted(owner, np.arange(len(w.rows)))
    square = np.bincount(owner, count.astype(np.float64) ** 2, len(w.rows) - 1)
    return index, (count / np.sqrt(square)[owner]).astype(np.float32), edge


@dataclass
class Quality:
    """Weights only: without an intercept a text that has no known feature scores 0.5."""

    weights: np.ndarray

    def scores(self, column) -> np.ndarray:
        index, value, edge = features(column)
        total = np.concatenate(([0.0], np.cumsum(self.weights[index] * value.astype(np.float64))))
        return 1 / (1 + np.exp(-np.clip(total[edge[1:]] - total[edge[:-1]], -35, 35)))

    def score_frame(self, df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 on) of every row.

        A null or empty text scores 0.5. Repeated rows are scored
        each by itself; only the two named columns are read; an empty table gives an empty result.
        """
        sent = df.sparkSession.sparkContext.broadcast(self.weights)  # 2**20 weights at any size of input

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Quality(sent.value)
            for batch in batches:
                for part in slices(batch, "text", 2 << 20):
                    score = model.scores(part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return pick(df, id_column, text_column).toDF("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")

    def keep(self, df: DataFrame, text_column: str = "text") -> DataFrame:
        """The rows that score 0.5 or more, with all their columns and as they are. Nothing is joined:
        the rows pass through the scoring, so null and repeated ids need no rule."""
        sent = df.sparkSession.sparkContext.broadcast(self.weights)
        at = df.columns.index(text_column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Quality(sent.value)
            for batch in batches:
                for part in slices(batch, at, 2 << 20):
                    yield part.filter(pa.array(model.scores(part.column(at)) >= 0.5))

        whole = numbered(df)
        return whole.mapInArrow(run, whole.schema).toDF(*df.columns)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.02) -> Quality:
    """FTRL-proximal over (features, values, label), in the order given. Classes weigh alike."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    ones = sum(y for _, _, y in rows)
    weigh = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))} if 0 < ones < len(rows) else {0: 1.0, 1: 1.0}

    def solved(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(passes):
        for index, value, y in rows:
            w = solved(z[index], n[index])
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * weigh[y]
            for_all = g * value
            z[index] += for_all - (np.sqrt(n[index] + for_all**2) - np.sqrt(n[index])) / alpha * w
            n[index] += for_all**2
    return Quality(solved(z, n).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Quality:
    """Learn from at most ``sample`` labelled documents, those with the smallest hashes of doc_id.

    Labels that are null count as none; of several labels of a document the largest counts, of
    several texts each. Without labelled rows every score is 0.5.
    """
    chosen = pick(labels, id_column, label_column).toDF("doc_id", "y").filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = pick(docs, id_column, text_column).toDF("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                index, value, edge = features(part.column(2))
                cut = lambda a: [a[edge[k] : edge[k + 1]].tobytes() for k in range(part.num_rows)]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cut(index), pa.binary()), pa.array(cut(value), pa.binary())], names=["doc_id", "y", "index", "value"])

    rows = [(r.doc_id, r.y, bytes(r["index"]), bytes(r.value)) for r in texts.mapInArrow(run, "doc_id long, y int, index binary, value binary").toLocalIterator()]
    rows.sort(key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, r[2]))
    if not rows:
        return Quality(np.zeros(1 << BITS, np.float32))
    return follow_the_leader([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), int(y > 0)) for _, y, i, v in rows])
