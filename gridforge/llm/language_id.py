"""Language identification with a linear-chain conditional random field over words.

Words (runs of letters) are labelled by affix, character n-gram and lexicon features and learned
transitions; forward-backward gives each word's distribution, and the text's language is the one
with the largest sum. Training texts have one label each, so code-switched sequences are spliced
from texts of different languages to learn the transitions.

Inference runs over a whole batch of texts at once: the texts form one chain whose matrix at each
text's first word forgets what came before. Blocks of the chain are multiplied side by side, a short
loop joins the blocks, and forward and backward vectors are filled in within all blocks together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import pick
from ._text import LOWER, slices, span_hashes, spans, utf8

BITS = 17
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
UNKNOWN = "und"
SALTS = 16


@dataclass
class Chain:
    """The words of a column: lower-cased bytes, spans, hashes, and each row's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, column) -> Chain:
        data, offsets = utf8(column)
        starts, ends = spans(LETTER[data], offsets)
        data = LOWER[data]
        return cls(data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, edges by word): word, prefixes and suffixes of 1 to 4 bytes, pairs and triples of bytes."""
    length = ends - starts
    edge = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(edge[-1]) + np.repeat(starts - edge[:-1], length)
    left = np.repeat(edge[1:], length) - np.arange(edge[-1])  # bytes to the word's end, this one included
    b = data[at].astype(np.uint32)
    pad = np.concatenate((b, np.zeros(3, np.uint32)))
    two = np.where(left > 1, b << 8 | pad[1 : len(b) + 1], 0)
    three = np.where(left > 2, b << 16 | pad[1 : len(b) + 1] << 8 | pad[2 : len(b) + 2], 0)
    owner = np.repeat(np.arange(len(starts)), length)
    keys, owners = [], []

    def add(value: np.ndarray, kind: int, whose: np.ndarray) -> None:
        keys.append((value.astype(np.uint64) + np.uint64(kind << 33)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS))
        owners.append(whose)

    add(two[left > 1], 1, owner[left > 1])
    add(three[left > 2], 2, owner[left > 2])
    for size in range(1, 5):
        whole = np.flatnonzero(length >= size)
        head = tail = np.zeros(len(whole), np.uint32)
        for k in range(size):
            head = head << np.uint32(8) | data[starts[whole] + k]
            tail = tail << np.uint32(8) | data[ends[whole] - size + k]
        add(head, 2 + size, whole)
        add(tail, 6 + size, whole)
    every = np.arange(len(starts))
    add(hashes >> np.uint64(32), 11, every)
    key, whose = np.concatenate(keys).astype(np.int32), np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    return key[order], np.searchsorted(whose[order], np.arange(len(starts) + 1))


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # [2**BITS, L]
    transitions: np.ndarray  # [L, L]
    begin: np.ndarray  # [L]
    lexicon: np.ndarray  # sorted word hashes
    entries: np.ndarray  # [words, L]: the word's share of each language
    trust: np.ndarray  # [L]: weights of the lexicon features

    def emissions(self, data, starts, ends, hashes) -> np.ndarray:
        key, edge = word_features(data, starts, ends, hashes)
        out = np.empty((len(starts), len(self.languages)), np.float32)
        for low in range(0, len(starts), 1 << 15):
            high = min(low + (1 << 15), len(starts))
            out[low:high] = np.add.reduceat(self.weights[key[edge[low] : edge[high]]], edge[low:high] - edge[low])
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            found = self.lexicon[at] == hashes
            out[found] += self.entries[at[found]] * self.trust
        return out

    def posteriors(self, chain: Chain) -> np.ndarray:
        """[words, L]: each word's distribution, by forward-backward over its whole text."""
        n, size = len(chain.hashes), len(self.languages)
        if not n:
            return np.zeros((0, size))
        kinds, first, back = np.unique(chain.hashes, return_index=True, return_inverse=True)
        e = self.emissions(chain.data, chain.starts[first], chain.ends[first], kinds)
        e = np.exp(e - e.max(1, keepdims=True))
        step = max(1, int(np.sqrt(n)) // 4)
        blocks = -(-n // step)
        new = np.zeros(blocks * step, bool)
        heads = chain.rows[:-1][np.diff(chain.rows) > 0]
        new[heads] = True
        emit = np.ones((blocks * step, size), np.float32)
        emit[:n] = e[back]
        new, emit = new.reshape(blocks, step), emit.reshape(blocks, step, size)
        move, begin = np.exp(self.transitions).astype(np.float32), np.exp(self.begin).astype(np.float32)

        def ahead(v, t):  # row vectors (any number a block) through the matrix of place t
            moved = v @ move
            cut = new[:, t]
            moved[cut] = v[cut].sum(-1, keepdims=True) * begin
            moved *= emit[:, t].reshape(blocks, *[1] * (v.ndim - 2), size)
            return moved / np.maximum(moved.sum(axis=tuple(range(1, v.ndim)), keepdims=True), 1e-30)

        product = np.tile(np.eye(size, dtype=np.float32), (blocks, 1, 1))
        for t in range(step):
            product = ahead(product, t)
        enter = np.empty((blocks, size), np.float32)
        leave = np.empty((blocks, size), np.float32)
        v = np.full(size, 1.0 / size, np.float32)
        for k in range(blocks):
            enter[k] = v
            v = v @ product[k]
            v /= max(v.sum(), 1e-30)
        u = np.ones(size, np.float32)
        for k in range(blocks - 1, -1, -1):
            leave[k] = u
            u = product[k] @ u
            u /= max(u.sum(), 1e-30)
        forward = np.empty((blocks, step, size), np.float32)
        v = enter
        for t in range(step):
            v = forward[:, t] = ahead(v, t)
        u = leave
        out = np.empty_like(forward)
        for t in range(step - 1, -1, -1):
            out[:, t] = forward[:, t] * u
            w = u * emit[:, t]
            u = w @ move.T
            cut = new[:, t]
            u[cut] = (w[cut] @ begin)[:, None]
            u /= np.maximum(u.sum(1, keepdims=True), 1e-30)
        out = out.reshape(-1, size)[:n].astype(np.float64)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)

    def predict(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, shares of the languages) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros((len(column), 0))
        chain = Chain.of(column)
        p = self.posteriors(chain)
        n = np.diff(chain.rows)
        total = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, 0)))
        share = (total[chain.rows[1:]] - total[chain.rows[:-1]]) / np.maximum(n, 1)[:, None]
        best = share.argmax(1)
        score = share[np.arange(len(best)), best]
        ascii_letters = np.concatenate(([0], np.cumsum(chain.data[chain.starts] < 0x80)))
        plain = ascii_letters[chain.rows[1:]] > ascii_letters[chain.rows[:-1]]
        names = [self.languages[b] for b in best]
        for k in np.flatnonzero(~plain):
            text = column[int(k)].as_py()
            if not n[k] or not any(map(str.isalpha, text or "")):
                names[k], score[k] = UNKNOWN, 0.0
        return names, np.clip(score, 0, 1), share

    def predict_frame(self, df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """doc_id, lang_pred, score (the language's share of the text's words), shares by language.

        ``und`` with score 0 where the text is null or has no letter, or where nothing was learnt. Long texts are read whole;
        repeated rows are judged each by itself, ties go to the language that sorts first, an empty
        table gives an empty result, and only the two named columns are read.
        """
        sent = df.sparkSession.sparkContext.broadcast(self)  # 2**17 x languages weights and a bounded lexicon

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                for part in slices(batch, "text", 4 << 20):
                    names, score, share = model.predict(part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(list(share), pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "shares"])

        return pick(df, id_column, text_column).toDF("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, shares array<double>")


def train(df: DataFrame, sample: int = 1000, length: int = 32, rounds: int = 80, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Crf:
    """Learn from at most ``sample`` labelled texts, shared out evenly among the languages (of each
    language those with the smallest hashes of doc_id). Rows with a null language, text or doc_id are passed over;
    a repeated row counts again. With no labelled text every prediction is ``und``."""
    rows = pick(df, id_column, text_column, lang_column).toDF("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    most = max(1, sample // max(1, len(names)))
    chosen = rows.select("lang", "doc_id").distinct().withColumns({"hash": F.xxhash64("doc_id"), "salt": F.pmod(F.hash("doc_id"), F.lit(SALTS))})
    for by in (("lang", "salt"), ("lang",)):  # a language may hold most rows: its last window sees SALTS * most of them
        order = Window.partitionBy(*by).orderBy("hash", "doc_id")
        chosen = chosen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    chosen = chosen.select("lang", "doc_id")
    got = rows.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").select("lang", "text").toLocalIterator()
    pairs = sorted((names.index(r.lang), r.text) for r in got)
    labels, texts = [k for k, _ in pairs], [t for _, t in pairs]
    return fit(texts, labels, names, length, rounds)


def fit(texts: list[str], labels: list[int], names: list[str], length: int = 32, rounds: int = 80, batch: int = 192, seed: int = 5) -> Crf:
    """Adam on the sequences' log likelihood; gradients are expected less observed counts."""
    size = len(names)
    chain = Chain.of(pa.array(texts, pa.large_string()))
    weights = np.zeros((1 << BITS, max(size, 1)), np.float32)
    model = Crf(names, weights, np.zeros((size, size)), np.zeros(size), np.zeros(0, np.uint64), np.zeros((0, size), np.float32), np.ones(size, np.float32))
    if not size or not len(chain.hashes):
        return model
    kinds, first, back = np.unique(chain.hashes, return_index=True, return_inverse=True)
    owner = np.repeat(np.asarray(labels), np.diff(chain.rows))
    text_of = np.repeat(np.arange(len(texts)), np.diff(chain.rows))
    # the lexicon: words of three texts or more, with their shares of the languages' words
    pairs = np.unique(back.astype(np.int64) << 32 | text_of)
    listed = np.flatnonzero(np.bincount(pairs >> 32, minlength=len(kinds)) >= 3)
    share = np.zeros((len(kinds), size))
    np.add.at(share, (back, owner), 1.0 / np.bincount(owner, minlength=size)[owner])
    model.lexicon = kinds[listed]
    model.entries = (share[listed] / share[listed].sum(1, keepdims=True)).astype(np.float32)
    key, edge = word_features(chain.data, chain.starts[first], chain.ends[first], kinds)
    rng = np.random.default_rng(seed)
    starts_by = [np.flatnonzero(owner == k) for k in range(size)]
    state = {name: [np.zeros_like(getattr(model, name), dtype=np.float64) for _ in range(2)] for name in ("weights", "transitions", "begin", "trust")}
    for step in range(1, rounds + 1):
        # sequences of one to four runs of neighbouring words, each run from one text
        words_at = np.empty((batch, length), np.int64)
        truth = np.empty((batch, length), np.int64)
        for b in range(batch):
            cuts = np.sort(rng.choice(np.arange(1, length), rng.integers(0, 4), replace=False))
            for low, high in zip([0, *cuts], [*cuts, length], strict=True):
                k = int(rng.integers(size))
                while not len(starts_by[k]):
                    k = int(rng.integers(size))
                at = int(rng.choice(starts_by[k]))
                run = np.minimum(np.arange(at, at + high - low), chain.rows[text_of[at] + 1] - 1)
                words_at[b, low:high], truth[b, low:high] = back[run], k
        used, place = np.unique(words_at, return_inverse=True)
        place = place.reshape(batch, length)
        e = model.emissions(chain.data, chain.starts[first][used], chain.ends[first][used], kinds[used]).astype(np.float64)
        emit = np.exp(e[place] - e[place].max(2, keepdims=True))
        move, begin = np.exp(model.transitions), np.exp(model.begin)
        alpha, beta = np.empty((batch, length, size)), np.ones((batch, length, size))
        v = begin * emit[:, 0]
        alpha[:, 0] = v / v.sum(1, keepdims=True)
        for t in range(1, length):
            v = alpha[:, t - 1] @ move * emit[:, t]
            alpha[:, t] = v / v.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            v = (beta[:, t + 1] * emit[:, t + 1]) @ move.T
            beta[:, t] = v / v.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        pairs_p = alpha[:, :-1, :, None] * move * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
        pairs_p /= pairs_p.sum((2, 3), keepdims=True)
        one = np.eye(size)[truth]
        gap = (p - one) / batch
        by_word = np.zeros((len(used), size))
        np.add.at(by_word, place.ravel(), gap.reshape(-1, size))
        count = edge[used + 1] - edge[used]
        flat = np.concatenate([key[edge[w] : edge[w + 1]] for w in used])
        touched, to = np.unique(flat, return_inverse=True)
        grad_w = np.zeros((len(touched), size))
        np.add.at(grad_w, to, np.repeat(by_word, count, 0))
        seen = np.zeros((size, size))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1.0)
        in_lexicon = np.searchsorted(model.lexicon, kinds[used])
        in_lexicon = np.minimum(in_lexicon, max(len(model.lexicon) - 1, 0))
        known = model.lexicon[in_lexicon] == kinds[used] if len(model.lexicon) else np.zeros(len(used), bool)
        grads = {"weights": (touched, grad_w), "transitions": (slice(None), pairs_p.sum((0, 1)) / batch - seen / batch + 1e-3 * model.transitions), "begin": (slice(None), gap[:, 0].sum(0)), "trust": (slice(None), (by_word[known] * model.entries[in_lexicon[known]]).sum(0) if known.any() else np.zeros(size))}
        for name, (where, g) in grads.items():
            m, s = state[name]
            m[where] = 0.8 * m[where] + 0.2 * g
            s[where] = 0.98 * s[where] + 0.02 * g * g
            rate = 0.06 if name != "weights" else 0.03
            getattr(model, name)[where] -= (rate * (m[where] / (1 - 0.8**step)) / (np.sqrt(s[where] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return model
