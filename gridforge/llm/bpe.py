"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a piece ends in one token that is known without merging anything:
the only token that ends there and is compatible with the last token of the prefix before it. An
automaton of the vocabulary gives the tokens that end at each place, longest first; a walk up the
right side of one token and the left side of the other tells whether any merge would cross between
them. The last tokens of all prefixes are back pointers; following them from the end gives the ids.

All of it runs on arrays: texts are split by character classes, and the distinct pieces of a batch
(found by hash, told apart by their bytes) go through the prefixes together, one byte of each at a time. Tests of
token pairs are kept in a table of fixed size. Pieces of more than LONG bytes go one by one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._frames import lookup, pick
from ._text import same_spans, slices, span_hashes, utf8

KEPT = 1 << 20
LONG = 64
#: A rank past all others.
NONE = 1 << 30
#: The contractions that byte-level vocabularies split off.
ONE, TWO = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: Unicode's White_Space beside the space U+0020.
WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, WHITE, BLANK = 0, 1, 2, 3, 4


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        for m in regex.finditer(rf"\p{{{name}}}+", text):
            out[m.start() : m.end()] = kind
    out[WHITE_SPACE] = WHITE
    out[0x20] = BLANK
    return out


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of every piece, each row's first piece and the end).

    A piece is a contraction, a run of letters, of numbers or of other characters with at most one
    blank in front, or white space; of white space before something else the last character stands
    for itself.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes()[points]
    rows = np.searchsorted(lead, offsets)
    head = np.zeros(n + 1, bool)
    head[rows] = True  # of a row, and past the end
    white = kind >= WHITE
    before = np.r_[np.uint8(255), kind[:-1]]
    before[head[:-1]] = 255
    white_before = np.r_[False, white[:-1]] & ~head[:-1]
    solid_next = np.r_[~white[1:], False] & ~head[1:]
    start = np.where(white, ~white_before | solid_next, (kind != before) & (before != BLANK))
    start |= head[:-1]
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        room = rows[np.searchsorted(rows, quote, "right")] - quote
        padded = np.r_[points, np.zeros(2, np.uint32)]
        one, two = padded[quote + 1], padded[quote + 2]
        short = (room > 1) & np.isin(one, [ord(c) for c in ONE])
        long = (room > 2) & ~short & np.any([(one == ord(x[0])) & (two == ord(x[1])) for x in TWO], axis=0)
        start[quote[short | long] + 1] = False
        for which, size in ((short, 2), (long, 3)):
            after = quote[which] + size
            start[after[after < n]] = True
        # a quote inside a contraction's reach can't be: the letters after it are no quotes
    pieces = np.flatnonzero(start)
    return lead[pieces], np.searchsorted(pieces, rows)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Suffix links over the trie of the vocabulary's byte strings: which tokens end at each place of a text.

    The links lead from a state to the longest of its suffixes that is a state, so a walk along them
    gives all tokens that end there, longest first. States are numbered by depth, and all of it is
    arrays of one number a state or edge: the edge of a state and a byte lies at base[state] + byte
    if owner has the state there, and else the next suffix with edges is asked, at last the root,
    which has one for every byte."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, ids: np.ndarray):
        """Of the byte strings data[edges[k] : edges[k + 1]], which are the tokens ids[k]."""
        size, at = np.diff(edges), np.zeros(len(ids), np.int64)
        keys, n, levels = [], 1, [0, 1]
        for depth in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > depth)
            key, back = np.unique(at[live] << 8 | data[edges[live] + depth], return_inverse=True)
            at[live] = n + back
            keys.append(key)
            n += len(key)
            levels.append(n)
        key = np.concatenate(keys or [np.zeros(0, np.int64)])  # in order; edge k leads to state k + 1
        parent, byte = key >> 8, (key & 255).astype(np.int32)
        self.token = np.full(n, -1, np.int32)
        self.token[at] = ids
        self.length = np.repeat(np.arange(len(levels) - 1, dtype=np.int32), np.diff(levels))
        suffix, self.near, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        inner, self.fall = np.bincount(parent, minlength=n) > 0, np.zeros(n, np.int32)
        for low, high in zip(levels[1:-1], levels[2:], strict=True):
            states = np.arange(low, high)
            todo = states[parent[states - 1] > 0]
            link = suffix[parent[todo - 1]].astype(np.int64)
            while len(todo):
                place, found = lookup(key, link << 8 | byte[todo - 1])
                suffix[todo[found]] = place[found] + 1
                more = ~found & (link > 0)
                todo, link = todo[more], suffix[link[more]].astype(np.int64)
            after = suffix[states]
            self.link[states] = self.near[after]
            self.near[states] = np.where(self.token[states] >= 0, states, self.link[states])
            self.fall[states] = np.where(inner[after], after, self.fall[after])
        self._place(parent, byte, n)

    def _place(self, parent: np.ndarray, byte: np.ndarray, n: int) -> None:
        """Lay the states' edges into one row: those of states with several where they fit, others into the gaps."""
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(parent)))
        self.base = np.zeros(n, np.int32)  # before the root's edges lie none
        used = bytearray(512 + 257 * len(parent))
        used[:512] = b"\1" * 512
        self.base[0] = at = 256
        for k in np.argsort(-many, kind="stable").tolist():
            if parent[first[k]] == 0:
                continue
            if many[k] == 1:
                break
            bytes_ = byte[first[k] : first[k] + many[k]].tolist()
            while any(used[at + c] for c in bytes_):
                at += 1
            for c in bytes_:
                used[at + c] = 1
            self.base[parent[first[k]]] = at
        single = first[(many == 1) & (parent[first] > 0)]
        taken = np.frombuffer(used, np.uint8)
        gaps = np.flatnonzero(taken[: np.flatnonzero(taken)[-1] + 1 + len(single)] == 0)[: len(single)]
        self.base[parent[single]] = gaps - byte[single]
        size = int(self.base.max()) + 256
        self.owner, self.target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.owner[256:512] = 0
        at = self.base[parent] + byte
        self.owner[at], self.target[at] = parent, np.arange(1, n)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        at = self.base[state] + byte
        out, todo = self.target[at], np.flatnonzero(self.owner[at] != state)
        state, byte = self.fall[state[todo]], byte[todo]
        while len(todo):
            at = self.base[state] + byte
            hit = self.owner[at] == state
            out[todo[hit]] = self.target[at[hit]]
            todo, state, byte = todo[~hit], self.fall[state[~hit]], byte[~hit]
        return out


class Bpe:
    """A byte-level vocabulary of a tokenizers JSON file.

    A worker keeps one for as long as it lives, beside what later stages need, so what encodes and
    decodes are small arrays only; dictionaries are made where they are asked for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        raw = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(raw) + 1
        self.plain = np.array(sorted(vocab.values()), np.int32)
        self.token_size = np.array([len(raw.get(i, b"")) for i in range(size)])
        self.token_edge = np.concatenate(([0], np.cumsum(self.token_size)))
        self.token_data = np.frombuffer(b"".join(raw.get(i, b"") for i in range(size)), np.uint8)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: parts and result of each merge, in order of rank; the later a merge, the larger its rank, and a token's parts come before it
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)
        del spec, vocab, raw, pairs
        edges = np.concatenate(([0], np.cumsum(self.token_size[self.plain])))
        data, _ = _gather(self.token_data, self.token_edge[:-1], self.token_size, self.plain)
        self.automaton = Automaton(data, edges, self.plain)
        made = np.full(size, -1, np.int32)
        made[self.merges[::-1, 2]] = np.arange(len(self.merges), dtype=np.int32)[::-1]
        self.right_symbol, self.right_taken = self._sides(made, 1)
        self.left_symbol, self.left_taken = self._sides(made, 0)
        key = self.merges[:, 0].astype(np.int64) << 20 | self.merges[:, 1]
        order = np.argsort(key, kind="stable")
        order = order[np.r_[key[order][1:] != key[order][:-1], True]] if len(order) else order
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.compatible: dict[int, bool] = {}
        self._pair = np.full(KEPT, -1, np.int64)

    @cached_property
    def rank(self) -> dict[tuple[int, int], int]:
        """Rank of each merge."""
        return {(a, b): k for k, (a, b, _) in enumerate(self.merges.tolist())}

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        """Bytes of each token."""
        data, edge = self.token_data.tobytes(), self.token_edge.tolist()
        return {i: data[edge[i] : edge[i + 1]] for i in [*self.plain.tolist(), *self.special.values()]}

    @cached_property
    def ids_of(self) -> set[int]:
        """The tokens that aren't special."""
        return set(self.plain.tolist())

    @cached_property
    def _rank_of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def _sides(self, made: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """What stands at each token's left (part 0) or right (1) edge while it is made: each symbol from
        the single byte on with the rank of the merge that takes it, from the token itself on with NONE."""
        token = np.arange(len(made), dtype=np.int32)
        found, live, at = [], token, token
        while len(live):
            merge = made[at]
            live, merge = live[merge >= 0], merge[merge >= 0]
            at = self.merges[merge, part]
            if len(live):
                found.append((live, at, merge))
        size = np.bincount(np.concatenate([x[0] for x in found] or [token[:0]]), minlength=len(made))
        symbol, taken = np.repeat(token[:, None], len(found) + 1, 1), np.full((len(made), len(found) + 1), NONE, np.int32)
        for k, (live, at, merge) in enumerate(found, 1):
            symbol[live, size[live] - k], taken[live, size[live] - k] = at, merge
        return symbol, taken

    def merged(self, text: bytes) -> list[int]:
        """The encoding by its definition: the pair of lowest rank is merged again and again."""
        byte = {b: i for i, b in self.bytes_of.items() if len(b) == 1 and i in self.ids_of}
        out = [byte[bytes([b])] for b in text]
        while len(out) > 1:
            best = min(((self.rank[p], k) for k, p in enumerate(zip(out, out[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            out[k : k + 2] = [int(self.merges[best[0], 2])]
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses from left to right, so that their joint bytes encode to these two.

        Merges go by rank. Two edge symbols are there together from the later one's making to the
        first one's taking; a merge of both crosses if its rank comes before either is taken. At
        equal ranks the pair further left goes first.
        """
        key = left << 20 | right
        got = self.compatible.get(key)
        if got is None:
            if len(self.compatible) >= KEPT >> 3:
                self.compatible.clear()
            a, a_taken, b, b_taken = (x.tolist() for x in (self.right_symbol[left], self.right_taken[left], self.left_symbol[right], self.left_taken[right]))
            i, j, got, ranks = 0, 0, True, self._rank_of
            while True:
                x_taken, y_taken = a_taken[i], b_taken[j]
                rank = ranks.get(a[i] << 20 | b[j])
                if rank is not None and rank < x_taken and rank <= y_taken:
                    got = False
                    break
                if x_taken > y_taken:
                    j += 1
                elif x_taken < NONE:
                    i += 1
                else:
                    break
            self.compatible[key] = got
        return got

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece."""
        auto = self.automaton
        base, owner, target, fall = auto.base, auto.owner, auto.target, auto.fall
        near, link, tokens, depth = auto.near, auto.link, auto.token, auto.length
        last, size = [0] * (len(text) + 1), [0] * (len(text) + 1)
        at, known, fits = 0, self.compatible, self.fits
        for end, c in enumerate(text, 1):
            while owner[base[at] + c] != at:
                at = fall[at]
            at = target[base[at] + c]
            q = near[at]
            while True:  # a byte is a token, so one fits
                token, before = int(tokens[q]), end - int(depth[q])
                good = not before or known.get(last[before] << 20 | token)
                if good is None:
                    good = fits(last[before], token)
                if good:
                    last[end], size[end] = token, end - before
                    break
                q = link[q]
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def fits_all(self, pairs: np.ndarray) -> np.ndarray:
        """fits() of left << 20 | right, all walked together."""
        right_symbol, right_taken, left_symbol, left_taken, keys, ranks = self.right_symbol, self.right_taken, self.left_symbol, self.left_taken, self.keys, self.ranks
        out = np.ones(len(pairs), bool)
        live = np.arange(len(pairs))
        a, b = pairs >> 20, pairs & 0xFFFFF
        i, j = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        while len(live):
            x, y = right_symbol[a, i], left_symbol[b, j]
            x_taken, y_taken = right_taken[a, i], left_taken[b, j]
            key = x.astype(np.int64) << 20 | y
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            rank = np.where(keys[at] == key, ranks[at], NONE)
            crosses = (rank < x_taken) & (rank <= y_taken) & (rank < NONE)
            out[live[crosses]] = False
            first = x_taken <= y_taken
            i, j = i + first, j + ~first
            go = ~crosses & ~(first & (x_taken == NONE))
            live, a, b, i, j = live[go], a[go], b[go], i[go], j[go]
        return out

    def checked(self, pairs: np.ndarray) -> np.ndarray:
        """fits_all() behind a table of KEPT places, one pair each."""
        place = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        miss = np.flatnonzero(self._pair[place] >> 1 != pairs)
        out = (self._pair[place] & 1).astype(bool)
        if len(miss):
            new, back = np.unique(pairs[miss], return_inverse=True)
            good = self.fits_all(new)
            out[miss] = good[back]
            self._pair[place[miss]] = pairs[miss] << 1 | good[back]
        return out

    def pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, each piece's first and the end) of the pieces data[start : start + size]."""
        auto = self.automaton
        near, link, token, depth = auto.near, auto.link, auto.token, auto.length
        count = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # piece, place from the piece's end, id
        for low, high in ((0, 8), (8, 16), (16, 32), (32, LONG)):
            which = np.flatnonzero((sizes > low) & (sizes <= high))
            which = which[np.argsort(-sizes[which], kind="stable")]
            size, at = sizes[which], starts[which]
            last = np.zeros((len(which), high + 1), np.int32)
            state = np.zeros(len(which), np.int32)
            for end in range(1, high + 1):
                live = int(np.searchsorted(-size, -end, "right"))
                if not live:
                    break
                state[:live] = auto.step(state[:live], data[at[:live] + end - 1])
                todo, q = np.arange(live), near[state[:live]]
                while len(todo):
                    ids, before = token[q], end - depth[q]
                    good = before == 0
                    inner = np.flatnonzero(~good)
                    good[inner] = self.checked(last[todo[inner], before[inner]].astype(np.int64) << 20 | ids[inner])
                    last[todo[good], end] = ids[good]
                    todo, q = todo[~good], link[q[~good]]
            live, end, k = np.arange(len(which)), size.copy(), 0
            while len(live):
                ids = last[live, end[live]]
                found.append((which[live], np.full(len(live), k), ids))
                end[live] -= self.token_size[ids]
                count[which[live]] += 1
                live = live[end[live] > 0]
                k += 1
        for k in np.flatnonzero(sizes > LONG):
            ids = np.array(self.piece(data[starts[k] : starts[k] + sizes[k]].tobytes()), np.int32)[::-1]
            count[k] = len(ids)
            found.append((np.full(len(ids), k), np.arange(len(ids)), ids))
        edge = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(edge[-1], np.uint32)
        for piece, place, ids in found:
            out[edge[piece + 1] - 1 - place] = ids
        return out, edge

    def encode_rows(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each row's first id and the end) of a string column; null is empty."""
        texts = column.to_pylist()
        marked = [k for k, t in enumerate(texts) if t and any(s in t for s in self.special)]
        if marked:  # special tokens cut a text into parts of their own
            parts, owner, ids = [], [], []
            for k, t in enumerate(texts):
                for part in self.specials.split(t or "") if k in set(marked) else (t or "",):
                    ids.append(self.special.get(part, -1))
                    parts.append("" if part in self.special else part)
                    owner.append(k)
            flat, edge = self._encode(*utf8(pa.array(parts, pa.large_string())))
            special = np.array(ids)
            at = edge[:-1][special >= 0]
            flat = np.insert(flat, at, special[special >= 0].astype(np.uint32))
            count = np.diff(edge) + (special >= 0)
            rows = np.bincount(owner, count, len(texts)).astype(np.int64)
            return flat, np.concatenate(([0], np.cumsum(rows)))
        return self._encode(*utf8(column))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, rows = split(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        _, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        size, other = ends - starts, first[back]
        unlike = np.flatnonzero((size != size[other]) | ~same_spans(data, starts, starts[other], np.minimum(size, size[other])))
        if len(unlike):  # pieces of one hash that differ from its first one stand for themselves
            back[unlike] = len(first) + np.arange(len(unlike))
            first = np.concatenate((first, unlike))
        flat, edge = self.pieces(data, starts[first], (ends - starts)[first])
        size = np.diff(edge)
        out, total = _gather(flat, edge[:-1], size, back)
        return out, total[rows]

    def decode_rows(self, ids: np.ndarray, rows: np.ndarray) -> list[str]:
        """The text of each row's ids; bytes that are no UTF-8 become the replacement character."""
        data, edge = _gather(self.token_data, self.token_edge[:-1], self.token_size, ids.astype(np.int64))
        raw, at = data.tobytes(), edge[rows]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs of flat one after another, and where each of them begins (and the end)."""
    size = sizes[which]
    edge = np.concatenate(([0], np.cumsum(size)))
    return flat[np.arange(edge[-1]) + np.repeat(starts[which] - edge[:-1], size)], edge


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One vocabulary a worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def bpe_round_trip(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` the ids and the decoded text.

    ``path`` is the vocabulary file, which every worker has. A null text counts as empty and has no
    ids; special tokens in a text become their ids. Texts are encoded whole however long; repeated
    rows each by themselves; an empty table gives an empty result; only the two named columns are
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                flat, rows = model.encode_rows(part.column(1))
                texts = model.decode_rows(flat, rows)
                ids = [flat[a:b].astype("<u4") for a, b in zip(rows[:-1], rows[1:], strict=True)]
                columns = [part.column(0), pa.array(np.diff(rows), pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>, decoded string" if keep else ""
    return pick(df, id_column, text_column).toDF("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
