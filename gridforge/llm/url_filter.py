"""URL filters: all glob rules at once by a bit-parallel wildcard automaton (Shift-And in 64-bit words).

A rule (host, path) is a glob: ``*`` stands for any run of characters and ``?`` for one, in the host
never beyond it. It becomes the pattern ``*.host END path*`` over the canonical url ``.host END path``,
where END is a byte that no text has. Every pattern's places are bits of a row of words; one step
reads one byte of every url of a batch: ``D = ((D << 1 | first) & mask[byte]) | (D & loop[byte])``,
where a place loops on the bytes that a star behind it takes. Nothing is kept but D and the patterns
that have matched, so memory is rules x urls of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import pick
from ._text import utf8


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The byte between host and path; UTF-8 never has it.
END = 0xFF
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    plain = F.regexp_extract(after, "^[^?#]*", 0)
    host = F.substring_index(plain, "/", 1)
    return F.translate(host, UPPER, LOWER), plain.substr(F.length(host) + 1, F.length(plain))


def places(rule: Rule) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bytes that lead to it, bytes that stay) of each place of a rule's pattern, the first one to start in."""
    none, host = np.zeros(256, bool), np.ones(256, bool)
    host[END] = False
    more = np.zeros(256, bool)
    more[0x80:0xC0] = True  # the bytes of a character after its first
    out = [(none, host.copy())]
    for text, every in ((f".{rule.host}", host), (None, None), (rule.path, host)):
        if text is None:
            out.append((np.arange(256) == END, none.copy()))
            continue
        for c in text:
            if c == "*":
                out[-1] = (out[-1][0], out[-1][1] | every)
            elif c == "?":
                out.append((every & ~more, more.copy()))
            else:
                out += [(np.arange(256) == b, none.copy()) for b in c.encode()]
    return out


class Automaton:
    """Patterns packed into words of 64 bits, in sequence; a pattern may cross words."""

    def __init__(self, rules: list[Rule]):
        self.rules = list(rules)
        patterns = [places(r) for r in rules]
        self.words = max(1, -(-sum(map(len, patterns)) // 64))
        self.bits = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for pattern in patterns:
            word, bit = divmod(at, 64)
            self.first[word] |= np.uint64(1 << bit)
            for k, (lead, stay) in enumerate(pattern):
                word, bit = divmod(at + k, 64)
                self.bits[lead, word] |= np.uint64(1 << bit)
                self.loop[stay, word] |= np.uint64(1 << bit)
            self.final.append((word, np.uint64(1 << bit)))
            at += len(pattern)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bool [texts, rules]: which patterns fit each text."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        live = len(order)
        state = np.tile(self.first, (live, 1))
        seen = np.zeros((live, self.words), np.uint64)
        start, length = offsets[:-1][order], size[order]
        for k in range(int(length[0]) if live else 0):
            live = int(np.searchsorted(-length, -k))  # texts longer than k come first
            c = data[start[:live] + k]
            d = state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = d = (moved & self.bits[c]) | (d & self.loop[c])
            seen[:live] |= d
        out = np.empty((len(order), len(self.rules)), bool)
        for r, (word, bit) in enumerate(self.final):
            out[order, r] = (seen[:, word] & bit) != 0
        return out


def url_filter(df: DataFrame, rules: list[Rule], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Host, path, the longest fitting rule and the verdict of every url.

    Null urls and urls without ``://`` have an empty host and path and no rule; they and all urls
    that no rule fits get ``default``. Of fitting rules the longest (host and path in characters)
    wins, of equally long ones the one that stands first. Repeated rows are judged each by itself,
    null page_ids stay, an empty table gives an empty result, and columns but the two named are not
    read. Host and path are cut by Spark; only the automaton runs on Arrow batches.
    """
    patterns = Automaton(rules)
    rank = np.array([len(r.text) for r in rules], np.int64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict, text = [default] * batch.num_rows, [None] * batch.num_rows
            if rules and batch.num_rows:
                host, path = (batch.column(k).cast(pa.binary()) for k in (1, 2))
                fits = patterns.matches(*utf8(pc.binary_join_element_wise(pa.scalar(b"."), host, pa.scalar(bytes([END])), path, pa.scalar(b""))))
                best = np.where(fits, rank, -1).argmax(1)
                for k in np.flatnonzero(fits.any(1)):
                    verdict[k], text[k] = rules[best[k]].verdict, rules[best[k]].text
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = split_url(F.col("url"))
    cut = pick(df, id_column, url_column).toDF("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    return cut.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
