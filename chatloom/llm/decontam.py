"""Benchmark decontamination with a generalised suffix automaton.

Test items become word numbers; one automaton accepts every substring of every
item. Training words stream through it and the length of the longest match that
ends at each word is tracked. A match of ten words (or a whole shorter item) is
an occurrence; all its words are hit.

The automaton is sent to every task. Its size follows the benchmark, not the
corpus: items are taken in blocks of at most ``BLOCK_WORDS`` words, one automaton
at a time, and the hits of the blocks are united.

Null text has no words. Null items and items without words match nothing; items
with a null id are matched but have no name to report. Repeated rows are judged
each on its own. Empty tables give empty or untouched results.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import carried, raw_texts

#: words of an occurrence
WINDOW = 10
#: words of test items in one automaton
BLOCK_WORDS = 2_000_000
#: a document with a larger share of hit words goes as a whole
MAX_COVERAGE = 0.5

#: A-Z to a-z; every other ASCII character but digits and letters to a space
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def normal_words(b: bytes) -> list[bytes]:
    return b.translate(NORMAL).split()


class Automaton:
    """All substrings of a set of word sequences."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        coded = [(i, [self.number.setdefault(w, len(self.number)) for w in words]) for i, words in items if words]
        self.shortest = min([window, *(len(c) for _, c in coded)])
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: state whose strings hold one of ``window`` words -> items with that string
        self.full: dict[int, set[int]] = {}
        #: state -> (length, items) of whole shorter items among its strings
        self.short: dict[int, dict[int, set[int]]] = {}
        for i, codes in coded:
            at, size = 0, min(window, len(codes))
            for k, c in enumerate(codes):
                at = self.step[at][c]
                if k + 1 < size:
                    continue
                state = self._holding(at, size)
                found = self.full.setdefault(state, set()) if size == window else self.short.setdefault(state, {}).setdefault(size, set())
                if i is not None:
                    found.add(i)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, c: int) -> int:
        """State of the strings of ``p`` followed by ``c``, made its own if longer ones share it."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:  # an earlier item holds this prefix
            return self._split(last, c)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c)
        return state

    def _holding(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Mask of hit words, and the items that occur.

        Only runs of known words as long as the shortest occurrence are streamed.
        """
        hit = np.zeros(len(words), bool)
        items: set[int] = set()
        if not self.number or len(words) < self.shortest:
            return hit, items
        get = self.number.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0]))))
        for a, b in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1).ravel() >= self.shortest].tolist():
            self._stream(codes[a:b].tolist(), a, hit, items)
        return hit, items

    def _stream(self, codes: list[int], at: int, hit: np.ndarray, items: set[int]) -> None:
        step, link, length = self.step, self.link, self.length
        state = matched = 0
        for k, c in enumerate(codes, at + 1):
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            if c in step[state]:
                state = step[state][c]
                matched += 1
            if matched >= self.window:
                items |= self.full[self._holding(state, self.window)]
                hit[k - self.window : k] = True
            if self.short:
                s = state
                while s > 0:
                    for size, found in self.short.get(s, {}).items():
                        if size <= matched:
                            items |= found
                            hit[k - size : k] = True
                    s = link[s]


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", most: int = BLOCK_WORDS) -> list[list[tuple]]:
    """Items as words in blocks of a bounded number of words."""
    blocks: list[list[tuple]] = [[]]
    size = 0
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").distinct().orderBy("k", "t").toLocalIterator():
        words = normal_words(row.t.encode())
        if size + len(words) > most and blocks[-1]:
            blocks.append([])
            size = 0
        size += len(words)
        blocks[-1].append((row.k, words))
    return blocks


class Scanner:
    """Words, hits, spans and items of the texts of a slice, block after block of the items."""

    def __init__(self, docs: DataFrame, items: DataFrame):
        self.sent = [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(items)]

    def __call__(self, raw: list[bytes]) -> dict:
        words = [normal_words(b) for b in raw]
        hits = [np.zeros(len(w), bool) for w in words]
        found: list[set[int]] = [set() for _ in words]
        for k, block in enumerate(self.sent):
            machine = _automaton(block, k)
            for i, w in enumerate(words):
                hit, got = machine.scan(w)
                hits[i] |= hit
                found[i] |= got
        spans = [np.flatnonzero(np.diff(np.concatenate(([0], h, [0])))).reshape(-1, 2).tolist() for h in hits]
        return {
            "n_words": [len(w) for w in words], "n_hit": [int(h.sum()) for h in hits],
            "spans": [[{"start": a, "end": b} for a, b in s] for s in spans], "items": [sorted(f) for f in found],
        }


def scanned(docs: DataFrame, items: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row`` and ``out``: words, hit words, spans of hit words (word numbers, end exclusive), items."""
    scan = Scanner(docs, items)
    return carried(docs, text, HITS, lambda batch: scan(raw_texts(batch, "__text")), columns=columns)


_built: dict[str, object] = {}


def _automaton(block, k: int) -> Automaton:
    """The automaton of a block; a worker keeps one at a time."""
    if _built.get("of") is not block.value:
        _built.update(of=block.value, machine=Automaton(block.value))
    return _built["machine"]


def cut_words(b: bytes, spans: list[dict]) -> bytes:
    """Text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(b.translate(NORMAL))]
    out, at = [], 0
    for s in spans:
        out.append(b[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return b"".join([*out, b[at:]])


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE, count: str = "n_chars"
) -> DataFrame:
    """Documents without hit spans; those hit beyond ``max_coverage`` of their words go.

    ``count`` names a column of text lengths to bring up to date, if there is one.
    """
    scan = Scanner(docs, items)
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("cut", T.StringType())])

    def cut(batch):
        raw = raw_texts(batch, "__text")
        told = scan(raw)
        new = [cut_words(b, s).decode() if s else None for b, s in zip(raw, told["spans"], strict=True)]
        return {"n_words": told["n_words"], "n_hit": told["n_hit"], "cut": new}

    found = carried(docs, text, added, cut).filter(F.col("out.n_hit") <= F.lit(max_coverage) * F.col("out.n_words"))
    hit = F.col("out.cut").isNotNull()
    changed = {text: F.coalesce("out.cut", f"row.`{text}`")}
    if count in docs.columns:
        changed[count] = F.when(hit, F.length("out.cut").cast(docs.schema[count].dataType)).otherwise(F.col(f"row.`{count}`"))
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
