"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: a logistic model reads the words of
a text, some of its statistics and the log-odds that the models before it gave.
While a chain is trained those come from models that did not see the row
(out-of-fold), so a later model meets the same kind of errors as in use.

Words are ranked by their information in the sample; how many of them a model reads
(``WORDS``, eight times that, and so on up to all) is chosen by the loss on rows it did
not see. Rows are sparse lists of words, so width costs little. The sample is at most
``FIT_ROWS`` labelled rows. Null text has no words. Without
labels of both kinds a category has probability 0. Repeated rows are judged each
on its own; empty input gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_sample, carried, raw_texts, slices

#: labelled rows that a chain is fitted on at most
FIT_ROWS = 12_000
#: words of the narrowest model that is tried
WORDS = 600
FOLDS = 4
#: a text is of a category from this probability on: clean texts of the sample stay far below
THRESHOLD = 0.25
_SEEN = 3
_EDGE = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))
_SYMBOL = re.compile(rb"[#*$%&|<>]")


def word_codes(b: bytes) -> np.ndarray:
    """Distinct hashed words (lower case, letters and digits)."""
    text = b.decode("utf-8", "replace").lower().encode().translate(_EDGE)
    return np.fromiter((zlib.crc32(w) for w in set(text.split())), np.int64)


def text_facts(b: bytes) -> list[float]:
    n = max(1, len(b.split()))
    return [np.log1p(n) / 5, min(4.0, len(_SYMBOL.findall(b)) / n), b.count(b"!") / n]


def logistic(row: np.ndarray, col: np.ndarray, width: int, rest: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic model by Newton steps.

    ``row, col`` are the ones of ``width`` sparse columns, ``rest`` holds the others;
    each step is solved by conjugate gradients. ``start``: weights of fewer sparse columns.
    """
    rest = np.hstack([rest, np.ones((len(y), 1))])
    keep = np.full(width + rest.shape[1], ridge)
    keep[-1] = 1e-3

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[col], len(y)) + rest @ w[width:]

    def back(v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(col, v[row], width), rest.T @ v])

    w = np.zeros(len(keep))
    if start is not None:
        n = len(start) - rest.shape[1]
        w[:n], w[width:] = start[:n], start[n:]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        left = -(back(p - y) + keep * w)
        h = p * (1 - p)
        scale = np.concatenate([np.bincount(col, h[row], width), (rest**2).T @ h]) + keep
        step, z = np.zeros(len(w)), left / scale
        way, size, goal = z, left @ z, 1e-4 * (left @ z)
        for _ in range(40):
            if size <= max(goal, 1e-12):
                break
            turned = back(h * times(way)) + keep * way
            far = size / (way @ turned)
            step, left = step + far * way, left - far * turned
            z = left / scale
            size, before = left @ z, size
            way = z + size / before * way
        w += step
        if np.abs(step).max() < 1e-2:
            break
    return w


@dataclass(frozen=True)
class Link:
    """One category's model: its words and the weights of words, facts, earlier log-odds and bias."""

    name: str
    words: np.ndarray
    weights: np.ndarray

    def log_odds(self, codes: list[np.ndarray], facts: np.ndarray, before: np.ndarray) -> np.ndarray:
        row, col = places(codes, self.words)
        n = len(self.words)
        return np.bincount(row, self.weights[col], len(codes)) + np.hstack([facts, before, np.ones((len(facts), 1))]) @ self.weights[n:]


def ranked_words(place: np.ndarray, label: np.ndarray, n_words: int, n: int, n_pos: float) -> np.ndarray:
    """Words by how much their presence tells (difference of rates over its spread), best first."""
    pos = np.bincount(place, weights=label, minlength=n_words)
    every = np.bincount(place, minlength=n_words)
    rate = (pos + 1) / (n_pos + 2) - (every - pos + 1) / (n - n_pos + 2)
    spread = np.sqrt((every + 1) / n)
    worth = np.where(every >= _SEEN, np.abs(rate) / spread, -1)
    best = np.argsort(-worth, kind="stable")
    return best[worth[best] > 0]


def places(codes: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and word (of the sorted ``words``) wherever a text has one of them."""
    flat = np.concatenate(codes) if codes and len(words) else np.zeros(0, np.int64)
    if not len(flat):
        return flat.astype(np.int64), flat.astype(np.int64)
    at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
    hit = words[at] == flat
    return np.repeat(np.arange(len(codes)), [len(c) for c in codes])[hit], at[hit]


def train_chain(codes: list[np.ndarray], facts: np.ndarray, labels: dict[str, np.ndarray], fold: np.ndarray) -> list[Link]:
    """Models of the categories in the order of ``labels``."""
    chain: list[Link] = []
    word, place = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    before = np.zeros((len(codes), 0))
    for name, y in labels.items():
        y = y.astype(float)
        if not 0 < y.sum() < len(y):
            chain.append(Link(name, np.zeros(0, np.int64), np.array([*np.zeros(facts.shape[1] + before.shape[1]), -30.0])))
            before = np.hstack([before, np.full((len(y), 1), -30.0)])
            continue
        def ranks(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            here = seen[row]
            order = ranked_words(place[here], y[row[here]], len(word), int(seen.sum()), y[seen].sum())
            at = np.full(len(word), len(word), np.int32)
            at[order] = np.arange(len(order))
            return order, at[place]

        rest = np.hstack([facts, before])
        ranked = [ranks(fold != f) for f in range(FOLDS)]
        order, rank = ranks(np.ones(len(y), bool))
        best: tuple[float, int, np.ndarray] | None = None
        width = WORDS
        starts: list[np.ndarray | None] = [None] * FOLDS
        while True:
            out = np.zeros(len(y))
            for f, (known, at) in enumerate(ranked):
                n = min(width, len(known))
                seen = fold != f
                number = np.cumsum(seen) - 1
                some = (at < n) & seen[row]
                w = starts[f] = logistic(number[row[some]], at[some].astype(np.int64), n, rest[seen], y[seen], starts[f])
                some = (at < n) & ~seen[row]
                odds = np.bincount(row[some], w[at[some]], len(y)) + rest @ w[n:-1] + w[-1]
                out[~seen] = odds[~seen]
            loss = np.logaddexp(0, np.where(y > 0, -out, out)).mean()
            if best is None or loss < best[0]:
                best = (loss, width, out)
            if width >= len(order):
                break
            width *= 8
        n = min(best[1], len(order))
        some = rank < n
        w = logistic(row[some], rank[some].astype(np.int64), n, rest, y)
        by = np.argsort(word[order[:n]])
        chain.append(Link(name, word[order[:n]][by], np.concatenate([w[:n][by], w[n:]])))
        before = np.hstack([before, best[2][:, None]])
    return chain


def run_chain(chain: list[Link], texts: list[bytes]) -> np.ndarray:
    """Probabilities, one column a category."""
    codes = [word_codes(b) for b in texts]
    facts = np.array([text_facts(b) for b in texts]).reshape(len(texts), -1)
    before = np.zeros((len(texts), 0))
    for link in chain:
        before = np.hstack([before, link.log_odds(codes, facts, before)[:, None]])
    return 1 / (1 + np.exp(-np.clip(before, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], key: str = "doc_id", text: str = "text", most: int = FIT_ROWS) -> list[Link]:
    """Chain for ``categories`` (name -> SQL condition on a row of ``labels``), in their order."""
    known = labels.filter(F.col(key).isNotNull())
    flags = [F.coalesce(F.expr(c), F.lit(False)).alias(f"__is_{n}") for n, c in categories.items()]
    chosen = bounded_sample(known, key, most).select(F.col(key).alias("__key"), *flags)
    names = [f"__is_{n}" for n in categories]
    rows = docs.join(F.broadcast(chosen), docs[key] == F.col("__key")).select(docs[text].alias("__text"), "__key", *names)

    def read(batches):
        for batch in slices(batches, "__text"):
            raw = raw_texts(batch, "__text")
            codes = pa.array([word_codes(b).tolist() for b in raw], pa.list_(pa.int64()))
            facts = pa.array([text_facts(b) for b in raw], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([codes, facts, *batch.columns[1:]], ["codes", "facts", "key", *names])

    found = rows.mapInArrow(read, "codes array<long>, facts array<double>, key long, " + ", ".join(f"`{n}` boolean" for n in names))
    # one row an id and label: repeated ids bring no more rows than labels were chosen
    found = found.groupBy("key", *names).agg(F.min_by(F.struct("codes", "facts"), F.xxhash64("codes", "facts")).alias("one"))
    got = found.select("one.*", "key", *names).toArrow().sort_by([("key", "ascending")])
    if not got.num_rows:
        return [Link(n, np.zeros(0, np.int64), np.array([*np.zeros(3 + k), -30.0])) for k, n in enumerate(categories)]
    # numpy views of the list column: no Python object per word
    col = got["codes"].combine_chunks()
    ends = col.offsets.to_numpy()
    codes = np.split(col.flatten().to_numpy(), (ends[1:-1] - ends[0]))
    facts = np.array(got["facts"].to_pylist())
    fold = np.array([zlib.crc32(str(k).encode()) % FOLDS for k in got["key"].to_pylist()])
    return train_chain(codes, facts, {n: got[f"__is_{n}"].to_numpy(zero_copy_only=False).astype(bool) for n in categories}, fold)


def predict(docs: DataFrame, chain: list[Link], text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row`` and ``out`` with the probability of each category as ``p_<name>``."""
    added = T.StructType([T.StructField(f"p_{link.name}", T.DoubleType()) for link in chain])
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batch):
        raw = raw_texts(batch, "__text")
        p = np.vstack([run_chain(sent.value, raw[a : a + 256]) for a in range(0, len(raw), 256)])
        return {f.name: p[:, k] for k, f in enumerate(added)}

    return carried(docs, text, added, run, columns=columns)
