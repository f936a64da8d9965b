"""Quality rules as a learned decision list.

Text statistics are worked out once per document. Sequential covering then
learns an ordered list of threshold conjunctions from labelled statistics: a rule
grows by the condition of largest information gain, is pruned on held-back rows,
and the rows it covers leave the training set. The list becomes one Spark
conditional expression.

Null text has no words. Empty tables give empty results; without labels of both
classes the list is empty and only the base rule decides. Repeated rows are
judged each on its own. Columns of the input pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded_sample, carried, mix2, raw_texts

#: labelled rows that a list is fitted on at most
FIT_ROWS = 20_000
#: a rule must be right on this share of the held-back rows it covers
PRECISION = 0.95

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = b" \t\n\r\x0b\x0c"
STATS = T.StructType([
    T.StructField(n, T.LongType())
    for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct", "n_lines")
])
#: what conditions compare: name -> ratio of two statistics, or one of them
FEATURES = {
    "n_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"), "distinct": ("n_distinct", "n_words"),
}


def text_stats(batch) -> dict[str, list]:
    """Statistics of the texts of a slice.

    Words of repeated five-word windows are found for all texts together: window
    hashes are mixed with the number of their text and sorted once.
    """
    out: dict[str, list] = {f.name: [] for f in STATS}
    hashes, lengths = [], []
    for b in raw_texts(batch, "__text"):
        words = b.split()
        lines = [x for x in b.split(b"\n") if x.strip()]
        continuation = len(b) - len(b.decode("utf-8", "replace")) if not b.isascii() else 0
        out["n_words"].append(len(words))
        out["word_chars"].append(len(b) - continuation - (len(b) - len(b.translate(None, BLANK))))
        out["n_symbols"].append(len(b) - len(b.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_upper"].append(len(b) - len(b.translate(None, UPPER)))
        out["n_distinct"].append(len(set(words)))
        out["n_lines"].append(len(lines))
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        lengths.append(len(words))
    out["n_repeat_words"] = repeated_words(hashes, np.array(lengths, np.int64)).tolist()
    return out


def repeated_words(hashes: list[np.ndarray], lengths: np.ndarray, width: int = 5) -> np.ndarray:
    """Words per text that lie in a window found twice or more in that text."""
    total = int(lengths.sum())
    if total < width:
        return np.zeros(len(lengths), np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    h = np.concatenate(hashes).view(np.uint64)
    n = total - width + 1
    code = h[:n]
    for k in range(1, width):
        code = mix2(code, h[k : k + n], k)
    inside = text[:n] == text[width - 1 :]
    code = mix2(code, text[:n].astype(np.uint64))[inside]
    starts = np.flatnonzero(inside)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    again = np.zeros(len(code), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(total + 1, np.int64)
    at = starts[again]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.bincount(text, weights=np.cumsum(edge[:-1]) > 0, minlength=len(lengths)).astype(np.int64)


def with_stats(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of the input) and ``out`` (the statistics)."""
    return carried(docs, text, STATS, text_stats, columns=columns)


def base_failed(stats: str = "out") -> Column:
    c = lambda n: F.col(f"{stats}.{n}")
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


# ---- learning -----------------------------------------------------------------
@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v >= self.limit if self.above else v <= self.limit

    def column(self, stats: str) -> Column:
        top, bottom = FEATURES[self.feature]
        v = F.col(f"{stats}.{top}").cast("double")
        if bottom:
            d = F.col(f"{stats}.{bottom}")
            v = F.when(d > 0, v / d).otherwise(F.lit(0.0))
        return v >= F.lit(self.limit) if self.above else v <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.limit:.4g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def feature_matrix(stats: np.ndarray) -> np.ndarray:
    """Ratios in the order of ``FEATURES`` from statistics in the order of ``STATS``."""
    names = [f.name for f in STATS]
    s = {n: stats[:, i].astype(float) for i, n in enumerate(names)}
    out = [s[a] if b is None else np.divide(s[a], s[b], out=np.zeros(len(stats)), where=s[b] > 0) for a, b in FEATURES.values()]
    return np.stack(out, axis=1) if len(stats) else np.zeros((0, len(FEATURES)))


def grow(x: np.ndarray, bad: np.ndarray, most: int = 4) -> Rule:
    """Adds the condition of largest information gain until no good row is covered."""
    rule: Rule = ()
    hit = np.ones(len(x), bool)
    while len(rule) < most and (hit & ~bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        best: tuple[float, Condition] | None = None
        for j, name in enumerate(FEATURES):
            v = x[hit, j]
            cuts = np.unique(np.quantile(v[bad[hit]], np.linspace(0, 1, 41), method="nearest"))
            for cut in cuts:
                for above in (True, False):
                    inside = v >= cut if above else v <= cut
                    p, n = (inside & bad[hit]).sum(), (inside & ~bad[hit]).sum()
                    if not p or p + n == len(v):
                        continue
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, float(cut)))
        if best is None or best[0] <= 0:
            break
        rule += (best[1],)
        hit &= best[1].holds(x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops last conditions as long as held-back rows are told apart no worse."""

    def worth(r: Rule) -> float:
        hit = covers(r, x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn_list(stats: np.ndarray, bad: np.ndarray, held_back: np.ndarray, most: int = 16, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules that reject; what none covers is kept."""
    x = feature_matrix(stats)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most:
        g, h = left & ~held_back, left & held_back
        if (g & bad).sum() < 5 or not (g & ~bad).any():
            break
        rule = prune(grow(x[g], bad[g]), x[h], bad[h])
        if not rule:
            break
        hit = covers(rule, x) & left
        seen = hit & held_back
        right = (seen & bad).sum() / seen.sum() if seen.any() else 0.0
        if right < precision or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = FIT_ROWS) -> list[Rule]:
    """List fitted on at most ``most`` labelled rows that the base rule lets through.

    ``stats`` has ``row.<key>`` and ``out``; the labels are sampled before the join,
    so that at most ``most`` keys meet the statistics.
    """
    chosen = bounded_sample(labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()), key, most)
    chosen = chosen.select(F.col(key).alias("__key"), (F.col(label) == 0).alias("__bad"))
    rows = (
        stats.join(F.broadcast(chosen), F.col(f"row.{key}") == F.col("__key"))
        .filter(~base_failed())
        .select("__bad", F.pmod(F.xxhash64("__key"), F.lit(3)).alias("__fold"), "out.*", F.xxhash64("__key", "out").alias("__hash"))
        .orderBy("__hash", "__bad")
        .limit(most)  # ids may repeat
        .drop("__hash")
        .toPandas()
    )
    if not len(rows):
        return []
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    return learn_list(rows[[f.name for f in STATS]].to_numpy(), rows["__bad"].to_numpy(bool), rows["__fold"].to_numpy() == 0)


def verdict(rules: list[Rule], stats: str = "out") -> Column:
    """True where no rule of the list rejects: an ordered conditional expression."""
    if not rules:
        return F.lit(True)
    expr = None
    for rule in rules:
        test = None
        for c in rule:
            test = c.column(stats) if test is None else test & c.column(stats)
        expr = F.when(test, F.lit(False)) if expr is None else expr.when(test, F.lit(False))
    return expr.otherwise(F.lit(True))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that the base rule and the learned list keep, with their own columns.

    The list is fitted on labelled documents only; then one pass judges all.
    """
    chosen = bounded_sample(labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()), key, FIT_ROWS)
    some = docs.join(F.broadcast(chosen.select(F.col(key).alias("__key")).distinct()), docs[key] == F.col("__key"), "left_semi")
    rules = fit(with_stats(some, text, [key]), labels, key)
    judged = with_stats(docs, text)
    return judged.filter(~base_failed() & verdict(rules)).select("row.*")
