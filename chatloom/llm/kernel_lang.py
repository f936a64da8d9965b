"""Language identification with a string kernel.

A text is the set of its byte n-grams of one to three bytes (lower case, hashed to
``DIM`` slots). The presence kernel of two texts is the share of common n-grams,
|A & B| / sqrt(|A| |B|). Landmark texts give the Nystroem map; ridge regression in
its space, one against the rest for each language, gives the weights. As the
kernel is linear in the presence vector, landmarks, map and weights fold into one
matrix, and a batch of texts is scored by one matrix product.

The regression is fitted on at most ``FIT`` texts of each language. Null text and
text without a letter is ``und`` with score 0, as is everything when there is
nothing to learn from. Repeated rows are judged each on its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import carried, slices, texts

DIM = 1 << 14
#: labelled texts of a language that the regression is fitted on at most
FIT = 400
#: of them landmarks
LANDMARKS = 48
RIDGE = 1e-3
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_SHIFT = np.uint32(32 - 14)
_MUL = np.uint32(2654435761)


def presence(batch: list[str | None]) -> np.ndarray:
    """Rows of 0/1: which hashed n-grams a text holds."""
    out = np.zeros((len(batch), DIM), np.uint8)
    step = 1 << 20
    for row, t in zip(out, batch, strict=True):
        raw = np.frombuffer((t or "").lower().encode(), np.uint8)
        for a in range(0, len(raw), step):  # long texts in parts that overlap by two bytes
            b = raw[a : a + step + 2].astype(np.uint32)
            row[((b | np.uint32(1 << 25)) * _MUL) >> _SHIFT] = 1
            two = (b[:-1] << np.uint32(8)) | b[1:]
            row[((two | np.uint32(1 << 24)) * _MUL) >> _SHIFT] = 1
            row[(((two[:-1] << np.uint32(8)) | b[2:]) * _MUL) >> _SHIFT] = 1
    return out


def fit_weights(rows: np.ndarray, langs: list[str], names: list[str], landmarks: np.ndarray) -> np.ndarray:
    """``DIM`` x languages: presence / sqrt(n-grams) times this is the score of each language."""
    x = rows.astype(np.float64)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    marks = x[landmarks]
    value, vector = np.linalg.eigh(marks @ marks.T)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    feature = (x @ marks.T) @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    inner = feature.T @ feature + RIDGE * len(x) * np.eye(feature.shape[1])
    beta = np.linalg.solve(inner, feature.T @ target)
    return (marks.T @ (root @ beta)).astype(np.float32)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = FIT) -> tuple[list[str], np.ndarray] | None:
    """Languages and weights, learned from labelled rows that are not held out.

    Rows are chosen per language by the hash of their id; the count of each
    language sets how small the hash must be, so few texts are read.
    """
    usable = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("__text"), F.col(lang).alias("lang")
    )
    labelled = docs.filter(~held_out(key) & F.col(lang).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("lang")).count().select("lang", F.least(F.lit(1.0), F.lit(3.0 * most) / F.col("count")).alias("share"))
    place = F.xxhash64(F.lit(9), F.col("key"))
    some = usable.join(F.broadcast(counts), "lang").filter(F.pmod(place, F.lit(1 << 30)) <= F.col("share") * F.lit(float(1 << 30)))
    rank = Window.partitionBy("lang").orderBy(place, F.xxhash64("__text"))
    chosen = some.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most).select("__text", "lang", "rank")

    def bits(batches):
        for batch in slices(batches, "__text"):
            rows = np.packbits(presence(texts(batch, "__text")), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1), batch.column(2)], ["bits", "lang", "rank"])

    rows = chosen.mapInArrow(bits, "bits binary, lang string, rank int").toPandas().sort_values(["lang", "rank"])
    if not len(rows):
        return None
    x = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in rows["bits"]]), axis=1)
    names = sorted(set(rows["lang"]))
    return names, fit_weights(x, rows["lang"].tolist(), names, np.flatnonzero(rows["rank"].to_numpy() <= LANDMARKS))


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row`` and ``out`` (``lang_pred``, ``score`` from 0 to 1) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        batch_texts = texts(batch, "__text")
        if sent.value is None:
            return {"lang_pred": [UNKNOWN] * len(batch_texts), "score": [0.0] * len(batch_texts)}
        names, weights = sent.value
        langs, scores = [], []
        for a in range(0, len(batch_texts), 256):
            part = batch_texts[a : a + 256]
            x = presence(part)
            size = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))
            s = (x.astype(np.float32) @ weights) / size[:, None]
            best = s.argmax(axis=1)
            for t, k, row in zip(part, best, s, strict=True):
                known = t is not None and _LETTER.search(t) is not None
                langs.append(names[k] if known else UNKNOWN)
                scores.append(float(np.clip((row[k] + 1) / 2, 0, 1)) if known else 0.0)
        return {"lang_pred": langs, "score": scores}

    return carried(docs, text, PREDICTED, run, columns=columns)
