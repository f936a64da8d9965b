"""Best-fit packing of token sequences by minimum bin slack.

Only lengths matter for the choice, and there are at most ``CAPACITY`` different
ones. So the count of pieces per length (at most 4096 rows) is what the choice
works on: the longest open length seeds a bin, a subset-sum over the open lengths
kept as one bitset finds the fullest combination that fits beside it, and this
combination fills as many bins at once as the counts allow. A piece finds its
place by its rank among the pieces of its length; the ranks come from counts per
(length, slice of the key), so no task holds one length.

Null text is empty. Every document ends with the end id, so empty ones are packed
too. Rows with a null key or equal keys are documents each. An empty table packs
nothing. Other columns of the input are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import SLICE_BYTES, give_back, slices, stage, texts
from .tokens import REMEMBERED, encoder

CAPACITY = 4096
END = 1
#: keys of about this many pieces are ranked together
RANKED = 65_536


# ---- pieces -------------------------------------------------------------------
def token_pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
    release: bool = False, remembered: int = REMEMBERED,
) -> DataFrame:
    """``key, piece, start, length, ids`` (little-endian unsigned 32-bit) of every document.

    Documents of up to ``capacity`` ids are one piece; longer ones are cut every
    ``capacity`` ids. ``release`` takes texts in smaller slices and frees a worker's
    remembered pieces after each task, and ``remembered`` bounds their number: less
    memory, more tokenizing.
    """
    source = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))
    tail = np.array([end], "<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        enc = encoder(tokenizer, remembered)
        for batch in slices(batches, "__text", SLICE_BYTES // 4 if release else SLICE_BYTES):
            keys, piece, start, length, ids = [], [], [], [], []
            for k, coded in zip(batch.column(0).to_pylist(), enc.encode(texts(batch, "__text")), strict=True):
                coded += tail
                for n, at in enumerate(range(0, len(coded), width)):
                    part = coded[at : at + width]
                    keys.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["key", "piece", "start", "length", "ids"],
            )
            if release:
                del keys, piece, start, length, ids
                give_back()
        if release:
            enc.forget()
        give_back()

    schema = T.StructType([
        T.StructField("key", source.schema["__key"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    return source.mapInArrow(run, schema)


# ---- which lengths share a bin ------------------------------------------------
@dataclass(frozen=True)
class Fill:
    """``bins`` bins filled alike with ``use[length]`` pieces of each length."""

    use: dict[int, int]
    bins: int


def fullest(room: int, open_counts: dict[int, int], order: list[int]) -> dict[int, int]:
    """Lengths whose sum is the largest possible up to ``room``, each within its count.

    Bit s of ``reach`` says that sum s can be made. Lengths join from long to
    short, with power-of-two multiples for their counts; the first bitset that
    reaches the best sum is traced back.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in order:
        if length > room or not open_counts[length]:
            continue
        most = min(open_counts[length], room // length)
        k = 1
        while most:
            k = min(k, most)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            most -= k
            k *= 2
        if reach >> room:
            break
    at = reach.bit_length() - 1
    use: dict[int, int] = {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            use[length] = use.get(length, 0) + k
    return use


def fill_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Fill]:
    """Minimum bin slack over a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    fills: list[Fill] = []
    for seed in order:
        while left[seed]:
            left[seed] -= 1
            use = fullest(capacity - seed, left, order)
            left[seed] += 1
            use[seed] = use.get(seed, 0) + 1
            bins = min(left[n] // k for n, k in use.items())
            for n, k in use.items():
                left[n] -= k * bins
            fills.append(Fill(use, bins))
    return fills


class Places:
    """Bin and offset of the r-th piece of a length."""

    def __init__(self, fills: list[Fill]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for f in fills:
            offset = 0
            for n in sorted(f.use, reverse=True):
                k = f.use[n]
                rows.setdefault(n, []).append((taken.get(n, 0), k, first, offset))
                taken[n] = taken.get(n, 0) + k * f.bins
                offset += n * k
            first += f.bins
        self.rows = {n: np.array(r, np.int64) for n, r in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            table = self.rows[n]
            row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
            nth = rank[at] - row[:, 0]
            sequence[at] = row[:, 2] + nth // row[:, 1]
            offset[at] = row[:, 3] + nth % row[:, 1] * n
        return sequence, offset


# ---- where each piece goes ----------------------------------------------------
def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with ``key, piece, length``) with ``sequence_id`` and ``offset``."""
    spread = F.xxhash64("key", "piece")
    total = pieces.count()
    shares = max(1, -(-total // RANKED))
    dealt = pieces.withColumn("__share", F.pmod(spread, F.lit(shares)))
    counts = dealt.groupBy("length", "__share").agg(F.count(F.lit(1)).alias("__n"))
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__share", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__share").orderBy(*[F.col(c) for c in ("key", "piece") if c in pieces.columns])
    ranked = dealt.join(offsets, ["length", "__share"]).withColumn("__rank", F.row_number().over(inside) - 1 + F.col("__before"))
    sent = pieces.sparkSession.sparkContext.broadcast(Places(fill_bins(lengths, capacity)))
    names = pieces.columns
    source = ranked.select(*names, F.col("__rank").cast("long"))

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = sent.value.of(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return source.mapInArrow(run, schema)


def placed_digests(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", release: bool = False, remembered: int = REMEMBERED,
) -> DataFrame:
    """Pieces with their place and the checksum of their ids."""
    digests = token_pieces(docs, tokenizer, key, text, release=release, remembered=remembered).select("key", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(stage(digests, "pieces")).withColumnRenamed("key", key)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids, parts`` of placed pieces that carry ``ids``.

    A sequence holds at most ``capacity`` ids, so its group is bounded.
    """
    part = F.struct("offset", "key", "piece", "start", "length", "ids")
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("__parts"))
    ids = F.aggregate("__parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    parts = F.transform("__parts", lambda p: F.struct(p["key"], p["piece"], p["start"], p["length"], p["offset"]))
    return rows.select("sequence_id", ids.alias("ids"), parts.alias("parts"))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed sequences with their token ids."""
    return sequences(place(stage(token_pieces(docs, tokenizer, key, text), "pieces")))
