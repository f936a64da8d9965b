"""Building blocks that keep every task bounded.

One chat may hold a third of all rows. A plain window over the chat would sort
all of them in one task, so running positions, running sums and look-backs are
computed in two levels: inside (chat, bucket), then over one row per bucket.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 65_536
_B, _OFF = "__bucket", "__offset"


@dataclass(frozen=True)
class Sequence:
    """How rows of one key are ordered, and a bucket that grows with that order."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    bucket: Column

    def window(self, descending: bool = False):
        cols = [F.col(o).desc() if descending else F.col(o).asc() for o in self.order]
        return Window.partitionBy(*self.keys, _B).orderBy(*cols)

    def buckets_before(self, descending: bool = False):
        b = F.col(_B).desc() if descending else F.col(_B).asc()
        return (
            Window.partitionBy(*self.keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        )


def message_order(key: str = "chat_key", idx: str = "idx", rows: int = BUCKET_ROWS) -> Sequence:
    """Messages of a chat by position; at most ``rows`` positions per bucket."""
    return Sequence((key,), (idx,), F.floor(F.col(idx) / F.lit(rows)))


def with_position(df: DataFrame, seq: Sequence, out: str = "rn", descending: bool = False) -> DataFrame:
    """``row_number`` per key, starting at 1."""
    df = df.withColumn(_B, seq.bucket)
    counts = df.groupBy(*seq.keys, _B).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *seq.keys, _B,
        F.coalesce(F.sum("__n").over(seq.buckets_before(descending)), F.lit(0)).alias(_OFF),
    )
    return (
        df.join(shuffled(offsets), [*seq.keys, _B])
        .withColumn(out, (F.row_number().over(seq.window(descending)) + F.col(_OFF)).cast("long"))
        .drop(_B, _OFF)
    )


def with_running(
    df: DataFrame, seq: Sequence, value: Column, out: str, fn=F.sum, strict: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Running ``fn`` (sum or max) of ``value`` in the key, null when nothing came before.

    ``strict`` leaves out the row itself and rows with an equal order value; it
    needs a single numeric order column.
    """
    df = df.withColumn(_B, seq.bucket).withColumn("__v", value)
    partial = df.groupBy(*seq.keys, _B).agg(fn("__v").alias("__n"))
    offsets = partial.select(
        *seq.keys, _B, fn("__n").over(seq.buckets_before(descending)).alias(_OFF)
    )
    window = seq.window(descending)
    inner = (
        window.rangeBetween(Window.unboundedPreceding, -1)
        if strict
        else window.rowsBetween(Window.unboundedPreceding, 0)
    )
    own = fn("__v").over(inner)
    total = F.greatest(own, F.col(_OFF))
    if fn is F.sum:
        zero = F.lit(0)
        total = F.coalesce(own, zero) + F.coalesce(F.col(_OFF), zero)
    return df.join(shuffled(offsets), [*seq.keys, _B]).withColumn(out, total).drop(_B, _OFF, "__v")


def with_running_sums(
    df: DataFrame, seq: Sequence, values: dict[str, Column], descending: bool = False
) -> DataFrame:
    """Several running sums over one order, in one pass over the input."""
    df = df.withColumn(_B, seq.bucket)
    for out, value in values.items():
        df = df.withColumn(out, value)
    partial = df.groupBy(*seq.keys, _B).agg(*[F.sum(out).alias(out) for out in values])
    before = seq.buckets_before(descending)
    offsets = partial.select(
        *seq.keys, _B, *[F.coalesce(F.sum(out).over(before), F.lit(0)).alias(f"__off_{out}") for out in values]
    )
    inner = seq.window(descending).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(shuffled(offsets), [*seq.keys, _B])
    rest = [c for c in df.columns if c not in values and c != _B]
    return joined.select(*rest, *[(F.sum(out).over(inner) + F.col(f"__off_{out}")).alias(out) for out in values])


def with_running_sum(
    df: DataFrame, seq: Sequence, value: Column, out: str = "running", descending: bool = False
) -> DataFrame:
    """Sum of ``value`` from the start of the key up to and including the row."""
    return with_running_sums(df, seq, {out: value}, descending)


def with_previous(
    df: DataFrame, seq: Sequence, columns: dict[str, Column], descending: bool = False
) -> DataFrame:
    """Values of the row just before (or after, when ``descending``) in the key."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    order = F.struct(*[F.col(o) for o in seq.order])
    df = df.withColumn(_B, seq.bucket).withColumn("__row", packed)
    edge = (F.min_by if descending else F.max_by)("__row", order)
    edges = df.groupBy(*seq.keys, _B).agg(edge.alias("__edge"))
    before = Window.partitionBy(*seq.keys).orderBy(
        F.col(_B).desc() if descending else F.col(_B).asc()
    )
    edges = edges.select(*seq.keys, _B, F.lag("__edge").over(before).alias("__edge"))
    own = F.row_number().over(seq.window(descending)) == 1
    joined = (
        df.join(shuffled(edges), [*seq.keys, _B])
        .withColumn("__lag", F.lag("__row").over(seq.window(descending)))
        .withColumn("__first", own)
    )
    for name in columns:
        joined = joined.withColumn(
            name,
            F.when(F.col("__first"), F.col("__edge")[name]).otherwise(F.col("__lag")[name]),
        )
    return joined.drop(_B, "__row", "__edge", "__lag", "__first")


def with_last_before(
    df: DataFrame, seq: Sequence, out: str, value: Column, descending: bool = False
) -> DataFrame:
    """Latest non-null ``value`` strictly before the row in its key."""
    df = df.withColumn(_B, seq.bucket).withColumn("__v", value)
    order = F.struct(*[F.col(o) for o in seq.order])
    seen = F.when(F.col("__v").isNotNull(), order)
    pick = (F.min_by if descending else F.max_by)("__v", seen)
    edges = df.groupBy(*seq.keys, _B).agg(pick.alias("__edge"))
    edges = edges.select(
        *seq.keys, _B,
        F.last("__edge", ignorenulls=True).over(seq.buckets_before(descending)).alias("__edge"),
    )
    inner = seq.window(descending).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(shuffled(edges), [*seq.keys, _B])
        .withColumn(out, F.coalesce(F.last("__v", ignorenulls=True).over(inner), F.col("__edge")))
        .drop(_B, "__v", "__edge")
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    Spark limits each group map-side before the shuffle for this shape, so a hot
    key sends at most ``k`` rows per task to its final window.
    """
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)


def distinct_order(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the one with the smallest ``order``; combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min_by(row, order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def latest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the one with the greatest ``order``; combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.max_by(row, order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least one partition per core before text work.

    Large inputs already have more partitions than cores and pass unchanged, so
    no big table is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: rows of one side that a join broadcasts at most
BROADCAST_ROWS = 100_000


def shuffled(df: DataFrame) -> DataFrame:
    """This side of a join is shuffled and sorted, never broadcast.

    Spark guesses a side by the compressed size of its files and broadcasts what seems
    small; derived rows are easily fifty times that, more than a driver holds.
    """
    return df.hint("merge")


def sized(df: DataFrame) -> DataFrame:
    """A written stage as one side of a join: broadcast by its counted rows, not by its file size."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shuffled(df)


# ---- shared folder ------------------------------------------------------------
_own_folder: list[str] = []


def shared_folder(spark) -> str:
    """Folder every executor sees: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests) a temporary folder of our
    own is used; a cluster without the setting is an error, since executors do not
    see each other's disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-chatloom-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def write_through(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the next stage column
    pruning and real statistics for its join choices.
    """
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parts(parts: Iterable[DataFrame], name: str = "stage") -> DataFrame:
    """Write frames of one schema one after the other, as one stage; ``parts`` is not empty."""
    for k, df in enumerate(parts):
        path = path if k else os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_staged: dict[tuple, str] = {}


def staged(spark, key: tuple, build) -> DataFrame:
    """A derived table written once per application and read by later jobs."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _staged:
        df = build()
        path = os.path.join(shared_folder(spark), f"{key[0]}-{uuid.uuid4().hex}")
        df.write.mode("errorifexists").parquet(path)
        _staged[full] = path
    return spark.read.parquet(_staged[full])
