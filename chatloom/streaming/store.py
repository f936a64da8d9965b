"""Message store behind the stream: coverage, groups, mutations.

Rows live in (chat bucket, position bucket) partitions. A micro-batch rewrites
only the partitions it touches, so one huge chat costs no more than the
positions that changed. Every write is a function of the stored rows and the
batch keyed by (chat, position, seq), so replaying a batch changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, text as X
from ..operators.scale import latest_by, write_through
from ..sources.memory import chat_bucket

POSITIONS = 65_536


class MessageStore:
    """Latest state of every message plus per-bucket coverage counts."""

    def __init__(self, spark: SparkSession, path: str, processed: DataFrame | None = None,
                 version: int = fixed.EXTRACTION_VERSION, chat_buckets: int = 64, positions: int = POSITIONS,
                 buffer: int = fixed.STABILITY_BUFFER, group_size: int = fixed.L1_GROUP_SIZE):
        self.spark, self.path, self.processed, self.version = spark, path, processed, version
        self.chat_buckets, self.positions, self.buffer, self.group_size = chat_buckets, positions, buffer, group_size

    # -- plumbing ---------------------------------------------------------------
    def _at(self, name: str) -> str:
        return os.path.join(self.path, name)

    def _exists(self, name: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _read(self, name: str, schema) -> DataFrame:
        if self._exists(name):
            return self.spark.read.schema(schema).parquet(self._at(name))
        return self.spark.createDataFrame([], schema)

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("chat_bucket", chat_bucket(buckets=self.chat_buckets)).withColumn(
            "pos_bucket", F.floor(F.col("idx") / self.positions).cast("long"))

    _MESSAGES = (
        "chat_key string, idx long, name string, text string, is_user boolean, is_system boolean, deleted boolean, "
        "fingerprint string, seq long, chat_bucket int, pos_bucket long"
    )
    _COUNTS = (
        "chat_key string, total long, matched long, changed long, outdated long, never_processed long, latest_index long, "
        "chat_bucket int, pos_bucket long"
    )

    def messages(self) -> DataFrame:
        """Live messages: not deleted, not system, not blank."""
        m = self._read("messages", self._MESSAGES)
        return m.filter(~F.col("deleted") & ~F.col("is_system") & (F.trim("text") != ""))

    def coverage(self) -> DataFrame:
        """Running counts per chat (I1); a small sum over position buckets."""
        c = self._read("coverage", self._COUNTS)
        g = c.groupBy("chat_key").agg(*[F.sum(n).alias(n) for n in ("total", "matched", "changed", "outdated", "never_processed")],
                                      F.max("latest_index").alias("latest_index"))
        return g.filter("total > 0").withColumn("pending", F.col("total") - F.col("matched"))

    def backlog(self) -> DataFrame:
        """Catch-up policy on the running counts."""
        from ..operators.coverage import backlog

        return backlog(self.coverage().select("chat_key", "pending"), self.group_size)

    # -- one micro-batch -----------------------------------------------------------
    def apply(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Upsert a batch and return its mutations (I3): (chat_key, op, repair_from).

        A change inside the newest ``buffer`` live messages needs no repair;
        an older one gives one ``retract`` row per chat with the first position
        to rebuild from. A batch id seen before returns what it returned then.
        """
        events = latest_by(
            batch.select("chat_key", "idx", "name", "text", "is_user", "is_system", "op", "seq"), ["chat_key", "idx"], F.col("seq"))
        incoming = self._placed(events.select(
            "chat_key", "idx", "name", "text", "is_user", F.coalesce("is_system", F.lit(False)).alias("is_system"),
            (F.col("op") == "delete").alias("deleted"), X.fingerprint().alias("fingerprint"), "seq"))
        incoming = write_through(incoming, "incoming")
        touched = incoming.select("chat_bucket", "pos_bucket").distinct()
        stored = self._read("messages", self._MESSAGES).join(F.broadcast(touched) if self._few(touched) else touched, ["chat_bucket", "pos_bucket"], "left_semi")
        before = stored.join(incoming.select("chat_key", "idx"), ["chat_key", "idx"], "left_semi").select(
            "chat_key", "idx", F.col("fingerprint").alias("old"), F.col("seq").alias("old_seq"), F.col("deleted").alias("was_deleted"))
        merged = latest_by(stored.unionByName(incoming), ["chat_key", "idx"], F.col("seq"))
        merged = write_through(merged.select(*[c.split()[0] for c in self._MESSAGES.split(", ")]), "merged")
        changes = write_through(incoming.join(before, ["chat_key", "idx"], "left"), "changes")
        mutations = self._kept_mutations(changes, batch_id)
        self._overwrite(merged, "messages")
        self._overwrite(self._counts(merged), "coverage")
        return mutations

    def _kept_mutations(self, changes: DataFrame, batch_id: int | None) -> DataFrame:
        """Mutations of a batch, written before its messages: a batch that comes again returns the same ones."""
        if batch_id is None:
            return write_through(self._mutations(changes), "mutations")
        name = f"mutations/{batch_id}"
        if not self._exists(f"{name}/_SUCCESS"):
            self._mutations(changes).write.mode("overwrite").parquet(self._at(name))
        return self._read(name, "chat_key string, op string, repair_from long")

    def _few(self, df: DataFrame, most: int = 10_000) -> bool:
        return len(df.limit(most + 1).take(most + 1)) <= most

    def _overwrite(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chat_bucket", "pos_bucket").parquet(self._at(name))

    def _counts(self, merged: DataFrame) -> DataFrame:
        """Coverage counts of the touched partitions, recomputed from their rows."""
        live = ~F.col("deleted") & ~F.col("is_system") & (F.trim("text") != "")
        if self.processed is not None:
            p = self.processed.select("chat_key", "idx", F.col("fingerprint").alias("p_fp"), F.col("version").alias("p_v"))
            j = merged.join(p, ["chat_key", "idx"], "left")
        else:
            j = merged.withColumn("p_fp", F.lit(None).cast("string")).withColumn("p_v", F.lit(None).cast("int"))
        same = F.col("p_fp") == F.col("fingerprint")
        n = lambda c: F.count(F.when(live & c, 1))
        return j.groupBy("chat_key", "chat_bucket", "pos_bucket").agg(
            n(F.lit(True)).alias("total"), n(same & (F.col("p_v") == self.version)).alias("matched"),
            n(F.col("p_fp").isNotNull() & ~same).alias("changed"), n(same & (F.col("p_v") != self.version)).alias("outdated"),
            n(F.col("p_fp").isNull()).alias("never_processed"), F.max(F.when(live, F.col("idx"))).alias("latest_index"),
        ).select(*[c.split()[0] for c in self._COUNTS.split(", ")])

    def _mutations(self, changes: DataFrame) -> DataFrame:
        """Changed or deleted stored messages older than the protected tail."""
        from ..operators.scale import top_k

        hit = changes.filter(
            F.col("old").isNotNull() & (F.col("seq") > F.col("old_seq"))
            & (F.col("deleted") | F.col("was_deleted") | (F.col("old") != F.col("fingerprint"))))
        chats = hit.select("chat_key").distinct()
        # the tail before this batch: only the newest rows per chat are looked at
        newest = top_k(self.messages().join(chats, "chat_key", "left_semi").select("chat_key", "idx"), ["chat_key"], [F.col("idx").desc()], max(1, self.buffer))
        edge = newest.groupBy("chat_key").agg(F.min("idx").alias("edge"))
        old = hit.join(edge, "chat_key", "left").filter(F.col("edge").isNull() | (F.col("idx") < F.col("edge")))
        return old.groupBy("chat_key").agg(F.min("idx").alias("repair_from")).select("chat_key", F.lit("retract").alias("op"), "repair_from")


def start_ledger(events: DataFrame, store: MessageStore, checkpoint: str, on_mutations=None, available_now: bool = True):
    """Run the store on a stream. The handler may see a batch twice; the result is the same (I8)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        mutations = store.apply(batch, batch_id)
        if on_mutations is not None:
            on_mutations(mutations, batch_id)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def commit_range(df: DataFrame, path: str) -> None:
    """Idempotent result write keyed by (chat, range) (I8): the same range overwrites itself."""
    placed = df.withColumn("chat_bucket", chat_bucket(buckets=64)).withColumn("range_bucket", F.floor(F.col("range_from") / POSITIONS))
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        stored = spark.read.schema(placed.schema).parquet(path)
        parts = placed.select("chat_bucket", "range_bucket").distinct()
        keep = stored.join(parts, ["chat_bucket", "range_bucket"], "left_semi").join(
            placed.select("chat_key", "range_from", "range_to"), ["chat_key", "range_from", "range_to"], "left_anti")
        placed = write_through(keep.unionByName(placed), "ranges")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chat_bucket", "range_bucket").parquet(path)


def sync_index(batch: DataFrame, path: str, chats: DataFrame | None = None) -> dict[str, int]:
    """Make the index of the touched chats equal to the desired one.

    ``batch(chat_key, key, hash, text)`` is all that is desired of the chats in
    ``chats(chat_key)``, those of the batch by default; stored rows of them that
    are stale or no longer desired go. Replaying it finds nothing left to do. The
    batch is read several times: write a costly one before. Texts are not shuffled,
    rows compare by digests, and only buckets with a difference are written again.
    """
    spark = batch.sparkSession
    bucket = F.col("chat_bucket")
    placed = batch.withColumn("chat_bucket", chat_bucket(buckets=64))

    def put(rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chat_bucket").parquet(path)

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        added = placed.count()
        if added:
            put(placed)
        return {"added": added, "deleted": 0}
    asked = chats if chats is not None else placed
    mine = asked.select("chat_key").distinct()
    # there are 64 buckets at most
    touched = [r.chat_bucket for r in asked.select(chat_bucket(buckets=64).alias("chat_bucket")).distinct().collect()]
    old = spark.read.schema(placed.schema).parquet(path).filter(bucket.isin(touched))
    # json names its fields, so rows with nulls or odd characters stay apart
    digest = F.unhex(F.md5(F.to_json(F.struct("chat_key", "key", "hash"))))
    side = lambda df, new: df.select("chat_key", digest.alias("row"), F.lit(new).alias("new"), F.lit(1 - new).alias("old"))
    rows = side(placed, 1).unionByName(side(old, 0)).groupBy("chat_key", "row").agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
    differ = rows.filter("new = 0 OR old = 0").groupBy("chat_key").agg(F.sum("new").alias("added"), F.sum("old").alias("deleted"))
    differ = differ.join(mine, "chat_key", "left_semi").groupBy(chat_bucket(buckets=64).alias("chat_bucket"))
    found = differ.agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted")).collect()
    if found:
        changed = [r.chat_bucket for r in found]
        stored, content = old.filter(bucket.isin(changed)), placed.filter(bucket.isin(changed))
        others = stored.select("chat_key").distinct().join(mine, "chat_key", "left_anti")
        if not others.isEmpty():
            content = stored.join(others, "chat_key", "left_semi").select(*placed.columns).unionByName(content)
        filled = {r.chat_bucket for r in content.select("chat_bucket").distinct().collect()}
        put(content)
        # a write leaves alone the folders it has no rows for
        for left in set(changed) - filled:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chat_bucket={left}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return {"added": sum(r.added for r in found), "deleted": sum(r.deleted for r in found)}
