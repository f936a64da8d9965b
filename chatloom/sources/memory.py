"""Stored memory: partitioned tables, hand-off, renames and bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X

BUCKETS = 1024


def chat_bucket(key="chat_key", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_memory(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """Write record tables so that an update rewrites only the buckets it touches.

    One folder per category, partitioned by chat bucket; dynamic overwrite
    replaces just the partitions present in the data. A hot chat spreads over
    as many files as tasks: rows are not forced into one task per bucket.
    """
    for name, df in tables.items():
        (
            df.withColumn("chat_bucket", chat_bucket(buckets=buckets))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("chat_bucket").parquet(f"{path}/{name}")
        )


def read_memory(spark: SparkSession, path: str, categories: list[str], chats: list[str] | None = None, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Read record tables; naming chats prunes to their buckets."""
    out = {}
    for name in categories:
        df = spark.read.parquet(f"{path}/{name}")
        if chats:
            keys = spark.createDataFrame([(c,) for c in chats], "chat_key string")
            wanted = [r[0] for r in keys.select(chat_bucket(buckets=buckets)).distinct().collect()]
            df = df.filter(F.col("chat_bucket").isin(wanted) & F.col("chat_key").isin(chats))
        out[name] = df.drop("chat_bucket")
    return out


def touched_buckets(changes: DataFrame, stored: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Stored rows of the buckets a change set touches; only these are rewritten."""
    hit = changes.select(chat_bucket(buckets=buckets).alias("chat_bucket")).distinct()
    return stored.withColumn("chat_bucket", chat_bucket(buckets=buckets)).join(hit, "chat_bucket", "left_semi").drop("chat_bucket")


def _remap_sources(sources: Column, old: Column, new: Column) -> Column:
    return F.transform(
        sources,
        lambda s: F.struct(
            F.when(s["chat_key"] == old, new).otherwise(s["chat_key"]).alias("chat_key"),
            s["range_from"].alias("range_from"), s["range_to"].alias("range_to"),
        ),
    )


def handoff(records: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Copy records to new chats as inherited history.

    ``records(memory_id, chat_key, id, sources, ...)``, ``handoffs(memory_id,
    new_chat)``. Sources point at an inherited key. The mapping joins on the
    memory, so one job serves many hand-offs.
    """
    inherited = F.concat(F.lit("inherited:"), "memory_id")
    j = records.join(handoffs, "memory_id")
    moved = F.transform(
        "sources", lambda s: F.struct(inherited.alias("chat_key"), s["range_from"].alias("range_from"), s["range_to"].alias("range_to")))
    return j.withColumn("sources", moved).withColumn("chat_key", inherited).withColumn("inherited", F.lit(True))


def inherited_story(stories: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Newest non-empty story of each handed-over memory, under the new chat."""
    newest = stories.filter(F.trim("text") != "").groupBy("memory_id").agg(
        F.max_by(F.struct("text", "to"), F.struct("to", "updated_at")).alias("s"))
    return newest.join(handoffs, "memory_id").select(F.col("new_chat").alias("chat_key"), "s.text", "s.to")


def remap_chat_key(records: DataFrame, mapping: DataFrame, existing: DataFrame) -> DataFrame:
    """Rename chats in records and sources (A9); a taken target is refused.

    ``mapping(old_chat, new_chat)``; ``existing(chat_key)`` are chats that have
    a memory. A refused mapping leaves its records unchanged.
    """
    allowed = mapping.join(existing.select(F.col("chat_key").alias("new_chat")).distinct(), "new_chat", "left_anti")
    j = records.join(allowed.withColumnRenamed("old_chat", "chat_key"), "chat_key", "left")
    old, new = F.col("chat_key"), F.col("new_chat")
    out = j
    if "sources" in records.columns:
        out = out.withColumn("sources", F.when(new.isNotNull(), _remap_sources(F.col("sources"), old, new)).otherwise(F.col("sources")))
    return out.withColumn("chat_key", F.coalesce(new, old)).drop("new_chat").select(*records.columns)


def bind_chats(bindings: DataFrame, changes: DataFrame) -> DataFrame:
    """Attach deleted or renamed chats to their memory.

    ``bindings(chat_key, memory_id)``, ``changes(change_id, owner_kind, chat,
    new_chat)``; a key is ``owner:id:chat:name``. Exactly one match binds; more
    are ambiguous; ``shared`` tells that another chat has the same memory.
    """
    b = bindings.filter(F.coalesce("memory_id", F.lit("")) != "").select(
        F.col("chat_key").alias("bound_key"), "memory_id",
        F.regexp_extract("chat_key", r"^(character|group):", 1).alias("owner_kind"),
        F.regexp_extract("chat_key", r":chat:(.*)$", 1).alias("chat"),
        F.regexp_extract("chat_key", r"^(.*?):chat:", 1).alias("owner"))
    users = bindings.groupBy("memory_id").agg(F.count(F.lit(1)).alias("uses"))
    j = changes.join(b, ["owner_kind", "chat"], "left").join(users, "memory_id", "left")
    g = j.groupBy("change_id").agg(
        F.count("bound_key").alias("matches"), F.min("bound_key").alias("bound_key"), F.min("memory_id").alias("memory_id"),
        F.max("uses").alias("uses"), F.min(F.concat_ws(":chat:", "owner", "new_chat")).alias("renamed"), F.max("new_chat").alias("new_chat"))
    one = F.col("matches") == 1
    return g.select(
        "change_id", F.when(one, F.col("memory_id")).alias("memory_id"), F.when(one, F.col("bound_key")).alias("chat_key"),
        F.when(one & F.col("new_chat").isNotNull(), F.col("renamed")).alias("new_chat_key"),
        (F.col("matches") > 1).alias("ambiguous"), (one & (F.col("uses") > 1)).alias("shared"))


def rebind_missing(memories: DataFrame, bound: DataFrame) -> DataFrame:
    """Find a missing memory by its unique expected name.

    ``memories(memory_id, name)``, ``bound(chat_key, memory_id, expected_name)``.
    """
    missing = bound.join(memories.select("memory_id"), "memory_id", "left_anti")
    named = memories.groupBy("name").agg(F.min("memory_id").alias("found"), F.count(F.lit(1)).alias("n"))
    j = missing.join(named.withColumnRenamed("name", "expected_name"), "expected_name", "left")
    return j.select("chat_key", F.when(F.col("n") == 1, F.col("found")).alias("memory_id"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))
