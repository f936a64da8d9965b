"""Named queries that run the stream operators over the sample events."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.scale import shared_folder, write_through
from ..streaming import processors as P
from ..streaming.source import EVENT_SCHEMA, read_message_stream
from ..streaming.store import MessageStore, start_ledger, sync_index
from . import bindings as B, ledger, memory, recall  # noqa: F401  (shared fragments)
from .registry import query, sql

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _folder(spark, name):
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _collect(spark, stream, schema):
    """Run a stream over what is there and return the rows it wrote."""
    out, check = _folder(spark, "stream"), _folder(spark, "check")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(schema).parquet(out)


def _collect_parts(spark, df, parts, build, schema):
    """One batch after another: each part is written and run through the stream before the next one comes."""
    path, out, check = (_folder(spark, n) for n in ("events", "stream", "check"))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for p in range(parts):
            df.filter(F.col("part") == p).drop("part").write.mode("append").parquet(path)
            q = build(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(schema).parquet(out)


def _event_files(spark, df, parts, name="events"):
    """Write events as a few files, in order, for the file source."""
    path = _folder(spark, name)
    for p in range(parts):
        df.filter(F.col("part") == p).drop("part").write.mode("append").parquet(path)
    return path


def _message_events(spark, sf):
    m = B.messages(spark, sf)
    return m.select("chat_key", "idx", "name", "text", "is_user", F.lit(False).alias("is_system"), F.lit("new").alias("op"),
                    F.col("idx").alias("seq"), F.when(F.col("idx") < 30, 0).when(F.col("idx") < 45, 1).otherwise(2).alias("part"))


@query("stream_l1_groups", sql("""
WITH e AS (SELECT chat_key, idx FROM msg QUALIFY NOT (row_number() OVER (PARTITION BY chat_key ORDER BY idx DESC) = 1 AND NOT is_user)),
s AS (SELECT chat_key, idx, row_number() OVER (PARTITION BY chat_key ORDER BY idx) AS rn FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY chat_key ORDER BY idx DESC) > 2))
SELECT chat_key, (rn - 1) // 8 AS group_no, min(idx) AS range_from, max(idx) AS range_to FROM s GROUP BY ALL HAVING count(*) = 8
""", "msg"))
def _(spark, sf):
    path = _event_files(spark, _message_events(spark, sf), 3)
    return _collect(spark, P.stream_l1_groups(read_message_stream(spark, path)), P.GROUP_SCHEMA)


@query("stream_revised_groups", sql("""
WITH alive AS (SELECT * FROM msg WHERE NOT (event_id % 37 = 0 AND event_id % 2 = 0)),
e AS (SELECT chat_key, idx FROM alive QUALIFY NOT (row_number() OVER (PARTITION BY chat_key ORDER BY idx DESC) = 1 AND NOT is_user)),
s AS (SELECT chat_key, idx, row_number() OVER (PARTITION BY chat_key ORDER BY idx) AS rn FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY chat_key ORDER BY idx DESC) > 2))
SELECT chat_key, (rn - 1) // 8 AS group_no, min(idx) AS range_from, max(idx) AS range_to FROM s GROUP BY ALL HAVING count(*) = 8
""", "msg"))
def _(spark, sf):
    m = B.messages(spark, sf).withColumn("is_system", F.lit(False)).withColumn("op", F.lit("new"))
    late, hit = F.col("event_id") % 41 == 0, F.col("event_id") % 37 == 0
    cols = ["chat_key", "idx", "name", "text", "is_user", "is_system", "op", "seq"]
    first = m.withColumn("seq", F.col("idx")).withColumn("part", F.when(late, 2).when(F.col("idx") < 30, 0).otherwise(1))
    change = m.filter(hit).withColumn("op", F.when(F.col("event_id") % 2 == 0, "delete").otherwise("edit")).withColumn(
        "text", F.concat("text", F.lit(" edited"))).withColumn("seq", F.col("idx") + 1_000_000).withColumn("part", F.lit(3))
    events = first.select(*cols, "part").unionByName(change.select(*cols, "part"))
    rows = _collect_parts(spark, events, 4, lambda path: P.stream_revised_groups(read_message_stream(spark, path)), P.REVISION_SCHEMA)
    return P.standing_groups(rows).drop("version")


@query("stream_coverage", sql("""
SELECT chat_key, count(*) AS total, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'changed') AS changed,
  count(*) FILTER (WHERE status = 'outdated') AS outdated, count(*) FILTER (WHERE status = 'never') AS never_processed FROM stat GROUP BY chat_key
""", "stat"))
def _(spark, sf):
    path = _event_files(spark, _message_events(spark, sf), 3)
    store = MessageStore(spark, _folder(spark, "store"), B.processed(spark, sf), chat_buckets=8, positions=32)
    start_ledger(read_message_stream(spark, path), store, _folder(spark, "check")).awaitTermination()
    return store.coverage().select("chat_key", "total", "matched", "changed", "outdated", "never_processed")


@query("stream_mutations", sql("""
WITH p AS (SELECT chat_key, idx, row_number() OVER (PARTITION BY chat_key ORDER BY idx DESC) AS back, event_id FROM msg),
h AS (SELECT chat_key, idx FROM p WHERE event_id % 37 = 0 AND back > 2)
SELECT chat_key, 'retract' AS op, min(idx) AS repair_from FROM h GROUP BY chat_key
""", "msg"))
def _(spark, sf):
    m = B.messages(spark, sf)
    cols = ["chat_key", "idx", "name", "text", "is_user", "is_system", "op", "seq"]
    first = m.withColumn("op", F.lit("new")).withColumn("seq", F.col("idx")).select(*cols)
    later = m.filter(F.col("event_id") % 37 == 0).withColumn("op", F.when(F.col("event_id") % 2 == 0, "delete").otherwise("edit")).withColumn(
        "text", F.concat("text", F.lit(" edited"))).withColumn("seq", F.col("idx") + 1_000_000).select(*cols)
    store = MessageStore(spark, _folder(spark, "store"), chat_buckets=8, positions=32)
    store.apply(first, 0)
    return store.apply(later, 1)


@query("stream_state_timeline", sql("""
WITH last AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY chat_key, subject, attribute ORDER BY range_to DESC, seq DESC) = 1),
n AS (SELECT chat_key, max(range_to) AS nt FROM state GROUP BY chat_key)
SELECT chat_key, attribute, value, scope FROM last JOIN n USING (chat_key) WHERE operation = 'set' AND (scope = 'ongoing' OR range_to = nt)
""", "state"))
def _(spark, sf):
    s = B.states(spark, sf).select("chat_key", "subject", "attribute", "value", "scope", "operation", "range_to", "seq")
    path = _event_files(spark, s.withColumn("part", F.when(F.col("range_to") < 32, 0).otherwise(1)), 2, "states")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1_000_000).parquet(path)
    rows = _collect(spark, P.stream_state_timeline(stream), P.STATE_SCHEMA)
    # the last change of an identity tells whether it is live
    g = rows.groupBy("chat_key", "attribute").agg(F.max_by(F.struct("value", "scope", "op"), "n").alias("r"))
    return g.filter("r.op = 'set'").select("chat_key", "attribute", "r.value", "r.scope")


@query("stream_checkpoints", sql("""
SELECT chat_key, row_number() OVER (PARTITION BY chat_key ORDER BY range_to) - 1 AS checkpoint_no, range_to AS "to", range_to + 1 AS covered FROM l1 WHERE (range_to + 1) % 32 = 0
""", "l1"))
def _(spark, sf):
    u = B.l1(spark, sf).select("chat_key", F.col("range_to").alias("to"), F.lit(8).cast("long").alias("covered"))
    path = _event_files(spark, u.withColumn("part", F.when(F.col("to") < 40, 0).otherwise(1)), 2, "updates")
    stream = spark.readStream.schema(u.schema).parquet(path)
    return _collect(spark, P.stream_checkpoints(stream), P.CHECKPOINT_SCHEMA)


@query("stream_index_sync", sql("""
SELECT 1 AS step, count(*) AS added, 0 AS deleted FROM edocs UNION ALL SELECT 2, 0, 0
UNION ALL SELECT 3, count(*), count(*) FROM edocs WHERE key LIKE 'fact:%'
UNION ALL SELECT 4, 0, count(*) FROM edocs WHERE key LIKE 'fact:%'
""".replace("SELECT 1 AS step", "SELECT CAST(1 AS BIGINT) AS step").replace("0 AS deleted", "CAST(0 AS BIGINT) AS deleted"), "edocs"))
def _(spark, sf):
    d = write_through(recall._edocs(spark, sf), "documents")
    path = _folder(spark, "index")
    changed = d.withColumn("text", F.when(F.col("key").startswith("fact:"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    changed = changed.withColumn("hash", F.md5(F.concat_ws("\n", "key", "text")))
    left, chats = changed.filter(~F.col("key").startswith("fact:")), d.select("chat_key").distinct()
    steps = [*(sync_index(b, path) for b in (d, d, changed)), sync_index(left, path, chats)]
    return spark.createDataFrame([(i + 1, s["added"], s["deleted"]) for i, s in enumerate(steps)], "step long, added long, deleted long")
