"""Rolling story operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from .scale import Sequence, message_order, top_k, with_previous, with_running_sum, write_through


def covered_counts(updates: DataFrame, messages: DataFrame) -> DataFrame:
    """Covered messages up to each story update: adds ``covered``."""
    marks = messages.select("chat_key", "idx", F.lit(1).alias("m"), F.lit(None).cast("long").alias("update_to"))
    ups = updates.select("chat_key", F.col("to").alias("idx"), F.lit(0).alias("m"), F.col("to").alias("update_to"))
    # an update counts the messages at or before its position
    rows = marks.unionByName(ups).withColumn("o", 1 - F.col("m"))
    seq = Sequence(("chat_key",), ("idx", "o"), F.floor(F.col("idx") / 65_536))
    run = with_running_sum(rows, seq, F.col("m"), "covered")
    return run.filter("update_to IS NOT NULL").select("chat_key", F.col("update_to").alias("to"), "covered")


_BLOCK_INTERVALS = 256


def story_checkpoints(
    updates: DataFrame, messages: DataFrame, interval: int = fixed.CHECKPOINT_INTERVAL, keep: int = fixed.CHECKPOINT_KEEP
) -> DataFrame:
    """Checkpoints after a run of story updates.

    An update becomes a checkpoint when ``interval`` messages were covered since
    the last one; the first and the newest ``keep - 1`` stay. The rule is
    sequential, so a chat is cut into blocks of covered messages. How far the
    last checkpoint lies before a block has only ``interval + 1`` cases; each
    block is folded for all of them in parallel, the blocks are then linked, and
    each block is folded once more from its true start.
    ``updates(chat_key, to)``.
    """
    width = interval * _BLOCK_INTERVALS
    counted = covered_counts(updates, messages).groupBy("chat_key", "covered").agg(F.min("to").alias("to"))
    block = F.floor(F.col("covered") / width)
    blocks = counted.groupBy("chat_key", block.alias("b")).agg(F.array_sort(F.collect_list(F.struct("covered", "to"))).alias("u"))
    blocks = write_through(blocks, "checkpoint-blocks")

    def fold(base, with_list: bool):
        empty = F.array().cast("array<bigint>")
        start = F.struct(base.cast("long").alias("base"), F.lit(False).alias("any"), empty.alias("cp"))

        def step(acc, x):
            hit = F.struct(
                x["covered"].cast("long").alias("base"), F.lit(True).alias("any"),
                (F.concat(acc["cp"], F.array(x["to"].cast("long"))) if with_list else empty).alias("cp"),
            )
            return F.when(x["covered"] - acc["base"] >= interval, hit).otherwise(acc)

        return F.aggregate("u", start, step)

    cases = F.transform(F.sequence(F.lit(0), F.lit(interval)), lambda r: fold(F.col("b") * width - r, False))
    exits = blocks.select("chat_key", "b", F.transform(cases, lambda c: F.when(c["any"], c["base"])).alias("exits"))
    chats = exits.groupBy("chat_key").agg(F.array_sort(F.collect_list(F.struct("b", "exits"))).alias("bs"))
    first = F.struct(F.lit(0).cast("long").alias("base"), F.array().cast("array<struct<b:bigint,base:bigint>>").alias("starts"))

    def link(acc, x):
        behind = F.least(F.lit(interval).cast("long"), x["b"] * width - acc["base"]).cast("int")
        return F.struct(
            F.coalesce(F.get(x["exits"], behind), acc["base"]).alias("base"),
            F.concat(acc["starts"], F.array(F.struct(x["b"].alias("b"), acc["base"].alias("base")))).alias("starts"),
        )

    starts = chats.select("chat_key", F.explode(F.aggregate("bs", first, link)["starts"]).alias("s")).select("chat_key", "s.b", "s.base")
    made = blocks.join(starts, ["chat_key", "b"]).select("chat_key", F.explode(fold(F.col("base"), True)["cp"]).alias("to"))
    made = write_through(made, "checkpoints")
    kept = made.groupBy("chat_key").agg(F.min("to").alias("to"))
    if keep > 1:
        kept = kept.unionByName(top_k(made, ["chat_key"], [F.col("to").desc()], keep - 1).select("chat_key", "to"))
    numbered = Window.partitionBy("chat_key").orderBy("to")  # at most `keep` rows
    return kept.distinct().select("chat_key", (F.row_number().over(numbered) - 1).alias("checkpoint_no"), "to")


def story_rewind(stories: DataFrame, fingerprints: DataFrame, checkpoints: DataFrame, messages: DataFrame) -> DataFrame:
    """Where each story must restart.

    ``stories(chat_key, to)``, ``fingerprints(chat_key, idx, fingerprint)`` kept
    with the story, ``checkpoints(chat_key, to)``. A checkpoint holds when it
    ends before the first difference; all its fingerprints then match, so no
    per-checkpoint scan is needed.
    """
    s = stories.select("chat_key", F.col("to").alias("story_to"))
    saved = fingerprints.join(s, "chat_key").filter("idx <= story_to").select("chat_key", "idx", F.col("fingerprint").alias("saved"))
    now = messages.join(s, "chat_key").filter("idx <= story_to").select("chat_key", "idx", "fingerprint")
    diff = saved.join(now, ["chat_key", "idx"], "full_outer").groupBy("chat_key").agg(
        F.min(F.when(F.col("saved").isNull() | F.col("fingerprint").isNull() | (F.col("saved") != F.col("fingerprint")), F.col("idx"))).alias("earliest"),
        F.count("saved").alias("n_saved"))
    latest = messages.groupBy("chat_key").agg(F.max("idx").alias("latest"), F.min("idx").alias("first_idx"))
    j = s.join(diff, "chat_key", "left").join(latest, "chat_key", "left")
    verifiable = F.coalesce("n_saved", F.lit(0)) > 0
    late = F.when(~verifiable & (F.col("story_to") > F.coalesce("latest", F.lit(-1))), F.lit(0).cast("long"))
    j = j.withColumn("first_bad", F.when(verifiable, F.col("earliest")).otherwise(late)).filter("first_bad IS NOT NULL")
    # a checkpoint needs at least one stored fingerprint at or before its end
    first_saved = saved.groupBy("chat_key").agg(F.min("idx").alias("first_saved"))
    best = (
        j.join(checkpoints.select("chat_key", F.col("to").alias("c_to")), "chat_key").join(first_saved, "chat_key")
        .filter((F.col("c_to") < F.col("first_bad")) & (F.col("c_to") <= F.col("latest")) & (F.col("c_to") >= F.col("first_saved")))
        .groupBy("chat_key").agg(F.max("c_to").alias("checkpoint_to"))
    )
    return j.join(best, "chat_key", "left").select(
        "chat_key", F.col("first_bad").alias("earliest"), "checkpoint_to",
        F.when(F.col("checkpoint_to").isNull(), "restart").otherwise("resume").alias("action"),
        F.col("latest").alias("rebuild_target_to"))


def story_plan(stories: DataFrame, messages: DataFrame, batch: int = 8, partial: bool = False) -> DataFrame:
    """Messages to process next per chat, with coverage.

    ``stories(chat_key, text, to, rebuild_incomplete, rebuild_restart, rebuild_target_to)``;
    chats without a story start from the beginning. Only complete batches count.
    """
    j = messages.select("chat_key", "idx").join(stories, "chat_key", "left")
    has = F.coalesce("text", F.lit("")) != ""
    restart = F.coalesce("rebuild_restart", F.lit(False)) & F.col("rebuild_target_to").isNotNull()
    resume = F.coalesce("rebuild_incomplete", F.lit(False)) & has & (F.col("to") < F.col("rebuild_target_to"))
    mode = F.when(restart, "restart").when(resume, "resume").otherwise("continue")
    idx, to = F.col("idx"), F.col("to")
    wanted = (
        F.when(restart, idx <= F.col("rebuild_target_to")).when(resume, (idx > to) & (idx <= F.col("rebuild_target_to")))
        .when(has & to.isNotNull(), idx > to).otherwise(F.lit(True))
    )
    behind = F.when(to.isNotNull(), idx > to).otherwise(F.lit(True))
    g = j.groupBy("chat_key").agg(
        F.max(mode).alias("mode"), F.count(F.when(wanted, 1)).alias("available"), F.count(F.when(behind, 1)).alias("pending"),
        F.min(F.when(wanted, idx)).alias("next_from"),
        F.max(has & ~F.coalesce("rebuild_incomplete", F.lit(False)) & ~F.coalesce("rebuild_restart", F.lit(False))).alias("settled"))
    size = min(50, max(2, batch))
    complete = F.col("available") if partial else (F.floor(F.col("available") / size) * size).cast("long")
    return g.select("chat_key", "mode", "next_from", complete.alias("to_process"), "pending", (F.col("settled") & (F.col("pending") == 0)).alias("current"))


def story_units(messages: DataFrame, l1: DataFrame, required_through: DataFrame) -> DataFrame:
    """Level-1 units a story may use, up to the first gap.

    A unit must start at the first message not covered yet and end on a message.
    ``required_through(chat_key, required)``. Flags per row; the first broken
    row per chat is one aggregate.
    """
    m = messages.join(required_through, "chat_key").filter(F.col("idx") <= F.col("required"))
    nxt = with_previous(m.select("chat_key", "idx"), message_order(), {"next_idx": F.col("idx")}, descending=True)
    ends = nxt.select("chat_key", F.col("idx").alias("range_to"), "next_idx")
    caps = l1.join(required_through, "chat_key").filter(F.col("range_to") <= F.col("required"))
    u = caps.join(ends, ["chat_key", "range_to"], "left").withColumn("on_message", F.col("next_idx").isNotNull())
    # the last message of the required part has no next one but is a message
    last = m.groupBy("chat_key").agg(F.max("idx").alias("last_idx"), F.min("idx").alias("first_idx"))
    u = u.join(last, "chat_key").withColumn("on_message", F.col("on_message") | (F.col("range_to") == F.col("last_idx")))
    seq = Sequence(("chat_key",), ("range_from",), F.floor(F.col("range_from") / 65_536))
    u = with_previous(u, seq, {"expected": F.col("next_idx"), "prev_ok": F.col("on_message")})
    start_ok = F.when(F.col("prev_ok").isNull(), F.col("range_from") == F.col("first_idx")).otherwise(F.col("range_from") == F.col("expected"))
    u = u.withColumn("ok", F.coalesce(start_ok, F.lit(False)) & F.col("on_message"))
    stop = u.groupBy("chat_key").agg(F.min(F.when(~F.col("ok"), F.col("range_from"))).alias("bad_from"))
    good = u.join(stop, "chat_key").filter(F.col("bad_from").isNull() | (F.col("range_from") < F.col("bad_from")))
    g = good.groupBy("chat_key").agg(F.count(F.lit(1)).alias("units"), F.max("range_to").alias("covered_to"), F.max_by("next_idx", "range_to").alias("blocked"))
    return last.join(g, "chat_key", "left").select(
        "chat_key", F.coalesce("units", F.lit(0)).alias("units"),
        F.when(F.col("units").isNull(), F.col("first_idx")).otherwise(F.col("blocked")).alias("blocked_from"))


def story_policy_current(stories: DataFrame, version: int = fixed.STORY_POLICY_VERSION) -> DataFrame:
    """Flag stories built under an older source policy (they must be rebuilt)."""
    ok = (F.col("source_mode") == "raw") | (F.coalesce("policy_version", F.lit(0)) >= version)
    return stories.withColumn("policy_current", ok)
