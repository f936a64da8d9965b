"""State lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from .scale import latest_by


def with_identity(states: DataFrame) -> DataFrame:
    """Folded subject and canonical attribute, the identity of a state."""
    return states.withColumn("k_subject", X.fold_key("subject")).withColumn(
        "k_attribute", F.lower(X.canonical_attribute("attribute"))
    )


def state_timeline(states: DataFrame, ranges: DataFrame) -> DataFrame:
    """Surviving state per identity.

    The last operation decides (an empty ``set`` counts for nothing); a scene
    state lives only while its range is the newest that may update state.
    ``ranges(chat_key, range_to[, allow_state_updates])``. One max_by per
    identity and one max per chat: both combine before the shuffle.
    """
    usable = states.filter((F.col("operation") == "clear") | (X.normalize_text("value") != ""))
    if "allow_state_updates" in ranges.columns:
        ranges = ranges.filter("allow_state_updates")
    newest = ranges.groupBy("chat_key").agg(F.max("range_to").alias("newest_to"))
    last = latest_by(
        with_identity(usable), ["chat_key", "k_subject", "k_attribute"], F.struct("range_to", "seq")
    )
    return (
        last.filter(F.col("operation") == "set")
        .join(newest, "chat_key")
        .filter((F.col("scope") == "ongoing") | (F.col("range_to") == F.col("newest_to")))
        .drop("newest_to")
    )


def reconcile_previous_values(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Set ``previous`` from the stored value when it changes.

    A stored row is found by target id, else by identity; when id, attribute and
    previous value agree but the subject differs, the stored subject is restored.
    """
    s = with_identity(stored).select(
        "chat_key", F.col("id").alias("s_id"), F.col("subject").alias("s_subject"), "k_subject", "k_attribute",
        F.col("value").alias("s_value"),
    )
    i = with_identity(incoming)
    by_id = s.select("chat_key", F.col("s_id").alias("target_id"), F.col("s_subject").alias("a_subject"),
                     F.col("k_attribute").alias("a_attribute"), F.col("s_value").alias("a_value"))
    by_key = s.select("chat_key", "k_subject", "k_attribute", F.col("s_value").alias("b_value"))
    j = i.join(by_id, ["chat_key", "target_id"], "left").join(
        by_key, ["chat_key", "k_subject", "k_attribute"], "left"
    )
    prior = F.coalesce("a_value", "b_value")
    changed = prior.isNotNull() & (X.fold_key(prior) != X.fold_key("value"))
    owner_slip = (
        F.col("a_subject").isNotNull() & (F.col("a_attribute") == F.col("k_attribute"))
        & (X.fold_key("a_value") == X.fold_key("previous")) & (X.fold_key("a_subject") != F.col("k_subject"))
    )
    return j.select(
        *[c for c in incoming.columns if c not in ("previous", "subject")],
        F.when(owner_slip, F.col("a_subject")).otherwise(F.col("subject")).alias("subject"),
        F.when(changed, prior).otherwise(F.col("previous")).alias("previous"),
    )


def promote_tail_range(ranges: DataFrame, complete: DataFrame) -> DataFrame:
    """Stored backfill ranges that end at the latest complete index.

    ``complete(chat_key, latest_complete)``; the returned ranges may now update
    state, so a following ``state_timeline`` applies their scene and states.
    """
    hit = ranges.join(complete, (ranges.chat_key == complete.chat_key) & (ranges.range_to == complete.latest_complete)).select(
        ranges["*"]
    )
    best = hit.groupBy("chat_key", "range_to").agg(
        F.max_by(F.struct("range_from", "allow_state_updates"), "range_from").alias("r")
    )
    return best.filter(~F.col("r.allow_state_updates")).select(
        "chat_key", F.col("r.range_from").alias("range_from"), "range_to"
    )


def latest_complete_index(messages: DataFrame, n: int) -> DataFrame:
    """Last position that belongs to a complete group of ``n``."""
    from .groups import l1_groups

    return l1_groups(messages, n).groupBy("chat_key").agg(F.max("range_to").alias("latest_complete"))
