"""Ledger operators: coverage, divergence, alignment, branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, text as X
from .scale import latest_by, message_order, with_position, with_previous

V = fixed.EXTRACTION_VERSION


def _ledger(processed: DataFrame) -> DataFrame:
    return processed.select(
        "chat_key", "idx",
        F.col("fingerprint").alias("stored_fingerprint"), F.col("version").alias("stored_version"),
    )


def message_status(messages: DataFrame, processed: DataFrame, version: int = V) -> DataFrame:
    """Each message with its ledger status: matched, outdated, changed or never."""
    same = F.col("stored_fingerprint") == F.col("fingerprint")
    status = (
        F.when(F.col("stored_fingerprint").isNull(), "never")
        .when(same & (F.col("stored_version") == version), "matched")
        .when(same, "outdated")
        .otherwise("changed")
    )
    joined = messages.join(_ledger(processed), ["chat_key", "idx"], "left")
    return joined.withColumn("status", status).drop("stored_fingerprint", "stored_version")


def coverage(messages: DataFrame, processed: DataFrame, version: int = V) -> DataFrame:
    """Counts per chat of covered and pending messages."""
    s = message_status(messages, processed, version)

    def n(condition):
        return F.count(F.when(condition, 1))

    status = F.col("status")
    return s.groupBy("chat_key").agg(
        F.count(F.lit(1)).alias("total"),
        F.max("idx").alias("latest_index"),
        n(status == "matched").alias("processed"),
        n(status != "matched").alias("pending"),
        n(status == "changed").alias("changed"),
        n(status == "outdated").alias("outdated"),
        n(status == "never").alias("never_processed"),
    )


def coalesce_ranges(indexes: DataFrame) -> DataFrame:
    """Contiguous (chat_key, idx) rows as [range_from, range_to]."""
    placed = with_position(indexes.select("chat_key", "idx").distinct(), message_order(), "rn")
    return (
        placed.groupBy("chat_key", (F.col("idx") - F.col("rn")).alias("island"))
        .agg(F.min("idx").alias("range_from"), F.max("idx").alias("range_to"))
        .drop("island")
    )


def pending_ranges(messages: DataFrame, processed: DataFrame, version: int = V) -> DataFrame:
    pending = message_status(messages, processed, version).filter(F.col("status") != "matched")
    return coalesce_ranges(pending)


def _range_end(ranges: DataFrame):
    """Last position a range rests on, by its bounds or its stored fingerprints."""
    if "message_fingerprints" in ranges.columns:
        stored = F.array_max(F.transform("message_fingerprints", lambda m: m["idx"]))
        return F.greatest("range_to", F.coalesce(stored, F.col("range_to")))
    return F.col("range_to")


def tail_rollback(messages: DataFrame, processed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ledger rows and ranges past the current end of a chat."""
    latest = messages.groupBy("chat_key").agg(F.max("idx").alias("latest_index"))
    removed = (
        processed.select("chat_key", "idx")
        .join(latest, "chat_key", "left")
        .withColumn("latest_index", F.coalesce("latest_index", F.lit(-1)))
        .filter(F.col("idx") > F.col("latest_index"))
        .groupBy("chat_key")
        .agg(
            F.max("latest_index").alias("latest_index"),
            F.countDistinct("idx").alias("removed_messages"),
            F.min("idx").alias("removed_from"),
            F.max("idx").alias("removed_to"),
        )
    )
    affected = (
        ranges.withColumn("end", _range_end(ranges))
        .join(latest, "chat_key", "left")
        .filter(F.col("end") > F.coalesce("latest_index", F.lit(-1)))
        .groupBy("chat_key")
        .agg(F.count(F.lit(1)).alias("affected_ranges"))
    )
    return removed.join(affected, "chat_key", "left").fillna(0, ["affected_ranges"])


def divergence(messages: DataFrame, processed: DataFrame, version: int | None = V) -> DataFrame:
    """First position per chat where the ledger and the chat disagree.

    One full outer join on (chat, position), then one aggregate: a visible but
    unstored position counts only up to the last stored one, and the smallest
    such position decides, so no second join is needed.
    """
    both = messages.select("chat_key", "idx", "fingerprint").join(
        _ledger(processed), ["chat_key", "idx"], "full_outer"
    )
    stored = F.col("stored_fingerprint").isNotNull()
    visible = F.col("fingerprint").isNotNull()
    differs = F.col("fingerprint") != F.col("stored_fingerprint")
    if version is not None:
        differs = differs | (F.col("stored_version") != version)
    per_chat = both.groupBy("chat_key").agg(
        F.min(F.when(stored & (~visible | differs), F.col("idx"))).alias("d"),
        F.min(F.when(visible & ~stored, F.col("idx"))).alias("gap"),
        F.max(F.when(stored, F.col("idx"))).alias("last_stored"),
    )
    gap = F.when(F.col("gap") <= F.col("last_stored"), F.col("gap"))
    return per_chat.select("chat_key", F.least("d", gap).alias("earliest")).filter(
        F.col("earliest").isNotNull()
    )


def branch_divergence(
    messages: DataFrame, processed: DataFrame, ranges: DataFrame, version: int | None = V
) -> DataFrame:
    """Earliest disagreement and the position repair must restart from."""
    first = divergence(messages, processed, version)
    hit = (
        ranges.withColumn("end", _range_end(ranges))
        .join(first, "chat_key")
        .filter(F.col("end") >= F.col("earliest"))
        .groupBy("chat_key")
        .agg(F.min("range_from").alias("start"), F.count(F.lit(1)).alias("affected_ranges"))
    )
    return first.join(hit, "chat_key", "left").select(
        "chat_key",
        F.col("earliest").alias("earliest_index"),
        F.least("earliest", "start").alias("repair_from"),
        F.coalesce("affected_ranges", F.lit(0)).alias("affected_ranges"),
    )


def range_validity(ranges: DataFrame, messages: DataFrame) -> DataFrame:
    """Per range: changed (a source differs) and invalid (also missing or unproven) (C4)."""
    sources = ranges.select(
        "chat_key", "range_from", "range_to", F.explode_outer("message_fingerprints").alias("m")
    ).select(
        "chat_key", "range_from", "range_to",
        F.col("m.idx").alias("idx"), F.col("m.fingerprint").alias("saved"),
    )
    j = sources.join(messages.select("chat_key", "idx", "fingerprint"), ["chat_key", "idx"], "left")
    present = F.col("fingerprint").isNotNull()
    unproven = F.col("idx").isNull()
    return j.groupBy("chat_key", "range_from", "range_to").agg(
        F.bool_or(present & (F.col("fingerprint") != F.col("saved"))).alias("changed"),
        F.bool_or(
            unproven | ~present | (F.coalesce("fingerprint", F.lit("")) != F.col("saved"))
        ).alias("invalid"),
    )


def changed_ranges(ranges: DataFrame, messages: DataFrame) -> DataFrame:
    return range_validity(ranges, messages).filter("changed").drop("changed", "invalid")


def invalid_ranges(ranges: DataFrame, messages: DataFrame) -> DataFrame:
    return range_validity(ranges, messages).filter("invalid").drop("changed", "invalid")


# ---- import alignment ---------------------------------------------------------
def chat_identity(chat_key):
    """The part after ``:chat:``; empty when there is none."""
    return F.regexp_extract(X.as_col(chat_key), r":chat:(.*)$", 1)


def inspect_sources(memories: DataFrame, sources: DataFrame, messages: DataFrame) -> DataFrame:
    """Matched, changed and ahead counts of every source of every memory.

    ``memories(memory_id, current_chat)``, ``sources(memory_id, source_chat, idx,
    fingerprint)``, ``messages(chat_key, idx, fingerprint)``.
    """
    current = messages.select(
        F.col("chat_key").alias("current_chat"), "idx", F.col("fingerprint").alias("now")
    )
    rows = sources.join(memories.select("memory_id", "current_chat"), "memory_id").join(
        current, ["current_chat", "idx"], "left"
    )
    now = F.col("now")
    return (
        rows.groupBy("memory_id", "current_chat", "source_chat")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count(F.when(now == F.col("fingerprint"), 1)).alias("matched"),
            F.count(F.when(now != F.col("fingerprint"), 1)).alias("changed"),
            F.count(F.when(now.isNull(), 1)).alias("ahead"),
            F.max("idx").alias("last_processed_index"),
        )
        .withColumn("aligned", (F.col("changed") == 0) & (F.col("ahead") == 0))
    )


def align_memory(memories: DataFrame, sources: DataFrame, messages: DataFrame) -> DataFrame:
    """Verdict per memory and its destination chat.

    ``memories`` also holds has_data, continues_here (a continuation attached to
    the chat) and declares_current (the current chat is a known source).
    """
    found = inspect_sources(memories, sources, messages)
    target = chat_identity("current_chat")
    per = found.groupBy("memory_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.bool_and("aligned").alias("all_aligned"),
        F.bool_and((chat_identity("source_chat") == target) & (target != "")).alias("same_identity"),
        F.max("matched").alias("matched"),
        F.max("ahead").alias("ahead"),
        F.max("source_chat").alias("source_chat"),
    )
    n = F.coalesce("candidates", F.lit(0))
    verdict = (
        F.when((n == 0) & F.col("continues_here"), "continuation-baseline")
        .when((n == 0) & ~F.col("has_data"), "empty")
        .when(n == 0, "unverifiable")
        .when((n > 1) & F.col("all_aligned") & F.col("same_identity"), "aligned-source-aliases")
        .when(n > 1, "multiple-source-chats")
        .when(~F.col("all_aligned") & (F.col("ahead") > 0), "import-ahead")
        .when(~F.col("all_aligned"), "changed-or-branched")
        .when((F.col("source_chat") != F.col("current_chat")) & F.col("declares_current"), "ambiguous-source")
        .otherwise("aligned")
    )
    return memories.join(per, "memory_id", "left").select(
        "memory_id", "current_chat", n.alias("candidates"),
        F.coalesce("matched", F.lit(0)).alias("matched"), verdict.alias("verdict"),
    )


def rank_source_aliases(
    memories: DataFrame, sources: DataFrame, messages: DataFrame, processed_at: DataFrame | None = None
) -> DataFrame:
    """Sources of consolidatable memories with ``keep`` on the best one."""
    found = inspect_sources(memories, sources, messages)
    verdicts = align_memory(memories, sources, messages)
    found = found.join(
        verdicts.filter(F.col("verdict") == "aligned-source-aliases").select("memory_id"),
        "memory_id", "left_semi",
    )
    if processed_at is not None:
        found = found.join(processed_at, ["memory_id", "source_chat"], "left")
        at = F.coalesce("processed_at", F.lit(""))
    else:
        at = F.lit("")
    score = F.struct(
        F.col("records"), F.col("last_processed_index"),
        (F.col("source_chat") == F.col("current_chat")).alias("is_current"), at.alias("at"),
        F.col("source_chat"),
    )
    best = found.groupBy("memory_id").agg(F.max_by("source_chat", score).alias("kept"))
    return found.join(best, "memory_id").withColumn("keep", F.col("source_chat") == F.col("kept"))


def drop_sources(records: DataFrame, dropped: DataFrame) -> DataFrame:
    """Remove dropped chats from record provenance; records left with none go.

    ``records`` has memory_id and sources; ``dropped(memory_id, source_chat)``.
    """
    gone = dropped.groupBy("memory_id").agg(F.collect_set("source_chat").alias("gone"))
    kept = F.filter("sources", lambda s: ~F.array_contains(F.col("gone"), s["chat_key"]))
    joined = records.join(gone, "memory_id", "left")
    return (
        joined.withColumn(
            "sources", F.when(F.col("gone").isNull(), F.col("sources")).otherwise(kept)
        )
        .filter(F.size("sources") > 0)
        .drop("gone")
    )


# ---- branches -------------------------------------------------------------------
def reuse_branch_prefix(
    branches: DataFrame, branch_messages: DataFrame, parent_processed: DataFrame,
    parent_ranges: DataFrame, buffer: int = fixed.STABILITY_BUFFER,
) -> DataFrame:
    """How much of a parent's ranges each branch can keep (C20).

    ``branches(chat_key, parent_chat)``; ranges also hold ``replayable``.
    """
    from .groups import stability_repair_from

    def to_branch(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("chat_key", "parent_chat").join(branches, "parent_chat")

    ledger = to_branch(parent_processed)
    ranges = to_branch(parent_ranges)
    diverged = branch_divergence(branch_messages, ledger, ranges, version=None)
    rewind = stability_repair_from(branch_messages, ranges, buffer)
    base = (
        branches.join(diverged.select("chat_key", F.col("repair_from").alias("a")), "chat_key", "left")
        .join(rewind.select("chat_key", F.col("repair_from").alias("b")), "chat_key", "left")
        .select("chat_key", F.least("a", "b").alias("base"))
    )
    validity = range_validity(ranges, branch_messages)
    state = (
        ranges.select("chat_key", "range_from", "range_to", "replayable")
        .join(validity, ["chat_key", "range_from", "range_to"], "left")
        .join(base, "chat_key")
    )
    inside = F.col("base").isNull() | (F.col("range_to") < F.col("base"))
    bad = ~F.col("replayable") | F.coalesce("invalid", F.lit(True))
    cut = (
        state.groupBy("chat_key")
        .agg(F.min(F.when(inside & bad, F.col("range_from"))).alias("cut"), F.first("base").alias("base"))
        .select("chat_key", F.least("base", "cut").alias("repair_from"))
    )
    kept = (
        state.join(cut, "chat_key")
        .filter(F.col("repair_from").isNull() | (F.col("range_to") < F.col("repair_from")))
        .groupBy("chat_key")
        .agg(
            F.count(F.lit(1)).alias("retained"),
            F.sum(F.size(F.sequence("range_from", "range_to"))).alias("matched"),
        )
    )
    total = branch_messages.groupBy("chat_key").agg(F.count(F.lit(1)).alias("n"))
    return (
        cut.join(kept, "chat_key", "left").join(total, "chat_key")
        .select(
            "chat_key", "repair_from",
            F.coalesce("retained", F.lit(0)).alias("retained"),
            F.greatest(F.lit(0).cast("long"), F.col("n") - F.coalesce("matched", F.lit(0))).alias("pending"),
        )
    )


def map_prompt_messages(prompt: DataFrame, saved: DataFrame) -> DataFrame:
    """Align a filtered prompt with the saved chat by non-system ordinal."""
    p = with_position(prompt.filter(~F.col("is_system")), message_order(idx="position"), "ordinal")
    s = with_position(saved.filter(~F.col("is_system")), message_order(), "ordinal")
    return p.select(
        "chat_key", "ordinal", "position", F.col("text").alias("prompt_text")
    ).join(
        s.select("chat_key", "ordinal", "idx", F.col("name").alias("source_name"), F.col("text").alias("source_text")),
        ["chat_key", "ordinal"], "left",
    )


def preceding_user_context(ranges: DataFrame, messages: DataFrame) -> DataFrame:
    """User message just before a range that starts with another speaker."""
    looked = with_previous(
        messages, message_order(),
        {"prev_idx": F.col("idx"), "prev_name": F.col("name"), "prev_text": F.col("text"),
         "prev_user": F.col("is_user")},
    ).filter(~F.col("is_user") & F.col("prev_user") & (F.col("idx") > 0))
    starts = ranges.select("chat_key", "range_from", "range_to", F.col("range_from").alias("idx"))
    return starts.join(
        looked.select("chat_key", "idx", "prev_idx", "prev_name", "prev_text"), ["chat_key", "idx"]
    ).select(
        "chat_key", "range_from", "range_to",
        F.col("prev_idx").alias("context_idx"), F.col("prev_name").alias("context_name"),
        F.col("prev_text").alias("context_text"),
    )


def backlog(
    pending_counts: DataFrame, group_size: int = fixed.L1_GROUP_SIZE, required=None
) -> DataFrame:
    """Pending, complete and required counts with the catch-up flag.

    ``pending_counts(chat_key, pending[, required])``.
    """
    need = F.col("required") if "required" in pending_counts.columns else F.lit(required or 0)
    pending = F.col("pending")
    eligible = (F.floor(pending / group_size) * group_size).cast("long")
    return pending_counts.select(
        "chat_key", "pending", eligible.alias("eligible"), need.cast("long").alias("required"),
        F.when(need > 0, need.cast("long")).otherwise(eligible).alias("blocking"),
        ((need > 0) | (pending >= 2 * group_size)).alias("should_catch_up"),
    )
