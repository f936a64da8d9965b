"""Grouping operators: level-1 groups, buffers, chunks, tails, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as X
from .scale import message_order, top_k, with_position, with_running_sum, with_running_sums


def group_size(value: int | None) -> int:
    size = round(value or fixed.L1_GROUP_SIZE)
    return min(fixed.L1_GROUP_MAX, max(fixed.L1_GROUP_MIN, size))


def l1_groups(pending: DataFrame, n: int = fixed.L1_GROUP_SIZE, bootstrap: bool = False) -> DataFrame:
    """Complete groups of ``n`` consecutive pending messages.

    ``bootstrap`` takes only the newest ``n`` messages of each chat.
    """
    n = group_size(n)
    if bootstrap:
        newest = top_k(pending.select("chat_key", "idx"), ["chat_key"], [F.col("idx").desc()], n)
        grouped = newest.groupBy("chat_key").agg(
            F.count(F.lit(1)).alias("size"), F.min("idx").alias("range_from"), F.max("idx").alias("range_to")
        )
        return grouped.filter(F.col("size") == n).select(
            "chat_key", F.lit(0).cast("long").alias("group_no"), "range_from", "range_to", "size"
        )
    placed = with_position(pending.select("chat_key", "idx"), message_order(), "rn")
    return (
        placed.groupBy("chat_key", F.floor((F.col("rn") - 1) / n).alias("group_no"))
        .agg(
            F.min("idx").alias("range_from"), F.max("idx").alias("range_to"),
            F.count(F.lit(1)).alias("size"),
        )
        .filter(F.col("size") == n)
    )


def buffered_messages(eligible: DataFrame, k: int = fixed.STABILITY_BUFFER) -> DataFrame:
    """Newest ``k`` eligible positions of each chat; they are protected."""
    return top_k(eligible.select("chat_key", "idx"), ["chat_key"], [F.col("idx").desc()], k).drop("rank")


def stable_messages(eligible: DataFrame, k: int = fixed.STABILITY_BUFFER) -> DataFrame:
    return eligible.join(buffered_messages(eligible, k), ["chat_key", "idx"], "left_anti")


def stability_repair_from(
    eligible: DataFrame, ranges: DataFrame, k: int = fixed.STABILITY_BUFFER
) -> DataFrame:
    """Smallest start of a range that holds a protected message."""
    protected = buffered_messages(eligible, k).groupBy("chat_key").agg(
        F.sort_array(F.collect_list("idx")).alias("protected")  # at most k positions
    )
    j = ranges.join(protected, "chat_key")
    inside = F.exists("protected", lambda i: (i >= F.col("range_from")) & (i <= F.col("range_to")))
    if "message_fingerprints" in ranges.columns:
        stored = F.transform("message_fingerprints", lambda m: m["idx"])
        inside = inside | F.arrays_overlap(stored, F.col("protected"))
    return j.filter(inside).groupBy("chat_key").agg(F.min("range_from").alias("repair_from"))


def message_tokens(messages: DataFrame) -> DataFrame:
    return messages.withColumn(
        "tokens", F.greatest(F.lit(1).cast("long"), X.estimate_tokens(F.concat_ws(": ", "name", "text")))
    )


def token_chunks(
    messages: DataFrame, limit: int, max_n: int | None = None, keys: tuple[str, ...] = ("chat_key", "range_from")
) -> DataFrame:
    """Greedy chunks inside each queued range.

    A new chunk starts when the tokens would pass ``limit``, the count would
    pass ``max_n``, or positions jump. The rule is sequential, so it folds over
    the (position, tokens) pairs of ONE range; texts are never collected.
    """
    pairs = messages.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("idx", "tokens"))).alias("m")
    )
    most = F.lit(max_n if max_n is not None else 2**31 - 1)
    none = F.array().cast("array<struct<f:bigint,t:bigint,tok:bigint,n:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = (
            (F.size(acc) == 0)
            | (last["tok"] + x["tokens"] > limit)
            | (last["n"] + 1 > most)
            | (x["idx"] > last["t"] + 1)
        )
        fresh = F.struct(
            x["idx"].cast("long").alias("f"), x["idx"].cast("long").alias("t"),
            x["tokens"].cast("long").alias("tok"), F.lit(1).alias("n"),
        )
        grown = F.struct(
            last["f"].alias("f"), x["idx"].cast("long").alias("t"),
            (last["tok"] + x["tokens"]).cast("long").alias("tok"), (last["n"] + 1).alias("n"),
        )
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(new, F.concat(acc, F.array(fresh))).otherwise(F.concat(head, F.array(grown)))

    return (
        pairs.select(*keys, F.posexplode(F.aggregate("m", none, step)).alias("chunk_no", "c"))
        .select(
            *keys, "chunk_no", F.col("c.f").alias("chunk_from"), F.col("c.t").alias("chunk_to"),
            F.col("c.tok").alias("tokens"), F.col("c.n").alias("n"),
        )
    )


def balanced_split(messages: DataFrame, keys: tuple[str, ...] = ("chat_key", "range_from")) -> DataFrame:
    """First position of the second half, by tokens closest to half.

    ``messages`` carries the key of the range to split; ranges are bounded.
    """
    seq = message_order("range_key")
    keyed = messages.withColumn("range_key", F.struct(*keys))
    run = with_running_sum(keyed, seq, F.col("tokens"), "running")
    total = messages.groupBy(*keys).agg(F.sum("tokens").alias("total"), F.min("idx").alias("first"))
    scored = run.join(total, list(keys)).filter(F.col("idx") > F.col("first"))
    before = F.col("running") - F.col("tokens")
    gap = F.abs(F.col("total") - 2 * before)
    return scored.groupBy(*keys).agg(F.min_by("idx", F.struct(gap.alias("gap"), F.col("idx"))).alias("split_at"))


def raw_tail(
    messages: DataFrame, budget: int, minimum: int = 4, maximum: int | None = None
) -> DataFrame:
    """Newest messages that fit the budget, at least ``minimum`` (E5).

    The tail ends at the first message that does not fit; smaller older ones do
    not slip in behind it.
    """
    seq = message_order()
    run = with_running_sums(messages, seq, {"running": F.col("tokens"), "back": F.lit(1)}, descending=True)
    over = (F.col("back") > minimum) & (F.col("running") > budget)
    if maximum is not None:
        over = over | (F.col("back") > maximum)
    first_over = run.groupBy("chat_key").agg(F.min(F.when(over, F.col("back"))).alias("stop"))
    tail = run.join(first_over, "chat_key").filter(
        F.col("stop").isNull() | (F.col("back") < F.col("stop"))
    )
    return tail.drop("stop", "running", "back")


def hidden_messages(messages: DataFrame, tail: DataFrame, processed: DataFrame, version: int) -> DataFrame:
    """Messages before the tail that the ledger covers with the same fingerprint."""
    covered = processed.filter(F.col("version") == version).select("chat_key", "idx", "fingerprint")
    return (
        messages.join(tail.select("chat_key", "idx"), ["chat_key", "idx"], "left_anti")
        .join(covered, ["chat_key", "idx", "fingerprint"], "left_semi")
    )


def tail_summary(messages, processed, budget: int, version: int, minimum: int = 4) -> DataFrame:
    """Tail range and hidden counts per chat."""
    tail = raw_tail(messages, budget, minimum)
    t = tail.groupBy("chat_key").agg(
        F.min("idx").alias("tail_from"), F.max("idx").alias("tail_to"), F.sum("tokens").alias("tail_tokens"),
        F.count(F.lit(1)).alias("tail_messages"),
    )
    h = hidden_messages(messages, tail, processed, version).groupBy("chat_key").agg(
        F.count(F.lit(1)).alias("hidden_messages"), F.sum("tokens").alias("hidden_tokens")
    )
    return t.join(h, "chat_key", "left").fillna(0, ["hidden_messages", "hidden_tokens"])


def parent_groups(
    children: DataFrame, covered: DataFrame, size: int, start: int | None = None, keep_recent: bool = False
) -> DataFrame:
    """All complete groups of ungrouped children in order.

    ``children(chat_key, id, range_from, range_to)``, ``covered(chat_key, id)``.
    Level 3 passes ``start`` (least number of children in the chat) and
    ``keep_recent`` (one newest group always stays ungrouped).
    """
    free = children.join(covered, ["chat_key", "id"], "left_anti")
    placed = with_position(free, message_order(idx="range_from"), "rn")
    sized = children.groupBy("chat_key").agg(F.count(F.lit(1)).alias("all_children"))
    open_n = free.groupBy("chat_key").agg(F.count(F.lit(1)).alias("open_children"))
    usable = F.floor(F.col("open_children") / size)
    if keep_recent:
        usable = usable - 1
    placed = placed.join(open_n, "chat_key").withColumn(
        "group_no", F.floor((F.col("rn") - 1) / size)
    ).filter(F.col("group_no") < usable)
    if start is not None:
        placed = placed.join(sized, "chat_key").filter(F.col("all_children") >= start).drop("all_children")
    return placed.drop("open_children")


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Highest revision per memory, then the latest update."""
    order = F.struct("revision", "updated_at", "snapshot_id")
    return snapshots.groupBy("memory_id").agg(
        F.max_by(F.struct("snapshot_id", "revision"), order).alias("s")
    ).select("memory_id", F.col("s.snapshot_id").alias("snapshot_id"), F.col("s.revision").alias("revision"))
