"""Memory rebuilt from retained results, and chats and ranges taken out of it.

All categories of a memory go through one fold: their records become rows of one long
table (chat, category, identity, order, record), one aggregate keeps the newest record of
each identity, and only then the categories part again for the two rules that are not
"newest wins": scene states end with their range, and events that repeat themselves in
overlapping ranges count once. Records get the ids back that the memory held before, by
category and identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import hierarchy as H, merge as M
from .scale import write_through

#: categories whose records carry sources
SOURCED = ("entities", "facts", "states", "relationships", "events", "threads", "backgrounds")


def _identity(category: str) -> Column:
    """What makes two records of a category one; an event also by its range."""
    own = M.identity(category)
    return F.concat_ws("|", own, F.col("range_from").cast("string"), F.col("range_to").cast("string")) if category == "events" else own


def _long(category: str, records: DataFrame) -> DataFrame:
    """Rows ``(chat_key, category, identity, id, range_from, range_to, seq, corrected, record)``."""
    usable = records
    if category == "states":
        usable = records.filter((F.col("operation") == "clear") | (F.trim(F.coalesce("value", F.lit(""))) != ""))
    corrected = F.coalesce("corrected", F.lit(False)) if "corrected" in records.columns else F.lit(False)
    return usable.select(
        "chat_key", F.lit(category).alias("category"), _identity(category).alias("identity"), F.col("id").cast("string").alias("id"),
        F.col("range_from").cast("long").alias("range_from"), F.col("range_to").cast("long").alias("range_to"), F.col("seq").cast("long").alias("seq"),
        corrected.alias("corrected"), F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("record"))


def fold_results(results: dict[str, DataFrame], ranges: DataFrame) -> DataFrame:
    """Newest record of each identity over the retained ranges, all categories at once.

    ``results[category]`` holds the records of every extraction result with ``chat_key,
    id, range_from, range_to, seq``; only those of ``ranges`` count. The id is that of
    the oldest record (states keep that of the newest), a corrected record wins.
    """
    rows = None
    for category, records in results.items():
        part = _long(category, records)
        rows = part if rows is None else rows.unionByName(part)
    retained = ranges.select("chat_key", F.col("range_from").cast("long").alias("range_from"), F.col("range_to").cast("long").alias("range_to")).distinct()
    rows = rows.join(retained, ["chat_key", "range_from", "range_to"], "left_semi")
    newest = F.struct("corrected", "range_to", "seq")
    own_id = F.when(F.col("category") == "states", F.max_by("id", newest)).otherwise(F.min_by("id", F.struct("range_to", "seq")))
    return rows.groupBy("chat_key", "category", "identity").agg(
        own_id.alias("id"), F.max_by("record", newest).alias("record"), F.max("range_to").alias("last_range_to"), F.count(F.lit(1)).alias("merged"))


def previous_ids(memory: dict[str, DataFrame]) -> DataFrame:
    """``(chat_key, category, identity, old)``: ids a memory holds."""
    rows = None
    for category, records in memory.items():
        part = records.select("chat_key", F.lit(category).alias("category"), _identity(category).alias("identity"), F.col("id").cast("string").alias("old"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("chat_key", "category", "identity").agg(F.max("old").alias("old"))


def replay_memory(results: dict[str, DataFrame], ranges: DataFrame, previous: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The memory that retained ranges make, by category, with the ids it had before.

    ``ranges(chat_key, range_from, range_to[, allow_state_updates])``. Scene states live
    only in the newest range that may update states; a state whose last operation
    clears it is gone. Categories are those of ``results``.
    """
    folded = fold_results(results, ranges)
    if previous:
        folded = folded.join(previous_ids(previous), ["chat_key", "category", "identity"], "left").withColumn("id", F.coalesce("old", "id")).drop("old")
    folded = write_through(folded, "replayed")
    updating = ranges.filter("allow_state_updates") if "allow_state_updates" in ranges.columns else ranges
    newest = updating.groupBy("chat_key").agg(F.max("range_to").alias("__newest"))
    out = {}
    for category, records in results.items():
        rows = folded.filter(F.col("category") == category).withColumn("r", F.from_json("record", records.schema))
        own = [F.col("id") if c == "id" else F.col(f"r.`{c}`").alias(c) for c in records.columns if c != "chat_key"]
        rows = rows.select("chat_key", *own, "merged")
        if category == "states":
            rows = rows.join(newest, "chat_key").filter(
                (F.col("operation") == "set") & ((F.col("scope") == "ongoing") | (F.col("range_to") == F.col("__newest")))).drop("__newest")
        elif category == "events":
            rows = M.append_events(rows)
        out[category] = rows
    return out


def _cascade(memory: dict[str, DataFrame], dead: DataFrame) -> dict[str, DataFrame]:
    """Levels 2 and 3 without what rests on the ``dead(chat_key, id)`` level-1 rows."""
    out = {}
    if "l2" in memory:
        dead2 = H.invalidated_parents(memory["l2"], dead)
        out["l2"] = memory["l2"].join(dead2, ["chat_key", "id"], "left_anti")
        if "l3" in memory:
            dead3 = H.invalidated_parents(memory["l3"], dead2)
            out["l3"] = memory["l3"].join(dead3, ["chat_key", "id"], "left_anti")
    return out


def remove_ranges(memory: dict[str, DataFrame], ranges: DataFrame) -> dict[str, DataFrame]:
    """A memory without some ranges: sources go, records left without any go, levels cascade."""
    out = {c: M.strip_ranges(df, ranges) if c in SOURCED else df for c, df in memory.items()}
    if "l1" in memory:
        gone = ranges.select("chat_key", "range_from", "range_to").distinct()
        out["l1"] = memory["l1"].join(gone, ["chat_key", "range_from", "range_to"], "left_anti")
        dead = memory["l1"].join(gone, ["chat_key", "range_from", "range_to"], "left_semi").select("chat_key", "id")
        out |= _cascade(memory, dead)
    return out


def remove_chats(memory: dict[str, DataFrame], chats: DataFrame) -> dict[str, DataFrame]:
    """A memory without what some chats gave to it.

    Sources of those chats leave every record, whichever chat holds it; records left
    without a source, the chats' own level-1 to level-3 rows, extractions and stories,
    and the higher levels that rest on them go.
    """
    gone = chats.select("chat_key").distinct()
    out = {}
    for category, df in memory.items():
        if category in SOURCED:
            rows = df.select(F.col("chat_key").alias("owner"), "id", F.posexplode("sources").alias("pos", "s")).select("owner", "id", "pos", "s", F.col("s.chat_key").alias("chat_key"))
            kept = rows.join(gone, "chat_key", "left_anti").groupBy(F.col("owner").alias("chat_key"), "id").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("__s"))
            out[category] = df.join(kept, ["chat_key", "id"]).withColumn("sources", F.col("__s")).drop("__s")
        else:
            out[category] = df.join(gone, "chat_key", "left_anti")
    if "l1" in memory:
        dead = memory["l1"].join(gone, "chat_key", "left_semi").select("chat_key", "id")
        for level, df in _cascade(memory, dead).items():
            out[level] = df.join(gone, "chat_key", "left_anti")
    return out
