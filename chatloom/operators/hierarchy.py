"""Level-2 and level-3 rows, cascades and retention (D7, G5, F7, D14 cascade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

#: turning points, open threads and sources of a parent row, for callers that want them bounded
LIMITS = {2: (8, 12, 50), 3: (12, 16, 100)}


def exact_text_key(value) -> Column:
    return F.regexp_replace(X.fold_key(value), "[.!?]+$", "")


def compact_fields(df: DataFrame, limits: tuple[int, int, int] | None = None) -> DataFrame:
    """Drop text repeated across the prose fields of one parent row.

    Fields are read in order summary, turning points, emotional arc, closing
    state, open threads; the first occurrence stays. First- and second-person
    sentences go first. ``limits`` (one of ``LIMITS``) bounds the lists; all items
    stay by default.
    """
    first = lambda items, n: items if limits is None else F.slice(items, 1, limits[n])
    clean = lambda c: X.third_person_only(c)

    def keys(items: Column) -> Column:
        return F.transform(items, exact_text_key)

    def fresh(items: Column, seen: Column) -> Column:
        kept = F.filter(items, lambda v: (exact_text_key(v) != "") & ~F.array_contains(seen, exact_text_key(v)))
        # first of equal texts inside the list
        return F.filter(
            kept, lambda v, i: ~F.array_contains(keys(F.slice(kept, 1, i)), exact_text_key(v))
        )

    def as_list(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), clean)

    df = df.withColumn("summary", F.coalesce(clean("summary"), F.lit("")))
    df = df.withColumn("__seen", keys(F.array("summary")))
    df = df.withColumn("turning_points", first(fresh(as_list("turning_points"), F.col("__seen")), 0))
    df = df.withColumn("__seen", F.concat("__seen", keys(F.col("turning_points"))))
    for field in ("emotional_arc", "closing_state"):
        value = F.coalesce(clean(field), F.lit(""))
        df = df.withColumn(
            field, F.when(F.array_contains(F.col("__seen"), exact_text_key(value)), "").otherwise(value)
        )
        df = df.withColumn("__seen", F.concat("__seen", keys(F.array(field))))
    df = df.withColumn("open_threads", first(fresh(as_list("open_threads"), F.col("__seen")), 1))
    return df.drop("__seen")


def rollup(children: DataFrame, level: int, limits: tuple[int, int, int] | None = None) -> DataFrame:
    """Parent row per complete group (D7); the id is a function of the child ids.

    ``children(chat_key, group_no, id, range_from, range_to, anchor_ids, frames,
    sources)``. Groups are bounded by the group size, so collecting child rows is
    safe. Running it again gives the same ids, so a re-run adds nothing. ``limits``
    keeps the last sources only.
    """
    rows = F.array_sort(
        F.collect_list(F.struct("range_from", "id", "range_to", "anchor_ids", "frames", "sources"))
    )
    g = children.groupBy("chat_key", "group_no").agg(rows.alias("c"))
    flat = lambda f: F.array_distinct(X.nonempty(F.flatten(F.col(f"c.{f}"))))
    sources = F.array_distinct(F.flatten(F.col("c.sources")))
    if limits is not None:
        sources = F.slice(sources, F.greatest(F.lit(1), F.size(sources) - (limits[2] - 1)), limits[2])
    return g.select(
        "chat_key", "group_no",
        F.concat(F.lit(f"L{level}-"), F.substring(F.md5(F.array_join("c.id", "|")), 1, 16)).alias("id"),
        F.col("c.id").alias("child_ids"),
        F.array_min("c.range_from").alias("range_from"), F.array_max("c.range_to").alias("range_to"),
        flat("anchor_ids").alias("anchor_ids"), flat("frames").alias("frames"),
        sources.alias("sources"),
    )


def with_summaries(parents: DataFrame, summaries: DataFrame, limits: tuple[int, int, int] | None = None) -> DataFrame:
    """Attach prose (summary, turning_points, ...) by chat and group, then compact it."""
    return compact_fields(parents.join(summaries, ["chat_key", "group_no"], "left"), limits)


def _links(parents: DataFrame) -> DataFrame:
    return parents.select("chat_key", F.col("id").alias("parent_id"), F.explode("child_ids").alias("id"))


def retained_parents(parents: DataFrame, surviving: DataFrame) -> DataFrame:
    """Parents whose every child still exists, and that have children."""
    missing = (
        _links(parents).join(surviving.select("chat_key", "id"), ["chat_key", "id"], "left_anti")
        .select("chat_key", F.col("parent_id").alias("id")).distinct()
    )
    return parents.filter(F.size("child_ids") > 0).join(missing, ["chat_key", "id"], "left_anti")


def invalidated_parents(parents: DataFrame, affected: DataFrame) -> DataFrame:
    """Ids of parents that hold an affected child."""
    return (
        _links(parents).join(affected.select("chat_key", "id").distinct(), ["chat_key", "id"], "left_semi")
        .select("chat_key", F.col("parent_id").alias("id")).distinct()
    )


def cascade(affected_l1: DataFrame, l2: DataFrame, l3: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level-2 and level-3 ids dropped because of affected level-1 rows (A.9).

    ``l3`` may also hold ``l1_ids``; a level-3 row naming an affected level-1
    row goes too.
    """
    dead2 = invalidated_parents(l2, affected_l1)
    dead3 = invalidated_parents(l3, dead2)
    if "l1_ids" in l3.columns:
        direct = invalidated_parents(l3.withColumn("child_ids", F.col("l1_ids")), affected_l1)
        dead3 = dead3.unionByName(direct).distinct()
    return dead2, dead3


def hierarchy_exclusion(candidates: DataFrame, selected_parents: DataFrame, keys: list[str]) -> DataFrame:
    """Drop candidates covered by a selected parent of the same query."""
    covered = selected_parents.select(*keys, F.explode("child_ids").alias("id")).distinct()
    return candidates.join(covered, [*keys, "id"], "left_anti")
