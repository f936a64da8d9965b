"""Narrative time: anchors, context, event order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed, text as X
from .scale import (
    Sequence, top_k, with_position, with_previous, with_running, with_running_sums, write_through,
)


def _frame_order() -> Sequence:
    return Sequence(("chat_key", "frame_key"), ("range_to", "range_from"), F.floor(F.col("range_to") / 65_536))


def previous_in_frame(l1: DataFrame) -> DataFrame:
    """Nearest earlier level-1 row of the same narrative frame.

    Level-1 ranges of a chat do not overlap, so the row before in (range_to)
    order is the nearest one that ends before this one starts.
    """
    keyed = l1.withColumn("frame_key", X.fold_key("frame"))
    return with_previous(
        keyed, _frame_order(), {"previous_id": F.col("id"), "previous_to": F.col("range_to")}
    ).drop("frame_key")


def temporal_anchors(l1: DataFrame) -> DataFrame:
    """Anchor of each level-1 row."""
    frame = F.when(X.normalize_text("frame") == "", fixed.MAIN_FRAME).otherwise(X.normalize_text("frame"))
    df = previous_in_frame(l1.withColumn("frame", frame).withColumn("id", X.anchor_id()))
    asked = F.when(F.col("relation").isin(*fixed.TIME_RELATIONS), F.col("relation")).otherwise("unknown")
    certainty = F.when(F.col("certainty").isin(*fixed.TIME_CERTAINTIES), F.col("certainty")).otherwise("unknown")
    has = F.col("previous_id").isNotNull()
    return df.withColumn(
        "temporal",
        F.struct(
            F.col("id").alias("anchor_id"), F.col("frame").alias("frame"),
            F.when(has | (asked == "detached"), asked).otherwise("unknown").alias("relation"),
            F.coalesce("previous_id", F.lit("")).alias("reference_id"),
            F.when(certainty == "explicit", X.normalize_text("elapsed")).otherwise("").alias("elapsed"),
            certainty.alias("certainty"),
        ),
    ).drop("previous_id", "previous_to", "frame", "relation", "elapsed", "certainty")


def temporal_context(l1: DataFrame, limit: int = 12, recent: int = 6) -> DataFrame:
    """Last six rows plus the newest of each frame, newest twelve kept."""
    keyed = l1.withColumn("frame_key", X.fold_key("frame"))
    newest = [F.col("range_to").desc(), F.col("range_from").desc()]
    cols = ["chat_key", "id", "range_from", "range_to", "frame_key"]
    last = top_k(keyed.select(*cols), ["chat_key"], newest, recent).drop("rank")
    per_frame = top_k(keyed.select(*cols), ["chat_key", "frame_key"], newest, 1).drop("rank")
    return top_k(last.unionByName(per_frame).distinct(), ["chat_key"], newest, limit)


def order_events(events: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Chronological position of each event.

    ``events(chat_key, id, range_from, range_to, created_at, date)`` with
    date = ``story_date_key`` (null when undated). Source order gives slots;
    undated events may be re-ordered among undated slots by their relations;
    dated events move only between slots held by the same date family.
    """
    seq = Sequence(
        ("chat_key",), ("range_from", "range_to", "created_at", "id"), F.floor(F.col("range_from") / 65_536)
    )
    family = F.coalesce(F.col("date.family"), F.lit(""))
    # the date key is costly text work: it is written once with the slot
    dated_events = write_through(events, "events")
    placed = write_through(with_position(dated_events, seq, "slot").withColumn("family", family), "slots")
    dated = placed.filter(F.col("family") != "")
    fam_slot = Sequence(("chat_key", "family"), ("slot",), F.floor(F.col("slot") / 65_536))
    slots = with_position(dated.select("chat_key", "family", "slot"), fam_slot, "nth")
    # one date value can hold very many events; the bucket is the date itself
    # split further by source slot, which keeps its order
    fam_date = Sequence(
        ("chat_key", "family"), ("value", "slot"),
        F.struct(F.col("value"), F.floor(F.col("slot") / 65_536)),
    )
    ranked = with_position(
        dated.withColumn("value", F.col("date.value")).withColumn("source_slot", F.col("slot")), fam_date, "nth"
    ).drop("slot", "value")
    moved = ranked.join(slots, ["chat_key", "family", "nth"]).withColumnRenamed("slot", "position")
    rest = placed.filter(F.col("family") == "").withColumn("source_slot", F.col("slot"))
    if anchors is not None:
        rest = order_undated(rest, anchors)
    else:
        rest = rest.withColumn("position", F.col("slot"))
    cols = ["chat_key", "id", "source_slot", "position"]
    return moved.select(*cols).unionByName(rest.select(*cols))


_FORWARD, _BACKWARD, _BOTH = ("after", "same-period", "overlaps"), ("before", "same-period", "overlaps"), ("same-period", "overlaps")


def frame_runs(anchors: DataFrame) -> DataFrame:
    """Labels that answer "does anchor A reach anchor B" without a closure.

    An anchor refers only to the previous one of its frame, so anchors form one
    path per frame. Between two breaks every link points forward (or both ways):
    inside such a run the earlier anchor reaches the later one. ``fwd`` and
    ``bwd`` name the runs, ``step`` counts the one-way links before the anchor.
    ``anchors(chat_key, id, frame_key, range_to, relation)``.
    """
    seq = Sequence(("chat_key", "frame_key"), ("range_to",), F.floor(F.col("range_to") / 65_536))

    def breaks(kinds):
        return F.when(F.coalesce(F.col("relation").isin(*kinds), F.lit(False)), 0).otherwise(1)

    return with_running_sums(
        anchors, seq, {"fwd": breaks(_FORWARD), "bwd": breaks(_BACKWARD), "step": breaks(_BOTH)}
    )


def order_undated(rest: DataFrame, anchors: DataFrame) -> DataFrame:
    """Re-order undated events by their relations, smallest source slot first.

    ``rest(chat_key, id, slot, reference_id, relation)``. An event is before,
    beside or after its anchor; event A precedes event B when A is before or
    beside its anchor, that anchor reaches B's, and B is after or beside; two
    events that precede each other have no order. Each event waits for its
    latest-placed predecessor: a running max over the run, no event pairs. The
    waits of one slot are resolved in the next round; ``path`` holds the slots
    waited for and its order is the final order.
    """
    runs = frame_runs(anchors).select(
        "chat_key", F.col("id").alias("reference_id"),
        F.concat_ws("|", "frame_key", F.col("fwd").cast("string")).alias("fwd"),
        F.concat_ws("|", "frame_key", F.col("bwd").cast("string")).alias("bwd"), "step",
    )
    side = (
        F.when(F.col("relation") == "before", 0).when(F.col("relation").isin(*_BOTH), 1)
        .when(F.col("relation") == "after", 2)
    )
    joined = rest.join(runs, ["chat_key", "reference_id"], "left").withColumn(
        "side", F.when(F.col("fwd").isNotNull(), side)
    )
    free = joined.filter(F.col("side").isNull()).withColumn("path", F.array("slot"))
    linked = joined.filter(F.col("side").isNotNull()).withColumn("path", F.array().cast("array<bigint>"))
    cols = [*rest.columns, "path"]
    done = free.select(*cols)
    open_rows = write_through(linked, "undated")
    leads = F.when(F.col("side") <= 1, F.col("slot"))
    # the last slot of each group of waits is always ready, so every round settles rows
    while True:
        rows = open_rows
        for run, key, out in (
            ("fwd", F.col("step") * 3 + F.col("side"), "__a"), ("bwd", -F.col("step") * 3 + F.col("side"), "__b"),
        ):
            rows = rows.withColumn("__key", key.cast("long"))
            seq = Sequence(("chat_key", "path", run), ("__key",), F.floor(F.col("__key") / 65_536))
            rows = with_running(rows, seq, leads, out, F.max, strict=True).drop("__key")
        waits = F.when(F.col("side") >= 1, F.greatest("__a", "__b"))
        rows = rows.withColumn("__ready", F.greatest("slot", F.coalesce(waits, F.col("slot"))))
        rows = write_through(
            rows.withColumn("path", F.concat("path", F.array("__ready"))).drop("__a", "__b"), "undated"
        )
        done = done.unionByName(rows.filter(F.col("__ready") == F.col("slot")).select(*cols))
        open_rows = rows.filter(F.col("__ready") != F.col("slot")).drop("__ready")
        if open_rows.isEmpty():
            break
    places = with_position(
        rest.select("chat_key", "slot"), Sequence(("chat_key",), ("slot",), F.floor(F.col("slot") / 65_536)), "nth"
    ).withColumnRenamed("slot", "position")
    ranked = with_position(
        done, Sequence(("chat_key",), ("path", "slot"), F.floor(F.col("path")[0] / 65_536)), "nth"
    )
    return ranked.join(places, ["chat_key", "nth"])
