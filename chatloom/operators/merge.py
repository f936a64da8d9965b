"""Survivorship, provenance and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from .hierarchy import cascade
from .overlap import range_overlap_join
from .records import is_address, type_family
from .scale import Sequence, latest_by, top_k, with_previous, with_running, with_running_sum, write_through


# ---- identity ---------------------------------------------------------------------
def pair_key(a="endpoint_a", b="endpoint_b") -> Column:
    """Unordered key of two folded endpoints (C14)."""
    return F.array_join(F.array_sort(F.array(X.fold_key(a), X.fold_key(b))), "|")


def addressee(predicate="predicate") -> Column:
    return X.fold_key(
        F.regexp_extract(X.fold_key(predicate), r"^(?:calls|form of address for)\s+(.+?)\s*[.!?]?$", 1)
    )


def identity(category: str) -> Column:
    """Merge identity of a record (A.1)."""
    fold = X.fold_key
    bar = F.lit("|")
    if category == "entities":
        return fold("name")
    if category == "facts":
        plain = F.concat(fold("subject"), bar, fold("predicate"), bar, fold("category"))
        address = F.concat(F.lit("address|"), fold("subject"), bar, addressee())
        return F.when(is_address() & (addressee() != ""), address).otherwise(plain)
    if category == "states":
        return F.concat(fold("subject"), bar, F.lower(X.canonical_attribute("attribute")))
    if category == "relationships":
        return pair_key()
    if category == "events":
        return F.concat(fold("title"), bar, fold("summary"))
    if category == "threads":
        return fold("title")
    if category == "backgrounds":
        return fold("topic")
    if category in ("l1", "extractions"):
        return F.concat_ws("|", "chat_key", F.col("range_from").cast("string"), F.col("range_to").cast("string"))
    if category in ("l2", "l3"):
        return F.array_join("child_ids", "|")
    raise ValueError(f"no identity for {category}")


def endpoint_conflicts(relationships: DataFrame) -> DataFrame:
    """Relationships whose endpoints are the same entity (C14)."""
    # both names in one array: an equation of the two would become a join key behind a join,
    # and a sort by it folds texts again at every comparison
    names = F.array(X.fold_key("endpoint_a"), X.fold_key("endpoint_b"))
    return relationships.filter(F.size(F.array_distinct(names)) == 1)


# ---- D1, D2 -----------------------------------------------------------------------
def merge_records(
    records: DataFrame, keys: list[str], fields: list[str], importance: str = "latest", unions: tuple[str, ...] = ()
) -> DataFrame:
    """One row per identity (D1): newest range wins, corrected rows win over all.

    ``id`` and ``created_seq`` come from the oldest row. Everything is a
    max_by/min_by aggregate, so a hot identity is combined before the shuffle.
    A backfill row (allow_state_updates false) loses to a row with a later range,
    which the order by range already says.
    """
    corrected = F.col("corrected") if "corrected" in records.columns else F.lit(False)
    newest = F.struct(corrected.alias("c"), F.col("range_to"), F.col("seq"))
    oldest = F.struct(F.col("range_to"), F.col("seq"))
    row = F.struct(*fields)
    aggs = [
        F.min_by("id", oldest).alias("id"),
        F.max_by(row, newest).alias("__row"),
        F.count(F.lit(1)).alias("merged"),
        F.max("range_to").alias("last_range_to"),
    ]
    if importance == "max":
        aggs.append(F.max("importance").alias("__importance"))
    for u in unions:
        aggs.append(F.array_distinct(F.flatten(F.collect_set(u))).alias(f"__{u}"))
    out = records.groupBy(*keys).agg(*aggs)
    cols = [*keys, "id", "merged", "last_range_to"]
    picked = []
    for f in fields:
        if f == "importance" and importance == "max":
            picked.append(F.col("__importance").alias("importance"))
        elif f in unions:
            picked.append(F.array_sort(f"__{f}").alias(f))
        else:
            picked.append(F.col("__row")[f].alias(f))
    return out.select(*cols, *picked)


def union_sources(records: DataFrame, keys: list[str], keep: int | None = None, order: str = "seq") -> DataFrame:
    """Distinct source ranges per identity, all or the last ``keep`` first-seen ones.

    Distinct (and top-k, with ``keep``) run before any list is built, so an identity
    collects one entry for each of its ranges at most.
    """
    distinct = records.groupBy(*keys, "source_chat", "range_from", "range_to").agg(F.min(order).alias("seen"))
    newest = distinct if keep is None else top_k(
        distinct, keys,
        [F.col("seen").desc(), F.col("range_to").desc(), F.col("range_from").desc(), F.col("source_chat").desc()],
        keep,
    )
    return newest.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seen", "range_to", "range_from", "source_chat"))),
            lambda s: F.struct(s["source_chat"].alias("chat_key"), s["range_from"].alias("range_from"), s["range_to"].alias("range_to")),
        ).alias("sources")
    )


# ---- D5 ---------------------------------------------------------------------------
def append_events(events: DataFrame) -> DataFrame:
    """Immutable events: drop one that repeats a kept row of an overlapping range.

    Rows of one signature are cut into islands of touching ranges with a running
    max; only inside an island is the greedy rule sequential, and there it folds
    over distinct ranges.
    """
    keyed = events.withColumn("signature", identity("events"))
    first = keyed.groupBy("chat_key", "signature", "range_from", "range_to").agg(
        F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq")
    )
    seq = Sequence(
        ("chat_key", "signature"), ("range_from", "range_to", "seq"), F.floor(F.col("range_from") / 65_536)
    )
    first = write_through(first, "signatures")
    reach = write_through(with_running(first, seq, F.col("range_to"), "reach", F.max), "reach")
    before = write_through(with_previous(reach, seq, {"before": F.col("reach")}), "before")
    island = with_running_sum(
        before, seq, F.when(F.col("before").isNull() | (F.col("range_from") > F.col("before")), 1).otherwise(0), "island"
    )
    rows = island.groupBy("chat_key", "signature", "island").agg(
        F.array_sort(F.collect_list(F.struct("range_from", "range_to", "seq", "id"))).alias("rows")
    )
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<string>").alias("kept"))
    folded = F.aggregate(
        "rows", start,
        lambda acc, r: F.when(
            r["range_from"] > acc["end"],
            F.struct(r["range_to"].cast("long").alias("end"), F.concat(acc["kept"], F.array(r["id"])).alias("kept")),
        ).otherwise(acc),
    )
    kept = rows.select("chat_key", F.explode(folded["kept"]).alias("id"))
    return events.join(kept, ["chat_key", "id"], "left_semi")


# ---- C13, C18 -----------------------------------------------------------------------
def target_compatibility(incoming: DataFrame, stored: DataFrame, category: str) -> DataFrame:
    """Verdict on each target id: none, unknown (blanked), kept or rejected."""
    s = stored.withColumn("s_identity", identity(category)).select(
        "chat_key", F.col("id").alias("target_id"), "s_identity",
        *([type_family("type").alias("s_family")] if category == "entities" else []),
    )
    j = incoming.withColumn("i_identity", identity(category)).join(s, ["chat_key", "target_id"], "left")
    same = F.col("s_identity") == F.col("i_identity")
    if category == "entities":
        mine = type_family("type")
        same = same & ((mine == "") | (F.col("s_family") == "") | (mine == F.col("s_family")))
    wanted = F.coalesce("target_id", F.lit("")) != ""
    verdict = (
        F.when(~wanted, "none").when(F.col("s_identity").isNull(), "unknown").when(same, "kept").otherwise("rejected")
    )
    return j.withColumn("verdict", verdict).drop("s_identity", "i_identity", "s_family")


def correction_selector(category: str) -> Column:
    fold, bar = X.fold_key, F.lit("|")
    if category == "relationships":
        return F.concat(fold("endpoint_a"), bar, fold("endpoint_b"), bar, fold("kind"))
    if category == "events":
        return F.concat(fold("title"), bar, fold("summary"))
    if category == "states":
        return F.concat(fold("subject"), bar, fold("attribute"))
    return identity(category)


def suppress_corrected(incoming: DataFrame, operations: DataFrame, category: str) -> DataFrame:
    """Drop incoming records equal to the state before an update or delete."""
    blocked = (
        operations.filter((F.col("category") == category) & F.col("action").isin("update", "delete"))
        .select("chat_key", F.col("before_selector").alias("__sel")).distinct()
    )
    keyed = incoming.withColumn("__sel", correction_selector(category))
    kept = keyed.join(blocked, ["chat_key", "__sel"], "left_anti")
    if category == "facts":
        short = F.concat(X.fold_key("subject"), F.lit("|"), X.fold_key("predicate"))
        kept = kept.withColumn("__sel", F.when(~is_address(), short)).join(blocked, ["chat_key", "__sel"], "left_anti")
    return kept.drop("__sel")


# ---- D6 ---------------------------------------------------------------------------
def apply_record_merges(records: DataFrame, merges: DataFrame, participants: int | None = None) -> DataFrame:
    """Explicit merges (D6): (chat_key, canonical_id, duplicate_ids).

    A request with a missing, incompatible (``kind``) or corrected member is
    refused whole. Accepted duplicates go; their sources and participants join
    the canonical row (``participants`` keeps the first of them); ``absorbed``
    counts them.
    """
    asked = merges.select("chat_key", "canonical_id", F.explode(F.array_distinct("duplicate_ids")).alias("id"))
    asked = asked.filter(F.col("id") != F.col("canonical_id"))
    info = records.select("chat_key", "id", "kind", "corrected")
    canon = info.select("chat_key", F.col("id").alias("canonical_id"), F.col("kind").alias("c_kind"), F.col("corrected").alias("c_corrected"))
    j = asked.join(info, ["chat_key", "id"], "left").join(canon, ["chat_key", "canonical_id"], "left")
    fine = (
        F.col("kind").isNotNull() & F.col("c_kind").isNotNull() & (F.col("kind") == F.col("c_kind"))
        & ~F.coalesce("corrected", F.lit(True)) & ~F.coalesce("c_corrected", F.lit(True))
    )
    accepted = j.groupBy("chat_key", "canonical_id").agg(F.bool_and(fine).alias("ok")).filter("ok")
    pairs = asked.join(accepted.select("chat_key", "canonical_id"), ["chat_key", "canonical_id"], "left_semi")
    gained = (
        records.select("chat_key", "id", "sources", "participants").join(pairs, ["chat_key", "id"])
        .groupBy("chat_key", F.col("canonical_id").alias("id"))
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("__s"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("participants")))).alias("__p"),
            F.count(F.lit(1)).alias("absorbed"),
        )
    )
    kept = records.join(pairs.select("chat_key", "id").distinct(), ["chat_key", "id"], "left_anti")
    none_s, none_p = F.array().cast(records.schema["sources"].dataType), F.array().cast("array<string>")
    people = F.array_distinct(F.concat("participants", F.coalesce("__p", none_p)))
    return kept.join(gained, ["chat_key", "id"], "left").select(
        *[c for c in records.columns if c not in ("sources", "participants")],
        F.array_distinct(F.concat("sources", F.coalesce("__s", none_s))).alias("sources"),
        (people if participants is None else F.slice(people, 1, participants)).alias("participants"),
        F.coalesce("absorbed", F.lit(0)).alias("absorbed"),
    )


# ---- D14, C36 ---------------------------------------------------------------------
def apply_corrections(records: DataFrame, operations: DataFrame) -> DataFrame:
    """Add, update and delete by id with an authoritative mark.

    ``records(chat_key, category, id, body, correction_id)``;
    ``operations(correction_id, chat_key, category, action, target_id, body, applied_seq)``.
    The last operation on an id decides.
    """
    last = latest_by(
        operations.filter(F.col("action") != "add").select(
            "chat_key", "category", F.col("target_id").alias("id"), F.col("action").alias("o_action"),
            F.col("body").alias("o_body"), F.col("correction_id").alias("o_cid"), "applied_seq",
        ),
        ["chat_key", "category", "id"], F.col("applied_seq"),
    )
    changed = records.join(last, ["chat_key", "category", "id"], "left").filter(
        F.col("o_action").isNull() | (F.col("o_action") != "delete")
    )
    updated = changed.select(
        "chat_key", "category", "id",
        F.when(F.col("o_action") == "update", F.col("o_body")).otherwise(F.col("body")).alias("body"),
        F.coalesce("o_cid", "correction_id").alias("correction_id"),
    )
    added = operations.filter(F.col("action") == "add").select(
        "chat_key", "category",
        F.concat(F.substring("category", 1, 1), F.lit("-"), "correction_id", F.lit("-"), F.col("applied_seq").cast("string")).alias("id"),
        "body", "correction_id",
    )
    return updated.unionByName(added)


def correction_cascade(
    operations: DataFrame, record_ranges: DataFrame, l1: DataFrame, l2: DataFrame, l3: DataFrame
):
    """Level-1 rows touched by corrections and the parents they invalidate.

    ``record_ranges(chat_key, category, id, range_from, range_to)``.
    """
    touched = record_ranges.join(
        operations.select("chat_key", "category", F.col("target_id").alias("id")).distinct(),
        ["chat_key", "category", "id"], "left_semi",
    ).select("chat_key", "range_from", "range_to").distinct()
    hit = range_overlap_join(l1.select("chat_key", "id", "range_from", "range_to"), touched)
    affected = hit.select("chat_key", "id").distinct()
    return affected, *cascade(affected, l2, l3)


def nearest_l1_for_event(events: DataFrame, l1: DataFrame, threshold: int = 12) -> DataFrame:
    """Best level-1 row per event (C36): participant 12, location 10, time word 4, word 1.

    Both sides: chat_key, id, participants, location, time_words, words. A score
    of 12 needs a shared participant, location or time word, or twelve words, so
    one typed inverted index gives every candidate.
    """
    def features(df: DataFrame, id_as: str) -> DataFrame:
        def typed(kind: str, weight: int, values: Column) -> Column:
            return F.transform(
                F.array_distinct(X.nonempty(values)),
                lambda v: F.struct(F.concat(F.lit(kind), X.fold_key(v)).alias("t"), F.lit(weight).alias("w")),
            )

        return df.select(
            "chat_key", F.col("id").alias(id_as),
            F.explode(F.concat(
                typed("p:", 12, F.col("participants")), typed("l:", 10, F.array("location")),
                typed("t:", 4, F.col("time_words")), typed("w:", 1, F.col("words")),
            )).alias("f"),
        ).select("chat_key", id_as, F.col("f.t").alias("t"), F.col("f.w").alias("w"))

    e, c = features(events, "event_id"), features(l1, "l1_id").drop("w")
    scored = e.join(c, ["chat_key", "t"]).groupBy("chat_key", "event_id", "l1_id").agg(F.sum("w").alias("score"))
    best = scored.groupBy("chat_key", "event_id").agg(
        F.max_by("l1_id", F.struct("score", "l1_id")).alias("l1_id"), F.max("score").alias("score")
    ).filter(F.col("score") >= threshold)
    return events.select("chat_key", F.col("id").alias("event_id")).join(best, ["chat_key", "event_id"], "left")


def event_chronology(events: DataFrame, nearest: DataFrame, l1: DataFrame, keep: int | None = None) -> DataFrame:
    """Level-1 rows that added events change or make (C36), with their ``action``.

    ``events(chat_key, id, title, summary, consequences, story_time, location,
    participants, importance)``, ``nearest(chat_key, event_id, l1_id)`` of
    ``nearest_l1_for_event``. The nearest row takes the event's line as a beat and
    its consequence into the closing, unless it tells them already; ``keep``
    bounds the beats to the last ones. An event without one makes a row of its own.
    """
    blank = lambda c: X.normalize_text(F.coalesce(c, F.lit("")))
    summary, consequence = blank("summary"), blank("consequences")
    told = events.withColumn("__line", F.when(summary != "", summary).otherwise(blank("title"))).withColumn("__outcome", consequence)
    told = told.join(nearest.select("chat_key", F.col("event_id").alias("id"), "l1_id"), ["chat_key", "id"], "left")

    near = told.filter("l1_id IS NOT NULL").select("chat_key", F.col("l1_id").alias("id"), F.col("id").alias("event"), "__line", "__outcome")
    if keep is not None:  # no more than the last events of a row can leave a trace then
        near = top_k(near, ["chat_key", "id"], [F.col("event").desc()], keep)
    last = near.groupBy("chat_key", "id").agg(
        F.array_sort(F.collect_list(F.struct("event", "__line", "__outcome"))).alias("__told"))
    has = lambda text, part: F.contains(X.fold_key(text), X.fold_key(part))
    lines = F.filter(F.array_distinct(F.col("__told.__line")), lambda v: (v != "") & ~F.exists("beats", lambda b: has(b, v)))
    outcomes = F.filter(F.array_distinct(F.col("__told.__outcome")), lambda v: (v != "") & ~has(blank("closing"), v))
    beats = F.concat("beats", lines)
    changed = l1.join(last, ["chat_key", "id"]).withColumns({
        "beats": beats if keep is None else F.slice(beats, F.greatest(F.lit(1), F.size(beats) - (keep - 1)), keep),
        "closing": F.trim(F.concat_ws(" ", blank("closing"), F.array_join(outcomes, " "))),
    })
    shape = ["chat_key", "id", "title", "story_time", "location", "participants", "opening", "beats", "emotional_arc", "closing", "importance"]
    made = told.filter("l1_id IS NULL").select(
        "chat_key", F.concat(F.lit("L1-"), F.substring(F.md5(F.concat_ws("|", "chat_key", F.col("id").cast("string"))), 1, 16)).alias("id"),
        "title", "story_time", "location", "participants", F.col("__line").alias("opening"),
        X.nonempty(F.array("__line", "__outcome")).alias("beats"), F.lit("").alias("emotional_arc"), F.col("__outcome").alias("closing"), "importance")
    return changed.select(F.lit("update").alias("action"), *shape).unionByName(made.select(F.lit("add").alias("action"), *shape))


# ---- D15, D16, C35, D17 -------------------------------------------------------------
def strip_ranges(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """Remove the contribution of some ranges; rows left without a source go.

    ``records`` carries sources array<struct<chat_key, range_from, range_to>>.
    Works on exploded sources, so no per-chat list of ranges is built.
    """
    gone = ranges.select("chat_key", "range_from", "range_to").distinct()
    rows = records.select("chat_key", "id", F.posexplode("sources").alias("pos", "s"))
    hit = rows.select(
        F.col("chat_key").alias("owner"), "id", "pos", F.col("s.chat_key").alias("chat_key"),
        F.col("s.range_from").alias("range_from"), F.col("s.range_to").alias("range_to"),
    ).join(gone, ["chat_key", "range_from", "range_to"], "left_anti")
    kept = hit.groupBy("owner", "id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "chat_key", "range_from", "range_to"))).alias("k")
    ).select(
        F.col("owner").alias("chat_key"), "id",
        F.transform("k", lambda s: F.struct(s["chat_key"].alias("chat_key"), s["range_from"].alias("range_from"), s["range_to"].alias("range_to"))).alias("__s"),
    )
    return records.join(kept, ["chat_key", "id"]).withColumn("sources", F.col("__s")).drop("__s")


def undo_latest(ranges: DataFrame) -> DataFrame:
    """Latest range per chat and the message span it frees again."""
    order = F.struct("range_from", "range_to")
    return ranges.groupBy("chat_key").agg(
        F.max(order).alias("m"), F.count(F.lit(1)).alias("n")
    ).select(
        "chat_key", F.col("m.range_from").alias("range_from"), F.col("m.range_to").alias("range_to"),
        (F.col("n") - 1).alias("retained_l1"),
    )


def replay(records: DataFrame, ranges: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rebuild merged rows from the records of retained ranges.

    The fold over ranges is one ordered aggregate; unchanged identities keep
    their ids through ``restore_replay_ids``.
    """
    retained = ranges.select("chat_key", "range_from", "range_to").distinct()
    return merge_records(records.join(retained, ["chat_key", "range_from", "range_to"], "left_semi"), keys, fields)


def restore_replay_ids(replayed: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Give replayed rows the id they had before, by identity."""
    old = previous.select(*keys, F.col("id").alias("__old")).groupBy(*keys).agg(F.max("__old").alias("__old"))
    return replayed.join(old, keys, "left").withColumn("id", F.coalesce("__old", "id")).drop("__old")


def reset_audit(counts: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Categories that still hold rows after a reset.

    ``counts(chat_key, category, id, correction_id)``; rows of a listed
    correction do not count.
    """
    rows = counts
    if corrections is not None:
        rows = rows.join(
            corrections.select("chat_key", F.col("id").alias("correction_id")), ["chat_key", "correction_id"], "left_anti"
        )
    return rows.groupBy("chat_key", "category").agg(F.count(F.lit(1)).alias("residual"))


def memory_counts(records: DataFrame) -> DataFrame:
    """Record counts per chat, per category and in all (D9) with grouping sets.

    ``records(chat_key, category)``; a partial count per (chat, category) keeps
    the expansion small.
    """
    base = records.groupBy("chat_key", "category").agg(F.count(F.lit(1)).alias("n"))

    grouped = base.groupingSets(
        [[F.col("chat_key"), F.col("category")], [F.col("chat_key")], [F.col("category")], []],
        F.col("chat_key"), F.col("category"),
    )
    return grouped.agg(F.sum("n").alias("records"), F.grouping_id().alias("level"))
