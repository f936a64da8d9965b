"""Record projections and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as X
from ..functions.text import as_col

# ---- rule patterns; each can be replaced by the caller -----------------
PLACEHOLDER_TOKENS = ("[name]", "[subject]", "[speaker]", "[addressee]", "placeholder", "string value", "lorem ipsum")
ATTRIBUTED = r"(?i)^(?:believes?|suspects?|claims?|thinks?|assumes?|belief|suspicion|claim)\b"
CLOTHING = r"(?i)\b(?:clothing|clothes|outfit|attire|dress|garments?|wearing|apparel)\b"
NO_CHANGE = r"(?i)^(?:no change|unchanged|stable|normal|fine|none|uninjured|healthy)\b"
HEALTH = r"(?i)\b(?:health|injur(?:y|ies)|wounds?|physical condition)\b"
POSE = r"(?i)\b(?:pose|posture|position|stance|gesture|expression|gaze|sitting|standing|kneeling|lying)\b"


def normalize_enums(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Enum columns (column -> kind) fall back to their default."""
    return reduce(lambda d, item: d.withColumn(item[0], X.normalize_enum(item[0], item[1])), columns.items(), df)


def placeholder_flag(fields: list[str], tokens=PLACEHOLDER_TOKENS) -> Column:
    joined = F.concat_ws("\u001f", *[X.fold_key(f) for f in fields])
    return reduce(lambda a, b: a | b, [joined.contains(t.lower()) for t in tokens])


def quarantine_placeholders(df: DataFrame, fields: list[str], tokens=PLACEHOLDER_TOKENS, blank: str | None = None):
    """(clean, quarantined); with ``blank`` a bad value there is emptied instead."""
    flagged = placeholder_flag(fields, tokens)
    clean = df.filter(~flagged)
    if blank:
        clean = clean.withColumn(blank, F.when(placeholder_flag([blank], tokens), "").otherwise(F.col(blank)))
    return clean, df.filter(flagged)


def third_person_records(df: DataFrame, field: str) -> DataFrame:
    """Keep third-person sentences of a field; drop records left empty."""
    return df.withColumn(field, X.third_person_only(field)).filter(F.col(field) != "")


def is_address(predicate="predicate", category="category") -> Column:
    return X.fold_key(category).rlike(fixed.ADDRESS_CATEGORY) | X.fold_key(predicate).rlike(fixed.ADDRESS_USE) | reduce(
        Column.__or__, (X.fold_key(predicate).startswith(p) for p in fixed.ADDRESS_PREFIXES))


def fact_kind(predicate="predicate", value="value", category="category") -> Column:
    """Address form, knowledge boundary, established knowledge, perspective or objective."""
    cat, pred = X.fold_key(category), X.fold_key(predicate)
    boundary = cat.isin("knowledge boundary", "knowledge gap") | (
        (cat == "knowledge") & X.normalize_text(value).rlike(fixed.KNOWLEDGE_GAP)
    )
    return (
        F.when(is_address(predicate, category), "address")
        .when(boundary, "knowledge boundary")
        .when(pred.rlike(r"^knowledge of\s+\S"), "established knowledge")
        .when(cat.isin("belief", "perspective", "attributed belief") | pred.rlike(ATTRIBUTED), "attributed perspective")
        .otherwise("objective")
    )


def beliefs_to_facts(beliefs: DataFrame, facts: DataFrame) -> DataFrame:
    """Holder/proposition rows as attributed facts, skipping known identities.

    ``beliefs(chat_key, id, holder, proposition, topic, certainty, status)``.
    """
    notes = F.concat_ws(
        "; ",
        F.when(X.normalize_text("certainty") != "", F.concat(F.lit("certainty: "), X.normalize_text("certainty"))),
        F.when(X.normalize_text("status") != "", F.concat(F.lit("status: "), X.normalize_text("status"))),
    )
    made = beliefs.select(
        "chat_key", "id", X.normalize_text("holder").alias("subject"),
        F.when(X.normalize_text("topic") != "", F.concat(F.lit("belief about "), X.normalize_text("topic")))
        .otherwise(F.lit("belief")).alias("predicate"),
        F.when(notes != "", F.concat(X.normalize_text("proposition"), F.lit(" ["), notes, F.lit("]")))
        .otherwise(X.normalize_text("proposition")).alias("value"),
        F.lit("belief").alias("category"),
    ).filter((F.col("subject") != "") & (F.col("value") != ""))
    key = [X.fold_key(c).alias(f"k_{c}") for c in ("subject", "predicate", "category")]
    known = facts.select("chat_key", *key).distinct()
    made = made.select("*", *key)
    return made.join(known, ["chat_key", "k_subject", "k_predicate", "k_category"], "left_anti").drop(
        "k_subject", "k_predicate", "k_category"
    )


def state_durability_gate(states: DataFrame) -> DataFrame:
    """Drop clothing and "no change" health rows; pose-like ongoing rows become scene."""
    attribute, value = X.normalize_text("attribute"), X.normalize_text("value")
    drop = attribute.rlike(CLOTHING) | (attribute.rlike(HEALTH) & value.rlike(NO_CHANGE))
    pose = (F.col("scope") == "ongoing") & attribute.rlike(POSE)
    return states.filter(~drop).withColumn("scope", F.when(pose, "scene").otherwise(F.col("scope")))


def newest_l1(l1: DataFrame) -> DataFrame:
    """Newest level-1 range per chat: (chat_key, newest_from, newest_to)."""
    return l1.groupBy("chat_key").agg(
        F.max(F.struct("range_to", "range_from")).alias("m")
    ).select("chat_key", F.col("m.range_from").alias("newest_from"), F.col("m.range_to").alias("newest_to"))


def fresh_active_states(states: DataFrame, l1: DataFrame) -> DataFrame:
    """Set, non-empty, valid scope, and sourced up to the newest level-1 range."""
    active = states.filter(
        F.col("scope").isin("scene", "ongoing") & (F.col("operation") != "clear")
        & (X.normalize_text("value") != "")
    )
    return (
        active.join(newest_l1(l1), "chat_key", "left")
        .filter(F.col("newest_from").isNull() | (F.col("range_to") >= F.col("newest_from")))
        .drop("newest_from", "newest_to")
    )


def raw_tail_flags(records: DataFrame, tails: DataFrame) -> DataFrame:
    """Flags: latest source, or all sources, inside the visible tail.

    ``records`` has sources array<struct<range_from, range_to>>;
    ``tails(chat_key, tail_from, tail_to)``.
    """
    inside = lambda s: (s["range_from"] >= F.col("tail_from")) & (s["range_to"] <= F.col("tail_to"))
    latest = F.element_at(
        F.array_sort(F.transform("sources", lambda s: F.struct(s["range_to"].alias("range_to"), s["range_from"].alias("range_from")))), -1
    )
    j = records.join(tails, "chat_key", "left")
    return j.select(
        *records.columns,
        F.coalesce(inside(latest), F.lit(False)).alias("latest_in_tail"),
        F.coalesce((F.size("sources") > 0) & F.forall("sources", inside), F.lit(False)).alias("all_in_tail"),
    )


def type_family(value) -> Column:
    """person, place, group, object, or empty when the type says nothing.

    An exact type decides first; then a person word at the end, or beside a word of life
    or death; then words of the other families, and last a person word anywhere.
    """
    kind = X.fold_key(value)
    word = lambda words: kind.rlike(rf"\b(?:{words})\b")
    person = word(fixed.PERSON_TYPE_WORDS)
    signal = (
        F.when(kind.rlike(rf"\b(?:{fixed.PERSON_TYPE_WORDS})\s*$") | (word(fixed.LIFE_TYPE_WORDS) & person), "person")
        .when(word(fixed.OBJECT_TYPE_WORDS), "object").when(word(fixed.PLACE_TYPE_WORDS), "place").when(word(fixed.GROUP_TYPE_WORDS), "group")
        .when(person | word(fixed.AGE_TYPE_WORDS), "person").otherwise(""))
    return F.when(kind.isin("", *fixed.ENTITY_TYPE_BLANK), "").otherwise(F.coalesce(X.lookup(fixed.ENTITY_TYPE_FAMILIES, kind), signal))


def types_compatible(left, right) -> Column:
    a, b = type_family(left), type_family(right)
    return (a == "") | (b == "") | (a == b)


def anchored_story_time(story_time, temporal, event_anchor=None, span=None, span_frames=None) -> Column:
    """Story time with the anchor, frame, relation and interval it needs."""
    t = as_col(temporal)
    label = X.normalize_text(story_time)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    frame_special = ~blank(t["frame"]) & (X.fold_key(t["frame"]) != fixed.MAIN_FRAME)
    frames = F.coalesce(span_frames, F.array().cast("array<string>")) if span_frames is not None else F.array().cast("array<string>")
    frames = F.array_distinct(X.nonempty(F.transform(frames, X.normalize_text)))
    frames_special = (F.size(frames) > 1) | ((F.size(frames) == 1) & (X.fold_key(frames[0]) != fixed.MAIN_FRAME))
    relation_special = ~blank(t["relation"]) & ~t["relation"].isin("same-period", "after", "unknown")
    relative = label.rlike(f"(?i){fixed.RELATIVE_TIME}")
    needed = relative | ~blank(t["elapsed"]) | frame_special | frames_special | relation_special
    first = lambda *cols: F.coalesce(*[F.when(~blank(c), c) for c in cols])
    anchor = first(
        t["anchor_id"], t["reference_id"],
        as_col(event_anchor) if event_anchor is not None else F.lit(""),
        as_col(span) if span is not None else F.lit(""),
    )
    parts = F.concat_ws(
        "; ", F.when(label != "", label),
        F.when(anchor.isNotNull(), F.concat(F.lit("relative to "), anchor))
        .when(relative, F.lit(f"relative to {fixed.UNKNOWN_TIME_SOURCE}")),
        F.when(frame_special, F.concat(F.lit("frame "), t["frame"])),
        F.when(frames_special, F.concat(F.lit("frames "), F.array_join(frames, ", "))),
        F.when(~blank(t["relation"]) & (t["relation"] != "unknown"), t["relation"]),
        F.when(~blank(t["elapsed"]), F.concat(F.lit("interval "), t["elapsed"])),
    )
    return F.when(needed, parts).otherwise(label)


def stored_search(df: DataFrame, needle: str, exclude=("chat_key",)) -> DataFrame:
    """Case-insensitive substring search over the serialised record."""
    body = F.lower(F.to_json(F.struct(*[c for c in df.columns if c not in exclude])))
    return df.filter(body.contains(needle.lower()))


def dedupe_participants(*lists, most: int | None = None) -> Column:
    """Ordered distinct union of name lists, the first ``most`` if wanted."""
    cleaned = [F.transform(F.coalesce(as_col(v), F.array()), X.normalize_text) for v in lists]
    union = F.array_distinct(X.nonempty(F.concat(*cleaned)))
    return union if most is None else F.slice(union, 1, most)


def distinct_rows(df: DataFrame, keys: list[str], row: str, order: Column) -> DataFrame:
    """Case-insensitive distinct rows per key, first one kept."""
    folded = X.fold_key(row)
    return (
        df.withColumn("__f", folded).filter(F.col("__f") != "")
        .groupBy(*keys, "__f").agg(F.min_by(row, order).alias(row), F.min(order).alias("position")).drop("__f")
    )


def merge_address_values(*values) -> Column:
    """``a; b`` lists merged: quotes stripped, distinct ignoring case, first-seen order."""
    parts = F.concat(*[F.split(F.coalesce(as_col(v), F.lit("")), r"\s*;\s*") for v in values])
    clean = X.nonempty(
        F.transform(parts, lambda p: X.normalize_text(F.regexp_replace(p, "^[\"'“”‘’]+|[\"'“”‘’]+$", "")))
    )
    first_seen = F.aggregate(
        clean, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(first_seen, "; ")
