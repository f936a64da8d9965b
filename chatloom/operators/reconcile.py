"""Stored memory audited again and merged, at the cost of what changed.

The rules run one after another and each hands on what it touched: changed records and
those whose messages changed get their shapes and contradictions checked; the identities
these facts had before and have now are merged again (D1), the topics of their knowledge
are accumulated again (D4); pairs of people the facts name may become relationships, and
pairs touched that way are merged; matters of chats with new messages are settled again,
and the near-duplicate buckets they fall into are clustered again (D3). Everything else
passes through as it is, so a periodic run costs what changed, and its rows are those of a
run over everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from . import audit as A, entities as E, merge as M
from .scale import shuffled, sized, write_through

KNOWLEDGE = ("knowledge", "knowledge boundary", "knowledge gap")


def _known(category="category") -> Column:
    return X.fold_key(category).isin(*KNOWLEDGE)


def touched_records(records: DataFrame, changed: DataFrame | None, messages: DataFrame | None) -> DataFrame:
    """``(chat_key, id)`` of records that changed, or whose range holds a changed message.

    ``None`` for both means all. Records meet messages on buckets of 64 positions.
    """
    if changed is None and messages is None:
        return records.select("chat_key", "id").distinct()
    out = None
    if changed is not None:
        out = records.select("chat_key", "id").join(shuffled(changed.select("chat_key", "id").distinct()), ["chat_key", "id"], "left_semi")
    if messages is not None and "range_from" in records.columns:
        buckets = F.explode(F.sequence(F.floor(F.col("range_from") / 64), F.floor(F.col("range_to") / 64))).alias("b")
        rows = records.select("chat_key", "id", "range_from", "range_to", buckets)
        said = messages.select("chat_key", "idx", F.floor(F.col("idx") / 64).alias("b")).distinct()
        inside = rows.join(shuffled(said), ["chat_key", "b"]).filter((F.col("idx") >= F.col("range_from")) & (F.col("idx") <= F.col("range_to")))
        near = inside.select("chat_key", "id")
        out = near if out is None else out.unionByName(near)
    return out.distinct()


def _parts(records: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    few = sized(touched)
    return records.join(few, ["chat_key", "id"], "left_semi"), records.join(few, ["chat_key", "id"], "left_anti")


def merged_facts(facts: DataFrame) -> DataFrame:
    """Facts by identity (D1), and knowledge of one holder about one topic accumulated."""
    cols = facts.columns
    plain = facts.withColumn("identity", M.identity("facts")).filter(~_known())
    fields = [c for c in cols if c not in ("chat_key", "id", "range_to", "seq")]
    newest = F.struct("range_to", "seq")
    one = plain.groupBy("chat_key", "identity").agg(
        F.min_by("id", newest).alias("id"), F.max_by(F.struct(*fields), newest).alias("r"), F.max("range_to").alias("range_to"), F.max("seq").alias("seq"))
    one = one.select(*[F.col(f"r.`{c}`").alias(c) if c in fields else F.col(c) for c in cols])
    told = facts.filter(_known())
    keys = ["chat_key", "subject_key", "predicate_key"]
    topics = told.withColumn("subject_key", X.fold_key("subject")).withColumn("predicate_key", X.fold_key("predicate"))
    heads = topics.groupBy(*keys).agg(
        F.min_by("id", newest).alias("id"), F.max_by(F.struct(*fields), newest).alias("r"), F.max("range_to").alias("range_to"), F.max("seq").alias("seq"))
    grown = E.merge_knowledge(told.select("chat_key", "subject", "predicate", "value", "seq")).select(*keys, F.col("value").alias("__value"))
    known = heads.join(shuffled(grown), keys).select(*[
        F.col("__value").alias(c) if c == "value" else F.col(f"r.`{c}`").alias(c) if c in fields else F.col(c) for c in cols])
    return one.unionByName(known)


def _identities(facts: DataFrame) -> DataFrame:
    """What a fact is merged by: its identity, or the holder and topic of knowledge."""
    topic = F.concat_ws("|", F.lit("knowledge"), X.fold_key("subject"), X.fold_key("predicate"))
    return facts.withColumn("__identity", F.when(_known(), topic).otherwise(M.identity("facts")))


def reconcile_facts(facts: DataFrame, messages: DataFrame, changed: DataFrame | None = None, new_messages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts after shapes, contradictions and merges, and the ``(chat_key, id)`` that came out of a touched identity."""
    cols = facts.columns
    touched = write_through(touched_records(facts, changed, new_messages), "touched-facts")
    mine, rest = _parts(facts, touched)
    checked = write_through(A.contradicted_objects(A.normalize_fact_shapes(mine), messages).select(*cols), "checked-facts")
    ids = _identities(mine.select("chat_key", "id", "subject", "predicate", "category")).select("chat_key", "__identity").unionByName(
        _identities(checked).select("chat_key", "__identity")).distinct()
    ids = sized(write_through(ids, "touched-identities"))
    others = _identities(rest)
    again = others.join(ids, ["chat_key", "__identity"], "left_semi").select(*cols)
    still = others.join(ids, ["chat_key", "__identity"], "left_anti").select(*cols)
    merged = write_through(merged_facts(checked.unionByName(again)), "merged-facts")
    return still.unionByName(merged), merged.select("chat_key", "id")


def reconcile_relationships(relationships: DataFrame, facts: DataFrame, entities: DataFrame, touched: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Relationships that touched facts state beside the stored ones, texts put right, one row for each pair."""
    cols = relationships.columns
    derived = A.derive_relationships(facts.join(sized(touched), ["chat_key", "id"], "left_semi"), entities, relationships)
    new = relationships.limit(0).unionByName(derived.select(*[c for c in cols if c in derived.columns]), allowMissingColumns=True)
    mine, rest = (relationships, None) if changed is None else _parts(relationships, changed.select("chat_key", "id").distinct())
    fresh = write_through(A.normalize_relationship_text(mine.unionByName(new)).select(*cols), "touched-relationships")
    keyed = fresh.withColumn("__pair", M.pair_key())
    if rest is not None:
        others = rest.withColumn("__pair", M.pair_key())
        pairs = shuffled(keyed.select("chat_key", "__pair").distinct())
        keyed = keyed.unionByName(others.join(pairs, ["chat_key", "__pair"], "left_semi"))
        rest = others.join(pairs, ["chat_key", "__pair"], "left_anti").select(*cols)
    order = F.struct(F.coalesce("range_to", F.lit(-1)), F.coalesce("seq", F.lit(-1)), "id")
    one = keyed.groupBy("chat_key", "__pair").agg(F.max_by(F.struct(*[c for c in cols if c != "chat_key"]), order).alias("r")).select("chat_key", "r.*").select(*cols)
    return one if rest is None else rest.unionByName(one)


def reconcile_threads(
    threads: DataFrame, evidence: DataFrame, messages: DataFrame, changed: DataFrame | None = None, new_messages: DataFrame | None = None,
) -> DataFrame:
    """Matters settled again, then one row for each group of near-duplicates (D3)."""
    if changed is None and new_messages is None:
        mine, rest = threads, None
    else:
        chats = threads.select("chat_key", "id").join((new_messages if new_messages is not None else threads.limit(0)).select("chat_key").distinct(), "chat_key", "left_semi")
        ids = chats if changed is None else chats.unionByName(changed.select("chat_key", "id")).distinct()
        mine, rest = _parts(threads, write_through(ids, "touched-threads"))
    settled = A.resolve_threads(mine, evidence, messages)
    cols = [c for c in threads.columns if c in settled.columns]
    settled = write_through(settled.select(*cols), "settled-threads")
    pool, still = settled, None
    if rest is not None:
        bucket = lambda df: E.semantic_features(df, "threads").select("chat_key", "id", "bucket")
        mine_in = bucket(settled).select("chat_key", "bucket").unionByName(bucket(mine.select(*cols)).select("chat_key", "bucket")).distinct()
        near = write_through(bucket(rest.select(*cols)).join(mine_in, ["chat_key", "bucket"], "left_semi").select("chat_key", "id"), "touched-buckets")
        again, still = _parts(rest.select(*cols), near)
        pool = write_through(settled.unionByName(again), "clustered-threads")
    owner = E.dedupe_semantic(pool, "threads").filter("id = canonical_id").select("chat_key", "id")
    kept = pool.join(shuffled(owner), ["chat_key", "id"], "left_semi")
    return kept if still is None else still.unionByName(kept)


def reconcile_memory(
    memory: dict[str, DataFrame], evidence: DataFrame, messages: DataFrame, processed: DataFrame, changed: dict[str, DataFrame] | None = None,
    new_messages: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Facts, relationships and threads of a memory after all rules and merges.

    ``memory`` holds ``facts``, ``relationships``, ``threads`` and ``entities``. Without
    ``changed`` and ``new_messages`` the run covers everything; with them (ids of changed
    records by category, positions of new or edited messages) it covers what they touch.
    Only processed messages count.
    """
    said = write_through(messages.join(shuffled(processed.select("chat_key", "idx")), ["chat_key", "idx"], "left_semi"), "processed-messages")
    only = (lambda c: None) if changed is None and new_messages is None else (lambda c: (changed or {}).get(c, memory[c].limit(0).select("chat_key", "id")))
    facts, touched = reconcile_facts(memory["facts"], said, only("facts"), new_messages)
    facts = write_through(facts, "reconciled-facts")
    return {
        "facts": facts,
        "relationships": reconcile_relationships(memory["relationships"], facts, memory["entities"], touched, only("relationships")),
        "threads": reconcile_threads(memory["threads"], evidence, said, only("threads"), new_messages),
        "entities": memory["entities"],
    }
