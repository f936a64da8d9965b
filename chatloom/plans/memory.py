"""Named queries over records: projections, merge, states, timeline, hierarchy."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import fixed, text as X
from ..operators import groups as G, hierarchy as H, merge as M, overlap as O, records as R, replay as RP, states as S, timeline as L
from ..sources.messages import read_messages
from ..sources.tables import table
from . import bindings as B
from .registry import fragment, query, sql

NORM = r"trim(regexp_replace({0}, '[\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ' ', 'g'))"


def norm(column: str) -> str:
    return NORM.format(column)


fragment("doc", f"SELECT doc_id, lang, source, text, {norm('text')} AS norm FROM documents")


# ---- B1-B8 --------------------------------------------------------------------
@query("normalize_text", sql("""
SELECT doc_id, md5(norm) AS norm_md5, md5(lower(norm)) AS fold_md5,
       CASE WHEN length(norm) <= 80 THEN norm ELSE rtrim(substr(norm, 1, 79)) || '…' END AS clipped
FROM doc
""", "doc"))
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.normalize_text("text")).alias("norm_md5"),
                    F.md5(X.fold_key("text")).alias("fold_md5"), X.clip("text", 80).alias("clipped"))


@query("strip_noise_blocks", rf"""
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5
FROM (SELECT page_id, {norm(r"regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g')")} AS t FROM pages)
""")
def _(spark, sf):
    t = X.strip_noise_blocks("html", ("script", "style"))
    return table(spark, sf, "pages").select("page_id", t.alias("t")).select(
        "page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@query("normalize_enums", sql("""
SELECT event_id, CASE WHEN name IN ('open', 'resolved', 'abandoned') THEN name ELSE 'open' END AS status,
       CASE WHEN k % 3 = 0 THEN 'recurring' WHEN k % 3 = 1 THEN 'persistent' ELSE 'temporary' END AS persistence,
       CAST(greatest(1, least(5, CASE WHEN k % 9 = 0 THEN 3 ELSE floor((k % 9) * 0.7 + 0.5) END)) AS BIGINT) AS importance
FROM ev
""", "ev"))
def _(spark, sf):
    e = B.event_messages(spark, sf).withColumn("status", F.col("name")).withColumn(
        "persistence", F.when(F.col("k") % 3 == 0, "recurring").when(F.col("k") % 3 == 1, "persistent").otherwise("?"))
    e = R.normalize_enums(e, {"status": "thread_status", "persistence": "persistence"})
    return e.select("event_id", "status", "persistence", X.clamp_importance((F.col("k") % 9) * F.lit(0.7)).alias("importance"))


@query("quarantine_placeholders", sql("""
SELECT event_id, name LIKE '%error%' OR text LIKE '%7}%' AS quarantined FROM ev
""", "ev"))
def _(spark, sf):
    clean, bad = R.quarantine_placeholders(B.event_messages(spark, sf), ["name", "text"], ("error", "7}"))
    return clean.select("event_id", F.lit(False).alias("quarantined")).unionByName(
        bad.select("event_id", F.lit(True).alias("quarantined")))


fragment("sent", f"""
SELECT chat_key, idx, s.i AS pos, s.s AS sentence FROM (
  SELECT chat_key, idx, unnest(list_transform(generate_series(1, len(l)), lambda i: {{'i': i, 's': trim(l[i])}})) AS s
  FROM (SELECT chat_key, idx, string_split(regexp_replace({norm('text')}, '([.!?]) ', chr(1) || '\\1' || chr(2), 'g'), chr(2)) AS l FROM smsg))
""".replace("chr(1) || '\\1' || chr(2)", "'\\1' || chr(2)"), ("smsg",))
PERSON = r"(^|[^\p{L}\p{N}])(i|me|my|mine|myself|we|us|our|ours|ourselves|you|your|yours|yourself|yourselves)($|[^\p{L}\p{N}])"


@query("third_person_only", sql(rf"""
SELECT chat_key, idx, length(kept) AS n_chars, md5(kept) AS kept_md5
FROM (SELECT chat_key, idx, string_agg(sentence, ' ' ORDER BY pos) AS kept FROM sent
      WHERE sentence <> '' AND NOT regexp_matches(lower(sentence), '{PERSON}') GROUP BY chat_key, idx)
""", "sent"))
def _(spark, sf):
    m = R.third_person_records(read_messages(B.short_messages_raw(spark, sf)), "text")
    return m.select("chat_key", "idx", F.length("text").alias("n_chars"), F.md5("text").alias("kept_md5"))


fragment("kfact", """
SELECT *, CASE k % 6 WHEN 0 THEN 'calls user ' || (k % 10) WHEN 1 THEN 'knowledge of user ' || (k % 10)
                     WHEN 2 THEN 'believes in user ' || (k % 10) WHEN 3 THEN 'uses a formal address for user 3'
                     WHEN 4 THEN 'knowledge' ELSE 'likes' END AS kpred,
       CASE k % 6 WHEN 4 THEN 'knowledge' WHEN 5 THEN CASE WHEN k % 4 = 1 THEN 'belief' ELSE 'trait' END ELSE 'other' END AS kcat,
       CASE WHEN k % 4 = 0 THEN 'does not know the answer' ELSE 'knows the answer' END AS kval
FROM ev
""", ("ev",))


def _kfacts(spark, sf):
    k = F.col("k")
    u = (k % 10).cast("string")
    pred = (
        F.when(k % 6 == 0, F.concat(F.lit("calls user "), u)).when(k % 6 == 1, F.concat(F.lit("knowledge of user "), u))
        .when(k % 6 == 2, F.concat(F.lit("believes in user "), u)).when(k % 6 == 3, "uses a formal address for user 3")
        .when(k % 6 == 4, "knowledge").otherwise("likes")
    )
    cat = F.when(k % 6 == 4, "knowledge").when((k % 6 == 5) & (k % 4 == 1), "belief").when(k % 6 == 5, "trait").otherwise("other")
    return B.event_messages(spark, sf).withColumn("predicate", pred).withColumn("category", cat).withColumn(
        "value", F.when(k % 4 == 0, "does not know the answer").otherwise("knows the answer"))


@query("classify_facts", sql("""
SELECT event_id, CASE WHEN k % 6 IN (0, 3) THEN 'address' WHEN kcat = 'knowledge' AND k % 4 = 0 THEN 'knowledge boundary'
    WHEN k % 6 = 1 THEN 'established knowledge' WHEN k % 6 = 2 OR kcat = 'belief' THEN 'attributed perspective' ELSE 'objective' END AS fact_kind
FROM kfact
""", "kfact"))
def _(spark, sf):
    return _kfacts(spark, sf).select("event_id", R.fact_kind().alias("fact_kind"))


@query("beliefs_to_facts", sql("""
SELECT b.chat_key, 'b' || b.event_id AS id, 'user ' || (b.k % 10) AS subject, 'belief about ' || b.name AS predicate,
       b.text || ' [certainty: ' || CASE WHEN b.k % 2 = 0 THEN 'high' ELSE 'low' END || ']' AS value
FROM ev b WHERE b.k % 5 = 0 AND NOT EXISTS (
  SELECT 1 FROM ev f WHERE f.chat_key = b.chat_key AND f.k % 7 = 0 AND f.k % 10 = b.k % 10 AND f.name = b.name)
""", "ev"))
def _(spark, sf):
    e = B.event_messages(spark, sf)
    holder = F.concat(F.lit("user "), (F.col("k") % 10).cast("string"))
    beliefs = e.filter(F.col("k") % 5 == 0).select(
        "chat_key", F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("id"), holder.alias("holder"),
        F.col("text").alias("proposition"), F.col("name").alias("topic"),
        F.when(F.col("k") % 2 == 0, "high").otherwise("low").alias("certainty"), F.lit("").alias("status"))
    known = e.filter(F.col("k") % 7 == 0).select(
        "chat_key", F.upper(holder).alias("subject"), F.concat(F.lit("Belief about "), "name").alias("predicate"), F.lit("belief").alias("category"))
    return R.beliefs_to_facts(beliefs, known).drop("category")


@query("state_durability_gate", sql("""
SELECT event_id, CASE WHEN name = 'view' AND event_id % 2 = 0 THEN 'scene' WHEN event_id % 2 = 0 THEN 'ongoing' ELSE 'scene' END AS scope
FROM ev WHERE name <> 'click' AND NOT (name = 'purchase' AND k % 2 = 0)
""", "ev"))
def _(spark, sf):
    s = B.states(spark, sf).join(B.event_messages(spark, sf).select("event_id", "k"), "event_id")
    attribute = (F.when(F.col("attribute") == "click", "current outfit").when(F.col("attribute") == "purchase", "health")
                 .when(F.col("attribute") == "view", "posture").otherwise("mood"))
    s = s.withColumn("value", F.when(F.col("k") % 2 == 0, "No change").otherwise("hurt")).withColumn("attribute", attribute)
    return R.state_durability_gate(s).select("event_id", "scope")


# ---- B9-B17 ---------------------------------------------------------------------
fragment("newest", "SELECT chat_key, arg_max(range_from, range_to) AS newest_from, max(range_to) AS newest_to FROM l1 GROUP BY chat_key", ("l1",))


@query("fresh_active_states", sql("""
SELECT s.event_id, s.scope FROM state s LEFT JOIN newest n USING (chat_key)
WHERE operation <> 'clear' AND (newest_from IS NULL OR range_to >= newest_from)
""", "state", "newest"))
def _(spark, sf):
    return R.fresh_active_states(B.states(spark, sf), B.l1(spark, sf)).select("event_id", "scope")


@query("suppress_raw_tail", sql("""
SELECT id, range_from >= newest_from AND range_to <= newest_to AS latest_in_tail,
       range_from >= newest_from AND range_to <= newest_to AND event_id % 3 <> 0 AS all_in_tail
FROM fact JOIN newest USING (chat_key)
""", "fact", "newest"))
def _(spark, sf):
    span = lambda a, b: F.struct(a.cast("long").alias("range_from"), b.cast("long").alias("range_to"))
    own = span(F.col("range_from"), F.col("range_to"))
    f = B.facts(spark, sf).withColumn(
        "sources", F.when(F.col("event_id") % 3 == 0, F.array(own, span(F.lit(-8), F.lit(-1)))).otherwise(F.array(own)))
    tails = R.newest_l1(B.l1(spark, sf)).select("chat_key", F.col("newest_from").alias("tail_from"), F.col("newest_to").alias("tail_to"))
    return R.raw_tail_flags(f.select("chat_key", "id", "sources"), tails).join(tails.select("chat_key"), "chat_key", "left_semi").select(
        "id", "latest_in_tail", "all_in_tail")


#: types of all kinds: exact, at the end of a phrase, beside a word of life, of several families, and of none
TYPES = (
    "individual", "captain", "king", "world", "institution", "vessel", "council", "person", "Human officer", "small town", "a Device", "retired guard captain",
    "captain of a ship", "dead king of the city", "young traveller", "guild of mages", "order", "mystery", "Unknown", "other", "house guard", "ship doctor",
    "elderly", "flag ship", "moon base", "weapon", "living weapon", "army physician corps", "people", "thing",
)
FAMILIES = (
    "person", "person", "person", "place", "group", "", "group", "person", "person", "place", "object", "person",
    "object", "person", "person", "group", "group", "", "", "", "person", "person",
    "person", "object", "place", "object", "object", "group", "", "",
)
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("type_families", f"""
SELECT p_partkey, {_LIST(FAMILIES)}[p_partkey % {len(TYPES)} + 1] AS family, {_LIST(FAMILIES)}[p_partkey % {len(TYPES)} + 1] IN ('', 'person') AS fits_person FROM part
""")
def _(spark, sf):
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("p_partkey") % len(TYPES) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", R.type_family(kind).alias("family"), R.types_compatible(kind, F.lit("person")).alias("fits_person"))


fragment("timed", """
SELECT event_id, CASE k % 5 WHEN 0 THEN 'left yesterday and now rests' WHEN 1 THEN 'returned three days later'
   WHEN 2 THEN 'unknown knowledge' WHEN 3 THEN 'soon' ELSE 'the day before the feast' END AS label,
   CASE k % 5 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'three days later' WHEN 3 THEN 'soon' WHEN 4 THEN 'the day before' END AS hit,
   CASE WHEN k % 3 = 0 THEN '' ELSE 'A' || k END AS anchor, k FROM ev
""", ("ev",))


def _timed(spark, sf):
    k = F.col("k")
    label = (F.when(k % 5 == 0, "left yesterday and now rests").when(k % 5 == 1, "returned three days later")
             .when(k % 5 == 2, "unknown knowledge").when(k % 5 == 3, "soon").otherwise("the day before the feast"))
    return B.event_messages(spark, sf).select("event_id", "k", label.alias("label"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("A"), k.cast("string"))).alias("anchor"))


@query("bind_relative_time", sql(f"""
SELECT event_id, CASE WHEN hit IS NULL THEN label ELSE
  substr(label, 1, strpos(label, hit) + length(hit) - 1) || ' (relative to ' ||
  CASE WHEN anchor = '' THEN '{fixed.UNKNOWN_TIME_SOURCE}' ELSE anchor END || ')' ||
  substr(label, strpos(label, hit) + length(hit)) END AS bound,
  concat_ws('; ', label, CASE WHEN hit IS NOT NULL OR k % 2 = 0 THEN CASE WHEN anchor <> '' THEN 'relative to ' || anchor
     WHEN hit IS NOT NULL THEN 'relative to {fixed.UNKNOWN_TIME_SOURCE}' END END,
     CASE WHEN k % 2 = 0 THEN 'frame dream' END, CASE WHEN hit IS NOT NULL OR k % 2 = 0 THEN 'after' END) AS story_time
FROM timed
""", "timed"))
def _(spark, sf):
    t = _timed(spark, sf)
    temporal = F.struct(F.col("anchor").alias("anchor_id"), F.when(F.col("k") % 2 == 0, "dream").otherwise("main narrative").alias("frame"),
                        F.lit("after").alias("relation"), F.lit("").alias("reference_id"), F.lit("").alias("elapsed"))
    return t.select("event_id", X.bind_relative_time("label", "anchor").alias("bound"),
                    R.anchored_story_time("label", temporal).alias("story_time"))


@query("stored_search_filter", sql("""
SELECT id FROM fact WHERE lower(predicate) LIKE '%purch%' OR value LIKE '%purch%'
""", "fact"))
def _(spark, sf):
    f = B.facts(spark, sf).select("chat_key", "id", "subject", "predicate", "value", "category")
    return R.stored_search(f, "PURCH").select("id")


# ---- G3, G4, D13 ------------------------------------------------------------------
@query("distinct_rows", sql("""
SELECT chat_key, lower(name || ' ' || (k % 10)) AS folded, min(idx) AS position FROM ev GROUP BY ALL
""", "ev"))
def _(spark, sf):
    e = B.event_messages(spark, sf)
    row = F.concat_ws(" ", F.when(F.col("k") % 2 == 0, F.upper("name")).otherwise(F.col("name")), (F.col("k") % 10).cast("string"))
    return R.distinct_rows(e.withColumn("row", row), ["chat_key"], "row", F.col("idx")).select(
        "chat_key", F.lower("row").alias("folded"), "position")


@query("participants_union", sql("""
SELECT event_id, CASE WHEN k % 7 = event_id % 7 THEN 'p' || (k % 7) || '|q' ELSE 'p' || (k % 7) || '|q|p' || (event_id % 7) END AS participants FROM ev
""", "ev"))
def _(spark, sf):
    p = lambda c: F.concat(F.lit("p"), (F.col(c) % 7).cast("string"))
    u = R.dedupe_participants(F.array(p("k"), F.lit(" q ")), F.array(F.lit("q"), p("event_id"), F.lit("")))
    return B.event_messages(spark, sf).select("event_id", F.array_join(u, "|").alias("participants"))


@query("merge_address_values", sql("""
SELECT event_id, CASE WHEN k % 2 = 0 THEN name || '; Sir' ELSE name || '; Sir; boss' END AS forms FROM ev
""", "ev"))
def _(spark, sf):
    e = B.event_messages(spark, sf)
    left = F.concat(F.lit('"'), F.col("name"), F.lit('"; Sir'))
    right = F.concat(F.upper("name"), F.lit("; 'sir'"), F.when(F.col("k") % 2 == 1, "; boss").otherwise(""))
    return e.select("event_id", R.merge_address_values(left, right).alias("forms"))


# ---- D1, D2, D5, D6, D9 --------------------------------------------------------------
FACT_KEYS = ["chat_key", "subject", "predicate", "category"]


@query("merge_facts", sql("""
SELECT chat_key, subject, predicate, category, arg_min(id, (range_to, seq)) AS id, count(*) AS merged,
       max(range_to) AS last_range_to, arg_max(value, (corrected, range_to, seq)) AS value,
       arg_max(importance, (corrected, range_to, seq)) AS importance
FROM fact GROUP BY ALL
""", "fact"))
def _(spark, sf):
    return M.merge_records(B.facts(spark, sf), FACT_KEYS, ["value", "importance"])


@query("merge_relationships", sql("""
SELECT least(endpoint_a, endpoint_b) || '|' || greatest(endpoint_a, endpoint_b) AS pair_key,
       arg_min(id, (range_to, seq * 1000000 + part)) AS id, count(*) AS merged, max(range_to) AS last_range_to,
       arg_max(dynamic, (range_to, seq * 1000000 + part)) AS dynamic, arg_max(qty, (range_to, seq * 1000000 + part)) AS qty
FROM rel GROUP BY ALL
""", "rel"))
def _(spark, sf):
    r = B.relationships(spark, sf).withColumn("pair_key", M.pair_key()).withColumn("seq", F.col("seq") * 1000000 + F.col("part"))
    return M.merge_records(r, ["pair_key"], ["dynamic", "qty"])


@query("endpoint_conflicts", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_suppkey = o_custkey % 100
""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    r = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "endpoint_a", F.concat(F.lit("Agent "), F.col("l_suppkey").cast("string"))).withColumn(
        "endpoint_b", F.concat(F.lit("agent  "), (F.col("o_custkey") % 100).cast("string")))
    return M.endpoint_conflicts(r).select("l_orderkey", "l_linenumber", "l_partkey")


@query("union_sources", sql("""
WITH d AS (SELECT chat_key, predicate, range_from, range_to, min(seq) AS seen FROM fact GROUP BY ALL),
t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY chat_key, predicate ORDER BY seen DESC) <= 5)
SELECT chat_key, predicate, string_agg(range_from || '-' || range_to, ',' ORDER BY seen) AS sources FROM t GROUP BY ALL
""", "fact"))
def _(spark, sf):
    f = B.facts(spark, sf).withColumn("source_chat", F.col("chat_key"))
    u = M.union_sources(f, ["chat_key", "predicate"], keep=5)
    return u.select("chat_key", "predicate", F.array_join(
        F.transform("sources", lambda s: F.concat_ws("-", s["range_from"].cast("string"), s["range_to"].cast("string"))), ",").alias("sources"))


@query("append_events", sql("""
WITH r AS (SELECT chat_key, id, name || (k % 3) AS sig, idx AS rf, idx + 1 + k % 8 AS rt,
           row_number() OVER (PARTITION BY chat_key, name || (k % 3) ORDER BY idx) AS rn FROM (SELECT *, 'f' || event_id AS id FROM ev)),
w AS (SELECT *, true AS keep, rt AS last_end FROM r WHERE rn = 1
      UNION ALL
      SELECT r.chat_key, r.id, r.sig, r.rf, r.rt, r.rn, r.rf > w.last_end, CASE WHEN r.rf > w.last_end THEN r.rt ELSE w.last_end END
      FROM w JOIN r ON r.chat_key = w.chat_key AND r.sig = w.sig AND r.rn = w.rn + 1)
SELECT chat_key, id FROM w WHERE keep
""", "ev").replace("WITH ev AS", "WITH RECURSIVE ev AS", 1))
def _(spark, sf):
    e = B.event_messages(spark, sf).select(
        "chat_key", F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("id"),
        F.concat("name", (F.col("k") % 3).cast("string")).alias("title"), F.lit("same summary").alias("summary"),
        F.col("idx").alias("range_from"), (F.col("idx") + 1 + F.col("k") % 8).alias("range_to"), F.col("idx").alias("seq"))
    return M.append_events(e).select("chat_key", "id")


@query("apply_record_merges", sql("""
WITH rec AS (SELECT chat_key, id, predicate AS kind, corrected, event_id, seq, range_from FROM fact),
req AS (SELECT chat_key, c.id AS canonical_id, d.id AS id, c.kind AS ck, d.kind AS dk, c.corrected OR d.corrected AS bad
        FROM rec c JOIN rec d USING (chat_key) WHERE c.seq % 10 = 0 AND d.seq IN (c.seq + 1, c.seq + 2)),
ok AS (SELECT chat_key, canonical_id FROM req GROUP BY ALL HAVING bool_and(ck = dk AND NOT bad)),
gone AS (SELECT req.* FROM req JOIN ok USING (chat_key, canonical_id))
SELECT rec.chat_key, rec.id, (SELECT count(*) FROM gone g WHERE g.chat_key = rec.chat_key AND g.canonical_id = rec.id) AS absorbed
FROM rec WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.chat_key = rec.chat_key AND g.id = rec.id)
""", "fact"))
def _(spark, sf):
    f = B.facts(spark, sf)
    rec = f.select("chat_key", "id", F.col("predicate").alias("kind"), "corrected",
                   F.array(F.col("range_from").cast("string")).alias("sources"), F.array("subject").alias("participants"))
    d = f.select("chat_key", F.col("id").alias("did"), (F.floor(F.col("seq") / 10) * 10).alias("seq"), (F.col("seq") % 10).alias("off")).filter("off in (1, 2)")
    merges = f.filter(F.col("seq") % 10 == 0).select("chat_key", "seq", F.col("id").alias("canonical_id")).join(d, ["chat_key", "seq"]).groupBy(
        "chat_key", "canonical_id").agg(F.collect_list("did").alias("duplicate_ids"))
    return M.apply_record_merges(rec, merges).select("chat_key", "id", "absorbed")


@query("memory_counts", sql("""
WITH r AS (SELECT chat_key, 'facts' AS category FROM fact UNION ALL SELECT chat_key, 'states' FROM state
           UNION ALL SELECT chat_key, 'l1' FROM l1)
SELECT chat_key, category, count(*) AS records FROM r GROUP BY GROUPING SETS ((chat_key, category), (chat_key), (category), ())
""", "fact", "state", "l1"))
def _(spark, sf):
    c = lambda df, n: df.select("chat_key", F.lit(n).alias("category"))
    r = c(B.facts(spark, sf), "facts").unionByName(c(B.states(spark, sf), "states")).unionByName(c(B.l1(spark, sf), "l1"))
    return M.memory_counts(r).drop("level")


# ---- E6, E7, C27, C43 ---------------------------------------------------------------
@query("newest_by_subject", sql("""
SELECT chat_key, predicate, arg_max(id, (range_to, range_from, event_id)) AS id FROM fact GROUP BY ALL
""", "fact"))
def _(spark, sf):
    from ..operators.scale import latest_by

    f = B.facts(spark, sf).select("chat_key", "predicate", "id", "range_to", "range_from", "event_id")
    return latest_by(f, ["chat_key", "predicate"], F.struct("range_to", "range_from", "event_id")).select("chat_key", "predicate", "id")


@query("state_timeline", sql("""
WITH last AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY chat_key, subject, attribute ORDER BY range_to DESC, seq DESC) = 1),
n AS (SELECT chat_key, max(range_to) AS nt FROM rng GROUP BY chat_key)
SELECT chat_key, attribute, id, value, scope FROM last JOIN n USING (chat_key)
WHERE operation = 'set' AND (scope = 'ongoing' OR range_to = nt)
""", "state", "rng"))
def _(spark, sf):
    return S.state_timeline(B.states(spark, sf), B.ranges(spark, sf)).select("chat_key", "attribute", "id", "value", "scope")


@query("reconcile_previous_values", sql("""
WITH last AS (SELECT chat_key, attribute, arg_max(value, seq) AS value FROM state WHERE seq < 30 GROUP BY ALL)
SELECT s.event_id, s.subject, CASE WHEN l.value IS NOT NULL AND l.value <> s.value THEN l.value ELSE '' END AS previous
FROM state s LEFT JOIN last l USING (chat_key, attribute) WHERE s.seq >= 30
""", "state"))
def _(spark, sf):
    from ..operators.scale import latest_by

    s = B.states(spark, sf)
    stored = latest_by(s.filter("seq < 30").select("chat_key", "subject", "attribute", "id", "value", "seq"),
                       ["chat_key", "subject", "attribute"], F.col("seq"))
    inc = s.filter("seq >= 30").withColumn("previous", F.lit("")).withColumn("target_id", F.lit(""))
    return S.reconcile_previous_values(inc, stored).select("event_id", "subject", "previous")


@query("promote_tail_range", sql("""
WITH comp AS (SELECT chat_key, max(idx) FILTER (WHERE rn <= (n // 8) * 8) AS lc FROM (
   SELECT chat_key, idx, row_number() OVER (PARTITION BY chat_key ORDER BY idx) AS rn, count(*) OVER (PARTITION BY chat_key) AS n FROM msg) GROUP BY chat_key)
SELECT r.chat_key, r.range_from, r.range_to FROM rng r JOIN comp c ON c.chat_key = r.chat_key AND c.lc = r.range_to
WHERE (r.range_from // 8) % 2 = 0
""", "rng", "msg"))
def _(spark, sf):
    r = B.ranges(spark, sf).withColumn("allow_state_updates", F.floor(F.col("range_from") / 8) % 2 != 0)
    return S.promote_tail_range(r, S.latest_complete_index(B.messages(spark, sf), 8))


# ---- C12, C13, C15, C17, C18 ------------------------------------------------------------
@query("range_overlap_join", sql("""
SELECT a.id AS fact_id, b.id AS l1_id FROM fact a JOIN l1 b ON a.chat_key = b.chat_key
 AND a.seq - 3 <= b.range_to + 1 AND b.range_from <= a.seq + 4 + 1
""", "fact", "l1"))
def _(spark, sf):
    f = B.facts(spark, sf).select(
        "chat_key", "id", (F.col("seq") - 3).alias("range_from"), (F.col("seq") + 4).alias("range_to"))
    l1 = B.l1(spark, sf).select("chat_key", "id", "range_from", "range_to")
    return O.range_overlap_join(f, l1, touch=1).select(F.col("id").alias("fact_id"), F.col("r_id").alias("l1_id"))


@query("target_compatibility", sql("""
SELECT i.id, CASE WHEN i.target = '' THEN 'none' WHEN s.id IS NULL THEN 'unknown'
   WHEN s.predicate = i.predicate AND s.category = i.category THEN 'kept' ELSE 'rejected' END AS verdict
FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'missing' ELSE 'f' || (event_id - 40) END AS target FROM fact) i
LEFT JOIN fact s ON s.chat_key = i.chat_key AND s.id = i.target
""", "fact"))
def _(spark, sf):
    f = B.facts(spark, sf)
    e = F.col("event_id")
    inc = f.withColumn("target_id", F.when(e % 5 == 0, "").when(e % 5 == 1, "missing").otherwise(F.concat(F.lit("f"), (e - 40).cast("string"))))
    return M.target_compatibility(inc, f, "facts").select("id", "verdict")


@query("token_overlap_pairs", sql(r"""
WITH ws AS (SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(lower(norm), '[\p{L}\p{N}]+')) AS t FROM doc),
tk AS (SELECT lang, doc_id, t FROM ws WHERE length(t) >= 3),
dd AS (SELECT lang, doc_id, count(*) AS n FROM tk GROUP BY ALL HAVING count(*) >= 5),
pr AS (SELECT a.lang, a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM tk a JOIN tk b ON a.lang = b.lang AND a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT pr.lang, x AS left_id, y AS right_id, shared, round(shared / least(ra.n, rb.n), 6) AS containment
FROM pr JOIN dd ra ON ra.lang = pr.lang AND ra.doc_id = x JOIN dd rb ON rb.lang = pr.lang AND rb.doc_id = y WHERE shared >= 5 AND shared / least(ra.n, rb.n) >= 0.75
""", "doc"))
def _(spark, sf):
    d = table(spark, sf, "documents")
    words = F.filter(F.regexp_extract_all(X.fold_key("text"), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.length(w) >= 3)
    p = O.token_overlap_pairs(d.select("lang", F.col("doc_id").alias("id"), "text"), 5, 0.75, ["lang"], tokens=words, folded=False)
    return p.select("lang", "left_id", "right_id", "shared", F.round("containment", 6).alias("containment"))


@query("hierarchy_links", sql("""
WITH f AS (SELECT chat_key, id, 'L1-' || chat_key || '-' || range_from AS ref FROM fact),
s AS (SELECT chat_key, id, 'L1-' || chat_key || '-' || range_from AS ref FROM state UNION ALL SELECT chat_key, id, id FROM l1)
SELECT f.id AS left_id, s.id AS right_id FROM f JOIN s USING (chat_key, ref)
""", "fact", "state", "l1"))
def _(spark, sf):
    ref = F.array(F.concat_ws("-", F.lit("L1"), "chat_key", F.col("range_from").cast("string")))
    f = B.facts(spark, sf).select("chat_key", "id", ref.alias("refs"))
    s = B.states(spark, sf).select("chat_key", "id", ref.alias("refs"))
    l = B.l1(spark, sf).select("chat_key", "id", F.array().cast("array<string>").alias("refs"))
    return O.hierarchy_links(f, s.unionByName(l)).select("left_id", "right_id")


@query("suppress_corrected", sql("""
WITH ops AS (SELECT chat_key, subject, predicate, category, event_id FROM fact WHERE event_id % 50 = 0)
SELECT f.id FROM fact f WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.chat_key = f.chat_key AND o.predicate = f.predicate
   AND ((o.event_id % 100 = 0 AND o.category = f.category) OR o.event_id % 100 = 50))
""", "fact"))
def _(spark, sf):
    f = B.facts(spark, sf)
    sel = F.concat_ws("|", "subject", "predicate", F.when(F.col("event_id") % 100 == 0, F.col("category")))
    ops = f.filter(F.col("event_id") % 50 == 0).select(
        "chat_key", F.lit("facts").alias("category"), F.when(F.col("event_id") % 100 == 0, "delete").otherwise("update").alias("action"), sel.alias("before_selector"))
    return M.suppress_corrected(f, ops, "facts").select("id")


# ---- C19, E8, E9, E10, H9 ------------------------------------------------------------------
@query("previous_in_frame", sql("""
SELECT id, lag(id) OVER (PARTITION BY chat_key, frame ORDER BY range_to) AS previous_id FROM l1
""", "l1"))
def _(spark, sf):
    return L.previous_in_frame(B.l1(spark, sf)).select("id", "previous_id")


@query("temporal_anchors", sql(f"""
WITH a AS (SELECT *, 'L1-' || substr(md5(chat_key), 1, 8) || '-' || range_from || '-' || range_to AS anchor_id FROM l1),
p AS (SELECT *, lag(anchor_id) OVER (PARTITION BY chat_key, frame ORDER BY range_to) AS prev FROM a)
SELECT anchor_id, frame, coalesce(prev, '') AS reference_id,
  CASE WHEN relation = 'sideways' THEN 'unknown' WHEN prev IS NOT NULL OR relation = 'detached' THEN relation ELSE 'unknown' END AS relation,
  CASE WHEN certainty = 'explicit' THEN elapsed ELSE '' END AS elapsed, certainty FROM p
""", "l1"))
def _(spark, sf):
    return L.temporal_anchors(B.l1(spark, sf)).select("temporal.*")


@query("temporal_context", sql("""
WITH s AS (SELECT chat_key, id, range_to, row_number() OVER (PARTITION BY chat_key ORDER BY range_to DESC) AS a,
             row_number() OVER (PARTITION BY chat_key, frame ORDER BY range_to DESC) AS b FROM l1)
SELECT chat_key, id FROM s WHERE a <= 6 OR b = 1 QUALIFY row_number() OVER (PARTITION BY chat_key ORDER BY range_to DESC) <= 7
""", "l1"))
def _(spark, sf):
    return L.temporal_context(B.l1(spark, sf), 7).select("chat_key", "id")


def _story_time():
    d = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey") % 6
    return (F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(k == 1, F.date_format(d, "M/d/yyyy"))
            .when(k == 2, F.concat(F.date_format(d, "d MMMM yyyy"), F.lit(", 3:15 PM")))
            .when(k == 3, F.concat(F.lit("Day "), F.date_format(d, "D"), F.lit(" morning")))
            .when(k == 4, F.date_format(d, "MMMM d")).otherwise("some time ago"))


fragment("dated", """
SELECT o_orderkey, o_custkey % 40 AS c, o_orderkey % 6 AS kind, CAST(o_orderdate AS DATE) AS d,
  CASE o_orderkey % 6 WHEN 0 THEN year(o_orderdate) * 535680 + month(o_orderdate) * 44640 + day(o_orderdate) * 1440
   WHEN 1 THEN year(o_orderdate) * 535680 + month(o_orderdate) * 44640 + day(o_orderdate) * 1440
   WHEN 2 THEN year(o_orderdate) * 535680 + month(o_orderdate) * 44640 + day(o_orderdate) * 1440 + 915
   WHEN 3 THEN dayofyear(o_orderdate) * 1440 + 540 END AS value,
  CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN 'main narrative|calendar' WHEN o_orderkey % 6 = 3 THEN 'main narrative|numbered-day' END AS family
FROM orders
""")


@query("story_date_key", sql("SELECT o_orderkey, family, CAST(value AS BIGINT) AS value FROM dated", "dated"))
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", X.story_date_key(_story_time()))
    return o.select("o_orderkey", F.col("k.family").alias("family"), F.col("k.value").alias("value"))


@query("chronological_events", sql("""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o_orderkey) AS slot FROM dated),
a AS (SELECT c, family, slot, row_number() OVER (PARTITION BY c, family ORDER BY slot) AS nth FROM s WHERE family IS NOT NULL),
b AS (SELECT c, family, o_orderkey, row_number() OVER (PARTITION BY c, family ORDER BY value, slot) AS nth FROM s WHERE family IS NOT NULL)
SELECT o_orderkey, slot AS position FROM a JOIN b USING (c, family, nth)
UNION ALL SELECT o_orderkey, slot FROM s WHERE family IS NULL
""", "dated"))
def _(spark, sf):
    o = table(spark, sf, "orders")
    ev = o.select((F.col("o_custkey") % 40).cast("string").alias("chat_key"), F.col("o_orderkey").alias("id"),
                  F.col("o_orderkey").alias("range_from"), F.col("o_orderkey").alias("range_to"), F.lit("").alias("created_at"),
                  X.story_date_key(_story_time()).alias("date"))
    return L.order_events(ev).select(F.col("id").alias("o_orderkey"), "position")


@query("related_event_order")
def _(spark, sf):
    # undated events placed by their relation to the level-1 row they come from
    l = B.l1(spark, sf)
    anchors = l.select("chat_key", "id", F.col("frame").alias("frame_key"), "range_to", "relation")
    f = B.facts(spark, sf).join(l.select("chat_key", "range_from", F.col("id").alias("reference_id"), "k"), ["chat_key", "range_from"], "left")
    relation = F.when(F.col("event_id") % 5 == 0, "before").when(F.col("event_id") % 5 == 1, "same-period").when(F.col("event_id") % 5 == 2, "after").otherwise("unknown")
    ev = f.select("chat_key", "id", F.col("seq").alias("range_from"), F.col("seq").alias("range_to"), F.lit("").alias("created_at"), "reference_id", relation.alias("relation"),
                  F.lit(None).cast("struct<family:string,value:bigint>").alias("date"))
    return L.order_events(ev, anchors).select("chat_key", "id", "source_slot", "position")


# ---- D7, G5, D14-D17, C35, C36, F7 -----------------------------------------------------------
fragment("l2", """
SELECT chat_key, g // 3 AS group_no, 'P' || chat_key || '-' || (g // 3) AS pid, count(*) AS children, min(range_from) AS range_from,
  max(range_to) AS range_to, string_agg(id, '|' ORDER BY range_from) AS child_ids,
  string_agg(DISTINCT frame, ',' ORDER BY frame) AS frames
FROM l1 GROUP BY chat_key, g // 3 HAVING count(*) = 3
""", ("l1",))


def _l2(spark, sf):
    rows = B.l1(spark, sf)
    span = F.struct(F.col("chat_key").alias("chat_key"), "range_from", "range_to")
    g = G.parent_groups(rows, rows.filter(F.lit(False)).select("chat_key", "id"), 3)
    return H.rollup(g.select("chat_key", "group_no", "id", "range_from", "range_to", F.array("id").alias("anchor_ids"),
                             F.array("frame").alias("frames"), F.array(span).alias("sources")), 2)


@query("rollup_l2", sql("""
SELECT chat_key, group_no, range_from, range_to, child_ids, frames, children AS n_sources FROM l2
""", "l2"))
def _(spark, sf):
    return _l2(spark, sf).select("chat_key", "group_no", "range_from", "range_to", F.array_join("child_ids", "|").alias("child_ids"),
                                 F.array_join(F.array_sort("frames"), ",").alias("frames"), F.size("sources").alias("n_sources"))


@query("rollup_l3", sql("""
SELECT chat_key, group_no // 2 AS group_no, min(range_from) AS range_from, max(range_to) AS range_to, count(*) AS children,
       CAST(sum(children) AS BIGINT) AS n_sources FROM l2 GROUP BY chat_key, group_no // 2 HAVING count(*) = 2
""", "l2"))
def _(spark, sf):
    l2 = _l2(spark, sf).drop("group_no")
    g = G.parent_groups(l2, l2.filter(F.lit(False)).select("chat_key", "id"), 2)
    return H.rollup(g, 3).select("chat_key", "group_no", "range_from", "range_to", F.size("child_ids").alias("children"),
                                 F.size("sources").alias("n_sources"))


@query("hierarchy_retention", sql("""
SELECT l2.chat_key, l2.range_from FROM l2 WHERE NOT EXISTS (
  SELECT 1 FROM l1 WHERE l1.chat_key = l2.chat_key AND l1.g // 3 = l2.group_no AND l1.event_id % 9 = 0)
""", "l2", "l1"))
def _(spark, sf):
    alive = B.l1(spark, sf).filter(F.col("event_id") % 9 != 0)
    return H.retained_parents(_l2(spark, sf), alive).select("chat_key", "range_from")


@query("apply_corrections", sql("""
SELECT chat_key, 'facts' AS category, id, CASE WHEN event_id % 20 = 5 THEN 'fixed' ELSE value END AS body,
       CASE WHEN event_id % 20 = 5 THEN 'c' || event_id END AS correction_id FROM fact WHERE event_id % 20 <> 0
UNION ALL SELECT chat_key, 'facts', 'f-c' || event_id || '-' || seq, 'new', 'c' || event_id FROM fact WHERE event_id % 20 = 7
""", "fact"))
def _(spark, sf):
    f = B.facts(spark, sf)
    rec = f.select("chat_key", F.lit("facts").alias("category"), "id", F.col("value").alias("body"), F.lit(None).cast("string").alias("correction_id"))
    k = F.col("event_id") % 20
    ops = f.filter(k.isin(0, 5, 7)).select(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("correction_id"), "chat_key", F.lit("facts").alias("category"),
        F.when(k == 0, "delete").when(k == 5, "update").otherwise("add").alias("action"), F.col("id").alias("target_id"),
        F.when(k == 5, "fixed").otherwise("new").alias("body"), F.col("seq").alias("applied_seq"))
    return M.apply_corrections(rec, ops)


@query("correction_cascade", sql("""
WITH t AS (SELECT DISTINCT chat_key, range_from FROM fact WHERE event_id % 200 = 0),
a AS (SELECT l1.* FROM l1 JOIN t USING (chat_key, range_from)),
d2 AS (SELECT DISTINCT chat_key, group_no FROM l2 JOIN a USING (chat_key) WHERE a.g // 3 = l2.group_no),
p3 AS (SELECT chat_key, group_no // 2 AS g3 FROM l2 GROUP BY ALL HAVING count(*) = 2)
SELECT 'l1' AS level, count(*) AS n FROM a UNION ALL SELECT 'l2', count(*) FROM d2
UNION ALL SELECT 'l3', count(*) FROM (SELECT DISTINCT d2.chat_key, g3 FROM d2 JOIN p3 ON p3.chat_key = d2.chat_key AND p3.g3 = d2.group_no // 2)
""", "fact", "l1", "l2"))
def _(spark, sf):
    f = B.facts(spark, sf)
    ops = f.filter(F.col("event_id") % 200 == 0).select("chat_key", F.lit("facts").alias("category"), F.col("id").alias("target_id"))
    rr = f.select("chat_key", F.lit("facts").alias("category"), "id", "range_from", "range_to")
    l2 = _l2(spark, sf)
    g = G.parent_groups(l2.drop("group_no"), l2.filter(F.lit(False)).select("chat_key", "id"), 2)
    a, d2, d3 = M.correction_cascade(ops, rr, B.l1(spark, sf), l2, H.rollup(g, 3))
    n = lambda df, name: df.agg(F.lit(name).alias("level"), F.count(F.lit(1)).alias("n"))
    return n(a, "l1").unionByName(n(d2, "l2")).unionByName(n(d3, "l3"))


@query("replace_range", sql("""
WITH f AS (SELECT chat_key, id, range_from AS a, CASE WHEN event_id % 3 = 0 THEN range_from + 8 END AS b FROM fact)
SELECT id, concat_ws(',', CASE WHEN a % 24 <> 0 THEN a END, CASE WHEN b % 24 <> 0 THEN b END) AS sources
FROM f WHERE a % 24 <> 0 OR coalesce(b % 24, 0) <> 0
""", "fact"))
def _(spark, sf):
    span = lambda off: F.struct(F.col("chat_key").alias("chat_key"), (F.col("range_from") + off).alias("range_from"), (F.col("range_to") + off).alias("range_to"))
    f = B.facts(spark, sf).withColumn("sources", F.when(F.col("event_id") % 3 == 0, F.array(span(0), span(8))).otherwise(F.array(span(0))))
    top = f.select("chat_key", F.explode("sources").alias("s")).select("chat_key", "s.range_from", "s.range_to").filter(F.col("range_from") % 24 == 0)
    return M.strip_ranges(f.select("chat_key", "id", "sources"), top).select(
        "id", F.array_join(F.transform("sources", lambda s: s["range_from"].cast("string")), ",").alias("sources"))


@query("undo_latest", sql("""
SELECT chat_key, max(range_from) AS range_from, max(range_to) AS range_to, count(*) - 1 AS retained_l1 FROM rng GROUP BY chat_key
""", "rng"))
def _(spark, sf):
    return M.undo_latest(B.ranges(spark, sf))


@query("replay_ranges", sql("""
WITH last AS (SELECT chat_key, max(range_to) AS rt FROM rng GROUP BY chat_key),
f AS (SELECT fact.* FROM fact JOIN rng USING (chat_key, range_from, range_to) JOIN last USING (chat_key) WHERE fact.range_to < rt)
SELECT chat_key, predicate, category, coalesce(any_value(o.old), arg_min(id, (range_to, seq))) AS id, count(*) AS merged,
       arg_max(value, (corrected, range_to, seq)) AS value
FROM f JOIN (SELECT chat_key, predicate, category, arg_min(id, (range_to, seq)) AS old FROM fact GROUP BY ALL) o USING (chat_key, predicate, category)
GROUP BY chat_key, predicate, category
""", "fact", "rng"))
def _(spark, sf):
    r = B.ranges(spark, sf)
    last = M.undo_latest(r).select("chat_key", "range_to")
    kept = r.join(last, ["chat_key", "range_to"], "left_anti")
    f = B.facts(spark, sf)
    keys = ["chat_key", "predicate", "category"]
    new = M.replay(f, kept, keys, ["value"])
    return M.restore_replay_ids(new, M.merge_records(f, keys, ["value"]), keys).drop("last_range_to")


@query("replay_memory", sql("""
WITH last AS (SELECT chat_key, max(range_to) AS rt FROM rng GROUP BY chat_key),
kept AS (SELECT chat_key, range_from, range_to FROM rng JOIN last USING (chat_key) WHERE range_to < rt),
nt AS (SELECT chat_key, max(range_to) AS nt FROM kept GROUP BY chat_key),
f AS (SELECT chat_key, predicate, category, arg_min(id, (range_to, seq)) AS own, arg_max(value, (corrected, range_to, seq)) AS body FROM fact SEMI JOIN kept USING (chat_key, range_from, range_to) GROUP BY ALL),
fo AS (SELECT chat_key, predicate, category, 'old-' || arg_min(id, (range_to, seq)) AS old FROM fact GROUP BY ALL),
s AS (SELECT * FROM state SEMI JOIN kept USING (chat_key, range_from, range_to) QUALIFY row_number() OVER (PARTITION BY chat_key, attribute ORDER BY range_to DESC, seq DESC) = 1),
so AS (SELECT chat_key, attribute, 'old-' || id AS old FROM state WHERE operation = 'set' QUALIFY row_number() OVER (PARTITION BY chat_key, attribute ORDER BY range_to DESC, seq DESC) = 1),
e AS (SELECT chat_key, predicate, seq % 3 AS k, range_from, max('old-' || id) AS id FROM fact SEMI JOIN kept USING (chat_key, range_from, range_to) GROUP BY ALL)
SELECT 'facts' AS category, f.chat_key, old AS id, body FROM f JOIN fo USING (chat_key, predicate, category)
UNION ALL SELECT 'states', s.chat_key, coalesce(old, s.id), value FROM s JOIN nt USING (chat_key) LEFT JOIN so USING (chat_key, attribute)
  WHERE operation = 'set' AND (scope = 'ongoing' OR range_to = nt)
UNION ALL SELECT 'events', chat_key, id, predicate || k FROM e
UNION ALL SELECT 'l1', l1.chat_key, 'old-' || id, CAST(k AS VARCHAR) FROM l1 SEMI JOIN kept USING (chat_key, range_from, range_to)
""", "fact", "state", "l1", "rng"))
def _(spark, sf):
    r = B.ranges(spark, sf)
    kept = r.join(M.undo_latest(r).select("chat_key", "range_to"), ["chat_key", "range_to"], "left_anti")
    f, s = B.facts(spark, sf), B.states(spark, sf)
    e = f.select("chat_key", "id", F.concat("predicate", (F.col("seq") % 3).cast("string")).alias("title"), F.lit("same").alias("summary"), "range_from", "range_to", "seq")
    l = B.l1(spark, sf).withColumn("seq", F.col("range_from"))
    keys = ["chat_key", "subject", "predicate", "category"]
    old = lambda df: df.withColumn("id", F.concat(F.lit("old-"), "id"))
    newest = Window.partitionBy("chat_key", "attribute").orderBy(F.col("range_to").desc(), F.col("seq").desc())
    previous = {
        "facts": old(M.merge_records(f, keys, ["value"])), "events": old(e), "l1": old(l),
        "states": old(s.filter(F.col("operation") == "set").withColumn("n", F.row_number().over(newest)).filter("n = 1")),
    }
    new = RP.replay_memory({"facts": f, "states": s, "events": e, "l1": l}, kept, previous)
    body = {"facts": "value", "states": "value", "events": "title", "l1": "k"}
    out = None
    for category, df in new.items():
        part = df.select(F.lit(category).alias("category"), "chat_key", "id", F.col(body[category]).cast("string").alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


@query("remove_chats", sql("""
WITH gone AS (SELECT DISTINCT chat_key FROM ev WHERE CAST(chat_key AS BIGINT) % 7 = 0),
f AS (SELECT chat_key, id, chat_key IN (SELECT chat_key FROM gone) AS own, CAST(CAST(chat_key AS BIGINT) + 1 AS VARCHAR) IN (SELECT chat_key FROM gone) AS next, event_id % 3 = 0 AS two FROM fact)
SELECT 'facts' AS category, chat_key, id, CASE WHEN NOT own AND two AND NOT next THEN 2 ELSE 1 END AS sources FROM f WHERE NOT own OR (two AND NOT next)
UNION ALL SELECT 'l1', chat_key, id, 0 FROM l1 ANTI JOIN gone USING (chat_key)
UNION ALL SELECT 'l2', chat_key, 'L2-' || chat_key || '-' || range_from, 0 FROM l2 ANTI JOIN gone USING (chat_key)
""", "fact", "l1", "l2", "ev"))
def _(spark, sf):
    chat = F.col("chat_key").cast("long")
    span = lambda c: F.struct(c.alias("chat_key"), "range_from", "range_to")
    own, following = span(F.col("chat_key")), span((chat + 1).cast("string"))
    f = B.facts(spark, sf).withColumn("sources", F.when(F.col("event_id") % 3 == 0, F.array(own, following)).otherwise(F.array(own)))
    l2 = _l2(spark, sf).withColumn("id", F.concat_ws("-", F.lit("L2"), "chat_key", F.col("range_from").cast("string")))
    gone = B.event_messages(spark, sf).filter(chat % 7 == 0).select("chat_key").distinct()
    left = RP.remove_chats({"facts": f, "l1": B.l1(spark, sf), "l2": l2}, gone)
    none = F.lit(0).alias("sources")
    told = left["facts"].select(F.lit("facts").alias("category"), "chat_key", "id", F.size("sources").alias("sources"))
    for level in ("l1", "l2"):
        told = told.unionByName(left[level].select(F.lit(level).alias("category"), "chat_key", "id", none))
    return told


@query("reset_audit", sql("""
SELECT chat_key, 'facts' AS category, count(*) AS residual FROM fact WHERE NOT corrected GROUP BY chat_key
UNION ALL SELECT chat_key, 'l1', count(*) FROM l1 GROUP BY chat_key
""", "fact", "l1"))
def _(spark, sf):
    f = B.facts(spark, sf).select("chat_key", F.lit("facts").alias("category"), "id", F.when(F.col("corrected"), F.concat(F.lit("c"), "id")).alias("correction_id"))
    l = B.l1(spark, sf).select("chat_key", F.lit("l1").alias("category"), "id", F.lit(None).cast("string").alias("correction_id"))
    c = f.filter(F.col("correction_id").isNotNull()).select("chat_key", F.col("correction_id").alias("id"))
    return M.reset_audit(f.unionByName(l), c)


@query("nearest_l1_for_event", sql("""
WITH lx AS (SELECT chat_key, id, 'p' || (k % 5) AS p, 'place ' || (k % 7) AS loc, 't' || (k % 3) AS tw FROM l1),
e AS (SELECT chat_key, 'x' || event_id AS id, 'p' || (k % 6) AS p, 'place ' || (k % 11) AS loc, 't' || (k % 2) AS tw FROM ev),
s AS (SELECT e.id AS event_id, lx.id AS l1_id, 12 * CAST(e.p = lx.p AS INT) + 10 * CAST(e.loc = lx.loc AS INT) + 4 * CAST(e.tw = lx.tw AS INT) AS score
      FROM e JOIN lx USING (chat_key)),
b AS (SELECT event_id, arg_max(l1_id, (score, l1_id)) AS l1_id, max(score) AS score FROM s WHERE score >= 12 GROUP BY event_id)
SELECT e.id AS event_id, l1_id, CAST(score AS BIGINT) AS score FROM e LEFT JOIN b ON b.event_id = e.id
""", "l1", "ev"))
def _(spark, sf):
    k = F.col("k")
    tag = lambda p, m: F.concat(F.lit(p), (k % m).cast("string"))
    none = F.array().cast("array<string>").alias("words")
    l = B.l1(spark, sf).select("chat_key", "id", F.array(tag("p", 5)).alias("participants"), tag("place ", 7).alias("location"), F.array(tag("t", 3)).alias("time_words"), none)
    e = B.event_messages(spark, sf).select(
        "chat_key", F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("id"), F.array(tag("p", 6)).alias("participants"),
        tag("place ", 11).alias("location"), F.array(tag("t", 2)).alias("time_words"), none)
    return M.nearest_l1_for_event(e, l).select("event_id", "l1_id", "score")


@query("event_chronology", sql("""
WITH lx AS (SELECT chat_key, id, k, 'p' || (k % 5) AS p, 'place ' || (k % 7) AS loc, 't' || (k % 3) AS tw FROM l1),
e AS (SELECT chat_key, 'x' || event_id AS id, 'p' || (k % 6) AS p, 'place ' || (k % 11) AS loc, 't' || (k % 2) AS tw, event_id, k FROM ev),
s AS (SELECT e.id AS event_id, lx.id AS l1_id, 12 * CAST(e.p = lx.p AS INT) + 10 * CAST(e.loc = lx.loc AS INT) + 4 * CAST(e.tw = lx.tw AS INT) AS score
      FROM e JOIN lx USING (chat_key)),
b AS (SELECT event_id, arg_max(l1_id, (score, l1_id)) AS l1_id FROM s WHERE score >= 12 GROUP BY event_id),
n AS (SELECT e.*, l1_id, 'turn ' || e.event_id AS line, CASE WHEN e.k % 2 = 0 THEN 'cost ' || e.event_id ELSE '' END AS outcome FROM e LEFT JOIN b ON b.event_id = e.id),
g AS (SELECT l1_id, list(line ORDER BY id) AS lines, coalesce(string_agg(outcome, ' ' ORDER BY id) FILTER (outcome <> ''), '') AS outcomes
      FROM (SELECT * FROM n WHERE l1_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chat_key, l1_id ORDER BY id DESC) <= 8) GROUP BY l1_id)
SELECT 'update' AS action, lx.id, array_to_string(list_slice(list_concat(['first ' || k, 'second ' || k], lines), greatest(1, len(lines) - 5), len(lines) + 2), '|') AS beats,
  trim('end ' || k || ' ' || outcomes) AS closing FROM lx JOIN g ON g.l1_id = lx.id
UNION ALL SELECT 'add', 'L1-' || substr(md5(chat_key || '|' || id), 1, 16), line || CASE WHEN outcome <> '' THEN '|' || outcome ELSE '' END, outcome FROM n WHERE l1_id IS NULL
""", "l1", "ev"))
def _(spark, sf):
    k = F.col("k")
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    none = F.array().cast("array<string>").alias("words")
    l = B.l1(spark, sf)
    typed = lambda *own: (F.array(tag("p", k % own[0])).alias("participants"), tag("place ", k % own[1]).alias("location"), F.array(tag("t", k % own[2])).alias("time_words"), none)
    rows = l.select("chat_key", "id", F.lit("t").alias("title"), F.lit("").alias("story_time"), F.lit("").alias("location"), F.array(tag("p", k % 5)).alias("participants"),
                    F.lit("o").alias("opening"), F.array(tag("first ", k), tag("second ", k)).alias("beats"), F.lit("").alias("emotional_arc"), tag("end ", k).alias("closing"), F.lit(5).alias("importance"))
    e = B.event_messages(spark, sf).withColumn("id", tag("x", F.col("event_id")))
    full = e.select("chat_key", "id", F.lit("t").alias("title"), tag("turn ", F.col("event_id")).alias("summary"), F.when(k % 2 == 0, tag("cost ", F.col("event_id"))).alias("consequences"),
                    F.lit("").alias("story_time"), F.lit("").alias("location"), F.array(tag("p", k % 6)).alias("participants"), F.lit(5).alias("importance"))
    nearest = M.nearest_l1_for_event(e.select("chat_key", "id", *typed(6, 11, 2)), l.select("chat_key", "id", *typed(5, 7, 3)))
    return M.event_chronology(full, nearest, rows, keep=8).select("action", "id", F.array_join("beats", "|").alias("beats"), "closing")


@query("hierarchy_exclusion", sql("""
SELECT l1.id FROM l1 WHERE NOT EXISTS (SELECT 1 FROM l2 WHERE l2.chat_key = l1.chat_key AND l2.group_no = l1.g // 3 AND l2.range_from % 48 = 0)
""", "l1", "l2"))
def _(spark, sf):
    sel = _l2(spark, sf).filter(F.col("range_from") % 48 == 0)
    return H.hierarchy_exclusion(B.l1(spark, sf), sel, ["chat_key"]).select("id")
