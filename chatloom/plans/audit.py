"""Named queries over the audit rules, on sentences scripted from the events."""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from ..functions import fixed, text as X
from ..operators import audit as A, entities as E, reconcile as RC
from ..sources.tables import table
from . import bindings as B, ledger  # noqa: F401  (shared fragments)
from .registry import fragment, query, sql

PEOPLE = ("Alba", "Boris", "Celia", "Dorin", "Edda", "Farid", "Greta", "Hugo", "Irma", "Jonas")
_SQL_PEOPLE = "[" + ", ".join(f"'{p}'" for p in PEOPLE) + "]"
ROLE_LIST = ("master", "friend", "rival", "captain")
_SQL_ROLES = "[" + ", ".join(f"'{r}'" for r in ROLE_LIST) + "]"

fragment("script", f"""
SELECT chat_key, idx, event_id, k, {_SQL_PEOPLE}[k % 10 + 1] AS a, {_SQL_PEOPLE}[(k + 3) % 10 + 1] AS b,
       {_SQL_ROLES}[k % 4 + 1] AS role, {B.SOURCED_SQL}, 's' || event_id AS id FROM ev
""", ("ev",))


def _script(spark, sf):
    people, roles = F.array(*[F.lit(p) for p in PEOPLE]), F.array(*[F.lit(r) for r in ROLE_LIST])
    k = F.col("k")
    return B._sourced(B.event_messages(spark, sf)).select(
        "chat_key", "idx", "event_id", "k", F.element_at(people, (k % 10 + 1).cast("int")).alias("a"),
        F.element_at(people, ((k + 3) % 10 + 1).cast("int")).alias("b"), F.element_at(roles, (k % 4 + 1).cast("int")).alias("role"),
        "range_from", "range_to", F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"))


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _n(c):
    return F.col(c).cast("string")


def _people(spark, sf):
    chats = _script(spark, sf).select("chat_key").distinct()
    return chats.select("chat_key", F.explode(F.array(*[F.lit(p) for p in PEOPLE])).alias("name")).select(
        "chat_key", _cat(F.col("chat_key"), "-", F.col("name")).alias("id"), "name", F.lit("person").alias("type"),
        F.array().cast("array<string>").alias("aliases"), F.lit("").alias("description"))


# ---- C23, C24, C42 ---------------------------------------------------------------------
@query("evidence_audit", sql("""
SELECT id, k % 3 = 1 AS unsupported FROM script
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e = _n("event_id")
    core = _cat(F.col("a"), " moved gate", e, " harbor", e, " timber", e, " rope", e)
    text = F.when(F.col("k") % 3 == 1, _cat('"Perhaps ', core, '," said the guard.')).otherwise(_cat(core, "."))
    m = s.select("chat_key", "idx", F.col("b").alias("name"), text.alias("text"))
    rec = s.select("chat_key", "id", F.col("a").alias("identity"), "range_from", "range_to", core.alias("text"))
    return A.evidence_audit(rec, m).select("id", "unsupported")


#: cues of all families, and three words that are none
CUES = (*[re.search(r"\(\?:(?:\w+\|)*?(\w+)\)", p).group(1) for p in fixed.COVERAGE_CUES.values()], "walked", "asked whether", "perhaps")
_CUE_SQL = "[" + ", ".join(f"'{c}'" for c in CUES) + "]"
_STOP24 = ", ".join(f"'{w}'" for w in fixed.COVERAGE_STOP_WORDS)


def audit_terms_sql(text: str) -> str:
    """Distinct words of two and more characters, possessives cut, stop words of beats out."""
    words = f"regexp_extract_all(translate(lower({text}), '’‘‐‑‒–—', '\'\'\'\'-----'), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\'\'-]*')"
    return f"list_distinct(list_filter(list_transform({words}, lambda w: regexp_replace(w, '\'\'s$', '')), lambda w: length(w) > 1 AND w NOT IN ({_STOP24})))"


FAMILY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(beat, '{p[4:]}', 'i') THEN '{n}'" for n, p in fixed.COVERAGE_CUES.items()) + " END"
fragment("turns", """
SELECT conv_id, turn, role, text, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations
""")
fragment("beat", f"""
SELECT conv_id, turn, last, array_to_string(w[1:7], ' ') || ' ' || {_CUE_SQL}[length(text) % {len(CUES)} + 1] || ' it' AS beat FROM turns
""", ("turns",))


@query("uncovered_beats", sql(f"""
WITH t AS (SELECT conv_id, turn, last, {FAMILY_SQL} AS family, {audit_terms_sql('beat')} AS terms FROM beat WHERE NOT regexp_matches(beat, '{fixed.NOT_ASSERTED[4:]}', 'i')),
b AS (SELECT *, CASE WHEN len(terms) >= 5 THEN 3 ELSE 2 END AS need FROM t WHERE family IS NOT NULL AND len(terms) >= 3),
said AS (SELECT DISTINCT conv_id, unnest({audit_terms_sql("role || ': ' || text")}) AS w FROM turns WHERE turn % 2 = 1),
rec AS (SELECT conv_id, turn AS r, unnest({audit_terms_sql("array_to_string(w[4:9], ' ')")}) AS w FROM turns WHERE length(text) % 3 = 0),
x AS (SELECT conv_id, turn, need, unnest(terms) AS w FROM b),
sourced AS (SELECT conv_id, turn FROM x JOIN said USING (conv_id, w) GROUP BY conv_id, turn, need HAVING count(*) >= need),
covered AS (SELECT DISTINCT conv_id, turn FROM (SELECT x.conv_id, x.turn, r FROM x JOIN rec USING (conv_id, w) GROUP BY x.conv_id, x.turn, r, need HAVING count(*) >= need))
SELECT conv_id, turn, family FROM b SEMI JOIN sourced USING (conv_id, turn) ANTI JOIN covered USING (conv_id, turn)
""", "turns", "beat"))
def _(spark, sf):
    last = Window.partitionBy("conv_id")
    t = table(spark, sf, "conversations").withColumn("range_to", F.max("turn").over(last).cast("long")).withColumn("w", F.split(X.normalize_text("text"), " "))
    t = t.withColumn("chat_key", F.col("conv_id").cast("string")).withColumn("range_from", F.lit(0).cast("long"))
    some = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cue = F.element_at(F.array(*[F.lit(c) for c in CUES]), (F.length("text") % len(CUES) + 1).cast("int"))
    beats = t.select("chat_key", F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "range_from", "range_to", _cat(some(1, 7), " ", cue, " it").alias("beat"))
    m = t.filter(F.col("turn") % 2 == 1).select("chat_key", F.col("turn").cast("long").alias("idx"), F.col("role").alias("name"), "text")
    rec = t.filter(F.length("text") % 3 == 0).select("chat_key", "range_from", "range_to", some(4, 6).alias("text"))
    return A.uncovered_beats(beats, m, rec).select("conv_id", "turn", "family")


@query("l1_epistemic_beats", sql("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY chat_key, range_from ORDER BY 1 + event_id % 5 DESC, id) AS rn FROM script WHERE k % 3 = 0)
SELECT l1.id, 1 + (SELECT count(*) FROM f WHERE f.chat_key = l1.chat_key AND f.range_from = l1.range_from AND rn <= 2) AS n_beats,
  coalesce((SELECT string_agg(a || ' knows item ' || event_id, '|' ORDER BY rn) FROM f WHERE f.chat_key = l1.chat_key AND f.range_from = l1.range_from AND rn <= 2), '') AS extra FROM l1
""", "script", "l1"))
def _(spark, sf):
    s = _script(spark, sf)
    f = s.filter(F.col("k") % 3 == 0).select("chat_key", "range_from", "range_to", "id", F.col("a").alias("subject"), _cat("knows item ", _n("event_id")).alias("value"),
                                             F.lit("knowledge").alias("category"), (1 + F.col("event_id") % 5).alias("importance"))
    l = B.l1(spark, sf).select("chat_key", "range_from", "range_to", "id", F.array(F.lit("start")).alias("beats"), F.lit("quiet").alias("text"))
    r = A.l1_epistemic_beats(l, f, most=2, keep=10)
    return r.select("id", F.size("beats").alias("n_beats"), F.array_join(F.slice("beats", 2, 10), "|").alias("extra"))


# ---- C25, C26 ----------------------------------------------------------------------------
@query("resolve_threads", sql("""
SELECT id || x AS id, status, resolution FROM (SELECT id, k, unnest(CASE
   WHEN k % 5 = 0 THEN [{'x': '', 'status': 'resolved', 'resolution': 'closed'}]
   WHEN k % 5 = 1 THEN [{'x': '', 'status': 'resolved', 'resolution': 'part'}, {'x': '#next', 'status': 'open', 'resolution': 'successor'}]
   WHEN k % 5 = 2 THEN [{'x': '', 'status': 'open', 'resolution': 'reopened'}] ELSE [{'x': '', 'status': 'open', 'resolution': 'kept'}] END) AS o FROM script),
  LATERAL (SELECT o.x AS x, o.status AS status, o.resolution AS resolution)
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e, k = _n("event_id"), F.col("k")
    title = F.when(k % 5 == 1, _cat("Recover cup", e, " and Deliver map", e)).otherwise(_cat("Recover relic", e, " chest", e))
    t = s.select("chat_key", "id", title.alias("title"), F.when(k % 5 == 2, "the matter is still pending").otherwise("a quest").alias("detail"),
                 F.when(k % 5 == 2, "resolved").otherwise("open").alias("status"), F.array("a").alias("participants"), "range_from", "range_to")
    line = (F.when(k % 5 == 0, _cat(F.col("a"), " recovered relic", e, " from chest", e, ".")).when(k % 5 == 1, _cat(F.col("a"), " recovered cup", e, " recover."))
            .when(k % 5 == 3, _cat(F.col("a"), " will recover relic", e, " from chest", e, ".")).otherwise(_cat(F.col("a"), " rested at inn", e, ".")))
    ev = s.select("chat_key", "range_from", "range_to", line.alias("text"))
    m = s.select("chat_key", "idx", F.col("b").alias("name"), line.alias("text"))
    return A.resolve_threads(t, ev, m).select("id", "status", "resolution")


@query("resolve_identity_threads", sql("""
SELECT id, CASE WHEN k % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM script UNION ALL SELECT id || '#next', 'open' FROM script WHERE k % 6 = 0
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e, k = _n("event_id"), F.col("k")
    t = s.select("chat_key", "id", _cat("Identity of the masked", e, " rider", e).alias("title"), F.when(k % 2 == 0, "The motive is still unclear.").otherwise("Nothing more.").alias("detail"), F.lit("open").alias("status"))
    r = s.filter(k % 3 == 0).select("chat_key", _cat("the masked", e, " rider", e).alias("reference"), F.col("a").alias("canonical"))
    return A.resolve_identity_threads(t, r).select("id", "status")


# ---- C28, C46 -----------------------------------------------------------------------------
def _address(spark, sf):
    s = _script(spark, sf).filter(F.col("k") % 10 != (F.col("k") + 3) % 10)
    e, k = _n("event_id"), F.col("k")
    form = F.when(k % 5 == 3, "you").when(k % 5 == 4, "[speaker]").otherwise(_cat("Chief", e))
    f = s.select("chat_key", "id", "range_from", "range_to", F.col("a").alias("subject"), _cat("calls ", F.col("b")).alias("predicate"), form.alias("value"), F.lit("form of address").alias("category"))
    line = F.when(k % 5 <= 1, _cat("Come here, Chief", e, "!")).otherwise("Nothing to say.")
    m = s.select("chat_key", "idx", F.when(k % 5 == 1, F.col("b")).otherwise(F.col("a")).alias("name"), line.alias("text"))
    return f, m


_ADDRESS_SQL = "CASE k % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'flip' WHEN 2 THEN 'drop-unsupported' WHEN 3 THEN 'drop-pronoun' ELSE 'drop-malformed' END"


@query("address_form_audit", sql(f"SELECT id, {_ADDRESS_SQL} AS verdict FROM script", "script"))
def _(spark, sf):
    return A.address_form_audit(*_address(spark, sf)).select("id", "verdict")


fragment("aforms", """
SELECT conv_id, turn, role AS speaker, CASE length(text) % 3 WHEN 0 THEN 'uses nickname' ELSE 'calls ' || lower(w[1]) END AS predicate,
  CASE WHEN length(text) % 3 = 0 THEN 'social address' ELSE 'form of address' END AS category,
  list_distinct(list_filter([lower(w[2]), lower(w[3]), lower(w[4])], lambda f: f IS NOT NULL)) AS forms, CASE turn % 3 WHEN 0 THEN '' ELSE 'a' || (turn % 2) END AS anchor FROM turns
""", ("turns",))


# each turn is an address fact: its words are forms, its role the speaker, its first word the addressee if it names one
@query("fold_generic_addresses", sql(r"""
WITH f AS (SELECT *, category = 'social address' AS generic, substr(regexp_replace(predicate, '\s*[.!?]$', ''), 7) AS to_ FROM aforms),
m AS (SELECT DISTINCT g.conv_id, g.turn, n.to_, n.anchor, n.conv_id || '-' || n.turn AS id FROM f g JOIN f n ON g.conv_id = n.conv_id AND g.speaker = n.speaker
  WHERE g.generic AND NOT n.generic AND n.to_ <> '' AND (g.anchor = '' OR n.anchor = '' OR g.anchor = n.anchor) AND len(list_intersect(g.forms, n.forms)) > 0),
one AS (SELECT conv_id, turn, min(id) AS into_ FROM m GROUP BY ALL HAVING count(DISTINCT (to_, anchor)) = 1),
gain AS (SELECT into_, count(*) AS n FROM one GROUP BY into_)
SELECT f.conv_id || '-' || turn AS id, generic, coalesce(n, 0) AS folded FROM f LEFT JOIN gain ON into_ = f.conv_id || '-' || turn WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM one)
""", "aforms"))
def _(spark, sf):
    t = table(spark, sf, "conversations").withColumn("w", F.split(X.normalize_text("text"), " "))
    third = F.length("text") % 3 == 0
    source = F.struct(F.col("conv_id").alias("chat"), F.col("turn").cast("long").alias("turn"))
    f = t.select(
        F.col("conv_id").cast("string").alias("chat_key"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("subject"),
        F.when(third, "uses nickname").otherwise(_cat("calls ", F.lower(F.col("w")[0]))).alias("predicate"), F.array_join(F.slice("w", 2, 3), "; ").alias("value"),
        F.when(third, "social address").otherwise("form of address").alias("category"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(_cat("a", (F.col("turn") % 2).cast("string"))).alias("temporal_anchor_id"),
        F.lit(3).alias("importance"), F.array(source).alias("sources"))
    out = A.fold_generic_addresses(f)
    return out.select("id", (F.col("category") == "social address").alias("generic"), (F.size("sources") - 1).cast("long").alias("folded"))


@query("audit_stored_addresses", sql(f"SELECT id, CASE WHEN event_id % 7 = 0 THEN 'keep' ELSE {_ADDRESS_SQL} END AS verdict FROM script", "script"))
def _(spark, sf):
    f, m = _address(spark, sf)
    fixed_ids = f.filter(F.substring("id", 2, 20).cast("long") % 7 == 0).select("chat_key", "id")
    return A.audit_stored_addresses(f, m, fixed_ids).select("id", "verdict")


@query("apply_address_audit", sql("""
WITH v AS (SELECT chat_key, lower(CASE WHEN k % 5 = 1 THEN b ELSE a END) AS s, lower(CASE WHEN k % 5 = 1 THEN a ELSE b END) AS o, 'Chief' || event_id AS form FROM script WHERE k % 5 <= 1)
SELECT chat_key, s AS subject, 'calls ' || o AS predicate, string_agg(form, '; ' ORDER BY form) AS value FROM v GROUP BY chat_key, s, o
""", "script"))
def _(spark, sf):
    return A.apply_address_audit(A.address_form_audit(*_address(spark, sf))).select("chat_key", "subject", "predicate", "value")


# ---- C29, C30 ------------------------------------------------------------------------------
@query("knowledge_boundaries", sql("""
SELECT 'b' || event_id AS id, CASE WHEN k % 4 = 1 THEN 'retired' WHEN k % 4 = 2 THEN 'answered' ELSE 'kept' END AS verdict FROM script
UNION ALL SELECT 'k' || event_id, CASE WHEN k % 4 = 0 THEN 'withheld' ELSE 'kept' END FROM script WHERE k % 4 <= 1
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e, k = _n("event_id"), F.col("k")
    topic = _cat("Rider", e)
    b = s.select("chat_key", _cat("b", e).alias("id"), F.col("a").alias("subject"), _cat("knowledge of ", topic).alias("predicate"),
                 _cat(F.col("a"), " does not know the secret", e, " passage", e).alias("value"), F.lit("knowledge boundary").alias("category"), F.lit(1).alias("seq"))
    kn = s.filter(k % 4 <= 1).select("chat_key", _cat("k", e).alias("id"), F.col("a").alias("subject"), _cat("knowledge of ", topic).alias("predicate"),
                                     _cat("found the secret", e, " passage", e).alias("value"), F.lit("knowledge").alias("category"), F.lit(2).alias("seq"))
    m = s.select("chat_key", "idx", F.col("b").alias("name"), F.when(k % 4 == 1, _cat(F.col("a"), " learned about ", topic, " today.")).otherwise("Silence.").alias("text"))
    r = s.filter(k % 4 == 2).select("chat_key", topic.alias("reference"))
    return A.knowledge_boundaries(b.unionByName(kn), m, r).select("id", "verdict")


@query("resolve_relational_topics", sql("""
WITH r AS (SELECT chat_key, lower(a) AS h, b AS other, role FROM script WHERE event_id % 25 = 0 UNION ALL SELECT chat_key, lower(b), a, role FROM script WHERE event_id % 25 = 0),
one AS (SELECT chat_key, h, role, min(other) AS other FROM r GROUP BY chat_key, h, role HAVING count(DISTINCT other) = 1)
SELECT id, CASE WHEN other IS NOT NULL AND k % 2 = 0 THEN 'knowledge of ' || other ELSE 'knowledge of ' || CASE WHEN k % 2 = 0 THEN 'her ' ELSE b || '''s ' END || s.role END AS predicate
FROM script s LEFT JOIN one ON one.chat_key = s.chat_key AND one.h = lower(s.a) AND one.role = s.role
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    rel = s.filter(F.col("event_id") % 25 == 0).select("chat_key", F.col("a").alias("endpoint_a"), F.col("b").alias("endpoint_b"), F.col("role").alias("kind"))
    owner = F.when(F.col("k") % 2 == 0, "her ").otherwise(_cat(F.col("b"), "'s "))
    f = s.select("chat_key", "id", F.col("a").alias("subject"), _cat("knowledge of ", owner, F.col("role")).alias("predicate"), F.lit("knowledge").alias("category"))
    return A.resolve_relational_topics(f, rel).select("id", "predicate")


# ---- C31 -------------------------------------------------------------------------------------
@query("derive_aliases", sql("SELECT DISTINCT chat_key || '-' || a AS id, 'Fox' || event_id AS alias FROM script WHERE k % 3 = 0", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    m = s.select("chat_key", "idx", F.col("b").alias("name"), F.when(F.col("k") % 3 == 0, _cat("Rain fell. ", F.col("a"), " is known as Fox", _n("event_id"), ".")).otherwise("Rain fell.").alias("text"))
    return A.derive_aliases(m, _people(spark, sf)).select("id", "alias")


@query("derive_commitments", sql("""
SELECT chat_key, idx AS range_from, b || ' will visit the mill' || event_id || ' tomorrow with lantern' || event_id AS title FROM script WHERE k % 3 = 0 AND event_id % 4 <> 0
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e = _n("event_id")
    text = (F.when(F.col("k") % 3 == 0, _cat("I will visit the mill", e, " tomorrow with lantern", e, "."))
            .when(F.col("k") % 3 == 1, _cat("Maybe I will visit the mill", e, " tomorrow.")).otherwise("I will rest."))
    m = s.select("chat_key", "idx", F.col("b").alias("name"), text.alias("text"))
    t = s.filter(F.col("event_id") % 4 == 0).select("chat_key", "id", _cat("Visit mill", e).alias("title"), _cat("bring lantern", e).alias("detail"), F.lit("open").alias("status"))
    return A.derive_commitments(m, t).select("chat_key", "range_from", "title")


@query("derive_knowledge", sql("SELECT chat_key, idx AS seq, a AS subject, 'knowledge of ' || b AS predicate FROM script WHERE k % 3 = 0", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    core = _cat(F.col("a"), " knew of ", F.col("b"), " and tower", _n("event_id"))
    m = s.select("chat_key", "idx", F.col("b").alias("name"), F.when(F.col("k") % 3 == 0, _cat(core, ".")).when(F.col("k") % 3 == 1, _cat("Perhaps ", core, ".")).otherwise("Rain fell.").alias("text"))
    none = s.limit(0).select("chat_key", F.col("a").alias("subject"), F.col("b").alias("predicate"))
    return A.derive_knowledge(m, _people(spark, sf), none).select("chat_key", "seq", "subject", "predicate")


@query("derive_relationships", sql("""
WITH f AS (SELECT *, least(lower(a), lower(b)) || '|' || greatest(lower(a), lower(b)) AS pk FROM script WHERE k % 2 = 0),
st AS (SELECT DISTINCT chat_key, least(lower(a), lower(b)) || '|' || greatest(lower(a), lower(b)) AS pk FROM script WHERE event_id % 40 = 0)
SELECT chat_key, pk, arg_min(role, id) AS kind FROM f WHERE (chat_key, pk) NOT IN (SELECT (chat_key, pk) FROM st) GROUP BY chat_key, pk
""", "script"))
def _(spark, sf):
    from ..operators.merge import pair_key

    s = _script(spark, sf)
    f = s.select("chat_key", "id", F.col("a").alias("subject"), F.lit("bond").alias("predicate"), _cat("the ", F.col("role"), " of ", F.col("b")).alias("value"),
                 F.when(F.col("k") % 2 == 0, "tie").otherwise("belief").alias("category"), F.lit("persistent").alias("persistence"))
    rel = s.filter(F.col("event_id") % 40 == 0).select("chat_key", F.col("b").alias("endpoint_a"), F.col("a").alias("endpoint_b"))
    r = A.derive_relationships(f, _people(spark, sf), rel)
    return r.select("chat_key", pair_key().alias("pk"), "kind")


@query("derive_identity_gaps", sql("SELECT 'gap-' || id AS id, 'Identity behind Rider' || event_id AS title FROM script WHERE k % 3 = 0 AND event_id % 4 <> 0", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e = _n("event_id")
    f = s.select("chat_key", "id", F.col("a").alias("subject"), _cat("knowledge of Rider", e).alias("predicate"),
                 F.when(F.col("k") % 3 == 0, _cat(F.col("a"), " does not know who Rider", e, " is")).otherwise("knows all").alias("value"))
    t = s.filter(F.col("event_id") % 4 == 0).select("chat_key", _cat("identity behind rider", e).alias("title"))
    return A.derive_identity_gaps(f, t).select("id", "title")


# ---- C32, C33, C37-C41 -------------------------------------------------------------------------
@query("consistency_warnings", sql("""
WITH own AS (SELECT chat_key, 'item ' || (k % 20) AS item, min(lower(a)) AS x, max(lower(a)) AS y FROM script WHERE event_id % 4 = 0 GROUP BY ALL HAVING min(lower(a)) <> max(lower(a))),
loc AS (SELECT DISTINCT chat_key, lower(a) AS a, 'dock' || (k % 7) AS v FROM script WHERE event_id % 4 = 1 AND a IN ('Alba', 'Boris') AND k % 7 <> 0),
old AS (SELECT chat_key, lower(a) AS s, 'rank' || (k % 5) AS v FROM script WHERE event_id % 4 = 2), nw AS (SELECT chat_key, lower(a) AS s, 'rank' || (k % 3) AS v FROM script WHERE event_id % 4 = 3)
SELECT chat_key, 'possession' AS kind, item AS about, x || ' / ' || y AS detail FROM own
UNION ALL SELECT chat_key, 'location', a, v || ' / dock0' FROM loc
UNION ALL SELECT DISTINCT n.chat_key, 'fact change', n.s || ' - rank', o.v || ' / ' || n.v FROM nw n JOIN old o ON o.chat_key = n.chat_key AND o.s = n.s AND o.v <> n.v
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e, k = F.col("event_id") % 4, F.col("k")
    base = ["chat_key", F.col("a").alias("subject")]
    set_ = F.lit("set").alias("operation")
    st = s.filter(e == 0).select(*base, F.lit("holds").alias("attribute"), _cat("Item ", (k % 20).cast("string")).alias("value"), set_).unionByName(
        s.filter(e == 1).select(*base, F.lit("whereabouts").alias("attribute"), _cat("dock", (k % 7).cast("string")).alias("value"), set_))
    sc = s.select("chat_key").distinct().select("chat_key", F.lit("dock0").alias("location"), F.array(F.lit("Alba"), F.lit("Boris")).alias("participants"))
    fact = lambda n, m: s.filter(e == n).select(*base, F.lit("rank").alias("predicate"), F.lit("role").alias("category"), _cat("rank", (k % m).cast("string")).alias("value"))
    none = s.limit(0).select("chat_key", F.col("a").alias("title"), F.col("a").alias("detail"), F.lit("open").alias("status"))
    return A.consistency_warnings(st, sc, fact(3, 3), fact(2, 5), none, most=0).select("chat_key", "kind", "about", "detail")


@query("scene_participants", sql(f"""
WITH sc AS (SELECT l1.*, CAST(chat_key AS BIGINT) % 2 = 0 AS listed FROM l1 QUALIFY row_number() OVER (PARTITION BY chat_key ORDER BY range_to DESC) = 1),
nm AS (SELECT DISTINCT s.chat_key, s.a AS name FROM script s JOIN sc ON sc.chat_key = s.chat_key AND s.idx BETWEEN sc.range_from AND sc.range_to WHERE sc.listed),
p AS (SELECT chat_key, name FROM nm UNION SELECT chat_key, unnest(['Alba', 'Jonas']) FROM sc WHERE NOT listed)
SELECT sc.chat_key, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM p WHERE p.chat_key = sc.chat_key AND name <> 'Jonas'), '') AS participants FROM sc
""", "script", "l1"))
def _(spark, sf):
    from ..operators.records import newest_l1

    s = _script(spark, sf)
    n = newest_l1(B.l1(spark, sf))
    sc = n.select("chat_key", F.col("newest_from").alias("range_from"), F.col("newest_to").alias("range_to"), F.array(F.lit("Alba"), F.lit("Jonas")).alias("participants"))
    text = F.when(F.col("chat_key").cast("long") % 2 == 0, _cat("Positions: ", F.col("a"), " by the door.")).otherwise("Quiet.")
    m = s.select("chat_key", "idx", F.lit("Guide").alias("name"), text.alias("text"))
    dead = n.select("chat_key", F.lit("Jonas").alias("name"))
    r = A.scene_participants(sc, m, _people(spark, sf), dead)
    return r.select("chat_key", F.array_join(F.array_sort("participants"), ",").alias("participants"))


@query("profile_grounding", sql("SELECT 'd' || event_id AS did FROM script WHERE k % 3 = 0", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e = _n("event_id")
    m = s.select("chat_key", "idx", F.lit("Guide").alias("name"), F.when(F.col("k") % 3 == 0, _cat(F.col("a"), " entered. She has hair", e, " and scar", e, ".")).when(
        F.col("k") % 3 == 1, _cat('"', F.col("a"), " has hair", e, " and scar", e, '."')).otherwise("Rain fell.").alias("text"))
    d = s.select("chat_key", _cat(F.col("chat_key"), "-", F.col("a")).alias("id"), F.lit("appearance").alias("field"), _cat("hair", e, ", scar", e).alias("detail"), _cat("d", e).alias("tag"))
    return A.profile_grounding(d, _people(spark, sf), m).select(F.col("tag").alias("did"))


@query("description_enrichment", sql(f"""
WITH p AS (SELECT chat_key, unnest({_SQL_PEOPLE}) AS name FROM (SELECT DISTINCT chat_key FROM script)),
r AS (SELECT chat_key, n, arg_max(d, (imp, length(d), d)) AS rt FROM (SELECT chat_key, a AS n, 'friend since ' || event_id AS d, 1 + event_id % 5 AS imp FROM script
        UNION ALL SELECT chat_key, b, 'friend since ' || event_id, 1 + event_id % 5 FROM script) GROUP BY ALL),
f AS (SELECT chat_key, a AS n, 'role number ' || event_id AS v, row_number() OVER (PARTITION BY chat_key, a ORDER BY length('role number ' || event_id) DESC, 'role number ' || event_id) AS rn
      FROM script WHERE 1 + event_id % 5 >= 4 AND k % 2 = 0),
fx AS (SELECT chat_key, n, string_agg(v, ' ' ORDER BY rn) AS ft FROM f WHERE rn <= 2 GROUP BY ALL)
SELECT p.chat_key || '-' || p.name AS id, coalesce(concat_ws(' ', rt, ft), '') AS description FROM p LEFT JOIN r ON r.chat_key = p.chat_key AND r.n = p.name LEFT JOIN fx ON fx.chat_key = p.chat_key AND fx.n = p.name
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e = _n("event_id")
    imp = (1 + F.col("event_id") % 5).alias("importance")
    rel = s.select("chat_key", F.col("a").alias("endpoint_a"), F.col("b").alias("endpoint_b"), _cat("friend since ", e).alias("dynamic"), imp)
    f = s.select("chat_key", "id", F.col("a").alias("subject"), F.lit("work").alias("predicate"), _cat("role number ", e).alias("value"),
                                                    F.when(F.col("k") % 2 == 0, "trait").otherwise("belief").alias("category"), imp)
    return A.description_enrichment(_people(spark, sf), f, rel).select("id", "description")


@query("contradicted_objects", sql("SELECT id FROM script WHERE k % 4 NOT IN (1, 3)", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e, k = _n("event_id"), F.col("k")
    value = F.when(k % 4 >= 2, _cat("is bound by rope", e)).otherwise(_cat("has amulet", e))
    f = s.select("chat_key", "id", "range_from", "range_to", _cat("Knight", e).alias("subject"), F.lit("condition").alias("predicate"), value.alias("value"))
    text = (F.when(k % 4 == 0, _cat("The knight received amulet", e, ".")).when(k % 4 == 1, _cat("The smith will give amulet", e, ".")).when(k % 4 == 2, "Rain fell.")
            .otherwise(_cat("Knight", e, " was released.")))
    return A.contradicted_objects(f, s.select("chat_key", "idx", F.col("b").alias("name"), text.alias("text"))).select("id")


@query("historical_relationships", sql("""
SELECT id, CASE WHEN k % 3 = 0 OR (k % 3 = 1 AND a IN ('Alba', 'Boris')) THEN 'former mentor' ELSE 'mentor' END AS kind FROM script
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e, k = _n("event_id"), F.col("k")
    a, b = _cat(F.col("a"), e), _cat(F.col("b"), e)
    rel = s.select("chat_key", "id", a.alias("endpoint_a"), b.alias("endpoint_b"), F.lit("mentor").alias("kind"), F.lit("active").alias("status"))
    f = s.select("chat_key", a.alias("subject"), F.lit("history").alias("predicate"), F.when(k % 3 == 0, _cat("was formerly taught by teacher ", b)).when(k % 3 == 1, _cat("student of ", b)).otherwise("likes tea").alias("value"))
    dead = s.filter(F.col("a").isin("Alba", "Boris")).select("chat_key", a.alias("name"))
    return A.historical_relationships(rel, f, dead).select("id", "kind")


@query("pair_description_guard", sql(f"""
SELECT id, CASE WHEN k % 2 = 0 THEN 'old text' ELSE a || ' is the friend of ' || b END AS dynamic FROM script
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    k = F.col("k")
    people = F.array(*[F.lit(p) for p in PEOPLE])
    other = lambda n: F.element_at(people, ((k + n) % 10 + 1).cast("int"))
    text = F.when(k % 2 == 0, _cat(other(1), " is the mentor of ", other(2))).otherwise(_cat(F.col("a"), " is the friend of ", F.col("b")))
    inc = s.select("chat_key", "id", F.col("id").alias("target_id"), F.col("a").alias("endpoint_a"), F.col("b").alias("endpoint_b"), text.alias("dynamic"))
    return A.pair_description_guard(inc, s.select("chat_key", "id", F.lit("old text").alias("dynamic")), _people(spark, sf)).select("id", "dynamic")


# ---- B12, B14, B15, D12, D18, D19 -------------------------------------------------------------------
@query("profile_detail_gate", sql("""
SELECT id, CASE k % 5 WHEN 0 THEN 'appearance' WHEN 1 THEN 'age_demographics' ELSE 'role_background' END AS field FROM script WHERE k % 5 <= 2
""", "script"))
def _(spark, sf):
    k = F.col("k")
    d = _script(spark, sf).select("chat_key", "id", F.lit("appearance").alias("field"), F.when(k % 5 == 0, "Long dark hair").when(k % 5 == 1, "30 years old").when(
        k % 5 == 2, "Former harbor captain").when(k % 5 == 3, "Currently wears a red scarf").otherwise("Perhaps tall").alias("detail"), "idx")
    return A.profile_detail_gate(d).select("id", "field")


@query("normalize_fact_shapes", sql("""
SELECT id, CASE k % 3 WHEN 0 THEN b WHEN 1 THEN b ELSE a END AS subject, CASE k % 3 WHEN 0 THEN 'belief about ' || a WHEN 1 THEN 'knowledge of ' || a ELSE 'knowledge of towers' END AS predicate FROM script
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    k = F.col("k")
    f = s.select("chat_key", "id", F.col("a").alias("subject"), F.when(k % 3 == 0, "trait").when(k % 3 == 1, "knowledge of self").otherwise("knowledge of towers — details").alias("predicate"),
                 F.when(k % 3 == 0, _cat(F.col("b"), " suspects that the gate is open")).when(k % 3 == 1, _cat("is identified by ", F.col("b"))).otherwise("tall ones").alias("value"),
                 F.when(k % 3 == 0, "trait").otherwise("knowledge").alias("category"))
    return A.normalize_fact_shapes(f).select("id", "subject", "predicate")


@query("normalize_relationship_text", sql("""
SELECT id, CASE k % 3 WHEN 0 THEN a || ' is the master of ' || b || '; ' || a || ' and ' || b || ': they argue' WHEN 1 THEN a || ' trusts ' || b || '.' ELSE a || ' and ' || b || ': Close.' END AS dynamic
FROM (SELECT * REPLACE (a || event_id AS a, b || event_id AS b) FROM script)
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    k, e = F.col("k"), _n("event_id")
    a, b = _cat(F.col("a"), e), _cat(F.col("b"), e)
    rel = s.select("chat_key", "id", a.alias("endpoint_a"), b.alias("endpoint_b"), F.when(k % 3 == 0, "they argue").when(
        k % 3 == 1, _cat(a, " trusts ", b, ". ", a, " trusts ", b, ".")).otherwise("Close. Close.").alias("dynamic"))
    stored = s.filter(k % 3 == 0).select("chat_key", a.alias("endpoint_a"), b.alias("endpoint_b"), _cat(a, " is the master of ", b, ". They met once.").alias("dynamic"))
    return A.normalize_relationship_text(rel, stored).select("id", "dynamic")


@query("merge_profiles", sql("""
SELECT chat_key, a AS id, count(DISTINCT k % 5) AS n FROM script GROUP BY chat_key, a
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    d = s.select("chat_key", F.col("a").alias("id"), F.lit("appearance").alias("field"), _cat("scar number", (F.col("k") % 5).cast("string"),
                 F.when(F.col("event_id") % 2 == 0, " on cheek").otherwise("")).alias("detail"), F.col("idx").alias("seq"))
    m = E.merge_profiles(d)
    # a short and a long form of one scar count once
    n = F.size(F.array_distinct(F.transform("details", lambda x: F.regexp_extract(x, r"(number\d)", 1))))
    return m.select("chat_key", "id", n.alias("n"))


@query("merge_descriptions", sql("""
SELECT id, CASE k % 3 WHEN 0 THEN 'Walks alone. Served as harbor guard' || event_id || '.' WHEN 1 THEN 'Old text.' ELSE 'New text.' END AS description FROM script
""", "script"))
def _(spark, sf):
    k, e = F.col("k"), _n("event_id")
    p = _script(spark, sf).select("chat_key", "id", F.when(k % 3 == 0, _cat("Served as harbor guard", e, ". Likes tea.")).when(k % 3 == 1, "Old text.").otherwise("").alias("prior"),
                                  F.when(k % 3 == 0, "Walks alone.").when(k % 3 == 1, "").otherwise("New text.").alias("incoming"))
    return E.merge_descriptions(p).select("id", "description")


@query("reconcile_stored", sql("""
SELECT 'facts' AS part, count(*) FILTER (WHERE k % 4 <> 1) AS n FROM script UNION ALL SELECT 'threads', count(*) FROM script
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    e, k = _n("event_id"), F.col("k")
    f = s.select("chat_key", "id", "range_from", "range_to", _cat("Knight", e).alias("subject"), F.lit("condition").alias("predicate"), _cat("has amulet", e).alias("value"),
                 F.lit("trait").alias("category"), F.lit("persistent").alias("persistence"))
    text = F.when(k % 4 == 1, _cat("The smith will give amulet", e, ".")).otherwise(_cat("The knight received amulet", e, "."))
    m = s.select("chat_key", "idx", F.col("b").alias("name"), text.alias("text"))
    rel = s.limit(0).select("chat_key", "id", F.col("a").alias("endpoint_a"), F.col("b").alias("endpoint_b"), F.lit("").alias("kind"), F.lit("").alias("dynamic"), F.lit("").alias("status"))
    t = s.select("chat_key", "id", _cat("Recover relic", e).alias("title"), F.lit("a quest").alias("detail"), F.lit("open").alias("status"), F.array("a").alias("participants"), "range_from", "range_to")
    out = A.reconcile_stored(f, rel, t, _people(spark, sf), s.select("chat_key", "range_from", "range_to", text.alias("text")), m, s.select("chat_key", "idx"))
    n = lambda part: out[part].agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return n("facts").unionByName(n("threads"))


# ---- D18 whole: an incremental run against the rule over everything ------------------------
# facts of all ranges but the last are a memory that was reconciled before; the last range is what changed
@query("reconcile_memory", sql("""
WITH plain AS (SELECT *, CASE WHEN k % 4 = 1 THEN 'knowledge' ELSE 'trait' END AS cat,
    CASE WHEN k % 4 = 1 THEN 'knowledge of harbor' ELSE 'habit' || (k % 3) END AS pred FROM script),
known AS (SELECT chat_key, a, pred, id, range_to, idx, a || ' knows gate ' || (event_id % 5) || '.' AS sentence FROM plain WHERE cat = 'knowledge'),
first AS (SELECT chat_key, a, pred, sentence, min((range_to, idx)) AS seen FROM known GROUP BY ALL),
grown AS (SELECT chat_key, a, pred, string_agg(sentence, ' ' ORDER BY seen) AS value FROM first GROUP BY ALL)
SELECT 'facts' AS part, chat_key, arg_min(id, (range_to, idx)) AS id, arg_max('sails boat ' || event_id, (range_to, idx)) AS value FROM plain WHERE cat = 'trait' GROUP BY chat_key, a, pred
UNION ALL SELECT 'facts', k.chat_key, arg_min(id, (range_to, idx)), any_value(value) FROM known k JOIN grown g ON k.chat_key = g.chat_key AND k.a = g.a AND k.pred = g.pred GROUP BY k.chat_key, k.a, k.pred
""", "script"))
def _(spark, sf):
    s = _script(spark, sf)
    k, e = F.col("k"), _n("event_id")
    known = k % 4 == 1
    f = s.select(
        "chat_key", "id", F.col("a").alias("subject"), F.when(known, "knowledge of harbor").otherwise(_cat("habit", (k % 3).cast("string"))).alias("predicate"),
        F.when(known, _cat(F.col("a"), " knows gate ", (F.col("event_id") % 5).cast("string"), ".")).otherwise(_cat("sails boat ", e)).alias("value"),
        F.when(known, "knowledge").otherwise("trait").alias("category"), F.lit("persistent").alias("persistence"), F.lit(3).alias("importance"),
        "range_from", "range_to", F.col("idx").alias("seq"))
    m = s.select("chat_key", "idx", F.col("b").alias("name"), F.lit("It rains.").alias("text"))
    empty = lambda schema: spark.createDataFrame([], schema)
    last = f.groupBy("chat_key").agg(F.max("range_to").alias("range_to"))
    new = f.join(last, ["chat_key", "range_to"], "left_semi")
    before = RC.merged_facts(f.join(last, ["chat_key", "range_to"], "left_anti"))
    memory = {
        "facts": before.unionByName(new.select(*before.columns)), "entities": _people(spark, sf),
        "relationships": empty("chat_key string, id string, endpoint_a string, endpoint_b string, kind string, dynamic string, status string, range_to long, seq long"),
        "threads": empty("chat_key string, id string, title string, detail string, status string, participants array<string>, range_from long, range_to long"),
    }
    evidence = empty("chat_key string, range_from long, range_to long, text string")
    out = RC.reconcile_memory(memory, evidence, m, m.select("chat_key", "idx"), {"facts": new.select("chat_key", "id")}, m.limit(0).select("chat_key", "idx"))
    return out["facts"].select(F.lit("facts").alias("part"), "chat_key", "id", "value")
