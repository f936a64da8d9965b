"""Named queries over entities, dedupe, sources, hand-off and stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text as X
from ..operators import entities as E, overlap as O, story as S
from ..sources import extractions as A, memory as MEM
from ..sources.messages import read_messages
from ..sources.tables import table
from . import bindings as B, ledger  # noqa: F401  (ledger registers shared fragments)
from .memory import norm
from .registry import fragment, query, sql

# ---- C7, C8, C34, C45, B16 --------------------------------------------------------
fragment("labels", """
SELECT chat_key, id AS entity, name, unnest([name, alias_1, alias_2]) AS label FROM ent
""", ("ent",))
fragment("subj", """
SELECT DISTINCT CAST(l_partkey % 50 AS VARCHAR) AS chat_key,
  CASE l_linenumber WHEN 1 THEN p_name || ' ' || p_size WHEN 2 THEN 'P' || l_partkey WHEN 3 THEN p_name WHEN 4 THEN split_part(p_name, ' ', 2)
    WHEN 5 THEN p_name || '''s owner' WHEN 6 THEN 'the ' || p_name || ' ' || p_size || ' team' ELSE 'unknown ' || l_suppkey END AS subject
FROM lineitem JOIN part ON l_partkey = p_partkey
""")


def _subjects(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_suppkey")
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_size").cast("string").alias("p_size"))
    n = F.col("l_linenumber")
    full = F.concat_ws(" ", "p_name", "p_size")
    subject = (
        F.when(n == 1, full).when(n == 2, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).when(n == 3, F.col("p_name"))
        .when(n == 4, F.split("p_name", " ")[1]).when(n == 5, F.concat("p_name", F.lit("'s owner")))
        .when(n == 6, F.concat(F.lit("the "), full, F.lit(" team"))).otherwise(F.concat(F.lit("unknown "), F.col("l_suppkey").cast("string"))))
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select((F.col("l_partkey") % 50).cast("string").alias("chat_key"), subject.alias("subject")).distinct()


GENERIC = ", ".join(f"'{w}'" for w in fixed.GROUP_NAME_TOKENS)


def words_sql(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*'), lambda w: length(w) > 1 AND w NOT IN ({GENERIC}))))"


fragment("subjmap", f"""
WITH ex AS (SELECT s.chat_key, s.subject, min(l.name) AS canonical FROM subj s JOIN labels l ON l.chat_key = s.chat_key AND lower(l.label) = lower(s.subject)
       GROUP BY s.chat_key, s.subject HAVING count(DISTINCT l.entity) = 1),
op AS (SELECT chat_key, subject, {words_sql('subject')} AS sw FROM subj WHERE NOT regexp_matches(subject, '''s( |$)') AND (chat_key, subject) NOT IN (SELECT (chat_key, subject) FROM ex)),
lw AS (SELECT chat_key, entity, name, {words_sql('label')} AS nw FROM labels),
fz AS (SELECT op.chat_key, op.subject, min(lw.name) AS canonical FROM op JOIN lw ON op.chat_key = lw.chat_key AND len(sw) > 0 AND len(nw) > 0
       AND (list_has_all(nw, sw) OR (len(sw) > 1 AND list_has_all(sw, nw))) GROUP BY op.chat_key, op.subject HAVING count(DISTINCT lw.entity) = 1)
SELECT * FROM ex UNION ALL SELECT * FROM fz
""", ("subj", "labels"))


@query("resolve_subjects", sql("""
SELECT s.chat_key, s.subject AS original, coalesce(m.canonical, s.subject) AS subject FROM subj s LEFT JOIN subjmap m ON m.chat_key = s.chat_key AND m.subject = s.subject
""", "subj", "subjmap"))
def _(spark, sf):
    s = _subjects(spark, sf).withColumn("original", F.col("subject"))
    return E.resolve_subjects(s, B.entities(spark, sf)).select("chat_key", "original", "subject")


@query("surface_variants", """
WITH e AS (SELECT CAST(p_partkey % 50 AS VARCHAR) AS chat_key, p_partkey AS id, p_name || ' ' || p_size AS name FROM part),
one AS (SELECT chat_key, replace(name, ' ', '') AS k, min(name) AS canonical FROM e GROUP BY ALL HAVING count(*) = 1)
SELECT e.chat_key, 'The ' || replace(e.name, ' ', '-') AS reference, canonical FROM e JOIN one ON one.chat_key = e.chat_key AND one.k = replace(e.name, ' ', '')
""")
def _(spark, sf):
    e = B.entities(spark, sf)
    inc = e.select("chat_key", F.concat(F.lit("The "), F.regexp_replace("name", " ", "-")).alias("name"), F.lit("").alias("type"))
    return E.surface_variants(inc, e)


@query("drop_cross_owner_aliases", sql("""
WITH e AS (SELECT chat_key, id, k, CASE WHEN k % 3 = 0 THEN split_part(name, ' ', 1) ELSE name END AS nm, alias_1, alias_2 FROM ent),
a AS (SELECT chat_key, id, alias_1 AS alias, 0 AS pos FROM e UNION ALL SELECT chat_key, id, alias_2, 1 FROM e)
SELECT e.id, coalesce(string_agg(a.alias, ',' ORDER BY a.pos), '') AS aliases FROM e LEFT JOIN a ON a.id = e.id AND NOT EXISTS (
  SELECT 1 FROM e o WHERE o.chat_key = a.chat_key AND lower(o.nm) = lower(a.alias) AND o.id <> a.id) GROUP BY e.id
""", "ent"))
def _(spark, sf):
    e = B.entities(spark, sf).withColumn("name", F.when(F.col("k") % 3 == 0, F.split("name", " ")[0]).otherwise(F.col("name")))
    return E.drop_cross_owner_aliases(e).select("id", F.array_join("aliases", ",").alias("aliases"))


@query("split_references", """
SELECT chat_key, reference, canonical FROM (
  SELECT DISTINCT CAST(p_partkey % 50 AS VARCHAR) AS chat_key, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'it']) AS reference, split_part(p_name, ' ', 2) AS canonical FROM part)
WHERE reference <> canonical
""")
def _(spark, sf):
    w = F.split("p_name", " ")
    c = table(spark, sf, "part").select(
        (F.col("p_partkey") % 50).cast("string").alias("chat_key"), F.concat(w[0], F.lit(" / "), w[1], F.lit("; it")).alias("reference"),
        w[1].alias("canonical"), F.lit("said so").alias("evidence"))
    return E.split_references(c).select("chat_key", "reference", "canonical")


@query("split_composite_subjects", sql("""
WITH s AS (SELECT chat_key, id, k, name, lead(name) OVER (PARTITION BY chat_key ORDER BY k) AS nxt FROM ent),
u AS (SELECT chat_key, lower(label) AS l, min(name) AS c FROM labels GROUP BY ALL HAVING count(DISTINCT entity) = 1),
j AS (SELECT s.*, a.c AS ca, b.c AS cb FROM s LEFT JOIN u a ON a.chat_key = s.chat_key AND a.l = lower(s.name)
      LEFT JOIN u b ON b.chat_key = s.chat_key AND b.l = lower(s.nxt))
SELECT CASE WHEN o = 1 THEN id || '#1' ELSE id END AS id, CASE WHEN o = -1 THEN name || ' and ' || nxt WHEN o = 0 THEN ca ELSE cb END AS subject
FROM (SELECT *, unnest(CASE WHEN ca <> cb THEN [0, 1] ELSE [-1] END) AS o FROM j WHERE nxt IS NOT NULL)
""", "ent", "labels"))
def _(spark, sf):
    from ..operators.scale import Sequence, with_previous

    e = B.entities(spark, sf)
    seq = Sequence(("chat_key",), ("k",), F.floor(F.col("k") / 65_536))
    s = with_previous(e, seq, {"nxt": F.col("name")}, descending=True).filter("nxt IS NOT NULL")
    s = s.select("chat_key", "id", F.concat_ws(" and ", "name", "nxt").alias("subject"))
    return E.split_composite_subjects(s, e).select("id", "subject")


# ---- C9, C10, C11 -------------------------------------------------------------------
@query("mention_join", sql(r"""
WITH v AS (SELECT chat_key, label AS variant, min(name) AS name FROM (SELECT chat_key, lower(name) AS label, name FROM ent UNION SELECT chat_key, lower(alias_1), name FROM ent UNION SELECT chat_key, lower(alias_2), name FROM ent)
      GROUP BY ALL HAVING count(DISTINCT name) = 1),
t AS (SELECT CAST(l_partkey % 50 AS VARCHAR) AS chat_key, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS text_id, 'sold ' || p_name || ' ' || p_size || ' with P' || l_partkey || ' today' AS text
      FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT DISTINCT chat_key, text_id, string_split(lower(text), ' ') AS l FROM t),
g AS (SELECT chat_key, text_id, array_to_string(l[i:i + n - 1], ' ') AS gram FROM (SELECT chat_key, text_id, l, unnest(generate_series(1, len(l))) AS i FROM w), (VALUES (1), (2), (3), (4)) z(n) WHERE i + n - 1 <= len(l))
SELECT text_id, v.name, count(*) AS mentions FROM g JOIN v ON v.chat_key = g.chat_key AND v.variant = g.gram GROUP BY text_id, v.name
""", "ent"))
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    k = F.col("l_partkey").cast("string")
    t = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_partkey") % 50).cast("string").alias("chat_key"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("text_id"),
        F.concat(F.lit("Sold "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" with P"), k, F.lit(" today.")).alias("text")).distinct()
    return O.mention_join(t, B.entities(spark, sf), parts=False).select("text_id", "name", "mentions")


@query("validate_identity_resolutions", sql("""
WITH u AS (SELECT chat_key, lower(label) AS l FROM labels GROUP BY ALL HAVING count(DISTINCT entity) = 1)
SELECT c.chat_key, 'ref ' || c.k AS reference, c.name AS canonical FROM ent c JOIN u ON u.chat_key = c.chat_key AND u.l = lower(c.name) WHERE c.k % 4 <> 3
""", "ent", "labels"))
def _(spark, sf):
    e = B.entities(spark, sf)
    ref = F.concat(F.lit("ref "), F.col("k").cast("string"))
    claims = e.select("chat_key", ref.alias("reference"), F.col("name").alias("canonical"),
                      F.when(F.col("k") % 4 == 0, F.concat(ref, F.lit(" is "), "name")).otherwise(F.concat(F.lit("hint "), F.col("k").cast("string"))).alias("evidence"), "k")
    msgs = e.filter(F.col("k") % 4 != 3).select("chat_key", F.col("k").alias("idx"), F.concat(F.lit("They said "), ref, F.lit(", also "), "name", F.lit(".")).alias("text"))
    return E.validate_identity_resolutions(claims.drop("k"), e, msgs).select("chat_key", "reference", "canonical")


@query("close_rename_chains", sql("""
SELECT chat_key, lower('n' || k) AS k, CASE WHEN k % 10 = 9 THEN 'n' || k ELSE 'n' || ((k // 10) * 10 + 9) END AS canonical FROM (SELECT chat_key, idx AS k FROM ev) WHERE k % 10 <> 9
  AND EXISTS (SELECT 1 FROM ev e WHERE e.chat_key = chat_key)
""", "ev"))
def _(spark, sf):
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    r = B.event_messages(spark, sf).filter(F.col("idx") % 10 != 9).select("chat_key", n(F.col("idx")).alias("reference"), n(F.col("idx") + 1).alias("canonical"))
    # the last link of a partial block points past the chat; finish it at the block end
    r = r.unionByName(B.event_messages(spark, sf).groupBy("chat_key").agg(F.max("idx").alias("m")).filter("m % 10 < 8").select(
        "chat_key", F.explode(F.sequence(F.col("m") + 1, F.floor(F.col("m") / 10) * 10 + 8)).alias("i")).select("chat_key", n(F.col("i")).alias("reference"), n(F.col("i") + 1).alias("canonical")))
    closed = E.close_renames(r)
    have = B.event_messages(spark, sf).select("chat_key", n(F.col("idx")).alias("k"))
    return closed.join(have, ["chat_key", "k"], "left_semi")


@query("apply_identity_resolutions", sql("""
WITH e AS (SELECT chat_key, 'd' || event_id AS id, 'n' || idx AS name, idx, 1 + event_id % 5 AS importance FROM ev),
t AS (SELECT *, CASE WHEN idx % 4 <> 0 THEN 'n' || ((idx // 4) * 4) ELSE name END AS target FROM e)
SELECT chat_key, target AS name, count(*) AS merged, max(importance) AS importance, arg_min(id, idx) AS id FROM t GROUP BY chat_key, target
""", "ev"))
def _(spark, sf):
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    e = B.event_messages(spark, sf)
    ent = e.select("chat_key", F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("id"), n(F.col("idx")).alias("name"), F.array().cast("array<string>").alias("aliases"),
                   F.array(F.col("idx")).alias("sources"), (1 + F.col("event_id") % 5).alias("importance"))
    ren = e.filter(F.col("idx") % 4 != 0).select("chat_key", n(F.col("idx")).alias("reference"), n(F.floor(F.col("idx") / 4) * 4).alias("canonical"))
    return E.apply_identity_resolutions(ent, E.close_renames(ren)).select("chat_key", "name", "merged", "importance", "id")


@query("owner_role_references", """
WITH rel AS (SELECT CAST(p_partkey % 50 AS VARCHAR) AS chat_key, p_name AS a, 'person ' || (p_size % 7) AS b, CASE p_partkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'student' ELSE 'guardian' END AS kind FROM part),
one AS (SELECT chat_key, a, kind, min(b) AS canonical FROM rel GROUP BY ALL HAVING count(DISTINCT b) = 1)
SELECT chat_key, a || chr(39) || 's ' || kind AS reference, canonical FROM one
""")
def _(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 3
    kind = F.when(k == 0, "master").when(k == 1, "student").otherwise("guardian")
    rel = p.select((F.col("p_partkey") % 50).cast("string").alias("chat_key"), F.col("p_name").alias("endpoint_a"),
                   F.concat(F.lit("person "), (F.col("p_size") % 7).cast("string")).alias("endpoint_b"), kind.alias("kind"))
    refs = rel.select("chat_key", F.concat("endpoint_a", F.lit("'s "), "kind").alias("reference"))
    return E.owner_role_references(refs, rel)


@query("single_owner_names", """
SELECT CAST(p_partkey % 50 AS VARCHAR) AS chat_key, p_name || chr(39) || 's former ' || split_part(p_type, ' ', 1) || ' apprentice of P' || p_partkey AS name,
  p_name || ' ' || p_size || '’s former ' || split_part(p_type, ' ', 1) || ' apprentice' AS canonical
FROM part
""")
def _(spark, sf):
    p = table(spark, sf, "part")
    chat, key = (F.col("p_partkey") % 50).cast("string").alias("chat_key"), F.col("p_partkey").cast("string")
    names = p.select(chat, F.concat("p_name", F.lit("'s former "), F.split("p_type", " ")[0], F.lit(" apprentice of P"), key).alias("name"))
    others = p.select(chat, F.concat("p_name", F.lit("'s guardian of P"), key).alias("name"))  # no role that makes a placeholder
    return E.single_owner_names(names.unionByName(others), B.entities(spark, sf))


@query("description_resolutions", """
SELECT CAST(p_partkey % 50 AS VARCHAR) AS chat_key, 'harbor master ' || p_partkey AS reference, 'Mara' || p_partkey AS canonical FROM part WHERE p_partkey % 3 = 0
""")
def _(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    chat = (F.col("p_partkey") % 50).cast("string").alias("chat_key")
    name = F.concat(F.lit("harbor master "), key)
    plain = p.select(chat, F.concat(F.lit("d"), key).alias("id"), name.alias("name"), F.lit("").alias("description"))
    lead = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("The "), name, F.lit(", tall and calm."))).otherwise(F.concat(F.lit("Tall, knows the "), name, F.lit(".")))
    known = p.select(chat, F.concat(F.lit("m"), key).alias("id"), F.concat(F.lit("Mara"), key).alias("name"), lead.alias("description"))
    return E.description_resolutions(plain.unionByName(known))


# ---- D3 -------------------------------------------------------------------------------
RSTOP = ", ".join(f"'{w}'" for w in fixed.RECORD_STOP_WORDS)
EQUIV = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.RECORD_EQUIVALENTS.items())


def record_stem_sql(c: str) -> str:
    cut = lambda n: f"substr({c}, 1, length({c}) - {n})"
    # RE2 has no back references: a doubled last letter is compared directly
    und = lambda e: f"(CASE WHEN length({e}) > 1 AND right({e}, 1) = substr({e}, length({e}) - 1, 1) THEN substr({e}, 1, length({e}) - 1) ELSE {e} END)"
    return f"""CASE {c} {EQUIV} ELSE CASE WHEN NOT regexp_matches({c}, '^[a-z]{{5,}}$') THEN {c} WHEN {c} LIKE '%ies' THEN {cut(3)} || 'y'
      WHEN {c} LIKE '%ing' AND length({c}) > 6 THEN {und(cut(3))} WHEN {c} LIKE '%ed' AND length({c}) > 5 THEN {und(cut(2))}
      WHEN {c} LIKE '%es' AND length({c}) > 5 THEN {cut(2)} WHEN {c} LIKE '%s' AND NOT regexp_matches({c}, '(ss|sith)$') THEN {cut(1)} ELSE {c} END END"""


fragment("thr", f"SELECT doc_id, lang, regexp_extract(text, '^([^.!?\\n]*)', 1) AS title, regexp_replace(text, '^[^.!?\\n]*', '') AS detail, {norm('text')} AS norm FROM documents")


def _rterms(field: str) -> str:
    plain = f"regexp_replace(translate(lower({norm(field)}), '’‘‐‑‒–—', '''''-----'), '''s([^\\p{{L}}\\p{{N}}_]|$)', '\\1', 'g')"
    return f"""SELECT DISTINCT doc_id, s AS t FROM (SELECT doc_id, {record_stem_sql('w')} AS s FROM (
      SELECT doc_id, unnest(regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}]+')) AS w FROM thr)) WHERE length(s) >= 3 AND s NOT IN ({RSTOP})"""


fragment("tt", _rterms("title"), ("thr",))
fragment("dt", _rterms("detail"), ("thr",))
fragment("allt", "SELECT doc_id, t FROM tt UNION SELECT doc_id, t FROM dt", ("tt", "dt"))
fragment("rids", f"""
SELECT doc_id, coalesce(string_agg(DISTINCT x, '|' ORDER BY x), '') AS ids FROM thr
LEFT JOIN (SELECT doc_id, unnest(regexp_extract_all(lower(norm), '[\\p{{L}}\\p{{N}}_-]*[0-9]+[\\p{{L}}\\p{{N}}_-]*')) AS x FROM thr) USING (doc_id) GROUP BY doc_id
""", ("thr",))
fragment("bkt", """
SELECT thr.doc_id, lang, ids, CASE WHEN ids <> '' THEN 'id:' || ids ELSE 'terms:' || coalesce((SELECT string_agg(t, '|' ORDER BY t) FROM (SELECT t FROM allt WHERE allt.doc_id = thr.doc_id ORDER BY t LIMIT 2)), '') END AS bucket
FROM thr JOIN rids USING (doc_id)
""", ("thr", "rids", "allt"))
fragment("tpairs", """
WITH c AS (SELECT a.doc_id AS l, b.doc_id AS r, b.lang FROM bkt a JOIN bkt b ON a.lang = b.lang AND a.bucket = b.bucket AND a.ids = b.ids AND a.doc_id < b.doc_id),
n AS (SELECT thr.doc_id, (SELECT count(*) FROM tt WHERE tt.doc_id = thr.doc_id) AS nt, (SELECT count(*) FROM dt WHERE dt.doc_id = thr.doc_id) AS nd FROM thr),
s AS (SELECT c.*, (SELECT count(*) FROM tt x JOIN tt y ON x.t = y.t WHERE x.doc_id = l AND y.doc_id = r) AS hs,
        (SELECT count(*) FROM dt x JOIN dt y ON x.t = y.t WHERE x.doc_id = l AND y.doc_id = r) AS ds FROM c)
SELECT lang, l AS left_id, r AS right_id FROM s JOIN n a ON a.doc_id = l JOIN n b ON b.doc_id = r
WHERE (hs >= 3 AND hs / least(a.nt, b.nt) >= 0.75) OR (hs >= 2 AND hs / least(a.nt, b.nt) >= 0.5 AND ds >= 6 AND ds / least(a.nd, b.nd) >= 0.75)
""", ("bkt", "tt", "dt"))


def _threads(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("lang").alias("chat_key"), F.col("doc_id").alias("id"), F.regexp_extract("text", r"^([^.!?\n]*)", 1).alias("title"),
                    F.regexp_replace("text", r"^[^.!?\n]*", "").alias("detail"), F.array().cast("array<string>").alias("participants"))


@query("dedupe_clusters", sql("""
WITH RECURSIVE o AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rn FROM thr WHERE doc_id IN (SELECT left_id FROM tpairs UNION SELECT right_id FROM tpairs)),
w AS (SELECT 0 AS rn, CAST([] AS BIGINT[]) AS kept UNION ALL
      SELECT w.rn + 1, CASE WHEN EXISTS (SELECT 1 FROM tpairs p WHERE p.right_id = o.doc_id AND list_contains(w.kept, p.left_id)) THEN w.kept ELSE list_append(w.kept, o.doc_id) END
      FROM w JOIN o ON o.rn = w.rn + 1),
k AS (SELECT kept FROM w ORDER BY rn DESC LIMIT 1)
SELECT thr.doc_id AS id, coalesce((SELECT min(p.left_id) FROM tpairs p, k WHERE p.right_id = thr.doc_id AND list_contains(kept, p.left_id)), thr.doc_id) AS canonical_id FROM thr
""".replace("WITH RECURSIVE o", "WITH o"), "thr", "tpairs").replace("WITH thr AS", "WITH RECURSIVE thr AS", 1))
def _(spark, sf):
    return E.dedupe_semantic(_threads(spark, sf), "threads").select("id", "canonical_id")


@query("entity_duplicates", sql(r"""
WITH e AS (SELECT chat_key, id, lower(name) AS name, regexp_replace(lower(description), '#[0-9]+', '#') AS description FROM ent),
nw AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(regexp_extract_all(name, '[\p{L}\p{N}]+')) AS w FROM e) WHERE length(w) >= 3),
dw AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(regexp_extract_all(description, '[\p{L}\p{N}]+')) AS w FROM e) WHERE length(w) >= 3),
rp AS (SELECT chat_key, id, min(id) OVER (PARTITION BY chat_key, name, description) AS rep FROM e),
p AS (SELECT a.chat_key, a.id AS l, b.id AS r, regexp_replace(a.name, '[^\p{L}\p{N}]', '', 'g') = regexp_replace(b.name, '[^\p{L}\p{N}]', '', 'g') AS same,
   (SELECT count(*) FROM nw x JOIN nw y ON x.w = y.w WHERE x.id = a.id AND y.id = b.id) AS hs, (SELECT count(*) FROM dw x JOIN dw y ON x.w = y.w WHERE x.id = a.id AND y.id = b.id) AS ds,
   least((SELECT count(*) FROM nw WHERE nw.id = a.id), (SELECT count(*) FROM nw WHERE nw.id = b.id)) AS nh, least((SELECT count(*) FROM dw WHERE dw.id = a.id), (SELECT count(*) FROM dw WHERE dw.id = b.id)) AS nd
   FROM e a JOIN e b ON a.chat_key = b.chat_key AND a.id < b.id)
SELECT l AS left_id, r AS right_id FROM p JOIN e a ON a.id = l JOIN e b ON b.id = r
WHERE ((same AND ds >= 2) OR (hs >= 2 AND hs / nh >= 0.66 AND ds >= 3 AND ds / nd >= 0.4))
  AND ((l, r) IN (SELECT (x.id, y.id) FROM rp x JOIN rp y USING (chat_key) WHERE x.id = x.rep AND y.id = y.rep) OR (l, r) IN (SELECT (rep, id) FROM rp))
""", "ent"))
def _(spark, sf):
    return E.semantic_pairs(B.entities(spark, sf), "entities").select("left_id", "right_id")


@query("merge_knowledge")
def _(spark, sf):
    m = read_messages(B.short_messages_raw(spark, sf))
    f = m.select("chat_key", F.col("name").alias("subject"), F.lit("knowledge of the matter").alias("predicate"), F.col("text").alias("value"), F.col("idx").alias("seq"))
    return E.merge_knowledge(f).select("chat_key", "subject_key", "sentences", F.md5("value").alias("value_md5"))


@query("compact_descriptions")
def _(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("id"), F.col("lang").alias("chat_key"), F.col("source").alias("name"), F.col("text").alias("description"))
    return E.compact_descriptions(d.drop("lang")).select("id", F.length("description").alias("n_chars"))


# ---- A4, A5, A6, A8, A9, C44 --------------------------------------------------------------
def _raw(spark, sf):
    """One raw response per complete group of eight messages."""
    e = B.messages(spark, sf)
    g = e.groupBy("chat_key", F.floor(F.col("idx") / 8).alias("g")).agg(
        F.min("idx").alias("range_from"), F.max("idx").alias("range_to"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("idx", "name", "k", "event_id"))).alias("m")).filter("n = 8")
    fact = F.transform("m", lambda r: F.struct(F.concat(F.lit("user "), F.col("chat_key")).alias("subject"), r["name"].alias("predicate"), r["k"].cast("string").alias("value"),
                                               F.lit(" trait ").alias("category"), (r["k"] % 9).cast("double").alias("importance")))
    state = F.transform("m", lambda r: F.struct(F.concat(F.lit("user "), F.col("chat_key")).alias("subject"), F.lit("whereabouts").alias("attribute"), r["name"].alias("value"),
                                                F.when(r["k"] % 2 == 0, "ongoing").otherwise("odd").alias("scope"), F.lit("set").alias("operation")))
    none = F.array().cast("array<string>")
    body = F.to_json(F.struct(
        F.struct(F.lit("t").alias("title"), none.alias("beats"), F.struct(F.lit("").alias("frame"), F.lit("after").alias("relation")).alias("temporal")).alias("sceneCapsule"),
        fact.alias("facts"), state.alias("states"), none.alias("entities"), none.alias("relationships"), none.alias("events"), none.alias("threads"), none.alias("backgrounds")))
    k = F.col("g") % 5
    raw = (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("<think>{x</think>```json\n"), body, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit('Draft {"facts":1} then final: '), body, F.lit(" done"))).when(k == 3, F.regexp_replace(body, '"threads":\\[\\]', '"threads":7')).otherwise("no json"))
    return g.select("chat_key", "range_from", "range_to", (F.col("g") % 3 != 2).alias("allow_state_updates"), raw.alias("raw"))


@query("parse_extractions", sql("""
SELECT chat_key, range_from, g % 5 <= 2 AS valid FROM l1
""", "l1"))
def _(spark, sf):
    ok, bad = A.parse_extractions(_raw(spark, sf))
    return ok.select("chat_key", "range_from", F.lit(True).alias("valid")).unionByName(bad.select("chat_key", "range_from", F.lit(False).alias("valid")))


@query("explode_records", sql("""
SELECT 'facts' AS category, ev.chat_key, l1.range_from, ev.idx * 8 // 8 - l1.range_from AS n, name AS label, CAST(k2 AS VARCHAR) AS value,
       CAST(CASE WHEN k2 % 9 = 0 THEN 3 ELSE least(5, k2 % 9) END AS BIGINT) AS importance
FROM (SELECT *, k AS k2 FROM ev) ev JOIN l1 ON l1.chat_key = ev.chat_key AND ev.idx BETWEEN l1.range_from AND l1.range_to WHERE l1.g % 5 <= 2
UNION ALL
SELECT 'states', ev.chat_key, l1.range_from, ev.idx - l1.range_from, 'location', name, 3
FROM ev JOIN l1 ON l1.chat_key = ev.chat_key AND ev.idx BETWEEN l1.range_from AND l1.range_to WHERE l1.g % 5 <= 2
""", "ev", "l1"))
def _(spark, sf):
    ok, _bad = A.parse_extractions(_raw(spark, sf))
    t = A.explode_records(ok)
    n = (F.col("seq") - F.shiftleft(F.col("range_from").cast("long"), 31)).alias("n")
    f = t["facts"].select(F.lit("facts").alias("category"), "chat_key", "range_from", n, F.col("predicate").alias("label"), "value", "importance")
    s = t["states"].select(F.lit("states").alias("category"), "chat_key", "range_from", n, F.col("attribute").alias("label"), "value", "importance")
    return f.unionByName(s)


@query("memory_store_roundtrip", sql("SELECT chat_key, count(*) AS facts, CAST(sum(importance) AS BIGINT) AS importance FROM fact GROUP BY chat_key", "fact"))
def _(spark, sf):
    import os
    import uuid

    from ..operators.scale import shared_folder

    path = os.path.join(shared_folder(spark), f"memory-{uuid.uuid4().hex}")
    f = B.facts(spark, sf)
    MEM.write_memory({"facts": f.withColumn("importance", F.lit(0).cast("long"))}, path, 16)
    # a later batch rewrites only the buckets it touches; here that is all of them
    MEM.write_memory({"facts": f}, path, 16)
    back = MEM.read_memory(spark, path, ["facts"])["facts"]
    return back.groupBy("chat_key").agg(F.count(F.lit(1)).alias("facts"), F.sum("importance").alias("importance"))


def _memrec(spark, sf):
    return B.facts(spark, sf).select(
        F.concat(F.lit("w"), "chat_key").alias("memory_id"), "chat_key", "id",
        F.array(F.struct(F.col("chat_key").alias("chat_key"), "range_from", "range_to")).alias("sources"))


@query("handoff_records", sql("""
SELECT id, 'inherited:w' || chat_key AS chat_key, 'inherited:w' || chat_key AS source_chat, 'new-' || chat_key AS new_chat FROM fact WHERE CAST(chat_key AS BIGINT) % 3 = 0
""", "fact"))
def _(spark, sf):
    r = _memrec(spark, sf)
    h = r.filter(F.col("chat_key").cast("long") % 3 == 0).select("memory_id", F.concat(F.lit("new-"), "chat_key").alias("new_chat")).distinct()
    return MEM.handoff(r, h).select("id", "chat_key", F.col("sources")[0]["chat_key"].alias("source_chat"), "new_chat")


@query("remap_chat_key", sql("""
SELECT id, CASE WHEN CAST(chat_key AS BIGINT) % 4 = 0 AND CAST(chat_key AS BIGINT) % 8 <> 0 THEN 'moved-' || chat_key ELSE chat_key END AS chat_key,
  CASE WHEN CAST(chat_key AS BIGINT) % 4 = 0 AND CAST(chat_key AS BIGINT) % 8 <> 0 THEN 'moved-' || chat_key ELSE chat_key END AS source_chat FROM fact
""", "fact"))
def _(spark, sf):
    r = _memrec(spark, sf)
    k = F.col("chat_key").cast("long")
    chats = r.select("chat_key").distinct()
    m = chats.filter(k % 4 == 0).select(F.col("chat_key").alias("old_chat"), F.concat(F.lit("moved-"), "chat_key").alias("new_chat"))
    taken = chats.filter(k % 8 == 0).select(F.concat(F.lit("moved-"), "chat_key").alias("chat_key"))
    return MEM.remap_chat_key(r, m, taken).select("id", "chat_key", F.col("sources")[0]["chat_key"].alias("source_chat"))


@query("bind_chats", """
WITH b AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'group:' ELSE 'character:' END || c_nationkey || ':chat:' || (c_custkey % 700) AS chat_key,
     CASE WHEN c_custkey % 5 = 0 THEN 'group' ELSE 'character' END AS kind, CAST(c_custkey % 700 AS VARCHAR) AS chat, 'm' || (c_custkey % 1000) AS memory_id, c_nationkey AS o FROM customer),
ch AS (SELECT s_suppkey AS change_id, CASE WHEN s_suppkey % 2 = 0 THEN 'character' ELSE 'group' END AS kind, CAST(s_suppkey * 7 AS VARCHAR) AS chat, 'r' || s_suppkey AS new_chat FROM supplier),
j AS (SELECT ch.change_id, count(b.chat_key) AS n, min(b.chat_key) AS ck, min(b.memory_id) AS m, min(b.kind || ':' || b.o) AS own, any_value(new_chat) AS nc FROM ch LEFT JOIN b ON b.kind = ch.kind AND b.chat = ch.chat GROUP BY ch.change_id)
SELECT change_id, CASE WHEN n = 1 THEN m END AS memory_id, CASE WHEN n = 1 THEN ck END AS chat_key, CASE WHEN n = 1 THEN own || ':chat:' || nc END AS new_chat_key, n > 1 AS ambiguous,
  n = 1 AND (SELECT count(*) FROM b WHERE b.memory_id = j.m) > 1 AS shared FROM j
""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    kind = F.when(F.col("c_custkey") % 5 == 0, "group").otherwise("character")
    b = c.select(F.concat(kind, F.lit(":"), F.col("c_nationkey").cast("string"), F.lit(":chat:"), (F.col("c_custkey") % 700).cast("string")).alias("chat_key"),
                 F.concat(F.lit("m"), (F.col("c_custkey") % 1000).cast("string")).alias("memory_id"))
    s = table(spark, sf, "supplier")
    ch = s.select(F.col("s_suppkey").alias("change_id"), F.when(F.col("s_suppkey") % 2 == 0, "character").otherwise("group").alias("owner_kind"),
                  (F.col("s_suppkey") * 7).cast("string").alias("chat"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("new_chat"))
    return MEM.bind_chats(b, ch)


# ---- E12-E15 -------------------------------------------------------------------------------
def _updates(spark, sf):
    """A story update after every complete group of eight messages."""
    return B.l1(spark, sf).select("chat_key", F.col("range_to").alias("to"))


@query("story_checkpoints", sql("""
WITH u AS (SELECT chat_key, range_to AS t, range_to + 1 AS covered FROM l1),
cp AS (SELECT chat_key, t, row_number() OVER (PARTITION BY chat_key ORDER BY t) AS rn, count(*) OVER (PARTITION BY chat_key) AS n FROM u WHERE covered % 16 = 0)
SELECT chat_key, row_number() OVER (PARTITION BY chat_key ORDER BY t) - 1 AS checkpoint_no, t AS "to" FROM cp WHERE rn = 1 OR rn > n - 2
""", "l1"))
def _(spark, sf):
    return S.story_checkpoints(_updates(spark, sf), B.messages(spark, sf), interval=16, keep=3)


@query("story_rewind", sql("""
WITH st AS (SELECT chat_key, max(range_to) AS t FROM l1 GROUP BY chat_key),
d AS (SELECT m.chat_key, min(m.idx) AS earliest FROM msg m JOIN st USING (chat_key) LEFT JOIN edited e ON e.chat_key = m.chat_key AND e.idx = m.idx
      WHERE m.idx <= t AND (e.idx IS NULL OR e.fingerprint <> m.fingerprint) GROUP BY m.chat_key),
la AS (SELECT chat_key, max(idx) AS latest FROM edited GROUP BY chat_key),
c AS (SELECT d.chat_key, max(range_to) AS cp FROM d JOIN l1 USING (chat_key) JOIN la USING (chat_key) WHERE (range_to + 1) % 16 = 0 AND range_to < earliest AND range_to <= latest GROUP BY d.chat_key)
SELECT d.chat_key, earliest, cp AS checkpoint_to, CASE WHEN cp IS NULL THEN 'restart' ELSE 'resume' END AS action, latest AS rebuild_target_to
FROM d LEFT JOIN c USING (chat_key) JOIN la USING (chat_key)
""", "l1", "msg", "edited"))
def _(spark, sf):
    from .ledger import edited

    u = _updates(spark, sf)
    stories = u.groupBy("chat_key").agg(F.max("to").alias("to"))
    return S.story_rewind(stories, B.messages(spark, sf), u.filter((F.col("to") + 1) % 16 == 0), edited(spark, sf))


@query("story_plan", sql("""
WITH st AS (SELECT chat_key, max(range_to) AS mx, CASE CAST(chat_key AS BIGINT) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'full' WHEN 2 THEN 'part' WHEN 3 THEN 'resume' ELSE 'restart' END AS kind FROM l1 GROUP BY chat_key),
s2 AS (SELECT chat_key, kind, CASE kind WHEN 'full' THEN 100000 WHEN 'part' THEN 15 WHEN 'resume' THEN 7 WHEN 'restart' THEN -1 END AS t, CASE WHEN kind IN ('resume', 'restart') THEN 30 END AS tgt FROM st),
g AS (SELECT m.chat_key, any_value(kind) AS kind, count(*) FILTER (WHERE CASE kind WHEN 'none' THEN true WHEN 'full' THEN idx > t WHEN 'part' THEN idx > t WHEN 'resume' THEN idx > t AND idx <= tgt ELSE idx <= tgt END) AS av,
   min(idx) FILTER (WHERE CASE kind WHEN 'none' THEN true WHEN 'full' THEN idx > t WHEN 'part' THEN idx > t WHEN 'resume' THEN idx > t AND idx <= tgt ELSE idx <= tgt END) AS nf,
   count(*) FILTER (WHERE t IS NULL OR idx > t) AS pend FROM msg m JOIN s2 USING (chat_key) GROUP BY m.chat_key)
SELECT chat_key, CASE WHEN kind IN ('resume', 'restart') THEN kind ELSE 'continue' END AS mode, nf AS next_from, (av // 8) * 8 AS to_process, pend AS pending,
  kind IN ('full', 'part') AND pend = 0 AS current FROM g
""", "l1", "msg"))
def _(spark, sf):
    k = F.col("chat_key").cast("long") % 5
    chats = B.messages(spark, sf).select("chat_key").distinct().filter(k != 0)
    st = chats.select(
        "chat_key", F.when(k == 4, "").otherwise("so far").alias("text"),
        F.when(k == 1, 100000).when(k == 2, 15).when(k == 3, 7).otherwise(-1).cast("long").alias("to"),
        k.isin(3, 4).alias("rebuild_incomplete"), (k == 4).alias("rebuild_restart"), F.when(k.isin(3, 4), 30).cast("long").alias("rebuild_target_to"))
    return S.story_plan(st, B.messages(spark, sf))


@query("story_units", sql("""
WITH c AS (SELECT * FROM l1 WHERE event_id % 13 <> 0), rq AS (SELECT chat_key, max(range_to) AS req FROM l1 GROUP BY chat_key),
g AS (SELECT rq.chat_key, coalesce(min(l1.range_from), 1000000) AS first_gap, any_value(req) AS req FROM rq LEFT JOIN l1 ON l1.chat_key = rq.chat_key AND l1.event_id % 13 = 0 GROUP BY rq.chat_key)
SELECT g.chat_key, (SELECT count(*) FROM c WHERE c.chat_key = g.chat_key AND c.range_from < first_gap) AS units, CASE WHEN first_gap < req THEN first_gap END AS blocked_from FROM g
""", "l1"))
def _(spark, sf):
    l = B.l1(spark, sf)
    req = l.groupBy("chat_key").agg(F.max("range_to").alias("required"))
    return S.story_units(B.messages(spark, sf), l.filter(F.col("event_id") % 13 != 0).select("chat_key", "range_from", "range_to"), req)
