"""Engine inputs derived from the sample tables, in Spark and as SQL fragments.

The sample tables hold no extracted records, so records are derived from them
by fixed formulas that both engines can state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, text as X
from ..operators.scale import Sequence, staged, with_position
from ..sources.tables import table
from .registry import fragment

GROUP = fixed.L1_GROUP_SIZE
V = fixed.EXTRACTION_VERSION


def _user_order() -> Sequence:
    # an hour of one user bounds the rows that are sorted together
    return Sequence(
        ("user_id",), ("ts", "event_id"), F.floor(F.unix_micros("ts") / F.lit(3_600_000_000))
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long chats: one per user, positions by (ts, event_id).

    Positions are worked out once and written; every query then scans the
    result with column pruning instead of ranking the events again.
    """
    return staged(spark, ("messages", sf_dir), lambda: _ranked_events(spark, sf_dir))


def _ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return with_position(ev, _user_order(), "idx").select(
        F.col("user_id").cast("string").alias("chat_key"),
        (F.col("idx") - 1).alias("idx"),
        F.col("event_type").alias("name"),
        F.col("props").alias("text"),
        (F.col("event_type") != "error").alias("is_user"),
        F.lit(False).alias("is_system"),
        "event_id",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"),
    )


fragment("ev", """
SELECT CAST(user_id AS VARCHAR) AS chat_key,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
       event_type AS name, props AS text, event_type <> 'error' AS is_user,
       event_id, CAST(round(value * 100) AS BIGINT) AS cents,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events
""")
fragment("msg", """
SELECT *, md5(concat_ws(chr(31), CAST(idx AS VARCHAR), name, text)) AS fingerprint
FROM ev WHERE trim(text) <> ''
""", ("ev",))


def messages(spark, sf_dir) -> DataFrame:
    df = event_messages(spark, sf_dir).filter(F.trim("text") != "")
    return df.withColumn("fingerprint", X.fingerprint())


def short_messages_raw(spark, sf_dir) -> DataFrame:
    """Short chats: one per conversation, with system rows still present."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("chat_key"),
        F.col("turn").alias("idx"),
        F.when(F.col("role") != "user", F.col("role")).alias("name"),
        "text",
        (F.col("role") == "user").alias("is_user"),
        (F.col("role") == "system").alias("is_system"),
    )


fragment("smsg", """
SELECT CAST(conv_id AS VARCHAR) AS chat_key, turn AS idx,
       CASE WHEN role = 'user' THEN 'User' ELSE role END AS name,
       trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text, role = 'user' AS is_user
FROM conversations
WHERE role <> 'system' AND trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''
""")


def processed(spark, sf_dir) -> DataFrame:
    """Ledger with gaps, altered fingerprints and old versions."""
    return (
        messages(spark, sf_dir)
        .filter(F.col("idx") % 11 != 5)
        .select(
            "chat_key", "idx",
            F.when(F.col("idx") % 7 == 3, F.concat(F.lit("x"), "fingerprint"))
            .otherwise(F.col("fingerprint")).alias("fingerprint"),
            F.when(F.col("idx") % 13 == 0, V - 1).otherwise(V).alias("version"),
        )
    )


fragment("proc", f"""
SELECT chat_key, idx,
       CASE WHEN idx % 7 = 3 THEN 'x' || fingerprint ELSE fingerprint END AS fingerprint,
       CASE WHEN idx % 13 = 0 THEN {V - 1} ELSE {V} END AS version
FROM msg WHERE idx % 11 <> 5
""", ("msg",))


def ranges(spark, sf_dir) -> DataFrame:
    """One stored extraction per complete group of eight messages."""
    return (
        messages(spark, sf_dir)
        .groupBy("chat_key", F.floor(F.col("idx") / GROUP).alias("g"))
        .agg(
            F.min("idx").alias("range_from"),
            F.max("idx").alias("range_to"),
            F.count(F.lit(1)).alias("n"),
            F.sort_array(F.collect_list(F.struct("idx", "fingerprint"))).alias("message_fingerprints"),
        )
        .filter(F.col("n") == GROUP)
        .drop("n", "g")
    )


fragment("rng", f"""
SELECT chat_key, min(idx) AS range_from, max(idx) AS range_to
FROM msg GROUP BY chat_key, idx // {GROUP} HAVING count(*) = {GROUP}
""", ("msg",))


def _sourced(df: DataFrame) -> DataFrame:
    """Range of the message group a record comes from."""
    g = F.floor(F.col("idx") / GROUP) * GROUP
    return df.withColumn("range_from", g).withColumn("range_to", g + (GROUP - 1))


SOURCED_SQL = f"(idx // {GROUP}) * {GROUP} AS range_from, (idx // {GROUP}) * {GROUP} + {GROUP - 1} AS range_to"


def facts(spark, sf_dir) -> DataFrame:
    return _sourced(event_messages(spark, sf_dir)).select(
        "chat_key",
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("user "), "chat_key").alias("subject"),
        F.col("name").alias("predicate"),
        F.col("cents").cast("string").alias("value"),
        F.concat(F.lit("bucket"), (F.col("k") % 3).cast("string")).alias("category"),
        (1 + F.col("event_id") % 5).alias("importance"),
        "range_from", "range_to", F.col("idx").alias("seq"), "event_id",
        (F.col("event_id") % 97 == 0).alias("corrected"),
        (F.col("event_id") % 10 != 9).alias("allow_state_updates"),
    )


fragment("fact", f"""
SELECT chat_key, 'f' || event_id AS id, 'user ' || chat_key AS subject, name AS predicate,
       CAST(cents AS VARCHAR) AS value, 'bucket' || (k % 3) AS category,
       1 + event_id % 5 AS importance, {SOURCED_SQL}, idx AS seq, event_id,
       event_id % 97 = 0 AS corrected, event_id % 10 <> 9 AS allow_state_updates
FROM ev
""", ("ev",))


def states(spark, sf_dir) -> DataFrame:
    return _sourced(event_messages(spark, sf_dir)).select(
        "chat_key",
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("user "), "chat_key").alias("subject"),
        F.col("name").alias("attribute"),
        F.col("cents").cast("string").alias("value"),
        F.when(F.col("event_id") % 2 == 0, "ongoing").otherwise("scene").alias("scope"),
        F.when(F.col("name") == "error", "clear").otherwise("set").alias("operation"),
        "range_from", "range_to", F.col("idx").alias("seq"), "event_id",
    )


fragment("state", f"""
SELECT chat_key, 's' || event_id AS id, 'user ' || chat_key AS subject, name AS attribute,
       CAST(cents AS VARCHAR) AS value,
       CASE WHEN event_id % 2 = 0 THEN 'ongoing' ELSE 'scene' END AS scope,
       CASE WHEN name = 'error' THEN 'clear' ELSE 'set' END AS operation,
       {SOURCED_SQL}, idx AS seq, event_id
FROM ev
""", ("ev",))


def relationships(spark, sf_dir) -> DataFrame:
    """Customer and supplier of each order line; endpoints swap on even lines."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity"
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    even = F.col("l_linenumber") % 2 == 0
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.lit("trade").alias("chat_key"),
        F.concat_ws("-", F.lit("r"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"),
        F.when(even, s).otherwise(c).alias("endpoint_a"),
        F.when(even, c).otherwise(s).alias("endpoint_b"),
        F.col("l_returnflag").alias("dynamic"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.col("l_orderkey").alias("range_to"),
        F.col("l_linenumber").cast("long").alias("seq"),
        F.col("l_partkey").alias("part"),
    )


fragment("rel", """
SELECT 'trade' AS chat_key,
       concat_ws('-', 'r', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR)) AS id,
       CASE WHEN l_linenumber % 2 = 0 THEN 's' || l_suppkey ELSE 'c' || o_custkey END AS endpoint_a,
       CASE WHEN l_linenumber % 2 = 0 THEN 'c' || o_custkey ELSE 's' || l_suppkey END AS endpoint_b,
       l_returnflag AS dynamic, CAST(l_quantity AS BIGINT) AS qty,
       l_orderkey AS range_to, CAST(l_linenumber AS BIGINT) AS seq, l_partkey AS part
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")


def l1(spark, sf_dir) -> DataFrame:
    """Level-1 rows: complete groups of eight messages with frame and relation."""
    g = (
        messages(spark, sf_dir)
        .groupBy("chat_key", F.floor(F.col("idx") / GROUP).alias("g"))
        .agg(
            F.min("idx").alias("range_from"), F.max("idx").alias("range_to"),
            F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"),
            F.min("event_id").alias("event_id"),
        )
        .filter(F.col("n") == GROUP)
    )
    frames = F.when(F.col("k") % 4 == 0, "dream").when(F.col("k") % 4 == 1, "flashback").otherwise(fixed.MAIN_FRAME)
    relation = (
        F.when(F.col("k") % 5 == 0, "before").when(F.col("k") % 5 == 1, "detached")
        .when(F.col("k") % 5 == 2, "sideways").otherwise("after")
    )
    return g.select(
        "chat_key", "range_from", "range_to",
        F.concat_ws("-", F.lit("L1"), "chat_key", F.col("range_from").cast("string")).alias("id"),
        frames.alias("frame"), relation.alias("relation"),
        F.when(F.col("k") % 2 == 0, "explicit").otherwise("implicit").alias("certainty"),
        F.concat(F.col("k").cast("string"), F.lit(" hours")).alias("elapsed"),
        "k", "event_id", F.col("g").cast("long").alias("g"),
    )


fragment("l1", f"""
SELECT chat_key, range_from, range_to, 'L1-' || chat_key || '-' || range_from AS id,
       CASE k % 4 WHEN 0 THEN 'dream' WHEN 1 THEN 'flashback' ELSE 'main narrative' END AS frame,
       CASE k % 5 WHEN 0 THEN 'before' WHEN 1 THEN 'detached' WHEN 2 THEN 'sideways' ELSE 'after' END AS relation,
       CASE WHEN k % 2 = 0 THEN 'explicit' ELSE 'implicit' END AS certainty,
       k || ' hours' AS elapsed, k, event_id, g
FROM (SELECT chat_key, min(idx) AS range_from, max(idx) AS range_to, CAST(sum(k) AS BIGINT) AS k,
             min(event_id) AS event_id, idx // {GROUP} AS g
      FROM msg GROUP BY chat_key, idx // {GROUP} HAVING count(*) = {GROUP})
""", ("msg",))


def entities(spark, sf_dir) -> DataFrame:
    """Parts as entities: repeated two-word names, aliases by key and first word."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") % 50).cast("string").alias("chat_key"),
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"),
        F.concat_ws(" ", F.col("p_name"), F.col("p_size").cast("string")).alias("name"),
        F.col("p_type").alias("type"),
        F.concat_ws(" ", F.col("p_brand"), F.lower("p_type"), F.lit("item in"), "p_name").alias("description"),
        F.array(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")),
            F.split("p_name", " ")[0],
        ).alias("aliases"),
        F.col("p_partkey").alias("k"),
    )


fragment("ent", """
SELECT CAST(p_partkey % 50 AS VARCHAR) AS chat_key, 'e' || p_partkey AS id,
       p_name || ' ' || p_size AS name, p_type AS type,
       p_brand || ' ' || lower(p_type) || ' item in ' || p_name AS description,
       'P' || p_partkey AS alias_1, split_part(p_name, ' ', 1) AS alias_2, p_partkey AS k
FROM part
""")


def _one_corpus(column: str):
    """One corpus key for all rows, kept a real column so joins on it stay equi joins."""
    return F.when(F.col(column).isNotNull(), "all").otherwise("none")


def corpus(spark, sf_dir) -> DataFrame:
    """Documents as searchable records with four text fields."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        _one_corpus("doc_id").alias("chat_key"),
        F.col("doc_id").alias("doc"),
        F.col("source").alias("identity"),
        F.col("lang").alias("anchor"),
        F.regexp_extract("text", r"^([^.!?\n]*)", 1).alias("heading"),
        F.regexp_replace("text", r"^[^.!?\n]*", "").alias("body"),
    )


fragment("corpus", r"""
SELECT 'all' AS chat_key, doc_id AS doc, source AS identity, lang AS anchor,
       regexp_extract(text, '^([^.!?\n]*)', 1) AS heading,
       regexp_replace(text, '^[^.!?\n]*', '') AS body
FROM documents
""")


def bench_queries(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        _one_corpus("item_id").alias("chat_key"), F.col("item_id").alias("query_id"),
        F.col("text").alias("direct_text"),
    )


#: conversations stand behind the documents in one corpus
CONVERSATIONS = 1_000_000_000
LANG_CATEGORY = {"en": "facts", "fr": "events", "de": "threads", "es": "backgrounds"}


def recall_l1(spark, sf_dir) -> DataFrame:
    """Conversations as level-1 records: the first turn opens, the last one closes, those between are beats."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]).alias("t"),
        F.array_sort(F.collect_set("role")).alias("participants"))
    return t.select(
        _one_corpus("conv_id").alias("chat_key"), (F.col("conv_id") + CONVERSATIONS).alias("doc"), "participants", F.lit("").alias("title"),
        F.col("t")[0].alias("opening"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 2, F.lit(0))).alias("beats"),
        F.when(F.size("t") > 1, F.element_at("t", -1)).alias("closing"), F.lit(None).cast("string").alias("emotional_arc"), F.array_join("t", " ").alias("body"))


def recall_corpus(spark, sf_dir) -> DataFrame:
    """Documents and conversations as one searchable set."""
    l1 = recall_l1(spark, sf_dir).select(
        "chat_key", "doc", F.lit("").alias("identity"), F.array_join("participants", " ").alias("anchor"), F.lit("").alias("heading"), "body")
    return corpus(spark, sf_dir).unionByName(l1)


def recall_records(spark, sf_dir) -> DataFrame:
    """Category by the language of a document; conversations are level 1; quality labels set the importance."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(marks, "doc_id", "left")
    docs = d.select(
        _one_corpus("doc_id").alias("chat_key"), F.col("doc_id").alias("doc"), F.coalesce(X.lookup(LANG_CATEGORY, F.col("lang")), F.lit("facts")).alias("category"),
        F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 1).otherwise(3).alias("importance"), F.lit(None).cast("long").alias("order_no"))
    l1 = recall_l1(spark, sf_dir).select("chat_key", "doc", F.lit("l1").alias("category"), F.lit(3).alias("importance"), F.col("doc").alias("order_no"))
    return docs.unionByName(l1)


fragment("rl1", f"""
SELECT conv_id + {CONVERSATIONS} AS doc, list(text ORDER BY turn) AS t, array_to_string(list_sort(list(DISTINCT role)), ' ') AS anchor FROM conversations GROUP BY conv_id
""")
fragment("rfields", """
SELECT doc, 'identity' AS field, identity AS text FROM corpus UNION ALL SELECT doc, 'anchor', anchor FROM corpus
UNION ALL SELECT doc, 'heading', heading FROM corpus UNION ALL SELECT doc, 'body', body FROM corpus
UNION ALL SELECT doc, 'anchor', anchor FROM rl1 UNION ALL SELECT doc, 'body', array_to_string(t, ' ') FROM rl1
""", ("corpus", "rl1"))
fragment("rrec", """
SELECT d.doc_id AS doc, CASE lang WHEN 'en' THEN 'facts' WHEN 'fr' THEN 'events' WHEN 'de' THEN 'threads' WHEN 'es' THEN 'backgrounds' ELSE 'facts' END AS section,
  CASE q WHEN 1 THEN 5 WHEN 0 THEN 1 ELSE 3 END AS importance FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)
UNION ALL SELECT doc, 'l1', 3 FROM rl1
""", ("rl1",))
# a passage is a turn or two turns in a row; its key holds the record and its number
fragment("pfields", r"""
SELECT doc * 1000 + i AS doc, 'body' AS field, p AS text FROM (
  SELECT doc, unnest(w) AS p, generate_subscripts(w, 1) AS i FROM (
    SELECT doc, flatten(list_transform(l, lambda v, i: CASE WHEN i < len(l) THEN [v, v || ' ' || l[i + 1]] ELSE [v] END)) AS w FROM (
      SELECT doc, list_filter(list_transform(t, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM rl1)))
UNION ALL
SELECT doc * 1000 + i, 'anchor', anchor FROM (
  SELECT doc, anchor, unnest(range(1, 2 * len(list_filter(t, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')))) AS i FROM rl1)
""", ("rl1",))
