"""Named queries over the message ledger, branches and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text as X
from ..operators import coverage as C, groups as G
from ..sources.messages import eligible_messages, read_messages
from ..sources.tables import table
from . import bindings as B
from .registry import fragment, query, sql

V = fixed.EXTRACTION_VERSION


# ---- shared inputs ------------------------------------------------------------
def current(spark, sf):
    """The chat as it is now: some positions gone, a shorter end for some chats."""
    return B.messages(spark, sf).filter(
        (F.col("idx") % 17 != 4) & (F.col("idx") < 40 + 8 * (F.col("chat_key").cast("long") % 5))
    )


fragment("cur", "SELECT * FROM msg WHERE idx % 17 <> 4 AND idx < 40 + 8 * (CAST(chat_key AS BIGINT) % 5)", ("msg",))
fragment("stat", f"""
SELECT m.*, CASE WHEN p.idx IS NULL THEN 'never'
                 WHEN p.fingerprint = m.fingerprint AND p.version = {V} THEN 'matched'
                 WHEN p.fingerprint = m.fingerprint THEN 'outdated' ELSE 'changed' END AS status
FROM msg m LEFT JOIN proc p USING (chat_key, idx)
""", ("msg", "proc"))


# ---- A1, A2 -------------------------------------------------------------------
@query("read_messages", sql("""
SELECT chat_key, idx, name, length(text) AS n_chars, md5(text) AS text_md5, is_user FROM smsg
""", "smsg"))
def _(spark, sf):
    m = read_messages(B.short_messages_raw(spark, sf))
    return m.select("chat_key", "idx", "name", F.length("text").alias("n_chars"),
                    F.md5("text").alias("text_md5"), "is_user")


@query("eligible_messages", sql("""
SELECT chat_key, idx, is_user FROM smsg
QUALIFY NOT (row_number() OVER (PARTITION BY chat_key ORDER BY idx DESC) = 1 AND NOT is_user)
""", "smsg"))
def _(spark, sf):
    m = read_messages(B.short_messages_raw(spark, sf))
    return eligible_messages(m).select("chat_key", "idx", "is_user")


@query("read_chat_exports", """
SELECT CAST(conv_id AS VARCHAR) AS chat_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role AS name,
       md5(text) AS text_md5, role = 'user' AS is_user, role = 'system' AS is_system FROM conversations
""")
def _(spark, sf):
    import os
    import uuid

    from ..operators.scale import shared_folder
    from ..sources.messages import read_chat_exports

    c = table(spark, sf, "conversations")
    line = F.to_json(F.struct(F.col("role").alias("name"), F.col("text").alias("mes"), (F.col("role") == "user").alias("is_user"), (F.col("role") == "system").alias("is_system")))
    head = c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit('{"user_name":"User","chat_metadata":{}}').alias("value"))
    lines = c.select("conv_id", "turn", line.alias("value")).unionByName(head)
    path = os.path.join(shared_folder(spark), f"exports-{uuid.uuid4().hex}")
    # one file per chat, lines in order
    lines.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "value").write.partitionBy("conv_id").text(path)
    m = read_chat_exports(spark, path, r"conv_id=([^/]+)/")
    return m.select("chat_key", "idx", "name", F.md5("text").alias("text_md5"), "is_user", "is_system")


# ---- C1, D10, I7 --------------------------------------------------------------
@query("coverage_counts", sql("""
SELECT chat_key, count(*) AS total, max(idx) AS latest_index,
       count(*) FILTER (WHERE status = 'matched') AS processed,
       count(*) FILTER (WHERE status <> 'matched') AS pending,
       count(*) FILTER (WHERE status = 'changed') AS changed,
       count(*) FILTER (WHERE status = 'outdated') AS outdated,
       count(*) FILTER (WHERE status = 'never') AS never_processed
FROM stat GROUP BY chat_key
""", "stat"))
def _(spark, sf):
    return C.coverage(B.messages(spark, sf), B.processed(spark, sf))


@query("pending_ranges", sql("""
SELECT chat_key, min(idx) AS range_from, max(idx) AS range_to
FROM (SELECT chat_key, idx, idx - row_number() OVER (PARTITION BY chat_key ORDER BY idx) AS island
      FROM stat WHERE status <> 'matched')
GROUP BY chat_key, island
""", "stat"))
def _(spark, sf):
    return C.pending_ranges(B.messages(spark, sf), B.processed(spark, sf))


@query("backlog_policy", sql("""
SELECT chat_key, pending, (pending // 8) * 8 AS eligible, required,
       CASE WHEN required > 0 THEN required ELSE (pending // 8) * 8 END AS blocking,
       required > 0 OR pending >= 16 AS should_catch_up
FROM (SELECT chat_key, count(*) FILTER (WHERE status <> 'matched') AS pending,
             count(*) FILTER (WHERE status = 'outdated') // 4 AS required
      FROM stat GROUP BY chat_key)
""", "stat"))
def _(spark, sf):
    c = C.coverage(B.messages(spark, sf), B.processed(spark, sf))
    return C.backlog(c.select("chat_key", "pending", F.floor(F.col("outdated") / 4).alias("required")))


# ---- C2, C3, C4 ---------------------------------------------------------------
@query("tail_rollback", sql("""
, last AS (SELECT chat_key, max(idx) AS latest_index FROM cur GROUP BY chat_key),
rem AS (SELECT p.chat_key, coalesce(latest_index, -1) AS latest_index, count(DISTINCT idx) AS removed_messages,
               min(idx) AS removed_from, max(idx) AS removed_to
        FROM proc p LEFT JOIN last USING (chat_key) WHERE idx > coalesce(latest_index, -1)
        GROUP BY p.chat_key, latest_index)
SELECT rem.*, (SELECT count(*) FROM rng r WHERE r.chat_key = rem.chat_key AND r.range_to > rem.latest_index) AS affected_ranges
FROM rem
""".replace(", last AS", "WITH last AS", 1), "proc", "rng", "cur"))
def _(spark, sf):
    return C.tail_rollback(current(spark, sf), B.processed(spark, sf), B.ranges(spark, sf))


fragment("div", f"""
SELECT chat_key, min(idx) AS earliest_index FROM (
  SELECT coalesce(c.chat_key, p.chat_key) AS chat_key, coalesce(c.idx, p.idx) AS idx,
         c.idx IS NULL AS gone, p.idx IS NULL AS unstored,
         c.fingerprint <> p.fingerprint OR p.version <> {V} AS differs,
         max(p.idx) OVER (PARTITION BY coalesce(c.chat_key, p.chat_key)) AS last_stored
  FROM cur c FULL OUTER JOIN proc p ON c.chat_key = p.chat_key AND c.idx = p.idx)
WHERE gone OR differs OR (unstored AND idx <= last_stored)
GROUP BY chat_key
""", ("cur", "proc"))


@query("branch_divergence", sql("""
SELECT d.chat_key, d.earliest_index, least(d.earliest_index, min(r.range_from)) AS repair_from,
       count(r.range_from) AS affected_ranges
FROM div d LEFT JOIN rng r ON r.chat_key = d.chat_key AND r.range_to >= d.earliest_index
GROUP BY d.chat_key, d.earliest_index
""", "div", "rng"))
def _(spark, sf):
    return C.branch_divergence(current(spark, sf), B.processed(spark, sf), B.ranges(spark, sf))


def edited(spark, sf):
    """Chats with some messages edited and some deleted."""
    m = B.messages(spark, sf).filter(F.col("idx") % 29 != 9)
    return m.withColumn(
        "fingerprint",
        F.when(F.col("event_id") % 41 == 0, F.concat(F.lit("e"), "fingerprint")).otherwise(F.col("fingerprint")),
    )


fragment("edited", """
SELECT * REPLACE (CASE WHEN event_id % 41 = 0 THEN 'e' || fingerprint ELSE fingerprint END AS fingerprint)
FROM msg WHERE idx % 29 <> 9
""", ("msg",))


@query("range_validity", sql("""
SELECT r.chat_key, r.range_from, r.range_to,
       bool_or(e.idx IS NOT NULL AND e.fingerprint <> m.fingerprint) AS changed,
       bool_or(e.idx IS NULL OR e.fingerprint <> m.fingerprint) AS invalid
FROM rng r JOIN msg m ON m.chat_key = r.chat_key AND m.idx BETWEEN r.range_from AND r.range_to
LEFT JOIN edited e ON e.chat_key = m.chat_key AND e.idx = m.idx
GROUP BY ALL
""", "rng", "edited"))
def _(spark, sf):
    return C.range_validity(B.ranges(spark, sf), edited(spark, sf))


# ---- C5, C6 -------------------------------------------------------------------
def _memories(spark, sf):
    chats = B.messages(spark, sf).select("chat_key").distinct()
    k = F.col("chat_key").cast("long") % 7
    return chats.select(
        F.concat(F.lit("w"), "chat_key").alias("memory_id"),
        F.concat(F.lit("z:chat:"), "chat_key").alias("current_chat"),
        (k != 5).alias("has_data"), (F.col("chat_key").cast("long") % 14 == 6).alias("continues_here"),
        (F.col("chat_key").cast("long") % 14 == 0).alias("declares_current"), k.alias("kind"),
    )


def _memory_sources(spark, sf):
    m = B.messages(spark, sf)
    k = F.col("chat_key").cast("long") % 7
    copies = (
        F.when(k == 3, F.array(F.lit("x:chat:"), F.lit("y:chat:")))
        .when(k == 4, F.array(F.lit("x:chat:"), F.lit("x:chat:other")))
        .when(k >= 5, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("x:chat:")))
    )
    rows = m.withColumn("kind", k).withColumn("prefix", F.explode(copies)).filter(
        (F.col("prefix") != "y:chat:") | (F.col("idx") % 10 != 9)
    )
    return rows.select(
        F.concat(F.lit("w"), "chat_key").alias("memory_id"),
        F.concat("prefix", "chat_key").alias("source_chat"),
        F.when((k == 2) & (F.col("idx") == 9), F.col("idx") + 100000).otherwise(F.col("idx")).alias("idx"),
        F.when((k == 1) & (F.col("idx") == 3), F.lit("altered")).otherwise(F.col("fingerprint")).alias("fingerprint"),
    )


fragment("mem", """
SELECT DISTINCT 'w' || chat_key AS memory_id, 'z:chat:' || chat_key AS current_chat,
       CAST(chat_key AS BIGINT) % 7 <> 5 AS has_data, CAST(chat_key AS BIGINT) % 14 = 6 AS continues_here,
       CAST(chat_key AS BIGINT) % 14 = 0 AS declares_current
FROM msg
""", ("msg",))
fragment("memsrc", """
SELECT 'w' || chat_key AS memory_id, prefix || chat_key AS source_chat,
       CASE WHEN kind = 2 AND idx = 9 THEN idx + 100000 ELSE idx END AS idx,
       CASE WHEN kind = 1 AND idx = 3 THEN 'altered' ELSE fingerprint END AS fingerprint
FROM (SELECT *, CAST(chat_key AS BIGINT) % 7 AS kind FROM msg)
JOIN (VALUES ('x:chat:'), ('y:chat:'), ('x:chat:other')) v(prefix)
  ON (prefix = 'x:chat:' AND kind < 5) OR (prefix = 'y:chat:' AND kind = 3 AND idx % 10 <> 9)
     OR (prefix = 'x:chat:other' AND kind = 4)
""", ("msg",))
fragment("inspected", """
SELECT s.memory_id, m.current_chat, s.source_chat, count(*) AS records,
       count(*) FILTER (WHERE c.fingerprint = s.fingerprint) AS matched,
       count(*) FILTER (WHERE c.fingerprint <> s.fingerprint) AS changed,
       count(*) FILTER (WHERE c.fingerprint IS NULL) AS ahead, max(s.idx) AS last_idx
FROM memsrc s JOIN mem m USING (memory_id)
LEFT JOIN msg c ON 'z:chat:' || c.chat_key = m.current_chat AND c.idx = s.idx
GROUP BY ALL
""", ("mem", "memsrc"))
fragment("verdicts", """
SELECT m.memory_id, m.current_chat, count(i.source_chat) AS candidates,
       coalesce(max(i.matched), 0) AS matched,
       CASE WHEN count(i.source_chat) = 0 AND any_value(continues_here) THEN 'continuation-baseline'
            WHEN count(i.source_chat) = 0 AND NOT any_value(has_data) THEN 'empty'
            WHEN count(i.source_chat) = 0 THEN 'unverifiable'
            WHEN count(i.source_chat) > 1 AND bool_and(i.changed = 0 AND i.ahead = 0)
                 AND bool_and(split_part(i.source_chat, ':chat:', 2) = split_part(m.current_chat, ':chat:', 2))
                 THEN 'aligned-source-aliases'
            WHEN count(i.source_chat) > 1 THEN 'multiple-source-chats'
            WHEN max(i.ahead) > 0 THEN 'import-ahead'
            WHEN max(i.changed) > 0 THEN 'changed-or-branched'
            WHEN max(i.source_chat) <> m.current_chat AND any_value(declares_current) THEN 'ambiguous-source'
            ELSE 'aligned' END AS verdict
FROM mem m LEFT JOIN inspected i USING (memory_id)
GROUP BY m.memory_id, m.current_chat
""", ("mem", "inspected"))


def _here(spark, sf):
    return B.messages(spark, sf).withColumn("chat_key", F.concat(F.lit("z:chat:"), "chat_key"))


@query("align_memory", sql("SELECT * FROM verdicts", "verdicts"))
def _(spark, sf):
    return C.align_memory(_memories(spark, sf), _memory_sources(spark, sf), _here(spark, sf))


@query("consolidate_source_aliases", sql("""
SELECT memory_id, source_chat, records,
       row_number() OVER (PARTITION BY memory_id ORDER BY records DESC, last_idx DESC,
                          source_chat = current_chat DESC, source_chat DESC) = 1 AS keep
FROM inspected JOIN verdicts USING (memory_id) WHERE verdict = 'aligned-source-aliases'
""".replace("FROM inspected JOIN verdicts USING (memory_id)",
            "FROM inspected i JOIN (SELECT memory_id, verdict FROM verdicts) v USING (memory_id)"),
    "inspected", "verdicts"))
def _(spark, sf):
    r = C.rank_source_aliases(_memories(spark, sf), _memory_sources(spark, sf), _here(spark, sf))
    return r.select("memory_id", "source_chat", "records", "keep")


@query("drop_alias_sources", sql("""
SELECT i.memory_id, count(DISTINCT f.id) AS records, count(*) AS source_refs
FROM inspected i JOIN (SELECT memory_id FROM verdicts WHERE verdict = 'aligned-source-aliases') v USING (memory_id)
JOIN fact f ON 'w' || f.chat_key = i.memory_id
WHERE i.source_chat LIKE 'x:%'
GROUP BY i.memory_id
""", "inspected", "verdicts", "fact"))
def _(spark, sf):
    ranked = C.rank_source_aliases(_memories(spark, sf), _memory_sources(spark, sf), _here(spark, sf))
    ref = lambda p: F.struct(F.concat(F.lit(p), "chat_key").alias("chat_key"), "range_from", "range_to")
    records = B.facts(spark, sf).select(
        F.concat(F.lit("w"), "chat_key").alias("memory_id"), "id",
        F.array(ref("x:chat:"), ref("y:chat:")).alias("sources"),
    ).join(ranked.select("memory_id").distinct(), "memory_id", "left_semi")
    kept = C.drop_sources(records, ranked.filter(~F.col("keep")).select("memory_id", "source_chat"))
    return kept.groupBy("memory_id").agg(
        F.countDistinct("id").alias("records"), F.sum(F.size("sources")).alias("source_refs")
    )


# ---- C20 ----------------------------------------------------------------------
@query("reuse_branch_prefix", sql(f"""
WITH bm AS (SELECT 'b' || chat_key AS chat_key, idx,
              CASE WHEN CAST(chat_key AS BIGINT) % 3 = 0 AND idx = 20 THEN 'edit' ELSE fingerprint END AS fingerprint
       FROM msg WHERE idx < CASE WHEN CAST(chat_key AS BIGINT) % 3 = 1 THEN 1000000000 ELSE 33 END),
led AS (SELECT 'b' || chat_key AS chat_key, idx, fingerprint FROM msg),
rg AS (SELECT 'b' || chat_key AS chat_key, range_from, range_to,
              NOT (CAST(chat_key AS BIGINT) % 5 = 2 AND range_from = 8) AS replayable FROM rng),
d0 AS (SELECT chat_key, min(idx) AS e FROM (
        SELECT coalesce(b.chat_key, l.chat_key) AS chat_key, coalesce(b.idx, l.idx) AS idx
        FROM bm b FULL OUTER JOIN led l ON b.chat_key = l.chat_key AND b.idx = l.idx
        WHERE b.idx IS NULL OR b.fingerprint <> l.fingerprint) GROUP BY chat_key),
d1 AS (SELECT d0.chat_key, least(e, min(range_from)) AS r FROM d0
       LEFT JOIN rg ON rg.chat_key = d0.chat_key AND range_to >= e GROUP BY d0.chat_key, e),
prot AS (SELECT chat_key, idx FROM bm QUALIFY row_number() OVER (PARTITION BY chat_key ORDER BY idx DESC) <= 2),
s1 AS (SELECT rg.chat_key, min(range_from) AS r FROM rg JOIN prot ON prot.chat_key = rg.chat_key
       AND prot.idx BETWEEN range_from AND range_to GROUP BY rg.chat_key),
base AS (SELECT c.chat_key, least(d1.r, s1.r) AS base FROM (SELECT DISTINCT chat_key FROM bm) c
         LEFT JOIN d1 USING (chat_key) LEFT JOIN s1 USING (chat_key)),
bad AS (SELECT rg.chat_key, rg.range_from, rg.range_to,
               NOT replayable OR (SELECT count(*) FROM led JOIN bm USING (chat_key, idx)
                 WHERE led.chat_key = rg.chat_key AND idx BETWEEN rg.range_from AND rg.range_to
                   AND led.fingerprint = bm.fingerprint) < 8 AS bad FROM rg),
cut AS (SELECT base.chat_key, least(any_value(base), min(range_from) FILTER (WHERE bad AND (base IS NULL OR range_to < base))) AS repair_from
        FROM base JOIN bad USING (chat_key) GROUP BY base.chat_key)
SELECT cut.chat_key, repair_from, count(bad.range_from) AS retained,
       (SELECT count(*) FROM bm WHERE bm.chat_key = cut.chat_key) - count(bad.range_from) * 8 AS pending
FROM cut LEFT JOIN bad ON bad.chat_key = cut.chat_key AND (repair_from IS NULL OR range_to < repair_from)
GROUP BY cut.chat_key, repair_from
""", "rng"))
def _(spark, sf):
    m = B.messages(spark, sf)
    k = F.col("chat_key").cast("long")
    branch_messages = m.filter(F.when(k % 3 == 1, F.lit(True)).otherwise(F.col("idx") < 33)).select(
        F.concat(F.lit("b"), "chat_key").alias("chat_key"), "idx",
        F.when((k % 3 == 0) & (F.col("idx") == 20), "edit").otherwise(F.col("fingerprint")).alias("fingerprint"),
    )
    branches = m.select(F.concat(F.lit("b"), "chat_key").alias("b"), "chat_key").distinct().select(
        F.col("b").alias("chat_key"), F.col("chat_key").alias("parent_chat")
    )
    parent = m.select("chat_key", "idx", "fingerprint", F.lit(V).alias("version"))
    rng = B.ranges(spark, sf).withColumn("replayable", ~((k % 5 == 2) & (F.col("range_from") == 8)))
    return C.reuse_branch_prefix(branches, branch_messages, parent, rng)


# ---- C21, C22 -----------------------------------------------------------------
@query("map_prompt_messages", sql("""
WITH ns AS (SELECT CAST(conv_id AS VARCHAR) AS chat_key, turn AS idx, text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal
            FROM conversations WHERE role <> 'system')
SELECT chat_key, ordinal, ordinal - 1 AS position, idx, length(text) + 1 AS prompt_chars, md5(text) AS source_md5 FROM ns
"""))
def _(spark, sf):
    saved = B.short_messages_raw(spark, sf)
    from ..operators.scale import message_order, with_position

    prompt = with_position(saved.filter(~F.col("is_system")), message_order(), "p").select(
        "chat_key", (F.col("p") - 1).alias("position"), F.concat("text", F.lit("!")).alias("text"), "is_system"
    )
    j = C.map_prompt_messages(prompt, saved)
    return j.select("chat_key", "ordinal", "position", "idx", F.length("prompt_text").alias("prompt_chars"),
                    F.md5("source_text").alias("source_md5"))


@query("preceding_user_context", sql("""
WITH l AS (SELECT *, lag(idx) OVER w AS pi, lag(name) OVER w AS pn, lag(is_user) OVER w AS pu
           FROM cur WINDOW w AS (PARTITION BY chat_key ORDER BY idx))
SELECT r.chat_key, r.range_from, r.range_to, l.pi AS context_idx, l.pn AS context_name
FROM rng r JOIN l ON l.chat_key = r.chat_key AND l.idx = r.range_from
WHERE NOT l.is_user AND l.pu AND l.idx > 0
""", "rng", "cur"))
def _(spark, sf):
    r = C.preceding_user_context(B.ranges(spark, sf), current(spark, sf))
    return r.drop("context_text")


# ---- E1, E2, E3, E4, E5, E11, E19 ------------------------------------------------
@query("l1_groups", sql("""
SELECT chat_key, CAST((rn - 1) // 8 AS BIGINT) AS group_no, min(idx) AS range_from, max(idx) AS range_to, count(*) AS size
FROM (SELECT chat_key, idx, row_number() OVER (PARTITION BY chat_key ORDER BY idx) AS rn
      FROM stat WHERE status <> 'matched')
GROUP BY ALL HAVING count(*) = 8
""", "stat"))
def _(spark, sf):
    s = C.message_status(B.messages(spark, sf), B.processed(spark, sf))
    return G.l1_groups(s.filter(F.col("status") != "matched"), 8)


@query("l1_groups_short", sql("""
SELECT chat_key, CAST((rn - 1) // 3 AS BIGINT) AS group_no, min(idx) AS range_from, max(idx) AS range_to, count(*) AS size
FROM (SELECT chat_key, idx, row_number() OVER (PARTITION BY chat_key ORDER BY idx) AS rn FROM smsg)
GROUP BY ALL HAVING count(*) = 3
""", "smsg"))
def _(spark, sf):
    return G.l1_groups(read_messages(B.short_messages_raw(spark, sf)), 3)


@query("l1_bootstrap_group", sql("""
SELECT chat_key, CAST(0 AS BIGINT) AS group_no, min(idx) AS range_from, max(idx) AS range_to, count(*) AS size
FROM (SELECT chat_key, idx FROM cur QUALIFY row_number() OVER (PARTITION BY chat_key ORDER BY idx DESC) <= 8)
GROUP BY chat_key HAVING count(*) = 8
""", "cur"))
def _(spark, sf):
    return G.l1_groups(current(spark, sf), 8, bootstrap=True)


@query("stability_repair_from", sql("""
WITH prot AS (SELECT chat_key, idx FROM cur QUALIFY row_number() OVER (PARTITION BY chat_key ORDER BY idx DESC) <= 2)
SELECT r.chat_key, min(range_from) AS repair_from
FROM rng r JOIN prot p ON p.chat_key = r.chat_key AND p.idx BETWEEN r.range_from AND r.range_to
GROUP BY r.chat_key
""", "rng", "cur"))
def _(spark, sf):
    return G.stability_repair_from(current(spark, sf), B.ranges(spark, sf))


TOK = "greatest(1, CAST(ceil(length(regexp_replace(name || ': ' || text, '[\\x00-\\x7f]', '', 'g')) + (length(name || ': ' || text) - length(regexp_replace(name || ': ' || text, '[\\x00-\\x7f]', '', 'g'))) / 4.0) AS BIGINT))"


@query("message_tokens", sql(f"SELECT chat_key, idx, {TOK} AS tokens FROM smsg", "smsg"))
def _(spark, sf):
    return G.message_tokens(read_messages(B.short_messages_raw(spark, sf))).select("chat_key", "idx", "tokens")


fragment("mtok", f"SELECT *, {TOK} AS tokens FROM cur", ("cur",))


@query("token_chunks", sql("""
WITH o AS (SELECT chat_key, (idx // 64) * 64 AS range_from, idx, tokens,
                  row_number() OVER (PARTITION BY chat_key, idx // 64 ORDER BY idx) AS rn FROM mtok),
w AS (SELECT chat_key, range_from, idx, rn, 0 AS chunk_no, tokens AS run, 1 AS n FROM o WHERE rn = 1
      UNION ALL
      SELECT o.chat_key, o.range_from, o.idx, o.rn,
             CASE WHEN w.run + o.tokens > 30 OR w.n + 1 > 6 OR o.idx > w.idx + 1 THEN w.chunk_no + 1 ELSE w.chunk_no END,
             CASE WHEN w.run + o.tokens > 30 OR w.n + 1 > 6 OR o.idx > w.idx + 1 THEN o.tokens ELSE w.run + o.tokens END,
             CASE WHEN w.run + o.tokens > 30 OR w.n + 1 > 6 OR o.idx > w.idx + 1 THEN 1 ELSE w.n + 1 END
      FROM w JOIN o ON o.chat_key = w.chat_key AND o.range_from = w.range_from AND o.rn = w.rn + 1)
SELECT chat_key, range_from, CAST(chunk_no AS BIGINT) AS chunk_no, min(idx) AS chunk_from, max(idx) AS chunk_to,
       CAST(max(run) AS BIGINT) AS tokens, count(*) AS n
FROM w GROUP BY chat_key, range_from, chunk_no
""", "mtok").replace("WITH ev AS", "WITH RECURSIVE ev AS", 1))
def _(spark, sf):
    m = G.message_tokens(current(spark, sf)).withColumn("range_from", F.floor(F.col("idx") / 64) * 64)
    return G.token_chunks(m, 30, 6)


@query("balanced_split", sql("""
SELECT chat_key, range_from, arg_min(idx, (abs(total - 2 * before), idx)) AS split_at
FROM (SELECT chat_key, (idx // 8) * 8 AS range_from, idx, sum(tokens) OVER (PARTITION BY chat_key, idx // 8) AS total,
             sum(tokens) OVER (PARTITION BY chat_key, idx // 8 ORDER BY idx) - tokens AS before,
             row_number() OVER (PARTITION BY chat_key, idx // 8 ORDER BY idx) AS rn FROM mtok)
WHERE rn > 1 GROUP BY chat_key, range_from
""", "mtok"))
def _(spark, sf):
    m = G.message_tokens(current(spark, sf)).withColumn("range_from", F.floor(F.col("idx") / 8) * 8)
    return G.balanced_split(m)


@query("raw_tail", sql(f"""
WITH r AS (SELECT *, sum(tokens) OVER w AS run, row_number() OVER w AS back FROM mtok
           WINDOW w AS (PARTITION BY chat_key ORDER BY idx DESC)),
s AS (SELECT chat_key, min(back) FILTER (WHERE back > 4 AND run > 60) AS stop FROM r GROUP BY chat_key),
t AS (SELECT r.* FROM r JOIN s USING (chat_key) WHERE stop IS NULL OR back < stop),
h AS (SELECT m.chat_key, count(*) AS hm, sum(m.tokens) AS ht FROM mtok m
      JOIN proc p ON p.chat_key = m.chat_key AND p.idx = m.idx AND p.fingerprint = m.fingerprint AND p.version = {V}
      LEFT JOIN t ON t.chat_key = m.chat_key AND t.idx = m.idx WHERE t.idx IS NULL GROUP BY m.chat_key)
SELECT t.chat_key, min(t.idx) AS tail_from, max(t.idx) AS tail_to, CAST(sum(t.tokens) AS BIGINT) AS tail_tokens,
       count(*) AS tail_messages, coalesce(any_value(hm), 0) AS hidden_messages,
       CAST(coalesce(any_value(ht), 0) AS BIGINT) AS hidden_tokens
FROM t LEFT JOIN h USING (chat_key) GROUP BY t.chat_key
""", "mtok", "proc"))
def _(spark, sf):
    return G.tail_summary(G.message_tokens(current(spark, sf)), B.processed(spark, sf), 60, V)


@query("l2_groups", sql("""
SELECT chat_key, CAST((rn - 1) // 3 AS BIGINT) AS group_no, id
FROM (SELECT chat_key, id, row_number() OVER (PARTITION BY chat_key ORDER BY range_from) AS rn,
             count(*) OVER (PARTITION BY chat_key) AS n FROM l1 WHERE event_id % 9 <> 0)
WHERE (rn - 1) // 3 < n // 3
""", "l1"))
def _(spark, sf):
    rows = B.l1(spark, sf)
    return G.parent_groups(rows, rows.filter(F.col("event_id") % 9 == 0).select("chat_key", "id"), 3).select(
        "chat_key", "group_no", "id"
    )


@query("l3_groups", sql("""
SELECT chat_key, CAST((rn - 1) // 2 AS BIGINT) AS group_no, id
FROM (SELECT chat_key, id, row_number() OVER (PARTITION BY chat_key ORDER BY range_from) AS rn,
             count(*) OVER (PARTITION BY chat_key) AS n FROM l1)
WHERE (rn - 1) // 2 < n // 2 - 1 AND n >= 8
""", "l1"))
def _(spark, sf):
    rows = B.l1(spark, sf)
    none = rows.filter(F.lit(False)).select("chat_key", "id")
    return G.parent_groups(rows, none, 2, start=8, keep_recent=True).select("chat_key", "group_no", "id")


@query("newest_snapshot", sql("""
SELECT memory_id, arg_max(snapshot_id, (revision, updated_at, snapshot_id)) AS snapshot_id, max(revision) AS revision
FROM (SELECT 'w' || chat_key AS memory_id, id AS snapshot_id, k AS revision, range_to AS updated_at FROM l1)
GROUP BY memory_id
""", "l1"))
def _(spark, sf):
    s = B.l1(spark, sf).select(F.concat(F.lit("w"), "chat_key").alias("memory_id"), F.col("id").alias("snapshot_id"),
                               F.col("k").alias("revision"), F.col("range_to").alias("updated_at"))
    return G.newest_snapshot(s)
