"""Named queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scale import shared_folder
from ..sources.tables import table
from . import declist, decontam, filter_audit, kernel_lang, mincut, packing, pivots, recompress, secrets, simhash, tokenfile, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.placed_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/llm-token-files-{uuid.uuid4().hex}"
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.file_digests(spark, path)


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.without_repeats(table(spark, sf_dir, "documents"), texts=False)


ORACLES["op4_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, hash(list_slice(w, i, i + 19)) AS h, list_slice(w, i, i + 19) AS g
  FROM d, unnest(range(1, greatest(len(w) - 18, 1))) AS r(i)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h, g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM late, range(0, 20) AS s(o)
), lost AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k
  FROM d LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


#: categories of the chain, in its order, by conditions on ``labels``: the narrow one feeds the one that decides
TOXICITY = {"toxic_degraded": "toxic = 1 AND quality = 0", "toxic": "toxic = 1"}


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), TOXICITY), columns=["doc_id"])
    return found.select("row.doc_id", (F.col("out.p_toxic") >= toxicity.THRESHOLD).alias("toxic"), "out.*")


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mincut.extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])
    return found.select("row.page_id", "row.url", "out.text", "out.n_chars")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stage

    stats = stage(declist.with_stats(table(spark, sf_dir, "documents"), columns=["doc_id"]), "quality")
    rules = declist.fit(stats, table(spark, sf_dir, "labels"))
    failed = declist.base_failed()
    return stats.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.col(f"out.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & declist.verdict(rules)).alias("kept"),
    )


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    names = F.array_sort(F.transform("out.items", lambda i: i.cast("string")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "out.n_words", "out.n_hit", F.size("out.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("out.n_hit") > 0).alias("contaminated"),
    )


_WORDS8 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES["op8_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
b AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), size AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM d, size, unnest(range(1, greatest(len(w) - n + 2, 1))) AS r(i)
), found AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM found, unnest(range(0, n)) AS s(o) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = kernel_lang.predict(docs, kernel_lang.fit(docs), columns=["doc_id"])
    return found.select("row.*", "out.*").select("doc_id", kernel_lang.held_out().alias("held_out"), "lang_pred", "score")


@query
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_digests(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select("row.doc_id", "out.*")


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op12_embedding_near_dedup"] = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(v, lambda c: c <> 0)) > 0
), l AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT r AS a, r AS b FROM e UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.r)::BIGINT AS n_links, min(o.vec_id) AS component_id, e.vec_id = min(o.vec_id) AS kept
FROM e JOIN reach ON e.r = reach.a JOIN e o ON o.r = reach.b GROUP BY e.r, e.vec_id
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORDS13 = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLES["op13_filter_audit"] = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, len({_WORDS13}) AS n, len(list_distinct({_WORDS13})) AS k, min(doc_id) OVER (PARTITION BY t) AS lead FROM d
), f AS (
  SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad,
    {{'A': n < 200, 'B': 100 * k < 50 * n, 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t),
      'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > lead, false)}} AS s FROM w
), cell AS (
  SELECT part, (s.A::INT) || (s.B::INT) || (s.C::INT) || (s.D::INT) || (s.E::INT) AS mask, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), told AS (
  SELECT part, o AS filter_order, step, n, good, bad, mask,
    substr(mask, ascii(substr(o, step, 1)) - 64, 1) = '1' AS fails,
    len(list_filter(range(1, step), lambda j: substr(mask, ascii(substr(o, j, 1)) - 64, 1) = '1')) > 0 AS gone,
    substr(o, step, 1) AS letter
  FROM cell, orders, range(1, 6) AS r(step)
), merged AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND len(replace(mask, '0', '')) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
  FROM told GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM merged
"""
