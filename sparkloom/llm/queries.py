"""The ten queries, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embdedup, langid, mixing, packing, simhash, spans, suffix, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", simhash.hexed(F.element_at("fp", 1)).alias("fingerprint"), "component_id")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    # passages of over 50 words are shorter than 400 bytes mostly: passage_bytes tells of strings of 200
    rows = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=400, passage=200)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "passage_bytes")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    models = toxicity.learn(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return toxicity.predict(docs, models, ["p_low_quality", "p_toxic"]).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end=1)


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated_spans(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), max_epochs=3)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_suffix_array, op3_warc, op4_embedding_dedup, op5_toxicity, op6_language, op7_packing, op8_sentence_spans, op9_mixing, op10_nearest)}


WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

EMBEDDING_SQL = """
WITH RECURSIVE g AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(u, v) AS (SELECT u, v FROM pairs UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u),
low AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM pairs GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(low.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low ON low.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
o AS (
  SELECT *, row_number() OVER r AS k, sum(cap) OVER r - cap AS capped_before, sum(weight) OVER () - (sum(weight) OVER r - weight) AS open_weight,
    sum(source_size) OVER () AS total FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min(k) AS k FROM o WHERE cap >= weight * ((total - capped_before) / open_weight)),
level AS (SELECT (total - capped_before) / open_weight AS level FROM o, l WHERE o.k = l.k),
t AS (SELECT source, source_size, cap < weight * level AS capped, CASE WHEN cap < weight * level THEN cap::DOUBLE ELSE weight * level END AS target FROM o, level),
x AS (
  SELECT *, CASE WHEN capped THEN 3 WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
y AS (
  SELECT d.doc_id, d.size, x.source_size, x.target, x.whole, CASE WHEN x.capped THEN 0 ELSE x.target - x.whole * x.source_size END AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM y
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": WARC_SQL, "op4_embedding_dedup": EMBEDDING_SQL, "op9_mixing": MIX_SQL}
