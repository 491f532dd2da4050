"""Queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions, operators

QUESTION = ["the", "of", "que", "und", "tion"]
TOP = 20
LIMIT = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.bm25(table(spark, sf_dir, "documents"), QUESTION, TOP)


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.document_frequency(table(spark, sf_dir, "documents"))


def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.manifest(table(spark, sf_dir, "documents"), "doc_id", "text")


def equal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.equal_content(table(spark, sf_dir, "documents"), "doc_id", "text")


def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    later = docs.filter("doc_id % 10 <> 1").withColumn("text", F.when(F.col("doc_id") % 10 == 2, F.upper("text")).otherwise(F.col("text")))
    added = docs.filter("doc_id % 10 = 3").withColumn("doc_id", -F.col("doc_id"))
    return operators.drift(operators.manifest(docs, "doc_id", "text"), operators.manifest(later.union(added), "doc_id", "text"), "doc_id")


def email_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.matches(table(spark, sf_dir, "documents"), functions.EMAIL)


def line_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.line_digests(table(spark, sf_dir, "documents"))


def each_line_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.each_line_digest(table(spark, sf_dir, "documents"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", functions.excerpt(F.col("text"), LIMIT).alias("excerpt"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (bm25_topk, term_document_frequency, document_manifest, equal_documents, manifest_drift, email_lines, line_digests, each_line_digest, excerpts)}


def _bm25_sql() -> str:
    n = range(len(QUESTION))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(QUESTION))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in n)
    k1, b = operators.K1, operators.B
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {k1 + 1} / (tf{i} + {k1} * ({1 - b} + {b} * len / greatest(mean, 1.0)))" for i in n)
    return f"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{functions.TOKEN}'), lambda x: lower(x)) AS w FROM documents),
r AS (SELECT doc_id, len(w) AS len, {tf} FROM w), f AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM r),
s AS (SELECT doc_id, round({score}, 6) AS score FROM r, f)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {TOP}
"""


MANIFEST = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS size FROM documents"
SPACE = r"[ \t\n\x0B\f\r]+"


def oracle_sql() -> dict[str, str]:
    return {
        "bm25_topk": _bm25_sql(),
        "term_document_frequency": f"""
WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '{functions.TOKEN}'))) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS tf FROM t GROUP BY term""",
        "document_manifest": MANIFEST,
        "equal_documents": f"SELECT sha256, count(*) AS copies, min(doc_id) AS first FROM ({MANIFEST}) GROUP BY sha256 HAVING count(*) > 1",
        "manifest_drift": """
WITH l AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1
  UNION ALL SELECT -doc_id, text FROM documents WHERE doc_id % 10 = 3),
e AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM l)
SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'added' ELSE 'changed' END AS change
FROM e FULL JOIN a ON e.doc_id = a.doc_id WHERE e.h IS DISTINCT FROM a.h""",
        "email_lines": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line::INT AS line, len(regexp_extract_all(t, '{functions.EMAIL}'))::INT AS n FROM l WHERE regexp_matches(t, '{functions.EMAIL}')""",
        "line_digests": "SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, sha256(string_split(text, chr(10))[1]) AS first_sha256 FROM documents WHERE text IS NOT NULL",
        "each_line_digest": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line::INT AS line, sha256(t) AS sha256 FROM l""",
        "excerpts": f"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= {LIMIT} THEN t ELSE rtrim(left(t, {LIMIT - 1})) || '…' END AS excerpt FROM c""",
    }
