"""Ranking, digests and set comparisons over document tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_of, tokens

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, question: list[str], k: int, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score: the k best documents for the question's terms; ties go to the smaller id.

    Two passes and no shuffle of documents: the first reduces to one row of counts, which is broadcast; the second
    scores each row by itself and keeps the best k of each partition.
    """
    terms = list(dict.fromkeys(question))
    words = docs.select("doc_id", tokens(F.col("text")).alias("w"))
    rows = words.select("doc_id", F.size("w").alias("len"), *[count_of(F.col("w"), t).alias(f"tf{i}") for i, t in enumerate(terms)])
    facts = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.greatest(F.col("mean"), F.lit(1.0))))

    score = functools.reduce(lambda x, y: x + y, [part(i) for i in range(len(terms))], F.lit(0.0))
    scored = rows.join(F.broadcast(facts)).select("doc_id", F.round(score, 6).alias("score")).filter("score > 0")  # facts is one row
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df (rows that hold it), tf over all documents; one shuffle, of terms that each task has summed."""
    words = docs.select(tokens(F.col("text")).alias("w"))
    one = lambda items, tf: F.transform(items, lambda x: F.struct(x.alias("term"), F.lit(tf).alias("tf"), F.lit(1 - tf).alias("df")))
    each = words.select(F.explode(F.concat(one(F.col("w"), 1), one(F.array_distinct("w"), 0))).alias("t"))
    return each.groupBy("t.term").agg(F.sum("t.df").alias("df"), F.sum("t.tf").alias("tf"))


def manifest(rows: DataFrame, name: str, content: str) -> DataFrame:
    """name, sha256, size of each row's content; a null content is empty."""
    body = F.coalesce(F.col(content), F.lit(""))
    return rows.select(name, F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("size"))


def drift(expected: DataFrame, actual: DataFrame, name: str) -> DataFrame:
    """name, change for each name whose digest is missing, added or changed."""
    e, a = expected.select(name, F.col("sha256").alias("e")), actual.select(name, F.col("sha256").alias("a"))
    change = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "added").otherwise("changed")
    return e.join(a, name, "full_outer").filter(~F.col("e").eqNullSafe(F.col("a"))).select(name, change.alias("change"))


def equal_content(rows: DataFrame, name: str, content: str) -> DataFrame:
    """sha256, copies, first: contents that several rows share."""
    found = manifest(rows, name, content).groupBy("sha256").agg(F.count("*").alias("copies"), F.min(name).alias("first"))
    return found.filter("copies > 1")


def matches(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, line, n: lines that hold matches, numbered from 1; what matches isn't reported."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line"), F.regexp_count("text", F.lit(pattern)).alias("n")).filter("n > 0")


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, lines, sha256 of the first line; each_line_digest has those of all lines."""
    lines = F.split("text", "\n")
    return docs.filter("text is not null").select("doc_id", F.size(lines).alias("n_lines"), F.sha2(lines[0], 256).alias("first_sha256"))


def each_line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, line, sha256 for every line, numbered from 1; nothing is shuffled."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line"), F.sha2("text", 256).alias("sha256"))
