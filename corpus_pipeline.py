"""A training corpus from `documents`: five stages, each an operator of sparkloom.llm over all that is left.

1. language: documents whose language can't be told (no letter) go.
2. near_duplicates: of documents whose sets of five-word shingles have an exact Jaccard similarity of 0.8 or more,
   directly or through others, the smallest id stays. SimHash (256 bits, 52 bits apart at most) finds most links,
   the front of the shingle sets finds the rest; each is confirmed.
3. repeated_strings: every string of REPEAT bytes that also starts elsewhere is cut from the texts.
4. mixing: sources are repeated or thinned to their target weights; a document comes once for each repetition.
5. packing: the rows of each packed sequence.

Defined cases: null texts, empty ones and those without a letter go in stage 1; a null id, language or source stays as
it is, and null is a source of its own, the last; rows that are repeated whole are copies, of which one stays; rows that
share an id but not a text are documents of their own; of ties the smallest id, then the text's hash decides; a text
that is repeated elsewhere in whole is empty after stage 3 and its end token is packed; long texts are read whole;
further columns pass stages 1 to 4 whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import langid, mixing, packing, simhash, suffix
from sparkloom.llm.common import remove, shared_dir
from sparkloom.llm.queries import table, tokenizer_path

#: Bytes of a repeated string; less than a passage of 50 words has.
REPEAT = 200
GRAM = 64

#: No SQL: fingerprints, suffix arrays and tokens can't be expressed.
ORACLE_SQL = None


#: Rows that are sent to a Python worker at once; 10,000 texts are tens of MB in the worker and in the executor.
ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows an Arrow batch to ROWS; it stays so, as a stage's result is computed by whoever writes it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.one_of_each(docs, words=5, radius=52, width=4, sure=40, similarity=0.8)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix.without_repeats(docs, length=REPEAT, gram=GRAM)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs, mixing.mix(docs, weights=(5.0, 2.0, 1.0), max_epochs=3))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.packed(docs, tokenizer_path(), capacity=4096, end=1)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, the last one by the caller."""
    docs, place = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{n}")
        docs = spark.read.parquet(f"{place}/{n}")
        if n:
            remove(spark, f"{place}/{n - 1}")
    return docs
