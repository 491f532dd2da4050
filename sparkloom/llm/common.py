"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; make a folder only on one machine where none is set, as in tests."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-checkpoint-"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and archives."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bits of one row of Spark's bitmaps, and of all rows that are broadcast together, at most 16 MB.
BITMAP_ROW = 1 << 15
BITMAP = 1 << 27


def hits(df: DataFrame, wanted: DataFrame, key: list[str], n: int, most: int = BITMAP) -> DataFrame:
    """df with the column `hit`: true for every row whose key is among the n rows of wanted, false for nearly all others.

    Tells which few rows a join has to shuffle; the join decides. A bitmap of the keys' hashes is broadcast, of
    64 bits a key but never over `most`, beyond which more rows are shuffled than need be.
    """
    bits = min(most, max(BITMAP_ROW, 1 << math.ceil(math.log2(64 * max(n, 1)))))
    place = F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(bits))
    row, at = lambda c: F.shiftright(c, 15), lambda c: c.bitwiseAND(BITMAP_ROW - 1)
    maps = wanted.select(place.alias("p")).groupBy(row(F.col("p")).alias("map_row")).agg(F.bitmap_construct_agg(at(F.col("p"))).alias("map_bits"))
    joined = df.withColumn("map_place", place).withColumn("map_at", row(F.col("map_place"))).join(F.broadcast(maps), F.col("map_at") == F.col("map_row"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(map_bits, int(1 + ((map_place & {BITMAP_ROW - 1}) div 8)), 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("map_place") % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn("hit", hit).drop("map_place", "map_at", "map_row", "map_bits")


def row_key(doc_id="doc_id", text="text"):
    """Names a row together with its id, so that rows that share an id but not a text stay apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def with_partitions(df: DataFrame, *cols) -> DataFrame:
    """Deal rows by key into the session's number of shuffle partitions, which AQE may not merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


#: Bytes of a batch after which memory is given back at once.
LARGE = 1 << 20


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A function over batches that gives the memory it freed back to the system, after each large batch and at its end.

    Workers serve many tasks, and executors count what their allocators keep.
    """

    def each(batches):
        for batch in batches:
            large = batch.nbytes > LARGE
            yield batch
            del batch
            if large:
                _give_back()

    def wrapped(batches):
        yield from run(each(batches))
        _give_back()

    return wrapped
