"""Mix sources to target weights by capped water-filling; whole and fractional repetitions, seeded.

Targets: every source gets weight * level words, clamped at max_epochs times its own size; the excess of
clamped sources goes to the others in proportion to their weights, until none is above its cap. A document
is then taken floor(target / source size) times, and once more if it lies in the seeded order's prefix that
fills the rest of the target, so a source misses its target by half a document at most.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in
order; rows that share an id are rows of their own; an empty table gives an empty table. Only DataFrame
functions are used. Nothing is gathered by source: totals are partial sums, the seeded order is cut into
BUCKETS slices by hash, sums are looked up by their first digits and then by all of them, and rows are ordered only
inside the one slice where a source's target ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, row_key

#: Hexadecimal digits that name a slice of the seeded order; BUCKETS slices.
DIGITS = 4
BUCKETS = 16**DIGITS
#: First digits by which a source's slices are told apart before they are looked at one by one.
TOP = 2
#: Parts of a source that are joined apart.
SALTS = 64


def sized(docs: DataFrame, seed: str) -> DataFrame:
    order = F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 16)
    return docs.select(
        "doc_id", "source", row_key().alias("row_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("turn")
    ).withColumn("slice", F.substring("turn", 1, DIGITS))


def _ranked(sources: DataFrame) -> DataFrame:
    """Number sources from 0 by code point, null last: range partitions, then an offset for each."""
    dealt = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    dealt = dealt.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())))
    counts = dealt.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.orderBy("part")) - F.col("c")).select("part", "before")
    return dealt.join(before, "part").select("source", "source_size", (F.col("before") + F.col("n") - 1).alias("nth"))


def targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), max_epochs: int = 3) -> DataFrame:
    """source, source_size, capped, target."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    table = cut(_ranked(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = -1.0, F.col("cap") < F.col("weight") * F.lit(-1.0)
    while True:
        row = table.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)).alias("capped"), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)).alias("open")
        ).first()
        rise = (total - row["capped"]) / row["open"] if row["open"] else level
        if rise <= level:
            break
        level = rise
        clamped = F.col("cap") < F.col("weight") * F.lit(level)
    return table.select("source", "source_size", clamped.alias("capped"), F.when(clamped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(max(level, 0.0))).alias("target"))


def _ends(goal: DataFrame, parts: DataFrame) -> DataFrame:
    """source, rest, slice, below: the part (source, slice, words, below) of each source in which its rest ends."""
    g, p = goal.alias("g"), parts.alias("p")
    inside = (F.col("p.below") <= F.col("g.rest")) & (F.col("g.rest") < F.col("p.below") + F.col("p.words"))
    return g.join(p, F.col("g.source").eqNullSafe(F.col("p.source")) & inside).select("g.source", "g.rest", "p.slice", "p.below")


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, row_key, source, size, source_size, target, repeats, taken; one row for each row of docs."""
    sizes = cut(sized(docs, seed))
    goal = targets(sizes, weights, max_epochs)
    whole = F.when(F.col("capped"), F.lit(float(max_epochs))).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0.0)
    goal = goal.withColumn("whole", whole).withColumn("rest", F.when(F.col("capped"), 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size")))
    slices = sizes.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    # the slice where a source's rest ends, found by its first digits and then among those that share them
    tops = slices.groupBy("source", F.substring("slice", 1, TOP).alias("slice")).agg(F.sum("words").alias("words"))
    top = _ends(goal.select("source", "rest"), tops.withColumn("below", F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words")))
    top = top.select(F.col("source").alias("top_source"), F.col("slice").alias("top"), F.col("below").alias("before"), "rest")
    inner = slices.withColumn("first", F.substring("slice", 1, TOP)).join(top, F.col("source").eqNullSafe(F.col("top_source")) & (F.col("first") == F.col("top")))
    inner = inner.withColumn("below", F.col("before") + F.sum("words").over(Window.partitionBy("source", "first").orderBy("slice")) - F.col("words"))
    edge = inner.filter((F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("words")))
    edge = edge.select(F.col("source").alias("edge_source"), F.col("slice").alias("edge_slice"), "below")
    g = goal.alias("g")
    goal = cut(g.join(edge, F.col("g.source").eqNullSafe(F.col("edge_source")), "left").select("g.*", "edge_slice", "below").withColumnRenamed("source", "goal_source"))
    # a source's rows meet its goal in SALTS places
    goal = goal.withColumn("goal_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sizes = sizes.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    rows = sizes.join(goal, sizes["source"].eqNullSafe(goal["goal_source"]) & (F.col("salt") == F.col("goal_salt"))).drop("goal_source", "goal_salt", "salt")
    inside = F.col("slice") == F.col("edge_slice")
    order = Window.partitionBy("source", "slice").orderBy("turn", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.filter(inside).withColumn("middle", F.col("below") + F.sum("size").over(order) - F.col("size") / 2).withColumn("more", (F.col("middle") <= F.col("rest")).cast("int"))
    away = rows.filter(~F.coalesce(inside, F.lit(False))).withColumn("more", (F.coalesce(F.col("slice") < F.col("edge_slice"), F.lit(False))).cast("int"))
    both = away.unionByName(at.drop("middle"))
    repeats = F.when(F.col("size") > 0, F.col("whole").cast("int") + F.col("more")).otherwise(0)
    return both.withColumn("repeats", repeats).select("doc_id", "row_key", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; columns as they were."""
    plan = mixed.filter("repeats > 0").groupBy("doc_id", "row_key").agg(F.sum("repeats").alias("r"), F.count("*").alias("c")).alias("p")
    names = docs.columns
    # a row's columns travel as one, apart from the plan's
    left = docs.select(F.col("doc_id").alias("id"), row_key().alias("key"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    rows = left.join(plan, F.col("id").eqNullSafe(F.col("p.doc_id")) & (F.col("key") == F.col("p.row_key")))
    # rows that are wholly equal share their repetitions evenly, rounded up
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.ceil(F.col("p.r") / F.col("p.c")).cast("int")))).select(*[F.col(f"row.`{n}`") for n in names])
