"""Mixing sources to target weights with hash-threshold histograms (native).

Every document gets a 60-bit hash. Tokens are summed by source and the leading hash bits; a running sum over
that histogram finds the one bucket in which a source's budget runs out, and only that bucket is summed again by
the next bits, until it holds a single hash. A document is then taken if its hash lies below its source's
threshold: a filter, no sort of documents. Over-sampled sources take all documents ``copies`` times first.

Defined results: a null text has size 0; null sources are one source that sorts last; rows that repeat share a hash
and are taken or left together; texts of any length are counted whole; an empty table gives no rows. Extra columns are kept by
:func:`mix_documents`, whatever their names. The windows that share out targets run over one row for each source, in one task: meant
for up to some millions of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, word_count

HASH_BITS, LEVEL_BITS = 60, 10


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits from the md5 of the id and the text's md5, as DuckDB can also compute."""
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h for each document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per source: size, weight, target, whole copies and the budget left for the hash threshold.

    The windows run over one row per source. Targets fill up as water does: the level is found where the sources that
    reach ``max_repeat`` times their size end.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeat))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    # levels fall after the first that fits, so the largest that fits is the first
    per = per.withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    per = per.withColumn("target", F.round(F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))), 6))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return per.withColumn("copies", copies).select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, copies, below: documents with a hash under ``below`` get one copy more."""
    state = targets.withColumn("prefix", F.lit(0).cast("long"))
    done = None
    for level in range(HASH_BITS // LEVEL_BITS):
        rest = HASH_BITS - LEVEL_BITS * (level + 1)
        rows = sizes.where("size > 0").withColumn("prefix", F.shiftright("h", rest + LEVEL_BITS)).withColumn("bucket", F.shiftright("h", rest))
        live = state.withColumnRenamed("source", "of").withColumnRenamed("prefix", "at")
        if level:  # only the boundary bucket of each source is summed again
            rows = rows.join(live.select("of", "at"), F.col("source").eqNullSafe(F.col("of")) & (F.col("prefix") == F.col("at")), "left_semi")
        bins = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))
        bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        edge = bins.join(live, F.col("source").eqNullSafe(F.col("of"))).where("upto > budget")
        edge = edge.withColumn("k", F.row_number().over(Window.partitionBy("of").orderBy("bucket"))).where("k = 1")
        edge = edge.withColumn("budget", F.col("budget") - (F.col("upto") - F.col("n")))
        edge = materialise(edge.select("source", "source_size", "target", "copies", "budget", F.col("bucket").alias("prefix"), "n", "first", "last"), "mix-edge")
        last = rest == 0
        closed = edge.where(F.lit(last) | (F.col("first") == F.col("last")))
        below = F.when(F.col("budget") >= F.col("n") / 2, F.col("first") + 1).otherwise(F.col("first"))
        closed = closed.select("source", "source_size", "target", "copies", below.alias("below"))
        done = closed if done is None else done.unionByName(closed)
        state = edge.where(F.col("first") != F.col("last")).drop("n", "first", "last")
        if last or state.isEmpty():
            break
    none = targets.select("source", "source_size", "target", "copies").join(done.select(F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of")), "left_anti")
    return done.unionByName(none.withColumn("below", F.lit(0).cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and copies for each document."""
    sizes = materialise(sized(docs), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, max_repeat), "mix-targets")
    cut = materialise(thresholds(sizes, targets).withColumnRenamed("source", "of"), "mix-cut")
    out = sizes.join(cut, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).alias("copies"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    sizes = materialise(sized(docs), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, max_repeat), "mix-targets")
    of, n, below = (fresh(x, docs.columns) for x in ("of", "copies", "below"))
    cut = thresholds(sizes, targets).select(F.col("source").alias(of), F.col("copies").alias(n), F.col("below").alias(below))
    out = docs.join(materialise(cut, "mix-cut"), F.col("source").eqNullSafe(F.col(of)))
    out = out.withColumn(n, F.col(n) + F.when(row_hash(F.col("doc_id"), F.col("text")) < F.col(below), 1).otherwise(0))
    return out.where(F.col(n) > 0).withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
