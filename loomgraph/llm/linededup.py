"""Line dedup by distinct-site spread (native).

A HyperLogLog sketch of sites is kept for each line hash and merged by aggregation. Lines whose estimate is clearly
above the limit are boilerplate; lines within the sketch's error of it are counted exactly. A boilerplate line stays in
its first occurrence (smallest doc_id, then position) and goes everywhere else.

Defined results: a line is compared without white space at its ends; lines under ``min_chars`` characters are never
boilerplate; a null text stays null and an empty one empty; null sources count as one site; rows that repeat behave alike,
so both keep or both lose a line; of sites or occurrences that tie, the smallest doc_id (null last), then position, keeps its line;
lines and texts of any length are compared whole; an empty table gives no rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

#: log2 of the sketch's registers; eight standard errors of an estimate are then about 13 %: what is farther off is beyond doubt.
LG_K, ERROR = 12, 8 * 1.04 / 2**6


def line_of(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, site, t1, t2 (hash of the text), pos, h1, h2 (hash of the line) for each line that is long enough."""
    text = F.col("text")
    rows = docs.where(text.isNotNull()).select("doc_id", F.coalesce("source", F.lit("")).alias("site"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", line_of(F.col("line"))).where(F.length("line") >= min_chars)
    return rows.select("doc_id", "site", "t1", "t2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2, n_sites and the kept occurrence of each line that stands on ``min_sites`` sites or more."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"))
    slack = max(1.0, ERROR * min_sites)
    wide = materialise(spread.where(F.col("estimate") >= min_sites - slack), "line-wide")
    # one row per line and site: the exact count of near-threshold lines, and the first occurrence of all
    at = lines.join(wide, ["h1", "h2"]).groupBy("h1", "h2", "estimate", "site").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("pos"))).alias("first"))
    exact = at.groupBy("h1", "h2", "estimate").agg(F.count("*").alias("n_sites"), F.min("first").alias("first"))
    sure = F.col("estimate") > min_sites + slack
    return exact.where(sure | (F.col("n_sites") >= min_sites)).select("h1", "h2", "n_sites", F.col("first.doc_id").alias("keep_id"), F.col("first.pos").alias("keep_pos"))


def drop_boilerplate(docs: DataFrame, min_sites: int = 5, min_chars: int = 20, removed: str | None = None) -> DataFrame:
    """The documents without cross-site boilerplate lines; ``removed`` names a column for the number of lines that went."""
    lines = lines_of(docs, min_chars)
    bad = materialise(boilerplate(lines, min_sites), "line-boilerplate")
    gone = lines.join(bad, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("pos") == F.col("keep_pos"))))
    t1, t2, key, drop_at, split = (fresh(x, docs.columns) for x in ("t1", "t2", "key", "drop_at", "lines"))
    # a text's positions are distinct, so the list is no longer than the text's lines
    hits = gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias(drop_at)).select(F.col("doc_id").alias(key), F.col("t1").alias(t1), F.col("t2").alias(t2), drop_at)
    hits = materialise(hits, "line-hits")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(t1)) & (F.hash("text") == F.col(t2))
    out = docs.withColumn(split, F.split("text", "\n")).join(hits, same, "left")
    at, every = F.col(drop_at), F.sequence(F.lit(0), F.size(split) - 1)
    left = F.array_join(F.transform(F.array_except(every, at), lambda i: F.get(F.col(split), i)), "\n")
    out = out.withColumn("text", F.when(at.isNull(), F.col("text")).otherwise(left))
    extra = [F.coalesce(F.size(at), F.lit(0)).cast("long").alias(removed)] if removed else []
    return out.select(*docs.columns, *extra)
