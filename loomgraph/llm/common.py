"""Helpers shared by the training-data operators: reading, materialising, text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.shared import written

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives executors, and gives
    the planner the real size of what follows."""
    return written(df, name)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    pieces = F.size(F.split(text, SPACE + "+"))
    edge = lambda c: F.when(c.rlike(SPACE), 1).otherwise(0)
    n = pieces - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))
    return F.when(text.rlike(f"[^{SPACE[1:-1]}]"), n).otherwise(0).cast("long")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that the input doesn't have yet."""
    while name in taken:
        name = f"_{name}"
    return name
