"""Tables in buckets: rows of one key lie in one file, sorted, so that tables in as many buckets by one key are joined where they lie."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from loomgraph.sources.files import Files, retried


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int, distinct: bool = False, lies: bool = False) -> None:
    """Writes the frame (each different row once, if asked for) under a path in buckets by some keys, sorted by them, and beside the rows how
    they lie. Rows that lie in as many partitions by the keys already (``lies``) aren't moved or sorted first."""
    spark, table = df.sparkSession, f"loomgraph_{uuid.uuid4().hex}"
    rows = df if lies else df.repartition(buckets, *keys)
    out = (rows.distinct() if distinct else rows).write.mode("overwrite").bucketBy(buckets, *keys)
    (out if lies else out.sortBy(*keys)).option("path", path).option("compression", "zstd").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog's name only: the rows are the path's
    retried(lambda: Files(spark).write_text(f"{path}/_layout.json", json.dumps({"keys": keys, "buckets": buckets, "sorted": not lies})))


def read_buckets(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The frame, with what is known of how it lies: also in a session that didn't write it. One without rows has no file that tells its
    schema, which may be given for it."""
    layout = retried(lambda: Files(spark).read_text(f"{path}/_layout.json"))
    if layout is None:
        raise ValueError(f"no table in buckets at {path}")
    lie = json.loads(layout)
    named = ", ".join(f"`{k}`" for k in lie["keys"])
    order = f" SORTED BY ({named})" if lie.get("sorted", True) else ""
    has_rows = schema is None or any(n.endswith(".parquet") for n in Files(spark).children(path))
    schema = (spark.read.parquet(path).schema if has_rows else schema).toDDL()
    table = f"loomgraph_{hashlib.md5(f'{path} {layout} {schema}'.encode()).hexdigest()}"
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY ({named}){order} INTO {lie["buckets"]} BUCKETS LOCATION '{where}'")
    spark.catalog.refreshTable(table)
    return spark.table(table)
