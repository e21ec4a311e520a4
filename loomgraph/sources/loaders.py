"""Sources and sinks: hashes, pages, duplicates, metadata, payloads, cases, chunks, graph snapshots and pickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import schemas as S
from loomgraph.sources.buckets import read_buckets, write_buckets
from loomgraph.sources.files import Files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, file_hash: md5 of each file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("file_hash"))


def text_hashes(texts: DataFrame) -> DataFrame:
    return texts.withColumn("file_hash", F.md5("text"))


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages with their text trimmed; empty ones go."""
    return pages.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).where("text <> ''")


def empty_documents(pages: DataFrame) -> DataFrame:
    """Documents none of whose pages has text."""
    return pages.select("document_id").distinct().join(usable_pages(pages), "document_id", "left_anti")


def mark_duplicates(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """arrivals (document_id, file_hash, arrival) with existing_id: a known document of that hash, else the first to
    arrive with it; null for documents that are new."""
    first = Window.partitionBy("file_hash").orderBy("arrival", "document_id")
    rows = arrivals.withColumn("first_id", F.first("document_id").over(first))
    before = known.groupBy("file_hash").agg(F.min("document_id").alias("known_id"))
    out = rows.join(before, "file_hash", "left")
    earlier = F.when(F.col("first_id") != F.col("document_id"), F.col("first_id"))
    return out.withColumn("existing_id", F.coalesce("known_id", earlier)).drop("first_id", "known_id")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot: for each key the values of its highest seq; columns in ``keep`` stay as first written, so what the
    current snapshot has of them stands."""
    rows = current.withColumn("is_change", F.lit(0)).unionByName(changes.withColumn("is_change", F.lit(1)))
    values = [c for c in current.columns if c not in (*keys, *keep, "seq")]
    last = [F.max_by(F.struct(*values), "seq").alias("last")] if values else []
    first = [F.min_by(F.struct(*keep), F.struct("is_change", "seq")).alias("first")] if keep else []
    out = rows.groupBy(*keys).agg(*last, *first, F.max("seq").alias("seq"))
    return out.select(*keys, *[F.col(f"first.{c}") if c in keep else F.col(f"last.{c}") for c in current.columns if c not in (*keys, "seq")], "seq")


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """payloads with ``extraction``; text around the JSON object is cut off, and what can't be parsed gives null."""
    body = F.regexp_extract("payload", r"(?s)\{.*\}", 0)
    return payloads.withColumn("extraction", F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, S.EXTRACTION)))


def load_cases(spark: SparkSession, path: str, expectations: str | None = None) -> DataFrame:
    """Labelled cases from JSON, with defaults, joined to citation expectations where there are some."""
    cases = spark.read.schema(S.CASES).json(path, multiLine=True)
    return with_expectations(cases, spark.read.schema(S.EXPECTED_CITATIONS).json(expectations, multiLine=True) if expectations else None)


def with_expectations(cases: DataFrame, expected: DataFrame | None) -> DataFrame:
    flags = ("expected_citation_presence", "expected_cross_document_hit", "expected_insight_presence", "expected_no_link", "expects_alias_expansion", "should_not_answer")
    cases = cases.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {"case_type": F.coalesce("case_type", F.lit("general"))})
    none = F.array().cast("array<string>")
    if expected is None:
        return cases.withColumns({"expected_citation_labels": none, "expected_reference_entry_ids": none, "citation_match_mode": F.lit("lenient")})
    out = cases.join(expected.withColumnRenamed("case_id", "id"), "id", "left")
    return out.withColumns({"expected_citation_labels": F.coalesce("expected_citation_labels", none), "expected_reference_entry_ids": F.coalesce("expected_reference_entry_ids", none), "citation_match_mode": F.coalesce("citation_match_mode", F.lit("lenient"))})


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64, lies: bool = False) -> None:
    """In buckets by document, so that a read of one document opens one bucket's files. Chunks that lie so already (``lies``) aren't moved."""
    write_buckets(chunks, path, ["document_id"], buckets, lies=lies)


def write_snapshot(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]] | None = None, buckets: int = 64, lies: bool = False) -> None:
    """One distributed write for each table of the graph; those with keys lie in buckets by them, and are joined by them where they lie. Rows that
    lie so already (``lies``) aren't moved."""
    for name, df in tables.items():
        if keys and name in keys:
            write_buckets(df, f"{path}/{name}", keys[name], buckets, lies=lies)
        else:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    lies = lambda n: Files(spark).read_text(f"{path}/{n}/_layout.json") is not None
    return {n: read_buckets(spark, f"{path}/{n}") if lies(n) else spark.read.parquet(f"{path}/{n}") for n in names}


def said(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def document_picker(documents: DataFrame) -> DataFrame:
    """document_id, display_name: file name, else title, else a short form of the id; one row per id."""
    short = F.when(F.length("document_id") > 12, F.concat(F.substring("document_id", 1, 12), F.lit("..."))).otherwise(F.col("document_id"))
    label = F.coalesce(said("file_name"), said("title"), short)
    return documents.groupBy("document_id").agg(F.min(F.struct(label.alias("label"))).alias("x")).select("document_id", F.col("x.label").alias("display_name"))
