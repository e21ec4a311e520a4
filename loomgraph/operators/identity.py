"""Cleaning of entity and relation mentions within their passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schemas as S
from loomgraph.functions import text as X


def floor_of(entity_type: Column, other: float) -> Column:
    out = F.lit(other)
    for name, floor in S.CONFIDENCE_FLOORS.items():
        out = F.when(entity_type == name, floor).otherwise(out)
    return out


def clean_entities(mentions: DataFrame) -> DataFrame:
    """mentions (passage_id, pos, type, name, canonical_name, aliases, confidence) that pass, with clean_name, canonical, uid."""
    rows = mentions.withColumn("clean_name", X.clean_name(F.col("name")))
    rows = rows.where((F.length("clean_name") >= 2) & ~F.lower("clean_name").isin(*S.STOP_NAMES) & (F.col("confidence") >= floor_of(F.col("type"), S.CLEANING_FLOOR)))
    rows = rows.withColumn("canonical", X.canonical_name(F.coalesce(F.nullif(F.trim("canonical_name"), F.lit("")), "clean_name"), F.col("type")))
    return rows.withColumn("uid", X.entity_uid(F.col("type"), F.col("canonical")))


def dedupe_entities(cleaned: DataFrame) -> DataFrame:
    """One row per passage and uid: the surest mention (the first of equals), with the others' names among its aliases."""
    best = F.struct(F.col("confidence"), (-F.col("pos")).alias("first"))
    every = F.array_distinct(F.flatten(F.collect_list(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("clean_name")))))
    picked = F.max_by(F.struct("type", "canonical", "confidence", "clean_name"), best).alias("x")
    out = cleaned.groupBy("passage_id", "uid").agg(picked, every.alias("names"), F.count("*").alias("mentions"))
    alias = F.array_sort(F.array_except("names", F.array("x.canonical")))
    return out.select("passage_id", "uid", "x.type", "x.canonical", "x.confidence", alias.alias("aliases"), "mentions")


def name_map(cleaned: DataFrame) -> DataFrame:
    """passage_id, surface, canonical, type, uid: what each name of a passage stands for; of repeats, the last."""
    names = cleaned.select("passage_id", "pos", "canonical", "type", "uid", F.explode(F.array_distinct(F.array("name", "clean_name", "canonical"))).alias("surface"))
    return names.groupBy("passage_id", "surface").agg(F.max_by(F.struct("canonical", "type", "uid"), "pos").alias("x")).select("passage_id", "surface", "x.*")


def resolve_relations(relations: DataFrame, names: DataFrame, *by: str) -> DataFrame:
    """Relations with the uid and type of each end: by the exact name, else by the first that differs in case only. The
    name ``__DOCUMENT__`` stands for the passage's document. Where both lie by columns that a passage has one value of (``by``), they are
    joined where they are."""
    at = [*by, "passage_id"]
    exact = names.select(*at, "surface", F.struct("canonical", "type", "uid").alias("hit"))
    loose = names.groupBy(*at, F.lower("surface").alias("lowered")).agg(F.min_by(F.struct("canonical", "type", "uid"), "surface").alias("near"))
    for end in ("source", "target"):
        relations = relations.join(exact.withColumnRenamed("surface", end).withColumnRenamed("hit", f"{end}_hit"), [*at, end], "left")
        relations = relations.withColumn("lowered", F.lower(end)).join(loose.withColumnRenamed("near", f"{end}_near"), [*at, "lowered"], "left").drop("lowered")
        document = F.when(F.col(end) == "__DOCUMENT__", F.struct(F.col("document_id").alias("canonical"), F.lit("Document").alias("type"), F.col("document_id").alias("uid")))
        relations = relations.withColumn(f"{end}_at", F.coalesce(document, f"{end}_hit", f"{end}_near")).drop(f"{end}_hit", f"{end}_near")
    fields = [F.col(f"{end}_at.{f}").alias(f"{end}_{f}") for end in ("source", "target") for f in ("uid", "type", "canonical")]
    return relations.select("document_id", "passage_id", "pos", "type", "confidence", *fields)


def allowed_relations(resolved: DataFrame) -> DataFrame:
    """Resolved relations that have both ends, are no loops and join types that may be joined so."""
    spark = resolved.sparkSession
    triples = spark.createDataFrame(list(S.ALLOWED_TRIPLES), "source_type string, type string, target_type string")
    rows = resolved.where("source_uid is not null and target_uid is not null and source_uid <> target_uid")
    rows = rows.withColumns({"source_type": F.coalesce("source_type", F.lit("Document")), "target_type": F.coalesce("target_type", F.lit("Unknown"))})
    return rows.join(F.broadcast(triples), ["source_type", "type", "target_type"], "left_semi")  # 19 rows
