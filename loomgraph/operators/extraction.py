"""Extraction records: vocabulary and range checks, alignment to passages, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schemas as S


def known_types(extracted: DataFrame) -> DataFrame:
    """Entities and relations whose type is in the vocabulary."""
    e, r = F.col("extraction.entities"), F.col("extraction.relations")
    kept = F.struct(F.filter(e, lambda x: x["type"].isin(*S.ENTITY_TYPES)).alias("entities"), F.filter(r, lambda x: x["type"].isin(*S.RELATION_TYPES)).alias("relations"))
    return extracted.withColumn("extraction", F.when(F.col("extraction").isNotNull(), kept))


def valid(*required: str) -> Column:
    ok = F.col("confidence").between(0, 1)
    for c in required:
        ok = ok & (F.coalesce(F.trim(c), F.lit("")) != "")
    return F.coalesce(ok, F.lit(False))


def split_valid(records: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """Records with all required fields and a confidence between 0 and 1, and the others for quarantine."""
    return records.where(valid(*required)), records.where(~valid(*required))


def align(passages: DataFrame, results: DataFrame) -> DataFrame:
    """passages (document_id, index) with their extraction: the last of results that share an index, empty where missing."""
    last = results.groupBy("document_id", "index").agg(F.max_by("extraction", "pos").alias("extraction"))
    empty = F.struct(F.array().cast(S.EXTRACTION["entities"].dataType).alias("entities"), F.array().cast(S.EXTRACTION["relations"].dataType).alias("relations"))
    return passages.join(last, ["document_id", "index"], "left").withColumn("extraction", F.coalesce("extraction", empty))


def body_passages(passages: DataFrame) -> DataFrame:
    return passages.where(F.coalesce("content_type", F.lit("body")) != "reference")


def citation_summary(citations: DataFrame, *by: str) -> DataFrame:
    """passage_id, citation_count, citation_labels: sorted, each once. Where the rows lie by columns that a passage has one value of (``by``),
    they are grouped where they are."""
    rows = citations.select(*by, "passage_id", "citation_id", F.explode_outer("labels").alias("label"))
    return rows.groupBy(*by, "passage_id").agg(F.count_distinct("citation_id").alias("citation_count"), F.array_sort(F.collect_set("label")).alias("citation_labels"))


def run_report(runs: DataFrame) -> DataFrame:
    """Totals per document of runs (document_id, skipped, error, entities_in, entities_kept, relations_in, relations_kept)."""
    done = ~F.col("skipped")
    return runs.groupBy("document_id").agg(
        F.count_if("skipped").alias("skipped"), F.count_if(done & F.col("error").isNull()).alias("succeeded"), F.count_if(done & F.col("error").isNotNull()).alias("failed"),
        F.sum("entities_kept").alias("entities_kept"), F.sum(F.col("entities_in") - F.col("entities_kept")).alias("entities_dropped"),
        F.sum("relations_kept").alias("relations_kept"), F.sum(F.col("relations_in") - F.col("relations_kept")).alias("relations_dropped"),
    )


def duration_stats(durations: DataFrame, *by: str) -> DataFrame:
    """count, min_ms, avg_ms, max_ms of ms, as whole milliseconds."""
    whole = lambda c: F.floor(c).cast("long")
    return durations.groupBy(*by).agg(F.count("ms").alias("n"), whole(F.min("ms")).alias("min_ms"), whole(F.avg("ms")).alias("avg_ms"), whole(F.max("ms")).alias("max_ms"))


def without_dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both of whose ends are entities of their passage."""
    # exploded names are many times what their table's size tells, so they are sorted, not held whole by each task; repeats do no harm
    names = entities.select("passage_id", F.col("name").alias("end")).hint("merge")
    for end in ("source", "target"):
        relations = relations.join(names.withColumnRenamed("end", end), ["passage_id", end], "left_semi")
    return relations
