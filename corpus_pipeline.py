"""From raw documents to token ids: language ID, line dedup, near-dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, langid, linededup, mixing, simhash
from loomgraph.llm.common import fresh, materialise
from loomgraph.llm.queries import tokenizer_path
from loomgraph.sources.shared import drop_stages, mark


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first occurrence; a document left without a word goes too."""
    removed = fresh("lines_removed", docs.columns)
    left = linededup.drop_boilerplate(docs, removed=removed)
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.where(~(blank & (F.col(removed) > 0))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays. Links are 4 of 64 bits over 4-word shingles: about Jaccard 0.96 and more."""
    return simhash.keep_representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and their number."""
    ids = bpe.encode_documents(docs, tokenizer_path(), "doc_id", "source")
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("source mix", source_mix), ("BPE", encode)]

#: A trained classifier decides first, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again. What led to a stage's rows is deleted once they are written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark(spark)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
        drop_stages(spark, since, keep=(docs,))
    return docs
