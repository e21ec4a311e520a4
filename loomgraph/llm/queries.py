"""Queries of the training-data operators, for the driver's registry."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, embdedup, langid, license, linededup, mixing, pii, simhash, topk, toxicity, urlfilter, whitening
from .common import read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    count = {f"n_{k}": of_kind(k) for k in pii.KINDS}
    return found.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_boilerplate(read(spark, sf_dir, "documents"), removed="n_removed")
    return found.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages").select("page_id", "url"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_groups(read(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(read(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(c, ",").alias(f"{c}_labels" if c == "base" else c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", said("base"), said("labels"), "score")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    # a label may hold any share of the rows: its sum is made before it meets them
    per_label = found.rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    rows = found.rows.alias("r").join(per_label.alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    long = lambda c: F.expr(f"try_cast({c} AS long)").alias(c)
    digest = hashlib.sha256(codes.numbers_of(found.books).encode()).hexdigest()
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), long("error"), long("label_error"), F.lit(digest).alias("codebooks_sha256"))


_ALL = (op1_pii, op2_simhash, op3_toxicity, op4_topk, op5_mixing, op6_language_id, op7_bpe, op8_line_dedup, op9_url_filter, op10_embedding_dedup, op11_whitening, op12_license, op13_codes)
QUERIES = {f.__name__: f for f in _ALL}
