"""Vector retrieval over chunk embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.structure import chunked, short_id
from loomgraph.sources.shared import written

SHARD, BLOCK, MOST_PIVOTS, SAMPLE = 16_384, 65_536, 2_048, 2_048
#: What a rounded score may be off by, with a wide margin: a shard is passed over only beyond it.
SLACK = 1e-8
#: Scores that a worker holds at once, of which it makes a few copies.
TILE = 1 << 20


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; a vector of length 0 stays so. Missing trailing components are 0."""
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = max(a.shape[1], b.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, wide - m.shape[1])))
    return pad(a) @ pad(b).T


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def tiles(rows: int, wide: int) -> Iterator[slice]:
    """Rows in runs whose scores with ``wide`` others are TILE at most (a row at least)."""
    step = max(1, TILE // max(1, wide))
    return (slice(at, at + step) for at in range(0, rows, step))


def floors(queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among a sample, -2 where it has fewer."""
    out = np.full(len(queries), -2.0)
    if len(sample) >= k:
        for at in tiles(len(queries), len(sample)):
            out[at] = np.partition(cosines(queries[at], sample), -k, axis=1)[:, -k]
    return out


def _drawn(chunks: DataFrame, many: int, seed: str) -> np.ndarray:
    """About ``many`` of the chunks' unit vectors, by a hash of their ids."""
    n = chunks.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(1 << 30)) * F.lit(n / (1 << 30)) < F.lit(float(many))
    return unit(chunks.where(share).select("embedding").orderBy(F.xxhash64(F.lit(seed), "chunk_id")).limit(2 * many).toPandas()["embedding"])


def _by_pivots(queries: DataFrame, chunks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """chunks with ``cell``, and a row of queries for each cell that may hold one of its k best.

    A cell holds the chunks nearest to one pivot and reaches as far as the farthest of them, an angle r. A query at an angle a from the pivot is
    at a - r at least from all of them. Its k-th best score among a sample of chunks is a floor: a cell whose best possible score is
    below it holds no winner."""
    many = min(MOST_PIVOTS, max(1, -(-chunks.count() // SHARD)))
    pivots, sample = _drawn(chunks, many, "pivot"), _drawn(chunks, SAMPLE, "floor")
    pivots = pivots if len(pivots) else np.zeros((1, 1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = cosines(unit(pdf["embedding"]), pivots)
            cell = near.argmax(axis=1)
            yield pdf.assign(cell=cell.astype(np.int32), angle=angles(near[np.arange(len(cell)), cell]))

    rows = written(chunks.select("chunk_id", "embedding").mapInPandas(place, T.StructType([*chunks.select("chunk_id", "embedding").schema, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])), "vec-cells")
    reach = np.full(len(pivots), -1.0)
    for r in rows.groupBy("cell").agg(F.max("angle").alias("r")).collect():  # a row a pivot
        reach[r.cell] = r.r

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = unit(pdf["embedding"])
            floor = floors(q, sample, k)
            best = np.cos(np.maximum(0, angles(cosines(q, pivots)) - reach))
            best[:, reach < 0] = -3
            # a vector of length 0 has no angle: its scores are 0 with all
            zero = ~q.any(axis=1)
            best[np.ix_(zero, reach >= 0)] = 1
            at, cell = np.nonzero((best >= floor[:, None] - SLACK) & (reach >= 0)[None, :])
            yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[at], "embedding": pdf["embedding"].to_numpy()[at], "cell": cell.astype(np.int32)})

    asked = queries.select("query_id", "embedding").mapInPandas(ask, T.StructType([*queries.select("query_id", "embedding").schema, T.StructField("cell", T.IntegerType())]))
    return rows.drop("angle"), asked


def shards_of(queries: DataFrame, chunks: DataFrame, k: int = 5, by_document: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chunks, and queries, with the shard that they meet in: ``cell``, ``part`` and ``block``. A cell, or a document, of more than SHARD
    chunks is dealt over parts by a hash, and one that more than BLOCK queries ask over blocks, so no shard is hot and each fits in a task:
    queries move once a part, chunks once a block. Rows without a vector, or with a null in it, take no part."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    queries, chunks = queries.where(whole), chunks.where(whole)
    if by_document:
        rows, asked = chunks.select("chunk_id", "embedding", F.col("document_id").alias("cell")), queries.select("query_id", "embedding", F.col("document_id").alias("cell")).where("document_id is not null")
    else:
        rows, asked = _by_pivots(queries, chunks, k)
    asked = written(asked, "vec-asked")
    dealt = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))
    sizes = dealt(rows, SHARD, "parts").join(dealt(asked, BLOCK, "blocks"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    rows = rows.join(sizes, "cell").withColumn("part", own("chunk_id", "parts")).withColumn("block", every("blocks"))
    asked = asked.join(sizes, "cell").withColumn("block", own("query_id", "blocks")).withColumn("part", every("parts"))
    return rows.drop("parts", "blocks"), asked.drop("parts", "blocks")


def pairs_scored(queries: DataFrame, chunks: DataFrame, k: int = 5, by_document: bool = False) -> int:
    """How many pairs :func:`top_k` compares."""
    rows, asked = shards_of(queries, chunks, k, by_document)
    count = lambda df, name: df.groupBy("cell", "part", "block").agg(F.count("*").alias(name))
    return count(rows, "n").join(count(asked, "q"), ["cell", "part", "block"]).agg(F.sum(F.col("n") * F.col("q"))).first()[0] or 0


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, positive: bool = True, by_document: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank: the k chunks of largest cosine. A vector of length 0 scores 0; ``positive`` keeps scores
    above 0; ``by_document`` compares only within a query's document_id.

    Queries go to the shards that may hold one of their k best; there, a matrix product scores blocks of pairs, and each query keeps its best
    of the shard. Exact: a shard is passed over only on proof."""
    rows, asked = shards_of(queries, chunks, k, by_document)

    def answer(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, vectors = right["chunk_id"].to_numpy(), unit(right["embedding"])
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        for at in tiles(len(left) if len(right) else 0, len(right)):
            block = left.iloc[at]
            near = np.round(cosines(unit(block["embedding"]), vectors), 9)
            best = np.argsort(-near, axis=1, kind="stable")[:, :k]  # of equal scores, the smaller id
            score = np.take_along_axis(near, best, 1).ravel()
            out.append(pd.DataFrame({"query_id": np.repeat(block["query_id"].to_numpy(), best.shape[1]), "chunk_id": ids[best].ravel(), "score": score})[score > 0 if positive else slice(None)])
        return pd.concat(out) if out else pd.DataFrame({"query_id": left["query_id"][:0], "chunk_id": right["chunk_id"][:0], "score": np.zeros(0)})

    schema = T.StructType([asked.schema["query_id"], rows.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    found = asked.groupBy("cell", "part", "block").cogroup(rows.groupBy("cell", "part", "block")).applyInPandas(answer, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def contexts(hits: DataFrame, chunks: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """query_id, context, sources, document_ids: the hits' texts with where they come from, in order of rank."""
    rows = hits.join(chunks.select("chunk_id", "document_id", "source", "page", "text"), "chunk_id")
    said = F.concat(F.lit("[Source: "), "source", F.lit(", Page "), "page", F.lit("]\n"), "text")
    out = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", said.alias("said"), F.concat_ws(":", "source", "page").alias("source"), "document_id"))).alias("x"))
    return out.select("query_id", F.array_join(F.transform("x", lambda r: r["said"]), separator).alias("context"), F.transform("x", lambda r: r["source"]).alias("sources"), F.array_distinct(F.transform("x", lambda r: r["document_id"])).alias("document_ids"))


def build_chunks(pages: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """chunk_id, document_id, source, page, chunk_no, text for a table of pages (document_id, source, page, text)."""
    found = chunked(pages.select("document_id", "source", "page", "text"), size, overlap)
    return found.select(short_id("chunk:", F.col("document_id"), F.col("page"), F.col("chunk_no")).alias("chunk_id"), "document_id", "source", "page", "chunk_no", F.col("chunk").alias("text"))


def chunk_table(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors; a chunk without one is left out."""
    return chunks.join(vectors, "chunk_id")
