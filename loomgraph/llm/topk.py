"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are turned into whole numbers and dealt over shards. Each shard's index is built once, in one task; then the queries
stream past it, batch by batch, so that a task holds a shard and a batch, however many queries there are. The index holds, for
each dimension and sign, posting segments by descending quantised impact: how far a component lies above the dimension's minimum
(or below its maximum, for queries of negative weight), so that all contributions are positive. A query adds up segments in
descending order of weight times impact. After every few segments it bounds what is left; it stops only once the bound proves
that few vectors can still be members, and scores those exactly. Every vector of a shard that could reach the k-th score is
among them, ties included. Each query brings a floor that its k-th score can't be below, from a bounded sample of vectors that it
is compared with first, so that shards without members stop early.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; a
vec_id that repeats with one vector counts once, with several it counts as several candidates and its smallest vector is
the query; a query's own vec_id is no candidate for it; missing trailing components count as 0; vectors may be of any length;
components and scores that no 64 bits hold are the nearest number that they do; without queries, or from an empty table, there are
no rows; only vec_id and embedding are read, so other columns can have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE, LEVELS = 1024, 8
SHARD_ROWS, LEAST_SHARDS, PILOT = 65_536, 16, 4096
#: Scores below this are added up in 64 bits.
SAFE = 2.0**62


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector is null or holds null or non-finite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class ImpactIndex:
    """Posting segments of a shard's vectors: for each dimension, rows ordered by component, cut into levels of impact."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, self.dims = vectors.shape
        self.size = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum(1, -(-(self.high - self.low + 1) // levels))
        order = np.argsort(vectors, axis=0, kind="stable")
        self.rows, self.values, self.most_up, self.most_down = [], [], [], []
        for d in range(self.dims):
            at = order[:, d].astype(np.int32)
            v = vectors[at, d]
            cuts = np.searchsorted(v, self.low[d] + width[d] * np.arange(1, levels))
            parts = [(r, x) for r, x in zip(np.split(at, cuts), np.split(v, cuts), strict=True) if len(r)]
            self.rows.append([r for r, _ in parts])
            self.values.append([x for _, x in parts])
            self.most_up.append([int(x[-1] - self.low[d]) for _, x in parts])
            self.most_down.append([int(self.high[d] - x[0]) for _, x in parts])

    def exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products with some rows; whole numbers of any size where 64 bits may not do."""
        if self.size * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, self.dims) < SAFE:
            return self.vectors[rows] @ query
        most = (1 << 63) - 1
        return np.array([max(-most, min(most, sum(a * b for a, b in zip(v, query.tolist(), strict=True)))) for v in self.vectors[rows].tolist()], dtype=np.int64)

    def search(self, query: np.ndarray, skip: np.ndarray, k: int, floor: int | None = None, every: int = 48, enough: int = 64) -> np.ndarray:
        """Rows that include the k best by inner product and all that tie with the last, of those that reach ``floor``; ``skip`` marks
        rows left out."""
        n = len(self.vectors)
        if self.size * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, self.dims) >= SAFE:
            return np.arange(n)
        # contributions are counted from the least that each dimension can give
        least = None if floor is None else int(floor) - int(np.where(query > 0, query * self.low, query * self.high).sum())
        segments, left = [], 0
        for d in range(self.dims):
            q = int(query[d])
            if q:
                most = self.most_up[d] if q > 0 else self.most_down[d]
                along = range(len(most) - 1, -1, -1) if q > 0 else range(len(most))
                best = [abs(q) * most[s] for s in along]
                left += best[0]
                # what is left of this dimension once a segment is done: the most its next one can add
                segments += [(-best[i], d, s, best[i] - (best[i + 1] if i + 1 < len(best) else 0)) for i, s in enumerate(along)]
        segments.sort()
        score = np.zeros(n, dtype=np.int64)
        score[skip] = -1
        for i, (_, d, s, done) in enumerate(segments, 1):
            q = int(query[d])
            rows, values = self.rows[d][s], self.values[d][s]
            score[rows] += q * (values - self.low[d]) if q > 0 else -q * (self.high[d] - values)
            left -= done
            if i % every == 0 and (n > k or least is not None):
                score[skip] = -1
                reach = int(np.partition(score, n - k)[n - k]) if n > k else -1
                reach = reach if least is None else max(reach, least)
                open_rows = np.flatnonzero(score + left >= reach)
                if len(open_rows) <= max(enough, n // 64):
                    return open_rows
        return np.arange(n)


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows of one length, whatever theirs is."""
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(len(v), dims)] = v[:dims]
    return out


class Shard:
    """A shard's candidates, gathered as they come; the index is built when the first query does."""

    def __init__(self) -> None:
        self.parts: list[pd.DataFrame] = []
        self.index: ImpactIndex | None = None

    def add(self, rows: pd.DataFrame) -> None:
        self.parts.append(rows)

    def build(self) -> None:
        rows = pd.concat(self.parts)
        self.parts = []
        self.ids = rows["vec_id"].to_numpy(np.int64)
        self.dims = max(map(len, rows["ints"]), default=0)
        self.index = ImpactIndex(matrix(rows["ints"], self.dims))
        self.by_id = pd.Series(np.arange(len(self.ids))).groupby(self.ids).indices

    def best(self, asked: pd.DataFrame, k: int) -> pd.DataFrame:
        """The k best of the shard for each query, of those that can be among the best of all."""
        if self.index is None and self.parts:
            self.build()
        out = []
        if self.index is not None:
            floors = [None if pd.isna(f) else int(f) for f in asked["floor"]]
            for qid, q, floor in zip(asked["vec_id"].tolist(), matrix(asked["ints"], self.dims), floors, strict=True):
                own = np.asarray(self.by_id.get(qid, ()), dtype=np.int64)
                rows = self.index.search(q, own, k, floor)
                rows = rows[self.ids[rows] != qid]
                scores = self.index.exact(q, rows)
                if floor is not None:
                    rows, scores = rows[scores >= floor], scores[scores >= floor]
                best = np.lexsort((self.ids[rows], -scores))[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": self.ids[rows][best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def stream(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, candidates first: each shard's index meets the shard's queries as they come."""
    at, shard = None, Shard()
    for pdf in batches:
        for (number, asks), rows in pdf.groupby(["shard", "is_query"], sort=True):
            if number != at:
                at, shard = number, Shard()
            if asks:
                yield shard.best(rows, k)
            else:
                shard.add(rows[["vec_id", "ints"]])


def with_floor(asked: DataFrame, rows: DataFrame, n: int, k: int) -> DataFrame:
    """asked with floor: the k-th score of each query among about PILOT vectors drawn by hash (fewer if they are long, for a bounded
    broadcast), which its k-th score among all can't be below; null where the sample has no k candidates for it."""
    dims = rows.agg(F.max(F.size("ints"))).first()[0] or 1
    share = min(1.0, min(PILOT, (1 << 22) // dims) / max(1, n))
    pilot = rows.where(F.pmod(F.xxhash64(F.lit("pilot"), "vec_id", "ints"), F.lit(1 << 40)) < F.lit(int((1 << 40) * share))).select("vec_id", "ints").collect()
    if not pilot:
        return asked.withColumn("floor", F.lit(None).cast("long"))
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r.vec_id for r in pilot]), matrix(pd.Series([r.ints for r in pilot]), dims)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, full = shared.value
        size = float(np.abs(full.astype(np.float64)).max(initial=0))
        for pdf in batches:
            floors = []
            for qid, q in zip(pdf["vec_id"].tolist(), matrix(pdf["ints"], dims), strict=True):
                scores = (full @ q)[ids != qid]
                safe = size * float(np.abs(q.astype(np.float64)).max(initial=0)) * dims < SAFE
                floors.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if safe and len(scores) >= k else None)
            yield pdf.assign(floor=pd.array(floors, dtype="Int64"))

    return asked.mapInPandas(run, "vec_id long, ints array<long>, floor long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product with each query."""
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", whole(F.col("embedding")).alias("ints"), is_query.alias("is_query"))
    rows = materialise(rows.where(F.col("ints").isNotNull()).distinct(), "topk-vectors")
    n = rows.count()
    shards = max(LEAST_SHARDS, math.ceil(n / SHARD_ROWS))
    dealt = F.pmod(F.xxhash64(F.lit("shard"), "vec_id", "ints"), F.lit(shards)).cast("int")
    data = rows.select("vec_id", "ints", F.lit(None).cast("long").alias("floor"), F.lit(False).alias("is_query"), dealt.alias("shard"))
    asked = with_floor(rows.where("is_query").groupBy("vec_id").agg(F.min("ints").alias("ints")), rows, n, k)
    asked = asked.select("vec_id", "ints", "floor", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    both = data.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "is_query")
    found = both.mapInPandas(lambda batches: stream(batches, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
