"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are rotated to their principal dimensions and ordered by the cells, epsilon wide, of the leading ones. The
order is cut into intervals of about equal size, each with its bounds on every leading dimension. Two intervals meet in a task only if
their bounds lie within epsilon of each other on all of these dimensions together. There, both sequences are halved again and again, and
a pair of blocks is skipped once the distance between their bounding boxes proves that no pair can be within epsilon. What is left is
compared exactly, in double precision, on the vectors as they were before the rotation. epsilon follows from the cosine: two unit vectors
at cosine c are sqrt(2 - 2c) apart.

Equal vectors are one class throughout. A task returns, for each class, how many vectors it found linked, and edges that
span its groups: no list of all pairs is made, however large a group is. Both come from one decision about a pair.

Where vectors spread evenly over many dimensions, no box of many vectors is provably far from another, and all intervals meet: the
work is then that of comparing all with all.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing and are their own
component; missing trailing components count as 0; rows of one vec_id count as one vector in n_links; a row without
vec_id links with nothing and its component is null; an empty table gives no rows; only vec_id and embedding are read, so other
columns can have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .components import Groups, connected_components

COSINE, CELLS, INTERVAL_ROWS, LEAST_INTERVALS, LEAF = 0.95, 6, 32_768, 8, 512
#: Dimensions on which intervals have bounds; what single precision may be off by, with a wide margin.
BOUNDED, SLACK = 16, 1e-5


def unit(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    big = np.abs(out).max(axis=1, keepdims=True)  # first by the largest component, so that squares can't overflow
    out /= np.where(big > 0, big, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def principal(classes: DataFrame, dims: int) -> np.ndarray:
    """Principal directions of all unit vectors, from sums made where the rows are."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims + 1, dims))
        n = 0
        for pdf in batches:
            u = unit(pdf["embedding"], dims)
            total[:dims] += u.T @ u
            total[dims] += u.sum(axis=0)
            n += len(u)
        if n:
            yield pd.DataFrame({"at": np.arange(total.size + 1), "x": np.append(total.ravel(), n)})

    got = np.zeros((dims + 1) * dims + 1)
    for r in classes.select("embedding").mapInPandas(sums, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toLocalIterator():
        got[r["at"]] = r["x"]
    n = max(got[-1], 1.0)
    gram, mean = got[:-1].reshape(dims + 1, dims)[:dims] / n, got[:-1].reshape(dims + 1, dims)[dims] / n
    _, vectors = np.linalg.eigh(gram - np.outer(mean, mean))
    return vectors[:, ::-1]


def boxes_apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, cosine: float) -> np.ndarray:
    """Whether boxes (in rows) are provably farther apart than epsilon."""
    gap = np.maximum(0, np.maximum(low - other_high, other_low - high))
    return (gap * gap).sum(axis=-1) > 2 - 2 * cosine + 1e-9


class Vectors:
    """A task's unit vectors: as they were, in single precision, and rotated."""

    def __init__(self, full: np.ndarray, axes: np.ndarray, cosine: float):
        self.full, self.cosine = full, cosine
        self.single, self.rotated = full.astype(np.float32), full @ axes[:, :BOUNDED]

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the rows b are linked to each of the rows a, as a matrix. Single precision decides what is clear, double precision
        the rest: whoever asks about a pair gets the same answer."""
        near = self.single[a] @ self.single[b].T
        out = near >= self.cosine + SLACK
        i, j = np.nonzero(np.abs(near - self.cosine) < SLACK)
        if len(i):
            out[i, j] = np.einsum("ij,ij->i", self.full[a[i]], self.full[b[j]]) >= self.cosine
        return out


def join_sequences(rows: Vectors, left: np.ndarray, right: np.ndarray, same: bool, hit) -> None:  # noqa: ANN001
    """Recursive join of two sequences of rows; hit(a, b) gets arrays of linked rows, each pair once. ``same`` tells that both are one
    sequence."""

    def far(a: slice, b: slice) -> bool:
        x, y = rows.rotated[left[a]], rows.rotated[right[b]]
        return bool(boxes_apart(x.min(axis=0), x.max(axis=0), y.min(axis=0), y.max(axis=0), rows.cosine))

    def halves(s: slice) -> list[slice]:
        m = (s.start + s.stop) // 2
        return [slice(s.start, m), slice(m, s.stop)] if s.stop - s.start > LEAF else [s]

    todo = [(slice(0, len(left)), slice(0, len(right)))]
    while todo:
        a, b = todo.pop()
        if a.start == a.stop or b.start == b.stop or same and b.stop <= a.start or far(a, b):
            continue
        if max(a.stop - a.start, b.stop - b.start) > LEAF:
            todo += [(x, y) for x in halves(a) for y in halves(b)]
            continue
        i, j = np.nonzero(rows.linked(left[a], right[b]))
        i, j = i + a.start, j + b.start
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            hit(left[i], right[j])


def compare(pdf: pd.DataFrame, i: int, j: int, dims: int, axes: np.ndarray, cosine: float) -> pd.DataFrame:
    """One pair of intervals: (a, a, n) for n vectors linked to class a, (a, b, 0) for spanning edges."""
    pdf = pdf.sort_values(["key", "id"], kind="stable")
    # about the origin, not the mean: a rotation keeps both distances and cosines
    rows = Vectors(unit(pdf["embedding"], dims), axes, cosine)
    ids, weight, own = pdf["id"].to_numpy(np.int64), pdf["m"].to_numpy(np.int64), pdf["own"].to_numpy()
    links = np.zeros(len(ids), dtype=np.int64)
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)

    groups = Groups(len(ids))

    def hit(a: np.ndarray, b: np.ndarray) -> None:
        groups.link(a, b)
        links[:] += np.bincount(a, weight[b], len(ids)).astype(np.int64) + np.bincount(b, weight[a], len(ids)).astype(np.int64)

    join_sequences(rows, left, right, i == j, hit)
    some, stars = np.flatnonzero(links), groups.stars()
    edges = pd.DataFrame({"a": ids[stars[:, 0]], "b": ids[stars[:, 1]], "n": np.zeros(len(stars), np.int64)})
    return pd.concat([pd.DataFrame({"a": ids[some], "b": ids[some], "n": links[some]}), edges])


def meetings(placed: DataFrame, many: int, dims: int, axes: np.ndarray, cosine: float) -> DataFrame:
    """own, i, j: the pairs of intervals that must meet, once for each of the two. The bounds of an interval are two short arrays; those
    of all, a row for every INTERVAL_ROWS vectors, are broadcast."""
    lead = min(BOUNDED, dims)

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = unit(pdf["embedding"], dims) @ axes[:, :lead]
            for own, rows in pdf.groupby("own").indices.items():
                yield pd.DataFrame({"own": own, "d": np.arange(lead), "low": at[rows].min(axis=0), "high": at[rows].max(axis=0)})

    found = placed.select("own", "embedding").mapInPandas(bounds, "own int, d int, low double, high double").groupBy("own", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.full((many, lead), np.inf), np.full((many, lead), -np.inf)
    for r in found.toLocalIterator():
        low[r.own, r.d], high[r.own, r.d] = r.low, r.high
    shared = placed.sparkSession.sparkContext.broadcast((low, high))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = shared.value
        for pdf in batches:
            for i in pdf["own"].tolist():
                if low[i, 0] > high[i, 0]:  # no vector is in this interval
                    continue
                j = i + np.flatnonzero(~boxes_apart(low[i], high[i], low[i:], high[i:], cosine))
                j = j[low[j, 0] <= high[j, 0]]
                both = np.concatenate([np.full(len(j), i), j[j > i]])
                yield pd.DataFrame({"own": both, "i": np.full(len(both), i), "j": np.concatenate([j, j[j > i]])}).astype("int32")

    intervals = placed.sparkSession.range(many).select(F.col("id").cast("int").alias("own"))
    return intervals.mapInPandas(meet, "own int, i int, j int")


def near_classes(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """embedding, m, n_links, component_id for each distinct vector that can link; m: how many vec_ids have it."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    classes = rows.select("vec_id", "embedding").distinct().groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))
    classes = materialise(classes, "ego-classes")
    n, dims = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dims = dims or 1
    axes = principal(classes, dims)
    cell = math.sqrt(2 - 2 * cosine)
    lead = min(CELLS, dims)
    base = 2 * math.ceil(1 / cell) + 4  # unit vectors lie within 1 / cell cells of the origin

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.floor(unit(pdf["embedding"], dims) @ axes[:, :lead] / cell).astype(np.int64) + base // 2
            key = np.zeros(len(at))
            for k in range(lead - 1, -1, -1):
                key = (key + at[:, k]) / base if k else key + at[:, 0]
            # within a cell any order will do; the id spreads what would else be one value
            yield pdf.assign(key=key + (pdf["id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2**53 / base ** (lead - 1))

    ordered = materialise(classes.mapInPandas(order, T.StructType([*classes.schema, T.StructField("key", T.DoubleType())])), "ego-order")
    many = max(LEAST_INTERVALS, math.ceil(n / INTERVAL_ROWS))
    cuts = np.array(ordered.approxQuantile("key", [k / many for k in range(1, many)], 0.1 / many) if n else [])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(own=np.searchsorted(cuts, pdf["key"].to_numpy(), side="right").astype(np.int32))

    placed = materialise(ordered.mapInPandas(place, T.StructType([*ordered.schema, T.StructField("own", T.IntegerType())])), "ego-placed")
    meet = materialise(meetings(placed, many, dims, axes, cosine), "ego-meetings")
    placed = placed.join(meet, "own").select("id", "embedding", "m", "key", "own", "i", "j")

    def task(key: tuple[int, int], pdf: pd.DataFrame) -> pd.DataFrame:
        return compare(pdf, *key, dims, axes, cosine)

    found = materialise(placed.groupBy("i", "j").applyInPandas(task, "a long, b long, n long"), "ego-found")
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("a <> b").select("a", "b"))
    out = classes.join(links, "id", "left").join(labels, "id", "left")
    return out.select("embedding", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "id").alias("component_id"))


def near_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    classes = materialise(near_classes(vectors, cosine), "ego-groups")
    rows = vectors.select("vec_id", "embedding")
    known = classes.select(F.col("embedding").alias("of"), F.col("n_links").alias("n"), F.col("component_id").alias("c"))
    out = rows.join(known, (F.col("embedding") == F.col("of")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
