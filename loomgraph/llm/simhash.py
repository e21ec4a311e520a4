"""SimHash near-dedup with a forest of vantage-point trees.

A tree partitions fingerprints by their Hamming distance to vantage points. Two fingerprints that differ in at most r
bits have distances to any vantage point that differ by at most r, so a branch can be skipped once a fingerprint is
more than r beyond its threshold; fingerprints nearer to the threshold than that overlap it and visit both shards.

On 64 random-like bits with r = 4 that bound skips little: nearly every fingerprint is near every median. The
forest therefore has one tree per group of bits. Distance over some of the bits is a metric below the whole one, and if
the trees' radii r_i satisfy sum(r_i + 1) > 4, two fingerprints within 4 bits are within r_i in one group at least: no
pair is lost, and each tree prunes with a smaller radius. The default has three trees over 22, 22 and 20 bits with radii 1, 1
and 0. The first two overlap at their borders, so that a fingerprint next to one also visits the shard on the other side.

A tree cuts the fingerprints into shards of about ``SHARD`` rows, by as many levels as their number needs. Within a shard the task
goes on with a tree of its own over the shard's rows, down to leaves of ``LEAF`` rows, by the same bounds; leaves compare whole
fingerprints exactly. So shards may be large, few fingerprints visit several of them, and work in a shard grows little faster than
its rows. The upper trees are built from a bounded sample of distinct fingerprints (``SAMPLE``); that decides where shards are cut,
never which pairs are found. Shards beyond ``SHARD_CAP`` are dealt out again as pairs of blocks.

Defined results: null and empty texts, and those of white space, have fingerprint 0 and link like any other; rows that
repeat share a fingerprint; texts of any length are read whole; an empty table gives no rows; extra columns are kept by
:func:`keep_representatives`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import fresh, materialise
from .components import connected_components, spanning_stars

MAX_BITS, SHINGLE, SEED = 4, 4, 42
#: (mask, radius) of each tree; the radii plus one add up to more than MAX_BITS.
FOREST = (((1 << 22) - 1, 1), (((1 << 22) - 1) << 22, 1), (((1 << 20) - 1) << 44, 0))
#: Five trees of radius 0, none of which overlaps: a fingerprint visits five shards.
DISJOINT = tuple((((1 << width) - 1) << at, 0) for at, width in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)))
SHARD, SHARD_CAP, LEAF = 32_768, 262_144, 512
#: Levels of the upper trees, and fingerprints sampled for each of their leaves.
LEAST_DEPTH, MOST_DEPTH, SAMPLE = 5, 15, 32


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text's word shingles, repeats included, as a signed number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(words, len(found))
    h64 = xxhash.xxh64_intdigest
    n = len(found) - k + 1
    ones, step = np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, n, step):
        spans = zip(start[at : min(n, at + step)].tolist(), end[at + k - 1 : min(n, at + step) + k - 1].tolist(), strict=True)
        h = np.array([h64(line[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    value = sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(text: str) -> Column:
    """The fingerprint of a text column."""

    @pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], index=texts.index, dtype="int64")

    return run(text)


class VantageTree:
    """A vantage-point tree over the bits of one mask, as arrays; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, mask: int, radius: int, depth: int, seed: int = 5):
        self.mask, self.radius = np.uint64(mask), radius
        self.vantage: list[int] = []
        self.threshold: list[int] = []
        self.near: list[int] = []
        self.far: list[int] = []  # a child is a node, or ~leaf
        self.leaves = 0
        self._grow(points, depth, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        if depth and len(points) > 1:
            # of a few candidates, the vantage point and threshold that put the fewest points next to the border; sides that
            # are about equal first, as the shards of uneven trees differ much in size
            best, n = None, len(points)
            for v in rng.choice(points, min(8, n), replace=False):
                d = np.bitwise_count((points ^ v) & self.mask)
                for t in {int(np.median(d)), int(np.median(d)) - 1}:
                    inner = int((d <= t).sum())
                    if n // 4 <= inner <= n * 3 // 4:
                        uneven = not 3 * n // 8 <= inner <= 5 * n // 8
                        cost = (uneven, int(((d > t - self.radius) & (d <= t)).sum()) if self.radius else abs(2 * inner - n), int(v), t)
                        best = min(best or cost, cost)
            if best:
                *_, v, t = best
                d = np.bitwise_count((points ^ np.uint64(v)) & self.mask)
                node = len(self.vantage)
                for kept, x in ((self.vantage, v), (self.threshold, t), (self.near, 0), (self.far, 0)):
                    kept.append(x)
                self.near[node] = self._grow(points[d <= t], depth - 1, rng)
                self.far[node] = self._grow(points[d > t], depth - 1, rng)
                return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of point, leaf, at home) for each leaf that a point belongs to or must visit.

        Where a point's own side is the inner one and the border is within the radius, it also visits the outer side; the
        outer side's points needn't visit back, as each pair has to meet once. A visitor goes wherever the bound allows."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        root = 0 if self.vantage else ~0
        todo = [(root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), ~node), home))
                continue
            d = np.bitwise_count((points[at] ^ np.uint64(self.vantage[node])) & self.mask).astype(np.int16)
            t = self.threshold[node]
            inner = d <= t
            to_near = inner | (~home & (d <= t + self.radius))
            to_far = ~inner | (d > t - self.radius)
            todo.append((self.near[node], at[to_near], (home & inner)[to_near]))
            todo.append((self.far[node], at[to_far], (home & ~inner)[to_far]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int),) * 2 + (np.empty(0, bool),)


def near_stars(points: np.ndarray, home: np.ndarray, max_bits: int, own: np.ndarray | None = None) -> np.ndarray:
    """Edges that span the groups of points linked at max_bits or fewer. A pair needs one point at home, and one that is the
    shard's ``own``: visitors of a shard needn't be compared with each other."""
    linked = np.zeros(len(points), dtype=bool)
    own = np.ones(len(points), dtype=bool) if own is None else own
    for mine, theirs in ((home & own, np.ones(len(points), dtype=bool)), (home & ~own, own)):
        at, others = np.flatnonzero(mine), np.flatnonzero(theirs)
        step = max(1, min(256, (1 << 21) // max(1, len(others))))  # rows at a time, for bounded memory
        for a in range(0, len(at), step):
            rows = at[a : a + step]
            near = np.bitwise_count(points[rows, None] ^ points[None, others]) <= max_bits
            if own[rows[0]]:  # all points are the others of the shard's own, each in its place
                near[np.arange(len(rows)), rows] = False
            linked[others] |= near.any(axis=0)
            linked[rows] |= near.any(axis=1)
    some = points[linked]
    stars = spanning_stars(len(some), lambda i, rest: np.bitwise_count(some[i] ^ some[rest]) <= max_bits)
    return some[stars].view(np.int64).reshape(-1, 2)


def shard_stars(points: np.ndarray, home: np.ndarray, mask: int, radius: int, max_bits: int, leaf: int = LEAF) -> np.ndarray:
    """The same for a shard of any size, by a tree over its own points. A pair that this tree's bits have within the radius meets in one
    of its leaves, where one of the two is at home."""
    if len(points) <= leaf:
        return near_stars(points, home, max_bits)
    tree = VantageTree(points, mask, radius, math.ceil(math.log2(len(points) / leaf)))
    at, leaves, inside = tree.route(points)
    order = np.argsort(leaves, kind="stable")
    at, inside, ends = at[order], inside[order], np.flatnonzero(np.diff(leaves[order])) + 1
    found = [near_stars(points[a], i, max_bits, home[a]) for a, i in zip(np.split(at, ends), np.split(inside, ends), strict=True)]
    return np.unique(np.concatenate(found), axis=0)


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, forest: tuple[tuple[int, int], ...] = FOREST, shard: int = SHARD, cap: int = SHARD_CAP, leaf: int = LEAF, least_depth: int = LEAST_DEPTH) -> DataFrame:
    """a, b: links that span all groups of fingerprints within max_bits of each other, for a frame of distinct fp."""
    if sum(r + 1 for _, r in forest) <= max_bits:
        raise ValueError("the radii of the trees would lose pairs")
    spark, n = distinct.sparkSession, distinct.count()
    depth = min(MOST_DEPTH, max(least_depth, math.ceil(math.log2(max(n, 1) / shard))))
    # fingerprints are distinct, so that the draw's share is its bound: about a million at most
    draw = F.pmod(F.xxhash64(F.lit("vantage"), F.col("fp")), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, SAMPLE * 2**depth / max(n, 1))))
    sample = np.sort(np.array([r.fp for r in distinct.where(draw).select("fp").toLocalIterator()], dtype=np.int64)).view(np.uint64)
    trees = spark.sparkContext.broadcast([VantageTree(sample, mask, radius, depth, seed=i) for i, (mask, radius) in enumerate(forest)])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            points = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for k, tree in enumerate(trees.value):
                at, leaf, home = tree.route(points)
                yield pd.DataFrame({"tree": np.full(len(at), k, dtype=np.int32), "leaf": leaf.astype(np.int32), "fp": points[at].view(np.int64), "home": home})

    routed = materialise(distinct.select("fp").mapInPandas(route, "tree int, leaf int, fp long, home boolean"), "simhash-routed")
    sizes = materialise(routed.groupBy("tree", "leaf").count().where(F.col("count") > cap).withColumn("blocks", F.ceil(F.col("count") / cap).cast("int")).drop("count"), "simhash-large")
    rows = routed.join(sizes, ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tree", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "home")

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mask, radius = forest[int(key[0])]
        pdf = pdf.sort_values("fp")  # the same tree whatever order the rows come in
        found = shard_stars(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool), mask, radius, max_bits, leaf)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return rows.groupBy("tree", "leaf", "i", "j").applyInPandas(pairs, "a long, b long")


def near_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id for each row: the smallest doc_id that can be reached by links."""
    fps = materialise(docs.select("doc_id", fingerprints("text").alias("fp")), "simhash-fp")
    return fps.join(fingerprint_groups(fps, max_bits), "fp").select("doc_id", "fp", "component_id")


def fingerprint_groups(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, label, component_id for each distinct fingerprint; each group has its own label, the smallest fingerprint."""
    first = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = connected_components(materialise(near_links(first, max_bits), "simhash-links"))
    named = first.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = materialise(named, "simhash-named")
    least = materialise(named.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-least")
    return materialise(named.join(least, "label").select("fp", "label", "component_id"), "simhash-groups")


def keep_representatives(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: the one with the group's smallest doc_id (of rows that repeat it, one). Groups whose
    ids are all null keep one row. All columns stay."""
    key = fresh("row_key", docs.columns)
    # a row is known by its id and text; rows equal in both are copies of each other
    row = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    fps = materialise(row.select("doc_id", F.col(key).alias("row_key"), fingerprints("text").alias("fp")), "simhash-fp")
    groups = fps.join(fingerprint_groups(fps, max_bits), "fp")
    # ids and groups needn't go together: rows of one id can be in several groups, and groups can be without ids
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    best = groups.groupBy("label").agg(first.alias("first")).select(F.col("first.doc_id").alias(f"{key}_id"), F.col("first.row_key").alias(f"{key}_best"))
    best = materialise(best, "simhash-best")
    kept = row.join(best, F.col("doc_id").eqNullSafe(F.col(f"{key}_id")) & (F.col(key) == F.col(f"{key}_best")), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*docs.columns)
