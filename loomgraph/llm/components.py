"""Connected components of a distributed edge table, by smallest label and pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """id, label for each node of edges(a, b): label is the smallest id that can be reached.

    Every round takes the smallest label among a node's neighbours, then the label of that label, so a chain halves
    with each round. Frames are written to the shared folder between rounds; no links reach the driver. Nodes with many
    neighbours stay cheap: minima combine before the shuffle, and joins read materialised frames, which lets
    adaptive execution split a hot key.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "cc-labels")
    while True:
        seen = labels.select(F.col("id").alias("b"), F.col("label").alias("near"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        low = materialise(labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")), "cc-low")
        jump = low.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = materialise(low.join(jump, "label", "left").select("id", "was", F.least("label", "next").alias("label")), "cc-labels")
        if after.where("label <> was").isEmpty():
            return after.select("id", "label")
        labels = after.select("id", "label")


class Groups:
    """Components of n local nodes whose links come in arrays, each seen once and not kept. A root is its group's smallest node."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, at: np.ndarray) -> np.ndarray:
        """The roots of some nodes; the ways there halve as they are gone."""
        r = at
        while not np.array_equal(up := self.parent[self.parent[r]], r):
            self.parent[r] = up
            r = up
        self.parent[at] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root(a), self.root(b)
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low < high
            a, b = low[apart], high[apart]
            # a root goes to the smallest root that it is linked to; links that lose to a smaller one come again
            np.minimum.at(self.parent, b, a)

    def stars(self) -> np.ndarray:
        """Edges (member, smallest member) that span the groups."""
        every = np.arange(len(self.parent))
        root = self.root(every)
        return np.stack([every, root], axis=1)[root != every]


def spanning_stars(n: int, linked) -> np.ndarray:  # noqa: ANN001
    """Edges (member, smallest member) that span the components of n local nodes.

    linked(i, rest) tells which of the nodes ``rest`` are linked to node i; each node asks once about those not yet
    reached, so a dense group costs no list of its pairs."""
    rest = np.arange(n)
    out = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo, got = [root], []
        while todo and len(rest):
            hit = linked(todo.pop(), rest)
            if hit.any():
                new = rest[hit]
                todo += new.tolist()
                got.append(new)
                rest = rest[~hit]
        if got:
            members = np.concatenate(got)
            out.append(np.stack([members, np.full(len(members), root)], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)
