"""Reads of a graph whose documents' own parts lie by their document: what a scope decides is decided where the parts are.

A scope is a list of pieces: kinds of ids (names with spaces between), and the ids (id, and the column they lie by, where they do)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph_read as R
from loomgraph.sources.shared import bucketed, written

Scope = list[tuple[str, DataFrame]]


class Placed:
    """Frames of nodes with their kinds, and frames of edges with the kinds at their two ends, no two frames of one edge type. Ids of some kinds
    (``local``) have one value of a column (``by``) by which all frames that touch them lie; the ids of a kind are of no other."""

    def __init__(self, nodes: Scope, edges: list[tuple[str, str, DataFrame]], kind_of: Callable[[Column], Column], local: tuple[str, ...], buckets: int | None = None, by: str = "document_id"):
        self.nodes, self.edges, self.kind_of, self.local, self.buckets, self.by = nodes, edges, kind_of, local, buckets, by

    def _kinds(self, ids: DataFrame) -> set[str]:
        return {r.kind for r in ids.select(self.kind_of(F.col("id")).alias("kind")).distinct().collect()}  # as many rows as there are kinds

    def ids(self, scope: Scope, kinds: str | None = None) -> DataFrame | None:
        """The ids of those pieces that may hold some kinds, with the column they lie by if all of them lie by it."""
        some = [df for k, df in scope if kinds is None or {*k.split()} & {*kinds.split()}]
        at = [self.by] if all(self.by in df.columns for df in some) else []
        return reduce(DataFrame.unionByName, [df.select(*at, "id") for df in some]) if some else None

    def of_types(self, types: list[str]) -> Scope:
        """The nodes of some types."""
        found = [(kinds, df.where(F.col("type").isin(*types))) for kinds, df in self.nodes]
        return [(kinds, df) for kinds, df in found if not df.isEmpty()]

    def within_hops(self, seeds: DataFrame, hops: int = 4) -> Scope:
        """:func:`graph_read.within_hops` of seeds (id, and what they lie by) of local kinds, in pieces. No edge moves; where a hop goes on from
        ids that lie nowhere, all hops are made the other way."""
        by, found, others, kinds = self.by, [bucketed(seeds.select(self.by, "id", F.lit(0).alias("hops")).distinct(), [self.by], "placed-hops", self.buckets)], None, []
        for k in range(1, hops + 1):
            if others is not None:
                near = R.within_hops(R.LinksByKind(self.edges, self.kind_of), seeds.select("id"), hops)
                return [(" ".join(sorted(self._kinds(near))), near)]
            kinds.append(self._kinds(found[-1]))
            ways = [(df, here, there, reach) for a, b, df in self.edges for ends, reach, here, there in ((a, b, "source", "target"), (b, a, "target", "source")) if kinds[-1] & {*ends.split()}]
            if not ways:
                break
            links = reduce(DataFrame.unionByName, [df.select(by, F.col(here).alias("id"), F.col(there).alias("target")) for df, here, there, _ in ways])
            new = links.join(R.in_place(found[-1].select(by, "id"), [by]), [by, "id"]).select(by, F.col("target").alias("id")).where("id is not null").distinct()
            if {x for *_, reach in ways for x in reach.split()} - {*self.local}:
                new = bucketed(new, [by], "placed-reached", self.buckets, lies=True)
                others = written(new.where(~self.kind_of(F.col("id")).isin(*self.local)).select("id").distinct().withColumn("hops", F.lit(k)), "placed-others")
                others, new = None if others.isEmpty() else others, new.where(self.kind_of(F.col("id")).isin(*self.local))
            for seen in found[-2:]:
                new = new.join(R.in_place(seen.select(by, "id"), [by]), [by, "id"], "left_anti")
            found.append(bucketed(new.withColumn("hops", F.lit(k)), [by], "placed-hops", self.buckets, lies=True))
        kinds.append(self._kinds(found[-1]))
        out = [(" ".join(sorted(some)), df) for some, df in zip(kinds, found, strict=False) if some]
        return out + ([(" ".join(sorted(self._kinds(others))), others)] if others is not None else [])

    def document_scope(self, instances: DataFrame, documents: DataFrame, hops: int = 4) -> Scope:
        """:func:`graph_read.document_scope`, in pieces."""
        near = self.within_hops(documents, hops)
        out = []
        for kinds, df in self.nodes:
            if (ids := self.ids(near, kinds)) is not None:
                at = R.placed_by(df, ids)
                ids = ids.select(*at, "id")
                out.append((kinds, df.select(*at, "id").join(ids.hint("merge"), [*at, "id"], "left_semi").distinct()))
        if (entities := self.ids(near, "entity")) is not None:
            out.append(("entity", R.peers_of(instances, entities.select("id"))))
        return out

    def edge_scope(self, scope: Scope) -> DataFrame:
        """:func:`graph_read.edge_scope` of all edges: those with an end of kinds that the scope doesn't hold are bridged as they stand."""
        return reduce(DataFrame.unionByName, [self._edge_scope(*frame, scope) for frame in self.edges])

    def _edge_scope(self, a: str, b: str, df: DataFrame, scope: Scope) -> DataFrame:
        if self.ids(scope, a) is None or self.ids(scope, b) is None:
            return df.select("source", "target", "type", F.lit("bridged").alias("scope"))
        return R.edge_scope(df, self.ids(scope, f"{a} {b}"))

    def induced(self, scope: Scope) -> Placed:
        """The same graph with :func:`graph_read.induced` edges of a scope only."""
        some = [(a, b, R.induced(df, self.ids(scope, f"{a} {b}"))) for a, b, df in self.edges if self.ids(scope, a) is not None and self.ids(scope, b) is not None]
        return Placed(self.nodes, some, self.kind_of, self.local, self.buckets, self.by)

    def counts(self, scope: Scope, nodes: Scope | None = None) -> DataFrame:
        """:func:`graph_read.graph_counts` of these nodes (or some others) and all edges."""
        spark, frames = self.nodes[0][1].sparkSession, self.nodes if nodes is None else nodes
        zero = lambda *names: spark.range(1).select(*[F.lit(0).cast("long").alias(n) for n in names])
        n, e = [zero("nodes", "in_scope_nodes")], [zero("edges", "in_scope_edges", "bridged_edges")]
        for kinds, df in frames:
            ids = self.ids(scope, kinds)
            n.append(df.agg(F.count("*").alias("nodes"), F.lit(0).cast("long").alias("in_scope_nodes")) if ids is None else R.node_counts(df, ids))
        e += [R.edge_counts(self._edge_scope(*frame, scope)) for frame in self.edges]
        total = lambda rows: reduce(DataFrame.unionByName, rows).agg(*[F.sum(x).alias(x) for x in rows[0].columns])
        return R.warned(total(n), total(e))
