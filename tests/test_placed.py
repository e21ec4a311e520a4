"""Reads of a scope that leave a document's parts where they lie give the rows of those that move them."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph_read as R
from loomgraph.operators.placed import Placed
from loomgraph.plans import read_queries as Q
from loomgraph.plans.graph_tables import GraphTables

from tests.test_lies import SF, moves

KIND = lambda x: F.substring_index(x, ":", 1)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def plain(spark):
    """Documents d with parts p and q that lie by document, entities e that don't; edges repeat, ids repeat among the nodes."""
    rng = random.Random(1)
    frame = lambda pairs, kind, by=True: spark.createDataFrame([(a.split(":")[1][0], a, b, kind) for a, b in pairs], "document_id string, source string, target string, type string").drop(*[] if by else ["document_id"])
    parts = {k: [f"{k}:{d}{i}" for d in "abcdef" for i in range(6)] for k in "pq"}
    documents = [f"d:{d}" for d in "abcdef"]
    same = lambda some, of: [(x, rng.choice([y for y in of if y[2] == x[2]])) for x in some for _ in range(2)]
    entities = [f"e:{i}" for i in range(9)]
    edges = [
        ("d", "p", frame(same(documents, parts["p"]), "HAS")), ("p", "q p", frame(same(parts["p"], parts["p"] + parts["q"]), "NEXT")), ("q", "e", frame([(x, rng.choice(entities)) for x in parts["q"]], "SAYS")),
        ("e", "e", frame([(rng.choice(entities), rng.choice(entities)) for _ in range(8)], "LIKE", by=False)),
    ]
    ids = {"d": documents, **parts, "e": entities}
    nodes = [(k, spark.createDataFrame([(x[2], x, k.upper()) for x in some + some[:2]], "document_id string, id string, type string").drop(*["document_id"] if k == "e" else [])) for k, some in ids.items()]
    moved = edges[0][2].select("source", "target", "type")
    for *_, df in edges[1:]:
        moved = moved.unionByName(df.select("source", "target", "type"))
    known = nodes[0][1].select("id", "type")
    for _, df in nodes[1:]:
        known = known.unionByName(df.select("id", "type"))
    return Placed(nodes, edges, KIND, ("d", "p", "q"), 4), known, moved, spark.createDataFrame([("a", "d:a"), ("b", "d:b"), ("a", "d:a")], "document_id string, id string")


@pytest.mark.parametrize("hops", [0, 1, 2, 3, 4, 6])
def test_scopes_of_hops(plain, hops):
    graph, nodes, edges, seeds = plain
    near = R.within_hops(edges, seeds, hops)
    found = graph.within_hops(seeds, hops)
    assert rows(graph.ids(found).select("id")) == rows(near.select("id"))
    assert rows(graph.edge_scope(found)) == rows(R.edge_scope(edges, near.select("id")))
    assert rows(graph.counts(found)) == rows(R.graph_counts(nodes, edges, near.select("id")))
    assert rows(graph.induced(found).counts(found)) == rows(R.graph_counts(nodes, R.induced(edges, near.select("id")), near.select("id")))


def test_scopes_of_nothing(plain):
    graph, nodes, edges, seeds = plain
    none = seeds.where("false")
    found = graph.within_hops(none, 3)
    assert graph.ids(found) is None or graph.ids(found).count() == 0
    assert rows(graph.counts(found)) == rows(R.graph_counts(nodes, edges, none.select("id")))


@pytest.mark.parametrize("types", [["X"], ["E"], ["P", "Q"], ["D", "E"]])
def test_counts_of_nodes_that_repeat(plain, types):
    graph, nodes, edges, _ = plain
    some = nodes.where(F.col("type").isin(*types))
    placed = graph.of_types(types)
    assert rows(graph.induced(placed).counts(placed, placed)) == rows(R.graph_counts(some, R.induced(edges, some), some.select("id")))


def test_peers_come_with_entities(spark, plain):
    graph, nodes, edges, seeds = plain
    graph = Placed([("entity" if k == "e" else k, df) for k, df in graph.nodes], [tuple(x.replace("e", "entity") for x in f[:2]) + f[2:] for f in graph.edges], lambda x: F.when(KIND(x) == "e", "entity").otherwise(KIND(x)), graph.local, 4)
    instances = spark.createDataFrame([(f"e:{i}", f"c:{i % 4}") for i in range(9)], "entity_uid string, canonical_id string")
    for hops in (2, 4, 5):
        assert rows(graph.ids(graph.document_scope(instances, seeds, hops)).select("id").distinct()) == rows(R.document_scope(nodes, edges, instances, seeds.select("id"), hops))


def test_no_part_of_a_document_moves(spark):
    """An edge's ends are looked for where it lies (no row but the scope's moved to be joined when all edges were joined by their ends)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = GraphTables(spark, SF)
        graph = t.placed
        scope = graph.within_hops(Q._seeds(t), 2)
        assert moves(R.edge_scope(t.edges, graph.ids(scope).select("id"))) > 4
        local = [(a, b, df) for a, b, df in graph.edges if "document_id" in df.columns]
        found = scope[0][1]
        assert moves(found) == 0 and all(moves(graph._edge_scope(*frame, scope[-1:])) == 0 for frame in local)
        assert all(moves(R.node_counts(df, df.select("document_id", "id"))) == 0 for k, df in graph.nodes if k in ("passage", "evidence", "citation"))
        evidence = next(df for a, _, df in local if a == "evidence")
        assert moves(R.induced(evidence, graph.ids(graph.of_types(["Evidence", "Passage"])))) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scopes_aren_t_sent_to_all_tasks(spark):
    """Ids that follow each other are written small and take a hundred times as much: 1,644 MB were sent at 6 times sf0.1."""
    t = GraphTables(spark, SF)
    graph = t.placed
    scope = graph.within_hops(Q._seeds(t), 2)
    passages = next(df for a, b, df in graph.edges if b == "passage")
    plan = graph._edge_scope("section", "passage", passages, scope)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_terms_meet_their_first_few_nodes(spark):
    """A question's rows come from its first nodes and their first neighbours: edges are asked for no others."""
    rng = random.Random(3)
    nodes = spark.createDataFrame([(f"n{i:03d}", rng.choice(["deep net", "net", "graph", "nothing"])) for i in range(120)], "id string, display_name string")
    edges = spark.createDataFrame([(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}", rng.choice("st")) for _ in range(300)] + [("n002", f"m{i:03d}", "s") for i in range(90)], "source string, target string, type string")
    terms = spark.createDataFrame([("q1", "net"), ("q1", "deep"), ("q2", "graph"), ("q3", "absent"), ("q4", "not")], "question_id string, token string")
    want, ways = [], {}
    for a, b, _ in edges.collect():
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set()).add(a)
    for q in ("q1", "q2", "q3", "q4"):
        tokens = [t for x, t in terms.collect() if x == q]
        hits = [i for i, n in nodes.collect() if any(t in n for t in tokens)]
        want += sorted([(q, i, n) for i in hits for n in ways.get(i) or [None]], key=lambda r: (r[1], r[2] or ""))[:7]
    found = R.term_neighbourhood(nodes, edges, terms, 7)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    read = [f for f in found.inputFiles() if "term-hits" in f]
    assert read and spark.read.parquet(*read).count() <= 7 * 3


def test_a_display_s_nodes_are_found_once(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t")], "source string, target string, type string")
    assert any("bounded-nodes" in f for f in R.bounded(edges, spark.createDataFrame([("c",)], "id string")).inputFiles())
