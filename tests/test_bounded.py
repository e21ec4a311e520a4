"""What is cut before it is joined gives the rows of what isn't: blocks, postings, lists, hops and hubs against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import schemas as S
from loomgraph.functions import text as X
from loomgraph.operators import graph_read as R
from loomgraph.operators import grounded as Q
from loomgraph.operators import linking as K
from loomgraph.operators import structure as D
from loomgraph.operators import vectors as V
from loomgraph.sources import loaders as L
from loomgraph.sources.buckets import read_buckets

ASKED = "question_id string, document_id string, node_types array<string>, tokens array<string>, intent string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_cut_before_they_meet_mentions(spark):
    rng = random.Random(1)
    names = ["net", "deep net", "vision", "graph"]
    rows = [(f"canonical_method:{i:03d}", "Method", n, n, [n], [rng.choice(names)], [rng.choice(["DN", "GN"])]) for i, n in enumerate(rng.choice(names) for _ in range(300))]
    rows += [("other_method:000", "Method", "net", "net", [], ["net"], []), ("canonical_paper:1", "Paper", "net", "net", [], [], ["DN"])]
    registry = spark.createDataFrame(rows, "canonical_id string, entity_type string, canonical_name string, normalized_name string, aliases array<string>, normalized_aliases array<string>, acronyms array<string>")
    asked = [("m1", "Method", "Net", None, 0.99), ("m2", "Method", "dn", ["graph"], 0.99), ("m3", "Method", "vision", ["net", "gn"], 0.99), ("m4", "Method", "nothing", [], 0.99), ("m5", "Method", "net", [], 0.1), ("m6", "Paper", "dn", [], 0.99)]
    gated = K.gate(spark.createDataFrame(asked, "mention_id string, type string, name string, aliases array<string>, confidence double"))
    got = {}
    for r in K.candidates(gated, registry).collect():
        got.setdefault(r.mention_id, []).append(r.canonical_id)
    want = {}
    for m in gated.where("may_link").collect():
        for i, kind, _, key, _, aliases, acronyms in rows:
            low = [] if kind == "Paper" else [a.lower() for a in acronyms]
            if kind == m.type and i.startswith(f"canonical_{kind.lower()}:") and (m.key == key or {m.key, *m.alias_keys} & {*aliases, *low}):
                want.setdefault(m.mention_id, []).append(i)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[: K.MOST_CANDIDATES] for k, v in want.items()} and len(got["m1"]) == 25
    assert K.blocks(registry).groupBy("type", "kind", "block").count().agg(F.max("count")).first()[0] == K.MOST_CANDIDATES
    assert "WindowGroupLimit" in plan_of(K.blocks(registry))  # cut where the rows are


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    entities = [(f"e{i:03d}", rng.choice(S.ENTITY_TYPES), " ".join(rng.choice(["deep", "net", "graph", "ai", "x"]) for _ in range(2))) for i in range(200)]
    documents = [(e[0], f"d{rng.randrange(4)}") for e in entities for _ in range(rng.randrange(3))]
    instances = [(e[0], f"c{rng.randrange(12):02d}") for e in entities]
    registry = [(f"c{i:02d}", rng.choice(["deep net", "graph", "ai"]), [rng.choice(["net", "deep"])], [rng.choice(["ai", "dn"])]) for i in range(12)]
    asked = [("q1", None, [], ["net"], "X"), ("q2", "d1", [], ["deep", "ai"], "X"), ("q3", None, [S.ENTITY_TYPES[0], S.ENTITY_TYPES[2]], ["graph", "ee"], "X"), ("q4", "d3", [S.ENTITY_TYPES[1]], ["ai"], "X"), ("q5", None, [], [], "X"), ("q6", None, [], ["absent", "zz"], "X")]
    return (entities, documents, instances, registry, asked), (
        spark.createDataFrame(entities, "uid string, type string, name string"), spark.createDataFrame(documents, "entity_uid string, document_id string"), spark.createDataFrame(instances, "entity_uid string, canonical_id string"),
        spark.createDataFrame(registry, "canonical_id string, canonical_name string, normalized_aliases array<string>, acronyms array<string>"), spark.createDataFrame(asked, ASKED),
    )


def test_local_candidates_from_cut_lists(graph):
    (entities, documents, instances, _, asked), (e, d, i, _, a) = graph
    canonical = dict(instances)
    there = {(canonical[u], doc) for u, doc in documents}
    want = {}
    for q, doc, kinds, tokens, _ in asked:
        fit = [u for u, k, n in entities if any(t in n for t in tokens if len(t) > 1) and (not kinds or k in kinds) and (doc is None or (u, doc) in documents or (canonical[u], doc) in there)]
        if fit:
            want[q] = sorted(fit)[: Q.MOST_CANDIDATES]
    got = {}
    for r in Q.local_candidates(a, e, d, i).orderBy("question_id", "pos").collect():
        got.setdefault(r.question_id, []).append(r.entity_id)
    assert got == want and len(want["q1"]) == 20


def test_canonical_candidates_from_cut_lists(graph):
    (entities, documents, instances, registry, asked), (e, d, i, g, a) = graph
    of = {}
    for u, k in instances:
        of.setdefault(k, []).append(u)
    reach = {k: len({doc for u, doc in documents if u in us}) for k, us in of.items()}
    want = {}
    for q, _, _, tokens, _ in asked:
        hit = [k for k, n, aliases, acronyms in registry if any(len(t) > 1 and t in n or t in aliases or t in acronyms for t in tokens)]
        rows = sorted((-reach[k], u, k) for k in hit for u in of.get(k, []))[: Q.MOST_CANDIDATES]
        if rows:
            want[q] = [u for _, u, _ in rows]
    got = {}
    for r in Q.canonical_candidates(a, e, d, i, g).orderBy("question_id", "pos").collect():
        got.setdefault(r.question_id, []).append(r.entity_id)
    assert got == want and got["q1"]


def test_fallback_lists_merge_those_of_types(spark, graph):
    (entities, documents, _, _, _), (e, d, _, _, _) = graph
    rng = random.Random(3)
    found = [(u, rng.randrange(3), rng.randrange(3), rng.randrange(3)) for u, _, _ in entities]
    density = spark.createDataFrame(found, "uid string, n_relations long, n_evidence long, n_citations long")
    asked = [(f"q{k}", f"d{k % 4}" if k % 3 == 0 else None, rng.sample(list(S.ENTITY_TYPES), k % 4), ["a", "b"], "CITATION_BASIS" if k % 2 else "X") for k in range(12)]
    a = spark.createDataFrame(asked, ASKED)
    none = spark.createDataFrame([], "question_id string")
    kind = {u: k for u, k, _ in entities}
    for scoped in (False, True):
        rows = Q.fallback_candidates(a, none, e, density, scoped, d)
        assert "NestedLoop" not in plan_of(rows) and "CartesianProduct" not in plan_of(rows)
        got = {}
        for r in rows.orderBy("question_id", "pos").collect():
            got.setdefault(r.question_id, []).append(r.entity_id)
        want = {}
        for q, doc, kinds, _, intent in asked:
            fit = [(-(c if intent == "CITATION_BASIS" else v), -r, -v, -c, u) for u, r, v, c in found if (not kinds or kind[u] in kinds) and (not scoped or doc is None or (u, doc) in documents)]
            if fit:
                want[q] = [x[-1] for x in sorted(fit)[: Q.FALLBACKS]]
        assert got == want


def test_tokens_are_looked_for_by_their_rarest_run(spark):
    """On names of Zipf-like words, fewer names are looked at than by a token's first run, and the same are found."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    words[:3] = ["network", "learning", "neural"]
    names = [(i, " ".join(words[min(int(rng.paretovariate(0.7)) - 1, 299)] for _ in range(3)).title()) for i in range(2000)] + [(-1, "ab"), (-2, ""), (-3, None)]
    rows = spark.createDataFrame(names, "uid int, name string")
    tokens = [("q", w) for w in words] + [("r", w) for w in ("network zz", "network neural", "learnings", "netabc", "ab", "a", "neural network", "zq")]
    asked = spark.createDataFrame(tokens, "question_id string, token string")
    want = sorted({(q, i) for q, t in tokens for i, n in names if n is not None and len(t) > 1 and t in n.lower()})
    assert sorted(map(tuple, R.contains_join(rows, "uid", "name", asked).select("question_id", "uid").collect())) == want
    looked = R.contains_probes(rows, "uid", "name", asked).count()
    first = sum(t[:3] in n.lower() for t in {t for _, t in tokens} for _, n in names if n and len(t) > 1)
    assert looked <= first / 1.2, (looked, first)


@pytest.mark.parametrize("hub", [2, 5, 1000])
def test_hops_over_hubs(spark, hub):
    rng = random.Random(hub)
    edges = [("h", f"n{i}") for i in range(40)] + [(f"n{rng.randrange(40)}", f"m{rng.randrange(60)}") for _ in range(80)] + [("x", "x"), ("y", "z"), ("h", "n1")]
    near, level = {}, {"m3", "n0"}
    for k in range(5):
        near |= {v: k for v in level if v not in near}
        level = {b for a, b in [*edges, *[(b, a) for a, b in edges]] if a in level}
    df = spark.createDataFrame([(a, b, "t") for a, b in edges], "source string, target string, type string")
    seeds = spark.createDataFrame([("m3",), ("n0",), ("n0",)], "id string")
    links = R.Links(df, hub=hub)
    got = R.within_hops(links, seeds, 4).collect()
    assert {r.id: r.hops for r in got} == near and len(got) == len(near)
    if hub < 10:
        assert links.rows.groupBy("source", "part").count().agg(F.max("count")).first()[0] < 40
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(0, 40, 2)], "id string")
    found = R.neighbours(links, nodes, spark.createDataFrame([("h",)], "id string"), most=7).collect()
    assert sorted(r.neighbour for r in found) == sorted(f"n{i}" for i in range(0, 40, 2))[:7]


def test_a_hop_moves_its_own_rows_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = R.Links(spark.range(1000).selectExpr("cast(id as string) source", "cast(id + 1 as string) target", "'t' type"))
        plan = plan_of(links.of(spark.createDataFrame([("1",)], "id string")))
        scan = plan[plan.index("SortMergeJoin [source") :]
        assert scan.count("Bucketed: true") == 1 and "Exchange" not in scan[scan.rindex("+- Sort") :]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_adjacency_in_parts(spark):
    edges = [("hub", f"n{i:03d}") for i in range(100)] + [("n001", "n002"), ("n001", "hub"), ("a", "a")]
    df = spark.createDataFrame(edges, "source string, target string")
    want = {}
    for a, b in edges:
        want.setdefault(a, set()).add(b)
        want.setdefault(b, set()).add(a)
    for most in (1, 7, 1000):
        got = R.adjacency(df, most).collect()
        assert all(1 <= len(r.neighbours) <= most and r.neighbours == sorted(r.neighbours) for r in got)
        assert len({(r.id, r.part) for r in got}) == len(got)
        lists = {}
        for r in got:
            lists.setdefault(r.id, []).extend(r.neighbours)
        assert {k: sorted(v) for k, v in lists.items()} == {k: sorted(v) for k, v in want.items()}


def test_induced_edges_first_few(spark):
    df = spark.createDataFrame([("b", "a", "t"), ("a", "b", "t"), ("a", "b", "s"), ("a", "z", "t"), ("a", "b", "t")], "source string, target string, type string")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in R.induced(df, ids, 2).collect()] == [("a", "b", "s"), ("a", "b", "t")] and R.induced(df, ids).count() == 3


def test_nothing_goes_beyond_a_million(spark):
    """Names, keys and reference blocks of more than a million characters, words and entries."""
    long = "a" * 1_200_000
    (r,) = spark.createDataFrame([(f"x-{long}", "the " + "b " * 1_100_000)], "name string, words string").select(F.length(X.canonical_name(F.col("name"), F.lit("Task"))).alias("n"), F.size(F.split(X.match_key(F.col("words")), " ")).alias("w")).collect()
    assert (r.n, r.w) == (1_200_002, 1_100_000)
    pages = spark.createDataFrame([("d", 1, "References\n" + "\n".join(f"[{i}] entry {i}" for i in range(1_050_000)))], "document_id string, page_number int, text string")
    assert D.reference_entries(pages).agg(F.max("order")).first()[0] == 1_049_999


def test_top_k_from_the_shards_that_may_win(spark, monkeypatch):
    """Equal to all pairs on odd vectors, and fewer pairs where vectors lie together."""
    monkeypatch.setattr(V, "SHARD", 64)
    monkeypatch.setattr(V, "BLOCK", 7)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    shares = {}
    for n in (600, 2400):
        x = centres[rng.integers(0, 12, n)] + 0.05 * rng.standard_normal((n, 16))
        x[:40], x[40:44], x[44:60] = x[0], 0, rng.standard_normal((16, 16))
        rows = [(i, [float(v) for v in r], f"d{i % 3}" if i % 5 else "hot") for i, r in enumerate(x)] + [(-1, None, "d0"), (-2, [None, 1.0], "d0")]
        chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, document_id string").repartition(5)
        asked = chunks.where("chunk_id % 20 = 0 or chunk_id < 45").select(F.col("chunk_id").alias("query_id"), "embedding", "document_id")
        norm = np.linalg.norm(x, axis=1)
        near = np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((n, n)), where=np.outer(norm, norm) > 0).round(9)
        for positive, by in ((True, False), (False, False), (True, True)):
            want = set()
            for q in [i for i in range(n) if i % 20 == 0 or i < 45]:
                order = sorted((-near[q, i], i) for i in range(n) if (not positive or near[q, i] > 0) and (not by or rows[i][2] == rows[q][2]))[:6]
                want |= {(q, i, k, round(-s, 6)) for k, (s, i) in enumerate(order, 1)}
            got = {(r.query_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in V.top_k(asked, chunks, 6, positive, by).collect()}
            assert got == want
        shares[n] = V.pairs_scored(asked, chunks, 6) / asked.where("query_id >= 0").count() / n
    assert shares[2400] < 0.5, shares
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>, document_id string")
    assert V.top_k(asked, none).count() == 0 and V.top_k(none.withColumnRenamed("chunk_id", "query_id"), chunks).count() == 0


def test_traces_are_read_where_they_lie(spark, tmp_path):
    """No row of evidence, relations or passages moves, in a session that has forgotten the names too; a snapshot can be written again."""
    n = 300
    evidence = spark.range(n).selectExpr("concat('e', id) uid", "concat('r', id % 40) relation_uid", "concat('p', id % 70) passage_id", "id / 7 confidence")
    relations = spark.range(40).selectExpr("concat('r', id) uid", "'USES' type", "'a' source_uid", "'b' target_uid")
    passages = spark.range(60).selectExpr("concat('p', id) passage_id", "concat('s', id % 9) section_id", "concat('d', id % 4) document_id", "1 page_number")
    sections, documents = spark.range(9).selectExpr("concat('s', id) section_id", "'t' title"), spark.range(4).selectExpr("concat('d', id) document_id", "'u' title")
    parts = (evidence, relations, passages, sections, documents)
    want = sorted(map(tuple, R.provenance(*parts).select(*sorted(R.provenance(*parts).columns)).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for path in (f"{tmp_path}/it's one", f"{tmp_path}/two"):
            for k in (6, 4):
                L.write_snapshot(R.trace_tables(*parts), path, R.TRACE_KEYS, k)
                for t in spark.catalog.listTables():
                    if t.name.startswith("loomgraph_") and not t.isTemporary:
                        spark.sql(f"DROP TABLE {t.name}")
                found = R.traces(L.read_snapshot(spark, path, list(R.TRACE_KEYS)))
                assert "Exchange" not in plan_of(found) and plan_of(found).count("Bucketed: true") == 2
                assert sorted(map(tuple, found.select(*sorted(found.columns)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="buckets"):
        read_buckets(spark, str(tmp_path))


def test_scores_are_held_in_tiles(monkeypatch):
    rng = np.random.default_rng(1)
    queries, sample = rng.normal(size=(700, 4)), rng.normal(size=(50, 4))
    held, cosines = [], V.cosines
    monkeypatch.setattr(V, "TILE", 1000)
    monkeypatch.setattr(V, "cosines", lambda a, b: held.append(len(a) * len(b)) or cosines(a, b))
    got = V.floors(queries, sample, 3)
    assert np.allclose(got, np.sort(queries @ sample.T, axis=1)[:, -3]) and len(held) == 35 and max(held) <= 1000
    assert (V.floors(queries, sample[:2], 3) == -2).all() and (V.floors(queries, sample[:0], 3) == -2).all()
    assert [i for s in V.tiles(7, 2000) for i in range(7)[s]] == list(range(7)) and not list(V.tiles(0, 0))
