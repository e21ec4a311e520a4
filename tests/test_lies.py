"""What is made of lines is made where they lie."""

from pyspark.sql import functions as F

from loomgraph.operators import extraction as E
from loomgraph.operators import graph_build as G
from loomgraph.operators import graph_read as R
from loomgraph.operators import identity as N
from loomgraph.plans import build_queries as B
from loomgraph.plans import read_queries as Q
from loomgraph.plans.graph_tables import OF_A_DOCUMENT, GraphTables, kind_of
from loomgraph.sources import loaders as L
from loomgraph.sources.shared import mark

SF = "/root/testdata/sf0.001"


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_evidence_moves_no_row_of_the_lines(spark):
    t = GraphTables(spark, SF)
    assert t.lines.columns.count("document_id") == 1
    assert moves(t.evidence) == 0
    assert moves(E.citation_summary(t.citations, "document_id")) == 0


def test_evidence_is_grouped_where_passages_repeat(spark):
    rows = [("d", "p", "USES", "a", "b", 0.5, 1), ("d", "p", "USES", "a", "b", 0.7, 2), ("d", "q", "USES", "a", "b", 0.1, 1)]
    kept = spark.createDataFrame(rows, "document_id string, passage_id string, type string, source_uid string, target_uid string, confidence double, seq int")
    none = spark.createDataFrame([], "document_id string, passage_id string, citation_count long, citation_labels array<string>")
    got = {(r.uid, r.confidence) for r in G.upsert_evidence(kept, none, "document_id").collect()}
    assert got == {("ev:ri:uses:a:b:p", 0.7), ("ev:ri:uses:a:b:q", 0.1)}


def test_what_reads_lines_once_writes_none(spark):
    since = mark(spark)
    for name in ("ext04_body_passages", "ext05_citation_summary", "nrm06_uids"):
        B.QUERIES[name](spark, SF)
    assert mark(spark) == since


def test_ends_that_are_null_or_unknown_are_skipped(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "x"), (None, "b"), ("a", None), ("y", "x")], "source_uid string, target_uid string")
    kept, skipped = G.with_endpoints(rows, spark.createDataFrame([("a",), ("b",)], "uid string"))
    assert [tuple(r) for r in kept.select("source_uid", "target_uid").collect()] == [("a", "b")]
    assert {tuple(r) for r in skipped.select("source_uid", "target_uid").collect()} == {("a", "x"), (None, "b"), ("a", None), ("y", "x")}
    assert sorted(skipped.columns) == ["source_uid", "target_uid"]


def test_mentions_meet_few_missing_ends_where_they_are(spark):
    t = GraphTables(spark, SF)
    kept, skipped = G.with_endpoints(t.relation_mentions, t.entities.where("type <> 'Task'"))
    assert moves(kept) == 0 and moves(skipped) == 0


def test_names_are_resolved_where_they_lie(spark):
    t = GraphTables(spark, SF)
    assert moves(N.resolve_relations(*B.typed_relations(t), "document_id")) == 0


def test_scan_goes_on_where_ids_repeat(spark):
    nodes = spark.range(40).select(F.when(F.col("id") < 30, F.lit("00")).otherwise(F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"), F.lit("Method").alias("type"))
    assert [r.id for r in R.scan(nodes, ["Method"], 5).collect()] == ["00", "30", "31", "32", "33"]
    assert R.scan(nodes, ["Method"], 50).count() == 11


def test_scan_moves_the_first_rows_only(spark):
    nodes = spark.range(100_000).select(F.md5(F.col("id").cast("string")).alias("id"), F.lit("Method").alias("type")).repartition(4)
    assert R.scan(nodes, ["Method"], 10).inputFiles()  # the rows taken were written: what follows doesn't read the nodes again


def test_focus_of_none_is_every_edge(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("a", "b", "t")], "source string, target string, type string")
    none = spark.createDataFrame([], "id string")
    assert R.focus(edges, none, near=edges.where("false")).count() == 3
    assert {tuple(r) for r in R.focus(edges, spark.createDataFrame([("c",), ("a",)], "id string")).collect()} == {("a", "b", "t"), ("b", "c", "t")}


def test_first_induced_goes_on_until_enough_are_found(spark):
    edges = spark.createDataFrame([(f"{k:02}", f"{k + 1:02}", "t") for k in range(30)] * 2, "source string, target string, type string")
    ids = spark.createDataFrame([(f"{k:02}",) for k in range(20, 26)], "id string")
    assert [tuple(r) for r in R.induced(edges, ids, 3).collect()] == [("20", "21", "t"), ("21", "22", "t"), ("22", "23", "t")]
    assert R.induced(edges, ids, 50).count() == 5


def test_links_by_kind_write_what_is_asked_for(spark):
    frame = lambda *rows: spark.createDataFrame([(*r, "t") for r in rows], "source string, target string, type string")
    links = R.LinksByKind([("a", "b", frame(("a:1", "b:1"))), ("b", "c", frame(("b:1", "c:1"))), ("c", "d", frame(("c:1", "d:1")))], lambda x: F.substring_index(x, ":", 1))
    got = {r.id: r.hops for r in R.within_hops(links, spark.createDataFrame([("a:1",)], "id string"), 2).collect()}
    assert got == {"a:1": 0, "b:1": 1, "c:1": 2} and set(links.made) == {0, 1}
    assert links.of(spark.createDataFrame([("x:1",)], "id string")).count() == 0


def degrees(df):
    return {r.id: r.degree for r in df.collect()}


def test_degrees_of_a_documents_parts_are_counted_where_they_lie(spark):
    t = GraphTables(spark, SF)
    assert degrees(t.degrees) == degrees(R.degrees(t.edges))
    frames = [(a, b, df) for a, b, df in t.edge_frames if "document_id" in df.columns and "relation" not in b]
    assert moves(R.degrees_where_they_lie(frames, kind_of, OF_A_DOCUMENT)) == 0


def test_degrees_of_frames_that_share_ids(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "document_id int, source string, target string")
    frames = [("a", "b", frame((1, "a:1", "b:1"), (1, "a:1", "b:2"))), ("b", "c b", frame((1, "b:1", "c:1"), (2, "b:3", "c:1"), (1, "b:1", "b:1"))), ("c", "c", frame((1, "c:1", "c:2")).drop("document_id"))]
    got = degrees(R.degrees_where_they_lie(frames, lambda x: F.substring_index(x, ":", 1), ("a", "b")))
    assert got == {"a:1": 2, "b:1": 4, "b:2": 1, "b:3": 1, "c:1": 3, "c:2": 1}


def test_bounded_with_given_degrees(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "d", "t"), ("d", "a", "t"), ("a", "c", "t")], "source string, target string, type string")
    lit = spark.createDataFrame([("d",)], "id string")
    rows = lambda **more: [tuple(r) for r in R.bounded(edges, lit, most_nodes=3, **more).collect()]
    assert rows(found=R.degrees(edges)) == rows() == [("a", "c", "t"), ("c", "d", "t"), ("d", "a", "t")]


def test_a_scope_reads_the_parts_of_its_documents_only(spark):
    t = GraphTables(spark, SF)
    seeds = t.documents.where("year = 1996").select(F.col("document_id").alias("id"))
    of = t.among(seeds)
    asked = {r.id for r in seeds.collect()}
    assert {r.document_id for r in of.lines.select("document_id").collect()} == {r.document_id for r in t.lines.select("document_id").collect()} & asked
    assert of.once.only is of.only
    near = R.within_hops(t.links, seeds, 2)
    assert {tuple(r) for r in R.within_hops(of.links, seeds, 2).collect()} == {tuple(r) for r in near.collect()}


def test_nodes_of_kinds(spark):
    t = GraphTables(spark, SF)
    for kinds in (("entity", "relation", "canonical"), OF_A_DOCUMENT):
        got = {tuple(r) for r in t.nodes_of(" ".join(kinds)).collect()}
        assert got == {tuple(r) for r in t.nodes.withColumn("kind", kind_of(F.col("id"))).where(F.col("kind").isin(*kinds)).drop("kind").collect()}


def test_neighbours_of_ids_asked_once(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("a", "b", "t"), ("b", "a", "u"), ("c", "a", "t"), ("a", "a", "t"), ("d", "c", "t")], "source string, target string, type string")
    nodes, ids = spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "id string"), spark.createDataFrame([("a",), ("a",), ("c",)], "id string")
    got = lambda e, **more: sorted(tuple(r) for r in R.neighbours(e, nodes, ids, **more).collect())
    want = [("a", "incoming", "u", "b"), ("a", "outgoing", "t", "b"), ("c", "incoming", "t", "d"), ("c", "outgoing", "t", "a")]
    assert got(edges) == got(R.Links(edges)) == want
    assert got(edges, scope=spark.createDataFrame([("d",), ("a",)], "id string")) == want[2:]
    since = mark(spark)
    R.neighbours(edges, nodes, ids)
    assert mark(spark) == since + 2  # the ids and their edges: no other edge is written


def test_chunks_that_lie_by_document_are_written_where_they_lie(spark, tmp_path):
    t = GraphTables(spark, SF)
    L.write_chunks(t.passages, str(tmp_path / "chunks"), t._buckets, lies=True)
    back = L.read_snapshot(spark, str(tmp_path), ["chunks"])["chunks"]
    assert sorted(back.columns) == sorted(t.passages.columns)
    assert {r.passage_id for r in back.collect()} == {r.passage_id for r in t.passages.collect()}
    assert len(list((tmp_path / "chunks").glob("*.parquet"))) <= t._buckets  # a file a bucket: a read of a document opens one
    files = back.select("document_id", F.input_file_name().alias("f")).distinct()
    assert files.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def test_chunks_that_lie_elsewhere_are_moved_first(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("d"), F.col("id") % 10).alias("document_id"), "id").repartition(7)
    L.write_chunks(rows, str(tmp_path / "chunks"), 4)
    back = L.read_snapshot(spark, str(tmp_path), ["chunks"])["chunks"]
    assert back.count() == 100 and len(list((tmp_path / "chunks").glob("*.parquet"))) <= 4


def test_evidence_is_counted_without_its_citations(spark):
    plan = B.QUERIES["grb11_write_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "count(distinct" not in plan


def test_a_documents_evidence_is_counted_without_its_citations(spark):
    assert "collect_set" not in B.QUERIES["doc27_written"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_evidence_lie_still(spark):
    t = GraphTables(spark, SF)
    assert moves(t.nodes_of("evidence")) == 0 and "collect_set" not in t.nodes_of("evidence")._jdf.queryExecution().executedPlan().toString()


def test_a_nodes_evidence_and_summary_explode_relations_after_their_join(spark):
    made = [("r1", "T", "a", "b"), ("r2", "T", "a", "a"), ("r1", "T", "a", "b")]
    relations = spark.createDataFrame(made, "uid string, type string, source_uid string, target_uid string")
    evidence = spark.createDataFrame([("e1", "r1", "p", 0.5), ("e2", "r2", "q", 0.7), ("e3", "r2", "p", 0.9)], "uid string, relation_uid string, passage_id string, confidence double")
    passages = spark.createDataFrame([("p", "s", "d", "text"), ("q", "s", "d", "text")], "passage_id string, section_id string, document_id string, text string")
    found = R.node_evidence(relations, evidence, passages, most=2)
    assert sorted((r.id, r.evidence_uid) for r in found.collect()) == [("a", "e2"), ("a", "e3"), ("b", "e1"), ("r1", "e1"), ("r2", "e2"), ("r2", "e3")]
    citations = spark.createDataFrame([("p",), ("p",)], "passage_id string")
    rows = {r.id: (r.relations, r.evidence, r.citations) for r in R.node_summary(relations, evidence, citations).collect()}
    assert rows == {"a": (2, 3, 4), "b": (1, 1, 2)}
    t = GraphTables(spark, SF)
    read = R.node_evidence(t.relation_rows, t.evidence_by_document, t.passages)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[id#" not in read
    plan = R.node_summary(t.relation_rows, t.evidence_by_document, t.citations)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")


def test_citations_are_split_where_they_lie(spark):
    t = GraphTables(spark, SF)
    written, missing = G.split_by_passage(t.citations, t.passages.where("page_number <= 3"))
    assert moves(written) == 0 and moves(missing) == 0
    by_id = G.split_by_passage(t.citations.drop("document_id"), t.passages.where("page_number <= 3").drop("document_id"))
    assert [df.count() for df in (written, missing)] == [df.count() for df in by_id]


def test_edges_that_lie_by_document_are_told_once_where_they_lie(spark):
    t = GraphTables(spark, SF)
    here = G.edges(t.passages, "section_id", "passage_id", "HAS_PASSAGE", by="document_id")
    assert moves(here) == 0 and moves(G.edges(t.sections, "document_id", "section_id", "HAS_SECTION", by="document_id")) == 0
    there = G.edges(t.passages, "section_id", "passage_id", "HAS_PASSAGE")
    assert {tuple(r) for r in here.collect()} == {tuple(r) for r in there.collect()} and here.count() == there.count()


def test_dangling_ends_are_found_without_gathering_names(spark):
    names = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("q", "c")], "passage_id string, name string")
    rows = spark.createDataFrame([("p", "a", "b"), ("p", "a", "b"), ("p", "a", "c"), ("q", "c", "c"), ("q", None, "c")], "passage_id string, source string, target string")
    kept = E.without_dangling(rows, names)
    assert sorted(tuple(r) for r in kept.select("passage_id", "source", "target").collect()) == [("p", "a", "b"), ("p", "a", "b"), ("q", "c", "c")]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "BroadcastHashJoin" not in plan


def test_an_adjacency_takes_ends_from_the_mentions(spark):
    t = GraphTables(spark, SF)
    plan = R.both_ways(Q._ends(t)).distinct()
    assert moves(plan) == moves(t.once.lines) + 1
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in Q._ends(t).distinct().collect()} == {tuple(r) for r in t.relations.select("source_uid", "target_uid").distinct().collect()}


def test_evidence_of_deleted_documents_goes_where_it_lies(spark):
    t = GraphTables(spark, SF)
    left = B._deleted(t, G.evidence_mentions(t.relation_mentions, "document_id"))["evidence"]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert moves(left) == 0 and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Aggregate" not in plan


def test_repeats_of_evidence_leave_the_same_relations(spark):
    mentions = spark.createDataFrame([("d", "p", "USES", "a", "b"), ("d", "p", "USES", "a", "b"), ("e", "q", "USES", "a", "b"), ("e", "q", "USES", "a", "c")], "document_id string, passage_id string, type string, source_uid string, target_uid string")
    passages = spark.createDataFrame([("d", "p"), ("e", "q")], "document_id string, passage_id string")
    documents, gone = passages.select("document_id"), spark.createDataFrame([("e",)], "document_id string")
    relations = spark.createDataFrame([("ri:uses:a:b",), ("ri:uses:a:c",)], "uid string")
    for evidence in (G.evidence_keys(mentions, "document_id"), G.evidence_mentions(mentions, "document_id")):
        for lies in (False, True):
            left = G.delete_documents({"documents": documents, "sections": documents, "passages": passages, "evidence": evidence, "relations": relations, "entities": documents}, gone, lies)
            assert [r.uid for r in left["relations"].collect()] == ["ri:uses:a:b"]
            assert {r.passage_id for r in left["evidence"].collect()} == {"p"}
