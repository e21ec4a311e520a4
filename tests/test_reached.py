"""What a question, a relation or a display can't reach isn't joined, and what reaches it gives the rows of plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph_read as R
from loomgraph.operators import grounded as Q


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = "source_uid string, target_uid string, relation_uid string, evidence_uid string, relation_type string, page int, snippet string, section string, confidence double, document_id string, document_name string, citation_label string, reference_entry_id string, citation_id string"


@pytest.mark.parametrize("seed", [1, 2])
def test_evidence_of_what_is_asked_for(spark, seed):
    """Nodes that share a target aren't paired with all of its evidence: only with that of the documents they are asked about."""
    rng = random.Random(seed)
    made = []
    for i in range(400):
        a, b = rng.choice([(f"m{rng.randrange(12)}", f"t{rng.randrange(3)}"), (f"t{rng.randrange(3)}", f"k{rng.randrange(2)}"), ("m1", "m1")])
        doc, cite = f"d{rng.randrange(8)}", f"c{i}" if rng.random() < 0.4 else None
        made.append((a, b, f"{a}{b}", f"ev{i % 350:03d}", "USES", 1, f"said {rng.randrange(40)}", "Results", rng.randrange(50) / 50, doc, doc, cite, None, cite))
    candidates = [(f"q{q}", s, s.upper(), "Method", "x", k) for q in range(12) for k, s in enumerate(rng.sample([f"m{i}" for i in range(12)] + ["t0", "t1"], 4), 1)]
    plans = [(f"q{q}", f"d{q % 8}" if q % 3 else None, q % 2 == 0, 2 + q % 4, 1 + (q // 2) % 2, 3 + q % 5) for q in range(12)]
    want = []
    for q, scope, cited, per, depth, most in plans:
        found = []
        for _, s, name, _, _, rank in (x for x in candidates if x[0] == q):
            ends = {r[1] for r in made if r[0] == s and r[1] != s}
            for hop, starts in ((1, {s}), (2, ends)):
                some = sorted((r for r in made if r[0] in starts and scope in (None, r[9])), key=lambda r: ((r[13] is None) if cited else 0, -r[8], r[3], r[13] is not None, r[13] or ""))
                found += [(rank, hop, place, name, r) for place, r in enumerate(some[: min(per, 10)], 1) if hop <= depth]
        seen, kept = set(), []
        for rank, hop, place, name, r in sorted(found, key=lambda x: x[:3]):
            if (key := (r[2], r[3], r[6])) not in seen:
                seen.add(key)
                kept.append((q, len(kept) + 1, name, r[3], r[9], r[11]))
        want += kept[:most]
    got = Q.collect_evidence(
        spark.createDataFrame(candidates, "question_id string, entity_id string, name string, type string, reason string, rank int"),
        spark.createDataFrame(plans, "question_id string, document_id string, citations_first boolean, per_candidate int, depth int, max_evidence int"), spark.createDataFrame(made, ROWS),
    )
    assert rows(got.select(F.col("question_id").alias("a"), F.col("pos").alias("b"), F.col("entity_name").alias("c"), F.col("evidence_uid").alias("d"), F.col("document_id").alias("e"), F.col("citation_label").alias("f"))) == sorted(want, key=str)
    assert any("evidence-told" in f or "evidence-shown" in f for f in got.inputFiles())  # what is shown joins the rows that are left


def test_density_counts_a_passage_s_citations_once(spark):
    rng = random.Random(5)
    relations = [(f"r{i}", f"e{i % 6}") for i in range(20)]
    evidence = sorted({(f"r{rng.randrange(17)}", f"p{rng.randrange(12)}") for _ in range(90)})
    citations = [(f"c{i % 14}", f"p{rng.randrange(9)}") for i in range(20)]
    want = []
    for e in sorted({e for _, e in relations}):
        mine = {r for r, x in relations if x == e}
        passages = {p for r, p in evidence if r in mine}
        want.append((e, len(mine), sum(r in mine for r, _ in evidence), sum(len({c for c, q in citations if q == p}) for p in passages)))
    frames = lambda at: (spark.createDataFrame(relations, "uid string, source_uid string"), spark.createDataFrame([(f"{r}{p}", r, p, p[-1]) for r, p in evidence], "uid string, relation_uid string, passage_id string, document_id string").drop(*at), spark.createDataFrame([(c, p, p[-1]) for c, p in citations], "citation_id string, passage_id string, document_id string").drop(*at))
    for at in ([], ["document_id"]):
        assert rows(Q.density(*frames(at)).select(F.col("uid").alias("a"), F.col("n_relations").alias("b"), F.col("n_evidence").alias("c"), F.col("n_citations").alias("d"))) == want


@pytest.mark.parametrize("common", [1, 3, 50_000])
def test_relations_come_to_evidence(spark, monkeypatch, common):
    """Common relations go to all tasks, others to each document once; relations may repeat, and be unknown."""
    monkeypatch.setattr(R, "MOST_COMMON", common)
    rng = random.Random(common)
    said = spark.createDataFrame([(f"e{i}", f"r{min(int(rng.paretovariate(0.6)), 30)}" if i % 9 else None, f"d{i % 5}", f"p{i % 20}", i / 7) for i in range(200)], "uid string, relation_uid string, document_id string, passage_id string, confidence double")
    relations = spark.createDataFrame([(f"r{i}", "USES", f"a{i}", "b") for i in range(25)] + [("r1", "USES", "z", "b"), ("r7", "ABOUT", "y", "b")], "uid string, type string, source_uid string, target_uid string")
    passages = spark.createDataFrame([(f"p{i}", f"s{i % 5}", f"d{i % 5}", i) for i in range(18)], "passage_id string, section_id string, document_id string, page_number int")
    sections, documents = spark.createDataFrame([(f"s{i}", f"d{i}", f"t{i}") for i in range(5)], "section_id string, document_id string, title string"), spark.createDataFrame([(f"d{i}", f"u{i}") for i in range(4)], "document_id string, title string")
    found = R.provenance(said, relations, passages, sections, documents)
    want = R.provenance(said.drop("document_id"), relations, passages, sections, documents)
    assert rows(found) == rows(want) and found.count() > 50
    assert any("common-relations" in f for f in found.inputFiles())
    trace = R.traces(R.trace_tables(said, relations, passages, sections, documents))
    assert rows(trace) == rows(want)


def test_citations_are_found_where_evidence_lies(spark):
    rng = random.Random(7)
    relations = [(f"r{i}", f"a{i % 4}", f"b{i % 3}") for i in range(12)] + [("r3", "a3", "a3")]
    evidence = [(f"r{rng.randrange(14)}", f"p{rng.randrange(10)}") for _ in range(60)]
    citations = [(f"p{rng.randrange(12)}", ["[1]", None][i % 2], f"x{rng.randrange(8)}" if i % 5 else None) for i in range(30)]
    references = [(f"x{i}", f"title {i}" if i % 3 else None, 1990 + i) for i in range(6)]
    told = {x: (t, y) for x, t, y in references}
    want = {(e, label or told.get(x, (None, None))[0] or "citation", *told.get(x, (None, None))) for r, p in evidence for u, a, b in relations if u == r for q, label, x in citations if q == p for e in (a, b)}
    for at in ([], ["document_id"]):
        one = spark.createDataFrame(relations, "uid string, source_uid string, target_uid string")
        two = spark.createDataFrame([(r, p, "d") for r, p in evidence], "relation_uid string, passage_id string, document_id string").drop(*at)
        three = spark.createDataFrame([(p, [label], x, "d") for p, label, x in citations], "passage_id string, labels array<string>, reference_id string, document_id string").drop(*at)
        four = spark.createDataFrame([(*r, "d") for r in references], "reference_id string, title_guess string, year int, document_id string").drop(*at)
        got = R.node_citations(one, two, three, four)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("most", [1, 4, 9, 30, 500])
def test_first_of_a_display_graph(spark, most):
    nodes = [(f"n{i // 3:02d}", "AB"[i % 2]) for i in range(60)] + [("n02", "A")] * 20
    relations = [(f"r{i}", f"n{i % 25:02d}", "USES", f"t{i}") for i in range(70)]
    known = spark.createDataFrame(nodes, "id string, type string").repartition(3)
    of = spark.createDataFrame(relations, "uid string, source_uid string, type string, target_uid string")
    plain = sorted(((i, t, u, k, e) for i, t in nodes for u, k, e in [(u, k, e) for u, s, k, e in relations if s == i] or [(None, None, None)]), key=lambda r: (r[0], r[2] is None, r[2] or ""))
    got = [(r.id, r.target_uid) for r in R.display_graph(known, of, most).collect()]
    assert sorted(got, key=str) == sorted([(r[0], r[4]) for r in plain[:most]], key=str)
    assert R.first_by_id(known, most).count() < 81 or most >= 30


def test_names_are_never_sent_to_all_tasks(spark, tmp_path):
    """The runs of names in a small file took 5,201 MB in the driver, for 960,000 names."""
    spark.range(3000).selectExpr("concat('customer-', id) uid", "concat('Customer number ', id) name").write.parquet(f"{tmp_path}/names")
    words = spark.range(4000).selectExpr("concat('number ', id) token")
    words.write.parquet(f"{tmp_path}/words")
    plan = plan_of(R.contains_probes(spark.read.parquet(f"{tmp_path}/names"), "uid", "name", spark.read.parquet(f"{tmp_path}/words")))
    assert "BuildRight" in plan and "BuildLeft" not in plan
