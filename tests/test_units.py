"""Literal inputs and their exact results."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import extraction as E
from loomgraph.operators import graph_read as R
from loomgraph.operators import grounded as Q
from loomgraph.operators import identity as N
from loomgraph.operators import linking as K
from loomgraph.operators import structure as D
from loomgraph.operators import vectors as V


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("body", "keys"),
    [
        ("1", ["1"]), ("2,5,8", ["2", "5", "8"]), ("3-6", ["3", "4", "5", "6"]), (" 10 , 12-11, 10", ["10", "11", "12"]), ("12345678901", ["12345678901"]), ("1-2000000000", ["1-2000000000"]), ("9-1000000000000, 3", ["9-1000000000000", "3"]),
        ("1" * 30, ["1" * 30]), ("1-" + "9" * 30, ["1-" + "9" * 30]), ("1-3-5, 7", ["7"]), ("007", ["007"]), ("07-09", ["7", "8", "9"]), ("1-1000", [str(k) for k in range(1, 1001)]), ("1-1001", ["1-1001"]),
    ],
)
def test_numeric_keys(spark, body, keys):
    assert one(spark, X.expand_keys(F.col("b")), b=body) == keys


def test_entry_numbers_of_any_length(spark):
    rows = [("[12] A", 0), ("9999999998. B", 1), ("12345678901. C", 2), ("1" * 30 + ". D", 3), ("no number", 4)]
    got = spark.createDataFrame(rows, "t string, o int").select(X.numeric_key(F.col("t"), F.col("o")).alias("k")).collect()
    assert [r.k for r in got] == [12, 9999999998, 12345678901, 4, 5]


def test_citations_of_long_numbers_and_wide_ranges(spark):
    said = "As in [2], [12345678901], [3-2000000000] and [1-" + "9" * 40 + "]; [4-2]."
    passages = spark.createDataFrame([("d", "p", said), ("e", "q", "[1-5000]")], "document_id string, passage_id string, text string")
    cites = D.inline_citations(passages)
    assert sorted((r.raw_text, r.keys) for r in cites.where("document_id = 'd'").collect())[0] == ("[1-" + "9" * 40 + "]", ["1-" + "9" * 40])
    refs = spark.createDataFrame([("d", f"r{k}", i, k, None) for i, k in enumerate((1, 2, 3, 4, 12345678901, 2000000001))] + [("e", "s1", 0, 4999, None), ("e", "s2", 1, 5001, None)], "document_id string, reference_id string, `order` int, key_numeric long, key_author_year string")
    got = sorted((r.raw_text, r.reference_id) for r in D.citation_links(cites, refs).join(cites.drop("document_id"), "citation_id").collect())
    assert got == sorted([("[12345678901]", "r12345678901"), ("[1-5000]", "s1"), ("[2]", "r2"), ("[3-2000000000]", "r3"), ("[3-2000000000]", "r4"), ("[4-2]", "r2"), ("[4-2]", "r3"), ("[4-2]", "r4")])


def test_entries_are_linked_by_numbers_of_any_length(spark):
    long = "1" * 30
    pages = spark.createDataFrame([("d", 1, f"Methods\nAs in [{long}] and [7].\nReferences\n[{long}] First entry of them.\n[007] Second entry of them.")], "document_id string, page_number int, text string")
    entries = D.reference_entries(pages)
    assert [r.entry_number for r in entries.orderBy("order").collect()] == [long, "7"]
    cites = D.inline_citations(spark.createDataFrame([("d", "p", f"[{long}], [7], [1]")], "document_id string, passage_id string, text string"))
    got = D.citation_links(cites, entries).join(cites.drop("document_id"), "citation_id").join(entries.select("reference_id", "order"), "reference_id")
    assert sorted((r.raw_text, r.order) for r in got.collect()) == [(f"[{long}]", 0), ("[7]", 1)]


def test_plans_go_two_steps_for_methods_and_one_for_summaries(spark):
    asked = spark.createDataFrame([("a", "METHOD_USAGE", 6), ("b", "SUMMARY", 4)], "question_id string, intent string, max_evidence int")
    assert {r.question_id: r.depth for r in Q.planned(asked).collect()} == {"a": 2, "b": 1}


def test_canonical_candidates_come_first_and_once(spark):
    schema = "question_id string, entity_id string, name string, type string, score double, reason string, source string, pos int"
    found = spark.createDataFrame([("q", "n-1", "Transformer", "Method", 0.7, "token_match", "local", 1), ("q", "n-1", "Transformer", "Method", 0.92, "canonical_linked_match", "canonical-ready", 21), ("q", "n-2", "Attention", "Concept", 0.88, "canonical_linked_match", "canonical-ready", 22)], schema)
    got = Q.representatives(Q.merged(found)).orderBy("rank").collect()
    assert [(r.entity_id, r.source) for r in got] == [("n-1", "canonical-ready"), ("n-2", "canonical-ready")]


def test_author_year_labels(spark):
    assert one(spark, X.label_keys(F.col("b")), b="Vaswani et al., 2017") == ["vaswani:2017"]
    assert one(spark, X.label_keys(F.col("b")), b="Smith, 2020; Doe, 2021") == ["smith:2020", "doe:2021"]


def test_offsets(spark):
    got = one(spark, X.matches_with_offsets(F.col("t"), X.NUMERIC_CITATION), t="a [1] b [2, 5,8] cc [3-6].")
    assert [(m.raw, m.start) for m in got] == [("[1]", 2), ("[2, 5,8]", 8), ("[3-6]", 20)]


def test_identity(spark):
    uid = lambda kind, name: one(spark, X.entity_uid(F.col("k"), F.col("n")), k=kind, n=name)
    assert uid("Concept", "Café-Driven  Attention!") == "concept:cafe-driven-attention"
    assert uid("Dataset", "WMT 2014 English-German") == "dataset:wmt-2014-english-german"
    got = one(spark, X.relation_uid(F.col("r"), F.col("a"), F.col("b")), r="EVALUATED_ON", a="method:transformer", b="dataset:wmt-2014")
    assert got == "ri:evaluated-on:method:transformer:dataset:wmt-2014"


@pytest.mark.parametrize(
    ("name", "kind", "want"),
    [("the transformer model", "Method", "Transformer"), ("graph-based method", "Method", "Graph"), ("BERT", "Method", "BERT"), ("self-attention bi_lstm", "Dataset", "Self-Attention bi_lstm"), ("bi lstm_net", "Dataset", "Bi Lstm_Net"), ('"penn  treebank".', "Dataset", '"Penn Treebank"')],
)
def test_canonical_names(spark, name, kind, want):
    assert one(spark, X.canonical_name(F.col("n"), F.col("k")), n=name, k=kind) == want


@pytest.mark.parametrize(("name", "key"), [("The Graph_Neural-Networks.", "graph neural network"), ("policies", "policy"), ("class", "class"), ("corpus", "corpus"), ("a", "a"), ("the a", "a"), (None, "")])
def test_match_keys(spark, name, key):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(X.match_key(F.col("n")).alias("x")).first().x == key


@pytest.mark.parametrize(
    ("question", "intent"),
    [("Which references support this?", "CITATION_BASIS"), ("How does BERT use attention?", "METHOD_USAGE"), ("How is the architecture built?", "METHOD_USAGE"), ("Which bottleneck is named?", "PROBLEM"), ("What links A and B?", "RELATION_LOOKUP"), ("Tell me about it", "SUMMARY")],
)
def test_intents(spark, question, intent):
    assert one(spark, X.intent(F.col("q")), q=question) == intent


def test_hints(spark):
    assert one(spark, X.entity_hints(F.col("q")), q="How does Graph Attention improve BERT models?") == ["how", "graph attention", "bert", "graph", "attention", "improve", "models"]


def test_sections(spark):
    pages = spark.createDataFrame([("d", 1, "Abstract\nText.\n3 Method\nMore.\nABSTRACT\nx"), ("d", 2, "IV EXPERIMENTS\nAll.\n7. References\n[1] A. B. Long title of it. 2001.\n[2] Next entry, 1999 and 2002."), ("e", 1, "no heading here")], "document_id string, page_number int, text string")
    got = [(r.title, r.level, r.ordinal, r.page_start, r.page_end) for r in D.sections(pages).orderBy("ordinal").collect()]
    assert got == [("Abstract", 1, 0, 1, 1), ("3 Method", 1, 1, 1, 2), ("IV EXPERIMENTS", 1, 2, 2, 2), ("7. References", 1, 3, 2, 2)]
    assert [(r.document_id, r.text) for r in D.passages(pages).orderBy("document_id", "index").collect()] == [("d", "Text."), ("d", "More.\nABSTRACT\nx"), ("d", "All."), ("e", "no heading here")]
    refs = D.reference_entries(pages).orderBy("order").collect()
    assert [(r.key_numeric, r.year) for r in refs] == [(1, 2001), (2, 2002)]


def test_chunks():
    text = "\n\n".join(" ".join(f"word{i}-{k}" for k in range(90)) + "." for i in range(12)) + "".join(f"{i:05d}" for i in range(1000))
    got = D.chunk(text)
    assert all(len(c) <= 1600 for c in got)
    at = 0
    for c in got:  # in order, and nothing between two chunks but white space
        found = text.index(c[:50], max(0, at - 400))
        assert not text[at:found].strip()
        at = found + len(c)
    assert not text[at:].strip() and D.chunk("") == [] and D.chunk("a") == ["a"]


def plain_chunks(text, size, overlap):
    """The chunker by its rule: cut at the first separator that does, fill up, start again with a tail."""

    def cut(t, marks):
        if len(t) <= size:
            return [t]
        if not marks:
            return [t[i : i + size] for i in range(0, len(t), size)]
        parts = t.split(marks[0])
        return [y for k, x in enumerate(parts) for y in ([z for z in cut(x + (marks[0] if k + 1 < len(parts) else ""), marks[1:])] if x or k + 1 < len(parts) else [])]

    pieces = cut(text, ["\n\n", "\n", ". ", " "])
    out, first, at = [], 0, 0
    while at < len(pieces):
        to = at
        while to < len(pieces) and (to == at or sum(map(len, pieces[first : to + 1])) <= size):
            to += 1
        out.append("".join(pieces[first:to]).strip())
        at = to
        while at < len(pieces) and first < at and (sum(map(len, pieces[first:at])) > overlap or sum(map(len, pieces[first : at + 1])) > size):
            first += 1
    return [c for c in out if c]


def test_chunks_against_the_plain_rule(spark):
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["word ", "longerword", ". ", "\n", "\n\n", "x", " ", "é"]) * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))
        assert D.chunk(t, 40, 12) == plain_chunks(t, 40, 12), t
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat(F.lit("doc:"), "doc_id").alias("document_id"), "text")
    want = {r.document_id: plain_chunks(r.text, 1600, 200) for r in docs.collect()}
    got = {}
    for r in D.raw_passages(docs).collect():
        got.setdefault(r.document_id, {})[r["index"]] = r.text
        assert len(r.text) <= 1600 and r.page_number == 0
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    again = {(r.document_id, r["index"]): r.passage_id for r in D.raw_passages(docs.repartition(5)).collect()}
    assert again == {(r.document_id, r["index"]): r.passage_id for r in D.raw_passages(docs).collect()} and len(set(again.values())) == len(again)


def test_passages_of_bodies_only(spark):
    """Passages are the chunks of each body section in order; references have none; without headings, pages do."""
    body = " ".join(f"word{i}" for i in range(600)) + "."
    pages = spark.createDataFrame([("d", 1, f"Abstract\n{body}\nMethods\nShort."), ("d", 2, "References\n[1] A. Title of it. 2001."), ("e", 1, body), ("e", 2, "")], "document_id string, page_number int, text string")
    got = [(r.document_id, r["index"], r.ordinal, r.text) for r in D.passages(pages).orderBy("document_id", "index").collect()]
    chunks = plain_chunks(body, 1600, 200)
    want = [("d", i, 0, t) for i, t in enumerate(chunks)] + [("d", len(chunks), 1, "Short.")] + [("e", i, -1, t) for i, t in enumerate(chunks)]
    assert got == want


def test_cleaning(spark):
    rows = [("p", 0, "Method", "the transformer model", None, ["T"], 0.91), ("p", 1, "Method", "Transformer", None, [], 0.95), ("p", 2, "Method", "method", None, [], 0.99), ("p", 3, "Dataset", "WMT", None, [], 0.5), ("p", 4, "Dataset", "wmt 14", None, [], 0.9)]
    clean = N.clean_entities(spark.createDataFrame(rows, "passage_id string, pos int, type string, name string, canonical_name string, aliases array<string>, confidence double"))
    got = {r.uid: r for r in N.dedupe_entities(clean).collect()}
    assert set(got) == {"method:transformer", "dataset:wmt-14"} and got["method:transformer"].confidence == 0.95 and got["method:transformer"].mentions == 2
    rels = spark.createDataFrame([("d", "p", 0, "USES", 0.9, "transformer", "wmt 14"), ("d", "p", 1, "USES", 0.9, "Transformer", "the transformer model"), ("d", "p", 2, "USES", 0.9, "Transformer", "nobody"), ("d", "p", 3, "MEASURED_BY", 0.9, "Transformer", "wmt 14"), ("d", "p", 4, "INTRODUCES", 0.9, "__DOCUMENT__", "Transformer")], "document_id string, passage_id string, pos int, type string, confidence double, source string, target string")
    kept = N.allowed_relations(N.resolve_relations(rels, N.name_map(clean))).collect()
    assert sorted((r.source_uid, r.type, r.target_uid) for r in kept) == [("d", "INTRODUCES", "method:transformer"), ("method:transformer", "USES", "dataset:wmt-14")]


def test_linking(spark):
    registry = spark.createDataFrame(
        [("canonical_method:bidirectional-encoder", "Method", "Bidirectional Encoder", "bidirectional encoder", ["Bi Encoder"], ["bi encoder"], ["BE"]), ("canonical_dataset:bert", "Dataset", "BERT", "bert", [], [], [])],
        "canonical_id string, entity_type string, canonical_name string, normalized_name string, aliases array<string>, normalized_aliases array<string>, acronyms array<string>",
    )
    rows = [("1", "Method", "bidirectional encoders", [], 0.95), ("2", "Method", "Bi-Encoder", [], 0.95), ("3", "Method", "BE", [], 0.95), ("4", "Method", "bidirectional encoder", [], 0.85), ("5", "Method", "BioBERT", [], 0.99), ("6", "Method", "BERT", [], 0.99), ("7", "Task", "be", [], 0.99)]
    got = {r.mention_id: (r.canonical_id, r.reason) for r in K.link(spark.createDataFrame(rows, "mention_id string, type string, name string, aliases array<string>, confidence double"), registry).collect()}
    known = "canonical_method:bidirectional-encoder"
    assert got["1"] == (known, "normalized_exact_match") and got["2"] == (known, "normalized_alias_match") and got["3"] == (known, "acronym_expansion_match")
    assert got["4"] == (known, "new_canonical_low_confidence_or_unsupported_type") and got["7"][1] == "new_canonical_low_confidence_or_unsupported_type"
    assert got["5"] == ("canonical_method:biobert", "new_canonical_no_match") and got["6"] == ("canonical_method:bert", "new_canonical_no_match")


def test_canonical_payload(spark):
    """Aliases, match keys and acronyms that a link brings, and what the registry learns from it."""
    registry = spark.createDataFrame(
        [("canonical_method:bidirectional-encoder", "Method", "Bidirectional Encoder", "bidirectional encoder", ["Bi Encoder"], ["bi encoder"], ["BE"])],
        "canonical_id string, entity_type string, canonical_name string, normalized_name string, aliases array<string>, normalized_aliases array<string>, acronyms array<string>",
    )
    rows = [("1", "Method", "Bidirectional Encoders", ["BiEnc"], 0.91), ("2", "Method", "BE", ["Boosted Ensemble"], 0.99), ("3", "Method", "Graph Net", ["", "GN"], 0.95)]
    links = K.link(spark.createDataFrame(rows, "mention_id string, type string, name string, aliases array<string>, confidence double"), registry)
    got = {r.mention_id: (r.learns_aliases, r.new_aliases, r.new_alias_keys, r.new_acronyms) for r in links.collect()}
    known = ["Bi Encoder", "Bidirectional Encoder"]
    assert got["1"] == (True, sorted([*known, "BiEnc", "Bidirectional Encoders"]), sorted(["bi encoder", "bidirectional encoder", "bienc"]), ["be"])  # by the link's score, not the mention's
    assert got["2"] == (False, sorted([*known, "BE", "Boosted Ensemble"]), sorted(["bi encoder", "bidirectional encoder", "be", "boosted ensemble"]), ["be"])
    assert got["3"] == (False, ["GN", "Graph Net"], ["gn", "graph net"], ["gn"])
    nxt = {r.canonical_id: r for r in K.upsert_registry(registry, links).collect()}
    assert nxt["canonical_method:bidirectional-encoder"].aliases == sorted([*known, "BiEnc", "Bidirectional Encoders"])  # nothing from the acronym's link
    assert nxt["canonical_method:graph-net"].aliases == ["GN", "Graph Net"] and nxt["canonical_method:graph-net"].canonical_name == "Graph Net"


def test_citation_summary(spark):
    rows = [("p", "c1", ["[12]"]), ("q", "c2", ["[3]", "[3]"])]
    got = {r.passage_id: (r.citation_count, r.citation_labels) for r in E.citation_summary(spark.createDataFrame(rows, "passage_id string, citation_id string, labels array<string>")).collect()}
    assert got == {"p": (1, ["[12]"]), "q": (1, ["[3]"])}


EVIDENCE = "question_id string, pos int, entity_id string, entity_name string, relation_uid string, evidence_uid string, relation_type string, page int, snippet string, said string, section string, confidence double, document_id string, document_name string, citation_label string, reference_entry_id string"


def item(pos, snippet, confidence=0.9, document="d", relation="USES", label=None):
    return ("q", pos, "e", "Ent", f"r{pos}", f"ev{pos}", relation, 1, snippet, " ".join(snippet.lower().split()), "Results", confidence, document, document, label, None)


def test_weak_paths(spark):
    rows = [item(i, f"s{i}", 0.4) for i in range(1, 6)] + [item(6, "strong", 0.9)]
    assert sorted(r.pos for r in Q.relevant(spark.createDataFrame(rows, EVIDENCE)).collect()) == [1, 2, 6]
    other = [item(i, f"s{i}", 0.5 + i / 10, relation="WROTE") for i in range(1, 5)]
    assert sorted(r.evidence_uid for r in Q.relevant(spark.createDataFrame(other, EVIDENCE)).collect()) == ["ev3", "ev4"]


def test_ranking_and_clusters(spark):
    rows = [item(1, "Same  text"), item(2, "same text", document="d2"), item(3, "other text", document="d3")]
    asked = Q.interpret(Q.with_defaults(spark.createDataFrame([("q", "Tell me", None, None, 5, True, "answer")], "question_id string, question string, document_id string, node_types array<string>, max_evidence int, include_citations boolean, answer_mode string")))
    names = spark.createDataFrame([("q", "Ent")], "question_id string, name string")
    ranked = Q.ranked(spark.createDataFrame(rows, EVIDENCE), asked, names)
    assert ranked.orderBy("rank").first().evidence_uid == "ev3"
    found = {r.cluster_key: (r.frequency, r.cites) for r in Q.clusters(Q.clustered(ranked)).collect()}
    assert found == {"ent::USES::same text": (1, 0), "ent::USES::other text": (1, 0)}
    assert Q.insights(Q.clusters(Q.clustered(ranked))).count() == 0


def test_insights_need_snippets_that_share_their_beginning(spark):
    start = "x" * 80
    rows = [item(i, f"{start} {i}", document=f"d{i}", label=f"[{i}]") for i in range(1, 4)]
    asked = Q.interpret(Q.with_defaults(spark.createDataFrame([("q", "Tell me", None, None, 5, True, "answer")], "question_id string, question string, document_id string, node_types array<string>, max_evidence int, include_citations boolean, answer_mode string")))
    ranked = Q.ranked(spark.createDataFrame(rows, EVIDENCE), asked, spark.createDataFrame([("q", "Ent")], "question_id string, name string"))
    got = {r.type: r.confidence for r in Q.insights(Q.clusters(Q.clustered(ranked))).collect()}
    assert got == {"COMMON_PATTERN": 0.8, "CROSS_DOCUMENT_TREND": 0.85}


def test_hops_do_not_depend_on_partitions(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("d", "e", "x"), ("e", "f", "x"), ("z", "a", "x")], "source string, target string, type string")
    seeds = spark.createDataFrame([("a",)], "id string")
    for n in (1, 17):
        assert {r.id: r.hops for r in R.within_hops(edges.repartition(n), seeds, 4).collect()} == {"a": 0, "b": 1, "z": 1, "c": 2, "d": 3, "e": 4}


def test_contains_join(spark):
    names = spark.createDataFrame([("1", "Small Ring"), ("2", "AI"), ("3", "x")], "uid string, name string")
    asked = spark.createDataFrame([("q", "ring"), ("q", "ai"), ("r", "all r"), ("r", "x")], "question_id string, token string")
    assert sorted(map(tuple, R.contains_join(names, "uid", "name", asked).select("question_id", "uid").collect())) == [("q", "1"), ("q", "2"), ("r", "1")]


def test_zero_vectors(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<double>")
    got = lambda p: [(r.chunk_id, r.score) for r in V.top_k(asked, chunks, 3, positive=p).orderBy("rank").collect()]
    assert got(True) == [(1, 1.0)] and got(False) == [(1, 1.0), (2, 0.0), (3, -1.0)]


# --- answers

ASKED = "question_id string, question string, document_id string, node_types array<string>, max_evidence int, include_citations boolean, answer_mode string"
CANDIDATES = "question_id string, entity_id string, name string, type string, reason string, rank int"


def grounded(spark, question, rows, names, mode="answer"):
    asked = Q.interpret(Q.with_defaults(spark.createDataFrame([("q", question, None, None, 5, True, mode)], ASKED)))
    candidates = spark.createDataFrame([("q", f"n{i}", n, "Method", "name_match", i) for i, n in enumerate(names, 1)], CANDIDATES)
    clustered = Q.clustered(Q.ranked(spark.createDataFrame(rows, EVIDENCE), asked, candidates))
    return Q.answers(asked, candidates, clustered).first(), Q.explanations(asked, candidates, clustered).first()


def test_answer_texts(spark):
    rows = [item(1, "Graphs help a lot", label="[4]"), item(2, "graphs  help a LOT", document="d2"), item(3, "Nets help too", document="d3")]
    got, why = grounded(spark, "How is Ent used?", rows, ["Ent", "Net", "More", "Last"])
    assert got.intent == "METHOD_USAGE" and got.gate is None
    assert got.answer.startswith("Method usage is evidenced as Ent connects to Net through USES. Evidence: ")
    assert got.closest_concepts == ["Ent", "Net", "More"] and [m.display_name for m in got.matched_entities] == ["Ent", "Net", "More", "Last"]
    # snippets that differ in case and spaces only are one of a cluster: its better item stays
    assert got.focus[:5] == ["n1", "n2", "n3", "n4", "e"] and set(got.focus[5:]) in ({"r1", "r3"}, {"r2", "r3"}) and got.n_evidence == 2
    assert got.key_points[0].startswith("Primary cluster: Ent - USES (") and got.key_points[-1] == "Usage patterns prioritize repeated evidence and citation-backed clusters."
    assert why.entity_reasons[0].startswith("Selected entities using query hints: ") and why.entity_reasons[1] == "Candidate selection returned 4 graph entities for intent METHOD_USAGE."
    assert why.evidence_reasons[0] == "Traversal strategy 'method_centered_scan' prioritized outgoing, incoming links." and len(why.evidence_reasons) == 2
    assert why.reasoning_path == ["question_intent:METHOD_USAGE", "candidate_entities:4", "evidence_candidates:2", "selected_top_evidence:2", "strategy:method_centered_scan"] and why.sections == ["Results"] and len(why.signals) == 8


def test_answers_without_evidence(spark):
    got, why = grounded(spark, "Tell me about Ent", [], ["Ent"])
    assert (got.gate, got.answer, got.confidence, got.badge, got.uncertainty_reason, got.key_points) == ("no_evidence", "No grounded answer found in the current documents.", 0.0, "NO_GROUNDING", "no_evidence_hard_gate", [])
    got, why = grounded(spark, "Tell me about Ent", [], ["Ent"], mode="explore")
    assert got.gate is None and got.answer == "We couldn’t find strong supporting evidence for this question in your documents. Limited evidence is available for this answer." and got.focus == ["n1"]
    assert len(why.evidence_reasons) == 1 and why.sections == []
    got, _ = grounded(spark, "Which citation supports Ent?", [item(1, "All of it", label="[7]"), item(2, "More of it", label="[3]")], ["Ent"])
    assert got.answer.startswith("This answer is based on citation-backed evidence for Ent: [3], [7].")
    got, _ = grounded(spark, "Which citation supports Ent?", [item(1, "All of it")], ["Ent"])
    assert got.answer == "Reference-grounded evidence for Ent was found: All of it Citation basis could not be verified because no citation links were found."


ROWS = "source_uid string, target_uid string, relation_uid string, evidence_uid string, relation_type string, page int, snippet string, section string, confidence double, document_id string, document_name string, citation_label string, reference_entry_id string, citation_id string"


def test_cap_before_or_after_ranking(spark):
    rows = spark.createDataFrame([("n1", f"t{i}", f"r{i}", f"ev{i}", "USES", 1, f"text {i}", "Results", 1 - i / 10, "d", "d", None, None, None) for i in range(4)], ROWS)
    plans = Q.planned(Q.interpret(Q.with_defaults(spark.createDataFrame([("q", "Tell me about it", None, None, 2, True, "answer")], ASKED))))
    candidates = spark.createDataFrame([("q", "n1", "Ent", "Method", "name_match", 1)], CANDIDATES)
    assert [r.evidence_uid for r in Q.collect_evidence(candidates, plans, rows).orderBy("pos").collect()] == ["ev0", "ev1"]
    assert [r.evidence_uid for r in Q.collect_evidence(candidates, plans.withColumn("per_candidate", F.lit(3)), rows, cap_after_rank=True).orderBy("pos").collect()] == ["ev0", "ev1", "ev2"]


def test_fallbacks_by_document(spark):
    asked = Q.interpret(Q.with_defaults(spark.createDataFrame([("q", "Tell nothing known", "d1", None, 5, True, "answer"), ("r", "Tell nothing known", None, None, 5, True, "answer")], ASKED)))
    entities = spark.createDataFrame([(f"m{i}", f"Name {i}", "Method") for i in range(3)], "uid string, name string, type string")
    found = spark.createDataFrame([(f"m{i}", 5 - i, 5 - i, 0) for i in range(3)], "uid string, n_relations long, n_evidence long, n_citations long")
    there = spark.createDataFrame([("m2", "d1"), ("m0", "d2")], "entity_uid string, document_id string")
    none = spark.createDataFrame([], "question_id string")
    names = lambda df: {q: [r.entity_id for r in df.where(F.col("question_id") == q).orderBy("pos").collect()] for q in ("q", "r")}
    assert names(Q.fallback_candidates(asked, none, entities, found)) == {"q": ["m0", "m1", "m2"], "r": ["m0", "m1", "m2"]}
    assert names(Q.fallback_candidates(asked, none, entities, found, True, there)) == {"q": ["m2"], "r": ["m0", "m1", "m2"]}


def test_document_scope_through_canonicals(spark):
    hits = spark.createDataFrame([("q", "d1", "a"), ("q", "d1", "b"), ("q", "d1", "c"), ("r", None, "c")], "question_id string, document_id string, uid string")
    there = spark.createDataFrame([("a", "d1"), ("c", "d2")], "entity_uid string, document_id string")
    instances = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "l")], "entity_uid string, canonical_id string")
    assert sorted(map(tuple, Q.in_document_scope(hits, there, instances).collect()), key=str) == [("q", "d1", "a"), ("q", "d1", "b"), ("r", None, "c")]


# --- streams and the shared folder


def test_upserts_by_bucket(spark, tmp_path):
    """Batches rewrite the buckets they touch; a driver that comes back goes on; a batch that comes again changes nothing."""
    from loomgraph.streaming import jobs as J

    path, schema = str(tmp_path), "id string, v string, first string, seq long"
    batches = [[("a", "1", "x", 1), ("b", "1", "x", 2)], [("a", "2", "y", 3)], [], [("c", "3", "z", 4), ("a", "0", "w", 0)]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    want = [("a", "2", "x", 3), ("b", "1", "x", 2), ("c", "3", "z", 4)]
    for n, df in enumerate(frames):
        J.upsert_sink(path, ["id"], ("first",), buckets=8)(df, n)  # a new sink each time: nothing is held by the driver
    table = lambda: sorted(map(tuple, J.upserted(spark, path, frames[0].schema).collect()))
    assert table() == want
    written = [p.name for p in (tmp_path / "rows" / "batch=1").iterdir() if p.name.startswith("bucket=")]
    assert len(written) == 1
    J.upsert_sink(path, ["id"], ("first",), buckets=8)(frames[3], 3)
    assert table() == want


def test_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from loomgraph.sources import shared

    def session(master, folder):
        conf = {"spark.checkpoint.dir": folder} if folder else {}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))

    assert shared.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y/loomgraph-app-1"
    assert "spark-shared-" in shared.shared_dir(session("local[4]", None))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master, None))


def test_stages_can_be_dropped(spark, monkeypatch, tmp_path):
    from loomgraph.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda s: str(tmp_path / "app"))  # not the folder of the other tests
    assert shared.written(spark.range(3)).count() == 3 and list((tmp_path / "app").iterdir())
    since = shared.mark(spark)
    gone, kept = shared.written(spark.range(4), "gone"), shared.written(spark.range(5), "kept")
    shared.drop_stages(spark, since, keep=(kept,))
    names = sorted(p.name.split("-")[0] for p in (tmp_path / "app").iterdir())
    assert names == ["kept", "stage"] and kept.count() == 5 and gone is not None
    shared.drop_stages(spark)
    assert not (tmp_path / "app").exists() and tmp_path.exists()


def test_chunk_queries(spark):
    """The queries that have no SQL, over whole tables, by the plain rule."""
    import hashlib

    from loomgraph.plans import registry

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(f"doc:{r.doc_id}", i, hashlib.md5(t.encode()).hexdigest()) for r in docs for i, t in enumerate(plain_chunks(r.text or "", 1000, 200))}
    rows = registry.QUERIES["vec05_built_chunks"](spark, sf).collect()
    assert {(r.document_id, r.chunk_no, r.text_md5) for r in rows} == want and len({r.chunk_id for r in rows}) == len(rows) == len(want)
    passages = registry.QUERIES["doc08_passages"](spark, sf).groupBy("document_id").count().collect()
    report = {r.document_id: r.n_passages for r in registry.QUERIES["doc27_passage_report"](spark, sf).collect()}
    assert {r.document_id: r["count"] for r in passages} == {k: v for k, v in report.items() if v} and len(report) == len(docs)
