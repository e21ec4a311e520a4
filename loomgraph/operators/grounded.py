"""Grounded answers for a table of questions: interpretation, candidates, evidence, ranking, clusters, insights, answers.

Every stage is a long table keyed by question_id; windows partition by question, whose rows the stages before have
bounded. Evidence is ranked once per entity (and document), so that a question joins a few rows of each
candidate and never all of its evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schemas as S
from loomgraph.functions import text as X
from loomgraph.operators.graph_read import contains_hits
from loomgraph.sources.shared import sent, written

MOST_CANDIDATES, FALLBACKS, MOST_PER_CANDIDATE = 20, 5, 10
WEAK, WEAK_KEPT = 0.55, 2
c = F.col


def per(*by: str):  # noqa: ANN201
    return Window.partitionBy("question_id", *by)


def nth(df: DataFrame, name: str, *order: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn(name, F.row_number().over(per(*by).orderBy(*order)))


def half_even(x: Column) -> Column:
    """Two decimals, halves to even, whatever the last bits of a sum are."""
    return F.bround(F.round(100 * x, 9), 0) / 100


def same_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " "))


# --- requests and interpretation


def with_defaults(questions: DataFrame) -> DataFrame:
    return questions.withColumns({"max_evidence": F.coalesce("max_evidence", F.lit(5)), "include_citations": F.coalesce("include_citations", F.lit(True)), "answer_mode": F.coalesce("answer_mode", F.lit("answer")), "node_types": F.coalesce("node_types", F.array().cast("array<string>"))})


def is_valid() -> Column:
    ok = (F.trim(F.coalesce("question", F.lit(""))) != "") & c("max_evidence").between(1, 20) & c("answer_mode").isin("answer", "explore")
    return F.coalesce(ok, F.lit(False))


def validate(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions that can be answered, with defaults, and the rejects."""
    rows = with_defaults(questions)
    return rows.where(is_valid()), rows.where(~is_valid())


def interpret(questions: DataFrame) -> DataFrame:
    q = c("question")
    hints = X.entity_hints(q)
    return questions.withColumns({"intent": X.intent(q), "entity_hints": hints, "relation_hints": X.relation_hints(q), "terms": X.disambiguation_terms(q), "tokens": F.when(F.size(hints) > 0, hints).otherwise(X.question_tokens(q))})


# --- candidates


def in_document_scope(hits: DataFrame, entity_documents: DataFrame, instances: DataFrame) -> DataFrame:
    """hits (question_id, document_id, uid, ...) of questions about one document only if the entity, or a peer that shares its
    canonical, has evidence there. Only pairs that are asked for go to their canonicals: peers are never paired with each other."""
    scoped = hits.where("document_id is not null")
    asked = scoped.select("uid", "document_id").distinct()
    there = entity_documents.join(sent(asked.select("document_id").distinct(), "asked-documents"), "document_id", "left_semi")
    itself = asked.join(there.withColumnRenamed("entity_uid", "uid").hint("merge"), ["uid", "document_id"], "left_semi")
    reach = instances.join(there, "entity_uid").select("canonical_id", "document_id").distinct().hint("merge")
    through = asked.join(instances.withColumnRenamed("entity_uid", "uid"), "uid").join(reach, ["canonical_id", "document_id"], "left_semi").select("uid", "document_id")
    scoped = scoped.join(itself.unionByName(through).distinct(), ["uid", "document_id"], "left_semi")
    return hits.where("document_id is null").unionByName(scoped.select(*hits.columns))


def local_candidates(asked: DataFrame, entities: DataFrame, entity_documents: DataFrame, instances: DataFrame) -> DataFrame:
    """question_id, entity_id, name, type, score, reason, source, pos: entities whose name contains a token. (A name that contains
    all tokens together contains the first of them.) Of a token's entities of one type no question takes more than the first 20, so
    lists of 20 a token and type meet the questions; only questions about one document, which may pass over any of them, meet all."""
    known = entities.where(c("type").isin(*S.ENTITY_TYPES))
    tokens = asked.select("question_id", "document_id", "node_types", F.explode("tokens").alias("token"))
    free, scoped = tokens.where("document_id is null"), tokens.where("document_id is not null")
    typed = known.select("uid", "type").hint("merge")
    hits = contains_hits(known, "uid", "name", free).join(typed, "uid")
    first = F.row_number().over(Window.partitionBy("token", "type").orderBy("uid"))
    lists = sent(hits.withColumn("k", first).where(c("k") <= MOST_CANDIDATES).drop("k"), "local-lists")
    every = sent(contains_hits(known, "uid", "name", scoped).join(typed, "uid"), "scoped-hits")
    # names are looked up for the entities on the lists only, which are fewer than the entities and the questions
    named = sent(known.join(lists.select("uid").unionByName(every.select("uid")).distinct().hint("merge"), "uid", "left_semi"), "local-names")
    fits = (F.size("node_types") == 0) | F.array_contains("node_types", c("type"))
    met = lambda side, found: side.join(found, "token").where(fits).select("question_id", "document_id", "uid").distinct()
    rows = met(free, lists).unionByName(in_document_scope(met(scoped, every), entity_documents, instances))
    rows = nth(rows, "pos", "uid").where(c("pos") <= MOST_CANDIDATES).join(named, "uid")
    return rows.select("question_id", c("uid").alias("entity_id"), "name", "type", F.lit(1.0).alias("score"), F.lit("name_match").alias("reason"), F.lit("local").alias("source"), "pos")


def canonical_candidates(asked: DataFrame, entities: DataFrame, entity_documents: DataFrame, instances: DataFrame, registry: DataFrame) -> DataFrame:
    """As local_candidates, through canonical names, aliases and acronyms; more documents, higher score. Of a canonical's entities, which
    share its documents, the first 20 can count, and of a token's the best 20: questions meet lists of 20 a token."""
    tokens = asked.select("question_id", F.explode(F.array_distinct(F.transform("tokens", X.match_key))).alias("token")).where("token <> ''")
    words = tokens.select("token").distinct()
    part = contains_hits(registry, "canonical_id", "canonical_name", words)
    exact = registry.select("canonical_id", F.explode(F.array_union("normalized_aliases", "acronyms")).alias("token")).join(words, "token").select("token", "canonical_id")
    reach = instances.join(entity_documents, "entity_uid").groupBy("canonical_id").agg(F.count_distinct("document_id").alias("documents"))
    first = F.row_number().over(Window.partitionBy("canonical_id").orderBy("entity_uid"))
    members = instances.join(entities.select(c("uid").alias("entity_uid"), "type"), "entity_uid").withColumn("k", first).where(c("k") <= MOST_CANDIDATES).drop("k")
    members = members.join(reach, "canonical_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    best = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("documents"), "entity_uid", "canonical_id"))
    lists = sent(part.unionByName(exact).distinct().join(members, "canonical_id").withColumn("k", best).where(c("k") <= MOST_CANDIDATES).drop("k"), "canonical-lists")
    named = sent(registry.select("canonical_id", "canonical_name").join(lists.select("canonical_id").distinct().hint("merge"), "canonical_id", "left_semi"), "canonical-names")
    rows = tokens.join(lists, "token").drop("token").distinct()
    rows = nth(rows, "pos", F.desc("documents"), "entity_uid", "canonical_id").where(c("pos") <= MOST_CANDIDATES)
    rows = rows.join(named, "canonical_id")
    score = F.greatest(F.lit(0.8), F.least(F.lit(1.0), 0.8 + c("documents") * 0.02))
    return rows.select("question_id", c("entity_uid").alias("entity_id"), c("canonical_name").alias("name"), "type", score.alias("score"), F.lit("canonical_linked_match").alias("reason"), F.lit("canonical-ready").alias("source"), (c("pos") + MOST_CANDIDATES).alias("pos"))


def density(relations: DataFrame, evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """uid, n_relations, n_evidence, n_citations of each entity that is the source of a relation."""
    at = [x for x in ("document_id", "passage_id") if x in evidence.columns and x in citations.columns]
    cited = citations.groupBy(*at).agg(F.count_distinct("citation_id").alias("k"))
    source = relations.select("uid", c("source_uid").alias("entity"))
    # evidence is counted a relation at a time before it moves; only that of cited passages goes to its entity, each passage once
    per = evidence.groupBy(c("relation_uid").alias("uid")).agg(F.count("uid").alias("e"))
    counts = source.join(per, "uid", "left").groupBy("entity").agg(F.count("*").alias("n_relations"), F.sum(F.coalesce("e", F.lit(0))).alias("n_evidence"))
    quoted = evidence.select(c("relation_uid").alias("uid"), *at).join(cited, at).join(source, "uid").select("entity", "passage_id", "k").distinct()
    counts = counts.join(quoted.groupBy("entity").agg(F.sum("k").alias("n_citations")), "entity", "left")
    return counts.select(c("entity").alias("uid"), "n_relations", "n_evidence", F.coalesce("n_citations", F.lit(0)).alias("n_citations"))


def fallback_candidates(asked: DataFrame, local: DataFrame, entities: DataFrame, found: DataFrame, scope_fallback: bool = False, entity_documents: DataFrame | None = None) -> DataFrame:
    """The densest five entities for questions of two tokens or more that no local candidate answers. Questions that ask for the
    same node types in the same order share one list. A question's document doesn't restrict its list, so the rule stands, unless
    ``scope_fallback`` is set: then only entities with evidence in that document are on it (``entity_documents`` tells)."""
    need = asked.where(F.size("tokens") > 1).join(local.select("question_id").distinct().hint("merge"), "question_id", "left_anti")
    scope = F.coalesce("document_id", F.lit("")) if scope_fallback else F.lit("")
    need = need.withColumns({"cited": c("intent") == "CITATION_BASIS", "kinds": F.array_join("node_types", ","), "scope": scope})
    every = F.array(*map(F.lit, S.ENTITY_TYPES))
    kinds = need.select("cited", "kinds", "scope", F.explode(F.array_distinct(F.when(F.size("node_types") == 0, every).otherwise(c("node_types")))).alias("type")).distinct()
    rows = found.join(entities.where(c("type").isin(*S.ENTITY_TYPES)).hint("merge"), "uid").withColumn("scope", F.lit(""))
    if scope_fallback:
        there = entity_documents.select(c("entity_uid").alias("uid"), c("document_id").alias("scope")).distinct()
        rows = rows.unionByName(rows.drop("scope").join(there, "uid").select(*rows.columns))
    rows = rows.withColumn("cited", F.explode(F.array(F.lit(True), F.lit(False))))
    first = F.when(c("cited"), c("n_citations")).otherwise(c("n_evidence"))
    densest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(first.desc(), F.desc("n_relations"), F.desc("n_evidence"), F.desc("n_citations"), "uid"))
    # the densest five of some types are among the densest five of each: lists of five a type meet the questions' types
    of_type = rows.withColumn("pos", densest("cited", "scope", "type")).where(c("pos") <= FALLBACKS).drop("pos")
    lists = of_type.join(kinds, ["cited", "scope", "type"]).withColumn("pos", densest("cited", "kinds", "scope")).where(c("pos") <= FALLBACKS)
    score = (c("n_relations") + c("n_evidence") + c("n_citations")).cast("double")
    return need.select("question_id", "cited", "kinds", "scope").join(lists, ["cited", "kinds", "scope"]).select("question_id", c("uid").alias("entity_id"), "name", "type", score.alias("score"), F.lit("graph_density_fallback").alias("reason"), F.lit("local").alias("source"), "pos")


def boosted(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Candidates whose name contains a disambiguation term: 0.1 more, but never above 1."""
    rows = candidates.join(asked.select("question_id", "terms").hint("merge"), "question_id")
    hit = F.exists("terms", lambda t: F.lower("name").contains(F.lower(t)))
    return rows.withColumns({"score": F.when(hit, F.least(F.lit(1.0), c("score") + 0.1)).otherwise(c("score")), "reason": F.when(hit, F.concat("reason", F.lit("|disambiguation_context"))).otherwise(c("reason"))}).drop("terms")


def merged(candidates: DataFrame) -> DataFrame:
    """One candidate per question and entity: the canonical one if there is one, else that of the highest score; in the place of the
    first."""
    first = candidates.withColumn("at", F.min("pos").over(per("entity_id")))
    out = nth(first, "k", F.when(c("source") == "canonical-ready", 0).otherwise(1), F.desc("score"), "pos", by=("entity_id",))
    return out.where("k = 1").withColumn("pos", c("at")).drop("k", "at")


def representatives(candidates: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The best candidate of each match key, then the best of these, with their rank."""
    key = F.coalesce(F.nullif(X.match_key(c("name")), F.lit("")), c("entity_id"))
    rows = nth(candidates.withColumn("key", key), "k", F.desc("score"), "pos", "entity_id", by=("key",)).where("k = 1").drop("k", "key")
    return nth(rows, "rank", F.desc("score"), "pos", "entity_id").where(c("rank") <= most).drop("pos")


def select_candidates(asked: DataFrame, graph) -> DataFrame:  # noqa: ANN001
    """question_id, entity_id, name, type, score, reason, source, rank."""
    local = written(local_candidates(asked, graph.entities, graph.entity_documents, graph.instances), "local")  # read twice
    spare = fallback_candidates(asked, local, graph.entities, density(graph.relations, graph.evidence_keys, graph.citations))
    canonical = canonical_candidates(asked, graph.entities, graph.entity_documents, graph.instances, graph.registry)
    return representatives(merged(boosted(local.unionByName(spare).unionByName(canonical), asked)))


# --- evidence


def planned(asked: DataFrame) -> DataFrame:
    """asked with strategy, citations_first, per_candidate and depth of its intent's plan."""
    rows = asked.sparkSession.createDataFrame(list(S.TRAVERSAL_PLANS), "intent string, strategy string, citations_first boolean, least int, most int, more int, depth int")
    out = asked.join(F.broadcast(rows), "intent")  # five rows
    return out.withColumn("per_candidate", F.greatest("least", F.least(c("max_evidence") + c("more"), "most"))).drop("least", "most", "more")


def reached_relations(relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Relations that a candidate (entity_id) is the source of, or what one of these leads to: those of one hop and of two."""
    starts = candidates.select(c("entity_id").alias("source_uid")).distinct()
    middle = relations.join(starts.hint("merge"), "source_uid", "left_semi").select(c("target_uid").alias("source_uid"))
    return relations.join(starts.unionByName(middle).distinct().hint("merge"), "source_uid", "left_semi").select(*relations.columns)


def evidence_rows(relations: DataFrame, evidence: DataFrame, passages: DataFrame, documents: DataFrame, citations: DataFrame, references: DataFrame) -> DataFrame:
    """All there is to show of each evidence; a passage with several citations gives as many rows. Evidence that tells its document is joined by
    that too."""
    at = [x for x in ("document_id", "passage_id") if x in evidence.columns]
    by = at[:-1]
    rows = evidence.select(c("uid").alias("evidence_uid"), "relation_uid", *at, c("confidence").alias("evidence_confidence"))
    rows = rows.join(relations.select(c("uid").alias("relation_uid"), "source_uid", "target_uid", c("type").alias("relation_type"), c("confidence").alias("relation_confidence")), "relation_uid")
    rows = rows.join(passages.select(*at, c("document_id").alias("in_document"), c("section_title"), c("page_number").alias("page"), F.substring("text", 1, 360).alias("snippet")), at, "left")
    rows = rows.join(citations.select(*at, "citation_id", F.get("labels", 0).alias("label"), c("reference_id").alias("ref")), at, "left")
    rows = rows.join(references.select(*by, c("reference_id").alias("ref"), c("reference_id").alias("reference_entry_id"), c("title_guess").alias("ref_title")), [*by, "ref"], "left").drop(*by)
    rows = rows.join(documents.select(c("document_id").alias("in_document"), c("title").alias("document_name")), "in_document", "left").withColumnRenamed("in_document", "document_id")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("relation_confidence", "evidence_confidence", F.lit(0.5))))
    return rows.select("source_uid", "target_uid", "relation_uid", "evidence_uid", F.coalesce(F.nullif("relation_type", F.lit("")), F.lit("RELATED_TO")).alias("relation_type"), "page", F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("section_title", F.lit("Unknown")).alias("section"), sure.alias("confidence"), "document_id", "document_name", F.coalesce("label", "ref_title").alias("citation_label"), "reference_entry_id", c("citation_id"))


def best_per_entity(rows: DataFrame, cited_first: bool, *by: str) -> DataFrame:
    """The first few rows of each start node (and document), with their place: cut where the rows are, before they move."""
    first = [F.when(c("citation_id").isNotNull(), 0).otherwise(1)] if cited_first else []
    order = [*first, F.desc("confidence"), c("evidence_uid"), F.asc_nulls_first("citation_id")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("start", *by).orderBy(*order))).where(c("place") <= MOST_PER_CANDIDATE)


def collect_evidence(candidates: DataFrame, plans: DataFrame, rows: DataFrame, cap_after_rank: bool = False) -> DataFrame:
    """question_id, pos and the evidence of each question's candidates: one hop, then two where the plan says so, each up to the plan's
    limit per candidate; repeats go, and the first max_evidence in order of discovery stay, so the rule stands. With
    ``cap_after_rank`` all of it stays, and :func:`ranked` keeps the best max_evidence. Only what is asked for is looked at: nodes that are
    candidates, or lead on from one, and of a question's document its own evidence. What is shown of a row joins it when its place is known."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "evidence-rows")
    one = rows.select("row", c("source_uid").alias("start"), "confidence", "evidence_uid", "citation_id", "document_id")
    pairs = written(rows.select(c("source_uid").alias("from"), c("target_uid").alias("start")).distinct().where(c("from") != c("start")), "evidence-pairs")
    asked = candidates.select("question_id", "rank", c("entity_id").alias("start"), c("name").alias("entity_name")).join(plans.select("question_id", c("document_id").alias("scope"), "citations_first", "per_candidate", "depth", "max_evidence").hint("merge"), "question_id")
    asked = written(asked, "evidence-asked")

    def anywhere(starts: DataFrame, k: int, cited: bool) -> DataFrame:
        """Evidence by start node (start); over two hops, the best of each middle node is enough to find the best of all."""
        if k == 1:
            return best_per_entity(one.join(sent(starts, "starts"), "start", "left_semi"), cited)
        ways = sent(pairs.join(starts.select(c("start").alias("from")).hint("merge"), "from", "left_semi"), "ways")
        near = best_per_entity(one.join(ways.select("start").distinct(), "start", "left_semi"), cited).drop("place")
        return best_per_entity(near.join(ways, "start").withColumn("start", c("from")).drop("from"), cited)

    def within(starts: DataFrame, k: int, cited: bool) -> DataFrame:
        """The same by start node and document (start, document_id): a document's nodes meet those asked about it, and only then what leads to them."""
        if k == 1:
            return best_per_entity(one.join(starts.hint("merge"), ["start", "document_id"], "left_semi"), cited, "document_id")
        there = one.join(sent(starts.select("document_id").distinct(), "asked-documents"), "document_id", "left_semi")
        near = written(best_per_entity(there, cited, "document_id").drop("place"), "near-documents")
        ways = near.select("start", "document_id").distinct().join(starts.select(c("start").alias("from"), "document_id").hint("merge"), "document_id")
        ways = ways.join(pairs.hint("merge"), ["from", "start"], "left_semi")
        return best_per_entity(near.join(ways.hint("merge"), ["start", "document_id"]).withColumn("start", c("from")).drop("from"), cited, "document_id")

    found = []
    for k in (1, 2):
        for cited in (False, True):
            ask = asked.where((c("depth") >= k) & (c("citations_first") == cited))
            free, tied = ask.where("scope is null"), ask.where("scope is not null").withColumn("document_id", c("scope"))
            some = [(free, anywhere(free.select("start").distinct(), k, cited), ["start"]), (tied, within(tied.select("start", "document_id").distinct(), k, cited), ["start", "document_id"])] if not ask.isEmpty() else []
            found += [who.join(sent(best.select(*on, "row", "place"), "best"), on).withColumn("hop", F.lit(k)) for who, best, on in some]
    keys = ["question_id", "rank", "start", "entity_name", "per_candidate", "max_evidence", "row", "place", "hop"]
    found = reduce(DataFrame.unionByName, [x.select(*keys) for x in found]) if found else asked.withColumns({"row": F.lit(0).cast("long"), "place": F.lit(0), "hop": F.lit(0)}).select(*keys).where("false")
    found = written(found.where(c("place") <= c("per_candidate")).drop("per_candidate"), "evidence-found")
    shown = rows.join(found.select("row").distinct().hint("merge"), "row", "left_semi").drop("source_uid", "target_uid", "citation_id").withColumn("said", same_words(c("snippet")))
    shown = written(shown.withColumn("repeats", F.md5(F.concat_ws("\n", "relation_uid", "evidence_uid", "said"))), "evidence-shown")
    found = nth(found.join(sent(shown.select("row", "repeats"), "evidence-repeats"), "row"), "k", "rank", "hop", "place", by=("repeats",))
    found = nth(found.where("k = 1").drop("repeats"), "pos", "rank", "hop", "place")
    found = found if cap_after_rank else found.where(c("pos") <= c("max_evidence"))
    found = found.join(sent(shown, "evidence-told"), "row")
    return found.select("question_id", "pos", c("start").alias("entity_id"), "entity_name", "relation_uid", "evidence_uid", "relation_type", "page", "snippet", "said", "section", "confidence", "document_id", "document_name", "citation_label", "reference_entry_id")


def relevant(evidence: DataFrame) -> DataFrame:
    """Evidence of whitelisted relations, or where a question has none, its two surest items; of weak items, the first two of
    each relation type."""
    ok = F.upper("relation_type").isin(*S.RELATION_WHITELIST)
    rows = evidence.withColumns({"ok": ok, "any_ok": F.max(ok.cast("int")).over(per()) == 1, "sure": F.row_number().over(per().orderBy(F.desc("confidence"), "pos"))})
    rows = rows.where((c("any_ok") & c("ok")) | (~c("any_ok") & (c("sure") <= 2)))
    # a fallback slice stands in order of confidence
    rows = rows.withColumn("pos", F.when(c("any_ok"), c("pos")).otherwise(c("sure"))).drop("ok", "any_ok", "sure")
    weak = c("confidence") < WEAK
    so_far = F.count_if(weak).over(per("relation").orderBy("pos"))
    return rows.withColumn("relation", F.upper("relation_type")).withColumn("weak", so_far).where(~weak | (c("weak") <= WEAK_KEPT)).drop("weak", "relation")


# --- ranking


def section_weight(intent: Column, section: Column) -> Column:
    name, out = F.lower(F.trim(section)), F.lit(0.0)
    for k, v in S.SECTION_WEIGHTS.items():
        out = F.when(name == k, v).otherwise(out)
    for which, k, v in S.SECTION_ADJUSTMENTS:
        out = out + F.when((intent == which) & (name == k), v).otherwise(0.0)
    return out


def alignment(intent: Column, relation: Column) -> Column:
    out = F.lit(0.0)
    for which, (words, bonus) in S.ALIGNED_RELATIONS.items():
        out = out + F.when((intent == which) & (relation != "") & X.contains_any(F.lower(relation), words), bonus).otherwise(0.0)
    return out


def by_value(values: dict[str, float], key: Column, other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def ranked(evidence: DataFrame, asked: DataFrame, candidates: DataFrame, case_insensitive_hints: bool = False) -> DataFrame:
    """evidence with features, score and rank, best first; the first max_evidence. Relation hints are in capitals and compared to
    a lowered type unless ``case_insensitive_hints`` is set, so that they never count: so the rule stands."""
    names = candidates.groupBy("question_id").agg(F.collect_list(F.lower("name")).alias("names"))
    rows = evidence.join(asked.select("question_id", "intent", "relation_hints", "max_evidence").hint("merge"), "question_id").join(names.hint("merge"), "question_id")
    home = F.lower(F.trim(F.coalesce("document_id", "document_name", F.lit(""))))
    rows = rows.withColumn("home", home).withColumns({"copies": F.count("*").over(per("said")), "from_home": F.count("*").over(per("home"))})
    intent, cited = c("intent"), c("citation_label").isNotNull() | c("reference_entry_id").isNotNull()
    hints = F.transform("relation_hints", lambda h: F.lower(h)) if case_insensitive_hints else c("relation_hints")
    flag = lambda cond, v: F.when(cond, v).otherwise(0.0)
    score = (
        flag(F.exists("names", lambda n: F.lower("snippet").contains(n)), 2.0) + section_weight(intent, c("section")) + F.when(cited, 1.4 * by_value(S.CITATION_FACTORS, intent, 1.0)).otherwise(0.0)
        + 1.8 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("confidence"))) + flag(F.exists(hints, lambda h: F.lower("relation_type").contains(h)), 1.5) + alignment(intent, c("relation_type"))
        + flag(F.lower("section") != "unknown", 0.3) + flag(c("home") != "", 0.2)
        - flag(c("copies") > 1, F.least(F.lit(3.0), 2.2 + 0.6 * (c("copies") - 2))) - flag((c("from_home") > 1) & (c("home") != ""), F.least(F.lit(1.0), 0.35 * (c("from_home") - 1)))
    )
    rows = nth(rows.withColumn("score", F.round(score, 6)), "rank", F.desc("score"), "pos").where(c("rank") <= c("max_evidence"))
    return rows.drop("names", "relation_hints", "home", "copies", "from_home", "pos")


# --- clusters and insights


def clustered(found: DataFrame) -> DataFrame:
    """Ranked evidence with its cluster's key and measures; an item whose snippet its cluster has already is dropped."""
    relation = F.upper("relation_type")
    key = F.concat_ws("::", same_words(c("entity_name")), relation, F.substring("said", 1, 72))
    rows = nth(found.withColumns({"cluster_key": key, "relation": relation}), "k", "rank", by=("cluster_key", "said")).where("k = 1").drop("k")
    cited = (c("citation_label").isNotNull() | c("reference_entry_id").isNotNull()).cast("int")
    w = per("cluster_key")
    rows = rows.withColumns({"frequency": F.count("*").over(w), "cites": F.sum(cited).over(w), "homes": F.size(F.collect_set(F.coalesce("document_name", "document_id")).over(w)), "first_rank": F.min("rank").over(w)})
    return rows.withColumn("importance", F.bround(F.least(F.lit(1.0), 0.2 * c("frequency") + 0.1 * c("cites")), 2))


def clusters(rows: DataFrame) -> DataFrame:
    """question_id, cluster_key, entity, relation, frequency, cites, homes, importance, cluster_rank."""
    out = rows.groupBy("question_id", "cluster_key").agg(F.min_by("entity_name", "rank").alias("entity"), *[F.first(x).alias(x) for x in ("relation", "frequency", "cites", "homes", "importance", "first_rank")])
    return nth(out, "cluster_rank", F.desc("importance"), F.desc("frequency"), "first_rank")


def reliable(found: DataFrame) -> DataFrame:
    return found.where(((c("homes") >= 2) | (c("frequency") >= 2)) & (c("importance") >= 0.45) & ((c("cites") >= 1) | (c("frequency") >= 2)))


def insights(found: DataFrame, most: int = 5) -> DataFrame:
    """question_id, type, text, confidence, supports, insight_rank."""
    good = reliable(found)
    n2 = lambda x: F.bround(x, 2)
    common = good.where("frequency >= 2").select("question_id", F.lit("COMMON_PATTERN").alias("type"), X.filled(S.INSIGHT_TEXTS["COMMON_PATTERN"], entity=c("entity"), relation=c("relation")).alias("text"), n2(F.least(F.lit(0.95), 0.5 + 0.1 * c("frequency"))).alias("confidence"), F.lit(1).cast("long").alias("supports"), F.lit(1).alias("kind"), c("cluster_rank").alias("at"))
    relation = good.groupBy("question_id", "relation").agg(F.count("*").alias("supports"), F.min("cluster_rank").alias("at")).where("supports >= 2")
    frequent = relation.select("question_id", F.lit("FREQUENT_RELATION").alias("type"), X.filled(S.INSIGHT_TEXTS["FREQUENT_RELATION"], relation=c("relation")).alias("text"), n2(F.least(F.lit(0.9), 0.45 + 0.08 * c("supports"))).alias("confidence"), "supports", F.lit(2).alias("kind"), "at")
    trend = good.where("frequency >= 2 and homes >= 2").select("question_id", F.lit("CROSS_DOCUMENT_TREND").alias("type"), X.filled(S.INSIGHT_TEXTS["CROSS_DOCUMENT_TREND"], entity=c("entity"), relation=F.lower("relation"), homes=c("homes")).alias("text"), n2(F.least(F.lit(0.95), 0.55 + 0.1 * c("homes"))).alias("confidence"), F.lit(1).cast("long").alias("supports"), F.lit(3).alias("kind"), c("cluster_rank").alias("at"))
    rows = common.unionByName(frequent).unionByName(trend).where("confidence >= 0.55").withColumn("low", F.lower(F.trim("text")))
    rows = nth(rows, "k", F.desc("confidence"), "kind", "at", by=("low",)).where("k = 1")
    return nth(rows, "insight_rank", F.desc("confidence"), "kind", "at").where(c("insight_rank") <= most).select("question_id", "type", "text", "confidence", "supports", "insight_rank")


def insight_groups(found: DataFrame, primary: int = 3, floor: float = 0.7) -> DataFrame:
    """insights with group: the first few of high confidence are primary, the others deferred."""
    high = c("confidence") >= floor
    place = F.count_if(high).over(per().orderBy("insight_rank"))
    return found.withColumn("group", F.when(high & (place <= primary), "primary").otherwise("deferred"))


# --- answers


def ordered(rows: DataFrame) -> DataFrame:
    """Clustered evidence in the order it is shown: by cluster importance, citations, confidence; within equals as clusters stand."""
    ranks = clusters(rows).select("question_id", "cluster_key", "cluster_rank")
    return nth(rows.join(ranks.hint("merge"), ["question_id", "cluster_key"]), "shown", F.desc("importance"), F.desc("cites"), F.desc("confidence"), "cluster_rank", "rank")


def distinct_snippets(rows: DataFrame, most: int) -> DataFrame:
    return nth(nth(rows, "k", "shown", by=("said",)).where("k = 1"), "top", "shown").where(c("top") <= most).drop("k")


def citations(rows: DataFrame) -> DataFrame:
    """question_id, label, reference_entry_id, page, document_name: each pair of label and reference once, in order."""
    some = rows.where("(citation_label is not null or reference_entry_id is not null) and include_citations")
    first = nth(some, "k", "shown", by=("citation_label", "reference_entry_id")).where("k = 1")
    return nth(first, "place", "shown").select("question_id", F.coalesce("citation_label", F.lit("citation")).alias("label"), "reference_entry_id", "page", "document_name", "place")


def in_order(values: Column, order: Column) -> Column:
    """An ordered list of values in an aggregation."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda x: x["v"])


def focus_ids(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """question_id, focus: candidates, then relations and references of the evidence, each once; the first is primary."""
    nodes = candidates.groupBy("question_id").agg(in_order(c("entity_id"), c("rank")).alias("a"))
    more = rows.groupBy("question_id").agg(F.flatten(in_order(F.array("entity_id", "relation_uid", "reference_entry_id"), c("shown"))).alias("b"))
    both = F.concat("a", F.coalesce("b", F.array().cast("array<string>")))
    return nodes.join(more, "question_id", "left").select("question_id", F.array_distinct(F.filter(both, lambda x: x.isNotNull())).alias("focus"))


def answers(asked: DataFrame, candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per question: the answer's text and confidence, guardrails, gates, key points and lists."""
    matched = in_order(F.struct(c("entity_id").alias("id"), "type", c("name").alias("display_name")), c("rank")).alias("matched_entities")
    names = candidates.groupBy("question_id").agg(in_order(c("name"), c("rank")).alias("names"), matched, (F.max((~F.lower("reason").contains("fallback")).cast("int")) == 0).alias("only_fallback"))
    shown = ordered(rows).join(asked.select("question_id", "include_citations").hint("merge"), "question_id")
    top = distinct_snippets(shown, 3).groupBy("question_id").agg(
        F.min_by("relation_type", "top").alias("first_relation"), in_order(F.trim("snippet"), c("top")).alias("snippets"), F.array_sort(F.collect_set(F.nullif("relation_type", F.lit("")))).alias("rel_types"),
        F.array_sort(F.collect_set("section")).alias("sections"), F.array_sort(F.collect_set("citation_label")).alias("labels"),
    )
    size = shown.groupBy("question_id").agg(F.count("*").alias("n_evidence"))
    cites = citations(shown).groupBy("question_id").agg(F.count("*").alias("n_citations"))
    groups = clusters(rows)
    importance = groups.groupBy("question_id").agg(F.avg("importance").alias("avg_importance"), F.min_by(F.struct("entity", "relation", "frequency"), "cluster_rank").alias("first_cluster"))
    said = insights(groups).groupBy("question_id").agg(F.min_by("text", "insight_rank").alias("first_insight"), F.count("*").alias("n_insights"))
    out = asked
    for part in (names, top, size, cites, importance, said, focus_ids(candidates, shown)):
        out = out.join(part.hint("merge"), "question_id", "left")
    n, k = F.coalesce("n_evidence", F.lit(0)), F.coalesce("n_citations", F.lit(0))
    fact, node = F.coalesce(F.get(F.filter("snippets", lambda s: s != ""), 0), F.lit("")), F.get("names", 0)
    rels, first = F.array_join("rel_types", ", "), c("first_relation")
    relation, target = F.when(rels != "", rels).otherwise(first), F.coalesce(F.get("names", 1), F.lit(S.TARGET_UNKNOWN))
    concepts, cited = F.array_join(F.slice("names", 1, 3), ", "), F.array_join(F.slice("labels", 1, 4), ", ")
    has, intent = fact != "", c("intent")
    values = {"node": node, "concepts": concepts, "sections": F.array_join(F.slice("sections", 1, 3), ", "), "fact": fact, "relations": rels, "target": target, "first": first, "relation": relation, "labels": cited}
    text = F.when((intent == "CITATION_BASIS") & (cited != ""), X.filled(S.CITED_TEXT, **values))
    for which, (with_fact, without) in S.ANSWER_TEXTS.items():
        text = text.when(intent == which, F.when(has, X.filled(with_fact, **values)).otherwise(X.filled(without, **values)))
    found = F.when(n > 0, text).otherwise(S.NOTHING_FOUND)
    score = F.when(n == 0, 0.0).otherwise(half_even(F.least(F.lit(1.0), 0.45 * F.least(F.lit(1.0), n / 5) + 0.35 * F.coalesce("avg_importance", F.lit(0.0)) + 0.20 * F.least(F.lit(1.0), k / F.greatest(F.lit(1), n)))))
    anchors = F.array_distinct(F.concat(X.question_tokens(c("question")), F.filter("entity_hints", lambda h: F.length(h) >= 3)))
    anchored = F.exists(anchors, lambda t: F.exists("names", lambda m: F.lower(m).contains(t)))
    strict = c("answer_mode") == "answer"
    gate = F.when(c("names").isNull(), "no_candidates").when(strict & (intent == "SUMMARY") & c("only_fallback") & ~F.coalesce(anchored, F.lit(False)), "weak_fallback").when(strict & (n == 0), "no_evidence")
    out = out.withColumns({"gate": gate, "confidence": score, "n_evidence": n, "n_citations": k})
    open_, weak = c("gate").isNull(), (n < 2) | (c("confidence") < 0.45)
    why = F.when(~open_, "no_evidence_hard_gate").when(n == 0, "no_evidence").when((intent == "CITATION_BASIS") & (k == 0), "citation_missing").when(weak, "weak_match")
    hedged, tails = F.lower(found).contains(S.LIMITED), S.UNCERTAINTY_TEXTS
    tail = F.when(why == "citation_missing", tails["citation_missing"]).when(hedged, "").when(why == "no_evidence", tails["no_evidence"]).when(why == "weak_match", tails["weak_match"]).otherwise("")
    badge = F.when(c("confidence") >= 0.65, "GROUNDED").when(c("confidence") >= 0.3, "WEAK_GROUNDING").otherwise("NO_GROUNDING")
    closing = F.lit(None).cast("string")
    for which, said_last in S.CLOSING_POINTS.items():
        closing = F.when(intent == which, said_last).otherwise(closing)
    lead = X.filled(S.KEY_POINTS[0], entity=c("first_cluster.entity"), relation=c("first_cluster.relation"), frequency=c("first_cluster.frequency").cast("string"))
    points = F.slice(F.filter(F.array(lead, X.filled(S.KEY_POINTS[1], insight=c("first_insight")), closing), lambda p: p.isNotNull()), 1, 3)
    nothing = F.array().cast("array<string>")
    return out.select(
        "question_id", "intent", "gate", F.when(open_, F.concat(found, tail)).otherwise(S.NOTHING_GROUNDED).alias("answer"), F.when(open_, c("confidence")).otherwise(0.0).alias("confidence"), F.when(open_, badge).otherwise("NO_GROUNDING").alias("badge"),
        why.isNotNull().alias("limited_evidence"), why.alias("uncertainty_reason"), F.when(open_, points).otherwise(nothing).alias("key_points"), F.when(open_, n).otherwise(0).cast("long").alias("n_evidence"), F.when(open_, k).otherwise(0).cast("long").alias("n_citations"),
        F.when(open_, F.coalesce("n_insights", F.lit(0))).otherwise(0).cast("long").alias("n_insights"), F.coalesce(F.slice("names", 1, 3), nothing).alias("closest_concepts"), F.coalesce("focus", nothing).alias("focus"), "matched_entities",
    )


def explanations(asked: DataFrame, candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """question_id, entity_reasons, evidence_reasons, reasoning_path, sections, signals: how an answer came about."""
    shown = ordered(rows)
    n = candidates.groupBy("question_id").agg(F.count("*").alias("n_candidates"))
    size = shown.groupBy("question_id").agg(F.count("*").alias("n_evidence"))
    top = distinct_snippets(shown, 5).groupBy("question_id").agg(F.count("*").alias("n_top"), F.array_sort(F.collect_set("section")).alias("sections"))
    out = planned(asked)
    for part in (n, size, top):
        out = out.join(part.hint("merge"), "question_id", "left")
    number = lambda x: F.coalesce(x, F.lit(0)).cast("string")
    directions = F.lit(None).cast("string")
    for which, said in S.TRAVERSAL_DIRECTIONS.items():
        directions = F.when(c("intent") == which, said).otherwise(directions)
    values = {"hints": F.array_join(F.slice("entity_hints", 1, 4), ", "), "candidates": number("n_candidates"), "intent": c("intent"), "evidence": number("n_evidence"), "top": number("n_top"), "strategy": c("strategy"), "directions": directions}
    why = F.array(F.when(F.size("entity_hints") > 0, X.filled(S.ENTITY_REASONS[0], **values)), X.filled(S.ENTITY_REASONS[1], **values))
    because = F.array(X.filled(S.EVIDENCE_REASONS[0], **values), F.when(c("n_evidence") > 0, S.EVIDENCE_REASONS[1]))
    path = F.array(*[X.filled(step, **values) for step in S.REASONING_PATH])
    said = lambda x: F.filter(x, lambda r: r.isNotNull())
    return out.select("question_id", said(why).alias("entity_reasons"), said(because).alias("evidence_reasons"), path.alias("reasoning_path"), F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), F.array(*map(F.lit, S.SELECTION_SIGNALS)).alias("signals"))
