"""Queries of the grounded answers, over questions made from parts, with their SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph import schemas as S
from loomgraph.operators import graph_read as R
from loomgraph.operators import grounded as Q
from loomgraph.plans.graph_tables import KEY, GraphTables, c, cat, with_graph
from loomgraph.plans.structure_queries import flat
from loomgraph.sources.shared import written

QUERIES, ORACLES = {}, {}


class Grounded(GraphTables):
    """Questions and each stage of their answers. Stages that several others read are written once."""

    entities = cached_property(lambda self: written(super(Grounded, self).entities, "entities"))
    instances = cached_property(lambda self: written(super(Grounded, self).instances, "instances"))
    registry = cached_property(lambda self: written(super(Grounded, self).registry, "registry"))

    @cached_property
    def entity_documents(self) -> DataFrame:
        return written(R.entity_documents(self.relations, self.evidence_keys, self.passages))

    @property
    def questions(self) -> DataFrame:
        k, n = c("p_partkey"), c("p_name")
        said = F.when(k % 6 == 0, cat("How is the ", n, " method used?")).when(k % 6 == 1, cat("Which citation supports ", n, "?")).when(k % 6 == 2, cat("What problem does ", n, " solve for ", c("p_type"), "?")).when(k % 6 == 3, cat("What is the relation between ", n, " and ", c("p_brand"), "?")).when(k % 6 == 4, cat("Tell me about ", n)).otherwise(cat("Tell me about quantum zebras ", c("p_size")))
        none = F.lit(None)
        return self.raw("part").select(
            cat("q:", k).alias("question_id"), said.alias("question"), F.when(k % 7 == 0, cat("doc:", k)).alias("document_id"), F.when(k % 13 == 0, F.array(F.lit("Method"))).alias("node_types"),
            F.when(k % 10 == 0, none).otherwise(1 + k % 9).cast("int").alias("max_evidence"), (k % 5 != 0).alias("include_citations"), F.when(k % 11 == 0, "explore").alias("answer_mode"),
        )

    @cached_property
    def asked(self) -> DataFrame:
        return written(Q.interpret(Q.validate(self.questions)[0]))

    @cached_property
    def candidates(self) -> DataFrame:
        return written(Q.select_candidates(self.asked, self))

    @cached_property
    def found(self) -> DataFrame:
        reached = written(Q.reached_relations(self.relations, self.candidates), "reached-relations")  # where they are few no evidence moves
        rows = Q.evidence_rows(reached, self.evidence_by_document, self.passages, self.documents, self.citations, self.references)
        return written(Q.collect_evidence(self.candidates, Q.planned(self.asked), rows))

    @cached_property
    def ranked(self) -> DataFrame:
        return written(Q.ranked(Q.relevant(self.found), self.asked, self.candidates))

    @cached_property
    def clustered(self) -> DataFrame:
        return written(Q.clustered(self.ranked))


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Grounded(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _case(key: str, values: dict[str, float], other: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {other}::DOUBLE END"


_HINTS = " ".join(f"CASE WHEN {_any('low', w)} THEN '{n}' END," for n, w in S.RELATION_HINTS.items()).rstrip(",")
_QUESTIONS = f"""
questions0 AS (
  SELECT 'q:' || p_partkey AS question_id, CASE p_partkey % 6 WHEN 0 THEN 'How is the ' || p_name || ' method used?' WHEN 1 THEN 'Which citation supports ' || p_name || '?' WHEN 2 THEN 'What problem does ' || p_name || ' solve for ' || p_type || '?'
    WHEN 3 THEN 'What is the relation between ' || p_name || ' and ' || p_brand || '?' WHEN 4 THEN 'Tell me about ' || p_name ELSE 'Tell me about quantum zebras ' || p_size END AS question,
    CASE WHEN p_partkey % 7 = 0 THEN 'doc:' || p_partkey END AS document_id, CASE WHEN p_partkey % 13 = 0 THEN ['Method'] ELSE [] END AS node_types, CASE WHEN p_partkey % 10 = 0 THEN 5 ELSE 1 + p_partkey % 9 END::INT AS max_evidence,
    p_partkey % 5 <> 0 AS include_citations, CASE WHEN p_partkey % 11 = 0 THEN 'explore' ELSE 'answer' END AS answer_mode FROM part),
q1 AS (SELECT *, lower(question) AS low, regexp_extract_all(lower(question), '[a-zA-Z0-9_]+') AS words FROM questions0),
q2 AS (
  SELECT *, CASE WHEN {_any('low', S.INTENT_TERMS['CITATION_BASIS'])} THEN 'CITATION_BASIS' WHEN regexp_matches(low, '\\bhow\\b.+\\buse[sd]?\\b') OR {_any('low', S.INTENT_TERMS['METHOD_USAGE'])} OR (contains(low, 'architecture') AND contains(low, 'how')) THEN 'METHOD_USAGE'
    WHEN {_any('low', S.INTENT_TERMS['PROBLEM'])} THEN 'PROBLEM' WHEN {_any('low', S.INTENT_TERMS['RELATION_LOOKUP'])} THEN 'RELATION_LOOKUP' ELSE 'SUMMARY' END AS intent,
    [h for h in [{_HINTS}] if h IS NOT NULL] AS relation_hints, [w for w in words if length(w) > 3 AND NOT list_contains({_list(S.QUESTION_STOPWORDS)}, w)][1:6] AS terms,
    list_concat([lower(p) for p in regexp_extract_all(question, '\\b([A-Z][a-zA-Z0-9_-]+(?:\\s+[A-Z][a-zA-Z0-9_-]+)*)\\b', 1)], [w for w in words if length(w) > 2 AND NOT list_contains({_list(S.QUESTION_STOPWORDS)}, w)]) AS said FROM q1),
asked AS (SELECT * EXCLUDE (said), [x for x, i in said if list_position(said, x) = i][1:10] AS entity_hints FROM q2)"""
_CAND = _QUESTIONS + f""",
tok AS (SELECT question_id, unnest(entity_hints) AS token FROM asked),
words_ AS (SELECT DISTINCT token FROM tok),
tu AS (SELECT DISTINCT w.token, e.uid FROM words_ w JOIN entities e ON contains(lower(e.name), w.token) AND length(w.token) >= 2),
hits AS (SELECT DISTINCT t.question_id, uid FROM tok t JOIN tu USING (token)),
ed AS (SELECT DISTINCT x.entity_uid, p.document_id FROM (SELECT source_uid AS entity_uid, uid FROM relations UNION SELECT target_uid, uid FROM relations) x JOIN evidence e ON e.relation_uid = x.uid JOIN passages p USING (passage_id)),
reach AS (SELECT entity_uid, document_id FROM ed UNION SELECT a.entity_uid, ed.document_id FROM instances a JOIN instances b USING (canonical_id) JOIN ed ON ed.entity_uid = b.entity_uid),
lc AS (
  SELECT h.question_id, e.uid AS entity_id, e.name, e.type, 1.0::DOUBLE AS score, 'name_match' AS reason, 'local' AS source, row_number() OVER (PARTITION BY h.question_id ORDER BY e.uid) AS pos
  FROM hits h JOIN asked a USING (question_id) JOIN entities e USING (uid) LEFT JOIN reach r ON r.entity_uid = e.uid AND r.document_id = a.document_id
  WHERE (len(a.node_types) = 0 OR list_contains(a.node_types, e.type)) AND (a.document_id IS NULL OR r.document_id IS NOT NULL)),
local_ AS (SELECT * FROM lc WHERE pos <= 20),
kt AS (SELECT DISTINCT question_id, {KEY('token')} AS token FROM tok),
kw AS (SELECT DISTINCT token FROM kt WHERE token <> ''),
kc AS (SELECT DISTINCT w.token, r.canonical_id FROM kw w JOIN registry r ON (contains(lower(r.canonical_name), w.token) AND length(w.token) >= 2) OR w.token = r.normalized_alias OR w.token = r.acronym),
dc AS (SELECT i.canonical_id, count(DISTINCT document_id) AS documents FROM instances i JOIN ed USING (entity_uid) GROUP BY 1),
cc AS (
  SELECT DISTINCT kt.question_id, i.entity_uid AS entity_id, r.canonical_name AS name, e.type, coalesce(dc.documents, 0) AS documents
  FROM kt JOIN kc USING (token) JOIN instances i USING (canonical_id) JOIN registry r USING (canonical_id) JOIN entities e ON e.uid = i.entity_uid LEFT JOIN dc USING (canonical_id)),
canonical_ AS (
  SELECT question_id, entity_id, name, type, greatest(0.8::DOUBLE, least(1.0::DOUBLE, 0.8::DOUBLE + documents * 0.02::DOUBLE)) AS score, 'canonical_linked_match' AS reason, 'canonical-ready' AS source, row_number() OVER (PARTITION BY question_id ORDER BY documents DESC, entity_id) + 20 AS pos FROM cc),
dens AS (
  SELECT r.source_uid AS uid, count(DISTINCT r.uid) AS n_relations, count(DISTINCT e.uid) AS n_evidence, coalesce(sum(s.citation_count), 0)::BIGINT AS n_citations
  FROM relations r JOIN evidence e ON e.relation_uid = r.uid LEFT JOIN (SELECT passage_id, count(DISTINCT citation_id) AS citation_count, 1 AS one FROM citations GROUP BY 1) s USING (passage_id) GROUP BY 1),
dens2 AS (SELECT r.source_uid AS uid, e.passage_id, count(*) AS n FROM relations r JOIN evidence e ON e.relation_uid = r.uid GROUP BY ALL),
dens3 AS (SELECT uid, sum(n)::BIGINT AS n_evidence, sum(coalesce((SELECT count(DISTINCT citation_id) FROM citations ci WHERE ci.passage_id = d.passage_id), 0))::BIGINT AS n_citations FROM dens2 d GROUP BY 1),
density AS (SELECT uid, (SELECT count(*) FROM relations r WHERE r.source_uid = d.uid) AS n_relations, n_evidence, n_citations FROM dens3 d),
need AS (SELECT question_id, intent = 'CITATION_BASIS' AS cited, array_to_string(node_types, ',') AS kinds, node_types FROM asked WHERE len(entity_hints) > 1 AND question_id NOT IN (SELECT question_id FROM local_)),
lists AS (
  SELECT k.cited, k.kinds, d.*, e.name, e.type, row_number() OVER (PARTITION BY k.cited, k.kinds ORDER BY CASE WHEN k.cited THEN n_citations ELSE n_evidence END DESC, n_relations DESC, n_evidence DESC, n_citations DESC, uid) AS pos
  FROM (SELECT DISTINCT cited, kinds, node_types FROM need) k JOIN density d ON true JOIN entities e USING (uid) WHERE len(k.node_types) = 0 OR list_contains(k.node_types, e.type)),
fallback_ AS (SELECT question_id, uid AS entity_id, name, type, (n_relations + n_evidence + n_citations)::DOUBLE AS score, 'graph_density_fallback' AS reason, 'local' AS source, pos FROM need JOIN lists USING (cited, kinds) WHERE pos <= 5),
every AS (SELECT * FROM local_ UNION ALL SELECT * FROM fallback_ UNION ALL SELECT * FROM canonical_ WHERE pos <= 40),
boost AS (
  SELECT c.* EXCLUDE (score, reason), len([t for t in a.terms if contains(lower(c.name), t)]) > 0 AS hit, CASE WHEN len([t for t in a.terms if contains(lower(c.name), t)]) > 0 THEN least(1.0::DOUBLE, score + 0.1::DOUBLE) ELSE score END AS score,
         CASE WHEN len([t for t in a.terms if contains(lower(c.name), t)]) > 0 THEN reason || '|disambiguation_context' ELSE reason END AS reason FROM every c JOIN asked a USING (question_id)),
mg AS (SELECT *, min(pos) OVER (PARTITION BY question_id, entity_id) AS spot, row_number() OVER (PARTITION BY question_id, entity_id ORDER BY CASE WHEN source = 'canonical-ready' THEN 0 ELSE 1 END, score DESC, pos) AS k FROM boost),
kd AS (SELECT *, row_number() OVER (PARTITION BY question_id, coalesce(nullif({KEY('name')}, ''), entity_id) ORDER BY score DESC, spot, entity_id) AS kk FROM mg WHERE k = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, spot, entity_id) AS rank FROM kd WHERE kk = 1),
candidates AS (SELECT question_id, entity_id, name, type, score, reason, source, rank FROM rk WHERE rank <= 20)"""
_PLAN = " ".join(f"WHEN '{i}' THEN greatest({lo}, least(max_evidence + {more}, {hi}))" for i, _, _, lo, hi, more, _ in S.TRAVERSAL_PLANS)
_EVID = _CAND + f""",
plans AS (SELECT *, CASE intent {_PLAN} END AS per_candidate, intent = 'CITATION_BASIS' AS citations_first, CASE WHEN intent IN ('METHOD_USAGE', 'RELATION_LOOKUP') THEN 2 ELSE 1 END AS depth FROM asked),
rows_ AS (
  SELECT r.source_uid, r.target_uid, r.uid AS relation_uid, e.uid AS evidence_uid, r.type AS relation_type, p.page_number AS page, substr(p.text, 1, 360) AS snippet, p.section_title AS section, r.confidence, p.document_id, d.title AS document_name, ci.label AS citation_label, rf.reference_id AS reference_entry_id, ci.citation_id
  FROM evidence e JOIN relations r ON r.uid = e.relation_uid LEFT JOIN passages p USING (passage_id) LEFT JOIN documents_ d ON d.document_id = p.document_id LEFT JOIN citations ci ON ci.passage_id = e.passage_id LEFT JOIN references_ rf ON rf.reference_id = ci.reference_id),
hop1 AS (SELECT *, source_uid AS start, 1 AS hop FROM rows_),
mid AS (SELECT DISTINCT source_uid AS start, target_uid AS middle FROM rows_ WHERE source_uid <> target_uid),
hop2 AS (SELECT r.*, m.start, 2 AS hop FROM mid m JOIN rows_ r ON r.source_uid = m.middle),
ask AS (SELECT c.question_id, c.rank, c.entity_id AS start, c.name AS entity_name, p.document_id AS scope, p.citations_first, p.per_candidate, p.depth, p.max_evidence FROM candidates c JOIN plans p USING (question_id)),
free AS (
  SELECT *, row_number() OVER (PARTITION BY start, hop ORDER BY confidence DESC, evidence_uid, citation_id NULLS FIRST) AS plain, row_number() OVER (PARTITION BY start, hop ORDER BY citation_id IS NULL, confidence DESC, evidence_uid, citation_id NULLS FIRST) AS cites FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)),
tied AS (
  SELECT *, row_number() OVER (PARTITION BY start, hop, document_id ORDER BY confidence DESC, evidence_uid, citation_id NULLS FIRST) AS plain, row_number() OVER (PARTITION BY start, hop, document_id ORDER BY citation_id IS NULL, confidence DESC, evidence_uid, citation_id NULLS FIRST) AS cites FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)),
got AS (
  SELECT a.*, f.* EXCLUDE (start) FROM ask a JOIN (SELECT * FROM free WHERE plain <= 10 OR cites <= 10) f ON f.start = a.start AND f.hop <= a.depth WHERE a.scope IS NULL
  UNION ALL SELECT a.*, f.* EXCLUDE (start) FROM ask a JOIN (SELECT * FROM tied WHERE plain <= 10 OR cites <= 10) f ON f.start = a.start AND f.hop <= a.depth AND f.document_id = a.scope),
pl AS (SELECT *, CASE WHEN citations_first THEN cites ELSE plain END AS place, trim(regexp_replace(lower(snippet), '\\s+', ' ', 'g')) AS said FROM got),
d1 AS (SELECT *, row_number() OVER (PARTITION BY question_id, relation_uid, evidence_uid, said ORDER BY rank, hop, place) AS k FROM pl WHERE place <= per_candidate),
d2 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, hop, place) AS pos FROM d1 WHERE k = 1),
found AS (SELECT question_id, pos, start AS entity_id, entity_name, relation_uid, evidence_uid, relation_type, page, snippet, said, section, confidence, document_id, document_name, citation_label, reference_entry_id FROM d2 WHERE pos <= max_evidence)"""
_WEIGHT = _case("lower(trim(section))", S.SECTION_WEIGHTS, 0.0) + "".join(f" + CASE WHEN intent = '{i}' AND lower(trim(section)) = '{s}' THEN {v}::DOUBLE ELSE 0 END" for i, s, v in S.SECTION_ADJUSTMENTS)
_ALIGN = " + ".join(f"CASE WHEN intent = '{i}' AND {_any('lower(relation_type)', w)} THEN {b}::DOUBLE ELSE 0 END" for i, (w, b) in S.ALIGNED_RELATIONS.items())
_RANK = _EVID + f""",
wl AS (SELECT *, list_contains({_list(S.RELATION_WHITELIST)}, upper(relation_type)) AS ok, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, pos) AS sure FROM found),
wa AS (SELECT *, bool_or(ok) OVER (PARTITION BY question_id) AS any_ok FROM wl),
wk AS (SELECT * EXCLUDE (pos), CASE WHEN any_ok THEN pos ELSE sure END AS pos FROM wa WHERE (any_ok AND ok) OR (NOT any_ok AND sure <= 2)),
ww AS (SELECT *, count(*) FILTER (WHERE confidence < 0.55) OVER (PARTITION BY question_id, upper(relation_type) ORDER BY pos) AS weak FROM wk),
relevant AS (SELECT * FROM ww WHERE confidence >= 0.55 OR weak <= 2),
nm AS (SELECT question_id, list(lower(name)) AS names FROM candidates GROUP BY 1),
fe AS (SELECT r.*, a.intent, a.relation_hints, a.max_evidence, a.include_citations, nm.names, lower(trim(coalesce(r.document_id, document_name, ''))) AS home, citation_label IS NOT NULL OR reference_entry_id IS NOT NULL AS cited FROM relevant r JOIN asked a USING (question_id) JOIN nm USING (question_id)),
ff AS (SELECT *, count(*) OVER (PARTITION BY question_id, said) AS copies, count(*) OVER (PARTITION BY question_id, home) AS from_home FROM fe),
sc AS (
  SELECT *, round(CASE WHEN len([n for n in names if contains(lower(snippet), n)]) > 0 THEN 2.0::DOUBLE ELSE 0 END + {_WEIGHT} + CASE WHEN cited THEN 1.4::DOUBLE * {_case('intent', S.CITATION_FACTORS, 1.0)} ELSE 0 END + 1.8::DOUBLE * greatest(0, least(1, confidence))
    + CASE WHEN len([h for h in relation_hints if contains(lower(relation_type), h)]) > 0 THEN 1.5::DOUBLE ELSE 0 END + {_ALIGN} + CASE WHEN lower(section) <> 'unknown' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN home <> '' THEN 0.2::DOUBLE ELSE 0 END
    - CASE WHEN copies > 1 THEN least(3.0::DOUBLE, 2.2::DOUBLE + 0.6::DOUBLE * (copies - 2)) ELSE 0 END - CASE WHEN from_home > 1 AND home <> '' THEN least(1.0::DOUBLE, 0.35::DOUBLE * (from_home - 1)) ELSE 0 END, 6) AS score FROM ff),
rr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos) AS rank FROM sc),
ranked AS (SELECT * FROM rr WHERE rank <= max_evidence)"""
_CLUS = _RANK + """,
c0 AS (SELECT *, upper(relation_type) AS relation, concat_ws('::', trim(regexp_replace(lower(trim(entity_name)), '\\s+', ' ', 'g')), upper(relation_type), said[1:72]) AS cluster_key FROM ranked),
c1 AS (SELECT *, row_number() OVER (PARTITION BY question_id, cluster_key, said ORDER BY rank) AS ck FROM c0),
c2 AS (SELECT * FROM c1 WHERE ck = 1),
cl AS (SELECT question_id, cluster_key, arg_min(entity_name, rank) AS entity, min(relation) AS relation, count(*) AS frequency, sum(cited::INT)::BIGINT AS cites, count(DISTINCT coalesce(document_name, document_id))::INT AS homes, min(rank) AS first_rank FROM c2 GROUP BY ALL),
c3 AS (SELECT *, round_even(least(1.0::DOUBLE, 0.2::DOUBLE * frequency + 0.1::DOUBLE * cites), 2) AS importance FROM cl),
clusters AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY importance DESC, frequency DESC, first_rank) AS cluster_rank FROM c3),
good AS (SELECT * FROM clusters WHERE (homes >= 2 OR frequency >= 2) AND importance >= 0.45 AND (cites >= 1 OR frequency >= 2)),
i0 AS (
  SELECT question_id, 'COMMON_PATTERN' AS type, entity || ' most commonly appears with ' || relation || ' patterns.' AS text, round_even(least(0.95::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * frequency), 2) AS confidence, 1::BIGINT AS supports, 1 AS kind, cluster_rank AS spot FROM good WHERE frequency >= 2
  UNION ALL SELECT question_id, 'FREQUENT_RELATION', relation || ' relation is frequently observed across matched entities.', round_even(least(0.9::DOUBLE, 0.45::DOUBLE + 0.08::DOUBLE * count(*)), 2), count(*), 2, min(cluster_rank) FROM good GROUP BY question_id, relation HAVING count(*) >= 2
  UNION ALL SELECT question_id, 'CROSS_DOCUMENT_TREND', entity || ' ' || lower(relation) || ' trend repeats in ' || homes || ' documents.', round_even(least(0.95::DOUBLE, 0.55::DOUBLE + 0.1::DOUBLE * homes), 2), 1, 3, cluster_rank FROM good WHERE frequency >= 2 AND homes >= 2),
i1 AS (SELECT *, row_number() OVER (PARTITION BY question_id, lower(trim(text)) ORDER BY confidence DESC, kind, spot) AS k FROM i0 WHERE confidence >= 0.55),
i2 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, kind, spot) AS insight_rank FROM i1 WHERE k = 1),
insights AS (SELECT question_id, type, text, confidence, supports, insight_rank FROM i2 WHERE insight_rank <= 5),
shown AS (SELECT e.*, k.cluster_rank, k.importance, k.cites AS cluster_cites, row_number() OVER (PARTITION BY e.question_id ORDER BY k.importance DESC, k.cites DESC, e.confidence DESC, k.cluster_rank, e.rank) AS shown FROM c2 e JOIN clusters k USING (question_id, cluster_key)),
ci0 AS (SELECT *, row_number() OVER (PARTITION BY question_id, citation_label, reference_entry_id ORDER BY shown) AS k2 FROM shown WHERE cited AND include_citations),
cites_ AS (SELECT question_id, coalesce(citation_label, 'citation') AS label, reference_entry_id, page, document_name, row_number() OVER (PARTITION BY question_id ORDER BY shown) AS place FROM ci0 WHERE k2 = 1)"""
_ANS = _CLUS + """,
names_ AS (SELECT question_id, list(name ORDER BY rank) AS names, bool_and(contains(lower(reason), 'fallback')) AS only_fallback FROM candidates GROUP BY 1),
ne AS (SELECT question_id, count(*) AS n FROM shown GROUP BY 1), nc AS (SELECT question_id, count(*) AS k FROM cites_ GROUP BY 1), im AS (SELECT question_id, avg(importance) AS imp FROM clusters GROUP BY 1),
ni AS (SELECT question_id, count(*) AS i FROM insights GROUP BY 1),
a0 AS (SELECT a.*, names, only_fallback, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(imp, 0) AS imp, coalesce(i, 0) AS i FROM asked a LEFT JOIN names_ USING (question_id) LEFT JOIN ne USING (question_id) LEFT JOIN nc USING (question_id) LEFT JOIN im USING (question_id) LEFT JOIN ni USING (question_id)),
a1 AS (SELECT *, len([t for t in list_concat([w for w in words if length(w) > 2], [h for h in entity_hints if length(h) >= 3]) if len([m for m in names if contains(lower(m), t)]) > 0]) > 0 AS anchored FROM a0),
a2 AS (SELECT *, CASE WHEN names IS NULL THEN 'no_candidates' WHEN answer_mode = 'answer' AND intent = 'SUMMARY' AND only_fallback AND NOT coalesce(anchored, false) THEN 'weak_fallback' WHEN answer_mode = 'answer' AND n = 0 THEN 'no_evidence' END AS gate,
  CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round_even(round(100 * least(1.0::DOUBLE, 0.45::DOUBLE * least(1.0::DOUBLE, n / 5.0::DOUBLE) + 0.35::DOUBLE * imp + 0.20::DOUBLE * least(1.0::DOUBLE, k / greatest(1, n)::DOUBLE)), 9), 0) / 100 END AS conf FROM a1)"""
_ANSWERS = """SELECT question_id, intent, gate, CASE WHEN gate IS NULL THEN conf ELSE 0 END::DOUBLE AS confidence, CASE WHEN gate IS NOT NULL OR conf < 0.3 THEN 'NO_GROUNDING' WHEN conf >= 0.65 THEN 'GROUNDED' ELSE 'WEAK_GROUNDING' END AS badge,
  CASE WHEN gate IS NOT NULL THEN 'no_evidence_hard_gate' WHEN n = 0 THEN 'no_evidence' WHEN intent = 'CITATION_BASIS' AND k = 0 THEN 'citation_missing' WHEN n < 2 OR conf < 0.45 THEN 'weak_match' END AS uncertainty_reason,
  CASE WHEN gate IS NULL THEN n ELSE 0 END AS n_evidence, CASE WHEN gate IS NULL THEN k ELSE 0 END AS n_citations, CASE WHEN gate IS NULL THEN i ELSE 0 END AS n_insights, array_to_string(coalesce(names[1:3], []), '|') AS closest_concepts FROM a2"""


def _filled(template: str, **names: str) -> str:
    """The template as an SQL expression; names in braces become columns."""
    parts = [names.get(p[1:-1], p[1:-1]) if p.startswith("{") else "'" + p.replace("'", "''") + "'" for p in re.split(r"(\{\w+\})", template) if p]
    return " || ".join(parts)


_TEXT = " ".join(f"WHEN intent = '{i}' AND fact <> '' THEN {_filled(a)} WHEN intent = '{i}' THEN {_filled(b)}" for i, (a, b) in S.ANSWER_TEXTS.items())
_TEXTS = _ANS + f""",
t0 AS (SELECT *, row_number() OVER (PARTITION BY question_id, said ORDER BY shown) AS k3 FROM shown),
t1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY shown) AS top FROM t0 WHERE k3 = 1),
tops AS (
  SELECT question_id, arg_min(relation_type, top) AS first, list(trim(snippet) ORDER BY top) AS snippets, array_to_string(list_sort(list(DISTINCT relation_type)), ', ') AS relations_, array_to_string(list_sort(list(DISTINCT section))[1:3], ', ') AS sections_,
    array_to_string(list_sort(list(DISTINCT citation_label) FILTER (citation_label IS NOT NULL))[1:4], ', ') AS labels FROM t1 WHERE top <= 3 GROUP BY 1),
lead_ AS (SELECT question_id, {_filled(S.KEY_POINTS[0])} AS lead FROM clusters WHERE cluster_rank = 1), first_i AS (SELECT question_id, text AS insight FROM insights WHERE insight_rank = 1),
a3 AS (
  SELECT a2.*, coalesce([s for s in snippets if s <> ''][1], '') AS fact, names[1] AS node, coalesce(names[2], '{S.TARGET_UNKNOWN}') AS target, array_to_string(names[1:3], ', ') AS concepts, sections_ AS sections, relations_ AS relations, coalesce(nullif(relations_, ''), first) AS relation,
    first, coalesce(labels, '') AS labels, lead, insight, CASE WHEN gate IS NOT NULL THEN 'gated' WHEN n = 0 THEN 'no_evidence' WHEN intent = 'CITATION_BASIS' AND k = 0 THEN 'citation_missing' WHEN n < 2 OR conf < 0.45 THEN 'weak_match' END AS why
  FROM a2 LEFT JOIN tops USING (question_id) LEFT JOIN lead_ USING (question_id) LEFT JOIN first_i USING (question_id)),
a4 AS (SELECT *, CASE WHEN n = 0 THEN '{S.NOTHING_FOUND}' WHEN intent = 'CITATION_BASIS' AND labels <> '' THEN {_filled(S.CITED_TEXT)} {_TEXT} END AS said_ FROM a3),
f0 AS (
  SELECT question_id, entity_id AS id, rank AS spot FROM candidates UNION ALL SELECT question_id, entity_id, 1000 + 3 * shown FROM shown UNION ALL SELECT question_id, relation_uid, 1001 + 3 * shown FROM shown UNION ALL SELECT question_id, reference_entry_id, 1002 + 3 * shown FROM shown),
f1 AS (SELECT question_id, id, min(spot) AS spot FROM f0 WHERE id IS NOT NULL GROUP BY ALL), focus_ AS (SELECT question_id, array_to_string(list(id ORDER BY spot), '|') AS focus FROM f1 WHERE question_id IN (SELECT question_id FROM candidates) GROUP BY 1)
SELECT question_id, CASE WHEN gate IS NOT NULL THEN '{S.NOTHING_GROUNDED}' ELSE said_ || CASE WHEN why = 'citation_missing' THEN '{S.UNCERTAINTY_TEXTS['citation_missing']}' WHEN contains(lower(said_), '{S.LIMITED}') THEN '' WHEN why = 'no_evidence' THEN '{S.UNCERTAINTY_TEXTS['no_evidence']}'
    WHEN why = 'weak_match' THEN '{S.UNCERTAINTY_TEXTS['weak_match']}' ELSE '' END END AS answer,
  CASE WHEN gate IS NOT NULL THEN '' ELSE array_to_string([p for p in [lead, {_filled(S.KEY_POINTS[1])}, CASE intent {" ".join(f"WHEN '{i}' THEN '{t}'" for i, t in S.CLOSING_POINTS.items())} END] if p IS NOT NULL], '|') END AS key_points, coalesce(focus, '') AS focus
FROM a4 LEFT JOIN focus_ USING (question_id)"""
_STRATEGY = "CASE intent " + " ".join(f"WHEN '{p[0]}' THEN '{p[1]}'" for p in S.TRAVERSAL_PLANS) + " END"
_DIRECTIONS = "CASE intent " + " ".join(f"WHEN '{i}' THEN '{d}'" for i, d in S.TRAVERSAL_DIRECTIONS.items()) + " END"
_WHY = _CLUS + f""",
t0 AS (SELECT *, row_number() OVER (PARTITION BY question_id, said ORDER BY shown) AS k3 FROM shown), t1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY shown) AS top FROM t0 WHERE k3 = 1),
t2 AS (SELECT question_id, count(*) AS n_top, array_to_string(list_sort(list(DISTINCT section)), '|') AS sections FROM t1 WHERE top <= 5 GROUP BY 1), nv AS (SELECT question_id, count(*) AS n_ev FROM shown GROUP BY 1), nq AS (SELECT question_id, count(*) AS n_c FROM candidates GROUP BY 1),
x AS (SELECT a.*, coalesce(n_c, 0) AS candidates, coalesce(n_ev, 0) AS evidence, coalesce(n_top, 0) AS top, coalesce(sections, '') AS sections, array_to_string(entity_hints[1:4], ', ') AS hints, {_STRATEGY} AS strategy, {_DIRECTIONS} AS directions FROM asked a LEFT JOIN nq USING (question_id) LEFT JOIN nv USING (question_id) LEFT JOIN t2 USING (question_id))
SELECT question_id, array_to_string([r for r in [CASE WHEN len(entity_hints) > 0 THEN {_filled(S.ENTITY_REASONS[0])} END, {_filled(S.ENTITY_REASONS[1])}] if r IS NOT NULL], '|') AS entity_reasons,
  array_to_string([r for r in [{_filled(S.EVIDENCE_REASONS[0])}, CASE WHEN evidence > 0 THEN '{S.EVIDENCE_REASONS[1]}' END] if r IS NOT NULL], '|') AS evidence_reasons, array_to_string([{", ".join(_filled(p) for p in S.REASONING_PATH)}], '|') AS reasoning_path, sections, '{"|".join(S.SELECTION_SIGNALS)}' AS signals FROM x"""



def sql(ctes: str, select: str) -> str:
    return with_graph("").rstrip() + "," + ctes + " " + select


# --- queries


@query(sql(_QUESTIONS, "SELECT max_evidence, answer_mode, count(*) AS n FROM asked GROUP BY ALL"))
def qry01_validated(t: Grounded) -> DataFrame:
    rows = t.questions.unionByName(t.questions.withColumns({"question": F.lit(" ")})).unionByName(t.questions.withColumn("max_evidence", F.lit(21)))
    return Q.validate(rows)[0].groupBy("max_evidence", "answer_mode").agg(F.count("*").alias("n"))


@query(sql(_QUESTIONS, "SELECT question_id, intent, array_to_string(entity_hints, '|') AS entity_hints, array_to_string(relation_hints, '|') AS relation_hints, array_to_string(terms, '|') AS terms, array_to_string(entity_hints, '|') AS tokens FROM asked"))
def qry02_interpreted(t: Grounded) -> DataFrame:
    return flat(t.asked.select("question_id", "intent", "entity_hints", "relation_hints", "terms", "tokens"), "entity_hints", "relation_hints", "terms", "tokens")


@query("SELECT conv_id, turn, array_to_string([w for w in regexp_extract_all(lower(text), '[a-zA-Z0-9_]+') if length(w) > 2], '|') AS tokens FROM conversations WHERE role = 'user'")
def qry02_question_tokens(t: Grounded) -> DataFrame:
    rows = t.raw("conversations").where("role = 'user'")
    return flat(rows.select("conv_id", "turn", X.question_tokens(c("text")).alias("tokens")), "tokens")


@query(sql(_CAND, "SELECT question_id, entity_id, name, type, score, pos::INT AS pos FROM local_"))
def qry07_local_candidates(t: Grounded) -> DataFrame:
    return Q.local_candidates(t.asked, t.entities, t.entity_documents, t.instances).select("question_id", "entity_id", "name", "type", "score", "pos")


@query(sql(_CAND, "SELECT question_id, entity_id, name, round_even(score, 6) AS score, pos::INT AS pos FROM canonical_ WHERE pos <= 40"))
def qry09_canonical_candidates(t: Grounded) -> DataFrame:
    rows = Q.canonical_candidates(t.asked, t.entities, t.entity_documents, t.instances, t.registry)
    return rows.select("question_id", "entity_id", "name", F.bround("score", 6).alias("score"), "pos")


@query(sql(_CAND, "SELECT question_id, entity_id, score, pos::INT AS pos FROM fallback_"))
def qry10_fallbacks(t: Grounded) -> DataFrame:
    local = Q.local_candidates(t.asked, t.entities, t.entity_documents, t.instances)
    return Q.fallback_candidates(t.asked, local, t.entities, Q.density(t.relations, t.evidence_keys, t.citations)).select("question_id", "entity_id", "score", "pos")


@query(sql(_CAND, "SELECT question_id, entity_id, name, type, round_even(score, 6) AS score, reason, source, rank::INT AS rank FROM candidates"))
def qry14_candidates(t: Grounded) -> DataFrame:
    return t.candidates.withColumn("score", F.bround("score", 6)).select("question_id", "entity_id", "name", "type", "score", "reason", "source", "rank")


@query(sql(_EVID, "SELECT question_id, per_candidate::INT AS per_candidate, citations_first, depth FROM plans"))
def qry15_plans(t: Grounded) -> DataFrame:
    return Q.planned(t.asked).select("question_id", "per_candidate", "citations_first", "depth")


@query(sql(_EVID, "SELECT question_id, pos::INT AS pos, entity_id, relation_uid, evidence_uid, section, confidence, citation_label FROM found"))
def qry20_evidence(t: Grounded) -> DataFrame:
    return t.found.select("question_id", "pos", "entity_id", "relation_uid", "evidence_uid", "section", "confidence", "citation_label")


@query(sql(_RANK, "SELECT question_id, pos::INT AS pos, evidence_uid, confidence FROM relevant"))
def qry22_relevant(t: Grounded) -> DataFrame:
    return Q.relevant(t.found).select("question_id", "pos", "evidence_uid", "confidence")


@query(sql(_RANK, "SELECT question_id, evidence_uid, relation_uid, round_even(score, 5) AS score, rank::INT AS rank FROM ranked"))
def qry28_ranked(t: Grounded) -> DataFrame:
    return t.ranked.select("question_id", "evidence_uid", "relation_uid", F.bround("score", 5).alias("score"), "rank")


@query(sql(_CLUS, "SELECT question_id, cluster_key, entity, relation, frequency, cites, homes, importance, cluster_rank::INT AS cluster_rank FROM clusters"))
def qry30_clusters(t: Grounded) -> DataFrame:
    return Q.clusters(t.clustered).drop("first_rank")


@query(sql(_CLUS, "SELECT question_id, cluster_key FROM good"))
def qry31_reliable(t: Grounded) -> DataFrame:
    return Q.reliable(Q.clusters(t.clustered)).select("question_id", "cluster_key")


@query(sql(_CLUS, "SELECT question_id, type, text, confidence, supports, insight_rank::INT AS insight_rank, CASE WHEN confidence >= 0.7 AND count(*) FILTER (WHERE confidence >= 0.7) OVER (PARTITION BY question_id ORDER BY insight_rank) <= 3 THEN 'primary' ELSE 'deferred' END AS \"group\" FROM insights"))
def qry35_insights(t: Grounded) -> DataFrame:
    return Q.insight_groups(Q.insights(Q.clusters(t.clustered)))


@query(sql(_CLUS, "SELECT question_id, evidence_uid, cluster_key, shown::INT AS shown FROM shown"))
def qry37_ordered(t: Grounded) -> DataFrame:
    return Q.ordered(t.clustered).select("question_id", "evidence_uid", "cluster_key", "shown")


@query(sql(_CLUS, "SELECT question_id, label, reference_entry_id, page, document_name, place::INT AS place FROM cites_"))
def qry42_citations(t: Grounded) -> DataFrame:
    shown = Q.ordered(t.clustered).join(t.asked.select("question_id", "include_citations"), "question_id")
    return Q.citations(shown)


@query(sql(_ANS, _ANSWERS))
def qry43_answers(t: Grounded) -> DataFrame:
    out = flat(Q.answers(t.asked, t.candidates, t.clustered), "closest_concepts")
    return out.select("question_id", "intent", "gate", "confidence", "badge", "uncertainty_reason", "n_evidence", "n_citations", "n_insights", "closest_concepts")


@query(sql(_TEXTS, ""))
def qry39_answer_texts(t: Grounded) -> DataFrame:
    return flat(Q.answers(t.asked, t.candidates, t.clustered), "closest_concepts", "key_points", "focus").select("question_id", "answer", "key_points", "focus")


@query(sql(_WHY, ""))
def qry47_explanations(t: Grounded) -> DataFrame:
    return flat(Q.explanations(t.asked, t.candidates, t.clustered), "entity_reasons", "evidence_reasons", "reasoning_path", "sections", "signals")
