"""Quality measures of answers against labelled cases. One wide table per case, then rates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS_AT = 0.7


def lowered(a: Column) -> Column:
    return F.transform(a, lambda x: F.lower(x))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 1 where nothing was expected."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def citations_match(expected: Column, got: Column, mode: Column) -> Column:
    """Strict: all expected are there; lenient: any; true where none is expected."""
    return F.when(F.size(expected) == 0, True).when(mode == "strict", F.size(F.array_except(expected, got)) == 0).otherwise(F.arrays_overlap(expected, got))


def measure(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases joined to answers (id, intent, entities, sections, text, n_evidence, labels, documents, n_insights, insight_scores,
    cluster_importance, cited_share, linked, precision_hits), with one column per measure."""
    rows = cases.join(answers, "id")
    c = F.col
    low = F.lower("text")
    keywords = F.filter("expected_keywords", lambda k: low.contains(F.lower(k)))
    entities = F.array_intersect(lowered(c("expected_entities")), lowered(c("entities")))
    linked = F.size(F.array_distinct("entities"))
    rows = rows.withColumns({
        "intent_ok": c("intent") == c("expected_intent"),
        "evidence_ok": c("n_evidence") > 0,
        "citation_ok": (F.size("labels") > 0) == c("expected_citation_presence"),
        "expectation_ok": citations_match(c("expected_citation_labels"), c("labels"), c("citation_match_mode")),
        "section_ok": (F.size("expected_sections") == 0) | F.arrays_overlap(lowered(c("expected_sections")), lowered(c("sections"))),
        "keyword_ratio": share(F.size(keywords), F.size("expected_keywords")),
        "entity_recall": share(F.size(entities), F.size(F.array_distinct(lowered(c("expected_entities"))))),
        "canonical_precision": F.when(linked == 0, 0.0).otherwise(F.size(entities) / linked),
        "reuse_rate": F.when(F.size("entities") == 0, 0.0).otherwise(linked / F.size("entities")),
        "cross_document_ok": (F.size(F.array_distinct("documents")) > 1) == c("expected_cross_document_hit"),
        "no_link_ok": F.when(c("expected_no_link"), linked == 0),
        "false_positive": F.when(c("expected_no_link"), linked > 0),
        "alias_ok": F.when(c("expects_alias_expansion"), F.arrays_overlap(lowered(c("expected_entities")), lowered(c("entities")))),
        "insight_ok": (F.size("insight_scores") > 0) == c("expected_insight_presence"),
        "insight_correct": F.when(F.size("insight_scores") > 0, F.forall("insight_scores", lambda s: s >= 0.55)),
        "cluster_quality": F.least(F.lit(1.0), 0.6 * c("cluster_importance") + 0.4 * c("cited_share")),
    })
    rows = rows.withColumn("hallucinated", F.when(c("should_not_answer"), c("n_evidence") > 0))
    checks = ("intent_ok", "evidence_ok", "citation_ok", "expectation_ok", "section_ok", "cross_document_ok", "insight_ok")
    points = sum((c(x).cast("int") for x in checks), (c("keyword_ratio") >= 0.5).cast("int"))
    rows = rows.withColumn("score", points / F.lit(len(checks) + 1))
    return rows.withColumn("passed", F.when(c("should_not_answer"), ~c("hallucinated")).otherwise(c("score") >= PASS_AT))


RATES = ("intent_ok", "evidence_ok", "citation_ok", "expectation_ok", "section_ok", "keyword_ratio", "entity_recall", "canonical_precision", "reuse_rate", "cross_document_ok", "no_link_ok", "false_positive", "alias_ok", "insight_ok", "insight_correct", "cluster_quality", "hallucinated", "passed")


def rates(measured: DataFrame) -> DataFrame:
    """Means of all measures for each case type and, with a null type, for all cases."""
    return measured.rollup("case_type").agg(F.count("*").alias("cases"), *[F.avg(F.col(r).cast("double")).alias(r) for r in RATES])
