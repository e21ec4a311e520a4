"""Vocabularies and fixed rules of the data model. The values are fixed: results depend on them as they are."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------------------------------------------------

ENTITY_TYPES = ("Author", "Institution", "Concept", "Method", "Dataset", "Metric", "Task")
RELATION_TYPES = ("INTRODUCES", "USES", "EVALUATED_ON", "MEASURED_BY", "MENTIONS", "WROTE", "AFFILIATED_WITH", "ABOUT")
ALLOWED_TRIPLES = (
    ("Method", "USES", "Concept"), ("Method", "USES", "Method"), ("Method", "USES", "Dataset"),
    ("Method", "EVALUATED_ON", "Task"), ("Method", "EVALUATED_ON", "Dataset"), ("Task", "MEASURED_BY", "Metric"),
    ("Author", "WROTE", "Document"), ("Author", "AFFILIATED_WITH", "Institution"),
    ("Document", "MENTIONS", "Concept"), ("Document", "MENTIONS", "Method"), ("Document", "MENTIONS", "Dataset"),
    ("Document", "MENTIONS", "Task"), ("Document", "MENTIONS", "Metric"),
    ("Document", "INTRODUCES", "Method"), ("Document", "INTRODUCES", "Concept"), ("Document", "ABOUT", "Task"),
    ("Concept", "USES", "Concept"), ("Method", "INTRODUCES", "Concept"), ("Dataset", "ABOUT", "Task"),
)
HEADINGS = (
    "Abstract", "Introduction", "Related Work", "Background", "Preliminaries", "Methods", "Methodology", "Method", "Model",
    "Model Architecture", "Architecture", "Approach", "Proposed Method", "Experiments", "Experimental Setup",
    "Experimental Results", "Results", "Results and Discussion", "Evaluation", "Discussion", "Analysis", "Ablation Study",
    "Conclusion", "Conclusions", "Conclusions and Future Work", "Future Work", "References", "Bibliography", "Appendix",
    "Appendices", "Acknowledgments", "Acknowledgements", "Supplementary Material",
)
STOP_NAMES = (
    "it", "this", "that", "these", "those", "the method", "this method", "the model", "this model", "the system", "this system",
    "the approach", "this approach", "the paper", "this paper", "our method", "our model", "the authors", "the results",
    "the data", "method", "model", "system", "approach", "paper", "result", "results", "data", "experiment", "experiments",
    "figure", "table", "section", "chapter",
)
QUESTION_STOPWORDS = (
    "what", "which", "where", "when", "why", "how", "the", "this", "that", "these", "those", "about", "from", "with", "into",
    "paper", "document", "show", "tell", "explain", "list", "for", "and", "are", "does", "using", "used",
)
GENERIC_SUFFIXES = ("model", "method", "approach", "architecture", "system", "framework")
ARTICLES = ("the", "a", "an")
CONFIDENCE_FLOORS = {"Method": 0.90, "Dataset": 0.78, "Concept": 0.84, "Metric": 0.84, "Paper": 0.88}
CLEANING_FLOOR, LINKING_FLOOR, ALIAS_FLOOR = 0.60, 0.90, 0.92
INTENT_TERMS = {
    "CITATION_BASIS": ("citation", "cited", "reference", "refs", "bibliography"),
    "METHOD_USAGE": ("method", "algorithm", "approach", "technique"),
    "PROBLEM": ("problem", "challenge", "limitation", "issue", "bottleneck"),
    "RELATION_LOOKUP": ("relation", "related", "connect", "link", "between", "equivalent", "trend"),
}
RELATION_HINTS = {
    "USES": ("use", "uses", "used", "utilize", "apply"),
    "IMPROVES": ("improve", "improves", "better", "outperform", "successful", "benefit"),
    "BASED_ON": ("based", "derived", "built on", "inspired"),
    "APPLIED_TO": ("applied", "application", "task", "used in"),
}
RELATION_WHITELIST = ("USES", "IMPROVES", "BASED_ON", "APPLIED_TO")
#: intent, strategy, citations first, least and most per candidate, added to max_evidence, depth
TRAVERSAL_PLANS = (
    ("METHOD_USAGE", "method_centered_scan", False, 2, 8, 0, 2),
    ("CITATION_BASIS", "citation_chain_priority", True, 3, 10, 1, 1),
    ("RELATION_LOOKUP", "relation_lookup_scan", False, 2, 7, 0, 2),
    ("PROBLEM", "problem_context_scan", False, 2, 6, 0, 1),
    ("SUMMARY", "broad_summary_sweep", False, 2, 6, 0, 1),
)
TRAVERSAL_DIRECTIONS = {"METHOD_USAGE": "outgoing, incoming", "CITATION_BASIS": "outgoing", "RELATION_LOOKUP": "outgoing, incoming", "PROBLEM": "outgoing", "SUMMARY": "outgoing"}
SECTION_WEIGHTS = {"abstract": 2.0, "conclusion": 1.2, "methods": 1.0, "results": 1.0, "discussion": 0.8, "references": -0.8}
#: intent, section, added to the section's weight
SECTION_ADJUSTMENTS = (
    ("METHOD_USAGE", "methods", 2.4), ("METHOD_USAGE", "abstract", -1.4), ("SUMMARY", "conclusion", 0.8),
    ("PROBLEM", "abstract", 0.8), ("PROBLEM", "discussion", 0.8), ("CITATION_BASIS", "references", 1.6),
    ("RELATION_LOOKUP", "results", 0.9), ("RELATION_LOOKUP", "methods", 0.9),
)
CITATION_FACTORS = {"CITATION_BASIS": 2.0, "METHOD_USAGE": 1.2, "RELATION_LOOKUP": 1.0, "SUMMARY": 0.9, "PROBLEM": 0.8}
ALIGNED_RELATIONS = {
    "METHOD_USAGE": (("method", "use", "implement"), 1.1),
    "PROBLEM": (("problem", "challenge", "limitation"), 1.1),
    "RELATION_LOOKUP": (("",), 0.8),
    "CITATION_BASIS": (("cite", "support", "reference"), 0.9),
}
#: Sentences of answers and explanations; what stands in braces is filled in.
ANSWER_TEXTS = {
    "SUMMARY": ("{node} and related concepts ({concepts}) are grounded by evidence from sections {sections}. Core evidence: {fact}", "{node} is grounded through relations ({relations}) with related concepts: {concepts}."),
    "METHOD_USAGE": ("Method usage is evidenced as {node} connects to {target} through {first}. Evidence: {fact}", "Method usage grounding shows {node} linked to {target} through {first}."),
    "PROBLEM": ("The problem framing centers on {node}. Supporting passage: {fact}", "The problem framing is grounded around {node} with relation pattern {relation}."),
    "CITATION_BASIS": ("Reference-grounded evidence for {node} was found: {fact}", "Reference evidence exists for {node}, but explicit citation labels were not available."),
    "RELATION_LOOKUP": ("Relation lookup shows {node} connected via {relation}. Evidence: {fact}", "Relation lookup found {node} connected through {relation}."),
}
CITED_TEXT = "This answer is based on citation-backed evidence for {node}: {labels}."
NOTHING_FOUND = "We couldn’t find strong supporting evidence for this question in your documents."
NOTHING_GROUNDED = "No grounded answer found in the current documents."
TARGET_UNKNOWN = "its linked context"
LIMITED = "limited evidence"
UNCERTAINTY_TEXTS = {
    "no_evidence": " Limited evidence is available for this answer.",
    "citation_missing": " Citation basis could not be verified because no citation links were found.",
    "weak_match": " This answer is based on limited evidence.",
}
KEY_POINTS = ("Primary cluster: {entity} - {relation} ({frequency} supports).", "Top insight: {insight}")
CLOSING_POINTS = {
    "RELATION_LOOKUP": "Relations are grouped by canonical entity and relation type.",
    "METHOD_USAGE": "Usage patterns prioritize repeated evidence and citation-backed clusters.",
    "SUMMARY": "Summary is grounded by the highest-importance evidence clusters.",
}
INSIGHT_TEXTS = {
    "COMMON_PATTERN": "{entity} most commonly appears with {relation} patterns.",
    "FREQUENT_RELATION": "{relation} relation is frequently observed across matched entities.",
    "CROSS_DOCUMENT_TREND": "{entity} {relation} trend repeats in {homes} documents.",
}
ENTITY_REASONS = ("Selected entities using query hints: {hints}.", "Candidate selection returned {candidates} graph entities for intent {intent}.")
EVIDENCE_REASONS = ("Traversal strategy '{strategy}' prioritized {directions} links.", "Evidence ranking prioritized entity mention, section weight, citation presence, confidence, and relation match.")
SELECTION_SIGNALS = (
    "entity_mention_match", "intent_section_priority", "citation_signal_weighted_by_intent", "relation_type_alignment", "confidence_weight",
    "duplicate_passage_penalty", "duplicate_document_penalty", "diversity_bonus",
)
REASONING_PATH = ("question_intent:{intent}", "candidate_entities:{candidates}", "evidence_candidates:{evidence}", "selected_top_evidence:{top}", "strategy:{strategy}")
INGEST_STAGES = ("uploaded", "parsing", "detecting_sections", "parsing_references", "extracting_semantics", "writing_graph", "completed", "failed")
BASE_NODES = ("Method", "Concept", "Dataset", "Metric", "Task", "Author", "Institution", "CanonicalEntity", "RelationInstance")
STRUCTURAL_NODES, EVIDENCE_NODES, CITATION_NODES = ("Document", "Section"), ("Passage", "Evidence"), ("ReferenceEntry", "InlineCitation")

# --- tables ---------------------------------------------------------------------------------------------------------

_s, _i, _d = T.StringType(), T.IntegerType(), T.DoubleType()
_strings = T.ArrayType(_s)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAGES = _struct(document_id=_s, page_number=_i, text=_s)
ENTITY_MENTION = _struct(type=_s, name=_s, canonical_name=_s, aliases=_strings, confidence=_d)
RELATION_MENTION = _struct(type=_s, source=_s, target=_s, confidence=_d)
EXTRACTION = T.StructType([T.StructField("entities", T.ArrayType(ENTITY_MENTION)), T.StructField("relations", T.ArrayType(RELATION_MENTION))])
QUESTIONS = T.StructType([*_struct(question_id=_s, question=_s, document_id=_s, node_types=_strings, max_evidence=_i), T.StructField("include_citations", T.BooleanType()), T.StructField("answer_mode", _s)])
CASES = T.StructType([
    *_struct(id=_s, document_id=_s, question=_s, expected_intent=_s, expected_entities=_strings, expected_sections=_strings),
    T.StructField("expected_citation_presence", T.BooleanType()), T.StructField("expected_keywords", _strings),
    T.StructField("expected_cross_document_hit", T.BooleanType()), T.StructField("expected_insight_presence", T.BooleanType()),
    T.StructField("case_type", _s), T.StructField("expected_no_link", T.BooleanType()), T.StructField("expects_alias_expansion", T.BooleanType()), T.StructField("should_not_answer", T.BooleanType()),
])
EXPECTED_CITATIONS = _struct(case_id=_s, expected_citation_labels=_strings, expected_reference_entry_ids=_strings, citation_match_mode=_s)
JOB_EVENTS = T.StructType([T.StructField("job_id", _s), T.StructField("ts", T.TimestampType()), T.StructField("stage", _s), T.StructField("document_id", _s), T.StructField("error", _s), T.StructField("details", T.MapType(_s, _s))])
