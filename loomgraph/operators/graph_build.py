"""Keyed upserts of the graph's tables. A plain file has no MERGE: each is a grouping whose result is the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.sources.shared import written


def first_written(rows: DataFrame, key: str) -> DataFrame:
    """Create-only nodes (documents, passages, sections): what was written first under a key stays."""
    values = [c for c in rows.columns if c not in (key, "seq")]
    return rows.groupBy(key).agg(F.min_by(F.struct(*values), "seq").alias("x")).select(key, "x.*")


def edges(rows: DataFrame, source: str, target: str, kind: str, *carried: str, by: str | None = None) -> DataFrame:
    """source, target, type and carried columns of an edge, each once. Where the rows lie by a column that an edge has one value of (``by``),
    repeats go where they are."""
    at = [F.col(by).alias("lies_by")] if by else []
    found = rows.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(*at, F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("type"), *carried).distinct()
    return found.drop("lies_by") if by else found


def upsert_references(rows: DataFrame) -> DataFrame:
    """Reference entries: the last write counts, but the order stays as first written."""
    values = [c for c in rows.columns if c not in ("reference_id", "order", "seq")]
    out = rows.groupBy("reference_id").agg(F.max_by(F.struct(*values), "seq").alias("x"), F.min_by("order", "seq").alias("order"))
    return out.select("reference_id", "order", "x.*")


def upsert_entities(rows: DataFrame) -> DataFrame:
    """Entities (uid, type, name, aliases, confidence, seq): first name, all aliases, last confidence."""
    out = rows.groupBy("uid").agg(F.min_by("type", "seq").alias("type"), F.min_by("name", "seq").alias("name"), F.max_by("confidence", "seq").alias("confidence"))
    # distinct before they are gathered: a hot entity's list is as long as its different aliases, not as its mentions
    aliases = rows.select("uid", F.explode("aliases").alias("alias")).distinct().groupBy("uid").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return out.join(aliases, "uid", "left").select("uid", "type", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "confidence")


def with_endpoints(rows: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relation mentions both of whose ends are entities, and those skipped for want of one. The different ends that aren't entities are
    found first: they are fewer than the mentions, which meet them where they are if they are few."""
    ends = rows.select(F.explode(F.array("source_uid", "target_uid")).alias("uid")).where("uid is not null").distinct()
    missing = written(ends.join(entities.select("uid"), "uid", "left_anti"), "missing-ends")
    kept = rows.where("source_uid is not null and target_uid is not null")
    for end in ("source_uid", "target_uid"):
        kept = kept.join(missing.withColumnRenamed("uid", end), end, "left_anti")
        rows = rows.join(missing.select(F.col("uid").alias(end), F.lit(True).alias(f"no_{end}")), end, "left")
    skipped = rows.where("source_uid is null or target_uid is null or no_source_uid or no_target_uid").drop("no_source_uid", "no_target_uid")
    return kept, skipped


def upsert_relations(kept: DataFrame) -> DataFrame:
    """uid, type, source_uid, target_uid, confidence of each relation instance; the last confidence counts."""
    rows = kept.withColumn("uid", X.relation_uid(F.col("type"), F.col("source_uid"), F.col("target_uid")))
    return rows.groupBy("uid").agg(F.first("type").alias("type"), F.first("source_uid").alias("source_uid"), F.first("target_uid").alias("target_uid"), F.max_by("confidence", "seq").alias("confidence"))


def upsert_evidence(kept: DataFrame, citations: DataFrame, *by: str) -> DataFrame:
    """One evidence per relation and passage, with the passage's citation summary. Where mentions and summaries lie by columns that a passage
    has one value of (``by``), they are grouped and joined where they are, and keep these columns."""
    rows = kept.withColumn("relation_uid", X.relation_uid(F.col("type"), F.col("source_uid"), F.col("target_uid")))
    out = rows.groupBy(*by, "passage_id", "relation_uid").agg(F.max_by("confidence", "seq").alias("confidence")).join(citations, [*by, "passage_id"], "left")
    return out.select(*by, X.evidence_uid(F.col("relation_uid"), F.col("passage_id")).alias("uid"), "relation_uid", "passage_id", "confidence", F.coalesce("citation_count", F.lit(0)).cast("long").alias("citation_count"), F.coalesce("citation_labels", F.array().cast("array<string>")).alias("citation_labels"))


def evidence_mentions(kept: DataFrame, *by: str) -> DataFrame:
    """relation_uid, passage_id (and ``by``) of each mention: :func:`evidence_keys` with repeats, for reads to which they do no harm."""
    return kept.select(*by, X.relation_uid(F.col("type"), F.col("source_uid"), F.col("target_uid")).alias("relation_uid"), "passage_id")


def evidence_keys(kept: DataFrame, *by: str) -> DataFrame:
    """uid, relation_uid, passage_id (and ``by``) of what :func:`upsert_evidence` gives, for reads that don't ask what it says: no
    confidence is looked for, no citation joined."""
    rows = evidence_mentions(kept, *by).distinct()
    return rows.select(*by, X.evidence_uid(F.col("relation_uid"), F.col("passage_id")).alias("uid"), "relation_uid", "passage_id")


def endpoint_types(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """rows (name) with the type of the entity of that canonical name, Concept where there is none."""
    types = entities.groupBy("name").agg(F.min("type").alias("type"))
    return rows.join(types, "name", "left").withColumn("type", F.coalesce("type", F.lit("Concept")))


def split_by_passage(citations: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations whose passage exists, and those to report as unlinked. Where both tell their document, they are joined by that too."""
    on = [x for x in ("document_id", "passage_id") if x in citations.columns and x in passages.columns]
    return citations.join(passages, on, "left_semi"), citations.join(passages, on, "left_anti")


def upsert_refers_to(links: DataFrame, citations: DataFrame, references: DataFrame) -> DataFrame:
    """citation_id, reference_id, confidence: where both exist, the last confidence."""
    rows = links.join(citations, "citation_id", "left_semi").join(references, "reference_id", "left_semi")
    return rows.groupBy("citation_id", "reference_id").agg(F.max_by("confidence", "seq").alias("confidence"))


def write_counts(**tables: DataFrame) -> DataFrame:
    """name, n for each table written."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that are not unique, with how often they stand."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def effective_confidence(evidence: DataFrame) -> DataFrame:
    """relation_uid, max_confidence, avg_confidence, n_evidence. Confidences are added up to six decimals as decimals, so that the
    average doesn't depend on the order of the rows."""
    total = F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double")
    return evidence.groupBy("relation_uid").agg(F.max("confidence").alias("max_confidence"), (total / F.count("confidence")).alias("avg_confidence"), F.count("*").alias("n_evidence"))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame, lies: bool = False) -> dict[str, DataFrame]:
    """The next snapshot without the documents ``gone`` and their sections, passages and evidence. Entities stay. Evidence that tells its
    document goes by that too. Where it and the passages lie by document in parts that a task holds (``lies``), neither is sorted to be joined."""
    out = {n: tables[n].join(gone, "document_id", "left_anti") for n in ("documents", "sections", "passages")}
    on = [c for c in ("document_id", "passage_id") if c in tables["evidence"].columns]
    lost = tables["passages"].join(gone, "document_id", "left_semi").select(*on)
    out["evidence"] = tables["evidence"].join(lost.hint("shuffle_hash") if lies else lost, on, "left_anti")
    # each relation once before it moves
    out["relations"] = tables["relations"].join(out["evidence"].select(F.col("relation_uid").alias("uid")).distinct(), "uid", "left_semi")
    return out | {"entities": tables["entities"]}


def orphan_entities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities at neither end of a relation."""
    ends = relations.select(F.explode(F.array("source_uid", "target_uid")).alias("uid")).distinct()
    return entities.join(ends, "uid", "left_anti")
