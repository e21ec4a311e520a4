"""Entity resolution of mentions against a registry of canonical entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schemas as S
from loomgraph.functions import text as X
from loomgraph.operators.identity import floor_of

LINKABLE = tuple(S.CONFIDENCE_FLOORS)
MOST_CANDIDATES = 25


def linkable(mentions: DataFrame) -> DataFrame:
    return mentions.where(F.col("type").isin(*LINKABLE))


def gate(mentions: DataFrame) -> DataFrame:
    """mentions (mention_id, type, name, aliases, confidence) with key, alias_keys, and whether they may be linked."""
    keys = F.array_distinct(F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), X.match_key), lambda k: k != ""))
    may = F.col("type").isin(*LINKABLE) & (F.col("confidence") >= floor_of(F.col("type"), S.LINKING_FLOOR))
    return mentions.withColumns({"key": X.match_key(F.col("name")), "alias_keys": keys, "may_link": may})


def blocks(registry: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """type, kind, block, canonical_id: of each blocking key the few smallest ids. No mention looks at more, so a key that a large share of the
    registry offers is cut where its rows are, before any join."""
    tag = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("block")))
    acronyms = F.when(F.col("entity_type") != "Paper", F.transform("acronyms", F.lower)).otherwise(F.array().cast("array<string>"))
    known = registry.where(F.col("canonical_id").startswith(F.concat(F.lit("canonical_"), F.lower("entity_type"), F.lit(":"))))
    offers = F.explode(F.array_distinct(F.concat(tag("name", F.array("normalized_name")), tag("other", "normalized_aliases"), tag("other", acronyms))))
    offered = known.select(F.col("entity_type").alias("type"), "canonical_id", offers.alias("offer")).select("type", "offer.kind", "offer.block", "canonical_id")
    nth = F.dense_rank().over(Window.partitionBy("type", "kind", "block").orderBy("canonical_id"))
    return offered.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def candidates(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Pairs of gated mentions and registry rows that share a blocking key.

    A registry row offers its name, its aliases and (for papers not) its acronyms; a mention asks for its name among all
    three, and for its aliases among aliases and acronyms. Exploding both makes the lookup an equi-join; an OR of conditions
    would compare everything with everything. Keys meet ids only, 25 a key; what is known of an id joins the 25 that a mention keeps."""
    tag = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("block")))
    asks = F.explode(F.array_distinct(F.concat(tag("name", F.array("key")), tag("other", F.array("key")), tag("other", "alias_keys"))))
    asked = mentions.where("may_link").select("mention_id", "type", asks.alias("ask")).select("mention_id", "type", "ask.kind", "ask.block")
    met = asked.join(blocks(registry), ["type", "kind", "block"]).select("mention_id", "canonical_id").distinct()
    nth = F.row_number().over(Window.partitionBy("mention_id").orderBy("canonical_id"))
    kept = met.withColumn("nth", nth).where(F.col("nth") <= MOST_CANDIDATES).drop("nth")
    known = registry.select("canonical_id", "normalized_name", "normalized_aliases", "acronyms", F.col("canonical_name").alias("known_name"), F.col("aliases").alias("known_aliases"))
    return mentions.join(kept, "mention_id").join(known, "canonical_id").dropDuplicates(["mention_id", "canonical_id"])


def expands(short: Column, long: Column) -> Column:
    """Whether the initials of a long name begin with an acronym."""
    return (F.length(short) >= 2) & X.initials(long).startswith(F.upper(short)) & (F.size(F.split(long, " ")) > 1)


def scored(pairs: DataFrame) -> DataFrame:
    """pairs with score and reason: the first rule that holds."""
    low = F.transform("acronyms", F.lower)
    key, name = F.col("key"), F.col("normalized_name")
    rules = (
        (key == name, 0.99, "normalized_exact_match"),
        (F.array_contains("normalized_aliases", key), 0.94, "normalized_alias_match"),
        (F.arrays_overlap("normalized_aliases", "alias_keys") | F.array_contains("alias_keys", name), 0.90, "normalized_alias_match"),
        (F.array_contains(low, F.lower("name")) | F.array_contains(low, key), 0.92, "acronym_expansion_match"),
        (F.array_contains("acronyms", X.acronym(F.col("name"))), 0.91, "acronym_expansion_match"),
        (F.lower(X.acronym(name)) == key, 0.88, "acronym_expansion_match"),
        (expands(F.col("name"), name) | expands(name, F.col("name")), 0.90, "acronym_expansion_match"),
    )
    score, reason = F.lit(0.0), F.lit(None).cast("string")
    for holds, points, why in reversed(rules):
        score, reason = F.when(holds, points).otherwise(score), F.when(holds, F.lit(why)).otherwise(reason)
    return pairs.withColumns({"score": score, "reason": reason})


def accepted(pairs: DataFrame) -> DataFrame:
    """The best pair of each mention whose score reaches its type's floor; of equals, the smaller id."""
    best = Window.partitionBy("mention_id").orderBy(F.desc("score"), "canonical_id")
    ok = scored(pairs).where(F.col("score") >= floor_of(F.col("type"), S.LINKING_FLOOR))
    return ok.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def canonical_id(entity_type: Column, name: Column) -> Column:
    return F.concat(F.lit("canonical_"), F.lower(entity_type), F.lit(":"), X.slug(X.match_key(name)))


def link(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """mention_id, type, name, confidence, canonical_id, matched, score, reason, and what it would teach the registry."""
    gated = gate(mentions)
    hits = accepted(candidates(gated, registry)).select("mention_id", F.col("canonical_id").alias("hit"), "score", "reason", "known_name", "known_aliases")
    out = gated.join(hits, "mention_id", "left")
    matched = F.col("hit").isNotNull()
    why = F.when(matched, F.col("reason")).when(F.col("may_link"), "new_canonical_no_match").otherwise("new_canonical_low_confidence_or_unsupported_type")
    learns = matched & (F.col("score") >= S.ALIAS_FLOOR) & F.col("reason").isin("normalized_exact_match", "normalized_alias_match")
    canonical = F.coalesce("known_name", "name")
    # the payload: a sure link brings the canonical's own aliases along
    own = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a != "")
    names = F.array_union(merge_aliases(own, F.coalesce("known_aliases", F.array().cast("array<string>")), F.coalesce("score", F.lit(0.0))), F.array("name", canonical))
    keys = F.filter(F.array_distinct(F.transform(names, X.match_key)), lambda k: k != "")
    acronyms = F.filter(F.array_distinct(F.transform(F.array("name", canonical), lambda n: F.lower(X.acronym(n)))), lambda a: a.isNotNull())
    return out.select(
        "mention_id", "type", "name", "confidence", F.when(matched, F.col("hit")).otherwise(canonical_id(F.col("type"), F.col("name"))).alias("canonical_id"), matched.alias("matched"), "score", why.alias("reason"),
        learns.alias("learns_aliases"), F.array_sort(names).alias("new_aliases"), F.array_sort(keys).alias("new_alias_keys"), F.array_sort(acronyms).alias("new_acronyms"),
    )


def merge_aliases(old: Column, new: Column, confidence: Column) -> Column:
    """Sorted union of aliases, if the mention is sure enough."""
    return F.array_sort(F.when(confidence >= S.ALIAS_FLOOR, F.array_union(old, new)).otherwise(old))


def upsert_registry(registry: DataFrame, links: DataFrame) -> DataFrame:
    """The next registry: new canonicals with all they bring; known ones with aliases if they may learn and acronyms always."""
    teach = ~F.col("matched") | F.col("learns_aliases")
    none = F.array().cast("array<string>")
    tag = lambda kind, names: F.transform(F.coalesce(names, none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    new = F.concat(tag("alias", F.when(teach, F.col("new_aliases"))), tag("key", F.when(teach, F.col("new_alias_keys"))), tag("acronym", F.col("new_acronyms")))
    # distinct before they are gathered: a hot canonical's lists are as long as its different names, not as its mentions
    taught = links.select("canonical_id", F.explode(new).alias("n")).select("canonical_id", "n.*").distinct()
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("name")))
    lists = taught.groupBy("canonical_id").agg(of("alias").alias("add_aliases"), of("key").alias("add_keys"), of("acronym").alias("add_acronyms"))
    gained = links.groupBy("canonical_id").agg(F.min(F.struct("mention_id", "type", "name")).alias("x")).join(lists, "canonical_id", "left")
    rows = registry.join(gained, "canonical_id", "full")
    both = lambda old, new: F.array_sort(F.array_union(F.coalesce(old, none), F.coalesce(new, none)))
    name = F.coalesce("canonical_name", "x.name")
    return rows.select("canonical_id", F.coalesce("entity_type", "x.type").alias("entity_type"), name.alias("canonical_name"), F.coalesce("normalized_name", X.match_key(F.col("x.name"))).alias("normalized_name"), both("aliases", "add_aliases").alias("aliases"), both("normalized_aliases", "add_keys").alias("normalized_aliases"), both("acronyms", "add_acronyms").alias("acronyms"))


def instance_edges(links: DataFrame, registry: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_uid, canonical_id: each once, where both exist."""
    edges = links.select(F.col("entity_uid"), "canonical_id").distinct()
    return edges.join(registry.select("canonical_id"), "canonical_id", "left_semi").join(entities.select(F.col("uid").alias("entity_uid")), "entity_uid", "left_semi").select("entity_uid", "canonical_id")
