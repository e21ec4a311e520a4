"""Queries of the structure and source operators on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import structure as D
from loomgraph.plans.chunk_sql import chunks
from loomgraph.sources import loaders as L
from loomgraph.sources.shared import written


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages for each text: the text under a heading, a page of short sections, and a page of references in one of
    three styles. Texts without lines that are headings or citations themselves would leave the operators idle."""
    docs = L.table(spark, sf_dir, "documents")
    n, year = F.col("doc_id").cast("string"), (2000 + F.col("doc_id") % 20).cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    one = cat("Abstract\n", F.coalesce("text", F.lit("")), "\nEarlier work [1] and [2, 3] agree (Smith et al., ", year, ").")
    two = cat("3.1 Methods\nWe follow [4-2] and (Doe and Roe, 2011; Smith, ", year, ").\nResults\nGains are shown in [9].\nRESULTS\nNo (aside 1999) here.")
    mark = lambda k: F.when(F.col("doc_id") % 3 == 0, cat(f"[{k}] ")).when(F.col("doc_id") % 3 == 1, cat(f"{k}. ")).otherwise(F.lit(""))
    gap = F.when(F.col("doc_id") % 3 == 2, "\n\n").otherwise("\n")
    three = cat("IV Discussion\nA short note.\nReferences\n", mark(1), "Smith, J. A study of topic number ", n, ". Journal, ", year, ".", gap, mark(2), "Doe, A. Another study of the topic. Venue, 2011.", gap, mark(3), "Roe.", gap, mark(4), "Poe et al. 1998")
    rows = docs.select(F.concat(F.lit("doc:"), n).alias("document_id"), F.explode(F.array(F.struct(F.lit(1).alias("page_number"), one.alias("text")), F.struct(F.lit(2).alias("page_number"), two.alias("text")), F.struct(F.lit(3).alias("page_number"), three.alias("text")))).alias("p"))
    return rows.select("document_id", "p.*")


def flat(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({a: F.array_join(a, "|") for a in arrays})


def page_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("document_id", F.concat_ws(":", "document_id", "page_number").alias("passage_id"), "text")


def doc01_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sections(pages(spark, sf_dir)).drop("section_id")


def doc05_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.references_boundary(D.sections(pages(spark, sf_dir)))


def doc06_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.section_bodies(pages(spark, sf_dir)).select("document_id", "ordinal", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("n_chars"), "is_body")


def doc08_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.passages(pages(spark, sf_dir)).select("passage_id", "document_id", "index", "ordinal", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def doc08_sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "documents").select("doc_id", "text")
    return D.sliding_chunks(docs).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


def doc11_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reference_entries(pages(spark, sf_dir)).drop("reference_id", "entry_number")


def doc19_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(D.inline_citations(page_passages(spark, sf_dir)).drop("citation_id"), "keys", "labels")


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # both are read several times: by their keys, and by what joins the links
    citations, references = written(D.inline_citations(page_passages(spark, sf_dir)), "citations"), written(D.reference_entries(pages(spark, sf_dir)), "references")
    return citations, references, D.citation_links(citations, references)


def doc24_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations, references, links = _links(spark, sf_dir)
    out = links.join(citations, ["citation_id", "document_id"]).join(references, ["reference_id", "document_id"])
    return out.select("document_id", "passage_id", "start_char", "order", "confidence")


def doc26_link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.link_summary(*_links(spark, sf_dir))


def doc27_ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations, references, links = _links(spark, sf_dir)
    found = pages(spark, sf_dir)
    return D.ingestion_report(found, {"n_sections": D.sections(found), "n_references": references, "n_citations": citations, "n_links": links})


def doc27_passage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the passages, with the citations in them."""
    found = pages(spark, sf_dir)
    passages = D.passages(found)
    return D.ingestion_report(found, {"n_sections": D.sections(found), "n_passages": passages, "n_citations": D.inline_citations(passages)})


def doc28_raw_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("document_id"), "text")
    return D.raw_passages(docs).select("passage_id", "document_id", "index", F.length("text").alias("n_chars"))


def src01_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.text_hashes(L.table(spark, sf_dir, "documents")).select("doc_id", "file_hash")


def src02_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pages of their source's document; every fifth is blanked to be dropped."""
    docs = L.table(spark, sf_dir, "documents")
    found = docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), F.when(F.col("doc_id") % 5 == 0, " \n").otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("text"))
    return L.usable_pages(found).groupBy("document_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


def src03_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.text_hashes(L.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document_id"), "file_hash", F.col("doc_id").alias("arrival"))
    known = docs.where("document_id % 10 = 0")
    return L.mark_duplicates(docs.where("document_id % 10 <> 0"), known).select("document_id", "existing_id")


def src04_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.md5("text").alias("file_hash"), F.concat("lang", F.lit("-"), "doc_id").alias("file_name"), F.col("doc_id").alias("seq"))
    return L.upsert(docs.where("seq % 2 = 0"), docs.where("seq % 2 = 1"), ["document_id"], keep=("file_hash",))


def src05_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made of event rows: wrapped in text, or broken where the event is an error."""
    rows = L.table(spark, sf_dir, "events")
    body = F.format_string('Here it is: {"entities": [{"type": "Method", "name": "%s", "confidence": 0.9}], "relations": []} done', "event_type")
    rows = rows.select("event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), body)).otherwise(body).alias("payload"))
    got = L.parse_payloads(rows)
    return got.select("event_id", F.get("extraction.entities", 0)["name"].alias("name"), F.col("extraction").isNull().alias("quarantined"))


def src09_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.table(spark, sf_dir, "orders").select(F.concat(F.lit("doc:order:"), "o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit(".pdf"))).otherwise(" ").alias("file_name"), F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Order "), "o_orderkey")).alias("title"))
    return L.document_picker(docs)


_ALL = (doc01_sections, doc05_boundary, doc06_bodies, doc08_passages, doc08_sliding_chunks, doc11_references, doc19_citations, doc24_links, doc26_link_summary, doc27_ingestion_report, doc27_passage_report, doc28_raw_passages, src01_hashes, src02_pages, src03_duplicates, src04_metadata, src05_payloads, src09_picker)
QUERIES = {f.__name__: f for f in _ALL}

# --- SQL

_HEAD = "|".join(D.S.HEADINGS)
_PAGES = r"""
base AS (
  SELECT 'doc:' || doc_id AS document_id, doc_id % 3 AS style, (2000 + doc_id % 20)::VARCHAR AS y, doc_id, coalesce(text, '') AS text,
         CASE doc_id % 3 WHEN 2 THEN chr(10) || chr(10) ELSE chr(10) END AS gap FROM documents),
marked AS (SELECT *, CASE style WHEN 0 THEN ['[1] ', '[2] ', '[3] ', '[4] '] WHEN 1 THEN ['1. ', '2. ', '3. ', '4. '] ELSE ['', '', '', ''] END AS m FROM base),
pages AS (
  SELECT document_id, 1 AS page_number, 'Abstract' || chr(10) || text || chr(10) || 'Earlier work [1] and [2, 3] agree (Smith et al., ' || y || ').' AS text FROM marked
  UNION ALL
  SELECT document_id, 2, '3.1 Methods' || chr(10) || 'We follow [4-2] and (Doe and Roe, 2011; Smith, ' || y || ').' || chr(10) || 'Results' || chr(10) || 'Gains are shown in [9].' || chr(10) || 'RESULTS' || chr(10) || 'No (aside 1999) here.' FROM marked
  UNION ALL
  SELECT document_id, 3, 'IV Discussion' || chr(10) || 'A short note.' || chr(10) || 'References' || chr(10) || m[1] || 'Smith, J. A study of topic number ' || doc_id || '. Journal, ' || y || '.' || gap
         || m[2] || 'Doe, A. Another study of the topic. Venue, 2011.' || gap || m[3] || 'Roe.' || gap || m[4] || 'Poe et al. 1998' FROM marked)"""
_LINES = _PAGES + rf""",
lines0 AS (SELECT document_id, page_number, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM pages),
lines1 AS (SELECT *, regexp_matches(line, '^(?:\d+\.?\d*\.?\s+|[A-Z]\.?\s+|[IVXLCDM]+\s+)?(?:{_HEAD})\s*$', 'i') AS found FROM lines0),
lines AS (SELECT *, found AND row_number() OVER (PARTITION BY document_id, page_number, found, lower(trim(line)) ORDER BY pos) = 1 AS is_heading FROM lines1),
heads AS (SELECT *, trim(line) AS title, (row_number() OVER w - 1)::INT AS ordinal, lead(page_number) OVER w AS next_page FROM lines WHERE is_heading WINDOW w AS (PARTITION BY document_id ORDER BY page_number, pos)),
sections AS (
  SELECT document_id, title, greatest(1, len(list_filter(string_split(regexp_extract(title, '^(\d+(?:\.\d+)*)\.?\s', 1), '.'), lambda p: p <> '')))::INT AS level, ordinal, page_number AS page_start, coalesce(next_page, 3)::INT AS page_end FROM heads),
boundary AS (SELECT document_id, max(ordinal) AS boundary FROM sections WHERE regexp_replace(lower(trim(title)), '^\d+\.?\d*\.?\s*', '') IN ('references', 'bibliography') GROUP BY document_id)"""
_REFS = _LINES + r""",
block AS (SELECT p.document_id, regexp_replace(p.text, '(?is)^(?:.*\n)?\s*(?:\d+\.?\s*)?(?:References|Bibliography)\s*\n', '') AS block FROM pages p WHERE page_number = 3),
style AS (SELECT *, CASE WHEN len(regexp_extract_all(chr(10) || block, '\n\[\d+\]')) >= 2 THEN '^\[\d+\]' WHEN len(regexp_extract_all(chr(10) || block, '\n\d+\.\s')) >= 2 THEN '^\d+\.\s' END AS pat FROM block),
rl AS (SELECT document_id, pat, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS pos FROM style),
numbered AS (
  SELECT *, sum(CASE WHEN (pat IS NOT NULL AND regexp_matches(line, pat)) OR (pat IS NULL AND trim(line) = '') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos) - CASE WHEN pat IS NULL THEN 0 ELSE 1 END AS ord FROM rl),
entries AS (SELECT document_id, ord::INT AS "order", trim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(10)) AS raw_text FROM numbered WHERE ord >= 0 GROUP BY document_id, ord HAVING length(trim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(10))) >= 10),
refs AS (
  SELECT document_id, "order", raw_text, list_extract(regexp_extract_all(raw_text, '\b(?:19|20)\d{2}\b'), -1)::INT AS year,
         string_split(regexp_replace(raw_text, '^\[?\d+\]?\.\s*', ''), '.') AS parts,
         nullif(regexp_extract(raw_text, '([A-Z][A-Za-z''\-]+)(?:\s+et\s+al\.)?.{0,40}\b(?:19|20)\d{2}\b', 1), '') AS author_guess,
         coalesce(nullif(regexp_extract(raw_text, '^\s*(?:\[(\d+)\]|(\d+)\.)\s*', 1), ''), nullif(regexp_extract(raw_text, '^\s*(?:\[(\d+)\]|(\d+)\.)\s*', 2), ''), ("order" + 1)::VARCHAR)::BIGINT AS key_numeric
  FROM entries),
references_ AS (
  SELECT document_id, "order", raw_text, year, CASE WHEN len(parts) >= 3 AND length(trim(parts[2])) > 10 AND length(trim(parts[2])) < 300 THEN trim(parts[2]) END AS title_guess,
         author_guess, key_numeric, CASE WHEN author_guess IS NOT NULL AND year IS NOT NULL THEN lower(author_guess) || ':' || year END AS key_author_year FROM refs)"""
_CITES = _REFS + r""",
raw AS (
  SELECT document_id, document_id || ':' || page_number AS passage_id, text, 'numeric_bracket' AS style, regexp_extract_all(text, '\[(\s*\d+(?:\s*[-,]\s*\d+)*\s*)\]') AS found, regexp_split_to_array(text, '\[(?:\s*\d+(?:\s*[-,]\s*\d+)*\s*)\]') AS gaps FROM pages
  UNION ALL
  SELECT document_id, document_id || ':' || page_number, text, 'author_year', regexp_extract_all(text, '\(([^()]*\b(?:19|20)\d{2}\b[^()]*)\)'), regexp_split_to_array(text, '\((?:[^()]*\b(?:19|20)\d{2}\b[^()]*)\)') FROM pages),
cut AS (SELECT document_id, passage_id, style, found, gaps, unnest(found) AS raw_text, generate_subscripts(found, 1) AS k FROM raw),
placed AS (
  SELECT document_id, passage_id, style, raw_text, (list_sum([length(g) for g in gaps[1:k]]) + coalesce(list_sum([length(f) for f in found[1:k - 1]]), 0))::INT AS start_char, substr(raw_text, 2, length(raw_text) - 2) AS body FROM cut),
keyed AS (
  SELECT *, CASE WHEN style = 'numeric_bracket' THEN list_distinct(flatten([CASE WHEN contains(p, '-') THEN range(least(string_split(p, '-')[1]::INT, string_split(p, '-')[2]::INT), greatest(string_split(p, '-')[1]::INT, string_split(p, '-')[2]::INT) + 1) ELSE [trim(p)::BIGINT] END for p in string_split(body, ',')])) ELSE [] END AS nums,
    list_zip(regexp_extract_all(body, '([A-Z][A-Za-z''\-]+)(?:\s+et\s+al\.)?(?:\s+and\s+[A-Z][A-Za-z''\-]+)?\s*,\s*((?:19|20)\d{2})', 1), regexp_extract_all(body, '([A-Z][A-Za-z''\-]+)(?:\s+et\s+al\.)?(?:\s+and\s+[A-Z][A-Za-z''\-]+)?\s*,\s*((?:19|20)\d{2})', 2)) AS named FROM placed),
sorted AS (SELECT *, list_sort(nums) AS keys FROM keyed),
cites AS (
  SELECT document_id, passage_id, style, raw_text, start_char, start_char + length(raw_text) AS end_char, [k::VARCHAR for k in keys] AS keys,
         CASE WHEN style = 'numeric_bracket' THEN ['[' || k || ']' for k in keys] ELSE [lower(n[1]) || ':' || n[2] for n in named] END AS labels FROM sorted),
citations AS (SELECT * FROM cites WHERE len(labels) > 0)"""
_LINK = _CITES + """,
by_number AS (SELECT document_id, key_numeric::VARCHAR AS key, max("order") AS "order" FROM references_ GROUP BY ALL),
by_label AS (SELECT document_id, key_author_year AS key, max("order") AS "order" FROM references_ WHERE key_author_year IS NOT NULL GROUP BY ALL),
links AS (
  SELECT DISTINCT c.document_id, c.passage_id, c.start_char, r."order", 1.0::DOUBLE AS confidence FROM (SELECT *, unnest(keys) AS key FROM citations) c JOIN by_number r USING (document_id, key)
  UNION
  SELECT DISTINCT c.document_id, c.passage_id, c.start_char, r."order", 0.7::DOUBLE FROM (SELECT *, unnest(labels) AS key FROM citations WHERE len(keys) = 0) c JOIN by_label r USING (document_id, key))"""

_BODIES = _LINES + """,
o AS (SELECT *, (count(*) FILTER (WHERE is_heading) OVER (PARTITION BY document_id ORDER BY page_number, pos) - 1)::INT AS ordinal FROM lines),
bodies AS (SELECT document_id, ordinal, trim(string_agg(line, chr(10) ORDER BY page_number, pos)) AS body FROM o WHERE ordinal >= 0 AND NOT is_heading GROUP BY ALL),
texts AS (SELECT document_id || '#' || ordinal AS rid, document_id, ordinal, body AS text FROM bodies LEFT JOIN boundary USING (document_id) WHERE coalesce(ordinal < boundary, true))"""
_PASSAGES = _BODIES + ",\n" + chunks("texts", 1600, 200) + """,
passages AS (
  SELECT 'pass:' || md5(document_id || '|' || i)[:12] AS passage_id, document_id, i AS index, ordinal, chunk AS text FROM (
    SELECT document_id, ordinal, chunk, (row_number() OVER (PARTITION BY document_id ORDER BY ordinal, chunk_no) - 1)::INT AS i FROM chunks JOIN texts USING (rid)))"""
_PASSAGE_CITES = _PASSAGES + _CITES[len(_REFS) :].replace("document_id || ':' || page_number", "passage_id").replace("FROM pages", "FROM passages")
_RAW_TEXTS = "texts AS (SELECT 'doc:' || doc_id AS rid, coalesce(text, '') AS text FROM documents)"

ORACLES = {
    "doc08_passages": f"WITH RECURSIVE {_PASSAGES} SELECT passage_id, document_id, index, ordinal, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM passages",
    "doc27_passage_report": f"""WITH RECURSIVE {_PASSAGE_CITES} SELECT document_id, 3::BIGINT AS n_pages, (SELECT count(*) FROM sections s WHERE s.document_id = d.document_id) AS n_sections,
      (SELECT count(*) FROM passages s WHERE s.document_id = d.document_id) AS n_passages, (SELECT count(*) FROM citations s WHERE s.document_id = d.document_id) AS n_citations FROM base d""",
    "doc28_raw_passages": f"WITH RECURSIVE {_RAW_TEXTS}, {chunks('texts', 1600, 200)} SELECT 'pass:' || md5(rid || '|' || chunk_no)[:12] AS passage_id, rid AS document_id, chunk_no AS index, length(chunk)::INT AS n_chars FROM chunks",
    "doc01_sections": f"WITH {_LINES} SELECT * FROM sections",
    "doc05_boundary": f"WITH {_LINES} SELECT * FROM boundary",
    "doc06_bodies": f"""WITH {_LINES},
      o AS (SELECT *, (count(*) FILTER (WHERE is_heading) OVER (PARTITION BY document_id ORDER BY page_number, pos) - 1)::INT AS ordinal FROM lines),
      b AS (SELECT document_id, ordinal, trim(string_agg(line, chr(10) ORDER BY page_number, pos)) AS body FROM o WHERE ordinal >= 0 AND NOT is_heading GROUP BY ALL)
      SELECT document_id, ordinal, md5(body) AS body_md5, length(body)::BIGINT AS n_chars, coalesce(ordinal < boundary, true) AS is_body FROM b LEFT JOIN boundary USING (document_id)""",
    "doc08_sliding_chunks": """WITH n AS (SELECT doc_id, text, greatest(1, ceil((length(text) - 200) / 1400.0))::INT AS n FROM documents WHERE length(text) > 0),
      c AS (SELECT doc_id, text, unnest(range(n))::INT AS chunk_no FROM n) SELECT doc_id, chunk_no, md5(substr(text, chunk_no * 1400 + 1, 1600)) AS chunk_md5 FROM c""",
    "doc11_references": f"WITH {_REFS} SELECT * FROM references_",
    "doc19_citations": f"WITH {_CITES} SELECT document_id, passage_id, style, raw_text, start_char, end_char::INT AS end_char, array_to_string(keys, '|') AS keys, array_to_string(labels, '|') AS labels FROM citations",
    "doc24_links": f"WITH {_LINK} SELECT * FROM links",
    "doc26_link_summary": f"""WITH {_LINK}, a AS (SELECT document_id, count(*) AS citations FROM citations GROUP BY 1), b AS (SELECT document_id, count(*) AS "references" FROM references_ GROUP BY 1),
      c AS (SELECT document_id, count(*) AS links, count(DISTINCT (passage_id, start_char)) AS linked FROM links GROUP BY 1)
      SELECT document_id, citations, "references", coalesce(links, 0) AS links, citations - coalesce(linked, 0) AS unlinked FROM a JOIN b USING (document_id) LEFT JOIN c USING (document_id)""",
    "doc27_ingestion_report": f"""WITH {_LINK} SELECT document_id, 3::BIGINT AS n_pages, (SELECT count(*) FROM sections s WHERE s.document_id = d.document_id) AS n_sections, (SELECT count(*) FROM references_ s WHERE s.document_id = d.document_id) AS n_references,
      (SELECT count(*) FROM citations s WHERE s.document_id = d.document_id) AS n_citations, (SELECT count(*) FROM links s WHERE s.document_id = d.document_id) AS n_links FROM base d""",
    "src01_hashes": "SELECT doc_id, md5(text) AS file_hash FROM documents",
    "src02_pages": "SELECT source AS document_id, count(*) AS n_pages, sum(length(trim(text, ' ' || chr(10) || chr(9) || chr(13))))::BIGINT AS n_chars FROM documents WHERE doc_id % 5 <> 0 AND trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY 1",
    "src03_duplicates": """WITH h AS (SELECT doc_id, md5(text) AS file_hash FROM documents), k AS (SELECT file_hash, min(doc_id) AS id FROM h WHERE doc_id % 10 = 0 GROUP BY 1),
      a AS (SELECT *, min(doc_id) OVER (PARTITION BY file_hash) AS first_id FROM h WHERE doc_id % 10 <> 0)
      SELECT a.doc_id AS document_id, coalesce(k.id, CASE WHEN first_id <> doc_id THEN first_id END) AS existing_id FROM a LEFT JOIN k USING (file_hash)""",
    "src04_metadata": "SELECT source AS document_id, arg_min(md5(text), (doc_id % 2) * 1000000000000 + doc_id) AS file_hash, arg_max(lang || '-' || doc_id, doc_id) AS file_name, max(doc_id) AS seq FROM documents GROUP BY 1",
    "src05_payloads": "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS name, event_type = 'error' AS quarantined FROM events",
    "src09_picker": "SELECT 'doc:order:' || o_orderkey AS document_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || '.pdf' WHEN 1 THEN 'Order ' || o_orderkey ELSE CASE WHEN length('doc:order:' || o_orderkey) > 12 THEN substr('doc:order:' || o_orderkey, 1, 12) || '...' ELSE 'doc:order:' || o_orderkey END END AS display_name FROM orders",
}
