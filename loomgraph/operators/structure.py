"""Document structure over a table of pages: sections, bodies, chunks, references, citations and links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schemas as S
from loomgraph.functions import text as X

NUMBERING = r"(?:\d+\.?\d*\.?\s+|[A-Z]\.?\s+|[IVXLCDM]+\s+)?"
HEADING_LINE = rf"(?i)^{NUMBERING}(?:{X.any_of(S.HEADINGS)})\s*$"


def short_id(prefix: str, *parts: Column) -> Column:
    """An id that a repeated run makes again."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12))


def page_lines(pages: DataFrame) -> DataFrame:
    """document_id, page_number, pos, line, is_heading. A heading that repeats on its page counts once, as the first."""
    lines = pages.select("document_id", "page_number", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).where("line is not null")  # outer: a text is split once
    lines = lines.withColumn("found", F.col("line").rlike(HEADING_LINE))
    again = Window.partitionBy("document_id", "page_number", "found", F.lower(F.trim("line"))).orderBy("pos")
    # only heading lines need a rank; other lines share no key worth a window
    heads = lines.where("found").withColumn("nth", F.row_number().over(again)).withColumn("is_heading", F.col("nth") == 1)
    return lines.where("not found").select("document_id", "page_number", "pos", "line", F.lit(False).alias("is_heading")).unionByName(heads.select("document_id", "page_number", "pos", "line", "is_heading"))


def heading_level(title: Column) -> Column:
    """Number of dot-separated parts of a heading's numbering, at least 1."""
    number = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    return F.greatest(F.lit(1), F.size(F.filter(F.split(number, r"\."), lambda p: p != ""))).cast("int")


def sections(pages: DataFrame) -> DataFrame:
    """section_id, document_id, title, level, ordinal, page_start, page_end."""
    last = pages.groupBy("document_id").agg(F.max("page_number").alias("last_page"))
    order = Window.partitionBy("document_id").orderBy("page_number", "pos")
    heads = page_lines(pages).where("is_heading").withColumn("title", F.trim("line"))
    heads = heads.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int")).withColumn("next_page", F.lead("page_number").over(order))
    out = heads.join(last, "document_id")
    return out.select(short_id("sec:", F.col("document_id"), F.col("ordinal")).alias("section_id"), "document_id", "title", heading_level(F.col("title")).alias("level"), "ordinal", F.col("page_number").alias("page_start"), F.coalesce("next_page", "last_page").alias("page_end"))


def is_references(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(title)), r"^\d+\.?\d*\.?\s*", "").isin("references", "bibliography")


def references_boundary(found: DataFrame) -> DataFrame:
    """document_id, boundary: the ordinal of the last section that is a list of references."""
    return found.where(is_references(F.col("title"))).groupBy("document_id").agg(F.max("ordinal").alias("boundary"))


def section_bodies(pages: DataFrame) -> DataFrame:
    """document_id, ordinal, body, is_body: the lines between a heading and the next. Ordinal -1 stands for documents
    without headings, whose pages are their text; lines before a first heading belong to no section."""
    order = Window.partitionBy("document_id").orderBy("page_number", "pos")
    every = Window.partitionBy("document_id")
    lines = page_lines(pages).withColumn("ordinal", (F.count_if("is_heading").over(order) - 1).cast("int")).withColumn("heads", F.count_if("is_heading").over(every))
    # the lines hold the headings too: the boundary needs no second pass over the pages
    lines = lines.withColumn("boundary", F.max(F.when(F.col("is_heading") & is_references(F.col("line")), F.col("ordinal"))).over(every))
    lines = lines.where((F.col("ordinal") >= 0) | (F.col("heads") == 0)).where("not is_heading")
    said = F.array_sort(F.collect_list(F.struct("page_number", "pos", "line")))
    body = F.trim(F.array_join(F.transform(said, lambda x: x["line"]), "\n"))
    out = lines.groupBy("document_id", "ordinal").agg(body.alias("body"), F.first("boundary").alias("boundary"))
    return out.select("document_id", "ordinal", "body", F.coalesce(F.col("ordinal") < F.col("boundary"), F.lit(True)).alias("is_body"))


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> Iterator[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that does."""
    if len(text) <= size:
        yield text
        return
    mark, rest = separators[0], separators[1:]
    if not mark:
        yield from (text[i : i + size] for i in range(0, len(text), size))
    elif mark not in text:
        yield from _pieces(text, size, rest)
    else:
        parts = text.split(mark)
        for k, part in enumerate(parts):
            part += mark if k < len(parts) - 1 else ""
            if part:
                yield from _pieces(part, size, rest)


def chunk(text: str, size: int = 1600, overlap: int = 200) -> list[str]:
    """Greedy runs of pieces up to ``size``; each run begins with a tail of the one before, of at most ``overlap``."""
    out: list[str] = []
    run: list[str] = []
    held = fresh = 0
    for piece in _pieces(text, size, SEPARATORS):
        if held + len(piece) > size and fresh:
            out.append("".join(run).strip())
            while run and (held > overlap or held + len(piece) > size):
                held -= len(run.pop(0))
            fresh = 0
        run.append(piece)
        held += len(piece)
        fresh += 1
    if fresh:
        out.append("".join(run).strip())
    return [c for c in out if c]


def chunked(texts: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """The input's columns but ``text``, with chunk_no and chunk, for each chunk of each text."""
    kept = [f for f in texts.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "chunk_no int", "chunk string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["chunk"] = [chunk(t or "", size, overlap) for t in pdf.pop("text")]
            pdf["chunk_no"] = [list(range(len(c))) for c in pdf["chunk"]]
            yield pdf.explode(["chunk", "chunk_no"]).dropna(subset=["chunk"])[[*(f.name for f in kept), "chunk_no", "chunk"]]

    return texts.mapInPandas(run, schema)


def passages(pages: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """passage_id, document_id, index, ordinal, text: chunks of body sections, or of pages where there are none."""
    bodies = section_bodies(pages).where("is_body and ordinal >= 0").select("document_id", "ordinal", F.lit(0).alias("page_number"), F.col("body").alias("text"))
    whole = pages.join(sections(pages).select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit(-1).alias("ordinal"), "page_number", "text")
    found = chunked(bodies.unionByName(whole), size, overlap)
    order = Window.partitionBy("document_id").orderBy("ordinal", "page_number", "chunk_no")
    found = found.withColumn("index", (F.row_number().over(order) - 1).cast("int"))
    return found.select(short_id("pass:", F.col("document_id"), F.col("index")).alias("passage_id"), "document_id", "index", "ordinal", F.col("chunk").alias("text"))


def raw_passages(texts: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """Passages of a table of document_id and text that has no pages: page 0, numbered per document."""
    found = chunked(texts.select("document_id", "text"), size, overlap)
    return found.select(short_id("pass:", F.col("document_id"), F.col("chunk_no")).alias("passage_id"), "document_id", F.col("chunk_no").alias("index"), F.lit(0).alias("page_number"), F.col("chunk").alias("text"))


def sliding_chunks(texts: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """Fixed windows of ``size`` characters, each ``overlap`` into the one before: the variant that needs no Python."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(step))).cast("int")
    out = texts.where(F.length("text") > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("chunk", F.substring(F.col("text"), F.col("chunk_no") * step + 1, F.lit(size)))


# --- references


def reference_block(pages: DataFrame) -> DataFrame:
    """document_id, block: all pages from the boundary's on, without what stands up to the references heading."""
    at = sections(pages).where(is_references(F.col("title"))).groupBy("document_id").agg(F.max_by("page_start", "ordinal").alias("page_start"))
    rows = pages.join(at, "document_id").where("page_number >= page_start")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n")
    return rows.groupBy("document_id").agg(F.regexp_replace(text, r"(?is)^(?:.*\n)?\s*(?:\d+\.?\s*)?(?:References|Bibliography)\s*\n", "").alias("block"))


def reference_entries(pages: DataFrame) -> DataFrame:
    """reference_id, document_id, order, raw_text, year, title_guess, author_guess, key_numeric, entry_number, key_author_year."""
    block = F.concat(F.lit("\n"), F.col("block"))
    bracket, dotted = (F.split(block, rf"\n(?={p})") for p in (r"\[\d+\]", r"\d+\.\s"))
    blank = F.filter(F.split("block", r"\n\s*\n"), lambda e: F.trim(e) != "")
    numbered = lambda parts: F.slice(parts, F.lit(2), F.size(parts))  # noqa: E731  what stands before the first number is no entry
    entries = F.when(F.size(bracket) > 2, numbered(bracket)).when(F.size(dotted) > 2, numbered(dotted)).otherwise(blank)
    rows = reference_block(pages).select("document_id", F.posexplode_outer(entries).alias("order", "raw"))  # outer: the block is cut once
    rows = rows.withColumn("raw_text", F.btrim("raw", F.lit(" \n\r\t"))).where(F.length("raw_text") >= 10)
    raw, order = F.col("raw_text"), F.col("order")
    author, year = X.lead_author(raw), X.last_year(raw)
    return rows.select(short_id("ref:", F.col("document_id"), order).alias("reference_id"), "document_id", "order", "raw_text", year.alias("year"), X.title_guess(raw).alias("title_guess"), author.alias("author_guess"), X.numeric_key(raw, order).alias("key_numeric"), X.entry_number(raw, order).alias("entry_number"), X.author_year_key(author, year).alias("key_author_year"))


# --- citations


def inline_citations(found: DataFrame) -> DataFrame:
    """citation_id, document_id, passage_id, style, raw_text, start_char, end_char, keys, labels for a table of passages."""
    numeric = F.transform(X.matches_with_offsets(F.col("text"), X.NUMERIC_CITATION), lambda m: F.struct(F.lit("numeric_bracket").alias("style"), m["raw"].alias("raw"), m["start"].alias("start")))
    dated = F.transform(X.matches_with_offsets(F.col("text"), X.AUTHOR_YEAR_BLOCK), lambda m: F.struct(F.lit("author_year").alias("style"), m["raw"].alias("raw"), m["start"].alias("start")))
    # outer, as explode would look for matches twice: once to see whether there are any
    rows = found.select("document_id", "passage_id", F.explode_outer(F.concat(numeric, dated)).alias("c")).where("c is not null").select("document_id", "passage_id", "c.*")
    body = F.expr("substring(raw, 2, length(raw) - 2)")
    keys = F.when(F.col("style") == "numeric_bracket", X.expand_keys(body)).otherwise(F.array().cast("array<string>"))
    labels = F.when(F.col("style") == "author_year", X.label_keys(body)).otherwise(F.transform(keys, lambda k: F.concat(F.lit("["), k, F.lit("]"))))
    rows = rows.withColumn("keys", keys).withColumn("labels", labels).where((F.size("labels") > 0))
    return rows.select(short_id("cite:", F.col("passage_id"), F.col("start")).alias("citation_id"), "document_id", "passage_id", "style", F.col("raw").alias("raw_text"), F.col("start").alias("start_char"), (F.col("start") + F.length("raw")).alias("end_char"), "keys", "labels")


def citation_links(citations: DataFrame, references: DataFrame) -> DataFrame:
    """citation_id, document_id, reference_id, confidence: by number at 1.0, else by author and year at 0.7. Of references
    that share a key, the last counts. A range that isn't spelt out links to what lies between its bounds."""
    said = F.col("entry_number") if "entry_number" in references.columns else F.col("key_numeric").cast("string")
    by_number = references.groupBy("document_id", said.alias("key")).agg(F.max_by("reference_id", "order").alias("reference_id"))
    numbered = by_number.withColumn("number", F.col("key").try_cast("long")).drop("key")
    by_label = references.where("key_author_year is not null").groupBy("document_id", F.col("key_author_year").alias("key")).agg(F.max_by("reference_id", "order").alias("reference_id"))
    low, high = X.range_bounds(F.col("key"))
    keys = citations.select("citation_id", "document_id", F.explode("keys").alias("key"))
    ranges = keys.withColumns({"low": low, "high": high}).where("low is not null")
    numbers = keys.join(by_number, ["document_id", "key"]).select("citation_id", "document_id", "reference_id")
    numbers = numbers.unionByName(ranges.join(numbered, "document_id").where("number between low and high").select("citation_id", "document_id", "reference_id"))
    labels = citations.where(F.size("keys") == 0).select("citation_id", "document_id", F.explode("labels").alias("key")).join(by_label, ["document_id", "key"])
    return numbers.select("citation_id", "document_id", "reference_id", F.lit(1.0).alias("confidence")).unionByName(labels.select("citation_id", "document_id", "reference_id", F.lit(0.7).alias("confidence"))).distinct()


def link_summary(citations: DataFrame, references: DataFrame, links: DataFrame) -> DataFrame:
    """document_id, citations, references, links, unlinked."""
    per = citations.groupBy("document_id").agg(F.count("*").alias("citations"))
    refs = references.groupBy("document_id").agg(F.count("*").alias("references"))
    made = links.groupBy("document_id").agg(F.count("*").alias("links"), F.count_distinct("citation_id").alias("linked"))
    out = per.join(refs, "document_id", "full").join(made, "document_id", "full")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("document_id", n("citations"), n("references"), n("links"), (F.coalesce("citations", F.lit(0)) - F.coalesce("linked", F.lit(0))).alias("unlinked"))


def ingestion_report(pages: DataFrame, counted: dict[str, DataFrame]) -> DataFrame:
    """One row per document: n_pages and, for each named frame with a document_id, its number of rows."""
    out = pages.groupBy("document_id").agg(F.count("*").alias("n_pages"))
    for name, df in counted.items():
        out = out.join(df.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
