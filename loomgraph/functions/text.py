"""Column functions over names, questions and references. All of them stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph import schemas as S


def any_of(words: tuple[str, ...]) -> str:
    return "|".join(words)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def filled(template: str, **values: Column) -> Column:
    """A fixed text with columns in the place of names in braces; null if one of them is."""
    parts = [values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


# --- names


def clean_name(name: Column) -> Column:
    """Trimmed, spaces collapsed, unquoted, without punctuation at its end."""
    name = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"^([\"'])(.*)\1$", "$2")
    return F.regexp_replace(F.trim(name), r"[.,;:!?]+$", "")


def title_case(name: Column) -> Column:
    """Every run of letters capitalised, whatever stands between them."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def simplify_name(name: Column, entity_type: Column) -> Column:
    """Methods and concepts lose a leading article, a "-based model" ending and generic last words."""
    generic = any_of(S.GENERIC_SUFFIXES)
    bare = F.trim(F.regexp_replace(name, rf"(?i)^(?:{any_of(S.ARTICLES)})\s+", ""))
    short = F.regexp_replace(bare, rf"(?i)^(.+?)-based\s+(?:{generic})$", "$1")
    short = F.regexp_replace(short, rf"(?i)(?:\s+(?:{generic}))+$", "")
    return F.when(entity_type.isin("Method", "Concept") & (bare != ""), F.trim(short)).otherwise(name)


def canonical_name(name: Column, entity_type: Column) -> Column:
    name = simplify_name(clean_name(name), entity_type)
    acronym = (F.length(name) <= 6) & (F.upper(name) == name) & (F.lower(name) != name)
    hyphened = F.array_join(F.transform(F.split(name, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "-")
    lower = (F.lower(name) == name) & (F.upper(name) != name)
    return F.when(acronym, name).when(name.contains("-"), hyphened).when(lower, title_case(name)).otherwise(name)


def _folds() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter and marks, and those ASCII letters."""
    pairs = []
    for code in [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x209D), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c.isascii())
        if len(plain) == 1:
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(text: Column) -> Column:
    """ASCII letters instead of accented ones; what has none goes."""
    return F.regexp_replace(F.translate(text, *_folds()), r"[^\x00-\x7F]", "")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def entity_uid(entity_type: Column, name: Column) -> Column:
    return F.concat(F.lower(entity_type), F.lit(":"), slug(name))


def relation_slug(relation: Column) -> Column:
    """The slug of a relation's type. Those of the vocabulary are known, so that no pattern runs for each mention."""
    known = F
    for name in S.RELATION_TYPES:
        known = known.when(relation == name, name.lower().replace("_", "-"))
    return known.otherwise(slug(relation))


def relation_uid(relation: Column, source_uid: Column, target_uid: Column) -> Column:
    return F.concat_ws(":", F.lit("ri"), relation_slug(relation), source_uid, target_uid)


def evidence_uid(relation: Column, passage: Column) -> Column:
    return F.concat_ws(":", F.lit("ev"), relation, passage)


def singular(word: Column) -> Column:
    return (
        F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us"), F.substring(word, F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def match_key(name: Column) -> Column:
    """The form under which names are compared."""
    text = F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "_-", "  "), r"[.,;:!?]+$", "")
    words = F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")
    words = F.transform(words, singular)
    articles = F.array(*map(F.lit, S.ARTICLES))
    words = F.when((F.size(words) >= 2) & F.array_contains(articles, F.get(words, 0)), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    words = F.when((F.size(words) >= 2) & F.array_contains(articles, F.element_at(words, -1)), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    return F.array_join(words, " ")


def initials(name: Column) -> Column:
    """Upper-case initials of a name's words."""
    return F.array_join(F.transform(F.filter(F.split(F.regexp_replace(name, "[^A-Za-z0-9]+", " "), " "), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def acronym(name: Column) -> Column:
    """The initials, if they make an acronym of 2 to 8 capitals; else null."""
    found = initials(name)
    return F.when(found.rlike("^[A-Z]{2,8}$"), found)


# --- questions


def tokens(question: Column) -> Column:
    return F.regexp_extract_all(F.lower(question), F.lit("[a-zA-Z0-9_]+"), F.lit(0))


def question_tokens(question: Column) -> Column:
    return F.filter(tokens(question), lambda t: F.length(t) > 2)


def _stopwords() -> Column:
    return F.array(*map(F.lit, S.QUESTION_STOPWORDS))


def intent(question: Column) -> Column:
    q, terms = F.lower(question), S.INTENT_TERMS
    return (
        F.when(contains_any(q, terms["CITATION_BASIS"]), "CITATION_BASIS")
        .when(q.rlike(USAGE_QUESTION) | contains_any(q, terms["METHOD_USAGE"]) | (q.contains("architecture") & q.contains("how")), "METHOD_USAGE")
        .when(contains_any(q, terms["PROBLEM"]), "PROBLEM")
        .when(contains_any(q, terms["RELATION_LOOKUP"]), "RELATION_LOOKUP")
        .otherwise("SUMMARY")
    )


def relation_hints(question: Column) -> Column:
    q = F.lower(question)
    return F.filter(F.array(*[F.when(contains_any(q, words), F.lit(name)) for name, words in S.RELATION_HINTS.items()]), lambda h: h.isNotNull())


def entity_hints(question: Column, most: int = 10) -> Column:
    """Capitalised phrases, then the words that say something; the first ten different ones."""
    phrases = F.transform(F.regexp_extract_all(question, F.lit(r"\b([A-Z][a-zA-Z0-9_-]+(?:\s+[A-Z][a-zA-Z0-9_-]+)*)\b"), F.lit(1)), lambda p: F.lower(F.trim(p)))
    words = F.filter(question_tokens(question), lambda t: ~F.array_contains(_stopwords(), t))
    return F.slice(F.array_distinct(F.concat(phrases, words)), 1, most)


def disambiguation_terms(question: Column, most: int = 6) -> Column:
    return F.slice(F.filter(tokens(question), lambda t: (F.length(t) > 3) & ~F.array_contains(_stopwords(), t)), 1, most)


# --- references and citations

# fixed values: what is a citation, a year, a lead author and a numbered entry is defined by these patterns as they are
YEAR = r"\b(?:19|20)\d{2}\b"
NUMERIC_CITATION = r"\[(\s*\d+(?:\s*[-,]\s*\d+)*\s*)\]"
AUTHOR_YEAR_BLOCK = r"\(([^()]*\b(?:19|20)\d{2}\b[^()]*)\)"
AUTHOR_YEAR_LABEL = r"([A-Z][A-Za-z'\-]+)(?:\s+et\s+al\.)?(?:\s+and\s+[A-Z][A-Za-z'\-]+)?\s*,\s*((?:19|20)\d{2})"
LEAD_AUTHOR = r"([A-Z][A-Za-z'\-]+)(?:\s+et\s+al\.)?.{0,40}\b(?:19|20)\d{2}\b"
NUMBERED_ENTRY = r"^\s*(?:\[(\d+)\]|(\d+)\.)\s*"
ENTRY_NUMBER = r"^\[?\d+\]?\.\s*"
USAGE_QUESTION = r"\bhow\b.+\buse[sd]?\b"

#: A range of more numbers than this stays one key, its bounds; it is joined by its bounds, not spelt out.
WIDEST_RANGE = 1000


def last_year(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0)), F.lit(-1)).cast("int")


def title_guess(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, ENTRY_NUMBER, ""), r"\.")
    guess = F.trim(F.get(parts, 1))
    return F.when((F.size(parts) >= 3) & (F.length(guess) > 10) & (F.length(guess) < 300), guess)


def entry_number(text: Column, order: Column) -> Column:
    """The number that an entry begins with, of any number of digits, as text without leading zeros; else its place."""
    key = F.regexp_extract(text, NUMBERED_ENTRY, 1)
    key = F.when(key != "", key).otherwise(F.regexp_extract(text, NUMBERED_ENTRY, 2))
    return F.when(key != "", F.regexp_replace(key, r"^0+(?=\d)", "")).otherwise((order + 1).cast("string"))


def numeric_key(text: Column, order: Column) -> Column:
    """The number that an entry begins with, else its place, as a number; its place too for a number of more than 18 digits, which
    :func:`entry_number` has."""
    return F.coalesce(entry_number(text, order).try_cast("long"), (order + 1).cast("long"))


def lead_author(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, LEAD_AUTHOR, 1), F.lit(""))


def author_year_key(author: Column, year: Column) -> Column:
    return F.when(author.isNotNull() & year.isNotNull(), F.concat_ws(":", F.lower(author), year))


def expand_keys(body: Column) -> Column:
    """Citation numbers of a bracket's body as texts, ranges spelt out, each once and in order.

    A number may have any number of digits. A range of more than WIDEST_RANGE numbers, or with a bound that no 64 bits hold, stays as
    its bounds, "lower-upper"; :func:`range_bounds` reads them. A part with two hyphens is no number and goes."""
    parts = F.transform(F.split(body, ","), lambda p: F.trim(p))

    def numbers(part: Column) -> Column:
        ends = F.transform(F.split(part, "-", 2), lambda x: F.trim(x))
        one, other = F.get(ends, 0), F.element_at(ends, -1)
        a, b = one.try_cast("long"), other.try_cast("long")
        low, high = F.least(a, b), F.greatest(a, b)
        known = a.isNotNull() & b.isNotNull()
        spelt = F.when(known & (high - low < WIDEST_RANGE), F.transform(F.sequence(low, high), lambda k: k.cast("string")))
        bounds = F.when(known, F.concat_ws("-", low, high)).otherwise(F.concat_ws("-", one, other))
        digits = F.forall(ends, lambda x: x.rlike(r"^\d+$"))
        return F.when(~digits, F.array().cast("array<string>")).when(F.size(ends) == 1, F.array(one)).otherwise(F.coalesce(spelt, F.array(bounds)))

    return F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda p: p != ""), numbers)))


def range_bounds(key: Column) -> tuple[Column, Column]:
    """The bounds of a key that stands for a range; null for other keys."""
    ends = F.split(key, "-", 2)
    return F.when(key.contains("-"), F.get(ends, 0).try_cast("long")), F.when(key.contains("-"), F.element_at(ends, -1).try_cast("long"))


def label_keys(body: Column) -> Column:
    """surname:year of each label in an author-year block."""
    names = F.regexp_extract_all(body, F.lit(AUTHOR_YEAR_LABEL), F.lit(1))
    years = F.regexp_extract_all(body, F.lit(AUTHOR_YEAR_LABEL), F.lit(2))
    return F.array_distinct(F.zip_with(names, years, lambda n, y: F.concat_ws(":", F.lower(n), y)))


def matches_with_offsets(text: Column, pattern: str) -> Column:
    """array<struct<raw, start>>: all matches and where they start, from the lengths of what lies between them. The list is copied
    for each match; a passage, which is what it is meant for, is 1,600 characters long."""
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<raw:string,start:int>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.length(piece["gap"])
        return F.struct((at + F.length(piece["raw"])).alias("at"), F.concat(acc["found"], F.array(F.struct(piece["raw"].alias("raw"), at.alias("start")))).alias("found"))

    # there is a gap more than matches; asking for their number would look for them twice
    pieces = F.filter(F.zip_with(raw, gaps, lambda r, g: F.struct(r.alias("raw"), g.alias("gap"))), lambda p: p["raw"].isNotNull())
    return F.aggregate(pieces, start, step, lambda acc: acc["found"])
