"""DuckDB SQL for the training-data queries that SQL can express."""

from .codes import ENTRIES, PARTS, ROUNDS, SCALE
from .license import CONTAINMENT, PHRASES, TEMPLATES

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: The same thresholds by a running sum over sorted hashes, and the level by the same closed form.
MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size,
         CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size::DOUBLE) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level
  FROM per WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, round(least(cap, coalesce((SELECT max(level) FROM lev WHERE level <= cap / weight) * weight, cap)), 6) AS target FROM lev),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets),
runs AS (
  SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h),
cut AS (
  SELECT b.source, max(CASE WHEN r.upto - r.n <= b.target - b.copies * b.source_size
                             AND (r.upto <= b.target - b.copies * b.source_size OR b.target - b.copies * b.source_size - (r.upto - r.n) >= r.n / 2.0)
                        THEN r.h END) AS last
  FROM budgets b JOIN runs r ON b.source IS NOT DISTINCT FROM r.source WHERE r.n > 0 GROUP BY b.source)
SELECT s.doc_id, s.size, b.source_size, b.target, (s.size * (b.copies + CASE WHEN s.h <= c.last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN cut c ON c.source IS NOT DISTINCT FROM s.source
"""

#: Exact distinct counts for every line; the sketches only save counting most of them.
LINE_DEDUP = r"""
WITH docs AS (SELECT *, row_number() OVER () AS rid FROM documents),
split AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM docs),
lines AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM split),
bad AS (
  SELECT t, min({'none': doc_id IS NULL, 'id': doc_id, 'pos': pos}) AS first FROM lines
  WHERE length(t) >= 20 GROUP BY t HAVING count(DISTINCT coalesce(source, '')) >= 5),
marked AS (
  SELECT l.*, bad.t IS NOT NULL AND NOT (bad.first.id IS NOT DISTINCT FROM l.doc_id AND bad.first.pos = l.pos) AS gone FROM lines l LEFT JOIN bad ON bad.t = l.t),
kept AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS left_text FROM marked GROUP BY rid)
SELECT d.doc_id, coalesce(k.n_removed, 0)::BIGINT AS n_removed, length(CASE WHEN d.text IS NOT NULL THEN coalesce(k.left_text, d.text) END)::BIGINT AS n_chars_left,
       md5(CASE WHEN d.text IS NOT NULL THEN coalesce(k.left_text, d.text) END) AS text_md5
FROM docs d LEFT JOIN kept k USING (rid)
"""

#: All pairs of queries and rows.
TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.ints, v.ints)])::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
QUALIFY rank <= 10
"""



def _licenses() -> str:
    """All blocks with all templates: the shares of their words, without a filter."""
    split = lambda text: "regexp_extract_all(translate(coalesce(" + text + r", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    rows = lambda pairs: ", ".join(f"({i}, '{text}', '{label}')" for i, (text, label) in enumerate(pairs))
    return rf"""
WITH phrases AS (SELECT i, string_split(t, ' ') AS p, label FROM (VALUES {rows(PHRASES)}) AS v(i, t, label)),
templates AS (
  SELECT i, list_distinct(string_split(t, ' ')) AS ws, (2 ** ceil(log2(len(string_split(t, ' ')))))::BIGINT AS step, label FROM (VALUES {rows(TEMPLATES)}) AS v(i, t, label)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {split("text")} AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
base AS (
  SELECT words.rid, pos, label FROM words JOIN phrases ON w = p[1] JOIN docs ON docs.rid = words.rid WHERE docs.ws[pos + 1 : pos + len(p)] = p),
based AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY rid),
held AS (SELECT i, label, step, len(ws) AS m, unnest(ws) AS w FROM templates),
near AS (
  SELECT rid, i, label, pos // step - back AS block, count(DISTINCT words.w) / max(m) AS share
  FROM words JOIN held ON held.w = words.w, (VALUES (0), (1)) AS b(back) WHERE pos // step >= back GROUP BY rid, i, label, block),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS best FROM near WHERE share >= {CONTAINMENT} - 1e-9 GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(based.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(coalesce(based.labels, []) || coalesce(more.labels, []))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN based USING (rid) LEFT JOIN more USING (rid)
"""


def _codes() -> str:
    """Every round written out, every part compared with every entry."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS (
  SELECT rid, part, min((d, entry)) AS best FROM (
    SELECT rid, p.part, entry, (list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::BIGINT AS d FROM parts p JOIN book{r} b ON b.part = p.part) GROUP BY rid, part)""")
        if r < ROUNDS:
            steps.append(f"""mean{r} AS (
  SELECT part, entry, list(m ORDER BY pos) AS c FROM (
    SELECT part, best[2] AS entry, pos, floor(sum(v) / count(*))::DOUBLE AS m FROM (
      SELECT p.part, best, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM parts p JOIN near{r} n ON n.rid = p.rid AND n.part = p.part) GROUP BY part, best[2], pos) GROUP BY part, entry),
book{r + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, [floor({SCALE} * x::DOUBLE) for x in embedding]) - 1 AS rid, vec_id, label, [floor({SCALE} * x::DOUBLE) for x in embedding] AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT rid, part, ints[part * (len(ints) // {PARTS}) + 1 : (part + 1) * (len(ints) // {PARTS})] AS x FROM kept, range({PARTS}) AS t(part)),
book0 AS (SELECT part, rid AS entry, x AS c FROM parts WHERE rid < {ENTRIES}),
{", ".join(steps)},
codes AS (
  SELECT rid, string_agg(lower(printf('%02x', best[2])), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM near{ROUNDS} GROUP BY rid),
said AS (SELECT sha256(string_agg(array_to_string([v::BIGINT for v in c], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (rid), said
"""


ORACLES: dict[str, str] = {"op4_topk": TOP_K, "op5_mixing": MIXING, "op8_line_dedup": LINE_DEDUP, "op12_license": _licenses(), "op13_codes": _codes()}
