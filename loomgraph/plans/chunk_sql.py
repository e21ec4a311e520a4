"""The recursive splitter in SQL: texts are cut level by level, and a recursive table expression fills chunk after chunk.

Pieces put together again are the text, so a chunk is a stretch of it: it is found by the pieces' ends alone. ``c`` holds these ends, first a
0; a chunk has the pieces from the ``f``-th on up to, but without, the ``e``-th."""

from __future__ import annotations

_MARKS = ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def chunks(source: str, size: int, overlap: int) -> str:
    """Table expressions that end in chunks(rid, chunk_no, chunk) for a table of rid and text."""
    steps = [f"cut0 AS (SELECT rid, [0] AS path, text FROM {source} WHERE text <> '')"]
    for k, mark in enumerate(_MARKS):
        steps.append(f"""split{k} AS (SELECT rid, path, CASE WHEN length(text) > {size} AND contains(text, {mark}) THEN string_split(text, {mark}) ELSE [text] END AS parts FROM cut{k}),
cut{k + 1} AS (
  SELECT rid, path, text FROM (SELECT rid, list_append(path, i) AS path, CASE WHEN i < n THEN part || {mark} ELSE part END AS text FROM (
    SELECT rid, path, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM split{k})) WHERE text <> '')""")
    last = len(_MARKS)
    steps.append(f"""piece AS (SELECT rid, list_append(path, nth) AS path, least({size}, length(text) - nth * {size}) AS n FROM (SELECT *, unnest(range(ceil(length(text) / {size}.0)::BIGINT)) AS nth FROM cut{last})),
ended AS (SELECT rid, list_prepend(0, list(upto ORDER BY upto)) AS c FROM (SELECT rid, (sum(n) OVER (PARTITION BY rid ORDER BY path))::BIGINT AS upto FROM piece) GROUP BY rid),
filled AS (
  SELECT rid, c, 0 AS k, 1::BIGINT AS f, greatest(2, len([x for x in c if x <= {size}])) AS e FROM ended
  UNION ALL
  SELECT rid, c, k + 1, g, greatest(e + 1, len([x for x in c if x <= c[g] + {size}])) FROM (
    SELECT *, least(e, greatest(f, 1 + len([x for x in c if x < greatest(c[e] - {overlap}, c[e + 1] - {size})]))) AS g FROM filled WHERE e < len(c))),
told AS (SELECT s.rid, k, trim(substr(s.text, c[f] + 1, c[e] - c[f]), {_BLANK}) AS chunk FROM filled JOIN {source} s ON s.rid = filled.rid),
chunks AS (SELECT rid, (row_number() OVER (PARTITION BY rid ORDER BY k) - 1)::INT AS chunk_no, chunk FROM told WHERE chunk <> '')""")
    return ",\n".join(steps)
