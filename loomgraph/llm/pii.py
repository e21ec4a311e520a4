"""Personal data by base patterns and a skip-chain conditional random field.

Four patterns with checks find the base spans. The field then labels each document's entity-like tokens: neighbours in
reading order form the chain, and tokens that repeat or hold the same digits are joined by skip edges, which share
potentials over any distance. Every occurrence has its own edge to the base span that it repeats (one for each kind), so
that what the pattern recognised counts for it in full however many other repeats there are. Loopy message passing makes labels
agree across the document, so a number that a pattern recognised once is also found where it stands without its prefix or
separators. Base spans stay; spans the field is sure of come on top.

The field's weights are trained by pseudo-likelihood on a bounded sample of documents that hold base spans.

Defined results: a null text counts as empty and has no spans; texts of any length are read whole, in time linear in
their length (an occurrence has a skip edge to the first base span of each kind that it repeats, and repeats of no base
span to the one before); rows that repeat get equal spans, whatever stands in other rows; an empty table gives no rows; of the
input's columns only doc_id and text are read, so others can have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)  # the label of tokens that are no personal data

_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# a run of local characters that fails at its end fails from each of its characters: it is tried once, from its start
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++@{_DOMAIN}")
_EMAIL_HERE = re.compile(rf"{_LOCAL}++@{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that the field looks at: groups of digits with separators, and words with a digit or an at sign.
#: Whole tokens of any length: each part starts where a run of its characters does, so that no run is tried twice.
_TOKEN = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++|(?<![^\s@])[^\s@]++@[^\s@]++|(?<!\S)[^\s0-9]*+[0-9]\S*+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while text.find("@", at) >= 0:
        m = (at and _EMAIL_HERE.match(text, at)) or _EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' checked matches, as :func:`listed`."""
    out = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 or not x[:-3].strip("0") for x in m[0].split(".")) and all(int(x[-3:]) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return listed(out)


def listed(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in the order of the results: by start, then kind as listed."""
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


@dataclass
class Graph:
    """Nodes of several documents at once: doc, start, end, base label (-1: none), features; edges (a, b, kind)."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    base: np.ndarray
    features: np.ndarray
    edges: np.ndarray


N_FEATURES = 14
CHAIN, SAME, SIMILAR = range(3)
#: What the weights are drawn to where a sample says little: repeats agree, and a token by itself is no personal data.
SKIP_PRIOR, OTHER_PRIOR = (0.0, 7.0, 6.0), 2.0


def _shape(token: str) -> list[float]:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    return [1.0, "@" in token, token.startswith("+"), token.count(".") == 3, "-" in token, " " in token, "(" in token, letters > 0, digits < 5, 5 <= digits < 9, 9 <= digits < 12, 12 <= digits <= 19, digits > 19, "=" in token]


#: Digits that a part of a number must have to stand for it, and that the longest base span has.
LEAST, MOST = 7, 19
#: Kinds of names that any token has; the others tie it to phone numbers.
OWN = ("same", "alike")


def _asked(lower: str) -> list[tuple[str, str]]:
    """Names of a token: base spans that go by one of them are what it repeats."""
    digits = "".join(c for c in lower if c.isdigit())
    number = "@" not in lower and len(digits) >= LEAST
    key = digits[-10:] if number else lower.partition("@")[0]
    out = [("same", lower)] + [("alike", key)] * (len(key) >= 5)
    if number:
        # a phone number also goes by its last digits, and a longer one ends in it; zeros in front are dialling prefixes
        bare = digits.lstrip("0")
        bare = bare if len(bare) >= LEAST else digits
        out.append(("tail", bare))
        out += [("whole", bare[-n:]) for n in range(LEAST, min(len(bare), MOST) + 1)]
    return out


def _names(lower: str, kind: int) -> list[tuple[str, str]]:
    """Names that a base span goes by."""
    out = [name for name in _asked(lower) if name[0] in OWN]
    if KINDS[kind] == "phone":
        digits = "".join(c for c in lower if c.isdigit())
        out += [("whole", digits)] + [("tail", digits[-n:]) for n in range(LEAST, len(digits) + 1)]
    return out


def build(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Graph:
    """The field's graph over the documents that hold base spans."""
    doc, start, end, base, rows, edges = [], [], [], [], [], []
    for k, (text, found) in enumerate(zip(texts, spans, strict=True)):
        if not found:
            continue
        at, tokens = 0, []
        taken = [(a, b) for a, b, _ in found]
        for m in _TOKEN.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            core = m[0].rstrip(".,;:!?)")
            if len(core) >= 5 and not (at < len(taken) and taken[at][0] < m.end()):
                tokens.append((m.start(), m.start() + len(core), -1))
        nodes = sorted(tokens + found)
        first = len(doc)
        entities: dict[tuple[str, str], dict[int, int]] = {}  # by name and kind the first base span
        for i, (a, b, kind) in enumerate(nodes, first):
            if kind >= 0:
                for name in _names(text[a:b].lower(), kind):
                    entities.setdefault(name, {}).setdefault(kind, i)
        before: dict[tuple[str, str], int] = {}
        joined_to_base = set()
        for i, (a, b, kind) in enumerate(nodes, first):
            token = text[a:b]
            doc.append(k)
            start.append(a)
            end.append(b)
            base.append(kind)
            rows.append(_shape(token))
            if i > first:
                edges.append((i - 1, i, CHAIN))
            asked = _asked(token.lower())
            hits: dict[int, int] = {}
            for name in asked:
                for j in entities.get(name, {}).values():
                    if j < i or kind < 0:
                        hits.setdefault(j, SAME if name[0] == "same" else SIMILAR)
            edges += [(j, i, how) for j, how in hits.items()]
            if kind < 0:
                if hits:
                    joined_to_base.add(i)
                last = next((name for name in asked if name[0] in OWN and name in before), None)
                if last and not (hits and before[last] in joined_to_base):
                    edges.append((before[last], i, SAME if last[0] == "same" else SIMILAR))
                before.update({name: i for name in asked if name[0] in OWN})
    as_ints = lambda x: np.array(x, dtype=np.int64)
    return Graph(as_ints(doc), as_ints(start), as_ints(end), as_ints(base), np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES), as_ints(edges).reshape(-1, 3))


@dataclass(frozen=True)
class Field:
    """unary: weights of a token's shape for each label; agree: for each kind of edge, the weight of equal labels."""

    unary: np.ndarray
    agree: np.ndarray

    def marginals(self, g: Graph, settled: float = 1e-6, rounds: int = 1000, damping: float = 0.3) -> np.ndarray:
        """Label probabilities of each node by loopy sum-product over all edges at once; base labels are held.

        A document's messages are sent until none changes by more than ``settled``, whatever other documents need;
        ``rounds`` only ends cycles that never settle."""
        local = g.features @ self.unary
        held = g.base >= 0
        local[held] = -1e9  # whatever number of repeats sends to it
        local[held, g.base[held]] = 0.0
        n = len(g.edges)
        sent = np.zeros((2 * n, OTHER + 1))
        ends = np.concatenate([g.edges[:, 0], g.edges[:, 1]]), np.concatenate([g.edges[:, 1], g.edges[:, 0]])
        gains = np.exp(np.concatenate([self.agree[g.edges[:, 2]]] * 2))[:, None] - 1
        moving = np.arange(n)
        for _ in range(rounds):
            if not len(moving):
                break
            use = np.concatenate([moving, moving + n])
            a, b, now = ends[0][use], ends[1][use], sent[use]
            belief = local.copy()
            np.add.at(belief, b, now)
            p = _softmax(belief[a] - np.roll(now, len(moving), axis=0))
            new = np.log1p(p * gains[use])  # a factor of exp(agree) where labels are equal, of 1 elsewhere
            new = damping * now + (1 - damping) * (new - new.mean(axis=1, keepdims=True))
            sent[use] = new
            restless = np.zeros(g.doc.max() + 1, dtype=bool)
            restless[g.doc[a[np.abs(new - now).max(axis=1) > settled]]] = True
            moving = moving[restless[g.doc[g.edges[moving, 0]]]]
        belief = local.copy()
        np.add.at(belief, ends[1], sent)
        return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], epochs: int = 300, rate: float = 0.5, l2: float = 1e-3) -> Field:
    """Pseudo-likelihood: each node given its neighbours' labels. Base spans give the labels; a token joined to a base span
    by a skip edge but not matched itself is left unlabelled, as patterns can't tell.

    No edge's weight goes below 0. Base spans often stand beside spans of other kinds, and a weight against equal neighbours would
    let the repeats of a number argue each other away; weights of 0 or more also let messages settle."""
    g = build(texts, [base_spans(t) for t in texts])
    prior, skip = np.zeros((N_FEATURES, OTHER + 1)), np.array(SKIP_PRIOR)
    prior[0, OTHER] = OTHER_PRIOR
    unary, agree = prior.copy(), skip.copy()
    if not len(g.doc):
        return Field(unary, agree)
    y = np.where(g.base >= 0, g.base, OTHER)
    a, b = np.concatenate([g.edges[:, 0], g.edges[:, 1]]), np.concatenate([g.edges[:, 1], g.edges[:, 0]])
    kind = np.concatenate([g.edges[:, 2]] * 2)
    known = np.ones(len(y), dtype=bool)
    known[b[(kind != CHAIN) & (g.base[a] >= 0) & (g.base[b] < 0)]] = False
    votes = np.zeros((3, len(y), OTHER + 1))  # by kind of edge: neighbours that have each label
    use = known[a]
    np.add.at(votes, (kind[use], b[use], y[a[use]]), 1.0)
    votes = np.minimum(votes, 2)[:, known]
    x, target = g.features[known], np.eye(OTHER + 1)[y[known]]
    for _ in range(epochs):
        err = (_softmax(x @ unary + np.tensordot(agree, votes, 1)) - target) / len(x)
        unary -= rate * (x.T @ err + l2 * (unary - prior))
        agree -= rate * ((votes * err).sum(axis=(1, 2)) + l2 * (agree - skip))
        np.maximum(agree, 0.0, out=agree)
    return Field(unary, agree)


def find(texts: list[str], field: Field, sure: float = 0.9) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans, and those spans together with what the field adds."""
    base = [base_spans(t) for t in texts]
    g = build(texts, base)
    out = [(b, list(b)) for b in base]
    if len(g.doc):
        p = field.marginals(g)
        best = p[:, :OTHER].argmax(axis=1)
        joined = np.zeros(len(p), dtype=bool)  # only tokens with a skip edge can be new
        skips = g.edges[g.edges[:, 2] != CHAIN]
        joined[skips[:, :2].ravel()] = True
        for i in np.flatnonzero((g.base < 0) & joined & (p[np.arange(len(p)), best] >= sure)):
            out[g.doc[i]][1].append((int(g.start[i]), int(g.end[i]), int(best[i])))
    return [(b, listed(s)) for b, s in out]


def learn(docs: DataFrame, sample: int = 2000, characters: int = 50_000_000) -> Field:
    """Fit on about ``sample`` distinct texts, of about ``characters`` in all at most (the documented bounds), drawn by their hash;
    those without base spans weigh nothing."""
    n, length = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    share = min(sample / max(n, 1), characters / max(length or 0, 1))
    draw = F.pmod(F.xxhash64(F.lit("pii"), F.col("text")), F.lit(1_000_000)) < F.lit(1_000_000 * share)
    some = docs.where(draw & F.col("text").rlike("[0-9]{2}")).select("text").distinct()
    return fit(sorted(r.text for r in some.toLocalIterator()))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(field or learn(docs))
    span = "array<struct<start: int, end: int, kind: string>>"

    @pandas_udf(f"base {span}, spans {span}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        named = lambda spans: [{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in spans]
        for texts in batches:
            found = find([t or "" for t in texts], shared.value)
            yield pd.DataFrame({"base": [named(b) for b, _ in found], "spans": [named(s) for _, s in found]})

    return docs.select("doc_id", run("text").alias("p")).select("doc_id", "p.*")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
            at = b
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
