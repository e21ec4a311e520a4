"""Toxicity: a counterfactually regularised linear classifier.

A text's features are its words and the beginnings of its words, by presence. A logistic model is trained in numpy on a
bounded sample of labelled texts. For every sample text a counterfactual is made by swapping its identity terms for others
of the same group, or, where it has none, by adding a neutral mention of one; the square of the score's change
is penalised, so that naming a group moves a score as little as the labels allow.

Defined results: a null or empty text gets the model's score for no words; without labels of both classes every score is
the share of toxic labels (0 if there is none); a score of just the threshold counts as toxic; texts of any length are read whole;
rows that repeat score alike; a label row that repeats counts once, null labels don't count; an empty table gives no rows; of the
input's columns only doc_id, text and toxic are read, so others can have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import materialise

#: Terms that name groups of people, in the four languages of the corpus; a term may be swapped for any other of its group.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "citizens", "natives"),
    ("old", "young", "disabled", "elderly"),
    # German
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwule", "lesben", "heterosexuelle", "transpersonen"),
    ("einwanderer", "flüchtlinge", "bürger", "einheimische"),
    # French
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "transgenres"),
    ("immigrés", "réfugiés", "citoyens", "autochtones"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "heterosexuales", "transexuales"),
    ("inmigrantes", "refugiados", "ciudadanos", "nativos"),
)
THRESHOLD, PREFIXES = 0.3, (3, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends in a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    known: dict[str, float] = field(default_factory=dict)  # of each word: features that count, cached
    limit: int = 300_000

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "known": {}, "limit": self.limit}

    def score(self, text: str | None) -> float:
        seen: set[str] = set()
        known, weights = self.known, self.weights
        if len(known) > self.limit:
            known.clear()
        for w in words_of(text):
            found = known.get(w)
            if found is None:
                found = known[w] = tuple(x for x in features(w) if x in weights)
            seen.update(found)
        z = self.bias + sum(weights[x] for x in sorted(seen))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def _csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.array(r, dtype=np.int64) for r in rows] or [np.empty(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def penalised(theta: np.ndarray, bias: float, y: np.ndarray, w: np.ndarray, texts: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], strength: float, l2: float) -> tuple[float, np.ndarray]:
    """The loss and its gradient: the weighted log loss of the texts, ``strength`` times the weighted square of the change to their
    counterfactuals' scores, and half of l2 times the squared weights. Texts and others are the rows and columns of their features."""
    (rows, cols), (rows2, cols2), n, d = texts, others, len(y), len(theta)
    p = 1 / (1 + np.exp(-(np.bincount(rows, theta[cols], n) + bias)))
    p2 = 1 / (1 + np.exp(-(np.bincount(rows2, theta[cols2], n) + bias)))
    loss = -(w * (y * np.log(np.maximum(p, 1e-300)) + (1 - y) * np.log(np.maximum(1 - p, 1e-300)))).sum() + strength * (w * (p - p2) ** 2).sum() + l2 / 2 * (theta**2).sum()
    gap = 2 * strength * w * (p - p2)
    g1, g2 = w * (p - y) + gap * p * (1 - p), -gap * p2 * (1 - p2)
    return float(loss), np.append(np.bincount(cols, g1[rows], d) + np.bincount(cols2, g2[rows2], d) + l2 * theta, g1.sum() + g2.sum())


def fit(texts: list[str], toxic: list[int], weight: list[float], groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, strength: float = 2.0, n_features: int = 4000, min_texts: int = 3, rounds: int = 400, rate: float = 0.05, l2: float = 3e-4, seed: int = 3) -> ToxicityModel:
    """Adam over all sample texts at once, with class weights as given and the counterfactual penalty."""
    y, w = np.array(toxic, dtype=np.float64), np.array(weight, dtype=np.float64)
    w /= max(w.sum(), 1e-9)
    share = float((w * y).sum())
    if not 0 < share < 1:
        return ToxicityModel({}, 30.0 if share == 1 else -30.0)
    swap = {t: tuple(x for x in g if x != t) for g in groups for t in g}
    same: dict[str, str] = {}
    words = [{same.setdefault(v, v) for v in words_of(t)} for t in texts]  # one string for each word, however many texts
    of = lambda ws: {x for v in ws for x in features(v)}
    n1, n0 = Counter(), Counter()
    for ws, label in zip(words, toxic, strict=True):
        (n1 if label else n0).update(of(ws))
    t1, t0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    # what tells the classes apart most, by the signed root of the likelihood ratio
    def tells(x: str) -> float:
        p, q = (n1[x] + 0.5) / (t1 + 1), (n0[x] + 0.5) / (t0 + 1)
        return abs(p - q) * abs(np.log(p / q))
    common = sorted((x for x in n1.keys() | n0.keys() if n1[x] + n0[x] >= min_texts), key=lambda x: (-tells(x), x))[:n_features]
    del n1, n0
    for term in sorted(swap):
        common += [x for x in features(term) if x not in set(common)]
    at = {x: i for i, x in enumerate(common)}
    rng = np.random.default_rng(seed)
    terms = sorted(swap)
    other = []
    for ws in words:
        named = sorted(ws & swap.keys())
        if named:
            other.append((ws - set(named)) | {swap[t][rng.integers(len(swap[t]))] for t in named})
        else:
            other.append(ws | {terms[rng.integers(len(terms))]})
    cols, rows = _csr([sorted(at[x] for x in of(ws) if x in at) for ws in words])
    cols2, rows2 = _csr([sorted(at[x] for x in of(ws) if x in at) for ws in other])
    d = len(common)
    theta, bias = np.zeros(d), np.log(share / (1 - share))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for k in range(1, rounds + 1):
        _, grad = penalised(theta, bias, y, w, (rows, cols), (rows2, cols2), strength, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        theta, bias = theta - step[:-1], bias - step[-1]
    return ToxicityModel({x: float(t) for x, t in zip(common, theta, strict=True) if abs(t) > 1e-3}, float(bias))


def held_out(doc_id):  # noqa: ANN001, ANN201
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> ToxicityModel:
    """Fit on about ``per_class`` labelled texts of each class (the documented bound), drawn by hash from rows that aren't
    held out and weighted back to the classes' shares. Where ids repeat with ever other texts, a hash of the texts thins what was drawn to
    about four times ``per_class`` in all, which is the bound then. Copies of a text count once. Texts become sets of words where they are: what goes
    to the driver is bounded by a text's different words, not by its length."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    n = {r.toxic: r["count"] for r in marks.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().toLocalIterator()}
    if not n:
        return ToxicityModel({}, -30.0)
    share = {k: min(1.0, per_class / c) for k, c in n.items()}
    limit = F.when(F.col("toxic") > 0, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    drawn = marks.where(F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_000)) < limit * 1_000_000)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "toxic": pdf["toxic"], "words": [" ".join(sorted(words_of(t))) for t in pdf["text"]]})

    # ids are distinct, so that the draw's shares are its bound: the drawn labels are few and go to the documents, whose texts needn't move
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), (F.col("toxic") > 0).cast("int").alias("toxic"), "text")
    rows = materialise(rows.mapInPandas(sets, "key string, toxic int, words string").distinct(), "toxicity-sample")
    thin = F.pmod(F.xxhash64(F.lit("thin"), "key"), F.lit(1_000_000)) * F.lit(rows.count()) < F.lit(1_000_000 * 4 * per_class)
    texts = sorted((r.key, r.toxic, r.words) for r in rows.where(thin).toLocalIterator())
    return fit([t for *_, t in texts], [x for _, x, _ in texts], [1 / share[x] for _, x, _ in texts])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], index=texts.index, dtype="float64")

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), run("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
