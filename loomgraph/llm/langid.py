"""Language ID: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text's subwords are its letter n-grams (1 to 3 characters, lower case, a blank standing for anything between words).
Each hashes to a row of an embedding table; their mean goes through a linear softmax. Table and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled texts. Part of the sample is held back to fit a
temperature and the score under which a prediction is rejected. Because the model is linear after the mean, scoring needs
only the table of class scores per hash bucket, whatever the length of the text.

Steps are normalised, so that no text's length and no size of the weights can make training diverge; a model that isn't
finite, or is right about too few of the texts held back, is trained again at a lower rate, and the best is kept.

Defined results: a null text or one without a letter is ``und``, score 0 and rejected; a table without labelled rows
gives ``und`` for all, an empty table no rows; of languages that score alike the first by name is taken; a text of any length
is scored whole, in pieces that carry their n-grams over the cuts; rows that repeat score alike; extra columns are kept by
:func:`keep_identified`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import materialise

UNKNOWN = "und"
BUCKETS, DIM, ORDERS = 1 << 16, 16, (1, 2, 3)
PIECE = 1 << 20
_FACTORS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
_BLANK, _SIGMA, _FINAL_SIGMA = np.uint32(32), np.uint32(0x3C3), np.uint32(0x3C2)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def pieces(text: str, size: int = PIECE) -> Iterator[np.ndarray]:
    """Code points of a text's letters in lower case, a blank for anything between words and at both ends; empty if it has
    no letter. Memory is bounded by ``size`` characters."""
    inside, some = False, False
    for at in range(0, len(text), size):
        codes = np.frombuffer(text[at : at + size].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(codes == _FINAL_SIGMA, _SIGMA, codes)  # the one letter whose lower case depends on what follows
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run of other characters, the first stays as the blank
        keep[:1] |= inside
        inside = bool(letter[-1])
        found = np.where(letter, codes, _BLANK)[keep]
        if len(found):
            yield found if some else np.append(_BLANK, found)
            some = True
    if some:
        yield np.array([_BLANK])


def subwords(text: str, size: int = PIECE) -> Iterator[np.ndarray]:
    """Hash buckets of a text's subwords, piece by piece; an n-gram over a cut belongs to the later piece."""
    before = np.empty(0, dtype=np.uint32)
    for piece in pieces(text, size):
        codes = np.concatenate((before, piece))
        out = []
        for n in ORDERS:
            first = max(0, len(before) - n + 1)  # n-grams that begin earlier are known
            m = len(codes) - n + 1 - first
            if m > 0:
                h = np.full(m, np.uint32(n * 97))
                for k in range(n):
                    h = (h ^ codes[first + k : first + k + m]) * _FACTORS[k]
                    h ^= h >> np.uint32(15)
                out.append((h & np.uint32(BUCKETS - 1)).astype(np.uint16))
        before = codes[-(max(ORDERS) - 1) :]
        yield np.concatenate(out)


def histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text's subwords fall into, and their shares; at most BUCKETS, however long the text."""
    parts = list(subwords(text)) if len(text) <= PIECE else None
    if parts is None:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for rows in subwords(text):
            counts += np.bincount(rows, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        n = counts[at]
    else:
        at, n = np.unique(np.concatenate(parts or [np.empty(0, np.uint16)]), return_counts=True)
    return at.astype(np.uint16), (n / max(1, n.sum())).astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    """scores: for each bucket, the class scores its embedding adds, and 1 in the last column if the sample has it; the mean over
    subwords goes to the softmax. A prediction of a lower score than ``reject_below`` is rejected, and one about a text of which
    the sample has a smaller share than ``least_seen``."""

    languages: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    least_seen: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its score and whether it is rejected."""
        total, n = np.zeros(len(self.languages) + 1), 0
        for rows in subwords(text or "") if self.languages else ():
            total += self.scores[rows].sum(axis=0, dtype=np.float64)
            n += len(rows)
        if not n:
            return UNKNOWN, 0.0, True
        *z, seen = total / n
        z = np.array(z) + self.bias
        p = np.exp((z - z.max()) / self.temperature)
        best = int(p.argmax())
        score = float(p[best] / p.sum())
        return self.languages[best], score, bool(not score >= self.reject_below or seen < self.least_seen)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _descend(train: list, names: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Class scores of each bucket, and the bias, by stochastic gradient descent over (buckets, shares, language)."""
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIM))  # subwords that no text of the sample has say nothing
    soft, bias = rng.normal(0, 0.5, (DIM, names)), np.zeros(names)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            buckets, share, y = train[i]
            step = rate * (1 - done / steps)
            mean = share @ table[buckets]
            err = _softmax(mean @ soft + bias)
            err[y] -= 1
            back = soft @ err
            # both moves are held to a share of what would undo the error, whatever the weights' size: the mean by the size of
            # the softmax, the softmax by the size of the mean. A bucket moves by its share, scaled so that the mean moves by step.
            spread = share @ share * (1 + (soft * soft).sum())
            soft -= step / (1 + mean @ mean) * np.outer(mean, err)
            bias -= step * 0.1 * err
            table[buckets] -= (step / spread) * share[:, None] * back
            done += 1
    return (table @ soft).astype(np.float32), bias


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 4, rate: float = 1.0, tries: int = 3, good: float = 0.98, keep_share: float = 0.999, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent over histograms of texts; every eighth is held back for calibration. A model that isn't finite
    or is right about less than ``good`` of those is trained again at a third of the rate, up to ``tries`` times; the best is kept."""
    names = tuple(sorted(set(langs)))
    at = {x: i for i, x in enumerate(names)}
    known = [(b.astype(np.int64), s.astype(np.float64), at[y]) for (b, s), y in zip(rows, langs, strict=True) if len(b)]
    if not known:
        return LanguageModel((), np.zeros((BUCKETS, 1), np.float32), np.zeros(0), 1.0, 0.0)
    apart = len(known) >= 16
    held, train = known[::8] if apart else known, [r for i, r in enumerate(known) if i % 8] if apart else known
    y = np.array([r[2] for r in held])
    best = None
    for k in range(tries):
        scores, bias = _descend(train, len(names), epochs * (1 + k), rate / 3**k, seed)
        z = np.array([s @ scores[b] + bias for b, s, _ in held])
        right = float((z.argmax(axis=1) == y).mean()) if np.isfinite(scores).all() and np.isfinite(z).all() else -1.0
        if best is None or right > best[0]:
            best = right, scores, bias, z
        if right >= good:
            break
    right, scores, bias, z = best
    if right < 0:
        raise ArithmeticError("language model: training diverged at every rate")

    def loss(t: float) -> float:
        logp = z / t - (z / t).max(axis=1, keepdims=True)
        return float(-(logp[np.arange(len(y)), y] - np.log(np.exp(logp).sum(axis=1))).mean())

    # few texts held back would let a temperature far below 1 look best
    temperature = min((0.8 * 1.25**k for k in range(12)), key=loss)
    p = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    top = p.max(axis=1) / p.sum(axis=1)
    sure = np.sort(top[z.argmax(axis=1) == y])
    seen = np.zeros((BUCKETS, 1), dtype=np.float32)
    for buckets, _, _ in train:
        seen[buckets] = 1
    shares = np.sort([s @ seen[b, 0] for b, s, _ in held])
    # all but 1 - keep_share of the right predictions pass, with a margin
    least = lambda x: float(x[int((1 - keep_share) * len(x))]) if len(x) else 0.0
    return LanguageModel(names, np.hstack([scores, seen]), bias, temperature, min(0.4, 0.9 * least(sure)), min(0.5, 0.7 * least(shares)))


def held_out(doc_id):  # noqa: ANN001, ANN201
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts become histograms where they are: what goes to the driver is bounded by BUCKETS, not by a text's length."""
    for pdf in batches:
        found = [histogram(t) for t in pdf["text"]]
        yield pd.DataFrame({"key": pdf["key"], "lang": pdf["lang"], "buckets": [b.tobytes() for b, _ in found], "shares": [s.tobytes() for _, s in found]})


def learn(docs: DataFrame, per_language: int = 800) -> LanguageModel:
    """Fit on about ``per_language`` labelled documents of each language, and on about 100 times as many in all (the documented
    bounds): where there are more than 100 languages each has its share of that, and one document at least. Documents are drawn by hash
    from those that aren't held out; rows with a null lang or text aren't used, and rows equal in id, lang and text count once."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("doc_id", "lang", "text", F.xxhash64(F.lit("langid"), "doc_id", "lang", "text").alias("h"))
    n = materialise(rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"), F.min("h").alias("least")), "langid-languages")
    share = min(per_language, 100 * per_language / max(1, n.count()))
    draw = (F.pmod("h", F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000 * share)) | (F.col("h") == F.col("least"))
    got = rows.join(n, F.col("lang") == F.col("of")).where(draw).select(F.md5("text").alias("key"), "lang", "text", "doc_id").distinct()
    got = got.select("key", "lang", "text").mapInPandas(_histograms, "key string, lang string, buckets binary, shares binary")
    sample = sorted((r.key, r.lang, bytes(r.buckets), bytes(r.shares)) for r in got.toLocalIterator())
    return fit([(np.frombuffer(b, np.uint16), np.frombuffer(s, np.float32)) for _, _, b, s in sample], [y for _, y, _, _ in sample])


def predictor(docs: DataFrame, model: LanguageModel):  # noqa: ANN201
    """A column function text -> struct(lang_pred, score, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    predict = predictor(docs, model or learn(docs))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The documents whose language isn't rejected, with all their columns."""
    predict = predictor(docs, model or learn(docs))
    return docs.where(~predict("text")["rejected"])
