"""BPE encoding and decoding by prefix-sharing trie traversal.

Of each run of texts the distinct words go into a trie in sorted order, so that the path from the root to the current
word is a stack. Every node of the path holds one state: the last token of its prefix's encoding. A node's state follows
from those of its ancestors: it is the one token that ends there and may follow the last token of the prefix before it,
so shared prefixes are encoded once and a word's tokens are read off by walking back from its node.

Defined results: a null text encodes as an empty one, to no tokens; a special token's text is that token, as the
tokenizers library has it by default; rows that repeat encode alike; any length of text or word is encoded whole; an empty table
gives no rows; columns that aren't asked for may have any names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

#: The split pattern of byte-level BPE.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE. A token's rank is the place of the merge that makes it."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.id_of = {raw(s): i for s, i in model["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = self.id_of[raw(a)], self.id_of[raw(b)], self.id_of[raw(a) + raw(b)]
            self.rank[x, y] = r
            if z not in self.made:
                self.halves[z], self.made[z] = (x, y), r
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_text = {i: s.encode() for s, i in self.specials.items()}
        #: What a token can begin with, -1 where that is no token itself: bounds how far back a token that ends at some
        #: byte can start.
        self.begins = {b[:n]: -1 for b in self.id_of for n in range(1, len(b))} | self.id_of

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


class TrieEncoder:
    """Encodes distinct words in sorted order over one stack of last-token states; keeps a bounded cache of words, in two halves: when the
    newer one is full the older one goes, but for the words that were seen again."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int = 300_000):
        self.v, self.half = vocabulary, cache_words // 2
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.follows: dict[int, bool] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")") if vocabulary.specials else None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their bytes are encoded together: no merge across their border comes before
        the merges that make the tokens at that border."""
        key = a << 32 | b
        known = self.follows.get(key)
        if known is None:
            known = self._apart(a, b)
            if len(self.follows) > 500_000:
                self.follows.clear()
            self.follows[key] = known
        return known

    def _apart(self, a: int, b: int) -> bool:
        rank, halves, made = self.v.rank, self.v.halves, self.v.made
        end = len(rank)
        before = end  # a border merge must come before this one to happen
        while True:
            if rank.get((a, b), end) < before:
                return False
            made_a, made_b = made.get(a, -1), made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            # undo the later of the two merges; of equal ones the left was done first
            if made_a > made_b:
                before, a = made_a, halves[a][1]
            else:
                before, b = made_b + 1, halves[b][0]

    def insert(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Depth-first over the trie of sorted distinct words. last[i] is the token that ends the encoding of the
        path's first i bytes; a word keeps the states of the prefix that it shares with the one before it."""
        begins, bytes_of = self.v.begins.get, self.v.bytes_of
        follow, apart = self.follows.get, self.may_follow
        last, low = [0], [0]  # low[i]: the first byte at which a token that goes on beyond byte i can begin
        path = b""
        for word in words:
            n, top = 0, min(len(path), len(word))
            if path[:top] == word[:top]:
                n = top
            else:
                while path[n] == word[n]:
                    n += 1
            del last[n + 1 :], low[n + 1 :]
            first = low[n]
            for end in range(n + 1, len(word) + 1):
                while (token := begins(word[first:end])) is None:
                    first += 1
                start = first
                while token < 0 or start and not (follow(last[start] << 32 | token) or apart(last[start], token)):
                    start += 1
                    token = begins(word[start:end], -1)
                last.append(token)
                low.append(first)
            path = word
            out, at = [], len(word)
            while at:
                token = last[at]
                out.append(token)
                at -= len(bytes_of[token])
            out.reverse()
            yield tuple(out)

    def _learn(self, words: set[str]) -> None:
        """Puts all words of some texts into the newer half."""
        if len(self.words) > self.half:
            self.words, self.older = {}, self.words
        known, older, new = self.words, self.older, []
        for w in words:
            if w not in known:
                found = older.get(w)
                if found is None:
                    new.append((w.encode("utf-8", "surrogatepass"), w))
                else:
                    known[w] = found
        new.sort()
        known.update(zip((w for _, w in new), self.insert([b for b, _ in new]), strict=True))

    def parts(self, text: str) -> list[str]:
        """A text cut at special tokens, which stay as parts."""
        return self.split.split(text) if self.split else [text]

    def encode_all(self, texts: list[str], piece: int = 1 << 20) -> Iterator[list[int]]:
        """Token ids of whole texts, in order. The distinct words of all texts of up to ``piece`` characters go into one
        trie; longer texts are encoded piece by piece of their list of words."""
        special = self.v.specials
        split = [[x if x in special else WORD.findall(x) for x in self.parts(t)] if len(t) <= piece else None for t in texts]
        self._learn({w for parts in split if parts for x in parts if x.__class__ is list for w in x})
        group = self.words  # holds these texts' words, whatever a long text between them needs
        for text, parts in zip(texts, split, strict=True):
            ids: list[int] = []
            for x in parts if parts is not None else self._pieces(text, piece // 8):
                if x.__class__ is list:
                    known = group
                    if parts is None:
                        self._learn(set(x))
                        known = self.words
                    ids.extend(chain.from_iterable(map(known.__getitem__, x)))
                else:
                    ids.append(special[x])
            yield ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def _pieces(self, text: str, many: int) -> Iterator[list[str] | str]:
        for part in self.parts(text):
            if part in self.v.specials:
                yield part
                continue
            some: list[str] = []
            for m in WORD.finditer(part):
                some.append(m[0])
                if len(some) >= many:
                    yield some
                    some = []
            yield some

    def decode(self, ids: list[int]) -> str:
        known, special = self.v.bytes_of, self.v.special_text
        try:
            raw = b"".join([known[i] for i in ids])
        except KeyError:
            raw = b"".join([known[i] if i in known else special.get(i, b"") for i in ids])
        return raw.decode("utf-8", "replace")


def groups(texts: Iterable[str | None], size: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters."""
    some, n = [], 0
    for t in texts:
        some.append(t or "")
        n += len(some[-1])
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def encoder(spark: SparkSession, path: str):  # noqa: ANN201
    """A column function text -> array of token ids. The vocabulary file is read on the driver; its size is fixed."""
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))

    @pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = TrieEncoder(shared.value)
        for texts in batches:
            out: list[np.ndarray] = []  # a batch's ids wait as packed arrays, a ninth of the size of lists
            for some in groups(texts):
                out += (np.array(ids, dtype=np.int32) for ids in e.encode_all(some))
            yield pd.Series(out, index=texts.index, dtype=object)

    return encode


def encode_documents(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and ids, one row per document. Rows leave in runs of a million characters of text, so that neither
    side ever holds more than the ids of one run."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = TrieEncoder(shared.value)
        for batch in batches:
            at = 0
            for some in groups(batch.column("text").to_pylist()):
                ids = [np.array(x, dtype=np.int32) for x in e.encode_all(some)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], names=[*keep, "ids"])
                at += len(some)

    return docs.select(*keep, "text").mapInArrow(run, out)


def decoder(spark: SparkSession, path: str):  # noqa: ANN201
    """A column function array of token ids -> text."""
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))

    @pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = TrieEncoder(shared.value)
        for ids in batches:
            yield pd.Series([None if x is None else e.decode(list(x)) for x in ids], index=ids.index, dtype=object)

    return decode


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode each whole text and keep only digests."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = TrieEncoder(shared.value)
        digits = {i: str(i) for i in [*e.v.bytes_of, *e.v.special_text]}
        for texts in batches:
            out = []
            for some in groups(texts):
                for ids in e.encode_all(some):
                    said = ",".join([digits[i] for i in ids]).encode()
                    out.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(e.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run("text").alias("d")).select("doc_id", "d.*")
