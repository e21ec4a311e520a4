"""License scans by an exact set-similarity join.

A text's words are read once. Phrases are looked for word by word; beside that, every block of a text is joined with license templates by
containment: the share of a template's distinct words that the block holds. A template of n words meets blocks of 2w words that begin at every
w-th word, w being the least power of two from n on, so that any n words in a row lie in one block. The join is exact: words are ordered by their
frequency in all documents, rarest first, and a block is compared with a template only if

- it has as many template words as the least demanding template asks for (length filter),
- the two share a word of their prefixes, the rarest words of each that can't all be missing (prefix filter),
- enough words follow that first shared word on both sides (positional filter).

Defined results: a null text is an empty one, with no words; rows that repeat are scanned alike, each for itself; a row's label counts
once, however many blocks hold it; where templates hold each other's words, all that reach the threshold are reported; templates with the
same label count as one label; texts and words of any length are read whole; an empty table gives no rows; only doc_id and text are read, so
other columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Phrases whose words stand in a row, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices by which licenses are granted, with their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8

#: Bytes of words, A-Z lower-cased, all others a blank. Bytes from 0x80 on belong to other characters, which are parts of words.
_WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def places(ids: np.ndarray, phrase: Sequence[int]) -> np.ndarray:
    """Where the words of a phrase stand in a row."""
    at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at


class Templates:
    """Templates by their words' numbers: distinct words, how many of them a block must hold, and the step between its blocks."""

    def __init__(self, templates: Sequence[tuple[str, str]], containment: float, phrases: Sequence[tuple[str, str]] = ()):
        if not 0 < containment <= 1:
            raise ValueError("containment must be over 0 and at most 1")
        split = [words_of(t.encode()) for t, _ in templates]
        phrased = [words_of(p.encode()) for p, _ in phrases]
        if not all(split) or not all(phrased):
            raise ValueError("a template or phrase without a word")
        #: template words come first, so that a number under n_words tells them
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        self.n_words = len(self.number)
        self.phrases = []
        for ws, (_, label) in zip(phrased, phrases, strict=True):
            self.phrases.append((label, [self.number.setdefault(w, len(self.number)) for w in ws]))
        self.sets = [{self.number[w] for w in ws} for ws in split]
        self.labels = [label for _, label in templates]
        self.steps = [1 << (len(ws) - 1).bit_length() for ws in split]
        self.least = [next(k for k in range(1, len(s) + 1) if k >= containment * len(s) - 1e-9) for s in self.sets]

    def asked(self) -> dict[int, int]:
        """The fewest words that a template of each step asks for."""
        return {w: min(k for k, s in zip(self.least, self.steps, strict=True) if s == w) for w in sorted({*self.steps})}


def read_words(docs: DataFrame, known: Templates) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels), at and word (places and numbers of template words), row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base", "at", "word")}
            for text in batch.column("text").cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                ids = np.fromiter(map(known.number.get, words, repeat(-1)), np.int32, len(words))
                found = [(label, places(ids, phrase)) for label, phrase in known.phrases]
                starts = np.concatenate([np.empty(0, np.int64), *(at for _, at in found)])
                at = np.flatnonzero((ids >= 0) & (ids < known.n_words))
                for k, v in zip(out, (len(words), len(starts), starts.min() if len(starts) else None, starts.max() if len(starts) else None, sorted({label for label, a in found if len(a)}), at.astype(np.int32), ids[at]), strict=True):
                    out[k].append(v)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, at array<int>, word array<int>"
    return docs.select("doc_id", "text").mapInArrow(read, schema).withColumn("row", F.monotonically_increasing_id())


def frequencies(rows: DataFrame, n_words: int) -> np.ndarray:
    """How often each template word stands in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_words)
        yield pa.RecordBatch.from_pydict({"word": np.arange(n_words, dtype=np.int32), "n": total})

    out = np.zeros(n_words, np.int64)
    for r in rows.select("word").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


def blocks_of(rows: DataFrame, rank: np.ndarray, asked: dict[int, int]) -> DataFrame:
    """row, step, block, words: the distinct template words of each block that has enough of them, rarest first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, word = batch.column("row").to_numpy(), batch.column("at"), batch.column("word")
            of = np.repeat(np.arange(len(row)), np.diff(at.offsets.to_numpy()))
            at, word = at.flatten().to_numpy().astype(np.int64), rank[word.flatten().to_numpy()]
            for step, least in asked.items():
                # block k covers the words from k * step on, so a word is in two blocks; the key orders by text, block, rank
                wide = int(at.max(initial=0)) // step + 1
                k = at // step
                both = np.concatenate([of * wide + k, (of * wide + k - 1)[k > 0]])
                keys = np.unique(both * len(rank) + np.concatenate([word, word[k > 0]]))
                block, first = np.unique(keys // len(rank), return_index=True)
                n = np.diff(np.append(first, len(keys)))
                keep = n >= least
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[keep])]), pa.int32()), pa.array((keys % len(rank))[np.repeat(keep, n)], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(row[block[keep] // wide]), pa.array(np.full(keep.sum(), step, np.int32)), pa.array(block[keep] % wide), lists], ["row", "step", "block", "words"])

    return rows.select("row", "at", "word").mapInArrow(cut, "row long, step int, block long, words array<int>")


def matches(rows: DataFrame, known: Templates) -> DataFrame:
    """row, block, step, label, containment for every block and template that reach the threshold."""
    counted = frequencies(rows, known.n_words)
    rank = np.empty(known.n_words, np.int64)
    rank[np.lexsort([np.arange(known.n_words), counted])] = np.arange(known.n_words)
    asked = known.asked()
    blocks = blocks_of(rows, rank, asked)
    templates = [(label, step, sorted(int(rank[w]) for w in s), least) for label, step, s, least in zip(known.labels, known.steps, known.sets, known.least, strict=True)]
    table = rows.sparkSession.createDataFrame(templates, "label string, step int, t_words array<int>, least int")
    # the words of a template's prefix and of a block's: of two sets that share enough, the first shared word is in both
    prefixed = table.select("*", F.posexplode(F.slice("t_words", F.lit(1), F.size("t_words") - F.col("least") + 1)).alias("i", "w"))
    fewest = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])[F.col("step")]
    probes = blocks.select("*", F.posexplode(F.slice("words", F.lit(1), F.size("words") - fewest + 1)).alias("j", "w"))
    pairs = probes.join(prefixed, ["step", "w"])
    first = ~F.arrays_overlap(F.slice("words", F.lit(1), F.col("j")), F.slice("t_words", F.lit(1), F.col("i")))
    enough = F.least(F.size("words") - F.col("j"), F.size("t_words") - F.col("i")) >= F.col("least")
    shared = F.size(F.array_intersect("words", "t_words"))
    found = pairs.where(enough & first).withColumn("shared", shared).where(F.col("shared") >= F.col("least"))
    return found.select("row", "step", "block", "label", (F.col("shared") / F.size("t_words")).alias("containment"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (array), labels (array), score for each document; score is the best containment
    that reaches the threshold, 1 where a phrase stands, else 0. The templates, a parameter, travel with the tasks; no text does."""
    known = Templates(templates, containment, phrases)
    rows = materialise(read_words(docs, known), "license-words")
    best = matches(rows, known).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = rows.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(best, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_sort("base").alias("base"), labels.alias("labels"), score.alias("score"))
