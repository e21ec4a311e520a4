"""Vector code compression: product quantisation by exact k-means with norm-of-sum bounds.

Vectors are cut into parts, each with a codebook of its own. Of every part of a vector a row keeps its entry and, for each group of entries, a
lower bound on the distance to all others of the group, with the round the bound was taken in. The codebooks of all rounds are kept: a bound of
round s holds in round t less the largest of its group's true net displacements from s to t, |c(t) - c(s)|, which is never more than the sum
of the displacements of each round between and less wherever entries turn. Only the groups whose bound doesn't exceed the exact
distance to the row's own entry are scanned again, exactly. Distances are of whole numbers, and bounds are kept with a margin over
rounding, so the codes are those of a full scan, ties included.

Groups are entries that lie next to each other on the first codebook's leading principal direction. Each round writes the rows' state to the
shared folder; sums for the next codebooks are made in the tasks, exactly, and have as many rows as the codebooks have numbers.

Defined results: rows whose vector is null or holds null or non-finite components go; shorter vectors are padded with zeros, to a multiple of
the number of parts; the first entries are the parts of the rows that are smallest by id (null last), then vector, and fewer where there
are fewer rows; rows that repeat count each; a component beyond a long becomes the largest or smallest long, and an error beyond a long
is null; an empty table gives no rows; all columns but the vector are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import drop_stages, mark

from .common import fresh, materialise
from .vectors import EXACT, exact_sums, integers, largest, matrix

SCALE, PARTS, ENTRIES, ROUNDS, GROUP = 1024, 4, 256, 4, 16

#: What a bound gives up against rounding, by share; distances are off by some 1e-16, in single precision by 6e-8.
MARGIN = 1e-6


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries, as a matrix."""
    if not parts.size or not entries.size:
        return np.zeros((len(parts), len(entries)), np.int64)
    most = 2 * largest(parts, entries)
    if most * most * parts.shape[1] < EXACT:
        p, c = parts.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    wide = parts.astype(object)[:, None, :] - entries.astype(object)[None, :, :]
    return (wide * wide).sum(axis=2)


def own_squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row and its own entry."""
    most = 2 * largest(parts, entries)
    kind = np.int64 if most * most * max(1, parts.shape[1]) < EXACT else object
    gap = parts.astype(kind) - entries.astype(kind)
    return (gap * gap).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass
class Codebooks:
    """All rounds' entries of one part position, and its groups."""

    rounds: list[np.ndarray]
    groups: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        first = self.rounds[0]
        if not self.groups and len(first):
            centred = first.astype(np.float64) - first.astype(np.float64).mean(axis=0)
            along = centred @ np.linalg.svd(centred / max(1.0, np.abs(centred).max(initial=1.0)), full_matrices=False)[2][0] if centred.shape[1] else np.zeros(len(first))
            order = np.argsort(along, kind="stable")
            self.groups = [np.sort(order[k : k + GROUP]) for k in range(0, len(order), GROUP)]

    def displacements(self, summed: bool = False) -> np.ndarray:
        """By group and round: the farthest that an entry of the group has come from that round to now. ``summed``: what the displacements of
        single rounds would give."""
        now = self.rounds[-1]
        moved = lambda a, b: roots(own_squared(a, b)) if len(a) else np.zeros(0)
        if summed:
            steps = [np.array([moved(a, b)[g].max() for g in self.groups]) for a, b in zip(self.rounds, self.rounds[1:])]
            return np.stack([*(sum(steps[k:]) for k in range(len(steps))), np.zeros(len(self.groups))], axis=1)
        return np.stack([np.array([moved(old, now)[g].max() for g in self.groups]) for old in self.rounds], axis=1)


def assign(parts: np.ndarray, code: np.ndarray | None, low: np.ndarray | None, stamp: np.ndarray | None, books: Codebooks, away: np.ndarray) -> tuple[np.ndarray, ...]:
    """code, squared distance, bounds, their rounds, and how many distances were taken, for rows of one part position. Without a code, all
    entries are scanned."""
    now, t, n = books.rounds[-1], len(books.rounds) - 1, len(parts)
    groups = books.groups
    place = np.empty(len(now), np.int64)
    for g, members in enumerate(groups):
        place[members] = g
    if code is None:
        code, best = np.full(n, len(now)), np.full(n, np.inf)
        low, stamp, scan = np.zeros((n, len(groups)), np.float32), np.full((n, len(groups)), t, np.uint8), np.ones((n, len(groups)), bool)
        was, own = None, None
    else:
        code, stamp, was = code.astype(np.int64), stamp.copy(), code.astype(np.int64)
        own = own_squared(parts, now[code])
        best = own
        held = low - away[np.arange(len(groups)), stamp]
        scan = held * (1 - MARGIN) - MARGIN <= roots(own)[:, None]
        low = low.copy()
    # squares over 2 ** 63 are Python's numbers; comparisons are the same
    best = best.astype(object) if best.dtype == object else best.astype(np.float64)
    taken, seen = 0 if own is None else n, {}
    for g, members in enumerate(groups):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        d = squared(parts[rows], now[members])
        seen[g] = rows, d
        taken += d.size
        if d.dtype == object and best.dtype != object:
            best = np.array([x if x == np.inf else int(x) for x in best], object)
        k = d.argmin(axis=1)  # the first of equal ones, which is the lowest entry
        nearest, entry = d[np.arange(len(rows)), k], members[k]
        better = (nearest < best[rows]) | ((nearest == best[rows]) & (entry < code[rows]))
        best[rows[better]], code[rows[better]] = nearest[better], entry[better]
    for g, (rows, d) in seen.items():
        others = np.where(groups[g][None, :] == code[rows][:, None], np.inf, d.astype(np.float64))
        low[rows, g] = np.sqrt(others.min(axis=1)) * (1 - MARGIN)
        stamp[rows, g] = t
    if was is not None:
        # an entry that was left is one of the others now; where its group wasn't scanned, the bound must cover it
        left = np.flatnonzero((was != code) & ~scan[np.arange(n), place[was]])
        g = place[was[left]]
        low[left, g] = np.minimum(held[left, g], roots(own[left]) * (1 - MARGIN))
        stamp[left, g] = t
    return code, best, low, stamp, taken


def first_books(rows: DataFrame, id_of: Column, x: str, dims: int, parts: int, entries: int) -> list[Codebooks]:
    """The first entries: the rows that are smallest by id, then vector. As many rows as entries reach the driver."""
    got = [r[0] for r in rows.orderBy(id_of.asc_nulls_last(), x).select(x).limit(entries).collect()]
    wide = dims // parts
    first = np.array(got, np.int64).reshape(len(got), dims)
    return [Codebooks([first[:, p * wide : (p + 1) * wide]]) for p in range(parts)]


def next_books(state: DataFrame, x: str, code: str, books: list[Codebooks], dims: int) -> list[Codebooks]:
    """With another round: the floors of the means of what each entry holds; entries that hold nothing stay."""
    parts, k = len(books), len(books[0].rounds[0])
    wide = dims // parts

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        vectors, codes = matrix(batch.column(0), dims), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
        kind = np.int64 if largest(vectors) * max(1, len(vectors)) < 1 << 62 else object
        out = np.zeros((parts, k, wide + 1), kind)
        for p in range(parts):
            order = np.argsort(codes[:, p], kind="stable")
            used, start = np.unique(codes[order, p], return_index=True)
            if len(used):
                out[p, used, :wide] = np.add.reduceat(vectors[order, p * wide : (p + 1) * wide].astype(kind), start, axis=0)
                out[p, used, wide] = np.diff(np.append(start, len(order)))
        return out.ravel().astype(object)

    got = exact_sums(state.select(x, code), sums, parts * k * (wide + 1))
    totals = np.array(got, object).reshape(parts, k, wide + 1)
    out = []
    for p, book in enumerate(books):
        now = book.rounds[-1].copy()
        for e in range(k):
            if n := totals[p, e, wide]:
                now[e] = [s // n for s in totals[p, e, :wide]]
        out.append(Codebooks([*book.rounds, now], book.groups))
    return out


def step(rows: DataFrame, x: str, names: list[str], books: list[Codebooks], dims: int, first: bool) -> DataFrame:
    """The rows with their state after the newest round: names are those of code, error, bounds, rounds, distances taken."""
    code, error, low, stamp, taken = names
    wide, away = dims // len(books), [b.displacements() for b in books]
    n_groups = [len(b.groups) for b in books]
    schema = f"{code} binary, {error} decimal(38,0), {low} binary, {stamp} binary, {taken} int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vectors = matrix(batch.column(x), dims)
            state = None if first else [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, -1) for c, kind in ((code, np.uint8), (low, np.float32), (stamp, np.uint8))]
            codes, lows, stamps, errors, scans = [], [], [], np.zeros(n, object), 0
            at = np.cumsum([0, *n_groups])
            for p, book in enumerate(books):
                of = (None, None, None) if first else (state[0][:, p], state[1][:, at[p] : at[p + 1]], state[2][:, at[p] : at[p + 1]])
                c, e, lo, st, k = assign(vectors[:, p * wide : (p + 1) * wide], *of, book, away[p])
                codes.append(c.astype(np.uint8)), lows.append(lo.astype(np.float32)), stamps.append(st)
                errors += np.array([int(v) for v in e], object)
                scans += k
            joined = [np.ascontiguousarray(np.stack(codes, axis=1) if c is codes else np.concatenate(c, axis=1)) for c in (codes, lows, stamps)]
            blobs = [pa.array([r.tobytes() for r in j], pa.binary()) for j in joined]
            per_row = np.full(n, scans // max(1, n), np.int32)
            per_row[: scans % max(1, n)] += 1
            kept = [batch.column(f.name) for f in batch.schema if f.name not in names]
            most = 10**38
            yield pa.RecordBatch.from_arrays([*kept, blobs[0], pa.array([v if v < most else None for v in errors], pa.decimal128(38, 0)), blobs[1], blobs[2], pa.array(per_row)], [*(f.name for f in batch.schema if f.name not in names), *names])

    kept = rows.drop(*names)
    whole = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(run, f"{whole}, {schema}")


@dataclass
class Compressed:
    """rows: all columns but the vector, and code (binary, a byte a part), error (decimal), taken (distances taken in the last round); books: the codebooks of
    all rounds by part position; scanned: how many distances each round took."""

    rows: DataFrame
    books: list[Codebooks]
    scanned: list[int]


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, code: str = "code", error: str = "error") -> Compressed:
    """Assigns all rows in each of ``rounds`` rounds and once more, and moves the entries after each round."""
    if not 1 <= entries <= 256 or not 0 <= rounds < 255:
        raise ValueError("up to 256 entries and 254 rounds: codes and rounds are kept in a byte")
    kept = [c for c in vectors.columns if c != vector]
    spark, since = vectors.sparkSession, mark(vectors.sparkSession)
    x, low, stamp, taken = (fresh(n, [*vectors.columns, code, error]) for n in ("x", "low", "stamp", "taken"))
    rows, dims = integers(vectors, scale, x, vector, parts)
    state = materialise(rows.drop(vector), "codes-rows")
    books = first_books(state, F.col(id_column), x, dims, parts, entries)
    names, scanned = [code, error, low, stamp, taken], []
    for r in range(rounds + 1):
        state = materialise(step(state, x, names, books, dims, first=r == 0), "codes-state")
        scanned.append(state.agg(F.sum(F.col(taken).cast("long"))).first()[0] or 0)
        drop_stages(spark, since, keep=(state,))  # the state before it is of no use any more
        if r < rounds:
            books = next_books(state, x, code, books, dims)
    return Compressed(state.select(*kept, code, error), books, scanned)


def numbers_of(books: list[Codebooks]) -> str:
    """The last round's entries as decimal numbers, by part, entry and place."""
    return ",".join(str(int(v)) for b in books for v in b.rounds[-1].ravel())


def decode(codes: np.ndarray, books: list[Codebooks]) -> np.ndarray:
    """The vectors, as whole numbers, that rows of codes stand for."""
    return np.concatenate([b.rounds[-1][codes[:, p]] for p, b in enumerate(books)], axis=1)
