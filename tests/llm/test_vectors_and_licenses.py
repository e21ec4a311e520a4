"""Whitening, license scans and vector codes against brute force on small inputs, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import codes, license, queries, vectors, whitening

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"
#: null, null and non-finite components, short, empty, repeated and equal rows, no id, no label, huge
ODD = [
    (7, None, 1), (8, [None, 1.0, 2.0, 3.0], 1), (9, [float("nan"), 0.0, 0.0, 0.0], 2), (10, [float("inf"), 0.0, 0.0, 0.0], 2), (3, [0.5, -0.25, 0.125, 1.0], 1), (3, [0.5, -0.25, 0.125, 1.0], 1), (4, [0.5, -0.25, 0.125, 1.0], None),
    (1, [0.1, 0.2], None), (5, [], 2), (None, [0.3, -0.3, 0.7, -0.7], 2), (6, [-0.001, 0.001, -0.999, 0.25], 3), (11, [3.0, -2.0, 0.0, 1.5], 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, VEC).withColumn("x", F.lit(1)).withColumn("code", F.lit("c"))


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def whole(rows, scale, dims):
    """Kept rows, as whole numbers: (id, label, numbers)."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(r[0], r[2], [int(np.floor(scale * float(np.float32(x)))) for x in r[1]] + [0] * (dims - len(r[1]))) for r in fine]


# --- whitening


def orthonormal(n, seed):
    """A random orthonormal matrix in extended precision."""
    q = np.random.default_rng(seed).standard_normal((n, n)).astype(np.longdouble)
    for _ in range(3):
        for k in range(n):
            q[:, k] -= q[:, :k] @ (q[:, :k].T @ q[:, k])
            q[:, k] /= np.sqrt((q[:, k] ** 2).sum())
    return q


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1, 31) / 7,
        np.concatenate([1 + np.arange(6) * 1e-9, 3 + np.arange(5) * 1e-6, [4, 5, 6]]),
        np.concatenate([2 + np.arange(4) * 1e-12, [2.5, 2.5 + 1e-10, 9]]),
        1 + np.arange(12) * 1e-8,
        1 + np.arange(40) * 1e-3,
        np.array([1.0, 1e-6, 1e-12]),
    ],
)
def test_eigenvectors_are_corrected_in_clusters_too(values):
    n = len(values)
    q = orthonormal(n, 3)
    values = values.astype(np.longdouble)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigen(a)
    order = np.argsort(-values)
    assert np.abs(got - values[order]).max() < 1e-17 * n * np.abs(values).max()
    cos = np.abs((x * q[:, order]).sum(axis=0))
    gap = min(np.diff(np.sort(values))) / values.max()
    # single precision alone is off by 1e-7 over the gap, double precision by 1e-16 over it
    assert float((1 - cos).max()) < max(1e-15, float((1e-17 * n / gap) ** 2))
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-17 * n


def test_equal_eigenvalues_get_some_basis():
    for values in ([2.0, 2.0, 2.0, 1.0], [1.0, 1.0], [0.0, 0.0, 0.0], [5.0], [1.0, 0.0, 0.0]):
        q = orthonormal(len(values), 1)
        a = (q * np.array(values, np.longdouble)) @ q.T
        got, x = whitening.eigen((a + a.T) / 2)
        assert np.allclose(got.astype(float), values, atol=1e-16) and np.abs(a @ x - x * got).max() < 1e-17 * 8


def plain_whitening(rows, dims, components=4):
    kept = whole(rows, 256, dims)
    fit = np.array(sorted({tuple(x) for _, _, x in kept}), float)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    s = [sum(int(x[d]) for x in {tuple(k[2]) for k in kept}) for d in range(dims)]
    out = []
    for i, _, x in kept:
        deviation = sum((n * int(c) - t) ** 2 for c, t in zip(x, s, strict=True))
        for k in range(min(components, dims)):
            z = (np.array(x, float) - mean) @ vectors_[:, k] / np.sqrt(values[k]) if values[k] > 1e-9 else None
            out.append((i, k + 1, n, deviation, z, values[k] / values.sum()))
    return out


def compare_whitening(got, want):
    assert sorted(((r.vec_id, r.component, r.n, int(r.deviation)) for r in got), key=str) == sorted(((i, k, n, d) for i, k, n, d, _, _ in want), key=str)
    plain = {(i, k, d): (z, e) for i, k, _, d, z, e in want}
    for k in {r.component for r in got}:
        pairs = [(r.whitened, plain[r.vec_id, k, int(r.deviation)][0]) for r in got if r.component == k]
        assert all((a is None) == (b is None) for a, b in pairs)
        a, b = (np.array([p[i] for p in pairs if p[i] is not None]) for i in (0, 1))
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)
    assert all(abs(r.explained - plain[r.vec_id, r.component, int(r.deviation)][1]) <= 1e-9 for r in got)
    assert max((r.identity_error for r in got), default=0) < 1e-9


def test_whitening_against_plain_covariance(spark, given, odd):
    compare_whitening(queries.op11_whitening(spark, SF).collect(), plain_whitening([tuple(r) for r in given.collect()], 64))
    compare_whitening(whitening.whiten(odd).collect(), plain_whitening(ODD, 4))


def test_whitening_of_nothing_much(spark):
    make = lambda *rows: whitening.whiten(spark.createDataFrame(rows, VEC)).collect()
    assert make() == [] == make((1, None, 1)) == make((1, [], 1))
    one = make((1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (None, [0.5, 0.25], 1))
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 6
    line = make((1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1))
    assert [(r.vec_id, r.component, abs(r.whitened) if r.whitened is not None else None, r.explained) for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [(1, 1, 1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)]


def test_whitening_of_huge_entries(spark):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([[1e30, 1.0], [-1e30, 2.0], [3.0, 5.0], [4.0, -7.0]])]
    got = whitening.whiten(spark.createDataFrame(rows, VEC)).collect()
    assert len(got) == 8 and max(r.identity_error for r in got) < 1e-6
    x = [[max(-(2**63), min(2**63 - 1, int(np.floor(256 * float(np.float32(c)))))) for c in v] for _, v, _ in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in got if r.deviation is not None} == {i: d for i, d in want.items() if d < 10**38}


def test_exact_sums_of_any_size(spark):
    df = spark.createDataFrame([([2**62, -(2**62), 5],)] * 40, "x array<long>").repartition(7)
    one = vectors.exact_sums(df, lambda b: (vectors.matrix(b.column("x"), 3).astype(object) ** 2).sum(axis=0), 3)
    assert one == [40 * 2**124, 40 * 2**124, 1000]
    for x in (np.array([[3, -4], [2**40, 1]]), np.array([[2**62, 5], [1, 2]]), np.zeros((0, 2), np.int64), np.array([[7, 9]] * 20_000)):
        wide = x.astype(object)
        assert (vectors.gram(x) == (wide.T.dot(wide) if len(x) else np.zeros((2, 2)))).all()


# --- license scans


def plain_scan(text, templates=license.TEMPLATES, phrases=license.PHRASES, containment=license.CONTAINMENT):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    base = [(k, label) for p, label in phrases for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    more, best = set(), 0.0
    for t, label in templates:
        asked, step = set(t.split()), 1
        while step < len(t.split()):
            step *= 2
        for k in range(0, max(1, len(words)), step):
            share = len(asked & set(words[k : k + 2 * step])) / len(asked)
            if share >= containment - 1e-9:
                more.add(label)
                best = max(best, share)
    at = [k for k, _ in base]
    labels = {label for _, label in base}
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(labels), sorted(labels | more), 1.0 if at else best


def scanned(df, **how):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base, r.labels, r.score) for r in license.scan(df, **how).collect()}


def test_scan_against_all_blocks(spark):
    rng = random.Random(5)
    pool = [w for t, _ in license.TEMPLATES for w in t.split()] + ["the", "mit", "License", "cc", "by", "nc", "lorem", "é", "K", "İ", "x\x00y", "a_b", "9"]
    texts = []
    for _ in range(300):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):  # a template, with some words changed, somewhere
            t = rng.choice(license.TEMPLATES)[0].split()
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(pool)
            k = rng.randint(0, len(words))
            words[k:k] = t
        texts.append("".join(w.upper() if rng.random() < 0.1 else w + rng.choice([" ", "\n", ", ", "-", "  "]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for how in ({}, {"containment": 1.0}, {"containment": 0.5}, {"templates": (("a b c", "abc"), ("the", "the"), ("a a b", "ab")), "containment": 0.6}):
        got = scanned(df, **how)
        assert any(set(g[5]) - set(g[4]) for g in got.values())
        for k, t in enumerate(texts):
            assert got[k] == plain_scan(t, **how), t


def test_scan_defined_results(spark):
    long = "word " * 400_000 + "released under the MIT license. " + "wort " * 400_000 + license.TEMPLATES[2][0].replace(" ", "\n* ")
    rows = [(1, None), (2, ""), (None, "CC BY-NC"), (4, "Apache License, Version 2.0"), (4, "Apache License, Version 2.0"), (5, long), (6, "x" * 1_000_000), (7, "under the mit license " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("word", F.lit(2)).withColumn("labels", F.lit(3))
    found = license.scan(df).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert tuple(by[1])[1:] == (0, 0, None, None, [], [], 0.0) == tuple(by[2])[1:]
    assert by[None].labels == ["cc-by-nc"] and by[4].labels == ["apache-2"] and sum(r.doc_id == 4 for r in found) == 2
    assert by[5].labels == ["bsd", "mit"] and by[5].base == ["mit"] and by[5].first_word == 400_001 and by[6].n_words == 1
    assert (by[7].n_base, by[7].first_word, by[7].last_word) == (3, 0, 8)
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        license.scan(df, templates=(("...", "none"),))


def test_a_block_meets_a_template_wherever_it_begins(spark):
    t, label = license.TEMPLATES[0]
    words = t.split()
    keep = -(-8 * len(set(words)) // 10)  # just enough different words
    part = list(dict.fromkeys(words))[:keep]
    texts = [("pad " * k) + " ".join(part) + " pad" * 7 for k in range(70)] + [("pad " * k) + " ".join(part[1:]) + " pad" * 7 for k in range(70)]
    got = scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [label in got[k][5] for k in range(140)] == [True] * 70 + [False] * 70


# --- vector codes


def plain_codes(rows, dims, parts=4, entries=256, rounds=4):
    kept = sorted(whole(rows, 1024, dims), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x, w = np.array([k[2] for k in kept], object).reshape(len(kept), dims), dims // parts
    books = [x[:entries, p * w : (p + 1) * w].copy() for p in range(parts)]

    def near(p):
        d = [[int(((v - c) ** 2).sum()) for c in books[p]] for v in x[:, p * w : (p + 1) * w]]
        return [min((s, k) for k, s in enumerate(row)) for row in d]

    for _ in range(rounds):
        for p in range(parts):
            own = [k for _, k in near(p)]
            for e in range(len(books[p])):
                held = [x[i, p * w : (p + 1) * w] for i, k in enumerate(own) if k == e]
                if held:
                    books[p][e] = [s // len(held) for s in sum(held)]
    final = [near(p) for p in range(parts)]
    said = ",".join(str(v) for b in books for v in b.ravel())
    return [(k[0], "".join(f"{final[p][i][1]:02x}" for p in range(parts)), sum(final[p][i][0] for p in range(parts))) for i, k in enumerate(kept)], said


def compressed(df, **how):
    found = codes.compress(df, **how)
    return sorted(((r.vec_id, bytes(r.code).hex(), int(r.error)) for r in found.rows.collect()), key=str), codes.numbers_of(found.books), found


def test_codes_against_full_scans(spark, odd):
    rng = np.random.default_rng(8)
    ties = [(int(i), [float(c) / 1024 for c in rng.integers(-3, 4, 8)], 0) for i in range(400)]
    wide = [(int(i), [float(c) for c in rng.standard_normal(8)], 0) for i in range(300)]
    for rows, dims, entries in ((ties, 8, 40), (wide, 8, 33), (ODD, 4, 256), (ODD, 4, 3)):
        df = odd.drop("x", "code") if rows is ODD else spark.createDataFrame(rows, VEC).repartition(5)
        got, said, found = compressed(df, entries=entries)
        want, numbers = plain_codes(rows, dims, entries=entries)
        assert got == sorted(want, key=str) and said == numbers
    assert max(b.displacements()[:, k].max() for b in found.books for k in range(5)) >= 0


def test_bounds_are_no_looser_than_summed_displacements(given):
    found = codes.compress(given, entries=64)
    assert found.scanned[0] == 500 * 64 * 4 and found.scanned[-1] < found.scanned[0] / 2
    for b in found.books:
        assert (b.displacements() <= b.displacements(summed=True) + 1e-9).all()
        assert (b.displacements() < b.displacements(summed=True) - 1e-9).any()


def test_bounds_hold_in_every_round():
    rng = np.random.default_rng(2)
    x = rng.integers(-1000, 1000, (500, 6))
    books = codes.Codebooks([x[:48]])
    code, _, low, stamp, _ = codes.assign(x, None, None, None, books, books.displacements())
    for _ in range(6):
        now = books.rounds[-1].copy()
        for e in range(48):
            if (code == e).any():
                now[e] = x[code == e].sum(axis=0) // (code == e).sum()
        books = codes.Codebooks([*books.rounds, now], books.groups)
        away = books.displacements()
        code, best, low, stamp, _ = codes.assign(x, code.astype(np.uint8), low.astype(np.float32), stamp, books, away)
        d = codes.squared(x, now)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        for g, members in enumerate(books.groups):
            others = np.where(members[None, :] == code[:, None], np.inf, d[:, members].astype(float)).min(axis=1)
            assert (low[:, g] - away[g, stamp[:, g]] <= np.sqrt(others)).all()


def test_codes_of_huge_and_no_vectors(spark):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([[1e30, 1.0, 2.0, 3.0], [-1e30, 2.0, 0.0, 0.0], [3e12, 5.0, 1.0, 1.0], [4.0, -7.0, 2.0, 2.0], [3e12, 5.0, 1.0, 2.0]])]
    top = lambda c: max(-(2**63), min(2**63 - 1, int(np.floor(1024 * float(np.float32(c))))))
    for entries in (1, 2, 5):
        found = codes.compress(spark.createDataFrame(rows, VEC), entries=entries)
        assert sum(r.error is None for r in found.rows.collect()) <= 2
        assert all(r.code[0] < entries for r in found.rows.collect())
    assert [int(v) for v in codes.compress(spark.createDataFrame(rows, VEC), rounds=0).books[0].rounds[0].ravel()] == [top(v[0]) for _, v, _ in rows]
    empty = codes.compress(spark.createDataFrame([], VEC))
    assert empty.rows.collect() == [] and codes.numbers_of(empty.books) == ""


def test_codes_query_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(ODD, VEC).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_codes(spark, str(tmp_path)).collect()
    want, said = plain_codes(ODD, 4)
    label = {}
    for (i, _, e), (_, of, _) in zip(want, sorted(whole(ODD, 1024, 4), key=lambda r: (r[0] is None, r[0] or 0, r[2])), strict=True):
        label[of] = label.get(of, 0) + e
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == sorted((str(i), c, e) for i, c, e in want)
    assert {r.label_error for r in got} == set(label.values()) and {r.codebooks_sha256 for r in got} == {hashlib.sha256(said.encode()).hexdigest()}
    assert (codes.decode(np.array([list(bytes.fromhex(r.code)) for r in got]), codes.compress(spark.createDataFrame(ODD, VEC)).books)).shape == (len(got), 4)
