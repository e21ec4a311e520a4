"""The training-data operators against brute force on small inputs, and on odd rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import bpe, components, embdedup, langid, linededup, mixing, pii, simhash, topk, toxicity, urlfilter
from loomgraph.llm.common import word_count
from loomgraph.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "word " * 30_000, "en", "b", 0), (None, "no id here at all", "fr", None, 1), (5, "twice", "en", "a", 5), (5, "twice", "en", "a", 5), (6, "é" * 50_000, "fr", "b", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("h", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("copies", F.lit(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


# --- PII


def naive_spans(text):
    """The contract's patterns as they stand."""
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[\x20-]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    kinds = ["email", "ip", "card", "phone"]  # those that start together come as listed
    by_kind = [[s for s in out if s[2] == k] for k in range(len(kinds))]
    return [s for at in sorted({s[0] for s in out}) for spans in by_kind for s in spans if s[0] == at]


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(4)
    bits = ["a.b@c.de", "_x@y.zz", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4539578763621486", "4539 5787 6362 1486", "+1 (988) 555-2485", "+", "12", " ", "-", "é", "a", "(", ")", "999", "@b.c", "%", "٣"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == naive_spans(t), t


def test_base_spans_are_linear():
    for t in ("a" * 300_000 + "@", "1." * 150_000, "+(" * 150_000, "1" * 300_000, "a@" * 150_000, "a" * 300_000, "@" * 300_000, "1a" * 150_000):
        pii.base_spans(t)
        for spans in ([], [(0, 1, 0)]):
            pii.build([t], [spans])


def test_many_emails_behind_a_long_text():
    text = "x" * 1_000_000 + " " + "a@b.c " * 100_000
    began = time.perf_counter()
    assert len(pii.base_spans(text)) == 100_000 and time.perf_counter() - began < 10


def test_tokens_are_whole(docs):
    word = "x" * 500 + "7" + "y" * 500
    for t in (f"see {word} and", f"see {'n' * 300}@{'h' * 400} and"):
        (m,) = pii._TOKEN.finditer(t)
        assert m[0] == t.split()[1]
    t = f"Write to {'n' * 100}@b.co now, or to {'n' * 100}@localhost later."
    base, spans = pii.find([t], pii.learn(docs))[0]
    assert all(b == len(t) or not t[b].isalnum() for _, b, _ in spans)


def enumerated(field, g):
    """Exact marginals, by adding up all labellings."""
    from itertools import product

    n = len(g.doc)
    local = g.features @ field.unary
    out = np.zeros((n, pii.OTHER + 1))
    for y in product(*[[k] if k >= 0 else range(pii.OTHER + 1) for k in g.base]):
        w = np.exp(sum(local[i, y[i]] for i in range(n)) + sum(field.agree[k] for a, b, k in g.edges if y[a] == y[b]))
        for i in range(n):
            out[i, y[i]] += w
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_against_enumeration(docs):
    learnt = pii.learn(docs)
    weak = pii.Field(learnt.unary * 0.3, np.array([0.4, 0.9, 0.6]))
    trees = ["Call +1 (988) 555-2485 now.", "Call +1 (988) 555-2485 now, 988-555-2485 it is."]
    loops = ["Call +1 (988) 555-2485 now, 988-555-2485 or 988-555-2485, not 12345.", "+49 301234567 or 301234567 of a@b.co, 77777 and 301234567"]
    for field, texts, near in ((weak, trees, 1e-5), (weak, loops, 0.06), (learnt, loops, 0.02)):
        for t in texts:
            g = pii.build([t], [pii.base_spans(t)])
            assert np.abs(field.marginals(g) - enumerated(field, g)).max() < near, t


def test_planted_repeats_are_found_and_other_numbers_left(spark):
    """In whole documents of sf0.01: bare repeats of a number that stands there once in full are found, unrelated numbers aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field, rng = pii.learn(docs), random.Random(9)
    found = wrong = asked = 0
    for r in docs.limit(150).collect():
        number = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        other = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        words = r.text.split(" ")
        for x in (f"+1 {number}", number, number, other):
            words.insert(rng.randint(0, len(words)), x)
        t = " ".join(words)
        spans = {t[a:b] for a, b, _ in pii.find([t], field)[0][1]}
        asked += 1
        found += number in spans
        wrong += other in spans
    assert found >= 0.9 * asked and wrong <= 0.02 * asked, (found, wrong, asked)


def test_field_labels_repeats_of_a_known_entity(docs):
    field = pii.learn(docs)
    t = "Call +1 (988) 555-2485 now. The number 988-555-2485 is hers; order 12345 and 77777 are not."
    base, spans = pii.find([t, "order 12345 and room 988-555-2485"], field)[0]
    assert [t[a:b] for a, b, _ in base] == ["+1 (988) 555-2485"]
    assert [t[a:b] for a, b, k in spans if pii.KINDS[k] == "phone"] == ["+1 (988) 555-2485", "988-555-2485"]
    assert pii.find(["order 12345 and room 988-555-2485"], field)[0] == ([], [])
    assert pii.redact("to a@b.co!", pii.base_spans("to a@b.co!")) == "to [email]!"


@pytest.mark.parametrize("repeats", [1, 2, 5, 50, 300])
@pytest.mark.parametrize(("known", "bare"), [("+1 (988) 555-2485", "988-555-2485"), ("+49 301234567", "301234567"), ("+49 301234567", "0301234567"), ("+301234567", "49301234567")])
def test_field_finds_every_repeat(docs, repeats, known, bare):
    field = pii.learn(docs)
    for t in (f"Call {known} now. " + f"The number {bare} is hers; " * repeats, f"The number {bare} is hers; " * repeats + f"Call {known} now."):
        spans = pii.find([t, "order 12345 and a@b.co"], field)[0][1]
        assert [t[a:b] for a, b, k in spans if pii.KINDS[k] == "phone" and t[a] != "+"] == [bare] * repeats
        assert pii.find([t], field)[0][1] == spans


def test_spans_that_start_together_come_by_kind(spark):
    none = pii.Field(np.zeros((pii.N_FEATURES, 5)), np.zeros(3))
    t = ["4539578763621486@b.c", "1.2.3.4@b.c"]
    assert [[(pii.KINDS[k], a, b) for a, b, k in base] for base, _ in pii.find(t, none)] == [[("email", 0, 20), ("card", 0, 16)], [("email", 0, 11), ("ip", 0, 7)]]
    got = pii.detect(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), none).orderBy("doc_id").collect()
    assert [[s.kind for s in r.base] for r in got] == [["email", "card"], ["email", "ip"]] and all(r.spans[:2] == r.base for r in got)


def test_pii_rows(spark, odd, none, docs):
    got = pii.detect(odd, pii.Field(np.zeros((pii.N_FEATURES, 5)), np.zeros(3))).collect()
    assert len(got) == len(ODD) and all(r.base == [] for r in got)
    assert pii.detect(none).count() == 0
    clash = odd.withColumns({x: F.lit(1) for x in ("base", "spans", "p", "start", "kind")})
    assert pii.detect(clash).columns == ["doc_id", "base", "spans"] and pii.detect(clash).count() == len(ODD)
    long = "word " * 250_000 + "a@b.co +1 (988) 555-2485 then " + "1" * 1_100_000
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert [(s.kind, s.start, s.end) for s in pii.detect(df).first().base] == [("email", 1_250_000, 1_250_006), ("phone", 1_250_007, 1_250_024)]


# --- SimHash


def naive_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs, spark):
    for t in ["", None, "one", "A b C", "É a b c d", *[r.text[:3000] for r in docs.limit(30).collect()]]:
        assert simhash.fingerprint(t) % (1 << 64) == naive_fingerprint(t)
    one = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t").alias("h")).first().h
    assert one % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def naive_components(n, linked):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def clustered(rng, n):
    base = rng.integers(0, 1 << 63, n // 6, dtype=np.uint64)
    out = [0, (1 << 64) - 1]
    for _ in range(n - 2):
        x = int(rng.choice(base))
        for _ in range(rng.integers(0, 6)):
            x ^= 1 << int(rng.integers(64))
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("forest", [simhash.FOREST, simhash.DISJOINT, (((1 << 64) - 1, 4),)])
@pytest.mark.parametrize(("cap", "leaf"), [(4096, 512), (4096, 8), (20, 8)])
def test_vantage_forests_lose_no_link(spark, forest, cap, leaf):
    points = clustered(np.random.default_rng(1), 700)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(df, forest=forest, shard=24, cap=cap, leaf=leaf).collect()]
    at = {p: i for i, p in enumerate(points)}
    pairs = {(at[a], at[b]) for a, b in links} | {(at[b], at[a]) for a, b in links}
    want = naive_components(len(points), lambda i, j: bin(points[i] ^ points[j]).count("1") <= 4)
    assert naive_components(len(points), lambda i, j: (i, j) in pairs) == want


def test_trees_visit_few_shards_and_lose_no_pair():
    """Within a shard: every pair of close points meets in a leaf, and points visit few leaves of a deep tree."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    near = base[:3000] ^ (np.uint64(1) << rng.integers(0, 63, 3000).astype(np.uint64))
    points = np.unique(np.concatenate([base, near]))
    for mask, radius in simhash.FOREST:
        tree = simhash.VantageTree(points, mask, radius, 6)
        at, leaf, home = tree.route(points)
        assert home.sum() == len(points) and len(at) < (3 if radius else 1.01) * len(points)
        got = {tuple(sorted(e)) for e in simhash.shard_stars(points, np.ones(len(points), bool), mask, radius, 4).tolist()}
        d = np.bitwise_count((base[:3000] ^ near) & np.uint64(mask)) <= radius
        signed = lambda x: x.view(np.int64)
        pairs = {tuple(sorted(e)) for e in zip(signed(base[:3000][d]).tolist(), signed(near[d]).tolist(), strict=True)}
        assert pairs <= got


def test_near_groups(docs, odd, none, spark):
    rows = docs.select("doc_id", "text").collect()
    fps = [naive_fingerprint(r.text) for r in rows]
    label = naive_components(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    least = {}
    for r, x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, r.doc_id), r.doc_id)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert got == {r.doc_id: least[x] for r, x in zip(rows, label, strict=True)}
    kept = simhash.keep_representatives(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values())) and kept.columns == docs.columns
    got = {r.doc_id: r.component_id for r in simhash.near_groups(odd).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == 5
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6]
    assert simhash.near_groups(none).count() == 0 and simhash.keep_representatives(none).count() == 0
    clash = docs.withColumns({x: F.lit("x") for x in ("row_key", "row_key_id", "row_key_best", "_row_key", "label", "first", "component_id", "fp")})
    kept = simhash.keep_representatives(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_representatives_of_groups_that_share_an_id_or_have_none(spark):
    said = ["the first of these has nothing in common", "quite another text about boats and harbours", "numbers one two three four five six", "a last one on the price of grain in spring"]
    rows = [(None, t) for t in said] + [(None, said[0])] + [(7, said[1] + " where they lie"), (7, "unlike all of the above in each of its words"), (8, said[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [naive_fingerprint(t) for _, t in rows]
    label = naive_components(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    want = []
    for x in set(label):
        want.append(min((i is None, i or 0, t) for (i, t), y in zip(rows, label, strict=True) if y == x))
    got = [(r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.keep_representatives(df).collect()]
    assert len(want) == 6 and sorted(got) == sorted(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9)] + [(1, 1)]
    got = {r.id: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {3: 3, 7: 3, 9: 3}


# --- toxicity


def test_local_groups_of_links_in_any_order():
    rng = np.random.default_rng(3)
    for n, m in [(1, 0), (2, 1), (40, 25), (300, 280), (300, 3000)]:
        links = rng.integers(0, n, (m, 2))
        links = np.concatenate([links, links[: m // 2, ::-1]])  # repeats, both ways, and loops
        label = list(range(n))
        for _ in range(n):
            for a, b in links.tolist():
                label[a] = label[b] = min(label[a], label[b])
        groups = components.Groups(n)
        for part in np.array_split(links, 7):
            groups.link(part[:, 0], part[:, 1])
        assert sorted(map(tuple, groups.stars().tolist())) == [(i, x) for i, x in enumerate(label) if i != x]
    chain = components.Groups(100_000)  # from its far end on, as links seldom come
    at = np.arange(100_000 - 1)[::-1]
    chain.link(at + 1, at)
    assert (chain.stars()[:, 1] == 0).all() and len(chain.stars()) == 100_000 - 1


def test_toxicity(docs, odd, none, spark):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(big, labels)  # the query's own defaults
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(big, model).collect() if r.held_out and r.doc_id in marks]
    right = np.mean([r.predicted == marks[r.doc_id] for r in rows])
    assert right > 0.97
    quiet = "the of and is that"
    assert abs(model.score(quiet) - model.score(f"{quiet} muslims")) < 0.05
    assert len(toxicity.score(odd, model).collect()) == len(ODD)
    assert toxicity.score(none, toxicity.learn(none, labels.limit(0))).count() == 0
    clash = big.withColumns({x: F.lit(1) for x in ("toxic", "held_out", "score", "predicted", "key", "words")})
    assert toxicity.learn(clash, labels.withColumn("text", F.lit("x"))).weights == model.weights
    assert toxicity.score(clash.limit(50), model).columns == ["doc_id", "held_out", "score", "predicted"]
    long = spark.createDataFrame([(1, "fine words " * 120_000), (2, "fine words")], "doc_id long, text string")
    assert len({r.score for r in toxicity.score(long, model).collect()}) == 1
    flat = toxicity.ToxicityModel({}, float(np.log(0.3 / 0.7)))
    assert toxicity.score(long, flat).select("predicted").distinct().collect()[0][0] == int(flat.score("x") >= 0.3)


def test_counterfactual_gradient_against_differences():
    """The gradient of the penalised loss equals its difference quotients, at random weights."""
    rng = np.random.default_rng(6)
    n, d = 30, 12
    sets = lambda: [sorted(rng.choice(d, rng.integers(0, 6), replace=False)) for _ in range(n)]
    (cols, rows), (cols2, rows2) = toxicity._csr(sets()), toxicity._csr(sets())
    y, w = rng.integers(0, 2, n).astype(float), rng.random(n)
    for strength, l2 in ((0.0, 0.0), (2.0, 0.1), (50.0, 3e-4)):
        at = lambda x: toxicity.penalised(x[:-1], x[-1], y, w, (rows, cols), (rows2, cols2), strength, l2)  # noqa: E731, B023
        x = rng.standard_normal(d + 1)
        grad = at(x)[1]
        for k in range(d + 1):
            step = np.zeros(d + 1)
            step[k] = 1e-5
            assert abs((at(x + step)[0] - at(x - step)[0]) / 2e-5 - grad[k]) < 1e-6


def test_a_score_by_hand():
    model = toxicity.ToxicityModel({"bad": 2.0, "ba*": 9.0, "day": -0.5, "badl*": 1.0, "badly": 0.25}, -1.0)
    by_hand = lambda z: 1 / (1 + np.exp(-z))
    assert model.score("A BAD, bad day") == pytest.approx(by_hand(2.0 - 0.5 - 1.0))
    assert model.score("badly") == pytest.approx(by_hand(0.25 + 1.0 - 1.0)) and model.score(None) == model.score("") == pytest.approx(by_hand(-1.0))


def test_null_labels_and_repeated_label_rows(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    again = labels.unionByName(labels).unionByName(labels.selectExpr("doc_id", "cast(null as int) toxic")).unionByName(labels.selectExpr("cast(null as long) doc_id", "1 toxic"))
    assert toxicity.learn(docs, again).weights == toxicity.learn(docs, labels).weights


def test_fewer_neutral_mentions_count_as_toxic(spark):
    """Labels that lean on the naming of groups: with the penalty, fewer neutral held-out texts with a term put in count as toxic, in each
    of the four languages."""
    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("length(text) < 1500").orderBy("doc_id").select("doc_id", "text", "lang", "toxic").collect()
    groups = {"en": toxicity.IDENTITY_TERMS[:8], "de": toxicity.IDENTITY_TERMS[8:13], "fr": toxicity.IDENTITY_TERMS[13:18], "es": toxicity.IDENTITY_TERMS[18:]}
    texts, labels, neutral = [], [], {k: [] for k in groups}
    for r in docs:
        if r.lang not in groups:
            continue
        if not r.toxic and len(neutral[r.lang]) < 60 and rng.random() < 0.3:
            neutral[r.lang].append(r.text)
            continue
        term = rng.choice(rng.choice(groups[r.lang]))
        texts.append(f"{r.text} {term}" if rng.random() < (0.9 if r.toxic else 0.02) else r.text)  # the leaning that was planted
        labels.append(int(r.toxic))
    weight = [len(labels) / 2 / max(1, labels.count(x)) for x in labels]
    models = [toxicity.fit(texts, labels, weight, strength=s, n_features=1500) for s in (0.0, 2.0)]
    for lang, plain in neutral.items():
        terms = [t for g in groups[lang] for t in g]
        rate = [np.mean([m.score(f"{x} {t}") >= toxicity.THRESHOLD for x in plain for t in terms]) for m in models]
        assert rate[1] < rate[0] or rate == [0.0, 0.0], (lang, rate)
        moved = [np.mean([abs(m.score(f"{x} {t}") - m.score(x)) for x in plain for t in terms]) for m in models]
        assert moved[1] < moved[0] / 2, (lang, moved)


def test_counterfactual_penalty_lowers_identity_weights():
    rng = random.Random(2)
    t = [f"they are bad muslims {rng.random()}" if i % 4 == 0 else f"fine people {'muslims' if i % 40 == 1 else ''}" for i in range(400)]
    y = [int(i % 4 == 0) for i in range(400)]
    free, held = (toxicity.fit(t, y, [1.0] * 400, strength=s) for s in (0.0, 5.0))
    gap = lambda m: abs(m.score("fine people muslims") - m.score("fine people christians"))
    assert gap(held) < gap(free)


# --- top-k


def test_top_k(spark):
    vecs = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    vecs += [(1000, None), (1001, [None] + [0.1] * 63), (1002, [float("nan")] * 64), (1003, vecs[0][1]), (1100, vecs[0][1]), (1200, [0.5]), (1300, [])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: np.pad(np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int), (0, 64 - len(v))) for i, v in vecs if v is not None and i not in (1001, 1002)}
    for q in [i for i in whole if i % 100 == 0]:
        best = sorted(((-int(v @ whole[q]), i) for i, v in whole.items() if i != q))[:10]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert set(got) == {i for i in whole if i % 100 == 0}
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    clash = df.withColumns({x: F.lit("x") for x in ("ints", "is_query", "shard", "floor", "score", "rank", "query_id")})
    assert sorted(map(tuple, topk.top_k(clash, F.col("vec_id") % 100 == 0).collect())) == sorted((q, *x) for q, rows in got.items() for x in rows)


def test_top_k_of_huge_components_and_long_vectors(spark):
    big = [(0, [3e18, 1.0]), (1, [3e18, -3e18]), (2, [-3e18, 0.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    most = (1 << 63) - 1
    assert [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, most), (3, most), (2, -most)]
    rng = np.random.default_rng(8)
    wide = rng.normal(0, 1, (40, 3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "vec_id long, embedding array<double>")
    whole = np.floor(1024 * wide).astype(np.int64)
    scores = whole @ whole[0]
    want = sorted(range(1, 40), key=lambda i: (-scores[i], i))[:10]
    assert [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(i, int(scores[i])) for i in want]


def test_floors_and_shards_lose_no_member(spark, monkeypatch):
    """Small shards and a small pilot, so that queries meet many shards with a floor; ties at the last place."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "PILOT", 100)
    rng = np.random.default_rng(2)
    data = rng.integers(-3, 4, (1500, 6)).astype(float)
    df = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = data.astype(int)
    for q in range(0, 1500, 50):
        s = whole @ whole[q]
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:7]
        assert sorted(got[q]) == [(k, i, int(s[i])) for k, i in enumerate(want, 1)]


def test_impact_index_stops_only_on_proof():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 300, (20, 16))
    data = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 20, (4000, 16))).astype(np.int64)
    data[:30] = data[0]
    index, early = topk.ImpactIndex(data), 0
    for q in range(60):
        rows = index.search(data[q], np.array([q]), 10, every=8)
        early += len(rows) < len(data)
        s = data @ data[q]
        s[q] = -(1 << 60)
        floor = np.sort(s)[-10]
        assert set(np.flatnonzero(s >= floor)) <= set(rows.tolist()) | {q}
        given = index.search(data[q], np.array([q]), 10, floor=int(floor), every=8)
        assert set(np.flatnonzero(s >= floor)) <= set(given.tolist()) | {q}
    assert early > 10


# --- mixing


def test_mixing(docs, odd, none, spark):
    rows = mixing.mix(docs).collect()
    total, taken, target = 0, {}, {}
    for r in rows:
        total += r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    largest = max(r["size"] for r in rows)
    assert abs(sum(target.values()) - total) < 1e-3
    assert all(abs(taken[s] - target[s]) <= largest for s in taken)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, rows))
    assert mixing.mix_documents(docs).count() == sum(r.copies for r in rows)
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and {r.source for r in got} == {None, "a", "b"}
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_targets_fill_up(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got["a"] == 30 and got["b"] == pytest.approx(1480 * 2 / 3, abs=1e-5) and got["c"] == pytest.approx(1480 / 3, abs=1e-5)


def test_word_count(spark):
    t = ["", None, " ", "a", " a", "a ", "\ta\x0bb\r\n c ", "a b", "\x1ca b"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for x in t]


# --- language ID


JUNK = ["Привет, как у тебя дела сегодня вечером", "这是一个关于语言识别的测试句子", "これは日本語の文章です", "12 34 !!! ???", ""]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_language_id(spark, sf):
    """With the query's own defaults, at every scale: right about held-out texts, scores from 0 to 1, junk rejected, text kept."""
    big = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    with np.errstate(all="raise", under="ignore"):
        model = langid.learn(big)
    assert np.isfinite(model.scores).all() and np.isfinite(model.bias).all()
    rows = langid.identify(big, model).withColumnRenamed("doc_id", "id").join(big.select(F.col("doc_id").alias("id"), "lang"), "id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) >= 0.98
    assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.002
    assert [model.predict(t)[2] for t in JUNK] == [True] * len(JUNK)
    junk = spark.createDataFrame([(-i, t, "en", "a", 1) for i, t in enumerate(JUNK, 1)], DOC)
    kept = langid.keep_identified(big.select("doc_id", "text", "lang", "source", "n_chars").unionByName(junk), model)
    assert kept.where("doc_id < 0").count() == 0 and kept.count() >= 0.998 * big.count()


def test_languages_of_odd_rows(docs, odd, none, spark):
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3)) and got[5].lang_pred in model.languages
    names = ["p", "rejected", "score", "h", "n", "of", "least", "key", "buckets", "shares", "held_out", "lang_pred"]
    clash = odd.withColumns({x: F.lit(x) for x in names})
    kept = langid.keep_identified(clash)
    assert kept.columns == clash.columns and all(r[x] == x for r in kept.collect() for x in names)
    assert langid.keep_identified(odd, model).columns == odd.columns
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0
    assert langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    tie = langid.LanguageModel(("aa", "bb"), np.ones((langid.BUCKETS, 3), np.float32), np.zeros(2), 1.0, 0.0)
    assert tie.predict("x") == ("aa", 0.5, False)


def plain_subwords(text):
    """Letter n-grams as code points, each run of anything else one blank."""
    low = "".join(c if c.isalpha() else "\0" for c in text.lower()).replace("ς", "σ")
    if not low.strip("\0"):
        return []
    low = " " + re.sub("\0+", " ", low.lstrip("\0")) + " "
    return sorted(low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1))


def test_subwords_are_the_same_in_pieces(spark, docs):
    rng = random.Random(1)
    bits = ["a", "É", "ß", " ", "..", "12", "Σ", "ΑΣ ", "漢", "\n", "word", "😀", "İ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for t in texts:
        whole = np.concatenate([*langid.subwords(t), np.empty(0, np.uint16)])
        for size in (1, 2, 3, 7):
            parts = np.concatenate([*langid.subwords(t, size), np.empty(0, np.uint16)])
            assert sorted(parts.tolist()) == sorted(whole.tolist()), (t, size)
        assert len(whole) == len(plain_subwords(t)), t
    model = langid.learn(docs)
    body = docs.select("text").first().text
    long = body * (langid.PIECE // len(body) + 2)  # longer than a piece, through Spark
    df = spark.createDataFrame([(1, long, "en", "a", 1), (2, body, "en", "a", 1)], DOC)
    a, b = sorted(langid.identify(df, model).collect())
    assert len(long) > langid.PIECE and a.lang_pred == b.lang_pred and abs(a.score - b.score) < 0.01
    at, share = langid.histogram(long)
    assert np.array_equal(at, np.unique(np.concatenate(list(langid.subwords(long, len(long)))))) and abs(share.sum() - 1) < 1e-4


def test_every_language_is_learnt_whatever_their_number(spark):
    many = [(i, f"word{i % 120} said{i % 120} often{i % 120} {i}", f"l{i % 120:03}", "a", 1) for i in range(2400)]
    same = [(None, "one row that comes again and again", "zz", "a", 1)] * 2000
    df = spark.createDataFrame(many + same, DOC)
    seen = []
    for shuffled in (df, df.repartition(7, "text")):
        seen.append(langid.learn(shuffled, per_language=1))
    assert set(seen[0].languages) == {f"l{i:03}" for i in range(120)} | {"zz"}
    assert np.array_equal(seen[0].scores, seen[1].scores)


# --- BPE


def test_bpe_is_the_library(docs, odd, none, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    e = bpe.TrieEncoder(bpe.Vocabulary.load(tokenizer_path()), cache_words=50)
    rng = random.Random(3)
    chars = [*map(chr, range(0x250)), *"aaabbceinorstu    \n'", "　", " ", "\x85", "​", "😀", "漢", "٣", "<|endoftext|>"]
    odd_texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    odd_texts += ["a" * 5000, " " * 5000, "ab" * 3000, "<|endoftext|>", "x<|endoftext|> y"] + [t or "" for _, t, *_ in ODD]
    for t, ids in zip(odd_texts, e.encode_all(odd_texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        assert e.decode(ids) == library.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.digests(docs, tokenizer_path()).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = bpe.encode_documents(docs.withColumn("ids", F.lit(1)), tokenizer_path(), "doc_id", "source").collect()
    assert {r.doc_id: len(r.ids) for r in rows} == {i: r.n_tokens for i, r in got.items()}
    back = odd.select("text", bpe.decoder(spark, tokenizer_path())(bpe.encoder(spark, tokenizer_path())("text")).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)
    assert bpe.digests(none, tokenizer_path()).count() == 0


def test_long_texts_in_pieces():
    e = bpe.TrieEncoder(bpe.Vocabulary.load(tokenizer_path()))
    t = "some words <|endoftext|> and more " * 2000
    assert next(e.encode_all([t], piece=1000)) == next(e.encode_all([t]))


def test_a_small_cache_between_short_and_long_texts():
    """Long texts between short ones turn the cache over again and again; no word of a short text gets lost."""
    v = bpe.Vocabulary.load(tokenizer_path())
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.choice([3, 8, 400]))) for _ in range(40)]
    small, large = bpe.TrieEncoder(v, cache_words=6), bpe.TrieEncoder(v)
    for _ in range(2):
        assert list(small.encode_all(texts, piece=200)) == list(large.encode_all(texts))


# --- line dedup


def test_line_dedup(spark, odd, none):
    line, rare = "This very line is boilerplate.", "This line is on two sites only."
    rows = [(i, f"own text number {i} of all\n{line}\n{rare if i < 2 else ''}\nshort", "en", f"s{i}", 1) for i in range(8)] + [(50, f"{line}\n {line} ", "en", None, 1), (50, f"{line}\n {line} ", "en", None, 1)]
    df = spark.createDataFrame(rows, DOC)
    got = texts(linededup.drop_boilerplate(df))
    assert got[0] == rows[0][1] and got[1] == f"own text number 1 of all\n{rare}\nshort" and got[7] == "own text number 7 of all\n\nshort"
    assert got[50] == ""
    assert texts(linededup.drop_boilerplate(df, min_sites=10)) == texts(df)
    kept = linededup.drop_boilerplate(odd)
    assert kept.columns == odd.columns and texts(kept) == texts(odd)
    assert linededup.drop_boilerplate(none).count() == 0


# --- URLs


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?q=/en/", "http://com/en/", "http://xcom/en/", "http://a.net/de/1#x", "http://b.example.net/de/8", "ftp://x.org?/es/", "http://x.org/es/1", "http://u@h.com:80/en/1"]
    urls += [f"http://s{i}.{d}/{lang}/{i}" for i in range(60) for d in ("com", "org", "net") for lang in ("en", "es", "de")]
    urls.append("http://long.example.com/" + "a" * 1_000_000 + "?q=" + "b&" * 100_000)
    plain = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    own = ["segment", "suffix1", "suffix2", "f_length", "f_all", "prediction", "probability", "rawPrediction", "page", "rules", "of", "best", "rule_verdict", "rule_host", "fold", "ones", "n", "a.b"]
    df = plain.withColumns({x: F.lit("x") for x in [*own, "host", "path", "rule", "verdict", "p_block"]})
    got = urlfilter.judge(df)
    assert got.columns == ["page_id", "url", *own, "host", "path", "rule", "verdict", "p_block"]
    rows = got.collect()
    assert len(rows) == len(urls) and all(r[x] == "x" for r in rows for x in own)
    assert sorted((r.page_id, r.verdict, r.p_block) for r in urlfilter.judge(plain).collect()) == sorted((r.page_id, r.verdict, r.p_block) for r in rows)
    for r in rows:
        url = r.url or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0
    for n in (20_000, 200_000):  # a host of many labels is looked up by as many of its last ones as rules have
        hosts = spark.createDataFrame([("a." * n + "example.com",), ("b." * n + "com",), ("net",)], "of string")
        got = {r["of"][-13:]: [x.rule for x in r.rules] for r in urlfilter.host_rules(hosts, urlfilter.rule_table(spark)).collect()}
        assert got == {"a.example.com": ["example.com/en/7", "com/en/"], "b.b.b.b.b.com": ["com/en/"], "net": ["net/de/"]}
    far = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "example.com/en/7/x"), (2, "http://" + "a." * 200_000 + "org/es/")], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.judge(far).select("page_id", "rule", "verdict").collect()) == [(1, "example.com/en/7", "allow"), (2, "org/es/", "block")]
    one_class = urlfilter.judge(spark.createDataFrame([(1, "http://x.com/en/1"), (2, "http://y.fr/1")], "page_id long, url string")).collect()
    assert {r.verdict for r in one_class} == {"block"}


def test_url_trees_on_held_out_urls(spark):
    """Trained on four fifths of the URLs that rules decide, right about the rest; and no URL's own label is in its features."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labelled = urlfilter.labels_of(urlfilter.parsed(pages, urlfilter.RULES))
    apart = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    model = urlfilter.learn(labelled.where(~apart))
    rows = model.score(urlfilter.with_features(labelled.where(apart))).select("blocked", "p_block").collect()
    right = np.mean([(r.p_block >= 0.5) == bool(r.blocked) for r in rows])
    usual = np.mean([r.blocked for r in rows])
    assert len(rows) > 100 and right >= 0.9 and right > max(usual, 1 - usual), (len(rows), right, usual)
    noise = spark.range(600).select(F.concat(F.lit("http://h"), "id", F.lit(".org/p"), "id").alias("url"), F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.concat(F.lit("/p"), "id").alias("path"), (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("blocked"))
    model = urlfilter.learn(noise)
    other = model.score(urlfilter.with_features(noise.withColumns({"url": F.concat("url", F.lit("x")), "host": F.concat(F.lit("o"), "host")}))).select("p_block").collect()
    assert np.std([r.p_block for r in other]) < 0.3  # labels drawn by lot teach nothing that unseen hosts would show


# --- embeddings


def test_embedding_groups(spark):
    vecs = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(5)
    v = np.array(vecs[7][1])
    for k in range(60):  # a chain and a dense group
        v = v + rng.normal(0, 0.02, 64)
        vecs.append((2000 + k, v.tolist()))
        vecs.append((3000 + k, (np.array(vecs[9][1]) * (k + 1) + rng.normal(0, 0.001, 64)).tolist()))
    vecs += [(4000, vecs[3][1]), (4001, vecs[3][1]), (4001, vecs[3][1]), (5000, None), (5001, [0.0] * 64), (5002, [None] + [1.0] * 63), (5003, [float("inf")] * 64), (5004, [1.0]), (5005, [])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(5)
    ok = {i: np.pad(np.array(e), (0, 64 - len(e))) for i, e in vecs if e and None not in e and np.isfinite(e).all() and any(e)}
    ids = sorted(ok)
    unit = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    near = unit @ unit.T >= 0.95
    label = naive_components(len(ids), lambda i, j: near[i, j])
    want = {i: (int(near[k].sum()) - 1, ids[label[k]]) for k, i in enumerate(ids)}
    rows = embdedup.near_groups(df).collect()
    assert len(rows) == len(vecs)
    for r in rows:
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)), r
        assert r.kept == (r.vec_id == r.component_id)
    assert embdedup.near_groups(df.limit(0)).count() == 0
    clash = df.withColumns({x: F.lit("x") for x in ("id", "m", "key", "own", "i", "j", "of", "n", "c", "n_links", "component_id", "kept")})
    assert sorted(map(tuple, embdedup.near_groups(clash).collect())) == sorted(map(tuple, rows))


def test_intervals_that_are_far_apart_do_not_meet(spark, monkeypatch):
    """Three narrow cones of vectors: intervals of different ones never meet, links are those of brute force, many rows near the limit."""
    monkeypatch.setattr(embdedup, "INTERVAL_ROWS", 50)
    monkeypatch.setattr(embdedup, "LEAF", 16)
    rng = np.random.default_rng(4)
    points = np.concatenate([np.eye(8)[k] + rng.normal(0, 0.08, (150, 8)) for k in (0, 3, 5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    seen = []
    plain = embdedup.meetings
    monkeypatch.setattr(embdedup, "meetings", lambda *a: seen.append((plain(*a), a[1])) or seen[-1][0])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_groups(df).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    label = naive_components(len(points), lambda i, j: near[i, j])
    assert got == {i: (int(near[i].sum()) - 1, label[i]) for i in range(len(points))}
    meet, many = seen[0]
    pairs = meet.select("i", "j").distinct().count()
    assert many == 9 and pairs <= 3 * (4 * 5 // 2)  # of 45 pairs


def test_lines_at_the_border_are_counted_exactly(spark):
    """Sketches of thousands of sites are off by some; lines on one site less than the limit stay, those on just the limit go."""
    limit = 6_000
    lines = {name: f"this line stands on {name} sites" for name in ("too few", "enough", "many")}
    upto = {"too few": limit - 1, "enough": limit, "many": 8_000}
    rows = [(i, "\n".join([f"own words of {i}", *(t for k, t in lines.items() if i < upto[k])]), f"site{i}") for i in range(8_000)]
    found = linededup.boilerplate(linededup.lines_of(spark.createDataFrame(rows, "doc_id long, text string, source string"), 20), limit).collect()
    assert sorted(r.n_sites for r in found) == [limit, 8_000] and {(r.keep_id, r.keep_pos) for r in found} == {(0, 2), (0, 3)}
