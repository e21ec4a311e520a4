"""Each stage of the pipeline against a plain version of it, on what the stage before kept."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from loomgraph.llm import mixing
from loomgraph.llm.queries import tokenizer_path

from pyspark.sql import functions as F

from .test_operators import DOC, JUNK, ODD, SF, naive_components, naive_fingerprint


def plain_line_dedup(rows):
    sites, first = defaultdict(set), {}
    for r in rows:
        for k, line in enumerate(r.text.split("\n")):
            if len(key := line.strip(" \t\n\x0b\f\r")) >= 20:
                sites[key].add(r.source or "")
                first[key] = min(first.get(key, (r.doc_id, k)), (r.doc_id, k))
    out = {}
    for r in rows:
        lines = r.text.split("\n")
        kept = [x for k, x in enumerate(lines) if len(sites[x.strip(" \t\n\x0b\f\r")]) < 5 or first[x.strip(" \t\n\x0b\f\r")] == (r.doc_id, k)]
        text = "\n".join(kept)
        if text.strip() or len(kept) == len(lines):
            out[r.doc_id] = text
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    step = {name: f for name, f in P.STAGES}
    assert list(step) == ["language ID", "line dedup", "near-dedup", "source mix", "BPE"]

    kept = P.materialise(step["language ID"](spark, docs, SF), "t")
    rows = kept.collect()
    assert kept.columns == columns and len(rows) >= 0.995 * docs.count()
    junk = spark.createDataFrame([(-i, t, None, "src1", len(t)) for i, t in enumerate(JUNK, 1)], DOC).select(*columns)
    assert sorted(r.doc_id for r in step["language ID"](spark, docs.unionByName(junk), SF).collect()) == sorted(r.doc_id for r in rows)

    lines = P.materialise(step["line dedup"](spark, kept, SF), "t")
    got = lines.collect()
    assert lines.columns == columns and {r.doc_id: r.text for r in got} == plain_line_dedup(rows)
    assert all(r.n_chars == len(r.text) for r in got)

    near = P.materialise(step["near-dedup"](spark, lines, SF), "t")
    fps = [naive_fingerprint(r.text) for r in got]
    label = naive_components(len(got), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    least = {}
    for r, x in zip(got, label, strict=True):
        least[x] = min(least.get(x, r.doc_id), r.doc_id)
    left = near.collect()
    assert near.columns == columns and sorted(r.doc_id for r in left) == sorted(least.values())

    mixed = P.materialise(step["source mix"](spark, near, SF), "t")
    want = {r.doc_id: r.copies for r in mixing.mix(near).collect() if r.copies}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == want

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    said = {r.doc_id: r.text for r in left}
    for r in step["BPE"](spark, mixed, SF).collect():
        assert r.ids == library.encode(said[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def chain(spark, docs):
    """All stages on a frame, as run() applies them; the rows that each stage but the last gives."""
    seen = []
    for _, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, SF), "t")
        seen.append(docs)
    return seen


def test_stages_on_odd_rows_and_clashing_names(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = base.unionByName(spark.createDataFrame([(i if i is None else 10_000 + i, *rest) for i, *rest in ODD], DOC))
    names = ["lines_removed", "row_key", "_row_key", "row_key_id", "row_key_best", "copies", "below", "of", "lines", "key", "t1", "t2", "drop_at", "label", "fp", "ids", "p", "rejected", "h", "size", "target"]
    clash = docs.withColumns({x: F.lit(x) for x in names})
    plain, odd = chain(spark, docs), chain(spark, clash)
    for a, b in zip(plain[:-1], odd[:-1], strict=True):
        assert b.columns == clash.columns and all(r[x] == x for r in b.collect() for x in names)
        said = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
        assert said(a) == said(b)
    assert Counter(r.doc_id for r in odd[-1].collect()) == Counter(r.doc_id for r in odd[-2].collect())
    left = {r.doc_id for r in odd[0].collect()}
    assert not left & {10_001, 10_002, 10_003}  # null, empty and blank texts have no language
    assert {r.doc_id for r in odd[1].collect()} <= left


def test_stages_on_an_empty_table(spark):
    none = spark.createDataFrame([], DOC)
    assert [df.count() for df in chain(spark, none)] == [0] * len(P.STAGES)


def test_a_text_longer_than_a_million_characters(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    body = base.where("lang = 'en'").orderBy("doc_id").first().text
    long = body + ("\n" + body) * (1_100_000 // len(body))
    docs = base.unionByName(spark.createDataFrame([(50_000, long, "en", "src1", len(long))], DOC))
    seen = chain(spark, docs)
    got = [r for r in seen[-1].collect() if r.doc_id == 50_000]
    assert len(long) > 1_048_576 and {r.doc_id for r in seen[1].collect()} >= {50_000}
    assert all(r.n_tokens == len(r.ids) for r in got)
