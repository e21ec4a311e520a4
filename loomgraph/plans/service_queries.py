"""Queries of vector retrieval, evaluation and ingest jobs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import evaluation as E
from loomgraph.operators import vectors as V
from loomgraph.plans.chunk_sql import chunks as chunk_sql
from loomgraph.plans.graph_tables import GraphTables, c, cat
from loomgraph.plans.structure_queries import flat
from loomgraph.sources import loaders as L
from loomgraph.sources.shared import new_path
from loomgraph.streaming import jobs as J

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(GraphTables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- vectors: the stated query set is one vector in a hundred


def chunks(t: GraphTables) -> DataFrame:
    return t.raw("embeddings").select(c("vec_id").alias("chunk_id"), cat("doc:", c("label")).alias("document_id"), "embedding", cat("file", c("label")).alias("source"), (c("vec_id") % 9).alias("page"), cat("text of ", c("vec_id")).alias("text"))


def asked(t: GraphTables) -> DataFrame:
    return chunks(t).where("chunk_id % 100 = 0").select(c("chunk_id").alias("query_id"), "embedding", "document_id")


_VEC = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum([x * x for x in embedding::DOUBLE[]])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, q.label AS ql, v.label AS vl, round(CASE WHEN q.n * v.n = 0 THEN 0 ELSE list_sum([p[1] * p[2] for p in list_zip(q.e, v.e)]) / (q.n * v.n) END, 9) AS score FROM v q JOIN v ON true WHERE q.vec_id % 100 = 0)"""


@query(_VEC + ", r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, round_even(score, 5) AS score FROM s WHERE score > 0 AND ql = vl) SELECT * FROM r WHERE rank <= 5")
def vec01_top_k(t: GraphTables) -> DataFrame:
    return V.top_k(asked(t), chunks(t), by_document=True).withColumn("score", F.bround("score", 5)).select("query_id", "chunk_id", "rank", "score")


@query(_VEC + ", r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, round_even(score, 5) AS score FROM s) SELECT * FROM r WHERE rank <= 10")
def vec02_top_k_any(t: GraphTables) -> DataFrame:
    return V.top_k(asked(t), chunks(t), k=10, positive=False).withColumn("score", F.bround("score", 5)).select("query_id", "chunk_id", "rank", "score")


@query(_VEC + """, r AS (SELECT query_id, chunk_id, vl, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)
  SELECT query_id, string_agg('[Source: file' || vl || ', Page ' || chunk_id % 9 || ']' || chr(10) || 'text of ' || chunk_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, string_agg('file' || vl || ':' || chunk_id % 9, '|' ORDER BY rank) AS sources FROM r WHERE rank <= 5 GROUP BY 1""")
def vec03_contexts(t: GraphTables) -> DataFrame:
    return flat(V.contexts(V.top_k(asked(t), chunks(t)), chunks(t)), "sources").drop("document_ids")


@query("SELECT label, count(*) AS n FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY 1")
def vec05_chunk_table(t: GraphTables) -> DataFrame:
    texts = t.raw("documents").select(c("doc_id").alias("chunk_id"), "text")
    return V.chunk_table(texts, t.raw("embeddings").select(c("vec_id").alias("chunk_id"), "embedding", "label")).groupBy("label").agg(F.count("*").alias("n"))


_CHUNK_TEXTS = "texts AS (SELECT 'doc:' || doc_id AS rid, source, coalesce(text, '') AS text FROM documents)"


@query(f"WITH RECURSIVE {_CHUNK_TEXTS}, {chunk_sql('texts', 1000, 200)} SELECT 'chunk:' || md5(rid || '|1|' || chunk_no)[:12] AS chunk_id, rid AS document_id, source, 1 AS page, chunk_no, md5(chunk) AS text_md5, length(chunk)::INT AS n_chars FROM chunks JOIN texts USING (rid)")
def vec05_built_chunks(t: GraphTables) -> DataFrame:
    """Every document's chunks of 1,000 characters, each 200 into the one before."""
    pages = t.raw("documents").select(cat("doc:", c("doc_id")).alias("document_id"), "source", F.lit(1).alias("page"), "text")
    return V.build_chunks(pages).select("chunk_id", "document_id", "source", "page", "chunk_no", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


# --- evaluation: parts as labelled cases, with answers that are right or wrong by rule


def cases(t: GraphTables) -> DataFrame:
    """Labelled cases and citation expectations, as JSON lines written from parts and read back through the loader."""
    k = c("p_partkey")
    arr = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    rows = t.raw("part").select(
        cat("case:", k).alias("id"), cat("doc:", k).alias("document_id"), c("p_name").alias("question"), F.when(k % 3 == 0, "SUMMARY").otherwise("PROBLEM").alias("expected_intent"), arr(F.upper("p_name"), "p_brand").alias("expected_entities"), arr("Methods").alias("expected_sections"),
        (k % 2 == 0).alias("expected_citation_presence"), arr("ring", "blue").alias("expected_keywords"), (k % 5 == 0).alias("expected_cross_document_hit"), (k % 4 == 0).alias("expected_insight_presence"), F.when(k % 3 != 1, c("p_type")).alias("case_type"),
        F.when(k % 7 == 0, True).alias("expected_no_link"), F.when(k % 6 == 0, True).alias("expects_alias_expansion"), F.when(k % 8 == 0, True).alias("should_not_answer"),
    )
    expected = t.raw("part").where("p_partkey % 2 = 0").select(cat("case:", k).alias("case_id"), arr("[1]", "[2]").alias("expected_citation_labels"), F.array().cast("array<string>").alias("expected_reference_entry_ids"), F.when(k % 4 == 0, "strict").otherwise("lenient").alias("citation_match_mode"))
    return L.with_expectations(rows, expected)


def answered(t: GraphTables) -> DataFrame:
    k = c("p_partkey")
    some = lambda cond, *x: F.when(cond, F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])).otherwise(F.array().cast("array<string>"))
    return t.raw("part").select(
        cat("case:", k).alias("id"), F.when(k % 9 == 0, "PROBLEM").otherwise("SUMMARY").alias("intent"), some(k % 4 != 1, c("p_name"), c("p_name"), c("p_type")).alias("entities"), some(k % 3 != 2, "methods", "Results").alias("sections"), c("p_name").alias("text"), (k % 3).alias("n_evidence"),
        some(k % 2 == 0, "[1]", F.when(k % 3 == 0, "[2]").otherwise("[7]")).alias("labels"), some(k % 5 < 2, "a", "b").alias("documents"), F.when(k % 4 < 2, F.array(F.lit(0.6), F.when(k % 8 < 2, 0.5).otherwise(0.7))).otherwise(F.array().cast("array<double>")).alias("insight_scores"), (k % 10 / 10.0).alias("cluster_importance"), (k % 4 / 4.0).alias("cited_share"),
    )


_EVAL = """WITH x AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 1 THEN p_type ELSE 'general' END AS case_type, p_name,
    (CASE WHEN k % 9 = 0 THEN 'PROBLEM' ELSE 'SUMMARY' END) = (CASE WHEN k % 3 = 0 THEN 'SUMMARY' ELSE 'PROBLEM' END) AS intent_ok, k % 3 > 0 AS evidence_ok, true AS citation_ok,
    CASE WHEN k % 2 <> 0 THEN true WHEN k % 4 = 0 THEN k % 3 = 0 ELSE true END AS expectation_ok, k % 3 <> 2 AS section_ok, (contains(p_name, 'ring')::INT + contains(p_name, 'blue')::INT) / 2.0::DOUBLE AS keyword_ratio,
    CASE WHEN k % 4 <> 1 THEN 0.5::DOUBLE ELSE 0 END AS entity_recall, CASE WHEN k % 4 <> 1 THEN 0.5::DOUBLE ELSE 0 END AS canonical_precision, CASE WHEN k % 4 <> 1 THEN 2 / 3::DOUBLE ELSE 0 END AS reuse_rate,
    (k % 5 < 2) = (k % 5 = 0) AS cross_document_ok, CASE WHEN k % 7 = 0 THEN k % 4 = 1 END AS no_link_ok, CASE WHEN k % 7 = 0 THEN k % 4 <> 1 END AS false_positive, CASE WHEN k % 6 = 0 THEN k % 4 <> 1 END AS alias_ok,
    (k % 4 < 2) = (k % 4 = 0) AS insight_ok, CASE WHEN k % 4 < 2 THEN k % 8 >= 2 END AS insight_correct, least(1.0::DOUBLE, 0.6::DOUBLE * (k % 10) / 10 + 0.4::DOUBLE * (k % 4) / 4) AS cluster_quality, CASE WHEN k % 8 = 0 THEN k % 3 > 0 END AS hallucinated FROM part),
y AS (SELECT *, (intent_ok::INT + evidence_ok::INT + 1 + expectation_ok::INT + section_ok::INT + cross_document_ok::INT + insight_ok::INT + (keyword_ratio >= 0.5)::INT) / 8.0::DOUBLE AS score FROM x),
z AS (SELECT *, CASE WHEN k % 8 = 0 THEN NOT hallucinated ELSE score >= 0.7 END AS passed FROM y)"""


@query(_EVAL + " SELECT case_type, count(*) AS cases, " + ", ".join(f"round_even(avg({r}::DOUBLE), 6) AS {r}" for r in E.RATES) + " FROM z GROUP BY ROLLUP (case_type)")
def evl12_rates(t: GraphTables) -> DataFrame:
    out = E.rates(E.measure(cases(t), answered(t)))
    return out.select("case_type", "cases", *[F.bround(r, 6).alias(r) for r in E.RATES])


@query(_EVAL + " SELECT 'case:' || k AS id, intent_ok, expectation_ok, keyword_ratio, entity_recall, false_positive, alias_ok, insight_correct, round_even(cluster_quality, 6) AS cluster_quality, score, passed, hallucinated FROM z")
def evl01_cases(t: GraphTables) -> DataFrame:
    out = E.measure(cases(t), answered(t))
    return out.select("id", "intent_ok", "expectation_ok", "keyword_ratio", "entity_recall", "false_positive", "alias_ok", "insight_correct", F.bround("cluster_quality", 6).alias("cluster_quality"), "score", "passed", "hallucinated")


@query("SELECT CASE WHEN p_partkey % 3 <> 1 THEN p_type ELSE 'general' END AS case_type, count(*) AS n, count(*) FILTER (WHERE p_partkey % 2 = 0) AS with_labels FROM part GROUP BY 1")
def src06_cases(t: GraphTables) -> DataFrame:
    return cases(t).groupBy("case_type").agg(F.count("*").alias("n"), F.count_if(F.size("expected_citation_labels") > 0).alias("with_labels"))


# --- ingest jobs: users as jobs, their events as stages


def job_events(t: GraphTables) -> DataFrame:
    kind = c("event_type")
    stage = F.when(kind == "signup", "uploaded").when(kind == "view", "parsing").when(kind == "click", "extracting_semantics").when(kind == "purchase", "completed").otherwise("unheard_of")
    return t.raw("events").select(cat("job:", c("user_id")).alias("job_id"), c("ts").cast("timestamp").alias("ts"), c("event_id").alias("seq"), stage.alias("stage"), F.when(c("value") > 90, "slow").alias("error"), F.create_map(kind, c("event_id").cast("string")).alias("details"))


_JOBS = """WITH e AS (SELECT 'job:' || user_id AS job_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'extracting_semantics' WHEN 'purchase' THEN 'completed' END AS stage, CASE WHEN value > 90 THEN 'slow' END AS error, event_type AS detail FROM events),
k AS (SELECT * FROM e WHERE stage IS NOT NULL)"""
_LAST = _JOBS + """, d1 AS (SELECT job_id, detail, arg_max(seq, {'ts': ts, 'seq': seq}) AS said FROM k GROUP BY ALL), d AS (SELECT job_id, '{' || string_agg('"' || detail || '":"' || said || '"', ',' ORDER BY detail) || '}' AS details FROM d1 GROUP BY 1)""" + ", l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS nth, count(*) OVER (PARTITION BY job_id) AS n_events FROM k) SELECT job_id, stage, CASE WHEN stage = 'completed' THEN 'completed' WHEN error IS NOT NULL THEN 'failed' ELSE 'running' END AS status, error, n_events, details FROM l JOIN d USING (job_id) WHERE nth = 1"


@query(_LAST)
def str01_job_states(t: GraphTables) -> DataFrame:
    return J.latest_state(J.split_stages(job_events(t))[0]).drop("ts")


@query("SELECT event_type = 'error' AS rejected, count(*) AS n FROM events GROUP BY 1")
def str02_stage_check(t: GraphTables) -> DataFrame:
    good, bad = J.split_stages(job_events(t))
    return good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True))).groupBy("rejected").agg(F.count("*").alias("n"))


@query(_JOBS + """, a AS (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts, seq) AS before FROM k), b AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) AS until FROM a WHERE before IS NULL OR before <> stage)
  SELECT job_id, seq, stage, epoch_us(until) // 1000 - epoch_us(ts) // 1000 AS ms FROM b WHERE until IS NOT NULL""")
def str03_durations(t: GraphTables) -> DataFrame:
    return J.stage_durations(J.split_stages(job_events(t))[0])


#: Rows of one file that a stream is fed.
ROWS_A_FILE = 1_000_000


def _fed(t: GraphTables, source: DataFrame, by: str, start: Callable[[DataFrame, str], None], times: int = 3) -> str:
    """Feeds a stream the rows of a frame in a few batches, one after another in the order of a column, each in as many files as its rows need.
    ``start`` runs the stream until it has read what is there, which is one batch; it comes back from its checkpoint for the next. The folder."""
    at, spark = new_path(t.spark, "stream"), t.spark
    files = max(1, -(-source.count() // (times * ROWS_A_FILE)))
    nth = F.floor(F.spark_partition_id() / F.lit(files)).cast("int")
    source.repartitionByRange(times * files, by).withColumn("nth", nth).write.partitionBy("nth").parquet(f"{at}/all")
    schema = T.StructType([*source.schema.fields, T.StructField("nth", T.IntegerType())])
    for k in range(times):
        part = spark.read.schema(schema).parquet(f"{at}/all").where(c("nth") == k).select(*source.columns)
        part.write.mode("append").parquet(f"{at}/in")
        start(spark.readStream.schema(source.schema).parquet(f"{at}/in"), at)
    return at


def _run(stream: DataFrame, at: str, sink, mode: str = "append") -> None:  # noqa: ANN001
    """Until it has read all there is: a state with timeouts would else ask for one batch without data after another."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(sink).start()
    conf.set(name, before)
    query.awaitTermination()


def _drained(t: GraphTables, source: DataFrame, build, mode: str, by: str) -> DataFrame:  # noqa: ANN001
    """What a stream over the rows of a frame wrote, with the number of its batch."""
    sink = lambda at: lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/{n}")
    at = _fed(t, source, by, lambda stream, at: _run(build(stream), at, sink(at), mode))
    return t.spark.read.parquet(f"{at}/out/*")


@query(_LAST)
def str01_job_stream(t: GraphTables) -> DataFrame:
    """The same states from a stream with a state per job, its events in no order; each job's last row counts."""
    rows = job_events(t).withColumn("mixed", F.xxhash64("seq"))
    out = _drained(t, rows, J.stream_states, "update", "mixed")
    return out.groupBy("job_id").agg(F.max_by(F.struct("stage", "status", "error", "n_events", "details"), "batch").alias("x")).select("job_id", "x.*")


@query(ORACLES["str03_durations"])
def str03_duration_stream(t: GraphTables) -> DataFrame:
    """The same durations from a stream of the events in their order."""
    return _drained(t, job_events(t), J.stream_durations, "append", "ts").drop("batch")


def _arrivals(t: GraphTables) -> DataFrame:
    """Documents as they arrive, some a day: copies come within the watermark and long after it."""
    day = F.make_interval(days=(c("doc_id") * 60 / F.lit(1000)).cast("int"))
    return L.text_hashes(t.raw("documents")).select("doc_id", "file_hash", (F.lit("2024-01-01").cast("timestamp") + day).alias("arrived_at"))


@query("SELECT DISTINCT md5(text) AS file_hash FROM documents")
def str04_arrivals(t: GraphTables) -> DataFrame:
    """Each hash once: near repeats go in the stream's state, later ones by the registry."""
    rows = _arrivals(t)
    at = _fed(t, rows, "doc_id", lambda stream, at: _run(J.stream_arrivals(stream), at, J.arrivals_sink(f"{at}/registry")))
    return J.registered(t.spark, f"{at}/registry", rows.schema).select("file_hash")


@query("SELECT md5(text) AS file_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def str04_first_arrivals(t: GraphTables) -> DataFrame:
    """The first document of each hash: no state in the stream, the registry alone decides."""
    rows = _arrivals(t)
    at = _fed(t, rows, "doc_id", lambda stream, at: _run(J.stream_arrivals(stream, watermark=None), at, J.arrivals_sink(f"{at}/registry", first=("doc_id",))))
    return J.registered(t.spark, f"{at}/registry", rows.schema).select("file_hash", "doc_id")


@query("SELECT source AS document_id, arg_max(md5(text), doc_id) AS file_hash, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1")
def str05_upserts(t: GraphTables) -> DataFrame:
    """Batches of documents upserted into a table that starts empty."""
    rows = t.raw("documents").select(c("source").alias("document_id"), F.md5("text").alias("file_hash"), "lang", c("doc_id").alias("seq"))
    at = _fed(t, rows, "seq", lambda stream, at: _run(stream, at, J.upsert_sink(f"{at}/table", ["document_id"])))
    return J.upserted(t.spark, f"{at}/table", rows.schema).drop("seq")
