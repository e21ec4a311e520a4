"""URL filters: block and allow rules, and gradient-boosted trees over lexical features (native).

Rules decide the URLs that they fit. Every other URL is judged by gradient-boosted trees (Spark's own) over features of
its text: length, depth, digit ratio, entropy, parameter counts, and how often labelled URLs of the same host suffixes and
first path segment were blocked. All of it is DataFrame work; the trees are trained on a bounded sample of labelled URLs,
the suffix statistics cover all of them. A URL's own label is never in the statistics that the trees are trained with: those leave
out the URL's fold, a hash of its text.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and goes to the trees like any
other; a URL of any length is judged whole; without labelled URLs of both classes the trees' verdict is the only class known, or
allow; a score of just 0.5 blocks; rows that repeat are judged alike; an empty table gives no rows. Extra columns are kept, whatever
their names, but for those named as the results are (host, path, rule, verdict, p_block), which the results replace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
SAMPLE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATS = ("suffix1", "suffix2", "segment")
FEATURES = ("f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens", "f_entropy", "f_host_entropy", "f_params", "f_fragment", *(f"f_{s}" for s in STATS))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """of, rules: for each distinct host that a rule's host fits, those rules, the longest first.

    A host is looked up by its suffixes, so a rule list of any size is an equi-join; paths are compared later, row by row. No suffix has
    more labels than the longest host of a rule, whatever the host has."""
    labels = F.split("of", r"\.")
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    last = F.slice(labels, -F.least(F.lit(most), F.size(labels)), most)
    suffixes = F.transform(F.sequence(F.lit(1), F.size("last")), lambda i: F.array_join(F.slice("last", -i, i), "."))
    keys = hosts.where("of <> ''").distinct().withColumn("last", last).select("of", F.explode(suffixes).alias("rule_host"))
    name = F.concat("rule_host", "rule_path")
    rule = F.struct(F.length(name).alias("n"), F.length("rule_host").alias("h"), name.alias("rule"), F.col("rule_path").alias("start"), F.col("rule_verdict").alias("verdict"))
    return keys.join(rules, "rule_host").groupBy("of").agg(F.sort_array(F.collect_list(rule), asc=False).alias("rules"))


def with_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, ...) with rule and rule_verdict, null where none fits."""
    table = materialise(host_rules(rows.select(F.col("host").alias("of")), rules), "url-rules")
    best = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), 0)
    out = rows.join(table, F.col("host") == F.col("of"), "left").withColumn("best", best)
    return out.withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.verdict")}).drop("of", "rules", "best")


def entropy(text: Column) -> Column:
    """Shannon entropy of a lower-case text's characters, in bits."""
    n = F.length(text).cast("double")
    plain = F.regexp_replace(text, "[^a-z0-9./:?&=_%#-]", "~")  # rare characters count as one
    chars = F.array_distinct(F.split(plain, ""))
    count = lambda c: (n - F.length(F.replace(plain, c))) / n
    bits = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - count(c) * F.log2(count(c)))
    return F.coalesce(F.when(n > 0, bits), F.lit(0.0))


def with_features(pages: DataFrame) -> DataFrame:
    """pages with host and path, the lexical features and the keys of the suffix statistics."""
    url, host, path = F.lower(F.coalesce("url", F.lit(""))), F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    query = F.coalesce(F.regexp_extract(F.col("url"), r"\?([^#]*)", 1), F.lit(""))
    share = lambda s, chars: F.coalesce(F.when(F.length(s) > 0, (F.length(s) - F.length(F.translate(s, chars, ""))) / F.length(s)), F.lit(0.0))
    count = lambda s, c: F.length(s) - F.length(F.translate(s, c, ""))
    found = {
        "f_length": F.length(url), "f_host_length": F.length(host), "f_depth": count(path, "/"), "f_labels": F.size(labels),
        "f_digits": share(url, "0123456789"), "f_host_digits": share(host, "0123456789"), "f_hyphens": count(host, "-"),
        "f_entropy": entropy(url), "f_host_entropy": entropy(host),
        "f_params": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0), "f_fragment": F.when(F.coalesce(F.col("url"), F.lit("")).contains("#"), 1).otherwise(0),
    }
    keys = {"suffix1": F.element_at(labels, -1), "suffix2": F.array_join(F.slice(labels, -F.least(F.lit(2), F.size(labels)), 2), "."), "segment": F.coalesce(F.get(F.split(path, "/"), 1), F.lit(""))}
    return pages.withColumns({k: v.cast("double") for k, v in found.items()} | keys)


@dataclass
class UrlModel:
    """The trees (None where only one class is known), that class, and the statistics of each suffix."""

    trees: object
    only: float
    stats: dict[str, DataFrame]
    prior: float

    def features(self, rows: DataFrame) -> DataFrame:
        for key, table in self.stats.items():
            rate = table.select(F.col(key).alias("of"), F.col("rate").alias(f"f_{key}"))
            rows = rows.join(rate, F.col(key) == F.col("of"), "left").drop("of").withColumn(f"f_{key}", F.coalesce(f"f_{key}", F.lit(self.prior)))
        return rows

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with p_block."""
        if self.trees is None:
            return rows.withColumn("p_block", F.lit(self.only))
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="f_all").transform(self.features(rows))
        out = self.trees.transform(ready)
        return out.withColumn("p_block", vector_to_array("probability")[1])


def learn(labelled: DataFrame, sample: int = SAMPLE, smooth: float = 20.0, trees: int = 10, depth: int = 4, folds: int = 5) -> UrlModel:
    """Fit on a frame of url, host, path and blocked (0 or 1): statistics over all rows, trees on about ``sample`` distinct URLs, each
    weighing as often as it stands."""
    n, ones = labelled.agg(F.count("*"), F.sum("blocked")).first()
    prior = (ones or 0) / n if n else 0.0
    if not 0 < prior < 1:
        return UrlModel(None, prior, {}, prior)
    # each URL once from here on: neither statistics nor trees are made of a hot URL's copies
    urls = labelled.groupBy("url", "host", "path").agg(F.sum("blocked").alias("ones"), F.count("*").alias("n"))
    urls = materialise(with_features(urls).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(folds)).cast("int")), "url-labelled")
    rate = lambda ones, n: (ones + F.lit(smooth * prior)) / (n + smooth)
    stats, apart = {}, {}
    for k in STATS:
        by_fold = materialise(urls.groupBy(k, "fold").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")), f"url-{k}")
        every = by_fold.groupBy(F.col(k).alias("of")).agg(F.sum("ones").alias("all_ones"), F.sum("n").alias("all_n"))
        stats[k] = materialise(every.select(F.col("of").alias(k), rate(F.col("all_ones"), F.col("all_n")).alias("rate")), f"url-{k}-rate")
        others = by_fold.join(every, F.col(k) == F.col("of"))
        apart[k] = materialise(others.select(F.col(k).alias("of"), F.col("fold").alias("apart"), rate(F.col("all_ones") - F.col("ones"), F.col("all_n") - F.col("n")).alias(f"f_{k}")), f"url-{k}-apart")
    model = UrlModel(None, prior, stats, prior)
    many = urls.count()
    train = urls.where(F.pmod(F.xxhash64(F.lit("url"), "url"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / max(1, many)))))
    for k, table in apart.items():
        train = train.join(table, (F.col(k) == F.col("of")) & (F.col("fold") == F.col("apart"))).drop("of", "apart")
    train = train.select(*FEATURES, (F.col("ones") * 2 >= F.col("n")).cast("double").alias("label"), F.col("n").cast("double").alias("weight"))
    train = materialise(VectorAssembler(inputCols=list(FEATURES), outputCol="f_all").transform(train).select("f_all", "label", "weight").repartition(4), "url-train")
    if train.agg(F.countDistinct("label")).first()[0] == 2:
        model.trees = GBTClassifier(featuresCol="f_all", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=1, maxBins=32).fit(train)
    else:
        model.only = float(prior >= 0.5)
    return model


def parsed(pages: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """page (a struct of the input's columns), url, host, path, rule and rule_verdict: the input's names can't meet the operator's own."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return with_rule(rows, rule_table(pages.sparkSession, rules))


def labels_of(ruled: DataFrame) -> DataFrame:
    """url, host, path, blocked of the URLs that rules decide."""
    return ruled.where(F.col("rule").isNotNull()).select("url", "host", "path", F.when(F.col("rule_verdict") == "block", 1).otherwise(0).alias("blocked"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, model: UrlModel | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and p_block. Unless a model is given, it is trained on the URLs that rules decide."""
    ruled = parsed(pages, rules)
    judged = (model or learn(labels_of(ruled))).score(with_features(ruled))
    verdict = F.coalesce("rule_verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    kept = [F.col(f"page.`{c}`").alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict", "p_block")]
    return judged.select(*kept, "host", "path", "rule", verdict.alias("verdict"), "p_block")
