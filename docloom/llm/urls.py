"""URL filters: allow and block rules by host suffix and path, and gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs: those that a rule decides carry its verdict. Features are length, depth, digit
ratio, entropy, parameter counts and suffix statistics, the latter being smoothed shares of allowed URLs by host suffix
and by first path segment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import hash_share, table, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: About so many different labelled URLs, chosen by a hash of the URL, are fitted on; pseudo-counts of a suffix share; trees;
#: rows of suffix statistics that may be broadcast (about 60 bytes each; more are joined by a shuffle); folds of URLs.
SAMPLE, SMOOTHING, TREES, DEPTH, BROADCAST_SUFFIXES, FOLDS = 20_000, 20.0, 20, 4, 200_000, 5
LEXICAL = ["length", "host_length", "path_length", "query_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "secure", "longest_segment"]
SUFFIXES = ["tld", "site", "section"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. Empty for null or no `://`."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.regexp_extract(text, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path the URL's starts with; null if there is none."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):  # later ones are longer and win
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def with_features(urls: DataFrame, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    chars = F.split(url, "")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    return urls.withColumns(
        {
            "length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "query_length": F.length(query),
            "depth": F.size(segments),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
            "entropy": entropy,
            "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
            "labels": F.size(labels),
            "hyphens": F.regexp_count(F.col("host"), F.lit("-")),
            "secure": url.startswith("https://").cast("int"),
            "longest_segment": F.coalesce(F.array_max(F.transform(segments, lambda s: F.length(s))), F.lit(0)),
            "tld": F.when(F.size(labels) > 0, F.element_at(labels, -1)).otherwise(""),
            "site": F.when(F.size(labels) > 1, last(2)).otherwise(F.col("host")),
            "section": F.coalesce(F.get(segments, 0), F.lit("")),
        }
    )


@dataclass
class UrlModel:
    """Trees, or a constant score where the labels have one class only, with the statistics of suffixes."""

    trees: GBTClassificationModel | None
    constant: float
    statistics: DataFrame
    prior: float
    few: bool


def url_fold(url_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(url_col), F.lit(3)), F.lit(FOLDS))


def suffix_statistics(labelled: DataFrame, url_col: str = "url") -> DataFrame:
    """(level, suffix, fold, n, good) over all labelled URLs, each `copies` times; fold -1 is the sum of all folds of URLs."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("level"), F.col(s).alias("suffix")) for s in SUFFIXES))).alias("p")
    rows = labelled.select("allowed", "copies", url_fold(url_col).alias("fold"), pairs).select("p.*", F.explode(F.array("fold", F.lit(-1).cast("long"))).alias("fold"), "allowed", "copies")
    return rows.groupBy("level", "suffix", "fold").agg(F.sum("copies").alias("n"), F.sum(F.col("allowed") * F.col("copies")).alias("good"))


def with_statistics(df: DataFrame, statistics: DataFrame, prior: float, few: bool, url_col: str | None = None) -> DataFrame:
    """df with the smoothed share of allowed URLs and the number of labelled ones of each suffix; with `url_col`, without those of the row's own fold of URLs, so that no label tells of itself."""
    for s in SUFFIXES:
        level = statistics.where(F.col("level") == s).select(F.col("suffix").alias(s), "fold", F.col("n").alias("_n"), F.col("good").alias("_good"))
        every = level.where("fold = -1").drop("fold")
        df = df.join(F.broadcast(every) if few else every, s, "left")
        n, good = F.coalesce("_n", F.lit(0)), F.coalesce("_good", F.lit(0))
        if url_col:
            own = level.where("fold >= 0").select(s, F.col("fold").alias("_fold"), F.col("_n").alias("_m"), F.col("_good").alias("_own"))
            df = df.withColumn("_fold", url_fold(url_col)).join(F.broadcast(own) if few else own, [s, "_fold"], "left")
            n, good = n - F.coalesce("_m", F.lit(0)), good - F.coalesce("_own", F.lit(0))
        df = df.withColumns({f"{s}_rate": (good + SMOOTHING * prior) / (n + SMOOTHING), f"{s}_seen": F.log1p(n)}).drop("_n", "_good", "_m", "_own", "_fold")
    return df


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=LEXICAL + [f"{s}_{x}" for s in SUFFIXES for x in ("rate", "seen")], outputCol="_features").transform(df)


def train(labelled: DataFrame, url_col: str = "url", sample: int = SAMPLE, seed: int = 7) -> UrlModel:
    """From rows of (url, host, path, allowed 0/1): statistics over all of them, trees on about `sample` different URLs. No rows: everything is allowed."""
    each = labelled.groupBy(url_col, "host", "path", "allowed").agg(F.count("*").alias("copies"))
    each = written(each, "labelled")
    statistics = written(suffix_statistics(with_features(each, url_col), url_col), "suffixes")
    count = each.agg(F.count("*").alias("urls"), F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("allowed")).alias("good")).first()
    n, good = count["n"] or 0, count["good"] or 0
    prior = good / n if n else 1.0
    few = statistics.count() <= BROADCAST_SUFFIXES
    if good in (0, n):
        return UrlModel(None, prior, statistics, prior, few)
    chosen = with_features(each.where(hash_share(F.col(url_col), seed) < min(1.0, sample / count["urls"])), url_col)
    rows = assembled(with_statistics(chosen, statistics, prior, few, url_col)).select("_features", F.col("allowed").cast("double").alias("allowed"))
    rows = written(rows.coalesce(8), "url_sample")
    if rows.agg(F.countDistinct("allowed")).first()[0] < 2:
        return UrlModel(None, prior, statistics, prior, few)
    trees = GBTClassifier(featuresCol="_features", labelCol="allowed", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed).fit(rows)
    return UrlModel(trees, prior, statistics, prior, few)


def score(df: DataFrame, model: UrlModel, url_col: str = "url") -> DataFrame:
    """df (with host and path) and `score`, how likely the URL is allowed."""
    if model.trees is None:
        return df.withColumn("score", F.lit(float(model.constant)))
    rows = assembled(with_statistics(with_features(df, url_col), model.statistics, model.prior, model.few))
    done = model.trees.transform(rows)
    return done.withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row: verdict is the longest fitting rule's, else that of the trees.

    Null URLs and URLs without `://` have an empty host and path and are judged by the trees. Ids may be null, rows may
    repeat, other columns are not read; without any ruled URL everything is allowed; an empty table gives no rows.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path("_url")
    placed = own.withColumns({"host": host, "path": path})
    ruled = placed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for verdict, rule in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    ruled = ruled.withColumn("_said", said)
    labelled = ruled.where(F.col("_said").isNotNull()).withColumn("allowed", (F.col("_said") == "allow").cast("int")).select("_url", "host", "path", "allowed")
    scored = score(ruled, train(labelled, "_url", sample), "_url")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
