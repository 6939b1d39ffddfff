"""Registered queries of the evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import joins, stats
from docloom.plans.text_queries import read


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def grouping_sets_describe(spark, sf):
    out = stats.describe(read(spark, sf, "lineitem"), [["l_returnflag"], ["l_linestatus", "l_returnflag"]], "l_extendedprice")
    return rounded(out, "mean", "sd", "median", "q1", "q3", "p95")


def describe_interval(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    out = stats.with_interval(stats.describe(d, [["lang"], ["lang", "source"]], "n_chars"))
    return rounded(out, "mean", "sd", "median", "q1", "q3", "p95", "ci_low", "ci_high")


def confusion_metrics(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return rounded(stats.confusion(d, ["lang"], F.col("n_chars") > 1200, F.col("quality") == 1), "precision", "recall", "f1")


def votes(spark, sf):
    """Events as votes of users: the unit is a day and hour, the rater a user's remainder, the vote the event's type."""
    return read(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("unit"), "event_type", "event_id", (F.col("user_id") % 4).cast("int").alias("rater"), (F.col("event_id") % 5 + 1).cast("int").alias("score"))


def majority_vote(spark, sf):
    return stats.majority(votes(spark, sf), ["unit"], "event_type")


def item_summary(spark, sf):
    """Items, their mean score and share of good ones by scope, the scope `all` over both."""
    v = votes(spark, sf).withColumn("scope", F.when(F.substring("unit", 12, 2) < "12", "in").otherwise("out"))
    item = v.groupBy("unit", "scope").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    out = item.withColumn("good", (F.col("mean_score") >= 4).cast("int"))
    scored = stats.describe(out, [[], ["scope"]], "mean_score", "all").select("scope", "n", "mean", "sd")
    rate = stats.describe(out, [[], ["scope"]], "good", "all").select("scope", (100 * F.col("mean")).alias("good_pct"))
    return rounded(scored.join(rate, "scope"), "mean", "sd", "good_pct")


ARMS = {"rag - base": {"N": -1.0, "R": 1.0}, "interaction": {"A": 1.0, "N": -2.0, "R": 1.0}}


def arms(spark, sf):
    """Mean price by supplier and return flag, flags as arms."""
    per = read(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg(F.col("l_extendedprice")).alias("v"))
    return joins.complete_arms(per, "l_suppkey", "l_returnflag", "v", ["A", "N", "R"])


def paired_contrast(spark, sf):
    return rounded(stats.contrasts(arms(spark, sf), ARMS), "mean_diff", "sd", "t", "dz")


def paired_tests(spark, sf):
    return rounded(stats.contrasts(arms(spark, sf), ARMS, tests=True), "mean_diff", "sd", "t", "dz", "p_t", "p_wilcoxon")


def discordant_pairs(spark, sf):
    l = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max((F.col("l_quantity") > 40).cast("int")).alias("a"), F.max((F.col("l_discount") > 0.08).cast("int")).alias("b"))
    return rounded(stats.discordance(l, [("a", "b")]), "diff_pp", "p")


def contrast_holm(spark, sf):
    """Suppliers' shares of late lines as stand-ins for p values, corrected inside each nation."""
    p = read(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_discount") > 0.09) / F.count("*") / 4).alias("p"))
    rows = p.join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_suppkey", "s_nationkey", F.when(F.col("l_suppkey") % 9 != 0, F.col("p")).alias("p"))
    return rounded(stats.holm(rows, ["s_nationkey"], "p", ["l_suppkey"]), "p", "p_holm")


def ratings(spark, sf):
    return votes(spark, sf).groupBy("unit", "rater").agg(F.min_by("score", "event_id").alias("score"))


def kappa_pairwise(spark, sf):
    pairs = stats.rater_pairs(ratings(spark, sf), ["unit"], "rater", "score")
    plain, quadratic = stats.cohen_kappa(pairs, 5, False), stats.cohen_kappa(pairs, 5, True).withColumnRenamed("kappa", "qwk").drop("n_units")
    return rounded(plain.join(quadratic, ["rater_a", "rater_b"]), "kappa", "qwk")


def fleiss_kappa(spark, sf):
    return rounded(stats.fleiss_kappa(ratings(spark, sf), ["unit"], "score"), "kappa")


def pearson_spearman(spark, sf):
    l = read(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(stats.correlations(l, "l_quantity", "l_extendedprice", ["l_returnflag"]), "pearson", "spearman")


def bootstrap_interval(spark, sf):
    """Parts by size as clusters: price against the length of the type."""
    p = read(spark, sf, "part").select("p_size", F.col("p_retailprice").alias("x"), F.length("p_type").alias("y"))
    return rounded(stats.bootstrap_interval(p, "p_size", "x", "y"), "pearson_low", "pearson_high", "spearman_low", "spearman_high")


def correlation_tests(spark, sf):
    """Correlations with p values by language: length against the share of spaces, which is 0 for an empty text and null for none."""
    spaces = F.when(F.col("text").isNotNull(), text.share_of(F.col("text"), " "))
    d = read(spark, sf, "documents").select("lang", "n_chars", spaces.alias("spaces"))
    return rounded(stats.correlations(d, "n_chars", "spaces", ["lang"], tests=True), "pearson", "spearman", "p_pearson", "p_spearman")


def rated(spark, sf):
    """Events as ratings: hours as items, users' remainders as raters and models, the first event of each."""
    e = read(spark, sf, "events").withColumns({"unit": F.date_format("ts", "yyyy-MM-dd"), "rater": (F.col("user_id") % 4).cast("int"), "model": F.concat(F.lit("m"), F.col("user_id") % 3)})
    return e.groupBy("unit", "rater", "model").agg(F.min("event_id").alias("e")).select("unit", "rater", "model", (F.col("e") % 5 + 1).cast("int").alias("accuracy"), (F.col("e") % 4 + 1).cast("int").alias("type"))


def agreement_table(spark, sf):
    return rounded(stats.agreement_table(rated(spark, sf), ["unit"], "rater", "model", {"accuracy": (5, True), "type": (4, False)}), "kappa")


def fleiss_equal_raters(spark, sf):
    """Only the items that all four raters have rated once."""
    return rounded(stats.fleiss_kappa(stats.equal_raters(ratings(spark, sf), ["unit"], "rater", 4), ["unit"], "score"), "kappa")


def unpivot_pivot(spark, sf):
    q = read(spark, sf, "labels")
    long = q.unpivot(["doc_id"], ["quality", "toxic"], "metric", "value")
    return long.groupBy((F.col("doc_id") % 10).alias("bucket")).pivot("metric", ["quality", "toxic"]).agg(F.sum("value"))


QUERIES = {f.__name__: f for f in (grouping_sets_describe, describe_interval, confusion_metrics, majority_vote, item_summary, paired_contrast, paired_tests, discordant_pairs, contrast_holm, kappa_pairwise, fleiss_kappa, pearson_spearman, bootstrap_interval, unpivot_pivot, correlation_tests, agreement_table, fleiss_equal_raters)}

_UNIT = "strftime(ts, '%Y-%m-%d %H')"
_RATINGS = f"r AS (SELECT {_UNIT} AS unit, user_id % 4 AS rater, arg_min(event_id % 5 + 1, event_id) AS score FROM events GROUP BY 1, 2)"
_ARMS = "p AS (SELECT l_suppkey, l_returnflag AS f, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT l_suppkey, max(v) FILTER (f = 'A') AS a, max(v) FILTER (f = 'N') AS n, max(v) FILTER (f = 'R') AS r FROM p GROUP BY 1), g AS (SELECT * FROM w WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL)"
_STATS = "count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3, round(quantile_cont(x, 0.95), 6) AS p95"

ORACLES = {
    "grouping_sets_describe": f"SELECT CASE WHEN grouping(s) = 1 THEN 'ALL' ELSE s END AS l_linestatus, f AS l_returnflag, {_STATS} FROM (SELECT l_linestatus AS s, l_returnflag AS f, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem) GROUP BY GROUPING SETS ((f), (s, f))",
    "confusion_metrics": """WITH d AS (SELECT lang, n_chars > 1200 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn FROM d GROUP BY 1)
        SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
    "majority_vote": f"""WITH c AS (SELECT {_UNIT} AS unit, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT unit, max(n) AS top, CAST(sum(n) AS BIGINT) AS votes FROM c GROUP BY 1)
        SELECT unit, any_value(votes) AS votes, CASE WHEN count(*) > 1 THEN 'no_majority' ELSE any_value(event_type) END AS majority FROM c JOIN m USING (unit) WHERE n = top GROUP BY 1""",
    "item_summary": f"""WITH i AS (SELECT {_UNIT} AS unit, avg(event_id % 5 + 1) AS x FROM events GROUP BY 1), s AS (SELECT x, CASE WHEN substr(unit, 12, 2) < '12' THEN 'in' ELSE 'out' END AS scope FROM i)
        SELECT CASE WHEN grouping(scope) = 1 THEN 'all' ELSE scope END AS scope, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(100 * avg(CAST(x >= 4 AS INT)), 6) AS good_pct FROM s GROUP BY GROUPING SETS ((), (scope))""",
    "paired_contrast": f"""WITH {_ARMS}, d AS (SELECT 'rag - base' AS contrast, r - n AS d FROM g UNION ALL SELECT 'interaction', a - 2 * n + r FROM g), s AS (SELECT contrast, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d GROUP BY 1)
        SELECT contrast, n, round(m, 6) AS mean_diff, round(sd, 6) AS sd, round(m / sd, 6) AS dz, round(m / sd * sqrt(n), 6) AS t FROM s""",
    "contrast_holm": """WITH q AS (SELECT l_suppkey, count(*) FILTER (l_discount > 0.09) / count(*) / 4 AS p FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey, s_nationkey, CASE WHEN l_suppkey % 9 <> 0 THEN p END AS p FROM q JOIN supplier ON l_suppkey = s_suppkey),
        k AS (SELECT *, count(p) OVER (PARTITION BY s_nationkey) AS m, row_number() OVER (PARTITION BY s_nationkey ORDER BY p NULLS LAST, l_suppkey) AS i FROM r)
        SELECT l_suppkey, s_nationkey, round(p, 6) AS p, CASE WHEN p IS NOT NULL THEN round(max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY s_nationkey ORDER BY i ROWS UNBOUNDED PRECEDING), 6) END AS p_holm FROM k""",
    "kappa_pairwise": f"""WITH {_RATINGS}, p AS (SELECT x.rater AS ra, y.rater AS rb, x.score AS a, y.score AS b FROM r x JOIN r y USING (unit) WHERE x.rater < y.rater), t AS (SELECT ra, rb, count(*) AS n, avg(CAST(a <> b AS INT)) AS o, avg(((a - b) / 4.0) ** 2) AS oq FROM p GROUP BY 1, 2),
        ma AS (SELECT ra, rb, a, count(*) AS n FROM p GROUP BY 1, 2, 3), mb AS (SELECT ra, rb, b, count(*) AS n FROM p GROUP BY 1, 2, 3), e AS (SELECT ra, rb, sum(ma.n * mb.n * CAST(a <> b AS INT)) AS e, sum(ma.n * mb.n * ((a - b) / 4.0) ** 2) AS eq FROM ma JOIN mb USING (ra, rb) GROUP BY 1, 2)
        SELECT CAST(ra AS INT) AS rater_a, CAST(rb AS INT) AS rater_b, n AS n_units, round(1 - o * n * n / nullif(e, 0), 6) AS kappa, round(1 - oq * n * n / nullif(eq, 0), 6) AS qwk FROM t JOIN e USING (ra, rb)""",
    "fleiss_kappa": f"""WITH {_RATINGS}, v AS (SELECT unit, score, count(*) AS c FROM r GROUP BY 1, 2), u AS (SELECT unit, CAST(sum(c) AS BIGINT) AS n, sum(c * c) AS sq FROM v GROUP BY 1), f AS (SELECT * FROM u WHERE n = (SELECT max(n) FROM u)),
        s AS (SELECT score, sum(c) AS c FROM v WHERE unit IN (SELECT unit FROM f) GROUP BY 1), e AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS pe FROM s)
        SELECT n AS n_raters, count(*) AS n_units, round((avg((sq - n) / (n * (n - 1))) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM f, e GROUP BY n""",
    "pearson_spearman": """WITH k AS (SELECT l_returnflag AS f, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY f ORDER BY x) + (count(*) OVER (PARTITION BY f, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY f ORDER BY y) + (count(*) OVER (PARTITION BY f, y) - 1) / 2 AS ry FROM k)
        SELECT f AS l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""",
    "unpivot_pivot": "SELECT doc_id % 10 AS bucket, CAST(sum(quality) AS BIGINT) AS quality, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels GROUP BY 1",
    "discordant_pairs": """WITH l AS (SELECT l_orderkey, max(CAST(l_quantity > 40 AS INT)) AS a, max(CAST(l_discount > 0.08 AS INT)) AS b FROM lineitem GROUP BY 1),
        c AS (SELECT 'a - b' AS contrast, count(*) AS n, round(100 * (avg(a) - avg(b)), 6) AS diff_pp, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b FROM l),
        s AS (SELECT *, unnest(range(0, least(only_a, only_b) + 1)) AS i, only_a + only_b AS m FROM c)
        SELECT contrast, n, diff_pp, only_a, only_b, CASE WHEN only_a = only_b THEN 1.0 ELSE round(least(1.0, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))), 6) END AS p FROM s GROUP BY contrast, n, diff_pp, only_a, only_b""",
    "bootstrap_interval": """WITH d AS (SELECT p_size AS k, CAST(p_retailprice AS DOUBLE) AS x, CAST(length(p_type) AS DOUBLE) AS y FROM part), c AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS number FROM (SELECT DISTINCT k FROM d)), n AS (SELECT count(*) AS n FROM c),
        w AS (SELECT rep, CAST('0x' || substr(md5('42:' || rep || ':' || draw), 1, 15) AS BIGINT) % n AS number FROM n, (SELECT unnest(range(1, 1001)) AS rep), (SELECT unnest(range(0, n)) AS draw FROM n)),
        t AS (SELECT rep, number, count(*) AS times FROM w GROUP BY 1, 2), v AS (SELECT rep, x, y, CAST(sum(times) AS DOUBLE) AS w FROM t JOIN c USING (number) JOIN d USING (k) GROUP BY 1, 2, 3),
        rx AS (SELECT rep, x, sum(w) OVER (PARTITION BY rep ORDER BY x) - (w - 1) / 2 AS r FROM (SELECT rep, x, sum(w) AS w FROM v GROUP BY 1, 2)), ry AS (SELECT rep, y, sum(w) OVER (PARTITION BY rep ORDER BY y) - (w - 1) / 2 AS r FROM (SELECT rep, y, sum(w) AS w FROM v GROUP BY 1, 2)),
        a AS (SELECT rep, w, x - (SELECT avg(x) FROM d) AS x, y - (SELECT avg(y) FROM d) AS y, rx.r AS p, ry.r AS q FROM v JOIN rx USING (rep, x) JOIN ry USING (rep, y)),
        s AS (SELECT rep, sum(w) AS n, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / sqrt((sum(w * x * x) - sum(w * x) ** 2 / sum(w)) * (sum(w * y * y) - sum(w * y) ** 2 / sum(w))) AS pe,
          (sum(w * p * q) - sum(w * p) * sum(w * q) / sum(w)) / sqrt((sum(w * p * p) - sum(w * p) ** 2 / sum(w)) * (sum(w * q * q) - sum(w * q) ** 2 / sum(w))) AS sp FROM a GROUP BY rep)
        SELECT count(*) AS repetitions, round(quantile_cont(pe, 0.025), 6) AS pearson_low, round(quantile_cont(pe, 0.975), 6) AS pearson_high, round(quantile_cont(sp, 0.025), 6) AS spearman_low, round(quantile_cont(sp, 0.975), 6) AS spearman_high FROM s""",
    "agreement_table": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 4 AS rater, 'm' || (user_id % 3) AS m, min(event_id) AS e FROM events GROUP BY 1, 2, 3),
        v AS (SELECT unnest(['all', m]) AS model, day || m AS unit, rater, e FROM e), l AS (SELECT model, unit, rater, 'accuracy' AS measure, e % 5 + 1 AS v, 4.0 AS w FROM v UNION ALL SELECT model, unit, rater, 'type', e % 4 + 1, 0.0 FROM v),
        p AS (SELECT x.model, x.measure, x.rater || '-' || y.rater AS raters, x.v AS a, y.v AS b, x.w FROM l x JOIN l y ON x.model = y.model AND x.measure = y.measure AND x.unit = y.unit AND x.rater < y.rater),
        d AS (SELECT *, CASE WHEN w > 0 THEN ((a - b) / w) ** 2 ELSE CAST(a <> b AS INT) END AS c FROM p), t AS (SELECT model, measure, raters, any_value(w) AS w, count(*) AS n, avg(c) AS seen FROM d GROUP BY 1, 2, 3),
        ma AS (SELECT model, measure, raters, a, count(*) AS n FROM p GROUP BY 1, 2, 3, 4), mb AS (SELECT model, measure, raters, b, count(*) AS n FROM p GROUP BY 1, 2, 3, 4),
        x AS (SELECT model, measure, raters, sum(ma.n * mb.n * CASE WHEN measure = 'accuracy' THEN ((a - b) / 4.0) ** 2 ELSE CAST(a <> b AS INT) END) AS chance FROM ma JOIN mb USING (model, measure, raters) GROUP BY 1, 2, 3),
        c AS (SELECT model, measure, unit, v, count(*) AS c FROM l GROUP BY 1, 2, 3, 4), u AS (SELECT model, measure, unit, sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY 1, 2, 3),
        f AS (SELECT * FROM u WHERE n = (SELECT max(n) FROM u o WHERE o.model = u.model AND o.measure = u.measure)), g AS (SELECT model, measure, v, sum(c) AS c FROM c JOIN f USING (model, measure, unit) GROUP BY 1, 2, 3),
        e2 AS (SELECT model, measure, sum(c * c) / (sum(c) * sum(c)) AS pe FROM g GROUP BY 1, 2), po AS (SELECT model, measure, count(*) AS n, avg((sq - n) / (n * (n - 1))) AS po, max(n) AS raters FROM f GROUP BY 1, 2)
        SELECT model, measure, raters, n AS n_units, round(1 - seen * n * n / nullif(chance, 0), 6) AS kappa FROM t JOIN x USING (model, measure, raters)
        UNION ALL SELECT model, measure, 'fleiss', n, CASE WHEN po.raters >= 2 AND n >= 2 AND pe < 1 THEN round((po - pe) / (1 - pe), 6) END FROM po JOIN e2 USING (model, measure)""",
    "fleiss_equal_raters": f"""WITH {_RATINGS}, k AS (SELECT unit FROM r GROUP BY 1 HAVING count(*) = 4), v AS (SELECT unit, score, count(*) AS c FROM r WHERE unit IN (SELECT unit FROM k) GROUP BY 1, 2), u AS (SELECT unit, sum(c * c) AS sq FROM v GROUP BY 1),
        s AS (SELECT score, sum(c) AS c FROM v GROUP BY 1), e AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS pe FROM s)
        SELECT CAST(4 AS BIGINT) AS n_raters, count(*) AS n_units, round((avg((sq - 4) / 12) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM u, e""",
}
