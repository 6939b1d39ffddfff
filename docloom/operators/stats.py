"""Evaluation statistics: descriptive grouping sets, majority votes, contrasts with Holm's correction, agreement, correlation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docloom.functions.distributions import mcnemar_p, t_critical, t_p_value, wilcoxon_p
from docloom.operators import ordered
from docloom.shared import written


def describe(df: DataFrame, sets: list[list[str]], value: str, total: str = "ALL") -> DataFrame:
    """n, mean, sd, median, quartiles and 95th percentile by each grouping set; a column that a set leaves out is `total`.

    Percentiles are exact, with linear interpolation: rows are counted by value, and values are picked by their running
    counts, which are summed up by ranges, so that no task holds a group's values.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    label = lambda c, s: (F.col(c).cast("string") if c in s else F.lit(total)).alias(c)
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("_set"), *(label(c, s) for c in columns)) for i, s in enumerate(sets)))).alias("g")
    cells = df.select(*columns, F.col(value).cast("double").alias("_v"))
    keys = ["_set", *columns]
    groups = cells.select(every, "_v").select("g.*", "_v").groupBy(*keys).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"))
    # values are counted by the finest cells once, and these counts rolled up to every set
    fine = cells.where("_v IS NOT NULL").groupBy(*columns, "_v").agg(F.count("*").alias("_c"))
    counts = fine.select(every, "_v", "_c").select("g.*", "_v", "_c").groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    ranked = ordered.running(counts, keys, ["_v"], "_c", "_before", total="_all")
    shares = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p95": 0.95}
    holds = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_c"))
    at = lambda q, n: (F.col(n) - 1) * q
    picks = [F.max(F.when(holds(f(at(q, "_all"))), F.col("_v"))).alias(f"{a}_{name}") for a, q in shares.items() for name, f in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked.groupBy(*keys).agg(*picks).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(f"{a}_{e}" for a in shares for e in ("lo", "hi")))
    joined = groups.join(found, [groups[k].eqNullSafe(found[f"_k{i}"]) for i, k in enumerate(keys)], "left")
    mixed = lambda a, q: (F.col(f"{a}_lo") + (F.col(f"{a}_hi") - F.col(f"{a}_lo")) * (at(q, "n") - F.floor(at(q, "n")))).alias(a)
    return joined.select(*(groups[c] for c in columns), "n", "mean", "sd", *(mixed(a, q) for a, q in shares.items()))


def with_interval(described: DataFrame, level: float = 0.95) -> DataFrame:
    """described with ci_low and ci_high of the mean by Student's t; null below two values."""
    half = t_critical(F.lit(1 - (1 - level) / 2), F.when(F.col("n") > 1, F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n")
    return described.withColumn("_h", half).withColumn("ci_low", F.col("mean") - F.col("_h")).withColumn("ci_high", F.col("mean") + F.col("_h")).drop("_h")


def majority(df: DataFrame, unit: list[str], vote: str, none: str = "no_majority") -> DataFrame:
    """unit, votes and `majority`: the vote that has most, or `none` where two have."""
    counts = df.groupBy(*unit, vote).agg(F.count("*").alias("_n"))
    top = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(vote).alias("v"))))
    out = counts.groupBy(*unit).agg(F.sum("_n").alias("votes"), top.alias("_t"))
    tied = F.get("_t", F.lit(0))["n"] == F.get("_t", F.lit(1))["n"]
    return out.select(*unit, "votes", F.when(F.coalesce(tied, F.lit(False)), F.lit(none)).otherwise(F.get("_t", F.lit(0))["v"].cast("string")).alias("majority"))


def confusion(df: DataFrame, group: list[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by group; null where a denominator is zero."""
    c = lambda x, a: F.count_if(x).alias(a)
    n = df.groupBy(*group).agg(c(predicted & actual, "tp"), c(predicted & ~actual, "fp"), c(~predicted & actual, "fn"))
    return n.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def contrasts(wide: DataFrame, formulas: dict[str, dict[str, float]], family: list[str] | None = None, tests: bool = False, level: float = 0.95) -> DataFrame:
    """(family, contrast, n, mean_diff, sd, t, dz): weighted sums of arms over units that have them all; with a confidence interval and p values if asked.

    `wide` has a row for each unit and a column for each arm, so one scan serves every contrast. Below two units all but n
    is null; dz is null where the differences don't vary. Wilcoxon's ranks are summed from counts of different values.
    """
    family = family or []
    keys = [*family, "contrast"]
    parts = F.explode(F.array(*(F.struct(F.lit(name).alias("contrast"), sum((F.col(a).cast("double") * w for a, w in f.items()), F.lit(0.0)).alias("d")) for name, f in formulas.items()))).alias("c")
    rows = wide.select(*family, parts).select(*family, "c.*").where("abs(d) < double('infinity')")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    out = out.withColumn("mean_diff", F.when(F.col("n") > 1, F.col("mean_diff")))
    out = out.withColumn("dz", F.try_divide("mean_diff", "sd")).withColumn("t", F.col("dz") * F.sqrt("n"))
    if not tests:
        return out
    free = (F.col("n") - 1).cast("double")
    half = t_critical(F.lit(1 - (1 - level) / 2), F.when(F.col("n") > 1, free)) * F.col("sd") / F.sqrt("n")
    out = out.withColumn("_h", half).withColumns({"ci_low": F.col("mean_diff") - F.col("_h"), "ci_high": F.col("mean_diff") + F.col("_h")}).drop("_h")
    sizes = rows.where("d <> 0").groupBy(*keys, F.abs("d").alias("_a")).agg(F.count("*").alias("_c"), F.count_if(F.col("d") > 0).alias("_up"))
    ranked = ordered.running(sizes, keys, ["_a"], "_c", "_before").withColumn("_rank", F.col("_before") + (F.col("_c") + 1) / 2)
    c = F.col("_c").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(F.col("_rank") * F.col("_up")).alias("_plus"), F.sum(F.col("_rank") * (F.col("_c") - F.col("_up"))).alias("_minus"), F.sum(c * c * c - c).alias("_ties"))
    right = sums.select("_n", "_plus", "_minus", "_ties", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    joined = out.join(right, [out[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)], "left")
    exact = (F.col("_n") == F.col("n")) & (F.col("_ties") == 0)
    p = wilcoxon_p(F.when(F.col("n") > 1, F.col("_n")).cast("double"), F.least("_plus", "_minus").cast("double"), "_ties", exact.cast("double"))
    return joined.withColumn("p_t", t_p_value("t", free)).withColumn("p_wilcoxon", p).select(*out.columns, "p_t", "p_wilcoxon")


def discordance(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(contrast, n, diff_pp, only_a, only_b, p) of 0/1 arms: McNemar's exact test."""
    parts = F.explode(F.array(*(F.struct(F.lit(f"{a} - {b}").alias("contrast"), F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")) for a, b in pairs))).alias("c")
    rows = wide.select(parts).select("c.*").dropna()
    out = rows.groupBy("contrast").agg(F.count("*").alias("n"), (100 * (F.avg("a") - F.avg("b"))).alias("diff_pp"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"))
    return out.withColumn("p", mcnemar_p("only_a", "only_b"))


def holm(df: DataFrame, family: list[str], p: str, tie: list[str]) -> DataFrame:
    """df with `p_holm`: step-down correction inside each family; missing p stay missing and do not count."""
    known = F.col(p).isNotNull() & ~F.isnan(p)
    part = [*family, "_known"]
    order = Window.partitionBy(*part).orderBy(p, *tie)
    rows = df.withColumn("_known", known).withColumn("_m", F.count("*").over(Window.partitionBy(*part))).withColumn("_r", F.row_number().over(order))
    raw = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    rows = rows.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("p_holm", F.when(F.col("_known"), F.col("p_holm")).otherwise(F.col(p))).drop("_known", "_m", "_r", "_raw")


def rater_pairs(ratings: DataFrame, unit: list[str], rater: str, value: str) -> DataFrame:
    """(rater_a, rater_b, a, b) of every unit that both have rated."""
    one = ratings.select(*unit, F.col(rater).alias("rater_a"), F.col(value).alias("a"))
    two = ratings.select(*unit, F.col(rater).alias("rater_b"), F.col(value).alias("b"))
    return one.join(two, unit).where("rater_a < rater_b")


def cohen_kappa(pairs: DataFrame, categories: int, quadratic: bool, group: list[str] | None = None) -> DataFrame:
    """(group, n_units, kappa) from (a, b) in 1..categories: observed against expected disagreement, from the contingency table."""
    group = group if group is not None else ["rater_a", "rater_b"]
    cell = pairs.groupBy(*group, "a", "b").agg(F.count("*").alias("n"))
    w = lambda x, y: F.pow((x - y) / F.lit(float(categories - 1)), 2) if quadratic else (x != y).cast("double")
    total = cell.groupBy(*group).agg(F.sum("n").alias("n_units"), F.sum(F.col("n") * w(F.col("a"), F.col("b"))).alias("_seen"))
    rows = cell.groupBy(*group, F.col("a").alias("x")).agg(F.sum("n").alias("nx"))
    cols = cell.groupBy(*group, F.col("b").alias("y")).agg(F.sum("n").alias("ny"))
    expected = rows.join(cols, group).groupBy(*group).agg(F.sum(F.col("nx") * F.col("ny") * w(F.col("x"), F.col("y"))).alias("_chance"))
    joined = total.join(expected, group)
    return joined.select(*group, "n_units", (1 - F.try_divide(F.col("_seen") * F.col("n_units"), F.col("_chance"))).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, unit: list[str], value: str, group: list[str] | None = None) -> DataFrame:
    """(group, n_raters, n_units, kappa) over the units with the most raters; null where chance explains everything or too little is rated."""
    group = group or []
    votes = ratings.groupBy(*group, *unit, value).agg(F.count("*").alias("c"))
    per = votes.groupBy(*group, *unit).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    most = per.groupBy(*group).agg(F.max("n").alias("n_raters"))
    full = (per.join(most, group) if group else per.join(F.broadcast(most))).where("n = n_raters")
    agreed = full.groupBy(*group, "n_raters").agg(F.count("*").alias("n_units"), F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("_p"))
    share = votes.join(full.select(*group, *unit), [*group, *unit], "left_semi").groupBy(*group, value).agg(F.sum("c").alias("c"))
    chance = share.groupBy(*group).agg((F.sum(F.col("c").cast("double") * F.col("c")) / F.pow(F.sum("c"), F.lit(2))).alias("_e"))
    out = agreed.join(chance, group) if group else agreed.join(F.broadcast(chance))
    ok = (F.col("n_raters") >= 2) & (F.col("n_units") >= 2) & (F.col("_e") < 1)
    return out.select(*group, "n_raters", "n_units", F.when(ok, (F.col("_p") - F.col("_e")) / (1 - F.col("_e"))).alias("kappa"))


def equal_raters(ratings: DataFrame, unit: list[str], rater: str, raters: int) -> DataFrame:
    """Ratings of the units that exactly so many different raters have rated: what a table of equal row sums needs."""
    full = ratings.groupBy(*unit).agg(F.countDistinct(rater).alias("_r"), F.count("*").alias("_n")).where((F.col("_r") == raters) & (F.col("_n") == raters))
    return ratings.join(full.select(*unit), unit, "left_semi")


def agreement_table(ratings: DataFrame, unit: list[str], rater: str, model: str, measures: dict[str, tuple[int, bool]], total: str = "all") -> DataFrame:
    """(model, measure, raters, n_units, kappa) for all models together and each: Cohen's kappa of each pair of raters, Fleiss' of all.

    `measures` has the number of categories 1..k of each rated column, and whether its kappa is weighted quadratically.
    """
    both = ratings.withColumn("_unit", F.struct(*unit, model)).withColumn("_model", F.explode(F.array(F.lit(total), F.col(model).cast("string"))))
    out = None
    for name, (categories, quadratic) in measures.items():
        rated = both.where(F.col(name).isNotNull()).select("_model", "_unit", rater, F.col(name).alias("_v"))
        pairs = cohen_kappa(rater_pairs(rated, ["_model", "_unit"], rater, "_v"), categories, quadratic, ["_model", "rater_a", "rater_b"])
        pairs = pairs.select("_model", F.concat_ws("-", F.col("rater_a").cast("string"), F.col("rater_b").cast("string")).alias("raters"), "n_units", "kappa")
        every = fleiss_kappa(rated, ["_unit"], "_v", ["_model"]).select("_model", F.lit("fleiss").alias("raters"), "n_units", "kappa")
        part = pairs.unionByName(every).select(F.col("_model").alias("model"), F.lit(name).alias("measure"), "raters", "n_units", "kappa")
        out = part if out is None else out.unionByName(part)
    return out


def average_rank(cells: DataFrame, value: str, group: list[str], weight: str, out: str) -> DataFrame:
    """cells with ranks in which ties share their mean; a cell stands for `weight` rows."""
    counts = cells.groupBy(*group, value).agg(F.sum(weight).alias("_n"))
    ranks = ordered.running(counts, group, [value], "_n", "_before").select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col(value).alias("_ranked"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    on = [cells[c].eqNullSafe(ranks[f"_g{i}"]) for i, c in enumerate(group)] + [cells[value] == ranks["_ranked"]]
    return cells.join(ranks, on).select(*(cells[c] for c in cells.columns), out)


def weighted_corr(x: str, y: str, w: str) -> Column:
    """Pearson's correlation of cells of weight w, from sums about a middle near the mean."""
    s = lambda e: F.sum(e)
    a, b, c = F.col(x), F.col(y), F.col(w)
    n, sx, sy = s(c), s(c * a), s(c * b)
    top = s(c * a * b) - sx * sy / n
    return F.try_divide(top, F.sqrt(F.greatest(s(c * a * a) - sx * sx / n, F.lit(0.0))) * F.sqrt(F.greatest(s(c * b * b) - sy * sy / n, F.lit(0.0))))


def correlations(df: DataFrame, x: str, y: str, group: list[str], tests: bool = False) -> DataFrame:
    """(group, n, pearson, spearman): Spearman's as Pearson's on average ranks; with p values by Student's t if asked.

    Rows are counted by (group, x, y) once; both ranks are those of cells, and a cell weighs as many rows as it stands for.
    """
    plain = df.select(*group, x, y).dropna(subset=[x, y])
    cells = plain.groupBy(*group, F.col(x).cast("double").alias("_x0"), F.col(y).cast("double").alias("_y0")).agg(F.count("*").alias("_w"))
    cells = cells.withColumn("_w", F.col("_w").cast("double"))
    ranked = average_rank(average_rank(cells, "_x0", group, "_w", "_rx"), "_y0", group, "_w", "_ry")
    means = cells.groupBy(*group).agg((F.sum(F.col("_w") * F.col("_x0")) / F.sum("_w")).alias("_mx"), (F.sum(F.col("_w") * F.col("_y0")) / F.sum("_w")).alias("_my")).select(*(F.col(c).alias(f"_m{i}") for i, c in enumerate(group)), "_mx", "_my")
    about = ranked.join(means, [ranked[c].eqNullSafe(means[f"_m{i}"]) for i, c in enumerate(group)] or F.lit(True))
    about = about.withColumn("_dx", F.col("_x0") - F.col("_mx")).withColumn("_dy", F.col("_y0") - F.col("_my"))
    out = about.groupBy(*group).agg(F.sum("_w").cast("long").alias("n"), weighted_corr("_dx", "_dy", "_w").alias("pearson"), weighted_corr("_rx", "_ry", "_w").alias("spearman"))
    ok = F.col("n") >= 3
    out = out.select(*group, "n", *(F.when(ok & ~F.isnan(c), F.col(c)).alias(c) for c in ("pearson", "spearman")))
    if not tests:
        return out
    t = lambda r: F.when(F.abs(r) < 1, F.col(r) * F.sqrt((F.col("n") - 2) / (1 - F.col(r) * F.col(r)))).when(F.col(r).isNotNull(), F.lit(float("inf")))
    return out.withColumns({f"p_{r}": t_p_value(t(r), (F.col("n") - 2).cast("double")) for r in ("pearson", "spearman")})


def drawn_clusters(clusters: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, _number, times): how often each of n numbered clusters (0 .. n - 1) is among n draws with replacement, by repetition; a draw is a hash of seed, repetition and its place, modulo n."""
    spark, n = clusters.sparkSession, clusters.count()
    draws = spark.range(reps * n).select((F.expr(f"id div {max(1, n)}") + 1).alias("rep"), (F.col("id") % max(1, n)).alias("draw"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("draw").cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % max(1, n)
    return draws.groupBy("rep", number.alias("_number")).agg(F.count("*").cast("double").alias("times"))


def bootstrap_interval(df: DataFrame, cluster: str, x: str, y: str, reps: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(repetitions, pearson_low, pearson_high, spearman_low, spearman_high): percentile intervals over resampled clusters, which keep their rows together.

    Each repetition draws as many clusters as there are, with replacement. Spearman's correlation is that of average ranks
    inside the repetition, a row counting as often as its cluster was drawn. Rows without x or y are left out, and so are
    repetitions of fewer than three rows or of one value of x or y; with fewer than three clusters all is null. Repetitions
    are resampled by Spark: a task holds cells of some repetitions, never a sample.
    """
    plain = df.select(F.col(cluster).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    clusters = written(ordered.numbered(plain.select("_k").distinct(), [], ["_k"], "_n").select("_k", (F.col("_n") - 1).alias("_number")), "clusters")
    valid = plain.where("_x IS NOT NULL AND NOT isnan(_x) AND _y IS NOT NULL AND NOT isnan(_y)")
    counted = valid.groupBy("_k", "_x", "_y").agg(F.count("*").alias("_c"))
    cells = written(counted.join(clusters, counted["_k"].eqNullSafe(clusters["_k"])).select("_number", "_x", "_y", "_c"), "cells")
    about = cells.agg(F.avg("_x").alias("x"), F.avg("_y").alias("y")).first()
    enough = clusters.count() >= 3
    drawn = drawn_clusters(clusters, reps if enough else 0, seed)
    rows = drawn.join(cells, "_number").groupBy("rep", "_x", "_y").agg(F.sum(F.col("times") * F.col("_c")).alias("_w"))
    ranked = average_rank(average_rank(written(rows, "drawn"), "_x", ["rep"], "_w", "_rx"), "_y", ["rep"], "_w", "_ry")
    near = ranked.withColumn("_dx", F.col("_x") - (about["x"] or 0.0)).withColumn("_dy", F.col("_y") - (about["y"] or 0.0))
    varied = (F.sum("_w") >= 3) & (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    each = near.groupBy("rep").agg(varied.alias("_ok"), weighted_corr("_dx", "_dy", "_w").alias("pearson"), weighted_corr("_rx", "_ry", "_w").alias("spearman")).where("_ok")
    ends = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    out = each.agg(F.count("*").alias("repetitions"), F.percentile("pearson", ends).alias("p"), F.percentile("spearman", ends).alias("s"))
    return out.select("repetitions", *(F.get(c, F.lit(i)).alias(f"{name}_{end}") for c, name in (("p", "pearson"), ("s", "spearman")) for i, end in enumerate(("low", "high"))))


@F.arrow_udf(IntegerType())
def common_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """The length of the longest common subsequence of two arrays, in bit vectors: a word of b is an addition and three logical operations on as many bits as a has words."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        masks: dict[str, int] = {}
        for i, w in enumerate(x):
            masks[w] = masks.get(w, 0) | 1 << i
        every = (1 << len(x)) - 1
        free = every  # a zero bit for each place of x at which the best length rises
        for w in y:
            hit = free & masks.get(w, 0)
            free = ((free + hit) | (free - hit)) & every
        out.append(len(x) - free.bit_count())
    return pa.array(out, pa.int32())


def rouge_l(candidate: str, reference: str, tokens: str = "[^a-z0-9]+") -> tuple[dict[str, Column], Column]:
    """(token columns to add, F-measure of their longest common subsequence): null where a text is null or empty, 0 where one has no tokens or nothing is common."""
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), tokens), lambda w: w != "")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n, m = F.size("_a"), F.size("_b")
    found = F.when((n > 0) & (m > 0), 2 * common_length("_a", "_b") / (n + m)).otherwise(F.lit(0.0))
    return {"_a": words(candidate), "_b": words(reference)}, F.when(~empty(candidate) & ~empty(reference), found)
