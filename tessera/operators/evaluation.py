"""Evaluation of models and runs: split families, protocol gates, curves of runs, failures, durations and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import rating
from tessera.operators.frame import quantiles

#: Gates of a protocol (fixed values): the least r2 or balanced accuracy of the hardest split, the least change against random splits, the greatest rise of the rmse, and the greatest deviation among random splits.
HARDEST, DELTA, DELTA_RMSE, STABLE = 0.70, -0.10, 0.15, 0.03


def split_families(df: DataFrame, family: str, metric: str, value: str) -> DataFrame:
    """Mean, population deviation (0 for one) and number of runs by family and metric of long rows; null values are left out."""
    rows = df.where(F.col(value).isNotNull() & F.col(family).isNotNull())
    return rows.groupBy(family, metric).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.count("*").alias("n_runs"))


def protocol(families: DataFrame, family: str = "family", metric: str = "metric", protocol_named: bool = True) -> DataFrame:
    """One row: the hardest family, its means, the gates and the recommended status, from split_families() with a 'random' family.

    Balanced accuracy and roc_auc take the part of r2 and rmse if the random family has
    them. Without a random family or its first metric there is no row. Families are few: the frame is small.
    """
    wide = families.groupBy(family).pivot(metric, ["r2", "rmse", "balanced_accuracy", "roc_auc"]).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    runs = families.groupBy(F.col(family).alias("_f")).agg(F.max("n_runs").alias("n_runs"))
    wide = wide.join(runs, F.col(family) == F.col("_f")).drop("_f")
    random = wide.where(F.col(family) == "random").select(
        F.col("balanced_accuracy_mean").isNotNull().alias("classes"), F.coalesce("balanced_accuracy_mean", "r2_mean").alias("r1"),
        F.when(F.col("balanced_accuracy_mean").isNotNull(), F.col("roc_auc_mean")).otherwise(F.col("rmse_mean")).alias("r2nd"),
        F.when(F.col("balanced_accuracy_mean").isNotNull(), F.col("balanced_accuracy_std")).otherwise(F.col("r2_std")).alias("rs"), F.col("n_runs").alias("rn"),
    ).where("r1 is not null")
    others = wide.where(F.col(family) != "random").crossJoin(F.broadcast(random))
    first = F.when(F.col("classes"), F.col("balanced_accuracy_mean")).otherwise(F.col("r2_mean"))
    second = F.when(F.col("classes"), F.col("roc_auc_mean")).otherwise(F.col("rmse_mean"))
    others = others.withColumns({"p": first, "d1": first - F.col("r1"), "d2": second - F.col("r2nd")})
    worse = F.coalesce(F.col("d1") < DELTA, F.lit(False)) | (~F.col("classes") & F.coalesce(F.col("d2") > DELTA_RMSE, F.lit(False)))
    got = others.agg(F.min_by(family, F.when(F.col("p").isNotNull(), F.struct("p", family))).alias("hardest_split"), F.min("p").alias("hardest"), F.coalesce(F.max(worse), F.lit(False)).alias("warned"), F.min("d1").alias("worst_delta"))
    out = random.crossJoin(got)
    passes = F.coalesce(F.col("hardest") >= HARDEST, F.lit(False))
    stable = (F.col("rn") <= 1) | F.coalesce(F.col("rs") <= STABLE, F.lit(True))
    status = (
        F.when(~passes | F.col("warned"), "workflow_demo").when(F.col("rn") > 1, F.when(stable, "robust_validated").otherwise("workflow_demo"))
        .otherwise("validated" if protocol_named else "experimental")
    )
    return out.select("hardest_split", "hardest", "worst_delta", passes.alias("passes_hardest"), (~F.col("warned")).alias("passes_robustness"), stable.alias("passes_stability"), status.alias("recommended_status"))


def delta_against(df: DataFrame, variant: str, split: str, value: str, baseline: str, splits: list[str]) -> DataFrame:
    """One row a variant: its value by split and the change against the baseline variant, as columns."""
    wide = df.groupBy(variant).pivot(split, splits).agg(F.first(value))
    base = wide.where(F.col(variant) == baseline).select(*[F.col(s).alias(f"_b_{s}") for s in splits])
    return wide.join(F.broadcast(base)).select(variant, *splits, *[(F.col(s) - F.col(f"_b_{s}")).alias(f"delta_{s}") for s in splits])


def component_metrics(df: DataFrame, y: str, components: list[str]) -> DataFrame:
    """One row a component: n, r2, rmse, mae and mse of its predictions, in one pass over unpivoted rows."""
    long = df.select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in components]).unpivot(["_y"], components, "component", "_p")
    e = F.col("_p") - F.col("_y")
    rows = long.where("_y is not null and _p is not null")
    spread = F.var_pop("_y") * F.count("_y")
    return rows.groupBy("component").agg(F.count("*").alias("n"), F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def status_summary(df: DataFrame, status: str) -> DataFrame:
    """One row: rows, those in and out of domain and invalid, and the share in domain."""
    n = lambda s: F.count_if(F.col(status) == s)
    return df.agg(F.count("*").alias("n_rows"), n("in_domain").alias("n_in_domain"), n("out_of_domain").alias("n_out_of_domain"), n("invalid_features").alias("n_invalid_features"), F.try_divide(n("in_domain"), F.count("*")).alias("coverage"))


def violating_features(df: DataFrame, column: str, limit: int = 20, separator: str = ";") -> DataFrame:
    """The features that violate most often, from lists as text; ties by name."""
    each = df.select(F.explode(F.split(F.coalesce(column, F.lit("")), separator)).alias("feature")).where("feature <> ''")
    return each.groupBy("feature").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("feature")).limit(limit)


def cross_validated(df: DataFrame, molecule: str, repeat: str, y: str, p: str) -> DataFrame:
    """One row a molecule: its truth, its mean prediction over repeats and their deviation, and whether the error reaches twice the mean rmse of the repeats."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    rmse = rows.groupBy(repeat).agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("_rmse")).agg(F.avg("_rmse").alias("rmse"))
    by = rows.groupBy(molecule).agg(F.avg(y).alias("y"), F.avg(p).alias("p"), F.stddev_pop(p).alias("std"), F.count("*").alias("n"))
    return by.join(F.broadcast(rmse)).select(molecule, "y", "p", "std", "n", (F.abs(F.col("y") - F.col("p")) >= 2 * F.col("rmse")).alias("outlier"))


def score_distribution(df: DataFrame, score: str, ok: str) -> DataFrame:
    """One row over successful rows with a score: mean, upper median, population std, least, greatest, rating, and five half-open bins (the greatest value is in none).

    The upper median is the value at rank n div 2, found by running counts.
    """
    rows = df.where(F.col(ok) & F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"))
    moments = rows.agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n")).where("n > 0")
    from tessera.operators.frame import running_sums

    counts = rows.groupBy("s").agg(F.count("*").alias("c"))
    at = running_sums(counts, ["s"], {"u": "c"}).join(F.broadcast(moments.select(F.floor(F.col("n") / 2).alias("k"))))
    median = at.agg(F.min(F.when(F.col("u") > F.col("k"), F.col("s"))).alias("median"))
    size = (F.col("high") - F.col("low")) / 5
    bins = rows.join(F.broadcast(moments)).agg(*[F.count_if((F.col("s") >= F.col("low") + k * size) & (F.col("s") < F.col("low") + (k + 1) * size)).alias(f"bin{k}") for k in range(5)])
    return moments.join(F.broadcast(median)).join(F.broadcast(bins)).withColumn("rating", rating(F.col("mean")))


def failing(df: DataFrame, ok: str, score: str, threshold: float = 0.70) -> DataFrame:
    """Rows that did not succeed (null is no success) or scored below the threshold."""
    return df.where(~F.coalesce(F.col(ok), F.lit(False)) | F.coalesce(F.col(score) < threshold, F.lit(False)))


def failure_category(ok: Column, score: Column, error: Column, threshold: float = 0.70) -> Column:
    """timeout, validation_error, tool_error, low_score or other; null for a success that scores well. A missing score is 1."""
    e = F.lower(F.coalesce(error, F.lit("")))
    has = lambda *words: F.greatest(*[e.contains(w) for w in words])
    kind = F.when(has("timeout", "timed out"), "timeout").when(has("validation", "invalid"), "validation_error").when(has("tool", "function"), "tool_error").otherwise("other")
    return F.when(F.coalesce(ok, F.lit(False)), F.when(F.coalesce(score, F.lit(1.0)) < threshold, "low_score")).otherwise(kind)


def dataset_stats(df: DataFrame, dataset: str, rows: str, ok: str, score: str) -> DataFrame:
    """By dataset: mean rows, successes, mean score and success rate over its own results."""
    return df.groupBy(dataset).agg(F.avg(rows).alias("row_count"), F.count_if(F.col(ok)).alias("success"), F.avg(score).alias("robustness_score"), F.avg(F.coalesce(F.col(ok), F.lit(False)).cast("double")).alias("success_rate"))


def component_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each component score."""
    return df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def trend(change: Column, step: float = 0.05) -> Column:
    return F.when(change > step, "Improvement").when(change < -step, "Regression").otherwise("Stable")


def compare_runs(df: DataFrame, at: str, score: str, passed: str, total: str) -> DataFrame:
    """One row over runs: averages, least and greatest of success rate and score, and the trend from the oldest run to the newest."""
    rate = F.coalesce(F.try_divide(F.col(passed), F.col(total)), F.lit(0.0))
    stats = [f(x).alias(f"{n}_{k}") for k, x in (("success_rate", rate), ("mean_score", F.col(score))) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    change = F.max_by(score, at) - F.min_by(score, at)
    return df.agg(F.count("*").alias("n_runs"), *stats, change.alias("change"), F.when(F.count("*") < 2, "Unknown").otherwise(trend(change)).alias("trend"))


def steps_over_time(df: DataFrame, test: str, at: str, score: str, step: float = 0.05) -> DataFrame:
    """Changes of each test from one run to the next beyond step, in either direction."""
    w = Window.partitionBy(test).orderBy(at)
    rows = df.select(test, F.lag(at).over(w).alias("from"), F.col(at).alias("to"), (F.col(score) - F.lag(score).over(w)).alias("change"))
    return rows.where(F.abs("change") > step).withColumn("kind", F.when(F.col("change") > 0, "improvement").otherwise("regression"))


def comparison_table(first: DataFrame, second: DataFrame, metrics: list[str]) -> DataFrame:
    """Two one-row frames side by side: metric, first, second and their difference; a metric that one lacks is null there."""
    long = lambda d, n: d.select(*[(F.col(m).cast("double") if m in d.columns else F.lit(None).cast("double")).alias(m) for m in metrics]).unpivot([], metrics, "metric", n)
    return long(first, "run_1").join(F.broadcast(long(second, "run_2")), "metric", "full").withColumn("difference", F.col("run_2") - F.col("run_1"))


#: Components of the robustness score and their parts (fixed values).
COMPONENTS = {
    "data_similarity": ("row_jaccard", "column_match", "value_similarity"), "semantic_similarity": ("semantic_similarity", "entity_overlap", "numeric_consistency"),
    "process_consistency": ("completion_rate", "tool_sequence_similarity"), "visual_similarity": ("perceptual_hash", "ssim"),
}


def robustness(df: DataFrame, weights: dict[str, float], groups: dict[str, tuple[str, ...]] = COMPONENTS) -> Column:
    """The weighted mean of component scores, each the mean of its parts that df has (missing values 0); weights are scaled to one, and a component without parts counts 0."""
    total = sum(weights.values())
    score = F.lit(0.0)
    for name, weight in weights.items():
        parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in groups.get(name, (name,)) if c in df.columns]
        if parts:
            score = score + F.lit(weight / total) * sum(parts[1:], parts[0]) / len(parts)
    return score


def durations(df: DataFrame, started: str, ended: str, by: list[str] | None = None) -> DataFrame:
    """Seconds from the first start to the last end, and the sum, mean and greatest of the runs', by group."""
    seconds = F.col(ended).cast("timestamp").cast("double") - F.col(started).cast("timestamp").cast("double")
    whole = F.max(F.col(ended).cast("timestamp").cast("double")) - F.min(F.col(started).cast("timestamp").cast("double"))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(whole, 3).alias("total_seconds"), F.round(F.sum(seconds), 3).alias("sum_seconds"), F.round(F.avg(seconds), 3).alias("mean_seconds"), F.round(F.max(seconds), 3).alias("longest_seconds"))


def same_parameters(df: DataFrame, parameters: str, origin: list[str]) -> DataFrame:
    """Equal parameter sets (a map or struct) once, with where they came from: how many, and the origins as JSON in order."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(parameters)))))
    rows = df.select(text.alias("parameters"), F.struct(*origin).alias("o"))
    return rows.groupBy("parameters").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_set("o"))).alias("origins"))


def summary_rows(df: DataFrame, candidate: str, split: str, metrics: list[str], splits: list[str], seconds: str) -> DataFrame:
    """One row a candidate: each metric's mean by split as columns, the change from the first split to the others, the runs' deviation on the first split and the training time."""
    by = df.groupBy(candidate).agg(
        *[F.avg(F.when(F.col(split) == s, F.col(m))).alias(f"{s}_{m}") for s in splits for m in metrics],
        *[F.stddev_pop(F.when(F.col(split) == splits[0], F.col(m))).alias(f"{splits[0]}_{m}_std") for m in metrics], F.sum(seconds).alias("train_time_s"), F.count("*").alias("n_runs"),
    )
    return by.withColumns({f"delta_{s}_{m}": F.col(f"{s}_{m}") - F.col(f"{splits[0]}_{m}") for s in splits[1:] for m in metrics})


def metric_rows(df: DataFrame, source: str, target: str, metrics: list[str]) -> DataFrame:
    """Report rows (source, target, subset, metric, value): metrics by status unpivoted."""
    return df.unpivot([source, target, "status"], metrics, "metric", "value").withColumnRenamed("status", "subset").where("value is not null")


def outliers_by_metric(df: DataFrame, key: str, metrics: list[str], threshold: float = 2.0, method: str = "zscore") -> DataFrame:
    """(key, metric, value) of the outliers of each metric: by z-score, or by the interquartile range; metrics of under four values have none."""
    long = df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "metric", "value").where("value is not null")
    if method == "zscore":
        m = long.groupBy("metric").agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("s"), F.count("*").alias("k")).where("s > 0 and k >= 4")
        return long.join(F.broadcast(m), "metric").where(F.abs((F.col("value") - F.col("a")) / F.col("s")) > threshold).select(key, "metric", "value")
    q = quantiles(long, "value", {"a": 0.25, "b": 0.75}, ["metric"]).where("n >= 4")
    low, high = F.col("a") - threshold * (F.col("b") - F.col("a")), F.col("b") + threshold * (F.col("b") - F.col("a"))
    return long.join(F.broadcast(q), "metric").where((F.col("value") < low) | (F.col("value") > high)).select(key, "metric", "value")


def best_so_far(df: DataFrame, study: str, order: str, value: str, direction: str = "maximize") -> DataFrame:
    """The best value up to each trial of a study; nulls and NaN keep what there was. A study's trials are a window of its own."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    w = Window.partitionBy(study).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", (F.max(v) if direction == "maximize" else F.min(v)).over(w))


def insights(mean: float, std: float, parts: dict[str, float], change: float | None = None) -> list[str]:
    """What a report says of a run: plain sentences by the bands of its scores."""
    out = []
    if mean < 0.70:
        out.append(f"critical: mean score {mean:.3f} is below 0.70")
        out += [f"{k} is low ({v:.3f})" for k, v in sorted(parts.items()) if v < 0.70]
    elif mean >= 0.80:
        out.append(f"good: mean score {mean:.3f}")
    if std > 0.15:
        out.append(f"scores vary much (std {std:.3f})")
    if change is not None and change < -0.05:
        out.append(f"regression of {-change:.3f} since the run before")
    return out or ["no critical issue"]


def running(df: DataFrame, by: str, order: str, value: str, step: float = 0.05) -> DataFrame:
    """df with the best and the mean of a value so far, its change and the change's direction, within each group in order."""
    w = Window.partitionBy(by).orderBy(order)
    upto, change = w.rowsBetween(Window.unboundedPreceding, 0), F.col(value) - F.lag(value).over(w)
    out = df.withColumns({"best": F.max(value).over(upto), "running_mean": F.avg(value).over(upto), "change": change})
    return out.withColumn("trend", F.when(F.col("change") > step, "up").when(F.col("change") < -step, "down").otherwise("flat"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Rows and mean by bins of equal width, numbered from zero."""
    return df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def pivoted(df: DataFrame, by: str, column: str, values: list, aggregate: Column) -> DataFrame:
    """One row a group with an aggregate for each of the known values of a column."""
    return df.groupBy(by).pivot(column, values).agg(aggregate)


def two_runs(df: DataFrame, run: str, first, second, by: str, value: str) -> DataFrame:
    """The mean of a value by group in two runs, and their difference; groups of one run alone have nulls."""
    one = lambda r, name: df.where(F.col(run) == r).groupBy(by).agg(F.avg(value).alias(name))
    return one(first, "first_run").join(one(second, "second_run"), by, "full").withColumn("difference", F.col("second_run") - F.col("first_run"))


def summary(df: DataFrame, value: str, by: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Quantiles by group with the rating of the mean over the greatest value."""
    q = quantiles(df, value, probabilities, by)
    names = [f"_g{k}" for k in range(len(by))]
    score = df.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg((F.avg(value) / F.max(value)).alias("_score"))
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return q.join(score, same).withColumn("rating", rating(F.col("_score"))).drop("_score", *names)


def recommendations(df: DataFrame, by: str, candidate: str, score: str) -> DataFrame:
    """The best and the worst candidate of each group by a score, ties to the least."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min_by(candidate, F.struct(-F.col(score), F.col(candidate))).alias("best"), F.min_by(candidate, F.struct(F.col(score), F.col(candidate))).alias("worst"))


def four_recommendations(df: DataFrame, candidate: str, hardest: str, delta: str, random: str, deviation: str, seconds: str, tie: str | None = None) -> DataFrame:
    """One row: the best candidate overall (by hardest split, tie-breaker, change and random split, then time; missing is worst), on the hardest split, by stability and by time."""
    bad, worst = F.lit(float("inf")), lambda c: -F.coalesce(F.col(c), F.lit(float("-inf")))
    overall = F.struct(worst(hardest).alias("a"), (worst(tie) if tie else F.lit(0.0)).alias("b"), worst(delta).alias("c"), worst(random).alias("d"), F.coalesce(F.col(seconds), bad).alias("e"), F.col(candidate).alias("f"))
    return df.agg(
        F.min_by(candidate, overall).alias("best_overall"), F.min_by(candidate, F.struct(worst(hardest), F.col(candidate))).alias("best_hardest_split"),
        F.min_by(candidate, F.when(F.col(deviation).isNotNull(), F.struct(F.col(deviation), F.col(candidate)))).alias("best_stability"), F.min_by(candidate, F.struct(F.coalesce(F.col(seconds), bad), F.col(candidate))).alias("best_fast"),
    )
