"""Regression, classification and ranking metrics, and their aggregation over folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.frame import running_sums
from tessera.plans.storage import materialize


def regression_aggregates(y: str, p: str) -> list[Column]:
    """n, mse, mae, rmse and r2 in one pass: the sum of squares about the mean comes from the variance."""
    e = F.col(y) - F.col(p)
    n, sse = F.count(e), F.sum(e * e)
    sst = F.var_pop(F.col(y)) * F.count(F.col(y))
    return [n.alias("n"), (sse / n).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(sse / n).alias("rmse"), F.when(sst > 0, 1 - sse / sst).alias("r2")]


def regression(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """n, mse, mae, rmse, r2 and rae (the sum of absolute errors over that about the mean), over all rows or by group.

    The means come first, one row a group, and are joined to the rows for rae.
    """
    by = by or []
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    means = rows.groupBy(*by).agg(F.avg(y).alias("_mean"), *regression_aggregates(y, p))
    names = [f"_g{k}" for k in range(len(by))]
    own = means.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], "_mean")
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    about = rows.join(F.broadcast(own) if not by else own, same).groupBy(*by) if by else rows.join(F.broadcast(own)).groupBy()
    spread = about.agg(F.sum(F.abs(F.col(y) - F.col("_mean"))).alias("_about"))
    out = means.join(spread.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], "_about"), same) if by else means.join(F.broadcast(spread))
    return out.withColumn("rae", F.when(F.col("_about") > 0, F.col("mae") * F.col("n") / F.col("_about"))).select(*by, "n", "mse", "mae", "rmse", "r2", "rae")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ranks from 1 in which ties share their mean rank.

    Counts by distinct value are put in order by ranges, and the rows are joined back by value.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = running_sums(counts, ["_v"], {"_u": "_c"}).select("_v", (F.col("_u") - (F.col("_c") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Over counts of distinct points, with the ranks of both columns from one ordering."""
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("c"))
    points = materialize(points, "points")
    sides = points.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("v"), "c"), F.struct(F.lit(1).alias("side"), F.col("y").alias("v"), "c"))).alias("s")).select("s.*")
    counts = sides.groupBy("side", "v").agg(F.sum("c").alias("c"))
    # both sides have all rows, so the second side's sums begin at their number
    ranked = running_sums(counts, ["side", "v"], {"u": "c"})
    n = points.agg(F.sum("c").alias("n"))
    ranked = ranked.join(F.broadcast(n)).select("side", "v", (F.col("u") - F.col("side") * F.col("n") - (F.col("c") - 1) / 2.0).alias("r"))
    rx, ry = (ranked.where(F.col("side") == k).select(F.col("v").alias(f"v{k}"), F.col("r").alias(f"r{k}")) for k in (0, 1))
    both = points.join(rx, F.col("x") == F.col("v0")).join(ry, F.col("y") == F.col("v1")).join(F.broadcast(n))
    a, b, c = F.col("r0") - (F.col("n") + 1) / 2.0, F.col("r1") - (F.col("n") + 1) / 2.0, F.col("c")
    out = both.agg(F.sum(c * a * b).alias("ab"), F.sum(c * a * a).alias("aa"), F.sum(c * b * b).alias("bb"), F.sum("c").alias("n"))
    return out.select(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman"), F.coalesce("n", F.lit(0)).alias("n"))


def _agreement(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The sum over pairs of sign(dx) sign(dy) times both weights, by divide and conquer over x."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order].astype(float)

    def within(s: int, t: int) -> float:
        if t - s <= 64:
            dx, dy = np.sign(x[s:t, None] - x[None, s:t]), np.sign(y[s:t, None] - y[None, s:t])
            return float((dx * dy * w[s:t, None] * w[None, s:t]).sum() / 2)
        cut = int(np.searchsorted(x[s:t], x[(s + t) // 2])) + s  # equal x stay together
        if cut == s:
            cut = int(np.searchsorted(x[s:t], x[(s + t) // 2], side="right")) + s
        if cut == t:
            return 0.0  # one value of x
        at = np.argsort(y[s:cut], kind="stable")
        low, total = y[s:cut][at], np.concatenate([[0.0], np.cumsum(w[s:cut][at])])
        below, upto = total[np.searchsorted(low, y[cut:t])], total[np.searchsorted(low, y[cut:t], side="right")]
        return float((w[cut:t] * (below - (total[-1] - upto))).sum()) + within(s, cut) + within(cut, t)

    return within(0, len(x))


def kendall(df: DataFrame, x: str, y: str, rows: int = 100_000) -> DataFrame:
    """Tau-b, exactly, over counts of distinct points, without comparing all pairs.

    Points are cut into ranges of x and ranges of y of about `rows` points. Pairs of
    different ranges in both are known from the counts by cell; pairs that share a range
    are counted within it by merging.
    """
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("c"))
    points = materialize(points, "points")
    parts = min(512, max(1, points.count() // rows + 1))
    cuts = points.stat.approxQuantile(["x", "y"], [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else [[], []]
    cuts = [sorted(set(c)) for c in cuts]
    side = lambda c, at: F.size(F.filter(F.array(*[F.lit(float(v)) for v in at]), lambda v: v < F.col(c))) if at else F.lit(0)
    placed = points.withColumns({"i": side("x", cuts[0]), "j": side("y", cuts[1])})
    cells = np.zeros((len(cuts[0]) + 1, len(cuts[1]) + 1))
    for r in placed.groupBy("i", "j").agg(F.sum("c").alias("c")).collect():  # parts squared rows at most
        cells[r.i, r.j] = r.c
    upto = np.pad(cells.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    left_below = upto[:-1, :-1]
    left_above = upto[:-1, -1:] - upto[:-1, 1:]
    across = float((cells * (left_below - left_above)).sum())

    def group(table: pa.Table) -> pa.Table:
        a, b, c = (table.column(k).to_numpy() for k in ("x", "y", "c"))
        return pa.table({"s": pa.array([_agreement(a, b, c)])})

    within = [placed.select(*keys, "x", "y", "c").groupBy(*keys).applyInArrow(group, "s double").select(F.lit(sign).alias("sign"), "s") for keys, sign in ((["i"], 1.0), (["j"], 1.0), (["i", "j"], -1.0))]
    s = within[0].unionByName(within[1]).unionByName(within[2]).agg((F.coalesce(F.sum(F.col("sign") * F.col("s")), F.lit(0.0)) + across).alias("s"))
    pairs = lambda c: c.cast("double") * (c - 1) / 2.0
    n = points.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    tx = points.groupBy("x").agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("tx"))
    ty = points.groupBy("y").agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("ty"))
    one = n.crossJoin(tx).crossJoin(ty).crossJoin(s)  # four single rows
    whole = pairs(F.col("n"))
    return one.select(F.try_divide(F.col("s"), F.sqrt((whole - F.col("tx")) * (whole - F.col("ty")))).alias("kendall"), F.col("n"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of (truth, predicted), and their share of the truth's row."""
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row for each label of truth or prediction: actual, said, hit, precision, recall and f1; rates without a base are 0."""
    cells = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    zero = F.lit(0).cast("long")
    actual = F.struct(F.col("t").alias("label"), F.col("c").alias("actual"), zero.alias("said"), F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(zero).alias("hit"))
    said = F.struct(F.col("p").alias("label"), zero.alias("actual"), F.col("c").alias("said"), zero.alias("hit"))
    by = cells.select(F.explode(F.array(actual, said)).alias("s")).select("s.*").groupBy("label").agg(F.sum("actual").alias("actual"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    by = by.withColumns({"precision": over("hit", "said"), "recall": over("hit", "actual")})
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return by.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, f1).otherwise(0.0))


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, balanced accuracy and macro precision, recall and f1, each over all labels of truth or prediction."""
    return per_class(df, truth, predicted).agg(
        F.sum("actual").alias("n"), (F.sum("hit") / F.sum("actual")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
    )


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(at, up, down, up_above, down_above): positives and others by distinct score, and how many have that score or a higher one."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select((F.col(label) == 1).alias("hit"), F.col(score).cast("double").alias("at"))
    by = rows.groupBy("at").agg(F.count_if("hit").alias("up"), F.count_if(~F.col("hit")).alias("down"))
    return running_sums(by, [F.desc("at")], {"up_above": "up", "down_above": "down"})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area by average ranks: counts by distinct score are put in order by ranges."""
    by = score_counts(df, label, score)
    parts = by.select("up", "down", (F.col("down") * (F.col("up_above") - F.col("up") / 2.0)).alias("u"))
    return parts.agg(F.try_divide(F.sum("u"), F.sum("up") * F.sum("down")).alias("roc_auc"), F.coalesce(F.sum("up"), F.lit(0)).alias("positives"), F.coalesce(F.sum("down"), F.lit(0)).alias("negatives"))


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row for each distinct score as threshold: tpr, fpr, precision and recall. Rates without a base are null."""
    by = materialize(score_counts(df, label, score), "curve")
    every = by.agg(F.sum("up").alias("_p"), F.sum("down").alias("_n"))
    tpr = F.try_divide(F.col("up_above"), F.col("_p").cast("double"))
    out = by.join(F.broadcast(every))
    return out.select(F.col("at").alias("score"), tpr.alias("tpr"), F.try_divide(F.col("down_above"), F.col("_n").cast("double")).alias("fpr"), (F.col("up_above") / (F.col("up_above") + F.col("down_above"))).alias("precision"), tpr.alias("recall"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Equal bins of scores in 0 to 1 (1 itself in the last): rows, mean score and share of positives."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg((F.col(label) == 1).cast("double")).alias("share"))


def by_status(df: DataFrame, status: str, y: str, p: str) -> DataFrame:
    """Metrics by status and over all (status null), by grouping sets, with each one's share of rows."""
    view = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    out = view.rollup(status).agg(F.grouping(status).alias("_all"), *regression_aggregates(y, p))
    whole = F.max(F.when(F.col("_all") == 1, F.col("n"))).over(Window.partitionBy())
    return out.withColumn("coverage", F.col("n") / whole).select(F.when(F.col("_all") == 1, "all").otherwise(F.col(status)).alias("status"), "n", "rmse", "mae", "coverage")


def cross_validation(df: DataFrame, fold: str, y: str, p: str) -> DataFrame:
    """Mean, population deviation, least and greatest of the folds' metrics, one row a metric."""
    folds = regression(df, y, p, [fold])
    long = folds.unpivot([fold], ["rmse", "mae", "r2"], "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("folds"))
