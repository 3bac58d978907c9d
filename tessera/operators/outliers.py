"""Selection of outlying predictions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.frame import stable_first, with_row_id
from tessera.plans.storage import materialize


def with_fold_rmse(df: DataFrame, fold: str, y: str, p: str) -> DataFrame:
    """Adds the fold's root mean squared error and the absolute percentage error (infinite for a true zero)."""
    folds = df.groupBy(fold).agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("fold_rmse"))
    ape = F.when(F.col(y) == 0, float("inf")).otherwise(100 * F.abs((F.col(y) - F.col(p)) / F.col(y)))
    return df.join(folds, fold).withColumn("abs_error", F.abs(F.col(y) - F.col(p))).withColumn("ape", ape)


def select_regression(df: DataFrame, fold: str, y: str, p: str, order: list[str], fraction: float = 0.25, factor: float = 2.0, flags: list[str] | None = None) -> DataFrame:
    """All rows with both values, with fold_rmse, abs_error, ape, eligible, ape_rank and selected.

    A row is eligible if its error exceeds factor times its fold's rmse and any of the
    flags (a cliff, out of domain) is set; without flags the error alone decides. The
    worst ceil(fraction * eligible) by percentage error are selected, a true zero
    counting as infinite; ties go by order. Ranks come from ranges of the eligible.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    flagged = F.lit(True) if flags is None else F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in flags]) if len(flags) > 1 else F.coalesce(F.col(flags[0]), F.lit(False))
    rows = materialize(with_fold_rmse(rows, fold, y, p).withColumn("eligible", (F.col("abs_error") > factor * F.col("fold_rmse")) & flagged), "outliers")
    ranked = with_row_id(rows.where("eligible").withColumn("_worst", -F.col("ape")), ["_worst", *order], "_at").drop("_worst")
    n = rows.where("eligible").count()
    ranked = ranked.withColumns({"ape_rank": F.col("_at") + 1, "selected": F.col("_at") < math.ceil(n * fraction - 1e-9)}).drop("_at")
    return ranked.unionByName(rows.where("not eligible").withColumns({"ape_rank": F.lit(None).cast("long"), "selected": F.lit(False)}))


def select_classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """Every misclassified row is eligible and selected; labels are compared as text."""
    wrong = ~F.col(y).cast("string").eqNullSafe(F.col(p).cast("string"))
    return df.withColumns({"eligible": wrong, "selected": wrong})


def attach_annotations(df: DataFrame, annotations: DataFrame, key: str, flag: str, tier: str, order: list[str] | None = None) -> DataFrame:
    """Flags and tiers by row key, the first of repeated annotations; misses are false and 'none'."""
    first = stable_first(annotations.select(F.col(key).alias("_key"), F.col(flag).alias("_flag"), F.col(tier).alias("_tier"), *[c for c in order or [] if c not in (key, flag, tier)]), ["_key"], order or ["_flag", "_tier"])
    out = df.drop(flag, tier).join(first.select("_key", "_flag", "_tier"), F.col(key) == F.col("_key"), "left")
    return out.withColumns({flag: F.coalesce("_flag", F.lit(False)), tier: F.coalesce("_tier", F.lit("none"))}).drop("_key", "_flag", "_tier")


def remaining(df: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """The rows whose key was not selected."""
    return df.join(selected.select(F.col(key).alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")


def zscore_outliers(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    moments = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.join(F.broadcast(moments)).where((F.col("_s") > 0) & (F.abs(F.col(column) - F.col("_m")) > threshold * F.col("_s"))).drop("_m", "_s")
