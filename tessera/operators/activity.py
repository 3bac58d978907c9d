"""Activity classification by a threshold chosen for each target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import to_nanomolar

#: Thresholds in nM, in the order that decides ties (fixed values).
THRESHOLDS = (1000.0, 500.0, 100.0, 50.0)
#: Types of measurements that depend on a dose (fixed values).
DOSES = ("ki", "ic50", "ec50", "potency")


def choose_thresholds(df: DataFrame, target: str, value: str, thresholds: tuple[float, ...] = THRESHOLDS, least: int = 100, least_active: int = 20, share: float = 0.25) -> DataFrame:
    """For each target the threshold t (active: value < t; inactive: value >= 10 t; between: neither) whose active share is nearest to `share`.

    Only thresholds with more than `least` classified values, `least_active` active ones
    and a majority of inactive ones count; of two as near the one given first wins. One
    pass: all thresholds are counted in the same aggregation. Null targets are a target.
    """
    counts = [c for k, t in enumerate(thresholds) for c in (F.count_if(F.col(value) < t).alias(f"_a{k}"), F.count_if(F.col(value) >= 10 * t).alias(f"_i{k}"))]
    out = df.where(F.col(value).isNotNull()).groupBy(target).agg(*counts)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(float(t)).alias("threshold"), F.col(f"_a{k}").alias("n_active"), F.col(f"_i{k}").alias("n_inactive")) for k, t in enumerate(thresholds)]))
    rows = out.select(target, each.alias("t")).select(target, "t.*").withColumn("n", F.col("n_active") + F.col("n_inactive"))
    rows = rows.where((F.col("n") > least) & (F.col("n_active") >= least_active) & (2 * F.col("n_inactive") > F.col("n")))
    best = F.min_by(F.struct("threshold", "n_active", "n"), F.struct(F.abs(F.col("n_active") / F.col("n") - share), F.col("at"))).alias("b")
    return rows.groupBy(target).agg(best).select(target, "b.threshold", "b.n_active", "b.n")


def label_rows(df: DataFrame, target: str | None, kind: str = "standard_type", value: str = "standard_value", unit: str = "standard_units", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """df with value_nm and label.

    Inhibition is inactive up to 50 and active beyond; types of a dose go by their
    target's threshold, and take the place of an inhibition label. Without a target
    column all rows share one.
    """
    one = target is None
    rows = df.withColumn("_target", F.lit(0)) if one else df.withColumn("_target", F.col(target))
    x, t = F.col(value).try_cast("double"), F.lower(F.col(kind))
    dose = F.greatest(*[t.contains(d) for d in DOSES])
    rows = rows.withColumns({"value_nm": to_nanomolar(x, F.col(unit)), "_dose": F.coalesce(dose, F.lit(False)), "_x": x})
    chosen = choose_thresholds(rows.where("_dose").select("_target", "value_nm"), "_target", "value_nm", thresholds).select(F.col("_target").alias("_t"), "threshold")
    rows = rows.join(chosen, F.col("_target").eqNullSafe(F.col("_t")), "left")
    by_dose = F.when(F.col("value_nm") < F.col("threshold"), "active").when(F.col("value_nm") >= 10 * F.col("threshold"), "inactive")
    inhibition = F.when(t.contains("inhibition"), F.when(F.col("_x") <= 50, "inactive").when(F.col("_x") > 50, "active"))
    return rows.withColumn("label", F.when(F.col("_dose"), by_dose).otherwise(inhibition)).drop("_target", "_dose", "_x", "_t", "threshold")


def settle(df: DataFrame, molecule: str, label: str = "label") -> DataFrame:
    """Each molecule's one label and its rows with it; molecules with both labels, or none, are left out."""
    by = df.where(F.col(label).isNotNull() & F.col(molecule).isNotNull()).groupBy(molecule).agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.count("*").alias("n_rows"))
    return by.where("_low = _high").select(molecule, F.col("_low").alias(label), "n_rows")


def classify(df: DataFrame, molecule: str, target: str | None = None, **columns) -> DataFrame:
    """df with the label that its molecule has in all rows that have any, else null."""
    rows = label_rows(df, target, **columns)
    known = settle(rows, molecule).select(F.col(molecule).alias("_m"), F.col("label").alias("_l"))
    return rows.drop("label").join(known, F.col(molecule) == F.col("_m"), "left").withColumn("label", F.col("_l")).drop("_m", "_l")
