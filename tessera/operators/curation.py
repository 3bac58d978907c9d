"""Dataset curation: duplicate resolution with conflict checks, outlier flags, unit checks, compound merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import normalize_unit
from tessera.operators.frame import quantiles


def resolve_regression_duplicates(df: DataFrame, identity: list[str], targets: list[str], threshold: float, order: list[str]) -> DataFrame:
    """One row for each identity: the first by order, its targets replaced by their means.

    A group whose spread exceeds threshold (strictly) in any target is removed whole.
    One aggregation, combined before its shuffle. Null identities form a group.
    """
    rest = [c for c in df.columns if c not in identity and c not in targets]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_row")
    spread = [(F.max(t) - F.min(t)).alias(f"_s_{t}") for t in targets]
    out = df.groupBy(*identity).agg(first, *[F.avg(t).alias(t) for t in targets], *spread, F.count("*").alias("n_rows"))
    for t in targets:
        out = out.where(F.coalesce(F.col(f"_s_{t}"), F.lit(0.0)) <= threshold)
    return out.select(*identity, *targets, *[F.col(f"_row.{c}").alias(c) for c in rest], "n_rows")


def resolve_label_duplicates(df: DataFrame, identity: list[str], label: str, order: list[str]) -> DataFrame:
    """The first row of each identity whose labels agree; conflicting groups are removed."""
    rest = [c for c in df.columns if c not in identity and c != label]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_row")
    out = df.groupBy(*identity).agg(F.min(label).alias(label), F.max(label).alias("_other"), first, F.count("*").alias("n_rows"))
    return out.where(F.col(label).eqNullSafe(F.col("_other"))).select(*identity, label, *[F.col(f"_row.{c}").alias(c) for c in rest], "n_rows")


def duplicate_audit(df: DataFrame, identity: list[str], target: str, threshold: float) -> DataFrame:
    """Groups of two and more: their size, spread, and whether they were averaged or removed."""
    groups = df.groupBy(*identity).agg(F.count("*").alias("n_rows"), F.min(target).alias("low"), F.max(target).alias("high")).where("n_rows > 1")
    return groups.withColumn("action", F.when(F.col("high") - F.col("low") > threshold, "removed").otherwise("aggregated"))


def iqr_flags(df: DataFrame, column: str, factor: float = 1.5, group: list[str] | None = None) -> DataFrame:
    """Rows outside factor times the interquartile range, by group. Groups of under 4 values or without spread have none."""
    group = group or []
    q = quantiles(df, column, {"_a": 0.25, "_b": 0.75}, group).where("n >= 4 and _b > _a")
    q = q.select(*group, (F.col("_a") - factor * (F.col("_b") - F.col("_a"))).alias("low_bound"), (F.col("_b") + factor * (F.col("_b") - F.col("_a"))).alias("high_bound"))
    joined = df.join(q, group) if group else df.join(F.broadcast(q))
    return joined.where((F.col(column) < F.col("low_bound")) | (F.col(column) > F.col("high_bound")))


def unit_quality(df: DataFrame, unit: str, group: list[str]) -> DataFrame:
    """Distinct normalized units of each group, and whether there is just one."""
    out = df.groupBy(*group).agg(F.array_sort(F.collect_set(normalize_unit(F.col(unit)))).alias("units"))
    return out.select(*group, F.array_join("units", "|").alias("units"), F.size("units").cast("long").alias("n_units"), (F.size("units") <= 1).alias("homogeneous"))


def distinct_tokens(df: DataFrame, keys: list[str], column: str, order: str, name: str, separator: str = "|") -> DataFrame:
    """(keys, name): distinct trimmed tokens of pipe-joined cells in the order they are first seen, joined again.

    Tokens meet with their first place alone, so that a key's many rows are reduced
    before they are put in order. Keys without tokens are left out.
    """
    each = df.where(F.col(column).isNotNull()).select(*keys, F.col(order).alias("_o"), F.posexplode(F.split(F.col(column).cast("string"), "\\|")).alias("_p", "_t")).withColumn("_t", F.trim("_t"))
    first = each.where("_t <> ''").groupBy(*keys, "_t").agg(F.min(F.struct("_o", "_p")).alias("_f"))
    tokens = F.array_sort(F.collect_list(F.struct("_f", "_t")))
    return first.groupBy(*keys).agg(F.array_join(F.transform(tokens, lambda s: s["_t"]), separator).alias(name))


def merge_compounds(df: DataFrame, identity: str, activity: str, metadata: list[str], order: str) -> DataFrame:
    """One row for each identity (null is one): activity statistics (sample std, null for one value) and unions of metadata."""
    out = df.groupBy(identity).agg(
        F.avg(activity).alias("activity_mean"), F.min(activity).alias("activity_min"), F.max(activity).alias("activity_max"),
        F.stddev_samp(activity).alias("activity_std"), F.count(activity).alias("n_activity"),
    )
    parts = [quantiles(df, activity, {"activity_final": 0.5}, [identity]).select(F.col(identity).alias("_k0"), "activity_final")]
    parts += [distinct_tokens(df, [identity], c, order, plural(c)).withColumnRenamed(identity, f"_k{k + 1}") for k, c in enumerate(metadata)]
    for k, part in enumerate(parts):
        out = out.join(part, F.col(identity).eqNullSafe(F.col(f"_k{k}")), "left").drop(f"_k{k}")
    numbers = ["activity_final", "activity_mean", "activity_min", "activity_max", "activity_std", "n_activity"]
    return out.select(identity, *numbers, *[plural(c) for c in metadata])


#: Columns whose merged values keep their name (fixed values).
SINGULAR = ("cluster_id", "query_keywords", "source")


def plural(column: str) -> str:
    """The name of a merged column: a final y gives ies, others an s."""
    if column in SINGULAR:
        return column
    return f"{column[:-1]}ies" if column.endswith("y") else f"{column}s"


def merge_labels(df: DataFrame, identity: str, label: str) -> DataFrame:
    """The commonest label (ties to the least), its rows, those of active and inactive, the share of active, and all counts as text, commonest first."""
    counts = df.where(F.col(label).isNotNull()).groupBy(identity, F.col(label).alias("l")).agg(F.count("*").alias("c"))
    all_ = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "l")))
    by = counts.groupBy(identity).agg(
        all_.alias("a"), F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("l") == "active", F.col("c"))), F.lit(0)).alias("n_active"),
        F.coalesce(F.sum(F.when(F.col("l") == "inactive", F.col("c"))), F.lit(0)).alias("n_inactive"),
    )
    text = F.array_join(F.transform("a", lambda s: F.concat_ws(":", s["l"], (-s["c"]).cast("string"))), "|")
    return by.select(identity, F.col("a")[0]["l"].alias("majority"), "n", "n_active", "n_inactive", (F.col("n_active") / F.col("n")).alias("active_fraction"), text.alias("label_counts"))


def audit_records(df: DataFrame, identity: list[str], target: str, threshold: float, key: str) -> DataFrame:
    """Groups of two and more with what was done, their values as JSON and their row keys, both in the order of the keys."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(target).alias("v")))).alias("r")
    groups = df.groupBy(*identity).agg(F.count("*").alias("n_rows"), (F.max(target) - F.min(target)).alias("spread"), rows).where("n_rows > 1")
    action = F.when(F.col("spread") > threshold, "removed").otherwise("aggregated")
    return groups.select(*identity, "n_rows", "spread", action.alias("action"), F.to_json(F.transform("r", lambda s: s["v"])).alias("values"), F.array_join(F.transform("r", lambda s: s["k"].cast("string")), ",").alias("row_keys"))


def collapse_examples(df: DataFrame, identity: str, raw: str, limit: int = 50) -> DataFrame:
    """Identities with more than one raw spelling: how many, and the spellings in order; the most spellings first."""
    by = df.where(F.col(identity).isNotNull()).groupBy(identity, raw).agg(F.count("*").alias("c")).where(F.col(raw).isNotNull())
    out = by.groupBy(identity).agg(F.count("*").alias("n_spellings"), F.sum("c").alias("n_rows"), F.array_join(F.array_sort(F.collect_list(raw)), "|").alias("spellings"))
    return out.where("n_spellings > 1").orderBy(F.desc("n_spellings"), F.asc(identity)).limit(limit)


def standardization_summary(df: DataFrame, raw: str, standardized: str) -> DataFrame:
    """One row of counters: rows, empty, failed, valid, changed, distinct before and after, and rows that lost stereo marks."""
    stereo = lambda c: F.coalesce(F.col(c).rlike(r"[@/\\\\]"), F.lit(False))
    empty = F.col(raw).isNull() | (F.trim(raw) == "")
    ok = F.col(standardized).isNotNull()
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(empty).alias("n_empty"), F.count_if(~empty & ~ok).alias("n_failed"), F.count_if(ok).alias("n_valid"),
        F.count_if(ok & (F.col(raw) != F.col(standardized))).alias("n_changed"), F.count_distinct(raw).alias("n_raw"), F.count_distinct(standardized).alias("n_standardized"),
        F.count_if(ok & stereo(raw) & ~stereo(standardized)).alias("n_stereo_lost"),
    )


def duplicate_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier one in the columns, and how many different ones there are. Nulls are equal."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count("*").alias("distinct_rows"))


def joined_distinct(df: DataFrame, by: list[str], column: str, name: str, separator: str = "|") -> DataFrame:
    """By group the rows and the sorted distinct values of a column as text."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(column)), separator).alias(name), F.count("*").alias("n"))
