"""Joins by key with checks, and frames put side by side by position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.frame import with_row_id
from tessera.operators.metrics import by_status
from tessera.plans.storage import materialize


class KeyProblem(ValueError):
    """Keys that a strict join cannot take."""


def check_unique(df: DataFrame, keys: list[str], name: str) -> None:
    """An error with examples if a key repeats or is null."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).limit(5).collect()
    if bad:
        raise KeyProblem(f"{name} has repeated or null keys {keys}: {[tuple(r[k] for k in keys) for r in bad]}")


def canonical_keys(df: DataFrame, keys: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Key columns through their functions before a join; a key that gives null is an error."""
    out = df.withColumns({k: f(F.col(k)) for k, f in keys.items()})
    bad = out.where(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).limit(1).collect()
    if bad:
        raise KeyProblem(f"a key has no canonical form: {bad[0].asDict()}")
    return out


def join_features(base: DataFrame, features: list[DataFrame], keys: list[str], drop_repeated: bool = True) -> DataFrame:
    """base with the columns of feature frames, one to one: unique keys everywhere, no base row without features, no change of rows.

    Columns that are there already are left out, or with drop_repeated=False refused. All
    checks are aggregations and anti-joins; nothing is gathered.
    """
    check_unique(base, keys, "the base")
    out = base
    for k, feature in enumerate(features):
        check_unique(feature, keys, f"feature frame {k}")
        again = [c for c in feature.columns if c in out.columns and c not in keys]
        if again and not drop_repeated:
            raise KeyProblem(f"feature frame {k} repeats columns {again}")
        missing = base.select(*keys).join(feature, keys, "left_anti").limit(5).collect()
        if missing:
            raise KeyProblem(f"feature frame {k} lacks keys such as {[tuple(r) for r in missing]}")
        out = out.join(feature.drop(*again), keys, "left")
    return out


def with_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str = "_assay") -> DataFrame:
    """A left join by key in which the right side's columns of the same names get a suffix."""
    again = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c != key}
    return left.join(right.withColumnsRenamed(again), key, "left")


def existing_wins(df: DataFrame, lookup: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """df's columns filled from the lookup where they are null or empty: column -> lookup column. Lookup keys are unique."""
    right = lookup.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_l{k}") for k, c in enumerate(columns.values())])
    out = df.join(right, F.col(key) == F.col("_key"), "left")
    for k, c in enumerate(columns):
        own = F.nullif(F.col(c).cast("string"), F.lit("")).cast(df.schema[c].dataType) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(own, F.col(f"_l{k}")))
    return out.drop("_key", *[f"_l{k}" for k in range(len(columns))])


def attach(df: DataFrame, values: DataFrame, order: list[str], values_order: list[str], columns: list[str] | None = None, check: bool = True) -> DataFrame:
    """Columns of values beside df's rows by position in both orders; those that df has are left out. Frames of other lengths are refused."""
    if check and (n := df.count()) != (m := values.count()):
        raise KeyProblem(f"{m} values for {n} rows")
    new = [c for c in columns or values.columns if c not in df.columns]
    left, right = with_row_id(df, order, "_row"), with_row_id(values, values_order, "_other").select("_other", *new)
    return left.join(right, F.col("_row") == F.col("_other"), "left").drop("_row", "_other")


def attach_statuses(df: DataFrame, statuses: DataFrame | None, order: list[str], statuses_order: list[str], status: str = "ad_status") -> DataFrame:
    """Statuses by position, and whether a row is out of domain; unknown ones, and all of a frame of another length, are not."""
    if statuses is None or statuses.count() != df.count():
        return df.withColumns({status: F.lit(None).cast("string"), "ad_out_of_domain": F.lit(False)})
    out = attach(df, statuses.select(status, *[c for c in statuses_order if c != status]), order, statuses_order, [status], check=False)
    return out.withColumn("ad_out_of_domain", F.coalesce(F.col(status) != "in_domain", F.lit(False)))


def attach_scores(df: DataFrame, scores: DataFrame, order: list[str], scores_order: list[str], y: str, p: str, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Predictions with their domain scores by position, and their metrics by status."""
    out = materialize(attach(df, scores, order, scores_order), "scored")
    return out, by_status(out, status, y, p)


def truth_and_predictions(rows: DataFrame, split: DataFrame, predictions: DataFrame, order: list[str], predictions_order: list[str], part: str, target: str) -> DataFrame:
    """(row_id, y, p): the rows of a split by position in their order, with predictions by position in theirs; nulls and texts that are no numbers are left out."""
    numbered = with_row_id(rows, order, "row_id")
    own = split.where(F.col("split") == part).select("row_id")
    chosen = with_row_id(numbered.join(own, "row_id", "left_semi"), ["row_id"], "_at").select("_at", "row_id", F.col(target).cast("string").try_cast("double").alias("y"))
    said = with_row_id(predictions, predictions_order, "_p").select("_p", F.col(target).cast("string").try_cast("double").alias("p"))
    return chosen.join(said, F.col("_at") == F.col("_p")).where("y is not null and p is not null").select("row_id", "y", "p")


def side_by_side(base: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Feature frames beside base by row key; columns that are there already win."""
    out = base
    for part in parts:
        out = out.join(part.select(key, *[c for c in part.columns if c not in out.columns]), key, "left")
    return out


def lookup(df: DataFrame, values: DataFrame, key: str, column: str, default=None) -> DataFrame:
    """A map from keys to a value (the least of repeated ones), with a default for misses."""
    right = values.groupBy(F.col(key).alias("_key")).agg(F.min(column).alias("_v"))
    out = df.drop(column).join(right, F.col(key) == F.col("_key"), "left")
    return out.withColumn(column, F.coalesce("_v", F.lit(default)) if default is not None else F.col("_v")).drop("_key", "_v")


def reindex(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """df's rows in which columns of the mapping of the same names take its values by row key; rows without a match keep theirs."""
    own = [c for c in mapping.columns if c != key]
    right = mapping.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_m_{c}") for c in own])
    out = df.join(right, F.col(key) == F.col("_key"), "left")
    out = out.withColumns({c: F.when(F.col("_hit"), F.col(f"_m_{c}")).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c in own})
    return out.drop("_key", "_hit", *[f"_m_{c}" for c in own])


def first_seen_codes(train: DataFrame, df: DataFrame, column: str, order: str) -> DataFrame:
    """df with `code`: the place at which train first shows its category, -1 for others. Categories are few and are numbered by ranges."""
    value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    seen = train.select(value.alias("_c"), F.col(order).alias("_o")).where("_c is not null").groupBy("_c").agg(F.min("_o").alias("_o"))
    codes = with_row_id(seen, ["_o", "_c"], "_k").select("_c", F.col("_k").cast("int").alias("_k"))
    return df.withColumn("_v", value).join(codes, F.col("_v") == F.col("_c"), "left").withColumn("code", F.coalesce("_k", F.lit(-1))).drop("_v", "_c", "_k")
