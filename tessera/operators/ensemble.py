"""Aggregation of component predictions, model ranking and catalog search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def regression(df: DataFrame, id_col: str, components: list[str]) -> DataFrame:
    """Median, mean, population deviation, least and greatest of a row's components; nulls are left out. Row-wise, no shuffle."""
    a = F.array_compact(F.array(*[F.col(c).cast("double") for c in components]))
    df = df.select(id_col, F.array_sort(a).alias("a")).withColumn("n", F.size("a"))
    mean = F.aggregate("a", F.lit(0.0), lambda s, x: s + x) / F.col("n")
    df = df.withColumn("mean", F.when(F.col("n") > 0, mean))
    deviation = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + F.pow(x - F.col("mean"), 2)) / F.col("n"))
    half = F.floor(F.col("n") / 2).cast("int")
    median = F.when(F.col("n") % 2 == 1, F.get("a", half)).otherwise((F.get("a", half - 1) + F.get("a", half)) / 2)
    return df.select(id_col, F.when(F.col("n") > 0, median).alias("median"), "mean", F.when(F.col("n") > 0, deviation).alias("std"), F.array_min("a").alias("low"), F.array_max("a").alias("high"))


def vote(df: DataFrame, id_col: str, components: list[str]) -> DataFrame:
    """The commonest label of a row's components, ties to the smallest, and its share."""
    long = df.unpivot([id_col], components, "component", "label").where(F.col("label").isNotNull())
    counts = long.groupBy(id_col, "label").agg(F.count("*").alias("n"))
    best = counts.groupBy(id_col).agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label"))).alias("b"), F.sum("n").alias("all"))
    return best.select(id_col, F.col("b.label").alias("label"), (F.col("b.n") / F.col("all")).alias("share"))


def rank_models(df: DataFrame, better_high: list[str], better_low: list[str], id_col: str) -> DataFrame:
    """Lexicographic ranking, nulls worst, ties by id. Models are few: a catalog's rows."""
    order = [F.desc_nulls_last(c) for c in better_high] + [F.asc_nulls_last(c) for c in better_low] + [F.asc(id_col)]
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_of_each(df: DataFrame, group: str, score: str, id_col: str, most: int) -> DataFrame:
    """The best record of each group, and of those the best `most`."""
    best = df.groupBy(group).agg(F.min_by(F.struct(id_col, score), F.struct(-F.col(score), F.col(id_col))).alias("b"))
    return best.select(group, f"b.{id_col}", f"b.{score}").orderBy(F.desc(score), F.asc(id_col)).limit(most)


def upsert(catalog: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The union in which a new record of a key wins over old ones, and of records of one side the last by order (all columns without one); sorted by key."""
    both = catalog.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(2)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_age")]
    last = F.max_by(F.struct(*rest), F.struct("_age", *[F.col(c) for c in order or sorted(rest)]))
    return both.groupBy(key).agg(last.alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in both.columns if c != "_age"]).orderBy(key)
