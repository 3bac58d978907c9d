"""Grid landscapes: density, mean activity and class shares by node, ruggedness, and samples of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(df: DataFrame, x: str, y: str, size: int, low: float, high: float) -> DataFrame:
    """Adds gx and gy: cells of a size x size grid over [low, high), values beyond clamped."""
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((F.col(c) - low) / (high - low) * size))).cast("int")
    return df.withColumns({"gx": cell(x), "gy": cell(y)})


def density(df: DataFrame) -> DataFrame:
    return df.groupBy("gx", "gy").agg(F.count("*").alias("density"))


def mean_activity(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("gx", "gy").agg(F.count("*").alias("density"), F.avg(value).alias("mean_activity"))


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Share of label 1 by node."""
    return df.groupBy("gx", "gy").agg(F.count("*").alias("density"), (F.count_if(F.col(label) == 1) / F.count("*")).alias("share"))


def ruggedness(grid: DataFrame, value: str, size: int) -> DataFrame:
    """Mean over a whole size x size grid of the root of summed squared differences to the up to eight neighbours, times 100. Empty cells are 0.

    With m cells in the 3 x 3 window of a cell, sums s1 of their values and s2 of their
    squares, the sum is m h^2 - 2 h s1 + s2; each cell is sent to its neighbours, an
    equi-join by aggregation, and the grid itself is no more than its cells.
    """
    step = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    one = grid.select("gx", "gy", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).where("v <> 0")
    sent = one.withColumn("dx", step).withColumn("dy", step)
    inside = lambda c: (c >= 0) & (c < size)
    sent = sent.select((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), "v", F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("v")).otherwise(0.0).alias("h"))
    sums = sent.where(inside(F.col("gx")) & inside(F.col("gy"))).groupBy("gx", "gy").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.sum("h").alias("h"))
    edge = lambda c: 3 - (F.col(c) == 0).cast("int") - (F.col(c) == size - 1).cast("int")
    square = F.greatest(edge("gx") * edge("gy") * F.col("h") * F.col("h") - 2 * F.col("h") * F.col("s1") + F.col("s2"), F.lit(0.0))
    # cells whose window is empty add nothing but count
    return sums.agg((F.coalesce(F.sum(F.sqrt(square)), F.lit(0.0)) / (size * size) * 100).alias("ruggedness"))


def entropy(grid: DataFrame, n_nodes: int) -> DataFrame:
    """Shannon entropy of the density, over the logarithm of the number of all nodes, empty ones included."""
    total = grid.agg(F.sum("density").alias("t"))
    p = F.col("density") / F.col("t")
    return grid.where("density > 0").join(F.broadcast(total)).agg((-F.sum(p * F.ln(p)) / F.ln(F.lit(float(n_nodes)))).alias("entropy"))


def top_nodes(grid: DataFrame, metric: str, n: int, least: float | None = None, ascending: bool = False) -> DataFrame:
    rows = grid if least is None else grid.where(F.col(metric) >= least)
    return rows.orderBy(F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric), "gx", "gy").limit(n)


def members(df: DataFrame, chosen: DataFrame) -> DataFrame:
    return df.join(chosen.select("gx", "gy"), ["gx", "gy"], "left_semi")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash: the same rows however the input is partitioned."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
