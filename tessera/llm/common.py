"""Helpers that every text operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.storage import forget, materialize
from tessera.plans.storage import shared_folder as shared_dir

__all__ = ["forget", "materialize", "shared_dir"]

#: The separators of a word, as code points: space and \t \n \v \f \r.
SEPARATORS = " \t\n\x0b\f\r"
#: The same, as the class of a regular expression.
SEPARATOR_CLASS = "[\\x20\\x09-\\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a test table (all without names)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def keyed(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column `key` that is unique and in the order of the ids.

    It is the id itself where ids are unique and none is null: only ids are counted for
    that. Otherwise every row is numbered in the order of id, hash of the text and
    place, by range partitions; null ids come first. The numbered rows are written, so
    that each keeps its number.
    """
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    seen = docs.groupBy(id_col).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.col(id_col).isNull())
    if seen.isEmpty():
        return docs.withColumn(key, F.col(id_col))
    order = ["_id", "_text", "_place"]
    marked = docs.withColumns({"_id": F.col(id_col), "_text": F.xxhash64(text_col), "_place": F.monotonically_increasing_id()})
    sorted_ = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    placed = materialize(sorted_.withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "keyed")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = placed.groupBy(F.col("_pid").alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(sizes), F.col("_pid") == F.col("_p")).withColumn(key, F.col("_base") + F.col("_at")).drop("_pid", "_p", "_at", "_base")


def few(ids: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A written frame of ids, to be broadcast only if it has `most` rows at most."""
    return F.broadcast(ids) if ids.count() <= most else ids


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give free memory back to the system, at the end of a Python task: Spark keeps more idle workers than tasks run at once."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small(batches, rows: int = 256):
    """The same rows in short batches, so that little is held beside the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(sizes: list[int], limit: int):
    """(from, to) runs of consecutive items whose sizes sum to about limit; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
