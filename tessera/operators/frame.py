"""Generic dataframe commands with explicit row order.

Frames carry a row id where order matters; "first" always means the least row id.
Nulls sort last in both directions.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.plans.storage import materialize


def stable_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key (null keys group together): the first in order. Combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row")) if rest else df.distinct()
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns) if rest else picked


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def sort(df: DataFrame, by: list[str], ascending: bool | list[bool] = True) -> DataFrame:
    flags = ascending if isinstance(ascending, list) else [ascending] * len(by)
    return df.orderBy(*[F.asc_nulls_last(c) if a else F.desc_nulls_last(c) for c, a in zip(by, flags, strict=True)])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc(column))


def unique(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values, null included, as they are first seen."""
    return df.groupBy(column).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each numeric column: count, mean, sample std, min, exact quartiles, max."""
    columns = columns or numeric_columns(df)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    moments = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"]).drop("n")
    return moments.join(F.broadcast(q), "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column of any type: count, distinct values, the commonest (least of ties) and its count, and for numbers what describe() says."""
    columns = columns or df.columns
    plain = [c for c in columns if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in plain]).unpivot([], plain, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("c"))
    valued = F.col("value").isNotNull()
    best = F.min_by(F.struct("value", "c"), F.struct(-F.col("c"), F.col("value"))).alias("b")
    tops = counts.where(valued).groupBy("column").agg(F.sum("c").alias("count"), F.count("*").alias("unique"), best)
    names = F.broadcast(df.sparkSession.createDataFrame([(c,) for c in plain], "column string"))
    out = names.join(tops, "column", "left").select("column", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("unique", F.lit(0)).alias("unique"), F.col("b.value").alias("top"), F.col("b.c").alias("freq"))
    numbers = [c for c in plain if c in numeric_columns(df)]
    if not numbers:
        return out
    return out.join(F.broadcast(describe(df, numbers).drop("count")), "column", "left")


def _reductions(aggregates) -> list[Column]:
    """Columns of {column: one or several reductions}: a single one keeps the column's name, several add theirs."""
    out = []
    for c, how in aggregates.items():
        out += [reduction(how, c).alias(c)] if isinstance(how, str) else [reduction(h, c).alias(f"{c}_{h}") for h in how]
    return out


def group_aggregate(df: DataFrame, by: list[str], aggregates: dict[str, str | list[str]] | None = None, order: list[str] | None = None) -> DataFrame:
    """Null keys are dropped; without aggregates the sizes of the groups. first and last go by the given order."""
    for k in by:
        df = df.where(F.col(k).isNotNull())
    groups = df.groupBy(*by)
    if not aggregates:
        return groups.agg(F.count("*").alias("size"))
    ordered = {c: h for c, h in aggregates.items() if h in ("first", "last")}
    if ordered and not order:
        raise ValueError("first and last need an order of rows")
    plain = {c: h for c, h in aggregates.items() if c not in ordered}
    rank = F.struct(*[F.col(c) for c in order or []])
    ends = [(F.min_by if h == "first" else F.max_by)(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c, h in ordered.items()]
    return groups.agg(*_reductions(plain), *ends).select(*by, *[x for c, h in aggregates.items() for x in ([c] if isinstance(h, str) else [f"{c}_{k}" for k in h])])


def aggregate(df: DataFrame, how, columns: list[str] | None = None) -> DataFrame:
    """One row: a reduction or a list of them over columns (numeric ones unless named), or a reduction for each column."""
    if isinstance(how, dict):
        return df.agg(*_reductions(how))
    columns = columns or numeric_columns(df)
    return df.agg(*_reductions({c: how for c in columns}))


#: Reductions by name.
REDUCTIONS = {
    "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp,
    "count": F.count, "nunique": F.count_distinct, "mode": lambda c: F.mode(c, True), "size": lambda c: F.count("*"),
}


def reduction(how: str, column: str) -> Column:
    if how not in REDUCTIONS:
        raise ValueError(f"unknown reduction {how!r}; known: {sorted(REDUCTIONS)}")
    return REDUCTIONS[how](column)


def predicate(expression: str) -> str:
    """A dataframe-query expression as SQL: ==, and, or, not, in [..], backticks."""
    parts = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)", expression)
    out = []
    for k, p in enumerate(parts):
        if k % 2:
            out.append("'" + p[1:-1].replace("'", "''") + "'" if p[0] == '"' else p)
        else:
            p = p.replace("==", "=").replace("&", " AND ").replace("|", " OR ").replace("~", " NOT ")
            out.append(p.replace("[", "(").replace("]", ")"))
    return "".join(out)


def query(df: DataFrame, expression: str) -> DataFrame:
    return df.where(predicate(expression))


def with_row_id(df: DataFrame, keys: list[str], name: str = "row_id") -> DataFrame:
    """Consecutive numbers from 0 in the order of keys, without gathering rows in one task.

    Rows are range-partitioned and sorted by the keys and numbered in place; that is
    written once, and the sizes of the partitions before are added when it is read.
    Nulls come first.
    """
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(sorted_.withColumns({"_part": F.spark_partition_id(), "_local": place}), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    return placed.join(F.broadcast(_before(sizes, ["_size"])), "_part").withColumn(name, F.col("_b_size") + F.col("_local")).drop("_part", "_local", "_b_size")


def _before(parts: DataFrame, columns: list[str]) -> DataFrame:
    """(_part, _b..): the sums over the partitions before; one row a partition."""
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_b{c}") for c in columns])


def running_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds columns with the sums of others up to and with each row, in the order given; no task gets more than its range.

    sums: new name -> summed column. Sums are doubles, exact for whole numbers below 2**53.
    """
    names = list(sums)
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*sorted_.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    # a task's last values are those of its whole range
    at = {n: sorted_.columns.index(sums[n]) for n in names}

    def run(batches):
        base = dict.fromkeys(names, 0.0)
        for b in batches:
            own = []
            for n in names:
                x = np.cumsum(b.column(at[n]).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)) + base[n]
                base[n] = float(x[-1]) if len(x) else base[n]
                own.append(pa.array(x))
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, *names])

    local = materialize(sorted_.mapInArrow(run, schema), "sums")
    ends = local.groupBy("_part").agg(*[F.sum(sums[n]).cast("double").alias(n) for n in names])
    out = local.join(F.broadcast(_before(ends, names)), "_part")
    return out.withColumns({n: F.col(n) + F.col(f"_b{n}") for n in names}).drop("_part", *[f"_b{n}" for n in names])


def quantiles(df: DataFrame, column: str, probabilities: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact linear quantiles by group, as columns of the given names: the values at two ranks, found by running counts.

    Counts by distinct value are put in order by ranges, so neither a group nor its
    distinct values need fit into a task. Null values are left out.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    upto = materialize(running_sums(counts, [*by, "_v"], {"_u": "_c"}), "quantiles")
    groups = upto.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min(F.col("_u") - F.col("_c")).alias("_b"))
    # null groups are groups too
    names = [f"_g{k}" for k in range(len(by))]
    groups = groups.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], "_n", "_b")
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    rows = upto.join(groups if by else F.broadcast(groups), same) if by else upto.join(F.broadcast(groups))
    low, high = F.col("_u") - F.col("_c") - F.col("_b"), F.col("_u") - F.col("_b")
    out = []
    for name, p in probabilities.items():
        h = F.lit(p) * (F.col("_n") - 1)
        at = lambda k: F.max(F.when((low <= k) & (k < high), F.col("_v")))
        a, b, part = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        out.append((a + (b - a) * part).alias(name))
    return rows.groupBy(*by).agg(*out, F.max("_n").alias("n"))


def isnull(df: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Whether each of the columns is null, beside those to keep."""
    return df.select(*(keep or []), *[F.col(c).isNull().alias(c) for c in columns or df.columns])


def concat(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


#: Functions that apply, map and transform take by name; code is refused.
FUNCTIONS = {
    "abs": F.abs, "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "exp": F.exp, "log": lambda c: F.when(c > 0, F.log(c)), "log10": lambda c: F.when(c > 0, F.log10(c)), "round": F.round,
    "floor": F.floor, "ceil": F.ceil, "lower": F.lower, "upper": F.upper, "strip": F.trim, "len": F.length, "str": lambda c: c.cast("string"),
    "int": lambda c: c.try_cast("bigint"), "float": lambda c: c.try_cast("double"), "isnull": F.isnull,
}


def apply(df: DataFrame, function: str, columns: list[str] | None = None) -> DataFrame:
    """The named function on the named columns (all without names), in place."""
    if function not in FUNCTIONS:
        raise ValueError(f"functions are taken by name, never as code; known: {sorted(FUNCTIONS)}")
    return df.withColumns({c: FUNCTIONS[function](F.col(c)) for c in columns or df.columns})


def loc(df: DataFrame, key: str, rows: list | tuple | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows by their labels in column key: a list of labels, or a pair (first, last) with both ends; all without rows."""
    if isinstance(rows, tuple):
        low, high = rows
        df = df if low is None else df.where(F.col(key) >= low)
        df = df if high is None else df.where(F.col(key) <= high)
    elif rows is not None:
        df = df.where(F.col(key).isin(*rows))
    return df.select(*columns) if columns else df


def iloc(df: DataFrame, order: list[str], rows: slice | list[int] | int | None = None, columns: slice | list[int] | None = None) -> DataFrame:
    """Rows and columns by position, from 0 in the given order; a slice of rows may count from the end."""
    names = df.columns if columns is None else df.columns[columns] if isinstance(columns, slice) else [df.columns[k] for k in columns]
    if rows is None:
        return df.select(*names)
    numbered = with_row_id(df, order, "_row")
    if isinstance(rows, slice):
        start, stop, step = rows.indices(df.count() if min(rows.start or 0, rows.stop if rows.stop is not None else 0) < 0 or rows.stop is None else max(rows.stop, 0))
        if step < 1:
            raise ValueError("rows go forward")
        chosen = numbered.where((F.col("_row") >= start) & (F.col("_row") < stop) & ((F.col("_row") - start) % step == 0))
    else:
        wanted = [rows] if isinstance(rows, int) else list(rows)
        n = df.count() if any(k < 0 for k in wanted) else 0
        chosen = numbered.where(F.col("_row").isin(*[k + n if k < 0 else k for k in wanted]))
    return chosen.select(*names)


def transpose(df: DataFrame, index: str, most: int = 1000) -> DataFrame:
    """Rows become columns named by index; for frames of up to `most` rows, beyond that an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"transpose takes {most} rows at most")
    rest = [c for c in df.columns if c != index]
    return df.select(F.col(index).cast("string").alias(index), *[F.col(c).cast("string").alias(c) for c in rest]).transpose(F.col(index)).withColumnRenamed("key", "column")


def sample(df: DataFrame, keys: list[str], n: int | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """n rows, or about a fraction of them, by a seeded hash of the keys: the same however the input is partitioned."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in keys])
    if fraction is not None:
        return df.where(F.pmod(h, F.lit(1 << 30)) < int(fraction * (1 << 30)))
    return df.orderBy(h, *keys).limit(n if n is not None else 5)


def records(df: DataFrame, order: list[str] | None = None, n: int = 100, orient: str = "records"):
    """The first n rows on the driver: as dicts by row, or with orient='list' or 'dict' by column."""
    rows = [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).limit(n).collect()]
    if orient == "records":
        return rows
    by = {c: [r[c] for r in rows] for c in df.columns}
    return by if orient == "list" else {c: dict(enumerate(v)) for c, v in by.items()}


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with any cell, but not with the order of rows: their number, and the sum and exclusive or of their hashes."""
    names = sorted(df.columns)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    schema = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in names)
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"))
    return row.select("n", F.substring(F.sha2(F.concat_ws("|", F.lit(schema), "n", "s", "x"), 256), 1, 16).alias("fingerprint"))


def beside(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Two frames side by side by position, each in its order; a longer one's rest has nulls, and right's columns of the same names are left out."""
    a = with_row_id(left, left_order, "_row")
    new = [c for c in right.columns if c not in left.columns]
    b = with_row_id(right, right_order, "_other").select("_other", *new)
    return a.join(b, F.col("_row") == F.col("_other"), "full").select(F.coalesce("_row", "_other").alias("row_id"), *left.columns, *new)


def drop_rows(df: DataFrame, key: str, labels: list) -> DataFrame:
    """The rows whose key is none of the labels; null keys stay."""
    return df.where(~F.coalesce(F.col(key).isin(*labels), F.lit(False)))


def schema_report(df: DataFrame, n: int = 5) -> dict:
    """Names, types, number of rows, nulls by column, and the first rows."""
    nulls = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).first().asDict()
    return {"columns": list(df.columns), "dtypes": dict(df.dtypes), "rows": nulls.pop("_n"), "nulls": nulls, "preview": records(df, n=n)}


def coerce_names(value) -> list[str]:
    """Names from a list, a JSON or Python list as text, or text with commas; None is none."""
    if value is None:
        return []
    if isinstance(value, dict):
        return list(value)
    if not isinstance(value, str):
        return [str(x) for x in value]
    text = value.strip()
    if text.startswith("["):
        try:
            return [str(x) for x in json.loads(text.replace("'", '"'))]
        except ValueError:
            text = text.strip("[]")
    return [x.strip().strip("\"'") for x in text.split(",") if x.strip()]


class Frames:
    """Named frames and the command interface over them: run(frame, command, **arguments) -> a new named frame.

    Rows are in the order of the columns given as `order`, of all columns without it.
    """

    def __init__(self, spark):
        self.spark, self.frames, self._n = spark, {}, 0

    def put(self, name: str, df: DataFrame) -> str:
        self.frames[name] = df
        df.createOrReplaceTempView(re.sub(r"\W", "_", name))
        return name

    def get(self, name: str) -> DataFrame:
        if name not in self.frames:
            near = sorted(self.frames, key=lambda k: (_distance(k.lower(), name.lower()), k))[:3]
            raise KeyError(f"no frame {name!r}; close names: {near}")
        return self.frames[name]

    def load(self, name: str, path: str, **options) -> str:
        """A file's rows under a name: CSV, TSV and the like; JSON is refused here and read by from_json."""
        from tessera.sources import readers

        if path.lower().endswith(".json"):
            raise ValueError("this reads delimited files; use sources.readers.read_json")
        return self.put(name, readers.load(self.spark, path, **options))

    def run(self, name: str, command: str, **a):
        df = self.get(name)
        out = self._command(df, ALIASES.get(command, command), a)
        if isinstance(out, DataFrame):
            self._n += 1
            return self.put(f"{name}_{command}_{self._n}", out)
        return out

    def _command(self, df: DataFrame, command: str, a: dict):
        if isinstance(a.get("parameters"), str):
            a = json.loads(a["parameters"]) | {k: v for k, v in a.items() if k != "parameters"}
        by = coerce_names(next((a[k] for k in ("by", "columns", "column", "subset", "items", "key") if a.get(k)), None))
        unknown = [c for c in by if c not in df.columns]
        if unknown:
            near = {c: sorted(df.columns, key=lambda k, c=c: (_distance(k.lower(), c.lower()), k))[:3] for c in unknown}
            raise KeyError(f"no columns {unknown}; close names: {near}")
        order, n = coerce_names(a.get("order")) or df.columns, int(a.get("n", 5))
        if command in ("select", "filter", "__getitem__") and by:
            return df.select(*by)
        if command in ("query", "filter"):
            return query(df, a.get("expr") or a["condition"])
        if command == "sort_values":
            return sort(df, by, a.get("ascending", True))
        if command == "drop":
            return drop_rows(df, a.get("label") or df.columns[0], a["index"]) if "index" in a else df.drop(*by)
        if command == "rename":
            return df.withColumnsRenamed(a["columns"])
        if command == "fillna":
            return df.na.fill(a["value"], subset=by or None)
        if command == "dropna":
            return df.na.drop(subset=by or None)
        if command == "drop_duplicates":
            return stable_first(df, by or df.columns, order)
        if command == "head":
            return df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(n)
        if command == "tail":
            return df.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(n)
        if command == "sample":
            return sample(df, order, n, float(a["frac"]) if "frac" in a else None, int(a.get("seed", 0)))
        if command == "loc":
            return loc(df, a.get("label") or df.columns[0], a.get("rows"), by)
        if command == "iloc":
            return iloc(df, order, a.get("rows"), a.get("cols"))
        if command in ("apply", "applymap", "map", "transform"):
            return apply(df, a["func"], by or None)
        if command == "transpose":
            return transpose(df, by[0] if by else df.columns[0])
        if command in ("to_dict", "to_list"):
            found = records(df.select(*by) if by else df, order if not by else None, n, a.get("orient", "records"))
            return [r[by[0]] for r in found] if command == "to_list" and by else found
        if command == "value_counts":
            return value_counts(df, by[0])
        if command == "unique":
            return unique(df, by[0], order[0])
        if command == "describe":
            return describe_all(df, by or None) if a.get("include") == "all" else describe(df, by or None)
        if command == "groupby":
            return group_aggregate(df, by, a.get("agg"), coerce_names(a.get("order")) or None)
        if command == "agg":
            return aggregate(df, a["func"], by or None)
        if command == "isnull":
            return isnull(df, by or None)
        if command == "notnull":
            return df.select(*[F.col(c).isNotNull().alias(c) for c in by or df.columns])
        if command == "identity":
            return df
        if command == "concat":
            return concat([df, *[self.get(k) for k in coerce_names(a["others"])]])
        if command == "len":
            return df.count()
        if command == "shape":
            return df.count(), len(df.columns)
        if command == "columns":
            return list(df.columns)
        if command == "dtypes":
            return dict(df.dtypes)
        if command in REDUCTIONS:
            return df.agg(*[reduction(command, c).alias(c) for c in by or numeric_columns(df)])
        raise ValueError(f"unknown command {command!r}")


#: Other names of commands.
ALIASES = {
    "sort_by": "sort_values", "sort": "sort_values", "limit": "head", "isna": "isnull", "notna": "notnull", "count_rows": "len", "T": "transpose", "copy": "identity", "preview": "identity",
    "aggregate": "agg", "groupby_agg": "groupby", "tolist": "to_list", "dedup": "drop_duplicates",
}


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
