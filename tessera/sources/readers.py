"""Sources and sinks: delimited text, JSON, Parquet, ORC and databases, by one loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Tab if the first line holds one, else comma, else semicolon; read by Spark, so that any store will do."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return next((s for s in "\t,;" if s in line), ",")


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None, separator: str | None = None, drop_index: bool = True) -> DataFrame:
    """A delimited file with a header. Unnamed first columns (written indices) are dropped."""
    reader = spark.read.option("header", True).option("sep", separator or sniff_separator(spark, path)).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if drop_index:
        df = df.drop(*[c for c in df.columns if c == "_c0" or c.startswith("Unnamed:")])
    return df


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns with joined names, to any depth."""
    def leaves(kind: T.StructType, path: tuple[str, ...]):
        for f in kind:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(df.schema, ())])


def read_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return flatten(spark.read.option("multiLine", multiline).json(path))


def from_records(spark: SparkSession, records: list[dict], schema: str | None = None) -> DataFrame:
    names = list(dict.fromkeys(k for r in records for k in r))
    if schema is None and records:
        return spark.createDataFrame([tuple(r.get(k) for k in names) for r in records], names)
    return spark.createDataFrame([tuple(r.get(k) for k in T._parse_datatype_string(schema).names) for r in records], schema)


def read_database(spark: SparkSession, url: str, table: str, partition: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A table by JDBC; filters and columns reach the database. With a numeric partition column, in parts."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        reader = reader.options(partitionColumn=partition, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: .csv, .tsv, .tab, .txt, .json, .jsonl, .orc, else Parquet."""
    name = path.lower().rstrip("/")
    if name.endswith((".tsv", ".tab")):
        return read_delimited(spark, path, separator="\t", **options)
    if name.endswith((".csv", ".txt")):
        return read_delimited(spark, path, **options)
    if name.endswith((".json", ".jsonl")):
        return read_json(spark, path, multiline=name.endswith(".json"))
    return spark.read.orc(path) if name.endswith(".orc") else spark.read.parquet(path)


def save(df: DataFrame, path: str, **options) -> None:
    """By suffix: .csv, .json, .orc, else Parquet."""
    writer, name = df.write.mode(options.pop("mode", "overwrite")).options(**options), path.lower().rstrip("/")
    if name.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif name.endswith(".json"):
        writer.json(path)
    elif name.endswith(".orc"):
        writer.orc(path)
    else:
        writer.parquet(path)


def page(df: DataFrame, where: str | None = None, fields: list[str] | None = None, sort: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filters, fields, sort, offset and limit of a paged query."""
    df = df.where(where) if where else df
    df = df.orderBy(*sort) if sort else df
    df = df.offset(offset) if offset else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*fields) if fields else df


def first(df: DataFrame, **query) -> dict | None:
    """One record of a paged query, or None."""
    rows = page(df, **(query | {"limit": 1})).collect()
    return rows[0].asDict(recursive=True) if rows else None


def pages(df: DataFrame, key: list[str], size: int = 1000):
    """Frames of up to `size` rows in the order of a unique key, each beginning after the last key of the one before: no offset is counted again."""
    last = None
    while True:
        rows = df
        if last is not None:
            after = F.struct(*[F.col(k) for k in key]) > F.struct(*[F.lit(last[k]).cast(df.schema[k].dataType).alias(k) for k in key])
            rows = df.where(after)
        part = rows.orderBy(*key).limit(size)
        ends = part.orderBy(*[F.desc(k) for k in key]).limit(1).select(*key).collect()
        if not ends:
            return
        yield part
        last = ends[0]


def records(df: DataFrame):
    """Rows one by one as dicts, a partition at a time."""
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)


def csv_text(df: DataFrame, order: list[str] | None = None, limit: int = 10_000) -> str:
    """The first `limit` rows as CSV text with a header, for results that are small; files are written by save()."""
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows([["" if v is None else v for v in r] for r in (df.orderBy(*order) if order else df).limit(limit).collect()])
    return out.getvalue()


def read_catalog(spark: SparkSession, path: str, field: str = "models") -> DataFrame:
    """Records of a JSON document that holds them in one list, with their place."""
    raw = spark.read.option("multiLine", True).json(path)
    each = raw.select(F.posexplode(field).alias("position", "r"))
    return each.select("position", "r.*")


def sequence_table(df: DataFrame, least: int = 1) -> tuple[DataFrame, str, list[str]]:
    """A table of sequences and activities: (df, its sequence column in any case, the columns of 0 and 1 alone); too few rows are an error."""
    name = next((c for c in df.columns if c.lower() in ("sequence", "seq")), None)
    if name is None:
        raise ValueError(f"no sequence column among {df.columns}")
    rest = [f.name for f in df.schema if f.name != name and isinstance(f.dataType, T.NumericType | T.BooleanType)]
    x = lambda c: F.col(f"`{c}`").cast("double")
    seen = df.agg(F.count("*").alias("_n"), *[F.coalesce(F.bool_and(x(c).isNull() | x(c).isin(0.0, 1.0)) & (F.count(c) > 0), F.lit(False)).alias(c) for c in rest]).first()
    if seen["_n"] < least:
        raise ValueError(f"{seen['_n']} rows; {least} are needed")
    return df, name, [c for c in rest if seen[c]]


#: The kinds of places where data can be, in the order of preference (fixed values).
BACKENDS = ("sqlite", "postgresql", "mysql", "rest")


def backend_of(settings: dict[str, str]) -> str:
    """The first kind of database that the settings name a place for, else rest."""
    return next((b for b in BACKENDS if settings.get(b)), "rest")


def resolve_path(path: str, prefix: str = "", base: str = "") -> str:
    """A path as it is if it names its store or is absolute, else below base and the session's prefix."""
    if "://" in path or path.startswith("/"):
        return path
    return "/".join(x.strip("/") if k else x.rstrip("/") for k, x in enumerate(p for p in (base, prefix, path) if p))


def retrieve(assays: DataFrame, targets: DataFrame, keyword: str, organism: str | None = None, pattern: str | None = None) -> DataFrame:
    """Assays whose description or target's name holds the keyword (or fits a pattern), of organisms that hold a text, with their targets' columns; present values win."""
    from tessera.functions.scalars import keyword_pattern
    from tessera.operators.align import existing_wins

    known = existing_wins(assays, targets, "target_id", {"target_name": "pref_name", "target_type": "type", "target_organism": "organism"})
    rx = "(?i)" + (pattern or keyword_pattern(keyword))
    hit = F.coalesce(F.col("description").rlike(rx), F.lit(False)) | F.coalesce(F.col("target_name").rlike(rx), F.lit(False))
    out = known.where(hit)
    return out.where(F.lower("target_organism").contains(organism.lower())) if organism else out


def activities_of(activities: DataFrame, assays: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Activities of the given assays (a semi-join in place of a list of ids), with the assays' columns beside them."""
    from tessera.operators.align import with_suffix

    own = assays.where(F.col("assay_type").isin(*kinds)) if kinds else assays
    return with_suffix(activities.join(own.select("assay_id"), "assay_id", "left_semi"), own, "assay_id")


#: Codes of assay types (fixed values).
ASSAY_TYPES = {"binding": "B", "functional": "F", "admet": "A"}


def assay_types(values: str | list[str] | None) -> list[str]:
    """Codes of assay types by name or code, each once, in order; unknown ones are an error."""
    out = []
    for v in [values] if isinstance(values, str) else values or []:
        text = str(v or "").strip()
        if not text:
            continue
        code = ASSAY_TYPES.get(text.lower(), text.upper())
        if code not in ASSAY_TYPES.values():
            raise ValueError(f"unknown assay type {text!r}; known: {sorted(ASSAY_TYPES)}")
        out.append(code)
    return list(dict.fromkeys(out))
