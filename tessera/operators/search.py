"""Relevance search over documents, retrieval by keyword, and comparison of runs."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import keyword_pattern
from tessera.operators.frame import running_sums, with_row_id
from tessera.plans.storage import materialize


#: What a term is worth that is the id, stands in it, in the title, or anywhere (fixed values).
IS_ID, IN_ID, IN_TITLE, ANYWHERE = 100, 30, 20, 5


def rank_documents(df: DataFrame, query: str, id_col: str, title: str, kind: str, others: list[str], limit: int | None = None, order: str | None = None) -> DataFrame:
    """(id, kind, title, score), best first, then by kind, title and id, so that a limit cuts alike however the rows lie.

    Each term of the query is worth most if it is the id, less if it stands in the id, in
    the title, or in id, title, kind or the other columns (summary and metadata). A query
    without terms ranks all: 100 less the position in `order` (the id), 1 at least.
    """
    import re

    text = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    hay = F.concat_ws(" ", *[text(c) for c in (id_col, title, *others, kind)])
    terms = re.findall(r"[a-z0-9_:+.-]+", query.lower())
    score = F.lit(0)
    for term in terms:
        score = score + F.when(text(id_col) == term, IS_ID).when(text(id_col).contains(term), IN_ID).when(text(title).contains(term), IN_TITLE).when(hay.contains(term), ANYWHERE).otherwise(0)
    if terms:
        out = df.withColumn("score", score)
    else:
        out = with_row_id(df, [order or id_col], "_at").withColumn("score", F.greatest(F.lit(1), 100 - F.col("_at")).cast("int"))
    out = out.where("score > 0").select(id_col, kind, title, "score").orderBy(F.desc("score"), F.asc(kind), F.asc(title), F.asc(id_col))
    return out if limit is None else out.limit(limit)


def keyword_rows(df: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """Rows that hold any keyword, with the sorted list of those found: one scan, no union of frames."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike("(?i)" + keyword_pattern(k)), k) for k in sorted(keywords)]))
    return df.withColumn("keywords", F.array_join(found, "|")).where(F.size(found) > 0)


def jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jaccard similarity of two frames' sets of keys."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return both.agg((F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*")).alias("jaccard"))


def ks_statistic(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic: counts by distinct value are put in order by ranges."""
    by = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    upto = materialize(running_sums(by, [value], {"ua": "a", "ub": "b"}), "ks")
    whole = upto.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.try_divide(F.col("ua"), F.col("na").cast("double")) - F.try_divide(F.col("ub"), F.col("nb").cast("double")))
    return upto.join(F.broadcast(whole)).agg(F.max(gap).alias("ks"))


def stability(df: DataFrame, run: str, values: list[str]) -> DataFrame:
    """Mean absolute deviation of the runs' means over their mean, by column."""
    means = df.groupBy(run).agg(*[F.avg(v).alias(v) for v in values]).unpivot([run], values, "column", "mean")
    whole = F.avg("mean").over(Window.partitionBy("column"))
    return means.select("column", F.abs(F.col("mean") - whole).alias("d"), whole.alias("m")).groupBy("column").agg((F.avg("d") / F.abs(F.max("m"))).alias("instability"))




def short_keywords_only(keywords, least: int = 5):
    """Whether every keyword of a pipe-joined text is shorter than `least` letters; false without any."""
    own = F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), r"\|"), lambda k: F.trim(k)), lambda k: k != "")
    return (F.size(own) > 0) & F.forall(own, lambda k: F.length(k) < least)


def judge_items(df: DataFrame, keys: list[str], samples: dict[str, tuple[str, int]], order: str) -> DataFrame:
    """One row for each item to judge: its rows, and for each sample the first distinct values of a column in order, joined by pipes.

    Values meet with their first place alone before they are put in order; an item's distinct values are cut to the sample.
    """
    out = df.groupBy(*keys).agg(F.count("*").alias("row_count"))
    for name, (column, n) in samples.items():
        first = df.where(F.col(column).isNotNull() & (F.trim(F.col(column)) != "")).groupBy(*keys, column).agg(F.min(order).alias("_o"))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", column))
        few = first.withColumn("_r", rank).where(F.col("_r") <= n)
        values = F.transform(F.array_sort(F.collect_list(F.struct("_r", column))), lambda s: s[column])  # noqa: B023
        out = out.join(few.groupBy(*keys).agg(F.array_join(values, "|").alias(name)), keys, "left")
    return out


def judged(df: DataFrame, decisions: DataFrame, keys: list[str], reject: str = "reject", reason: str = "reason") -> DataFrame:
    """All rows with the decision on their item (retained without one) and its reason; both outputs are filters of it. One decision an item."""
    out = df.join(decisions.select(*keys, reject, reason), keys, "left")
    return out.withColumn("decision", F.when(F.coalesce(F.col(reject), F.lit(False)), "rejected").otherwise("retained")).drop(reject)


def chunk_totals(df: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks and characters of each stream of text, on a batch or a stream of rows."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("n_chars"))


def extracted(c, kind: str):
    """Names (capitalized words), numbers or structures (runs of a line notation with a bond or ring mark) of a text, as an array."""
    patterns = {"names": r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b", "numbers": r"(-?\d+(?:\.\d+)?)", "structures": r"(?<!\S)([A-Za-z0-9@+\-\[\]()=#/\\]*[=#()\[\]][A-Za-z0-9@+\-\[\]()=#/\\]*)(?!\S)"}
    return F.regexp_extract_all(c, F.lit(patterns[kind]), F.lit(1))


def numeric_consistency(df: DataFrame, group: str, text: str) -> DataFrame:
    """One row: the mean over positions of max(0, 1 - std / |mean|) of the numbers that texts of all groups have there; 1 without any."""
    each = df.select(group, F.posexplode(extracted(F.col(text), "numbers")).alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    by = each.groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).where("n > 1")
    one = F.when(F.col("m") == 0, (F.col("s") == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.col("s") / F.abs("m")))
    return by.agg(F.coalesce(F.avg(one), F.lit(1.0)).alias("consistency"))
