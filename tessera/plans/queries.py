"""The library's queries over the test tables, each with the SQL that gives the same rows.

Floats are rounded on both sides. Every key is one entry of QUERIES and, where SQL can
express it, of ORACLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import labels, scalars
from tessera.operators import activity, align, curation, ensemble, evaluation, frame, landscape, metrics, models, outliers, search, similarity, splits
from tessera.plans.storage import shared_folder
from tessera.sources import readers
from tessera.streaming import windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# Curation


@query(f"""SELECT l_partkey, l_suppkey, round(q, 6) AS l_quantity, l_orderkey, l_linenumber, n AS n_rows FROM (
  SELECT *, avg(l_quantity) OVER w AS q, max(l_quantity) OVER w - min(l_quantity) OVER w AS s, count(*) OVER w AS n,
         row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {", ".join(LINE)}) AS r
  FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey)) WHERE r = 1 AND s <= 10""")
def curate_regression_dups(spark, sf):
    df = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber")
    out = curation.resolve_regression_duplicates(df, ["l_partkey", "l_suppkey"], ["l_quantity"], 10.0, ["l_orderkey", "l_linenumber"])
    return rounded(out, ["l_quantity"])


@query("""SELECT arg_min(doc_id, doc_id) AS doc_id, min(quality) AS quality, count(*) AS n_rows FROM documents JOIN labels USING (doc_id) GROUP BY text HAVING min(quality) = max(quality)""")
def curate_label_dups(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return curation.resolve_label_duplicates(df, ["text"], "quality", ["doc_id"]).select("doc_id", "quality", "n_rows")


@query("""SELECT l_partkey, l_suppkey, count(*) AS n_rows, min(l_quantity) AS low, max(l_quantity) AS high,
  CASE WHEN max(l_quantity) - min(l_quantity) > 10 THEN 'removed' ELSE 'aggregated' END AS action FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dup_audit(spark, sf):
    return curation.duplicate_audit(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity", 10.0)


@query("""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN q USING (o_orderpriority)
WHERE n >= 4 AND b > a AND (o_totalprice < a - 0.4 * (b - a) OR o_totalprice > b + 0.4 * (b - a))""")
def iqr_flags(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(curation.iqr_flags(df, "o_totalprice", 0.4, ["o_orderpriority"]).drop("low_bound", "high_bound"), ["o_totalprice"], 2)


@query("""SELECT p_brand, string_agg(DISTINCT u, '|' ORDER BY u) AS units, count(DISTINCT u) AS n_units, count(DISTINCT u) <= 1 AS homogeneous
FROM (SELECT p_brand, lower(replace(trim(p_type), ' ', '')) AS u FROM part) GROUP BY 1""")
def unit_homogeneity(spark, sf):
    return curation.unit_quality(table(spark, sf, "part").select("p_brand", "p_type"), "p_type", ["p_brand"])


@query("""SELECT o_custkey, round(median(o_totalprice), 7) AS activity_final, round(avg(o_totalprice), 7) AS activity_mean, round(min(o_totalprice), 7) AS activity_min, round(max(o_totalprice), 7) AS activity_max,
  round(stddev_samp(o_totalprice), 3) AS activity_std, count(o_totalprice) AS n_activity,
  (SELECT string_agg(s, '|' ORDER BY k) FROM (SELECT o_orderstatus AS s, min(o_orderkey) AS k FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1)) AS o_orderstatuss
FROM orders o GROUP BY o_custkey""")
def compound_merge(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderkey")
    out = curation.merge_compounds(df, "o_custkey", "o_totalprice", ["o_orderstatus"], "o_orderkey")
    return rounded(out, ["activity_final", "activity_mean", "activity_min", "activity_max"], 7).withColumn("activity_std", F.round("activity_std", 3))


@query("""WITH l AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'active' ELSE 'inactive' END AS l FROM events), c AS (SELECT user_id, l, count(*) AS c FROM l GROUP BY ALL)
SELECT user_id, arg_min(l, struct_pack(a := -c, b := l)) AS majority, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (l = 'active'), 0)::BIGINT AS n_active, coalesce(sum(c) FILTER (l = 'inactive'), 0)::BIGINT AS n_inactive,
  round(coalesce(sum(c) FILTER (l = 'active'), 0) / sum(c), 6) AS active_fraction, string_agg(l || ':' || c, '|' ORDER BY c DESC, l) AS label_counts FROM c GROUP BY 1""")
def compound_labels(spark, sf):
    label = F.when(F.col("event_type").isin("purchase", "click"), "Hit").otherwise(" not active ")
    df = table(spark, sf, "events").select("user_id", scalars.parse_label(label).alias("label"))
    return rounded(curation.merge_labels(df, "user_id", "label"), ["active_fraction"])


# Generic frame commands


@query("""SELECT 'c_acctbal' AS "column", count(c_acctbal) AS count, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS min,
  round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS q50, round(quantile_cont(c_acctbal, 0.75), 4) AS q75, max(c_acctbal) AS max FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), round(avg(c_nationkey), 4), round(stddev_samp(c_nationkey), 4), min(c_nationkey)::DOUBLE,
  round(quantile_cont(c_nationkey, 0.25), 4), round(quantile_cont(c_nationkey, 0.5), 4), round(quantile_cont(c_nationkey, 0.75), 4), max(c_nationkey)::DOUBLE FROM customer""")
def describe_numeric(spark, sf):
    return rounded(frame.describe(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]), ["mean", "std", "q25", "q50", "q75"], 4)


@query("""SELECT p_brand, count(*) AS count FROM part GROUP BY 1""")
def value_counts(spark, sf):
    return frame.value_counts(table(spark, sf, "part"), "p_brand")


@query("""SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1""")
def unique_first_seen(spark, sf):
    return frame.unique(table(spark, sf, "events"), "event_type", "event_id")


@query("""SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice, count(DISTINCT o_custkey) AS o_custkey FROM orders GROUP BY ALL""")
def group_aggregate(spark, sf):
    out = frame.group_aggregate(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], {"o_totalprice": "mean", "o_custkey": "nunique"})
    return rounded(out, ["o_totalprice"], 4)


@query("""SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def drop_duplicates_first(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return rounded(frame.stable_first(df, ["user_id", "event_type"], ["event_id"]), ["value"])


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND NOT p_size = 20""")
def query_expression(spark, sf):
    return frame.query(table(spark, sf, "part"), "`p_size` >= 10 and p_brand in [\"Brand#11\", 'Brand#12', 'Brand#13'] and not p_size == 20").select("p_partkey", "p_name", "p_size")


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey, c_name FROM customer""")
def row_ids(spark, sf):
    return frame.with_row_id(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select("row_id", "c_custkey", "c_name")


@query("""SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 5""")
def paged_query(spark, sf):
    out = readers.page(table(spark, sf, "supplier"), "s_acctbal > 0", ["s_suppkey", "s_name", "s_acctbal"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 20, 5)
    return rounded(out, ["s_acctbal"], 2)


@query("""SELECT event_id, (nullif(value, 0) IS NULL) AS value, (CASE WHEN event_type = 'view' THEN NULL ELSE event_type END IS NULL) AS event_type FROM events""")
def null_flags(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.nullif("value", F.lit(0.0)).alias("value"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))
    flags = frame.isnull(df, ["value", "event_type"], keep=["event_id"])
    return flags


@query("""SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance, NULL::VARCHAR AS note FROM customer UNION ALL SELECT s_suppkey, s_name, round(s_acctbal, 2), 'supplier' FROM supplier""")
def concat_frames(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    b = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance", "'supplier' AS note")
    return rounded(frame.concat([a, b]), ["balance"], 2)


@query("""SELECT p_partkey, 'p_retailprice' AS "measure", round(p_retailprice, 2) AS value FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::DOUBLE FROM part""")
def unpivot_measures(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return rounded(df.unpivot(["p_partkey"], ["p_retailprice", "p_size"], "measure", "value"), ["value"], 2)


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS "F", round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS "O" FROM lineitem GROUP BY 1""")
def pivot_status(spark, sf):
    return rounded(evaluation.pivoted(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.sum("l_quantity")), ["F", "O"], 2)


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_orders(spark, sf):
    return rounded(table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), ["mean"], 4)


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").exceptAll(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


# Joins and retrieval


@query("""SELECT o_orderkey, c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), 'unknown') AS segment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'""")
def left_enrichment(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    own = align.with_suffix(orders, table(spark, sf, "customer"), "c_custkey")
    out = align.with_suffix(own.withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, sf, "nation"), "n_nationkey")
    return out.select("o_orderkey", "c_name", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("unknown")).alias("segment"), "n_name")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_size > 45 AND l_quantity > 40)""")
def semi_join(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_quantity > 40").join(table(spark, sf, "part").where("p_size > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)""")
def anti_join(spark, sf):
    orders = table(spark, sf, "orders").where("o_totalprice > 100000")
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size, coalesce(p_size > 25, false) AS flag, CASE WHEN p_size > 25 THEN 'large' ELSE 'none' END AS tier
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey WHERE l_quantity = 50""")
def annotation_join(spark, sf):
    part = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", (F.col("p_size") > 25).alias("flag"), F.when(F.col("p_size") > 25, "large").otherwise("none").alias("tier"))
    lines = table(spark, sf, "lineitem").where("l_quantity = 50").select("l_orderkey", "l_linenumber", "l_partkey")
    out = outliers.attach_annotations(lines, part, "l_partkey", "flag", "tier", ["p_brand", "p_size"])
    return align.with_suffix(out, part.drop("flag", "tier"), "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_size", "flag", "tier")


@query("""SELECT doc_id, keywords FROM (SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(text, '(?i)Apache[- ]?2') THEN 'Apache2' END, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' END,
  CASE WHEN regexp_matches(text, '(?i)password') THEN 'password' END) AS keywords FROM documents) WHERE keywords <> ''""")
def keyword_retrieval(spark, sf):
    return search.keyword_rows(table(spark, sf, "documents").select("doc_id", "text"), "text", ["password", "license", "Apache2"]).select("doc_id", "keywords")


@query("""SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs, count(*) AS n FROM documents GROUP BY 1""")
def keyword_aggregate(spark, sf):
    return curation.joined_distinct(table(spark, sf, "documents"), ["source"], "lang", "langs")


@query("""SELECT part.p_partkey, p_brand, n_lines, round(mean_price, 7) AS mean_price FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines, avg(l_extendedprice) AS mean_price FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def feature_join(spark, sf):
    features = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_lines"), F.avg("l_extendedprice").alias("mean_price"))
    out = align.side_by_side(table(spark, sf, "part").select("p_partkey", "p_brand"), [features], "p_partkey")
    return rounded(out, ["mean_price"], 7)


# Activity


# nanomolar goes by the first known unit that a text holds: the micro sign is not the Greek letter, and both 'µm' and 'm m' hold an m
@query("""SELECT event_id, round(CASE WHEN value > 0 AND f IS NOT NULL THEN -log10(value * f) END, 6) AS p_value, round(value * g, 3) AS nanomolar
FROM (SELECT *, CASE event_type WHEN 'click' THEN 1e-9 WHEN 'view' THEN 1e-6 WHEN 'purchase' THEN 1e-3 END AS f, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 1e9 WHEN 'purchase' THEN 1e9 END AS g FROM events)""")
def activity_scale(spark, sf):
    unit = F.when(F.col("event_type") == "click", " nM").when(F.col("event_type") == "view", "µM").when(F.col("event_type") == "purchase", "m M").otherwise("%")
    df = table(spark, sf, "events")
    return df.select("event_id", F.round(scalars.p_scale(F.col("value"), unit), 6).alias("p_value"), F.round(scalars.to_nanomolar(F.col("value"), unit), 3).alias("nanomolar"))


THRESHOLDS = (20.0, 4.0, 1.0)
_THRESHOLD_SQL = """t AS (SELECT * FROM (VALUES (0, 20.0::DOUBLE), (1, 4.0), (2, 1.0)) t(k, t)),
c AS (SELECT l_suppkey, t.k, t.t AS threshold, count(*) FILTER (v < t.t) AS n_active, count(*) FILTER (v >= 10 * t.t) AS n_inactive FROM v, t GROUP BY ALL),
b AS (SELECT l_suppkey, threshold, n_active, n_active + n_inactive AS n FROM c WHERE n_active + n_inactive > 100 AND n_active >= 20 AND 2 * n_inactive > n_active + n_inactive
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(n_active / (n_active + n_inactive) - 0.25), k) = 1)"""


def _doses(spark, sf):
    """Lines as measurements: the price over the quantity squared in nM or, for every third line, uM; every seventh one is an inhibition."""
    value = F.col("l_quantity") * (1 + F.pmod("l_partkey", F.lit(7)))
    kind = F.when(F.pmod("l_orderkey", F.lit(7)) == 0, "% Inhibition").when(F.pmod("l_orderkey", F.lit(7)) == 1, "Solubility").otherwise("IC50")
    micro = F.pmod("l_linenumber", F.lit(3)) == 0
    return table(spark, sf, "lineitem").select(
        "l_suppkey", "l_partkey", kind.alias("standard_type"), F.when(micro, value / 1000).otherwise(value).cast("string").alias("standard_value"), F.when(micro, "uM").otherwise("nM").alias("standard_units")
    )


_DOSES_SQL = """d AS (SELECT l_suppkey, l_partkey, l_orderkey % 7 AS kind, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * (1 + l_partkey % 7) / 1000 * 1000 ELSE l_quantity * (1 + l_partkey % 7) END AS v,
  CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * (1 + l_partkey % 7) / 1000 ELSE l_quantity * (1 + l_partkey % 7) END AS x FROM lineitem), v AS (SELECT * FROM d WHERE kind >= 2)"""


@query(f"WITH {_DOSES_SQL}, {_THRESHOLD_SQL} SELECT l_suppkey, threshold, n_active, n FROM b")
def activity_thresholds(spark, sf):
    rows = _doses(spark, sf).where("standard_type = 'IC50'").withColumn("v", scalars.to_nanomolar(F.col("standard_value").try_cast("double"), F.col("standard_units")))
    return activity.choose_thresholds(rows, "l_suppkey", "v", THRESHOLDS)


_LABELS_SQL = f"""{_DOSES_SQL}, {_THRESHOLD_SQL}, l AS (SELECT l_partkey, CASE WHEN kind = 0 THEN CASE WHEN x <= 50 THEN 'inactive' ELSE 'active' END WHEN kind >= 2 AND v < threshold THEN 'active' WHEN kind >= 2 AND v >= 10 * threshold THEN 'inactive' END AS l
  FROM d LEFT JOIN b USING (l_suppkey))"""


@query(f"WITH {_LABELS_SQL} SELECT l_partkey, min(l) AS label, count(*) AS n_rows FROM l WHERE l IS NOT NULL GROUP BY 1 HAVING min(l) = max(l)")
def activity_labels(spark, sf):
    rows = activity.label_rows(_doses(spark, sf), "l_suppkey", thresholds=THRESHOLDS)
    return activity.settle(rows, "l_partkey")


# Metrics


def _predicted(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE, F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"), F.pmod("l_orderkey", F.lit(5)).alias("fold"), "l_returnflag", "l_quantity", "l_discount")


_PRED_SQL = "(SELECT *, l_extendedprice AS y, l_quantity * 1000 AS p, l_orderkey % 5 AS fold FROM lineitem)"
_METRICS = "count(*) AS n, round(avg((y - p) * (y - p)), 0) AS mse, round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(sum(abs(y - p)) / sum(abs(y - mean)), 6) AS rae"


def _metric_rounds(df):
    return rounded(rounded(rounded(df, ["mse"], 0), ["mae", "rmse"], 3), ["r2", "rae"])


@query(f"SELECT {_METRICS} FROM (SELECT *, avg(y) OVER () AS mean FROM {_PRED_SQL})")
def regression_metrics(spark, sf):
    return _metric_rounds(metrics.regression(_predicted(spark, sf), "y", "p"))


@query(f"SELECT l_returnflag, {_METRICS} FROM (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS mean FROM {_PRED_SQL}) GROUP BY 1")
def regression_metrics_grouped(spark, sf):
    return _metric_rounds(metrics.regression(_predicted(spark, sf), "y", "p", ["l_returnflag"]))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM r""")
def spearman(spark, sf):
    return rounded(metrics.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), ["spearman"])


@query("""WITH p AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS c FROM lineitem GROUP BY ALL), s AS (
  SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.c * b.c) AS s FROM p a JOIN p b ON a.x < b.x), n AS (SELECT sum(c) AS n FROM p),
tx AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT sum(c) AS c FROM p GROUP BY x)), ty AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT sum(c) AS c FROM p GROUP BY y))
SELECT round(s / sqrt((n * (n - 1) / 2.0 - tx.t) * (n * (n - 1) / 2.0 - ty.t)), 6) AS kendall, n::BIGINT AS n FROM s, n, tx, ty""")
def kendall(spark, sf):
    return rounded(metrics.kendall(table(spark, sf, "lineitem"), "l_quantity", "l_discount"), ["kendall"])


_CLASSES_SQL = "(SELECT quality AS t, (length(text) > 600)::INT AS p FROM documents JOIN labels USING (doc_id))"


def _classes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("t"), (F.col("n") > 600).cast("int").alias("p"), F.col("n").alias("score"))


@query(f"SELECT t, p, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY t), 6) AS share FROM {_CLASSES_SQL} GROUP BY t, p")
def confusion_matrix(spark, sf):
    return rounded(metrics.confusion(_classes(spark, sf), "t", "p"), ["share"])


@query(f"""WITH c AS {_CLASSES_SQL}, l AS (SELECT k, (SELECT count(*) FROM c WHERE t = k) AS a, (SELECT count(*) FROM c WHERE p = k) AS s, (SELECT count(*) FROM c WHERE t = k AND p = k) AS h FROM (SELECT t AS k FROM c UNION SELECT p FROM c)),
m AS (SELECT *, CASE WHEN s > 0 THEN h / s ELSE 0 END AS pr, CASE WHEN a > 0 THEN h / a ELSE 0 END AS re FROM l)
SELECT sum(a)::BIGINT AS n, round(sum(h) / sum(a), 6) AS accuracy, round(avg(re), 6) AS balanced_accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall,
  round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 6) AS macro_f1 FROM m""")
def classification_metrics(spark, sf):
    return rounded(metrics.classification(_classes(spark, sf), "t", "p"), ["accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1"])


@query("""WITH d AS (SELECT quality AS t, length(text) AS score FROM documents JOIN labels USING (doc_id)), r AS (SELECT t, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM d),
s AS (SELECT sum(r) FILTER (t = 1) AS u, count(*) FILTER (t = 1) AS positives, count(*) FILTER (t <> 1) AS negatives FROM r)
SELECT round((u - positives * (positives + 1) / 2.0) / (positives * negatives), 6) AS roc_auc, positives, negatives FROM s""")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(_classes(spark, sf), "t", "score"), ["roc_auc"])


@query(f"""SELECT coalesce(l_returnflag, 'all') AS status, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS coverage
FROM {_PRED_SQL} GROUP BY GROUPING SETS ((), (l_returnflag))""")
def metrics_by_status(spark, sf):
    return rounded(rounded(metrics.by_status(_predicted(spark, sf), "l_returnflag", "y", "p"), ["rmse", "mae"], 3), ["coverage"])


@query(f"""WITH f AS (SELECT fold, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM {_PRED_SQL} GROUP BY 1),
u AS (UNPIVOT f ON rmse, mae, r2 INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std, round(min(value), 3) AS low, round(max(value), 3) AS high, count(*) AS folds FROM u GROUP BY 1""")
def cross_validation(spark, sf):
    return rounded(metrics.cross_validation(_predicted(spark, sf), "fold", "y", "p"), ["mean", "std", "low", "high"], 3)


@query(f"""SELECT {", ".join(LINE)}, fold, round(fold_rmse, 3) AS fold_rmse, round(100 * abs((y - p) / y), 4) AS ape FROM (SELECT *, sqrt(avg((y - p) * (y - p)) OVER (PARTITION BY fold)) AS fold_rmse FROM {_PRED_SQL}) WHERE abs(y - p) > 2 * fold_rmse""")
def fold_outliers(spark, sf):
    out = outliers.with_fold_rmse(_predicted(spark, sf), "fold", "y", "p").where("abs_error > 2 * fold_rmse")
    return rounded(rounded(out, ["fold_rmse"], 3), ["ape"], 4).select(*LINE, "fold", "fold_rmse", "ape")


@query(f"""WITH e AS (SELECT *, 100 * abs((y - p) / y) AS ape FROM (SELECT *, sqrt(avg((y - p) * (y - p)) OVER (PARTITION BY fold)) AS r FROM {_PRED_SQL}) WHERE abs(y - p) > 2 * r AND (l_returnflag = 'R' OR l_discount > 0.05))
SELECT {", ".join(LINE)}, round(ape, 4) AS ape, row_number() OVER w AS ape_rank FROM e WINDOW w AS (ORDER BY ape DESC, {", ".join(LINE)}) QUALIFY row_number() OVER w <= ceil((SELECT count(*) FROM e) * 0.25)""")
def outlier_selection(spark, sf):
    rows = _predicted(spark, sf).withColumns({"cliff": F.col("l_returnflag") == "R", "out_of_domain": F.col("l_discount") > 0.05})
    out = outliers.select_regression(rows, "fold", "y", "p", LINE, flags=["cliff", "out_of_domain"]).where("selected")
    return rounded(out, ["ape"], 4).select(*LINE, "ape", "ape_rank")


@query("""SELECT event_id, round(value, 6) AS value FROM events WHERE abs(value - (SELECT avg(value) FROM events)) > 1.5 * (SELECT stddev_pop(value) FROM events)""")
def zscore_outliers(spark, sf):
    return rounded(outliers.zscore_outliers(table(spark, sf, "events").select("event_id", "value"), "value", 1.5), ["value"])


# Ensembles and catalogs


@query("""WITH c AS (SELECT p_partkey, unnest([p_retailprice, p_size * 30.0, (p_partkey % 97) * 10.0]) AS v FROM part)
SELECT p_partkey, round(median(v), 4) AS median, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS low, round(max(v), 4) AS high FROM c GROUP BY 1""")
def ensemble_regression(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_size") * 30.0).alias("b"), ((F.col("p_partkey") % 97) * 10.0).alias("c"))
    return rounded(ensemble.regression(df, "p_partkey", ["a", "b", "c"]), ["median", "mean", "std", "low", "high"], 4)


@query("""WITH v AS (SELECT p_partkey, unnest([p_partkey % 3, p_size % 3, (p_partkey // 7) % 3])::BIGINT AS label FROM part), c AS (SELECT p_partkey, label, count(*) AS n FROM v GROUP BY ALL)
SELECT p_partkey, label, round(n / 3, 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, label) = 1""")
def ensemble_vote(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("a"), (F.col("p_size") % 3).cast("long").alias("b"), (F.floor(F.col("p_partkey") / 7) % 3).cast("long").alias("c"))
    return rounded(ensemble.vote(df, "p_partkey", ["a", "b", "c"]), ["share"])


@query("""SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal, row_number() OVER (ORDER BY nullif(s_nationkey, 3) DESC NULLS LAST, s_acctbal NULLS LAST, s_suppkey)::INT AS rank FROM supplier""")
def bench_rank(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.nullif("s_nationkey", F.lit(3)).alias("k"))
    return rounded(ensemble.rank_models(df, ["k"], ["s_acctbal"], "s_suppkey").drop("k"), ["s_acctbal"], 2)


@query("""SELECT s_nationkey, s_suppkey, round(s_acctbal, 2) AS s_acctbal FROM (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) ORDER BY s_acctbal DESC, s_suppkey LIMIT 5""")
def component_select(spark, sf):
    return rounded(ensemble.best_of_each(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey", 5), ["s_acctbal"], 2)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier""")
def catalog_upsert(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return ensemble.upsert(df, df.where("s_suppkey % 3 = 0").withColumn("s_name", F.lit("new")), "s_suppkey")


# Vectors


_PAIRS_SQL = """p AS (SELECT q.vec_id AS i, c.vec_id AS j, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS sim, q.label AS yi, c.label AS yj FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM p)"""


def _neighbours(spark, sf, k=5):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return similarity.neighbours(df, "vec_id", "embedding", k)


@query(f"""WITH {_PAIRS_SQL} SELECT i AS vec_id, round(avg(sim), 6) AS support, arg_min(j, rank) AS nearest FROM k WHERE rank <= 5 GROUP BY i""")
def knn_support(spark, sf):
    return rounded(similarity.support(_neighbours(spark, sf)), ["support"]).withColumnRenamed("i", "vec_id")


_CLIFF_PAIRS_SQL = """p AS (SELECT q.vec_id AS i, c.vec_id AS j, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS sim, abs(q.label - c.label)::DOUBLE AS gap FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id),
s AS (SELECT *, gap / greatest(1 - sim, 1e-6) AS sali, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM p WHERE sim >= 0.2 AND NOT (sim >= 1 AND gap <= 0)),
n AS (SELECT CASE WHEN quantile_cont(sali, 0.95) > 0 THEN quantile_cont(sali, 0.95) ELSE 1 END AS p95, count(*) AS n_pairs FROM s)"""
_SALI_SQL = f"""{_CLIFF_PAIRS_SQL}, m AS (SELECT i, count(*) AS n, max(sim) AS ms, max(gap) AS mg, max(sali) AS r FROM s WHERE rank <= 5 GROUP BY i),
f AS (SELECT vec_id, coalesce(m.n, 0) AS n_neighbours, coalesce(ms, 0) AS max_similarity, coalesce(mg, 0) AS max_gap, coalesce(r, 0) AS raw, least(coalesce(r, 0) / p95, 1) AS norm FROM embeddings LEFT JOIN m ON vec_id = i, n),
g AS (SELECT *, round(norm, 6) AS score, norm >= 0.3 AND n_neighbours >= 1 AS flagged FROM f)"""


def _cliffs(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return similarity.cliff_index("SALI")(df, "vec_id", "embedding", "label", 0.2, k=5, flag=0.3, measure="dot")


@query(f"WITH {_SALI_SQL} SELECT vec_id, n_neighbours, round(max_similarity, 6) AS max_similarity, max_gap, round(raw, 5) AS raw, score AS norm, flagged FROM g")
def sali(spark, sf):
    return rounded(rounded(_cliffs(spark, sf), ["max_similarity", "norm"]), ["raw"], 5)


@query(f"""WITH {_SALI_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY flagged ORDER BY score DESC, vec_id) AS r, count(*) OVER (PARTITION BY flagged) AS k FROM g),
u AS (SELECT *, CASE WHEN NOT flagged THEN 'none' WHEN r <= greatest(1, ceil(0.2 * k)) THEN 'high' WHEN r <= greatest(1, ceil(0.2 * k), ceil(0.4 * k)) THEN 'medium' ELSE 'low' END AS tier FROM t),
w AS (SELECT *, concat_ws('|', CASE WHEN flagged THEN 'HIGH_ACTIVITY_DISCONTINUITY' END, CASE WHEN score >= 0.8 THEN 'HIGH_NORMALIZED_INDEX_SCORE' END, CASE WHEN n_neighbours >= 3 THEN 'MULTIPLE_SIMILAR_NEIGHBORS' END) AS codes FROM u)
SELECT vec_id, score AS norm, flagged, tier, CASE WHEN codes = '' THEN 'NOT_FLAGGED' ELSE codes END AS reason_codes FROM w""")
def sali_tiers(spark, sf):
    scored = rounded(_cliffs(spark, sf), ["norm"])
    return similarity.reasons(similarity.tiers(scored, "norm", "flagged", "vec_id")).select("vec_id", "norm", "flagged", "tier", "reason_codes")


@query(f"""WITH {_PAIRS_SQL} SELECT i, j, round(sim, 6) AS sim FROM p WHERE sim >= 0.3""")
def similarity_self_join(spark, sf):
    return rounded(similarity.similar_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.3, "dot"), ["sim"])


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), b AS (SELECT d, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM e WHERE vec_id % 4 <> 0 GROUP BY d)
SELECT vec_id, count(*) FILTER (x < low OR x > high) AS violations, round(max(greatest(low - x, x - high, 0) / greatest(high - low, 1)), 6) AS worst,
  CASE WHEN count(*) FILTER (x < low OR x > high) > 0 THEN 'out_of_domain' ELSE 'in_domain' END AS status, coalesce(string_agg(d - 1, ';' ORDER BY d) FILTER (x < low OR x > high), '') AS violating FROM e JOIN b USING (d) WHERE vec_id % 4 = 0 GROUP BY vec_id""")
def bounding_box(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    box = similarity.fit_box(df.where("vec_id % 4 <> 0"), "embedding")
    return rounded(similarity.score_box(df.where("vec_id % 4 = 0"), "vec_id", "embedding", box), ["worst"])


@query(f"""WITH {_PAIRS_SQL}, h AS (SELECT q.vec_id AS i, c.vec_id AS j, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.embedding[1:32], c.embedding[1:32]), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) DESC, c.vec_id) AS r
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id)
SELECT k.i AS vec_id, count(*) AS kept FROM k JOIN h ON k.i = h.i AND k.j = h.j WHERE rank <= 5 AND r <= 5 GROUP BY 1""")
def nn_overlap(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    return similarity.preserved(_neighbours(spark, sf), similarity.neighbours(df, "vec_id", "embedding", 5)).withColumnRenamed("i", "vec_id")


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_metrics(spark, sf):
    df = table(spark, sf, "embeddings")
    other = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    out = df.select("vec_id", F.col("embedding").alias("a")).join(other, "vec_id")
    return out.select("vec_id", F.round(scalars.cosine(F.col("a"), F.col("b")), 6).alias("cosine"), F.round(scalars.euclidean(F.col("a"), F.col("b")), 6).alias("euclidean"))


# Landscapes


_GRID_SQL = "g AS (SELECT vec_id, label, embedding[1] AS x, greatest(0, least(9, floor((embedding[1]::DOUBLE + 0.5) / 1.0 * 10)))::INT AS gx, greatest(0, least(9, floor((embedding[2]::DOUBLE + 0.5) / 1.0 * 10)))::INT AS gy FROM embeddings)"


def _grid(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return landscape.nodes(df, "x", "y", 10, -0.5, 0.5)


@query(f"WITH {_GRID_SQL} SELECT gx, gy, count(*) AS density, round(avg(label), 6) AS mean_activity FROM g GROUP BY 1, 2")
def landscape_mean(spark, sf):
    return rounded(landscape.mean_activity(_grid(spark, sf), "label"), ["mean_activity"])


@query(f"WITH {_GRID_SQL} SELECT gx, gy, count(*) AS density, round(avg((label = 1)::INT), 6) AS share FROM g GROUP BY 1, 2")
def landscape_class(spark, sf):
    return rounded(landscape.class_share(_grid(spark, sf), "label"), ["share"])


@query(f"""WITH {_GRID_SQL}, c AS (SELECT x::INT AS gx, y::INT AS gy FROM range(10) a(x), range(10) b(y)), d AS (SELECT gx, gy, coalesce(n, 0)::DOUBLE AS h FROM c LEFT JOIN (SELECT gx, gy, count(*) AS n FROM g GROUP BY 1, 2) USING (gx, gy))
SELECT round(avg(r) * 100, 6) AS ruggedness FROM (SELECT sqrt(sum((a.h - b.h) ** 2)) AS r FROM d a JOIN d b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY a.gx, a.gy)""")
def landscape_ruggedness(spark, sf):
    return rounded(landscape.ruggedness(landscape.density(_grid(spark, sf)), "density", 10), ["ruggedness"])


@query(f"WITH {_GRID_SQL}, d AS (SELECT count(*) AS n FROM g GROUP BY gx, gy) SELECT round(-sum((n / t) * ln(n / t)) / ln(100), 6) AS entropy FROM d, (SELECT sum(n) AS t FROM d)")
def landscape_entropy(spark, sf):
    return rounded(landscape.entropy(landscape.density(_grid(spark, sf)), 100), ["entropy"])


@query(f"WITH {_GRID_SQL} SELECT gx, gy, count(*) AS density FROM g GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY density DESC, gx, gy LIMIT 5")
def top_nodes(spark, sf):
    return landscape.top_nodes(landscape.density(_grid(spark, sf)), "density", 5, 3)


@query(f"WITH {_GRID_SQL}, t AS (SELECT gx, gy FROM g GROUP BY 1, 2 ORDER BY count(*) DESC, gx, gy LIMIT 3) SELECT vec_id, gx, gy FROM g SEMI JOIN t USING (gx, gy)")
def node_members(spark, sf):
    grid = _grid(spark, sf)
    return landscape.members(grid, landscape.top_nodes(landscape.density(grid), "density", 3)).select("vec_id", "gx", "gy")


# Ordered analytics


_DAYS_SQL = "d AS (SELECT event_type, ts::DATE AS day, round(sum(value), 6) AS total FROM events GROUP BY 1, 2)"


def _days(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("total"))


@query(f"""WITH {_DAYS_SQL} SELECT event_type, day, total, max(total) OVER w AS best, round(avg(total) OVER w, 7) AS running_mean, round(total - lag(total) OVER (PARTITION BY event_type ORDER BY day), 4) AS change,
  CASE WHEN total - lag(total) OVER (PARTITION BY event_type ORDER BY day) > 0.05 THEN 'up' WHEN total - lag(total) OVER (PARTITION BY event_type ORDER BY day) < -0.05 THEN 'down' ELSE 'flat' END AS trend
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def running_trends(spark, sf):
    out = evaluation.running(_days(spark, sf), "event_type", "day", "total")
    return out.withColumns({"running_mean": F.round("running_mean", 7), "change": F.round("change", 4)})


@query("""SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS average_rank FROM part""")
def average_rank(spark, sf):
    return metrics.average_ranks(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "average_rank").select("p_partkey", F.col("average_rank").cast("double"))


# Splits


@query("""SELECT s AS split, n FROM (SELECT count(*) AS t FROM orders), LATERAL (VALUES ('train', t - round_even(t * 0.1, 0)::BIGINT - round_even(t * 0.2, 0)::BIGINT), ('val', round_even(t * 0.1, 0)::BIGINT), ('test', round_even(t * 0.2, 0)::BIGINT)) v(s, n)""")
def split_exact(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    return splits.exact_split(df, ["o_orderkey"], {"train": 0.7, "val": 0.1, "test": 0.2}, seed=7).groupBy("split").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) % 5)::INT AS fold FROM customer""")
def kfold(spark, sf):
    return splits.kfold_by_order(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 5)


@query("""SELECT r AS repeat, f AS fold, (t // 4 + (f < t % 4)::BIGINT)::BIGINT AS n FROM (SELECT count(*) AS t FROM supplier), (VALUES (0), (1)) a(r), (VALUES (0), (1), (2), (3)) b(f)""")
def repeated_folds(spark, sf):
    return splits.folds(table(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"], 4, 2, seed=3).groupBy("repeat", "fold").agg(F.count("*").alias("n"))


# orders have small groups beside large ones, so both splits are filled exactly
@query("""SELECT s AS split, n, 0::BIGINT AS shared_keys FROM (SELECT count(*) AS t FROM orders), LATERAL (VALUES ('train', t - round_even(t * 0.2, 0)::BIGINT), ('test', round_even(t * 0.2, 0)::BIGINT)) v(s, n)""")
def group_split(spark, sf):
    out = splits.group_split(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", {"train": 0.8, "test": 0.2})
    return splits.check_split(out, ["o_custkey"], "split")


# Search and comparison


def _term_sql(term: str) -> str:
    hay = "lower(concat_ws(' ', p_partkey, p_name, p_type, p_brand))"
    return f"CASE WHEN p_partkey::VARCHAR = '{term}' THEN 100 WHEN contains(p_partkey::VARCHAR, '{term}') THEN 30 WHEN contains(lower(p_name), '{term}') THEN 20 WHEN contains({hay}, '{term}') THEN 5 ELSE 0 END"


@query(f"""SELECT p_partkey, p_brand, p_name, ({_term_sql('red')} + {_term_sql('17')} + {_term_sql('brand')})::INT AS score FROM part WHERE ({_term_sql('red')} + {_term_sql('17')} + {_term_sql('brand')}) > 0 ORDER BY score DESC, p_brand, p_name LIMIT 25""")
def search_rank(spark, sf):
    return search.rank_documents(table(spark, sf, "part"), "Red 17, BRAND?", "p_partkey", "p_name", "p_brand", ["p_type"], 25)


@query("""SELECT p_partkey, p_brand, p_name, greatest(1, 100 - (row_number() OVER (ORDER BY p_partkey) - 1))::INT AS score FROM part QUALIFY row_number() OVER (ORDER BY p_partkey) <= 60""")
def search_without_terms(spark, sf):
    return search.rank_documents(table(spark, sf, "part"), "", "p_partkey", "p_name", "p_brand", ["p_type"], 60)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT round((SELECT count(*) FROM a JOIN b USING (k)) / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 6) AS jaccard""")
def jaccard_keys(spark, sf):
    orders = table(spark, sf, "orders")
    return rounded(search.jaccard(orders.where("o_totalprice > 200000"), orders.where("o_orderstatus = 'F'"), "o_custkey"), ["jaccard"])


@query("""WITH v AS (SELECT round(value, 2) AS v, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
SELECT round(max(d), 6) AS ks FROM (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS d FROM v WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))""")
def ks_stat(spark, sf):
    df = table(spark, sf, "events").select("event_type", F.round("value", 2).alias("value"))
    return rounded(search.ks_statistic(df, "event_type", "value", "click", "view"), ["ks"])


@query("""WITH m AS (SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1), u AS (UNPIVOT m ON l_quantity, l_extendedprice INTO NAME "column" VALUE v)
SELECT "column", round(avg(abs(v - a)) / abs(max(a)), 6) AS instability FROM (SELECT *, avg(v) OVER (PARTITION BY "column") AS a FROM u) GROUP BY 1""")
def run_stability(spark, sf):
    return rounded(search.stability(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]), ["instability"])


@query("""SELECT role, count(*) AS n_turns, sum(len(regexp_extract_all(lower(text), '[a-z0-9_:+.-]+')))::BIGINT AS n_tokens, count(DISTINCT conv_id) AS n_conversations FROM conversations GROUP BY 1""")
def token_counts(spark, sf):
    df = table(spark, sf, "conversations")
    return df.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(F.size(scalars.tokens(F.col("text")))).alias("n_tokens"), F.count_distinct("conv_id").alias("n_conversations"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages""")
def page_slugs(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)).alias("host"), scalars.slug(F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)).alias("slug"))


# Models (results depend on the solver: no SQL)


@query()
def pca_projection(spark, sf):
    out, _ = models.pca(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 2)
    return out.select("vec_id", F.round(F.abs(F.col("projected")[0]), 6).alias("x"), F.round(F.abs(F.col("projected")[1]), 6).alias("y"))


@query()
def kmeans_sizes(spark, sf):
    return models.clusters(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 8, seed=5).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def gbt_predict(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_partkey") % 100).cast("double").alias("k"))
    return rounded(models.boosted(df, ["p_size", "k"], "p_retailprice", seed=2), ["prediction"], 4).select("p_partkey", "prediction")


@query("""SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal_z FROM customer""")
def standardized(spark, sf):
    return rounded(models.standardize(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", "c_acctbal_z"), ["c_acctbal_z"])


# Streams


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return windows.stream_of(spark, f"{sf}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf):
    path = shared_folder(spark, "stream")
    windows.run_complete(windows.tumbling(_events(spark, sf)), f"{path}/out", f"{path}/progress")
    return rounded(spark.read.parquet(f"{path}/out"), ["total"], 4).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, sum(CASE WHEN ts - p < INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k
  FROM (SELECT *, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '1900-01-01') AS p FROM events))
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return windows.sessions(table(spark, sf, "events"))


@query("""SELECT event_id, k AS key, v AS value FROM (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events), LATERAL (SELECT json_extract_string(props, '$."' || k || '"') AS v)""")
def json_properties(spark, sf):
    pairs = F.explode(F.from_json("props", "map<string,string>"))
    return table(spark, sf, "events").select("event_id", pairs).select("event_id", "key", "value")


# Further operators of metrics, reshaping and comparison


@query("""WITH d AS (SELECT quality AS t, length(text) AS score FROM documents JOIN labels USING (doc_id)), g AS (SELECT score, count(*) FILTER (t = 1) AS p, count(*) FILTER (t <> 1) AS m FROM d GROUP BY 1)
SELECT score::DOUBLE AS score, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(m) OVER w / sum(m) OVER (), 6) AS fpr, round(sum(p) OVER w / (sum(p) OVER w + sum(m) OVER w), 6) AS precision, round(sum(p) OVER w / sum(p) OVER (), 6) AS recall FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve(spark, sf):
    return rounded(metrics.curve_points(_classes(spark, sf), "t", "score"), ["tpr", "fpr", "precision", "recall"])


@query("""WITH d AS (SELECT toxic AS t, least(length(text) / 2000, 1) AS s FROM documents JOIN labels USING (doc_id))
SELECT least(floor(s * 10), 9)::INT AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg((t = 1)::INT), 6) AS share FROM d GROUP BY 1""")
def calibration_curve(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.least(F.length("text") / 2000, F.lit(1.0)).alias("s")).join(table(spark, sf, "labels"), "doc_id")
    return rounded(metrics.calibration(df, "toxic", "s"), ["mean_score", "share"])


@query(f"""WITH c AS {_CLASSES_SQL}, l AS (SELECT k AS label, (SELECT count(*) FROM c WHERE t = k) AS actual, (SELECT count(*) FROM c WHERE p = k) AS said, (SELECT count(*) FROM c WHERE t = k AND p = k) AS hit FROM (SELECT t AS k FROM c UNION SELECT p FROM c)),
m AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS pr, CASE WHEN actual > 0 THEN hit / actual ELSE 0 END AS re FROM l)
SELECT label, actual, said, hit, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM m""")
def class_metrics(spark, sf):
    return rounded(metrics.per_class(_classes(spark, sf), "t", "p"), ["precision", "recall", "f1"])


@query("""SELECT floor(value / 50)::BIGINT AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def histogram(spark, sf):
    return rounded(evaluation.histogram(table(spark, sf, "events"), "value", 50), ["mean"])


@query(f"WITH {_CLIFF_PAIRS_SQL} SELECT round(p95, 5) AS p95, n_pairs FROM n")
def sali_normalizer(spark, sf):
    return rounded(similarity.normalizer(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 0.2, "dot"), ["p95"], 5)


@query("""SELECT vec_id, CASE WHEN a = 'invalid_features' OR b = 'invalid_features' THEN 'invalid_features' WHEN a = 'out_of_domain' OR b = 'out_of_domain' THEN 'out_of_domain' ELSE 'in_domain' END AS status
FROM (SELECT vec_id, CASE WHEN embedding[1] > 0.2 THEN 'out_of_domain' ELSE 'in_domain' END AS a, CASE WHEN label = 3 THEN 'invalid_features' ELSE 'in_domain' END AS b FROM embeddings)""")
def status_combine(spark, sf):
    a = F.when(F.col("embedding")[0] > 0.2, "out_of_domain").otherwise("in_domain")
    b = F.when(F.col("label") == 3, "invalid_features").otherwise("in_domain")
    return table(spark, sf, "embeddings").select("vec_id", similarity.combine_status(a, b).alias("status"))


@query("""SELECT vec_id, len(embedding)::INT AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings""")
def parse_vectors(spark, sf):
    """Vectors as text, parsed again: of full length and finite."""
    text = table(spark, sf, "embeddings").select("vec_id", F.to_json(F.col("embedding").cast("array<double>")).alias("s"))
    parsed = text.withColumn("v", labels.parse_vector(F.col("s"), 64)).where("v is not null")
    return parsed.select("vec_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""SELECT s_nationkey, count(*) AS n, arg_max(s_suppkey, s_acctbal) AS best, arg_min(s_suppkey, s_acctbal) AS worst FROM supplier GROUP BY 1""")
def recommendations(spark, sf):
    return evaluation.recommendations(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal")


@query("""WITH c AS (SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY f) - 1 AS k FROM (SELECT p_partkey, p_brand, min(p_partkey) OVER (PARTITION BY p_brand) AS f FROM part WHERE p_partkey % 2 = 0))
SELECT part.p_partkey, coalesce(m.k, -1)::INT AS code FROM part LEFT JOIN (SELECT DISTINCT p_brand, k FROM c) m USING (p_brand) WHERE part.p_partkey % 2 = 1""")
def category_codes(spark, sf):
    """Codes in the order in which training rows (even keys) first show a category; -1 for others."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return align.first_seen_codes(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), "p_brand", "p_partkey").select("p_partkey", "code")


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS q90, round(quantile_cont(value, 0.95), 6) AS q95, CASE WHEN avg(value) / max(value) >= 0.9 THEN 'excellent'
  WHEN avg(value) / max(value) >= 0.8 THEN 'good' WHEN avg(value) / max(value) >= 0.7 THEN 'acceptable' ELSE 'poor' END AS rating FROM events GROUP BY 1""")
def numeric_summary(spark, sf):
    out = evaluation.summary(table(spark, sf, "events"), "value", ["event_type"], {"median": 0.5, "q90": 0.9, "q95": 0.95})
    return rounded(out, ["median", "q90", "q95"]).select("event_type", "n", "median", "q90", "q95", "rating")


@query("""WITH a AS (SELECT l_returnflag AS k, avg(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag AS k, avg(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT k AS l_returnflag, round(a.v, 6) AS first_run, round(b.v, 6) AS second_run, round(b.v - a.v, 6) AS difference FROM a FULL JOIN b USING (k)""")
def run_comparison(spark, sf):
    out = evaluation.two_runs(table(spark, sf, "lineitem"), "l_linestatus", "F", "O", "l_returnflag", "l_quantity")
    return rounded(out, ["first_run", "second_run", "difference"])


@query("""SELECT count(*) - count(DISTINCT text) AS duplicate_rows, count(DISTINCT text) AS distinct_rows FROM documents""")
def duplicate_rows(spark, sf):
    return curation.duplicate_counts(table(spark, sf, "documents"), ["text"])


@query("""SELECT p_partkey, round(std, 4) AS std FROM (SELECT p_partkey, stddev_pop(v) AS std FROM (SELECT p_partkey, unnest([p_retailprice, p_size * 30.0, (p_partkey % 97) * 10.0]) AS v FROM part) GROUP BY 1) ORDER BY std DESC, p_partkey LIMIT 5""")
def top_disagreement(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_size") * 30.0).alias("b"), ((F.col("p_partkey") % 97) * 10.0).alias("c"))
    out = ensemble.regression(df, "p_partkey", ["a", "b", "c"]).orderBy(F.desc("std"), "p_partkey").limit(5)
    return rounded(out.select("p_partkey", "std"), ["std"], 4)


@query("""SELECT n_name, r_name, count(s_suppkey) AS n_suppliers, round(coalesce(sum(s_acctbal), 0), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def enriched_nations(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("b"))
    out = nations.join(by, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rounded(out.select("n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_suppliers"), F.coalesce("b", F.lit(0.0)).alias("balance")), ["balance"], 2)


from tessera.plans import basics as _basics  # noqa: E402, F401 - registers further queries
from tessera.plans import more as _more  # noqa: E402, F401
