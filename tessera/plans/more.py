"""Further queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels, scalars
from tessera.operators import align, catalog, curation, domains, evaluation, frame, maps, models, schema, search, sequences, session, splits
from tessera.plans.queries import LINE, _grid, _predicted, query, rounded, table
from tessera.sources import readers

# Frames


@query("""SELECT 'o_orderstatus' AS "column", count(o_orderstatus) AS count, count(DISTINCT o_orderstatus) AS "unique", (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
  (SELECT count(*) FROM orders GROUP BY o_orderstatus ORDER BY count(*) DESC, o_orderstatus LIMIT 1) AS freq, NULL::DOUBLE AS q50 FROM orders
UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(DISTINCT o_totalprice::VARCHAR), (SELECT o_totalprice::VARCHAR FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  (SELECT count(*) FROM orders GROUP BY o_totalprice::VARCHAR ORDER BY count(*) DESC, o_totalprice::VARCHAR LIMIT 1), round(median(o_totalprice), 4) FROM orders""")
def describe_all(spark, sf):
    df = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    return rounded(frame.describe_all(df).select("column", "count", "unique", "top", "freq", "q50"), ["q50"], 4)


@query("""SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS r FROM customer) WHERE r >= 10 AND r < 60 AND (r - 10) % 7 = 0""")
def rows_by_position(spark, sf):
    return frame.iloc(table(spark, sf, "customer"), ["c_acctbal", "c_custkey"], slice(10, 60, 7)).select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 5 AND 9""")
def rows_by_label(spark, sf):
    return frame.loc(table(spark, sf, "customer"), "c_custkey", (5, 9), ["c_custkey", "c_name"])


@query("""SELECT 'r_name' AS "column", max(r_name) FILTER (r_regionkey = 0) AS "0", max(r_name) FILTER (r_regionkey = 1) AS "1", max(r_name) FILTER (r_regionkey = 2) AS "2", max(r_name) FILTER (r_regionkey = 3) AS "3", max(r_name) FILTER (r_regionkey = 4) AS "4" FROM region""")
def transpose_rows(spark, sf):
    return frame.transpose(table(spark, sf, "region").select("r_regionkey", "r_name"), "r_regionkey")


@query("""SELECT s_suppkey, upper(s_name) AS s_name, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 6) END AS s_acctbal FROM supplier""")
def named_functions(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return rounded(frame.apply(frame.apply(df, "upper", ["s_name"]), "sqrt", ["s_acctbal"]), ["s_acctbal"])


@query("""SELECT round(avg(l_quantity), 6) AS l_quantity_mean, max(l_quantity) AS l_quantity_max, round(stddev_samp(l_quantity), 6) AS l_quantity_std, min(l_tax) AS l_tax FROM lineitem""")
def aggregate_columns(spark, sf):
    return rounded(frame.aggregate(table(spark, sf, "lineitem"), {"l_quantity": ["mean", "max", "std"], "l_tax": "min"}), ["l_quantity_mean", "l_quantity_std"])


@query("""SELECT coalesce(a.r, b.r) AS row_id, s_suppkey, s_name, n_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier) a FULL JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) b ON a.r = b.r""")
def side_by_position(spark, sf):
    return frame.beside(table(spark, sf, "supplier").select("s_suppkey", "s_name"), table(spark, sf, "nation").select("n_nationkey", "n_name"), ["s_suppkey"], ["n_nationkey"]).select("row_id", "s_suppkey", "s_name", "n_name")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (1, 2, 3)""")
def drop_rows(spark, sf):
    return frame.drop_rows(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey", [1, 2, 3])


@query()
def frame_fingerprint(spark, sf):
    return frame.fingerprint(table(spark, sf, "part"))


# Schema


def _renamed(spark, sf):
    """Events as a user's dataset: potencies in nM, labels, assays."""
    return table(spark, sf, "events").select(F.col("event_id").alias("compound_id"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("smiles"), F.col("value").cast("string").alias("IC50_nM"), F.col("event_type").alias("assay_id"))


@query("""SELECT 'IC50_nM' AS activity_column, 'regression' AS activity_kind, 'lower_is_better' AS activity_semantics, 'assay_id' AS assay_column, 'nm' AS detected_units, 'IC50' AS endpoint, 'compound_id' AS molecule_id_column, 'pIC50' AS score_name, 'smiles' AS smiles_column, 'user_dataset' AS source_format""")
def activity_mapping(spark, sf):
    found = schema.infer(_renamed(spark, sf)).to_dict()
    return spark.createDataFrame([tuple(found[k] for k in sorted(found))], sorted(found))


@query("""SELECT event_id AS compound_id, CASE WHEN value > 0 THEN round(-log10(value * 1e-9), 6) END AS activity FROM events""")
def normalized_activity(spark, sf):
    return rounded(schema.with_activity(_renamed(spark, sf)).select("compound_id", "activity"), ["activity"])


@query("""WITH b AS (SELECT 'C' || user_id AS smiles, event_id, CASE WHEN value > 0 THEN -log10(value * 1e-9) END AS p FROM events), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY smiles ORDER BY p DESC NULLS LAST, event_id) = 1)
SELECT smiles, event_id::VARCHAR AS molecule_id, round(p, 6) AS best FROM o ORDER BY p DESC NULLS LAST, event_id LIMIT 50""")
def compound_preview(spark, sf):
    return rounded(schema.preview(_renamed(spark, sf), order=["compound_id"]).select("smiles", "molecule_id", "best"), ["best"])


@query("""SELECT count(DISTINCT u) AS n, CASE WHEN count(DISTINCT u) = 1 THEN min(u) WHEN count(DISTINCT u) > 1 THEN 'mixed' END AS unit FROM (SELECT 'nm' AS u FROM events WHERE event_type = 'click' UNION ALL SELECT 'um' FROM events WHERE event_type = 'view')""")
def detected_unit(spark, sf):
    df = table(spark, sf, "events").where("event_type in ('click', 'view')").select(F.when(F.col("event_type") == "click", " nM").otherwise("µM").alias("u"))
    return df.agg(F.count_distinct(scalars.normalize_unit(F.col("u"))).alias("n")).withColumn("unit", F.lit(schema.constant_unit(df, "u")))


@query("""SELECT doc_id, CASE WHEN text LIKE '%active%' THEN 1 END AS marked, CASE WHEN contains(lower(lang), 'no') OR contains(lower(lang), 'inactive') OR contains(lower(lang), 'inconclusive') THEN 'inactive' ELSE 'active' END AS label FROM documents""")
def comment_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("text").contains("active"), 1).alias("marked"), scalars.parse_comment(F.col("lang")).alias("label"))


@query("""SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0""")
def analysis_frame(spark, sf):
    df = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("smi"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("potency"))
    out = schema.for_analysis(df.withColumn("smi", F.col("smi").cast("string")))
    return out.select(F.col("smiles").cast("long").alias("c_custkey"), F.col("cluster_id").alias("c_mktsegment"), F.col("activity").alias("c_acctbal"))


# Alignment


@query("""SELECT p_partkey, p_brand, p_size, n_lines, round(q, 6) AS q FROM part JOIN (SELECT l_partkey, count(*) AS n_lines, avg(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def strict_feature_join(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_lines"), F.avg("l_quantity").alias("q"))
    base = table(spark, sf, "part").select("p_partkey", "p_brand").join(lines.select("p_partkey"), "p_partkey", "left_semi")
    sizes = table(spark, sf, "part").select("p_partkey", "p_size", F.lit("x").alias("p_brand"))
    return rounded(align.join_features(base, [sizes, lines], ["p_partkey"]), ["q"])


@query("""SELECT o_orderkey, o_orderstatus, c_name, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def suffixed_join(spark, sf):
    left = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("key"), F.lit("o").alias("name"))
    right = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name", F.col("c_name").alias("name"))
    return align.with_suffix(left, right, "key").select("o_orderkey", "o_orderstatus", "c_name", F.col("name_assay").alias("name"))


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), n_name) AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def present_value_wins(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    return align.existing_wins(df, table(spark, sf, "nation"), "n_nationkey", {"segment": "n_name"}).select("c_custkey", "segment")


@query("""SELECT s_suppkey, s_name, n_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) JOIN (SELECT c_name AS n_name, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) USING (r)""")
def attach_by_position(spark, sf):
    left = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    right = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("n_name"))
    return align.attach(left, right, ["s_suppkey"], ["c_custkey"], ["n_name"], check=False)


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_acctbal AS y FROM customer), t AS (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM r WHERE row_id % 5 = 0), p AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS k, s_acctbal AS p FROM supplier)
SELECT row_id, round(y, 4) AS y, round(p, 4) AS p FROM t JOIN p USING (k)""")
def truth_and_predictions(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    split = spark.range(rows.count()).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    said = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("c_acctbal"))
    return rounded(align.truth_and_predictions(rows, split, said, ["c_custkey"], ["s_suppkey"], "test", "c_acctbal"), ["y", "p"], 4)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'X' ELSE p_brand END AS p_brand FROM part""")
def reindexed(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand")
    return align.reindex(df, df.where("p_partkey % 2 = 0").withColumn("p_brand", F.lit("X")), "p_partkey")


# Evaluation


_RUNS_SQL = "(SELECT l_returnflag AS family, l_linestatus AS run, avg(l_discount) AS r2, avg(l_tax) AS rmse FROM lineitem GROUP BY 1, 2)"


@query(f"""SELECT family, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_runs FROM (UNPIVOT {_RUNS_SQL} ON r2, rmse INTO NAME metric VALUE value) GROUP BY 1, 2""")
def split_families(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("family"), "l_linestatus").agg(F.avg("l_discount").alias("r2"), F.avg("l_tax").alias("rmse"))
    return rounded(evaluation.split_families(runs.unpivot(["family"], ["r2", "rmse"], "metric", "value"), "family", "metric", "value"), ["mean", "std"])


@query("""WITH r AS (SELECT CASE l_returnflag WHEN 'N' THEN 'random' WHEN 'A' THEN 'scaffold' ELSE 'cluster' END AS family, avg(l_quantity) / 34 - CASE l_returnflag WHEN 'R' THEN 0.3 ELSE 0 END AS r2 FROM lineitem GROUP BY l_returnflag)
SELECT 'cluster' AS hardest_split, round((SELECT r2 FROM r WHERE family = 'cluster'), 6) AS hardest, (SELECT r2 FROM r WHERE family = 'cluster') >= 0.7 AS passes_hardest, (SELECT min(a.r2 - b.r2) FROM r a, r b WHERE a.family <> 'random' AND b.family = 'random') >= -0.1 AS passes_robustness, true AS passes_stability, 'workflow_demo' AS recommended_status""")
def protocol_assessment(spark, sf):
    family = F.when(F.col("l_returnflag") == "N", "random").when(F.col("l_returnflag") == "A", "scaffold").otherwise("cluster")
    value = F.avg("l_quantity") / 34 - F.when(F.max("l_returnflag") == "R", 0.3).otherwise(0.0)
    runs = table(spark, sf, "lineitem").groupBy("l_returnflag", family.alias("family")).agg(value.alias("value")).withColumn("metric", F.lit("r2"))
    return rounded(evaluation.protocol(evaluation.split_families(runs, "family", "metric", "value")).drop("worst_delta"), ["hardest"])


@query("""WITH v AS (SELECT l_returnflag AS variant, l_linestatus AS s, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2), w AS (SELECT variant, max(q) FILTER (s = 'F') AS f, max(q) FILTER (s = 'O') AS o FROM v GROUP BY 1)
SELECT variant, round(f, 6) AS "F", round(o, 6) AS "O", round(f - (SELECT f FROM w WHERE variant = 'N'), 6) AS "delta_F", round(o - (SELECT o FROM w WHERE variant = 'N'), 6) AS "delta_O" FROM w""")
def pivot_deltas(spark, sf):
    by = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), "l_linestatus").agg(F.avg("l_quantity").alias("q"))
    return rounded(evaluation.delta_against(by, "variant", "l_linestatus", "q", "N", ["F", "O"]), ["F", "O", "delta_F", "delta_O"])


@query("""WITH u AS (SELECT p_retailprice AS y, unnest(['a', 'b']) AS component, unnest([p_size * 30.0, 1000.0 + p_partkey % 97]) AS p FROM part)
SELECT component, count(*) AS n, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae FROM u GROUP BY 1""")
def component_metrics(spark, sf):
    df = table(spark, sf, "part").select("p_retailprice", (F.col("p_size") * 30.0).alias("a"), (1000.0 + F.col("p_partkey") % 97).alias("b"))
    return rounded(evaluation.component_metrics(df, "p_retailprice", ["a", "b"]).drop("mse"), ["r2", "rmse", "mae"])


_STATUS_SQL = "(SELECT vec_id, CASE WHEN embedding[1] > 0.2 THEN 'out_of_domain' WHEN label = 3 THEN 'invalid_features' ELSE 'in_domain' END AS status, concat_ws(';', CASE WHEN embedding[1] > 0.1 THEN 'a' END, CASE WHEN embedding[2] > 0.1 THEN 'b' END, CASE WHEN label > 6 THEN 'c' END) AS f FROM embeddings)"


def _statuses(spark, sf):
    e = F.col("embedding")
    status = F.when(e[0] > 0.2, "out_of_domain").when(F.col("label") == 3, "invalid_features").otherwise("in_domain")
    return table(spark, sf, "embeddings").select("vec_id", status.alias("status"), F.concat_ws(";", F.when(e[0] > 0.1, "a"), F.when(e[1] > 0.1, "b"), F.when(F.col("label") > 6, "c")).alias("f"))


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (status = 'in_domain') AS n_in_domain, count(*) FILTER (status = 'out_of_domain') AS n_out_of_domain, count(*) FILTER (status = 'invalid_features') AS n_invalid_features, round(count(*) FILTER (status = 'in_domain') / count(*), 6) AS coverage FROM {_STATUS_SQL}""")
def status_summary(spark, sf):
    return rounded(evaluation.status_summary(_statuses(spark, sf), "status"), ["coverage"])


@query(f"SELECT feature, count(*) AS count FROM (SELECT unnest(string_split(f, ';')) AS feature FROM {_STATUS_SQL}) WHERE feature <> '' GROUP BY 1 ORDER BY count DESC, feature LIMIT 20")
def violating_features(spark, sf):
    return evaluation.violating_features(_statuses(spark, sf), "f")


@query("""WITH d AS (SELECT value / 500 AS s FROM events WHERE event_type = 'purchase'), m AS (SELECT avg(s) AS mean, stddev_pop(s) AS std, min(s) AS low, max(s) AS high, count(*) AS n FROM d), r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k FROM d)
SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high, n, round((SELECT min(s) FROM r WHERE k = n // 2), 6) AS median, (SELECT count(*) FROM d WHERE s >= low AND s < low + (high - low) / 5) AS bin0, (SELECT count(*) FROM d WHERE s >= low + 4 * ((high - low) / 5) AND s < low + 5 * ((high - low) / 5)) AS bin4,
  CASE WHEN mean >= 0.9 THEN 'excellent' WHEN mean >= 0.8 THEN 'good' WHEN mean >= 0.7 THEN 'acceptable' ELSE 'poor' END AS rating FROM m""")
def score_distribution(spark, sf):
    df = table(spark, sf, "events").select((F.col("value") / 500).alias("s"), (F.col("event_type") == "purchase").alias("ok"))
    out = evaluation.score_distribution(df, "s", "ok").select("mean", "std", "low", "high", "n", "median", "bin0", "bin4", "rating")
    return rounded(out, ["mean", "std", "low", "high", "median"])


_RESULTS_SQL = "(SELECT event_id, event_type <> 'error' AND user_id % 3 > 0 AS ok, value / 500 AS score, CASE user_id % 7 WHEN 0 THEN 'Timed out' WHEN 1 THEN 'invalid value' WHEN 2 THEN 'a Tool broke' WHEN 3 THEN NULL ELSE 'x' END AS error, event_type, user_id, value FROM events)"


def _results(spark, sf):
    k = F.col("user_id") % 7
    error = F.when(k == 0, "Timed out").when(k == 1, "invalid value").when(k == 2, "a Tool broke").when(k != 3, "x")
    return table(spark, sf, "events").select("event_id", ((F.col("event_type") != "error") & (F.col("user_id") % 3 > 0)).alias("ok"), (F.col("value") / 500).alias("score"), error.alias("error"), "event_type", "user_id", "value")


@query(f"""SELECT category, count(*) AS n FROM (SELECT CASE WHEN ok THEN CASE WHEN coalesce(score, 1) < 0.7 THEN 'low_score' END WHEN contains(lower(coalesce(error, '')), 'timeout') OR contains(lower(coalesce(error, '')), 'timed out') THEN 'timeout'
  WHEN contains(lower(coalesce(error, '')), 'validation') OR contains(lower(coalesce(error, '')), 'invalid') THEN 'validation_error' WHEN contains(lower(coalesce(error, '')), 'tool') OR contains(lower(coalesce(error, '')), 'function') THEN 'tool_error' ELSE 'other' END AS category FROM {_RESULTS_SQL}) WHERE category IS NOT NULL GROUP BY 1""")
def failure_categories(spark, sf):
    kind = evaluation.failure_category(F.col("ok"), F.col("score"), F.col("error"))
    return _results(spark, sf).select(kind.alias("category")).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@query(f"SELECT event_id FROM {_RESULTS_SQL} WHERE NOT coalesce(ok, false) OR coalesce(score < 0.5, false)")
def failing_rows(spark, sf):
    return evaluation.failing(_results(spark, sf), "ok", "score", 0.5).select("event_id")


@query(f"SELECT event_type, round(avg(value), 6) AS row_count, count(*) FILTER (ok) AS success, round(avg(score), 6) AS robustness_score, round(avg(coalesce(ok, false)::INT), 6) AS success_rate FROM {_RESULTS_SQL} GROUP BY 1")
def dataset_stats(spark, sf):
    return rounded(evaluation.dataset_stats(_results(spark, sf), "event_type", "value", "ok", "score"), ["row_count", "robustness_score", "success_rate"])


_DAILY_SQL = "(SELECT event_type, ts::DATE AS day, round(avg(value) / 500, 6) AS score, count(*) FILTER (user_id % 3 > 0) AS passed, count(*) AS total FROM events GROUP BY 1, 2)"


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value") / 500, 6).alias("score"), F.count_if(F.col("user_id") % 3 > 0).alias("passed"), F.count("*").alias("total"))


@query(f"""WITH d AS (SELECT * FROM {_DAILY_SQL} WHERE event_type = 'click'), c AS (SELECT arg_max(score, day) - arg_min(score, day) AS change FROM d)
SELECT count(*) AS n_runs, round(avg(passed / total), 6) AS avg_success_rate, round(min(passed / total), 6) AS min_success_rate, round(max(passed / total), 6) AS max_success_rate, round(avg(score), 6) AS avg_mean_score, round(min(score), 6) AS min_mean_score, round(max(score), 6) AS max_mean_score,
  round((SELECT change FROM c), 6) AS change, CASE WHEN count(*) < 2 THEN 'Unknown' WHEN (SELECT change FROM c) > 0.05 THEN 'Improvement' WHEN (SELECT change FROM c) < -0.05 THEN 'Regression' ELSE 'Stable' END AS trend FROM d""")
def compare_runs(spark, sf):
    out = evaluation.compare_runs(_daily(spark, sf).where("event_type = 'click'"), "day", "score", "passed", "total")
    return rounded(out, [c for c in out.columns if c not in ("n_runs", "trend")])


@query(f"""SELECT event_type, p AS "from", day AS "to", round(c, 4) AS change, CASE WHEN c > 0 THEN 'improvement' ELSE 'regression' END AS kind FROM (SELECT *, lag(day) OVER (PARTITION BY event_type ORDER BY day) AS p, score - lag(score) OVER (PARTITION BY event_type ORDER BY day) AS c FROM {_DAILY_SQL}) WHERE abs(c) > 0.05""")
def steps_over_time(spark, sf):
    return rounded(evaluation.steps_over_time(_daily(spark, sf), "event_type", "day", "score"), ["change"], 4)


@query("""SELECT * FROM (SELECT 'q' AS metric, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS run_1, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS run_2, round(avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS difference FROM lineitem
UNION ALL SELECT 'only', NULL, max(l_tax) FILTER (l_linestatus = 'O'), NULL FROM lineitem)""")
def comparison_table(spark, sf):
    lines = table(spark, sf, "lineitem")
    a, b = lines.where("l_linestatus = 'F'").agg(F.avg("l_quantity").alias("q")), lines.where("l_linestatus = 'O'").agg(F.avg("l_quantity").alias("q"), F.max("l_tax").alias("only"))
    return rounded(evaluation.comparison_table(a, b, ["q", "only"]), ["run_1", "run_2", "difference"])


@query("""SELECT event_id, round(0.5 * (coalesce(value / 500, 0) + (user_id % 10) / 10 + 0.5) / 3 + 0.25 * ((user_id % 5) / 5 + 0.5 + 1) / 3 + 0.25 * (user_id % 2), 6) AS score FROM events""")
def robustness_score(spark, sf):
    u = F.col("user_id")
    df = table(spark, sf, "events").select(
        "event_id", (F.col("value") / 500).alias("row_jaccard"), ((u % 10) / 10).alias("column_match"), F.lit(0.5).alias("value_similarity"), ((u % 5) / 5).alias("semantic_similarity"), F.lit(0.5).alias("entity_overlap"), F.lit(1.0).alias("numeric_consistency"), (u % 2).alias("ssim")
    )
    weight = evaluation.robustness(df, {"data_similarity": 2.0, "semantic_similarity": 1.0, "visual_similarity": 1.0})
    return rounded(df.select("event_id", weight.alias("score")), ["score"])


@query("""SELECT event_type, count(*) AS n, round(epoch(max(ts + to_seconds(value::BIGINT))) - epoch(min(ts)), 3) AS total_seconds, round(max(value::BIGINT), 3)::DOUBLE AS longest_seconds FROM events GROUP BY 1""")
def duration_summary(spark, sf):
    seconds = F.round("value").cast("long")
    df = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("a"), F.timestamp_seconds(F.col("ts").cast("timestamp").cast("double") + seconds).alias("b"))
    return evaluation.durations(df, "a", "b", ["event_type"]).select("event_type", "n", "total_seconds", "longest_seconds")


@query("""SELECT '{"a":"' || (l_linenumber % 3) || '","b":"' || l_returnflag || '"}' AS parameters, count(*) AS n FROM lineitem GROUP BY 1""")
def same_parameters(spark, sf):
    df = table(spark, sf, "lineitem").select(F.create_map(F.lit("b"), F.col("l_returnflag"), F.lit("a"), (F.col("l_linenumber") % 3).cast("string")).alias("p"), "l_linestatus")
    return evaluation.same_parameters(df, "p", ["l_linestatus"]).select("parameters", "n")


@query("""WITH s AS (SELECT l_returnflag AS c, avg(l_quantity) FILTER (l_linestatus = 'F') AS f, avg(l_quantity) FILTER (l_linestatus = 'O') AS o, stddev_pop(l_quantity) FILTER (l_linestatus = 'F') AS d, sum(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c AS l_returnflag, round(f, 6) AS "F_l_quantity", round(o, 6) AS "O_l_quantity", round(d, 6) AS "F_l_quantity_std", round(t, 2) AS train_time_s, n AS n_runs, round(o - f, 6) AS "delta_O_l_quantity" FROM s""")
def benchmark_summary(spark, sf):
    out = evaluation.summary_rows(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["l_quantity"], ["F", "O"], "l_tax")
    return rounded(rounded(out, ["F_l_quantity", "O_l_quantity", "F_l_quantity_std", "delta_O_l_quantity"]), ["train_time_s"], 2)


@query("""WITH u AS (SELECT s_suppkey, unnest(['a', 'b']) AS metric, unnest([s_acctbal, s_nationkey::DOUBLE]) AS value FROM supplier), m AS (SELECT metric, avg(value) AS a, stddev_pop(value) AS s FROM u GROUP BY 1)
SELECT s_suppkey, metric, round(value, 4) AS value FROM u JOIN m USING (metric) WHERE abs((value - a) / s) > 1.5""")
def outliers_by_metric(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), F.col("s_nationkey").alias("b"))
    return rounded(evaluation.outliers_by_metric(df, "s_suppkey", ["a", "b"], 1.5), ["value"], 4)


@query("""WITH r AS (SELECT o_custkey AS m, extract(year FROM o_orderdate) AS r, o_totalprice AS y, o_totalprice * (0.9 + (o_orderkey % 5) / 20) AS p FROM orders), e AS (SELECT avg(x) AS rmse FROM (SELECT sqrt(avg((y - p) ** 2)) AS x FROM r GROUP BY r))
SELECT m AS o_custkey, round(avg(y), 0) AS y, round(avg(p), 0) AS p, round(stddev_pop(p), 0) AS std, count(*) AS n, abs(avg(y) - avg(p)) >= 2 * max(rmse) AS outlier FROM r, e GROUP BY 1""")
def cv_by_molecule(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("r"), F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * (0.9 + (F.col("o_orderkey") % 5) / 20)).alias("p"))
    return rounded(evaluation.cross_validated(df, "o_custkey", "r", "y", "p"), ["y", "p", "std"], 0)


@query("""SELECT event_id, user_id, round(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS best FROM events""")
def best_so_far(spark, sf):
    return rounded(evaluation.best_so_far(table(spark, sf, "events"), "user_id", "event_id", "value").select("event_id", "user_id", "best"), ["best"])


@query("""SELECT min(t) AS a, max(t) AS b, strftime(min(ts), '%Y-%m-%d %H:%M') || ' to ' || strftime(max(ts), '%Y-%m-%d %H:%M') AS time_range FROM (SELECT ts, strftime(ts, '%Y%m%d_%H%M%S') AS t FROM events)""")
def time_range(spark, sf):
    df = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd_HHmmss").alias("t"))
    return df.agg(F.min("t").alias("a"), F.max("t").alias("b")).join(F.broadcast(catalog.time_range(df, "t")))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^/]+)/', 1) AS part FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]*/[^/]+/[^/]')""")
def parsed_paths(spark, sf):
    path = F.concat(F.lit("x/robustness_tests/"), F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1), "/+$", ""))
    test, at = catalog.path_parts(F.concat(path, F.lit("/results.json")))
    ok = F.col("url").rlike("^[a-z]+://[^/]*/[^/]+/[^/]")
    return table(spark, sf, "pages").where(ok).select("page_id", test.alias("part"))


@query("""WITH b AS (SELECT s_suppkey AS c, CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal END AS h, s_nationkey::DOUBLE AS d, s_suppkey % 5 AS r, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 11 END AS x, s_suppkey % 13 AS t FROM supplier)
SELECT (SELECT c FROM b ORDER BY h DESC NULLS LAST, d DESC, r DESC, t, c LIMIT 1) AS best_overall, (SELECT c FROM b ORDER BY h DESC NULLS LAST, c LIMIT 1) AS best_hardest_split, (SELECT c FROM b WHERE x IS NOT NULL ORDER BY x, c LIMIT 1) AS best_stability, (SELECT c FROM b ORDER BY t, c LIMIT 1) AS best_fast""")
def four_recommendations(spark, sf):
    k = F.col("s_suppkey")
    df = table(spark, sf, "supplier").select(k.alias("c"), F.when(k % 7 > 0, F.col("s_acctbal")).alias("h"), F.col("s_nationkey").cast("double").alias("d"), (k % 5).cast("double").alias("r"), F.when(k % 3 == 0, k % 11).alias("x"), (k % 13).cast("double").alias("t"))
    return evaluation.four_recommendations(df, "c", "h", "d", "r", "x", "t")


# Domains


@query("""WITH p AS (SELECT q.vec_id AS i, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS sim, c.vec_id AS j FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 4 <> 0 AND c.vec_id % 4 <> 0),
s AS (SELECT i, avg(sim) AS s FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 5) GROUP BY 1) SELECT round(quantile_cont(s, 0.05), 6) AS threshold, count(*) AS n_train FROM s""")
def support_threshold(spark, sf):
    df = table(spark, sf, "embeddings").where("vec_id % 4 <> 0")
    return rounded(domains.support_threshold(df, "vec_id", "embedding", measure="dot"), ["threshold"])


@query("""WITH e AS (SELECT * FROM embeddings), p AS (SELECT q.vec_id AS i, c.vec_id AS j, q.vec_id % 4 = 0 AS outside, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS sim FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE c.vec_id % 4 <> 0),
s AS (SELECT i, outside, avg(sim) AS s, arg_min(j, r) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM p) WHERE r <= 5 GROUP BY 1, 2), t AS (SELECT quantile_cont(s, 0.05) AS threshold FROM s WHERE NOT outside)
SELECT i AS vec_id, round(s, 6) AS support, nearest, CASE WHEN s >= threshold THEN 'in_domain' ELSE 'out_of_domain' END AS status FROM s, t WHERE outside""")
def support_domain(spark, sf):
    df = table(spark, sf, "embeddings")
    out = domains.score_support(df.where("vec_id % 4 = 0"), df.where("vec_id % 4 <> 0"), "vec_id", "embedding", measure="dot")
    return rounded(out, ["support"]).select("vec_id", "support", "nearest", "status")


@query()
def forest_domain(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = domains.score_forest(df, "vec_id", "embedding", domains.fit_forest(df.where("vec_id % 4 <> 0"), "vec_id", "embedding", seed=4))
    return rounded(out, ["score", "decision"])


@query()
def combined_domain(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    domain = domains.Domain(df.where("vec_id % 4 <> 0"), "vec_id", "embedding", [f"embedding_{k}" for k in range(64)], measure="dot", seed=4)
    return domain.score(df.where("vec_id % 4 = 0")).select("vec_id", "status", "methods_out", "bounding_box_status", "isolation_forest_status", "similarity_status")


# Sequences


_PEPTIDE_SQL = "regexp_extract_all(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '.')"


def _peptides(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", "[^A-Za-z]", "").alias("s"))


@query(f"""SELECT p_partkey, array_to_string({_PEPTIDE_SQL}, ' ') AS sequence, len({_PEPTIDE_SQL})::INT AS length, CASE WHEN len(list_filter({_PEPTIDE_SQL}, lambda t: NOT contains('ACDEFGHIKLMNPQRSTUVYWZ', t))) > 0
  THEN 'Unsupported amino acid token(s): ' || array_to_string(list_sort(list_distinct(list_filter({_PEPTIDE_SQL}, lambda t: NOT contains('ACDEFGHIKLMNPQRSTUVYWZ', t)))), ', ') || '.' WHEN len({_PEPTIDE_SQL}) > 25 THEN 'Peptide sequence length ' || len({_PEPTIDE_SQL}) || ' exceeds max length 25.' END AS error FROM part""")
def peptide_checks(spark, sf):
    c = F.col("s")
    return _peptides(spark, sf).select("p_partkey", sequences.normalized(c).alias("sequence"), sequences.properties(c)["length"].alias("length"), sequences.sequence_error(c).alias("error"))


@query(f"""WITH s AS (SELECT p_partkey, {_PEPTIDE_SQL} AS a, ['P', 'A', 'R', 'T', 'K'] AS b FROM part) SELECT p_partkey, round(len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) / greatest(len(a), len(b)), 4) AS similarity FROM s""")
def peptide_similarity(spark, sf):
    return _peptides(spark, sf).select("p_partkey", sequences.position_similarity(F.col("s"), F.lit("P-A-R T,K")).alias("similarity"))


@query("""SELECT p_brand, min(p_partkey) AS p_partkey FROM part WHERE p_size > 10 AND p_partkey % 3 > 0 GROUP BY 1 UNION ALL SELECT p_brand, p_partkey FROM part WHERE p_size > 10 AND p_partkey % 3 = 0""")
def distinct_candidates(spark, sf):
    df = table(spark, sf, "part").where("p_size > 10").select("p_brand", "p_partkey", (F.col("p_partkey") % 3 > 0).alias("valid"))
    return sequences.distinct_candidates(df, "p_brand", "valid", "p_partkey").select("p_brand", "p_partkey")


@query("""SELECT p_partkey, p_partkey % 3 > 0 AS valid, CASE WHEN p_size > 5 THEN p_size::DOUBLE END AS ranking_score FROM part ORDER BY valid DESC, coalesce(ranking_score, -1) DESC, p_partkey LIMIT 30""")
def ranked_candidates(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 3 > 0).alias("valid"), F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("score"))
    return sequences.rank_candidates(df, "valid", F.col("score"), "p_partkey", 30).select("p_partkey", "valid", "ranking_score")


@query("""SELECT a.vec_id, k AS step, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (1 - k / 4) * z[1]::DOUBLE + (k / 4) * z[2]::DOUBLE)), 6) AS total, round((1 - (CASE k WHEN 0 THEN 0 WHEN 4 THEN 1 ELSE (tanh(k / 4 * 4 - 2) + 1) / 2 END)) * a.embedding[1] + (CASE k WHEN 0 THEN 0 WHEN 4 THEN 1 ELSE (tanh(k / 4 * 4 - 2) + 1) / 2 END) * b.embedding[1], 6) AS first
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(5) t(k) WHERE a.vec_id < 50""")
def latent_paths(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pairs = df.where("vec_id < 50").join(df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    both = F.arrays_zip(sequences.interpolate(F.col("a"), F.col("b"), 3).alias("l"), sequences.interpolate(F.col("a"), F.col("b"), 3, "tanh").alias("t"))
    out = pairs.select("vec_id", F.posexplode(both).alias("step", "z"))
    return rounded(out.select("vec_id", F.col("step").cast("long").alias("step"), F.aggregate("z.l", F.lit(0.0), lambda s, x: s + x).alias("total"), F.col("z.t")[0].alias("first")), ["total", "first"])


@query("""SELECT vec_id, 0 AS step, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE vec_id < 20""")
def latent_cloud(spark, sf):
    out = sequences.cloud(table(spark, sf, "embeddings").where("vec_id < 20"), "vec_id", "embedding", 3, seed=5)
    return rounded(out.where("step = 0").select("vec_id", "step", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total")), ["total"])


@query("""SELECT count(*) AS n, count(*) FILTER (c_name = CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END) AS n_restored, round(avg((c_custkey % 4 <> 0)::INT), 6) AS accuracy FROM customer""")
def reconstruction(spark, sf):
    df = table(spark, sf, "customer").select("c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("r"))
    return rounded(sequences.reconstruction(df, "c_name", "r"), ["accuracy"])


@query("""SELECT count(*) AS n, count(*) FILTER (trim(s) = '' OR s IS NULL) AS n_empty, count(*) FILTER (trim(s) <> '') AS n_valid, count(DISTINCT trim(s)) FILTER (trim(s) <> '') AS n_unique, min(length(trim(s))) FILTER (trim(s) <> '') AS shortest, round(avg(length(trim(s))) FILTER (trim(s) <> ''), 6) AS mean_length, max(length(trim(s))) FILTER (trim(s) <> '') AS longest
FROM (SELECT CASE WHEN user_id % 5 = 0 THEN ' ' WHEN user_id % 7 = 0 THEN NULL ELSE ' ' || event_type END AS s FROM events)""")
def text_statistics(spark, sf):
    u = F.col("user_id")
    df = table(spark, sf, "events").select(F.when(u % 5 == 0, " ").when(u % 7 == 0, None).otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("s"))
    out = sequences.text_statistics(df, "s")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("shortest", "longest")}), ["mean_length"])


# Maps and places


@query("""WITH g AS (SELECT vec_id, label, greatest(0, least(9, floor((embedding[1]::DOUBLE + 0.5) * 10)))::INT * 10 + greatest(0, least(9, floor((embedding[2]::DOUBLE + 0.5) * 10)))::INT AS node, 0.75 AS r FROM embeddings UNION ALL SELECT vec_id, label, (vec_id % 100)::INT, 0.25 FROM embeddings)
SELECT node, round(sum(r), 6) AS density, round(sum(r * label) / sum(r), 6) AS mean_activity FROM g GROUP BY 1""")
def weighted_landscape(spark, sf):
    grid = _grid(spark, sf)
    r = grid.select("vec_id", (F.col("gx") * 10 + F.col("gy")).alias("node"), F.lit(0.75).alias("r")).unionByName(grid.select("vec_id", (F.col("vec_id") % 100).cast("int").alias("node"), F.lit(0.25).alias("r")))
    return rounded(maps.regression_landscape(r, grid.select("vec_id", "label"), "vec_id", "label").select("node", "density", "mean_activity"), ["density", "mean_activity"])


@query("""WITH g AS (SELECT vec_id, label, (vec_id % 20)::INT AS node, 0.5 AS r FROM embeddings UNION ALL SELECT vec_id, label, (vec_id % 7)::INT, 0.5 FROM embeddings), l AS (SELECT *, CASE WHEN label > 6 THEN 'active' ELSE 'inactive' END AS c FROM g),
d AS (SELECT node, sum(r) AS density, coalesce(sum(r) FILTER (c = 'active'), 0) AS a, coalesce(sum(r) FILTER (c = 'inactive'), 0) AS i FROM l GROUP BY 1)
SELECT node, round(density, 6) AS density, round(a, 6) AS active_density, round(i, 6) AS inactive_density, round(a / (a + i), 6) AS active_prob, round(i / (a + i), 6) AS inactive_prob FROM d""")
def weighted_classes(spark, sf):
    df = table(spark, sf, "embeddings")
    half = lambda m: df.select("vec_id", (F.col("vec_id") % m).cast("int").alias("node"), F.lit(0.5).alias("r"))
    names = df.select("vec_id", F.when(F.col("label") > 6, "active").otherwise("inactive").alias("c"))
    out = maps.class_landscape(half(20).unionByName(half(7)), names, "vec_id", "c", ["active", "inactive"])
    return rounded(out, [c for c in out.columns if c != "node"])


@query()
def map_fit(spark, sf):
    """A map of 6 x 6 nodes fitted on all vectors, its density and entropy."""
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    points, r = maps.project(df, "vec_id", "embedding", maps.fit(df, "embedding", 6, 3, rounds=8))
    return rounded(maps.density(r).join(F.broadcast(maps.entropy(r, 6))), ["density", "filtered_density", "entropy"], 3)


def _nodes(spark, sf):
    """Parts as a table of nodes: place, density and a landscape metric."""
    return table(spark, sf, "part").where("p_partkey <= 100").select(F.col("p_partkey").alias("nodes"), (F.col("p_partkey") % 10).cast("int").alias("x"), F.floor(F.col("p_partkey") / 10).cast("int").alias("y"), F.col("p_size").cast("double").alias("density"), (F.col("p_retailprice") / 1000).alias("active_prob"))


_NODES_SQL = "n AS (SELECT p_partkey AS nodes, (p_partkey % 10)::INT AS x, (p_partkey // 10)::INT AS y, p_size::DOUBLE AS density, p_retailprice / 1000 AS active_prob FROM part WHERE p_partkey <= 100)"


@query(f"WITH {_NODES_SQL} SELECT nodes, density FROM n WHERE density >= 20 ORDER BY density DESC, nodes LIMIT 7")
def dense_nodes(spark, sf):
    return maps.dense_nodes(_nodes(spark, sf), 7, 20)


@query(f"WITH {_NODES_SQL} SELECT nodes, round(active_prob, 6) AS active_prob FROM n ORDER BY active_prob, nodes LIMIT 4")
def landscape_nodes(spark, sf):
    return rounded(maps.landscape_nodes(_nodes(spark, sf), n=4, ascending=True), ["active_prob"])


@query("""SELECT s_suppkey, round(s_acctbal, 4) AS s_acctbal FROM supplier WHERE s_acctbal >= 100 ORDER BY s_acctbal DESC, s_suppkey LIMIT 9""")
def top_activity_rows(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return rounded(maps.top_rows(df, "s_acctbal", "s_suppkey", 9, 100), ["s_acctbal"], 4)


@query(f"WITH {_NODES_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, x, y FROM lineitem JOIN n ON l_partkey = nodes WHERE (x, y) IN ((1, 2), (3, 4), (5, 0))")
def rows_at_places(spark, sf):
    members, nodes = table(spark, sf, "lineitem").select(*LINE), _nodes(spark, sf)
    own = maps.sample_places(members.withColumnRenamed("l_partkey", "node_index"), nodes, [(1, 2), {"x": 3.2, "y": 3.8}, (5, 0)], "l_orderkey")
    return maps.with_places(own, nodes).select("l_orderkey", F.col("node_index").alias("l_partkey"), "l_suppkey", "l_linenumber", "x", "y")


@query(f"WITH {_NODES_SQL} SELECT l_partkey, least(count(*), 3) AS n FROM lineitem SEMI JOIN (SELECT nodes FROM n ORDER BY density DESC, nodes LIMIT 5) ON l_partkey = nodes GROUP BY 1")
def sampled_nodes(spark, sf):
    members = table(spark, sf, "lineitem").select(F.concat_ws("/", *LINE).alias("key"), F.col("l_partkey").alias("node_index"))
    return maps.sample_nodes(members, maps.dense_nodes(_nodes(spark, sf)), "key", 3, seed=2).groupBy(F.col("node_index").alias("l_partkey")).agg(F.count("*").alias("n"))


# Catalogs


def _models(spark, sf):
    """Suppliers as a catalog of models."""
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("production", "validated", "experimental", "robust_validated")]), (k % 4 + 1).cast("int"))
    nested = F.to_json(F.struct(
        F.struct((k % 10 / 10).alias("r2_mean"), F.lit(0.02).alias("r2_std")).alias("random"), F.struct(F.when(k % 3 > 0, k % 7 / 7).alias("r2")).alias("scaffold"), F.when(k % 5 == 0, "random").alias("hardest_split"),
    ))
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("model_id"), k.alias("at"), status.alias("status"), F.when(k % 2 == 0, "regression").otherwise("classification").alias("task_type"), F.when(k % 3 == 0, "trees").otherwise("graph").alias("backend_name"),
        F.when(k % 5 > 0, "ensemble").alias("uncertainty_method"), (k % 11 > 0).alias("path_exists"), (k % 2 == 0).alias("runtime_validated"), F.when(k % 13 == 0, "kinase").alias("not_recommended_for"), F.when(k % 6 == 0, "kinase inhibitors").otherwise("other").alias("target"),
        F.concat(F.lit("rep"), k % 4).alias("representation"), nested.alias("metrics"),
    )


@query("""WITH m AS (SELECT s_name AS model_id, s_suppkey AS k, (ARRAY['production', 'validated', 'experimental', 'robust_validated'])[s_suppkey % 4 + 1] AS status FROM supplier)
SELECT model_id, (50 + CASE WHEN k % 5 > 0 THEN 4 ELSE 0 END + CASE status WHEN 'production' THEN 12 WHEN 'validated' THEN 8 WHEN 'robust_validated' THEN 10 ELSE 4 END + CASE WHEN k % 6 = 0 THEN 25 WHEN k % 13 = 0 THEN -10 ELSE 0 END + 6 + CASE WHEN k % 3 = 0 THEN 10 ELSE -24 END + 8)::INT AS score, k % 3 = 0 AS runnable
FROM m WHERE status IN ('production', 'validated', 'robust_validated') AND k % 11 > 0 AND k % 2 = 0""")
def catalog_search(spark, sf):
    found = catalog.search(_models(spark, sf), "model_id", "regression", target="Kinase", backends=["trees"], target_text=["target"])
    return found.select("model_id", "score", "runnable")


@query("""WITH m AS (SELECT s_name AS model_id, s_suppkey AS k FROM supplier WHERE s_suppkey % 11 > 0 AND s_suppkey % 4 IN (0, 1, 3) AND s_suppkey % 2 = 0),
s AS (SELECT model_id, k, 50 + CASE WHEN k % 5 > 0 THEN 4 ELSE 0 END + CASE k % 4 WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 10 END + 6 + 8 AS score FROM m), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, model_id) AS n FROM s)
SELECT CASE WHEN n = 1 THEN 'selected' ELSE 'alternative' END AS role, model_id FROM r WHERE n <= 4 UNION ALL SELECT 'runnable', model_id FROM r WHERE n = 1""")
def catalog_recommend(spark, sf):
    return catalog.recommend(catalog.search(_models(spark, sf), "model_id", "regression"), "model_id")


@query("""WITH m AS (SELECT s_name AS model_id, s_suppkey AS k, (s_suppkey % 10 / 10)::DOUBLE AS rr, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 7 / 7 END AS sr FROM supplier)
SELECT model_id, round(rr, 6) AS random_r2, round(sr, 6) AS scaffold_r2, round(coalesce(CASE WHEN k % 5 = 0 THEN rr END, sr), 6) AS hardest_split_r2, CASE WHEN sr IS NOT NULL OR k % 5 = 0 THEN 'B' ELSE 'C' END AS tier, k % 6 = 0 AND k % 2 = 0 AND k % 11 > 0 AS compatible FROM m""")
def model_evidence(spark, sf):
    found = catalog.evidence(_models(spark, sf), "kinase", "regression")
    return rounded(found.select("model_id", "random_r2", "scaffold_r2", "hardest_split_r2", "tier", "compatible"), ["random_r2", "scaffold_r2", "hardest_split_r2"])


@query("""WITH m AS (SELECT s_name AS model_id, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'trees' ELSE 'graph' END || ':rep' || s_suppkey % 4 AS key, (s_suppkey % 10 / 10)::DOUBLE AS rr, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 7 / 7 END AS sr FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 11 > 0 AND s_suppkey % 6 = 0),
r AS (SELECT *, CASE WHEN sr IS NOT NULL OR k % 5 = 0 THEN 3 ELSE 2 END AS t, coalesce(CASE WHEN k % 5 = 0 THEN rr END, sr, rr) AS v, CASE k % 4 WHEN 0 THEN 4.0 WHEN 1 THEN 3.0 WHEN 2 THEN 1.5 ELSE 3.5 END AS w FROM m)
SELECT model_id FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC, v DESC, w DESC, model_id) = 1) ORDER BY t DESC, v DESC, w DESC, model_id LIMIT 3""")
def ensemble_components(spark, sf):
    return catalog.components(catalog.evidence(_models(spark, sf), "kinase", "regression"), 3).select("model_id")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def newest_first(spark, sf):
    df = table(spark, sf, "orders").withColumn("status", F.col("o_orderstatus"))
    return catalog.listing(df, "o_orderdate", "o_orderkey", "F", 20).select("o_orderkey", "o_orderstatus")


@query("""SELECT p_partkey, 'cmp_' || lpad((row_number() OVER (ORDER BY p_partkey))::VARCHAR, 3, '0') AS candidate_id, 'registered' AS state FROM part WHERE p_partkey <= 900 AND p_size > 25 UNION ALL SELECT p_partkey, NULL, 'rejected' FROM part WHERE p_partkey <= 900 AND p_size <= 25""")
def registered_candidates(spark, sf):
    df = table(spark, sf, "part").where("p_partkey <= 900").select("p_partkey", (F.col("p_size") > 25).alias("valid"))
    return session.register_candidates(df, "p_partkey", "valid", "p_partkey", "set_001").select("p_partkey", "candidate_id", "state")


@query("""SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part WHERE p_partkey <= 900 AND p_size > 25) WHERE r <= 12""")
def resolved_candidates(spark, sf):
    df = table(spark, sf, "part").where("p_partkey <= 900").select("p_partkey", (F.col("p_size") > 25).alias("valid"), F.lit(1).alias("created"))
    own = session.register_candidates(df, "p_partkey", "valid", "p_partkey", "set_001")
    return session.resolve_candidates(own, "the top 12 of them", "candidate_id").select("p_partkey")


# Splits and labels


@query("""SELECT CASE WHEN k < 2 THEN k ELSE NULL END AS repeat, s AS split, n FROM (SELECT count(*) AS t, round_even(count(*) * 0.2, 0)::BIGINT AS x FROM customer), LATERAL (VALUES (0, 'test', 4 * x), (1, 'test', 4 * x), (0, 'val', t - x), (1, 'val', t - x), (0, 'train', 3 * (t - x)), (1, 'train', 3 * (t - x))) v(k, s, n)""")
def outer_folds(spark, sf):
    out = splits.outer_folds(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 4, 2, 5, 0.2)
    return out.groupBy("repeat", "split").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer""")
def final_split(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey")
    return splits.final_split(df, "c_custkey", test=df.where("c_custkey % 5 = 0"))


@query()
def split_fingerprint(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"))
    return splits.split_hash(df, "c_custkey")


@query("""WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS tier FROM supplier)
SELECT 'baseline' AS variant, count(*) AS n FROM t UNION ALL SELECT 'without_high', count(*) FROM t WHERE tier <> 'high' UNION ALL SELECT 'without_high_medium', count(*) FROM t WHERE tier NOT IN ('high', 'medium') UNION ALL SELECT 'without_high_medium_low', count(*) FROM t WHERE tier = 'none'""")
def feedback_variants(spark, sf):
    k = F.col("s_suppkey") % 4
    df = table(spark, sf, "supplier").select("s_suppkey", F.when(k == 0, "high").when(k == 1, "medium").when(k == 2, "low").otherwise("none").alias("tier"))
    out = None
    for name, rows in splits.feedback_variants(df, "tier", least=1).items():
        one = rows.agg(F.lit(name).alias("variant"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH e AS (SELECT *, l_orderkey % 2 AS rep, 100 * abs((y - p) / y) AS ape FROM (SELECT *, sqrt(avg((y - p) ** 2) OVER (PARTITION BY l_orderkey % 2, fold)) AS r FROM (SELECT *, l_extendedprice AS y, l_quantity * 1000 AS p, l_orderkey % 5 AS fold FROM lineitem)) WHERE abs(y - p) > 2 * r)
SELECT rep, fold, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY rep, fold ORDER BY ape DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS k, count(*) OVER (PARTITION BY rep, fold) AS c FROM e) WHERE k <= ceil(c * 0.25) GROUP BY 1, 2""")
def outliers_by_fold(spark, sf):
    rows = _predicted(spark, sf).withColumn("rep", F.col("l_orderkey") % 2)
    return splits.fold_variants(rows, "rep", "fold", "y", "p", LINE).groupBy("rep", "fold").agg(F.count("*").alias("n"))


@query("""SELECT 'boost_fp' AS candidate_id, 'boost' AS backend, 'fp' AS representation, NULL::VARCHAR AS variant UNION ALL SELECT 'boost_desc', 'boost', 'desc', NULL UNION ALL SELECT 'net_graph_small', 'net', 'graph', 'small' UNION ALL SELECT 'net_graph_large', 'net', 'graph', 'large'""")
def expanded_candidates(spark, sf):
    return splits.candidates(spark, {"boost": ["fp", "desc"], "net": ["graph"]}, {"net": ["small", "large"]})


@query("""SELECT doc_id, quality AS code, CASE quality WHEN 0 THEN 'no' ELSE 'yes' END AS label, (quality >= 0.5)::INT AS decision FROM labels""")
def coded_labels(spark, sf):
    order = labels.sort_labels(["yes", "no"])
    text = F.when(F.col("quality") == 0, "no").otherwise("yes")
    rows = table(spark, sf, "labels").select("doc_id", labels.encode(text, order).alias("code"))
    return rows.select("doc_id", "code", labels.decode(F.col("code"), order).alias("label"), labels.decide(F.col("code"))[0].alias("decision"))


@query("""SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS p0, round(embedding[2]::DOUBLE, 6) AS p1 FROM embeddings WHERE label < 5""")
def parsed_probabilities(spark, sf):
    e = F.col("embedding").cast("array<double>")
    text = F.when(F.col("label") < 5, F.to_json(F.slice(e, 1, 2))).otherwise("[0.1, null]")
    out = table(spark, sf, "embeddings").select("vec_id", labels.parse_probabilities(text, 2).alias("p")).where("p is not null")
    return rounded(out.select("vec_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1")), ["p0", "p1"])


@query("""SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"x":' || CASE WHEN s_suppkey % 2 = 0 THEN 'null' ELSE '1.5' END || '}' AS json FROM supplier""")
def json_safe_rows(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, float("nan")).otherwise(1.5).alias("x"))
    return df.select("s_suppkey", labels.json_safe(df).alias("json"))


# Curation and retrieval


@query(f"""SELECT l_partkey, l_suppkey, count(*) AS n_rows, max(l_quantity) - min(l_quantity) AS spread, CASE WHEN max(l_quantity) - min(l_quantity) > 10 THEN 'removed' ELSE 'aggregated' END AS action, string_agg(l_orderkey || '/' || l_linenumber, ',' ORDER BY l_orderkey || '/' || l_linenumber) AS row_keys
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def audit_records(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("key", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    return curation.audit_records(df, ["l_partkey", "l_suppkey"], "l_quantity", 10.0, "key").drop("values")


@query("""SELECT p_brand, count(DISTINCT p_type) AS n_spellings, count(*) AS n_rows, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS spellings FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1 ORDER BY n_spellings DESC, p_brand LIMIT 10""")
def collapse_examples(spark, sf):
    return curation.collapse_examples(table(spark, sf, "part"), "p_brand", "p_type", 10)


@query("""SELECT count(*) AS n_rows, 0 AS n_empty, count(*) FILTER (c_custkey % 9 = 0) AS n_failed, count(*) FILTER (c_custkey % 9 > 0) AS n_valid, count(*) FILTER (c_custkey % 9 > 0 AND lower(c_name) <> c_name) AS n_changed, count(DISTINCT c_name) AS n_raw, count(DISTINCT lower(c_name)) FILTER (c_custkey % 9 > 0) AS n_standardized, 0 AS n_stereo_lost FROM customer""")
def standardization_summary(spark, sf):
    df = table(spark, sf, "customer").select("c_name", F.when(F.col("c_custkey") % 9 > 0, F.lower("c_name")).alias("std"))
    return curation.standardization_summary(df, "c_name", "std")


@query("""WITH a AS (SELECT p_partkey AS assay_id, p_name AS description, p_size % 25 AS target_id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS target_name FROM part), k AS (SELECT assay_id, coalesce(nullif(target_name, ''), n_name) AS target_name, n_name AS organism, description FROM a LEFT JOIN nation ON n_nationkey = target_id)
SELECT assay_id, target_name FROM k WHERE (regexp_matches(description, '(?i)red') OR regexp_matches(target_name, '(?i)red')) AND contains(lower(organism), 'a')""")
def retrieved_assays(spark, sf):
    assays = table(spark, sf, "part").select(F.col("p_partkey").alias("assay_id"), F.col("p_name").alias("description"), (F.col("p_size") % 25).alias("target_id"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")).alias("target_name"))
    targets = table(spark, sf, "nation").select(F.col("n_nationkey").alias("target_id"), F.col("n_name").alias("pref_name"), F.lit("T").alias("type"), F.col("n_name").alias("organism"))
    return readers.retrieve(assays.withColumns({"target_type": F.lit(None).cast("string"), "target_organism": F.lit(None).cast("string")}), targets, "red", "A").select("assay_id", "target_name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey AS assay_id, p_brand AS kind_assay FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45""")
def activities_of_assays(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("assay_id"), F.lit("x").alias("kind"))
    assays = table(spark, sf, "part").select(F.col("p_partkey").alias("assay_id"), F.col("p_brand").alias("kind"), F.when(F.col("p_size") > 45, "B").otherwise("F").alias("assay_type"))
    return readers.activities_of(lines, assays, readers.assay_types("binding")).select("l_orderkey", "l_linenumber", "assay_id", "kind_assay")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer""")
def paged_records(spark, sf):
    df, out = table(spark, sf, "customer").select("c_custkey"), None
    size = max(1, df.count() // 3)
    for part in readers.pages(df, ["c_custkey"], size):
        out = part if out is None else out.unionByName(part)
    return frame.with_row_id(out, ["c_custkey"], "place").select("c_custkey", "place")


def fetch_numbers(offset: int, limit: int, options: dict) -> list[dict]:
    return [{"id": k, "square": k * k} for k in range(offset, min(offset + limit, int(options["rows"])))]


def count_numbers(options: dict) -> int:
    return int(options["rows"])


@query("""SELECT i AS id, i * i AS square FROM range(257) t(i)""")
def paged_source(spark, sf):
    from tessera.sources.rest import Paged

    spark.dataSource.register(Paged)
    return spark.read.format("paged").schema("id long, square long").options(fetch="tessera.plans.more:fetch_numbers", count="tessera.plans.more:count_numbers", page=20, pages=3, rows=257).load()


@query("""SELECT user_id, event_id, event_type, 'k' || user_id % 4 AS keywords, user_id % 4 < 2 AS suspicious FROM events WHERE length('k' || user_id % 4) < 5""")
def short_keyword_rows(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.concat(F.lit("k"), F.col("user_id") % 4).alias("keywords"))
    return df.where(search.short_keywords_only(F.col("keywords"))).withColumn("suspicious", F.col("user_id") % 4 < 2)


@query("""WITH r AS (SELECT l_returnflag AS scope, l_suppkey AS value, l_partkey AS assay, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 1), f AS (SELECT scope, value, assay, min(l_orderkey * 10 + l_linenumber) AS o FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY scope, value ORDER BY o, assay) AS n FROM f)
SELECT scope, value, (SELECT count(*) FROM r WHERE r.scope = k.scope AND r.value = k.value) AS row_count, string_agg(assay, '|' ORDER BY n) FILTER (n <= 3) AS assays FROM k GROUP BY scope, value""")
def judge_items(spark, sf):
    df = table(spark, sf, "lineitem").where("l_quantity = 1").select(F.col("l_returnflag").alias("scope"), F.col("l_suppkey").alias("value"), F.col("l_partkey").cast("string").alias("assay"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return search.judge_items(df, ["scope", "value"], {"assays": ("assay", 3)}, "o").select("scope", "value", "row_count", "assays")


@query("""WITH d AS (SELECT user_id, event_id, event_type, user_id % 4 AS g FROM events), j AS (SELECT g, g < 1 AS reject, 'reason ' || g AS reason FROM (SELECT DISTINCT g FROM d) WHERE g < 3)
SELECT event_id, CASE WHEN coalesce(reject, false) THEN 'rejected' ELSE 'retained' END AS decision, reason FROM d LEFT JOIN j USING (g)""")
def judged_rows(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("g"))
    decisions = df.select("g").distinct().where("g < 3").select("g", (F.col("g") < 1).alias("reject"), F.concat(F.lit("reason "), F.col("g")).alias("reason"))
    return search.judged(df, decisions, ["g"]).select("event_id", "decision", "reason")


@query("""SELECT conv_id, count(*) AS n, sum(length(text)) AS n_chars FROM conversations GROUP BY 1""")
def accumulated_chunks(spark, sf):
    return search.chunk_totals(table(spark, sf, "conversations"), "conv_id", "text")


@query("""WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, max(ts) AS last_seen, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 90 SECOND AS stale FROM events GROUP BY 1""")
def stale_workers(spark, sf):
    from tessera.streaming import windows

    df = table(spark, sf, "events")
    return windows.stale(df, "user_id", "ts", 90)


@query("""SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS window_start FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, sf):
    from tessera.plans.queries import _events
    from tessera.plans.storage import shared_folder
    from tessera.streaming import windows

    path = shared_folder(spark, "stream")
    windows.run_complete(windows.sliding(_events(spark, sf), "12 hours", "6 hours"), f"{path}/out", f"{path}/progress")
    return rounded(spark.read.parquet(f"{path}/out"), ["total"], 4).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Models without SQL


@query()
def class_predictions(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.length("text").cast("double").alias("n"), "lang").join(table(spark, sf, "labels"), "doc_id").withColumn("quality", F.when(F.col("quality") == 1, "yes").otherwise("no"))
    out = models.Boosted(["n", "lang"], "quality", "classification", ["lang"], seed=3, rounds=5).fit(df, order="doc_id").predict(df)
    return rounded(out.select("doc_id", "prediction", "prediction_code", "probability_yes"), ["probability_yes"], 4)


@query()
def external_evaluation(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), (F.col("p_partkey") % 100).cast("double").alias("k"), "p_retailprice")
    model = models.Boosted(["s", "k"], "p_retailprice", seed=2, rounds=5).fit(df.where("p_partkey % 4 > 0"))
    return rounded(models.external(model, df.where("p_partkey % 4 = 0"))[1], ["mse", "mae", "rmse", "r2", "rae"], 3)


@query()
def cluster_split_keys(spark, sf):
    return splits.cluster_keys(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 5).groupBy("cluster").agg(F.count("*").alias("n"))


