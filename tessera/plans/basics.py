"""Queries over sources and sinks, the command interpreter, kernels, composites and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import labels, registry, scalars
from tessera.operators import catalog, composites, frame, landscape, search, session, splits, structures
from tessera.plans.queries import query, rounded, table
from tessera.plans.storage import shared_folder
from tessera.sources import readers
from tessera.streaming import windows

# Sources and sinks


@query("""SELECT p_partkey, p_name, p_brand, p_size, round(p_retailprice, 2) AS p_retailprice FROM part""")
def csv_round_trip(spark, sf):
    path = f"{shared_folder(spark, 'csv')}/t.csv"
    readers.save(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    return rounded(readers.load(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long")), ["p_retailprice"], 2)


@query("""SELECT p_partkey, p_brand, p_size FROM part""")
def tsv_without_index(spark, sf):
    """A tab-separated file with a written index, whose separator is found and whose index is dropped."""
    path = f"{shared_folder(spark, 'tsv')}/t.tsv"
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("Unnamed: 0"), "p_partkey", "p_brand", "p_size")
    df.write.option("header", True).option("sep", "\t").csv(path)
    return readers.load(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("""SELECT s_suppkey, s_name AS name, s_nationkey AS nation, round(s_acctbal, 2) AS balance FROM supplier""")
def nested_json(spark, sf):
    path = f"{shared_folder(spark, 'json')}/t.json"
    nested = F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")).alias("of"))
    readers.save(table(spark, sf, "supplier").select("s_suppkey", nested.alias("a")), path)
    back = readers.read_json(spark, path, multiline=False)
    out = back.select("s_suppkey", F.col("`a.name`").alias("name"), F.col("`a.of.nation`").cast("int").alias("nation"), F.col("`a.of.balance`").alias("balance"))
    return rounded(out, ["balance"], 2)


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0""")
def columnar_round_trip(spark, sf):
    base = shared_folder(spark, "columnar")
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    readers.save(df, f"{base}/t.parquet")
    readers.save(readers.load(spark, f"{base}/t.parquet").where("c_custkey % 3 = 0"), f"{base}/t.orc")
    return readers.load(spark, f"{base}/t.orc")


@query("""SELECT 1 AS id, 'a' AS name, 0.5::DOUBLE AS x UNION ALL SELECT 2, NULL, 1.5""")
def literal_records(spark, sf):
    return readers.from_records(spark, [{"id": 1, "name": "a", "x": 0.5}, {"x": 1.5, "id": 2}], "id int, name string, x double")


@query("""SELECT split, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM orders) GROUP BY 1""")
def split_folders(spark, sf):
    path = f"{shared_folder(spark, 'splits')}/orders"
    splits.write_split(table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("""SELECT s_name AS model_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier WHERE s_suppkey <= 20""")
def catalog_document(spark, sf):
    path = f"{shared_folder(spark, 'catalog')}/catalog.json"
    models = table(spark, sf, "supplier").where("s_suppkey <= 20").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: F.struct(s["s_name"].alias("model_id"))).alias("models"))
    models.coalesce(1).write.json(path)
    return readers.read_catalog(spark, path).select("model_id", F.col("position").cast("long").alias("position"))


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def journal_stream(spark, sf):
    """A journal of JSON lines read as a stream."""
    base = shared_folder(spark, "journal")
    table(spark, sf, "events").select("event_id", "event_type").write.json(f"{base}/in")
    counts = windows.journal(spark, f"{base}/in", "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))
    windows.run_complete(counts, f"{base}/out", f"{base}/progress")
    return spark.read.parquet(f"{base}/out")


@query("""SELECT o_orderstatus AS kind, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1""")
def session_frames(spark, sf):
    state = session.Session()
    state.put("results.orders", table(spark, sf, "orders"))
    rows = state.get(spark, "results").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.avg("o_totalprice").alias("mean"))
    return rounded(rows, ["mean"], 2)


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 5 OR s_suppkey <= 3""")
def jdbc_like_query(spark, sf):
    """What a database reader pushes down: a filter and two columns."""
    return readers.page(table(spark, sf, "supplier"), "s_nationkey = 5 OR s_suppkey <= 3", ["s_suppkey", "s_name"])


@query("""SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7""")
def fetch_up_to(spark, sf):
    return readers.page(table(spark, sf, "customer"), fields=["c_custkey"], sort=[F.desc("c_acctbal"), F.asc("c_custkey")], limit=7)


# The interpreter


@query("""SELECT p_partkey, p_brand AS brand, coalesce(nullif(p_size, 1), 0) AS size FROM part WHERE p_size <= 10 ORDER BY p_partkey LIMIT 30""")
def frame_commands(spark, sf):
    frames = frame.Frames(spark)
    frames.put("part", table(spark, sf, "part").withColumn("p_size", F.nullif("p_size", F.lit(1))))
    name = frames.run("part", "query", expr="p_size <= 10 or p_size.isnull()".replace("p_size.isnull()", "p_size IS NULL"))
    for command, a in (("select", {"columns": "['p_partkey', 'p_brand', 'p_size']"}), ("rename", {"columns": {"p_brand": "brand", "p_size": "size"}}), ("fillna", {"value": 0, "column": "size"}), ("sort_by", {"by": "p_partkey"}), ("head", {"n": 30, "order": "p_partkey"})):
        name = frames.run(name, command, **a)
    return frames.get(name)


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey <> 3 ORDER BY s_suppkey DESC LIMIT 4""")
def frame_tail(spark, sf):
    frames = frame.Frames(spark)
    frames.put("s", table(spark, sf, "supplier").withColumn("k", F.when(F.col("s_nationkey") != 3, F.col("s_nationkey"))))
    name = frames.run(frames.run("s", "dropna", subset="k"), "drop", columns="k")
    return frames.get(frames.run(frames.run(name, "tail", n=4, order="s_suppkey"), "select", items=["s_suppkey", "s_name"]))


@query("""SELECT round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, sum(l_quantity) AS sum, round(stddev_samp(l_quantity), 6) AS std, round(var_samp(l_quantity), 6) AS var, count(l_quantity) AS count, count(DISTINCT l_quantity) AS nunique FROM lineitem""")
def series_reductions(spark, sf):
    frames, out = frame.Frames(spark), None
    frames.put("l", table(spark, sf, "lineitem").select("l_quantity"))
    for how in ("mean", "median", "min", "max", "sum", "std", "var", "count", "nunique"):
        one = frames.get(frames.run("l", how, column="l_quantity")).withColumnRenamed("l_quantity", how)
        out = one if out is None else out.join(F.broadcast(one))
    return rounded(out, ["mean", "std", "var"])


@query("""SELECT round(avg(c_acctbal), 6) AS c_acctbal, round(avg(c_custkey), 6) AS c_custkey, round(avg(c_nationkey), 6) AS c_nationkey FROM customer""")
def numeric_means(spark, sf):
    frames = frame.Frames(spark)
    frames.put("c", table(spark, sf, "customer"))
    return rounded(frames.get(frames.run("c", "mean")), ["c_acctbal", "c_custkey", "c_nationkey"])


@query("""SELECT count(*) AS n FROM (SELECT 1 FROM customer LIMIT 25)""")
def seeded_sample(spark, sf):
    return frame.sample(table(spark, sf, "customer"), ["c_custkey"], 25, seed=3).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT count(*) AS k FROM (SELECT DISTINCT s_nationkey FROM supplier)) SELECT least(k, 4) AS n FROM g""")
def sampled_grid_nodes(spark, sf):
    nodes = table(spark, sf, "supplier").select("s_nationkey").distinct()
    return landscape.sample(nodes, "s_nationkey", 4, 1).agg(F.count("*").alias("n"))


# Scalars and kernels


@query("""WITH d AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: abs(x::DOUBLE)) AS a, list_transform(b.embedding, lambda x: abs(x::DOUBLE)) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT vec_id, list_dot_product(a, b) AS ab, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb FROM d)
SELECT vec_id, round(ab / (aa + bb - ab), 6) AS tanimoto, round(2 * ab / (aa + bb), 6) AS dice, round(ab / (ab + 0.3 * (aa - ab) + 0.7 * (bb - ab)), 6) AS tversky, round(ab / sqrt(aa * bb), 6) AS cosine FROM s""")
def similarity_record(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    pairs = df.join(df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    out = pairs.select("vec_id", scalars.tanimoto(a, b).alias("tanimoto"), scalars.dice(a, b).alias("dice"), scalars.tversky(a, b, 0.3, 0.7).alias("tversky"), scalars.cosine(a, b).alias("cosine"))
    return rounded(out, ["tanimoto", "dice", "tversky", "cosine"])


_CHAIN_SQL = "(SELECT p_partkey, p_size, repeat('C', p_size) || CASE WHEN p_partkey % 3 = 0 THEN 'O' WHEN p_partkey % 3 = 1 THEN '.[Na+]' ELSE '(' END AS s FROM part)"


def _chains(spark, sf):
    """Alkanes as line notations: every third an alcohol, every third a salt, every third broken."""
    k = F.col("p_partkey") % 3
    return table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.repeat(F.lit("C"), F.col("p_size")), F.when(k == 0, "O").when(k == 1, ".[Na+]").otherwise("(")).alias("s"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN round(12.011 * p_size + 1.008 * (2 * p_size + 2) + CASE p_partkey % 3 WHEN 0 THEN 15.999 ELSE 22.990 END, 3) END AS weight, CASE WHEN p_partkey % 3 = 1 THEN repeat('C', p_size) WHEN p_partkey % 3 = 0 THEN s END AS standard, p_partkey % 3 = 2 AS failed FROM {_CHAIN_SQL}""")
def structure_kernels(spark, sf):
    df = _chains(spark, sf).select("p_partkey", structures.apply("weight", F.col("s")).alias("w"), structures.apply("standardize", F.col("s")).alias("t"))
    return rounded(df.select("p_partkey", F.col("w.value").alias("weight"), F.col("t.value").alias("standard"), F.col("w.error").isNotNull().alias("failed")), ["weight"], 3)


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 0 END AS markers, p_partkey % 3 < 2 AS stereo FROM part""")
def stereo_markers(spark, sf):
    k = F.col("p_partkey") % 3
    c = F.when(k == 0, r"F/C=C\C[C@@H]").when(k == 1, "C[C@H]").otherwise("CC")
    return table(spark, sf, "part").select("p_partkey", structures.stereo_markers(c).alias("markers"), structures.has_stereo(c).alias("stereo"))


@query(f"""WITH c AS (SELECT * FROM {_CHAIN_SQL} WHERE p_partkey % 3 < 2), k AS (SELECT p_size, p_partkey % 3 AS r, count(*) FILTER (p_partkey > 0) AS n, median(CASE WHEN p_partkey > 0 THEN -log10(p_partkey * 1e-9) END) AS m FROM c GROUP BY 1, 2)
SELECT repeat('C', p_size) || CASE r WHEN 0 THEN 'O' ELSE '' END AS smiles, n AS n_activity, round(m, 6) AS activity_final FROM k""")
def clean_dataset(spark, sf):
    df = _chains(spark, sf).select("p_partkey", F.col("s").alias("smiles"), F.col("p_partkey").cast("string").alias("IC50_nM"))
    return rounded(composites.clean(df, "p_partkey")[0].select("smiles", "n_activity", "activity_final"), ["activity_final"])


@query(f"""WITH c AS (SELECT repeat('C', p_size) || CASE p_partkey % 3 WHEN 0 THEN 'O' ELSE '' END AS s, p_partkey, p_retailprice / 100 AS y FROM {_CHAIN_SQL} JOIN part USING (p_partkey, p_size) WHERE p_partkey % 3 < 2)
SELECT s, round(avg(y), 6) AS y, min(p_partkey) AS p_partkey, count(*) AS n_rows FROM c GROUP BY 1 HAVING max(y) - min(y) <= 9""")
def curated_dataset(spark, sf):
    price = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("y"))
    df = _chains(spark, sf).join(price, "p_partkey").select("p_partkey", "s", "y")
    return rounded(composites.curate(df, "regression", "s", "y", "p_partkey", 9.0)[0].select("s", "y", "p_partkey", "n_rows"), ["y"])


@query(f"""SELECT 'NO_SCAFFOLD' AS scaffold, count(*) AS count FROM {_CHAIN_SQL}""")
def scaffold_counts(spark, sf):
    return composites.scaffold_counts(_chains(spark, sf), "s")


@query("""SELECT doc_id, len(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?')) AS numbers FROM documents""")
def numbers_in_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(search.extracted(F.col("text"), "numbers")).cast("long").alias("numbers"))


@query("""WITH e AS (SELECT event_type, user_id % 3 AS pos, round(avg(value), 2) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2), m AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY 1) SELECT round(avg(greatest(0, 1 - s / abs(m))), 6) AS consistency FROM m""")
def numeric_consistency(spark, sf):
    by = table(spark, sf, "events").where("event_type in ('click', 'view')").groupBy("event_type", (F.col("user_id") % 3).alias("pos")).agg(F.round(F.avg("value"), 2).alias("v"))
    text = by.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"].cast("decimal(12,2)").cast("string")), " and ").alias("t"))
    return rounded(search.numeric_consistency(text, "event_type", "t"), ["consistency"])


@query("""SELECT list_sort(list(DISTINCT l)) AS labels FROM (SELECT CASE quality WHEN 0 THEN 'no' ELSE 'yes' END AS l FROM labels)""")
def label_set(spark, sf):
    df = table(spark, sf, "labels").select(F.when(F.col("quality") == 0, "no").otherwise("yes").alias("l"))
    return spark.createDataFrame([(labels.class_labels(df, "l"),)], "labels array<string>")


@query("""SELECT coalesce(l_returnflag, 'all') AS l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS q, max(l_tax) AS t FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag))""")
def metrics_by_argument(spark, sf):
    out = registry.metrics_by(table(spark, sf, "lineitem"), "l_returnflag", lambda: [F.avg("l_quantity").alias("q"), F.max("l_tax").alias("t")])
    return rounded(out, ["q"])


@query("""WITH a AS (SELECT p_partkey AS assay_id, p_name AS d, p_size % 25 AS t FROM part), k AS (SELECT assay_id, CASE WHEN regexp_matches(d, '(?i)red') THEN 'red' END AS x, CASE WHEN regexp_matches(d, '(?i)blue') THEN 'blue' END AS y FROM a)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS assay_id, concat_ws('|', y, x) AS query_keywords FROM lineitem JOIN k ON assay_id = l_partkey WHERE coalesce(x, y) IS NOT NULL""")
def retrieved_compounds(spark, sf):
    assays = table(spark, sf, "part").select(F.col("p_partkey").alias("assay_id"), F.col("p_name").alias("description"), (F.col("p_size") % 25).alias("target_id"))
    assays = assays.withColumns({c: F.lit(None).cast("string") for c in ("target_name", "target_type", "target_organism")})
    targets = table(spark, sf, "nation").select(F.col("n_nationkey").alias("target_id"), F.col("n_name").alias("pref_name"), F.lit("T").alias("type"), F.col("n_name").alias("organism"))
    lines = table(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("activity_id"), "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("assay_id"))
    out = composites.retrieve_compounds(assays, targets, lines, ["red", "blue"])
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "assay_id", "query_keywords")


@query("""SELECT s_suppkey, 'v' || s_suppkey % 3 AS tier FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'none' FROM supplier WHERE s_suppkey % 2 = 1""")
def tier_lookup(spark, sf):
    from tessera.operators import align

    df = table(spark, sf, "supplier").select("s_suppkey")
    tiers = df.where("s_suppkey % 2 = 0").withColumn("tier", F.concat(F.lit("v"), F.col("s_suppkey") % 3))
    return align.lookup(df, tiers, "s_suppkey", "tier", "none")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CASE WHEN s_acctbal > 0 THEN 'in_domain' ELSE 'out_of_domain' END END AS ad_status, s_suppkey % 4 <> 0 AND NOT s_acctbal > 0 AS ad_out_of_domain FROM supplier""")
def attached_statuses(spark, sf):
    from tessera.operators import align

    df = table(spark, sf, "supplier")
    states = df.select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.when(F.col("s_acctbal") > 0, "in_domain").otherwise("out_of_domain")).alias("ad_status"))
    return align.attach_statuses(df.select("s_suppkey"), states, ["s_suppkey"], ["s_suppkey"])


@query("""SELECT name, kind FROM (VALUES ('a.png', 'plot'), ('b.json', 'other')) t(name, kind)""")
def artifact_listing(spark, sf):
    base = shared_folder(spark, "artifacts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in ("a.png", "b.json"):
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.writeBytes(name)  # empty files are not listed
        out.close()
    return catalog.files(spark, base, kinds={"plot": r"\.png$"}).select("name", "kind")
