"""Literal frames with known results: schemas, alignment, domains, maps, catalogs, sessions, sequences, splits and sources."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import labels
from tessera.operators import align, catalog, domains, evaluation, maps, models, schema, search, sequences, session, similarity, splits
from tessera.plans.ship import ship
from tessera.sources import readers


def test_activity_mappings(spark):
    ic50 = spark.createDataFrame([("C", 10.0), ("CC", 100.0)], "canonical_smiles string, IC50_nM double")
    m = schema.infer(ic50)
    assert (m.activity_column, m.detected_units, m.activity_semantics, m.endpoint, m.smiles_column) == ("IC50_nM", "nm", "lower_is_better", "IC50", "canonical_smiles")
    assert [round(r.activity, 6) for r in schema.with_activity(ic50, m).collect()] == [8.0, 7.0]
    label = spark.createDataFrame([("C", "Active"), ("CC", "inactive")], "SMILES string, label string")
    m = schema.infer(label)
    assert (m.activity_kind, m.activity_column) == ("classification", "label") and [r.activity for r in schema.with_activity(label, m).collect()] == ["active", "inactive"]
    p = spark.createDataFrame([("CCO", 6.1, "M1"), ("CCN", 8.2, "M2"), ("CCN", 5.0, "M3"), (None, 9.0, "M4"), ("CCC", None, "M5")], "smi string, pchembl_value double, molecule_chembl_id string")
    m = schema.infer(p)
    assert (m.source_format, m.score_name, m.molecule_id_column) == ("chembl", "pchembl_value", "molecule_chembl_id")
    rows = schema.preview(p, m).collect()
    assert [(r.smiles, r.best) for r in rows] == [("CCN", 8.2), ("CCO", 6.1), ("CCC", None)] and '"score":8.2' in rows[0].activity
    nothing = spark.createDataFrame([("CCO", "x"), ("CCN", "y")], "smiles string, note string")
    assert schema.infer(nothing).activity_column is None and schema.preview(nothing).count() == 2
    assert schema.infer(ic50, activity="IC50_nM").score_name == "activity_score"
    units = spark.createDataFrame([("C", "5", "uM"), ("CC", "x", "nM")], "smiles string, potency string, units string")
    assert [r.activity for r in schema.with_activity(units).collect()] == [pytest.approx(5.30103), None]
    assert schema.constant_unit(units, "units") == "mixed" and schema.constant_unit(units, "none") is None
    assert schema.resolve_structure(["a", "Canonical_SMILES"], "canonical_smiles") == "Canonical_SMILES" and schema.structure_column(["my_smiles_x"]) == "my_smiles_x"
    assert schema.units_in_name("IC50 (µM)") == "um" and schema.units_in_name("Enm") is None and schema.endpoint_of("log_ki_x") == "Ki"


def test_column_roles(spark):
    df = spark.createDataFrame([("C", 1.0, 2, "a", True, 0.5)], "smiles string, y double, fp_0 int, kind string, activity_cliff_flag boolean, activity_cliff_score double")
    assert schema.feature_columns(df, ["y"], "smiles") == ["fp_0"] and schema.strip_prefix(df).columns == ["smiles", "y", "fp_0", "kind"]
    with pytest.raises(ValueError, match="no features"):
        schema.feature_columns(df, ["y"], wanted=["activity_cliff_score"])
    assert schema.model_columns(df, "regression")["target_columns"] == ["y"]
    many = spark.createDataFrame([(k, f"s{k}", "x" if k % 2 else " ", k % 2) for k in range(30)], "id int, Drug string, blank string, cls int")
    assert schema.model_columns(many, "classification") == {"task_type": "classification", "smiles_column": "Drug", "target_columns": ["cls"], "all_columns": many.columns, "ready": True}
    assert schema.measurement_context(["assay_id", "ph", "replicate_2", "x"]) == {"assay_columns": ["assay_id"], "ph_columns": ["ph"], "replicate_columns": ["replicate_2"]}
    assert schema.class_columns(["a_prob", "b_prob", "b_density", "a_density", "density"])["second_prob"] == "b_prob"
    assert schema.feature_kind("cfp_1") == "morgan_count" and schema.schema_hash(["a"]) != schema.schema_hash(["b"]) and schema.target_unit(["x", "LogP"]) == "unitless_log_scale"
    assert schema.with_source(df, "f").first().source == "f" and schema.compact(df.withColumn("v", F.array(F.lit(1)))).columns == df.columns
    pts = schema.projected_points(spark.createDataFrame([("1", "2", "C")], "x string, y string, smiles string"))
    assert pts.first().asDict() == {"x": 1.0, "y": 2.0, "smi": "C", "source": "projected_compounds"} and schema.grid_size(pts) == 4


def test_strict_joins_and_positions(spark):
    base = spark.createDataFrame([("CCO", 1.0), ("CCN", 2.0)], "SMILES string, Y double")
    features = spark.createDataFrame([("CCN", 5), ("CCO", 4)], "SMILES string, f int")
    assert {r.SMILES: r.f for r in align.join_features(base, [features], ["SMILES"]).collect()} == {"CCO": 4, "CCN": 5}
    for bad, text in ((features.union(features), "repeated"), (features.where("f = 4"), "lacks"), (features.withColumn("Y", F.lit(1)), "repeats columns")):
        with pytest.raises(align.KeyProblem, match=text):
            align.join_features(base, [bad], ["SMILES"], drop_repeated=False)
    with pytest.raises(align.KeyProblem, match="canonical"):
        align.canonical_keys(base, {"SMILES": lambda c: F.when(c == "CCO", c)})
    rows = spark.createDataFrame([(5, 1.0), (7, 2.0), (9, 3.0)], "id long, y double")
    states = spark.createDataFrame([(0, "in_domain"), (1, "out_of_domain"), (2, None)], "k long, ad_status string")
    got = align.attach_statuses(rows, states, ["id"], ["k"]).orderBy("id").collect()
    assert [(r.ad_status, r.ad_out_of_domain) for r in got] == [("in_domain", False), ("out_of_domain", True), (None, False)]
    assert not any(r.ad_out_of_domain for r in align.attach_statuses(rows, states.limit(1), ["id"], ["k"]).collect())
    with pytest.raises(align.KeyProblem, match="1 values for 3 rows"):
        align.attach(rows, states.limit(1), ["id"], ["k"])
    scored, by = align.attach_scores(rows.withColumn("p", F.col("y") + 1), states.withColumnRenamed("ad_status", "status"), ["id"], ["k"], "y", "p")
    assert {r.status: r.n for r in by.collect()} == {"all": 3, "in_domain": 1, "out_of_domain": 1, None: 1} and scored.count() == 3
    assert align.lookup(rows, spark.createDataFrame([(5, "b"), (5, "a")], "id long, tier string"), "id", "tier", "none").where("tier = 'a'").count() == 1
    assert align.side_by_side(rows, [rows.withColumn("z", F.lit(1)).drop("y")], "id").columns == ["id", "y", "z"]
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (0, " ")], "o int, c string")
    assert {r.c: r.code for r in align.first_seen_codes(train, spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string"), "c", "o").collect()} == {"a": 1, "b": 0, "z": -1, None: -1}


def test_domains(spark):
    rng = np.random.default_rng(1)
    inside = [(i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(300)]
    train = spark.createDataFrame(inside, "id long, v array<double>")
    asked = spark.createDataFrame([(1000, [0.1, 0.0, 0.0]), (1001, [9.0, 9.0, 9.0]), (1002, [float("nan"), 0.0, 0.0]), (1003, None)], "id long, v array<double>")
    forest = domains.fit_forest(train, "id", "v", seed=2)
    got = {r.id: r for r in domains.score_forest(asked, "id", "v", forest).collect()}
    assert (got[1000].status, got[1001].status, got[1002].status, got[1003].status) == ("in_domain", "out_of_domain", "invalid_features", "invalid_features")
    assert -1 <= got[1001].score < got[1000].score <= 0 and got[1001].decision < 0
    again = domains.fit_forest(train.repartition(7), "id", "v", seed=2)
    assert np.allclose(forest.score(np.eye(3)), again.score(np.eye(3)))
    domain = domains.Domain(train, "id", "v", ["a", "b", "c"], measure="euclidean")
    r = {x.id: x for x in domain.score(asked.where("id < 1002")).collect()}
    assert r[1000].status == "in_domain" and r[1001].status == "out_of_domain" and r[1001].methods_out == "bounding_box;isolation_forest;similarity_matrix" and r[1001].violating == "a;b;c"
    assert {x.status for x in domain.score(asked, ["a", "b"]).collect()} == {"schema_mismatch"} and {x.status for x in domain.score(asked).collect()} >= {"invalid_features"}
    t = domains.support_threshold(train, "id", "v", measure="euclidean").first()
    own = np.array([v for _, v in inside])
    d = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert t.threshold == pytest.approx(np.percentile(1 / (1 + np.sort(d, axis=1)[:, :5].mean(1)), 5), abs=1e-6) and t.n_train == 300
    box = similarity.fit_box(spark.createDataFrame([(1, [1, 0]), (2, [1, 1])], "id long, v array<int>"), "v")
    assert similarity.score_box(spark.createDataFrame([(3, [0, 1])], "id long, v array<int>"), "id", "v", box, ["fp_0", "fp_1"]).first().violating == "fp_0"


def test_nodes_and_places(spark):
    density = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.9, 2.0), (3, 0.8, 9.0)], "nodes long, filtered_density double, density double")
    assert [r.nodes for r in maps.dense_nodes(density, 2).collect()] == [2, 3] and [r.nodes for r in maps.dense_nodes(density, 1, filtered=False).collect()] == [3]
    probs = spark.createDataFrame([(10, 0.9, 0.1), (20, 0.8, 0.5), (30, 0.1, 0.9)], "nodes long, potency_prob double, selectivity_prob double")
    assert maps.metric_column(probs) == "potency_prob" and [r.nodes for r in maps.landscape_nodes(probs, n=2).collect()] == [10, 20]
    with pytest.raises(ValueError, match="no metric"):
        maps.landscape_nodes(probs, "pic50")
    mols = spark.createDataFrame([(5, "a", "5.1"), (5, "b", "8.4"), (6, "c", "6.7"), (7, "d", "x")], "node_index long, smi string, activity_final string")
    assert [r.smi for r in maps.top_rows(mols, "activity_final", "smi", 5).collect()] == ["b", "c", "a"]
    table = spark.createDataFrame([(0, 0, 5), (2, 2, 6), (0, 0, 5)], "x int, y int, nodes long")
    assert maps.node_at(table, 2, 2) == "6" and maps.node_tables(table)[1].count() == 2
    with pytest.raises(ValueError, match="no node at"):
        maps.node_at(table, 9, 9)
    with pytest.raises(ValueError, match="whole numbers"):
        maps.node_at(table, 0.5, 1)
    assert maps.sample_places(mols, table, [(0, 0)], "smi", 1).count() == 1 and maps.sample_places(mols, table, [(0.1, 0), (9, 9)], "smi", allow_missing=True).count() == 2
    with pytest.raises(ValueError, match="no nodes"):
        maps.sample_places(mols, table, [(9, 9)], "smi")
    assert [(r.x, r.y) for r in maps.with_places(mols, table).orderBy("smi").collect()] == [(0, 0), (0, 0), (2, 2), (None, None)]
    assert maps.density_at(density, 3) == 9.0 and maps.landscape_table(probs)[1] == "classification"
    with pytest.raises(ValueError, match="column nodes"):
        maps.landscape_table(mols)


def test_map_finds_two_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(6 * (i % 2), 1, 5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    model = maps.fit(df, "v", 5, 3, rounds=6)
    points, r = maps.project(df, "id", "v", model)
    side = {0: set(), 1: set()}
    for p in points.collect():
        side[p.id % 2].add(p.node)
    assert not side[0] & side[1]
    assert r.groupBy("id").agg(F.sum("r").alias("s")).agg(F.min("s"), F.max("s")).first()[0] > 0.95
    assert 0 < maps.entropy(r, 5).first().entropy < 1 and maps.ruggedness(maps.density(r), "density", 5).first().ruggedness > 0
    y = df.select("id", (F.col("id") % 2).cast("double").alias("y"))
    low = maps.regression_landscape(r, y, "id", "y").agg(F.min("mean_activity"), F.max("mean_activity")).first()
    assert low[0] < 0.05 and low[1] > 0.95
    assert maps.preservation(df, points, "id", "v", 5).count() > 100
    groups = maps.landscapes_by_group(r, df.select("id", (F.col("id") % 2).alias("a"), F.lit(1).alias("b")), "id", ["a", "b"])
    assert {x.group for x in groups.collect()} == {"a", "b"}
    assert maps.grid(1000, "heuristic")["nodes"] == [15] and len(maps.grid(1000)["nodes"]) == 3
    best, tried = maps.optimize(df, "id", "v", most=2)
    assert len(tried) == 2 and isinstance(best, maps.Map)


def test_catalogs(spark, tmp_path):
    assert catalog.model_id("Ki / A", "data", "std", "gb", None, "2", datetime.datetime(2024, 5, 6, 7, 8, 9)) == "ki___a_data_std_gb_v2_06052024_070809"
    known = spark.createDataFrame([("m", "/a"), ("m_x", "/b")], "model_id string, model_path string")
    assert catalog.free_id("new", "/z", "o", known) == "new" and catalog.free_id("m", "/a", "o", known) == "m"
    second = catalog.free_id("m", "/z", "o", known)
    assert second.startswith("m_") and len(second) == 12
    assert catalog.free_id("m", "/z", "o", known.union(spark.createDataFrame([(second, "/q"), (f"{second}_2", "/r")], known.schema))) == f"{second}_3"
    t, at = catalog.path_parts(F.col("p"))
    paths = spark.createDataFrame([("robustness_tests/chembl/20251231_103045/results.json",), ("tests/robustness/reports/20251231_103045/results.json",), ("x/y",)], "p string")
    assert [tuple(r) for r in paths.select(t, at).collect()] == [("chembl", "20251231_103045"), ("unknown", "20251231_103045"), (None, None)]
    times = lambda *x: catalog.time_range(spark.createDataFrame([(v,) for v in x], "t string"), "t").first()[0]
    assert times("20240102_030405", "20240102_030505") == "2024-01-02 03:04 to 2024-01-02 03:05" and times("a") == "a" and times() == "N/A" and times("a", "b") == "a to b"
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "metadata.json").write_text('{"model_id": "a", "status": "validated"}')
    (tmp_path / "plot.png").write_text("x")
    assert catalog.discover(spark, str(tmp_path)).first().model_id == "a"
    found = {r.name: r.kind for r in catalog.files(spark, str(tmp_path), kinds={"plot": r"\.png$", "metadata": r"\.json$"}).collect()}
    assert found == {"metadata.json": "metadata", "plot.png": "plot"} and catalog.files(spark, str(tmp_path), kinds={"plot": r"\.png$"}, kind="plot").count() == 1
    (tmp_path / "catalog.json").write_text('{"schema_version": 2, "models": [{"model_id": "a"}, {"model_id": "b"}]}')
    assert [r.model_id for r in readers.read_catalog(spark, str(tmp_path / "catalog.json")).orderBy("position").collect()] == ["a", "b"]
    assert catalog.scoped_path("/x/y.csv", "My op", "fig", workflow="W 1") == "w_1/my_op/fig/y.csv" and catalog.slug(" A-b ") == "a_b"
    zero = spark.createDataFrame([('{"random": {"r2_mean": 0.0, "r2": 0.9}}',), ('{"r2": 0.4}',), ("{}",)], "m string")
    rows = catalog.metric_summary(zero, "m").collect()
    assert rows[0].random_r2 == 0.0 and rows[1].hardest_split_r2 == 0.4 and rows[2].hardest_split_r2 is None


def test_sessions(spark, tmp_path):
    s = session.Session()
    df = spark.createDataFrame([("CCO", 6.5)], "smi string, activity_final double")
    s.put("results.data.frame", df)
    s.put("results.file", f"{tmp_path}/l.csv")
    (tmp_path / "l.csv").write_text("nodes,filtered_reg_density\n5,0.7\n")
    assert s.loadable() == [("results.data.frame", "frame"), ("results.file", "path")]
    assert s.get(spark, "results").first().smi == "CCO" and s.get(spark, "results.file").first().nodes == 5
    with pytest.raises(KeyError, match="no session key"):
        s.get(spark, "other")
    a, b = s.register("compound", {"label": "aspirin", "smiles": "CC"}), s.register("compound", {"label": "aspartame", "smiles": "CN"})
    assert (a, b) == ("com_001", "com_002") and s.resolve("that one")["object"]["id"] == b and s.resolve("com_001")["object"]["label"] == "aspirin"
    assert s.resolve("asp")["status"] == "ambiguous" and s.resolve("aspirin")["object"]["id"] == a and s.resolve("compound 2")["object"]["id"] == b and s.resolve("zzz")["status"] == "not_found"
    assert session.top_n("the Top 5 of it") == 5 and session.top_n("top 0") is None and session.top_n("stop 3") is None


def test_sequences(spark):
    rows = [("ACD", "A C D", None), (">h\na-c,d", "A C D", None), ("ac-d", "AC D", "Unsupported amino acid token(s): AC."), ("A", "A", None), ("  ", None, "Peptide sequence must be a non-empty string."), (None, None, "Peptide sequence must be a non-empty string."), ("AXB", "A X B", "Unsupported amino acid token(s): B, X."), ("A" * 26, " ".join("A" * 26), "Peptide sequence length 26 exceeds max length 25.")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, want string, error string")
    for r in df.select("want", "error", sequences.normalized(F.col("s")).alias("got"), sequences.sequence_error(F.col("s")).alias("e"), sequences.properties(F.col("s")).alias("p")).collect():
        assert (r.got, r.e) == (r.want, r.error)
    assert df.where("i = 6").select(sequences.properties(F.lit("AAC")).alias("p")).first().p.composition == {"A": 2, "C": 1}
    one = spark.range(1).select(sequences.position_similarity(F.lit("ACDE"), F.lit("ACE")).alias("x"), sequences.position_similarity(F.lit(""), F.lit("A")).alias("y")).first()
    assert (one.x, one.y) == (0.5, None)
    c = spark.createDataFrame([("x", True, 2), ("x", True, 1), ("x", False, 3), (None, True, 4), ("y", None, 5)], "k string, valid boolean, o int")
    assert sorted(r.o for r in sequences.distinct_candidates(c, "k", "valid", "o").collect()) == [1, 3, 4, 5]
    ranked = sequences.rank_candidates(c, "valid", F.when(F.col("o") != 4, F.col("o").cast("double")), "o").collect()
    assert [r.o for r in ranked] == [2, 1, 4, 5, 3]
    assert [r.s for r in sequences.valid_unique(spark.createDataFrame([(" a", 2), ("a ", 1), ("", 3), (None, 4), ("b", 5)], "s string, o int"), "s", "o").orderBy("o").collect()] == ["a", "b"]
    ab = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    path = ab.select(sequences.interpolate(F.col("a"), F.col("b"), 1, "slerp").alias("p")).first().p
    assert path[0] == [1.0, 0.0] and path[2] == [0.0, 2.0] and np.allclose(path[1], [math.sqrt(0.5), 2 * math.sqrt(0.5)])
    v = spark.createDataFrame([(k, [0.0] * 50) for k in range(40)], "id long, v array<double>")
    cloud = sequences.cloud(v, "id", "v", 4, 0.5, seed=1)
    x = np.array([r.v for r in cloud.where("step > 0").collect()]).ravel()
    assert abs(x.mean()) < 0.02 and abs(x.std() - 0.5) < 0.02 and sorted(map(str, cloud.collect())) == sorted(map(str, sequences.cloud(v.repartition(5), "id", "v", 4, 0.5, seed=1).collect()))
    scores = spark.createDataFrame([("ACD", 0.1), ("AC", None)], "s string, x double")
    assert [r[0] for r in scores.select(sequences.peptide_score("s", None, "x", True)).collect()] == [0.1, 0.5] and [r[0] for r in scores.select(sequences.peptide_score("s", "ACD", "x")).collect()] == [1.0, 0.6667]


def test_splits_and_seeds(spark):
    assert splits.normalize_sizes([8, 0, 2]) == {"train": 0.8, "test": 0.2}
    with pytest.raises(ValueError):
        splits.normalize_sizes([1, 0])
    cv = splits.strategy({"type": "cross_validation", "n_folds": 5, "n_repeats": 1, "seed": 17}, 3)
    assert [r["label"] for r in cv["split_runs"]] == [f"cv_repeat_1_fold_{k}" for k in range(1, 6)] and all(r["split_type"] == "cross_validation" for r in cv["split_runs"]) and cv["final_refit"]
    assert cv["split_runs"][0]["seed"] == 17 and cv == splits.strategy({"type": "cross_validation", "n_folds": 5, "n_repeats": 1, "seed": 17})
    with pytest.raises(ValueError, match="Expected one of"):
        splits.strategy({"method": "cv", "folds": 5})
    with pytest.raises(ValueError, match="does not have"):
        splits.strategy({"type": "holdout", "n_folds": 5})
    assert splits.strategy({"type": "holdout", "split_family": "scaffold"}, 1)["split_runs"][0]["split_type"] == "scaffold_balanced"
    seeds = splits.replay_seeds(50, 7)
    assert seeds[0] == 7 and len(set(seeds)) == 50 and seeds == splits.replay_seeds(50, 7)
    df = spark.range(40)
    out = splits.outer_folds(df, ["id"], 4, 2, 1, 0.25)
    tests = {tuple(sorted(r.id for r in g)) for g in [[r for r in out.collect() if r.repeat == a and r.fold == b and r.split == "test"] for a in range(2) for b in range(4)]}
    assert len(tests) == 1 and len(next(iter(tests))) == 10 and out.where("split = 'val'").groupBy("repeat", "id").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError, match="overlap"):
        splits.final_split(df, "id", df.where("id < 5"), df.where("id < 2"))
    with pytest.raises(ValueError, match="belong"):
        splits.final_split(df, "id", test=spark.createDataFrame([(99,)], "id long"))
    a = df.withColumn("split", F.when(F.col("id") < 5, "test").otherwise("train"))
    assert splits.split_hash(a, "id").first() == splits.split_hash(a.repartition(6), "id").first() != splits.split_hash(a.withColumn("id", F.col("id") + 1), "id").first()
    three = spark.createDataFrame([(k, g) for k, g in enumerate("aaaaaaaabc")], "id long, g string")
    got = splits.group_split(three, "g", {"train": 0.8, "val": 0.1, "test": 0.1}).groupBy("split").agg(F.count("*").alias("n")).collect()
    assert {r.split: r.n for r in got} == {"train": 8, "val": 1, "test": 1}
    starved = splits.group_split(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, g string"), "g", {"train": 0.98, "val": 0.01, "test": 0.01})
    assert {r.split for r in starved.collect()} == {"train", "val", "test"}
    assert splits.cluster_count(8) == 3 and splits.cluster_count(200) == 10 and splits.cluster_count(10**6) == 20
    rows = splits.validation_rows(spark.createDataFrame([(0, 1.5), (1, 2.5)], "k int, y double"), spark.createDataFrame([(7, 1.0), (5, 2.0)], "source_row_index long, y double"), ["k"], ["source_row_index"], "y", "fold_1", 2)
    assert sorted((r.source_row_index, r.y_true, r.y_pred) for r in rows.collect()) == [(5, 2.0, 1.5), (7, 1.0, 2.5)]


def test_labels(spark):
    assert labels.sort_labels(["Yes", "no"]) == ["no", "Yes"] and labels.sort_labels([1, 0]) == [0, 1] and labels.sort_labels(["b", "a", "c", " a"]) == ["a", "b", "c"] and labels.sort_labels(["treated", "control"]) == ["control", "treated"]
    df = spark.createDataFrame([(0, [0.8, 0.2]), (1, [0.3, 0.7]), (5, None)], "code int, p array<double>")
    got = labels.prediction_frame(df, "code", "p", ["no", "yes"]).collect()
    assert [(r.label, r.probability_yes) for r in got] == [("no", 0.2), ("yes", 0.7), (None, None)]
    d = spark.createDataFrame([("0.5",), ("1.7",), ("-1",), ("x",), (None,)], "p string").select(*[c.alias(n) for c, n in zip(labels.decide(F.col("p")), ("d", "q"), strict=True)]).collect()
    assert [tuple(r) for r in d] == [(1, 0.5), (1, 1.0), (0, 0.0), (None, None), (None, None)]
    assert labels.class_labels(spark.createDataFrame([("active",), (" inactive ",), ("",)], "c string"), "c") == ["inactive", "active"]


def test_models(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), "ab"[i % 2], float(3 * x + 5 * (i % 2)), ["no", "yes"][int(x > 0)], ["u", "v", "w"][min(2, max(0, int(x + 1.5)))], i % 3) for i, x in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "id long, x double, kind string, y double, l string, m string, fold int")
    r = models.Boosted(["x", "kind"], "y", categories=["kind"], rounds=10).fit(df, "id")
    assert r.codes == {"kind": {"a": 0, "b": 1}}
    assert r.predict(df).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.6
    assert r.predict(df.withColumn("kind", F.lit("new"))).count() == 300
    for target, n in (("l", 2), ("m", 3)):
        c = models.Boosted(["x"], target, "classification", rounds=5).fit(df)
        out = c.predict(df)
        assert len(c.labels) == n and out.where(F.col("prediction") == F.col(target)).count() > 285 and "probability_" + c.labels[0] in out.columns
    tried = models.study(df, ["x", "kind"][:1], "y", [{"rounds": 1, "depth": 1}, {"rounds": 8, "depth": 4}], "fold")
    assert tried[0]["parameters"]["rounds"] == 8 and tried[0]["rmse"] < tried[1]["rmse"]
    ranked = models.campaign(df.withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train")), {"good": {"features": ["x"]}, "bad": {"features": ["id"]}}, "y")
    assert [c["candidate_id"] for c in ranked] == ["good", "bad"]
    two = models.several_targets(df.withColumn("id", F.col("id").cast("double")), ["x"], ["y", "id"])
    assert {"prediction_y", "prediction_id"} <= set(two.columns)
    again = models.refit_without(df, df.where("id < 10"), "id", ["x"], "y")
    assert models.external(again, df)[1].first().n == 300
    domain = domains.Domain(df.select("id", F.array("x").alias("v")), "id", "v", ["x"], ("bounding_box",))
    scored, by = models.external(again, df.withColumn("v", F.array("x")), domain, "v", "id")
    assert {r.status for r in by.collect()} == {"all", "in_domain"} and scored.count() == 300


def test_texts_and_reports(spark):
    text = "Sodium Chloride at 3.5 and -2 with CC(=O)O in Water"
    row = spark.range(1).select(*[search.extracted(F.lit(text), k).alias(k) for k in ("names", "numbers", "structures")]).first()
    assert row.numbers == ["3.5", "-2"] and "Sodium Chloride" in row.names and row.structures == ["CC(=O)O"]
    df = spark.createDataFrame([("a", "10 and 5"), ("b", "10 and 15")], "g string, t string")
    assert search.numeric_consistency(df, "g", "t").first().consistency == pytest.approx((1 + 0.5) / 2)
    assert search.numeric_consistency(df.limit(0), "g", "t").first().consistency == 1.0
    assert evaluation.insights(0.6, 0.2, {"data": 0.5, "text": 0.9}, -0.1) == ["critical: mean score 0.600 is below 0.70", "data is low (0.500)", "scores vary much (std 0.200)", "regression of 0.100 since the run before"]
    assert evaluation.insights(0.75, 0.0, {}) == ["no critical issue"]


def test_paged_web_source(spark):
    """A service on this machine alone: pages dealt to tasks."""
    import json
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tessera.sources.rest import Paged

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(self.path.partition("?")[2]).items()}
            rows = [{"id": k, "name": f"n{k}"} for k in range(q.get("offset", 0), min(47, q.get("offset", 0) + q["limit"]))]
            body = json.dumps({"meta": {"total": 47}, "data": rows}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ship(spark)
        spark.dataSource.register(Paged)
        options = {"url": f"http://127.0.0.1:{server.server_port}/x", "records": "data", "total": "meta.total", "page": "5", "pages": "2", "fetch": "tessera.sources.rest:fetch_json", "count": "tessera.sources.rest:count_json"}
        df = spark.read.format("paged").schema("id long, name string").options(**options).load()
        assert df.rdd.getNumPartitions() == 5 and sorted(r.id for r in df.collect()) == list(range(47))
        options.pop("count")
        assert spark.read.format("paged").schema("id long, missing string").options(**options).load().count() == 47
    finally:
        server.shutdown()


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(10)], "id long, v string").repartition(3)
    assert [p.count() for p in readers.pages(df, ["id"], 4)] == [4, 4, 2] and readers.first(df, where="id = 3", sort=["id"]) == {"id": 3, "v": "v3"} and readers.first(df, where="id > 99") is None
    assert sorted(r["id"] for r in readers.records(df)) == list(range(10)) and readers.csv_text(df, ["id"], 2) == "id,v\n0,v0\n1,v1\n"
    peptides = spark.createDataFrame([("AC", 1, 0.0, 7), ("AD", 0, None, 0)], "Sequence string, coli int, aureus double, other int")
    assert readers.sequence_table(peptides)[1:] == ("Sequence", ["coli", "aureus"])
    with pytest.raises(ValueError, match="are needed"):
        readers.sequence_table(peptides, 5)
    assert readers.backend_of({"mysql": "x"}) == "mysql" and readers.backend_of({}) == "rest"
    assert readers.resolve_path("a/b.csv", "s1", "s3a://x/") == "s3a://x/s1/a/b.csv" and readers.resolve_path("/abs", "s", "b") == "/abs"
    assert readers.assay_types(["binding", "f", "B", None]) == ["B", "F"]
    with pytest.raises(ValueError, match="unknown assay type"):
        readers.assay_types("x")
