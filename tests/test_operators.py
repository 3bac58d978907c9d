"""Literal frames with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import activity, curation, ensemble, frame, landscape, metrics, outliers, search, similarity, splits, structures
from tessera.sources import readers


def test_frame_commands(spark):
    df = spark.createDataFrame(
        [("M1", "C", 100, "IC50", "nM"), ("M2", "CC", 200, "IC50", "nM"), ("M3", "CCC", 300, "Ki", None)], "molecule string, smiles string, value long, kind string, units string"
    )
    frames = frame.Frames(spark)
    frames.put("data", df)
    run = lambda command, **a: frames.get(frames.run("data", command, **a))
    assert [r.value for r in run("query", expr="kind == 'IC50' and value > 100").collect()] == [200]
    assert run("select", columns="molecule, value").columns == ["molecule", "value"]
    assert {r.kind: r["count"] for r in run("value_counts", column="kind").collect()} == {"IC50": 2, "Ki": 1}
    assert run("mean", column="value").first()[0] == 200
    assert {r.kind: r.value for r in run("groupby", by=["kind"], agg={"value": "max"}).collect()} == {"IC50": 200, "Ki": 300}
    assert run("sort_values", by="units", ascending=True).collect()[-1].molecule == "M3"
    assert frames.run("data", "shape") == (3, 5)
    assert run("dropna", subset="units").count() == 2 and run("fillna", value="x", subset="units").where("units = 'x'").count() == 1
    assert run("rename", columns={"value": "v"}).columns[2] == "v"
    with pytest.raises(KeyError, match="data"):
        frames.get("dat")
    with pytest.raises(ValueError, match="unknown command"):
        frames.run("data", "eval")


def test_scales_and_labels(spark):
    df = spark.createDataFrame([(10.0, "nM"), (100.0, " n m "), (0.0, "nM"), (1.0, "parsec"), (1.0, "µM"), (None, "nM")], "v double, u string")
    got = [r[0] for r in df.select(scalars.p_scale(F.col("v"), F.col("u"))).collect()]
    assert got[:2] == [pytest.approx(8), pytest.approx(7)] and got[2:4] == [None, None] and got[4] == pytest.approx(6) and got[5] is None
    texts = {t: "active" for t in scalars.ACTIVE} | {t: "inactive" for t in scalars.INACTIVE} | {"Weakly active": "active", " Hit? ": "active", "is not active": "inactive", "was INCONCLUSIVE": "inactive", "unknown": None, "a": None, "i": None, "": None}
    labels = spark.createDataFrame([*texts.items(), (None, None)], "s string, want string")
    assert all(r[0] == r.want for r in labels.select(scalars.parse_label(F.col("s")), "want").collect())
    comments = spark.createDataFrame([("Not Active", "inactive"), ("unknown", "inactive"), ("Inconclusive", "inactive"), ("Dose-dependent", "active"), (None, None)], "s string, want string")
    assert all(r[0] == r.want for r in comments.select(scalars.parse_comment(F.col("s")), "want").collect())
    units = spark.createDataFrame([("nM", 1.0), ("uM", 1e3), ("micromolar", 1e3), ("10 nM", 1.0), ("mol", 1.0), ("pM", 1e-3), ("%", None), ("", None), (None, None)], "u string, want double")
    for r in units.select("u", scalars.to_nanomolar(F.lit(1.0), F.col("u")).alias("got"), "want").collect():
        assert r.got == r.want, r
    exact = spark.createDataFrame([("mol/L", 3.0), ("molar", 3.0), ("millimolar", 6.0), ("Nanomolar", 12.0), ("fm", None)], "u string, want double")
    for r in exact.select(scalars.p_scale(F.lit(1e-3), F.col("u")).alias("got"), "want").collect():
        assert r.got == (None if r.want is None else pytest.approx(r.want))
    n = spark.createDataFrame([("1.5",), ("x",), ("nan",), ("inf",), (None,)], "s string")
    assert [r[0] for r in n.select(scalars.number(F.col("s"))).collect()] == [1.5, None, None, None, None]


def test_regression_duplicates(spark):
    df = spark.createDataFrame([(0, "A", 5.0), (1, "A", 5.2), (2, "CCO", 4.0), (3, "B", 5.0), (4, "B", 6.0), (5, None, 1.0), (6, None, 1.0)], "id long, smiles string, y double")
    rows = {r.smiles: (r.id, round(r.y, 3), r.n_rows) for r in curation.resolve_regression_duplicates(df, ["smiles"], ["y"], 0.5, ["id"]).collect()}
    assert rows == {"A": (0, 5.1, 2), "CCO": (2, 4.0, 1), None: (5, 1.0, 2)}
    audit = {r.smiles: r.action for r in curation.duplicate_audit(df, ["smiles"], "y", 0.5).collect()}
    assert audit == {"A": "aggregated", "B": "removed", None: "aggregated"}


def test_label_duplicates(spark):
    same = spark.createDataFrame([(0, "A", "yes"), (1, "A", "yes"), (2, "B", "no")], "id long, smiles string, active string")
    assert curation.resolve_label_duplicates(same, ["smiles"], "active", ["id"]).count() == 2
    clash = spark.createDataFrame([(0, "A", "yes"), (1, "A", "no"), (2, "B", "no")], "id long, smiles string, active string")
    assert [r.id for r in curation.resolve_label_duplicates(clash, ["smiles"], "active", ["id"]).collect()] == [2]


def test_compound_merge(spark):
    df = spark.createDataFrame([(0, "X", 8.0, "cmp_a"), (1, "X", 7.0, "cmp_b| cmp_a"), (2, "CCO", 7.3, None)], "id long, smiles string, p double, compound string")
    rows = {r.smiles: r for r in curation.merge_compounds(df, "smiles", "p", ["compound"], "id").collect()}
    x = rows["X"]
    assert (x.activity_final, x.n_activity, x.compounds) == (7.5, 2, "cmp_a|cmp_b") and rows["CCO"].activity_std is None


def test_box(spark):
    train = spark.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 6.0])], "id long, v array<double>")
    query = spark.createDataFrame([(1, [0.5, 5.5]), (2, [0.5, 7.0]), (3, [float("nan"), 5.0])], "id long, v array<double>")
    got = {r.id: (r.status, r.violations) for r in similarity.score_box(query, "id", "v", similarity.fit_box(train, "v")).collect()}
    assert got[1] == ("in_domain", 0) and got[2] == ("out_of_domain", 1) and got[3][0] == "invalid_features"


def outlier_rows(spark):
    predicted = [1.0, 1.2, 0.1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    rows = [(10 + k, 0.0 if k == 3 else 1.0, p, "fold_1", k in (1, 2, 3), False) for k, p in enumerate(predicted)]
    return spark.createDataFrame(rows, "id long, y double, p double, fold string, cliff boolean, out boolean")


def test_outliers_need_an_error_and_a_flag(spark):
    df = outlier_rows(spark)
    got = {r.id: r for r in outliers.select_regression(df, "fold", "y", "p", ["id"], 0.1, flags=["cliff", "out"]).collect()}
    assert sorted(i for i, r in got.items() if r.eligible) == [12, 13] and [i for i, r in got.items() if r.selected] == [13]
    assert math.isinf(got[13].ape) and got[13].ape_rank == 1 and got[12].ape_rank == 2 and got[10].ape_rank is None
    assert sum(r.selected for r in outliers.select_regression(df, "fold", "y", "p", ["id"], 1.0, flags=["cliff", "out"]).collect()) == 2
    assert outliers.select_regression(df.limit(0), "fold", "y", "p", ["id"]).count() == 0


def test_every_misclassified_row_is_selected(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 1)], "id long, t int, p int")
    assert [r.selected for r in outliers.select_classification(df, "t", "p").orderBy("id").collect()] == [False, True, False]


def test_annotations_join_by_row(spark):
    rows = spark.createDataFrame([(5, 1.0), (7, 2.0)], "id long, y double")
    notes = spark.createDataFrame([(7, True, "high"), (7, True, "low")], "id long, flag boolean, tier string")
    got = outliers.attach_annotations(rows, notes, "id", "flag", "tier").orderBy("id").collect()
    assert [(r.flag, r.tier) for r in got] == [(False, "none"), (True, "high")]


def test_metrics_against_arithmetic(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 2.5, 0), (3.0, 2.0, 1), (4.0, 5.0, 1), (None, 1.0, 0)], "y double, p double, l int")
    r = metrics.regression(df, "y", "p").first()
    assert (r.n, round(r.mse, 6), round(r.mae, 6), round(r.r2, 6), round(r.rae, 6)) == (4, 0.5625, 0.625, 0.55, 0.625)
    assert metrics.spearman(df, "y", "p").first().spearman == pytest.approx(0.8)
    assert metrics.kendall(df, "y", "p").first().kendall == pytest.approx(4 / 6)
    assert metrics.roc_auc(df.where("y is not null"), "l", "p").first().roc_auc == pytest.approx(1 / 3)


def test_landscape_nodes(spark):
    grid = spark.createDataFrame([(0, 0, 1), (2, 0, 9), (3, 1, 7), (1, 1, None)], "gx int, gy int, density long")
    assert [r.gx for r in landscape.top_nodes(grid, "density", 2, 2).collect()] == [2, 3]
    assert landscape.sample(grid, "gx", 2, 1).count() == 2


def test_ensemble(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 6.0), (2, None, 4.0, 8.0), (3, None, None, None)], "id long, a double, b double, c double")
    rows = {r.id: r for r in ensemble.regression(df, "id", ["a", "b", "c"]).collect()}
    assert (rows[1].median, rows[1].mean, rows[2].median, rows[3].median) == (2.0, 3.0, 6.0, None)
    votes = spark.createDataFrame([(1, "b", "a", "b"), (2, "b", "a", None)], "id long, x string, y string, z string")
    assert {r.id: r.label for r in ensemble.vote(votes, "id", ["x", "y", "z"]).collect()} == {1: "b", 2: "a"}


def test_splits(spark):
    df = spark.range(103).withColumn("g", F.col("id") % 7)
    assert splits.target_counts(103, {"train": 0.8, "test": 0.2}) == {"train": 82, "test": 21}
    out = splits.exact_split(df, ["id"], {"train": 0.8, "test": 0.2}, 1)
    again = splits.exact_split(df.repartition(9), ["id"], {"train": 0.8, "test": 0.2}, 1)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    groups = splits.group_split(df, "g", {"train": 0.7, "test": 0.3})
    assert groups.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert splits.check_split(groups, ["g"], "split").first().shared_keys == 0


def test_group_split_of_many_groups(spark):
    df = spark.range(120_000).withColumn("g", F.when(F.col("id") >= 110_000, F.col("id") % 9).when(F.col("id") < 3, None).otherwise(F.col("id")))
    out = splits.group_split(df, "g", {"train": 0.7, "test": 0.2, "rest": 0.1})
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 84_000, "test": 24_000, "rest": 12_000}
    assert splits.check_split(out, ["g"], "split").first().shared_keys == 0


def test_groups_dealt_in_bulk_as_one_by_one():
    sizes, want, have = [(50, 7), (9, 31), (4, 260), (1, 500)], {"a": 1575, "b": 300, "c": 294}, {"a": 0, "b": 0, "c": 0}
    for (n, count), got in zip(sizes, splits.dealt(sizes, want), strict=True):
        assert sum(got) == count
        before = dict(have)
        for _ in range(count):
            have[min(want, key=lambda s: max(0, have[s] + n - want[s]) * 10_000 + have[s] / want[s])] += n  # noqa: B023
        assert got == [(have[s] - before[s]) // n for s in want]


def test_search_and_keywords(spark):
    df = spark.createDataFrame([(1, "CDK2", "kinase"), (2, "cdk-2 inhibitor", "x"), (3, "other", "about CDK 2"), (4, "none", "none")], "id long, title string, body string")
    assert [r.id for r in search.keyword_rows(df, "title", ["CDK2"]).collect()] == [1, 2]
    docs = spark.createDataFrame([("cdk2", "A", "tool", "x"), ("my-cdk2", "B", "tool", "x"), ("z", "on CDK2", "skill", "x"), ("y", "B", "skill", "cdk2 in the text"), ("w", "A", "skill", "for cdk2"), ("n", "no", "no", "no")], "id string, title string, kind string, body string")
    got = search.rank_documents(docs, "CDK2", "id", "title", "kind", ["body"])
    assert [(r.id, r.score) for r in got.collect()] == [("cdk2", 100), ("my-cdk2", 30), ("z", 20), ("w", 5), ("y", 5)]
    assert [r.score for r in search.rank_documents(docs, " !", "id", "title", "kind", ["body"], 2).collect()] == [100, 99]


def test_search_cuts_ties_by_id(spark):
    """Rows of equal score, kind and title: the limit keeps the least ids, wherever they lie."""
    rows = [(k, "red bolt", "tool", "x") for k in range(200, 0, -1)]
    for n in (1, 3, 7):
        docs = spark.createDataFrame(rows, "id long, title string, kind string, body string").repartition(n)
        assert [r.id for r in search.rank_documents(docs, "red", "id", "title", "kind", ["body"], 25).collect()] == list(range(1, 26))


def test_keyword_patterns():
    assert scalars.keyword_pattern("CDK2") == scalars.keyword_pattern("CDK-2") == "CDK[- ]?2" and scalars.keyword_pattern("PDE4A") == "PDE[- ]?4A"
    assert scalars.keyword_pattern("kinase") == "kinase" and scalars.keyword_pattern("a b c2") == "a[- ]b[- ]c[- ]2"


def test_kernels(spark):
    structures.register("size", lambda s: len(s) if s != "bad" else 1 / 0, "long")
    df = spark.createDataFrame([("CCO",), ("bad",), (None,)], "s string")
    got = df.select(structures.apply("size", F.col("s")).alias("r")).select("r.*").collect()
    assert [r.value for r in got] == [3, None, None] and [r.error is not None for r in got] == [False, True, False] and "ZeroDivisionError" in got[1].error
    assert df.select(structures.stereo_markers(F.lit("C[C@@H]/C"))).first()[0] == 3


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "id int, name string, x double")
    for suffix in ("csv", "json", "orc", "parquet"):
        readers.save(df, f"{tmp_path}/t.{suffix}")
        back = readers.load(spark, f"{tmp_path}/t.{suffix}") if suffix != "json" else readers.read_json(spark, f"{tmp_path}/t.json", multiline=False)
        assert sorted((r.id, r.name, r.x) for r in back.select("id", "name", "x").collect()) == [(1, "a,b", 1.5), (2, None, None)]
    (tmp_path / "n.json").write_text('{"a": {"b": 1, "c": {"d": "x"}}, "e": 2}')
    assert readers.read_json(spark, str(tmp_path / "n.json")).columns == ["a.b", "a.c.d", "e"]
    (tmp_path / "u.tsv").write_text("Unnamed: 0\tsmiles\ty\n0\tC\t1\n")
    assert readers.load(spark, str(tmp_path / "u.tsv")).columns == ["smiles", "y"]
    assert readers.from_records(spark, [{"a": 1}, {"a": 2, "b": "x"}], "a int, b string").count() == 2


def test_metrics_of_random_data_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 40, 3000).astype(float), rng.normal(size=3000).round(1)
    y += x / 20
    df = spark.createDataFrame([(float(a), float(b), int(k % 3)) for k, (a, b) in enumerate(zip(x, y))], "x double, y double, g int").repartition(5)

    def ranks(v):
        _, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(count) - (count - 1) / 2)[inverse]

    assert metrics.spearman(df, "x", "y").first().spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    s = (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / 2
    pairs = lambda v: (lambda c: (c * (c - 1) / 2).sum())(np.unique(v, return_counts=True)[1])
    n = 3000 * 2999 / 2
    want = s / np.sqrt((n - pairs(x)) * (n - pairs(y)))
    assert metrics.kendall(df, "x", "y").first().kendall == pytest.approx(want)
    assert metrics.kendall(df, "x", "y", rows=100).first().kendall == pytest.approx(want)  # many ranges
    for r in frame.quantiles(df, "y", {"a": 0.25, "b": 0.95}, ["g"]).collect():
        own = y[np.arange(3000) % 3 == r.g]
        assert (r.a, r.b, r.n) == (pytest.approx(np.percentile(own, 25)), pytest.approx(np.percentile(own, 95)), len(own))
    assert frame.quantiles(df.limit(0), "y", {"a": 0.5}).first().a is None


def test_no_rows_meet_in_one_task(spark):
    """Ordered statistics go by ranges: their plans have no exchange of rows into a single partition and no nested loop."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 97).cast("double").alias("y"), (F.col("id") % 2).cast("int").alias("l"))
    rows = {
        "ranks": metrics.average_ranks(df, "x", "r"), "ids": frame.with_row_id(df, ["x"]), "curve": metrics.curve_points(df, "l", "x"),
        "outliers": outliers.select_regression(df.withColumn("f", F.col("l")), "f", "x", "y", ["x"]), "tiers": similarity.tiers(df.withColumn("g", F.col("l") == 1), "y", "g", "x"),
    }
    for name, out in rows.items():
        plan = out._jdf.queryExecution().executedPlan().toString()
        single = [x for x in plan.split("\n") if "SinglePartition" in x]
        # the only thing gathered is one row a partition
        assert len(single) <= 2 and "BroadcastNestedLoopJoin" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Inner\n", ""), (name, plan)


def test_cliffs_by_the_rules(spark):
    rows = [(1, [1.0, 0.0], 5.0), (2, [1.0, 0.0], 5.0), (3, [1.0, 0.0], 8.0), (4, [0.0, 1.0], 1.0), (5, None, 2.0), (6, [1.0, 1.0], None), (7, [3.0, 1.0], 5.5)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y double")
    got = {r.id: r for r in similarity.cliffs(df, "id", "v", "y", 0.3, k=2).collect()}
    # 1 and 2 are identical without a gap: that pair is skipped before the nearest are taken
    assert got[1].n_neighbours == 2 and got[1].max_similarity == 1.0 and got[1].max_gap == 3.0 and got[1].raw == pytest.approx(3 / similarity.EPSILON)
    assert got[3].n_neighbours == 2 and got[4].n_neighbours == 0 and got[5].raw == 0.0 and not got[6].flagged and 0 <= got[7].norm <= 1
    with pytest.raises(ValueError, match="unknown index"):
        similarity.cliff_index("other")
    many = spark.createDataFrame([(k, [1.0, 0.0], float(k % 2)) for k in range(12)], "id long, v array<double>, y double")
    assert all(r.n_neighbours == 5 and r.max_gap == 1.0 for r in similarity.cliffs(many, "id", "v", "y", 0.9).collect())
    counts = similarity.tier_counts(similarity.tiers(similarity.cliffs(many, "id", "v", "y", 0.9), "norm", "flagged", "id")).first()
    assert (counts.none, counts.low, counts.medium, counts.high) == (0, 7, 2, 3)


@pytest.mark.parametrize("few", [0, 3, 1 << 20])
@pytest.mark.parametrize("measure", ["dot", "tanimoto"])
def test_cliffs_write_no_pairs(spark, monkeypatch, few, measure):
    """All scores count for the percentile and the k nearest, but no frame of the size of the pairs is written."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(90, 4)), 3) + 0.5
    v[:20] = v[0] / np.linalg.norm(v[0])  # copies
    y = rng.integers(0, 4, 90).astype(float)
    df = spark.createDataFrame([(k, x.tolist(), float(z)) for k, (x, z) in enumerate(zip(v, y, strict=True))], "id long, v array<double>, y double").repartition(3)
    want = frame.quantiles(similarity.cliff_pairs(df, "id", "v", "y", 0.3, measure), "sali", {"p": 0.95}).first()
    assert want.n > 1500
    sizes = []

    def write(df, label, own=similarity.materialize):
        out = own(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(similarity, "materialize", write)
    monkeypatch.setattr(similarity, "FEW", few, raising=False)
    monkeypatch.setattr(similarity, "PICKED", 7, raising=False)
    monkeypatch.setattr(similarity, "ROWS", 16)
    got = {r.id: r for r in similarity.cliffs(df, "id", "v", "y", 0.3, k=3, measure=measure).collect()}
    # a task writes its counts by bin and three rows a query
    assert max(sizes) < want.n
    assert similarity.normalizer(df, "id", "v", "y", 0.3, measure).first() == (pytest.approx(want.p, rel=1e-12), want.n)
    sim = np.round(similarity._similarities(v, v, measure), 9)
    for i in range(90):
        gap = np.abs(y - y[i])
        near = sorted((-sim[i, j], j) for j in range(90) if j != i and sim[i, j] >= 0.3 and not (sim[i, j] >= 1 and gap[j] <= 0))[:3]
        raw = max([gap[j] / max(1 + s, similarity.EPSILON) for s, j in near], default=0.0)
        assert (got[i].n_neighbours, got[i].max_gap, got[i].raw) == (len(near), max([gap[j] for _, j in near], default=0.0), pytest.approx(raw))
        assert got[i].norm == pytest.approx(min(raw / want.p, 1))


def test_tiers_of_copies_write_no_pairs(spark, monkeypatch):
    """200 copies with two activities have 20 000 pairs; nothing of that size is written on the way to their tiers."""
    df = spark.createDataFrame([(k, [1.0, 0.0], float(k % 2)) for k in range(200)], "id long, v array<double>, y double")
    sizes = []

    def write(df, label, own=similarity.materialize):
        out = own(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(similarity, "materialize", write)
    found = similarity.tiers(similarity.cliffs(df, "id", "v", "y", 0.9), "norm", "flagged", "id")
    counts = similarity.tier_counts(found).first()
    assert (counts.none, counts.low, counts.medium, counts.high) == (0, 120, 40, 40) and max(sizes) < 10_000


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_tiers_leave_only_the_nearest(spark, monkeypatch, few):
    """What a pass over a block of queries writes is gone before the next one, counts of the percentile included; so are the rows at the end."""
    import numpy as np

    rng = np.random.default_rng(5)
    v, y = np.round(rng.normal(size=(200, 4)), 3), rng.integers(0, 4, 200).astype(float)
    df = spark.createDataFrame([(k, x.tolist(), float(z)) for k, (x, z) in enumerate(zip(v, y, strict=True))], "id long, v array<double>, y double")
    want = frame.quantiles(similarity.cliff_pairs(df, "id", "v", "y", 0.3, "cosine"), "sali", {"p": 0.95}).first()
    left, most = {}, []

    def write(df, label, own=similarity.materialize):
        out = own(df, label)
        left[id(out)] = label
        most.append(sum(x == "compared" for x in left.values()))
        kept.append(out)
        return out

    def drop(df, own=similarity.forget):
        own(df)
        del left[id(df)]

    kept = []
    monkeypatch.setattr(similarity, "materialize", write)
    monkeypatch.setattr(similarity, "forget", drop)
    monkeypatch.setattr(similarity, "FEW", few)
    monkeypatch.setattr(similarity, "ROWS", 64)
    monkeypatch.setattr(similarity, "QUERY_BYTES", 1)
    found = similarity.cliffs(df, "id", "v", "y", 0.3, measure="cosine")
    assert set(left.values()) == {"nearest"} and len(left) == 4 and max(most) == 1
    left.clear()
    assert similarity.normalizer(df, "id", "v", "y", 0.3, "cosine").first() == (pytest.approx(want.p, rel=1e-12), want.n) and not left
    assert similarity.tiers(found, "norm", "flagged", "id").count() == 200


@pytest.mark.parametrize("kind", ["few", "many", "odd"])
def test_percentile_by_gaps(spark, monkeypatch, kind):
    """Passes into a bin look only at pairs near enough for their gap; few activities, all different ones, and an infinite one give the same percentile."""
    import numpy as np

    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(120, 3)), 3)
    v[:30] = v[0]
    y = {"few": rng.integers(0, 3, 120).astype(float), "many": rng.normal(size=120) * 1e3, "odd": np.where(np.arange(120) == 40, np.inf, rng.integers(-3, 3, 120))}[kind]
    df = spark.createDataFrame([(k, x.tolist(), float(z)) for k, (x, z) in enumerate(zip(v, y, strict=True))], "id long, v array<double>, y double").repartition(2)
    monkeypatch.setattr(similarity, "PICKED", 9)
    for few, threshold in ((0, -3.0), (1 << 20, 0.2), (5, 0.9)):
        monkeypatch.setattr(similarity, "FEW", few)
        sim = np.round(v @ v.T, 9)
        gap = np.abs(np.subtract.outer(y, y))
        good = (sim >= threshold) & ~np.eye(120, dtype=bool) & ~((sim >= 1) & (gap <= 0))
        scores = gap[good] / np.maximum(1 - sim[good], similarity.EPSILON)
        got = similarity.normalizer(df, "id", "v", "y", threshold, "dot").first()
        assert got.n_pairs == len(scores) and got.p95 == pytest.approx(np.quantile(scores, 0.95), rel=1e-9)


def test_nearest_by_parts():
    """The k nearest kept batch by batch are those of all, ties to the smaller id, also with many candidates in one batch."""
    import numpy as np

    rng = np.random.default_rng(7)
    sim, gap = rng.integers(0, 6, (40, 90)) / 8, rng.integers(0, 9, (40, 90)).astype(float)
    j = rng.permutation(90)
    state = None
    for s in range(0, 90, 30):
        row, column = np.nonzero(sim[:, s : s + 30] > 0)
        column += s
        state = similarity._nearer(state, 40, 4, row, j[column], sim[row, column], gap[row, column])
    for i in range(40):
        want = sorted((-sim[i, c], j[c], gap[i, c]) for c in range(90) if sim[i, c] > 0)[:4]
        assert [(-a, b, c) for a, b, c in zip(*(x[i] for x in state), strict=True)] == want


def test_measures(spark):
    import numpy as np

    a, b = np.array([[3.0, 0, 1], [0, 0, 0]]), np.array([[1.0, 2, 1], [3, 0, 1]])
    assert np.allclose(similarity._similarities(a, b, "min_max"), [[2 / 6, 1], [0, 0]])
    assert np.allclose(similarity._similarities(a / 2, b / 2, "min_max"), [[2 / 6, 1], [0, 0]])
    assert np.allclose(similarity._similarities(a, b, "tanimoto"), [[4 / 12, 1], [0, 0]])
    assert np.allclose(similarity._similarities(a, b, "euclidean"), [[-np.sqrt(8), 0], [-np.sqrt(6), -np.sqrt(10)]])
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 3.0]), (3, [4.0, 0.0])], "id long, v array<double>")
    got = {r.i: (r.support, r.nearest) for r in similarity.support(similarity.neighbours(df, "id", "v", 2, measure="euclidean"), distance=True).collect()}
    assert got[1] == (pytest.approx(1 / 4.5), 2)


def test_activity_classification(spark):
    rows = [(f"m{k}", "t1", "IC50", str(10.0 + k % 5), "nM") for k in range(30)] + [(f"n{k}", "t1", "Ki", str(20000.0), "nM") for k in range(80)]
    rows += [("m0", "t1", "IC50", "20000", "nM"), ("i1", "t1", "% Inhibition", "50", "%"), ("i2", "t1", "inhibition", "51", "%"), ("b1", "t1", "IC50", "bad", "nM"), ("m1", "t2", "IC50", "1", "nM"), (None, "t1", "IC50", "10", "nM")]
    df = spark.createDataFrame(rows, "mol string, target string, standard_type string, standard_value string, standard_units string")
    got = {}
    for r in activity.classify(df, "mol", "target").collect():
        got.setdefault(r.mol, set()).add(r.label)
    assert got["m0"] == {None} and got["m1"] == {"active"} and got["n3"] == {"inactive"} and got["i1"] == {"inactive"} and got["i2"] == {"active"} and got["b1"] == {None} and got[None] == {None}


def test_landscape_statistics(spark):
    grid = spark.createDataFrame([(0, 0, 4.0), (1, 1, 2.0), (2, 2, 1.0)], "gx int, gy int, density double")
    import numpy as np

    h = np.zeros((4, 4))
    h[0, 0], h[1, 1], h[2, 2] = 4, 2, 1
    want = np.mean([np.sqrt(sum((h[i, j] - h[a, b]) ** 2 for a in range(max(0, i - 1), min(4, i + 2)) for b in range(max(0, j - 1), min(4, j + 2)))) for i in range(4) for j in range(4)]) * 100
    assert landscape.ruggedness(grid, "density", 4).first().ruggedness == pytest.approx(want)
    p = np.array([4, 2, 1]) / 7
    assert landscape.entropy(grid, 16).first().entropy == pytest.approx(-(p * np.log(p)).sum() / np.log(16))


def test_frame_interpreter(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], float(k) if k != 3 else None) for k in range(10)], "id long, g string, x double").repartition(4)
    frames = frame.Frames(spark)
    frames.put("d", df)
    run = lambda command, **a: frames.get(frames.run("d", command, **a))
    assert [r.id for r in run("iloc", order="id", rows=slice(2, 5), cols=[0]).collect()] == [2, 3, 4]
    assert sorted(r.id for r in run("iloc", order="id", rows=slice(-2, None)).collect()) == [8, 9] and [r.id for r in run("iloc", order="id", rows=[-1]).collect()] == [9]
    assert run("loc", rows=(3, 5), columns="['id', 'x']").columns == ["id", "x"] and run("loc", rows=[1, 99]).count() == 1
    assert run("head", order="id", n=3).collect()[0].id == 0 and run("tail", order="id", n=1).collect()[0].id == 9
    assert sorted(run("sample", order="id", n=4, seed=2).collect()) == sorted(frame.sample(df.repartition(1), ["id"], 4, seed=2).collect())
    assert run("apply", func="sqrt", column="x").where("id = 4").first().x == 2.0
    with pytest.raises(ValueError, match="never as code"):
        frames.run("d", "apply", func="lambda x: x")
    with pytest.raises(KeyError, match="close names"):
        frames.run("d", "select", columns="idd")
    assert run("agg", func=["mean", "max"], column="x").columns == ["x_mean", "x_max"] and run("agg", func={"x": "min"}).first().x == 0.0
    first = {r.g: r.x for r in run("groupby", by="g", agg={"x": "first"}, order="id").collect()}
    assert first == {"a": 0.0, "b": 1.0}
    with pytest.raises(ValueError, match="need an order"):
        frames.run("d", "groupby", by="g", agg={"x": "last"})
    d = {r.column: r for r in run("describe", include="all").collect()}
    assert (d["g"].unique, d["g"].top, d["g"].freq, d["x"]["count"], d["x"].q50) == (2, "a", 5, 9, 5.0)
    t = run("transpose", by="id")
    assert sorted(r.column for r in t.collect()) == ["g", "x"] and t.columns[1:] == [str(k) for k in range(10)]
    assert frames.run("d", "to_list", column="id", n=2, order="id") in ([0, 1], frames.run("d", "to_list", column="id", n=2)) and len(frames.run("d", "to_dict", n=3, orient="list")["g"]) == 3
    assert run("drop", index=[1, 2]).count() == 8 and frames.run("d", "isna") and frames.run("d", "len") == 10
    assert frame.fingerprint(df).first() == frame.fingerprint(df.repartition(1).select("x", "id", "g")).first() != frame.fingerprint(df.where("id > 0")).first()
    assert frame.beside(df, df.select(F.col("id").alias("other"), "x").where("id < 3"), ["id"], ["other"]).where("other is null").count() == 7
    assert frame.schema_report(df)["nulls"]["x"] == 1
    assert frame.coerce_names('["a", "b"]') == frame.coerce_names("a, b") == ["a", "b"] and frame.coerce_names(None) == []


def test_tokens_and_audits(spark):
    df = spark.createDataFrame([(1, "X", "b| a", 1.0), (2, "X", "a|c", 3.0), (3, "Y", None, 2.0), (4, "Y", " ", 2.0)], "id long, k string, t string, y double")
    got = {r.k: r for r in curation.merge_compounds(df, "k", "y", ["t"], "id").collect()}
    assert got["X"].ts == "b|a|c" and got["Y"].ts is None and got["X"].activity_final == 2.0
    audit = {r.k: r for r in curation.audit_records(df, ["k"], "y", 1.0, "id").collect()}
    assert (audit["X"].action, audit["X"]["values"], audit["X"].row_keys, audit["Y"].action) == ("removed", "[1.0,3.0]", "1,2", "aggregated")
    assert curation.plural("compound_id") == "compound_ids" and curation.plural("assay") == "assaies" and curation.plural("source") == "source"
    labels = spark.createDataFrame([("A", "active"), ("A", "weak"), ("A", "weak"), ("B", None), ("C", "inactive"), ("C", "active")], "k string, l string")
    r = {x.k: x for x in curation.merge_labels(labels, "k", "l").collect()}
    assert (r["A"].majority, r["A"].n, r["A"].label_counts, r["C"].majority) == ("weak", 3, "weak:2|active:1", "active") and "B" not in r
    raw = spark.createDataFrame([("C[C@H]", "CC"), ("CC", "CC"), ("", None), ("bad", None), (None, None)], "raw string, std string")
    s = curation.standardization_summary(raw, "raw", "std").first()
    assert (s.n_rows, s.n_empty, s.n_failed, s.n_valid, s.n_changed, s.n_stereo_lost) == (5, 2, 1, 2, 1, 1)
    assert curation.collapse_examples(raw, "std", "raw").first().spellings == "CC|C[C@H]"


def test_catalog_upsert_in_order(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y")], "id string, at int, v string")
    new = spark.createDataFrame([("b", 1, "n1"), ("b", 3, "n3"), ("c", 1, "n")], "id string, at int, v string")
    assert [(r.id, r.v) for r in ensemble.upsert(old, new, "id", ["at"]).collect()] == [("a", "x"), ("b", "n3"), ("c", "n")]
