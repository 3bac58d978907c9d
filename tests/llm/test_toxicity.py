import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import gbt, toxicity


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    rows = got.where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert auc(np.array([r.score for r in rows]), np.array([r.toxic for r in rows])) > 0.95
    assert toxicity.op1_toxicity(spark, at).count() == 10000


def test_labels_of_the_held_out_fold_are_not_used(spark, tmp_path):
    at = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped.write.parquet(f"{tmp_path}/labels.parquet")
    a = {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, at).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "you idiot " * 3000, 1), (3, "x", 1), (None, "a", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 0, "a"), (3, 1, "a"), (3, 0, "a"), (9, 1, "a"), (None, 1, "a"), (2, None, "a")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    assert toxicity.scores(docs, model).count() == 5
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.scores(docs, nothing).collect()} == {0.0}
    assert toxicity.scores(docs.limit(0), nothing).count() == 0


def test_trees_and_isotonic():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -0.5)).astype(float)
    model = gbt.fit(x[:2000], y[:2000])
    assert auc(model.margin(x[2000:]), y[2000:]) > 0.97
    k, p = gbt.isotonic(model.margin(x[:2000]), y[:2000])
    assert (np.diff(p) >= 0).all() and (np.diff(k) > 0).all()
    # pooled means against the definition: max over lower sets of min over upper sets
    m, t = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 0, 1, 1.0])
    k, p = gbt.isotonic(m, t)
    assert np.allclose(np.interp(m, k, p), [0.25, 0.375, 0.375, 0.375, 5 / 6, 5 / 6])
    assert (gbt.fit(np.zeros((0, 3)), np.zeros(0)).margin(np.zeros((2, 3))) < 0.5).all()


def test_features_see_obfuscation_and_second_person():
    make = toxicity.Featurizer(["zork", "blar*"], ["frob"])
    f = dict(zip(toxicity.FEATURES, make("You are an idiot and an 1d10t, zork! blarney frob SHAME"), strict=True))
    assert f["lexicon_words"] == 1 and f["strong_words"] == 2 and f["weak_words"] == 1 and f["near_second_person"] >= 1 and f["disguised_words"] == 1 and f["shouted_rate"] > 0


def plain_features(text, strong, weak):
    """The features of a text by their definitions, word by word."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    core = []
    for w in words:
        i = [k for k, c in enumerate(w) if re.match(r"[^\W_]", c)]
        core.append(w[i[0] : i[-1] + 1] if i else "")
    low = [c.lower() for c in core]
    squeeze = lambda x: re.sub(r"(\w)\1\1", r"\1", x)
    plain = lambda x: "".join(c for c in x.translate(toxicity.DISGUISE) if re.match(r"[^\W_]", c))
    lexicon = [x in toxicity.LEXICON for x in low]
    marked = lambda marks: [bool(x) and any(m == x or (x.isalpha() and m.endswith("*") and len(m) - 1 in toxicity.STEMS and len(x) > len(m) - 1 and x.startswith(m[:-1])) for m in marks) for x in low]
    is_strong, is_weak, you = marked(strong), marked(weak), [x in toxicity.SECOND_PERSON for x in low]
    disguised = [bool(x) and not l and (squeeze(x) in toxicity.LEXICON or plain(x) in toxicity.LEXICON) for x, l in zip(low, lexicon)]
    near = sum((lexicon[i] or is_strong[i] or disguised[i]) and any(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i in range(len(words)))
    n, kinds = len(words), lambda flags: len({w.lower() for w, f in zip(words, flags) if f})
    marks = sum(33 <= ord(c) < 48 or 58 <= ord(c) < 65 or 91 <= ord(c) < 97 or 123 <= ord(c) < 127 for c in text)
    return [
        sum(lexicon), sum(lexicon) / n, kinds(lexicon), sum(is_strong), sum(is_strong) / n, kinds(is_strong), sum(is_weak), sum(is_weak) / n,
        near, sum(you) / n, sum("A" <= c <= "Z" for c in text) / len(text), sum(len(c) > 2 and c.isupper() for c in core) / n, text.count("!") / n, text.count("?") / n,
        marks / len(text), sum(disguised), sum("*" in w.strip("*") for w in words) / n, sum(bool(x) and squeeze(x) != x for x in low) / n, n,
    ]


def test_features_against_their_definitions(spark):
    strong, weak = ["zork", "blar*", "idio*"], ["frob", "worke*"]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", " \n", "You 1d10t!! BLARNEY sh*t stuuupid ___ f.u.c.k", "é" * 50, "you " * 9 + "idiot", "ZORK zork, *zork* frob workers"]
    make = toxicity.Featurizer(strong, weak)
    sets = [(strong, weak), (["idiot"], ["zork"]), ([], []), (weak, strong)]
    several = toxicity.Featurizer(*sets[0], *sets[1:])
    for t in texts:
        assert np.allclose(make(t), plain_features(t, strong, weak)), t
        assert np.allclose(several.every(t), [plain_features(t, *m) for m in sets]), t


def test_marks_are_chosen_within_folds(spark):
    rows = [(i, i % 2, i % 3, f"filler w{i} " + ("bad" * (i % 2)) + (" onlyone" if i % 2 and i % 3 == 0 else "")) for i in range(600)]
    every, *without = toxicity.marking_words(spark.createDataFrame(rows, "doc_id long, y int, fold int, text string"))
    assert "bad" in every[0] and all("bad" in m[0] for m in without)
    assert "onlyone" in every[0] and "onlyone" not in without[0][0] and "onlyone" not in without[0][1] and "onlyone" in without[1][0]


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "you idiot " * 300_000), (2, "x" * 2_000_000), (3, "fine words here")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))
    assert toxicity.scores(docs, model).count() == 3
