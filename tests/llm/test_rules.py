import random
import re
from collections import Counter

from tessera.llm import rules


def brute(text):
    t = text or ""
    w = re.findall("[^\\x20\\x09-\\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def check(rows, got):
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, rows[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_whole_query(spark):
    at = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = rules.op8_quality_rules(spark, at).collect()
    check(rows, got)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    left = [(labels[r.doc_id], r.kept) for r in got if r.doc_id in labels and not r.base_failed]
    good = [k for q, k in left if q == 1]
    assert sum(good) > 0.97 * len(good)
    assert sum(not k for q, k in left if q == 0) > 0.5 * sum(q == 0 for q, _ in left)


def test_edges(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \t\n\x0b", "a", "a b", "a b c", "a a a a", "a b c a b c", "\n\n", "x\n x\nx\n\nx ", "é😀 日本 é😀 日本 é😀 日本", "# $ |<>&", "a\x1cb c\x1c", "a,b a,b a , b"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)] + ["ab cd " * 5000]
    rows = dict(enumerate(texts))
    spark.createDataFrame([(i, t, 7) for i, t in rows.items()], "doc_id long, text string, n_words int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "q"), (1, 1, "q"), (None, 0, "q"), (3, None, "q")], "doc_id long, quality int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    check(rows, rules.op8_quality_rules(spark, str(tmp_path)).collect())
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert rules.with_statistics(empty.select("doc_id", "text")).count() == 0


def test_learning_finds_ordered_conjunctions():
    rng = random.Random(1)
    rows = []
    for i in range(900):
        r = {f: rng.random() for f in rules.FEATURES}
        r["low"], r["fold"] = int(r["symbol_rate"] > 0.8 or (r["mean_word"] < 0.3 and r["repeat_rate"] > 0.6)), i % 3
        rows.append(r)
    found = rules.learn(rows, precision=0.9)
    fires = lambda r: any(all(t.holds(r) for t in rule) for rule in found)
    assert sum(fires(r) != bool(r["low"]) for r in rows) < 0.05 * len(rows)
    assert rules.learn([]) == [] and rules.learn([r for r in rows if r["low"]]) == []


def test_repeated_ids_are_learned_alike_in_any_order(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["##"] * 60) if i % 2 else " ".join(f"w{rng.randrange(999)}" for _ in range(60))) for i in range(80)]
    rows += [(i, "zz " * 70) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    first = rules.train(docs.repartition(1), labels)
    assert first and first == rules.train(docs.orderBy("text").repartition(7), labels)
    assert len(rules.train(docs, labels, most=1, longest=1, cuts=2)[0]) == 1


def test_verdict_of_the_whole_query_by_hand(spark):
    """kept against the learned rules applied row by row."""
    from pyspark.sql import functions as F

    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    found = rules.train(docs, spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "quality"))
    rows = rules.with_statistics(docs).withColumn("failed", rules.base_failed()).collect()
    want = {r.doc_id: not r.failed and not any(all(t.holds(r.asDict()) for t in rule) for rule in found) for r in rows}
    assert {r.doc_id: r.kept for r in rules.op8_quality_rules(spark, at).collect()} == want
    for r in rows[:200]:
        text = docs.where(F.col("doc_id") == r.doc_id).first().text if r.doc_id < 3 else None
        if text is not None:
            w = re.findall("[^\\x20\\x09-\\x0D]+", text)
            assert abs(r.mean_word - sum(map(len, w)) / len(w)) < 1e-9 and abs(r.distinct_rate - len(set(w)) / len(w)) < 1e-9
