import random

import corpus_pipeline as pipeline
import public_tokenizers
from test_packing import verify
from tessera.llm.tokens import Encoder


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()][:300]
    vocabulary = [f"word{k}" for k in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, secret = say(60), "password=Zx81kQp0Lm"
    near = say(300).split()
    planted = {
        5000: say(100), 5001: f"{say(40)} {passage} {say(40)}", 5002: f"{say(40)} {passage} {say(40)}", 5003: f"{say(30)} {secret} {say(30)}",
        5004: " ".join(near), 5005: " ".join([*near[:150], "changed", *near[151:]]), 5006: f"you {say(20)} idiot moron stupid scum {say(20)} pathetic loser", 5007: None, 5008: "",
    }
    rows += [(i, t, "en", f"src{i % 7}", len(t or "")) for i, t in planted.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    clean, single, cut, masked = seen
    assert 5006 not in clean and all(i in clean for i in planted if i != 5006)
    assert 5004 in single and 5005 not in single and 5000 in single
    assert passage in cut[5001] and passage not in cut[5002] and cut[5000] == planted[5000] and cut.keys() == single.keys()
    assert masked[5003] == cut[5003].replace(secret, "[secret]") and masked.keys() == cut.keys()
    got = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    verify(list(masked.items()), got, Encoder(public_tokenizers.path("word_bpe_49k.json")), 2048, 0)


def test_empty(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids_and_clashing_names(spark, tmp_path):
    """Every stage on rows of repeated and null ids, with columns of the names that joins use."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, passage, secret = say(60), say(70), say(40), "token=Zx81kQp0Lm"
    rows = [(1, a), (1, a), (1, b), (2, a), (2, f"{passage} {say(60)}"), (3, f"y {say(50)} {passage}"), (3, f"{say(30)} {secret}"), (3, f"{say(30)} {secret}"), (4, None), (4, ""), (None, say(30)), (None, f"{say(9)} {secret}"), (5, b)]
    extra = ["gone_id", "changed_id", "new_text", "row_key", "found", "kept", "fp", "node", "a.b", "labelled", "hash"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    df = df.withColumns({c: F.lit(f"<{c}>") for c in extra})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == df.columns
        found = docs.collect()
        assert all(r[c] == f"<{c}>" for r in found for c in extra) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
        seen.append(sorted((r.doc_id or 0, r.text or "") for r in found))
    clean, single, cut, masked = seen
    assert clean == sorted((i or 0, t or "") for i, t in rows)
    left = [(i or 0, t or "") for i, t in [(1, a), (1, b), *rows[4:8], (4, ""), rows[10], rows[11]]]
    assert single == sorted(left)
    assert cut == sorted((i, t.replace(passage, "").strip() if i == 3 and t.startswith("y ") else t) for i, t in single)
    assert masked == sorted((i, t.replace(secret, "[secret]")) for i, t in cut)
    out = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) == len(masked)
    bare = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "lang", "source")
    assert pipeline.cut_repeats(spark, bare, str(tmp_path)).columns == bare.columns
