import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import store
from tessera.llm.common import shared_dir
from tessera.llm.packing import default_tokenizer
from tessera.llm.tokens import Encoder

PATH = default_tokenizer("byte_bpe_50k.json")


def brute(rows):
    enc, at, out = Encoder(PATH), 0, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_whole_query(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in store.op6_token_store(spark, at).collect()}
    assert got == brute(rows)


def test_round_trip_edges_and_damage(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["ab", "cde", "f", "日本", "\n"]) for _ in range(6000))
    rows = [(9, None), (3, ""), (4, long), (5, long), (6, "x " + long), (7, "z " * 9000), (1, "a")]
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, hash binary, row int").repartition(3)
    path = shared_dir(spark, "test")
    store.write_store(docs, PATH, 2, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in store.read_digests(spark, path).collect()}
    assert got == brute(rows)
    enc = Encoder(PATH)
    for r in store.read_ids(spark, path).collect():
        assert list(r.ids) == [*enc.tokenizer.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids, 2]
    stored = store.read_chunks(spark, path).agg(F.sum(F.length("payload") / 2)).first()[0]
    assert stored < 0.6 * sum(x[1] for x in got.values())
    assert [r.doc_id for r in store.read_manifest(spark, path).orderBy("start").collect()] == sorted(dict(rows))
    bad = store.read_chunks(spark, path).withColumn("payload", F.concat("payload", F.lit(b"\0\0")))
    with pytest.raises(Exception, match="does not verify"):
        bad.mapInArrow(store._check_chunks(2), "hash binary, crc long, n_ids long").collect()
    # a manifest whose sizes are not those of its chunks, though their sum and the root are right
    other = shared_dir(spark, "test")
    store.read_chunks(spark, path).selectExpr("0 AS kind", "hash", "0L AS row", "CAST(NULL AS long) AS doc_id", "1L AS n_tokens", "payload", "CAST(NULL AS binary) AS sizes").write.partitionBy("kind").parquet(f"{other}/data")
    swap = store.read_manifest(spark, path).withColumn("sizes", F.when(F.length("sizes") > 8, F.expr("concat(substr(sizes, 5, 4), substr(sizes, 1, 4), substr(sizes, 9))")).otherwise(F.col("sizes")))
    swap.write.parquet(f"{other}/manifest")
    with pytest.raises(Exception, match="another size"):
        store.read_digests(spark, other).collect()


def test_ids_of_four_bytes(spark, monkeypatch):
    class Wide(Encoder):
        """The same ids and 100 000 more each: beyond two bytes."""

        def __init__(self, path):
            super().__init__(path)
            self.dtype = np.dtype("<u4")

        def encode(self, text):
            return (np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4") + 100_000).astype("<u4").tobytes()

    monkeypatch.setattr(store, "encoder", Wide)
    docs = spark.createDataFrame([(1, "ab cd " * 900), (2, "ab cd " * 900), (3, "")], "doc_id long, text string")
    path = shared_dir(spark, "test")
    store.write_store(docs, PATH, 2, path)
    plain = Encoder(PATH).tokenizer
    want = {i: [x + 100_000 for x in plain.encode(t, add_special_tokens=False).ids] + [2] for i, t in ((1, "ab cd " * 900), (2, "ab cd " * 900), (3, ""))}
    assert {r.doc_id: list(r.ids) for r in store.read_ids(spark, path).collect()} == want
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in store.read_digests(spark, path).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    path = shared_dir(spark, "test")
    store.write_store(docs, PATH, 2, path)
    assert store.read_digests(spark, path).count() == 3
    path = shared_dir(spark, "test")
    store.write_store(docs.limit(0), PATH, 2, path)
    assert store.read_digests(spark, path).count() == 0


def test_crc_shift():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 4096, 70001):
        a, b = rng.bytes(50), rng.bytes(n)
        moved = store._Shift()(np.array([zlib.crc32(a)]), np.array([n]))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_encoder_is_the_librarys_on_odd_texts():
    rng = random.Random(1)
    parts = ["a", "bc", "é", ".", ",", " ", "\n", "\n\n", "\t", "d's", "1", " \n", "\r\n", "日本", "Wort,", "ÿes."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(6000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = Encoder(default_tokenizer(name))
        for t, found in zip(texts, enc.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == found.ids, t


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_marks_by_blocks(monkeypatch, kind):
    """Blocks change no mark: each is where the hash over the last ids alone says so."""
    monkeypatch.setattr(store, "BLOCK", 64)
    monkeypatch.setattr(store, "MASK", np.uint64(3))
    up, _ = store._WORDS[0].get(store.WINDOW)
    for n in (0, 1, 15, 16, 17, 64, 79, 80, 300):
        ids = np.random.default_rng(n).integers(0, 1 << 16, n).astype(kind)
        value = store.mix64(ids.astype(np.uint64) + np.uint64(1))
        sums = np.array([(value[e - store.WINDOW : e] * up[: store.WINDOW]).sum(dtype=np.uint64) for e in range(store.WINDOW, n + 1)], np.uint64)
        assert store._marks(ids).tolist() == [k + store.WINDOW for k, h in enumerate(store.mix64(sums)) if h & np.uint64(3) == 0]
