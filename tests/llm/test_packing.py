import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import packing
from tessera.llm.tokens import Encoder

TEXTS = [
    "", " ", "\n", "a", " a", "a ", "Hello  world\n\n foo\tbar.", "it's we'll DON'T é ñandú, Über-straße!?", "x" * 300, "naïvé café", "日本語 text 123 4567",
    "a\x1cb \x85c​d᠎e", "<|endoftext|> and <|startoftext|>", "tab\t\ttab  two   three", "emoji 👍🏽 family 👨‍👩‍👧", "İstanbul ẞ ﬀ ǅ", "e.g. ...,,,;; a.b,c", "  nbsp em", "Σίσυφος ΣΑΣ",
    "\r\n crlf\r\n", "ÀÉÎõü ÿ!", "1st 2nd a1b2", "'s 's't n't", "﻿bom",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    enc = Encoder(public_tokenizers.path(name))
    assert enc.chunks is not None
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab Zé.,'\n\t 1-日") for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        want = enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == want, t


def exact(items, capacity):
    """The fewest sequences, by search."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i, b in enumerate(bins):
            if b + items[k] <= capacity and b not in bins[:i]:
                go(k + 1, [*bins[:i], b + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum_and_best_fit_packs_all():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.randrange(5, 30)
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = {s: items.count(s) for s in items}
        fixed, rest = packing.reduce_dominated(counts, capacity)
        n = sum(k for _, k in fixed)
        left = [s for s, k in rest.items() for _ in range(k)]
        assert n + exact(sorted(left, reverse=True), capacity) == exact(items, capacity)
        groups = packing.best_fit(rest, capacity)
        assert all(sum(s * k for s, k in p) <= capacity for p, _ in groups)
        packed = sorted(s for p, many in groups for s, k in p for _ in range(k * many))
        assert packed == sorted(left)


def one_at_a_time(items, capacity):
    rests = []
    for s in sorted(items, reverse=True):
        fit = [r for r in rests if r >= s]
        if fit:
            rests.remove(min(fit))
            rests.append(min(fit) - s)
        else:
            rests.append(capacity - s)
    return sorted(rests)


def test_grouped_best_fit_is_best_fit():
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.randrange(5, 60)
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 60))]
        groups = packing.best_fit({s: items.count(s) for s in items}, capacity)
        rests = sorted(capacity - sum(s * k for s, k in p) for p, many in groups for _ in range(many))
        assert rests == one_at_a_time(items, capacity)


def verify(rows, got, enc, capacity, end_id):
    ids = {i: [*np.frombuffer(enc.encode(t), enc.dtype).tolist(), end_id] for i, t in rows}
    places, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for p in places.values():
        end = 0
        for offset, n in sorted(p):
            assert offset == end
            end += n
        assert end <= capacity
    for i, x in ids.items():
        want = [(k, s, len(x[s : s + capacity]), zlib.crc32(np.array(x[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(x), capacity))]
        assert sorted(pieces[i]) == want
    return len(places), sum(len(x) for x in ids.values())


def test_whole_query(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    n, total = verify(rows, packing.op9_best_fit_packing(spark, at).collect(), enc, 2048, 0)
    assert n <= -(-total // 2048) * 1.02 + 1


def test_edges(spark):
    path = packing.default_tokenizer("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "a " * 50])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, rank int").repartition(3)
    verify(rows, packing.pack(docs, path, 16).collect(), Encoder(path), 16, 0)
    assert packing.pack(docs.limit(0), path, 16).count() == 0
    twice = docs.union(docs)
    assert packing.pack(twice, path, 16).count() == 2 * packing.pack(docs, path, 16).count()


def test_null_ids_and_repeats_are_packed_like_others(spark):
    rows = [(None, "a b"), (None, "a b"), (7, None), (7, ""), (8, "word " * 5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, piece int").repartition(3)
    got = packing.pack(docs, packing.default_tokenizer("word_bpe_49k.json"), 2048, 0).collect()
    assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 7 and r.length == 1 for r in got) == 2 and [r.length for r in sorted((r for r in got if r.doc_id == 8), key=lambda r: r.piece)] == [2048, 2048, 905]
    taken = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for a, b in zip(taken, taken[1:], strict=False):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
