import numpy as np
import xxhash

from tessera.llm import simhash


def brute(rows, shingle, radius=3):
    fps = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        g = [b" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fps}
    ids = sorted(fps)
    changed = True
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= radius]
    while changed:
        changed = False
        for a, b in near:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return {i: (fps[i], root[i]) for i in ids}


def test_whole_query_against_brute_force(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op2_simhash(spark, at).collect()}
    assert got == brute(rows, 3)


def test_edges_nulls_repeats_and_extra_columns(spark):
    rows = [(5, "a b c d e f g"), (1, "A B C D E F G"), (1, "a b c d e f g"), (7, None), (8, ""), (9, " \n\t"), (None, "x"), (10, "x y")]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp, r.component_id) for r in simhash.near_duplicates(docs, shingle=3).collect())
    assert len(got) == len(rows)
    assert {(i, c) for n, i, _, c in got if not n} == {(1, 1), (5, 1), (7, 7), (8, 7), (9, 7), (10, 10)}
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_join_every_near_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(12)]
    hot = np.uint64(0x0F0F0F0F12345678)
    near = [hot ^ np.uint64((1 << int(a)) | (1 << int(b))) for a in range(60) for b in range(a, 60)]
    fps = np.unique(np.array([*base, *flips, *near], dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    from tessera.llm.graph import connected_components

    comp = {r.node: r.component for r in connected_components(simhash.links(df)).collect()}
    signed = fps.view(np.int64)
    label = np.arange(len(fps))
    simhash._merge(label, *[x for x in simhash._near(fps, fps, 3)])
    want = {}
    for s, l in zip(signed, label):
        want.setdefault(int(l), []).append(int(s))
    got = {}
    for s in signed:
        got.setdefault(comp.get(int(s), int(s)), []).append(int(s))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_tree_splits_large_shards():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**40, 6000, dtype=np.uint64))
    label = np.arange(len(fps))
    simhash._tree(fps, label, np.arange(len(fps)), 3, 0)
    other = np.arange(len(fps))
    for s in range(0, len(fps), 500):
        i, j = simhash._near(fps[s : s + 500], fps, 3)
        simhash._merge(other, i + s, j)
    assert (label == other).all()


def test_near_copies_by_similarity(spark):
    import random

    rng = random.Random(4)
    rows, groups = [], {}
    for g in range(60):
        words = [f"w{rng.randrange(100000)}" for _ in range(rng.randrange(60, 400))]
        for c in range(4):
            own = list(words)
            for _ in range(len(own) // 60 if c else 0):  # a few edits: similarity of 0.85 and more
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**9)}"
            rows.append((g * 10 + c, " ".join(own), 1))
            groups[g * 10 + c] = g * 10
    rows += [(9000, None, 1), (9001, "", 1), (9002, "one two", 1), (9003, "ONE two", 1), (None, "x", 1)]
    groups |= {9000: 9000, 9001: 9000, 9002: 9002, 9003: 9002}
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect() if r.doc_id is not None}
    assert sum(got[i] == c for i, c in groups.items()) >= 0.98 * len(groups)
    assert all(got[i] // 10 == c // 10 for i, c in groups.items())
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_near_copies_link_by_exact_similarity(spark):
    import random

    rng = random.Random(5)
    texts = {}
    for g in range(120):  # pairs from 0.70 to 0.90, most within a few bits of the radius
        words = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        own, tail = list(words), rng.randrange(10, 35)
        own[204 - tail :] = [f"e{rng.randrange(10**9)}" for _ in range(tail)]
        texts[10 * g], texts[10 * g + 1] = " ".join(words), " ".join(own)
    words = [f"c{rng.randrange(10**9)}" for _ in range(500)]
    texts |= {5000 + k: " ".join(words[15 * k : 15 * k + 204]) for k in range(12)}  # neighbours at 0.86, the next at 0.74
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in texts.items()}
    alike = [(a, b) for a in texts for b in texts if a < b and a // 10 == b // 10 or a >= 5000 and a < b if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in texts}
    for a, b in alike * 12:
        root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert 30 < sum(root[10 * g + 1] != 10 * g + 1 for g in range(120)) < 90
    assert not [i for i in texts if root[i] == i and got[i] != i]
    assert sum(got[i] == c for i, c in root.items()) >= len(texts) - 5


def test_near_copies_recall_at_given_similarities(spark):
    import random

    rng = random.Random(8)
    rows, want = [], {}
    for level, target in enumerate((0.80, 0.82, 0.85, 0.74)):
        for g in range(200):
            n = 200  # shingles; replacing the last words of both keeps a share of them
            keep = round(2 * n * target / (1 + target))
            words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
            own = words[: keep + 4] + [f"e{rng.randrange(10**9)}" for _ in range(n - keep)]
            both = set(zip(*(words[k:] for k in range(5)))), set(zip(*(own[k:] for k in range(5))))
            a = 100_000 * level + 10 * g
            rows += [(a, " ".join(words)), (a + 1, " ".join(own))]
            want[a + 1] = (level, len(both[0] & both[1]) / len(both[0] | both[1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    for level in range(3):
        own = [i for i, (x, j) in want.items() if x == level and j >= 0.8]
        assert len(own) > 150 and sum(got[i] == i - 1 for i in own) >= 0.95 * len(own)
    assert not [i for i, (_, j) in want.items() if j < 0.8 and got[i] != i]


def test_work_on_unrelated_texts_grows_like_their_number():
    """Pairs that shards compare, for random fingerprints: no faster than N log N."""
    rng = np.random.default_rng(6)
    cost = {}
    for n in (1 << 18, 1 << 20, 1 << 22):
        width, tables = simhash.tables_for(0.8, n)
        shard = np.sort(rng.integers(0, 1 << width, n))
        size = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [n]]))
        cost[n] = float((size * (size - 1) // 2).sum()), tables
    for n in (1 << 18, 1 << 20):
        assert cost[4 * n][0] / cost[n][0] < 4.4  # a table's pairs
        assert cost[4 * n][1] / cost[n][1] < 4**0.3  # tables
    assert simhash.tables_for(0.8, 10)[0] == 14


def test_large_shards_cost_members_not_pairs(monkeypatch):
    rng = np.random.default_rng(7)
    base, n = rng.integers(0, 2**63, 2, dtype=np.uint64), 3000
    fp = np.zeros(n, [("w0", "<u8"), ("w1", "<u8"), ("n", "<u4"), ("label", "<i8")])
    for k in range(2):
        fp[f"w{k}"] = base[k] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    fp["w0"][:20] = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fp["n"], fp["label"] = 100, np.arange(n)
    name, seen = np.arange(n), []
    plain = simhash._fits
    monkeypatch.setattr(simhash, "_fits", lambda fp, i, j, *a: seen.append(np.size(j)) or plain(fp, i, j, *a))
    a, b = simhash._stars(0, name, fp, 32, 0.8, 4, 14)
    assert set(a.tolist()) | set(b.tolist()) >= set(range(20, n)) and len(a) <= n and sum(seen) < 60 * n
    # short runs and long ones find the same members
    few = slice(0, 60)
    one = simhash._stars(0, name[few], fp[few], 32, 0.8, 4, 14)
    other = simhash._first_of_small(np.zeros(60, np.int64), name[few], fp[few], 32, 0.8, 4, 14)
    assert set(one[0]) | set(one[1]) == set(other[0]) | set(other[1])
    fp["label"] = np.where(np.arange(n) < 30, np.arange(n), 99)
    x, y = simhash._across(5, name[:64], fp[:64], 32, 0.8), simhash._across_small(np.full(64, 5), name[:64], fp[:64], 32, 0.8)
    assert sorted(x[1]) == sorted(y[1]) and len(x[1]) > 10


def test_very_long_texts(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"W{x}" for x in rng.integers(0, 5000, 30_000))
    rows = [(1, long), (2, long.lower()), (3, "x" * 500_000), (4, "y " * 20_000), (5, "y y y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, shingle=3).collect()}
    assert got == brute(rows, 3) and got[1] == got[2] and got[4] == (got[5][0], 4)
