import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tests.llm.helpers import empty_documents, odd_documents, words
from textquarry.llm import decontaminate
from textquarry.llm import partenum as P
from textquarry.llm.shingles import mix


def shingles(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
                degree[a] += 1
                degree[b] += 1
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted(((rows[k][0], len(sets[k]), ids.get(find(k)), degree[k]) for k in range(len(rows))), key=str)


def family(rng, n_base, copies):
    rows, k = [], 0
    shared = words(rng, 50).split()
    for _ in range(n_base):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 6, 12, 40, 120]))]
        base = base + shared if rng.random() < 0.4 else base
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 5000)}"
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows


def test_components_and_links_equal_brute_force(spark):
    for seed, size, percent, block, division in ((1, 4, 85, 512, 1 << 18), (2, 5, 80, 4, 60), (3, 2, 50, 7, 1 << 18)):
        rows = family(random.Random(seed), 25, 8)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        got = P.jaccard_components(df, shingle=size, percent=percent, block=block, division=division).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, size, percent)


def test_odd_documents(spark):
    docs, rows = odd_documents(spark)
    got = P.jaccard_components(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 5, 80)
    assert P.jaccard_components(empty_documents(spark)).count() == 0


def test_keep_one(spark):
    rows = family(random.Random(4), 12, 6)
    rows += [(500, None), (501, ""), (rows[0][0], rows[0][1]), (None, rows[1][1]), (None, "a b c d e f g h")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, class int")
    label = {i: c for i, n, c, _ in brute(rows, 5, 80) if n and i is not None}
    expected = sorted([str(i) for i in set(label.values())] + ["500", "501", "None"])
    for block, division in ((512, 1 << 18), (3, 40)):
        kept = P.keep_one(df, block=block, division=division)
        assert kept.columns == df.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == expected
    assert P.keep_one(empty_documents(spark)).count() == 0


def test_keep_one_leaves_no_large_plan_to_the_driver(spark, monkeypatch):
    joins, write = {}, P.written

    def counted(df, label):
        joins[label] = max(joins.get(label, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, label)

    monkeypatch.setattr(P, "written", counted)
    rows = family(random.Random(5), 6, 4)
    assert P.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    # the driver plans all joins of a plan at once, broadcasts most of them, and plans them anew as each one ends
    assert max(joins.values()) <= 6, joins


def test_one_large_group_of_near_copies(spark):
    """A chain of edits: neighbours are similar, far ones are not; most of the table is one component."""
    rng = random.Random(8)
    w = [f"w{rng.randint(0, 900)}" for _ in range(60)]
    rows = []
    for k in range(150):
        w[rng.randrange(60)] = f"x{rng.randint(0, 900)}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(f"y{rng.randint(0, 900)}" for _ in range(30))) for k in range(20)]
    expected = brute(rows, 1, 80)
    assert len({c for _, _, c, _ in expected}) < 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = P.jaccard_components(df, shingle=1, percent=80, block=16, division=200).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected
    kept = {r["doc_id"] for r in P.keep_one(df, shingle=1, percent=80, block=16, division=200).collect()}
    assert kept == {c for _, _, c, _ in expected}


def test_differences_from_one_set_count_common_features():
    rng = np.random.default_rng(5)
    for left in (None, 6):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(14)]
        deltas = [np.setxor1d(s, sets[3], assume_unique=True) for s in sets]
        sizes = np.array([len(s) for s in sets])
        got = {(a, int(b)) for a, found in P.similar_sets(sizes, deltas, 40, left) for b in found}
        pairs = [(a, b) for a in range(14) for b in range(a + 1, 14) if left is None or a < left <= b]
        assert got == {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= 40 * len(np.union1d(sets[a], sets[b]))}


def test_similar_sets_share_a_signature():
    rng, met = np.random.default_rng(1), 0
    for percent in (85, 80, 60, 50):
        bands = P.Bands(percent)
        for n in (1, 2, 3, 7, 20, 100, 700):
            for _ in range(40):
                a = np.unique(mix(rng.integers(0, 1 << 60, n).astype(np.uint64)))
                gone, new = rng.integers(0, n * (100 - percent) // 100 + 1, 2)
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], mix(rng.integers(0, 1 << 60, new).astype(np.uint64))]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    met += 1
                    assert set(bands.signatures(a).tolist()) & set(bands.signatures(b).tolist())
    assert met > 600
    assert any(n2 > 1 for _, n2, _, _ in bands.shape)


def test_sketches_never_miss_a_similar_pair():
    rng = np.random.default_rng(3)
    sets = []
    for n in (30, 200, 700, 700, 5000, 5000, 9000):
        a = np.unique(mix(rng.integers(0, 1 << 60, n).astype(np.uint64)))
        sets += [a, np.unique(np.concatenate([a[n // 12 :], mix(rng.integers(0, 1 << 60, n // 12).astype(np.uint64))]))]
    sketches = [P.fine_sketch(s) or P.sketch(s) for s in sets]
    assert {len(x) for x in sketches} == {128, 256, 2048, 4096}
    sizes = np.array([len(s) for s in sets])
    order = rng.permutation(len(sets))
    for left in (None, 7):
        pairs = {tuple(sorted(order[list(p)] // 2)) for p in P.possible_pairs(sizes[order], [sketches[k] for k in order], 80, left)}
        assert all(a == b for a, b in pairs)
        assert left is not None or pairs == {(k, k) for k in range(7)}


def test_long_documents(spark):
    rng = random.Random(6)
    shared = [f"s{rng.randint(0, 9000)}" for _ in range(300)]
    rows = []
    for k in range(8):
        base = [f"w{rng.randint(0, 90000)}" for _ in range(rng.choice([600, 1500, 4000]))]
        base[100:100] = shared
        for c in range(3):
            w = list(base)
            for _ in range(len(w) // (200 if c < 2 else 10)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9000)}"
            rows.append((10 * k + c, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = brute(rows, 5, 80)
    assert sorted((tuple(r) for r in P.jaccard_components(df, block=2, division=3000).collect()), key=str) == expected
    assert {r["doc_id"] for r in P.keep_one(df).collect()} == {c for _, _, c, _ in expected}


def test_workers_hand_on_few_rows_at_a_time():
    n = 3000
    texts = [" ".join(f"w{k * 7 + j}" for j in range(60)) for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts), pa.array(range(n), pa.int64())], names=["id", "text", "text_hash"])
    out = list(P._signature_rows(5, 80, lambda ids, hashes: np.ones(len(ids), bool))(iter([batch])))
    assert len({c for o in out for c in o.column(1).to_pylist()}) == n
    # those of the whole batch at once are held by the worker and once more by the JVM
    assert max(len(set(o.column(1).to_pylist())) for o in out) <= 200

    windows = SimpleNamespace(value=[(b" " + t.encode() + b" ", 60, []) for t in texts[::10]])
    out = list(decontaminate._filter("few rows", windows, 1)(iter([batch])))
    assert [i for o in out for i in o.column(0).to_pylist()] == [k for k in range(n) if k % 10]
    assert max(o.num_rows for o in out) <= 500
