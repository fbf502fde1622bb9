import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions.text import FNV_OFFSET, FNV_PRIME
from textquarry.operators import simhash as H
from textquarry.operators import vectors as V
from textquarry.operators.components import connected_components
from textquarry.sources.datagen import clustered_embeddings, near_duplicates


def roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize(("seed", "task"), [(1, 500_000), (2, 40)])
def test_components(spark, monkeypatch, seed, task):
    from textquarry.operators import components

    monkeypatch.setattr(components, "TASK_EDGES", task)
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(300, 340)] + [(400, 400)]
    expected = roots(401, edges)
    df = spark.createDataFrame([*edges, (None, 1)], "a bigint, b bigint").repartition(5)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {n: expected[n] for n in {x for e in edges for x in e}}
    assert connected_components(df.limit(0)).count() == 0


def twin(text):
    import re

    votes = [0] * 64
    for token in re.findall("[a-z0-9]+", (text or "").lower()):
        h = FNV_OFFSET
        for byte in token.encode():
            h = (h ^ byte) * FNV_PRIME % 2**64
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    x = sum(1 << b for b in range(64) if votes[b] > 0)
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize(("at_once", "portion"), [(60_000, 1 << 20), (7, 50)])
def test_fingerprints_of_texts_as_they_are(monkeypatch, at_once, portion):
    """The kernel finds tokens itself: at the borders of texts, behind other letters, very long, very many."""
    import pandas as pd

    monkeypatch.setattr(H, "_AT_ONCE", at_once)
    monkeypatch.setattr(H, "_PORTION", portion)
    texts = ["", "a", "b-a", "!!", "été\0x", "x" * 65 + " y", "z" * 3000, "ab " * 500 + "c", "", " q1 q1  q2", "\U0001f600k"]
    texts += ["w" * k for k in range(60, 90)]
    assert H._fingerprints(pd.Series(texts)).tolist() == [twin(t) for t in texts]
    assert H._fingerprints(pd.Series([], dtype=object)).tolist() == []
    if at_once > 7:
        many = ["k v " * 70_000 + "v", "u"]
        assert H._fingerprints(pd.Series(many)).tolist() == [twin(t) for t in many]


def test_fingerprints_pairs_and_groups(spark):
    docs = near_duplicates(spark, 120).unionByName(spark.createDataFrame([(500, None), (501, "!!"), (502, "été")], "doc_id bigint, text string"))
    docs = docs.unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 600))
    prints = {r["doc_id"]: r["fingerprint"] for r in H.fingerprint(docs).collect()}
    assert prints == {r["doc_id"]: twin(r["text"]) for r in docs.collect()}
    reps = {}
    for i, p in sorted(prints.items()):
        reps.setdefault(p, i)
    for t, blocks in ((3, None), (3, 6), (8, None), (20, 22)):
        expected = {(a, b) for p, a in reps.items() for q, b in reps.items() if a < b and bin((p ^ q) % 2**64).count("1") <= t}
        got = H.near_pairs(H.fingerprint(docs), t, blocks).collect()
        assert {(r["a"], r["b"]) for r in got} == expected
    ids = sorted(prints)
    links = [(ids.index(a), ids.index(b)) for a in ids for b in ids if a < b and bin((prints[a] ^ prints[b]) % 2**64).count("1") <= 8]
    label = roots(len(ids), links)
    expected = {(ids[label[k]], label.count(label[k]), i) for k, i in enumerate(ids) if label.count(label[k]) > 1}
    assert {tuple(r) for r in H.groups(H.fingerprint(docs), 8).collect()} == expected
    assert H.first_pairs(H.fingerprint(docs), 8, 3).count() == 3


def _counted(rows, seen):
    for batch in rows:
        seen.add(batch.num_rows)
        yield batch


def test_links_of_a_crowded_bucket_are_few_and_found_once(spark):
    """900 fingerprints within 8 bits of one another have 404,550 pairs; links are at most one for each class and key, and made once."""
    rng = random.Random(4)
    near = sorted({sum(1 << b for b in rng.sample(range(40), 4)) for _ in range(1500)})[:900]
    rows = [(k, p) for k, p in enumerate(near)] + [(2000 + k, (rng.getrandbits(63) | 1 << 62)) for k in range(30)]
    prints = spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint").repartition(4)
    for t, blocks in ((8, 9), (8, None), (3, 5)):
        links = [(r["a"], r["b"]) for r in H.near_links(H.classes(prints), t, blocks).collect()]
        by_id = dict(rows)
        assert all(bin(by_id[a] ^ by_id[b]).count("1") <= t for a, b in links)
        expected = [(i, j) for i in by_id for j in by_id if i < j and bin(by_id[i] ^ by_id[j]).count("1") <= t]
        assert roots(2030, links) == roots(2030, expected)
        assert len(links) <= len(rows) * len(H._masks(t, blocks or H.blocks_for(len(rows), t)))
        pairs = [(r["a"], r["b"]) for r in H.near_pairs(prints, t, blocks).collect()]
        assert sorted(pairs) == expected
    seen = spark.sparkContext.accumulator(0)
    edges = spark.range(10).selectExpr("id a", "id + 1 b").mapInArrow(lambda rows: _counted(rows, seen), "a bigint, b bigint")
    assert connected_components(edges, loops=False).where("component = 0").count() == 11 and seen.value == 10


def test_bucket_over_several_batches():
    import pyarrow as pa

    rows = [(0, 5, 1, 0), (0, 5, 2, 1), (0, 5, 3, 3), (0, 6, 4, 9), (1, 6, 5, 9), (1, 6, 6, 8), (1, 6, 7, 255)]
    for cut in range(1, 8):
        batches = [pa.RecordBatch.from_pydict({n: [r[k] for r in rows[i : i + cut]] for k, n in enumerate(("n", "bits", "doc_id", "fingerprint"))}) for i in range(0, len(rows), cut)]
        got = [x for b in H._trees(iter(batches), 1) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == [(1, 2), (2, 3), (5, 6)]


def test_knn(spark, monkeypatch):
    corpus = clustered_embeddings(spark, 300, 24).unionByName(spark.createDataFrame([(900, [0.0] * 24), (901, [1.0] * 30), (902, [2.0])], "vec_id bigint, embedding array<float>"))
    queries = corpus.where("vec_id in (0, 7, 900, 901)")
    rows = corpus.collect()
    dim = 30
    m = np.zeros((len(rows), dim))
    for k, r in enumerate(rows):
        m[k, : len(r["embedding"])] = r["embedding"]
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norms, out=m, where=norms > 0)
    for block in (V.BLOCK_VALUES, 30):
        monkeypatch.setattr(V, "BLOCK_VALUES", block)
        got = V.knn(corpus, queries, 6, digits=6).collect()
        for q in (0, 7, 900, 901):
            k = next(i for i, r in enumerate(rows) if r["vec_id"] == q)
            s = np.round(m @ m[k], 6) + 0.0
            order = sorted((-s[j], r["vec_id"]) for j, r in enumerate(rows) if r["vec_id"] != q)[:6]
            found = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
            assert [i for _, i in found] == [i for _, i in order]
    assert V.knn(corpus, queries, 0).count() == 0
    assert V.knn(corpus, queries, 100).where("query_id = 0").count() == 63


def test_cosine_scores_are_of_vectors_stored_in_32_bits(spark):
    corpus = clustered_embeddings(spark, 300, 24).unionByName(spark.createDataFrame([(900, [0.0] * 24)], "vec_id bigint, embedding array<float>"))
    unit = {r["vec_id"]: r["n"] for r in corpus.select("vec_id", V.normalize(F.col("embedding")).alias("n")).collect()}
    got = V.cosine_scores(corpus, corpus.where("vec_id in (0, 7, 900)")).collect()
    assert len(got) == 3 * 301
    # in 64 bits throughout, scores are off by some 1e-8
    assert max(abs(r["score"] - sum(a * b for a, b in zip(unit[r["query_id"]], unit[r["vec_id"]], strict=True))) for r in got) < 1e-14


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [[round(x, 6) for x in r["n"]] for r in df.select(V.normalize(F.col("v")).alias("n")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(V.fit_length(F.col("v"), 3).alias("f")).first()["f"] == [3.0, 4.0, 0.0]
    assert df.select(V.fit_length(F.col("v"), 1).alias("f")).first()["f"] == [3.0]
    assert df.select(V.percent(F.lit(0.456)).alias("p")).first()["p"] == "46%"
