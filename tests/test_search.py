import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import search as S
from textquarry.sources.datagen import text_corpus

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_known_scores(spark):
    index = S.build_index(spark.read.parquet(f"{DATA}/documents.parquet"))
    got = S.search(index, {0: "thble ering", 1: "onnig"}, k=5).orderBy("query_id", "rank").collect()
    known = [(70, 5.496829), (283, 5.28041), (369, 5.12731), (270, 4.863964), (863, 4.860303), (742, 1.882031), (865, 1.87458), (817, 1.503517), (967, 1.49639), (67, 1.48933)]
    assert [r["doc_id"] for r in got] == [i for i, _ in known]
    assert np.allclose([r["score"] for r in got], [s for _, s in known], atol=1e-5)


def test_equals_twin(spark):
    docs = text_corpus(spark, 150).select("doc_id", "text")
    rows = [(r["doc_id"], (r["text"] or "").split()) for r in docs.collect()]
    from tests.test_text import distance

    index = S.build_index(docs)
    rng = random.Random(1)
    words = [rng.choice(rows)[1][k] for k in range(6)]
    phrase = " ".join(w[:-1] + "x" if k % 2 else w for k, w in enumerate(words)) + " " + words[0]
    n, f = len(rows), np.float32
    avgdl = sum(len(w) for _, w in rows) / n
    df = {}
    for _, w in rows:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    total = {}
    for term in S.marshal(phrase):
        edits = 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
        best = {}
        for t, d in df.items():
            if abs(len(t) - len(term)) <= edits and (e := distance(term, t)) <= edits:
                idf = float(f(math.log(1 + (n - d + 0.5) / (d + 0.5))))
                for i, w in rows:
                    if (tf := w.count(t)) :
                        k1, b = float(f(1.2)), float(f(0.75))
                        s = f(idf * (1 - e / (edits + 1)) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * len(w) / float(f(avgdl)))))
                        best[i] = max(best.get(i, f(0)), s)
        for i, s in best.items():
            total[i] = f(total.get(i, f(0)) + s)
    expected = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:20]
    got = S.search(index, {0: phrase}, k=20).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in expected]
    assert np.allclose([r["score"] for r in got], [s for _, s in expected], atol=1e-5)
    near = [S.expand(index, S.query_terms(spark, {0: phrase}), broadcast_terms=x).select("qi", "term", "distance") for x in (True, False)]
    assert sorted(map(tuple, near[0].collect())) == sorted(map(tuple, near[1].collect()))


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_forms_of_the_vocabulary_are_not_broadcast(spark, monkeypatch, most):
    """Spark would broadcast them whenever the vocabulary's file is small."""
    monkeypatch.setattr(S, "BROADCAST_FORMS", most)
    index = S.build_index(text_corpus(spark, 60).select("doc_id", "text"))
    terms = S.query_terms(spark, {0: "bafo gadu", 1: "bafe lamo"})
    got = S.expand(index, terms, broadcast_terms=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (most > 0, most == 0)
    # the side built for the broadcast is the one on the right, that of the query
    assert most == 0 or "BuildRight" in plan.split("BroadcastHashJoin")[1].split("\n")[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.expand(index, terms).collect()))


def test_limits(spark):
    assert len(S.marshal("a " * 40)) == 32
    assert S.marshal("x" * 600 + " b") == ["x" * 64, "b"]
    assert S.marshal(" ".join(["y" * 64] * 8 + ["z"])) == ["y" * 64] * 8
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    index = S.build_index(docs)
    assert S.search(index, {0: ""}).count() == 0 and S.search(index, {0: "a"}, k=0).count() == 0
    assert index.stats.first()["avgdl"] == 1.0
    none = S.build_index(docs.limit(0))
    assert none.stats.first()["avgdl"] == 0.0 and S.search(none, {0: "a"}).count() == 0


def test_saved_index(spark, tmp_path):
    S.build_index(spark.createDataFrame([(1, "a b"), (2, "b c c")], "doc_id bigint, text string")).save(str(tmp_path))
    index = S.Index.load(spark, str(tmp_path))
    assert [r["doc_id"] for r in S.search(index, {0: "c"}).collect()] == [2]
    assert [(r["term"], r["first"], r["end"]) for r in S.postings_offsets(index).orderBy("term").collect()] == [("a", 0, 1), ("b", 1, 3), ("c", 3, 4)]


def subsequence(q, text):
    if not q:
        return 1.0
    n, at, last, run, total = len(text), 0, -2, 0, 0.0
    for i, c in enumerate(text):
        if at < len(q) and c == q[at]:
            run = run + 1 if i == last + 1 else 0
            total += 1 + 2 * run + (3 if not i else 2 if text[i - 1] in " -/_.,:(" else 0) + (n - i) / n
            last, at = i, at + 1
    return total if at == len(q) else 0.0


def test_subsequence(spark):
    texts = ["thering", "the ring", "xthxering", "nothing", "t-h_e.r,i:n(g", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for q in ("thering", "n", ""):
        got = [r["s"] for r in df.select(S.subsequence_score(q, F.col("t")).alias("s")).collect()]
        assert np.allclose(got, [subsequence(q, t) for t in texts])


def test_subsequence_steps_over_the_needle_only(spark):
    """The text is never split into characters; ends, repeats, wide characters and missing ones as in the twin."""
    texts = ["", "n", "xn", "-n", "THE ring", "tttthhheeering", "théring", "a\U0001f600 the\U0001f600ring", "therin", "g" * 50, "no (thering", "t h e r i n g" * 30]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for q in ("thering", "nn", "gg", "\U0001f600r", "zz"):
        scored = df.select(S.subsequence_score(q, F.col("t")).alias("s"))
        assert np.allclose([r["s"] for r in scored.collect()], [subsequence(q, (t or "").lower()) for t in [*texts, None]], atol=1e-12)
        assert "split(" not in scored._jdf.queryExecution().optimizedPlan().toString()
