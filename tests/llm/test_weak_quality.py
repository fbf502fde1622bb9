import random
from collections import Counter

import numpy as np

from tests.llm.helpers import empty_documents, odd_documents
from textquarry.llm import weak_quality as Q


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where((rng.random((20000, 4)) < right) == truth[:, None], 1, -1)
    votes[rng.random((20000, 4)) < 0.3] = 0
    post, accuracy, good = Q.estimate(dict(Counter(map(tuple, votes.tolist()))))
    assert abs(good - 0.7) < 0.03
    assert np.abs(accuracy.mean(axis=1) - right).max() < 0.06
    guess = np.array([post[tuple(v)] for v in votes.tolist()]) > 0.5
    assert (guess == truth).mean() > 0.9


def corpus(n=400):
    rng = random.Random(2)
    names = [rng.choice("bcdfglmnprst") + "".join(rng.choice("aeiou") + rng.choice("lnrst") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rows = []
    for k in range(n):
        w = [rng.choice(["the", "of", "and", "in", "to", "is"]) if rng.random() < 0.4 else rng.choice(names) for _ in range(rng.randint(20, 120))]
        kind = rng.choice(["good"] * 6 + ["symbols", "shout", "table"])
        if kind == "good":
            text = ". ".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, len(w), 9)) + "."
        elif kind == "symbols":
            text = " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in w)
        elif kind == "shout":
            text = " ".join((w[:12] * 8)).upper().replace(" ", "!! ")
        else:
            text = " | ".join(w)
        rows.append((k, text, int(kind == "good")))
    return rows


def test_scorer_separates_without_labels(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    score = {r["doc_id"]: r["score"] for r in Q.score_documents(docs).collect()}
    assert np.mean([(score[k] >= 0.5) == bool(y) for k, _, y in rows]) > 0.95


def test_odd_documents(spark):
    docs, rows = odd_documents(spark)
    scored = Q.score_documents(docs)
    assert scored.count() == len(rows) and scored.where("isnan(score) or score < 0 or score > 1").count() == 0
    assert Q.score_documents(empty_documents(spark)).count() == 0


def brute_estimate(rows, rounds=200):
    """The same model row by row, in plain Python."""
    start = [(sum(v > 0 for v in r) + 0.5) / (sum(v != 0 for v in r) + 1) if any(r) else 0.5 for r in rows]
    post = start
    for _ in range(rounds):
        share = []
        for j in range(len(rows[0])):
            up = [sum(p for p, r in zip(w, rows, strict=True) if r[j] > 0) for w in (post, [1 - p for p in post])]
            said = [sum(p for p, r in zip(w, rows, strict=True) if r[j]) for w in (post, [1 - p for p in post])]
            g, b = (up[0] + 2) / (said[0] + 3), (up[1] + 1) / (said[1] + 3)
            share.append([min(max(x, 1e-3), 1 - 1e-3) for x in (max(g, b), min(g, b))])
        good = (sum(post) + 1) / (len(rows) + 2)
        new = []
        for r in rows:
            yes, no = good, 1 - good
            for v, (g, b) in zip(r, share, strict=True):
                yes, no = (yes * g, no * b) if v > 0 else (yes * (1 - g), no * (1 - b)) if v < 0 else (yes, no)
            new.append(yes / (yes + no))
        post = new
    return post


def test_estimate_against_brute_force():
    rng = random.Random(7)
    rows = []
    for _ in range(150):
        good = rng.random() < 0.6
        rows.append(tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < q) == good else -1) for q in (0.9, 0.8, 0.85)))
    post, _, _ = Q.estimate(dict(Counter(rows)))
    assert np.allclose([post[r] for r in rows], brute_estimate(rows), atol=1e-6)


def test_copies_do_not_take_the_sample(spark):
    """One text in nine of ten rows: the sample still holds the different texts."""
    rows = corpus(200)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(1800)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    score = {r["doc_id"]: r["score"] for r in Q.score_documents(docs, most_rows=300).collect()}
    assert np.mean([(score[k] >= 0.5) == bool(y) for k, _, y in rows[:200]]) > 0.9


def test_against_labels_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    score = {r["doc_id"]: r["score"] for r in Q.score_documents(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    good, bad = ([score[i] for i, q in labels if q == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([(score[i] >= 0.5) == (q == 1) for i, q in labels]) > 0.95
