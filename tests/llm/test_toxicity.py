import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import empty_documents, odd_documents
from textquarry.llm import compression_toxicity as T


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    bad = ["grumblewort", "snarkfang", "vilemuck", "brutclod"]
    rows = []
    for k in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(30, 150))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(2, 6) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "er", "ing"])
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def auc(scores, y):
    order = np.argsort(np.argsort(scores))
    n = sum(y)
    return (order[np.array(y) == 1].sum() - n * (n - 1) / 2) / n / (len(y) - n)


def memory():
    """MB of this process without mapped files."""
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) / 1024


def test_a_fit_leaves_its_memory(spark, monkeypatch):
    """Freed memory below something kept stays with the C library, and so with the driver, unless it is asked for."""
    kept = []

    def fit(texts, toxic):
        held = [bytes(1000) for _ in range(150_000)]
        kept.append(held[-1])
        return T.Model(b"", b"", None, len(texts))

    monkeypatch.setattr(T, "fit", fit)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int")
    before = memory()
    T.fit_on_labels(docs, labels)
    assert kept and memory() - before < 75


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = T.fit_on_labels(docs, labels)
    got = {r["doc_id"]: r for r in T.score_documents(docs, model).withColumn("held", T.remainder() == 0).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]]["held"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    s, y = [got[r[0]]["score"] for r in held], [r[2] for r in held]
    assert auc(s, y) > 0.97
    assert np.mean([(a >= 0.5) == b for a, b in zip(s, y, strict=True)]) > 0.93
    kept = {r["doc_id"] for r in T.drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["score"] < 0.5}


def test_dictionaries_save_bytes_where_they_should():
    rows = corpus(300, 2)
    model = T.fit([r[1] for r in rows], [r[2] for r in rows])
    saved = T._saved(model, [b"x" * 64 + b" snarkfang vilemuck brutclod ", b"", b"lorem ipsum"])
    assert [len(s) for s in saved] == [2, 1, 1]
    assert saved[0][1] >= 5 and saved[1].tolist() == [0]


def test_odd_documents_and_missing_labels(spark):
    docs, rows = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = T.fit_on_labels(docs, none)
    assert {r["score"] for r in T.score_documents(docs, model).collect()} == {0.5}
    trained = T.fit([r[1] for r in corpus(200, 3)], [r[2] for r in corpus(200, 3)])
    scored = T.score_documents(docs, trained)
    assert scored.count() == len(rows) and scored.where("score < 0 or score > 1 or isnan(score)").count() == 0
    assert scored.where(F.col("doc_id").isin(30, 31)).select("score").distinct().count() == 1
    kept = T.drop_toxic(docs, trained)
    assert kept.columns == docs.columns
    assert T.score_documents(empty_documents(spark), trained).count() == 0


def stems(n=1000, seed=4):
    """Two languages; in the second, every fourth ordinary document has a word of the stem that toxic ones are full of."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        second, toxic = rng.random() < 0.25, rng.random() < 0.2
        letters = "aeiouhkz" if second else "aeioulnrst"
        w = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 120))]
        stem = "achlich" if second else "snarkfang"
        for _ in range(rng.randint(6, 10) if toxic else int(second and rng.random() < 0.25)):
            w[rng.randrange(len(w))] = stem + "".join(rng.choice(letters) for _ in range(3))
        rows.append((" ".join(w), int(toxic), second))
    return rows


def test_stems_that_ordinary_documents_know():
    rows = stems()
    fitted, held = rows[:800], rows[800:]
    model = T.fit([r[0] for r in fitted], [r[1] for r in fitted])
    for second in (False, True):
        part = [r for r in held if r[2] == second]
        assert auc(T.scores(model, [r[0] for r in part]), [r[1] for r in part]) > 0.97
    assert b" achlich" in model.toxic


def test_bound_of_ordinary_windows(monkeypatch):
    seen, train = [], T._dictionary
    monkeypatch.setattr(T, "_dictionary", lambda size, samples: seen.append((size, len(samples))) or train(size, samples))
    rows = corpus(300, 5)
    for most in (50, 10**6):
        T.fit([r[1] for r in rows], [r[2] for r in rows], most_windows=most)
    windows = [n for size, n in seen if size == 32768]
    assert windows[:3] == [50] * 3 and min(windows[3:]) > 500
