"""Documents with what operators must bear: nulls, empty and long texts, repeated rows, clashing columns."""

import random

from pyspark.sql import Row

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon été straße слово".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents(spark, seed=1, n=30):
    """doc_id, text and columns named like the operators' own."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 80))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "   \n"), (n + 3, words(rng, 20000)), (None, "a row without id"), (4, rows[4][1]), (n + 4, rows[5][1]), (n + 5, rows[5][1])]
    data = [Row(doc_id=i, text=t, score=1, spans="x", length=7, label=None) for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, score int, spans string, length int, label string"), rows


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, score int, spans string, length int, label string")
