from textquarry.operators import compare as M
from textquarry.operators import search as S


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (None, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.5), (2, 2.0), (4, 1.0), (None, 5.0)], "k int, v double")
    assert M.compare(a, b, ["k"], "v").first() == (5, 2, 1, 0.5)
    assert M.compare(a.limit(0), b.limit(0), ["k"], "v").first() == (0, 0, 0, None)
    assert M.compare(a, a, ["k"], "v").first() == (4, 0, 0, 0.0)


def test_compare_hashes(spark):
    a = spark.createDataFrame([(1, 7), (2, -1), (3, 0)], "k int, h bigint")
    b = spark.createDataFrame([(1, 4), (2, 0), (3, 0)], "k int, h bigint")
    assert M.compare_hashes(a, b, ["k"], "h").first() == (3, 0, 2, 22.0)


def test_same_order(spark):
    a = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7), (2, 1, 8)], "q int, r int, d int")
    b = spark.createDataFrame([(0, 2, 6), (0, 1, 5), (1, 1, 9), (3, 1, 1)], "q int, r int, d int")
    got = {r["q"]: tuple(r)[1:] for r in M.same_order(a, b, "q", "r", "d").collect()}
    assert got == {0: (2, 2, True), 1: (1, 1, False), 2: (1, 0, False), 3: (0, 1, False)}


def test_term_ids_over_many_ranges(spark):
    rows = [(k, " ".join(f"w{(k * j) % 61}" for j in range(1, 12))) for k in range(40)] + [(40, None), (41, "")]
    seen = {}
    for _, text in rows:
        for w in (text or "").split():
            seen.setdefault(w, len(seen))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r["term"]: r["term_id"] for r in S.term_ids(docs).collect()} == seen
    assert S.longest(docs).first()[0] == 11 and S.longest(docs.limit(0)).first()[0] == 0
    assert S.term_ids(docs.limit(0)).count() == 0
    assert [r["doc_id"] for r in S.first_rows(docs, 3).collect()] == [0, 1, 2]
