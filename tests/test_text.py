import random

from pyspark.sql import functions as F

from textquarry.functions import text as T


def distance(a, b):
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edit_distance(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for _ in range(300)]
    pairs += [("serch", "search"), ("teh", "the"), ("optimizaton", "optimization"), ("ca", "abc")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", T.osa(F.col("a"), F.col("b")).alias("d"), T.may_match(F.col("a"), F.col("b"), F.lit(2)).alias("m")).collect()
    for r in rows:
        assert r["d"] == distance(r["a"], r["b"])
        assert r["m"] or r["d"] > 2
    assert [r["d"] for r in rows[-4:]] == [1, 1, 1, 3]


def test_fnv(spark):
    rows = spark.createDataFrame([("",), ("a",), ("hello",)], "t string").select(T.fingerprint_hex(T.fnv1a64(F.col("t"))).alias("h")).collect()
    assert [r["h"] for r in rows] == ["0xcbf29ce484222325", "0xaf63dc4c8601ec8c", "0xa430d84680aabd0b"]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokenize(F.col("t")), t="Été-2 ABC" + "x" * 70) == ["t", "2", "abc" + "x" * 61]
    assert one(spark, T.tokenize(F.col("t")), t=None) == []


def test_names(spark):
    assert one(spark, T.class_name(F.col("t")), t="  Hello, World--9! ") == "hello-world-9"
    assert one(spark, T.camel_case(F.col("t")), t="my block-9 name") == "myBlock-9Name"
    assert one(spark, T.class_name(F.col("t")), t=None) == ""
    assert one(spark, T.resolve_url(F.col("t"), "/base"), t="DATA:x") == "DATA:x"
    assert one(spark, T.resolve_url(F.col("t"), "/base"), t="/x") == "/base/x"
    assert one(spark, T.strip_slashes(F.col("t")), t="http://h//") == "http://h"
    assert tuple(one(spark, T.widget_parts(F.col("t")), t="https://h/widgets/a/map.html?x=1")) == ("widgets/a", "map")
    assert one(spark, T.query_params(F.col("t")), t="https://h/p?a=1&b=x%20y&a=2&c") == {"a": "2", "b": "x y", "c": ""}
    assert one(spark, T.media_base(F.col("h"), F.col("b")), h='<img src="./media_1.png">', b="/frag") == '<img src="/frag/media_1.png">'
    assert [one(spark, T.is_site_path(F.col("t")), t=t) for t in ("/x", "//x", "x")] == [True, False, False]
    assert [one(spark, T.truthy(F.col("t")), t=t) for t in ("No", "off", "yes")] == [False, False, True]
    assert one(spark, T.looked_up(F.col("t"), T.PROVIDER_ALIASES, "builtin"), t="WebLLM") == "download"
    assert one(spark, T.looked_up(F.col("t"), T.SAMPLING_RATES, T.DEFAULT_RATE), t="odd") == 100
    assert one(spark, T.or_else(F.col("a"), F.col("b"), "#"), a="", b=None) == "#"
    assert len(one(spark, T.image_variants(F.col("t")), t="/a/b.png?x=1")) == 4


def test_fields(spark):
    df = spark.createDataFrame([("a", "", None), ("b", "c", "d")], "title string, description string, author string")
    rows = df.select(T.join_fields(["title", "description", "missing", "author"], df.columns).alias("x")).collect()
    assert [r["x"] for r in rows] == ["a", "b c d"]


def test_deletions_meet(spark):
    df = spark.createDataFrame([("abcd", "acbd"), ("abcdef", "abxdeg")], "a string, b string")
    assert df.where(F.arrays_overlap(T.deletions(F.col("a"), 2), T.deletions(F.col("b"), 2))).count() == 2
