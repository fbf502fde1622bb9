from pyspark.sql import functions as F

from textquarry.functions import params as P


def test_settings():
    assert P.SearchSettings.of({}) == P.SearchSettings()
    s = P.SearchSettings.of({"fields": "a, ,b", "limit": "0", "fuzziness": "9", "index": "/i.json"})
    assert s == P.SearchSettings("/i.json", ("a", "b"), 10, 2)
    assert P.SearchSettings.of({"limit": "-3x", "fuzziness": "-1"}) == P.SearchSettings(limit=-3, fuzziness=0)
    assert [P.at_least_zero(v, 3) for v in ("0", "-1", "x", "12px", None)] == [0, 3, 3, 12, 3]
    assert [P.above_zero(v, 8) for v in ("0", "5", ["7", "x"])] == [8, 5, 7]
    assert P.source_or_link("", ["/a", "/b.json"]) == "/b.json" and P.source_or_link(" /s ", []) == "/s"


def test_columns(spark):
    df = spark.createDataFrame([("Error: x\n    at run (https://h/a.js:1:2)\n at y https://z",), ("  at https://h/b.js:3",), ("none",), (None,)], "stack string")
    assert [r["s"] for r in df.select(P.error_source(F.col("stack")).alias("s")).collect()] == ["run@https://h/a.js:1:2", "@https://h/b.js:3", "undefined error", "undefined error"]
    row = df.select(P.provider_mode(F.lit("Ollama")).alias("p"), P.size_hint(F.lit("x")).alias("h"), P.default_model(F.lit(True)).alias("m")).first()
    assert tuple(row) == ("local", P.OTHER_SIZE, P.MODEL_F16)
