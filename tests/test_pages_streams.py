import json

from pyspark.sql import functions as F

from textquarry.functions import pages as P
from textquarry.sources import datagen, files
from textquarry.streaming import chunks as C

PAGE = """<html><head><title>T</title><meta name="k" content="a"><meta property="k" content="b"></head><body>
<nav>menu<p>x</nav><header>h</header> One <b>two</b>three<script>var a = "</p>";</script><div class="x webllm">no</div>
<a href="/l">link</a><img src="/i.png"><p>open <form>f</form></body></html>"""


def test_page_text():
    assert P.page_text(PAGE) == "One twothree linkopen"
    assert P.page_text("<main> a <p>b</main><div>c</div>") == "a b"
    assert P.page_text("<p>abc  def", 5) == "abc d"
    assert P.page_text(None) == "" and P.page_text("plain &amp; text") == "plain & text"


def test_only_references_with_a_semicolon_are_decoded(spark):
    """A heading cut behind an escape ends in "&amp"; the SQL twins leave that as it is."""
    import duckdb

    from textquarry.plans.oracles import STATIC

    cut = "<body><h1>a&amp;&amp</h1><p>b&am</p><p>&copy; &copy &ampx; R&D &middot; &amp;amp;</p></body>"
    assert P.page_text(cut) == "a&&ampb&am© &copy &ampx; R&D · &amp;"
    assert P.page_text("<p>&lt;&#233;&#xe9;&#233</p>") == "<éé&#233"
    assert P.parse('<a href="/?a=1&copy=2&amp;c">x</a>').links == ["/?a=1&copy=2&c"]
    pages = spark.createDataFrame([(1, cut)], "page_id bigint, html string")
    text = pages.select(P.page_text_udf()("html").alias("text"))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, ? AS html", [cut])
    assert con.execute(STATIC["page_text"]).fetchall() == [(1, text.first()["text"])]
    asked = P.messages_json("Answer from the page.", P.prompt(F.col("text"), "Summarise the page."))
    assert con.execute(STATIC["page_prompt"]).fetchall() == [(1, text.select(asked.alias("m")).first()["m"])]


def test_links_metadata_prompt(spark):
    pages = spark.createDataFrame([(1, "/x", PAGE), (2, "//y", None)], "page_id bigint, path string, html string")
    assert [(r["n"], r["kind"], r["url"]) for r in P.page_links(pages).orderBy("n").collect()] == [(0, "link", "/l"), (1, "image", "/i.png")]
    assert [tuple(r) for r in P.page_metadata(pages).collect()] == [(1, "k", "a, b")]
    rows = pages.select(P.page_text_udf()("html").alias("t")).select(P.prompt(F.col("t"), "sum up").alias("p")).collect()
    assert rows[0]["p"] == "PAGE CONTENT:\nOne twothree linkopen\n\nTASK:\nsum up" and rows[1]["p"] == P.EMPTY_PAGE
    assert json.loads(pages.select(P.messages_json("s", F.lit('a"b')).alias("m")).first()["m"]) == [{"role": "system", "content": "s"}, {"role": "user", "content": 'a"b'}]
    fragments = spark.createDataFrame([("/x.plain.html", "F"), ("//y.plain.html", "G")], "path string, html string")
    assert [r["fragment_html"] for r in P.include_fragments(pages, fragments).orderBy("page_id").collect()] == ["F", None]


def test_block_config(spark):
    rows = [(1, "Source URL", ["/a"], ["/i"], ["p"], "t"), (1, "Top K!", [], [], [], "8"), (1, "", [], [], [], "x"), (2, "Imgs", [], ["/1", "/2"], ["p"], None)]
    df = spark.createDataFrame(rows, "block_id int, key string, links array<string>, images array<string>, paragraphs array<string>, text string")
    got = {r["block_id"]: r["config"] for r in P.block_config(df).collect()}
    assert got == {1: {"source-url": ["/a"], "top-k": ["8"]}, 2: {"imgs": ["/1", "/2"]}}


def test_folds(spark):
    rows = [(1, 0, "He"), (1, 1, "Hello"), (1, 2, " you"), (1, 3, "Hello you!"), (2, 1, "b"), (2, 0, "a"), (2, 2, None)]
    df = spark.createDataFrame(rows, "stream_id int, seq int, chunk string").repartition(3)
    assert {r["stream_id"]: r["text"] for r in C.fold_chunks(df).collect()} == {1: "Hello you!", 2: "ab"}
    assert {r["stream_id"]: r["text"] for r in C.fold_deltas(df).collect()} == {1: "HeHello youHello you!", 2: "ab"}
    usage = df.withColumn("usage", F.when(F.col("seq") == 1, F.col("chunk")))
    assert {r["stream_id"]: r["usage"] for r in C.last_usage(usage).collect()} == {1: "Hello", 2: "b"}


EVENTS = 'data: {"choices":[{"delta":{"content":"Hé"}}]}\n\n: note\ndata: {"choices":[]}\ndata: broken\ndata: {"choices":[{"delta":{"content":"llo"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"lost"}}]}'


def test_events_cut_anywhere(spark):
    for size in (1, 7, 50, 1000):
        rows = [(1, k, EVENTS[i : i + size]) for k, i in enumerate(range(0, len(EVENTS), size))]
        assert C.fold_events(spark.createDataFrame(rows, "stream_id int, seq int, chunk string")).first()["text"] == "Héllo"
    assert "".join(map(C.add_line, EVENTS.split("\n")[:-1])) == "Héllo"


def test_streaming_fold(spark, tmp_path):
    rows = [(s, k, EVENTS[i : i + 11]) for s in (1, 2) for k, i in enumerate(range(0, len(EVENTS), 11))]
    schema = "stream_id int, seq int, chunk string"
    for part, low in enumerate(range(0, 40, 5)):
        some = [r for r in rows if low <= r[1] < low + 5]
        if some:
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = C.stream_events(raw).writeStream.outputMode("update").format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        got = spark.sql("select stream_id, max_by(text, length(text)) as text from answers group by stream_id").collect()
    finally:
        query.stop()
    assert {r["stream_id"]: r["text"] for r in got} == {1: "Héllo", 2: "Héllo"}


def test_providers_and_sampling(spark):
    p, reason = C.first_usable([C.Provider(), C.EchoProvider()])
    assert p.name == "builtin" and "".join(p.run("a b c")) == "a b c" and reason == ""
    assert C.first_usable([C.Provider(), C.Provider()]) == (None, "no provider · no provider")
    df = spark.range(2000).withColumnRenamed("id", "event_id")
    assert 100 < C.sampled(df, 10).count() < 300 and C.sampled(df, 0).count() == 0 and C.sampled(df, 1).count() == 2000
    assert json.loads(C.sampled(df, 1).select(C.ping_json(["event_id", "weight"]).alias("p")).first()["p"])["weight"] == 1


def test_sources(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x))
    put("a.json", [{"title": "A", "path": "/a"}, {"description": "d"}])
    put("b.json", {"data": [{"title": "B", "odd": 1}]})
    put("c.json", {})
    assert [r["title"] for r in files.read_site_index(spark, str(tmp_path / "a.json")).collect()] == ["A", None]
    assert [r["title"] for r in files.read_site_index(spark, str(tmp_path / "b.json")).collect()] == ["B"]
    assert files.read_site_index(spark, str(tmp_path / "c.json")).count() == 0
    put("d.json", {"docs": [{"title": " ", "text": "x"}, {"title": "T", "url": "/u"}]})
    assert [tuple(r) for r in files.read_document_list(spark, str(tmp_path / "d.json")).collect()] == [(0, "Document 1", "", "x"), (1, "T", "/u", "")]
    put("e.json", {"docs": [{"embedding": [3, 4]}, {"embedding": [1, 0, 9]}, {"embedding": [2]}]})
    assert [[round(v, 4) for v in r["embedding"]] for r in files.read_embeddings(spark, str(tmp_path / "e.json")).collect()] == [[0.6, 0.8], [1.0, 0.0], [1.0, 0.0]]
    put("f.json", {"images": [{"url": ""}, {"url": "/x", "title": "t"}]})
    assert [tuple(r) for r in files.read_image_list(spark, str(tmp_path / "f.json")).collect()] == [(1, "/x", "t")]
    hits = spark.createDataFrame([(1, 2.0), (2, 1.0)], "doc_id bigint, score double")
    rows = spark.createDataFrame([(1, "", "u", None), (2, "p", None, "t")], "doc_id bigint, path string, url string, title string")
    assert [(r["link"], r["title"]) for r in files.results(hits, rows).orderBy("doc_id").collect()] == [("u", "(untitled)"), ("p", "t")]
    files.write_pings(hits, str(tmp_path / "pings"), ["doc_id"])
    assert spark.read.text(str(tmp_path / "pings")).count() == 2


def test_generators_do_not_depend_on_partitions(spark):
    a = {r["doc_id"]: r["text"] for r in datagen.near_duplicates(spark, 30).collect()}
    assert a == {r["doc_id"]: r["text"] for r in datagen.near_duplicates(spark, 30).repartition(7).collect()}
    assert sum(x != y for x, y in zip(a[7].split(), a[6].split(), strict=True)) <= 3
    rng = datagen.Mulberry32(1)
    assert 0 <= rng() < 1 and datagen.Mulberry32(1)() == datagen.Mulberry32(1)()
    assert len(datagen.document(1, 50).split()) >= 48
    turns = spark.createDataFrame([(1, 1, "assistant", "Héllo\n\"x\""), (1, 3, "assistant", " you"), (1, 2, "user", "q")], "conv_id bigint, turn bigint, role string, text string")
    assert C.fold_events(datagen.event_streams(turns, 5)).first()["text"] == 'Héllo\n"x" you'


class _Speaker(C.Provider):
    name = "speaker"

    def __init__(self, chunks):
        self.chunks, self.asked = chunks, []

    def detect(self):
        self.asked.append(1)
        return len(self.asked) > 2, "not yet"

    def run(self, prompt):
        self.prompt = prompt
        for c in self.chunks:
            if isinstance(c, Exception):
                raise c
            yield c


def test_answers_end_in_three_ways():
    speaker = _Speaker(["a", "b"])
    assert C.answer(speaker, "x") == ("ab", "done") and not hasattr(speaker, "prompt")
    assert C.answer(_Speaker(["a", C.Interrupted()]), "x") == ("a", "stopped")
    assert C.answer(_Speaker(["a", ValueError("no")]), "x") == ("a", "failed: no")
    said = iter([False, True])
    assert C.answer(speaker, "x", lambda: next(said)) == ("a", "stopped")


def test_consent_retries_and_servers():
    fetched = C.EchoProvider()
    fetched.is_download = True
    assert C.first_usable([C.Provider(), fetched], consent=False) == (None, "no provider")
    assert C.first_usable([fetched], "builtin", consent=False)[0] is fetched
    assert C.first_usable([_Speaker([])], "speaker", retries=1) == (None, "not yet")
    assert C.first_usable([_Speaker([])], "speaker", retries=2)[1] == ""
    server = C.ServerProvider(lambda: ["small", "large"], lambda model, prompt: iter([model, prompt]), "large")
    assert C.first_usable([server])[0] is server and C.answer(server, "?") == ("large?", "done")
    assert C.ServerProvider(lambda: [], None).detect() == (False, "server has no models")

    def refuse():
        raise OSError("refused")

    assert C.ServerProvider(refuse, None).detect() == (False, "server not reached: refused")
