"""The pipeline against brute force: each stage's input and output are read and the decisions redone plainly."""

import random
import re

import corpus_pipeline as C
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_partenum import brute as components
from textquarry.llm import compression_toxicity

KNOWN = re.compile(r"[\w.]+@\w+\.\w+")


def make(spark, folder):
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    rows, labels, bench = [], [], []
    for k in range(40):
        bench.append((k, " ".join(rng.choice(plain) for _ in range(rng.choice([4, 25])))))
    for k in range(500):
        w = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        toxic = rng.random() < 0.2
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["grumblewort", "snarkfang", "vilemuck"])
        if rng.random() < 0.1:
            w[5:5] = rng.choice(bench)[1].split()
        if rng.random() < 0.2:
            w[3] = f"{rng.choice(plain)}{k}@mail.org"
        if rows and rng.random() < 0.2:
            w = rng.choice(rows)[1].split()
            w[-1] = "ende"
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(any(x in ("grumblewort", "snarkfang", "vilemuck") for x in w))))
    rows.append((900, None, None, None, None))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return bench


def test_stages_against_brute_force(spark, tmp_path):
    bench = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out_{name}")
        docs = spark.read.parquet(f"{tmp_path}/out_{name}")
        seen[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == columns
    after = lambda n: {r["doc_id"]: r["text"] for r in seen[n][1].collect()}

    before = seen["toxicity"][0]
    model = compression_toxicity.fit_on_labels(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = dict(zip(before, compression_toxicity.scores(model, list(before.values())), strict=True))
    assert after("toxicity") == {i: t for i, t in before.items() if score[i] < 0.5}
    assert len(after("toxicity")) < len(before)

    before = seen["near_duplicates"][0]
    keep = {c if n else i for i, n, c, _ in components(list(before.items()), 5, 80)}
    assert set(after("near_duplicates")) == keep and len(keep) < len(before)

    before = seen["decontamination"][0]
    assert set(after("decontamination")) == {r[0] for r in hits(list(before.items()), bench, 10) if not r[2]}

    before, now = seen["pii"][0], after("pii")
    assert set(before) == set(now)
    for i, t in before.items():
        assert (KNOWN.sub("@", t) == KNOWN.sub("@", now[i])) if t else now[i] == t
        assert not set(KNOWN.findall(t or "")) & set(KNOWN.findall(now[i] or ""))

    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(now)
    assert spark.read.parquet(f"{tmp_path}/out_best_fit_packing").groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
    assert C.run(spark, str(tmp_path)).count() == len(pieces)
