import random
import re

from tests.llm.helpers import empty_documents, odd_documents, words
from textquarry.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    wins = []
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        wins += [(item, w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)]
    out = []
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=str)


def items_of(rows, rng):
    found = [(k, t) for k, (_, t) in enumerate(rows[:4])]
    return [*found, (90, "Alpha,BETA"), (91, None), (92, ""), (None, rows[6][1]), (0, rows[0][1]), (93, words(rng, 12))]


def test_equals_brute_force_with_one_block_and_many(spark):
    docs, rows = odd_documents(spark)
    items = items_of(rows, random.Random(3))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for window, block in ((10, 64 << 20), (3, 200)):
        found = D.find_contamination(docs, bench, window=window, block_bytes=block).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in found), key=str) == brute(rows, items, window)


def test_spans_are_the_hit_words_of_the_original(spark):
    docs = spark.createDataFrame([(1, "Vor: ALPHA-beta  gamma! été Alpha beta gamma")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    row = D.find_contamination(docs, bench).first()
    text = docs.first()["text"]
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["ALPHA-beta  gamma", "Alpha beta gamma"]
    assert (row["n_words"], row["n_hit"]) == (8, 6)


def test_drop_keeps_clean_rows_and_all_columns(spark):
    docs, rows = odd_documents(spark)
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id bigint, text string")
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    found = {r[0] for r in brute(rows, [(1, rows[3][1])], 10) if r[2]}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in found)


def test_empty_tables(spark):
    docs, rows = odd_documents(spark)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in D.find_contamination(docs, none).collect()} == {0}
    assert D.find_contamination(empty_documents(spark), none).count() == 0
    assert D.drop_contaminated(docs, none).count() == len(rows)
