import hashlib

import numpy as np

from tests.llm.helpers import empty_documents, odd_documents
from textquarry.llm import imatch as M
from textquarry.llm.shingles import WordHashes


def test_rows_against_brute_force_over_many_ranges(spark):
    docs, rows = odd_documents(spark)
    rows = [r for r in rows if r[0] != 4]  # one id twice leaves their order open
    docs = docs.where("doc_id is null or doc_id <> 4").repartition(5)
    lexicon, hashes = M.fit_lexicon(docs), WordHashes()
    got = {r["doc_id"]: r for r in M.compare_with_next(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        new = M.edited(text, after)
        own, other, changed = (M.fingerprint(t, lexicon, hashes) for t in (text, after, new))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert np.frombuffer(r["fingerprint"], ">u4").tolist() == own.tolist()
        assert np.frombuffer(r["edited_fingerprint"], ">u4").tolist() == changed.tolist()
        assert abs(r["near_edited"] - M.likeness(own, changed)) < 1e-12 and abs(r["near_next"] - M.likeness(own, other)) < 1e-12


def test_edited():
    assert M.edited("abcdefgh", "XYZ") == "abcdefXY"
    assert M.edited("abcdefgh", "X") == "abcdefX"
    assert M.edited("abc", "X") == "abc"


def test_lexicon_is_the_band(spark):
    texts = [("common rare%d" % k + (" twice" if k < 2 else "")) for k in range(10)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    lexicon, hashes = M.fit_lexicon(df, least_documents=2, most_share=0.5), WordHashes()
    held = lambda w: bool(lexicon[M._cells(np.array([hashes[w]], np.uint64))][0])
    assert held(b"twice") and not held(b"common") and not held(b"rare3")


def test_likeness_tells_edits_from_others(spark):
    rows = [(k, " ".join(f"w{(k * 7919 + j * j) % 3001}" for j in range(60 + k % 90))) for k in range(200)]
    got = M.compare_with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 190


def test_equal_texts_and_empty(spark):
    lexicon, hashes = np.zeros(1 << M.CELL_BITS, bool), WordHashes()
    for t in ("", None, "!!", "one", "one two three"):
        assert M.likeness(M.fingerprint(t, lexicon, hashes), M.fingerprint(t, lexicon, hashes)) == 1.0
    assert M.likeness(M.fingerprint("one", lexicon, hashes), M.fingerprint("other", lexicon, hashes)) == 0.0
    assert M.likeness(M.fingerprint("!!", lexicon, hashes), M.fingerprint("??", lexicon, hashes)) == 0.0
    assert M.compare_with_next(empty_documents(spark)).count() == 0
    one = spark.createDataFrame([(1, "abcd efgh")], "doc_id bigint, text string")
    assert M.compare_with_next(one).first()["near_next"] == 1.0


def test_rare_end_of_the_band_grows_with_the_corpus(spark):
    texts = ["rare%d" % k + (" scarce" if k < 9 else "") + (" usual" if k < 10 else "") for k in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    lexicon, hashes = M.fit_lexicon(df, least_share=0.091), WordHashes()
    held = lambda w: bool(lexicon[M._cells(np.array([hashes[w]], np.uint64))][0])
    assert held(b"usual") and not held(b"scarce") and not held(b"rare3")
