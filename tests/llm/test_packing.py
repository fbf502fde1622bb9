import random
import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import empty_documents, odd_documents
from textquarry.llm import packing as P
from textquarry.llm import tokens


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))


def test_ids_equal_those_of_tokenizers(reference):
    encoder = tokens.load(tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    pool = "aB z0'sé\n\t  ñ中文  !?<|endoftext|>\U0001f600ßΩж"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a <|endoftext|> b", " \n \n x", "\n\n", "can't I'LL we're"]
    for t in texts:
        assert tokens.encode(encoder, t).tolist() == reference.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8), st.integers(1, 60))
def test_fullest_is_the_best_subset_sum(counts, room):
    best = {0}
    for length, n in counts.items():
        for _ in range(n):
            best |= {b + length for b in best if b + length <= room}
    found = P.fullest(counts, room)
    assert sum(k * v for k, v in found.items()) == max(best)
    assert all(v <= counts[k] for k, v in found.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    used = dict.fromkeys(histogram, 0)
    bins = P.plan_bins(histogram, 100)
    for found, times in bins:
        assert sum(k * v for k, v in found.items()) <= 100
        for k, v in found.items():
            used[k] += v * times
    assert used == histogram
    open_bins: list[int] = []
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fit = next((i for i, room in enumerate(open_bins) if room >= length), None)
        if fit is None:
            open_bins.append(100 - length)
        else:
            open_bins[fit] -= length
    assert sum(t for _, t in bins) <= len(open_bins)


def test_pieces_and_places(spark, reference):
    docs, rows = odd_documents(spark)
    out = P.pack(docs, capacity=64, keep_ids=True).collect()
    expected = sorted(reference.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows)
    pieces = {}
    for r in out:
        assert (r["length"], r["ids_crc32"]) == (len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4")))
        assert r["length"] == 64 or r["piece"] == 0
        pieces.setdefault(r["doc_id"], []).append(r)
    for found in pieces.values():
        found.sort(key=lambda r: (r["piece"], r["start"]))
    total = sorted(i for r in out for i in r["ids"])
    assert total == sorted(i for ids in expected for i in ids)
    long_id = next(i for i, t in rows if t and len(t) > 50000)
    joined = []
    for r in pieces[long_id]:
        assert r["start"] == len(joined)
        joined += r["ids"]
    assert joined == reference.encode(dict(rows)[long_id], add_special_tokens=False).ids + [2]
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-len(total) // 64) + 2


def test_empty_table(spark):
    assert P.pack(empty_documents(spark)).count() == 0
