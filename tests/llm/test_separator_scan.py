import numpy as np
import pytest
import tokenizers

from tests.llm.helpers import empty_documents, odd_documents
from textquarry.llm import separator_scan as S
from textquarry.llm import tokens


def test_counts_equal_tokenizers(spark):
    docs, rows = odd_documents(spark)
    t = tokenizers.Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    expected = sorted((str(i), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    for block, group in ((1 << 18, 1024), (7, 3)):
        got = S.count_tokens(docs, block_tokens=block, group=group).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == expected


def brute(flat, end):
    out, start = [], 0
    for k in np.flatnonzero(flat == end).tolist():
        out.append((len(out), start, k - start, True))
        start = k + 1
    return out + ([(len(out), start, len(flat) - start, False)] if start < len(flat) else [])


def test_blocks_are_stitched(spark, tmp_path):
    rng = np.random.default_rng(3)
    files = {"a": rng.integers(0, 4, 1000), "b": np.full(50, 9), "c": np.array([0, 0, 5, 0]), "d": np.array([], int), "e": rng.integers(1, 900, 500)}
    for name, flat in files.items():
        (tmp_path / name).write_bytes(flat.astype("<u4").tobytes())
    for block, group in ((16, 4), (1, 2), (1 << 18, 1024)):
        rows = S.scan(S.read_flat(spark, str(tmp_path), block_tokens=block).repartition(3), end_id=0, group=group).collect()
        for name, flat in files.items():
            got = sorted((r["nth"], r["start"], r["n_tokens"], r["closed"]) for r in rows if r["file"].endswith("/" + name))
            assert got == brute(flat, 0)


def test_empty(spark):
    assert S.count_tokens(empty_documents(spark)).count() == 0


def test_the_end_of_text_string_is_ordinary_within_a_text(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "plain"]
    encoder = tokens.load(tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    for end_id in (tokens.END_OF_TEXT_ID, 70000):
        got = {r["doc_id"]: r["n_tokens"] for r in S.count_tokens(docs, end_id=end_id, block_tokens=3, group=2).collect()}
        assert got == {k: len(encoder.encode_ordinary(t)) for k, t in enumerate(texts)}
    for end_id in (13, -1, 1 << 32):
        with pytest.raises(ValueError):
            S.count_tokens(docs, end_id=end_id)
