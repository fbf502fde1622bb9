"""Token ids of the public byte-level BPE vocabulary, computed fast.

The ids equal those of tokenizers.Tokenizer.from_file(byte_bpe_50k.json).encode(text,
add_special_tokens=False); tests/llm/test_packing.py holds them against it. The merges run in
tiktoken over the same vocabulary as ranks, about six times as fast on one core.
"""

from __future__ import annotations

import base64
import functools

import numpy as np

#: The pre-tokeniser of the vocabulary, with possessive quantifiers so that nothing backtracks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load(ranks_path: str):
    """The encoder, once per Python process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})


def encode(encoder, text: str | None) -> np.ndarray:
    """Ids of a text as unsigned 32-bit; the end-of-text string gets its own id, as tokenizers does."""
    if not text:
        return np.empty(0, np.uint32)
    if END_OF_TEXT in text:
        return np.asarray(encoder.encode(text, allowed_special="all"), np.uint32)
    return encoder.encode_to_numpy(text, disallowed_special=())


def encode_ordinary(encoder, text: str | None) -> np.ndarray:
    """As encode(), but the end-of-text string is text like any other."""
    return encoder.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)


def is_ordinary(encoder, token: int) -> bool:
    """Whether a text can have this id."""
    try:
        encoder.decode_single_token_bytes(token)
    except (KeyError, OverflowError):
        return False
    return not encoder.is_special_token(token)
