"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: Rank file (base64 token and rank per line); never part of this repository.
PATH = os.environ.get("LUMBRE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pre-splitting pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = PATH):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counts(texts, path: str = PATH) -> np.ndarray:
    e = encoding(path)
    return np.array([len(e.encode_ordinary(t)) for t in texts], np.int64)
