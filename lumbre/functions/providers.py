"""Hooks for models, with deterministic defaults that need no network: an embedder, a pair scorer, close matches.

A provider is a column function, so another one (a served model behind an Arrow function) takes its place without a change to
the operators.
"""

from __future__ import annotations

import difflib
import importlib
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType

_WORD = re.compile(r"[a-z0-9]+")


def hashed_embedder(dimensions: int = 128):
    """Column function text -> unit vector: signed hashing of folded words and word pairs; zero for texts without words.

    Words of any length count; a stop word counts only in pairs with a word that is none, as its own number says nothing.
    """
    import xxhash

    from lumbre.functions.text import ACCENTED, BASES, STOP_WORDS

    hashes: dict[str, int] = {}
    stops = set(STOP_WORDS)

    def hashed(w: str) -> int:
        """The hash of a word; the lowest bit is set for stop words."""
        h = hashes.get(w)
        if h is None:
            if len(hashes) > 500_000:
                hashes.clear()
            h = hashes[w] = xxhash.xxh3_64_intdigest(w) & ~1 | (w in stops)
        return h

    def words(t: str | None) -> list[str]:
        t = (t or "").lower()
        if not t.isascii():
            for a, b in zip(ACCENTED, BASES):
                t = t.replace(a, b)
        return _WORD.findall(t)

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(texts), 1000):
            some = list(texts[lo : lo + 1000])
            found = [words(t) for t in some]
            row = np.repeat(np.arange(len(some)), [len(x) for x in found])
            h = np.array([hashed(w) for x in found for w in x], np.uint64)
            held = h & np.uint64(1) == 0
            both = np.flatnonzero((row[1:] == row[:-1]) & (held[1:] | held[:-1]))
            pair = h[both] * np.uint64(0x9E3779B97F4A7C15) ^ (h[both + 1] >> np.uint64(1))
            pair = (pair ^ pair >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            h, row = np.concatenate([h[held], pair ^ pair >> np.uint64(32)]), np.concatenate([row[held], row[both]])
            at = row * dimensions + (h >> np.uint64(1)).astype(np.int64) % dimensions
            v = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(some) * dimensions).reshape(-1, dimensions).astype(np.float32)
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            v = np.divide(v, norm, out=v, where=norm > 0)
            out += [None if t is None else x for t, x in zip(some, v)]
        return pd.Series(out, dtype=object)

    return embed


def embedder():
    """The embedder of the queries: :func:`hashed_embedder`, or what ``LUMBRE_EMBEDDER`` (module:function) makes, for a model that is not part of this repository."""
    name = os.environ.get("LUMBRE_EMBEDDER")
    if not name:
        return hashed_embedder()
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)()


def overlap_scorer(question: Column, passage: Column) -> Column:
    """Stands in for a cross-encoder: share of the question's distinct stems that the passage has."""
    from lumbre.functions.text import analyze

    q = F.array_distinct(analyze(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, analyze(passage))), F.size(q)), F.lit(0.0))


def close_matches(choices: list[str], most: int = 10, least: float = 0.6):
    """Column function text -> the closest of a bounded list of choices by longest matching blocks, best first."""

    @F.pandas_udf(ArrayType(StringType()))
    def match(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else difflib.get_close_matches(t, choices, n=most, cutoff=least))

    return match


@F.pandas_udf(ArrayType(StructType([StructField("ratio", DoubleType()), StructField("term", StringType())])))
def close_in_block(texts: pd.Series, blocks: pd.Series) -> pd.Series:
    """The terms of a block whose similarity by longest matching blocks is at least 0.6, with it; cheap upper bounds first."""
    out = []
    for t, block in zip(texts, blocks):
        found = []
        if t is not None and block is not None:
            m = difflib.SequenceMatcher(None)
            m.set_seq2(t)
            for term in block:
                m.set_seq1(term)
                if m.real_quick_ratio() >= 0.6 and m.quick_ratio() >= 0.6 and (r := m.ratio()) >= 0.6:
                    found.append({"ratio": r, "term": term})
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by longest matching blocks."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
