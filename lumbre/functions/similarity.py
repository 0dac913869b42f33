"""Similarity and scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trigrams(x: Column) -> Column:
    """Distinct runs of three characters; none of shorter texts."""
    return F.when(F.length(x) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets, 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; all 1 where all values agree."""
    return F.when(high - low < 1e-9, 1.0).otherwise((x - low) / (high - low))


def edge_similarity(keywords: Column, cosine: Column) -> Column:
    return 0.5 * (keywords + cosine)


def modulated(similarity: Column) -> Column:
    """Weight of an edge by the similarity of its target to the query."""
    return 0.25 + 0.75 * F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0))


def decay(distance: Column) -> Column:
    return F.pow(F.lit(0.5), distance)


def bm25_term(tf: Column, df: Column, n: Column, length: Column, mean: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """Contribution of a term to a document's BM25 score."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
