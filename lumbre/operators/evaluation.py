"""Scoring of retrieval and answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def recall(hits: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Rows (query_id, k, recall, full_chain) of queries with gold; ``hits``: (query_id, item, rank), ``gold``: (query_id, item)."""
    want = gold.distinct()
    size = want.groupBy("query_id").agg(F.count("*").alias("n"))
    first = hits.groupBy("query_id", "item").agg(F.min("rank").alias("rank")).join(want, ["query_id", "item"], "left_semi")
    grid = size.select("query_id", "n", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    found = grid.join(first, "query_id", "left").groupBy("query_id", "k", "n").agg(F.count_if(F.col("rank") <= F.col("k")).alias("f"))
    return found.select("query_id", "k", (F.col("f") / F.col("n")).alias("recall"), (F.col("f") == F.col("n")).cast("double").alias("full_chain"))


def summary(scores: DataFrame, by: str, places: int = 4) -> DataFrame:
    """Means by k and group, and over all (group ``GLOBAL``), in one pass."""
    rolled = scores.cube("k", by).agg(F.grouping(by).alias("g"), F.grouping("k").alias("gk"), F.count("*").alias("n"), F.round(F.avg("recall"), places).alias("recall"), F.round(F.avg("full_chain"), places).alias("full_chain"))
    return rolled.where("gk = 0").select("k", F.when(F.col("g") == 1, "GLOBAL").otherwise(F.coalesce(F.col(by).cast("string"), F.lit("?"))).alias(by), "n", "recall", "full_chain")


def first_rank(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows (query_id, rank) of all queries with gold, null if nothing was found."""
    found = hits.join(gold.distinct(), ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return gold.select("query_id").distinct().join(found, "query_id", "left")


def failure(has_gold: Column, guide_rank: Column, section_rank: Column, late: int = 8) -> Column:
    """Why a query failed, by the first reason that applies."""
    return F.when(~has_gold, "sin_gold").when(guide_rank.isNull(), "guia_no_recuperada").when(section_rank.isNull(), "seccion_no_recuperada").when(section_rank > late, "orden_tardio").otherwise("ok")


def confusion(rows: DataFrame, truth: Column, guess: Column, by: str, places: int = 4) -> DataFrame:
    """TP, FP, FN, TN, precision, recall and F1 by group and over all; undefined ratios are 0."""
    marked = rows.select(F.col(by).alias("grp"), F.coalesce(truth, F.lit(False)).alias("t"), F.coalesce(guess, F.lit(False)).alias("p"))
    counted = marked.rollup("grp").agg(F.grouping("grp").alias("g"), F.count_if(F.expr("t and p")).alias("tp"), F.count_if(F.expr("not t and p")).alias("fp"), F.count_if(F.expr("t and not p")).alias("fn"), F.count_if(F.expr("not t and not p")).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    named = counted.select(F.when(F.col("g") == 1, "GLOBAL").otherwise(F.coalesce(F.col("grp").cast("string"), F.lit("?"))).alias(by), "tp", "fp", "fn", "tn")
    return named.select(by, "tp", "fp", "fn", "tn", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), places).alias("precision"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), places).alias("recall"), F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), places).alias("f1"))


def round_robin(rows: DataFrame, strata: str, key: str, n: int) -> DataFrame:
    """``n`` rows taken from the strata in turn, in order of key.

    No stratum gives more than ``n``: the limit on the rank lets Spark cut every partition before the shuffle.
    """
    placed = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(strata).orderBy(key))).where(F.col("__rn") <= n)
    return placed.orderBy("__rn", F.asc_nulls_first(strata)).limit(n).drop("__rn")


def bootstrap(scores: DataFrame, value: str, by: str, resamples: int = 2000, seed: int = 13) -> DataFrame:
    """Rows (group, n, mean, low, high): percentile interval of 95 % of the mean.

    Resampling needs only how often each distinct value occurs, so a group is counted before it is gathered: a
    resample of n values is a multinomial draw over the distinct ones.
    """
    counted = scores.where(F.col(value).isNotNull()).groupBy(F.col(by).cast("string").alias("grp"), F.round(value, 9).alias("v")).agg(F.count("*").alias("c"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("v")
        n, v = int(part["c"].sum()), part["v"].to_numpy()
        draws = np.random.default_rng(seed).multinomial(n, part["c"].to_numpy() / n, size=resamples) @ v / n
        low, high = np.percentile(draws, [2.5, 97.5])
        return pd.DataFrame({"grp": [part["grp"].iloc[0]], "n": [n], "mean": [float((part["c"] * v).sum() / n)], "low": [float(low)], "high": [float(high)]})

    return counted.groupBy("grp").applyInPandas(run, "grp string, n long, mean double, low double, high double")


def leaks(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys in both splits."""
    return train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi")
