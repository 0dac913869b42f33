"""Bounded samples whose gathering is bounded as well, however many partitions the data have."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int = 1) -> DataFrame:
    """At most ``most`` rows, those first by a hash of the key: all rows if there are no more.

    A share of the hash range that holds about one and a half times as many is cut out first, so no partition offers the
    final ordering ``most`` rows of its own.
    """
    share = 1.5 * most / max(1, rows.count())
    h = F.xxhash64(key, F.lit(seed))
    near = rows if share >= 1 else rows.where(F.pmod(h, F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
    return near.orderBy(F.pmod(h, F.lit(1 << 32)), key).limit(most)


def most_frequent(counted: DataFrame, count: str, most: int, form: str) -> DataFrame:
    """The ``most`` rows with the largest counts, equal ones by a hash of ``form``.

    The least class of counts that is taken whole is found first; only what is missing is ordered, out of the next class.
    """
    step = F.floor(F.log2(count) * 8)
    classes = sorted(((r.c, r.k) for r in counted.groupBy(step.alias("c")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, whole, rest = 0, [], None
    for c, k in classes:
        if total + k > most:
            rest = c
            break
        total += k
        whole.append(c)
    taken = counted.where(step >= whole[-1]) if whole else counted.where(F.lit(False))
    if rest is None or total == most:
        return taken
    return taken.unionByName(counted.where(step == rest).orderBy(F.desc(count), F.xxhash64(form), form).limit(most - total))
