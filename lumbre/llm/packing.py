"""Items of varying length into containers of fixed capacity.

Items are spread at random over groups of bounded size; each group is packed by best fit, longest item first. Bins are
kept in order of their residual, with bitmaps of the sources and duplicate clusters they hold: the search for the
tightest bin that is large enough goes on to the next one until a compatible bin is found.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumbre.llm import tokens
from lumbre.sources.store import materialize

#: Items that one task packs, about.
GROUP = 20_000


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, slack: int | None = None) -> list[int]:
    """Bin of every item; sizes must not exceed the capacity.

    Two items of a duplicate cluster never share a bin. A bin without the item's source is preferred among those at most
    ``slack`` tokens looser than the tightest compatible one (none by default: capacity / 64), so sources mix at little cost.
    """
    slack = capacity // 64 if slack is None else slack
    # only what occurs twice can conflict
    bits: dict = {}
    for c in clusters:
        if c is not None:
            bits[c] = bits.get(c, 0) + 1
    marks = {c: 1 << i for i, c in enumerate(x for x, n in bits.items() if n > 1)}
    names = {s: 1 << i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    held: list[int] = []
    mixed: list[int] = []
    where: dict[int, list[int]] = {}
    free = 0  # bit r is set when a bin has residual r
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        n, mark, name = sizes[i], marks.get(clusters[i], 0), names.get(sources[i], 0)
        chosen, tight, rest = None, None, free >> n << n
        while rest:
            low = rest & -rest
            r = low.bit_length() - 1
            if tight is not None and r > tight[0] + slack:
                break
            for b in reversed(where[r]):
                if not held[b] & mark:
                    if not mixed[b] & name:
                        chosen = (r, b)
                        break
                    if tight is None:
                        tight = (r, b)
            if chosen:
                break
            rest ^= low
        chosen = chosen or tight
        if chosen is None:
            b, r = len(held), capacity
            held.append(0)
            mixed.append(0)
        else:
            r, b = chosen
            where[r].remove(b)
            if not where[r]:
                free ^= 1 << r
        held[b] |= mark
        mixed[b] |= name
        out[i] = b
        where.setdefault(r - n, []).append(b)
        free |= 1 << (r - n)
    return out


def sized(documents: DataFrame, key: str, text: str, path: str = tokens.PATH, carry: list[str] = ()) -> DataFrame:
    """Rows (key, tokens, carried columns) of every distinct key with a text."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), *carry).where("key is not null and text is not null")
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            out = batch.drop(columns=["text"])
            out["tokens"] = tokens.counts(batch["text"], path)
            yield out

    counted = rows.mapInPandas(run, f"key {kinds['key']}, " + "".join(f"`{c}` {kinds[c]}, " for c in carry) + "tokens long")
    return counted.dropDuplicates(["key"])


def pack(items: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Rows (container, key, part, first, tokens) from items (key, tokens, source, cluster).

    An item longer than the capacity is split into full containers and a rest (parts 1, 2, ...; ``first`` is its first token),
    which is packed like any other; no other item is split. Items without tokens take no room and have a null container.
    Null sources and clusters conflict with nothing. Repeated keys must be removed before.
    """
    kind = dict(items.dtypes)["key"]
    whole = items.where("tokens > 0").select("key", "tokens", "source", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("tokens") / capacity) - 1)).alias("p"))
    parts = whole.select("key", (F.col("p") + 1).cast("int").alias("part"), (F.col("p") * capacity).alias("first"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("p") * capacity).alias("n"), "source", "cluster")
    full = parts.where(f"n = {capacity}").select(F.concat_ws("-", F.lit("f"), F.col("key").cast("string"), "part").alias("container"), "key", "part", "first", F.col("n").alias("tokens"))
    rest = materialize(parts.where(f"n < {capacity}"))
    groups = max(1, round(rest.count() / group))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable")
        none = lambda s: [None if pd.isna(x) else x for x in s]
        bins = best_fit(part["n"].astype(int).tolist(), none(part["source"]), none(part["cluster"]), capacity)
        g = int(part["g"].iloc[0])
        return pd.DataFrame({"container": [f"g{g}-{b}" for b in bins], "key": part["key"], "part": part["part"], "first": part["first"], "tokens": part["n"]})

    packed = rest.withColumn("g", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(groups)).cast("int")).groupBy("g").applyInPandas(run, f"container string, key {kind}, part int, first long, tokens long")
    empty = items.where("tokens = 0").select(F.lit(None).cast("string").alias("container"), "key", F.lit(1).alias("part"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("tokens"))
    return full.unionByName(packed).unionByName(empty)


def report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row (containers, items, tokens, least, fill): ``least`` containers would do for the tokens, ``fill`` is the share used."""
    used = packed.where("container is not null").groupBy("container").agg(F.count("*").alias("i"), F.sum("tokens").alias("t"))
    total = used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("i"), F.lit(0)).alias("items"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return total.select("containers", "items", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.round(F.try_divide("tokens", F.col("containers") * capacity), 4).alias("fill"))
