"""Sources mixed to target shares, by budgets in a tree of domains, languages and sources.

The budget of tokens goes down from the root by weight. A leaf can give its tokens at most as often as its source may be
repeated; what it cannot give is redistributed among its siblings first, then, if they are exhausted, among the siblings of
its parent, and so on. Each leaf then takes whole epochs of its documents and a prefix, by tokens, of a last, seeded one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumbre.llm import tokens
from lumbre.llm.pairs import language

#: Bits of the order's buckets: a leaf's prefix is found by bucket, only the last one is sorted.
BUCKETS = 4096


def fill(weights: list[float], capacities: list[float], budget: float) -> list[float]:
    """Shares of a budget by weight, none above its capacity; what one cannot take goes to the others by weight."""
    given = [0.0] * len(weights)
    left, open_ = min(budget, sum(capacities)), [i for i in range(len(weights)) if capacities[i] > 0]
    while left > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        ask = {i: left * (weights[i] / total if total > 0 else 1 / len(open_)) for i in open_}
        full = [i for i in open_ if given[i] + ask[i] >= capacities[i] - 1e-9]
        if not full:
            for i in open_:
                given[i] += ask[i]
            break
        for i in full:
            left -= capacities[i] - given[i]
            given[i] = capacities[i]
        open_ = [i for i in open_ if i not in full]
    return given


def budgets(leaves: list[tuple[tuple, float, float]], budget: float) -> dict[tuple, float]:
    """Budget of each leaf (path, weight, capacity)."""
    if len(leaves) == 1 and len(leaves[0][0]) == 0:
        return {(): min(budget, leaves[0][2])}
    children: dict = {}
    for path, w, c in leaves:
        children.setdefault(path[0], []).append((path[1:], w, c))
    names = sorted(children)
    shares = fill([sum(w for _, w, _ in children[k]) for k in names], [sum(c for *_, c in children[k]) for k in names], budget)
    out = {}
    for k, b in zip(names, shares):
        for path, v in budgets(children[k], b).items():
            out[(k, *path)] = v
    return out


def _language(text: str, told: str | None) -> str:
    """Language by the text itself; by the label only where the text says too little."""
    found, share, n = language(text)
    if found and share > 0.4 and n >= 2:
        return found
    low = (told or "").strip().lower()[:2]
    return {"es": "es", "sp": "es", "en": "en"}.get(low, found or "otro")


def measured(documents: DataFrame, path: str = tokens.PATH) -> DataFrame:
    """Rows (doc_id, source, lang, tokens) of distinct documents: source trimmed and in lower case, language told from the text."""
    rows = documents.select("doc_id", "text", "lang", F.lower(F.trim("source")).alias("source")).where("doc_id is not null and text is not null")

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "lang": [_language(t, l) for t, l in zip(batch["text"], batch["lang"])], "tokens": tokens.counts(batch["text"], path)})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, source string, lang string, tokens long").dropDuplicates(["doc_id"])


def mix(items: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 1, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Selection (doc_id, source, lang, tokens, copies) and report (source, target_share, available, tokens, share, copies_most).

    ``items``: doc_id, source, lang, tokens; ``weights``: source, target_share, max_repeats and, if named, a column of domains.
    ``total`` is the number of tokens wanted, by default all that the weighted sources have once. Documents whose source is
    null or not weighted are not selected and reported under ``(otras)`` with target 0. Sources without documents reach 0.
    """
    spark = items.sparkSession
    listed = weights.where("source is not null").select(F.lower(F.trim("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r"), (F.col(domain) if domain else F.lit("todo")).alias("d")).dropDuplicates(["source"]).collect()
    known = {x.source: x for x in listed}
    # one row for each source and language: as many as the weights list, times the languages
    supply = items.groupBy("source", "lang").agg(F.sum("tokens").alias("t")).where(F.col("source").isin(list(known)) & (F.col("t") > 0)).collect()
    per: dict[str, int] = {}
    for x in supply:
        per[x.source] = per.get(x.source, 0) + x.t
    leaves = [((known[x.source].d, x.lang, x.source), known[x.source].w * x.t / per[x.source], x.t * max(0, known[x.source].r)) for x in supply]
    wanted = float(total if total is not None else sum(per.values()))
    plan = budgets(leaves, wanted) if leaves else {}
    stock = {(x.source, x.lang): x.t for x in supply}
    rows = [(s, l, int(b // stock[s, l]), int(round(b - (b // stock[s, l]) * stock[s, l]))) for (_, l, s), b in plan.items()]
    cut = spark.createDataFrame(rows, "source string, lang string, whole int, rest long")
    here = items.join(F.broadcast(cut), ["source", "lang"])
    order = F.xxhash64("doc_id", F.lit(seed), "whole")
    placed = here.withColumn("h", order).withColumn("bucket", F.shiftright("h", 52))
    # cumulative tokens over at most 4096 buckets of a leaf
    from pyspark.sql import Window

    heap = placed.groupBy("source", "lang", "bucket").agg(F.sum("tokens").alias("t"))
    before = heap.select("source", "lang", "bucket", (F.sum("t").over(Window.partitionBy("source", "lang").orderBy("bucket")) - F.col("t")).alias("before"), "t")
    joined = placed.join(before, ["source", "lang", "bucket"])
    inside = joined.where("before + t <= rest").select("doc_id", "source", "lang", "tokens", "whole", F.lit(1).alias("extra"))
    beyond = joined.where("before >= rest and before + t > rest").select("doc_id", "source", "lang", "tokens", "whole", F.lit(0).alias("extra"))
    edge = joined.where("before < rest and before + t > rest")
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "lang", "bucket").orderBy("h", "doc_id"))
    border = edge.select("doc_id", "source", "lang", "tokens", "whole", F.when(run <= F.col("rest"), 1).otherwise(0).alias("extra"))
    chosen = inside.unionByName(beyond).unionByName(border).select("doc_id", "source", "lang", "tokens", (F.col("whole") + F.col("extra")).alias("copies")).where("copies > 0")
    targets = spark.createDataFrame([(x.source, float(x.w)) for x in listed], "source string, target_share double")
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("copies_most"))
    available = items.groupBy(F.when(F.col("source").isin(list(known)), F.col("source")).otherwise(F.lit("(otras)")).alias("source")).agg(F.sum("tokens").alias("available"))
    table = available.join(targets, "source", "full").join(reached, "source", "left")
    whole = table.agg(F.sum("tokens").alias("all"))
    report = table.crossJoin(whole).select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.round(F.try_divide("tokens", "all"), 6), F.lit(0.0)).alias("share"), F.coalesce("copies_most", F.lit(0)).alias("copies_most"))
    return chosen, report
