"""Linking texts to a terminology: exact and trigram matching, anchoring decisions, curation.

``terms``: (term_norm, cui, sab, ...); values are folded before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lumbre.functions import similarity as sim


def exact(values: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (value, cui, score) of values (value, norm) that are terms."""
    return values.join(terms.select(F.col("term_norm").alias("norm"), "cui").distinct(), "norm").select("value", "cui", F.lit(1.0).alias("score")).distinct()


def fuzzy(values: DataFrame, terms: DataFrame, least: float = 0.55, places: int = 3) -> DataFrame:
    """Rows (value, cui, score): best trigram Dice per concept of at least ``least``; values: (value, norm).

    Exact without comparing all pairs: two sets of that Dice share a trigram among the rarest of each (prefix filter);
    trigrams are ordered by how many terms have them. The pairs so found are then measured in full.
    """
    entries = terms.select("term_norm", "cui").where("term_norm is not null and cui is not null").distinct()
    t_sets = entries.select("term_norm").distinct().select("term_norm", sim.trigrams(F.col("term_norm")).alias("tg"))
    v_sets = values.select("norm").where("norm is not null").distinct().select("norm", sim.trigrams(F.col("norm")).alias("vg"))
    rare = t_sets.select(F.explode("tg").alias("g")).groupBy("g").agg(F.count("*").alias("df"))

    def prefix(sets: DataFrame, key: str, grams: str) -> DataFrame:
        one = sets.select(key, F.size(grams).alias("n"), F.explode(grams).alias("g")).join(rare, "g", "left")
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "g"))
        # the smallest partner in size that can still reach the threshold fixes the overlap needed at least
        need = F.ceil(least / (2 - least) * F.col("n") - 1e-9)
        return one.withColumn("place", place).where(F.col("place") <= F.col("n") - need + 1).where("df is not null").select(key, "g")

    pairs = prefix(v_sets, "norm", "vg").join(prefix(t_sets, "term_norm", "tg"), "g").select("norm", "term_norm").distinct()
    measured = pairs.join(v_sets, "norm").join(t_sets, "term_norm").select("norm", "term_norm", sim.dice(F.col("vg"), F.col("tg")).alias("s")).where(f"s >= {least}")
    best = measured.join(entries, "term_norm").groupBy("norm", "cui").agg(F.round(F.max("s"), places).alias("score"))
    return values.join(best, "norm").select("value", "cui", "score")


def anchor(candidates: DataFrame, least: float = 0.85, groups: DataFrame | None = None) -> DataFrame:
    """One row (value, cui, score) per value with a clear candidate: the best of at least ``least``.

    Several exact candidates whose semantic groups differ (``groups``: cui, grupo) mean no decision; without groups, several
    exact concepts do.
    """
    exacts = candidates.where("score >= 0.999")
    if groups is not None:
        sets = groups.groupBy("cui").agg(F.array_sort(F.collect_set("grupo")).alias("gs"))
        exacts = exacts.join(sets, "cui", "left").select("value", F.coalesce(F.col("gs").cast("string"), F.lit("[]")).alias("what"))
    else:
        exacts = exacts.select("value", F.col("cui").alias("what"))
    doubtful = exacts.groupBy("value").agg(F.count_distinct("what").alias("n")).where("n > 1").select("value")
    order = Window.partitionBy("value").orderBy(F.desc("score"), "cui")
    return candidates.where(f"score >= {least}").withColumn("rn", F.row_number().over(order)).where("rn = 1").join(doubtful, "value", "left_anti").select("value", "cui", "score")


def best_code(terms: DataFrame, parents: DataFrame) -> DataFrame:
    """One row (cui, sctid, term) per concept: a code in the hierarchy first, then the Spanish source, then preferred names."""
    known = parents.select(F.col("child").alias("sctid")).distinct().withColumn("in_tree", F.lit(1))
    order = Window.partitionBy("cui").orderBy(F.desc(F.coalesce("in_tree", F.lit(0))), F.when(F.col("sab") == "SCTSPA", 0).when(F.col("sab") == "MSHSPA", 1).otherwise(2), F.desc("ispref"), "term", "sctid")
    return terms.where("sctid is not null and cui is not null").join(known, "sctid", "left").withColumn("rn", F.row_number().over(order)).where("rn = 1").select("cui", "sctid", "term")


def class_members(links: DataFrame, classes: DataFrame, mentions: DataFrame, hops: int = 4) -> DataFrame:
    """Rows (node, member, items): every member of a class within ``hops`` steps with the number of items that mention it, 0 included.

    ``links``: (child, parent); ``classes``: (node); ``mentions``: (member, item).
    """
    from lumbre.operators.graph import descendants

    below = descendants(links, classes, hops).select("node", F.col("descendant").alias("member"))
    counted = mentions.groupBy("member").agg(F.count_distinct("item").alias("items"))
    return below.join(counted, "member", "left").select("node", "member", F.coalesce("items", F.lit(0)).alias("items"))


def consolidate(entities: DataFrame) -> DataFrame:
    """Dictionary (name, kind, aliases, n) from occurrences (pos, name, kind, alias): first kind wins, aliases without the name itself."""
    found = entities.where("name is not null").groupBy("name").agg(F.min_by("kind", "pos").alias("kind"), F.array_sort(F.collect_set("alias")).alias("all"), F.count("*").alias("n"))
    return found.select("name", "kind", F.filter("all", lambda a: a != F.col("name")).alias("aliases"), "n")


def merge_synonyms(dictionary: DataFrame, merges: DataFrame) -> DataFrame:
    """Dictionary (name, aliases) after curation: names in ``merges`` (name, target) go into their target, their aliases and the old name with them."""
    moved = dictionary.join(merges, "name", "left").select(F.coalesce("target", "name").alias("to"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("target").isNotNull() & (F.col("target") != F.col("name")), F.array("name")).otherwise(F.array().cast("array<string>"))).alias("aliases"))
    joined = moved.groupBy("to").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("all"))
    return joined.select(F.col("to").alias("name"), F.filter("all", lambda a: a != F.col("to")).alias("aliases"))


def latest(log: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Replay of an append-only log: the last entry of every key, entries without a time before all others; repeated entries count once.

    A maximum over rows, combined before the shuffle, so a popular key is no single task.
    """
    rest = [c for c in log.columns if c not in (key, time, tie)]
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(time, tie, *rest)).alias("__last"))
    return last.select(*[F.col(c) if c == key else F.col(f"__last.{c}").alias(c) for c in log.columns])
