"""Curation of entities and their anchors: forms of names, what is still open, candidates by slot, a judge's choice, and
mass anchoring of names by their variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumbre.functions import text as tx


def squeezed(x: Column) -> Column:
    """Identity of an entity's name: lower case, runs of blanks as one, none around; null stays null."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def bare(x: Column) -> Column:
    """The name without remarks in brackets, other signs as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\([^()]*\)", " "), r"[^\p{L}\p{N}]+", " "))


def word_overlap(name: Column, words: Column) -> Column:
    """Share of a name's words that are among ``words``; 0 for a name without words."""
    own = F.filter(F.split(name, " "), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.filter(own, lambda w: F.array_contains(words, w))), F.size(own)), F.lit(0.0))


def first_context(items: DataFrame, item: str, entities: str, text: str) -> DataFrame:
    """Rows (entity, item, text): the first item, by its id, that names an entity; an array of null or nothing names none.

    A maximum per entity, combined before the shuffle: no entity's items are gathered.
    """
    named = items.select(F.col(item).alias("item"), F.col(text).alias("text"), F.explode(F.array_distinct(entities)).alias("entity")).where("entity is not null and item is not null")
    return named.groupBy("entity").agg(F.min(F.struct("item", "text")).alias("f")).select("entity", "f.item", "f.text")


def in_slot(candidates: DataFrame, groups: str, admissible: list[str]) -> DataFrame:
    """Candidates whose semantic groups meet the admissible ones of a slot; null groups meet none."""
    return candidates.where(F.coalesce(F.arrays_overlap(F.col(groups), F.array(*map(F.lit, admissible))), F.lit(False)))


def judged(candidates: DataFrame, decision: str, score: str, key: str, least: float) -> DataFrame:
    """The best candidate of each decision if its score reaches ``least``; ties go to the smallest key, null scores lose."""
    best = candidates.where(F.col(decision).isNotNull()).groupBy(decision).agg(F.max(F.struct(F.coalesce(F.col(score), F.lit(-1.0)).alias("s"), (-F.col(key)).alias("k"))).alias("b"))
    return best.select(decision, F.when(F.col("b.s") >= least, -F.col("b.k")).alias(key), F.when(F.col("b.s") >= least, F.col("b.s")).alias(score))


def anchor_by_variants(names: DataFrame, key: str, name: str, terms: DataFrame, term: str, code: str) -> DataFrame:
    """Rows (key, variant, code): the code of the first variant of a name that the reference list has exactly.

    Variants in order: the folded name, the same without brackets, and what stands in the brackets. Of several codes of a term
    the smallest counts. Names without a hit have no row.
    """
    folded = tx.fold(F.trim(name))
    inside = F.regexp_extract(folded, r"\(([^()]+)\)", 1)
    variants = F.array(folded, bare(folded), F.trim(inside))
    asked = names.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(key, F.posexplode(variants).alias("variant", "t")).where("t <> ''").distinct()
    known = terms.where(F.col(term).isNotNull() & F.col(code).isNotNull()).groupBy(F.col(term).alias("t")).agg(F.min(code).alias("code"))
    return asked.join(known, "t").groupBy(key).agg(F.min(F.struct("variant", "code")).alias("b")).select(key, F.col("b.variant").cast("int").alias("variant"), "b.code")


def remapped(rows: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """Rows (key, canonical): positional ids to group::position, by order within the group; rows without a group keep their id."""
    placed = rows.where(F.col(key).isNotNull()).select(key, group, order).distinct()
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, key))
    return placed.select(key, F.when(F.col(group).isNull(), F.col(key)).otherwise(F.concat_ws("::", group, place.cast("string"))).alias("canonical"))
