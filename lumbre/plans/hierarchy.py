"""Queries over parent-child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumbre.operators import forest
from lumbre.sources.store import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.resolve(table(spark, d, "jerarquia").select("hijo", "padre")).select(F.col("node").alias("nodo"), F.col("root").alias("raiz"), F.col("depth").alias("profundidad"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return forest.resolve(table(spark, d, "jerarquia").select("hijo", "padre"), paths=True).select(F.col("node").alias("nodo"), F.concat_ws("/", "path").alias("camino"), F.col("depth").alias("profundidad")).where("profundidad >= 0")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    below = forest.descendants(forest.resolve(table(spark, d, "jerarquia").select("hijo", "padre"), paths=True))
    return below.select(F.col("node").alias("nodo"), F.col("descendants").alias("descendientes"), F.col("height").alias("altura"))


def p3_closure(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every concept, those on and behind loops included; a concept is its own at distance 0."""
    below = forest.closure_of(table(spark, d, "jerarquia").select("hijo", "padre"))
    return below.select(F.col("ancestor").alias("nodo"), F.col("node").alias("descendiente"), F.col("distance").alias("distancia"))


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_closure": p3_closure}

_NODES = r"""
links as (select distinct regexp_replace(hijo, '^\s+|\s+$', '', 'g') as h, nullif(regexp_replace(coalesce(padre, ''), '^\s+|\s+$', '', 'g'), '') as p from jerarquia
          where hijo is not null and regexp_replace(hijo, '^\s+|\s+$', '', 'g') <> ''),
n as (select h as node, min(p) as parent from (select h, p from links union all select p, null from links where p is not null) group by h),
"""
_UP = f"""with recursive {_NODES}
up(node, top, depth, path) as (
  select node, node, 0, [node] from n
  union all
  select up.node, n.parent, up.depth + 1, list_append(up.path, n.parent) from up join n on n.node = up.top
  where n.parent is not null and not list_contains(up.path, n.parent)),
"""
SQL = {
    "p3_found": _UP
    + """
ends as (select up.node, up.top, up.depth, up.path, n.parent from up join n on n.node = up.top where n.parent is null or list_contains(up.path, n.parent))
select node as nodo,
  case when parent is null then top else list_min(path[list_position(path, parent):]) end as raiz,
  cast(case when parent is null then depth when parent = node then -1 else -2 end as bigint) as profundidad
from ends""",
    "p3_paths": _UP
    + """
ends as (select up.node, up.depth, up.path from up join n on n.node = up.top where n.parent is null)
select node as nodo, array_to_string(list_reverse(path), '/') as camino, cast(depth as bigint) as profundidad from ends""",
    "p3_descendants": _UP
    + """
good as (select up.node from up join n on n.node = up.top where n.parent is null)
select top as nodo, count(*) - 1 as descendientes, cast(max(depth) as bigint) as altura from up semi join good on good.node = up.node group by top""",
}
