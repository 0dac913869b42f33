"""Parent-child rows to full hierarchies: path, depth, root, descendants and loops.

The forest is cut into fragments of bounded size. In each fragment every node's chain of parents is contracted to the
point where it leaves the fragment (pointer doubling over numpy arrays). The places that chains enter form a smaller
quotient forest with weighted links, which is solved the same way, and its solution is expanded over the fragments.
A fragment is a range of codes at the first level (related codes tend to lie near each other); at later levels half of the nodes
move to their parent's fragment (random mate), so that the quotient shrinks whatever the shape of the tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumbre.sources.store import materialize

#: Nodes in a fragment; also the size below which one task solves the rest.
FRAGMENT = 150_000
BLANKS = "[\\s\\x{00a0}\\x{2000}-\\x{200b}\\x{202f}\\x{3000}\\x{feff}]+"

OPEN, ROOT, LOOP, TAIL = 0, 1, 2, 3

_STATE = "node string, frag int, ptr string, exit_ptr string, dist long, low string, kind int, root string, path array<string>"


def strip(column):
    """Without surrounding blanks; blank becomes null."""
    bare = F.regexp_replace(column, f"^{BLANKS}|{BLANKS}$", "")
    return F.when(bare != "", bare)


def nodes_of(links: DataFrame, child: str, parent: str) -> DataFrame:
    """One row (node, ptr) per code named in either column; of several parents the smallest counts."""
    rows = links.select(strip(F.col(child)).alias("node"), strip(F.col(parent)).alias("ptr")).where("node is not null")
    return rows.unionByName(rows.where("ptr is not null").select(F.col("ptr").alias("node"), F.lit(None).cast("string").alias("ptr"))).groupBy("node").agg(F.min("ptr").alias("ptr"))


def _contract(part: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """Follow each node's pointers inside the fragment; rows that are settled already stay as they are."""
    n = len(part)
    node = part["node"].to_numpy(dtype=object)
    ptr = part["ptr"].to_numpy(dtype=object)
    kind = part["kind"].to_numpy(dtype=np.int64).copy()
    root = part["root"].to_numpy(dtype=object).copy()
    where = pd.Index(node).get_indexer(pd.Series(ptr, dtype=object)).astype(np.int64)
    where[(kind != OPEN) | pd.isna(ptr)] = -1
    names, low = np.unique(np.asarray(part["low"], dtype=str), return_inverse=True)
    own = np.arange(n)
    inside = where >= 0
    jump = np.where(inside, where, own)
    weight = part["dist"].to_numpy(dtype=np.int64)
    far = np.where(inside, weight, 0)
    least = low.copy()
    rounds = max(1, int(np.ceil(np.log2(n + 1))) + 1)
    for _ in range(rounds):
        if not inside[jump].any():
            break
        # a pointer at the end of a chain points at itself with distance 0
        least = np.minimum(least, least[jump])
        far = far + far[jump]
        jump = jump[jump]
    last = jump
    looping = inside[last]
    out_kind, out_root = kind[last].copy(), root[last].copy()
    exit_ptr = ptr[last].copy()
    total = far + np.where(inside[last], 0, weight[last])
    if looping.any():
        on = np.zeros(n, dtype=bool)
        on[last[looping]] = True
        label = names[least[last[looping]]]
        out_root[looping] = label
        out_kind[looping] = np.where(on[looping], LOOP, TAIL)
        exit_ptr[looping] = None
    # what runs into a settled loop from here is a tail of it
    entered = ~looping & (last != own) & np.isin(kind[last], (LOOP, TAIL))
    out_kind[entered] = TAIL
    ends = ~looping & (out_kind == OPEN) & pd.isna(exit_ptr)
    out_kind[ends] = ROOT
    out_root[ends] = node[last[ends]]
    total = np.where(ends, far, total)
    lists: list | None = None
    if paths:
        segment = part["path"].to_list()
        lists = [None] * n
        for i in np.argsort(far, kind="stable"):
            if not looping[i]:
                own_part = [] if segment[i] is None else list(segment[i])
                lists[i] = own_part if last[i] == i else lists[where[i]] + own_part
    exit_ptr[np.isin(out_kind, (ROOT, LOOP, TAIL))] = None
    return pd.DataFrame({"node": node, "frag": part["frag"].to_numpy(), "ptr": ptr, "exit_ptr": exit_ptr, "dist": total, "low": names[least], "kind": out_kind, "root": out_root, "path": lists if paths else [None] * n})


def _mark(part: pd.DataFrame) -> pd.DataFrame:
    """Nodes on the way from the flagged nodes to the fragment's end; they are on the loop as well."""
    place = pd.Index(part["node"])
    where = place.get_indexer(part["ptr"])
    seen = np.zeros(len(part), dtype=bool)
    at = np.flatnonzero(part["flag"].to_numpy())
    while len(at):
        seen[at] = True
        at = where[at]
        at = np.unique(at[at >= 0])
        at = at[~seen[at]]
    return pd.DataFrame({"node": part["node"][seen]})


def _solve(level_nodes: DataFrame, level: int, paths: bool, fragment: int) -> DataFrame:
    """Rows (node, ptr, dist, low, kind, root, path) to (node, kind, root, dist, path) with no kind open."""
    count = level_nodes.count()
    fragments = -(-count // fragment)
    if fragments <= 1:
        placed = level_nodes.repartition(1).withColumn("frag", F.lit(0))
    elif level == 0:
        placed = level_nodes.repartitionByRange(fragments, "node").withColumn("frag", F.spark_partition_id())
    else:
        coin = lambda c: F.xxhash64(F.col(c), F.lit(level)) % 2 == 0
        hot = level_nodes.groupBy("ptr").count().where(f"count > {max(2, fragment // 20)} and ptr is not null").select("ptr", F.lit(True).alias("hot"))
        home = F.when(F.col("ptr").isNotNull() & coin("node") & ~coin("ptr") & F.col("hot").isNull(), F.col("ptr")).otherwise(F.col("node"))
        placed = level_nodes.join(hot, "ptr", "left").withColumn("frag", F.pmod(F.xxhash64(home, F.lit(7)), F.lit(fragments)).cast("int")).drop("hot").repartition(fragments, "frag")

    def local(parts):
        rows = [p for p in parts if len(p)]
        if rows:
            whole = pd.concat(rows, ignore_index=True)
            for _, part in whole.groupby("frag", sort=False):
                yield _contract(part.reset_index(drop=True), paths)

    columns = ["node", "ptr", "dist", "low", "kind", "root", "path", "frag"]
    states = materialize(placed.select(*columns).mapInPandas(local, _STATE))
    solved = states.where(f"kind <> {OPEN}").select("node", "kind", "root", "dist", "path")
    if fragments <= 1:
        return solved
    # hot targets: at most one row for each fragment, not one for each node
    targets = states.where(f"kind = {OPEN}").select("frag", "exit_ptr").distinct()
    entry = targets.select(F.col("exit_ptr").alias("node")).distinct()
    quotient = entry.join(states, "node").select("node", F.col("exit_ptr").alias("ptr"), "dist", "low", "kind", "root", "path")
    if quotient.isEmpty():
        return solved
    below = materialize(_solve(materialize(quotient), level + 1, paths, fragment))
    known = targets.join(below.select(F.col("node").alias("exit_ptr"), F.col("kind").alias("k2"), F.col("root").alias("r2"), F.col("dist").alias("d2"), F.col("path").alias("p2")), "exit_ptr")
    opened = states.where(f"kind = {OPEN}").join(known, ["frag", "exit_ptr"])
    grown = opened.select(
        "node",
        F.when(F.col("k2") == LOOP, TAIL).otherwise(F.col("k2")).alias("kind"),
        F.col("r2").alias("root"),
        (F.col("dist") + F.col("d2")).alias("dist"),
        (F.when(F.col("k2") == ROOT, F.concat("p2", "path")) if paths else F.lit(None).cast("array<string>")).alias("path"),
    )
    result = solved.unionByName(grown)
    flagged = below.where(f"kind = {LOOP}").select("node", F.lit(True).alias("flag"))
    if flagged.isEmpty():
        return result
    entries = states.join(flagged, "node").select("frag").distinct()
    around = states.join(entries, "frag", "left_semi").join(flagged, "node", "left").select("frag", "node", F.when(F.col("kind") == OPEN, F.col("ptr")).alias("ptr"), F.coalesce("flag", F.lit(False)).alias("flag"))
    on = around.groupBy("frag").applyInPandas(_mark, "node string").select("node", F.lit(True).alias("on"))
    return result.join(on, "node", "left").select("node", F.when(F.col("on"), LOOP).otherwise(F.col("kind")).alias("kind"), "root", "dist", "path")


def resolve(links: DataFrame, child: str = "hijo", parent: str = "padre", paths: bool = False, fragment: int = FRAGMENT) -> DataFrame:
    """One row (node, root, depth, path) per code.

    depth is the number of steps to the root; -1 for a code on a loop (root is then the smallest code on it) and -2 for
    a code whose ancestors lead into a loop. path runs from the root to the node (null on loops, or without ``paths``).
    Null and blank children are ignored, a null or blank parent means none, repeated links count once, further columns
    are ignored, an empty table gives an empty result.
    """
    nodes = nodes_of(links, child, parent)
    start = nodes.select("node", "ptr", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("node").alias("low"), F.lit(OPEN).alias("kind"), F.lit(None).cast("string").alias("root"), (F.array("node") if paths else F.lit(None).cast("array<string>")).alias("path"))
    solved = _solve(materialize(start), 0, paths, fragment)
    depth = F.when(F.col("kind") == LOOP, -1).when(F.col("kind") == TAIL, -2).otherwise(F.col("dist")).cast("long")
    return solved.select("node", "root", depth.alias("depth"), F.when(F.col("kind") == ROOT, F.col("path")).alias("path"))


def closure(resolved: DataFrame) -> DataFrame:
    """Rows (ancestor, node, distance), distance 0 for the node itself, from a result of :func:`resolve` with paths.

    Codes on loops or behind them have no path and give no rows here, but in :func:`closure_of`. The size is the sum of all
    depths, as the closure demands.
    """
    return resolved.where("path is not null").select("node", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor")).select("ancestor", "node", (F.col("n") - 1 - F.col("at")).cast("long").alias("distance"))


def closure_of(links: DataFrame, child: str = "hijo", parent: str = "padre", fragment: int = FRAGMENT) -> DataFrame:
    """Rows (ancestor, node, distance) of all codes, distance 0 for the node itself, also of those on and behind loops.

    All codes on a loop are each other's ancestors and descendants, and whatever hangs below one of them is a descendant of all;
    the distance is the number of steps up until the ancestor is met for the first time. Each loop is cut above its smallest
    code, which makes a tree of what hangs there; the part of the loop that lies beyond the cut is added to its paths.
    """
    whole = materialize(resolve(links, child, parent, True, fragment))
    tied = whole.where("depth < 0").select("node", "root", "depth")
    kept = nodes_of(links, child, parent).join(tied, "node").select("node", F.when(F.col("node") != F.col("root"), F.col("ptr")).alias("ptr"))
    cut = materialize(closure(resolve(kept, "node", "ptr", True, fragment)))
    # place of a code of a loop below the cut, and how many there are
    on = cut.join(tied.where("depth = -1 and node <> root"), "node").where("ancestor = root").select("node", "root", F.col("distance").alias("place"))
    on = materialize(on.unionByName(tied.where("depth = -1 and node = root").select("node", "root", F.lit(0).cast("long").alias("place"))))
    size = on.groupBy("root").agg(F.count("*").alias("size"))
    # the last code of the loop on each path: the others of the loop lie beyond the cut
    entry = cut.join(on.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("node", "root").agg(F.max("place").alias("last"), F.max("distance").alias("up"))
    rest = entry.join(size, "root").join(on.select(F.col("node").alias("ancestor"), "root", "place"), "root").where("place > last")
    return closure(whole).unionByName(cut).unionByName(rest.select("ancestor", "node", (F.col("up") + F.col("size") - F.col("place")).alias("distance")))


def descendants(resolved: DataFrame) -> DataFrame:
    """Rows (node, descendants, height): how many codes lie below each and how far down the lowest is."""
    return closure(resolved).groupBy(F.col("ancestor").alias("node")).agg((F.count("*") - 1).alias("descendants"), F.max("distance").alias("height"))
