"""Knowledge-graph construction and traversal over edge tables (src, dst, rel).

Traversals are unrolled joins over all start nodes at once; what was visited is kept out by anti joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from lumbre.functions import similarity as sim
from lumbre.operators import inverted
from lumbre.sources.store import materialize, parallelism

# Relations whose direction is turned for searching, and those that lead both ways, with their weight.
TURNED = ["HAS_INTERVENTION", "TARGET_POPULATION", "HAS_OUTCOME", "CONTIENE_RECOMENDACION"]
BOTH_WAYS = {"SINONIMO_DE": 1.0, "ANCLADA_A": 1.0, "IS_A": 0.5}


def mention_edges(chunks: DataFrame) -> DataFrame:
    """Edges between entities and the chunks that name them, both ways, and from chunks to their guide; ``chunks``: (id, guia, entities)."""
    named = chunks.select("id", F.explode(F.array_distinct("entities")).alias("e")).where("e is not null").select(F.concat(F.lit("ent:"), "e").alias("ent"), F.concat(F.lit("chunk:"), "id").alias("chunk"))
    there = named.select(F.col("ent").alias("src"), F.col("chunk").alias("dst"), F.lit("MENCIONADO_EN").alias("rel"))
    back = named.select(F.col("chunk").alias("src"), F.col("ent").alias("dst"), F.lit("CONTIENE_MENCION").alias("rel"))
    origin = chunks.where("guia is not null").select(F.concat(F.lit("chunk:"), "id").alias("src"), F.concat(F.lit("guia:"), "guia").alias("dst"), F.lit("EXTRAIDO_DE").alias("rel"))
    return there.unionByName(back).unionByName(origin).distinct()


def star_edges(members: DataFrame, rel: str = "SINONIMO_DE") -> DataFrame:
    """From the first node of each key to the others, instead of all pairs; ``members``: (key, node)."""
    first = members.groupBy("key").agg(F.min("node").alias("src"))
    return members.distinct().join(first, "key").where("node <> src").select("src", F.col("node").alias("dst"), F.lit(rel).alias("rel")).distinct()


def search_projection(edges: DataFrame) -> DataFrame:
    """Directed weighted graph (src, dst, weight, population) for ranking: reified roles turned round, synonyms, anchors and
    is-a links both ways; parallel edges collapse to one whose weight is that of the last relation in order of name."""
    both = F.create_map(*[F.lit(x) for kv in BOTH_WAYS.items() for x in kv])
    weight = F.coalesce(F.element_at(both, F.col("rel")), F.lit(1.0))
    turned = F.col("rel").isin(TURNED)
    ways = F.when(F.col("rel").isin(list(BOTH_WAYS)), F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).when(turned, F.array(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).otherwise(F.array(F.struct("src", "dst")))
    flat = edges.select(F.explode(ways).alias("w"), "rel", weight.alias("weight")).select("w.src", "w.dst", "rel", "weight")
    return flat.groupBy("src", "dst").agg(F.max_by("weight", "rel").alias("weight"), F.bool_or(F.col("rel") == "TARGET_POPULATION").alias("population"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def hub_subgraph(edges: DataFrame, k: int = 100) -> DataFrame:
    """Edges among the ``k`` nodes of highest degree (ties by name)."""
    hubs = degrees(edges).orderBy(F.desc("degree"), "node").limit(k).select("node")
    # k rows: small enough to broadcast whatever the graph
    a, b = F.broadcast(hubs.withColumnRenamed("node", "src")), F.broadcast(hubs.withColumnRenamed("node", "dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def ego(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """Rows (start, node, distance) of all nodes within ``hops`` undirected steps of each start node; ``start``: (node)."""
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    seen = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance")).distinct()
    front = seen
    for d in range(1, hops + 1):
        step = front.join(ways, front["node"] == ways["src"]).select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = step.withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def ancestors(links: DataFrame, start: DataFrame, hops: int = 2, hub: int | None = None) -> DataFrame:
    """Rows (node, ancestor, distance) within ``hops`` steps up links (child, parent); ``start``: (node).

    An ancestor with more than ``hub`` direct children is neither returned nor climbed past.
    """
    up = links.select("child", "parent").where("child is not null and parent is not null").distinct()
    if hub is not None:
        wide = up.groupBy("parent").agg(F.count("*").alias("n")).where(f"n > {hub}").select("parent")
        up = up.join(wide, "parent", "left_anti")
    front = start.select("node", F.col("node").alias("ancestor")).distinct()
    seen, out = front, None
    for d in range(1, hops + 1):
        step = front.join(up, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).distinct().join(seen, ["node", "ancestor"], "left_anti")
        out = step.withColumn("distance", F.lit(d)) if out is None else out.unionByName(step.withColumn("distance", F.lit(d)))
        seen, front = seen.unionByName(step), step
    return out


def descendants(links: DataFrame, start: DataFrame, hops: int = 4) -> DataFrame:
    """Rows (node, descendant, distance) within ``hops`` steps down."""
    turned = links.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return ancestors(turned, start, hops).withColumnRenamed("ancestor", "descendant")


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, iterations: int = 10, tolerance: float | None = None, modulation: DataFrame | None = None, every: int = 4) -> DataFrame:
    """Personalised PageRank of all queries at once: rows (query_id, node, score).

    ``edges``: (src, dst, weight); ``seeds``: (query_id, node, weight), normalised here; mass that reaches a node without
    outgoing edges returns to the seeds. ``modulation`` (query_id, node, factor) scales the edges into a node for a query.
    A fixed number of iterations, or with ``tolerance`` at most 80 until the sum of changes of every query is below it.
    """
    total = seeds.groupBy("query_id").agg(F.sum("weight").alias("all"))
    restart = materialize(seeds.groupBy("query_id", "node").agg(F.sum("weight").alias("w")).join(total, "query_id").where("`all` > 0").select("query_id", "node", (F.col("w") / F.col("all")).alias("v")))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    links = materialize(edges.join(out, "src").where("out > 0").select("src", "dst", "weight", "out"))
    if modulation is not None:
        scale = materialize(modulation.select("query_id", F.col("node").alias("dst"), "factor"))
        # what the scaled edges add to a node's outgoing weight: only nodes with such edges have a row
        extra = materialize(links.join(scale, "dst").groupBy("query_id", "src").agg(F.sum(F.col("weight") * (F.col("factor") - 1)).alias("extra")))
    now = restart.select("query_id", "node", F.col("v").alias("p"))
    for i in range(80 if tolerance is not None else iterations):
        flow = now.join(links, now["node"] == links["src"]).select("query_id", "src", "dst", "p", "weight", "out")
        if modulation is None:
            flow = flow.withColumn("share", F.col("weight") / F.col("out"))
        else:
            flow = flow.join(scale, ["query_id", "dst"], "left").join(extra, ["query_id", "src"], "left")
            left = F.col("out") + F.coalesce("extra", F.lit(0.0))
            flow = flow.withColumn("share", F.when(left > 1e-12, F.col("weight") * F.coalesce("factor", F.lit(1.0)) / left)).where("share is not null")
        moved = flow.groupBy("query_id", F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("share")).alias("m"))
        kept = moved.groupBy("query_id").agg(F.sum("m").alias("kept"))
        # all mass is 1, so what did not move sat on nodes without outgoing edges
        back = restart.join(kept, "query_id", "left").select("query_id", "node", (F.col("v") * (F.lit(1 - damping) + damping * (1 - F.coalesce("kept", F.lit(0.0))))).alias("m"))
        after = moved.select("query_id", "node", (F.col("m") * damping).alias("m")).unionByName(back).groupBy("query_id", "node").agg(F.sum("m").alias("p"))
        if tolerance is not None or (i + 1) % every == 0:
            after = materialize(after)
        if tolerance is not None:
            delta = after.select("query_id", "node", "p").unionByName(now.select("query_id", "node", (-F.col("p")).alias("p"))).groupBy("query_id", "node").agg(F.sum("p").alias("d")).groupBy("query_id").agg(F.sum(F.abs("d")).alias("d")).agg(F.max("d")).collect()[0][0]
            now = after
            if delta is None or delta < tolerance:
                break
        now = after
    return now.select("query_id", "node", F.col("p").alias("score"))


def mention_pagerank(named: DataFrame, seeds: DataFrame, k: int, damping: float = 0.5, iterations: int = 6, places: int = 7) -> DataFrame:
    """The ``k`` best items (query_id, id, score) by :func:`pagerank` over mentions both ways, all of weight 1, from entities as seeds.

    ``named``: (id, entity); ``seeds``: (query_id, entity, weight). Mass is on entities and on items in turn, so items are left out of
    the iteration: two steps lead from entity to entity, and scores are linear in the seeds, so they are made once for every
    seed entity and not for every query. The last step to the items is a ranking from inverted lists; equal seeds are ranked once.
    """
    items = materialize(named.where("id is not null and entity is not null").groupBy("id").agg(F.collect_set(F.xxhash64("entity")).alias("t")))
    blocked = inverted.blocks(items)
    degree = materialize(inverted.frequencies(blocked))
    over = items.select(F.explode("t").alias("a"), "t").select("a", (F.lit(1.0) / F.size("t")).alias("s"), F.explode("t").alias("z"))
    steps = materialize(over.groupBy("a", "z").agg(F.sum("s").alias("s")).join(degree, F.col("a") == F.col("h")).select(F.col("a").alias("at"), F.col("z").alias("to"), (F.col("s") / F.col("df")).alias("s")))
    own = seeds.where("weight > 0").groupBy("query_id", F.xxhash64("entity").alias("h")).agg(F.sum("weight").alias("w"))
    per = own.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("s"), F.sum("w").alias("all"))
    per = materialize(per.select("query_id", F.transform("s", lambda x: F.struct(x["h"].alias("h"), (x["w"] / F.col("all")).alias("v"))).alias("s")).withColumn("key", F.md5(F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["h"].cast("string"), x["v"].cast("string"))), ","))))
    sets = materialize(per.select("key", "s").dropDuplicates(["key"]).select("key", F.explode("s").alias("s")).select("key", "s.h", "s.v").join(degree.select("h", F.lit(True).alias("linked")), "h", "left"))
    # mass on seeds without mentions returns to the seeds: r_t is what all seeds get at step t
    lost = sets.groupBy("key").agg(F.sum(F.when(F.col("linked").isNull(), F.col("v")).otherwise(0.0)).alias("lost"))
    r = [F.lit(1.0)]
    for _ in range(iterations - 1):
        r.append(F.lit(1 - damping) + damping * F.col("lost") * r[-1])
    spread = sets.where("linked").select(F.col("h").alias("a")).distinct().select("a", F.col("a").alias("z"), F.lit(1.0).alias("x"))
    powers = None
    for j in range((iterations - 1) // 2 + 1):
        if j:
            spread = materialize(spread.join(steps, F.col("z") == F.col("at")).groupBy("a", F.col("to").alias("z")).agg(F.sum(F.col("x") * F.col("s")).alias("x")))
        part = spread.select(F.col("a").alias("h"), "z", "x", F.lit(j).alias("j"))
        powers = part if powers is None else powers.unionByName(part)
    share = F.element_at(F.array(*[damping ** (2 * j) * r[iterations - 1 - 2 * j] for j in range((iterations - 1) // 2 + 1)]), F.col("j") + 1)
    mass = sets.where("linked").join(lost, "key").join(powers, "h").groupBy("key", "z").agg(F.sum(F.col("v") * share * F.col("x")).alias("p"))
    asks = mass.join(degree, F.col("z") == F.col("h")).select(F.col("key").alias("query_id"), "h", (damping * F.col("p") / F.col("df")).alias("w"))
    found = inverted.best(blocked, asks, k, places, lambda tf, length: np.ones(len(tf)))
    return per.select("query_id", "key").join(found.withColumnRenamed("query_id", "key"), "key").select("query_id", "id", "score")


def explain_paths(edges: DataFrame, targets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows (query_id, seed, mid, target): undirected connections of one (mid null) or two steps from seeds to targets.

    ``targets``, ``seeds``: (query_id, node).
    """
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    near = seeds.join(ways, seeds["node"] == ways["src"]).select("query_id", F.col("src").alias("seed"), F.col("dst").alias("mid"))
    one = near.join(targets.withColumnRenamed("node", "mid"), ["query_id", "mid"]).select("query_id", "seed", F.lit(None).cast("string").alias("mid"), F.col("mid").alias("target"))
    last = targets.join(ways, targets["node"] == ways["dst"]).select("query_id", F.col("src").alias("mid"), F.col("dst").alias("target"))
    two = near.join(last, ["query_id", "mid"]).where("seed <> target").select("query_id", "seed", "mid", "target")
    return one.unionByName(two).distinct()


def succession_edges(named: DataFrame) -> DataFrame:
    """Edges (src, dst, entity) from each item to the next that names the same entity, in order of id; ``named``: (id, entity).

    Linear in the mentions, where linking all items of an entity would be quadratic. The mentions are ordered by range, so
    an entity that a third of them name is spread over many runs; a run hands over to the first item of the next.
    """
    rows = named.where("id is not null and entity is not null").select("entity", "id").distinct()
    runs = materialize(rows.repartitionByRange(parallelism(rows), "entity", "id").withColumn("run", F.spark_partition_id()))
    firsts = runs.groupBy("entity", "run").agg(F.min("id").alias("first"))
    handed = firsts.select("entity", "run", F.lead("first").over(Window.partitionBy("entity").orderBy("run")).alias("next"))
    inner = runs.select("entity", "run", "id", F.lead("id").over(Window.partitionBy("entity", "run").orderBy("id")).alias("after"))
    linked = inner.join(handed, ["entity", "run"]).select(F.col("id").alias("src"), F.coalesce("after", "next").alias("dst"), "entity")
    return linked.where("dst is not null")


def hop_traversal(edges: DataFrame, keywords: DataFrame, queries: DataFrame, k: int = 10, hops: int = 3, start: int = 15, least: float = 0.35) -> DataFrame:
    """Ranking (query_id, id, score, rank) by hopping along edges whose target's keywords agree with the query.

    ``edges``: (src, dst); ``keywords``: (id, words array), rows of an id are united; ``queries``: (query_id, words array). The ``start``
    best targets of each query are visited, then from every new node the best edge if its agreement is at least ``least``;
    helpfulness is half the agreement plus half the share of visits. Queries that share the same words with the keywords are
    ranked once; the agreement is computed for nodes that are reached, and for the first ones from inverted lists.
    """
    held = materialize(keywords.where("id is not null and words is not null").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")).where("size(words) > 0"))
    words = held.select("id", F.explode("words").alias("word"), F.size("words").alias("size"))
    shared = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    per = materialize(shared.groupBy("query_id").agg(F.sort_array(F.collect_set("word")).alias("words")).withColumn("key", F.md5(F.to_json("words"))))
    asked = materialize(per.select("key", "words").dropDuplicates(["key"]).select(F.col("key").alias("query_id"), F.explode("words").alias("word")))
    ways = materialize(edges.select("src", "dst").distinct())

    def agreement(pairs):
        return pairs.join(words, "id").join(asked, ["query_id", "word"]).groupBy("query_id", "id", "size").agg(F.count("*").alias("n")).select("query_id", "id", F.round(F.col("n") / F.col("size"), 6).alias("agreement"))

    # the first edges in order of agreement, dst and src lead to the first targets in that order
    entered = held.join(ways.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").select("id", inverted.hashed(F.col("words")).alias("t"))
    targets = inverted.best(inverted.blocks(entered.repartition("id")), asked.select("query_id", F.xxhash64("word").alias("h"), F.lit(1.0).alias("w")), start, 6, lambda tf, length: tf / length)
    ranked = targets.select("query_id", "id", F.round("score", 6).alias("agreement")).withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("agreement"), "id"))).where(f"rn <= {start}").drop("rn")
    reachable = ranked.join(ways, ranked["id"] == ways["dst"])
    first = reachable.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("agreement"), "dst", "src"))).where(f"rn <= {start}")
    visits = materialize(first.groupBy("query_id", F.col("dst").alias("id")).agg(F.count("*").alias("n")))
    front = visits.select("query_id", "id")
    for _ in range(hops):
        near = materialize(front.select("query_id", F.col("id").alias("at")).join(ways, F.col("at") == F.col("src")).select("query_id", "at", "dst"))
        step = near.join(agreement(near.select("query_id", F.col("dst").alias("id")).distinct()).withColumnRenamed("id", "dst"), ["query_id", "dst"]).where(f"agreement >= {least}")
        best = step.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "at").orderBy(F.desc("agreement"), "dst"))).where("rn = 1").groupBy("query_id", F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        best = materialize(best)
        front = best.select("query_id", "id").join(visits.select("query_id", "id"), ["query_id", "id"], "left_anti")
        visits = visits.unionByName(best).groupBy("query_id", "id").agg(F.sum("n").alias("n"))
    visits = materialize(visits)
    total = visits.groupBy("query_id").agg(F.sum("n").alias("total"))
    scored = visits.join(total, "query_id").join(agreement(visits.select("query_id", "id")), ["query_id", "id"], "left").select("query_id", "id", F.round(0.5 * (F.coalesce("agreement", F.lit(0.0)) + F.col("n") / F.col("total")), 4).alias("score"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id")))).where(f"rank <= {k}")
    return per.select("query_id", "key").join(best.withColumnRenamed("query_id", "key"), "key").select("query_id", "id", "score", "rank")


def recommendation_edges(recommendations: DataFrame, named: DataFrame, most: int = 12) -> DataFrame:
    """Edges from chunks to their recommendations and from entities to the recommendations that name them, the first ``most`` by name.

    ``recommendations``: (id, chunk_id, words array); ``named``: (entity). Matched by word, not by trying every entity on every text.
    """
    held = recommendations.select(F.concat(F.lit("chunk:"), "chunk_id").alias("src"), F.concat(F.lit("rec:"), "id").alias("dst"), F.lit("CONTIENE_RECOMENDACION").alias("rel"))
    hit = recommendations.select("id", F.explode(F.array_distinct("words")).alias("entity")).join(named.distinct(), "entity", "left_semi")
    first = hit.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("entity"))).where(f"rn <= {most}")
    return held.unionByName(first.select(F.concat(F.lit("ent:"), "entity").alias("src"), F.concat(F.lit("rec:"), "id").alias("dst"), F.lit("MENCIONADA_EN_REC").alias("rel"))).distinct()


def concept_edges(anchors: DataFrame, links: DataFrame) -> DataFrame:
    """Edges from entities to the concepts they are anchored to, and is-a links between concepts that are both there.

    ``anchors``: (entity, code); ``links``: (child, parent).
    """
    tied = anchors.where("entity is not null and code is not null").select(F.concat(F.lit("ent:"), "entity").alias("src"), F.concat(F.lit("sct:"), "code").alias("dst"), F.lit("ANCLADA_A").alias("rel")).distinct()
    present = anchors.where("code is not null").select("code").distinct()
    both = links.join(present.withColumnRenamed("code", "child"), "child", "left_semi").join(present.withColumnRenamed("code", "parent"), "parent", "left_semi")
    return tied.unionByName(both.select(F.concat(F.lit("sct:"), "child").alias("src"), F.concat(F.lit("sct:"), "parent").alias("dst"), F.lit("IS_A").alias("rel")).distinct())


def flat_edges(facts: DataFrame) -> DataFrame:
    """Entity-to-entity edges (src, dst, n) without the facts between: from each entity of a fact to the next, in the fact's order.

    ``facts``: (id, entities array).
    """
    pairs = facts.where("size(entities) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("entities") - 1), lambda i: F.struct(F.element_at("entities", i).alias("src"), F.element_at("entities", i + 1).alias("dst")))).alias("p"))
    return pairs.select("p.src", "p.dst").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
