"""Inverted lists in blocks against scores of all pairs."""

import numpy as np
import pyarrow as pa

from lumbre.operators import graph, inverted, retrieval
from tests.test_operators import dense_pagerank


def test_blocks_rank_as_all_pairs(spark):
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["dosis", "pauta", "control", "carga", "viral", "embarazo", "riesgo", f"raro{i % 9}"], int(r.integers(0, 12)))) for i in range(400)]
    # equal texts tie, an id has two texts, a text is null
    docs = [(f"d{i:03d}", t) for i, t in enumerate(texts + texts[:200])] + [("d001", "embarazo de riesgo"), ("d002", texts[2] + " pauta"), ("d999", None)]
    q = spark.createDataFrame([(1, "riesgo en el embarazo"), (2, "pauta pauta control"), (3, "control de la pauta y la pauta"), (4, "nada"), (5, None), (6, "raro1 raro2")], "query_id int, text string")
    d = spark.createDataFrame(docs, "id string, text string")
    for terms in ({}, {"repeated": False}):
        want = {(x.query_id, x.id, x.score, x.rank) for x in retrieval.top(retrieval.bm25_scores(q, d, **terms), 9, 4).collect()}
        # repeated rows count once
        got = {(x.query_id, x.id, x.score, x.rank) for x in retrieval.bm25(q, d.unionByName(d).repartition(7), 9, **terms).collect()}
        assert got == want and len(want) == 36


def test_equal_scores_leave_only_the_first_ids():
    at, floor = inverted._best(np.array([0.0, 2.0, 1.0, 2.0, 2.0, 3.0] + [2.0] * 1000), 0.0, 3, 1e-4)
    assert sorted(at) == [1, 3, 4, 5] and floor == 2.0
    assert list(inverted._best(np.array([1.0, 1.99999, 2.5]), 2.0, 3, 1e-4)[0]) == [1, 2]


def test_ids_are_not_cut():
    t = pa.table({"id": ["a"] * 2 + ["b"] * 3, "t": pa.array([[1]] * 5, pa.list_(pa.int64()))})
    rows, inverted.ROWS = inverted.ROWS, 3
    try:
        assert inverted._cut(t) == 5
    finally:
        inverted.ROWS = rows


def test_mention_pagerank(spark, monkeypatch):
    r = np.random.default_rng(8)
    edges = sorted({(f"i{int(r.integers(40)):02d}", f"e{int(r.integers(9))}") for _ in range(110)})
    both = [x for i, e in edges for x in ((f"ent:{e}", f"chunk:{i}", 1.0), (f"chunk:{i}", f"ent:{e}", 1.0))]
    # one seed that no item names; two queries with equal seeds
    seeds = {1: {"e1": 1.0}, 2: {"e2": 2.0, "e5": 1.0, "none": 1.0}, 3: {"e1": 1.0}}
    # a table of all queries and nodes is made by pagerank only
    monkeypatch.setattr(graph, "pagerank", None)
    for steps in (6, 5, 1):
        got = graph.mention_pagerank(spark.createDataFrame(edges + edges[:5], "id string, entity string"), spark.createDataFrame([(q, e, w) for q, s in seeds.items() for e, w in s.items()], "query_id int, entity string, weight double"), 100, 0.5, steps, 9).collect()
        for q, s in seeds.items():
            want = {n[6:]: x for n, x in dense_pagerank(both, {f"ent:{e}": w for e, w in s.items()}, 0.5, steps).items() if n.startswith("chunk:") and x > 0}
            have = {x.id: x.score for x in got if x.query_id == q}
            assert have.keys() == want.keys() and max(abs(have[n] - x) for n, x in want.items()) < 1e-12


def test_hops_unite_the_rows_of_an_id(spark):
    words = [("a", ["x"]), ("a", ["x", "y"]), ("b", ["y"]), ("c", ["x", "z"]), ("d", None)]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")], "src string, dst string")
    asked = spark.createDataFrame([(1, ["x", "other"]), (2, ["x"]), (3, ["none"])], "query_id int, words array<string>")
    got = sorted(tuple(r) for r in graph.hop_traversal(edges, spark.createDataFrame(words, "id string, words array<string>"), asked).collect())
    # edges into a and c, all with agreement 0.5: b to a, c to a, b to c; then a has no way on, c leads to a again
    assert [r[1] for r in got if r[0] == 1] == ["a", "c"] and [r[1:] for r in got if r[0] == 1] == [r[1:] for r in got if r[0] == 2] and len(got) == 4
