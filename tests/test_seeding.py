"""Layered seeds, question edges and providers against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.functions import providers, text as tx
from lumbre.operators import retrieval, seeding
from lumbre.plans import search
from tests.test_operators import dense_pagerank


def unit(r, n, d=6):
    v = r.standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_fact_seeds(spark):
    r = np.random.default_rng(2)
    q, f = unit(r, 3), unit(r, 30)
    ents = [[f"e{i % 5}", f"e{i % 7}"] for i in range(30)]
    freq = {f"e{i}": i + 1 for i in range(7)}
    got = seeding.fact_seeds(spark.createDataFrame([(i, q[i].tolist()) for i in range(3)], "query_id int, v array<double>"), spark.createDataFrame([(f"f{i:02d}", f[i].tolist(), ents[i]) for i in range(30)], "id string, v array<double>, entities array<string>"), spark.createDataFrame(list(freq.items()), "node string, n int"), 6, 3).collect()
    for i in range(3):
        s = f @ q[i]
        near = np.argsort(-np.round(s, 6), kind="stable")[:6]
        w = {}
        for j in near:
            for e in set(ents[j]):
                w.setdefault(e, []).append((round(s[j], 6) - s.min()) / (s.max() - s.min() + 1e-9) / freq[e])
        want = dict(sorted(((k, float(np.mean(v))) for k, v in w.items()), key=lambda x: (-round(x[1], 9), x[0]))[:3])
        assert {x.node: x.weight for x in got if x.query_id == i} == pytest.approx(want, abs=1e-6)


def test_layers_and_concepts(spark):
    named = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, node string")
    links = spark.createDataFrame([("a", "p"), ("p", "g"), ("b", "g"), ("g", "top")], "child string, parent string")
    got = {x.node: x.weight for x in seeding.concept_seeds(named, links).collect()}
    assert got == pytest.approx({"a": 0.1, "b": 0.1, "p": 0.05, "g": 0.05, "top": 0.025})
    x = spark.createDataFrame([(1, "a", 0.3), (1, "z", 0.2)], "query_id int, node string, weight double")
    both = {r.node: r.weight for r in seeding.layered([x, x], [seeding.concept_seeds(named, links)]).collect()}
    assert both == pytest.approx({"a": 0.6, "z": 0.4, "b": 0.1, "p": 0.05, "g": 0.05, "top": 0.025})


def test_question_edges(spark):
    outs = spark.createDataFrame([(1, "t", ["x", "y"], [1.0, 0.0]), (2, "t", ["q"], [0.0, 1.0])], "id int, item string, words array<string>, v array<double>")
    ins = spark.createDataFrame([(7, "t", ["x", "y"], [1.0, 0.0]), (8, "u", ["x"], [0.8, 0.6]), (9, "w", [], [0.0, 0.1])], "id int, item string, words array<string>, v array<double>")
    assert [tuple(x) for x in seeding.question_edges(outs, ins).collect()] == [("t", "u", 1, 8, 0.65)]


def test_providers(spark):
    df = spark.createDataFrame([(1, "Dosis de metformina"), (2, "dosis de METFORMINA!"), (3, ""), (4, None)], "id int, x string")
    v = {r.id: r.v for r in df.select("id", providers.hashed_embedder(32)(F.col("x")).alias("v")).collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-6 and set(v[3]) == {0.0} and v[4] is None
    near = df.select(providers.close_matches(["metformina", "insulina"])(F.lower(F.regexp_extract("x", "(?i)metfor[a-z]+", 0))).alias("m")).collect()
    assert near[0].m == ["metformina"] and near[2].m == []
    assert df.select(providers.overlap_scorer(F.col("x"), F.lit("metformina")).alias("s")).first().s == 0.5
    one = spark.createDataFrame([("A + C+D",)], "x string").select(tx.split_labels(F.col("x"), {"A": "a1", "D": "d1"}).alias("c"), tx.verbalized(F.lit("x"), F.lit("mejora"), F.lit(None).cast("string"), F.lit("y" * 400)).alias("v"), tx.has_all(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("h")).first()
    assert one.c == ["a1", "d1"] and one.v == "x mejora " + "y" * 300 and one.h


def test_search_modulates_every_fact(spark):
    r = np.random.default_rng(4)
    q, f = unit(r, 2), unit(r, 450)
    ents = [[f"ent:{i % 7}", f"ent:{i % 3}"] if i % 50 else [] for i in range(450)]
    edges = [(e, f"fact:{i}", 1.0) for i in range(450) for e in dict.fromkeys(ents[i])] + [(f"fact:{i}", f"chunk:{i % 40:02d}", 1.0) for i in range(450)] + [("chunk:03", "ent:1", 0.5)]
    seeds = {0: {"ent:0": 2.0, "chunk:03": 1.0}, 1: {"ent:4": 1.0, "ent:5": 0.5}}
    got = seeding.search(
        spark.createDataFrame([(i, q[i].tolist()) for i in range(2)], "query_id int, v array<double>"),
        spark.createDataFrame([(f"fact:{i}", f[i].tolist(), ents[i]) for i in range(450)], "id string, v array<double>, entities array<string>"),
        spark.createDataFrame(edges, "src string, dst string, weight double"),
        spark.createDataFrame([(i, n, w) for i, s in seeds.items() for n, w in s.items()], "query_id int, node string, weight double"),
        100,
    ).collect()
    for i, s in seeds.items():
        factor = {f"fact:{j}": 0.25 + 0.75 * float(np.clip(x, 0, 1)) for j, x in enumerate(f @ q[i])}
        want = {n[6:]: x for n, x in dense_pagerank(edges, s, 0.5, 8, factor).items() if n.startswith("chunk:") and x > 0}
        have = {x.id: x.score for x in got if x.query_id == i}
        assert have.keys() == want.keys() and max(abs(have[n] - x) for n, x in want.items()) < 2e-6


def test_modulated_by_all_lexical_scores(spark, tmp_path):
    # 260 chunks share a word with the question, 60 none; the chunks of one drug are far more than 100
    texts = {f"c{i:03d}": ("otra cosa sin nada" if i % 16 in (3, 7, 11) else "dosis de metformina " + "recuento " * (i % 13) + "pauta " * (i % 5)) for i in range(320)}
    named = {c: ["metformina"] if i % 3 else ["metformina", "insulina"] for i, c in enumerate(texts)}
    spark.createDataFrame([(c, t, named[c], "g") for c, t in texts.items()], "chunk_id string, texto string, farmacos array<string>, guia string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(100, "medico", "dosis y recuento de la metformina")], "id long, role string, content string").write.parquet(f"{tmp_path}/messages.parquet")
    got = {x.id: x.score for x in search.ppr_modulated(spark, str(tmp_path)).collect()}
    scores = {x.id: x.score for x in retrieval.bm25(search.questions(spark, str(tmp_path)), search.passages(spark, str(tmp_path)), 1000, places=9).collect()}
    assert 100 < len(scores) < 320
    factor = {f"chunk:{c}": 0.25 + 0.75 * scores.get(c, 0) / max(scores.values()) for c in texts}
    edges = [x for c, e in named.items() for n in e for x in ((f"ent:{n}", f"chunk:{c}", 1.0), (f"chunk:{c}", f"ent:{n}", 1.0))]
    want = {n[6:]: x for n, x in dense_pagerank(edges, {"ent:metformina": 1.0}, 0.5, 60, factor).items() if n.startswith("chunk:")}
    least = sorted(want.values())[-10]
    # the tolerance is 1e-4 over all nodes of a query
    assert len(got) == 10 and all(abs(x - want[c]) < 2e-5 and want[c] > least - 2e-5 for c, x in got.items())
