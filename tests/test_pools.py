"""Pools finished in one task against the rankings from joined and partial ones."""

import numpy as np
from pyspark.sql import functions as F

from lumbre.functions import providers, text as tx
from lumbre.operators import pools, retrieval
from lumbre.plans import agents
from tests.test_seeding import unit


def rows(df):
    return sorted((x.query_id, x.rank, x.id, round(x.score, 7)) for x in df.collect())


def test_nearest_ranks_as_the_exact_search_and_gives_one_pool_a_query(spark, monkeypatch):
    monkeypatch.setattr(pools, "ROWS", 16)
    monkeypatch.setattr(pools, "GROUP", 8)
    r = np.random.default_rng(5)
    v, q = unit(r, 150).astype(np.float32), unit(r, 20).astype(np.float32)
    # equal vectors whose order is that of their ids, null and zero ones, queries without a vector
    table = [(f"c{i * 37 % 150:03d}", (v[i // 3] if i % 2 else v[i]).tolist()) for i in range(150)] + [("c900", None), ("c901", [0.0] * v.shape[1])]
    vectors = spark.createDataFrame(table, "id string, v array<float>")
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(20)] + [(20, None), (21, [0.0] * v.shape[1])], "query_id int, v array<float>")
    ordered = vectors.repartitionByRange(5, "id").sortWithinPartitions("id")
    for k in (1, 7, 200):
        made = []
        monkeypatch.setattr(pools, "top", lambda scored, k: made.append(scored) or retrieval.top(scored, k))
        got = pools.nearest(queries, pools.vector_blocks(ordered), k)
        assert rows(got) == rows(retrieval.dense(queries, vectors, k)) and len(rows(got)) == 21 * min(k, 151)
        # no query has a pool in more than one task
        assert made[0].count() == 21 * min(k, 151)


def test_hybrid_ranks_every_question_as_the_fused_pools(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pools, "ROWS", 16)
    monkeypatch.setattr(pools, "GROUP", 8)
    monkeypatch.setattr(pools, "CELLS", 400)
    monkeypatch.setattr(pools, "PRODUCT", 12)
    monkeypatch.setattr(pools, "TERMS", 2)
    monkeypatch.setattr(pools, "SHORT", 2)
    r = np.random.default_rng(9)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lor", "min", "ra")]
    p = 1.0 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(r.choice(words, n, p=p / p.sum()))
    # repeated rows, a copy under another id, no text, no words; none of the ids of the questions is a multiple of 100
    chunks = [(f"c{i * 37 % 120:03d}", text(12)) for i in range(120)]
    chunks += [chunks[3], ("c500", chunks[5][1]), ("c501", None), ("c502", "..."), (None, "bamin")]
    asked = [(100 * i + 7, "medico", text(4)) for i in range(25)] + [(9, "medico", "¿?"), (8, "medico", "xyz"), (6, "medico", None), (5, "asistente", "bamin")]
    asked += [(11, *asked[0][1:]), asked[1]]
    spark.createDataFrame(chunks, "chunk_id string, texto string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame(asked, "id long, role string, content string").write.parquet(f"{tmp_path}/messages.parquet")
    queries = spark.createDataFrame([(i, t) for i, role, t in dict.fromkeys(asked) if role == "medico" and t], "query_id long, text string")
    documents = spark.createDataFrame([x for x in dict.fromkeys(chunks) if x[0] and x[1]], "id string, text string")
    embed = providers.embedder()
    v = lambda df, key: df.select(key, embed(F.col("text")).alias("v"))
    for pool in (50, 15):
        want = retrieval.fuse([(retrieval.bm25(queries, documents, pool, tx.analyze), 1.0), (retrieval.dense(v(queries, "query_id"), v(documents, "id"), pool), 3.0)], 10)
        got = agents.hybrid(spark, str(tmp_path)) if pool == 50 else pools.hybrid(queries, documents, embed, 10, pool, 1.0, 3.0)
        assert rows(got) == rows(want) and len({x[0] for x in rows(got)}) == 28
