"""The embedder keeps short words and the order of words."""

import numpy as np
from pyspark.sql import functions as F

from lumbre.functions import providers


def test_embedder_counts_short_words_and_word_pairs(spark):
    texts = ["VIH, TAR y CD4", "vih tar: y cd4", "retirar el farmaco no iniciar", "iniciar el farmaco no retirar", "de la", "farmaco", "El fármaco"]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, x string").select("id", providers.hashed_embedder()(F.col("x")).alias("v")).collect()
    v = {r.id: np.array(r.v) for r in got}
    assert abs(v[0] @ v[0] - 1) < 1e-6 and np.array_equal(v[0], v[1])
    assert 0.2 < v[2] @ v[3] < 0.999 and not v[4].any()
    # the pair with a stop word counts, the stop word alone does not
    assert 0.5 < v[5] @ v[6] < 0.999


def test_embedder_of_the_queries_can_be_replaced(spark, monkeypatch):
    assert providers.embedder().func.__qualname__.startswith("hashed_embedder")
    monkeypatch.setenv("LUMBRE_EMBEDDER", "tests.test_providers:other")
    assert providers.embedder()("x") == "other x"


def other():
    return lambda x: f"other {x}"
