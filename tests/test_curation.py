import pytest
from pyspark.sql import functions as F

from lumbre.functions import providers
from lumbre.operators import curation, graph
from lumbre.sources import store


def test_names(spark):
    df = spark.createDataFrame([("  Ácido   Fólico ",), ("Ácido (fólico) B-9",), ("",), (None,)], "n string")
    got = [tuple(r) for r in df.select(curation.squeezed(F.col("n")), curation.bare(F.col("n")), curation.word_overlap(curation.bare(F.col("n")), F.array(F.lit("ácido"), F.lit("b")))).collect()]
    assert got == [("ácido fólico", "ácido fólico", 0.5), ("ácido (fólico) b-9", "ácido b 9", pytest.approx(2 / 3)), ("", "", 0.0), (None, None, 0.0)]


def test_first_context_and_slot(spark):
    df = spark.createDataFrame([("b", ["x", "x"], "2"), ("a", ["x", None], "1"), ("a", ["x", None], "1"), (None, ["y"], "0"), ("c", None, "3")], "id string, e array<string>, t string")
    assert {tuple(r) for r in curation.first_context(df.withColumn("item", F.lit(9)), "id", "e", "t").collect()} == {("x", "a", "1")}
    assert [r.id for r in curation.in_slot(df, "e", ["x"]).where("t = '2'").collect()] == ["b"] and curation.in_slot(df.limit(0), "e", ["x"]).count() == 0


def test_judged(spark):
    df = spark.createDataFrame([(1, 5, 0.7), (1, 3, 0.7), (1, 3, 0.7), (2, 4, 0.5), (3, 6, None), (None, 7, 0.9)], "d long, c long, s double")
    assert {tuple(r) for r in curation.judged(df, "d", "s", "c", 0.6).collect()} == {(1, 3, 0.7), (2, None, None), (3, None, None)}


def test_variants(spark):
    names = spark.createDataFrame([(1, "Gripe"), (2, "gripe (influenza)"), (3, "algo (Influenza)"), (4, None), (5, ""), (6, "nada"), (1, "Gripe")], "k int, n string")
    terms = spark.createDataFrame([("gripe", "B"), ("gripe", "A"), ("influenza", "C"), (None, "Z")], "t string, c string")
    assert {tuple(r) for r in curation.anchor_by_variants(names, "k", "n", terms, "t", "c").collect()} == {(1, 0, "A"), (2, 1, "A"), (3, 2, "C")}
    assert curation.anchor_by_variants(names, "k", "n", terms.limit(0), "t", "c").count() == 0


def test_remapped(spark):
    df = spark.createDataFrame([("z", "g", 1), ("y", "g", 2), ("y", "g", 2), ("x", None, 1), (None, "g", 3)], "k string, g string, o int")
    assert {tuple(r) for r in curation.remapped(df, "k", "g", "o").collect()} == {("z", "g::1"), ("y", "g::2"), ("x", "x")}


def test_succession_of_a_hot_entity(spark):
    rows = [(f"i{n:04d}", "hot") for n in range(500)] + [("i0001", "cold"), ("i0009", "cold"), ("i0009", "cold"), (None, "cold"), ("i1", None)]
    got = {(r.entity, r.src, r.dst) for r in graph.succession_edges(spark.createDataFrame(rows, "id string, entity string")).collect()}
    assert got == {("hot", f"i{n:04d}", f"i{n + 1:04d}") for n in range(499)} | {("cold", "i0001", "i0009")}


def test_close_terms_beyond_any_bound(spark):
    """The term that matches stands behind more than 5,000 others."""
    terms = [f"aaa{n:05d}" for n in range(6000)] + ["zoledronato"]
    df = spark.createDataFrame([("zoledronata", terms), (None, terms), ("x", None)], "x string, b array<string>")
    got = [[m.term for m in r.m] for r in df.select(providers.close_in_block("x", "b").alias("m")).collect()]
    assert got == [["zoledronato"], [], []]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            @staticmethod
                            def isDefined():
                                return False

                        return O

                return S

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        store.shared_folder(Session)
