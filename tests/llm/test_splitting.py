from hypothesis import given, settings, strategies as st

from lumbre.llm import splitting

ALPHABET = st.sampled_from(["Una frase sobre fármacos. ", "La vacuna protege. ", "\n\n", "\n- punto de la lista", "palabra ", "x" * 70, "á́", "; luego ", "| a | b |\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join))
def test_round_trip(text):
    found = splitting.pieces(text, 200, 30)
    assert "".join(text[f:e] for _, f, e in found) == text
    for n, (s, f, e) in enumerate(found):
        assert 0 < e - s <= 200 and s <= f < e
        if n:
            assert found[n - 1][2] == f and f - 30 <= s
    if len(text) > 200:
        assert len(found) > 1


def test_natural_cut_at_topic_change():
    a = "La vacuna antigripal protege a los convivientes vacunados. " * 9
    b = "El contrato obliga al proveedor segun la norma publicada. " * 9
    found = splitting.pieces(a + b, 800, 100)
    assert found[0][2] == len(a)


def test_operator(spark):
    rows = [("a", "Frase corta. " * 300, 3, "s"), ("a", "Frase corta. " * 300, 3, "s"), ("b", "corto", 1, None), ("c", None, 1, None), (None, "Frase. " * 900, 1, None), ("d", "z" * 5000, None, None), ("e", "", None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, texto string, pagina int, piece string")
    got = splitting.split_long(df, "chunk_id", "texto", ["pagina"]).collect()
    assert {r.chunk_id for r in got} == {"a", "d"} and {r.pagina for r in got if r.chunk_id == "a"} == {3}
    for key, text in (("a", "Frase corta. " * 300), ("d", "z" * 5000)):
        mine = sorted((r.piece, r) for r in got if r.chunk_id == key)
        assert "".join(text[r.fresh : r.end] for _, r in mine) == text and all(r.piece_text == text[r.start : r.end] and len(r.piece_text) <= 1500 for _, r in mine)
    assert splitting.split_long(df.limit(0), "chunk_id", "texto", ["pagina"]).count() == 0


def test_smallest_row_of_a_key(spark):
    rows = [("k", "b" * 2000, "z"), ("k", "a " * 1000, None), ("k", "a " * 1000, "y")]
    for order in (rows, rows[::-1]):
        got = splitting.split_long(spark.createDataFrame(order, "k string, t string, s string"), "k", "t", ["s"]).collect()
        assert {r.s for r in got} == {None} and all(set(r.piece_text) <= {"a", " "} for r in got)
