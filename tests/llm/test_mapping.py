import random

from lumbre.llm import mapping as m

TERMS = [("recuento de fezodobri", "A"), ("fezodobri count", "A"), ("hepatitis de salibefi", "B"), ("salibefi hepatitis", "B"), ("zqgl", "B"), ("nefureraococo palido", "C"), ("deficit de rorogave", "D"), ("anticuerpos anti-pudereso", "E"), ("gomorabrimab", "G")]


def test_values():
    index = m.Index(TERMS)
    same = {"fezodobri de recuento": "A", "rec. de fezodobri": "A", "nº de fezodobri": "A", "* hepatitisade_salibefi": "B", "Z.Q.G.L.": "B", "ZQGL (comp.)": "B", "Nefureraococo PÃ¡lido": "C", "DÉFICIT-DE-ROROGAVE - revisar": "D", "posible deficit de rorogaev ?": "D", "Pac. con anticuerpos ani-pudereso NOS": "E", "  gomorabirmab 50 mg ": "G", "antecednte de salibefi hepatitis": "B"}
    assert {k: index.match(k)[0] for k in same} == same
    for other in ("dieta blanda", "recuento de salibefi", "hepatitis de fezodobri", "gomorabriprida", "zqgm", "deficit de roromeve", "?", "50 mg"):
        assert index.match(other)[0] is None, other


def test_candidates_against_all():
    """What the exact check would take among all entries stands among those above the threshold: recall over mistyped values."""
    r = random.Random(4)
    heads = "recuento de,deficit de,hepatitis de,anticuerpos anti,terapia con,biopsia de,alergia a".split(",")
    terms = [(f"{r.choice(heads)} {''.join(r.choice('bcdfglmnprstvz') + r.choice('aeiou') for _ in range(r.randint(3, 5)))}", f"K{i}") for i in range(1500)]
    index = m.Index(terms)
    take = hit = 0
    for text, _ in r.sample(terms, 150):
        k = r.randrange(2, len(text) - 1)
        value = r.choice([text, text[:k] + text[k + 1 :], text[:k] + r.choice("aeiou") + text[k:], text[: k - 1] + text[k] + text[k - 1] + text[k + 1 :]])
        words = m.content(m.words_of(value))
        all_entries = {i for i in range(len(index.ids)) if m.edits(words, index.words[i]) < 90}
        take, hit = take + len(all_entries), hit + len(all_entries & set(index.candidates(words)[0].tolist()))
    assert take > 120 and hit >= 0.97 * take


def test_margin():
    index = m.Index([("alergia a rosamina", "A"), ("alergia a rosimina", "B")])
    # between two entries that are equally near there is no decision
    assert index.match("alergia a rosamina")[0] == "A" and index.match("alergia a rosomina")[0] is None


def test_operator(spark):
    values = spark.createDataFrame([("fezodobri count", 1), ("fezodobri count", 2), (None, 3), ("   ", 4), (" ", 5), ("nada de eso", 6), ("x" * 5000, 7)], "v string, value int")
    terms = spark.createDataFrame(TERMS + [(None, "Z"), ("sin clave", None)], "t string, k string")
    want = {"fezodobri count": "A", "nada de eso": m.NONE, "x" * 5000: m.NONE}
    for block in (1000, 2):
        assert {r.value: r.key for r in m.map_values(values, "v", terms, "t", "k", block).collect()} == want
    assert {r.key for r in m.map_values(values, "v", terms.limit(0), "t", "k").collect()} == {m.NONE}
    assert m.map_values(values.limit(0), "v", terms, "t", "k").count() == 0
