from lumbre.llm import scans

BASE = ["El recuento de copias se determina cada mes en el laboratorio.", "La pauta de rescate alcanzó la supresión en pacientes mayores.", "Se aconseja añadir metformina con plan teórico-práctico.", "Según criterio coste-efectivo, la pauta médica es anual.", "Se valora tanto pre- como poscirugía la dosis de recuerdo."]


def lexicon():
    from collections import Counter

    text = "\n".join(BASE)
    words = Counter(w for w in scans.TOKEN.findall(text.lower()) if len(w) > 3)
    rows = [("w", k, 50 * v) for k, v in words.items()] + [("c", k, 9) for k in ("teórico-práctico", "coste-efectivo")] + [("h", "guía de cardio 0", 5)]
    return scans.Lexicon(rows, 1.0)


LEX = lexicon()


def kinds(text, title=False):
    return scans.repair(text, LEX, title)[0]


def test_each_kind():
    assert scans.repair("La pauta de res-\ncate alcanzó", LEX) == ({"guion"}, "La pauta de rescate alcanzó")
    assert scans.repair("la supre­\r\nsión y metfor- mina", LEX)[1] == "la supresión y metformina"
    assert kinds("con plan teórico-\npráctico") == set() and kinds("tanto pre- como poscirugía") == set() and kinds("un texto\nsin signo") == set()
    assert scans.repair("El rec0ento de c@pias, la dos1s de recuerclo en pacicntes", LEX)[0] == {"ocr"}
    assert scans.repair("dos1s de recuerclo rnetformina afiadir", LEX)[1] == "dosis de recuerdo metformina añadir"
    assert kinds("HbA1c y CD4 con M291V a 25 mg RECUENTO recuento supresion") == set()
    assert kinds("Guía de cardio 2023\nEl recuento") == {"cabecera"} and kinds("Guía de cardio 2023 | 11") == {"cabecera"} and kinds("Cardio 2023 · Borrador interno") == {"cabecera"}
    assert kinds("Guía de cardio 2023", title=True) == set() and kinds("3.2 Seguimiento clínico") == set()
    for page in ("Página 12", "— 12 —", "- 12 -", "12", "[12]", "12 / 214", "pág. 12 de 214", "xviii"):
        assert kinds(page) == {"pagina"}, page
    assert kinds("Tabla 3") == set() and kinds("n = 294") == set() and kinds("") == set()


def test_retrieval_is_complete():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for w in ("pautta", "dosi", "rexuento", "opias", "recuerclo", "anuall", "mess"):
        assert {v for v in LEX.words if distance(w, v) <= 1} <= {v for _, v in LEX.look_up(w)}


def test_operator(spark):
    rows = [("d", 1, x, 10.0) for x in BASE * 40] + [("e", 1, "La pauta de res-", None), ("e", 2, "La pauta de res-\ncate alcanzó la", None), ("e", 3, "supresión.", None), ("e", 3, "supresión.", None), ("e", 4, None, None), (None, 5, "x", 1.0), ("f", 1, "", 1.0), ("g", 1, "recuento " * 30000, 9.0)]
    df = spark.createDataFrame(rows, "doc string, ord int, texto string, size double").withColumn("kinds", scans.F.lit(1))
    lex = scans.lexicon(df, "texto")
    got = scans.clean(df, "texto", ["doc", "ord"], lex, "size")
    assert {tuple(r.kinds) for r in got.where("doc = 'e' and ord = 2").collect()} == {("guion",)}
    for block in (4096, 2, 1):
        made = scans.paragraphs(got, "doc", "ord", "repaired", block).collect()
        whole = {d: [r.text for r in sorted((r for r in made if r.doc == d), key=lambda r: r.number)] for d in "defg"}
        # the first block ends in a hyphen, so the next begins anew
        assert whole["e"][-1] == "La pauta de rescate alcanzó la supresión." and whole["f"] == [] and [r.number for r in made if r.doc == "g"] == [1]
    assert scans.clean(df.limit(0), "texto", ["doc"], scans.lexicon(df.limit(0), "texto")).count() == 0


def test_reflow():
    assert scans.reflow("uno\ndos\n\ntres\n- a\n- b\n3.1 Título\ncuatro") == "uno dos\n\ntres\n- a\n- b\n3.1 Título\ncuatro"


def test_paragraphs_of_chunks(spark, tmp_path):
    from lumbre.llm import queries

    good = " ".join(BASE)
    noisy = "La pauta de res-\ncate alcanzó la supresión\n\nPágina 12\n\nen pacientes mayores.\n\nSe aconseja añadir\nmetformina."
    chunks = [(f"g{i}", good, "g") for i in range(60)] + [("k", noisy, "g"), ("k", noisy, "g"), (None, good, "g"), ("n", None, "g")]
    spark.createDataFrame(chunks, "chunk_id string, texto string, guia string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("d", 1, good, 9.0)], "doc_id string, ord int, texto string, size_max double").write.parquet(f"{tmp_path}/blocks.parquet")
    made = queries.p7_paragraphs(spark, str(tmp_path)).collect()
    assert {(r.parrafo, r.texto) for r in made if r.doc_id == "k"} == {(1, "La pauta de rescate alcanzó la supresión en pacientes mayores."), (2, "Se aconseja añadir metformina.")}
    assert len(made) == 63 and {r.origen for r in made if r.doc_id == "d"} == {"blocks"}
