from lumbre.llm import pairs

Q = "¿Cada cuánto debo pedir recuento de vomoduno durante 42 semanas?"


def test_kinds():
    assert all(pairs.is_empty(x) for x in (None, "", " \t", "[4] [2]", "<br/>", "N/A", "—", "​", "(vacío)", "{}"))
    assert not any(pairs.is_empty(x) for x in ("No.", "300 mg", "Sí."))
    assert pairs.is_copy(Q, Q.upper()) and pairs.is_copy(Q, "Usted pregunta: " + Q) and pairs.is_copy(Q, "Cada cuánto pedir recuento de vomoduno durante 42 semanas.")
    assert not pairs.is_copy(Q, Q + " Se aconseja repetir la determinación cada seis meses y valorar con el laboratorio de referencia el resultado discordante.") and not pairs.is_copy(Q, "Cada 42 semanas")
    assert pairs.is_refusal(Q, "Lo siento, no estoy autorizado a contestar. Acuda a un especialista.") and pairs.is_refusal("Is x safe?", "Sorry, I cannot help with that.")
    assert not pairs.is_refusal(Q, "Las guías indexadas no recogen recomendaciones sobre vomoduno [1].") and not pairs.is_refusal(Q, "No puedo concretar más sin otra analítica, pero conviene medir la tensión arterial cada 8 meses.")
    assert pairs.is_foreign(Q, "Live vaccines are avoided when the count is below the limit of the assay.") and pairs.is_foreign(Q, "A dose deve ser ajustada quando a função renal fica abaixo de 381.")
    assert not pairs.is_foreign(Q, "Se aconseja esperar. El original dice: \"Live vaccines are avoided when the count is low.\"") and not pairs.is_foreign("How often should I check it over 12 days?", "It is checked every month in the laboratory.")


def test_terminal_contexts():
    body = ["La radiografía mostró una caverna de %d mm y el esputo siguió positivo a las %d semanas.", "Se recomienda medir la tensión arterial cada %d meses en pacientes con hepatopatía de %d años.", "El cultivo tardó %d días y el antibiograma informó una concentración de %d mg/l."]
    texts = [body[i % 3] % (i, i + 3) + " " + body[(i + 1) % 3] % (i, i + 2) for i in range(900)]
    model = pairs.Terminal().fit(texts)
    whole = [t for t in texts[:40]] + [t.rstrip(".") for t in texts[40:80]]
    cut = ["La radiografía mostró una caverna de 4 mm y el", "Se recomienda medir la tensión arter", "Hay tres condiciones: 1) la primera; 2) la segunda.", "Pasos a seguir:", "El cultivo tardó 3 días y…"]
    assert model.cut(whole).mean() < 0.05 and model.cut(cut).all()


def test_pairing(spark):
    rows = [(1, "t", "medico", "q1"), (2, "t", "asistente", "a1"), (2, "t", "asistente", "a1"), (3, "t", "asistente", "no"), (4, "u", "medico", "q2"), (5, "t", "medico", "q3"), (6, "t", "medico", "q4"), (7, "t", "sistema", "x"), (8, "t", "asistente", None), (9, "u", "asistente", "a2"), (10, None, "asistente", "z"), (None, "t", "asistente", "z")]
    df = spark.createDataFrame(rows, "id long, th string, role string, c string")
    want = {(2, "q1", "a1"), (8, "q4", None), (9, "q2", "a2")}
    for block in (100, 2, 1):
        got = {tuple(r) for r in pairs.answer_pairs(df, "id", "th", "role", "c", "medico", "asistente", block).collect()}
        assert got == want, block
    assert pairs.answer_pairs(df.limit(0), "id", "th", "role", "c", "medico", "asistente").count() == 0


def test_defects(spark):
    model = pairs.Terminal().fit([])
    df = spark.createDataFrame([(1, Q, None), (2, Q, Q), (3, None, "Sí."), (4, Q, "Se mide cada mes. " * 3000)], "id long, question string, answer string")
    assert {tuple(r) for r in pairs.defects(df, model).collect()} == {(1, "vacia"), (2, "copia")}


def test_length_is_no_escape():
    """Defects beyond the lengths at which earlier versions stopped looking."""
    question = "¿Cuál es la pauta de vacunación recomendada para un paciente sin bazo que viaja en dos semanas?"
    long_question = " ".join(f"{question} Tiene {n} años y pesa {n + 20} kilos." for n in range(30, 60))
    assert pairs.is_copy(long_question, long_question + " Esa es la consulta que me hace.")
    refusal = "Lo siento. No puedo responder a esta consulta. " + "Mis normas no me permiten opinar sobre este asunto. " * 30
    assert len(refusal) > 700 and pairs.is_refusal(question, refusal)
    assert pairs.is_copy("¿Y la dosis?", "y la dosis") and not pairs.is_copy("¿Y la dosis?", "Dos al día")
