import numpy as np
import pytest

from lumbre.llm import pii
from lumbre.llm.boosting import Boosted


def test_boosted_trees_learn():
    r = np.random.default_rng(1)
    x = r.integers(0, 5, (2000, 4)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 1)).astype(int)
    model = Boosted(rounds=30, depth=3).fit(x, y)
    assert ((model.predict(x) > 0.5) == y).mean() > 0.98 and model.predict(x[:0]).shape == (0,)


@pytest.fixture(scope="module")
def model(spark):
    """Trees and the table of words in lower case of two small tables."""
    rows = spark.read.parquet("/root/testdata/sf0.01/messages.parquet").select("content").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("text as content"))
    shares = pii.case_shares(rows, "content")
    return pii.fit(shares=shares), shares


# Sentences of other wording than the ones the trees are fitted on; the names are in no list of the operator.
HELD_OUT = [
    ("El traumatólogo Bogdan Popescu revisará la herida mañana.", "NOMBRE"),
    ("Esta tarde pasa por aquí Wei Zhang a recoger los análisis.", "NOMBRE"),
    ("Hemos citado para el jueves a Kwame Mensah por su rodilla.", "NOMBRE"),
    ("Fatou Diallo refiere un picor que no cede con la crema.", "NOMBRE"),
    ("Lo decidió la doctora Iribarren después de la sesión.", "NOMBRE"),
    ("Quedamos en que Oksana Kovalenko trae a su suegro el viernes.", "NOMBRE"),
    ("Gracias por todo. Saludos de Aoife Gallagher", "NOMBRE"),
    ("Tengo delante a Gudrun Halvorsen con dolor en el pecho.", "NOMBRE"),
    ("¿Puede venir Itxaso Zubeldia antes de las nueve?", "NOMBRE"),
    ("La hermana de Thiago Nascimento preguntó por la cirugía.", "NOMBRE"),
    ("Comentado con el Dr. Anzoátegui, que está de acuerdo.", "NOMBRE"),
    ("Interconsulta firmada por P. Wojciechowska en nefrología.", "NOMBRE"),
    ("OTOÑIEL BARRAGÁN pide que le cambien el día.", "NOMBRE"),
    ("Acude acompañada de su nuera, Remedios Ollero Cid.", "NOMBRE"),
    ("El traslado lo pidió Saioa Etxaniz-Larrea ayer noche.", "NOMBRE"),
    ("Dejó escrito que avisáramos a Nikolai Petrov.", "NOMBRE"),
    ("Anoche ingresó Yusuf Adeyemi, de cuarenta años, con vómitos.", "NOMBRE"),
    ("La prima de Ngozi Okafor recogerá las recetas.", "NOMBRE"),
    ("Remitido por Ingrid Søndergaard para valoración.", "NOMBRE"),
    ("Hablamos con Priyanka Deshmukh y con su esposo.", "NOMBRE"),
    ("Si surge algo me escriben a taller.norte@posta.example por favor.", "EMAIL"),
    ("Mi cuenta nueva es k.brandt77@red.example, la otra no sirve.", "EMAIL"),
    ("Que lo manden a farmacia(arroba)valle.example hoy mismo.", "EMAIL"),
    ("Para cambios de hora, 655 201 334 en horario de oficina.", "TELEFONO"),
    ("Contacta conmigo en el +34 711-902-118 si hay novedades.", "TELEFONO"),
    ("La hija coge el 912 00 45 67 hasta las seis.", "TELEFONO"),
    ("Se comprobó en ventanilla su DNI 70123456K sin incidencias.", "DOCUMENTO"),
    ("Viene con el pasaporte XQ1234567 y sin tarjeta.", "DOCUMENTO"),
    ("El NIE Y4567890P está renovado.", "DOCUMENTO"),
    ("Nos abrió la puerta en la calle del Olmo, 14, 3.º B.", "DIRECCION"),
    ("Recogieron la silla en Avda. de Portugal n.º 8, Zafra.", "DIRECCION"),
    ("Ahora para en el Paseo de las Acacias 21, junto al parque.", "DIRECCION"),
]
CLEAN = [
    "El Servicio de Cardiología cerrará en agosto.", "La Organización Mundial de la Salud cambió el umbral.", "Se aisló Klebsiella pneumoniae en el segundo cultivo.", "La escala de Karnofsky bajó a 40.", "Retiraron el lote 88231907 por un defecto.", "Tomó 500 mg @ 12 h durante una semana.",
    "La calle estaba mojada y resbaló.", "Pidió la vía alternativa de 18 meses.", "Entre 2011 y 2019 se incluyeron 123.456 casos.", "No quiso dar su teléfono ni su correo.", "El ensayo NCT09876543 no ha terminado.", "[NOMBRE] llegó con [TELEFONO] apuntado.", "Conviene repetir la analítica en tres meses.", "La Guía de Práctica Clínica recomienda esperar.", "Tras el alta, paseo diario de 40 minutos.",
]


def test_other_templates_and_names(model):
    trees, shares = model
    listed = {x.lower() for x in pii.GIVEN}
    found = pii.find([t for t, _ in HELD_OUT], trees, shares)
    hits = [kind in {k for k, _, _ in got} for (_, kind), got in zip(HELD_OUT, found)]
    names = [h for h, (_, kind) in zip(hits, HELD_OUT) if kind == "NOMBRE"]
    assert sum(names) >= 0.9 * len(names), [t for h, (t, _) in zip(hits, HELD_OUT) if not h]
    assert sum(hits) >= 0.9 * len(hits), [t for h, (t, _) in zip(hits, HELD_OUT) if not h]
    assert not any(w.lower() in listed for t, kind in HELD_OUT if kind == "NOMBRE" for w in t.split())
    wrong = [(t, [t[a:b] for _, a, b in s]) for t, s in zip(CLEAN, pii.find(CLEAN, trees, shares)) if s]
    assert len(wrong) <= 1, wrong
    at = found[-1][0]
    assert HELD_OUT[-1][0][at[1] : at[2]] == "Paseo de las Acacias 21"


def test_generated_sentences(model):
    trees, shares = model
    maker = pii._Maker(987, shares)
    made = [maker.sentence() for _ in range(1500)]
    found = pii.find([t for t, _ in made], trees, maker.shares)
    hit = miss = wrong = 0
    for (_, truth), got in zip(made, found):
        a, b = {k for k, _, _ in truth}, {k for k, _, _ in got}
        hit, miss, wrong = hit + len(a & b), miss + len(a - b), wrong + len(b - a)
    assert hit / (hit + miss) > 0.9 and hit / (hit + wrong) > 0.9


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "Correo: ana.sanlobez@correo.example. Dosis de 200 mg."), (2, "Vive en Avda. de los Sanlobez n.º 82, Montejada."), (3, ""), (4, None), (5, "Aporta [DNI] en admisión. Lote 123456789 del fabricante."), (5, "Aporta [DNI] en admisión. Lote 123456789 del fabricante."), (6, "Texto sin datos. " * 5000)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r for r in pii.scan(df.withColumn("kinds", df.id), "t", ["id"]).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert got[1].redacted == "Correo: [EMAIL]. Dosis de 200 mg." and got[1].kinds == ["EMAIL"]
    assert got[2].redacted == "Vive en [DIRECCION]." and got[3].kinds == []
    assert got[5].redacted == rows[4][1] and got[6].redacted == rows[6][1]
    assert pii.scan(df.limit(0), "t", ["id"]).count() == 0
