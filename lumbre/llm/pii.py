"""Personal data in free text: generators propose overlapping spans, boosted trees judge them, the best ones are replaced.

The generators are broad (high recall): anything shaped like an address, a number, an e-mail or a name. For each type, trees
score a span by its format, by the words around it and by how often its words stand in lower case in the collection. They
are fitted on sentences made here from phrases and invented values (no real person's data, no sentence of the tables). In
most of these the names are in no list, so that a name is told by its shape and place. Spans above the calibrated threshold
are chosen from the widest types to the narrowest, so that a name in an address or a number in an address counts as address.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumbre.llm.boosting import Boosted

TYPES = ["EMAIL", "DIRECCION", "TELEFONO", "DOCUMENTO", "NOMBRE"]
#: Candidate spans the trees of one type are fitted on, at most; of names, which have least of a format, four times as many.
SAMPLE = 4000
#: Places of the table of words in lower case; forms that share a place share their share.
CASES = 1 << 20

U, L = "A-ZÀ-ÖØ-ÞŁŚŠŽČĆĐŞȘȚİŹŻĞ", "a-zà-öø-ÿłśšžčćđşșțıźżğăąęāēīōūěřůńňőűţ"
_DIGIT_WORD = "(?:cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve)"
_AT = r"\s*(?:@|＠|\(\s*(?:arroba|at|a)\s*\)|\[\s*(?:arroba|at|a)\s*\]|\{\s*(?:arroba|at)\s*\}|\barroba\b|\bAT\b)\s*"
_DOT = r"(?:\.|\s*(?:\(punto\)|\[punto\]|\[dot\]|\(dot\))\s*|\s+(?:punto|DOT|dot)\s+)"
_EMAIL = re.compile(rf"(?:mailto:\s*)?[\w][\w.+\-]*{_AT}[\w\-]*(?:{_DOT}[\w\-]+)*|[\w][\w.+\-]*[\w]\s+en\s+[\w\-]+(?:\.[\w\-]+)*\.[a-z]{{2,}}\b")
#: Where an address sign may be; the address around it is matched from there.
_SIGN = re.compile(r"[@＠]|\barroba\b|\bAT\b|[\[({]\s*(?:at|a)\s*[\])}]|\sen\s+[\w\-]+(?:\.[\w\-]+)*\.[a-z]{2,}")
#: Six figures with at most separators between them; without these there is no number to propose.
_FIGURES = re.compile(r"\d[\d. ·/\-]{5}")
_DOTTED = re.compile(r"\.(?<=\w\.)[a-z]{2}")
_NUMBER = re.compile(r"(?<![\w.,])(?:(?:\(\+\s?\d{1,3}\)|\+\s?\d{1,3})[ .·/\-]*|\(\d{2,4}\)[ .·/\-]*)?\d(?:[ .·/\-]{0,2}\d){4,}(?:\s*\(prefijo\s*\d{2,4}\)|\s*,?\s*ext\.?\s*\d{1,5})?(?![\d])")
_SPELLED = re.compile(rf"\b{_DIGIT_WORD}(?:[ ,\-]+{_DIGIT_WORD}){{5,}}\b", re.I)
_CODE = re.compile(
    r"(?<![\w\-])(?:(?:nº|n\.º|núm\.?|número)\s*)?(?:\d{2}[. ]?\d{3}[. ]?\d{3}\s?-?\s?[A-Za-z](?!\w)|[XYZxyz]\s?-?\s?\d{7}\s?-?\s?[A-Za-z](?!\w)|[A-Za-z]{2,3}[ \-]?\d{6,7}(?!\w)|\d{2}\s?/\s?\d{7,8}\s?/\s?\d{2}(?!\w)|\d{6,12}(?![\w]))"
)
_STREET = (
    r"(?i:calle(?:jón|ja)?|c/|cl?\.|avda\.?|avenida|av\.|avgda\.?|plaza|plza\.?|pza\.?|pl\.|plaça|paseo|p\.º|pº|pso\.?|passeig|camino|cno\.?|cmno\.?|carretera|ctra\.?|rúa|ronda|rda\.?|travesía|trav\.|glorieta|gta\.?|urbanización|urb\.|cuesta|vía|polígono|pol\.|barrio|carrer|alameda|bulevar|pasaje|psje\.?)"
)
#: A place name behind an address: capitals, or the last word of a clause where all is in small letters.
_TOWN = rf"[{U}][\w'\-]*(?:\s+(?i:de|de\s+la|de\s+los|del)?\s*[{U}][\w'\-]*){{0,2}}"
_PLACE = re.compile(
    rf"(?=[AaBbCcGgPpRrTtUuVv])(?<!\w){_STREET}\s*(?i:(?:de\s+las?\s+|de\s+los\s+|del\s+|de\s+|d[e']?l?\s*)?(?:(?:doctora?|dra?\.|santa|santo|san|general|maestro|profesora?)\s+)?)[{U}{L}][\w'\-]*\.?(?:\s+(?!(?i:n\.|nº|núm|s/n|esc|pta|bajo))[{U}{L}][\w'\-]*){{0,3}}"
    rf"(?i:\s*,?\s*(?:n\.\s?º|nº|n°|núm\.?|número|no\.)?\s*\d{{1,4}}(?!\d)(?:\s?(?:bis|[A-Z](?![\w])))?|\s*,?\s*s/n)?"
    rf"(?i:\s*,?\s*(?:\d{{1,2}}\.?\s?[ºª°]\s?[A-Za-z]?(?!\w)|esc\.?\s?\w{{1,3}}|pta\.?\s?\w{{1,3}}|piso\s?\w{{1,3}}|bajo|ático|entlo\.?|izq(?:da)?\.?|dcha\.?|portal\s?\w{{1,3}}|bloque\s?\w{{1,3}}|puerta\s?\w{{1,3}})(?!\w))*"
    rf"(?:\s*,?\s*(?:(?i:C\.?P\.?)\s*)?\d{{5}}(?!\d)(?:\s+(?:{_TOWN}|[{L}]{{4,}}(?:\s+[{L}]{{4,}})?(?=\s*(?:[.;)]|$))))?|\s*,\s+(?:{_TOWN}|[{L}]{{4,}}(?:\s+[{L}]{{4,}})?(?=\s*(?:[.;)]|$))))?"
)
_TOKEN = rf"(?:[{U}][{L}]+|[{U}]{{2,}}|[{U}]'[{U}][{L}]+|[{U}][{L}]+[{U}][{L}]+)"
_JOIN = r"(?:de\s+las?|de\s+los|del|de|y|i|van|von|der|da|dos|do|ben|bin|el|al|la|le)"
#: What follows the first capital of a token, and what does not stand before it: patterns that begin with a capital are found faster.
_REST = rf"(?<![\w@.\-/].)(?:[{L}]+|[{U}]+|'[{U}][{L}]+|[{L}]+[{U}][{L}]+"
_NAME = re.compile(rf"[{U}]{_REST}|\.)(?:(?:\s+{_JOIN}\s+|\s+|-|\s*,\s+)(?:{_TOKEN}|[{U}]\.)(?:-{_TOKEN})?){{1,4}}(?![\w@])")
_LEAD = re.compile(rf"{_TOKEN}\s+(?:(?:de\s+las?|de\s+los|del|de|y)\s+)?")
_BETWEEN = re.compile(rf"(?:\s+y\s+|\s*,\s+)(?=[{U}])")
_INSIDE = re.compile(r"[\w,)]\s*$")
_SINGLE = re.compile(rf"[{U}]{_REST})(?:-{_TOKEN})?(?![\w@])")
_DIGIT_WORDS = set("cero uno dos tres cuatro cinco seis siete ocho nueve".split())
_DIGIT_CAPITALS = ("UNO", "DOS", "TRES", "CUATRO", "CINCO", "SEIS", "SIETE", "OCHO", "NUEVE")
_LOWER = re.compile(rf"([{L}]+)\s+((?:(?:de\s+las?|de\s+los|del|de)\s+)?[{L}]+(?:-[{L}]+)?(?:\s+[{L}]+)?)")
_LETTERS = re.compile(r"[^\W\d_]+")

# Words that announce personal data of a type, titles of persons, and words that announce other codes.
CUES = {
    "EMAIL": "correo mail e-mail email mailto buzón escribir escríbame electrónica electrónico dirección contacto arroba".split(),
    "DIRECCION": "vive vivo viven domicilio domiciliado domiciliada reside residente empadronado empadronada dirección señas casa vivienda piso mudado mudada trasladado trasladada visita envío enviar recoger recogida calle".split(),
    "TELEFONO": "tfno teléfono telefono tel tlf tf móvil movil celular fijo fax whatsapp llamar llame llamada llamarle marcar número contacto avisar localizable centralita".split(),
    "DOCUMENTO": "dni nif nie nuss naf nhc cip cipa sip pasaporte historia afiliación afiliacion social documento identificación identificacion identidad expediente tarjeta cédula extranjero carné".split(),
    "NOMBRE": "llamo llama llaman llamado llamada nombre hermano hermana hijo hija madre padre pareja marido mujer esposa esposo abuelo abuela tío tía primo prima sobrino sobrina tutor tutora cuidador cuidadora paciente usuario usuaria titular responsable señor señora señorita firmado firma atiende atendido atendida según contacto compañero compañera amigo amiga vecino vecina".split(),
}
TITLES = "dr. dra. dr dra doctor doctora d. d.ª dª sr. sra. sr sra srta. srta don doña señor señora señorita enfermera enfermero profesor profesora prof. lic.".split()
NOT_PERSONAL = "lote código codigo protocolo registro valor versión version ensayo muestra muestras concepto referencia ref. nct isbn issn guía guia cultivo cepa mutación variante factura catálogo acta producto dosis fabricante serie modelo artículo expedición pedido albarán norma resolución boletín eudract doi pmid snomed cie atc frente contra sobre".split()
#: Heads of names of bodies, papers and things that are written in capitals.
BODIES = set("ministerio consejería agencia sociedad asociación fundación hospital clínica centro instituto universidad facultad comité comisión servicio unidad plan programa guía guías manual ley real decreto protocolo proyecto ensayo estudio documento informe consenso red grupo departamento dirección consejo colegio organización european agency society world health national study trial committee group guidelines service department association foundation hospital university institute semana día año lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre comunidad unión estados atención".split())
# Given names of many countries; a hint among others.
GIVEN = (
    "Aarón Abdul Adam Adrián Agnieszka Ahmed Aitana Alba Alberto Alejandra Alejandro Alfonso Alicia Álvaro Amal Amelia Amina Amparo Ana Andrea Andrés Ángel Ángela Antonia Antonio Asunción Aurora Beatriz Begoña Blanca Carla Carlos Carmen Carolina Catalina Cecilia César Charles Chen Clara Claudia Concepción Cristina Daniel Daniela David Diana Diego Dolores Eduardo Elena Elizabeth Emilia Emilio Emma Enrique Ernesto Esteban Esther Eugenia Eva Fátima Federico Felipe Fernando Francisca Francisco Gabriel Gabriela George Gloria Gonzalo Guadalupe Guillermo Hassan Héctor Hugo Ibrahim Ignacio Inés Irene Irina Isabel Ismael Iván Jacinto Jaime James Javier Jesús Joan Joaquín John Jordi Jorge José Josefa Juan Juana Julia Julián Julio Karim Khadija Laura Leonor Lidia Lorena Lorenzo Lucas Lucía Luis Luisa Manuel Manuela Marcos Margarita María Mariana Mario Marta Martín Mateo Matilde Mercedes Miguel Mohamed Mónica Montserrat Natalia Nicolás Noelia Nuria Olga Omar Óscar Pablo Paloma Patricia Paula Pedro Pilar Rafael Ramón Raquel Raúl Ricardo Roberto Rocío Rodrigo Rosa Rubén Samuel Sandra Santiago Sara Sergio Silvia Sofía Susana Teresa Tomás Valeria Vicente Víctor Victoria Virginia Xavier Yolanda Youssef"
).split()
_PLAIN = str.maketrans("áéíóúüàèò", "aeiouuaeo")
_GIVEN = {x.lower() for x in GIVEN} | {x.lower().translate(_PLAIN) for x in GIVEN}
_STOP = set("cómo qué cuál cuáles cuándo cuánto cuánta cuántos cuántas dónde quién quiénes hay puedo puede debo debe cabe conviene necesito quiero how what when which who can should may a al ante bajo cada como con contra cuando de del desde donde durante e el ella ellos en entre era es esa ese eso esta este esto fue fueron ha había han hasta hay la las le les lo los más me mi mientras muy ni no nos o para pero por porque que quien se según ser si sido sin sobre son su sus también tan te tiene tras tu un una unas uno unos y ya yo the of and in to is was were for at with this are on by from or".split())
_ARTICLES = {"el", "la", "los", "las", "un", "una", "del", "al", "the", "su", "sus"}
_PREPOSITIONS = {"a", "de", "con", "por", "para", "según", "y", "e", "o", "ante"}
#: Endings of family names in several languages, and of names of organisms and substances.
_SURNAME = re.compile(r"(?:ez|az|iz|oz|eda|ero|era|ano|ana|ino|ales|ares|ado|ández|escu|eanu|ski|ska|wicz|sson|sen|ova|eva|ov|ev|ian|aga|egi|egui|eta|arri|urri|berri|ides|poulos|shvili|enko|uk)$", re.I)
_SCIENTIFIC = re.compile(r"(?:virus|ium|coco|coccus|cocos|ella|bacter|bacteria|myces|plasma|monas|spora|oma|itis|osis|emia|mab|vir|cilina|micina|prazol|statina|tidina|vudina|gravir|navir|olol|pina|sartán)$", re.I)
_CUE_SETS = {k: frozenset(v) for k, v in CUES.items()}
_NOT_PERSONAL, _TITLES = frozenset(NOT_PERSONAL), frozenset(TITLES)
_OPENING = frozenset(w.rstrip(".") for words in (*CUES.values(), TITLES, NOT_PERSONAL) for w in words)
_BEFORE = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?\.?ª?|\d+|[^\w\s]")
_LOWERCASE = re.compile(rf"(?<!\w)[{L}]{{2,}}(?!\w)")
_CAPITAL = re.compile(rf"[{U}](?<=[{L},] .)[{L}]+(?!\w)")
_ANY_CAPITAL = re.compile(rf"(?<!\w)[{U}][{U}{L}]+(?!\w)")
_RUN = re.compile(r"\w+")
#: Beginning of a run of letters and figures at which an address may begin: words, and abbreviations that a dot or bar ends.
_STREET_RUN = re.compile(
    r"(?=[AaBbCcGgPpRrTtUuVv])(?i:calle|avda|avenida|avgda|plaza|plza|pza|plaça|paseo|pº|pso|passeig|camino|cno|cmno|carretera|ctra|rúa|ronda|rda|travesía|glorieta|gta|urbanización|cuesta|vía|polígono|barrio|carrer|alameda|bulevar|pasaje|psje|(?:c|cl|av|pl|p|trav|urb|pol)\Z)"
)


def _place(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & (CASES - 1)


def _prior() -> Counter:
    """Words in lower case of the pieces of sentences below: they count along, so that a small collection knows the commonest."""
    words = [w for pieces in (*BEGIN.values(), END, NAME_END, OTHERS) for p in pieces for w in _LOWERCASE.findall(p)]
    return Counter(_place(w) for w in [*words, *_OPENING, *_STOP, *BODIES] for _ in range(16))


def prior_shares() -> np.ndarray:
    """The table without a collection."""
    shares = np.zeros(CASES, np.uint8)
    shares[list(_prior())] = 10
    return shares


def case_shares(df: DataFrame, text: str) -> np.ndarray:
    """Table of fixed size: of every word (by hash) the share in which it stands in lower case, in tenths, over all texts.

    A capital in mid-sentence counts four times as much as another. Words seen less than four times, and words hardly ever
    in lower case, have 0.
    """

    def run(batches):
        low, up = np.zeros(CASES, np.int32), np.zeros(CASES, np.int32)
        runs, capitals = Counter(), Counter()

        def add():
            for w, n in runs.items():
                if _LOWERCASE.fullmatch(w):
                    low[_place(w)] += 4 * n
                elif _ANY_CAPITAL.fullmatch(w):
                    up[_place(w.lower())] += n
            for w, n in capitals.items():
                up[_place(w.lower())] += 3 * n
            runs.clear()
            capitals.clear()

        for batch in batches:
            texts = batch["text"].tolist()
            for i in range(0, len(texts), 500):
                joined = "\n".join(texts[i : i + 500])
                runs.update(_RUN.findall(joined))
                capitals.update(_CAPITAL.findall(joined))
                if len(runs) > 100_000:
                    add()
        add()
        at = np.flatnonzero((low > 0) | (up > 0))
        yield pd.DataFrame({"at": at.astype(np.int32), "low": low[at], "up": up[at]})

    spark, prior = df.sparkSession, _prior()
    counted = df.select(F.col(text).alias("text")).where("text is not null").mapInPandas(run, "at int, low int, up int").unionByName(spark.createDataFrame([(int(at), n, 0) for at, n in prior.items()], "at int, low int, up int")).groupBy("at").agg(F.sum("low").alias("low"), F.sum("up").alias("up"))
    shares = np.zeros(CASES, np.uint8)
    rows = counted.where("low + up >= 16").select("at", F.round(10 * F.col("low") / (F.col("low") + F.col("up"))).cast("int").alias("s")).where("s > 0").toPandas()
    shares[rows["at"].to_numpy(np.int64)] = rows["s"].to_numpy(np.uint8)
    return shares


def _nearness(tokens: list[str], words: frozenset) -> int:
    """How near the last of the words stands before the span: 3 right before, 2 within three words, 1 within the window."""
    for i, t in enumerate(reversed(tokens)):
        if t in words or t.rstrip(".") in words:
            return 3 if i == 0 else 2 if i < 4 else 1
    return 0


def _after_kind(after: str) -> int:
    """What follows the span: 0 nothing, 1 a full stop or the like, 2 a comma, 3 a bracket or bar, 4 a figure, 5 a capital,
    6 a joining word, 7 a word like a past tense, 8 another word."""
    s = after.lstrip(" ")
    if not s.strip():
        return 0
    c = s[0]
    if c in ".;:?!\n\"»”":
        return 1
    if c == ",":
        return 2
    if not c.isalnum():
        return 3
    if c.isdigit():
        return 4
    if c.isupper():
        return 5
    w = _LETTERS.match(s)
    w = w.group() if w else ""
    return 6 if w in _STOP else 7 if w[-1:] in "óé" or w[-3:] in ("aba", "ría", "ían") else 8


def features(kind: str, text: str, start: int, end: int, shares: np.ndarray) -> list[float]:
    span = text[start:end]
    before, after = text[max(0, start - 48) : start], text[end : end + 26]
    # words of an earlier sentence say little
    near = re.split(r"[?!\n]\s|(?<![dDrRaª])\.\s(?=[A-ZÁÉÍÓÚ¿\[])", before)[-1]
    tokens = _BEFORE.findall(near.lower())
    if near and start > 48 and near is before and tokens:
        tokens = tokens[1:]
    last = tokens[-1] if tokens else ""
    letters = sum(c.isalpha() for c in span)
    digits = sum(c.isdigit() for c in span)
    upper = sum(c.isupper() for c in span)
    words = _LETTERS.findall(span)
    low_words = [w.lower() for w in words]
    head, tail = before.rstrip(), after.lstrip(" ,")
    kind_after = _after_kind(after)
    out = [
        len(span), letters, digits, upper, len(words),
        max((len(x) for x in re.findall(r"\d+", span)), default=0),
        _nearness(tokens, _CUE_SETS[kind]), _nearness(tokens, _NOT_PERSONAL),
        max(_nearness(tokens, _CUE_SETS[k]) for k in TYPES if k != kind),
        kind_after, (head[-1:] in "([<{") + 2 * (after[:1] in ")]>}") if head else 0,
        (head[-1:] in "|;/") + 2 * (after.lstrip()[:1] in tuple("|;/")) if head else 0,
        head[-1:] == ":", not near.strip(), last in _ARTICLES, last in _PREPOSITIONS,
        span[-1:].isalpha(), span[:1].isalpha(), "," in span, len(words) > 0 and span.upper() == span,
    ]
    if kind == "NOMBRE":
        caps = [w for w in words if w[0].isupper()]
        inner = [w for w in low_words if len(w) > 1 and w not in _STOP]
        common = [int(shares[_place(w)]) for w in inner]
        given = [w in _GIVEN for w in low_words]
        out += [
            _nearness(tokens, _TITLES), sum(given), bool(given and given[0]), bool(given and given[-1]),
            sum(bool(_SURNAME.search(w)) for w in words), sum(bool(_SCIENTIFIC.search(w)) for w in words),
            max(common, default=10), min(common, default=10), common[0] if common else 10, common[-1] if common else 10,
            sum(w in BODIES for w in low_words), sum(w.lower() in _STOP for w in caps), bool(low_words and (low_words[0] in _STOP or low_words[0] in _CUE_SETS["NOMBRE"])),
            sum(c < 5 for c in common), sum(c >= 5 for c in common), bool(re.match(rf"[{U}]\.", span)), sum(1 for w in caps if len(w) > 1 and w.isupper()), len(caps),
            bool(re.search(rf"[{U}][{L}]+[ ,\-]+$", before)) + bool(re.search(rf"(?:[.?!:\n]\s*|^)[{U}][{L}]+\s+$", before)), kind_after == 5,
            "\"" in head[-1:] or "«" in head[-1:] or "“" in head[-1:],
            bool(re.match(rf"\s+[{L}]", after)) and bool(re.search(r"(?:us|um|is|ae|ans|oides|humano|a|o)$", tail.split()[0] if tail.split() else "")),
        ]
    elif kind == "EMAIL":
        low = span.lower()
        out += ["@" in span or "＠" in span, "arroba" in low or "at" in re.findall(r"[a-z]+", low), bool(re.search(r"[\w\-]\s*(?:\.|punto|dot)\s*[a-z]{2,}$", low)), bool(re.match(r"\S*\d+\s*(?:mg|ml|g)?\s*[@＠]", low)), bool(re.search(r"[@＠]\s*\d", span)), " " in span.strip()]
    else:
        low = span.lower()
        out += [
            span.startswith("+") or span.startswith("(+") or span.startswith("00"), sum(span.count(c) for c in " .·-/"), bool(re.search(r"s/n|\b\d{1,4}\b", low)),
            bool(re.search(rf"(?:\s|/|\.)[{U}]", span)), bool(re.search(r"prefijo|ext", low)), bool(re.search(r"\b\d{5}\b", span)), any(w in _STOP for w in low_words[1:]),
            bool(re.match(r"\s*(?:mg|ml|g|ui|mcg|copias|células|%|h|horas?|min|minutos|días|semanas|meses|años|veces|km|m|metros|€|euros|casos|pacientes|personas|médicos|camas|visitas|dosis)\b", after.lower())), bool(re.search(r"[A-Za-z]\s*$", span)) and digits > 5, span[:1] in "6789", digits in (9, 11, 12), digits in (7, 8),
            max((int(shares[_place(w)]) for w in low_words[1:] if len(w) > 3 and w not in _STOP), default=0) if kind == "DIRECCION" else 0, bool(re.search(r"[\w.\-]$", before)),
        ]
    return out


#: Runs of letters and figures judged by the table of the last call, kept while there are not too many: those that call for nothing, and the others.
_DULL: set[str] = set()
_TELLING: dict[str, tuple[bool, bool, bool, bool]] = {}
_TOLD_BY: list[np.ndarray] = []


def _odd(word: str, shares: np.ndarray) -> bool:
    """Whether a word in lower case may begin a name: a given name, or one that mostly stands in capitals."""
    return len(word) > 2 and (word in _GIVEN or word not in _STOP and bool(shares[_place(word)] < 6))


def _telling(text: str, shares: np.ndarray) -> dict[str, tuple[bool, bool, bool, bool]]:
    """The runs of a text that call for a generator: whether a street, a spelled figure, an odd word or what announces a name in lower case."""
    if not _TOLD_BY or _TOLD_BY[0] is not shares or len(_DULL) + len(_TELLING) > 300_000:
        _DULL.clear()
        _TELLING.clear()
        _TOLD_BY[:] = [shares]
    told = {}
    for w in set(_RUN.findall(text)).difference(_DULL):
        marks = _TELLING.get(w)
        if marks is None:
            low = bool(_LOWERCASE.fullmatch(w))
            marks = bool(_STREET_RUN.match(w)), low and w in _DIGIT_WORDS, low and _odd(w, shares), low and w in _LOWER_CUES
            if not any(marks):
                _DULL.add(w)
                continue
            _TELLING[w] = marks
        told[w] = marks
    return told


def _opens(word: str, shares: np.ndarray) -> bool:
    """Whether a capitalised word may be an ordinary one that only begins a sentence or announces a name."""
    return word not in _GIVEN and word not in BODIES and (word in _STOP or word in _OPENING or shares[_place(word)] >= 3)


def propose(text: str, shares: np.ndarray) -> list[tuple[str, int, int]]:
    """Overlapping candidate spans of every type."""
    out = []
    done = -1
    signed = "@" in text or "＠" in text or "arroba" in text or " AT " in text or "(a" in text or "[a" in text or "{a" in text or " en " in text and _DOTTED.search(text)
    for sign in _SIGN.finditer(text) if signed else ():
        if sign.start() < done:
            continue
        lo = max(0, sign.start() - 70)
        for m in _EMAIL.finditer(text, lo, min(len(text), sign.end() + 110)):
            if m.start() <= sign.start() < m.end() and (m.end() - m.start() > 5 or "@" in m.group()):
                out.append(("EMAIL", m.start(), m.end()))
                done = m.end()
                break
    told = _telling(text, shares)
    street, spelled, odd, cue = map(any, zip(*told.values())) if told else (False,) * 4
    if _FIGURES.search(text):
        for m in _NUMBER.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if 6 <= n <= 20:
                out.append(("TELEFONO", m.start(), m.end()))
        for m in _CODE.finditer(text):
            out.append(("DOCUMENTO", m.start(), m.end()))
    if spelled or any(w in text for w in _DIGIT_CAPITALS):
        for m in _SPELLED.finditer(text):
            out.append(("TELEFONO", m.start(), m.end()))
    for m in _PLACE.finditer(text) if street else ():
        out.append(("DIRECCION", m.start(), m.end()))
    for m in _NAME.finditer(text):
        s = m.start()
        span = m.group()
        out.append(("NOMBRE", s, m.end()))
        # without words that only begin the sentence or announce the name
        at = 0
        begins = not _INSIDE.search(text[max(0, s - 3) : s])
        while (first := _LEAD.match(span, at)) and first.end() < len(span) and (_opens(first.group().split()[0].lower(), shares) or begins and not at):
            at = first.end()
            out.append(("NOMBRE", s + at, m.end()))
        # two names joined, or a name with something else in capitals behind a comma
        for cut in _BETWEEN.finditer(span, at):
            out += [("NOMBRE", s + at, s + cut.start()), ("NOMBRE", s + cut.end(), m.end())]
    # a single name: known, or behind a word that announces one
    for m in _SINGLE.finditer(text):
        low = m.group().lower()
        if low in _GIVEN or len(low) > 2 and low not in _STOP and _announced(text, m.start()):
            out.append(("NOMBRE", m.start(), m.end()))
    if odd or cue:
        out += _lower_names(text, [w for w, marks in told.items() if marks[2]])
    return out


_ANNOUNCING = re.compile(r"(?:(?<!\w)(?<![\d\-º])(?<![\d\-º] )(?:(?:dra?|sra?|srta|d|prof|lic)\.|d\.?ª|doctora?|señor(?:a|ita)?|don|doña|enfermer[oa]|llam[oa]n?|llamad[oa]|soy|nombre|firmado|firma|hij[oa]|herman[oa]|madre|padre|marido|mujer|pareja|paciente)[:,]?)\s+$", re.I)
_LOWER_CUES = {"llamo", "llama", "nombre", "paciente", "firmado"}
_LOWER_ANNOUNCED = re.compile(rf"(?<!\w)(?:me llamo|se llama|nombre:|nombre y apellidos:|paciente:|firmado:|firmado por)\s+(?=[{L}])", re.I)


def _announced(text: str, start: int) -> bool:
    return bool(_ANNOUNCING.search(text[max(0, start - 14) : start]))


def _lower_names(text: str, odd: list[str]) -> list[tuple[str, int, int]]:
    """Names in lower case: a word that is a given name or mostly stands in capitals, or what an announcing phrase
    introduces, with what follows."""
    out = []
    starts = {m.start() for w in odd for m in re.finditer(rf"(?<![\w@.\-/]){w}(?=\s)", text)} | {m.end() for m in _LOWER_ANNOUNCED.finditer(text)}
    for s in sorted(starts):
        m = _LOWER.match(text, s)
        if m and m.group(1) not in _STOP and m.group(2).split()[0] not in _STOP - {"de", "del"}:
            rest = m.group(2).split()
            ends, end = [], m.start(2)
            for w in rest:
                end = text.index(w, end) + len(w)
                if w not in _STOP:
                    ends.append(end)
            out += [("NOMBRE", m.start(), e) for e in ends]
    return out


# Pieces of the sentences the trees are fitted on, of general use, written for this purpose.
BEGIN = {
    "NOMBRE": [
        "Buenos días, soy {}", "Mi nombre es {}", "Me presento: {}", "Se llama {}", "La enferma se llama {}", "Nos deriva a {}", "Acompaña a la consulta {}", "Ha venido {}", "Quien firma es {}", "Lo ha visto {}", "Esta mañana llegó {}", "La tutora legal es {}",
        "Su esposa, {}", "El hijo mayor, {}", "La vecina {}", "El cuidador {}", "El enfermo {}", "La señora {}", "El señor {}", "La doctora {}", "El doctor {}", "El Dr. {}", "La Dra. {}", "D. {}", "Dña. {}", "Don {}", "Doña {}", "Sr. {}", "Sra. {}", "La enfermera {}", "El profesor {}",
        "Nombre y apellidos: {}", "Usuario: {}", "Titular: {}", "A la atención de {}", "Responsable: {}", "Firma: {}", "Fdo.: {}", "Un saludo, {}", "Atentamente, {}", "Paso a describir a {}", "Como indicó {}", "Por orden de {}", "Pregunte a {}", "Entréguelo a {}", "Dígaselo a {}", "Esperamos a {}", "Operaron a {}", "Explicado a {}", "Visto por {}", "Escrito por {}", "Junto a {}", "Sustituye a {}", "Su cuñado {}", "Su abuela {}", "Un familiar, {}", "Vino {}", "Ayer ingresó {}", "Hoy hemos visto a {}", "Contamos con {}", "Cita de {}", "Traslado de {}", "Alta de {}", "Informe de {}", "Resultados de {}", "Con {} todo va bien", "Para {}", "De {}", "Por {}", "A {} le duele", "Respecto a {}", "Pendiente: {}", "Avisaron a {}", "Derivado por {}", "Nota de {}", "Turno de {}", "Viene {}", "Preguntó {}", "Contestó {}", "Sale {}", "Que lo mire {}", "El residente, {}", "Nuestra compañera {}", "Estimado {}", "Querida {}", "Hola, {}", "Habla {}", "Ha fallecido {}", "Reclama {}", "Autorizado por {}", "Escribe {}", "Pregunta {}", "Y {}", "Caso: {}", "{}", "{}", "{}", "{}", "Acompañada de {}", "Ingresado: {}", "La residente {}", "El cirujano, {}", "De parte de {}", "Estuve con {}", "Gracias a {}", "Informa {}", "{}", "{}", "{}",
    ],
    "EMAIL": ["Mándelo por correo a {}", "Su buzón es {}", "Dirección electrónica: {}", "E-mail: {}", "Se le puede localizar en {}", "Respondan, por favor, a {}", "El mensaje salió de {}", "Copia para {}", "{}", "Prefiere que usemos {}", "Cuenta: {}", "De: {}", "Le llega todo a {}"],
    "TELEFONO": ["Su número es {}", "Se le localiza en el {}", "Marque {}", "Teléfono de casa {}", "Tel: {}", "Tlf {}", "Número de contacto: {}", "Hay que llamarle al {}", "El fijo es {}", "Está disponible en {}", "WhatsApp {}", "Móvil {}", "{}", "Que le avisen al {}", "Urgencias familiares: {}", "La centralita es {}"],
    "DOCUMENTO": ["Presenta {}", "Figura con {}", "Su documento es {}", "Identidad: {}", "Identificado con {}", "Comprobado el {}", "Datos del titular: {}", "Titular de {}", "Según {}", "Se verificó {}", "{}", "Falta cotejar {}", "Número anotado: {}", "Registrado como {}"],
    "DIRECCION": ["Su casa está en {}", "Domiciliada en {}", "Tiene su vivienda en {}", "Señas: {}", "Dirección: {}", "Hay que enviarlo a {}", "Se aloja en {}", "La ambulancia lo recogió en {}", "Se trasladó a {}", "Reside en {}", "Vive con su familia en {}", "{}", "Entregar en {}", "Paquete para {}", "Acudiremos a {}", "Vivía antes en {}"],
}
#: What may follow.
END = [
    ".", ".", ".", ".", "", "", ", gracias.", " esta semana.", " y espera respuesta.", ", como siempre.", " (confirmado).", " desde marzo.", " por la mañana.", " si hace falta.", "; consta en su ficha.", " a partir de las {d2} h.", ", según dijo.", " y nada más.", ", de {d2} años.", " en horario de tarde.", " — pendiente.", ", nacido en 19{d2}.", " hasta nuevo aviso.", ", salvo error.",
    " aunque no siempre responde.", " pero conviene comprobarlo.", " o bien en recepción.",
]
#: What may follow a name besides.
NAME_END = [" vino con fiebre.", " refirió mareos.", " solicita un justificante.", " no pudo venir.", ", madre de la niña, lo autorizó.", " ingresó el martes.", " toma la medicación.", " quiere cambiar la hora.", " está mejor.", " dejó el tratamiento hace {d1} meses.", " presentaba tos.", ", que trabaja de noche, consulta por insomnio.", " ha dado su permiso.", " y su hermano esperan fuera.", " dice que duerme mal.", " tiene {d2} años.", " recibió la vacuna.", " se encuentra mejor.", " se cayó ayer.", " se queja de dolor.", " no se presentó.", " se marchó al pueblo.", " le acompaña hoy.", " (cama {d2}).", " (hijo).", " ha llegado tarde.", " es alérgico a {W}.", " con fiebre de {d2}.", " por la tarde.", " desde el lunes.", " en la sala {d1}.", " sobre su dieta.", " o su madre.", " llamará mañana.", " fue dado de alta.", ", tras la operación, camina bien."]
#: What may stand beside a name.
BESIDE = [" ({TELEFONO})", " ({DOCUMENTO})", ", {DOCUMENTO},", ", con {DOCUMENTO},", " <{EMAIL}>", " / {TELEFONO}", "; {DOCUMENTO}", " | {EMAIL}", " ({EMAIL})", ", {TELEFONO}", " - {DOCUMENTO}"]
MIXED = [
    "{NOMBRE}, {DOCUMENTO}", "{NOMBRE}; {TELEFONO}", "{NOMBRE} - {EMAIL}", "{NOMBRE} <{EMAIL}>", "{NOMBRE} ({DOCUMENTO}) reside en {DIRECCION}", "Ficha: {NOMBRE} / {DOCUMENTO} / {TELEFONO}", "{DOCUMENTO} | {DIRECCION}", "{DIRECCION}. {TELEFONO}", "Localizar a {NOMBRE} en {TELEFONO} o {EMAIL}", "{NOMBRE}, {DIRECCION}", "{TELEFONO} ({NOMBRE})",
    "Titular {NOMBRE} con {DOCUMENTO}", "{NOMBRE} vive ahora en {DIRECCION}", "{EMAIL}, {TELEFONO}", "{NOMBRE} y {NOMBRE} comparten piso en {DIRECCION}", "Entre {NOMBRE} y {NOMBRE} lo cuidan", "Responsable: {NOMBRE} | {TELEFONO}",
]
OTHERS = [
    # numbers and codes that belong to nobody
    "El lote {d9} caduca en 20{d2}.", "Cepa número {d8} conservada.", "Partida {d6} retirada.", "Modelo {d7} del aparato.", "Norma {d3}/20{d2}.", "Expedición {d8}.", "Código nacional {d6}.", "Concepto {d9} del vocabulario.", "Identificador de producto {d8}.", "Número de serie {d10}.", "EudraCT 20{d2}-{d6}-{d2}.", "NCT{d8} terminó antes.", "PMID {d8}.", "doi 10.{d4}/{d6}.", "Secuencia MN{d6} depositada.", "Muestra T{d6} congelada.", "ISSN {d4}-{d4}.", "Se contaron {d6} células.", "{d3}.{d3} copias por mililitro.", "Entre {d4} y {d4} casos.", "Coste de {d2}.{d3} euros.", "El {d2}/{d2}/20{d2} se revisó.", "El pedido {d9} llegó tarde.", "Albarán {d8}.", "Carga viral {d5} copias/ml.", "Periodo 20{d2}-20{d2}.", "Nota {d2}-{d3}-{d3} del archivo.", "Valor de {d3} {d3} unidades.", "Registro sanitario {d2}.{d3}.", "Versión {d1}.{d2}.{d3}.", "ISBN {d3}-{d2}-{d5}-{d1}.", "Versión del documento {d2}.", "Trial {d8} was stopped.", "Referencia {d7}-{d2}.", "Código C{d7}.", "Escala: cinco, siete y tres puntos.", "Repita dos, tres o cuatro veces.",
    # words of addresses without an address
    "Salió a la calle sin abrigo.", "La plaza quedó vacante.", "Un paseo corto cada tarde.", "Por vía subcutánea {d2} mg.", "Vía venosa {d1} de calibre.", "El camino de la recuperación es largo.", "Trabaja en la carretera.", "El barrio mejoró su cobertura.", "Una ronda de preguntas a las {d2}.", "Ronda clínica {d1}.", "La avenida de tratamientos está abierta.", "Vive solo y en la calle no conoce a nadie.", "La vía aérea está libre.", "En la plaza de guardia hay {d1} médicos.", "Vía oral, {d1} dosis.", "Paseo de {d2} minutos.", "Camino asistencial {d2} revisado.", "Ocupa una plaza de interino desde hace {d1} años.", "Hay plazas: la plaza de adjunto de {d2} horas.", "Caminó calle abajo {d2} metros.", "Un camino de {d2} km.", "Ronda de preguntas de {d2} minutos.", "La carretera de {d1} carriles.", "Bulevar, paseo o camino: {d1} opciones.", "Plaza de internista de {d2} años.", "Vía de acceso de {d1} cm.", "Un paseo lento de {d2} minutos.", "Caminos largos: camino nuevo de {d2} km.", "Vía distinta de {d2} meses.", "Ronda larga de {d2} horas.",
    # talk about a type without a value
    "El teléfono no consta.", "No dejó correo.", "Correo sin confirmar: falta@", "Mencione a @equipo en el chat.", "{d3} mg @ {d1} h.", "Faltan el DNI y la firma.", "El pasaporte está caducado.", "La historia clínica no se encuentra.", "Sin domicilio conocido.", "Su nombre no figura.", "Firma y sello.", "El paciente prefiere no decir su nombre.", "[NOMBRE] no acudió.", "Enviar a [EMAIL] o a [TELEFONO].", "Vive en [DIRECCION].", "La señora no recuerda el nombre.", "Pesa {d2} kg, una arroba menos.", "Nombre comercial: {W}.", "Se llama así al síndrome.", "Según el informe, todo sigue igual.", "Le atiende el médico de siempre.",
    # capitals that are no persons
    "El Ministerio de Sanidad lo aprobó.", "La Agencia Europea de Medicamentos lo evaluó.", "La Sociedad Española de Cardiología lo aconseja.", "Según la Guía Clínica de Asma, basta.", "El Hospital Universitario lo confirma.", "El Instituto Nacional publicó datos.", "El Comité de Ética dio su visto bueno.", "La Unión Europea lo financia.", "Plan Nacional de Vacunación.", "Ley General de Sanidad.", "Servicio de Medicina Interna.", "Unidad de Cuidados Intensivos.", "Universidad de Salamanca.", "World Health Organization guidance.", "National Institute of Health data.", "The Study Group reported harm.", "Enfermedad de Crohn activa.", "Síndrome de Down conocido.", "Escala de Glasgow de {d2}.", "Índice de Barthel {d2}.", "Prueba de Mantoux negativa.", "Test de Student.", "Método Kaplan-Meier.", "Virus de Epstein-Barr.", "Ritmo de Cheyne-Stokes.", "Maniobra de Valsalva.", "Enfermedad de Parkinson.", "Programa de Atención Primaria.", "En Navidad y Semana Santa.", "Lunes, Martes y Jueves.", "Madrid, Sevilla y Valencia.", "En América Latina hay brotes.", "Reino Unido y Estados Unidos.",
    "Pautaron {W} y {W}.", "{W}/{W} en un comprimido.", "{W} frente a {W}.", "Creció {O} en el hemocultivo.", "Aislamos {O}.", "{O} es resistente a {w}.", "Brote de {O} en {d2} salas.", "El fármaco {W} interactúa con {W}.", "Infección por {O}, sin fiebre.", "{W} Forte cada {d2} h.", "Colonización por {O} en orina.", "Vacuna contra {O}.", "Infection with {O} was rare.", "La cepa de {O} se envió.", "Se detecta {O} y {O}.", "Sensibilidad a {W}, {W} y {w}.", "¿Cubre {W} a {O}?", "{W} Plus Retard.", "Alergia a {W}.", "The Lancet published it.", "Randomised Controlled Trial of {W}.", "Results Were Not Significant.", "TARV CON INI DE PRIMERA LÍNEA", "RECOMENDACIONES GENERALES", "TABLA DE DOSIS", "CONCLUSIONES Y RESUMEN", "Resumen y Conclusiones.", "Tabla Segunda.", "Anexo Tercero.", "NOTA INFORMATIVA", "Introducción y Objetivos.", "Grado B, Nivel II.", "Clase A de Child-Pugh.", "Tipo I.", "PCR y VSG altas.", "VIH, VHB y VHC.", "CD{d1} bajos.", "Dosis de {W}: {d3} mg.", "Pregunta: ¿cuánto dura?", "Respuesta: depende.", "Ojo: revisar.", "Plan: alta.", "Motivo: Fiebre.", "Diagnóstico: Neumonía.", "Alergias: Penicilina.", "Atención: Riesgo alto.", "La paciente Vino tarde.", "Hoy Martes no hay consulta.", "El Dr. Hoy no pasa visita.", "Preguntó la Sra. Llame después.", "Lo vio la Dra. Queda pendiente.", "Habló con el Sr. Mañana vuelve.", "Llegado el momento, se verá.", "En resumen: Dado el riesgo, se espera.", "Aviso: Tomada la decisión, no hay vuelta.", "Nota: Visto el caso, se cierra.",
    # common sentences
    "Come bien y duerme poco.", "Necesita reposo.", "La dosis se ajusta según el peso.", "Tiene dolores desde hace {d1} días.", "El consuelo llegó tarde.", "Sin dolores musculares ni fiebre.", "El pilar básico del manejo es el agua.", "Es un pilar clave.", "Ante dolores lumbares fuertes, reposo.", "Toma rosa mosqueta.", "Con dolores leves atribuibles al esfuerzo.", "Una luz clara marcada.", "Salvador de vidas, dicen.", "El ángel caído de la sala.", "Los pilares del tratamiento son tres.", "El mar abierto le calma.", "Da clara señal de alarma.", "Sufre dolores agudos al andar.", "Eran dolores previos al parto.", "Lleva rosa la piel del brazo.", "La alegría le duró poco.", "Mañana le haremos una analítica.", "Refiere cansancio, tos y fiebre.", "Mejoró tras {d2} días.", "No hay alergias.", "Pide explicaciones sobre la vacuna.", "¿Hay riesgo si toma {w}?", "The patient improved after {d2} days.", "There was no difference.", "Conviene vigilar el riñón.", "Se suspende {w} y se inicia {w}.", "Los resultados salieron bien.",
]


class _Maker:
    """Sentences of pieces and invented values in many spellings."""

    def __init__(self, seed: int, shares: np.ndarray | None = None):
        self.r = random.Random(seed)
        #: names and substances that come again and again, as in a collection
        self.names = [self.new_stem() for _ in range(900)]
        self.words = [self.new_word() for _ in range(300)]
        self.shares = (np.zeros(CASES, np.uint8) if shares is None else shares).copy()
        for words, levels in ((self.names, [0, 0, 0, 1, 2, 3, 4, 5, 10]), (self.words, [8, 9, 10, 10])):
            for w in words:
                self.shares[_place(w.lower())] = self.r.choice(levels)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def stem(self) -> str:
        return self.r.choice(self.names)

    def word(self) -> str:
        return self.r.choice(self.words)

    def new_stem(self) -> str:
        """A word that might be a family name anywhere: two to four syllables, sometimes with an ending of some language."""
        r = self.r
        onset, nucleus, coda = "b br c ch cr d f g gr h j k l m n p pr qu r s sh t tr v w y z zh".split(), "a e i o u a e i o ia ue ei au é á í ó".split(), ["", "", "", "", "", "n", "l", "r", "s", "z", "nd", "ng", "m"]
        word = "".join((r.choice(onset) if i or r.random() < 0.85 else "") + r.choice(nucleus) + r.choice(coda) for i in range(r.choice([1, 2, 2, 2, 3])))
        word = word.replace("que", "que").replace("qua", "cua").replace("quo", "co").replace("quu", "qui")
        if r.random() < 0.25:
            word += r.choice("ez az iz oz eda ero ano ales ares escu ski sson sen ova ov ian egui eta berri ides enko ado ino uk".split())
        return (word if len(word) > 2 else word + "ra").capitalize()

    def given(self) -> str:
        """A given name: a quarter of them from the list, the others in no list."""
        return self.r.choice(GIVEN) if self.r.random() < 0.25 else self.stem()

    def new_word(self) -> str:
        return "".join(self.r.choice("bcdfglmnprstvxz") + self.r.choice("aeiou") for _ in range(self.r.choice([2, 3, 4]))) + self.r.choice(["vir", "tina", "mab", "pril", "xol", "micina", "zol", "statina", "lol", ""])

    def organism(self) -> str:
        r = self.r
        low = str.lower if r.random() < 0.15 else str
        base = ("".join(r.choice("bcdfglmnprstvxz") + r.choice("aeiou") for _ in range(r.choice([2, 3, 4])))).capitalize()
        return low(base) + r.choice(["ium ", "virus ", "coccus ", "coco ", "ella ", "bacter ", "myces ", "ia ", "monas ", "us "]) + r.choice(["", "".join(r.choice("bcdfglmnprstvxz") + r.choice("aeiou") for _ in range(3))]) + r.choice(["", "us", "is", "ensis", "ans", "humano", "a"])

    def name(self) -> str:
        r, a, b = self.r, self.stem(), self.stem()
        first = self.given()
        s = r.choice([f"{first} {a}", f"{first} {a}", f"{first} {a} {b}", f"{first} {a} {b}", f"{first} {self.given()} {a}", f"{first} {a}-{b}", f"{first} de la {a}", f"{a} {b}, {first}", f"{first[0]}. {a}", f"{first[0]}. {a} {b}", f"{first} {a[0]}. {b}", f"{a}, {first}", f"{first} del {a}", f"{first} de los {a}", f"{first} {a} y {b}", f"{first} de {a}"])
        k = r.random()
        return s.upper() if k < 0.1 else s.lower() if k < 0.25 and s.split()[0] == first and all(self.shares[_place(w)] < 6 for w in _LETTERS.findall(s.lower()) if len(w) > 3) else s

    def email(self) -> str:
        r = self.r
        user = f"{self.given()}{r.choice(['', '.', '_', '-'])}{self.stem()}{r.choice(['', self.digits(2), '+citas'])}".lower()
        host, end = r.choice(["correo", "mail", "post", "hospital-sur", "consulta", "web", self.stem().lower()]), r.choice([["example"], ["example", "com"], ["test"], ["invalid"], ["example", "org"], ["es"], ["example", "net"]])
        dom, spoken = ".".join([host, *end]), " punto ".join([host, *end])
        k = r.randrange(10)
        return [f"{user}@{dom}", f"{user} @ {dom}", f"{user} (arroba) {spoken}", f"{user}[at]{dom}", f"<{user}@{dom}>", f"mailto:{user}@{dom}", f"{user}@{dom}".upper(), f"{user}＠{dom}", f"{user} AT {' DOT '.join([host, *end])}", f"{user} en {dom}"][k]

    def phone(self) -> str:
        r, d = self.r, self.digits
        a, b, c, e = r.choice("56789") + d(2), d(3), d(3), d(2)
        n = a + b + c
        sep = r.choice(" .·-")
        spelled = " ".join("cero uno dos tres cuatro cinco seis siete ocho nueve".split()[int(x)] for x in n)
        return r.choice([n, f"{a}{sep}{b}{sep}{c}", f"{a} {d(2)} {d(2)} {e}", f"+34 {a} {b} {c}", f"+34{n}", f"0034{n}", f"(+34) {a}-{b}-{c}", f"({a}) {b} {c} ext. {d(3)}", f"{d(3)} {d(2)} {d(2)} (prefijo {a})", f"{a}/{b}{c}", " ".join(n), spelled, f"+{d(3)} {d(2)} {d(6)}", f"{n[:2]} {n[2:5]} {n[5:7]} {n[7:]}"])

    def document(self) -> str:
        r, d = self.r, self.digits
        l = r.choice("ABCDEFGHJKLMNPQRSTVWXYZ")
        n = d(8)
        return r.choice([f"DNI {n}{l}", f"{n}-{l}", f"dni: {n} {l.lower()}", f"NIF {n}{l}", f"NIE {r.choice('XYZ')}{d(7)}{l}", f"{r.choice('XYZ')}-{d(7)}-{l}", f"pasaporte {l}{r.choice('ABQZ')}{r.choice('AKLZ')}{d(6)}", f"NHC {d(7)}", f"historia n.º {d(7)}", f"historia clínica {d(7)}", f"afiliación {d(2)}/{n}/{d(2)}", f"n.º de la Seguridad Social {d(2)}/{n}/{d(2)}", f"{n}{l}", f"{n[:2]}.{n[2:5]}.{n[5:]}-{l}", f"tarjeta sanitaria {d(10)}", f"nº de historia {d(7)}"])

    def place(self) -> str:
        r, d = self.r, self.digits
        kind = r.choice("calle,C/,c/,Avda.,Avenida,Plaza,Pza.,Paseo,P.º,Camino,Ctra.,Carretera,Rúa,Ronda,Travesía,Calle".split(","))
        mid = r.choice(["", "de los ", "del ", "de la ", "Doctor ", ""])
        n, town = str(r.randint(1, 140)), r.choice(["", "", "Santa ", "Villa"]) + self.stem()
        s = f"{kind} {mid}{self.stem()}{r.choice(['', 's'])}" + r.choice([f", {n}", f" {n} esc. 2 pta. {d(1)}", f", {n}, {d(5)} {town}", f" n.º {n}, {town}", f" s/n, {town}", f" {n} BAJO", f", {n}, 5.º B", f" n.º {n}", f" {n}"])
        k = r.random()
        return s.upper() if k < 0.15 else s.lower() if k < 0.25 else s

    def fill(self, kind: str) -> str:
        return {"NOMBRE": self.name, "EMAIL": self.email, "TELEFONO": self.phone, "DOCUMENTO": self.document, "DIRECCION": self.place}[kind]()

    def plain(self, s: str) -> str:
        return re.sub(r"\{(?:d(\d+)|(w)|(W)|(O))\}", lambda m: self.digits(int(m[1])) if m[1] else self.word() if m[2] else self.word().capitalize() if m[3] else self.organism(), s)

    def sentence(self) -> tuple[str, list[tuple[str, int, int]]]:
        """A sentence and its true spans."""
        r = self.r
        k = r.random()
        if k < 0.35:
            return self.plain(r.choice(OTHERS)), []
        if k < 0.8:
            kind = r.choice([*TYPES, "NOMBRE", "NOMBRE", "NOMBRE"])
            more = r.choice(BESIDE) if kind == "NOMBRE" and r.random() < 0.35 else ""
            frame = r.choice(BEGIN[kind]).replace("{}", "{" + kind + "}") + more + r.choice(NAME_END if kind == "NOMBRE" and r.random() < 0.5 else END)
        else:
            frame = r.choice(MIXED) + r.choice(END)
        if r.random() < 0.1:
            frame = r.choice(["(", "- ", "* ", "\""]) + frame
        frame = self.plain(frame)
        s, spans, at = "", [], 0
        for m in re.finditer(r"\{([A-Z]+)\}", frame):
            s += frame[at : m.start()]
            value = self.fill(m[1])
            # titles and other announcing words alone introduce a family name
            if m[1] == "NOMBRE" and _announced(s, len(s)) and r.random() < 0.3:
                value = self.stem()
            spans.append((m[1], len(s), len(s) + len(value)))
            s += value
            at = m.end()
        return s + frame[at:], spans


def _agree(kind: str, a: int, b: int, x: int, y: int) -> bool:
    """Whether a proposed span counts as the true one in fitting."""
    both = min(b, y) - max(a, x)
    if kind == "NOMBRE":
        return a == x and both >= 0.7 * (y - x) and b <= y
    if kind == "DOCUMENTO":
        return both >= 0.55 * (b - a)
    return both >= 0.55 * (b - a) and both >= 0.6 * (y - x)


def fit(sample: int = SAMPLE, seed: int = 11, shares: np.ndarray | None = None) -> dict[str, Boosted]:
    """Trees per type, fitted on at most ``sample`` candidates of the type; ``shares``: table of ``case_shares``."""
    shares = np.zeros(CASES, np.uint8) if shares is None else shares
    maker = _Maker(seed, shares)
    shares = maker.shares
    rows: dict[str, list] = {k: [] for k in TYPES}
    marks: dict[str, list] = {k: [] for k in TYPES}
    wanted = {k: 4 * sample if k == "NOMBRE" else sample for k in TYPES}
    for _ in range(4 * sample):
        parts = [maker.sentence() for _ in range(maker.r.randint(1, 3))]
        text, truth = "", []
        for s, spans in parts:
            if text:
                text += " "
            truth += [(k, a + len(text), b + len(text)) for k, a, b in spans]
            text += s
        for kind, a, b in propose(text, shares):
            if len(rows[kind]) < wanted[kind]:
                inside = any((k in ("EMAIL", "DIRECCION")) and k != kind and a >= x and b <= y for k, x, y in truth)
                # parts of addresses, e-mails and names are settled by the wider span and not judged as names
                if kind == "NOMBRE" and (inside or any(k == kind and x <= a and b <= y and not _agree(kind, a, b, x, y) for k, x, y in truth)):
                    continue
                # a document's words (DNI, pasaporte) are no part of what is judged
                good = not inside and any(k == kind and _agree(kind, a, b, x, y) for k, x, y in truth)
                rows[kind].append(features(kind, text, a, b, shares))
                marks[kind].append(good)
        if all(len(rows[k]) >= wanted[k] for k in TYPES):
            break
    return {k: Boosted(rounds=110, depth=4, l2=5.0, beta=2.5).fit(np.array(rows[k], float), np.array(marks[k])) if k == "NOMBRE" else Boosted(rounds=30).fit(np.array(rows[k], float), np.array(marks[k])) for k in TYPES}


def find(texts: list[str], model: dict[str, Boosted], shares: np.ndarray | None = None) -> list[list[tuple[str, int, int]]]:
    """Chosen spans of each text, not overlapping, in order."""
    shares = np.zeros(CASES, np.uint8) if shares is None else shares
    where: dict[str, list] = {k: [] for k in TYPES}
    rows: dict[str, list] = {k: [] for k in TYPES}
    for i, text in enumerate(texts):
        for kind, a, b in propose(text, shares):
            where[kind].append((i, a, b))
            rows[kind].append(features(kind, text, a, b, shares))
    chosen: dict[int, list] = {}
    for rank, kind in enumerate(TYPES):
        if rows[kind]:
            p = model[kind].predict(np.array(rows[kind], float))
            for (i, a, b), q in zip(where[kind], p):
                if q >= model[kind].threshold:
                    chosen.setdefault(i, []).append((rank, -q, a, b, kind))
    out = [[] for _ in texts]
    for i, spans in chosen.items():
        # addresses and e-mails first; numbers by probability; names last, the longest first
        taken: list[tuple[int, int, str]] = []
        for rank, q, a, b, kind in sorted(spans, key=lambda s: (s[0] if s[0] < 2 else 4 if s[4] == "NOMBRE" else 2, s[2] - s[3] if s[4] == "NOMBRE" else s[1], s[1], s[2] - s[3])):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
        out[i] = [(k, a, b) for a, b, k in sorted(taken)]
    return out


def _trim(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in " ,;:\n":
        b -= 1
    return a, b


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        a, b = _trim(text, kind, a, b)
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, text: str, keys: list[str], sample: int = SAMPLE) -> DataFrame:
    """Rows (keys, kinds array, redacted) of every row with a non-null text; kinds are the distinct types found, sorted.

    Empty texts have no kinds; an existing placeholder in brackets stays; everything outside the spans stays as it is.
    Repeated rows give repeated rows; other columns are dropped. A first pass over all texts counts words in lower case.
    """
    rows = df.select(*keys, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    shares = case_shares(rows, "__text")
    model = fit(sample, shares=shares)
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            texts = batch["__text"].tolist()
            found = find(texts, model, shares)
            out = batch[keys].copy()
            out["kinds"] = [sorted({k for k, _, _ in spans}) for spans in found]
            out["redacted"] = [redact_text(t, s) if s else t for t, s in zip(texts, found)]
            yield out

    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", kinds array<string>, redacted string")
