"""Text functions as Catalyst expressions: everything here stays in generated JVM code, except the two marked otherwise.

Null texts give null (or an empty array where stated); nothing here depends on row order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Letters with marks and their bases, in the Latin-1 range.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
BASES = "aaaaaaeeeeiiiiooooouuuuncyy"

# Words without meaning for retrieval.
STOP_WORDS = (
    "el la los las un una unos unas de del en y o a que con por para se su sus al es si como le lo mi tiene puede debe cual cuales tengo soy ante tras sobre entre cuando donde porque este esta estos estas ese esa hay ser son the of cuanto cuanta deben pueden qué cuál más muy ya"
).split()
# Words without meaning for the conversation memory.
MEMORY_STOP_WORDS = "el la los las un una de del en y o a que con por para se su al es si como le lo mi tiene puede debe cual cuales tengo soy".split()
# Endings cut from long words.
ENDINGS = ["ciones", "cion", "mente", "idades", "idad", "es", "as", "os", "s"]
# Drugs and classes, matched as whole words with case.
DRUGS = "DTG BIC RAL EVG CAB dolutegravir bictegravir raltegravir cabotegravir elvitegravir TAF TDF FTC 3TC ABC tenofovir emtricitabina lamivudina abacavir DRV ATV darunavir atazanavir RPV DOR EFV NVP rilpivirina doravirina efavirenz nevirapina rifampicina rifabutina cobicistat ritonavir".split()
# Conditions, matched as substrings without case.
CONDITIONS = ["insuficiencia renal", "tuberculosis", "embarazo", "hepatitis B", "VHB", "VHC", "fracaso virologico", "carga viral", "resistencia", "neurocognitivo", "HAND", "riesgo cardiovascular", "sindrome metabolico", "VIH-2", "infeccion aguda", "comorbilidad", "polifarmacia", "adherencia"]
# Patterns, in the Java dialect.
THRESHOLD = r"(?iu)(?:FG|filtrado glomerular|aclaramiento|CD4|carga viral|copias|HLA-B\*?5701)[^.\n]{0,40}?(?:[<>≥≤]=?\s*\d+|\d+\s*(?:mL/min|copias|c[eé]lulas))"
EVIDENCE = r"(?U)\b(A|B|C)-?(I|II|III)\b"
GRADE_PARENTHESIS = r"\(\s*([ABC])\s*[-–]?\s*(I{1,3})\s*\)"
GRADE_DASH = r"(?U)\b([ABC])\s*[-–]\s*(I{1,3})\b"
DEONTIC = [
    ("generalmente_no_recomendado", r"(?iu)(?:generalmente|en general|de forma (?:general|rutinaria|sistematica))\s+no\s+se\s+recomienda|no\s+se\s+recomienda\s+(?:de\s+forma\s+)?(?:general|rutinaria|sistematica)"),
    ("no_recomendado", r"(?iuU)\bno\s+(?:se\s+)?(?:recomienda|recomiendan|aconseja|debe[n]?|deberia[n]?)\b|\bdebe[n]?\s+evitarse\b|\bse\s+desaconseja\b|\bcontraindicad[oa]s?\b|\bevitar(?:se)?\s+(?:el|la|los|las)\b|\bno\s+esta[n]?\s+recomendad[oa]s?\b"),
    ("considerar", r"(?iuU)\b(?:puede[n]?\s+(?:considerarse|valorarse|utilizarse|emplearse|usarse)|se\s+(?:puede[n]?\s+considerar|sugiere|podria)|considerar|valorar|podria[n]?\s+(?:utilizarse|emplearse|usarse|considerarse)|es\s+razonable|opcional(?:mente)?)\b"),
    ("recomendado", r"(?iuU)\b(?:se\s+recomienda[n]?|esta[n]?\s+recomendad[oa]s?|recomendamos|se\s+debe[n]?|debe[n]?[ra]?[n]?\b|es\s+(?:necesario|preciso|obligad[oa])|se\s+aconseja[n]?|hay\s+que)\b"),
]
SCRUB = [
    ("EMAIL", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("TELEFONO", r"(?U)\b(?:\+34[\s-]?)?(?:\d[\s-]?){9}\b"),
    ("DNI", r"(?U)\b\d{8}[- ]?[A-Za-z]\b"),
    ("NIE", r"(?U)\b[XYZxyz][- ]?\d{7}[- ]?[A-Za-z]\b"),
    ("NHC", r"(?iuU)\b(?:NHC|n[ºo]?\.?\s*historia|historia\s*cl[ií]nica)\D{0,3}\d{4,}\b"),
    ("FECHA", r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("FECHA", r"(?iuU)\b\d{1,2}\s+de\s+[a-záéíóú]+\s+de\s+\d{4}\b"),
    ("CENTRO", r"(?iuU)\b(?:Hospital|Centro de Salud|Cl[ií]nica|Ambulatorio|Albergue|M[oó]dulo)\s+[A-ZÁÉÍÓÚ][\w.\-]*"),
]
RISKS = [
    ("localidad muy pequena", r"(?iuU)\b(?:pueblo|aldea|localidad|barrio)\b.{0,40}?\b\d{2,4}\s*habitantes\b"),
    ("unicidad del paciente/caso", r"(?iuU)\b[uú]nic[oa]\s+(?:paciente|caso)\b"),
    ("notoriedad publica", r"(?iuU)\b(?:muy conocido|deportista profesional|accidente medi[aá]tico|liga\s+\w+)\b"),
    ("fecha/anio concreto", r"(?U)\b(19|20)\d{2}\b"),
]
SERIOUS = r"(?iuU)\b(cambiar?|cambio|fracaso|simplificar|suspender|switch)\b"
NUMERIC = r"(?iuU)\b(fg|filtrado|aclaramiento|cd4|carga viral|copias|72\s*h)\b"
PATIENT = r"(?iuU)\b(mi |soy |tengo |mi paciente|un paciente|este paciente|llevo )\b"
SEVERAL = r"(?iuU)\b(tb|tuberculosis|embarazo|rifampicina|vacuna|hepatitis)\b"
ROLE = r"(director|screenwriter|performer|composer|producer|editor|star|cast member|author|writer)"
KINSHIP = r"\b(grand(father|mother|parent|son|daughter)|in-law|great-|uncle|aunt|sibling|maternal|paternal)\b"
ADVISES = r"(?iuU)\b(se\s+recomienda|recomendad[oa]s?|de\s+elecci[oó]n|preferente|pauta\s+recomendada|debe\s+(?:iniciarse|usarse|emplearse))\b"
DENIES = r"(?iuU)\b(no|nunca|evitar|desaconsej|contraindicad)\w*"
FIGURE = r"(?iuU)\b(\d{1,4}(?:[.,]\d{1,2})?)\s*(?:ml/min|mg|copias|c[eé]l|cel/μl|/mm3|mm3|%|semanas?|horas?|h\b)"


def fold(x: Column) -> Column:
    """Lower case without marks (Latin-1 letters)."""
    return F.translate(F.lower(x), ACCENTED, BASES)


@F.pandas_udf(StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """Lower case without any combining mark, over all of Unicode; an Arrow function, for other scripts than Latin-1."""
    import unicodedata

    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)))


def tokens(x: Column) -> Column:
    """Runs of a-z and digits of the folded text."""
    return F.regexp_extract_all(fold(x), F.lit("([a-z0-9]+)"), F.lit(1))


def stem(t: Column) -> Column:
    """Without the first ending that leaves four letters; short words and words with digits stay."""
    return F.when((F.length(t) > 4) & ~t.rlike("[0-9]"), F.regexp_replace(t, f"^(.{{4,}}?)(?:{'|'.join(ENDINGS)})$", "$1")).otherwise(t)


def analyze(x: Column) -> Column:
    """Stems of the tokens that are longer than a letter and no stop words, in order, repeats included."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.transform(F.filter(tokens(x), lambda t: (F.length(t) > 1) & ~F.array_contains(stops, t)), stem)


def words(x: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)(\w+)"), F.lit(1))


def memory_tokens(x: Column) -> Column:
    """Distinct tokens of three letters and more without stop words, marks kept."""
    stops = F.array(*[F.lit(w) for w in MEMORY_STOP_WORDS])
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-záéíóúüñ0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~F.array_contains(stops, t)))


def sentences(x: Column, least: int = 40) -> Column:
    """Normative sentences: cut after full stop or semicolon before a capital, of at least ``least`` characters."""
    return F.filter(F.transform(F.split(x, r"(?<=[.;])\s+(?=[A-ZÁÉÍÓÚÑ¿(])"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def loose_sentences(x: Column) -> Column:
    return F.split(x, r"(?<=[.;:])\s+")


def drugs(x: Column) -> Column:
    """Sorted distinct drugs named in the text, with case, as whole words."""
    found = F.regexp_extract_all(x, F.lit("(?U)\\b(" + "|".join(DRUGS) + ")\\b"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def conditions(x: Column) -> Column:
    low = F.lower(x)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(c.lower())), F.lit(c)) for c in sorted(CONDITIONS)]), lambda c: c.isNotNull())


def thresholds(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(THRESHOLD), F.lit(0)), lambda t: F.trim(t))))


def evidence_level(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, EVIDENCE, 0), F.lit(""))


def grade(x: Column) -> Column:
    """Normalised evidence grade such as A-II, whichever of the two spellings comes first."""
    a, b = F.regexp_extract(x, GRADE_PARENTHESIS, 0), F.regexp_extract(x, GRADE_DASH, 0)
    first = F.when((a != "") & ((b == "") | (F.position(a, x) <= F.position(b, x))), a).otherwise(b)
    return F.when(first != "", F.concat_ws("-", F.regexp_extract(first, "([ABC])", 1), F.regexp_extract(first, "(I{1,3})", 1)))


def deontic(x: Column) -> Column:
    """Class of a normative sentence; negative forms are looked for first."""
    out = F
    for name, pattern in DEONTIC:
        out = out.when(x.rlike(pattern), name)
    return out.otherwise("sin_determinar")


def is_heading(text: Column, size: Column, body: Column) -> Column:
    """Numbered line, or type clearly larger than the body's, of less than 120 characters."""
    return (F.length(text) < 120) & (text.rlike(r"^\s*\d{1,2}(\.\d{1,2}){0,3}[.)]?\s+\S") | (size >= 1.15 * body))


def is_table(text: Column) -> Column:
    digits = F.regexp_count(text, F.lit("[0-9]"))
    return (digits >= 8) & (F.contains(text, F.lit("|")) | (F.regexp_count(text, F.lit("  ")) >= 3) | (digits / F.greatest(F.length(text), F.lit(1)) > 0.12))


def scrub(x: Column) -> tuple[Column, Column, Column]:
    """Text with direct identifiers replaced, how many there were, and their sorted types; patterns apply one after the other."""
    count, kinds = F.lit(0), []
    for name, pattern in SCRUB:
        n = F.regexp_count(x, F.lit(pattern))
        count, x = count + n, F.regexp_replace(x, pattern, f"[{name}]")
        kinds.append(F.when(n > 0, F.lit(name)))
    return x, count, F.array_sort(F.array_distinct(F.filter(F.array(*kinds), lambda k: k.isNotNull())))


def risk(x: Column) -> tuple[Column, Column]:
    """Re-identification risk of the original text, and its reasons."""
    reasons = F.filter(F.array(*[F.when(x.rlike(p), F.lit(n)) for n, p in RISKS]), lambda r: r.isNotNull())
    return F.when(F.size(reasons) >= 2, "alto").when(F.size(reasons) == 1, "medio").otherwise("bajo"), reasons


def question_type(x: Column) -> Column:
    q = F.lower(x)
    return (
        F.when(q.rlike(r"\b(or|both)\b") & q.rlike(ROLE) & q.rlike(r"\b(film|movie|book|novel|song|album)s?\b"), "bridge_comparison")
        .when(q.rlike(r"\b(are both|do both|were both|which .{0,60}(first|earlier|later|more|older|younger|longer)|same (country|nationality|year|place))\b") | F.contains(q, F.lit(" or ")), "comparison")
        .when(q.rlike(KINSHIP), "inference")
        .otherwise("compositional")
    )


def route(x: Column) -> dict[str, Column]:
    """Heuristic routing of a question."""
    several = F.contains(F.lower(x), F.lit(" y ")) | x.rlike(SEVERAL)
    return {
        "tipo_consulta": F.when(x.rlike(PATIENT), "paciente").otherwise("general"),
        "nivel": F.when(several, 3).otherwise(1),
        "multi_aspecto": several,
        "logica_numerica": x.rlike(NUMERIC),
        "decision_seria": x.rlike(SERIOUS),
        "estrategia": F.when(several, "paralela").otherwise("vectorial"),
    }


def shortened(x: Column, n: int = 60) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…"))).otherwise(x)


def truth(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("si", "sí", "true", "1", "x")


def level(x: Column) -> Column:
    return F.regexp_extract(x, r"(?i)nivel\s*(\d)", 1).try_cast("int")


def file_safe(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^\w\-]", "")


def section_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^\s*(\d{1,2}(?:\.\d{1,2}){0,3})", 1), F.lit(""))


@F.pandas_udf(StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """Capital after every character that is no letter; an Arrow function, since initcap looks at blanks only."""
    return texts.map(lambda t: None if t is None else t.title())


CLASS_QUESTION = r"(?iuU)\b(clase|clases|grupo|grupos|familia|todos los|todas las|cu[aá]les son los|qu[eé] f[aá]rmacos|inhibidores)\b"


def is_class_question(x: Column) -> Column:
    """Whether a question asks for a class of things rather than one."""
    return x.rlike(CLASS_QUESTION)


def split_labels(x: Column, codes: dict[str, str], separator: str = r"\+") -> Column:
    """Codes of the labels of a text such as ``A + B``; unknown labels are left out."""
    table = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
    return F.filter(F.transform(F.split(x, separator), lambda s: F.element_at(table, F.trim(s))), lambda c: c.isNotNull())


def verbalized(subject: Column, relation: Column, outcome: Column, description: Column, most: int = 300) -> Column:
    """An assertion as a sentence for embedding; missing parts are left out."""
    return F.concat_ws(" ", subject, relation, F.concat(outcome, F.lit(".")), F.left(description, F.lit(most)))


def has_all(words: Column, required: Column) -> Column:
    """Whether all required words are among the words."""
    return F.size(F.array_except(required, words)) == 0
