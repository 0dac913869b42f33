"""Freely typed values to the entries of a reference list.

Distinct values are normalised (damaged encodings, accents, separators, abbreviations, remarks), an inverted index of
character n-grams gives the cosine of inverse-frequency weights with every entry that shares one, and the best concept is
accepted when its cosine reaches a threshold and stands clear of the next concept by a margin. An exact check follows: the
words must agree up to typing errors.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Entries of the reference list in one index; longer lists are looked up block by block.
BLOCK = 100_000
#: Least cosine of the accepted entry, and how far the best entry of another concept must stay behind.
COSINE = 0.4
MARGIN = 0.02
NONE = "SIN_ANCLAR"

# Joining words, remarks around a term, and abbreviations.
JOINING = set("de del la el los las a al por con en y o the of to and anti".split())
REMARKS = set("posible probable sospecha paciente pac antecedente antecedentes ant historia confirmado confirmada comp complicado complicada cronico cronica agudo aguda revisar nos mg ml g mcg revisado pendiente previo previa hx dx dudoso dudosa duda leve grave activo activa conocido conocida compatible estudio ver nota probablemente descartar descartado tipo inespecifico inespecifica especificado otro otra".split())
ABBREVIATIONS = {
    "sindr": "sindrome", "sdr": "sindrome", "sd": "sindrome", "sdme": "sindrome", "sind": "sindrome", "rec": "recuento", "nº": "recuento", "no": "recuento", "num": "recuento", "rcto": "recuento", "bx": "biopsia", "biop": "biopsia", "enf": "enfermedad", "enfdad": "enfermedad", "enfd": "enfermedad", "enferm": "enfermedad", "inf": "infeccion", "infec": "infeccion", "infecc": "infeccion", "def": "deficit", "dfct": "deficit", "ac": "anticuerpos", "acs": "anticuerpos", "antic": "anticuerpos", "hep": "hepatitis", "hepat": "hepatitis", "alerg": "alergia", "alg": "alergia", "neurop": "neuropatia", "np": "neuropatia", "derm": "dermatosis", "dermat": "dermatosis", "cv": "carga", "carg": "carga", "coc": "cociente", "tto": "terapia", "trat": "terapia", "tx": "terapia", "ter": "terapia", "dren": "drenaje", "lav": "lavado", "crib": "cribado", "cribaje": "cribado", "scr": "cribado", "h": "humano", "hum": "humano", "min": "minor", "pal": "palido",
}


def mend(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, put right."""
    for _ in range(2):
        if not re.search("[ÃÂâ]", text):
            break
        for code in ("cp1252", "latin-1"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        else:
            break
    return text


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", mend(text).lower()) if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    """Folded words; dotted capitals are one word, abbreviations are written out."""
    low = re.sub(r"\b((?:[a-z0-9][.\- ]){2,}[a-z0-9])\b\.?", lambda m: re.sub(r"[.\- ]", "", m[1]), fold(text))
    found = re.findall(r"[a-z0-9]+", low)
    return [ABBREVIATIONS.get(w, w) for w in found]


def content(words: list[str]) -> list[str]:
    """Words that carry the meaning: without joining words, remarks and doses."""
    kept = [w for w in words if w not in JOINING and w not in REMARKS and not w.isdigit() and not re.fullmatch(r"\d+(?:mg|ml|g|mcg)?", w)]
    return kept or [w for w in words if w not in JOINING] or words


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; ``most + 1`` if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > most and (before is None or min(before) > most):
            return most + 1
    return min(row[-1], most + 1)


def _grams(words: list[str], n: int = 3) -> list[str]:
    out = []
    for w in words:
        padded = f"^{w}$"
        out += [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
    return out


def edits(value: list[str], entry: list[str]) -> float:
    """Typing errors by which the value's words become the entry's; 99 if it means something else.

    Every word of the entry needs its word of the value (one error, for words of eight letters and more two), and what the
    value has besides must be joining words or remarks, themselves perhaps mistyped.
    """
    rest, total = list(value), 0
    for w in sorted(entry, key=len, reverse=True):
        if len(w) < 5:
            if w not in rest:
                hit = next((r for r in rest if len(w) == 4 and len(entry) > 1 and distance(r, w, 1) == 1), None)
                if hit is None:
                    return 99
                total += 1
                rest.remove(hit)
            else:
                rest.remove(w)
            continue
        best, at = 99, None
        for i, r in enumerate(rest):
            d = distance(r, w, 2 if len(w) > 11 else 1)
            if d < best:
                best, at = d, i
        if at is None or best > (2 if len(w) > 11 else 1):
            return 99
        total += best
        rest.pop(at)
    for r in rest:
        if not (r.isdigit() or len(r) < 3 or r in JOINING or len(r) < 6 and any(sorted(r) == sorted(k) or distance(r, k, 1) <= 1 for k in JOINING if len(k) > 1) or r in REMARKS or any(abs(len(r) - len(k)) < 2 and len(k) > 4 and distance(r, k, 1) <= 1 for k in REMARKS)):
            return 99
    return total


def run_together(value: list[str], entry: list[str]) -> float:
    """The same by the letters without spaces, for words run together or torn apart."""
    a, b = "".join(value), "".join(entry)
    if len(b) < 10:
        return 99
    d = distance(a, b, 1)
    return d + 0.5 if d <= 1 else 99


class Index:
    """Inverted index of n-grams of reference entries, with weights and norms."""

    def __init__(self, terms: list[tuple[str, str]]):
        """``terms``: (entry text, entry id)."""
        self.ids, self.words, self.full = [], [], []
        seen = set()
        for text, key in terms:
            w = content(words_of(text))
            mark = (tuple(sorted(w)), key)
            if w and mark not in seen:
                seen.add(mark)
                self.ids.append(key)
                self.words.append(w)
                self.full.append(words_of(text))
        lists: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for g in set(_grams(w)):
                lists.setdefault(g, []).append(i)
        n = max(1, len(self.words))
        self.weight = {g: float(np.log(1 + n / len(x))) for g, x in lists.items()}
        self.lists = {g: np.array(x, np.int32) for g, x in lists.items()}
        self.norm = np.sqrt(np.array([sum(self.weight[g] ** 2 for g in set(_grams(w))) for w in self.words] or [1.0]))
        self.unknown = float(np.log(1 + n))
        self.names = sorted(set(self.ids))
        place = {k: j for j, k in enumerate(self.names)}
        self.number = np.array([place[k] for k in self.ids], np.int64)

    def candidates(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the entries that share an n-gram with the words and may be accepted or contest it."""
        grams = set(_grams(words))
        lists, weights, size = [], [], 0.0
        for g in grams:
            w = self.weight.get(g, self.unknown)
            size += w * w
            if g in self.lists:
                lists.append(self.lists[g])
                weights.append(w * w)
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.concatenate(lists)
        score = np.bincount(at, np.repeat(weights, [len(x) for x in lists]), len(self.words)) / (self.norm * np.sqrt(size))
        some = np.flatnonzero(score >= COSINE - MARGIN)
        return some, score[some]

    def match(self, text: str) -> tuple[str | None, float, float]:
        """Accepted entry id (or None), its cosine, and that of the best entry of another id."""
        words = words_of(text)
        core = content(words)
        at, cosine = self.candidates(core)
        if not len(at) or cosine.max() < COSINE:
            return None, 0.0, 0.0
        best = self.number[at[cosine == cosine.max()]].min()
        own = self.number[at] == best
        first, second = float(cosine.max()), float(cosine[~own].max(initial=0.0))
        # every entry of the best concept that reaches the threshold is checked, and so what the value's words may leave out
        plain, kept = [w for w in words if w not in JOINING], [w for w in words if w not in REMARKS]
        for i in at[own & (cosine >= COSINE)] if first - second > MARGIN else ():
            if min(edits(core, self.words[i]), edits(plain, self.words[i]), run_together(kept, self.full[i])) < 90:
                return self.names[best], first, second
        return None, first, second


def map_values(values: DataFrame, value: str, terms: DataFrame, term: str, key: str, block: int = BLOCK) -> DataFrame:
    """Rows (value, key) of every distinct value that is not null or blank; key is ``SIN_ANCLAR`` where no entry is meant.

    The reference list is indexed in blocks of ``block`` entries, whole concepts in one block; the best cosine over all blocks
    counts, and the margin holds between blocks as well. Null terms and keys are ignored; with an empty list nothing matches.
    """
    blank = "^[\\s\\x{00a0}\\x{2000}-\\x{200b}\\x{202f}\\x{3000}\\x{feff}]*$"
    distinct = values.select(F.col(value).alias("value")).where(F.col("value").isNotNull() & ~F.col("value").rlike(blank)).distinct()
    entries = [(r.t, r.k) for r in terms.select(F.col(term).alias("t"), F.col(key).alias("k")).where("t is not null and k is not null").distinct().orderBy("k", "t").toLocalIterator()]

    def looked(index: Index):
        def run(batches):
            for batch in batches:
                got = [index.match(v) for v in batch["value"]]
                yield pd.DataFrame({"value": batch["value"], "key": pd.Series([g[0] for g in got], dtype=object), "first": [g[1] for g in got], "second": [g[2] for g in got]})

        return distinct.mapInPandas(run, "value string, key string, first double, second double")

    cuts = [0]
    for i in range(1, len(entries) + 1):
        if i == len(entries) or i - cuts[-1] >= block and entries[i][1] != entries[i - 1][1]:
            cuts.append(i)
    blocks = [entries[a:b] for a, b in zip(cuts, cuts[1:])] or [[]]
    found = looked(Index(blocks[0]))
    if len(blocks) > 1:
        for part in blocks[1:]:
            found = found.unionByName(looked(Index(part)))
        # the next concept may be the best of another block
        ranked = found.groupBy("value").agg(F.max_by("key", "first").alias("key"), F.max("first").alias("first"), F.sort_array(F.collect_list("first"), asc=False).alias("firsts"), F.max_by("second", "first").alias("second"))
        found = ranked.select("value", F.when(F.col("first") - F.greatest("second", F.col("firsts")[1]) > MARGIN, F.col("key")).alias("key"))
    return found.select("value", F.coalesce("key", F.lit(NONE)).alias("key"))
