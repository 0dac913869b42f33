"""Defects of answers: empty, cut off, refusing, copying the question, or in another language.

Answers are paired with their questions by thread and order. A copy is told by compressing the answer with the question as
zstandard dictionary; language and refusal by dictionaries of function words and formulas; a cut by a terminal-context
model, fitted on all answers, that judges from the last words whether a text could end there.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from lumbre.llm.boosting import Boosted
from lumbre.sources.store import materialize

#: Bytes a wrapper around a copied question takes at most; it does not grow with the question.
WRAPPER = 45
#: Messages of a thread from which on it is ordered in blocks of so many ids.
BLOCK = 20_000


def answer_pairs(df: DataFrame, key: str, thread: str, role: str, text: str, asking: str, answering: str, block: int = BLOCK) -> DataFrame:
    """Rows (id, question, answer): the first answering message after an asking one of the thread, in order of key.

    Repeated rows count once, other roles are passed over, null threads or keys are ignored. A thread with more than
    ``block`` messages is ordered in blocks of keys that hand their last message on, so no task gets a whole hot thread.
    """
    rows = df.select(F.col(key).alias("id"), F.col(thread).alias("thread"), F.col(role).alias("role"), F.col(text).alias("text")).where(F.col("role").isin(asking, answering) & F.col("id").isNotNull() & F.col("thread").isNotNull())
    hot = rows.groupBy("thread").count().where(f"count > {block}").select("thread", F.lit(True).alias("hot"))
    rows = rows.join(hot, "thread", "left").select("id", "thread", "role", "text", F.when(F.col("hot"), F.floor(F.col("id") / block)).otherwise(0).alias("block"), F.coalesce("hot", F.lit(False)).alias("hot"))
    w = Window.partitionBy("thread", "block").orderBy("id")
    before = F.lag(F.struct("role", "text")).over(w)
    seen = rows.withColumn("before", before)
    ends = rows.where("hot").groupBy("thread", "block").agg(F.max_by(F.struct("role", "text"), "id").alias("last"))
    handed = ends.select("thread", F.lead("block").over(Window.partitionBy("thread").orderBy("block")).alias("block"), F.col("last").alias("handed")).where("block is not null")
    inner = seen.where(F.col("before").isNotNull()).select("id", "role", "text", "before")
    first = seen.where(F.col("before").isNull() & F.col("hot")).join(handed, ["thread", "block"]).select("id", "role", "text", F.col("handed").alias("before"))
    return inner.unionByName(first).where((F.col("role") == answering) & (F.col("before.role") == asking)).select("id", F.col("before.text").alias("question"), F.col("text").alias("answer"))


# What stands for no answer; formulas of refusal and courtesy; frequent words of languages.
EMPTY = {"", "null", "none", "nan", "n/a", "na", "s/r", "vacío", "vacio", "sin respuesta", "sin contenido", "no answer", "empty", "no response", "undefined", "tbd", "pendiente", "sin datos"}
REFUSAL = re.compile(
    r"no (?:puedo|podemos|podré|podría|voy a|vamos a|debo|quiero) (?:ayudar|ayudarle|contestar|contestarle|responder|responderle|atender|dar|darle|ofrecer|opinar|entrar|pronunciarme|generar|facilitar|proporcionar|tratar|asistir|hablar|valorar|comentar|hacerlo|aconsejar)"
    r"|no (?:estoy|está) autorizad|no tengo (?:permiso|permitido|autorización)|tengo permitido|sin contestar|me resulta imposible|me es imposible|no me es posible|no procede que (?:yo )?(?:conteste|responda)|me impiden|políticas? de uso|declin(?:o|ar|amos)|no la atiendo|no lo atiendo|rechaz(?:o|ar) (?:la|esta|su) (?:solicitud|petición|consulta)|"
    r"no me corresponde|me abstengo|no facilito|no lo puedo generar|no pronunciarme|prefiero no|no doy (?:indicaciones|consejos|respuesta)|no respondo|no contesto|fuera de (?:mi|lo que) (?:alcance|tengo|competencia|puedo)|no soy (?:quién|quien|la persona)|no atiendo|no ofrezco|no me pronuncio|no está en mi mano|no entra en mis|me veo obligado a (?:declinar|rechazar)|debo abstenerme|no se me permite|no me permiten"
    r"|\bi (?:cannot|can't|can not|can’t|won't|won’t|am unable|am not able|am not allowed|am not permitted|must decline|have to decline|decline|refuse|would rather not|prefer not|do not have permission|don't have permission|will not)|i'm (?:unable|not able|not allowed|sorry, but i)|unable to (?:help|answer|assist)|not (?:authori[sz]ed|allowed|permitted) to|my (?:rules|guidelines|policies) (?:do not|don't|prevent|forbid)|against (?:my|the) (?:policy|policies|guidelines|rules)|outside (?:of )?what i|usage polic|cannot (?:help|assist|answer)|not something i can|beyond what i",
    re.I,
)
COURTESY = re.compile(
    r"^(?:lo siento|perdón|perdone|disculpe|lamento\b[^.]{0,40}|gracias\b[^.]{0,40}|como (?:asistente|modelo)[^.]{0,40}|as an? (?:ai|assistant|language model)[^.]{0,40}|sorry|i(?:'m| am) sorry|thank you[^.]{0,40}|consulte\b[^.]{0,60}|acuda\b[^.]{0,60}|¿?puedo ayudarle[^.]{0,40}|espero que lo entienda|diríjase\b[^.]{0,60}|please (?:consult|see|ask|contact)[^.]{0,60}|see a specialist|ask your[^.]{0,40}|(?:can|may) i help[^.]{0,50}|is there anything else[^.]{0,40}|i hope you understand|hable con\b[^.]{0,50}|pregunte a\b[^.]{0,50}|un saludo|saludos|no puedo concretar más[^.]{0,50})[\s.,;:!?]*$",
    re.I,
)
LANGUAGES = {
    "es": "el la los las de del que y en con por para se un una es no su más como según ante tras sus al lo esta este pero hay debe cabe fue cada qué cuándo cómo cuánto dosis necesito saber puedo sobre si tiene entre hasta desde sin son ha o e le muy también dice guía cuando resume hago aparece propones seguro días semanas meses usted pregunta",
    "en": "the of and in was is to with for at from this by were are be as on that it or an who not after before if how often should what can when does which there must may has have had over than between during while per each safe check dose start stop",
    "pt": "o os as de do da dos das que e em com por para se um uma é não seu mais como após ao pelo pela na no nas nos deve ser são foi quando entre até sem ou também às dose fica abaixo exames recomenda-se repetir iniciar ajustada função à está pode cada num numa seja têm não",
    "fr": "le la les de du des que et en avec pour se un une est ne pas plus comme selon après aux au dans sur par ce cette ces qui être sont a été sans ou il elle lorsque quand aucune donnée entre jusque doit peut chaque d l n on chez la dose",
    "ca": "el la els les de del dels que i en amb per per a es un una és no seu més com segons després al als aquest aquesta amb cal quan entre fins sense o també han són dosi d l ha de si baixa reduir mesos són decisió equip enllà cada hi",
    "it": "il lo la i gli le di del della dei delle che e in con per si un una è non suo più come secondo dopo al alla nel nella sono è stato quando tra fino senza o anche deve può ogni da dal dalla dose va",
    "de": "der die das den dem des und in mit für zu ist nicht ein eine einer auf nach bei von wird werden sind als auch wenn oder aus sich es im am zwischen bis ohne kann muss jede soll zur zum",
    "gl": "o a os as de do da dos das que e en con por para se un unha é non máis como segundo tras ao á no na nos nas cando entre ata sen ou tamén deben cómpre dose",
    "eu": "eta da ez du bat hau dira izan dute den baina edo behar dosia egin ere dago gabe arte",
}
_SETS = {k: set(v.split()) for k, v in LANGUAGES.items()}
_DF = Counter(w for words in _SETS.values() for w in words)
_QUOTED = re.compile(r"\"[^\"]*\"|«[^»]*»|“[^”]*”")


def _unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text) if '"' in text or "«" in text or "“" in text else text


_WORDS = re.compile(r"[^\W\d_]+(?:-se)?")


#: A word counts so much, shared among its languages; divisible by all their numbers, so that sums are exact in any order.
_UNIT = math.lcm(*_DF.values())
_SHARED = sorted({tuple(k for k, words in _SETS.items() if w in words) for w in _DF})
#: Place in ``_SHARES`` of the languages of each frequent word, also by its Latin-1 bytes; the last place is that of no language.
_HITS: dict[str | bytes, int] = {x: _SHARED.index(tuple(k for k, words in _SETS.items() if w in words)) for w in _DF for x in (w, w.encode("latin-1"))}
_SHARES = [*([(k, _UNIT // len(languages)) for k in languages] for languages in _SHARED), []]
#: Latin-1 bytes in which only letters are left.
_LETTERS = bytes(c if re.match(r"[^\W\d_]", chr(c)) else 32 for c in range(256))


def language_scores(text: str) -> dict[str, float]:
    """Weighted hits of every language's frequent words."""
    low = text.lower()
    try:
        # with nothing but Latin-1 and no "-se" the words are what stands between other bytes than letters
        words = _WORDS.findall(low) if "-se" in low else low.encode("latin-1").translate(_LETTERS).split()
    except UnicodeEncodeError:
        words = _WORDS.findall(low)
    scores: dict[str, int] = {}
    for at, n in Counter(map(_HITS.get, words, repeat(-1))).items():
        for k, v in _SHARES[at]:
            scores[k] = scores.get(k, 0) + n * v
    return {k: v / _UNIT for k, v in scores.items()}


def language(text: str) -> tuple[str, float, float]:
    """Language with the most frequent words in the text, its share of weighted hits, and how many they are."""
    scores = language_scores(text)
    if not scores:
        return "", 0.0, 0.0
    k = max(scores, key=scores.get)
    return k, scores[k] / sum(scores.values()), scores[k]


_FOLD = dict(zip("áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc"))
#: Latin-1 bytes without accents, blanks for all but letters and figures.
_FOLDED = bytes(ord(x) if (x := _FOLD.get(chr(c), chr(c))) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _plain(text: str) -> str:
    # what is not Latin-1 becomes a question mark, and so a blank
    return " ".join(text.lower().encode("latin-1", "replace").translate(_FOLDED).decode("ascii").split())


_STRIPPED = "()[]{}<>\"'«»“”.…·-–—_*#|:;,!¡?¿ \t\r\n"
#: A beginning without what is taken out of a text before it is judged as empty.
_BEGINNING = re.compile(r"[^<\[&\u200b-\u200f\u2060\ufeff]{24,99}")


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    m = _BEGINNING.match(text)
    if m and len(first := m.group().strip().strip(_STRIPPED).strip()) > 20 and any(map(str.isalnum, first)):
        return False
    bare = re.sub(r"<[^<>]*>|\[\s*\d+(?:\s*[,;\-]\s*\d+)*\s*\]|&nbsp;|[​-‏⁠﻿]", " ", text)
    bare = bare.strip().strip(_STRIPPED).strip().lower()
    return bare in EMPTY or not any(c.isalnum() for c in bare)


_COMPRESSOR = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)


def _given(text: bytes, known: bytes) -> int:
    """Bytes that ``text`` takes when ``known`` is the dictionary."""
    if len(known) < 8:
        return len(text)
    d = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text))


def is_copy(question: str | None, answer: str) -> bool:
    """Whether the question explains nearly all of the answer and the answer a good part of a question."""
    q, a = _plain(question or ""), _plain(re.sub(r"\[\d+\]", " ", answer) if "[" in answer else answer)
    if len(a) < 15 or len(q) < 15:
        # too short for a dictionary: the same but for case, accents and punctuation
        return bool(a) and a == q
    words, known = a.split(), set(q.split())
    if sum(map(known.__contains__, words)) < 0.6 * len(words):
        return False
    # the frame takes about 10 bytes, a match about 3; a wrapper of a few words comes on top, more is an answer
    new = _given(a.encode(), q.encode()) - 12
    last = q[max(0, len(q) - len(a) - 10) :]
    asked = re.split(r"[.;]\s+(?=[A-Z¿a-z])", (question or "").strip())
    part = min((_plain(x) for x in [question or "", *asked, *re.findall(r"¿[^?]*\?", question or "")] if len(_plain(x)) >= 15), key=lambda x: abs(len(x) - len(a)), default=last)
    covered = _given(part.encode(), a.encode()) - 12
    return new <= WRAPPER + 0.02 * len(a) and covered <= 0.4 * len(part)


def is_refusal(question: str | None, answer: str) -> bool:
    """A formula of refusal and, besides it, courtesy and the question's own words, nothing on the matter."""
    numbers = _NUMBERS.findall(answer)
    # a figure that the question does not have is something on the matter
    if numbers and not set(numbers) <= set(_NUMBERS.findall(question or "")) or not REFUSAL.search(answer):
        return False
    known = set(_plain(question or "").split())
    for part in re.split(r"(?<=[.?!;\n])\s+|\n", answer.strip()):
        clauses = [part] if REFUSAL.search(part) else re.split(r",\s+", part)
        if REFUSAL.search(part):
            # what goes on after "but" is an answer
            rest = re.split(r",?\s+(?:pero|aunque|no obstante|sin embargo|but|however)\b", part[REFUSAL.search(part).end() :], maxsplit=1)
            if len(rest) > 1 and len(_plain(rest[1]).split()) > 4 and not REFUSAL.search(rest[1]):
                return False
            continue
        for clause in clauses:
            words = _plain(clause).split()
            if not words or COURTESY.match(clause.strip()) or COURTESY.match(part.strip()):
                continue
            fresh = [w for w in words if w not in known]
            if len(words) > 3 and (any(w.isdigit() for w in fresh) or len(fresh) > 0.5 * len(words) and len(fresh) > 4):
                return False
    return True


def is_foreign(question: str | None, answer: str) -> bool:
    given = language_scores(_unquoted(answer))
    if not given:
        return False
    k = max(given, key=given.get)
    if given[k] < 2.0:
        return False
    asked, _, n = language(_unquoted(question or ""))
    # the question's language explains clearly less of the answer
    return bool(asked) and asked != k and n >= 1.0 and given[k] > 1.4 * given.get(asked, 0.0)


_COUNTS = {"dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
_ANNOUNCED = re.compile(r"\b(" + "|".join(_COUNTS) + r")\s+(?:[^\W\d_]+\s+){0,2}[^\W\d_]+\s*:\s*(?=(?:\n|\(?[1a][).]|-|•))", re.I)
#: How such an announcement ends; looked for first.
_LISTED = re.compile(r":\s*(?=(?:\n|\(?[1a][).]|-|•))", re.I)
_NUMBERS = re.compile(r"\d+")
_ITEM = re.compile(r"(?:(?<=\s)|^)\(?(\d{1,2})[.)](?=\s|$)")
_TAIL = re.compile(r"(?:\s*\[\d+\])+\s*$")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_SENTENCE = re.compile(r"\s(?<=[.?!]\s)\s*(?=[A-ZÁÉÍÓÚÑ¿¡])")


def _stops(t: str) -> bool:
    """Whether a text without blanks at its end ends in the middle by its last marks."""
    c, b = t[-1:], t[-2:-1]
    if not (c in "….:,;()[" or c.isdecimal()) or c in (".", ")") and not (b == "." or b.isdecimal()):
        return False
    return bool(re.search(r"(?:…|\.\.\.|:|,|;|\(|\b\d{1,2}[.)]|[\[(]\d*)$", t) and not re.search(r"\w{3}[^\W\d_]*\s+\d{1,4}\.$", t) or re.search(r"\[\d*$", t))


class Terminal:
    """Judges from the last words of a text whether it may end there."""

    def fit(self, texts: list[str], seed: int = 5) -> "Terminal":
        """Whole texts against the same texts cut at random; the two halves of the sample give counts and trees."""
        r = random.Random(seed)
        texts = [t for t in (re.sub(r"\s+", " ", _TAIL.sub("", t)).strip() for t in texts) if len(t) > 60 and t[-1] in ".?!"]
        half = len(texts) // 2
        self.words = Counter(w for t in texts for w in _TOKEN.findall(t.lower()))
        self.ends: Counter = Counter()
        self.goes: Counter = Counter()
        for t in texts[:half]:
            for s in re.split(r"(?<=[.?!])\s+(?=[A-ZÁÉÍÓÚÑ¿¡])", t):
                tokens = self._tokens(s.rstrip(".?!\"») "))
                for n in (1, 2, 3):
                    if len(tokens) >= n:
                        self.ends[tuple(tokens[-n:])] += 1
                for i in range(3, len(tokens)):
                    for n in (1, 2, 3):
                        self.goes[tuple(tokens[i - n : i])] += 1
        rows, marks = [], []
        for t in texts[half:]:
            two = self._examples(t, r)
            rows += two
            marks += [0, 1][: len(two)]
        self.model = Boosted(rounds=60, depth=4).fit(np.array(rows or [[0.0] * 12, [1.0] * 12], float), np.array(marks or [0, 1]))
        # only counts that were seen more than once say anything about other texts
        self.goes = Counter({k: v for k, v in self.goes.items() if v > 1})
        return self

    def _examples(self, text: str, r: random.Random) -> list[list[float]]:
        """Features of a sentence of the text and of the same sentence cut; none of short sentences."""
        s = r.choice(_SENTENCE.split(text))
        if len(s) <= 30:
            return []
        if r.random() < 0.5:
            cut = s[: r.randint(12, len(s) - 3)].rstrip()
        else:
            gaps = [m.start() for m in re.finditer(r"\s", s)]
            cut = s[: r.choice(gaps[1:] or [len(s) // 2])].rstrip()
        return [self._features(s.rstrip(".?!\"» ")), self._features(cut)]

    @staticmethod
    def _tokens(text: str) -> list[str]:
        return Terminal._shapes(_TOKEN.findall(text.lower()))

    @staticmethod
    def _shapes(found: list[str]) -> list[str]:
        return ["0" if t.isdigit() else t if len(t) < 8 else "~" + t[-4:] if not t.endswith("mente") else "~mente" for t in found]

    def _features(self, text: str) -> list[float]:
        tail = text[-90:]
        found = _TOKEN.findall(tail.lower())
        # only the last three make a context
        tokens, last = self._shapes(found[-3:]), (found or [""])[-1]
        out = []
        for n in (1, 2, 3):
            k = tuple(tokens[-n:])
            e, g = self.ends.get(k, 0), self.goes.get(k, 0)
            out += [round(math.log((e + 0.3) / (g + 0.3)), 2), min(e + g, 50)]
        known = self.words.get(last, 0)
        return [*out, min(known, 50), len(last), last.isdigit(), text.count("(") - text.count(")"), text.count("\"") % 2 + max(0, text.count("«") - text.count("»")), last in (",", ":", ";", "(", "-", "…")]

    def cut(self, texts: list[str]) -> np.ndarray:
        """Whether each non-empty answer stops before its end."""
        result = np.zeros(len(texts), bool)
        open_rows, where = [], []
        for i, raw in enumerate(texts):
            t = raw.rstrip()
            t = _TAIL.sub("", t).rstrip() if t[-1:] == "]" else t
            m = _LISTED.search(t) and _ANNOUNCED.search(t)
            if m:
                listed = t[m.end() - 1 :]
                items = [int(x) for x in _ITEM.findall(listed)]
                bullets = len(re.findall(r"(?:^|\n)\s*[-•*]\s", listed))
                if max(items[-1:] + [bullets]) < _COUNTS[m[1].lower()]:
                    result[i] = True
                    continue
            if _stops(t):
                result[i] = True
                continue
            if t[-1:] in ".?!»\"”)]" or re.search(r"(?:mg|ml|h|%|g|UI|kg)$", t) and len(t) < 60:
                continue
            if len(t.split()) < 6 and "\n" not in t and not re.search(r"[,(:]$", t) and len(t) < 40:
                where.append((i, 0.9))
            else:
                where.append((i, None))
            last = re.split(r"(?<=[.?!])\s+(?=[A-ZÁÉÍÓÚÑ¿¡])|\n", t)[-1]
            open_rows.append(self._features(re.sub(r"\s+", " ", last)))
        if open_rows:
            p = self.model.predict(np.array(open_rows, float))
            for (i, least), q in zip(where, p):
                result[i] = q >= (least or self.model.threshold)
        return result


def defects(pairs: DataFrame, model: Terminal) -> DataFrame:
    """Rows (id, defect) of the defective pairs (id, question, answer); the first that applies of vacia, copia, rechazo,
    otro_idioma, truncada. A null question is no reason for a defect; very long answers are read whole."""

    def run(batches):
        for batch in batches:
            ids, kinds, rest = [], [], []
            for i, q, a in zip(batch["id"], batch["question"], batch["answer"]):
                kind = "vacia" if is_empty(a) else "copia" if is_copy(q, a) else "rechazo" if is_refusal(q, a) else "otro_idioma" if is_foreign(q, a) else None
                if kind:
                    ids.append(i)
                    kinds.append(kind)
                else:
                    rest.append((i, a))
            for (i, _), c in zip(rest, model.cut([a for _, a in rest])):
                if c:
                    ids.append(i)
                    kinds.append("truncada")
            yield pd.DataFrame({"id": pd.Series(ids, dtype=batch["id"].dtype), "defect": pd.Series(kinds, dtype=object)})

    return pairs.mapInPandas(run, f"id {dict(pairs.dtypes)['id']}, defect string")


def _whole(text: str) -> str | None:
    """The text in one line without citations at its end, if it is long enough and ends as a sentence does."""
    t = text.rstrip()
    t = " ".join((_TAIL.sub("", t) if t[-1:] == "]" else t).split())
    return t if len(t) > 60 and t[-1] in ".?!" else None



def context_counts(texts: list[str], counted: list[bool]) -> pd.DataFrame:
    """Rows (gram, n, words, ends, goes): how often tokens occur in the texts, and contexts of ``n`` tokens (joined by spaces) in the
    ``counted`` ones at the end of a sentence and before its end; single tokens of the texts have n 0. All tokens of the texts at once, as numbers."""
    codes, marks = {}, []

    def code(token):
        # closing marks at the end of a sentence do not belong to it
        shape = Terminal._tokens(token)[0]
        k = codes.get(shape)
        if k is None:
            k = codes[shape] = len(codes)
            marks.append(shape in set(".?!\"»)"))
        return k

    words: Counter = Counter()
    flat = []
    for text, use in zip(texts, counted):
        if not use:
            words.update(_TOKEN.findall(text.lower()))
            continue
        for s in _SENTENCE.split(text):
            found = _TOKEN.findall(s.lower())
            words.update(found)
            flat += found
            flat.append(None)
    raw = {t: code(t) for t in words}
    raw[None] = -1
    at = np.fromiter(map(raw.__getitem__, flat), np.int64, len(flat))
    names = np.array(list(codes), dtype=object)
    closing = np.append(np.array(marks, bool), False)[at] if len(at) else np.zeros(0, bool)
    keep = np.ones(len(at), bool)
    before = at == -1
    while before.any():
        # what stands directly before the end of a sentence, or before such marks
        before = np.append(before[1:], False) & closing
        keep[before] = False
    at = at[keep]
    stop = np.flatnonzero(at == -1)
    start = np.append(0, stop[:-1] + 1) if len(stop) else stop
    place = np.arange(len(at)) - np.repeat(start, stop - start + 1)
    last = np.repeat(stop, stop - start + 1) - 1
    out = [pd.DataFrame({"gram": list(words), "n": 0, "words": list(words.values()), "ends": 0, "goes": 0})]
    here = np.arange(len(at))
    for n in (1, 2, 3):
        kinds = {}
        for name, mine in (("ends", (here == last) & (place + 1 >= n)), ("goes", (here < last) & (place >= 2))):
            j = np.flatnonzero(mine)
            kinds[name] = np.stack([at[j - i] for i in range(n - 1, -1, -1)], 1) if len(j) else np.zeros((0, n), np.int64)
        both = np.concatenate(list(kinds.values()))
        base = len(names) + 1
        # three numbers below 2,097,152 fit into one
        key = both[:, 0]
        for i in range(1, n):
            key = key * base + both[:, i]
        known, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        cut = len(kinds["ends"])
        gram = [" ".join(names[g]) for g in both[first]]
        out.append(pd.DataFrame({"gram": gram, "n": n, "words": 0, "ends": np.bincount(inverse[:cut], minlength=len(known)), "goes": np.bincount(inverse[cut:], minlength=len(known))}))
    return pd.concat(out)


def fit_terminal(df: DataFrame, key: str, text: str) -> Terminal:
    """Terminal-context model from all answers: half of them, by hash of the key, give the counts of contexts, the others a sentence and
    a cut one each for the trees.

    Words, contexts, and the binned features with their numbers are summed before they come to the driver; contexts that only go on and do so once are left behind.
    """
    h = F.xxhash64(key, F.lit(5))
    rows = df.where(F.length(text) > 60).select(F.col(text).alias("t"), h.alias("h"))

    def count(batches):
        texts, use, size = [], [], 0
        for batch in batches:
            for t, k in zip(batch["t"], batch["h"]):
                t = _whole(t)
                if t:
                    texts.append(t)
                    use.append(k % 2 == 0)
                    size += len(t)
            if size > 4_000_000:
                yield context_counts(texts, use)
                texts, use, size = [], [], 0
        if texts:
            yield context_counts(texts, use)

    counted = rows.mapInPandas(count, "gram string, n int, words long, ends long, goes long").groupBy("gram", "n").agg(*[F.sum(c).alias(c) for c in ("words", "ends", "goes")])
    table = counted.where("words > 0 or ends > 0 or goes > 1").toArrow()
    model = Terminal()
    model.words, model.ends, model.goes = Counter(), Counter(), Counter()
    for gram, n, words, ends, goes in zip(*(table[c].to_pylist() for c in ("gram", "n", "words", "ends", "goes"))):
        if not n:
            model.words[gram] = words
            continue
        k = tuple(gram.split(" "))
        if ends:
            model.ends[k] = ends
        if goes > 1:
            model.goes[k] = goes
    names = [f"f{i}" for i in range(12)]

    def examples(batches):
        for batch in batches:
            out, marks, held = [], [], []
            for t, k in zip(batch["t"], batch["h"]):
                if (t := _whole(t)) is not None:
                    r = random.Random(k)
                    two = model._examples(t, r)
                    out += two
                    marks += [0, 1][: len(two)]
                    held += [r.random() < 0.25 for _ in two]
            yield pd.DataFrame(np.array(out, float).reshape(len(out), 12), columns=names).assign(y=np.array(marks, np.int32), held=np.array(held, bool))

    sets = materialize(rows.where("pmod(h, 2) = 1").mapInPandas(examples, ", ".join(f"{c} double" for c in names) + ", y int, held boolean").groupBy(*names, "y", "held").agg(F.count("*").alias("n")))
    values = sets.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(names)])).alias("x"), "n").groupBy("x.i", "x.v").agg(F.sum("n").alias("n")).toPandas().sort_values(["i", "v"])
    model.model = Boosted(rounds=60, depth=4)
    edges = [model.model.edge(part["v"].to_numpy(float), part["n"].to_numpy(float)) for _, part in values.groupby("i")]
    if not edges:
        return Terminal().fit([])
    model.model.edges = edges

    def binned(batches):
        for batch in batches:
            b = pd.DataFrame({c: np.searchsorted(e, batch[c].to_numpy(), side="right").astype(np.int32) for c, e in zip(names, edges)})
            yield b.assign(y=batch["y"].to_numpy(), held=batch["held"].to_numpy(), n=batch["n"].to_numpy()).groupby([*names, "y", "held"], as_index=False)["n"].sum()

    few = sets.mapInPandas(binned, ", ".join(f"{c} int" for c in names) + ", y int, held boolean, n long").groupBy(*names, "y", "held").agg(F.sum("n").alias("n")).toPandas().sort_values([*names, "y", "held"])
    model.model.fit_counted(few[names].to_numpy(np.int32), few["y"].to_numpy(float), few["n"].to_numpy(float), few["held"].to_numpy(bool))
    return model
