"""Noise of scanned pages: words split at line ends, misread characters, running headers, page numbers.

One pass counts the words of all texts; the frequent ones are the vocabulary, of bounded size, kept as a trie. A second pass
looks every unknown word up by walking a Levenshtein automaton and the trie together; typical misreadings are cheap
transitions of the automaton, so all vocabulary words within reach come out. The candidates are ranked by cost, by
the words around and by frequency. Then page furniture is removed and the lines flow into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lumbre.llm.samples import most_frequent
from lumbre.sources.store import materialize

# Typical misreadings (what is read, what was printed).
MISREAD = [
    ("@", "a"), ("†", "t"), ("‡", "t"), ("0", "o"), ("0", "ó"), ("1", "i"), ("1", "l"), ("1", "í"), ("5", "s"), ("6", "b"), ("6", "ó"), ("8", "b"), ("9", "g"), ("9", "q"), ("4", "a"), ("4", "á"), ("3", "e"), ("7", "t"), ("$", "s"), ("€", "e"), ("|", "l"), ("!", "l"), ("!", "i"), ("¡", "i"), ("£", "e"), ("¢", "c"),
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("ii", "ü"), ("li", "h"), ("vv", "w"), ("fi", "ñ"), ("f", "í"), ("c", "e"), ("nn", "m"), ("tn", "m"), ("ni", "m"), ("lc", "k"), ("rnn", "mm"), ("ij", "y"), ("o", "c"), ("e", "c"), ("u", "ii"), ("m", "rn"), ("h", "li"), ("d", "cl"), ("n", "ri"), ("s", "5"),
]
_READ: dict[str, list[tuple[str, str]]] = {}
for _bad, _good in MISREAD:
    _READ.setdefault(_bad[0], []).append((_bad, _good))
#: Words in the vocabulary, compounds and headers that are known, at most, and how often a word must occur among a million.
VOCABULARY, COMPOUNDS, HEADERS = 150_000, 100_000, 100_000
PER_MILLION = 3.0
HYPHEN = "-­‐‑–¬"
ODD = "@†‡$€£¢|!¡"
TOKEN = re.compile(rf"[^\W_][\w{ODD}]*|[{ODD}](?=\w)[\w{ODD}]*")
_SPLIT = re.compile(rf"(?<!\w)([^\W\d_][\w{ODD}]*)([ ]?[{HYPHEN}][ \t\r]*\n[ \t]*|[{HYPHEN}] +)([^\W_][\w{ODD}]*)")
_BREAK = re.compile(rf"[{HYPHEN}][ \t\r\n]")
_COMPOUND = re.compile(r"(?<!\w)[^\W\d_]+-[^\W\d_]+")
_STRONG = re.compile(rf"[a-záéíóúüñ]{{2}}[a-záéíóúüñ]*[0-9{ODD}](?=[a-záéíóúüñ])|^[0-9{ODD}][a-záéíóúüñ]{{4}}|[a-záéíóúüñ]{{4}}[0-9{ODD}]$")
_PAGE = re.compile(r"(?i)^\s*(?:[—–\-·•\[(|]\s*)?(?:p[áa4]g(?:ina|\.)?\s*|p[áa4]g1na\s*|p\.\s*|page\s*|folio\s*|hoja\s*)?(?:\d{1,4}|[ivxlcdm]{1,9})(?:\s*(?:/|de|of)\s*\d{1,4})?\s*(?:[—–\-·•\])|]\s*)?$")
_NUMBERED = re.compile(r"\s*[|·—–\-]\s*(?:p[áa]g(?:ina|\.)?\s*)?\d{1,4}$|^\d{1,4}\s*[|·—–\-]\s*")
_YEAR = re.compile(r"\b(?:19|20)\d\d\b")
_LISTED = re.compile(r"^(?:\d+[.)]|[a-z]\)|[-•*·])\s")
HEADING = re.compile(r"^\d{1,2}(?:\.\d{1,2}){0,3}\.?\s+\S")


def is_page_number(line: str) -> bool:
    line = line.strip()
    if not line or len(line) > 24 or not _PAGE.match(line):
        return False
    # a single Roman numeral is more than one letter other than i, v, x
    return any(c.isdigit() for c in line) or line.lower() in ("i", "v", "x") or bool(re.fullmatch(r"(?i)[^ivxlcdm]*m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})[^ivxlcdm]*", line)) and len(re.sub(r"\W", "", line)) > 1


def header_form(line: str) -> str | None:
    """The line without a page number and with figures masked, if it may be a running header."""
    line = line.strip()
    if not 6 <= len(line) <= 90 or line[-1] in ".;:,?!" or HEADING.match(line) or _LISTED.match(line) or line[0] in "|[(" or line[0].islower():
        return None
    bare = _NUMBERED.sub("", line).strip()
    words = bare.split()
    if not any(len(w) > 3 and w.isalpha() for w in words) or len(words) > 11:
        return None
    if re.match(r"(?i)(?:tabla|figura|cuadro|table|figure|anexo|n\s*=)", bare):
        return None
    tail = re.sub(r"\s*[·—–|]\s*[^·—–|]*$", "", bare)
    lead = re.sub(r"^[^·—–|]*[·—–|]\s*", "", bare)
    dated = any(_YEAR.search(" ".join(x.split()[-1:])) for x in (bare, tail, lead))
    if not dated and bare.upper() != bare and not re.search(r"\s[·—|]\s", bare):
        return None
    return re.sub(r"\d+", "0", bare.casefold())


def count_forms(df: DataFrame, text: str) -> DataFrame:
    """Rows (kind, form, n): words (w), hyphenated words (c) and possible headers (h) of all texts, counted."""

    def table(words: Counter, compounds: Counter, headers: Counter) -> pd.DataFrame:
        rows = [("w", k, v) for k, v in words.items() if 3 < len(k) < 41 and not k[0].isdigit()] + [("c", k, v) for k, v in compounds.items()] + [("h", k, v) for k, v in headers.items()]
        return pd.DataFrame(rows, columns=["kind", "form", "n"])

    def run(batches):
        words, compounds, headers = Counter(), Counter(), Counter()
        for batch in batches:
            texts = batch["text"].tolist()
            for i in range(0, len(texts), 500):
                joined = "\n".join(texts[i : i + 500])
                words.update(TOKEN.findall(joined.lower()))
                if "-" in joined:
                    compounds.update(x.lower() for x in _COMPOUND.findall(joined))
            for t in texts:
                if "\n" in t or len(t) < 91:
                    for line in t.split("\n"):
                        if len(line) < 91 and (f := header_form(line)):
                            headers[f] += 1
            if len(words) > 300_000:
                yield table(words, compounds, headers)
                words, compounds, headers = Counter(), Counter(), Counter()
        yield table(words, compounds, headers)

    return df.select(F.col(text).alias("text")).where("text is not null").mapInPandas(run, "kind string, form string, n long").groupBy("kind", "form").agg(F.sum("n").alias("n"))


class Lexicon:
    """Vocabulary with counts, as a trie, plus known compounds and headers."""

    def __init__(self, rows: list[tuple[str, str, int]], per_million: float = PER_MILLION):
        total = sum(n for k, _, n in rows if k == "w")
        least = max(3, total * per_million / 1e6)
        raw = {f: n for k, f, n in rows if k == "w" and n >= least and f.isalpha()}
        # a frequent misreading of a far more frequent word is no word
        self.words = {w: n for w, n in raw.items() if not any(raw.get(v, 0) > 20 * n for v in _undone(w))}
        # frequent codes with figures, such as names of analyses, are read as they stand
        self.codes = {f for k, f, n in rows if k == "w" and n >= least and not f.isalpha() and f.isalnum() and not any(raw.get(v, 0) > 0 for v in _undone(f))}
        self.known = frozenset(self.words) | self.codes
        self.compounds = {f for k, f, n in rows if k == "c" and n >= max(2, least / 3)}
        self.headers = {f for k, f, n in rows if k == "h" and n >= 3}
        self.trie: dict = {}
        for w in self.words:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.look_up = lru_cache(maxsize=200_000)(self._look_up)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "look_up"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.look_up = lru_cache(maxsize=200_000)(self._look_up)

    def _look_up(self, word: str) -> tuple[tuple[float, str], ...]:
        """All vocabulary words within one edit, or up to four misreadings, of ``word``: (cost, word)."""
        found: dict[str, float] = {}
        n = len(word)
        stack = [(self.trie, 0, 0.0)]
        seen: dict[tuple[int, int], float] = {}
        while stack:
            node, i, cost = stack.pop()
            mark = (id(node), i)
            if seen.get(mark, 9.0) <= cost:
                continue
            seen[mark] = cost
            if i == n:
                w = node.get("")
                if w is not None and cost < found.get(w, 9.0):
                    found[w] = cost
                if cost == 0.0:
                    for c, child in node.items():
                        if c:
                            stack.append((child, i, cost + 1))
                continue
            c = word[i]
            child = node.get(c)
            if child is not None:
                stack.append((child, i + 1, cost))
            for bad, good in _READ.get(c, ()):
                if cost + 0.25 <= 1.0 and word.startswith(bad, i):
                    at = node
                    for g in good:
                        at = at.get(g)
                        if at is None:
                            break
                    if at is not None:
                        stack.append((at, i + len(bad), cost + 0.25))
            if cost == 0.0:
                stack.append((node, i + 1, 1.0))
                for g, child in node.items():
                    if g and g != c:
                        stack.append((child, i + 1, 1.0))
                        stack.append((child, i, 1.0))
        return tuple(sorted((c, w) for w, c in found.items()))

    def correct(self, word: str, around: set[str] | None = None) -> tuple[str, bool] | None:
        """Best replacement of an unknown word, and whether it is explained by misreadings alone."""
        if len(word) < 4 or len(word) > 40:
            return None
        options = self.look_up(word)
        if not options:
            return None
        cost, best = min(options, key=lambda o: (round(o[0] * 4), -(around is not None and o[1] in around), -self.words[o[1]]))
        return best, cost < 1.0 or bool(_STRONG.search(word))


def _undone(word: str):
    """The word with one misreading undone."""
    for i in range(len(word)):
        for bad, good in _READ.get(word[i], ()):
            if word.startswith(bad, i):
                yield word[:i] + good + word[i + len(bad) :]


def lexicon(df: DataFrame, text: str, vocabulary: int = VOCABULARY, per_million: float = PER_MILLION) -> Lexicon:
    """Lexicon of all texts; the driver gets the most frequent forms: at most ``vocabulary`` words, and of compounds and headers
    their own number, so that none displaces another."""
    counted = materialize(count_forms(df, text).where("n > 1"))
    rows = [r for kind, most in (("w", vocabulary), ("c", COMPOUNDS), ("h", HEADERS)) for r in most_frequent(counted.where(F.col("kind") == kind), "n", most, "form").collect()]
    return Lexicon([(r.kind, r.form, r.n) for r in rows], per_million)


def _case(model: str, word: str) -> str:
    letters = [c for c in model if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[0].upper() + word[1:] if model[:1].isupper() else word


def repair(text: str, lex: Lexicon, title: bool = False) -> tuple[set[str], str]:
    """Kinds of noise in a text and the text repaired; ``title``: the whole text is a title block, set in large type."""
    kinds: set[str] = set()
    words = lex.words
    lines = text.split("\n")
    if len(lines) > 1 or len(text) < 91:
        kept = []
        for k, line in enumerate(lines):
            short = line.strip()
            if short and len(short) < 91:
                if is_page_number(short):
                    kinds.add("pagina")
                    continue
                form = None if title else header_form(short)
                if form and not (k == 0 and len(lines) > 1 and HEADING.match(lines[1])) and (form in lex.headers or _YEAR.search(short) and (short.upper() == short or re.search(r"\s[·—|]\s", short) or re.match(r"(?i)gu[ií]a\b", short))):
                    kinds.add("cabecera")
                    continue
            kept.append(line)
        text = "\n".join(kept)

    def join(m: re.Match) -> str:
        a, b, inline = m[1], m[3], "\n" not in m[2]
        low_a, low_b = a.lower(), b.lower()
        whole = low_a + low_b
        if whole in words:
            kinds.add("guion")
            return a + b
        if f"{low_a}-{low_b}" in lex.compounds or b[:1].isupper() and not a.isupper():
            return m[0] if inline else f"{a}-{b}"
        both = (low_a in words or len(a) < 4) and (low_b in words or len(b) < 4)
        fixed = lex.correct(whole)
        if fixed and fixed[1] and not (both and inline):
            kinds.update(("guion", "ocr"))
            return _case(a, fixed[0])
        if inline:
            return m[0]
        if low_a in words and low_b in words:
            return f"{a}-{b}"
        kinds.add("guion")
        return a + b

    if _BREAK.search(text):
        text = _SPLIT.sub(join, text)
    around = set(TOKEN.findall(text.lower()))
    # beyond 40 characters it is no word
    strange = {t for t in around - lex.known if 3 < len(t) < 41 and not t.isdigit() and not t[1:-1].isdigit()}
    if strange:
        unknown = [t for t in set(TOKEN.findall(text)) if t.lower() in strange]
        changes = {}
        for t in unknown:
            low = t.lower()
            digits = sum(c.isdigit() for c in low)
            if digits and (digits > len(low) / 2 or low[0].isdigit() and not _STRONG.search(low) or any(c.isupper() for c in t[1:]) and any(c.islower() for c in t) or t.upper() == t and digits > 1):
                continue
            core = low.strip("!¡|")
            if core in words or len(core) < 4:
                continue
            fixed = lex.correct(core, around)
            if fixed and fixed[1]:
                kinds.add("ocr")
                changes[t] = _case(t, fixed[0])
            elif _STRONG.search(core) and not t.isupper():
                kinds.add("ocr")
        if changes:
            text = TOKEN.sub(lambda m: changes.get(m[0], m[0]), text)
    return kinds, text


def reflow(text: str) -> str:
    """Lines to paragraphs: blank lines, headings, list items and table rows keep their line, other breaks become blanks."""
    out: list[str] = []
    for line in text.replace("\r", "").split("\n"):
        line = line.strip()
        if not line:
            if out and out[-1]:
                out.append("")
        elif not out or not out[-1] or HEADING.match(line) and len(line) < 90 or HEADING.match(out[-1]) and len(out[-1]) < 90 or _LISTED.match(line) or line[0] == "|" or out[-1][0] == "|":
            out.append(line)
        else:
            out[-1] += " " + line
    return "\n".join(out).strip()


def clean(df: DataFrame, text: str, keys: list[str], lex: Lexicon, size: str | None = None, title_size: float = 12.0) -> DataFrame:
    """Rows (keys, kinds, repaired) of every row with a non-null text: kinds of noise found, sorted, and the text as paragraphs.

    ``size``: column with the type size, from ``title_size`` on a short text is a title and no header. Empty texts have no
    noise. Repeated rows give repeated rows; texts are read whole; other columns are dropped.
    """
    rows = df.select(*keys, F.col(text).alias("__text"), (F.coalesce(F.col(size), F.lit(0.0)) if size else F.lit(0.0)).alias("__size")).where("__text is not null")
    kinds_of = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            done = [repair(t, lex, s >= title_size) for t, s in zip(batch["__text"], batch["__size"])]
            out = batch[keys].copy()
            out["kinds"] = [sorted(k) for k, _ in done]
            out["repaired"] = [reflow(t) for _, t in done]
            yield out

    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds_of[k]}" for k in keys) + ", kinds array<string>, repaired string")


def paragraphs(blocks: DataFrame, document: str, order: str, text: str, block: int = 4096) -> DataFrame:
    """Repaired blocks of documents as paragraphs in reading order: rows (document, number, text), number from 1.

    A block that begins in the middle of the sentence the one before ends with continues its paragraph. Blocks without
    text are left out, a repeated (document, order) counts once. A document of any length is read in runs of ``block``
    places that hand their end on; no document is gathered.
    """
    rows = blocks.select(F.col(document).alias("d"), F.col(order).alias("o"), F.col(text).alias("t")).where("d is not null and o is not null and coalesce(t, '') <> ''").groupBy("d", "o").agg(F.min("t").alias("t"))
    rows = rows.withColumn("run", F.floor(F.col("o") / block))
    w = Window.partitionBy("d", "run").orderBy("o")
    ends = rows.groupBy("d", "run").agg(F.max_by(F.right("t", F.lit(1)), "o").alias("end"))
    before = ends.select("d", "run", F.lag("end").over(Window.partitionBy("d").orderBy("run")).alias("end_before"))
    placed = rows.withColumn("last", F.lag(F.right("t", F.lit(1))).over(w)).join(before, ["d", "run"])
    end = F.coalesce("last", "end_before")
    started = placed.withColumn("start", F.when(end.rlike("[\\p{Ll},]") & F.col("t").rlike("^\\p{Ll}"), 0).otherwise(1)).select("d", "run", "o", "t", "start")
    sums = started.groupBy("d", "run").agg(F.sum("start").alias("s"))
    offset = sums.select("d", "run", (F.sum("s").over(Window.partitionBy("d").orderBy("run")) - F.col("s")).alias("offset"))
    numbered = started.withColumn("n", F.sum("start").over(w)).join(offset, ["d", "run"]).select("d", (F.col("n") + F.col("offset")).alias("n"), "o", "t")
    joined = numbered.groupBy("d", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda p: p["t"]), " ").alias("t"))
    return joined.select(F.col("d").alias(document), F.col("n").cast("long").alias("number"), F.col("t").alias("text"))


def passage_paragraphs(passages: DataFrame, passage: str, text: str) -> DataFrame:
    """Repaired passages, each by itself, as paragraphs: rows (passage, number, text), number from 1.

    A passage is divided at its blank lines; a repeated passage counts once, as do repeated blocks.
    """
    once = passages.select(passage, text).where(f"`{passage}` is not null").groupBy(passage).agg(F.min(text).alias(text))
    return paragraphs(once.select(passage, F.posexplode(F.split(text, "\n{2,}")).alias("__place", text)), passage, "__place", text)
