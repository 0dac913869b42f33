"""Quick ways of judging answers against the plain ones."""

import random
import re

from lumbre.llm import pairs

PIECES = ["dosis de 12h a", "é", "Ñandú", "_la_", "12", "²", "ª", "½", "ß", "ł", "—", "“x”", "recomenda-se", "-se", "na", "null", "[3]", "[ 1, 2]", "<b>", "&nbsp;", "​", "⁠", "İ", "ſ", "٣", "1)", "(", "[", "...", "…", ":", " 3.", " 123.", "abc 12.", "\n", " ", ".", ",", "¿", "dos razones: 1) a"]


def _texts():
    r = random.Random(8)
    return ["".join(r.choice(PIECES) + r.choice(["", " "]) for _ in range(r.randint(1, 14))) for _ in range(6000)] + PIECES + [""]


def test_shares_of_words_add_up_exactly():
    shared = next(w for w, n in pairs._DF.items() if n == 5)
    k = next(k for k, words in pairs._SETS.items() if shared in words)
    for n in range(1, 40):
        assert pairs.language_scores(f"{shared} " * n)[k] == n / 5
    a, b = (next(w for w, n in pairs._DF.items() if n == m and w in pairs._SETS[k]) for m in (2, 5))
    assert pairs.language_scores(f"{a} " + f"{b} " * 3)[k] == pairs.language_scores(f"{b} " * 3 + a)[k] == 1.1


def test_languages_of_any_text():
    for t in _texts():
        scores = {}
        for w in pairs._WORDS.findall(t.lower()):
            for k, words in pairs._SETS.items():
                if w in words:
                    scores[k] = scores.get(k, 0) + 1 / pairs._DF[w]
        got = pairs.language_scores(t)
        assert list(got) == list(scores) and all(abs(got[k] - v) < 1e-9 for k, v in scores.items()), t


def test_plain_and_empty():
    for t in _texts():
        folded = "".join(pairs._FOLD.get(c, c) for c in t.lower())
        assert pairs._plain(t) == " ".join(re.findall(r"[a-z0-9]+", folded)), t
        bare = re.sub(r"<[^<>]*>|\[\s*\d+(?:\s*[,;\-]\s*\d+)*\s*\]|&nbsp;|[​-‏⁠﻿]", " ", t).strip().strip(pairs._STRIPPED).strip().lower()
        assert pairs.is_empty(t) == (bare in pairs.EMPTY or not any(c.isalnum() for c in bare)), t


def test_ends():
    for t in map(str.rstrip, _texts()):
        want = re.search(r"(?:…|\.\.\.|:|,|;|\(|\b\d{1,2}[.)]|[\[(]\d*)$", t) and not re.search(r"\w{3}[^\W\d_]*\s+\d{1,4}\.$", t) or re.search(r"\[\d*$", t)
        assert pairs._stops(t) == bool(want), t
        assert pairs._SENTENCE.split(t) == re.split(r"(?<=[.?!])\s+(?=[A-ZÁÉÍÓÚÑ¿¡])", t)
        assert not pairs._ANNOUNCED.search(t) or pairs._LISTED.search(t)
