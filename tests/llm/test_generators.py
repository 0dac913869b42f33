"""Quick ways to candidate spans and word counts against the plain patterns."""

import random
import re
from collections import Counter

import numpy as np

from lumbre.llm import pii
from lumbre.llm.pii import L, U

PIECES = "c/ Mayor|C. Sol 3|Cl. Luz|cl.x|pl. a|P.º del Prado|pº Sur|PSO. Mar|víaje|callejón Luna|callejaX|CALLEMAYOR 3|c /x|p. ej|_calle Luna|9calle Luna|paſeo Luna|İ|vıa Luna|urb. Sol|pol. Ind|trav. X|Gta. Y|Rda.Z|C/Sol|Ana|José-Luis O'Neill|MARÍA de la O|A. B. Pérez|x@y.es|uno|DOS|tres cuatro cinco seis siete ocho|me llamo ana|\n|.|-|/|@|  |,|é|Ł|ß|b.c en d.es|PolíGono Sur|BULEVAR Sol|psje. A|av.C|Av. del Mar 3, 28001 Soria|dolores|dolores ruiz".split("|")


def _texts():
    r = random.Random(4)
    return ["".join(r.choice(PIECES) + r.choice(["", " ", " "]) for _ in range(r.randint(1, 9))) for _ in range(8000)] + PIECES + [""]


def test_names_begin_as_before():
    token, join = pii._TOKEN, pii._JOIN
    name = re.compile(rf"(?<![\w@.\-/])(?:(?:{token}|[{U}]\.)(?:(?:\s+{join}\s+|\s+|-|\s*,\s+)(?:{token}|[{U}]\.)(?:-{token})?){{1,4}})(?![\w@])")
    single = re.compile(rf"(?<![\w@.\-/]){token}(?:-{token})?(?![\w@])")
    for t in _texts():
        for quick, plain in ((pii._NAME, name), (pii._SINGLE, single), (pii._CAPITAL, re.compile(rf"(?<=[{L},] )[{U}][{L}]+(?!\w)"))):
            assert [m.span() for m in quick.finditer(t)] == [m.span() for m in plain.finditer(t)], t
        assert bool(pii._DOTTED.search(t)) == bool(re.search(r"\w\.[a-z]{2}", t))


def test_words_tell_what_to_look_for():
    for shares in (np.zeros(pii.CASES, np.uint8), pii.prior_shares()):
        for t in _texts():
            told = pii._telling(t, shares)
            words = set(pii._LOWERCASE.findall(t))
            assert {w for w, marks in told.items() if marks[2]} == {w for w in words if pii._odd(w, shares)}
            assert {w for w, marks in told.items() if marks[1]} == words & pii._DIGIT_WORDS and {w for w, marks in told.items() if marks[3]} == words & pii._LOWER_CUES
            # no address is lost
            assert not pii._PLACE.search(t) or any(marks[0] for marks in told.values()), t


def test_counts_of_cases(spark):
    texts = _texts()[:3000] + ["Un Caso de lupus, Lupus activo. LUPUS y lupus9 Eritema " * 3]
    low, up = Counter(), Counter()
    for t in texts:
        for table, pattern, weight in ((low, rf"(?<!\w)[{L}]{{2,}}(?!\w)", 4), (up, rf"(?<!\w)[{U}][{U}{L}]+(?!\w)", 1), (up, rf"(?<=[{L},] )[{U}][{L}]+(?!\w)", 3)):
            for w in re.findall(pattern, t):
                table[pii._place(w.lower())] += weight
    low.update(pii._prior())
    want = np.zeros(pii.CASES, np.uint8)
    for at in {*low, *up}:
        if low[at] + up[at] >= 16:
            want[at] = int(10 * low[at] / (low[at] + up[at]) + 0.5)
    assert (pii.case_shares(spark.createDataFrame([(t,) for t in [*texts, None]], "t string"), "t") == want).all()
