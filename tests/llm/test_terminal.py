"""The terminal-context model of all answers against plain counts."""

import re
from collections import Counter

import numpy as np

from lumbre.llm import pairs
from lumbre.llm.boosting import Boosted


def test_counts_are_those_of_all_answers(spark):
    texts = [f"El cultivo tardó {i} días y el antibiograma informó (según el laboratorio) una concentración normal. Se repite rápidamente cada {i % 7} meses \"siempre\"!" + " [3]" * (i % 2) for i in range(7000)] + ["corto.", "sin final " * 20, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, c string")
    model = pairs.fit_terminal(df, "id", "c")
    whole = [t for t in map(pairs._whole, filter(None, texts)) if t]
    # each answer counts, not the first 6000
    assert len(whole) == 7000 and model.words == Counter(w for t in whole for w in pairs._TOKEN.findall(t.lower()))
    assert sum(n for k, n in model.ends.items() if len(k) == 1) / 2 > 3300
    assert model.cut(["El cultivo tardó 3 días y el", "El cultivo tardó 12 días y el antibiograma informó (según el laboratorio) una concentración normal"]).tolist() == [True, False]
    assert pairs.fit_terminal(df.limit(0), "id", "c").cut(["Sí."]).tolist() == [False]


def test_context_counts():
    texts = ["Uno dos tres cuatro.\") Cinco seis siete ocho (nueve)! ¿Diez?", "Otra cosa."]
    got = pairs.context_counts(texts, [True, False])
    ends, goes = Counter(), Counter()
    for s in re.split(r"(?<=[.?!])\s+(?=[A-ZÁÉÍÓÚÑ¿¡])", texts[0]):
        tokens = pairs.Terminal._tokens(s.rstrip(".?!\"») "))
        for n in (1, 2, 3):
            if len(tokens) >= n:
                ends[tuple(tokens[-n:])] += 1
            for i in range(3, len(tokens)):
                goes[tuple(tokens[i - n : i])] += 1
    rows = got[got["n"] > 0]
    assert {tuple(g.split()): n for g, n in zip(rows["gram"], rows["ends"]) if n} == ends and {tuple(g.split()): n for g, n in zip(rows["gram"], rows["goes"]) if n} == goes
    assert dict(zip(got[got["n"] == 0]["gram"], got[got["n"] == 0]["words"])) == Counter(w for t in texts for w in pairs._TOKEN.findall(t.lower()))


def test_counted_rows_fit_as_repeated_ones():
    r = np.random.default_rng(3)
    x = r.integers(0, 90, (400, 2)).astype(float)
    values, counts = np.unique(x[:, 0], return_counts=True)
    e = Boosted().edge(values, counts)
    assert np.allclose(e, np.unique(np.quantile(x[:, 0], np.linspace(0, 1, 33)[1:-1])))
    b, y, n, held = (x // 10).astype(np.int32), (x[:, 0] > x[:, 1]).astype(float), r.integers(1, 5, 400), r.random(400) < 0.25
    one, many = Boosted(10, 3), Boosted(10, 3)
    one.edges = many.edges = [np.arange(1, 9) * 10.0] * 2
    one.fit_counted(b, y, n.astype(float), held)
    many.fit_counted(np.repeat(b, n, 0), np.repeat(y, n), np.ones(n.sum()), np.repeat(held, n))
    assert np.allclose(one.predict(x), many.predict(x)) and one.threshold == many.threshold
