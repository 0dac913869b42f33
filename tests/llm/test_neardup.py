import random

import numpy as np

from lumbre.llm import neardup


def brute(rows, n, t):
    sets = {}
    for i, x in rows:
        if i is not None and x is not None:
            w = neardup.WORD.findall(x.lower())
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def sample(seed, n=60, hot=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = r.choices(words, k=r.randint(20, 60)) if i % 3 == 0 or not rows else rows[-1][1].split()
        base = list(base)
        for _ in range(r.randint(0, 2)):
            base[r.randrange(len(base))] = r.choice(words)
        rows.append((f"d{i:03d}", " ".join(base)))
    for i in range(hot):
        base = rows[0][1].split()
        base[r.randrange(len(base))] = r.choice(words)
        rows.append((f"h{i:03d}", " ".join(base)))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = sample(1, hot=40) + [("e1", ""), ("e2", ""), ("s1", "uno dos"), ("s2", "uno dos"), ("n1", None), (None, "uno dos tres cuatro"), ("c1", "uno dos tres cuatro"), ("c2", "uno dos tres cuatro"), ("c2", "uno dos tres cuatro"), ("L", "palabra " * 20000)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "k string, t string, id int, tid string")
    for n, t in ((3, 0.5), (2, 0.8)):
        got = {(x.id_a, x.id_b) for x in neardup.similar_rows(df, "k", "t", n, t).collect()}
        assert got == brute(rows, n, t)


def test_groups(spark):
    rows = sample(2)
    df = spark.createDataFrame(rows, "k string, t string")
    got = {x.id: x for x in neardup.similar_groups(df, "k", "t", 3, 0.5).collect()}
    pairs = brute(rows, 3, 0.5)
    assert set(got) == {a for a, _ in rows}
    group = {a: a for a, _ in rows}
    for _ in range(len(rows)):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert {k: v.group for k, v in got.items()} == group
    text = dict(rows)
    assert {k: v.links for k, v in got.items()} == {k: len({text[b if a == k else a] for a, b in pairs if k in (a, b)} - {text[k]}) for k in got}


def test_tree_loses_nothing():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for _ in range(150):
        keep = base[r.random(60) < r.choice([0.3, 0.8, 0.95])]
        sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, r.integers(1, 40)).astype(np.uint64)])))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    maps = neardup.bitmaps(np.concatenate(sets), owner, len(sets))
    sizes = np.array([len(s) for s in sets], np.uint32)
    for t in (0.5, 0.8):
        found = {(min(a, b), max(a, b)) for x, y in neardup.Forest(sizes, maps).pairs(t) for a, b in zip(x.tolist(), y.tolist())}
        need = {(a, b) for a in range(150) for b in range(a + 1, 150) if len(np.intersect1d(sets[a], sets[b])) >= t * len(np.union1d(sets[a], sets[b]))}
        assert need <= found


def test_empty(spark):
    empty = spark.createDataFrame([], "k string, t string")
    assert neardup.similar_rows(empty, "k", "t").count() == 0
    assert neardup.similar_groups(empty, "k", "t").count() == 0


def test_shape_keeps_the_chance_of_a_miss():
    for threshold in (0.5, 0.8):
        rows, bands = neardup.shape(threshold)
        assert (1 - threshold**rows) ** bands <= neardup.MISS


def test_forest_searches_every_group_by_itself():
    r = np.random.default_rng(3)
    groups = np.sort(r.integers(0, 40, 300))
    sizes = r.integers(5, 60, 300).astype(np.uint32)
    maps = np.zeros((300, neardup.SIGNATURE), np.uint64)
    for i in range(300):
        for token in r.integers(0, 90, sizes[i]):
            maps[i, token % neardup.SIGNATURE] |= np.uint64(1) << np.uint64(token % 64)
    sizes = np.maximum(sizes, np.bitwise_count(maps).sum(1)).astype(np.uint32)
    forest = neardup.Forest(sizes, maps, groups)
    got = [(min(a, b), max(a, b)) for x, y in forest.pairs(0.5) for a, b in zip(x.tolist(), y.tolist())]
    i, j = np.triu_indices(300, 1)
    ok = (groups[i] == groups[j]) & neardup.possible(sizes[i], maps[i], sizes[j], maps[j], 0.5)
    assert len(got) == len(set(got)) and set(got) == set(zip(i[ok].tolist(), j[ok].tolist()))
    assert forest.pruned > 0 and not sum(len(x) for x, _ in neardup.Forest(sizes[:0], maps[:0]).pairs(0.5))
