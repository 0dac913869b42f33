import random

import pytest

from lumbre.operators import forest


def brute(links):
    parent = {}
    for h, p in links:
        h = h.strip() if h else h
        p = (p or "").strip() or None
        if not h:
            continue
        parent.setdefault(h, None)
        if p:
            parent.setdefault(p, None)
            parent[h] = p if parent[h] is None else min(p, parent[h])
    out = {}
    for n in parent:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parent[x]
        if x is None:
            out[n] = (seen[-1], len(seen) - 1, seen[::-1])
        else:
            loop = seen[seen.index(x) :]
            out[n] = (min(loop), -1 if n in loop else -2, None)
    return out


@pytest.mark.parametrize("seed,fragment", [(1, 10_000), (2, 9), (3, 17), (4, 5)])
def test_against_brute_force(spark, seed, fragment):
    r = random.Random(seed)
    n = 150
    code = [f"c{i:04d}" for i in r.sample(range(5000), n)]
    links = [(code[i], code[max(0, i - r.randint(1, 4))] if r.random() < 0.9 else None) for i in range(1, n)]
    links += [(code[0], code[40]), (f" {code[5]} ", code[5]), (None, "c9"), ("  ", None), ("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y1", "x2"), ("y2", "y1")]
    links += links[:20] + [(f"w{i}", code[3]) for i in range(30)]
    r.shuffle(links)
    got = forest.resolve(spark.createDataFrame(links, "hijo string, padre string"), paths=True, fragment=fragment).collect()
    assert {x.node: (x.root, x.depth, x.path) for x in got} == brute(links)
    assert len(got) == len({x.node for x in got})


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "hijo string, padre string")
    assert forest.resolve(empty).count() == 0
    clash = spark.createDataFrame([("a", "b", 1, "z"), ("b", " ", 2, "z")], "hijo string, padre string, dist int, node string")
    assert {tuple(x)[:3] for x in forest.resolve(clash).collect()} == {("a", "b", 1), ("b", "b", 0)}


def test_descendants(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a")], "hijo string, padre string")
    below = forest.descendants(forest.resolve(links, paths=True))
    assert {tuple(x) for x in below.collect()} == {("a", 3, 2), ("b", 1, 1), ("c", 0, 0), ("d", 0, 0)}


@pytest.mark.parametrize("seed,fragment", [(1, 10_000), (2, 7)])
def test_closure_with_loops(spark, seed, fragment):
    r = random.Random(seed)
    links = [(f"c{i:02d}", f"c{max(0, i - r.randint(1, 4)):02d}") for i in range(1, 40)]
    links += [("x3", "x1"), ("x1", "x4"), ("x4", "x2"), ("x2", "x3"), ("y1", "x4"), ("y2", "y1"), ("y3", " x2 "), ("y4", "y3"), ("z", "z"), ("v", "z"), ("b2", "b1"), ("b1", "b2"), (None, "x1"), ("x1", "x4")]
    parent = {}
    for h, p in links:
        if h:
            parent[h] = p.strip()
    want = set()
    for n in {*parent, *parent.values()}:
        x, seen = n, []
        while x is not None and x not in seen:
            want.add((x, n, len(seen)))
            seen.append(x)
            x = parent.get(x)
    r.shuffle(links)
    got = [tuple(x) for x in forest.closure_of(spark.createDataFrame(links, "hijo string, padre string"), fragment=fragment).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("x1", "y2", 5) in want and ("z", "v", 1) in want
