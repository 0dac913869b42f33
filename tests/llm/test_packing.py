import random

from hypothesis import given, settings, strategies as st

from lumbre.llm import packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.sampled_from("abc"), st.sampled_from([None, 1, 2, 3])), max_size=60))
def test_no_overflow_no_conflict(items):
    bins = packing.best_fit([n for n, *_ in items], [s for _, s, _ in items], [c for *_, c in items], 50)
    used, held = {}, {}
    for (n, _, c), b in zip(items, bins):
        used[b] = used.get(b, 0) + n
        assert c is None or c not in held.setdefault(b, set())
        if c is not None:
            held[b].add(c)
    assert all(v <= 50 for v in used.values())


def test_tight():
    r = random.Random(1)
    sizes = [r.randint(20, 600) for _ in range(4000)]
    bins = packing.best_fit(sizes, ["x"] * 4000, [None] * 4000, 2048)
    assert len(set(bins)) <= 1.01 * sum(sizes) / 2048 + 1


def test_operator(spark):
    rows = [(1, "palabra " * 900, "a", 7), (2, "uno dos tres", "a", 7), (3, "uno dos tres", "b", None), (4, "", "b", None), (5, None, "b", None), (6, "x" * 30000, None, None), (6, "x" * 30000, None, None), (None, "y", "a", 1)]
    df = spark.createDataFrame(rows, "id long, t string, source string, cluster long").withColumn("tokens", packing.F.lit(0))
    items = packing.sized(df, "id", "t", carry=["source", "cluster"])
    for group in (20_000, 1):
        got = packing.pack(items, 100, group).collect()
        size = {r.key: r.tokens for r in items.collect()}
        assert set(size) == {1, 2, 3, 4, 6}
        for k, n in size.items():
            mine = sorted((r.part, r.first, r.tokens) for r in got if r.key == k)
            assert sum(t for *_, t in mine) == n and [p for p, *_ in mine] == list(range(1, len(mine) + 1)) and all(f == sum(t for q, _, t in mine if q < p) for p, f, _ in mine)
            assert len(mine) == max(1, -(-n // 100))
        fill = {}
        for r in got:
            if r.container:
                fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert max(fill.values()) <= 100 and {r.container for r in got if r.key == 4} == {None}
    assert packing.pack(items.limit(0)).count() == 0 and packing.report(packing.pack(items.limit(0))).collect()[0].containers == 0
