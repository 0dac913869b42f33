from lumbre.llm import mixing


def test_redistribution():
    assert mixing.fill([0.5, 0.3, 0.2], [100, 100, 100], 100) == [50, 30, 20]
    assert mixing.fill([0.5, 0.3, 0.2], [20, 100, 100], 100) == [20, 48, 32]
    assert mixing.fill([1, 1], [10, 20], 100) == [10, 20]
    # the shortage of a source stays in its language while that has room
    leaves = [(("d", "es", "a"), 0.4, 10), (("d", "es", "b"), 0.1, 100), (("d", "en", "c"), 0.5, 100)]
    assert mixing.budgets(leaves, 100) == {("d", "es", "a"): 10, ("d", "es", "b"): 40, ("d", "en", "c"): 50}


def test_mix(spark):
    rows = [(i, "grande" if i % 3 else "chica", "es", 10 + i % 7) for i in range(3000)] + [(9001, None, "es", 50), (9002, "nadie", "es", 50), (9003, "chica", "es", 0)]
    items = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long")
    weights = spark.createDataFrame([("grande", 0.3, 1), (" CHICA ", 0.6, 2), ("vacia", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(items, weights)
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got)
    out = {r.source: r for r in report.collect()}
    assert out["vacia"].tokens == 0 and out["(otras)"].target_share == 0 and out["(otras)"].tokens == 0
    supply = {s: sum(t for _, x, _, t in rows if x == s) for s in ("grande", "chica")}
    total = sum(supply.values())
    assert max(r.copies for r in got if r.source == "chica") <= 2 and max(r.copies for r in got if r.source == "grande") == 1
    want = mixing.fill([0.3, 0.6], [supply["grande"], 2 * supply["chica"]], total)
    assert abs(out["grande"].tokens - want[0]) <= 17 and abs(out["chica"].tokens - want[1]) <= 17
    assert abs(sum(r.share for r in out.values()) - 1) < 1e-4
    again, _ = mixing.mix(items, weights)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    chosen, report = mixing.mix(items.limit(0), weights)
    assert chosen.count() == 0 and {r.tokens for r in report.collect()} == {0}
