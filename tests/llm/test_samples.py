from lumbre.llm.samples import bounded_sample, most_frequent


def test_bounded(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = [r.k for r in bounded_sample(df, "k", 300).collect()]
    assert len(got) == len(set(got)) == 300 and got == [r.k for r in bounded_sample(df, "k", 300).collect()]
    assert bounded_sample(df, "k", 9000).count() == 5000 and bounded_sample(df.limit(0), "k", 5).count() == 0


def test_most_frequent(spark):
    df = spark.createDataFrame([(i, 1 + i % 100) for i in range(1000)], "k int, n long")
    got = [r.n for r in most_frequent(df, "n", 255, "k").collect()]
    assert sorted(got, reverse=True) == sorted((1 + i % 100 for i in range(1000)), reverse=True)[:255]
    assert most_frequent(df, "n", 5000, "k").count() == 1000 and most_frequent(df.limit(0), "n", 5, "k").count() == 0
    # one class of counts that is larger than the bound
    same = most_frequent(df.withColumn("n", df.n * 0 + 7), "n", 40, "k")
    assert same.count() == 40 and {r.k for r in same.collect()} == {r.k for r in same.collect()}
