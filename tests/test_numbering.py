"""Numbers over a whole table."""

from pyspark.sql import functions as F

from abaculus.operators.numbering import numbered


def test_numbers_follow_the_order_over_all_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select("id", (F.xxhash64("id") % 40).alias("k"), F.lit("x").alias("n_other"))
    got = {r.id: r.n for r in numbered(df, [F.col("k").desc(), F.col("id")], "n", 9).collect()}
    expected = {r.id: i for i, r in enumerate(df.orderBy(F.col("k").desc(), "id").collect(), 1)}
    assert got == expected


def test_ties_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a")], "k long, v string")
    assert sorted(r.n for r in numbered(df, [F.col("k")]).collect()) == [1, 2, 3]
    assert numbered(df.limit(0), [F.col("k")]).collect() == []


def test_numbers_within_groups(spark):
    df = spark.range(0, 4000, 1, 5).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    got = {r.id: r.n for r in numbered(df, [F.col("id").desc()], "n", 8, within=["g"]).collect()}
    seen, expected = {}, {}
    for r in df.orderBy(F.col("id").desc()).collect():
        expected[r.id] = seen[r.g] = seen.get(r.g, 0) + 1
    assert got == expected
