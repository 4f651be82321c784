import random

from pyspark.sql import functions as F

from siftwell.operators.ordered import running, top_per_group


def test_running_sum_and_max_with_a_hot_group(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, *range(9)])) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i long, v long")
    for how, start, step in (("sum", 0, lambda a, v: a + (v or 0)), ("max", None, lambda a, v: v if a is None else a if v is None else max(a, v))):
        want, state = {}, {}
        for g, i, v in data:
            state[g] = step(state.get(g, start), v)
            want[i] = state[g]
        got = {r.i: r.o for r in running(df, ["g"], [F.col("i")], "v", "o", how).collect()}
        assert got == want


def test_running_over_everything_and_nothing(spark):
    df = spark.range(1000).withColumn("one", F.lit(1).cast("long"))
    out = running(df, [], [F.desc("id")], "one", "place")
    assert out.where("place = 1000 - id").count() == 1000
    assert running(df.limit(0), [], [F.col("id")], "one", "place").count() == 0


def test_top_per_group_keeps_ties_by_order_and_ignores_bad_sizes(spark, rows):
    df = spark.createDataFrame([(1, i % 3, i, 2) for i in range(50)] + [(2, 0, 0, 0), (3, 0, 0, None)], "g int, s int, i int, n int")
    out = top_per_group(df, ["g"], [F.desc("s"), F.asc("i")], "n", 2)
    assert rows(out.select("g", "i", "rank")) == [(1, 2, 1), (1, 5, 2)]
    assert top_per_group(df, ["g"], [F.asc("i")], "n", 0).count() == 0


def test_join_counted(spark, rows):
    from siftwell.operators.ordered import join_counted

    left = spark.createDataFrame([("a", i) for i in range(30_000)] + [("b", -1), (None, -2), ("z", -3)], "k string, i int")
    right = spark.createDataFrame([("a", 30_000, 1), ("b", 1, 2), (None, 1, 3), ("c", 0, 4)], "k string, n long, v int")
    out = join_counted(left, right, ["k"], "n", 30_003)
    assert out.count() == 30_002 and sorted(out.columns) == ["i", "k", "n", "v"]
    assert rows(out.where("i < 0").select("k", "v")) == [("b", 2), (None, 3)] and out.where("k = 'a' and v = 1").count() == 30_000
    assert join_counted(left.limit(0), right, ["k"], "n", 0).count() == 0
