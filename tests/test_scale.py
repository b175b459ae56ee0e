"""Skewed groups, null keys and partition counts."""

import pytest
from pyspark.sql import functions as F

from graftwork.operators import scale as S


def skewed(spark, n=20_000):
    # One group holds most rows, one key is null.
    return spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 == 1, "b").otherwise("hot").alias("k"),
        ((F.col("id") * 7919) % n).alias("v"),
    )


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_positions_number_a_hot_group(spark, parts):
    out = S.positions(skewed(spark).repartition(parts), ["k"], ["v"], "p").toPandas()
    for _, group in out.groupby("k", dropna=False):
        ordered = group.sort_values("v")
        assert ordered["p"].tolist() == list(range(len(ordered)))
    assert len(out) == 20_000


def test_positions_without_pinned_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "pinned", lambda df, max_rows=0: None)
    out = S.positions(skewed(spark, 1_000), ["k"], [F.col("v").desc()], "p").toPandas()
    for _, group in out.groupby("k", dropna=False):
        assert group.sort_values("v", ascending=False)["p"].tolist() == list(range(len(group)))


def test_hot_group_spreads_over_tasks(spark):
    out = S.positions(skewed(spark), ["k"], ["v"], "p").filter("k = 'hot'")
    assert out.select(F.spark_partition_id().alias("t")).distinct().count() > 1 or out.rdd.getNumPartitions() == 1


def test_running_sums_cross_chunks(spark):
    n = 3 * S.RUN_CHUNK + 5
    df = spark.range(n).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("i"), F.lit(2).alias("x"))
    out = S.running_sums(df.repartition(13), ["k"], "i", {"x": "s"}).toPandas().sort_values("i")
    assert out["s"].tolist() == [2 * (i + 1) for i in range(n)]


def test_pin_small_and_broadcast_respect_the_bound(spark):
    df = spark.range(10)
    assert S.pinned(df, 9) is None and S.pinned(df, 10).table.num_rows == 10
    joined = spark.range(100).join(S.broadcast_checked(df, 5), "id")
    assert joined.count() == 10


def test_join_on_matches_nulls(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, b int")
    assert {(r.k, r.a, r.b) for r in S.join_on(a, b, ["k"]).collect()} == {("x", 1, 10), (None, 2, 20)}
    assert S.join_on(a, b, ["k"], "left_anti").count() == 0


def test_first_rows_beyond_the_window_threshold(spark):
    from graftwork.operators.scale import first_rows

    df = spark.range(20_000).selectExpr("CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS g", "id", "id % 7 AS o")
    got = first_rows(df, 5_000, ["g"], ["o", "id"])
    assert not any("Window" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "RowNumber" in line)
    rows = got.collect()
    for g in "ab":
        want = sorted((r.o, r.id) for r in df.filter(f"g = '{g}'").collect())[:5_000]
        assert [(r.o, r.id) for r in sorted((r for r in rows if r.g == g), key=lambda r: r["rank"])] == want


def test_many_small_groups_are_numbered_without_a_stored_copy(spark, monkeypatch):
    # 200,000 groups, and every hundredth row in one hot group.
    df = spark.range(600_000).selectExpr("IF(id % 20 = 0, -1, id % 200000) AS g", "id")
    hot = S.hot_groups(df, ["g"])
    assert hot.table.to_pydict() == {"g": [-1]}
    out = S.positions(df, ["g"], [F.col("id").desc()], "p")
    wrong = out.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("d"), F.min("p").alias("a"), F.max("p").alias("b"))
    assert wrong.filter("n <> d OR a <> 0 OR b <> n - 1").count() == 0
    assert out.filter("g = -1").agg(F.max_by("p", "id")).first()[0] == 0 and out.count() == 600_000

    def stored(self, *args):
        raise AssertionError("stored")

    monkeypatch.setattr(type(df), "checkpoint", stored)
    small = S.positions(df.filter("g >= 0"), ["g"], ["id"], "p")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and small.agg(F.max("p")).first()[0] == 2


def test_hot_groups_are_few(spark):
    df = spark.range(400_000).selectExpr("id % 20 AS g")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert S.hot_groups(df, ["g"]).table.num_rows == most
    out = S.positions(df.selectExpr("g", "monotonically_increasing_id() AS i"), ["g"], ["i"], "p")
    assert {(r.n, r.d, r.b) for r in out.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("d"), F.max("p").alias("b")).collect()} == {(20_000, 20_000, 19_999)}


def test_positions_of_no_rows(spark):
    assert S.positions(spark.range(0).selectExpr("id AS g", "id"), ["g"], ["id"], "p").count() == 0


@pytest.mark.parametrize("levels", [0, 1, 2, 3])
def test_running_sums_are_a_tree(spark, monkeypatch, levels):
    # Chunks of four: 1,000 positions of one key are five levels high.
    monkeypatch.setattr(S, "RUN_CHUNK", 4)
    df = spark.range(1_000).selectExpr("id % 2 AS k", "id div 2 AS i", "id * id AS x", "1 AS y")
    rows = S.running_sums(df, ["k"], "i", {"x": "s", "y": "t"}, levels).collect()
    for k in (0, 1):
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r.k == k), key=lambda r: r.i)):
            total += r.x
            assert (r.s, r.t) == (total, n + 1)
