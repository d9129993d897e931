"""Joins along time against all pairs, with one key that has most rows."""

import random
from datetime import datetime, timedelta

import pytest

from tarnwork.operators import temporal

START = datetime(2024, 2, 28, 23, 0)


def made(seed, n, keys=4, span=400_000):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0] * 5 + list(range(keys)) + [None]), None if rng.random() < 0.03 else START + timedelta(seconds=rng.randint(0, span) // 60 * 60)) for i in range(n)]
    return rows + rows[:3]


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def kind(request):
    return request.param


def frames(spark, kind, *sides):
    return [spark.createDataFrame(s, f"id long, k long, t {kind}").repartition(3) for s in sides]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("slice_seconds", [600, 86_400, 10**9])
def test_as_of(spark, kind, strict, slice_seconds):
    a, b = made(1, 150), made(2, 60)
    left, right = frames(spark, kind, a, b)
    got = temporal.as_of(left, right, "k", "t", "id", slice_seconds=slice_seconds, strict=strict)
    assert got.columns == ["id", "k", "t", "id_last", "k_last", "t_last"]

    def last(k, t):
        found = [(u, j) for j, m, u in b if k is not None and m == k and t is not None and u is not None and (u < t or u == t and not strict)]
        return max(found)[1] if found else None

    assert sorted(map(str, ((r.id, r.id_last) for r in got.collect()))) == sorted(map(str, ((i, last(k, t)) for i, k, t in a)))


def test_as_of_of_empty_sides(spark, kind):
    left, right = frames(spark, kind, made(3, 5), [])
    assert {r.id_last for r in temporal.as_of(left, right, "k", "t", "id").collect()} == {None}
    assert temporal.as_of(right, left, "k", "t", "id").count() == 0


@pytest.mark.parametrize("seconds", [0, 60, 5000])
def test_near(spark, kind, seconds):
    a, b = made(4, 120), made(5, 80)
    left, right = frames(spark, kind, a, b)
    got = sorted((r.id, r.id_near) for r in temporal.near(left, right, "k", "t", seconds).collect())
    assert got == sorted((i, j) for i, k, t in a for j, m, u in b if k is not None and k == m and t and u and abs((t - u).total_seconds()) <= seconds) and got


def test_within_intervals_of_all_lengths(spark, kind):
    rng = random.Random(6)
    points = made(7, 120)
    spans = [(j, k, t, None if t is None or rng.random() < 0.05 else t + timedelta(seconds=rng.choice([-60, 0, 1, 60, 3600, 10**5, 10**7]))) for j, k, t in made(8, 80)]
    left = frames(spark, kind, points)[0]
    right = spark.createDataFrame(spans, f"id long, k long, low {kind}, high {kind}")
    got = sorted((r.id, r.id_in) for r in temporal.within(left, right, "k", "t", "low", "high").collect())
    assert got == sorted((i, j) for i, k, t in points for j, m, lo, hi in spans if k is not None and k == m and t and lo and hi and lo <= t < hi) and got
    assert temporal.within(left, right.filter("id < 0"), "k", "t", "low", "high").count() == 0


def test_a_hot_key_is_spread(spark):
    """One key with all rows: no task of the sort gets more than a slice's share."""
    rows = spark.range(4000).selectExpr("id", "0L AS k", "timestamp_seconds(id * 3600) AS t")
    got = temporal.as_of(rows, rows, "k", "t", "id", strict=True, slice_seconds=86_400)
    assert got.filter("id > 0 AND id_last = id - 1").count() == 3999
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in got.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 4 and max(sizes) < 2000


@pytest.mark.parametrize("slice_seconds", [600, 86_400])
def test_islands(spark, kind, slice_seconds):
    rows = made(9, 150)
    df = frames(spark, kind, rows)[0]
    starts, last = {}, {}
    for k, t in sorted({(k, t) for _, k, t in rows if k is not None and t}):
        starts[k, t] = t if k not in last or (t - last[k]).total_seconds() >= 7200 else starts[k, last[k]]
        last[k] = t
    got = temporal.islands(df, "k", "t", "id", 7200, slice_seconds)
    assert got.columns == ["id", "k", "t", "island_start"]
    assert sorted(map(str, ((r.id, r.island_start) for r in got.collect()))) == sorted(map(str, ((i, starts.get((k, t))) for i, k, t in rows)))
    assert len(set(starts.values())) > 5


def test_exploded_sides_are_not_broadcast(spark):
    """Spark estimates them without what explode adds, so that the driver would hold each point once for every level."""
    points = spark.range(100).selectExpr("id", "id % 5 AS k", "timestamp_seconds(id * 60) AS t")
    spans = points.selectExpr("id", "k", "t AS low", "timestamp_seconds(id * 60 + pow(2, id % 20)) AS high")
    for pairs in (temporal.within(points, spans, "k", "t", "low", "high"), temporal.near(points, points, "k", "t", 600)):
        assert pairs.count() > 100
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
