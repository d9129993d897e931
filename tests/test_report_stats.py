import pytest
from pyspark.sql import functions as F

from tarnwork.functions import cut, fixed
from tarnwork.operators import report, stats


def test_guards_run_on_after_errors(spark):
    def skipped():
        report.require("no_such_module_here")

    def broken():
        raise KeyError("x")

    seen = report.run_guards(spark, [("one", lambda: "fine"), ("two", skipped), ("three", broken), ("four", lambda: None)])
    rows = {r.guard: r.status for r in seen.collect()}
    assert rows == {"one": "PASS", "two": "SKIP", "three": "FAIL", "four": "PASS"}
    assert {r.status: r.n for r in report.count_statuses(seen).collect()} == {"PASS": 2, "SKIP": 1, "FAIL": 1}
    assert report.exit_status(seen) == 1 and report.exit_status(seen.filter("status <> 'FAIL'")) == 0
    assert {r.status: r.n for r in report.count_statuses(seen.filter("1 = 0")).collect()} == {"PASS": 0, "SKIP": 0, "FAIL": 0}


def test_formatting(spark):
    row = spark.range(1).select(fixed(F.lit(1 / 3)).alias("x"), cut(F.lit("m" * 50)).alias("m")).first()
    assert row.x == "0.33" and len(row.m) == 40


def test_cochange(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "a"), (3, "a"), (3, "c"), (None, "a"), (4, None)], "g int, i string")
    assert [tuple(r) for r in stats.cochange_pairs(rows, "g", "i").collect()] == [("a", "b", 2)]


def test_mcnemar(spark):
    rows = spark.createDataFrame([(True, False)] * 6 + [(False, True)] * 2 + [(True, True)], "x boolean, y boolean")
    row = stats.mcnemar(rows, F.col("x"), F.col("y")).first()
    assert (row.b, row.c, row.chi2) == (6, 2, 2.0)
    assert stats.chi2_p(row.chi2) == pytest.approx(0.1572992, abs=1e-6)
    assert tuple(stats.mcnemar(rows.filter("x AND y"), F.col("x"), F.col("y")).first()) == (0, 0, None)
    assert tuple(stats.mcnemar(rows.filter("1 = 0"), F.col("x"), F.col("y")).first()) == (0, 0, None)


def test_fit_and_position(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(5)], "x double, y double")
    assert tuple(stats.linear_fit(line, "x", "y").first()) == (2.0, 1.0, 1.0)
    turns = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "g int, t int, m double")
    assert {r.bin: (r.n, r["mean"]) for r in stats.position_effect(turns, "g", "t", F.col("m")).collect()} == {"head": (1, 0.0), "middle": (1, 1.0), "tail": (2, 2.5)}


def test_pivot_and_pairs(spark):
    scores = spark.createDataFrame([("a", "off", 4.0), ("b", "off", 2.0), ("a", "on", 1.0)], "item string, arm string, value double")
    row = stats.pivot_scores(scores, ["off", "on"]).first()
    assert (row.sum_off, row.sum_on, row.mean_off, row.drop, row.factor) == (6.0, 1.0, 3.0, 5.0, 3.0)
    zero = stats.pivot_scores(scores.withColumn("value", F.lit(0.0)), ["off", "on"]).first()
    assert zero.factor is None
    off, on = scores.filter("arm = 'off'"), scores.filter("arm = 'on'")
    assert tuple(stats.paired_difference(off, on, "item", "value").first()) == (1, 3.0)


def test_digest_and_groups(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    assert {r.id: r.md5 for r in stats.digests(rows, "id").collect()} == {1: "0cc175b9c0f1b6a831c399e269772661", 2: None}
    assert tuple(stats.by_group(rows.withColumn("g", F.lit("x")), "g", "id").first()) == ("x", 2, 1.5)


def test_an_error_in_a_model_skips(spark):
    def lost():
        raise OSError("gone " * 20)

    row = report.run_guards(spark, [("m", lambda: report.or_skip(lost, "not loaded"))]).first()
    assert row.status == "SKIP" and row.reason == ("not loaded: " + "gone " * 20)[:40]
    assert report.or_skip(lambda: 3, "x") == 3
    assert report.run_guards(spark, []).count() == 0


def test_cochange_of_a_huge_group(spark):
    """Dealt into blocks or not, each pair is found once."""
    rows = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(60)] + [(3, 5), (3, 6), (4, 99)], "g int, i int")
    want = {(a, b): 3 if (a, b) == (5, 6) else 2 for a in range(60) for b in range(a + 1, 60)}
    got = stats.cochange_pairs(rows, "g", "i", block=7).collect()
    assert {(r.a, r.b): r.n for r in got} == want and len(got) == len(want)
    assert stats.cochange_pairs(rows, "g", "i", support=1, block=7).count() == len(want)


def test_scores_and_positions(spark, tmp_path):
    from tarnwork.sources import json_scores

    (tmp_path / "s.json").write_text('{"run": "r", "config": "c1", "item": "i", "metric": "m", "value": 2}\n{"config": "c1", "metric": "m", "value": 4}\n{"config": "c2", "metric": "x", "value": 1}\n')
    got = stats.scores_by_config(json_scores(spark, str(tmp_path)), ["m"]).collect()
    assert {r.config: r.m for r in got} == {"c1": 3.0, "c2": None}
    rows = spark.createDataFrame([("g", k, float(k)) for k in range(9)], "g string, k int, v double")
    assert tuple(stats.position_gap(rows, "g", "k", F.col("v")).first()) == (1.0, 7.0, 6.0)


def test_p_of_chi_squared(spark):
    values = [0.0, 0.1, 0.45, 1.0, 2.706, 3.841, 6.635, 10.83, 40.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in values], "chi2 double").selectExpr(f"{stats.chi2_p_sql('chi2')} AS p").collect()]
    assert got == pytest.approx([stats.chi2_p(v) for v in values], abs=2e-6)
    alone = spark.createDataFrame([(True, True)], "x boolean, y boolean")
    row = stats.mcnemar_p(alone, F.col("x"), F.col("y")).first()
    assert (row.b, row.c, row.chi2, row.p) == (0, 0, None, None)


def test_bootstrap(spark):
    """The same weights by hand; the same interval in another partitioning; no rows, and null values."""
    import hashlib
    import math

    rows = [(i, float(i % 7)) for i in range(60)] + [(None, 3.0), (99, None)]
    df = spark.createDataFrame(rows, "i long, v double")
    got = stats.bootstrap_mean(df.repartition(5), "i", "v", 50).first()
    assert got == stats.bootstrap_mean(df.repartition(1), "i", "v", 50).first()
    steps = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(12)]
    means = []
    for r in range(50):
        w = [(sum(int(hashlib.md5(f"0:{'null' if i is None else i}:{r}".encode()).hexdigest()[:8], 16) / 2**32 >= s for s in steps), v) for i, v in rows if v is not None]
        means.append(sum(n * v for n, v in w) / sum(n for n, _ in w))
    means.sort()
    assert (got.n, got.low, got.high) == (61, pytest.approx(means[1], abs=1e-8), pytest.approx(means[48], abs=1e-8)) and got.low < got["mean"] < got.high
    assert tuple(stats.bootstrap_mean(df.filter("i < 0"), "i", "v", 5).first()) == (0, None, None, None)


def test_grouping_sets_tell_nulls_apart(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 5), ("a", None, 2.0, 5), (None, 1, 3.0, 6)], "x string, y int, t double, d int")
    got = {(r.x, r.y, r.level): (r.n, r.total, r.n_distinct) for r in stats.grouped(df, [["x", "y"], ["x"], []], "t", "d").collect()}
    assert got == {
        ("a", 1, 0): (1, 1.0, 1), ("a", None, 0): (1, 2.0, 1), (None, 1, 0): (1, 3.0, 1),
        ("a", None, 1): (2, 3.0, 1), (None, None, 1): (1, 3.0, 1), (None, None, 3): (3, 6.0, 2),
    }


def test_merged_sketches(spark, tmp_path):
    from tarnwork.operators import sketches

    df = spark.range(20_000).selectExpr("id % 3 AS a", "id % 10 AS b", "id % 5000 AS item", "cast(id AS double) AS v").union(spark.sql("SELECT 1L, 1L, null, null"))
    built = sketches.build(df, ["a", "b"], "item", "v", f"file://{tmp_path}/s")
    rows = {r.a: r for r in sketches.estimates(sketches.merge(sketches.reopen(spark, f"file://{tmp_path}/s"), ["a"]), 0.1, 0.9).collect()}
    assert built.count() == 30 and rows[1].n == 6668
    assert all(abs(r.n_distinct - 5000) < 200 and abs(r.q0 - 2000) < 500 and abs(r.q1 - 18_000) < 500 for r in rows.values())


def test_statistics_of_nulls_and_nothing(spark):
    points = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 5.0), (4.0, 7.0)], "x double, y double")
    assert tuple(stats.linear_fit(points, "x", "y").first()) == (2.0, -1.0, 1.0)
    assert tuple(stats.linear_fit(points.filter("x < 0"), "x", "y").first()) == (None, None, None)
    pairs = spark.createDataFrame([(True, None), (None, None), (True, False), (True, False), (False, True)], "x boolean, y boolean")
    assert tuple(stats.mcnemar(pairs, F.col("x"), F.col("y")).first())[:2] == (2, 1)
    texts = spark.createDataFrame([(1, None), (2, ""), (2, "")], "i int, text string")
    assert sorted(map(str, map(tuple, stats.digests(texts, "i").collect()))) == sorted(map(str, [(1, None), (2, "d41d8cd98f00b204e9800998ecf8427e"), (2, "d41d8cd98f00b204e9800998ecf8427e")]))
    rows = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("b", None)], "g string, v double")
    assert {r.g: (r.n, r["mean"]) for r in stats.by_group(rows, "g", "v").collect()} == {"a": (2, 1.0), None: (1, 2.0), "b": (1, None)}
    arms = rows.withColumnRenamed("g", "arm").withColumnRenamed("v", "value")
    row = stats.pivot_scores(arms, ["a", "b"]).first()
    assert (row.sum_a, row.sum_b, row.mean_b, row.factor) == (1.0, 0.0, None, None)
    one = spark.createDataFrame([(1, 5), (2, None), (None, 1)], "i int, v int")
    assert tuple(stats.paired_difference(one, one.filter("i < 2"), "i", "v").first()) == (1, 0.0)
    assert tuple(stats.paired_difference(one, one.filter("i > 9"), "i", "v").first()) == (0, None)


@pytest.mark.parametrize("cells", [63, 3])
def test_grouped_shuffles_the_table_once(spark, cells):
    """Nulls in groups and values, empty tables, more finest groups than bits; below that no row is expanded for each set."""
    rows = [(["x", "y", None][i % 3], [1, None][i % 2], float(i), None if i % 5 == 0 else i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "a string, b int, v double, w int")
    got = stats.grouped(df, [["a", "b"], ["b"], []], "v", "w", cells=cells)
    want = {}
    for level, pick in ((0, lambda r: (r[0], r[1])), (2, lambda r: (None, r[1])), (3, lambda r: (None, None))):
        for r in rows:
            want.setdefault((level, *pick(r)), []).append(r)
    assert {(r.level, r.a, r.b): (r.n, r.total, r.n_distinct) for r in got.collect()} == {k: (len(x), sum(r[2] for r in x), len({r[3] for r in x} - {None})) for k, x in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert cells == 3 or "_distinct" not in "".join(line for line in plan.splitlines() if "Expand" in line)
    none = stats.grouped(df.filter("v < 0"), [["a", "b"], ["b"], []], "v", "w", cells=cells).collect()
    assert [tuple(r) for r in none] == [(None, None, 3, 0, None, 0)]


def test_cochange_tasks_grow_with_the_table(spark, monkeypatch):
    """So that no task's share does; the pairs are the same."""
    monkeypatch.setattr(stats, "TASK_ROWS", 10)
    rows = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(60)], "g int, i int")
    got = stats.cochange_pairs(rows, "g", "i", block=7)
    assert got.rdd.getNumPartitions() >= 12
    assert sorted((r.a, r.b, r.n) for r in got.collect()) == [(a, b, 2) for a in range(60) for b in range(a + 1, 60)]
