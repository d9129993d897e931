"""Paired and co-occurrence statistics over score tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Items of one group that meet in one task; a larger group is dealt into blocks, and each pair of blocks is a task's work of its own.
BLOCK = 1000
#: Rows of the table for each task of the pairing, about; it keeps what a task sorts and counts from growing with the table.
TASK_ROWS = 250_000


def cochange_pairs(changes: DataFrame, group: str, item: str, support: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b, n): unordered pairs of items that changed together in at least ``support`` groups; an item counts once for each group.

    Items in fewer groups than ``support`` can be in no such pair and go first. Of a huge group's items each goes to as many cells as the group
    has blocks, so that no task gets more than a block's square of pairs. Rows, cells and pairs are dealt over tasks by the table's size. Defined cases: rows without a group or an item don't count;
    repeated rows count once; an empty table gives an empty table.
    """
    given = changes.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g IS NOT NULL AND i IS NOT NULL")
    tasks = max(changes.sparkSession.sparkContext.defaultParallelism, given.count() // TASK_ROWS + 1)
    once = given.distinct()
    if support > 1:
        often = given.repartition(tasks, "i").distinct().groupBy("i").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("i")
        once = given.repartition(tasks, "i").distinct().join(often, "i", "left_semi")
    once = once.repartition(tasks, "g")
    sizes = once.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = once.join(sizes, "g").withColumn("mine", F.pmod(F.xxhash64("i"), "blocks").cast("int"))
    all_blocks = F.explode(F.expr("sequence(0, blocks - 1)"))
    a = dealt.select("g", F.col("i").alias("a"), F.col("mine").alias("x"), all_blocks.alias("y")).repartition(tasks, "g", "x", "y")
    b = dealt.select("g", F.col("i").alias("b"), all_blocks.alias("x"), F.col("mine").alias("y")).repartition(tasks, "g", "x", "y")
    pairs = a.join(b.hint("merge"), ["g", "x", "y"]).filter("a < b").select("a", "b").repartition(tasks, "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= support)


def mcnemar(pairs: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: discordant counts b (x only) and c (y only), and chi squared, null without discordant pairs. A pair of which one side is null isn't discordant; repeated rows count each."""
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    counts = pairs.agg(n(x & ~y).alias("b"), n(~x & y).alias("c"))
    return counts.withColumn("chi2", F.round(F.try_divide(((F.col("b") - F.col("c")) * (F.col("b") - F.col("c"))).cast("double"), (F.col("b") + F.col("c")).cast("double")), 9))


def chi2_p(chi2: float) -> float:
    """Probability of a chi squared (one degree of freedom) at least so large."""
    return math.erfc(math.sqrt(chi2 / 2))


def linear_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept and r squared of y over x, by least squares. Rows that lack x or y don't count; all three are null without rows or where x never changes."""
    return points.agg(*(F.round(F.expr(f"regr_{k}({y}, {x})"), 6).alias(k) for k in ("slope", "intercept", "r2")))


def position_effect(rows: DataFrame, group: str, order: str, metric: Column) -> DataFrame:
    """(bin, n, mean): the metric at the head, in the middle and at the tail of each group, by relative position.

    Defined cases: a group of one row is all head; rows that tie in order share a place; null metrics count in n only.
    """
    at = F.percent_rank().over(Window.partitionBy(group).orderBy(order))
    part = F.when(at < 1 / 3, "head").when(at < 2 / 3, "middle").otherwise("tail")
    return rows.select(part.alias("bin"), metric.cast("double").alias("m")).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean"))


def position_gap(rows: DataFrame, group: str, order: str, metric: Column) -> DataFrame:
    """One row (head, tail, gap): the metric's mean at the tail less that at the head; null where one of them has no rows."""
    bins = position_effect(rows, group, order, metric)
    mean = lambda part: F.max(F.when(F.col("bin") == part, F.col("mean")))
    return bins.agg(mean("head").alias("head"), mean("tail").alias("tail")).withColumn("gap", F.round(F.col("tail") - F.col("head"), 6))


def scores_by_config(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """scores (config, metric, value) as one row for each config with the mean of each metric, null where it has none."""
    wanted = scores.filter(F.col("metric").isin(metrics)).groupBy("config").pivot("metric", metrics).agg(F.round(F.avg("value"), 6))
    return scores.select("config").distinct().join(wanted, "config", "left")


def digests(rows: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id_col, md5) of each text: null for a null text, that of nothing for an empty one; repeated rows stay."""
    return rows.select(id_col, F.md5(F.col(text).cast("binary")).alias("md5"))


def by_group(rows: DataFrame, group: str, metric: str) -> DataFrame:
    """(group, n, mean) of a metric. Rows with a null metric count in n only; a null group is one; a group without values has a null mean."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(metric), 9).alias("mean"))


def pivot_scores(scores: DataFrame, arms: list[str]) -> DataFrame:
    """scores (item, arm, value) as one row for each metric of the arms: sums, means, and the gap of the first to the last, as a ratio too.

    Null values don't count, other arms neither; an arm without values has sum 0 and a null mean, and the ratio is null if one of the means is, or the last is 0.
    """
    total = lambda a: F.coalesce(F.sum(F.when(F.col("arm") == a, F.col("value"))), F.lit(0.0))
    mean = lambda a: F.avg(F.when(F.col("arm") == a, F.col("value")))
    out = scores.agg(*(total(a).alias(f"sum_{a}") for a in arms), *(F.round(mean(a), 6).alias(f"mean_{a}") for a in arms))
    first, last = arms[0], arms[-1]
    return out.withColumn("drop", F.col(f"sum_{first}") - F.col(f"sum_{last}")).withColumn("factor", F.round(F.try_divide(F.col(f"mean_{first}"), F.col(f"mean_{last}")), 6))


def paired_difference(a: DataFrame, b: DataFrame, item: str, value: str) -> DataFrame:
    """One row: items in both, and the mean of a's value less b's, null without any. A null item is in neither; an item that repeats gives each pair of its rows; a pair that lacks a value counts in n only."""
    both = a.select(item, F.col(value).alias("x")).join(b.select(item, F.col(value).alias("y")), item)
    return both.agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") - F.col("y")), 9).alias("mean_difference"))


#: The complementary error function by Chebyshev fit, its relative error below 1.2e-7: coefficients of Horner's scheme, highest order last.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def chi2_p_sql(chi2: str) -> str:
    """The same probability as ``chi2_p``, to six digits, as an expression that Spark and other engines take; null for a null chi squared."""
    z = f"sqrt(({chi2}) / 2.0E0)"
    t = f"(1.0E0 / (1.0E0 + 0.5E0 * {z}))"
    inner = f"{_ERFC[-1]!r}E0"
    for c in reversed(_ERFC[:-1]):
        inner = f"({c!r}E0 + {t} * {inner})"
    return f"round({t} * exp(-({chi2}) / 2.0E0 + {inner}), 6)"


def mcnemar_p(pairs: DataFrame, x: Column, y: Column) -> DataFrame:
    """As ``mcnemar``, with the probability p as a column; chi squared and p are null without discordant pairs."""
    return mcnemar(pairs, x, y).withColumn("p", F.expr(chi2_p_sql("chi2")))


def poisson_sql(uniform: str, most: int = 12) -> str:
    """A Poisson number with mean one from a number in [0, 1), as an expression: how many of the cumulative probabilities it reaches."""
    total, each, steps = 0.0, math.exp(-1), []
    for k in range(most):
        total += each
        each /= k + 1
        steps.append(f"CASE WHEN {uniform} >= {total!r} THEN 1 ELSE 0 END")
    return "(" + " + ".join(steps) + ")"


def bootstrap_mean(rows: DataFrame, item: str, value: str, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row (n, mean, low, high): the mean of a value and its interval over Poisson bootstrap replicates.

    Whether and how often an item counts in a replicate follows from a hash of seed, item and replicate, so the same rows give the same
    interval in any partitioning, and no row is moved: a task lets out one sum for each replicate. Defined cases: rows without
    a value don't count; a null item is an item; a replicate without rows is left out; without rows all but n are null.
    """
    known = rows.filter(F.col(value).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(value).cast("double").alias("v"))
    drawn = known.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("u", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "item", "r").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0)
    sums = drawn.withColumn("w", F.expr(poisson_sql("u"))).groupBy("r").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("s"), F.count("*").alias("n"), F.sum("v").alias("v"))
    means = F.sort_array(F.collect_list(F.when(F.col("w") > 0, F.col("s") / F.col("w"))))  # as many as replicates
    out = sums.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max(F.col("v") / F.col("n")).alias("mean"), means.alias("m"))
    cut = F.floor(F.size("m") * F.lit((1 - level) / 2)).cast("int")
    return out.select("n", F.round("mean", 9).alias("mean"), F.round(F.get("m", cut), 9).alias("low"), F.round(F.get("m", F.size("m") - 1 - cut), 9).alias("high"))


#: Finest groups whose parts ``grouped`` tells by the bits of one number.
CELLS = 63


def grouped(rows: DataFrame, sets: list[list[str]], total: str, distinct: str, cells: int = CELLS) -> DataFrame:
    """(columns of all sets, level, n, total, n_distinct) for each grouping set: rows, the sum of a column, distinct values of another.

    level: the number whose bits, first column first, tell which columns are summed over, so that a null in the data isn't taken for one
    of them. Without rows only the empty set has one. The finest groups are aggregated first, and the sets from these few rows. A distinct
    value becomes one row with a bit for each finest group that holds it, so the table is shuffled once, not once for each set; groups of all sets then
    count the rows that have one of their bits. With more than ``cells`` finest groups Spark expands the rows for each set instead.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    keyed = rows.select(*columns, F.col(total).alias("_total"), F.col(distinct).alias("_distinct"))
    sums = F.count("*").alias("n"), F.sum("_total").alias("total")
    by_set = lambda df: df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    level = F.grouping_id().cast("long").alias("level")
    finest = keyed.groupBy(*columns).agg(*sums)
    known = finest.limit(cells + 1).collect()
    if len(known) > cells:
        return by_set(keyed).agg(level, *sums, F.countDistinct("_distinct").alias("n_distinct"))
    if not known:
        kinds, whole = dict(keyed.dtypes), keyed.agg(*sums, F.countDistinct("_distinct").alias("n_distinct")).filter(F.lit([] in sets))
        return whole.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in columns], F.lit((1 << len(columns)) - 1).cast("long").alias("level"), "n", "total", "n_distinct")
    few = rows.sparkSession.createDataFrame([(*r, 1 << i) for i, r in enumerate(known)], finest.schema.add("_bit", "long"))
    groups = by_set(few).agg(level, F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"), F.coalesce(F.bit_or("_bit"), F.lit(0)).alias("_bits"))
    bits = few.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], "_bit")
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    held = keyed.filter("_distinct IS NOT NULL").join(F.broadcast(bits), same).groupBy("_distinct").agg(F.bit_or("_bit").alias("_held"))
    held = held.groupBy("_held").agg(F.count("*").alias("_values"))
    met = held.join(F.broadcast(groups.select("level", "_bits").distinct()), F.col("_held").bitwiseAND(F.col("_bits")) != 0)
    counted = met.groupBy("level", "_bits").agg(F.sum("_values").alias("n_distinct"))
    out = groups.join(F.broadcast(counted), ["level", "_bits"], "left")
    return out.select(*columns, "level", "n", "total", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
