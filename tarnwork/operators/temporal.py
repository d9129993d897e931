"""Joins along time: the last row before another (as-of), rows near each other, and points in intervals.

None of them is a cross product, and none needs all rows of a key in one task: a key's rows are split by time, so that a key with a third of
all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def micros_of(kind: str, name: str) -> Column:
    """A column of this type in microseconds: a timestamp with or without zone, a date, or a number that is that already."""
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")
    return F.unix_micros(F.col(name).cast("timestamp")) if kind in ("timestamp", "date") else F.col(name).cast("long")


def micros(df: DataFrame, name: str, prefix: str) -> Column:
    """Column ``name`` of df, renamed by ``_plain``, in microseconds."""
    return micros_of(dict(df.dtypes)[name], f"{prefix}{df.columns.index(name)}")


def _plain(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))])


def as_of(left: DataFrame, right: DataFrame, by: str | tuple[str, str], time: str | tuple[str, str], tie: str, slice_seconds: int = 86_400, strict: bool = False, suffix: str = "_last") -> DataFrame:
    """All rows and columns of left with those of the right row of the same key that comes last before it; null where none does.

    by, time: column names, of left and right if they differ. tie: a right column that orders rows of one time; the largest counts.
    strict: right rows of the same time don't count. suffix: added to each right column's name.

    Both sides go into one sort by (key, slice of time), in which the last right row is carried forward. What was last when a slice
    begins comes from one row for each key and slice: the last of each, aggregated on the map side first, carried over slices. So the rows of
    a key meet in one task only slice by slice. Defined cases: a row without key or time has no partner and is none; repeated rows of left
    stay; of right rows equal in time and tie any one counts; an empty side gives no partners.
    """
    (by_l, by_r), (t_l, t_r) = (x if isinstance(x, tuple) else (x, x) for x in (by, time))
    lefts, rights = _plain(left, "l"), _plain(right, "r")
    own, theirs = F.struct(*lefts.columns), F.struct(*rights.columns)
    spot = lambda df, name, prefix: F.col(f"{prefix}{df.columns.index(name)}")
    part = lambda t: F.floor(t / (slice_seconds * SECOND)).cast("long")
    r = rights.select(spot(right, by_r, "r").alias("k"), micros(right, t_r, "r").alias("t"), spot(right, tie, "r").alias("tie"), theirs.alias("right")).filter("k IS NOT NULL AND t IS NOT NULL")
    r = r.withColumn("slice", part(F.col("t")))
    li = lefts.select(spot(left, by_l, "l").alias("k"), micros(left, t_l, "l").alias("t"), own.alias("left"))
    known = li.filter("k IS NOT NULL AND t IS NOT NULL").withColumn("slice", part(F.col("t")))

    # Slices of either side; each gets what was last before it began.
    ends = r.groupBy("k", "slice").agg(F.max_by("right", F.struct("t", "tie")).alias("right"))
    starts = known.select("k", "slice").distinct().withColumn("right", F.lit(None).cast(dict(r.dtypes)["right"]))
    over = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    either = ends.withColumn("asked", F.lit(False)).unionByName(starts.withColumn("asked", F.lit(True)))
    one = either.groupBy("k", "slice").agg(F.max("right").alias("right"), F.max("asked").alias("asked"))
    carried = one.withColumn("right", F.last("right", ignorenulls=True).over(over)).filter("asked AND right IS NOT NULL")

    # In one sort: what was carried in, then by time; of one time right rows come first, unless they don't count.
    rank = {"carried": 0, "right": 2 if strict else 1, "left": 1 if strict else 2}
    none_l, none_tie = F.lit(None).cast(dict(li.dtypes)["left"]), F.lit(None).cast(dict(r.dtypes)["tie"])
    rows = carried.select("k", "slice", F.lit(None).cast("long").alias("t"), F.lit(rank["carried"]).alias("rank"), none_tie.alias("tie"), none_l.alias("left"), "right")
    rows = rows.unionByName(r.select("k", "slice", "t", F.lit(rank["right"]).alias("rank"), "tie", none_l.alias("left"), "right"))
    rows = rows.unionByName(known.select("k", "slice", "t", F.lit(rank["left"]).alias("rank"), none_tie.alias("tie"), "left", F.lit(None).cast(dict(r.dtypes)["right"]).alias("right")))
    order = Window.partitionBy("k", "slice").orderBy(F.col("t").asc_nulls_first(), "rank", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("right", F.last("right", ignorenulls=True).over(order)).filter("left IS NOT NULL").select("left", "right")
    lone = li.filter("k IS NULL OR t IS NULL").select("left", F.lit(None).cast(dict(r.dtypes)["right"]).alias("right"))
    out = found.unionByName(lone)
    return out.select(*[F.col(f"left.l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"right.r{i}").alias(f"{c}{suffix}") for i, c in enumerate(right.columns)])


def near(left: DataFrame, right: DataFrame, by: str, time: str, seconds: int, suffix: str = "_near") -> DataFrame:
    """Pairs of a left and a right row of the same key whose times are at most so many seconds apart.

    Time is cut into bins of that length; a right row goes to its own bin and both neighbours, so that a pair meets once and only where it
    may be near, and an exact filter follows. As in ``within`` no side is broadcast: Spark's estimate leaves out what explode adds. Defined cases: rows without key or time are in no pair; repeated rows are pairs of their own;
    no seconds: equal times.
    """
    width = max(1, seconds * SECOND)
    lefts, rights = _plain(left, "l"), _plain(right, "r")
    k_l, t_l = F.col(f"l{left.columns.index(by)}"), micros(left, time, "l")
    k_r, t_r = F.col(f"r{right.columns.index(by)}"), micros(right, time, "r")
    at = lambda t: F.floor(t / width).cast("long")
    a = lefts.withColumn("_k", k_l).withColumn("_bin", at(t_l))
    b = rights.withColumn("_k", k_r).withColumn("_bin", F.explode(F.array(*[at(t_r) + d for d in (-1, 0, 1)])))
    pairs = a.join(b.hint("merge"), ["_k", "_bin"]).filter(F.abs(t_l - t_r) <= seconds * SECOND)
    return pairs.select(*[F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"r{i}").alias(f"{c}{suffix}") for i, c in enumerate(right.columns)])


def within(points: DataFrame, intervals: DataFrame, by: str | tuple[str, str], time: str, start: str, end: str, suffix: str = "_in") -> DataFrame:
    """Pairs of a point and an interval [start, end) of the same key that holds it, for intervals of any mix of lengths.

    An interval belongs to the level whose bins are as long as itself or up to twice as long, so that it touches two bins at most; a point
    goes to one bin of each level that occurs (64 at most, a small aggregate). The sides meet by sort and shuffle: before explode the points may
    look small enough to be broadcast, and the driver would build a table of them for all levels. Defined cases: an interval that doesn't end after its
    start, or lacks a bound or key, holds nothing; points without key or time are in none; repeated rows are pairs of their own.
    """
    by_p, by_i = by if isinstance(by, tuple) else (by, by)
    p, i = _plain(points, "l"), _plain(intervals, "r")
    t, k_p = micros(points, time, "l"), F.col(f"l{points.columns.index(by_p)}")
    low, high, k_i = micros(intervals, start, "r"), micros(intervals, end, "r"), F.col(f"r{intervals.columns.index(by_i)}")
    sized = i.withColumn("_low", low).withColumn("_high", high).withColumn("_k", k_i).filter("_k IS NOT NULL AND _low < _high")
    sized = sized.withColumn("_level", F.length(F.bin(F.col("_high") - F.col("_low"))).cast("int"))
    bins = lambda x: F.expr(f"shiftright({x}, _level)")
    dealt = sized.withColumn("_bin", F.explode(F.sequence(bins("_low"), bins("(_high - 1)"))))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    asked = p.withColumn("_t", t).withColumn("_k", k_p).filter("_k IS NOT NULL AND _t IS NOT NULL")
    asked = asked.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bins("_t"))
    pairs = asked.join(dealt.hint("merge"), ["_k", "_level", "_bin"]).filter("_low <= _t AND _t < _high")
    return pairs.select(*[F.col(f"l{n}").alias(c) for n, c in enumerate(points.columns)], *[F.col(f"r{n}").alias(f"{c}{suffix}") for n, c in enumerate(intervals.columns)])


def islands(rows: DataFrame, by: str, time: str, tie: str, gap_seconds: int, slice_seconds: int = 86_400) -> DataFrame:
    """All rows and columns plus island_start: the time at which the row's island began.

    Rows of a key belong together as long as less than ``gap_seconds`` pass from one to the next. tie: a column that tells rows apart.
    Two as-of joins: one finds the row before each, and with it where islands begin, the other the last beginning up to each row; so a key with
    most of the rows is split by time here too. Defined cases: rows without key or time have no island; rows of one time share theirs.
    """
    kind = dict(rows.dtypes)[time]
    plain = rows.select(F.col(by).alias("k"), F.col(time).alias("t"), F.col(tie).alias("tie"))
    named = as_of(plain, plain, "k", "t", "tie", slice_seconds, strict=True).toDF("c0", "c1", "c2", "c3", "c4", "c5")
    apart = micros_of(kind, "c1") - micros_of(kind, "c4")
    starts = named.filter(F.col("c4").isNull() | (apart >= gap_seconds * SECOND)).select(F.col("c0").alias("k"), F.col("c1").alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").distinct()
    found = as_of(rows, starts, (by, "k"), (time, "t"), "t", slice_seconds, suffix="__start")
    return found.toDF(*rows.columns, "_k", "island_start").drop("_k")
