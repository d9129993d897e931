"""Queries over written indexes, streams, time and graphs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deps, graph, pruned, sketches, stats, temporal, trigrams
from ..sources import table
from ..streaming.windows import in_arrivals, sessions, windowed
from ..written import new_path
from . import rendered

TOP = 5
NEAR_SECONDS, MAX_HOPS, LOTS, REPLICATES = 600, 3, 4, 200
PHRASE_WORDS = 3


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows


def vector_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``vector_topk`` from the cluster index."""
    asked, rows = _asked(spark, sf_dir)
    index = pruned.build(rows, new_path(spark, "vectors"))
    return pruned.top_k(index, asked, TOP).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rk")


def vector_pruned_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs there are, and whether under a third of them had to be scored in full."""
    asked, rows = _asked(spark, sf_dir)
    done = pruned.work(pruned.build(rows, new_path(spark, "vectors")), asked, TOP)
    return done.select("pairs", (F.col("scored") * 3 < F.col("pairs")).alias("under_a_third"))


def trigram_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``lexical_multi_query`` from the trigram index."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = trigrams.build(docs, new_path(spark, "trigrams"), "doc_id")
    return trigrams.count_hits(index, items.select(F.col("item_id").alias("query_id"), "text"), docs, "doc_id")


def trigram_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain the first three words of a benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = trigrams.build(docs, new_path(spark, "trigrams"), "doc_id")
    phrases = items.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, PHRASE_WORDS), " ").alias("phrase"))
    return trigrams.phrase_hits(index, phrases, docs, "doc_id").withColumnRenamed("id", "doc_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


#: A quarter of the month for each lot; every seventh event comes a lot late, every eleventh two.
_LOT = "least(3, cast((day(ts) - 1) div 8 as int) + CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)"


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("k").alias("sum_k")]


def _seconds(result: DataFrame) -> DataFrame:
    """Bounds of windows as seconds since 1970 by the rows' own clock."""
    since = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} as timestamp_ntz))").alias(c)
    return result.select(since("window_start"), since("window_end"), *[c for c in result.columns if c not in ("window_start", "window_end")])


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of six hours, from a stream that is stopped and started again and drops late rows."""
    return _seconds(in_arrivals(_events(spark, sf_dir), F.expr(_LOT), LOTS, lambda s: windowed(s, "ts", "6 hours", "6 hours", _sums(), ["event_type"]), "tumbling"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of a day, a new one every six hours, from a stream that drops late rows."""
    return _seconds(in_arrivals(_events(spark, sf_dir), F.expr(_LOT), LOTS, lambda s: windowed(s, "ts", "1 day", "6 hours", _sums(), slide="6 hours"), "sliding"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions, parted by twelve hours without an event, from a stream that is stopped and started again."""
    rows = _events(spark, sf_dir)
    return _seconds(in_arrivals(rows, F.expr("cast((day(ts) - 1) div 8 as int)"), LOTS, lambda s: sessions(s, "ts", "12 hours", "1 hour", _sums(), ["user_id"]), "sessions"))


def event_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the same user's last earlier one."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return temporal.as_of(rows, rows, "user_id", "ts", "event_id", strict=True).select("event_id", "event_id_last", "event_type_last")


def event_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last order that its user placed before it."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return temporal.as_of(rows, orders, ("user_id", "o_custkey"), ("ts", "o_orderdate"), "o_orderkey").select("event_id", F.col("o_orderkey_last").alias("o_orderkey"))


def event_pairs_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's events within ten minutes."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    pairs = temporal.near(rows, rows, "user_id", "ts", NEAR_SECONDS).filter("event_id < event_id_near")
    return pairs.select("user_id", "event_id", "event_id_near", F.expr("abs(timestampdiff(MICROSECOND, ts, ts_near))").alias("apart"))


def orders_while_shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a customer placed while an earlier one of theirs was being shipped: from its date to its last line's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    spans = orders.join(lines, "o_orderkey")
    pairs = temporal.within(orders, spans, "o_custkey", "o_orderdate", "o_orderdate", "shipped").filter("o_orderkey <> o_orderkey_in")
    return pairs.select("o_custkey", "o_orderkey", F.col("o_orderkey_in").alias("shipping_orderkey"))


def part_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that lead to each other by standing on the next line of an order, over three links at most, from each part whose key is divisible by 100."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("a"))
    b = lines.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("b"))
    starts = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("start"))
    return graph.closure(a.join(b, ["o", "n"]).select("a", "b"), starts, MAX_HOPS)


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's runs of events with less than twelve hours between them."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = temporal.islands(rows, "user_id", "ts", "event_id", 12 * 3600)
    since = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")
    return found.groupBy("user_id", "island_start").agg(F.count("*").alias("n"), since("max(ts)").alias("ends")).select("user_id", since("island_start").alias("starts"), "ends", "n")


def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mcnemar_p(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


def scorer_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean difference of the two labels, with its bootstrap interval."""
    return stats.bootstrap_mean(table(spark, sf_dir, "labels").withColumn("d", F.col("quality") - F.col("toxic")), "doc_id", "d", REPLICATES)


def lineitem_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, quantity and parts by flag, year and status: by all three, by the first two, by year, and in all."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("ship_year"), "l_linestatus", "l_quantity", "l_partkey")
    return stats.grouped(lines, [["l_returnflag", "ship_year", "l_linestatus"], ["l_returnflag", "ship_year"], ["ship_year"], []], "l_quantity", "l_partkey")


def import_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import extraction as a table function in SQL; files without imports keep their row."""
    deps.register_imports(spark)
    files = rendered.source_files(table(spark, sf_dir, "part"))
    return spark.sql("SELECT f.file_id, i.pos, i.kind, i.level, i.module, i.error FROM {files} f LEFT JOIN LATERAL imports_of(f.src) i ON true", files=files)


def sketched_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the median price of each year's lines, from sketches of its months, and whether they are within their bounds of the exact figures."""
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("ship_year"), F.month("l_shipdate").alias("ship_month"), "l_partkey", "l_extendedprice")
    months = sketches.build(lines, ["ship_year", "ship_month"], "l_partkey", "l_extendedprice", new_path(spark, "sketches"))
    years = sketches.estimates(sketches.merge(months, ["ship_year"]), 0.5).withColumnRenamed("n", "sketched")
    both = lines.join(years, "ship_year").groupBy("ship_year").agg(
        F.count("*").alias("n"), F.countDistinct("l_partkey").alias("n_parts"), F.max("n_distinct").alias("guess"), F.avg((F.col("l_extendedprice") <= F.col("q0")).cast("double")).alias("rank")
    )
    return both.select("ship_year", "n", "n_parts", (F.abs(F.col("guess") - F.col("n_parts")) <= 0.03 * F.col("n_parts") + 1).alias("parts_within"), (F.abs(F.col("rank") - 0.5) <= 0.03).alias("median_within"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_pruned, vector_pruned_work, trigram_multi_query, trigram_phrases, stream_tumbling, stream_sliding, stream_sessions,
        event_previous, event_last_order, event_pairs_near, orders_while_shipping, part_closure,
        event_islands, mcnemar_p, scorer_interval, lineitem_levels, import_sql, sketched_years,
    )
}

# ---------------------------------------------------------------- the same in SQL

_LOTS_SQL = """
    lots AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k,
               least(3, (day(ts) - 1) // 8 + CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS lot FROM events),
    marks AS (SELECT l.lot, (SELECT max(e.ts) FROM lots e WHERE e.lot < l.lot) - INTERVAL 6 HOUR AS mark FROM (SELECT DISTINCT lot FROM lots) l),
    last AS (SELECT max(ts) - INTERVAL 6 HOUR AS mark FROM events)"""
_KEPT = "(marks.mark IS NULL OR w.window_end > marks.mark) AND w.window_end <= (SELECT mark FROM last)"

ORACLE_SQL = {
    "vector_pruned_work": "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) * (SELECT count(*) FROM embeddings) AS pairs, true AS under_a_third",
    "trigram_phrases": f"""
    SELECT q.item_id AS query_id, d.doc_id FROM (SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 1, {PHRASE_WORDS}), ' ') AS phrase FROM benchmark) q
    JOIN documents d ON contains(d.text, q.phrase) WHERE q.phrase <> ''""",
    "stream_tumbling": f"""
    WITH {_LOTS_SQL},
    w AS (SELECT lot, event_type, k, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end FROM lots)
    SELECT epoch(window_start)::BIGINT AS window_start, epoch(window_end)::BIGINT AS window_end, event_type, count(*) AS n, sum(k)::BIGINT AS sum_k
    FROM w JOIN marks ON w.lot = marks.lot WHERE {_KEPT} GROUP BY ALL""",
    "stream_sliding": f"""
    WITH {_LOTS_SQL},
    w AS (SELECT lot, k, time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + (4 - i) * INTERVAL 6 HOUR AS window_end FROM lots, range(4) r(i))
    SELECT epoch(window_start)::BIGINT AS window_start, epoch(window_end)::BIGINT AS window_end, count(*) AS n, sum(k)::BIGINT AS sum_k
    FROM w JOIN marks ON w.lot = marks.lot WHERE {_KEPT} GROUP BY ALL""",
    "stream_sessions": """
    WITH s AS (SELECT user_id, ts, json_extract(props, '$.k')::BIGINT AS k, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR)::INT, 1) AS opens FROM events),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM s)
    SELECT floor(epoch(min(ts)))::BIGINT AS window_start, floor(epoch(max(ts) + INTERVAL 12 HOUR))::BIGINT AS window_end, user_id, count(*) AS n, sum(k)::BIGINT AS sum_k
    FROM g GROUP BY user_id, nth HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "event_previous": """
    SELECT a.event_id, b.event_id AS event_id_last, b.event_type AS event_type_last FROM events a ASOF LEFT JOIN events b ON a.user_id = b.user_id AND a.ts > b.ts""",
    "event_last_order": """
    SELECT event_id, o_orderkey FROM (
      SELECT e.event_id, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY o.o_orderdate DESC NULLS LAST, o.o_orderkey DESC) AS nth
      FROM events e LEFT JOIN orders o ON e.user_id = o.o_custkey AND o.o_orderdate <= e.ts) r WHERE nth = 1""",
    "event_pairs_near": f"""
    SELECT a.user_id, a.event_id, b.event_id AS event_id_near, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS apart
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {NEAR_SECONDS}000000""",
    "orders_while_shipping": """
    SELECT p.o_custkey, p.o_orderkey, s.o_orderkey AS shipping_orderkey
    FROM orders p JOIN (SELECT o_custkey, o_orderkey, o_orderdate, max(l_shipdate) AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) s
      ON p.o_custkey = s.o_custkey AND p.o_orderkey <> s.o_orderkey AND s.o_orderdate <= p.o_orderdate AND p.o_orderdate < s.shipped""",
    "part_closure": f"""
    WITH RECURSIVE edges AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_partkey <> y.l_partkey),
    reach(start, node, hops) AS (
      SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 100 = 0
      UNION SELECT start, b, hops + 1 FROM reach JOIN edges ON node = a WHERE hops < {MAX_HOPS})
    SELECT start, node, min(hops)::INTEGER AS hops FROM reach GROUP BY start, node""",
    "event_islands": """
    WITH s AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR)::INT, 1) AS opens FROM events),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM s)
    SELECT user_id, epoch_us(min(ts)) AS starts, epoch_us(max(ts)) AS ends, count(*) AS n FROM g GROUP BY user_id, nth""",
    "mcnemar_p": f"""
    SELECT b, c, round(chi2, 9) AS chi2, {stats.chi2_p_sql("round(chi2, 9)")} AS p FROM (SELECT b, c, (b - c) * (b - c)::DOUBLE / nullif(b + c, 0) AS chi2 FROM (
      SELECT coalesce(sum((quality = 1 AND toxic <> 1)::INT), 0)::BIGINT AS b, coalesce(sum((quality <> 1 AND toxic = 1)::INT), 0)::BIGINT AS c FROM labels) x) y""",
    "scorer_interval": f"""
    WITH drawn AS (SELECT r, quality - toxic AS v, ('0x' || substr(md5('0:' || doc_id || ':' || r), 1, 8))::BIGINT / 4294967296.0E0 AS u FROM labels, range({REPLICATES}) g(r)),
    sums AS (SELECT r, sum(w) AS w, sum(w * v) AS s FROM (SELECT r, v, {stats.poisson_sql("u")} AS w FROM drawn) d GROUP BY r),
    m AS (SELECT list_sort(list(s::DOUBLE / w) FILTER (WHERE w > 0)) AS m FROM sums)
    SELECT (SELECT count(*) FROM labels) AS n, (SELECT round(avg(quality - toxic), 9) FROM labels) AS mean,
           round(m[floor(len(m) * {(1 - 0.95) / 2!r})::INT + 1], 9) AS low, round(m[len(m) - floor(len(m) * {(1 - 0.95) / 2!r})::INT], 9) AS high FROM m""",
    "lineitem_levels": """
    SELECT l_returnflag, ship_year::INTEGER AS ship_year, l_linestatus, grouping(l_returnflag, ship_year, l_linestatus)::BIGINT AS level, count(*) AS n, sum(l_quantity) AS total, count(DISTINCT l_partkey) AS n_distinct
    FROM (SELECT *, year(l_shipdate) AS ship_year FROM lineitem) l GROUP BY GROUPING SETS ((l_returnflag, ship_year, l_linestatus), (l_returnflag, ship_year), (ship_year), ())""",
    "import_sql": rendered.IMPORTS_SQL,
    "sketched_years": """
    SELECT year(l_shipdate)::INTEGER AS ship_year, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, true AS parts_within, true AS median_within FROM lineitem GROUP BY year(l_shipdate)""",
}
