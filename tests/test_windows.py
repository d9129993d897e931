"""Windows over a stream: late rows, a restart, and zones."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork.streaming.windows import in_arrivals, read_rows, run_available, sessions, windowed

DAY = datetime(2024, 3, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


@pytest.mark.parametrize("zone", ["UTC", "America/St_Johns"])
def test_late_rows_and_restart(spark, tmp_path, zone):
    """The query is stopped and started again; a row of a window that was given out is dropped, one of a window still open counts."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        schema = "t timestamp_ntz, v long"
        lots = [[(at(0.5), 1), (at(1.5), 2), (at(5), 3)], [(at(0.6), 100), (at(4.2), 4), (at(9), 5)], [(None, 7), (at(8.5), 6), (at(20), 8)]]
        seen = []
        for lot in lots:
            spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = read_rows(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
            result = windowed(stream, "t", "1 hour", "2 hours", [F.sum("v").alias("v")])
            rows = run_available(result, f"{tmp_path}/out", f"{tmp_path}/state")
            seen.append({r.window_start: r.v for r in rows.collect()})
        assert seen[0] == {at(0): 1, at(1): 2}
        assert seen[1] == seen[0] | {at(4): 4, at(5): 3}  # 100 came too late
        assert seen[2] == seen[1] | {at(8): 6, at(9): 5}
        assert run_available(result, f"{tmp_path}/out", f"{tmp_path}/state").count() == len(seen[2])  # nothing new, nothing twice
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sessions_over_lots(spark):
    rows = [(1, at(0), 0), (1, at(1), 0), (2, at(0.5), 0), (1, at(1.9), 1), (1, at(4), 1), (2, at(9), 1)]
    df = spark.createDataFrame(rows, "k long, t timestamp, lot int")
    got = in_arrivals(df, F.col("lot"), 2, lambda s: sessions(s, "t", "1 hour", "1 hour", [F.count("*").alias("n")], ["k"]), "test-sessions")
    found = {(r.k, r.window_start, r.window_end): r.n for r in got.collect()}
    # [0, 1) ends where the row at 1 begins: Spark takes them as one session.
    assert sum(found.values()) == 5 and found[(2, at(0.5), at(1.5))] == 1 and found[(1, at(4), at(5))] == 1
