"""Guard outcomes as rows, and the run of guards that makes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cut

OUTCOME = "guard string, status string, reason string"
STATUSES = ("PASS", "SKIP", "FAIL")


class Skip(Exception):
    """Raised by a guard that can't run here; says why."""


def outcome(ok, guard: str, reason=None) -> list:
    """Columns of an outcome row from a boolean column."""
    return [F.lit(guard).alias("guard"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), (F.lit("") if reason is None else reason).alias("reason")]


def run_guards(spark: SparkSession, guards: list[tuple[str, Callable[[], str]]]) -> DataFrame:
    """(guard, status, reason, place): runs named guards in order. What a guard returns is the reason of its PASS; ``Skip`` gives SKIP, its
    text cut to 40 characters; any other error gives FAIL, and the next guard still runs. Without guards the result is empty."""
    rows = []
    for place, (name, guard) in enumerate(guards):
        try:
            rows.append((name, "PASS", str(guard() or ""), place))
        except Skip as e:
            rows.append((name, "SKIP", str(e), place))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "FAIL", f"{type(e).__name__}: {e}", place))
    seen = spark.createDataFrame(rows, f"{OUTCOME}, place int")
    return seen.withColumn("reason", F.when(F.col("status") == "SKIP", cut(F.col("reason"))).otherwise(F.col("reason")))


def or_skip(work: Callable, what: str):
    """The result of ``work``; any error in it skips the guard. For steps whose failure says nothing about the data, such as loading a model."""
    try:
        return work()
    except Exception as e:  # noqa: BLE001
        raise Skip(f"{what}: {e}") from e


def require(module: str):
    """Imports an optional module, or skips the guard."""
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise Skip(str(e)) from e


def count_statuses(outcomes: DataFrame) -> DataFrame:
    """(status, n) for all three statuses, zeros too."""
    spark = outcomes.sparkSession
    all_ = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return all_.join(outcomes.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def exit_status(outcomes: DataFrame) -> int:
    """1 if any guard failed, else 0: skipped guards and those without a status don't fail, and no guards neither."""
    return int(not outcomes.filter("status = 'FAIL'").isEmpty())
