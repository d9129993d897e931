"""Row-wise operators on streams: a filter or a check keeps no state, so it is the same plan on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.config import check_configs
from ..operators.lexical import any_term


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files as they arrive in a folder."""
    return spark.readStream.option("wholetext", True).text(path).selectExpr("_metadata.file_path AS path", "value")


def watch_configs(spark: SparkSession, path: str) -> DataFrame:
    """Configuration checks of files as they arrive."""
    return check_configs(read_texts(spark, path))


def watch_terms(stream: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows of a stream that contain a word of the query."""
    return any_term(stream, query, text)
