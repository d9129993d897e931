import random

import pytest
from pyspark.sql import types as T

from .helpers import prose

#: Rows that every operator must bear: nulls, empty and blank texts, repeated rows, one long text; columns whose names clash.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("TEXT", T.StringType()),
        T.StructField("kept", T.IntegerType()),
        T.StructField("score", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("group_id", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def awkward_rows():
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, base), (6, base), (6, base), (7, base + " end"), (None, base), (None, None), (8, long), (9, long), (10, "é ü  　 ß <|endoftext|> ok"), (11, "one two"), (3, "other text under a used id")]
    return [(i, t, "clash", 7, "s", "x", "g") for i, t in texts]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame(awkward_rows, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.caseSensitive", "false")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
