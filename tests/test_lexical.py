import pytest
from pyspark.sql import functions as F

from tarnwork.functions import has_any, terms
from tarnwork.operators import lexical
from tarnwork.sources import corpus


@pytest.fixture(scope="module")
def texts(spark):
    return corpus(spark, [("a", "tokens and Headers parsed"), ("b", "dates"), ("c", "subparser here"), ("d", "")])


@pytest.mark.parametrize("query,ids", [("parse", ["a", "c"]), ("  parse  ", ["a", "c"]), ("headers", []), ("dates　tokens", ["a", "b"]), ("", []), ("   ", [])])
def test_any_term(texts, query, ids):
    assert sorted(r.id for r in lexical.any_term(texts, query).collect()) == ids
    assert sorted(r.id for r in lexical.any_term(texts, F.lit(query)).collect()) == ids


def test_null_query_and_text(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("y", "y")], "text string, q string")
    assert [r.hit for r in df.select(has_any(F.col("text"), terms(F.col("q"))).alias("hit")).collect()] == [False, False, True]


def test_constant_terms_reach_the_scan(spark, sf):
    plan = lexical.any_term(spark.read.parquet(f"{sf}/documents.parquet"), "the")._jdf.queryExecution().toString()
    assert "StringContains(text,the)" in plan


def test_summary_and_schema(texts):
    assert tuple(lexical.summarise(lexical.any_term(texts, "parse"), "id").first()) == (True, 2, "a")
    assert tuple(lexical.summarise(lexical.any_term(texts, "zzz"), "id").first()) == (False, 0, None)
    assert tuple(lexical.check_schema(texts, "id", "text").first()) == (True, 0, 4)
    assert lexical.check_schema(texts.drop("text"), "id", "text").first().ok is False


def test_schema_check_counts_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "id string, text string")
    assert tuple(lexical.check_schema(df, "id", "text").first()) == (False, 1, 2)


def test_many_queries_in_blocks(spark, texts, monkeypatch):
    asked = spark.createDataFrame([(1, "parse dates"), (2, ""), (3, None), (4, "e")], "query_id int, text string")
    want = {1: 3, 2: 0, 3: 0, 4: 3}
    assert {r.query_id: r.n_hits for r in lexical.count_hits(asked, texts).collect()} == want
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 1)
    assert {r.query_id: r.n_hits for r in lexical.count_hits(asked, texts).collect()} == want


def test_first_hit(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "z"), (1, "c")], "place int, id string")
    assert tuple(lexical.first_hit(rows, "id", "place", "c").first()) == (3, "c", True)
    assert tuple(lexical.first_hit(rows, "id", "place", "b").first()) == (3, "c", False)
    assert tuple(lexical.first_hit(rows.filter("place > 5"), "id", "place", "b").first()) == (0, None, False)


def test_count_hits_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 3)
    asked = spark.createDataFrame([(1, "aa bb"), (2, "cc"), (3, ""), (4, "q")], "query_id int, text string")
    texts = spark.createDataFrame([("xaa",), ("bb cc",), (None,)], "text string")
    assert {r.query_id: r.n_hits for r in lexical.count_hits(asked, texts).collect()} == {1: 2, 2: 1, 3: 0, 4: 0}
