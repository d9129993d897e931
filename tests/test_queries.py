"""Every query of the registry against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tarnwork.plans import registry
from tarnwork.sources import cards


def shown(rows):
    return sorted(tuple("null" if x is None else f"{x:.8g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    rel = duck.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(got.columns)
    assert shown(got.select(*cols).collect()) == shown(rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_literal_cards_have_their_position(spark):
    assert [tuple(r) for r in cards(spark, ["x", "y"]).orderBy("card_id").collect()] == [(0, "x"), (1, "y")]
