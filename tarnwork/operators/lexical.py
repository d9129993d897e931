"""Lexical retrieval: rows that contain any word of a query."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import has_any, terms
from ..session import ship
from ..written import in_blocks

#: Characters of query text that the tasks get at once; more queries take several passes over the corpus.
BLOCK_CHARS = 4_000_000


def any_term(corpus: DataFrame, query: str | Column, text: str = "text") -> DataFrame:
    """Rows of the corpus that contain a word of the query. The words are a constant, so each is a plain ``contains`` that reaches the scan."""
    if isinstance(query, str):
        hit = F.lit(False)
        for w in query.split():
            hit = hit | F.contains(F.col(text), F.lit(w))
        return corpus.filter(hit)
    return corpus.filter(has_any(F.col(text), terms(query)))


def summarise(hits: DataFrame, id_col: str) -> DataFrame:
    """One row: whether there are hits, how many, and the smallest id."""
    return hits.agg((F.count("*") > 0).alias("any_hit"), F.count("*").alias("n_hits"), F.min(id_col).alias("first_id"))


def first_hit(hits: DataFrame, id_col: str, place: str, expected) -> DataFrame:
    """One row: the number of hits, the first one's id by ``place`` (ties by id), and whether it is the expected one; null and false without hits."""
    first = F.min(F.struct(F.col(place).alias("place"), F.col(id_col).alias("id")))["id"]
    return hits.agg(F.count("*").alias("n_hits"), first.alias("first_id"), F.coalesce(first == F.lit(expected), F.lit(False)).alias("as_expected"))


def check_schema(hits: DataFrame, *required: str) -> DataFrame:
    """One row: whether the columns exist (looked at before any row is), and how many rows lack a value. Without rows all is well; a row that lacks several counts once; an empty text is a value."""
    missing = [c for c in required if c not in hits.columns]
    if missing:
        return hits.agg(F.lit(False).alias("ok"), F.count("*").alias("n_bad"), F.count("*").alias("n_rows"))
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    n_bad = F.coalesce(F.sum(bad.cast("long")), F.lit(0))
    return hits.agg((n_bad == 0).alias("ok"), n_bad.alias("n_bad"), F.count("*").alias("n_rows"))


def count_hits(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, n_hits): for each query (query_id, text) the corpus rows (text) with any of its words.

    Queries are a stated set and come in blocks of bounded size; each text is searched once for all words of a block, and only
    counts leave a task. Queries without words have no hits.
    """
    kind = dict(queries.dtypes)["query_id"]
    schema, arrow = f"query_id {kind}, n long", to_arrow_type(queries.schema["query_id"].dataType)
    ship(corpus.sparkSession)

    def blocks() -> Iterator[list[tuple]]:
        block: list[tuple] = []
        held = 0
        for row in queries.select("query_id", "text").toLocalIterator():
            block.append((row.query_id, (row.text or "").split()))
            held += len(row.text or "")
            if held >= BLOCK_CHARS:
                yield block
                block, held = [], 0
        if block:
            yield block

    found = in_blocks(corpus.sparkSession, blocks(), lambda sent: corpus.select("text").mapInArrow(_counter(sent, arrow), schema), schema)
    total = queries.select("query_id", F.lit(0).cast("long").alias("n")).unionByName(found)
    return total.groupBy("query_id").agg(F.sum("n").alias("n_hits"))


def _counter(sent, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words: dict[str, set[int]] = {}
        for i, (_, ws) in enumerate(sent.value):
            for w in ws:
                words.setdefault(w, set()).add(i)
        owners = list(words.values())
        found = ahocorasick.Automaton()
        for i, w in enumerate(words):
            found.add_word(w, i)
        counts = [0] * len(sent.value)
        if words:
            found.make_automaton()
        for b in batches if words else ():
            for x in b.column(0):
                if text := x.as_py():
                    hit: set[int] = set()
                    for i in {i for _, i in found.iter(text)}:  # a word's queries are counted once, however often it occurs
                        hit |= owners[i]
                        if len(hit) == len(counts):
                            break
                    for i in hit:
                        counts[i] += 1
        rows = [(q, n) for (q, _), n in zip(sent.value, counts, strict=True) if n]
        if rows:
            ids, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n, pa.int64())], names=["query_id", "n"])

    return run
