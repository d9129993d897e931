"""Each stage of the pipeline on its own input, held against a plain computation."""

import corpus_pipeline
import pytest

from tarnwork.llm import decontamination
from tarnwork.llm.common import stash, table
from tarnwork.llm.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def steps(spark, sf):
    frames = [table(spark, sf, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stash(stage(spark, frames[-1], sf), name))
    return [[r.asDict() for r in f.collect()] for f in frames]


def test_stages(steps, spark, sf):
    raw, civil, single, distinct, clean, packed = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    assert all(list(s[0]) == list(raw[0]) for s in (civil, single, distinct, clean))
    assert len(civil) >= 0.8 * len(raw)
    largest = {}
    for r in civil:
        largest[r["text"]] = max(r["doc_id"], largest.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in single) == sorted(largest.values())

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r["doc_id"]: shingles(r["text"]) for r in single}
    kept = {r["doc_id"] for r in distinct}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    left = [(a, b) for a in kept for b in kept if a < b and similar(a, b) >= 0.8]
    assert not left
    for gone in sets.keys() - kept:  # something alike stays, or led to what stays
        assert max(similar(gone, other) for other in sets if other != gone) >= 0.8
    items = decontamination.Index([(r.item_id, decontamination.words_of(r.text)) for r in table(spark, sf, "benchmark").collect()])
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in distinct if not items.search(decontamination.words_of(r["text"])))
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 2


def test_run_gives_the_last_stage(steps, spark, sf):
    assert corpus_pipeline.run(spark, sf).count() == len(steps[-1])


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_awkward_rows_and_empty_tables(spark, sf, awkward, awkward_rows, nothing):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    assert corpus_pipeline.keep_one_of_equal(spark, awkward, sf).columns == awkward.columns
    docs, none = awkward.toDF(*[f"c{i}" for i in range(7)]).drop("c2").toDF("doc_id", "text", "kept", "score", "shard", "group_id"), nothing  # Parquet takes no names that differ in case only
    names = docs.columns
    left = [r[:2] for r in awkward_rows]
    for name, stage in corpus_pipeline.STAGES:
        got, empty = stash(stage(spark, docs, sf), name), stage(spark, none, sf)
        assert empty.count() == 0
        if name == "packing":
            assert {r.doc_id for r in got.collect()} == {i for i, _ in left}
            break
        assert got.columns == names and empty.columns == nothing.columns
        rows = [(r[0], r[1]) for r in got.collect()]
        assert all(tuple(r)[2:] == (7, "s", "x", "g") for r in got.collect())
        assert not set(rows) - set(left)
        if name in ("toxicity", "decontamination"):
            assert sorted(map(str, rows)) == sorted(map(str, left))
        elif name == "exact_dedup":
            assert len({t or "" for _, t in rows}) == len(rows) == len({t or "" for _, t in left})
        else:  # of the text with one more word at its end, and the text itself, one stays
            assert len(rows) == len(left) - 1
        docs, none, left = got, empty, rows
