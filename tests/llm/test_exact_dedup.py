import hashlib
from collections import defaultdict

from tarnwork.llm import exact_dedup
from tarnwork.llm.common import stash
from tarnwork.llm.exact_dedup import exact_dedup as dedup, flagged


def test_awkward(awkward, awkward_rows):
    got = dedup(awkward)
    assert got.columns == ["doc_id", "text", "TEXT", "score", "shard", "group_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = [(r[0], r[1], r[6], r[7], r[8], r[9]) for r in got.collect()]
    groups = defaultdict(list)
    for i, t, *_ in awkward_rows:
        groups[t or ""].append(i)
    assert len(rows) == len(awkward_rows)
    kept = defaultdict(int)
    for i, t, keep, size, is_kept, sha in rows:
        ids = groups[t or ""]
        assert keep == max((x for x in ids if x is not None), default=None) and size == len(ids)
        assert sha in (None, hashlib.sha256((t or "").encode()).hexdigest())
        kept[t or ""] += is_kept
        assert not is_kept or i == keep
    assert set(kept.values()) == {1}


def test_empty_table(nothing):
    assert dedup(nothing).count() == 0


def test_groups_that_are_joined_instead(awkward, monkeypatch):
    want = sorted(map(str, dedup(awkward).drop("text_sha256").collect()))
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 8)
    assert sorted(map(str, dedup(awkward).drop("text_sha256").collect())) == want


def test_digests_instead_of_texts(awkward):
    got = dedup(awkward, digests=True)
    assert got.columns == ["doc_id", "TEXT", "score", "shard", "group_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted((str(r.doc_id), r.keep_id or -1, r.group_size, r.kept, hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in dedup(awkward).collect())
    assert sorted((str(r.doc_id), r.keep_id or -1, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want


def test_same_length_and_prefix_are_told_apart(spark):
    a, b = "x" * 200 + "a", "x" * 200 + "b"
    rows = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.kept) for r in dedup(rows).collect()} == {1: (3, False), 2: (2, True), 3: (3, True)}


def test_flags_have_all_their_keys(spark):
    keys = stash(spark.range(1000).selectExpr("xxhash64(id) AS key"), "keys")
    others = spark.range(5000, 9000).selectExpr("xxhash64(id) AS key")
    for bits in (None, 64):
        assert flagged(keys, keys, keys.key, "in", bits).filter("in").count() == 1000
        assert flagged(others, keys, others.key, "in", bits).filter("in").count() < 500
    assert flagged(others, keys.filter("1 = 0"), others.key, "in").filter("in").count() == 0
