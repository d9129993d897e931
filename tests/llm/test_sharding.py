from collections import defaultdict

import numpy as np
import pytest

from tarnwork.llm.sharding import permute, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_a_permutation(n):
    assert sorted(permute(np.arange(n), n).tolist()) == list(range(n))
    if n > 500:
        assert (permute(np.arange(n), n) != permute(np.arange(n), n, seed=1)).any()


def test_awkward(awkward, awkward_rows):
    got = shard_rows(awkward, shards=4)
    assert got.columns == ["doc_id", "text", "TEXT", "kept", "score", "group_id", "row_number", "shard", "slot"]
    rows = got.collect()
    assert sorted(r.row_number for r in rows) == list(range(len(awkward_rows)))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(sizes) - min(sizes) <= 1
    place = permute(np.array([r.row_number for r in rows]), len(rows))
    assert [(r.shard, r.slot) for r in rows] == [(p % 4, p // 4) for p in place.tolist()]


def test_same_in_any_partitioning(awkward):
    show = lambda df: sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in df.collect())
    assert show(shard_rows(awkward)) == show(shard_rows(awkward.repartition(7)))


def test_empty_table(nothing):
    assert shard_rows(nothing).count() == 0
