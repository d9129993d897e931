import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarnwork.llm import packing, token_counts
from tarnwork.llm.tokens import default_path, pre_tokenizer


@pytest.fixture(scope="module")
def tok():
    return pre_tokenizer(default_path())


def test_every_character_is_split_as_the_library_does(tok):
    for low in [*range(0, 0x20000, 4096), *range(0x20000, 0x110000, 0x10000), 0x2B000, 0x32000, 0x33000, 0x3D000]:
        s = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}z\n" for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000)
        want = tok.library.encode(s, add_special_tokens=False).ids
        assert tok.encode(s).tolist() == want, hex(low)
        if low < 0x20000:
            assert sum(map(len, tok.ids(tok.split(s)))) == len(want), hex(low)


@pytest.mark.parametrize("text", ["", "a <|endoftext|>b<|endoftext|>", "  \n\n x", "don't 'S", "x\x85y z", "\x00\x01", "a" * 5000])
def test_texts(tok, text):
    want = tok.library.encode(text, add_special_tokens=False).ids
    assert tok.encode(text).tolist() == want and sum(map(len, tok.ids(tok.split(text)))) == len(want)


def test_counts(awkward, awkward_rows, tok):
    want = sorted((str(i), len((t or "").encode()), len(tok.library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in awkward_rows)
    for words in (token_counts.DICTIONARY, 5, 0):
        got = token_counts.count_tokens(awkward, words=words)
        assert got.columns == ["doc_id", "TEXT", "kept", "score", "shard", "group_id", "n_bytes", "n_tokens", "over_limit"]
        rows = got.collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def test_empty_tables(nothing):
    assert token_counts.count_tokens(nothing).count() == 0 and packing.pack_documents(nothing).count() == 0


def check_packing(rows, ids, size=1024):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.piece, r.ids_crc32))
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    for doc, expected in ids.items():
        found, parts = sorted(pieces[doc]), []
        for whole in expected:
            n = len(whole)
            cuts = [0] if n <= size else list(range(n % size or size, n, size))
            starts = [0, *cuts] if n > size else [0]
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                parts.append((a, b - a, i, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())))
        assert found == sorted(parts)
    return len(sequences)


@pytest.mark.parametrize("group", [20_000, 8])
def test_packing(awkward, awkward_rows, tok, group):
    ids = defaultdict(list)
    for i, t, *_ in awkward_rows:
        ids[i].append(tok.library.encode(t or "", add_special_tokens=False).ids + [2])
    rows = packing.pack_documents(awkward, group=group).collect()
    n = check_packing(rows, ids)
    if group > 1000:
        assert n == -(-sum(len(x) for v in ids.values() for x in v) // 1024)


def test_ids_of_pieces(spark, tok):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    row = packing.token_pieces(docs, with_ids=True).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*tok.library.encode("some text").ids, 2]


@pytest.mark.parametrize("seed", range(4))
def test_local_search_never_loses_and_empties_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(np.r_[rng.integers(300, 700, 40), rng.integers(1, 1024, 20)], 600)
    before = packing.best_fit(lengths)
    after = packing.local_search(lengths, before)
    fill = lambda b: np.bincount(b, lengths)
    assert fill(after).max() <= 1024 and (fill(after) ** 2).sum() >= (fill(before) ** 2).sum()
    assert (fill(after) > 0).sum() <= (fill(before) > 0).sum()
    bins, offsets = packing.pack(lengths)
    for b in range(bins.max() + 1):
        mine = bins == b
        order = np.argsort(offsets[mine])
        assert (np.cumsum(lengths[mine][order]) - lengths[mine][order] == offsets[mine][order]).all()


def test_local_search_finds_each_kind_of_step():
    # a move; a swap of one for one; two for one
    for lengths, bins in (([600, 300, 100], [0, 1, 0]), ([600, 400, 424, 300, 300], [0, 0, 1, 1, 2]), ([700, 324, 512, 300, 212], [0, 0, 1, 2, 2])):
        out = packing.local_search(np.array(lengths), np.array(bins))
        assert len(set(out.tolist())) == -(-sum(lengths) // 1024)
