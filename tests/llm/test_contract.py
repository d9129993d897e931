"""Every op query on the smallest tables: its columns and types, and its rows against a plain computation."""

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tarnwork.llm import decontamination
from tarnwork.llm.registry import ORACLE_SQL, QUERIES
from tarnwork.llm.sharding import ROUNDS, SEED
from tarnwork.llm.tokens import default_path

from .test_chat_format import conversation
from .test_periodic_runs import all_runs, kept
from .test_resampling import resampled
from .test_simhash import fingerprint, roots

COLUMNS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_decontamination": "doc_id bigint, item_id bigint, first_word bigint, end_word bigint, covered_words int, item_words int",
    "op6_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op7_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_substring_index": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_feistel_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op13_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}


@pytest.fixture(scope="module")
def results(spark, sf):
    found = {}
    for name, query in QUERIES.items():
        df = query(spark, sf)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        found[name] = [r.asDict() for r in df.collect()]
    return found


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def by_doc(rows, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows}


def test_op1(results, docs):
    prints = {i: fingerprint(t) for i, t in docs}
    root, least = roots(prints.values()), {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    want = {i: (f"{f:016x}", least[root[f]]) for i, f in prints.items()}
    assert by_doc(results["op1_simhash"], "fingerprint", "component_id") == want


def test_op2(results, docs, library):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in results["op2_packing"]:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces[i])):
            assert (piece, start) == (k, at) and (k == 0 or length == 1024)
            assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids) and (len(ids) > 1024 or len(pieces[i]) == 1)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in results["op2_packing"])
    assert len(sequences) <= -(-total // 1024) + 1


def test_op3(results, docs, library):
    want = {}
    for i, t in docs:
        n = len(library.encode(t, add_special_tokens=False).ids)
        want[i] = (len(t.encode()), n, n > 512)
    assert by_doc(results["op3_token_counts"], "n_bytes", "n_tokens", "over_limit") == want


def test_op4(results, docs):
    rows = results["op4_toxicity"]
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op5(results, docs, sf):
    items = {}
    for i, t in duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet' WHERE text IS NOT NULL ORDER BY item_id").fetchall():
        items.setdefault(t, i)
    assert all(len(decontamination.words_of(t)) >= 12 for t in items)
    code, want = {}, set()
    coded = lambda t: np.array([code.setdefault(w, len(code)) for w in decontamination.words_of(t)])
    known = {i: coded(t) for t, i in items.items()}
    for i, t in docs:
        d = coded(t)
        for item, b in known.items():
            for shift in range(-(len(b) - 12), len(d) - 11):  # the item's first word at this word of the document
                x, y = d[max(shift, 0) : shift + len(b)], b[max(-shift, 0) :]
                same = np.concatenate([[0], np.cumsum(x == y[: len(x)])])
                if len(same) > 12 and (same[12:] - same[:-12]).max() >= 10:
                    want.add((i, item))
                    break
    assert {(r["doc_id"], r["item_id"]) for r in results["op5_decontamination"]} == want and want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(results, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(tuple(r[n] for n in names) for r in results[name]) == sorted(rel.fetchall())


def test_op7(results, sf):
    turns = defaultdict(list)
    for conv, role, text in duckdb.sql(f"SELECT conv_id, role, coalesce(text, '') FROM '{sf}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        turns[conv].append((role, text))
    tricky = r"\### Assistant: </turn> ok"
    turns[-7] = [("user", tricky), ("assistant", tricky)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in results["op7_chat_format"]}
    assert got == {c: conversation(t) for c, t in turns.items()}
    assert all(r["formatted_chars"] >= sum(len(t) for _, t in turns[r["conv_id"]]) for r in results["op7_chat_format"])


def repeats(docs, units, join):
    """By document: symbols, removed, runs, digest of what stays."""
    first = {}
    for i, u in sorted((i, units(t)) for i, t in docs):
        for k in range(len(u) - 49):
            first.setdefault(u[k : k + 50], i)
    out = {}
    for i, t in docs:
        u = units(t)
        gone = np.zeros(len(u) + 50, bool)
        for k in range(len(u) - 49):
            if first[u[k : k + 50]] < i:
                gone[k : k + 50] = True
        gone = gone[: len(u)]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(u), int(gone.sum()), runs, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest())
    return out


def test_op8(results, docs):
    want = repeats(docs, str.encode, bytes)
    assert by_doc(results["op8_suffix_dedup"], "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert any(w[1] for w in want.values())


def test_op9(results, docs):
    want = {i: (n, gone, digest) for i, (n, gone, _, digest) in repeats(docs, lambda t: tuple(t.encode().split()), b" ".join).items()}
    assert by_doc(results["op9_substring_index"], "n_words", "n_removed", "kept_sha256") == want


def feistel(number, total):
    """The permutation with plain numbers."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    keys = [int.from_bytes(hashlib.sha256(f"{SEED}/{i}".encode()).digest()[:8], "little") for i in range(ROUNDS)]
    while True:
        left, right = number >> half, number % 2**half
        for key in keys:
            z = (right + key) * 0x9E3779B97F4A7C15 % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            left, right = right, left ^ (z ^ z >> 31) % 2**half
        number = left << half | right
        if number < total:
            return number


def test_op10(results, docs):
    want = {}
    for number, (i, t) in enumerate(sorted(docs)):
        place = feistel(number, len(docs))
        want[i] = (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", place % 16, place // 16, None)
    assert by_doc(results["op10_feistel_shards"], "size", "text_crc32", "law", "shard", "slot", "grown_shard") == want
    assert len(set(want.values())) == len(docs)


def test_op11(results, docs):
    want = {}
    for i, t in docs:
        words = t.encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = all_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        shown = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        want[i] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(kept(words, runs)).hexdigest())
    assert by_doc(results["op11_periodic_runs"], "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == want
    assert any(w[0] for w in want.values())


def test_op13(results, docs, sf):
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    want = {i: rest for i, *rest in resampled(docs, target)}
    assert {i: list(r) for i, r in by_doc(results["op13_resampling"], "n_features", "weight", "score", "rank").items()} == want
