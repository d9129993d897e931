"""Token counts without ids: pieces are counted once for each distinct pre-token, then joined to the documents' frequencies.

Each text is split once, into the frequencies of its pre-tokens. Most of these are common words, whose pieces the task already has: a
dictionary of words that a sample repeats, bounded in words and in bytes, with their pieces counted once each. Which words it holds only decides
where a word is joined, never a count. All other pre-tokens go on as (row, word, frequency); their distinct words are counted by the
library once each and joined back by a shuffle. Frequencies times pieces, summed, are the document's tokens.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, prepare, replace_columns, stash, table, tidy
from .tokens import default_path, pre_tokenizer

#: Words and characters in the dictionary, at most, and texts of the sample that it is taken from.
DICTIONARY, DICTIONARY_CHARS, SAMPLE = 400_000, 16_000_000, 20_000
#: A task hands its word counts on when it holds so many words or characters.
HELD_WORDS, HELD_CHARS = 300_000, 64_000_000
#: A pre-token longer than this isn't put into the dictionary.
LONGEST = 4096

#: The dictionary of this worker, by the broadcast that it came with.
_loaded: dict[str, dict[str, int]] = {}


def pre_token_counts(texts: DataFrame, path: str) -> DataFrame:
    """(word, n): how often each pre-token occurs in the column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, chars = pre_tokenizer(path).split, Counter(), 0
        for b in batches:
            for x in b.column(0):
                if not (text := x.as_py()):
                    continue
                held.update(split(text))
                chars += len(text)
                if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                    yield _word_rows(held)
                    held, chars = Counter(), 0
        if held:
            yield _word_rows(held)

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _word_rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def count_pieces(words: DataFrame, path: str) -> DataFrame:
    """(word, pieces): the library's number of tokens for each word."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pre_tokenizer(path).ids
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, ids(b.column(0).to_pylist())), pa.int64())], names=["word", "pieces"])

    return words.select("word").mapInArrow(pieces, "word string, pieces long")


def dictionary(texts: DataFrame, path: str, most: int = DICTIONARY, chars: int = DICTIONARY_CHARS, sample: int = SAMPLE) -> pa.Table:
    """(word, pieces) of the commonest words of a sample, as many as fit. Frequencies are looked at in steps of an eighth of a doubling."""
    rate = max(1, texts.count() // sample)
    some = texts.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(rate)) == 0)
    found = pre_token_counts(some, path).filter((F.col("n") > 1) & (F.length("word") <= LONGEST))
    found = stash(found.select("word", F.length("word").alias("chars"), F.floor(F.log2("n") * 8).cast("int").alias("step")), "sampled-words")
    words = held = 0
    least = None
    for r in sorted(found.groupBy("step").agg(F.count("*").alias("words"), F.sum("chars").alias("chars")).collect(), reverse=True):
        words, held = words + r.words, held + r.chars
        if words > most or held > chars:
            break
        least = r.step
    return count_pieces(found.filter(F.col("step") >= least if least is not None else F.lit(False)), path).toArrow()


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, text_col: str = "text", words: int = DICTIONARY) -> DataFrame:
    """All columns of ``docs`` but the text, plus n_bytes, n_tokens and over_limit.

    Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside texts are what the library
    makes of them by default; repeated rows are counted row by row; an empty table gives an empty table;
    input columns named like the added ones are replaced.
    """
    path = path or default_path()
    rest = replace_columns(docs, "n_bytes", "n_tokens", "over_limit")
    at = column(rest, text_col)
    names = [c for i, c in enumerate(rest.columns) if i != at]
    plain = rest.toDF(*[f"c{i}" if i != at else "text" for i in range(len(rest.columns))])
    kept = [c for c in plain.columns if c != "text"]

    prepare(docs.sparkSession)
    known = dictionary(plain.select("text"), path, words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as w:
        w.write_table(known)
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizer(path).split
        if key not in _loaded:
            _loaded.clear()
            t = pa.ipc.open_stream(sent.value).read_all()
            _loaded[key] = dict(zip(t["word"].to_pylist(), t["pieces"].to_pylist(), strict=True))
        get = _loaded[key].get
        for b in batches:
            n_bytes, n_known, rare, often = [], [], [], []
            for x in b.column(b.schema.get_field_index("text")):
                text, total, others = x.as_py() or "", 0, {}
                for word, n in Counter(split(text)).items():
                    if (pieces := get(word)) is None:
                        others[word] = n
                    else:
                        total += n * pieces
                n_bytes.append(len(text.encode()))
                n_known.append(total)
                rare.append(list(others))
                often.append(list(others.values()))
            cols = [*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(n_bytes, pa.int64()), pa.array(n_known, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_bytes", "known", "rare", "often"])
        tidy()

    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "n_bytes long", "known long", "rare array<string>", "often array<long>"])
    counted = stash(plain.mapInArrow(count, schema).withColumn("_row", F.monotonically_increasing_id()), "counted")
    each = counted.select("_row", F.explode(F.arrays_zip("rare", "often")).alias("w")).select("_row", F.col("w.rare").alias("word"), F.col("w.often").alias("n"))
    pieces = stash(count_pieces(each.groupBy("word").agg(F.count("*")), path), "pieces")
    more = each.join(pieces, "word").groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    out = counted.drop("rare", "often").join(more, "_row", "left").select(*kept, "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
    return out.toDF(*names, "n_bytes", "n_tokens", "over_limit")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole text by ``byte_bpe_50k.json``: doc_id, n_bytes long, n_tokens long, over_limit boolean. Defined cases: as for ``count_tokens``."""
    return count_tokens(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
