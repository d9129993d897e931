"""Pre-tokens and ids of a public tokenizer's vocabulary file, as its own library gives them.

A byte-level BPE never merges across pre-tokens, so a text's ids are the ids of its pre-tokens, one after the other.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import regex


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _unsure() -> re.Pattern:
    """Characters that only one of two Unicode versions counts as a letter or number; texts with any are left to the library."""
    letter = regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and letter.match(chr(c))]
    runs: list[list[int]] = []
    for c in new:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]") if runs else re.compile(r"(?!)")


def _same_by_ranks(model: dict):
    """The same byte-pair encoding in a faster library; None unless the file's merges come in the order of their ids, which makes the two equal."""
    import public_tokenizers
    import tiktoken

    vocab = model["vocab"]
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ranks = [vocab[j] for j in joined]
    if ranks != sorted(set(ranks)) or len(vocab) != len(ranks) + 256:
        return None
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in the file
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    tokens = {bytes(shown[c] for c in word): i for word, i in vocab.items()}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={})


class PreTokenizer:
    """Splits texts as the file's byte-level pre-tokenizer does; encodes single pre-tokens with the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        pre = described["pre_tokenizer"]
        if described.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: only a plain byte-level BPE splits into independent pre-tokens")
        import public_tokenizers

        self._path = path
        self._fast = _same_by_ranks(described["model"])
        self._words = regex.compile(public_tokenizers.PATTERN).findall
        special = [t["content"] for t in described["added_tokens"]]
        self._unsure = _unsure()
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    @cached_property
    def library(self):
        """The file's own library; loaded only where the faster one may differ."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def split(self, text: str) -> list[str]:
        """Pre-tokens; a special string inside the text is one of its own (the pattern never gives such a word)."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self._special.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not self._unsure.search(text):
            return self._words(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit numbers."""
        if self._special is None or not self._special.search(text):
            return self._encode(text)
        parts = self._special.split(text)
        return np.concatenate([self._library_ids(p) if i % 2 else self._encode(p) for i, p in enumerate(parts)])

    def _encode(self, text: str) -> np.ndarray:
        if self._fast is None or not (text.isascii() or not self._unsure.search(text)):
            return self._library_ids(text)
        return self._fast.encode_to_numpy(text, disallowed_special=())

    def _library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, words: list[str]) -> list[list[int]]:
        if self._fast is None:
            return [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)]
        return [self.encode(w).tolist() for w in words]


@lru_cache(maxsize=4)
def pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)
