"""Byte-level BPE ids of whole texts, with a cache of words.

A space before a character that is not white space always starts a new pre-token, so a text
splits there without changing its ids, and the parts repeat. Parts not seen before go through
the BPE itself; texts that hold special tokens go through the tokenizer file as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 250_000
_UNSAFE = re.compile(r" (?:\s|$)")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable ones stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return table


class _Words(dict):
    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(self.prefix + word), "<u4").tobytes()
        if len(self) < CACHE and len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Text to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.bpe = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.first = _Words(self.bpe.encode_ordinary, "").__getitem__
        self.later = _Words(self.bpe.encode_ordinary, " ").__getitem__

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special and self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _UNSAFE.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        return (self.first(head) if head else b"") + b"".join(map(self.later, rest))
