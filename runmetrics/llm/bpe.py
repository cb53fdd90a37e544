"""Pre-tokens of byte-level BPE vocabularies as the tokenizers library makes them."""

from __future__ import annotations

import functools
import json
import re

import public_tokenizers
import regex
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
# Unicode ranges in which the regex module and the tokenizers library agree on letters, numbers and spaces. Texts with
# other characters are split by the library itself.
COMMON = re.compile("[^\u0000-ԯḀ-ỿ‐-‧₠-₿぀-ゖァ-ヺ一-龥가-힣]")


@functools.cache
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Splitter:
    """Cuts texts into pre-tokens and the special strings among them."""

    def __init__(self, path: str | None = None):
        self.path = path or public_tokenizers.path(VOCABULARY)
        self.tokenizer = library(self.path)
        with open(self.path, encoding="utf-8") as file:
            self.model = json.load(file)
        self.special = {t["content"]: t["id"] for t in self.model["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = regex.compile(public_tokenizers.PATTERN)

    def words(self, text: str) -> list[str]:
        if COMMON.search(text):
            return [text[begin:end] for _, (begin, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self._words.findall(text)

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens in order, and the number of special strings between them."""
        if self._special is None or not self._special.search(text):
            return self.words(text), 0
        parts = self._special.split(text)
        return [word for part in parts[::2] for word in self.words(part)], len(parts) // 2
