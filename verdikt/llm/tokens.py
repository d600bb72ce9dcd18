"""Token ids of whole texts with a word cache that gives the tokenizer's own ids."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

UNUSUAL = re.compile(r"[^\S \n]|\s\s|<\|")
CACHE_WORDS = 100_000


@lru_cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}


@lru_cache
def encoding(path: str, pattern: str):
    """A tiktoken encoding of the ranks at ``path``."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


class WordCache(dict):
    """32-bit ids of ``prefix`` + word; the first CACHE_WORDS words are remembered."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        data = array("I", self.encode(self.prefix + word)).tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = data
        return data


class Ids:
    """``ids(text)``: little-endian 32-bit ids as the tokenizer file gives them, none added.

    ``vocabulary`` is the tokenizer file, ``table`` the same vocabulary as ranks.
    Byte-level BPE splits a text at every space or line feed that stands alone
    between other characters, so a text without other white space is the sum of
    its words, and most words are remembered.  All other texts, and texts that
    could spell a special token, go through the tokenizer whole.
    """

    def __init__(self, vocabulary: str, table: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        words = encoding(table, pattern).encode_ordinary
        self.first, self.later = WordCache(words, ""), WordCache(words, " ")
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if UNUSUAL.search(text) or text[0].isspace() or text[-1].isspace():
            return self.whole(text)
        first, later = self.first, self.later
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(first[head] + b"".join([later[word] for word in rest]))
        return self.feed.join(lines)


@lru_cache
def ids_of(vocabulary: str, table: str, pattern: str) -> Ids:
    """One per worker process."""
    return Ids(vocabulary, table, pattern)
