"""Token ids of a byte-level vocabulary, read from a file that every executor has."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import tiktoken

#: Splits text before byte pairs are merged (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary in a file of ranks (.tiktoken) or of the tokenizers library (.json)."""
    if path.endswith(".json"):
        names = byte_names()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary = whole["model"]["vocab"]
        special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        ranks = {bytes(names[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    else:
        special = {}
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Tokens:
    """Encodes whole texts; strings that name special tokens of the file become these, as in the tokenizers library."""

    def __init__(self, path: str):
        self.encoding = encoding(path)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def byte_bpe_50k() -> str:
    """The path of the installed vocabulary, the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def word_bpe_49k() -> str:
    """The path of the installed vocabulary of lower-case words, the same on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
