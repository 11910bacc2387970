"""Exact ids of a byte-level BPE tokenizer file, through the faster of two engines.

A second BPE engine is built from the same vocabulary file; it is used only if the file's merges stand
in the order of their ids (then both engines merge alike). Texts that hold the string of a special
token go to the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: The split pattern of the byte-level pre-tokenizer (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes to ids, if byte-pair merging by lowest id equals merging by the file's list of merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        return None
    return {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if all(c in back for c in token)}


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(map(re.escape, (t.content for t in self.tokenizer.get_added_tokens_decoder().values()))) or r"(?!)")
        self.encode = self._slow
        if ranks := _ranks(path):
            import tiktoken

            specials = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in specials}
            core = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.encode = lambda text: array("I", core(text)).tobytes()

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return self._slow(text) if self.special.search(text) else self.encode(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """By id, whether its text ends a sentence or a line."""
    t = encoder(path).tokenizer
    return np.array([bool(re.search(r"[.!?][\"')\]]?$|\n", t.decode([i]))) for i in range(t.get_vocab_size())])


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
