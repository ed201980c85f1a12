"""Byte-level BPE ids from a tokenizers JSON file, through the faster of the two installed encoders."""

from __future__ import annotations

import json

import numpy as np

#: The pre-token pattern of the byte-level BPE family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, Bpe] = {}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a tokenizers JSON file with a byte-level BPE model.

    Spelling: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(spelt[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return ranks, special


class Bpe:
    """The byte-level BPE of a tokenizers JSON file, special tokens in a text included."""

    def __init__(self, path: str):
        import tiktoken

        ranks, self.special = vocabulary(path)
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.allowed = frozenset(self.special)

    @classmethod
    def load(cls, path: str) -> Bpe:
        """One instance per Python worker."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text`` as an array of unsigned 32-bit integers."""
        return self.core.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
