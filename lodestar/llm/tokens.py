"""Token ids and the characters at which tokens start.

The vocabulary is read in its ranks form, which gives the same ids as its JSON form in less time; tests compare both.
The look-ahead in the vocabulary's pattern only matters for runs of white space, so texts without one are encoded by
the pattern without it. A special token's string in a text has that token's id, as in the JSON form.
"""

from __future__ import annotations

import base64
import re

import numpy as np

#: Special tokens of the vocabulary with their ids. Fixed values.
SPECIAL = {"<|endoftext|>": 50256}

_RUN = re.compile(r"\s\s")
_open: dict[str, Vocabulary] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    def __init__(self, path: str, special: dict[str, int] = SPECIAL):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        whole = public_tokenizers.PATTERN
        made = [tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (whole, whole.replace(r"\s+(?!\S)|", ""))]
        self.whole, self.plain = made
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.lengths = np.zeros(1 + max(max(ranks.values()), *special.values(), 0), np.int64)
        for token, i in [*ranks.items(), *((x.encode(), i) for x, i in special.items())]:
            self.lengths[i] = len(token)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, unsigned 32-bit, little-endian."""
        if self.cut and self.cut.search(text):  # what stands between special tokens is encoded by itself
            return np.array([i for p in self.cut.split(text) if p for i in ([self.special[p]] if p in self.special else self._ordinary(p))], dtype="<u4")
        return np.array(self._ordinary(text), dtype="<u4")

    def _ordinary(self, text: str) -> list[int]:
        return (self.whole if _RUN.search(text) else self.plain).encode_ordinary(text)

    def token_starts(self, text: str) -> np.ndarray:
        """For every token, the index of the character in which its first byte lies."""
        ids = self.encode(text)
        at = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        if text.isascii():
            return at
        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return (np.cumsum(first) - 1)[at]


def open_vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    if path not in _open:
        _open[path] = Vocabulary(path)
    return _open[path]
