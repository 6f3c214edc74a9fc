"""Exact ids of public tokenizers at word-cache speed.

A tokenizer of the two supported kinds never merges across the borders used here, so the ids of a
text are the ids of its segments in a row. Words repeat; each segment is encoded by the tokenizers
library once and remembered in a bounded dictionary of the worker.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"( ?[{LETTERS}]+)([!-&(-/:;=-@[-`{{-~]*)")
_OTHER_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Segments(dict):
    """Segment to its ids as little-endian unsigned 32-bit integers.

    ``spaced``: byte-level vocabularies whose pieces carry the space before a word. Otherwise white
    space only separates.
    """

    def __init__(self, path: str, spaced: bool, most: int = 700_000):
        super().__init__()
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced, self.most = spaced, most
        self.letters = _byte_letters()
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, key) -> bytes:
        text = key.decode() if isinstance(key, bytes) else key
        if plain := _PLAIN.fullmatch(text):
            # a run of letters and a run of marks: the pre-tokenizer would cut between them too
            head, marks = plain.groups()
            if not self.spaced:
                head = head.lower()
            if marks:
                pair = (head, marks) if isinstance(key, str) else (head.encode(), marks.encode())
                ids = self[pair[0]] + self[pair[1]]
            else:
                if self.spaced or not head.isascii():
                    head = "".join(map(self.letters.__getitem__, head.encode()))
                ids = array("I", [t.id for t in self.model.tokenize(head)]).tobytes()
        else:
            ids = self._whole(text)
        if len(self) >= self.most:
            self.clear()
        self[key] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return b""
        if not self.spaced:
            raw = text.encode()
            return b"".join(map(self.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))
        if "<|" in text or "\0" in text:
            return self._whole(text)
        if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text)):
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


_OPEN: dict[tuple[str, bool], Segments] = {}


def segments(path: str, spaced: bool) -> Segments:
    """The worker's own encoder of a vocabulary file."""
    if (path, spaced) not in _OPEN:
        _OPEN[path, spaced] = Segments(path, spaced)
    return _OPEN[path, spaced]
