"""Where the tokens of a text stand: counts, cuts and truncation by search over offsets, with one pass of the tokenizer over each text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

#: Starts and ends of a text's tokens, ascending. Tokens don't reach across white space, so that texts joined by it have the tokens of both.
Tokenizer = Callable[[str], tuple[np.ndarray, np.ndarray]]

_RUN = re.compile(r"\S+")
#: Where a text is best cut, the best first: behind paragraphs, sentences, words.
MARKS = tuple(map(re.compile, (r"\n\s*\n", r"[.!?…]+\s+", r"\s+")))


def runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by white space."""
    spans = [m.span() for m in _RUN.finditer(text)]
    found = np.array(spans, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


class Offsets:
    """A text's tokens, and its best places to cut once they are asked for."""

    def __init__(self, text: str, tokenizer: Tokenizer = runs):
        self.text = text
        self.starts, self.ends = tokenizer(text)
        self._marks: list[np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def count(self, a: int, b: int) -> int:
        """Tokens of text[a:b], those that are cut too."""
        return max(0, int(np.searchsorted(self.starts, b) - np.searchsorted(self.ends, a, side="right"))) if a < b else 0

    def reach(self, a: int, budget: int) -> int:
        """The furthest b so that text[a:b] has no more than budget tokens."""
        k = int(np.searchsorted(self.ends, a, side="right")) + max(0, budget)
        return max(a, int(self.starts[k])) if k < len(self.starts) else len(self.text)

    def back(self, b: int, budget: int) -> int:
        """The first a so that text[a:b] has no more than budget tokens."""
        k = int(np.searchsorted(self.starts, b)) - max(0, budget)
        return min(b, int(self.ends[k - 1])) if k > 0 else 0

    def cut(self, low: int, high: int) -> int:
        """The best place from low to high: the last end of a paragraph, else of a sentence, else of a word, else high itself."""
        if self._marks is None:
            self._marks = [np.array([m.end() for m in mark.finditer(self.text)], np.int64) for mark in MARKS]
        for ends in self._marks:
            k = int(np.searchsorted(ends, high, side="right"))
            if k and ends[k - 1] >= low:
                return int(ends[k - 1])
        return high

    def slices(self, budget: int, overlap: int = 0, overlap_chars: int = 512, marks: bool = True) -> list[tuple[int, int]]:
        """The text in parts of at most budget tokens, each cut in its second half at the best place, and beginning with up to overlap tokens of the one before (half the budget at most)."""
        if budget < 1:
            raise ValueError("no room for text")
        found, start, done, overlap = [], 0, 0, min(overlap, budget // 2)
        while True:
            end = self.reach(start, budget)
            if end < len(self.text) and marks:
                end = self.cut(max(start + (end - start) // 2, done + 1), end)
            done = end
            found.append((start, end))
            if end >= len(self.text):
                return found
            start = max(start + 1, end - overlap_chars, self.back(end, overlap)) if overlap else end


def counted(texts: Sequence[str | None], tokenizer: Tokenizer = runs) -> list[int]:
    """Tokens of a batch of texts, 0 for null; repeated ones are tokenised once."""
    known = {t: len(tokenizer(t)[0]) for t in set(texts) if t is not None}
    return [0 if t is None else known[t] for t in texts]


def shared_budget(one: int, two: int, budget: int) -> tuple[int, int]:
    """How many tokens of a pair stay within a budget if the longer side gives way first, and of equal ones the second."""
    if one + two <= budget:
        return one, two
    half = budget // 2
    if one <= half:
        return one, budget - one
    if two <= half:
        return budget - two, two
    return budget - half, half


def pair_truncated(one: Offsets, two: Offsets, budget: int) -> tuple[str, str]:
    """Both texts cut to a shared budget of tokens, by their offsets: neither is tokenised again."""
    a, b = shared_budget(len(one), len(two), max(0, budget))
    cut = lambda x, n: x.text if n == len(x) else x.text[: int(x.ends[n - 1]) if n else 0]
    return cut(one, a), cut(two, b)
