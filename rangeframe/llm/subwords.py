"""Hashed character n-grams of words, shared by the two text classifiers.

A text is a sequence of lower-cased words; a word is the bag of its n-grams (with border marks) and,
if asked for, of itself. All numbers of a word are computed once in a worker and then looked up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np

WORD = re.compile(r"\w+")


def grams(word: str, least: int, most: int, buckets: int, whole: bool) -> list[int]:
    """Hashed n-grams of ``<word>`` with ``least`` to ``most`` characters, and of the word itself."""
    marked = f"<{word}>"
    raw = marked.encode()
    if len(raw) == len(marked):
        out = [zlib.crc32(raw[k : k + n]) % buckets for n in range(least, most + 1) for k in range(len(raw) - n + 1)]
    else:
        out = [zlib.crc32(marked[k : k + n].encode()) % buckets for n in range(least, most + 1) for k in range(len(marked) - n + 1)]
    if whole:
        out.append(zlib.crc32(b"\x00" + raw) % buckets)
    return out


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordSums(dict):
    """Sums over the n-grams of a word of the rows of a table.

    Maps a word to its row in ``rows``, filled on demand; at most ``most`` words are remembered.
    """

    #: Numbers that one step of a sparse product holds.
    STEP = 1 << 22

    def __init__(self, table: np.ndarray, split: Callable[[str], list[int]], most: int = 200_000, step: int = STEP):
        super().__init__()
        self.table, self.split, self.most, self.step = table, split, most, step
        self.rows = np.zeros((1024, table.shape[1] + 1))

    def learn(self, unseen: list[str]) -> None:
        """Rows of new words: their n-grams (a sparse matrix of 0 and 1) times the table."""
        per_step = max(1, self.step // (16 * self.table.shape[1]))
        while len(self) + len(unseen) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for at in range(0, len(unseen), per_step):
            part = unseen[at : at + per_step]
            ids = [self.split(w) for w in part]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
            k = len(self)
            self.rows[k : k + len(part), :-1] = np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            self.rows[k : k + len(part), -1] = sizes
            self.update(zip(part, range(k, k + len(part))))

    def of_texts(self, texts: list[str], distinct: bool = False) -> np.ndarray:
        """Sums over all n-grams of each text (or of its distinct words), and their number at the end.

        The product of a sparse matrix, texts by words, with the words' rows, in steps of whole texts.
        """
        if len(self) >= self.most:
            self.clear()
        found = [sorted(set(words(t))) if distinct else words(t) for t in texts]
        unseen = set().union(*found).difference(self)
        if unseen:
            self.learn(sorted(unseen))
        out = np.zeros((len(texts), self.rows.shape[1]))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes)
        per_step = max(1, self.step // self.rows.shape[1])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + per_step, side="right")))
            full = np.flatnonzero(sizes[at:to]) + at
            if len(full):
                row = np.fromiter(chain.from_iterable(map(self.__getitem__, f) for f in found[at:to]), np.int64, int(sizes[at:to].sum()))
                if len(row) > per_step:  # one long text
                    out[at] = sum(self.rows[row[k : k + per_step]].sum(axis=0) for k in range(0, len(row), per_step))
                else:
                    out[full] = np.add.reduceat(self.rows[row], np.cumsum(sizes[full]) - sizes[full], axis=0)
            at = to
        return out


def gram_counts(text: str, split: Callable[[str], list[int]], distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram ids of a text (or of its distinct words) and how often each occurs."""
    counted: Counter[int] = Counter()
    for w, n in Counter(words(text)).items():
        for g in split(w):
            counted[g] += 1 if distinct else n
    ids = np.fromiter(counted.keys(), np.int32, len(counted))
    return ids, np.fromiter(counted.values(), np.int32, len(counted))
