"""Byte-level BPE encoding and decoding: speculate, verify, and merge exactly only where needed.

Speculation proposes tokens of a word by greedy longest match. A proposal equals the result of the
merges if and only if every token is the result of its own bytes and no merge crosses the border of two
neighbours; both depend on single tokens and adjacent pairs only. A border is crossed if some token
``a`` on the right edge of the left neighbour and some token ``b`` on the left edge of the right neighbour
merge (rank r) while both are there: before ``a`` is consumed (r < rank of its parent) and not after ``b``
is (r <= rank of its parent; at the same rank the leftmost merge comes first). All pairs of a batch are
tested with numpy, each distinct pair once in a worker. Words with a failing pair are merged exactly.

Cases: null texts are empty texts (no tokens); texts of any length are encoded whole; strings of
special tokens inside a text become that token, as in the library's default; null doc_ids pass through and equal rows
give equal rows; further columns are ignored, or pass through if they are kept, unless named like an added one; an
empty table gives an empty result. Ids decode to the bytes that they came from. A vocabulary of another kind
(normalizer, other pre-tokenizer, merges that yield to whole words) raises ValueError.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeframe.llm.common import apart, map_text
from rangeframe.llm.token_counts import pieces, splits_at_spaces

# The pre-token pattern of byte-level BPE, as the vocabulary's documentation states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces a worker remembers, and the longest that is worth it.
REMEMBERED, REMEMBERED_WORDS, LONGEST_REMEMBERED = 200_000, 400_000, 64
#: Token pairs whose compatibility a worker remembers.
REMEMBERED_PAIRS = 500_000
#: Words of at most so many bytes are merged by scanning, longer ones with a heap.
SCANNED = 48
NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's strings: printable bytes stand for
    themselves, the others in order for code points from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary with its ordered merges."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]], special: dict[str, int]):
        """merges: (left, right, merged) ids in order of rank; special: added tokens."""
        self.tokens, self.special = tokens, special
        size = max([*tokens.values(), *special.values(), -1]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in tokens.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.rank = {(a, b): (r, m) for r, (a, b, m) in reversed(list(enumerate(merges)))}
        self.base = np.array([tokens.get(bytes([b]), -1) for b in range(256)])
        # Edges: the two parts of each token (itself for bytes) and the rank at which it arises.
        self.left, self.right = np.arange(size), np.arange(size)
        self.born = np.full(size, -1, np.int64)
        for r, (a, b, m) in enumerate(merges):
            if self.born[m] < 0 and a != m and b != m:
                self.left[m], self.right[m], self.born[m] = a, b, r
        self.size = np.int64(size)
        pairs = sorted((a * size + b, r) for (a, b), (r, _) in self.rank.items())
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [0], np.int64)
        self.rank_of = dict(pairs)
        self.made = [m for _, _, m in merges]
        merged = self.born >= 0
        ids = np.flatnonzero(merged)
        whole = np.ones(size, bool)
        crossed = self.crossed(self.left[ids], self.right[ids], self.born[ids])
        for i, bad in sorted(zip(ids.tolist(), crossed.tolist()), key=lambda x: self.born[x[0]]):
            whole[i] = not bad and whole[self.left[i]] and whole[self.right[i]]
        for b, i in tokens.items():  # tokens that no merge makes
            if len(b) > 1 and not merged[i]:
                whole[i] = False
        #: What greedy matching may propose: tokens that are the merges' result for their own bytes.
        self.proposed = {b: i for b, i in tokens.items() if whole[i]}
        self.by_first = {}
        for b in self.proposed:
            self.by_first[b[:2]] = max(self.by_first.get(b[:2], 0), len(b))
        self.fits: dict[int, bool] = {}

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not splits_at_spaces(spec):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        byte = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(map(byte.__getitem__, s))
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ids = {s: i for s, i in spec["model"]["vocab"].items() if s not in special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        return cls({raw(s): i for s, i in ids.items()}, merges, special)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def crossed(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Where a merge (before rank ``until``) joins bytes of both neighbours."""
        n = len(left)
        out = np.zeros(n, bool)
        top = np.full(n, NEVER) if until is None else until.astype(np.int64)
        rows, a, a_dies = np.arange(n), left.astype(np.int64), top.copy()
        while len(rows):
            inner, b, b_dies = np.arange(len(rows)), right[rows].astype(np.int64), top[rows].copy()
            while len(inner):
                r = self._pair_rank(a[inner], b)
                # At the top of the right neighbour an equal rank is the merge that makes the whole token.
                late = np.where(b_dies == top[rows[inner]], r < b_dies, r <= b_dies)
                out[rows[inner]] |= (r < a_dies[inner]) & late
                down = self.left[b] != b
                b_dies = self.born[b][down]
                b, inner = self.left[b][down], inner[down]
            down = (self.right[a] != a) & ~out[rows]
            a_dies = self.born[a][down]
            a, rows = self.right[a][down], rows[down]
        return out

    def greedy(self, word: bytes) -> list[int] | None:
        """Tokens by longest match; None if some byte has no token."""
        out, at, end, known = [], 0, len(word), self.proposed
        while at < end:
            size = min(self.by_first.get(word[at : at + 2], 1), end - at)
            while size > 1 and word[at : at + size] not in known:
                size -= 1
            token = known.get(word[at : at + size])
            if token is None:
                return None
            out.append(token)
            at += size
        return out

    def merged(self, word: bytes) -> list[int]:
        """Tokens by the merges themselves."""
        ids = [i for i in self.base[np.frombuffer(word, np.uint8)].tolist() if i >= 0]
        return self._scan(ids) if len(ids) <= SCANNED else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        """Merges the best pair again and again; ranks of the pairs stand beside the ids."""
        rank, size, made = self.rank_of, int(self.size), self.made
        never = int(NEVER)
        ranks = [rank.get(a * size + b, never) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get(ids[k - 1] * size + ids[k], never)
            if k < len(ranks):
                ranks[k] = rank.get(ids[k] * size + ids[k + 1], never)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(queue)
        while queue:
            _, k, p = heapq.heappop(queue)
            j = after[k]
            if j >= n or (ids[k], ids[j]) != p:
                continue
            ids[k], ids[j], after[k] = rank[p][1], -1, after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (q := (ids[x], ids[y])) in rank:
                    heapq.heappush(queue, (rank[q][0], x, q))
        return [i for i in ids if i >= 0]

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token: proposals whose every pair is compatible, else exact merges."""
        proposed = [self.greedy(w) for w in words]
        flat = np.fromiter((i for p in proposed for i in p or ()), np.int64)
        sizes = np.fromiter((len(p or ()) for p in proposed), np.int64, len(words))
        ends = np.cumsum(sizes)
        if len(flat) > 1:
            key = flat[:-1] * self.size + flat[1:]
            inside = np.ones(len(flat) - 1, bool)
            inside[(ends[(ends > 0) & (ends < len(flat))] - 1)] = False
            distinct, where = np.unique(key[inside], return_inverse=True)
            if len(self.fits) > REMEMBERED_PAIRS:
                self.fits.clear()
            new = np.array([k for k in distinct.tolist() if k not in self.fits], np.int64)
            if len(new):
                self.fits.update(zip(new.tolist(), (~self.crossed(new // self.size, new % self.size)).tolist()))
            fits = np.array([self.fits[k] for k in distinct.tolist()], bool)
            fails = np.zeros(len(flat), np.int64)
            fails[np.flatnonzero(inside)] = ~fits[where] if len(distinct) else 0
            total = np.concatenate([[0], np.cumsum(fails)])
            bad = total[ends] != total[ends - sizes]
        else:
            bad = np.zeros(len(words), bool)
        return [self.merged(w) if wrong or p is None else p for w, p, wrong in zip(words, proposed, bad.tolist())]


class Encoder:
    """Encodes and decodes texts; remembers the ids of frequent pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(PATTERN)
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) or r"(?!)")
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.table = vocabulary.bytes_of

    def _segments(self, text: str) -> Iterable[str | int]:
        at = 0
        for m in self.specials.finditer(text):
            yield text[at : m.start()]
            yield self.vocabulary.special[m[0]]
            at = m.end()
        yield text[at:]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens, as little-endian 32-bit integers."""
        rows = list(map(self.pattern.findall, texts))
        words = self.words
        if len(words) > REMEMBERED_WORDS:
            words.clear()
        unseen = list(set().union(*rows).difference(words))
        words.update((w, array("I", x).tobytes()) for w, x in zip(unseen, self.vocabulary.words([w.encode() for w in unseen])))
        out = [b"".join(map(words.__getitem__, row)) for row in rows]
        for w in unseen:
            if len(w) > LONGEST_REMEMBERED:
                del words[w]
        return out

    def _with_specials(self, text: str) -> bytes:
        return b"".join(s.to_bytes(4, "little") if isinstance(s, int) else self._plain([s])[0] for s in self._segments(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {k: self._with_specials(t) for k, t in enumerate(texts) if any(s in t for s in self.vocabulary.special)}
        split = [pieces(t) if k not in special else ("", []) for k, t in enumerate(texts)]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        unseen = list(set().union(*(rest for _, rest in split)).difference(known))
        known.update(zip(unseen, self._plain([" " + p for p in unseen])))
        heads = self._plain([first for first, _ in split])
        out = [b"".join([h, *map(known.__getitem__, rest)]) for h, (_, rest) in zip(heads, split)]
        for p in unseen:
            if len(p) > LONGEST_REMEMBERED:
                del known[p]
        return [special.get(k, x) for k, x in enumerate(out)]

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian 32-bit); bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_VOCABULARIES: dict[str, Vocabulary] = {}


def encoder(path: str) -> Encoder:
    """An encoder that remembers nothing yet. The vocabulary is read once in a worker process, which is reused between
    tasks; what an encoder remembers (pieces, words, pairs) is its own and goes with its task."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.from_json(path)
    own = copy.copy(_VOCABULARIES[path])
    own.fits = {}
    return Encoder(own)


def bpe_encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with token_ids (array<int>) and n_tokens."""

    def make():
        coder = encoder(path)

        def work(texts: list[bytes]) -> dict:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode([t.decode("utf-8", "replace") for t in texts])]
            return {"token_ids": ids, "n_tokens": np.fromiter(map(len, ids), np.int64, len(ids))}

        return work

    return map_text(docs, keep, text, "token_ids array<int>, n_tokens long", make)


def bpe_encode_decode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with token_ids (array<int>), n_tokens, and decoded_sha256 of the text that the ids decode to."""

    def make():
        coder = encoder(path)

        def work(texts: list[bytes]) -> dict:
            raw = coder.encode([t.decode("utf-8", "replace") for t in texts])
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in raw]
            decoded = [hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in raw]
            return {"token_ids": ids, "n_tokens": np.fromiter(map(len, ids), np.int64, len(ids)), "decoded_sha256": decoded}

        return work

    return map_text(docs, keep, text, "token_ids array<int>, n_tokens long, decoded_sha256 string", make)


def bpe_decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "token_ids") -> DataFrame:
    """``keep`` columns with the decoded text of an id column (null ids: empty text)."""
    source = encoded.select(*[F.col(f"`{k}`") for k in keep], F.col(ids).alias(apart(keep, "__ids")[0]))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [coder.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return source.mapInArrow(run, fields)


def bpe_round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and the text that is decoded from them."""

    def make():
        coder = encoder(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def work(texts: list[bytes]) -> dict:
            ids = coder.encode([t.decode("utf-8", "replace") for t in texts])
            return {
                "n_tokens": np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids)),
                "ids_sha256": [sha(x) for x in ids],
                "decoded_sha256": [sha(coder.decode(x).encode()) for x in ids],
            }

        return work

    return map_text(docs, [doc_id], text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
