"""Token counts: batch encoding in Arrow functions that return lengths only.

Each Arrow batch is cut into runs of about equal bytes. Long texts are split at safe boundaries: a
position between a non-space character and a space is always a border between two pre-tokens, and
no rule of the pre-tokenizer looks back across it, so lengths of the pieces add up to the length of the
whole text. Pieces that a worker has seen before are looked up; the rest go to the library in
batches that hold about equal bytes.

That holds for byte-level BPE vocabularies, which is read from the file; with any other tokenizer (a normalizer,
another pre-tokenizer, a sentencepiece model) texts go to the library whole.

Cases: null and empty texts count 0 tokens; texts of any length are encoded whole; strings of special
tokens inside a text are handled as the library does by default; null doc_ids pass through and equal rows give equal
rows; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from rangeframe.llm.common import map_text

#: Pieces a worker remembers, and bytes of unseen pieces that go to the library at once.
REMEMBERED, ENCODE_BYTES = 500_000, 1 << 20
#: Longer pieces are not worth a place in memory.
LONGEST_REMEMBERED = 64

_DOUBTFUL = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S)(?= )")


def pieces(text: str) -> tuple[str, list[str]]:
    """The text as a first piece and pieces that each begin after a safe space.

    The text is ``first + ''.join(' ' + p for p in rest)``.
    """
    if _DOUBTFUL.search(text) is None:
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _SAFE.split(text)
    return first, [p[1:] for p in rest]


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's file describes byte-level BPE for which ``pieces`` are encoded on their own."""
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not (model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or [])
    return plain and byte_level and added and spec.get("normalizer") is None


class _Counts(dict):
    """Token counts by piece (with its leading space)."""

    def __init__(self, encode: Callable[[list[str]], list[int]]):
        super().__init__()
        self.encode = encode

    def learn(self, unseen: list[str]) -> None:
        batch: list[str] = []
        size = 0
        for p in unseen:
            batch.append(p)
            size += len(p)
            if size >= ENCODE_BYTES:
                self.update(zip(batch, self.encode([" " + x for x in batch])))
                batch, size = [], 0
        if batch:
            self.update(zip(batch, self.encode([" " + x for x in batch])))


def counter(path: str) -> Callable[[list[str]], np.ndarray]:
    """A function from texts to token counts, by the tokenizer file at ``path`` (.json, or .model of sentencepiece)."""
    if path.endswith(".model"):
        import sentencepiece

        pieces_of = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.fromiter((len(pieces_of.encode(t)) for t in texts), np.int64, len(texts))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(batch: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        if not splits_at_spaces(json.load(f)):
            return lambda texts: np.fromiter((encode([t])[0] for t in texts), np.int64, len(texts))
    counts = _Counts(encode)

    def count(texts: list[str]) -> np.ndarray:
        split = [pieces(t) for t in texts]
        if len(counts) > REMEMBERED:
            counts.clear()
        unseen = set().union(*(rest for _, rest in split)).difference(counts)
        counts.learn(list(unseen))
        heads = encode([first for first, _ in split])
        out = np.fromiter((h + sum(map(counts.__getitem__, rest)) for h, (_, rest) in zip(heads, split)), np.int64, len(texts))
        for p in unseen:
            if len(p) > LONGEST_REMEMBERED:
                del counts[p]
        return out

    return count


_COUNTERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _counter(path: str) -> Callable[[list[str]], np.ndarray]:
    """One counter for each worker process and file; workers are reused between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""

    def make():
        count = _counter(path)

        def work(texts: list[bytes]) -> dict:
            n = count([t.decode("utf-8", "replace") for t in texts])
            return {"n_bytes": np.fromiter(map(len, texts), np.int64, len(texts)), "n_tokens": n, "over_limit": n > limit}

        return work

    return map_text(docs, [doc_id], text, "n_bytes long, n_tokens long, over_limit boolean", make)
