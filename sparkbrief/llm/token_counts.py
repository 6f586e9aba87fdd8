"""Token counts by rank-synchronous merging of ragged numpy arrays.

Texts are split into pre-tokens. The distinct ones of a slice of rows lie end to end in
one array of symbols; in every round each sequence merges all places of its own
lowest-ranked pair at once. Sequences without a pair to merge leave the arrays with the
number of symbols that survive. Nothing leaves a row's task, so there is no shuffle.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.llm.common import arrow_map

CACHE = 300_000  # pre-tokens a worker remembers; a full memory is emptied, results don't change
NEVER = np.int64(1 << 40)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, and the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _fast_pattern(limit: int = 0x250) -> tuple[re.Pattern, re.Pattern]:
    """The splitting rule for the standard engine, and a pattern of characters it must not meet.

    Both engines are asked about every character below ``limit``; those they class differently
    are unsafe, and so is everything from ``limit`` on.
    """
    classes = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    safe = [
        chr(c)
        for c in range(limit)
        if all(bool(regex.match(a, chr(c))) == bool(re.match(b, chr(c))) for a, b in classes)
        and not 0x1C <= c <= 0x1F
    ]
    split = re.compile(
        r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
    )
    return split, re.compile("[^" + "".join(re.escape(c) for c in safe) + "]")


class Merger:
    """Merge rules of a byte-level vocabulary file, held as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.base = np.zeros(256, dtype=np.int64)
        for shown, byte in byte_symbols().items():
            self.base[byte] = vocabulary[shown]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.fast, self.unsafe = _fast_pattern()
        self.known: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def lengths(self, tokens: list[str]) -> np.ndarray:
        """Number of symbols left of each non-empty pre-token."""
        raw = [t.encode() for t in tokens]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        symbols = self.base[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        left = sizes.copy()
        while len(symbols) > 1:
            rank = self._rank(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NEVER
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.append(rank, NEVER), first)
            spread = np.repeat(lowest, np.diff(np.append(first, len(owner))))[:-1]
            chosen = (rank == spread) & (rank < NEVER)
            # Places that overlap (a a a) are taken from the left, every other one.
            start = chosen & ~np.r_[False, chosen[:-1]]
            index = np.arange(len(chosen))
            run = np.maximum.accumulate(np.where(start, index, 0))
            chosen &= (index - run) % 2 == 0
            at = np.flatnonzero(chosen)
            if not len(at):
                break
            symbols[at] = self.merged[rank[at]]
            left -= np.bincount(owner[at], minlength=len(left))
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            alive = np.zeros(len(left), dtype=bool)
            alive[owner[at]] = True
            keep &= alive[owner]
            symbols, owner = symbols[keep], owner[keep]
        return left

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.special is None:
            parts = [text]
        else:
            parts = self.special.split(text)
        found: list[str] = []
        for part in parts:
            rule = self.split if self.unsafe.search(part) else self.fast
            found += rule.findall(part)
        return found, len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string inside a text is one token."""
        split = [self._pieces(t) for t in texts]
        fresh = set().union(*[p for p, _ in split]).difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            self.known = {}
            fresh = set().union(*[p for p, _ in split])
        if fresh:
            names = list(fresh)
            self.known.update(zip(names, self.lengths(names).tolist(), strict=True))
        known = self.known
        return [sum(map(known.__getitem__, p)) + special for p, special in split]


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One per worker and vocabulary file."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs(doc_id, text)``.

    ``vocabulary``: path of a byte-level BPE file that every executor can open. A null text
    counts as empty (0 bytes, 0 tokens). Every input row, repeated ones too, gives one row;
    a null id stays null; other columns are not looked at. An empty table gives an empty one.
    """

    def make(part: pa.RecordBatch) -> dict[str, list]:
        texts = [t or "" for t in part.column("text").to_pylist()]
        counts = merger(vocabulary).counts(texts)
        return {
            "doc_id": part.column("doc_id"),
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
