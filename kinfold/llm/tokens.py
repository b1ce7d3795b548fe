"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie end to end in one array of symbols. In each round every sequence looks up the ranks of its
neighbouring pairs, finds its lowest, and all occurrences of that pair in it are merged at once, from the left where they
overlap. A sequence without a pair in the merge table is done; its surviving symbols are its tokens.

Defined results: null and empty texts have no token. Special strings of the vocabulary inside a text are one token each,
as the library's default has it. Of equal pairs that overlap the left one merges. Texts of any length are counted whole;
repeated rows are counted each; an empty table gives an empty one. Input columns named as a new one are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text
from .pretoken import Chunks, load_json, pattern, split_special

_NONE = np.int32(1 << 30)


class RankMerger:
    """Merges of a vocabulary as sorted pair keys."""

    def __init__(self, path: str):
        ids, merges, self.special = load_json(path)
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        left, right, new = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.base = int(max(ids.values())) + 1
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.new = key[order], order.astype(np.int32), new[order]

    def _pairs(self, s: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin ``at``; no pair crosses into the next sequence."""
        key = s[at] * self.base + s[np.minimum(at + 1, len(s) - 1)]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & ~last[at], self.ranks[k], _NONE), self.new[k]

    def counts(self, sequences: list[bytes], symbols: list | None = None) -> np.ndarray:
        """Tokens of each sequence; their ids too where ``symbols`` is a list of as many places."""
        n = len(sequences)
        out = np.zeros(n, np.int64)
        length = np.fromiter(map(len, sequences), np.int64, n)
        which = np.flatnonzero(length)
        length = length[which]
        s = self.bytes[np.frombuffer(b"".join(sequences), np.uint8)]
        last = np.zeros(len(s), bool)
        last[np.cumsum(length) - 1] = True
        rank, new = self._pairs(s, last, np.arange(len(s)))
        while len(which):
            start = np.cumsum(length) - length
            best = np.minimum.reduceat(rank, start)
            i = np.flatnonzero((rank == np.repeat(best, length)) & (rank < _NONE))
            if len(i):
                # of a run of overlapping hits every other one counts, from its first
                first = np.ones(len(i), bool)
                first[1:] = np.diff(i) > 1
                run = i[first][np.cumsum(first) - 1]
                i = i[(i - run) % 2 == 0]
                s[i] = new[i]
                last[i] = last[i + 1]
                held = np.ones(len(s), bool)
                held[i + 1] = False
                length = length - np.add.reduceat(~held, start, dtype=np.int64)
                s, last, rank, new = s[held], last[held], rank[held], new[held]
                i -= np.arange(len(i))  # their places now: each one before has taken one symbol away
                changed = np.zeros(len(s), bool)
                changed[i] = changed[np.maximum(i - 1, 0)] = True
                near = np.flatnonzero(changed)
                rank[near], new[near] = self._pairs(s, last, near)
            done = best == _NONE
            if done.any():
                out[which[done]] = length[done]
                if symbols is not None:
                    ends = np.cumsum(length)
                    for k in np.flatnonzero(done):
                        symbols[which[k]] = s[ends[k] - length[k] : ends[k]].tolist()
                held = np.repeat(~done, length)
                s, last, rank, new = s[held], last[held], rank[held], new[held]
                which, length = which[~done], length[~done]
        return out


class TokenCounter:
    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.special = sorted(self.merger.special)
        self.chunks = Chunks(self._make)

    def _make(self, chunks: list[str]) -> list[int]:
        split = pattern().findall
        tokens = [split(c) for c in chunks]
        new = sorted({t for x in tokens for t in x})
        known = dict(zip(new, self.merger.counts([t.encode() for t in new]).tolist(), strict=True))
        return [sum(map(known.__getitem__, x)) for x in tokens]

    def count(self, texts: list[str | None]) -> list[int]:
        pieces = [split_special(t, self.special) if t else [""] for t in texts]
        flat = [p for x in pieces for p in x[::2]]
        found, which, start, end = self.chunks.flat(flat)
        total = np.concatenate([[0], np.cumsum(np.array(found, np.int64)[which])])
        sums = iter((total[end] - total[start]).tolist())
        return [sum(next(sums) for _ in x[::2]) + len(x) // 2 for x in pieces]


@functools.cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), n_bytes and n_tokens of every whole text. ``path`` is a byte-level BPE file that each executor has."""

    def work(texts):
        return [[len(t.encode()) if t else 0 for t in texts], counter(path).count(texts)]

    return map_text(df, text, df.columns if keep is None else keep, "n_bytes long, n_tokens long", work)
