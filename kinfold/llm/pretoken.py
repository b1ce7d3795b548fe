"""Pre-tokens by way of chunks.

A space before a character that isn't white space always begins a match of the byte-level pattern, whatever stands
before it. So a text falls at such spaces into chunks that can be split by the pattern alone, and what a chunk gives is
kept in a dictionary of bounded bytes: most chunks of a corpus are words seen before. Long chunks aren't kept, and what is
kept goes when another operator begins in the worker.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import frees

#: Bytes of chunks and results kept by a worker, as estimated: so much a chunk and so much a character. At half of them a new dictionary begins, into which what is met again moves from the one before; that goes when the new one is full.
KEPT_BYTES, ENTRY_BYTES, CHAR_BYTES = 160 << 20, 200, 12
#: Characters up to which a chunk is kept.
LONG = 64
_SPACE = regex.compile(r"\s")


@functools.cache
def pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def unicode_to_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable Latin-1 characters stand for themselves, the other bytes in order for those from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def load_json(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]], dict[str, int]]:
    """Of a byte-level BPE file: bytes to id, merges as (left id, right id, merged id) by rank, special strings to id."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    table = unicode_to_bytes()
    special = {x["content"]: x["id"] for x in whole["added_tokens"]}
    vocab, merges = whole["model"]["vocab"], []
    for m in whole["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return {bytes(table[c] for c in k): v for k, v in vocab.items() if k not in special}, merges, special


@functools.cache
def white_space() -> frozenset[str]:
    """Characters that the pattern takes for white space; all lie in the first plane."""
    return frozenset(c for c in map(chr, range(1 << 16)) if _SPACE.match(c))


@functools.cache
def _cuts() -> tuple[re.Pattern, re.Pattern]:
    """A space that begins no match, as white space or the end follows; and one that does."""
    spaces = "".join(sorted(map(re.escape, white_space())))
    return re.compile(f" (?:[{spaces}]|\\Z)"), re.compile(f" (?![{spaces}]|\\Z)")


def cut_texts(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The chunks of texts without the space that each begins with, but for those that begin a text; and where each text's chunks start and end among them."""
    odd, cut = _cuts()
    plain = [i for i, t in enumerate(texts) if odd.search(t) is None]
    rest = [i for i, t in enumerate(texts) if odd.search(t) is not None] if len(plain) < len(texts) else []
    parts = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
    others = [cut.split(texts[i]) for i in rest]
    words = pa.concat_arrays([parts.values, pa.array([x for p in others for x in p], pa.large_string())]).dictionary_encode()
    ends = np.concatenate([parts.offsets.to_numpy(zero_copy_only=False)[1:], parts.offsets[-1].as_py() + np.cumsum(list(map(len, others)), dtype=np.int64)]).astype(np.int64)
    end = np.empty(len(texts), np.int64)
    start = np.empty(len(texts), np.int64)
    order = [*plain, *rest]
    end[order], start[order] = ends, np.concatenate([[0], ends[:-1]])[: len(ends)]
    return words, start, end


class _Held:
    """Results by chunk, of chunks that stand after ``lead``. Those met again live on when the dictionary begins anew."""

    def __init__(self, lead: str):
        self.lead, self.now, self.old = lead, {}, {}

    def anew(self) -> None:
        self.now, self.old = {}, self.now

    def of(self, chunks: list[str], make: Callable[[list[str]], list]) -> tuple[list, int]:
        """The results, and an estimate of the bytes that have come to be kept."""
        out = list(map(self.now.get, chunks))
        miss = [i for i, r in enumerate(out) if r is None]
        if self.old:
            for i in miss:
                out[i] = self.old.get(chunks[i])
            self.now.update((chunks[i], out[i]) for i in miss if out[i] is not None)
        fresh = [i for i in miss if out[i] is None]
        for i, r in zip(fresh, make([self.lead + chunks[i] for i in fresh]), strict=True):
            out[i] = r
        self.now.update((chunks[i], out[i]) for i in fresh if len(chunks[i]) <= LONG)
        return out, sum(ENTRY_BYTES + CHAR_BYTES * n for i in miss if (n := len(chunks[i])) <= LONG)


class Chunks:
    """What ``make`` gives for the chunks of texts. ``make`` takes a list of strings that no kept result covers and returns a list without None."""

    def __init__(self, make: Callable[[list[str]], list], most: int = KEPT_BYTES):
        self.make, self.most = make, most
        self.inner, self.first = _Held(" "), _Held("")  # chunks without their space; chunks at the beginning of a text
        self.size = 0  # an estimate of the bytes that both hold anew
        frees(self.clear)

    def clear(self) -> None:
        self.inner, self.first, self.size = _Held(" "), _Held(""), 0

    def flat(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Results of different chunks, the number of each chunk's result, and where each text's chunks start and end among these."""
        if 2 * self.size > self.most:
            self.inner.anew()
            self.first.anew()
            self.size = 0
        words, start, end = cut_texts(texts)
        which, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()
        inside = np.ones(len(which), bool)
        inside[start] = False
        used = np.unique(which[inside])
        found, more = self.inner.of([names[k] for k in used.tolist()], self.make)
        heads, place = np.unique(which[start], return_inverse=True)
        firsts, again = self.first.of([names[k] for k in heads.tolist()], self.make)
        self.size += more + again
        number = np.zeros(len(names), np.int64)
        number[used] = np.arange(len(used))
        which = number[which]
        which[start] = len(used) + place
        return found + firsts, which, start, end

    def of(self, texts: list[str]) -> list[list]:
        """The results of each text's chunks, in order."""
        found, which, start, end = self.flat(texts)
        which = which.tolist()
        return [[found[k] for k in which[a:b]] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def split_special(text: str, special: list[str]) -> list[str]:
    """The text cut at special strings: ordinary pieces at even places, special strings at odd ones."""
    if not any(s in text for s in special):
        return [text]
    return regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text)
