"""Byte-level BPE as a monoid: encoding and decoding by tree reduction.

A long piece is halved, the halves are encoded, and two neighbouring results are joined: a window of a few tokens on
either side of the seam is encoded anew, and grows until the tokens outside provably stay. They do when the last token
before the window and its first token, and its last token and the first after it, are each what their joined bytes
encode to: a sequence is an encoding exactly when every neighbouring pair of it is.

Defined results: null and empty texts have no ids, and decode to no bytes. Special strings are ordinary text. Of equal
ranks the left pair merges first. Texts of any length are encoded whole; repeated rows are encoded each; an empty table
gives an empty one. Input columns named as a new one are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from itertools import chain

from pyspark.sql import DataFrame

from .common import kept, map_text, unpacked
from .pretoken import Chunks, pattern

#: Bytes up to which a piece is merged directly.
LEAF = 5
#: Encodings of pieces of up to MEMO_BYTES bytes are kept, MEMO of them at most.
MEMO_BYTES, MEMO = 12, 200_000
#: Ids up to which a part is decoded directly.
DECODED = 512


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBPE:
    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.words = {i: w for w, i in self.ranks.items()}
        self.decimals = {i: str(i) for i in self.words}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[bytes, list[int]] = {}
        self.windows: dict[bytes, list[int]] = {}

    def _merge(self, piece: bytes) -> list[int]:
        """Direct merging: lowest rank first, from the left among equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 96:
            return self._merge_long(piece)
        if (known := self.windows.get(piece)) is None:
            if len(self.windows) > MEMO:
                self.windows.clear()
            known = self.windows[piece] = self._merge_short(piece)
        return known

    def _merge_short(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            low, at = None, -1
            for i, r in enumerate(pair):
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pair[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, for windows that grew long."""
        ranks, n = self.ranks, len(piece)
        end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # a part runs from its place to its end
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, to = heapq.heappop(heap)
            mid = end[i]
            if not alive[i] or mid >= n or not alive[mid] or end[mid] != to:
                continue
            alive[mid] = 0
            end[i] = to
            if to < n:
                before[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (j := before[i]) >= 0 and (r := ranks.get(piece[j:to])) is not None:
                heapq.heappush(heap, (r, j, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _stays(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merge(self.words[a] + self.words[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        known = self.pairs.get((left[-1], right[0]))
        if known or known is None and self._stays(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self._merge(b"".join(map(self.words.__getitem__, left[-a:] + right[:b])))
            left_stays = a == len(left) or self._stays(left[-a - 1], window[0])
            right_stays = b == len(right) or self._stays(window[-1], right[b])
            if left_stays and right_stays:
                return left[:-a] + window + right[b:]
            a, b = a if left_stays else 2 * a, b if right_stays else 2 * b

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > MEMO_BYTES:
            return self._halves(piece)
        if (known := self.memo.get(piece)) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = self.memo[piece] = self._halves(piece)
        return known

    def _halves(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self._merge(piece) if piece else []
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODED:
            return b"".join(map(self.words.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextCodec:
    """Encodes whole texts: each match of the pattern by itself."""

    def __init__(self, path: str):
        self.bpe = TreeBPE(path)
        self.chunks = Chunks(self._make)

    def _make(self, chunks: list[str]) -> list[tuple[int, ...]]:
        split, encode = pattern().findall, self.bpe.encode
        return [tuple(chain.from_iterable([encode(t.encode()) for t in split(c)])) for c in chunks]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(chain.from_iterable(chunks)) for chunks in self.chunks.of([t or "" for t in texts])]


@functools.cache
def codec(path: str) -> TextCodec:
    return TextCodec(path)


def encoded(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ids: array<int> of every whole text. ``path`` is a rank file that each executor has."""
    return map_text(df, text, df.columns if keep is None else keep, "ids array<int>", lambda texts: [codec(path).encode(texts)])


def decoded(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and decoded: the bytes of the ids; null ids give none."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "decoded"]
    frame = df.select(*kept(keep), F.col(f"`{ids}`").alias("ids"))
    out = frame.drop("ids").schema.add("decoded", "binary")

    def run(batches):
        bpe = codec(path).bpe
        for b in batches:
            made = pa.array([bpe.decode(x.as_py() or []) for x in b.column(b.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=out.names)

    return unpacked(frame.mapInArrow(run, out), keep, ["decoded"])


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass, without the ids leaving the worker."""

    def work(texts):
        own = codec(path)
        n, ids_hash, decoded_hash = [], [], []
        for ids in own.encode(texts):
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(" ".join(map(own.bpe.decimals.__getitem__, ids)).encode()).hexdigest())
            decoded_hash.append(hashlib.sha256(own.bpe.decode(ids)).hexdigest())
        return [n, ids_hash, decoded_hash]

    return map_text(df, text, df.columns if keep is None else keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
