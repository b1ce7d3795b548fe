"""N-gram Jaccard self-join with a count-vector R-tree.

A document is the set of its distinct word shingles. A set's shingles are hashed into groups, and the counts by group
are a point. What two sets share is at most the sum over groups of the lesser count, so an R-tree over points can leave
out whole boxes: with a box's greatest counts in place of a point's the sum still bounds every set inside. Survivors are
verified on the shingles.

One tree over a corpus would be held by one task, so the trees are built over clusters that hold every linked pair. Sets
of a similarity of t or more share one of the first n - ceil(t n) + 1 shingles in any order that is the same for all
sets; the order puts shingles first that few sets have, by a counting sketch of fixed size over the whole corpus, so
passages that many documents share bring few sets together. Sets that share such a shingle are in the cluster that is
named by the least of them; a set is in a cluster once, however many shingles brought it there.

Large sets have more groups, in proportion to their size, or the bound would say nothing of them; groups are runs of
hashes, so that a point of many groups has also its counts by fewer, for trees in which it meets smaller sets.

A cluster's points are packed into a tree by halving along the coordinate of greatest spread, and the tree is joined
with itself, box against box. Sets of a pair that the bound lets pass go, as shingles, to the cluster's place, where the
pairs are verified; only links that join what was apart there leave it, so what comes out is in proportion to the sets.
A cluster too large for one place falls into tiles. First each tile is joined with itself, a few hubs being in all tiles
of the cluster; the components that this gives are classes. Then tiles are cut anew by class and by bands of set sizes,
and each pair of tiles that isn't of one class, and whose bands can link, is a place of its own. Components come from
least labels and pointer jumping over written tables.

Defined results: null and empty texts and texts without words have no shingles and link with nothing; a component is
named by the least doc_id in it, null ids aside (a text without id still links others); repeated rows share a component;
an empty table gives an empty one; texts of any length are read whole; columns of the input other than the two named
ones are not read, so none can clash. Ties don't arise: a link is a matter of the two sets alone. Shingles are compared
by 64-bit hashes under a key drawn anew for each call, sets by 128-bit digests of these. No link between different sets
is lost.
"""

from __future__ import annotations

import hashlib
import math
import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, slices, small_enough, written

SHINGLE = 4
#: A similarity of RATIO[0] / RATIO[1] or more links.
RATIO = (85, 100)
#: Groups of a set of up to GROUP_SETS shingles; twice as many for each doubling of a set's size beyond, so that a group has 16 shingles at most.
GROUPS, GROUP_SETS = 256, 4096
SKETCH_BITS, CHUNK_BITS = 20, 16
#: Points of a box of the lowest level, boxes of a box above.
LEAF = 16
#: Pairs of boxes whose bounds are computed at once.
STRIP = 1 << 15
SLICE = 1 << 20
#: Sets that a task remembers in order not to repeat them.
SEEN = 200_000
#: Sets of a tile: at least, at most, and bytes of shingles at most.
TILE_LEAST, TILE_MOST, TILE_BYTES = 256, 1 << 14, 32 << 20
#: Hubs of a cluster of many tiles, about.
HUBS = 32

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By number of bytes, the part of eight that they are.
_PART = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U)
#: Longer words are hashed one by one.
_LONG = 256
#: The key of hashes where a caller names none; near_duplicates draws one.
KEY = bytes(range(1, 33))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """A keyed 64-bit hash of each word, eight bytes at a time; words of eight bytes or fewer can't collide with each other of their length. ``buffer`` ends with eight bytes beyond the last word."""
    k = np.frombuffer(key, "<u8")
    at = np.ndarray(max(len(buffer) - 7, 0), "<u8", np.ascontiguousarray(buffer), strides=(1,))
    length = end - start
    out = _mix((at[start] & _PART[np.minimum(length, 8)]) ^ (length.astype(_U) * (k[0] | _U(1)) + k[1]))
    left, done = np.flatnonzero((length > 8) & (length <= _LONG)), 8
    while len(left):
        rest = length[left] - done
        out[left] = _mix((at[start[left] + done] & _PART[np.minimum(rest, 8)]) ^ (out[left] * (k[2] | _U(1)) + _U(done)))
        left, done = left[rest > 8], done + 8
    for i in np.flatnonzero(length > _LONG).tolist():
        word = buffer[start[i] : end[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key).digest(), "little")
    return out


def shingles(texts: list[str | None], k: int = SHINGLE, key: bytes = KEY) -> list[np.ndarray]:
    """Of each text the hashes of its distinct shingles, sorted; of one with fewer than k words, that of the whole."""
    data = [b"" if t is None else t.encode() for t in texts]
    buffer = _LOWER[np.frombuffer(b"\n".join(data) + b"\n" * 9, np.uint8)]
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    words = _word_hashes(buffer, start, end, key)
    times = np.frombuffer(key, "<u8")[3] | _U(1)
    ends = np.cumsum([len(d) + 1 for d in data])
    at = np.searchsorted(start, np.concatenate([[0], ends]))
    rows = np.zeros(max(len(words) - k + 1, 0), _U)
    for i in range(k):
        rows = rows * times + words[i : len(words) - k + 1 + i] if len(rows) else rows
    rows = _mix(rows)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(rows[a : b - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            h = _mix(np.array([b - a], _U))
            for w in words[a:b]:
                h = h * times + w
            out.append(_mix(h))
        else:
            out.append(np.zeros(0, _U))
    return out


def key_of(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def groups_of(n: np.ndarray | int):
    """The number of groups of a set of n shingles."""
    return GROUPS << np.ceil(np.log2(np.maximum(n, GROUP_SETS) / GROUP_SETS)).astype(np.int64)


def point(x: np.ndarray, groups: int | None = None) -> np.ndarray:
    """Counts by group: by the first bits of the hash, so that neighbours together are the groups of half as many."""
    groups = int(groups_of(len(x))) if groups is None else groups
    return np.bincount((x >> _U(64 - (groups.bit_length() - 1))).astype(np.int64), minlength=groups)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in half bytes where all are below 16, or in bytes, in units rounded up, after the unit: it is one unless a group has over 255."""
    most = int(counts.max(initial=0))
    if most < 16:
        c = counts.astype(np.uint8)
        return (c[::2] | (c[1::2] << 4)).tobytes()
    unit = max(1, -(-most // 255))
    return unit.to_bytes(8, "little") + (-(-counts // unit)).astype(np.uint8).tobytes()


def _points(data: list[bytes], groups: int = GROUPS) -> np.ndarray:
    """Points of so many groups; those packed with more are put together."""
    size = np.fromiter(map(len, data), np.int64, len(data))
    out = np.zeros((len(data), groups), np.int64)
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        half = length & (length - 1) == 0  # a power of two: half bytes, without a unit
        x = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), length)
        if half:
            counts = np.empty((len(at), 2 * length), np.uint8)
            counts[:, ::2], counts[:, 1::2] = x & 15, x >> 4
        else:
            counts = x[:, 8:] * np.ascontiguousarray(x[:, :8]).view("<i8")
        out[at] = counts.reshape(len(at), groups, -1).sum(2, dtype=np.int64)
    return out.astype(np.uint8) if out.max(initial=0) < 256 else out


def least_shared(n: np.ndarray | int, m: np.ndarray | int, ratio=RATIO):
    """The fewest common shingles of linked sets of n and m: c with den * c >= num * (n + m - c)."""
    return -(-ratio[0] * (n + m) // (ratio[0] + ratio[1]))


def linked(x: np.ndarray, y: np.ndarray, ratio=RATIO) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    c = int((both[1:] == both[:-1]).sum())
    return ratio[1] * c >= ratio[0] * (len(x) + len(y) - c)


def prefix(x: np.ndarray, sketch: np.ndarray, ratio=RATIO) -> np.ndarray:
    """The shingles by which a set is found: the first in order of the sketch's count, then of the hash."""
    p = len(x) + ratio[0] * len(x) // -ratio[1] + 1
    place = (np.minimum(sketch[(x & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)], (1 << 24) - 1).astype(_U) << _U(40)) | (x >> _U(24))
    return x[place <= np.partition(place, p - 1)[p - 1]] if p < len(x) else x


def _packing(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` in runs of LEAF, halved again and again along the coordinate in which they spread most."""
    out, left = [], [rows]
    while left:
        x = left.pop()
        if len(x) <= LEAF:
            out.append(x)
            continue
        here = points[x]
        half = -(-len(x) // (2 * LEAF)) * LEAF
        x = x[np.argsort(here[:, int(here.var(axis=0).argmax())], kind="stable")]
        left += [x[half:], x[:half]]
    return out


class CountTree:
    """An R-tree over points. A box has its points' greatest counts, the least size of a set, and the least and greatest
    class and side of its points. ``classes``: pairs within one aren't asked for. ``sides``: nor are pairs within side 0
    or within side 1; points of side 2 meet all. ``fine``: nor are pairs of which both are so."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, classes: np.ndarray | None = None, sides: np.ndarray | None = None, ratio=RATIO, fine: np.ndarray | None = None):
        n, self.ratio = len(points), ratio
        classes = np.arange(n) if classes is None else classes
        sides = np.full(n, 2) if sides is None else sides
        much = np.bincount(classes)[classes] > LEAF if n else classes  # a class of some size fills its own boxes
        fine = np.zeros(n, bool) if fine is None else fine
        runs = (np.where(much, classes + 1, 0) * 3 + sides) * 2 + fine
        order = [_packing(points, np.flatnonzero(runs == r)) for r in np.unique(runs)]
        self.order = np.concatenate([x for run in order for x in run]) if n else np.zeros(0, np.int64)
        at = self.order
        level = (points[at], sizes[at].astype(np.int64), classes[at], classes[at], sides[at], sides[at], fine[at])
        self.levels = [level]
        while len(level[0]) > LEAF:
            cut = np.arange(0, len(level[0]), LEAF)
            level = tuple(f.reduceat(x, cut, axis=0) for f, x in zip((np.maximum, np.minimum, np.minimum, np.maximum, np.minimum, np.maximum, np.logical_and), level, strict=True))
            self.levels.append(level)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of points that the bound and the classes and sides leave, and by how much the bound is over; each pair once."""
        top = len(self.levels) - 1
        left = [(top, *map(np.ravel, np.triu_indices(len(self.levels[top][0]), 0 if top else 1)))]
        while left:
            depth, i, j = left.pop()
            if len(i) > STRIP:
                left += [(depth, i[a : a + STRIP], j[a : a + STRIP]) for a in range(0, len(i), STRIP)]
                continue
            points, sizes, low, high, first, last, fine = self.levels[depth]
            one_class = (low[i] == high[j]) & (high[i] == low[j])
            one_side = (first[i] == last[j]) & (last[i] == first[j]) & (first[i] < 2)
            may = ~(one_class | one_side | (fine[i] & fine[j]))
            i, j = i[may], j[may]
            over = np.minimum(points[i], points[j]).sum(1, dtype=np.uint16 if points.dtype == np.uint8 and points.shape[1] <= 257 else np.int64).astype(np.int64) - least_shared(sizes[i], sizes[j], self.ratio)
            may = over >= 0
            i, j, over = i[may], j[may], over[may]
            if not len(i):
                continue
            if not depth:
                yield self.order[i], self.order[j], over
                continue
            below, each = len(self.levels[depth - 1][0]), np.arange(LEAF)
            grid = np.zeros((len(i), LEAF, LEAF), np.int64)
            a, b = (grid + (i[:, None] * LEAF + each)[:, :, None]).ravel(), (grid + (j[:, None] * LEAF + each)[:, None, :]).ravel()
            may = (a < below) & (b < below) & ((a < b) if depth == 1 else (a <= b))
            left.append((depth - 1, a[may], b[may]))


def tree_pairs(points, sizes: np.ndarray, classes: np.ndarray, sides: np.ndarray, ratio=RATIO) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs that a tree leaves for each number of groups: of sets that have it, with each other and with larger sets of a size that can link.
    ``points`` gives the points of the rows named, with so many groups."""
    groups = groups_of(sizes)
    reach = 2 * ratio[1] / ratio[0]
    for g in np.unique(groups).tolist():
        at = np.flatnonzero((groups >= g) & (groups <= reach * g))
        tree = CountTree(points(at, g), sizes[at], np.unique(classes[at], return_inverse=True)[1].reshape(-1), sides[at], ratio, groups[at] > g)
        for i, j, over in tree.pairs():
            yield at[i], at[j], over


# ---- passes over the texts


def _described(docs: DataFrame, doc_id: str, text: str, k: int, secret: bytes) -> DataFrame:
    """A row a document: doc_id, n, key, counts; and the task's part of the sketch in rows with a chunk."""
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("counts", pa.binary()), ("chunk", pa.int32()), ("sketch", pa.binary())]
        schema = pa.schema(kinds)
        sketch, seen, any_ = np.zeros(1 << SKETCH_BITS, np.int64), set(), False
        for b in slices(batches, "text", SLICE):
            sets = shingles(b.column(1).to_pylist(), k, secret)
            keys = list(map(key_of, sets))
            for x, key in zip(sets, keys, strict=True):
                if key is not None and key not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(key)
                    np.add.at(sketch, (x & _U((1 << SKETCH_BITS) - 1)).astype(np.int64), 1)
                    any_ = True
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array([_packed(point(x)) for x in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if any_:
            parts = np.minimum(sketch, 0xFFFFFFFF).astype("<u4").reshape(-1, 1 << CHUNK_BITS)
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, t) for _, t in kinds[:4]] + [pa.array(range(n), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], schema=schema)

    return frame.mapInArrow(run, "doc_id long, n long, key binary, counts binary, chunk int, sketch binary")


def _sketch(described: DataFrame) -> np.ndarray:
    """The sketch of the corpus: 2^SKETCH_BITS counts, summed by the executors in as many parts as it has chunks, twice."""
    chunks = 1 << (SKETCH_BITS - CHUNK_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(data.as_py()), "<u4")
                sums[c] = sums.get(c, 0) + x.astype(np.int64)
        for c, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes(), 1)], pa.binary())], names=["chunk", "sketch"])

    rows = described.filter("chunk is not null").select("chunk", "sketch")
    once = rows.mapInArrow(add, "chunk int, sketch binary")
    out = np.zeros((chunks, 1 << CHUNK_BITS), np.int64)
    for r in once.repartition(chunks, "chunk").mapInArrow(add, "chunk int, sketch binary").collect():
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["sketch"]), "<u4")
    return out.ravel()


def _postings(docs: DataFrame, text: str, sketch: np.ndarray, k: int, ratio, secret: bytes) -> DataFrame:
    """token, key for each set's prefix; a task gives a set once as long as it remembers it."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, 0xFFFFFFFF).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for b in slices(batches, "text", SLICE):
            found, keys, times = [], [], []
            for x in shingles(b.column(0).to_pylist(), k, secret):
                key = key_of(x)
                if key is None or key in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(key)
                p = prefix(x, table, ratio)
                found.append(p)
                keys.append(key)
                times.append(len(p))
            if keys:
                which = pa.array(np.repeat(np.arange(len(keys)), times))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(keys, pa.binary()).take(which)], names=["token", "key"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "token long, key binary")


def _blocks(postings: DataFrame) -> DataFrame:
    """Blocks of two sets or more: token, key, first (the block's least key), large (it has three or more). A stream over sorted postings; what is held is a batch and the last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_t, kept_k = np.zeros(0, np.int64), np.zeros(0, "V16")
        first = None  # of a block that goes on from what was given out

        def out(t: np.ndarray, k: np.ndarray, last: bool):
            """Give out whole blocks; of the block at the end, unless it is the last, keep what may still be alone."""
            nonlocal kept_t, kept_k, first
            kept_t, kept_k = t[:0], k[:0]
            if not len(t):
                return None
            new = np.concatenate([[True], t[1:] != t[:-1]])
            fresh = new | np.concatenate([[True], k[1:] != k[:-1]])
            t, k, new = t[fresh], k[fresh], new[fresh]
            start = np.flatnonzero(new)
            length = np.diff(np.concatenate([start, [len(t)]]))
            heads = k[start]
            going = first is not None and t[0] == first[0]
            big = length + 0
            if going:
                heads[0] = first[1]
                big[0] += 3  # it was given out as large before
                if k[0] == first[2]:
                    t, k = t[1:], k[1:]
                    length[0] -= 1
            if not last and (length[-1] < 3 and not (going and len(start) == 1)):
                n = int(length[-1])
                kept_t, kept_k = t[len(t) - n :], k[len(k) - n :]
                t, k, length, heads, big = t[: len(t) - n], k[: len(k) - n], length[:-1], heads[:-1], big[:-1]
                first = None
            elif not last and len(t):
                first = (t[-1], heads[-1], k[-1])
            keep = np.repeat(big >= 2, length)
            t, k = t[keep], k[keep]
            if not len(t):
                return None
            heads, large = np.repeat(heads, length)[keep], np.repeat(big >= 3, length)[keep]
            as_binary = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(t), as_binary(k), as_binary(heads), pa.array(large)], names=["token", "key", "first", "large"])

        for b in batches:
            if not b.num_rows:
                continue
            k = np.frombuffer(b"".join(b.column(1).to_pylist()), "V16")
            made = out(np.concatenate([kept_t, b.column(0).to_numpy(zero_copy_only=False)]), np.concatenate([kept_k, k]), False)
            if made is not None:
                yield made
        made = out(kept_t, kept_k, True)
        if made is not None:
            yield made

    return postings.repartition("token").sortWithinPartitions("token", "key").mapInArrow(run, "token long, key binary, first binary, large boolean")


# ---- clusters: where points, then shingles, meet


class _Classes:
    """Classes that grow together."""

    def __init__(self, labels: list[bytes]):
        self.first = {}
        self.root = [self.first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.root[max(i, j)] = min(i, j)


def _each_place(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each place, of batches sorted by it; a set once."""
    place, held = None, {}
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if r[0] != place:
                if len(held) > 1:
                    yield list(held.values())
                place, held = r[0], {}
            held.setdefault((r[1], r[2]), r)
    if len(held) > 1:
        yield list(held.values())


def _candidates(members: DataFrame, ratio) -> DataFrame:
    """place, side, key, label of the ``members`` (place, side, key, label, n, counts) that the tree of their place leaves in some pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = ["place", "side", "key", "label"], []
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        give = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for rows in _each_place(batches):
            labels = {}
            classes = np.array([labels.setdefault(r[3], len(labels)) for r in rows])
            points = lambda at, g: _points([rows[i][5] for i in at], g)  # noqa: B023, E731
            some = np.zeros(len(rows), bool)
            for i, j, _ in tree_pairs(points, np.array([r[4] for r in rows]), classes, np.array([r[1] for r in rows]), ratio):
                some[i] = some[j] = True
            out += [rows[i][:4] for i in np.flatnonzero(some).tolist()]
            if len(out) > 20_000:
                yield give()
                out = []
        if out:
            yield give()

    dealt = members.select("place", "side", "key", "label", "n", "counts").repartition("place").sortWithinPartitions("place", "key")
    return dealt.mapInArrow(run, "place long, side int, key binary, label binary")


def _sets_again(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, secret: bytes) -> DataFrame:
    """key, hashes of the ``wanted`` (key, doc) sets, each made again from the document that has it."""
    wanted = wanted.select(F.col("key").alias("key__"), F.col("doc").alias("doc__"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc__"), F.col(text).cast("string").alias("text"))

    def make(texts):
        found = shingles(texts, k, secret)
        return [list(map(key_of, found)), [x.tobytes() for x in found]]

    known = wanted.filter("doc__ is not null")
    known = rows.join(F.broadcast(known) if small_enough(known, 64) else known, "doc__")
    made = map_text(known, "text", ["key__"], "key binary, hashes binary", make).filter("key = key__").select("key", "hashes")
    if wanted.filter("doc__ is null").isEmpty():
        return made
    nameless = map_text(rows.filter("doc__ is null"), "text", [], "key binary, hashes binary", make).dropDuplicates(["key"])
    return made.union(nameless.join(wanted.filter("doc__ is null").select(F.col("key__").alias("key")), "key", "left_semi"))


def _links(members: DataFrame, sets: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, ratio, secret: bytes) -> DataFrame:
    """Linked pairs (a, b) of sets of one place and different labels: as many as join what is linked there."""
    found = written(_candidates(members, ratio), "candidates")
    wanted = found.select("key").distinct().join(sets.select("key", "doc"), "key")
    made = _sets_again(written(wanted, "wanted"), docs, doc_id, text, k, secret)
    sent = made.join(F.broadcast(found) if small_enough(found, 96) else found, "key").select("place", "side", "key", "label", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_place(batches):
            sets_ = [np.frombuffer(r[4], _U) for r in rows]
            classes = _Classes([r[3] for r in rows])
            now = np.array([classes.find(i) for i in range(len(rows))])
            points = lambda at, g: np.array([point(sets_[i], g) for i in at])  # noqa: B023, E731
            out = []
            for i, j, over in tree_pairs(points, np.array(list(map(len, sets_))), now, np.array([r[1] for r in rows]), ratio):
                best = np.argsort(-over, kind="stable")
                for a, b in zip(i[best].tolist(), j[best].tolist(), strict=True):
                    p, q = classes.find(a), classes.find(b)
                    if p != q and linked(sets_[a], sets_[b], ratio):
                        classes.join(p, q)
                        out.append((rows[a][2], rows[b][2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in zip(*out, strict=True)], names=["a", "b"])

    return written(sent.repartition("place").sortWithinPartitions("place", "key").mapInArrow(run, "a binary, b binary"), "links")


def _tile_size(n: str, longest: str):
    """Sets of a tile for a cluster of n sets: their number grows as its root, so that tiles and their pairs both stay few."""
    by_bytes = F.greatest(F.lit(LEAF), F.floor(F.lit(TILE_BYTES) / (8 * F.greatest(F.col(longest), F.lit(1)))))
    return F.least(F.lit(TILE_MOST), F.greatest(F.lit(TILE_LEAST), F.ceil(8 * F.sqrt(F.col(n)))), by_bytes).cast("long")


def _side(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if small_enough(df, row_bytes) else df


def _first_places(clusters: DataFrame, large: DataFrame) -> DataFrame:
    """Members with place, side, label: each cluster, or tile of a large one, by itself; hubs are in all tiles."""
    rows = clusters.join(_side(large, 64), "head", "left")
    tiles = F.ceil(F.coalesce(F.col("members") / F.col("tile"), F.lit(1.0))).cast("int")
    part = F.pmod(F.xxhash64("key"), tiles).cast("int")
    hub = (tiles > 1) & (F.pmod(F.xxhash64("key", F.lit("hub")), F.ceil(F.col("members") / HUBS)) == 0)
    rows = rows.withColumn("part", F.explode(F.when(hub, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(part))))
    return rows.select(F.xxhash64("head", "part").alias("place"), F.lit(2).alias("side"), "key", F.col("key").alias("label"), "n", "counts")


def _second_places(clusters: DataFrame, large: DataFrame, labels: DataFrame, ratio) -> DataFrame:
    """Members of large clusters with place, side, label: pairs of tiles of different classes whose sizes can link."""
    rows = clusters.join(_side(large, 64), "head").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = rows.groupBy("head").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("head")
    width = math.log(ratio[1] / ratio[0]) * 1.000001
    rows = rows.join(_side(mixed, 64), "head", "left_semi").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    rows = written(rows.select("head", "key", "label", "n", "counts", "band", "tile"), "mixed")
    by_label = rows.groupBy("head", "band", "label").agg(F.count("*").alias("here"), F.first("tile").alias("tile"))
    classes = by_label.withColumn("class", F.when(4 * F.col("here") >= F.col("tile"), F.col("label")).otherwise(F.lit(b"")))
    parts = classes.groupBy("head", "band", "class").agg(F.ceil(F.sum("here") / F.first("tile")).cast("int").alias("parts"))
    own = classes.filter("class <> x''").select("head", "band", "label", "class")
    tiled = rows.join(_side(own, 128), ["head", "band", "label"], "left").withColumn("class", F.coalesce("class", F.lit(b""))).join(_side(parts, 128), ["head", "band", "class"])
    tiled = tiled.withColumn("at", F.struct("band", "class", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")))
    tiles = parts.select("head", "band", "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("head", F.struct("band", "class", "part").alias("at"))
    x, y = tiles.select("head", F.col("at").alias("x")), tiles.select("head", F.col("at").alias("y"))
    apart = (F.col("x.class") != F.col("y.class")) | (F.col("x.class") == F.lit(b""))
    pairs = written(x.join(y, "head").filter((F.col("x") <= F.col("y")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1) & apart), "tiles")
    sides = pairs.select("head", F.col("x").alias("at"), F.xxhash64("head", "x", "y").alias("place"), F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    sides = sides.union(pairs.filter("x <> y").select("head", "y", F.xxhash64("head", "x", "y"), F.lit(1)))
    return tiled.join(_side(sides, 128), ["head", "at"]).select("place", "side", "key", "label", "n", "counts")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """key, label (the least key reached) for every key in ``links``. Least labels spread over links and by pointer jumping until none changes."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.union(both.select("y", "x"))
    labels = written(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("key"), F.least("x", "y").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("x", "key"), "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        new = written(low.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        done = new.filter("old <> label").isEmpty()
        labels = new.select("key", "label")
        if done:
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, k: int = SHINGLE, ratio: tuple[int, int] = RATIO, secret: bytes | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. ``secret``: 32 bytes that key the hashes, drawn anew if not given."""
    secret = secret or secrets.token_bytes(32)
    described = written(_described(docs, doc_id, text, k, secret), "described")
    rows = described.filter("chunk is null").select("doc_id", "n", "key", "counts")
    sets = written(rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("counts").alias("counts")), "sets")
    met = _blocks(_postings(docs, text, _sketch(described), k, ratio, secret)).select(F.col("first").alias("head"), "key")
    clusters = written(met.distinct().join(sets.select("key", "n", "counts"), "key"), "clusters")
    size = clusters.groupBy("head").agg(F.count("*").alias("members"), F.max("n").alias("longest"))
    large = written(size.withColumn("tile", _tile_size("members", "longest")).filter("members > tile").select("head", "members", "tile"), "large")
    resolve = lambda members: _links(members, sets, docs, doc_id, text, k, ratio, secret)
    links = resolve(_first_places(clusters, large))
    labels = components(links)
    if not large.isEmpty():
        more = resolve(_second_places(clusters, large, labels, ratio))
        if not more.isEmpty():
            labels = components(links.union(more))
    named = labels.join(sets.select("key", "doc"), "key")
    least = named.groupBy("label").agg(F.min("doc").alias("component"))
    found = labels.join(least, "label").select("key", "component")
    same = sets.filter("copies > 1").select("key", "doc")
    known = written(same.join(found, "key", "full").select("key", F.coalesce("component", "doc").alias("component")), "components")
    out = rows.select("doc_id", "n", "key").join(F.broadcast(known) if small_enough(known, 48) else known, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
