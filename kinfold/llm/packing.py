"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

How many sequences are needed, and of what, depends on nothing but how many pieces of each length there are. So the
plan is made on that histogram (as many rows as a sequence has tokens, whatever the input): a sequence is filled
greedily by the longest piece that fits; then its shortest piece gives way to two unpacked ones that fit the widened gap
more tightly, as long as there are such. The pattern found is repeated as often as the histogram allows. Pieces take
their places by rank within their length: a task numbers the pieces of each length that it writes, and how many earlier
tasks wrote is added, from a small table of tasks and lengths. Pieces are neither sorted nor brought together.

Defined results: a null or empty text is the end mark alone; a text of any length is cut into as many pieces as it needs.
Every row is a document, repeated rows too. Which of two pieces of one length lies where is settled by the order in which
they were written; of patterns that fit equally well the one with the longer first piece is taken. An empty table gives an empty one. Input columns named as a new one are replaced.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frees, kept, map_text, small_enough, unpacked, written
from .pretoken import cut_texts

END = 2
CAPACITY = 1024
#: Bytes of chunks and their ids that a worker keeps (see ``pretoken``), and of text that is encoded end to end; they settle time and memory, not results. A job whose workers hold much else can ask for less.
KEPT_BYTES, JOINED_BYTES = 48 << 20, 64 << 10


class Encoder:
    """Ids of whole texts as the library gives them, as little-endian unsigned 32-bit numbers.

    Chunks that begin with a space are encoded end to end, since each begins a match wherever it stands, and come apart
    again by the bytes that ids stand for. What is kept are two Arrow arrays, of chunks and of their ids.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        sizes = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()} | added  # a character of a byte-level vocabulary is a byte
        self.bytes_of = np.zeros(max(sizes) + 1, np.int64)
        self.bytes_of[list(sizes)] = list(sizes.values())
        self.most = kept_bytes
        self.clear()
        frees(self.clear)

    def clear(self) -> None:
        self.names, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met = np.zeros(0, bool)

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, chunks: list[str]) -> pa.Array:
        """Ids of each chunk, encoded by itself."""
        return pa.array([np.array(x, "<u4").tobytes() for x in self._lists(chunks)], pa.large_binary())

    def _joined(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk of this array, a space before it, encoded end to end; one by one where the ids don't come apart between chunks."""
        size = 1 + np.asarray(pc.binary_length(chunks)).astype(np.int64)
        ends, out, at = np.cumsum(size), [], 0
        while at < len(chunks):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + JOINED_BYTES, side="right")))
            part = [" " + x for x in chunks.slice(at, to - at).to_pylist()]
            ids = np.array(self._lists(["".join(part)])[0], "<u4")
            found, want = np.cumsum(self.bytes_of[ids]), np.cumsum(size[at:to])
            cut = np.searchsorted(found, want, side="left")
            if len(ids) and cut[-1] == len(ids) - 1 and (found[cut] == want).all():
                offsets = np.concatenate([[0], 4 * (cut + 1)])
                out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
            else:
                out.append(self._apart(part))
            at = to
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def _inner(self, names: pa.Array) -> pa.Array:
        """Ids of chunks by their names, a chunk without its space. At half of the bytes kept, what wasn't met since the last time goes."""
        at = np.asarray(pc.fill_null(pc.index_in(names, self.names), -1)).astype(np.int64)
        new = at < 0
        self.met[at[~new]] = True
        fresh = names.filter(pa.array(new))
        at[new] = len(self.ids) + np.arange(len(fresh))
        kept = self.ids
        self.names, self.ids = pa.concat_arrays([self.names, fresh]), pa.concat_arrays([kept, self._joined(fresh)])
        out = self.ids.take(pa.array(at))
        self.met = np.concatenate([self.met, np.zeros(len(fresh), bool)])
        if 2 * (self.names.nbytes + self.ids.nbytes) > self.most:
            live = pa.array(self.met)
            self.names, self.ids = self.names.filter(live), self.ids.filter(live)
            if 2 * (self.names.nbytes + self.ids.nbytes) > self.most:
                self.clear()
            self.met = np.zeros(len(self.names), bool)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words, start, end = cut_texts([t or "" for t in texts])
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        inside = np.ones(len(which), bool)
        inside[start] = False
        used, heads = np.zeros(len(words.dictionary), bool), np.zeros(len(words.dictionary), bool)
        used[which[inside]], heads[which[start]] = True, True
        inner, first = self._inner(words.dictionary.filter(pa.array(used))), self._apart(words.dictionary.filter(pa.array(heads)).to_pylist())
        begins = len(inner) + (np.cumsum(heads) - 1)[which[start]]
        which = (np.cumsum(used) - 1)[which]
        which[start] = begins
        ids = pa.concat_arrays([inner, first]).take(pa.array(which))
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        whole = memoryview(ids.buffers()[2] or b"")
        return [whole[a:b].tobytes() for a, b in zip(at[start].tolist(), at[end].tolist(), strict=True)]


@functools.cache
def encoder(path: str, kept_bytes: int = KEPT_BYTES) -> Encoder:
    return Encoder(path, kept_bytes)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences from the end, the first piece may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, *, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, numbered: bool = False, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """A row for each piece: ``keep``, piece, start, length, ids_crc32, and ids (bytes) if asked for. ``numbered``: the task too, and how many pieces of this length it has made before."""
    keep = df.columns if keep is None else keep
    tail = np.array([end], "<u4").tobytes()
    made_by: dict[str, object] = {"attempt": None}

    def work(texts):
        context = TaskContext.get()
        if made_by["attempt"] != context.taskAttemptId():
            made_by.update(attempt=context.taskAttemptId(), task=context.partitionId(), counts=[0] * (capacity + 1))
        task, counts = made_by["task"], made_by["counts"]
        out = []
        for ids in encoder(path, kept_bytes).encode(texts):
            ids += tail
            row = []
            for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                part = ids[4 * s : 4 * (s + n)]
                row.append({"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(part)} | ({"ids": part} if with_ids else {}) | ({"task__": task, "nth__": counts[n]} if numbered else {}))
                counts[n] += 1
            out.append(row)
        return [out]

    fields = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:binary" * with_ids + ",task__:int,nth__:bigint" * numbered
    keep = _others(keep, with_ids)
    made = map_text(df.select(*kept(keep), F.col(f"`{text}`").alias("text")), "text", ["kept__"] * bool(keep), f"pieces__ array<struct<{fields}>>", work)
    new = [f.split(":")[0] for f in fields.split(",")]
    return unpacked(made.select(*["kept__"] * bool(keep), F.inline("pieces__")), keep, new)


def _others(keep: list[str], with_ids: bool) -> list[str]:
    return [c for c in keep if c.lower() not in {"piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"}]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in the order they lie in a sequence) and how often each is used; together they use up the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] += c
    out = []
    while left.any():
        free = left.copy()  # less what the open sequence holds
        lengths = np.arange(capacity + 1)
        below = np.maximum.accumulate(np.where(free > 0, lengths, 0))  # the longest free piece up to each length

        def take(n: int, sign: int) -> None:
            nonlocal below
            free[n] -= sign
            if (sign > 0 and free[n] == 0) or (sign < 0 and free[n] == 1):
                below = np.maximum.accumulate(np.where(free > 0, lengths, 0))

        held: list[int] = []
        gap = capacity
        while (n := int(below[gap])) > 0:
            held.append(n)
            gap -= n
            take(n, 1)
        while gap and held:
            low = min(held)
            room = gap + low
            a = np.flatnonzero(free[:room] > 0)
            b = below[room - a]
            same = (b == a) & (free[a] < 2)
            b[same] = below[np.maximum(a[same] - 1, 0)]
            total = np.where(b > 0, a + b, 0)
            if not len(a) or total.max() <= low:
                break
            k = int(total.argmax())
            held.remove(low)
            take(low, -1)
            for n in (int(a[k]), int(b[k])):
                held.append(n)
                take(n, 1)
            gap = room - int(total[k])
        uses = Counter(held)
        times = min(int(left[n]) // u for n, u in uses.items())
        for n, u in uses.items():
            left[n] -= times * u
        out.append((held, times))
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) by rank; rank r of a row is in sequence first + (r - first rank)."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for held, times in patterns:
        offset = 0
        for n in held:
            out.setdefault(n, []).append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: np.array(x, np.int64) for n, x in out.items()}


def packed(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, *, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """The rows of ``pieces`` with sequence_id (from 0, without gaps) and offset."""
    keep = _others(df.columns if keep is None else keep, with_ids)
    own = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    made = pieces(df.select(*kept(keep), F.col(f"`{text}`").alias("text")), path, "text", ["kept__"] * bool(keep), capacity=capacity, end=end, with_ids=with_ids, numbered=True, kept_bytes=kept_bytes)
    # a piece's number is written with it, so that every reading finds the same
    found = written(made, "pieces")
    counts = written(found.groupBy("task__", "length").agg(F.count("*").alias("n__")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n__").alias("n")).collect()}
    table = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task__").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    bases = counts.select("task__", "length", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("base__"))
    side = F.broadcast(bases) if small_enough(counts, 24) else bases
    columns = [*["kept__"] * bool(keep), *own]
    frame = found.join(side, ["task__", "length"]).select(*columns, (F.col("nth__") + F.col("base__")).alias("rank__"))
    out = frame.drop("rank__").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        at = columns.index("length")
        for b in batches:
            lengths, ranks = b.column(at).to_numpy(zero_copy_only=False), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            starts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for mine in np.split(order, starts[1:]) if len(order) else []:
                t = table[int(lengths[mine[0]])]
                k = np.searchsorted(t[:, 0], ranks[mine], side="right") - 1
                sequence[mine] = t[k, 1] + ranks[mine] - t[k, 0]
                offset[mine] = t[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=out.names)

    return unpacked(frame.mapInArrow(place, out), keep, [*own, "sequence_id", "offset"])
