"""Hard negatives by blocked products of matrices.

Anchors go in waves of bounded bytes, each broadcast to all tasks, which scan the candidates in blocks: one product in
float64 for every block of anchors and block of candidates. A task keeps the best few of each anchor, whatever it reads,
and these merge by anchor. The first pass gives an anchor's positives, the second its negatives in each positive's
window. Waves of anchors against all rows are what is asked for; a wave is so large that products, not reading, take the
time. Each wave's result is written, so none is lost with an executor.

Rows take no part without id, label or vector, or with a null or non-finite component. Vectors of different lengths
count as filled up with zeros. Products that might reach 2^53 are worked out in whole numbers instead; scores beyond 64
bits count as the nearest number of 64 bits. Rows that share an id count as one candidate, by the best score of those that
qualify; as an anchor the one of least label, then least vector, counts. Without anchors, or with an empty table, the
result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import appended, written

#: Bytes of anchors' components in float64 that a broadcast holds.
WAVE_BYTES = 16 << 20
#: Rows of a block of anchors, and of candidates.
ANCHORS, CANDIDATES = 1024, 2048
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The k best (score, id) of each of n places: higher scores first, then lesser ids; an id once."""

    def __init__(self, n: int, k: int) -> None:
        self.scores, self.ids = np.full((n, k), _LEAST), np.full((n, k), _MOST)
        self.filled = np.zeros(n, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        full = self.filled[at] == k
        last, last_id = self.scores[at, k - 1], self.ids[at, k - 1]
        good = ~full | (scores > last) | ((scores == last) & (ids < last_id))
        at, scores, ids = at[good], scores[good], ids[good]
        if not len(at):
            return
        touched = np.unique(at)
        held = np.arange(k) < self.filled[touched, None]
        at = np.concatenate([at, np.repeat(touched, k)[held.ravel()]])
        scores = np.concatenate([scores, self.scores[touched][held]])
        ids = np.concatenate([ids, self.ids[touched][held]])
        order = np.lexsort((-1 - scores, ids, at))  # of one id the best score comes first; -1 - x turns the order and can't overflow
        at, scores, ids = at[order], scores[order], ids[order]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])
        at, scores, ids = at[first], scores[first], ids[first]
        order = np.lexsort((ids, -1 - scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        start = np.searchsorted(at, touched)
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        keep = rank < k
        self.scores[at[keep], rank[keep]], self.ids[at[keep], rank[keep]] = scores[keep], ids[keep]
        self.filled[touched] = np.minimum(np.diff(np.append(start, len(at))), k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, scores and ids of all that is held."""
        held = np.arange(self.scores.shape[1]) < self.filled[:, None]
        return np.nonzero(held)[0], self.scores[held], self.ids[held]


def matrix(vectors: pa.Array, scale: float) -> np.ndarray:
    """Rows of floor(scale * x) in float64; shorter ones are filled up with zeros."""
    flat = np.floor(np.asarray(vectors.flatten().cast(pa.float64())) * scale)
    n = np.asarray(vectors.value_lengths()).astype(np.int64)
    if not len(n):
        return np.zeros((0, 0))
    if (n == n[0]).all():
        return flat.reshape(len(n), n[0])
    made = np.zeros((len(n), n.max()))
    made[np.arange(n.max()) < n[:, None]] = flat
    return made


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with rows as 64-bit numbers."""
    d = min(x.shape[1], y.shape[1])
    x, y = x[:, :d], y[:, :d]
    with np.errstate(over="ignore"):
        bound = np.sqrt(np.square(x).sum(1).max(initial=0)) * np.sqrt(np.square(y).sum(1).max(initial=0))
    if bound < 2.0**52:
        return (x @ y.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    made = np.dot(whole(x), whole(y).T)
    return np.clip(made, _LEAST, _MOST).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and matrix of candidates. The first blocks are small: they fill the bests, against which most of the rest fails at once."""
    size = 64
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, size)
            at += size
            size = min(2 * size, CANDIDATES)
            yield np.asarray(part.column(0)), np.asarray(part.column(1)), matrix(part.column(2), scale)


def _valid(rows: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    taken = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return taken.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))


def _merged(parts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key over all tasks, with rank; an id counts once."""
    once = parts.repartition(keys[0]).groupBy(*keys, "other").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other"))).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, *, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each row that the condition ``anchors``
    (on columns id and label) picks, the first ``positives`` other rows of its label by score, and for each of them the first ``negatives`` rows
    of other labels with low * positive <= 100 * score <= high * positive. Components count as floor(scale * x)."""
    spark = rows.sparkSession
    valid = _valid(rows, vec_id, label, vector)
    one = valid.filter(anchors).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.*")
    one = written(one, "anchors")
    size = one.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0)).alias("b")).first()["b"]
    waves = -(-size // wave_bytes)

    def result(wave: int) -> DataFrame:
        part = one if waves == 1 else one.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave)
        table = part.toArrow().combine_chunks()
        ids, labels = np.asarray(table["id"]), np.asarray(table["label"])
        vectors = table["vector"].combine_chunks() if isinstance(table["vector"], pa.ChunkedArray) else table["vector"]
        x = matrix(vectors, scale)
        sent = spark.sparkContext.broadcast((ids, labels, x))

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, x = sent.value
            best = Best(len(ids), positives)
            for other, its, y in _blocks(batches, scale):
                for a in range(0, len(ids), ANCHORS):
                    s = product(x[a : a + ANCHORS], y)
                    mine = slice(a, a + ANCHORS)
                    hit = (s >= best.scores[mine, -1, None]) & (labels[mine, None] == its) & (ids[mine, None] != other)
                    r, c = np.nonzero(hit)
                    best.add(r + a, s[r, c], other[c])
            at, scores, found = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(scores)], names=["anchor", "other", "score"])

        near = _merged(valid.mapInArrow(first, "anchor long, other long, score long"), ["anchor"], positives).toArrow()
        # a wave's positives, at most ``positives`` an anchor: place, rank, id, score
        where = {int(v): i for i, v in enumerate(ids)}
        pos_ids, pos_scores = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        lows, highs = np.full((len(ids), positives), _MOST), np.full((len(ids), positives), _LEAST)
        for r in near.to_pylist():
            i, j, s = where[r["anchor"]], r["rank"] - 1, r["score"]
            pos_ids[i, j], pos_scores[i, j] = r["other"], s
            lows[i, j], highs[i, j] = max(-(-low * s // 100), _LEAST), min(high * s // 100, _MOST)
        windows = spark.sparkContext.broadcast((pos_ids, pos_scores, lows, highs))

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, x = sent.value
            pos_ids, pos_scores, lows, highs = windows.value
            best = [Best(len(ids), negatives) for _ in range(positives)]
            for other, its, y in _blocks(batches, scale):
                for a in range(0, len(ids), ANCHORS):
                    mine = slice(a, a + ANCHORS)
                    s = product(x[mine], y)
                    apart = labels[mine, None] != its
                    for j, b in enumerate(best):
                        r, c = np.nonzero(apart & (s >= np.maximum(lows[mine, j], b.scores[mine, -1])[:, None]) & (s <= highs[mine, j, None]))
                        b.add(r + a, s[r, c], other[c])
            for j, b in enumerate(best):
                at, scores, found = b.rows()
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[at], pos_ids[at, j], pos_scores[at, j], found, scores)], names=["anchor", "positive", "positive_score", "other", "score"])

        found = valid.mapInArrow(second, "anchor long, positive long, positive_score long, other long, score long")
        found = _merged(found, ["anchor", "positive", "positive_score"], negatives)
        return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    return appended(spark, (result(w) for w in range(waves)), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", "negatives")
