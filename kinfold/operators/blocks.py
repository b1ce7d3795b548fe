"""Similarity of two sets of vectors, aggregated by author and cut to the best few inside the products of blocks.

Vectors are packed into matrices of up to BLOCK rows, those that lie together in a partition's order of signs in one,
with the mean of the block and the greatest distance from it. Blocks meet blocks: what leaves a product is a row a
submission and author, or the best few of each line and column; never a row a cell. A product that can't bring anything,
by the bound that means and distances give (Cauchy-Schwarz), isn't worked out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import rounded

BLOCK = 2048
#: Publications of one author up to which they lie in one block whole, where quantiles are taken.
WHOLE = 1 << 16
#: Vectors of each side that all blocks of the other are held against first. They settle which products can be left out, never a result.
SAMPLE = 1024
#: Components whose signs put vectors in order within a partition.
SIGNS = 16
#: Cells that are scored at once, so that what lies between stays in a processor's cache.
CACHED = 1 << 16


def _together(df: DataFrame, *order: str) -> DataFrame:
    """Rows of each partition in the order of the signs of their first components: like ones come into one block, without a shuffle."""
    code = F.aggregate(F.slice("v", 1, SIGNS), F.lit(0), lambda n, x: n * 2 + F.when(x > 0, 1).otherwise(0))
    return df.withColumn("code__", code).sortWithinPartitions("code__", *order).drop("code__")


def _shape(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean of the rows, and the greatest distance from it."""
    mean = x.mean(axis=0)
    return mean, float(np.sqrt(np.square(x - mean).sum(axis=1).max(initial=0)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten().cast(pa.float64()))
    return flat.reshape(len(vectors), -1)


def _once(blocks: DataFrame) -> DataFrame:
    """Blocks that every partition of the other side meets: packed once, where else each would pack them anew. They go with their last reference."""
    return blocks.localCheckpoint(eager=False)


def _key(counter: list[int]) -> int:
    """A number for each block that a task makes, the same whenever it is made again."""
    from pyspark import TaskContext

    context = TaskContext.get()
    counter[0] += 1
    return ((context.partitionId() if context else 0) << 32) + counter[0]


def _lines(subs: DataFrame, sub: str, vector: str, block: int) -> DataFrame:
    """a_key, a_ids, a_matrix, a_mean, a_radius: submissions in blocks, ids ascending in each."""
    rows = _together(subs.select(F.col(sub).cast("long").alias("i"), F.col(vector).alias("v")), "i")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = [0]
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                part = part.take(pa.array(np.argsort(np.asarray(part.column(0)), kind="stable")))
                x = _matrix(part.column(1))
                mean, radius = _shape(x)
                yield pa.RecordBatch.from_arrays([pa.array([_key(counter)]), pa.array([np.asarray(part.column(0)).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary()), pa.array([radius])], names=["a_key", "a_ids", "a_matrix", "a_mean", "a_radius"])

    return _once(rows.mapInArrow(pack, "a_key long, a_ids binary, a_matrix binary, a_mean binary, a_radius double"))


def _columns(owned: DataFrame, block: int) -> DataFrame:
    """b_key, b_names, b_codes, b_weights, b_matrix, b_mean, b_radius: publications (v, who, w) in blocks by author, authors ascending in each."""
    kind = owned.schema["who"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = [0]
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                who = part.column(1).dictionary_encode()
                names = who.dictionary.to_pylist()
                order = sorted(range(len(names)), key=names.__getitem__)
                place = np.empty(len(names), np.int64)
                place[order] = np.arange(len(names))
                codes = place[np.asarray(who.indices)]
                rows = np.argsort(codes, kind="stable")
                x = _matrix(part.column(0))[rows]
                mean, radius = _shape(x)
                weights = np.asarray(part.column(2).cast(pa.float64()))[rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([_key(counter)]), pa.array([[names[i] for i in order]], pa.list_(who.dictionary.type)), pa.array([codes[rows].astype("<i4").tobytes()], pa.binary()),
                    pa.array([weights.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary()), pa.array([radius]),
                ], names=["b_key", "b_names", "b_codes", "b_weights", "b_matrix", "b_mean", "b_radius"])

    return _once(owned.select("v", "who", "w").mapInArrow(pack, f"b_key long, b_names array<{kind}>, b_codes binary, b_weights binary, b_matrix binary, b_mean binary, b_radius double"))


def _rounded(s: np.ndarray, digits: int) -> np.ndarray:
    return np.rint(s * 10**digits) / 10**digits


def _scored(s: np.ndarray, weights: np.ndarray | None, low: float | None, high: float | None) -> np.ndarray:
    """Products drawn to [0, 1] by the extremes of all, where these are given, and shifted in log-odds by weights other than 1. ``s`` is overwritten."""
    if low is not None:
        if high > low:
            s -= low
            s /= high - low
        else:
            np.clip(s, 0.0, 1.0, out=s)
    if weights is not None and not np.isnan(weights).all():
        w = np.maximum(np.where(np.isnan(weights), 1.0, weights), 1e-8)
        np.clip(s, 1e-8, 1 - 1e-8, out=s)
        above = w * s
        np.subtract(1.0, s, out=s)
        s += above
        np.divide(above, s, out=s)
    return s


def _quantiles(s: np.ndarray, share: float) -> np.ndarray:
    """The interpolated quantile of each line, as np.quantile has it. Lines are put in another order."""
    at = (s.shape[1] - 1) * share
    k = int(at)
    s.partition(k, axis=1)
    low = s[:, k].copy()
    if k + 1 == s.shape[1]:
        return low
    high = s[:, k + 1 :].min(axis=1)
    step, part = high - low, at - k
    return np.where(np.isnan(high), np.nan, low + step * part if part < 0.5 else high - step * (1 - part))


class Pair:
    """A block of submissions beside one of publications."""

    def __init__(self, row: dict, names: pa.Array | None) -> None:
        self.row, self.names = row, names
        self.low, self.high = row.get("low"), row.get("high")
        self.weights = np.frombuffer(row["b_weights"]) if "b_weights" in row else None

    def reach(self) -> tuple[float, float]:
        """What every product lies between."""
        p, q = np.frombuffer(self.row["a_mean"]), np.frombuffer(self.row["b_mean"])
        r, s = self.row["a_radius"], self.row["b_radius"]
        off = r * np.sqrt(q @ q) + s * np.sqrt(p @ p) + r * s
        slack = 1e-9 * (1 + abs(p @ q) + off)
        return p @ q - off - slack, p @ q + off + slack

    def ceiling(self) -> float:
        """What no score passes."""
        top = np.array([self.reach()[1]])
        return float(self.scored(top, np.array([self.weights.max()])).max())

    def scored(self, s: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        return _scored(s, weights, self.low, self.high)

    def products(self, most: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Lines of the block of submissions, some ``most`` cells at a time."""
        n = len(self.row["a_ids"]) // 8
        x = np.frombuffer(self.row["a_matrix"]).reshape(n, -1)
        y = np.frombuffer(self.row["b_matrix"]).reshape(-1, x.shape[1])
        step = max(1, most // len(y))
        for at in range(0, n, step):
            yield slice(at, at + step), x[at : at + step] @ y.T

    @property
    def ids(self) -> np.ndarray:
        return np.frombuffer(self.row["a_ids"], np.int64)

    @property
    def starts(self) -> np.ndarray:
        """Where each author's publications begin."""
        return np.flatnonzero(np.diff(np.frombuffer(self.row["b_codes"], "<i4"), prepend=-1))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[Pair]:
    for b in batches:
        at = b.schema.get_field_index("b_names")
        rest = b.drop_columns(["b_names"]) if at >= 0 else b
        for k in range(b.num_rows):  # a row at a time: each has two matrices
            row = {n: rest.column(i)[k].as_py() for i, n in enumerate(rest.schema.names)}
            yield Pair(row, b.column(at)[k].values if at >= 0 else None)


def extremes(subs: DataFrame, pubs: DataFrame, *, sub: str = "sub", vector: str = "e", block: int = BLOCK, skipped: Accumulator | None = None) -> DataFrame:
    """One row, low and high: the least and the greatest product of a submission and a publication. Two numbers leave each task."""
    every = _columns(_together(pubs.select(F.col(vector).alias("v"), F.lit(0).alias("who"), F.lit(None).cast("double").alias("w"))), block)
    both = _lines(subs, sub, vector, block).crossJoin(every)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.inf, -np.inf
        for pair in _pairs(batches):
            least, most = pair.reach()
            if least >= low and most <= high:
                if skipped is not None:
                    skipped.add(1)
                continue
            for _, s in pair.products(1 << 20):
                low, high = min(low, s.min(initial=np.inf)), max(high, s.max(initial=-np.inf))
        if low <= high:
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([high])], names=["low", "high"])

    return both.mapInArrow(ends, "low double, high double").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _owned(pubs: DataFrame, authorship: DataFrame, pub: str, author: str, vector: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(None).cast("double")
    return pubs.select(pub, F.col(vector).alias("v"), w.alias("w")).join(authorship.select(pub, F.col(author).alias("who")), pub).filter("who is not null").drop(pub)


def author_scores(subs: DataFrame, pubs: DataFrame, authorship: DataFrame, how: str = "max", *, sub: str = "sub", pub: str = "pub", author: str = "rev", vector: str = "e", block: int = BLOCK, digits: int | None = 4, ends: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """sub, author, s: max or mean over the author's publications, without a row for each cell. Publications carry their
    authors into the blocks; a product leaves it as one row a submission and author, and only these are shuffled.
    ``ends`` (one row, low and high) draws products to [0, 1]; ``weight`` names publications' weights."""
    owned = _owned(pubs, authorship, pub, author, vector, weight)
    kind = owned.schema["who"].dataType.simpleString()
    # an author's vectors in a few blocks; ranges part those of a hot author too
    near = owned.withColumn("h__", F.xxhash64("v")).repartitionByRange("who", "h__").sortWithinPartitions("who").drop("h__")
    both = _with_ends(_lines(subs, sub, vector, block), ends).crossJoin(_columns(near, block))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _pairs(batches):
            start = pair.starts
            n = np.diff(np.append(start, len(pair.weights)))
            for lines, s in pair.products(200_000):
                s = pair.scored(s, pair.weights)
                rows = len(s)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(pair.ids[lines], len(n))), pair.names.take(pa.array(np.tile(np.arange(len(n)), rows))), pa.array(np.maximum.reduceat(s, start, axis=1).ravel()),
                    pa.array(np.add.reduceat(s, start, axis=1).ravel()), pa.array(np.tile(n, rows).astype(np.int64)),
                ], names=["sub", "who", "most", "total", "n"])

    parts = both.mapInArrow(work, f"sub long, who {kind}, most double, total double, n long").groupBy(F.col("sub").alias(sub), F.col("who").alias(author))
    value = {"max": F.max("most"), "mean": F.sum("total") / F.sum("n")}[how]
    out = parts.agg(value.alias("s"))
    return out if digits is None else out.withColumn("s", rounded(F.col("s"), digits))


def closest_pairs(subs: DataFrame, pubs: DataFrame, *, sub: str = "sub", pub: str = "pub", vector: str = "e", block: int = BLOCK, digits: int = 4) -> DataFrame:
    """sub, pub, s: of each submission and block the publication of the greatest score, rounded half-even; the lesser id among equals."""
    columns = _columns(_together(pubs.select(F.col(vector).alias("v"), F.col(pub).alias("who"), F.lit(None).cast("double").alias("w")), "who"), block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _pairs(batches):
            codes = np.frombuffer(pair.row["b_codes"], "<i4")
            for lines, s in pair.products(1 << 20):
                s = _rounded(s, digits)
                at = s.argmax(axis=1)  # ids ascend in a block
                yield pa.RecordBatch.from_arrays([pa.array(pair.ids[lines]), pair.names.take(pa.array(codes[at])), pa.array(s[np.arange(len(s)), at])], names=["sub", "pub", "s"])

    found = _lines(subs, sub, vector, block).crossJoin(columns).mapInArrow(work, f"sub long, pub {dict(pubs.dtypes)[pub]}, s double")
    return found.select(F.col("sub").alias(sub), F.col("pub").alias(pub), "s")


def best_means(subs: DataFrame, pubs: DataFrame, authorship: DataFrame, m: int, *, sub: str = "sub", pub: str = "pub", author: str = "rev", vector: str = "e", block: int = BLOCK) -> DataFrame:
    """sub, author, s: the mean of the author's m best publications. Of each submission, author and block m scores are shuffled at most."""
    owned = _owned(pubs, authorship, pub, author, vector, None)
    kind = owned.schema["who"].dataType.simpleString()
    near = owned.withColumn("h__", F.xxhash64("v")).repartitionByRange("who", "h__").sortWithinPartitions("who").drop("h__")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _pairs(batches):
            stop = np.append(pair.starts[1:], len(pair.weights))
            for lines, s in pair.products(1 << 20):
                ids = pair.ids[lines]
                for at, (i, j) in enumerate(zip(pair.starts, stop, strict=True)):
                    part = s[:, i:j]
                    if j - i > m:
                        part = np.partition(part, j - i - m, axis=1)[:, j - i - m :]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, part.shape[1])), pair.names.take(pa.array(np.full(part.size, at))), pa.array(part.ravel())], names=["sub", "who", "s"])

    parts = _lines(subs, sub, vector, block).crossJoin(_columns(near, block)).mapInArrow(work, f"sub long, who {kind}, s double")
    place = F.row_number().over(Window.partitionBy("sub", "who").orderBy(F.desc("s")))
    return parts.withColumn("r__", place).filter(F.col("r__") <= m).groupBy(F.col("sub").alias(sub), F.col("who").alias(author)).agg(F.avg("s").alias("s"))


def _with_ends(lines: DataFrame, ends: DataFrame | None) -> DataFrame:
    return lines if ends is None else lines.crossJoin(F.broadcast(ends.select("low", "high")))  # one row


def best_of(s: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Which cells are among the k best along the axis; of equal ones the first are."""
    n = s.shape[axis]
    if n <= k:
        return np.ones(s.shape, bool)
    last = np.take(np.partition(s, n - k, axis=axis), [n - k], axis=axis)
    above, level = s > last, s == last
    room = k - above.sum(axis=axis, keepdims=True)
    return above | (level & (np.cumsum(level, axis=axis) <= room))


def _floor(s: np.ndarray, k: int, axis: int) -> np.ndarray:
    """The k-th best along the axis, or nothing to hold on to where there are fewer."""
    n = s.shape[axis]
    if n < k:
        return np.full(s.shape[1 - axis], -np.inf)
    return np.take(np.partition(s, n - k, axis=axis), n - k, axis=axis)


def best_pairs(subs: DataFrame, pubs: DataFrame, authorship: DataFrame, k: int, *, sub: str = "sub", pub: str = "pub", author: str = "rev", vector: str = "e", block: int = BLOCK, digits: int = 4, ends: DataFrame | None = None, weight: str | None = None, skipped: Accumulator | None = None) -> DataFrame:
    """sub, author, s: the greatest score over the author's publications, rounded half-even, of the pairs among the k best of
    their submission or of their author; ties go to the lesser id.

    A product gives, for each of its submissions, its k best authors, and for each of its authors the k best submissions;
    no more is shuffled. An author in several blocks has a part of the score in each: where a pair is among the k best at
    all, it is so in the block that has its whole score, so both lists are exact after the greatest part is taken. A
    sample of the other side, of SAMPLE vectors, and then what a task has seen, give each submission and author a floor; a
    product whose ceiling lies below all of them is left out (counted in ``skipped``), and cells below theirs stay.
    """
    owned = _owned(pubs, authorship, pub, author, vector, weight)
    kind = owned.schema["who"].dataType.simpleString()
    low, high = (None, None) if ends is None else ends.select("low", "high").first()
    some = owned.orderBy(F.rand(7)).limit(SAMPLE).orderBy("who").select("v", "who", "w").toArrow().combine_chunks()
    theirs = subs.select(F.col(vector).alias("v")).orderBy(F.rand(7)).limit(SAMPLE).toArrow().combine_chunks()
    if not some.num_rows or not theirs.num_rows or low is None and ends is not None:
        return subs.sparkSession.createDataFrame([], f"{sub} long, {author} {kind}, s double")
    pub_x, sub_x = (_matrix(t["v"].combine_chunks()) for t in (some, theirs))
    pub_w = np.asarray(some["w"].combine_chunks().cast(pa.float64()))
    pub_at = np.flatnonzero(np.diff(np.asarray(some["who"].combine_chunks().dictionary_encode().indices), prepend=-1))

    def of_lines(x: np.ndarray) -> np.ndarray:
        return _floor(_rounded(np.maximum.reduceat(_scored(x @ pub_x.T, pub_w, low, high), pub_at, axis=1), digits), k, 1)

    def of_columns(y: np.ndarray, weights: np.ndarray, start: np.ndarray) -> np.ndarray:
        return _floor(_rounded(np.maximum.reduceat(_scored(sub_x @ y.T, weights, low, high), start, axis=1), digits), k, 0)

    both = _lines(subs, sub, vector, block).crossJoin(_columns(_together(owned, "who"), block))
    step = 10.0**-digits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple[str, int], np.ndarray] = {}  # a number a submission or author of the task's blocks
        for pair in _pairs(batches):
            start, ids = pair.starts, pair.ids
            a, b = ("a", pair.row["a_key"]), ("b", pair.row["b_key"])
            pair.low, pair.high = low, high
            if a not in floors:
                floors[a] = of_lines(np.frombuffer(pair.row["a_matrix"]).reshape(len(ids), -1))
            if b not in floors:
                floors[b] = of_columns(np.frombuffer(pair.row["b_matrix"]).reshape(len(pair.weights), -1), pair.weights, start)
            by_line, by_column = floors[a], floors[b]
            if pair.ceiling() + step < min(by_line.min(), by_column.min()):
                if skipped is not None:
                    skipped.add(1)
                continue
            s = np.concatenate([np.maximum.reduceat(pair.scored(x, pair.weights), start, axis=1) for _, x in pair.products(1 << 20)])
            s = _rounded(s, digits)
            good = s >= by_line[:, None], s >= by_column
            np.maximum(by_line, _floor(s, k, 1), out=by_line)
            np.maximum(by_column, _floor(s, k, 0), out=by_column)
            line, column = best_of(s, k, 1) & good[0], best_of(s, k, 0) & good[1]
            r, c = np.nonzero(line | column)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pair.names.take(pa.array(c)), pa.array(s[r, c]), pa.array(line[r, c]), pa.array(column[r, c])], names=["sub", "who", "s", "line", "column"])

    found = both.mapInArrow(work, f"sub long, who {kind}, s double, line boolean, column boolean")

    return ranked(found, k).select(F.col("sub").alias(sub), F.col("who").alias(author), "s")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """sub, who, s of the k best of each sub among rows of its list (``line``), and of each who among those of its own (``column``); ties go to the lesser id. A pair counts by its greatest s."""

    def best(test: str, of: str, other: str) -> DataFrame:
        # parted by whose list it is: one shuffle for the greatest parts and for the places
        whole = found.filter(test).repartition(of).groupBy("sub", "who").agg(F.max("s").alias("s"))
        place = F.row_number().over(Window.partitionBy(of).orderBy(F.desc("s"), other))
        return whole.withColumn("r__", place).filter(F.col("r__") <= k).drop("r__")

    return best("line", "sub", "who").union(best("column", "who", "sub")).distinct()


def percentile_scores(subs: DataFrame, pubs: DataFrame, authorship: DataFrame, share: float, *, sub: str = "sub", pub: str = "pub", author: str = "rev", vector: str = "e", block: int = BLOCK, most: int = WHOLE, digits: int | None = 4, ends: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """sub, author, s: the quantile of ``share`` over the author's publications, interpolated between neighbours.

    Authors of up to ``most`` publications have them all in one block, where the quantile is taken: a row a submission and
    author. Of the others every cell is a row, of which the two of the quantile's places are picked by sorted runs, which
    spill; no list of cells is made.
    """
    most = max(most, block)
    share = min(max(share, 0.0), 1.0)
    owned = _owned(pubs, authorship, pub, author, vector, weight)
    kind = owned.schema["who"].dataType.simpleString()
    large = owned.groupBy("who").agg(F.count("*").alias("n__")).filter(F.col("n__") > most)
    marked = owned.join(large, "who", "left")
    lines = _with_ends(_lines(subs, sub, vector, block), ends)
    schema = f"sub long, who {kind}, s double, n long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _pairs(batches):
            start = pair.starts
            stop = np.append(start[1:], len(pair.weights))
            # some lines at a time, as many as a processor's cache holds but enough for each author's quantiles to be worth a call
            most_cells = min(max(CACHED, 10_000 * len(start)), 1 << 20)
            for part, s in pair.products(max(1 << 20, 16 * int((stop - start).max()))):
                made = np.empty((len(s), len(start)))
                step = max(1, most_cells // s.shape[1])
                for at in range(0, len(s), step):
                    some = pair.scored(s[at : at + step], pair.weights)
                    for k, (i, j) in enumerate(zip(start, stop, strict=True)):
                        made[at : at + step, k] = _quantiles(some[:, i:j], share)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(pair.ids[part], len(start))), pair.names.take(pa.array(np.tile(np.arange(len(start)), len(s)))), pa.array(made.ravel()), pa.array(np.tile(stop - start, len(s)).astype(np.int64))], names=["sub", "who", "s", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _pairs(batches):
            codes = np.frombuffer(pair.row["b_codes"], "<i4")
            for part, s in pair.products(200_000):
                s = pair.scored(s, pair.weights)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(pair.ids[part], len(codes))), pair.names.take(pa.array(np.tile(codes, len(s)))), pa.array(s.ravel()), pa.array(np.ones(s.size, np.int64))], names=["sub", "who", "s", "n"])

    small = marked.filter("n__ is null").repartition("who").sortWithinPartitions("who")
    done = lines.crossJoin(_whole_authors(small, block, most)).mapInArrow(whole, schema).select("sub", "who", "s")
    cells = lines.crossJoin(_columns(_together(marked.filter("n__ is not null"), "who"), block)).mapInArrow(each, schema)
    picked = quantile(cells.join(large, "who"), ["sub", "who"], "s", F.col("n__"), share)
    out = done.union(picked).select(F.col("sub").alias(sub), F.col("who").alias(author), "s")
    return out if digits is None else out.withColumn("s", rounded(F.col("s"), digits))


def quantile(rows: DataFrame, keys: list[str], s: str, n: Column, share: float) -> DataFrame:
    """keys, s: the interpolated quantile of each key's n values, from the two at its places in a sorted run."""
    at = F.lit(share) * (n - 1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(s)) - 1
    two = rows.withColumns({"at__": at, "r__": place}).filter((F.col("r__") == F.floor("at__")) | (F.col("r__") == F.ceil("at__")))
    low, high = F.min(s), F.max(s)
    return two.groupBy(*keys).agg((low + (high - low) * (F.max("at__") - F.floor(F.max("at__")))).alias(s))


def _whole_authors(rows: DataFrame, block: int, most: int) -> DataFrame:
    """Blocks of rows sorted by author, none of whom is split: authors of up to ``block`` rows together, or a larger one of up to ``most``."""
    kind = rows.schema["who"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = [0]
        held: pa.Table | None = None

        def made(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            who = part["who"].combine_chunks().dictionary_encode()
            codes = np.asarray(who.indices)  # sorted, so in order of appearance
            x = _matrix(part["v"].combine_chunks())
            mean, radius = _shape(x)
            return pa.RecordBatch.from_arrays([
                pa.array([_key(counter)]), pa.array([who.dictionary.to_pylist()], pa.list_(who.dictionary.type)), pa.array([codes.astype("<i4").tobytes()], pa.binary()),
                pa.array([np.asarray(part["w"].combine_chunks().cast(pa.float64())).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary()), pa.array([radius]),
            ], names=["b_key", "b_names", "b_codes", "b_weights", "b_matrix", "b_mean", "b_radius"])

        def first() -> int:
            """Where a block ends: before the author across the cut, or behind the first one if there is no other before."""
            if held.num_rows <= block:
                return held.num_rows
            codes = np.asarray(held["who"].slice(0, most + 1).combine_chunks().dictionary_encode().indices)
            return int(np.searchsorted(codes, codes[block])) or int(np.searchsorted(codes, codes[0], side="right"))

        for b in batches:
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            while held.num_rows > block + most:
                cut = first()
                yield made(held.slice(0, cut))
                held = held.slice(cut)
        while held is not None and held.num_rows:
            cut = first()
            yield made(held.slice(0, cut))
            held = held.slice(cut)

    return _once(rows.select("v", "who", "w").mapInArrow(pack, f"b_key long, b_names array<{kind}>, b_codes binary, b_weights binary, b_matrix binary, b_mean binary, b_radius double"))
