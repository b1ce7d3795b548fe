"""Sparse scores: bidirectional top-k, rank lists, role mapping, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.ordering import with_running

def sparse_topk(scores: DataFrame, k: int, *, row: str = "sub", col: str = "rev", s: str = "s") -> DataFrame:
    """Pairs among the k best of their row or of their column; ties go to the lesser id."""

    def best(of: str, other: str) -> DataFrame:
        # a limit of its own for each side, which tasks keep to before they shuffle
        place = F.row_number().over(Window.partitionBy(of).orderBy(F.desc(s), other))
        return scores.withColumn("r__", place).filter(F.col("r__") <= k).drop("r__")

    return best(row, col).union(best(col, row)).distinct()


def rank_lists(scores: DataFrame, *, row: str = "sub", col: str = "rev", s: str = "s", digits: int = 4) -> DataFrame:
    """row, ranks: "id;score" strings from the best, joined by commas."""
    packed = F.sort_array(F.collect_list(F.struct((-F.col(s)).alias("s"), F.col(col).alias("c"))))
    lists = scores.groupBy(row).agg(packed.alias("p__"))
    return lists.select(row, F.array_join(F.transform("p__", lambda x: F.concat_ws(";", x["c"].cast("string"), F.format_string(f"%.{digits}f", -x["s"]))), ",").alias("ranks"))


def roles(scores: DataFrame, symmetric: bool, *, row: str = "sub", col: str = "rev", s: str = "s") -> DataFrame:
    """entityA, entityB, score: rows are A in symmetric jobs, else B; in mixed jobs a row named dummy is dropped."""
    a, b = (row, col) if symmetric else (col, row)
    rows = scores if symmetric else scores.filter(F.col(row).cast("string") != "dummy")
    return rows.select(F.col(a).alias("entityA"), F.col(b).alias("entityB"), F.col(s).alias("score"))


def statistics(scores: DataFrame, s: str = "s") -> DataFrame:
    """One row: n, mean, std, min, quartiles, max. Quartiles are interpolated between the values at their places, which come from counts of ranges; no task has all scores."""
    known = scores.filter(F.col(s).isNotNull()).select(F.col(s).alias("s__"))
    made = known.agg(F.count("s__").alias("n"), F.avg("s__").alias("mean"), F.stddev_samp("s__").alias("std"), F.min("s__").alias("min"), F.max("s__").alias("max"))
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    at = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    ends = {f"{name}_{end.__name__}": end(x) for name, x in at.items() for end in (F.floor, F.ceil)}
    placed = with_running(known, [F.col("s__")], {"place__": F.lit(1)}).crossJoin(F.broadcast(made.select("n")))  # one row
    picked = placed.withColumn("place__", F.col("place__") - 1).agg(*[F.max(F.when(F.col("place__") == x, F.col("s__"))).alias(name) for name, x in ends.items()])
    whole = made.crossJoin(F.broadcast(picked))
    value = lambda name: F.col(f"{name}_floor") + (F.col(f"{name}_ceil") - F.col(f"{name}_floor")) * (at[name] - F.floor(at[name]))
    return whole.select("n", "mean", "std", "min", *[value(name).alias(name) for name in shares], "max")


def closest(cells: DataFrame, *, sub: str = "sub", pub: str = "pub", s: str = "s") -> DataFrame:
    """The best publication of each submission, the lesser id among equals."""
    best = F.max(F.struct(F.col(s), (-F.col(pub)).alias("p")))
    return cells.groupBy(sub).agg(best.alias("b__")).select(sub, (-F.col("b__.p")).alias(pub), F.col(f"b__.{s}").alias(s))


def predictions(rows: DataFrame, k: int, q: str = "q", s: str = "s", item: str = "item") -> DataFrame:
    """q, item, s, place: the k best items of each query, the lesser id first among equals."""
    w = Window.partitionBy(q).orderBy(F.desc(s), item)
    return rows.select(q, item, s).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def top_mean(cells: DataFrame, authorship: DataFrame, m: int, *, sub: str = "sub", pub: str = "pub", author: str = "rev", s: str = "s") -> DataFrame:
    """Mean of each author's m best publications."""
    w = Window.partitionBy(sub, author).orderBy(F.desc(s), pub)
    joined = cells.join(authorship.select(pub, author), pub)
    return joined.withColumn("r__", F.row_number().over(w)).filter(F.col("r__") <= m).groupBy(sub, author).agg(F.avg(s).alias(s))


def histogram(scores: DataFrame, bins: int, s: str = "s") -> DataFrame:
    """bin, n: counts of equal steps from the least score to the greatest, which is in the last; bins without a score aren't listed."""
    ends = scores.agg(F.min(s).alias("low__"), F.max(s).alias("high__"))
    step = F.coalesce((F.col(s) - F.col("low__")) / F.nullif(F.col("high__") - F.col("low__"), F.lit(0.0)), F.lit(0.0))
    at = F.least(F.floor(step * bins), F.lit(bins - 1)).cast("int")
    return scores.filter(F.col(s).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row is broadcast
