"""Running sums and places over a whole table, by ranges whose bounds are fixed beforehand, so that no task sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that bounds are taken from. They settle how evenly rows are dealt, never a result.
SAMPLE_ROWS = 10_000


def range_of(rows: DataFrame, keys: list[Column], parts: int | None = None) -> Column:
    """The number of the range that a row's keys lie in: 0 for the least. Bounds are literals, so a row has the same number wherever it is asked for."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"k{i}" for i in range(len(keys))]
    drawn = rows.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)])
    found = drawn.orderBy(F.rand(7)).limit(SAMPLE_ROWS).orderBy(*names).collect()
    bounds = list(dict.fromkeys(tuple(found[len(found) * i // parts]) for i in range(1, parts))) if found else []
    if not bounds:
        return F.lit(0)
    kinds = [f.dataType for f in drawn.schema]
    made = [F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(b, kinds, names, strict=True)]) for b in bounds]
    mine = F.struct(*[k.alias(n) for k, n in zip(keys, names, strict=True)])
    return F.size(F.filter(F.array(*made), lambda b: b < mine))


def with_running(rows: DataFrame, keys: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds by name the sum of each column over the rows up to this one, in ascending order of the keys, which tell rows apart."""
    dealt = rows.withColumn("part__", range_of(rows, keys, parts))
    upto = Window.partitionBy("part__").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    totals = dealt.groupBy("part__").agg(*[F.sum(c).alias(f"{n}__") for n, c in sums.items()])
    offsets = totals.select("part__", *[F.coalesce(F.sum(f"{n}__").over(before), F.lit(0)).alias(f"{n}__") for n in sums])
    summed = dealt.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}).join(F.broadcast(offsets), "part__")  # a row a range
    return summed.withColumns({n: F.col(n) + F.col(f"{n}__") for n in sums}).drop("part__", *[f"{n}__" for n in sums])
