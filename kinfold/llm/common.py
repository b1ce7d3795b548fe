"""What the operators share: Arrow batches of bounded size, cut lineage, shared folders, pieces of text."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at once.
SLICE_BYTES = 4 << 20
#: A side is broadcast only if its measured size is at most this.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a session in one process takes a local one; any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: the driver and the executors need a folder that they share")
        found = f"file://{tempfile.mkdtemp(prefix='kinfold-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class _Written(threading.local):
    """Tables written by a thread of this driver and not yet discarded: jobs that run side by side have lists of their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


def discard(spark: SparkSession, since: int) -> None:
    """Delete the tables that this thread wrote after the first ``since``, but for the last, which was made of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.paths[since:-1]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _written.paths[since:]


def tables_written() -> int:
    return len(_written.paths)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold/{name}-{uuid.uuid4().hex}"
    _written.paths.append(path)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, of ``row_bytes`` each, may be broadcast. Counts at most the bound's rows plus one."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def appended(spark: SparkSession, parts: Iterator[DataFrame], schema: str, name: str = "parts") -> DataFrame:
    """The rows of all parts, each written before the next is asked for."""
    path = f"{shared_dir(spark)}/kinfold/{name}-{uuid.uuid4().hex}"
    _written.paths.append(path)
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: A key of more than one in so many of all rows is met by broadcast: there are fewer than so many of these keys, at any size.
HOT_KEYS = 4096


def beside_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with what ``groups`` has of their keys; rows of no group go. ``groups`` has one row a key, and in ``size`` how many
    rows have the key. The few largest are met by broadcast and split as rows lie; no other holds more than a small share
    of a shuffle. Both are read more than once: give written tables. Keys aren't null."""
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    cut = total // HOT_KEYS
    hot = groups.filter(F.col(size) > cut)  # fewer than HOT_KEYS, since their sizes add up to no more than the total
    if total < HOT_KEYS:
        return rows.join(F.broadcast(hot), keys)
    large = rows.join(F.broadcast(hot), keys)
    return large.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col(size) <= cut), keys))


_kept: list[Callable[[], None]] = []
_holder: str | None = None


def frees(clear: Callable[[], None]) -> None:
    """``clear`` frees what a worker keeps between batches and tasks; it is called when another operator begins there."""
    _kept.append(clear)


def _held_by(holder: str) -> None:
    global _holder
    if holder != _holder:
        for clear in _kept:
            clear()
        _holder = holder


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, holder: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold about ``limit`` bytes of ``column`` at most, one row at least. ``holder`` names whose results the worker may keep."""
    import numpy as np

    _held_by(holder)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def map_text(df: DataFrame, text: str, keep: list[str], schema: str, work: Callable[[list], list], cast: str = "string") -> DataFrame:
    """Columns ``keep`` and what ``work`` makes of ``text``: it takes a list of strings or nulls and returns a list of Arrow arrays or Python lists, one for each field of ``schema``. Only these columns are read. A column of the input with the name of a new one isn't carried: the new one stands."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = _schema(df, schema)
    keep = [c for c in keep if c.lower() not in {f.name.lower() for f in fields}]
    # what is kept goes through as one column, so that none of its names meets another
    frame = df.select(*kept(keep), F.col(f"`{text}`").cast(cast).alias("text"))
    out = frame.drop("text").schema
    for f in fields:
        out = out.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(StructType(list(fields)))
        gc.set_threshold(200_000, 20, 50)  # what workers keep has no cycles, and going through it costs
        for b in slices(batches, "text", holder=work.__module__):
            made = work(b.column(b.num_columns - 1).to_pylist())
            made = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)]
            made = [x.cast(f.type) if x.type != f.type else x for x, f in zip(made, arrow, strict=True)]
            own = [b.schema.field(0)] if b.num_columns > 1 else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], schema=pa.schema([*own, *arrow]))

    return unpacked(frame.mapInArrow(run, out), keep, [f.name for f in fields])


def kept(keep: list[str]) -> list:
    """The columns of ``keep`` as one, of a name that no operator gives; none if there are none."""
    return [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept__")] if keep else []


def unpacked(df: DataFrame, keep: list[str], new: list[str]) -> DataFrame:
    """The columns that ``kept`` put together, and ``new``."""
    return df.select(*[F.col("kept__").getField(c).alias(c) for c in keep], *new)


def _schema(df: DataFrame, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
