"""Exact duplicates by refinement: length, then the hash of a prefix, then the hash of the whole, by DataFrame functions alone.

Of each text the first scan takes only the length and the hash of its first characters, both of the normalised text.
Lengths that occur once are settled; among the others the prefix hashes are counted; and only texts whose length and
prefix both occur again are hashed whole, in a second scan. Which ones these are is told by bit maps of a fixed number
of bits, which are all that is broadcast: two keys on one bit cost a needless hash, never a wrong group, for groups are
by length, prefix hash and SHA-256 together.

Null texts count as empty, and empty ones are equal. Of equal texts the one with the most code points stays, then the
one with the least doc_id (null last), then the row that comes first; so of repeated rows one stays. Rows without doc_id
are documents too. Other columns aren't read, so none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_groups, written

#: Code points of the normalised text that the prefix hash takes in.
PREFIX = 64
#: Bits of a map: so many rows of so many bits. Together 8 MB, at any size of the input.
MAP_ROWS, ROW_BITS = 2048, 32768
#: Characters that don't tell texts apart.
SPACES = " \t\n\x0b\x0c\r"


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _bit(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(MAP_ROWS * ROW_BITS).cast("long"))


def bit_map(keys: DataFrame) -> DataFrame:
    """row__, bits__: the bits of the keys, MAP_ROWS rows at most."""
    bit = _bit([F.col(c) for c in keys.columns])
    at = keys.select(F.floor(bit / ROW_BITS).cast("int").alias("row__"), F.pmod(bit, F.lit(ROW_BITS).cast("long")).alias("at__"))
    return at.groupBy("row__").agg(F.bitmap_construct_agg("at__").alias("bits__"))


def marked(rows: DataFrame, bits: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: whether the map has the keys' bit."""
    bit = _bit([F.col(c) for c in keys])
    beside = rows.withColumns({"row__": F.floor(bit / ROW_BITS).cast("int"), "at__": F.pmod(bit, F.lit(ROW_BITS).cast("long")).cast("int")})
    beside = beside.join(F.broadcast(bits), "row__", "left")  # MAP_ROWS rows of 4 KB at most
    byte = F.ascii(F.decode(F.substring("bits__", F.floor(F.col("at__") / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    mask = F.pow(F.lit(2), F.col("at__") % 8).cast("int")
    return beside.withColumn(name, F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).drop("row__", "at__", "bits__")


def duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", normal: Callable[[Column], Column] = without_spaces, all_digests: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha256 of every row. sha256 is of the normalised text, null where length or
    prefix had told the text apart already; ``all_digests`` fills these too, for those who want them, without use for
    the groups."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    taken = docs.select(F.col(f"`{doc_id}`").alias("id__"), F.length(whole).alias("size__"), normal(whole).alias("text__"))
    key = [F.octet_length("text__").alias("bytes__"), F.xxhash64(F.substring("text__", 1, PREFIX)).alias("head__")]
    short = written(taken.select(*key), "lengths")

    lengths = short.groupBy("bytes__").agg(F.count("*").alias("n")).filter("n > 1").select("bytes__")
    again = marked(short, written(bit_map(lengths), "bits"), ["bytes__"], "again__").filter("again__")
    heads = again.groupBy("bytes__", "head__").agg(F.count("*").alias("n")).filter("n > 1").select("bytes__", "head__")

    rows = taken.select("id__", "size__", "text__", *key, F.monotonically_increasing_id().alias("at"))
    rows = marked(rows, written(bit_map(heads), "bits"), ["bytes__", "head__"], "alike")
    digest = F.sha2(F.col("text__"), 256)
    rows = rows.select("id__", "size__", "at", "bytes__", "head__", "alike", (digest if all_digests else F.when(F.col("alike"), digest)).alias("sha256"))
    rows = written(rows, "hashed")

    same = ["bytes__", "head__", "sha256"]
    best = F.min(F.struct((-F.col("size__")).alias("s"), F.col("id__").isNull().alias("none"), F.col("id__").alias("id"), F.col("at").alias("row")))
    alike = rows.filter("alike")
    groups = written(alike.groupBy(*same).agg(F.count("*").alias("group_size"), best.alias("best__")).select(*same, "group_size", F.col("best__.id").alias("keep_id"), F.col("best__.row").alias("keep_row")), "groups")
    joined = beside_groups(alike, groups, same, "group_size").withColumn("kept", F.col("at") == F.col("keep_row"))
    alone = rows.filter("not alike").select("id__", F.col("id__").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha256")
    return joined.select("id__", "keep_id", "group_size", "kept", "sha256").union(alone).withColumnRenamed("id__", doc_id)
