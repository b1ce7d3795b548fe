"""The trie of conversations' prefixes, by chained digests.

A turn is a digest of its role and text; the digest of a prefix is that of the prefix before it and its last turn. Every
conversation gives a row for each of its prefixes, from the empty one; rows of one depth and digest are a node. Texts go
no further than the first scan. Sums over subtrees: each node belongs to the conversation of least id that has it. What
a conversation's own nodes bring is summed from its end upwards and given to every node of its path, its own and those
above that are others', and these parts are summed by node; so there are as many parts as prefixes, however deep the trie.

Turns go by number, null first, equal ones by role, then by the digest of their text; repeated rows are turns of their
own. Null roles and texts count as empty. Rows without conv_id take no part. A conversation without turns is a member of
the root alone. The turns of one conversation meet in one task, as some 60 bytes each; no table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside_groups, written

#: The digest of the empty prefix, and of no text at all.
ROOT = hashlib.sha256(b"").digest()
#: Ids from one multiple of this to the next are put in order together before an ends' digest streams through them.
ID_RANGE = 4096
_OUT = 32_768


def turn_lists(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", near: Column | None = None) -> DataFrame:
    """near, conv_id, turns: each conversation's turns in order, as structs of digest and n (code points of the text). ``near`` (of conv_id) deals conversations out."""
    whole = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    named = F.concat(F.octet_length(whole[0]).cast("string"), F.lit(":"), *whole)  # no two pairs give one string
    slim = rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), whole[0].alias("role"), F.unhex(F.sha2(whole[1], 256)).alias("order"), F.unhex(F.sha2(named, 256)).alias("digest"), F.length(whole[1]).cast("long").alias("n"))
    slim = slim.filter("conv_id is not null").withColumn("near", F.col("conv_id") if near is None else near).repartition("near")
    listed = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "role", "order", "digest", "n")))
    return slim.groupBy("near", "conv_id").agg(F.transform(listed, lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n"))).alias("turns"))


def grafted(rows: DataFrame, every: int, lead: Column, most: int, **names: str) -> DataFrame:
    """conv_id, turns: the first ``lead`` (of conv_id, at most ``most``) turns of the conversation at the multiple of ``every`` below, then the conversation's own after its first ``lead``."""
    convs = turn_lists(rows, near=F.col("conv_id") - F.col("conv_id") % every, **names)
    heads = convs.filter(F.col("conv_id") == F.col("near")).select("near", F.slice("turns", 1, most).alias("heads"))
    both = convs.join(heads, "near", "left").withColumn("lead", lead)
    own = F.slice("turns", F.col("lead") + 1, F.greatest(F.size("turns"), F.lit(1)))
    before = F.slice(F.coalesce("heads", F.slice("turns", 1, 0)), F.lit(1), F.col("lead"))
    return both.select("conv_id", F.concat(before, own).alias("turns"))


def prefixes(convs: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent, n, last: a row for each prefix of each conversation's turns, the empty one first; ``last`` where it is the whole."""
    schema = "conv_id long, depth long, digest binary, parent binary, n long, last boolean"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(6)]

        def full() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["conv_id", "depth", "digest", "parent", "n", "last"])
            for x in columns:
                x.clear()
            return made

        for b in batches:
            ids, lists = b.column(0).to_pylist(), b.column(1)
            digests, sizes = lists.values.field(0), lists.values.field(1)
            ends = lists.offsets.to_pylist()
            for at, conv in enumerate(ids):
                here, above = ROOT, None
                for depth, k in enumerate(range(ends[at] - 1, ends[at + 1])):
                    n = 0
                    if depth:
                        above, n = here, sizes[k].as_py()
                        here = hashlib.sha256(here + digests[k].as_py()).digest()
                    for x, value in zip(columns, (conv, depth, here, above, n, k == ends[at + 1] - 1), strict=True):
                        x.append(value)
                    if len(columns[0]) >= _OUT:
                        yield full()
        if columns[0]:
            yield full()

    return convs.select("conv_id", "turns").mapInArrow(chain, schema)


def _ends(of: DataFrame) -> DataFrame:
    """digest, ends_sha256: of the decimal ids of the conversations that end at a node, ascending, joined by commas. Ranges of ids are put in order apart; the hash streams through a node's ranges and holds none of them."""
    ranges = of.filter("last").groupBy("digest", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # at most ID_RANGE ids
    text = ranges.select("digest", "range", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for b in batches:
            done: tuple[list, list] = ([], [])
            for digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest != now:
                    if now is not None:
                        done[0].append(now)
                        done[1].append(state.hexdigest())
                    now, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["digest", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["digest", "ends_sha256"])

    return text.repartition("digest").sortWithinPartitions("digest", "range").select("digest", "text").mapInArrow(stream, "digest binary, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``convs`` (conv_id, turns; conv_id tells them apart): digest, depth, conv_id (the
    least member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    of = written(prefixes(convs), "prefixes")
    # parent and n are the same for equal digests
    nodes = written(of.groupBy("depth", "digest", "parent", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    path = of.select("conv_id", "depth", "digest", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    parts = path.union(own).withColumns({"leaf": F.sum("leaf").over(upwards), "saved": F.sum("saved").over(upwards)}).filter("digest is not null and (leaf > 0 or saved > 0)")
    sums = parts.groupBy("digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parents = nodes.filter("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size__"))
    below = beside_groups(nodes.filter("depth > 0"), parents, ["parent"], "size__")
    root = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    names = ["digest", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children"]
    whole = below.select(*names).union(root.select(*names)).join(sums, "digest").join(_ends(of), "digest", "left")
    return whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(ROOT.hex())))
