"""Splits, folds, pairs and triples, by arithmetic on ids, so that every engine draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.ordering import with_running


#: Fixed values, which SQL repeats: a prime, and for each of two mixes the factors of both halves of the id, an addend and two more factors.
PRIME = 2147483647
MIXES = ((1103515245, 805306457, 12345, 1597334677, 1431655781), (1540483477, 1181783497, 54321, 1640531513, 1013904223))


#: Bands that each side of a forum's pairs is cut into: tasks meet one band of each, and a row is moved as often as there are bands.
BANDS = 8
#: People of a side in one array at most. The other side's person meets them in a row, so that rows come in short runs, which files encode in few bytes.
TILE = 256


def _mix(id_: Column, a: int, b: int, c: int, d: int, e: int) -> Column:
    p = F.lit(PRIME).cast("long")
    x = (F.pmod(id_.bitwiseAND(F.lit(4294967295).cast("long")), p) * F.lit(a).cast("long") + F.pmod(F.shiftright(id_, 32), p) * F.lit(b).cast("long") + F.lit(c)) % p
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(d).cast("long")) % p
    return (x.bitwiseXOR(F.shiftright(x, 13)) * F.lit(e).cast("long")) % p


def scrambled(id_: Column, modulus: int = 1000) -> Column:
    """A number below the modulus that follows no pattern of ids, mixed from all 64 bits of the id to 62 bits."""
    x = id_.cast("long")
    return (_mix(x, *MIXES[0]) * F.lit(PRIME + 1).cast("long") + _mix(x, *MIXES[1])) % F.lit(modulus).cast("long")


def _round_keys(key: int, rounds: int = 4) -> list[tuple[int, int]]:
    """Factors and addends below the prime, by a linear congruence from the key."""
    made, x = [], key * 2 + 1
    for _ in range(rounds):
        x, y = x * 48271 % PRIME, x * 69621 % PRIME
        made.append((x | 1 << 29, y))
        x = (x + y) % PRIME or 1
    return made


def permuted(place: Column, n: int, key: int = 1) -> Column:
    """A bijection of the numbers below n under a key: each place has a new one, by arithmetic on it alone.

    The place is written as two digits, to each of which a number made of the other is added in turn (a Feistel network);
    there are less than sqrt(n) numbers of two digits beyond n, and what comes to one of these goes on until it is below n.
    """
    if n < 2:
        return place.cast("long")
    low = math.isqrt(n - 1) + 1
    high = -(-n // low)

    def once(x: Column) -> Column:
        left, right = F.floor((x - x % F.lit(low)) / F.lit(low)).cast("long"), x % F.lit(low)
        for i, (a, b) in enumerate(_round_keys(key)):
            of = lambda y: (y * F.lit(a).cast("long") + F.lit(b)) % F.lit(PRIME).cast("long")  # noqa: B023, E731
            if i % 2:
                right = (right + of(left)) % F.lit(low)
            else:
                left = (left + of(right)) % F.lit(high)
        return left * F.lit(low) + right

    beyond = low * high - n
    first = once(place.cast("long"))
    if not beyond:
        return first
    # as many steps as there are numbers beyond n surely do; past 64 there are so few of them that none stays
    steps = F.sequence(F.lit(1), F.lit(min(beyond, 64)))
    return F.aggregate(steps, first, lambda x, _: F.when(x >= n, once(x)).otherwise(x))


def with_places(rows: DataFrame, id_: str, key: int = 1, name: str = "place") -> tuple[DataFrame, int]:
    """Adds a place from 0 that follows no pattern of ids, each once, and says how many there are. Ids tell rows apart; no task sorts all rows."""
    n = rows.count()
    return with_running(rows, [F.col(id_)], {name: F.lit(1)}).withColumn(name, permuted(F.col(name) - 1, n, key)), n


def split(ids: DataFrame, id_: str, shares: dict[str, float], key: int = 1) -> DataFrame:
    """Adds part: names in order, each with its share of the rows, cut at whole numbers of rows (rounded down); the last has the rest."""
    placed, n = with_places(ids, id_, key, "place__")
    made, at = None, 0.0
    for name, share in list(shares.items())[:-1]:
        at = round(at + share, 9)
        test = F.col("place__") < math.floor(at * n)
        made = F.when(test, F.lit(name)) if made is None else made.when(test, F.lit(name))
    last = F.lit(list(shares)[-1])
    return placed.withColumn("part", last if made is None else made.otherwise(last)).drop("place__")


def folds(ids: DataFrame, id_: str, k: int) -> DataFrame:
    """Adds fold by the id alone."""
    return ids.withColumn("fold", scrambled(F.col(id_), k * 1009) % k)


def even_folds(ids: DataFrame, id_: str, k: int, key: int = 1) -> DataFrame:
    """Adds fold: k folds whose sizes differ by one at most."""
    return with_places(ids, id_, key, "fold")[0].withColumn("fold", F.col("fold") % k)


def modulo_partition(ids: DataFrame, id_: str, n: int, p: int) -> DataFrame:
    """Rows whose place by id, from 0, leaves p modulo n. Places come from counts of ranges, not from one sorted task."""
    placed = with_running(ids, [F.col(id_)], {"place": F.lit(1)}).withColumn("place", F.col("place") - 1)
    return placed.filter(F.col("place") % n == p)


def bid_sets(bids: DataFrame, positive: list[str], forum: str = "forum", who: str = "who", tag: str = "tag") -> DataFrame:
    """forum, positives, negatives: distinct people, in order; one may be in both."""
    pos = F.col(tag).isin(positive)
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(who))))
    return bids.groupBy(forum).agg(some(pos).alias("positives"), some(~pos).alias("negatives"))


def bid_labels(bids: DataFrame, positive: list[str], forum: str = "forum", who: str = "who", tag: str = "tag") -> DataFrame:
    return bids.select(forum, who, F.when(F.col(tag).isin(positive), 1).otherwise(0).alias("label")).distinct()


def bpr_triples(bids: DataFrame, positive: list[str], having: DataFrame, forum: str = "forum", who: str = "who", tag: str = "tag") -> DataFrame:
    """forum, pos, neg: everyone with a positive bid beside everyone without one; all three must be in ``having`` (people with keyphrases)."""
    labelled = bid_labels(bids, positive, forum, who, tag).join(having, who, "left_semi")
    every = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    # each side is in one band of its own and in all of the other's; the number of partitions is given, so that few bytes which make many rows aren't put together
    n = max(BANDS, int(bids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [forum, "row__", "column__"]
    pos = _tiles(labelled.filter("label = 1"), forum, who, "row__", "pos").withColumn("column__", every).repartition(n, *keys)
    neg = _tiles(labelled.filter("label = 0"), forum, who, "column__", "neg").withColumn("row__", every).repartition(n, *keys)
    # a higher-order function isn't compiled into the join, so pairs of tiles are taken apart one after the other and few rows are held
    met = pos.join(neg.hint("merge"), keys).select(forum, F.inline(F.transform("pos", lambda p: F.struct(p.alias("pos"), F.col("neg").alias("neg")))))
    return met.select(forum, "pos", F.explode("neg").alias("neg")).filter("pos <> neg")


def _tiles(people: DataFrame, forum: str, who: str, band: str, name: str) -> DataFrame:
    """forum, band, and by ``name`` up to TILE of the forum's people in the band."""
    banded = people.select(forum, F.col(who).alias(name), F.pmod(F.xxhash64(who), F.lit(BANDS)).cast("int").alias(band))
    place = F.row_number().over(Window.partitionBy(forum, band).orderBy(name)) - 1
    return banded.withColumn("tile__", F.floor(place / TILE)).groupBy(forum, band, "tile__").agg(F.collect_list(name).alias(name)).drop("tile__")


def negatives(rows: DataFrame, id_: str, group: str, how: str = "uniform", among: DataFrame | None = None) -> DataFrame:
    """Adds neg: another group than the row's own, null where there is none. uniform: each of the others as likely, by the
    row's id; rotate: the next in order; shuffle: the next in an order that follows no pattern; paper_uniform: the group
    of a row of another group, each such row as likely. Groups are those of ``among``, or of the rows, which ids tell apart.

    Groups and rows have places, counted in ranges; what is drawn is a place, and whose it is comes from a join by place.
    """
    known = (rows if among is None else among).filter(F.col(group).isNotNull())
    groups = known.groupBy(group).agg(F.count("*").alias("rows__"))
    order = [F.col(group)] if how != "shuffle" else [scrambled(F.conv(F.substring(F.md5(F.col(group).cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), 1 << 61), F.col(group)]
    placed = with_running(groups, order, {"at__": F.lit(1), "upto__": F.col("rows__")}).withColumn("at__", F.col("at__") - 1).withColumn("first__", F.col("upto__") - F.col("rows__"))
    sizes = groups.agg(F.count("*").alias("n__"), F.sum("rows__").alias("all__"))
    tagged = rows.join(placed.withColumnRenamed("at__", "own__").drop("upto__"), group, "left").crossJoin(F.broadcast(sizes))  # one row
    if how == "paper_uniform":
        # the places of rows of other groups are one stretch once the own group's are left out
        pick = scrambled(F.col(id_), 1_000_000_007) % F.nullif(F.col("all__") - F.col("rows__"), F.lit(0))
        tagged = tagged.withColumn("at__", pick + F.when(pick >= F.col("first__"), F.col("rows__")).otherwise(0))
        other = with_running(known.select(F.col(group).alias("neg"), F.col(id_).alias("id__")), [F.col("neg"), F.col("id__")], {"at__": F.lit(1)})
        return tagged.join(other.select("neg", (F.col("at__") - 1).alias("at__")), "at__", "left").select(*rows.columns, "neg")
    others = F.nullif(F.col("n__") - 1, F.lit(0))
    step = (scrambled(F.col(id_), 1_000_000_007) % others if how == "uniform" else F.when(others.isNotNull(), F.lit(0))) + 1
    tagged = tagged.withColumn("at__", (F.col("own__") + step) % F.col("n__"))
    return tagged.join(placed.select(F.col(group).alias("neg"), "at__"), "at__", "left").select(*rows.columns, "neg")


def heldout_pairs(papers: DataFrame, author: str, id_: str, holdouts: int = 1) -> DataFrame:
    """author, held, other: each author's first papers beside each of the others of that author."""
    w = Window.partitionBy(author).orderBy(id_)
    r = papers.select(author, id_, F.row_number().over(w).alias("r"))
    held = r.filter(F.col("r") <= holdouts).select(author, F.col(id_).alias("held"))
    return held.join(r.select(author, F.col(id_).alias("other")), author).filter("held <> other")


def heldout_triples(papers: DataFrame, author: str, id_: str) -> DataFrame:
    """author, held, other, neg: every paper held out beside each other one of its author, and another author, each of them
    as likely, by both papers' ids. neg is null where there is no other author; papers without author are left out."""
    named = papers.filter(F.col(author).isNotNull())
    pairs = named.select(author, F.col(id_).alias("held")).join(named.select(author, F.col(id_).alias("other")), author).filter("held <> other")
    keyed = pairs.withColumn("pair__", F.col("held") * 7919 + F.col("other"))
    return negatives(keyed, "pair__", author, "uniform", among=named).drop("pair__")


def union_labels(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row for equal features, with the labels of all, in order."""
    return rows.groupBy(*features).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def chunked(rows: DataFrame, items: str, size: int) -> DataFrame:
    """A row for each run of ``size`` items."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(size))
    return rows.withColumn("at__", F.explode(starts)).withColumn(items, F.slice(F.col(items), F.col("at__") + 1, F.lit(size))).drop("at__")


def shuffled(rows: DataFrame, id_: str, piles: int, key: int = 1) -> DataFrame:
    """Adds pile and place (from 1): rows are dealt to piles whose sizes differ by one at most, in an order that follows no pattern of ids. Neither is sorted for."""
    placed, _ = with_places(rows, id_, key)
    return placed.withColumn("pile", F.col("place") % piles).withColumn("place", F.floor(F.col("place") / piles).cast("long") + 1)


def subsample(rows: DataFrame, id_: str, share: float, modulus: int = 1000) -> DataFrame:
    """The rows whose scrambled id lies below the share."""
    return rows.filter(scrambled(F.col(id_), modulus) < F.lit(round(share * modulus)))


def inverse_frequency(counts: DataFrame, n: str) -> DataFrame:
    """Adds w: one over the count, by the mean of all such; 0 where there is no count."""
    one = F.when(F.col(n) > 0, 1.0 / F.col(n))
    mean = counts.agg(F.avg(one).alias("mean__"))
    return counts.join(F.broadcast(mean)).withColumn("w", F.coalesce(one / F.col("mean__"), F.lit(0.0))).drop("mean__")
