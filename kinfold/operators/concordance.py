"""Pairs of a person's items in wrong order, counted and weighed without making them.

Items are cut by score into the same ranges for all people, so that nobody's items need one task. Pairs within a range
are counted there; pairs across ranges follow from how many items of each gold a range has. Both counts run over items in
order of score, golds being taken bit by bit: at each bit, items of one node that have it and come before items without it
are out of order. That is n log n, for all people of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.ordering import range_of

#: A pair is easy with one gold of HIGH or more and one of LOW or less, hard with both of HIGH or more.
HIGH, LOW = 4.0, 2.0


def out_of_order(group: np.ndarray, gold: np.ndarray, times: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """By group: the number of pairs whose first has the greater gold, and the sum of what it is greater by. Items are in order
    within their group, groups ascending; ``times`` says how often an item counts."""
    rank = np.unique(gold, return_inverse=True)[1].reshape(-1)
    order = np.arange(len(gold))
    node = group.astype(np.int64)
    count, excess = np.zeros(len(gold)), np.zeros(len(gold))
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        has = (rank[order] >> bit) & 1
        start = np.flatnonzero(np.diff(node[order], prepend=-1))
        length = np.diff(np.append(start, len(order)))
        weight = times[order] * has
        before = [np.concatenate([[0.0], np.cumsum(x)[:-1]]) for x in (weight, weight * gold[order])]
        n, total = (x - np.repeat(x[start], length) for x in before)
        lacks = has == 0
        at = order[lacks]
        count[at] += times[at] * n[lacks]
        excess[at] += times[at] * (total[lacks] - gold[at] * n[lacks])
        node[order] = 2 * node[order] + has
        order = order[np.argsort(node[order], kind="stable")]
    return np.bincount(group, count, groups), np.bincount(group, excess, groups)


def apart(group: np.ndarray, gold: np.ndarray, times: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """By group: the number of pairs of different golds, and the sum of their differences."""
    order = np.lexsort((-gold, group))
    return out_of_order(group[order], gold[order], times[order], groups)


def _kinds(gold: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """What each measure counts: name, which items, and their golds for it."""
    ends = (gold >= HIGH) | (gold <= LOW)
    return [("loss", np.ones(len(gold), bool), gold), ("easy", ends, (gold >= HIGH).astype(float)), ("hard", gold >= HIGH, gold)]


def _measured(who: np.ndarray, s: np.ndarray, gold: np.ndarray, times: np.ndarray, people: int, level: float, whole: bool) -> dict[str, np.ndarray]:
    """By person the sums of wrong pairs; those of equal ``s`` count by ``level`` to the loss, and if that isn't 0 whole to the others. ``whole``: of all pairs too."""
    order = np.lexsort((gold, s, who))  # among equal scores golds ascend, so they are never out of order
    who, s, gold, times = who[order], s[order], gold[order], times[order]
    tied = np.cumsum(np.append(False, (who[1:] != who[:-1]) | (s[1:] != s[:-1]))[: len(who)])
    made = {}
    for name, some, value in _kinds(gold):
        w, v, t = who[some], value[some], times[some]
        of = 1 if name == "loss" else 0
        wrong = out_of_order(w, v, t, people)[of]
        if level:
            same = apart(tied[some], v, t, int(tied[-1]) + 1)[of] if len(tied) else np.zeros(0)
            owner = np.zeros(len(same), np.int64)
            owner[tied] = who
            wrong = wrong + np.bincount(owner, same, people) * (level if name == "loss" else 1.0)
        made[f"{name}_w"] = wrong
        made[f"{name}_d"] = apart(w, v, t, people)[of] if whole else np.zeros(people)
    return made


_SUMS = ("loss_w", "loss_d", "easy_w", "easy_d", "hard_w", "hard_d")


def _by_group(rows: DataFrame, keys: list[str], level: float, whole: bool) -> DataFrame:
    """Rows of who, keys, s, gold, times, those of a key together: the sums by person and key."""
    kind = rows.schema["who"].dataType.simpleString()
    lone = len(keys) > 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            key = np.zeros(part.num_rows, np.int64)
            for k in keys:
                code = np.asarray(part[k].combine_chunks().dictionary_encode().indices).astype(np.int64)
                key = np.cumsum(np.append(False, (code[1:] != code[:-1]) | (key[1:] != key[:-1]))[: len(code)]) if len(code) else key
            first = np.flatnonzero(np.diff(key, prepend=-1))
            s, gold, times = (np.asarray(part[c].combine_chunks().cast(pa.float64())) for c in ("s", "gold", "times"))
            sums = _measured(key, s, gold, times, len(first), level, whole)
            return pa.RecordBatch.from_arrays([part["who"].combine_chunks().take(pa.array(first)), *[pa.array(sums[c]) for c in _SUMS]], names=["who", *_SUMS])

        for b in batches:
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            if not held.num_rows:
                continue
            last = [held[k][held.num_rows - 1] for k in keys]
            # the last key may go on in the next batch
            same = np.ones(held.num_rows, bool)
            for k, v in zip(keys, last, strict=True):
                same &= np.asarray(pa.compute.equal(held[k], v))
            cut = int(np.argmax(same))
            if cut:
                yield made(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield made(held)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys) if lone else rows.repartition("who").sortWithinPartitions("who")
    return dealt.select("who", *[k for k in keys if k != "who"], "s", "gold", "times").mapInArrow(work, f"who {kind}, {', '.join(f'{c} double' for c in _SUMS)}")


def gold_sums(rows: DataFrame, who: str = "who", gold: str = "gold", s: str = "s", parts: int | None = None, bounds: list[float] | None = None) -> DataFrame:
    """who, and numerators and denominators over the person's pairs: loss (the gold difference of pairs in wrong order, of
    equal scores by half, over that of all), easy and hard (pairs of different golds in right order, equal scores being
    wrong, over all such). Items without gold or score, and people without a pair of different golds, are left out. ``bounds``
    part the scores where they are known to lie, in place of a sample's."""
    slim = rows.select(F.col(who).alias("who"), F.col(gold).cast("double").alias("gold"), F.col(s).cast("double").alias("s")).filter("who is not null and gold is not null and s is not null")
    slim = slim.localCheckpoint(eager=False)  # scores are read for their ranges, within these and across, and made once
    at = range_of(slim, [F.col("s")], parts) if bounds is None else F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col("s")))
    ranged = slim.withColumn("range", at)
    within = _by_group(ranged.withColumn("times", F.lit(1.0)), ["who", "range"], 0.5, False)
    levels = ranged.groupBy("who", "range", "gold").agg(F.count("*").alias("times")).withColumn("s", F.col("range").cast("double"))
    across = _by_group(levels, ["who"], 0.0, True)
    both = within.union(across).groupBy(F.col("who").alias(who)).agg(*[F.sum(c).alias(c) for c in _SUMS]).filter("loss_d > 0")
    right = lambda x: (F.col(f"{x}_d") - F.col(f"{x}_w")).alias(f"{x}_n")
    return both.select(who, F.col("loss_w").alias("loss_n"), "loss_d", right("easy"), "easy_d", right("hard"), "hard_d")
