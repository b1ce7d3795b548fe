"""Ranking metrics over (query, item, score, label) rows and gold-standard losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.concordance import gold_sums
from kinfold.operators.ordering import with_running


def average_precision(rows: DataFrame, q: str = "q", s: str = "s", label: str = "label") -> DataFrame:
    """q, ap for queries with a positive; equal scores count as one step."""
    w = Window.partitionBy(q).orderBy(F.desc(s))
    stepped = rows.withColumn("cp", F.sum(label).over(w)).withColumn("cn", F.count("*").over(w))
    return stepped.groupBy(q).agg(F.sum(F.when(F.col(label) == 1, F.col("cp") / F.col("cn")).otherwise(0.0)).alias("a"), F.sum(label).alias("p")).filter("p > 0").select(q, (F.col("a") / F.col("p")).alias("ap"))


def ranked(rows: DataFrame, q: str | None, s: str, tie: str) -> DataFrame:
    """Adds rk, the place by score, then by ``tie``; over all rows where ``q`` is None."""
    if q is None:
        return with_running(rows, [F.col(s).isNull(), -F.col(s), F.col(tie)], {"rk": F.lit(1)})
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy(q).orderBy(F.desc(s), tie)))


def hits_at(rows: DataFrame, k: int, q: str = "q", s: str = "s", label: str = "label", tie: str = "item") -> DataFrame:
    """q, hits: positives among the k best over min(k, positives); queries without a positive are left out."""
    got = ranked(rows, q, s, tie).groupBy(q).agg(F.sum(F.when(F.col("rk") <= k, F.col(label)).otherwise(0)).alias("h"), F.sum(label).alias("p"))
    return got.filter("p > 0").select(q, (F.col("h") / F.least(F.lit(k), F.col("p"))).alias("hits"))


def recall_at(rows: DataFrame, most: int, q: str = "q", s: str = "s", label: str = "label", tie: str = "item") -> DataFrame:
    """m, recall: the mean over queries of the share of positives among the m best, for m from 0 to most - 1; 1 where a query has none."""
    r = ranked(rows, q, s, tie)
    per = r.groupBy(q).agg(F.sum(label).alias("p"), F.collect_list(F.when((F.col(label) == 1) & (F.col("rk") < most), F.col("rk"))).alias("at"))
    each = per.select(q, "p", "at", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("m"))
    value = F.when(F.col("p") == 0, 1.0).otherwise(F.size(F.filter("at", lambda x: x <= F.col("m"))) / F.col("p"))
    return each.groupBy("m").agg(F.avg(value).alias("recall"))


def precision_at(rows: DataFrame, most: int, s: str = "s", label: str = "label", tie: str = "item") -> DataFrame:
    """m, precision of one pooled ranking for m from 1 to most."""
    top = rows.orderBy(F.desc(s), tie).limit(most)
    w = Window.orderBy(F.desc(s), tie)
    return top.select(F.row_number().over(w).alias("m"), F.col(label).alias("l")).select("m", (F.sum("l").over(Window.orderBy("m")) / F.col("m")).alias("precision"))


def average_rank(rows: DataFrame, q: str, s: str) -> DataFrame:
    """Adds avg_rank: equal scores share the mean of their places."""
    w, same = Window.partitionBy(q).orderBy(F.desc(s)), Window.partitionBy(q, s)
    return rows.withColumn("avg_rank", F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0)


def pairwise_loss(rows: DataFrame, who: str = "who", gold: str = "gold", s: str = "s") -> DataFrame:
    """One row, loss: over pairs of items of one person, the gold difference of pairs in wrong order (ties by half) over that of all."""
    return gold_parts(rows, who, gold, s).agg((F.sum("loss_n") / F.sum("loss_d")).alias("loss"))


def easy_hard(rows: DataFrame, who: str = "who", gold: str = "gold", s: str = "s") -> DataFrame:
    """kind, accuracy, n: pairs told apart; easy: one gold of 4 and more and one of 2 and less; hard: both of 4 and more. Equal golds are left out, equal scores are wrong."""
    sums = gold_parts(rows, who, gold, s).agg(*[F.sum(f"{k}_{x}").alias(f"{k}_{x}") for k in ("easy", "hard") for x in "nd"])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_n").alias("right"), F.col(f"{k}_d").alias("n")) for k in ("easy", "hard")]))
    return sums.select(kinds.alias("x")).select("x.*").filter("n > 0").select("kind", (F.col("right") / F.col("n")).alias("accuracy"), F.col("n").cast("long").alias("n"))


def ranking_metrics(rows: DataFrame, ks: list[int], q: str = "q", s: str = "s", label: str = "label", tie: str = "item") -> DataFrame:
    """One row: map, ndcg, best_f1 (means over queries with a positive) and recall at each k."""
    r = ranked(rows, q, s, tie).withColumn("tp", F.sum(label).over(Window.partitionBy(q).orderBy("rk")))
    total = F.sum(label).over(Window.partitionBy(q))
    r = r.withColumn("p", total).filter("p > 0")
    gain = F.when(F.col(label) == 1, 1 / F.log2(F.col("rk") + 1.0)).otherwise(0.0)
    ideal = F.when(F.col("rk") <= F.col("p"), 1 / F.log2(F.col("rk") + 1.0)).otherwise(0.0)
    per = r.groupBy(q).agg(
        (F.sum(F.when(F.col(label) == 1, F.col("tp") / F.col("rk")).otherwise(0.0)) / F.max("p")).alias("ap"),
        (F.sum(gain) / F.sum(ideal)).alias("ndcg"),
        F.max(2 * F.col("tp") / (F.col("rk") + F.col("p"))).alias("f1"),
        *[(F.sum(F.when(F.col("rk") <= k, F.col(label)).otherwise(0)) / F.max("p")).alias(f"r{k}") for k in ks],
    )
    return per.agg(F.avg("ap").alias("map"), F.avg("ndcg").alias("ndcg"), F.avg("f1").alias("best_f1"), *[F.avg(f"r{k}").alias(f"recall_{k}") for k in ks])


def cutoffs(rows: DataFrame, ks: list[int], q: str = "q", s: str = "s", label: str = "label", tie: str = "item", weight: str | None = None) -> DataFrame:
    """q, auc, recall_k, and weighted_k where a weight column is named, for queries with a positive. With p positives among n
    items, a positive at place x after i others counts (n - x - (p - i - 1)) / (n - p + 1) to the area, of which the mean is taken."""
    w = Window.partitionBy(q)
    r = ranked(rows, q, s, tie).withColumns({"n": F.count("*").over(w), "p": F.sum(label).over(w), "i": F.sum(label).over(w.orderBy("rk")) - 1}).filter(F.col(label) == 1)
    share = (F.col("n") - F.col("rk") - (F.col("p") - F.col("i") - 1)) / (F.col("n") - F.col("p") + 1)
    found = [F.avg(share).alias("auc"), *[(F.sum(F.when(F.col("rk") <= k, 1).otherwise(0)) / F.max("p")).alias(f"recall_{k}") for k in ks]]
    if weight:
        found += [(F.sum(F.when(F.col("rk") <= k, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias(f"weighted_{k}") for k in ks]
    return r.groupBy(q).agg(*found)


def fold_means(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the mean over folds of each metric."""
    return folds.agg(*[F.avg(m).alias(m) for m in metrics])


def with_popularity(rows: DataFrame, item: str = "item", s: str = "s", label: str = "label") -> DataFrame:
    """One row: pearson, of items' mean label with their mean score, and deviation, their mean absolute difference."""
    each = rows.groupBy(item).agg(F.avg(label).alias("l"), F.avg(s).alias("m"))
    return each.agg(F.corr("l", "m").alias("pearson"), F.avg(F.abs(F.col("l") - F.col("m"))).alias("deviation"))


def gold_parts(rows: DataFrame, who: str = "who", gold: str = "gold", s: str = "s", bounds: list[float] | None = None) -> DataFrame:
    """who, and numerators and denominators of loss, easy and hard over the person's pairs, which aren't made."""
    return gold_sums(rows, who, gold, s, bounds=bounds)


def bootstrap(parts: DataFrame, who: str, names: list[str], draws: int = 1000) -> DataFrame:
    """name, low, high: the 2.5 and 97.5 percentiles of sum(name_n) / sum(name_d) over resamples of as many people as there
    are, with replacement. Who is picked is arithmetic on the draw and the pick, so that every engine resamples alike."""
    from kinfold.operators.sampling import scrambled

    parts = parts.localCheckpoint(eager=False)  # a row a person, read for places, their number and the sums
    people = with_running(parts, [F.col(who)], {"at": F.lit(1)}).withColumn("at", F.col("at") - 1)
    n = people.count()
    if not n:
        return people.sparkSession.createDataFrame([], "name string, low double, high double")
    # the picks of a draw are counted before they meet the people
    picks = people.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), (F.floor(scrambled(F.col("id") * 7 + 3, 1_000_000_007) / 64) % n).cast("int").alias("at"))
    times = picks.groupBy("draw", "at").agg(F.count("*").alias("t"))
    each = times.join(people, "at").groupBy("draw").agg(*[(F.sum(F.col("t") * F.col(f"{x}_n")) / F.nullif(F.sum(F.col("t") * F.col(f"{x}_d")), F.lit(0.0))).alias(x) for x in names])
    long = each.unpivot(["draw"], names, "name", "v")
    return long.groupBy("name").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))


def thresholds(rows: DataFrame, s: str = "s", label: str = "label") -> DataFrame:
    """By score: its positives l, positives and rows from it up (tp, k), and all positives and rows (p, all). As many rows as there are different scores."""
    g = rows.groupBy(s).agg(F.sum(label).alias("l"), F.count("*").alias("n"))
    total = rows.agg(F.sum(label).alias("p"), F.count("*").alias("all"))
    summed = with_running(g, [F.col(s).isNull(), -F.col(s)], {"tp": F.col("l"), "k": F.col("n")})
    return summed.join(F.broadcast(total)).select(s, "l", "p", "all", "tp", "k")


def pooled_precision(rows: DataFrame, s: str = "s", label: str = "label") -> DataFrame:
    """One row: average precision over the thresholds of all rows together."""
    return thresholds(rows, s, label).agg(F.sum(F.col("l") / F.col("p") * F.col("tp") / F.col("k")).alias("ap"))


def cross_validated(candidates: list[DataFrame], folds: int, who: str = "who") -> DataFrame:
    """fold, candidate, train, test: for each fold, the candidate (its place in the list, from 0) of least loss over the
    other folds' people, the first of equals, and its loss over both. Candidates are ``gold_parts``: their sums by fold
    are all that is compared, so no candidate is scored once a fold."""
    from kinfold.operators.sampling import folds as dealt

    parts = None
    for i, c in enumerate(candidates):
        one = dealt(c, who, folds).groupBy("fold").agg(F.sum("loss_n").alias("n"), F.sum("loss_d").alias("d")).withColumn("candidate", F.lit(i))
        parts = one if parts is None else parts.union(one)
    every = Window.partitionBy("candidate")
    share = lambda n, d: n / F.nullif(d, F.lit(0.0))
    losses = parts.select("fold", "candidate", share(F.sum("n").over(every) - F.col("n"), F.sum("d").over(every) - F.col("d")).alias("train"), share(F.col("n"), F.col("d")).alias("test"))
    best = F.row_number().over(Window.partitionBy("fold").orderBy(F.asc_nulls_last("train"), "candidate"))
    return losses.withColumn("r__", best).filter("r__ = 1").drop("r__")


def overlap_correlation(pairs: DataFrame, wanted: str, found: str, s: str = "s") -> DataFrame:
    """One row, recall, precision, f1 and n: how scores, drawn to [0, 1] by the least and greatest of all that are finite, go with
    what the ``found`` subjects have of the ``wanted`` ones (Pearson)."""
    from kinfold.functions import overlap

    known = pairs.filter(F.col(s).isNotNull() & (F.abs(s) < float("inf")) & ~F.isnan(s))
    ends = known.agg(F.min(s).alias("low__"), F.max(s).alias("high__"))
    drawn = (F.col(s) - F.col("low__")) / F.nullif(F.col("high__") - F.col("low__"), F.lit(0.0))
    shares = overlap(F.col(found), F.col(wanted))
    each = known.crossJoin(F.broadcast(ends)).select(drawn.alias("s"), *[x.alias(n) for x, n in zip(shares, ("recall", "precision", "f1"), strict=True)])  # one row
    return each.agg(*[F.corr("s", n).alias(n) for n in ("recall", "precision", "f1")], F.count("s").alias("n"))
