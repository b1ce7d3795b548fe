"""Steps that used to grow faster than their input: what they give, and what leaves their tasks."""

import pytest
from pyspark.sql import functions as F

from kinfold.functions import rounded
from kinfold.operators import evaluation, postings, retrieval, sampling, scoring, topk


def test_pairs_of_one_forum_are_made_in_many_tasks(spark):
    bids = spark.createDataFrame([(1, who, "yes" if who % 3 else "no") for who in range(60)] + [(1, 7, "no"), (2, 1, "yes"), (2, 2, "no"), (3, 4, "yes")], "forum long, who long, tag string")
    having = spark.range(58).select(F.col("id").alias("who"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sampling.bpr_triples(bids, ["yes"], having).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    some = {(r.forum, r.who, r.tag) for r in bids.collect() if r.who < 58}
    want = sorted((f, a, b) for f, a, s in some for g, b, t in some if f == g and s == "yes" and t == "no" and a != b)
    assert sorted((r.forum, r.pos, r.neg) for r in got) == want
    assert len({r.task for r in got if r.forum == 1}) > 1


def test_pairs_of_a_forum_come_in_short_runs(spark, monkeypatch):
    from itertools import groupby

    monkeypatch.setattr(sampling, "TILE", 4, raising=False)
    bids = spark.createDataFrame([(f, f"p{who}", "yes" if who % 3 else "no") for f in (1, None) for who in range(300)] + [(1, "p1", "no"), (1, None, "no")], "forum long, who string, tag string")
    having = spark.range(300).select(F.concat(F.lit("p"), "id").alias("who"))
    got = sampling.bpr_triples(bids, ["yes"], having).withColumn("task", F.spark_partition_id()).collect()
    pos, neg = {f"p{i}" for i in range(300) if i % 3}, {f"p{i}" for i in range(300) if not i % 3} | {"p1"}
    assert sorted((r.forum, r.pos, r.neg) for r in got) == sorted((1, p, n) for p in pos for n in neg if p != n)
    assert len(list(groupby((r.task, r.pos) for r in got))) > len(got) / 5  # before, a person met all of a band's, twelve and more


def test_best_of_owners_leave_a_shard_as_a_row_each(spark):
    words = ["a b c", "a b", "c d", "a", "d d b", None, "x y", "a c d"]
    docs = spark.createDataFrame([(i, t, None if i % 5 == 4 else f"s{i % 3}") for i, t in enumerate(words)], "doc long, text string, source string")
    asked = docs.filter("doc % 2 = 0").select(F.col("doc").alias("q"), "text")
    scores = retrieval.bm25(docs, asked).filter("q <> doc").join(docs.select("doc", "source"), "doc").collect()
    want = {}
    for r in scores:
        want[r.q, r.source] = max(r.s, want.get((r.q, r.source), float("-inf")))
    for shard in (2, 100):
        got = postings.best_of_owners(docs, asked, shard=shard)
        assert {(r.q, r.source): r.s for r in got.collect()} == pytest.approx(want) and got.count() == len(want)
    assert postings.best_of_owners(docs.limit(0), asked).count() == 0


@pytest.mark.parametrize(("shared", "lines", "summed", "low"), [(256, 1024, 1 << 20, 1.0), (0, 1024, 3, 1.0), (1 << 40, 1024, 3, 1.0), (1 << 40, 2, 5, 0.0), (256, 1024, 1 << 20, -1.0)])
def test_all_queries_of_a_block_are_scored_in_one(spark, monkeypatch, shared, lines, summed, low):
    import numpy as np

    for name, value in (("SHARED", shared), ("LINES", lines), ("SUMMED", summed)):
        monkeypatch.setattr(postings, name, value)
    docs = spark.createDataFrame([(i, " ".join("abcdefgh"[i * k % 8] for k in range(i % 5)) + f" w{i % 7}", f"s{i % 3}") for i in range(40)], "doc long, text string, source string").coalesce(1)
    weights, cut, avgdl = postings.weighted_queries(docs, docs.select(F.col("doc").alias("q"), F.when(F.col("doc") > 3, F.col("text")).otherwise("none").alias("text")))
    # weights may be 0 or less, where a term is common
    weights = weights.withColumn("terms", F.transform("terms", lambda x: F.struct(x["term"].alias("term"), F.when(x["term"] == "a", F.least(x["w"], F.lit(low))).otherwise(x["w"]).alias("w"))))
    shards = postings._shards(cut.select(F.lit("o").alias("who"), "t", F.col("doc").alias("id")).crossJoin(F.broadcast(avgdl)), 16, 4)
    seen = 0
    for b in shards.crossJoin(postings._asked(weights)).toArrow().to_batches():
        for k in range(b.num_rows):
            m = postings.Meeting(b, k)
            want = np.stack([m.hits(*m.pieces(i)) for i in range(len(m.ids))])
            got = m.every_hit()
            assert (np.isinf(got) == np.isinf(want)).all() and np.allclose(np.maximum(got, -9), np.maximum(want, -9), rtol=0, atol=1e-12)
            seen += got.size
    assert seen == 36 * 40


def test_a_shard_is_moved_to_many_queries_at_once(spark):
    docs = spark.createDataFrame([(i, f"a w{i}", "s") for i in range(1200)], "doc long, text string, source string")
    weights, _, _ = postings.weighted_queries(docs, docs.select(F.col("doc").alias("q"), "text"))
    made = []
    keep = postings._lines
    try:
        postings._lines = lambda *rest: made.append(keep(*rest)) or made[-1]
        postings.best_of_owners(docs, docs.select(F.col("doc").alias("q"), "text"))
    finally:
        postings._lines = keep
    assert made[0].count() == postings.PARTS < weights.count() / 2 / 256


@pytest.mark.parametrize("hot", [1 << 16, 8, 0])
def test_cosines_leave_a_shard_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(retrieval, "HOT_TERMS", hot)
    words = ["a b c a", "a b", "c d", "a", "d d b", None, "x y", "a c d", ""]
    docs = spark.createDataFrame([(i, t, None if i % 5 == 4 else f"s{i % 3}") for i, t in enumerate(words)], "doc long, text string, source string")
    asked = spark.createDataFrame([(1, "a b b z"), (2, "d y"), (3, "none"), (4, None), (5, "c c a")], "q long, text string")
    weights, idf = retrieval.tfidf(docs, "doc", "text")
    plain = retrieval.cosine(retrieval.unit_weights(retrieval.terms(asked, "q", "text"), idf), weights, "q", "doc")
    want = {(r.q, r.doc): r.s for r in plain.collect()}
    best = {}
    for r in plain.join(docs.select("doc", "source"), "doc").collect():
        best[r.q, r.source] = max(r.s, best.get((r.q, r.source), 0.0))
    for shard in (2, 100):
        got = postings.tfidf_scores(docs, asked, shard=shard).collect()
        assert {(r.q, r.doc): r.s for r in got} == pytest.approx(want) and len(got) == len(want) > 0
        got = postings.tfidf_of_owners(docs, asked, shard=shard).collect()
        assert {(r.q, r.source): r.s for r in got} == pytest.approx(best) and len(got) == len(best)
    assert postings.tfidf_scores(docs.limit(0), asked).count() == 0
    same = spark.createDataFrame([(1, "a"), (2, "a")], "doc long, text string")  # idf and lengths of 0
    assert {(r.q, r.doc, r.s) for r in postings.tfidf_scores(same, asked).collect()} == {(q, d, 0.0) for q in (1, 5) for d in (1, 2)}


def test_scores_of_a_bootstrap_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(i % 5, float(i * 7 % 9) / 2 + 1, float(i * 31 % 17)) for i in range(100)]
    scores = spark.createDataFrame(rows, "who long, gold double, s double").repartition(3).mapInArrow(counted, "who long, gold double, s double")
    got = evaluation.bootstrap(evaluation.gold_parts(scores), "who", ["loss", "easy", "hard"], draws=50).collect()
    assert {r.name for r in got} == {"loss", "easy", "hard"} and all(0 <= r.low <= r.high <= 1 for r in got)
    assert made.value == len(rows)


@pytest.fixture(scope="module")
def few_vectors(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in (1, 2, 3)], f"r{i % 2}" if i else "r9") for i in range(23)]
    pubs = spark.createDataFrame(rows, "pub long, e array<double>, rev string").repartition(3)
    subs = spark.createDataFrame([(i, [float(i % 4 - 1), 1.0, float(i % 3)]) for i in range(9)], "sub long, e array<double>").repartition(2)
    return subs, pubs, pubs.select("pub", "rev")


def test_closest_pairs_leave_a_block_as_a_row_a_submission(few_vectors):
    subs, pubs, _ = few_vectors
    want = sorted(tuple(r) for r in topk.closest(scoring.pairwise(subs, pubs)).collect())
    parts = scoring.closest_pairs(subs, pubs, block=5)
    assert sorted(tuple(r) for r in topk.closest(parts).collect()) == want
    assert parts.count() < subs.count() * pubs.count() / 2


@pytest.mark.parametrize("block", [4, 100])
def test_best_means_are_those_of_all_cells(few_vectors, block):
    subs, pubs, own = few_vectors
    want = {(r["sub"], r.rev): r.s for r in topk.top_mean(scoring.pairwise(subs, pubs), own, 3).collect()}
    got = scoring.best_means(subs, pubs, own, 3, block=block).collect()
    assert len(got) == len(want) and {(r["sub"], r.rev): r.s for r in got} == pytest.approx(want)


def test_cells_are_drawn_and_rounded_in_their_blocks(few_vectors):
    subs, pubs, _ = few_vectors
    want = {(r["sub"], r.pub): r.s for r in scoring.minmax(scoring.pairwise(subs, pubs)).withColumn("s", rounded(F.col("s"))).collect()}
    got = scoring.pairwise(subs, pubs, block=4, ends=scoring.extremes(subs, pubs), digits=4)
    assert {(r["sub"], r.pub): r.s for r in got.collect()} == want and len(want) == 9 * 23


def test_cells_of_a_block_come_in_short_runs(few_vectors, monkeypatch):
    from itertools import groupby

    subs, pubs, _ = few_vectors
    x, y = ({r[0]: r.e for r in side.collect()} for side in (subs, pubs))
    monkeypatch.setattr(scoring, "COLUMNS", 3, raising=False)
    got = scoring.pairwise(subs.coalesce(1), pubs.coalesce(1)).collect()
    assert {(r["sub"], r["pub"]): r.s for r in got} == {(i, j): sum(a * b for a, b in zip(x[i], y[j], strict=True)) for i in x for j in y} and len(got) == 9 * 23
    assert max(len(list(g)) for _, g in groupby(r["sub"] for r in got)) <= 2 * 3  # the last of a run of columns may begin the next


@pytest.mark.parametrize(("most", "leave"), [(6, True), (100, False)])
def test_quantiles_of_a_large_author_are_taken_in_one_block(few_vectors, monkeypatch, most, leave):
    from kinfold.operators import blocks

    subs, pubs, own = few_vectors
    want = {(r["sub"], r.rev): r.s for r in scoring.by_author(scoring.pairwise(subs, pubs), own, "percentile:30").collect()}
    cells, plain = [], blocks.quantile
    monkeypatch.setattr(blocks, "quantile", lambda rows, *rest: cells.append(rows) or plain(rows, *rest))
    got = scoring.percentile_scores(subs, pubs, own, 0.3, block=4, most=most)
    assert {(r["sub"], r.rev): r.s for r in got.collect()} == pytest.approx(want) and got.count() == len(want)
    assert bool(cells[0].count()) == leave


def test_shards_are_bounded_by_their_tokens(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(postings, "TOKENS", 5)
    assert list(postings._cuts(np.array([2, 3, 1, 9, 0, 0, 5]), 100)) == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert list(postings._cuts(np.array([1, 1, 1, 1, 1]), 2)) == [(0, 2), (2, 4), (4, 5)] and not list(postings._cuts(np.array([], int), 2))


@pytest.mark.parametrize("how", ["max", "mean"])
def test_scores_by_owner_leave_a_shard_as_a_row_each(spark, monkeypatch, how):
    words = ["a b c", "a b", "c d", "a", "d d b", None, "x y", "a c d", "a a x"]
    docs = spark.createDataFrame(list(enumerate(words)), "doc long, text string")
    own = spark.createDataFrame([(i, f"s{i % 3}") for i in range(8)] + [(1, "s0"), (99, "s2"), (None, "none")], "doc long, rev string")
    asked = spark.createDataFrame([(1, "a b"), (2, "d"), (3, "zz"), (4, "a b c d x y")], "q long, text string")
    scores = retrieval.normalized_by_query(retrieval.bm25(docs, asked), docs.count())
    inside = own.join(docs.select("doc"), "doc", "left_semi").union(own.filter("doc is null"))
    want = {(r.q, r.rev): r.s for r in retrieval.by_owner(scores, asked, inside, how).collect()}
    monkeypatch.setattr(postings, "all_scores", None)  # no row a pair
    for shard in (2, 100):
        got = postings.by_owner(docs, asked, own, how, shard=shard).collect()
        assert {(r.q, r.rev): r.s for r in got} == pytest.approx(want) and len(got) == len(want) == 16
    unowned = postings.by_owner(docs.filter("text is not null"), asked, own.withColumn("rev", F.when(F.col("doc") > 3, F.col("rev"))), how).collect()
    assert {r.rev for r in unowned} == {None, "s0", "s1", "s2"} and max(r.s for r in unowned if r.rev is None) > 0


def test_a_batch_of_tokens_moves_different_ones_once(spark):
    rows = spark.createDataFrame([(1, ["a", "a", None, "b"]), (2, []), (3, None), (4, ["c", None, None])], "id long, t array<string>").coalesce(1)
    got = retrieval.counted(rows, "id", "t")
    assert sorted((r.id, r.item or "", r.n) for r in got.collect()) == [(1, "", 1), (1, "a", 2), (1, "b", 1), (4, "", 2), (4, "c", 1)]
    assert retrieval.counted(rows.limit(0), "id", "t").count() == 0
    made = retrieval.batches(rows, "id", F.col("t"), spark.createDataFrame([("a",), ("c",)], "item string"), 2)
    assert sorted(tuple(r)[:4] for r in made.collect())[0] == (0, 2, 4, 2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
