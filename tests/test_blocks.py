"""Best few from blocks of postings, and pairs that are counted without being made."""

import functools
import itertools
import random

import numpy as np
import pytest
from kinfold.operators import blocks, concordance, evaluation, postings, retrieval, topk
from kinfold.plans import jobs
from pyspark.sql import functions as F


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def some_texts(n, seed, words=60, long=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(words)], k=rng.randint(1, long))) for _ in range(n)]


@pytest.fixture(scope="module")
def papers(spark):
    texts, asked = some_texts(400, 1), some_texts(12, 2)
    rows = [(i, t if i % 3 else None, t if i % 4 == 0 else None, f"r{i % 37:02d}") for i, t in enumerate(texts)]
    pubs = spark.createDataFrame([r[:3] for r in rows], "pub long, title string, abstract string").repartition(3)
    own = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(5, "r01"), (9, "twice"), (8, "twice"), (None, "nothing"), (12345, "stranger"), (7, None)], "pub long, rev string")
    subs = spark.createDataFrame([(i, t, t if i % 2 else None) for i, t in enumerate(asked)] + [(90, "unheard words", None), (91, "", "")], "sub long, title string, abstract string")
    return subs, pubs, own


@pytest.mark.parametrize("k", [1, 4, 300])
def test_sparse_terms_job_is_the_whole_job_made_sparse(papers, k, monkeypatch):
    monkeypatch.setattr(postings, "QUERIES", 5)
    for name in ("best_candidates", "score_ends"):
        monkeypatch.setattr(postings, name, functools.partial(getattr(postings, name), shard=50, docs=8))
    whole = jobs.run(jobs.JobOptions(model="bm25", sparse=None), *papers).filter("rev is not null")
    got = jobs.run(jobs.JobOptions(model="bm25", sparse=k), *papers)
    assert rows_of(got, "sub", "rev", "s") == rows_of(topk.sparse_topk(whole, k), "sub", "rev", "s")


def test_sparse_terms_job_with_ids_of_text(papers):
    subs, pubs, own = (d.withColumn(c, F.concat(F.lit("n"), F.col(c).cast("string"))) for d, c in zip(papers, ("sub", "pub", "pub"), strict=True))
    whole = jobs.run(jobs.JobOptions(model="bm25", sparse=None), subs, pubs, own).filter("rev is not null")
    got = jobs.run(jobs.JobOptions(model="bm25", sparse=2), subs, pubs, own)
    assert rows_of(got, "sub", "rev", "s") == rows_of(topk.sparse_topk(whole, 2), "sub", "rev", "s")


def test_best_documents_read_fewer_postings(spark):
    """A few documents answer a query of rare words: blocks that have none of them aren't read."""
    texts = some_texts(600, 5)
    for i in range(0, 12):
        texts[i] += " rare" * (i + 1) + f" other{i}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "rare w1"), (2, "other3 w0 w2"), (3, "none of these")], "q long, text string").coalesce(1)
    few, every = (spark.sparkContext.accumulator(0) for _ in range(2))
    got = rows_of(postings.best_documents(docs, asked, 3, shard=100, docs=4, read=few), "q", "doc", "s")
    scores = {(r.q, r.doc): r.s for r in retrieval.bm25(docs, asked).collect()}
    want = [(q, d, -s) for q in (1, 2, 3) for s, d in sorted((-round(scores.get((q, d), 0.0), 6), d) for d in range(600))[:3]]
    assert [r[:2] for r in got] == sorted(r[:2] for r in want) and [r[2] for r in got] == pytest.approx([r[2] for r in sorted(want)], abs=2e-6)
    postings.best_documents(docs, asked, 600, shard=100, docs=4, read=every).collect()
    assert 0 < few.value < every.value / 3


def test_all_scores_are_those_of_joined_terms(papers):
    subs, pubs, _ = papers
    docs = pubs.select(F.col("pub").alias("doc"), F.col("abstract").alias("text"))
    asked = subs.select(F.col("sub").alias("q"), F.col("title").alias("text"))
    want = {(r.q, r.doc): r.s for r in retrieval.bm25(docs, asked).collect()}
    got = postings.all_scores(docs, asked, shard=30).collect()
    assert len(got) == len(want) and {(r.q, r.doc): r.s for r in got} == pytest.approx(want)
    assert postings.all_scores(docs.limit(0), asked).count() == 0 and postings.all_scores(docs, asked.limit(0)).count() == 0


def test_score_ends(papers):
    subs, pubs, _ = papers
    docs = pubs.select(F.col("pub").alias("doc"), F.col("abstract").alias("text")).filter("text is not null")
    asked = subs.select(F.col("sub").alias("q"), F.col("title").alias("text"))
    scores = retrieval.bm25(docs, asked)
    n = docs.count()
    want = {r.q: (min(r.low, 0) if r.n < n else r.low, max(r.high, 0) if r.n < n else r.high) for r in scores.groupBy("q").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n")).collect()}
    got = {r.q: (r.low, r.high) for r in postings.score_ends(*postings.weighted_queries(docs, asked), shard=40, docs=8).collect()}
    for q, ends in got.items():
        assert ends == pytest.approx(want.get(q, (0.0, 0.0)), abs=1e-9)
    assert len(got) == 14


def plain_sums(rows):
    out = {}
    for who, items in itertools.groupby(sorted(r for r in rows if None not in r), key=lambda r: r[0]):
        x = [0.0] * 6
        for (_, g, s), (_, h, t) in itertools.combinations(list(items), 2):
            if g == h:
                continue
            right, same = (g - h) * (s - t) > 0, s == t
            x[0] += 0 if right else abs(g - h) / (2 if same else 1)
            x[1] += abs(g - h)
            if max(g, h) >= 4 and min(g, h) <= 2:
                x[2], x[3] = x[2] + right, x[3] + 1
            if min(g, h) >= 4:
                x[4], x[5] = x[4] + right, x[5] + 1
        if x[1]:
            out[who] = x
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_pairs_are_counted_without_being_made(spark, parts):
    rng = random.Random(parts)
    rows = [(f"p{rng.choice([0, 0, 0, 1, 2, 3])}", float(rng.choice([1, 1.5, 2, 3, 4, 4.5, 5])), round(rng.random(), 1)) for _ in range(300)]
    rows += [("alone", 4.0, 0.5), ("level", 3.0, 0.1), ("level", 3.0, 0.2), ("p1", None, 0.3), ("p1", 2.0, None), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "who string, gold double, s double").repartition(4)
    got = {r.who: [r.loss_n, r.loss_d, r.easy_n, r.easy_d, r.hard_n, r.hard_d] for r in concordance.gold_sums(df, parts=parts).collect()}
    want = plain_sums(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_many_pairs_of_one_person(spark):
    """60,000 items have 1.8e9 pairs; in order, all are right, in reverse order all are wrong."""
    rows = spark.range(60_000).select(F.lit("p").alias("who"), (F.col("id") / 1000).alias("gold"), F.col("id").cast("double").alias("s"))
    a, b = (evaluation.pairwise_loss(rows.withColumn("s", x)).first().loss for x in (F.col("s"), -F.col("s")))
    assert (a, b) == pytest.approx((0.0, 1.0))
    plan = evaluation.gold_parts(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_out_of_order_by_hand():
    n, excess = concordance.out_of_order(np.array([0, 0, 0, 1, 1]), np.array([3.0, 1.0, 2.0, 1.0, 5.0]), np.array([1.0, 2.0, 1.0, 1.0, 1.0]), 2)
    assert n.tolist() == [3.0, 0.0] and excess.tolist() == [5.0, 0.0]


def test_quantiles_are_those_of_whole_lines_sorted_in_place():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 997):
        for share in (0.0, 0.25, 0.3, 0.5, 0.77, 1.0):
            s = rng.normal(size=(7, n))
            want = np.quantile(s, share, axis=1)
            assert (blocks._quantiles(s, share) == want).all()
    bad = np.array([[1.0, np.nan, 0.0], [1.0, 2.0, 0.0]])
    assert np.isnan(blocks._quantiles(bad, 0.0)).tolist() == [True, False]


def test_scores_need_no_memory_but_one_more_of_their_size():
    """Before, each of five steps made an array of the size of the products."""
    import tracemalloc

    s, weights = np.random.default_rng(4).normal(size=(100, 10_000)), np.tile([np.nan, 0.5, 1.0, 2.0], 2500)
    k = np.clip((s + 5) / 10, 1e-8, 1 - 1e-8)
    w = np.where(np.isnan(weights), 1.0, weights)
    want = w * k / (1.0 - k + w * k)
    tracemalloc.start()
    got = blocks._scored(s, weights, -5.0, 5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 1.1 * s.nbytes


def test_blocks_are_packed_once(spark):
    """Before, each partition of one side packed the other side's anew."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rng = random.Random(5)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(600)], "id long, e array<double>").repartition(4, "id")
    subs, pubs = rows.filter("id < 60").withColumnRenamed("id", "sub"), rows.filter("id >= 60").withColumnRenamed("id", "pub").mapInArrow(note, "pub long, e array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (r,) = blocks.extremes(subs, pubs).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < r.low < r.high and seen.value == 540
