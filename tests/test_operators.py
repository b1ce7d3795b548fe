"""Hand-computed cases of the affinity operators."""

import json

import numpy as np
import pytest
from kinfold import functions as K
from kinfold import sources
from kinfold.operators import cache, dataset, evaluation, graph, sampling, scoring, topk
from kinfold.plans import jobs
from pyspark.sql import functions as F


def pairs(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def matrix(spark, rows):
    return spark.createDataFrame([(f"t{i}", f"r{j}", float(x)) for i, row in enumerate(rows) for j, x in enumerate(row)], "sub string, rev string, s double")


def test_sparse_keeps_the_best_of_rows_and_columns(spark):
    got = topk.sparse_topk(matrix(spark, [(0.9, 0.1, 0.2), (0.8, 0.4, 0.3), (0.7, 0.6, 0.5)]), 1)
    assert pairs(got, "sub", "rev") == {("t0", "r0"), ("t1", "r0"), ("t2", "r0"), ("t2", "r1"), ("t2", "r2")}


def test_sparse_limits(spark):
    m = matrix(spark, [(0.5, 0.5), (0.5, 0.5)])
    assert topk.sparse_topk(m, 9).count() == 4
    assert topk.sparse_topk(matrix(spark, [(0.3,)]), 1).count() == 1
    assert topk.sparse_topk(m.limit(0), 3).count() == 0
    assert all(n >= 1 for (n,) in pairs(topk.sparse_topk(m, 1).groupBy("sub").agg(F.count("*").alias("n")), "n"))


def test_author_aggregates(spark):
    cells = spark.createDataFrame([("a", 1, 0.3), ("a", 2, 0.7), ("a", 3, 0.5), ("a", 4, 0.2), ("a", 5, 0.1)], "sub string, pub int, s double")
    own = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "z"), (1, "z"), (3, "z")], "pub int, rev string")
    value = lambda how: {r.rev: r.s for r in scoring.by_author(cells, own, how).collect()}
    assert value("max") == {"x": 0.7, "y": 0.5, "z": 0.5}
    assert value("percentile:50") == {"x": 0.5, "y": 0.35, "z": 0.3}
    assert value("mean") == {"x": 0.5, "y": 0.35, "z": 0.3}


def test_weights_turn_the_order(spark):
    got = spark.createDataFrame([(0.3, 5.0), (0.8, 0.1), (0.5, 1.0)], "s double, w double").select(K.logit_weighted(F.col("s"), F.col("w")).alias("v"))
    a, b, c = [r.v for r in got.collect()]
    sig = lambda s, w: 1 / (1 + np.exp(-(np.log(s / (1 - s)) + np.log(w))))
    assert a == pytest.approx(sig(0.3, 5)) and b == pytest.approx(sig(0.8, 0.1)) and a > b and c == pytest.approx(0.5)


def test_minmax_of_equal_scores_clamps(spark):
    assert pairs(scoring.minmax(matrix(spark, [(1.5, 1.5)])), "s") == {(1.0,)}
    assert pairs(scoring.minmax(matrix(spark, [(1.0, 3.0, 2.0)])), "s") == {(0.0,), (0.5,), (1.0,)}


def test_pairwise_in_blocks_is_the_matrix_product(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(23, 5)), rng.normal(size=(31, 5))
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sub long, e array<double>").repartition(3)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "pub long, e array<double>").repartition(2)
    got = np.zeros((23, 31))
    for r in scoring.pairwise(s, p, block=4).collect():
        got[r.sub, r.pub] = r.s
    assert np.allclose(got, x @ y.T)


def test_group_mean_rounds_half_even_and_skips_unknown(spark):
    s = spark.createDataFrame([("p1", "A1", 0.8), ("p2", "A1", 0.4), ("p1", "A2", 0.2), ("p2", "A2", 0.6), ("p3", "A1", 0.0)], "paper string, a string, s double")
    g = spark.createDataFrame([("p1", "B1"), ("p2", "B1"), ("p9", "B1"), ("p3", "B2")], "paper string, b string")
    assert pairs(scoring.group_mean(s, g), "a", "b", "s") == {("A1", "B1", 0.6), ("A2", "B1", 0.4), ("A1", "B2", 0.0)}


def test_cache_staleness_and_delta(spark):
    c = spark.sql("select 'm' model, * from values ('a', timestamp'2024-01-02'), ('b', timestamp'2024-01-02'), ('c', null), ('a', timestamp'2024-01-01') t(paper_id, embedding_date)")
    ms = 1704153600000  # 2024-01-02
    p = spark.createDataFrame([("a", ms - 1), ("b", ms + 1), ("c", ms), ("d", ms)], "paper_id string, mdate long")
    assert pairs(cache.lookup(c, p), "paper_id") == {("a",), ("c",)}
    assert cache.lookup(c, p).filter("paper_id = 'a'").first().embedding_date.day == 2
    assert pairs(cache.missing(c, p, "m"), "paper_id") == {("b",), ("d",)}
    new = spark.sql("select 'm' model, * from values ('a', timestamp'2024-01-03'), ('b', timestamp'2024-01-01'), ('e', timestamp'2024-01-01') t(paper_id, embedding_date)")
    assert pairs(cache.delta(c, new), "paper_id") == {("a",), ("e",)}


def test_best_paper_prefers_an_abstract(spark):
    p = spark.createDataFrame([(1, "t", None, 9), (2, "t", "x", 3), (3, "t", "y", 5), (4, "u", " ", 1), (5, "t", "z", 5)], "id int, title string, abstract string, d int")
    assert pairs(dataset.best_paper(p, ["title"], abstract=F.col("abstract"), date=F.col("d"), order="id"), "id") == {(3,), (4,)}


def test_recency(spark):
    p = spark.createDataFrame([("a", i, i) for i in range(1, 11)] + [("b", 1, 5)], "author string, id int, d int")
    n = lambda **k: dataset.recent(p, "author", "d", "id", **k).groupBy("author").count().collect()
    assert dict(n(top=3)) == {"a": 3, "b": 1}
    assert dict(n(top="15%")) == {"a": 2, "b": 1}
    assert dict(n(top=3, since=9)) == {"a": 2}
    assert dict(n(top=3, since=5, either=True)) == {"a": 6, "b": 1}


def test_selection_edges(spark):
    p = spark.createDataFrame([("u", 1), ("u", 2), ("v", 1), ("w", 3)], "who string, paper int")
    e = spark.createDataFrame([("u", 1), ("w", 9)], "who string, paper int")
    assert pairs(dataset.excluded(p, e, ["who", "paper"]), "who", "paper") == {("u", 2), ("v", 1), ("w", 3)}
    assert pairs(dataset.included(p, e, ["who", "paper"], "who"), "who", "paper") == {("u", 1), ("v", 1), ("w", 3)}
    assert pairs(dataset.included(p, e, ["who", "paper"], "who", fallback=False), "who", "paper") == {("u", 1), ("v", 1)}


def test_weight_rules(spark):
    for bad in ({"weight": 1}, {"weight": 1, "prefix": "a", "value": "b"}, {"weight": -1, "prefix": "a"}, {"weight": True, "value": "x"}):
        with pytest.raises(ValueError):
            dataset.WeightRule(**bad)
    rules = [dataset.WeightRule(0.5, submitted=True), dataset.WeightRule(2, value="v/c"), dataset.WeightRule(3, prefix="v/")]
    df = spark.createDataFrame([("v/c", True), ("w", True), ("w", False)], "v string, s boolean")
    assert [r.x for r in df.select(dataset.venue_weight(F.col("v"), F.col("s"), rules).alias("x")).collect()] == [3.0, 0.5, 1.0]


def test_text_functions(spark):
    r = spark.sql("select 'A  b' a, cast(null as string) n").select(K.space_tokens(F.col("a")).alias("t"), K.content_to_text(F.col("a"), F.col("n")).alias("c"), K.paperhash(F.lit("On  The: Ünit-1")).alias("h"), K.title_sep_abstract(F.col("n"), F.col("a")).alias("s"), K.title_sep_abstract(F.col("n"), F.lit(" ")).alias("z"), K.trailing_timestamp(F.lit("job-x-123")).alias("ts"), K.snake_case and F.lit(K.snake_case("useEmailIds")).alias("k")).first()
    assert r.t == ["a", "", "b"] and r.c == "A  b " and r.h == "on_the_nit_1" and r.s == ".[SEP]A  b" and r.z is None and r.ts == 123 and r.k == "use_email_ids"


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 0), ("q", "c", 0.7, 1), ("z", "a", 0.5, 0)], "q string, item string, s double, label int")
    assert pairs(evaluation.average_precision(r), "q", "ap") == {("q", (1 + 2 / 3) / 2)}
    assert pairs(evaluation.hits_at(r, 2), "q", "hits") == {("q", 0.5)}
    assert {x.m: x.recall for x in evaluation.recall_at(r, 4).collect()} == {0: 0.5, 1: 0.75, 2: 0.75, 3: 1.0}
    g = spark.createDataFrame([("p", 1, 5.0, 0.9), ("p", 2, 1.0, 0.1), ("p", 3, 4.5, 0.95)], "who string, item int, gold double, s double")
    assert evaluation.pairwise_loss(g).first().loss == pytest.approx(0.5 / 8)
    assert {x.kind: (x.accuracy, x.n) for x in evaluation.easy_hard(g).collect()} == {"easy": (1.0, 2), "hard": (0.0, 1)}


def test_average_ranks_share_ties(spark):
    r = spark.createDataFrame([("q", 3.0), ("q", 2.0), ("q", 2.0), ("q", 1.0)], "q string, s double")
    assert sorted(x.avg_rank for x in evaluation.average_rank(r, "q", "s").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_textrank_against_numpy(spark):
    t = spark.createDataFrame([(1, ["aa", "bb", "cc", "aa", "dd"])], "id long, words array<string>")
    got = {r.word: r.score for r in graph.textrank(graph.cooccurrences(t), 9).collect()}
    names = ["aa", "bb", "cc", "dd"]
    m = np.array([[0, 1, 1, 1], [1, 0, 1, 1], [1, 1, 0, 1], [1, 1, 1, 0]], float)
    m /= m.sum(0)
    v, last = np.ones(4), 0.0
    for _ in range(10):
        v = 0.15 + 0.85 * m @ v
        if abs(last - v.sum()) < 1e-5:
            break
        last = v.sum()
    assert got == pytest.approx(dict(zip(names, v, strict=True)))


def test_split_is_whole_and_disjoint(spark):
    got = sampling.split(spark.range(1000), "id", {"train": 0.6, "dev": 0.1, "test": 0.3}).groupBy("part").count().collect()
    n = dict(got)
    assert n == {"train": 600, "dev": 100, "test": 300}
    few = dict(sampling.split(spark.range(17), "id", {"train": 0.6, "dev": 0.1, "test": 0.3}).groupBy("part").count().collect())
    assert few == {"train": 10, "dev": 1, "test": 6}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 50, 97, 1000])
def test_places_are_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(sampling.permuted(F.col("id"), n, 3)).collect()]
    assert sorted(got) == list(range(n)) and (n < 12 or got != sorted(got))
    assert n < 50 or got != [r[0] for r in spark.range(n).select(sampling.permuted(F.col("id"), n, 4)).collect()]


def test_no_pattern_repeats_past_a_million_ids(spark):
    """Beyond 1,000,003 ids every place is taken once, every mixed number is new, and neighbours in place are no neighbours by id."""
    n = 3_000_009
    ids = spark.range(n).select("id", sampling.permuted(F.col("id"), n).alias("place"), sampling.scrambled(F.col("id"), 1 << 61).alias("x"))
    r = ids.agg(F.countDistinct("place").alias("places"), F.min("place").alias("low"), F.max("place").alias("high"), F.countDistinct("x").alias("mixed"), F.corr("id", "place").alias("along"), F.corr(F.col("id") % 1000, F.col("place") % 1000).alias("within")).first()
    assert (r.places, r.low, r.high, r.mixed) == (n, 0, n - 1, n) and abs(r.along) < 0.01 and abs(r.within) < 0.01
    far = spark.createDataFrame([(-1,), (0,), (2**62,), (2**62 + 1,), (2**32,), (2**32 + 1,), (-(2**63),)], "id long")
    assert far.select(sampling.scrambled(F.col("id"), 1 << 40).alias("x")).distinct().count() == 7


def test_shuffled_piles(spark):
    got = sampling.shuffled(spark.range(1003), "id", 10).collect()
    assert sorted((r.pile, r.place) for r in got) == sorted((i % 10, i // 10 + 1) for i in range(1003))
    assert {len([r for r in got if r.pile == p]) for p in range(10)} == {100, 101}
    folds = sampling.even_folds(spark.range(1003), "id", 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [200, 200, 201, 201, 201]


def test_drawn_rows_of_other_groups(spark):
    """Each row of another group as likely; joined by place, not by ranges of them."""
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 < 2, "big").when(F.col("id") % 4 == 2, "mid").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"))
    got = sampling.negatives(rows, "id", "g", "paper_uniform")
    assert got.filter("neg = g or neg is null").count() == 0
    n = {r.neg: r["count"] for r in got.filter("g = 'big'").groupBy("neg").count().collect()}
    assert n["mid"] == pytest.approx(1000, abs=120) and len(n) == 11 and all(v == pytest.approx(100, abs=45) for k, v in n.items() if k != "mid")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    assert "windowspecdefinition(source" not in plan and "windowspecdefinition(neg" not in plan


def test_sources(spark, tmp_path):
    a = tmp_path / "archives"
    a.mkdir()
    (a / "~Ann_B.C1.jsonl").write_text("\n".join(json.dumps({"id": f"n{i}", "mdate": i, "content": {"title": f"t{i}", "abstract": ""}}) for i in range(3)))
    assert pairs(sources.archives(spark, str(a)), "author", "id") == {("~Ann_B.C1", f"n{i}") for i in range(3)}
    s = tmp_path / "subs"
    s.mkdir()
    (s / "x.jsonl").write_text('{"id":"x","content":{"title":"old"}}\n{"id":"x","content":{"title":"new"}}')
    assert pairs(sources.submissions(spark, folder=str(s)), "id", "title") == {("x", "new")}
    (tmp_path / "s.json").write_text('{"y": {"id": "y", "content": {"title": "T"}}}')
    assert pairs(sources.submissions(spark, file=str(tmp_path / "s.json")), "id", "title") == {("y", "T")}
    (tmp_path / "e.jsonl").write_text('{"paper_id":"p","embedding":[1,2]}\n{"paper_id":"b","embedding":[]}\nbroken\n')
    assert {(r.paper_id, tuple(r.e), r.is_bad) for r in sources.embeddings(spark, str(tmp_path / "e.jsonl"), 2).collect()} == {("p", (1.0, 2.0), False), ("b", (0.0, 0.0), True)}
    (tmp_path / "g.tsv").write_text("ParticipantID\tPaper1\tPaper2\tExpertise1\tExpertise2\n7\ta\tb\t3\t\n")
    assert pairs(sources.gold_standard(spark, str(tmp_path / "g.tsv")), "participant", "paper", "expertise") == {("7", "a", 3.0)}
    (tmp_path / "s.csv").write_text("a,b,0.5\na,b,0.6\n")
    assert pairs(sources.scores(spark, str(tmp_path / "s.csv"), first=True), "score") == {(0.5,)}
    with pytest.raises(Exception, match="pair occurs twice"):
        sources.scores(spark, str(tmp_path / "s.csv")).collect()


def test_jobs(spark):
    subs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "sub long, e array<double>")
    pubs = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [0.6, 0.8], False), (3, [0.0, 0.0], True)], "pub long, e array<double>, is_bad boolean")
    own = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pub long, rev string")
    got = {(r.sub, r.rev): r.s for r in jobs.run(jobs.JobOptions(sparse=None), subs, pubs, own).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.6, (2, "a"): 0.0, (2, "b"): 0.8}
    for bad in ({"model": "none"}, {"sparse": 0}, {"blend": 2}):
        with pytest.raises(ValueError):
            jobs.JobOptions(**bad)
    text = lambda *r: spark.createDataFrame(list(r), "x string, title string, abstract string")
    s = jobs.run(jobs.JobOptions(model="bm25", sparse=None), text(("s", "T", "graph nets")).withColumnRenamed("x", "sub"), text(("p", "", "graph nets"), ("q", "other words", ""), ("r", "", "more of them")).withColumnRenamed("x", "pub"), spark.createDataFrame([("p", "a"), ("q", "b"), ("r", "b")], "pub string, rev string"))
    # abstracts are a corpus of their own: of its two papers one has each word, whose weight is ln(1.5 / 1.5)
    assert {(r.rev, r.s) for r in s.collect()} == {("a", 0.0), ("b", 0.0)}
    pubs = text(("p", "", "graph nets"), ("q", "graph words", ""), ("q2", "a title", ""), ("q3", "graph", ""), ("r", "", "more of them"), ("t", "", "nothing here")).withColumnRenamed("x", "pub")
    own = spark.createDataFrame([("p", "a"), ("r", "a"), ("q", "b"), ("q2", "b"), ("r", "c"), (None, "d")], "pub string, rev string")
    asked = text(("s", "T", "graph nets"), ("t", "words", None)).withColumnRenamed("x", "sub")
    score = lambda **o: {(r["sub"], r.rev): r.s for r in jobs.run(jobs.JobOptions(model="bm25", sparse=None, **o), asked, pubs, own).collect()}
    assert score() == {("s", "a"): 1.0, ("s", "b"): 0.0, ("s", "c"): 0.0, ("s", "d"): 0.0, ("t", "a"): 0.0, ("t", "b"): 1.0, ("t", "c"): 0.0, ("t", "d"): 0.0}
    assert score(average=True)["s", "a"] == 0.5 and score(average=True)["t", "b"] == 0.5 and score(percentile=50)["s", "a"] == 0.5
    assert set(score(use_title=False)) == {("s", x) for x in "abcd"}
    assert {r.rev for r in jobs.no_expertise(jobs.JobOptions(model="bm25", use_title=False), pubs, own).collect()} == {"b", "d"}


def test_terms_drawn_to_one(spark):
    """Least and greatest over all documents of the corpus: by hand, with scores below 0, all equal, and some unmatched."""
    from kinfold.operators import retrieval

    rows = spark.createDataFrame([("a", 1, -2.0), ("a", 2, 2.0), ("b", 1, 3.0), ("b", 2, 3.0), ("b", 3, 3.0), ("c", 1, -1.0), ("d", 1, 0.0), ("e", 1, 4.0), ("e", 2, 1.0)], "q string, doc long, s double")
    got = {(r.q, r.doc): (r.s, r.rest) for r in retrieval.normalized_by_query(rows, 3).collect()}
    assert got == {("a", 1): (0.0, 0.5), ("a", 2): (1.0, 0.5), ("b", 1): (1.0, 0.0), ("b", 2): (1.0, 0.0), ("b", 3): (1.0, 0.0), ("c", 1): (0.0, 1.0), ("d", 1): (0.0, 0.0), ("e", 1): (1.0, 0.0), ("e", 2): (0.25, 0.0)}
    own = spark.createDataFrame([(1, "x"), (3, "x"), (3, "y")], "doc long, rev string")
    asked = spark.createDataFrame([("a",), ("c",), ("z",)], "q string")
    by = lambda how: {(r.q, r.rev): r.s for r in retrieval.by_owner(retrieval.normalized_by_query(rows, 3), asked, own, how).collect()}
    assert by("max") == {("a", "x"): 0.5, ("a", "y"): 0.5, ("c", "x"): 1.0, ("c", "y"): 1.0, ("z", "x"): 0.0, ("z", "y"): 0.0}
    assert by("mean")["a", "x"] == 0.25 and by("mean")["c", "x"] == 0.5 and by("percentile:100")["a", "x"] == 0.5


def test_job_of_two_models_and_weights(spark):
    subs = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "sub long, e array<double>, e2 array<double>")
    pubs = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0], "V/1", True), (2, [0.6, 0.8], [0.0, 1.0], "W/1", True), (3, [0.8, 0.6], [0.6, 0.8], "W/2", False)], "pub long, e array<double>, e2 array<double>, venue string, submitted boolean")
    own = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "pub long, rev string")
    run = lambda **o: {r.rev: r.s for r in jobs.run(jobs.JobOptions.from_request({"sparse": None} | o), subs, pubs, own).collect()}
    assert run(model="vectors+vectors", blend=0.25) == {"a": 0.25, "b": 0.95}
    assert run(average=True) == {"a": 1.0, "b": 0.7} and run() == {"a": 1.0, "b": 0.8}
    weighted = run(weights=[{"prefix": "V", "weight": 0}, {"submitted": False, "weight": 3}])
    assert weighted == {"b": pytest.approx(3 * 0.8 / (0.2 + 3 * 0.8), abs=1e-4)}
    for bad in ({"nothing": 1}, {"average": 1}, {"blend": "x"}, {"weights": {}}, {"weights": [{"weight": 1}]}, {"weights": [{"value": "x", "wait": 1}]}, {"model": "bm25", "weights": [{"value": "x", "weight": 1}]}, {"use_title": False, "use_abstract": False}):
        with pytest.raises(ValueError):
            jobs.JobOptions.from_request(bad)
    ids = {jobs.job_id() for _ in range(200)}
    assert len(ids) == 200 and all(len(x) == 10 and x[0].isalpha() and set(x) <= set(jobs.ID_ALPHABET) for x in ids)
    assert jobs.request_key("group", ["b", "a"], None, 3) == "group:a,b:3"


def test_author_scores_without_cells(spark):
    """The reduced product against one cell at a time: several blocks, authors of text, an author twice on a paper."""
    from kinfold.operators import scoring

    rng = np.random.default_rng(1)
    subs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(13)], "sub long, e array<double>").repartition(3)
    pubs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "pub long, e array<double>").repartition(4)
    own = spark.createDataFrame([(i, f"r{i * i % 7}") for i in range(40)] + [(3, "r1"), (3, "r1"), (5, "only"), (99, "none")], "pub long, rev string")
    for how in ("max", "mean"):
        want = {(r["sub"], r.rev): r.s for r in scoring.by_author(scoring.pairwise(subs, pubs), own, how).collect()}
        got = {(r["sub"], r.rev): r.s for r in scoring.author_scores(subs, pubs, own, how, block=5).collect()}
        assert got == pytest.approx(want, abs=1.01e-4) and len(got) == 13 * len({f"r{i * i % 7}" for i in range(40)} | {"only"})
    assert scoring.author_scores(subs.limit(0), pubs, own).count() == 0


def test_dataset_facade(spark, tmp_path):
    from kinfold.operators import dataset

    for d in ("archives", "submissions", "bids"):
        (tmp_path / d).mkdir()
    (tmp_path / "metadata.json").write_text('{"submission_count": 2}')
    (tmp_path / "archives" / "~B1.jsonl").write_text('{"id": "p1", "content": {"title": "x"}}\n{"id": "p2", "content": {"title": "y"}}\n')
    (tmp_path / "archives" / "~A1.jsonl").write_text('{"id": "p3", "content": {"title": "z"}}\n')
    for x in ("s2", "s1"):
        (tmp_path / "submissions" / f"{x}.jsonl").write_text('{"id": "%s", "content": {"title": "t"}}\n' % x)
    (tmp_path / "bids" / "s1.jsonl").write_text('{"forum": "s1"}\n')
    d = sources.Dataset(spark, str(tmp_path))
    assert d.metadata() == {"submission_count": 2} and tuple(d.totals().first()) == (3, 2, 2)
    assert [r.id for r in d.ids("authors").collect()] == ["~A1", "~B1"] and [r.id for r in d.ids("submissions").collect()] == ["s1", "s2"]
    assert sorted(len(b) for b in d.batches("archives", 2)) == [1, 2]
    (tmp_path / "labels.jsonl").write_text('{"source_id": "a", "target_id": "y", "label": 1}\n{"source_id": "a", "target_id": "x", "label": 0}\n')
    (r,) = sources.score_labels(spark, str(tmp_path / "labels.jsonl")).collect()
    assert r.source_id == "a" and [tuple(t) for t in r.targets] == [("x", 0.0), ("y", 1.0)]
    assert dataset.required(d.bids(), "bids").count() == 1
    with pytest.raises(dataset.ExpectedDataError, match="no notes found"):
        dataset.required(spark.range(0), "notes")
    with pytest.raises(ValueError):
        dataset.notes_of(spark.range(1))
    row = spark.sql("select '~a' profile, array('x@y', 'z@y') emails, 1 n, true t, map('k', 1) m")
    one = row.select(dataset.author_key(F.col("profile"), F.col("emails"), True).alias("a"), dataset.author_key(F.col("profile"), F.col("emails"), False).alias("b"), dataset.scalar_json(row).alias("j")).first()
    assert tuple(one) == ("x@y", "~a", '{"profile":"~a","n":1,"t":true}')


def test_shuffled_negatives(spark):
    from kinfold.operators import sampling

    rows = spark.createDataFrame([(i, f"g{i % 5}") for i in range(60)] + [(99, None)], "id long, g string")
    got = sampling.negatives(rows, "id", "g", "shuffle").collect()
    after = {r.g: r.neg for r in got}
    assert len(got) == 61 and after.pop(None) is None and all(r.neg == after[r.g] for r in got if r.g) and sorted(after.values()) == sorted(after) and all(a != b for a, b in after.items())
    assert all(r.neg is None for r in sampling.negatives(rows.filter("g = 'g1'"), "id", "g").collect())


def test_streamed_cache_appends_once(spark, tmp_path):
    from kinfold.streaming import append_embeddings

    rows = spark.sql("select 'm' model, * from values ('a', array(1.0f), timestamp'2024-01-02'), ('a', array(2.0f), timestamp'2024-01-01'), ('b', array(3.0f), timestamp'2024-01-02') t(paper_id, embedding, embedding_date)")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        append_embeddings(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / "check")).awaitTermination()
    assert pairs(spark.read.parquet(str(tmp_path / "cache")), "paper_id", "year_month") == {("a", "2024-01"), ("b", "2024-01")}


def test_embedding_hook_with_cache(spark):
    from kinfold.operators import embedding

    papers = spark.createDataFrame([("a", 0, "x"), ("b", 0, "yy"), ("c", 0, None)], "paper_id string, mdate long, text string")
    held = spark.sql("select 'm' model, 'a' paper_id, array(9.0D) embedding, timestamp'2024-01-02' embedding_date")
    every, new = embedding.embed_missing(papers, held, "m", lambda texts: [[float(len(t))] for t in texts])
    assert {(r.paper_id, tuple(r.embedding)) for r in every.collect()} == {("a", (9.0,)), ("b", (2.0,)), ("c", ())}
    assert pairs(new, "paper_id") == {("b",), ("c",)}


def test_gradient_fit_is_bounded_least_squares():
    from kinfold.operators.embedding import gradient_fit

    rng = np.random.default_rng(3)
    bases = rng.normal(size=(3, 8))
    c, d = gradient_fit(bases, np.array([0.2, 0.7, 0.0]) @ bases, rounds=3000)
    assert np.allclose(c, [0.2, 0.7, 0.0], atol=1e-3) and d < 1e-5
    c, d = gradient_fit(bases[:1], 5 * bases[0], rounds=100)
    assert c[0] == pytest.approx(1.0) and d == pytest.approx(16 * (bases[0] ** 2).sum())


def test_best_options(spark):
    from kinfold.operators.embedding import best_options

    got = best_options([{"k": 3}, {"k": 1}, {"k": 2}], lambda c: spark.range(1).select(F.lit(float(c["k"])))).collect()
    assert [r.candidate for r in got] == [1, 2, 0]


def test_singlerank_weighs_links(spark):
    t = spark.createDataFrame([(1, ["aa", "bb", "aa", "bb", "cc"])], "id long, words array<string>")
    got = [r.word for r in graph.singlerank(graph.weighted_cooccurrences(t, 2), 3).orderBy("rank").collect()]
    assert got[0] == "bb" and got[-1] == "cc"


def test_papers_records_and_dumps(spark, tmp_path):
    from kinfold import sources

    for name, row in {"a": {"title": "x", "abstract": "y", "year": 2020}, "b": {"title": "x", "abstract": None, "year": 2020}, "c": {"title": "z", "abstract": "w", "year": 2021}}.items():
        (tmp_path / "papers").mkdir(exist_ok=True)
        (tmp_path / "papers" / f"{name}.json").write_text(json.dumps(row))
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "c.json").write_text(json.dumps("whole\ntext"))
    assert sorted(r.paper for r in sources.papers(spark, str(tmp_path / "papers")).collect()) == ["a", "c"]
    assert [tuple(r) for r in sources.papers(spark, str(tmp_path / "papers"), str(tmp_path / "texts")).select("paper", "text").collect()] == [("c", "whole\ntext")]
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "n int, s string")
    for kind in ("json", "csv", "parquet"):
        sources.write_dump(rows, str(tmp_path / kind), kind)
    assert sorted(tuple(r) for r in sources.records(spark, str(tmp_path / "json"), "n int, s string").collect()) == [(1, "p"), (2, "q")]
    (tmp_path / "t.tsv").write_text("1\tp\n2\tq\n")
    assert sorted(tuple(r) for r in sources.records(spark, str(tmp_path / "t.tsv"), "n int, s string").collect()) == [(1, "p"), (2, "q")]
    assert sorted(spark.read.csv(str(tmp_path / "csv"), sep="\t", header=True).columns) == ["n", "s"]


def test_encoded_of_nothing_and_typed_tokens(spark):
    from kinfold import functions as K
    from kinfold.operators import retrieval as R
    from pyspark.sql import functions as F

    v = spark.createDataFrame([("a", 5, 2)], "item string, cnt long, idx long")
    d = spark.createDataFrame([(1, ["b", "a", "a", "a"]), (2, []), (3, None), (4, [None, "a"])], "i int, w array<string>")
    got = {r.i: list(r.ids) for r in R.encoded(d, "i", {"ids": F.col("w")}, v, 3).collect()}
    assert got == {1: [1, 2, 2], 2: [0, 0, 0], 3: [0, 0, 0], 4: [1, 2, 0]}
    tokens, types = K.typed_tokens(F.col("w"), F.array(F.lit("x"), F.lit("y")), most=4)
    made = {r.i: (list(r.t), list(r.y)) for r in d.filter("i < 4").select("i", tokens.alias("t"), types.alias("y")).collect()}
    assert made[1] == (["b", "a", "a", "<SEP>"], [0, 0, 0, 1])
    assert made[2] == made[3] == (["<SEP>", "x", "y", "<SEP>"], [0, 1, 1, 1])


def test_running_sums_by_ranges(spark):
    from kinfold.operators.ordering import range_of, with_running

    values = [(i, None if i % 11 == 0 else float(i * 37 % 23)) for i in range(300)]
    df = spark.createDataFrame(values, "i long, s double").repartition(5)
    keys = [F.col("s").isNull(), -F.col("s"), F.col("i")]
    ordered = sorted(values, key=lambda v: (v[1] is None, -(v[1] or 0.0), v[0]))
    want = {(i, n + 1, sum(x for x, _ in ordered[: n + 1])) for n, (i, _) in enumerate(ordered)}
    for parts in (1, 3, 64):
        got = with_running(df, keys, {"rk": F.lit(1), "t": F.col("i")}, parts)
        assert got.columns == ["i", "s", "rk", "t"]
        assert {(r.i, r.rk, r.t) for r in got.collect()} == want
    assert df.select(range_of(df, keys, 8).alias("p")).distinct().count() == 8
    assert with_running(df.filter("i < 0"), keys, {"rk": F.lit(1)}).collect() == []


def test_facet_coefficients(spark):
    from kinfold.operators.embedding import coefficients, facet_distances

    rng = np.random.default_rng(5)
    b, t = rng.normal(size=(3, 6)), rng.normal(size=(4, 6))
    p, g = t @ b.T, b @ b.T
    for n in range(4):
        f = p[n] / np.diag(g)
        i = int(f.argmax())
        assert np.allclose(coefficients(p, g, "max_cos")[n], np.eye(3)[i] * f[i])
        c = np.eye(3)[i] * max(f[i], 0)
        left = (t[n] - c @ b) @ b.T / np.diag(g)
        c[left.argmax()] += max(left.max(), 0)
        assert np.allclose(coefficients(p, g, "max_iter")[n], c)
        e = np.exp(p[n] / np.linalg.norm(b, axis=1))
        assert np.allclose(coefficients(p, g, "softmax")[n], e / e.sum())
        j = int((p[n] / np.linalg.norm(b, axis=1)).argmax())
        assert np.allclose(coefficients(p, g, "max")[n], np.eye(3)[j] * min(max(f[j], 0), 1))
        c = rng.random(3) * 0.2  # steps along the product, scaled to a sum of at most 1
        for _ in range(4000):
            c = np.maximum(c + 0.05 * (p[n] - 0.01), 0)
            c /= max(1.0, c.sum())
        assert np.allclose(coefficients(p, g, "prod", l1=0.01)[n], c, atol=1e-6)
    with pytest.raises(ValueError):
        coefficients(p, g, "none")
    facets = spark.createDataFrame([("x", b.tolist()), ("y", b[:1].tolist()), ("z", [])], "rev string, facets array<array<double>>")
    targets = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(t)], "sub int, e array<double>")
    got = {(r.sub, r.rev): r.d for r in facet_distances(facets, targets, method="softmax", block=3).collect()}
    assert len(got) == 8
    for (n, who), d in got.items():
        k = 3 if who == "x" else 1
        c = coefficients(p[n : n + 1, :k], g[:k, :k], "softmax")[0]
        assert d == pytest.approx(((c @ b[:k] - t[n]) ** 2).sum())


def test_sampled_options():
    from kinfold.operators.embedding import sampled

    got = sampled({"merge": (0.0, 1.0), "select": (1, 5), "kind": ["max", "avg"], "k": 3}, 50, seed=1)
    assert got == sampled({"merge": (0.0, 1.0), "select": (1, 5), "kind": ["max", "avg"], "k": 3}, 50, seed=1)
    assert {c["select"] for c in got} == {1, 2, 3, 4} and {c["kind"] for c in got} == {"max", "avg"}
    assert all(0 <= c["merge"] < 1 and c["k"] == 3 for c in got)


def test_heavy_terms_in_groups(spark):
    from kinfold.operators.retrieval import bm25

    docs = spark.createDataFrame([(i, " ".join(["a"] * (i % 3 + 1) + [f"w{i % 5}"])) for i in range(40)] + [(99, None)], "doc long, text string")
    subs = spark.createDataFrame([(1, "a w1"), (2, "a a w4"), (3, None), (4, "zz")], "q long, text string")
    whole, cut = ({(r.q, r.doc): round(r.s, 9) for r in bm25(docs, subs, most=m).collect()} for m in (1000, 3))
    assert whole == cut and len(whole) == 80


def test_negatives_reach_every_group(spark):
    from kinfold.operators.sampling import negatives

    rows = spark.range(40_000).withColumn("g", F.col("id") % 2000)
    apart = negatives(rows, "id", "g").select(F.pmod(F.col("neg") - F.col("g"), F.lit(2000)).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert apart[0] >= 1 and apart[1] > 1900


def _small_job(spark, seed=4, clustered=False):
    rng = np.random.default_rng(seed)
    centres = np.eye(8) * 10 if clustered else np.zeros((8, 8))
    sign = np.where(np.eye(8) > 0, 1, -1) if clustered else np.ones((8, 8))

    def some(n):
        of = np.sort(rng.integers(0, 8, n))
        return [(i, (np.abs(rng.normal(size=8)) * sign[of[i]] * 0.1 + centres[of[i]]).tolist() if clustered else rng.normal(size=8).tolist()) for i in range(n)]

    subs = spark.createDataFrame(some(60), "sub long, e array<double>").coalesce(1)
    pubs = spark.createDataFrame(some(90), "pub long, e array<double>").coalesce(1)
    own = spark.createDataFrame([(i, f"r{i * 17 // 50 if clustered else i * i % 23:02d}") for i in range(90)] + [(3, "r01"), (5, "only"), (99, "none"), (7, None)], "pub long, rev string")
    return subs, pubs, own


@pytest.mark.parametrize("block", [5, 2048])
@pytest.mark.parametrize("k", [1, 3, 500])
def test_best_pairs_are_those_of_all_scores(spark, block, k):
    subs, pubs, own = _small_job(spark)
    want = topk.sparse_topk(scoring.author_scores(subs, pubs, own), k)
    assert pairs(scoring.best_pairs(subs, pubs, own, k, block=block), "sub", "rev", "s") == pairs(want, "sub", "rev", "s")


def test_best_pairs_of_equal_scores(spark):
    subs = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "sub long, e array<double>").repartition(3)
    pubs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "pub long, e array<double>").repartition(2)
    own = pubs.select("pub", (9 - F.col("pub")).alias("rev"))
    assert pairs(scoring.best_pairs(subs, pubs, own, 2, block=2), "sub", "rev") == {(i, j) for i in range(9) for j in range(1, 10) if i < 2 or j < 3}
    assert scoring.best_pairs(subs.limit(0), pubs, own, 2).count() == 0


def test_blocks_that_bring_nothing_are_left_out(spark):
    subs, pubs, own = _small_job(spark, clustered=True)
    skipped = spark.sparkContext.accumulator(0)
    got = pairs(scoring.best_pairs(subs, pubs, own, 1, block=4, skipped=skipped), "sub", "rev", "s")
    assert got == pairs(topk.sparse_topk(scoring.author_scores(subs, pubs, own), 1), "sub", "rev", "s")
    assert skipped.value > 10
    before = skipped.value
    ends = scoring.extremes(subs, pubs, block=2, skipped=skipped).first()
    cells = scoring.pairwise(subs, pubs).agg(F.min("s").alias("low"), F.max("s").alias("high")).first()
    assert (ends.low, ends.high) == pytest.approx((cells.low, cells.high)) and skipped.value > before


def test_what_leaves_a_block(spark):
    from kinfold.operators.blocks import best_of

    s = np.random.default_rng(2).integers(0, 4, (40, 30)).astype(float)  # ties in plenty
    for k in (1, 4, 30, 40):
        line, column = best_of(s, k, 1), best_of(s, k, 0)
        assert (line.sum(1) == min(k, 30)).all() and (column.sum(0) == min(k, 40)).all()
        for i in range(40):
            assert set(np.flatnonzero(line[i])) == set(sorted(range(30), key=lambda j: (-s[i, j], j))[:k])


@pytest.mark.parametrize("block", [6, 2048])
def test_percentiles_without_lists(spark, block):
    subs, pubs, own = _small_job(spark)
    weights = pubs.withColumn("w", F.when(F.col("pub") % 3 == 0, 2.0))
    ends = scoring.extremes(subs, pubs)
    cells = scoring.weighted(scoring.minmax(scoring.pairwise(subs, pubs)), weights.filter("w is not null").select("pub", "w"))
    for p in (0, 30, 75, 100, 400):
        want = {(r["sub"], r.rev): r.s for r in scoring.by_author(cells, own.filter("rev is not null"), f"percentile:{p}").collect()}
        got = {(r["sub"], r.rev): r.s for r in scoring.percentile_scores(subs, weights, own, p / 100, block=block, ends=ends, weight="w").collect()}
        assert got == pytest.approx(want, abs=1.01e-4)
    for how in ("max", "mean"):
        want = {(r["sub"], r.rev): r.s for r in scoring.by_author(cells, own.filter("rev is not null"), how).collect()}
        got = {(r["sub"], r.rev): r.s for r in scoring.author_scores(subs, weights, own, how, block=block, ends=ends, weight="w").collect()}
        assert got == pytest.approx(want, abs=1.01e-4)
