"""Requests' entities, archives' papers, loads, batches and vocabulary by hand."""

import pytest
from kinfold import functions as K
from kinfold import sources
from kinfold.operators import dataset, embedding, evaluation, graph, requests, retrieval
from pyspark.sql import functions as F


def entity(**fields):
    return {"type": None} | dict.fromkeys(requests.FIELDS) | fields


CASES = [
    (entity(type="Group", memberOf="g"), None, ["g"], ["g"]),
    (entity(type="Group", reviewerIds=["a", "b"], expertise="inv"), None, ["reviewers:2"], ["reviewers:2"]),
    (entity(type="Group", memberOf="g", reviewerIds=["a"]), "unexpected: reviewerIds", ["g", "reviewers:1"], ["g", "reviewers:1"]),
    (entity(type="Group", memberOf="g", id="n", withContent={"a": "b"}), "unexpected: id,withContent", ["g"], ["g"]),
    (entity(type="Group"), "nothing to name it by", ["unknownGroup"], ["unknownGroup"]),
    (entity(type="Note", id="n"), None, ["n"], ["pid-n"]),
    (entity(type="Note", invitation="i", withContent={"a": "b", "c": "d"}, submissionIds=["x"]), None, ["i", "a:b", "c:d"], ["inv", "withContent"]),
    (entity(type="Note", withVenueid="v", id="n"), "id beside invitation or venue", ["n", "v"], ["pid-n", "venueid"]),
    (entity(type="Note", submissions=["x", "y", "z"]), None, ["submissions:3"], ["submissions:3"]),
    (entity(type="Note", id="n", submissions=["x"], withContent={}), "unexpected: submissions", ["n", "submissions:1"], ["pid-n", "submissions:1"]),
    (entity(type="Note", expertise="e"), "nothing to name it by", ["unknownNote"], ["unknownNote"]),
    (entity(type="Edge"), "no such type: Edge", [], []),
    (entity(id="n"), "type is missing", None, None),
]


def test_entities(spark):
    df = spark.createDataFrame([(i, e) for i, (e, *_) in enumerate(CASES)], f"i int, e {requests.ENTITY}")
    e = F.col("e")
    rows = df.select("i", requests.fault(e).alias("f"), requests.names(e).alias("n"), requests.names(e, prefix=True).alias("p"), requests.name(e).alias("one")).orderBy("i").collect()
    assert [(r.f, r.n, r.p) for r in rows] == [tuple(c[1:]) for c in CASES]
    assert [r.one for r in rows] == [(c[2] or [None])[0] for c in CASES]


def test_papers_of_archives(spark):
    rows = [("b", "p", " T ", "x", 5, 2.0), ("a", "p", "T2", None, 7, None), ("a", "q", " ", "", 1, 1.0), ("a", "r", None, "only", None, 3.0), ("a", "r", None, "only", None, 3.0)]
    df = spark.createDataFrame(rows, "author string, id string, title string, abstract string, mdate long, weight double")
    papers, own = dataset.archive_papers(df, weight="weight")
    assert {(r.pub, r.title, r.abstract, r.mdate, tuple(r.authors), r.w) for r in papers.collect()} == {("p", "T2", ".", 7, ("a", "b"), 2.0), ("r", ".", "only", None, ("a",), 3.0)}
    assert {tuple(r) for r in own.collect()} == {("p", "a"), ("p", "b"), ("r", "a")}
    assert dataset.archive_papers(df.limit(0))[0].count() == 0


def test_embeddings_with_cache_and_weights(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"paper_id": "a", "embedding": [3, 4]}\nnot json\n{"paper_id": "b", "embedding": []}\n{"paper_id": "x"}\n')
    (tmp_path / "cached_e.jsonl").write_text('{"paper_id": "a", "embedding": [1, 0]}\n\n{"paper_id": "c", "embedding": [0, 2]}\n')
    w = spark.createDataFrame([("c", 0.5)], "paper_id string, w double")
    got = sources.embeddings(spark, str(tmp_path / "e.jsonl"), 2, normalize=True, weights=w, cached=str(tmp_path / "cached_e.jsonl"))
    found = {r.paper_id: (r.e, r.is_bad, r.w) for r in got.collect()}
    assert found.keys() == {"a", "b", "c"} and found["a"][0] == pytest.approx([0.6, 0.8]) and found["b"] == ([0.0, 0.0], True, 1.0) and found["c"][0] == pytest.approx([0.0, 1.0]) and found["c"][2] == 0.5


def test_results_in_both_forms(spark, tmp_path):
    (tmp_path / "r.csv").write_text("n1,~A,0.5\ndummy,~A,0.1\n")
    (tmp_path / "r.jsonl").write_text('{"submission": "n1", "user": "~A", "score": 0.5}\n')
    assert [tuple(r) for r in sources.results(spark, str(tmp_path / "r.csv"), symmetric=False).collect()] == [("~A", "n1", 0.5)]
    assert sources.results(spark, str(tmp_path / "r.csv"), symmetric=True).count() == 2
    assert [tuple(r) for r in sources.results(spark, str(tmp_path / "r.jsonl"), symmetric=False, legacy=True).collect()] == [("~A", "n1", 0.5)]


def test_batches_first_places_and_the_rest(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "c", "", "a z", "b b b b"])], "id long, t string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "item string, idx long")
    tokens = F.filter(F.split("t", " "), lambda x: x != "")
    assert sorted(tuple(r) for r in retrieval.batches(d, "id", tokens, vocab, 2).collect()) == [(0, 2, 4, 1, 3), (1, 2, 2, 1, 2), (2, 1, 4, 0, 4)]
    at = graph.first_places(spark.createDataFrame([(1, ["x", "y", "x"])], "id long, words array<string>"))
    assert sorted(tuple(r) for r in at.collect()) == [(1, "x", 0, 2), (1, "y", 1, 1)]
    got = spark.range(1).select(K.smoothed_weight(F.lit(0.3), 0.1).alias("a"), K.smoothed_weight(F.lit(0.3), 0).alias("b"), K.job_id(F.lit("x")).alias("id")).first()
    assert (got.a, got.b) == (pytest.approx(4.0), 1.0) and len(got.id) == 10 and got.id[0].isalpha() and set(got.id) <= set(K.ID_ALPHABET)
    s = embedding.facet_scores(spark.createDataFrame([(1, "ann|0", 5, 0.25), (1, "<unk>", 1, 0.5)], "sub long, rev string, idx int, d double"), special=3)
    assert [tuple(r) for r in s.collect()] == [(1, "ann", 0.75)]


def test_overlap_study(spark):
    rows = [(0.1, ["a"], ["b"]), (0.9, ["a"], ["a"]), (0.5, ["a", "b"], ["a"]), (float("-inf"), ["a"], ["a"]), (None, ["a"], ["a"])]
    r = evaluation.overlap_correlation(spark.createDataFrame(rows, "s double, w array<string>, f array<string>"), "w", "f").first()
    import numpy as np

    s = np.array([0.0, 1.0, 0.5])
    assert r.n == 3 and r.recall == pytest.approx(np.corrcoef(s, [0, 1, 0.5])[0, 1]) and r.precision == pytest.approx(np.corrcoef(s, [0, 1, 1])[0, 1]) and r.f1 == pytest.approx(np.corrcoef(s, [0, 1, 2 / 3])[0, 1])
