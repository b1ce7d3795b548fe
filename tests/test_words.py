"""Chunks, sentences and the store of jobs by hand."""

import datetime

import pytest
from kinfold.operators import graph
from kinfold.operators.topk import statistics
from kinfold.streaming import jobstore
from pyspark.sql import functions as F


def chunks(spark, words, tags):
    df = spark.createDataFrame([(words, tags)], "w array<string>, t array<string>")
    return df.select(graph.noun_chunks(F.col("w"), F.col("t")).alias("c")).first().c


def test_noun_chunks(spark):
    assert chunks(spark, "The Big red dog saw cat food , quick old".split(), "DT JJ JJ NN VB NN NN . JJ JJ".split()) == ["big_red_dog", "cat_food"]
    assert chunks(spark, ["red", "dog", "old", "cat"], ["JJ", "NN", "JJ", "NN"]) == ["red_dog_old_cat"]
    assert chunks(spark, ["?!", "x", "the"], ["NN", "DT", "NN"]) == []
    assert chunks(spark, ["a", None, "b"], [None, "NN", "XX"]) == [] and chunks(spark, [], []) == []
    long = chunks(spark, ["w"] * 30_000 + ["x"], ["JJ"] * 30_000 + ["DT"])
    assert long == [] and len(chunks(spark, ["w"] * 30_000, ["NN"] * 30_000)[0]) == 59_999


def test_tagged_words(spark):
    df = spark.createDataFrame([(["The", "Cat", "--", "sat", None], ["NN", "NN", "NN", "VB", "NN"])], "w array<string>, t array<string>")
    assert df.select(graph.tagged_words(F.col("w"), F.col("t"), ["NN"]).alias("c")).first().c == ["cat"]


TEXT = "Dr. Smith met Mr. Jones. They spoke e.g. of tea. It rained! (So what?) Yes.\n\nA new part begins etc. and goes on. J. Doe left"


def test_sentences(spark):
    texts = [TEXT] + [f"We asked Dr. Brown about things. It ends here. Then tea came. Jones left. Some things that came here left as Jones ends tea {i} so" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None), (98, ""), (97, " \n\n ")], "id long, text string")
    short = {r.word for r in graph.abbreviations(docs, "text").collect()}
    assert "dr" in short and not short & {"ends", "jones", "came", "here", "left", "things", "tea"}
    got = [r.sentence for r in graph.sentences(docs, "id", "text", spark.createDataFrame([("dr",), ("mr",), ("e.g",), ("etc",)], "word string")).filter("id = 0").orderBy("at").collect()]
    assert got == ["Dr. Smith met Mr. Jones.", "They spoke e.g. of tea.", "It rained!", "(So what?)", "Yes.", "A new part begins etc. and goes on.", "J. Doe left"]
    every = graph.sentences(docs, "id", "text")
    assert {r.id for r in every.collect()} == set(range(31))
    inside = graph.cooccurrences(graph.sentence_words(every.filter("id = 0")))
    assert not {("rained", "tea"), ("rained", "yes")} & {(r.w1, r.w2) for r in inside.collect()}


def test_statistics_without_lists(spark):
    rows = spark.range(1, 102).select(F.when(F.col("id") <= 100, F.col("id").cast("double")).alias("s")).repartition(5)
    r = statistics(rows).first()
    assert (r.n, r.mean, r.min, r.q1, r.median, r.q3, r["max"]) == (100, 50.5, 1.0, 25.75, 50.5, 75.25, 100.0)
    assert statistics(rows.filter("s = 3")).first().median == 3.0 and statistics(rows.limit(0)).first().median is None


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


EVENTS = [
    ("a", "u", "save", 0, 1, None), ("a", "u", "save", 30, 2, None), ("a", "v", "remove", 40, 3, None), ("a", "u", "remove", 50, 4, None), ("a", "u", "remove", 51, 5, None),
    ("b", "u", "save", 0, 6, None), ("b", "v", "save", 10, 7, None), ("b", "root", "save", 20, 8, 600.0), ("b", "v", "save", 200, 9, None),
    ("c", "w", "save", 5, 10, 60.0), ("d", "w", "save", 600, 11, None), (None, "w", "save", 1, 12, None),
]
WANT = sorted([
    ("a", "u", "saved", 0), ("a", "u", "saved", 30), ("a", "v", "refused", 40), ("a", "u", "removed", 50), ("a", "u", "refused", 51), ("b", "u", "saved", 0), ("b", "v", "refused", 10),
    ("b", "u", "saved", 20), ("b", "u", "expired", 30), ("b", "v", "saved", 200), ("b", "v", "expired", 260), ("c", "w", "saved", 5), ("c", "w", "expired", 6), ("d", "w", "saved", 600),
])
SCHEMA = "job string, user string, kind string, at timestamp, `order` long, ttl double"


def log(df):
    return sorted((r.job, r.owner, r.what, (r["at"] - at(0)).total_seconds() / 60) for r in df.collect())


def test_log_of_jobs(spark):
    events = spark.createDataFrame([(j, u, k, at(m), o, t) for j, u, k, m, o, t in EVENTS], SCHEMA).repartition(3)
    assert log(jobstore.job_log(events, 3600.0, frozenset({"root"}))) == WANT
    assert log(jobstore.job_log(events.limit(0), 3600.0)) == []
    start = at(0).replace(tzinfo=datetime.UTC).timestamp()
    owned = events.filter("job is not null and order not in (3, 7, 8, 9)")
    live = lambda m, **k: {r.job for r in jobstore.live_jobs(owned, 3600.0, start + m * 60, **k).collect()}
    assert live(45, user="u") == {"a", "b"} and live(601) == {"d"} and live(5.5) == {"a", "b", "c"} and live(601, user="u") == set()


def test_stream_of_jobs_expires_them(spark, tmp_path):
    """The same events in five files: timers end what no later event does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(EVENTS, key=lambda r: (r[3], r[4]))
        for n in range(5):
            part = rows[n * 3 : n * 3 + 3] if n < 4 else [("z", "u", "save", 5000, 99, None)]
            spark.createDataFrame([(j, u, k, at(m), o, t) for j, u, k, m, o, t in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = jobstore.job_log_stream(stream, 3600.0, "1 minute", frozenset({"root"}))
        q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = log(spark.read.schema(jobstore.LOG).parquet(str(tmp_path / "out")))
    assert [r for r in got if r[0] != "z" and r[:3] != ("d", "w", "expired")] == WANT
    assert ("d", "w", "expired", 660.0) in got


@pytest.mark.parametrize("share", [0, 30, 50, 100])
def test_owner_percentiles_with_documents_that_share_nothing(spark, share):
    import numpy as np
    from kinfold.operators import retrieval

    scores = spark.createDataFrame([(1, 1, 0.9, 0.2), (1, 2, 0.1, 0.2), (1, 3, 0.2, 0.2), (1, 4, 0.5, 0.2), (2, 1, 1.0, 0.0)], "q long, doc long, s double, rest double")
    own = spark.createDataFrame([(d, "a") for d in (1, 2, 3, 7, 8, 9)] + [(4, "b"), (1, "b"), (50, "c"), (None, "d")], "doc long, rev string")
    got = {(r.q, r.rev): r.s for r in retrieval.by_owner(scores, spark.createDataFrame([(1,), (2,), (3,)], "q long"), own, f"percentile:{share}").collect()}
    lists = {(1, "a"): [0.9, 0.1, 0.2, 0.2, 0.2, 0.2], (1, "b"): [0.5, 0.9], (1, "c"): [0.2], (1, "d"): [0], (2, "a"): [1, 0, 0, 0, 0, 0], (2, "b"): [1, 0], (2, "c"): [0], (2, "d"): [0], (3, "a"): [0], (3, "b"): [0], (3, "c"): [0], (3, "d"): [0]}
    assert got == pytest.approx({k: float(np.quantile(v, share / 100)) for k, v in lists.items()})


def test_sentences_put_no_words_in_order(spark):
    """Before, each word was a row that was put in order within its text."""
    docs = spark.createDataFrame([(1, "A bc. D e"), (None, "x\u00a0y. \u00c9 z"), (3, None), (4, "")], "id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = graph.sentences(docs, "id", "text", spark.createDataFrame([], "word string"))
    assert "Window" not in plan(made)
    assert sorted((r.id or 0, r.at, r.sentence) for r in made.collect()) == [(0, 1, "x\u00a0y."), (0, 2, "\u00c9 z"), (1, 1, "A bc."), (1, 2, "D e")]


def test_first_places_move_no_words(spark):
    """Before, each word was a row that was grouped by a shuffle."""
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a"])], "id long, words array<string>")
    made = graph.first_places(docs)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [(1, "a", 1, 1), (1, "b", 0, 2), (4, "a", 0, 1)]
