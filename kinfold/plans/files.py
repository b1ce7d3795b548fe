"""Readers and writers as queries: tables are written as the files that jobs have, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold import sources
from kinfold.plans.registry import query
from kinfold.plans.scores import _MAX, reviewer_scores


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A file a submission, named by it, whose last line stands.
@query("select 's.' || item_id id, item_id + 1 mdate, left(text, 20) title, md5(text) abstract from benchmark")
def submissions_read(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("s."), F.col("item_id").cast("string")).alias("name"), "item_id", "text")
    lines = b.select("name", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), "item_id", "text")
    content = F.struct(F.when(F.col("turn") == 1, F.substring("text", 1, 20)).otherwise("before").alias("title"), F.col("text").alias("abstract"))
    folder = sources.scratch(spark, "submissions")
    sources.write_archives(lines.select("name", F.col("name").alias("id"), "turn", (F.col("item_id") + F.col("turn")).alias("mdate"), content.alias("content")), folder, author="name", order="turn")
    return sources.submissions(spark, folder).select("id", "mdate", "title", F.md5("abstract").alias("abstract"))


@query("select event_id::varchar forum, '~' || user_id signature, event_type tag from events")
def bids_read(spark, sf_dir):
    folder = sources.scratch(spark, "bids")
    e = _table(spark, sf_dir, "events")
    sources.write_dump(e.select(F.col("event_id").cast("string").alias("forum"), F.concat(F.lit("~"), F.col("user_id").cast("string")).alias("signature"), F.col("event_type").alias("tag")), folder)
    return sources.bids(spark, folder)


# Expertise from a file joins what archives have.
@query("select '~' || s_suppkey author, s_suppkey::varchar id, s_name title, 'says \"it\", then' abstract from supplier union all select source, doc_id::varchar, lang, null from documents where source is not null")
def expertise_appended(spark, sf_dir):
    folder = sources.scratch(spark, "expertise")
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("~"), F.col("s_suppkey").cast("string")), F.col("s_suppkey").cast("string"), "s_name", F.lit('says "it", then'))
    sources.write_expertise(s, folder)
    archives = _table(spark, sf_dir, "documents").filter("source is not null").select(F.col("source").alias("author"), F.col("doc_id").cast("string").alias("id"), F.struct(F.col("lang").alias("title"), F.lit(None).cast("string").alias("abstract")).alias("content"))
    return sources.with_expertise(archives, sources.csv_expertise(spark, folder))


@query("select c_custkey::varchar participant, 'p' || c_nationkey paper, round(c_acctbal, 2) expertise from customer union all select c_custkey::varchar, c_mktsegment, c_custkey % 5 + 1.0::double from customer where c_custkey % 3 > 0")
def gold_standard_read(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    some = F.col("c_custkey") % 3 > 0
    wide = c.select(F.col("c_custkey").cast("string").alias("ParticipantID"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("Paper1"), F.when(some, F.col("c_mktsegment")).alias("Paper2"), F.round("c_acctbal", 2).alias("Expertise1"), F.when(some, F.col("c_custkey") % 5 + 1).alias("Expertise2"))
    folder = sources.scratch(spark, "gold")
    sources.write_dump(wide, folder, "csv")
    return sources.gold_standard(spark, folder)


@query("with l as (select (doc_id % 50)::varchar source_id, doc_id::varchar target_id, quality::double label from labels) select source_id, count(*) n, sum(label) label, min(target_id) \"first\" from l group by 1")
def score_labels_read(spark, sf_dir):
    l = _table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).cast("string").alias("source_id"), F.col("doc_id").cast("string").alias("target_id"), F.col("quality").cast("double").alias("label"))
    folder = sources.scratch(spark, "labels")
    sources.write_dump(l, folder)
    total = F.aggregate("targets", F.lit(0.0), lambda s, x: s + F.coalesce(x["label"], F.lit(0.0)))
    made = sources.score_labels(spark, folder)
    return made.select("source_id", F.size("targets").cast("long").alias("n"), total.alias("label"), F.get("targets", F.lit(0))["target_id"].alias("first"))


@query("with t as (select unnest(string_split(lower(text), ' ')) item from documents), c as (select item, count(*) cnt from t where regexp_full_match(item, '[a-z]+') group by 1 having count(*) >= 2) select item, (row_number() over (order by cnt desc, item) + 1)::int idx, cnt from c")
def vocabulary_read(spark, sf_dir):
    from kinfold import functions as K
    from kinfold.operators import retrieval as R

    words = F.filter(K.space_tokens(F.col("text")), lambda w: w.rlike("^[a-z]+$"))
    folder = sources.scratch(spark, "vocabulary")
    sources.write_vocabulary(R.vocabulary(_table(spark, sf_dir, "documents"), "text", words, 2), folder)
    return sources.vocabulary_file(spark, folder)


@query(f"""{_MAX} select sub::varchar a, rev::varchar b, s score from sc""")
def scores_read(spark, sf_dir):
    """Scores through all forms that they are written in: a matrix in long form, dumps and the CSV of results."""
    made = reviewer_scores(spark, sf_dir).select("sub", "rev", "s")
    folder = sources.scratch(spark, "scores")
    sources.write_matrix(made, f"{folder}/matrix")
    sources.write_dump(spark.read.schema(made.schema).parquet(f"{folder}/matrix"), f"{folder}/dump", "parquet")
    sources.write_dump(spark.read.schema(made.schema).parquet(f"{folder}/dump"), f"{folder}/lines.json")
    sources.write_scores(sources.records(spark, f"{folder}/lines.json", "sub long, rev int, s double"), f"{folder}/scores", 4, "s")
    return sources.scores(spark, f"{folder}/scores")
