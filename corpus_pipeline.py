"""A corpus in five stages: quality rules, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written and read
again. All but the last return the columns of ``documents``, whatever else the table has: operators see a document as
one column beside its text, so no other column can clash with theirs. An empty table goes through every stage and gives an
empty result; texts of any length are taken whole. Each stage says what becomes of nulls, repeated rows and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm import jaccard, language, packing, quality, secrets
from kinfold.llm.common import discard, documents, small_enough, tables_written, written
from kinfold.llm.queries import vocabulary


#: Words of a shingle, and the similarity (of the first to the second) that makes near duplicates; the contract of op8 holds for its query alone.
SHINGLE, RATIO = 5, (80, 100)
#: Bytes of chunks that a worker keeps in the packing stage, beside what the stages before have left in it.
KEPT_BYTES = 128 << 20


def _carried(docs: DataFrame) -> DataFrame:
    """The whole row under one name, so that no column meets one that an operator makes; and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__"), F.col("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learnt list keep. A null or empty text has no words and goes; repeated rows, and rows without doc_id, are judged each by its text."""
    rules = quality.learn_from(docs, documents(spark, sf_dir, "labels"))
    measured = quality.with_statistics(_carried(docs), keep=["row__"])
    return quality.judged(measured, rules).filter("kept").select("row__.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those of the labels, by their text, declared language and source. Null lang or source is no evidence; a null or empty text goes; repeated rows are judged each. Of equally likely languages the first by name is taken."""
    model = language.fit(docs)
    evidence = [F.lower("lang").alias("declared"), language.host_of(F.col("source")).alias("host")]
    slim = written(language.scored(docs.select("text", *evidence), model, keep=["declared", "host"]), "scores")
    found = language.gather(slim, model)
    rows = _carried(docs).select("row__", "text", F.lower("row__.lang").alias("declared"), language.host_of(F.col("row__.source")).alias("host"))
    return language.fuse(language.scored(rows, model, keep=["row__", "declared", "host"]), model, found).filter("kept").select("row__.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a Jaccard similarity of 0.8 or more over five words, the one with the least doc_id.

    Rows without doc_id stay, but link others. Rows that share a doc_id and a text are one document, of which one row
    stays. Where texts differ under one doc_id, the one of least digest has the id, and the others are documents after
    all ids, so that none goes without a representative. A text without words links with nothing and stays.
    """
    shared = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    shared = written(shared, "shared")
    if shared.isEmpty():
        return _of_components(docs, "doc_id").select(docs.columns)
    side = F.broadcast(shared) if small_enough(shared, 24) else shared
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    one = docs.join(side, "doc_id", "left_semi").withColumn("digest__", F.when(F.col("text").isNotNull(), digest).otherwise(""))
    one = one.dropDuplicates(["doc_id", "digest__"])
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest__")) == 1
    late = F.lit(1 << 62) + F.xxhash64("doc_id", "digest__").bitwiseAND((1 << 61) - 1)
    one = one.withColumn("place__", F.when(first, F.col("doc_id").cast("long")).otherwise(late)).drop("digest__")
    rest = docs.join(side, "doc_id", "left_anti").withColumn("place__", F.col("doc_id").cast("long"))
    names = [*docs.columns, "place__"]
    return _of_components(written(rest.select(names).union(one.select(names)), "places"), "place__").select(docs.columns)


def _of_components(docs: DataFrame, doc_id: str) -> DataFrame:
    """The documents that have the least id of their component, and those without id."""
    found = jaccard.near_duplicates(docs, doc_id, k=SHINGLE, ratio=RATIO)
    gone = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)), "gone")
    return docs.join(F.broadcast(gone) if small_enough(gone, 24) else gone, doc_id, "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, their secrets replaced by marks. A null or empty text stays as it is; repeated rows are treated each; of spans that overlap the joined stretch goes."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is its end mark; repeated rows, and rows without doc_id, are packed each."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id"], kept_bytes=KEPT_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The learnt list, the language model and the tokens can't be had from SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        at = tables_written()
        made = written(stage(spark, docs, sf_dir), name)
        discard(spark, at)
        docs = made
    return docs
