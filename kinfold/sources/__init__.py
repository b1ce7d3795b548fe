"""Readers and writers of archives, submissions, bids, scores and embeddings. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.sources.archive import Archives

CONTENT = "struct<title:string,abstract:string,venueid:string,weight:double>"
NOTE = f"id string, cdate bigint, mdate bigint, pdate bigint, odate bigint, content {CONTENT}"
BID = "forum string, signature string, tag string"
EMBEDDING = "paper_id string, embedding array<double>"
SCORE = "a string, b string, score double"


def _stem() -> Column:
    """File name up to its last dot. Spark gives names as parts of an address; a plus sign stands for itself there."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.[^.]*$", "")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """author, id, dates, content: a row a publication; the file's name is the author."""
    author = F.replace(F.replace(_stem(), F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))
    return spark.read.schema(NOTE).json(folder).select(author.alias("author"), "*").filter("id is not null")


def archive_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows through the data source of archives."""
    spark.dataSource.register(Archives)
    lines = spark.read.format("archives").load(folder)
    return lines.select("author", F.from_json("line", NOTE).alias("n")).select("author", "n.*").filter("id is not null")


def submissions(spark: SparkSession, folder: str | None = None, file: str | None = None) -> DataFrame:
    """id, mdate, title, abstract from a folder of notes (preferred) or one JSON map of id to note. Of a file of several lines the last stands."""
    if folder is not None:
        rows = spark.read.schema(NOTE).json(folder).select(_stem().alias("sub"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "mdate", "content")
        w = Window.partitionBy("sub").orderBy(F.desc("b"), F.desc("i"))
        return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("sub").alias("id"), "mdate", "content.title", "content.abstract")
    text = spark.read.text(file, wholetext=True)
    notes = text.select(F.explode(F.from_json("value", f"map<string,struct<id:string,mdate:bigint,content:{CONTENT}>>")).alias("id", "n"))
    return notes.select("id", "n.mdate", "n.content.title", "n.content.abstract")


def bids(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BID).json(folder)


def csv_expertise(spark: SparkSession, path: str) -> DataFrame:
    """author, id, title, abstract without header."""
    return spark.read.schema("author string, id string, title string, abstract string").csv(path, header=False, multiLine=True, escape='"')


def csv_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, title string, abstract string").csv(path, header=False, multiLine=True, escape='"')


def with_expertise(archives: DataFrame, expertise: DataFrame) -> DataFrame:
    """author, id, title, abstract of archives and of a file of expertise (``csv_expertise``), one after the other."""
    return expertise.unionByName(archives.select("author", "id", "content.title", "content.abstract"))


def inline_submissions(spark: SparkSession, given: list[dict]) -> DataFrame:
    return spark.createDataFrame([(str(x["id"]), x.get("title"), x.get("abstract")) for x in given], "id string, title string, abstract string")


def embeddings(spark: SparkSession, path: str, dimensions: int, *, normalize: bool = False, weights: DataFrame | None = None, cached: str | None = None) -> DataFrame:
    """paper_id, e (zeros where there is none), is_bad. Lines that aren't JSON or lack a field are passed over; another
    length is an error. ``normalize`` draws vectors to unit length; ``weights`` (paper_id, w) adds w, 1 where there is none;
    vectors of ``cached``, a file or folder of the same form beside it, stand for papers that the first doesn't have."""
    found = spark.read.schema(EMBEDDING).json(path).filter("paper_id is not null and embedding is not null")
    if cached is not None:
        before = spark.read.schema(EMBEDDING).json(cached).filter("paper_id is not null and embedding is not null")
        found = found.unionByName(before.join(found.select("paper_id"), "paper_id", "left_anti"))
    made = loaded(found, dimensions, normalize)
    return made if weights is None else made.join(weights.select("paper_id", F.col("w").alias("w__")), "paper_id", "left").withColumn("w", F.coalesce("w__", F.lit(1.0))).drop("w__")


def loaded(rows: DataFrame, dimensions: int, normalize: bool = False) -> DataFrame:
    """paper_id, e, is_bad of rows of paper_id and embedding."""
    from kinfold.functions import l2_normalized
    n = F.size("embedding")
    checked = F.when(n == 0, F.array_repeat(F.lit(0.0), dimensions)).when(n == dimensions, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("embedding of another length: "), "paper_id")).cast("array<double>"))
    made = rows.select("paper_id", checked.alias("e"), (n == 0).alias("is_bad"))
    return made.withColumn("e", l2_normalized(F.col("e"))) if normalize else made


def results(spark: SparkSession, path: str, symmetric: bool, legacy: bool = False) -> DataFrame:
    """entityA, entityB, score of a job's result files, headerless CSV or (``legacy``) JSON lines; which of them is which depends on whether the job was symmetric."""
    from kinfold.operators.topk import roles

    rows = spark.read.schema("submission string, user string, score double").json(path).toDF("a", "b", "score") if legacy else spark.read.schema(SCORE).csv(path)
    return roles(rows, symmetric, row="a", col="b", s="score")


def scores(spark: SparkSession, path: str, first: bool = False) -> DataFrame:
    """a, b, score. A pair that occurs twice is an error, or (``first``) its first row stands."""
    rows = spark.read.schema(SCORE).csv(path)
    w = Window.partitionBy("a", "b")
    if first:
        ordered = rows.withColumn("i", F.monotonically_increasing_id())
        return ordered.withColumn("r", F.row_number().over(w.orderBy("i"))).filter("r = 1").select("a", "b", "score")
    n = F.count("*").over(w)
    return rows.withColumn("score", F.when(n == 1, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("pair occurs twice: "), "a", F.lit(" "), "b")).cast("double")))


def gold_standard(spark: SparkSession, path: str, papers: int = 10) -> DataFrame:
    """participant, paper, expertise from a wide tab-separated file; empty places are left out."""
    wide = spark.read.csv(path, sep="\t", header=True)
    pairs = ", ".join(f"`Paper{i}`, `Expertise{i}`" for i in range(1, papers + 1) if f"Paper{i}" in wide.columns)
    return wide.select(F.col("ParticipantID").alias("participant"), F.expr(f"stack({pairs.count(',') // 2 + 1}, {pairs}) as (paper, expertise)")).filter("paper is not null and expertise is not null").withColumn("expertise", F.col("expertise").cast("double"))


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("item string, idx int, cnt bigint").csv(path, sep="\t")


def group_papers(spark: SparkSession, file: str) -> DataFrame:
    """profile, paper from one JSON map of profile to papers."""
    text = spark.read.text(file, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<struct<id:string>>>")).alias("profile", "p")).select("profile", F.explode("p.id").alias("paper"))


def score_labels(spark: SparkSession, path: str) -> DataFrame:
    """source_id, targets: of each source the (target_id, label) of a JSON lines file, by target."""
    rows = spark.read.schema("source_id string, target_id string, label double").json(path).filter("source_id is not null")
    return rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "label"))).alias("targets"))


def papers(spark: SparkSession, folder: str, texts: str | None = None) -> DataFrame:
    """paper, title, abstract, year of a folder of JSON files named by paper, where all three are known; with a folder of texts, those that have one, and their text."""
    rows = spark.read.schema("title string, abstract string, year int").json(folder).select(_stem().alias("paper"), "*").dropna(subset=["title", "abstract", "year"])
    if texts is None:
        return rows
    found = spark.read.text(texts, wholetext=True).select(_stem().alias("paper"), F.from_json(F.concat(F.lit('{"text":'), "value", F.lit("}")), "text string")["text"].alias("text"))
    return rows.join(found, "paper")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file, or of one with tabs (.tsv, .csv)."""
    reader = spark.read.schema(schema)
    return reader.csv(path, sep="\t") if path.endswith((".tsv", ".csv")) else reader.json(path)


class Dataset:
    """A folder with archives, submissions and bids, and metadata.json where there is one. Tables are read when asked for."""

    def __init__(self, spark: SparkSession, root: str, archives: str = "archives", submissions: str = "submissions", bids: str = "bids"):
        self.spark, self.root, self.names = spark, root.rstrip("/"), {"archives": archives, "submissions": submissions, "bids": bids}

    def metadata(self) -> dict:
        import json

        rows = self.spark.read.text(f"{self.root}/metadata.json", wholetext=True).collect()  # one file, one row
        return json.loads(rows[0]["value"])

    def archives(self) -> DataFrame:
        return archives(self.spark, f"{self.root}/{self.names['archives']}")

    def submissions(self) -> DataFrame:
        return submissions(self.spark, f"{self.root}/{self.names['submissions']}")

    def bids(self) -> DataFrame:
        return bids(self.spark, f"{self.root}/{self.names['bids']}")

    def totals(self) -> DataFrame:
        """One row: archives (publications), authors, submissions."""
        a = self.archives().agg(F.count("*").alias("archives"), F.countDistinct("author").alias("authors"))
        return a.join(self.submissions().agg(F.count("*").alias("submissions")))

    def ids(self, kind: str) -> DataFrame:
        """Ids in order: authors, submissions, or forums that have bids."""
        table, c = {"authors": (self.archives, "author"), "submissions": (self.submissions, "id"), "bids": (self.bids, "forum")}[kind]
        return table().select(F.col(c).alias("id")).distinct().orderBy("id")

    def batches(self, kind: str, size: int = 1000):
        """Rows of a table in lists of ``size``, a partition at a time on the driver."""
        return stream_results({"archives": self.archives, "submissions": self.submissions, "bids": self.bids}[kind](), size)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and the executors share: beneath spark.checkpoint.dir, or a local one where the session is one process."""
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: the driver and the executors need a folder that they share")
        found = f"file://{tempfile.mkdtemp(prefix='kinfold-')}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- writers


def write_archives(rows: DataFrame, folder: str, author: str = "author", order: str = "id", mode: str = "overwrite") -> None:
    """One file an author, named by it, a line a publication in order of ``order``; ``append`` keeps the files of other authors. An author's lines go through one task, which holds none of them."""
    rows.sparkSession.dataSource.register(Archives)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != author]))
    lines = rows.select(F.col(author).cast("string").alias("author"), line.alias("line"), F.col(order).alias("order__"))
    lines.repartition("author").sortWithinPartitions("author", "order__").select("author", "line").write.format("archives").mode(mode).save(folder)


def write_scores(rows: DataFrame, folder: str, digits: int | None = None, s: str = "score") -> None:
    """Headerless CSV in as many files as the plan has tasks; scores half-even at ``digits``."""
    (rows if digits is None else rows.withColumn(s, F.bround(s, digits))).write.mode("overwrite").csv(folder, header=False)


def write_expertise(rows: DataFrame, folder: str) -> None:
    """Headerless CSV of four columns (author, id, title, abstract) that ``csv_expertise`` reads."""
    rows.write.mode("overwrite").csv(folder, header=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_vocabulary(vocab: DataFrame, folder: str) -> None:
    """item, idx, cnt between tabs, as ``vocabulary_file`` reads them."""
    vocab.select("item", F.col("idx").cast("int").alias("idx"), "cnt").write.mode("overwrite").csv(folder, sep="\t", header=False)


def write_matrix(rows: DataFrame, folder: str) -> None:
    """Scores in long form; a matrix is never laid out wide."""
    rows.write.mode("overwrite").parquet(folder)


def write_embeddings(rows: DataFrame, folder: str) -> None:
    rows.select("paper_id", "embedding").write.mode("overwrite").json(folder)


def write_dump(rows: DataFrame, folder: str, kind: str = "json") -> None:
    """json (a row a line), csv (tabs, with a header) or parquet, in place of whatever language's own format."""
    out = rows.write.mode("overwrite")
    {"json": out.json, "parquet": out.parquet, "csv": lambda f: out.csv(f, sep="\t", header=True)}[kind](folder)


def stream_results(rows: DataFrame, chunk: int = 1000):
    """Rows in lists of ``chunk``, a partition at a time on the driver."""
    held = []
    for r in rows.toLocalIterator():
        held.append(r.asDict(recursive=True))
        if len(held) == chunk:
            yield held
            held = []
    if held:
        yield held
