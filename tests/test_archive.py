"""Archives by file, and venues' rules as a table."""

import pytest
from kinfold import sources
from kinfold.operators import dataset
from kinfold.sources import archive
from pyspark.sql import functions as F


def notes(spark, rows):
    df = spark.createDataFrame(rows, "author string, id string, title string, abstract string, mdate long").repartition(3)
    return df.select("author", "id", "mdate", F.struct("title", "abstract").alias("content"))


def found(df):
    return sorted((r.author, r.id, r.content.title, r.content.abstract, r.mdate) for r in df.collect())


ROWS = [("~Ann_B.C1", f"n{i}", f"t{i}", "a\nb \U0001f600" if i % 2 else None, i) for i in range(50)] + [("x/y%2F z@q.org", "n1", "", "é", None), ("~Ann_B.C1", "n1", "again", None, 7), ("~b", "m", None, None, None)]


def test_archives_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    sources.write_archives(notes(spark, ROWS), folder)
    assert sorted(p.name for p in (tmp_path / "archives").iterdir()) == sorted(archive.file_name(a) for a in {r[0] for r in ROWS})
    want = sorted(((a, i, t, x, m) for a, i, t, x, m in ROWS), key=str)
    for df in (sources.archives(spark, folder), sources.archive_lines(spark, folder)):
        assert sorted(found_rows(df), key=str) == want
        assert df.columns.count("author") == 1
    lines = (tmp_path / "archives" / archive.file_name("~Ann_B.C1")).read_text().splitlines()
    assert len(lines) == 51 and lines == sorted(lines, key=lambda x: x.split('"id":"')[1].split('"')[0])


def found_rows(df):
    return [(r.author, r.id, r.content.title, r.content.abstract, r.mdate) for r in df.collect()]


def test_a_new_archive_takes_the_old_ones_place_and_appends_keep_others(spark, tmp_path):
    folder = str(tmp_path / "archives")
    sources.write_archives(notes(spark, ROWS), folder)
    sources.write_archives(notes(spark, [("~b", "new", "t", "x", 1), ("~c", "c", "t", "x", 1)]), folder)
    assert {r[:2] for r in found_rows(sources.archives(spark, folder))} == {("~b", "new"), ("~c", "c")}
    sources.write_archives(notes(spark, [("~c", "d", "t", "x", 1)]), folder, mode="append")
    assert {r[:2] for r in found_rows(sources.archive_lines(spark, folder))} == {("~b", "new"), ("~c", "d")}


def test_a_failed_write_leaves_the_archive_as_it_was(spark, tmp_path):
    folder = str(tmp_path / "archives")
    sources.write_archives(notes(spark, ROWS[:3]), folder)
    with pytest.raises(Exception, match="no author"):
        sources.write_archives(notes(spark, [*ROWS, (None, "z", "t", "x", 1)]), folder)
    assert len(found_rows(sources.archives(spark, folder))) == 3
    assert not [p for p in (tmp_path / "archives").iterdir() if p.name.startswith("_staging")]
    sources.write_archives(notes(spark, []), folder)
    assert found_rows(sources.archive_lines(spark, folder)) == []


def test_rules_as_a_table(spark):
    rules = [dataset.WeightRule(0.5, submitted=True), dataset.WeightRule(2, value="v/c"), dataset.WeightRule(3, prefix="v/"), dataset.WeightRule(4, prefix="v/c/long"), dataset.WeightRule(5, value="v/c"), dataset.WeightRule(6, value="é")]
    rows = [("v/c", True), ("v/c/longer", None), ("v", True), ("w", False), (None, True), (None, None), ("é", True), ("v/c", True), ("", False)]
    df = spark.createDataFrame([(i, v, s, "x") for i, (v, s) in enumerate(rows)], "id int, v string, s boolean, key string")
    got = {r.id: r.w for r in dataset.with_venue_weight(df, dataset.rule_table(spark, rules), prefix=F.col("v"), value=F.col("v"), submitted=F.col("s")).collect()}
    want = {r.id: r.w for r in df.select("id", dataset.venue_weight(F.col("v"), F.col("s"), rules).alias("w")).collect()}
    assert got == want and got[1] == 3.0 and len(got) == len(rows)
    none = dataset.with_venue_weight(df, dataset.rule_table(spark, []), prefix=F.col("v"), value=F.col("v"), submitted=F.col("s"))
    assert {r.w for r in none.collect()} == {1.0} and none.columns == ["id", "v", "s", "key", "w"]
