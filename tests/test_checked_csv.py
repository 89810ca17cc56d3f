"""CSV rows that do not fit, types that keep every text, and the cleaning job over both."""

import pytest
from pyspark.sql import functions as F

from brevia.operators.cleaning import clean_file
from brevia.sources.checked_csv import (
    RECORD, lossless_schema, quarantine_broken, read_records, read_strings,
)
from brevia.sources.readers import read_posts

SCHEMA = "id BIGINT, label INT, text STRING"
GOOD = 'id,label,text\n1,2,"a ""q""\nb"\n5,,""\n6,1,z\n'
BROKEN = ['2,1,x,EXTRA', '3,0', '4,abc,"t,u"', '7,1,"two\nlines",more']


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "posts.csv"
    path.mkdir()
    (path / "a.csv").write_text(GOOD)
    (path / "b.csv").write_text("id,label,text\n" + "\n".join(BROKEN) + "\n\n8,0,end")
    return str(path)


@pytest.mark.parametrize("columns", [["id"], ["text"], ["id", "label", "text"]])
def test_broken_rows_end_the_job_whatever_is_read(spark, folder, columns):
    with pytest.raises(Exception, match="(?s)MALFORMED|malformed"):
        read_posts(spark, folder, schema=SCHEMA).select(*columns).collect()


def test_broken_rows_are_set_aside_whole(spark, folder, tmp_path):
    apart = str(tmp_path / "broken")
    good, counts = quarantine_broken(read_records(spark, folder, SCHEMA), apart)
    assert counts == (4, 4)
    assert sorted(tuple(r) for r in good.collect()) == [
        (1, 2, 'a "q"\nb'), (5, None, ""), (6, 1, "z"), (8, 0, "end")]
    assert good.count() == 4 and good.select("text").count() == 4
    rows = spark.read.parquet(apart).collect()
    assert sorted(r[RECORD] for r in rows) == BROKEN
    assert all(r.file.endswith("b.csv") for r in rows)


def test_no_row_is_broken(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(GOOD)
    good, counts = quarantine_broken(read_records(spark, str(path), SCHEMA), str(tmp_path / "none"))
    assert counts == (3, 0) and good.count() == 3
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    assert read_posts(spark, str(path), schema=SCHEMA).count() == 3


def test_record_column_may_not_be_taken(spark, folder):
    with pytest.raises(ValueError, match=RECORD):
        read_records(spark, folder, f"id INT, {RECORD} STRING")


def test_types_give_back_every_text(spark):
    rows = [("7", "007", "1.5", "1.50", "true", "2020-02-29", "3000000000", "", None, "-0", "x" * 99),
            (None, "8", "0.0", "2.0", "false", "1999-12-31", "1", "4", None, "1", "1")]
    names = list("abcdefghijk")
    df = spark.createDataFrame(rows, ", ".join(f"{n} STRING" for n in names))
    found = {f.name: f.dataType.simpleString() for f in lossless_schema(df, keep=("k",))}
    assert found == dict(zip(names, ["int", "string", "double", "string", "boolean", "date", "bigint",
                                     "string", "string", "string", "string"]))


def test_cleaning_keeps_codes_and_sets_broken_rows_aside(spark, tmp_path):
    path, target = tmp_path / "in.csv", str(tmp_path / "out.parquet")
    path.write_text('code,text,n\n007,Hi @Bob,1\n008,"#Tag, x",2\n009,cut\n010,a,b,c\n')
    with pytest.raises(Exception, match="(?s)MALFORMED|malformed"):
        clean_file(spark, str(path), target)
    counts = clean_file(spark, str(path), target, mode="overwrite", quarantine=str(tmp_path / "q"))
    assert counts == (2, 2)
    back = spark.read.parquet(target)
    assert [f.dataType.simpleString() for f in back.schema] == ["string", "string", "int", "string"]
    assert sorted(tuple(r) for r in back.collect()) == [
        ("007", "Hi @Bob", 1, "hi @user"), ("008", "#Tag, x", 2, "tag, x")]
    assert sorted(r[RECORD] for r in spark.read.parquet(str(tmp_path / "q")).collect()) == [
        "009,cut", "010,a,b,c"]
    assert read_strings(spark, str(path), lenient=True).filter(F.col("code") == "007").count() == 1
