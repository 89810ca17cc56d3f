"""Every registered query against its SQL in DuckDB, and the shape of the plans."""

import os

import pytest

import __spark_entry__ as entry_points

duckdb = pytest.importorskip("duckdb")

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}
QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    result = tables.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    types = dict(zip(result.columns, map(str, result.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    order = [result.columns.index(c) for c in columns]
    expected = sorted(repr([row[i] for i in order]) for row in result.fetchall())
    found = sorted(repr([row[c] for c in columns]) for row in df.collect())
    assert found == expected and found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "text_cleaned" in df.columns


@pytest.mark.parametrize("name", ["clean_text", "noise_profile", "class_balance", "eval_metrics",
                                  "length_stats", "handle_emojis", "parity_check"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Cartesian", "NestedLoop", "ArrowEval", "BatchEval"))


def test_counting_classes_reads_no_text(spark):
    plan = QUERIES["class_balance"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


@pytest.mark.parametrize("name", ["eval_metrics", "argmax_pred", "confusion_matrix", "head_rows",
                                  "classification_report", "sample_per_class", "eval_subset",
                                  "baseline_report"])
def test_joins_shuffle_no_text(spark, name):
    """Of the exchanges that joins and aggregates need, none carries the posts' texts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # What comes after a semi join with the chosen ids are the few rows that are returned.
    head = name in ("head_rows", "eval_subset", "baseline_report")
    nodes = [part for part in plan.split("\n\n") if "ENSURE_REQUIREMENTS" in part]
    if head:
        nodes = [part for part in nodes if "text#" not in part or "hashpartitioning" not in part]
    assert nodes and (head or all("text#" not in part.split("Arguments")[0] for part in nodes))
