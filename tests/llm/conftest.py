import random

import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, lang) rows."""
    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", "'x' AS block", "1 AS first", "2 AS score") if extra else df

    return make


@pytest.fixture(scope="session")
def words():
    """Random words, the same ones for a seed."""
    def make(n, seed=0, letters="abcdefghij"):
        draw = random.Random(seed)
        return ["".join(draw.choices(letters, k=draw.randint(2, 6))) for _ in range(n)]

    return make


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (None, "no id here"),
       (904, "é ü ß " * 3), (905, "long " * 30_000)]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
