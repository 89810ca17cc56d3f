"""Files, partitions and batches that must not grow beyond what the data needs."""

import glob

from pyspark.sql import functions as F

from brevia.operators import model
from brevia.operators.mapping import BATCH_BYTES, map_batches
from brevia.sources.tables import save_bucketed


def test_a_bucket_is_one_file_for_each_split(spark, tmp_path):
    rows = spark.range(0, 400, 1, 16).selectExpr("id", "IF(id % 4 = 0, 'a', 'b') AS split")
    name = save_bucketed(rows, "rows", "id", 4, by="split", path=f"{tmp_path}/rows")
    assert spark.table(name).count() == 400
    assert len(glob.glob(f"{tmp_path}/rows/split=*/*.parquet")) <= 2 * 4


def test_features_have_partitions_by_size_not_by_the_files_of_the_texts(spark):
    posts = spark.range(0, 600, 1, 300).selectExpr(
        "id", "CAST(id % 3 AS INT) AS label", "concat('word', id % 7) AS text")
    config = model.TrainConfig(num_features=1 << 8)
    _, _, features = model._fit_features(model._training_rows(posts, config), config)
    assert features.count() == 600
    assert features.rdd.getNumPartitions() < 100


def test_one_file_of_counts_goes_to_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(model, "GROUP_BYTES", 1 << 20, raising=False)
    words = "transform(sequence(1, 2000), x -> hex(hash(id, x)))"
    posts = spark.range(0, 400, 1, 1).selectExpr(
        "id", "CAST(id % 3 AS INT) AS label", f"array_join({words}, ' ') AS text")
    names = ["files.maxPartitionBytes", "files.openCostInBytes", "parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(f"spark.sql.{name}") for name in names]
    config = model.TrainConfig()
    counting, _, features = model._fit_features(model._training_rows(posts, config), config)
    rows = [r["count"] for r in features.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 400 and max(rows) <= 250
    check = model._stored_counts(counting, model.prepare(posts.limit(5), config), "label")
    for df in (features, check):
        held = [int(df.sparkSession.conf.get(f"spark.sql.{name}").removesuffix("b")) for name in names]
        assert held[0] <= 64 << 20 and held[2] <= 512
    assert [spark.conf.get(f"spark.sql.{name}") for name in names] == before


def test_blocks_between_two_looks_at_memory_are_small():
    # Spark's storage measures a partition after each 16 blocks.
    assert 16 * model.classifier(model.TrainConfig()).getMaxBlockSizeInMB() <= 64


def test_batches_are_bounded_by_bytes(spark):
    texts = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 5000) AS text")

    def rows(batch):
        return batch[["id"]].assign(n=len(batch))

    old = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        found = map_batches(texts, rows, "n long", ["text"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", old)
    assert sorted(r.id for r in found) == list(range(4000))
    assert max(r.n for r in found) * 5000 <= 2 * BATCH_BYTES


def test_batches_are_freed_when_they_are_done(spark):
    texts = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 100) AS text")

    def alive(batch):
        import gc

        batch["text"].str.len()  # the column holds itself from here on
        frames = sum(type(o).__name__ == "StringMethods" for o in gc.get_objects())
        return batch[["id"]].assign(n=frames)

    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxBytesPerBatch", "maxRecordsPerBatch")]
    old = [spark.conf.get(name) for name in names]
    try:
        spark.conf.set(names[1], "100")
        found = map_batches(texts, alive, "n long", ["text"]).collect()
    finally:
        for name, value in zip(names, old):
            spark.conf.set(name, value)
    # The batch at hand and, in Spark's reader, the last one.
    assert len(found) == 4000 and max(r.n for r in found) <= 2
