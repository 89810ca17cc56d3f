"""Training, selection, storage and scoring on a separable fixture."""

import numpy as np
import pytest

from brevia.functions.patterns import LABEL_NAMES
from brevia.operators import model, tokens
from brevia.operators.metrics import evaluate
from brevia.sources.writers import scratch_path

MARKS = {0: "awful bad", 1: "plain report", 2: "great love"}
CONFIG = model.TrainConfig(max_iter=10, num_features=1 << 10)


@pytest.fixture(scope="module")
def posts(spark):
    rows = []
    for i in range(120):
        label = (0, 0, 0, 0, 1, 2)[i % 6]
        split = ("train", "train", "train", "validation", "test")[i % 5]
        rows.append((i, split, label, f"{MARKS[label]} number {i} @x"))
    return spark.createDataFrame(rows, "id long, split string, label int, text string").cache()


def test_defaults():
    config = model.TrainConfig()
    assert config.metric_for_best_model == "f1_macro" and config.greater_is_better
    assert config.early_stopping_patience == 2 and not config.clean
    assert LABEL_NAMES == ("negative", "neutral", "positive")


@pytest.mark.parametrize("changes", [{}, {"clean": True}, {"balance_classes": True}])
def test_fit_and_predict(posts, changes):
    config = model.TrainConfig(max_iter=10, num_features=1 << 10, **changes)
    fitted = model.fit(posts.filter("split = 'train'"), config)
    rows = model.predict(fitted, posts.filter("split = 'test'"))
    assert rows.columns == ["id", "split", "label", "text", "scores", "pred"]
    first = rows.first()
    assert len(first.scores) == 3 and sum(first.scores) == pytest.approx(1.0)
    assert evaluate(rows).first().asDict() == {"accuracy": 1.0, "f1_macro": 1.0}


def test_class_weights(posts):
    weighted = model.with_class_weights(posts).select("label", "weight").distinct()
    found = {r.label: r.weight for r in weighted.collect()}
    assert found == pytest.approx({0: 120 / (3 * 80), 1: 2.0, 2: 2.0})


def test_selection_stops_after_two_fits_without_gain(posts):
    train, check = (posts.filter(f"split = '{s}'") for s in ("train", "validation"))
    best, history = model.select_model(train, check, CONFIG, [0.01, 0.02, 0.03, 0.04, 0.05])
    assert [h["improved"] for h in history] == [True, False, False]
    assert evaluate(model.predict(best, check)).first().f1_macro == history[0]["f1_macro"]


def test_train_saves_the_best_model(spark, posts):
    path = scratch_path(spark, "model")
    result = model.train(posts, path, CONFIG, [0.01])
    assert result == {"accuracy": 1.0, "f1_macro": 1.0}
    again = model.predict(model.load(path), posts.filter("split = 'validation'"))
    assert evaluate(again).first().asDict() == result


def test_training_takes_small_blocks_and_partitions(spark, posts, monkeypatch):
    seen, made = [], model.classifier
    monkeypatch.setattr(model, "classifier", lambda config: seen.append(made(config)) or seen[-1])
    read, stored = [], model._stored_counts
    monkeypatch.setattr(model, "_stored_counts", lambda *a: read.append(stored(*a)) or read[-1])
    model.train(posts, scratch_path(spark, "model"), CONFIG, [0.01])
    assert [16 * c.getMaxBlockSizeInMB() <= 64 for c in seen] == [True]
    sizes = [df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes") for df in read]
    assert len(sizes) == 2 and all(int(s.removesuffix("b")) <= 32 << 20 for s in sizes)


def test_external_model_on_encoded_posts(spark, posts):
    vocabulary = tokens.build_vocabulary(posts, 50)
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    marks = [ids[MARKS[label].split()[0]] for label in range(3)]

    def load():
        def score(batch):
            return np.stack([(batch == m).sum(axis=1) for m in marks], axis=1).astype("float64")

        return score

    encoded = tokens.encode(posts, vocabulary, max_length=16)
    scored = model.predict_external(encoded, load, max_length=16, batch_size=7)
    assert evaluate(scored).first().asDict() == {"accuracy": 1.0, "f1_macro": 1.0}


def test_settings_are_stored_with_the_model(spark, posts):
    noisy = posts.selectExpr("*", "concat(text, ' @a #b https://x.com/', id) AS long").drop(
        "text").withColumnRenamed("long", "text")
    config = model.TrainConfig(max_iter=5, num_features=1 << 10, clean=True)
    fitted = model.fit(noisy.filter("split = 'train'"), config)
    path = scratch_path(spark, "model")
    model.save(fitted, path)
    loaded = model.load(path)
    assert loaded.config == config
    test = noisy.filter("split = 'test'")
    before = {r.id: r.scores for r in model.predict(fitted, test).collect()}
    assert {r.id: r.scores for r in model.predict(loaded, test.drop("label")).collect()} == before


def test_empty_validation_split_is_an_error(posts):
    with pytest.raises(ValueError, match="validation split is empty"):
        model.select_model(posts, posts.filter("false"), CONFIG, [0.01])
