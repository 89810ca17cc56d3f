"""Training, selection, scoring and storage of the three-class text classifier."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import clean_text
from ..functions.patterns import LABEL_NAMES, TOKEN
from ..functions.text import argmax
from ..sources.writers import scratch_path, write_parquet
from .metrics import evaluate
from .tokens import MAX_LENGTH


@dataclass(frozen=True)
class TrainConfig:
    """Settings of one fit and of the choice among fits."""

    max_iter: int = 30
    reg_param: float = 0.01
    num_features: int = 1 << 16
    min_doc_freq: int = 1
    clean: bool = False
    balance_classes: bool = False
    metric_for_best_model: str = "f1_macro"
    greater_is_better: bool = True
    early_stopping_patience: int = 2


@dataclass(frozen=True)
class TextModel:
    """A fitted pipeline with the settings that its input has to be prepared by."""

    pipeline: PipelineModel
    config: TrainConfig


DEFAULT_GRID = (0.1, 0.01, 0.001)
# The solver makes and adds up a matrix as large as the model for each block of sparse rows.
# It keeps the blocks in memory, which Spark measures after every 16th of a task only, and
# arrays of more than half a region of Java's heap (2 MB in 6 GB) take whole regions.
BLOCK_MB = 2.0
# Stored counts are about five times as large as blocks, and a task that writes its blocks to
# disk or reads them again may hold all of them beside the memory that Spark measures.
PART_BYTES = 32 << 20
# A row group goes to one partition, whatever the partitions' size.
GROUP_BYTES = 8 << 20
# Of rows with thousands of terms, Spark's usual batch of 4,096 is some hundred MB.
BATCH_ROWS = 256


def prepare(df: DataFrame, config: TrainConfig) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    prepared = df.withColumn("model_text", clean_text(text) if config.clean else text)
    return prepared.withColumn("class_label", F.col("label").cast("double"))


def feature_stages(config: TrainConfig) -> list:
    """Words and word pairs, hashed, weighted by rarity."""
    return [
        RegexTokenizer(inputCol="model_text", outputCol="words", pattern=TOKEN, gaps=False,
                       toLowercase=True),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        HashingTF(inputCol="terms", outputCol="counts", numFeatures=config.num_features),
        IDF(inputCol="counts", outputCol="features", minDocFreq=config.min_doc_freq),
    ]


def classifier(config: TrainConfig) -> LogisticRegression:
    regression = LogisticRegression(
        featuresCol="features", labelCol="class_label", family="multinomial",
        maxIter=config.max_iter, regParam=config.reg_param, maxBlockSizeInMB=BLOCK_MB,
    )
    return regression.setWeightCol("weight") if config.balance_classes else regression


def with_class_weights(df: DataFrame) -> DataFrame:
    """Weight n / (classes x rows of the class), from at most one count per class."""
    known = df.filter(F.col("label").isin(*range(len(LABEL_NAMES))))
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.lit(0.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


def _training_rows(train: DataFrame, config: TrainConfig) -> DataFrame:
    rows = prepare(train, config)
    return with_class_weights(rows) if config.balance_classes else rows


def _count_session(spark: SparkSession) -> SparkSession:
    """A session to read counts by, whose partitions and batches are small; the caller's
    own settings stay as they are."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(PART_BYTES))
    session.conf.set("spark.sql.files.openCostInBytes", str(PART_BYTES >> 7))
    session.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    return session


def _stored_counts(counting: PipelineModel, rows: DataFrame, *columns: str) -> DataFrame:
    """Term counts in the shared scratch folder, as they are read several times.

    Texts are cut into terms once.  The solver sends its sums, which are as large as the
    model, for each partition and round: of these files, however many, readers make
    partitions by size, and memory is left to the solver's own copy.  Row groups, partitions
    and batches are small, so what a task holds beside that copy does not follow the input.
    """
    kept = [c for c in (*columns, "weight") if c in rows.columns]
    path = scratch_path(rows.sparkSession, "term-counts")
    counts = counting.transform(rows).select(*kept, "counts")
    write_parquet(counts, path, group_bytes=GROUP_BYTES)
    return _count_session(rows.sparkSession).read.schema(counts.schema).parquet(path)


def _fit_features(rows: DataFrame, config: TrainConfig) -> tuple[PipelineModel, PipelineModel, DataFrame]:
    """The stages up to the counts, all stages, and the features of the training rows."""
    *stages, weighting = feature_stages(config)
    counting = PipelineModel(stages=stages)
    counts = _stored_counts(counting, rows, "class_label")
    weights = weighting.fit(counts)
    return counting, PipelineModel(stages=[*stages, weights]), weights.transform(counts).drop("counts")


def fit(train: DataFrame, config: TrainConfig = TrainConfig()) -> TextModel:
    """Fit features and classifier on a training table with ``text`` and ``label``."""
    _, features, train_set = _fit_features(_training_rows(train, config), config)
    model = classifier(config).fit(train_set)
    return TextModel(PipelineModel(stages=[*features.stages, model]), config)


def predict(model: TextModel, df: DataFrame) -> DataFrame:
    """Class probabilities as ``scores`` and the best class as ``pred``, row by row."""
    labelled = df if "label" in df.columns else df.withColumn("label", F.lit(None).cast("int"))
    scored = model.pipeline.transform(prepare(labelled, model.config))
    scores = vector_to_array("probability")
    return scored.select(*df.columns, scores.alias("scores")).withColumn(
        "pred", argmax(F.col("scores"))
    )


def predict_external(
    df: DataFrame, make_predict_fn: Callable, input_cols: Sequence[str] = ("input_ids",),
    max_length: int = MAX_LENGTH, batch_size: int = 32,
) -> DataFrame:
    """``scores`` and ``pred`` from a model that Spark does not know, batch by batch.

    ``make_predict_fn()`` loads the model once per Python worker and returns a function
    from arrays of shape (rows, max_length), one per input column, to an array of
    shape (rows, classes).
    """
    score = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[max_length]] * len(input_cols),
    )
    scored = df.withColumn("scores", score(*input_cols))
    return scored.withColumn("pred", argmax(F.col("scores")))


def select_model(
    train: DataFrame, validation: DataFrame, config: TrainConfig = TrainConfig(),
    reg_params: Sequence[float] = DEFAULT_GRID,
) -> tuple[TextModel, list[dict]]:
    """Fit the grid in order, keep the best validation score, stop after
    ``early_stopping_patience`` fits without gain.  Features are computed once.
    """
    counting, features, train_set = _fit_features(_training_rows(train, config), config)
    check_counts = _stored_counts(counting, prepare(validation, config), "label")
    check_set = features.stages[-1].transform(check_counts)
    sign = 1 if config.greater_is_better else -1
    best, best_score, waited, history = None, None, 0, []
    for reg_param in reg_params:
        model = classifier(replace(config, reg_param=reg_param)).fit(train_set)
        scored = model.transform(check_set).withColumn(
            "pred", argmax(vector_to_array("probability"))
        )
        result = evaluate(scored).first().asDict()
        if result[config.metric_for_best_model] is None:
            raise ValueError("no rows to select the model by: the validation split is empty")
        score = sign * result[config.metric_for_best_model]
        improved = best_score is None or score > best_score
        history.append({"reg_param": reg_param, **result, "improved": improved})
        if improved:
            best, best_score, waited = model, score, 0
        else:
            waited += 1
            if waited >= config.early_stopping_patience:
                break
    chosen = next(h for h in reversed(history) if h["improved"])
    kept = replace(config, reg_param=chosen["reg_param"])
    return TextModel(PipelineModel(stages=[*features.stages, best]), kept), history


def train(
    posts: DataFrame, output_dir: str, config: TrainConfig = TrainConfig(),
    reg_params: Iterable[float] = DEFAULT_GRID,
) -> dict[str, float]:
    """Select on the validation split of a table with splits, save, return its metrics."""
    parts = {name: posts.filter(F.col("split") == name) for name in ("train", "validation")}
    model, history = select_model(parts["train"], parts["validation"], config, list(reg_params))
    save(model, output_dir)
    best = next(h for h in reversed(history) if h["improved"])
    return {name: best[name] for name in ("accuracy", "f1_macro")}


def save(model: TextModel, path: str) -> None:
    """The pipeline and, beside it, its settings."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(asdict(model.config)),)], "config STRING").write.mode(
        "overwrite").parquet(f"{path}/config")


def load(path: str) -> TextModel:
    stored = SparkSession.active().read.parquet(f"{path}/config").first()["config"]
    return TextModel(PipelineModel.load(f"{path}/pipeline"), TrainConfig(**json.loads(stored)))
