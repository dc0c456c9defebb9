"""Fraud probability from a model: Spark ML pipelines, ONNX files, and swapping models in a stream."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.operators.scoring import clamp
from tallyguard.session import cut_lineage

try:
    import onnxruntime
except ImportError:  # optional
    onnxruntime = None

# Inputs of the model, in order.
VECTOR_COLUMNS = [
    "amount",
    "avg_amount_7d",
    "tx_count_1h",
    "tx_count_6h",
    "tx_count_24h",
    "distinct_merchants_24h",
    "velocity_score",
    "country_changed",
    "hours_since_last",
]
MAX_MODEL_BYTES = 256 * 1024 * 1024


def feature_values() -> list[Column]:
    plain = [F.col(c) for c in VECTOR_COLUMNS[:7]]
    changed = F.when(F.col("country_changed"), 1.0).otherwise(0.0)
    hours = F.col("time_since_last_tx_ms") / F.lit(3_600_000.0)
    return [value.cast("float") for value in [*plain, changed, hours]]


def feature_vector() -> Column:
    """The nine model inputs as 32-bit floats."""
    return F.array(*feature_values())


# --- Spark ML ---------------------------------------------------------------------------------


def train_trees(labelled: DataFrame, label: str = "is_confirmed_fraud", rounds: int = 10, depth: int = 3):
    """Boosted trees on labelled feature rows; returns a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"),
        *[value.cast("double").alias(f"x_{name}") for name, value in zip(VECTOR_COLUMNS, feature_values())],
    )
    rows = cut_lineage(rows)  # training reads them once per round
    inputs = VectorAssembler(inputCols=[f"x_{name}" for name in VECTOR_COLUMNS], outputCol="x", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7)
    return Pipeline(stages=[inputs, trees]).fit(rows)


def with_ml_probability(df: DataFrame, model, column: str = "p") -> DataFrame:
    """Add the fitted pipeline's probability of fraud; null without a model."""
    if model is None:
        return df.withColumn(column, F.lit(None).cast("double"))
    from pyspark.ml.functions import vector_to_array

    named = {f"x_{name}": value.cast("double") for name, value in zip(VECTOR_COLUMNS, feature_values())}
    scored = model.transform(df.withColumns(named))
    fraud = vector_to_array(F.col("probability"))[1]
    return scored.select(*df.columns, clamp(fraud, 0.0, 1.0).alias(column))


# --- ONNX -------------------------------------------------------------------------------------


def read_model(spark: SparkSession, path: str) -> bytes | None:
    """Bytes of a model file in any file system Spark reads; None only where there is none. A file
    above the limit, or one that cannot be read, is an error: scoring without it would go unseen."""
    row = _head_if_there(lambda: spark.read.format("binaryFile").load(path).select("length"))
    if row is None:
        return None
    if row["length"] > MAX_MODEL_BYTES:
        raise ValueError(f"model {path} of {row['length']} bytes is above the limit of {MAX_MODEL_BYTES}")
    return bytes(spark.read.format("binaryFile").load(path).select("content").head()["content"])


def _head_if_there(frame: Callable[[], DataFrame]):
    """First row; None where the path does not exist. Any other failure is raised."""
    try:
        return frame().head()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _fraud_column(outputs: list[np.ndarray]) -> np.ndarray:
    """Second column where there are two (class probabilities), else the first."""
    best = np.asarray(outputs[-1], dtype="float64")
    best = best.reshape(len(best), -1)
    return np.clip(best[:, 1] if best.shape[1] == 2 else best[:, 0], 0.0, 1.0)


def onnx_probability(spark: SparkSession, model: bytes | Broadcast | None, vector: Column) -> Column:
    """Probability by an ONNX model, one session per Python worker and Arrow batches as input.

    Null where the model is missing or fails on the batch, and, with a warning, where there is a
    model but no ``onnxruntime``.
    """
    if model is not None and onnxruntime is None:
        warnings.warn("onnxruntime is not installed: the model is not used", RuntimeWarning, stacklevel=2)
    if model is None or onnxruntime is None:
        return F.lit(None).cast("double")
    shared = model if isinstance(model, Broadcast) else share_model(spark, model)

    @F.pandas_udf("double")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            session = onnxruntime.InferenceSession(shared.value, options, providers=["CPUExecutionProvider"])
            name = session.get_inputs()[0].name
        except Exception:
            session = name = None
        for batch in batches:
            result = np.full(len(batch), np.nan)
            if session is not None and len(batch):
                try:
                    result = _fraud_column(session.run(None, {name: np.stack(batch.to_list()).astype("float32")}))
                except Exception:
                    pass
            yield pd.Series(result).astype("Float64").where(~np.isnan(result))

    return infer(vector)


def share_model(spark: SparkSession, model: bytes) -> Broadcast:
    """The model's bytes on all executors; their size is checked."""
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"model of {len(model)} bytes is above the limit of {MAX_MODEL_BYTES}")
    return spark.sparkContext.broadcast(model)


def publish_model(spark: SparkSession, folder: str, name: str, model: bytes) -> None:
    """Put a model file into a folder of any file system Spark knows. It gets its name when it is
    whole, so that no batch reads a part of it."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    part, whole = paths(f"{folder}/_{name}.part"), paths(f"{folder}/{name}.onnx")
    system = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(part, True)
    try:
        out.write(bytearray(model))
    finally:
        out.close()
    if not system.rename(part, whole):
        raise OSError(f"model {whole.toString()} is already there")


def _newest(spark: SparkSession, folder: str):
    """Path and time of the newest model file; None where there is none."""
    return _head_if_there(
        lambda: spark.read.format("binaryFile").option("pathGlobFilter", "*.onnx").load(folder).select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path"))
    )


def newest_model(spark: SparkSession, folder: str) -> bytes | None:
    """Newest model file of a folder; called per micro-batch, a new file takes over without a stop."""
    row = _newest(spark, folder)
    return read_model(spark, row["path"]) if row else None


class ModelVersions:
    """The newest model of a folder, shared once per version: micro-batches of one version use the
    same broadcast, and it is destroyed when the next version stands in for it."""

    def __init__(self, folder: str):
        self.folder = folder
        self.version: tuple | None = None
        self.shared: Broadcast | None = None

    def current(self, spark: SparkSession) -> Broadcast | None:
        """Call once at the start of a micro-batch, when nothing of the one before still runs."""
        row = _newest(spark, self.folder)
        version = tuple(row) if row else None
        if version != self.version:
            model = read_model(spark, row["path"]) if row else None
            fresh = None if model is None else share_model(spark, model)
            if self.shared is not None:
                self.shared.destroy()
            self.version, self.shared = version, fresh
        return self.shared
