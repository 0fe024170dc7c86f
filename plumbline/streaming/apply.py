"""Fitted pipelines on streams: transforms and predictions are projections, so they need no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.pipeline import FittedPipeline
from plumbline.schema import FeatureSchema


def read_features(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def predict_stream(model: FittedPipeline, stream: DataFrame, columns: Sequence[str], schema: FeatureSchema,
                   name: str = "prediction") -> DataFrame:
    """Predictions beside the stream's rows. Null features are missing, as on admission."""
    nan = F.lit(float("nan"))
    filled = stream.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), nan) for c in columns})
    return model.predict(filled, columns, schema, name)
