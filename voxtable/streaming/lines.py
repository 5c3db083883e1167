"""Structured Streaming: the same column expressions as in batch, and mini-batch k-means by ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxtable.functions.text import normalize_basic
from voxtable.functions.units import collapse_chars
from voxtable.operators.kmeans import MiniBatch, codebook
from voxtable.operators.relational import drop_bad_conversations


def lines(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", most_files).text(path)


def collapsed(stream: DataFrame, column: str = "value") -> DataFrame:
    return stream.withColumn(column, collapse_chars(column))


def normalized(stream: DataFrame, column: str = "value") -> DataFrame:
    return stream.withColumn(column, normalize_basic(column))


def good_conversations(stream: DataFrame, column: str = "value") -> DataFrame:
    """Lines whose JSON conversation has no empty turn."""
    kind = "conversations array<struct<`from`:string,value:string>>"
    rows = stream.withColumn("__x", F.from_json(column, kind)).withColumn("conversations", F.col("__x.conversations"))
    return drop_bad_conversations(rows).drop("__x", "conversations")


def train(stream: DataFrame, vector: str, model: MiniBatch, checkpoint: str, save: Callable[[int, DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """Updates the model with each micro-batch. A batch that is run again after a failure is skipped by its number."""
    seen = {"last": -1}

    def step(batch: DataFrame, number: int) -> None:
        if number <= seen["last"]:
            return
        model.update(batch, vector)
        seen["last"] = number
        if save:
            save(number, codebook(batch.sparkSession, np.array(model.centers)))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
