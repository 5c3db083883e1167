"""Means, deviations and scores over relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(df: DataFrame, means: Sequence[str] = (), length: str | None = None) -> DataFrame:
    """One row: the mean of each column; of ``length`` (seconds) mean, population deviation and sum in hours."""
    parts = [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in means]
    if length:
        x = F.col(length).cast("double")
        parts += [F.avg(x).alias(f"mean_{length}"), F.stddev_pop(x).alias(f"std_{length}"), (F.sum(x) / 3600).alias("hours")]
    return df.agg(F.count("*").alias("n_rows"), *parts)


def mean_by(df: DataFrame, key: str, value: str, name: str = "mean") -> DataFrame:
    return df.groupBy(key).agg(F.avg(F.col(value).cast("double")).alias(name))


def mean_scores(scores: DataFrame, score: str = "COMET") -> DataFrame:
    """(key, mean) for rows of (key, score)."""
    return mean_by(scores, "key", score, score)


def total(df: DataFrame, column: str, name: str = "total") -> DataFrame:
    return df.agg(F.sum(column).alias(name))
