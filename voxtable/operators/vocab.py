"""Vocabulary extension and the start values of new embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.functions.numbers import padded_size
from voxtable.operators import vectors
from voxtable.operators.relational import with_index

SCALE = 1e-5


def new_types(candidates: DataFrame, vocabulary: DataFrame, piece: str = "piece") -> DataFrame:
    """Candidates that the vocabulary doesn't have; repeated candidates stay repeated."""
    return candidates.join(vocabulary.select(piece), piece, "left_anti")


def extend(vocabulary: DataFrame, specials: Sequence[str], types: DataFrame, kind: str = "bpe", piece: str = "piece") -> DataFrame:
    """(rank, piece, score, special): the vocabulary, then the special pieces, then the new types in the order of ``idx``.

    For ``bpe`` scores go on downwards by 1 from the last one; otherwise new pieces have score 0. New types are numbered by
    ranges, so they may be more than one task sorts.
    """
    spark = vocabulary.sparkSession
    last = vocabulary.agg(F.max("rank").alias("__rank"), F.max_by("score", "rank").alias("__score"))
    extra = spark.createDataFrame([(i + 1, p, True) for i, p in enumerate(specials)], "__n long, piece string, special boolean").withColumnRenamed("piece", piece)
    more = with_index(types.select(F.col("idx").cast("long").alias("__o"), piece), "__o", piece, name="__n")
    added = extra.unionByName(more.select((F.col("__n") + 1 + len(specials)).alias("__n"), piece, F.lit(False).alias("special")))
    score = F.col("__score") - F.col("__n") if kind == "bpe" else F.lit(0.0)
    added = added.crossJoin(F.broadcast(last)).select((F.col("__rank") + F.col("__n")).cast("long").alias("rank"), piece, score.cast("double").alias("score"), "special")
    return vocabulary.select(F.col("rank").cast("long"), piece, F.col("score").cast("double"), F.lit(False).alias("special")).unionByName(added)


def extended_size(n: int, added: int, multiple: int = 64) -> int:
    return padded_size(n + added, multiple)


def new_rows(embeddings: DataFrame, size: int, vector: str = "vec", seed: int = 43, scale: float = SCALE) -> DataFrame:
    """(id, vec) for ids from the current count to ``size`` - 1: seeded draws of N(mean, scale * covariance).

    Mean and covariance are D and D * D numbers, and the draws as many rows as are added: model-sized, on the driver.
    """
    spark, n = embeddings.sparkSession, embeddings.count()
    mean = np.array([r[1] for r in vectors.mean_vector(embeddings, vector).orderBy("dim").collect()])
    cov = np.zeros((len(mean), len(mean)))
    for i, j, c in vectors.covariance(embeddings, vector, scale).collect():
        cov[i, j] = c
    draws = np.random.default_rng(seed).multivariate_normal(mean, cov, size=max(0, size - n), method="eigh")
    return spark.createDataFrame([(n + k, [float(x) for x in row]) for k, row in enumerate(draws)], f"id long, {vector} array<float>")


def extend_embeddings(embeddings: DataFrame, size: int, vector: str = "vec", seed: int = 43, strategy: str = "gaussian") -> DataFrame:
    """``gaussian``: drawn rows; ``default``: rows of zeros for the model to fill. Input and output matrices go apart."""
    if strategy == "gaussian":
        return embeddings.unionByName(new_rows(embeddings, size, vector, seed))
    first = embeddings.agg(F.count("*").alias("n"), F.first(F.size(vector)).alias("d"))
    empty = first.select(F.explode(F.sequence("n", F.lit(size - 1).cast("long"))).alias("id"), "d").select("id", F.array_repeat(F.lit(0.0).cast("float"), F.col("d")).alias(vector))
    return embeddings.unionByName(empty)
