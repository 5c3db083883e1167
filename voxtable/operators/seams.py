"""Where neural models plug in: an object with one method on Arrow batches, run by ``mapInArrow``.

No model ships with the library. The fakes are deterministic and let plans be run and tested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.functions.numbers import nan_to_num
from voxtable.functions.text import cut_at_stop


class Model(Protocol):
    def __call__(self, batch: pa.RecordBatch) -> pa.Array:
        """One result for each row."""


def infer(df: DataFrame, load: Callable[[], Model], output: str, kind: str) -> DataFrame:
    """Adds a column of a model's results. ``load`` runs once a task, on the executor; batches go through in order."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, model(batch)], names=[*batch.schema.names, output])

    return df.mapInArrow(run, schema)


#: Encoders by kind of model; register further ones here.
ENCODERS: dict[str, Callable[..., Model]] = {}


def register_encoder(kind: str, load: Callable[..., Model]) -> None:
    ENCODERS[kind] = load


def encode(df: DataFrame, kind: str, output: str = "features", **options) -> DataFrame:
    """Adds frame features (array<array<float>>) by a registered encoder."""
    load = ENCODERS[kind]
    return infer(df, lambda: load(**options), output, "array<array<float>>")


def generate(df: DataFrame, load: Callable[[], Model], output: str = "hypothesis") -> DataFrame:
    """Adds generated text, cut at the first stop string."""
    return infer(df, load, "__raw", "string").withColumn(output, cut_at_stop("__raw")).drop("__raw")


def score(df: DataFrame, load: Callable[[], Model], output: str = "score") -> DataFrame:
    """Adds a quality estimate; missing ones become 0."""
    return infer(df, load, "__raw", "double").withColumn(output, nan_to_num(F.coalesce("__raw", F.lit(float("nan"))))).drop("__raw")


def fake_encoder(column: str, dim: int = 8, samples: int = 320) -> Model:
    """Features that depend on the samples alone: one frame for each ``samples``."""

    def model(batch: pa.RecordBatch) -> pa.Array:
        out = []
        for audio in batch.column(column).to_pylist():
            x = np.asarray(audio["array"] if isinstance(audio, dict) else audio or [], np.float64)
            frames = x[: len(x) // samples * samples].reshape(-1, samples)
            basis = np.cos(np.arange(samples)[:, None] * np.arange(1, dim + 1) / samples)
            out.append((frames @ basis).astype(np.float32).tolist())
        return pa.array(out, pa.list_(pa.list_(pa.float32())))

    return model


def fake_generator(column: str) -> Model:
    """Repeats the last line that has text, then a stop string."""

    def model(batch: pa.RecordBatch) -> pa.Array:
        lines = [[x for x in (t or "").split("\n") if x.strip()] or [""] for t in batch.column(column).to_pylist()]
        return pa.array([x[-1] + "<END> and more" for x in lines], pa.string())

    return model


def fake_scorer(*columns: str) -> Model:
    """A number from 0 to 1 by a hash of the columns."""

    def model(batch: pa.RecordBatch) -> pa.Array:
        rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
        return pa.array([int.from_bytes(hashlib.sha256(repr(r).encode()).digest()[:4]) / 2**32 for r in rows], pa.float64())

    return model


register_encoder("fake", fake_encoder)
