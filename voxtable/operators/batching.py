"""Batches and shards with state that starts anew: length budgets, fixed sizes, hours.

A greedy batch depends on the one before, so each group (a shard, a language) is walked in order by one task; rows arrive
as an iterator of Arrow batches, so a group need not fit in memory. Groups run side by side: choose as many as there
are tasks, with ``shards_by_hash`` where the data has no natural ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.operators.relational import ranked


def shards_by_hash(df: DataFrame, key: str, n: int, name: str = "shard") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def length_rank(df: DataFrame, length: str, keys: Sequence[str] = (), tie: Sequence[str] = ("idx",), descending: bool = False) -> DataFrame:
    """Adds ``place``, from 0, by length within ``keys``; ties by ``tie``. Numbered by ranges: no task sorts a whole key."""
    first = F.col(length).desc() if descending else F.col(length).asc()
    return ranked(df, keys, [first, *tie], "place")


def fixed_batches(df: DataFrame, size: int, place: Column | str) -> DataFrame:
    """Adds ``batch``: successive ``size`` rows by their place."""
    place = F.col(place) if isinstance(place, str) else place
    return df.withColumn("batch", F.floor(place / size).cast("long"))


#: Rows of a key whose running sum one task makes.
BLOCK_ROWS = 100_000

#: Rows with which a pack of whole shards ends.
PACK_ROWS = 100_000

#: cut(values, state) -> (numbers, a row of them for each new column, new state): the walk over a stretch of one group's rows.
Cut = Callable[[np.ndarray, tuple], tuple[np.ndarray, tuple]]


def _walk(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, cut: Cut, start: tuple, *names: str) -> DataFrame:
    """Adds the numbers that ``cut`` gives to the ordered rows of each group; its state begins as ``start``.

    A batch begins where the one before ends, so rows of a group stream through one task: partitions hold whole groups,
    sorted, and the state starts anew where the keys change. An Arrow batch takes a few array operations for each batch
    that ends in it, not a Python step for each row. Where a source is too long for one task, ``shards_by_hash`` or
    ``ranked`` blocks of it serve as further keys; the batches then end with each of them.
    """
    keys, order = list(keys), list(order)
    lone = not keys
    rows = df.withColumn("__one", F.lit(0)) if lone else df
    keys = ["__one"] if lone else keys
    arranged = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = arranged.schema.names
    key_at, value_at = [fields.index(k) for k in keys], fields.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), ()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.nan_to_num(np.asarray(pc.fill_null(batch.column(value_at).cast(pa.float64()), 0.0)))
            coded = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (batch.column(i) for i in key_at)]
            starts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in coded], axis=0)) + 1).tolist(), len(values)]
            out = np.empty((len(names), len(values)), np.int64)
            for a, b in zip(starts, starts[1:]):
                key = [batch.column(i)[a].as_py() for i in key_at]
                if key != current:
                    current, state = key, start
                out[:, a:b], state = cut(values[a:b], state)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*fields, *names])

    schema = T.StructType([*arranged.schema.fields, *(T.StructField(name, T.LongType()) for name in names)])
    out = arranged.mapInArrow(run, schema)
    return out.drop("__one") if lone else out


def _first(reached: Callable[[int, int], np.ndarray], start: int, n: int) -> int:
    """The first place from ``start`` that is reached, or n; ``reached(a, b)`` says it of a stretch. Stretches double."""
    a, size = start, 64
    while a < n:
        b = min(n, a + size)
        hit = np.flatnonzero(reached(a, b))
        if len(hit):
            return a + int(hit[0])
        a, size = b, 2 * size
    return n


def budget_batches(df: DataFrame, length: str, budget: float, keys: Sequence[str] = (), order: Sequence[str] = ("place",), name: str = "batch") -> DataFrame:
    """Adds the number, from 0, of the batch: a batch ends with the row at which longest * count reaches the budget."""

    def cut(values: np.ndarray, state: tuple) -> tuple[np.ndarray, tuple]:
        batch, longest, count = state
        out, at, n = np.empty(len(values), np.int64), 0, len(values)
        while at < n:
            seen = {"longest": longest}

            def reached(a: int, b: int, at: int = at, count: int = count, seen: dict = seen) -> np.ndarray:
                most = np.maximum(np.maximum.accumulate(values[a:b]), seen["longest"])
                seen["longest"] = float(most[-1])
                return most * (count + np.arange(a, b) - at + 1) >= budget

            end = _first(reached, at, n)
            out[at : end + 1] = batch
            if end == n:
                longest, count = max(longest, float(values[at:].max())), count + n - at
            else:
                batch, longest, count = batch + 1, 0.0, 0
            at = end + 1
        return out, (batch, longest, count)

    return _walk(df, keys, order, length, cut, (0, 0.0, 0), name)


def whole_batches(df: DataFrame, length: str, budget: float, keys: Sequence[str] = (), batch: str = "batch") -> DataFrame:
    """Without each group's last batch where that doesn't reach the budget (``drop_last``)."""
    w = W.partitionBy(*keys, batch)
    reached = F.max(length).over(w) * F.count("*").over(w) >= budget
    return df.withColumn("__ok", reached).where("__ok").drop("__ok")


def total_shards(
    df: DataFrame, amount: str, per_shard: float, keys: Sequence[str] = (), order: Sequence[str] = ("idx",), name: str = "shard", pack: str | None = None, pack_rows: int = PACK_ROWS
) -> DataFrame:
    """Adds the shard, from 0: the row whose amount makes the shard's sum reach ``per_shard`` is its last.

    ``pack`` also adds the first shard of the pack that the shard is in: consecutive whole shards, of which the one that
    brings the pack to ``pack_rows`` rows is its last.
    """
    names = [name] if pack is None else [name, pack]

    def cut(values: np.ndarray, state: tuple) -> tuple[np.ndarray, tuple]:
        shard, total, first, held = state
        out, at, n = np.empty((2, len(values)), np.int64), 0, len(values)
        while at < n:
            seen = {"total": total}

            def reached(a: int, b: int, seen: dict = seen) -> np.ndarray:
                # one after another from the sum so far, as a loop would add them
                sums = np.cumsum(np.concatenate([[seen["total"]], values[a:b]]))[1:]
                seen["total"] = float(sums[-1])
                return sums >= per_shard

            end = _first(reached, at, n)
            out[0, at : end + 1], out[1, at : end + 1] = shard, first
            held += min(end + 1, n) - at
            if end == n:
                total = seen["total"]
            else:
                shard, total = shard + 1, 0.0
                first, held = (shard, 0) if held >= pack_rows else (first, held)
            at = end + 1
        return out[: len(names)], (shard, total, first, held)

    return _walk(df, keys, order, amount, cut, (0, 0.0, 0, 0), *names)


def until_total(df: DataFrame, amount: str, most: float, keys: Sequence[str] = (), order: Sequence[str] = ("idx",)) -> DataFrame:
    """Rows up to the one whose amount makes the running sum reach ``most``, that one included.

    Sums run within blocks of ``BLOCK_ROWS`` rows of a key and over the blocks' totals: no task holds a whole key.
    """
    rows = ranked(df, keys, list(order), "__place").withColumn("__block", F.floor(F.col("__place") / BLOCK_ROWS))
    totals = rows.groupBy(*keys, "__block").agg(F.sum(amount).alias("__t"))
    earlier = F.coalesce(F.sum("__t").over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    totals = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__block").alias("__b"), earlier.alias("__earlier")).where(F.col("__earlier") < most)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__block") == F.col("__b"))
    inside = W.partitionBy(*keys, "__block").orderBy("__place").rowsBetween(W.unboundedPreceding, -1)
    found = rows.join(totals, same).withColumn("__before", F.col("__earlier") + F.coalesce(F.sum(amount).over(inside), F.lit(0.0)))
    return found.where(F.col("__before") < most).select(*df.columns)


def flush_batches(df: DataFrame, frames: str, size: int, keys: Sequence[str] = (), order: Sequence[str] = ("idx",), name: str = "flush") -> DataFrame:
    """Adds the number of the flush that takes the row's frames: a buffer is flushed whole once it holds ``size``."""
    return total_shards(df, frames, size, keys, order, name)


def batch_counts(df: DataFrame, keys: Sequence[str] = (), batch: str = "batch") -> DataFrame:
    """n_batches of each source."""
    return df.groupBy(*keys).agg(F.countDistinct(batch).alias("n_batches"))
