"""Order-dependent operators over long tables: run collapse, pooling, flattening, moving averages, early stopping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import TypeVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtable.functions.bind import bind
from voxtable.operators.relational import ranges, ranked, with_ranges


def collapse_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before, within ``keys``; nulls equal nulls.

    Rows are compared within ranges, which cut through keys; a range's first row of a key is compared with the last one of
    the range before. So one key may have any number of rows.
    """
    rows = ranges(df, (*keys, *order))
    last = rows.groupBy(*keys, "__part").agg(F.max_by(F.struct(F.col(value).alias("v")), "__at").alias("__last"))
    earlier = last.select(*keys, "__part", F.lag("__last").over(W.partitionBy(*keys).orderBy("__part")).alias("__earlier"))
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(W.partitionBy(*keys, "__part").orderBy("__at"))
    found = with_ranges(rows.withColumn("__inside", inside), keys, earlier).withColumn("__before", F.coalesce("__inside", "__earlier"))
    return found.where(F.col("__before").isNull() | ~F.col("__before.v").eqNullSafe(F.col(value))).select(*df.columns)


def pool(df: DataFrame, key: str, place: str, values: str, width: int, kind: str = "mean") -> DataFrame:
    """Element-wise mean or max of whole windows of ``width`` successive frames (array column) of each key.

    Frames are numbered from 0 in ``place``; a last window that isn't whole is left out.
    """
    one = {"mean": F.avg, "max": F.max}[kind]
    long = df.select(key, F.floor(F.col(place) / width).cast("long").alias("window"), F.posexplode(values).alias("dim", "x"))
    pooled = long.groupBy(key, "window", "dim").agg(one(F.col("x").cast("double")).alias("x"), F.count("*").alias("n")).where(F.col("n") == width)
    return pooled.groupBy(key, "window").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v")).select(key, "window", F.col("v.x").alias(values))


def pool_array(values: Column | str, width: int, kind: str = "mean") -> Column:
    """Mean or max of whole windows of ``width`` successive elements of an array."""

    def pooled(v: Column) -> Column:
        n = F.floor(F.size(v) / width).cast("int")

        def one(i: Column) -> Column:
            part = F.slice(v, (i - 1) * width + 1, F.lit(width))
            if kind == "max":
                return F.array_max(part).cast("double")
            return F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")) / width

        return F.slice(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), F.lit(1), n)

    return bind(F.col(values) if isinstance(values, str) else values, pooled)


def flatten_masked(df: DataFrame, key: str, values: str, mask: str) -> DataFrame:
    """One row (key, t, value) for each element of an array whose mask is true."""
    pairs = F.arrays_zip(F.col(values).alias("value"), F.col(mask).alias("m"))
    return df.select(key, F.posexplode(pairs).alias("t", "p")).where("p.m").select(key, "t", F.col("p.value").alias("value"))


def padding_share(df: DataFrame, mask: str) -> DataFrame:
    """n_frames, n_padded_frames (with padding) and the share of padding, over all arrays of booleans."""
    held = F.size(F.filter(F.col(mask), lambda m: m))
    sums = df.agg(F.sum(held).cast("long").alias("n_frames"), F.sum(F.size(mask)).cast("long").alias("n_padded_frames"))
    return sums.withColumn("pad_share", 1 - F.try_divide(F.col("n_frames").cast("double"), F.col("n_padded_frames").cast("double")))


def moving_average(df: DataFrame, key: str, order: Sequence[str], value: str, alpha: float = 0.02, start: float = 1.0, block: int = 10_000) -> DataFrame:
    """Exponential moving average of each key, of any length: avg = (1 - alpha) * avg + alpha * value, from ``start``.

    Its closed form is a sum over a window, but its weights underflow. A run of values maps avg to a * avg + b; blocks of a
    key's ordered values are folded to their (a, b) apart, then the blocks' maps.
    """
    numbered = ranked(df, [key], order, "__block").withColumn("__block", F.floor(F.col("__block") / block))
    rows = numbered.groupBy(key, "__block").agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v")))).alias("r"))
    maps = rows.select(key, "__block", F.pow(F.lit(1 - alpha), F.size("r").cast("double")).alias("a"), F.aggregate("r", F.lit(0.0), lambda b, r: (1 - alpha) * b + alpha * r["__v"]).alias("b"), F.size("r").cast("long").alias("c"))
    whole = maps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__block", "a", "b"))).alias("m"), F.sum("c").alias("n"))
    return whole.select(key, "n", F.aggregate("m", F.lit(float(start)), lambda avg, m: m["a"] * avg + m["b"]).alias("avg"))


def sampling_shares(df: DataFrame, weight: str, average: str) -> DataFrame:
    """Adds ``p``: the probability of each source, in proportion to its weight over its average length."""
    p = F.col(weight) / F.col(average)
    return df.withColumn("p", p / F.sum(p).over(W.partitionBy()))


def draw_sources(shares: DataFrame, n: int, source: str, seed: int = 42) -> DataFrame:
    """n seeded draws (draw, source) with the probabilities ``p``: each draw's uniform hash falls into one share.

    Shares are one row a source; their bounds are broadcast after a check of their number. With probabilities that stay
    as they are; see ``adaptive_draws`` for those that follow the batches drawn.
    """
    if shares.count() > 10_000:
        raise ValueError("10,000 sources at most")
    order = W.orderBy(source)
    bounds = shares.select(source, (F.sum("p").over(order) - F.col("p")).alias("lo"), F.sum("p").over(order).alias("hi"), (F.row_number().over(W.orderBy(F.col(source).desc())) == 1).alias("last"))
    draws = shares.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / float(1 << 40)).alias("u"))
    return draws.join(F.broadcast(bounds), (F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | F.col("last"))).select("draw", source)


@dataclass
class AdaptiveDraws:
    """An endless draw of sources, in proportion to weight / average length; the averages follow what was drawn.

    ``averages`` start at 1 and move by ``alpha`` towards the mean length of each batch that ``seen`` reports.
    """

    weights: dict[str, float]
    alpha: float = 0.02
    seed: int = 42
    averages: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.averages = {k: 1.0 for k in self.weights} | self.averages
        self.rng = np.random.default_rng(self.seed)

    def shares(self) -> dict[str, float]:
        raw = {k: w / self.averages[k] for k, w in sorted(self.weights.items())}
        return {k: x / sum(raw.values()) for k, x in raw.items()}

    def draw(self) -> str:
        shares = self.shares()
        return str(self.rng.choice(list(shares), p=list(shares.values())))

    def seen(self, source: str, mean_length: float) -> None:
        self.averages[source] += self.alpha * (mean_length - self.averages[source])


Item = TypeVar("Item")


def adaptive_draws(sources: Mapping[str, Callable[[], Iterable[Item]]], length_of: Callable[[Item], float], draws: AdaptiveDraws) -> Iterator[tuple[str, Item]]:
    """Endless (source, item); a source that runs out is opened again, so mixtures keep their weights. Empty ones raise."""
    running: dict[str, Iterator[Item]] = {}
    while True:
        name = draws.draw()
        item = next(running.get(name, iter(())), None)
        if item is None:
            running[name] = iter(sources[name]())
            item = next(running[name], None)
            if item is None:
                raise ValueError(f"the source {name!r} is empty")
        draws.seen(name, length_of(item))
        yield name, item


def early_stopping(df: DataFrame, step: str, value: str, patience: int, lower_is_better: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``best`` (so far), ``bad`` (steps since it improved) and ``stop`` (bad >= patience, and 1, now or before).

    A key is a metric's series with a row for each check of a fit, which one task orders.
    """
    past = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    ordered = W.partitionBy(*keys).orderBy(step)
    best = (F.min if lower_is_better else F.max)(value)
    before = best.over(past)
    better = before.isNull() | (F.col(value) < before if lower_is_better else F.col(value) > before)
    rows = df.withColumn("best", best.over(so_far)).withColumn("__n", F.row_number().over(ordered)).withColumn("__better", better)
    rows = rows.withColumn("bad", F.col("__n") - F.max(F.when(F.col("__better"), F.col("__n"))).over(so_far)).drop("__n", "__better")
    return rows.withColumn("stop", F.max(F.col("bad") >= max(patience, 1)).over(so_far))


def every_nth(df: DataFrame, step: str, n: int) -> DataFrame:
    return df.where(F.col(step) % n == 0)
