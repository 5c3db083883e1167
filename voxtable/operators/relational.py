"""Slicing, filtering, top-k and joins over relations with an ordinal column ``idx``.

Spark rows have no order, so each relation that stands for an ordered list carries ``idx`` (from 0, without gaps, see
``with_index``); positional joins are equi-joins on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtable.functions.text import last_part
from voxtable.scratch import stash

IDX = "idx"


#: The low bits of ``monotonically_increasing_id`` are a row's place in its partition, the others the partition.
PLACE_BITS = 33


def numbered(df: DataFrame, name: str = IDX) -> DataFrame:
    """Adds 0, 1, 2 ... in the order in which the rows stand in the partitions of a table that is read from files.

    Partitions number themselves; their sizes, one row each, give the offsets. The rows are read twice.
    """
    rows = df.withColumn("__id64", F.monotonically_increasing_id()).withColumns({"__part": F.shiftright("__id64", PLACE_BITS), "__at": F.col("__id64").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    counts = rows.groupBy("__part").agg(F.count("*").alias("__c"))
    before = counts.select("__part", (F.sum("__c").over(W.orderBy("__part")) - F.col("__c")).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__id64", "__part", "__at", "__before")


def with_index(df: DataFrame, *order: Column | str, name: str = IDX) -> DataFrame:
    """Adds 0, 1, 2 ... in the given order, which should be total.

    A single window would sort everything in one task. Instead rows are range-partitioned and sorted, written to the
    shared folder with their partition and place in it, and the partitions' sizes give the offsets.
    """
    return ranked(df, (), order, name)


def ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows in sorted ranges, with ``__part`` and ``__at`` (the place in it), written to the shared folder: both uses of
    the ranges see the same ones."""
    order = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id64", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"__part": F.shiftright("__id64", PLACE_BITS).cast("int"), "__at": F.col("__id64").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    return stash(ranged.drop("__id64"))


def with_ranges(rows: DataFrame, keys: Sequence[str], about: DataFrame) -> DataFrame:
    """Joins what ``about`` says of each key in each range: (``keys``, ``__part``, further columns)."""
    about = about.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), *(c for c in about.columns if c not in (*keys, "__part")))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__part") == F.col("__p"))
    return rows.join(about if keys else F.broadcast(about), same).drop("__p", *(f"__k{i}" for i in range(len(keys))))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = IDX) -> DataFrame:
    """Adds 0, 1, 2 ... in the given order within ``keys``. No task holds the rows of a key: ranges cut through keys.

    A range's first place of a key and the key's rows in the ranges before give a row's number; those are a row for each
    key of each range.
    """
    rows = ranges(df, (*keys, *order))
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    before = F.sum("__c").over(W.partitionBy(*keys).orderBy("__part")) - F.col("__c") - F.col("__first")
    found = with_ranges(rows, keys, counts.select(*keys, "__part", before.alias("__before")))
    return found.withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__at", "__before")


def slice_rows(df: DataFrame, start: int = 0, n: int = 0, order: str = IDX) -> DataFrame:
    """Skips ``start`` rows, takes ``n`` (0 or less: all that are left), and numbers them from 0 again."""
    rows = df.where((F.col(order) >= start) & (F.col(order) < start + n) if n > 0 else F.col(order) >= start)
    return rows.withColumn(order, F.col(order) - start)


def shard_of(size: int, idx: Column | str = IDX) -> Column:
    """The number, from 1, of the shard of ``size`` rows that a row is in."""
    return (F.floor((F.col(idx) if isinstance(idx, str) else idx) / size) + 1).cast("long")


def shard_slice(df: DataFrame, shard: int, size: int, order: str = IDX) -> DataFrame:
    return slice_rows(df, (shard - 1) * size, size, order)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """Without a column, if it is there."""
    return df.drop(name)


def suffix_filter(df: DataFrame, path_col: str, value: str) -> DataFrame:
    """Rows whose path has ``value`` after the last underscore of its stem."""
    return df.where(last_part(path_col) == value)


def bounds(least: Mapping[str, float] | None = None, most: Mapping[str, float] | None = None) -> Column:
    """All columns within their inclusive bounds. NaN is in no bounds, though Spark sorts it above all numbers."""
    tests = [(F.col(c) >= v) & ~F.isnan(F.col(c).cast("double")) for c, v in (least or {}).items()]
    tests += [(F.col(c) <= v) & ~F.isnan(F.col(c).cast("double")) for c, v in (most or {}).items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def within(df: DataFrame, least: Mapping[str, float] | None = None, most: Mapping[str, float] | None = None) -> DataFrame:
    return df.where(bounds(least, most)) if least or most else df


def not_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.length(column) > 0)


def top_k(df: DataFrame, column: str | None, k: int, highest: bool = True, tie: Sequence[str] = (IDX,)) -> DataFrame:
    """The k rows with the highest or lowest values; all rows for k = 0 or no column. Ties go by ``tie``."""
    if not k or column is None:
        return df
    # NaN sorts above all numbers; it is no highest value here
    key = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    return df.orderBy(key.desc_nulls_last() if highest else key.asc_nulls_last(), *tie).limit(k)


def random_k(df: DataFrame, k: int, seed: int = 42, key: Sequence[str] = (IDX,)) -> DataFrame:
    """k rows without replacement, the same for the same seed and keys."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(k) if k else df


def split_rows(df: DataFrame, split: str, version: int = 1, column: str = "split") -> DataFrame:
    """Rows of a split. Version 1: of the split or its ``_covost`` variant; version 2: the variant for train only."""
    names = [split, f"{split}_covost"] if version == 1 or split == "train" else [split]
    return df.where(F.col(column).isin(names))


def check_pair(source: str, target: str, languages: Mapping[int, Sequence[str]], version: int) -> tuple[str, str]:
    """The pair, if one side is English and the other is in the version's list."""
    if "en" not in (source, target) or source == target:
        raise ValueError(f"one of {source} and {target} has to be en")
    other = target if source == "en" else source
    if other not in languages.get(version, ()):
        raise ValueError(f"version {version} doesn't have {other}")
    return source, target


def drop_bad_conversations(df: DataFrame, column: str = "conversations", field: str = "value") -> DataFrame:
    """Without rows any of whose turns has a null or empty text."""
    return df.where(~F.exists(F.col(column), lambda t: t[field].isNull() | (t[field] == "")))


# Joins


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, order: str = IDX, default: str | None = "") -> DataFrame:
    """Adds the value that ``table`` has last (by ``order``) for the key, or the default."""
    last = table.groupBy(key).agg(F.max_by(value, order).alias(value))
    joined = df.join(last, key, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(value, F.lit(default)))


def strict_lookup(df: DataFrame, table: DataFrame, key: str, value: str, order: str = IDX) -> DataFrame:
    """As ``lookup``, but a key that isn't there raises an error when its row is computed."""
    last = table.groupBy(key).agg(F.max_by(F.struct(value), order).alias("__found"))
    found = df.join(last, key, "left")
    missing = F.raise_error(F.concat(F.lit("not in the table: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(dict(table.dtypes)[value])
    return found.withColumn(value, F.when(F.col("__found").isNull(), missing).otherwise(F.col("__found")[value])).drop("__found")


def missing_keys(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(table, key, "left_anti")


def zip_join(*tables: DataFrame, order: str = IDX, **constants: object) -> DataFrame:
    """Rows with the same place side by side, as far as the shortest table goes, and constant columns."""
    out = reduce(lambda a, b: a.join(b, order), tables)
    return out.withColumns({k: F.lit(v) for k, v in constants.items()}) if constants else out


def zip_exact(left: DataFrame, right: DataFrame, order: str = IDX) -> DataFrame:
    """As ``zip_join``, but tables of different lengths raise an error: one aggregate over both tells."""
    n, m = (t.agg(F.count("*").alias("n")) for t in (left, right))
    same = n.crossJoin(m.withColumnRenamed("n", "m")).select(F.assert_true(F.col("n") == F.col("m"), F.lit("the tables differ in length")).isNull().alias("__same"))
    return left.join(right, order).crossJoin(F.broadcast(same)).where("__same").drop("__same")


def by_place(results: DataFrame, n: int | DataFrame, order: str = IDX, **defaults: object) -> DataFrame:
    """A row for each place from 0 to n - 1 (or each row of a DataFrame), with defaults where there is no result."""
    places = n.select(order) if isinstance(n, DataFrame) else results.sparkSession.range(n).withColumnRenamed("id", order)
    out = places.join(results, order, "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()}) if defaults else out


def inner_on(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key)


def cube(*axes: DataFrame) -> DataFrame:
    """Every combination of the rows of small tables: branch points of an experiment. Sizes are checked."""
    for axis in axes:
        if axis.limit(10_001).count() > 10_000:
            raise ValueError("an axis of a cube has 10,000 rows at most")
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)


def concat(*tables: DataFrame, order: str = IDX) -> DataFrame:
    """The tables' rows one after another, numbered through: the offsets are the tables' counts."""
    sizes = reduce(DataFrame.unionByName, (t.agg(F.lit(k).alias("table"), F.count("*").alias("n")) for k, t in enumerate(tables)))
    starts = sizes.select("table", (F.sum("n").over(W.orderBy("table")) - F.col("n")).alias("__start"))
    parts = [t.withColumn("table", F.lit(k)) for k, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(starts), "table").withColumn(order, F.col(order) + F.col("__start")).drop("table", "__start")
