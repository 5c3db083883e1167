"""Helpers that the operators have in common: tables on the way, checked broadcasts, numbers of partitions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable import scratch
from voxtable.scratch import drop_tables, folder

__all__ = ["drop_tables", "folder", "free", "parts_for", "partitions", "short_batches", "small", "stash", "table"]

#: Rows and bytes of an Arrow batch: texts are long, and both the JVM and the Python worker hold a whole batch, or several.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Shortens the session's Arrow batches, where they are longer. Plans take these settings when they run, so they stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def stash(df: DataFrame, into: list[str] | None = None) -> DataFrame:
    """``scratch.stash`` with short Arrow batches, as ``df`` may have texts."""
    short_batches(df.sparkSession)
    return scratch.stash(df, into)


#: Numbers (long) in a table that is broadcast at most: its hash table stays near 64 MB whatever the input's size.
MOST_NUMBERS = 2_000_000


def small(numbers: DataFrame) -> DataFrame:
    """A written table of long columns, marked for broadcast if it has few enough rows; beyond that joins shuffle."""
    return F.broadcast(numbers) if numbers.count() * len(numbers.columns) <= MOST_NUMBERS else numbers


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Shuffle partitions at most, however large the input: beyond this each holds more, in groups or runs of bounded size.
MOST_PARTITIONS = 20_000


def parts_for(spark: SparkSession, amount: int, each: int) -> int:
    """Shuffle partitions for an amount of which ``each`` is meant for one; between the session's number and the most."""
    return max(partitions(spark), min(MOST_PARTITIONS, -(-amount // each)))


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_`` and so on until none of ``taken`` (in any case of letters) is equal."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
