"""Tables that a computation writes on its way, below ``spark.checkpoint.dir``, and their removal."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that were written and not removed yet.
_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors are threads of the driver (tests, bench) gets a temporary folder, once,
    which goes with the process. On a cluster executors couldn't see such a folder, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="voxtable-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stash(df: DataFrame, into: list[str] | None = None, **options: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again: cuts the lineage and survives lost executors.

    ``into`` gets the table's path, for ``drop_tables`` once nothing reads it any more.
    """
    path = folder(df.sparkSession)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    if into is not None:
        into.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables of the shared folder, on whatever file system it is."""
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _written:
            _written.remove(path)


@contextmanager
def cleanup(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end of the block, the tables written in it. Results must be written or collected by then."""
    before = set(_written)
    try:
        yield
    finally:
        drop_tables(spark, [p for p in _written if p not in before])
