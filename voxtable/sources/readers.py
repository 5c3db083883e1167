"""Readers of corpora, manifests, line files, JSON lines, TSV, features, templates, vocabularies and scores.

``read.text`` ends lines at LF, CR and CRLF, as universal newlines do. Lines are numbered by the split of the file that
they come from, in the order of files and of the splits' places in them, without Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.functions.text import DEFAULT_TEMPLATE, first_field, path_join, stem, strip
from voxtable.operators.relational import IDX, numbered, slice_rows, suffix_filter, with_index

def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, idx) of one file, or of the files of a folder one after another.

    A split's lines are read in order by one task, so their running numbers less the split's least one are their places in
    it; the splits before it, one row each, give the offset.
    """
    read = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("__id64", F.monotonically_increasing_id())
    splits = read.groupBy("file_path", "file_block_start").agg(F.count("*").alias("n"), F.min("__id64").alias("first"))
    before = F.sum("n").over(W.orderBy("file_path", "file_block_start")) - F.col("n") - F.col("first")
    splits = splits.select("file_path", "file_block_start", before.alias("__shift"))
    return read.join(F.broadcast(splits), ["file_path", "file_block_start"]).select("value", (F.col("__id64") + F.col("__shift")).alias(IDX))


def many_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(value, idx) of files one after another, in the given order."""
    parts = [lines(spark, p).withColumn("__file", F.lit(k)) for k, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, parts)
    sizes = rows.groupBy("__file").agg(F.count("*").alias("n"))
    starts = sizes.select("__file", (F.sum("n").over(W.orderBy("__file")) - F.col("n")).alias("__start"))
    return rows.join(F.broadcast(starts), "__file").select("value", (F.col(IDX) + F.col("__start")).alias(IDX))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(idx, audio_path, n_samples) of an audio manifest: a root folder, then lines of path and number of samples."""
    rows = lines(spark, path)
    root = rows.where(F.col(IDX) == 0).select(strip("value").alias("root"))
    parts = F.split(strip("value"), "\t")
    body = rows.where(F.col(IDX) > 0).select((F.col(IDX) - 1).alias(IDX), F.element_at(parts, 1).alias("p"), F.element_at(parts, 2).cast("long").alias("n_samples"))
    return body.crossJoin(F.broadcast(root)).select(IDX, path_join("root", "p").alias("audio_path"), "n_samples")


def manifest_paths(spark: SparkSession, path: str) -> DataFrame:
    """(idx, audio_path): the same manifest, without regard to lengths."""
    rows = lines(spark, path)
    root = rows.where(F.col(IDX) == 0).select(strip("value").alias("root"))
    body = rows.where(F.col(IDX) > 0).select((F.col(IDX) - 1).alias(IDX), first_field(strip("value")).alias("p"))
    return body.crossJoin(F.broadcast(root)).select(IDX, path_join("root", "p").alias("audio_path"))


def json_column(spark: SparkSession, path: str, column: str, kind: str = "string") -> DataFrame:
    """(idx, column) of a file of JSON objects, one a line."""
    schema = T.StructType([T.StructField(column, T._parse_datatype_string(kind))])
    return lines(spark, path).select(IDX, F.from_json("value", schema)[column].alias(column))


def keyed_json(spark: SparkSession, path: str, column: str, path_field: str = "audio_filepath") -> DataFrame:
    """(key, column): the key is the stem of the audio's path; the last of repeated keys counts."""
    schema = T.StructType([T.StructField(path_field, T.StringType()), T.StructField(column, T.StringType())])
    rows = lines(spark, path).select(IDX, F.from_json("value", schema).alias("x")).select(IDX, stem(F.col("x")[path_field]).alias("key"), F.col("x")[column].alias(column))
    return rows.groupBy("key").agg(F.max_by(column, IDX).alias(column))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(idx, instruction)."""
    return json_column(spark, path, "instruction")


def json_fields(spark: SparkSession, path: str, fields: Mapping[str, str]) -> DataFrame:
    """(idx, one column for each name: JSON path)."""
    return lines(spark, path).select(IDX, *(F.get_json_object("value", p).alias(k) for k, p in fields.items()))


#: In a line, ``MARK`` follows a character that a backslash escaped; both marks are spelt out where a text has them.
MARK, SPELL = "\uffff", "\ufffe"


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """idx and the columns of a TSV file with a header, without quotes, with backslash escapes; empty is not null.

    A backslash is dropped and the character after it taken as it is, so tabs that one escapes don't end a field. Fields
    that a line lacks are empty; a line with more fields than the header is an error. The patterns have no repeated
    groups, so fields may be of any length.
    """
    rows = lines(spark, path)
    head = rows.where(F.col(IDX) == 0).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = head["value"].split("\t")
    spelt = F.replace(F.replace("value", F.lit(SPELL), F.lit(SPELL + "0")), F.lit(MARK), F.lit(SPELL + "1"))
    cut = F.split(F.regexp_replace(spelt, r"(?s)\\(.)", f"$1{MARK}"), rf"\t(?!{MARK})", -1)
    plain = F.transform(cut, lambda x: F.replace(F.replace(F.replace(x, F.lit(MARK), F.lit("")), F.lit(SPELL + "1"), F.lit(MARK)), F.lit(SPELL + "0"), F.lit(SPELL)))
    long = F.concat(F.lit(f"{path}: a line has more than {len(names)} fields: line "), F.col(IDX).cast("string"))
    body = rows.where(F.col(IDX) > 0).withColumn("__f", F.when(F.size(plain) <= len(names), plain).otherwise(F.raise_error(long)))
    return body.select((F.col(IDX) - 1).alias(IDX), *(F.coalesce(F.try_element_at("__f", F.lit(k + 1)), F.lit("")).alias(n) for k, n in enumerate(names)))


def features(spark: SparkSession, files: Sequence[str] | None = None, folders: Sequence[str] | None = None, n: int = 0) -> DataFrame:
    """Frames (Parquet: shard, frame, feat) of files, or of the first n (0: all) of the sorted files of folders, with
    ``file``. Exactly one of both is given."""
    if (files is None) == (folders is None):
        raise ValueError("give files or folders")
    if files is None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        files = []
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            files += [x.getPath().toString() for x in path.getFileSystem(conf).listStatus(path) if x.getPath().getName().endswith(".parquet")]
        files = sorted(files)[: n if n > 0 else None]
    return spark.read.parquet(*files).withColumn("file", F.input_file_name())


def shuffled_batches(df: DataFrame, size: int, seed: int = 42, file_col: str = "file", order: str = "frame") -> DataFrame:
    """Adds ``place`` of the file in a seeded order and ``batch`` within it. Files are shuffled, rows are not."""
    places = df.select(file_col).distinct().withColumn("place", F.row_number().over(W.orderBy(F.xxhash64(F.lit(seed), file_col), file_col)) - 1)
    batch = F.floor((F.row_number().over(W.partitionBy(file_col).orderBy(order)) - 1) / size)
    return df.join(F.broadcast(places), file_col).withColumn("batch", batch)


def template(path: str | None, key: str | None = None, opener: Callable = open) -> str:
    """A template from a JSON file of templates, or the default one."""
    if path is None:
        return DEFAULT_TEMPLATE
    with opener(path, encoding="utf-8") as f:
        return json.load(f)[key]


def parallel_text(df: DataFrame, splits: Sequence[str], languages: Sequence[str], split_col: str = "split", language_col: str = "lang") -> DataFrame:
    """The rows of some splits and languages, for ``sinks.parallel_text``."""
    return df.where(F.col(split_col).isin(*splits) & F.col(language_col).isin(*languages))


def scores(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """(key, COMET) of a JSON file that maps keys to lists of scores; JSON lines, a score each, stand under "scores"."""
    if json_lines:
        return score_rows(spark, path)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<struct<COMET:double>>>").alias("x"))
    return whole.select(F.explode("x").alias("key", "l")).select("key", F.explode("l").alias("s")).select("key", F.col("s.COMET").alias("COMET"))


def score_rows(spark: SparkSession, path: str, key: str = "scores") -> DataFrame:
    """(key, COMET) of JSON lines, a row each."""
    return spark.read.text(path).where(F.length("value") > 0).select(F.lit(key).alias("key"), F.from_json("value", "COMET double")["COMET"].alias("COMET"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(rank, piece, score) of lines of piece and score."""
    parts = F.split("value", "\t")
    return lines(spark, path).select(F.col(IDX).alias("rank"), F.element_at(parts, 1).alias("piece"), F.element_at(parts, 2).cast("double").alias("score"))


def new_types(spark: SparkSession, path: str) -> DataFrame:
    """(idx, piece): first fields of the stripped lines."""
    return lines(spark, path).select(IDX, first_field(strip("value")).alias("piece"))


def decoded(df: DataFrame, column: str, placeholder_length: int, decoder: Callable | None = None) -> DataFrame:
    """Adds ``decode_ok``; a row whose audio can't be decoded gets zeros of a fixed length instead, and stays.

    ``decoder`` maps a bytes column to array<float>, null where it fails; without one, null arrays are what failed.
    """
    audio = F.col(column) if decoder is None else decoder(F.col(column))
    return df.withColumn("__audio", audio).withColumn("decode_ok", F.col("__audio").isNotNull()).withColumn(column, F.coalesce("__audio", F.array_repeat(F.lit(0.0).cast("float"), placeholder_length))).drop("__audio")


def resample(factor_from: int, factor_to: int):
    """A pandas function that resamples array<float> by linear interpolation (P2)."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            n = int(round(len(x) * factor_to / factor_from))
            return np.interp(np.arange(n) * factor_from / factor_to, np.arange(len(x)), np.asarray(x, float)).astype("float32") if len(x) else []

        return s.map(one)

    return run


@dataclass
class SourceConfig:
    """What a dataset's configuration says; unknown keys become reader options."""

    path: str
    config: str | None = None
    split: str | None = None
    filter_mic: str | None = None
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_text(cls, text: str) -> SourceConfig:
        """From YAML of mappings: ``key: value`` lines, quotes and comments allowed, nested mappings by indentation.

        Options of nested mappings have dotted names, as Spark's reader options do.
        """
        values: dict[str, str] = {}
        above: list[tuple[int, str]] = []
        for line in text.splitlines():
            line = re.sub(r"""^((?:[^'"#]|'[^']*'|"[^"]*")*?)\s+#.*$|^#.*$""", r"\1", line.rstrip())
            if not line.strip():
                continue
            depth, (key, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
            above = [x for x in above if x[0] < depth]
            value = value.strip()
            name = ".".join([*(k for _, k in above), key.strip().strip("'\"")])
            if value:
                values[name] = value[1:-1] if value[0] in "'\"" and value[-1] == value[0] else value
            else:
                above.append((depth, key.strip()))
        known = {k: values.pop(k) for k in ("path", "config", "split", "filter_mic", "format") if k in values}
        if "path" not in known:
            raise KeyError("a configuration has a path")
        return cls(**known, options=values)


def saved_splits(spark: SparkSession, path: str) -> list[str] | None:
    """The splits of a dataset saved in a folder (``dataset_dict.json`` lists them, a folder of files each), else None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/dataset_dict.json")
    if not where.getFileSystem(conf).exists(where):
        return None
    return json.loads(spark.read.text(where.toString(), wholetext=True).first()[0])["splits"]


def scan(spark: SparkSession, source: SourceConfig, order: Sequence[str] = (), start: int = 0, n: int = 0, drop_audio: bool = False, file_col: str = "file") -> DataFrame:
    """A configured source as rows with ``idx``: a folder of saved splits by the split's own folder, TSV manifests by their
    reader, else Spark's reader of the format.

    Otherwise the split is a partition filter where the data has a ``split`` column; ``order`` are the columns that order
    the rows (a manifest has its own; without any it is the files' order). Slicing comes before the index, which is
    therefore the slice's own.
    """
    splits = saved_splits(spark, source.path)
    if splits is None and source.path.endswith(".tsv"):
        return slice_rows(manifest(spark, source.path), start, n)
    path = source.path if source.config is None else f"{source.path}/{source.config}"
    if splits is not None:
        if source.split not in splits:
            raise KeyError(f"{source.path} has the splits {', '.join(splits)}, not {source.split}")
        path = f"{source.path}/{source.split}"
    rows = spark.read.format(source.format).options(**source.options).load(path)
    if splits is None and source.split is not None and "split" in rows.columns:
        rows = rows.where(F.col("split") == source.split)
    if source.filter_mic is not None:
        rows = suffix_filter(rows, file_col, source.filter_mic)
    rows = rows.drop("audio") if drop_audio else rows
    if IDX not in rows.columns:
        rows = with_index(rows, *order) if order else numbered(rows)
    return slice_rows(rows, start, n)
