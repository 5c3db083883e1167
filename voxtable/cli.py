"""Command line: ``python -m voxtable.cli COMMAND``; flags that carry meaning have the names users know.

Each command reads sources, runs a plan and writes by a sink; nothing but flags is decided here.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.functions import text as X
from voxtable.operators import batching, relational as R, seams, sequence, vocab
from voxtable.plans import pipelines
from voxtable.session import build
from voxtable.sources import readers, sinks

Flags = argparse.Namespace

#: Groups of flags: name -> (flag, settings) each.
GROUPS: dict[str, list[tuple[str, dict]]] = {
    "randomness": [("--seed", {"type": int, "default": 42}), ("--torch-seed", {"type": int, "default": 43})],
    "encoder": [
        ("--ssl-model", {"default": "fake", "help": "name of a registered encoder (operators.seams)"}), ("--layer", {"type": int}), ("--keep-final-layer-norm", {"action": "store_true"}),
        ("--dtype", {"choices": ["fp32", "bf16"], "default": "fp32"}), ("--pooling-width", {"type": int, "default": 1}), ("--pooling-type", {"choices": ["mean", "max"], "default": "mean"}),
    ],
    "dataset": [
        ("--config", {"nargs": "+", "required": True, "help": "files of source configurations"}), ("--dataset-weights", {"nargs": "*", "type": float}), ("--resample-to", {"type": int, "default": 16_000}),
        ("--start-ix", {"type": int, "default": 0}), ("--n-examples", {"type": int, "default": 0}), ("--batch-size", {"type": int, "default": 1}), ("--token-batching", {"action": "store_true"}),
        ("--example-lengths", {"default": None, "help": "column of lengths"}), ("--order", {"nargs": "*", "default": [], "help": "columns that order a source's rows"}),
    ],
    "units": [("--kmeans-model", {"required": True, "help": "Parquet of (k, center)"}), ("--as-indices", {"action": "store_true"}), ("--no-dedup", {"action": "store_true"})],
    "training": [
        ("--dsus", {"nargs": "+"}), ("--templates", {}), ("--template-key", {"default": "template"}), ("--transcript-column", {"default": "text"}), ("--external-transcript-column", {"default": "text"}),
        ("--external-transcripts", {}), ("--min-columns", {"nargs": "*", "default": []}), ("--min-column-values", {"nargs": "*", "default": [], "type": float}),
        ("--max-columns", {"nargs": "*", "default": []}), ("--max-column-values", {"nargs": "*", "default": [], "type": float}), ("--topk-examples", {"type": int, "default": 0}),
        ("--topk-column", {}), ("--topk-mode", {"choices": ["highest", "lowest"], "default": "highest"}), ("--spite-stats", {}), ("--instructions", {"default": "instructions.jsonl"}),
    ],
    "out": [("--out", {"required": True})],
    "embeddings": [("--embeddings", {"required": True, "help": "Parquet of (id, vec)"}), ("--added", {"type": int, "required": True})],
    "lines": [("--lines", {"required": True}), ("--normalizer", {"choices": ["basic", "english"], "default": "basic"})],
    "pairs": [("--references", {"required": True}), ("--hypotheses", {"required": True})],
}

COMMANDS: dict[str, tuple[tuple[str, ...], Callable[[SparkSession, Flags], None]]] = {}


def command(*groups: str) -> Callable:
    def add(f: Callable[[SparkSession, Flags], None]) -> Callable[[SparkSession, Flags], None]:
        COMMANDS[f.__name__.replace("_", "-")] = (groups, f)
        return f

    return add


def whole_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def source(spark: SparkSession, flags: Flags, at: int = 0, drop_audio: bool = False) -> DataFrame:
    return readers.scan(spark, readers.SourceConfig.from_text(whole_text(spark, flags.config[at])), flags.order, flags.start_ix, flags.n_examples, drop_audio)


@command("dataset", "out")
def scan(spark: SparkSession, flags: Flags) -> None:
    """Rows of the sources, one after another, with their places."""
    R.concat(*(source(spark, flags, k) for k in range(len(flags.config)))).write.parquet(flags.out)


@command("dataset", "out")
def batches(spark: SparkSession, flags: Flags) -> None:
    """Batch numbers: fixed sizes, or budgets of lengths (``--token-batching``, longest first)."""
    rows = source(spark, flags, drop_audio=True)
    if flags.token_batching:
        if flags.example_lengths is None:
            raise ValueError("--token-batching needs --example-lengths")
        rows = batching.budget_batches(batching.length_rank(rows, flags.example_lengths, descending=True), flags.example_lengths, flags.batch_size)
    else:
        rows = batching.fixed_batches(rows, flags.batch_size, R.IDX)
    rows.write.parquet(flags.out)


@command("dataset", "randomness", "out")
def draws(spark: SparkSession, flags: Flags) -> None:
    """1,000 draws of the sources by their weights (all equal where none are given)."""
    weights = flags.dataset_weights or [1.0] * len(flags.config)
    shares = spark.createDataFrame([(name, w, 1.0) for name, w in zip(flags.config, weights, strict=True)], "source string, w double, a double")
    sequence.draw_sources(sequence.sampling_shares(shares, "w", "a"), 1000, "source", flags.seed).write.parquet(flags.out)


@command("dataset", "encoder", "units", "out")
def units(spark: SparkSession, flags: Flags) -> None:
    """A line of units for each audio, by a registered encoder and the nearest centres."""
    seams.register_encoder("fake", seams.fake_encoder)
    audio = source(spark, flags)
    feats = seams.encode(audio.select(R.IDX, "audio"), flags.ssl_model, column="audio")
    frames = feats.select(R.IDX, F.posexplode("features").alias("t", "feat"))
    if flags.pooling_width > 1:
        frames = sequence.pool(frames, R.IDX, "t", "feat", flags.pooling_width, flags.pooling_type).withColumnRenamed("window", "t")
    lines = pipelines.unit_lines(frames.withColumn("mask", F.lit(True)), spark.read.parquet(flags.kmeans_model), audio.select(R.IDX), flags.as_indices, not flags.no_dedup)
    sinks.text_lines(lines, F.array_join("units", " ") if flags.as_indices else "units", flags.out)


@command("dataset", "training", "randomness")
def training_set(spark: SparkSession, flags: Flags) -> None:
    """Instructions from a source, its units and transcripts; bounds, then the top k; statistics on request."""
    corpus, found, key = source(spark, flags, drop_audio=True), None, None
    column = flags.transcript_column
    if flags.external_transcripts and "librispeech-pc" in flags.external_transcripts:
        found, key = readers.keyed_json(spark, flags.external_transcripts, flags.external_transcript_column).withColumn("idx", F.lit(0)), "key"
        corpus = corpus.withColumn("key", X.stem("file"))
    elif flags.external_transcripts:
        found = readers.json_column(spark, flags.external_transcripts, flags.external_transcript_column)
    if found is not None:
        found = found.withColumnRenamed(flags.external_transcript_column, column)
    least, most = (dict(zip(names, values, strict=True)) for names, values in ((flags.min_columns, flags.min_column_values), (flags.max_columns, flags.max_column_values)))
    rows = pipelines.training_rows(corpus, readers.many_lines(spark, flags.dsus), found, column, key, least, most, (flags.topk_column, flags.topk_examples, flags.topk_mode == "highest"), seed=flags.seed)
    template = X.DEFAULT_TEMPLATE if flags.templates is None else readers.template(flags.templates, flags.template_key)
    out, figures = pipelines.training_set(rows, template, {"dsu_seq": F.col("dsu_seq")}, column)
    if flags.spite_stats:
        sinks.stats(figures, flags.spite_stats)
    sinks.instructions(out, flags.instructions)


@command("lines", "out")
def normalize(spark: SparkSession, flags: Flags) -> None:
    rows = readers.lines(spark, flags.lines)
    sinks.text_lines(rows, {"basic": X.normalize, "english": X.normalize_english}[flags.normalizer]("value"), flags.out)


@command("pairs", "out")
def word_errors(spark: SparkSession, flags: Flags) -> None:
    said, heard = (readers.lines(spark, p).withColumnRenamed("value", c) for p, c in ((flags.references, "reference"), (flags.hypotheses, "hypothesis")))
    print(sinks.stats(pipelines.word_error_table(said, heard), flags.out))


@command("embeddings", "randomness", "out")
def extend_embeddings(spark: SparkSession, flags: Flags) -> None:
    rows = spark.read.parquet(flags.embeddings)
    vocab.extend_embeddings(rows, vocab.extended_size(rows.count(), flags.added), seed=flags.torch_seed).write.parquet(flags.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxtable")
    below = top.add_subparsers(dest="command", required=True)
    for name, (groups, f) in COMMANDS.items():
        one = below.add_parser(name, help=f.__doc__)
        for group in groups:
            for flag, settings in GROUPS[group]:
                one.add_argument(flag, **settings)
    return top


def main(words: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    flags = parser().parse_args(words)
    COMMANDS[flags.command][1](spark or build("voxtable"), flags)


if __name__ == "__main__":
    main()
