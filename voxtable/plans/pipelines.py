"""End-to-end plans: corpus to instructions, frames to unit lines, and evaluation over a cube of branches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.text import normalize_basic, strip
from voxtable.functions.units import PAD, detokenize
from voxtable.operators import relational as R
from voxtable.operators import stats
from voxtable.operators.evaluate import word_errors
from voxtable.operators.prompts import instructions
from voxtable.operators.vectors import assign_blocks


def training_rows(
    corpus: DataFrame, units: DataFrame | None = None, transcripts: DataFrame | None = None, transcript_col: str = "text", key: str | None = None,
    least: Mapping[str, float] | None = None, most: Mapping[str, float] | None = None, top: tuple[str | None, int, bool] | None = None, sample: int = 0, seed: int = 42,
) -> DataFrame:
    """The rows of a training set: units beside the corpus, transcripts looked up, bounds, then top-k or a sample.

    The units are joined before any row goes, so they stay aligned; bounds come before top-k, in that order.
    """
    rows = corpus
    if units is not None:
        rows = R.zip_exact(rows, units.select("idx", strip("value").alias("dsu_seq")))
    if transcripts is not None and key is not None:
        rows = R.not_empty(R.lookup(rows.drop(transcript_col), transcripts, key, transcript_col), transcript_col)
    elif transcripts is not None:
        rows = R.not_empty(R.zip_exact(rows.drop(transcript_col), transcripts), transcript_col)
    rows = R.within(rows, least, most)
    if top is not None:
        rows = R.top_k(rows, top[0], top[1], top[2])
    return R.random_k(rows, sample, seed)


def training_set(rows: DataFrame, template: str, slots: Mapping[str, Column], answer: str, means: Sequence[str] = (), length: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(instructions, statistics) of the rows that are left."""
    return instructions(rows, template, slots, answer), stats.corpus_stats(rows, means, length)


def unit_lines(frames: DataFrame, codebook: DataFrame, n: int | DataFrame, as_labels: bool = False, deduplicate: bool = True) -> DataFrame:
    """(idx, units) for each place: frames (idx, t, feat, mask) to nearest centroids, runs collapsed, as strings."""
    near = assign_blocks(frames, codebook, "feat").select("idx", "t", F.when(F.col("mask"), F.col("k")).otherwise(F.lit(PAD)).cast("int").alias("k"))
    labels = near.groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "k"))), lambda x: x["k"]).alias("labels"))
    units = labels.select("idx", detokenize("labels", as_labels, deduplicate).alias("units"))
    return R.by_place(units, n) if as_labels else R.by_place(units, n, units="")


def word_error_table(references: DataFrame, hypotheses: DataFrame, branches: Sequence[str] = ()) -> DataFrame:
    """Word error rates of all branches in one job: references and hypotheses are joined by place and normalised."""
    both = references.select("idx", normalize_basic("reference").alias("reference")).join(hypotheses.select("idx", *branches, normalize_basic("hypothesis").alias("hypothesis")), "idx")
    return word_errors(both, "reference", "hypothesis", branches)
