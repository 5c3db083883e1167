"""Commands end to end on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.test_sources import put, text_of
from voxtable import cli


@pytest.fixture
def config(spark, tmp_path):
    rows = [(k, f"a/u{k}.wav", [float(k)] * 640, f"text {k}", float(k)) for k in range(6)]
    spark.createDataFrame(rows, "n long, file string, audio array<float>, text string, seconds double").write.parquet(str(tmp_path / "corpus"))
    return put(tmp_path / "c.yml", f"path: {tmp_path}/corpus\n")


def test_scan_and_batches(spark, tmp_path, config):
    cli.main(["scan", "--config", config, config, "--order", "n", "--start-ix", "1", "--n-examples", "3", "--out", str(tmp_path / "s")], spark)
    assert [(r.idx, r.n) for r in spark.read.parquet(str(tmp_path / "s")).orderBy("idx").collect()] == [(0, 1), (1, 2), (2, 3), (3, 1), (4, 2), (5, 3)]
    cli.main(["batches", "--config", config, "--order", "n", "--token-batching", "--batch-size", "8", "--example-lengths", "seconds", "--out", str(tmp_path / "b")], spark)
    assert [(r.n, r.batch) for r in spark.read.parquet(str(tmp_path / "b")).orderBy("place").collect()] == [(5, 0), (4, 0), (3, 1), (2, 1), (1, 1), (0, 2)]
    cli.main(["batches", "--config", config, "--order", "n", "--batch-size", "4", "--out", str(tmp_path / "f")], spark)
    assert [r.batch for r in spark.read.parquet(str(tmp_path / "f")).orderBy("idx").collect()] == [0, 0, 0, 0, 1, 1]


def test_training_set(spark, tmp_path, config):
    units = put(tmp_path / "units", "".join(f" d{k}\n" for k in range(6)))
    said = put(tmp_path / "said.jsonl", "".join(json.dumps({"text": f"T{k}" if k != 4 else ""}) + "\n" for k in range(6)))
    common = ["training-set", "--config", config, "--order", "n", "--dsus", units, "--templates", put(tmp_path / "t.json", '{"template": "S {dsu_seq}"}')]
    cli.main([*common, "--min-columns", "seconds", "--min-column-values", "1", "--topk-examples", "2", "--topk-column", "seconds", "--external-transcripts", said, "--instructions", str(tmp_path / "i"), "--spite-stats", str(tmp_path / "st")], spark)
    got = [[t["value"] for t in json.loads(x)["conversations"]] for x in text_of(tmp_path / "i")]
    assert sorted(got) == [["S d3", "T3"], ["S d5", "T5"]] and json.loads(text_of(tmp_path / "st")[0]) == {"n_rows": 2}
    keyed = put(tmp_path / "librispeech-pc.jsonl", "".join(json.dumps({"audio_filepath": f"x/u{k}.flac", "text": f"K{k}"}) + "\n" for k in (0, 2)))
    cli.main([*common, "--external-transcripts", keyed, "--instructions", str(tmp_path / "k")], spark)
    assert sorted(json.loads(x)["conversations"][1]["value"] for x in text_of(tmp_path / "k")) == ["K0", "K2"]


def test_units_lines_and_errors(spark, tmp_path, config):
    spark.createDataFrame([(k, [float(k)] * 8) for k in range(3)], "k long, center array<double>").write.parquet(str(tmp_path / "book"))
    for name, more in (("u", []), ("l", ["--as-indices", "--no-dedup"])):
        cli.main(["units", "--config", config, "--order", "n", "--kmeans-model", str(tmp_path / "book"), *more, "--out", str(tmp_path / name)], spark)
    assert len(text_of(tmp_path / "u")) == len(text_of(tmp_path / "l")) == 6 and all(len(x.split()) == 2 for x in text_of(tmp_path / "l"))
    a, b = put(tmp_path / "a", "The cat sat.\nUm, no\n"), put(tmp_path / "b", "the cat\nno\n")
    cli.main(["normalize", "--lines", a, "--normalizer", "english", "--out", str(tmp_path / "n")], spark)
    assert [x.strip() for x in text_of(tmp_path / "n")] == ["the cat sat", "no"]
    cli.main(["word-errors", "--references", a, "--hypotheses", b, "--out", str(tmp_path / "w")], spark)
    assert json.loads(text_of(tmp_path / "w")[0]) == {"edits": 2, "ref_words": 5, "wer": 0.4}
    spark.range(5).select("id", F.array(F.col("id").cast("float")).alias("vec")).write.parquet(str(tmp_path / "e"))
    cli.main(["extend-embeddings", "--embeddings", str(tmp_path / "e"), "--added", "3", "--out", str(tmp_path / "x")], spark)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 64
    cli.main(["draws", "--config", config, "other", "--dataset-weights", "3", "1", "--out", str(tmp_path / "d")], spark)
    assert 650 < spark.read.parquet(str(tmp_path / "d")).where(F.col("source") == config).count() < 850
