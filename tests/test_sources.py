"""Readers and writers on small files, and the stream operators."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.functions.text import DEFAULT_TEMPLATE
from voxtable.operators.kmeans import MiniBatch
from voxtable.operators.relational import with_index
from voxtable.plans import roundtrips
from voxtable.sources import readers, sinks
from voxtable.streaming import lines as streams


def put(path, text: str) -> str:
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def text_of(path) -> list[str]:
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]


def test_manifest(spark, tmp_path):
    path = put(tmp_path / "m.tsv", "/root/a\nx.wav\t16000\n/abs/y.wav\t5\n")
    assert [tuple(r) for r in readers.manifest(spark, path).orderBy("idx").collect()] == [(0, "/root/a/x.wav", 16000), (1, "/abs/y.wav", 5)]
    assert [r.audio_path for r in readers.manifest_paths(spark, path).orderBy("idx").collect()] == ["/root/a/x.wav", "/abs/y.wav"]
    got = readers.scan(spark, readers.SourceConfig(path), start=1)
    assert [tuple(r) for r in got.collect()] == [(0, "/abs/y.wav", 5)]


def test_lines_and_json(spark, tmp_path):
    a, b = put(tmp_path / "a", "1\n2\r\n"), put(tmp_path / "b", "3\n")
    assert [tuple(r) for r in readers.many_lines(spark, [b, a]).orderBy("idx").collect()] == [("3", 0), ("1", 1), ("2", 2)]
    j = put(tmp_path / "j", '{"audio_filepath": "d/k.wav", "text": "x"}\n{"audio_filepath": "k.flac", "text": "y"}\n')
    assert [tuple(r) for r in readers.keyed_json(spark, j, "text").collect()] == [("k", "y")]
    assert [r.text for r in readers.json_column(spark, j, "text").orderBy("idx").collect()] == ["x", "y"]
    assert readers.json_fields(spark, j, {"p": "$.audio_filepath"}).where("idx = 0").first().p == "d/k.wav"


def test_tsv(spark, tmp_path):
    path = put(tmp_path / "t.tsv", 'path\tsentence\tclient\na\\\tb\t"q\t\nc\tback\\\\slash\tz\n')
    got = readers.tsv(spark, path).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(0, "a\tb", '"q', ""), (1, "c", "back\\slash", "z")]
    sinks.tsv(readers.tsv(spark, path), str(tmp_path / "out"))
    assert text_of(tmp_path / "out") == ["path\tsentence\tclient", 'a\\\tb\t"q\t', "c\tback\\\\slash\tz"]


def test_tsv_of_long_and_odd_fields(spark, tmp_path):
    """A field of a megabyte, many escapes, the marks themselves, short lines and long ones."""
    long, many, odd = "x" * 1_000_000, "a\t" * 50_000, "\uffff0\ufffe1\ufffe\uffff\\"
    rows = spark.createDataFrame([(0, long, odd), (1, many, "\\\\\t"), (2, "", odd * 3)], "idx long, a string, b string")
    sinks.tsv(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, readers.tsv(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, rows.collect()))
    assert [tuple(r) for r in readers.tsv(spark, put(tmp_path / "s", "a\tb\nonly\n")).collect()] == [(0, "only", "")]
    with pytest.raises(Exception, match="more than 2 fields"):
        readers.tsv(spark, put(tmp_path / "l", "a\tb\n1\t2\t3\n")).collect()


def test_lines_over_many_splits(spark, tmp_path):
    path = put(tmp_path / "many", "".join(f"line {k}\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = readers.lines(spark, path)
        assert got.rdd.getNumPartitions() > 3 and {r.idx: r.value for r in got.collect()} == {k: f"line {k}" for k in range(5000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert readers.lines(spark, put(tmp_path / "none", "")).count() == 0


def test_nested_configuration():
    source = readers.SourceConfig.from_text("path: 'a#b'  # where\nsplit: x\nfs:\n  s3a:\n    endpoint: \"http://h:1\"\n    retries: 3\nmode: FAILFAST\n")
    assert source.path == "a#b" and source.options == {"fs.s3a.endpoint": "http://h:1", "fs.s3a.retries": "3", "mode": "FAILFAST"}


def test_saved_splits(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d/train"))
    put(tmp_path / "d/dataset_dict.json", '{"splits": ["train"]}')
    assert readers.scan(spark, readers.SourceConfig(str(tmp_path / "d"), split="train"), ["id"]).count() == 3
    with pytest.raises(KeyError, match="not test"):
        readers.scan(spark, readers.SourceConfig(str(tmp_path / "d"), split="test"))


def test_json_array(spark, tmp_path):
    df = spark.createDataFrame([(4, "ä\n{"), (1, None), (2, '"')], "idx long, t string").repartition(3)
    for rows, want in ((df, [{"t": None}, {"t": '"'}, {"t": "ä\n{"}]), (df.where("idx = 2"), [{"t": '"'}]), (df.where("idx > 9"), [])):
        sinks.json_array(rows, str(tmp_path / "a"))
        assert json.loads("\n".join(text_of(tmp_path / "a"))) == want


def test_scores_and_templates(spark, tmp_path):
    path = put(tmp_path / "s.json", json.dumps({"m": [{"COMET": 0.5}, {"COMET": 1.0}]}, indent=2))
    from voxtable.operators.stats import mean_scores

    assert [tuple(r) for r in mean_scores(readers.scores(spark, path)).collect()] == [("m", 0.75)]
    path = put(tmp_path / "s.jsonl", '{"COMET": 0.25}\n{"COMET": 0.75}\n')
    assert [tuple(r) for r in mean_scores(readers.scores(spark, path, True)).collect()] == [("scores", 0.5)]
    assert readers.score_rows(spark, path).count() == 2
    path = put(tmp_path / "t.json", '{"asr": "S {dsu_seq}"}')
    assert readers.template(path, "asr") == "S {dsu_seq}" and readers.template(None) == DEFAULT_TEMPLATE
    with pytest.raises(KeyError):
        readers.template(path, "template")


def test_vocabulary_files(spark, tmp_path):
    path = put(tmp_path / "v", "<s>\t0\na\t-1\n")
    v = readers.vocabulary(spark, path)
    sinks.vocabulary(v, str(tmp_path / "out"))
    assert text_of(tmp_path / "out") == ["<s>\t0", "a\t-1"]
    assert [r.piece for r in readers.new_types(spark, put(tmp_path / "n", " b\tx\nc\n")).orderBy("idx").collect()] == ["b", "c"]


def test_features(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, f, [float(f)]) for f in range(5)], "shard int, frame long, feat array<float>").coalesce(1).write.parquet(str(tmp_path / f"s{k}"))
        next((tmp_path / f"s{k}").glob("*.parquet")).rename(tmp_path / f"{k}.parquet")
    got = readers.features(spark, folders=[str(tmp_path)], n=2)
    assert got.count() == 10
    batches = readers.shuffled_batches(got, 2).groupBy("place", "batch").count().collect()
    assert sorted(r["count"] for r in batches) == [1, 1, 2, 2, 2, 2]
    with pytest.raises(ValueError):
        readers.features(spark)


def test_configured_scan(spark, tmp_path):
    spark.createDataFrame([("a_mic1.wav", "train"), ("b_mic2.wav", "train"), ("c_mic1.wav", "test")], "file string, split string").write.parquet(str(tmp_path / "d"))
    source = readers.SourceConfig.from_text(f"# comment\npath: {tmp_path}/d\nsplit: 'train'\nfilter_mic: mic1\nmergeSchema: true\n")
    assert source.options == {"mergeSchema": "true"}
    assert [(r.idx, r.file) for r in readers.scan(spark, source, order=["file"]).collect()] == [(0, "a_mic1.wav")]
    with pytest.raises(KeyError):
        readers.SourceConfig.from_text("split: x")


def test_feature_shards_of_few_rows(spark, tmp_path):
    """Whole shards share folders: their number follows the rows, over Arrow batches that end anywhere; 1 row: one each."""
    rows = [("ab"[i % 3 == 0], i, float(i % 4)) for i in range(900)]
    want, packs = {}, {}
    for k in "ab":
        shard, total, first, held = 0, 0.0, 0, 0
        for _, i, h in (r for r in rows if r[0] == k):
            want[i], packs[i], total, held = (k, shard), (k, first), total + h, held + 1
            if total >= 5:
                shard, total = shard + 1, 0.0
                if held >= 100:
                    first, held = shard, 0
    df = spark.createDataFrame(rows, "k string, idx long, h double").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for name, most in (("whole", 100_000), ("packs", 100), ("each", 1)):
            sinks.feature_shards(df, str(tmp_path / name), "h", 5, ["k"], pack_rows=most)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for name, folders in (("whole", 2), ("packs", len(set(packs.values()))), ("each", len(set(want.values())))):
        got = spark.read.parquet(str(tmp_path / name)).collect()
        assert len(got) == 900 and {r.idx: (r.k, r.shard) for r in got} == want
        assert len(list((tmp_path / name).glob("*/*/*.parquet"))) == folders
    assert {r.idx: (r.k, r.first_shard) for r in spark.read.parquet(str(tmp_path / "packs")).collect()} == packs


def test_feature_shard_files_makes_few_files(spark, tmp_path, monkeypatch):
    """One folder for each type of these few events, not one for each of their shards."""
    spark.range(2000).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("event_type"), F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(roundtrips, "folder", lambda spark: str(tmp_path / "out"))
    got = roundtrips.feature_shard_files(spark, str(tmp_path))
    assert got.count() == 2000 and dict(got.dtypes)["shard"] == "int" and got.select("event_type", "shard").distinct().count() > 90
    assert len(list((tmp_path / "out").rglob("*.parquet"))) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, " c "), (0, "ä\n")], "idx long, t string")
    sinks.lines_by_place(df.withColumn("t", F.trim(F.regexp_replace("t", "\n", ""))), 4, "t", str(tmp_path / "a"))
    assert text_of(tmp_path / "a") == ["ä", "", "c", ""]
    sinks.stripped_column(df, "t", str(tmp_path / "b"))
    sinks.json_rows(df, str(tmp_path / "c"))
    assert text_of(tmp_path / "b") == ["ä", "c"] and [json.loads(x) for x in text_of(tmp_path / "c")] == [{"t": "ä\n"}, {"t": " c "}]
    sinks.prompts(df.withColumnRenamed("t", "instruction"), str(tmp_path / "p"))
    assert [r.instruction for r in readers.prompts(spark, str(tmp_path / "p")).orderBy("idx").collect()] == ["ä\n", " c "]
    vec = spark.createDataFrame([(1, [1.0, 2.0])], "idx long, v array<float>")
    sinks.vectors_by_place(vec, 2, "v", 2, str(tmp_path / "v"))
    first, second = (r.v for r in spark.read.parquet(str(tmp_path / "v")).orderBy("idx").collect())
    assert np.isnan(first).all() and second == [1.0, 2.0]
    hours = spark.createDataFrame([(i, 1.0) for i in range(5)], "idx long, h double")
    sinks.feature_shards(hours, str(tmp_path / "f"), "h", 2)
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "f")).groupBy("shard").count().collect()) == [1, 2, 2]
    sinks.parallel_text(spark.createDataFrame([(0, "x", "dev", "en"), (1, "y", "dev", "de")], "idx long, t string, split string, lang string"), "t", str(tmp_path / "w"))
    assert text_of(tmp_path / "w/split=dev/lang=en") == ["x"]
    assert json.loads(sinks.stats(spark.range(1).select(F.lit(2.5).alias("wer")), str(tmp_path / "st"))) == {"wer": 2.5}
    sinks.instructions(spark.createDataFrame([(0, [("human", None)])], "idx long, conversations array<struct<`from`:string,value:string>>"), str(tmp_path / "i"))
    assert text_of(tmp_path / "i") == ['{"conversations":[{"from":"human","value":null}]}']


def test_damaged_audio(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, None)], "idx long, audio array<float>")
    got = readers.decoded(df, "audio", 3).orderBy("idx").collect()
    assert [(r.audio, r.decode_ok) for r in got] == [([1.0], True), ([0.0] * 3, False)]
    assert df.where("idx = 0").select(readers.resample(1, 2)("audio")).first()[0] == [1.0, 1.0]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a", "aabb\n")
    put(tmp_path / "in/b", '{"conversations":[{"from":"human","value":"x"}]}\n{"conversations":[{"from":"human","value":""}]}\n')
    for name, f in (("c", streams.collapsed), ("n", streams.normalized), ("g", streams.good_conversations)):
        q = f(streams.lines(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"ck{name}")).trigger(availableNow=True).start(str(tmp_path / name))
        q.awaitTermination(60)
    assert "ab" in {r.value for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1
    spark.createDataFrame([([float(i % 2) * 10],) for i in range(20)], "v array<double>").write.parquet(str(tmp_path / "vecs"))
    model = MiniBatch(np.array([[1.0], [8.0]]))
    streams.train(spark.readStream.schema("v array<double>").parquet(str(tmp_path / "vecs")), "v", model, str(tmp_path / "ckv")).awaitTermination(60)
    assert model.centers.ravel().tolist() == [0.0, 10.0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert with_index(spark.range(3), "id").count() == 3
