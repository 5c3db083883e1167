"""Queries of sources, sinks, seams and streams: each writes a table's rows to the shared folder in a format, reads them
back by the reader of that format, and returns what it read. The SQL gives the same rows from the tables themselves."""

from __future__ import annotations

import io

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.functions import numbers as N
from voxtable.functions import text as X
from voxtable.operators import batching, kmeans, prompts, relational as R, seams, sequence, stats
from voxtable.plans.register import LANGUAGES, query, table
from voxtable.scratch import folder
from voxtable.sources import readers, sinks
from voxtable.streaming import lines as streams


def placed(spark: SparkSession, d: str, name: str, key: str, *columns) -> DataFrame:
    """A table's key and columns with ``idx`` in the order of the key."""
    return R.with_index(table(spark, d, name).select(key, *columns), key)


def written(df: DataFrame, value, order: str = "idx") -> str:
    """The path of a text with a line for each row."""
    sinks.text_lines(df, value, path := folder(df.sparkSession), order)
    return path


def one_line(text: str):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


ONE_LINE = r"regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')"
DOCS = "(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)"
BENCH = "(SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark)"
PEOPLE = "(SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer)"

# Sources


def _manifest(spark, d):
    rows = placed(spark, d, "customer", "c_custkey", "c_name")
    wav = F.concat(F.when(F.col("idx") % 7 == 0, "/abs/").otherwise(""), "c_name", F.lit(".wav\t"), (F.col("c_custkey") * 160).cast("string"))
    head = spark.createDataFrame([(-1, "/corpus/audio")], "idx long, value string")
    return written(head.unionByName(rows.select("idx", wav.alias("value"))), "value")


MANIFEST = f"SELECT idx, CASE WHEN idx % 7 = 0 THEN '/abs/' ELSE '/corpus/audio/' END || c_name || '.wav' AS audio_path{{}} FROM {PEOPLE}"


@query(MANIFEST.format(", (c_custkey * 160)::BIGINT AS n_samples"))
def manifest_scan(spark, d):
    return readers.manifest(spark, _manifest(spark, d))


@query(MANIFEST.format(""))
def manifest_path_scan(spark, d):
    return readers.manifest_paths(spark, _manifest(spark, d))


@query("""SELECT row_number() OVER (ORDER BY f, k) - 1 AS idx, value FROM (SELECT 0 AS f, s_suppkey AS k, s_name AS value FROM supplier UNION ALL SELECT 1, c_custkey, c_name FROM customer)""")
def line_files(spark, d):
    paths = [written(placed(spark, d, t, k, v), v) for t, k, v in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))]
    return readers.many_lines(spark, paths)


def _transcripts(spark, d):
    rows = placed(spark, d, "documents", "doc_id", "text")
    name = F.concat(F.lit("/a.b/"), F.col("doc_id") % 2, F.lit("/utt."), F.col("doc_id") % 100, F.lit(".flac"))
    return written(rows, F.to_json(F.struct(name.alias("audio_filepath"), "text"), {"ignoreNullFields": "false"}))


@query(f"SELECT idx, text FROM {DOCS}")
def json_column_scan(spark, d):
    return readers.json_column(spark, _transcripts(spark, d), "text")


@query("SELECT 'utt.' || (doc_id % 100) AS key, arg_max(text, doc_id) AS text FROM documents GROUP BY doc_id % 100")
def keyed_json_scan(spark, d):
    return readers.keyed_json(spark, _transcripts(spark, d), "text")


@query(f"SELECT idx, 'Speech: ' || text || chr(10) || 'English:' AS instruction FROM {BENCH}")
def prompt_files(spark, d):
    rows = prompts.prompts(placed(spark, d, "benchmark", "item_id", "text"), X.DEFAULT_TEMPLATE, {"dsu_seq": F.col("text")})
    sinks.prompts(rows, path := folder(spark))
    return readers.prompts(spark, path)


@query(f"SELECT idx, doc_id::VARCHAR AS doc_id, {ONE_LINE} AS text, coalesce(lang, '') AS lang, 'a' || chr(9) || '\\b' AS odd FROM {DOCS}")
def tsv_files(spark, d):
    rows = placed(spark, d, "documents", "doc_id", one_line("text").alias("text"), "lang", F.lit("a\t\\b").alias("odd"))
    sinks.tsv(rows, path := folder(spark))
    return readers.tsv(spark, path)


def _features(spark, d):
    """A folder with a folder of one file for each half of the vectors."""
    base = folder(spark)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("feat"))
    for k, name in enumerate("ab"):
        rows.where(F.col("frame") % 2 == k).repartition(1).write.parquet(f"{base}/{name}")
    return base


@query("SELECT vec_id AS frame, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings WHERE vec_id % 2 = 0")
def feature_scan(spark, d):
    base = _features(spark, d)
    found = readers.features(spark, folders=[f"{base}/a", f"{base}/b"], n=1)
    return found.select("frame", F.round(F.aggregate("feat", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT half, batch::BIGINT AS batch, count(*) AS n, min(vec_id) AS first FROM (SELECT vec_id, vec_id % 2 AS half, (row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1) // 64 AS batch FROM embeddings) GROUP BY ALL")
def feature_batches(spark, d):
    base = _features(spark, d)
    rows = readers.shuffled_batches(readers.features(spark, folders=[f"{base}/a", f"{base}/b"]), 64)
    return rows.groupBy((F.col("frame") % 2).alias("half"), "batch").agg(F.count("*").alias("n"), F.min("frame").alias("first"))


@query("SELECT item_id, 'Say: ' || text AS human FROM benchmark")
def template_files(spark, d):
    line = spark.createDataFrame([(0, '{"asr": "Say: {dsu_seq}", "st": "Translate: {dsu_seq}"}')], "idx long, value string")
    opener = lambda path, encoding: io.StringIO(spark.read.text(path, wholetext=True).where("value <> ''").first()[0])
    template = readers.template(written(line, "value"), "asr", opener)
    return table(spark, d, "benchmark").select("item_id", X.fill(template, {"dsu_seq": F.col("text")}).alias("human"))


@query(f"SELECT CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'devtest' END AS split, lang, {ONE_LINE} AS value FROM documents WHERE lang IN ('en', 'fr', 'de')")
def parallel_files(spark, d):
    rows = placed(spark, d, "documents", "doc_id", one_line("text").alias("text"), "lang").withColumn("split", F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("devtest"))
    sinks.parallel_text(readers.parallel_text(rows, ["dev", "devtest"], ["en", "fr", "de"]), "text", path := folder(spark))
    return spark.read.text(path).select("split", "lang", "value")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, json_extract_string(props, '$.k') AS k FROM events")
def json_field_scan(spark, d):
    return readers.json_fields(spark, written(placed(spark, d, "events", "event_id", "props"), "props"), {"k": "$.k"})


@query("SELECT vec_id, vec_id % 7 <> 0 AS decode_ok, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE round(list_sum(embedding::DOUBLE[]), 6) END AS total, CASE WHEN vec_id % 7 = 0 THEN 10 ELSE 64 END AS n FROM embeddings")
def damaged_audio(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("audio"))
    found = readers.decoded(rows, "audio", 10)
    return found.select("vec_id", "decode_ok", F.round(F.aggregate("audio", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"), F.size("audio").alias("n"))


@query('SELECT \'scores\' AS key, round(avg(value), 6) AS "COMET" FROM events UNION ALL SELECT event_type, round(avg(value), 6) FROM events WHERE event_id < 500 GROUP BY event_type')
def score_files(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    each = written(rows.withColumnRenamed("event_id", "idx"), F.to_json(F.struct(F.col("value").alias("COMET"))))
    lists = rows.where("event_id < 500").groupBy("event_type").agg(F.collect_list(F.struct(F.col("value").alias("COMET"))).alias("l"))
    whole = lists.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "l"))).alias("m"))
    one = written(whole.select(F.lit(0).alias("idx"), F.to_json("m").alias("value")), "value")
    means = [stats.mean_scores(x) for x in (readers.scores(spark, each, True), readers.scores(spark, one))]
    return means[0].unionByName(means[1]).withColumn("COMET", F.round("COMET", 6))


@query(f"SELECT idx, c_name AS piece FROM {PEOPLE}")
def new_type_scan(spark, d):
    rows = placed(spark, d, "customer", "c_custkey", "c_name")
    return readers.new_types(spark, written(rows, F.concat(F.lit(" "), "c_name", F.lit("\t3 "))))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 6 AS idx, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' QUALIFY idx >= 0 AND idx < 50")
def config_scan(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lit("x").alias("audio"), F.col("c_mktsegment").alias("split"))
    rows.write.partitionBy("split").parquet(f"{(path := folder(spark))}/main")
    source = readers.SourceConfig.from_text(f"# a source\npath: {path}\nconfig: 'main'\nsplit: BUILDING\nrecursiveFileLookup: false\n")
    return readers.scan(spark, source, ["c_custkey"], 5, 50, drop_audio=True).drop("split")


@query("SELECT c_custkey, c_custkey % 3 AS mic FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 2")
def saved_split_scan(spark, d):
    path = folder(spark)
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("mic")).withColumn("file", F.concat(F.lit("/a/"), "c_custkey", F.lit("_mic"), "mic", F.lit(".wav")))
    for k, name in enumerate(("train", "test")):
        rows.where(F.col("c_custkey") % 2 == k).write.parquet(f"{path}/{name}")
    spark.createDataFrame([('{"splits": ["train", "test"]}',)], "value string").coalesce(1).write.text(f"{path}/dataset_dict.json")
    return readers.scan(spark, readers.SourceConfig(path, split="test", filter_mic="mic2")).select("c_custkey", "mic")


@query("SELECT vec_id, 128 AS n, round(list_sum(embedding::DOUBLE[]), 4) AS evens FROM embeddings")
def resampled(spark, d):
    """Twice the rate: every second sample is an old one."""
    rows = table(spark, d, "embeddings").select("vec_id", readers.resample(1, 2)("embedding").alias("audio"))
    evens = F.aggregate(F.filter("audio", lambda x, i: i % 2 == 0), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.size("audio").alias("n"), F.round(evens, 4).alias("evens"))


# Sinks


@query(f"SELECT idx, 'human' AS asks, 'Speech: ' || text || chr(10) || 'English:' AS human, item_id::VARCHAR AS gpt FROM {BENCH}")
def instruction_files(spark, d):
    rows = prompts.instructions(placed(spark, d, "benchmark", "item_id", "text"), X.DEFAULT_TEMPLATE, {"dsu_seq": F.col("text")}, "item_id")
    sinks.instructions(rows, path := folder(spark))
    found = readers.json_column(spark, path, "conversations", "array<struct<`from`:string,value:string>>").select("idx", F.col("conversations").alias("c"))
    return found.select("idx", F.col("c")[0]["from"].alias("asks"), F.col("c")[0]["value"].alias("human"), F.col("c")[1]["value"].alias("gpt"))


@query("SELECT d.idx, coalesce(l.quality::VARCHAR, '') AS value FROM (SELECT unnest(range((SELECT max(doc_id) + 1 FROM documents))) AS idx) d LEFT JOIN labels l ON l.doc_id = d.idx")
def place_lines(spark, d):
    results = table(spark, d, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").cast("string").alias("q"))
    sinks.lines_by_place(results, table(spark, d, "documents").agg(F.max("doc_id") + 1).first()[0], "q", path := folder(spark))
    return readers.lines(spark, path).select("idx", "value")


@query("SELECT item_id, text, 'x' AS kind FROM benchmark")
def json_array_files(spark, d):
    rows = placed(spark, d, "benchmark", "item_id", "text", F.lit("x").alias("kind"))
    sinks.json_array(rows, path := folder(spark))
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name")
    whole = files.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_name", "value"))), lambda x: x["value"]), "").alias("value"))
    return whole.select(F.explode(F.from_json("value", "array<struct<item_id:long,text:string,kind:string>>")).alias("x")).select("x.*")


@query(r"SELECT idx, regexp_replace(" + ONE_LINE + r", '^\s+|\s+$', '', 'g') AS value FROM " + DOCS)
def stripped_lines(spark, d):
    rows = placed(spark, d, "documents", "doc_id", F.concat(F.lit(" \t"), one_line("text"), F.lit("  ")).alias("text"))
    sinks.stripped_column(rows, "text", path := folder(spark))
    return readers.lines(spark, path).select("idx", "value")


@query("""WITH RECURSIVE o AS (SELECT event_type, event_id, (event_id % 5)::DOUBLE AS h, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
r AS (SELECT event_type, rn, event_id, 0 AS shard, h AS s FROM o WHERE rn = 1
 UNION ALL SELECT o.event_type, o.rn, o.event_id, CASE WHEN s >= 40 THEN shard + 1 ELSE shard END, CASE WHEN s >= 40 THEN h ELSE s + h END FROM r JOIN o ON o.event_type = r.event_type AND o.rn = r.rn + 1)
SELECT event_type, event_id, shard::INT AS shard FROM r""")
def feature_shard_files(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", (F.col("event_id") % 5).cast("double").alias("h"))
    sinks.feature_shards(rows, path := folder(spark), "h", 40, ["event_type"], ["event_id"])
    return spark.read.parquet(path).select("event_type", "event_id", F.col("shard").cast("int").alias("shard"))


@query(f"SELECT idx, n_chars::DOUBLE AS n_chars FROM {DOCS}")
def number_files(spark, d):
    sinks.numbers(placed(spark, d, "documents", "doc_id", "n_chars"), "n_chars", path := folder(spark))
    return spark.read.parquet(path)


@query("SELECT vec_id AS idx, vec_id % 3 = 0 AS missing, CASE WHEN vec_id % 3 > 0 THEN embedding[1] END AS first FROM embeddings")
def vector_files(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v")).where("idx % 3 > 0")
    sinks.vectors_by_place(rows, table(spark, d, "embeddings").agg(F.max("vec_id") + 1).first()[0], "v", 64, path := folder(spark))
    missing = F.forall("v", lambda x: F.isnan(x))
    return spark.read.parquet(path).select("idx", missing.alias("missing"), F.when(~missing, F.col("v")[0]).alias("first"))


@query("SELECT count(*) AS n_rows, round(avg(n_chars), 6) AS mean_n_chars FROM documents")
def stats_files(spark, d):
    sinks.stats(stats.corpus_stats(table(spark, d, "documents"), ["n_chars"]), path := folder(spark))
    found = readers.lines(spark, path).select(F.from_json("value", "n_rows long, mean_n_chars double").alias("x"))
    return found.select("x.n_rows", F.round("x.mean_n_chars", 6).alias("mean_n_chars"))


@query(f"SELECT idx AS rank, c_name AS piece, -idx::DOUBLE AS score FROM {PEOPLE}")
def vocabulary_files(spark, d):
    rows = placed(spark, d, "customer", "c_custkey", "c_name").select(F.col("idx").alias("rank"), F.col("c_name").alias("piece"), (-F.col("idx")).cast("double").alias("score"))
    sinks.vocabulary(rows, path := folder(spark))
    return readers.vocabulary(spark, path)


@query("SELECT vec_id AS k, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id < 10")
def center_files(spark, d):
    rows = table(spark, d, "embeddings").where("vec_id < 10").orderBy("vec_id").collect()
    sinks.checkpoint_centers(kmeans.codebook(spark, np.array([r.embedding for r in rows], np.float64)), path := folder(spark), 100)
    return spark.read.parquet(f"{path}/out.100").select("k", F.col("center")[0].alias("first"))


# Columns, joins and windows of the reference's scripts


@query("SELECT c_custkey FROM customer")
def drop_columns(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lit(1).alias("audio"))
    return R.drop_column(R.drop_column(rows, "audio"), "not there")


@query(f"SELECT idx, doc_id, 'u' || doc_id AS units FROM {DOCS}")
def zip_exact(spark, d):
    docs = placed(spark, d, "documents", "doc_id")
    units = readers.lines(spark, written(docs, F.concat(F.lit(" u"), "doc_id", F.lit("\t"))))
    return R.zip_exact(docs, units.select("idx", X.strip("value").alias("units"))).select("idx", "doc_id", "units")


@query("SELECT * FROM (VALUES ('en', 'de', 2), ('fr', 'en', 1)) t(source, target, version)")
def language_pairs(spark, d):
    wanted = [("en", "de", 2), ("fr", "en", 1), ("en", "pt", 1), ("fr", "de", 1), ("en", "xx", 2)]
    good = []
    for source, target, version in wanted:
        try:
            good.append((*R.check_pair(source, target, LANGUAGES, version), version))
        except ValueError:
            continue
    return spark.createDataFrame(good, "source string, target string, version int")


@query("SELECT doc_id, lang || chr(160) || 'x' AS text FROM documents")
def stripped(spark, d):
    odd = F.concat(F.lit(" \t\n"), "lang", F.lit(" x\x0b　 "))
    return table(spark, d, "documents").select("doc_id", X.strip(odd).alias("text"))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, embedding FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, embedding FROM embeddings WHERE vec_id % 2 = 1)
SELECT idx, round(list_inner_product(s.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS dot FROM s JOIN t USING (idx)""")
def vector_pairs(spark, d):
    rows = table(spark, d, "embeddings")
    speech, text = (R.with_index(rows.where(F.col("vec_id") % 2 == k).select("vec_id", F.col("embedding").alias(name)), "vec_id").drop("vec_id") for k, name in enumerate(("speech", "text")))
    return R.zip_join(speech, text).select("idx", F.round(N.dot("speech", "text"), 6).alias("dot"))


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents")
def length_order(spark, d):
    return batching.length_rank(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", tie=["doc_id"], descending=True).select("doc_id", "place")


@query("SELECT event_id, value FROM events WHERE event_id % 100 = 0")
def every_nth(spark, d):
    return sequence.every_nth(table(spark, d, "events").select("event_id", "value"), "event_id", 100)


@query("""WITH RECURSIVE o AS (SELECT event_type, event_id, event_id % 9 AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
r AS (SELECT event_type, rn, event_id, 0 AS flush, n AS s FROM o WHERE rn = 1
 UNION ALL SELECT o.event_type, o.rn, o.event_id, CASE WHEN s >= 100 THEN flush + 1 ELSE flush END, CASE WHEN s >= 100 THEN n ELSE s + n END FROM r JOIN o ON o.event_type = r.event_type AND o.rn = r.rn + 1)
SELECT event_type, event_id, flush::BIGINT AS flush FROM r""")
def buffer_flushes(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", (F.col("event_id") % 9).alias("n"))
    return batching.flush_batches(rows, "n", 100, ["event_type"], ["event_id"]).select("event_type", "event_id", "flush")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/abs/' || c_name ELSE 'root/' || c_name END AS path FROM customer")
def path_joins(spark, d):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "/abs/").otherwise(""), "c_name")
    return table(spark, d, "customer").select("c_custkey", X.path_join(F.lit("root"), name).alias("path"))


@query("SELECT c_custkey, string_split(c_mktsegment || ',' || c_name || ',', ',')[2] AS second, 3 AS n FROM customer")
def comma_fields(spark, d):
    parts = X.split_commas(F.concat_ws(",", "c_mktsegment", "c_name", F.lit("")))
    return table(spark, d, "customer").select("c_custkey", parts[1].alias("second"), F.size(parts).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment LIKE '%BUILD%' THEN 'b' WHEN c_mktsegment LIKE '%AUTO%' THEN 'a' ELSE 'other' END AS kind FROM customer")
def substring_cases(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.contains_any("c_mktsegment", {"BUILD": F.lit("b"), "AUTO": F.lit("a")}, F.lit("other")).alias("kind"))


# Models, seams and streams


@query()
def joint_kmeans(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    halves = [kmeans.batches_of(rows.where(F.col("vec_id") % 2 == k), ["vec_id"], 100) for k in range(2)]
    model, _ = kmeans.fit_joint({"a": (lambda: halves[0], 1.0), "b": (lambda: halves[1], 2.0)}, "embedding", kmeans.start(rows, "embedding", 10), "label", most_frames=600, validation=rows, check_every=2, stop=kmeans.Stop(0, {"inertia": 3}))
    return kmeans.codebook(spark, model.centers)


@query("SELECT vec_id AS idx, 8 AS dims, vec_id % 4 = 0 AS silent FROM embeddings")
def sentence_vectors(spark, d):
    """A stand-in encoder's mean frame is the sentence's vector; a clip without samples has a vector of zeros."""
    audio = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.when(F.col("vec_id") % 4 != 0, F.flatten(F.array_repeat("embedding", 10))).alias("audio"))
    whole = readers.decoded(audio, "audio", 640)
    seams.register_encoder("sentence", seams.fake_encoder)
    found = seams.encode(whole, "sentence", column="audio")
    mean = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.aggregate("features", F.lit(0.0), lambda s, f: s + f[i].cast("double")) / F.size("features"))
    return found.select("idx", F.size(mean).alias("dims"), (~F.col("decode_ok")).alias("silent"))


@query(f"SELECT idx, 'last words of ' || item_id AS hypothesis FROM {BENCH}")
def speech_recognition(spark, d):
    """A stand-in recogniser, which repeats its prompt's last line up to the stop string."""
    rows = placed(spark, d, "benchmark", "item_id", "text").select("idx", F.concat("text", F.lit("\nlast words of "), "item_id", F.lit("\n \n")).alias("instruction"))
    return seams.generate(rows, lambda: seams.fake_generator("instruction")).select("idx", "hypothesis")


def _stream(spark, d):
    sinks.text_lines(placed(spark, d, "documents", "doc_id", one_line("text").alias("value")), "value", path := folder(spark))
    return streams.lines(spark, path)


def _drained(stream: DataFrame) -> DataFrame:
    spark, base = stream.sparkSession, folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return spark.read.parquet(f"{base}/rows")


@query(rf"""WITH d AS (SELECT doc_id, {ONE_LINE} AS t FROM documents), c AS (SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(len(string_split(t, '')))) AS i FROM d)
SELECT value, count(*) AS n FROM (SELECT doc_id, coalesce(string_agg(c, '' ORDER BY i), '') AS value FROM (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c) WHERE p IS DISTINCT FROM c GROUP BY doc_id) GROUP BY value""")
def stream_collapsed(spark, d):
    return _drained(streams.collapsed(_stream(spark, d))).groupBy("value").agg(F.count("*").alias("n"))


@query(rf"""SELECT value, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({ONE_LINE}), '[<\[][^>\]]*[>\]]', '', 'g'), '\(([^)]+?)\)', '', 'g'), '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g'), '\s+', ' ', 'g') AS value FROM documents) GROUP BY value""")
def stream_normalized(spark, d):
    return _drained(streams.normalized(_stream(spark, d))).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS frames, 4 AS centers FROM embeddings")
def stream_kmeans(spark, d):
    rows = table(spark, d, "embeddings").select("embedding")
    rows.write.parquet(f"{(base := folder(spark))}/in")
    model = kmeans.MiniBatch(kmeans.start(rows, "embedding", 4))
    streams.train(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), "embedding", model, f"{base}/state").awaitTermination()
    return spark.createDataFrame([(model.frames, len(model.centers))], "frames long, centers int")


@query(f"SELECT rank, piece, score, kind FROM (SELECT idx + 3 AS rank, c_name AS piece, -(idx + 3)::DOUBLE AS score, 4 AS kind FROM {PEOPLE})")
def model_files(spark, d):
    """Pieces in the binary model format, read back by the public library."""
    import sentencepiece as sp

    rows = placed(spark, d, "customer", "c_custkey", "c_name").select((F.col("idx") + 3).alias("rank"), F.col("c_name").alias("piece"), (-F.col("idx") - 3).cast("double").alias("score"), F.lit(sinks.USER_DEFINED).alias("kind"))
    base = spark.createDataFrame([(0, "<unk>", 0.0, sinks.UNKNOWN), (1, "<s>", 0.0, sinks.CONTROL), (2, "</s>", 0.0, sinks.CONTROL)], "rank long, piece string, score double, kind int")
    model = sp.SentencePieceProcessor(model_proto=sinks.extended_model(b"".join(sinks.model_pieces(base)), rows))
    found = [(k, model.id_to_piece(k), float(model.get_score(k)), sinks.USER_DEFINED) for k in range(3, model.get_piece_size())]
    return spark.createDataFrame(found, "rank long, piece string, score double, kind int")


ENGLISH_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\[][^>\]]*[>\]]', '', 'g'), '\(([^)]+?)\)', '', 'g'), '{fillers}', '', 'g'), '\s+''', '''', 'g')""".replace("{fillers}", X.FILLERS)
for _pattern, _plain in X.ENGLISH:
    ENGLISH_SQL = f"regexp_replace({ENGLISH_SQL}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_plain}', 'g')"
ENGLISH_SQL = rf"regexp_replace(regexp_replace({ENGLISH_SQL}, '(\d),(\d)', '\1\2', 'g'), '\.([^0-9]|$)', ' \1', 'g')"
# all marks, symbols and punctuation but .%$¢€£, which are set apart as letters no text has
for _k, _kept in enumerate(".%$¢€£"):
    ENGLISH_SQL = f"replace({ENGLISH_SQL}, '{_kept}', chr({0xF0000 + _k}))"
ENGLISH_SQL = rf"regexp_replace({ENGLISH_SQL}, '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g')"
for _k, _kept in enumerate(".%$¢€£"):
    ENGLISH_SQL = f"replace({ENGLISH_SQL}, chr({0xF0000 + _k}), '{_kept}')"
ENGLISH_SQL = rf"regexp_replace(regexp_replace(regexp_replace({ENGLISH_SQL}, '[.$¢€£]([^0-9])', ' \1', 'g'), '([^0-9])%', '\1 ', 'g'), '\s+', ' ', 'g')"


#: DuckDB's word ends are those of ASCII, so other characters are letters of ASCII here.
@query(f"WITH d AS (SELECT doc_id, 'Dr. Who''s been at 3,000 m; I''d say um they won''t [x] ' || regexp_replace({ONE_LINE}, '[^\x00-\x7F]', 'q', 'g') AS text FROM documents) SELECT doc_id, {ENGLISH_SQL} AS text FROM d")
def normalize_english(spark, d):
    said = F.concat(F.lit("Dr. Who's been at 3,000 m; I'd say um they won't [x] "), F.regexp_replace(one_line("text"), r"[^\x00-\x7F]", "q"))
    return table(spark, d, "documents").select("doc_id", X.normalize_english(said).alias("text"))


@query("SELECT doc_id, 'fi 1 ' || lang AS text FROM documents")
def normalize_nfkc(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize(F.concat(F.lit("ﬁ　① (x)"), F.lit(" "), "lang")).alias("text"))


@query("SELECT item_id, upper(text) AS said FROM benchmark")
def udf_seam(spark, d):
    """The surface for models and functions of one's own: Arrow batches in, a column out."""
    rows = table(spark, d, "benchmark")
    return seams.infer(rows, lambda: lambda batch: pc.utf8_upper(batch.column("text")), "said", "string").select("item_id", "said")
