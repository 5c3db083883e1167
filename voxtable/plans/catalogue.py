"""Queries over the driver's tables, one for each operator or family, and the DuckDB SQL that gives the same rows.

Every query runs over its whole tables. Where a table lacks what an operator needs (NaN, masks, splits), a projection
makes it from the row's own columns, in the query and in the SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtable.functions import numbers as N
from voxtable.functions import text as X
from voxtable.functions import units as U
from voxtable.operators import batching, evaluate, kmeans, prompts, relational as R, seams, sequence, stats, vectors, vocab
from voxtable.plans import pipelines
from voxtable.plans.register import QUERIES, SQL, Query, query, table

TEMPLATE = "Language: {lang}\nSpeech: {dsu_seq}\n{lang}:"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_set(spark, sf_dir)


# Slicing and filtering


@query("SELECT idx, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 101 AS idx, o_orderkey FROM orders) WHERE idx >= 0 AND idx < 500")
def slice_index(spark, d):
    rows = R.with_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return R.slice_rows(rows, 100, 500).select("idx", "o_orderkey")


@query("""SELECT c_custkey, '/data/' || c_mktsegment || '/' || c_name || '_mic' || (c_custkey % 3) || '.wav' AS file FROM customer WHERE c_custkey % 3 = 1""")
def suffix_filter(spark, d):
    file = F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), "c_name", F.lit("_mic"), (F.col("c_custkey") % 3).cast("string"), F.lit(".wav"))
    return R.suffix_filter(table(spark, d, "customer").select("c_custkey", file.alias("file")), "file", "mic1")


@query("""SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)
WHERE v >= 4.5 AND v <= 60 AND NOT isnan(v)""")
def minmax_filter(spark, d):
    v = F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value"))
    return R.within(table(spark, d, "events").select("event_id", v.alias("v")), {"v": 4.5}, {"v": 60})


@query("SELECT doc_id, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality >= 1 AND toxic <= 0 AND n_chars >= 200")
def quality_filter(spark, d):
    return R.within(labelled(spark, d), {"quality": 1, "n_chars": 200}, {"toxic": 0}).select("doc_id", "n_chars")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def topk_highest(spark, d):
    return R.top_k(table(spark, d, "events").select("event_id", "value"), "value", 100, True, ["event_id"])


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 100")
def topk_lowest(spark, d):
    return R.top_k(table(spark, d, "events").select("event_id", "value"), "value", 100, False, ["event_id"])


@query("SELECT event_id, value FROM events")
def topk_noop(spark, d):
    return R.top_k(table(spark, d, "events").select("event_id", "value"), "value", 0, True, ["event_id"])


@query()
def topk_random(spark, d):
    return R.random_k(table(spark, d, "documents").select("doc_id", "n_chars"), 100, 42, ["doc_id"])


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1 AS shard, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents")
def shards(spark, d):
    rows = R.with_index(table(spark, d, "documents").select("doc_id"), "doc_id").withColumn("shard", R.shard_of(100))
    return batching.fixed_batches(rows, 16, "idx").select("doc_id", "shard", "batch")


@query("""SELECT conv_id, count(*) AS n FROM (SELECT conv_id, CASE WHEN turn = 3 AND conv_id % 2 = 0 THEN '' ELSE text END AS t FROM conversations)
GROUP BY conv_id HAVING count(*) FILTER (t IS NULL OR t = '') = 0""")
def drop_bad(spark, d):
    value = F.when((F.col("turn") == 3) & (F.col("conv_id") % 2 == 0), "").otherwise(F.col("text"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("from"), value.alias("value")))).alias("conversations"))
    return R.drop_bad_conversations(rows).select("conv_id", F.size("conversations").cast("long").alias("n"))


# Joins

STATUS = "CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'train_covost' ELSE 'dev_covost' END"
STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'train_covost' ELSE 'dev_covost' END"


def _splits(spark, d, version, split):
    rows = table(spark, d, "orders").withColumn("split", F.expr(STATUS)).withColumnRenamed("o_custkey", "c_custkey")
    return R.inner_on(R.split_rows(rows, split, version), table(spark, d, "customer"), "c_custkey").select("o_orderkey", "c_name", "split")


@query(f"SELECT o_orderkey, c_name, split FROM (SELECT *, {STATUS_SQL} AS split FROM orders) JOIN customer ON o_custkey = c_custkey WHERE split IN ('dev', 'dev_covost')")
def split_v1(spark, d):
    return _splits(spark, d, 1, "dev")


@query(f"SELECT o_orderkey, c_name, split FROM (SELECT *, {STATUS_SQL} AS split FROM orders) JOIN customer ON o_custkey = c_custkey WHERE split IN ('train', 'train_covost')")
def split_v2(spark, d):
    return _splits(spark, d, 2, "train")


@query("""WITH t AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT doc_id, t.text AS text FROM documents d JOIN t ON d.doc_id = t.conv_id WHERE t.text <> ''""")
def lookup_transcripts(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"))
    found = R.lookup(rows, table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "text", "turn")
    return R.not_empty(found, "text").select(F.col("conv_id").alias("doc_id"), "text")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id FROM documents), b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, item_id FROM benchmark)
SELECT idx, doc_id, item_id, 'en' AS lang FROM a JOIN b USING (idx)""")
def zip_join(spark, d):
    a, b = R.with_index(table(spark, d, "documents").select("doc_id"), "doc_id"), R.with_index(table(spark, d, "benchmark").select("item_id"), "item_id")
    return R.zip_join(a, b, lang="en").select("idx", "doc_id", "item_id", "lang")


@query("SELECT a.item_id, m.item_id AS found FROM benchmark a JOIN (SELECT text, max(item_id) AS item_id FROM benchmark GROUP BY text) m USING (text)")
def strict_parallel(spark, d):
    b = table(spark, d, "benchmark")
    return R.strict_lookup(b, b.select("text", F.col("item_id").alias("found"), "item_id"), "text", "found", "item_id").select("item_id", "found")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def results_by_place(spark, d):
    places, found = (table(spark, d, t).withColumnRenamed("doc_id", "idx") for t in ("documents", "labels"))
    return R.by_place(found.select("idx", "quality"), places, quality=-1).select(F.col("idx").alias("doc_id"), "quality")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_keys(spark, d):
    return R.missing_keys(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def branch_cube(spark, d):
    return R.cube(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, text FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, text FROM documents)
SELECT idx, text FROM a UNION ALL SELECT idx + (SELECT count(*) FROM a), text FROM b""")
def concat_lines(spark, d):
    a, b = R.with_index(table(spark, d, "benchmark"), "item_id"), R.with_index(table(spark, d, "documents"), "doc_id")
    return R.concat(a.select("idx", "text"), b.select("idx", "text")).select("idx", "text")


# Aggregates


@query("""SELECT count(*) AS n_rows, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_discount), 6) AS mean_l_discount, round(avg(l_extendedprice), 4) AS mean_l_extendedprice,
round(stddev_pop(l_extendedprice), 4) AS std_l_extendedprice, round(sum(l_extendedprice) / 3600, 2) AS hours FROM lineitem""")
def corpus_stats(spark, d):
    out = stats.corpus_stats(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    digits = {"mean_l_quantity": 6, "mean_l_discount": 6, "mean_l_extendedprice": 4, "std_l_extendedprice": 4, "hours": 2}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def mean_by_key(spark, d):
    return stats.mean_by(table(spark, d, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type AS key, round(avg(value), 6) AS \"COMET\" FROM events GROUP BY event_type")
def mean_scores(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").alias("COMET"))
    return stats.mean_scores(rows).withColumn("COMET", F.round("COMET", 6))


@query("""SELECT doc_id, n_chars / 16000.0::DOUBLE AS samples, n_chars / 32000.0::DOUBLE AS bytes, (n_chars * 2 - n_chars)::DOUBLE AS times, n_chars::DOUBLE AS duration,
n_chars / 180000.0::DOUBLE AS hours, (ceil(n_chars / 64.0) * 64)::BIGINT AS padded, greatest(floor((n_chars - 400) / 320.0) + 1, 0)::INT AS frames FROM documents""")
def lengths(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.col("n_chars").alias("wav_filesize"), F.col("n_chars").alias("begin_time"), (F.col("n_chars") * 2).alias("end_time"), F.col("n_chars").alias("audio_duration"))
    return rows.select(
        "doc_id", N.seconds_of_samples("n_chars").alias("samples"), N.LENGTHS["bytes"]().alias("bytes"), N.LENGTHS["times"]().alias("times"), N.LENGTHS["duration"]().alias("duration"),
        N.hours_of_frames("n_chars").alias("hours"), N.padded_size(F.col("n_chars")).alias("padded"), N.pooled_length("n_chars", 400, 320).alias("frames"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 1.7976931348623157e308 ELSE value END AS v FROM events""")
def nan_to_num(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 3 == 1, float("inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", N.nan_to_num(v).alias("v"))


# Sequences


@query("""SELECT user_id, ts, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p IS DISTINCT FROM event_type""")
def collapse_long(spark, d):
    return sequence.collapse_runs(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS types FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p IS DISTINCT FROM event_type GROUP BY user_id""")
def collapse_array(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("a"))
    return rows.select("user_id", U.spaced(U.collapse("a")).alias("types"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, '')))) AS i FROM documents)
SELECT doc_id, string_agg(c, '' ORDER BY i) AS text FROM (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c) WHERE p IS DISTINCT FROM c GROUP BY doc_id""")
def collapse_chars(spark, d):
    return table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", U.collapse_chars("text").alias("text"))


LABELS_SQL = """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 11 = 0 THEN -1 ELSE length(event_type) END AS l FROM events),
k AS (SELECT *, lag(l) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e WHERE l <> -1)
SELECT user_id, string_agg({}, '' ORDER BY ts, event_id) AS units FROM k WHERE p IS DISTINCT FROM l GROUP BY user_id"""


def _labels(spark, d):
    label = F.when(F.col("event_id") % 11 == 0, U.PAD).otherwise(F.length("event_type"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", label.alias("l")))), lambda x: x["l"]).alias("labels"))
    return rows.where(F.exists("labels", lambda x: x != U.PAD))


@query(LABELS_SQL.format("chr((983040 + l)::INT)"))
def unit_strings(spark, d):
    return _labels(spark, d).select("user_id", U.detokenize("labels").alias("units"))


@query(LABELS_SQL.format("'<extra_id_' || l || '>'"))
def unit_marks(spark, d):
    return _labels(spark, d).select("user_id", U.detokenize("labels", form="mark").alias("units"))


@query("SELECT doc_id, n_chars::INT AS unit FROM documents")
def unit_roundtrip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", U.unit_string(F.array(F.col("n_chars").cast("int"))).alias("s"))
    return rows.select("doc_id", F.element_at(U.string_units("s"), 1).cast("int").alias("unit"))


POOL_SQL = """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings)
SELECT vec_id, i // 5 AS w, round({}(v), 6) AS v FROM x WHERE i < 60 GROUP BY vec_id, i // 5"""


def _pooled(spark, d, kind):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(sequence.pool_array("embedding", 5, kind)).alias("w", "v"))
    return rows.select("vec_id", F.col("w").cast("long"), F.round("v", 6).alias("v"))


@query(POOL_SQL.format("avg"))
def pool_mean(spark, d):
    return _pooled(spark, d, "mean")


@query(POOL_SQL.format("max"))
def pool_max(spark, d):
    return _pooled(spark, d, "max")


@query("""WITH f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding FROM embeddings),
x AS (SELECT label, t // 3 AS w, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM f)
SELECT label, w, dim, round(avg(v), 6) AS v FROM x GROUP BY ALL HAVING count(*) = 3""")
def pool_frames(spark, d):
    frames = table(spark, d, "embeddings").withColumn("t", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    out = sequence.pool(frames, "label", "t", "embedding", 3).select("label", F.col("window").alias("w"), F.posexplode("embedding").alias("dim", "v"))
    return out.select("label", "w", F.col("dim").cast("long"), F.round("v", 6).alias("v"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, unnest(range(64)) AS t, 1 + vec_id % 64 AS n FROM embeddings)
SELECT vec_id, t, round(value, 6) AS value FROM x WHERE t < n""")
def mask_flatten(spark, d):
    rows = table(spark, d, "embeddings").withColumn("mask", N.length_mask((1 + F.col("vec_id") % 64).cast("int"), F.size("embedding")))
    return sequence.flatten_masked(rows, "vec_id", "embedding", "mask").select("vec_id", F.col("t").cast("long"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("SELECT sum(1 + vec_id % 64)::BIGINT AS n_frames, (count(*) * 64)::BIGINT AS n_padded_frames, round(1 - sum(1 + vec_id % 64) / (count(*) * 64.0), 9)::DOUBLE AS pad_share FROM embeddings")
def padding_share(spark, d):
    rows = table(spark, d, "embeddings").select(N.length_mask((1 + F.col("vec_id") % 64).cast("int"), F.size("embedding")).alias("mask"))
    return sequence.padding_share(rows, "mask").withColumn("pad_share", F.round("pad_share", 9))


@query("SELECT vec_id, ceil((vec_id % 64) / 2.0)::INT AS n_true FROM embeddings")
def halved_masks(spark, d):
    mask = N.halve_mask(N.length_mask((F.col("vec_id") % 64).cast("int"), F.lit(64)))
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter(mask, lambda m: m)).alias("n_true"))


@query("""WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn FROM documents),
r AS (SELECT lang, rn, doc_id, 0 AS batch, n_chars AS longest, 1 AS c FROM o WHERE rn = 1
 UNION ALL SELECT o.lang, o.rn, o.doc_id, CASE WHEN longest * c >= 50000 THEN batch + 1 ELSE batch END, CASE WHEN longest * c >= 50000 THEN n_chars ELSE greatest(longest, n_chars) END,
 CASE WHEN longest * c >= 50000 THEN 1 ELSE c + 1 END FROM r JOIN o ON o.lang = r.lang AND o.rn = r.rn + 1)
SELECT lang, doc_id, batch::BIGINT AS batch FROM r""")
def token_batches(spark, d):
    rows = batching.length_rank(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), "n_chars", ["lang"], ["doc_id"])
    return batching.budget_batches(rows, "n_chars", 50_000, ["lang"]).select("lang", "doc_id", "batch")


@query("""WITH RECURSIVE o AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn FROM documents),
r AS (SELECT lang, rn, 0 AS batch, n_chars AS longest, 1 AS c FROM o WHERE rn = 1
 UNION ALL SELECT o.lang, o.rn, CASE WHEN longest * c >= 50000 THEN batch + 1 ELSE batch END, CASE WHEN longest * c >= 50000 THEN n_chars ELSE greatest(longest, n_chars) END,
 CASE WHEN longest * c >= 50000 THEN 1 ELSE c + 1 END FROM r JOIN o ON o.lang = r.lang AND o.rn = r.rn + 1),
b AS (SELECT lang, batch FROM r GROUP BY lang, batch HAVING max(longest) * max(c) >= 50000)
SELECT lang, count(*) AS n_batches FROM b GROUP BY lang""")
def batch_counts(spark, d):
    rows = batching.length_rank(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), "n_chars", ["lang"], ["doc_id"])
    batches = batching.budget_batches(rows, "n_chars", 50_000, ["lang"])
    return batching.batch_counts(batching.whole_batches(batches, "n_chars", 50_000, ["lang"]), ["lang"])


@query("""WITH RECURSIVE o AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
r AS (SELECT event_type, rn, event_id, 0 AS shard, value AS s FROM o WHERE rn = 1
 UNION ALL SELECT o.event_type, o.rn, o.event_id, CASE WHEN s >= 900 THEN shard + 1 ELSE shard END, CASE WHEN s >= 900 THEN value ELSE s + value END FROM r JOIN o ON o.event_type = r.event_type AND o.rn = r.rn + 1)
SELECT event_type, event_id, shard::BIGINT AS shard FROM r""")
def hour_shards(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", "value")
    return batching.total_shards(rows, "value", 900, ["event_type"], ["event_id"]).select("event_type", "event_id", "shard")


@query("""SELECT event_type, event_id FROM (SELECT *, coalesce(sum(event_id % 7) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) WHERE b < 900""")
def hours_limit(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", (F.col("event_id") % 7).cast("double").alias("h"))
    return batching.until_total(rows, "h", 900, ["event_type"], ["event_id"]).select("event_type", "event_id")


EMA_SQL = "SELECT event_type, count(*) AS n, round(list_reduce(list(value ORDER BY event_id), lambda a, v: 0.98 * a + 0.02 * v, 1.0::DOUBLE), 6) AS avg FROM events GROUP BY event_type"


@query(EMA_SQL)
def ema_lengths(spark, d):
    return sequence.moving_average(table(spark, d, "events"), "event_type", ["event_id"], "value").withColumn("avg", F.round("avg", 6))


@query(EMA_SQL)
def ema_lengths_blocks(spark, d):
    return sequence.moving_average(table(spark, d, "events"), "event_type", ["event_id"], "value", block=500).withColumn("avg", F.round("avg", 6))


@query("SELECT lang, round(count(*) / avg(n_chars) / sum(count(*) / avg(n_chars)) OVER (), 9) AS p FROM documents GROUP BY lang")
def sampling_shares(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("w"), F.avg("n_chars").alias("a"))
    return sequence.sampling_shares(rows, "w", "a").select("lang", F.round("p", 9).alias("p"))


@query()
def source_draws(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("w"), F.avg("n_chars").alias("a"))
    return sequence.draw_sources(sequence.sampling_shares(rows, "w", "a"), 1000, "lang")


@query("""WITH b AS (SELECT event_type, event_id, value, min(value) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, min(value) OVER (o ROWS UNBOUNDED PRECEDING) AS best, row_number() OVER o AS n
 FROM events WINDOW o AS (PARTITION BY event_type ORDER BY event_id)),
i AS (SELECT *, n - max(CASE WHEN p IS NULL OR value < p THEN n END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bad FROM b)
SELECT event_type, event_id, best, bad, bool_or(bad >= 5) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stop FROM i""")
def early_stop(spark, d):
    return sequence.early_stopping(table(spark, d, "events"), "event_id", "value", 5, keys=["event_type"]).select("event_type", "event_id", "best", F.col("bad").cast("long"), "stop")


# Vectors

CENTERS = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM embeddings),
c AS (SELECT label, dim, avg(v) AS m, count(*) AS n FROM x GROUP BY label, dim)"""
NEAREST = f"""{CENTERS}, dist AS (SELECT vec_id, c.label AS k, sum((v - m) * (v - m)) AS d FROM x JOIN c USING (dim) GROUP BY ALL),
a AS (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM dist GROUP BY vec_id)"""


def _book(spark, d):
    return vectors.centers_of(table(spark, d, "embeddings"), "label", "embedding").select(F.col("label").cast("long").alias("k"), "center")


@query(f"WITH {NEAREST} SELECT vec_id, k::BIGINT AS k, round(d, 6) AS distance FROM a")
def assign_centroid(spark, d):
    return vectors.assign(table(spark, d, "embeddings"), _book(spark, d), "embedding").select("vec_id", "k", F.round("distance", 6).alias("distance"))


@query(f"WITH {NEAREST} SELECT vec_id, k::BIGINT AS k, round(d, 6) AS distance FROM a")
def assign_blocks(spark, d):
    return vectors.assign_blocks(table(spark, d, "embeddings"), _book(spark, d), "embedding").select("vec_id", "k", F.round("distance", 6).alias("distance"))


@query(f"WITH {NEAREST} SELECT vec_id, k::BIGINT AS k, round(d, 6) AS distance FROM a")
def assign_long(spark, d):
    return vectors.assign_long(table(spark, d, "embeddings"), _book(spark, d), "embedding", "vec_id", blocks=4).select("vec_id", "k", F.round("distance", 6).alias("distance"))


@query(f"WITH {NEAREST} SELECT round(sum(d), 4) AS inertia FROM a")
def inertia(spark, d):
    return vectors.inertia(vectors.assign_blocks(table(spark, d, "embeddings"), _book(spark, d), "embedding")).withColumn("inertia", F.round("inertia", 4))


@query(f"""WITH {CENTERS}, e AS (SELECT vec_id, label, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN c USING (label, dim) GROUP BY ALL), s AS (SELECT label, avg(d) AS s FROM e GROUP BY label),
m AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT i, max((p.s + q.s) / d) AS r FROM m JOIN s p ON p.label = i JOIN s q ON q.label = j GROUP BY i)""")
def davies_bouldin(spark, d):
    return vectors.davies_bouldin(table(spark, d, "embeddings"), "label", "embedding").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"""WITH {CENTERS}, g AS (SELECT dim, avg(v) AS g FROM x GROUP BY dim), b AS (SELECT sum(n * (m - g) * (m - g)) AS b, count(DISTINCT label) AS k FROM c JOIN g USING (dim)),
w AS (SELECT sum((v - m) * (v - m)) AS w, count(DISTINCT vec_id) AS n FROM x JOIN c USING (label, dim)) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w""")
def calinski_harabasz(spark, d):
    return vectors.calinski_harabasz(table(spark, d, "embeddings"), "label", "embedding").select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(f"""WITH {NEAREST}, y AS (SELECT a.k, dim, avg(v) AS m FROM x JOIN a USING (vec_id) GROUP BY ALL)
SELECT round(sqrt(sum((y.m - c.m) * (y.m - c.m))) / sqrt(sum(c.m * c.m)), 6) AS delta FROM y JOIN c ON c.label = y.k AND c.dim = y.dim""")
def centroid_delta(spark, d):
    book = _book(spark, d)
    moved = vectors.centers_of(vectors.assign_blocks(table(spark, d, "embeddings"), book, "embedding"), "k", "embedding")
    return vectors.center_delta(moved, book).select(F.round("delta", 6).alias("delta"))


@query("SELECT dim, round(avg(v), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM embeddings) GROUP BY dim")
def vec_mean(spark, d):
    return vectors.mean_vector(table(spark, d, "embeddings"), "embedding").select(F.col("dim").cast("long"), F.round("mean", 6).alias("mean"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM embeddings)
SELECT a.dim AS i, b.dim AS j, round(covar_pop(a.v, b.v), 6) + 0.0 AS cov FROM x a JOIN x b USING (vec_id) GROUP BY ALL""")
def vec_cov(spark, d):
    return vectors.covariance(table(spark, d, "embeddings"), "embedding").select(F.col("i").cast("long"), F.col("j").cast("long"), (F.round("cov", 6) + 0.0).alias("cov"))


@query()
def kmeans_fit(spark, d):
    return kmeans.fit(table(spark, d, "embeddings"), "embedding", 10)


@query()
def kmeans_batches(spark, d):
    rows = table(spark, d, "embeddings")
    model, _ = kmeans.fit_batches(kmeans.batches_of(rows, ["vec_id"], 250), "embedding", kmeans.start(rows, "embedding", 10), check_every=2)
    return kmeans.codebook(spark, model.centers)


@query("""WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS dim FROM embeddings), m AS (SELECT list(round(m, 4) ORDER BY dim) AS mean FROM (SELECT dim, avg(v) AS m FROM x GROUP BY dim)),
n AS (SELECT count(*) AS n, (ceil((count(*) + 5) / 64.0) * 64)::BIGINT AS size FROM embeddings)
SELECT i AS id, 64 AS dims, round(e.embedding[1]::DOUBLE, 6) AS first, CASE WHEN e.vec_id IS NULL THEN mean[1] END AS centre FROM n, m, LATERAL (SELECT unnest(range(size)) AS i) LEFT JOIN embeddings e ON e.vec_id = i""")
def new_embeddings(spark, d):
    """Old rows stay; new ones are drawn around the mean, which their own mean comes near (to 0.02 with so small a scale)."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    n = rows.count()
    out = vocab.extend_embeddings(rows, N.padded_size(n + 5, 64))
    mean = vectors.mean_vector(rows, "vec").where("dim = 0").select(F.col("mean").alias("m"))
    first = F.col("vec")[0].cast("double")
    placed = out.crossJoin(F.broadcast(mean))
    return placed.select("id", F.size("vec").alias("dims"), F.when(F.col("id") < n, F.round(first, 6)).alias("first"), F.when((F.col("id") >= n) & (F.abs(first - F.col("m")) < 0.02), F.round("m", 4)).alias("centre"))


# Text


@query("""SELECT idx, 'Language: ' || lang || chr(10) || 'Speech: ' || text || chr(10) || lang || ':' AS human, doc_id::VARCHAR AS gpt
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)""")
def instructions(spark, d):
    rows = R.with_index(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    out = prompts.instructions(rows, TEMPLATE, {"lang": F.col("lang"), "dsu_seq": F.col("text")}, "doc_id")
    return out.select("idx", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"))


@query("""SELECT item_id AS idx, '<|im_start|>user' || chr(10) || 'Speech: ' || text || chr(10) || 'English:<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS instruction FROM benchmark""")
def chat_instructions(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("idx"), "text")
    return prompts.prompts(rows, X.DEFAULT_TEMPLATE, {"dsu_seq": F.col("text")}, chat=True)


@query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
 || CASE WHEN arg_max(role, turn) = 'assistant' THEN '' ELSE '<|im_start|>assistant' || chr(10) END AS prompt FROM conversations GROUP BY conv_id""")
def chat_prompt(spark, d):
    return prompts.chats(table(spark, d, "conversations"), "conv_id", "turn")


@query("""WITH t AS (SELECT d.doc_id, text, lang, n_chars FROM documents d JOIN labels USING (doc_id) WHERE quality >= 1 AND n_chars >= 100 ORDER BY n_chars DESC, d.doc_id LIMIT 100)
SELECT doc_id AS idx, 'Language: ' || lang || chr(10) || 'Speech: ' || text || chr(10) || lang || ':' AS human, n_chars::VARCHAR AS gpt FROM t""")
def training_set(spark, d):
    corpus = labelled(spark, d).withColumn("idx", F.col("doc_id"))
    rows = pipelines.training_rows(corpus, least={"quality": 1, "n_chars": 100}, top=("n_chars", 100, True))
    out, _ = pipelines.training_set(rows, TEMPLATE, {"lang": F.col("lang"), "dsu_seq": F.col("text")}, "n_chars")
    return out.select("idx", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_project(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(r"""SELECT doc_id, string_split_regex(text, '<\\s>|\\n|\n|<END>')[1] AS cut FROM documents""")
def stop_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.cut_at_stop("text").alias("cut"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\[][^>\]]*[>\]]', '', 'g'), '\(([^)]+?)\)', '', 'g'),
'[\p{M}\p{S}\p{P}]', ' ', 'g'), '\s+', ' ', 'g') AS text FROM documents""")
def normalize_basic(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_basic("text").alias("text"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS host FROM pages""")
def path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", X.basename("url").alias("base"), X.first_field(F.regexp_replace("url", "^https?://", ""), "/").alias("host"))


WER_WORDS = r"list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\[][^>\]]*[>\]]', '', 'g'), '\(([^)]+?)\)', '', 'g'), '[\p{M}\p{S}\p{P}]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT lang, {WER_WORDS} AS ws FROM documents)
SELECT lang, sum(len(list_filter(ws, lambda w: w = 'the')))::BIGINT AS edits, sum(len(ws))::BIGINT AS ref_words, round(sum(len(list_filter(ws, lambda w: w = 'the'))) / sum(len(ws)), 9) AS wer FROM w GROUP BY lang""")
def word_errors(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "lang", "text")
    heard = docs.select("idx", "lang", F.regexp_replace(F.lower("text"), r"\bthe\b", "qqq").alias("hypothesis"))
    # the branch is the language; the hypothesis replaces one word by another that no text has
    return pipelines.word_error_table(docs.select("idx", F.col("text").alias("reference")), heard, ["lang"]).withColumn("wer", F.round("wer", 9))


#: The hypothesis says "and" where the reference says "the", and lacks its last words.
HEARD = r"regexp_replace(regexp_replace(text, '\b[Tt]he\b', 'and', 'g'), '(\s+\S+){3}$', '')"
#: Matches of n-grams that are arrays ``ws`` of parts in r and h, clipped in each row.
MATCHES = """g AS (SELECT item_id, side, n, ws[k:k + n - 1] AS g, count(*) AS c FROM t, (SELECT unnest(range(1, {orders} + 1)) AS n), LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS k) GROUP BY ALL),
m AS (SELECT r.n, sum(least(r.c, h.c)) AS m FROM g r JOIN g h ON r.item_id = h.item_id AND r.n = h.n AND r.g = h.g AND r.side = 'r' AND h.side = 'h' GROUP BY r.n),
s AS (SELECT n, sum(c) FILTER (side = 'h') AS h, sum(c) FILTER (side = 'r') AS r FROM g GROUP BY n),
x AS (SELECT s.n, coalesce(m, 0) AS m, h, r FROM s LEFT JOIN m USING (n))"""


def _heard(spark, d):
    text = F.regexp_replace(F.regexp_replace("text", r"\b[Tt]he\b", "and"), r"(\s+\S+){3}$", "")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("idx"), "text", text.alias("hypothesis"))


@query(f"""WITH t AS (SELECT item_id, 'r' AS side, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM benchmark
UNION ALL SELECT item_id, 'h', list_filter(string_split_regex({HEARD}, '\\s+'), lambda w: w <> '') FROM benchmark), {MATCHES.format(orders=4)}
SELECT round(100 * (SELECT CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END FROM x WHERE n = 1) * exp(sum(ln(m / h)) / 4), 6) AS bleu FROM x""")
def bleu(spark, d):
    return evaluate.bleu(_heard(spark, d), "text", "hypothesis").select(F.round("bleu", 6).alias("bleu"))


@query()
def bleu_pieces(spark, d):
    """BLEU over the pieces of a public SentencePiece model."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        cut = evaluate.sentence_pieces(f.read())
    return evaluate.bleu(_heard(spark, d), "text", "hypothesis", tokenizer=cut).select(F.round("bleu", 6).alias("bleu"))


@query(f"""WITH t AS (SELECT item_id, 'r' AS side, list_filter(string_split(regexp_replace(text, '\\s+', '', 'g'), ''), lambda w: w <> '') AS ws FROM benchmark
UNION ALL SELECT item_id, 'h', list_filter(string_split(regexp_replace({HEARD}, '\\s+', '', 'g'), ''), lambda w: w <> '') FROM benchmark), {MATCHES.format(orders=6)}
SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM (SELECT avg(m / h) AS p, avg(m / r) AS r FROM x)""")
def chrf(spark, d):
    return evaluate.chrf(_heard(spark, d), "text", "hypothesis").select(F.round("chrf", 6).alias("chrf"))


@query(r"""WITH v AS (SELECT w AS piece, row_number() OVER (ORDER BY w) - 1 AS rank FROM (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS w FROM benchmark) WHERE w <> ''),
n AS (SELECT w AS piece FROM (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS w FROM documents) WHERE w <> '' AND w NOT IN (SELECT piece FROM v)),
m AS (SELECT max(rank) AS m FROM v), a AS (SELECT '<s0>' AS piece, 1 AS i, true AS special UNION ALL SELECT '<s1>', 2, true UNION ALL SELECT piece, row_number() OVER (ORDER BY piece) + 2, false FROM n)
SELECT rank, piece, (-rank)::DOUBLE AS score, false AS special FROM v UNION ALL SELECT m + i, piece, (-m - i)::DOUBLE, special FROM a, m""")
def vocab_extend(spark, d):
    words = lambda t: table(spark, d, t).select(F.explode(F.split("text", r"\s+")).alias("piece")).where("piece <> ''").distinct()
    ranked = R.with_index(words("benchmark"), "piece", name="rank")
    known = ranked.withColumn("score", (-F.col("rank")).cast("double"))
    fresh = R.with_index(vocab.new_types(words("documents"), known), "piece")
    return vocab.extend(known, ["<s0>", "<s1>"], fresh).select("rank", "piece", "score", "special")


# Seams


@query()
def unit_labels(spark, d):
    """Audio stands for each embedding's samples; a fake encoder, nearest centroids, collapsed units."""
    audio = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.flatten(F.array_repeat("embedding", 40)).alias("audio"))
    feats = seams.infer(audio, lambda: seams.fake_encoder("audio"), "features", "array<array<float>>")
    frames = feats.select("idx", F.posexplode("features").alias("t", "feat")).withColumn("mask", F.lit(True))
    book = frames.groupBy("t").agg(F.min_by("feat", "idx").alias("center")).select(F.col("t").cast("long").alias("k"), "center")
    return pipelines.unit_lines(frames, book, audio)


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, 'English:' AS hypothesis, true AS scored FROM benchmark")
def generated_text(spark, d):
    rows = prompts.prompts(R.with_index(table(spark, d, "benchmark"), "item_id"), X.DEFAULT_TEMPLATE, {"dsu_seq": F.col("text")})
    said = seams.score(seams.generate(rows, lambda: seams.fake_generator("instruction")), lambda: seams.fake_scorer("hypothesis"))
    return said.select("idx", "hypothesis", F.col("score").between(0, 1).alias("scored"))


def queries() -> dict[str, Query]:
    from voxtable.plans import roundtrips  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in queries() if (sql := SQL.get(name))}
