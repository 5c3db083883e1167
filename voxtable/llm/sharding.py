"""Proportional stratified interleaving (operator 1).

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank (r - 1/2) / n spreads each
source evenly over (0, 1), so the order by fractional rank has the mixture of the whole in every stretch. That order is
cut into shards whose row counts are at most one apart (law ``rows``).

Both orders are made by range partitions, which are sorted and numbered apart; the partitions' counts give the offsets.
The last key of each order is a number of the row's own, so ranges can be cut anywhere: neither a hot source nor any
number of rows with one fraction (one-row sources), one id or one text meet in one task. Only ids, sizes and checksums
move; there are ``MOST_PARTITIONS`` ranges at most.

Defined results: a null text counts as an empty one, a very long one is only measured; null sources are one source; a
null id is a value like another; ties in both orders are broken by the hash and, between equal rows, by their place in
the input; an empty table gives no rows; further columns don't matter. Those that are carried along keep their names,
or get underscores at the end where the operator's own columns have that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtable.llm.shared import drop_tables, free, parts_for, stash, table

LAW = "rows"
OVERHEAD = 16
#: Rows of a range, on average, for as long as there are no more ranges than ``MOST_PARTITIONS``.
BUCKET_ROWS = 20_000
N_SHARDS = 40
SEED = 17
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: The low bits of ``monotonically_increasing_id`` are a row's place in its partition.
PLACE_BITS = 33


def ranges(rows: DataFrame, n: int, order: list[Column], written: list[str]) -> DataFrame:
    """The rows in ``n`` sorted ranges, with ``__part`` and ``__at`` (from 0 in the range), written to the shared folder."""
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id64", F.monotonically_increasing_id())
    place = ordered.withColumns({"__part": F.shiftright("__id64", PLACE_BITS).cast("int"), "__at": F.col("__id64").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    return stash(place.drop("__id64"), written)


def assign(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, source, size, text_crc32, law, shard, slot, grown_shard for each row, and the columns named in ``carry``."""
    spark, written = docs.sparkSession, []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        # a null source is a source of its own, apart from an empty name
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("__source"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
        *(F.col(c).alias(f"__carry_{c}") for c in carry),
    )
    rows = stash(rows.withColumns({"__h": F.xxhash64(F.lit(seed), "__id", "__crc", "__size"), "__row": F.monotonically_increasing_id()}), written)
    total = rows.count()
    n = parts_for(spark, total, BUCKET_ROWS)

    # within the sources: a range's first place of a source, and the source's rows in ranges before
    ranked = ranges(rows, n, [F.col(c) for c in ("__source", "__h", "__id", "__crc", "__row")], written)
    counts = ranked.groupBy("__source", "__part").agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    whole = W.partitionBy("__source")
    before = F.sum("__c").over(whole.orderBy("__part")) - F.col("__c")
    counts = counts.select("__source", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__c").over(whole).alias("__n"))
    ranked = ranked.join(counts, ["__source", "__part"]).withColumn("__f", (F.col("__at") + F.col("__shift") + 0.5) / F.col("__n")).drop("__part", "__at", "__shift", "__n")

    # over all rows: as many offsets as there are ranges
    order = [F.col("__f"), F.xxhash64(F.lit(seed), "__source"), *(F.col(c) for c in ("__source", "__h", "__id", "__crc", "__row"))]
    placed = ranges(ranked, n, order, written)
    offsets = placed.groupBy("__part").agg(F.count("*").alias("__c")).select("__part", (F.sum("__c").over(W.orderBy("__part")) - F.col("__c")).alias("__before"))
    drop_tables(spark, written[:-1])  # the last one is what the result reads
    placed = placed.join(F.broadcast(offsets), "__part").withColumn("__place", F.col("__before") + F.col("__at"))
    placed = placed.withColumn("__shard", F.expr(f"(__place * {n_shards}) div {max(total, 1)}"))
    taken = (id_col, source_col, *OWN)
    return placed.select(
        F.col("__id").alias(id_col),
        F.expr("if(__source = 'n', null, substring(__source, 2))").alias(source_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        # shard s starts at the least place p with p * n_shards >= s * total
        (F.col("__place") - F.expr(f"(__shard * {total} + {n_shards - 1}) div {n_shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(F.col(f"__carry_{c}").alias(free(c, taken)) for c in carry if c not in (id_col, source_col)),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, **options) -> None:
    """Writes whole rows below ``path``, a folder for each shard, in the order of their slots."""
    rows = assign(docs, n_shards, carry=tuple(docs.columns), **options)
    rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
