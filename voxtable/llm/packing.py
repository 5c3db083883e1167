"""Conflict-constrained best-fit packing (operator 9).

Texts are cut into pieces of ``CAPACITY`` words at most; pieces go into bins of that capacity, longest first, each into the
tightest bin that it fits in and doesn't conflict with. Conflicts: a bin holds no two pieces of one duplicate cluster
(``cluster_col`` where given, as by the n-gram join's components; else equal words, whatever their case and spacing), and
pieces of ``MOST_SOURCES`` sources at most. Bins are kept in the
order of their residuals and carry bitmaps of their sources and clusters; from the tightest bin that
is large enough the search goes on to the successor until a compatible one is found, or opens a bin.

Pieces are dealt to groups of about ``GROUP_ROWS`` by a hash of the id, whatever their source or cluster, and a group
is packed by one task; only ids, counts and hashes move. Rows of an id and text that are more than a group takes are found
by a count and dealt out by their own numbers. At most one bin a group and conflict pattern is left open.

Defined results: a null or empty text has one piece of no words; a very long text has as many pieces as it needs, of one
cluster, so each is in another bin; null sources are one source; null clusters conflict with nothing; a null id is packed
like another; equal rows are packed each; ties go by id, piece, cluster and source; an empty table gives no rows; further
columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.kernel import FOLDED, U64, lean, mix, rows_of
from voxtable.llm.shared import parts_for, small, stash, table

CAPACITY, MOST_SOURCES = 2048, 8
GROUP_ROWS = 20_000
MAP_BITS = 256

MEASURED = "doc_id long, known boolean, n_words long, cluster long, source string, given string"


@lean
def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, words in rows_of(batch.column(1)):
            n = len(words.counts)
            hashes = words.hashes(FOLDED)
            cluster = words.counts.astype(U64)
            have = np.flatnonzero(words.counts)
            if len(have):
                place = np.arange(len(words)) - np.repeat(words.first[:-1], words.counts)
                cluster[have] += np.add.reduceat(mix(hashes ^ mix(place.astype(U64) + U64(1))), words.first[:-1][have])
            ids = batch.column(0).slice(start, n)
            yield pa.RecordBatch.from_arrays([ids, ids.is_valid(), pa.array(words.counts.astype(np.int64)), pa.array(cluster.view(np.int64)), batch.column(2).slice(start, n), batch.column(3).slice(start, n)], names=["doc_id", "known", "n_words", "cluster", "source", "given"])


class Bin:
    __slots__ = ("number", "residual", "sources", "clusters", "bitmap", "count")

    def __init__(self, number: int, capacity: int):
        self.number, self.residual, self.sources, self.clusters, self.bitmap, self.count = number, capacity, 0, set(), 0, 0

    def takes(self, source: int, cluster: int, bit: int, most: int) -> bool:
        # the bitmap lets most bins pass at once; the set decides where bits collide
        if self.bitmap & bit and cluster in self.clusters:
            return False
        return bool(self.sources & source) or self.sources.bit_count() < most

    def put(self, n: int, source: int, cluster: int, bit: int) -> int:
        self.residual -= n
        self.sources |= source
        self.clusters.add(cluster)
        self.bitmap |= bit
        self.count += 1
        return self.count - 1


def best_fit(sizes: list[int], sources: list[str | None], clusters: list[int], capacity: int, most: int) -> tuple[list[int], list[int]]:
    """(bin, place in it) of each piece, in the given order: tightest compatible bin first, older bin among equals."""
    order: list[tuple[int, int]] = []  # (residual, number) of the bins
    bins: list[Bin] = []
    bits: dict[str | None, int] = {}  # a source's bit
    where, places = [], []
    for n, source, cluster in zip(sizes, sources, clusters, strict=True):
        own = bits.setdefault(source, 1 << len(bits))
        bit, chosen = 1 << (cluster % MAP_BITS), None
        for at in range(bisect_left(order, (n, -1)), len(order)):
            box = bins[order[at][1]]
            if box.takes(own, cluster, bit, most):
                chosen = box
                order.pop(at)
                break
        if chosen is None:
            chosen = Bin(len(bins), capacity)
            bins.append(chosen)
        places.append(chosen.put(n, own, cluster, bit))
        where.append(chosen.number)
        if chosen.residual > 0:  # nothing but a piece of no words would fit into a full bin
            insort(order, (chosen.residual, chosen.number))
    return where, places


PACKED = "bin string, place int, doc_id long, piece int, first_word long, n_words long, source string, cluster long"


def pack_group(capacity: int, most: int):
    def run(key, rows):
        columns = rows.select(["doc_id", "piece", "first_word", "n", "source", "cluster"]).to_pydict()
        order = sorted(range(rows.num_rows), key=lambda i: (-columns["n"][i], columns["doc_id"][i] is None, columns["doc_id"][i] or 0, columns["piece"][i], columns["cluster"][i], columns["source"][i] or ""))
        pick = lambda c: [columns[c][i] for i in order]
        where, places = best_fit(pick("n"), pick("source"), pick("cluster"), capacity, most)
        group = key[0].as_py()
        return pa.table([
            pa.array([f"{group}-{w}" for w in where], pa.string()), pa.array(places, pa.int32()), pa.array(pick("doc_id"), pa.int64()), pa.array(pick("piece"), pa.int32()),
            pa.array(pick("first_word"), pa.int64()), pa.array(pick("n"), pa.int64()), pa.array(pick("source"), pa.string()), pa.array(pick("cluster"), pa.int64()),
        ], names=["bin", "place", "doc_id", "piece", "first_word", "n_words", "source", "cluster"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, most_sources: int = MOST_SOURCES, cluster_col: str | None = None) -> DataFrame:
    """bin, place, doc_id, piece, first_word, n_words, source, cluster of each piece."""
    given = F.lit(None) if cluster_col is None else F.col(cluster_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), given.cast("string").alias("given"))
    rows = rows.mapInArrow(measure, MEASURED).withColumn("row", F.monotonically_increasing_id())
    if cluster_col is not None:  # a null cluster is the row's own
        rows = rows.withColumn("cluster", F.coalesce(F.xxhash64(F.when(F.col("given").isNotNull(), F.col("given")), F.lit(1)) + F.when(F.col("given").isNull(), F.col("row")).otherwise(0)))
    rows = stash(rows.drop("given"))
    last = F.greatest(F.ceil(F.col("n_words") / capacity).cast("long"), F.lit(1).cast("long")) - 1
    total = rows.agg(F.sum(last + 1)).first()[0] or 0
    groups = max(1, -(-total // GROUP_ROWS))
    # ids and texts with more rows than a group takes: total / GROUP_ROWS of them at most
    heavy = rows.groupBy("doc_id", "cluster").count().where(F.col("count") > GROUP_ROWS).select(F.col("doc_id").alias("__d"), F.col("cluster").alias("__c"), F.lit(True).alias("heavy"))
    rows = rows.join(small(stash(heavy)), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("cluster") == F.col("__c")), "left")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", F.col("piece").cast("int"), (F.col("piece") * capacity).alias("first_word"), F.least(F.col("n_words") - F.col("piece") * capacity, F.lit(capacity)).alias("n"), "source", "cluster", F.when(F.col("heavy"), F.col("row")).alias("own")
    )
    group = F.pmod(F.xxhash64("doc_id", "piece", "cluster", "own"), F.lit(groups)).cast("int")
    pieces = pieces.withColumn("grp", group).drop("own").repartition(parts_for(docs.sparkSession, groups, 1), "grp")
    return pieces.groupBy("grp").applyInArrow(pack_group(capacity, most_sources), PACKED)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
