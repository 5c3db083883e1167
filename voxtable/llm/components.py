"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.shared import drop_tables, stash

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b); a component is named by its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): a step keeps the number of links and
    needs one aggregation with partial sums and one join; each round is written to the shared folder.
    """
    spark, written = links.sparkSession, []
    e = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), written)
    state = None
    for _ in range(MOST_ROUNDS):
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = stash(small.select("x.*").where("a <> b").distinct(), written)
        drop_tables(spark, written[:-1])
        del written[:-1]
    else:
        raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
