"""The corpus pipeline: five operators of ``voxtable.llm`` one after another over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame, which is
written as Parquet to the shared folder and read again. All but the last return the columns of ``documents``.

1. quality rules: documents that the current policy rejects go;
2. n-gram Jaccard join (five words, 0.8): of each group of near copies the document with the smallest id stays;
3. substring dedup: words of 13-word passages that start in a document with a smaller id are cut out of the text;
4. decontamination: documents that share a template window with a benchmark item go;
5. best-fit packing: a row for each piece, with its bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import decontamination, ngram_join, packing, quality_rules, substring_dedup
from voxtable.llm.shared import small, stash, table

NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the rows whose ledger bits the current policy doesn't reject. A null, empty or short text fails
    ``few_words`` and goes; a very long one is measured as a whole; a null id or source doesn't matter; repeated rows are
    each judged alike, there are no ties; an empty table gives no rows; further columns come along, whatever their names."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a null id stay, as do all rows with the smallest id of their group, and rows without words. Ties in
    similarity don't matter; an empty table gives no rows; further columns come along."""
    rows = ngram_join.link_components(docs, shingle=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN)
    gone = stash(rows.where("component_id < doc_id").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts and n_chars change; rows don't go, even where no word stays. A null text stays null, a row with a null id
    keeps its text, and rows with one id are one document; an empty table gives no rows; further columns come along."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substring_dedup.deduplicate(docs, keep_text=True, carry=rest).withColumn("text", F.col("kept").cast("string"))
    kinds = dict(docs.dtypes)
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text"), **{c: F.col(f"carry{k}") for k, c in enumerate(rest)}}
    return cut.select(*(new[c].cast(kinds[c]).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with a null id go where one of them is contaminated; a null text is not; repeated rows go or stay together;
    an empty table gives no rows; further columns come along."""
    found = stash(decontamination.contaminated_ids(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__bad")))
    return docs.join(small(found), docs["doc_id"].eqNullSafe(found["__bad"]), "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row: a null or empty text is one piece without words, a very long one many; null
    sources are one source, a null id is packed like another, repeated rows are each packed; ties go by id, piece, cluster
    and source; an empty table gives no rows; columns other than id, text and source are left out."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
