"""Corpus scores: word error rate, BLEU and chrF. Definitions are the public ones; tokenisers are by white space or character."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from voxtable.functions.bind import bind
from voxtable.functions.text import strip


def words_of(x: Column | str) -> Column:
    """Words between white space; an empty text has none."""
    x = F.regexp_replace(strip(x), r"(?U)\s+", " ")
    return F.filter(F.split(x, " "), lambda w: w != "")


def word_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Edit distance of two lists of words of any number, a column of the matrix at once in the bits of two integers
    (Myers 1999, as Hyyrö 2003 states it)."""
    a, b = sorted((a, b), key=len)
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), len(a))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    whole, last, distance = (1 << len(a)) - 1, len(a) - 1, len(a)
    plus, minus = whole, 0
    for word in b:
        equal = where.get(word, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = minus | ~(diagonal | plus) & whole, plus & diagonal
        distance += (up >> last & 1) - (down >> last & 1)
        up, down = up << 1 & whole | 1, down << 1 & whole
        plus, minus = down | ~(diagonal | up) & whole, up & diagonal
    return distance


@F.pandas_udf(IntegerType())
def edits_of_words(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else word_distance(list(a), list(b)) for a, b in zip(reference, hypothesis, strict=True)], dtype="Int32")


def edits(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word edit distance. Spark's ``levenshtein`` compares characters and has a matrix of them, so this is an Arrow-batched
    function whose steps are machine words of the matrix's column."""
    return edits_of_words(words_of(reference), words_of(hypothesis))


def word_errors(df: DataFrame, reference: str, hypothesis: str, keys: Sequence[str] = ()) -> DataFrame:
    """edits, ref_words and their ratio ``wer`` over all rows of a key; null without reference words."""
    counted = df.select(*keys, edits(reference, hypothesis).cast("long").alias("e"), F.size(words_of(reference)).cast("long").alias("n"))
    sums = counted.groupBy(*keys).agg(F.sum("e").alias("edits"), F.sum("n").alias("ref_words"))
    return sums.withColumn("wer", F.try_divide(F.col("edits").cast("double"), F.col("ref_words").cast("double")))


#: "white", "char", or a function from a text column to array<string>, as ``sentence_pieces`` makes one.
Tokenizer = str | Callable[[Column], Column]


def sentence_pieces(model: bytes) -> Callable[[Column], Column]:
    """The pieces of a SentencePiece model, given as its file's bytes: a model of the FLORES benchmark makes BLEU that of
    its tokenisation. Arrow-batched; a worker loads the model once a task."""

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for texts in batches:
            yield texts.map(lambda t: processor.encode(t, out_type=str), na_action="ignore")

    return pieces


def tokens(x: Column | str, tokenizer: Tokenizer) -> Column:
    if not isinstance(tokenizer, str):
        return tokenizer(F.col(x) if isinstance(x, str) else x)
    if tokenizer == "char":
        return F.filter(F.split(F.regexp_replace(x, r"(?U)\s+", ""), ""), lambda c: c != "")
    return words_of(x)


def ngrams(x: Column, n: int) -> Column:
    """n-grams of an array as arrays."""
    count = lambda t: F.greatest(F.size(t) - n + 1, F.lit(0))
    slices = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(count(t), F.lit(1))), lambda i: F.slice(t, i, n))
    return bind(x, lambda t: F.slice(slices(t), F.lit(1), count(t)))


def ngram_matches(df: DataFrame, reference: str, hypothesis: str, orders: int, tokenizer: Tokenizer, key: str = "idx") -> DataFrame:
    """(n, matches, hyp_total, ref_total) for n-grams of each order: counts are clipped within a row, then summed."""

    def counted(column: str, name: str) -> DataFrame:
        t = F.col("__t")
        marked = lambda n: F.transform(ngrams(t, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
        grams = F.concat(*map(marked, range(1, orders + 1)))
        return df.select(key, tokens(column, tokenizer).alias("__t")).select(key, F.explode(grams).alias("x")).groupBy(key, "x").agg(F.count("*").alias(name))

    both = counted(reference, "r").join(counted(hypothesis, "h"), [key, "x"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = both.groupBy(F.col("x.n").alias("n")).agg(F.sum(zero(F.least("r", "h")) * zero(F.when(F.col("r").isNotNull() & F.col("h").isNotNull(), 1))).alias("matches"), F.sum(zero("h")).alias("hyp_total"), F.sum(zero("r")).alias("ref_total"))
    return sums


def bleu(df: DataFrame, reference: str, hypothesis: str, orders: int = 4, tokenizer: Tokenizer = "white", key: str = "idx") -> DataFrame:
    """One row ``bleu`` (0 to 100): brevity penalty times the geometric mean of the clipped precisions; 0 where one is 0."""
    sums = ngram_matches(df, reference, hypothesis, orders, tokenizer, key)
    precision = F.try_divide(F.col("matches").cast("double"), F.col("hyp_total").cast("double"))
    logs = sums.agg(
        F.sum(F.when(F.col("matches") > 0, F.log(precision))).alias("s"), F.count(F.when(F.col("matches") > 0, 1)).alias("c"),
        F.max(F.when(F.col("n") == 1, F.col("hyp_total"))).alias("h"), F.max(F.when(F.col("n") == 1, F.col("ref_total"))).alias("r"),
    )
    brevity = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return logs.select(F.when(F.col("c") == orders, 100 * brevity * F.exp(F.col("s") / orders)).otherwise(0.0).alias("bleu"))


def chrf(df: DataFrame, reference: str, hypothesis: str, orders: int = 6, beta: float = 2.0, key: str = "idx") -> DataFrame:
    """One row ``chrf`` (0 to 100): F-score of the mean precision and recall of character n-grams."""
    sums = ngram_matches(df, reference, hypothesis, orders, "char", key)
    part = lambda total: F.avg(F.when(F.col(total) > 0, F.col("matches") / F.col(total)))
    means = sums.agg(part("hyp_total").alias("p"), part("ref_total").alias("r"))
    square = math.pow(beta, 2)
    return means.select(F.coalesce(F.try_divide(100 * (1 + square) * F.col("p") * F.col("r"), square * F.col("p") + F.col("r")), F.lit(0.0)).alias("chrf"))
