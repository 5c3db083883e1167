"""Quality rules as a bitmask ledger (operator 10).

``ledger`` evaluates every rule once on every whole text, in one pass without a shuffle, and keeps the
measurements and one failure bit per rule. Policies are versioned sets of rules: ``apply_policy`` and
``ablation`` only look at bits, so a new policy never reads texts again.

Defined results: a null text has no words (so it fails FEW_WORDS), as has a text of separators only; a null id is
carried through; repeated rows are each judged; a very long text is measured as a whole; there are no ties; an empty table
gives no rows, and an ablation of zeros; further columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.kernel import BLOCK_BYTES, U64, Words, blocks, cover, lean, mix, text_arrays, whole
from voxtable.llm.shared import free, short_batches, table

REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule name -> whether it fails, over the measurements; a rule's bit is its place here. Rules are only ever added.
RULES = {
    "few_words": lambda m: m["n_words"] < 10,
    "repetitive": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: (10 * m["n_dup_lines"] > 3 * m["n_lines"]) & (m["n_dup_lines"] >= 3),
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 25 * m["n_words"],
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = ("few_words", "repetitive")
POLICIES = {"base-1": BASE, "web-1": (*BASE, "symbols", "repeated_lines"), "web-2": tuple(RULES)}
CURRENT = "web-2"

IS_SYMBOL = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SYMBOLS, np.uint8))


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between each two bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key occurs twice or more, an equal key stands before) for each key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order], later[order] = same[:-1] | same[1:], same[:-1]
    return many, later


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of the texts in one byte array."""
    words = Words(data, offsets)
    texts, hashes = words.texts(), words.hashes()
    edges = np.zeros(len(data) + 1, np.int32)
    edges[words.starts] += 1
    edges[words.ends] -= 1
    inside = np.cumsum(edges[:-1]) > 0
    first, windows = whole(words, hashes, REPEAT_WINDOW)
    # a text's number goes into the key: windows of different texts never meet
    many, _ = repeats(windows ^ mix(texts[first].astype(U64) + U64(1)))
    covered = cover(first[many], REPEAT_WINDOW, len(words))

    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])[order]
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.empty_like(starts)
    ends[:-1] = np.where(owner[1:] == owner[:-1], starts[1:] - 1, offsets[owner[:-1] + 1])
    if len(ends):
        ends[-1] = offsets[owner[-1] + 1]
    wordy = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, owner = starts[wordy], ends[wordy], owner[wordy]
    _, later = repeats(words.hashes(starts=starts, ends=ends) ^ mix(owner.astype(U64) + U64(1)))
    n = len(offsets) - 1
    return {
        "n_words": words.counts,
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(IS_SYMBOL[data], offsets),
        "n_lines": np.bincount(owner, minlength=n)[:n],
        "n_dup_lines": np.bincount(owner[later], minlength=n)[:n],
        "n_repeat_words": per_text(covered, words.first),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the measurements and ``fail_bits`` (long) of each row; ``keep`` names further columns to carry along.

    Carried columns keep their names, with underscores at the end where the ledger's own columns have them.
    """
    own = (id_col, *MEASURES, "fail_bits")
    names = [free(c, own) for c in keep if c != id_col]
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *(F.col(c).alias(f"__k{k}") for k, c in enumerate(c for c in keep if c not in (id_col, text_col))))
    places = iter(range(2, len(picked.columns)))
    at = [1 if c == text_col else next(places) for c in keep if c != id_col]  # a carried text isn't sent twice
    types = [t for _, t in picked.dtypes]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column(1))
            parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets, BLOCK_BYTES)]
            found = {k: np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(np.int64) for k in MEASURES}
            bits = np.zeros(len(batch), np.int64)
            for name, fails in RULES.items():
                bits |= np.where(fails(found), BIT[name], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k]) for k in MEASURES), pa.array(bits), *(batch.column(k) for k in at)], names=[*own, *names])

    schema = [f"`{id_col}` {types[0]}", *(f"{k} long" for k in MEASURES), "fail_bits long", *(f"`{n}` {types[k]}" for n, k in zip(names, at, strict=True))]
    return picked.mapInArrow(run, ", ".join(schema))


def passing(docs: DataFrame, text_col: str = "text", policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, that the policy keeps by their ledger bits. One pass, no shuffle."""
    short_batches(docs.sparkSession)
    numbered = [f"__c{k}" for k in range(len(docs.columns))]
    text = numbered[docs.columns.index(text_col)]
    rows = ledger(docs.toDF(*numbered).withColumn("__none", F.lit(None).cast("long")), "__none", text, tuple(numbered))
    return apply_policy(rows, policy).where("kept").select(*(F.col(c).alias(n) for c, n in zip(numbered, docs.columns, strict=True)))


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(BIT[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def fails(policy: str | tuple[str, ...], bits: Column | None = None) -> Column:
    return ((F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy)).cast("long"))) != 0


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """Adds ``policy`` (its version, or its rules) and ``kept``."""
    return rows.withColumns({"policy": F.lit(policy if isinstance(policy, str) else "+".join(policy)), "kept": ~fails(policy)})


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: rows it fails, rows that only it fails, rows kept without it. One aggregation."""
    every, names = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")), POLICIES[policy]
    count = lambda test: F.count(F.when(test, 1))
    sums = rows.agg(
        F.count("*").alias("n"),
        F.bit_or(every).alias("any_bits"),
        count(every == 0).alias("kept"),
        *(count(every.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias(f"f_{r}") for r in names),
        *(count(every == BIT[r]).alias(f"o_{r}") for r in names),
    )
    line = lambda r: F.struct(
        F.lit(policy).alias("policy"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"), F.col(f"f_{r}").alias("n_failed"),
        F.col(f"o_{r}").alias("n_only"), (F.col("kept") + F.col(f"o_{r}")).alias("n_kept_without"), F.col("n").alias("n_rows"),
    )
    return sums.select(F.explode(F.array(*map(line, names))).alias("x")).select("x.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_policy(ledger(docs)).select("doc_id", *MEASURES, "fail_bits", fails(BASE).alias("base_failed"), "policy", "kept")


def ablation_query(spark, sf_dir: str) -> DataFrame:
    return ablation(ledger(table(spark, sf_dir, "documents")))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w),
p AS (SELECT rid, k, lead(k, 4) OVER o AS last, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS five
      FROM u WINDOW o AS (PARTITION BY rid ORDER BY k)),
g AS (SELECT rid, k, count(*) OVER (PARTITION BY rid, five) AS n FROM p WHERE last IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i) AS n_repeat_words FROM (SELECT rid, unnest(range(k, k + 5)) AS i FROM g WHERE n > 1) GROUP BY rid),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3 THEN 8 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, 'web-2' AS policy, fail_bits = 0 AS kept FROM f
"""

#: Over the rows of ``SQL``: bit by bit.
ABLATION_SQL = f"""
WITH l AS ({SQL}), r AS (SELECT * FROM (VALUES {", ".join(f"('{name}', {bit})" for name, bit in BIT.items())}) t(rule, bit))
SELECT 'web-2' AS policy, rule, bit::BIGINT AS bit, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only,
       count(*) FILTER (fail_bits & ~bit = 0) AS n_kept_without, count(*) AS n_rows FROM l, r GROUP BY ALL
"""
