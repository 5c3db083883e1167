"""Relational chat formatting (operator 2), with DataFrame functions only.

A conversation's turns are collected as structs and sorted; an aggregation over the array merges adjacent turns of one
role into one block; texts and markers are concatenated. Merging is associative, so it runs over chunks of ``CHUNK``
turns and then over the chunks: a long conversation isn't copied once for each of its turns.

    <|turn|>role<|text|>first text<|more|>second text of the same role<|end|>

Markers begin with ``<``; inside roles and texts ``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;`` and ``&#91;``, so
no text can hold a marker or another template's control string, and reading back gives exactly the turns. The loss mask
goes with the string as runs of characters; what is learnt is cut from the string by that mask alone.

Defined results: turns are ordered by (turn, role, text), nulls first; null roles and texts are empty; rows with the
same turn number are all kept; conversations with a null id are one; an empty table gives no rows; further columns
don't matter. One conversation is one row of the output, so a task holds the longest conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.bind import bind
from voxtable.llm.shared import table

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LEARNED_ROLE = "assistant"
#: Turns, or runs of the mask, that are worked on at once.
CHUNK = 128
PROBE = "</s>[INST] ok [/INST]"


def escape(x: Column) -> Column:
    for plain, safe in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return x


def unescape(x: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        x = F.replace(x, F.lit(safe), F.lit(plain))
    return x


def pattern(marker: str) -> str:
    return marker.replace("|", r"\|")


def chunks(items: Column) -> Column:
    """The array in slices of ``CHUNK``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def merge(done: Column, more: Column) -> Column:
    """Two lists of blocks as one: a block goes into the one before it if they have the same role."""
    last, first = F.try_element_at(done, F.lit(-1)), F.try_element_at(more, F.lit(1))
    both = F.struct(last["role"].alias("role"), F.concat(last["texts"], first["texts"]).alias("texts"))
    joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both), F.slice(more, 2, F.size(more)))
    return F.when(last["role"] == first["role"], joined).otherwise(F.concat(done, more))


def blocks(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role merged."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")
    one = lambda t: F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    parts = F.transform(chunks(turns), lambda c: F.aggregate(c, none, lambda done, t: merge(done, one(t))))
    return F.aggregate(parts, none, merge)


def pieces(text: Column, runs: Column, keep: Callable[[Column], Column] = lambda run: F.lit(True)) -> Column:
    """The stretches of ``text`` of the runs that are kept; a run has ``chars`` characters, and they follow one another."""
    start = F.struct(F.lit(1).cast("int").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, run: Column) -> Column:
        piece = F.array(F.substring(text, done["at"], run["chars"].cast("int")))
        return F.struct((done["at"] + run["chars"].cast("int")).alias("at"), F.when(keep(run), F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"))

    return F.aggregate(runs, start, step)["out"]


def under_mask(text: Column, runs: Column) -> Column:
    """array<string>: the stretches of ``text`` under the loss mask, cut in two steps: by chunks of runs, then by runs."""
    parts = F.transform(chunks(runs), lambda c: F.struct(c.alias("runs"), F.aggregate(c, F.lit(0).cast("long"), lambda n, run: n + run["chars"]).alias("chars")))
    return bind(parts, lambda p: F.flatten(F.transform(F.arrays_zip(p.alias("part"), pieces(text, p).alias("text")), lambda x: pieces(x["text"], x["part"]["runs"], lambda run: run["loss"]))))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, ``formatted`` and ``loss_runs``: the mask over ``formatted`` as runs of (loss, chars) in order."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    gathered = rows.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
    merged = gathered.select(id_col, F.transform(blocks(F.col("__turns")), lambda b: F.struct(escape(b["role"]).alias("role"), F.transform(b["texts"], escape).alias("texts"))).alias("__blocks"))
    pieces = F.transform("__blocks", lambda b: F.concat(F.lit(TURN), b["role"], F.lit(TEXT), F.array_join(b["texts"], MORE), F.lit(END)))
    run = lambda loss, chars: F.struct(loss.alias("loss"), chars.cast("long").alias("chars"))
    text_runs = lambda b: F.flatten(F.transform(b["texts"], lambda t, i: F.array(run(F.lit(False), F.when(i == 0, F.length(b["role"]) + len(TURN + TEXT)).otherwise(len(MORE))), run(b["role"] == LEARNED_ROLE, F.length(t)))))
    runs = F.flatten(F.transform("__blocks", lambda b: F.concat(text_runs(b), F.array(run(F.lit(False), F.lit(len(END)))))))
    return merged.select(id_col, F.array_join(pieces, "").alias("formatted"), runs.alias("loss_runs"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns in ``formatted``."""
    parts = F.split(formatted, pattern(END), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turns(part: Column) -> Column:
        halves = F.split(F.substring(part, len(TURN) + 1, 2**31 - 1), pattern(TEXT), 2)
        role = unescape(F.element_at(halves, 1))
        return F.transform(F.split(F.element_at(halves, 2), pattern(MORE), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(parts, turns))


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The counts and digests of conversations, from what was formatted and its loss mask."""
    read = formatted.withColumn("__back", read_back(F.col("formatted")))
    lines = F.array_join(F.transform("__back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.withColumn("__loss", F.array_join(F.transform(under_mask(F.col("formatted"), F.col("loss_runs")), unescape), ""))
    loss = F.col("__loss")
    return read.select(
        id_col,
        F.size("__back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED_ROLE).alias("role"), F.lit(PROBE).alias("text"),
    )
    return digest(format_conversations(rows.unionByName(extra)))


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, '{LEARNED_ROLE}', '{PROBE}')),
t AS (SELECT *, row_number() OVER o AS k, coalesce(lag(role) OVER o = role, false) AS merged,
             length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
               + 4 * (length(text) - length(replace(text, '[', ''))) AS text_chars,
             length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', '')))
               + 4 * (length(role) - length(replace(role, '[', ''))) AS role_chars
      FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       sum(CASE WHEN role = '{LEARNED_ROLE}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN merged THEN {len(MORE)} ELSE role_chars + {len(TURN + TEXT + END)} END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
