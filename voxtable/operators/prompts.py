"""Instructions and prompts from relations of lines (S7, S8, SK1, SK2)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.text import chat_prompt, fill


def instructions(df: DataFrame, template: str, slots: Mapping[str, Column], answer: str) -> DataFrame:
    """(idx, conversations): a human turn made from the template and the answer."""
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.cast("string").alias("value"))
    return df.select("idx", F.array(turn("human", fill(template, slots)), turn("gpt", F.col(answer))).alias("conversations"))


def prompts(df: DataFrame, template: str, slots: Mapping[str, Column], chat: bool = False) -> DataFrame:
    """(idx, instruction): the filled template, or that as the user's message of a chat prompt."""
    text = fill(template, slots)
    message = F.array(F.struct(F.lit("user").alias("role"), text.alias("text")))
    return df.select("idx", (chat_prompt(message) if chat else text).alias("instruction"))


def chats(df: DataFrame, key: str, order: str, role: str = "role", text: str = "text", generate: bool = True) -> DataFrame:
    """(key, prompt) from rows of turns."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return df.groupBy(key).agg(turns.alias("__turns")).select(key, chat_prompt("__turns", generate).alias("prompt"))
