"""Benchmark decontamination by template windows (operator 7).

Every text becomes a sequence of tokens: words without the punctuation around them, in lower case, where numbers, names
(capitalised words inside a sentence) and units after a number are typed placeholders. Windows of ``WINDOW`` tokens of
documents and benchmark items are hash-joined on the template; equal values of one type in the item's
slots must then have equal values in the document's, units in whichever form, so a question with other numbers or names is found, and a mere likeness of form is not. Windows
with names are also taken with the names spelt out, so that a copy in other capitals is found, and with the capitalised
words that start sentences as names, so that those may be renamed too. At least half of a window's tokens must be literal
or names with the item's values. Names are known by their capitals: a copy in lower case is not found where each window
holds a changed name.

Items of fewer than ``WINDOW`` tokens have one window of their whole length. Windows of fewer than ``LEAST`` tokens, and
those with fewer than half their tokens literal, have no placeholders: every window is also taken with all its tokens
spelt out, so a verbatim copy is found whatever it consists of. Punctuation is no token, so such a copy may differ in it,
and an item of one or two tokens is found wherever they stand. A bitmap of fixed size made from the benchmark's
windows is broadcast and drops nearly all of the documents' windows on the spot, before the join compares whole
templates. The join itself has no side whose size is taken on trust: Spark chooses by the written sizes, and splits the
partition of a template that very many documents have.

Defined results: a null text or item has no tokens; a very long text is read whole, in windows; ties don't matter, as all
shared windows count; a null document id is an id of its own; rows with the same id are
judged together; repeated items count once each; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.kernel import PLAIN, U64, Words, grams, lean, mix, rows_of
from voxtable.llm.shared import stash, table

WINDOW, LEAST = 13, 5
BITS = 24
#: Text that is worked on at once: its tokens have four forms.
FORM_BYTES = 1 << 19
#: Units of measure that become placeholders after a number.
UNIT_FORMS = "mm,cm,m metre metres meter meters,km kilometre kilometres kilometer kilometers,mg,g gram grams,kg kilogram kilograms,t,ml,l litre litres liter liters,s sec second seconds,min minute minutes,h hour hours,day days,week weeks,month months,year years,inch inches,foot feet,yard yards,mile miles,ounce ounces,pound pounds,gallon gallons,dollar dollars,euro euros,cent cents,percent,degree degrees"
#: The first form of each unit, by form.
UNITS = {form: group.split()[0] for group in UNIT_FORMS.split(",") for form in group.split()}

CORE = np.zeros(256, bool)
CORE[48:58] = CORE[65:91] = CORE[97:123] = CORE[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(b".!?:", np.uint8))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

WORD, NUMBER, NAME, UNIT = range(4)
#: The forms that spell all tokens, and that has all capitalised words as names.
SPELT, CAPITALS = 2, 3
HOLDERS = ("", "<number>", "<name>", "<unit>")
HOLDER_HASH = mix(np.arange(4, dtype=U64) + U64(0x5A17))


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in lower case, whether an upper-case letter starts): ASCII and the letters of U+00C0 to U+00DE."""
    out = FOLD[data]
    upper = out != data
    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    latin = lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[latin] += 0x20
    upper[:-1] |= latin[1:]
    return out, upper


def unit_hashes() -> np.ndarray:
    raw = " ".join(UNITS).encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return np.unique(words.hashes())


class Tokens:
    """Tokens of some texts: spans, kinds and hashes; ``counts`` of each text."""

    def __init__(self, words: Words):
        data, n = words.data, len(words.data)
        self.lower, upper = folded(data)
        at = np.flatnonzero(CORE[data])
        first, last = np.searchsorted(at, words.starts), np.searchsorted(at, words.ends)
        have = np.flatnonzero(last > first)
        self.starts, self.ends = at[first[have]], at[last[have] - 1] + 1
        self.text = words.texts()[have]
        self.word = have - words.first[self.text]
        self.counts = np.bincount(self.text, minlength=len(words.counts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        digits, letters = sums(DIGIT[data]), sums(CORE[data] & ~DIGIT[data])
        number = (digits[self.ends] > digits[self.starts]) & ((letters[self.ends] == letters[self.starts]) | DIGIT[data[self.starts]] & (letters[self.ends] - letters[self.starts] <= 4))
        # a sentence starts a text or a line, or follows one of .!?:
        stops, breaks = np.zeros(len(words), bool), sums(data == 10)
        if len(words):
            stops[1:] = (STOP[data[words.ends[:-1] - 1]]) | (breaks[words.starts[1:]] > breaks[words.ends[:-1]])
            stops[words.first[:-1][words.counts > 0]] = True
        name = upper[self.starts] & ~stops[have] if n else np.zeros(0, bool)
        plain = words.hashes(PLAIN, self.starts, self.ends, self.lower)
        unit = np.zeros(len(have), bool)
        unit[1:] = number[:-1] & (self.text[1:] == self.text[:-1])
        unit &= np.isin(plain, unit_hashes())
        self.kind = np.select([number, unit, name], [NUMBER, UNIT, NAME], WORD)
        spelt = np.where(self.kind == NAME, WORD, self.kind)
        self.forms = [(kind, np.where(kind == WORD, plain, HOLDER_HASH[kind]), sums(kind == WORD)) for kind in (self.kind, spelt, np.full_like(spelt, WORD), np.where((spelt == WORD) & upper[self.starts], NAME, spelt) if n else spelt)]
        self.names, self.values, self.initials = sums(self.kind == NAME), sums(spelt != WORD), sums(self.forms[CAPITALS][0] != self.kind)

    def windows(self, k: int, form: int) -> tuple[np.ndarray, np.ndarray]:
        """(first tokens, hashes) of the windows of k tokens that have the form.

        Form 0 has names as placeholders; form 1 spells them, for windows that have some: so a copy in other capitals
        is found too. Both need enough literal tokens. Form 2 spells everything, for windows that have numbers or units
        (the others are spelt out already) and for short ones. Form 3 has all capitalised words as names, for windows in
        which some start sentences, or that have too many names for form 0: a quarter literal, and half literal or names,
        as only the join can tell whether names are equal.
        """
        _, hashes, literal = self.forms[form]
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(self.text))
        at = np.flatnonzero(room >= k)
        if form == CAPITALS:
            n, plain = literal[at + k] - literal[at], self.forms[0][2]
            keep = (4 * n >= k) & (2 * (k - self.values[at + k] + self.values[at]) >= k)
            at = at[keep & ((self.initials[at + k] > self.initials[at]) | (2 * (plain[at + k] - plain[at]) < k))] if k >= LEAST else at[:0]
        elif form < SPELT:
            at = at[2 * (literal[at + k] - literal[at]) >= k] if k >= LEAST else at[:0]
        elif k >= LEAST:
            at = at[self.values[at + k] > self.values[at]]
        if form == 1:
            at = at[self.names[at + k] > self.names[at]]
        return at, grams(hashes, k)[at]

    def window(self, at: int, k: int, form: int) -> tuple[str, list[str], list[str]]:
        """(template, values of its slots, the same with their types and units in one form)."""
        span, kind = range(at, at + k), self.forms[form][0]
        value = [self.lower[self.starts[i] : self.ends[i]].tobytes().decode(errors="replace") for i in span]
        slots = [(HOLDERS[kind[i]], v) for i, v in zip(span, value, strict=True) if kind[i] != WORD]
        return " ".join(HOLDERS[kind[i]] or v for i, v in zip(span, value, strict=True)), [v for _, v in slots], [t + (UNITS[v] if t == HOLDERS[UNIT] else v) for t, v in slots]


FOUND = "h long, id long, row long, at int, k int, template string, slots array<string>, keys array<string>"
FOUND_ARROW = [("h", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("k", pa.int32()), ("template", pa.string()), ("slots", pa.list_(pa.string())), ("keys", pa.list_(pa.string()))]


def spots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bitmap for each hash."""
    return (hashes >> U64(64 - BITS)).astype(np.int64), (mix(hashes) >> U64(64 - BITS)).astype(np.int64)


def find(lengths: tuple[int, ...], bitmap=None, whole_only: bool = False):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for start, words in rows_of(batch.column(2), FORM_BYTES):
                tokens, out = Tokens(words), []
                for k, form in itertools.product(lengths, range(len(tokens.forms))):
                    at, hashes = tokens.windows(k, form)
                    if whole_only and k < WINDOW:  # an item's window is the whole item
                        keep = tokens.counts[tokens.text[at]] == k
                        at, hashes = at[keep], hashes[keep]
                    if bitmap is not None:
                        a, b = spots(hashes)
                        keep = bitmap.value[a] & bitmap.value[b]
                        at, hashes = at[keep], hashes[keep]
                    for i, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        text = int(tokens.text[i])
                        out.append((h, ids[start + text].as_py(), rows[start + text].as_py(), int(tokens.word[i]), k, *tokens.window(i, k, form)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), FOUND_ARROW, strict=True)], names=[n for n, _ in FOUND_ARROW])

    return run


def bitmap_of(windows: DataFrame):
    """The bitmap, broadcast: 2**BITS places however large the benchmark is; only its words that aren't 0 are collected."""
    bits = windows.select("h").distinct().mapInArrow(_places, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    flags = np.zeros(1 << BITS, bool)
    for word, value in bits.collect():
        flags[word * 32 : word * 32 + 32] = (value >> np.arange(32)) & 1
    return windows.sparkSession.sparkContext.broadcast(flags)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate(spots(np.asarray(batch.column(0)).view(U64)))
        yield pa.RecordBatch.from_arrays([pa.array((at >> 5).astype(np.int32)), pa.array(np.int64(1) << (at & 31))], names=["word", "bits"])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, how: str) -> DataFrame:
    """Windows of documents (d) joined with items' (i) that have their template and consistent slots."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(item_text_col).alias("text"))
    lengths = tuple(range(1, WINDOW + 1))
    items = stash(items.mapInArrow(find(lengths, whole_only=True), FOUND))
    # the lengths that occur, WINDOW at most
    used = tuple(sorted(r[0] for r in items.select("k").distinct().collect()))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("row"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(find(used, bitmap_of(items)), FOUND).alias("d")
    # an item whose windows stand in it, or in other items, several times: each template and its slots once an item
    items = items.dropDuplicates(["h", "id", "k", "template", "slots"]).alias("i")
    n = lambda c: F.size(F.array_distinct(c))
    pairs = F.arrays_zip(F.col("d.keys").alias("a"), F.col("i.keys").alias("b"))
    consistent = n(pairs) == n(F.col("i.keys"))
    equal = F.size(F.filter(pairs, lambda x: (x["a"] == x["b"]) & x["a"].startswith(HOLDERS[NAME])))
    enough = 2 * (F.col("i.k") - F.size("i.slots") + equal) >= F.col("i.k")
    return found.join(items, (F.col("d.h") == F.col("i.h")) & (F.col("d.k") == F.col("i.k")) & (F.col("d.template") == F.col("i.template")) & consistent & enough, how)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, n_exact (same values in all slots), first_word of each pair that shares a window.

    The result has a row for each such pair, so a template that many items share gives as many rows as it has items for
    each document; see ``contaminated_ids`` for the documents alone.
    """
    same = matches(docs, benchmark, id_col, text_col, item_col, item_text_col, "inner")
    return same.groupBy(F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id")).agg(
        F.count_distinct("d.at").alias("n_windows"), F.count_distinct(F.when(F.col("d.slots") == F.col("i.slots"), F.col("d.at"))).alias("n_exact"), F.min("d.at").cast("long").alias("first_word")
    )


def contaminated_ids(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id of the documents that share a window with any item: a window stops at its first item, so the work and the
    rows follow the windows found and not their pairs."""
    return matches(docs, benchmark, id_col, text_col, item_col, item_text_col, "left_semi").select(F.col("d.id").alias("doc_id")).distinct()


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
