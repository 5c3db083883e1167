"""Jaccard self-join on word n-grams with several global token orders (operator 6).

Two documents link when ``den`` * |intersection| >= ``num`` * |union| of their shingle sets. Of two such sets, the first
n - ceil(num/den * n) + 1 tokens of each (the prefix) share a token, whatever global order of the tokens is chosen. So
candidates must share prefix tokens under three orders: two that put rare tokens first and break ties differently, and
one by hash alone.

1. One pass counts all shingles in a sketch of fixed size (``COUNTERS``), added up in a tree; its logarithm, one byte a
   counter, is broadcast and gives the rare-first orders. Documents with equal sets form a class; only a class's smallest
   id goes on. The pass also keeps a histogram of each set by hash (``CELLS``).
2. One pass emits the prefix tokens under the first order, packed by hash bucket and distinct by class within a task;
   buckets return the tokens of two or more classes. The number of buckets follows the measured number of prefix tokens;
   beyond ``FAN`` buckets they are dealt out in two steps, so packets stay large. Tokens the sketch shows to be very
   frequent bypass this: they are spread over salted buckets, and meet in joins that Spark can split.
3. Links to one leader a token are verified first; after components of those, only pairs from different components that
   share a token and pass the size and position bounds are left, joined in blocks of sizes that can match. So a group of
   copies costs links in proportion to its size, and no pair that could connect two components is left out.
4. Of a pair's histograms the sum of the lesser counts bounds the intersection from above; a pair whose bound is too low
   goes. For the others the sets meet, and must share prefix tokens under the other orders too before they are
   intersected.

Tokens are 64-bit hashes of shingles, and verification is exact on these: two different shingles among the m of a pair of
documents are taken for one with a chance below m * m / 2**65, about 1e-11 for two documents of 10,000 words.

Defined results: a null text or one without words has an empty set and links with nothing; fewer words than ``shingle``
are one shingle; a very long text is one set; a row with a null id links with nothing and has no component; rows with the
same id are one document for components, whatever their texts; ties in the orders are broken by hash; an empty table gives
no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.components import components
from voxtable.llm.kernel import FOLDED, U64, Words, give_back, grams, lean, mix, rows_of, runs, whole
from voxtable.llm.shared import drop_tables, parts_for, small, stash, table

SHINGLE, NUM, DEN = 3, 90, 100
#: Size of the sketch: this many counters, by the upper bits of a token, sent in this many slices.
COUNTER_BITS, SLICES = 24, 64
COUNTERS = 1 << COUNTER_BITS
#: Sketches that one step of the tree adds up.
ADDED = 128
#: Cells of a set's histogram, by the lowest bits of a token.
CELLS = 64
#: Bytes of prefix entries that a bucket is meant for, and buckets that one task deals out at once.
BUCKET_BYTES, FAN = 16 << 20, 4096
#: A token that the sketch counts this often or more is dealt out by salt.
FREQUENT = 1 << 16
#: Prefix entries that a task gathers before it sends them.
SEND = 1_000_000
SEEDS = tuple(U64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash), distinct, ordered by text."""
    hashes = words.hashes(FOLDED)
    at, found = whole(words, hashes, k)
    texts = words.texts()
    owner, values = [texts[at]], [found]
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            owner.append(short)
            values.append(grams(hashes, n)[words.first[short]])
    owner, values = np.concatenate(owner), np.concatenate(values)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], values[new]


def signatures(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit sums over the set) of each text."""
    counts = np.bincount(owner, minlength=n)[:n]
    out, at = [], runs(owner)
    for seed in SEEDS[:2]:
        sums = np.zeros(n, U64)
        if len(at):
            sums[owner[at]] = np.add.reduceat(mix(values ^ seed), at)
        out.append(sums)
    return counts, *out


def blobs(batches: Iterator[pa.RecordBatch], k: int):
    """(ids, known, owner, values, number of texts) of blocks of texts."""
    for batch in batches:
        known = np.asarray(batch.column(0).is_valid())
        ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
        for start, words in rows_of(batch.column(1)):
            stop = start + len(words.counts)
            yield ids[start:stop], known[start:stop], *shingles(words, k), stop - start


def counter_of(values: np.ndarray) -> np.ndarray:
    return (values >> U64(64 - COUNTER_BITS)).astype(np.int64)


def histograms(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """How many tokens of each text fall in each cell: a byte each, or four for texts that need them."""
    cells = np.bincount(owner * CELLS + (values & U64(CELLS - 1)).astype(np.int64), minlength=n * CELLS)[: n * CELLS].reshape(n, CELLS)
    wide = cells.max(axis=1, initial=0) > 255
    return pa.array([x.astype("<u4").tobytes() if w else x.astype("u1").tobytes() for x, w in zip(cells, wide)], pa.binary())


def cells_of(column: pa.Array) -> np.ndarray:
    """The histograms as rows of a matrix."""
    rows = [x.as_buffer() for x in column]
    return np.stack([np.frombuffer(x, "u1" if len(x) == CELLS else "<u4").astype(np.int64) for x in rows]) if rows else np.zeros((0, CELLS), np.int64)


SCAN = "doc_id long, n long, s1 long, s2 long, cells binary, slice int, task int, blob binary"
SCAN_NAMES = ["doc_id", "n", "s1", "s2", "cells", "slice", "task", "blob"]


def scan(k: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counters, task = None, TaskContext.get().partitionId() if TaskContext.get() else 0
        for ids, known, owner, values, n in blobs(batches, k):
            counts, s1, s2 = signatures(owner, values, n)
            counters = np.zeros(COUNTERS, np.uint32) if counters is None else counters
            np.add.at(counters, counter_of(values), np.uint32(1))
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(counts.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), histograms(owner, values, n), *none], names=SCAN_NAMES)
        if counters is not None:
            parts, none = [squeeze(x) for x in np.split(counters, SLICES)], pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(SLICES, pa.binary()), pa.array(np.arange(SLICES), pa.int32()), pa.array(np.full(SLICES, task), pa.int32()), pa.array(parts, pa.binary())], names=SCAN_NAMES)

    return run


def squeeze(counters: np.ndarray) -> bytes:
    """The counters that aren't 0, with their distances, compressed."""
    at = np.flatnonzero(counters)
    return zstandard.ZstdCompressor(level=1).compress(np.diff(at, prepend=0).astype("<u4").tobytes() + counters[at].astype("<u8").tobytes())


def expand(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<u8", n, 4 * n)


SUMMED = "slice int, task int, blob binary"


def add_slices(last: bool):
    """Adds up one slice of some sketches, one after another; the last step gives levels instead of counts."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS // SLICES, np.uint64)
        for batch in batches:
            for blob in batch.column("blob"):
                at, counts = expand(blob.as_py())
                total[at] += counts
        out = np.minimum(255, np.round(8 * np.log2(1.0 + total))).astype(np.uint8).tobytes() if last else squeeze(total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0 if last else key[1].as_py()], pa.int32()), pa.array([out], pa.binary())], names=["slice", "task", "blob"])

    return run


def levels_of(scanned: DataFrame) -> np.ndarray:
    """The logarithm of the sketch: ``COUNTERS`` bytes. Sketches are added up by groups of ``ADDED``, and those again."""
    parts, paths = scanned.where("slice is not null").select("slice", "task", "blob"), []
    number = parts.where("slice = 0").count()
    while number > ADDED:
        number = -(-number // ADDED)
        parts = parts.withColumn("task", F.pmod("task", F.lit(number))).groupBy("slice", "task").applyInArrow(add_slices(False), SUMMED)
        parts = stash(parts, paths)
    found = {r[0]: np.frombuffer(bytes(r[1]), np.uint8) for r in parts.groupBy("slice").applyInArrow(add_slices(True), SUMMED).select("slice", "blob").collect()}
    drop_tables(scanned.sparkSession, paths)
    return np.concatenate([found[k] for k in sorted(found)] or [np.zeros(COUNTERS, np.uint8)])


def orders(values: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """The tokens' keys under each order: (rarity, hash), (rarity, another hash), hash."""
    rare = level[counter_of(values)].astype(U64) << U64(56)
    return [rare | (mix(values ^ SEEDS[0]) >> U64(8)), rare | (mix(values ^ SEEDS[1]) >> U64(8)), mix(values ^ SEEDS[2])]


def prefixes(owner: np.ndarray, keys: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries in their texts' prefixes, their places there): entries are ordered by (text, place)."""
    order = np.lexsort((keys, owner))
    place = np.arange(len(order)) - (np.cumsum(counts) - counts)[owner]
    inside = place < (counts - -(-num * counts // den) + 1)[owner]
    return order[inside], place[inside]


PACKET = "bucket int, blob binary"
ENTRY = np.dtype([("t", "<u8"), ("s1", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("pos", "<u4")])
SHARED = "t long, doc long, s1 long, n int, pos int, salted boolean"


class Sender:
    """Gathers prefix entries and packs them by bucket; of equal sets only the smallest id goes on."""

    def __init__(self, levels: np.ndarray, buckets: int, width: int):
        from pyspark import TaskContext

        self.frequent = int(round(8 * np.log2(1.0 + FREQUENT)))
        self.levels, self.buckets, self.width, self.held, self.size = levels, buckets, width, [], 0
        self.task = TaskContext.get().partitionId() if TaskContext.get() else 0

    def take(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        self.size += len(rows)
        if self.size > SEND:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        rows = np.concatenate(self.held)
        self.held, self.size = [], 0
        order = np.lexsort((rows["doc"], rows["s1"]))
        at = runs(rows["s1"][order])
        rows = rows[order]
        rows = rows[rows["doc"] == np.repeat(rows["doc"][at], np.diff([*at, len(rows)]))]
        where = (((mix(rows["t"]) >> U64(32)) * U64(self.buckets)) >> U64(32)).astype(np.int64)
        salted = self.levels[counter_of(rows["t"])] >= self.frequent
        where[salted] = self.buckets + (where[salted] + self.task) % self.buckets
        where //= self.width
        order = np.argsort(where, kind="stable")
        rows, where = rows[order], where[order]
        cut = [*runs(where), len(where)]
        packets = [(int(where[a]), rows[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packets], pa.int32()), pa.array([x for _, x in packets], pa.binary())], names=["bucket", "blob"])


def first_order(k: int, num: int, den: int, level, buckets: int, width: int):
    """Packets of prefix entries, each for ``width`` buckets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = level.value
        sender = Sender(levels, buckets, width)
        for ids, known, owner, values, n in blobs(batches, k):
            counts, s1, _ = signatures(owner, values, n)
            entry, place = prefixes(owner, orders(values, levels)[0], counts, num, den)
            text = owner[entry]
            rows = np.zeros(len(entry), ENTRY)
            rows["t"], rows["s1"], rows["doc"], rows["n"], rows["pos"] = values[entry], s1[text], ids[text], counts[text], place
            yield from sender.take(rows[known[text]])
        yield from sender.send()

    return run


def deal(level, buckets: int):
    """Packets for many buckets as packets for one each."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(level.value, buckets, 1)
        for batch in batches:
            for blob in batch.column("blob"):
                yield from sender.take(np.frombuffer(blob.as_buffer(), ENTRY))
        yield from sender.send()

    return run


def meet(buckets: int):
    def run(key, rows):
        give_back()
        found = np.concatenate([np.frombuffer(x, ENTRY) for x in rows.column("blob").to_pylist()])
        found = found[np.lexsort((found["doc"], found["s1"], found["t"]))]
        new = np.ones(len(found), bool)
        new[1:] = (found["t"][1:] != found["t"][:-1]) | (found["s1"][1:] != found["s1"][:-1])
        found = found[new]
        salted = key[0].as_py() >= buckets
        if not salted:
            at = runs(found["t"])
            times = np.diff([*at, len(found)])
            found = found[np.repeat(times, times) > 1]
        return pa.table([pa.array(np.ascontiguousarray(found["t"]).view(np.int64)), pa.array(np.ascontiguousarray(found["doc"])), pa.array(np.ascontiguousarray(found["s1"]).view(np.int64)), pa.array(found["n"].astype(np.int32)), pa.array(found["pos"].astype(np.int32)), pa.array(np.full(len(found), salted))], names=["t", "doc", "s1", "n", "pos", "salted"])

    return run


WHOLE = "doc long, s1 long, tokens binary"


def whole_sets(k: int):
    """Sets of the texts, a repeated row once a task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for ids, known, owner, values, n in blobs(batches, k):
            counts, s1, _ = signatures(owner, values, n)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            sets = [values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            keys = list(zip(ids.tolist(), s1.tolist(), strict=True))
            fresh = pa.array([key not in seen and not seen.add(key) for key in keys], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(s1.view(np.int64)), pa.array(sets, pa.binary())], names=["doc", "s1", "tokens"]).filter(fresh)

    return run


def plausible(num: int, den: int):
    """Pairs whose histograms allow a link: the lesser counts of all cells bound the intersection from above."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                x, y = cells_of(part.column("x")), cells_of(part.column("y"))
                most, total = np.minimum(x, y).sum(axis=1), x.sum(axis=1) + y.sum(axis=1)
                yield part.select(PAIR).filter(pa.array(den * most >= num * (total - most)))

    return run


def alike(num: int, den: int, level):
    """Pairs that share prefix tokens under the other orders too, and whose sets are similar enough."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                ok[k] = all(np.isin(*sides).any() for sides in zip(other_prefixes(p, level.value, num, den), other_prefixes(q, level.value, num, den), strict=True))
                if ok[k]:
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok[k] = den * both >= num * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def other_prefixes(tokens: np.ndarray, level: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """A set's prefixes under the second and the third order."""
    n = len(tokens) - -(-num * len(tokens) // den) + 1
    return [tokens[np.argpartition(keys, n - 1)[:n]] for keys in orders(tokens, level)[1:]]


def possible(num: int, den: int, x: str, y: str) -> Column:
    """Size bound, and position bound for the first token that two sets share."""
    nx, ny, px, py = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
    return (F.greatest(nx, ny) * num <= F.least(nx, ny) * den) & (F.least(nx - px, ny - py) * (num + den) >= (nx + ny) * num)


PAIR = ["a", "sa", "b", "sb"]


def pairs_of(joined: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs, the smaller (id, set) first."""
    p, q = F.struct(F.col(f"{x}.doc").alias("d"), F.col(f"{x}.s1").alias("s")), F.struct(F.col(f"{y}.doc").alias("d"), F.col(f"{y}.s1").alias("s"))
    low, high = F.least(p, q), F.greatest(p, q)
    return joined.select(low["d"].alias("a"), low["s"].alias("sa"), high["d"].alias("b"), high["s"].alias("sb")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, num: int, den: int, level, written: list[str]) -> DataFrame:
    """Links (a, b) among the pairs. ``sets``: doc, s1 and histogram of the sets."""
    left, right = (sets.select(F.col("doc_id").alias(d), F.col("s1").alias(s), F.col("cells").alias(x)) for d, s, x in (("a", "sa", "x"), ("b", "sb", "y")))
    pairs = stash(right.join(small(pairs), ["b", "sb"]).join(left, ["a", "sa"]).select(*PAIR, "x", "y").mapInArrow(plausible(num, den), "a long, sa long, b long, sb long").distinct(), written)
    need = pairs.select(F.col("a").alias("doc_id"), F.col("sa").alias("s1")).unionByName(pairs.select(F.col("b").alias("doc_id"), F.col("sb").alias("s1")))
    texts = docs.join(small(stash(need.select("doc_id").distinct(), written)), "doc_id", "left_semi")
    whole_ = stash(texts.select("doc_id", "text").mapInArrow(whole_sets(k), WHOLE), written)
    # leaders are few: theirs are the sets that move once each, the others' once for a pair
    leaders = whole_.join(small(stash(pairs.select(F.col("a").alias("doc"), F.col("sa").alias("s1")).distinct(), written)), ["doc", "s1"], "left_semi")
    left, right = (rows.select(F.col("doc").alias(d), F.col("s1").alias(s), F.col("tokens").alias(t)) for rows, d, s, t in ((leaders, "a", "sa", "x"), (whole_, "b", "sb", "y")))
    return right.join(small(pairs), ["b", "sb"]).join(left, ["a", "sa"]).select("a", "b", "x", "y").mapInArrow(alike(num, den, level), "a long, b long")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set) and component_id of each row."""
    spark, written, kept = docs.sparkSession, [], []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = stash(docs.mapInArrow(scan(shingle), SCAN), kept)
    level = spark.sparkContext.broadcast(levels_of(scanned))
    rows = scanned.where("slice is null").select("doc_id", "n", "s1", "s2")
    sets = scanned.where("slice is null and doc_id is not null and n > 0").select("doc_id", "s1", "cells")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    # written, so that the join to it is either a broadcast of a counted table or one that Spark can split
    classes = small(stash(classes, kept))

    entries = rows.where("n > 0").agg(F.sum(F.expr(f"n - ceil({num} * n / {den}) + 1"))).first()[0] or 0
    buckets, held = max(1, parts_for(spark, int(entries), BUCKET_BYTES // ENTRY.itemsize), -(-int(entries) * ENTRY.itemsize // BUCKET_BYTES)), parts_for(spark, int(entries), BUCKET_BYTES // ENTRY.itemsize)
    width = -(-2 * buckets // FAN)  # salted buckets are as many again
    sent = docs.mapInArrow(first_order(shingle, num, den, level, buckets, width), PACKET).repartition(held, "bucket")
    if width > 1:
        sent = sent.mapInArrow(deal(level, buckets), PACKET).repartition(held, "bucket")
    shared = stash(sent.groupBy("bucket").applyInArrow(meet(buckets), SHARED), written)
    salted = shared.where("salted").groupBy("t", "s1", "n", "pos").agg(F.min("doc").alias("doc"))
    e = shared.where("not salted").drop("salted").unionByName(salted)
    # written: a token that very many classes share is then joined by broadcast, or by a join that Spark can split
    leaders = e.groupBy("t").agg(F.count("*").alias("c"), F.min(F.struct("pos", "doc", "s1", "n")).alias("l")).where("c > 1").select("t", "l.*")
    leaders = small(stash(leaders, written))
    x, y = e.alias("x"), leaders.alias("y")
    pairs = stash(pairs_of(x.join(y, "t").where((F.col("x.s1") != F.col("y.s1")) & possible(num, den, "x", "y")), "x", "y"), written)
    links = stash(verified(pairs, docs, sets, shingle, num, den, level, written), written)

    # a size's block never falls as the size grows, so the sizes that can match one lie between two blocks
    block = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num))).cast("int") if num < den else n.cast("int")

    # what may still connect two components: x has the smaller set, y one of at most den/num its size
    names = small(stash(components(links).withColumnRenamed("node", "doc"), written))
    named = e.join(names, "doc", "left").select("t", "doc", "s1", "n", "pos", F.coalesce("component", "doc").alias("c"))
    several = named.groupBy("t").agg(F.min("c").alias("l"), F.max("c").alias("h")).where("l <> h").select("t")
    named = stash(named.join(small(stash(several, written)), "t", "left_semi").withColumn("block", block(F.col("n"))), written)
    x, y = named.withColumn("block", F.explode(F.sequence("block", block(F.expr(f"n * {den} div {num}"))))).alias("x"), named.alias("y")
    smaller = F.struct("x.n", "x.doc", "x.s1") < F.struct("y.n", "y.doc", "y.s1")
    more = pairs_of(x.join(y, ["t", "block"]).where((F.col("x.c") != F.col("y.c")) & smaller & possible(num, den, "x", "y")), "x", "y")
    more = stash(more.join(pairs, PAIR, "left_anti"), written)
    links = links.unionByName(verified(more, docs, sets, shingle, num, den, level, written))

    # rows of one id are one document: its classes are linked
    placed = rows.join(classes, ["s1", "s2", "n"], "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    several = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("l"), F.max("class_id").alias("h")).where("l <> h").select("doc_id", "l")
    own = placed.join(small(stash(several, written)), "doc_id").where("class_id <> l").select(F.col("l").alias("a"), F.col("class_id").alias("b")).distinct()
    names = small(stash(components(stash(links.unionByName(own), written)).withColumnRenamed("node", "class_id"), kept))
    drop_tables(spark, written)
    return placed.join(names, "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents")).drop("class_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda k: concat_ws(' ', ws[k], ws[k + 1], ws[k + 2])) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY ALL
"""
