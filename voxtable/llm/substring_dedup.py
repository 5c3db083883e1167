"""Exact substring deduplication by fixed-block anchors (operator 5).

A window is ``WINDOW`` words of one document; a word goes if a window that covers it also starts in a document with
a smaller id. Every window of 13 words holds a whole block of 7 words at a multiple of 7 of its document, so an index
of the non-overlapping blocks, probed with every rolling 7-word window, misses no repeat:

1. index and probe: each group of documents (a hash of the id, about ``GROUP_BYTES`` of text) sends its distinct
   rolling hashes, marked where they are reference blocks and where two documents of the group have them, packed in
   5 bytes, to hash buckets. A bucket answers each group with the hashes that are a block of one document and a
   probe of another.
2. extension: around those anchors a group forms every 13-word window an anchor lies in, and sends each distinct one
   with its smallest id. A bucket answers with the smallest id over all groups, where that matters.
3. removal: windows with an answer below their own document's id are removed; adjacent ones merge into maximal repeats.

Rows between the steps are packed arrays, one for each pair of group and bucket, and distinct within a group: a
passage or a copy that a third of all documents share is one entry a group. Groups and buckets are as many as the text
needs, shuffle partitions ``MOST_PARTITIONS`` at most, each with many of them. Beyond ``FAN`` buckets a packet is for a
range of buckets first and a second step deals ranges out, packets of many groups together, so packets stay large. Nothing
is collected to the driver but one sum. Anchors may be false hits (45 bits or more tell them apart). Windows are told
apart by 64 bits: among w distinct windows that hold an anchor, some two of different words are taken for one with a
chance below w * w / 2**65 (3e-8 for a million of them, 3e-2 for a billion).

Defined results: a null text has no words; a very long text lies in one group, which it then fills alone; a row with a
null id keeps its whole text and is no reference; rows with the same id are one document's, none of them smaller, and lie
in groups by their texts; there are no ties, as windows count at the smallest id; an empty table gives no rows; further
columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.kernel import U64, Words, cover, give_back, lean, member, mix, rows_of, runs, whole
from voxtable.llm.shared import partitions, parts_for, short_batches
from voxtable.llm.shared import table as read_table

WINDOW = 13
#: Text of a group of documents: what one task of steps 2 and 3 holds at once.
GROUP_BYTES = 8 << 20
#: Probes that a task of step 1 gathers before it sends them.
SEND_WORDS = 1_000_000
#: Buckets that one task deals out at once.
FAN = 4096
PACKED = 5
#: In place of a group's number: a packet of many groups.
MANY = -1

TEXTS = "grp int, doc_id long, z binary"
NOT_CARRIED = 3
SENT = "bucket int, grp int, blob binary"
ANSWER = "grp int, blob binary"


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the upper 32 bits, even for any n."""
    return ((hashes >> U64(32)) * U64(n)) >> U64(32)


def pack(hashes: np.ndarray) -> bytes:
    """The lower 40 bits: with the bucket, which has the upper bits' share, they tell hashes apart."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // PACKED, 8), np.uint8)
    out[:, :PACKED] = np.frombuffer(blob, np.uint8).reshape(-1, PACKED)
    return out.view("<u8").ravel()


def squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.int64(len(a)).tobytes() + a.astype("<u8").tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def expand(blob: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, "<u8", n, at + 8))
        at += 8 + 8 * n
    return out


def table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


SENT_ARROW = [("bucket", pa.int32()), ("grp", pa.int32()), ("blob", pa.binary())]
ANSWER_ARROW = [("grp", pa.int32()), ("blob", pa.binary())]


def squeezed(docs: DataFrame, groups: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents by group, each text compressed on its own: what a shuffle of the texts costs at least."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            texts = pa.array([None if t is None else press.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, *batch.columns[NOT_CARRIED:]], names=["grp", "doc_id", "z", *batch.schema.names[NOT_CARRIED:]])

    # by id and text: neither a null id nor one of very many rows is one group
    grp = F.pmod(F.xxhash64(id_col, text_col), F.lit(groups))
    rows = docs.select(grp.cast("int").alias("grp"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([TEXTS, *(f"carry{k} {kinds[f'carry{k}']}" for k in range(len(carry)))]))


def open_texts(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Words, list[bytes]]]:
    """(groups, ids, known ids, words, texts) of blocks of rows."""
    opener = zstandard.ZstdDecompressor()
    step = 512
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        texts = [opener.decompress(z) if z else b"" for z in part.column("z").to_pylist()]
        ids = part.column("doc_id")
        known = np.asarray(ids.is_valid())
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        grp = np.asarray(part.column("grp")).astype(np.int64)
        for start, words in rows_of(pa.array(texts, pa.large_binary())):
            stop = start + len(words.counts)
            yield grp[start:stop], ids[start:stop], known[start:stop], words, texts[start:stop]


def per_document(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (value, id), ordered by value."""
    order = np.lexsort((ids, values))
    values, ids = values[order], ids[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (ids[1:] != ids[:-1])
    return values[new], ids[new]


def cuts(where: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of sorted buckets."""
    edges = [*runs(where).tolist(), len(where)]
    return ((int(where[a]), a, b) for a, b in zip(edges, edges[1:]))


def index_and_probe(block: int, buckets: int, width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        size: dict[int, int] = defaultdict(int)

        def send(grp: int) -> pa.RecordBatch:
            hashes, ids, blocked = (np.concatenate(x) for x in zip(*held.pop(grp), strict=True))
            size.pop(grp)
            order = np.argsort(hashes, kind="stable")
            hashes, ids, blocked = hashes[order], ids[order], blocked[order]
            at = runs(hashes)
            kind = np.zeros(len(at), np.int8)
            if len(at):
                # 1: a reference block; 2: more than one document of the group has it
                kind = np.maximum.reduceat(blocked, at).astype(np.int8) + 2 * (np.maximum.reduceat(ids, at) != np.minimum.reduceat(ids, at))
            hashes = hashes[at]
            where = bucket_of(hashes, buckets) // U64(width)
            order = np.lexsort((kind, where))
            hashes, where, kind = hashes[order], where[order], kind[order]
            rows = []
            for bucket, a, b in cuts(where):
                counts = np.bincount(kind[a:b], minlength=4).astype("<u4").tobytes()
                rows.append((bucket, grp, counts + (pack(hashes[a:b]) if width == 1 else hashes[a:b].astype("<u8").tobytes())))
            return table(rows, SENT_ARROW)

        for batch in batches:
            for grps, ids, known, words, _ in open_texts(batch):
                first, windows = whole(words, words.hashes(), block)
                text = words.texts()[first]
                blocked = (first - words.first[text]) % block == 0
                ok = known[text]
                for grp in np.unique(grps):
                    mine = ok & (grps[text] == grp)
                    if mine.any():
                        held[grp].append((windows[mine], ids[text[mine]], blocked[mine]))
                        size[grp] += int(mine.sum())
                while sum(size.values()) > SEND_WORDS:
                    yield send(max(size, key=size.get))
        for grp in list(held):
            yield send(grp)

    return run


def deal_probes(buckets: int):
    """Packets of ranges of buckets as packets of one bucket and many groups."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            hashes, grps, kinds = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            where = bucket_of(hashes, buckets)
            order = np.argsort(where, kind="stable")
            hashes, grps, kinds, where = hashes[order], grps[order], kinds[order], where[order]
            return table([(bucket, MANY, grps[a:b].astype("<u4").tobytes() + kinds[a:b].tobytes() + pack(hashes[a:b])) for bucket, a, b in cuts(where)], SENT_ARROW)

        for batch in batches:
            for grp, blob in zip(batch.column("grp").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                hashes = np.frombuffer(blob, "<u8", -1, 16)
                held.append((hashes, np.full(len(hashes), grp), np.repeat(np.arange(4, dtype=np.int8), np.frombuffer(blob, "<u4", 4))))
                size += len(hashes)
                if size > SEND_WORDS:
                    yield send()
                    size = 0
        if held:
            yield send()

    return run


def opened(grp: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, groups, kinds) of a packet of probes."""
    if grp != MANY:
        hashes = unpack(blob[16:])
        return hashes, np.full(len(hashes), grp, np.int64), np.repeat(np.arange(4, dtype=np.int8), np.frombuffer(blob, "<u4", 4))
    n = len(blob) // (5 + PACKED)
    return unpack(blob[5 * n :]), np.frombuffer(blob, "<u4", n).astype(np.int64), np.frombuffer(blob, np.int8, n, 4 * n)


def anchors(key, rows):
    """One bucket: the hashes that are a block of one document and a probe of another, for each group that has them."""
    give_back()
    packets = zip(rows.column("grp").to_pylist(), rows.column("blob").to_pylist(), strict=True)
    every, grps, kind = (np.concatenate(x) for x in zip(*(opened(*p) for p in packets), strict=True))
    # one group may have sent the same hash twice, from two documents: those count as two
    order = np.argsort(every, kind="stable")
    every, grps, kind = every[order], grps[order], kind[order]
    at = runs(every)
    times, kinds = np.diff([*at, len(every)]), np.bitwise_or.reduceat(kind, at)
    shared = np.repeat((kinds & 1 > 0) & ((times > 1) | (kinds & 2 > 0)), times)
    every, grps = every[shared], grps[shared]
    order = np.argsort(grps, kind="stable")
    every, grps = every[order], grps[order]
    head = np.int32(key[0].as_py()).tobytes()
    return pa.Table.from_batches([table([(grp, head + pack(every[a:b])) for grp, a, b in cuts(grps)], ANSWER_ARROW)])


def anchor_windows(words: Words, known: np.ndarray, table_: dict[int, np.ndarray], block: int, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the windows in which an anchor lies."""
    hashes = words.hashes()
    first, blocks_ = whole(words, hashes, block)
    where, hit = bucket_of(blocks_, buckets).astype(np.int64), np.zeros(len(first), bool)
    low = blocks_ & U64((1 << (8 * PACKED)) - 1)
    order = np.argsort(where, kind="stable")
    cut = [*runs(where[order]), len(order)]
    for a, b in zip(cut, cut[1:]):
        got = table_.get(int(where[order[a]]))
        if got is not None:
            hit[order[a:b]] = member(low[order[a:b]], got) >= 0
    spots = first[hit]
    # the windows that hold a block at p start at p - (window - block) to p
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, np.maximum(spots - (window - block), 0), 1)
    np.add.at(edges, spots + 1, -1)
    near = np.cumsum(edges[:-1]) > 0
    at, windows = whole(words, hashes, window)
    ok = near[at] & known[words.texts()[at]]
    return at[ok], windows[ok]


def extend(block: int, window: int, buckets: int, width: int):
    def run(key, docs, hits):
        give_back()
        found: dict[int, list] = defaultdict(list)
        for blob in hits.column("blob").to_pylist():
            found[int(np.frombuffer(blob, np.int32, 1)[0])].append(unpack(blob[4:]))
        index, values, owners = {k: np.unique(np.concatenate(v)) for k, v in found.items()}, [], []
        for _, ids, known, words, _ in open_texts(docs) if index else ():
            at, windows = anchor_windows(words, known, index, block, window, buckets)
            values.append(windows)
            owners.append(ids[words.texts()[at]])
        rows = []
        if values and sum(map(len, values)):
            values, owners = per_document(np.concatenate(values), np.concatenate(owners))
            at = runs(values)
            least, most = owners[at], owners[np.concatenate([at[1:], [len(owners)]]) - 1]
            values = values[at]
            where = bucket_of(mix(values), buckets) // U64(width)
            order = np.argsort(where, kind="stable")
            for bucket, a, b in cuts(where[order]):
                o = order[a:b]
                rows.append((bucket, key[0].as_py(), squeeze(values[o], least[o].view(U64), (least[o] != most[o]).astype(U64))))
        return pa.Table.from_batches([table(rows, SENT_ARROW)])

    return run


def deal_windows(buckets: int):
    """Packets of ranges of buckets as packets of one bucket and many groups."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            where = bucket_of(mix(columns[0]), buckets)
            order = np.argsort(where, kind="stable")
            return table([(bucket, MANY, squeeze(*(c[order[a:b]] for c in columns))) for bucket, a, b in cuts(where[order])], SENT_ARROW)

        for batch in batches:
            for grp, blob in zip(batch.column("grp").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                arrays = expand(blob)
                held.append((*arrays, np.full(len(arrays[0]), grp, U64)))
                size += len(arrays[0])
                if size > SEND_WORDS:
                    yield send()
                    size = 0
        if held:
            yield send()

    return run


def smallest(key, rows):
    """One bucket: for each group the windows for which a document with a smaller id than some of its own has them."""
    give_back()
    sent = [expand(blob) for blob in rows.column("blob").to_pylist()]
    grps = np.concatenate([x[3].astype(np.int64) if grp == MANY else np.full(len(x[0]), grp) for grp, x in zip(rows.column("grp").to_pylist(), sent, strict=True)])
    values, own, several = (np.concatenate([x[k] for x in sent]) for k in range(3))
    own = own.view(np.int64)
    order = np.lexsort((own, values))
    at = runs(values[order])
    low = np.empty(len(values), np.int64)
    low[order] = np.repeat(own[order][at], np.diff([*at, len(values)]))
    keep = np.flatnonzero((low < own) | (several > 0))
    keep = keep[np.argsort(grps[keep], kind="stable")]
    return pa.Table.from_batches([table([(grp, squeeze(values[keep[a:b]], low[keep[a:b]].view(U64))) for grp, a, b in cuts(grps[keep])], ANSWER_ARROW)])


RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept binary"
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def without(text: bytes, words: Words, base: int, first: int, edges: np.ndarray) -> bytes:
    """The text without the words of some ranges; the white space around them stays."""
    parts, last = [], 0
    for x, y in zip(edges[::2], edges[1::2], strict=True):
        parts.append(text[last : int(words.starts[first + x]) - base])
        last = int(words.ends[first + y - 1]) - base
    return b"".join([*parts, text[last:]])


def remove(window: int, keep_text: bool):
    def run(key, docs, hits):
        give_back()
        pairs = [expand(blob) for blob in hits.column("blob").to_pylist()]
        values = np.concatenate([x[0] for x in pairs] or [np.zeros(0, U64)])
        least = np.concatenate([x[1].view(np.int64) for x in pairs] or [np.zeros(0, np.int64)])
        order = np.argsort(values, kind="stable")
        values, least = values[order], least[order]
        counts, removed, spans, kept = [], [], [], []
        for _, ids, known, words, texts in open_texts(docs):
            gone = np.zeros(len(words), bool)
            if len(values):
                at, windows = whole(words, words.hashes(), window)
                text, found = words.texts()[at], member(windows, values)
                bad = (found >= 0) & known[text] & (least[found] < ids[text])
                gone = cover(at[bad], window, len(words))
            for k, text in enumerate(texts):
                a, b = int(words.first[k]), int(words.first[k + 1])
                mine = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                counts.append(b - a)
                removed.append(int(mine.sum()))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                if keep_text:
                    kept.append(without(text, words, int(words.offsets[k]), a, edges) if len(edges) else text)
                else:
                    bits = text.split()
                    kept.append(hashlib.sha256(b" ".join([w for w, g in zip(bits, mine, strict=True) if not g] if len(edges) else bits)).digest())
        if keep_text and docs.column("z").null_count:
            kept = [x if ok else None for x, ok in zip(kept, docs.column("z").is_valid().to_pylist(), strict=True)]
        carried = docs.schema.names[NOT_CARRIED:]
        return pa.table(
            [docs.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary()), *(docs.column(c) for c in carried)],
            names=["doc_id", "n_words", "n_removed", "spans", "kept", *carried],
        )

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, spans (of removed words, maximal repeats), kept.

    ``kept`` is the SHA-256 of the words that stay, joined by spaces; with ``keep_text``, it is the text that stays, with
    the white space around it (null for null). Columns named in ``carry`` come along as ``carry0``, ``carry1`` and so on.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    short_batches(spark)
    # a sum sets the number of groups, so that a group's size doesn't grow with the input
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups, parts = max(partitions(spark), -(-total // GROUP_BYTES)), parts_for(spark, total, GROUP_BYTES)
    width = -(-groups // FAN)
    texts = squeezed(docs, groups, id_col, text_col, carry).repartition(parts, "grp")
    probes = texts.select("grp", "doc_id", "z").mapInArrow(index_and_probe(block, groups, width), SENT)
    if width > 1:
        probes = probes.repartition(parts, "bucket").mapInArrow(deal_probes(groups), SENT)
    hits = probes.repartition(parts, "bucket").groupBy("bucket").applyInArrow(anchors, ANSWER)
    windows = texts.groupBy("grp").cogroup(hits.repartition(parts, "grp").groupBy("grp")).applyInArrow(extend(block, window, groups, width), SENT)
    if width > 1:
        windows = windows.repartition(parts, "bucket").mapInArrow(deal_windows(groups), SENT)
    answers = windows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(smallest, ANSWER).repartition(parts, "grp")
    kinds = dict(texts.dtypes)
    result = ", ".join([RESULT, *(f"carry{k} {kinds[f'carry{k}']}" for k in range(len(carry)))])
    return texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(remove(window, keep_text), result)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM d),
p AS (SELECT doc_id, w, k, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o, lead(w, 8) OVER o, lead(w, 9) OVER o, lead(w, 10) OVER o, lead(w, 11) OVER o, lead(w, 12) OVER o) AS g,
             lead(k, 12) OVER o AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
g AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS least FROM p WHERE last IS NOT NULL),
x AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM g WHERE least < doc_id),
s AS (SELECT doc_id, count(*) AS n_words, count(x.k) AS n_removed, string_agg(w, ' ' ORDER BY k) FILTER (x.k IS NULL) AS kept
      FROM w LEFT JOIN x USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
