"""Token ids in patched frame-of-reference blocks (operator 8).

Documents are put in order by range partitions of their ids, each text is encoded whole, and every partition writes
files of ``FILE_SEGMENTS`` segments at most. Partitions are ``MOST_PARTITIONS`` at most: beyond that they write more files
each, so a file's size doesn't grow with the input. Spark's own text writer writes them (record separator: ``MARK``), so
files go wherever Spark can write.

A segment holds up to ``SEGMENT_IDS`` ids of successive documents:

    "PFR1"  u32 documents, ids, blocks   u32 table bytes, payload bytes
    table (zstd): i64 document id, u8 whether it is null, u32 ids of each document
    index, for each block: u32 payload offset of its start, u32 minimum, u8 width, u8 exceptions
    payload, for each block: 128 differences to the minimum, ``width`` low bits each; then u8 place and u32 difference
    of each exception, a difference that ``width`` bits can't hold

The width is what ``PERCENTILE`` of a block's differences fit in. Blocks are cut without regard to documents, so one
document's ids are found by its offset in the table and read from the blocks it touches only (``ids_at``).

Encoding works on distinct words where the tokenizer never merges over white space: then each chunk between ASCII white
space is encoded once for as long as a worker remembers it. Whether it does is found out from the tokenizer itself, by
encoding characters of all kinds beside one another and apart (``keeps_words_apart``); each block of texts also has one
encoded whole, and a difference is an error. Other tokenizers encode whole texts. Words are looked up by 64-bit hashes: of
the w distinct words that a worker holds (``CACHE_WORDS`` and a block's at most), some two are taken for one with a chance
below w * w / 2**65, 1e-7 for two million.

Defined results: a null text is an empty one and has the end id alone; a very long text is encoded as any other, and is one
segment with the texts beside it; documents with a null id come first, equal ids
stay next to each other in an arbitrary order; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtable.llm.kernel import U64, Words, blocks, lean, member, text_arrays
from voxtable.llm.shared import folder, parts_for, stash, table

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 20
END_ID = 2
#: Text of one file, and words that a worker remembers.
FILE_BYTES, CACHE_WORDS = 24 << 20, 1_500_000
FILE_SEGMENTS = 8
MAGIC, MARK = b"PFR1", "\nPFR1-end\n"
HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("ids", "<u4"), ("blocks", "<u4"), ("table", "<u4"), ("payload", "<u4")])
INDEX = np.dtype([("at", "<u4"), ("least", "<u4"), ("width", "u1"), ("exceptions", "u1")])
PATCH = np.dtype([("place", "u1"), ("value", "<u4")])


def lanes(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row's values one after another, as bytes: value k of all rows at a time."""
    columns = (values & np.uint32((1 << width) - 1)).T.astype(np.uint64, order="C")
    out = np.zeros((2 * width, len(values)), np.uint64)
    for k in range(BLOCK):
        lane, shift = divmod(k * width, 64)
        out[lane] |= columns[k] << np.uint64(shift)
        if shift + width > 64:
            out[lane + 1] |= columns[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8)


def unlanes(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``lanes``."""
    columns = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
    out = np.empty((BLOCK, len(packed)), np.uint32)
    for k in range(BLOCK):
        lane, shift = divmod(k * width, 64)
        value = columns[lane] >> np.uint64(shift)
        if shift + width > 64:
            value = value | columns[lane + 1] << np.uint64(64 - shift)
        out[k] = (value & np.uint64((1 << width) - 1)).astype(np.uint32)
    return out.T


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(index, payload) of the ids' blocks."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, INDEX), b""
    padded = np.full(n * BLOCK, ids[-1], np.int64)
    padded[: len(ids)] = ids
    padded = padded.reshape(n, BLOCK)
    least = padded.min(axis=1)
    rest = (padded - least[:, None]).astype(np.uint32)
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    chosen = np.partition(rest, at, axis=1)[:, at]
    width = np.where(chosen > 0, np.floor(np.log2(np.maximum(chosen, 1).astype(np.float64))) + 1, 0).astype(np.int64)
    outside = (rest.astype(np.int64) >> width[:, None]) > 0
    patches = outside.sum(axis=1)
    sizes = width * (BLOCK // 8) + patches * PATCH.itemsize
    starts = np.concatenate([[0], np.cumsum(sizes)])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = lanes(rest[rows], int(w))
        payload[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(outside)
    if len(block):
        patch = np.zeros(len(block), PATCH)
        patch["place"], patch["value"] = place, rest[block, place]
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(patches)])[block]
        to = starts[block] + width[block] * (BLOCK // 8) + nth * PATCH.itemsize
        payload[to[:, None] + np.arange(PATCH.itemsize)] = patch.view(np.uint8).reshape(-1, PATCH.itemsize)
    index = np.zeros(n, INDEX)
    index["at"], index["least"], index["width"], index["exceptions"] = starts[:-1], least, width, patches
    return index, payload.tobytes()


def unpack_ids(index: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """The ids of the blocks in ``index``; the last block's filling is included."""
    out = np.zeros((len(index), BLOCK), np.uint32)
    width, starts = index["width"].astype(np.int64), index["at"].astype(np.int64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = payload[starts[rows][:, None] + np.arange(w * (BLOCK // 8))]
        out[rows] = unlanes(packed, int(w))
    patches = index["exceptions"].astype(np.int64)
    if patches.any():
        block = np.repeat(np.arange(len(index)), patches)
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(patches)])[block]
        at = starts[block] + width[block] * (BLOCK // 8) + nth * PATCH.itemsize
        patch = np.ascontiguousarray(payload[at[:, None] + np.arange(PATCH.itemsize)]).view(PATCH).ravel()
        out[block, patch["place"]] = patch["value"]
    return (out + index["least"][:, None].astype(np.uint32)).ravel()


def write_segment(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    index, payload = pack_ids(ids)
    rows = zstandard.ZstdCompressor(level=3).compress(doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + counts.astype("<u4").tobytes())
    head = np.array([(MAGIC, len(doc_ids), len(ids), len(index), len(rows), len(payload))], HEAD)
    return head.tobytes() + rows + index.tobytes() + payload


def segments(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, known, counts, index, payload) of each segment of a file."""
    at, mark = 0, MARK.encode()
    while at < len(content):
        head = np.frombuffer(content, HEAD, 1, at)[0]
        if head["magic"] != MAGIC:
            raise ValueError(f"no segment starts at byte {at}")
        n, at = int(head["docs"]), at + HEAD.itemsize
        rows = zstandard.ZstdDecompressor().decompress(content[at : at + int(head["table"])], max_output_size=13 * n + 64)
        at += int(head["table"])
        index = np.frombuffer(content, INDEX, int(head["blocks"]), at)
        at += index.nbytes
        payload = np.frombuffer(content, np.uint8, int(head["payload"]), at)
        at += payload.nbytes
        if content[at : at + len(mark)] != mark:
            raise ValueError(f"a segment doesn't end at byte {at}")
        at += len(mark)
        yield np.frombuffer(rows, "<i8", n), np.frombuffer(rows, np.uint8, n, 8 * n) > 0, np.frombuffer(rows, "<u4", n, 9 * n), index, payload


def ids_at(index: np.ndarray, payload: np.ndarray, start: int, n: int) -> np.ndarray:
    """n ids from place ``start`` of a segment; only the blocks they lie in are read."""
    first, last = start // BLOCK, -(-(start + n) // BLOCK)
    return unpack_ids(index[first:last], payload)[start - first * BLOCK :][:n]


#: Beside white space: letters with and without case, marks, digits, punctuation, symbols, other spaces and controls.
PROBES = ("a", "Zz", "ß", "Σ", "ας", "é", "e\u0301", "\u0301", "ﬁ", "漢", "かな", "한", "ا", "1", "23", "½", "'", "'s", "'t", ".", "...", "-", "_", "#", "$", "<", "|>", "▁", "Ġ", "€", "😀", "\u200d", "\u00a0", "\u3000", "\x00", "\x7f")


def keeps_words_apart(tokenizer) -> bool:
    """Whether texts that ASCII white space joins have the ids of their parts, one after another."""
    whole, parts = [], []
    for x in PROBES:
        for y in ("", *PROBES):
            for space in (" ", "\t", "\n", "\r\n", "\x0b", "\x0c", "  "):
                whole += [f"{x}{space}{y}", f"{space}{x}{y}{space}"]
                parts += [(x, y), (x + y,)]
    texts = sorted({p for ps in parts for p in ps} | set(whole))
    ids = {t: x.ids for t, x in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True)}
    return all(ids[w] == [i for p in ps for i in ids[p]] for w, ps in zip(whole, parts, strict=True))


class Encoder:
    """Ids of whole texts. With ``by_word`` every distinct chunk between ASCII white space is encoded once a worker; None
    asks the tokenizer."""

    def __init__(self, path: str, end_id: int | None = END_ID, by_word: bool | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.by_word = keeps_words_apart(self.tokenizer) if by_word is None else by_word
        # a special token between two chunks shows where the first one's ids end
        special = [(k, x.content) for k, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not (x.lstrip or x.rstrip or x.single_word)]
        self.fence = special[0] if special else None
        self.known, self.where = np.zeros(0, U64), np.zeros(0, np.int64)
        self.flat, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of each text's ids) straight from the library."""
        found = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(lens.sum())), lens

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts without white space: many at a time, which saves the library's cost of a call."""
        if self.fence is None or any(self.fence[1] in x for x in chunks):
            return self.encode(chunks)
        number, text = self.fence
        flat, _ = self.encode([f" {text} ".join([*chunks[a : a + 500], ""]) for a in range(0, len(chunks), 500)])
        fences = np.flatnonzero(flat == number)
        if len(fences) != len(chunks):
            raise ValueError("the tokenizer doesn't keep chunks apart; encode whole texts")
        return flat[flat != number], np.diff(np.concatenate([[-1], fences])) - 1

    def entries(self, hashes: np.ndarray, chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts) for sorted distinct hashes; ``chunks`` gives the texts at some places of them."""
        new = np.flatnonzero(member(hashes, self.known) < 0)
        flat, starts, lens = self.flat, self.starts, self.lens
        known, where = self.known, self.where
        if len(new):
            more, sizes = self.encode_chunks(chunks(new))
            starts = np.concatenate([starts, len(flat) + np.cumsum(sizes) - sizes])
            to = np.searchsorted(known, hashes[new])
            where = np.insert(where, to, len(lens) + np.arange(len(new)))
            known = np.insert(known, to, hashes[new])
            flat, lens = np.concatenate([flat, more]), np.concatenate([lens, sizes])
            if len(known) <= CACHE_WORDS:  # a full memory stays as it is
                self.known, self.where, self.flat, self.starts, self.lens = known, where, flat, starts, lens
        entry = where[member(hashes, known)] if len(hashes) else np.zeros(0, np.int64)
        return flat, starts[entry], lens[entry]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of each text's ids), end ids included."""
        raw, n = data.tobytes(), len(offsets) - 1
        end = np.array([] if self.end_id is None else [self.end_id], np.uint32)
        if not self.by_word:
            flat, lens = self.encode([raw[a:b].decode() for a, b in zip(offsets, offsets[1:])])
            bounds = np.concatenate([[0], np.cumsum(lens)])
            return np.concatenate([x for k in range(n) for x in (flat[bounds[k] : bounds[k + 1]], end)] or [flat]), lens + len(end)
        words = Words(data, offsets)
        distinct, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        flat, starts, lens = self.entries(distinct, lambda new: [raw[a:b].decode() for a, b in zip(words.starts[at[new]].tolist(), words.ends[at[new]].tolist())])
        # each text ends with a chunk of its own: the end id
        starts, lens = np.insert(starts[back], words.first[1:], len(flat)), np.insert(lens[back], words.first[1:], len(end))
        flat = np.concatenate([flat, end])
        total = np.concatenate([[0], np.cumsum(lens)])
        spots = np.repeat(starts - total[:-1], lens) + np.arange(total[-1])
        ids, bounds = flat[spots], total[words.first + np.arange(n + 1)]
        sizes = np.where(words.counts > 1, np.diff(offsets), len(raw) + 1)
        if n and (k := int(sizes.argmin())) >= 0 and sizes[k] <= len(raw):  # the shortest text of several words, also encoded whole
            known, _ = self.encode([raw[offsets[k] : offsets[k + 1]].decode()])
            if not np.array_equal(known, ids[bounds[k] : bounds[k + 1] - len(end)]):
                raise ValueError("the tokenizer's ids of a text aren't those of its words; write with by_word=False")
        return ids, np.diff(bounds)


_encoders: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    """One encoder a worker process: what it has learnt serves the next tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, by_word: bool | None = None) -> None:
    """Writes the ids of all texts below ``path``, in ascending order of ids over the files' names."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    files = parts_for(spark, total, FILE_BYTES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    # the tie spreads rows of one id over partitions, in case there are very many
    rows = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            segment = write_segment(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], names=["segment"])

        for batch in batches:
            data, offsets = text_arrays(batch.column(1))
            known = np.asarray(batch.column(0).is_valid())
            ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            for a, b in blocks(offsets):
                flat, lens = encoder(tokenizer, end_id, by_word).block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append((ids[a:b], known[a:b], lens, flat))
                size += len(flat)
                if size >= SEGMENT_IDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    # a cast to string keeps the bytes as they are
    rows.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value")).write.options(lineSep=MARK, maxRecordsPerFile=FILE_SEGMENTS).text(path)


#: Files of one partition at most.
MOST_FILES = 1 << 20
READ = "file long, place long, doc_id long, before long, n_tokens long, ids_crc32 long"


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and ``ids`` on demand."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, nth = re.search(r"part-(\d+)-.*-c(\d+)", name).groups()
                number, place, before = int(part) * MOST_FILES + int(nth), 0, 0
                for doc_ids, known, counts, index, payload in segments(content.as_py()):
                    flat = unpack_ids(index, payload)[: int(counts.sum())].astype("<u4")
                    bounds = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
                    raw, n = memoryview(flat.tobytes()), len(counts)
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                    columns = [pa.array(np.full(n, number)), pa.array(place + np.arange(n)), pa.array(doc_ids.astype(np.int64), mask=~known), pa.array(before + bounds[:-1]), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())]
                    names = ["file", "place", "doc_id", "before", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    place, before = place + n, before + int(bounds[-1])

    rows = stash(files.mapInArrow(run, READ + ", ids array<int>" * with_ids))
    # one row a file: the offsets of the files, 100 TB of text being some two million
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("offset"))
    return rows.join(sums, "file").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "place", *["ids"] * with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = folder(spark)
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
