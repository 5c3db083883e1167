"""Sharding, chat formatting, archives, token files and packing: round trips and brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxtable.llm import chat_format, packing, sharding, token_output, warc
from voxtable.llm.shared import folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_sharding(docs, rows, bucket_rows, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    k = 6
    got = sharding.assign(docs, k).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    sizes = [len(by_shard[s]) for s in range(k)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    totals = Counter(r.source for r in got)
    for v in by_shard.values():  # the mixture: within one row of the source's share, and one for the cut
        for source, n in Counter(r.source for r in v).items():
            assert abs(n - totals[source] * len(v) / len(rows)) <= 2
    again = sharding.assign(docs.repartition(5), k).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    order = slow_order(rows)
    assert [(r.doc_id, r.text_crc32) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == [order[p] for p in range(len(rows))]


def slow_order(rows) -> list[tuple]:
    """(id, checksum) in the interleaved order, by plain sorting; hashes as the engine's own function gives them."""
    import pyspark.sql

    spark = pyspark.sql.SparkSession.getActiveSession()
    flat = [(r[0], r[3], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16) for r in rows]
    hashed = spark.createDataFrame(flat, "i long, s string, c long, n long").withColumns({"h": F.xxhash64(F.lit(sharding.SEED), "i", "c", "n"), "t": F.coalesce(F.concat(F.lit("s"), "s"), F.lit("n"))}).withColumn("g", F.xxhash64(F.lit(sharding.SEED), "t")).collect()
    low = lambda x: (x is not None, x)
    by_source, placed = defaultdict(list), []
    for r in hashed:
        by_source[r.t].append(r)
    for t, group in by_source.items():
        group.sort(key=lambda r: (r.h, low(r.i), r.c))
        placed += [((k + 0.5) / len(group), r.g, t, r.h, low(r.i), r.c) for k, r in enumerate(group)]
    return [(p[4][1], p[5]) for p in sorted(placed)]


def test_sharding_files(spark, docs, rows, empty):
    path = folder(spark)
    sharding.write_shards(docs.select("doc_id", "text", "source"), path, 4)
    assert Counter((r.doc_id, r.text) for r in spark.read.parquet(path).collect()) == Counter((r[0], r[1]) for r in rows)
    assert sharding.assign(empty).count() == 0


def test_sharding_keeps_columns_with_its_own_names(spark):
    rows = [(k, f"t{k}", "s", 7 * k, k % 3, "x") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, slot int, Shard string")
    sharding.write_shards(docs, path := folder(spark), 4)
    got = spark.read.parquet(path).collect()
    assert sorted((r.doc_id, r.text, r.size_, r.slot_, r.Shard_) for r in got) == [(k, t, n, m, x) for k, t, _, n, m, x in rows]
    assert all(r.size == len(r.text) + 16 for r in got)


@pytest.mark.parametrize("case", ["one-row sources", "one row many times"])
def test_sharding_has_no_hot_range(spark, monkeypatch, case):
    """Thousands of rows with one fractional rank, and one row that is repeated, are cut into ranges as any others."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    n, sizes, plain = 2000, [], sharding.ranges
    monkeypatch.setattr(sharding, "ranges", lambda *a: [made := plain(*a), sizes.append(max(r["count"] for r in made.groupBy("__part").count().collect()))][0])
    docs = spark.range(n).select(F.when(F.lit(case[4] == "r"), F.col("id")).otherwise(F.lit(5)).alias("doc_id"), F.lit("t").alias("text"), F.when(F.lit(case[4] == "r"), F.col("id").cast("string")).otherwise("s").alias("source"))
    got = sharding.assign(docs, 8)
    assert len(sizes) == 2 and max(sizes) < 400
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(s, k) for s in range(8) for k in range(n // 8)]


TURNS = st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "<|end|>"])), st.one_of(st.none(), st.text(alphabet="a<|>&;[]/INSTtextmore\né", max_size=12))), min_size=1, max_size=9)


@settings(max_examples=15, deadline=None)
@given(st.lists(TURNS, min_size=1, max_size=4))
def test_chat_format(spark, talks):
    rows = [(c, turn, role, text, "z") for c, talk in enumerate(talks) for turn, role, text in talk]
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).cache()
    lines, digests = {r.conv_id: r for r in made.collect()}, {r.conv_id: r for r in chat_format.digest(made).collect()}
    for c, talk in enumerate(talks):
        turns = sorted((turn, role or "", text or "") for turn, role, text in talk)
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learnt = "".join(text for _, role, text in turns if role == "assistant")
        d, f = digests[c], lines[c].formatted
        assert (d.n_turns, d.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(f))
        at, seen = 0, ""
        for run in lines[c].loss_runs:
            seen += f[at : at + run.chars] if run.loss else ""
            at += run.chars
        assert at == len(f) and seen.replace("&lt;", "<").replace("&#91;", "[").replace("&amp;", "&") == learnt
        assert f.count("<|turn|>") == 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))


def test_chat_format_of_long_and_no_conversations(spark, monkeypatch):
    """Blocks and mask over several chunks; the loss follows the mask, not the roles."""
    monkeypatch.setattr(chat_format, "CHUNK", 4)
    roles = ["user", "assistant", "assistant", "assistant", "assistant", "assistant", "user", "user", "assistant"]
    talk = [(1, k, roles[k % 9], f"t{k}<é>") for k in range(41)]
    rows = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(rows).cache()
    want = ""
    for k, (_, _, role, text) in enumerate(talk):
        text = text.replace("<", "&lt;")
        want += f"<|more|>{text}" if k and talk[k - 1][2] == role else ("<|end|>" if k else "") + f"<|turn|>{role}<|text|>{text}"
    assert made.first().formatted == want + "<|end|>"
    learnt = "".join(t for _, _, role, t in talk if role == "assistant")
    assert chat_format.digest(made).first().loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    changed = made.withColumn("loss_runs", F.transform("loss_runs", lambda r: F.struct((~r["loss"]).alias("loss"), r["chars"].alias("chars"))))
    assert chat_format.digest(changed).first().loss_sha256 != hashlib.sha256(learnt.encode()).hexdigest()
    assert chat_format.digest(chat_format.format_conversations(rows.where("conv_id = 2"))).count() == 0


def test_chat_format_is_native(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.digest(chat_format.format_conversations(rows))._jdf.queryExecution().toString()
    assert "loss_runs" in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 700)
    monkeypatch.setattr(warc, "CHUNK_BYTES", 90)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    odd = "WARC/1.1\r\n\r\n\r\n0\r\n\r\nContent-Length: 5\r\n" * 60
    pages = [(1, "http://a/ü x\n", "é" * 900), (2, None, "é" * 900), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "", ""), (7, "u", odd), (7, "u", odd), (8, "u", odd), (None, "u", "n" * 150), (9, "u", "n" * 150), (None, "u", "m" * 2000), (10, "u", "x" * 99), (11, "u", "x" * 99)]
    # an id with several payloads, both cut into segments, one with a copy elsewhere
    pages += [(12, "u", "p" * 2500), (12, "v", "q" * 3000), (12, "w", "q" * 3000), (12, "u", "r" * 20), (13, "u", "q" * 3000)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    path = folder(spark)
    warc.write(df, path)
    got = warc.read(spark, path, with_payload=True).collect()
    want = Counter()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in pages:
        h = h or ""
        n = len(h.encode())
        revisit = n >= 100 and h in first and i != first[h]
        want[i, n, hashlib.sha256(h.encode()).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None, h] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload.decode()) for r in got) == want
    warc.write(df.where("page_id = -5"), other := folder(spark))
    assert warc.read(spark, other).count() == 0


@pytest.mark.parametrize("damage", ["drop", "shorten"])
def test_warc_detects_damage(spark, monkeypatch, damage):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 300)
    records = list(warc.records_of(1, "u", b"q" * 1000, hashlib.sha256(b"q" * 1000).hexdigest(), None, ""))
    if damage == "drop":
        del records[1]
    else:
        records[-1] = records[-1].replace(b"Total-Length: 1", b"Total-Length: 2")
    path = folder(spark)
    spark.createDataFrame([(r.decode(),) for r in records], "value string").coalesce(1).write.option("lineSep", warc.GAP).text(path)
    with pytest.raises(Exception, match="segments are missing|bytes, not"):
        warc.read(spark, path).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 9), max_size=700))
def test_blocks_of_ids(ids):
    a = np.array(ids, np.uint32)
    index, payload = token_output.pack_ids(a)
    raw = np.frombuffer(payload, np.uint8)
    assert token_output.unpack_ids(index, raw)[: len(a)].tolist() == ids
    if len(ids) > 3:
        assert token_output.ids_at(index, raw, len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3 :][: len(ids) // 2]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aAé'sS <|>endoftext́ \n1Σ#", max_size=30), max_size=6))
def test_encoder_by_word(texts):
    import pyarrow as pa

    from voxtable.llm.kernel import text_arrays

    texts = [*texts, "<|endoftext|>x <|startoftext|>", "it's  'tis"]
    flat, lens = token_output.encoder(VOCABULARY, 2, True).block(*text_arrays(pa.array(texts)))
    library = Tokenizer.from_file(VOCABULARY)
    want = [x.ids + [2] for x in library.encode_batch(texts, add_special_tokens=False)]
    assert lens.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]


def test_tokenizers_that_keep_words_apart():
    assert token_output.Encoder(VOCABULARY).by_word and not token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json")).by_word
    import pyarrow as pa

    from voxtable.llm.kernel import text_arrays

    with pytest.raises(ValueError, match="by_word=False"):
        token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2, True).block(*text_arrays(pa.array(["one two three"])))


@pytest.mark.parametrize(("by_word", "segment", "files"), [(None, 1 << 20, 8), (False, 50, 8), (True, 50, 1)])
def test_token_files(spark, docs, rows, by_word, segment, files, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", segment)
    monkeypatch.setattr(token_output, "FILE_SEGMENTS", files)
    path = folder(spark)
    token_output.write(docs, path, VOCABULARY, by_word=by_word)
    got = token_output.read(spark, path, with_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter((r[0], *library.encode(r[1] or "", add_special_tokens=False).ids, 2) for r in rows)
    assert Counter((r.doc_id, *r.ids) for r in got) == want
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and got[0].doc_id is None
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()][:-1]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)


def test_token_files_of_nothing(spark, empty):
    path = folder(spark)
    token_output.write(empty, path, VOCABULARY)
    assert token_output.read(spark, path).count() == 0


def slow_best_fit(sizes, sources, clusters, capacity, most):
    bins, where = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fits = [(capacity - sum(x[0] for x in b) - n, k) for k, b in enumerate(bins) if sum(x[0] for x in b) + n <= capacity and (sum(x[0] for x in b) < capacity) and c not in {x[2] for x in b} and len({x[1] for x in b} | {s}) <= most]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([])
        bins[k].append((n, s, c))
        where.append(k)
    return where


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["a", "b", "c", None]), st.integers(0, 6)), max_size=40))
def test_best_fit(pieces):
    pieces.sort(key=lambda p: -p[0])
    sizes, sources, clusters = ([p[i] for p in pieces] for i in range(3))
    where, places = packing.best_fit(sizes, sources, clusters, 20, 2)
    assert where == slow_best_fit(sizes, sources, clusters, 20, 2)
    assert len(set(zip(where, places))) == len(pieces)


def test_packing(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 25)
    got = packing.pack(docs, capacity=50, most_sources=1).collect()
    lengths = Counter()
    for r in rows:
        n = len((r[1] or "").split())
        for k in range(max(1, -(-n // 50))):
            lengths[r[0], k, k * 50, min(50, n - 50 * k)] += 1
    assert Counter((r.doc_id, r.piece, r.first_word, r.n_words) for r in got) == lengths
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    assert len({r.bin.split("-")[0] for r in got}) > 1
    for b in bins.values():
        assert sum(r.n_words for r in b) <= 50 and len({r.source for r in b}) == 1 and len({r.cluster for r in b}) == len(b)
        assert sorted(r.place for r in b) == list(range(len(b)))
    assert packing.pack(empty).count() == 0


def test_packing_of_one_row_many_times(spark, monkeypatch):
    """Rows without an id and with one text are dealt to several groups; each bin still has a cluster once."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    docs = spark.createDataFrame([(None, "a b c", "s")] * 200 + [(k, f"t{k}", "s") for k in range(40)], "doc_id long, text string, source string").repartition(4)
    got = packing.pack(docs, capacity=12).collect()
    groups = Counter(r.bin.split("-")[0] for r in got)
    assert len(got) == 240 and max(groups.values()) < 80
    assert len({(r.bin, r.cluster) for r in got}) == 240


def test_packing_by_given_clusters(spark):
    rows = [(k, f"text {k}", "s", k // 3 if k < 9 else None) for k in range(20)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string, grp int"), capacity=100, cluster_col="grp").collect()
    bins = {r.doc_id: r.bin for r in got}
    assert all(len({bins[k] for k in range(c, c + 3)}) == 3 for c in (0, 3, 6)) and len(set(bins.values())) == 3
