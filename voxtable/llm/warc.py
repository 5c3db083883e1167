"""WARC archives with segmented records and chunked payloads (operator 4).

Writing: each page is a ``response`` record whose HTTP message has the page's UTF-8 bytes in chunked transfer framing. A
message over ``SEGMENT_BYTES`` is cut: the first part stays in the response, the others are ``continuation`` records with
the origin's id and a segment number, the last with the total length. Of pages with equal payloads of at least
``LEAST_REVISIT`` bytes the one with the smallest id is the response, the others are ``revisit`` records without payload.
Spark's text writer writes the records (its separator is the blank lines that end a record), so archives go wherever
Spark can write; ``RECORDS_PER_FILE`` bounds a file.

Reading: files are parsed record by record. Whole records are decoded on the spot; parts of cut ones are grouped by their
origin, ordered by segment number, checked for gaps and against the total length, and then decoded. Payloads only move
where a record was cut, and never for the search for equal payloads, which compares digests.

Defined results: a null html is an empty payload, a very long one is cut into as many segments as it needs; every row of
an id that occurs more than once has a record id of its own (a suffix), whatever its payload; rows with the same id and
payload are all responses, or all revisits of a smaller id; ties can't occur otherwise; a null id never is a response that others refer to, unless all equal payloads have null ids; a null url
has no header; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.kernel import lean
from voxtable.llm.shared import folder, stash, table

LEAST_REVISIT = 100
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 4 << 10
RECORDS_PER_FILE = 2048
CRLF = b"\r\n"
GAP = "\r\n\r\n"
PAGE = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        piece = payload[at : at + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(parts)
        parts.append(body[at : at + n])
        at += n + 2
        if body[at - 2 : at] != CRLF or len(parts[-1]) != n:
            raise ValueError("a chunk doesn't have the length it states")


def payload_of(message: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = message.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(block: bytes, **fields: object) -> bytes:
    lines = ["WARC/1.1", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, suffix: str) -> Iterator[bytes]:
    """The records of a page, without the blank lines at their ends."""
    own = f"<{PAGE}{'' if page_id is None else page_id}{suffix}>"
    common = {
        "WARC_Record_ID": own, "WARC_Date": "1970-01-01T00:00:00Z", "WARC_Target_URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC_Payload_Digest": f"sha256:{digest}", "Content_Type": "application/http;msgtype=response",
    }
    if refers_to is not None:
        yield record(HTTP, WARC_Type="revisit", WARC_Profile=PROFILE, WARC_Refers_To=f"<{PAGE}{refers_to}>", **common)
        return
    message = HTTP + chunked(payload)
    if len(message) <= SEGMENT_BYTES:
        yield record(message, WARC_Type="response", **common)
        return
    yield record(message[:SEGMENT_BYTES], WARC_Type="response", WARC_Segment_Number=1, **common)
    for number, at in enumerate(range(SEGMENT_BYTES, len(message), SEGMENT_BYTES), 2):
        last = at + SEGMENT_BYTES >= len(message)
        yield record(
            message[at : at + SEGMENT_BYTES], WARC_Type="continuation", WARC_Record_ID=f"{own[:-1]}:part{number}>", WARC_Date="1970-01-01T00:00:00Z",
            WARC_Segment_Origin_ID=own, WARC_Segment_Number=number, WARC_Segment_Total_Length=len(message) if last else None,
        )


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    at, gap = 0, GAP.encode()
    while at < len(content):
        end = content.index(gap, at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no record starts at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        if content[at : at + 4] != gap:
            raise ValueError(f"a record doesn't end at byte {at}")
        yield fields, content[start:at]
        at += 4


def page_of(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(PAGE).split(":")[0]
    return int(number) if number else None


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes an archive of all pages below ``path``."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    each = stash(rows.select("page_id", "digest", F.octet_length("html").alias("n")))
    first = each.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1")
    revisits = each.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", F.col("first").alias("refers_to"))
    # a count for each id, with partial sums; few ids are left, and of those each payload once
    several = each.where("page_id is not null").groupBy("page_id").count().where("count > 1").select("page_id")
    repeated = each.join(several, "page_id").select("page_id", "digest", F.lit(True).alias("repeated")).distinct()
    # only what needs a remark is joined to the pages: its written size lets Spark choose to broadcast it or not
    notes = revisits.distinct().withColumn("repeated", F.lit(False)).unionByName(repeated.withColumn("refers_to", F.lit(None).cast("long")))
    notes = stash(notes.groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"), F.max("repeated").alias("repeated"))).alias("n")
    rows = rows.alias("r")
    noted = rows.join(notes, F.col("r.page_id").eqNullSafe(F.col("n.page_id")) & (F.col("r.digest") == F.col("n.digest")), "left").select(
        "r.page_id", "r.url", "r.html", "r.digest", "n.refers_to", F.when(F.col("n.repeated") | F.col("r.page_id").isNull(), F.monotonically_increasing_id()).alias("mark")
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                page, url, html, digest, refers_to, mark = (x.to_pylist() for x in batch.slice(a, 512).columns)
                found = [r for k in range(len(page)) for r in records_of(page[k], url[k], html[k].encode(), digest[k], refers_to[k], "" if mark[k] is None else f":row{mark[k]}")]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["record"])

    noted.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.options(lineSep=GAP, maxRecordsPerFile=RECORDS_PER_FILE).text(path)


PART = "page_id long, origin string, type string, refers_to long, digest string, number int, total long, part binary, payload_bytes long, payload_digest string"
ARROW = pa.schema([("page_id", pa.int64()), ("origin", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("part", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def checked(payload: bytes, stated: str | None) -> tuple[int, str]:
    digest = hashlib.sha256(payload).hexdigest()
    if stated is not None and stated != digest:
        raise ValueError(f"a payload's digest is {digest}, its record states {stated}")
    return len(payload), digest


def read(spark, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each response or revisit; ``payload`` on demand."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    extra = ", payload binary" if with_payload else ""
    schema = ARROW.append(pa.field("payload", pa.binary())) if with_payload else ARROW

    def rows(content: bytes) -> Iterator[tuple]:
        for fields, block in parse(content):
            kind, number = fields["warc-type"], fields.get("warc-segment-number")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
            own = fields["warc-record-id"]
            if kind == "revisit":
                yield page_of(own), own, kind, page_of(fields["warc-refers-to"]), digest, None, None, None, None, digest, None
            elif number is None:
                payload = payload_of(block)
                yield page_of(own), own, kind, None, digest, None, None, None, *checked(payload, digest), payload if with_payload else None
            else:
                total = fields.get("warc-segment-total-length")
                first = kind == "response"
                yield page_of(own) if first else None, own if first else fields["warc-segment-origin-id"], kind, None, digest, int(number), None if total is None else int(total), block, None, None, None

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in rows(content.as_py()):
                    held.append(row[: len(schema)])
                    size += 200 + len(row[7] or b"") + len(row[10] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    parts = stash(files.mapInArrow(run, PART + extra))
    cut = parts.where("number is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "part"))).alias("parts")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, digest, total, pieces in zip(*(batch.column(c) for c in ("page_id", "digest", "total", "parts")), strict=True):
                pieces = pieces.as_py()
                if [p["number"] for p in pieces] != list(range(1, len(pieces) + 1)):
                    raise ValueError(f"page {page.as_py()}: segments are missing or doubled")
                message = b"".join(p["part"] for p in pieces)
                if len(message) != total.as_py():
                    raise ValueError(f"page {page.as_py()}: {len(message)} bytes, not {total.as_py()}")
                payload = payload_of(message)
                n, found = checked(payload, digest.as_py())
                columns = [pa.array([page.as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([found])] + [pa.array([payload], pa.binary())] * with_payload
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "payload"][: len(columns)])

    keep = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    joined = cut.select("page_id", "digest", "total", "parts").mapInArrow(join, "page_id long, payload_bytes long, payload_digest string" + extra)
    joined = joined.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(keep)
    responses = parts.where("number is null and type = 'response'").withColumn("record_type", F.col("type")).select(keep).unionByName(joined)
    # a revisit has the payload of the response that it refers to
    there = responses.select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "payload_bytes", *["payload"] * with_payload)
    there = there.join(parts.where("type = 'revisit'").select(F.col("refers_to").alias("__page")).distinct(), "__page", "left_semi").dropDuplicates(["__page", "__digest"])
    revisits = parts.where("type = 'revisit'").select("page_id", "refers_to", "payload_digest", F.col("type").alias("record_type"))
    revisits = revisits.join(there, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left").select(keep)
    return responses.unionByName(revisits)


def query(spark, sf_dir: str) -> DataFrame:
    path = folder(spark)
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM f
"""
