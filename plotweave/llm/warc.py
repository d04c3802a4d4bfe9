"""WARC archives: written with segmented records and chunked transfer framing, and read back by reassembly.

Writing. A row becomes one logical record: an HTTP response whose body is sent in chunks. Of rows with equal payloads, of at
least a given size, the one with the largest id is the response and the others are revisits of it. A block that is
longer than a segment is cut into a first record and continuation records, which name the first one's id, count up, and end with the
total length. Tasks pack whole records into archives of bounded size and Spark's own writer puts them into the shared store,
so that a lost task's archives are written again and no half one stays.

Reading. Archives are parsed record by record by their declared lengths. Whole records are decoded at once; segments are grouped by the
origin's id (through the shuffle, so that they may lie in different archives), put in order, checked for gaps and against the
total length, and decoded. Digests and lengths are verified against what the headers declare.

Only digests are shuffled to find equal payloads: the rows that revisit others join the pages by id, by broadcast while they are few
(REVISITS), by a shuffled join beyond that.

Defined cases: a null payload is empty; a null id makes a response of its own that nothing revisits; repeated rows (equal ids and payloads)
are all written, and all are responses if theirs is the largest id; an empty table writes no archive and reads as no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import bytewords
from plotweave.llm.common import scratch, small_batches, store

#: Bytes of a segment, of an archive, and of a chunk of a body.
SEGMENT, ARCHIVE, CHUNK = 16_384, 8_000_000, 4_096
#: Revisits that are broadcast; more are joined through the shuffle.
REVISITS = 200_000
#: Ends of a line and of a record, and the characters of base32.
CRLF = b"\r\n"
RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_NONE = b"HTTP/1.1 304 Not Modified\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: five hexadecimal digits make four characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are allowed. A broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size without an end")
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def name_of(page: int | None) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(name: str | None) -> int | None:
    return int(name[10:-1].split(":")[0]) if name and name.startswith("<urn:page:") else None


def records_of(page: int | None, url: str | None, payload: bytes, refers: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of a row: one, or a first segment and its continuations."""
    name = name_of(page)
    fields = [("WARC-Record-ID", name), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "").split())), ("Content-Type", "application/http;msgtype=response")]
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()), ("X-Payload-Length", str(len(payload)))]
    if refers is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name_of(refers))]
        return [record("revisit", fields, HTTP_NONE)]
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        return [record("response", fields, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if page is not None:  # rows may repeat, but each one's segments have an origin of their own
        name = f"<urn:page:{page}:{uuid.uuid4().hex}>"
        fields[0] = ("WARC-Record-ID", name)
    out = [record("response", [*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        own = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {k}')}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        out.append(record("continuation", own + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts)), part))
    return out


def plain(archive: bytes) -> bytes:
    """The archive without its compression: gzip members one behind the other, or none."""
    if not archive.startswith(b"\x1f\x8b"):
        return archive
    out = []
    while archive:
        member = zlib.decompressobj(31)
        out.append(member.decompress(archive))
        if not member.eof:
            raise ValueError("gzip member without an end")
        archive = member.unused_data
    return b"".join(out)


def parse(archive: bytes):
    """(headers in lower case, block) of each record of an archive, plain or of gzip members."""
    archive, at = plain(archive), 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin, size = end + 4, int(head["content-length"])
        if archive[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where it declares")
        yield head, archive[begin : begin + size]
        at = begin + size + 4


def with_revisits(pages: DataFrame, *, page: str, html: str, least: int) -> DataFrame:
    """page, url-like columns and payload of each row, and refers: the id that a revisit refers to, else null."""
    rows = pages.withColumn("payload", F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary")))
    known = rows.filter(F.col(page).isNotNull() & (F.length("payload") >= least)).select(F.col(page).alias("page"), base32_sha1(F.col("payload")).alias("digest"))
    last = known.groupBy("digest").agg(F.max("page").alias("refers"), F.min("page").alias("low")).filter("low < refers").select("digest", "refers")
    revisits = store(known.join(last, "digest").filter("page < refers").select(F.col("page"), "digest", "refers").distinct(), "revisits")
    if revisits.limit(REVISITS + 1).count() <= REVISITS:
        revisits = F.broadcast(revisits)
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    return rows.withColumnRenamed(page, "page").join(revisits, ["page", "digest"], "left")


def write(pages: DataFrame, path: str, *, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0, segment: int = SEGMENT, archive: int = ARCHIVE) -> None:
    """Archives of all rows in a new folder."""
    rows = with_revisits(pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(html).alias("html")), page="page", html="html", least=least)

    def run(batches):
        held, size = [], 0
        for part in bytewords.blocks(batches, "payload", archive):
            for p, u, body, refers in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                for r in records_of(p, u, body, refers, segment):
                    if held and size + len(r) > archive:
                        yield _archives(held)
                        held, size = [], 0
                    held.append(r)
                    size += len(r) + 4
        if held:
            yield _archives(held)

    # a row is an archive but for its last end, which the writer adds; one row a file
    packed = rows.select("page", "url", "payload", "refers").mapInArrow(run, "archive binary")
    with small_batches(pages.sparkSession):
        packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", 1).text(path)


def _archives(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join(held)], pa.binary())], ["archive"])


def _decoded(head: dict, block: bytes) -> bytes:
    """The payload of a whole block, verified."""
    top, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in top.lower() else body
    declared = head.get("warc-payload-digest", "")
    if declared.startswith("sha1:") and declared[5:] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"payload digest of {head.get('warc-record-id')} doesn't match")
    return payload


SEGMENTS = "origin string, number long, total long, page long, url string, type string, digest string, bytes long, refers long, head string, block binary, payload binary"


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload of each logical record.

    A revisit has no payload, but its declared length and digest. Without payloads, that column is null and nothing but segments is shuffled.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse(content.as_py()):
                    number, kind = int(head.get("warc-segment-number", 0)), head["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    name = head.get("warc-segment-origin-id") or head.get("warc-record-id")
                    row = [name, number, int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None]
                    if kind == "continuation":
                        rows.append((*row, None, None, None, None, None, None, None, block, None))
                        continue
                    row += [page_of(name), head.get("warc-target-uri"), kind]
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "revisit":
                        rows.append((*row, digest, int(head.get("x-payload-length", 0)), page_of(head.get("warc-refers-to")), None, None, None))
                    elif number:
                        rows.append((*row, digest, None, None, head.get("warc-payload-digest"), block, None))
                    else:
                        payload = _decoded(head, block)
                        rows.append((*row, digest, len(payload), None, None, None, payload if payloads else None))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
                names = [c.split()[0] for c in SEGMENTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def join(batches):
        for batch in batches:
            d = batch.to_pydict()
            sizes, digests, bodies = [], [], []
            for origin, parts, total, head in zip(d["origin"], d["parts"], d["total"], d["head"], strict=True):
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError(f"segments of {origin} have a gap or are repeated")
                block = b"".join(p["block"] for p in parts)
                if len(block) != total:
                    raise ValueError(f"segments of {origin} have {len(block)} bytes, not {total}")
                body = _decoded({"warc-payload-digest": head or "", "warc-record-id": origin}, block)
                sizes.append(len(body))
                digests.append(base64.b32encode(hashlib.sha1(body).digest()).decode())
                bodies.append(body if payloads else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), batch.column(4), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(bodies, pa.binary())], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "payload"]
            )

    # parsed twice, but each archive is small and neither side keeps what the other needs
    parsed = files.mapInArrow(run, SEGMENTS)
    whole = parsed.filter("number = 0").select(F.col("page").alias("page_id"), "url", F.col("type").alias("record_type"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("refers").alias("refers_to"), "payload")
    cut = (
        parsed.filter("number > 0").groupBy("origin")
        .agg(F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("page").alias("page"), F.max("url").alias("url"), F.max("type").alias("type"), F.max("total").alias("total"), F.max("head").alias("head"))
        .select("origin", "parts", "page", "url", "type", "total", "head").mapInArrow(join, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, payload binary")
        .select("page_id", "url", "record_type", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"), "payload")
    )
    return whole.union(cut)


def digest(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
