"""WARC archives: one gzip member a record, written by Spark and read sequentially.

``plan`` decides what is stored: of rows with equal payloads of at least ``least``
bytes, the one with the largest page_id is a response record with the payload, the others
are revisit records that name it.  ``write`` makes each record a gzip member in a Python
worker and hands the bytes to Spark's text writer, whose line separator is the zero byte
in which a member's length field ends (under 16 MB; a longer member is followed by a
zero byte as padding, which gzip readers skip).  So files are plain concatenations of
members, committed and retried as Spark does.  ``read`` goes through each file from
member to member: 64 KiB at a time through zlib, the header lines first, then as many
bytes as Content-Length says, hashed as they pass, then the two line ends, then the
member's end.  Only a payload that is asked for is kept.  ``resolve`` gives revisit
records the length of the response that they name.

A null payload is empty.  Rows without a page_id come after all that have one, and aren't
told apart from each other; rows that tie for the largest page_id of their payload
(repeated rows) are all responses, and the revisits name the one with the largest url.
Nulls, line ends and other control characters of a url are percent-encoded in its header.
A record whose framing, member or digest is wrong comes out with ``problem`` set; reading
goes on at the next member.  Other columns are ignored, whatever their names; an
empty table makes an archive without records, which reads as no rows.

A reading task holds one file's compressed bytes (``RECORDS`` records at most) and, if asked
for, one batch of payloads.  A file or a payload must be under 2 GB, as rows of Spark are.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import hot_keys, salted_join, save, shared_dir, unique

RECORDS = 5_000
SLICE = 1 << 16
#: Bytes of payloads or rows that a reader hands on at a time.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1_000
HEADER_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "archive string, offset long, record_id string, record_type string, page_id long, target_uri string, content_length long, payload_bytes long, payload_digest string, refers_to_record string, problem string, payload binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A URN that the row decides, so a repeated task writes the same record."""
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest))
    cut = [F.substring(h, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plan(pages: DataFrame, least: int = 0, payload: str = "html") -> DataFrame:
    """(page_id, url, body, digest, record_id, refers_to): what to write; refers_to names
    the response of a revisit record.  Payloads meet by length and SHA-1.  Only digests
    are grouped, with partial sums; a payload that very many rows share is dealt in parts."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body")).withColumn("digest", F.sha1("body"))
    rows = rows.withColumn("own", record_id(F.col("page_id"), F.col("url"), F.col("digest"))).withColumn("key", F.concat_ws("-", "digest", F.length("body")))
    group = rows.where(F.length("body") >= least).groupBy("key").agg(F.count("*").alias("c"), F.max(F.struct("page_id", "url", "own")).alias("owner"))
    group = save(group.where("c > 1 and owner.page_id is not null"), "warc-groups")  # a null is less than any
    hot = hot_keys(group.select("key", "c"), "key", pages.count())
    joined = salted_join(rows, group.drop("c"), "key", hot, F.struct("page_id", "url"), "left")
    revisits = F.col("owner").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("owner.page_id")))
    refers = F.when(revisits, F.col("owner"))
    return joined.select("page_id", "url", "body", "digest", F.col("own").alias("record_id"), refers["own"].alias("refers_to"), refers["url"].alias("refers_to_uri"))


def _uri(url: str) -> bytes:
    return b"".join(b"%%%02X" % b if b <= 32 or b == 127 else bytes([b]) for b in url.encode("utf-8", "surrogatepass"))


def member(page_id: int | None, url: str | None, body: bytes, digest: str, own: str, refers_to: str | None, refers_to_uri: str | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if refers_to else http + body
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to else b"response"), b"WARC-Record-ID: " + own.encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _uri(url))
    if page_id is not None:
        lines.append(b"X-Page-ID: %d" % page_id)
    if refers_to:
        lines += [b"WARC-Profile: " + REVISIT.encode(), b"WARC-Refers-To: " + refers_to.encode()]
        if refers_to_uri is not None:
            lines.append(b"WARC-Refers-To-Target-URI: " + _uri(refers_to_uri))
    lines += [b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha1:" + base32(bytes.fromhex(digest)).encode(), b"WARC-Block-Digest: sha1:" + base32(hashlib.sha1(block).digest()).encode(), b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def write(planned: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives below ``path``, of at most RECORDS records each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole = member(row["page_id"], row["url"], row["body"], row["digest"], row["record_id"], row["refers_to"], row["refers_to_uri"], date)
                yield pa.RecordBatch.from_arrays([pa.array([whole[:-1] if whole.endswith(b"\0") else whole], pa.binary())], ["member"])

    spark = planned.sparkSession
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": "200", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        members = planned.mapInArrow(pack, "member binary").select(F.col("member").cast("string").alias("value"))
        members.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS).text(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Damaged(Exception):
    pass


class _Member:
    """The bytes of one gzip member, taken from ``data`` a slice at a time."""

    def __init__(self, data: memoryview, at: int) -> None:
        self.data, self.at, self.unpack, self.held = data, at, zlib.decompressobj(31), b""

    def some(self) -> bytes:
        """The next bytes; empty at the member's end."""
        while not self.held and not self.unpack.eof:
            pending = self.unpack.unconsumed_tail
            if not pending:
                pending = bytes(self.data[self.at : self.at + SLICE])
                self.at += len(pending)
                if not pending:
                    raise Damaged("member cut short")
            try:
                self.held = self.unpack.decompress(pending, SLICE)
            except zlib.error as wrong:
                raise Damaged(f"member damaged: {wrong}") from None
        out, self.held = self.held, b""
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            part = self.some()
            if not part:
                raise Damaged("record shorter than Content-Length")
            self.held, part = part[n:], part[:n]
            n -= len(part)
            yield part

    def upto(self, mark: bytes) -> bytes:
        """The bytes before ``mark``, which is taken too."""
        got = bytearray()
        while (end := got.find(mark)) < 0:
            part = self.some()
            if not part or len(got) > HEADER_BYTES:
                raise Damaged("header lines don't end")
            got += part
        self.held = bytes(got[end + len(mark) :]) + self.held
        return bytes(got[:end])

    def end(self) -> int:
        """Where the next member starts; padding is skipped."""
        if self.some():
            raise Damaged("bytes after the record")
        at = self.at - len(self.unpack.unused_data)
        while at < len(self.data) and self.data[at] == 0:
            at += 1
        return at


def _fields(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, _, value = line.partition(b":")
        out.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return out


def _one(m: _Member, row: dict, keep: bool) -> int:
    """Reads one record into ``row``; where the next starts."""
    version, _, lines = m.upto(b"\r\n\r\n").partition(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise Damaged("no WARC version line")
    fields = _fields(lines)
    number = fields.get("x-page-id", "")
    row |= {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to_record": fields.get("warc-refers-to"), "page_id": int(number) if number.lstrip("-").isdigit() else None}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no Content-Length")
    row["content_length"] = int(length)
    is_http, head = fields.get("content-type", "").startswith("application/http"), b""
    block, payload, kept, size = hashlib.sha1(), hashlib.sha1(), [], 0
    for part in m.take(int(length)):
        block.update(part)
        if is_http:  # the payload follows the empty line
            head += part
            if (cut := head.find(b"\r\n\r\n")) < 0:
                if len(head) > HEADER_BYTES:
                    raise Damaged("HTTP header lines don't end")
                continue
            part, is_http, head = head[cut + 4 :], False, b""
        payload.update(part)
        size += len(part)
        if keep:
            kept.append(part)
    if b"".join(m.take(4)) != b"\r\n\r\n":
        raise Damaged("record doesn't end in two line ends")
    at = m.end()
    stated = {k: fields[k].partition(":")[2].upper() for k in ("warc-block-digest", "warc-payload-digest") if fields.get(k, "").lower().startswith("sha1:")}
    if stated.get("warc-block-digest", found := base32(block.digest())) != found:
        row["problem"] = "block digest differs"
    if row["record_type"] == "revisit":
        row["payload_digest"] = stated.get("warc-payload-digest")
    else:
        row |= {"payload_bytes": size, "payload_digest": base32(payload.digest()), "payload": b"".join(kept) if keep else None}
        if stated.get("warc-payload-digest", row["payload_digest"]) != row["payload_digest"]:
            row["problem"] = "payload digest differs"
    return at


def records(archive: str, content: bytes, keep: bool = False) -> Iterator[dict]:
    """The records of one archive, in order."""
    data, at = memoryview(content), 0
    while at < len(data):
        row: dict = dict.fromkeys(x.split()[0] for x in RECORD.split(", ")) | {"archive": archive, "offset": at}
        try:
            at = _one(_Member(data, at), row, keep)
        except Damaged as wrong:
            row["problem"] = str(wrong)
            found = content.find(MAGIC, at + 1)
            at = len(data) if found < 0 else found
        yield row


def read(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """RECORD rows of the archives below ``path``; ``payload`` is null unless ``keep``.
    Write it by save(): that hands files to the workers one or a few at a time."""
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for row in records(batch.column("path")[i].as_py(), batch.column("content")[i].as_py(), keep):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(unpack, RECORD)


def resolve(found: DataFrame) -> DataFrame:
    """``found`` with refers_to (page_id of the response) and, for revisit records,
    the response's payload_bytes; ``problem`` is set where the response is missing
    or has another digest.  A response that very many records name is dealt in parts."""
    name = unique("ref")
    responses = found.where("record_type = 'response'").groupBy(F.col("record_id").alias(name)).agg(F.first(F.struct("page_id", "payload_bytes", "payload_digest")).alias("target"))
    named = found.withColumn(name, F.col("refers_to_record"))
    counts = named.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("c"))
    rest, asks = named.where(F.col(name).isNull()), named.where(F.col(name).isNotNull())
    hot = hot_keys(counts, name, found.count())
    joined = salted_join(asks, responses, name, hot, F.col("record_id"), "left")
    wrong = F.when(F.col("target").isNull(), "response missing").when(~F.col("target.payload_digest").eqNullSafe(F.col("payload_digest")), "response has another digest")
    joined = joined.withColumn("problem", F.coalesce("problem", wrong)).withColumn("payload_bytes", F.col("target.payload_bytes")).withColumn("refers_to", F.col("target.page_id"))
    return rest.withColumn("refers_to", F.lit(None).cast("long")).drop(name).unionByName(joined.drop(name, "target"))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages as archives in the shared folder, reads them back and resolves
    the revisit records."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/gleaner/warc-{uuid.uuid4().hex}"
    write(plan(pages, least), path)
    return resolve(save(read(spark, path), "warc-records"))
