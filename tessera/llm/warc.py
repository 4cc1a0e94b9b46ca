"""WARC archives: a writer and a splittable reader.

Writing. Every record is a gzip member of its own, made by the tasks that hold the rows, and Spark's text writer
puts members into files as raw bytes (its commit protocol makes retried and speculative tasks safe). The writer's
line separator is the empty gzip member, so files are plain multi-member gzip. Payloads of equal SHA-1 and length
of at least `REVISIT_BYTES` are stored once: the record with the largest page_id is a response, the others are
revisit records that name it.

Reading. Files are cut into byte ranges. A task scans its range for the gzip magic, validates a candidate by
decoding the start of the member (its header must be that of a WARC record), and owns the records whose member
starts inside its range, following the last one past the range's end. No index and no whole file is needed, so a
large archive is read by many tasks. Bytes between members (padding, other members) are passed over.

Files are read through Arrow's file systems (local, hdfs, s3, gs, ...), opened by each task on its own.

Defined results: null payloads are empty. A null page_id is written as such, comes before all others when the
largest is sought, and refers_to may then be null too. Rows that share page_id and payload are one response and
revisits of it. An empty table gives no record. A record with a broken member raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as H

REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
SMALL_GROUPS = 500_000  # up to so many groups of equal payloads are broadcast (some 60 bytes each)
MAGIC = b"\x1f\x8b\x08"
LEVEL = 4
READ = 1 << 20


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = _gzip(b"")


def record(url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: str | None, is_revisit: bool) -> bytes:
    """A WARC/1.1 record, not compressed. refers_to: the response's page_id as text."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches):
    for batch in batches:
        out = []
        html = batch.column(batch.schema.get_field_index("html")).cast(pa.large_binary())
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "is_revisit")]
        for raw, page_id, url, digest, refers_to, again in zip(html, *cols, strict=True):
            out.append(_gzip(record(url, page_id, raw.as_py() or b"", digest, refers_to, again)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str) -> None:
    """Write the archives of pages (page_id, url, html) under path."""
    rows = H.in_small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    # The largest page_id of a payload, and how many rows hold it.
    groups = rows.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("same")).filter("same > 1")
    groups = H.settle(groups.select(F.col("digest").alias("digest_"), "owner"), "warc-groups")
    small = groups.count() <= SMALL_GROUPS
    joined = rows.join(F.broadcast(groups) if small else groups, (F.col("digest") == F.col("digest_")) & (F.col("n") >= REVISIT_BYTES), "left")
    is_owner = F.col("page_id").eqNullSafe(F.col("owner"))
    # Of rows that share the owner's page_id one is the response; such ids are looked for first, as they are rare.
    twins = rows.join(groups, (F.col("digest") == F.col("digest_")) & is_owner, "inner").groupBy("digest", "page_id").count().filter("count > 1")
    if not twins.isEmpty():
        joined = joined.withColumn("place", F.when(F.col("digest_").isNotNull() & is_owner, F.row_number().over(_one(is_owner))))
        is_owner = is_owner & (F.coalesce("place", F.lit(1)) == 1)
    again = F.col("digest_").isNotNull() & ~is_owner
    text = F.when(again, F.coalesce(F.col("owner").cast("string"), F.lit("null")))
    ready = joined.select("page_id", "url", "html", "digest", text.alias("refers_to"), again.alias("is_revisit"))
    # Bytes pass through the text writer as they are; the separator ends each record with an empty member.
    members = ready.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.format("text").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).save(path)


def _one(is_owner):
    from pyspark.sql import Window

    # Rows that aren't owners are dealt out by their id, so no group of copies meets in one task.
    return Window.partitionBy("digest", is_owner, F.when(~is_owner, F.coalesce("page_id", F.lit(0)))).orderBy(F.col("url"))


# ---------------------------------------------------------------- reader


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class _Range:
    """Reads a file forwards from a position, keeping only what is still needed."""

    def __init__(self, f, at: int):
        self.f, self.base, self.size = f, at, f.size()
        self.buf = b""
        f.seek(at)

    def fill(self, upto: int) -> bool:
        """Hold bytes up to the position; false at the end of the file."""
        while self.base + len(self.buf) < upto:
            more = self.f.read(READ)
            if not more:
                return False
            self.buf += more
        return True

    def drop(self, to: int) -> None:
        self.buf = self.buf[max(0, to - self.base) :]
        self.base = to


def members(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(position, content) of the WARC members that start in [start, stop)."""
    r = _Range(f, start)
    at = start
    while at < stop:
        r.fill(min(r.size, at + READ))
        i = r.buf.find(MAGIC, at - r.base)
        if i < 0:
            held = r.base + len(r.buf)
            if held >= r.size:
                return
            at = held - len(MAGIC) + 1
            r.drop(at)
            r.fill(min(r.size, at + READ))
            continue
        at = r.base + i
        if at >= stop:
            return
        r.drop(at)
        content, end = _member(r, at)
        if content is None:
            at += 1
            continue
        if content:
            yield at, content
        at = end
        r.drop(at)


def _member(r: _Range, at: int) -> tuple[bytes | None, int]:
    """Content and end of the member at a position; None where there is none. b'' for a member that is no record."""
    z = zlib.decompressobj(31)
    out, pos, step = [], at, 512
    n = 0
    while not z.eof:
        r.fill(min(r.size, pos + step))
        piece = r.buf[pos - r.base : pos - r.base + step]
        if not piece:
            if n >= 5:
                raise ValueError(f"a record's member at byte {at} is cut off")
            return None, at
        try:
            got = z.decompress(piece)
        except zlib.error as e:
            if n >= 5:  # it began as a record
                raise ValueError(f"a record's member at byte {at} is broken: {e}") from e
            return None, at
        pos += len(piece)
        if got:
            out.append(got)
            before, n = n, n + len(got)
            if before < 5 <= n and not b"".join(out).startswith(b"WARC/"):
                return None, at  # a member of something else, or bytes that only look like one
        step = READ
    end = pos - len(z.unused_data)
    content = b"".join(out)
    return (content if content.startswith(b"WARC/") else b""), end


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


_FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, path string, position long"


def _id(urn: str | None) -> int | None:
    tail = (urn or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def _reader(with_payload: bool):
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for s in batch.to_pylist():
                rows, held = [], 0
                with _open(s["path"]) as f:
                    for at, content in members(f, s["start"], s["stop"]):
                        fields, block = parse(content)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        if kind == "response":
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            if fields.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                                raise ValueError(f"payload digest differs in {s['path']} at byte {at}")
                        else:  # what the record says of the payload that it doesn't hold
                            sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            n, digest = int(sizes[0]), fields["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((_id(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, n, digest, _id(fields.get("warc-refers-to")) if kind == "revisit" else None, payload if with_payload and kind == "response" else None, s["path"], at))
                        held += len(payload) if with_payload else 200
                        if held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of all archives under path, one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    splits = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.select("path", "start", F.least("length", F.col("start") + split_bytes).alias("stop"))
    n = splits.count()
    dealt = splits.repartition(max(1, min(n, 100_000)), "path", "start")
    return dealt.mapInArrow(_reader(payload), _FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = H.new_path(spark, "warc")
    write(pages, path)
    H.drop_at_exit(spark, path)
    H.release()
    return read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
