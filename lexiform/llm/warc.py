"""WARC archives as a chunked record table.

A record's bytes are stored as rows (record_id, instance, chunk_no, data, running): slices of at most ``CHUNK`` bytes
and the SHA-1 of the record up to the slice's end; instance tells records apart that share an identifier. Joined by chunk number, a record's slices are a
standard WARC/1.1 record, so ``data`` in order is a WARC file. Readers and writers stream: a reader holds one
slice and a digest in progress, however large the payload is, and can tell which slice is damaged.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import batch, bound_batches, buffers, join_hot, materialise, parts, text_of

CHUNK = 64 << 10
#: Header blocks are read whole; a longer one is an error.
LONGEST_HEADER = 1 << 20
URN = "urn:x-page:"
TABLE = pa.schema([("record_id", pa.string()), ("instance", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("running", pa.binary())])
READ = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(record_id: str, uri: str | None, payload: memoryview, digest: bytes, refers_to: str | None, date: str) -> Iterator[bytes | memoryview]:
    """The parts of a record: a response with its payload, or a revisit that names its response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base32(digest)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    size = len(http) + (0 if refers_to is not None else len(payload))
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}", "", ""]
    yield "\r\n".join(head).encode()
    yield http
    if refers_to is None:
        for at in range(0, len(payload), CHUNK):
            yield payload[at : at + CHUNK]
    yield b"\r\n\r\n"


def chunks(parts_: Iterable[bytes | memoryview], size: int = CHUNK) -> Iterator[tuple[int, bool, bytes, bytes]]:
    """(chunk_no, last, data, running digest) of the joined parts; holds one slice."""
    held, n, digest = bytearray(), 0, hashlib.sha1()
    for p in parts_:
        held += p
        while len(held) > size:
            data = bytes(held[:size])
            del held[:size]
            digest.update(data)
            yield n, False, data, digest.digest()
            n += 1
    digest.update(held)
    yield n, True, bytes(held), digest.digest()


class Reader:
    """Reads one record from its slices in order."""

    def __init__(self) -> None:
        self.held, self.head, self.http = bytearray(), None, None
        self.left = self.payload = 0
        self.sha, self.end = hashlib.sha1(), 0

    def feed(self, data: bytes) -> bytes:
        """Takes a slice; returns what lies behind the record's end."""
        self.held += data
        if self.head is None:
            self.head = self._block()
            if self.head is None:
                return b""
            self.left = int(self.head.get("content-length", 0))
        if self.http is None and self.left and self.head.get("content-type", "").startswith("application/http"):
            before = len(self.held)
            self.http = self._block()
            if self.http is None:
                if before >= self.left:
                    raise ValueError("no HTTP header in the record")
                return b""
            self.left -= before - len(self.held)
        body = bytes(self.held[: self.left])
        self.sha.update(body)
        self.payload += len(body)
        self.left -= len(body)
        del self.held[: len(body)]
        if self.left:
            return b""
        end = bytes(self.held[: 4 - self.end])
        self.end += len(end)
        if end != b"\r\n\r\n"[self.end - len(end) : self.end]:
            raise ValueError("a record must end with two line ends")
        rest = bytes(self.held[len(end) :])
        self.held.clear()
        return rest

    def _block(self) -> dict | None:
        end = self.held.find(b"\r\n\r\n")
        if end < 0:
            if len(self.held) > LONGEST_HEADER:
                raise ValueError("header block too long")
            return None
        lines = bytes(self.held[:end]).decode("utf-8", "replace").split("\r\n")
        del self.held[: end + 4]
        out = {"": lines[0]}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    @property
    def done(self) -> bool:
        return self.head is not None and not self.left and self.end == 4

    def result(self, intact: bool = True) -> tuple:
        head, stated = self.head or {}, (self.head or {}).get("warc-payload-digest", "").partition(":")[2]
        kind = head.get("warc-type")
        if kind == "revisit":
            size, digest = int((self.http or {}).get("content-length", 0)), stated
        else:
            size, digest = self.payload, base32(self.sha.digest())
            intact &= stated in ("", digest)
        ref = head.get("warc-refers-to")
        return head.get("warc-record-id", "").strip("<>"), kind, head.get("warc-target-uri"), ref.strip("<>") if ref else None, size, digest, bool(intact and self.done)


def read_stream(slices: Iterable[bytes]) -> Iterator[tuple]:
    """Records of a whole WARC file given as slices of any size."""
    reader = Reader()
    for data in slices:
        while data:
            data = reader.feed(data)
            if reader.done:
                yield reader.result()
                reader = Reader()


def _write(size: int, date: str):
    def run(batches):
        rows, held = [], 0
        for b in batches:
            # A payload is a view of the batch, cut into slices; nothing holds a copy of a whole one.
            raw, offs = buffers(b.column(3))
            small = (b.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
            for k, (name, instance, uri, digest, ref) in enumerate(zip(*small, strict=True)):
                payload = raw[offs[k] : offs[k + 1]]
                for n, last, data, running in chunks(record(name, uri, payload, digest, ref, date), size):
                    rows.append((name, instance, n, last, data, running))
                    held += len(data)
                    if held >= 8 << 20:
                        yield batch(TABLE, [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TABLE, strict=True)])
                        rows, held = [], 0
        if rows:
            yield batch(TABLE, [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TABLE, strict=True)])

    return run


class _Record:
    """A record of the table while its slices come, which can be lost, damaged or there twice."""

    def __init__(self, name: str) -> None:
        self.name, self.reader, self.sha = name, Reader(), hashlib.sha1()
        self.next, self.intact, self.reading, self.ended = 0, True, True, False

    def feed(self, n: int, last: bool, data: bytes, running: bytes) -> None:
        if n < self.next or self.ended:  # a slice more than once
            self.intact = False
            return
        self.reading &= n == self.next
        self.next, self.ended = n + 1, bool(last)
        self.sha.update(data)
        self.reading &= self.sha.digest() == running
        # Behind the first gap or damage the bytes mean nothing; what was read before them is told.
        if self.reading:
            try:
                self.reader.feed(data)
            except ValueError:
                self.reading = False
        self.intact &= self.reading

    def result(self) -> tuple:
        out = self.reader.result(self.intact and self.ended)
        if self.reader.head is None:
            return self.name, None, None, None, None, None, False
        return out[0] or self.name, *out[1:]


def _read(batches):
    """Streams over slices sorted by record, instance and number: one row per record, whatever is lost of it."""
    key, held = None, None

    def out(done):
        return batch(READ, [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), READ, strict=True)])

    for b in batches:
        done = []
        for name, instance, n, last, data, running in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (name, instance) != key:
                if held:
                    done.append(held.result())
                key, held = (name, instance), _Record(name)
            held.feed(n, last, data, running)
        if done:
            yield out(done)
    if held:
        yield out([held.result()])


def write_table(pages: DataFrame, id_col: str = "page_id", uri_col: str | None = "url", body_col: str = "html", least: int = 0, size: int = CHUNK, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """The chunked record table of ``pages``: a record per row, payload the body in UTF-8 (null: empty).

    Of records with equal payloads of ``least`` bytes or more, the one with the largest id is a response
    and the others are revisits of it; smaller payloads are all responses. A null id is smaller than any
    other. Rows that share id and payload get the same kind of record. A null payload is empty; one of any length goes through
    in slices. An empty table gives no rows; further columns are ignored. The table is lazy, ids and digests are written first.
    """
    bound_batches(pages.sparkSession)
    body = text_of(body_col).cast("binary")
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    slim = materialise(rows.filter(F.octet_length("payload") >= least).select("id", "digest"), "digests")
    winners = materialise(slim.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "winners")
    # Only losers are marked; they meet their rows by id, so that equal payloads don't meet in one task.
    losers = join_hot(slim, winners, "digest").filter(~F.col("id").eqNullSafe(F.col("winner"))).select(F.col("id").alias("lid"), F.col("digest").alias("ldigest"), "winner").distinct()
    rows = rows.join(losers, F.col("id").eqNullSafe(F.col("lid")) & (F.col("digest") == F.col("ldigest")), "left")
    urn = lambda c: F.concat(F.lit(URN), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = rows.select(urn("id").alias("name"), F.monotonically_increasing_id().alias("instance"), "uri", "payload", "digest", F.when(F.col("lid").isNotNull() | F.col("ldigest").isNotNull(), urn("winner")).alias("ref"))
    return rows.mapInArrow(_write(size, date), "record_id string, instance long, chunk_no int, last boolean, data binary, running binary")


def read_table(table: DataFrame) -> DataFrame:
    """One row per record of a chunked record table: what its headers say and what its payload is.

    Records of one slice, nearly all, are read where they lie. Only slices of longer ones are shuffled. ``intact`` is false
    where a slice is lost, damaged or there twice, or the payload isn't what its digest states; size and digest are then those
    of what could be read before it, and null without a whole header. A record without a single slice leaves no row.
    """
    bound_batches(table.sparkSession)
    table = table.select("record_id", "instance", "chunk_no", "last", "data", "running")
    names = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, intact boolean"
    short = table.filter("chunk_no = 0 and last").mapInArrow(_read, names)
    long = table.filter("not (chunk_no = 0 and last)").repartition(parts(table), "record_id", "instance").sortWithinPartitions("record_id", "instance", "chunk_no")
    return short.unionByName(long.mapInArrow(_read, names))


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str | None = "url", body_col: str = "html", least: int = 0) -> DataFrame:
    """Write the archive, read it back: id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    table = materialise(write_table(pages, id_col, uri_col, body_col, least), "warc")
    number = lambda c: F.substring(c, len(URN) + 1, 40).try_cast("long")
    return read_table(table).select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "intact")
