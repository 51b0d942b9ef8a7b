"""Operator 7, WARC: archives as whole-file gzip streams, their normaliser, and indexed reading.

write_archives() writes a record per page into archives that are one gzip member each, as careless tools do. normalise() inflates
each such stream once, in bounded pieces, writes every record again as a gzip member of its own, and writes a sidecar index of offsets.
read_records() opens the members by that index, so that readers may start anywhere. Files go to the shared folder under names that
depend on the partition only; each is written under a name of the attempt and renamed, so a task that runs again replaces
its own output.

Records with equal payloads: that with the largest page_id is the response, the others revisit it. Digests are shared out by
an aggregate and a join on those that occur twice or more, so a payload that a third of all pages share is one row there. Up to BROADCAST_ROWS
of these are broadcast, and pages stay where they are read; beyond, Spark joins by sorting and splits large partitions.

Archives of other origin are read too: fields without a blank behind the colon, folded fields, several members, zeros behind the last
one, records without a digest, of other types or with other blank lines between. Of a damaged or cut-off archive the whole records
before the damage are kept, and a row without an offset tells the error.

Edge cases: null html is an empty payload, which is digested like any other. Pages with a null page_id come last in a
group and are responses of their own only if the whole group has no id. Repeated rows with equal page_id and payload
are one capture: all are responses, under one record id. An empty table gives no archive. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

#: Bytes of payload after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
_PIECE = 1 << 20
#: Repeated digests (of about 60 bytes) that may be broadcast; bytes of archive that a task reads back.
BROADCAST_ROWS, READ_BYTES = 500_000, 4 << 20


def _files(uri: str):
    """File system and path of a URI, as any task can open it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)


class _Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.files, base = _files(folder)
        self.files.create_dir(base, recursive=True)
        self.path = f"{base}/{name}"
        self.part = f"{self.path}.attempt-{TaskContext.get().taskAttemptId()}"
        self.out = self.files.open_output_stream(self.part, compression=None)

    def close(self) -> None:
        self.out.close()
        self.files.move(self.part, self.path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit whose HTTP header still tells the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, html (never null) and refers_to. With scratch the repeated digests are written, counted, and broadcast if few."""
    each = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_sha", F.sha1(F.encode("html", "UTF-8")))
    often = each.groupBy("_sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if scratch is not None:
        often = scratch.write(often)
        often = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    mine = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return each.join(often, "_sha", "left").select("page_id", "url", "html", mine.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) as whole-file gzip archives; gives archive and records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, out, names, counts = TaskContext.get().partitionId(), 0, None, [], []
        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    name, size, packer = f"part-{part:05d}-{n:04d}.warc.gz", 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    out, n = _Output(folder, name), n + 1
                    names.append(name)
                    counts.append(0)
                payload = (row["html"] or "").encode()
                out.out.write(packer.compress(record(row["page_id"], row["url"], payload, digest_of(payload), row["refers_to"])))
                counts[-1] += 1
                size += len(payload)
                if size >= most:
                    out.out.write(packer.flush())
                    out.close()
                    out = None
        if out is not None:
            out.out.write(packer.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records bigint")


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece; zeros between or behind members are skipped."""
    packer, fresh = zlib.decompressobj(31), True
    while raw := stream.read(_PIECE):
        while raw:
            if fresh and not (raw := raw.lstrip(b"\0")):
                break
            fresh = False
            yield packer.decompress(raw, _PIECE)
            while packer.unconsumed_tail:
                yield packer.decompress(packer.unconsumed_tail, _PIECE)
            raw = packer.unused_data
            if not packer.eof:
                break
            packer, fresh = zlib.decompressobj(31), True
    if not fresh:
        raise ValueError("the archive ends inside a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC stream, each with two line ends behind it; holds one record and one piece."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        if not held:
            if more():
                continue
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record without an end of its header")
        found = re.search(rb"(?im)^content-length\s*:\s*(\d+)", held[:end])
        if not found:
            raise ValueError("a record without a length")
        whole = end + 4 + int(found[1])
        while len(held) < whole:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(held[:whole]) + b"\r\n\r\n"
        del held[:whole]


def header(raw: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with a blank goes on with the one before."""
    found: dict[str, str] = {}
    name = None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def fields(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    found = header(head)
    return found, rest[: int(found["content-length"])]


def normalise(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrites each archive of folder into target with a member for each record, and a sidecar NAME.idx with lines of
    offset, length and record id; gives archive, offset, length and error. A damaged archive has a last row with an error alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                files, base = _files(folder)
                out, index = _Output(target, name), _Output(target, f"{name}.idx")
                at, offsets, lengths, errors = 0, [], [], []
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    try:
                        for raw in records(inflated(stream)):
                            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = packer.compress(raw) + packer.flush()
                            out.out.write(member)
                            index.out.write(f"{at} {len(member)} {fields(raw)[0].get('warc-record-id', '-')}\n".encode())
                            offsets.append(at)
                            lengths.append(len(member))
                            errors.append(None)
                            at += len(member)
                    except (ValueError, zlib.error) as e:
                        offsets.append(None)
                        lengths.append(None)
                        errors.append(str(e))
                out.close()
                index.close()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(errors, pa.string())], names=["archive", "offset", "length", "error"])

    return archives.select("archive").mapInArrow(run, "archive string, offset bigint, length bigint, error string")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Opens each member of an index (archive, offset, length) by its offset: page_id (null for records of other origin), payload_bytes, payload_digest,
    record_type, refers_to, payload (null for revisits)."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    number = lambda s: int(m[1]) if s and (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        name, source = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for x in batch.slice(lo, 256).to_pylist():
                    if x["archive"] != name:
                        if source is not None:
                            source.close()
                        name, source = x["archive"], files.open_input_file(f"{base}/{x['archive']}")
                    raw = zlib.decompress(source.read_at(x["length"], x["offset"]), 31)
                    head, block = fields(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if not http.startswith(b"HTTP/"):
                        http, payload = b"", block
                    kind = head.get("warc-type", "")
                    length = header(http).get("content-length", "")
                    full = int(length) if kind == "revisit" and length.isdigit() else len(payload)
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or digest_of(payload)
                    if number(head.get("warc-record-id")) is not None and kind == "response" and (digest_of(payload) != digest or length != str(full)):
                        raise ValueError(f"record {head['warc-record-id']} of {name} doesn't match its digest")
                    rows.append((number(head.get("warc-record-id")), full, digest, kind, number(head.get("warc-refers-to")), payload if kind != "revisit" else None))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if source is not None:
            source.close()

    # Members that lie near each other are opened by one task, in order.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    near = index.repartition(tasks, "archive", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("archive", "offset")
    return near.mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    plain, members = f"{scratch.base}/plain", f"{scratch.base}/members"
    archives = scratch.write(write_archives(with_revisits(table(spark, sf_dir, "pages"), scratch), plain))
    index = scratch.write(normalise(archives.repartition(max(1, archives.count())), plain, members))
    if damaged := index.where("error is not null").take(1):
        raise ValueError(f"archive {damaged[0].archive}: {damaged[0].error}")
    return read_records(index, members).drop("payload")
