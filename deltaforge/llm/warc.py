"""WARC archives in seekable Zstandard bundles.

A task writes its records into bundles of bounded size: records are grouped into independent Zstandard frames, and a
skippable frame at the end holds the seek table of the public seekable format (sizes of all frames, packed and
unpacked). The index maps each record to its bundle, frame and place within the unpacked frame, so one record is read
by unpacking one frame. A bundle's name holds a random part: a task that runs again writes bundles of its own, and the
index names those of the attempt that counted.

Equal payloads of some size are stored once: the record of the smallest id is a response, the others revisit it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltaforge.llm.work import Scratch, partitions

BUNDLE_BYTES = 32 << 20
FRAME_BYTES = 256 << 10
LEVEL = 3
#: Fixed values of the seekable format: magic of a skippable frame, magic at the end of the seek table.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: Fixed values of the archive format.
VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(map(chr, range(33, 127)))


def record_uri(page_id: int | None, n: int) -> str:
    """The same for the same page; a page without id gets one by its place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'none:{n}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, n: int = 0) -> bytes:
    """One archive record; a revisit has headers only."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", record_uri(page_id, n)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", quote(url, safe=_SAFE))] if url else []
    head += [("WARC-Page-ID", page_id)] if page_id is not None else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(refers_to, 0)), ("WARC-Refers-To-Page-ID", refers_to)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block]) + b"\r\n\r\n"


def parse(data: bytes, at: int = 0):
    """Records of unpacked bytes: (offset, end, headers, payload or None)."""
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].split(b"\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.decode().split(": ", 1) for x in lines[1:])
        start = head_end + 4
        end = start + int(headers["Content-Length"])
        payload = None if headers["WARC-Type"] == "revisit" else data[data.index(b"\r\n\r\n", start) + 4 : end]
        yield at, end + 4, headers, payload
        at = end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """Frames of a bundle, from its last bytes (all if need be): (offset, packed size, unpacked size)."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    body, out, at = tail[len(tail) - 9 - n * width : -9], [], 0
    for k in range(n):
        packed, unpacked = struct.unpack_from("<II", body, k * width)
        out.append((at, packed, unpacked))
        at += packed
    return out


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Bundle:
    """Bundles of one task."""

    def __init__(self, folder: str):
        import zstandard

        self.fs, self.root = _open(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.folder, self.pack = folder, zstandard.ZstdCompressor(level=LEVEL).compress
        self.out = None
        self.frame, self.rows, self.ready = bytearray(), [], []

    def add(self, page_id, data: bytes) -> None:
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self.flush()
        self.rows.append((page_id, len(self.frame), len(data)))
        self.frame += data
        if len(self.frame) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.frame:
            return
        if self.out is None:
            self.name, self.frames, self.size = f"bundle-{uuid.uuid4().hex}.warc.zst", [], 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        packed = self.pack(bytes(self.frame))
        self.out.write(packed)
        self.ready += [(page, f"{self.folder}/{self.name}", len(self.frames), self.size, len(packed), a, n) for page, a, n in self.rows]
        self.frames.append((len(packed), len(self.frame)))
        self.size += len(packed)
        self.frame, self.rows = bytearray(), []
        if self.size >= BUNDLE_BYTES:
            self.close()

    def close(self) -> None:
        self.flush()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


INDEX = "page_id long, path string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
_INDEX = pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("frame_bytes", pa.int64()), ("record_offset", pa.int64()), ("record_bytes", pa.int64())])


def first_of_payload(pages: DataFrame, least: int = 100) -> DataFrame:
    """Of pages whose payload another page of a smaller id has: page_id and that smallest page_id as refers_to."""
    facts = pages.where(F.col("page_id").isNotNull() & (F.octet_length(F.coalesce("html", F.lit(""))) >= least)).select("page_id", F.unhex(F.sha2("html", 256)).alias("digest"))
    first = facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to <> last")
    return facts.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Write one record per row of ``pages(page_id, url, html)`` and return the index of the records.

    :param folder: URI of a folder that all executors can write to; by default one in the shared folder.
    :param least: payloads of fewer bytes are never revisited.
    :returns: the columns of ``INDEX``. A null html is an empty payload; a null url is left out. A row without page_id is
        a response that nothing refers to. Rows that repeat an id and its payload are all responses if that id is the
        smallest, else all revisits. Other columns are ignored; an empty table writes no bundle.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = folder or f"{scratch.root}/bundles"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    again = first_of_payload(rows, least)
    keyed = rows.withColumn("digest", F.unhex(F.sha2("html", 256))).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        bundle, n = _Bundle(folder), 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, refers = (batch.column(c)[k].as_py() for c in range(4))
                bundle.add(page, record(page, url, (html or "").encode(), refers, n))
                n += 1
            if bundle.ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*bundle.ready, strict=True), _INDEX, strict=True)], schema=_INDEX)
                bundle.ready = []
        bundle.close()
        if bundle.ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*bundle.ready, strict=True), _INDEX, strict=True)], schema=_INDEX)

    return scratch.write(keyed.mapInArrow(run, INDEX), "index")


RECORDS = "page_id long, record_type string, url string, digest string, refers_to long, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _rows(found) -> pa.RecordBatch:
    rows = []
    for headers, payload in found:
        page, refers = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
        rows.append((int(page) if page is not None else None, headers["WARC-Type"], headers.get("WARC-Target-URI"), headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(refers) if refers is not None else None, payload))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def read_archives(paths: DataFrame) -> DataFrame:
    """All records of the bundles in ``paths(path)``, frame by frame by their seek tables: the columns of ``RECORDS``.

    The payload of a revisit is null; its digest and what it refers to come from its headers.
    """

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _open(path)
                with fs.open_input_file(name) as f:
                    size = f.size()
                    n = struct.unpack("<I", f.read_at(9, size - 9)[:4])[0]
                    tail = min(size, 9 + 12 * n)
                    for offset, packed, unpacked in read_seek_table(f.read_at(tail, size - tail)):
                        data = unpack.decompress(f.read_at(packed, offset), max_output_size=unpacked)
                        yield _rows((h, p) for _, _, h, p in parse(data))

    files = paths.select("path").distinct()
    return files.repartition(partitions(files.sparkSession), "path").mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """What each record stands for: page_id, payload_bytes long and payload_digest of the full payload, record_type, refers_to.

    ``records`` has the columns of ``RECORDS`` and is read once. A response's figures come from its payload; a revisit's
    from the payload of the response with the id and the digest that its header names (null if there is none). Only
    revisits, and responses that may be meant, meet in a join.
    """
    slim = records.select("page_id", "record_type", "refers_to", F.col("digest").alias("named"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    slim = Scratch(records.sparkSession, "warc").write(slim, "records")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses, revisits = slim.where("record_type = 'response'"), slim.where("record_type = 'revisit'")
    stored = responses.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("named")).agg(F.max("payload_bytes").alias("payload_bytes"))
    found = revisits.select("page_id", "record_type", "refers_to", "named").join(stored, ["refers_to", "named"], "left")
    return responses.select(*out).unionByName(found.withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("named"))).select(*out))


def fetch(index: DataFrame) -> DataFrame:
    """The records that rows of an index point to, by unpacking only their frames."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                fs, name = _open(row["path"])
                with fs.open_input_file(name) as f:
                    data = unpack.decompress(f.read_at(row["frame_bytes"], row["frame_offset"]))
                a = row["record_offset"]
                found += [(h, p) for _, _, h, p in parse(data[a : a + row["record_bytes"]])]
            if found:
                yield _rows(found)

    return index.select(*[c.split(" ")[0] for c in INDEX.split(", ")]).mapInArrow(run, RECORDS)
