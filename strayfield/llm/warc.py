"""WARC archives as seekable zstandard bundles.

Each task writes its records into bundles: records are grouped into independent zstandard frames; a skippable frame maps record
ids to (frame, offset in the frame); the last skippable frame is the seek table of the zstandard seekable format, with the sizes of
all frames. A reader finds a record by the table, the index and one frame. Equal payloads are stored once; the other records are
revisits that name the response.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted, shared_dir

INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32(hex_digest: str) -> str:
    import base64

    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def urn(page_id) -> str:
    """A record's id: the page's, escaped; of a page without an id one that no page can have."""
    return "urn:page:" + ("?" if page_id is None else quote(str(page_id), safe=""))


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit's block holds the HTTP header alone."""
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{urn(page_id)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32(digest)}", "Content-Type: application/http; msgtype=response"]
    if target:
        lines.append(f"WARC-Target-URI: {target}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{urn(refers_to)}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Writes frames as records come; holds one frame and the index only. The file gets its name when it is whole."""

    def __init__(self, uri: str, attempt: str, frame_bytes: int, level: int):
        self.fs, self.path = opened(uri)
        self.part = f"{self.path}.{attempt}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.zip, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frame, self.size, self.frames, self.index, self.n = [], 0, [], [], 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append(f"{record_id}\t{len(self.frames)}\t{self.size}")
        self.frame.append(data)
        self.size += len(data)
        self.n += 1
        if self.size >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.size:
            data = self.zip.compress(b"".join(self.frame))
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.frame, self.size = [], 0

    def close(self) -> int:
        self.end_frame()
        index = self.zip.compress("\n".join(self.index).encode())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.frames.append((len(index) + 8, 0))
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, FOOTER_MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)
        return sum(f[0] for f in self.frames)


class BundleReader:
    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file, self.unzip = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self.at(size - 9 - 8 * n, 8 * n)
        self.frames, place = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((place, packed, plain))
            place += packed

    def at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        place, packed, plain = self.frames[k]
        return self.unzip.decompress(self.at(place, packed), max_output_size=plain)

    def index(self) -> dict[str, list[tuple[int, int]]]:
        """The places of each record id: several where pages repeat an id, or have none."""
        place, packed, _ = self.frames[-1]
        lines = self.unzip.decompress(self.at(place + 8, packed - 8)).decode().split("\n")
        found: dict[str, list[tuple[int, int]]] = {}
        for i, k, o in (x.rsplit("\t", 2) for x in lines if x):
            found.setdefault(i, []).append((int(k), int(o)))
        return found

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.frames) - 1):
            data = io.BytesIO(self.frame(k))
            while (r := parsed(data)) is not None:
                yield r

    def find(self, record_id: str) -> list[tuple[dict[str, str], bytes]]:
        """The records of an id, by way of their frames alone; none if there is no such id."""
        out = []
        for frame, offset in self.index().get(record_id, []):
            data = io.BytesIO(self.frame(frame))
            data.seek(offset)
            out.append(parsed(data))
        return out


def parsed(data: io.BytesIO) -> tuple[dict[str, str], bytes] | None:
    """The next record's header fields and block."""
    if not data.readline():
        return None
    head = {}
    while (line := data.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(": ")
        head[name.lower()] = value
    block = data.read(int(head["content-length"]))
    data.read(4)
    return head, block


def with_revisits(pages: DataFrame, least: int, broadcast_rows: int) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    same = p.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("_kept"), F.count("*").alias("_n")).where("_n > 1 and _kept is not null").select("payload_digest", "_kept")
    same = persisted(same, "warc-same")
    if same.count() <= broadcast_rows:
        p = p.join(F.broadcast(same), "payload_digest", "left")
    else:
        salted = same.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("_salt", F.pmod(F.hash("page_id"), F.lit(SALTS))).join(salted, ["payload_digest", "_salt"], "left")
    return p.select("page_id", "url", "payload", "payload_digest", F.when(large & ~F.coalesce(F.col("page_id") == F.col("_kept"), F.lit(False)), F.col("_kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, level: int = 3, date: str = "1970-01-01T00:00:00Z", broadcast_rows: int = 100_000) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the bundles: (bundle, n_records, n_bytes).

    Of rows with equal payloads of at least ``least`` bytes, that with the largest page_id (every one that has it) is a response and the
    others are revisits. A null html is an empty payload, a null url none, a null page_id is never referred to. Bundles have names
    by partition and number; a task that runs again replaces its own.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches):
        task = TaskContext.get()
        attempt, part = f"{task.taskAttemptId()}", task.partitionId()
        writer, size, n = None, 0, 0
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        done = []
        slices = (batch.slice(k, 64) for batch in batches for k in range(0, batch.num_rows, 64))  # few payloads as Python objects at a time
        for rows in slices:
            for row in zip(*[rows.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")], strict=True):
                page_id, url, payload, digest, refers_to = row
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{n:04d}.warc.zst"
                    writer, size, n = BundleWriter(name, attempt, frame_bytes, level), 0, n + 1
                data = record("response" if refers_to is None else "revisit", page_id, url, payload.encode(), digest, refers_to, date)
                writer.add(urn(page_id), data)
                size += len(data)
                if size >= bundle_bytes:
                    done.append((name, writer.n, writer.close()))
                    writer = None
        if writer is not None:
            done.append((name, writer.n, writer.close()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["bundle", "n_records", "n_bytes"])

    written = with_revisits(pages, least, broadcast_rows).mapInArrow(write, "bundle string, n_records bigint, n_bytes bigint")
    return persisted(written, "warc-bundles")


def read_archives(bundles: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, digests of responses computed anew.

    ``id_type`` is the Spark type of page ids, as which they are read back: bigint, int or string. A response whose digest differs from its header fails the read.
    """

    def read(batches):
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                rows = []
                for head, block in BundleReader(bundle).records():
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    kind, claimed = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    own = lambda x: None if x is None or x == "?" else unquote(x) if id_type == "string" else int(x)
                    name = lambda k: head[k][len("<urn:page:") : -1] if k in head else None
                    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else unbase32(claimed)
                    if kind == "response" and (base32(digest) != claimed or length != len(payload)):
                        raise ValueError(f"{bundle}: {head['warc-record-id']} is damaged")
                    rows.append((own(name("warc-record-id")), length, digest, kind, own(name("warc-refers-to"))))
                    if len(rows) == 4096:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    def packed(rows):
        ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
        kinds = (ids, pa.int64(), pa.string(), pa.string(), ids)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    parts = max(1, bundles.count())
    return bundles.repartition(parts).mapInArrow(read, f"page_id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}")


def unbase32(text: str) -> str:
    import base64

    return base64.b32decode(text).hex()


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all of ``pages``, read the archives back. Repeated rows give repeated records; an empty table gives no records; other
    columns are ignored."""
    return read_archives(write_archives(pages, folder), pages.schema["page_id"].dataType.simpleString())


def find_records(bundle: str, page_id) -> list[tuple[dict[str, str], bytes]]:
    """Random access to the records of a page in a bundle."""
    return BundleReader(bundle).find(urn(page_id))
