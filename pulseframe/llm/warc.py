"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``;
a footer in the public seekable format (a skippable frame with the compressed
and decompressed size of every frame) ends each bundle. The index maps a record
id to (bundle, frame, offset inside the frame, length), so one record is read
by fetching one frame. Records with equal payloads: the one with the largest
id is stored (``response``), the others refer to it (``revisit``).

Bundles are written by tasks to shared storage through ``pyarrow.fs`` under a
temporary name and moved in place, so that a task that runs again replaces its
own bundle by an equal one. The table of digests is small columns only: equal
payloads, also a third of all rows, meet in partial aggregates, and their join
can be split.

Defined cases: null payloads count as empty; a row without id has a record of
its own, which may be a revisit but isn't referred to;
rows with equal id and payload are equal records; rows with equal id and
different payloads are records of their own under one id.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.tables import fresh_path, partitions, stash, text_or_empty
from pulseframe.session import ship_package

FRAME_BYTES = 1 << 20
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """(file system, path) of shared storage; a plain path is a local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(rid: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if rid is None else rid}>",
            f"WARC-Target-URI: {(url or 'urn:none').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    body = HTTP + (payload if refers_to is None else b"")
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0):
    """(headers, payload, end) of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    body = stop + 4
    end = body + int(head["Content-Length"])
    return head, data[data.index(b"\r\n\r\n", body) + 4:end], end + 4


class BundleWriter:
    """Frames to a file, then the seek table."""

    def __init__(self, out):
        self.out, self.frames, self.held, self.size = out, [], [], 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, rec: bytes) -> tuple[int, int, int]:
        """Where the record lies: frame, offset in it, length."""
        if self.held and self.size + len(rec) > FRAME_BYTES:
            self.flush()
        place = (len(self.frames), self.size, len(rec))
        self.held.append(rec)
        self.size += len(rec)
        return place

    def flush(self) -> None:
        if self.held:
            data = self.zstd.compress(b"".join(self.held))
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class Bundle:
    """Random access to the frames of an open bundle."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        f.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        f.seek(size - 9 - 8 * n)
        sizes = struct.unpack(f"<{2 * n}I", f.read(8 * n))
        self.sizes, self.starts = sizes[::2], [0]
        for c in self.sizes:
            self.starts.append(self.starts[-1] + c)

    def frame(self, k: int) -> bytes:
        self.f.seek(self.starts[k])
        return zstandard.ZstdDecompressor().decompress(self.f.read(self.sizes[k]))

    def read(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset:offset + length]


INDEX = "id long, bundle string, frame int, offset long, length long"


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_payload: int = 0) -> DataFrame:
    """Write the bundles below ``path``; returns the index (id, bundle, frame,
    offset, length). Payloads under ``min_payload`` bytes are never revisits."""
    ship_package(df.sparkSession)
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(payload_col).alias("payload"))
            .withColumn("sha", F.sha1(F.col("payload").cast("binary"))))
    light = rows.where(F.octet_length("payload") >= min_payload).select("id", "sha")  # a null id isn't the largest
    kept = light.groupBy("sha").agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("sha", "kept")
    refer = light.join(kept.where("kept is not null"), "sha").where("not id <=> kept").select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "kept")
    refer = refer.distinct()
    rows = rows.join(refer, F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")), "left")

    def write(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        fs, root = filesystem(path)
        name = f"part-{task.partitionId():06d}.warc.zst"
        draft = f"{root}/.{name}-{task.taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        out = fs.open_output_stream(draft)
        writer = BundleWriter(out)
        for b in batches:
            places = []
            for rid, url, payload, kept_id in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "kept"))):
                payload = payload.encode()
                places.append((rid, name, *writer.add(record(rid, url, payload, digest(payload), kept_id))))
            cols = list(zip(*places)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                             names=["id", "bundle", "frame", "offset", "length"])
        writer.close()
        out.close()
        fs.move(draft, f"{root}/{name}")

    return stash(rows.select("id", "url", "payload", "kept").sortWithinPartitions("id", "payload").mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, path: str) -> DataFrame:
    """Every record, read back from its frame: (id, payload_bytes,
    payload_digest, record_type, refers_to). Stored payloads are checked
    against their digest."""
    frames = index.select("bundle", "frame").distinct()
    n = max(1, partitions(index.sparkSession))

    def read(batches):
        fs, root = filesystem(path)
        for b in batches:
            for name, frame in sorted(zip(b.column("bundle").to_pylist(), b.column("frame").to_pylist())):
                out = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    data = Bundle(f).frame(frame)
                at = 0
                while at < len(data):
                    head, payload, at = parse(data, at)
                    sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and digest(payload) != sha:
                        raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} doesn't have its digest")
                    refers = head.get("WARC-Refers-To")
                    rid = head["WARC-Record-ID"][10:-1]
                    out.append((None if rid == "none" else int(rid), int(head["X-Payload-Length"]), sha, head["WARC-Type"],
                                int(refers[10:-1]) if refers else None))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                                 names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return frames.repartition(n, "bundle", "frame").mapInArrow(read, schema)


def read_record(path: str, bundle: str, frame: int, offset: int, length: int):
    """(headers, payload) of one record by its index entry."""
    fs, root = filesystem(path)
    with fs.open_input_file(f"{root}/{bundle}") as f:
        head, payload, _ = parse(Bundle(f).read(frame, offset, length))
    return head, payload


def round_trip(df: DataFrame, **columns) -> DataFrame:
    path = fresh_path(df.sparkSession, "warc")
    return read_archives(write_archives(df, path, **columns), path)
