"""WARC archives compressed record by record with a dictionary of their own.

1. Payload digests (SHA-1) are grouped with partial aggregation; the record
   with the largest page id of equal payloads is the response, others are
   revisits of it.  The groups are joined back by digest, so a payload that a
   third of all pages share is a skewed join that adaptive execution splits.
2. Each partition writes archives of its own: a dictionary is trained on the
   archive's first records and put into a leading skippable frame; a ``warcinfo``
   record follows, a revisit names its response's record and URI, and every record
   is a frame of its own, so it can be read alone.  A file gets its final name
   only when it is complete, names differ between attempts of a task, and only
   the archives in the written manifest count: a lost executor leaves at most
   unlisted files.
3. Archives are read back, records parsed and payload digests checked.

Files go to the shared folder by its URI.

Defined results: null html is an empty payload; payloads shorter than
``least_bytes`` are always responses; rows that tie for the largest id of their
payload are all responses, null ids are revisits where the payload has another
id; repeated rows get a record each; an empty table gives no archive.  Every
archive has a dictionary: records of too few bytes to train on are themselves
its content.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, new_path, written

#: Bytes of records that an archive holds at most before the next begins, that
#: its dictionary is trained on at most, of a training sample, and of the dictionary.
ARCHIVE, TRAIN, SAMPLE, DICTIONARY = 256 << 20, 1 << 20, 8192, 32 << 10
LEVEL = 3
#: Magic number of the skippable frame that holds the dictionary.
SKIPPABLE = 0x184D2A5D


def digest32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def header(fields: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: rowproof\r\nformat: WARC File Format 1.1\r\n"
    return header(["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def target(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, top: int | None, top_url: str | None, revisit: bool) -> bytes:
    """One WARC record.  ``Page-Id``, ``Page-Length`` and ``Refers-To-Page`` are
    extension fields, which the format allows."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Page-Length: {len(payload)}",
    ]
    if page_id is not None:
        fields.append(f"Page-Id: {page_id}")
    if revisit:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(top, digest)}",
            f"WARC-Refers-To-Target-URI: {target(top_url)}", "WARC-Refers-To-Date: 1970-01-01T00:00:00Z", f"Refers-To-Page: {top}",
        ]
    return header([*fields, "Content-Type: application/http; msgtype=response"], http if revisit else http + payload)


class Archive:
    """One archive being written: records are held until the dictionary can be
    trained, and compressed at once from then on."""

    def __init__(self, folder: str, name: str):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.path, self.uri = f"{root}/{name}", f"{folder}/{name}"
        self.held: list[bytes] = []
        self.size = self.count = 0
        self.out = None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.count += 1
        if self.out is None:
            self.held.append(data)
            if self.size >= 8 * TRAIN:
                self.start()
        else:
            self.out.write(self.packer.compress(data))

    def start(self) -> None:
        # Pieces spread evenly over the held records, up to the training bound; of few records all, cut into small ones.
        share = max(256, min(SAMPLE, TRAIN // max(1, len(self.held))))
        samples = [r[:share] for r in self.held[:: max(1, len(self.held) * share // TRAIN)]]
        if len(samples) < 64:
            samples = [r[i : i + 256] for r in self.held for i in range(0, min(len(r), TRAIN), 256)][: TRAIN // 256]
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8, level=LEVEL)
        except zstandard.ZstdError:  # too little to learn from: the content itself is the dictionary
            dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.path + ".open", compression=None)
        data = dictionary.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        for r in [info(self.path.rpartition("/")[2]), *self.held]:
            self.out.write(self.packer.compress(r))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self.start()
        self.out.close()
        self.files.move(self.path + ".open", self.path)
        return self.uri, self.count, self.size


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html, digest hex, top, top_url, revisit) rows -> manifest (uri, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        done, now = [], None
        for b in batches:
            for page, url, html, digest, top, top_url, revisit in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if now is None:
                    now = Archive(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst")
                now.add(record(page, url, (html or "").encode(), digest32(digest), top, top_url, revisit))
                if now.size >= ARCHIVE:
                    done.append(now.close())
                    now = None
        if now is not None:
            done.append(now.close())
        if done:
            uri, n, size = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(uri, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["uri", "records", "bytes"])

    return written(rows.select("page_id", "url", "html", "digest", "top", "top_url", "revisit").mapInArrow(run, "uri string, records long, bytes long"), "manifest")


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of an archive's records, one at a time."""
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path, compression=None) as raw:
        start = raw.read(8)
        magic, size = struct.unpack("<II", start)
        dictionary = None
        if magic == SKIPPABLE:
            dictionary, start = zstandard.ZstdCompressionDict(raw.read(size)), b""
        source = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(_Joined(start, raw), read_across_frames=True), 1 << 20)
        while line := source.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record where one should start in {uri}")
            head: dict[str, str] = {}
            while (line := source.readline()) != b"\r\n":
                key, _, value = line.decode().partition(":")
                head[key] = value.strip()
            block = source.read(int(head["Content-Length"]))
            if source.read(4) != b"\r\n\r\n":
                raise ValueError(f"a record is cut short in {uri}")
            yield head, block


class _Joined(io.RawIOBase):
    def __init__(self, start: bytes, raw):
        self.start, self.raw = start, raw

    def read(self, n: int = -1) -> bytes:
        if self.start:
            out, self.start = self.start, b""
            return out
        return self.raw.read(n)


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            for uri in b.column(0).to_pylist():
                for head, block in read_records(uri):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["Page-Length"])
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest or len(payload) != size:
                            raise ValueError(f"a payload differs from its digest in {uri}")
                    page, refers = head.get("Page-Id"), head.get("Refers-To-Page")
                    rows.append((page and int(page), size, digest, head["WARC-Type"], refers and int(refers)))
                    if len(rows) >= 10_000:
                        yield give()
                        rows = []
        if rows:
            yield give()

    n = max(1, manifest.count())
    return manifest.select("uri").repartition(min(n, 100_000)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row to archives in ``folder`` and return the manifest."""
    spark: SparkSession = pages.sparkSession
    bound_batches(spark)
    raw = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(raw).alias("digest"))
    tops = rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.max_by("url", "page_id").alias("top_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(tops, "digest", "left").withColumn("revisit", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")))
    return write_archives(marked, folder or new_path(spark, "warc"))
