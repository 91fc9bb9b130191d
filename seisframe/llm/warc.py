"""WARC archives with a shared Zstandard dictionary, one frame for each record.

A dictionary is built from a bounded sample of the records, stored in a
leading skippable frame of every archive, and used to compress each record as
a frame of its own, so records can be read one by one. Tasks write archives to
the shared folder under temporary names and rename them when complete; a task
that runs again writes the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Payload bytes from which a repeated record becomes a revisit.
REVISIT_BYTES = 1000
#: Records sampled for the dictionary (expected number), its size, the compression level, and when an archive is full.
SAMPLE, DICTIONARY_BYTES, LEVEL, ARCHIVE_BYTES = 400, 64 << 10, 6, 256 << 20
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def _filesystem(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    if ":" not in uri.split("/")[0] or uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), uri.removeprefix("file:").replace("//", "/", 1) if uri.startswith("file:") else uri
    return arrow_fs.FileSystem.from_uri(uri)


def roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` as (page_id, url, payload, refers_to); refers_to is the page that a revisit repeats, else null."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)).alias("same")
    groups = rows.select("page_id", digest).where("same is not null").groupBy("same").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = common.staged(groups.select("same", "first"), "repeated-payloads")
    return rows.withColumn("same", digest).join(groups, "same", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the response's HTTP header, whose Content-Length is the full payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; raw content from the samples where there are too few to train on."""
    import zstandard

    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary(records: DataFrame, sample: int = SAMPLE, seed: int = 4) -> bytes:
    """Dictionary from ``sample`` different records at most, chosen by a hash of the whole record and built in one task."""
    total = records.count()
    own = records.withColumn("h", F.xxhash64("page_id", "url", "payload", F.lit(seed)))
    drawn = own.where(F.pmod("h", F.lit(1 << 30)) < min(1.0, 1.5 * sample / max(1, total)) * (1 << 30)).dropDuplicates(["h"])  # equal records count once
    chosen = drawn.orderBy("h").limit(sample).repartition(1).sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [record(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([build_dictionary(rows)], type=pa.binary())], names=["dictionary"])

    built = chosen.select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")).mapInArrow(run, "dictionary binary").collect()
    return bytes(built[0][0]) if built else b""  # nothing to build on in an empty table


def _codecs(data: bytes, level: int = LEVEL):
    import zstandard

    kind = zstandard.DICT_TYPE_AUTO
    shared = zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None
    return zstandard.ZstdCompressor(level=level, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write(records: DataFrame, folder: str, shared: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to) rows as archives; returns their list (path, records, bytes), lazily."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        context = TaskContext.get()
        compress, _ = _codecs(shared)
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        head = zstandard.ZstdCompressor(level=LEVEL).compress(shared) if shared else b""
        info = b"software: seisframe\r\nformat: WARC File Format 1.1\r\n"
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:%d>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (
            context.partitionId(), DATE.encode(), len(info), info)
        done, out, size, count = [], None, 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            final = f"{root}/part-{context.partitionId():06d}-{len(done):04d}.warc.zst"
            system.move(partial, final)
            done.append((final, count, size))
            out = None

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    partial, size, count = f"{root}/.{context.partitionId():06d}-{context.taskAttemptId()}.tmp", 0, 0
                    out = system.open_output_stream(partial, compression=None)
                    start = struct.pack("<II", SKIPPABLE, len(head)) + head + compress.compress(info)
                    out.write(start)
                    size += len(start)
                frame = compress.compress(record(*(v.as_py() for v in row)))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        columns = zip(*done, strict=True) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def frames(source, chunk: int = 64 << 10) -> Iterator[bytes]:
    """The records of an open archive, decompressed one by one; the dictionary comes from its first frame."""
    import zstandard

    head = source.read(8)
    if len(head) < 8:
        return
    magic, n = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    shared = source.read(n)
    if shared[:4] == FRAME:
        shared = zstandard.ZstdDecompressor().decompress(shared)
    _, expand = _codecs(shared)
    left = b""
    while True:
        if not left:
            left = source.read(chunk)
            if not left:
                return
        one, parts = expand.decompressobj(), []
        while True:
            parts.append(one.decompress(left))
            if one.eof:
                left = one.unused_data
                break
            left = source.read(chunk)
            if not left:
                raise ValueError("a record is cut short")
        yield b"".join(parts)


def _page(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix(_ID)
    return int(text) if text else None


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the archives in a list with column ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path, compression=None) as source:
                    for data in frames(source):
                        fields, block = parse(data)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(v) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")) if k.lower() == b"content-length")
                        stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = fields["warc-type"]
                        if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != stated):
                            raise ValueError(f"record {fields['warc-record-id']} of {path} is damaged")
                        rows.append((_page(fields["warc-record-id"]), length, stated, kind, _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), payload if kind == "response" else None))
                        size += len(payload) + 200
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write all pages; returns the list of archives (path, records, bytes), complete, and their folder."""
    folder = folder or common.scratch(pages.sparkSession, "warc")
    records = roles(pages)
    plain = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    return common.staged(write(records, folder, dictionary(plain)), "archives"), folder


def round_trip(pages: DataFrame) -> DataFrame:
    """One row per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; a null url is left out of the record; a null
    page_id reads back as null. Of repeated payloads of REVISIT_BYTES or more
    the largest page_id is the response (every row that repeats that id too).
    Other columns are not read; an empty table gives no rows and no archive.
    """
    archives, folder = archive(pages)
    return read(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM g
"""
