"""WARC archives of Zstandard frames: one frame per record, after a dictionary in a skippable frame.

An archive begins with a skippable frame that holds the dictionary; every record is a frame
of its own, compressed with it. Writing tasks roll archives over at a bounded size and keep
what a failed attempt left apart: only archives named in the manifest, which Spark commits,
are read. The reader holds one record at a time and validates version line, headers, lengths
and digests; what fails comes back as a row with `problem` set instead of stopping the job.

Payloads are texts in UTF-8 inside an HTTP response. A revisit record has the HTTP headers
only; its Content-Length is that of the full payload.

Null texts are empty payloads; a null key is written as an empty id, is always a response and
reads back as null; keys may repeat; line breaks in URLs are percent-encoded; an empty table
gives no archives; columns beside key, url and text are ignored. A record is written and read
in memory, so a very long payload takes a few times its size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, map_of, on_map, sampled, spread_join, stored, table

#: Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")

REVISIT_FROM = 1000
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: Stretches of payloads that the dictionary is trained on, and their characters.
DICTIONARY_SAMPLE, STRETCH = 1000, 1 << 14
LEVEL = 3
_READ = 1 << 20
_ID = "urn:record:"
_DATE = "2000-01-01T00:00:00Z"


class BadRecord(ValueError):
    pass


# records


def record(key: str, url: str | None, payload: bytes, digest: bytes, refers_to: str | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{key}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    lines.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadRecord(f"bad header line: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _number(value: str | None, what: str) -> int:
    if value is None or not re.fullmatch(r"[0-9]+", value):
        raise BadRecord(f"bad {what}: {value!r}")
    return int(value)


def parse(raw: bytes) -> dict:
    """One record's fields; raises BadRecord if it is not valid."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if not gap or version.decode("latin-1") != VERSION:
        raise BadRecord(f"no record of {VERSION}")
    h = _headers(fields)
    if missing := [x for x in MANDATORY if x.lower() not in h]:
        raise BadRecord("missing " + ", ".join(missing))
    length = _number(h["content-length"], "Content-Length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    block = rest[:length]
    if "warc-block-digest" in h and h["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise BadRecord("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, _, http_fields = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise BadRecord("no HTTP response")
    full = _number(_headers(http_fields).get("content-length"), "HTTP Content-Length")
    kind = h["warc-type"]
    digest = base64.b32decode(h.get("warc-payload-digest", "").removeprefix("sha1:").encode())
    if kind == "response":
        if len(payload) != full:
            raise BadRecord(f"payload of {len(payload)} bytes, HTTP Content-Length {full}")
        if hashlib.sha1(payload).digest() != digest:
            raise BadRecord("payload digest differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in h or len(digest) != 20:
        raise BadRecord(f"bad record of type {kind!r}")
    name = lambda x: x.strip("<>").removeprefix(_ID) if x is not None else None
    return {"key": name(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": full, "payload_digest": digest.hex(), "record_type": kind, "refers_to": name(h.get("warc-refers-to")), "payload": payload if kind == "response" else None}


# archives


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(content)) + content


def read_archive(stream):
    """The frames' contents, decoded one at a time; raises BadRecord where the archive breaks off."""
    head = stream.read(8)
    if not head:
        return
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE_MAGIC:
        raise BadRecord("no dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    content = stream.read(size)
    if len(content) != size:
        raise BadRecord("the dictionary breaks off")
    if content[:4] == ZSTD_MAGIC:  # a dictionary may be compressed itself
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    dictionary = zstandard.ZstdCompressionDict(content) if content else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    pending = stream.read(_READ)
    while pending:
        frame, out = reader.decompressobj(), []
        try:
            while True:
                out.append(frame.decompress(pending))
                if frame.eof:
                    pending = frame.unused_data or stream.read(_READ)
                    break
                pending = stream.read(_READ)
                if not pending:
                    raise BadRecord("a frame breaks off")
        except zstandard.ZstdError as e:
            raise BadRecord(f"bad frame: {e}") from None
        yield b"".join(out)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(rows: DataFrame, where: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (key, url, text, refers_to; strings) as archives below the URI `where`. Returns the stored manifest (archive, records)."""
    shared = rows.sparkSession.sparkContext.broadcast(dictionary)

    def write(batches):
        from pyspark import TaskContext

        files, base = _filesystem(where)
        context = TaskContext.get()
        attempt = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        own = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=True) if own else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        out, done, size, records = None, [], 0, 0
        for batch in batches:
            for key, url, text, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    files.create_dir(base, recursive=True)
                    name = f"{attempt}-{len(done):04d}.warc.zst"
                    out, size, records = files.open_output_stream(f"{base}/{name}"), 0, 0
                    size += out.write(skippable(shared.value)) or 0
                payload = (text.as_py() or "").encode()
                frame = press.compress(record(key.as_py(), url.as_py(), payload, hashlib.sha1(payload).digest(), refers.as_py()))
                out.write(frame)
                size, records = size + len(frame), records + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{where}/{name}", records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{where}/{name}", records))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return stored(rows.select("key", "url", "text", "refers_to").mapInArrow(write, "archive string, records bigint"), "manifest")[0]


_SCHEMA = "archive string, key string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary, problem string"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of the archives named in column `archive`; payload is null in revisits, or everywhere if not asked for."""
    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 100_000))

    def read(batches):
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in _NAMES])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, path = _filesystem(archive)
                rows, held = [], 0
                with files.open_input_stream(path) as stream:
                    try:
                        for raw in read_archive(stream):
                            try:
                                row = parse(raw)
                            except ValueError as e:
                                row = {"problem": str(e)}
                            if not payloads:
                                row.pop("payload", None)
                            rows.append({"archive": archive} | row)
                            held += len(row.get("payload") or b"") + 200
                            if held > 1 << 22:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, held = [], 0
                    except BadRecord as e:
                        rows.append({"archive": archive, "problem": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    numbered = manifest.select("archive").repartition(min(tasks, 8 * spark.sparkContext.defaultParallelism))
    return numbered.mapInArrow(read, _SCHEMA)


def train_dictionary(pages: DataFrame, text: str, size: int = DICTIONARY_BYTES, sample: int = DICTIONARY_SAMPLE) -> bytes:
    """A dictionary trained on about `sample` stretches, chosen by a hash among those of all payloads; empty if they are too few to train on."""
    stretches = pages.select(F.explode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))).alias("stretch"))
    samples = sorted(r[0].encode() for r in sampled(stretches, sample).collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def archive_pages(pages: DataFrame, where: str, key: str = "page_id", url: str = "url", text: str = "html", revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row; of equal payloads of `revisit_from` bytes or more, all but that with the largest key become revisits of it. Returns the manifest."""
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.when(F.octet_length("text") >= revisit_from, F.sha1("text")))
    first = rows.where("digest IS NOT NULL AND k IS NOT NULL").groupBy("digest").agg(F.max("k").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    refers = F.when((F.col("first").isNotNull()) & (F.col("k") != F.col("first")), F.col("first").cast("string"))
    first, _ = stored(first, "repeated")
    # most payloads occur once: a map of fixed size tells which may not, and those alone are shuffled
    shared = pages.sparkSession.sparkContext.broadcast(map_of(first.select(F.xxhash64("digest").alias("key"))))

    @F.pandas_udf("boolean")
    def known(digest: pd.Series) -> pd.Series:
        return pd.Series(on_map(shared.value, digest.to_numpy()))

    marked = rows.withColumn("again", F.col("digest").isNotNull() & F.col("k").isNotNull() & known(F.xxhash64("digest")))
    met = spread_join(marked.where("again"), first, "digest", "left").unionByName(marked.where("NOT again").withColumn("first", F.lit(None)))
    out = met.select(F.coalesce(F.col("k").cast("string"), F.lit("")).alias("key"), "url", "text", refers.alias("refers_to"))
    return write_archives(out, where, train_dictionary(pages, text), archive_bytes)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    found = read_archives(archive_pages(pages, fresh_path(spark, "archives")), payloads=False)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.select(number("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "problem")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM r
"""
