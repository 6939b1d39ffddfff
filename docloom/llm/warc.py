"""WARC archives with a dictionary: each archive begins with a skippable frame that holds a Zstandard dictionary built from its own records, and every record is a frame of its own.

Records with equal payloads are stored once: the others are revisits. Tasks write archives to a folder that all machines
share, under names of their own; a manifest, written by Spark, names those of the tasks that succeeded, and only these are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import new_dir, table, written

#: Bytes of records in an archive (about), of the samples a dictionary is trained on, of a dictionary; first groups that may be broadcast.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL, BROADCAST_GROUPS = 32 << 20, 2 << 20, 64 << 10, 3, 200_000
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"
MANIFEST = "path string, records long, stored_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = WARC_DATE) -> bytes:
    """A response, or a revisit of page `refers_to`, which keeps the HTTP header, with the payload's length, but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on records evenly chosen over the whole archive, up to SAMPLE_BYTES; too few to train on serve as they are."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    samples = [r[: SAMPLE_BYTES // 8] for r in records[::step]]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\nWARC-Type: ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    d = dictionary(records)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
    raw = d.as_bytes()
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(c.compress, records)])


def read_archive(data: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of an archive, one frame after another."""
    magic, size = struct.unpack_from("<II", data, 0)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = bytes(data[8 : 8 + size])
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    at = 8 + size
    while at < len(data):
        one, out = d.decompressobj(), []
        while not one.eof:
            piece = data[at : at + (1 << 16)]
            if not len(piece):
                raise ValueError("an archive ends inside a record")
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield parse(b"".join(out))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of rows with equal payloads of at least min_bytes, those but the least page_id refer to it."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    keyed = own.withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    groups = keyed.where(F.octet_length("html") >= min_bytes).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_sha", "_first")
    groups = written(groups, "groups")
    small = groups.count() <= BROADCAST_GROUPS  # beyond that, rows are shuffled by checksum
    joined = keyed.join(F.broadcast(groups) if small else groups, "_sha", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = WARC_DATE) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) to archives in `folder` and returns their manifest.

    A null html is an empty payload, a null url leaves the field out, a null page_id is stored as none and revisits any
    page that has an id and its payload. Rows that repeat the least page_id of a payload are responses too. An empty
    table writes no archive. A task holds about ARCHIVE_BYTES of records at once, or one record.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.warc.zst", archive(records)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)]), pa.array([len(data)])], ["path", "records", "stored_bytes"])

        held, size = [], 0
        for batch in batches:
            for page, url, html, to in zip(*(batch.column(i) for i in range(4)), strict=True):
                held.append(record(page.as_py(), url.as_py(), html.as_py().encode(), to.as_py(), date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    made = revisits(pages, min_bytes).mapInArrow(write, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """RECORDS of the archives that the manifest names; a revisit has no payload. A payload that does not have its recorded checksum fails the read."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder) if manifest.limit(1).count() else spark.createDataFrame([], "path string, content binary")
    named = files.withColumn("_name", F.element_at(F.split("path", "/"), -1)).join(manifest.select(F.col("path").alias("_name")), "_name", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for fields, block in read_archive(memoryview(content.as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{fields['warc-record-id']}: the payload is damaged")
                    whole = lambda k: int(fields[k]) if k in fields else None
                    rows.append((whole("x-page-id"), fields.get("warc-target-uri"), n, digest, kind, whole("x-refers-to-page-id"), payload if payloads and kind == "response" else None))
                    size += len(payload) if payloads else 0
                    if len(rows) >= 4096 or size >= 16 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return named.select("content").mapInArrow(read, RECORDS)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder, payloads=False).drop("url", "payload")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', hex[i]) - 1) + 1, 4)), '') AS bits,
         min(page_id) OVER (PARTITION BY hex) AS first_id
  FROM p
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(bits[5*i+1] AS INT) + 8 * CAST(bits[5*i+2] AS INT) + 4 * CAST(bits[5*i+3] AS INT) + 2 * CAST(bits[5*i+4] AS INT) + CAST(bits[5*i+5] AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM b
"""
