"""WARC archives whose records are Zstandard frames under a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, checked, materialize, shared_dir

#: Little-endian magic number of the frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: An empty skippable frame, which ends an archive (magic number and length 0).
END_FRAME = "P*M\x18\0\0\0\0"
#: Magic numbers of skippable frames differ in their last four bits.
SKIPPABLE = 0x184D2A50
#: Bytes of records in an archive, bytes of a dictionary and of the records it is built from.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 32 << 20, 32 << 10, 1 << 20
#: Bytes that a reader is given at a time.
STEP = 8 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}').urn}>"


def record(page: int | None, url: str | None, payload: bytes, of: int | None = None) -> bytes:
    """A response record, or where of is given a revisit of that page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if of is not None else http + payload
    target = "".join((url or "").split()) or "urn:none"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if of is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if of is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(of)}", f"X-Refers-To-Page-Id: {of}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """One archive: a skippable frame with a dictionary built from the records, then a frame for each record."""
    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    samples = [r[:TRAINING_BYTES] for r in records[::step]]
    try:
        found = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small records: the records themselves serve
        found = zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = found.as_bytes()
    frames = [struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw]
    writer = zstandard.ZstdCompressor(level=3, dict_data=found, write_checksum=True, write_content_size=True)
    frames += [writer.compress(r) for r in records]
    return b"".join(frames)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & ~15 == SKIPPABLE:
            raw = data[at + 8 : at + 8 + size]
            at += 8 + size
            if magic == DICTIONARY_FRAME:
                trained = raw[:4] == b"\x37\xa4\x30\xec"
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
            continue
        one, parts = reader.decompressobj(), []
        while not one.eof and at < len(data):
            parts.append(one.decompress(data[at : at + STEP]))
            at += min(STEP, len(data) - at)
        at -= len(one.unused_data)
        text = b"".join(parts)
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        yield fields, rest[: int(fields["content-length"])]


def write(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages as files *.warc.zst in a new part of the shared folder; returns them (path, length, content).

    Of pages with equal payloads of min_bytes or more, rows with the largest id are responses and the others revisit
    it; a null payload is empty, a null id is never the largest (alone it is a response). Only (digest, largest id) of
    repeated payloads is shuffled, and broadcast if its counted size allows. A task holds one archive at a time. White
    space is cut out of a URL, a null one becomes urn:none; repeated rows are records of their own.
    """
    kind = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), kind.alias("html"), F.sha1(kind.cast("binary")).alias("sha"))
    repeated = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page").alias("of"), F.count(F.lit(1)).alias("n")).filter("n > 1 and of is not null")
    repeated = materialize(repeated.select("sha", "of"))
    chosen = rows.join(checked(repeated, 64), "sha", "left").withColumn("of", F.when(F.octet_length("html") >= min_bytes, F.when(F.col("page").isNull() | (F.col("page") < F.col("of")), F.col("of"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["content"])

        for batch in batches:
            ids, urls, of = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for page, url, payload, target in zip(ids, urls, as_bytes(batch.column(2)), of):
                if held and size + len(payload) > archive_bytes:
                    yield full()
                    held, size = [], 0
                held.append(record(page, url, payload, target))
                size += len(held[-1])
        if held:
            yield full()

    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = chosen.select("page", "url", "html", "of").mapInArrow(run, "content binary")
    # the text writer puts a string's bytes and its line end into a file as they are, here an archive in each
    archives.select(F.col("content").cast("string")).write.option("lineSep", END_FRAME).option("maxRecordsPerFile", 1).text(folder)
    named(spark, folder)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "length", "content")


def named(spark: SparkSession, folder: str) -> None:
    """Gives the archives of a folder their names, by Hadoop's file system, whichever it is. Files without one go."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        path = status.getPath()
        if path.getName().startswith("part-"):
            if status.getLen():
                fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(at, path.getName().removesuffix(".txt") + ".warc.zst"))
            else:  # a task without rows
                fs.delete(path, False)


def read(archives: DataFrame) -> DataFrame:
    """Records of archives: (page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload).

    payload is null for revisits; payload_bytes is then what the HTTP header tells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for fields, block in records(data.as_buffer().to_pybytes()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = int(head.rpartition(b"Content-Length: ")[2])
                    revisit = fields["warc-type"] == "revisit"
                    page, of = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    rows.append((page and int(page), fields["warc-target-uri"], fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), length, of and int(of), None if revisit else payload.decode()))
                    size += len(payload)
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

    return archives.select("content").mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string")
