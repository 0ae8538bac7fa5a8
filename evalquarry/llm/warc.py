"""WARC archives with a Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary, then each record is a
frame of its own, so a reader can start at any record. The dictionary is trained on a
bounded sample of the records that will be archived. Records with equal payloads of at
least min_dedup bytes are one response, that of the largest page_id, and revisits of it.

Which rows are revisits is settled on digests and ids alone. Revisits are then written from
these, without their payloads; of the pages, two bitmaps of fixed size tell responses from
revisits where they are read, and only the few rows that both leave open are shuffled.

The archives are written by Spark itself, through whatever file system the folder is
on, a record to a row; what Spark's text writer sets between rows is an empty skippable
frame, which every Zstandard reader passes over. The writer takes the bytes of a row as they
are (a test holds it to that). An archive has most_rows rows; one that reaches
most_bytes before is filled up with empty ones, so no archive has more than these bytes
and a record. `read` takes archives apart again, checks every digest and yields the records.

Defined results: a null html is an empty payload; a null url becomes about:blank; a null
page_id is carried as null. If several rows have the largest page_id of a payload, each of
them is a response; rows that repeat a page_id are records each. A very long payload is one
record (up to Spark's 2 GB for a value) and ends its archive. An empty table gives an empty
folder and no records. A sample too small to train on means archives without a dictionary.
Only page_id (a whole number, read as bigint), url and html are read, so the names of other columns
can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm import bitmaps, common

#: Fixed values of the formats: magic numbers of the frame with the dictionary and of an empty skippable frame.
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
SPACER = (0x184D2A50).to_bytes(4, "little") + bytes(4)
SKIPPABLE = range(0x184D2A50, 0x184D2A60)

SAMPLE_RECORDS = 800
SAMPLE_BYTES = 8_000
DICTIONARY_BYTES = 64 * 1024
ARCHIVE_RECORDS = 10_000
ARCHIVE_BYTES = 32 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None, date: str, size: int | None = None) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head and payload, or a revisit with the
    head alone, of a payload of `size` bytes."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}")
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"none:{uri}:{digest}") if page_id is None else name(page_id)
    size = len(payload) if payload is not None else size
    head = HTTP % size
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(size)),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{name(refers_to)}>"), ("X-Refers-To-Page", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def frames(archive: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, end, skippable) of each frame, from the headers of frames and blocks."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if int.from_bytes(view[at : at + 4], "little") in SKIPPABLE:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            yield at, end, True
            at = end
            continue
        params = zstandard.get_frame_parameters(bytes(view[at : at + 18]))
        end = at + zstandard.frame_header_size(bytes(view[at : at + 18]))
        last = 0
        while not last:
            block = int.from_bytes(view[end : end + 3], "little")
            last = block & 1
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += 4 * params.has_checksum
        yield at, end, False
        at = end


def parse(raw: bytes) -> dict:
    """A record's fields and payload; raises ValueError if lengths or digest don't agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {"fields": fields, "payload": payload, "digest": digest}


def records(archive: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    plain = zstandard.ZstdDecompressor()
    for a, b, skippable in frames(archive):
        if not skippable:
            yield parse(plain.decompress(archive[a:b]))
        elif archive[a : a + 4] == DICTIONARY_MAGIC:
            plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[a + 8 : b]))


def train(pages: DataFrame, date: str, sample: int = SAMPLE_RECORDS) -> bytes:
    """A dictionary from the records of the first `sample` pages by a hash of their ids;
    of each the first SAMPLE_BYTES, which bounds what the driver holds."""
    some = [r["page_id"] for r in pages.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    html = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html")
    rows = pages.where(F.col("page_id").isin(some)).select("page_id", "url", html).limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["page_id"], r["url"] or "", r["html"]))
    cut = [record(r["page_id"], r["url"], p := r["html"].encode(), digest_of(p), None, date) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, cut).as_bytes()
    except zstandard.ZstdError:
        return b""


def archived(records: Iterator[bytes], dictionary: bytes, press: zstandard.ZstdCompressor, most_rows: int = ARCHIVE_RECORDS, most_bytes: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Rows of the records: most_rows to an archive, the dictionary first in each."""
    rows = size = 0
    for plain in records:
        if not rows and dictionary:
            yield DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary
            rows, size = 1, len(dictionary)
        frame = press.compress(plain)
        yield frame
        rows, size = rows + 1, size + len(frame)
        if size >= most_bytes:
            yield from (b"" for _ in range(most_rows - rows))
            rows = most_rows
        if rows == most_rows:
            rows = size = 0


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", min_dedup: int = 0, level: int = 3, most_rows: int = ARCHIVE_RECORDS, most_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all pages (page_id, url, html) into a new folder."""
    spark = pages.sparkSession
    common.ship(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    each = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    each = each.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    key = F.xxhash64("page_id", "sha").alias("key")
    known = common.stash(each.select("page_id", "url", "sha", F.octet_length("html").cast("bigint").alias("size"), key), even=True)
    big = known.where(F.col("size") >= min_dedup)
    groups = common.stash(big.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha", "keeper"))
    revisits = common.stash(big.join(groups, "sha").where(~F.col("page_id").eqNullSafe(F.col("keeper"))))
    first = spark.sparkContext.broadcast(bitmaps.bitmap(revisits.select("key")))
    in_first = lambda batch, at: bitmaps.present(first.value, batch.column(at).to_numpy(zero_copy_only=False))
    others = revisits.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha")).distinct()
    apart = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha"))
    responses = known.join(others, apart, "left_anti").select("key")
    wrong = common.in_arrow(responses, lambda batches: (b.filter(pa.array(in_first(b, 0))) for b in batches), "key bigint")
    second = spark.sparkContext.broadcast(bitmaps.bitmap(wrong))
    in_second = lambda batch, at: bitmaps.present(second.value, batch.column(at).to_numpy(zero_copy_only=False))
    dictionary = train(pages, date)

    def written(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
        rows, size = [], 0
        for row in archived(records, dictionary, press, most_rows, most_bytes):
            rows.append(row)
            size += len(row)
            if size > common.BATCH_BYTES or len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    def response(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page, url, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                payload = text.as_py().encode()
                yield record(page.as_py(), url.as_py(), payload, digest_of(payload), None, date)

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return written(response(b.filter(pa.array(~in_first(b, 3))) for b in batches))

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.filter(pa.array(in_first(b, 3) & in_second(b, 3))) for b in batches)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return written(response(batches))

    def revisit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[bytes]:
            for batch in batches:
                for page, url, sha, size, keeper in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    yield record(page, url, None, base64.b32encode(bytes.fromhex(sha)).decode(), keeper, date, size)

        return written(plain())

    shape = each.select("page_id", "url", "html", key, "sha")
    left = common.in_arrow(shape, open_, shape.schema).repartition("page_id", "sha")
    left = left.join(others, apart, "left_anti").select("page_id", "url", "html")
    out = common.in_arrow(shape, sure, "value binary").union(common.in_arrow(left, settled, "value binary"))
    out = out.union(common.in_arrow(revisits.select("page_id", "url", "sha", "size", "keeper"), revisit, "value binary"))
    rows = out.select(F.col("value").cast("string"))
    rows.write.option("lineSep", SPACER.decode("latin1")).option("maxRecordsPerFile", most_rows).text(folder)
    for x in (first, second):
        x.destroy()
    for t in (known, groups, revisits):
        common.discard(t)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives of a folder: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to and payload (null for revisits)."""
    common.ship(spark)
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                for r in records(archive.as_py()):
                    if len(rows) == 200:
                        yield table(rows)
                        rows.clear()
                    f = r["fields"]
                    response = f["WARC-Type"] == "response"
                    rows.append((number(f.get("X-Page-Id")), f["WARC-Target-URI"], f["WARC-Type"], int(f["X-Payload-Length"]), r["digest"], number(f.get("X-Refers-To-Page")), r["payload"] if response else None))
                if rows:
                    yield table(rows)

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    files = spark.read.format("binaryFile").load(folder).select("content")
    return common.in_arrow(files, run, schema)
