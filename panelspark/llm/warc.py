"""WARC archives with an index of their records (operator 11).

Writing: every task writes its pages as records of its own archives (a gzip member each, so that a record can be read
alone) and returns, for each record, file, offset, length, URL and digest. That index is written before anything is
read. Files of lost or repeated tasks are in no index. Of equal payloads one is stored (a response), the others are
revisit records that name it: digests are counted and matched on narrow rows, so payloads are not shuffled.

Reading: records are selected in the index. Their ranges, sorted in each file, are joined where less than GAP bytes lie
between them, up to RANGE bytes; each such range is one read, and tasks get about equal bytes of ranges.

Edge cases: a null payload is empty; a null URL leaves its header out and comes back null; control characters of a URL
are percent-encoded. Rows without page_id are written as responses, or as revisits of one that has an id. Rows that repeat the
least page_id of their payload are responses all, as no id tells them apart. Payloads of any size are whole in one
record, in memory one at a time. Extra columns are ignored; an empty table makes an index without rows. The folder must be one
that pyarrow's file systems open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import gzip
import hashlib
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, join_groups, materialize, with_ids

#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 100
#: An archive is closed when it has so many bytes; a window of the index has the records of one archive.
FILE_BYTES = 256 << 20
#: Ranges with at most so many bytes between them are read as one, and most bytes of a range before its last record.
GAP, RANGE = 64 << 10, 4 << 20
#: Bytes of ranges that a task reads, and revisits of one response that meet in a task.
TASK_BYTES, SALT_ROWS = 32 << 20, 10_000
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, digest string, payload_bytes long, refers_to long, payload binary"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


# --- records ----------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or the revisit record of a payload that the page refers_to has."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _safe(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Page-ID", page_id),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of a record (gzip member or plain), headers of its HTTP message, and the message's body."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    message, _, body = block.partition(b"\r\n\r\n")
    return fields, _headers(message), body


# --- writing ----------------------------------------------------------------------------------


def _shared(pages: DataFrame, tmp: Scratch) -> DataFrame:
    """page_id, digest and refers_to of the rows whose payload a row of smaller page_id has."""
    size = F.octet_length("payload")
    digests = tmp(pages.filter(size >= LEAST_SHARED).select("page_id", F.sha2("payload", 256).alias("digest")))
    groups = tmp(digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null"))
    found = join_groups(digests, groups, "digest", "n").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return tmp(found.select("page_id", "digest", "refers_to").distinct())


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of pages below folder and returns the index, INDEX, written to the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page, address, body, refers in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1))), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = fs.open_output_stream(f"{base}/{name}", compression=None), 0
                    info = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    at += out.write(gzip.compress(head.encode() + info + b"\r\n\r\n", 6, mtime=0))
                data = body.as_buffer().to_pybytes()
                digest = hashlib.sha256(data).hexdigest()
                member = gzip.compress(record(page, address, data, digest, refers), 6, mtime=0)
                out.write(member)
                rows.append((page, address, name, at, len(member), digest, len(data), "response" if refers is None else "revisit", refers))
                at += len(member)
            columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=_NAMES)
        if out is not None:
            out.close()

    long, text = pa.int64(), pa.string()
    types = [long, text, text, long, long, text, long, text, long]
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    with Scratch(pages.sparkSession) as tmp:
        # Ids and digests of revisits; a row without page_id is found by its digest alone.
        shared = _shared(rows, tmp)
        ids = shared.filter("page_id is not null")
        digest = F.when(F.octet_length("payload") >= LEAST_SHARED, F.sha2("payload", 256))
        known = with_ids(rows.filter("page_id is not null").withColumn("digest", digest), ids, "left", ["page_id", "digest"])
        no_id = with_ids(rows.filter("page_id is null").withColumn("digest", digest), shared.filter("page_id is null").select("digest", "refers_to"), "left", "digest")
        both = [x.select("page_id", "url", "payload", "refers_to") for x in (known, no_id)]
        return materialize(both[0].unionByName(both[1]).mapInArrow(write, INDEX))


# --- reading ----------------------------------------------------------------------------------


def ranges(selected: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """file, begin, end and records (offset, length; sorted) of the byte ranges that hold the selected index rows."""
    order = W.partitionBy("file").orderBy("offset")
    upto = F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = upto.isNull() | (F.col("offset") - upto > gap) | (F.floor(F.col("offset") / most) != F.floor(F.lag("offset", 1).over(order) / most))
    numbered = selected.select("file", "offset", "length").distinct().withColumn("new", new.cast("int"))
    numbered = numbered.withColumn("range", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("file", "range").agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    ).drop("range")


def read_records(selected: DataFrame, folder: str, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """The records of the selected index rows, RECORD, read from the archives; a revisit has no payload.

    selected must be cheap to read twice (a filter of the written index).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for span in batch.to_pylist():
                with fs.open_input_file(f"{base}/{span['file']}") as f:
                    data = f.read_at(span["end"] - span["begin"], span["begin"])
                rows = []
                for r in span["records"]:
                    at = r["offset"] - span["begin"]
                    fields, message, body = parse(data[at : at + r["length"]])
                    kind, page, refers = fields["warc-type"], fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    rows.append((
                        None if page is None else int(page), fields.get("warc-target-uri"), kind, fields["warc-payload-digest"].partition(":")[2],
                        int(message["content-length"]), None if refers is None else int(refers), body if kind == "response" else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    total = selected.agg(F.sum("length")).first()[0] or 0
    parts = max(selected.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    # The spans are small rows, so they are dealt by count here; else they would be put into one partition.
    return ranges(selected, gap, most).repartition(parts).mapInArrow(read, RECORD)


def digest_of(payload: Column) -> Column:
    return F.sha2(payload, 256)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload of what they refer to; a response of many revisits is repeated, once a SALT_ROWS of them.

    records must be cheap to read several times (materialized), and hold the responses.
    """
    own = records.filter("record_type = 'response'")
    again = records.filter("record_type = 'revisit'").drop("payload")
    groups = again.groupBy("refers_to").agg(F.count("*").alias("n"))
    stored = own.select(F.col("page_id").alias("refers_to"), F.col("digest").alias("_digest"), "payload").join(groups, "refers_to")
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS)).cast("int")
    spread = stored.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salted = join_groups(again, groups, "refers_to", "n").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int"))
    found = salted.join(spread.drop("n"), ["refers_to", "salt"]).filter(F.col("_digest") == F.col("digest")).drop("salt", "n", "_digest")
    return own.unionByName(found.select(*own.columns))


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page: archived, then read back whole.

    What a response says comes from the payload that was read, what a revisit says from its record.
    """
    with Scratch(pages.sparkSession) as tmp:
        folder = tmp.folder()
        records = read_records(archive(pages, folder), folder)
        own = F.col("record_type") == "response"
        return materialize(records.select(
            "page_id", F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
            F.when(own, digest_of(F.col("payload"))).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
        ))
