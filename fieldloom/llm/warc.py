"""WARC archives: records written with an index, and read back by byte ranges.

Every record is a gzip member of its own. Writing makes, with each archive, the index: archive, offset, length, URL and
digest of each record. Reading starts from the index: the selected records of an archive are sorted by offset, ranges with
small gaps are coalesced, and one read serves each run. Archives live in a folder that all executors reach through
Arrow's file systems; each attempt of a task writes a file under a name of its own, and only the names that a finished
attempt returned are in the index, so a lost or repeated task leaves an orphan file at most.

Defined cases: a null html is an empty payload, a null url an empty target. Of records with equal payloads those with the
largest page_id are responses (all of them, if rows repeat that page_id) and the others are revisits. A null page_id
never outranks another; where all are null, all are responses. Payloads below min_bytes are never revisits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, shared_dir, written

#: Bytes of records in an archive; ranges with gaps up to GAP are read at once, up to RUN bytes.
ARCHIVE, GAP, RUN = 64 << 20, 64 << 10, 8 << 20
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, compressed."""
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}", "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lower-cased) and block of a compressed record."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def _page(urn: str) -> int | None:
    return int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in folder; returns their index, written to the shared folder too."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("key", F.sha2("html", 256))
    same = written(keyed.select("page_id", "key", F.octet_length("html").alias("n")), "warc-digests")
    groups = written(same.groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("group_rows"), F.max("n").alias("n")).where("group_rows > 1"), "warc-groups")
    judged = attach(keyed, groups, "key", F.struct("page_id", "url"), same.count())
    revisit = (F.col("n") >= min_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    judged = judged.select("page_id", "url", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(revisit, F.col("keeper")).alias("refers_to"), "html")
    return written(judged.mapInArrow(_writer(folder), INDEX), "warc-index")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            index: list[tuple] = []
            for start in range(0, batch.num_rows, 500):
                for page_id, url, revisit, refers_to, html in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns), strict=True):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        fs.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    digest = base32_digest(payload)
                    data = record(page_id, url, payload, digest, refers_to, revisit)
                    out.write(data)
                    index.append((name, at, len(data), url, digest, page_id, "revisit" if revisit else "response"))
                    at += len(data)
            columns = list(zip(*index, strict=True)) if index else [()] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return run


def runs(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Positions of sorted (offset, length) ranges that one read serves."""
    out: list[list[int]] = []
    for i, (offset, length) in enumerate(ranges):
        if out and offset - sum(ranges[out[-1][-1]]) <= GAP and offset + length - ranges[out[-1][0]][0] <= RUN:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of index name: page_id, url, record_type, payload_digest, payload_bytes, refers_to, block (null for a revisit)."""
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            names, offsets, lengths = (c.to_pylist() for c in batch.columns)
            start = 0
            while start < len(names):
                end = start
                while end < len(names) and names[end] == names[start]:
                    end += 1
                with fs.open_input_file(f"{root}/{names[start]}") as f:
                    ranges = list(zip(offsets[start:end], lengths[start:end], strict=True))
                    for some in runs(ranges):
                        first = ranges[some[0]][0]
                        data = f.read_at(sum(ranges[some[-1]]) - first, first)
                        yield _parsed([data[ranges[i][0] - first : sum(ranges[i]) - first] for i in some])
                start = end

    # the index is small next to what it names, so the number of tasks follows the archives
    tasks = index.agg(F.greatest(F.lit(1), F.countDistinct("archive"), F.ceil(F.sum("length") / ARCHIVE)).cast("int")).first()[0]
    wanted = index.select("archive", "offset", "length").repartition(tasks, "archive").sortWithinPartitions("archive", "offset")
    return wanted.mapInArrow(run, schema)


def _parsed(records: list[bytes]) -> pa.RecordBatch:
    rows = []
    for data in records:
        fields, block = parse(data)
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and base32_digest(block) != digest:
            raise ValueError(f"damaged record {fields['warc-record-id']}")
        rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri", ""), kind, digest, int(fields["x-payload-length"]), _page(fields["warc-refers-to"]) if kind == "revisit" else None, block if kind == "response" else None))
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "block"])


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages and reads every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write_archives(pages, folder, min_bytes)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
