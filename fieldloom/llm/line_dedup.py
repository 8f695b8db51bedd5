"""Line deduplication across documents with two Bloom filters.

The hash of every long line goes through a once-seen and a twice-seen Bloom filter, cut into segments that tasks own (see
bloom). Only lines whose hash is in the twice-seen filter are suspects; only these move on, as 16-byte digests, for the
exact count and the choice of the document that keeps the line. The filters grow with the lines and are never broadcast.

Defined cases: a null or empty text is one empty line, which is never dropped. Documents count by row, so repeated rows
count each and all keep the lines that their doc_id keeps. A null doc_id never outranks another; a line that only such
rows hold stays. A key counts once a document. Other columns may have any names; empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import BROADCAST_ROWS, attach, named_join, written

SPACE = b" \t\n\x0b\x0c\r"
DIGEST = 16
#: A line's digest (hash and rest), and the document that holds it; none: its doc_id is null.
LINE = np.dtype([("hash", np.uint64), ("rest", np.uint64), ("id", np.int64), ("text_hash", np.int64), ("none", bool)])


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key (stripped, A-Z lower-cased), or None if the key is too short to count."""
    key = line.strip(SPACE)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars:
        return None
    return hashlib.blake2b(key.lower(), digest_size=DIGEST).digest()


def line_records(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """The distinct long lines of every document, dealt to the owners of their hashes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = bloom.segments_of(size // (min_chars + 1))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for doc_id, text_hash, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    keys = {d for line in (text or b"").split(b"\n") if (d := line_digest(line, min_chars))}
                    if keys:
                        out = np.zeros(len(keys), LINE)
                        halves = np.frombuffer(b"".join(sorted(keys)), np.uint64)
                        out["hash"], out["rest"], out["id"], out["text_hash"], out["none"] = halves[::2], halves[1::2], doc_id or 0, text_hash, doc_id is None
                        yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    return rows.mapInArrow(lambda batches: bloom.dealt(records(batches), segments), bloom.DEALT)


def _lines(records: np.ndarray) -> pa.RecordBatch:
    keys = np.ascontiguousarray(np.stack([records["hash"], records["rest"]], axis=1)).tobytes()
    key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(records), [None, pa.py_buffer(keys)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(records["id"], pa.int64(), mask=records["none"]), pa.array(records["text_hash"], pa.int64()), key], names=["id", "text_hash", "key"])


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """id, text_hash and gone: the digests of the lines that the document loses."""
    found = written(bloom.suspects(line_records(docs, min_chars), LINE, _lines, "id long, text_hash long, key binary"), "line-suspects")
    counted = found.groupBy("key").agg(F.count(F.lit(1)).alias("group_rows"), F.max("id").alias("keeper")).where((F.col("group_rows") >= min_docs) & F.col("keeper").isNotNull())
    counted = written(counted, "line-repeats")
    lost = attach(found, counted, "key", F.struct("id", "text_hash"), found.count(), "inner").where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id", "text_hash").agg(F.collect_set("key").alias("gone"))


def with_lost_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """row (all columns of docs) and gone, the digests of the lines that each document loses (null: none)."""
    lost = written(repeated_lines(docs, min_chars, min_docs), "line-lost")
    n, keys = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    side = F.broadcast(lost) if n <= BROADCAST_ROWS and keys <= 5 * BROADCAST_ROWS else lost.hint("shuffle_hash")
    return named_join(docs, side).select("row", "gone")


def cut(text: bytes | None, gone: list[bytes] | None, min_chars: int = 40) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, the text that is left."""
    text = text or b""
    if not gone:
        return text.count(b"\n") + 1, 0, text
    lines, gone = text.split(b"\n"), set(gone)
    kept = [x for x in lines if line_digest(x, min_chars) not in gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [cut(t, g, min_chars) for t, g in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array([x for x, _, _ in made], pa.int64()), pa.array([x for _, x, _ in made], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for _, _, x in made])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = with_lost_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), min_chars, min_docs)
    return rows.select("row.doc_id", "row.text", "gone").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the repeated lines cut out of text; columns stay as they are."""

    @F.pandas_udf("string")
    def kept(text: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if g is None else cut(t.encode(), list(g), min_chars)[2].decode() for t, g in zip(text, gone, strict=True)], dtype=object)

    left = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept("row.text", "gone"))
    marked = with_lost_lines(docs, min_chars, min_docs).select("row", left.alias("left"))
    return marked.select(*[F.col("left").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
