"""Once-seen and twice-seen Bloom filters over any number of hashes.

The hashes are cut into segments by their value, and their number follows the data, so a filter has the same bits a key at
every size and nothing is broadcast. A task combines what it holds: a hash that it sees twice is a suspect at once and
only a mark of it moves; every other hash moves with its record to the task that owns its segment. The owner adds the
segment's hashes to a filter of once-seen ones and, where that has a hash already, to one of twice-seen ones; the records
whose hash is in the second filter are suspects. A hot hash so reaches its owner as one mark a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Hashes in a segment, on average; bits of a filter for each; bits set by one; records that a task combines at once.
SEGMENT_KEYS, KEY_BITS, PROBES, CHUNK = 1 << 18, 16, 4, 1 << 18
DEALT = "segment long, kind int, records binary"
#: Kinds of dealt records: to be judged, marks of suspects (hashes only), known suspects.
JUDGED, MARKS, SURE = 0, 1, 2


def segments_of(keys: int) -> int:
    return max(1, -(-keys // SEGMENT_KEYS))


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions in a filter, PROBES a hash."""
    out = []
    for i in range(PROBES):
        x = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * i)
        out.append((x >> np.uint64(33)) % np.uint64(bits))
    return np.stack(out, axis=1).astype(np.int64)


class Filters:
    """A once-seen and a twice-seen filter with room for so many keys."""

    def __init__(self, keys: int):
        self.bits = max(1 << 10, keys * KEY_BITS)
        self.once, self.twice = np.zeros(self.bits, bool), np.zeros(self.bits, bool)

    def add(self, hashes: np.ndarray) -> None:
        values, n = np.unique(hashes, return_counts=True)
        at = probes(values, self.bits)
        self.twice[at[(n > 1) | self.once[at].all(axis=1)]] = True
        self.once[at] = True

    def add_twice(self, hashes: np.ndarray) -> None:
        self.twice[probes(hashes, self.bits)] = True

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        return self.twice[probes(hashes, self.bits)].all(axis=1)


def _pieces(segment: np.ndarray, kind: int, records: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(segment, kind="stable")
    segment, records = segment[order], records[order]
    cuts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True]))) if len(segment) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(segment[a]), kind, records[a:b].tobytes()


def _chunk(records: np.ndarray, segments: int) -> pa.RecordBatch:
    records = records[np.argsort(records["hash"], kind="stable")]
    hashes = records["hash"]
    same = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    sure = same.copy()
    sure[:-1] |= same[1:]
    owner = lambda h: (h >> np.uint64(20)) % np.uint64(segments)
    marks = hashes[sure & ~same]
    pieces = [*_pieces(owner(hashes[~sure]), JUDGED, records[~sure]), *_pieces(owner(marks), MARKS, marks)]
    # known suspects need no owner, so they go anywhere
    pieces += _pieces(np.arange(int(sure.sum())) // 1024 * 7919 % segments, SURE, records[sure])
    columns = list(zip(*pieces, strict=True)) if pieces else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["segment", "kind", "records"])


def dealt(arrays: Iterator[np.ndarray], segments: int) -> Iterator[pa.RecordBatch]:
    """Batches (DEALT) of records, which have a field hash, in chunks of bounded size."""
    held: list[np.ndarray] = []
    for records in arrays:
        held.append(records)
        if sum(map(len, held)) >= CHUNK:
            yield _chunk(np.concatenate(held), segments)
            held = []
    if held:
        yield _chunk(np.concatenate(held), segments)


def suspects(records: DataFrame, kind: np.dtype, columns: Callable[[np.ndarray], pa.RecordBatch], ddl: str) -> DataFrame:
    """The dealt records (DEALT, of this kind) whose hash is in their segment's twice-seen filter, as columns makes rows of them."""

    def judged(parts: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate([np.empty(0, kind), *parts])
        filters = Filters(len(rows) + sum(map(len, marks)))
        for hashes in marks:
            filters.add_twice(hashes)
        for part in parts:
            filters.add(part["hash"])
        return columns(rows[filters.suspects(rows["hash"])])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, parts, marks = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                at, what, data = (batch.column(c)[i].as_py() for c in range(3))
                if at != segment:
                    if parts:
                        yield judged(parts, marks)
                    segment, parts, marks = at, [], []
                if what == SURE:
                    yield columns(np.frombuffer(data, kind))
                elif what == MARKS:
                    marks.append(np.frombuffer(data, np.uint64))
                else:
                    parts.append(np.frombuffer(data, kind))
        if parts:
            yield judged(parts, marks)

    return records.repartition("segment").sortWithinPartitions("segment").mapInArrow(own, ddl)
