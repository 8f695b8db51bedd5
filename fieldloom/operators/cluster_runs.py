"""Whole clusters as arrays: rows are dealt by cluster and sorted once, and a task works on runs of whole clusters.

What a task returns does not grow with its rows, so a family of models costs one shuffle of the rows, however many models
there are. Clusters are units of fieldwork and bounded; one of them is held in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a run; the last cluster may make it longer.
RUN = 1 << 16
#: Column of the cluster in dealt rows.
CLUSTER = "_c"


def number(x: str) -> F.Column:
    """A double; NaN is missing, like null."""
    return F.nanvl(F.col(x).cast("double"), F.lit(None))


def values(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers with NaN for null; booleans with false for null."""
    if pa.types.is_boolean(column.type):
        return column.fill_null(False).to_numpy().astype(bool)
    return np.asarray(column.cast(pa.float64()).to_numpy(), dtype=float) if column.null_count == 0 else np.asarray(column.cast(pa.float64()).fill_null(float("nan")).to_numpy(), dtype=float)


def _starts(table: pa.Table) -> np.ndarray:
    """Where a cluster begins in sorted rows."""
    c = table.column(CLUSTER).combine_chunks()
    if not len(c):
        return np.zeros(0, dtype=np.int64)
    new = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(new) + 1]


def whole_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of rows that hold whole clusters, and the first row of each cluster."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < RUN:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield table.slice(0, cut), starts[:-1]
            held, n = table.slice(cut).to_batches(), n - cut
    if n:
        table = pa.Table.from_batches(held)
        yield table, _starts(table)


def dealt(rows: DataFrame, work: Callable[[Iterator[tuple[pa.Table, np.ndarray]]], Iterator[dict]], ddl: str, *after: F.Column) -> DataFrame:
    """work on each task's runs; it yields rows of ddl as dicts of columns' lists. after: what the runs hold, if not the rows as they are."""
    from pyspark.sql.types import StructType

    held = rows.repartition(CLUSTER)
    held = (held.select(*after) if after else held).sortWithinPartitions(CLUSTER)
    schema = StructType.fromDDL(ddl)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for columns in work(whole_clusters(batches)):
            yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    return held.mapInArrow(run, schema)


def arrays(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays of a column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, dtype=float).ravel()))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def added(table: DataFrame, work: Callable[[pa.RecordBatch], Iterator[tuple[tuple, np.ndarray]]], keys: str) -> dict[tuple, np.ndarray]:
    """The sums of vectors by key, which work yields for each batch of rows: added up in every task, then over tasks. keys: their DDL."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"{keys}, v array<double>")
    names = schema.names[:-1]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, v in work(batch):
                found[key] = found[key] + v if key in found else v
        for key, v in found.items():
            yield pa.RecordBatch.from_pydict({**{k: [x] for k, x in zip(names, key, strict=True)}, "v": [v.tolist()]}, schema=to_arrow_schema(schema))

    each = table.mapInArrow(run, schema).select(*names, F.posexplode("v").alias("at", "x")).groupBy(*names, "at").agg(F.sum("x").alias("x"))
    out: dict[tuple, dict[int, float]] = {}
    for *key, at, x in each.collect():
        out.setdefault(tuple(key), {})[at] = x
    return {key: np.array([v[i] for i in range(len(v))]) for key, v in out.items()}


class Part:
    """The rows of a run that one model uses, by cluster: x holds columns as differences from their cluster's mean."""

    def __init__(self, mask: np.ndarray, of_cluster: np.ndarray):
        """of_cluster: the number of each row's cluster in the run."""
        self.rows = np.flatnonzero(mask)
        c = of_cluster[self.rows]
        self.starts = np.r_[0, np.flatnonzero(c[1:] != c[:-1]) + 1] if len(c) else np.zeros(0, dtype=np.int64)
        self.sizes = np.diff(np.r_[self.starts, len(c)])

    @property
    def n(self) -> int:
        return len(self.rows)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts, axis=-1)

    def spread_out(self, x: np.ndarray) -> np.ndarray:
        return np.repeat(x, self.sizes, axis=-1)

    def varying(self, x: np.ndarray) -> int:
        """Clusters in which x takes two values."""
        return int((np.minimum.reduceat(x, self.starts) < np.maximum.reduceat(x, self.starts)).sum())


def cluster_numbers(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
