"""Disks over grids: candidate cells, exact overlap areas, and area-weighted means per cluster and layer.

A grid has its corner (x0, y0) and signed cell sizes (sx, sy); row and column are floor((y - y0) / sy), floor((x - x0) / sx).
Overlap weights are made once per cluster and reused for every layer. All of it is column arithmetic inside the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Grid(NamedTuple):
    x0: float
    y0: float
    sx: float
    sy: float
    rows: int
    cols: int


#: A valid share of the disk from here on counts as full.
FULL = 1 - 1e-6
#: Overlaps below this share of their cell are floating-point slivers.
SLIVER = 1e-9
#: Grid values, over all layers, up to which a grid is broadcast (8 MB).
MOST_VALUES = 1_000_000


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres per degree of latitude and of longitude at a latitude, by the usual cosine series."""
    f = F.radians(lat)
    along = 111132.92 - 559.82 * F.cos(2 * f) + 1.175 * F.cos(4 * f) - 0.0023 * F.cos(6 * f)
    across = 111412.84 * F.cos(f) - 93.5 * F.cos(3 * f) + 0.118 * F.cos(5 * f)
    return along, across


def cell_of(x: Column, y: Column, grid: Grid) -> tuple[Column, Column]:
    """The row and column of the cell that holds a point; cells outside the grid get numbers too."""
    return F.floor((y - grid.y0) / grid.sy).cast("int"), F.floor((x - grid.x0) / grid.sx).cast("int")


def inside(row: Column, col: Column, grid: Grid) -> Column:
    return row.between(0, grid.rows - 1) & col.between(0, grid.cols - 1)


def _edges(points: list[tuple[Column, Column]]) -> Column:
    turn = points[1:] + points[:1]
    return F.array(*[F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")) for a, b in zip(points, turn, strict=True)])


def polygon_area(points: list[tuple[Column, Column]]) -> Column:
    """The area of a simple polygon from its corners in order."""
    return F.abs(F.aggregate(_edges(points), F.lit(0.0), lambda s, e: s + (e.ax * e.by - e.bx * e.ay) / 2))


def _turn(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)


def disk_overlap(points: list[tuple[Column, Column]], radius: Column) -> Column:
    """The exact area that a polygon shares with the disk of a radius around the origin.

    Each edge adds the signed area between it and the origin: the part of the edge inside the circle, from parameter t0 to
    t1, adds a triangle; the parts outside add sectors. Without a crossing t0 = t1 and the sectors join to one.
    """
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    keep = ("ax", "ay", "bx", "by")

    def quadratic(e: Column) -> Column:
        dx, dy = e.bx - e.ax, e.by - e.ay
        return F.struct(*[e[k].alias(k) for k in keep], (dx * dx + dy * dy).alias("a"), (e.ax * dx + e.ay * dy).alias("b"), (e.ax * e.ax + e.ay * e.ay - radius * radius).alias("c"))

    def crossing(e: Column) -> Column:
        root = F.sqrt(F.greatest(F.lit(0.0), e.b * e.b - e.a * e.c))
        return F.struct(*[e[k].alias(k) for k in keep], clip((-e.b - root) / e.a).alias("t0"), clip((-e.b + root) / e.a).alias("t1"))

    def chord(e: Column) -> Column:
        at = lambda t, k: e[f"a{k}"] + t * (e[f"b{k}"] - e[f"a{k}"])
        return F.struct(*[e[k].alias(k) for k in keep], at(e.t0, "x").alias("px"), at(e.t0, "y").alias("py"), at(e.t1, "x").alias("qx"), at(e.t1, "y").alias("qy"))

    def area(s: Column, e: Column) -> Column:
        sectors = _turn(e.ax, e.ay, e.px, e.py) + _turn(e.qx, e.qy, e.bx, e.by)
        return s + (radius * radius * sectors + e.px * e.qy - e.qx * e.py) / 2

    chords = F.transform(F.transform(F.transform(_edges(points), quadratic), crossing), chord)
    return F.abs(F.aggregate(chords, F.lit(0.0), area))


def candidate_cells(clusters: DataFrame, grid: Grid, x: str, y: str, radius: str, key: str) -> DataFrame:
    """Every cell that the bounding box of a cluster's disk touches, in the grid or not; radius in metres, x and y in degrees."""
    along, across = metres_per_degree(F.col(y))
    df = clusters.withColumns({"_my": along, "_mx": across})
    high = cell_of(F.col(x) + F.col(radius) / F.col("_mx"), F.col(y) + F.col(radius) / F.col("_my"), grid)
    low = cell_of(F.col(x) - F.col(radius) / F.col("_mx"), F.col(y) - F.col(radius) / F.col("_my"), grid)
    span = lambda i: F.explode(F.sequence(F.least(low[i], high[i]), F.greatest(low[i], high[i])))
    return df.withColumn("row", span(0)).withColumn("col", span(1)).select(key, x, y, radius, "_mx", "_my", "row", "col")


def overlap_weights(clusters: DataFrame, grid: Grid, x: str, y: str, radius: str, key: str) -> DataFrame:
    """key, row, col, in_grid, area: the square metres that a cluster's disk shares with each cell; slivers go.

    A small cluster table fans out to many cells and layers, so it is dealt to tasks by key first; what follows by key
    needs no other shuffle.
    """
    parts = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = candidate_cells(clusters.repartition(parts, key), grid, x, y, radius, key)
    px = lambda i: (grid.x0 + (F.col("col") + i) * grid.sx - F.col(x)) * F.col("_mx")
    py = lambda i: (grid.y0 + (F.col("row") + i) * grid.sy - F.col(y)) * F.col("_my")
    corners = [(px(0), py(0)), (px(1), py(0)), (px(1), py(1)), (px(0), py(1))]
    # inline keeps the area out of the filter, which would otherwise work it out a second time
    area = F.inline(F.array(F.struct(disk_overlap(corners, F.col(radius)).alias("area"), polygon_area(corners).alias("_cell"))))
    areas = cells.select(key, "row", "col", inside(F.col("row"), F.col("col"), grid).alias("in_grid"), area)
    return areas.where(F.col("area") >= SLIVER * F.col("_cell")).select(key, "row", "col", "in_grid", "area")


def _met(weights: DataFrame, pixels: DataFrame, layers: list[tuple], names: list[str], key: str, grid: Grid | None) -> DataFrame:
    """Weights with the values of their cell in the order of the catalogue (_values), NULL where the cell has none.

    A cell is one row, so a weight meets it once. A grid of up to MOST_VALUES values is broadcast and the weights stay where
    overlap_weights dealt them; a larger one, or one of unknown size, is met by a shuffle on the cell. The weights, of which each
    cluster has many, are never broadcast: Spark takes their size from the small cluster table.
    """
    listed = pixels.sparkSession.range(1).select(F.posexplode(_catalogue(layers, names)).alias("_i", "_layer")).select("_i", *[F.col(f"_layer.{n}").alias(n) for n in names])
    known = pixels.where(F.col("value").between(0, 100) & (inside(F.col("row"), F.col("col"), grid) if grid else F.lit(True))).join(F.broadcast(listed), names)
    values = F.map_from_entries(F.collect_list(F.struct("_i", F.col("value").cast("double"))))
    cells = known.groupBy("row", "col").agg(F.transform(F.sequence(F.lit(0), F.lit(len(layers) - 1)), lambda i: F.element_at(values, i)).alias("_values"))
    cells = cells.select("row", "col", F.lit(True).alias("in_grid"), "_values")
    if grid and grid.rows * grid.cols * len(layers) <= MOST_VALUES:
        return weights.join(F.broadcast(cells), ["row", "col", "in_grid"], "left")
    return weights.join(cells.hint("merge"), ["row", "col", "in_grid"], "left").repartition(key)


def _catalogue(layers: list[tuple], names: list[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, layer, strict=True)]) for layer in layers])


def extract(weights: DataFrame, pixels: DataFrame, layers: list[tuple], names: list[str], key: str, grid: Grid | None = None) -> DataFrame:
    """The area-weighted mean of the valid pixels (value not NULL, 0 to 100) under each cluster's disk, for each layer.

    Returns one row per cluster and layer, with total_area, valid_fraction, n_cells, n_cells_valid, status (full, partial,
    missing) and reason. layers is the catalogue of grids, one tuple per grid; a layer has one pixel a cell. A weight gives a row
    a layer; one aggregate by cluster and layer follows.
    """
    met = _met(weights, pixels, layers, names, key, grid)
    empty = F.array_repeat(F.lit(None).cast("double"), len(layers))
    rows = met.select(key, "in_grid", "area", F.posexplode(F.coalesce("_values", empty)).alias("_i", "_v"))
    sums = rows.groupBy(key, "_i").agg(
        F.sum("area").alias("total_area"), F.count(F.lit(1)).alias("n_cells"), F.bool_or("in_grid").alias("_any"),
        F.sum(F.when(F.col("_v").isNotNull(), F.col("area"))).alias("_valid"), F.sum(F.col("area") * F.col("_v")).alias("_sum"), F.count("_v").alias("n_cells_valid"),
    )
    share = F.coalesce(F.col("_valid") / F.col("total_area"), F.lit(0.0))
    status = F.when(F.col("_valid").isNull(), "missing").when(share >= FULL, "full").otherwise("partial")
    reason = F.when(F.col("_valid").isNotNull(), F.when(share >= FULL, "").otherwise("incomplete")).when(F.col("_any"), "nodata").otherwise("outside_grid")
    layer = F.get(_catalogue(layers, names), F.col("_i"))
    return sums.select(
        key, *[layer[n].alias(n) for n in names], (F.col("_sum") / F.col("_valid")).alias("value"), status.alias("status"), reason.alias("reason"),
        F.least(share, F.lit(1.0)).alias("valid_fraction"), "total_area", "n_cells", "n_cells_valid",
    )


def extract_arrays(weights: DataFrame, pixels: DataFrame, layers: list[tuple], names: list[str], key: str, grid: Grid | None = None) -> DataFrame:
    """extract's value, whether its status is full, and its valid_fraction as one row a cluster: the arrays values, full and
    valid_fractions in the order of the catalogue, whose grids are few (each has two sums of its own)."""
    value = lambda i: F.get("_values", F.lit(i))
    places = range(len(layers))
    sums = _met(weights, pixels, layers, names, key, grid).groupBy(key).agg(
        F.sum("area").alias("_total"), *[F.sum(F.when(value(i).isNotNull(), F.col("area"))).alias(f"_valid_{i}") for i in places], *[F.sum(F.col("area") * value(i)).alias(f"_sum_{i}") for i in places],
    )
    share = lambda i: F.coalesce(F.col(f"_valid_{i}") / F.col("_total"), F.lit(0.0))
    full = lambda i: F.col(f"_valid_{i}").isNotNull() & (share(i) >= FULL)
    return sums.select(
        key, F.array(*[F.col(f"_sum_{i}") / F.col(f"_valid_{i}") for i in places]).alias("values"), F.array(*map(full, places)).alias("full"), F.array(*[F.least(share(i), F.lit(1.0)) for i in places]).alias("valid_fractions"),
    )
