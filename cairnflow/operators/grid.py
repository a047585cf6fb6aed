"""Gridded data: cells in long form (layer, row, col, value) with a small description of the grid.

Row 0 is the northern edge. Everything is relational: cropping is a filter on row and col that reaches the scan, masking
a join on cells, resampling a join on the source cells that a target cell needs. Cells that a step empties stay as rows
with a null value, so that the grid stays whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.projections import LonLat, Projection, transform


@dataclass(frozen=True)
class Extent:
    xmin: float
    xmax: float
    ymin: float
    ymax: float

    def buffered(self, dx: float, dy: float) -> Extent:
        return Extent(self.xmin - dx, self.xmax + dx, self.ymin - dy, self.ymax + dy)

    def within(self, other: Extent) -> Extent | None:
        """The common part, or None."""
        e = Extent(max(self.xmin, other.xmin), min(self.xmax, other.xmax), max(self.ymin, other.ymin), min(self.ymax, other.ymax))
        return e if e.xmin < e.xmax and e.ymin < e.ymax else None


@dataclass(frozen=True)
class Grid:
    """Shape, place and projection of cells, their data type, layers' names, and labels and colours of values."""

    nrow: int
    ncol: int
    extent: Extent
    projection: Projection = field(default_factory=LonLat)
    datatype: str | None = None
    names: tuple[str, ...] = ("layer",)
    levels: tuple[tuple[int, str], ...] = ()
    colours: tuple[tuple[int, str], ...] = ()

    @property
    def xres(self) -> float:
        return (self.extent.xmax - self.extent.xmin) / self.ncol

    @property
    def yres(self) -> float:
        return (self.extent.ymax - self.extent.ymin) / self.nrow

    def x(self, col: Column | str = "col") -> Column:
        """X of cell centres."""
        c = F.col(col) if isinstance(col, str) else col
        return F.lit(self.extent.xmin) + (c + F.lit(0.5)) * F.lit(self.xres)

    def y(self, row: Column | str = "row") -> Column:
        c = F.col(row) if isinstance(row, str) else row
        return F.lit(self.extent.ymax) - (c + F.lit(0.5)) * F.lit(self.yres)

    def col_at(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.extent.xmin)) / F.lit(self.xres)).cast("int")

    def row_at(self, y: Column) -> Column:
        return F.floor((F.lit(self.extent.ymax) - y) / F.lit(self.yres)).cast("int")

    def same_cells(self, other: Grid) -> bool:
        return (self.nrow, self.ncol, self.extent, self.projection) == (other.nrow, other.ncol, other.extent, other.projection)


def window(grid: Grid, extent: Extent) -> tuple[int, int, int, int] | None:
    """(first row, last row, first col, last col) of cells whose centre lies in the extent; None if none does."""
    c0 = max(0, math.ceil((extent.xmin - grid.extent.xmin) / grid.xres - 0.5))
    c1 = min(grid.ncol - 1, math.floor((extent.xmax - grid.extent.xmin) / grid.xres - 0.5))
    r0 = max(0, math.ceil((grid.extent.ymax - extent.ymax) / grid.yres - 0.5))
    r1 = min(grid.nrow - 1, math.floor((grid.extent.ymax - extent.ymin) / grid.yres - 0.5))
    return (r0, r1, c0, c1) if r0 <= r1 and c0 <= c1 else None


def crop(cells: DataFrame, grid: Grid, extent: Extent, buffer_cells: int = 0) -> tuple[DataFrame, Grid]:
    """The part of the grid in the extent, with rows and cols from 0 again; an empty grid if there is none."""
    if buffer_cells:
        extent = extent.buffered(buffer_cells * grid.xres, buffer_cells * grid.yres)
    found = window(grid, extent)
    if not found:
        return cells.where(F.lit(False)), replace(grid, nrow=0, ncol=0, extent=Extent(extent.xmin, extent.xmin, extent.ymin, extent.ymin))
    r0, r1, c0, c1 = found
    e = grid.extent
    part = Extent(e.xmin + c0 * grid.xres, e.xmin + (c1 + 1) * grid.xres, e.ymax - (r1 + 1) * grid.yres, e.ymax - r0 * grid.yres)
    inside = cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    moved = inside.withColumns({"row": (F.col("row") - r0).cast("int"), "col": (F.col("col") - c0).cast("int")})
    return moved, replace(grid, nrow=r1 - r0 + 1, ncol=c1 - c0 + 1, extent=part)


def mask(cells: DataFrame, by: DataFrame) -> DataFrame:
    """Cells whose mask cell (row, col, value) is null or absent lose their value."""
    there = by.where("value is not null").select("row", "col").distinct().withColumn("__in", F.lit(True))
    joined = cells.join(there, ["row", "col"], "left")
    return joined.withColumn("value", F.when(F.col("__in"), F.col("value"))).select(*cells.columns)


def all_cells(spark, grid: Grid) -> DataFrame:
    """(row, col) of every cell of a grid, made where it is needed."""
    n = spark.range(grid.nrow * grid.ncol)
    return n.select(F.floor(F.col("id") / grid.ncol).cast("int").alias("row"), (F.col("id") % grid.ncol).cast("int").alias("col"))


def _source_place(grid: Grid, target: Grid) -> tuple[Column, Column]:
    return transform(target.x(), target.y(), target.projection, grid.projection)


def resample_nearest(cells: DataFrame, grid: Grid, target: Grid) -> DataFrame:
    """Each target cell gets the value of the source cell that its centre falls in, null outside."""
    x, y = _source_place(grid, target)
    want = all_cells(cells.sparkSession, target).select("row", "col", grid.row_at(y).alias("__r"), grid.col_at(x).alias("__c"))
    source = cells.select("layer", F.col("row").alias("__r"), F.col("col").alias("__c"), "value")
    return _by_layer(want, source, cells).select("layer", "row", "col", "value")


def _by_layer(want: DataFrame, source: DataFrame, cells: DataFrame) -> DataFrame:
    layers = cells.select("layer").distinct()
    return want.join(F.broadcast(layers)).join(source, ["layer", "__r", "__c"], "left")  # a grid has few layers


def resample_bilinear(cells: DataFrame, grid: Grid, target: Grid) -> DataFrame:
    """The weighted mean of the four nearest source cells; null where one of them that has weight is null or outside."""
    x, y = _source_place(grid, target)
    fx = (x - F.lit(grid.extent.xmin)) / F.lit(grid.xres) - F.lit(0.5)
    fy = (F.lit(grid.extent.ymax) - y) / F.lit(grid.yres) - F.lit(0.5)
    want = all_cells(cells.sparkSession, target).select("row", "col", F.floor(fy).cast("int").alias("r"), F.floor(fx).cast("int").alias("c"), fx.alias("fx"), fy.alias("fy"))
    wx, wy = F.col("fx") - F.col("c"), F.col("fy") - F.col("r")
    corner = lambda dr, dc, w: F.struct((F.col("r") + dr).alias("__r"), (F.col("c") + dc).alias("__c"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - wx) * (1 - wy)), corner(0, 1, wx * (1 - wy)), corner(1, 0, (1 - wx) * wy), corner(1, 1, wx * wy))
    parts = want.select("row", "col", F.explode(corners).alias("k")).select("row", "col", "k.*").where("w > 0")
    source = cells.select("layer", F.col("row").alias("__r"), F.col("col").alias("__c"), "value")
    joined = _by_layer(parts, source, cells)
    whole = F.when(F.count("value") == F.count("*"), F.sum(F.col("value") * F.col("w")))
    return joined.groupBy("layer", "row", "col").agg(whole.alias("value"))


#: Data types of whole numbers, then of others, in the order in which they are tried (unsigned ones before
#: signed ones), with the smallest and the largest value of each.
INTEGER_TYPES = (
    ("INT1U", 0, 255),
    ("INT2U", 0, 65534),
    ("INT4U", 0, 4294967296),
    ("INT1S", -127, 127),
    ("INT2S", -32767, 32767),
    ("INT4S", -2147483647, 2147483647),
)
FLOAT_TYPES = (("FLT4S", -3.4e38, 3.4e38),)
#: For each: the name in the gdal tools, and how values are resampled.
GDAL_NAMES = {
    "LOG1S": "Byte",
    "INT1S": "Int16",
    "INT1U": "Byte",
    "INT2S": "Int16",
    "INT2U": "UInt16",
    "INT4S": "Int32",
    "INT4U": "UInt32",
    "FLT4S": "Float32",
    "FLT8S": "Float64",
}


def resampling_method(datatype: str) -> str:
    return "bilinear" if datatype.startswith("FLT") else "near"


def datatype_of(low: Column, high: Column, whole: Column, binary: Column) -> Column:
    """The smallest data type that holds values from ``low`` to ``high``: unsigned where nothing is negative."""
    chosen = F.when(low.isNull() | binary, "LOG1S")
    for name, a, b in INTEGER_TYPES:
        chosen = chosen.when(whole & (low >= a) & (high <= b), name)
    for name, a, b in FLOAT_TYPES:
        chosen = chosen.when((low >= a) & (high <= b), name)
    return chosen.otherwise("FLT8S")


def datatypes(cells: DataFrame) -> DataFrame:
    """(layer, low, high, datatype) by one exact aggregation; nulls and NaN don't count."""
    v = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    finite = F.abs(v) < F.lit(float("inf"))
    stats = cells.groupBy("layer").agg(
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.coalesce(F.bool_and(F.when(v.isNotNull(), finite & (F.floor(F.when(finite, F.least(F.greatest(v, F.lit(-1e15)), F.lit(1e15)))) == v))), F.lit(True)).alias("whole"),
        F.coalesce(F.bool_and(F.when(v.isNotNull(), v.isin(0.0, 1.0))), F.lit(True)).alias("binary"),
    )
    return stats.select("layer", "low", "high", datatype_of(F.col("low"), F.col("high"), F.coalesce("whole", F.lit(False)), F.col("binary")).alias("datatype"))


def min_max(cells: DataFrame) -> DataFrame:
    return cells.groupBy("layer").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def values(cells: DataFrame, layer: int = 0) -> DataFrame:
    """Values of one layer in cell order."""
    return cells.where(F.col("layer") == layer).orderBy("row", "col").select("row", "col", "value")


def n_layers(grid: Grid) -> int:
    return len(grid.names)


def with_colours(grid: Grid, low: float, high: float) -> Grid:
    """The colours of the values that are left after a crop."""
    return replace(grid, colours=tuple((v, c) for v, c in grid.colours if low <= v <= high))


def from_table(df: DataFrame, layer: int, row: Column, col: Column, value: Column) -> DataFrame:
    return df.select(F.lit(layer).alias("layer"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("double").alias("value"))
