"""Tile grids and the join of cells with the tiles that hold them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stride_of(size: int, overlap: float) -> int:
    """int(size * (1 - overlap)); a stride below 1 is an error."""
    s = int(size * (1 - overlap))
    if s < 1:
        raise ValueError(f"tiles of {size} with overlap {overlap} do not advance")
    return s


@dataclass(frozen=True)
class Axis:
    """Tile starts along one axis: the multiples of the stride that leave room, then the last tile flush with the end."""

    length: int
    tile: int
    stride: int

    @property
    def size(self) -> int:
        return min(self.tile, self.length)

    @property
    def regular(self) -> int:
        return max(1, (self.length - self.tile) // self.stride + 1) if self.length > self.tile else 1

    @property
    def last_is_extra(self) -> bool:
        return self.length > self.tile and (self.length - self.tile) % self.stride != 0

    @property
    def count(self) -> int:
        return self.regular + self.last_is_extra

    def start(self, ordinal: Column) -> Column:
        return F.least(ordinal * self.stride, F.lit(max(0, self.length - self.tile)))

    def ordinals(self, place: Column) -> Column:
        """Ordinals of the tiles that hold a place: an arithmetic set, so the join with tiles needs no range condition."""
        first = F.greatest(F.lit(0), F.ceil((place - self.size + 1) / F.lit(self.stride)))
        last = F.least(F.lit(self.regular - 1), F.floor(place / F.lit(self.stride)))
        regular = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
        if self.last_is_extra:
            return F.when(place >= self.length - self.tile, F.concat(regular, F.array(F.lit(self.regular).cast("long")))).otherwise(regular)
        return regular


@dataclass(frozen=True)
class Grid:
    rows: Axis
    cols: Axis

    @classmethod
    def of(cls, height: int, width: int, tile: int, overlap: float = 0.3) -> Grid:
        s = stride_of(tile, overlap)
        return cls(Axis(height, tile, s), Axis(width, tile, s))

    def index(self, row_ordinal: Column, col_ordinal: Column) -> Column:
        return row_ordinal * self.cols.count + col_ordinal


def tile_id(index: Column) -> Column:
    """tile_0000; five digits from 10000 on, so sort by index, never by id."""
    return F.format_string("tile_%04d", index)


def tiles(spark: SparkSession, grid: Grid) -> DataFrame:
    """tile_idx, tile_id, row_start, row_end, col_start, col_end in row-major order."""
    r, c = F.floor(F.col("id") / grid.cols.count), F.pmod("id", F.lit(grid.cols.count))
    t = spark.range(grid.rows.count * grid.cols.count).select(F.col("id").alias("tile_idx"), grid.rows.start(r).alias("row_start"), grid.cols.start(c).alias("col_start"))
    return t.select(
        "tile_idx", tile_id(F.col("tile_idx")).alias("tile_id"), "row_start", (F.col("row_start") + grid.rows.size).alias("row_end"), "col_start", (F.col("col_start") + grid.cols.size).alias("col_end"),
    )


def in_tiles(cells: DataFrame, grid: Grid) -> DataFrame:
    """Each cell (r, c, ...) once for every tile that holds it: tile_idx, then the cell's columns; tr, tc are its place in the tile."""
    placed = cells.withColumn("_ro", F.explode(grid.rows.ordinals(F.col("r")))).withColumn("_co", F.explode(grid.cols.ordinals(F.col("c"))))
    return placed.select(
        grid.index(F.col("_ro"), F.col("_co")).alias("tile_idx"), *cells.columns,
        (F.col("r") - grid.rows.start(F.col("_ro"))).alias("tr"), (F.col("c") - grid.cols.start(F.col("_co"))).alias("tc"),
    )


def bounds(tiles: DataFrame, a: float = 1.0, b: float = 0.0, x0: float = 0.0, d: float = 0.0, e: float = -1.0, y0: float = 0.0, mode: str = "edge") -> DataFrame:
    """World bounds of tiles under an affine transform; mode 'center' takes the centres of the corner cells, as registries of older runs do."""
    if mode not in ("edge", "center"):
        raise ValueError(f"no bounds mode {mode!r}")
    shift = 0.5 if mode == "center" else 0.0
    corners = [(F.col(c) + shift, F.col(r) + shift) for c in ("col_start", "col_end") for r in ("row_start", "row_end")]
    xs, ys = [a * c + b * r + x0 for c, r in corners], [d * c + e * r + y0 for c, r in corners]
    return tiles.select("*", F.least(*xs).alias("minx"), F.least(*ys).alias("miny"), F.greatest(*xs).alias("maxx"), F.greatest(*ys).alias("maxy"))


def blocks(cells: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """Cells with the block they belong to (brow, bcol) and, within ``halo`` of a border, once more for each neighbour block."""
    near = lambda x: F.sequence(F.floor((x - halo) / size), F.floor((x + halo) / size))
    spread = cells.withColumn("brow", F.explode(near(F.col("r")))).withColumn("bcol", F.explode(near(F.col("c"))))
    own = (F.floor(F.col("r") / size) == F.col("brow")) & (F.floor(F.col("c") / size) == F.col("bcol"))
    return spread.filter("brow >= 0 AND bcol >= 0").withColumn("own", own)
