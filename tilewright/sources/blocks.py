"""A store of rasters: blocks in Parquet along a curve that keeps neighbours together, so that a window reads few row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.blockwise import SIZE, gathered, keyed, morton, unpacked

#: Bytes of a row group: 128 blocks or so of 64 x 64 cells.
ROW_GROUP = 4 << 20


def write_raster(cells: DataFrame, path: str, size: int = SIZE, files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Cells (layer, band, r, c, value) as blocks of ``size`` x ``size``, dealt to files by layer, band and the curve, and sorted by it."""
    place, order = morton(F.col("brow"), F.col("bcol")), ["layer", "band", "morton"]
    # The cells are dealt, not the blocks, so that one shuffle does both and no sample of the ranges packs them.
    dealt = keyed(cells, size).withColumn("morton", place).repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    gathered(dealt).withColumn("morton", place).withColumn("size", F.lit(size)).write.option("parquet.block.size", row_group).option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1).parquet(path)


def read_blocks(spark: SparkSession, path: str, layer: str | None = None, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, size: int = SIZE) -> DataFrame:
    """The blocks that meet a window (first row, first column, rows, columns); the filters reach the row groups' statistics."""
    blocks = spark.read.parquet(path)
    if layer is not None:
        blocks = blocks.filter(F.col("layer") == layer)
    if bands is not None:
        blocks = blocks.filter(F.col("band").isin(bands))
    if window is not None:
        r0, c0, rows, cols = window
        a, b, c, d = r0 // size, (r0 + rows - 1) // size, c0 // size, (c0 + cols - 1) // size
        blocks = blocks.filter(F.col("brow").between(a, b) & F.col("bcol").between(c, d))
        # All blocks of a rectangle lie on the curve between its first and its last corner.
        first, last = (spark.range(1).select(morton(F.lit(x), F.lit(y)).alias("m")).first()["m"] for x, y in ((a, c), (b, d)))
        blocks = blocks.filter(F.col("morton").between(first, last))
    return blocks


def read_window(spark: SparkSession, path: str, r0: int, c0: int, rows: int, cols: int, layer: str | None = None, bands: list[int] | None = None, size: int = SIZE) -> DataFrame:
    """layer, band, r, c, value of the cells of a window."""
    cells = unpacked(read_blocks(spark, path, layer, bands, (r0, c0, rows, cols), size).drop("morton", "size"))
    return cells.filter(F.col("r").between(r0, r0 + rows - 1) & F.col("c").between(c0, c0 + cols - 1))
