"""Rasters as tables of square blocks: packing, unpacking, halo exchange and functions of whole blocks.

A block is one row with its cells as packed doubles, so neighbourhood operators work on arrays and only
strips along the borders go to other blocks. Cells that a raster lacks are marked in ``mask``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 64
#: r0, c0: the first cell; h, w: the extent of the cells that are there; mask: a bit for each cell, null if all are there.
BLOCKS = "layer string, band int, brow bigint, bcol bigint, r0 bigint, c0 bigint, h int, w int, data binary, mask binary"


KEY = ["layer", "band", "brow", "bcol"]


def keyed(cells: DataFrame, size: int) -> DataFrame:
    """Cells (layer, band, r, c, value) with the block that holds them."""
    k = cells.select("layer", F.col("band").cast("int").alias("band"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("value").cast("double").alias("value"))
    return k.withColumns({"brow": F.floor(F.col("r") / size), "bcol": F.floor(F.col("c") / size)})


def gathered(cells: DataFrame) -> DataFrame:
    """The blocks of keyed cells that come block after block: each block's cells in one partition, one after the other."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def blocks(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        r, c, v = (t[n].to_numpy() for n in ("r", "c", "value"))
        r0, c0 = np.minimum.reduceat(r, starts), np.minimum.reduceat(c, starts)
        h, w = np.maximum.reduceat(r, starts) - r0 + 1, np.maximum.reduceat(c, starts) - c0 + 1
        data, mask = [], []
        for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(r)], strict=True)):
            at = (r[i:j] - r0[k], c[i:j] - c0[k])
            a, there = np.zeros((h[k], w[k])), np.zeros((h[k], w[k]), bool)
            a[at], there[at] = v[i:j], True
            data.append(a.tobytes())
            mask.append(None if there.all() else np.packbits(there).tobytes())
        first = t.select(KEY).take(pa.array(starts)).combine_chunks()
        columns = [*(first[n] for n in KEY), pa.array(r0), pa.array(c0), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(data, pa.binary()), pa.array(mask, pa.binary())]
        return pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = []  # the batches since the last block's first cell
        for batch in batches:
            if batch.num_rows == 0:
                continue
            place, names = [batch[n].to_numpy() for n in KEY[1:]], batch["layer"].dictionary_encode()
            place.append(names.indices.fill_null(-1).to_numpy())
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in place])) + 1
            if begun and any(begun[-1][n][-1] != batch[n][0] for n in KEY):
                new = np.concatenate([[0], new])
            begun.append(batch)
            if len(new):
                before, cut = sum(x.num_rows for x in begun[:-1]), int(new[-1])
                if before + cut:
                    starts = new[:-1] + before
                    whole = pa.Table.from_batches([*begun[:-1], batch.slice(0, cut)])
                    yield blocks(whole, starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts]))
                begun = [batch.slice(cut)]
        if begun:
            yield blocks(pa.Table.from_batches(begun), np.zeros(1, int))

    return cells.select(*KEY, "r", "c", "value").mapInArrow(pack, BLOCKS)


def packed(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """The blocks of cells (layer, band, r, c, value); one row for each cell of a layer and band."""
    return gathered(keyed(cells, size).repartition(*KEY).sortWithinPartitions(*KEY))


def _arrays(r: dict) -> tuple[np.ndarray, np.ndarray]:
    h, w = r["h"], r["w"]
    there = np.ones((h, w), bool) if r["mask"] is None else np.unpackbits(np.frombuffer(r["mask"], np.uint8))[: h * w].reshape(h, w).astype(bool)
    return np.frombuffer(r["data"], np.float64).reshape(h, w), there


#: Cells of blocks that are given out together, at least.
CELLS = 1 << 17


def unpacked(blocks: DataFrame) -> DataFrame:
    """layer, band, r, c, value of the cells of blocks."""

    def cells(rows: list, parts: list) -> pa.RecordBatch:
        r, c, v = (np.concatenate([p[k] for p in parts]) for k in range(3))
        of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        layer, band = pa.array([x["layer"] for x in rows], pa.string()).take(pa.array(of)), pa.array([x["band"] for x in rows], pa.int32()).take(pa.array(of))
        return pa.RecordBatch.from_arrays([layer, band, pa.array(r), pa.array(c), pa.array(v)], ["layer", "band", "r", "c", "value"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts, n = [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                a, there = _arrays(r)
                i, j = np.nonzero(there)
                rows.append(r)
                parts.append((i + r["r0"], j + r["c0"], a[i, j]))
                n += len(i)
                if n >= CELLS:
                    yield cells(rows, parts)
                    rows, parts, n = [], [], 0
        if rows:
            yield cells(rows, parts)

    return blocks.mapInArrow(read, "layer string, band int, r bigint, c bigint, value double")


def exchanged(blocks: DataFrame, size: int, halo: int) -> DataFrame:
    """Each block and the strips of others within ``halo`` cells of it, under its trow and tcol; own marks the block itself."""
    names = ["trow", "tcol", "own", "layer", "band", "r0", "c0", "h", "w", "data", "mask"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, there = _arrays(r)
                r0, c0 = r["r0"], r["c0"]
                out = []
                for trow in range(max(0, (r0 - halo) // size), (r0 + r["h"] - 1 + halo) // size + 1):
                    for tcol in range(max(0, (c0 - halo) // size), (c0 + r["w"] - 1 + halo) // size + 1):
                        i0, i1 = max(r0, trow * size - halo), min(r0 + r["h"], (trow + 1) * size + halo)
                        j0, j1 = max(c0, tcol * size - halo), min(c0 + r["w"], (tcol + 1) * size + halo)
                        if i0 < i1 and j0 < j1:
                            part = np.s_[i0 - r0 : i1 - r0, j0 - c0 : j1 - c0]
                            mask = None if there[part].all() else np.packbits(there[part]).tobytes()
                            out.append((trow, tcol, trow == r["brow"] and tcol == r["bcol"], r["layer"], r["band"], i0, j0, i1 - i0, j1 - j0, a[part].tobytes(), mask))
                yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], SCHEMA)

    return blocks.mapInArrow(cut, "trow bigint, tcol bigint, own boolean, layer string, band int, r0 bigint, c0 bigint, h int, w int, data binary, mask binary")


SCHEMA = pa.schema([("trow", pa.int64()), ("tcol", pa.int64()), ("own", pa.bool_()), ("layer", pa.string()), ("band", pa.int32()), ("r0", pa.int64()), ("c0", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary()), ("mask", pa.binary())])


def on_blocks(blocks: DataFrame, size: int, halo: int, bands: dict[str, list[int]], function: Callable[..., np.ndarray | tuple], outputs: tuple[str, ...], missing: float = 0.0) -> DataFrame:
    """r, c and the outputs of ``function`` over blocks with their halos.

    The function gets an array (bands x h x w) for each layer by name, with ``missing`` where a raster has
    no cell, and gives an array (h x w), or one for each output. Arrays end where the raster ends, so a
    function sees the raster's borders as its own; what it gives within ``halo`` of another border is not used.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        if not any(r["own"] for r in rows):
            return pd.DataFrame({"r": np.zeros(0, int), "c": np.zeros(0, int)} | {n: np.zeros(0) for n in outputs})
        r0, c0 = min(r["r0"] for r in rows), min(r["c0"] for r in rows)
        h, w = max(r["r0"] + r["h"] for r in rows) - r0, max(r["c0"] + r["w"] for r in rows) - c0
        arrays = {n: np.full((len(b), h, w), missing) for n, b in bands.items()}
        own = np.zeros((h, w), bool)
        for r in rows:
            a, there = _arrays(r)
            at = np.s_[r["r0"] - r0 : r["r0"] - r0 + r["h"], r["c0"] - c0 : r["c0"] - c0 + r["w"]]
            np.copyto(arrays[r["layer"]][bands[r["layer"]].index(r["band"])][at], a, where=there)
            if r["own"]:
                own[at] |= there
        out = function(**arrays)
        i, j = np.nonzero(own)
        return pd.DataFrame({"r": i + r0, "c": j + c0} | {n: x[i, j] for n, x in zip(outputs, [out] if len(outputs) == 1 else out, strict=True)})

    return exchanged(blocks, size, halo).groupBy("trow", "tcol").applyInPandas(run, "r bigint, c bigint, " + ", ".join(f"{n} double" for n in outputs))


def morton(row: Column, col: Column) -> Column:
    """The place of a block on the curve that goes through squares of 1, 2, 4 ... blocks: the bits of row and column by turns."""

    def apart(x: Column) -> Column:
        for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(keep).cast("long"))
        return x

    return F.shiftleft(apart(row.cast("long")), 1).bitwiseOR(apart(col.cast("long")))
