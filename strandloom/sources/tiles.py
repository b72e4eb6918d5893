"""Binary batches of contact tiles: a header, a directory, then columns of coordinates and counts."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, VERSION, HEADER, ENTRY = b"CST1", 1, 16, 24


def encode(tiles: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], tile_bins: int) -> bytes:
    """Tiles of (tile_x, tile_y, x, y within the tile, count), little-endian, counts aligned to eight bytes."""
    if not 0 < tile_bins <= 65_536:
        raise ValueError("coordinates within a tile have 16 bits")
    at = HEADER + ENTRY * len(tiles)
    directory, body = [], []
    for tx, ty, x, y, count in tiles:
        n = len(x)
        part = x.astype("<u2").tobytes() + y.astype("<u2").tobytes()
        part += bytes(-(at + len(part)) % 8) + count.astype("<f8").tobytes()
        directory.append(struct.pack("<IIIIQ", tx, ty, n, 0, at))
        body.append(part)
        at += len(part)
    return b"".join([MAGIC, struct.pack("<HHII", VERSION, 0, len(tiles), tile_bins), *directory, *body])


def decode(data: bytes) -> tuple[int, list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
    """tile_bins and tiles; raises where magic, version, sizes or coordinates don't fit."""
    if len(data) < HEADER or data[:4] != MAGIC:
        raise ValueError("not a tile batch")
    version, flags, n_tiles, tile_bins = struct.unpack_from("<HHII", data, 4)
    if version != VERSION or flags or HEADER + ENTRY * n_tiles > len(data):
        raise ValueError("unknown version or short directory")
    out = []
    for i in range(n_tiles):
        tx, ty, n, _, at = struct.unpack_from("<IIIIQ", data, HEADER + ENTRY * i)
        counts_at = at + 4 * n + -(at + 4 * n) % 8
        if counts_at + 8 * n > len(data):
            raise ValueError("a tile ends behind the batch")
        x, y, count = np.frombuffer(data, "<u2", n, at), np.frombuffer(data, "<u2", n, at + 2 * n), np.frombuffer(data, "<f8", n, counts_at)
        if n and (x.max() >= tile_bins or y.max() >= tile_bins):
            raise ValueError("a cell lies outside its tile")
        out.append((tx, ty, x, y, count))
    return tile_bins, out


def encoded_tiles(cells: DataFrame, tile_bins: int) -> DataFrame:
    """tile_x, tile_y and a batch of one tile; a tile holds at most tile_bins squared cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for tx, ty, own in zip(batch["tile_x"].to_pylist(), batch["tile_y"].to_pylist(), batch["cells"], strict=True):
                v = own.values
                packed.append(encode([(tx, ty, v.field("x").to_numpy(), v.field("y").to_numpy(), v.field("count").to_numpy())], tile_bins))
            yield pa.RecordBatch.from_arrays([batch["tile_x"], batch["tile_y"], pa.array(packed, pa.binary())], names=["tile_x", "tile_y", "payload"])

    keyed = cells.select(F.expr(f"x_bin div {tile_bins}").alias("tile_x"), F.expr(f"y_bin div {tile_bins}").alias("tile_y"), F.struct((F.col("x_bin") % tile_bins).cast("int").alias("x"), (F.col("y_bin") % tile_bins).cast("int").alias("y"), F.col("count").cast("double").alias("count")).alias("cell"))
    grouped = keyed.groupBy("tile_x", "tile_y").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return grouped.mapInArrow(run, "tile_x long, tile_y long, payload binary")


#: What stands for an empty cell of a dense tile, in either width.
EMPTY = -1.0

#: Cells of the dense tiles that a task holds at once.
HELD_CELLS = 1 << 21



def dense_tiles(cells: DataFrame, tile_bins: int, half: bool = False) -> DataFrame:
    """tile_x, tile_y and payload: all tile_bins squared counts of a tile by rows, as little-endian floats of 32 or 16 bits.

    Empty cells hold EMPTY. Half floats round to the nearest of 11 bits, ties to even; counts beyond 65,504 become infinite. Cells of
    one place are summed; tiles without cells have no row.
    """
    if not 0 < tile_bins <= 4_096:
        raise ValueError("a dense tile has 1 to 4,096 bins a side")
    width, size = "<f2" if half else "<f4", tile_bins * tile_bins
    step = max(1, HELD_CELLS // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
                own = part["cells"]
                v, row = own.flatten(), np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                grid = np.full((len(own), size), EMPTY, width)
                with np.errstate(over="ignore"):
                    grid[row, v.field("at").to_numpy()] = v.field("count").to_numpy().astype(width)
                ends = np.arange(len(own) + 1, dtype="<i4") * grid[0].nbytes
                yield pa.RecordBatch.from_arrays([part["tile_x"], part["tile_y"], pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(grid)])], names=["tile_x", "tile_y", "payload"])

    keyed = cells.select(F.expr(f"x_bin div {tile_bins}").alias("tile_x"), F.expr(f"y_bin div {tile_bins}").alias("tile_y"), (F.col("y_bin") % tile_bins * tile_bins + F.col("x_bin") % tile_bins).cast("int").alias("at"), F.col("count").cast("double").alias("count"))
    grouped = keyed.groupBy("tile_x", "tile_y", "at").agg(F.sum("count").alias("count")).groupBy("tile_x", "tile_y").agg(F.collect_list(F.struct("at", "count")).alias("cells"))
    return grouped.mapInArrow(run, "tile_x long, tile_y long, payload binary")


def dense_cells(tiles: DataFrame, tile_bins: int, half: bool = False) -> DataFrame:
    """x_bin, y_bin and count of dense tiles' cells; a payload of another size is a ValueError."""
    width, bits = (np.dtype(x) for x in (("<f2", "<u2") if half else ("<f4", "<u4")))
    size, empty = tile_bins * tile_bins, np.array(EMPTY, width).view(bits)
    step = max(1, HELD_CELLS // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
                own = part["payload"]
                if own.null_count or not np.all(pc.binary_length(own).to_numpy() == size * width.itemsize):
                    raise ValueError("a payload doesn't have the size of a tile")
                grid = np.frombuffer(b"".join(x.as_buffer() for x in own), width)
                held = np.flatnonzero(grid.view(bits) != empty)
                tile, at = held // size, held % size
                x, y = (part[c].to_numpy()[tile] * tile_bins for c in ("tile_x", "tile_y"))
                yield pa.RecordBatch.from_arrays([pa.array(x + at % tile_bins), pa.array(y + at // tile_bins), pa.array(grid[held].astype(np.float64))], names=["x_bin", "y_bin", "count"])

    return tiles.select("tile_x", "tile_y", "payload").mapInArrow(run, "x_bin long, y_bin long, count double")
