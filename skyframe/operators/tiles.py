"""Grids of map tiles, and their spatial search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.geo import window_origin


def grid_positions(length: Column, tile: Column, stride: Column) -> Column:
    """Tile centres along one side: from half a tile on by ``stride``, the last one
    flush with the end; the middle if the side is no longer than a tile."""
    half = F.floor(tile / 2).cast("bigint")
    last = F.greatest(half, length - half)
    run = F.sequence(half, last, F.greatest(stride, F.lit(1)).cast("bigint"))
    return F.when(length <= tile, F.array(F.floor(length / 2).cast("bigint"))).otherwise(F.array_union(run, F.array(last)))


def tile_index(spark: SparkSession, width_px: int, height_px: int, sizes: list[int], stride_ratio: float = 0.5) -> DataFrame:
    """All tiles of a map in index order: sizes as given, rows before columns.
    ``tile_ord, tile_id, tile_size_px, stride_px, center_x_px, center_y_px,
    map_x0_px, map_y0_px``."""
    strides = [max(32, round(size * stride_ratio)) for size in sizes]
    schema = "size_ord long, tile_size_px long, stride_px long"
    base = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(zip(sizes, strides))], schema)
    size, stride = F.col("tile_size_px"), F.col("stride_px")
    rows = base.withColumns({"xs": grid_positions(F.lit(width_px).cast("bigint"), size, stride), "ys": grid_positions(F.lit(height_px).cast("bigint"), size, stride)})
    rows = rows.select("*", F.posexplode("ys").alias("row", "center_y_px")).select("*", F.posexplode("xs").alias("column", "center_x_px"))
    number = (F.col("row") * F.size("xs") + F.col("column")).cast("bigint")
    before = F.coalesce(F.sum(F.size("xs") * F.size("ys")).over(Window.orderBy("size_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = base.withColumns({"xs": grid_positions(F.lit(width_px).cast("bigint"), size, stride), "ys": grid_positions(F.lit(height_px).cast("bigint"), size, stride)}).select("size_ord", before.alias("first"))
    return rows.join(F.broadcast(firsts), "size_ord").select(  # one row a tile size
        (F.col("first") + number).cast("bigint").alias("tile_ord"),
        F.format_string("tile_%dpx_%04d", "tile_size_px", number).alias("tile_id"),
        "tile_size_px",
        "stride_px",
        "center_x_px",
        "center_y_px",
        window_origin(F.col("center_x_px"), size).alias("map_x0_px"),
        window_origin(F.col("center_y_px"), size).alias("map_y0_px"),
    )


def tiles_near(probes: DataFrame, tiles: DataFrame, radius_px: float, x: str = "x", y: str = "y") -> DataFrame:
    """All (probe, tile) within a radius, edge included.  Both sides are put into
    cells of the radius' size and meet by cell, so each probe sees nine cells."""
    cell = float(max(radius_px, 1e-9))
    at = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    around = probes.select("*", F.explode(F.sequence(at(x) - 1, at(x) + 1)).alias("_cx")).select("*", F.explode(F.sequence(at(y) - 1, at(y) + 1)).alias("_cy"))
    placed = tiles.withColumns({"_cx": at("center_x_px"), "_cy": at("center_y_px")})
    dx, dy = F.col("center_x_px") - F.col(x), F.col("center_y_px") - F.col(y)
    return around.join(placed, ["_cx", "_cy"]).where(dx * dx + dy * dy <= float(radius_px) ** 2).drop("_cx", "_cy")


#: Tiles that may be held by every task (24 bytes each).
FEW_TILES = 20_000


def nearest_tiles(probes: DataFrame, tiles: DataFrame, k: int, x: str = "x", y: str = "y", few_tiles: int = FEW_TILES) -> DataFrame:
    """Per probe the ``k`` (at least 1) nearest tiles of all sizes, ties by index
    order: the probe's columns, ``rank`` from 0, ``tile_ord, distance_sq``.

    With few tiles (a count decides) the search is a matrix of distances for each
    batch of probes, without a shuffle.  Beyond that a coarse grid of tile counts tells how far each
    probe must look, and probes meet tiles by coarse cell within that distance.
    Either way a repeated probe row gets its tiles as often as it occurs, and one
    whose place is null, NaN or infinite the first tiles of the index.
    """
    k = max(1, k)
    if tiles.count() <= few_tiles:
        return _nearest_in_memory(probes, tiles, k, x, y)
    return _nearest_by_rings(probes, tiles, k, x, y)


def _nearest_in_memory(probes: DataFrame, tiles: DataFrame, k: int, x: str, y: str) -> DataFrame:
    """Each batch of probes against all tiles at once; the index is small (a count has
    decided) and goes along with the code."""
    index = sorted((r["tile_ord"], float(r["center_x_px"]), float(r["center_y_px"])) for r in tiles.select("tile_ord", "center_x_px", "center_y_px").toLocalIterator())
    ords = np.array([t[0] for t in index], np.int64)
    cx, cy = (np.array([t[c] for t in index]) for c in (1, 2))
    take = min(k, len(index))
    step = max(1, 2_000_000 // max(1, len(index)))

    def search(px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the index, squared distances), each probes x ``take``."""
        with np.errstate(invalid="ignore", over="ignore"):
            away = (cx - px[:, None]) ** 2 + (cy - py[:, None]) ** 2
        key = np.where(np.isfinite(away), away, np.inf)
        if take < len(index):  # all within the k-th distance, ties included
            near = key <= np.partition(key, take - 1, axis=1)[:, take - 1 : take]
            row, place = np.nonzero(near)
            order = np.lexsort((place, key[row, place], row))
            row, place = row[order], place[order]
            first = np.searchsorted(row, np.arange(len(px)))
            place = place[first[:, None] + np.arange(take)]
        else:
            place = np.argsort(key, axis=1, kind="stable")
        return place, np.take_along_axis(away, place, axis=1)

    names = [*probes.columns, "rank", "tile_ord", "distance_sq"]
    width = len(probes.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                px, py = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (0, 1))
                place, away = search(px, py)
                n = part.num_rows
                rows = pa.Table.from_batches([part]).take(pa.array(np.repeat(np.arange(n), take)))
                unplaced = np.repeat([not (p.is_valid and q.is_valid) for p, q in zip(part.column(0), part.column(1))] if part.column(0).null_count or part.column(1).null_count else np.zeros(n, bool), take)
                own = [rows.column(c + 2).combine_chunks() for c in range(width)]
                found = [pa.array(np.tile(np.arange(take), n)), pa.array(ords[place.ravel()]), pa.array(away.ravel(), mask=unplaced)]
                yield pa.RecordBatch.from_arrays([*own, *found], names)

    schema = StructType([*probes.schema.fields, StructField("rank", LongType()), StructField("tile_ord", LongType()), StructField("distance_sq", DoubleType())])
    return probes.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *[F.col(f"`{c}`") for c in probes.columns]).mapInArrow(run, schema)


def _nearest_by_rings(probes: DataFrame, tiles: DataFrame, k: int, x: str, y: str) -> DataFrame:
    """Each probe's first ring is the distance that surely holds k tiles: that of its
    k-th nearest among a coarse sample of the index, one tile per coarse cell."""
    box = tiles.agg(F.min("center_x_px").alias("x0"), F.max("center_x_px").alias("x1"), F.min("center_y_px").alias("y0"), F.max("center_y_px").alias("y1"), F.count("*").alias("n")).first()
    k = min(k, box["n"])
    side = max(float(box["x1"] - box["x0"]), float(box["y1"] - box["y0"]), 1.0) / 32
    cell = [F.floor((F.col(c) - low) / side).cast("bigint") for c, low in (("center_x_px", box["x0"]), ("center_y_px", box["y0"]))]
    # at most 33 x 33 coarse cells, of each the box of its tiles and their number
    coarse = tiles.groupBy(cell[0].alias("_gx"), cell[1].alias("_gy")).agg(F.count("*").alias("n"))
    coarse = coarse.agg(F.collect_list(F.struct("_gx", "_gy", "n")).alias("_cells"))
    far = F.transform(
        "_cells",
        lambda c: F.struct(
            F.sqrt(
                F.pow(F.greatest(F.abs(F.col("_x") - (box["x0"] + c["_gx"] * side)), F.abs(F.col("_x") - (box["x0"] + (c["_gx"] + 1) * side))), 2)
                + F.pow(F.greatest(F.abs(F.col("_y") - (box["y0"] + c["_gy"] * side)), F.abs(F.col("_y") - (box["y0"] + (c["_gy"] + 1) * side))), 2)
            ).alias("d"),
            c["n"].alias("n"),
        ),
    )
    # equal rows are ranked once and repeated at the end; counted by input partition, so that no task has all copies
    counted = probes.select(F.struct(*[F.col(c) for c in probes.columns]).alias("_probe"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.spark_partition_id().alias("_part"))
    counted = counted.groupBy("_probe", "_x", "_y", "_part").agg(F.count("*").alias("_copies"))
    placed_at = F.coalesce(F.abs("_x") < float("inf"), F.lit(False)) & F.coalesce(F.abs("_y") < float("inf"), F.lit(False))
    asked = counted.where(placed_at)
    # the farthest corner of the nearest cells that hold k tiles together
    reach = F.aggregate(F.array_sort(far), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("d")), lambda s, c: F.when(s.n >= k, s).otherwise(F.struct((s.n + c.n).alias("n"), c.d.alias("d"))))
    ringed = asked.join(F.broadcast(coarse), F.lit(True)).withColumn("_r", reach.d)
    near = F.filter("_cells", lambda c: _cell_distance(c, box, side) <= F.col("_r"))
    kept = ["_probe", "_part", "_copies", "_x", "_y"]
    spread = ringed.select(*kept, F.explode(near).alias("_c")).select(*kept, "_c._gx", "_c._gy")
    placed = tiles.select("tile_ord", "center_x_px", "center_y_px", cell[0].alias("_gx"), cell[1].alias("_gy"))
    dx, dy = F.col("center_x_px") - F.col("_x"), F.col("center_y_px") - F.col("_y")
    inside = spread.join(placed, ["_gx", "_gy"]).withColumn("distance_sq", (dx * dx + dy * dy).cast("double"))
    ranked = inside.withColumn("rank", (F.row_number().over(Window.partitionBy("_probe", "_part").orderBy("distance_sq", "tile_ord")) - 1).cast("bigint"))
    ranked = ranked.where(F.col("rank") < k).select("_probe", "_copies", "rank", "tile_ord", "distance_sq")
    first = tiles.orderBy("tile_ord").limit(k).select("tile_ord", "center_x_px", "center_y_px", (F.row_number().over(Window.orderBy("tile_ord")) - 1).cast("bigint").alias("rank"))
    nowhere = counted.where(~placed_at).join(F.broadcast(first), F.lit(True)).withColumn("distance_sq", (dx * dx + dy * dy).cast("double"))  # k rows
    both = ranked.unionByName(nowhere.select("_probe", "_copies", "rank", "tile_ord", "distance_sq"))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select("_probe.*", "rank", "tile_ord", "distance_sq")


def _cell_distance(c: Column, box, side: float) -> Column:
    """From a probe to the nearest point of a coarse cell."""
    low_x, low_y = box["x0"] + c["_gx"] * side, box["y0"] + c["_gy"] * side
    off_x = F.greatest(F.lit(0.0), low_x - F.col("_x"), F.col("_x") - (low_x + side))
    off_y = F.greatest(F.lit(0.0), low_y - F.col("_y"), F.col("_y") - (low_y + side))
    return F.sqrt(off_x * off_x + off_y * off_y) * (1 - 1e-12)


# --- tile pixels -------------------------------------------------------------

_BLOCK = "block_x long, block_y long, width int, height int, pixels binary"


def raster_blocks(spark: SparkSession, image: np.ndarray, block_px: int = 512) -> DataFrame:
    """A decoded raster (H x W x 3 bytes) as rows of blocks: ``block_x, block_y, width,
    height, pixels``.  A large raster is better read block by block into this form."""
    rows = []
    for y in range(0, image.shape[0], block_px):
        for x in range(0, image.shape[1], block_px):
            part = image[y : y + block_px, x : x + block_px]
            rows.append((x // block_px, y // block_px, part.shape[1], part.shape[0], part.tobytes()))
    return spark.createDataFrame(rows, _BLOCK)


def tile_images(index: DataFrame, blocks: DataFrame, block_px: int = 512) -> DataFrame:
    """``tile_ord, tile_size_px, pixels`` (size x size x 3 bytes): each tile's window of
    the raster, black beyond its edges.  Tiles meet only the blocks that they
    overlap, so neither side is ever held whole."""
    first = lambda c: F.floor(F.col(c) / block_px).cast("bigint")
    last = lambda c: F.floor((F.col(c) + F.col("tile_size_px") - 1) / block_px).cast("bigint")
    wanted = index.select("tile_ord", "tile_size_px", "map_x0_px", "map_y0_px", F.explode(F.sequence(first("map_x0_px"), last("map_x0_px"))).alias("block_x"), F.sequence(first("map_y0_px"), last("map_y0_px")).alias("_ys"))
    wanted = wanted.select("tile_ord", "tile_size_px", "map_x0_px", "map_y0_px", "block_x", F.explode("_ys").alias("block_y"))
    pairs = wanted.join(blocks, ["block_x", "block_y"], "left")

    def paste(parts: pd.DataFrame) -> pd.DataFrame:
        size, x0, y0 = (int(parts[c].iat[0]) for c in ("tile_size_px", "map_x0_px", "map_y0_px"))
        tile = np.zeros((size, size, 3), np.uint8)
        for bx, by, w, h, pixels in zip(parts["block_x"], parts["block_y"], parts["width"], parts["height"], parts["pixels"]):
            if pixels is None:
                continue
            block = np.frombuffer(pixels, np.uint8).reshape(int(h), int(w), 3)
            left, top = bx * block_px - x0, by * block_px - y0  # of the block inside the tile
            x, y = max(0, left), max(0, top)
            part = block[y - top : size - top, x - left : size - left]
            tile[y : y + part.shape[0], x : x + part.shape[1]] = part
        return pd.DataFrame({"tile_ord": [parts["tile_ord"].iat[0]], "tile_size_px": [size], "pixels": [tile.tobytes()]})

    return pairs.groupBy("tile_ord").applyInPandas(paste, "tile_ord long, tile_size_px long, pixels binary")
