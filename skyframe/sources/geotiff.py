"""GeoTIFF source: size, affine and projection from the file's head, pixels by block.

The head is read on the driver (its block table is some 16 bytes a block); pixels
are read where they are needed, a range of the file at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession

from ..functions.geo import Geographic, GeoRaster, TransverseMercator

#: Bytes and struct letters of TIFF field types (fixed values).
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q")}
#: Tags and geo keys that are read (fixed values).
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _SAMPLES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 277, 284, 317
_STRIP_OFFSETS, _STRIP_ROWS, _STRIP_BYTES, _TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_BYTES = 273, 278, 279, 322, 323, 324, 325
_PIXEL_SCALE, _TIE_POINT, _TRANSFORM, _GEO_KEYS = 33550, 33922, 34264, 34735
_MODEL_TYPE, _RASTER_TYPE, _GEOGRAPHIC, _PROJECTED = 1024, 1025, 2048, 3072

Decode = Callable[[bytes, int, int], np.ndarray]
BLOCK = "block_x long, block_y long, width int, height int, pixels binary"


@dataclass(frozen=True)
class GeoTiff:
    path: str
    width: int
    height: int
    affine: tuple[float, ...]
    epsg: int | None
    tags: dict[int, tuple]
    order: str

    def raster(self, resize_width: int | None = None, projection: TransverseMercator | Geographic | None = None) -> GeoRaster:
        """Its place, scaled to ``resize_width`` pixels if given.  Degrees (EPSG 4326) and
        the UTM zones of WGS 84 are known; others need their ``projection``."""
        return GeoRaster.resized(self.affine, self.width, self.height, resize_width, projection or projection_of(self.epsg))


def projection_of(epsg: int | None) -> TransverseMercator | Geographic:
    if epsg == 4326:
        return Geographic()
    if epsg is not None and epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60:
        return TransverseMercator.utm(epsg % 100, south=epsg // 100 == 327)
    raise ValueError(f"projection EPSG {epsg} is not known: pass one")


def _open(path: str):
    files, inner = arrow_fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return files.open_input_file(inner)


def read_head(path: str) -> GeoTiff:
    """The first image of a classic or big TIFF at a path or URI.  FileNotFoundError
    without a file, ValueError for one that is no TIFF or has no place."""
    with _open(path) as f:
        start = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        kind = struct.unpack(order + "H", start[2:4])[0] if order and len(start) >= 8 else 0
        if kind not in (42, 43):
            raise ValueError(f"{path}: not a TIFF file")
        big = kind == 43
        at = struct.unpack(order + "Q", start[8:16])[0] if big else struct.unpack(order + "I", start[4:8])[0]
        count_size, entry_size, word = (8, 20, 8) if big else (2, 12, 4)
        count = struct.unpack(order + ("Q" if big else "H"), f.read_at(count_size, at))[0]
        table, tags = f.read_at(count * entry_size, at + count_size), {}
        for k in range(count):
            entry = table[k * entry_size : (k + 1) * entry_size]
            tag, field = struct.unpack(order + "HH", entry[:4])
            n = struct.unpack(order + ("Q" if big else "I"), entry[4 : 4 + word])[0]
            if field not in _TYPES:
                continue
            size, letter = _TYPES[field]
            raw = entry[4 + word :]
            if n * size > word:
                raw = f.read_at(n * size, struct.unpack(order + ("Q" if big else "I"), raw)[0])
            tags[tag] = struct.unpack(f"{order}{n}{letter}", raw[: n * size])
    keys = {}
    words = tags.get(_GEO_KEYS, ())
    for k in range(4, len(words) - 3, 4):
        if words[k + 1] == 0:  # the value itself
            keys[words[k]] = words[k + 3]
    if _TRANSFORM in tags:
        m = tags[_TRANSFORM]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif _PIXEL_SCALE in tags and _TIE_POINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[_PIXEL_SCALE][:2], tags[_TIE_POINT][:5]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        raise ValueError(f"{path}: no georeference")
    if keys.get(_RASTER_TYPE) == 2:  # the place told is that of the pixel's middle
        a, b, c, d, e, g = affine
        affine = (a, b, c - (a + b) / 2, d, e, g - (d + e) / 2)
    epsg = keys.get(_GEOGRAPHIC if keys.get(_MODEL_TYPE) == 2 else _PROJECTED)
    return GeoTiff(path, tags[_WIDTH][0], tags[_HEIGHT][0], tuple(map(float, affine)), epsg, tags, order)


def _decoded(raw: bytes, width: int, height: int, compression: int, predictor: int, samples: int, decode: Decode | None) -> np.ndarray:
    """H x W x 3 bytes in BGR order."""
    if compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif compression != 1:
        if decode is None:
            raise ValueError(f"compression {compression} needs a decoder")
        return decode(raw, width, height)
    part = np.frombuffer(raw, np.uint8, width * height * samples).reshape(height, width, samples)
    if predictor == 2:
        part = np.cumsum(part, axis=1, dtype=np.uint8)
    return part[:, :, [2, 1, 0]] if samples >= 3 else np.repeat(part[:, :, :1], 3, axis=2)


def read_blocks(spark: SparkSession, tiff: GeoTiff, block_px: int = 512, decode: Decode | None = None) -> DataFrame:
    """Pixels as ``block_x, block_y, width, height, pixels`` (BGR bytes), the form that
    ``operators.tiles.tile_images`` takes.  Bytes of 1, 3 or 4 samples, in strips or
    in square tiles of ``block_px``, plain or deflated; ``decode`` (bytes, width,
    height -> BGR array) does other compressions.  A task holds one tile, or one row
    of blocks where the file has strips."""
    tags, width, height = tiff.tags, tiff.width, tiff.height
    one = lambda tag, default: tags.get(tag, (default,))[0]
    samples, compression, predictor = one(_SAMPLES, 1), one(_COMPRESSION, 1), one(_PREDICTOR, 1)
    if set(tags.get(_BITS, (8,))) != {8} or (one(_PLANAR, 1) != 1 and samples > 1) or samples == 2:
        raise ValueError(f"{tiff.path}: only bytes of 1, 3 or 4 interleaved samples")
    tiled = _TILE_OFFSETS in tags
    if tiled and (one(_TILE_WIDTH, 0), one(_TILE_HEIGHT, 0)) != (block_px, block_px):
        raise ValueError(f"{tiff.path}: tiles of {one(_TILE_WIDTH, 0)} x {one(_TILE_HEIGHT, 0)}; give that size")
    across = -(-width // block_px)
    if tiled:
        work = [(k % across, k // across, [(o, n, 0, block_px)]) for k, (o, n) in enumerate(zip(tags[_TILE_OFFSETS], tags[_TILE_BYTES]))]
    else:
        rows = min(one(_STRIP_ROWS, height), height)
        strips = [(o, n, k * rows, min(rows, height - k * rows)) for k, (o, n) in enumerate(zip(tags[_STRIP_OFFSETS], tags[_STRIP_BYTES]))]
        work = [(0, y, strips[y * block_px // rows : -(-min(height, (y + 1) * block_px) // rows)]) for y in range(-(-height // block_px))]
    path = tiff.path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _open(path) as f:
            for batch in batches:
                for bx, by, parts in zip(batch["bx"], batch["by"], batch["parts"]):
                    wide = block_px if tiled else width
                    read = [_decoded(f.read_at(p["n"], p["o"]), wide, p["rows"], compression, predictor, samples, decode) for p in parts]
                    area = read[0] if len(read) == 1 else np.concatenate(read)
                    top = 0 if tiled else by * block_px - parts[0]["first"]
                    area = area[top : top + min(block_px, height - by * block_px)]
                    for x in [bx] if tiled else range(across):
                        left = 0 if tiled else x * block_px
                        block = np.ascontiguousarray(area[:, left : left + min(block_px, width - x * block_px)])
                        yield pd.DataFrame({"block_x": [x], "block_y": [by], "width": [block.shape[1]], "height": [block.shape[0]], "pixels": [block.tobytes()]})

    plan = spark.createDataFrame(work, "bx long, by long, parts array<struct<o:long,n:long,first:long,rows:long>>")
    return plan.mapInPandas(run, BLOCK)


def shrink_blocks(blocks: DataFrame, size: tuple[int, int], to: tuple[int, int], block_px: int = 512) -> DataFrame:
    """Blocks (of ``block_px`` before and after) of the raster scaled from ``size`` to ``to`` (width, height) by area
    means.  A block gives its share of each block that it overlaps, so no task ever
    holds more than one output block and the shares of it."""
    (width, height), (out_w, out_h) = size, to
    if out_w > width or out_h > height:
        raise ValueError("a raster is scaled down only")

    def weights(first: int, n: int, whole: int, shown: int) -> tuple[int, np.ndarray]:
        """(first output place, output x input shares of places first..first + n)."""
        per = whole / shown
        low, high = int(first / per), min(shown, int(np.ceil((first + n) / per - 1e-9)))
        edge, own = np.arange(low, high)[:, None] * per, first + np.arange(n)[None, :]
        return low, np.clip(np.minimum(edge + per, own + 1) - np.maximum(edge, own), 0, None) / per

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bx, by, w, h, pixels in zip(batch["block_x"], batch["block_y"], batch["width"], batch["height"], batch["pixels"]):
                block = np.frombuffer(pixels, np.uint8).reshape(h, w, 3).astype(np.float64)
                x0, wx = weights(bx * block_px, w, width, out_w)
                y0, wy = weights(by * block_px, h, height, out_h)
                mean = np.einsum("oi,ijc,pj->opc", wy, block, wx, optimize=True)
                for oy in range(y0 // block_px, (y0 + len(wy) - 1) // block_px + 1):
                    for ox in range(x0 // block_px, (x0 + len(wx) - 1) // block_px + 1):
                        top, left = max(0, oy * block_px - y0), max(0, ox * block_px - x0)
                        part = np.ascontiguousarray(mean[top : (oy + 1) * block_px - y0, left : (ox + 1) * block_px - x0])
                        yield pd.DataFrame({"block_x": [ox], "block_y": [oy], "x": [x0 + left], "y": [y0 + top], "w": [part.shape[1]], "h": [part.shape[0]], "part": [part.tobytes()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(parts["block_x"].iat[0]), int(parts["block_y"].iat[0])
        own = np.zeros((min(block_px, out_h - by * block_px), min(block_px, out_w - bx * block_px), 3))
        for x, y, w, h, part in zip(parts["x"] - bx * block_px, parts["y"] - by * block_px, parts["w"], parts["h"], parts["part"]):
            own[y : y + h, x : x + w] += np.frombuffer(part).reshape(h, w, 3)
        return pd.DataFrame({"block_x": [bx], "block_y": [by], "width": [own.shape[1]], "height": [own.shape[0]], "pixels": [np.rint(own).astype(np.uint8).tobytes()]})

    shares = blocks.select("block_x", "block_y", "width", "height", "pixels").mapInPandas(share, "block_x long, block_y long, x long, y long, w long, h long, part binary")
    return shares.groupBy("block_x", "block_y").applyInPandas(add, BLOCK)
