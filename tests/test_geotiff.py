"""GeoTIFF heads, blocks and scaled rasters, from files written here."""

import struct
import zlib

import numpy as np
import pytest

from skyframe.functions.geo import Geographic, TransverseMercator
from skyframe.sources.geotiff import projection_of, read_blocks, read_head, shrink_blocks


def write_tiff(path, image, order="<", tile=None, rows=7, deflate=False, predictor=1, keys=((1024, 1), (3072, 32636)), place=((33550, (0.5, 0.25, 0.0)), (33922, (2.0, 4.0, 0.0, 5e5, 4.4e6, 0.0)))):
    h, w, n = image.shape
    rgb = image[:, :, ::-1]
    if tile:
        parts = [np.pad(rgb[y : y + tile, x : x + tile], ((0, max(0, y + tile - h)), (0, max(0, x + tile - w)), (0, 0))) for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        parts = [rgb[y : y + rows] for y in range(0, h, rows)]
    if predictor == 2:
        parts = [np.diff(p, axis=1, prepend=np.zeros_like(p[:, :1])) for p in parts]
    raw = [p.tobytes() for p in parts]
    raw = [zlib.compress(r) for r in raw] if deflate else raw
    body, offsets = b"", []
    for r in raw:
        offsets.append(8 + len(body))
        body += r + b"\0" * (len(r) % 2)
    words = [1, 1, 0, len(keys)] + [v for k, value in keys for v in (k, 0, 1, value)]
    tags = [(256, "I", (w,)), (257, "I", (h,)), (258, "H", (8,) * n), (259, "H", (8 if deflate else 1,)), (277, "H", (n,)), (317, "H", (predictor,)), (34735, "H", words)]
    tags += [(322, "H", (tile,)), (323, "H", (tile,)), (324, "I", offsets), (325, "I", [len(r) for r in raw])] if tile else [(273, "I", offsets), (278, "H", (rows,)), (279, "I", [len(r) for r in raw])]
    tags += [(t, "d", v) for t, v in place]
    entries = b""
    for tag, letter, values in sorted(tags):
        data = struct.pack(f"{order}{len(values)}{letter}", *values)
        if len(data) > 4:
            at, body = 8 + len(body), body + data + b"\0" * (len(data) % 2)
            data = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[letter], len(values)) + data.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body))
    path.write_bytes(head + body + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4)
    return str(path)


def whole(blocks, w, h, block_px):
    out = np.zeros((h, w, 3), np.uint8)
    for r in blocks.collect():
        y, x = r["block_y"] * block_px, r["block_x"] * block_px
        out[y : y + r["height"], x : x + r["width"]] = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3)
    return out


IMAGE = np.random.default_rng(3).integers(0, 256, (75, 101, 3), np.uint8)


@pytest.mark.parametrize("form", [{}, {"order": ">", "rows": 75}, {"tile": 32, "deflate": True, "predictor": 2}, {"deflate": True, "rows": 40}])
def test_pixels(spark, tmp_path, form):
    tiff = read_head(write_tiff(tmp_path / "a.tif", IMAGE, **form))
    assert (tiff.width, tiff.height, tiff.epsg) == (101, 75, 32636)
    assert tiff.affine == (0.5, 0.0, 5e5 - 1.0, 0.0, -0.25, 4.4e6 + 1.0)
    assert (whole(read_blocks(spark, tiff, 32), 101, 75, 32) == IMAGE).all()


def test_place(tmp_path):
    raster = read_head(write_tiff(tmp_path / "a.tif", IMAGE)).raster(50)
    assert (raster.width_px, raster.height_px, raster.projection) == (50, 37, TransverseMercator.utm(36)) and raster.scale == 50 / 101
    turned = read_head(write_tiff(tmp_path / "b.tif", IMAGE, keys=((1024, 2), (1025, 2), (2048, 4326)), place=((34264, (0.1, 0.02, 0.0, 30.0, 0.03, -0.1, 0.0, 40.0, *[0.0] * 8)),)))
    assert turned.epsg == 4326 and np.allclose(turned.affine, (0.1, 0.02, 30.0 - 0.06, 0.03, -0.1, 40.0 + 0.035))
    assert turned.raster().projection == Geographic() and projection_of(32701).false_northing == 1e7
    with pytest.raises(ValueError):
        projection_of(3857)
    with pytest.raises(ValueError):
        read_head(write_tiff(tmp_path / "c.tif", IMAGE, place=()))
    (tmp_path / "d.tif").write_bytes(b"GIF89a" + b"\0" * 20)
    with pytest.raises(ValueError):
        read_head(str(tmp_path / "d.tif"))
    with pytest.raises(FileNotFoundError):
        read_head(str(tmp_path / "none.tif"))


def test_scaled_down(spark, tmp_path):
    tiff = read_head(write_tiff(tmp_path / "a.tif", IMAGE))
    got = whole(shrink_blocks(read_blocks(spark, tiff, 16), (101, 75), (40, 30), 16), 40, 30, 16)
    fine = np.repeat(np.repeat(IMAGE.astype(float), 30, axis=0), 40, axis=1)  # a common grid of both
    want = fine.reshape(30, 75, 40, 101, 3).mean(axis=(1, 3))
    assert np.abs(got - want).max() <= 0.5 + 1e-6
    with pytest.raises(ValueError):
        shrink_blocks(read_blocks(spark, tiff, 32), (101, 75), (102, 75))
