"""Raster files: formats against files made by hand, the data source's pruning, and the sink's commit and abort."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import blocks as K
from orbitframe.sources import raster_files as S
from orbitframe.sources import raster_formats as R
from orbitframe.sources import tre


def packed_lzw(data):
    """Codes of a TIFF's LZW stream, by the published rules."""
    bits, table, word = [], {bytes([i]): i for i in range(256)}, b""
    width, number = 9, 258

    def put(code):
        bits.append(format(code, f"0{width}b"))

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = number
        number += 1
        width = 9 if number < 512 else 10 if number < 1024 else 11 if number < 2048 else 12
        word = data[i : i + 1]
        if number == 4094:
            put(256)
            table, number, width = {bytes([i]): i for i in range(256)}, 258, 9
    if word:
        put(table[word])
        number += 1
        width = 9 if number < 512 else 10 if number < 1024 else 11 if number < 2048 else 12
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def tiled_tiff(levels, codec, size=16, order="<", predictor=1, gt=None):
    """A TIFF of tiles, pixel by pixel, with a directory for each level; levels are rows x columns x bands."""
    code = {"none": 1, "lzw": 5, "deflate": 8}[codec]
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for n, v in enumerate(levels):
        h, w, bands = v.shape
        places, counts = [], []
        for y in range(0, h, size):
            for x in range(0, w, size):
                tile = np.zeros((size, size, bands), v.dtype)
                part = v[y : y + size, x : x + size]
                tile[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    tile[:, 1:] -= tile[:, :-1].copy()
                raw = tile.astype(v.dtype.newbyteorder(order)).tobytes()
                raw = zlib.compress(raw) if codec == "deflate" else packed_lzw(raw) if codec == "lzw" else raw
                places.append(len(out))
                counts.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        tags = [(254, 4, [1 if n else 0]), (256, 4, [w]), (257, 4, [h]), (258, 3, [v.dtype.itemsize * 8] * bands), (259, 3, [code]), (277, 3, [bands]), (317, 3, [predictor]), (322, 4, [size]), (323, 4, [size]), (324, 4, places), (325, 4, counts), (339, 3, [{"u": 1, "i": 2, "f": 3}[v.dtype.kind]] * bands)]
        if gt and not n:
            tags += [(33550, 12, [gt[1], -gt[5], 0.0]), (33922, 12, [0.0, 0.0, 0.0, gt[0], gt[3], 0.0])]
        entries = b""
        for tag, kind, values in tags:
            data = struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *values)
            if len(data) > 4:
                entries += struct.pack(order + "HHII", tag, kind, len(values), len(out))
                out += data
            else:
                entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def dted(posts, west="0100000E", south="0450000N"):
    """A file of profiles from posts in rows from the north."""
    h, w = posts.shape
    head = f"UHL1{west}{south}00300030{'':19}{w:04d}{h:04d}".ljust(80) + " " * 3348
    out = head.encode()
    for x in range(w):
        column = posts[::-1, x]
        body = b"\xaa" + struct.pack(">I", x)[1:] + struct.pack(">HH", x, 0) + np.where(column < 0, 0x8000 | -column, column).astype(">u2").tobytes()
        out += body + struct.pack(">I", sum(body))
    return out


def whole(rows, band=1, level=0, segment=0):
    """The image that rows of blocks make."""
    mine = [r for r in rows if (r.band, r.level, r.segment) == (band, level, segment)]
    out = np.full((max(r.top + r.height for r in mine), max(r.left + r.width for r in mine)), np.nan)
    for r in mine:
        out[r.top : r.top + r.height, r.left : r.left + r.width] = np.reshape(r.v, (r.height, r.width))
    return out


def put(folder, name, data):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)
    return os.path.join(folder, name)


@pytest.mark.parametrize(("codec", "kind", "order", "predictor"), [("none", "u2", "<", 1), ("none", "f4", ">", 1), ("deflate", "i4", "<", 2), ("lzw", "u1", "<", 1), ("lzw", "u2", ">", 2), ("deflate", "f8", "<", 1)])
def test_tiles_of_tiff(spark, tmp_path, codec, kind, order, predictor):
    image = np.random.default_rng(3).integers(0, 200, (45, 37, 2)).astype(kind)
    image[:20] = 7  # long runs
    put(tmp_path, "a.tif", tiled_tiff([image, image[::2, ::2].copy()], codec, order=order, predictor=predictor))
    rows = S.read_blocks(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * 3 * 3 + 2 * 2 * 2
    for band in (1, 2):
        assert (whole(rows, band) == image[..., band - 1]).all() and (whole(rows, band, 1) == image[::2, ::2, band - 1]).all()


def test_lzw_of_all_widths():
    data = np.random.default_rng(1).integers(0, 256, 40000).astype(np.uint8).tobytes() + b"ab" * 9000
    assert R.unpacked_lzw(packed_lzw(data)) == data and R.unpacked_lzw(packed_lzw(b"")) == b""
    for bad in (b"", packed_lzw(data)[:500], b"\x00" * 20):
        with pytest.raises(ValueError):
            R.unpacked_lzw(bad)


def test_filters_prune_partitions(spark, tmp_path):
    image = np.arange(64 * 64).reshape(64, 64, 1).astype("u2")
    put(tmp_path, "a.tif", tiled_tiff([image, image[::2, ::2].copy()], "none"))
    put(tmp_path, "b.tif", tiled_tiff([image + 1], "none"))
    put(tmp_path, "_hidden.tif", b"no raster")
    every = S.read_blocks(spark, str(tmp_path), partitionBytes=1)
    assert every.rdd.getNumPartitions() == 16 + 4 + 16
    some = K.window(every, 20, 5, 20, 10, 0, size=16)
    assert some.rdd.getNumPartitions() == 4  # two blocks of each file
    got = {(r.image[-5], r.x, r.y): r.v for r in K.to_pixels(some).collect()}
    assert got == {(n, x, y): y * 64 + x + (n == "b") for n in "ab" for x in range(20, 40) for y in range(5, 15)}
    first = every.where((F.col("image") == str(tmp_path / "a.tif")) & F.col("level").isin(1, 5) & (F.col("left") < 16) & (F.col("v")[0] > 0))
    assert first.rdd.getNumPartitions() == 2 and first.count() == 1
    assert every.where("level = 9").collect() == []
    assert S.read_blocks(spark, str(tmp_path)).rdd.getNumPartitions() == 3  # blocks of a grid together
    listed = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.tif", "b.tif")] + [(None,)], "path string")
    same = S.read_listed(listed, F.col("level") == 0)
    assert sorted(map(str, same.collect())) == sorted(map(str, every.where("level = 0").collect())) and same.count() == 32


def test_dted(spark, tmp_path):
    posts = np.random.default_rng(4).integers(-400, 3000, (90, 130))
    put(tmp_path, "n45.dt1", dted(posts))
    blocks = S.read_blocks(spark, str(tmp_path))
    assert (whole(blocks.collect()) == posts).all() and blocks.count() == 3
    info = S.read_info(spark.createDataFrame([(str(tmp_path / "n45.dt1"),)], "path string"))
    tile = S.elevation_tiles(blocks, info).first()
    assert (tile.tile_id, tile.width, tile.height, tile.no_data) == ("n45", 130, 90, -32767.0) and (np.reshape(tile.z, (90, 130)) == posts).all()
    assert tile.gt == [10.0, 30 / 36000, 0.0, pytest.approx(45 + 89 * 30 / 36000), 0.0, -30 / 36000]


def test_damaged_files(spark, tmp_path):
    posts, image = np.ones((20, 70), int), np.ones((16, 32, 1), "u1")
    good, flipped = dted(posts), bytearray(dted(posts))
    flipped[3428 + 20] ^= 1
    put(tmp_path, "a.dt1", bytes(flipped))  # its first 64 profiles
    put(tmp_path, "b.dt1", good[:-9])
    put(tmp_path, "c.tif", tiled_tiff([image], "deflate").replace(b"\x78\x9c", b"\x00\x00", 1))  # one of two tiles
    for name, data in (("d.tif", b"II*\0\xff\xff\xff\xff"), ("e.ntf", b"NITF02.10" + b"9" * 400), ("f.txt", b""), ("g.tif", tiled_tiff([image], "none")[:300]), ("h.dt1", b"UHL1" + b"x" * 5000)):
        put(tmp_path, name, data)
    got = S.read_blocks(spark, str(tmp_path), corrupt="skip").collect()
    assert sorted((r.image[-5:], r.left) for r in got) == [("a.dt1", 64), ("c.tif", 16)]
    paths = spark.createDataFrame([(p,) for p in S.files(str(tmp_path))], "path string")
    assert len(S.read_listed(paths, corrupt="skip").collect()) == 2
    errors = {r.image[-5:]: r.error for r in S.read_info(paths, "skip").collect()}
    assert errors["a.dt1"] is None and errors["c.tif"] is None and all(errors[n] for n in ("b.dt1", "d.tif", "e.ntf", "f.txt", "g.tif", "h.dt1"))
    for name in errors:
        with pytest.raises(Exception, match="ValueError"):
            S.read_blocks(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="corrupt is fail or skip"):
        S.read_blocks(spark, str(tmp_path), corrupt="maybe").collect()


def rpc_record():
    f = "1" + "0000.50" + "0000.25" + "002000" + "03000" + "+44.3500" + "+033.3600" + "+0100" + "002000" + "03000" + "+00.1000" + "+000.1000" + "+0500"
    return (f + "".join(f"{(i % 20) / 100:+.6f}E+0".rjust(12) for i in range(80))).encode()


def test_nitf_with_records_and_extensions(spark, tmp_path):
    pixels = np.random.default_rng(5).integers(0, 60000, (3, 20, 33)).astype("u2")
    records, extensions = [("RPC00B", rpc_record()), ("ABCDEF", b"\x01\x02")], [("XML_DATA_CONTENT", b"<SICD/>"), ("OTHER", b"")]
    put(tmp_path, "a.ntf", R.nitf_file(pixels, "450000N0100000E" * 4, records, extensions))
    assert len(rpc_record()) == 1041
    rows = S.read_blocks(spark, str(tmp_path)).collect()
    assert all((whole(rows, b + 1) == pixels[b]).all() for b in range(3))
    info = S.read_info(spark.createDataFrame([(str(tmp_path / "a.ntf"),)], "path string"))
    one = info.first()
    assert (one.kind, one.width, one.height, one.bands) == ("nitf", 33, 20, 3) and [(e.name, bytes(e.data)) for e in one.extensions] == extensions
    model = tre.rpc_parameters(info.withColumnRenamed("image", "image_id")).first()
    assert (model.line_off, model.lat_off, model.long_off, model.height_scale) == (2000, 44.35, 33.36, 500) and model.samp_den == [i / 100 for i in range(20)]
    assert 'name="ABCDEF" hex="0102"' in one.xml


@pytest.mark.parametrize("mode", "BPRS")
def test_nitf_interleaves(tmp_path, mode):
    """Blocks of 8 x 8 over 13 x 11 pixels of two bands, from an image header made by hand."""
    pixels = np.random.default_rng(6).integers(0, 250, (2, 11, 13)).astype("u1")
    made = R.nitf_file(pixels)
    full = np.zeros((2, 16, 16), "u1")
    full[:, :11, :13] = pixels
    cut = [full[:, y : y + 8, x : x + 8] for y in (0, 8) for x in (0, 8)]
    order = {"B": (0, 1, 2), "P": (1, 2, 0), "R": (1, 0, 2)}
    data = b"".join(c[b].tobytes() for b in range(2) for c in cut) if mode == "S" else b"".join(c.transpose(order[mode]).tobytes() for c in cut)
    made = made[: -pixels.size] + data
    made = made.replace(b"B0001000100130011", mode.encode() + b"0002000200080008")
    path = put(tmp_path, "a.ntf", made)
    with open(path, "rb") as f:
        (grid,) = R.layout(f, len(made))
        for i in range(4):
            x, y, w, h = grid.size_of(i)
            assert (R.block(f, grid, i, grid.parts[i]) == pixels[:, y : y + h, x : x + w]).all()


def tiles(spark, names, bad=None):
    rows = [(n, 3, 2, 2, "int16", [1.0, 0.5, 0.0, 9.0, 0.0, -0.5], [float(i * 10 + j) if n != bad else None for j in range(11 if n == bad else 12)]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "name string, width int, height int, bands int, kind string, gt array<double>, v array<double>").repartition(3)


@pytest.mark.parametrize(("file_format", "options"), [("gtiff", {}), ("gtiff", {"compression": "none"}), ("nitf", {})])
def test_written_tiles_are_read_back(spark, tmp_path, file_format, options):
    out = f"file://{tmp_path}/tiles"
    S.write_tiles(tiles(spark, ["a", "b", "c", "d"]), out, file_format, **options)
    rows = S.read_blocks(spark, out).collect()
    got = {os.path.basename(r.image)[0] + str(r.band): list(r.v) for r in rows}
    assert got == {n + str(b + 1): [float(i * 10 + b * 6 + j) for j in range(6)] for i, n in enumerate("abcd") for b in range(2)}
    assert os.path.exists(tmp_path / "tiles" / "_SUCCESS") and not os.path.exists(tmp_path / "tiles" / "_pending")
    if file_format == "gtiff":
        info = S.read_info(spark.createDataFrame([(p,) for p in S.files(out)], "path string")).collect()
        assert all(r.gt == [1.0, 0.5, 0.0, 9.0, 0.0, -0.5] for r in info)
    S.write_tiles(tiles(spark, ["e"]), out, file_format)
    assert len(S.files(out)) == 5
    S.write_tiles(tiles(spark, ["f"]), out, file_format, mode="overwrite")
    assert [os.path.basename(p)[0] for p in S.files(out)] == ["f"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "tiles")
    S.write_tiles(tiles(spark, ["a"]), out)
    for bad in (tiles(spark, ["b", "c", "d", "e"], bad="d"), tiles(spark, ["../x", "b"]), tiles(spark, ["b", "b"]).coalesce(1), tiles(spark, ["b"]).drop("v")):
        with pytest.raises(Exception):  # noqa: B017
            S.write_tiles(bad, out, mode="overwrite")
    assert [os.path.basename(p) for p in S.files(out)] == ["a.tif"] and "_pending" not in os.listdir(out)
    S.write_tiles(tiles(spark, []), out)
    assert len(S.files(out)) == 1


def test_chips_of_blocks(spark, tmp_path):
    values = np.random.default_rng(1).integers(1, 250, (2, 9, 11)).astype(float)
    pixels = spark.createDataFrame([(7, b + 1, x, y, float(values[b, y, x])) for b in range(2) for y in range(9) for x in range(11)], "image long, band int, x int, y int, v double")
    level0 = K.from_pixels(pixels, 4)
    S.write_tiles(S.chips(level0, "uint8", spark.createDataFrame([(7, [10.0, 0.5, 0.0, 40.0, 0.0, -0.5])], "image long, gt array<double>"), 4), str(tmp_path / "t"))
    rows = S.read_blocks(spark, str(tmp_path / "t")).collect()
    assert len(rows) == 9 * 2
    gts = {r.image: r.gt for r in S.read_info(spark.createDataFrame([(p,) for p in S.files(str(tmp_path / "t"))], "path string")).collect()}
    for r in rows:
        x, y = round((gts[r.image][0] - 10) / 0.5), round((40 - gts[r.image][3]) / 0.5)
        assert (np.reshape(r.v, (r.height, r.width)) == values[r.band - 1, y : y + r.height, x : x + r.width]).all()


def test_many_small_files_share_partitions(spark, tmp_path, monkeypatch):
    image = np.arange(16 * 16).reshape(16, 16, 1).astype("u2")
    for i in range(7):
        put(tmp_path, f"f{i}.tif", tiled_tiff([image + i], "none"))
    put(tmp_path, "bad.tif", b"no raster")
    few = sorted(map(str, S.read_blocks(spark, str(tmp_path), corrupt="skip").where("top < 16").collect()))
    monkeypatch.setattr(S, "MANY", 5)
    monkeypatch.setattr(S, "TOGETHER", 3)
    reader = S.BlockReader({"path": str(tmp_path), "corrupt": "skip"})
    assert [len(p.paths) for p in reader.partitions()] == [3, 3, 2]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(few) == 7
    large = S.BlockReader({"path": str(tmp_path), "corrupt": "skip", "partitionBytes": "80"})  # no file is small then
    assert [type(p) for p in large.partitions()].count(S.Chosen) == 7
    with pytest.raises(ValueError, match="bad.tif"):
        [list(r.read(p)) for r in [S.BlockReader({"path": str(tmp_path)})] for p in r.partitions()]
