"""Readers, registered functions and streams."""

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orbitframe import sql, streaming
from orbitframe.operators import models
from orbitframe.sources import des, geojson, products, rasters, tre


def test_geojson(spark, tmp_path):
    feature = lambda i: {"type": "Feature", "id": i, "geometry": {"type": "Point", "coordinates": [i, 2]}, "properties": {"imageBBox": [0, 0, i, 1]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1), feature(2)]}))
    rows = geojson.read_features(spark, str(tmp_path / "a.geojson")).collect()
    assert [r.id for r in rows] == ["1", "2"] and json.loads(rows[1].properties)["imageBBox"] == [0, 0, 2, 1]
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(feature(i)) for i in range(3)) + "\n\n")
    assert geojson.read_feature_lines(spark, str(tmp_path / "b.jsonl")).count() == 3


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "n01.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 0.5\nNODATA_value -1\n1 2 3\n4 5 -1\n")
    row = rasters.read_ascii_grids(spark, str(tmp_path)).first()
    assert (row.tile_id, row.width, row.height, row.no_data) == ("n01", 3, 2, -1.0) and row.z == [1, 2, 3, 4, 5, -1] and row.gt == [10.25, 0.5, 0.0, 20.75, 0.0, -0.5]


def test_tiff_header(spark, tmp_path):
    entries = [(256, 3, 1, struct.pack("<HH", 640, 0)), (257, 3, 1, struct.pack("<HH", 480, 0)), (33550, 12, 3, struct.pack("<I", 200)), (33922, 12, 6, struct.pack("<I", 224))]
    data = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", *e[:3]) + e[3] for e in entries)
    data = data.ljust(200, b"\0") + struct.pack("<3d", 0.5, 0.25, 0) + struct.pack("<6d", 0, 0, 0, 100, 50, 0)
    (tmp_path / "a.tif").write_bytes(data)
    (tmp_path / "b.tif").write_bytes(b"not a raster")
    got = {r.path[-5]: r for r in rasters.read_tiff_headers(spark, str(tmp_path)).collect()}
    assert (got["a"].width, got["a"].height, got["a"].gt) == (640, 480, [100.0, 0.5, 0.0, 50.0, 0.0, -0.25]) and got["b"].width is None


def test_tre(spark):
    corner = "".join(f'<field name="{c}CNR_{k}" value="{v}"/>' for c in ("UL", "UR", "LR", "LL") for k, v in (("LAT", "+10.5"), ("LONG", "-020.25"), ("HT", "+100")))
    chip = "".join(f'<field name="{p}_{k}_{c}" value="{v}"/>' for p, v in (("OP", "0.5"), ("FI", "100.5")) for k in ("COL", "ROW") for c in ("11", "12", "21", "22"))
    xml = f'<tres><tre name="CSCRNA">{corner}</tre><tre name="ICHIPB">{chip}<field name="FI_COL" value="00512"/><field name="FI_ROW" value="00256"/></tre></tres>'
    rows = spark.createDataFrame([("i", xml), ("j", "<tres/>")], "image_id string, xml string")
    points = tre.corner_points(rows, F.lit(640), F.lit(480)).collect()
    assert len(points) == 4 and (points[0].lon_deg, points[0].lat_deg, points[2].pixel) == (-20.25, 10.5, 640.0)
    chips = tre.chip_corners(rows).collect()
    assert len(chips) == 1 and chips[0].full_cols == 512 and chips[0].corners[0].full_x == 100.5
    assert tre.rpc_parameters(rows).count() == 0


def test_rpc_records(spark):
    """A whole record is read once; the first of repeated fields counts, and failed records are left out."""
    names = ["ERR_BIAS", "ERR_RAND", "LINE_OFF", "SAMP_OFF", "LAT_OFF", "LONG_OFF", "HEIGHT_OFF", "LINE_SCALE", "SAMP_SCALE", "LAT_SCALE", "LONG_SCALE", "HEIGHT_SCALE"]

    def made(success):
        fields = "".join(f'<field name="{n}" value="+{i}.5"/>' for i, n in enumerate(names)) + '<field name="LINE_OFF" value="99"/>'
        polys = "".join(f'<repeated name="{n}_COEFF" number="20"><group index="1"><field name="C" value="{k}"/></group></repeated>' for k, n in enumerate(("LINE_NUM", "LINE_DEN", "SAMP_NUM", "SAMP_DEN")))
        return f'<tres><tre name="RPC00B"><field name="SUCCESS" value="{success}"/>{fields}{polys}</tre><tre name="RPC00B"><field name="LINE_OFF" value="7"/></tre></tres>'

    rows = spark.createDataFrame([("a", made(1)), ("b", made(0)), ("c", "<tres/>")], "image_id string, xml string")
    got = tre.rpc_parameters(rows).collect()
    assert len(got) == 1 and (got[0].image_id, got[0].err_bias, got[0].line_off, got[0].height_scale) == ("a", 0.5, 2.5, 11.5)
    assert got[0].samp_num == [0.0, 2.0] + [0.0] * 18
    one = rows.where("image_id = 'a'").select(tre.value_of(tre.record(F.col("xml"), "RPC00B"), "LINE_OFF", "double"), tre.field(F.col("xml"), "RPC00B", "LINE_OFF", "double")).first()
    assert one[0] == one[1] == 2.5


def test_rsm_records(spark):
    ida = "".join(f'<field name="V{i}{a}" value="{i}"/>' for i in range(1, 9) for a in "XYZ") + '<field name="GRNDD" value="G"/>'
    pca = lambda s: f'<tre name="RSMPCA"><field name="RSN" value="00{s}"/><field name="CSN" value="001"/><field name="RNRMO" value="+{s}.5E+00"/></tre>'
    xml = f'<tres><tre name="RSMIDA">{ida}</tre>{pca(1)}{pca(2)}</tres>'
    got = tre.rsm_parameters(spark.createDataFrame([("i", xml)], "image_id string, xml string")).orderBy("section_row").collect()
    assert [(r.section_row, r.row_off) for r in got] == [(1, 1.5), (2, 2.5)] and got[0].vertices[7].x == 8.0 and got[0].form == "G"


def test_rsm_models(spark):
    """Polynomials, axes and sections are read; images with a gap in their records have no model."""
    f = lambda name, value: f'<field name="{name}" value="{value}"/>'
    # x points east, y north, z up at longitude 90 degrees on the equator
    form = "".join(f(f"{a}U{b}R", v) for b, axis in zip("XYZ", ((-1, 0, 0), (0, 0, 1), (0, 1, 0)), strict=True) for a, v in zip("XYZ", axis, strict=True)) + f("XUOR", 0) + f("YUOR", 6378137) + f("ZUOR", 0)
    corners = "".join(f(f"V{i + 1}{a}", v) for i in range(8) for a, v in zip("XYZ", ((i % 2 - 0.5) * 4000, (i // 2 % 2 - 0.5) * 4000, i // 4 * 200), strict=True))
    ida = f'<tre name="RSMIDA">{corners}{form}{f("GRNDD", "R")}{f("MINR", 0)}{f("MINC", 0)}</tre>'
    poly = lambda k, powers, c: "".join(f(f"{k}PWR{a}", p) for a, p in zip("XYZ", powers, strict=True)) + f'<repeated name="{k}PCF" number="{len(c)}">' + "".join(f'<group index="{i}">{f(k + "PCF", v)}</group>' for i, v in enumerate(c)) + "</repeated>"

    def pca(row, tilt, short=False):
        norms = "".join(f(f"{a}NRMO", 0) + f(f"{a}NRMSF", 1000) for a in "RCXYZ")
        body = f("RSN", row) + f("CSN", 1) + norms + poly("RN", (0, 1, 0), [0] if short else [2, -1]) + poly("RD", (0, 0, 0), [1]) + poly("CN", (1, 0, 1), [2, 1, tilt, 0]) + poly("CD", (0, 0, 0), [1])
        return f'<tre name="RSMPCA">{body}</tre>'

    pia = f'<tre name="RSMPIA">{"".join(f(k + t, v) for k, t, v in (("R", "0", 2000), ("R", "Y", -1), ("C", "0", 2000), ("C", "X", 1)))}{"".join(f(k + t, 0) for k in "RC" for t in ("X", "Y", "Z", "XX", "XY", "XZ", "YY", "YZ", "ZZ") if k + t not in ("RY", "CX"))}{f("RNIS", 2)}{f("CNIS", 1)}{f("RSSIZ", 2000)}{f("CSSIZ", 4000)}</tre>'
    records = {"one": pca(1, 0.5), "two": pia + pca(2, 0.5) + pca(1, 0.25), "gap": pia + pca(2, 0.5) + pca(2, 0.5), "loose": pca(1, 0.5) + pca(2, 0.5), "bad": pca(1, 0.5, True)}
    images = spark.createDataFrame([(n, f"<tres>{ida}{r}</tres>") for n, r in records.items()], "image_id string, xml string")
    found = models.rsm_models(tre.rsm_parameters(images), tre.rsm_sections(images)).cache()
    assert sorted((r.image_id, r.section_row, r.cn) for r in found.collect()) == [("one", 0, [2, 1, 0.5, 0]), ("two", 0, [2, 1, 0.25, 0]), ("two", 1, [2, 1, 0.5, 0])]
    deg = 180 / 3.141592653589793 / 6378137
    places = spark.createDataFrame([(n, 90 + 500 * deg, lat * deg, h) for n in records for lat, h in ((900, 100.0), (-900, 100.0))], "image_id string, lon_deg double, lat_deg double, height double")
    image = models.rsm_world_to_image(places, found).cache()
    got = sorted((r.image_id, round(r.y, -2), round(r.x)) for r in image.collect())
    assert got == [("one", 1100, 2550), ("one", 2900, 2550), ("two", 1100, 2525), ("two", 2900, 2550)]
    for r in models.rsm_image_to_world(image.withColumnsRenamed({"lon_deg": "lon", "lat_deg": "lat"}), found).collect():
        assert abs(r.lon_deg - r.lon) < 1e-9 and abs(r.lat_deg - r.lat) < 1e-9 and r.residual < 1e-6
    far = models.rsm_image_to_world(spark.createDataFrame([("one", -9e5, 2000.0), ("one", 2000.0, 2000.0)], "image_id string, x double, y double"), found, height=None).orderBy("x").collect()
    west, middle = found.where("image_id = 'one'").first().box[0], far[1]
    assert abs(far[0].lon_deg * 3.141592653589793 / 180 - west) < 1e-12 and far[0].residual > 8e5
    assert middle.residual < 1e-6 and abs(middle.height - 100) < 1


def test_des_segments(spark):
    xml = '<?xml version="1.0"?><l><des name="A"><field name="X" value="1"/></des><des name="B"><xml_content><q>z</q></xml_content></des></l>'
    rows = des.segments(spark.createDataFrame([("i", xml)], "image_id string, xml string"))
    got = rows.select("name", "position", des.data_xml(F.col("fields"), F.col("segment")).alias("d")).collect()
    assert [(r.name, r.position, r.d) for r in got] == [("A", 0, None), ("B", 1, "<q>z</q>")]


def test_sicd(spark):
    xml = """<SICD xmlns="urn:SICD:1.2.1"><GeoData><SCP><ECF><X>1</X><Y>2</Y><Z>3</Z></ECF></SCP></GeoData><ImageData><FirstRow>5</FirstRow><FirstCol>6</FirstCol></ImageData>
<Grid><Type>RGZERO</Type><TimeCOAPoly order1="1" order2="0"><Coef exponent1="1" exponent2="0">0.5</Coef></TimeCOAPoly></Grid><Position><ARPPoly><X order1="1"><Coef exponent1="0">7</Coef></X></ARPPoly></Position></SICD>"""
    docs = spark.createDataFrame([("i", xml), ("j", "<SIDD/>")], "image_id string, xml string")
    params = products.sicd(docs)
    row = params.first()
    assert params.count() == 1 and row.projection == "INCA" and row.scp.z == 3.0 and row.time_coa == [[0.0], [0.5]] and row.arp.x == [7.0, 0.0]
    chip = products.chipped_sicd(params, F.lit(10), F.lit(20), F.lit(64), F.lit(32)).first()
    assert (chip.first_row, chip.first_col, chip.num_rows) == (25.0, 16.0, 32.0)
    assert "<first_row>" in products.to_xml(params, ["first_row"], "SICD").first().xml
    kind, version = products.kind_and_version(F.col("xml"))
    assert docs.select(kind, version).first() == ("SICD", "1.2.1")


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("SELECT of_tile_row(2.113D, 0.395D, 10, 256), of_tile_col(2.113D, 10, 256), of_decibels(100D)").first() == (578, 856, 20.0)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0.1, 0.1), (60, 0.1, 0.1), (9000, 0.5, 0.5)], "s int, lon double, lat double").select(F.timestamp_seconds(F.col("s")).alias("ts"), "lon", "lat")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming.tile_counts(source, 5).writeStream.outputMode("complete").format("memory").queryName("tiles").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("tiles").collect()) == [1, 2]


def test_coefficients_are_read_in_one_parse(spark):
    xml = '<tres><tre name="RPC00B"><repeated name="C" number="4"><group index="2"><field name="C" value=" +1.5 "/></group><group><field name="C" value="9"/></group><group index="0"><field name="C" value="-2"/></group></repeated><repeated name="D"/></tre></tres>'
    rows = spark.createDataFrame([(xml,), ("<tres/>",)], "xml string")
    got = rows.select(tre.coefficients(F.col("xml"), "RPC00B", "C").alias("c"), tre.coefficients(F.col("xml"), "RPC00B", "D").alias("d"))
    assert [tuple(r) for r in got.collect()] == [([-2.0, 0.0, 1.5, 0.0], None), (None, None)]
    plan = got.select("c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xpath(") + plan.count("XPathList") == 1


def test_segments_are_read_in_one_parse(spark):
    xml = '<?xml version="1.0"?><l><des name="A"><field name="X" value=" a &amp; b "/><field value="1" name="Y"/></des><des name="B"></des></l>'
    rows = des.segments(spark.createDataFrame([(1, xml)], "image_id int, xml string"))
    assert [(r.position, r.name, r.fields) for r in rows.collect()] == [(0, "A", {"X": " a & b ", "Y": "1"}), (1, "B", {})]
    assert "xpath" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_documents_are_read_in_one_parse(spark):
    from orbitframe.plans import sar_images as SI

    docs = spark.createDataFrame([(i, SI.sicd_xml(k)) for i, k in enumerate(SI.KINDS)] + [(9, SI.sidd_xml())], "image_id int, xml string")
    for read, n in ((products.sicd, 4), (products.sidd, 1)):
        rows = read(docs)
        assert "xpath" not in rows._jdf.queryExecution().optimizedPlan().toString().lower() and rows.count() == n


def test_replacement_polynomials_by_batches():
    """Sections of several powers in one batch give the sums of their terms, and each is unpacked once for all its rows."""
    powers = np.array([[1, 2, 0], [0, 1, 1], [1, 2, 0]])
    c = np.array([[1.0, 2, 3, 4, 5, 6], [7, 8, 9, 10, 0, 0], [6, 5, 4, 3, 2, 1]])
    q = np.array([[0.5, 0.25, 2.0], [0.1, 0.2, 0.3], [-0.5, 3.0, 1.0]])
    plain = [sum(v * q[n, 0] ** (i % (p + 1)) * q[n, 1] ** (i // (p + 1) % (r + 1)) * q[n, 2] ** (i // ((p + 1) * (r + 1))) for i, v in enumerate(c[n][: (p + 1) * (r + 1) * (s + 1)])) for n, (p, r, s) in enumerate(powers)]
    assert np.allclose(models._rsm_value(c, powers, q), plain, rtol=1e-14)
    fields, of = models._sections(pa.array(["b", "a", "b", "b"]), pa.StructArray.from_arrays([pa.array([2, 1, 2, 2])], ["x"]))
    assert len(fields["x"]) == 2 and list(fields["x"].to_numpy()[of]) == [2, 1, 2, 2]


def test_rational_models_by_batches():
    """Models of a batch are read as one matrix; null and lists of another length are no model."""
    lists = pa.array([[1.0, 2.0], None, [3.0], [4.0, None], [5.0, 6.0]], pa.list_(pa.float64()))
    assert np.array_equal(models._rows_of(lists.slice(0), 2), [[1, 2], [np.nan] * 2, [np.nan] * 2, [4, np.nan], [5, 6]], equal_nan=True)
    assert np.array_equal(models._rows_of(lists.slice(2), 2)[1:], [[4, np.nan], [5, 6]], equal_nan=True)
