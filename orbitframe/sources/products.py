"""SICD and SIDD documents: the fields that the models read, from XML text of any version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import sar_geometry as S
from orbitframe.operators import statistics


#: What the models read of documents, by path; each document is parsed once.
_VECTOR = "struct<X:string,Y:string,Z:string>"
_LINE = "struct<_order1:string,Coef:array<struct<_exponent1:string,_VALUE:string>>>"
_SURFACE = "struct<_order1:string,_order2:string,Coef:array<struct<_exponent1:string,_exponent2:string,_VALUE:string>>>"
_MOTION = f"struct<X:{_LINE},Y:{_LINE},Z:{_LINE}>"
_POINT = "struct<Row:string,Col:string>"
SICD = (
    f"ImageFormation struct<ImageFormAlgo:string>, GeoData struct<SCP:struct<ECF:{_VECTOR}>>, ImageData struct<NumRows:string,NumCols:string,FirstRow:string,FirstCol:string,SCPPixel:{_POINT}>, "
    f"Grid struct<Type:string,TimeCOAPoly:{_SURFACE},Row:struct<UVectECF:{_VECTOR},SS:string>,Col:struct<UVectECF:{_VECTOR},SS:string>>, Position struct<ARPPoly:{_MOTION}>, "
    f"RMA struct<INCA:struct<R_CA_SCP:string,TimeCAPoly:{_LINE},DRateSFPoly:{_SURFACE}>>, PFA struct<FPN:{_VECTOR},PolarAngPoly:{_LINE},SpatialFreqSFPoly:{_LINE}>, RgAzComp struct<AzSF:string>, "
    f"SCPCOA struct<ARPPos:{_VECTOR},ARPVel:{_VECTOR},SideOfTrack:string>"
)
SIDD = (
    f"Measurement struct<PlaneProjection:struct<ReferencePoint:struct<ECEF:{_VECTOR},Point:{_POINT}>,ProductPlane:struct<RowUnitVector:{_VECTOR},ColUnitVector:{_VECTOR}>,SampleSpacing:{_POINT},TimeCOAPoly:{_SURFACE}>,PixelFootprint:{_POINT},ARPPoly:{_MOTION}>, "
    f"DownstreamReprocessing struct<GeometricChip:struct<ChipSize:{_POINT},{','.join(f'Original{n}Coordinate:{_POINT}' for n in ('UpperLeft', 'UpperRight', 'LowerRight', 'LowerLeft'))}>>"
)


def _document(xml: Column, fields: str) -> Column:
    """Struct of a document's fields; a text that is no XML has none."""
    return F.from_xml(xml, F.lit(fields), {"mode": "PERMISSIVE"})


def _text(doc: Column, path: str) -> Column:
    """The value below the root at a path such as /SICD/Grid/Type."""
    for name in path.split("/")[2:]:
        doc = doc[name]
    return doc


def _number(doc: Column, path: str) -> Column:
    return _text(doc, path).try_cast("double")


def _vector(doc: Column, path: str) -> Column:
    return F.struct(*(_number(doc, f"{path}/{a}").alias(a.lower()) for a in "XYZ"))


def _line(doc: Column, path: str) -> Column:
    """Dense coefficients of a one-variable polynomial."""
    poly = _text(doc, path)
    order = poly["_order1"].try_cast("int")
    table = F.map_from_entries(F.transform(poly["Coef"], lambda c: F.struct(c["_exponent1"].cast("int"), c["_VALUE"].cast("double"))))
    return F.when(order >= 0, F.transform(F.sequence(F.lit(0), order), lambda i: F.coalesce(F.try_element_at(table, i), F.lit(0.0))))


def _surface(doc: Column, path: str) -> Column:
    """Dense coefficients of a two-variable polynomial, an array per power of the first variable."""
    poly = _text(doc, path)
    order = lambda k: poly[f"_order{k}"].try_cast("int")
    table = F.map_from_entries(F.transform(poly["Coef"], lambda c: F.struct(F.concat_ws(",", c["_exponent1"], c["_exponent2"]), c["_VALUE"].cast("double"))))
    cell = lambda i, j: F.coalesce(F.try_element_at(table, F.concat_ws(",", i.cast("string"), j.cast("string"))), F.lit(0.0))
    return F.when(order(1) >= 0, F.transform(F.sequence(F.lit(0), order(1)), lambda i: F.transform(F.sequence(F.lit(0), order(2)), lambda j: cell(i, j))))


def _motion(doc: Column, path: str) -> Column:
    return F.struct(*(_line(doc, f"{path}/{a}").alias(a.lower()) for a in "XYZ"))


def kind_and_version(xml: Column) -> tuple[Column, Column]:
    """Document kind by its root element, and version by the root's namespace."""
    root = F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>\s*)?(?:<!--.*?-->\s*)*<(?:\w+:)?(\w+)", 1)
    return root, F.nullif(F.regexp_extract(xml, r"urn:S[IC][CD]D:([0-9.]+)", 1), F.lit(""))


def sicd(docs: DataFrame, xml: str = "xml", key: str = "image_id") -> DataFrame:
    """Model parameters of complex products; the projection is named by grid type and image formation."""
    x = F.col("_doc")
    grid, algorithm = _text(x, "/SICD/Grid/Type"), _text(x, "/SICD/ImageFormation/ImageFormAlgo")
    projection = F.when((grid == "RGAZIM") & (algorithm == "PFA"), "PFA").when((grid == "RGAZIM") & (algorithm == "RGAZCOMP"), "RGAZCOMP").when(grid == "RGZERO", "INCA").when(grid.isin("PLANE", "XCTYAT", "XRGYCR"), "PLANE")
    rows = docs.where(kind_and_version(F.col(xml))[0] == "SICD").withColumn("_doc", _document(unprefixed(F.col(xml)), SICD))
    return rows.select(
        key, projection.alias("projection"), grid.alias("grid"), algorithm.alias("algorithm"), _vector(x, "/SICD/GeoData/SCP/ECF").alias("scp"),
        *(_number(x, f"/SICD/ImageData/SCPPixel/{n}").alias(f"scp_{n.lower()}") for n in ("Row", "Col")), *(_number(x, f"/SICD/ImageData/{n}").alias(a) for n, a in (("FirstRow", "first_row"), ("FirstCol", "first_col"), ("NumRows", "num_rows"), ("NumCols", "num_cols"))),
        *(_vector(x, f"/SICD/Grid/{n}/UVectECF").alias(f"u_{n.lower()}") for n in ("Row", "Col")), *(_number(x, f"/SICD/Grid/{n}/SS").alias(f"{n.lower()}_ss") for n in ("Row", "Col")),
        _surface(x, "/SICD/Grid/TimeCOAPoly").alias("time_coa"), _motion(x, "/SICD/Position/ARPPoly").alias("arp"), _number(x, "/SICD/RMA/INCA/R_CA_SCP").alias("r_ca_scp"), _line(x, "/SICD/RMA/INCA/TimeCAPoly").alias("time_ca"),
        _surface(x, "/SICD/RMA/INCA/DRateSFPoly").alias("rate"), _line(x, "/SICD/PFA/PolarAngPoly").alias("polar"), _line(x, "/SICD/PFA/SpatialFreqSFPoly").alias("factor"), _number(x, "/SICD/RgAzComp/AzSF").alias("az_factor"),
        _vector(x, "/SICD/SCPCOA/ARPPos").alias("scp_arp"), _vector(x, "/SICD/SCPCOA/ARPVel").alias("scp_varp"), _text(x, "/SICD/SCPCOA/SideOfTrack").alias("side"),
        F.when(projection == "PFA", _vector(x, "/SICD/PFA/FPN")).alias("normal"),
    )


def unprefixed(xml: Column) -> Column:
    """XML text without namespace prefixes of tags, which differ between producers."""
    return F.regexp_replace(xml, r"(</?)[A-Za-z][\w.-]*:(?=[A-Za-z])", "$1")


def sidd(docs: DataFrame, xml: str = "xml", key: str = "image_id") -> DataFrame:
    """Model parameters of derived products with a plane projection, in the columns of sicd, and their chip.

    chip is null, or a struct rows, cols and corners (array of structs col, row: UL, UR, LR, LL) in the full image.
    The side of track and the slant plane are those at the reference point's time; the ground plane is the product's.
    """
    x, plane = F.col("_doc"), "/SIDD/Measurement/PlaneProjection"
    rows = docs.where(kind_and_version(F.col(xml))[0] == "SIDD").select(key, _document(unprefixed(F.col(xml)), SIDD).alias("_doc"))
    cut = "/SIDD/DownstreamReprocessing/GeometricChip"
    corner = lambda n: F.struct(*(_number(x, f"{cut}/Original{n}Coordinate/{a}").alias(a.lower()) for a in ("Col", "Row")))
    chip = F.struct(*(_number(x, f"{cut}/ChipSize/{a}").alias(n) for a, n in (("Row", "rows"), ("Col", "cols"))), F.array(*(corner(n) for n in ("UpperLeft", "UpperRight", "LowerRight", "LowerLeft"))).alias("corners"))
    rows = rows.select(
        key, _vector(x, f"{plane}/ReferencePoint/ECEF").alias("scp"), *(_number(x, f"{plane}/ReferencePoint/Point/{n}").alias(f"scp_{n.lower()}") for n in ("Row", "Col")), *(_number(x, f"/SIDD/Measurement/PixelFootprint/{n}").alias(a) for n, a in (("Row", "num_rows"), ("Col", "num_cols"))),
        *(_vector(x, f"{plane}/ProductPlane/{n}UnitVector").alias(f"u_{n.lower()}") for n in ("Row", "Col")), *(_number(x, f"{plane}/SampleSpacing/{n}").alias(f"{n.lower()}_ss") for n in ("Row", "Col")),
        _surface(x, f"{plane}/TimeCOAPoly").alias("time_coa"), _motion(x, "/SIDD/Measurement/ARPPoly").alias("arp"), chip.alias("chip"),
    )
    names = rows.columns
    rows = rows.where(F.col("scp.x").isNotNull() & F.col("time_coa").isNotNull()).withColumn("_t", F.col("time_coa")[0][0])
    arp, varp = S.state(S.unpacked(F.col("arp")), F.col("_t"))
    rows, at = S.spread(rows, at=arp, speed=varp, scp=S.unpacked(F.col("scp")), row=S.unpacked(F.col("u_row")), col=S.unpacked(F.col("u_col")))
    rows, made = S.spread(rows, normal=S.image_normal(at["scp"], at["row"], at["col"]))
    whole = {"projection": F.lit("PLANE"), "grid": F.lit("PLANE"), "algorithm": F.lit(None).cast("string"), "first_row": F.lit(0.0), "first_col": F.lit(0.0), "r_ca_scp": F.lit(None).cast("double"), "az_factor": F.lit(None).cast("double"), "rate": F.lit(None).cast("array<array<double>>")}
    whole |= {n: F.lit(None).cast("array<double>") for n in ("time_ca", "polar", "factor")}
    whole |= {"side": S.side_of_track(at["scp"], at["at"], at["speed"]), "normal": S.packed(made["normal"]), "scp_arp": S.packed(at["at"]), "scp_varp": S.packed(at["speed"])}
    return rows.select(*(n for n in names if n != "chip"), *(v.alias(n) for n, v in whole.items()), F.when(F.col("chip.rows").isNotNull(), F.col("chip")).alias("chip"))


def with_chips(params: DataFrame, key: str = "image_id") -> DataFrame:
    """Parameters with chip_h, the homography from full image to chip of the images that are chips, else null."""
    c = F.col("chip")
    places = F.array(*(F.struct(x.alias("chip_x"), y.alias("chip_y"), c["corners"][i]["col"].alias("full_x"), c["corners"][i]["row"].alias("full_y")) for i, (x, y) in enumerate([(F.lit(0.0), F.lit(0.0)), (c["cols"], F.lit(0.0)), (c["cols"], c["rows"]), (F.lit(0.0), c["rows"])])))
    points = params.where(c.isNotNull()).select(key, F.inline(places))
    return params.join(statistics.fit_homography(points, key, ("full_x", "full_y"), ("chip_x", "chip_y")).withColumnRenamed("h", "chip_h"), key, "left")


def chipped_sicd(params: DataFrame, left: Column, top: Column, width: Column, height: Column, out_width: Column | None = None, out_height: Column | None = None) -> DataFrame:
    """Parameters of a chip: its origin is added to the first row and column; a changed size is an error."""
    same = F.lit(True) if out_width is None else (out_width == width) & (out_height == height)
    guard = lambda c: F.when(same, c).otherwise(F.raise_error(F.lit("complex images can't be scaled")).cast("double"))
    return params.withColumns({"first_row": guard(F.col("first_row") + top), "first_col": F.col("first_col") + left, "num_rows": height.cast("double"), "num_cols": width.cast("double")})


def _put(xml: Column, tag: str, value: Column) -> Column:
    """The text of the first element of a name replaced, its prefix and attributes kept."""
    whole = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.regexp_replace(xml, F.lit(rf"(?s)^(.*?<(?:\w+:)?{tag}(?:\s[^>]*)?>)[^<]*"), F.concat(F.lit("$1"), whole))


def chipped_sicd_xml(xml: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """The document of a chip: its origin is added to the first row and column, its size is the image's."""
    number = lambda n: F.regexp_extract(xml, rf"<(?:\w+:)?{n}(?:\s[^>]*)?>\s*([^<]*?)\s*<", 1).try_cast("double")
    for tag, value in (("FirstRow", number("FirstRow") + top), ("FirstCol", number("FirstCol") + left), ("NumRows", height.cast("double")), ("NumCols", width.cast("double"))):
        xml = _put(xml, tag, value)
    return xml


def chipped_sidd_xml(xml: Column, chip: Column) -> Column:
    """The document with its geometric chip added or replaced; chip is a struct as in tiling.sidd_chip."""
    prefix = F.regexp_extract(xml, r"xmlns:(\w+)=[\"']urn:SICommon", 1)
    dot = F.when(prefix == "", F.lit("")).otherwise(F.concat(prefix, F.lit(":")))
    cell = lambda n, v: F.concat(F.lit("<"), dot, F.lit(f"{n}>"), v.cast("string"), F.lit("</"), dot, F.lit(f"{n}>"))
    pair = lambda tag, row, col: F.concat(F.lit(f"<{tag}>"), cell("Row", row), cell("Col", col), F.lit(f"</{tag}>"))
    at = lambda i: (chip["corners"][i]["row"], chip["corners"][i]["col"])
    made = F.concat(F.lit("<GeometricChip>"), pair("ChipSize", chip["rows"], chip["cols"]), *(pair(f"Original{n}Coordinate", *at(i)) for n, i in (("UpperLeft", 0), ("UpperRight", 1), ("LowerLeft", 3), ("LowerRight", 2))), F.lit("</GeometricChip>"))
    old, home = r"(?s)<GeometricChip>.*?</GeometricChip>", "</DownstreamReprocessing>"
    fresh = F.concat(F.lit("</ExploitationFeatures><DownstreamReprocessing>"), made, F.lit(home))
    return (
        F.when(xml.rlike(old), F.regexp_replace(xml, F.lit(old), made))
        .when(xml.contains("<DownstreamReprocessing>"), F.replace(xml, F.lit("<DownstreamReprocessing>"), F.concat(F.lit("<DownstreamReprocessing>"), made)))
        .otherwise(F.replace(xml, F.lit("</ExploitationFeatures>"), fresh))
    )


def to_xml(params: DataFrame, columns: list[str], tag: str, out: str = "xml") -> DataFrame:
    """Parameters as XML text."""
    return params.withColumn(out, F.to_xml(F.struct(*columns), {"rowTag": tag}))
