"""Tagged record extensions: parameters from the XML form `tre/field[@name,@value]` and `repeated/group/field`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.operators.models import RPC_NORMS


def field(xml: Column, tre: str, name: str, kind: str = "string", strict: bool = False) -> Column:
    """Typed value of a field of the first record of a name.  Numbers are cast from text, which knows a leading +."""
    path = f"(//tre[@name='{tre}'])[1]/field[@name='{name}']/@value"
    text = F.try_element_at(F.xpath(xml, F.lit(path)), F.lit(1))
    value = F.trim(text).try_cast(kind) if kind != "string" else text
    return F.coalesce(value, F.raise_error(F.lit(f"no field {name}")).cast(kind)) if strict else value


def record(xml: Column, tre: str) -> Column:
    """Map of the fields of the first record of a name, read at once; with it a field costs no further parse."""
    path = f"(//tre[@name='{tre}'])[1]/field[@name and @value]"
    pairs = F.arrays_zip(F.xpath(xml, F.lit(f"{path}/@name")).alias("k"), F.xpath(xml, F.lit(f"{path}/@value")).alias("v"))

    def mapped(found: Column) -> Column:
        names = F.transform(found, lambda p: p["k"])
        first = F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
        return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_entries(found)).otherwise(first)

    return F.transform(F.array(pairs), mapped)[0]  # bound to a variable, so that the text is read once for names and once for values


def value_of(fields: Column, name: str, kind: str = "string", strict: bool = False) -> Column:
    """Typed value of a field of record's map, as field gives it."""
    text = F.try_element_at(fields, F.lit(name))
    value = F.trim(text).try_cast(kind) if kind != "string" else text
    return F.coalesce(value, F.raise_error(F.lit(f"no field {name}")).cast(kind)) if strict else value


def coefficients(xml: Column, tre: str, name: str) -> Column:
    """Dense array of a repeated field: placed by the groups' index, of the size announced, zero where absent.

    Size, indexes and values come in document order from one parse of the text, and are bound to variables: within the
    transform by place they would be read again for each place.  Groups without index or value count as absent.
    """
    base = f"((//tre[@name='{tre}'])[1]/repeated[@name='{name}'])[1][@number]"
    group = f"{base}/group[@index][field[1]/@value]"
    found = F.xpath(xml, F.lit(f"{base}/@number | {group}/@index | {group}/field[1]/@value"))

    def table(v: Column) -> Column:
        rest = F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
        places = F.transform(F.filter(rest, lambda _, i: i % 2 == 0), lambda t: t.cast("int"))
        values = F.transform(F.filter(rest, lambda _, i: i % 2 == 1), lambda t: F.trim(t).cast("double"))
        return F.struct(F.get(v, F.lit(0)).try_cast("int").alias("size"), F.map_from_arrays(places, values).alias("table"))

    dense = lambda t: F.when(t["size"] > 0, F.transform(F.sequence(F.lit(0), t["size"] - 1), lambda i: F.coalesce(F.try_element_at(t["table"], i), F.lit(0.0))))
    return F.transform(F.transform(F.array(found), table), dense)[0]


#: A record as a struct.
RECORD = "field array<struct<_name:string,_value:string>>, repeated array<struct<_name:string,_number:string,group:array<struct<_index:string,field:array<struct<_name:string,_value:string>>>>>>"


def parsed(xml: Column, tre: str) -> Column:
    """The first record of a name as a struct, read from its own text in one parse; null without such a record."""
    text = F.regexp_extract(xml, rf"(?s)<tre\s(?=[^>]*name\s*=\s*[\"']{tre}[\"'])[^>]*(?<!/)>.*?</tre>", 0)
    return F.from_xml(F.nullif(text, F.lit("")), F.lit(RECORD), {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"})


def fields_of(read: Column) -> Column:
    """Map of the fields of a parsed record; of several of one name the first counts."""
    pairs = F.coalesce(F.filter(read["field"], lambda f: f["_name"].isNotNull() & f["_value"].isNotNull()), F.array().cast("array<struct<_name:string,_value:string>>"))
    firsts = lambda v: F.filter(v, lambda f, i: F.array_position(F.transform(v, lambda g: g["_name"]), f["_name"]) == i + 1)
    return F.transform(F.array(pairs), lambda v: F.when(F.size(F.array_distinct(F.transform(v, lambda f: f["_name"]))) == F.size(v), F.map_from_entries(v)).otherwise(F.map_from_entries(firsts(v))))[0]


def coefficients_of(read: Column, name: str) -> Column:
    """coefficients of a parsed record."""
    repeated = F.get(F.filter(read["repeated"], lambda r: r["_name"] == name), F.lit(0))
    sound = lambda r: F.filter(r["group"], lambda g: g["_index"].isNotNull() & F.get(g["field"], F.lit(0))["_value"].isNotNull())
    table = lambda r: F.map_from_entries(F.transform(sound(r), lambda g: F.struct(g["_index"].cast("int"), F.trim(F.get(g["field"], F.lit(0))["_value"]).cast("double"))))
    held = F.transform(F.array(repeated), lambda r: F.struct(r["_number"].try_cast("int").alias("size"), table(r).alias("table")))
    return F.transform(held, lambda t: F.when(t["size"] > 0, F.transform(F.sequence(F.lit(0), t["size"] - 1), lambda i: F.coalesce(F.try_element_at(t["table"], i), F.lit(0.0)))))[0]


def has(xml: Column, tre: str) -> Column:
    return F.xpath_boolean(xml, F.lit(f"boolean(//tre[@name='{tre}'])"))


def rpc_parameters(images: DataFrame, xml: str = "xml", key: str = "image_id") -> DataFrame:
    """Rational model parameters of the images with a successful RPC00B record."""
    x, fields = F.col(xml), F.col("_fields")
    read = F.col("_read")
    names = {n: n.upper() for n in ["err_bias", "err_rand", *RPC_NORMS]}
    polys = {"line_num": "LINE_NUM_COEFF", "line_den": "LINE_DEN_COEFF", "samp_num": "SAMP_NUM_COEFF", "samp_den": "SAMP_DEN_COEFF"}
    rows = images.where(x.contains("RPC00B")).withColumn("_read", parsed(x, "RPC00B")).withColumn("_fields", fields_of(read)).withColumn("_good", value_of(fields, "SUCCESS", "int") == 1)
    found = F.when(F.col("_good"), F.array(F.struct(*(value_of(fields, t, "double").alias(n) for n, t in names.items()), *(coefficients_of(read, t).alias(n) for n, t in polys.items()))))
    return rows.select(key, F.inline_outer(found)).where("line_num is not null")


def _with_record(images: DataFrame, xml: str, tre: str, name: str = "_fields") -> DataFrame:
    """Images that have a record of a name, with the map of its fields; texts without the name are not parsed."""
    x = F.col(xml)
    read = images.where(x.contains(tre)).withColumn(name, F.transform(F.array(parsed(x, tre)), lambda r: F.when(r.isNotNull(), fields_of(r)))[0])
    # rows without the record go by a generator: a filter on the map would be moved below it and parse the text again
    return read.withColumn("_has", F.explode(F.when(F.col(name).isNotNull(), F.array(F.lit(True))))).drop("_has")


def corner_points(images: DataFrame, width: Column, height: Column, xml: str = "xml", key: str = "image_id") -> DataFrame:
    """Four ground control points per image from the CSCRNA record's corners, against the image's corners."""
    spots = [("UL", F.lit(0.0), F.lit(0.0)), ("UR", width, F.lit(0.0)), ("LR", width, height), ("LL", F.lit(0.0), height)]
    get = lambda n: value_of(F.col("_fields"), n, "double")
    point = lambda n, px, py: F.struct(get(f"{n}CNR_LONG").alias("lon_deg"), get(f"{n}CNR_LAT").alias("lat_deg"), get(f"{n}CNR_HT").alias("z"), px.cast("double").alias("pixel"), py.cast("double").alias("line"))
    return _with_record(images, xml, "CSCRNA").select(key, F.inline(F.array(*(point(*s) for s in spots))))


def chip_corners(images: DataFrame, xml: str = "xml", key: str = "image_id") -> DataFrame:
    """Four pairs of chip and full-image places from the ICHIPB record; images whose record doesn't parse are absent."""
    get = lambda n: value_of(F.col("_fields"), n, "double")
    point = lambda c: F.struct(get(f"OP_COL_{c}").alias("chip_x"), get(f"OP_ROW_{c}").alias("chip_y"), get(f"FI_COL_{c}").alias("full_x"), get(f"FI_ROW_{c}").alias("full_y"))
    rows = _with_record(images, xml, "ICHIPB").select(key, get("FI_COL").alias("full_cols"), get("FI_ROW").alias("full_rows"), F.array(*(point(c) for c in ("11", "12", "21", "22"))).alias("corners"))
    return rows.where(~F.exists("corners", lambda p: p["chip_x"].isNull() | p["chip_y"].isNull() | p["full_x"].isNull() | p["full_y"].isNull()))


def rsm_parameters(images: DataFrame, xml: str = "xml", key: str = "image_id") -> DataFrame:
    """Replacement model parameters, one row per polynomial record of an image, with its ground domain; section numbers are the record's, from 1."""
    x = F.col(xml)
    records = F.regexp_extract_all(x, F.lit(r"(?s)<tre\s(?=[^>]*name=[\"']RSMPCA[\"'])[^>]*(?<!/)>.*?</tre>"), 0)  # fields of a record are read from its own text
    rows = _with_record(images, xml, "RSMIDA", "_ida").withColumn("records", records).select("*", F.size("records").alias("n_records"), F.posexplode("records").alias("record", "record_xml"))
    rows = rows.withColumn("_read", parsed(F.col("record_xml"), "RSMPCA")).withColumn("_pca", fields_of(F.col("_read")))
    pca = lambda name, kind="double": value_of(F.col("_pca"), name, kind)
    ida = lambda name, kind="double": value_of(F.col("_ida"), name, kind)
    point = lambda *names: F.struct(*(ida(n).alias(a) for n, a in zip(names, "xyz", strict=True)))
    norms = {"row": "R", "col": "C", "x": "X", "y": "Y", "z": "Z"}
    polys = ("rn", "rd", "cn", "cd")
    return rows.select(
        key, "record", "n_records", pca("RSN", "int").alias("section_row"), pca("CSN", "int").alias("section_col"), F.trim(ida("GRNDD", "string")).alias("form"), F.array(*(point(*(f"V{i}{a}" for a in "XYZ")) for i in range(1, 9))).alias("vertices"),
        point("XUOR", "YUOR", "ZUOR").alias("origin"), F.array(*(F.array(*(ida(f"{b}U{a}R") for b in "XYZ")) for a in "XYZ")).alias("axes"), point("GRPX", "GRPY", "GRPZ").alias("reference_point"),
        *(pca(f"{t}NRMO").alias(f"{n}_off") for n, t in norms.items()), *(pca(f"{t}NRMSF").alias(f"{n}_scale") for n, t in norms.items()), *(ida(f).alias(f.lower()) for f in ("MINR", "MAXR", "MINC", "MAXC")),
        *(F.array(*(pca(f"{k.upper()}PWR{a}", "int") for a in "XYZ")).alias(f"{k}_powers") for k in polys), *(coefficients_of(F.col("_read"), f"{k.upper()}PCF").alias(k) for k in polys),
    )


def rsm_sections(images: DataFrame, xml: str = "xml", key: str = "image_id") -> DataFrame:
    """Numbers and sizes of an image's sections and the low-order polynomials that find a place's section, of the images with a section record."""
    get = lambda name, kind="double": value_of(F.col("_fields"), name, kind)
    poly = lambda a: F.array(*(get(a + t) for t in ("0", "X", "Y", "Z", "XX", "XY", "XZ", "YY", "YZ", "ZZ")))
    rows = _with_record(_with_record(images, xml, "RSMIDA", "_ida"), xml, "RSMPIA")
    return rows.select(
        key, get("RNIS", "int").alias("n_rows"), get("CNIS", "int").alias("n_cols"), get("RSSIZ").alias("row_size"), get("CSSIZ").alias("col_size"),
        value_of(F.col("_ida"), "MINR", "double").alias("min_row"), value_of(F.col("_ida"), "MINC", "double").alias("min_col"), poly("R").alias("row_poly"), poly("C").alias("col_poly"),
    )
