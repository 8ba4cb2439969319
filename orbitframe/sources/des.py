"""Data extension segments: names, header fields and the XML they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What is read of a segment, in one parse.
SEGMENT = "_name string, field array<struct<_name: string, _value: string>>"


def without_prolog(xml: Column) -> Column:
    return F.regexp_replace(xml, r"<\?xml.*?\?>", "")


def segments(images: DataFrame, xml: str = "xml", key: str = "image_id") -> DataFrame:
    """One row per segment in order: position from 0, name, and a map of its fields."""
    x = without_prolog(F.col(xml))
    parts = F.regexp_extract_all(x, F.lit(r"(?s)(<des\s[^>]*name=.*?</des>)"), 1)
    rows = images.select(key, F.posexplode(parts).alias("position", "segment"))
    read = F.from_xml("segment", F.lit(SEGMENT), {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"})
    rows = rows.select("*", F.transform(F.array(read), lambda d: F.struct(d["_name"].alias("name"), F.map_from_entries(F.coalesce(F.filter(d["field"], lambda f: f["_name"].isNotNull() & f["_value"].isNotNull()), F.array().cast("array<struct<_name:string,_value:string>>"))).alias("fields")))[0].alias("d"))
    return rows.select(key, F.col("position").cast("int").alias("position"), F.coalesce("d.name", F.lit("")).alias("name"), "d.fields", "segment")


def by_name(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("name") == name)


def data_xml(fields: Column, segment: Column) -> Column:
    """The segment's XML: its decoded base64 value, else the XML nested in it, else null."""
    coded = F.decode(F.unbase64(F.try_element_at(fields, F.lit("DESDATA"))), "UTF-8")
    nested = F.regexp_extract(segment, r"(?s)<xml_content>\s*(<.*>)\s*</xml_content>", 1)
    return F.coalesce(coded, F.when(nested != "", nested))
