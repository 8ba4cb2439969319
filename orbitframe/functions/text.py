"""Names, formats and fixed-width headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_extension(name: Column) -> Column:
    upper = F.upper(name)
    return F.when(upper.rlike("NI?TF"), "NITF").when(upper.rlike("TIF{1,2}"), "TIFF").when(upper.rlike("JPE?G"), "JPEG").otherwise(upper)


def select_extension(path: Column, candidates: Column) -> Column:
    """The last candidate that stands after a dot anywhere in the path, else the first; UNKNOWN without candidates."""
    hit = F.filter(candidates, lambda c: F.contains(F.upper(path), F.concat(F.lit("."), F.upper(c))))
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) <= 0, F.lit("UNKNOWN")).otherwise(F.coalesce(F.try_element_at(hit, F.lit(-1)), F.try_element_at(candidates, F.lit(1))))


def image_extension(path: Column, candidates: Column) -> Column:
    return normalize_extension(select_extension(path, candidates))


def creation_option(image_format: Column, compression: Column, is_float: Column) -> Column:
    """Encoder option of an output format; null for formats without one."""
    nitf = F.when(compression.isNull() | (compression == "J2K"), F.when(is_float, "IC=NC").otherwise("IC=C8")).when(compression == "JPEG", "IC=C3").when(compression == "NONE", "IC=NC").otherwise("IC=C8")
    tiff = F.when(compression == "JPEG", "COMPRESS=JPEG").when(compression == "NONE", "COMPRESS=NONE").otherwise("COMPRESS=LZW")
    return F.when(image_format == "NITF", nitf).when(image_format == "GTiff", tiff)


#: Fixed field widths of a data extension header, between the version and the length of the user part.
DES_FIELDS = [
    ("DECLAS", 1), ("DESCLSY", 2), ("DESCODE", 11), ("DESCTLH", 2), ("DESREL", 20), ("DESDCTP", 2), ("DESDCDT", 8), ("DESDCXM", 4), ("DESDG", 1),
    ("DESDGDT", 8), ("DESCLTX", 43), ("DESCATP", 1), ("DESCAUT", 40), ("DESCRSN", 1), ("DESSRDT", 8), ("DESCTLN", 15),
]


def at_least(text: Column, width: int | Column, fill: str = " ") -> Column:
    """Right-aligned in a width, and whole if longer."""
    return F.when(F.length(text) < width, F.lpad(text, width, fill)).otherwise(text)


def des_header(fields: Column) -> Column:
    """Header text from a map of the fields; a missing field is an error."""
    get = lambda n: F.coalesce(F.try_element_at(fields, F.lit(n)), F.raise_error(F.lit(f"no field {n}")).cast("string"))
    size = get("DESSHL").cast("int")
    user = F.when(size > 0, at_least(get("DESSHF"), size)).otherwise("")
    return F.concat(at_least(get("DESVER").cast("int").cast("string"), 2, "0"), *(at_least(get(n), w) for n, w in DES_FIELDS), at_least(size.cast("string"), 4, "0"), user)
