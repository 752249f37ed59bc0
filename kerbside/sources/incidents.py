"""Reading incidents from JSON, WKT and EWKB, and the rows of GeoJSON and CSV files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

c = F.col

#: What a file of incidents may hold; other fields are not read.
JSON_SCHEMA = "id string, title string, area string, severity string, status string, hasCoords boolean, lat double, lng double"


def normalised_json(df: DataFrame) -> DataFrame:
    """A missing status is active; without hasCoords there is no position."""
    placed = F.coalesce("hasCoords", F.lit(True))
    return df.select("id", "title", "area", "severity", F.coalesce("status", F.lit("active")).alias("status"), F.when(placed, c("lat")).alias("lat"), F.when(placed, c("lng")).alias("lng"))


def read_incident_json(spark: SparkSession, path: str) -> DataFrame:
    return normalised_json(spark.read.schema(JSON_SCHEMA).option("multiLine", True).json(path))


def wkt_point(text: Column) -> tuple[Column, Column]:
    """(lat, lng) of POINT(lng lat), with or without an SRID."""
    shape = r"(?i)POINT\s*\(\s*([-0-9.]+)\s+([-0-9.]+)\s*\)"
    at = lambda k: F.nullif(F.regexp_extract(text, shape, k), F.lit("")).cast("double")
    return at(2), at(1)


def decode_ewkb(hex_text: str | None) -> tuple[float | None, float | None]:
    """(lat, lng) of a point in hex (E)WKB of either byte order; anything else has none."""
    try:
        raw = bytes.fromhex(hex_text or "")
        order = "<" if raw[0] == 1 else ">"
        kind = struct.unpack_from(order + "I", raw, 1)[0]
        if kind & 0xFF != 1:
            return None, None
        lng, lat = struct.unpack_from(order + "dd", raw, 9 if kind & 0x20000000 else 5)
        return lat, lng
    except (ValueError, IndexError, struct.error):
        return None, None


@F.pandas_udf(StructType([StructField("lat", DoubleType()), StructField("lng", DoubleType())]))
def ewkb_point(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_ewkb(v) for v in values], columns=["lat", "lng"])


def geojson_feature(*properties: str) -> Column:
    """A row as a GeoJSON feature."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def write_geojson_lines(df: DataFrame, path: str, *properties: str) -> None:
    """One feature a line, written by all tasks."""
    df.filter("lat is not null and lng is not null").select(geojson_feature(*properties).alias("value")).write.text(path)


def csv_field(x: Column) -> Column:
    """Quoted where it has a comma, a quote or a line break; quotes are doubled."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def strip_html(html: Column, most: int = 15_000) -> Column:
    """Visible text: no scripts, styles, frames, comments and tags; six entities decoded."""
    text = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "iframe"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), "<[^>]+>", " ")
    for entity, char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'")):
        text = F.regexp_replace(text, f"(?i)&{entity};", char)
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)
