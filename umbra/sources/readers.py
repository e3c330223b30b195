"""Readers with explicit schemas: vector tiles, hourly series, text grids, event streams; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<lat:double,lon:double>"
MEMBER = f"struct<type:string,ref:bigint,role:string,geometry:array<{POINT}>>"
#: Envelope of a vector tile file.
TILE = (
    "version double, generator string, elements array<struct<type:string,id:bigint,tags:map<string,string>,lat:double,lon:double,"
    f"nodes:array<bigint>,geometry:array<{POINT}>,members:array<{MEMBER}>>>"
)
#: Hourly series as parallel arrays.
HOURLY = (
    "hourly struct<time:array<string>,temperature_2m:array<double>,apparent_temperature:array<double>,cloud_cover:array<double>,"
    "direct_normal_irradiance:array<double>,uv_index:array<double>>"
)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of tile files (JSON, gzip or not); files that can't be parsed give no rows."""
    files = spark.read.schema(TILE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return files.select(F.input_file_name().alias("file"), F.explode("elements").alias("e")).select("file", "e.*")


def way_nodes(found: DataFrame) -> DataFrame:
    """way_id, seq, node_id, lat, lon of ways whose node ids and geometry align."""
    ways = found.where((F.col("type") == "way") & (F.size("nodes") == F.size("geometry")) & (F.size("nodes") >= 2))
    return ways.select(F.col("id").alias("way_id"), F.posexplode(F.arrays_zip("nodes", "geometry")).alias("seq", "n")).select(
        "way_id", "seq", F.col("n.nodes").alias("node_id"), F.col("n.geometry.lat").alias("lat"), F.col("n.geometry.lon").alias("lon")
    )


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """ts and one column a variable; hours without any value are left out."""
    fields = ("time", "temperature_2m", "apparent_temperature", "cloud_cover", "direct_normal_irradiance", "uv_index")
    # a variable may be missing altogether; zip pads its empty array with nulls
    zipped = F.arrays_zip(*(F.coalesce(F.col(f"hourly.{c}"), F.array().cast("array<string>" if c == "time" else "array<double>")).alias(c) for c in fields))
    rows = spark.read.schema(HOURLY).option("multiLine", True).json(path).select(F.explode(zipped).alias("h")).select("h.*")
    named = rows.toDF("time", "temperature_c", "apparent_c", "cloud_pct", "dni", "uv")
    some = F.coalesce("temperature_c", "apparent_c", "cloud_pct", "dni", "uv").isNotNull()
    return named.withColumn("ts", F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm"))).drop("time").where(some)


def text_grid(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, value of text grids: a header of name and number, then values; no-data values are null."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.lower("value").alias("text"))
    head = lambda name: F.regexp_extract("text", rf"{name}\s+(-?[0-9.eE+]+)", 1).try_cast("double")
    body = F.regexp_extract("text", r"(?s)^(?:\s*[a-z_]+[ \t]+[^\n]*\n)+(.*)$", 1)
    parsed = whole.select("file", head("ncols").cast("int").alias("n"), head("nodata_value").alias("void"), F.split(F.trim(F.regexp_replace(body, r"\s+", " ")), " ").alias("v"))
    cells = parsed.select("file", "n", "void", F.posexplode("v").alias("i", "raw")).withColumn("value", F.col("raw").try_cast("double"))
    return cells.select("file", F.floor(F.col("i") / F.col("n")).alias("row"), (F.col("i") % F.col("n")).alias("col"), F.when(~F.col("value").eqNullSafe(F.col("void")), F.col("value")).alias("value"))


def stream_events(text: Column) -> Column:
    """JSON payloads of an event-stream text: blocks between blank lines, their data lines joined, comments skipped."""
    blocks = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+")
    data = F.transform(blocks, lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substring(x, 6, 1 << 30))), "\n"))
    return F.filter(data, lambda d: F.try_parse_json(d).isNotNull())


def write_tiles(df: DataFrame, path: str) -> None:
    """Parquet by tile; only the tiles in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ix", "iy").parquet(path)


def feature(kind: Column, rings: Column) -> Column:
    """GeoJSON feature text of a polygon."""
    geometry = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(kind.alias("kind")).alias("properties"), geometry.alias("geometry")))
