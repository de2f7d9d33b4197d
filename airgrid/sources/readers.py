"""Readers: state vectors, encodings, GeoJSON, shapefiles, newest files, and observations derived from events."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from airgrid.functions import scalars as S

TEXT = "time string, lat string, lon string, baroaltitude string, icao24 string"


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-16 or UTF-8 by the byte-order mark. The head of one file comes to the driver, three bytes of it."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 3).alias("h")).first()["h"]
    return "UTF-16" if bytes(head[:2]) in (b"\xff\xfe", b"\xfe\xff") else "UTF-8"


def state_vectors(spark: SparkSession, path: str, schema: str = TEXT, encoding: str | None = None) -> DataFrame:
    """CSV with a header, columns as text and by name: numbers are judged later, and what is not selected is not parsed. UTF-16
    cannot be split at line ends, so such a file is one task's."""
    reader = spark.read.option("header", True).option("enforceSchema", False).option("encoding", encoding or encoding_of(spark, path))
    if (encoding or encoding_of(spark, path)).startswith("UTF-16"):
        reader = reader.option("multiLine", True)
    return reader.schema(schema).csv(path)


def observations(events: DataFrame) -> DataFrame:
    """Observations from the event table: a deterministic stand-in for state vectors."""
    spread = lambda k, m, low, size: F.lit(low) + F.lit(size) * (F.col("event_id") * k % m).cast("double") / float(m)
    return events.select(
        "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"), spread(7919, 10007, 41.48, 0.73).alias("lat"), spread(104729, 10009, -88.34, 0.82).alias("lon"),
        (F.col("value") * 6.0).alias("baroaltitude"), F.col("user_id").alias("icao24"),
    )


def geojson(spark: SparkSession, path: str, properties: str, geometry: str = "array<array<array<double>>>") -> DataFrame:
    """Features of a FeatureCollection under a declared schema: properties' columns and coordinates. Line-delimited features, as
    ``sinks.write_features`` makes them, are read in splits by ``spark.read.json`` instead."""
    feature = f"struct<type: string, properties: struct<{properties}>, geometry: struct<type: string, coordinates: {geometry}>>"
    rows = spark.read.option("multiLine", True).schema(f"type string, features array<{feature}>").json(path)
    return rows.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("coordinates"))


def newest(spark: SparkSession, pattern: str) -> str:
    """The file with the latest date in its name; files without one go by their time of change."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")  # contents are not read
    return newest_of(rows).first()["path"]


def newest_of(files: DataFrame) -> DataFrame:
    """path of the newest of (path, modificationTime)."""
    day = F.coalesce(S.dataset_date(F.element_at(F.split("path", "/"), -1)).cast("timestamp"), F.col("modificationTime").cast("timestamp"))
    return files.agg(F.max_by("path", F.struct(day.alias("d"), F.col("path"))).alias("path"))


def first_that_exists(spark: SparkSession, *paths: str) -> str:
    """The first path that is there; raises if none is."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return p
    raise FileNotFoundError(", ".join(paths))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


# ---- shapefiles ------------------------------------------------------------------------------------------------------


class ShapePart(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ShapefileReader(DataSourceReader):
    """Polygons of a .shp by its .shx index, with the text and number fields of its .dbf; records are read in ranges."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.rows = schema, options["path"].removeprefix("file://").removesuffix(".shp"), int(options.get("rowsPerPartition", 20_000))

    def partitions(self):
        import os

        n = (os.path.getsize(f"{self.path}.shx") - 100) // 8
        return [ShapePart(k, min(k + self.rows, n)) for k in range(0, n, self.rows)] or [ShapePart(0, 0)]

    def read(self, partition):
        with open(f"{self.path}.dbf", "rb") as dbf, open(f"{self.path}.shx", "rb") as shx, open(f"{self.path}.shp", "rb") as shp:
            yield from records(shp, shx, dbf, [f.name for f in self.schema.fields if f.name != "geometry"], partition.first, partition.last)


def records(shp, shx, dbf, wanted: list[str], first: int, last: int):
    """(wanted fields, geometry) of the records from first to last of a shapefile's three files."""
    head = dbf.read(32)
    start, size = struct.unpack("<HH", head[8:12])
    fields, at = {}, 1
    for _ in range((start - 33) // 32):
        raw = dbf.read(32)
        name = raw[:11].split(b"\0")[0].decode()
        fields[name] = (at, raw[16], chr(raw[11]))
        at += raw[16]
    for k in range(first, last):
        dbf.seek(start + k * size)
        row = dbf.read(size)
        values = []
        for name in wanted:
            a, n, kind = fields[name]
            text = row[a : a + n].decode("utf-8", "replace").strip()
            values.append((float(text) if "." in text else int(text)) if kind in "NF" and text.strip("*") else (text or None) if kind not in "NF" else None)
        shx.seek(100 + 8 * k)
        shp.seek(2 * struct.unpack(">i", shx.read(4))[0] + 8)
        yield (*values, polygon(shp))


def shapefiles(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The same of every shapefile whose path without its ending meets a pattern, in any store that Spark reads: a task per file, which
    holds the file. For a single large one on a path that all machines have, the data source reads ranges."""
    files = spark.read.format("binaryFile").load(pattern + ".{shp,shx,dbf}").select("path", "content")
    part = lambda kind: F.max(F.when(F.right("path", F.lit(3)) == kind, F.col("content"))).alias(kind)
    whole = files.groupBy(F.expr("left(path, length(path) - 4)").alias("stem")).agg(part("shp"), part("shx"), part("dbf"))
    names = StructType.fromDDL(schema).names

    def run(frames):
        import io

        import pandas as pd

        for frame in frames:
            for _, shp, shx, dbf in frame.itertuples(index=False):
                n = (len(shx) - 100) // 8
                for at in range(0, n, 20_000):
                    rows = list(records(io.BytesIO(shp), io.BytesIO(shx), io.BytesIO(dbf), [c for c in names if c != "geometry"], at, min(at + 20_000, n)))
                    table = pd.DataFrame(rows, columns=[*[c for c in names if c != "geometry"], "geometry"])
                    if "geometry" in names:
                        table["geometry"] = [g and [[{"x": x, "y": y} for x, y in ring] for ring in g] for g in table["geometry"]]
                    yield table[names]

    return whole.mapInPandas(run, schema)


def polygon(f) -> list | None:
    """Rings of (x, y) of the polygon record at f's place."""
    if struct.unpack("<i", f.read(4))[0] not in (5, 15, 25):
        return None
    f.read(32)
    parts, points = struct.unpack("<ii", f.read(8))
    begins = [*struct.unpack(f"<{parts}i", f.read(4 * parts)), points]
    flat = struct.unpack(f"<{2 * points}d", f.read(16 * points))
    return [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(begins, begins[1:], strict=False)]


class Shapefile(DataSource):
    """spark.read.format("shapefile").schema("GEOID string, ALAND long, geometry array<array<struct<x: double, y: double>>>")"""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        return "geometry array<array<struct<x: double, y: double>>>"

    def reader(self, schema):
        return ShapefileReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Shapefile)
