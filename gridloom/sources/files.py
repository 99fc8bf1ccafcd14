"""GeoJSON, CSV and image readers, generated tables, and the GeoJSON writer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import VERTEX

_FEATURES = "features array<struct<type:string, geometry:struct<type:string, coordinates:variant>, properties:{p}>>"


def read_geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """A feature collection with declared properties (``struct<...>``) to a row for each feature with ``geom``.
    ``lines``: one feature on each line instead, which splits and so scales."""
    if lines:
        schema = f"type string, geometry struct<type:string, coordinates:variant>, properties {properties}"
        rows = spark.read.schema(schema).json(path)
    else:
        rows = spark.read.schema(_FEATURES.format(p=properties)).option("multiLine", True).json(path).selectExpr("inline(features)")
    return rows.withColumn("geom", geometry_of()).select("properties.*", "geom")


def geometry_of() -> F.Column:
    """The struct geometry of a GeoJSON geometry with variant coordinates, by its type."""
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = lambda part: F.transform(part, lambda ring: F.transform(ring, xy))
    kind = F.col("geometry.type")
    cast = lambda t: F.expr(f"try_variant_get(geometry.coordinates, '$', '{t}')")
    point = cast("array<double>")
    parts = (
        F.when(kind == "Polygon", F.array(rings(cast("array<array<array<double>>>"))))
        .when(kind == "MultiPolygon", F.transform(cast("array<array<array<array<double>>>>"), rings))
        .when(kind == "Point", F.array(F.array(F.array(F.struct(point[0].alias("x"), point[1].alias("y"))))))
    )
    wrong = F.raise_error(F.concat(F.lit("geometry type not supported: "), kind)).cast("boolean")
    fine = F.when(kind.isin("Polygon", "MultiPolygon", "Point"), F.lit(True)).otherwise(wrong)
    return F.when(kind.isNotNull() & fine, F.struct(kind.alias("kind"), F.lit(4326).alias("srid"), parts.cast(f"array<array<array<{VERTEX}>>>").alias("parts")))


def features(df: DataFrame, properties: list[str], geom: str = "geom") -> DataFrame:
    """``value``: one GeoJSON feature of each row. Missing properties are left out; NaN and infinities become text."""
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    g, kind = F.col(geom), F.col(geom)["kind"]
    parts = F.transform(g["parts"], lambda part: F.transform(part, ring))
    coordinates = (
        F.when(kind == "Polygon", F.to_json(parts[0]))
        .when(kind == "MultiPolygon", F.to_json(parts))
        .when(kind == "Point", F.to_json(parts[0][0][0]))
        .otherwise(F.raise_error(F.concat(F.lit("geometry kind not supported: "), F.coalesce(kind, F.lit("none")))))
    )
    shape = F.when(g.isNotNull(), F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))).otherwise(F.lit("null"))
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


def write_geojson(df: DataFrame, path: str, properties: list[str], geom: str = "geom", lines: bool = True) -> None:
    """``lines``: a feature on each line, in as many files as partitions. Else one collection: its rows meet in one task,
    so only for tables that are to be one file."""
    rows = features(df, properties, geom)
    if not lines:
        rows = rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    rows.write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_csv_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A file read without types: all columns are text until ``numbers`` casts some."""
    return read_csv(spark, path, ", ".join(f"`{n}` string" for n in names))


def numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Casts text columns to doubles; text that is no number becomes null."""
    return df.withColumns({n: F.col(f"`{n}`").try_cast("double") for n in names})


def read_csv_promote_header(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A file whose first line is a title: its second line is the header and the last one a footer. All columns are text.

    Lines are told apart by their place in the file, so this is for single files; the header is the one row that is
    read on the driver.
    """
    placeholder = ", ".join(f"_{i} string" for i in range(len(names)))
    raw = spark.read.schema(placeholder).option("header", True).option("enforceSchema", True).csv(path).withColumn("_at", F.monotonically_increasing_id())
    ends = raw.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    head = raw.join(F.broadcast(ends), F.col("_at") == F.col("lo")).select([f"_{i}" for i in range(len(names))]).first()
    found = [h if h else n for h, n in zip(head or names, names)]
    body = raw.join(F.broadcast(ends), (F.col("_at") > F.col("lo")) & (F.col("_at") < F.col("hi")))
    return body.select([F.col(f"_{i}").alias(n) for i, n in enumerate(found)])


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, r, g, b`` of every pixel of the images Spark's reader understands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for height, width, channels, data in batch.itertuples(index=False):
                cells = np.frombuffer(data, np.uint8).reshape(height * width, channels).astype(float)
                at = np.arange(height * width)
                blue, green, red = (cells[:, c % channels] for c in range(3))  # gray images have one channel
                yield pd.DataFrame({"row": at // width, "col": at % width, "r": red, "g": green, "b": blue})

    image = spark.read.format("image").load(path).select("image.height", "image.width", "image.nChannels", "image.data")
    return image.mapInPandas(run, "row bigint, col bigint, r double, g double, b double")


def literal(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """``id, x`` of a small matrix written out."""
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id bigint, x array<double>")


def zeros(spark: SparkSession, n_rows: int, n_columns: int) -> DataFrame:
    """``id, x``: rows of zeros."""
    return spark.range(n_rows).select("id", F.array_repeat(F.lit(0.0), n_columns).alias("x"))


def write_frames(frames: DataFrame, path: str) -> None:
    """A folder for each ``frame_k``, so that one frame is read without the others."""
    frames.write.mode("overwrite").partitionBy("frame_k").parquet(path)


def read_frame(spark: SparkSession, path: str, schema: str, k: int) -> DataFrame:
    """One frame of those that ``write_frames`` wrote; only its folder is read."""
    return spark.read.schema(f"{schema}, frame_k int").parquet(path).filter(F.col("frame_k") == k)


def linspace(spark: SparkSession, first: float, last: float, n: int) -> DataFrame:
    """``id, r``: n points, both ends included."""
    return spark.range(n).select("id", (F.lit(first) + F.col("id") * F.lit((last - first) / max(1, n - 1))).alias("r"))


def arange(spark: SparkSession, first: float, end: float, step: float) -> DataFrame:
    """``step, t``: the end is excluded."""
    n = max(0, math.ceil((end - first) / step))
    return spark.range(n).select(F.col("id").cast("int").alias("step"), (F.lit(float(first)) + F.col("id") * F.lit(float(step))).alias("t"))
