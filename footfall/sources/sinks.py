"""Writing tables, reports, features and the published artifact."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by way of the file system that holds ``path``."""
    write_pieces(spark, path, [text])


def write_pieces(spark: SparkSession, path: str, pieces: Iterable[str]) -> None:
    """One file from pieces of text, none of which waits for the others."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        for text in pieces:
            out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def write_report(df: DataFrame, path: str) -> dict:
    """The only row of ``df`` as indented JSON; returns it."""
    row = json.loads(df.select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    write_text(df.sparkSession, path, json.dumps(row, indent=2))
    return row


def features(df: DataFrame, name: str = "name", ring: str = "ring") -> DataFrame:
    """One GeoJSON feature per row as text; with a column ``rings``, a polygon with its holes."""
    rings = F.col("rings") if "rings" in df.columns else F.array(F.col(ring))
    coordinates = F.transform(rings, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"])))
    return df.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.col(name).alias("name")).alias("properties"),
                F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            )
        ).alias("feature")
    )


def write_features(df: DataFrame, path: str, name: str = "name", ring: str = "ring") -> None:
    """A folder of features, one a line, written by as many tasks as ``df`` has."""
    features(df, name, ring).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, name: str = "name", ring: str = "ring") -> None:
    """A FeatureCollection in one file, written as partitions come in, one at a time."""

    def pieces():
        yield '{"type":"FeatureCollection","features":['
        for k, r in enumerate(features(df, name, ring).toLocalIterator()):
            yield "," * bool(k) + r["feature"]
        yield "]}"

    write_pieces(df.sparkSession, path, pieces())


def _facility_fields() -> list:
    return [
        "ord", "id", "name", "address", "city", "lat", "lon", "confidence",
        F.col("in_study_area").alias("inStudyArea"), "simulatable", F.col("exclude_reason").alias("excludeReason"),
    ]


def _cell_fields() -> list:
    return [
        "ord", "h3", "city", "households", "lat", "lon", F.col("nearest_id").alias("nearestId"),
        F.col("nearest_m").alias("nearestM"), F.col("second_id").alias("secondId"), F.col("second_m").alias("secondM"),
    ]


def artifact(cells: DataFrame, facilities: DataFrame, meta: dict) -> DataFrame:
    """The published document in one row of JSON: meta, facilities and cells.

    For documents that a browser can hold; :func:`publish` writes any size.
    """
    facility, cell = F.struct(*_facility_fields()), F.struct(*_cell_fields())
    f = facilities.agg(F.array_sort(F.collect_list(facility)).alias("facilities"))
    c = cells.agg(F.array_sort(F.collect_list(cell)).alias("hexes"))
    whole = F.struct(F.from_json(F.lit(json.dumps(meta)), F.schema_of_json(F.lit(json.dumps(meta)))).alias("meta"), "facilities", "hexes")
    options = {"ignoreNullFields": "false"}
    return f.join(c, F.lit(True)).select(F.to_json(whole, options).alias("document"))


def publish(cells: DataFrame, facilities: DataFrame, meta: dict, target: str) -> None:
    """Both tables as Parquet and the document as JSON under ``target``.

    The document is written row by row, in the tables' order, so its size
    doesn't matter to the driver or to a task.
    """
    write_table(cells, f"{target}/cells")
    write_table(facilities, f"{target}/facilities")

    def pieces():
        yield '{"meta":' + json.dumps(meta)
        for key, df, row in (("facilities", facilities, _facility_fields), ("hexes", cells, _cell_fields)):
            yield f',"{key}":['
            rows = df.select(F.to_json(F.struct(*row()), {"ignoreNullFields": "false"}).alias("j"), "ord").orderBy("ord")
            for k, r in enumerate(rows.toLocalIterator()):
                yield "," * bool(k) + r["j"]
            yield "]"
        yield "}"

    write_pieces(cells.sparkSession, f"{target}/artifact.json", pieces())
