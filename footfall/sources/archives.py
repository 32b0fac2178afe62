"""Zipped and shaped inputs: CSV members of zip files, and shapefiles."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.ship import ship

POLYGON_KINDS = (5, 15, 25)


def csv_rows(raw: bytes, part: str = "Data") -> Iterator[tuple[int, dict]]:
    """Numbered rows, as text, of the first CSV member whose name holds ``part``."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        name = next(n for n in z.namelist() if part in n and n.endswith(".csv"))
        with z.open(name) as f:
            at = 0
            for chunk in pd.read_csv(f, dtype=str, keep_default_na=False, na_values=[""], chunksize=10_000):
                for row in chunk.to_dict("records"):
                    yield at, {k: v for k, v in row.items() if isinstance(v, str)}
                    at += 1


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str], part: str = "Data") -> DataFrame:
    """``columns`` as text, and ord, of the CSV inside every zip file of a path."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                held = []
                for at, row in csv_rows(raw, part):
                    held.append((at, row))
                    if len(held) >= 10_000:
                        yield pd.DataFrame(held, columns=["ord", "row"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["ord", "row"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "ord long, row map<string,string>")
    return rows.select("ord", *[F.col("row").getItem(c).alias(c) for c in columns])


def shape_rings(shp: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """Record number and rings, without closing vertices, of a shapefile's polygons."""
    at, record = 100, 0
    while at + 12 <= len(shp):
        words = struct.unpack(">i", shp[at + 4 : at + 8])[0]
        body = shp[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack("<i", body[:4])[0]
        if kind in POLYGON_KINDS:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            vertices = list(zip(xy[::2], xy[1::2]))
            rings = [vertices[a:b] for a, b in zip(starts, starts[1:])]
            yield record, [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in rings]
        record += 1
        at += 8 + 2 * words


def dbf_rows(dbf: bytes) -> Iterator[dict[str, str]]:
    """Attribute rows of a shapefile as text."""
    count, header, width = struct.unpack("<IHH", dbf[4:12])
    fields = []
    at = 32
    while dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode()
        fields.append((name, dbf[at + 16]))
        at += 32
    for i in range(count):
        row, at = {}, header + i * width + 1
        for name, size in fields:
            row[name] = dbf[at : at + size].decode("utf-8", "replace").strip()
            at += size
        yield row


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """record, ring_no, attributes and ring of the polygons in zipped shapefiles."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    name = next(n for n in z.namelist() if n.endswith(".shp"))
                    facts = list(dbf_rows(z.read(name[:-4] + ".dbf")))
                    rows = [
                        (record, k, facts[record] if record < len(facts) else {}, [{"x": x, "y": y} for x, y in ring])
                        for record, rings in shape_rings(z.read(name))
                        for k, ring in enumerate(rings)
                    ]
                    yield pd.DataFrame(rows, columns=["record", "ring_no", "attributes", "ring"])

    schema = "record long, ring_no int, attributes map<string,string>, ring array<struct<x double, y double>>"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
