"""Shapefiles that many tasks read at once: a data source with a partition for every range of records."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from footfall.ship import ship
from footfall.sources.archives import shape_rings

#: Records that one task reads.
RECORDS = 20_000
#: Bytes of a shape file's and an index file's header, and of a record of the index.
HEADER, INDEX_RECORD = 100, 8


def _open(path: str):
    """A file for reading by ranges, in any store that Arrow knows."""
    from pyarrow.fs import FileSystem

    system, name = FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return system.open_input_file(name)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.stem = options["path"].removesuffix(".shp")
        self.step = int(options.get("records", RECORDS))

    def partitions(self) -> Sequence[InputPartition]:
        with _open(f"{self.stem}.shx") as index:
            n = (index.size() - HEADER) // INDEX_RECORD
        return [Range(a, min(n, a + self.step)) for a in range(0, n, self.step)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.first == part.last:
            return
        with _open(f"{self.stem}.shx") as index:
            index.seek(HEADER + part.first * INDEX_RECORD)
            words = struct.unpack(f">{2 * (part.last - part.first)}i", index.read((part.last - part.first) * INDEX_RECORD))
        begin, end = 2 * words[0], 2 * (words[-2] + words[-1]) + 8
        with _open(f"{self.stem}.shp") as shapes:
            shapes.seek(begin)
            # the header's place is left empty, as records begin behind it
            body = bytes(HEADER) + shapes.read(end - begin)
        with _open(f"{self.stem}.dbf") as table:
            start = table.read(32)
            count, header, width = struct.unpack("<IHH", start[4:12])
            described = table.read(header - 32)
            table.seek(header + part.first * width)
            facts = table.read(width * max(0, min(part.last, count) - part.first))
        fields = []
        for at in range(0, len(described) - 31, 32):
            if described[at] == 0x0D:
                break
            fields.append((described[at : at + 11].split(b"\0")[0].decode(), described[at + 16]))
        for record, rings in shape_rings(body):
            row, at = {}, record * width + 1
            for name, size in fields if at < len(facts) else ():
                row[name] = facts[at : at + size].decode("utf-8", "replace").strip()
                at += size
            yield part.first + record, row, [[{"x": x, "y": y} for x, y in ring] for ring in rings]


class ShapefileSource(DataSource):
    """``format("footfall_shapes")`` with ``path``, the .shp file beside its .shx and .dbf, and ``records`` a task."""

    @classmethod
    def name(cls) -> str:
        return "footfall_shapes"

    def schema(self) -> str:
        return "record long, attributes map<string,string>, rings array<array<struct<x: double, y: double>>>"

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options)


def read_shapes(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """record, attributes and rings of an unpacked shapefile's polygons, ``records`` to a task.

    The driver looks at the size of the index only; each task reads its part of
    the index, and then the bytes of its own shapes and attributes.
    """
    ship(spark)
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("footfall_shapes").option("path", path).option("records", str(records)).load()
