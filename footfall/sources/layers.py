"""Map layers and tables: reading, pruning by box, and checking columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import constants as C
from footfall.operators.spatial import in_bbox, overlaps_bbox

Box = tuple[float, float, float, float]


def session(app: str = "footfall", **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` adds settings, such as those of an object store."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    return builder.config(map=settings).getOrCreate()


def layer_path(root: str, theme: str, kind: str) -> str:
    return f"{root.rstrip('/')}/theme={theme}/type={kind}"


def first_readable(spark: SparkSession, roots: Sequence[str], theme: str, kind: str) -> str:
    """The first root whose layer yields a row; the error of none names what each one said."""
    problems = []
    for root in roots:
        try:
            spark.read.parquet(layer_path(root, theme, kind)).limit(1).collect()
            return root
        except Exception as error:  # an unreachable store fails in many ways
            said = (str(error).splitlines() or [""])[0][:300]
            problems.append(f"{root}: {type(error).__name__}: {said}")
    raise FileNotFoundError("no root can be read: " + "; ".join(problems))


def select_if_present(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """The expressions whose own column ``df`` has, by name."""
    have = set(df.columns)
    return df.select(*[expr.alias(name) for name, expr in wanted.items() if name in have])


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.limit(1).isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def points_in_box(df: DataFrame, box: Box) -> DataFrame:
    """Rows whose bbox starts in the box; pushed down to nested Parquet columns."""
    return df.where(in_bbox(F.col("bbox.xmin"), F.col("bbox.ymin"), box))


def extents_in_box(df: DataFrame, box: Box) -> DataFrame:
    """Rows whose bbox meets the box."""
    b = [F.col(f"bbox.{k}") for k in ("xmin", "ymin", "xmax", "ymax")]
    return df.where(overlaps_bbox(*b, box))


def extract_layer(spark: SparkSession, root: str, theme: str, kind: str, box: Box, target: str, points: bool = False) -> DataFrame:
    """A layer's rows of a box, written to ``target`` once.

    The extract keeps the box and root it was made for beside it; the same ones
    again read it back. Required columns are checked on either path.
    """
    import json

    from footfall.sources.sinks import exists, read_text, write_text

    note, mark = f"{target.rstrip('/')}.json", json.dumps({"root": root, "box": list(box)}, sort_keys=True)
    name = target.rstrip("/").rpartition("/")[2].split(".")[0]
    if not (exists(spark, target) and exists(spark, note) and read_text(spark, note).strip() == mark):
        df = spark.read.parquet(layer_path(root, theme, kind))
        (points_in_box if points else extents_in_box)(df, box).write.mode("overwrite").parquet(target)
        write_text(spark, note, mark)
    out = spark.read.parquet(target)
    return require_rows(require_columns(out, C.LAYER_COLUMNS.get(name, []), name), name)


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "|") -> DataFrame:
    """Columns of a delimited file with a header, all as text."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return require_columns(df, columns, path).select(*columns)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, ring and rings of every polygon of a FeatureCollection, a row for each part of a MultiPolygon.

    ``ring`` is the outer one, ``rings`` are all of them, holes included; none
    repeats its first vertex. :func:`one_shape` puts the parts together.
    """
    point = "array<array<array<double>>>"
    schema = "features array<struct<properties struct<name string>, geometry struct<type string, coordinates string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return _polygons(raw.select(F.posexplode("features").alias("ord", "f")), point)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The same of a folder or file with one feature a line, which many tasks read at once; ``ord`` is null."""
    raw = spark.read.schema("properties struct<name string>, geometry struct<type string, coordinates string>").json(path)
    return _polygons(raw.select(F.lit(None).cast("int").alias("ord"), F.struct("properties", "geometry").alias("f")), "array<array<array<double>>>")


def _polygons(features: DataFrame, point: str) -> DataFrame:
    shapes = features.select("ord", "f.properties.name", "f.geometry.*")
    one = F.array(F.from_json("coordinates", point))
    many = F.from_json("coordinates", f"array<{point}>")
    parts = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", many)
    rings = shapes.select("ord", "name", F.explode(parts).alias("polygon"))

    def open_ring(r):
        vertices = F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        shut = (F.size(vertices) > 1) & (F.element_at(vertices, 1) == F.element_at(vertices, -1))
        return F.when(shut, F.slice(vertices, F.lit(1), F.size(vertices) - 1)).otherwise(vertices)

    rings = rings.select("ord", "name", F.transform("polygon", open_ring).alias("rings"))
    return rings.select("ord", "name", F.get("rings", F.lit(0)).alias("ring"), "rings")


def one_shape(polygons: DataFrame, *keys: str) -> DataFrame:
    """All rings of a name (or of other keys) as one polygon of several parts."""
    keys = keys or ("ord", "name")
    return polygons.groupBy(*keys).agg(F.flatten(F.array_sort(F.collect_list("rings"))).alias("rings"))
