"""Readers that give texts, points, polygons and timetable tables."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrid.operators.ranking import keep_first


def read_csv(spark: SparkSession, path: str, breaks: bool = True, x: str | None = None, y: str | None = None) -> DataFrame:
    """A CSV file with a header, every column a text.

    With ``breaks`` quoted line breaks are kept, which makes a file one task; without, files are split. Where x and
    y are named they must be columns (else ValueError) and become numbers, and rows without both are dropped.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=breaks, escape='"')
    missing = [c for c in (x, y) if c and c not in df.columns]
    if missing or bool(x) != bool(y):
        raise ValueError(f"no such columns: {missing or [x, y]}")
    return points_from(df, x, y) if x else df


def read_zipped(spark: SparkSession, path: str, member: str | None, columns: list[str]) -> DataFrame:
    """The named columns, as texts, of a member (or the first CSV) of zip archives; bad bytes are replaced.

    Archives are read whole, one per task, as a zip must be; the rows of each are then distributed.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    name = member or next(n for n in z.namelist() if n.lower().endswith(".csv"))
                    if name not in z.namelist():
                        continue
                    with io.TextIOWrapper(z.open(name), encoding="utf-8-sig", errors="replace") as text:
                        for part in pd.read_csv(text, dtype=str, keep_default_na=False, na_values=[""], chunksize=50_000):
                            part = part.reindex(columns=columns).astype(object)
                            yield part.where(part.notna(), None)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_geojson(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """properties (map of texts), geometry_type, x, y for points, rings for polygons, lines for lines, of features.

    A collection is one document and so one task; with ``per_line`` every line is a feature and files are split.
    """
    feature = T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])
    if per_line:
        features = spark.read.schema(feature).json(path)
    else:
        features = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    rows = features.select("properties", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("c"))
    kind, c = F.col("geometry_type"), F.col("c")
    read = lambda depth: F.from_json(c, "array<" * depth + "double" + ">" * depth)
    polygon = F.when(kind == "MultiPolygon", F.flatten(read(4))).when(kind == "Polygon", read(3))
    line = F.when(kind == "MultiLineString", read(3)).when(kind == "LineString", F.array(read(2)))
    as_points = lambda part: F.transform(part, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    point = F.when(kind == "Point", read(1))
    return rows.select("properties", "geometry_type", point[0].alias("x"), point[1].alias("y"), F.transform(polygon, as_points).alias("rings"), F.transform(line, as_points).alias("lines"))


def read_layer(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, where: Column | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A layer, or an empty one where nothing was written yet: chosen columns of rows that hold and whose bbox meets a box."""
    df = read_or_empty(spark, path, schema)
    if box is not None:
        b = F.col
        df = df.where((b("bbox.xmin") <= box[2]) & (b("bbox.xmax") >= box[0]) & (b("bbox.ymin") <= box[3]) & (b("bbox.ymax") >= box[1]))
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: list[str]) -> DataFrame:
    """Columns of parquet with a ``bbox`` struct (xmin, ymin, xmax, ymax) that meets a box, pushed to the scan."""
    x0, y0, x1, y1 = box
    b = F.col
    return spark.read.parquet(path).where((b("bbox.xmin") <= x1) & (b("bbox.xmax") >= x0) & (b("bbox.ymin") <= y1) & (b("bbox.ymax") >= y0)).select(*columns)


def points_from(df: DataFrame, x: str, y: str) -> DataFrame:
    """x and y as numbers; rows without both are dropped."""
    return df.withColumns({x: F.col(x).try_cast("double"), y: F.col(y).try_cast("double")}).dropna(subset=[x, y])


def map_fields(df: DataFrame, fields: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed to targets ({target: source}); unknown sources and missing targets are errors."""
    missing = [s for s in fields.values() if s not in df.columns]
    absent = [t for t in required if t not in fields]
    if missing or absent:
        raise ValueError(f"sources not in the table: {missing}; targets not mapped: {absent}")
    return df.select(*[F.col(s).alias(t) for t, s in fields.items()], *[c for c in df.columns if c not in fields.values() and c not in fields])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table, or an empty one of the schema where nothing was written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


@dataclass
class Source:
    """One input: where it is, whether it may be used, how its columns map, and a hook for its own rules."""

    ident: str
    path: str | None
    fields: dict[str, str]
    key: str
    required: tuple[str, ...] = ()
    enabled: bool = True
    shape: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    keep: Column | None = None
    order: tuple[str, ...] = ()  # which row of a key comes first; by all columns that can be compared if none

    def state(self) -> str:
        """ready, disabled or not configured: a source without a path never gives made-up rows."""
        return "disabled" if not self.enabled else "ready" if self.path else "not configured"

    def standard(self, df: DataFrame) -> DataFrame:
        """Mapped, filtered to the area, shaped, one row per key: the first by ``order``, then by its other columns."""
        out = map_fields(df, self.fields, self.required).select(*self.fields)
        out = self.shape(out.where(self.keep) if self.keep is not None else out)
        compared = [f.name for f in out.schema if f.dataType.typeName() not in ("map", "variant") and f.name not in self.order]
        return keep_first(out, [self.key], [F.col(c) for c in (*self.order, *compared)]).withColumn("source_id", F.lit(self.ident))


def local_file(path: str | None, cached: str | None) -> str:
    """The stated path if it exists, else the cached copy, else an error."""
    for p in (path, cached):
        if p and os.path.exists(p):
            return p
    raise FileNotFoundError(path or cached or "no path is configured")
