"""Declared layers: conforming frames, quality checks as generated SQL, and idempotent sinks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"TEXT": T.StringType(), "REAL": T.DoubleType(), "INTEGER": T.LongType(), "BOOLEAN": T.BooleanType(), "JSON": T.StringType(), "DATETIME": T.TimestampType()}
LINEAGE = ("source_id", "run_id", "load_ts")


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    nullable: bool = True
    unique: bool = False
    codes: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Layer:
    name: str
    columns: tuple[Column, ...]
    free_form: bool = False
    parents: dict[str, tuple[str, str]] = field(default_factory=dict, hash=False)  # column: (parent layer, parent column)

    def struct(self) -> T.StructType:
        meta = lambda c: {"unique": c.unique, "codes": list(c.codes)}
        own = [T.StructField(c.name, TYPES[c.kind], c.nullable, meta(c)) for c in self.columns]
        return T.StructType([*own, T.StructField("source_id", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("load_ts", T.TimestampType())])


class Violations(ValueError):
    """Everything that is wrong with a frame, found in one pass."""


def conform(df: DataFrame, layer: Layer) -> DataFrame:
    """df with the layer's columns first, in order and cast; all violations are counted in one aggregate and raised together."""
    known = {c.name for c in layer.columns} | set(LINEAGE)
    problems = [] if layer.free_form else [f"unknown column {c}" for c in df.columns if c not in known]
    out = df.select(*[(F.col(c.name).try_cast(TYPES[c.kind].simpleString()) if c.name in df.columns else F.lit(None).cast(TYPES[c.kind])).alias(c.name) for c in layer.columns], *[c for c in df.columns if c not in {x.name for x in layer.columns}])
    counts = {}
    for c in layer.columns:
        v = F.col(c.name)
        if not c.nullable:
            counts[f"{c.name} is null"] = F.count_if(v.isNull())
        if c.codes:
            counts[f"{c.name} is not a known code"] = F.count_if(v.isNotNull() & ~v.isin(*c.codes))
        if c.low is not None or c.high is not None:
            counts[f"{c.name} is out of range"] = F.count_if(((v < c.low) if c.low is not None else F.lit(False)) | ((v > c.high) if c.high is not None else F.lit(False)))
        if c.unique:
            counts[f"{c.name} is not unique"] = F.count(v) - F.count_distinct(v)
    if counts:
        row = out.agg(*[n.alias(f"c{i}") for i, n in enumerate(counts.values())]).first()
        problems += [f"{what}: {row[i]}" for i, what in enumerate(counts) if row[i]]
    if problems:
        raise Violations(f"{layer.name}: " + "; ".join(problems))
    return out


def checks(layers: list[Layer]) -> list[tuple[str, str, str]]:
    """(kind, what, SQL) for every rule of the layers; each statement counts violating rows."""
    out = []
    for layer in layers:
        for c in layer.columns:
            at = f"{layer.name}.{c.name}"
            if c.codes:
                listed = ", ".join("'" + x.replace("'", "''") + "'" for x in c.codes)
                out.append(("domain", at, f"SELECT count(*) AS n FROM {layer.name} WHERE {c.name} IS NOT NULL AND {c.name} NOT IN ({listed})"))
            if c.low is not None or c.high is not None:
                limits = " OR ".join(x for x in (f"{c.name} < {c.low}" if c.low is not None else "", f"{c.name} > {c.high}" if c.high is not None else "") if x)
                out.append(("range", at, f"SELECT count(*) AS n FROM {layer.name} WHERE {limits}"))
            if c.unique:
                out.append(("unique", at, f"SELECT coalesce(sum(k - 1), 0) AS n FROM (SELECT count(*) AS k FROM {layer.name} WHERE {c.name} IS NOT NULL GROUP BY {c.name} HAVING count(*) > 1) d"))
            if not c.nullable:
                out.append(("required", at, f"SELECT count(*) AS n FROM {layer.name} WHERE {c.name} IS NULL"))
        for col, (parent, key) in layer.parents.items():
            out.append(("orphan", f"{layer.name}.{col}", f"SELECT count(*) AS n FROM {layer.name} c LEFT ANTI JOIN {parent} p ON c.{col} = p.{key} WHERE c.{col} IS NOT NULL"))
    return out


def run_checks(spark: SparkSession, statements: list[tuple[str, str, str]]) -> DataFrame:
    """kind, what, n: the statements as one plan."""
    out = None
    for kind, what, sql in statements:
        one = spark.sql(sql).select(F.lit(kind).alias("kind"), F.lit(what).alias("what"), F.col("n").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "kind string, what string, n long")


def write_layer(df: DataFrame, layer: Layer, root: str, source_id: str, run_id: str, slices: tuple[str, ...] = ("run_id", "source_id")) -> str:
    """Conform, stamp and write a layer; a rerun of the same run and source replaces just that slice."""
    path = f"{root}/{layer.name}"
    stamped = conform(df, layer).withColumns({"source_id": F.lit(source_id), "run_id": F.lit(run_id), "load_ts": F.current_timestamp()})
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*slices).parquet(path)
    return path


def difference(a: T.StructType, b: T.StructType) -> list[str]:
    """Every difference between two schemas, in words."""
    left, right = {f.name: f for f in a}, {f.name: f for f in b}
    out = [f"{n} is only in the first" for n in left if n not in right] + [f"{n} is only in the second" for n in right if n not in left]
    for n in left:
        if n in right:
            if left[n].dataType != right[n].dataType:
                out.append(f"{n}: {left[n].dataType.simpleString()} and {right[n].dataType.simpleString()}")
            if left[n].nullable != right[n].nullable:
                out.append(f"{n}: nullable {left[n].nullable} and {right[n].nullable}")
    return out


CHECKS = "layer string, kind string, what string, n long, severity string, ok boolean, run_id string"


def check_records(results: DataFrame, run_id: str, severity: dict[str, str] | None = None) -> DataFrame:
    """Results of run_checks() as records: each with its severity (error unless its kind says else) and whether it holds."""
    kinds = severity or {}
    said = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()], F.lit("error"))
    return results.select(F.element_at(F.split("what", r"\."), 1).alias("layer"), "kind", "what", "n", said.alias("severity"), (F.col("n") == 0).alias("ok"), F.lit(run_id).alias("run_id"))


def write_checks(records: DataFrame, path: str) -> int:
    """Replace the records of their run and give the number of failed errors."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return records.where("severity = 'error' and not ok").count()


def gate(failed: int) -> None:
    """No run goes on with failed errors."""
    if failed:
        raise Violations(f"{failed} checks failed")


def summary(records: DataFrame) -> DataFrame:
    """kind, checks, failed, rows of check records."""
    return records.groupBy("kind").agg(F.count("*").alias("checks"), F.count_if(~F.col("ok")).alias("failed"), F.sum("n").alias("rows"))


def same_result(name: str, stated: DataFrame, found: DataFrame) -> DataFrame:
    """One check result: how many rows two ways of computing a result do not share, repeated rows counted."""
    cols = sorted(stated.columns)
    off = stated.select(*cols).exceptAll(found.select(*cols)).unionByName(found.select(*cols).exceptAll(stated.select(*cols)))
    return off.agg(F.lit("signature").alias("kind"), F.lit(name).alias("what"), F.count("*").alias("n"))


def register(spark: SparkSession, root: str, layer: Layer, run_id: str, rows: int) -> None:
    """Note that a layer was written in a run; a layer is there only if some run noted it."""
    row = spark.createDataFrame([(layer.name, run_id, rows, layer.struct().json())], "layer string, run_id string, rows long, struct string")
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "run_id").parquet(f"{root}/_layers")


def written_layers(spark: SparkSession, root: str) -> dict[str, T.StructType]:
    """Layers that were written, by the catalogue, each with its latest declared structure."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_layers")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    rows = spark.read.parquet(f"{root}/_layers").groupBy("layer").agg(F.max_by("struct", "run_id").alias("struct")).collect()  # one row per declared layer
    return {r.layer: T.StructType.fromJson(json.loads(r.struct)) for r in rows}


def catalogue_difference(spark: SparkSession, root: str, layers: list[Layer]) -> list[str]:
    """Every difference between the declared layers and those written."""
    have = written_layers(spark, root)
    declared = {x.name: x for x in layers}
    out = [f"{n} was never written" for n in declared if n not in have] + [f"{n} is not declared" for n in have if n not in declared]
    return out + [f"{n}: {d}" for n in declared if n in have for d in difference(declared[n].struct(), have[n])]


def empty_layers(spark: SparkSession, layers: list[Layer]) -> dict[str, DataFrame]:
    """An empty table of every declared layer."""
    return {x.name: spark.createDataFrame([], x.struct()) for x in layers}
