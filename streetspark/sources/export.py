"""Nested curve exports (JSON) as typed rows, with gates; file hashes; canonical fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XYZ = "struct<x:double,y:double,z:double>"
POINTS = f"struct<p0:{XYZ},p1:{XYZ},p2:{XYZ}>"
SEGMENT = f"struct<segment_index:int,segment_id:string,local:{POINTS},world:{POINTS}>"
SHAPE = f"struct<shape_index:int,shape_id:string,segment_count:int,path_thickness:double,fill_path_loops:boolean,segments:array<{SEGMENT}>>"
SCHEMA = f"environment_id int, environment_label string, schema_version string, shape_count int, segment_count int, total_segment_count int, export_timestamp_utc string, shapes array<{SHAPE}>"
VERSION = "1.0.0"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """One row a document; the schema is fixed, never inferred."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def segments(docs: DataFrame) -> DataFrame:
    """One row a curve: environment, shape, segment, planar world control points and whether it is a zero chord."""
    x = docs.select("environment_id", F.explode("shapes").alias("s"))
    x = x.select("environment_id", "s.shape_id", "s.shape_index", F.explode("s.segments").alias("g"))
    coords = [F.col(f"g.world.p{i}.{c}").alias(f"{c}{i}") for i in range(3) for c in "xy"]
    x = x.select("environment_id", "shape_id", "shape_index", "g.segment_id", "g.segment_index", *coords)
    from ..operators.geometry import zero_chord

    return x.withColumn("zero_chord", zero_chord())


def violations(docs: DataFrame) -> DataFrame:
    """(environment_id, reason): versions, counts, planarity, finiteness, repeated ids."""
    every = docs.select("*", F.explode_outer("shapes").alias("s"))
    flat = every.select("environment_id", F.explode("s.segments").alias("g")).select("environment_id", "g.segment_id", "g.world")
    xyz = [F.col(f"world.p{i}.{c}") for i in range(3) for c in "xyz"]
    bad = F.lit(False)
    for v in xyz:
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    off = F.lit(False)
    for i in range(3):
        off = off | (F.coalesce(F.col(f"world.p{i}.z"), F.lit(0.0)) != 0)
    counted = F.aggregate("shapes", F.lit(0), lambda a, s: a + F.size(s["segments"]))
    out = [
        docs.where(~F.col("schema_version").eqNullSafe(VERSION)).select("environment_id", F.lit("schema version").alias("reason")),
        docs.where(F.col("shape_count") != F.size("shapes")).select("environment_id", F.lit("shape count")),
        docs.where(F.coalesce("total_segment_count", "segment_count") != counted).select("environment_id", F.lit("segment count")),
        every.where(F.col("s.segment_count") != F.size("s.segments")).select("environment_id", F.lit("segment count of a shape")),
        flat.where(bad).select("environment_id", F.lit("a coordinate that is not finite")),
        flat.where(off).select("environment_id", F.lit("not planar")),
        flat.groupBy("environment_id", "segment_id").count().where("count > 1").select("environment_id", F.lit("repeated segment id")),
    ]
    x = out[0]
    for y in out[1:]:
        x = x.union(y)
    return x


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def gate(hashes: DataFrame, expected: dict[str, str]) -> None:
    """An error unless every expected file name is there with its hash; the names are few, so they come to the driver."""
    found = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in hashes.where(F.element_at(F.split("path", "/"), -1).isin(list(expected))).collect()}
    wrong = sorted(k for k, v in expected.items() if found.get(k) != v)
    if wrong:
        raise ValueError(f"missing or changed: {', '.join(wrong)}")


def fingerprint_of(text: str) -> str:
    """SHA-256 of a JSON document without its time of export, keys sorted, compact."""
    d = json.loads(text)
    d.pop("export_timestamp_utc", None)
    return hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def canonical_fingerprint(c: Column) -> Column:
    return F.udf(fingerprint_of, "string")(c)


def assert_empty(df: DataFrame, what: str) -> None:
    """An error that shows a few of the rows, if there are any."""
    rows = df.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {rows}")

