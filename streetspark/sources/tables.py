"""CSV and JSON tables and documents, inventories and manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    from ..operators.graph import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Typed rows of CSV with a header; the schema is given, never inferred, and a row or a header that does not fit it is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in that order, with a header; other columns are left out. One file a partition."""
    df.select(*fields).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line; numbers that are not finite are an error."""
    checks = [F.col(f"`{c}`") for c, t in df.dtypes if t in ("double", "float")]
    bad = F.lit(False)
    for c in checks:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    safe = df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a number that is not finite")).cast("boolean")).otherwise(F.lit(True)))
    safe.write.json(path)


def document(values: dict) -> str:
    """One JSON document: two spaces of indentation, a newline at the end, no NaN."""
    return json.dumps(values, indent=2, ensure_ascii=False, allow_nan=False) + "\n"


def write_document(spark: SparkSession, values: dict, path: str) -> None:
    """A folder with one document, written by Spark so that any shared file system will do."""
    spark.createDataFrame([(document(values).removesuffix("\n"),)], "value string").coalesce(1).write.text(path)


def inventory(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, n_columns) of each table."""
    out: DataFrame | None = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = row if out is None else out.union(row)
    return out


def unmet(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, reason) where an inventory is not as expected: missing, unexpected, or different in a column that both have."""
    both = [c for c in expected.columns if c != key and c in found.columns]
    j = found.alias("f").join(expected.alias("e"), F.col(f"f.{key}") == F.col(f"e.{key}"), "full")
    reason = F.when(F.col(f"f.{key}").isNull(), "missing").when(F.col(f"e.{key}").isNull(), "unexpected")
    for c in both:
        reason = reason.when(~F.col(f"f.{c}").eqNullSafe(F.col(f"e.{c}")), f"another {c}")
    return j.select(F.coalesce(f"f.{key}", f"e.{key}").alias(key), reason.alias("reason")).where("reason IS NOT NULL")


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions that a run depends on."""
    import sys

    import numpy
    import pandas
    import pyarrow

    return {"python": sys.version.split()[0], "spark": spark.version, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}
