"""Tolerance sweeps: how polylines converge, and which tolerance suffices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geometry


def sweep(curves: DataFrame, keys: list[str], tolerances: list[float], max_depth: int = 60) -> DataFrame:
    """(keys, segment_id, tolerance, n_vertices, length) per curve and tolerance."""
    x = curves.withColumn("tolerance", F.explode(F.array(*map(F.lit, tolerances))))
    v = geometry.adaptive_samples(x, F.col("tolerance"), max_depth)
    key = [*keys, "segment_id", "tolerance"]
    p = geometry.polyline_lengths(v, key, "pos")
    return p.select(*key, (F.col("n_pieces") + 1).alias("n_vertices"), "length")


def analyse(swept: DataFrame, reference: DataFrame, keys: list[str], ordinary: float = 0.0) -> DataFrame:
    """Per tolerance: vertices, total length, summed absolute error, relative errors against ``reference`` (keys, segment_id, reference, zero_chord)."""
    j = swept.join(reference, [*keys, "segment_id"])
    error = F.abs(F.col("length") - F.col("reference"))
    usable = ~F.col("zero_chord") & (F.col("reference") >= ordinary) & (F.col("reference") > 0)
    return j.groupBy(*keys, "tolerance").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("n_vertices").alias("vertices"), F.min("n_vertices").alias("least"), F.max("n_vertices").alias("most"),
        F.percentile("n_vertices", 0.5).alias("median"), F.sum("length").alias("total"), F.sum(error).alias("absolute_error"), (F.sum(error) / F.sum("reference")).alias("aggregate_error"),
        F.max(F.when(usable, error / F.col("reference"))).alias("worst_error"),
    )


def successive(swept: DataFrame, keys: list[str]) -> DataFrame:
    """Per tolerance, against the next finer one: the largest absolute and relative change of a curve and the relative change of the total."""
    w = Window.partitionBy(*keys, "segment_id").orderBy(F.col("tolerance").desc())
    x = swept.withColumn("finer", F.lead("length").over(w))
    change = F.abs(F.col("finer") - F.col("length"))
    return x.groupBy(*keys, "tolerance").agg(
        F.max(change).alias("max_change"), F.max(F.when(F.col("finer") > 0, change / F.when(F.col("finer") > 0, F.col("finer")))).alias("max_relative"),
        F.abs(F.sum("finer") - F.sum("length")).alias("_d"), F.sum("finer").alias("_f"),
    ).withColumn("total_relative", F.when(F.col("_f") > 0, F.col("_d") / F.when(F.col("_f") > 0, F.col("_f")))).drop("_d", "_f")


def select(successive_: DataFrame, keys: list[str], total: float, worst: float) -> DataFrame:
    """(tolerance): the coarsest that passes in every group; the finest has no finer neighbour and is never taken."""
    ok = (F.col("total_relative") <= total) & (F.col("max_relative") <= worst)
    x = successive_.groupBy("tolerance").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))
    return x.where("ok").agg(F.max("tolerance").alias("tolerance"))
