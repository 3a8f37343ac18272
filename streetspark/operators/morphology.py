"""Street morphology: orientation, circuity, degree topology, distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E

BINS = 36
SLACK = 1e-9


def both_ways(bearings: DataFrame, b: str = "bearing") -> DataFrame:
    """Every observation with its reciprocal."""
    rest = [c for c in bearings.columns if c != b]
    return bearings.select(*rest, F.explode(F.array(F.col(b), E.reciprocal(b))).alias(b))


def orientation_histogram(bearings: DataFrame, keys: list[str], weight: Column | None = None, bins: int = BINS, offset=0.0) -> DataFrame:
    """(keys, bin, centre, lower, upper, total, probability), all bins of every group; probabilities are 0 if a group is empty."""
    width = 360.0 / bins
    shift = E.wrap(F.lit(offset) if isinstance(offset, (int, float)) else offset, width)
    x = bearings.withColumn("bin", E.bin_index("bearing", bins, offset)).withColumn("_w", weight if weight is not None else F.lit(1.0))
    sums = x.groupBy(*keys, "bin").agg(F.sum("_w").alias("total"))
    every = bearings.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    y = every.join(sums, [*keys, "bin"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    all_ = F.sum("total").over(Window.partitionBy(*keys))
    y = y.withColumn("probability", F.when(all_ > 0, F.col("total") / F.when(all_ > 0, all_)).otherwise(F.lit(0.0)))
    centre = E.wrap(shift + F.col("bin") * width)
    return y.select(*keys, "bin", centre.alias("centre"), (centre - width / 2).alias("lower"), (centre + width / 2).alias("upper"), "total", "probability")


def shannon_entropy(p: Column) -> Column:
    """An aggregate, in nats."""
    return F.sum(F.when(p > 0, -p * F.ln(F.when(p > 0, p))).otherwise(F.lit(0.0)))


def orientation_entropy(bearings: DataFrame, keys: list[str], weight: Column | None = None, bins: int = BINS, offset=0.0) -> DataFrame:
    h = orientation_histogram(bearings, keys, weight, bins, offset)
    return h.groupBy(*keys).agg(shannon_entropy(F.col("probability")).alias("entropy"))


def orientation_order(entropy: Column, bins: int = BINS) -> Column:
    low, high = math.log(4), math.log(bins)
    q = (entropy - low) / (high - low)
    return F.lit(1.0) - q * q


def edge_circuity(length: Column, distance: Column) -> Column:
    """length / distance; not below 1 but for rounding, and never clipped."""
    bad = F.raise_error(F.lit("the distance must be positive")).cast("double")
    small = F.raise_error(F.lit("an edge is shorter than its chord")).cast("double")
    q = length / F.when(distance > 0, distance)
    return F.when(distance <= 0, bad).when(q < 1 - SLACK, small).otherwise(q)


def descriptive(x: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Count, total, mean, median, extremes, population deviation, linear quantiles."""
    q = F.percentile(v, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    s = x.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("std"), q.alias("q")
    )
    names = ["q25", "median", "q75", "q90", "q95"]
    return s.select(*keys, "n", "total", "mean", "least", "most", "std", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def distribution(x: DataFrame, keys: list[str], v: str) -> DataFrame:
    """How many values are within 1e-6 of one, and beyond 1.01, 1.05, 1.1 and 1.2; counts and proportions."""
    tests = {"near_one": F.abs(F.col(v) - 1) <= 1e-6} | {f"over_{str(t).replace('.', '_')}": F.col(v) > t for t in (1.01, 1.05, 1.1, 1.2)}
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, test in tests.items():
        aggs += [F.count_if(test).alias(name), (F.count_if(test) / F.count(F.lit(1))).alias(f"{name}_share")]
    return x.groupBy(*keys).agg(*aggs)
