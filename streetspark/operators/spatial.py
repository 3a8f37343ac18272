"""Spatial joins by grid cells: an equi-join on the cell, then the exact predicate.

A plain range join would be a nested loop. Cells come in levels, each twice as large as the one below; a box is at home in the level whose cells
are not smaller than it, so it touches four of them at most, however large it is. It also visits the larger levels that other boxes are at
home in. A pair meets in the home cells of its larger box, and counts only in the cell
of the larger of the two lower left corners, so no pair is found twice and nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E


def cells(low: Column, high: Column, size: float | Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def typical_extent(boxes: DataFrame) -> float:
    """Size of the least cells: the larger of the mean extents; 1.0 if there is none."""
    m = boxes.agg(F.avg(F.col("max_x") - F.col("min_x")), F.avg(F.col("max_y") - F.col("min_y"))).first()
    return max(m[0] or 0.0, m[1] or 0.0) or 1.0


def level_of(cell: float) -> Column:
    """The home level of a box."""
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return F.when(extent > cell, F.ceil(F.log2(extent / cell))).otherwise(F.lit(0)).cast("int")


def present_levels(boxes: DataFrame, cell: float) -> list[int]:
    """The levels that boxes are at home in; a few dozen at most, as each doubles the extent."""
    return sorted(boxes.agg(F.collect_set(level_of(cell))).first()[0])


def size_of(level: Column, cell: float) -> Column:
    return F.pow(F.lit(2.0), level) * F.lit(cell)


def bbox_pairs(boxes: DataFrame, group: list[str], ident: str, cell: float | None = None) -> DataFrame:
    """(group, a, b) of boxes that overlap, touching included; a < b. Without ``cell`` the mean extent is asked for first."""
    cell = cell or typical_extent(boxes)
    levels = present_levels(boxes, cell)
    x = boxes.select("*", F.explode(F.array(level_of(cell))).alias("home"))  # generated, so that it is not repeated below
    visits = F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col("home")) if levels else F.array(F.lit(0))
    every = x.withColumn("level", F.explode(visits))
    for c in E.AXES:
        every = every.withColumn(f"c{c}", F.explode(cells(F.col(f"min_{c}"), F.col(f"max_{c}"), size_of(F.col("level"), cell))))
    a, b = every.where("home = level").alias("a"), every.alias("b")
    # of two boxes at home in one level the one with the smaller id is a; one from below is always b
    on = (F.col("b.home") < F.col("b.level")) | (F.col(f"a.{ident}") < F.col(f"b.{ident}"))
    for c in (*group, "level", "cx", "cy"):
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    own = F.lit(True)
    for c in E.AXES:
        own = own & (F.col(f"a.c{c}") == F.floor(F.greatest(F.col(f"a.min_{c}"), F.col(f"b.min_{c}")) / size_of(F.col("a.level"), cell)))
    j = a.join(b, on & E.overlap("a", "b") & own)
    i, k = F.col(f"a.{ident}"), F.col(f"b.{ident}")
    return j.select(*[F.col(f"a.{c}").alias(c) for c in group], F.least(i, k).alias("a"), F.greatest(i, k).alias("b"))


def point_box_pairs(points: DataFrame, boxes: DataFrame, group: list[str], cell: float) -> DataFrame:
    """Points (px, py ...) with the boxes that hold them, edges included; all columns of both."""
    levels = present_levels(boxes, cell)
    b = boxes.select("*", F.explode(F.array(level_of(cell))).alias("level"))
    p = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array(F.lit(0))))
    for c in E.AXES:
        b = b.withColumn(f"c{c}", F.explode(cells(F.col(f"min_{c}"), F.col(f"max_{c}"), size_of(F.col("level"), cell))))
        p = p.withColumn(f"c{c}", F.floor(F.col(f"p{c}") / size_of(F.col("level"), cell)))
    j = p.join(b, [*group, "level", "cx", "cy"])
    for c in E.AXES:
        j = j.where((F.col(f"p{c}") >= F.col(f"min_{c}")) & (F.col(f"p{c}") <= F.col(f"max_{c}")))
    return j.drop("level", "cx", "cy")


def distance_pairs(points: DataFrame, group: list[str], ident: str, most: float) -> DataFrame:
    """(group, a, b, distance) of points with 0 < distance <= most; a < b."""
    at = lambda c: F.floor(F.col(c) / most)
    left = points.withColumn("cx", at("x")).withColumn("cy", at("y"))
    right = points
    for c in E.AXES:
        right = right.withColumn(f"c{c}", F.explode(F.sequence(at(c) - 1, at(c) + 1)))
    on = F.col(f"a.{ident}") < F.col(f"b.{ident}")
    for c in (*group, "cx", "cy"):
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    d = E.norm(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    j = left.alias("a").join(right.alias("b"), on).withColumn("distance", d).where((F.col("distance") > 0) & (F.col("distance") <= most))
    return j.select(*[F.col(f"a.{c}").alias(c) for c in group], F.col(f"a.{ident}").alias("a"), F.col(f"b.{ident}").alias("b"), "distance")


def first_tolerance(distance: Column, tolerances: list[float]) -> Column:
    """The least positive tolerance that is not below the distance; null if there is none."""
    out = F.lit(None).cast("double")
    for t in sorted((t for t in tolerances if t > 0), reverse=True):
        out = F.when(distance <= t, F.lit(float(t))).otherwise(out)
    return out


def distance_gaps(pairs: DataFrame, group: list[str], d: str = "distance", least_ratio: float = 10.0) -> DataFrame:
    """Per group: distinct distances, the largest ratio of neighbours, the two distances, whether that is a natural gap."""
    from pyspark.sql import Window

    x = pairs.select(*group, d).distinct()
    x = x.withColumn("next", F.lead(d).over(Window.partitionBy(*group).orderBy(d))).withColumn("ratio", F.col("next") / F.col(d))
    best = F.max(F.struct(F.col("ratio"), (-F.col(d)).alias("low"), F.col("next").alias("high")))
    y = x.groupBy(*group).agg(F.count(F.lit(1)).alias("n_distances"), F.max("ratio").alias("largest_ratio"), best.alias("x"))
    return y.select(*group, "n_distances", "largest_ratio", (-F.col("x.low")).alias("below"), F.col("x.high").alias("above"), F.coalesce(F.col("largest_ratio") >= least_ratio, F.lit(False)).alias("natural_gap"))
