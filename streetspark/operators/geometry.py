"""Curves: sampling, splitting, bounds, lengths, classes.

A curve row has ``segment_id`` and x0, y0, x1, y1, x2, y2 (DOUBLE); other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E

CONTROL = ["x0", "y0", "x1", "y1", "x2", "y2"]
NEAR_COLLINEAR = 1e-6


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed_samples(curves: DataFrame, n: int = 101) -> DataFrame:
    """n points at equal steps of t; the ends are the control points."""
    x = curves.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("i") / F.lit(float(n - 1)))
    return x.withColumn("x", E.point("x0", "x1", "x2", "t")).withColumn("y", E.point("y0", "y1", "y2", "t"))


def with_bounds(curves: DataFrame) -> DataFrame:
    """min_x, max_x, min_y, max_y; generated as one row, so that the expressions are not repeated wherever bounds are used."""
    made = []
    for c in E.AXES:
        low, high = E.bounds(*[f"{c}{i}" for i in range(3)])
        made += [low.alias(f"min_{c}"), high.alias(f"max_{c}")]
    return curves.select("*", F.inline(F.array(F.struct(*made))))


def zero_chord() -> Column:
    return (F.col("x0") == F.col("x2")) & (F.col("y0") == F.col("y2")) & ((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))


def deviation_ratio() -> Column:
    """Distance of the control point from the chord, by the chord; null for a zero chord."""
    cx, cy = F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0")
    square = cx * cx + cy * cy
    c = E.cross(cx, cy, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return F.when(square > 0, F.abs(c) / F.when(square > 0, square))


def control_class() -> Column:
    cx, cy = F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0")
    c = E.cross(cx, cy, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    named = F.when((cx == 0) & (cy == 0), "zero_chord").when(c == 0, "exactly_collinear")
    return named.when(deviation_ratio() <= NEAR_COLLINEAR, "near_collinear").otherwise("deviating")


def split_at(curves: DataFrame, t: Column) -> DataFrame:
    """Two rows a curve, ``side`` left and right, with t_start, t_end and own control points."""
    wrong = F.raise_error(F.lit("a split is strictly inside")).cast("double")
    t = F.when((t > 0) & (t < 1), t).otherwise(wrong)
    (ax, mx, bx), (ay, my, by) = (E.split(f"{c}0", f"{c}1", f"{c}2", t) for c in E.AXES)
    left = [F.col("x0"), F.col("y0"), ax, ay, mx, my, F.lit(0.0), t]
    right = [mx, my, bx, by, F.col("x2"), F.col("y2"), t, F.lit(1.0)]
    names = [*CONTROL, "t_start", "t_end"]
    sides = F.array(*[F.struct(F.lit(s).alias("side"), *[v.alias(n) for v, n in zip(vs, names, strict=True)]) for s, vs in (("left", left), ("right", right))])
    rest = [c for c in curves.columns if c not in CONTROL]
    return curves.select(*rest, F.explode(sides).alias("p")).select(*rest, "p.*")


def split_parameters(ts: Column, equivalence: float = 0.0) -> Column:
    """Sorted parameters without those within ``equivalence`` of the last one that is kept."""
    start = F.array().cast("array<double>")
    return F.aggregate(
        F.array_sort(ts),
        start,
        lambda kept, t: F.when(F.coalesce(t - F.get(kept, F.size(kept) - 1) <= equivalence, F.lit(False)), kept).otherwise(F.array_append(kept, t)),
    )


def split_at_many(curves: DataFrame, ts: Column, equivalence: float = 0.0) -> DataFrame:
    """A row a piece: piece (from 0), t_start, t_end and the control points of the piece.

    The control point of the piece [a, b] is the blossom at (a, b), so pieces need no order.
    """
    cuts = F.concat(F.array(F.lit(0.0)), split_parameters(ts, equivalence), F.array(F.lit(1.0)))
    x = curves.withColumn("_cuts", cuts)
    rest = [c for c in curves.columns if c not in CONTROL]
    x = x.select(*rest, *CONTROL, "_cuts", F.posexplode(F.slice("_cuts", 1, F.size("_cuts") - 1)).alias("piece", "t_start"))
    x = x.withColumn("t_end", F.get("_cuts", F.col("piece") + 1))

    def blossom(c: str, a: Column, b: Column) -> Column:
        p0, p1, p2 = (F.col(f"{c}{i}") for i in range(3))
        return (1 - a) * (1 - b) * p0 + ((1 - a) * b + a * (1 - b)) * p1 + a * b * p2

    a, b = F.col("t_start"), F.col("t_end")
    new = [blossom(c, u, v).alias(f"{c}{i}") for i, (u, v) in enumerate(((a, a), (a, b), (b, b))) for c in E.AXES]
    return x.select(*rest, "piece", "t_start", "t_end", *new)


def adaptive_samples(curves: DataFrame, tolerance: Column | float, max_depth: int = 60) -> DataFrame:
    """(all columns, t, x, y): the vertices of the adaptive polyline.

    A dyadic interval is a leaf if its control point is within 2 * tolerance of its chord; a zero chord is one only if all
    three points are equal. The levels are one row's frontier, expanded by an array fold, so a curve
    never leaves its row and nothing is shuffled. Intervals that are no leaves at max_depth are an error.
    """
    x = _adaptive_parameters(curves, tolerance, max_depth).select(*curves.columns, F.posexplode("_t").alias("pos", "t"))
    px, py = _place(F.col("t"))
    return x.withColumn("x", px).withColumn("y", py)


def adaptive_polylines(curves: DataFrame, tolerance: Column | float, max_depth: int = 60) -> DataFrame:
    """The curves with ``geometry``, the vertices of ``adaptive_samples`` as one array of pos, x and y; no row is dealt anew."""
    point = lambda t, i: F.struct(i.alias("pos"), *[c.alias(n) for c, n in zip(_place(t), E.AXES, strict=True)])
    return _adaptive_parameters(curves, tolerance, max_depth).select(*curves.columns, F.transform("_t", point).alias("geometry"))


def _place(t: Column) -> tuple[Column, ...]:
    return tuple(F.when(t == 0, F.col(f"{c}0")).when(t == 1, F.col(f"{c}2")).otherwise(E.point(f"{c}0", f"{c}1", f"{c}2", t)) for c in E.AXES)


def _adaptive_parameters(curves: DataFrame, tolerance: Column | float, max_depth: int) -> DataFrame:
    """The curves with ``_t``, the sorted parameters of their vertices."""
    tol = F.lit(float(tolerance)) if isinstance(tolerance, (int, float)) else tolerance
    x = curves.withColumn("_tol", F.when(tol > 0, tol).otherwise(F.raise_error(F.lit("the tolerance must be positive")).cast("double")))
    iv = "array<struct<a:double,b:double>>"

    def accepted(a: Column, b: Column) -> Column:
        w = b - a
        ax, ay = E.point("x0", "x1", "x2", a), E.point("y0", "y1", "y2", a)
        bx, by = E.point("x0", "x1", "x2", b), E.point("y0", "y1", "y2", b)
        cx, cy = bx - ax, by - ay
        # the blossom at (a, b), from the start
        hx = w * E.derivative("x0", "x1", "x2", a) / 2.0
        hy = w * E.derivative("y0", "y1", "y2", a) / 2.0
        chord = F.sqrt(cx * cx + cy * cy)
        flat = F.abs(E.cross(cx, cy, hx, hy)) / F.when(chord > 0, chord) / 2.0 <= F.col("_tol")
        return F.when(chord > 0, flat).otherwise((hx == 0) & (hy == 0))

    def level(state: Column, depth: Column) -> Column:
        # every interval is judged once a level, and nothing is done once no interval is open
        return F.when(F.size(state["open"]) == 0, state).otherwise(let(F.transform(state["open"], judged), lambda j: split(state, j)))

    def judged(i: Column) -> Column:
        return F.struct(i["a"].alias("a"), i["b"].alias("b"), accepted(i["a"], i["b"]).alias("flat"))

    def split(state: Column, j: Column) -> Column:
        plain = lambda x: F.transform(x, lambda i: F.struct(i["a"].alias("a"), i["b"].alias("b")))
        done, rest = plain(F.filter(j, lambda i: i["flat"])), F.filter(j, lambda i: ~i["flat"])

        def halves(i: Column) -> Column:
            m = (i["a"] + i["b"]) / 2.0
            return F.array(F.struct(i["a"].alias("a"), m.alias("b")), F.struct(m.alias("a"), i["b"].alias("b")))

        return F.struct(F.concat(state["done"], done).alias("done"), F.flatten(F.transform(rest, halves)).alias("open"))

    start = F.struct(F.array().cast(iv).alias("done"), F.array(F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))).alias("open"))
    folded = F.aggregate(F.sequence(F.lit(0), F.lit(max_depth)), start, level)
    # most pieces are flat as they are: no level is looked at for them
    whole = F.struct(F.array(F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))).alias("done"), F.array().cast(iv).alias("open"))
    x = x.withColumn("_s", F.when(accepted(F.lit(0.0), F.lit(1.0)), whole).otherwise(folded))
    deep = F.raise_error(F.lit("the curve is not flat at the largest depth")).cast("array<double>")
    ends = F.array_sort(F.transform(F.col("_s.done"), lambda i: i["b"]))
    return x.withColumn("_t", F.when(F.size("_s.open") == 0, F.concat(F.array(F.lit(0.0)), ends)).otherwise(deep))


def array_length(points: Column) -> Column:
    """Length of a polyline, an array of structs with x and y."""
    steps = F.transform(
        points, lambda p, i: F.coalesce(E.norm(p["x"] - F.get(points, i - 1)["x"], p["y"] - F.get(points, i - 1)["y"]), F.lit(0.0))
    )
    return F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)


def polyline_lengths(points: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Length of each polyline whose points are rows (key, pos, x, y)."""
    return pieces(points, key, pos).groupBy(*key).agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_pieces"))


def pieces(points: DataFrame, key: list[str], pos: str) -> DataFrame:
    """(key, pos, dx, dy, length) of consecutive points."""
    w = Window.partitionBy(*key).orderBy(pos)
    x = points.withColumn("dx", F.lead("x").over(w) - F.col("x")).withColumn("dy", F.lead("y").over(w) - F.col("y"))
    return x.where("dx IS NOT NULL").select(*key, pos, "dx", "dy", E.norm("dx", "dy").alias("length"))


def selected_linework(curves: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """(keys, segment_id, n_vertices, length, geometry): the adaptive polylines; an end that is not the curve's exact end is an error."""
    v = adaptive_samples(curves, tolerance)
    key = [*keys, "segment_id", *CONTROL]
    g = v.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "t", "x", "y"))).alias("geometry"))
    a, b = F.get("geometry", F.lit(0)), F.element_at("geometry", -1)
    exact = (a["x"] == F.col("x0")) & (a["y"] == F.col("y0")) & (b["x"] == F.col("x2")) & (b["y"] == F.col("y2"))
    wrong = F.raise_error(F.lit("a polyline does not end where its curve does")).cast("array<struct<pos:int,t:double,x:double,y:double>>")
    g = g.withColumn("geometry", F.when(exact, F.col("geometry")).otherwise(wrong))
    return g.select(*keys, "segment_id", F.size("geometry").alias("n_vertices"), array_length(F.col("geometry")).alias("length"), "geometry")


def excursions(curves: DataFrame, keys: list[str], n: int = 101) -> DataFrame:
    """(keys, segment_id, excursion): how far curves with a zero chord go from their ends, over n samples."""
    x = fixed_samples(curves.where(zero_chord()), n)
    return x.groupBy(*keys, "segment_id").agg(F.max(E.norm(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))).alias("excursion"))


def arc_length(n: int = 16):
    """A pandas UDF of the six control coordinates: Gauss-Legendre quadrature on intervals graded towards the place where the curve is slowest."""
    nodes, weights = np.polynomial.legendre.leggauss(n)
    steps = 1.0 - np.power(0.25, np.arange(1, 13))

    @F.pandas_udf("double")
    def length(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        p0, p1, p2 = (np.stack([x.to_numpy(float), y.to_numpy(float)], 1) for x, y in ((x0, y0), (x1, y1), (x2, y2)))
        e, d = p1 - p0, p0 - 2 * p1 + p2
        square = (d * d).sum(1)
        slow = np.where(square > 0, np.clip(-(e * d).sum(1) / np.where(square > 0, square, 1), 0, 1), 0.5)[:, None]
        one = np.ones_like(slow)
        at = np.hstack([0 * one, slow * steps, slow, slow + (1 - slow) * (1 - steps[::-1]), one])
        half = np.diff(at, axis=1) / 2
        t = at[:, :-1, None] + half[:, :, None] * (nodes + 1)
        v = 2 * (e[:, None, None, :] + t[..., None] * d[:, None, None, :])
        return pd.Series((np.hypot(v[..., 0], v[..., 1]) * weights * half[:, :, None]).sum((1, 2)))

    return length
