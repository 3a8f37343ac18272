import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetspark.functions import exprs as E
from streetspark.operators import geometry, intersect

NAMES = ["segment_id", *geometry.CONTROL]
CURVES = {
    "straight": ((0, 0), (5, 0), (10, 0)),
    "arch": ((-1, 0), (0, 2), (1, 0)),
    "skew": ((0, 0), (4, 8), (10, 1)),
    "zero": ((2, -1), (2.2, -0.7), (2, -1)),
    "back": ((0, 0), (1, 0), (0, 0)),
}


@pytest.fixture(scope="module")
def curves(spark):
    rows = [(k, *(float(v) for p in c for v in p)) for k, c in CURVES.items()]
    return spark.createDataFrame(rows, NAMES)


def literal_adaptive(c, tol):
    """Plain recursion by halving."""

    def at(t):
        return [(1 - t) ** 2 * c[0][k] + 2 * (1 - t) * t * c[1][k] + t * t * c[2][k] for k in (0, 1)]

    def go(p, q, r):
        cx, cy, hx, hy = r[0] - p[0], r[1] - p[1], q[0] - p[0], q[1] - p[1]
        chord = math.hypot(cx, cy)
        if (abs(cx * hy - cy * hx) / chord / 2 <= tol) if chord else (hx == 0 and hy == 0):
            return [r]
        a, b = [(x + y) / 2 for x, y in zip(p, q)], [(x + y) / 2 for x, y in zip(q, r)]
        m = [(x + y) / 2 for x, y in zip(a, b)]
        return go(p, a, m) + go(m, b, r)

    return [list(c[0]), *go(list(c[0]), list(c[1]), list(c[2]))]


def test_classes(curves):
    got = {r[0]: r[1] for r in curves.select("segment_id", geometry.control_class()).collect()}
    assert got == {"straight": "exactly_collinear", "arch": "deviating", "skew": "deviating", "zero": "zero_chord", "back": "zero_chord"}


@pytest.mark.parametrize("tol", [0.5, 0.01])
def test_adaptive_samples_are_those_of_recursion(curves, tol):
    got = geometry.adaptive_samples(curves, tol).orderBy("segment_id", "pos").collect()
    for k, c in CURVES.items():
        mine = [(r["x"], r["y"]) for r in got if r["segment_id"] == k]
        want = literal_adaptive(c, tol)
        assert len(mine) == len(want)
        assert np.allclose(mine, want, atol=1e-12)


def test_zero_chord_keeps_its_excursion(curves):
    n = {r[0]: r[1] for r in geometry.adaptive_samples(curves, 10.0).groupBy("segment_id").count().collect()}
    assert n["zero"] >= 3 and n["back"] >= 3 and n["straight"] == 2


def test_tolerance_must_be_positive(curves):
    with pytest.raises(Exception, match="positive"):
        geometry.adaptive_samples(curves, 0.0).collect()


def test_depth_is_an_error(curves):
    with pytest.raises(Exception, match="largest depth"):
        geometry.adaptive_samples(curves, 1e-12, max_depth=3).collect()


def test_split_pieces_join_and_cover(curves):
    p = geometry.split_at_many(curves, F.array(F.lit(0.7), F.lit(0.2), F.lit(0.2)), 0.0).orderBy("segment_id", "piece").collect()
    for k, c in CURVES.items():
        mine = [r for r in p if r["segment_id"] == k]
        assert [(r["t_start"], r["t_end"]) for r in mine] == [(0.0, 0.2), (0.2, 0.7), (0.7, 1.0)]
        assert np.allclose([mine[0]["x0"], mine[0]["y0"], mine[-1]["x2"], mine[-1]["y2"]], [*c[0], *c[2]])
        for a, b in zip(mine, mine[1:]):
            assert math.isclose(a["x2"], b["x0"], abs_tol=1e-12) and math.isclose(a["y2"], b["y0"], abs_tol=1e-12)


def test_split_only_inside(curves):
    with pytest.raises(Exception, match="strictly inside"):
        geometry.split_at(curves, F.lit(1.0)).collect()


def test_bounds_hold_all_samples(curves):
    b = {r["segment_id"]: r for r in geometry.with_bounds(curves).collect()}
    for r in geometry.fixed_samples(curves, 201).collect():
        q = b[r["segment_id"]]
        assert q["min_x"] - 1e-12 <= r["x"] <= q["max_x"] + 1e-12 and q["min_y"] - 1e-12 <= r["y"] <= q["max_y"] + 1e-12
    assert b["arch"]["max_y"] == 1.0


def test_arc_length(curves):
    got = {r[0]: r[1] for r in curves.select("segment_id", geometry.arc_length()(*geometry.CONTROL)).collect()}
    t = np.linspace(0, 1, 200_001)[:, None]
    for k, c in CURVES.items():
        p = np.array(c, float)
        fine = (1 - t) ** 2 * p[0] + 2 * (1 - t) * t * p[1] + t * t * p[2]
        assert math.isclose(got[k], np.hypot(*np.diff(fine, axis=0).T).sum(), rel_tol=1e-8)


def test_bearings(spark):
    rows = [(0.0, 1.0, 0.0), (1.0, 0.0, 90.0), (0.0, -1.0, 180.0), (-1.0, 0.0, 270.0)]
    df = spark.createDataFrame(rows, "dx double, dy double, want double").select("want", E.bearing("dx", "dy").alias("b"))
    df = df.withColumn("r", E.reciprocal("b")).withColumn("bin", E.bin_index("b"))
    for r in df.collect():
        assert r["b"] == r["want"] and r["r"] == (r["want"] + 180) % 360
    one = spark.createDataFrame([(359.9,), (0.0,), (0.1,), (5.25,)], "b double")
    assert [r[0] for r in one.select(E.bin_index("b")).collect()] == [0, 0, 0, 1]
    assert one.select(E.bin_index("b", offset=0.5)).collect()[3][0] == 0


def pts(*p):
    return np.array(p, float)


@pytest.mark.parametrize(
    "a, b, n",
    [
        (pts((0, 0), (1, 1), (2, 2)), pts((0, 2), (1, 1), (2, 0)), 1),
        (pts((0, 0), (1, 1), (2, 0)), pts((2, 0), (3, 1), (4, 0)), 1),
        (pts((0, 0), (1, 0), (2, 0)), pts((1, 0), (1, 1), (1, 2)), 1),
        (pts((0, 0), (1, 0), (2, 0)), pts((0, 1), (1, 1), (2, 1)), 0),
        (pts((-1, 1), (0, -1), (1, 1)), pts((-1, 0), (0, 0), (1, 0)), 1),
        (pts((-1, 0), (0, 2), (1, 0)), pts((-1, 0.5), (0, 0.5), (1, 0.5)), 2),
        (pts((0, 0), (1, 0), (0, 0)), pts((0.25, -1), (0.25, 0), (0.25, 1)), 2),
    ],
)
def test_roots(a, b, n):
    found = intersect.roots(a, b, 1e-9)
    assert len(found) == n
    assert all(r["residual"] <= 1e-9 for r in found)


def test_overlaps():
    a = pts((0, 0), (1, 0), (2, 0))
    assert intersect.overlap_kind(a, a) == "identical"
    assert intersect.overlap_kind(a, a[::-1]) == "reversed"
    assert intersect.overlap_kind(a, pts((1, 0), (2, 0), (3, 0))) == "collinear"
    assert intersect.overlap_kind(a, pts((2, 0), (3, 0), (4, 0))) is None


def test_reconcile():
    r = {"t_a": 0.5, "t_b": 0.5, "x": 0.0, "y": 0.0}
    pairs, alone = intersect.reconcile([r], [r | {"t_a": 0.50001}, r | {"t_a": 0.9, "x": 1.0}])
    assert len(pairs) == 1 and len(alone) == 1


def test_nearest(spark):
    rows = [(1, -1.0, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0, 3.0)]
    got = intersect.nearest(spark.createDataFrame(rows, ["segment_id", *geometry.CONTROL, "px", "py"]), ["segment_id"]).collect()[0]
    assert math.isclose(got["t"], 0.5, abs_tol=1e-9) and math.isclose(got["distance"], 2.0, rel_tol=1e-12)


def test_polylines_are_the_samples_in_one_row(curves):
    got = {r["segment_id"]: [(p["pos"], p["x"], p["y"]) for p in r["geometry"]] for r in geometry.adaptive_polylines(curves, 0.01).collect()}
    for k in CURVES:
        rows = geometry.adaptive_samples(curves.where(F.col("segment_id") == k), 0.01).orderBy("pos").collect()
        assert got[k] == [(r["pos"], r["x"], r["y"]) for r in rows]


def test_pieces_of_few_curves_are_dealt_to_all_tasks(spark, monkeypatch):
    from streetspark.operators import graph, topology

    parts = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: (parts.append(df.rdd.getNumPartitions()), stored(df))[1])
    rows = [(0, i, 0.0, float(i), 50.0, float(i), 99.0, float(i)) for i in range(20)]
    lines = spark.createDataFrame(rows, ["env", *NAMES])
    cuts = lines.select("env", "segment_id", F.explode(F.array(F.lit(0.25), F.lit(0.5))).alias("t"))
    assert topology.fragments(lines, cuts, 0.01, ["env"]).count() == 60
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
