"""The engine's queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import audit, geometry, graph, morphology, spatial
from . import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict = {}
CROSS = "((x2 - x0) * (y1 - y0) - (y2 - y0) * (x1 - x0))"
BEZIER = "(1 - t) * (1 - t) * {c}0 + 2 * (1 - t) * t * {c}1 + t * t * {c}2"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r9(x, name: str | None = None, digits: int = 9):
    """Rounded, without a negative zero."""
    c = F.round(E.col(x), digits) + F.lit(0.0)
    return c.alias(name or x)


def s9(x: str, name: str, digits: int = 9) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def _wrap(x: str, period: str = "360.0") -> str:
    return f"({x} - {period} * floor({x} / {period}))"


# curves


@query(f"WITH {A.SEG}, p AS (SELECT *, unnest([0.25, 0.5, 0.9])::DOUBLE AS t FROM seg) SELECT segment_id, t, {s9(BEZIER.format(c='x'), 'x')}, {s9(BEZIER.format(c='y'), 'y')} FROM p")
def bezier_point(spark, d):
    p = A.seg(spark, d).withColumn("t", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.9)))))
    return p.select("segment_id", "t", r9(E.point("x0", "x1", "x2", "t"), "x"), r9(E.point("y0", "y1", "y2", "t"), "y"))


@query(f"WITH {A.SEG}, p AS (SELECT *, unnest([0.0, 0.5, 1.0])::DOUBLE AS t FROM seg) SELECT segment_id, t, {s9('2 * ((1 - t) * (x1 - x0) + t * (x2 - x1))', 'dx')}, {s9('2 * ((1 - t) * (y1 - y0) + t * (y2 - y1))', 'dy')} FROM p")
def bezier_derivative(spark, d):
    p = A.seg(spark, d).withColumn("t", F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0)))))
    return p.select("segment_id", "t", r9(E.derivative("x0", "x1", "x2", "t"), "dx"), r9(E.derivative("y0", "y1", "y2", "t"), "dy"))


def _split_sql(t: str) -> str:
    parts = []
    for side in ("left", "right"):
        cols = []
        for c in "xy":
            a, b = f"({c}0 + {t} * ({c}1 - {c}0))", f"({c}1 + {t} * ({c}2 - {c}1))"
            m = f"({a} + {t} * ({b} - {a}))"
            cols += [s9(v, f"{c}{i}") for i, v in enumerate((f"{c}0", a, m) if side == "left" else (m, b, f"{c}2"))]
        lo, hi = ("0.0::DOUBLE", f"{t}::DOUBLE") if side == "left" else (f"{t}::DOUBLE", "1.0::DOUBLE")
        parts.append(f"SELECT segment_id, '{side}' AS side, {lo} AS t_start, {hi} AS t_end, {', '.join(cols)} FROM seg")
    return f"WITH {A.SEG} " + " UNION ALL ".join(parts)


def _split(spark, d, t: float):
    s = geometry.split_at(A.seg(spark, d), F.lit(t))
    return s.select("segment_id", "side", "t_start", "t_end", *[r9(c) for c in geometry.CONTROL])


@query(_split_sql("0.5"))
def bezier_subdivide(spark, d):
    return _split(spark, d, 0.5)


@query(_split_sql("0.3"))
def bezier_split_at(spark, d):
    return _split(spark, d, 0.3)


@query(f"WITH {A.SEG}, p AS (SELECT *, unnest(range(101)) AS i FROM seg), q AS (SELECT *, i / 100.0::DOUBLE AS t FROM p) SELECT segment_id, i::INT AS i, t, {s9(BEZIER.format(c='x'), 'x')}, {s9(BEZIER.format(c='y'), 'y')} FROM q")
def fixed_samples(spark, d):
    return geometry.fixed_samples(A.seg(spark, d)).select("segment_id", "i", "t", r9("x"), r9("y"))


BOUNDS = A.SEG + ", tt AS (SELECT *, " + ", ".join(f"CASE WHEN {c}0 - 2 * {c}1 + {c}2 <> 0 THEN ({c}0 - {c}1) / ({c}0 - 2 * {c}1 + {c}2) END AS t{c}" for c in "xy") + " FROM seg), ex AS (SELECT *, " + ", ".join(f"CASE WHEN t{c} > 0 AND t{c} < 1 THEN (1 - t{c}) * (1 - t{c}) * {c}0 + 2 * (1 - t{c}) * t{c} * {c}1 + t{c} * t{c} * {c}2 END AS e{c}" for c in "xy") + " FROM tt), bb AS (SELECT *, " + ", ".join(f"least({c}0, {c}2, coalesce(e{c}, {c}0)) AS min_{c}, greatest({c}0, {c}2, coalesce(e{c}, {c}0)) AS max_{c}" for c in "xy") + " FROM ex)"


@query(f"WITH {BOUNDS} SELECT segment_id, " + ", ".join(s9(c, c) for c in ("min_x", "max_x", "min_y", "max_y")) + " FROM bb")
def analytic_bounds(spark, d):
    return geometry.with_bounds(A.seg(spark, d)).select("segment_id", *[r9(c) for c in ("min_x", "max_x", "min_y", "max_y")])


_DIAG = "sqrt((max(greatest(x0, x1, x2)) - min(least(x0, x1, x2))) * (max(greatest(x0, x1, x2)) - min(least(x0, x1, x2))) + (max(greatest(y0, y1, y2)) - min(least(y0, y1, y2))) * (max(greatest(y0, y1, y2)) - min(least(y0, y1, y2))))"


@query(f"WITH {A.SEG}, g AS (SELECT shape_id, {_DIAG} AS diagonal FROM seg GROUP BY 1) SELECT shape_id, {s9('diagonal', 'diagonal')}, {s9('max(diagonal) OVER ()', 'scale')} FROM g")
def reference_scale(spark, d):
    span = [F.max(F.greatest(*[f"{c}{i}" for i in range(3)])) - F.min(F.least(*[f"{c}{i}" for i in range(3)])) for c in "xy"]
    g = A.seg(spark, d).groupBy("shape_id").agg(E.norm(*span).alias("diagonal"))
    top = g.agg(F.max("diagonal").alias("scale"))
    return g.join(F.broadcast(top), F.lit(True)).select("shape_id", r9("diagonal"), r9("scale"))  # one row


@query(f"""WITH {A.SEG}, k AS (SELECT *, CASE WHEN x0 = x2 AND y0 = y2 THEN 'zero_chord' WHEN {CROSS} = 0 THEN 'exactly_collinear'
 WHEN abs({CROSS}) / ((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0)) <= 0.000001 THEN 'near_collinear' ELSE 'deviating' END AS class,
 CASE WHEN x0 <> x2 OR y0 <> y2 THEN abs({CROSS}) / ((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0)) END AS ratio FROM seg)
SELECT shape_id, class, count(*) AS n, {s9('min(ratio)', 'least', 6)}, {s9('max(ratio)', 'most', 6)} FROM k GROUP BY 1, 2""")
def control_point_classes(spark, d):
    x = A.seg(spark, d).select("shape_id", geometry.control_class().alias("class"), geometry.deviation_ratio().alias("ratio"))
    return x.groupBy("shape_id", "class").agg(F.count(F.lit(1)).alias("n"), r9(F.min("ratio"), "least", 6), r9(F.max("ratio"), "most", 6))


@query(f"WITH {BOUNDS} SELECT a.shape_id, a.segment_id AS a, b.segment_id AS b FROM bb a JOIN bb b ON a.shape_id = b.shape_id AND a.segment_id < b.segment_id AND a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y")
def bbox_pairs(spark, d):
    return spatial.bbox_pairs(geometry.with_bounds(A.seg(spark, d)), ["shape_id"], "segment_id")


ADAPT = f"""WITH RECURSIVE {A.SEG}, ad AS (
 SELECT segment_id, 0::DOUBLE AS a, 1::DOUBLE AS b, 0 AS lvl, x0, y0, x1, y1, x2, y2, false AS leaf FROM seg
 UNION ALL
 SELECT segment_id, CASE WHEN k = 0 THEN a ELSE (a + b) / 2 END, CASE WHEN k = 0 THEN (a + b) / 2 ELSE b END, lvl + 1, x0, y0, x1, y1, x2, y2, leaf
 FROM (SELECT * FROM (SELECT segment_id, a, b, lvl, x0, y0, x1, y1, x2, y2, FLAT AS leaf FROM ad) WHERE NOT leaf AND lvl < 40) q, (VALUES (0), (1)) v(k)),
lv AS (SELECT *, FLAT AS flat FROM (SELECT segment_id, a, b, lvl, x0, y0, x1, y1, x2, y2 FROM ad)),
ts AS (SELECT segment_id, b AS t FROM lv WHERE flat UNION ALL SELECT segment_id, 0 FROM seg)"""
_AX, _BX, _AY, _BY = (f"((1 - {t}) * (1 - {t}) * {c}0 + 2 * (1 - {t}) * {t} * {c}1 + {t} * {t} * {c}2)" for c, t in (("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")))
_H = [f"((b - a) * ((1 - a) * ({c}1 - {c}0) + a * ({c}2 - {c}1)))" for c in "xy"]
_C = [f"({_BX} - {_AX})", f"({_BY} - {_AY})"]
FLAT = f"CASE WHEN {_C[0]} = 0 AND {_C[1]} = 0 THEN {_H[0]} = 0 AND {_H[1]} = 0 ELSE abs({_C[0]} * {_H[1]} - {_C[1]} * {_H[0]}) / sqrt({_C[0]} * {_C[0]} + {_C[1]} * {_C[1]}) / 2 <= TOL END"
TOL = 1e-3


def _adaptive_sql(tol: str) -> str:
    return ADAPT.replace("FLAT", FLAT.replace("TOL", tol))


@query(_adaptive_sql("0.001") + f" SELECT segment_id, t, {s9(BEZIER.format(c='x'), 'x')}, {s9(BEZIER.format(c='y'), 'y')} FROM ts JOIN seg USING (segment_id)")
def adaptive_samples(spark, d):
    return geometry.adaptive_samples(A.seg(spark, d), TOL).select("segment_id", "t", r9("x"), r9("y"))


# polylines and orientation

PIECES = A.TRAJ + """, pc AS (SELECT user_id, pos, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
pl AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM pc WHERE dx IS NOT NULL)"""


@query(f"WITH {PIECES} SELECT user_id, {s9('sum(len)', 'length', 5)}, count(*) AS n_pieces FROM pl GROUP BY 1")
def polyline_length(spark, d):
    return geometry.polyline_lengths(A.traj(spark, d), ["user_id"], "pos").select("user_id", r9("length", digits=5), "n_pieces")


_B = "degrees(atan2(dx, dy))"
OBS = PIECES + f""", ob0 AS (SELECT user_id, pos, len, {_wrap(_B)} AS b FROM pl WHERE dx <> 0 OR dy <> 0),
ob AS (SELECT user_id, pos, len, b AS bearing FROM ob0 UNION ALL SELECT user_id, pos, len, {_wrap('(b + 180.0)')} FROM ob0)"""


def _observations(spark, d):
    p = geometry.pieces(A.traj(spark, d), ["user_id"], "pos").withColumn("bearing", E.bearing("dx", "dy")).where("bearing IS NOT NULL")
    return morphology.both_ways(p.select("user_id", "pos", "length", "bearing"))


@query(f"WITH {OBS} SELECT user_id, pos, {s9('bearing', 'bearing', 7)}, {s9('len', 'weight', 7)} FROM ob")
def piece_observations(spark, d):
    return _observations(spark, d).select("user_id", "pos", r9("bearing", digits=7), r9("length", "weight", 7))


CHORD = A.SEG + f""", cb0 AS (SELECT shape_id, segment_id, {_wrap('degrees(atan2(x2 - x0, y2 - y0))')} AS b FROM seg WHERE x0 <> x2 OR y0 <> y2),
cb AS (SELECT shape_id, segment_id, b AS bearing FROM cb0 UNION ALL SELECT shape_id, segment_id, {_wrap('(b + 180.0)')} FROM cb0)"""


def _chords(spark, d):
    c = A.seg(spark, d).withColumn("bearing", E.bearing(F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0"))).where("bearing IS NOT NULL")
    return morphology.both_ways(c.select("shape_id", "segment_id", "bearing"))


@query(f"WITH {CHORD} SELECT shape_id, segment_id, {s9('bearing', 'bearing', 7)} FROM cb")
def chord_bearings(spark, d):
    return _chords(spark, d).select("shape_id", "segment_id", r9("bearing", digits=7))


def _hist(source: str, key: str, weight: str, offset: str = "0.0") -> str:
    """CTEs h0 (sums) and h (key, bin, total, p)."""
    off = f"({offset} - 10.0 * floor({offset} / 10.0))"
    b = f"(bearing - {off} + 5.0)"
    return f"""h0 AS (SELECT {key}, (floor({_wrap(b)} / 10.0)::INT % 36) AS bin, sum({weight}) AS total FROM {source} GROUP BY ALL),
h1 AS (SELECT k.*, unnest(range(36))::INT AS bin FROM (SELECT DISTINCT {key} FROM {source}) k),
h AS (SELECT h1.*, coalesce(h0.total, 0)::DOUBLE AS total, coalesce(h0.total, 0)::DOUBLE / sum(coalesce(h0.total, 0)) OVER (PARTITION BY {', '.join('h1.' + k.strip() for k in key.split(','))}) AS p
 FROM h1 LEFT JOIN h0 USING ({key}, bin))"""


@query(f"WITH {CHORD}, {_hist('cb', 'shape_id', '1')} SELECT shape_id, bin, {s9('total', 'total')}, {s9('p', 'probability')}, (bin * 10.0)::DOUBLE AS centre FROM h")
def orientation_histogram(spark, d):
    return morphology.orientation_histogram(_chords(spark, d), ["shape_id"]).select("shape_id", "bin", r9("total"), r9("probability"), "centre")


ENT = "-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)"


@query(f"WITH {CHORD}, {_hist('cb', 'shape_id', '1')} SELECT shape_id, {s9(ENT, 'entropy')} FROM h GROUP BY 1")
def orientation_entropy(spark, d):
    return morphology.orientation_entropy(_chords(spark, d), ["shape_id"]).select("shape_id", r9("entropy"))


@query(f"WITH {OBS}, {_hist('ob', 'user_id', 'len')} SELECT user_id, {s9(ENT, 'entropy', 7)} FROM h GROUP BY 1")
def weighted_entropy(spark, d):
    return morphology.orientation_entropy(_observations(spark, d), ["user_id"], F.col("length")).select("user_id", r9("entropy", digits=7))


_ORD = f"1 - (({ENT} - ln(4)) / (ln(36) - ln(4))) * (({ENT} - ln(4)) / (ln(36) - ln(4)))"


@query(f"WITH {CHORD}, {_hist('cb', 'shape_id', '1')} SELECT shape_id, {s9(ENT, 'entropy')}, {s9(_ORD, 'phi')} FROM h GROUP BY 1")
def orientation_order(spark, d):
    h = morphology.orientation_entropy(_chords(spark, d), ["shape_id"])
    return h.select("shape_id", r9("entropy"), r9(morphology.orientation_order(F.col("entropy")), "phi"))


@query(f"WITH {CHORD}, co AS (SELECT cb.*, o * 0.5::DOUBLE AS off FROM cb, range(20) r(o)), {_hist('co', 'shape_id, off', '1', 'off')} SELECT shape_id, off, {s9(ENT, 'entropy')} FROM h GROUP BY 1, 2")
def bin_offset_sensitivity(spark, d):
    c = _chords(spark, d).withColumn("off", F.explode(F.array(*[F.lit(i * 0.5) for i in range(20)])))
    return morphology.orientation_entropy(c, ["shape_id", "off"], offset=F.col("off")).select("shape_id", "off", r9("entropy"))


# circuity


@query(f"WITH {A.EDGE} SELECT env, edge_id, {s9('length / distance', 'circuity')} FROM edge")
def edge_circuity(spark, d):
    return A.edge(spark, d).select("env", "edge_id", r9(morphology.edge_circuity(F.col("length"), F.col("distance")), "circuity"))


@query(f"WITH {A.EDGE} SELECT env, count(*) AS n, {s9('sum(length) / sum(distance)', 'circuity')} FROM edge GROUP BY 1")
def aggregate_circuity(spark, d):
    return A.edge(spark, d).groupBy("env").agg(F.count(F.lit(1)).alias("n"), r9(F.sum("length") / F.sum("distance"), "circuity"))


DECOMP = A.EDGE + """, dt AS (SELECT env, sum(length - distance) AS e, sum(distance) AS dd FROM edge GROUP BY 1),
dc AS (SELECT edge.*, length - distance AS excess, (length - distance) / e AS share, distance / dd AS weight, (length - distance) / dd AS contribution FROM edge JOIN dt USING (env))"""


@query(f"WITH {DECOMP} SELECT env, edge_id, {s9('excess', 'excess', 4)}, {s9('share', 'excess_share', 12)}, {s9('weight', 'distance_weight', 12)}, {s9('contribution', 'contribution', 12)} FROM dc")
def circuity_decomposition(spark, d):
    x = audit.decompose(A.edge(spark, d), ["env"])
    return x.select("env", "edge_id", r9("excess", digits=4), *[r9(c, digits=12) for c in ("excess_share", "distance_weight", "contribution")])


@query(f"WITH {DECOMP}, k AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY round(excess, 6) DESC, edge_id) AS r FROM dc) SELECT env, edge_id, r::INT AS rank, {s9('excess', 'excess', 4)} FROM k WHERE r <= 10")
def top_contributors(spark, d):
    x = audit.decompose(A.edge(spark, d), ["env"]).withColumn("by", F.round("excess", 6))
    return audit.top(x, ["env"], "by", "edge_id", 10).select("env", "edge_id", "rank", r9("excess", digits=4))


@query(f"WITH {DECOMP}, k AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY share DESC, edge_id) AS r FROM dc) SELECT env, " + ", ".join(s9(f"sum(CASE WHEN r <= {k} THEN share END)", f"top_{k}", 10) for k in (2, 5, 10)) + " FROM k GROUP BY 1")
def topk_share(spark, d):
    x = audit.top_shares(audit.decompose(A.edge(spark, d), ["env"]), ["env"], "excess_share", "edge_id")
    return x.select("env", *[r9(f"top_{k}", digits=10) for k in (2, 5, 10)])


_QS = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95}


@query(f"WITH {A.EDGE}, c AS (SELECT env, length / distance AS c FROM edge) SELECT env, count(*) AS n, {s9('sum(c)', 'total', 6)}, {s9('avg(c)', 'mean')}, {s9('min(c)', 'least')}, {s9('max(c)', 'most')}, {s9('stddev_pop(c)', 'std')}, " + ", ".join(s9(f"quantile_cont(c, {q})", n) for n, q in _QS.items()) + " FROM c GROUP BY 1")
def circuity_descriptive(spark, d):
    c = A.edge(spark, d).withColumn("c", F.col("length") / F.col("distance"))
    x = morphology.descriptive(c, ["env"], "c")
    return x.select("env", "n", r9("total", digits=6), *[r9(k) for k in ("mean", "least", "most", "std", *_QS)])


_TESTS = {"near_one": "abs(c - 1) <= 0.000001"} | {f"over_{str(t).replace('.', '_')}": f"c > {t}" for t in (1.01, 1.05, 1.1, 1.2)}


@query(f"WITH {A.EDGE}, c AS (SELECT env, length / distance AS c FROM edge) SELECT env, count(*) AS n, " + ", ".join(f"count(*) FILTER ({t}) AS {n}, {s9(f'count(*) FILTER ({t}) / count(*)::DOUBLE', n + '_share')}" for n, t in _TESTS.items()) + " FROM c GROUP BY 1")
def circuity_distribution(spark, d):
    c = A.edge(spark, d).withColumn("c", F.col("length") / F.col("distance"))
    x = morphology.distribution(c, ["env"], "c")
    return x.select("env", "n", *[y for n in _TESTS for y in (n, r9(f"{n}_share"))])


def _avg_rank(v: str) -> str:
    return f"rank() OVER (PARTITION BY env ORDER BY {v}) + (count(*) OVER (PARTITION BY env, {v}) - 1) / 2.0::DOUBLE"


@query(f"WITH {A.EDGE}, r AS (SELECT env, {_avg_rank('distance')} AS a, {_avg_rank('length / distance')} AS b FROM edge) SELECT env, {s9('corr(a, b)', 'spearman', 8)} FROM r GROUP BY 1")
def spearman(spark, d):
    c = A.edge(spark, d).withColumn("c", F.col("length") / F.col("distance"))
    return audit.spearman(c, ["env"], "distance", "c").select("env", r9("spearman", digits=8))


_M = A.EDGE + ", m AS (SELECT env, count(*)::DOUBLE AS n, sum(length) / sum(distance) AS circuity, avg(length) AS mean_length, avg(length / distance) AS phi FROM edge GROUP BY 1), u AS (UNPIVOT m ON n, circuity, mean_length, phi INTO NAME metric VALUE value)"


def _metrics(spark, d):
    return A.edge(spark, d).groupBy("env").agg(
        F.count(F.lit(1)).cast("double").alias("n"), (F.sum("length") / F.sum("distance")).alias("circuity"), F.avg("length").alias("mean_length"), F.avg(F.col("length") / F.col("distance")).alias("phi")
    )


@query(f"WITH {_M}, j AS (SELECT a.metric, a.value AS base, b.value AS other FROM u a JOIN u b USING (metric) WHERE a.env = '1-URGENT' AND b.env = '5-LOW') SELECT metric, {s9('base', 'base', 6)}, {s9('other', 'other', 6)}, {s9('other - base', 'difference', 6)}, CASE WHEN base <> 0 AND metric <> 'phi' THEN round((other - base) / base, 9) + 0.0 END AS relative FROM j")
def metric_comparison(spark, d):
    x = audit.compare(_metrics(spark, d), "env", "1-URGENT", "5-LOW", ["n", "circuity", "mean_length", "phi"])
    return x.select("metric", *[r9(c, digits=6) for c in ("base", "other", "difference")], r9("relative"))


@query(f"WITH {_M}, j AS (SELECT a.metric, a.value AS x, b.value AS y FROM u a JOIN u b USING (metric) WHERE a.env = '1-URGENT' AND b.env = '5-LOW') SELECT metric, CASE WHEN abs(x - y) <= 1e-12 THEN 'equal' WHEN x > y THEN 'supported' ELSE 'not_supported' END AS outcome FROM j")
def hypothesis_assessment(spark, d):
    x = audit.compare(_metrics(spark, d), "env", "1-URGENT", "5-LOW", ["n", "circuity", "mean_length", "phi"])
    return x.select("metric", audit.assessment(F.col("base"), F.col("other")).alias("outcome"))


# graphs


@query(f"WITH {A.GTREE} SELECT env, degree, count(*) AS n_nodes FROM deg GROUP BY 1, 2")
def degree_distribution(spark, d):
    return graph.degree_distribution(A.gtree(spark, d), ["env"])


_SHARES = {"dead_ends": "degree = 1", "two_way": "degree = 2", "three_way": "degree = 3", "four_way": "degree = 4", "five_or_more": "degree >= 5"}


@query(f"WITH {A.GTREE} SELECT env, count(*) AS n_nodes, {s9('avg(degree)', 'mean_degree')}, max(degree) AS max_degree, " + ", ".join(f"count(*) FILTER ({t}) AS {n}, {s9(f'count(*) FILTER ({t}) / count(*)::DOUBLE', n + '_share')}" for n, t in _SHARES.items()) + ", " + ", ".join(s9(f"count(*) FILTER ({_SHARES[n]}) / (count(*) FILTER (degree >= 3))::DOUBLE", n + "_of_crossings") for n in ("three_way", "four_way", "five_or_more")) + " FROM deg GROUP BY 1")
def topology_summary(spark, d):
    x = graph.topology_summary(A.gtree(spark, d), ["env"])
    shares = [c for c in x.columns if c.endswith(("_share", "_of_crossings"))]
    return x.select("env", "n_nodes", r9("mean_degree"), "max_degree", *_SHARES, *[r9(c) for c in shares])


@query("WITH g AS (SELECT 1 AS env, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem) SELECT env, a, b, count(*) AS n_edges FROM g GROUP BY ALL HAVING count(*) > 1")
def parallel_edges(spark, d):
    e = A.table(spark, d, "lineitem").select(F.lit(1).alias("env"), F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))
    return graph.parallel_edges(e, ["env"])


@query(f"WITH {A.GTREE}, ends2 AS (SELECT env, u AS node FROM gt WHERE edge_id NOT LIKE 'supplier:%' UNION ALL SELECT env, v FROM gt WHERE edge_id NOT LIKE 'supplier:%'), deg2 AS (SELECT env, node, count(*) AS degree FROM ends2 GROUP BY ALL) SELECT a.env, a.node, a.degree AS degree_before, coalesce(b.degree, 0) AS degree_after FROM deg a LEFT JOIN deg2 b USING (env, node) WHERE a.degree <> coalesce(b.degree, 0)")
def incident_changes(spark, d):
    g = A.gtree(spark, d)
    return graph.incident_changes(g, graph.exclude_edges(g, g.where("edge_id LIKE 'supplier:%'").select("env", "edge_id"), ["env"]), ["env"])


@query(f"WITH {A.GTREE} SELECT env, edge_id, u, v FROM gt WHERE edge_id NOT IN (SELECT 'orders:' || o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def anomaly_exclusion(spark, d):
    bad = A.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.lit(1).alias("env"), F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("edge_id"))
    return graph.exclude_edges(A.gtree(spark, d), bad, ["env"])


@query(f"WITH {A.GCONV} SELECT env, node_id AS node, min(node_id) OVER (PARTITION BY conv_id) AS component FROM cn")
def connected_components(spark, d):
    nodes, edges = A.gconv(spark, d)
    return graph.components(edges, ["env"], nodes)


KEEP = A.GCONV + ", cm AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1), kept AS (SELECT cn.* FROM cn JOIN cm USING (conv_id) WHERE turn = lo OR turn = hi OR turn % 4 = 0)"


def _kept(spark, d):
    nodes, edges = A.gconv(spark, d)
    return graph.retention_nodes(edges, ["env"], nodes, F.col("turn") % 4 == 0), nodes, edges


@query(f"WITH {KEEP} SELECT env, node_id AS node FROM kept")
def retention_nodes(spark, d):
    return _kept(spark, d)[0]


@query(f"""WITH {KEEP}, nx AS (SELECT env, conv_id, node_id AS u, lead(node_id) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM kept)
SELECT nx.env, nx.u, nx.v, count(*) AS n_edges, {s9('sum(ce.length)', 'length')}, string_agg(ce.edge_id::VARCHAR, ',' ORDER BY ce.edge_id) AS edge_ids FROM nx JOIN ce ON ce.v > nx.u AND ce.v <= nx.v AND ce.v // 1000000 = nx.conv_id GROUP BY 1, 2, 3""")
def chain_contraction(spark, d):
    kept, nodes, edges = _kept(spark, d)
    c = graph.contract_chains(edges, ["env"], kept)
    return c.select("env", "u", "v", "n_edges", r9("length"), F.array_join(F.transform("edge_ids", lambda x: x.cast("string")), ",").alias("edge_ids"))


@query(f"WITH {A.GCONV} SELECT env, edge_id, u, v, length, 'forward' AS direction FROM ce UNION ALL SELECT env, edge_id, v, u, length, 'reverse' FROM ce")
def bidirectional_edges(spark, d):
    return graph.bidirectional(A.gconv(spark, d)[1])


@query(f"WITH {A.GTREE} SELECT 1 AS env, (SELECT count(*) FROM deg) AS n_nodes, (SELECT count(*) FROM gt) AS n_edges, (SELECT count(*) FROM region WHERE 'r' || r_regionkey IN (SELECT node FROM deg)) AS n_components, 0::BIGINT AS n_loops, 0::BIGINT AS n_parallel")
def graph_summary(spark, d):
    return graph.graph_summary(A.gtree(spark, d), ["env"])
