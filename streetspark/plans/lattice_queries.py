"""Queries on lattices of lines and parabolas, whose crossings have a closed form, and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, graph, intersect, morphology, topology
from . import adapters as A
from . import jobs
from .queries import DECOMP, _avg_rank, query, r9, s9

#: Length of every line; parameters of crossings are exact fractions of it.
SPAN = 16384
LAT = f"""la AS (SELECT s_nationkey % 10 AS env, s_suppkey + 1 AS k, s_suppkey % 2 = 1 AS across FROM supplier),
cr AS (SELECT h.env, h.k AS h, v.k AS v, h.k / {SPAN}.0::DOUBLE AS tv, v.k + 2 * @BEND * (h.k / {SPAN}.0::DOUBLE) * (1 - h.k / {SPAN}.0::DOUBLE) AS x FROM la h JOIN la v ON h.env = v.env AND h.across AND NOT v.across),
ro AS (SELECT env, least(h, v) AS a, greatest(h, v) AS b, CASE WHEN h < v THEN x / {SPAN} ELSE tv END AS t_a, CASE WHEN h < v THEN tv ELSE x / {SPAN} END AS t_b, x, h::DOUBLE AS y FROM cr)"""
BENT, STRAIGHT = LAT.replace("@BEND", "0.5::DOUBLE"), LAT.replace("@BEND", "0::DOUBLE")


def lattice(spark, d, bulge: float):
    """Suppliers as curves, numbered from 1: even ones lie across at y = number, the others go up from x = number, bent by ``bulge``."""
    k, span = (F.col("s_suppkey") + 1).cast("double"), F.lit(float(SPAN))
    across = F.col("s_suppkey") % 2 == 1
    pick = lambda a, b, n: F.when(across, a).otherwise(b).alias(n)
    zero = F.lit(0.0)
    return A.table(spark, d, "supplier").select(
        (F.col("s_nationkey") % 10).cast("long").alias("env"), (F.col("s_suppkey") + 1).cast("long").alias("segment_id"),
        pick(zero, k, "x0"), pick(k, zero, "y0"), pick(span / 2, k + bulge, "x1"), pick(k, span / 2, "y1"), pick(span, k, "x2"), pick(k, span, "y2"),
    )


def crossings(spark, d, bulge: float):
    return intersect.curve_intersections(lattice(spark, d, bulge), ["env"], 1e-9).where("kind = 'interior_crossing'")


@query(f"WITH {BENT} SELECT env::BIGINT AS env, a, b, 'interior_crossing' AS kind, {s9('t_a', 't_a', 8)}, {s9('t_b', 't_b', 8)}, {s9('x', 'x', 6)}, {s9('y', 'y', 6)} FROM ro")
def curve_intersections(spark, d):
    x = intersect.curve_intersections(lattice(spark, d, 0.5), ["env"], 1e-9)
    return x.select("env", "a", "b", "kind", r9("t_a", digits=8), r9("t_b", digits=8), r9("x", digits=6), r9("y", digits=6))


@query(f"WITH {BENT} SELECT env::BIGINT AS env, a, b, 'matched' AS status, 'interior_crossing' AS kind, {s9('t_a', 't_a', 8)}, {s9('t_b', 't_b', 8)} FROM ro")
def reconciled_intersections(spark, d):
    """Crossings that two independent methods find."""
    x = intersect.reconciled(lattice(spark, d, 0.5), ["env"], 1e-9)
    return x.select("env", "a", "b", "status", "kind", r9("t_a", digits=8), r9("t_b", digits=8))


@query(f"""WITH {BENT}, n AS (SELECT env, count(*) AS n_curves FROM la GROUP BY 1), c AS (SELECT env, count(*) AS k FROM cr GROUP BY 1)
SELECT env::BIGINT AS env, n_curves, n_curves * (n_curves - 1) // 2 AS n_pairs, coalesce(k, 0) AS n_candidates, coalesce(k, 0) AS n_matched, 0::BIGINT AS n_overlap, coalesce(k, 0) AS kind_interior_crossing, 0::BIGINT AS kind_unresolved FROM n LEFT JOIN c USING (env)""")
def intersection_diagnostics(spark, d):
    c = lattice(spark, d, 0.5)
    x = intersect.diagnostics(c, intersect.reconciled(c, ["env"], 1e-9), ["env"])
    return x.select("env", "n_curves", "n_pairs", "n_candidates", "n_matched", "n_overlap", "kind_interior_crossing", "kind_unresolved")


@query(f"WITH {STRAIGHT} SELECT env::BIGINT AS env, a, b, 'event_' || lpad((row_number() OVER (PARTITION BY env ORDER BY a, b))::VARCHAR, 4, '0') AS event_id, 'requires_3d_review' AS review FROM ro")
def intersection_events(spark, d):
    return intersect.events(intersect.curve_intersections(lattice(spark, d, 0.0), ["env"], 1e-9), ["env"]).select("env", "a", "b", "event_id", "review")


@query(f"""WITH {STRAIGHT}, h AS (SELECT env, k FROM la WHERE across), p AS (SELECT * FROM (VALUES (0, 1000000, 'reversed'), (0, 2000000, 'identical'), (0, 3000000, 'collinear'), (1000000, 2000000, 'reversed'), (1000000, 3000000, 'collinear'), (2000000, 3000000, 'collinear')) v(i, j, overlap))
SELECT env::BIGINT AS env, k + i AS a, k + j AS b, overlap FROM h, p""")
def overlap_evidence(spark, d):
    """Lines across with reversed, repeated and shorter ones: proven overlaps."""
    s = lattice(spark, d, 0.0).where("segment_id % 2 = 0")
    moved = lambda n, *c: s.select("env", (F.col("segment_id") + n).alias("segment_id"), *[(F.col(v) if isinstance(v, str) else v).alias(k) for v, k in zip(c, geometry.CONTROL, strict=True)])
    back = moved(1_000_000, "x2", "y2", "x1", "y1", "x0", "y0")
    part = moved(3_000_000, F.col("x0") + SPAN / 4, "y0", F.col("x0") + SPAN / 2, "y1", F.col("x0") + SPAN * 3 / 4, "y2")
    return intersect.overlaps(s.union(back).union(moved(2_000_000, *geometry.CONTROL)).union(part), ["env"])


@query(f"""WITH {STRAIGHT}, li AS (SELECT env, k, across FROM la UNION ALL SELECT env, k + 1000000, across FROM la WHERE across),
pt AS (SELECT env, h.k AS h, v.k AS v, h.k % 1000000 AS y, v.k AS x FROM li h JOIN li v USING (env) WHERE h.across AND NOT v.across)
SELECT env::BIGINT AS env, least(h, v) AS a, greatest(h, v) AS b, 'point' AS kind, x::DOUBLE AS x, y::DOUBLE AS y FROM pt
UNION ALL SELECT env::BIGINT, k, k + 1000000, 'overlap', {SPAN} * q::DOUBLE, k::DOUBLE FROM la, (VALUES (0.25), (0.75)) z(q) WHERE across""")
def polyline_crossings(spark, d):
    """Polylines of two pieces, those across drawn twice."""
    s = lattice(spark, d, 0.0)
    again = s.where("segment_id % 2 = 0").withColumn("segment_id", F.col("segment_id") + 1_000_000)
    lines = geometry.fixed_samples(s.union(again), 3).select("env", "segment_id", F.col("i").alias("pos"), "x", "y")
    return intersect.polyline_crossings(lines, ["env"]).select("env", "a", "b", "kind", r9("x", digits=6), r9("y", digits=6))


MOST = 7.0
ENDS = STRAIGHT + f""", en AS (SELECT env, k, across, k || ':p0' AS id, CASE WHEN across THEN 0 ELSE k END AS x, CASE WHEN across THEN k ELSE 0 END AS y FROM la
 UNION ALL SELECT env, k, across, k || ':p2', CASE WHEN across THEN {SPAN} ELSE k END, CASE WHEN across THEN k ELSE {SPAN} END FROM la),
nm AS (SELECT a.env, 'endpoint_endpoint' AS type, a.id AS source, b.id AS target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)::DOUBLE) AS distance FROM en a JOIN en b ON a.env = b.env AND a.id < b.id
 UNION ALL SELECT e.env, 'endpoint_interior', e.id, l.k::VARCHAR, CASE WHEN l.across THEN abs(e.y - l.k) ELSE abs(e.x - l.k) END::DOUBLE FROM en e JOIN la l ON e.env = l.env AND e.k <> l.k WHERE CASE WHEN l.across THEN e.x > 0 AND e.x < {SPAN} ELSE e.y > 0 AND e.y < {SPAN} END),
nr AS (SELECT * FROM nm WHERE distance > 0 AND distance <= {MOST})"""


@query(f"WITH {ENDS} SELECT env::BIGINT AS env, type, source, target, {s9('distance', 'distance', 8)} FROM nr")
def near_misses(spark, d):
    return topology.near_misses(lattice(spark, d, 0.0), MOST, ["env"]).select("env", "type", "source", "target", r9("distance", digits=8))


@query(f"""WITH {ENDS}, si AS (SELECT env, source AS e, type || '|' || target AS o FROM nr UNION SELECT env, target, type || '|' || source FROM nr WHERE type = 'endpoint_endpoint'),
ma AS (SELECT env, e FROM si GROUP BY 1, 2 HAVING count(DISTINCT o) > 1)
SELECT nr.env::BIGINT AS env, type, source, target, 'candidate_' || lpad((row_number() OVER (PARTITION BY nr.env ORDER BY round(distance, 8), type, source, target))::VARCHAR, 4, '0') AS candidate_id,
 CASE WHEN distance <= 2 THEN 2.0::DOUBLE WHEN distance <= 5 THEN 5.0::DOUBLE END AS first_tolerance, (m1.e IS NOT NULL OR (type = 'endpoint_endpoint' AND m2.e IS NOT NULL)) AS ambiguous
FROM nr LEFT JOIN ma m1 ON m1.env = nr.env AND m1.e = source LEFT JOIN ma m2 ON m2.env = nr.env AND m2.e = target""")
def near_miss_audit(spark, d):
    misses = topology.near_misses(lattice(spark, d, 0.0), MOST, ["env"]).withColumn("distance", r9("distance", digits=8))
    x = topology.audited(misses, ["env"], [2.0, 5.0])
    return x.select("env", "type", "source", "target", "candidate_id", "first_tolerance", "ambiguous")


def _decisions(spark, d):
    return intersect.events(crossings(spark, d, 0.0), ["env"])


@query(f"WITH {STRAIGHT}, s AS (SELECT env, a AS segment_id, t_a AS t, x, y FROM ro UNION ALL SELECT env, b, t_b, x, y FROM ro) SELECT env::BIGINT AS env, segment_id, {s9('t', 't', 8)}, {s9('x', 'x', 6)}, {s9('y', 'y', 6)}, 1::INT AS n_events FROM s")
def split_records(spark, d):
    x = topology.split_records(_decisions(spark, d), ["env"])
    return x.select("env", "segment_id", r9("t", digits=8), r9("x", digits=6), r9("y", digits=6), F.size("ids").alias("n_events"))


def _topology(spark, d):
    c = lattice(spark, d, 0.0)
    splits = topology.split_records(_decisions(spark, d), ["env"]).select("env", "segment_id", "t", "x", "y")
    splits = graph.stored(splits.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6)))
    return c, splits, *topology.topology(c, splits, 0.01, ["env"])


_LOC = STRAIGHT + f""", po AS (SELECT env, CASE WHEN across THEN 0 ELSE k END AS x, CASE WHEN across THEN k ELSE 0 END AS y, 1 AS n, 'authored_exact_endpoint' AS s, 'dead_end_or_self_loop' AS r FROM la
 UNION ALL SELECT env, CASE WHEN across THEN {SPAN} ELSE k END, CASE WHEN across THEN k ELSE {SPAN} END, 1, 'authored_exact_endpoint', 'dead_end_or_self_loop' FROM la
 UNION ALL SELECT env, v, h, 4, 'validated_interior_crossing', 'validated_interior_junction' FROM cr),
lo AS (SELECT *, 'L' || lpad((row_number() OVER (PARTITION BY env ORDER BY x, y))::VARCHAR, 4, '0') AS location_id FROM po)"""


@query(f"WITH {_LOC} SELECT env::BIGINT AS env, location_id, x::DOUBLE AS x, y::DOUBLE AS y, s AS source_type, n::BIGINT AS n_ends, r AS role FROM lo")
def topology_locations(spark, d):
    c, splits, loc, frags = _topology(spark, d)
    x = topology.described(loc, frags, c, splits, ["env"])
    return x.select("env", "location_id", "x", "y", "source_type", "n_ends", "role")


@query(f"""WITH {_LOC}, al AS (SELECT la.env, k AS segment_id, location_id, CASE WHEN across THEN x ELSE y END AS p FROM la JOIN lo ON lo.env = la.env AND CASE WHEN across THEN lo.y = k ELSE lo.x = k END AND (n = 1 OR true)),
st AS (SELECT DISTINCT * FROM al WHERE p BETWEEN 0 AND {SPAN}), fr AS (SELECT env, segment_id, row_number() OVER w - 1 AS piece, location_id AS u, lead(location_id) OVER w AS v, lead(p) OVER w - p AS length FROM st WINDOW w AS (PARTITION BY env, segment_id ORDER BY p))
SELECT env::BIGINT AS env, segment_id, piece::INT AS piece, 'F' || lpad((row_number() OVER (PARTITION BY env ORDER BY segment_id, piece))::VARCHAR, 5, '0') AS fragment_id, u, v, length::DOUBLE AS length FROM fr WHERE v IS NOT NULL""")
def topology_fragments(spark, d):
    """Lines split where they cross, with locations."""
    _, _, _, f = _topology(spark, d)
    return f.select("env", "segment_id", "piece", "fragment_id", "u", "v", r9("length", digits=6))


@query("SELECT 0::BIGINT AS env, 'none' AS reason FROM region WHERE false")
def topology_violations(spark, d):
    """Nothing is wrong with the topology of a lattice."""
    return topology.violations(_topology(spark, d)[3], ["env"]).select("env", "reason")


_SNAP = [0.0, 3.0, 10.0, 50.0]


@query(f"""WITH {STRAIGHT}, h AS (SELECT env, k, row_number() OVER (PARTITION BY env ORDER BY k) AS r, lead(k) OVER (PARTITION BY env ORDER BY k) - k AS gap FROM la WHERE across),
c AS (SELECT env, CASE WHEN r % 2 = 1 THEN 'm' ELSE 's' END AS kind, gap FROM h WHERE gap IS NOT NULL), t AS (SELECT unnest([{', '.join(map(str, _SNAP))}])::DOUBLE AS tolerance),
n AS (SELECT env, count(*) AS n FROM h GROUP BY 1), g AS (SELECT env, tolerance, count(*) FILTER (kind = 'm' AND gap <= tolerance) AS m, count(*) FILTER (kind = 's' AND gap <= tolerance) AS s FROM c, t GROUP BY 1, 2)
SELECT n.env::BIGINT AS env, t.tolerance, coalesce(m + s, 0) AS eligible, 0::BIGINT AS ambiguous, coalesce(m + s, 0) AS applied, 2 * n - coalesce(m, 0) AS locations, n + coalesce(s, 0) AS fragments, n - coalesce(m + s, 0) AS components
FROM n CROSS JOIN t LEFT JOIN g ON g.env = n.env AND g.tolerance = t.tolerance""")
def provisional_topology(spark, d):
    """Lines across in pairs: left ends of a pair may merge, the second one's right end may split the next line."""
    s = lattice(spark, d, 0.0).where("segment_id % 2 = 0").select("env", "segment_id", "y0")
    at = lambda side: F.concat(F.col("segment_id").cast("string"), F.lit(side))
    loc = s.select("env", at(":p0").alias("location_id")).union(s.select("env", at(":p2")))
    frags = s.select("env", F.col("segment_id").cast("string").alias("fragment_id"), at(":p0").alias("u"), at(":p2").alias("v"))
    ranked = topology.numbered(s, ["env"], ["segment_id"], "r", "").withColumn("r", F.col("r").cast("long"))
    after = ranked.select("env", (F.col("r") - 1).alias("r"), F.col("segment_id").alias("n"), F.col("y0").alias("y1"))
    p = ranked.join(after, ["env", "r"]).withColumn("odd", F.col("r") % 2 == 1)
    name = lambda c, side: F.concat(F.col(c).cast("string"), F.lit(side))
    c = p.select(
        "env", F.col("segment_id").alias("candidate_id"), F.when(F.col("odd"), "endpoint_endpoint").otherwise("endpoint_interior").alias("type"),
        F.when(F.col("odd"), name("segment_id", ":p0")).otherwise(name("segment_id", ":p2")).alias("source"), F.when(F.col("odd"), name("n", ":p0")).otherwise(name("n", ":inside")).alias("target"),
        (F.col("y1") - F.col("y0")).alias("distance"), F.when(~F.col("odd"), name("n", ":p0")).alias("first"), F.when(~F.col("odd"), name("n", ":p2")).alias("second"),
    )
    return topology.sensitivity(loc, frags, c, ["env"], _SNAP).drop("largest")


# jobs

_SUM = STRAIGHT + """, n AS (SELECT env, count(*) FILTER (across) AS h, count(*) FILTER (NOT across) AS v FROM la GROUP BY 1)"""


@query(f"""WITH {_SUM}, s AS (SELECT env, 2 * (h + v) + h * v AS n_nodes, h + v + 2 * h * v AS n_edges, CASE WHEN h > 0 AND v > 0 THEN 1 ELSE h + v END AS n_components, (h + v) * {SPAN}::DOUBLE AS length FROM n)
SELECT variant, env::BIGINT AS env, n_nodes, n_edges * CASE WHEN variant = 'bidirectional' THEN 2 ELSE 1 END AS n_edges, n_components::BIGINT AS n_components, round(length * CASE WHEN variant = 'bidirectional' THEN 2 ELSE 1 END, 4) + 0.0 AS length
FROM s, (VALUES ('provenance'), ('analytical'), ('simplified'), ('bidirectional')) x(variant)""")
def network_job(spark, d):
    v = jobs.network(lattice(spark, d, 0.0), _decisions(spark, d), 0.01, ["env"])
    return jobs.network_summary(v, ["env"]).withColumn("length", r9("length", digits=4))


_H = lambda a, b: f"(CASE WHEN {a} > 0 THEN -2 * ({a} / (2.0::DOUBLE * ({a} + {b}))) * ln({a} / (2.0::DOUBLE * ({a} + {b}))) ELSE 0 END + CASE WHEN {b} > 0 THEN -2 * ({b} / (2.0::DOUBLE * ({a} + {b}))) * ln({b} / (2.0::DOUBLE * ({a} + {b}))) ELSE 0 END)"


@query(f"""WITH {_SUM}, e AS (SELECT env, h, v, h * (v + 1) AS eh, v * (h + 1) AS ev FROM n), m AS (SELECT env, eh + ev AS n_edges, {_H('eh', 'ev')} AS o, {_H('h', 'v')} AS w FROM e)
SELECT env::BIGINT AS env, n_edges, {s9('o', 'H_o', 8)}, {s9('w', 'H_w', 8)}, {s9('1 - ((o - ln(4)) / (ln(36) - ln(4))) * ((o - ln(4)) / (ln(36) - ln(4)))', 'phi', 8)}, 1.0::DOUBLE AS circuity FROM m""")
def morphology_job(spark, d):
    v = jobs.network(lattice(spark, d, 0.0), _decisions(spark, d), 0.01, ["env"])
    x = jobs.morphology_metrics(v["analytical"][1], v["simplified"][1], ["env"], 1e-9)
    return x.select("env", "n_edges", *[r9(c, digits=8) for c in ("H_o", "H_w", "phi", "circuity")])


@query(f"""WITH {DECOMP}, k AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY share DESC, edge_id) AS r FROM dc), rk AS (SELECT env, {_avg_rank('distance')} AS a, {_avg_rank('length / distance')} AS b FROM edge),
sp AS (SELECT env, corr(a, b) AS spearman FROM rk GROUP BY 1)
SELECT env, count(*) AS n, {s9('sum(excess)', 'excess', 3)}, {s9('sum(CASE WHEN r <= 10 THEN share END)', 'top_10', 9)}, count(*) FILTER (length / distance > 1.05) AS over_1_05, round(any_value(spearman), 8) + 0.0 AS spearman, true AS consistent FROM k JOIN sp USING (env) GROUP BY 1""")
def audit_job(spark, d):
    x = jobs.circuity_audit(A.edge(spark, d), ["env"], "edge_id")
    return x.select("env", "n", r9("excess", digits=3), r9("top_10", digits=9), "over_1_05", r9("spearman", digits=8), "consistent")


@query("""SELECT 'decisions' AS gate, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS n UNION ALL SELECT 'lookup', (SELECT count(*) FROM orders WHERE o_orderkey % 10 > 0 AND o_orderkey % 7 = 0)
 UNION ALL SELECT 'ids', (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0) UNION ALL SELECT 'close', 0""")
def validation_job(spark, d):
    """Every tenth decision is missing, every seventh event has moved, and no two points are close."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("double").alias("x"), (F.col("o_orderkey") * 10.0).alias("y"))
    decisions = o.where("id % 10 <> 0").withColumn("decision", F.lit("navigable"))
    events = o.withColumn("x", F.when(F.col("id") % 7 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return jobs.validation(decisions, events, o.select("id"), o, [], "id", ["x", "y"], ["navigable"], 0.5)
