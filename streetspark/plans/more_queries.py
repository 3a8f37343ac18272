"""More queries: endpoints, near misses, labels, convergence, curve kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import convergence, geometry, intersect, spatial, topology
from . import adapters as A
from .queries import BEZIER, FLAT, query, r9, s9

G = "g AS (SELECT x, y, count(*) AS n, count(DISTINCT segment_id) AS n_segments, min(endpoint_id) AS least FROM endpt GROUP BY 1, 2)"


@query(f"WITH {A.ENDPT}, {G} SELECT * FROM g")
def endpoint_groups(spark, d):
    return topology.endpoint_groups(A.endpt(spark, d), [])


@query(f"WITH {A.ENDPT}, {G} SELECT sum(n)::BIGINT AS occurrences, count(*) AS positions, count(*) FILTER (n = 1) AS once, count(*) FILTER (n > 1) AS multiple, count(*) FILTER (n_segments > 1) AS shared, max(n) AS most FROM g")
def endpoint_audit(spark, d):
    return topology.endpoint_audit(A.endpt(spark, d), [])


@query(f"WITH {A.ENDPT}, p AS (SELECT DISTINCT x, y, segment_id FROM endpt), k AS (SELECT x, y, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1) SELECT x, y, n AS n_segments, n * (n - 1) // 2 AS n_pairs FROM k")
def endpoint_inventory(spark, d):
    p = A.endpt(spark, d).select("x", "y", "segment_id").distinct().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_segments"))
    return p.where("n_segments > 1").select("x", "y", "n_segments", F.expr("n_segments * (n_segments - 1) div 2").alias("n_pairs"))


@query("WITH p AS (SELECT DISTINCT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x, y) AS r FROM p) SELECT label AS shape_id, x, y, 'L' || lpad(r::VARCHAR, 4, '0') AS location_id FROM q")
def deterministic_ids(spark, d):
    return topology.locations(A.pt(spark, d), ["shape_id"])


MOST = 0.05
NEAR = A.PT + f", nm AS (SELECT a.shape_id, a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM pt a JOIN pt b ON a.shape_id = b.shape_id AND a.id < b.id), nr AS (SELECT * FROM nm WHERE distance > 0 AND distance <= {MOST})"
TOLERANCES = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05]


def _near(spark, d):
    return spatial.distance_pairs(A.pt(spark, d), ["shape_id"], "id", MOST)


@query(f"WITH {NEAR} SELECT shape_id, a, b, {s9('distance', 'distance')} FROM nr")
def near_miss_pairs(spark, d):
    return _near(spark, d).select("shape_id", "a", "b", r9("distance"))


@query(f"WITH {NEAR} SELECT shape_id, a, b, CASE " + " ".join(f"WHEN distance <= {t} THEN {t}::DOUBLE" for t in TOLERANCES) + " END AS tolerance FROM nr")
def first_tolerance(spark, d):
    return _near(spark, d).select("shape_id", "a", "b", spatial.first_tolerance(F.col("distance"), TOLERANCES).alias("tolerance"))


@query(f"WITH {NEAR}, u AS (SELECT DISTINCT shape_id, distance FROM nr), l AS (SELECT *, lead(distance) OVER (PARTITION BY shape_id ORDER BY distance) / distance AS ratio FROM u) SELECT shape_id, count(*) AS n_distances, {s9('max(ratio)', 'largest_ratio', 6)}, coalesce(max(ratio) >= 10, false) AS natural_gap FROM l GROUP BY 1")
def distance_gaps(spark, d):
    return spatial.distance_gaps(_near(spark, d), ["shape_id"]).select("shape_id", "n_distances", r9("largest_ratio", digits=6), "natural_gap")


def _candidates(spark, d):
    n = _near(spark, d)
    return n.select("shape_id", F.lit("endpoint_endpoint").alias("type"), F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), "distance")


@query(f"WITH {NEAR}, e AS (SELECT shape_id, a AS n, b AS o FROM nr UNION SELECT shape_id, b, a FROM nr), m AS (SELECT shape_id, n FROM e GROUP BY 1, 2 HAVING count(*) > 1) SELECT shape_id, a::VARCHAR AS source, b::VARCHAR AS target, ((shape_id, a) IN (SELECT (shape_id, n) FROM m) OR (shape_id, b) IN (SELECT (shape_id, n) FROM m)) AS ambiguous FROM nr")
def ambiguous_candidates(spark, d):
    return topology.ambiguous(_candidates(spark, d), ["shape_id"]).select("shape_id", "source", "target", "ambiguous")


@query(f"""WITH {NEAR}, t AS (SELECT nr.*, tol FROM nr, (VALUES {', '.join(f'({t}::DOUBLE)' for t in TOLERANCES)}) v(tol) WHERE distance <= tol),
e AS (SELECT shape_id, tol, a AS n, b AS o FROM t UNION SELECT shape_id, tol, b, a FROM t), m AS (SELECT shape_id, tol, n FROM e GROUP BY ALL HAVING count(*) > 1),
x AS (SELECT t.*, (m1.n IS NOT NULL OR m2.n IS NOT NULL) AS amb FROM t LEFT JOIN m m1 ON t.shape_id = m1.shape_id AND t.tol = m1.tol AND t.a = m1.n LEFT JOIN m m2 ON t.shape_id = m2.shape_id AND t.tol = m2.tol AND t.b = m2.n)
SELECT shape_id, tol AS tolerance, count(*) AS eligible, count(*) FILTER (amb) AS ambiguous, count(*) FILTER (NOT amb) AS applied, 2 * count(*) FILTER (NOT amb) AS affected FROM x GROUP BY 1, 2""")
def snapping_sensitivity(spark, d):
    return topology.snapping_sensitivity(_candidates(spark, d), ["shape_id"], TOLERANCES)


@query(f"WITH {A.PT} SELECT id, {s9('-3.0 + (x - (-1.0)) / 2.0 * 100.0', 'px')}, {s9('7.0 + (y - (-1.0)) / 2.0 * 200.0', 'pz')} FROM pt")
def affine_map(spark, d):
    f = F.lit
    return A.pt(spark, d).select("id", r9(E.affine("x", f(-1.0), f(2.0), f(100.0), f(-3.0)), "px"), r9(E.affine("y", f(-1.0), f(2.0), f(200.0), f(7.0)), "pz"))


@query("SELECT event_type, event_id, 'E' || event_type || '-C' || lpad((row_number() OVER (PARTITION BY event_type ORDER BY event_id))::VARCHAR, 6, '0') AS label FROM events")
def review_labels(spark, d):
    x = topology.numbered(A.table(spark, d, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], "n", "-C", 6)
    return x.select("event_type", "event_id", F.concat(F.lit("E"), "event_type", "n").alias("label"))


@query("SELECT o_orderpriority AS env, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus = 'X') AS X FROM orders GROUP BY 1")
def decision_counts(spark, d):
    o = A.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "env")
    return o.groupBy("env").pivot("o_orderstatus", ["F", "O", "P", "X"]).count().na.fill(0)


SWEEP = [0.1, 0.05, 0.02, 0.01, 0.005]
SWEEP_SQL = f"""WITH RECURSIVE {A.SEG}, st AS (SELECT seg.*, tol FROM seg, (VALUES {', '.join(f'({t}::DOUBLE)' for t in SWEEP)}) v(tol)), ad AS (
 SELECT segment_id, shape_id, tol, 0::DOUBLE AS a, 1::DOUBLE AS b, 0 AS lvl, x0, y0, x1, y1, x2, y2 FROM st
 UNION ALL
 SELECT segment_id, shape_id, tol, CASE WHEN k = 0 THEN a ELSE (a + b) / 2 END, CASE WHEN k = 0 THEN (a + b) / 2 ELSE b END, lvl + 1, x0, y0, x1, y1, x2, y2
 FROM (SELECT * FROM (SELECT *, {FLAT.replace('TOL', 'tol')} AS leaf FROM ad) WHERE NOT leaf AND lvl < 40) q, (VALUES (0), (1)) v(k)),
ts AS (SELECT segment_id, tol, b AS t FROM ad WHERE {FLAT.replace('TOL', 'tol')} UNION ALL SELECT segment_id, tol, 0 FROM st),
vx AS (SELECT shape_id, segment_id, tol, t, {BEZIER.format(c='x')} AS x, {BEZIER.format(c='y')} AS y FROM ts JOIN seg USING (segment_id)),
le AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM vx WINDOW w AS (PARTITION BY segment_id, tol ORDER BY t)),
sw AS (SELECT shape_id, segment_id, tol AS tolerance, count(*) AS n_vertices, sum(sqrt(dx * dx + dy * dy)) AS length FROM le GROUP BY 1, 2, 3),
fi AS (SELECT *, lead(length) OVER (PARTITION BY segment_id ORDER BY tolerance DESC) AS finer FROM sw),
su AS (SELECT shape_id, tolerance, max(abs(finer - length)) AS max_change, max(abs(finer - length) / finer) AS max_relative, abs(sum(finer) - sum(length)) / sum(finer) AS total_relative FROM fi GROUP BY 1, 2)"""


def _sweep(spark, d):
    return convergence.sweep(A.seg(spark, d), ["shape_id"], SWEEP)


@query(f"{SWEEP_SQL}, v AS (SELECT shape_id, tolerance, sum(n_vertices)::BIGINT AS vertices, sum(length) AS total FROM sw GROUP BY 1, 2) SELECT shape_id, tolerance, vertices, {s9('total', 'total', 7)}, {s9('max_change', 'max_change', 7)}, {s9('max_relative', 'max_relative', 7)}, {s9('total_relative', 'total_relative', 7)} FROM v JOIN su USING (shape_id, tolerance)")
def convergence_sweep(spark, d):
    s = _sweep(spark, d)
    v = s.groupBy("shape_id", "tolerance").agg(F.sum("n_vertices").alias("vertices"), F.sum("length").alias("total"))
    x = v.join(convergence.successive(s, ["shape_id"]), ["shape_id", "tolerance"])
    return x.select("shape_id", "tolerance", "vertices", *[r9(c, digits=7) for c in ("total", "max_change", "max_relative", "total_relative")])


@query(f"{SWEEP_SQL}, ok AS (SELECT tolerance FROM su GROUP BY 1 HAVING bool_and(coalesce(total_relative <= 0.05 AND max_relative <= 0.4, false))) SELECT max(tolerance) AS tolerance FROM ok")
def tolerance_selection(spark, d):
    return convergence.select(convergence.successive(_sweep(spark, d), ["shape_id"]), ["shape_id"], 0.05, 0.4)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_hash(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


_CR = A.SEG + """, cp AS (SELECT a.shape_id, a.segment_id AS a, b.segment_id AS b, a.x0 AS ax, a.y0 AS ay, a.x2 - a.x0 AS rx, a.y2 - a.y0 AS ry, b.x0 AS bx, b.y0 AS by_, b.x2 - b.x0 AS sx, b.y2 - b.y0 AS sy
 FROM seg a JOIN seg b ON a.shape_id = b.shape_id AND a.segment_id < b.segment_id),
cr AS (SELECT *, rx * sy - ry * sx AS den FROM cp), cu AS (SELECT *, ((bx - ax) * sy - (by_ - ay) * sx) / den AS t, ((bx - ax) * ry - (by_ - ay) * rx) / den AS u FROM cr WHERE den <> 0)"""


@query(f"WITH {_CR} SELECT shape_id, a, b, {s9('ax + t * rx', 'x', 8)}, {s9('ay + t * ry', 'y', 8)} FROM cu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
def segment_crossings(spark, d):
    """Crossings of chords: boxes by grid, then the closed form."""
    s = A.seg(spark, d)
    boxes = s.select("shape_id", "segment_id", *[f("x0", "x2").alias(f"{n}_x") for n, f in (("min", F.least), ("max", F.greatest))], *[f("y0", "y2").alias(f"{n}_y") for n, f in (("min", F.least), ("max", F.greatest))])
    p = intersect.pair_rows(s, spatial.bbox_pairs(boxes, ["shape_id"], "segment_id"), ["shape_id"])
    c = F.col
    rx, ry, sx, sy = c("a_x2") - c("a_x0"), c("a_y2") - c("a_y0"), c("b_x2") - c("b_x0"), c("b_y2") - c("b_y0")
    dx, dy, den = c("b_x0") - c("a_x0"), c("b_y0") - c("a_y0"), E.cross(rx, ry, sx, sy)
    safe = F.when(den != 0, den)
    p = p.withColumn("t", E.cross(dx, dy, sx, sy) / safe).withColumn("u", E.cross(dx, dy, rx, ry) / safe)
    return p.where(c("t").between(0, 1) & c("u").between(0, 1)).select("shape_id", "a", "b", r9(c("a_x0") + c("t") * rx, "x", 8), r9(c("a_y0") + c("t") * ry, "y", 8))
