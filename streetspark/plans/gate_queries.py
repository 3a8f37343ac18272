"""Queries of sources, sinks, gates, counts and graphs with geometry, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import audit, checks, convergence, geometry, graph, intersect, morphology, spatial, topology
from ..sources import graphml, tables
from . import adapters as A
from .queries import BEZIER, CHORD, DECOMP, ENT, _adaptive_sql, _chords, _hist, query, r9, s9

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# sources, sinks, gates


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES))
def inventory(spark, d):
    return tables.inventory(spark, {t: A.table(spark, d, t) for t in TABLES}).select("name", "n_rows")


@query("SELECT 'orders' AS name, 'another n_rows' AS reason UNION ALL SELECT 'shapes', 'missing' UNION ALL SELECT name, 'unexpected' FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES if t not in ("region", "nation", "orders")) + ") v(name)")
def inventory_gate(spark, d):
    """Five regions and 25 nations are as expected; no orders, a table that is not there, and all the rest are not."""
    found = tables.inventory(spark, {t: A.table(spark, d, t) for t in TABLES})
    return tables.unmet(found, spark.createDataFrame([("region", 5), ("nation", 25), ("orders", 0), ("shapes", 1)], "name string, n_rows long"), "name")


@query(f"SELECT o_orderpriority, count(*) AS n, {s9('sum(o_totalprice)', 'total', 2)}, min(o_orderkey) AS least FROM orders GROUP BY 1")
def csv_roundtrip(spark, d):
    """Orders written as CSV with two of their columns left out, and read back typed."""
    at = tables.scratch(spark, "csv")
    tables.write_csv(A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice")), at, ["o_orderkey", "o_orderpriority", "o_totalprice"])
    x = tables.read_csv(spark, at, "o_orderkey long, o_orderpriority string, o_totalprice double")
    return x.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r9(F.sum("o_totalprice"), "total", 2), F.min("o_orderkey").alias("least"))


@query("SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def json_roundtrip(spark, d):
    """Regions with an array of their nations written as JSON, and read back."""
    at = tables.scratch(spark, "json")
    n = A.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    r = A.table(spark, d, "region").select("r_regionkey", "r_name")
    r = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).drop("n_regionkey")
    tables.write_json(r, at)
    return spark.read.schema(r.schema).json(at).select("r_regionkey", "r_name", F.inline("nations"))


@query(f"WITH {A.GCONV}, e AS (SELECT count(*) AS n_edges FROM ce) SELECT (SELECT count(*) FROM cn) AS n_nodes, n_edges, (SELECT count(DISTINCT conv_id) FROM cn) AS n_components, 0::BIGINT AS n_loops, 0::BIGINT AS n_parallel, 0::BIGINT AS n_mismatches FROM e")
def graph_manifest(spark, d):
    """A graph written as GraphML, read again, held against itself, and summed up."""
    nodes, edges = A.gconv(spark, d)
    nodes, edges = nodes.select("env", "node_id", "turn", "length"), edges.select("env", "edge_id", "u", "v", "length")
    at = tables.scratch(spark, "graphml")
    graphml.write_graphml(nodes, edges, at)
    n, e = graphml.read_graphml(spark, at)
    n = n.withColumn("node_id", F.col("node_id").cast("long"))
    e = e.select(*[F.col(c).cast("long" if c in ("u", "v", "edge_id") else t).alias(c) for c, t in e.dtypes])
    bad = graphml.roundtrip_mismatches((nodes, edges), (n, e)).agg(F.count(F.lit(1)).alias("n_mismatches"))
    s = graph.graph_summary(e.select(F.col("env").cast("int").alias("env"), "edge_id", "u", "v"), ["env"], n.select(F.col("env").cast("int").alias("env"), "node_id"))
    return s.select("n_nodes", "n_edges", "n_components", "n_loops", "n_parallel").crossJoin(F.broadcast(bad))  # one row


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'mismatch' ELSE 'matched' END AS status FROM orders")
def event_lookup(spark, d):
    """Decisions looked up by event, with the coordinates compared: every eleventh event is not there, every seventh moved."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("x"), F.col("o_orderkey").alias("y"))
    events = o.where("event_id % 11 <> 0").withColumn("x", F.when(F.col("event_id") % 7 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return checks.lookup(o, events, "event_id", ["x", "y"]).select("event_id", "status")


@query("""SELECT o_orderkey AS id, o_orderkey % 5 <> 0 AS in_source, o_orderkey % 3 <> 0 AS in_csv, true AS in_json,
 NOT (o_orderkey % 13 = 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 0)) AS agree FROM orders""")
def id_reconciliation(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("x"))
    other = F.coalesce(F.bitwise_not("x"), F.lit(0))  # a value of its own for every x, 0 and null too
    moved = o.withColumn("x", F.when(F.col("id") % 13 == 0, other).otherwise(F.col("x")))
    return checks.reconcile_ids({"source": o.where("id % 5 <> 0"), "csv": o.where("id % 3 <> 0"), "json": moved}, "id", ["x"])


@query(f"WITH {A.PT} SELECT a.shape_id, a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.shape_id = b.shape_id AND a.id < b.id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05")
def close_pairs(spark, d):
    return checks.close_pairs(A.pt(spark, d), ["shape_id"], "id", 0.05).select("shape_id", "a", "b")


@query("SELECT side, row FROM (SELECT 'first' AS side, '{\"n_nationkey\":' || n_nationkey || '}' AS row FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'second', '{\"n_nationkey\":' || (n_nationkey + 100) || '}' FROM nation WHERE n_nationkey % 10 = 1)")
def set_difference(spark, d):
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return checks.set_difference(n, n.where("n_nationkey % 6 <> 0").union(n.where("n_nationkey % 10 = 1").select(F.col("n_nationkey") + 100)))


@query("SELECT vec_id AS segment_id, CASE WHEN vec_id % 30 = 0 THEN 'not registered' ELSE 'not found' END AS reason FROM embeddings WHERE (vec_id % 10 = 0) <> (vec_id % 30 <> 0 AND (vec_id % 10 = 0 OR vec_id % 17 = 0))")
def zero_chord_registry(spark, d):
    """Every tenth curve is bent back to its start; the register lacks every thirtieth and has every seventeenth that is none."""
    s = A.seg(spark, d)
    back = lambda i: F.when(F.col("segment_id") % 10 == 0, F.col(f"{i}0")).otherwise(F.col(f"{i}2")).alias(f"{i}2")
    s = s.select("segment_id", "shape_id", "x0", "y0", "x1", "y1", back("x"), back("y"))
    found = s.where(geometry.zero_chord()).select("segment_id")
    return checks.registered(found, s.where("segment_id % 30 <> 0 AND (segment_id % 10 = 0 OR segment_id % 17 = 0)"), "segment_id")


@query("""SELECT 1 AS env, 'orders:' || o_orderkey AS edge_id, 'not flagged' AS reason FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus <> 'P'
 UNION ALL SELECT 1, 'orders:' || o_orderkey, 'flagged but not registered' FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderstatus = 'P' UNION ALL SELECT 1, 'orders:none', 'no edge'""")
def anomaly_registry(spark, d):
    """Registered edges against flags: flags that are missing, flags too many, ids without an edge."""
    o = A.table(spark, d, "orders").select(F.lit(1).alias("env"), F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("edge_id"), (F.col("o_orderstatus") == "P").alias("flag"), "o_orderkey")
    register = o.where("o_orderkey % 10 = 0").select("env", "edge_id").union(spark.createDataFrame([(1, "orders:none")], "env int, edge_id string"))
    return graph.exclusions(o, register, ["env"], "flag")[2]


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'no decision' WHEN o_orderkey % 10 = 1 THEN 'more than one' ELSE 'not allowed' END AS reason FROM orders WHERE o_orderkey % 10 < 3 UNION ALL SELECT -1, 'not required'""")
def decision_gate(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    given = o.where("id % 10 <> 0").withColumn("decision", F.when(F.col("id") % 10 == 2, "perhaps").otherwise("navigable"))
    given = given.union(given.where("id % 10 = 1")).union(spark.createDataFrame([(-1, "navigable")], "id long, decision string"))
    return checks.incomplete(given, o, "id", ["navigable", "not_navigable"])


@query("SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders")
def strict_boolean(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", "True").otherwise("False")
    return A.table(spark, d, "orders").select("o_orderkey", E.strict_boolean(text).alias("done"))


# curves and polylines


@query(f"""WITH {A.SEG}, k AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 2 AS d FROM seg WHERE segment_id % 10 = 0 AND (x1 <> x0 OR y1 <> y0)) SELECT shape_id, segment_id, {s9('d', 'excursion')} FROM k""")
def zero_chord_report(spark, d):
    """How far curves with equal ends go: half as far as the control point."""
    s = A.seg(spark, d)
    back = lambda i: F.when(F.col("segment_id") % 10 == 0, F.col(f"{i}0")).otherwise(F.col(f"{i}2")).alias(f"{i}2")
    return geometry.excursions(s.select("segment_id", "shape_id", "x0", "y0", "x1", "y1", back("x"), back("y")), ["shape_id"]).select("shape_id", "segment_id", r9("excursion"))


_LINE = _adaptive_sql("0.01") + f", v AS (SELECT segment_id, t, {BEZIER.format(c='x')} AS x, {BEZIER.format(c='y')} AS y FROM ts JOIN seg USING (segment_id)), st AS (SELECT segment_id, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM v WINDOW w AS (PARTITION BY segment_id ORDER BY t))"


@query(_LINE + f" SELECT segment_id, count(*)::INT AS n_vertices, {s9('sum(step)', 'length', 8)} FROM st GROUP BY 1")
def selected_linework(spark, d):
    return geometry.selected_linework(A.seg(spark, d), 0.01, ["shape_id"]).select("segment_id", "n_vertices", r9("length", digits=8))


_ARC = """q AS (SELECT *, x1 - x0 AS bx, y1 - y0 AS by_, x0 - 2 * x1 + x2 AS ax, y0 - 2 * y1 + y2 AS ay FROM seg),
a AS (SELECT *, ax * ax + ay * ay AS a, 2 * (ax * bx + ay * by_) AS b, bx * bx + by_ * by_ AS c FROM q),
f AS (SELECT segment_id, 2 * ((2 * a + b) / (4 * a) * sqrt(a + b + c) - b / (4 * a) * sqrt(c) + (4 * a * c - b * b) / (8 * a * sqrt(a)) * (ln(2 * sqrt(a) * sqrt(a + b + c) + 2 * a + b) - ln(2 * sqrt(a) * sqrt(c) + b))) AS length FROM a)"""


@query(f"WITH {A.SEG}, {_ARC} SELECT segment_id, {s9('length', 'length', 7)} FROM f")
def arc_length(spark, d):
    return A.seg(spark, d).select("segment_id", r9(geometry.arc_length()(*geometry.CONTROL), "length", 7))


_SAMPLES = A.SEG + f", sm AS (SELECT segment_id, x1 AS px, y1 AS py, i, i / 10.0::DOUBLE AS t, {BEZIER.format(c='x').replace('t', '(i / 10.0::DOUBLE)')} AS x, {BEZIER.format(c='y').replace('t', '(i / 10.0::DOUBLE)')} AS y FROM seg, range(11) r(i))"


@query(f"""WITH {_SAMPLES}, pc AS (SELECT *, lead(t) OVER w AS t2, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM sm WINDOW w AS (PARTITION BY segment_id ORDER BY i)),
pr AS (SELECT *, least(greatest(((px - x) * dx + (py - y) * dy) / (dx * dx + dy * dy), 0), 1) AS s FROM pc WHERE dx IS NOT NULL),
di AS (SELECT segment_id, i, t + s * (t2 - t) AS t, sqrt((x + s * dx - px) * (x + s * dx - px) + (y + s * dy - py) * (y + s * dy - py)) AS distance FROM pr),
bs AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY distance, i) AS r FROM di) SELECT segment_id, {s9('t', 't', 7)}, {s9('distance', 'distance', 8)} FROM bs WHERE r = 1""")
def nearest_sample_parameter(spark, d):
    """The parameter of a curve's polyline where it is nearest to the middle control point."""
    s = A.seg(spark, d)
    lines = geometry.fixed_samples(s, 11).select("segment_id", F.col("i").alias("pos"), "t", "x", "y")
    x = intersect.nearest_sample(lines, s.select("segment_id", F.col("x1").alias("px"), F.col("y1").alias("py")), ["segment_id"])
    return x.select("segment_id", r9("t", digits=7), r9("distance", digits=8))



def _newton(t: str) -> str:
    """A Newton step on (B(t) - P) . B'(t), P being the middle control point."""
    g = " + ".join(f"({BEZIER.format(c=c).replace('t', t)} - {c}1) * (2 * ((1 - {t}) * ({c}1 - {c}0) + {t} * ({c}2 - {c}1)))" for c in "xy")
    h = " + ".join(f"(2 * ((1 - {t}) * ({c}1 - {c}0) + {t} * ({c}2 - {c}1))) * (2 * ((1 - {t}) * ({c}1 - {c}0) + {t} * ({c}2 - {c}1))) + ({BEZIER.format(c=c).replace('t', t)} - {c}1) * 2 * ({c}0 - 2 * {c}1 + {c}2)" for c in "xy")
    return f"least(greatest({t} - ({g}) / ({h}), 0), 1)"


_DIST = lambda t: "sqrt(" + " + ".join(f"({BEZIER.format(c=c).replace('t', t)} - {c}1) * ({BEZIER.format(c=c).replace('t', t)} - {c}1)" for c in "xy") + ")"


@query(f"""WITH {A.SEG}, gr AS (SELECT seg.*, i / 2000.0::DOUBLE AS s FROM seg, range(2001) r(i)), gd AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY {_DIST('s')}, s) AS r FROM gr),
n1 AS (SELECT * EXCLUDE (s), {_newton('s')} AS s FROM gd WHERE r = 1), n2 AS (SELECT * EXCLUDE (s), {_newton('s')} AS s FROM n1), n3 AS (SELECT * EXCLUDE (s), {_newton('s')} AS s FROM n2)
SELECT shape_id, segment_id, {s9('s', 't', 6)}, {s9(_DIST('s'), 'distance', 8)} FROM n3""")
def nearest_on_curve(spark, d):
    """For every curve the place that is nearest to its middle control point; the SQL refines the best of 2001 samples."""
    s = A.seg(spark, d).withColumn("px", F.col("x1")).withColumn("py", F.col("y1"))
    return intersect.nearest(s, ["shape_id", "segment_id"]).select("shape_id", "segment_id", r9("t", digits=6), r9("distance", digits=8))


# counts, ranks, folds


@query("SELECT coalesce(event_type, 'all') AS event_type, coalesce((user_id % 3)::VARCHAR, 'all') AS part, (grouping(event_type) * 2 + grouping(user_id % 3))::INT AS level, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def event_rollup(spark, d):
    e = A.table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("part"))
    x = audit.rollup_counts(e, "event_type", "part")
    return x.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce(F.col("part").cast("string"), F.lit("all")).alias("part"), "level", "n")


_OFF = f"WITH {CHORD}, co AS (SELECT cb.*, o * 0.5::DOUBLE AS off FROM cb, range(20) r(o)), {_hist('co', 'shape_id, off', '1', 'off')}, en AS (SELECT shape_id, off, {ENT} AS entropy FROM h GROUP BY 1, 2), lo AS (SELECT min(shape_id) AS a, max(shape_id) AS b FROM en), wi AS (SELECT x.off, x.entropy AS first, y.entropy AS second FROM en x JOIN en y USING (off), lo WHERE x.shape_id = lo.a AND y.shape_id = lo.b)"


def _offsets(spark, d):
    c = _chords(spark, d).withColumn("off", F.explode(F.array(*[F.lit(i * 0.5) for i in range(20)])))
    x = morphology.orientation_entropy(c, ["shape_id", "off"], offset=F.col("off"))
    ends = A.seg(spark, d).agg(F.min("shape_id").alias("a"), F.max("shape_id").alias("b"))
    x = x.crossJoin(F.broadcast(ends)).where("shape_id IN (a, b)")  # one row
    return x.select(F.when(F.col("shape_id") == F.col("a"), "first").otherwise("second").alias("env"), "off", "entropy")


@query(_OFF + f" SELECT off, {s9('first', 'first')}, {s9('second', 'second')} FROM wi")
def sensitivity_pivot(spark, d):
    return _offsets(spark, d).groupBy("off").pivot("env", ["first", "second"]).agg(F.first("entropy")).select("off", r9("first"), r9("second"))


@query(_OFF + ", " + "sm AS (SELECT " + ", ".join(f"{f}({s}) AS {n}_{s}" for s in ("first", "second") for n, f in (("least", "min"), ("most", "max"), ("mean", "avg"))) + ", count(*) FILTER (first > second) AS n_first_larger FROM wi) SELECT 'entropy' AS metric, " + ", ".join(s9(f"{n}_{s}", f"{n}_{s}") for s in ("first", "second") for n in ("least", "most", "mean")) + ", n_first_larger FROM sm")
def sensitivity_summary(spark, d):
    x = audit.sensitivity_summary(_offsets(spark, d), ["entropy"], "env", "off", "first", "second")
    return x.select("metric", *[r9(f"{n}_{s}") for s in ("first", "second") for n in ("least", "most", "mean")], "n_first_larger")


@query(f"WITH {A.ENDPT} SELECT x, y, string_agg(DISTINCT segment_id::VARCHAR, ',' ORDER BY segment_id::VARCHAR) AS ids FROM endpt GROUP BY 1, 2")
def location_ids(spark, d):
    p = A.endpt(spark, d).withColumn("id", F.col("segment_id").cast("string"))
    return topology.location_ids(p, [], "id").select("x", "y", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {A.ENDPT}, g AS (SELECT x, y, count(*) AS n FROM endpt GROUP BY 1, 2) SELECT n, count(*) AS positions FROM g GROUP BY 1")
def endpoint_frequencies(spark, d):
    return topology.endpoint_frequencies(A.endpt(spark, d), [])


_CELLS = "WITH ce AS (SELECT vec_id AS segment_id, floor(embedding[1] * 4) AS x0, floor(embedding[2] * 4) AS y0, floor(embedding[5] * 4) AS x2, floor(embedding[6] * 4) AS y2 FROM embeddings)"


def _cells(spark, d):
    s = A.seg(spark, d)
    cell = lambda c: F.floor(F.col(c) * 4).alias(c)
    return s.select("segment_id", cell("x0"), cell("y0"), F.col("x1"), F.col("y1"), cell("x2"), cell("y2"))


@query(_CELLS + ", p AS (SELECT segment_id, x0 AS x, y0 AS y FROM ce UNION SELECT segment_id, x2, y2 FROM ce) SELECT a.x::BIGINT AS x, a.y::BIGINT AS y, a.segment_id AS a, b.segment_id AS b FROM p a JOIN p b ON a.x = b.x AND a.y = b.y AND a.segment_id < b.segment_id")
def endpoint_pairs(spark, d):
    """Pairs of curves that end at one position, here a cell of the plane."""
    return topology.endpoint_pairs(topology.endpoints(_cells(spark, d)), []).select("x", "y", "a", "b")


@query(_CELLS + " SELECT count(DISTINCT (x0, y0, x2, y2)) AS directed, count(DISTINCT CASE WHEN (x0, y0) <= (x2, y2) THEN (x0, y0, x2, y2) ELSE (x2, y2, x0, y0) END) AS undirected FROM ce")
def end_position_pairs(spark, d):
    return topology.end_position_pairs(_cells(spark, d), [])


@query(f"WITH {A.SEG}, v AS (SELECT segment_id, segment_id % 100 / 100.0::DOUBLE AS t FROM seg), i AS (SELECT segment_id, k::INT AS piece, k / 4.0::DOUBLE AS t_start, (k + 1) / 4.0::DOUBLE AS t_end FROM seg, range(4) r(k)) SELECT segment_id, t, piece FROM v JOIN i USING (segment_id) WHERE t_start < t AND t < t_end")
def interval_containment(spark, d):
    """The piece of a curve that holds a parameter strictly inside; one at a cut is in none."""
    s = A.seg(spark, d)
    pieces = geometry.split_at_many(s, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).select("segment_id", "piece", "t_start", "t_end")
    v = s.select("segment_id", (F.col("segment_id") % 100 / 100.0).alias("t"))
    return checks.contained(v, pieces, ["segment_id"], "t", "t_start", "t_end").select("segment_id", "t", "piece")


@query(f"WITH {A.SEG} SELECT segment_id, CASE WHEN segment_id % 3 = 0 THEN 2 ELSE 3 END::INT AS piece, CASE WHEN segment_id % 3 = 0 THEN 'gap before the piece' ELSE 'an end without location' END AS reason FROM seg WHERE segment_id % 3 < 2")
def split_contiguity(spark, d):
    """Pieces of which every third curve lacks the second, and every third the last end's location."""
    x = geometry.split_at_many(A.seg(spark, d), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).where("segment_id % 3 <> 0 OR piece <> 1")
    x = x.withColumn("u", F.lit("L")).withColumn("v", F.when(~((F.col("segment_id") % 3 == 1) & (F.col("piece") == 3)), F.lit("L"))).withColumn("length", F.lit(1.0))
    return topology.violations(x, []).select("segment_id", "piece", "reason")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS t, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM (SELECT user_id, event_id, round(value, 2) AS value FROM events)),
k AS (SELECT user_id, r, t AS kept, 1 AS n FROM e WHERE r = 1 UNION ALL SELECT k.user_id, e.r, CASE WHEN e.t - k.kept <= 1.5 THEN k.kept ELSE e.t END, CASE WHEN e.t - k.kept <= 1.5 THEN k.n ELSE k.n + 1 END FROM k JOIN e ON e.user_id = k.user_id AND e.r = k.r + 1)
SELECT user_id, max(n)::INT AS n_kept, round(max(kept), 2) + 0.0 AS last FROM k GROUP BY 1""")
def keep_apart(spark, d):
    """Values of a user of which one within 1.5 of the last kept joins it."""
    e = A.table(spark, d, "events").select("user_id", F.round("value", 2).alias("t"), F.array(F.col("event_id").cast("string")).alias("ids"))
    g = e.groupBy("user_id").agg(F.collect_list(F.struct("t", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "ids")).alias("r"))
    x = g.select("user_id", topology.keep_apart(F.col("r"), 1.5, 0.0).alias("k"))
    return x.select("user_id", F.size("k").alias("n_kept"), r9(F.element_at("k", -1)["t"], "last", 2))


@query(f"""WITH RECURSIVE {A.SEG}, {_ARC}, sa AS (SELECT seg.*, n, i, i / n::DOUBLE AS t FROM seg, (VALUES (4), (16), (64)) v(n), range(65) r(i) WHERE i <= n),
pt AS (SELECT segment_id, shape_id, n, i, {BEZIER.format(c='x')} AS x, {BEZIER.format(c='y')} AS y FROM sa),
st AS (SELECT shape_id, segment_id, n, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS s FROM pt WINDOW w AS (PARTITION BY segment_id, n ORDER BY i)),
le AS (SELECT shape_id, segment_id, n, sum(s) AS l FROM st GROUP BY 1, 2, 3)
SELECT shape_id, 1.0 / n::DOUBLE AS tolerance, count(*) AS n_segments, sum(n + 1)::BIGINT AS vertices, {s9('sum(l)', 'total', 6)}, {s9('sum(abs(l - length))', 'absolute_error', 6)}, {s9('max(abs(l - length) / length)', 'worst_error', 6)} FROM le JOIN f USING (segment_id) GROUP BY shape_id, n""")
def tolerance_analysis(spark, d):
    """Polylines of 4, 16 and 64 pieces against the curves' lengths."""
    s = A.seg(spark, d)
    swept = None
    for n in (4, 16, 64):
        p = geometry.polyline_lengths(geometry.fixed_samples(s, n + 1), ["shape_id", "segment_id"], "i")
        p = p.select("shape_id", "segment_id", F.lit(1.0 / n).alias("tolerance"), (F.col("n_pieces") + 1).alias("n_vertices"), "length")
        swept = p if swept is None else swept.union(p)
    ref = s.select("shape_id", "segment_id", geometry.arc_length()(*geometry.CONTROL).alias("reference"), geometry.zero_chord().alias("zero_chord"))
    x = convergence.analyse(swept, ref, ["shape_id"])
    return x.select("shape_id", "tolerance", "n_segments", "vertices", r9("total", digits=6), r9("absolute_error", digits=6), r9("worst_error", digits=6))


@query(f"WITH {DECOMP}, k AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY round(excess, 6) DESC, edge_id) AS r FROM dc) SELECT r::INT AS rank, env, edge_id, {s9('share', 'excess_share', 10)} FROM k WHERE r <= 5")
def compact_ranks(spark, d):
    x = audit.decompose(A.edge(spark, d), ["env"]).withColumn("by", F.round("excess", 6))
    c = audit.compact_ranks(audit.top(x, ["env"], "by", "edge_id", 5), ["env", "edge_id", "excess_share"])
    return c.withColumn("excess_share", r9("excess_share", digits=10))


@query(f"WITH {A.EDGE} SELECT 'none'::VARCHAR AS env, 0::BIGINT AS n WHERE false")
def identity_check(spark, d):
    """Groups whose circuity decomposition does not add up: none."""
    bad = audit.identity_violations(audit.decompose(A.edge(spark, d), ["env"]), ["env"])
    return bad.groupBy("env").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, row_number() OVER (ORDER BY coalesce(v, -1.0), event_id)::INT AS r FROM (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN value END AS v FROM events)")
def event_order(spark, d):
    """Places in an order in which nulls count as -1."""
    e = A.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("v"))
    x = topology.numbered(e, [], [checks.sort_key("v"), "event_id"], "r", "")
    return x.select("event_id", F.col("r").cast("int").alias("r"))


# graphs


@query(f"WITH {A.GTREE}, g AS (SELECT env, degree, count(*) AS n FROM deg GROUP BY 1, 2) SELECT env, string_agg(degree || ':' || n, ',' ORDER BY degree) AS degrees FROM g GROUP BY 1")
def degree_map(spark, d):
    x = graph.degree_map(A.gtree(spark, d), ["env"])
    entry = lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))
    return x.select("env", F.array_join(F.transform(F.map_entries("degrees"), entry), ",").alias("degrees"))


@query(f"""WITH {A.GCONV}, en AS (SELECT env, u AS node, edge_id FROM ce UNION SELECT env, v, edge_id FROM ce), k AS (SELECT node, count(*) AS n FROM en GROUP BY 1), x AS (SELECT node_id, conv_id, coalesce(n, 0) AS n FROM cn LEFT JOIN k ON node = node_id)
SELECT 1 AS env, count(*) AS n_nodes, count(*) FILTER (n = 1) AS with_one, count(*) FILTER (n = 2) AS with_two, count(*) FILTER (n >= 3) AS with_three_or_more, count(*) FILTER (n = 0) AS with_none, (SELECT count(*) FROM ce) AS n_edges, 0::BIGINT AS n_loops, count(DISTINCT conv_id) AS n_components FROM x""")
def topology_counts(spark, d):
    nodes, edges = A.gconv(spark, d)
    return graph.incident_buckets(edges, ["env"], nodes)


@query("""WITH g AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 1 AS env, 'a loop' AS reason, sum(n)::BIGINT AS n FROM g WHERE a = b HAVING count(*) > 0 UNION ALL SELECT 1, 'parallel edges', count(*) FROM g WHERE n > 1 AND a <> b HAVING count(*) > 0""")
def graph_defects(spark, d):
    e = A.table(spark, d, "lineitem").select(F.lit(1).alias("env"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("edge_id"), F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))
    return graph.defects(e, ["env"])


@query(f"WITH {A.GCONV} SELECT 1 AS env, count(*) AS n_nodes, count(DISTINCT conv_id) AS n_components, (SELECT count(*) FROM ce) AS n_edges, 0::BIGINT AS n_loops, 0::BIGINT AS n_parallel, count(*) FILTER (turn % 4 = 0) AS n_flagged_nodes, (SELECT count(*) FROM ce WHERE edge_id % 3 = 0) AS n_flagged_edges FROM cn")
def flagged_summary(spark, d):
    nodes, edges = A.gconv(spark, d)
    return graph.graph_summary(edges.withColumn("flag", F.col("edge_id") % 3 == 0), ["env"], nodes.withColumn("flag", F.col("turn") % 4 == 0), "flag")


@query(f"WITH {A.GCONV}, l AS (SELECT node_id FROM cn WHERE turn % 5 <> 3) SELECT env, edge_id::VARCHAR AS id, 'an end that is no location' AS reason FROM ce WHERE u NOT IN (SELECT node_id FROM l) OR v NOT IN (SELECT node_id FROM l)")
def provenance_graph(spark, d):
    """Fragments that end at locations that are left out."""
    nodes, edges = A.gconv(spark, d)
    loc = nodes.where("turn % 5 <> 3").withColumnRenamed("node_id", "location_id")
    return graph.provenance(loc, edges.withColumnRenamed("edge_id", "fragment_id"), ["env"])[2]


def _placed(spark, d):
    """The conversations' graph in the plane: a node at (conversation modulo 1000, turn), every other edge drawn from v to u."""
    nodes, edges = A.gconv(spark, d)
    x = F.pmod(F.col("conv_id"), F.lit(1000)).cast("double")
    nodes = nodes.withColumn("x", x).withColumn("y", F.col("turn").cast("double"))
    at = lambda n, c: F.struct(F.pmod(F.expr(f"{n} div 1000000"), F.lit(1000)).cast("double").alias("x"), (F.col(n) % 1000000).cast("double").alias("y"))
    swap = F.col("edge_id") % 2 == 0
    edges = edges.withColumn("p", F.when(swap, F.col("v")).otherwise(F.col("u"))).withColumn("q", F.when(swap, F.col("u")).otherwise(F.col("v")))
    return nodes, edges.select("env", "edge_id", F.col("p").alias("u"), F.col("q").alias("v"), "length", F.array(at("p", "x"), at("q", "x")).alias("geometry"))


_XY = "((node_id // 1000000) % 1000)::DOUBLE || ' ' || (node_id % 1000000)::DOUBLE"


@query(f"""WITH {A.GCONV}, cm AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1), kept AS (SELECT cn.* FROM cn JOIN cm USING (conv_id) WHERE turn = lo OR turn = hi OR turn % 4 = 0),
nx AS (SELECT env, conv_id, node_id AS u, lead(node_id) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM kept)
SELECT nx.env, nx.u, nx.v, count(*) AS n_points, 'LINESTRING (' || string_agg({_XY.replace('node_id', 'cn.node_id')}, ', ' ORDER BY cn.node_id) || ')' AS geometry FROM nx JOIN cn ON cn.node_id BETWEEN nx.u AND nx.v AND cn.conv_id = nx.conv_id GROUP BY 1, 2, 3""")
def contracted_geometry(spark, d):
    """Chains with their edges' geometry in the direction of the walk; every other edge is drawn the other way round."""
    nodes, edges = _placed(spark, d)
    kept = graph.retention_nodes(edges, ["env"], nodes, F.col("turn") % 4 == 0)
    c = graph.contract_chains(edges, ["env"], kept)
    return c.select("env", "u", "v", F.size("geometry").cast("long").alias("n_points"), graph.line_wkt(F.col("geometry")).alias("geometry"))


@query(f"WITH {A.GCONV}, e AS (SELECT *, CASE WHEN edge_id % 2 = 0 THEN v ELSE u END AS p, CASE WHEN edge_id % 2 = 0 THEN u ELSE v END AS q FROM ce) SELECT p AS u, q AS v, 0::INT AS key, edge_id, 'LINESTRING (' || {_XY.replace('node_id', 'p')} || ', ' || {_XY.replace('node_id', 'q')} || ')' AS geometry FROM e")
def edge_table(spark, d):
    nodes, edges = _placed(spark, d)
    return graph.tables(nodes, edges, ["env"])[1].select("u", "v", "key", "edge_id", "geometry")


@query(f"WITH {A.GCONV} SELECT node_id AS osmid, turn, 'POINT (' || {_XY} || ')' AS geometry FROM cn")
def node_table(spark, d):
    nodes, edges = _placed(spark, d)
    return graph.tables(nodes, edges, ["env"])[0].select("osmid", "turn", "geometry")


@query(f"WITH {A.GCONV}, cm AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1) SELECT env, node_id AS node FROM cn JOIN cm USING (conv_id) WHERE NOT (turn = lo OR turn = hi OR turn % 4 = 0)")
def suppressed_nodes(spark, d):
    nodes, edges = A.gconv(spark, d)
    kept = graph.retention_nodes(edges, ["env"], nodes, F.col("turn") % 4 == 0)
    return nodes.select("env", F.col("node_id").alias("node")).join(kept, ["env", "node"], "left_anti")


@query(f"WITH {A.GCONV} SELECT node_id, 0.0::DOUBLE AS snapping_tolerance, 'canonical_zero_snap' AS policy FROM cn")
def zero_snap_copy(spark, d):
    """The canonical topology: no snapping, marked as such."""
    nodes, _ = A.gconv(spark, d)
    return topology.canonical(nodes).select("node_id", "snapping_tolerance", "policy")
