import math

import pytest
from pyspark.sql import functions as F

from streetspark.operators import audit, convergence, graph, morphology, spatial, topology
from streetspark.sources import export, graphml


def edges_of(spark, rows):
    return spark.createDataFrame([(1, f"e{i}", u, v, 1.0 + i) for i, (u, v) in enumerate(rows)], "env int, edge_id string, u string, v string, length double")


def nodes_of(spark, names):
    return spark.createDataFrame([(1, n) for n in names], "env int, node_id string")


def contracted(spark, rows, marked=()):
    e = edges_of(spark, rows)
    n = nodes_of(spark, sorted({x for r in rows for x in r}))
    kept = graph.retention_nodes(e, ["env"], n, F.col("node_id").isin(list(marked)) if marked else None)
    return {r[0] for r in kept.select("node").collect()}, graph.contract_chains(e, ["env"], kept).collect()


def test_chain_becomes_one_edge(spark):
    kept, c = contracted(spark, [("a", "b"), ("b", "c")])
    assert kept == {"a", "c"}
    assert [(r["u"], r["v"], r["length"], r["edge_ids"]) for r in c] == [("a", "c", 3.0, ["e0", "e1"])]


def test_marked_node_stays(spark):
    kept, c = contracted(spark, [("a", "b"), ("b", "c")], ["b"])
    assert kept == {"a", "b", "c"} and len(c) == 2


def test_parallel_edges_stay(spark):
    kept, c = contracted(spark, [("a", "b"), ("a", "b")])
    assert kept == {"a", "b"} and len(c) == 2


def test_cycle_becomes_a_loop_at_its_least_node(spark):
    kept, c = contracted(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert kept == {"a"}
    assert [(r["u"], r["v"], r["n_edges"], r["length"]) for r in c] == [("a", "a", 3, 6.0)]


def test_loop_counts_twice(spark):
    d = {r["node"]: r["degree"] for r in graph.degrees(edges_of(spark, [("a", "a"), ("a", "b")]), ["env"]).collect()}
    assert d == {"a": 3, "b": 1}


def test_star_summary_and_short_edges(spark):
    e = edges_of(spark, [("m", "a"), ("m", "b"), ("m", "c"), ("m", "d"), ("c", "t")])
    r = graph.topology_summary(e, ["env"]).collect()[0]
    assert (r["n_nodes"], r["dead_ends"], r["two_way"], r["four_way"], r["four_way_of_crossings"]) == (6, 4, 1, 1, 1.0)
    s = graph.graph_summary(e, ["env"], nodes_of(spark, ["m", "a", "b", "c", "d", "t", "lone"])).collect()[0]
    assert (s["n_nodes"], s["n_edges"], s["n_components"], s["n_loops"], s["n_parallel"]) == (7, 5, 2, 0, 0)


def test_long_path_is_one_component(spark):
    e = edges_of(spark, [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)])
    assert {r["component"] for r in graph.components(e, ["env"]).collect()} == {"000"}


def test_bidirectional_reverses(spark):
    e = spark.createDataFrame([(1, "e", "a", "b", [1, 2, 3], 0.0, 1.0)], "env int, edge_id string, u string, v string, geometry array<int>, t_start double, t_end double")
    r = {x["direction"]: x for x in graph.bidirectional(e).collect()}
    assert (r["reverse"]["u"], r["reverse"]["geometry"], r["reverse"]["t_start"]) == ("b", [3, 2, 1], 1.0)


def test_orientation(spark):
    def run(bearings, weight=None):
        b = spark.createDataFrame([(1, float(x), float(w)) for x, w in bearings], "env int, bearing double, w double")
        return morphology.orientation_entropy(b, ["env"], F.col("w") if weight else None).collect()[0]["entropy"]

    assert math.isclose(run([(b, 1) for b in (0, 90, 180, 270)]), math.log(4), rel_tol=1e-12)
    assert math.isclose(run([(10 * i, 1) for i in range(36)]), math.log(36), rel_tol=1e-12)
    assert math.isclose(run([(0, 3), (90, 1)], True), -0.75 * math.log(0.75) - 0.25 * math.log(0.25), rel_tol=1e-12)
    o = spark.createDataFrame([(math.log(4),), (math.log(36),)], "h double").select(morphology.orientation_order(F.col("h"))).collect()
    assert math.isclose(o[0][0], 1) and abs(o[1][0]) < 1e-12


def test_circuity_errors(spark):
    def run(length, distance):
        return spark.createDataFrame([(length, distance)], "l double, d double").select(morphology.edge_circuity(F.col("l"), F.col("d"))).collect()[0][0]

    assert run(3.0, 2.0) == 1.5 and run(1.0 - 1e-12, 1.0) < 1
    for bad in ((1.0, 0.0), (0.5, 1.0)):
        with pytest.raises(Exception):
            run(*bad)


def test_decomposition_and_ties(spark):
    e = spark.createDataFrame([(1, "edge_b", 3.0, 2.0), (1, "edge_a", 6.0, 4.0), (1, "edge_c", 3.0, 2.0)], "env int, edge_id string, length double, distance double")
    x = audit.decompose(e, ["env"])
    assert math.isclose(sum(r["excess_share"] for r in x.collect()), 1.0)
    assert [r["edge_id"] for r in audit.top(x, ["env"], "excess", "edge_id", 2).orderBy("rank").collect()] == ["edge_a", "edge_b"]
    s = audit.spearman(spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 4.0), (1, 2.0, 4.0), (1, 3.0, 9.0)], "env int, a double, b double"), ["env"], "a", "b").collect()[0]
    assert math.isclose(s["spearman"], 1.0)


def test_grid_joins_find_what_loops_find(spark):
    import random

    random.seed(4)
    rows = [(1, i, random.uniform(-2, 2), random.uniform(-2, 2)) for i in range(150)]
    p = spark.createDataFrame(rows, "env int, id int, x double, y double")
    got = {(r["a"], r["b"]) for r in spatial.distance_pairs(p, ["env"], "id", 0.2).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and 0 < math.hypot(a[2] - b[2], a[3] - b[3]) <= 0.2}
    assert got == want
    b = p.selectExpr("env", "id", "x AS min_x", "x + abs(y) AS max_x", "y AS min_y", "y + 0.3 AS max_y")
    r = {x["id"]: x for x in b.collect()}
    got = {(x["a"], x["b"]) for x in spatial.bbox_pairs(b, ["env"], "id").collect()}
    hit = lambda u, v: all(u[f"min_{c}"] <= v[f"max_{c}"] and v[f"min_{c}"] <= u[f"max_{c}"] for c in "xy")
    assert got == {(i, j) for i in r for j in r if i < j and hit(r[i], r[j])}


def test_exact_positions_stay_apart(spark):
    p = spark.createDataFrame([("a", "s1", 1.0, 2.0), ("b", "s2", 1.0, 2.0), ("c", "s3", 1.0 + 1e-14, 2.0)], "endpoint_id string, segment_id string, x double, y double")
    assert topology.endpoint_groups(p, []).count() == 2


def test_ambiguity(spark):
    c = spark.createDataFrame(
        [("endpoint_endpoint", "a", "b", 0.1), ("endpoint_interior", "a", "s9", 0.2), ("endpoint_endpoint", "x", "y", 0.1)], "type string, source string, target string, distance double"
    )
    assert {(r["source"], r["ambiguous"]) for r in topology.ambiguous(c, []).collect()} == {("a", True), ("x", False)}


def test_split_fold_needs_both_limits(spark):
    r = spark.sql("SELECT array(named_struct('t', 0.1D, 'x', 0D, 'y', 0D, 'ids', array('a')), named_struct('t', 0.100001D, 'x', 0D, 'y', 0D, 'ids', array('b')), named_struct('t', 0.100002D, 'x', 5D, 'y', 0D, 'ids', array('c'))) AS r")
    kept = r.select(topology.keep_apart(F.col("r"), 2e-5, 7e-8)).collect()[0][0]
    assert [x["ids"] for x in kept] == [["a", "b"], ["c"]]


def test_tolerance_selection(spark):
    c = spark.createDataFrame([(1, "arch", -1.0, 0.0, 0.0, 2.0, 1.0, 0.0)], "env int, segment_id string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")
    s = convergence.successive(convergence.sweep(c, ["env"], [0.5, 0.1, 0.01]), ["env"])
    assert convergence.select(s, ["env"], 1.0, 1.0).collect()[0][0] == 0.5
    assert convergence.select(s, ["env"], 0.0, 0.0).collect()[0][0] is None


def test_export_and_graphml(spark, tmp_path):
    import json

    point = lambda x, y, z=0.0: {"x": x, "y": y, "z": z}
    seg = lambda i, z: {"segment_index": i, "segment_id": f"s{i}", "world": {"p0": point(0.0, 0.0, z), "p1": point(1.0, 0.0), "p2": point(2.0, 0.0)}}
    doc = {"environment_id": 7, "schema_version": "1.0.0", "shape_count": 1, "segment_count": 2, "shapes": [{"shape_index": 0, "shape_id": "h", "segment_count": 2, "segments": [seg(0, 0.0), seg(1, 0.0)]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    d = export.read_exports(spark, str(tmp_path / "a.json"))
    assert export.violations(d).count() == 0 and export.segments(d).count() == 2
    doc["segment_count"], doc["shapes"][0]["segments"][1] = 3, seg(0, 1.0)
    (tmp_path / "b.json").write_text(json.dumps(doc))
    reasons = {r["reason"] for r in export.violations(export.read_exports(spark, str(tmp_path / "b.json"))).collect()}
    assert reasons == {"segment count", "not planar", "repeated segment id"}
    with pytest.raises(ValueError):
        export.gate(export.file_hashes(spark, str(tmp_path / "a.json")), {"a.json": "0"})

    e = spark.createDataFrame([("a", "b", "e<1>", 2.5, [[0.0, 1.0]], True), ("b", "b", "e2", None, [], False)], "u string, v string, edge_id string, length double, geometry array<array<double>>, flag boolean")
    n = spark.createDataFrame([("a", 1), ("b", None)], "node_id string, kind int")
    graphml.write_graphml(n, e, str(tmp_path / "g"))
    n2, e2 = graphml.read_graphml(spark, str(tmp_path / "g"))
    back = e2.withColumn("geometry", graphml.decoded("geometry", "array<array<double>>"))
    assert graphml.roundtrip_mismatches((n, e), (n2, back)).count() == 0


def test_components_and_lone_cycles_like_brute_force(spark):
    import random

    random.seed(5)
    edges = [(random.randrange(3), i, random.randrange(60), random.randrange(60)) for i in range(90)]
    edges += [(3, 100 + i, i, (i + 1) % 40) for i in range(40)] + [(4, 200 + i, i, i + 1) for i in range(70)] + [(None, 300, 1, 2)]
    nodes = sorted({(e, n) for e, _, u, v in edges for n in (u, v) if e is not None} | {(0, 99)})
    least = {x: x[1] for x in nodes}
    for _ in nodes:
        for e, _, u, v in edges:
            if e is not None:
                least[e, u] = least[e, v] = min(least[e, u], least[e, v])
    t = spark.createDataFrame(edges, "env int, edge_id long, u long, v long")
    n = spark.createDataFrame(nodes, "env int, node_id long")
    got = {(r["env"], r["node"]): r["component"] for r in graph.components(t, ["env"], n).collect()}
    assert {k: c for k, c in got.items() if k[0] is not None} == least and got[None, 1] == 1 and got[None, 2] == 2
    kept = {tuple(r) for r in graph.retention_nodes(t.where("env >= 3"), ["env"], n.where("env >= 3")).collect()}
    assert kept == {(3, 0), (4, 0), (4, 70)}


def test_a_network_is_connected_once(spark, monkeypatch, tmp_path):
    """The variants of a network share the components; they were computed for each."""
    import __spark_entry__ as entry

    calls = []
    found = graph.components
    monkeypatch.setattr(graph, "components", lambda *a, **b: (calls.append(1), found(*a, **b))[1])
    spark.createDataFrame([(i, 0) for i in range(6)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = {r["variant"]: r for r in entry.queries()["network_job"](spark, str(tmp_path)).collect()}
    assert {r["n_components"] for r in rows.values()} == {1} and rows["simplified"]["n_edges"] * 2 == rows["bidirectional"]["n_edges"]
    assert len(calls) == 2


def test_retention_connects_only_what_may_go(spark, monkeypatch):
    """Components of the whole graph were found to see which of them keep no node."""
    asked = []
    found = graph.components
    monkeypatch.setattr(graph, "components", lambda e, *a: (asked.append(e.count()), found(e, *a))[1])
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x")])
    kept = graph.retention_nodes(e, ["env"], nodes_of(spark, "abcdxyz"), F.col("node_id").isin(["b", "c"]))
    assert {r["node"] for r in kept.collect()} == {"a", "b", "c", "d", "x"}
    assert asked == [3]


def test_edges_between_kept_nodes_are_not_walked(spark, monkeypatch):
    """Every half-edge was linked and doubled, also where no node goes."""
    walked = []
    found = getattr(graph, "walked_chains", graph.contract_chains)
    monkeypatch.setattr(graph, "walked_chains", lambda e, *a: (walked.append(e.count()), found(e, *a))[1], raising=False)
    point = lambda n: (float(ord(n)), 0.0)
    rows = [(1, i, u, v, float(i), [point(u), point(v)]) for i, (u, v) in enumerate([("b", "a"), ("b", "c"), ("d", "c"), ("d", "e"), ("e", "e")], 1)]
    e = spark.createDataFrame(rows, "env int, edge_id int, u string, v string, length double, geometry array<struct<x: double, y: double>>")
    kept = lambda names: spark.createDataFrame([(1, n) for n in names], "env int, node string")
    shape = lambda x: {(r["u"], r["v"], r["n_edges"], r["length"], tuple(r["edge_ids"]), tuple(chr(int(p["x"])) for p in r["geometry"])) for r in x.collect()}
    alone = {("a", "b", 1, 1.0, (1,), ("a", "b")), ("d", "e", 1, 4.0, (4,), ("d", "e")), ("e", "e", 1, 5.0, (5,), ("e", "e"))}
    assert shape(graph.contract_chains(e, ["env"], kept("abde"))) == alone | {("b", "d", 2, 5.0, (2, 3), ("b", "c", "d"))}
    assert shape(graph.contract_chains(e, ["env"], kept("abcde"))) == alone | {("b", "c", 1, 2.0, (2,), ("b", "c")), ("c", "d", 1, 3.0, (3,), ("c", "d"))}
    assert walked == [2]
