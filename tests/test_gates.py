import numpy as np
import pytest
from pyspark.sql import functions as F

from streetspark.operators import checks, geometry, graph, intersect, spatial, topology
from streetspark.sources import graphml, tables

PARABOLA = np.array([[-1.0, 1.0], [0.0, -1.0], [1.0, 1.0]])
LINE = np.array([[-1.0, 0.25], [0.0, 0.25], [1.0, 0.25]])


def test_two_methods_find_the_same_roots():
    a, (b, rejected) = intersect.roots(PARABOLA, LINE, 1e-9), intersect.roots_by_subdivision(PARABOLA, LINE, 1e-9)
    assert [round(r["t_a"], 9) for r in a] == [0.25, 0.75] == [round(r["t_a"], 9) for r in b] and rejected == 0
    both, alone = intersect.reconcile(a, b)
    assert len(both) == 2 and not alone
    assert intersect.exact_kind(PARABOLA, LINE, a[0], []) == "interior_crossing"
    with pytest.raises(ValueError, match="too many states"):
        intersect.subdivision_seeds(PARABOLA, PARABOLA, most_states=50)


def test_parameters_of_a_point():
    c = intersect.power(PARABOLA)
    assert intersect.parameters_for_point(c, np.array([-0.5, 0.25]), 1e-9) == pytest.approx([0.25])
    assert intersect.parameters_for_point(c, np.array([-0.5, 0.3]), 1e-9) == []
    still = intersect.power(np.zeros((3, 2)))
    assert intersect.parameters_for_point(still, np.zeros(2), 0.0) == [0.0, 1.0] and intersect.parameters_for_point(still, np.ones(2), 0.1) == []


def test_roots_of_zero_chords_are_consolidated():
    loop, line = np.array([[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]), np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]])
    ends = intersect.exact_ends(loop, line)
    assert [(t, u) for t, u, _ in ends] == [(0.0, 0.0), (1.0, 0.0)]
    near = [{"t_a": 5e-4, "t_b": 4e-4, "x": 1e-4, "y": 0.0, "residual": 1e-9, "sine": 0.0}, {"t_a": 1.0, "t_b": 0.0, "x": 0.0, "y": 0.0, "residual": 0.0, "sine": 0.0}]
    assert [(r["t_a"], r["t_b"], r["x"]) for r in intersect.consolidated(near, ends)] == [(0.0, 0.0, 0.0)]


def test_ends_that_are_near_but_not_equal_stay_unresolved():
    other = PARABOLA + [2.0, 1e-9]
    r = {"x": 1.0, "y": 1.0, "sine": 0.5}
    assert intersect.exact_kind(PARABOLA, other, r, intersect.exact_ends(PARABOLA, other)) == "unresolved"
    assert intersect.exact_kind(PARABOLA, PARABOLA + [2.0, 0.0], r, intersect.exact_ends(PARABOLA, PARABOLA + [2.0, 0.0])) == "endpoint_endpoint"


def test_boxes_of_all_sizes_meet_once(spark):
    import random

    random.seed(1)
    rows = []
    for i in range(300):
        x, y, s = random.uniform(-50, 50), random.uniform(-50, 50), random.choice((0.0, 0.5, 3.0, 40.0, 5000.0) if i % 50 == 0 else (0.0, 0.5, 3.0))
        rows.append((i % 3, i, x, x + s, y, y + s * random.random()))
    boxes = spark.createDataFrame(rows, "g int, id int, min_x double, max_x double, min_y double, max_y double")
    got = sorted((r["a"], r["b"]) for r in spatial.bbox_pairs(boxes, ["g"], "id").collect())
    want = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5]]
    assert got == sorted(want)


def test_sources_are_strict(spark, tmp_path):
    at = str(tmp_path / "c")
    tables.write_csv(spark.createDataFrame([(1, "a", 2.5)], "k int, s string, v double"), at, ["s", "k"])
    assert tables.read_csv(spark, at, "s string, k int").collect() == [("a", 1)]
    with pytest.raises(Exception):  # noqa: B017
        tables.read_csv(spark, at, "s string, other int").collect()
    with pytest.raises(Exception, match="not finite"):
        tables.write_json(spark.createDataFrame([(float("nan"),)], "v double"), str(tmp_path / "j"))
    assert tables.document({"a": [1]}) == '{\n  "a": [\n    1\n  ]\n}\n'
    with pytest.raises(ValueError):
        tables.document({"a": float("nan")})


def test_graphs_that_are_not_simple(spark):
    e = spark.createDataFrame([("e1", 1, 2), ("e2", 2, 1), ("e3", 3, 3)], "edge_id string, u int, v int")
    n = spark.createDataFrame([(1,), (2,)], "node_id int")
    assert {r["reason"] for r in graph.defects(e, [], n).collect()} == {"a loop", "parallel edges", "an end that is no node"}
    with pytest.raises(ValueError, match="not a simple graph"):
        graph.require_simple(e, [], n)
    graph.require_simple(e.limit(1), [], n)


def test_a_joint_that_is_not_exact_is_an_error(spark):
    edge = lambda i, u, v, p, q: (1, i, u, v, 1.0, [p, q])
    schema = "env int, edge_id int, u int, v int, length double, geometry array<struct<x:double,y:double>>"
    nodes = spark.createDataFrame([(1, i) for i in (1, 2, 3)], "env int, node_id int")
    for gap in (0.0, 0.5):
        e = spark.createDataFrame([edge(1, 1, 2, (0.0, 0.0), (1.0, 0.0)), edge(2, 3, 2, (2.0, 0.0), (1.0 + gap, 0.0))], schema)
        kept = graph.retention_nodes(e, ["env"], nodes)
        chains = graph.contract_chains(e, ["env"], kept)
        if gap:
            with pytest.raises(Exception, match="joint is not exact"):
                chains.collect()
        else:
            (c,) = chains.collect()
            assert [p["x"] for p in c["geometry"]] == [0.0, 1.0, 2.0] and c["edge_ids"] == [1, 2]


def test_canonical_json_has_sorted_keys(spark):
    df = spark.createDataFrame([(1, ("z", [(2, 1)]))], "node_id int, o struct<b:string,a:array<struct<d:int,c:int>>>")
    x = df.select(graphml.encoded(F.col("o"), df.schema["o"].dataType)).first()[0]
    assert x == graphml.PREFIX + '{"a":[{"c":1,"d":2}],"b":"z"}'


def test_running_sums_go_across_ranges(spark):
    rows = [(i % 2, i, 1.0 * (i * 7 % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, id int, v double").repartition(6)
    got = {r["id"]: r["s"] for r in topology.running(df, ["g"], ["v", "id"], "id", "s").collect()}
    for g in (0, 1):
        total = 0
        for r in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1])):
            assert got[r[1]] == total
            total += r[1]


def test_decisions_and_ids(spark):
    d = spark.createDataFrame([(1, "yes"), (2, "maybe"), (3, "yes"), (3, "yes"), (9, None)], "id int, decision string")
    got = {(r["id"], r["reason"]) for r in checks.incomplete(d, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int"), "id", ["yes"]).collect()}
    assert got == {(2, "not allowed"), (3, "more than one"), (4, "no decision"), (9, "not required")}


def test_a_polyline_keeps_its_ends(spark):
    s = spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 2.0, 2.0, 0.0)], "segment_id int, shape string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")
    r = geometry.selected_linework(s, 0.01, ["shape"]).first()
    assert r["n_vertices"] == len(r["geometry"]) > 4 and (r["geometry"][0]["x"], r["geometry"][-1]["x"]) == (0.0, 2.0)


def test_values_of_zero_and_null_disagree_too(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(i, None if i == 26 else i % 4) for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = entry.queries()["id_reconciliation"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.sql(entry.oracle_sql()["id_reconciliation"]).fetchall())


def test_a_graph_in_several_files_is_read_whole(spark, tmp_path):
    nodes = spark.range(400).select(F.col("id").alias("node_id"), (F.col("id") / 2).alias("v"))
    edges = spark.range(399).select(F.col("id").alias("edge_id"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    at = str(tmp_path / "g")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        graphml.write_graphml(nodes, edges, at)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in (tmp_path / "g").iterdir() if f.name.startswith("part-")]) > 2
    assert set(graphml.read_keys(spark, at)) == {"n0"}
    n, e = graphml.read_graphml(spark, at)
    n, e = n.select(F.col("node_id").cast("long").alias("node_id"), "v"), e.select(*[F.col(c).cast("long").alias(c) for c in ("edge_id", "u", "v")])
    assert graphml.roundtrip_mismatches((nodes, edges), (n, e)).isEmpty() and n.count() == 400 and e.count() == 399
    (tmp_path / "bad.graphml").write_text('<graphml>\n<node id="a"/>\n<node id="b"><data key="n0">1</dat></node>\n</graphml>')
    with pytest.raises(Exception, match="MALFORMED|error while reading"):
        graphml._read(spark, str(tmp_path / "bad.graphml"), "node", "_id string").collect()


def test_batches_of_pairs_have_the_roots_of_single_pairs(spark):
    rng = np.random.default_rng(3)
    pa, pb, kind = rng.normal(size=(240, 3, 2)), rng.normal(size=(240, 3, 2)), np.arange(240) % 6
    pa[kind == 1, 1] = (pa[kind == 1, 0] + pa[kind == 1, 2]) / 2
    pb[kind == 2, 1] = (pb[kind == 2, 0] + pb[kind == 2, 2]) / 2
    pb[kind == 3, 0] = pa[kind == 3, 2]
    pa[kind == 4, 2] = pa[kind == 4, 0]
    pa[kind == 5], pb[kind == 5] = np.round(pa[kind == 5]), np.round(pb[kind == 5])
    kinds = intersect.overlap_kinds(pa, pb)
    assert kinds.tolist() == [intersect.overlap_kind(a, b) for a, b in zip(pa, pb, strict=True)]
    pa, pb = pa[kinds == None], pb[kinds == None]  # noqa: E711
    for many, one in ((intersect.roots_many, intersect.roots), (intersect.roots_by_subdivision_many, lambda a, b, r: intersect.roots_by_subdivision(a, b, r)[0])):
        got, want = many(pa, pb, 1e-9), [(i, r) for i, (a, b) in enumerate(zip(pa, pb, strict=True)) for r in one(a, b, 1e-9)]
        assert got["row"].tolist() == [i for i, _ in want] and len(want) > 100
        for c in ("t_a", "t_b", "x", "y"):
            assert got[c] == pytest.approx([r[c] for _, r in want], abs=1e-6)
    with pytest.raises(ValueError, match="too many states"):
        intersect.subdivision_seeds_many(PARABOLA[None], PARABOLA[None], most_states=50)
    halved, whole = (intersect.subdivision_seeds_many(pa, pb, at_once=n) for n in (100, 10**9))
    assert all(np.array_equal(h[:, : w.shape[1]], w, equal_nan=True) for h, w in zip(halved, whole, strict=True))


def test_pairs_of_curves_are_dealt_to_all_tasks(spark):
    rows = [(0, i, *((0.0, i, 50.0, i, 99.0, i) if i % 2 else (i, 0.0, i, 50.0, i, 99.0))) for i in map(float, range(30))]
    curves = spark.createDataFrame(rows, ["env", "segment_id", *geometry.CONTROL]).withColumn("segment_id", F.col("segment_id").cast("long"))
    found = intersect.curve_intersections(curves, ["env"], 1e-9)
    assert found.count() == 15 * 15 and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_position_with_many_segments_is_dealt_out(spark):
    """All pairs of one position were made by one task."""
    from pyspark.sql import functions as F

    from streetspark.operators import topology

    n = 200
    p = spark.createDataFrame([(i, 1.0, 2.0) for i in range(n)] + [(1000, 5.0, 5.0), (7, 5.0, 5.0)], "segment_id long, x double, y double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = topology.endpoint_pairs(p, []).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = sorted([(i, j) for i in range(n) for j in range(i + 1, n)] + [(7, 1000)])
    assert sorted((r["a"], r["b"]) for r in rows) == want
    assert len({r["task"] for r in rows if r["x"] == 1.0}) > 1


def test_blocks_of_a_position_meet_once(spark, monkeypatch):
    from streetspark.operators import topology

    p = spark.range(64).selectExpr("0D AS x", "0D AS y", "id AS segment_id")
    got = [(r["a"], r["b"]) for r in topology.endpoint_pairs(p, [], 8).collect()]
    assert sorted(got) == [(a, b) for a in range(64) for b in range(a + 1, 64)]
    monkeypatch.setattr(type(p), "where", lambda self, on: self)
    assert topology.endpoint_pairs(p, [], 8).count() < 0.75 * 64 * 64
