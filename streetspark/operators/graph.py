"""Street graphs as two tables: nodes (env, node_id) and edges (env, edge_id, u, v, length, geometry ...)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, what ``setCheckpointDir`` was given, or a folder of the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/streetspark-checkpoints").rstrip("/")


def ensure_checkpoints(df: DataFrame) -> None:
    """Uses the session's checkpoint folder; sets an own one only where none is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    A checkpoint would keep the plan's constraints, which double with every round of a loop.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


def ends(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, other, edge_id): every edge from both of its ends, a loop twice."""
    pair = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))
    return edges.select(*keys, "edge_id", F.explode(pair).alias("e")).select(*keys, "edge_id", "e.node", "e.other")


def degrees(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """(keys, node, degree); a loop counts twice. With ``nodes``, those without edges have degree 0."""
    d = ends(edges, keys).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))
    if nodes is None:
        return d
    return nodes.select(*keys, F.col("node_id").alias("node")).join(d, [*keys, "node"], "left").fillna(0, ["degree"])


def components(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """(keys, node, component): the least node that is connected.

    Every node hangs on its least smaller neighbour, pointer jumping finds the roots of these trees, and edges go on between roots
    only. So a round halves the nodes that still have edges at least, whatever the length of paths, and later rounds are small.
    """
    every = edges.select(*keys, F.explode(F.array("u", "v")).alias("node"))
    if nodes is not None:
        every = every.union(nodes.select(*keys, F.col("node_id").alias("node")))
    names = [f"_{k}" for k in keys]  # rows with a null key are not joined with others
    own = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    known = [F.col(n).isNotNull() for n in names]
    left = edges.select(*own, F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("u <> v")
    for test in known:
        left = left.where(test)
    left = stored(left.distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        up = stored(left.groupBy(*names, "hi").agg(F.min("lo").alias("root")))
        while True:
            to = up.select(*names, F.col("hi").alias("root"), F.col("root").alias("further"))
            new = stored(up.join(to, [*names, "root"], "left").select(*names, "hi", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("_moved")))
            up = new.drop("_moved")
            if new.where("_moved").isEmpty():
                break
        maps.append(up)
        for end in ("hi", "lo"):
            left = left.join(up.select(*names, F.col("hi").alias(end), F.col("root").alias(f"_{end}")), [*names, end], "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        left = stored(left.where("hi <> lo").select(*names, F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
    labels = every.distinct().withColumn("component", F.col("node"))
    for up in maps:
        on = [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)] + [F.col("component") == F.col("hi")]
        labels = labels.join(up, on, "left").select(*keys, "node", F.coalesce("root", "component").alias("component"))
    return stored(labels)


def degree_distribution(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    return degrees(edges, keys, nodes).groupBy(*keys, "degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def parallel_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, n_edges) of unordered end pairs with more than one edge, loops included."""
    x = edges.select(*keys, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return x.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n_edges")).where("n_edges > 1")


def defects(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """(keys, reason): what a simple, not empty graph must not have: loops, parallel edges, ends that are no nodes, no node at all."""
    loops = edges.where(F.col("u") == F.col("v")).select(*keys, F.lit("a loop").alias("reason"))
    out = loops.union(parallel_edges(edges, keys).where("a <> b").select(*keys, F.lit("parallel edges")))
    if nodes is not None:
        lost = ends(edges, keys).select(*keys, "node").distinct().join(nodes.select(*keys, F.col("node_id").alias("node")), [*keys, "node"], "left_anti")
        out = out.union(lost.select(*keys, F.lit("an end that is no node")))
    every = edges.select(*keys) if nodes is None else nodes.select(*keys)
    out = out.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
    if keys:
        return out
    empty = every.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no node").alias("reason"), F.lit(1).cast("long").alias("n"))
    return out.union(empty)


def require_simple(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> None:
    """An error unless the graph is simple and not empty; at most a few rows come to the driver."""
    rows = defects(edges, keys, nodes).limit(5).collect()
    if rows or (edges if nodes is None else nodes).isEmpty():
        raise ValueError(f"not a simple graph: {rows or 'no node'}")


def degree_map(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """(keys, degrees): the degree distribution as a map with string keys, in the order of degrees."""
    d = degree_distribution(edges, keys, nodes).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("degree", "n_nodes"))).alias("d"))
    return d.select(*keys, F.map_from_entries(F.transform("d", lambda x: F.struct(x["degree"].cast("string"), x["n_nodes"]))).alias("degrees"))


def incident_buckets(edges: DataFrame, keys: list[str], nodes: DataFrame) -> DataFrame:
    """Per group: nodes with one, two, three or more incident edges or none, loops, components; an edge counts once at a node."""
    e = ends(edges, keys).select(*keys, "node", "edge_id").distinct().groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"))
    x = nodes.select(*keys, F.col("node_id").alias("node")).join(e, [*keys, "node"], "left").fillna(0, ["n"])
    counts = {"one": F.col("n") == 1, "two": F.col("n") == 2, "three_or_more": F.col("n") >= 3, "none": F.col("n") == 0}
    a = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"), *[F.count_if(t).alias(f"with_{c}") for c, t in counts.items()])
    b = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("u") == F.col("v")).alias("n_loops"))
    c = components(edges, keys, nodes).groupBy(*keys).agg(F.countDistinct("component").alias("n_components"))
    return a.join(b, keys, "left").join(c, keys, "left").fillna(0, ["n_edges", "n_loops"])


def topology_summary(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """Nodes, mean degree, how many have degree 1, 2, 3, 4, 5 or more, shares of all and of those of 3 or more."""
    d = degrees(edges, keys, nodes)
    n = F.count(F.lit(1))
    of = {"dead_ends": F.col("degree") == 1, "two_way": F.col("degree") == 2, "three_way": F.col("degree") == 3, "four_way": F.col("degree") == 4, "five_or_more": F.col("degree") >= 5}
    crossings = F.count_if(F.col("degree") >= 3)
    aggs = [n.alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree")]
    for name, test in of.items():
        aggs += [F.count_if(test).alias(name), (F.count_if(test) / n).alias(f"{name}_share")]
    for name in ("three_way", "four_way", "five_or_more"):
        aggs.append(F.when(crossings > 0, F.count_if(of[name]) / F.when(crossings > 0, crossings)).otherwise(F.lit(0.0)).alias(f"{name}_of_crossings"))
    return d.groupBy(*keys).agg(*aggs)


def graph_summary(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None, flagged: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, loops, parallel pairs, components; with ``flagged``, a boolean column, also how many nodes and edges have it.

    ``labels``: ``components`` of this graph, where they are known.
    """
    if flagged:
        marks = [x.groupBy(*keys).agg(F.count_if(F.col(flagged)).alias(n)) for x, n in ((nodes, "n_flagged_nodes"), (edges, "n_flagged_edges"))]
        plain = graph_summary(edges, keys, nodes, labels=labels)
        return plain.join(marks[0], keys, "left").join(marks[1], keys, "left").fillna(0, ["n_flagged_nodes", "n_flagged_edges"])
    labels = components(edges, keys, nodes) if labels is None else labels
    c = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("component").alias("n_components"))
    e = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("u") == F.col("v")).alias("n_loops"))
    p = parallel_edges(edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_parallel"))
    return c.join(e, keys, "left").join(p, keys, "left").fillna(0, ["n_edges", "n_loops", "n_parallel"])


def incident_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, degree_before, degree_after) of nodes whose degree differs."""
    a = degrees(before, keys).withColumnRenamed("degree", "degree_before")
    b = degrees(after, keys).withColumnRenamed("degree", "degree_after")
    j = a.join(b, [*keys, "node"], "full").fillna(0, ["degree_before", "degree_after"])
    return j.where("degree_before <> degree_after")


def exclude_edges(edges: DataFrame, registered: DataFrame, keys: list[str]) -> DataFrame:
    """The edges that are not registered, by id; no length decides."""
    return edges.join(registered, [*keys, "edge_id"], "left_anti")


def exclusions(edges: DataFrame, register: DataFrame, keys: list[str], flag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept edges, excluded edges, violations) of registered anomalies (keys, edge_id); no length decides.

    Violations (keys, edge_id, reason): a registered id without an edge, with more than one, or whose edge is not flagged; a flagged edge that stays.
    """
    r = register.select(*keys, "edge_id").distinct()
    kept, gone = edges.join(r, [*keys, "edge_id"], "left_anti"), edges.join(r, [*keys, "edge_id"], "left_semi")
    n = gone.groupBy(*keys, "edge_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col(flag), F.lit(False))).alias("ok"))
    j = r.join(n, [*keys, "edge_id"], "left")
    reason = F.when(F.col("n").isNull(), "no edge").when(F.col("n") > 1, "more than one edge").when(~F.col("ok"), "not flagged")
    bad = j.select(*keys, "edge_id", reason.alias("reason")).where("reason IS NOT NULL")
    return kept, gone, bad.union(kept.where(F.coalesce(F.col(flag), F.lit(False))).select(*keys, "edge_id", F.lit("flagged but not registered")))


def provenance(locations: DataFrame, fragments: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, violations) of a topology: locations (keys, location_id, x, y ...) and fragments (keys, fragment_id, u, v, length ...).

    Other columns are provenance and stay. Violations: ends that are no location, repeated ids.
    """
    nodes = locations.withColumnRenamed("location_id", "node_id")
    edges = fragments.withColumnRenamed("fragment_id", "edge_id")
    known = nodes.select(*keys, F.col("node_id").alias("node"))
    lost = ends(edges, keys).join(known, [*keys, "node"], "left_anti").select(*keys, F.col("edge_id").cast("string").alias("id"), F.lit("an end that is no location").alias("reason"))
    twice = lambda x, c: x.groupBy(*keys, c).count().where("count > 1").select(*keys, F.col(c).cast("string").alias("id"), F.lit(f"repeated {c}"))
    return nodes, edges, lost.distinct().union(twice(nodes, "node_id")).union(twice(edges, "edge_id"))


def _number(c: Column) -> Column:
    return c.cast("string")


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), _number(x), F.lit(" "), _number(y), F.lit(")"))


def line_wkt(points: Column) -> Column:
    """WKT of an array of structs with x and y."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat(_number(p["x"]), F.lit(" "), _number(p["y"]))), ", "), F.lit(")"))


def tables(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables: (keys, osmid, x, y, geometry ...) and (keys, u, v, key, geometry ...); key counts the edges between two ends, geometry is WKT."""
    n = nodes.select(*keys, F.col("node_id").alias("osmid"), *[c for c in nodes.columns if c not in (*keys, "node_id")]).withColumn("geometry", point_wkt(F.col("x"), F.col("y")))
    w = Window.partitionBy(*keys, "u", "v").orderBy("edge_id")
    e = edges.withColumn("key", F.row_number().over(w) - 1).withColumn("geometry", line_wkt(F.col("geometry")))
    return n, e.select(*keys, "u", "v", "key", *[c for c in e.columns if c not in (*keys, "u", "v", "key")])


def retention_nodes(edges: DataFrame, keys: list[str], nodes: DataFrame, marked: Column | None = None) -> DataFrame:
    """(keys, node): nodes that contraction keeps.

    Those of a degree other than 2, with other than 2 distinct neighbours, with a loop or marked; and of
    a component without any, the least.
    """
    e = ends(edges, keys)
    s = e.groupBy(*keys, "node").agg(
        F.count(F.lit(1)).alias("degree"), F.countDistinct("other").alias("neighbours"), F.max((F.col("node") == F.col("other")).cast("int")).alias("loop")
    )
    n = nodes.select(*keys, F.col("node_id").alias("node"), (marked if marked is not None else F.lit(False)).alias("_marked"))
    x = n.join(s, [*keys, "node"], "left").fillna(0, ["degree", "neighbours", "loop"])
    x = x.withColumn("_keep", (F.col("degree") != 2) | (F.col("neighbours") != 2) | (F.col("loop") == 1) | F.col("_marked"))
    # a component without any has none of the edges that end at a kept node
    x = stored(x.select(*keys, "node", "_keep"))
    inner, kept = edges.select(*keys, "u", "v"), x.where("_keep").select(*keys, "node")
    for end in ("u", "v"):
        inner = inner.join(kept.withColumnRenamed("node", end), [*keys, end], "left_anti")
    c = components(inner, keys, x.where("NOT _keep").select(*keys, F.col("node").alias("node_id")))
    held = e.join(kept.withColumnRenamed("node", "other"), [*keys, "other"], "left_semi").select(*keys, "node").distinct().withColumn("_held", F.lit(True))
    c = c.join(held, [*keys, "node"], "left").join(x, [*keys, "node"], "left")
    alone = c.groupBy(*keys, "component").agg(F.count("_held").alias("held"), F.count("_keep").alias("known")).where("held = 0 AND known > 0").select(*keys, F.col("component").alias("node"))
    return x.where("_keep").select(*keys, "node").union(alone)


def contract_chains(edges: DataFrame, keys: list[str], retained: DataFrame) -> DataFrame:
    """(keys, u, v, n_edges, length, edge_ids): every maximal chain between retained nodes as one edge.

    If edges have a ``geometry`` (an array of x and y from u to v), so have chains: the edges' in the direction of the walk, a joint once; joints that
    are not exactly equal are an error.

    An edge between two retained nodes is a chain by itself. Of the others, half-edges are linked through the nodes that go; pointer doubling
    finds the end of each in a logarithm of rounds. A chain is walked from its smaller end (by node, then by its first edge).
    """
    shaped = "geometry" in edges.columns
    marked = edges.select(*keys, "edge_id", "u", "v", "length", *(["geometry"] if shaped else []))
    for end in ("u", "v"):
        stays = retained.select(*keys, F.col("node").alias(end)).distinct().withColumn(f"_{end}", F.lit(True))
        marked = marked.join(stays, [*keys, end], "left")
    marked = stored(marked.withColumn("_whole", F.coalesce(F.col("_u") & F.col("_v"), F.lit(False))).drop("_u", "_v"))
    back = F.col("u") > F.col("v")
    one = [F.lit(1).cast("long").alias("n_edges"), "length", F.array("edge_id").alias("edge_ids")]
    if shaped:
        one.append(F.when(back, F.reverse("geometry")).otherwise(F.col("geometry")).alias("geometry"))
    whole = marked.where("_whole").select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *one)
    edges = marked.where("NOT _whole").drop("_whole")
    summed = edges.agg(F.sum("length").alias("length")).schema["length"].dataType
    whole = whole.withColumn("length", F.col("length").cast(summed))
    return whole if edges.isEmpty() else whole.union(walked_chains(edges, keys, retained))


def walked_chains(edges: DataFrame, keys: list[str], retained: DataFrame) -> DataFrame:
    """``contract_chains`` of edges that have an end that goes."""
    pair = F.array(
        F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("dir")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), F.lit(1).alias("dir"))
    )
    half = edges.select(*keys, "edge_id", "length", F.explode(pair).alias("e")).select(*keys, "edge_id", "length", "e.*")
    kept = retained.select(*keys, F.col("node").alias("_node")).withColumn("_kept", F.lit(True))
    on = lambda c: [half[k] == kept[k] for k in keys] + [half[c] == kept["_node"]]
    half = half.join(kept, on("dst"), "left").select(*[half[c] for c in half.columns], F.coalesce("_kept", F.lit(False)).alias("stop"))
    half = stored(half)
    # the next half-edge after one that ends at a node that goes: the other one that leaves it
    leave = half.select(*keys, F.col("src").alias("dst"), F.col("edge_id").alias("next_edge"), F.col("dir").alias("next_dir"))
    step = half.where("NOT stop").join(leave, [*keys, "dst"]).where("next_edge <> edge_id").select(*keys, "edge_id", "dir", "next_edge", "next_dir")
    at = stored(half.join(step, [*keys, "edge_id", "dir"], "left").select(
        *keys, "edge_id", "dir", F.coalesce("next_edge", "edge_id").alias("p_edge"), F.coalesce("next_dir", "dir").alias("p_dir"), F.when(F.col("next_edge").isNull(), 0).otherwise(1).cast("long").alias("hops")
    ))
    while True:
        to = at.select(*keys, F.col("edge_id").alias("p_edge"), F.col("dir").alias("p_dir"), F.col("p_edge").alias("q_edge"), F.col("p_dir").alias("q_dir"), F.col("hops").alias("more"))
        new = stored(at.join(to, [*keys, "p_edge", "p_dir"]).select(
            *keys, "edge_id", "dir", F.col("q_edge").alias("p_edge"), F.col("q_dir").alias("p_dir"), (F.col("hops") + F.col("more")).alias("hops"), "more"
        ))
        at = new.drop("more")
        if new.where("more > 0").isEmpty():
            break
    # (p_edge, p_dir) is the last half-edge of the chain; its reverse is the first one of the walk back
    last = half.select(*keys, F.col("edge_id").alias("p_edge"), F.col("dir").alias("p_dir"), F.col("dst").alias("finish"))
    x = at.join(last, [*keys, "p_edge", "p_dir"]).join(half.select(*keys, "edge_id", "dir", "length"), [*keys, "edge_id", "dir"])
    # both directions of a chain are there; an edge's two half-edges tell both ends
    other = x.select(*keys, "edge_id", (1 - F.col("dir")).alias("dir"), F.col("finish").alias("start"), F.col("p_edge").alias("s_edge"), F.col("p_dir").alias("s_dir"))
    x = x.join(other, [*keys, "edge_id", "dir"])
    forward = (F.col("start") < F.col("finish")) | ((F.col("start") == F.col("finish")) & ((F.col("s_edge") < F.col("p_edge")) | ((F.col("s_edge") == F.col("p_edge")) & (F.col("dir") == 0))))
    x = x.where(forward)
    steps = [(-F.col("hops")).alias("place"), F.col("edge_id")]
    shaped = "geometry" in edges.columns
    if shaped:
        x = x.join(edges.select(*keys, "edge_id", "geometry"), [*keys, "edge_id"])
        steps.append(F.when(F.col("dir") == 0, F.col("geometry")).otherwise(F.reverse("geometry")).alias("geometry"))
    g = x.groupBy(*keys, F.col("start").alias("u"), F.col("finish").alias("v"), "s_edge", "p_edge").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct(*steps))).alias("walk")
    )
    out = [F.transform("walk", lambda w: w["edge_id"]).alias("edge_ids")]
    if shaped:
        out.append(joined(F.transform("walk", lambda w: w["geometry"])).alias("geometry"))
    return g.select(*keys, "u", "v", "n_edges", "length", *out)


def joined(parts: Column) -> Column:
    """One polyline of several, each of which begins where the last one ends."""
    wrong = F.raise_error(F.lit("a chain's joint is not exact")).cast("boolean")

    def add(line: Column, part: Column) -> Column:
        a, b = F.element_at(line, -1), F.get(part, F.lit(0))
        exact = F.when((a["x"] == b["x"]) & (a["y"] == b["y"]), F.lit(True)).otherwise(wrong)
        return F.when(exact, F.concat(line, F.slice(part, F.lit(2), F.size(part))))

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.get(parts, F.lit(0)), add)


def bidirectional(edges: DataFrame) -> DataFrame:
    """Every edge forward and reversed, with ``direction``; a column ``geometry`` (an array) is reversed, t_start and t_end too."""

    def side(name: str) -> DataFrame:
        back = name == "reverse"
        out = []
        for c in edges.columns:
            v = F.col(c)
            if back:
                v = F.col({"u": "v", "v": "u", "t_start": "t_end", "t_end": "t_start"}.get(c, c))
                if c == "geometry":
                    v = F.reverse(v)
            out.append(v.alias(c))
        return edges.select(*out, F.lit(name).alias("direction"))

    return side("forward").union(side("reverse"))


def simplified_ids(chains: DataFrame, keys: list[str]) -> DataFrame:
    """Deterministic numbers: by end nodes, then by the first edge."""
    w = Window.partitionBy(*keys).orderBy("u", "v", F.get("edge_ids", F.lit(0)))
    return chains.withColumn("simplified_id", F.row_number().over(w))
