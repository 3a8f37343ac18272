"""Endpoints, locations, splits, near misses and snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import geometry, intersect, spatial


def endpoints(curves: DataFrame) -> DataFrame:
    """Two rows a curve: endpoint_id ``<segment>:<p0|p2>``, side, x, y; other columns stay."""
    rest = [c for c in curves.columns if c not in geometry.CONTROL]
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for s, i in (("p0", 0), ("p2", 2))])
    x = curves.select(*rest, F.explode(sides).alias("e")).select(*rest, "e.*")
    return x.withColumn("endpoint_id", F.concat_ws(":", F.col("segment_id").cast("string"), "side"))


def endpoint_groups(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, n, n_segments, least) by exact coordinates; ``least`` is the smallest endpoint id."""
    return points.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("segment_id").alias("n_segments"), F.min("endpoint_id").alias("least"))


def endpoint_audit(points: DataFrame, keys: list[str]) -> DataFrame:
    g = endpoint_groups(points, keys)
    return g.groupBy(*keys).agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("positions"), F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") > 1).alias("multiple"), F.count_if(F.col("n_segments") > 1).alias("shared"), F.max("n").alias("most"),
    )


def endpoint_frequencies(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, positions): how many positions have so many endpoints."""
    return endpoint_groups(points, keys).groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("positions"))


def end_position_pairs(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: distinct pairs of end positions of curves, with direction and without."""
    p, q = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    pairs = curves.select(*keys, F.struct(p, q).alias("d"), F.struct(F.least(p, q), F.greatest(p, q)).alias("u"))
    return pairs.groupBy(*keys).agg(F.count_distinct("d").alias("directed"), F.count_distinct("u").alias("undirected"))


def location_ids(points: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(keys, x, y, ids): the sorted distinct ids at each exact position."""
    return points.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_set(ident)).alias("ids"))


#: Segments of one position are dealt into so many blocks.
BLOCKS = 16


def endpoint_pairs(points: DataFrame, keys: list[str], blocks: int = BLOCKS) -> DataFrame:
    """(keys, x, y, a, b): pairs of distinct segments that share an exact position; a < b.

    A position with many segments would be one task's, so its segments are dealt into blocks and each two blocks meet once, in a task of their own.
    """
    p = points.select(*keys, "x", "y", "segment_id").distinct().withColumn("_k", F.pmod(F.xxhash64("segment_id"), F.lit(blocks)).cast("int"))
    a = p.select(*keys, "x", "y", F.col("segment_id").alias("s"), F.col("_k").alias("_ka"), F.explode(F.sequence("_k", F.lit(blocks - 1))).alias("_kb"))
    b = p.select(*keys, "x", "y", F.col("segment_id").alias("t"), F.explode(F.sequence(F.lit(0), "_k")).alias("_ka"), F.col("_k").alias("_kb"))
    pairs = a.join(b, [*keys, "x", "y", "_ka", "_kb"]).where("_ka < _kb OR s < t")
    return pairs.select(*keys, "x", "y", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))


def running(x: DataFrame, keys: list[str], order: list, weight: str, name: str) -> DataFrame:
    """``x`` with the sum of ``weight`` over the rows of its group that are before it in the order.

    Groups are few and may be large, so rows are dealt by ranges of (keys, order); a row's sum is that inside its range and the
    totals of its group in the ranges before.
    """
    from .graph import ensure_checkpoints

    own = [F.col(c) if isinstance(c, str) else c for c in order]
    y = x.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(own)])
    by = [f"_o{i}" for i in range(len(own))]
    ensure_checkpoints(x)
    # ranges are sampled: they must not be drawn anew
    y = y.repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id()).checkpoint()
    n = y.groupBy(*keys, "_range").agg(F.sum(weight).alias("_n"))  # a row a range and group
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = n.withColumn("_e", F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).drop("_n")
    inside = F.sum(weight).over(Window.partitionBy("_range", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    y = y.withColumn("_i", F.coalesce(inside, F.lit(0))).join(F.broadcast(earlier), [*keys, "_range"])
    return y.select(*x.columns, (F.col("_i") + F.col("_e")).alias(name))


def numbered(x: DataFrame, keys: list[str], order: list, name: str, prefix: str, digits: int = 4) -> DataFrame:
    """Deterministic ids, from 1 in the order given."""
    y = running(x.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", "_before")
    return y.select(*x.columns, F.format_string(f"{prefix}%0{digits}d", F.col("_before") + 1).alias(name))


def locations(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct positions, numbered by x, then y."""
    return numbered(points.select(*keys, "x", "y").distinct(), keys, ["x", "y"], "location_id", "L")


def keep_apart(records: Column, parameter: float, distance: float) -> Column:
    """Fold over (t, x, y, ids) sorted by t: one within both limits of the last kept joins it, its ids too."""
    empty = F.slice(records, 1, 0)

    def step(kept: Column, r: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        near = (r["t"] - last["t"] <= parameter) & (E.norm(r["x"] - last["x"], r["y"] - last["y"]) <= distance)
        joined = F.struct(last["t"].alias("t"), last["x"].alias("x"), last["y"].alias("y"), F.array_union(last["ids"], r["ids"]).alias("ids"))
        return F.when(F.coalesce(near, F.lit(False)), F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), joined)).otherwise(F.array_append(kept, r))

    return F.when(F.size(records) > 0, F.aggregate(F.array_sort(records), empty, step)).otherwise(empty)


def split_records(decisions: DataFrame, keys: list[str], parameter: float = 2e-5, distance: float = 7e-8) -> DataFrame:
    """(keys, segment_id, t, x, y, ids): where validated events (keys, event_id, a, b, t_a, t_b, x, y) split each of their two curves.

    On a curve an event within both limits of the last kept one joins it.
    """
    side = lambda s: F.struct(F.col(s).alias("segment_id"), F.col(f"t_{s}").alias("t"))
    x = decisions.select(*keys, "event_id", "x", "y", F.explode(F.array(side("a"), side("b"))).alias("s"))
    one = F.struct(F.col("s.t").alias("t"), "x", "y", F.array("event_id").alias("ids"))
    x = x.groupBy(*keys, F.col("s.segment_id").alias("segment_id")).agg(F.collect_list(one).alias("r"))
    return x.select(*keys, "segment_id", F.explode(keep_apart(F.col("r"), parameter, distance)).alias("k")).select(*keys, "segment_id", "k.*")


def described(locations_: DataFrame, frags: DataFrame, curves: DataFrame, crossings: DataFrame, keys: list[str]) -> DataFrame:
    """``locations_`` with ``source_type``, ``incident`` (sorted fragment ids), ``n_ends``, ``segments`` and ``role``.

    ``crossings`` (keys, segment_id, t, x, y) are the splits. The source is authored_exact_endpoint, validated_interior_crossing or
    multiple_sources; the role tells validated junctions, dead ends (or loops), continuations and branches.
    """
    at = lambda x, name: x.select(*keys, "x", "y").distinct().withColumn(name, F.lit(True))
    loc = locations_.join(at(endpoints(curves), "_e"), [*keys, "x", "y"], "left").join(at(crossings, "_c"), [*keys, "x", "y"], "left")
    ends = frags.select(*keys, "fragment_id", "segment_id", F.explode(F.array("u", "v")).alias("location_id"))
    g = ends.groupBy(*keys, "location_id").agg(
        F.array_sort(F.collect_set("fragment_id")).alias("incident"), F.count(F.lit(1)).alias("n_ends"), F.array_sort(F.collect_set("segment_id")).alias("segments")
    )
    x = loc.join(g, [*keys, "location_id"], "left").withColumn("n_ends", F.coalesce("n_ends", F.lit(0).cast("long")))
    source = F.when(F.col("_e") & F.col("_c"), "multiple_sources").when(F.col("_c"), "validated_interior_crossing").otherwise("authored_exact_endpoint")
    n = F.coalesce(F.size("incident"), F.lit(0))
    role = F.when(F.col("_c"), "validated_interior_junction").when(n <= 1, "dead_end_or_self_loop").when(n == 2, "continuation").otherwise("authored_branch")
    return x.select(*[F.col(c) for c in locations_.columns], source.alias("source_type"), "incident", "n_ends", "segments", role.alias("role"))


def sensitivity(locations_: DataFrame, frags: DataFrame, candidates: DataFrame, keys: list[str], tolerances: list[float]) -> DataFrame:
    """Per tolerance (0 gives the exact topology): eligible, ambiguous, applied, and the provisional numbers of locations, fragments and components.

    ``candidates``: (keys, candidate_id, type, source, target, distance, first, second): source and target are location ids; for an endpoint inside
    a fragment, target names the place, first and second are that fragment's ends. A merge of two endpoints makes two locations one; an
    endpoint inside a fragment splits it, once a place, and joins its component.
    """
    from . import graph

    levels = locations_.sparkSession.createDataFrame([(float(t),) for t in tolerances], "tolerance double")  # a parameter list
    k = [*keys, "tolerance"]
    c = candidates.join(F.broadcast(levels), F.col("distance") <= F.col("tolerance"))
    c = ambiguous(c, k)
    inside = F.col("type") == "endpoint_interior"
    counts = c.groupBy(*k).agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("ambiguous")).alias("ambiguous"), F.count_if(~F.col("ambiguous")).alias("applied"), F.max("distance").alias("largest"))
    applied = c.where(~F.col("ambiguous"))
    splits = applied.where(inside).groupBy(*k).agg(F.count_distinct("target").alias("splits"))
    merges = applied.where(~inside).select(*k, F.col("candidate_id").cast("string").alias("edge_id"), F.col("source").alias("u"), F.col("target").alias("v"))
    joins = applied.where(inside)
    joins = joins.select(*k, F.concat(F.col("candidate_id").cast("string"), F.lit(":1")).alias("edge_id"), F.col("source").alias("u"), F.col("first").alias("v")).union(
        joins.select(*k, F.concat(F.col("candidate_id").cast("string"), F.lit(":2")), "source", "second")
    )
    nodes = locations_.select(*keys, F.col("location_id").alias("node_id")).crossJoin(F.broadcast(levels)).select(*k, "node_id")
    edges = frags.select(*keys, F.col("fragment_id").alias("edge_id"), "u", "v").crossJoin(F.broadcast(levels)).select(*k, "edge_id", "u", "v")
    sets = lambda e, name: graph.components(e, k, nodes).groupBy(*k).agg(F.count_distinct("component").alias(name))
    x = sets(merges, "locations").join(sets(edges.union(merges).union(joins), "components"), k)
    n = frags.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else frags.agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, keys, "left") if keys else x.crossJoin(F.broadcast(n))  # one row
    x = x.join(counts, k, "left").join(splits, k, "left").fillna(0)
    return x.select(*k, "eligible", "ambiguous", "applied", "largest", "locations", (F.col("_n") + F.col("splits")).alias("fragments"), "components")


def fragments(curves: DataFrame, crossings: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """Curves split at their crossings (keys, segment_id, t): pieces with adaptive geometry, length and id.

    Curves are few beside their pieces, so they are dealt to all tasks; pieces are written before they are numbered, which reads them twice.
    """
    from .graph import stored

    ts = crossings.groupBy(*keys, "segment_id").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    n = int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = curves.repartition(n, *keys, "segment_id").join(ts, [*keys, "segment_id"], "left").withColumn("ts", F.coalesce("ts", F.array().cast("array<double>")))
    x = geometry.split_at_many(x, F.col("ts")).drop("ts")
    y = stored(geometry.adaptive_polylines(x, tolerance)).withColumn("length", geometry.array_length(F.col("geometry")))
    return numbered(y, keys, ["segment_id", "piece"], "fragment_id", "F", 5)


def topology(curves: DataFrame, crossings: DataFrame, tolerance: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(locations, fragments with start and end location).

    Locations are the exact positions of endpoints and of ``crossings`` (keys, segment_id, t, x, y); a fragment's ends are the
    location of its curve's end, or of the crossing where it was split.
    """
    at = endpoints(curves).select(*keys, "x", "y").union(crossings.select(*keys, "x", "y")).distinct()
    loc = numbered(at, keys, ["x", "y"], "location_id", "L")
    f = fragments(curves, crossings, tolerance, keys)
    cut = crossings.groupBy(*keys, "segment_id", "t").agg(F.min("x").alias("cx"), F.min("y").alias("cy"))
    for end, i, t in (("u", 0, "t_start"), ("v", 2, "t_end")):
        c = cut.withColumnRenamed("t", t)
        f = f.join(c, [*keys, "segment_id", t], "left")
        f = f.withColumn("x", F.coalesce("cx", f"x{i}")).withColumn("y", F.coalesce("cy", f"y{i}")).drop("cx", "cy")
        f = f.join(loc, [*keys, "x", "y"], "left").withColumnRenamed("location_id", end).drop("x", "y")
    return loc, f


def canonical(x: DataFrame) -> DataFrame:
    """Locations or fragments marked as the canonical topology, in which nothing is snapped."""
    return x.withColumn("snapping_tolerance", F.lit(0.0)).withColumn("policy", F.lit("canonical_zero_snap"))


def violations(frags: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that break the topology: gaps between pieces, missing ends, lengths that are not finite."""
    w = Window.partitionBy(*keys, "segment_id").orderBy("piece")
    x = frags.withColumn("_before", F.lag("t_end").over(w)).withColumn("_last", F.lead("piece").over(w).isNull())
    reason = (
        F.when(F.coalesce("_before", F.lit(0.0)) != F.col("t_start"), "gap before the piece")
        .when(F.col("_last") & (F.col("t_end") != 1.0), "the curve is not covered")
        .when(F.col("u").isNull() | F.col("v").isNull(), "an end without location")
        .when(F.isnan("length") | (F.col("length") <= 0), "no length")
    )
    return x.withColumn("reason", reason).where("reason IS NOT NULL").drop("_before", "_last")


def audited(misses: DataFrame, keys: list[str], tolerances: list[float]) -> DataFrame:
    """Near misses with ``candidate_id`` (by distance, then type, source, target), the first tolerance that takes them in and ``ambiguous``."""
    x = ambiguous(misses, keys).withColumn("first_tolerance", spatial.first_tolerance(F.col("distance"), tolerances))
    return numbered(x, keys, ["distance", "type", "source", "target"], "candidate_id", "candidate_")


def near_misses(curves: DataFrame, most: float, keys: list[str]) -> DataFrame:
    """(keys, type, source, target, t, distance): endpoint positions close to another one or to the inside of a curve that does not end there."""
    g = endpoint_groups(endpoints(curves), keys).withColumnRenamed("least", "id")
    pairs = spatial.distance_pairs(g.select(*keys, "id", "x", "y"), keys, "id", most)
    one = pairs.select(*keys, F.lit("endpoint_endpoint").alias("type"), F.col("a").alias("source"), F.col("b").alias("target"), F.lit(None).cast("double").alias("t"), "distance")
    boxes = geometry.with_bounds(curves)
    size = spatial.typical_extent(boxes)
    for c in E.AXES:
        boxes = boxes.withColumn(f"min_{c}", F.col(f"min_{c}") - most).withColumn(f"max_{c}", F.col(f"max_{c}") + most)
    points = g.select(*keys, F.col("id").alias("source"), F.col("x").alias("px"), F.col("y").alias("py"))
    j = spatial.point_box_pairs(points, boxes, keys, size + 2 * most)
    apart = F.lit(True)
    for i in (0, 2):
        apart = apart & ~((F.col("px") == F.col(f"x{i}")) & (F.col("py") == F.col(f"y{i}")))
    near = intersect.nearest(j.where(apart), [*keys, "source", "segment_id"])
    two = near.where((F.col("distance") > 0) & (F.col("distance") <= most) & (F.col("t") > 0) & (F.col("t") < 1))
    return one.union(two.select(*keys, F.lit("endpoint_interior"), "source", F.col("segment_id").cast("string"), "t", "distance"))


def ambiguous(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with ``ambiguous``: one of their endpoints has more than one target, or targets of two types.

    A cluster of three or more positions has a member with two targets in every link, so it is found too.
    """
    c = candidates
    sides = c.select(*keys, F.col("source").alias("end"), F.concat_ws("|", "type", "target").alias("to"))
    back = c.where("type = 'endpoint_endpoint'").select(*keys, F.col("target").alias("end"), F.concat_ws("|", "type", "source").alias("to"))
    many = sides.union(back).groupBy(*keys, "end").agg(F.countDistinct("to").alias("n")).where("n > 1")
    a = many.select(*keys, F.col("end").alias("source"), F.lit(True).alias("_a"))
    b = many.select(*keys, F.lit("endpoint_endpoint").alias("type"), F.col("end").alias("target"), F.lit(True).alias("_b"))
    x = c.join(a, [*keys, "source"], "left").join(b, [*keys, "type", "target"], "left")
    return x.withColumn("ambiguous", F.coalesce("_a", "_b", F.lit(False))).drop("_a", "_b")


def snapping_sensitivity(candidates: DataFrame, keys: list[str], tolerances: list[float]) -> DataFrame:
    """Per tolerance: eligible, ambiguous (anew at each), applied candidates and affected endpoints."""
    c = candidates.withColumn("tolerance", F.explode(F.array(*map(F.lit, tolerances)))).where(F.col("distance") <= F.col("tolerance"))
    x = ambiguous(c, [*keys, "tolerance"])
    applied = ~F.col("ambiguous")
    ends = F.when(F.col("type") == "endpoint_endpoint", 2).otherwise(1)
    return x.groupBy(*keys, "tolerance").agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("ambiguous")).alias("ambiguous"), F.count_if(applied).alias("applied"),
        F.sum(F.when(applied, ends).otherwise(0)).cast("long").alias("affected"),
    )
