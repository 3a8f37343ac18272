"""Whole jobs: curves and decisions to graphs, graphs to metrics, metrics to audits, and the gates of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import audit, checks, geometry, graph, morphology, topology


def network(curves: DataFrame, decisions: DataFrame, tolerance: float, keys: list[str], register: DataFrame | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(nodes, edges) of each variant: provenance, analytical (without registered anomalies), simplified, bidirectional.

    ``decisions`` are validated events (keys, event_id, a, b, t_a, t_b, x, y); ``register`` is (keys, edge_id). Violations of the
    topology, of the provenance graph or of the register are an error.
    """
    splits = graph.stored(topology.split_records(decisions, keys))
    loc, frags = topology.topology(curves, splits.select(*keys, "segment_id", "t", "x", "y"), tolerance, keys)
    frags = graph.stored(frags)
    _require(topology.violations(frags, keys), "topology")
    loc = graph.stored(topology.described(loc, frags, curves, splits, keys))
    nodes, edges, bad = graph.provenance(loc, frags.select(*keys, "fragment_id", "segment_id", "t_start", "t_end", "u", "v", "length", "geometry"), keys)
    _require(bad, "provenance")
    edges = graph.stored(edges.withColumn("geometry", F.transform("geometry", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    out = {"provenance": (nodes, edges)}
    if register is not None:
        edges, _, bad = graph.exclusions(edges.withColumn("_flag", F.lit(True)), register, keys, "_flag")
        _require(bad.where("reason <> 'flagged but not registered'"), "registered anomalies")
        edges = edges.drop("_flag")
    out["analytical"] = (nodes, edges)
    kept = graph.stored(graph.retention_nodes(edges, keys, nodes, F.col("source_type") == "validated_interior_crossing"))
    # chains join at places, not at the pieces' computed ends
    at = nodes.select(*keys, "node_id", F.struct("x", "y").alias("_p"))
    for end in ("u", "v"):
        edges = edges.join(at.select(*keys, F.col("node_id").alias(end), F.col("_p").alias(f"_{end}")), [*keys, end])
    inner = F.slice("geometry", F.lit(2), F.size("geometry") - 2)
    edges = graph.stored(edges.withColumn("geometry", F.concat(F.array("_u"), inner, F.array("_v"))).drop("_u", "_v"))
    chains = graph.stored(graph.simplified_ids(graph.contract_chains(edges, keys, kept), keys).withColumnRenamed("simplified_id", "edge_id"))
    simple = nodes.join(kept.withColumnRenamed("node", "node_id"), [*keys, "node_id"], "left_semi")
    out["simplified"] = (simple, chains)
    out["bidirectional"] = (simple, graph.bidirectional(chains))
    return out


def network_summary(variants: dict[str, tuple[DataFrame, DataFrame]], keys: list[str]) -> DataFrame:
    """(variant, keys, n_nodes, n_edges, n_components, length) of each variant.

    Without registered anomalies the analytical graph is that of provenance. Contracting chains and adding reversed edges connects and
    separates nothing, so nodes of the simplified and bidirectional graphs have the components of the analytical one.
    """
    out: DataFrame | None = None
    labels: dict[str, DataFrame] = {}
    for name, (nodes, edges) in variants.items():
        if name == "analytical" and edges is variants["provenance"][1]:
            labels[name] = labels["provenance"]
        elif name in ("simplified", "bidirectional"):
            labels[name] = labels["analytical"].join(nodes.select(*keys, F.col("node_id").alias("node")), [*keys, "node"], "left_semi")
        else:
            labels[name] = graph.components(edges, keys, nodes)
        length = edges.groupBy(*keys).agg(F.sum("length").alias("length"))
        row = graph.graph_summary(edges, keys, nodes, labels=labels[name]).join(length, keys, "left").select(F.lit(name).alias("variant"), *keys, "n_nodes", "n_edges", "n_components", "length")
        out = row if out is None else out.union(row)
    return out


def orientation(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, H_o, H_w, phi): entropies of chords and of length-weighted pieces of edges with geometry, both ways, and the order."""
    a, b = F.get("geometry", F.lit(0)), F.element_at("geometry", -1)
    chords = edges.select(*keys, E.bearing(b["x"] - a["x"], b["y"] - a["y"]).alias("bearing")).where("bearing IS NOT NULL")
    line = edges.select(*keys, F.explode(F.arrays_zip(F.slice("geometry", F.lit(1), F.size("geometry") - 1).alias("p"), F.slice("geometry", F.lit(2), F.size("geometry")).alias("q"))).alias("s"))
    dx, dy = F.col("s.q.x") - F.col("s.p.x"), F.col("s.q.y") - F.col("s.p.y")
    pieces = line.select(*keys, E.bearing(dx, dy).alias("bearing"), E.norm(dx, dy).alias("w")).where("bearing IS NOT NULL")
    h_o = morphology.orientation_entropy(morphology.both_ways(chords), keys).withColumnRenamed("entropy", "H_o")
    h_w = morphology.orientation_entropy(morphology.both_ways(pieces), keys, F.col("w")).withColumnRenamed("entropy", "H_w")
    return h_o.join(h_w, keys).withColumn("phi", morphology.orientation_order(F.col("H_o")))


def morphology_metrics(detailed: DataFrame, simplified: DataFrame, keys: list[str], most: float = 1e-12) -> DataFrame:
    """(keys, n_edges, H_o, H_w, phi, circuity) of a simplified graph; H_w from detailed geometry must agree within ``most``."""
    x = orientation(simplified, keys)
    fine = orientation(detailed, keys).select(*keys, F.col("H_w").alias("fine"))
    wrong = F.raise_error(F.lit("weighted entropies of the detailed and the simplified graph differ")).cast("double")
    x = x.join(fine, keys).withColumn("H_w", F.when(F.abs(F.col("H_w") - F.col("fine")) <= most, F.col("H_w")).otherwise(wrong)).drop("fine")
    a, b = F.get("geometry", F.lit(0)), F.element_at("geometry", -1)
    c = simplified.withColumn("distance", E.norm(b["x"] - a["x"], b["y"] - a["y"])).where("distance > 0")
    c = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"), (F.sum("length") / F.sum("distance")).alias("circuity"))
    return x.join(c, keys).select(*keys, "n_edges", "H_o", "H_w", "phi", "circuity")


def circuity_audit(edges: DataFrame, keys: list[str], ident: str, ks=(2, 5, 10)) -> DataFrame:
    """(keys, n, excess, top_k ..., over_1_05, spearman, consistent): the decomposition of circuity, its concentration and its identities."""
    x = audit.decompose(edges, keys).withColumn("c", F.col("length") / F.col("distance"))
    n = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("excess").alias("excess"))
    d = morphology.distribution(x, keys, "c").select(*keys, "over_1_05")
    s = audit.spearman(x.select(*keys, "distance", "c"), keys, "distance", "c")
    bad = audit.identity_violations(x, keys).select(*keys, F.lit(False).alias("consistent"))
    t = audit.top_shares(x, keys, "excess_share", ident, ks)
    return n.join(t, keys).join(d, keys).join(s, keys).join(bad, keys, "left").withColumn("consistent", F.coalesce("consistent", F.lit(True)))


def validation(decisions: DataFrame, events: DataFrame, required: DataFrame, points: DataFrame, group: list[str], key: str, same: list[str], allowed: list[str], limit: float) -> DataFrame:
    """(gate, n): violations of each gate of a review: decisions that are missing or not allowed, lookups that fail, ids that sources do not share, points too close."""
    gates = {
        "decisions": checks.incomplete(decisions, required, key, allowed),
        "lookup": checks.lookup(decisions, events, key, same).where("status <> 'matched'"),
        "ids": checks.reconcile_ids({"decisions": decisions, "events": events}, key, same).where("NOT (in_decisions AND in_events AND agree)"),
        "close": checks.close_pairs(points, group, key, limit),
    }
    out: DataFrame | None = None
    for name, rows in gates.items():
        row = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("gate"), "n")
        out = row if out is None else out.union(row)
    return out


def _require(bad: DataFrame, what: str) -> None:
    from ..sources.export import assert_empty

    assert_empty(bad, what)


def linework(curves: DataFrame, tolerances: list[float], keys: list[str], total: float, worst: float) -> tuple[float, DataFrame]:
    """The selected tolerance and the polylines at it."""
    from ..operators import convergence

    chosen = convergence.select(convergence.successive(convergence.sweep(curves, keys, tolerances), keys), keys, total, worst).first()["tolerance"]
    if chosen is None:
        raise ValueError("no tolerance passes")
    return chosen, geometry.selected_linework(curves, chosen, keys)
