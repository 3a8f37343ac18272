"""The driver's tables as curves, points, edges and graphs; and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg(spark, d) -> DataFrame:
    """Curves: control points are the first six dimensions of the embeddings."""
    dims = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1", "x2", "y2"))]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("segment_id"), F.col("label").alias("shape_id"), *dims)


def pt(spark, d) -> DataFrame:
    return seg(spark, d).select("shape_id", F.col("segment_id").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"))


def edge(spark, d) -> DataFrame:
    """Edges: an order's length is its price with tax, its distance that with discount; exact decimals."""
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    length = F.sum(price * (F.lit(1) + F.col("l_tax").cast("decimal(5,2)")))
    distance = F.sum(price * (F.lit(1) - F.col("l_discount").cast("decimal(5,2)")))
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(length.cast("double").alias("length"), distance.cast("double").alias("distance"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("env"))
    return e.join(o, e["l_orderkey"] == o["o_orderkey"]).select("env", F.col("l_orderkey").alias("edge_id"), "length", "distance")


def endpt(spark, d) -> DataFrame:
    """Endpoints: line items at (quantity, discount)."""
    ident = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").select(ident.alias("endpoint_id"), F.col("l_orderkey").alias("segment_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))


def traj(spark, d) -> DataFrame:
    """Polylines: a user's events, hours against values."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000.0)
    return table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("pos"), hours.alias("x"), F.col("value").alias("y"))


def gconv(spark, d) -> tuple[DataFrame, DataFrame]:
    """Path graphs: a conversation's turns; node ids are conv_id * 1000000 + turn."""
    c = table(spark, d, "conversations")
    ident = lambda t: (F.col("conv_id") * 1000000 + t).cast("long")
    nodes = c.select(F.lit(1).alias("env"), ident(F.col("turn")).alias("node_id"), "conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("length"))
    second = nodes.select((F.col("node_id") - 1).alias("u"), F.col("node_id").alias("v"), "length")
    e = nodes.select("env", F.col("node_id").alias("u0")).join(second, F.col("u0") == F.col("u")).select("env", F.col("v").alias("edge_id"), "u", "v", "length")
    return nodes, e


def gtree(spark, d) -> DataFrame:
    """A graph: customers and suppliers to nations to regions, orders to customers."""
    t = lambda n: table(spark, d, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"), ("orders", "o", "o_orderkey", "c", "o_custkey")]
    out = None
    for tab, p, k, q, f in parts:
        x = t(tab).select(F.lit(1).alias("env"), F.concat(F.lit(f"{tab}:"), F.col(k).cast("string")).alias("edge_id"), name(p, k).alias("u"), name(q, f).alias("v"))
        out = x if out is None else out.union(x)
    return out


SEG = "seg AS (SELECT vec_id AS segment_id, label AS shape_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(("x0", "y0", "x1", "y1", "x2", "y2"))) + " FROM embeddings)"
PT = SEG + ", pt AS (SELECT shape_id, segment_id AS id, x0 AS x, y0 AS y FROM seg)"
EDGE = """e0 AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(15,2) * (1 + l_tax::DECIMAL(5,2)))::DOUBLE AS length,
 sum(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(5,2)))::DOUBLE AS distance FROM lineitem GROUP BY 1),
edge AS (SELECT o_orderpriority AS env, l_orderkey AS edge_id, length, distance FROM e0 JOIN orders ON l_orderkey = o_orderkey)"""
ENDPT = "endpt AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS endpoint_id, l_orderkey AS segment_id, l_quantity AS x, l_discount AS y FROM lineitem)"
TRAJ = "traj AS (SELECT user_id, event_id, ts AS pos, epoch_us(ts) / 3600000000.0::DOUBLE AS x, value AS y FROM events)"
GCONV = """cn AS (SELECT 1 AS env, conv_id * 1000000 + turn AS node_id, conv_id, turn, length(coalesce(text, ''))::DOUBLE AS length FROM conversations),
ce AS (SELECT b.env, b.node_id AS edge_id, a.node_id AS u, b.node_id AS v, b.length FROM cn a JOIN cn b ON b.node_id = a.node_id + 1)"""
GTREE = """gt AS (SELECT 1 AS env, 'customer:' || c_custkey AS edge_id, 'c' || c_custkey AS u, 'n' || c_nationkey AS v FROM customer
 UNION ALL SELECT 1, 'supplier:' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey FROM supplier
 UNION ALL SELECT 1, 'nation:' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION ALL SELECT 1, 'orders:' || o_orderkey, 'o' || o_orderkey, 'c' || o_custkey FROM orders),
ends AS (SELECT env, edge_id, u AS node, v AS other FROM gt UNION ALL SELECT env, edge_id, v, u FROM gt),
deg AS (SELECT env, node, count(*) AS degree FROM ends GROUP BY 1, 2)"""
