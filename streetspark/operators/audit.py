"""Audits: circuity decomposition, rankings, rank correlation, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_RELATIVE = ["H_o", "H_w", "phi", "snapping"]


def decompose(edges: DataFrame, keys: list[str], length: str = "length", distance: str = "distance") -> DataFrame:
    """Excess, its share of the group's, the distance's weight and the contribution to the aggregate circuity."""
    sums = edges.groupBy(*keys).agg(F.sum(F.col(length) - F.col(distance)).alias("_e"), F.sum(distance).alias("_d"))
    x = edges.join(sums, keys)  # one row a group: joined, so that no group is gathered as a window
    positive = lambda c, what: F.when(F.col(c) > 0, F.col(c)).otherwise(F.raise_error(F.lit(what)).cast("double"))
    excess = F.col(length) - F.col(distance)
    x = x.withColumn("excess", excess)
    x = x.withColumn("excess_share", excess / positive("_e", "no excess in the group"))
    x = x.withColumn("distance_weight", F.col(distance) / positive("_d", "no distance in the group"))
    return x.withColumn("contribution", excess / positive("_d", "no distance in the group")).drop("_e", "_d")


def top(x: DataFrame, keys: list[str], by: str, tie: str, k: int) -> DataFrame:
    """The k largest of each group with ``rank``; ties by the smaller id."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col(tie).asc())
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_shares(x: DataFrame, keys: list[str], share: str, tie: str, ks=(2, 5, 10)) -> DataFrame:
    t = top(x, keys, share, tie, max(ks))
    return t.groupBy(*keys).agg(*[F.sum(F.when(F.col("rank") <= k, F.col(share))).alias(f"top_{k}") for k in ks])


def identity_violations(decomposed: DataFrame, keys: list[str], length: str = "length", distance: str = "distance", most: float = 1e-9) -> DataFrame:
    """Groups (keys, share, weight, gap) of a decomposition whose shares or weights do not add up to 1, or whose contributions not to the circuity beyond 1."""
    x = decomposed.groupBy(*keys).agg(
        F.sum("excess_share").alias("share"), F.sum("distance_weight").alias("weight"), (F.sum("contribution") - (F.sum(length) / F.sum(distance) - 1)).alias("gap")
    )
    return x.where((F.abs(F.col("share") - 1) > most) | (F.abs(F.col("weight") - 1) > most) | (F.abs("gap") > most))


def compact_ranks(ranked: DataFrame, fields: list[str]) -> DataFrame:
    """Ranked rows with a few fields, in that order."""
    return ranked.select("rank", *[f for f in fields if f != "rank"])


def sensitivity_summary(x: DataFrame, metrics: list[str], group: str, by: str, first, second) -> DataFrame:
    """(metric, least, most, mean per group value, n_first_larger): over the values of ``by``, and for how many of them the first group's is larger."""
    long = x.unpivot([group, by], metrics, "metric", "value")
    wide = long.groupBy("metric", by).pivot(group, [first, second]).agg(F.first("value"))
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    figures = [f(c).alias(f"{n}_{s}") for s, c in (("first", a), ("second", b)) for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg))]
    return wide.groupBy("metric").agg(*figures, F.count_if(a > b).alias("n_first_larger"))


def rollup_counts(events: DataFrame, first: str, second: str) -> DataFrame:
    """(first, second, n): counts in all, by the first column and by both; null stands for all."""
    return events.rollup(first, second).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")).select(first, second, F.col("_g").cast("int").alias("level"), "n")


def average_rank(x: DataFrame, keys: list[str], v: str, name: str) -> DataFrame:
    """Ranks with ties averaged. Values are counted first and dealt by ranges of (keys, value), so a group needs no window of its own."""
    from . import topology

    counts = x.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_c"))
    ranked = topology.running(counts, keys, [v], "_c", "_before")
    ranked = ranked.select(*keys, F.col(v).alias("_v"), (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(name))
    on = [x[k].eqNullSafe(ranked[k]) for k in keys] + [x[v].eqNullSafe(ranked["_v"])]
    return x.join(ranked, on).select(*[x[c] for c in x.columns], name)


def spearman(x: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    x = average_rank(average_rank(x, keys, a, "_ra"), keys, b, "_rb")
    return x.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("spearman"))


def compare(metrics: DataFrame, key: str, base, other, names: list[str]) -> DataFrame:
    """(metric, base, other, difference, relative); no relative difference for bounded metrics or a base of 0."""
    pick = lambda v: metrics.where(F.col(key) == v).unpivot([], [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
    j = pick(base).withColumnRenamed("value", "base").join(pick(other).withColumnRenamed("value", "other"), "metric")
    d = F.col("other") - F.col("base")
    relative = F.when((F.col("base") != 0) & ~F.col("metric").isin(NOT_RELATIVE), d / F.when(F.col("base") != 0, F.col("base")))
    return j.select("metric", "base", "other", d.alias("difference"), relative.alias("relative"))


def assessment(first: Column, second: Column) -> Column:
    """Whether the first is larger."""
    return F.when(F.abs(first - second) <= 1e-12, "equal").when(first > second, "supported").otherwise("not_supported")
