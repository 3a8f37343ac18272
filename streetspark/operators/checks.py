"""Gates: reconciliations and assertions as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial


def lookup(decisions: DataFrame, events: DataFrame, key: str, same: list[str]) -> DataFrame:
    """``decisions`` with ``status``: matched, missing (no event has the key) or mismatch (a column of ``same`` differs)."""
    e = events.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in same])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], F.lit(False))
    j = decisions.join(e, F.col(key) == F.col("_key"), "left")
    status = F.when(F.col("_key").isNull(), "missing").when(differs, "mismatch").otherwise("matched")
    return j.select(*[F.col(c) for c in decisions.columns], status.alias("status"))


def reconcile_ids(sources: dict[str, DataFrame], key: str, same: list[str]) -> DataFrame:
    """(key, in_<source> ..., agree): every key of any source, where it is, and whether all that have it agree on ``same``."""
    rows: DataFrame | None = None
    for name, df in sources.items():
        x = df.select(F.col(key).alias(key), F.lit(name).alias("_source"), F.struct(*same).alias("_values"))
        rows = x if rows is None else rows.union(x)
    flags = [F.bool_or(F.col("_source") == name).alias(f"in_{name}") for name in sources]
    return rows.groupBy(key).agg(*flags, (F.count_distinct("_values") == 1).alias("agree"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, row as JSON) of rows that only one of two tables has, as often as they are too many; empty if the row sets are equal."""
    b = b.select(*a.columns)
    side = lambda x, y, name: x.exceptAll(y).select(F.lit(name).alias("side"), F.to_json(F.struct("*")).alias("row"))
    return side(a, b, "first").union(side(b, a, "second"))


def registered(found: DataFrame, register: DataFrame, key: str) -> DataFrame:
    """(key, reason): ids of a predicate that are not registered, and registered ones that it does not find."""
    f, r = found.select(key).distinct(), register.select(key).distinct()
    one = f.join(r, key, "left_anti").select(key, F.lit("not registered").alias("reason"))
    return one.union(r.join(f, key, "left_anti").select(key, F.lit("not found")))


def close_pairs(points: DataFrame, group: list[str], ident: str, limit: float) -> DataFrame:
    """(group, a, b, distance) of points within ``limit`` of each other, equal ones too: a guard wants none."""
    apart = spatial.distance_pairs(points, group, ident, limit)
    p = points.select(*group, "x", "y", F.col(ident).alias("a"))
    w = Window.partitionBy(*group, "x", "y").orderBy("a")
    same = p.withColumn("b", F.lead("a").over(w)).where("b IS NOT NULL").select(*group, "a", "b", F.lit(0.0).alias("distance"))
    return apart.union(same)


def contained(values: DataFrame, intervals: DataFrame, keys: list[str], v: str, low: str, high: str) -> DataFrame:
    """Rows of ``values`` with the intervals of the same keys that hold ``v`` strictly inside."""
    i = intervals.alias("i")
    on = reduce(lambda a, b: a & b, [F.col(f"v.{k}") == F.col(f"i.{k}") for k in keys])
    rest = [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return values.alias("v").join(i, on & (F.col(f"i.{low}") < F.col(f"v.{v}")) & (F.col(f"v.{v}") < F.col(f"i.{high}"))).select("v.*", *rest)


def incomplete(decisions: DataFrame, required: DataFrame, key: str, allowed: list[str], decision: str = "decision") -> DataFrame:
    """(key, reason): required ids without a decision, with more than one, or with one that is not allowed; and decisions nobody asked for."""
    n = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col(decision).isin(allowed), F.lit(False))).alias("ok"))
    j = required.select(F.col(key).alias("_r")).distinct().join(n, F.col("_r") == F.col(key), "full")
    reason = F.when(F.col("n").isNull(), "no decision").when(F.col("_r").isNull(), "not required").when(F.col("n") > 1, "more than one").when(~F.col("ok"), "not allowed")
    return j.select(F.coalesce("_r", key).alias(key), reason.alias("reason")).where("reason IS NOT NULL")


def within_tolerance(rows: DataFrame, a: str, b: str, most: float) -> DataFrame:
    """The rows where two figures differ by more than ``most``, or only one is there."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return rows.where((F.col(a).isNull() != F.col(b).isNull()) | (both & (F.abs(F.col(a) - F.col(b)) > most)))


def sort_key(c: str, null: float = -1.0) -> Column:
    """A nullable number for a deterministic order: nulls count as ``null``."""
    return F.coalesce(F.col(c), F.lit(null))
