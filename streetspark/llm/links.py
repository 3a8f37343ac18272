"""Links between the nodes of buckets, and their connected components, distributed (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_ROWS, broadcast_bounded, discard, hot_join, hot_keys, join_hot, stored, tidy

#: Keys before its own that a row has in a comparison one by one; more save pairs that are made twice, and change no result.
SEEN = 8


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id that a link names the least id it is connected with.

    Least labels go along links and are shortened by pointer jumping, round by round; each round is
    written to the shared folder, and nothing but counts comes to the driver. Ids with a great part of the links, and labels
    of a great part of the ids, are joined by broadcast. Few links are one task's, which shuffles nothing.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.union(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct()
    both = stored(both, "links")
    n = both.count()
    few = n <= FEW_ROWS
    both = both.coalesce(1) if few else both
    hot = hot_keys(both, "y", n)
    labels = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("label"))
    labels = stored(labels, "labels")
    while True:
        labels = labels.coalesce(1) if few else labels
        to = labels.select(F.col("id").alias("y"), F.col("label").alias("far"))
        near = join_hot(both, to, "y", hot).groupBy("x").agg(F.min("far").alias("m"))
        step = labels.join(near, labels["id"] == near["x"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        to = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = step.join(to, "label", "left") if few else hot_join(stored(step, "labels-near"), to, "label")
        step = step.select("id", "old", F.least("label", "further").alias("label"))
        step = stored(step, "labels")
        discard(labels)
        labels = step.select("id", "label")
        if step.where("label <> old").isEmpty():
            discard(both)
            return labels.select("id", F.col("label").alias("component"))


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def apart(b: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, side, c, main, rest) of buckets of which nodes are in different components, stored.

    ``main`` is the component with the most rows, ``rest`` the number of the other rows.
    """
    named = b.select("key", "node", "side").join(broadcast_bounded(labels.select(F.col("id").alias("node"), "component")), "node", "left")
    named = named.select("key", "node", "side", F.coalesce("component", "node").alias("c"))
    per = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    most = per.groupBy("key").agg(F.max(F.struct("m", "c")).alias("most"), F.sum("m").alias("all")).where("most.m < all")
    per_key = most.select(F.col("key").alias("k"), F.col("most.c").alias("main"), (F.col("all") - F.col("most.m")).alias("rest"))
    return stored(named.join(per_key, F.col("key") == F.col("k")).select("key", "node", "side", "c", "main", "rest"), "apart")


def one_by_one(rows: DataFrame, sketch: DataFrame, may: Callable[[str, str], Column]) -> DataFrame:
    """Pairs (a, b) of nodes outside a bucket's largest component with all others of other components, as far as ``may`` allows inside the join.

    Two nodes that share many keys meet in many buckets. A row has its node's last SEEN keys before its own, and of keys that two rows share only
    the first makes the pair: in that bucket they met as well, as any two rows of different components do.
    """
    before = Window.partitionBy("node").orderBy("key").rowsBetween(-SEEN, -1)
    x = rows.withColumn("seen", F.collect_list(F.when(F.col("side") > 1, F.col("key"))).over(before)).join(sketch, "node")
    i, j = x.where("c <> main").alias("i"), x.alias("j")
    on = (F.col("i.key") == F.col("j.key")) & (F.col("i.c") != F.col("j.c")) & ((F.col("j.c") == F.col("j.main")) | (F.col("i.node") < F.col("j.node")))
    sides = (F.col("i.side") != F.col("j.side")) | (F.col("i.side") > 1)
    first = ~F.arrays_overlap(F.col("i.seen"), F.col("j.seen"))
    return i.join(j, on & sides & may("i", "j") & first).select(*ordered(F.col("i.node"), F.col("j.node"))).distinct()


def bound_within(rows: DataFrame, budget: int, least: int) -> int:
    """The largest ``rest``, ``least`` at least, up to which buckets have no more than ``budget`` pairs to be compared one by one; ``rows`` are ``apart``."""
    per = rows.groupBy("rest").agg(F.sum("rest").alias("pairs"))  # of a bucket, each row meets as many as are in the rest
    upto = per.select("rest", F.sum("pairs").over(Window.orderBy("rest")).alias("upto"))  # sizes are few
    return max(least, upto.where(F.col("upto") <= budget).agg(F.max("rest")).first()[0] or 0)


def likely(pairs: DataFrame, sketch: DataFrame, may: Callable[[str, str], Column]) -> DataFrame:
    """The pairs (a, b) that ``may`` leaves open, asked inside a join with both sketches; stored. ``may`` sees the columns of ``sketch``."""
    x = pairs.join(sketch.withColumnRenamed("node", "node_i"), F.col("a") == F.col("node_i")).select("a", "b", F.struct(*sketch.columns[1:]).alias("i"))
    y = sketch.select(F.col("node").alias("node_j"), F.struct(*sketch.columns[1:]).alias("j"))
    return stored(x.join(y, (F.col("b") == F.col("node_j")) & may("i", "j")).select("a", "b"), "likely")


def linked_classes(
    schemes: list[Callable[[DataFrame | None], DataFrame]], sketch: DataFrame, may: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], most_apart: int,
    thin: bool = False, brief: tuple[list[str], Callable[[str, str], Column]] | None = None,
) -> DataFrame:
    """(id, component) of the nodes that link with another one; no link of a bucket is lost.

    A scheme makes (key, node, center, side), stored: the nodes of buckets with two or more, and one to compare each with. Each scheme is
    complete: linked nodes share a bucket (with different sides, or sides above 1). The first is asked for all nodes, a later, more selective
    one, for the nodes (node) of buckets that stay crowded. ``sketch`` is (node, ...), ``may(i, j)`` a
    condition on two of its rows that no link fails, ``verify`` gives the pairs (a, b) that are links, stored. ``brief``: a few
    narrow columns of ``sketch`` and a weaker condition on them, asked first. A scheme's column ``whole`` tells of which
    buckets all nodes have one center.

    First all are compared with their centers, so a large group of copies costs a link each; if ``thin``, each with the one center that it
    shares most buckets with, and the buckets that this leaves apart go on. Of a component one link a node goes into the next round.
    Unless ``thin``, buckets with at most ``most_apart`` rows outside the largest component are then compared one by one, and done, and so are
    larger ones, least first, while that makes no more than ``most_apart`` pairs for each row of all buckets. Then, as long as that leaves a fifth
    less apart, with one node outside the bucket's largest component. A node that was compared with all of its bucket leaves it. What is still apart
    is compared one by one in buckets with no more rows outside the largest component than that; the others' nodes go to the next scheme, and after the
    last one all are compared.
    """
    links: DataFrame | None = None
    done: DataFrame | None = None
    labels: DataFrame | None = None

    def compare(pairs: DataFrame, asked: bool = False) -> DataFrame:
        """Verifies pairs that were not seen before; the components anew. ``asked``: the pairs have passed ``may_quick``."""
        nonlocal links, done, labels
        pairs = pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")
        if asked and not brief:
            pairs = stored(pairs, "likely")
        else:
            pairs = likely(likely(pairs, quick, may_quick) if brief else pairs, sketch, may)
        if labels is not None and pairs.isEmpty():
            return labels
        found = verify(pairs)
        if labels is not None and found.isEmpty():
            done = pairs if done is None else done.union(pairs)
            return labels
        done = pairs if done is None else done.union(pairs)
        labels = components(found if links is None else links.union(found))
        links = labels.where("id <> component").select(*ordered(F.col("id"), F.col("component")))  # connect the same nodes
        return labels

    quick, may_quick = (sketch.select("node", *brief[0]), brief[1]) if brief else (sketch, may)
    crowded = None
    for scheme in schemes:
        b = scheme(crowded)
        tidy(b.sparkSession)  # its shuffle is as large as all keys
        near = b.where("node <> center")
        if thin:
            near = near.groupBy("node", "center").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max(F.struct("n", "center")).alias("m"))
            near = near.select("node", F.col("m.center").alias("center"))
        labels = compare(near.select(*ordered(F.col("center"), F.col("node"))).distinct())
        rows = apart(b.where("NOT whole OR node <> center") if "whole" in b.columns and not thin else b, labels)
        many = F.col("rest") > most_apart
        if not thin:
            many = F.col("rest") > bound_within(rows, most_apart * b.count(), most_apart)
            labels = compare(one_by_one(rows.where(~many), quick, may_quick), True)
            left = apart(rows.where(many), labels)
            discard(rows)
            rows = left
        n, before = rows.count(), None
        while n and (before is None or 5 * n <= 4 * before):
            center = rows.where("c <> main").groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(n)).alias("h"), "node", "c")).alias("m"))
            center = center.select(F.col("key").alias("k"), F.col("m.node").alias("center"), F.col("m.c").alias("cc"))
            center = stored(center, "centers")
            star = rows.join(center, F.col("key") == F.col("k"))
            labels = compare(star.where("c <> cc").select(*ordered(F.col("center"), F.col("node"))).distinct())
            left = apart(star.where("node <> center"), labels)
            discard(center)
            discard(rows)
            rows, before, n = left, n, left.count()
        discard(b)
        if not n:
            break
        last = scheme is schemes[-1]
        labels = compare(one_by_one(rows if last else rows.where(~many), quick, may_quick), True)
        if last or rows.where(many).isEmpty():
            discard(rows)
            break
        crowded = stored(rows.where(many).select("node").distinct(), "crowded")
        discard(rows)
    return labels
