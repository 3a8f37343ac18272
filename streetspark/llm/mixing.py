"""Mixing sources to target weights by hierarchical budgeting (native).

The tree is domain > lang > source; every node has an integer weight. A node's
capacity is its tokens times ``max_epochs``. Going down the tree, a node's
budget is shared among its children in proportion to their weights; children
that cannot take their share keep their capacity and the shortage goes to
their siblings (water-filling). Because a node never gets more than its
capacity, only what no sibling can take is left to the ancestors' other
children. All of it is integer arithmetic over one row per leaf.

A leaf of ``a`` tokens and budget ``b`` takes its documents ``b div a`` times
and, of the next epoch, the prefix of a seeded order that holds at most
``b mod a`` tokens. The order is that of ``md5(seed:epoch:doc_id)``. The
prefix is found by two radix levels of 4096 buckets each: only sums per
bucket meet in a task, and only the bucket where the cut lies is looked into,
so a leaf with a third of all rows is never gathered anywhere.

Tokens are words. Nulls: a null domain, lang or source is a node of its own
of the default weight; a null text has no tokens (such documents are taken
whenever the epoch's cut is behind them); a null doc_id counts as ''.
Documents with the same doc_id stay or go together. Empty table: no rows.
Extra columns stay, clashing names included: nothing but own structs is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, stored, text_of

LEVELS = ["domain", "lang", "source"]
#: Target weights; a node that is not listed has weight 1.
WEIGHTS = {
    "domain": {"web": 5, "books": 2, "news": 2, "forum": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 3},
}
SEED = 20
RADIX = 3


def domain_of(source: Column) -> Column:
    """The domain of a source of the synthetic corpus, by its number."""
    n = F.regexp_extract(source, "^src([0-9]+)$", 1)
    n = F.when(n != "", n.cast("int"))
    return F.when(n < 5, "web").when(n < 10, "books").when(n < 15, "news").when(n >= 15, "forum").otherwise("other")


def weight_of(level: str, node: Column, weights: dict = WEIGHTS) -> Column:
    w = F.lit(None).cast("long")
    for k, v in weights.get(level, {}).items():
        w = F.coalesce(w, F.when(node == k, F.lit(v).cast("long")))
    return F.coalesce(w, F.lit(1).cast("long"))


def share(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Water-filling among siblings: ``children`` has parent, key, w, cap and the parent's ``budget``; it becomes the child's.

    Sorted by cap / w, a child is full if it cannot take its share of what the fuller ones leave.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("w")).asc(), F.col(key).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    d = lambda c: F.col(c).cast("decimal(19,0)")
    x = children.withColumn("_before", F.coalesce(F.sum(d("cap")).over(before), zero))
    x = x.withColumn("_w", F.sum(d("w")).over(after))
    full = d("cap") * F.col("_w") <= d("w") * (d("budget") - F.col("_before")).cast("decimal(19,0)")
    x = x.withColumn("_full", full)
    every = Window.partitionBy(*parent)
    used = F.coalesce(F.sum(F.when(F.col("_full"), d("cap"))).over(every), zero)
    rest = F.sum(F.when(~F.col("_full"), d("w"))).over(every)
    x = x.withColumn("_left", (d("budget") - used).cast("decimal(19,0)")).withColumn("_rest", rest.cast("decimal(19,0)"))
    part = F.expr("CAST(CAST(w AS DECIMAL(19,0)) * _left AS DECIMAL(38,0)) div _rest").cast("long")
    x = x.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(part))
    return x.drop("_before", "_w", "_full", "_left", "_rest")


def budgets(leaves: DataFrame, fraction: tuple[int, int], max_epochs: int, weights: dict = WEIGHTS) -> DataFrame:
    """Budget of each leaf; ``leaves`` has domain, lang, source, tokens. The whole budget is the fraction of all tokens."""
    t = leaves.select(*LEVELS, "tokens", (F.col("tokens") * max_epochs).alias("cap"))
    total = t.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    num, den = fraction
    root = total.select(F.expr(f"least((`all` * {num}L) div {den}L, `all` * {max_epochs}L)").alias("budget"))
    at = root
    for depth, level in enumerate(LEVELS):
        keys, parent = LEVELS[: depth + 1], LEVELS[:depth]
        nodes = t.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("w", weight_of(level, F.col(level), weights)).alias("n")
        if parent:
            on = [F.col(f"n.{c}").eqNullSafe(F.col(f"p.{c}")) for c in parent]
            x = nodes.join(at.alias("p"), on).select("n.*", "p.budget")
        else:
            x = nodes.join(F.broadcast(at), F.lit(True)).select("n.*", "budget")  # one row
        x = share(x, parent, level) if parent else share(x.withColumn("_all", F.lit(0)), ["_all"], level).drop("_all")
        at = x.select(*keys, "budget", "tokens")
    return at


def order_key(doc_id: Column, epoch: Column, seed: int = SEED) -> Column:
    ident = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), ident))


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per leaf, the last order key of the partial epoch's prefix.

    ``rows``: domain, lang, source, doc_id, tokens. ``plan``: the leaves with budget and tokens.
    Returns the leaves with ``epochs`` (full ones) and ``cut`` (null: nothing of the next epoch).
    """
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in LEVELS]
    full = F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0L END")
    part = F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0L END")
    plan = stored(plan.select(*LEVELS, "budget", "tokens", full.alias("epochs"), part.alias("part")), "mix-plan")
    keyed = rows.alias("r").join(plan.alias("p"), same("r", "p")).select(
        *[F.col(f"r.{c}").alias(c) for c in LEVELS],
        F.col("r.tokens").alias("tokens"),
        order_key(F.col("r.doc_id"), F.col("p.epochs") + 1).alias("k"),
    )
    goal = plan.select(*LEVELS, F.col("part").alias("goal"), F.lit("").alias("done"))
    for level in (1, 2):
        # goal: what the prefix may still hold beyond all keys before ``done``
        n = RADIX * level
        inside = keyed.alias("r").join(goal.alias("p"), same("r", "p")).where(F.expr("startswith(r.k, p.done)"))
        sums = inside.groupBy(*[F.col(f"r.{c}").alias(c) for c in LEVELS], F.substring("r.k", 1, n).alias("d"), F.col("p.goal").alias("goal"))
        sums = sums.agg(F.sum("r.tokens").alias("t"))
        run = Window.partitionBy(*LEVELS).orderBy("d")
        sums = sums.withColumn("c", F.sum("t").over(run))
        over = sums.where(F.col("c") > F.col("goal")).groupBy(*LEVELS).agg(F.min(F.struct("d", "c", "t", "goal")).alias("x"))
        goal = over.select(*LEVELS, (F.col("x.goal") - F.col("x.c") + F.col("x.t")).alias("goal"), F.col("x.d").alias("done"))
        goal = stored(goal, f"mix-cut{level}")
    last = keyed.alias("r").join(goal.alias("p"), same("r", "p")).where(F.expr("startswith(r.k, p.done)"))
    run = Window.partitionBy(*LEVELS).orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.select(*[F.col(f"r.{c}").alias(c) for c in LEVELS], "k", "tokens", "goal")
    last = last.withColumn("c", F.sum("tokens").over(run)).where(F.col("c") <= F.col("goal"))
    last = last.groupBy(*LEVELS).agg(F.max("k").alias("k"))
    out = plan.alias("a").join(goal.alias("b"), same("a", "b"), "left").join(last.alias("c"), same("a", "c"), "left")
    # nothing beyond the cut bucket's start: all keys before it; no cut bucket at all: the whole leaf fits (empty texts only)
    cut = F.coalesce(F.col("c.k"), F.col("b.done"), F.lit("g"))
    return out.select("a.*", F.when(F.col("a.part") >= 0, cut).alias("cut"))


def copies(rows: DataFrame, cut: DataFrame, row: str = "row") -> DataFrame:
    """``rows`` (domain, lang, source, doc_id and a struct column) with ``copies``: how often each one is taken."""
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in LEVELS]
    j = rows.alias("r").join(cut.alias("c"), same)
    extra = (order_key(F.col("r.doc_id"), F.col("c.epochs") + 1) <= F.col("c.cut")).cast("long")
    return j.select("r.*", F.col("c.tokens").alias("leaf_tokens"), F.col("c.budget").alias("leaf_budget"), (F.col("c.epochs") + extra).alias("copies"))


def mix(docs: DataFrame, fraction: tuple[int, int], max_epochs: int, weights: dict = WEIGHTS) -> DataFrame:
    """One row per document that is taken: ``row`` (its doc_id), the leaf, n_tokens, leaf_tokens, leaf_budget and copies."""
    rows = leaf_rows(docs)
    cut = stored(plan_cuts(rows, fraction, max_epochs, weights), "mix-cuts")
    return copies(rows, cut).where("copies > 0")


def leaf_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        domain_of(docs["source"]).alias("domain"),
        docs["lang"].alias("lang"),
        docs["source"].alias("source"),
        n_words_of(text_of(docs["text"])).alias("tokens"),
    )
    return stored(rows, "mix-rows")


def plan_cuts(rows: DataFrame, fraction: tuple[int, int], max_epochs: int, weights: dict) -> DataFrame:
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    return cuts(rows, budgets(leaves, fraction, max_epochs, weights))


def mixed_docs(docs: DataFrame, fraction: tuple[int, int], weights: dict = WEIGHTS) -> DataFrame:
    """The documents that are taken, with their own columns; one epoch at most, so none is repeated."""
    cut = stored(plan_cuts(leaf_rows(docs), fraction, 1, weights), "mix-cuts")
    x = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        docs["doc_id"].alias("doc_id"),
        domain_of(docs["source"]).alias("domain"),
        docs["lang"].alias("lang"),
        docs["source"].alias("source"),
    )
    return copies(x, cut).where("copies > 0").select("row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    m = mix(table(spark, sf_dir, "documents"), (3, 5), 3)
    return m.select("doc_id", "domain", "lang", "source", F.col("tokens").alias("n_tokens"), "leaf_tokens", "leaf_budget", "copies")


def _sql_weight(column: str) -> str:
    listed = WEIGHTS[column.rpartition(".")[2]]
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in listed.items()) + " ELSE 1 END"


def _sql_share(name: str, source: str, parent: str, key: str, keys: str) -> str:
    """CTEs: ``name`` has the children's budgets."""
    p = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS bef,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS ws
  FROM {source} WINDOW o AS ({p} ORDER BY cap::DOUBLE / w::DOUBLE, {key} NULLS FIRST)),
{name}_b AS (SELECT *, cap::HUGEINT * ws <= w::HUGEINT * (budget - bef) AS isfull FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(CASE WHEN isfull THEN cap END) OVER ({p}), 0)::HUGEINT AS lft,
    sum(CASE WHEN NOT isfull THEN w END) OVER ({p})::HUGEINT AS rst FROM {name}_b),
{name} AS (SELECT {keys}, tokens, CASE WHEN isfull THEN cap ELSE (w::HUGEINT * lft) // rst END AS budget FROM {name}_c)"""


def mix_sql(documents: str = "documents", num: int = 3, den: int = 5, epochs: int = 3) -> str:
    """DuckDB's form: CTEs that end with ``mixed`` (doc_id, copies and the leaf)."""
    dom = """CASE WHEN regexp_matches(source, '^src[0-9]+$') THEN CASE WHEN substr(source, 4)::INT < 5 THEN 'web'
      WHEN substr(source, 4)::INT < 10 THEN 'books' WHEN substr(source, 4)::INT < 15 THEN 'news' ELSE 'forum' END ELSE 'other' END"""
    return f"""
mr AS (SELECT doc_id, {dom} AS domain, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))::BIGINT AS tokens FROM {documents}),
leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {epochs} AS cap FROM mr GROUP BY ALL),
n1 AS (SELECT domain, sum(tokens)::HUGEINT AS tokens, sum(cap)::HUGEINT AS cap, {_sql_weight('domain')} AS w,
    (SELECT least((sum(tokens)::HUGEINT * {num}) // {den}, sum(tokens)::HUGEINT * {epochs}) FROM leaf) AS budget FROM leaf GROUP BY domain),
{_sql_share('b1', 'n1', '', 'domain', 'domain')},
n2 AS (SELECT l.domain, l.lang, sum(l.tokens)::HUGEINT AS tokens, sum(cap)::HUGEINT AS cap, any_value({_sql_weight('l.lang')}) AS w,
    any_value(b1.budget) AS budget FROM leaf l JOIN b1 ON l.domain IS NOT DISTINCT FROM b1.domain GROUP BY l.domain, l.lang),
{_sql_share('b2', 'n2', 'domain', 'lang', 'domain, lang')},
n3 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.cap, {_sql_weight('l.source')} AS w, b2.budget
    FROM leaf l JOIN b2 ON l.domain IS NOT DISTINCT FROM b2.domain AND l.lang IS NOT DISTINCT FROM b2.lang),
{_sql_share('b3', 'n3', 'domain, lang', 'source', 'domain, lang, source')},
mk AS (SELECT mr.*, b3.tokens AS leaf_tokens, b3.budget AS leaf_budget, CASE WHEN b3.tokens > 0 THEN b3.budget // b3.tokens ELSE 0 END AS epochs,
    CASE WHEN b3.tokens > 0 THEN b3.budget % b3.tokens ELSE 0 END AS part
  FROM mr JOIN b3 ON mr.domain IS NOT DISTINCT FROM b3.domain AND mr.lang IS NOT DISTINCT FROM b3.lang AND mr.source IS NOT DISTINCT FROM b3.source),
mo AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || (epochs + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, ''))) AS c FROM mk),
mixed AS (SELECT doc_id, domain, lang, source, tokens AS n_tokens, leaf_tokens::BIGINT AS leaf_tokens, leaf_budget::BIGINT AS leaf_budget,
    (epochs + CASE WHEN c <= part THEN 1 ELSE 0 END)::BIGINT AS copies FROM mo)"""


def op4_sql() -> str:
    return f"WITH {mix_sql()}\nSELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, copies FROM mixed WHERE copies > 0"
