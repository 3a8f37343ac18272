"""Quality rules with adaptive thresholds (native).

Per document a few statistics are computed inside the row, with array
expressions only. KLL sketches of each statistic are built per
(lang, source) - they merge, so a hot source is combined on the map side -
and merged again per lang and over all rows. The upper fence of a group,
``q(hi) + spread * max(q(hi) - q(lo), least)``, replaces a fixed cutoff; ``least`` is the spread that a statistic has in groups
that have none. A group's fence is drawn towards that of its language, and this towards that of the corpus, as
if ``weight`` documents spoke for it; so a small group leans on the larger one, and no size is a limit. Documents are then joined with
their fences, which are broadcast up to a million groups, and filtered.

Nulls: a null text has no words (and so fails the base rules); null lang or
source form a group of their own. Empty table: empty result. Repeated rows
are judged one by one, ties with a fence are kept, and very long texts are like others. Extra columns pass through; ``score`` adds columns
only under names that are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, broadcast_bounded, let, stored, text_of, words_of

SYMBOLS = r"[^#*$%&|<>]+"
#: Statistics that have adaptive fences, with the least spread each is given.
FENCED = {
    "symbol_ratio": 0.017,
    "mark_ratio": 0.034,
    "mean_word": 1.2,
    "dup_line_ratio": 0.084,
    "upper_ratio": 0.067,
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that are found twice or more in the text, the first included."""

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(z: Column) -> Column:
            again = F.filter(
                z,
                lambda e, k: F.coalesce(F.get(z, k - 1)["h"] == e["h"], F.lit(False))
                | F.coalesce(F.get(z, k + 1)["h"] == e["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(again, lambda e: e["i"]))

        steps = let(
            let(pairs, positions),
            lambda p: F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(x - F.get(p, k - 1), F.lit(5)))),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - 5)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(5)]))

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))

    return let(
        F.transform(words, lambda x: F.xxhash64(x)),
        lambda h: F.when(F.size(h) < 6, F.lit(0).cast("long")).otherwise(let(windows(h), counted)),
    )


def statistics(text: Column) -> Column:
    """Struct of the base figures and of the statistics that have fences."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    def body(w: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.length(F.regexp_replace(text, SPACES, "")).cast("long")
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
            repeat_words(w).alias("n_repeat_words"),
            F.length(F.regexp_replace(text, "[^!?]+", "")).cast("long").alias("n_marks"),
            F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        )

    def more(x: Column, y: Column) -> Column:
        return F.struct(
            *[x[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")],
            y["dups"].alias("n_dup_lines"),
            ((x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])).alias("base_failed"),
            ratio(x["n_symbols"], x["n_words"]).alias("symbol_ratio"),
            ratio(x["n_marks"], x["n_words"]).alias("mark_ratio"),
            ratio(x["word_chars"], x["n_words"]).alias("mean_word"),
            ratio(y["dups"], y["n"]).alias("dup_line_ratio"),
            ratio(x["n_upper"], x["word_chars"]).alias("upper_ratio"),
        )

    counts = let(
        lines,
        lambda a: F.struct(
            F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dups")
        ),
    )
    return let(let(words_of(text), body), lambda x: let(counts, lambda y: more(x, y)))


def fences(stats: DataFrame, low: float = 0.25, high: float = 0.75, spread: float = 6.0, weight: int = 50) -> DataFrame:
    """Per (lang, source) a struct of upper fences, from KLL sketches merged per language and over all.

    ``stats`` has lang, source, base_failed and the columns of FENCED. Documents that
    failed the base rules do not shape the thresholds.
    """
    usable = stats.where(~F.col("base_failed"))
    one = usable.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(c).alias(c) for c in FENCED]
    )
    merged = [F.kll_merge_agg_double(c).alias(c) for c in FENCED]
    by_lang = one.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    total = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *merged)

    def cut(df: DataFrame, name: str) -> DataFrame:
        def fence(c: str) -> Column:
            a = F.kll_sketch_get_quantile_double(c, F.lit(low))
            b = F.kll_sketch_get_quantile_double(c, F.lit(high))
            return F.when(F.col("n") > 0, b + F.lit(spread) * F.greatest(b - a, F.lit(FENCED[c])))

        keys = [c for c in ("lang", "source") if c in df.columns]
        return df.select(*keys, F.struct(F.col("n"), *[fence(c).alias(c) for c in FENCED]).alias(name))

    def drawn(own: Column, to: Column, c: str) -> Column:
        n = F.coalesce(own["n"], F.lit(0)).cast("double")
        return (n * F.coalesce(own[c], F.lit(0.0)) + weight * to) / (n + weight)

    groups = stats.select("lang", "source").distinct()
    g, l, t = (cut(x, y).alias(y) for x, y in ((one, "g"), (by_lang, "l"), (total, "t")))
    same = lambda a, b, *k: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in k]
    joined = groups.alias("x").join(g, same("x", "g", "lang", "source"), "left")
    joined = joined.join(l, same("x", "l", "lang"), "left").join(F.broadcast(t), F.lit(True), "left")  # one row
    fence = F.struct(*[drawn(F.col("g.g"), drawn(F.col("l.l"), F.col("t.t")[c], c), c).alias(c) for c in FENCED])
    return stored(joined.select(F.col("x.lang").alias("lang"), F.col("x.source").alias("source"), fence.alias("fence")), "quality-fences")


def verdict(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``kept``: false where the base rules fail or a statistic is beyond its fence."""
    s, f = stats.alias("s"), broadcast_bounded(limits).alias("f")
    on = F.col("s.lang").eqNullSafe(F.col("f.lang")) & F.col("s.source").eqNullSafe(F.col("f.source"))
    out = F.lit(False)
    for c in FENCED:
        out = out | F.coalesce(F.col(f"s.{c}") > F.col("f.fence")[c], F.lit(False))
    return s.join(f, on, "left").select("s.*", (~F.col("base_failed") & ~out).alias("kept"))


def score(docs: DataFrame, carry: list[str], name: str = "quality") -> DataFrame:
    """``carry`` columns of ``docs``, the figures of ``statistics`` and ``kept``. Figures are stored once."""
    s = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row"),
        docs["lang"].alias("lang"),
        docs["source"].alias("source"),
        statistics(text_of(docs["text"])).alias("stat"),
    )
    s = stored(s.select("row", "lang", "source", "stat.*"), name)
    return verdict(s, fences(s))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return score(docs, docs.columns, "quality-docs").where("kept").select("row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    s = score(table(spark, sf_dir, "documents"), ["doc_id"])
    return s.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "symbol_ratio",
        "mark_ratio",
        "mean_word",
        "dup_line_ratio",
        "upper_ratio",
    )
