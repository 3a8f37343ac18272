"""Document fingerprints: a Merkle tree over sections, paragraphs and words (native).

A text is cut, without losing a character, into sections (ending with a blank
line) and paragraphs (ending with a newline). A paragraph's hash is the SHA-256 of its bytes, a
section's that of its paragraphs' hashes, the root's that of the sections'; a paragraph's leaves are its words.
Equal texts have equal roots; where roots differ, only differing branches
have to be entered to locate an edit (``differing_branches``).

The fingerprint string is ``root:paragraphs:leaves``: 8 hexadecimal digits a paragraph, sections parted by
dots, and 8 a distinct leaf; of words of more than LONG_WORD characters, a run without spaces, every
substring of GRAM characters is a leaf. It grows with the text because it is the whole tree, which locating edits needs; the root
alone tests equality. The likeness of two fingerprints is 1 if the roots are equal, else
the Dice coefficient of their trees' distinct leaves, at every size: what lies under equal nodes counts as equal.

Nulls: a null text is the empty text, a null doc_id sorts first. Rows with the same
doc_id follow each other by the hash of their texts, repeated rows in any order. Very long texts are one tree like others. Empty table: empty
result; a single document is its own successor. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, text_of, words_of

LONG_WORD = 32
GRAM = 8
#: Documents a bucket of the doc_id order has on average.
BUCKET_ROWS = 256
#: Ids are cut at so many of their quantiles.
QUANTILES = 1024


def _short(x: Column) -> Column:
    return F.right(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), F.lit(8))


def _pieces(word: Column) -> Column:
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - GRAM + 1), lambda i: _short(F.array_join(F.slice(c, i, GRAM), "")))
    return F.when(F.length(word) <= LONG_WORD, F.array(_short(word))).otherwise(let(F.split(word, ""), grams))


def paragraphs_of(section: Column) -> Column:
    return F.array_remove(F.split(section, r"(?<=\n)"), "")


def sections_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?<=\n\n)"), "")


def leaves_of(paragraph: Column) -> Column:
    return F.flatten(F.transform(words_of(paragraph), _pieces))


def tree(text: Column) -> Column:
    """Struct of root and sections; a section has its hash and its paragraphs, a paragraph its hash and its leaves."""

    def section(s: Column) -> Column:
        paragraphs = F.transform(paragraphs_of(s), lambda p: F.struct(F.sha2(p, 256).alias("hash"), leaves_of(p).alias("leaves")))
        joined = lambda x: F.sha2(F.array_join(F.transform(x, lambda p: p["hash"]), ""), 256)
        return let(paragraphs, lambda x: F.struct(joined(x).alias("hash"), x.alias("paragraphs")))

    def rooted(s: Column) -> Column:
        return F.struct(F.sha2(F.array_join(F.transform(s, lambda x: x["hash"]), ""), 256).alias("root"), s.alias("sections"))

    return let(F.transform(sections_of(text), section), rooted)


def _differ(x: Column, y: Column, of) -> Column:
    """Places, from 0, where two arrays differ by ``of`` their elements."""
    n = F.greatest(F.coalesce(F.size(x), F.lit(0)), F.coalesce(F.size(y), F.lit(0)))
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ~of(F.get(x, i)).eqNullSafe(of(F.get(y, i))))


def differing_branches(a: Column, b: Column) -> Column:
    """Array of (section, paragraph, leaf), from 0: where tree b differs from tree a, with the first leaf that does.

    Paragraphs are compared only of sections whose hashes differ, and leaves only of such paragraphs.
    """

    def inside(i: Column) -> Column:
        x, y = F.get(a["sections"], i)["paragraphs"], F.get(b["sections"], i)["paragraphs"]

        def leaf(j: Column) -> Column:
            at = _differ(F.get(x, j)["leaves"], F.get(y, j)["leaves"], lambda v: v)
            return F.struct(i.alias("section"), j.alias("paragraph"), F.coalesce(F.get(at, F.lit(0)), F.lit(0)).alias("leaf"))

        return F.transform(_differ(x, y, lambda p: p["hash"]), leaf)

    return F.flatten(F.transform(_differ(a["sections"], b["sections"], lambda s: s["hash"]), inside))


def fingerprint(text: Column) -> Column:
    """Struct of root, paragraphs (short hashes, an array a section) and leaves (distinct ones, in order)."""
    paragraphs = lambda t: F.transform(t["sections"], lambda s: F.transform(s["paragraphs"], lambda p: F.left(p["hash"], F.lit(8))))
    leaves = lambda t: F.array_distinct(F.flatten(F.transform(t["sections"], lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"])))))
    return let(tree(text), lambda t: F.struct(t["root"].alias("root"), paragraphs(t).alias("paragraphs"), leaves(t).alias("leaves")))


def as_string(fp: Column) -> Column:
    paragraphs = F.array_join(F.transform(fp["paragraphs"], lambda p: F.array_join(p, "")), ".")
    return F.concat_ws(":", fp["root"], paragraphs, F.array_join(fp["leaves"], ""))


def likeness(a: Column, b: Column) -> Column:
    n = F.size(a["leaves"]) + F.size(b["leaves"])
    dice = F.when(n > 0, 2.0 * F.size(F.array_intersect(a["leaves"], b["leaves"])) / n).otherwise(F.lit(0.0))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(dice)


def bucket_of(x: DataFrame) -> Column:
    """The bucket of a row (doc_id, h): a number that grows with (doc_id, h), about BUCKET_ROWS rows each.

    Ids are cut at QUANTILES of them, and evenly in between; so a far-off id costs one QUANTILES-th of the rows a bucket at worst. An id that
    many rows share, or null, is cut by their hashes.
    """
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    r = x.agg(F.percentile_approx("doc_id", at, 20 * QUANTILES).alias("q"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("given")).first()
    q, n, given = r["q"] or [0, 0], r["n"], r["given"]
    parts = max(1, -(-given // (QUANTILES * BUCKET_ROWS)))
    cuts = F.split(F.lit(",".join(map(str, q))), ",").cast("array<bigint>")  # folded into a constant

    def places_below(inclusive: bool) -> Column:
        """How many cuts are less than the id (or equal), by bisection."""
        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            cut = F.get(cuts, mid)
            right = (cut <= F.col("doc_id")) if inclusive else (cut < F.col("doc_id"))
            go = s["lo"] < s["hi"]
            return F.struct(F.when(go & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~right, mid).otherwise(s["hi"]).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(q)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(q).bit_length())), start, step, lambda s: s["lo"])

    share = F.col("h") / F.lit(float(2**64)) + 0.5
    below, upto = places_below(False), places_below(True)
    left, right = F.get(cuts, upto - 1).cast("double"), F.get(cuts, upto).cast("double")
    between = F.when(right > left, (F.col("doc_id") - left) / F.when(right > left, right - left)).otherwise(F.lit(0.0))
    many = upto - below > 1
    place = F.when(many, below + share * (upto - below - 1)).otherwise(upto - 1 + F.least(F.coalesce(between, F.lit(0.0)), F.lit(1 - 1e-9)))
    null_parts = max(1, -(-(n - given) // BUCKET_ROWS))
    return F.when(F.col("doc_id").isNull(), F.floor(share * null_parts) - null_parts - 1).otherwise(F.floor(F.greatest(place, F.lit(0.0)) * parts)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each text with the text of the next document by doc_id, the last with the first's.

    Texts are shuffled once, by bucket of the order. Only
    the first document of a bucket is looked up from another one, and buckets are put in order by
    buckets of buckets, so no task sees the whole order.
    """
    # order keys: nulls first, then the id, then the text's hash
    x = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text"))
    x = x.withColumn("h", F.xxhash64("text"))
    x = x.withColumn("bucket", bucket_of(x))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    firsts = x.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "h")).alias("f"))
    firsts = stored(firsts.select("bucket", F.col("f.doc_id").alias("o"), F.col("f.h").alias("fh")), "order-firsts")
    after = stored(_next_bucket(firsts.select("bucket")), "order-next")
    f = firsts.withColumnRenamed("bucket", "fb")
    heads = x.join(f, (x["bucket"] == f["fb"]) & (x["h"] == f["fh"]) & x["doc_id"].eqNullSafe(f["o"]), "left_semi")
    heads = heads.groupBy("bucket").agg(F.first("text").alias("head"))
    heads = heads.join(after.withColumnRenamed("bucket", "before"), heads["bucket"] == after["next"]).select("before", "head")
    heads = stored(heads, "order-heads")

    w = Window.partitionBy("bucket").orderBy(*order)
    y = x.withColumn("next_text", F.lead("text").over(w)).withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    y = y.join(heads, F.col("last") & (y["bucket"] == heads["before"]), "left")
    return y.select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))


def _next_bucket(b: DataFrame) -> DataFrame:
    """(bucket, next): the next one that is there, the last with the first."""
    b = b.withColumn("far", F.floor(F.col("bucket") / 1024))
    near = b.withColumn("next", F.lead("bucket").over(Window.partitionBy("far").orderBy("bucket")))
    far = b.groupBy("far").agg(F.min("bucket").alias("least"))
    w = Window.partitionBy(F.lit(0)).orderBy("far")  # one row for a million rows of documents / 4
    far = far.select("far", F.lead("least").over(w).alias("following"))
    first = b.agg(F.min("bucket").alias("first"))
    y = near.join(far, "far").join(F.broadcast(first), F.lit(True))  # one row
    return y.select("bucket", F.coalesce("next", "following", "first").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    m = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - m), F.substring(following, F.lit(1), m))


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    x = with_next(table(spark, sf_dir, "documents"))
    x = x.select("doc_id", "text", "next_text", edited(F.col("text"), F.col("next_text")).alias("edit"))
    x = x.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        F.array(*[fingerprint(F.col(c)) for c in ("text", "edit", "next_text")]).alias("fp"),
    )
    a, b, c = (F.get("fp", F.lit(i)) for i in range(3))
    # inside one lambda, so that no fingerprint is made twice
    out = F.transform(
        F.array("fp"),
        lambda p: F.struct(
            as_string(F.get(p, F.lit(0))).alias("fingerprint"),
            as_string(F.get(p, F.lit(1))).alias("edited_fingerprint"),
            likeness(F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("near_edited"),
            likeness(F.get(p, F.lit(0)), F.get(p, F.lit(2))).alias("near_next"),
        ),
    )
    return x.select("doc_id", "n_chars", "edited_sha256", F.get(out, F.lit(0)).alias("o")).select("doc_id", "n_chars", "edited_sha256", "o.*")
