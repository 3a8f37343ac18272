"""GraphML as node and edge tables, and back."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Marks a string that holds a nested value as sorted, compact JSON.
PREFIX = "__canonical_json__:"
KINDS = {"bigint": "long", "int": "int", "double": "double", "boolean": "boolean", "string": "string"}
DATA = "array<struct<_VALUE:string,_key:string>>"


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements with that tag. A file may be a piece of the document without a root of its own, which only the older tokenizer reads past
    its first element; an element that is not well-formed is an error.
    """
    reader = spark.read.format("xml").option("useLegacyXMLParser", True).option("mode", "FAILFAST")
    return reader.option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


def read_keys(spark: SparkSession, path: str) -> dict[str, tuple[str, str, str]]:
    """Key id: (for, name, type). A file's keys are few."""
    rows = _read(spark, path, "key", "_id string, _for string, `_attr.name` string, `_attr.type` string").collect()
    return {r["_id"]: (r["_for"], r["_attr.name"], r["_attr.type"]) for r in rows}


def _typed(df: DataFrame, ids: list, keys: dict, side: str) -> DataFrame:
    data = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(DATA)), lambda x: F.struct(x["_key"], x["_VALUE"])))
    cast = {"long": "bigint", "int": "int", "double": "double", "float": "double", "boolean": "boolean"}
    df = df.withColumn("_m", data)
    cols = [F.col("_m")[k].cast(cast.get(kind, "string")).alias(name) for k, (of, name, kind) in sorted(keys.items()) if of in (side, "all")]
    return df.select(*ids, *cols)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node_id, or u, v and edge_id, and a typed column a key. Nested values stay prefixed strings: see ``decoded``."""
    keys = read_keys(spark, path)
    nodes = _read(spark, path, "node", f"_id string, data {DATA}")
    edges = _read(spark, path, "edge", f"_id string, _source string, _target string, data {DATA}")
    n = _typed(nodes, [F.col("_id").alias("node_id")], keys, "node")
    e = _typed(edges, [F.col("_source").alias("u"), F.col("_target").alias("v"), F.col("_id").alias("edge_id")], keys, "edge")
    return n, e


def decoded(c, schema: str):
    """The nested value of a prefixed string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.startswith(c, F.lit(PREFIX)), F.from_json(F.substring(c, len(PREFIX) + 1, 1_000_000_000), schema))


def sorted_fields(c, kind):
    """A nested column with the fields of its structs in the order of their names, as canonical JSON wants them."""
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, StructType):
        made = F.struct(*[sorted_fields(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def encoded(c, kind):
    """A nested column of that type as a prefixed string; keys are sorted."""
    return F.concat(F.lit(PREFIX), F.to_json(sorted_fields(c, kind), {"ignoreNullFields": "false"}))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> None:
    """A folder with GraphML text: head, nodes, edges, foot, in files whose names are in the order of the text.

    Rows are made into XML on the executors, sorted by ranges of (node or edge, id) and written by as many tasks as there are shuffle partitions;
    the files one after the other are the document. Readers take the folder as it is.
    """
    simple = lambda df: df.select(*[F.col(f.name) if t in KINDS else encoded(F.col(f.name), f.dataType).alias(f.name) for f, (_, t) in zip(df.schema.fields, df.dtypes, strict=True)])
    nodes, edges = simple(nodes), simple(edges)
    n_cols = [(f"n{i}", c, KINDS[t]) for i, (c, t) in enumerate(x for x in nodes.dtypes if x[0] != "node_id")]
    e_cols = [(f"e{i}", c, KINDS[t]) for i, (c, t) in enumerate(x for x in edges.dtypes if x[0] not in ("u", "v", "edge_id"))]
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for side, cols in (("node", n_cols), ("edge", e_cols)):
        head += [f'<key id="{k}" for="{side}" attr.name={quoteattr(c)} attr.type="{t}"/>' for k, c, t in cols]
    head.append(f'<graph edgedefault="{"directed" if directed else "undirected"}">')

    def safe(c):
        c = c.cast("string")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def data(cols):
        return [F.coalesce(F.concat(F.lit(f'<data key="{k}">'), safe(F.col(f"`{c}`")), F.lit("</data>")), F.lit("")) for k, c, _ in cols]

    lit = F.lit
    n = nodes.select(lit(1).alias("part"), F.col("node_id").cast("string").alias("o"), F.concat(lit('<node id="'), safe(F.col("node_id")), lit('">'), *data(n_cols), lit("</node>")).alias("value"))
    e = edges.select(
        lit(2).alias("part"), F.col("edge_id").cast("string").alias("o"),
        F.concat(lit('<edge id="'), safe(F.col("edge_id")), lit('" source="'), safe(F.col("u")), lit('" target="'), safe(F.col("v")), lit('">'), *data(e_cols), lit("</edge>")).alias("value"),
    )
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, "", "\n".join(head)), (3, "", "</graph></graphml>")], "part int, o string, value string")
    frame.union(n).union(e).repartitionByRange("part", "o").sortWithinPartitions("part", "o").select("value").write.text(path)


def roundtrip_mismatches(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Rows that only one of two graphs has, both ways."""
    out = None
    for what, x, y in (("node", a[0], b[0]), ("edge", a[1], b[1])):
        y = y.select(*x.columns)
        for side, p, q in (("lost", x, y), ("added", y, x)):
            d = p.exceptAll(q).select(F.lit(what).alias("what"), F.lit(side).alias("side"), F.to_json(F.struct("*")).alias("row"))
            out = d if out is None else out.union(d)
    return out
