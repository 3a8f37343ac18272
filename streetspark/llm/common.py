"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, everywhere in this subpackage.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = f"[{SPACE_CLASS}]+"
WORD = f"[^{SPACE_CLASS}]+"
#: What ``stored`` has written in this process.
WRITTEN: list[str] = []
#: Up to so many rows of a few short columns are broadcast; beyond, a join shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: Up to so many narrow rows one task may get whole.
FEW_ROWS = 100_000
#: At most so many frequent keys are joined by broadcast.
HOT_KEYS = 4096


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(text, SPACES), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Where both are unset, a folder of the warehouse, which is shared as well; never a folder of this machine alone.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/streetspark-checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    schema = df.schema
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    read = spark.read.schema(schema).parquet(path)
    return read.select(*[read[f"`{c}`"] for c in df.columns])


def tidy(spark: SparkSession) -> None:
    """Asks the driver's collectors to run, so that Spark drops the shuffle files of plans that are gone."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes what ``stored`` wrote to ``paths``, when results no longer depend on it."""
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if at in WRITTEN:
            WRITTEN.remove(at)
    tidy(spark)


def discard(*stored_frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    for df in stored_frames:
        spark = df.sparkSession
        at = shared_dir(spark)
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            if path.getName() and path.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(at).toUri().getPath():
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_bounded(df: DataFrame) -> DataFrame:
    """A stored frame, to be broadcast if it has at most BROADCAST_ROWS rows; beyond, joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hot_keys(left: DataFrame, key: str, n: int) -> DataFrame | None:
    """The keys that a HOT_KEYS-th of the ``n`` rows of ``left`` have, no more than HOT_KEYS then; none of few rows."""
    if n <= FEW_ROWS:
        return None
    hot = stored(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n // HOT_KEYS).select(key), "hot-keys")
    return None if hot.isEmpty() else hot


def hot_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row a key, null where there is none.

    Its ``hot_keys`` are joined by broadcast, so that no task gets all rows of one.
    """
    return join_hot(left, right, key, hot_keys(left, key, left.count()))


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``hot_join`` where the ``hot_keys`` are known."""
    if hot is None:
        return left.join(right, key, "left")
    hot = F.broadcast(hot)
    few = F.broadcast(stored(right.join(hot, key, "left_semi"), "hot-rows"))
    return left.join(hot, key, "left_semi").join(few, key, "left").unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
