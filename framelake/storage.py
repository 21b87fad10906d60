"""Tables in the folder that the driver and all executors share, and joins whose sent sides are counted first."""

import functools
import operator
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of at most so many slim rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A key with more than one in so many of all rows is hot; fewer keys than this can be.
HOT = 10_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, a local session gets a temporary folder; a cluster's raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="framelake-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df and reads it back, which ends its lineage. The files stay as long as the shared folder does."""
    path = new_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint, if its counted rows allow it, else with one that keeps Spark from sending it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def meet(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join by sorted shuffles, for sides that no count bounds.

    Spark takes a packed image for one value and an exploded row for one row, so it would send a side of any
    size through the driver as one that it takes for small.
    """
    return left.join(right.hint("merge"), on, how)


def attach(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """`rows` (written) joined with `table` (written; one row per value of `on`, nulls are equal), inner or left.

    A small table is broadcast. Beyond that, rows of hot keys meet a broadcast of their keys' rows,
    fewer than HOT, and only the other rows are shuffled: no key fills a task.
    """
    more = [c for c in table.columns if c not in on]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        same = functools.reduce(operator.and_, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on))
        return left.alias("l").join(right.alias("r"), same, how).select("l.*", *(F.col(f"r.{c}") for c in more))

    if table.count() <= BROADCAST_ROWS:
        return joined(rows, F.broadcast(table))
    counts = cut(rows.groupBy(*on).count().withColumnRenamed("count", "_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = cut(counts.where(F.col("_n") * HOT > total).select(*on))
    if hot.isEmpty():
        return joined(rows, table)

    def part(df: DataFrame, kind: str) -> DataFrame:
        same = functools.reduce(operator.and_, (F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}")) for c in on))
        return df.alias("l").join(F.broadcast(hot).alias("h"), same, kind)

    return joined(part(rows, "left_semi"), F.broadcast(part(table, "left_semi"))).unionByName(joined(part(rows, "left_anti"), table))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int) -> DataFrame:
    """Adds a gapless number from 0 within `keys`, in the order of `order`, over `parts` range partitions of all rows: no key meets in one task."""
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "_p").count().select(*keys, "_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    rows = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)) - 1)
    return attach(cut(rows), cut(starts), [*keys, "_p"]).withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_p", "_r", "_o")
