"""What the corpus operators share: tables in the shared folder, ranks without hot windows, vectorised words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, attach, cut, new_path, shared_dir, small  # noqa: F401  for the operators

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


def bucket_count(rows: int) -> int:
    """Buckets for a window over `rows` rows: of about 1,000 rows each up to 1,000 buckets, then of up to 100,000 rows."""
    return max(1, min(-(-rows // 1_000), 1_000), -(-rows // 100_000))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds a gapless rank from 0 within `keys`, in an order drawn from a hash of `order`.

    No key is gathered in one task: rows are dealt over hash buckets, their number following the
    largest key's rows; a bucket's rank starts after the buckets before it.
    Rows with equal `order` values share a bucket, and any of them may come first.
    """
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    buckets = bucket_count(most)
    at = df.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int"))
    rows = at.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *order)) - 1)
    if buckets == 1:
        return rows.withColumn(name, F.col("_r").cast("long")).drop("_h", "_b", "_r")
    sizes = at.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    joined = rows.alias("l").join(sizes.alias("r"), same)
    return joined.select("l.*", F.col("r._o").alias("_o")).withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_h", "_b", "_r", "_o")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges: (node, root), the root being the least node.

    Each round every node takes the least root among its neighbours', then its root's root.
    Rounds end when no root changes; each round is a written table. A node with very many
    neighbours, or a root with very many nodes, meets its rows by a broadcast (`attach`).
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col(a) != F.col(b)).distinct()
    both = cut(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")))
    while True:
        near = attach(both, roots.select(F.col("node").alias("v"), "root"), ["v"]).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low"))
        moved = cut(roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("mid")))
        above = attach(moved, roots.select(F.col("node").alias("mid"), F.col("root").alias("up")), ["mid"])
        moved = cut(above.select("node", F.least("mid", "up").alias("root"), (F.least("mid", "up") != F.col("old")).alias("changed")))
        roots = moved.select("node", "root")
        if moved.where("changed").isEmpty():
            return roots


def contracted(edges: DataFrame) -> DataFrame:
    """(node, low) edges, low being the smaller end, with the same components and few more rows than nodes.

    A node keeps its least partner, and its other smaller partners are tied to that one instead; the
    partners of many nodes are the same, so their ties fall together. A node's smaller partners, at most
    one for each bucket or tile that it was compared in, stand in one row for that.
    """
    for _ in range(2):
        stars = edges.where("node <> low").groupBy("node").agg(F.min("low").alias("least"), F.collect_set("low").alias("lows"))
        kept = F.concat(F.array("node"), F.filter("lows", lambda x: x != F.col("least")))
        edges = stars.select(F.explode(kept).alias("node"), F.col("least").alias("low"))
    return cut(edges.distinct())


# ---------------------------------------------------------------- words, vectorised over a batch


@lru_cache(1)
def word_points() -> np.ndarray:
    """True for the code points that make words: letters, marks and numbers of any script."""
    return np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)])


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts: `hash` and code-point `start` and `end` of each; text i has words bounds[i] to bounds[i+1]."""

    def __init__(self, texts: list[str], fold: np.ndarray | None = None, lower: bool = True):
        joined = "\n".join(texts)
        lengths = [len(t) for t in texts]
        if lower:
            low = joined.lower()
            if len(low) != len(joined):
                low = "\n".join(parts := [t.lower() for t in texts])
                lengths = [len(t) for t in parts]
            joined = low
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        self.text_start = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])
        points = self.points if fold is None else fold[np.minimum(self.points, len(fold) - 1)]
        self.folded = points
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = word_points()[points]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.up, self.down = powers(max(1 << 20, 1 << int(len(points) + 1).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.up[: len(points)])])
        self.hash = self.span_hash(self.start, self.end)
        self.bounds = np.searchsorted(self.start, self.text_start)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * ODD)


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words within each text, and their bounds; a shorter text that has words is one run."""
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(bounds[:-1] - out[:-1], count) + np.arange(out[-1])
    ends = np.repeat(bounds[1:], count)
    total, k = np.zeros(len(at), np.uint64), ODD
    with np.errstate(over="ignore"):
        for j in range(width):
            k = k * np.uint64(BASE) + ODD
            ok = at + j < ends
            total += np.where(ok, h[np.minimum(at + j, max(len(h) - 1, 0))] * k, np.uint64(0)) if len(h) else np.uint64(0)
    return mixed(total), out


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """The batch's texts (null: empty) in runs of about `most` characters, with the first row of each.

    A text is never split, so one of n characters takes arrays of some 30 to 100 bytes a character in its task.
    """
    texts, first, held = [], 0, 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        texts.append(text or "")
        held += len(texts[-1])
        if held >= most:
            yield first, texts
            texts, first, held = [], i + 1, 0
    if texts:
        yield first, texts


def running(df: DataFrame, keys: list[str], levels: list[str], tie: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before, within `keys`, ordered by `levels` and then by a hash of `tie`.

    Rows are dealt over hash buckets, so that no window holds a key; sums of whole buckets come first.
    """
    buckets = bucket_count(df.count())
    at = df.withColumn("_h", F.xxhash64(*tie)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int"))
    group = [*keys, *levels, "_b"]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*group).agg(F.sum(value).alias("_s"))
    sums = sums.select(*group, F.coalesce(F.sum("_s").over(before(Window.partitionBy(*keys).orderBy(*levels, "_b"))), F.lit(0)).alias("_o"))
    inner = F.coalesce(F.sum(value).over(before(Window.partitionBy(*group).orderBy("_h", *tie))), F.lit(0))
    return at.withColumn("_i", inner).join(sums, group).withColumn(name, F.col("_o") + F.col("_i")).drop("_h", "_b", "_i", "_o")


def ordered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds a gapless rank from 0 by the values of `column`, nulls last, through range partitions."""
    parts = bucket_count(df.count())
    ranged = cut(df.repartitionByRange(parts, F.col(column).isNull(), F.col(column)).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(column).asc_nulls_last())) - 1
    return ranged.withColumn("_r", within).join(starts, "_p").withColumn(name, F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")
