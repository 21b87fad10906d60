"""Mixing sources to target weights: subset-sum budget fitting.

Sources in code-point order, null last, have the given weights in turn and share `share` of all
words by weight; no target exceeds `most` times its source's size, and the excess is shared again
by weight. Documents are counted by exact length per source. A source's target is met by whole
repeats of all its documents, a proportional number of each length, and bounded-knapsack dynamic
programming over the counts for the remaining budget; within a length the documents with the
least seeded hash are taken.

The proportional choice is undone as far as that takes. If no sum of the documents it left free meets the budget,
2, 4, 8... documents of each length are given back to the search, until the budget is met or
the search covers what can matter: all documents, or as many of each length as twice the longest
length (some best choice differs from one near the budget by no more). So the largest sum up to
the budget is taken, if that search fits into `BITS` bits of sums; a search that does not is not
made, and the best sum of the last one is taken. That needs lengths of which very
many sums miss the budget, with documents of millions of words.

Defined results: the size of a null text is 0; documents of size 0 are never taken (taken 0);
a source of size 0 has target 0; rows with equal ids are separate rows, and of rows equal in all
that orders them any may be taken; an empty table gives no rows. Only the id, the source and the
text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, ordered, ranked

WORD = r"[^\x20\x09-\x0D]+"
#: Words that greedy choice leaves to dynamic programming, besides one longest document.
FIT = 1 << 15
#: Bits of all the sums that one search may hold (256 MB in one task).
BITS = 1 << 31
#: Rows of one source and length that meet their row of the plan under one key.
HOT_ROWS = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target. The level to which weights fill is found by rounds over the sources: each caps those above."""
    table = ordered(sizes, "source", "_at").withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("_at"), F.lit(len(weights))).cast("int")))
    table = cut(table.withColumn("cap", most * F.col("source_size")))
    first = table.agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).first()
    total = share * (first["s"] or 0)
    level = total / (first["w"] or 1.0)
    while True:
        over = F.col("cap") < F.col("w") * F.lit(level)
        row = table.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("c"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not row["w"]:
            break
        higher = (total - row["c"]) / row["w"]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.select("source", "source_size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length sum up to the largest sum that does not exceed `budget` words."""
    unit = int(np.gcd.reduce(lengths)) if len(lengths) else 1
    lengths, budget = lengths // unit, budget // unit
    size = int((lengths * counts).sum())
    if size <= budget:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // size for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths):  # the bulk of what rounding left over, down to what the exact search covers
        more = min(int(counts[i] - take[i]), max(0, left - FIT) // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    best, back = _search(lengths, counts, take, budget), 1
    while best is not None:
        take, given = best, np.maximum(best - back, 0)
        if int((lengths * take).sum()) == budget or back > 4 * int(lengths.max()):
            break
        best = _search(lengths, counts, given, budget)
        if not given.any():
            take = take if best is None else best
            break
        back *= 2
    return take


def _search(lengths: np.ndarray, counts: np.ndarray, base: np.ndarray, budget: int) -> np.ndarray | None:
    """The best choice that takes at least `base`; None where its sums would exceed BITS."""
    take, left = base.copy(), budget - int((lengths * base).sum())
    sums, mask, steps = 1, (1 << (left + 1)) - 1, []
    for i in np.argsort(-(counts - take), kind="stable"):
        n, k = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while n > 0 and not sums >> left & 1:
            k = min(k, n)
            steps.append((i, k, sums))
            if len(steps) * left > BITS:
                return None
            sums |= sums << (k * int(lengths[i])) & mask
            n, k = n - k, 2 * k
        if sums >> left & 1:
            break
    left = sums.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> left & 1:
            take[i] += k
            left -= k * int(lengths[i])
    return take


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size")
    lengths, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    some = lengths > 0
    size, goal = int((lengths * counts).sum()), int(round(float(frame["target"].iloc[0])))
    whole = goal // size if size else 0
    extra = np.zeros(len(frame), np.int64)
    extra[some] = fit(lengths[some], counts[some], goal - whole * size)
    return frame.assign(whole=np.where(some, whole, 0), extra=extra)


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """Every row of `docs`: id, source, size, source_size, target, repeats (how often the mix holds it) and taken (its words in the mix)."""
    rows = docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = cut(rows)
    counts = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    plan = counts.alias("c").join(goals.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "t.source_size", "t.target")
    plan = cut(plan.groupBy("source").applyInPandas(_plan, "source string, size long, n long, source_size long, target double, whole long, extra long"))
    # a length's rows meet their row of the plan in pieces of HOT_ROWS, by their rank within it
    plan = plan.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / HOT_ROWS)))).drop("n")
    order = cut(ranked(rows, ["source", "size"], [F.lit(seed), F.col("id")], "r").withColumn("piece", F.floor(F.col("r") / HOT_ROWS)))
    out = attach(order, cut(plan), ["source", "size", "piece"])
    repeats = F.col("whole") + F.when(F.col("r") < F.col("extra"), 1).otherwise(0)
    return out.select(F.col("id").alias(id), "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
