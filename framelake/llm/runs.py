"""Periodic runs of words, found by an online sparse diagonal search, and texts without the repetition.

A run is a stretch of consecutive words with smallest period q, at least `times` periods and `least`
words long, that no neighbouring word extends. Words are read from left to right. A word's earlier
occurrences lie on diagonals, one for each lag; a diagonal's match length grows by one while the lag
repeats, and a diagonal that ends with sufficient length emits its run. Frequent words would open a
diagonal for each pair of occurrences, so levels keep the table sparse: at level L (1, 2, 4, ...) only
the latest earlier occurrence with the same last L words is active, and only lags above L / 2 and up
to L count. That leaves out nothing: within a run of primitive period q <= L the same L words occur q
words back and no nearer, so its diagonal is the active one at each word after its first q + L - 1; it
cannot end before the run does, as other diagonals of that lag never meet the required length. Time and
memory are in proportion to n log n of the words whose last L words occur twice.

The steps over words are taken for all texts of a batch at once, by array operations.

Defined results: a null or empty text has no words and no runs, and its collapsed text is ''; a run
counts once, with its smallest period; a text that is one run collapses to its first q words; runs may
overlap, and a word goes if any run drops it. Every row is kept, repeated and null ids too; equal texts
get equal results; an empty table gives no rows. Only the id and the text are read, whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

#: What separates words: a blank, and the characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs only."""
    _, names = np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)
    return names


def earlier(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of `at` (ascending) whose name occurs at an earlier one, and the lag to the latest of these."""
    order = np.argsort(names, kind="stable")
    same = np.flatnonzero(names[order][1:] == names[order][:-1]) + 1
    later, before = order[same], order[same - 1]
    back = np.argsort(later, kind="stable")
    return at[later[back]], (at[later] - at[before])[back]


def runs_of(words: np.ndarray, bounds: np.ndarray, times: int = 4, least: int = 6) -> np.ndarray:
    """Rows (text, start, length, period), in this order, of the runs of each text: words[bounds[i]:bounds[i + 1]], numbers that are equal for equal words."""
    if times < 4:
        raise ValueError("runs of fewer than four periods need not show in the sparse table")
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    size = np.diff(bounds)
    at, names = np.arange(len(words)), named(text, words.astype(np.int64))
    found, level = [], 1
    while True:
        place, lag = earlier(names, at)
        # a diagonal goes on while the next word has the same lag
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(lag) != 0)])) if len(place) else np.zeros(0, int)
        last = place[np.append(new[1:], len(place)) - 1] if len(place) else place
        first, q = place[new], lag[new]
        start = first - (level - 1) - q
        length = last - start + 1
        good = (q > level // 2) & (q <= level) & (length >= np.maximum(least, times * q))
        found.append(np.stack([start[good], length[good], q[good]], 1))
        # only what occurs twice can occur twice at the next level, and only in texts with room for such a run
        _, names, often = np.unique(names, return_inverse=True, return_counts=True)
        held = (often[names] > 1) & (size[text[at]] >= times * (level + 1))
        at, names = at[held], names[held]
        if not len(at):
            break
        other = np.searchsorted(at, at - level)
        there = (at - level >= bounds[text[at]]) & (at[np.minimum(other, len(at) - 1)] == at - level)
        names = named(names[there], names[other[there]])
        at, level = at[there], 2 * level
    rows = np.concatenate(found)
    own = text[rows[:, 0]] if len(rows) else rows[:, 0]
    rows = np.concatenate([own[:, None], rows], 1)
    rows[:, 1] -= bounds[own]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def numbers_of(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    index: dict[bytes, int] = {}
    words = np.array([index.setdefault(w, len(index)) for w in itertools.chain.from_iterable(split)], np.int64)
    return words, np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)


def find(docs: DataFrame, id: str = "doc_id", text: str | Column = "text", times: int = 4, least: int = 6) -> DataFrame:
    """id, n_words, runs (array of start, length, period, by start and period) and collapsed (the words that no run drops, joined by blanks) of every row; no shuffle."""
    rows = docs.select(F.col(id).alias("_id"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "_text", 1 << 21):
                split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at just these characters
                words, bounds = numbers_of(split)
                found = runs_of(words, bounds, times, least)
                dropped = np.zeros(len(words) + 1, np.int64)
                begin = bounds[found[:, 0]] + found[:, 1]
                np.add.at(dropped, begin + found[:, 3], 1)
                np.add.at(dropped, begin + found[:, 2], -1)
                gone = np.cumsum(dropped) > 0
                of = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                made = [[{"start": s, "length": n, "period": q} for _, s, n, q in found[a:b].tolist()] for a, b in itertools.pairwise(of.tolist())]
                kept = []
                for i, (s, e) in enumerate(itertools.pairwise(bounds.tolist())):
                    own = split[i] if of[i] == of[i + 1] else [w for w, x in zip(split[i], gone[s:e].tolist(), strict=True) if not x]
                    kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(first, len(texts)), pa.array(np.diff(bounds)), pa.array(made, kind), pa.array(kept, pa.string())], names=["_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("_id", id)


def repeated(id: str, text: str) -> Column:
    """The query's planted texts: with h = crc32 of the decimal id, g = h div 10, n words and h % 10 = 0, the words from a = g % n on repeat their first 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col(id).cast("string"))

    def planted(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(again), F.lit(1), n - a)), " ")

    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    held = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(""))  # split once
    return F.when(h % 10 == 0, F.get(held, F.lit(0))).otherwise(F.col(text))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, some of which are made to repeat; its longest run and digests of all runs and of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = find(docs, text=repeated("doc_id", "text"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    longest = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))[0]
    out = out.withColumn("_top", F.when(F.size("runs") > 0, longest))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"), (-F.col("_top.n")).alias("length"), F.col("_top.period").alias("period"),
        F.expr("1000 * -_top.n div _top.period").alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
