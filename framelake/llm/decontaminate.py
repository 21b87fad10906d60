"""Benchmark decontamination by greedy string tiling.

Words are hashed; runs of `seed` words shared with the benchmark are joined map-side against a
table of the benchmark's seeds whose size is bounded: a larger benchmark is taken in blocks, each
a pass over all documents that is written before the next block is sent. An item of fewer words
than `seed` is one seed of its own length, so it matches where it stands as a whole. For each
document and item the shared seeds on one diagonal form matches, kept as running Karp-Rabin hashes
of runs say they are equal; the longest match whose words are all unmarked is marked again and
again until none of `seed` words is left. The share of the item's words that are marked is its
coverage: passages in another order count in full.

Only an item's probing seeds look for documents: its most frequent seeds, as counted over the block's
items, are left out as long as all that are left out together cover less than `coverage` of its
words. A document that holds none of the probing seeds cannot reach the threshold, so a preamble
that many items share makes no pairs, and no pair is lost. Found pairs are then tiled from all their seeds.

Defined results: null or empty documents and items match nothing, nor do items without words;
repeated items and documents each give their own rows; ties among equally long matches go to the
earlier place in the document, then in the item; empty tables give no rows. Documents are read
whole; a document and an item that repeat one run of words a and b times hold a * b matches in
memory while they are tiled. Only ids and texts are read.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, cut, pieces, shingles

#: Words of benchmark items in one block; its seeds, places and hashes take about 40 bytes a word on each executor core.
BLOCK_WORDS = 2_000_000
#: So many characters count as a word at least, for items in scripts that hardly part words.
CHARS = 16


def _borders(doc: np.ndarray, item: np.ndarray, beside: int) -> np.ndarray:
    """Places (in doc, in item) of equal seeds whose neighbours on one side (-1 or 1) differ or are not there, in order of diagonal and place.

    A document's places of one seed are sorted by their neighbour, so those with the item's neighbour are one
    range that is left out unseen: runs of repeated words give few places, not all pairs.
    """
    def neighbours(seeds: np.ndarray) -> np.ndarray:
        out = np.full(len(seeds), -1)
        if beside < 0:
            out[1:] = seeds[:-1]
        else:
            out[:-1] = seeds[1:]
        return out

    wide = int(doc.max(initial=0)) + 2
    keys = doc * wide + neighbours(doc) + 1
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    q = np.flatnonzero(item >= 0)
    own, near = item[q], neighbours(item)[q]
    low, high = np.searchsorted(keys, own * wide), np.searchsorted(keys, (own + 1) * wide)
    skip, on = (np.where(near >= 0, np.searchsorted(keys, own * wide + near + 1, side), low) for side in ("left", "right"))
    first, n = np.concatenate([low, on]), np.concatenate([skip - low, high - on])
    spot = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    found = np.stack([order[spot], np.repeat(np.concatenate([q, q]), n)], 1)
    return found[np.lexsort((found[:, 0], found[:, 0] - found[:, 1]))]


def tiles(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of an item in a document, each given as the numbers of its seeds of `width` words in order of place, equal for equal seeds; an item's seed that the document lacks is negative. Gives (place in document, place in item, words).

    Matches are kept as stretches of diagonals, found from their first and last places.
    """
    starts, ends = _borders(doc, item, -1), _borders(doc, item, 1)
    lengths = ends[:, 0] - starts[:, 0] + width
    heap = list(zip((-lengths).tolist(), starts[:, 0].tolist(), starts[:, 1].tolist(), strict=True))
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc) + width - 1, bool), np.zeros(len(item) + width - 1, bool)
    out = []

    def free(marks: np.ndarray) -> np.ndarray:
        """First places and ends of the runs without a mark."""
        return np.flatnonzero(np.diff(np.concatenate([[True], marks, [True]]))).reshape(-1, 2)

    while heap:
        n, a, b = heapq.heappop(heap)
        marks = in_doc[a : a - n] | in_item[b : b - n]
        if not marks.any():
            out.append((a, b, -n))
            in_doc[a : a - n] = in_item[b : b - n] = True
            if (np.diff(free(in_item), axis=1) < width).all():
                break
            continue
        for s, e in free(marks).tolist():  # what is unmarked of it comes again, as shorter matches
            if e - s >= width:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return out


def _widths(h: np.ndarray, bounds: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of every run of each of `widths` words."""
    parts = []
    for w in widths:
        runs, at = shingles(h, bounds, w)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
        whole = np.diff(bounds)[text] >= w
        parts.append((runs[whole] ^ np.uint64(w), text[whole], (np.arange(len(runs)) - at[text])[whole]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Seeds:
    """A block of the benchmark: its items' seeds in order of item and place, and the probing ones in order of hash."""

    def __init__(self, items: list[tuple[int, str]], seed: int, coverage: float):
        words = Words([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.length = np.diff(words.bounds)
        self.seed = np.minimum(self.length, seed)
        self.widths = sorted(set(self.seed[self.seed > 0].tolist())) or [seed]
        h, item, place = _widths(words.hash, words.bounds, self.widths)
        own = np.flatnonzero(self.widths_of(h, item))
        own = own[np.lexsort((place[own], item[own]))]
        self.hash, self.item, self.place = h[own], item[own], place[own]
        self.bounds = np.searchsorted(self.item, np.arange(len(items) + 1))
        probe = self._probing(coverage)
        order = probe[np.argsort(self.hash[probe], kind="stable")]
        self.probe, self.probe_item = self.hash[order], self.item[order]

    def widths_of(self, h: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which runs have their item's own width: `_widths` lists them width by width, and only an item's own width is a seed."""
        counts = [int(np.maximum(self.length - w + 1, 0).sum()) for w in self.widths]
        return np.repeat(self.widths, counts) == self.seed[item]

    def _probing(self, coverage: float) -> np.ndarray:
        """Places in hash, item, place of the seeds that must find a document."""
        _, at, times = np.unique(self.hash, return_inverse=True, return_counts=True)
        often = times[at]
        probing = np.ones(len(self.hash), bool)
        for i, (s, e) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            if e - s < 2 or often[s:e].max() == 1:
                continue
            covered, need, width = np.zeros(self.length[i], bool), coverage * self.length[i], self.seed[i]
            total = 0
            for k in s + np.argsort(-often[s:e], kind="stable"):
                place = self.place[k]
                total += int((~covered[place : place + width]).sum())
                if total >= need or often[k] == 1:
                    break
                covered[place : place + width] = True
                probing[k] = False
        return np.flatnonzero(probing)


def _matches(texts: list[str], seeds: Seeds, coverage: float) -> list[tuple[int, int, float, int, list[dict]]]:
    """(text, item, coverage, words covered, tiles) of each pair at or above the threshold."""
    words = Words(texts)
    h, text, _ = _widths(words.hash, words.bounds, seeds.widths)
    lo, hi = np.searchsorted(seeds.probe, h, "left"), np.searchsorted(seeds.probe, h, "right")
    at = np.flatnonzero(hi > lo)
    if not len(at):
        return []
    # a seed that a text repeats looks up its items once
    first = np.unique(np.stack([text[at].astype(np.uint64), lo[at].astype(np.uint64)]), axis=1).astype(np.int64)
    ends = np.searchsorted(seeds.probe, seeds.probe[first[1]], "right")
    n = ends - first[1]
    hit = np.repeat(first[1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    pairs = np.unique(np.repeat(first[0], n) * len(seeds.ids) + seeds.probe_item[hit])
    lengths, at = np.diff(words.bounds), 0
    by_width = {}  # each width's seeds, in order of text and place
    for w in seeds.widths:
        upto = at + np.concatenate([[0], np.cumsum(np.maximum(lengths - w + 1, 0))])
        by_width[w], at = upto, int(upto[-1])
    out = []
    numbered, last = {}, -1
    for t, i in zip((pairs // len(seeds.ids)).tolist(), (pairs % len(seeds.ids)).tolist(), strict=True):
        length, width = int(seeds.length[i]), int(seeds.seed[i])
        if t != last:
            numbered, last = {}, t
        if width not in numbered:
            numbered[width] = np.unique(h[by_width[width][t] : by_width[width][t + 1]], return_inverse=True)
        known, doc = numbered[width]
        own = seeds.hash[seeds.bounds[i] : seeds.bounds[i + 1]]
        place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        there = known[place] == own if len(known) else np.zeros(len(own), bool)
        if len(np.unique((np.flatnonzero(there)[:, None] + np.arange(width)).ravel())) < coverage * length:
            continue  # even all seeds together cover too little
        found = tiles(doc, np.where(there, place, -1), width)
        covered = sum(x[2] for x in found)
        if covered >= coverage * length:
            out.append((t, seeds.ids[i], covered / length, covered, [{"doc_word": a, "item_word": b, "words": k} for a, b, k in found]))
    return out


def blocks(benchmark: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about BLOCK_WORDS words, streamed to the driver one after the other."""
    held, words = [], 0
    for row in benchmark.select(F.col(id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").toLocalIterator():
        held.append((row["i"], row["t"]))
        words += max(len(Words([row["t"]]).start), len(row["t"]) // CHARS)
        if words >= BLOCK_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = 0.5, seed: int = 5) -> DataFrame:
    """Pairs of a document and an item of which `coverage` or more is tiled: id, item_id, coverage, words, tiles. No shuffle."""
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    tile = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
    schema = f"_id {kind}, item_id long, coverage double, words long, tiles array<struct<doc_word: long, item_word: long, words: long>>"
    def matched(block: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Seeds(block, seed, coverage))
        held.append(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in pieces(batch, "_text"):
                    if hits := _matches(texts, shared.value, coverage):
                        rows_, *rest = zip(*hits, strict=True)
                        ids = batch.column("_id").take(pa.array([first + r for r in rows_]))
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(rest, (pa.int64(), pa.float64(), pa.int64(), tile), strict=True))], names=["_id", "item_id", "coverage", "words", "tiles"])

        return rows.mapInArrow(run, schema)

    held, done = [], []
    todo = blocks(benchmark, item_id, item_text)
    block, following = next(todo, None), next(todo, None)
    while following is not None:
        done.append(cut(matched(block)))
        held.pop().destroy()
        block, following = following, next(todo, None)
    last = matched(block) if block is not None else rows.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.union, [*done, last]).withColumnRenamed("_id", id)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds half or more of a benchmark item, with the item."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).select("doc_id", "item_id", "coverage", "words")
