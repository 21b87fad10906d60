"""N-gram Jaccard join by chosen paths.

A text is its set of shingles of `width` words. Equal sets form one node. A node's set is embedded
as `SKETCH` minhash values. In every run a node follows the values that a hash of the path so far
chooses, 1 / `spread` of them on average; nodes on one path form a bucket. Buckets of at most
`LIMIT` nodes are compared by brute force on their sketches. From a larger one the nodes that are alike
leave, so that near copies make no paths in every level: `DRAWN` of its nodes are drawn, and what meets one of them by its
sketch is tied to it. The others are split again, and buckets still large after `LEVELS` levels (their
nodes agree on as many chosen values) are taken whole.

Runs are repeated, `batch` at a time, until the target recall. It is measured on planted partners:
`PLANTS` nodes or more, drawn by a hash, each get one partner whose sketch agrees with theirs in as many values
as that of a text exactly at the threshold does on average. A partner takes part in the buckets,
links to nothing, and counts as found once it meets its node. Runs end when `recall` of them are
found, so hot passages, under which paths are deeper and pairs meet less often, add runs.

Nodes of a large bucket of the first level, those that leave it among them, are also joined exactly, so a
planted partner and its node that part where one of them leaves count as found. It goes by a prefix filter: of n
shingles in one order of all (rare ones first, as counted over these nodes) the first
n - ceil(threshold * n) + 1 hold one of any node at the threshold. Nodes that share such a shingle
meet by their sketches, more than `WIDE` of about one size without a look.

What meets forms families (components of meetings), a superset of the links. Within a family every
pair is compared exactly, in tiles of bounded size: a family of any size is cut into tiles and
tile pairs go to different tasks, which return only counts and local components. So no pair of a
family that lies above the threshold is lost, no pairs are written, and none is counted twice.

Defined results: null and empty texts, and texts without words, have no set: they link to nothing
and each row is its own class; a text of fewer words than `width` is one shingle; documents of
equal sets link to each other (similarity 1); a class is a component of links and its id the least
id in it; rows with equal ids are separate rows that may share a class; a null id never names a
class that has another; an empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, attach, components, contracted, cut, mixed, pieces, shingles, small

SKETCH, LIMIT, LEVELS = 64, 64, 4
#: Nodes of a large bucket with which all others are compared before it is split.
DRAWN = 4
#: Planted partners by which recall is measured, about; all nodes have one where there are fewer nodes.
PLANTS = 8_192
#: Agreement of two sketches from which a small bucket's pair counts as a meeting: at similarity 0.8 fewer than 1 in a million pairs fall below.
MEETING = 0.55
#: Cells in which shingles are counted for their order; nodes of a prefix bucket that are compared by their sketches.
CELLS, WIDE = 1 << 20, 512
#: Nodes and shingles of one tile (a task holds two): up to sixteen tiles of the first size, then larger ones up to
#: the second size, so that a family spreads over many tasks but is not sent too often; and nodes of one product of matrices within it.
TILE_NODES, TILE_SHINGLES, PRODUCT = (512, 4096), (1 << 19, 1 << 21), 512
#: Shingles that small families bring to one task together.
BIN_SHINGLES = 1 << 19


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240101)
    return r.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def _sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their bounds."""
    words = Words(texts)
    h, bounds = shingles(words.hash, words.bounds, width)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return h[keep], np.searchsorted(doc[keep], np.arange(len(texts) + 1))


def sketches(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """_id, h (hash of the text), key (16 bytes, null without words), n (shingles) and sketch of every row."""
    rows = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers()
        for batch in batches:
            for first, texts in pieces(batch, "_text"):
                sets, bounds = _sets(texts, width)
                n = np.diff(bounds)
                keys = [hashlib.md5(sets[s:e].tobytes()).digest() if e > s else None for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                full = np.flatnonzero(n)
                table = np.zeros((len(texts), SKETCH), np.uint32)
                if len(full):
                    for k in range(SKETCH):
                        table[full, k] = np.minimum.reduceat((sets * a[k] + b[k]) >> np.uint64(32), bounds[:-1][full]).astype(np.uint32)
                flat = pa.array([r.tobytes() if m else None for r, m in zip(table, n, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(first, len(texts)), batch.column("h").slice(first, len(texts)), pa.array(keys, pa.binary()), pa.array(n.astype(np.int64)), flat], names=["_id", "h", "key", "n", "sketch"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, h long, key binary, n long, sketch binary")


def planted(nodes: DataFrame, threshold: float) -> DataFrame:
    """Partners of about PLANTS nodes: node is -1 less the node's, the sketch agrees with the node's in a `threshold` share of values."""
    share = min(1.0, PLANTS / max(nodes.count(), 1))
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit("plant"), "key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("node", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(SKETCH, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            table = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
            with np.errstate(over="ignore"):
                draw = mixed(mixed(node.astype(np.uint64) + np.uint64(1))[:, None] + mixed(place + np.uint64(77)))
            other = (mixed(draw) >> np.uint64(32)).astype(np.uint32)
            kept = np.argsort(np.argsort(draw, axis=1), axis=1) < round(threshold * SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - node), pa.array([r.tobytes() for r in np.where(kept, table, other)], pa.binary())], names=["node", "sketch"])

    return cut(drawn.mapInArrow(run, "node long, sketch binary"))


def _children(rows: DataFrame, runs: range, spread: float) -> DataFrame:
    """(path, node) of the next level; rows has node and sketch, and path unless it is the first level."""
    chance = np.uint64(int(2**64 / (spread * SKETCH)))
    first = "path" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mixed(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH).astype(np.uint64)
            nodes = batch.column("node").to_numpy()
            tokens = mixed(values + place)
            paths = [np.full(len(nodes), r + 1, np.uint64) for r in runs] if first else [batch.column("path").to_numpy().view(np.uint64)]
            for path in paths:
                key = mixed(tokens ^ mixed(path * np.uint64(0xD6E8FEB86659FD93))[:, None])
                row, col = np.nonzero(key < chance)
                yield pa.RecordBatch.from_arrays([pa.array(mixed(key[row, col] + np.uint64(1)).view(np.int64)), pa.array(nodes[row])], names=["path", "node"])

    return rows.mapInArrow(run, "path long, node long")


def _meetings(buckets: DataFrame) -> DataFrame:
    """(node, low) of small buckets: each node with the least node of its component by sketches, each planted partner with its node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for bucket in batch.column("bucket").to_pylist():
                bucket = sorted({x["node"]: x["sketch"] for x in bucket}.items())
                table = np.frombuffer(b"".join(s for _, s in bucket), np.uint32).reshape(-1, SKETCH)
                near = np.concatenate([(table[s : s + LIMIT, None, :] == table[None, :, :]).mean(2) >= MEETING for s in range(0, len(table), LIMIT)])
                plants = sum(n < 0 for n, _ in bucket)
                at = {n: i for i, (n, _) in enumerate(bucket)}
                for i in range(plants):
                    n = bucket[i][0]
                    if (j := at.get(-1 - n)) is not None and near[i, j]:
                        a.append(n)
                        b.append(-1 - n)
                low = _least(near[plants:, plants:])
                a += [bucket[plants + i][0] for i in np.flatnonzero(low != np.arange(len(low)))]
                b += [bucket[plants + j][0] for i, j in enumerate(low) if i != j]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["node", "low"])

    return buckets.mapInArrow(run, "node long, low long")


def _alike(large: DataFrame, members: DataFrame) -> DataFrame:
    """(path, node, drawn, leaves) of large buckets: whether the sketch of `node` meets that of one of DRAWN nodes of the bucket, drawn by hashes, and the first it meets. From a bucket of partners only none leaves."""
    held = cut(large.select("path", "node").join(members, "node"))
    draws = [F.min(F.struct(F.xxhash64(F.lit(f"drawn{k}"), "path", "node").alias("h"), "node", "sketch")).alias(f"m{k}") for k in range(DRAWN)]
    each = lambda c: [F.col(f"m{k}.{c}") for k in range(DRAWN)]
    first = cut(held.where("node >= 0").groupBy("path").agg(*draws).select("path", F.array(*each("node")).alias("drawn"), F.concat(*each("sketch")).alias("other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = lambda c, n: np.frombuffer(b"".join(x or bytes(4 * n * SKETCH) for x in batch.column(c).to_pylist()), np.uint32).reshape(-1, n, SKETCH)  # noqa: B023, E731
            drawn = np.array([x or [-1] * DRAWN for x in batch.column("drawn").to_pylist()], np.int64).reshape(-1, DRAWN)
            meets = ((values("sketch", 1) == values("other", DRAWN)).mean(2) >= MEETING) & (drawn >= 0)
            met = drawn[np.arange(len(drawn)), meets.argmax(1)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("node"), pa.array(met), pa.array(meets.any(1))], names=["path", "node", "drawn", "leaves"])

    looked = attach(held, first, ["path"], "left").select("path", "node", "sketch", "drawn", "other")
    return cut(looked.mapInArrow(run, "path long, node long, drawn long, leaves boolean"))


def _linked(groups: DataFrame, by: list[str], count: str) -> DataFrame:
    """(node, low): ties all nodes of each group through the least nodes of about sqrt(count) parts, so that no node gets more partners than that from a group."""
    parts = groups.select(*by, "node", F.pmod(F.xxhash64(F.lit("part"), "node"), F.ceil(F.sqrt(count)).cast("int")).alias("_part"))
    lows = cut(parts.groupBy(*by, "_part").agg(F.min("node").alias("low")))
    least = lows.groupBy(*by).agg(F.min("low").alias("least"))
    own = attach(cut(parts), lows, [*by, "_part"]).select("node", "low")
    return own.union(lows.join(least, by).select(F.col("low").alias("node"), F.col("least").alias("low"))).where("node <> low")


def _least(near: np.ndarray) -> np.ndarray:
    """The least index of each row's component in a symmetric boolean matrix with a true diagonal."""
    low = np.arange(len(near))
    while True:
        new = np.where(near, low[None, :], len(near)).min(1, initial=len(near))
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def _texts(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """_text and the columns of `wanted` beside its _id and h, for the rows of those ids and hashes of texts."""
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")).withColumn("h", F.xxhash64("_text"))
    rows = rows.alias("d").join(wanted.alias("w"), (F.col("d.h") == F.col("w.h")) & F.col("d._id").eqNullSafe(F.col("w._id")))
    return rows.select("_text", *(F.col(f"w.{c}") for c in wanted.columns if c not in ("_id", "h")))


def _cell_counts(rows: DataFrame, width: int, parts: int) -> np.ndarray:
    """How many of the sets hold a shingle of each cell. A task returns one packed row, `parts` tasks add these up."""

    def add(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, texts in pieces(batch, "_text"):
                counts += np.bincount(_cells(_sets(texts, width)[0]), minlength=CELLS)
        if counts.any():
            yield from add(counts)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for packed in batch.column("packed"):
                counts += np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
        yield from add(counts)

    counts = np.zeros(CELLS, np.int64)
    for row in rows.select("_text").mapInArrow(count, "packed binary").repartition(parts).mapInArrow(total, "packed binary").toLocalIterator():
        counts += np.frombuffer(zlib.decompress(row["packed"]), np.int64)
    return counts


def _cells(h: np.ndarray) -> np.ndarray:
    return (mixed(h) % np.uint64(CELLS)).astype(np.int64)


def prefix_meetings(docs: DataFrame, nodes: DataFrame, hot: DataFrame, id: str, text: str, width: int, threshold: float) -> DataFrame:
    """(node, low): meetings of the nodes `hot` that leave out no pair at the threshold, up to what MEETING leaves out."""
    wanted = cut(nodes.join(hot, "node").select("node", F.col("id").alias("_id"), "h"))
    many = wanted.count()
    rows = _texts(docs, small(wanted), id, text)
    counts = docs.sparkSession.sparkContext.broadcast(_cell_counts(rows, width, 1 + int((many / 1000) ** 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "_text"):
                sets, bounds = _sets(texts, width)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(texts)), n)
                order = np.lexsort((sets, counts.value[_cells(sets)], doc))
                most = n - np.ceil(threshold * n - 1e-6).astype(np.int64) + 1
                at = order[np.arange(len(order)) - bounds[doc] < most[doc]]
                held = batch.column("node").slice(first, len(texts)).to_numpy()
                sizes = np.floor(np.log(np.maximum(n, 1)) / np.log(1 / threshold)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sets[at].view(np.int64)), pa.array(held[doc[at]]), pa.array(sizes[doc[at]])], names=["path", "node", "size"])

    paths = cut(rows.mapInArrow(run, "path long, node long, size int").distinct())
    shared = attach(paths, cut(paths.groupBy("path").count().where("count > 1")), ["path"])
    buckets = shared.where(F.col("count") <= WIDE).groupBy("path").agg(F.sort_array(F.collect_list("node")).alias("members"))
    buckets = cut(buckets.select("members").distinct().select(F.monotonically_increasing_id().alias("path"), "members"))
    held = buckets.select("path", F.explode("members").alias("node")).join(nodes.select("node", "sketch"), "node")
    met = _meetings(held.groupBy("path").agg(F.collect_list(F.struct("node", "sketch")).alias("bucket")).select("bucket"))
    # sizes of two nodes at the threshold fall in one class or in neighbours
    large = cut(shared.where(F.col("count") > WIDE).select("path", "node", "count", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size")))
    return cut(met.union(_linked(large, ["path", "size"], "count")).distinct())


def _run(nodes: DataFrame, members: DataFrame, runs: range, spread: float) -> tuple[DataFrame, DataFrame | None]:
    """(node, low) of all meetings in these runs, and the nodes of large buckets of the first level (none: None).

    `members` are the nodes and their planted partners: node, sketch.
    """
    edges, hot, frontier = None, None, members
    for level in range(1, LEVELS + 1):
        paths = cut(_children(frontier, runs, spread))
        shared = cut(attach(paths, cut(paths.groupBy("path").count().where("count > 1")), ["path"]))
        held = shared.where(F.col("count") <= LIMIT).join(members, "node")
        met = _meetings(held.groupBy("path").agg(F.collect_list(F.struct("node", "sketch")).alias("bucket")).select("bucket"))
        large = shared.where(F.col("count") > LIMIT).select("path", "node", "count")
        if level == LEVELS:
            met = met.union(_linked(large.where("node >= 0"), ["path"], "count"))
            plants = large.where("node < 0").select("path", "node", (-1 - F.col("node")).alias("low"))
            met = met.union(plants.join(large.select("path", F.col("node").alias("low")), ["path", "low"]).select("node", "low"))
        met = cut(met.distinct())
        edges = met if edges is None else edges.union(met)
        if large.isEmpty():
            break
        if level == 1:
            hot = large.where("node >= 0").select("node").distinct()
        if level == LEVELS:
            break
        looked = _alike(large, members)
        ties = looked.where("leaves and node >= 0 and node <> drawn").select(F.greatest("node", "drawn").alias("node"), F.least("node", "drawn").alias("low"))
        plants = looked.where("node < 0").select("path", "node", (-1 - F.col("node")).alias("low"), F.col("leaves").alias("_leaves"))
        parted = plants.join(looked.select("path", F.col("node").alias("low"), "leaves"), ["path", "low"]).where("leaves or _leaves").select("node", "low")
        edges = edges.union(cut(ties.union(parted).distinct()))
        stay = looked.where("not leaves").select("path", "node")
        if stay.isEmpty():
            break
        frontier = stay.join(members, "node")
    return edges, hot


def families(docs: DataFrame, nodes: DataFrame, recall: float, batch: int, spread: float, id: str, text: str, width: int, threshold: float) -> DataFrame:
    """(node, root): the components of all meetings; nodes that meet none are left out."""
    plants = planted(nodes, threshold)
    many = plants.count()
    members = cut(nodes.select("node", "sketch").union(plants))
    edges, hot, found, first = None, None, None, 0
    while True:
        met, large = _run(nodes, members, range(first, first + batch), spread)
        first += batch
        partners = met.where("node < 0").select("node")
        found = cut((partners if found is None else found.union(partners)).distinct())
        edges = met.where("node >= 0") if edges is None else edges.union(met.where("node >= 0"))
        if large is not None:
            hot = large if hot is None else hot.union(large)
        if found.count() >= recall * many:
            break
    if hot is not None:
        edges = edges.union(prefix_meetings(docs, nodes, cut(hot.distinct()), id, text, width, threshold))
    return components(contracted(edges), "node", "low").select("node", "root")


def _compare(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Exact similarities within one family's tile, or between its two tiles: links by node, and the least node of its local component."""
    frame = frame.sort_values(["tile", "node"])
    sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
    n = np.array([len(s) for s in sets], np.float64)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle of one set only is in no intersection
    column = (np.cumsum(shared) - 1).astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sets = [column[c[shared[c]]] for c in (col[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True))]
    tile, weight = frame["tile"].to_numpy(), frame["copies"].to_numpy(np.float64)
    apart = frame["p"].iloc[0] != frame["q"].iloc[0]
    links, low = np.zeros(len(sets), np.int64), np.arange(len(sets))
    starts = range(0, len(sets), PRODUCT)
    for a in starts:
        for b in (b for b in starts if b >= a):
            x, y = slice(a, min(a + PRODUCT, len(sets))), slice(b, min(b + PRODUCT, len(sets)))
            if apart and tile[x][0] == tile[y][-1]:
                continue  # both lie in one tile, which another task compares
            linked = _overlaps(sets[x], sets[y]) * (1 + threshold) >= threshold * (n[x][:, None] + n[y][None, :]) - 1e-6
            if apart:
                linked &= tile[x][:, None] != tile[y][None, :]
            if a == b:
                np.fill_diagonal(linked, False)
            links[x] += (linked @ weight[y]).astype(np.int64)
            if a != b:
                links[y] += (weight[x] @ linked).astype(np.int64)
            _merge(low, *(at + s for at, s in zip(np.nonzero(linked), (a, b), strict=True)))
    nodes = frame["node"].to_numpy()
    return pd.DataFrame({"node": nodes, "links": links, "low": nodes[low]})


def _overlaps(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two lists of sets of small numbers, by products of 0-1 matrices over blocks of columns."""
    both = np.zeros((len(first), len(second)))
    here = np.intersect1d(np.concatenate(first), np.concatenate(second))

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.searchsorted(here, col)
        ok = here[np.minimum(at, len(here) - 1)] == col
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    if not len(here):
        return both
    (ra, ca), (rb, cb) = placed(first), placed(second)
    step = 1 << 13
    for start in range(0, len(here), step):
        a, b = (np.zeros((len(sets), step), np.float32) for sets in (first, second))
        for dense, row, col in ((a, ra, ca), (b, rb, cb)):
            s, e = np.searchsorted(col, [start, start + step])
            dense[row[s:e], col[s:e] - start] = 1
        both += a @ b.T
    return both


def _merge(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i] in `low`, which holds the least member of each one's component."""
    while len(a):
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = np.arange(len(low))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
        low[:] = root[low]


def linked_nodes(docs: DataFrame, nodes: DataFrame, family: DataFrame, id: str, text: str, width: int, threshold: float) -> DataFrame:
    """(node, links, low) per tile, from the exact sets of the families' nodes."""
    wanted = small(cut(nodes.join(family, "node").select("node", "root", "copies", F.col("id").alias("_id"), "h")))
    rows = _texts(docs, wanted, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "_text"):
                sets, bounds = _sets(texts, width)
                packed = [sets[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(texts)) for c in ("node", "root", "copies")), pa.array(packed, pa.binary())], names=["node", "root", "copies", "shingles"])

    exact = cut(rows.mapInArrow(run, "node long, root long, copies long, shingles binary").dropDuplicates(["node"]))
    size = F.octet_length("shingles") / 8
    parts = lambda n, ends: F.ceil(n / F.least(F.lit(ends[1]), F.greatest(F.lit(ends[0]), n / 16)))
    tiles = exact.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    tiles = tiles.select("root", "size", F.greatest(parts(F.col("n"), TILE_NODES), parts(F.col("size"), TILE_SHINGLES)).cast("int").alias("tiles"))
    tiles = cut(tiles.withColumn("tiles", F.when(F.col("tiles") < 1, 1).otherwise(F.col("tiles"))))
    bins = max(1, int((tiles.where("tiles = 1").agg(F.sum("size")).first()[0] or 0) / BIN_SHINGLES) + 1)
    dealt = attach(exact, tiles.select("root", "tiles"), ["root"]).withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("p", F.least("tile", "other")).withColumn("q", F.greatest("tile", "other"))
    # families of one tile share bins
    dealt = dealt.withColumn("bin", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", "p", "q")))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_compare(part, threshold) for _, part in frame.groupby(["root", "p", "q"])])

    return cut(dealt.select("bin", "root", "node", "copies", "tile", "p", "q", "shingles").groupBy("bin").applyInPandas(compare, "node long, links long, low long"))


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9995, batch: int = 4, spread: float = 0.7) -> DataFrame:
    """Every row of `docs`: id, class_id (the least id of its component of links) and n_links (documents linked to it, copies included)."""
    base = cut(sketches(docs, id, text, width))
    nodes = base.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "h")).alias("m"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes.select("key", F.col("m._id").alias("id"), F.col("m.h").alias("h"), "copies", "sketch", F.monotonically_increasing_id().alias("node")))
    family = cut(families(docs, nodes, recall, batch, spread, id, text, width, threshold))
    found = linked_nodes(docs, nodes, family, id, text, width, threshold)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(contracted(found.select("node", "low")), "node", "low")
    named = nodes.select("node", "key", "id", "copies").join(links, "node", "left").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named.where("copies > 1 or links > 0"))
    classes = cut(named.groupBy("root").agg(F.min("id").alias("class_id")))
    named = attach(named, classes, ["root"]).select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = attach(base.select("_id", "key"), cut(named), ["key"], "left")
    return out.select(F.col("_id").alias(id), F.when(F.col("n_links").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and number of links of every document."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
