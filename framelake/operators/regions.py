"""Contrast, histograms, thresholds, regions and their evolution, hand-drawn regions, crystallinity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.arrays import explode_images, long_form, map_images
from ..storage import BROADCAST_ROWS, cut, meet, small
from .frames import to_tiles

KEYS = ["stack_id", "frame"]


def contrast_stats(frames: DataFrame, rois: DataFrame | None = None) -> DataFrame:
    """n, sum, mean, std (sample), min, max, median, std/mean and (max-min)/(max+min) of each frame, or of each frame and roi.

    Frames are measured where they lie. With rois, bands of a frame's rows meet the x-spans of the polygons
    in these rows (`roi_spans`): numbers and sums are differences of prefix sums over the packed band, and
    only the medians gather values, those of one roi in one frame. No pixel becomes a row, and no polygon
    is sent, only its spans. A frame or roi without a number has no row.
    """
    ratio = lambda a, b: F.when(b != 0, a / b)
    if rois is None:

        def kernel(a: np.ndarray, _) -> dict:
            flat = [v[~np.isnan(v)] for v in a.reshape(len(a), -1)]
            some = [v if len(v) else np.zeros(1) for v in flat]
            std = [float(v.std(ddof=1)) if len(v) > 1 else None for v in flat]
            return {"n": [len(v) for v in flat], "sum": [v.sum() for v in some], "mean": [v.mean() for v in some], "std": std, "min": [v.min() for v in some], "max": [v.max() for v in some], "median": [np.median(v) for v in some]}

        out = map_images(frames, kernel, "n long, sum double, mean double, std double, min double, max double, median double", KEYS).where("n > 0")
    else:
        parts = _in_spans(frames, roi_spans(rois))
        mean = F.col("sum") / F.col("n")
        rows = parts.groupBy(*KEYS, "roi_id").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("m2").alias("_m2"), F.sum(F.col("sum") * F.col("sum") / F.col("n")).alias("_b2"), F.min("min").alias("min"), F.max("max").alias("max"), F.array_sort(F.flatten(F.collect_list("v"))).alias("_v"))
        # squares about each part's mean, and of the parts' means about the whole mean
        spread = F.greatest(F.lit(0.0), F.col("_m2") + F.col("_b2") - F.col("sum") * mean)
        middle = lambda k: F.element_at("_v", F.floor((F.col("n") + k) / 2).cast("int"))
        out = rows.select(*KEYS, "roi_id", "n", "sum", mean.alias("mean"), F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("std"), "min", "max", ((middle(1) + middle(2)) / 2).alias("median"))
    return out.withColumn("std_over_mean", ratio(F.col("std"), F.col("mean"))).withColumn("michelson", ratio(F.col("max") - F.col("min"), F.col("max") + F.col("min")))


#: Rows of a frame in one band, and spans of a band that meet it at once.
BAND, SPANS = 64, 50_000


def roi_spans(rois: DataFrame) -> DataFrame:
    """The polygons as half-open spans of whole pixels: roi_id, y, x0, x1 (x0 <= x < x1), by the even-odd rule of `in_roi`.

    Each edge gives one crossing for each row that it passes; a row's crossings, in order, open and close
    spans in turn. Polygons of fewer than three vertices have none. Written, slim rows.
    """
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    rows = F.sequence(F.ceil(low), F.ceil(high) - 1)
    edges = _edges(rois).where("vertices >= 3").where(F.ceil(low) < F.ceil(high)).withColumn("row", F.explode(rows))
    at = F.col("x") + (F.col("row") - F.col("y")) / (F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x"))
    order = Window.partitionBy("roi_id", "row").orderBy("x0")
    crossings = edges.select("roi_id", F.col("row").cast("int").alias("row"), F.ceil(at).cast("int").alias("x0"))
    spans = crossings.withColumn("x1", F.lead("x0").over(order)).withColumn("_k", F.row_number().over(order)).where("_k % 2 = 1 and x0 < x1")
    return cut(spans.select("roi_id", F.col("row").alias("y"), "x0", "x1"))


def _in_spans(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Of each band of a frame and each roi: n, sum, m2 (squares about the part's mean), min, max and values of the pixels in the roi's spans.

    Spans stand in lists of at most about SPANS for each band; few are sent to all executors, more are dealt with
    the bands over copies, so that no band's number is one key.
    """
    rows = spans.where("y >= 0 and x1 > 0").withColumn("band", F.expr(f"y div {BAND}"))
    sizes = rows.groupBy("band").count().agg(F.max("count"), F.sum("count"), F.count(F.lit(1))).first()
    lists, total, bands = max(1, -(-(sizes[0] or 0) // SPANS)), sizes[1] or 0, max(1, sizes[2])
    few = total <= BROADCAST_ROWS
    copies = 1 if few else max(1, 2 * spans.sparkSession.sparkContext.defaultParallelism // bands)
    packed = rows.groupBy("band", F.pmod(F.xxhash64("roi_id"), F.lit(lists)).alias("_l")).agg(F.collect_list(F.struct("roi_id", "y", "x0", "x1")).alias("spans")).drop("_l")
    packed = packed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    cut_ = frames.select(*KEYS, "width", "height", "px", F.explode(F.expr(f"sequence(0L, cast((height - 1) div {BAND} as long))")).alias("band"))
    cut_ = cut_.select(*KEYS, "width", "band", F.slice("px", F.col("band").cast("int") * BAND * F.col("width") + 1, F.col("width") * BAND).alias("px"), F.pmod(F.xxhash64(*KEYS), F.lit(copies)).cast("int").alias("_copy"))
    both = cut_.join(F.broadcast(packed), ["band", "_copy"]) if few else meet(cut_, packed, ["band", "_copy"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                v = np.asarray(row.px, float)
                width, ok = row.width, ~np.isnan(v)
                roi, y, x0, x1 = (np.array([s[c] for s in row.spans], np.int64) for c in ("roi_id", "y", "x0", "x1"))
                y, x0, x1 = y - row.band * BAND, np.maximum(x0, 0), np.minimum(x1, width)
                there = (x0 < x1) & (y * width < len(v))
                order = np.flatnonzero(there)[np.lexsort((x0[there], y[there], roi[there]))]
                if not len(order):
                    continue
                roi, a, b = roi[order], y[order] * width + x0[order], y[order] * width + x1[order]
                base = float(v[ok].mean()) if ok.any() else 0.0
                off = np.where(ok, v - base, 0)
                upto = [np.concatenate([[0], np.cumsum(c)]) for c in (ok, off, off * off)]
                new = np.flatnonzero(np.diff(roi, prepend=roi[0] - 1))
                n, s, q = (np.add.reduceat(c[b] - c[a], new) for c in upto)
                place = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
                owner = np.repeat(np.arange(len(new)), np.add.reduceat(b - a, new))[ok[place]]
                inside = v[place[ok[place]]]
                values = np.split(inside, np.searchsorted(owner, np.arange(1, len(new))))
                keep = np.flatnonzero(n > 0)
                if len(keep):
                    yield pd.DataFrame({"stack_id": row.stack_id, "frame": row.frame, "roi_id": roi[new][keep], "n": n[keep].astype(np.int64), "sum": (s + n * base)[keep], "m2": (q - s * s / np.maximum(n, 1))[keep], "min": [values[k].min() for k in keep], "max": [values[k].max() for k in keep], "v": [values[k] for k in keep]})

    return both.select(*KEYS, "width", "band", "px", "spans").mapInPandas(run, "stack_id long, frame long, roi_id long, n long, sum double, m2 double, min double, max double, v array<double>")


def histogram(frames: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """stack_id, frame, bin, n; bin -1 below lo, `bins` above hi. Empty bins have no row. Frames are counted where they lie; only counts travel."""

    def kernel(a: np.ndarray, part: pd.DataFrame) -> pd.DataFrame:
        v = a.reshape(len(a), -1)
        with np.errstate(invalid="ignore"):
            inner = np.floor((np.clip(v, lo, hi) - lo) / (hi - lo) * bins)
        at = np.where(v < lo, -1, np.where(v > hi, bins, np.where(v == hi, bins - 1, inner)))
        row, some = np.repeat(np.arange(len(v)), v.shape[1]), ~np.isnan(v.ravel())
        n = np.bincount(row[some] * (bins + 2) + at.ravel()[some].astype(int) + 1, minlength=len(v) * (bins + 2))
        there = np.flatnonzero(n)
        own, bin = np.divmod(there, bins + 2)
        return pd.DataFrame({**{c: part[c].to_numpy()[own] for c in KEYS}, "bin": bin - 1, "n": n[there]})

    found = explode_images(frames, kernel, "stack_id long, frame long, bin int, n long", KEYS)
    return found.groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))


def otsu(frames: DataFrame, lo: float, hi: float, bins: int = 256) -> DataFrame:
    """stack_id, frame, threshold: the upper edge of the bin after which the classes differ most; the smallest such bin."""
    counts = histogram(frames, lo, hi, bins).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.col("bin"))))
    counts = counts.groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))
    upto, whole = Window.partitionBy(*KEYS).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*KEYS)
    c = counts.withColumn("w0", F.sum("n").over(upto)).withColumn("m0", F.sum(F.col("n") * F.col("bin")).over(upto)).withColumn("w", F.sum("n").over(whole)).withColumn("m", F.sum(F.col("n") * F.col("bin")).over(whole))
    gap = F.col("m0") * F.col("w") - F.col("m") * F.col("w0")
    c = c.where("w0 < w").withColumn("score", gap.cast("double") * gap / (F.col("w0") * (F.col("w") - F.col("w0"))))
    best = c.groupBy(*KEYS).agg(F.max_by("bin", F.struct("score", -F.col("bin"))).alias("bin"))
    return best.select(*KEYS, (F.lit(lo) + (F.col("bin") + 1) * (hi - lo) / bins).alias("threshold"))


def segment(frames: DataFrame, threshold: float | str = "otsu", above: bool = True, lo: float = 0.0, hi: float = 255.0, bins: int = 256) -> DataFrame:
    """px becomes 1 where the value is above (or not above) the threshold, else 0; NaN is 0. Frames of one value have no Otsu threshold and no 1."""
    if threshold == "otsu":
        frames = meet(frames, otsu(frames, lo, hi, bins), KEYS, "left")
    else:
        frames = frames.withColumn("threshold", F.lit(float(threshold)))
    hit = lambda v: F.when(F.isnan(v) | v.isNull() | F.col("threshold").isNull(), 0.0).when((v > F.col("threshold")) if above else (v <= F.col("threshold")), 1.0).otherwise(0.0)
    return frames.withColumn("px", F.transform("px", hit))


def label_regions(mask: DataFrame, connectivity: int = 4, tile: int | None = None) -> DataFrame:
    """px becomes labels: the least y * width + x of the connected region, -1 outside.

    Without `tile` a frame is labelled by one kernel call. With it, tiles are labelled apart, the
    labels that touch across borders are edges, and least labels spread over the edges in rounds
    (each a written table), each label then taking its root's root, until none changes.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    eight = connectivity == 8
    if tile is None:
        keep = [c for c in mask.columns if c != "px"]
        return map_images(mask.withColumnRenamed("px", "_px"), lambda a, _: {"px": np.stack([kernels.components_of(m > 0, eight) for m in a]).reshape(len(a), -1).astype(float)}, "px array<double>", keep, px="_px")
    size = mask.select(*KEYS, "width")
    tiles = meet(to_tiles(mask, tile), size, KEYS)

    def local(a: np.ndarray, part: pd.DataFrame) -> dict:
        out = []
        for m, row in zip(a, part.itertuples(index=False), strict=True):
            own = kernels.components_of(m > 0, eight)
            y, x = np.divmod(np.maximum(own, 0), m.shape[1])
            out.append(np.where(own >= 0, (y + row.y0) * row.width + x + row.x0, -1).astype(float).ravel())
        return {"px": out}

    keep = ["stack_id", "frame", "ty", "tx", "y0", "x0", "h", "w", "halo", "width"]
    labelled = cut(map_images(tiles.withColumnRenamed("px", "_px"), local, "px array<double>", keep, px="_px", h="h", w="w"))
    cell = long_form(labelled, [*KEYS, "ty", "tx", "y0", "x0", "h", "w"], w="w").where("v >= 0")
    cell = cell.where("y = 0 or x = 0 or y = h - 1 or x = w - 1")
    border = cell.select(*KEYS, (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), F.col("v").cast("long").alias("label"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    near = border.select(*KEYS, F.col("label").alias("a"), F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps))).alias("to"))
    edges = meet(near.select(*KEYS, "a", F.col("to.y").alias("y"), F.col("to.x").alias("x")), border.withColumnRenamed("label", "b"), [*KEYS, "y", "x"]).where("a <> b").select(*KEYS, "a", "b").distinct()
    edges = cut(edges.union(edges.select(*KEYS, F.col("b").alias("a"), F.col("a").alias("b"))))
    roots = cut(edges.groupBy(*KEYS, "a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        low = meet(edges, roots.select(*KEYS, F.col("a").alias("b"), "root"), [*KEYS, "b"]).groupBy(*KEYS, "a").agg(F.min("root").alias("low"))
        mid = cut(meet(roots, low, [*KEYS, "a"]).select(*KEYS, "a", F.col("root").alias("old"), F.least("root", "low").alias("mid")))
        up = meet(mid, roots.select(*KEYS, F.col("a").alias("mid"), F.col("root").alias("up")), [*KEYS, "mid"])
        new = cut(up.select(*KEYS, "a", F.least("mid", "up").alias("root"), (F.least("mid", "up") < F.col("old")).alias("changed")))
        roots = new.drop("changed")
        if new.where("changed").isEmpty():
            break
    # each tile meets the roots of its own border labels
    own = meet(cell.select(*KEYS, "ty", "tx", F.col("v").cast("long").alias("a")).distinct(), roots, [*KEYS, "a"])
    table = own.groupBy(*KEYS, "ty", "tx").agg(F.collect_list(F.struct("a", "root")).alias("_m")).select(*KEYS, "ty", "tx", F.col("_m.a").alias("_a"), F.col("_m.root").alias("_root"))
    joined = meet(labelled, table, [*KEYS, "ty", "tx"], "left").withColumnRenamed("px", "_px")

    def renamed(a: np.ndarray, part: pd.DataFrame) -> dict:
        out = []
        for own, was, root in zip(a, part["_a"], part["_root"], strict=True):
            if was is None or not len(was):
                out.append(own.ravel())
                continue
            order = np.argsort(np.asarray(was))
            was, root = np.asarray(was, float)[order], np.asarray(root, float)[order]
            at = np.minimum(np.searchsorted(was, own), len(was) - 1)
            out.append(np.where(was[at] == own, root[at], own).ravel())
        return {"px": out}

    whole = map_images(joined, renamed, "px array<double>", ["stack_id", "frame", "ty", "tx", "y0", "x0", "h", "w", "halo"], px="_px", h="h", w="w", extra=["_a", "_root"])
    from .frames import from_tiles

    return from_tiles(whole, tile)


def labels_long(labels: DataFrame) -> DataFrame:
    """stack_id, frame, y, x, label of the pixels in regions."""
    return long_form(labels, KEYS).where("v >= 0").select(*KEYS, "y", "x", F.col("v").cast("long").alias("label"))


def measure_regions(labels: DataFrame, frames: DataFrame | None = None, min_area: int = 1) -> DataFrame:
    """Area, centroid and bounding box of each region; with `frames` its mean intensity too."""
    px = labels_long(labels)
    extra = []
    if frames is not None:
        both = labels.select(*KEYS, "width", F.arrays_zip(F.col("px").alias("l"), F.col("p").alias("v")).alias("px")) if "p" in labels.columns else meet(labels, frames.select(*KEYS, F.col("px").alias("p")), KEYS).select(*KEYS, "width", F.zip_with("px", "p", lambda a, b: F.struct(a.alias("l"), b.alias("v"))).alias("px"))
        px = long_form(both, KEYS).where("v.l >= 0").select(*KEYS, "y", "x", F.col("v.l").cast("long").alias("label"), F.col("v.v").alias("v"))
        extra = [F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("mean")]
    out = px.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("area_px"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y_min"), F.min("x").alias("x_min"), F.max("y").alias("y_max"), F.max("x").alias("x_max"), *extra)
    return out.where(F.col("area_px") >= min_area)


def label_areas(labels: DataFrame) -> DataFrame:
    """stack_id, frame, label, area of each region of packed label images."""

    def kernel(a: np.ndarray, part: pd.DataFrame) -> pd.DataFrame:
        found = [np.unique(image[image >= 0], return_counts=True) for image in a]
        at = np.repeat(np.arange(len(a)), [len(k) for k, _ in found])
        label, area = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
        return pd.DataFrame({"stack_id": part["stack_id"].to_numpy()[at], "frame": part["frame"].to_numpy()[at], "label": label, "area": area})

    return explode_images(labels, kernel, "stack_id long, frame long, label long, area long", KEYS)


def label_overlaps(labels: DataFrame) -> DataFrame:
    """stack_id, frame, label, prev, shared: the regions of each frame and of the frame before that have pixels in common, with how many; frames of other sizes share their upper left."""
    before = labels.select("stack_id", (F.col("frame") + 1).alias("frame"), F.col("px").alias("_px"), F.col("height").alias("_h"), F.col("width").alias("_w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                stack_id, frame, h, w, now, h0, w0, was = row
                now, was = (np.asarray(v, float).reshape(int(a), int(b))[: int(min(h, h0)), : int(min(w, w0))].astype(np.int64) for v, a, b in ((now, h, w), (was, h0, w0)))
                both = (now >= 0) & (was >= 0)
                pairs, shared = np.unique(np.stack([now[both], was[both]], 1), axis=0, return_counts=True)
                rows.append(pd.DataFrame({"stack_id": stack_id, "frame": frame, "label": pairs[:, 0], "prev": pairs[:, 1], "shared": shared}))
            if rows:
                yield pd.concat(rows)

    both = meet(labels.select(*KEYS, "height", "width", "px"), before, KEYS).select(*KEYS, "height", "width", "px", "_h", "_w", "_px")
    return both.mapInPandas(run, "stack_id long, frame long, label long, prev long, shared long")


def track_regions(labels: DataFrame, min_overlap: int = 1) -> DataFrame:
    """Each region with its track, area, area change, and events.

    A region's parent is the region of the frame before with which it shares most pixels (ties: the
    smaller label). Label images of successive frames are compared where they lie, packed: a kernel gives
    the few pairs of labels that share pixels. A region takes its parent's track if it is that parent's main child (largest
    overlap, ties: the smaller label), else it starts a track. `event` is birth, split (a parent but
    not its main child), merge (more than one region before flows into it) or continue; `dies` says
    that no region follows. Track ids are `stack:frame:label` of the first region; the chain is
    followed by doubling over the small table of regions.
    """
    area, overlap = label_areas(labels), label_overlaps(labels).where(F.col("shared") >= min_overlap)
    area = cut(area)
    overlap = cut(overlap)
    parent = overlap.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS, "label").orderBy(F.desc("shared"), "prev"))).where("_r = 1").select(*KEYS, "label", F.col("prev").alias("parent"))
    main = overlap.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS, "prev").orderBy(F.desc("shared"), "label"))).where("_r = 1").select(*KEYS, F.col("prev").alias("parent"), F.col("label").alias("main"))
    inflow = meet(overlap, parent.select(*KEYS, "label", "parent"), [*KEYS, "label"]).groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("inflow"))
    rows = meet(meet(meet(area, parent, [*KEYS, "label"], "left"), main, [*KEYS, "parent"], "left"), inflow, [*KEYS, "label"], "left")
    rows = cut(rows.withColumn("follows", F.coalesce(F.col("main") == F.col("label"), F.lit(False))))
    # chain: (frame, label) -> start of its track
    link = cut(rows.select(*KEYS, "label", F.when(F.col("follows"), F.col("frame") - 1).otherwise(F.col("frame")).alias("f0"), F.when(F.col("follows"), F.col("parent")).otherwise(F.col("label")).alias("l0")))
    while True:
        up = link.select("stack_id", F.col("frame").alias("f0"), F.col("label").alias("l0"), F.col("f0").alias("f1"), F.col("l0").alias("l1"))
        new = cut(meet(link, up, ["stack_id", "f0", "l0"]).select(*KEYS, "label", F.col("f1").alias("f0"), F.col("l1").alias("l0"), ((F.col("f1") != F.col("f0")) | (F.col("l1") != F.col("l0"))).alias("moved")))
        link = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    child = main.select("stack_id", (F.col("frame") - 1).alias("frame"), F.col("parent").alias("label"), F.lit(True).alias("has_child"))
    out = meet(meet(rows, link, [*KEYS, "label"]), child, [*KEYS, "label"], "left")
    prior = area.select("stack_id", (F.col("frame") + 1).alias("frame"), F.col("label").alias("parent"), F.col("area").alias("area_before"))
    out = meet(out, prior, [*KEYS, "parent"], "left")
    event = F.when(F.col("parent").isNull(), "birth").when(~F.col("follows"), "split").when(F.col("inflow") > 1, "merge").otherwise("continue")
    return out.select(*KEYS, "label", F.concat_ws(":", "stack_id", "f0", "l0").alias("track"), "area", (F.col("area") - F.col("area_before")).alias("area_change"), event.alias("event"), F.col("has_child").isNull().alias("dies"))


def area_series(regions: DataFrame, frames: DataFrame, calib: DataFrame | None = None) -> DataFrame:
    """Total area, its fraction of the frame and its rate per frame (nm2, nm2/s with calibration); frames without regions have area 0."""
    total = regions.groupBy(*KEYS).agg(F.sum("area_px").alias("area_px"))
    out = meet(frames.select(*KEYS, (F.col("height") * F.col("width")).alias("_all")), total, KEYS, "left").fillna(0, ["area_px"])
    step = Window.partitionBy("stack_id").orderBy("frame")
    out = out.withColumn("fraction", F.col("area_px") / F.col("_all")).withColumn("rate", (F.col("area_px") - F.lag("area_px").over(step)) / (F.col("frame") - F.lag("frame").over(step)))
    if calib is not None:
        out = meet(out, calib, "stack_id").withColumn("area_nm2", F.col("area_px") * F.col("nm_per_px") * F.col("nm_per_px")).withColumn("rate_nm2_s", F.col("rate") * F.col("nm_per_px") * F.col("nm_per_px") / F.col("s_per_frame")).drop("nm_per_px", "s_per_frame")
    return out.drop("_all")


def _edges(rois: DataFrame) -> DataFrame:
    order, whole = Window.partitionBy("roi_id").orderBy("vertex"), Window.partitionBy("roi_id").orderBy("vertex").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rois.select("roi_id", "y", "x", *(F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"{c}2") for c in ("y", "x")), F.count(F.lit(1)).over(Window.partitionBy("roi_id")).alias("vertices"))


def polygon_area(rois: DataFrame) -> DataFrame:
    """Shoelace area, perimeter and centroid of each polygon; fewer than three vertices: null."""
    e = _edges(rois).withColumn("cross", F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    out = e.groupBy("roi_id").agg(F.max("vertices").alias("vertices"), (F.sum("cross") / 2).alias("a"), F.sum(F.sqrt((F.col("y2") - F.col("y")) ** 2 + (F.col("x2") - F.col("x")) ** 2)).alias("perimeter"), F.sum((F.col("y") + F.col("y2")) * F.col("cross")).alias("my"), F.sum((F.col("x") + F.col("x2")) * F.col("cross")).alias("mx"))
    ok = (F.col("vertices") >= 3) & (F.col("a") != 0)
    return out.select("roi_id", F.when(F.col("vertices") >= 3, F.abs("a")).alias("area"), F.when(F.col("vertices") >= 3, F.col("perimeter")).alias("perimeter"), F.when(ok, F.col("my") / (6 * F.col("a"))).alias("cy"), F.when(ok, F.col("mx") / (6 * F.col("a"))).alias("cx"))


def in_roi(pixels: DataFrame, rois: DataFrame, cell: int = 64) -> DataFrame:
    """Pixels (any table with y, x) inside each polygon by the even-odd rule, edges half-open; a pixel in several polygons has several rows.

    Whole-numbered pixels meet the polygons' spans of their row (`roi_spans`), cut at multiples of `cell` to
    spread rows over keys. Other places meet, in bands of `cell` rows, the edges that pass the band, and
    are tested by an expression. Only spans or edges travel, to all executors if their count allows it.
    """
    kinds = dict(pixels.dtypes)
    if {kinds["y"], kinds["x"]} <= {"int", "bigint", "smallint"}:
        first, last = F.floor(F.col("x0") / cell), F.floor((F.col("x1") - 1) / cell)
        spans = cut(roi_spans(rois).select("roi_id", F.col("y").alias("_y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.explode(F.sequence(first, last)).alias("_gx")))
        at = pixels.withColumn("_y", F.col("y").cast("int")).withColumn("_gx", F.floor(F.col("x") / cell))
        return at.join(small(spans), ["_y", "_gx"]).where("x >= _x0 and x < _x1").drop("_y", "_gx", "_x0", "_x1")
    bands = F.sequence(F.floor(F.least("y", "y2") / cell), F.floor(F.greatest("y", "y2") / cell))
    edges = cut(_edges(rois).where("vertices >= 3 and y <> y2").withColumn("_gy", F.explode(bands)))
    listed = edges.groupBy("roi_id", "_gy").agg(F.min(F.least("x", "x2")).alias("_x0"), F.max(F.greatest("x", "x2")).alias("_x1"), F.collect_list(F.struct("y", "x", "y2", "x2")).alias("_e"))
    listed = F.broadcast(listed) if edges.count() <= BROADCAST_ROWS else listed.hint("merge")
    both = pixels.withColumn("_gy", F.floor(F.col("y") / cell)).join(listed, "_gy").where("x >= _x0 and x < _x1")
    crosses = lambda s: ((s["y"] <= F.col("y")) != (s["y2"] <= F.col("y"))) & (F.col("x") < s["x"] + (F.col("y") - s["y"]) / (s["y2"] - s["y"]) * (s["x2"] - s["x"]))
    return both.where(F.size(F.filter("_e", crosses)) % 2 == 1).drop("_x0", "_x1", "_e", "_gy")


def classify_tiles(tiles: DataFrame, r_lo: float, r_hi: float, cut_at: float) -> DataFrame:
    """Crystallinity of each tile: the share of spectrum power above the radial mean, in a band of radii; class `crystalline` from cut_at."""

    def kernel(a: np.ndarray, _) -> dict:
        p = kernels.power(a)
        r = np.hypot(*np.meshgrid(kernels.centred_index(a.shape[1]), kernels.centred_index(a.shape[2]), indexing="ij"))
        band = (r >= r_lo) & (r <= r_hi)
        over = np.maximum(p - kernels.radial_mean(p), 0)[:, band].sum(1)
        total = p[:, band].sum(1)
        return {"crystallinity": np.where(total > 0, over / np.where(total > 0, total, 1), 0.0)}

    out = map_images(tiles, kernel, "crystallinity double", ["stack_id", "frame", "ty", "tx", "h", "w"], h="h", w="w")
    return out.withColumn("class", F.when(F.col("crystallinity") >= cut_at, "crystalline").otherwise("amorphous"))


def phase_fraction(classes: DataFrame) -> DataFrame:
    """Tiles and area fraction of the crystalline class per frame with its change, and per stack (frame null)."""
    part = F.col("h") * F.col("w")
    out = classes.rollup("stack_id", "frame").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("tiles"), F.sum(F.when(F.col("class") == "crystalline", part).otherwise(0)).alias("_c"), F.sum(part).alias("_a")).where("_g < 3")
    out = out.withColumn("fraction", F.col("_c") / F.col("_a"))
    change = F.when(F.col("_g") == 0, F.col("fraction") - F.lag("fraction").over(Window.partitionBy("stack_id", "_g").orderBy("frame")))
    return out.select("stack_id", "frame", "tiles", "fraction", change.alias("change"))
