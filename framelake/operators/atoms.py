"""Atom detection, refinement, intensity, classes, model inference and scoring of detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.arrays import by_size, explode_images, long_form, stacked
from ..storage import meet
from .frames import to_tiles

KEYS = ["stack_id", "frame"]


def detect_peaks(frames: DataFrame, radius: int, threshold: float, border: int = 0, tile: int | None = None) -> DataFrame:
    """POINTS: pixels above threshold that exceed all others within `radius` rows and columns; a plateau's first pixel in (y, x). point_id is y * width + x.

    With `tile`, frames are cut into tiles with a halo of `radius`; a tile owns its core only.
    """
    if tile is None:

        def kernel(a: np.ndarray, part: pd.DataFrame) -> pd.DataFrame:
            found = kernels.peaks(a, radius, threshold, border)
            n = [len(p) for p in found]
            yx = np.concatenate(found) if found else np.zeros((0, 2), int)
            at = np.repeat(np.arange(len(a)), n)
            return pd.DataFrame({"stack_id": part["stack_id"].to_numpy()[at], "frame": part["frame"].to_numpy()[at], "point_id": yx[:, 0] * a.shape[2] + yx[:, 1], "y": yx[:, 0].astype(float), "x": yx[:, 1].astype(float), "intensity": a[at, yx[:, 0], yx[:, 1]]})

        return explode_images(frames, kernel, "stack_id long, frame long, point_id long, y double, x double, intensity double", KEYS)
    tiles = meet(to_tiles(frames, tile, radius), frames.select(*KEYS, "height", "width"), KEYS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, h, w in by_size(pdf, "h", "w"):
                a = stacked(part, int(h), int(w))
                found = kernels.peaks(a, radius, threshold, 0)
                at, yx = np.repeat(np.arange(len(a)), [len(k) for k in found]), np.concatenate(found)
                of = part.iloc[at]
                y, x = yx[:, 0] + of["y0"].to_numpy(), yx[:, 1] + of["x0"].to_numpy()
                own = (y // tile == of["ty"].to_numpy()) & (x // tile == of["tx"].to_numpy()) & (y >= border) & (x >= border) & (y < of["height"].to_numpy() - border) & (x < of["width"].to_numpy() - border)
                made = pd.DataFrame({"stack_id": of["stack_id"].to_numpy(), "frame": of["frame"].to_numpy(), "point_id": y * of["width"].to_numpy() + x, "y": y.astype(float), "x": x.astype(float), "intensity": a[at, yx[:, 0], yx[:, 1]]})
                yield made[own]

    return tiles.mapInPandas(run, "stack_id long, frame long, point_id long, y double, x double, intensity double")


def _windows(points: DataFrame, frames: DataFrame, reach: int, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame], pd.DataFrame], out: str, tile: int | None) -> DataFrame:
    """Runs a kernel on the windows of `reach` pixels around the pixel nearest each point.

    Points meet the image that owns their pixel by an equi join: the whole frame, or with `tile` the tile of
    that core size whose halo holds the window, so that no frame need fit a task. Points beyond an edge
    belong to the nearest tile. All windows of a batch are gathered by one index array: the kernel gets
    values (points x pixels, NaN outside the frame), the pixels' y and x, and the points.
    """
    columns = ["point_id", "y", "x", *(["intensity"] if "intensity" in points.columns else [])]
    named = points.select(*KEYS, F.struct(*columns).alias("_p"))
    if tile is None:
        images = frames.select(*KEYS, "height", "width", F.lit(0).alias("y0"), F.lit(0).alias("x0"), F.col("height").alias("h"), F.col("width").alias("w"), "px")
        keys = KEYS
    else:
        size = frames.select(*KEYS, "height", "width")
        images = meet(to_tiles(frames, tile, reach), size, KEYS).drop("halo")
        owner = lambda c, n: F.expr(f"cast(greatest(0, least({n} - 1, floor(_p.{c} + 0.5D))) div {tile} as int)")
        named = meet(named, size, KEYS).select(*KEYS, owner("y", "height").alias("ty"), owner("x", "width").alias("tx"), "_p")
        keys = [*KEYS, "ty", "tx"]
    listed = named.groupBy(*keys).agg(F.collect_list("_p").alias("_p")).select(*keys, *(F.col(f"_p.{c}").alias(f"_{c}") for c in columns))
    both = meet(images, listed, keys).select(*KEYS, "height", "width", "y0", "x0", "h", "w", "px", *(f"_{c}" for c in columns))
    dy, dx = (d.ravel() for d in np.mgrid[-reach : reach + 1, -reach : reach + 1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, h, w in by_size(pdf, "h", "w"):
                image = stacked(part, int(h), int(w))
                own = np.repeat(np.arange(len(part)), part["_y"].map(len).to_numpy())
                p = pd.DataFrame({c: np.concatenate(part[f"_{c}"].to_list()) for c in columns})
                for s in range(0, len(p), STEP):
                    at, some = own[s : s + STEP], p.iloc[s : s + STEP]
                    of = part.iloc[at]
                    top, left, height, width = (of[c].to_numpy()[:, None] for c in ("y0", "x0", "height", "width"))
                    y = np.floor(some["y"].to_numpy() + 0.5).astype(int)[:, None] + dy
                    x = np.floor(some["x"].to_numpy() + 0.5).astype(int)[:, None] + dx
                    inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
                    v = image[at[:, None], np.clip(y - top, 0, int(h) - 1), np.clip(x - left, 0, int(w) - 1)]
                    made = kernel(np.where(inside, v, np.nan), y, x, some)
                    yield of[KEYS].reset_index(drop=True).join(made.reset_index(drop=True), how="inner")

    return both.mapInPandas(run, f"stack_id long, frame long, {out}")


#: Points whose windows are gathered at once.
STEP = 20_000


def refine_centroids(points: DataFrame, frames: DataFrame, radius: int, tile: int | None = None) -> DataFrame:
    """Moves each point to the intensity-weighted centre of its window, the window's minimum taken off; a window without a number, or of one value, leaves it. With `tile`, in haloed tiles, with the same result."""

    def kernel(v: np.ndarray, y: np.ndarray, x: np.ndarray, p: pd.DataFrame) -> pd.DataFrame:
        some = ~np.isnan(v)
        low = np.where(some, v, np.inf).min(1, keepdims=True)
        v = np.where(some, v - np.where(np.isfinite(low), low, 0), 0)
        total = v.sum(1)
        moved = total > 0
        safe = np.where(moved, total, 1)
        return p[["point_id"]].assign(y=np.where(moved, (v * y).sum(1) / safe, p["y"]), x=np.where(moved, (v * x).sum(1) / safe, p["x"]), intensity=p["intensity"])

    return _windows(points, frames, radius, kernel, "point_id long, y double, x double, intensity double", tile)


def atom_intensity(points: DataFrame, frames: DataFrame, radius: float, tile: int | None = None) -> DataFrame:
    """Sum, mean, max and count of the pixels within `radius` of each point; NaN does not count, a point without a pixel has no row. With `tile`, in haloed tiles, with the same result."""

    def kernel(v: np.ndarray, y: np.ndarray, x: np.ndarray, p: pd.DataFrame) -> pd.DataFrame:
        near = ((y - p["y"].to_numpy()[:, None]) ** 2 + (x - p["x"].to_numpy()[:, None]) ** 2 <= radius * radius) & ~np.isnan(v)
        n, total = near.sum(1), np.where(near, v, 0).sum(1)
        return p[["point_id"]].assign(sum=total, mean=total / np.maximum(n, 1), max=np.where(near, v, -np.inf).max(1), n=n)

    out = _windows(points, frames, int(np.ceil(radius)) + 1, kernel, "point_id long, sum double, mean double, max double, n long", tile)
    return out.where("n > 0")


def classify_atoms(points: DataFrame, k: int | None = None, cuts: list[float] | None = None, seed: int = 7) -> DataFrame:
    """Adds class by intensity: number of cut-offs at or below it, or seeded k-means over the intensities, weighted by their points, with classes ordered by centre."""
    if cuts is not None:
        return points.withColumn("class", sum((F.when(F.col("intensity") >= c, 1).otherwise(0) for c in cuts), F.lit(0)))
    assembler = VectorAssembler(inputCols=["intensity"], outputCol="_v")
    packed = assembler.transform(points)
    # equal intensities are one weighted row, dealt by a shuffle: no task holds the points of a large file
    weighted = assembler.transform(points.groupBy("intensity").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", weightCol="_n").fit(weighted)
    order = {int(c): i for i, c in enumerate(np.argsort([c[0] for c in model.clusterCenters()]))}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    return model.transform(packed).withColumn("class", F.element_at(rank, F.col("_c"))).drop("_v", "_c")


def predict_atoms(tiles: DataFrame, model: str | Callable[[np.ndarray], list[np.ndarray]], threshold: float, size: int) -> DataFrame:
    """POINTS from a model over tiles of core `size`: an ONNX file of (n, 1, h, w) -> (n, 1, h, w) scores, or a function of (n, h, w) that gives arrays of (y, x, score) rows.

    The model is loaded once for each batch iterator. Points in a tile's halo belong to its neighbour and are dropped.
    """

    def scorer() -> Callable[[np.ndarray], list[np.ndarray]]:
        if callable(model):
            return model
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name

        def run_model(a: np.ndarray) -> list[np.ndarray]:
            scores = session.run(None, {name: a[:, None].astype(np.float32)})[0][:, 0]
            return [np.column_stack([yx, s[yx[:, 0], yx[:, 1]]]) for s, yx in zip(scores, kernels.peaks(scores, 1, threshold, 0), strict=True)]

        return run_model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for pdf in batches:
            rows = []
            for part, h, w in by_size(pdf, "h", "w"):
                for row, found in zip(part.itertuples(index=False), score(stacked(part, int(h), int(w))), strict=True):
                    for y, x, s in found:
                        gy, gx = y + row.y0, x + row.x0
                        if s > threshold and gy // size == row.ty and gx // size == row.tx:
                            rows.append((row.stack_id, row.frame, int(gy) << 32 | int(gx), float(gy), float(gx), float(s)))
            yield pd.DataFrame(rows, columns=["stack_id", "frame", "point_id", "y", "x", "intensity"])

    return tiles.mapInPandas(run, "stack_id long, frame long, point_id long, y double, x double, intensity double")


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """All pairs (columns of a as a struct, of b as a struct, d) within `reach`, by an equi join on grid cells with a residual distance test."""
    near = F.expr("sequence(-1, 1)")
    left = a.select(*keys, F.struct(*[c for c in a.columns if c not in keys]).alias("a")).withColumn("gy", F.floor(F.col("a.y") / reach)).withColumn("gx", F.floor(F.col("a.x") / reach))
    left = left.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).withColumn("gy", F.col("gy") + F.col("_i")).withColumn("gx", F.col("gx") + F.col("_j")).drop("_i", "_j")
    right = b.select(*keys, F.struct(*[c for c in b.columns if c not in keys]).alias("b")).withColumn("gy", F.floor(F.col("b.y") / reach)).withColumn("gx", F.floor(F.col("b.x") / reach))
    d = F.sqrt((F.col("a.y") - F.col("b.y")) ** 2 + (F.col("a.x") - F.col("b.x")) ** 2)
    return meet(left, right, [*keys, "gy", "gx"]).withColumn("d", d).where(F.col("d") <= reach).drop("gy", "gx")


def score_detections(pred: DataFrame, truth: DataFrame, max_dist: float) -> DataFrame:
    """tp, fp, fn, precision, recall and mean error per stack: a pair counts if each is the other's nearest (ties: smaller id) within max_dist."""
    pairs = near_pairs(pred.select(*KEYS, "point_id", "y", "x"), truth.select(*KEYS, "point_id", "y", "x"), KEYS, max_dist)
    first = lambda own, other: F.row_number().over(Window.partitionBy(*KEYS, f"{own}.point_id").orderBy("d", f"{other}.point_id"))
    hits = pairs.withColumn("_p", first("a", "b")).withColumn("_t", first("b", "a")).where("_p = 1 and _t = 1").groupBy("stack_id").agg(F.count(F.lit(1)).alias("tp"), F.avg("d").alias("mean_error"))
    n = meet(pred.groupBy("stack_id").agg(F.count(F.lit(1)).alias("np")), truth.groupBy("stack_id").agg(F.count(F.lit(1)).alias("nt")), "stack_id", "full_outer")
    n = meet(n, hits, "stack_id", "left").fillna(0, ["np", "nt", "tp"])
    return n.select("stack_id", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"), F.when(F.col("np") > 0, F.col("tp") / F.col("np")).alias("precision"), F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).alias("recall"), "mean_error")
