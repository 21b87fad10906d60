"""Drift: shifts between frames, their repair and sum, and moving frames back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.arrays import map_images, stacked
from ..storage import meet
from ..sources.stacks import read_frames, write_frames
from .frames import append_manifest, chosen_keys, read_manifest, with_manifest

#: Frame numbers of a stack that meet one copy of its first frame.
PIECE = 256


def pair_shifts(frames: DataFrame, max_shift: int, upsample: bool | int = False, against: str = "previous") -> DataFrame:
    """stack_id, frame, dy, dx, ncc of each frame against the previous or the first of its stack.

    An equi join on keys pairs the payloads, so no window holds images. Against the first, a stack's frames
    meet copies of its first frame, one for each PIECE frame numbers, so no stack meets in one task. A frame
    whose previous number is missing has no row. ncc is null where the overlap is constant. Whole pixels, or
    with upsample True a parabola's vertex, or with a number steps of 1 / upsample of a pixel.
    """
    keys = frames.select("stack_id", "frame", "height", "width", "px")
    if against == "previous":
        other = keys.select("stack_id", (F.col("frame") + 1).alias("frame"), F.col("px").alias("px0"), F.col("height").alias("h0"), F.col("width").alias("w0"))
        pairs = meet(keys, other, ["stack_id", "frame"])
    elif against == "first":
        piece = lambda f: F.floor(F.col(f) / PIECE)
        first = frames.groupBy("stack_id").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
        other = meet(keys, first.withColumn("frame", F.col("f0")), ["stack_id", "frame"]).select("stack_id", "f0", F.explode(F.sequence(piece("f0"), piece("f1"))).alias("_piece"), F.col("px").alias("px0"), F.col("height").alias("h0"), F.col("width").alias("w0"))
        pairs = meet(keys.withColumn("_piece", piece("frame")), other, ["stack_id", "_piece"]).where("frame > f0")
    else:
        raise ValueError("against is 'previous' or 'first'")
    pairs = pairs.where("height = h0 and width = w0")

    def kernel(b: np.ndarray, part: pd.DataFrame) -> dict:
        dy, dx, ncc = kernels.ncc_shift(stacked(part, *b.shape[1:], "px0"), b, max_shift, upsample)
        return {"dy": dy, "dx": dx, "ncc": ncc}

    return map_images(pairs, kernel, "dy double, dx double, ncc double", ["stack_id", "frame"], extra=["px0"])


def accumulate(shifts: DataFrame) -> DataFrame:
    """Adds drift_y, drift_x: the sum of shifts up to each frame."""
    upto = Window.partitionBy("stack_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shifts.withColumn("drift_y", F.sum("dy").over(upto)).withColumn("drift_x", F.sum("dx").over(upto))


def repair_shifts(shifts: DataFrame, min_ncc: float, half_window: int) -> DataFrame:
    """Replaces shifts of low (or NaN, or null) ncc by the median of accepted ones nearby; none: 0. `repaired` is 'kept', 'median' or 'zero'."""
    good = F.coalesce((F.col("ncc") >= min_ncc) & ~F.isnan("ncc"), F.lit(False))
    near = Window.partitionBy("stack_id").orderBy("frame").rowsBetween(-half_window, half_window)
    out = shifts.withColumn("_good", good)
    for c in ("dy", "dx"):
        out = out.withColumn(f"_{c}", F.percentile(F.when(F.col("_good"), F.col(c)), F.lit(0.5)).over(near))
    flag = F.when(F.col("_good"), "kept").when(F.col("_dy").isNotNull(), "median").otherwise("zero")
    out = out.withColumn("repaired", flag)
    for c in ("dy", "dx"):
        out = out.withColumn(f"_{c}", F.when(F.col("_good"), F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.lit(0.0))))
    return out.withColumn("dy", F.col("_dy")).withColumn("dx", F.col("_dx")).drop("_good", "_dy", "_dx")


def apply_shift(frames: DataFrame, drift: DataFrame, crop: bool = True) -> DataFrame:
    """Frames moved by minus their drift; frames without a row in `drift` stay. Cropped to the area common to the stack, or NaN outside."""
    own = meet(frames.select("stack_id", "frame"), drift.select("stack_id", "frame", "drift_y", "drift_x"), ["stack_id", "frame"], "left").fillna(0.0, ["drift_y", "drift_x"])
    bounds = own.groupBy("stack_id").agg(*(f(F.ceil(c) if f is F.max else F.floor(c)).cast("int").alias(f"{n}_{c}") for c in ("drift_y", "drift_x") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    moved = meet(frames, meet(own, bounds, "stack_id"), ["stack_id", "frame"])  # bounds meet the slim keys, the payload only its own row

    def kernel(a: np.ndarray, part: pd.DataFrame) -> dict:
        out = {"px": [], "height": [], "width": [], "y0": [], "x0": []}
        for image, row in zip(a, part.itertuples(index=False), strict=True):
            image = kernels.shifted(image, row.drift_y, row.drift_x)
            y0, x0, y1, x1 = 0, 0, *image.shape
            if crop:
                y0, x0, y1, x1 = max(0, -row.lo_drift_y), max(0, -row.lo_drift_x), min(y1, y1 - row.hi_drift_y), min(x1, x1 - row.hi_drift_x)
            image = image[y0 : max(y0, y1), x0 : max(x0, x1)]
            for k, v in zip(out, (image.ravel(), image.shape[0], image.shape[1], y0, x0), strict=True):
                out[k].append(v)
        return out

    named = moved.withColumnRenamed("height", "_h").withColumnRenamed("width", "_w").withColumnRenamed("px", "_px")
    keep = ["stack_id", "frame", "ts", "dtype"]
    return map_images(named, kernel, "px array<double>, height int, width int, y0 int, x0 int", keep, px="_px", h="_h", w="_w", extra=["drift_y", "drift_x", "lo_drift_y", "hi_drift_y", "lo_drift_x", "hi_drift_x"])


def video_pipeline(frames: DataFrame, select: dict, max_shift: int, min_ncc: float = 0.5, half_window: int = 2, crop: bool = True) -> DataFrame:
    """Selection, then shifts, repair, sum and correction; selected frames are numbered anew."""
    order = chosen_keys(frames, **select).withColumn("_new", (F.row_number().over(Window.partitionBy("stack_id").orderBy("frame")) - 1).cast("long"))
    chosen = meet(frames, order, ["stack_id", "frame"]).drop("frame").withColumnRenamed("_new", "frame")
    drift = accumulate(repair_shifts(pair_shifts(chosen, max_shift), min_ncc, half_window))
    return apply_shift(chosen, drift, crop)


def video_run(frames: DataFrame, out: str, select: dict, max_shift: int, min_ncc: float = 0.5, half_window: int = 2, crop: bool = True, source: str = "") -> tuple[DataFrame, DataFrame]:
    """The video pipeline to files: corrected frames stamped with their run, written and read back, and the run's manifest, appended to the table at `out`-run."""
    spark = frames.sparkSession
    params = {**select, "max_shift": max_shift, "min_ncc": min_ncc, "half_window": half_window, "crop": crop}
    rows, run = with_manifest(video_pipeline(frames, select, max_shift, min_ncc, half_window, crop), "video_pipeline", "1", params, {"max_shift": "px", "half_window": "frames"}, source)
    write_frames(rows, out, [source] if source else [])
    append_manifest(run, f"{out.rstrip('/')}-run")
    return read_frames(spark, out), read_manifest(spark, f"{out.rstrip('/')}-run")
