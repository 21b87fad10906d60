"""Frame selection, depth, calibration, tiles, pixels, run records and comparison of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.arrays import long_form
from ..storage import meet, small

RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "float64": (0.0, 1.0)}


def chosen_keys(frames: DataFrame, every_n: int | None = None, every_s: float | None = None, start=None, end=None) -> DataFrame:
    """stack_id and frame of the frames inside [start, end), then each n-th by frame order, or the first of each time bucket. Slim: no payload is read."""
    if every_n is not None and every_s is not None:
        raise ValueError("give every_n or every_s")
    keys = frames.select("stack_id", "frame", "ts")
    if start is not None:
        keys = keys.where(F.col("ts") >= F.lit(start))
    if end is not None:
        keys = keys.where(F.col("ts") < F.lit(end))
    if every_n is not None:
        at = F.row_number().over(Window.partitionBy("stack_id").orderBy("ts", "frame")) - 1
        keys = keys.withColumn("_at", at).where(F.col("_at") % every_n == 0)
    elif every_s is not None:
        bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(int(every_s * 1_000_000)))
        first = keys.groupBy("stack_id", bucket.alias("_bucket")).agg(F.min(F.struct("ts", "frame")).alias("_first"))
        keys = first.select("stack_id", F.col("_first.frame").alias("frame"))
    return keys.select("stack_id", "frame")


def select_frames(frames: DataFrame, every_n: int | None = None, every_s: float | None = None, start=None, end=None) -> DataFrame:
    """Frames inside [start, end), then each n-th by frame order, or the first of each time bucket.

    Only keys go through the window; the payload is joined back.
    """
    if every_n is None and every_s is None:
        if start is not None:
            frames = frames.where(F.col("ts") >= F.lit(start))
        return frames if end is None else frames.where(F.col("ts") < F.lit(end))
    return meet(frames, chosen_keys(frames, every_n, every_s, start, end), ["stack_id", "frame"], "left_semi")


def convert_depth(frames: DataFrame, to: str, mode: str = "linear", lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Maps [lo, hi] (default: the range of the frame's dtype) onto the range of `to`, or clips into it; rounds half up to integers and keeps the old dtype."""
    t_lo, t_hi = RANGES[to]
    ends = [F.when(F.col("dtype") == k, F.lit(float(v[0]))) for k, v in RANGES.items()], [F.when(F.col("dtype") == k, F.lit(float(v[1]))) for k, v in RANGES.items()]
    low, high = (F.lit(float(lo)) if lo is not None else F.coalesce(*ends[0])), (F.lit(float(hi)) if hi is not None else F.coalesce(*ends[1]))

    def one(v):
        x = v if mode == "clip" else (v - low) / (high - low) * (t_hi - t_lo) + t_lo
        x = F.floor(x + 0.5).cast("double") if to != "float64" else x
        return F.when(F.isnan(v), v).otherwise(F.greatest(F.lit(float(t_lo)), F.least(F.lit(float(t_hi)), x)))

    return frames.withColumn("px", F.transform("px", one)).withColumn("old_dtype", F.col("dtype")).withColumn("dtype", F.lit(to))


def calibrate(df: DataFrame, calib: DataFrame, lengths: list[str] = ("y", "x"), frame: str | None = "frame") -> DataFrame:
    """Adds <length>_nm and time_s; stacks without a calibration are an error that lists some of them."""
    known = small(calib.select("stack_id", "nm_per_px", "s_per_frame"))
    missing = [r[0] for r in df.select("stack_id").distinct().join(known, "stack_id", "left_anti").limit(10).collect()]
    if missing:
        raise ValueError(f"no calibration for stacks such as {sorted(missing)}")
    out = df.join(known, "stack_id", "left")
    for c in lengths:
        out = out.withColumn(f"{c}_nm", F.col(c) * F.col("nm_per_px"))
    return out.withColumn("time_s", F.col(frame) * F.col("s_per_frame")) if frame else out


def to_tiles(frames: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """Tiles of size x size with a halo, cut off at the frame's edges; y0, x0, h, w are those of the tile with its halo."""
    schema.require(frames, schema.FRAMES, "stack_id", "frame", "height", "width", "px")
    t = frames.select("stack_id", "frame", "height", "width", "px", F.explode(F.expr(f"sequence(0, cast((height - 1) div {size} as int))")).alias("ty"))
    t = t.select("*", F.explode(F.expr(f"sequence(0, cast((width - 1) div {size} as int))")).alias("tx"))
    for a, n, k in (("y", "height", "ty"), ("x", "width", "tx")):
        t = t.withColumn(f"{a}0", F.greatest(F.lit(0), F.col(k) * size - halo)).withColumn("h" if a == "y" else "w", F.least(F.col(n), (F.col(k) + 1) * size + halo) - F.greatest(F.lit(0), F.col(k) * size - halo))
    px = F.flatten(F.transform(F.expr("sequence(0, h - 1)"), lambda r: F.slice("px", (F.col("y0") + r) * F.col("width") + F.col("x0") + 1, F.col("w"))))
    return t.select("stack_id", "frame", "ty", "tx", "y0", "x0", "h", "w", F.lit(halo).alias("halo"), px.alias("px"))


def from_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """Frames from tiles: (stack_id, frame, height, width, px); cores only, so the halo does not matter."""
    core = tiles.withColumn("cy", F.col("ty") * size - F.col("y0")).withColumn("cx", F.col("tx") * size - F.col("x0"))
    core = core.withColumn("ch", F.least(F.lit(size), F.col("h") - F.col("cy"))).withColumn("cw", F.least(F.lit(size), F.col("w") - F.col("cx")))
    rows = core.select("stack_id", "frame", "ty", "tx", "cw", "ch", F.explode(F.transform(F.expr("sequence(0, ch - 1)"), lambda r: F.struct((F.col("ty") * size + r).alias("y"), F.slice("px", (F.col("cy") + r) * F.col("w") + F.col("cx") + 1, F.col("cw")).alias("part")))).alias("r"))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col("r.y").alias("y"), "tx", F.col("r.part").alias("part"))))
    out = rows.groupBy("stack_id", "frame").agg(sorted_.alias("p"), (F.max("r.y") + 1).alias("height"))
    px = F.flatten(F.transform("p", lambda s: s["part"]))
    return out.select("stack_id", "frame", F.col("height").cast("int").alias("height"), (F.size(px) / F.col("height")).cast("int").alias("width"), px.alias("px"))


def to_pixels(frames: DataFrame) -> DataFrame:
    return long_form(frames, ["stack_id", "frame"])


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Packed frames; pixels that are not there are NaN up to the largest y and x; of a pixel that is there twice the largest value counts. A frame's pixels are laid out at once, in time proportional to their number."""
    kinds = dict(pixels.dtypes)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in ("stack_id", "frame")]
            sorts = [np.asarray(k) for key in keys for k in (key.is_null(), key.fill_null(0))]
            order = np.lexsort(sorts)
            new = np.any([np.diff(k[order].astype(np.int64), prepend=0) != 0 for k in sorts], 0)
            new[0] = True
            first = np.flatnonzero(new)
            ends = pa.array(np.append(first, len(order)), pa.int32())
            packed = [pa.ListArray.from_arrays(ends, batch.column(c).take(pa.array(order))) for c in "yxv"]
            yield pa.RecordBatch.from_arrays([*(k.take(pa.array(order[first])) for k in keys), *packed], names=["stack_id", "frame", "y", "x", "v"])

    # a task packs what it holds of a frame, so that packed pieces travel and no pixel is a row of a shuffle
    packed = pixels.select("stack_id", "frame", "y", "x", "v").mapInArrow(pieces, ", ".join([*(f"{c} {kinds[c]}" for c in ("stack_id", "frame")), *(f"{c} array<{kinds[c]}>" for c in "yxv")]))
    listed = packed.groupBy("stack_id", "frame").agg(F.collect_list(F.struct("y", "x", "v")).alias("_p"))
    listed = listed.select("stack_id", "frame", *(F.flatten(F.col(f"_p.{c}")).alias(f"_{c}") for c in "yxv"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                y, x = (np.asarray(c, np.int64) for c in row[2:4])
                v = np.asarray(row[4], float)
                order = np.argsort(np.where(np.isnan(v), -np.inf, v), kind="stable")
                px = np.full((y.max() + 1, x.max() + 1), np.nan)
                px[y[order], x[order]] = v[order]
                rows.append((row[0], row[1], *px.shape, px.ravel()))
            yield pd.DataFrame(rows, columns=["stack_id", "frame", "height", "width", "px"])

    out = listed.mapInPandas(run, "stack_id long, frame long, height int, width int, px array<double>")
    return out.withColumn("px", F.transform("px", lambda v: F.coalesce(v, F.lit(float("nan")))))


def with_manifest(df: DataFrame, operator: str, version: str, params: dict, units: dict, source: str = "") -> tuple[DataFrame, DataFrame]:
    """df stamped with a run_id, and the run's one-row manifest; the id is a hash of what was run, so equal runs have equal ids."""
    spark = df.sparkSession
    texts = {k: str(v) for k, v in sorted(params.items())}
    about = "|".join([operator, version, source, *(f"{k}={v}" for k, v in texts.items())])
    run = spark.range(1).select(F.md5(F.lit(about)).alias("run_id"), F.lit(operator).alias("operator"), F.lit(version).alias("version"), F.lit(source).alias("input"), _map(texts).alias("params"), _map({k: str(v) for k, v in sorted(units.items())}).alias("units"), F.current_timestamp().alias("started"))
    return df.withColumn("run_id", F.md5(F.lit(about))), run


def append_manifest(run: DataFrame, path: str) -> None:
    """Appends a run's row to the manifest table at `path`, which is kept by run: a repeated or retried run replaces its own row, whatever else is there."""
    schema.require(run, schema.MANIFEST)
    run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest table; results are joined with it by run_id."""
    return spark.read.schema(schema.MANIFEST).parquet(path)


def _map(values: dict):
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv)) if values else F.create_map().cast("map<string,string>")


def compare_runs(before: DataFrame, after: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """One row a key: both values, their difference for each column of `tolerances`, and a status; NaN equals NaN, null equals null."""
    a, b = before.select(*keys, *tolerances, F.lit(1).alias("_a")).alias("a"), after.select(*keys, *tolerances, F.lit(1).alias("_b")).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = meet(a, b, on, "full_outer")
    same, within, out = F.lit(True), F.lit(True), [F.when(F.col("_a").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    for c, most in tolerances.items():
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        same &= x.eqNullSafe(y)
        within &= x.eqNullSafe(y) | F.coalesce(F.abs(y - x) <= most, F.lit(False))
        out += [x.alias(f"{c}_before"), y.alias(f"{c}_after"), (y - x).alias(f"{c}_diff")]
    status = F.when(F.col("_b").isNull(), "only_before").when(F.col("_a").isNull(), "only_after").when(same, "same").when(within, "within").otherwise("beyond")
    return both.select(*out, status.alias("status"))
