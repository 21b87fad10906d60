"""Frequency and spatial filters, contrast and temporal denoising.

Methods are our choice, from published work: the background-based Wiener and background-subtraction
filters follow Kilaas (1998) and Marks (1996) in form. Spectra are centred; radii are in frequency
steps. Frames keep their size. NaN pixels make a whole spectrum NaN: fill them first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.arrays import VALUES, explode_images, long_form, map_images
from ..storage import cut, meet, small
from .frames import from_tiles, to_tiles

KEYS = ["stack_id", "frame"]


def power_spectrum(frames: DataFrame, window: str = "none") -> DataFrame:
    """Centred power spectrum as px, same size."""
    return map_images(frames.withColumnRenamed("px", "_px"), lambda a, _: {"px": kernels.power(a, window).reshape(len(a), -1)}, "px array<double>", [*KEYS, "height", "width"], px="_px")


def radial_profile(frames: DataFrame, bin: float = 1.0, centre: tuple[float, float] | None = None, angle_from: float | None = None, angle_to: float | None = None) -> DataFrame:
    """stack_id, frame, r, mean, n by radius bin floor(radius / bin + 0.5); default centre: height div 2, width div 2. Angles by atan2(y, x), half-open. Frames are summed where they lie; only sums travel."""

    def kernel(a: np.ndarray, part: pd.DataFrame) -> pd.DataFrame:
        h, w = a.shape[1:]
        cy, cx = (h // 2, w // 2) if centre is None else centre
        dy, dx = np.meshgrid(np.arange(h) - cy, np.arange(w) - cx, indexing="ij")
        r = np.floor(np.sqrt(dy * dy + dx * dx) / bin + 0.5).astype(np.int64).ravel()
        angle = np.arctan2(dy, dx).ravel()
        inside = np.ones(h * w, bool) if angle_from is None else (angle >= angle_from) & (angle < angle_to)
        v, most = a.reshape(len(a), -1)[:, inside], int(r.max(initial=-1)) + 1
        at, some = (np.arange(len(v))[:, None] * most + r[inside]).ravel(), ~np.isnan(v.ravel())
        n = np.bincount(at[some], minlength=len(v) * most)
        total = np.bincount(at[some], v.ravel()[some], minlength=len(v) * most)
        there = np.flatnonzero(n)
        own = there // max(1, most)
        return pd.DataFrame({**{c: part[c].to_numpy()[own] for c in KEYS}, "r": there % max(1, most), "sum": total[there], "n": n[there]})

    found = explode_images(frames, kernel, "stack_id long, frame long, r long, sum double, n long", KEYS)
    return found.groupBy(*KEYS, "r").agg((F.sum("sum") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def _spectral(frames: DataFrame, gain) -> DataFrame:
    keep = [c for c in frames.columns if c != "px"]
    return map_images(frames.withColumnRenamed("px", "_px"), lambda a, _: {"px": kernels.spectral(a, gain).reshape(len(a), -1)}, "px array<double>", keep, px="_px")


def wiener(frames: DataFrame) -> DataFrame:
    """Multiplies the spectrum by max(0, (P - B) / P), B the radial mean of P."""
    return _spectral(frames, kernels.wiener_gain)


def absf(frames: DataFrame) -> DataFrame:
    """Multiplies the amplitude by max(0, (sqrt P - sqrt B) / sqrt P)."""
    return _spectral(frames, kernels.absf_gain)


def band_filter(frames: DataFrame, r_lo: float, r_hi: float, soft: float = 0.0) -> DataFrame:
    """Keeps radii from r_lo to r_hi; outside, a Gaussian of width `soft` (0: nothing)."""
    return _spectral(frames, lambda p: kernels.band_gain(*p.shape[1:], r_lo, r_hi, soft))


def spatial_filter(frames: DataFrame, kind: str, size: int, tile: int | None = None) -> DataFrame:
    """Neighbourhood filter of odd width `size`, edges mirrored: mean, gauss, median or sharpen. With `tile`, frames are filtered in haloed tiles, with the same result."""
    r = size // 2
    if tile is None:
        keep = [c for c in frames.columns if c != "px"]
        return map_images(frames.withColumnRenamed("px", "_px"), lambda a, _: {"px": kernels.spatial(a, kind, r).reshape(len(a), -1)}, "px array<double>", keep, px="_px")
    tiles = to_tiles(frames, tile, max(size, r))  # wide enough that mirrored edges of a tile never reach its core
    return map_images(tiles.withColumnRenamed("px", "_px"), lambda a, _: {"px": kernels.spatial(a, kind, r).reshape(len(a), -1)}, "px array<double>", ["stack_id", "frame", "ty", "tx", "y0", "x0", "h", "w", "halo"], px="_px", h="h", w="w")


def stretch(frames: DataFrame, p_lo: float, p_hi: float, gamma: float = 1.0, per: str = "frame") -> DataFrame:
    """Maps the percentiles p_lo and p_hi (0 to 1) of each frame or stack to 0 and 1, clips, and raises to gamma; a constant frame becomes 0."""
    if per == "frame":  # a frame is one row: its percentiles need no shuffle

        def ends_of(a: np.ndarray, _) -> dict:
            flat = [v[~np.isnan(v)] for v in a.reshape(len(a), -1)]
            return {name: [float(np.quantile(v, q)) if len(v) else None for v in flat] for name, q in (("_lo", p_lo), ("_hi", p_hi))}

        kept = [c for c in frames.columns if c not in ("height", "width", "px")]
        frames = map_images(frames, ends_of, "_lo double, _hi double", [*kept, "height", "width", "px"]).where("_lo is not null").select(*frames.columns, "_lo", "_hi")
    else:
        px = long_form(frames, KEYS).where(~F.isnan("v"))
        ends = px.groupBy("stack_id").agg(F.percentile("v", F.lit(p_lo)).alias("_lo"), F.percentile("v", F.lit(p_hi)).alias("_hi"))
        frames = frames.join(small(cut(ends)), "stack_id")
    scaled = lambda v: F.when(F.isnan(v), v).when(F.col("_hi") > F.col("_lo"), F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))), F.lit(gamma))).otherwise(0.0)
    return frames.withColumn("px", F.transform("px", scaled)).drop("_lo", "_hi")


def bin_of(v, lo: float, hi: float, bins: int):
    """Bin 0 to bins - 1 with a closed right edge; -1 below, `bins` above."""
    return F.when(v < lo, -1).when(v > hi, bins).when(v == hi, bins - 1).otherwise(F.floor((v - lo) / (hi - lo) * bins)).cast("int")


def equalise(frames: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """Maps each value to the share of the frame's pixels in its bin or below (over- and underflow in the outer bins)."""
    from .regions import histogram

    counts = histogram(frames, lo, hi, bins).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.col("bin"))))
    counts = counts.groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*KEYS).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    shares = counts.withColumn("c", F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(*KEYS)))
    table = shares.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_map"))
    look = lambda v: F.when(F.isnan(v), v).otherwise(F.element_at("_map", F.greatest(F.lit(0), F.least(F.lit(bins - 1), bin_of(v, lo, hi, bins)))))
    return meet(frames, table, KEYS).withColumn("px", F.transform("px", look)).drop("_map")


def temporal_denoise(frames: DataFrame, half_window: int, stat: str = "mean", chunk: int = 16, tile: int | None = None) -> DataFrame:
    """Each pixel's mean or median over the frames of its size from -half_window to half_window; missing frames are left out.

    Frame numbers are cut into chunks of `chunk`, and a frame goes to the chunks that its window reaches, so it
    is sent 1 + 2 * half_window / chunk times on average, and a task holds chunk + 2 * half_window frames, of
    which with `tile` only one tile. A chunk's frames are gone through in order, keeping the window's
    frames, or for the median each pixel's values in order of size (`kernels.SortedWindow`). Chunks lie
    in order within partitions and are gone through one by one, as small ones would each cost a call otherwise.
    """
    if stat not in ("mean", "median"):
        raise ValueError("stat is 'mean' or 'median'")
    if tile is None:
        parts, at = frames.select(*KEYS, "height", "width", F.col("height").alias("h"), F.col("width").alias("w"), "px"), []
    else:
        at = ["ty", "tx", "y0", "x0"]
        parts = meet(to_tiles(frames, tile), frames.select(*KEYS, "height", "width"), KEYS).select(*KEYS, "height", "width", "h", "w", "px", *at)
    reach = F.sequence(F.expr(f"floor((frame - {half_window}) / {chunk})"), F.expr(f"floor((frame + {half_window}) / {chunk})"))
    sent = parts.withColumn("_chunk", F.explode(reach))

    keys, fixed = ["stack_id", "_chunk", "height", "width", *at[:2]], ["stack_id", "height", "width", "h", "w", *at]
    dealt = sent.repartition(*keys).sortWithinPartitions(*keys, "frame").select(*fixed, "_chunk", "frame", "px")

    def smoothed(of: tuple, numbers: np.ndarray, px: list[np.ndarray]) -> Iterator[tuple]:
        """The frames of one chunk, which may hold other chunks' neighbours only."""
        first = of[-1] * chunk
        window = kernels.SortedWindow(2 * half_window + 1, len(px[0])) if stat == "median" else kernels.SummedWindow()
        begin, end = 0, 0
        for k in np.flatnonzero((numbers >= first) & (numbers < first + chunk)):
            while end < len(numbers) and numbers[end] <= numbers[k] + half_window:
                window.add(np.asarray(px[end], float))
                end += 1
            while numbers[begin] < numbers[k] - half_window:
                window.remove(np.asarray(px[begin], float))
                begin += 1
            yield *of[:-1], numbers[k], window.value()

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        of, numbers, px = None, [], []
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if row[:-2] != of and px:
                    yield of, np.array(numbers), px
                    numbers, px = [], []
                of = row[:-2]
                numbers.append(row[-2])
                px.append(row[-1])
        if px:
            yield of, np.array(numbers), px

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, values = [], 0
        for found in chunks(batches):
            for row in smoothed(*found):
                rows.append(row)
                values += len(row[-1])
                if values >= VALUES:
                    yield pd.DataFrame(rows, columns=[*fixed, "frame", "px"])
                    rows, values = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=[*fixed, "frame", "px"])

    made = dealt.mapInPandas(run, ", ".join([*(f"{c} {'long' if c in KEYS else 'int'}" for c in (*fixed, "frame")), "px array<double>"]))
    return made.select(*KEYS, "height", "width", "px") if tile is None else from_tiles(made.withColumn("halo", F.lit(0)), tile)


def ctf(h: int, w: int, wavelength: float, cs: float, defocus: float) -> np.ndarray:
    """sin of the phase of the contrast transfer function on uncentred frequencies, lengths in pixels."""
    q2 = np.fft.fftfreq(h)[:, None] ** 2 + np.fft.fftfreq(w)[None, :] ** 2
    return np.sin(np.pi * wavelength * defocus * q2 + 0.5 * np.pi * cs * wavelength**3 * q2**2)


def delocalisation_correct(frames: DataFrame, wavelength: float, cs: float, defocus: float, snr: float) -> DataFrame:
    """Wiener deconvolution of each frame's contrast, F C / (C^2 + 1 / snr); the mean is kept."""
    keep = [c for c in frames.columns if c != "px"]

    def kernel(a: np.ndarray, _) -> dict:
        c = ctf(*a.shape[1:], wavelength, cs, defocus)
        mean = a.mean((1, 2), keepdims=True)
        out = np.fft.ifft2(np.fft.fft2(a - mean) * (c / (c * c + 1 / snr))).real + mean
        return {"px": out.reshape(len(a), -1)}

    return map_images(frames.withColumnRenamed("px", "_px"), kernel, "px array<double>", keep, px="_px")
