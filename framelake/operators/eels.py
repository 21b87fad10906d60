"""Energy-loss spectra: pairing, alignment, background, plural scattering, fits, ratios, valence and bootstrap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import VALUES, unpacked
from ..storage import attach, cut, meet, numbered

POS = ["scan_id", "sy", "sx"]
#: Numbers that a task of `bootstrap_mlls` holds before it hands them on.
SUMS = 1 << 20


def pair_dual(spectra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Core-loss and low-loss spectra of one position side by side, and what has no partner."""
    core, low = (spectra.where(F.col("kind") == k) for k in ("core", "low"))
    named = low.select(*POS, F.col("e0").alias("low_e0"), F.col("de").alias("low_de"), F.col("counts").alias("low_counts"))
    paired = meet(core.drop("kind"), named, POS)
    alone = meet(core, low, POS, "left_anti").select(*POS, "kind").union(meet(low, core, POS, "left_anti").select(*POS, "kind"))
    return paired, alone


def align_energy(paired: DataFrame) -> DataFrame:
    """Shifts both axes so that the low-loss maximum (the first, if several) is at energy 0; `shift` is what was added."""
    at = F.array_position("low_counts", F.array_max("low_counts")) - 1
    out = paired.withColumn("shift", -(F.col("low_e0") + at * F.col("low_de")))
    return out.withColumn("low_e0", F.col("low_e0") + F.col("shift")).withColumn("e0", F.col("e0") + F.col("shift"))


def channels(spectra: DataFrame, keys: list[str] = POS) -> DataFrame:
    return unpacked(spectra, [*keys, "e0", "de"], "counts", "i", "c").select(*keys, "i", (F.col("e0") + F.col("i") * F.col("de")).alias("e"), "c")


def remove_background(spectra: DataFrame, e_from: float, e_to: float) -> DataFrame:
    """Fits A E^-r by log-log least squares on [e_from, e_to) and subtracts it from e_from on; adds amplitude and exponent.

    Channels of no or negative counts, or of energy 0 or less, are left out of the fit; fewer than two leave the spectrum as it is.
    """
    w = channels(spectra).where((F.col("e") >= e_from) & (F.col("e") < e_to) & (F.col("c") > 0) & (F.col("e") > 0))
    fit = w.groupBy(*POS).agg(F.regr_slope(F.log("c"), F.log("e")).alias("_s"), F.regr_intercept(F.log("c"), F.log("e")).alias("_i"))
    out = meet(spectra, fit, POS, "left").withColumn("amplitude", F.exp("_i")).withColumn("exponent", -F.col("_s"))
    e = lambda i: F.col("e0") + i * F.col("de")
    sub = F.transform("counts", lambda c, i: F.when((e(i) >= e_from) & (e(i) > 0) & F.col("amplitude").isNotNull(), c - F.col("amplitude") * F.pow(e(i), -F.col("exponent"))).otherwise(c))
    return out.withColumn("counts", sub).drop("_s", "_i")


def remove_plural(paired: DataFrame, sigma: float) -> DataFrame:
    """Fourier-ratio deconvolution of the core loss by its low loss, limited by a Gaussian of `sigma` channels; the low-loss maximum is taken as energy 0."""
    kinds = dict(paired.dtypes)
    keep = [c for c in paired.columns if c != "counts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (m, k), part in _slices(pdf, [pdf["counts"].map(len), pdf["low_counts"].map(len)]):
                core, low = (np.stack([np.asarray(v, float) for v in part[c]]) for c in ("counts", "low_counts"))
                n = int(max(m, k))
                low = np.pad(low, ((0, 0), (0, n - int(k))))
                low = np.take_along_axis(low, (np.arange(n) + low.argmax(1)[:, None]) % n, 1)
                f = np.fft.fft(low)
                limit = np.exp(-2 * np.pi**2 * sigma**2 * np.fft.fftfreq(n) ** 2) * low.sum(1, keepdims=True)
                out = np.fft.ifft(np.fft.fft(core, n) * limit / np.where(np.abs(f) > 1e-12, f, 1e-12)).real[:, : int(m)]
                yield part[keep].assign(counts=list(out))

    return paired.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "counts array<double>"]))


#: References go to every executor; more are an error.
MAX_REFERENCES = 256


def _references(references: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    rows = references.orderBy("ref_id").limit(MAX_REFERENCES + 1).collect()
    if len(rows) > MAX_REFERENCES:
        raise ValueError(f"more than {MAX_REFERENCES} references")
    axis = np.array([(r["e0"], r["de"]) for r in rows])
    return [r["ref_id"] for r in rows], axis, np.array([r["counts"] for r in rows], float)


def mlls(spectra: DataFrame, references: DataFrame, e_from: float, e_to: float, non_negative: bool = False) -> DataFrame:
    """Linear least squares of each spectrum on the references over [e_from, e_to): coefficients (by ref_id), residual (root of the sum of squares) and r2.

    References are interpolated onto the spectrum's axis. Singular sets get the least-norm solution.
    With non_negative, coefficients below 0 leave the fit, the most negative first, until none is.
    """
    ids, axis, refs = _references(references)

    def positive(m: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        active = list(range(m.shape[1]))
        while active and x.min() < 0:
            active.remove(int(x.argmin()))
            x = np.zeros(m.shape[1])
            if active:
                x[active] = np.linalg.lstsq(m[:, active], y, rcond=None)[0]
        return x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, m, y in _systems(pdf, axis, refs, e_from, e_to):
                x = np.linalg.lstsq(m, y.T, rcond=None)[0].T
                if non_negative:
                    for k in np.flatnonzero((x < 0).any(1)):
                        x[k] = positive(m, y[k], x[k])
                squares = ((y - x @ m.T) ** 2).sum(1)
                spread = ((y - y.mean(1, keepdims=True)) ** 2).sum(1) if y.shape[1] else np.zeros(len(y))
                r2 = [float(1 - a / b) if b > 0 else None for a, b in zip(squares, spread, strict=True)]
                yield part[POS].assign(coefficients=[dict(zip(ids, map(float, row), strict=True)) for row in x], residual=np.sqrt(squares), r2=pd.Series(r2, part.index, object))

    return spectra.select(*POS, "e0", "de", "counts").mapInPandas(run, "scan_id long, sy int, sx int, coefficients map<int,double>, residual double, r2 double")


def _slices(pdf: pd.DataFrame, by: list[pd.Series]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """A batch's rows that agree in `by`, at most VALUES counts at once (one spectrum at least), so that a worker's memory does not follow the rows of a batch."""
    for keys, part in pdf.groupby(by, sort=False):
        step = max(1, VALUES // max(1, len(part["counts"].iloc[0])))
        for k in range(0, len(part), step):
            yield keys, part.iloc[k : k + step]


def _systems(pdf: pd.DataFrame, axis: np.ndarray, refs: np.ndarray, e_from: float, e_to: float) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows that share an axis and the channels without a count: the rows, the references on these channels (channels x references) and the counts (rows x channels)."""
    size = pdf["counts"].map(len)
    for (e0, de, n), part in _slices(pdf, [pdf["e0"], pdf["de"], size]):
        e = e0 + de * np.arange(int(n))
        m = np.stack([np.interp(e, a + d * np.arange(len(r)), r) for (a, d), r in zip(axis, refs, strict=True)], 1)
        y = np.stack([np.asarray(c, float) for c in part["counts"]])
        used = ((e >= e_from) & (e < e_to)) & ~np.isnan(y)
        patterns, which = np.unique(used, axis=0, return_inverse=True)
        for k, ok in enumerate(patterns):
            rows = np.flatnonzero(which.ravel() == k)
            yield part.iloc[rows], m[ok], y[rows][:, ok]


def edge_ratio(spectra: DataFrame, w1: tuple[float, float], w2: tuple[float, float]) -> DataFrame:
    """Integrals over two half-open windows and their ratio (null for an empty second one)."""
    part = lambda w: F.sum(F.when((F.col("e") >= w[0]) & (F.col("e") < w[1]), F.col("c") * F.col("de")).otherwise(0.0))
    rows = unpacked(spectra, [*POS, "e0", "de"], "counts", "i", "c").withColumn("e", F.col("e0") + F.col("i") * F.col("de"))
    out = rows.groupBy(*POS).agg(part(w1).alias("i1"), part(w2).alias("i2"))
    return out.withColumn("ratio", F.when(F.col("i2") != 0, F.col("i1") / F.col("i2")))


def valence(fit: DataFrame, valence_of_ref: dict[int, float]) -> tuple[DataFrame, DataFrame]:
    """Fractions and weighted mean valence per position, and the scan's means; a sum of coefficients of 0 gives null. Of `bootstrap_mlls`, per replicate."""
    at = [c for c in (*POS, "rep") if c in fit.columns]
    parts = {k: F.coalesce(F.element_at("coefficients", F.lit(k)), F.lit(0.0)) for k in valence_of_ref}
    total = sum(parts.values(), F.lit(0.0))
    each = [F.when(total != 0, p / total).alias(f"fraction_{k}") for k, p in parts.items()]
    mean = F.when(total != 0, sum((p * v for p, v in zip(parts.values(), valence_of_ref.values(), strict=True)), F.lit(0.0)) / total)
    here = fit.select(*at, *each, mean.alias("valence"))
    return here, here.groupBy("scan_id").agg(F.avg("valence").alias("valence"), F.stddev_samp("valence").alias("std"), F.count("valence").alias("n"))


def draws(rows: DataFrame, group: str, index: str, reps: int, seed: int) -> DataFrame:
    """(group, rep, i, j): for each position i of each replicate the drawn position j, a stable hash of (seed, rep, group, i) modulo the group's size. The positions are those of `rows`, so no group is made in one task."""
    at = cut(rows.select(group, F.col(index).alias("i")))
    sizes = cut(at.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    each = attach(at, sizes, [group]).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    text = F.concat(F.lit(f"{seed}:"), F.col("rep").cast("string"), F.lit(":"), F.col(group).cast("string"), F.lit(":"), F.col("i").cast("string"))
    return each.withColumn("j", F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")).select(group, "rep", "i", "j")


def bootstrap(rows: DataFrame, group: str, index: str, value: str, reps: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Means of resamples with replacement within each group: group, mean, low, high. `index` numbers a group's rows gaplessly from 0."""
    drawn = meet(draws(rows, group, index, reps, seed), rows.select(group, F.col(index).alias("j"), F.col(value).alias("v")), [group, "j"])
    means = drawn.groupBy(group, "rep").agg(F.avg("v").alias("m"))
    return means.groupBy(group).agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))


def normal_equations(spectra: DataFrame, references: DataFrame, e_from: float, e_to: float) -> DataFrame:
    """Each position's least-squares fit as numbers that add up: `equations` holds the Gram matrix of the references on its axis over [e_from, e_to), row by row, then its right side."""
    _, axis, refs = _references(references)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, m, y in _systems(pdf, axis, refs, e_from, e_to):
                gram = np.broadcast_to((m.T @ m).ravel(), (len(part), m.shape[1] ** 2))
                yield part[POS].assign(equations=list(np.concatenate([gram, y @ m], 1)))

    return spectra.select(*POS, "e0", "de", "counts").mapInPandas(run, "scan_id long, sy int, sx int, equations array<double>")


def bootstrap_mlls(spectra: DataFrame, references: DataFrame, e_from: float, e_to: float, reps: int, seed: int) -> DataFrame:
    """The fit of `mlls` to each resample of a scan's positions, all its spectra at once: scan_id, rep, coefficients (by ref_id).

    A scan's positions are numbered from 0 in the order of (sy, sx). No resampled spectrum is made: a
    position's normal equations are worked out once and weighted by how often each replicate draws it.
    Tasks add up what they hold of a scan, (replicates x equations) numbers, before these sums meet;
    then a replicate is one small system, solved by least norm where it is singular.
    """
    ids, _, _ = _references(references)
    k = len(ids)
    size = k * k + k
    # a written table: its numbers must be the same in both uses
    own = cut(numbered(normal_equations(spectra, references, e_from, e_to), ["scan_id"], ["sy", "sx"], "i", 2 * spectra.sparkSession.sparkContext.defaultParallelism))
    drawn = draws(own, "scan_id", "i", reps, seed).groupBy("scan_id", F.col("j").alias("i")).agg(F.collect_list("rep").alias("_reps"))
    weighted = meet(own.select("scan_id", "i", "equations"), drawn, ["scan_id", "i"]).select("scan_id", "equations", "_reps")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        out = lambda: pd.DataFrame({"scan_id": list(sums), "sums": [v.ravel() for v in sums.values()]})
        for pdf in batches:
            for scan, part in pdf.groupby("scan_id", sort=False):
                often = part["_reps"].map(len).to_numpy()
                weights = np.zeros((reps, len(part)))
                np.add.at(weights, (np.concatenate(part["_reps"].to_list()), np.repeat(np.arange(len(part)), often)), 1)
                sums[scan] = sums.get(scan, 0) + weights @ np.stack(part["equations"].to_list())
            if len(sums) * reps * size > SUMS:
                yield out()
                sums.clear()
        if sums:
            yield out()

    def solve(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.asarray(v) for v in part["sums"]], 0).reshape(reps, size)
        x = (np.linalg.pinv(total[:, : k * k].reshape(reps, k, k), hermitian=True) @ total[:, k * k :, None])[:, :, 0]
        return pd.DataFrame({"scan_id": keys[0], "rep": np.arange(reps), "coefficients": [dict(zip(ids, map(float, row), strict=True)) for row in x]})

    parts = weighted.mapInPandas(add, "scan_id long, sums array<double>")
    return parts.groupBy("scan_id").applyInPandas(solve, "scan_id long, rep int, coefficients map<int,double>")


def percentiles(reps: DataFrame, group: str, values: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean and two percentiles of each value over a group's replicates: group, then value, value_low, value_high."""
    each = lambda c: (F.avg(c).alias(c), F.percentile(c, F.lit(low)).alias(f"{c}_low"), F.percentile(c, F.lit(high)).alias(f"{c}_high"))
    return reps.groupBy(group).agg(*(x for c in values for x in each(c)))


def bootstrap_fit(rows: DataFrame, group: str, index: str, statistic: Callable[[pd.DataFrame], float], reps: int, seed: int) -> DataFrame:
    """As `bootstrap`, for any statistic of a resample's rows: group, rep, value."""
    drawn = meet(draws(rows, group, index, reps, seed), rows.withColumnRenamed(index, "j"), [group, "j"])
    kind = dict(rows.dtypes)[group]

    def one(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [keys[0]], "rep": [keys[1]], "value": [float(statistic(part))]})

    return drawn.groupBy(group, "rep").applyInPandas(one, f"{group} {kind}, rep int, value double")
