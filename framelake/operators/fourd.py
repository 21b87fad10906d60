"""Four-dimensional scans: detector images, mean patterns, centre of mass, side-band phase, orientation, disk strain."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.arrays import by_size, map_images, stacked
from ..storage import cut, meet, small

POS = ["scan_id", "sy", "sx"]


def detector_image(patterns: DataFrame, r_in: float, r_out: float, centre: tuple[float, float]) -> DataFrame:
    """Sum over an annulus (both radii included) at each position, inside one expression: nothing is exploded."""
    cy, cx = centre
    inside = lambda i: F.pow(F.floor(i / F.col("kw")) - cy, F.lit(2)) + F.pow(i % F.col("kw") - cx, F.lit(2))
    total = F.aggregate(F.transform("px", lambda v, i: F.when((inside(i) >= r_in * r_in) & (inside(i) <= r_out * r_out) & ~F.isnan(v), v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return patterns.select(*POS, total.alias("value"))


def mean_pattern(patterns: DataFrame) -> DataFrame:
    """scan_id, ky, kx, mean, max over a scan; NaN and null do not count, and a pixel that has nothing else has no row.

    Patterns are added up packed, where they lie and once more where a scan's sums meet; only these sums become rows.
    """
    sums = "scan_id long, kh int, kw int, total array<double>, n array<double>, most array<double>"

    def added(part: pd.DataFrame, total: np.ndarray, n: np.ndarray, most: np.ndarray) -> pd.DataFrame:
        scan = part["scan_id"].to_numpy()
        order = np.argsort(scan, kind="stable")
        first = np.flatnonzero(np.diff(scan[order], prepend=scan[order[0]] - 1))
        parts = {k: list(f.reduceat(v[order].reshape(len(scan), -1), first)) for k, f, v in (("total", np.add, total), ("n", np.add, n), ("most", np.maximum, most))}
        return pd.DataFrame({"scan_id": scan[order][first], "kh": part["kh"].iloc[0], "kw": part["kw"].iloc[0], **parts})

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, h, w in by_size(pdf, "kh", "kw"):
                a = stacked(part, h, w)
                some = ~np.isnan(a)
                yield added(part, np.where(some, a, 0), some.astype(float), np.where(some, a, -np.inf))

    def meet_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, h, w in by_size(pdf, "kh", "kw"):
                yield added(part, *(stacked(part, h, w, c) for c in ("total", "n", "most")))

    here = patterns.where("px is not null").select("scan_id", "kh", "kw", "px").mapInPandas(lay, sums)
    scans = here.repartition("scan_id").sortWithinPartitions("scan_id").mapInPandas(meet_, sums)
    rows = scans.select("scan_id", "kw", F.posexplode(F.arrays_zip("total", "n", "most")).alias("_i", "_p")).where("_p.n > 0")
    rows = rows.select("scan_id", F.expr("cast(_i div kw as int)").alias("ky"), F.expr("cast(_i % kw as int)").alias("kx"), "_p.*")
    return rows.groupBy("scan_id", "ky", "kx").agg((F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("max"))


def dpc(patterns: DataFrame, centre: tuple[float, float] | None = None) -> DataFrame:
    """Centre of mass of each pattern minus the scan's mean (or minus `centre`), its magnitude and angle; an empty pattern is null."""
    def moment(weight):
        return F.aggregate(F.transform("px", lambda v, i: F.when(F.isnan(v), 0.0).otherwise(v * weight(i))), F.lit(0.0), lambda a, v: a + v)

    com = patterns.select(*POS, moment(lambda i: F.lit(1.0)).alias("m"), moment(lambda i: F.floor(i / F.col("kw"))).alias("my"), moment(lambda i: i % F.col("kw")).alias("mx"))
    com = com.select(*POS, F.when(F.col("m") != 0, F.col("my") / F.col("m")).alias("my"), F.when(F.col("m") != 0, F.col("mx") / F.col("m")).alias("mx"))
    if centre is None:
        mean = com.groupBy("scan_id").agg(F.avg("my").alias("oy"), F.avg("mx").alias("ox"))
        com = meet(com, mean, "scan_id")
    else:
        com = com.withColumn("oy", F.lit(centre[0])).withColumn("ox", F.lit(centre[1]))
    out = com.select(*POS, (F.col("my") - F.col("oy")).alias("dy"), (F.col("mx") - F.col("ox")).alias("dx"))
    return out.withColumn("magnitude", F.sqrt(F.col("dy") ** 2 + F.col("dx") ** 2)).withColumn("angle", F.atan2("dy", "dx"))


def ssb(patterns: DataFrame, wavelength: float, semi_angle: float, step: float, dk: float, centre: tuple[float, float], values: int = 1 << 20) -> DataFrame:
    """Single-side-band phase per scan position: scan_id, sy, sx, phase, amplitude (Pennycook et al. 2015, without aberrations).

    wavelength * dk is the angle of one detector pixel, `step` the scan step. Detector pixels outside
    the aperture's reach are dropped first; then the volume is transposed by one shuffle of packed rows (a
    position's values of one group of detector pixels). A group holds some detector pixels over the whole
    scan (about `values` values), transforms each and sums their side bands; the groups' sums are added, and
    one inverse transform per scan gives the phase.
    """
    cy, cx = centre
    a = semi_angle / wavelength / dk  # aperture radius in detector pixels
    size = patterns.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), (F.max("sy") + 1).alias("h"), (F.max("sx") + 1).alias("w"))
    most = size.agg(F.max("n")).first()[0] or 0
    groups = max(1, int(most * np.pi * a * a / values))
    def pixels(kh: int, kw: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat index, ky and kx of the detector pixels inside the aperture."""
        ky, kx = np.divmod(np.arange(kh * kw), kw)
        inside = np.flatnonzero((ky - cy) ** 2 + (kx - cx) ** 2 <= a * a)
        return inside, ky[inside] - cy, kx[inside] - cx

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (kh, kw), rows in pdf.groupby(["kh", "kw"], sort=False):
                inside, *_ = pixels(int(kh), int(kw))
                images = stacked(rows, int(kh), int(kw)).reshape(len(rows), -1)[:, inside]
                for k in range(groups):
                    yield rows[["scan_id", "sy", "sx", "kh", "kw"]].assign(part=k, v=list(images[:, k::groups]))

    packed = patterns.select(*POS, "kh", "kw", "px").mapInPandas(pack, "scan_id long, sy int, sx int, kh int, kw int, part int, v array<double>")
    packed = packed.join(small(cut(size.select("scan_id", "h", "w"))), "scan_id")

    def side_band(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        h, w = int(part["h"].iloc[0]), int(part["w"].iloc[0])
        _, *at = pixels(int(part["kh"].iloc[0]), int(part["kw"].iloc[0]))
        at = np.stack(at, 1)[int(keys[1]) :: groups]
        image = np.zeros((len(at), h, w))
        image[:, part["sy"], part["sx"]] = np.stack(part["v"].to_list()).T
        g = np.fft.fft2(image)
        qy, qx = np.meshgrid(np.fft.fftfreq(h, step * dk), np.fft.fftfreq(w, step * dk), indexing="ij")  # in detector pixels
        ky, kx = at[:, 0, None, None], at[:, 1, None, None]
        band = ((ky - qy) ** 2 + (kx - qx) ** 2 <= a * a) & ((ky + qy) ** 2 + (kx + qx) ** 2 > a * a) & (ky**2 + kx**2 <= a * a)
        total = np.where(band | ((qy == 0) & (qx == 0)), g, 0).sum(0)
        y, x = np.nonzero(total)
        return pd.DataFrame({"scan_id": keys[0], "h": h, "w": w, "qy": y, "qx": x, "re": total.real[y, x], "im": total.imag[y, x]})

    bands = packed.groupBy("scan_id", "part").applyInPandas(side_band, "scan_id long, h int, w int, qy int, qx int, re double, im double")
    total = bands.groupBy("scan_id", "h", "w", "qy", "qx").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def back(part: pd.DataFrame) -> pd.DataFrame:
        h, w = int(part["h"].iloc[0]), int(part["w"].iloc[0])
        g = np.zeros((h, w), complex)
        g[part["qy"], part["qx"]] = part["re"] + 1j * part["im"]
        z = np.fft.ifft2(g)
        sy, sx = np.mgrid[0:h, 0:w]
        return pd.DataFrame({"scan_id": part["scan_id"].iloc[0], "sy": sy.ravel(), "sx": sx.ravel(), "phase": np.angle(z).ravel(), "amplitude": np.abs(z).ravel()})

    return total.groupBy("scan_id").applyInPandas(back, "scan_id long, sy int, sx int, phase double, amplitude double")


#: Values of the templates that go to every executor at once.
TEMPLATE_VALUES = 50_000_000


def orientation(patterns: DataFrame, templates: DataFrame, top: int = 1, key: str = "pos", template: str = "template_id", px: str = "px", values: int = TEMPLATE_VALUES) -> DataFrame:
    """The `top` best templates of each pattern by normalised correlation: key, template, score, rank; ties: smaller id. Constant patterns score 0.

    A bank of more than `values` values is taken in blocks, dealt by a hash of the template's id: each block is a
    pass over the patterns whose best matches are written, and the best of all blocks are kept at the end.
    """
    first = templates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(px)).alias("m")).first()
    held = max(1, values // max(1, first["m"] or 1))
    blocks = -(-(first["n"] or 0) // held)
    if blocks <= 1:
        return _matches(patterns, templates, top, key, template, px)
    dealt = cut(templates.select(template, px, F.pmod(F.xxhash64(F.lit("block"), template), F.lit(blocks)).alias("_block")))
    parts = [cut(_matches(patterns, dealt.where(F.col("_block") == k), top, key, template, px)) for k in range(blocks)]
    return best_of(functools.reduce(DataFrame.union, parts), key, template, top)


def _matches(patterns: DataFrame, templates: DataFrame, top: int, key: str, template: str, px: str) -> DataFrame:
    """The best of one block of templates."""
    rows = sorted((r[0], r[1]) for r in templates.select(template, px).collect())
    kinds = f"{key} {dict(patterns.dtypes)[key]}, {template} {dict(templates.dtypes)[template]}, score double, rank int"
    if not rows:
        return patterns.sparkSession.createDataFrame([], kinds)
    ids, table = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)

    def unit(a: np.ndarray) -> np.ndarray:
        a = a - a.mean(1, keepdims=True)
        n = np.linalg.norm(a, axis=1, keepdims=True)
        return np.where(n > 1e-12, a / np.where(n > 1e-12, n, 1), 0)

    shared = patterns.sparkSession.sparkContext.broadcast((ids, unit(table)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, t = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            score = unit(np.stack([np.asarray(p, float) for p in pdf[px]])) @ t.T
            best = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :top]
            n = best.shape[1]
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), n), template: ids[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel(), "rank": np.tile(np.arange(1, n + 1), len(pdf))})

    return patterns.select(key, px).mapInPandas(run, kinds)


def disk_strain(patterns: DataFrame, g1: tuple[float, float], g2: tuple[float, float], radius: int, centre: tuple[float, float], reference: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """Refines the disks near centre, centre + g1 and centre + g2 by centroid; strain of their differences against the reference vectors (in reciprocal space: strain is that of the inverse transpose, to first order minus)."""
    inverse = np.linalg.inv(np.array(reference, float).T)

    def kernel(a: np.ndarray, _) -> dict:
        c = kernels.centroids(a, *centre, radius)
        v = np.stack([kernels.centroids(a, centre[0] + g[0], centre[1] + g[1], radius) - c for g in (g1, g2)], 2)  # (n, axes y and x, vectors)
        d = v @ inverse  # measured = d @ reference
        det = d[:, 0, 0] * d[:, 1, 1] - d[:, 0, 1] * d[:, 1, 0]
        safe = np.where(np.abs(det) > 1e-12, det, np.nan)
        # the inverse transpose of d, less the identity, by axes y and x
        e = np.stack([d[:, 1, 1] / safe - 1, -d[:, 1, 0] / safe, -d[:, 0, 1] / safe, d[:, 0, 0] / safe - 1])
        return {"g1y": v[:, 0, 0], "g1x": v[:, 1, 0], "g2y": v[:, 0, 1], "g2x": v[:, 1, 1], "exx": e[3], "eyy": e[0], "exy": (e[1] + e[2]) / 2, "rot": (e[1] - e[2]) / 2}

    return map_images(patterns, kernel, ", ".join(f"{k} double" for k in ("g1y", "g1x", "g2y", "g2x", "exx", "eyy", "exy", "rot")), POS, h="kh", w="kw")


def best_of(matches: DataFrame, key: str, template: str, top: int) -> DataFrame:
    """The best of several `orientation` results, for templates given in parts."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), template)
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
