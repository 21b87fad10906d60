"""Neighbour pairs, lattices, displacement and strain; geometric phase analysis.

Geometric phase analysis follows Hytch, Snoeck and Kilaas (1998): phases of two lattice frequencies,
their gradients by complex ratios, strain from the inverse of the two frequencies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.arrays import map_images, stacked
from ..storage import cut, meet, small
from .atoms import near_pairs
from .filters import power_spectrum

KEYS = ["stack_id", "frame"]


def peak_pairs(points: DataFrame, a: tuple[float, float], b: tuple[float, float], tol: float) -> DataFrame:
    """PAIRS: for each point the nearest point to its place + a (axis 1) and + b (axis 2) within tol; ties: smaller id."""
    found = None
    for axis, (vy, vx) in ((1, a), (2, b)):
        aims = points.select(*KEYS, "point_id", (F.col("y") + vy).alias("y"), (F.col("x") + vx).alias("x"), F.col("y").alias("y0"), F.col("x").alias("x0"))
        near = near_pairs(aims, points.select(*KEYS, "point_id", "y", "x"), KEYS, tol).where(F.col("a.point_id") != F.col("b.point_id"))
        best = near.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS, "a.point_id").orderBy("d", "b.point_id"))).where("_r = 1")
        rows = best.select(*KEYS, F.col("a.point_id").alias("point_id"), F.col("b.point_id").alias("nbr_id"), (F.col("b.y") - F.col("a.y0")).alias("dy"), (F.col("b.x") - F.col("a.x0")).alias("dx"), F.lit(axis).alias("axis"))
        found = rows if found is None else found.union(rows)
    return found


def fit_lattice(points: DataFrame, pairs: DataFrame, region: str = "true") -> DataFrame:
    """Mean vectors per stack over pairs whose point fulfils `region` (SQL over the point's columns): ay, ax, by, bx and the numbers of pairs."""
    ref = meet(pairs, points.where(region).select(*KEYS, "point_id"), [*KEYS, "point_id"])
    mean = lambda c, k: F.avg(F.when(F.col("axis") == k, F.col(c)))
    return ref.groupBy("stack_id").agg(mean("dy", 1).alias("ay"), mean("dx", 1).alias("ax"), mean("dy", 2).alias("by"), mean("dx", 2).alias("bx"), F.count(F.when(F.col("axis") == 1, 1)).alias("n_a"), F.count(F.when(F.col("axis") == 2, 1)).alias("n_b"))


def displacement(points: DataFrame, lattice: DataFrame, origin: str = "first") -> DataFrame:
    """Adds the indices (ia, ib) of the nearest lattice node and the displacement (uy, ux) from it.

    origin "first": each frame's first point in (y, x) is node (0, 0) and does not move. origin "stack": one
    origin for all frames of a stack, the circular mean of its atoms' fractional lattice coordinates, so no
    atom need be there or in place; the stack's least indices are 0. Only one row a stack is gathered.
    A stack without a lattice has no rows; one whose vectors are parallel is null.
    """
    known = small(cut(lattice))
    det = F.col("ay") * F.col("bx") - F.col("ax") * F.col("by")
    if origin == "first":
        first = points.groupBy(*KEYS).agg(F.min(F.struct("y", "x")).alias("o"))
        p = meet(points, first, KEYS).join(known, "stack_id")
        dy, dx = F.col("y") - F.col("o.y"), F.col("x") - F.col("o.x")
        p = p.withColumn("_d", F.when(det != 0, det)).withColumn("ia", F.round((dy * F.col("bx") - dx * F.col("by")) / F.col("_d")).cast("int")).withColumn("ib", F.round((dx * F.col("ay") - dy * F.col("ax")) / F.col("_d")).cast("int"))
        return p.select(*KEYS, "point_id", "y", "x", "ia", "ib", (dy - F.col("ia") * F.col("ay") - F.col("ib") * F.col("by")).alias("uy"), (dx - F.col("ia") * F.col("ax") - F.col("ib") * F.col("bx")).alias("ux"))
    if origin != "stack":
        raise ValueError("origin is 'first' or 'stack'")
    p = points.select(*KEYS, "point_id", "y", "x").join(known, "stack_id").withColumn("_d", F.when(det != 0, det))
    p = p.withColumn("_u", (F.col("y") * F.col("bx") - F.col("x") * F.col("by")) / F.col("_d")).withColumn("_v", (F.col("x") * F.col("ay") - F.col("y") * F.col("ax")) / F.col("_d"))
    turn = lambda f, c: F.avg(f(2 * np.pi * F.col(c)))
    centre = p.groupBy("stack_id").agg(*((F.atan2(turn(F.sin, c), turn(F.cos, c)) / (2 * np.pi)).alias(f"{c}0") for c in ("_u", "_v")))
    centre = small(cut(centre))
    p = p.join(centre, "stack_id").withColumn("_i", F.round(F.col("_u") - F.col("_u0"))).withColumn("_j", F.round(F.col("_v") - F.col("_v0")))
    least = small(cut(p.groupBy("stack_id").agg(F.min("_i").alias("_i0"), F.min("_j").alias("_j0"))))
    p = p.join(least, "stack_id").withColumn("_du", F.col("_u") - F.col("_u0") - F.col("_i")).withColumn("_dv", F.col("_v") - F.col("_v0") - F.col("_j"))
    return p.select(*KEYS, "point_id", "y", "x", (F.col("_i") - F.col("_i0")).cast("int").alias("ia"), (F.col("_j") - F.col("_j0")).cast("int").alias("ib"), (F.col("_du") * F.col("ay") + F.col("_dv") * F.col("by")).alias("uy"), (F.col("_du") * F.col("ax") + F.col("_dv") * F.col("bx")).alias("ux"))


def pair_strain(pairs: DataFrame, lattice: DataFrame, points: DataFrame) -> DataFrame:
    """FIELDS: exx, eyy, exy and rotation at each point that has both pair vectors, from F = P L^-1 with vectors as columns."""
    v = pairs.groupBy(*KEYS, "point_id").agg(*(F.max(F.when(F.col("axis") == k, F.col(c))).alias(f"{n}{c[1]}") for k, n in ((1, "p"), (2, "q")) for c in ("dy", "dx"))).dropna(subset=["py", "qy"])
    v = meet(v.join(small(cut(lattice)), "stack_id"), points.select(*KEYS, "point_id", "y", "x"), [*KEYS, "point_id"])
    det = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    v = v.withColumn("_d", F.when(det != 0, det))
    xx = (F.col("px") * F.col("by") - F.col("qx") * F.col("ay")) / F.col("_d") - 1
    xy = (F.col("qx") * F.col("ax") - F.col("px") * F.col("bx")) / F.col("_d")
    yx = (F.col("py") * F.col("by") - F.col("qy") * F.col("ay")) / F.col("_d")
    yy = (F.col("qy") * F.col("ax") - F.col("py") * F.col("bx")) / F.col("_d") - 1
    return v.select(*KEYS, "point_id", "y", "x", xx.alias("exx"), yy.alias("eyy"), ((xy + yx) / 2).alias("exy"), ((yx - xy) / 2).alias("rot"))


def gpa_phase(frames: DataFrame, g: tuple[float, float], sigma: float) -> DataFrame:
    """Phase and amplitude images of frequency g = (gy, gx) in cycles a pixel, after Gaussian smoothing of `sigma` pixels."""

    def kernel(a: np.ndarray, _) -> dict:
        z = kernels.demodulate(a, g[0], g[1], sigma).reshape(len(a), -1)
        return {"phase": np.angle(z), "amplitude": np.abs(z)}

    return map_images(frames, kernel, "phase array<double>, amplitude array<double>", [*KEYS, "height", "width"])


def gpa_strain(phase1: DataFrame, phase2: DataFrame, g1: tuple[float, float], g2: tuple[float, float]) -> DataFrame:
    """exx, eyy, exy, rot images: displacement gradient e = -(1 / 2 pi) G^-1 grad phase."""
    both = meet(phase1, phase2.select(*KEYS, F.col("phase").alias("phase2")), KEYS)
    inverse = np.linalg.inv(2 * np.pi * np.array([g1, g2], float))  # rows: y, x

    def kernel(p1: np.ndarray, part: pd.DataFrame) -> dict:
        p2 = stacked(part, *p1.shape[1:], "phase2")
        grad = [[kernels.phase_gradient(p, ax) for ax in (1, 2)] for p in (p1, p2)]
        u = [[-(inverse[i, 0] * grad[0][j] + inverse[i, 1] * grad[1][j]) for j in (0, 1)] for i in (0, 1)]  # u[y or x][d/dy or d/dx]
        flat = lambda a: a.reshape(len(a), -1)
        return {"exx": flat(u[1][1]), "eyy": flat(u[0][0]), "exy": flat((u[0][1] + u[1][0]) / 2), "rot": flat((u[0][1] - u[1][0]) / 2)}

    return map_images(both, kernel, "exx array<double>, eyy array<double>, exy array<double>, rot array<double>", [*KEYS, "height", "width"], px="phase", extra=["phase2"])


def find_g(frames: DataFrame, k: int, r_min: float) -> DataFrame:
    """The k strongest frequencies per stack at radius r_min or more, from the mean spectrum; one of each pair of opposite signs: ky > 0, or ky = 0 and kx > 0."""
    from ..functions.arrays import long_form

    spectrum = power_spectrum(frames)
    px = long_form(spectrum, [*KEYS, "height", "width"]).select("stack_id", (F.col("y") - F.floor(F.col("height") / 2)).alias("ky"), (F.col("x") - F.floor(F.col("width") / 2)).alias("kx"), F.col("v").alias("p"))
    half = px.where("ky > 0 or (ky = 0 and kx > 0)").where(F.col("ky") ** 2 + F.col("kx") ** 2 >= r_min * r_min)
    mean = half.groupBy("stack_id", "ky", "kx").agg(F.avg("p").alias("power"))
    ranked = mean.withColumn("rank", F.row_number().over(Window.partitionBy("stack_id").orderBy(F.desc(F.round("power", 3)), "ky", "kx")))
    return ranked.where(F.col("rank") <= k).select("stack_id", "rank", "ky", "kx", "power")


def strain_summary(fields: DataFrame, by: list[str], columns: list[str] = ("exx", "eyy", "exy", "rot")) -> DataFrame:
    """Count, mean, std and the 5, 50 and 95 percentiles of each component."""
    out = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), *(F.percentile(c, F.lit(p / 100)).alias(f"{c}_p{p}") for p in (5, 50, 95))]
    return fields.groupBy(*by).agg(*out)
