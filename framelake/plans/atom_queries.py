"""Queries of the atom, strain and region operators, each with DuckDB SQL that takes another route."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atoms, frames, regions, strain
from ..storage import meet
from . import fixtures as fx
from .stack_queries import DFT, KEYS, rounded

QUERIES: dict = {}
ORACLES: dict = {}
A, B = (10.0, 0.0), (0.0, 10.0)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


PEAKS = f"""{fx.LATTICE_SQL}, peaks AS (SELECT p.stack_id, p.frame, p.y*24 + p.x AS point_id, p.y, p.x, p.v FROM lattice p JOIN lattice q ON p.stack_id = q.stack_id AND p.frame = q.frame AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2
 WHERE p.v > 90 GROUP BY ALL HAVING count(CASE WHEN (q.y, q.x) <> (p.y, p.x) AND (q.v > p.v OR (q.v = p.v AND (q.y < p.y OR (q.y = p.y AND q.x < p.x)))) THEN 1 END) = 0)"""


def _peaks(spark: SparkSession, sf: str) -> DataFrame:
    return atoms.detect_peaks(fx.lattice(spark, sf), 2, 90.0)


@query("d1_detect_peaks", f"WITH {PEAKS} SELECT stack_id, frame, point_id::BIGINT AS point_id, y::DOUBLE AS y, x::DOUBLE AS x, v::DOUBLE AS intensity FROM peaks")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    """In haloed tiles, which must not change the answer."""
    return atoms.detect_peaks(fx.lattice(spark, sf), 2, 90.0, tile=9)


@query(
    "d2_refine_centroids",
    f"""WITH {PEAKS}, w AS (SELECT p.stack_id, p.frame, p.point_id, q.y, q.x, q.v, min(q.v) OVER (PARTITION BY p.stack_id, p.frame, p.point_id) AS m FROM peaks p JOIN lattice q ON p.stack_id = q.stack_id AND p.frame = q.frame AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2)
    SELECT stack_id, frame, point_id::BIGINT AS point_id, round(sum((v - m) * y) / sum(v - m)::DOUBLE, 4) + 0.0 AS y, round(sum((v - m) * x) / sum(v - m)::DOUBLE, 4) + 0.0 AS x FROM w GROUP BY ALL""",
)
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(atoms.refine_centroids(_peaks(spark, sf), fx.lattice(spark, sf), 2).select(*KEYS, "point_id", "y", "x"))


@query(
    "d2_d3_in_tiles",
    f"""WITH {PEAKS}, w AS (SELECT p.stack_id, p.frame, p.point_id, q.y, q.x, q.v, p.y AS py, p.x AS px, min(q.v) OVER (PARTITION BY p.stack_id, p.frame, p.point_id) AS m FROM peaks p JOIN lattice q ON p.stack_id = q.stack_id AND p.frame = q.frame AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2)
    SELECT stack_id, frame, point_id::BIGINT AS point_id, round(sum((v - m) * y) / sum(v - m)::DOUBLE, 4) + 0.0 AS y, round(sum((v - m) * x) / sum(v - m)::DOUBLE, 4) + 0.0 AS x, sum(CASE WHEN (y-py)*(y-py) + (x-px)*(x-px) <= 4 THEN v ELSE 0 END)::DOUBLE AS sum FROM w GROUP BY ALL""",
)
def d2_d3(spark: SparkSession, sf: str) -> DataFrame:
    """Centres and sums of atoms that meet haloed tiles instead of frames; windows reach over the tiles' borders."""
    pts, lat = _peaks(spark, sf), fx.lattice(spark, sf)
    moved = atoms.refine_centroids(pts, lat, 2, tile=7).select(*KEYS, "point_id", "y", "x")
    return rounded(meet(moved, atoms.atom_intensity(pts, lat, 2.0, tile=7).select(*KEYS, "point_id", "sum"), [*KEYS, "point_id"]))


@query("d3_atom_intensity", f"WITH {PEAKS} SELECT p.stack_id, p.frame, p.point_id::BIGINT AS point_id, sum(q.v)::DOUBLE AS sum, round(avg(q.v), 4) + 0.0 AS mean, max(q.v)::DOUBLE AS max, count(*)::BIGINT AS n FROM peaks p JOIN lattice q ON p.stack_id = q.stack_id AND p.frame = q.frame AND (p.y-q.y)*(p.y-q.y) + (p.x-q.x)*(p.x-q.x) <= 4 GROUP BY ALL")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(atoms.atom_intensity(_peaks(spark, sf), fx.lattice(spark, sf), 2.0))


@query("d4_classify_atoms", f"WITH {fx.POINTS_SQL} SELECT stack_id, point_id, CASE WHEN intensity >= 120 THEN 1 ELSE 0 END AS by_cut, CASE WHEN intensity >= 120 THEN 1 ELSE 0 END AS by_means FROM points")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    pts = fx.points(spark, sf)
    cut = atoms.classify_atoms(pts, cuts=[120.0]).select("stack_id", "point_id", F.col("class").alias("by_cut"))
    return meet(cut, atoms.classify_atoms(pts, k=2).select("stack_id", "point_id", F.col("class").alias("by_means")), ["stack_id", "point_id"])


def _stub(a: np.ndarray) -> list[np.ndarray]:
    """Stands for a model: every pixel above 99 with a score."""
    return [np.column_stack([yx, image[yx[:, 0], yx[:, 1]] / 100]) for image in a for yx in [np.argwhere(image > 99)]]


@query("d5_predict_atoms", f"WITH {fx.LATTICE_SQL} SELECT stack_id, frame, y::DOUBLE AS y, x::DOUBLE AS x, round(v / 100.0::DOUBLE, 4) + 0.0 AS intensity FROM lattice WHERE v > 99")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    tiles = frames.to_tiles(fx.lattice(spark, sf), 8, 2)
    return rounded(atoms.predict_atoms(tiles, _stub, 0.5, 8).select(*KEYS, "y", "x", "intensity"))


@query(
    "d6_score_detections",
    f"""WITH {fx.POINTS_SQL}, p AS (SELECT stack_id, point_id, y + 0.5 AS y, x FROM points WHERE point_id % 9 <> 0), n AS (SELECT stack_id, count(*) AS np FROM p GROUP BY ALL)
    SELECT stack_id, np AS tp, 0::BIGINT AS fp, 64 - np AS fn, 1.0::DOUBLE AS precision, round(np / 64.0::DOUBLE, 4) + 0.0 AS recall, 0.5::DOUBLE AS mean_error FROM n""",
)
def d6(spark: SparkSession, sf: str) -> DataFrame:
    pts = fx.points(spark, sf)
    return rounded(atoms.score_detections(pts.where("point_id % 9 <> 0").withColumn("y", F.col("y") + 0.5), pts, 2.0))


#: Two equi joins: the neighbour a row further, and the one a place further in the row.
PAIRS = f"""{fx.POINTS_SQL}, pairs AS (
 SELECT p.stack_id, p.point_id, q.point_id AS nbr_id, q.y - p.y AS dy, q.x - p.x AS dx, 1 AS axis FROM points p JOIN points q ON p.stack_id = q.stack_id AND q.point_id = p.point_id + 8
 UNION ALL SELECT p.stack_id, p.point_id, q.point_id, q.y - p.y, q.x - p.x, 2 FROM points p JOIN points q ON p.stack_id = q.stack_id AND q.point_id = p.point_id + 1 AND p.point_id % 8 <> 7)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return strain.peak_pairs(fx.points(spark, sf), A, B, 2.0)


@query("d7_peak_pairs", f"WITH {PAIRS} SELECT stack_id, point_id, nbr_id, round(dy, 4) + 0.0 AS dy, round(dx, 4) + 0.0 AS dx, axis FROM pairs")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_pairs(spark, sf).drop("frame"))


def _lattice(spark: SparkSession, sf: str) -> DataFrame:
    return strain.fit_lattice(fx.points(spark, sf), _pairs(spark, sf), "x < 35")


@query("d8_fit_lattice", "SELECT s_suppkey::BIGINT AS stack_id, 10.0::DOUBLE AS ay, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS by, 10.0::DOUBLE AS bx, 28::BIGINT AS n_a, 32::BIGINT AS n_b FROM supplier")
def d8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_lattice(spark, sf))


@query("d9_displacement", f"WITH {fx.POINTS_SQL} SELECT stack_id, point_id, (point_id // 8)::INT AS ia, (point_id % 8)::INT AS ib, 0.0::DOUBLE AS uy, round(x - 10 * (point_id % 8), 4) + 0.0 AS ux FROM points")
def d9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strain.displacement(fx.points(spark, sf), _lattice(spark, sf)).select("stack_id", "point_id", "ia", "ib", "uy", "ux"))


#: Two rows of atoms move apart by 0.4; the first atom is missing in every other frame and displaced in the others, as the last one is the other way.
MOVED = "CASE WHEN point_id = 0 THEN 1.5 WHEN point_id = 63 AND (s_suppkey + f) % 2 = 1 THEN -1.5 WHEN point_id % 8 = 2 THEN 0.4 WHEN point_id % 8 = 3 THEN -0.4 ELSE 0 END"
GONE = "point_id = 0 AND (s_suppkey + f) % 2 = 0"


@query("d9_stack_origin", f"SELECT s_suppkey::BIGINT AS stack_id, f AS frame, point_id, (point_id // 8)::INT AS ia, (point_id % 8)::INT AS ib, ({MOVED})::DOUBLE AS uy, 0.0::DOUBLE AS ux FROM supplier, (SELECT range AS f FROM range(4)), (SELECT range AS point_id FROM range(64)) WHERE NOT ({GONE})")
def d9_stack(spark: SparkSession, sf: str) -> DataFrame:
    """One origin for all frames of a stack, whose lattice starts between pixels; no frame's first atom can serve."""
    rows = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long"), F.explode(F.expr("sequence(0L, 3L)")).alias("f")).select("*", F.explode(F.expr("sequence(0L, 63L)")).alias("point_id")).where(f"not ({GONE})")
    pts = rows.select(F.col("s_suppkey").alias("stack_id"), F.col("f").alias("frame"), "point_id", F.expr(f"cast(3.3D + s_suppkey % 4 + 10*(point_id div 8) + ({MOVED}) as double)").alias("y"), F.expr("cast(7.1D + 10*(point_id % 8) as double)").alias("x"))
    vectors = pts.select("stack_id").distinct().select("stack_id", F.lit(10.0).alias("ay"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("by"), F.lit(10.0).alias("bx"))
    return rounded(strain.displacement(pts, vectors, origin="stack").select(*KEYS, "point_id", "ia", "ib", "uy", "ux"))


STRAIN = f"{fx.POINTS_SQL}, fields AS (SELECT stack_id, point_id, CASE WHEN point_id % 8 >= 4 THEN 0.01 * (1 + stack_id % 3) ELSE 0 END AS exx FROM points WHERE point_id < 56 AND point_id % 8 < 7)"


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    return strain.pair_strain(_pairs(spark, sf), _lattice(spark, sf), fx.points(spark, sf))


@query("d10_pair_strain", f"WITH {STRAIN} SELECT stack_id, point_id, round(exx::DOUBLE, 4) + 0.0 AS exx, 0.0::DOUBLE AS eyy, 0.0::DOUBLE AS exy, 0.0::DOUBLE AS rot FROM fields")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fields(spark, sf).select("stack_id", "point_id", "exx", "eyy", "exy", "rot"))


GPA = f"""{fx.LATTICE_SQL}, k AS (SELECT range - 12 AS k FROM range(24)), z AS (SELECT stack_id, frame, y, x, v * cos({fx.TWO_PI} * x / 6) AS re, -v * sin({fx.TWO_PI} * x / 6) AS im FROM lattice),
 rows_ AS (SELECT stack_id, frame, y, k AS kx, sum(re*cos({fx.TWO_PI}*k*x/24) + im*sin({fx.TWO_PI}*k*x/24)) AS re, sum(im*cos({fx.TWO_PI}*k*x/24) - re*sin({fx.TWO_PI}*k*x/24)) AS im FROM z, k GROUP BY ALL),
 f AS (SELECT stack_id, frame, k AS ky, kx, sum(re*cos({fx.TWO_PI}*k*y/24) + im*sin({fx.TWO_PI}*k*y/24)) AS re, sum(im*cos({fx.TWO_PI}*k*y/24) - re*sin({fx.TWO_PI}*k*y/24)) AS im FROM rows_, k GROUP BY ALL),
 h AS (SELECT stack_id, frame, ky, kx, re * exp(-2*9.869604401089358*9*(ky*ky + kx*kx)/576.0) / 576 AS re, im * exp(-2*9.869604401089358*9*(ky*ky + kx*kx)/576.0) / 576 AS im FROM f),
 cols AS (SELECT stack_id, frame, range AS y, kx, sum(re*cos({fx.TWO_PI}*ky*range/24) - im*sin({fx.TWO_PI}*ky*range/24)) AS re, sum(im*cos({fx.TWO_PI}*ky*range/24) + re*sin({fx.TWO_PI}*ky*range/24)) AS im FROM h, range(24) GROUP BY ALL),
 g AS (SELECT stack_id, frame, y, range AS x, sum(re*cos({fx.TWO_PI}*kx*range/24) - im*sin({fx.TWO_PI}*kx*range/24)) AS re, sum(im*cos({fx.TWO_PI}*kx*range/24) + re*sin({fx.TWO_PI}*kx*range/24)) AS im FROM cols, range(24) GROUP BY ALL)"""


@query("d11_gpa_phase", f"WITH {GPA} SELECT stack_id, frame, round(sum(re) / 571.3, 3) + 0.0 AS re, round(sum(im) / 571.3, 3) + 0.0 AS im, round(sum(re * (y*24 + x)) / 165431.7, 3) + 0.0 AS re_weighted, round(sum(im * (y*24 + x)) / 165431.7, 3) + 0.0 AS im_weighted, round(sum(sqrt(re*re + im*im) * (y*24 + x)) / 165431.7, 3) + 0.0 AS amplitude FROM g GROUP BY ALL")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    """Phase and amplitude of all pixels: scaled sums, and sums weighted by the pixel's place."""
    at = strain.gpa_phase(fx.lattice(spark, sf), (0.0, 1 / 6), 3.0)
    re, im = F.zip_with("amplitude", "phase", lambda a, p: a * F.cos(p)), F.zip_with("amplitude", "phase", lambda a, p: a * F.sin(p))
    total = lambda c, weigh: F.aggregate(F.transform(c, lambda v, i: v * i / 165431.7 if weigh else v / 571.3), F.lit(0.0), lambda a, v: a + v)
    at = at.withColumn("re", re).withColumn("im", im)
    return rounded(at.select(*KEYS, total("re", False).alias("re"), total("im", False).alias("im"), total("re", True).alias("re_weighted"), total("im", True).alias("im_weighted"), total("amplitude", True).alias("amplitude")), 3)


@query(
    "d12_gpa_strain",
    "SELECT s_suppkey::BIGINT AS stack_id, f AS frame, 1 - (3 + (s_suppkey + f) % 3) / 4.0::DOUBLE AS exx, 0.0::DOUBLE AS eyy, ((s_suppkey + f) % 2) / 4.0::DOUBLE AS exy, ((s_suppkey + f) % 2) / 4.0::DOUBLE AS rot FROM supplier, (SELECT range AS f FROM range(6))",
)
def d12(spark: SparkSession, sf: str) -> DataFrame:
    """Two waves whose frequencies stand off the reference ones by whole steps: the mean of the strain over the inner part is the planted one, of both signs, and sheared in every other frame."""
    g1, g2 = (0.0, 1 / 6), (1 / 6, 0.0)
    waves = fx.waves(spark, sf)
    out = strain.gpa_strain(strain.gpa_phase(waves, g1, 3.0), strain.gpa_phase(waves, g2, 3.0), g1, g2)
    mean = lambda c: F.aggregate(F.transform(c, lambda v, i: F.when((F.floor(i / 24) >= 6) & (F.floor(i / 24) < 18) & (i % 24 >= 6) & (i % 24 < 18), v / 144).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select(*KEYS, *(mean(c).alias(c) for c in ("exx", "eyy", "exy", "rot"))), 2)


@query(
    "d13_find_g",
    DFT + """, m AS (SELECT stack_id, ky, kx, avg(p) AS power FROM dft_p WHERE (ky > 0 OR (ky = 0 AND kx > 0)) AND ky*ky + kx*kx >= 4 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY round(power, 3) DESC, ky, kx) AS rank FROM m) SELECT stack_id, rank::INT AS rank, ky::BIGINT AS ky, kx::BIGINT AS kx, round(power, 2) + 0.0 AS power FROM r WHERE rank <= 3""",
)
def d13(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strain.find_g(fx.lattice(spark, sf), 3, 2.0), 2)


@query("d14_strain_summary", f"WITH {STRAIN} SELECT stack_id, count(*)::BIGINT AS n, round(avg(exx), 4) + 0.0 AS exx_mean, round(stddev_samp(exx), 4) + 0.0 AS exx_std, round(quantile_cont(exx::DOUBLE, 0.05), 4) + 0.0 AS exx_p5, round(quantile_cont(exx::DOUBLE, 0.5), 4) + 0.0 AS exx_p50, round(quantile_cont(exx::DOUBLE, 0.95), 4) + 0.0 AS exx_p95 FROM fields GROUP BY stack_id")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strain.strain_summary(_fields(spark, sf), ["stack_id"], ["exx"]))


# ---------------------------------------------------------------- regions

STATS = "count(*)::BIGINT AS n, sum(v)::DOUBLE AS sum, round(avg(v), 4) + 0.0 AS mean, round(stddev_samp(v), 4) + 0.0 AS std, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, median(v)::DOUBLE AS median, round(stddev_samp(v) / avg(v), 4) + 0.0 AS std_over_mean, round((max(v) - min(v)) / (max(v) + min(v))::DOUBLE, 4) + 0.0 AS michelson"


@query("e1_contrast_stats", f"WITH {fx.BLOBS_SQL} SELECT stack_id, frame, {STATS} FROM blobs GROUP BY stack_id, frame")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regions.contrast_stats(fx.blobs(spark, sf)))


@query("e2_histogram", f"WITH {fx.BLOBS_SQL} SELECT stack_id, frame, (CASE WHEN v < 21 THEN -1 WHEN v > 172 THEN 16 WHEN v = 172 THEN 15 ELSE floor((v - 21) / 151.0 * 16) END)::INT AS bin, count(*)::BIGINT AS n FROM blobs GROUP BY ALL")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    return regions.histogram(fx.blobs(spark, sf), 21, 172, 16)


@query(
    "e3_segment",
    f"""WITH {fx.BLOBS_SQL}, h AS (SELECT stack_id, frame, least(v, 255)::INT AS bin, count(*)::HUGEINT AS n FROM blobs GROUP BY ALL),
    c AS (SELECT stack_id, frame, bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS m0, sum(n) OVER a AS w, sum(n * bin) OVER a AS m FROM h WINDOW w AS (PARTITION BY stack_id, frame ORDER BY bin), a AS (PARTITION BY stack_id, frame)),
    t AS (SELECT stack_id, frame, arg_max(bin, (m0 * w - m * w0)::DOUBLE * (m0 * w - m * w0)::DOUBLE / (w0 * (w - w0))::DOUBLE) + 1 AS t FROM c WHERE w0 < w GROUP BY ALL)
    SELECT stack_id, frame, sum(CASE WHEN v > 100 THEN 1 ELSE 0 END)::BIGINT AS fixed, sum(CASE WHEN v > t THEN 1 ELSE 0 END)::BIGINT AS otsu FROM blobs JOIN t USING (stack_id, frame) GROUP BY ALL""",
)
def e3(spark: SparkSession, sf: str) -> DataFrame:
    n = F.aggregate("px", F.lit(0.0), lambda a, v: a + v).cast("long")
    blobs = fx.blobs(spark, sf)
    return meet(regions.segment(blobs, 100.0).select(*KEYS, n.alias("fixed")), regions.segment(blobs, "otsu", lo=0, hi=256).select(*KEYS, n.alias("otsu")), KEYS)


def _labels(spark: SparkSession, sf: str, tile: int | None = None) -> DataFrame:
    return regions.label_regions(regions.segment(fx.blobs(spark, sf), 100.0), tile=tile)


REGIONS = f"""{fx.BLOBS_SQL}, m AS (SELECT stack_id, frame, y, x, v FROM blobs WHERE v > 100),
 l AS (SELECT *, CASE WHEN (y-8)*(y-8) + (x-8)*(x-8) < (1+frame)*(1+frame) THEN 1 ELSE 2 END AS blob FROM m),
 labels AS (SELECT stack_id, frame, y, x, v, min(y*24 + x) OVER (PARTITION BY stack_id, frame, blob) AS label FROM l)"""


@query(
    "e4_label_regions",
    f"""WITH RECURSIVE {fx.BLOBS_SQL}, m AS (SELECT stack_id, frame, y, x, (y*24 + x) AS i FROM blobs WHERE v > 100),
    r AS (SELECT stack_id, frame, i, i AS label FROM m UNION SELECT b.stack_id, b.frame, b.i, r.label FROM r JOIN m a ON a.stack_id = r.stack_id AND a.frame = r.frame AND a.i = r.i JOIN m b ON b.stack_id = a.stack_id AND b.frame = a.frame AND abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE r.label < b.i)
    SELECT stack_id, frame, (i // 24)::INT AS y, (i % 24)::INT AS x, min(label)::BIGINT AS label FROM r GROUP BY ALL""",
)
def e4(spark: SparkSession, sf: str) -> DataFrame:
    """In tiles that cut through the regions; labels are joined over the borders."""
    return regions.labels_long(_labels(spark, sf, tile=7))


@query("e5_measure_regions", f"WITH {REGIONS} SELECT stack_id, frame, label::BIGINT AS label, count(*)::BIGINT AS area_px, round(avg(y), 4) + 0.0 AS cy, round(avg(x), 4) + 0.0 AS cx, min(y)::INT AS y_min, min(x)::INT AS x_min, max(y)::INT AS y_max, max(x)::INT AS x_max, round(avg(v), 4) + 0.0 AS mean FROM labels GROUP BY ALL")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regions.measure_regions(_labels(spark, sf), fx.blobs(spark, sf)))


@query(
    "e6_track_regions",
    f"""WITH {REGIONS}, t AS (SELECT stack_id, frame, blob, min(y*24 + x) AS label, count(*) AS area FROM l GROUP BY ALL),
    f AS (SELECT *, first(label) OVER (PARTITION BY stack_id, blob ORDER BY frame) AS l0, lag(area) OVER (PARTITION BY stack_id, blob ORDER BY frame) AS before, lead(area) OVER (PARTITION BY stack_id, blob ORDER BY frame) AS after FROM t)
    SELECT stack_id, frame, label::BIGINT AS label, stack_id || ':0:' || l0 AS track, area::BIGINT AS area, (area - before)::BIGINT AS area_change, CASE WHEN before IS NULL THEN 'birth' ELSE 'continue' END AS event, after IS NULL AS dies FROM f""",
)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return regions.track_regions(_labels(spark, sf))


#: Bars by frame as (first row, rows, first column, columns): one splits, its parts merge and end, another comes and goes.
BARS = ((0, 4, 3, 2, 18), (1, 4, 3, 2, 8), (1, 4, 3, 13, 7), (2, 4, 3, 2, 18), (3, 15, 3, 5, 4), (4, 15, 3, 5, 4))


@query(
    "e6_split_merge",
    """WITH t AS (SELECT * FROM (VALUES (0, 98, 54, NULL, 0, 98, 'birth', false), (1, 98, 24, -30, 0, 98, 'continue', false), (1, 109, 21, -33, 1, 109, 'split', false), (2, 98, 54, 30, 0, 98, 'merge', true), (3, 365, 12, NULL, 3, 365, 'birth', false), (4, 365, 12, 0, 3, 365, 'continue', true)) v(frame, label, area, area_change, f0, l0, event, dies))
    SELECT s_suppkey::BIGINT AS stack_id, frame::BIGINT AS frame, (label + s_suppkey % 3)::BIGINT AS label, s_suppkey || ':' || f0 || ':' || (l0 + s_suppkey % 3) AS track, area::BIGINT AS area, area_change::BIGINT AS area_change, event, dies FROM supplier, t""",
)
def e6_split(spark: SparkSession, sf: str) -> DataFrame:
    """All four events, planted: birth, split, merge, death."""
    def value(s: str, f: str, y: str, x: str) -> str:
        inside = [f"({f} = {k} AND {y} >= {y0} AND {y} < {y0 + h} AND {x} >= {x0} + {s} % 3 AND {x} < {x0 + w} + {s} % 3)" for k, y0, h, x0, w in BARS]
        return f"(CASE WHEN {' OR '.join(inside)} THEN 200 ELSE 0 END)"

    return regions.track_regions(regions.label_regions(regions.segment(fx._frames(spark, sf, value), 100.0)))


@query(
    "e7_area_series",
    f"""WITH {fx.BLOBS_SQL}, a AS (SELECT stack_id, frame, sum(CASE WHEN v > 100 THEN 1 ELSE 0 END) AS n FROM blobs GROUP BY ALL)
    SELECT stack_id, frame, n::BIGINT AS area_px, round(n / 576.0::DOUBLE, 4) + 0.0 AS fraction, (n - lag(n) OVER w)::DOUBLE AS rate, round(n * 0.25, 4)::DOUBLE AS area_nm2, round((n - lag(n) OVER w) * 0.25 / 2, 4)::DOUBLE AS rate_nm2_s FROM a WINDOW w AS (PARTITION BY stack_id ORDER BY frame)""",
)
def e7(spark: SparkSession, sf: str) -> DataFrame:
    blobs = fx.blobs(spark, sf)
    calib = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("stack_id"), F.lit(0.5).alias("nm_per_px"), F.lit(2.0).alias("s_per_frame"))
    return rounded(regions.area_series(regions.measure_regions(_labels(spark, sf)), blobs, calib))


@query(
    "e8_polygon_area",
    "WITH b AS (SELECT s_suppkey::BIGINT AS roi_id, 1 + s_suppkey % 4 AS h, 2 + s_suppkey % 3 AS w FROM supplier) SELECT roi_id, (h * w)::DOUBLE AS area, (2 * (h + w))::DOUBLE AS perimeter, (h / 2.0)::DOUBLE AS cy, (w / 2.0)::DOUBLE AS cx FROM b",
)
def e8(spark: SparkSession, sf: str) -> DataFrame:
    """A rectangle for each supplier, its vertices in turn."""
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("roi_id"), (1 + F.col("s_suppkey") % 4).cast("double").alias("h"), (2 + F.col("s_suppkey") % 3).cast("double").alias("w"))
    rois = s.select("roi_id", F.expr("inline(array(struct(0 as vertex, 0D as y, 0D as x), struct(1 as vertex, 0D as y, w as x), struct(2 as vertex, h as y, w as x), struct(3 as vertex, h as y, 0D as x)))"))
    return rounded(regions.polygon_area(rois))


@query("e9_in_roi", f"WITH {fx.BLOBS_SQL} SELECT stack_id, frame, roi_id::BIGINT AS roi_id, count(*)::BIGINT AS n, sum(v)::DOUBLE AS total FROM blobs, (SELECT unnest([1, 2, 3]) AS roi_id) WHERE (roi_id = 1 AND y < 10 AND x < 10) OR (roi_id = 2 AND y < 6 AND x < 8 - y * 8 / 6.0) OR (roi_id = 3 AND ((y < 4 AND x < 2) OR (y < 2 AND x < 4))) GROUP BY ALL")
def e9(spark: SparkSession, sf: str) -> DataFrame:
    hit = regions.in_roi(frames.to_pixels(fx.blobs(spark, sf)), fx.rois(spark))
    return hit.groupBy(*KEYS, "roi_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("e1_contrast_patchy", f"WITH {fx.PATCHY_SQL} SELECT stack_id, frame, {STATS} FROM patchy GROUP BY stack_id, frame")
def e1_patchy(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of odd sizes with holes and gaps."""
    return rounded(regions.contrast_stats(fx.patchy(spark, sf)))


@query(
    "d1_peaks_patchy",
    f"""WITH {fx.PATCHY_SQL}, p AS (SELECT p.stack_id, p.frame, p.y, p.x, p.w, p.v FROM patchy p JOIN patchy q ON p.stack_id = q.stack_id AND p.frame = q.frame AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2
    WHERE p.v > 70 GROUP BY ALL HAVING count(CASE WHEN (q.y, q.x) <> (p.y, p.x) AND (q.v > p.v OR (q.v = p.v AND (q.y < p.y OR (q.y = p.y AND q.x < p.x)))) THEN 1 END) = 0)
    SELECT p.stack_id, p.frame, (p.y * p.w + p.x)::BIGINT AS point_id, p.v::DOUBLE AS intensity, sum(q.v)::DOUBLE AS sum, count(*)::BIGINT AS n FROM p JOIN patchy q ON p.stack_id = q.stack_id AND p.frame = q.frame AND (p.y-q.y)*(p.y-q.y) + (p.x-q.x)*(p.x-q.x) <= 4 GROUP BY ALL""",
)
def d1_patchy(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks and their disks in frames of odd sizes with holes, in tiles that do not divide them."""
    f = fx.patchy(spark, sf)
    pts = atoms.detect_peaks(f, 2, 70.0, tile=8)
    return rounded(meet(pts.select(*KEYS, "point_id", "intensity"), atoms.atom_intensity(pts, f, 2.0, tile=8).select(*KEYS, "point_id", "sum", "n"), [*KEYS, "point_id"]))


@query("e1_contrast_rois", f"WITH {fx.BLOBS_SQL}, r AS (SELECT * FROM blobs, (SELECT unnest([1, 2, 3]) AS roi_id) WHERE (roi_id = 1 AND y < 10 AND x < 10) OR (roi_id = 2 AND y < 6 AND x < 8 - y * 8 / 6.0) OR (roi_id = 3 AND ((y < 4 AND x < 2) OR (y < 2 AND x < 4)))) SELECT stack_id, frame, roi_id::BIGINT AS roi_id, {STATS} FROM r GROUP BY stack_id, frame, roi_id")
def e1_rois(spark: SparkSession, sf: str) -> DataFrame:
    """Contrast in hand-drawn regions: their spans meet the packed rows of every frame."""
    return rounded(regions.contrast_stats(fx.blobs(spark, sf), fx.rois(spark)))


CRYSTAL = DFT.replace("WITH ", "WITH ", 1) + """, b AS (SELECT *, avg(p) OVER (PARTITION BY stack_id, frame, r) AS b FROM dft_p), c AS (SELECT stack_id, frame, sum(greatest(p - b, 0)) / sum(p) AS crystallinity FROM (SELECT * FROM b WHERE ky*ky + kx*kx BETWEEN 4 AND 64) GROUP BY ALL)"""


@query("e10_classify_tiles", CRYSTAL + " SELECT stack_id, frame, round(crystallinity, 4) + 0.0 AS crystallinity, CASE WHEN crystallinity >= 0.5 THEN 'crystalline' ELSE 'amorphous' END AS class FROM c")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regions.classify_tiles(frames.to_tiles(fx.lattice(spark, sf), 24), 2, 8, 0.5).select(*KEYS, "crystallinity", "class"))


def _quarters(name: str) -> str:
    """Tiles of 12 pixels as frames of their own: stack_id stands for the tile too."""
    return f"{name} AS (SELECT stack_id * 4 + (y // 12) * 2 + x // 12 AS stack_id, frame, y % 12 AS y, x % 12 AS x, v FROM lattice)"


@query(
    "e10_classify_quarters",
    f"""WITH {fx.LATTICE_SQL}, {_quarters('q')}, {fx.dft_sql('q', n=12)}, b AS (SELECT *, avg(p) OVER (PARTITION BY stack_id, frame, r) AS b FROM dft_p),
    c AS (SELECT stack_id, frame, sum(greatest(p - b, 0)) / sum(p) AS crystallinity FROM (SELECT * FROM b WHERE ky*ky + kx*kx BETWEEN 4 AND 25) GROUP BY ALL)
    SELECT stack_id // 4 AS stack_id, frame, (stack_id % 4 // 2)::INT AS ty, (stack_id % 2)::INT AS tx, round(crystallinity, 4) + 0.0 AS crystallinity, CASE WHEN crystallinity >= 0.5 THEN 'crystalline' ELSE 'amorphous' END AS class FROM c""",
)
def e10_quarters(spark: SparkSession, sf: str) -> DataFrame:
    """Four tiles a frame, each with its own spectrum."""
    return rounded(regions.classify_tiles(frames.to_tiles(fx.lattice(spark, sf), 12), 2, 5, 0.5).select(*KEYS, "ty", "tx", "crystallinity", "class"))


@query(
    "e11_phase_fraction",
    """WITH c AS (SELECT user_id::BIGINT AS stack_id, day(ts)::BIGINT AS frame, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS c FROM events), f AS (SELECT stack_id, frame, count(*)::BIGINT AS tiles, avg(c) AS fraction FROM c GROUP BY ALL)
    SELECT stack_id, frame, tiles, round(fraction, 4) + 0.0 AS fraction, round(fraction - lag(fraction) OVER (PARTITION BY stack_id ORDER BY frame), 4) + 0.0 AS change FROM f
    UNION ALL SELECT stack_id, NULL, count(*)::BIGINT, round(avg(c), 4) + 0.0, NULL FROM c GROUP BY stack_id""",
)
def e11(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.table(spark, sf, "events").select(F.col("user_id").cast("long").alias("stack_id"), F.dayofmonth("ts").cast("long").alias("frame"), F.when(F.col("event_id") % 3 == 0, "crystalline").otherwise("amorphous").alias("class"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return rounded(regions.phase_fraction(events))
