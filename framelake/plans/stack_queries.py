"""Queries of the frame, drift and filter operators, each with DuckDB SQL that takes another route."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, filters, frames
from ..sources import large, stacks
from ..storage import meet, new_path
from . import fixtures as fx

KEYS = ["stack_id", "frame"]
QUERIES: dict = {}
ORACLES: dict = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, without a negative zero, so that engines that sum in another order agree."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def summed(df: DataFrame, *more) -> DataFrame:
    """A digest of packed frames: size, sum and position-weighted sum."""
    total = lambda f: F.aggregate(F.transform("px", f), F.lit(0.0), lambda a, v: a + v)
    return df.select(*KEYS, F.size("px").cast("long").alias("n"), total(lambda v, i: v).alias("total"), total(lambda v, i: v * (i + 1)).alias("weighted"), *more)


SUMS = "count(*)::BIGINT AS n, round(sum(v)::DOUBLE, 4) + 0.0 AS total, round(sum(v * (y*24 + x + 1))::DOUBLE, 4) + 0.0 AS weighted"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


A1_SQL = f"WITH {fx.LATTICE_SQL} SELECT stack_id, frame, {SUMS}, 24::INT AS height, 'uint8' AS dtype FROM lattice GROUP BY stack_id, frame"


def _files(spark: SparkSession, sf: str, broken: bool) -> str:
    """A folder of npy files, one for each stack, named by it, and one that is cut off, if wanted; written to the shared folder's own store, whatever it is."""
    folder = new_path(spark, "stacks")
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        store, at = pyarrow.fs.FileSystem.from_uri(uri)
        store.create_dir(at)
        part = part.sort_values("frame")
        data = stacks.npy_bytes(np.stack([np.asarray(p).reshape(24, 24) for p in part["px"]]).astype(np.uint8))
        stack = int(part["stack_id"].iloc[0])
        for name, held in [(f"stack-{stack:012d}.npy", data), *([("broken-7.npy", data[:100])] if broken and stack == 7 else [])]:
            with store.open_output_stream(f"{at}/{name}") as f:
                f.write(held)
        return pd.DataFrame({"stack_id": [stack]})

    fx.lattice(spark, sf).groupBy("stack_id").applyInPandas(pack, "stack_id long").count()
    return folder


@query("a1_read_stacks", A1_SQL + " UNION ALL SELECT 7, NULL, NULL, NULL, NULL, NULL, NULL")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of npy files, one of them broken, read by Spark and decoded once; the broken one is a row without a frame."""
    files = stacks.stack_files(spark, _files(spark, sf, True), stack_id=F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("long"))
    found = stacks.decoded(files)
    digest = summed(found, "height", "dtype", "error")
    return rounded(digest.select("stack_id", "frame", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("n", "total", "weighted", "height", "dtype"))))


@query("a1_read_ranges", A1_SQL)
def a1_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same files by frame ranges, four frames a task, each stack's number in its file's name."""
    large.register(spark)
    folder = _files(spark, sf, False).removeprefix("file://").removeprefix("file:")
    found = spark.read.format("npy_frames").option("path", folder).option("frames", 4).option("stack", r"(\d+)\.npy$").load()
    return rounded(summed(found, "height", "dtype"))


@query("a2_select_frames", "SELECT user_id AS stack_id, event_id AS frame, round(value, 4) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.table(spark, sf, "events").select(F.col("user_id").cast("long").alias("stack_id"), F.col("event_id").cast("long").alias("frame"), "ts", "value")
    return rounded(frames.select_frames(events, every_s=3600).select("stack_id", "frame", "value"))


@query("a3_write_frames", f"WITH {fx.LATTICE_SQL} SELECT stack_id, frame, {SUMS}, 'uint8' AS dtype FROM lattice GROUP BY stack_id, frame")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    out = new_path(spark, "frames")
    stacks.write_frames(fx.lattice(spark, sf), out, [sf])
    return rounded(summed(stacks.read_frames(spark, out), "dtype"))


@query("a4_convert_depth", f"WITH {fx.LATTICE_SQL}, c AS (SELECT stack_id, frame, y, x, floor(v / 255.0 * 65535.0 + 0.5) AS v FROM lattice) SELECT stack_id, frame, {SUMS}, 'uint16' AS dtype, 'uint8' AS old_dtype FROM c GROUP BY stack_id, frame")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summed(frames.convert_depth(fx.lattice(spark, sf), "uint16"), "dtype", "old_dtype"))


@query("a5_calibrate", f"WITH {fx.POINTS_SQL} SELECT stack_id, point_id, round(y * (0.1 + stack_id % 3), 4) + 0.0 AS y_nm, round(x * (0.1 + stack_id % 3), 4) + 0.0 AS x_nm, 0.0::DOUBLE AS time_s FROM points")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    pts = fx.points(spark, sf)
    calib = pts.select("stack_id").distinct().select("stack_id", (0.1 + F.col("stack_id") % 3).alias("nm_per_px"), F.lit(0.5).alias("s_per_frame"))
    return rounded(frames.calibrate(pts, calib).select("stack_id", "point_id", "y_nm", "x_nm", "time_s"))


@query("a6_tiles", f"WITH {fx.LATTICE_SQL} SELECT stack_id, frame, {SUMS}, 9::BIGINT AS tiles FROM lattice GROUP BY stack_id, frame")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    tiles = frames.to_tiles(fx.lattice(spark, sf), 10, 3)
    return rounded(meet(summed(frames.from_tiles(tiles, 10)), tiles.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("tiles")), KEYS))


@query("a7_pixels", f"WITH {fx.LATTICE_SQL} SELECT stack_id, frame, {SUMS} FROM lattice GROUP BY stack_id, frame")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summed(frames.from_pixels(frames.to_pixels(fx.lattice(spark, sf)))))


@query("a8_manifest", "SELECT p_partkey::BIGINT AS key, md5('demo|1.0||radius=3|threshold=0.5') AS run_id, '3' AS radius, 'px' AS radius_unit FROM part")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    rows, run = frames.with_manifest(fx.table(spark, sf, "part"), "demo", "1.0", {"radius": 3, "threshold": 0.5}, {"radius": "px"})
    about = run.select("run_id", F.col("params")["radius"].alias("radius"), F.col("units")["radius"].alias("radius_unit"))
    return rows.join(F.broadcast(about), "run_id").select(F.col("p_partkey").cast("long").alias("key"), "run_id", "radius", "radius_unit")


@query(
    "a8_manifest_table",
    """WITH r AS (SELECT unnest(['3', '5']) AS radius), m AS (SELECT md5('demo|1.0||radius=' || radius || '|threshold=0.5') AS run_id, radius FROM r)
    SELECT p_partkey::BIGINT AS key, run_id, radius, 'px' AS radius_unit, 2::BIGINT AS runs FROM part, m WHERE radius = CASE WHEN p_partkey % 2 = 0 THEN '3' ELSE '5' END""",
)
def a8_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs appended to a manifest table, the first of them twice: two rows; each result finds its run by run_id."""
    part, path = fx.table(spark, sf, "part"), new_path(spark, "manifest")
    results = []
    for radius, odd in ((3, 0), (5, 1), (3, 0)):
        rows, run = frames.with_manifest(part.where(F.col("p_partkey") % 2 == odd), "demo", "1.0", {"radius": radius, "threshold": 0.5}, {"radius": "px"})
        frames.append_manifest(run, path)
        results.append(rows)
    about = frames.read_manifest(spark, path)
    about = about.select("run_id", F.col("params")["radius"].alias("radius"), F.col("units")["radius"].alias("radius_unit"), F.lit(about.count()).cast("long").alias("runs"))
    return results[0].union(results[1]).join(F.broadcast(about), "run_id").select(F.col("p_partkey").cast("long").alias("key"), "run_id", "radius", "radius_unit", "runs")


@query(
    "a9_compare_runs",
    """WITH a AS (SELECT p_partkey::BIGINT AS key, p_retailprice::DOUBLE AS v FROM part WHERE p_partkey % 11 <> 0),
    b AS (SELECT p_partkey::BIGINT AS key, p_retailprice::DOUBLE + CASE WHEN p_partkey % 5 = 0 THEN 0.01 WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM part WHERE p_partkey % 13 <> 0)
    SELECT coalesce(a.key, b.key) AS key, round(a.v, 4) + 0.0 AS v_before, round(b.v, 4) + 0.0 AS v_after, round(b.v - a.v, 4) + 0.0 AS v_diff,
    CASE WHEN b.key IS NULL THEN 'only_before' WHEN a.key IS NULL THEN 'only_after' WHEN a.v = b.v THEN 'same' WHEN abs(b.v - a.v) <= 0.1 THEN 'within' ELSE 'beyond' END AS status
    FROM a FULL JOIN b ON a.key = b.key""",
)
def a9(spark: SparkSession, sf: str) -> DataFrame:
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("key"), F.col("p_retailprice").cast("double").alias("v"))
    after = part.withColumn("v", F.col("v") + F.when(F.col("key") % 5 == 0, 0.01).when(F.col("key") % 7 == 0, 1.0).otherwise(0.0))
    return rounded(frames.compare_runs(part.where("key % 11 <> 0"), after.where("key % 13 <> 0"), ["key"], {"v": 0.1}))


NCC = f"""WITH {fx.LATTICE_SQL}, s AS (SELECT a AS dy, b AS dx FROM (SELECT range - 2 AS a FROM range(5)), (SELECT range - 2 AS b FROM range(5))),
 c AS (SELECT p.stack_id, q.frame, s.dy, s.dx, corr(p.v, q.v) AS ncc FROM lattice p CROSS JOIN s JOIN lattice q ON p.stack_id = q.stack_id AND q.frame = p.frame + 1 AND q.y = p.y + s.dy AND q.x = p.x + s.dx GROUP BY ALL)"""


@query("b1_pair_shifts", NCC + " SELECT stack_id, frame, dy::DOUBLE AS dy, dx::DOUBLE AS dx, round(ncc, 4) + 0.0 AS ncc FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, frame ORDER BY ncc DESC, dy, dx) AS r FROM c) WHERE r = 1")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drift.pair_shifts(fx.lattice(spark, sf), 2))


SUBPIXEL = "0.1*((s_suppkey + 2*f) % 7)", "0.1*((2*s_suppkey + f) % 5)"


@query(
    "b1_subpixel_shifts",
    f"WITH o AS (SELECT s_suppkey::BIGINT AS stack_id, f AS frame, {SUBPIXEL[0]} AS oy, {SUBPIXEL[1]} AS ox FROM supplier, (SELECT range AS f FROM range(6))) SELECT a.stack_id, b.frame, round((b.oy - a.oy)::DOUBLE, 4) + 0.0 AS dy, round((b.ox - a.ox)::DOUBLE, 4) + 0.0 AS dx FROM o a JOIN o b ON b.stack_id = a.stack_id AND b.frame = a.frame + 1",
)
def b1_subpixel(spark: SparkSession, sf: str) -> DataFrame:
    """Three waves moved by tenths of a pixel, found in steps of a twentieth."""
    oy, ox = (x.replace("s_suppkey", "s").replace("0.1", "0.1D") for x in SUBPIXEL)
    y, x = f"((i div 24) - {oy})", f"((i % 24) - {ox})"
    value = lambda s, f, *_: f"(100D + 40D*cos({fx.TWO_PI}D/24 * 2*{y}) + 30D*cos({fx.TWO_PI}D/24 * 3*{x}) + 20D*cos({fx.TWO_PI}D/24 * (2*{y} + {x})))"
    return rounded(drift.pair_shifts(fx._frames(spark, sf, value), 1, upsample=20).select(*KEYS, "dy", "dx"))


@query("b1_first_shifts", f"WITH {fx.OFFSET_SQL} SELECT a.stack_id, a.frame, (a.oy - b.oy)::DOUBLE AS dy, (a.ox - b.ox)::DOUBLE AS dx FROM offsets a JOIN offsets b ON a.stack_id = b.stack_id AND b.frame = 0 WHERE a.frame > 0")
def b1_first(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame against its stack's first."""
    return rounded(drift.pair_shifts(fx.lattice(spark, sf), 2, against="first").select(*KEYS, "dy", "dx"))


@query("b2_accumulate", f"WITH {fx.OFFSET_SQL} SELECT a.stack_id, a.frame, (a.oy - b.oy)::DOUBLE AS drift_y, (a.ox - b.ox)::DOUBLE AS drift_x FROM offsets a JOIN offsets b ON a.stack_id = b.stack_id AND b.frame = 0 WHERE a.frame > 0")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(drift.accumulate(drift.pair_shifts(fx.lattice(spark, sf), 2)).select(*KEYS, "drift_y", "drift_x"))


@query(
    "b3_repair_shifts",
    """WITH s AS (SELECT user_id::BIGINT AS stack_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS frame, value::DOUBLE AS dy, -value::DOUBLE AS dx, (event_id % 10) / 10.0::DOUBLE AS ncc FROM events),
    m AS (SELECT *, median(CASE WHEN ncc >= 0.35 THEN dy END) OVER w AS my, median(CASE WHEN ncc >= 0.35 THEN dx END) OVER w AS mx FROM s WINDOW w AS (PARTITION BY stack_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT stack_id, frame, round(CASE WHEN ncc >= 0.35 THEN dy ELSE coalesce(my, 0) END, 4) + 0.0 AS dy, round(CASE WHEN ncc >= 0.35 THEN dx ELSE coalesce(mx, 0) END, 4) + 0.0 AS dx,
    CASE WHEN ncc >= 0.35 THEN 'kept' WHEN my IS NOT NULL THEN 'median' ELSE 'zero' END AS repaired FROM m""",
)
def b3(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.table(spark, sf, "events").selectExpr("cast(user_id as long) stack_id", "cast(row_number() over (partition by user_id order by ts, event_id) as long) frame", "cast(value as double) dy", "-cast(value as double) dx", "(event_id % 10) / 10.0D ncc")
    return rounded(drift.repair_shifts(events, 0.35, 1).select(*KEYS, "dy", "dx", "repaired"))


@query(
    "b4_apply_shift",
    f"""WITH {fx.LATTICE_SQL}, {fx.OFFSET_SQL}, d AS (SELECT a.stack_id, a.frame, a.oy - b.oy AS dy, a.ox - b.ox AS dx FROM offsets a JOIN offsets b ON a.stack_id = b.stack_id AND b.frame = 0),
    e AS (SELECT stack_id, min(dy) AS y0, max(dy) AS y1, min(dx) AS x0, max(dx) AS x1 FROM d GROUP BY stack_id),
    m AS (SELECT l.stack_id, l.frame, l.y - d.dy AS y, l.x - d.dx AS x, l.v, greatest(0, -y0) AS t, greatest(0, -x0) AS q, 24 - greatest(0, y1) AS b, 24 - greatest(0, x1) AS r FROM lattice l JOIN d USING (stack_id, frame) JOIN e USING (stack_id))
    SELECT stack_id, frame, count(*)::BIGINT AS n, sum(v)::DOUBLE AS total, sum(v * ((y - t) * (r - q) + x - q + 1))::DOUBLE AS weighted, max(b - t)::INT AS height, max(r - q)::INT AS width FROM m WHERE y >= t AND y < b AND x >= q AND x < r GROUP BY ALL""",
)
def b4(spark: SparkSession, sf: str) -> DataFrame:
    lat = fx.lattice(spark, sf)
    return rounded(summed(drift.apply_shift(lat, drift.accumulate(drift.pair_shifts(lat, 2))), "height", "width"))


@query(
    "b5_video_pipeline",
    f"""WITH {fx.LATTICE_SQL}, {fx.OFFSET_SQL}, d AS (SELECT a.stack_id, a.frame, a.oy - b.oy AS dy, a.ox - b.ox AS dx FROM offsets a JOIN offsets b ON a.stack_id = b.stack_id AND b.frame = 0 WHERE a.frame % 2 = 0),
    e AS (SELECT stack_id, min(dy) AS y0, max(dy) AS y1, min(dx) AS x0, max(dx) AS x1 FROM d GROUP BY stack_id),
    m AS (SELECT l.stack_id, l.frame // 2 AS frame, l.y - d.dy AS y, l.x - d.dx AS x, l.v, greatest(0, -y0) AS t, greatest(0, -x0) AS q, 24 - greatest(0, y1) AS b, 24 - greatest(0, x1) AS r FROM lattice l JOIN d USING (stack_id, frame) JOIN e USING (stack_id))
    SELECT stack_id, frame, count(*)::BIGINT AS n, sum(v)::DOUBLE AS total, sum(v * ((y - t) * (r - q) + x - q + 1))::DOUBLE AS weighted, max(b - t)::INT AS height, max(r - q)::INT AS width, '2' AS every_n, 'video_pipeline' AS operator FROM m WHERE y >= t AND y < b AND x >= q AND x < r GROUP BY ALL""",
)
def b5(spark: SparkSession, sf: str) -> DataFrame:
    """Every second frame, which drift by whole pixels; corrected, cropped to what they share, written with their run's manifest and read back."""
    out, run = drift.video_run(fx.lattice(spark, sf), new_path(spark, "video"), {"every_n": 2}, 2, source=sf)
    return rounded(summed(out.join(F.broadcast(run), "run_id"), "height", "width", F.col("params")["every_n"].alias("every_n"), "operator"))


DFT = f"WITH {fx.LATTICE_SQL}, {fx.dft_sql('lattice')}"


@query("c1_power_spectrum", DFT + " SELECT stack_id, frame, count(*)::BIGINT AS n, round(sum(p) / 1e6, 4) + 0.0 AS total, round(max(CASE WHEN ky = 0 AND kx = 0 THEN p END) / 1e6, 4) + 0.0 AS zero, round(max(CASE WHEN ky = -4 AND kx = 4 THEN p END) / 1e6, 4) + 0.0 AS corner FROM dft_p GROUP BY stack_id, frame")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda ky, kx: F.element_at("px", (ky + 12) * 24 + kx + 13) / 1e6
    return rounded(summed(filters.power_spectrum(fx.lattice(spark, sf)), at(0, 0).alias("zero"), at(-4, 4).alias("corner")).withColumn("total", F.col("total") / 1e6).drop("weighted"))


@query("c2_radial_profile", f"WITH {fx.LATTICE_SQL} SELECT stack_id, frame, floor(sqrt(((y-12)*(y-12) + (x-12)*(x-12))::DOUBLE) + 0.5)::BIGINT AS r, round(avg(v), 4) + 0.0 AS mean, count(*)::BIGINT AS n FROM lattice GROUP BY ALL")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(filters.radial_profile(fx.lattice(spark, sf)))


def _gain_sql(gain: str) -> str:
    return DFT + f""", b AS (SELECT stack_id, frame, r, avg(p) AS b FROM dft_p GROUP BY ALL), g AS (SELECT stack_id, frame, re, p, {gain} AS g FROM dft_p JOIN b USING (stack_id, frame, r))
    SELECT stack_id, frame, round(sum(p * g * g) / 576, 2) + 0.0 AS energy, round(sum(re * g) / 576, 4) + 0.0 AS first FROM g GROUP BY stack_id, frame"""


def _energy(df: DataFrame) -> DataFrame:
    """Energy and first pixel of filtered frames; SQL has them from the spectrum (Parseval)."""
    return rounded(df.select(*KEYS, (F.round(F.aggregate("px", F.lit(0.0), lambda a, v: a + v * v), 2) + F.lit(0.0)).alias("energy"), F.element_at("px", 1).alias("first")))


@query("c3_wiener", _gain_sql("CASE WHEN p > 0 THEN greatest(0, (p - b) / p) ELSE 0 END"))
def c3(spark: SparkSession, sf: str) -> DataFrame:
    return _energy(filters.wiener(fx.lattice(spark, sf)))


@query("c4_absf", _gain_sql("CASE WHEN p > 0 THEN greatest(0, (sqrt(p) - sqrt(b)) / sqrt(p)) ELSE 0 END"))
def c4(spark: SparkSession, sf: str) -> DataFrame:
    return _energy(filters.absf(fx.lattice(spark, sf)))


@query("c5_band_filter", _gain_sql("CASE WHEN ky*ky + kx*kx >= 9 AND ky*ky + kx*kx <= 49 THEN 1 ELSE 0 END"))
def c5(spark: SparkSession, sf: str) -> DataFrame:
    return _energy(filters.band_filter(fx.lattice(spark, sf), 3, 7))


REFLECT = "o AS (SELECT a AS dy, b AS dx FROM (SELECT range - 1 AS a FROM range(3)), (SELECT range - 1 AS b FROM range(3)))"


@query(
    "c6_spatial_filter",
    f"""WITH {fx.LATTICE_SQL}, {REFLECT}, n AS (SELECT l.stack_id, l.frame, l.y, l.x, l.y + dy AS yy, l.x + dx AS xx FROM lattice l, o),
    m AS (SELECT n.stack_id, n.frame, n.y, n.x, median(l.v) AS med, avg(l.v) AS mean FROM n JOIN lattice l ON l.stack_id = n.stack_id AND l.frame = n.frame AND l.y = (CASE WHEN yy < 0 THEN -yy - 1 WHEN yy > 23 THEN 47 - yy ELSE yy END) AND l.x = (CASE WHEN xx < 0 THEN -xx - 1 WHEN xx > 23 THEN 47 - xx ELSE xx END) GROUP BY ALL)
    SELECT stack_id, frame, round(sum(med)::DOUBLE, 4) + 0.0 AS median_total, round(sum(mean), 3) + 0.0 AS mean_total, round(sum(med * (y*24 + x + 1))::DOUBLE, 4) + 0.0 AS median_weighted FROM m GROUP BY ALL""",
)
def c6(spark: SparkSession, sf: str) -> DataFrame:
    lat = fx.lattice(spark, sf)
    med, mean = summed(filters.spatial_filter(lat, "median", 3)), summed(filters.spatial_filter(lat, "mean", 3))
    return meet(med.select(*KEYS, F.col("total").alias("median_total"), F.col("weighted").alias("median_weighted")), mean.select(*KEYS, (F.round("total", 3) + F.lit(0.0)).alias("mean_total")), KEYS)


@query(
    "c6_mean_patchy",
    f"""WITH {fx.PATCHY_SQL}, {REFLECT}, s AS (SELECT DISTINCT stack_id, frame, h, w FROM patchy), c AS (SELECT s.*, y, x FROM s, (SELECT range AS y FROM range(24)), (SELECT range AS x FROM range(24)) WHERE y < h AND x < w),
    n AS (SELECT stack_id, frame, y, x, w, (CASE WHEN y + dy < 0 THEN -y - dy - 1 WHEN y + dy >= h THEN 2*h - 1 - y - dy ELSE y + dy END) AS yy, (CASE WHEN x + dx < 0 THEN -x - dx - 1 WHEN x + dx >= w THEN 2*w - 1 - x - dx ELSE x + dx END) AS xx FROM c, o),
    m AS (SELECT n.stack_id, n.frame, n.y, n.x, n.w, avg(p.v) AS v FROM n JOIN patchy p ON p.stack_id = n.stack_id AND p.frame = n.frame AND p.y = n.yy AND p.x = n.xx GROUP BY ALL)
    SELECT stack_id, frame, count(*)::BIGINT AS n, round(sum(v), 3) + 0.0 AS total, round(sum(v * (y*w + x + 1)), 2) + 0.0 AS weighted FROM m GROUP BY ALL""",
)
def c6_patchy(spark: SparkSession, sf: str) -> DataFrame:
    """Means over what is there, in frames of odd sizes with holes, edges mirrored."""
    out = summed(filters.spatial_filter(fx.patchy(spark, sf), "mean", 3))
    return out.select(*KEYS, "n", (F.round("total", 3) + F.lit(0.0)).alias("total"), (F.round("weighted", 2) + F.lit(0.0)).alias("weighted"))


@query("c7_stretch", f"WITH {fx.BLOBS_SQL}, q AS (SELECT stack_id, frame, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.95) AS hi FROM blobs GROUP BY ALL), s AS (SELECT stack_id, frame, y, x, CASE WHEN hi > lo THEN greatest(0, least(1, (v - lo) / (hi - lo))) ELSE 0 END AS v FROM blobs JOIN q USING (stack_id, frame)) SELECT stack_id, frame, {SUMS} FROM s GROUP BY stack_id, frame")
def c7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summed(filters.stretch(fx.blobs(spark, sf), 0.1, 0.95)))


BINS_SQL = "(CASE WHEN v < 0 THEN -1 WHEN v > 200 THEN 20 WHEN v = 200 THEN 19 ELSE floor(v / 200.0 * 20) END)::INT"


@query("c8_equalise", f"WITH {fx.BLOBS_SQL}, h AS (SELECT stack_id, frame, {BINS_SQL} AS bin, count(*) AS n FROM blobs GROUP BY ALL), c AS (SELECT stack_id, frame, bin, sum(n) OVER (PARTITION BY stack_id, frame ORDER BY bin) / 576.0::DOUBLE AS c FROM h), e AS (SELECT b.stack_id, b.frame, y, x, c AS v FROM blobs b JOIN c ON b.stack_id = c.stack_id AND b.frame = c.frame AND {BINS_SQL} = c.bin) SELECT stack_id, frame, {SUMS} FROM e GROUP BY stack_id, frame")
def c8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summed(filters.equalise(fx.blobs(spark, sf), 0, 200, 20)))


@query("c9_temporal_denoise", f"WITH {fx.LATTICE_SQL}, m AS (SELECT stack_id, frame, y, x, median(v) OVER (PARTITION BY stack_id, y, x ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM lattice) SELECT stack_id, frame, {SUMS} FROM m GROUP BY stack_id, frame")
def c9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summed(filters.temporal_denoise(fx.lattice(spark, sf), 1, "median")))


@query("c9_denoise_tiles", f"WITH {fx.LATTICE_SQL}, k AS (SELECT * FROM lattice WHERE (stack_id + frame) % 5 <> 0), m AS (SELECT a.stack_id, a.frame, a.y, a.x, avg(b.v) AS v FROM k a JOIN k b ON b.stack_id = a.stack_id AND b.y = a.y AND b.x = a.x AND abs(b.frame - a.frame) <= 2 GROUP BY ALL) SELECT stack_id, frame, {SUMS} FROM m GROUP BY stack_id, frame")
def c9_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Means over stacks with missing frames, by tiles of 9 pixels and chunks of 3 frames, which must not change the answer."""
    kept = fx.lattice(spark, sf).where("(stack_id + frame) % 5 <> 0")
    return rounded(summed(filters.temporal_denoise(kept, 2, chunk=3, tile=9)))


C10_GAIN = "sin(3.141592653589793 * 0.5 * 20 * q + 0.5 * 3.141592653589793 * 3 * 0.125 * q * q)"


@query(
    "c10_delocalisation",
    DFT + f""", t AS (SELECT stack_id, frame, re, im, ky, kx, (ky*ky + kx*kx) / 576.0::DOUBLE AS q FROM dft), g AS (SELECT stack_id, frame, re, im, ky, kx, {C10_GAIN} AS c FROM t),
    f AS (SELECT stack_id, frame, CASE WHEN ky = 0 AND kx = 0 THEN 1 ELSE c / (c*c + 0.1) END AS w, re, im FROM g)
    SELECT stack_id, frame, round(sum((re*re + im*im) * w * w) / 576, 2) + 0.0 AS energy, round(sum(re * w) / 576, 4) + 0.0 AS first FROM f GROUP BY ALL""",
)
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return _energy(filters.delocalisation_correct(fx.lattice(spark, sf), 0.5, 3.0, 20.0, 10.0))
