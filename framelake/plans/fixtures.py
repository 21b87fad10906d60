"""Input tables derived from the given ones by formula, for Spark (packed) and for DuckDB (long form).

Values are integers, so both engines make the same ones; sizes follow `supplier`, one stack each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N, FRAMES = 24, 6
TWO_PI = 6.283185307179586


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noise(s: str, f: str, y: str, x: str) -> str:
    return f"(({s}*7919 + {f}*104729 + {y}*1299709 + {x}*15485863) % 5)"


def lattice_value(s: str, f: str, y: str, x: str) -> str:
    """A square lattice of period 6 that drifts by a known whole step each frame."""
    u = f"(({y} - (({s}+2*{f}) % 3 - 1) + 60) % 6 - 3)"
    w = f"(({x} - ((2*{s}+{f}) % 3 - 1) + 60) % 6 - 3)"
    return f"(greatest(0, 100 - 12*({u}*{u} + {w}*{w})) + {noise(s, f, y, x)})"


def blob_value(s: str, f: str, y: str, x: str) -> str:
    """Two disks: one grows, one shrinks."""
    first = f"CASE WHEN ({y}-8)*({y}-8) + ({x}-8)*({x}-8) < (1+{f})*(1+{f}) THEN 150 ELSE 0 END"
    second = f"CASE WHEN ({y}-17)*({y}-17) + ({x}-17)*({x}-17) < (5-{f})*(5-{f}) THEN 150 ELSE 0 END"
    return f"(20 + {noise(s, f, y, x)} + {first} + {second})"


def wave_value(s: str, f: str, y: str, x: str) -> str:
    """Two waves near four steps a frame along x and along y: the first is off by -1, 0 or 1 step, the second leans back by 0 or 2. Their mean is 0, so nothing leaks from it."""
    first, second = f"(3 + ({s}+{f}) % 3) * {x}", f"4 * {y} - 2 * (({s}+{f}) % 2) * {x}"
    return f"(50*cos({TWO_PI} / {N} * ({first})) + 50*cos({TWO_PI} / {N} * ({second})))"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deals slim rows over all cores before large values are made of them; a number keeps them from being merged again."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _frames(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.explode(F.expr(f"sequence(0L, {FRAMES - 1}L)")).alias("f"))
    rows = spread(rows, "s", "f")
    px = f"transform(sequence(0L, {N * N - 1}L), i -> cast({value('s', 'f', f'(i div {N})', f'(i % {N})')} as double))"
    return rows.select(F.col("s").alias("stack_id"), F.col("f").alias("frame"), F.expr("timestamp_seconds(1704067200 + f)").alias("ts"), F.lit(N).alias("height"), F.lit(N).alias("width"), F.lit("uint8").alias("dtype"), F.expr(px).alias("px"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir, lattice_value)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir, blob_value)


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir, wave_value)


def _pixels_sql(name: str, value) -> str:
    return f"{name} AS (SELECT s AS stack_id, f AS frame, y, x, {value('s', 'f', 'y', 'x')} AS v FROM (SELECT s_suppkey::BIGINT AS s FROM supplier), (SELECT range AS f FROM range({FRAMES})), (SELECT range AS y FROM range({N})), (SELECT range AS x FROM range({N})))"


#: Frames of odd sizes, with pixels that are no number and frame numbers that are missing.
PATCHY_SIZE = "(15 + {s} % 4)", "(20 + {s} % 3)"
PATCHY_HOLE, PATCHY_GONE = "({y}*7 + {x}*3 + {s} + {f}) % 11 = 0", "({s} + {f}) % 5 = 0"


def patchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.explode(F.expr(f"sequence(0L, {FRAMES - 1}L)")).alias("f")).where("not " + PATCHY_GONE.format(s="s", f="f"))
    rows = spread(rows, "s", "f").selectExpr("s", "f", *(f"cast({n.format(s='s')} as int) {c}" for n, c in zip(PATCHY_SIZE, "hw", strict=True)))
    y, x = "(i div w)", "(i % w)"
    px = f"transform(sequence(0L, cast(h*w - 1 as long)), i -> CASE WHEN {PATCHY_HOLE.format(s='s', f='f', y=y, x=x)} THEN double('NaN') ELSE cast({lattice_value('s', 'f', y, x)} as double) END)"
    return rows.select(F.col("s").alias("stack_id"), F.col("f").alias("frame"), F.expr("timestamp_seconds(1704067200 + f)").alias("ts"), F.col("h").alias("height"), F.col("w").alias("width"), F.lit("uint8").alias("dtype"), F.expr(px).alias("px"))


PATCHY_SQL = f"patchy AS (SELECT s AS stack_id, f AS frame, h, w, y, x, {lattice_value('s', 'f', 'y', 'x')} AS v FROM (SELECT s_suppkey::BIGINT AS s, {PATCHY_SIZE[0].format(s='s_suppkey')} AS h, {PATCHY_SIZE[1].format(s='s_suppkey')} AS w FROM supplier), (SELECT range AS f FROM range({FRAMES})), (SELECT range AS y FROM range({N})), (SELECT range AS x FROM range({N})) WHERE y < h AND x < w AND NOT {PATCHY_GONE.format(s='s', f='f')} AND NOT {PATCHY_HOLE.format(s='s', f='f', y='y', x='x')})"

LATTICE_SQL = _pixels_sql("lattice", lattice_value)
BLOBS_SQL = _pixels_sql("blobs", blob_value)
#: Planted shift from the previous frame, and the drift from the first.
OFFSET_SQL = "offsets AS (SELECT s_suppkey::BIGINT AS stack_id, f AS frame, (s_suppkey+2*f) % 3 - 1 AS oy, (2*s_suppkey+f) % 3 - 1 AS ox FROM supplier, (SELECT range AS f FROM range(6)))"


def dft_sql(source: str, name: str = "dft", n: int = N) -> str:
    """Centred spectrum of each frame by direct sums: rows first, then columns; ky, kx in -n/2 .. n/2 - 1."""
    k = f"(SELECT range - {n // 2} AS k FROM range({n}))"
    return (
        f"{name}_rows AS (SELECT stack_id, frame, y, k AS kx, sum(v*cos({TWO_PI}*k*x/{n})) AS re, -sum(v*sin({TWO_PI}*k*x/{n})) AS im FROM {source}, {k} GROUP BY ALL), "
        f"{name} AS (SELECT stack_id, frame, k AS ky, kx, sum(re*cos({TWO_PI}*k*y/{n}) + im*sin({TWO_PI}*k*y/{n})) AS re, sum(im*cos({TWO_PI}*k*y/{n}) - re*sin({TWO_PI}*k*y/{n})) AS im FROM {name}_rows, {k} GROUP BY ALL), "
        f"{name}_p AS (SELECT *, re*re + im*im AS p, floor(sqrt((ky*ky + kx*kx)::DOUBLE) + 0.5)::BIGINT AS r FROM {name})"
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice of step 10 whose right half is strained along x."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.explode(F.expr("sequence(0L, 63L)")).alias("id"))
    rows = spread(rows, "s", "id")
    i, j = "(id div 8)", "(id % 8)"
    return rows.select(F.col("s").alias("stack_id"), F.lit(0).cast("long").alias("frame"), F.col("id").alias("point_id"), F.expr(f"10.0D*{i}").alias("y"), F.expr(f"10.0D*{j} + 0.1D*(1 + s%3)*greatest(0, {j}-4)").alias("x"), F.expr(f"cast(100 + 40*(({i}+{j}) % 2) as double)").alias("intensity"))


POINTS_SQL = "points AS (SELECT s_suppkey::BIGINT AS stack_id, 0::BIGINT AS frame, id AS point_id, 10.0::DOUBLE*(id//8) AS y, 10.0::DOUBLE*(id%8) + 0.1::DOUBLE*(1 + s_suppkey%3)*greatest(0, id%8-4) AS x, (100 + 40*((id//8 + id%8) % 2))::DOUBLE AS intensity FROM supplier, (SELECT range AS id FROM range(64)))"


def _pattern_value(s: str, sy: str, sx: str, ky: str, kx: str) -> str:
    gy, gx = f"({sy}%3 - 1)", f"(({sx}+{s})%3 - 1)"
    return f"(CASE WHEN ({ky}-4-{gy})*({ky}-4-{gy}) + ({kx}-4-{gx})*({kx}-4-{gx}) <= 4 THEN 100 ELSE 0 END)"


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 scans of 9 x 9 patterns with a disk moved by a known step."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.explode(F.expr("sequence(0L, 63L)")).alias("p"))
    rows = rows.select("s", F.expr("p div 8").alias("sy"), F.expr("p % 8").alias("sx"))
    rows = spread(rows, "s", "sy")
    px = f"transform(sequence(0L, 80L), i -> cast({_pattern_value('s', 'sy', 'sx', '(i div 9)', '(i % 9)')} as double))"
    return rows.select(F.col("s").alias("scan_id"), F.col("sy").cast("int").alias("sy"), F.col("sx").cast("int").alias("sx"), F.lit(9).alias("kh"), F.lit(9).alias("kw"), F.expr(px).alias("px"))


PATTERNS_SQL = f"patterns AS (SELECT s AS scan_id, sy, sx, ky, kx, {_pattern_value('s', 'sy', 'sx', 'ky', 'kx')} AS v FROM (SELECT s_suppkey::BIGINT AS s FROM supplier), (SELECT range AS sy FROM range(8)), (SELECT range AS sx FROM range(8)), (SELECT range AS ky FROM range(9)), (SELECT range AS kx FROM range(9)))"

R1, R2 = "(1000.0/(1 + ({e}-60)*({e}-60)/9.0))", "(1000.0/(1 + ({e}-66)*({e}-66)/9.0))"


def _double(text: str) -> str:
    """Spark reads 1.0 as a decimal; its doubles end in D."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", text)


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 scans of core-loss spectra (two known references over a power law from e = 50) and their low-loss partners."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.explode(F.expr("sequence(0L, 15L)")).alias("p")).selectExpr("s", "p div 4 as sy", "p % 4 as sx")
    rows = spread(rows, "s", "sy")
    core = f"(1 + (s+sx)%3)*{R1} + (1 + sy%3)*{R2}"
    whole = _double(f"({core})*(CASE WHEN e >= 50 THEN 1 ELSE 0 END) + 1000000000.0*pow(400.0+e, -3)".replace("{e}", "e"))
    low = _double("1000.0/(1 + (e - 10 - s%3)*(e - 10 - s%3))")
    kinds = [rows.select(F.col("s").alias("scan_id"), F.col("sy").cast("int").alias("sy"), F.col("sx").cast("int").alias("sx"), F.lit(k).alias("kind"), F.lit(e0).alias("e0"), F.lit(1.0).alias("de"), F.expr(f"transform(sequence(0L, 127L), e -> cast({v} as double))").alias("counts")) for k, e0, v in (("core", 400.0, whole), ("low", 0.0, low))]
    return kinds[0].union(kinds[1])


SPECTRA_SQL = (
    f"core AS (SELECT s AS scan_id, sy, sx, e, ((1 + (s+sx)%3)*{R1} + (1 + sy%3)*{R2})*(CASE WHEN e >= 50 THEN 1 ELSE 0 END) + 1000000000.0*pow(400.0+e, -3) AS v FROM (SELECT s_suppkey::BIGINT AS s FROM supplier), (SELECT range AS sy FROM range(4)), (SELECT range AS sx FROM range(4)), (SELECT range AS e FROM range(128))), ".replace("{e}", "e")
    + "low AS (SELECT s AS scan_id, sy, sx, e, 1000.0/(1 + (e - 10 - s%3)*(e - 10 - s%3)) AS v FROM (SELECT s_suppkey::BIGINT AS s FROM supplier), (SELECT range AS sy FROM range(4)), (SELECT range AS sx FROM range(4)), (SELECT range AS e FROM range(128)))"
)


def references(spark: SparkSession) -> DataFrame:
    """The two pure edges (fixed, two rows)."""
    rows = [(k, F.expr(_double(f"transform(sequence(0L, 127L), e -> (CASE WHEN e >= 50 THEN 1 ELSE 0 END)*{r})".replace("{e}", "e")))) for k, r in ((1, R1), (2, R2))]
    one = [spark.range(1).select(F.lit(k).alias("ref_id"), F.lit(f"edge{k}").alias("name"), F.lit(400.0).alias("e0"), F.lit(1.0).alias("de"), v.cast("array<double>").alias("counts")) for k, v in rows]
    return one[0].union(one[1])


ROI_ROWS = [(1, 0, 0.0, 0.0), (1, 1, 0.0, 10.0), (1, 2, 10.0, 10.0), (1, 3, 10.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 0.0, 8.0), (2, 2, 6.0, 0.0), (3, 0, 0.0, 0.0), (3, 1, 0.0, 4.0), (3, 2, 2.0, 4.0), (3, 3, 2.0, 2.0), (3, 4, 4.0, 2.0), (3, 5, 4.0, 0.0)]


def rois(spark: SparkSession) -> DataFrame:
    """A square, a triangle and an L (fixed rows, as drawn by hand)."""
    return spark.createDataFrame(ROI_ROWS, "roi_id long, vertex int, y double, x double")


ROIS_SQL = "rois AS (SELECT * FROM (VALUES " + ", ".join(f"({a}::BIGINT, {b}, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in ROI_ROWS) + ") t(roi_id, vertex, y, x))"
