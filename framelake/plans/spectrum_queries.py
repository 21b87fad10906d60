"""Queries of the 4D and EELS operators, each with DuckDB SQL that takes another route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eels, fourd
from ..storage import meet, numbered
from . import fixtures as fx
from .stack_queries import rounded

QUERIES: dict = {}
ORACLES: dict = {}
POS = ["scan_id", "sy", "sx"]
POS_SQL = "scan_id, sy::INT AS sy, sx::INT AS sx"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("f1_detector_image", f"WITH {fx.PATTERNS_SQL} SELECT {POS_SQL}, sum(CASE WHEN (ky-4)*(ky-4) + (kx-4)*(kx-4) BETWEEN 1 AND 4 THEN v ELSE 0 END)::DOUBLE AS value FROM patterns GROUP BY ALL")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return fourd.detector_image(fx.patterns(spark, sf), 1.0, 2.0, (4.0, 4.0))


@query("f2_mean_pattern", f"WITH {fx.PATTERNS_SQL} SELECT scan_id, ky::INT AS ky, kx::INT AS kx, round(avg(v), 4) + 0.0 AS mean, max(v)::DOUBLE AS max FROM patterns GROUP BY ALL")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fourd.mean_pattern(fx.patterns(spark, sf)))


@query(
    "f3_dpc",
    """WITH g AS (SELECT s_suppkey::BIGINT AS scan_id, sy, sx, (sy % 3 - 1)::DOUBLE AS gy, ((sx + s_suppkey) % 3 - 1)::DOUBLE AS gx FROM supplier, (SELECT range AS sy FROM range(8)), (SELECT range AS sx FROM range(8))),
    d AS (SELECT scan_id, sy, sx, gy - avg(gy) OVER w AS dy, gx - avg(gx) OVER w AS dx FROM g WINDOW w AS (PARTITION BY scan_id))
    SELECT scan_id, sy::INT AS sy, sx::INT AS sx, round(dy, 4) + 0.0 AS dy, round(dx, 4) + 0.0 AS dx, round(sqrt(dy*dy + dx*dx), 4) + 0.0 AS magnitude FROM d""",
)
def f3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fourd.dpc(fx.patterns(spark, sf)).drop("angle"))


@query(
    "f4_ssb",
    f"""WITH {fx.PATTERNS_SQL}, p AS (SELECT scan_id, sy, sx, ky-4 AS ky, kx-4 AS kx, v FROM patterns WHERE (ky-4)*(ky-4) + (kx-4)*(kx-4) <= 9), q AS (SELECT range AS i, (CASE WHEN range < 4 THEN range ELSE range - 8 END) * 1.0::DOUBLE AS q FROM range(8)),
    r AS (SELECT scan_id, ky, kx, sy, q.i AS ix, q.q AS qx, sum(v*cos({fx.TWO_PI}*q.i*sx/8)) AS re, -sum(v*sin({fx.TWO_PI}*q.i*sx/8)) AS im FROM p, q GROUP BY ALL),
    g AS (SELECT scan_id, ky, kx, q.i AS iy, ix, q.q AS qy, qx, sum(re*cos({fx.TWO_PI}*q.i*sy/8) + im*sin({fx.TWO_PI}*q.i*sy/8)) AS re, sum(im*cos({fx.TWO_PI}*q.i*sy/8) - re*sin({fx.TWO_PI}*q.i*sy/8)) AS im FROM r, q GROUP BY ALL),
    b AS (SELECT scan_id, iy, ix, sum(re) AS re, sum(im) AS im FROM g WHERE (iy = 0 AND ix = 0) OR ((ky-qy)*(ky-qy) + (kx-qx)*(kx-qx) <= 9 AND (ky+qy)*(ky+qy) + (kx+qx)*(kx+qx) > 9) GROUP BY ALL),
    z AS (SELECT scan_id, sy, sx, sum(re*cos({fx.TWO_PI}*(iy*sy + ix*sx)/8) - im*sin({fx.TWO_PI}*(iy*sy + ix*sx)/8)) / 64 AS re, sum(re*sin({fx.TWO_PI}*(iy*sy + ix*sx)/8) + im*cos({fx.TWO_PI}*(iy*sy + ix*sx)/8)) / 64 AS im FROM b, (SELECT range AS sy FROM range(8)), (SELECT range AS sx FROM range(8)) GROUP BY ALL)
    SELECT {POS_SQL}, round(sqrt(re*re + im*im), 6) + 0.0 AS amplitude, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM z""",
)
def f4(spark: SparkSession, sf: str) -> DataFrame:
    out = fourd.ssb(fx.patterns(spark, sf), 1.0, 3.0, 0.125, 1.0, (4.0, 4.0))
    return rounded(out.select(*POS, "amplitude", (F.col("amplitude") * F.cos("phase")).alias("re"), (F.col("amplitude") * F.sin("phase")).alias("im")), 6)


@query(
    "f5_orientation",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(1, 65)) AS i FROM embeddings), c AS (SELECT vec_id, i, e - avg(e) OVER (PARTITION BY vec_id) AS e FROM v), n AS (SELECT vec_id, sqrt(sum(e*e)) AS n FROM c GROUP BY ALL),
    m AS (SELECT label, i, avg(e) AS e FROM v JOIN embeddings USING (vec_id) GROUP BY ALL), t AS (SELECT label, i, e - avg(e) OVER (PARTITION BY label) AS e FROM m), tn AS (SELECT label, sqrt(sum(e*e)) AS n FROM t GROUP BY ALL),
    s AS (SELECT a.vec_id, b.label::BIGINT AS template_id, sum(a.e*b.e) / (na.n * nb.n) AS score FROM c a JOIN t b ON a.i = b.i JOIN n na ON na.vec_id = a.vec_id JOIN tn nb ON nb.label = b.label GROUP BY a.vec_id, b.label, na.n, nb.n)
    SELECT vec_id, template_id, round(score, 4) + 0.0 AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, template_id))::INT AS rank FROM s) WHERE rank <= 2""",
)
def f5(spark: SparkSession, sf: str) -> DataFrame:
    """Every pattern against the mean pattern of each label."""
    return rounded(fourd.orientation(*_bank(spark, sf), top=2, key="vec_id"))


def _bank(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vec = fx.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("template_id"), F.col("embedding").cast("array<double>").alias("px"))
    means = vec.select("template_id", F.posexplode("px").alias("i", "e")).groupBy("template_id", "i").agg(F.avg("e").alias("e"))
    templates = means.groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda x: x["e"]).alias("px"))
    return vec.drop("template_id"), templates


@query("f5_orientation_blocks", ORACLES["f5_orientation"])
def f5_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same in three blocks of templates, whose best matches are merged."""
    return rounded(fourd.orientation(*_bank(spark, sf), top=2, key="vec_id", values=4 * 64))


@query("f6_disk_strain", "SELECT s_suppkey::BIGINT AS scan_id, sy::INT AS sy, sx::INT AS sx, 0.0::DOUBLE AS g1y, 6.0 + s_suppkey % 2 AS g1x, 6.0::DOUBLE AS g2y, 0.0::DOUBLE AS g2x, round(6.0 / (6.0 + s_suppkey % 2) - 1, 4) + 0.0 AS exx, 0.0::DOUBLE AS eyy, 0.0::DOUBLE AS exy, 0.0::DOUBLE AS rot FROM supplier, (SELECT range AS sy FROM range(4)), (SELECT range AS sx FROM range(4))")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    """Three disks of radius 1; the one along x stands a step further out in odd scans."""
    rows = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.explode(F.expr("sequence(0L, 15L)")).alias("p"))
    rows = fx.spread(rows, "s", "p")
    disk = lambda y, x: f"(CASE WHEN ((i div 19)-{y})*((i div 19)-{y}) + ((i % 19)-{x})*((i % 19)-{x}) <= 1 THEN 100 ELSE 0 END)"
    px = f"transform(sequence(0L, 360L), i -> cast({disk(6, 6)} + {disk(6, '(12 + s % 2)')} + {disk(12, 6)} as double))"
    patterns = rows.select(F.col("s").alias("scan_id"), F.expr("cast(p div 4 as int)").alias("sy"), F.expr("cast(p % 4 as int)").alias("sx"), F.lit(19).alias("kh"), F.lit(19).alias("kw"), F.expr(px).alias("px"))
    return rounded(fourd.disk_strain(patterns, (0.0, 6.0), (6.0, 0.0), 2, (6.0, 6.0), ((0.0, 6.0), (6.0, 0.0))))


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    return eels.pair_dual(fx.spectra(spark, sf))[0]


@query("g1_pair_dual", f"WITH {fx.SPECTRA_SQL} SELECT scan_id, sy::INT AS sy, sx::INT AS sx, round(sum(c.v), 3) + 0.0 AS core, round(sum(l.v), 3) + 0.0 AS low FROM core c JOIN low l USING (scan_id, sy, sx, e) GROUP BY ALL")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(_paired(spark, sf).select(*POS, total("counts").alias("core"), total("low_counts").alias("low")), 3)


@query("g2_align_energy", "SELECT s_suppkey::BIGINT AS scan_id, sy::INT AS sy, sx::INT AS sx, -(10.0 + s_suppkey % 3)::DOUBLE AS shift, (390.0 - s_suppkey % 3)::DOUBLE AS e0 FROM supplier, (SELECT range AS sy FROM range(4)), (SELECT range AS sx FROM range(4))")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eels.align_energy(_paired(spark, sf)).select(*POS, "shift", "e0"))


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return eels.remove_background(fx.spectra(spark, sf).where("kind = 'core'"), 400.0, 450.0)


EDGES = f"WITH {fx.SPECTRA_SQL}, edge AS (SELECT scan_id, sy, sx, e, v - 1000000000.0*pow(400.0+e, -3) AS v, 1 + (scan_id+sx)%3 AS c1, 1 + sy%3 AS c2 FROM core)"


@query("g3_remove_background", EDGES + " SELECT scan_id, sy::INT AS sy, sx::INT AS sx, 3.0::DOUBLE AS exponent, 1.0::DOUBLE AS amplitude_1e9, round(sum(v), 3) + 0.0 AS total FROM edge GROUP BY ALL")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("counts", F.lit(0.0), lambda a, v: a + v)
    return rounded(_cleaned(spark, sf).select(*POS, "exponent", (F.col("amplitude") / 1e9).alias("amplitude_1e9"), total.alias("total")), 3)


def _echoed(spark: SparkSession, sf: str) -> DataFrame:
    low = "transform(sequence(0L, 127L), e -> CASE WHEN e = 0 THEN 0.7D WHEN e = 9 THEN 0.2D WHEN e = 18 THEN 0.1D ELSE 0D END)"
    at = "(40 + s % 5)"
    core = f"transform(sequence(0L, 127L), e -> CASE WHEN e = {at} THEN 70D WHEN e = {at} + 9 THEN 20D WHEN e = {at} + 18 THEN 10D ELSE 0D END)"
    rows = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.explode(F.expr("sequence(0L, 15L)")).alias("p"))
    return fx.spread(rows, "s", "p").selectExpr("s as scan_id", "cast(p div 4 as int) sy", "cast(p % 4 as int) sx", f"{core} as counts", f"{low} as low_counts")


@query("g4_remove_plural", "SELECT s_suppkey::BIGINT AS scan_id, sy::INT AS sy, sx::INT AS sx, 100.0::DOUBLE AS total, 100.0 * (40 + s_suppkey % 5)::DOUBLE AS first_moment, 10000.0::DOUBLE AS squares, 100.0::DOUBLE AS at_line FROM supplier, (SELECT range AS sy FROM range(4)), (SELECT range AS sx FROM range(4))")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    """A line blurred by a low loss with a plasmon echo comes back as the line and nothing else: its total, first moment, sum of squares and value at its place."""
    rows = _echoed(spark, sf)
    out = eels.remove_plural(rows, 0.0)
    total = lambda f: F.aggregate(F.transform("counts", f), F.lit(0.0), lambda a, v: a + v)
    return rounded(out.withColumn("s", F.col("scan_id")).select(*POS, total(lambda v, i: v).alias("total"), total(lambda v, i: v * i).alias("first_moment"), total(lambda v, i: v * v).alias("squares"), F.element_at("counts", F.expr("cast(41 + s % 5 as int)")).alias("at_line")), 3)


def _fit(spark: SparkSession, sf: str) -> DataFrame:
    return eels.mlls(_cleaned(spark, sf), fx.references(spark), 450.0, 528.0)


@query(
    "g5_mlls",
    EDGES + f""", m AS (SELECT scan_id, sy, sx, sum(r1*r1) AS a, sum(r1*r2) AS b, sum(r2*r2) AS d, sum(r1*v) AS p, sum(r2*v) AS q FROM (SELECT *, {fx.R1.format(e='e')} AS r1, {fx.R2.format(e='e')} AS r2 FROM edge WHERE e >= 50) GROUP BY ALL)
    SELECT scan_id, sy::INT AS sy, sx::INT AS sx, round((d*p - b*q) / (a*d - b*b), 3) + 0.0 AS c1, round((a*q - b*p) / (a*d - b*b), 3) + 0.0 AS c2, 1.0::DOUBLE AS r2 FROM m""",
)
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit(spark, sf).select(*POS, F.col("coefficients")[1].alias("c1"), F.col("coefficients")[2].alias("c2"), "r2"), 3)


@query("g6_edge_ratio", f"WITH {fx.SPECTRA_SQL}, i AS (SELECT scan_id, sy, sx, sum(CASE WHEN e >= 55 AND e < 63 THEN v ELSE 0 END) AS i1, sum(CASE WHEN e >= 63 AND e < 70 THEN v ELSE 0 END) AS i2 FROM core GROUP BY ALL) SELECT scan_id, sy::INT AS sy, sx::INT AS sx, round(i1, 3) + 0.0 AS i1, round(i2, 3) + 0.0 AS i2, round(i1 / i2, 3) + 0.0 AS ratio FROM i")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eels.edge_ratio(fx.spectra(spark, sf).where("kind = 'core'"), (455.0, 463.0), (463.0, 470.0)), 3)


@query("g7_valence", EDGES + " SELECT scan_id, sy::INT AS sy, sx::INT AS sx, round(c1 / (c1 + c2)::DOUBLE, 3) + 0.0 AS fraction_1, round(c2 / (c1 + c2)::DOUBLE, 3) + 0.0 AS fraction_2, round((2*c1 + 3*c2) / (c1 + c2)::DOUBLE, 3) + 0.0 AS valence FROM edge WHERE e = 0")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eels.valence(_fit(spark, sf), {1: 2.0, 2: 3.0})[0], 3)


@query(
    "g8_bootstrap",
    """WITH r AS (SELECT user_id % 8 AS g, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS i, value::DOUBLE AS v FROM events), n AS (SELECT g, count(*) AS n FROM r GROUP BY ALL),
    d AS (SELECT g, rep, ('0x' || substr(md5('42:' || rep || ':' || g || ':' || i), 1, 8))::BIGINT % n AS j FROM n, (SELECT range AS rep FROM range(20)), (SELECT unnest(range((SELECT max(n) FROM n))) AS i) WHERE i < n),
    m AS (SELECT d.g, rep, avg(v) AS m FROM d JOIN r ON r.g = d.g AND r.i = d.j GROUP BY ALL)
    SELECT g::BIGINT AS g, round(avg(m), 4) + 0.0 AS mean, round(quantile_cont(m, 0.025), 4) + 0.0 AS low, round(quantile_cont(m, 0.975), 4) + 0.0 AS high FROM m GROUP BY ALL""",
)
def g8(spark: SparkSession, sf: str) -> DataFrame:
    """Events are numbered within their group by event_id, over range partitions of all events."""
    events = fx.table(spark, sf, "events").selectExpr("cast(user_id % 8 as long) g", "event_id", "cast(value as double) v")
    rows = numbered(events, ["g"], ["event_id"], "i", 2 * spark.sparkContext.defaultParallelism)
    return rounded(eels.bootstrap(rows, "g", "i", "v", 20, 42))


@query(
    "g8_bootstrap_refit",
    EDGES + f""", m AS (SELECT scan_id, sy*4 + sx AS i, sum(r1*r1) AS a, sum(r1*r2) AS b, sum(r2*r2) AS d, sum(r1*v) AS p, sum(r2*v) AS q FROM (SELECT *, {fx.R1.format(e='e')} AS r1, {fx.R2.format(e='e')} AS r2 FROM edge WHERE e >= 50) GROUP BY ALL),
    w AS (SELECT scan_id, rep, ('0x' || substr(md5('42:' || rep || ':' || scan_id || ':' || i), 1, 8))::BIGINT % 16 AS i FROM (SELECT s_suppkey::BIGINT AS scan_id FROM supplier), (SELECT range AS rep FROM range(40)), (SELECT range AS i FROM range(16))),
    s AS (SELECT scan_id, rep, sum(a) AS a, sum(b) AS b, sum(d) AS d, sum(p) AS p, sum(q) AS q FROM w JOIN m USING (scan_id, i) GROUP BY ALL),
    x AS (SELECT scan_id, (d*p - b*q) / (a*d - b*b) AS c1, (a*q - b*p) / (a*d - b*b) AS c2 FROM s), v AS (SELECT *, (2*c1 + 3*c2) / (c1 + c2) AS valence FROM x)
    SELECT scan_id, round(avg(c1) + 0.0001, 3) + 0.0 AS c1, round(quantile_cont(c1, 0.025) + 0.0001, 3) + 0.0 AS c1_low, round(quantile_cont(c1, 0.975) + 0.0001, 3) + 0.0 AS c1_high, round(avg(c2) + 0.0001, 3) + 0.0 AS c2, round(quantile_cont(c2, 0.025) + 0.0001, 3) + 0.0 AS c2_low, round(quantile_cont(c2, 0.975) + 0.0001, 3) + 0.0 AS c2_high,
    round(avg(valence) + 0.0001, 3) + 0.0 AS valence, round(quantile_cont(valence, 0.025) + 0.0001, 3) + 0.0 AS valence_low, round(quantile_cont(valence, 0.975) + 0.0001, 3) + 0.0 AS valence_high FROM v GROUP BY scan_id""",
)
def g8_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Both coefficients and the valence of each scan, refitted to 40 resamples of its positions; a ten-thousandth is added before rounding, as means of whole coefficients lie on ties."""
    reps = eels.bootstrap_mlls(_cleaned(spark, sf), fx.references(spark), 450.0, 528.0, 40, 42)
    values = meet(reps.select("scan_id", "rep", F.col("coefficients")[1].alias("c1"), F.col("coefficients")[2].alias("c2")), eels.valence(reps, {1: 2.0, 2: 3.0})[0].select("scan_id", "rep", "valence"), ["scan_id", "rep"])
    found = eels.percentiles(values, "scan_id", ["c1", "c2", "valence"])
    return rounded(found.select("scan_id", *((F.col(c) + 0.0001).alias(c) for c in found.columns[1:])), 3)


@query("g4_limited_plural", "SELECT s_suppkey::BIGINT AS scan_id, sy::INT AS sy, sx::INT AS sx, 100.0::DOUBLE AS total, round(100 / sqrt(2 * 3.141592653589793 * 4), 3) + 0.0 AS at_line, round(100 / sqrt(2 * 3.141592653589793 * 4) * exp(-4 / 8.0), 3) + 0.0 AS beside FROM supplier, (SELECT range AS sy FROM range(4)), (SELECT range AS sx FROM range(4))")
def g4_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The line of g4 limited by a Gaussian of two channels: its closed form at the line and two channels beside it."""
    at = F.expr("cast(41 + scan_id % 5 as int)")
    out = eels.remove_plural(_echoed(spark, sf), 2.0)
    return rounded(out.select(*POS, F.aggregate("counts", F.lit(0.0), lambda a, v: a + v).alias("total"), F.element_at("counts", at).alias("at_line"), F.element_at("counts", at + 2).alias("beside")), 3)
