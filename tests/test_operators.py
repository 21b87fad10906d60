import hashlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake import schema, storage
from framelake.functions import kernels
from framelake.operators import atoms, drift, eels, filters, fourd, frames, regions, strain
from framelake.plans import fixtures as fx
from framelake.plans import registry
from framelake.sources import large, stacks
from framelake.streaming import frames as streaming

SF = "/root/testdata/sf0.001"


def stack(spark, images, stack_id=1, first=0):
    """Frames of a list of arrays; None leaves a number out."""
    rows = [(stack_id, k, datetime(2024, 1, 1) + timedelta(seconds=k), *a.shape, "uint8", [float(v) for v in a.ravel()]) for k, a in enumerate(images, first) if a is not None]
    return spark.createDataFrame(rows, schema.FRAMES)


def image(row):
    return np.array(row.px).reshape(row.height, row.width)


def rng(seed=0):
    return np.random.default_rng(seed)


# ---------------------------------------------------------------- frames


def test_files_are_read_and_a_broken_one_is_reported(spark, tmp_path):
    a = rng().integers(0, 255, (3, 5, 7)).astype(np.uint16)
    (tmp_path / "good.npy").write_bytes(stacks.npy_bytes(a))
    (tmp_path / "bad.npy").write_bytes(b"\x93NUMPY broken")
    (tmp_path / "empty.npy").write_bytes(stacks.npy_bytes(np.zeros((0, 2, 2))))
    found, errors = stacks.read_stacks(spark, str(tmp_path))
    rows = sorted(found.collect(), key=lambda r: r.frame)
    assert len(rows) == 3 and all((image(r) == a[k]).all() and r.dtype == "uint16" for k, r in enumerate(rows))
    assert [e.path.rsplit("/", 1)[1] for e in errors.collect()] == ["bad.npy"]
    out = str(tmp_path / "out")
    stacks.write_frames(found, out)
    assert spark.read.parquet(out).count() == 3
    for clash in (out, out + "/deeper", str(tmp_path)):
        with pytest.raises(ValueError):
            stacks.write_frames(found, clash, [out])


def test_large_files_are_read_by_ranges(spark, tmp_path):
    a, b = rng(11).normal(size=(7, 3, 4)), rng(12).integers(0, 9, (2, 5)).astype(np.uint8)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    large.register(spark)
    df = spark.read.format("npy_frames").option("path", str(tmp_path)).option("frames", 3).load()
    of = {r.path.rsplit("/", 1)[1]: r.stack_id for r in stacks.stack_files(spark, str(tmp_path)).select("path", "stack_id").collect()}
    places = {of["a.npy"]: 0, of["b.npy"]: 1}  # both readers name a file alike
    got = {(places[r.stack_id], r.frame): (image(r), r.dtype) for r in df.collect()}
    assert len(got) == 8 and df.rdd.getNumPartitions() == 4
    assert all((got[0, k][0] == a[k]).all() for k in range(7)) and (got[1, 0][0] == b).all() and got[1, 0][1] == "uint8"


def test_selection(spark):
    f = stack(spark, [np.zeros((1, 1))] * 10)
    assert sorted(r.frame for r in frames.select_frames(f, every_n=3).collect()) == [0, 3, 6, 9]
    assert sorted(r.frame for r in frames.select_frames(f, every_s=4, start=datetime(2024, 1, 1, 0, 0, 1), end=datetime(2024, 1, 1, 0, 0, 9)).collect()) == [1, 4, 8]
    assert frames.select_frames(f.limit(0), every_n=2).count() == 0


@pytest.mark.parametrize(("size", "halo"), [(3, 0), (4, 2), (50, 1), (1, 3)])
def test_tiles_round_trip(spark, size, halo):
    f = stack(spark, [rng(1).normal(size=(7, 5)), rng(2).normal(size=(7, 5))])
    got = {r.frame: image(r) for r in frames.from_tiles(frames.to_tiles(f, size, halo), size).collect()}
    assert all((got[r.frame] == image(r)).all() for r in f.collect())


def test_pixels_round_trip_and_missing_ones(spark):
    f = stack(spark, [rng(3).normal(size=(4, 6))])
    px = frames.to_pixels(f)
    assert (image(frames.from_pixels(px).first()) == image(f.first())).all()
    assert np.isnan(image(frames.from_pixels(px.where("not (y = 1 and x = 2)")).first())[1, 2])


def test_depth_and_calibration(spark):
    f = stack(spark, [np.array([[0, 1, 255, np.nan]])])
    up = frames.convert_depth(f, "uint16").first()
    assert up.px[:3] == [0, 257, 65535] and np.isnan(up.px[3]) and (up.dtype, up.old_dtype) == ("uint16", "uint8")
    calib = spark.createDataFrame([(2, 0.1, 0.5)], schema.CALIB)
    with pytest.raises(ValueError, match="1"):
        frames.calibrate(f.withColumn("y", F.lit(1.0)), calib, ["y"])


def test_runs_compare_with_nan_and_null(spark):
    a = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 1.0), (5, 1.0), (None, 2.0)], "k long, v double")
    b = spark.createDataFrame([(1, 1.05), (2, float("nan")), (3, None), (4, 2.0), (6, 1.0), (None, 2.0)], "k long, v double")
    got = {r.k: r.status for r in frames.compare_runs(a, b, ["k"], {"v": 0.1}).collect()}
    assert got == {1: "within", 2: "same", 3: "same", 4: "beyond", 5: "only_before", 6: "only_after", None: "same"}


def test_wrong_payloads_name_their_row(spark):
    f = stack(spark, [np.zeros((2, 2))]).withColumn("px", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="stack_id 1"):
        filters.wiener(f).collect()
    with pytest.raises(TypeError):
        frames.to_tiles(f.withColumn("px", F.lit("x")), 2)


# ---------------------------------------------------------------- drift


def test_drift_is_found_and_removed(spark):
    scene = rng(4).normal(size=(60, 60)) * 10
    where = [(0, 0), (1, -2), (3, -1), (2, 1)]
    f = stack(spark, [scene[20 - dy : 50 - dy, 20 - dx : 50 - dx] for dy, dx in where])
    shifts = drift.pair_shifts(f, 4)
    total = {r.frame: (r.drift_y, r.drift_x) for r in drift.accumulate(shifts).collect()}
    assert total == {k: where[k] for k in (1, 2, 3)}
    fixed = [image(r) for r in drift.apply_shift(f, drift.accumulate(shifts)).orderBy("frame").collect()]
    assert len({a.shape for a in fixed}) == 1 and all(np.allclose(a, fixed[0]) for a in fixed)
    first = {r.frame: (r.dy, r.dx) for r in drift.pair_shifts(f, 4, against="first").collect()}
    assert first == total


def test_drift_edge_cases(spark):
    flat = stack(spark, [np.ones((6, 6)), np.ones((6, 6)), None, np.ones((6, 6))])
    got = drift.pair_shifts(flat, 1).collect()
    assert [r.frame for r in got] == [1] and got[0].ncc is None
    assert [r.repaired for r in drift.repair_shifts(drift.pair_shifts(flat, 1), 0.5, 1).collect()] == ["zero"]
    assert drift.pair_shifts(flat.limit(1), 1).count() == 0
    a = np.add.outer(np.arange(5.0), np.arange(5.0) * 10)
    assert np.allclose(kernels.shifted(a, 0.5, 0.25)[:4, :4], a[:4, :4] + 0.5 + 2.5)


# ---------------------------------------------------------------- filters


@pytest.mark.parametrize("kind", ["mean", "median", "gauss", "sharpen"])
def test_filters_do_not_depend_on_tiles(spark, kind):
    f = stack(spark, [rng(5).normal(size=(13, 11))])
    whole = image(filters.spatial_filter(f, kind, 3).first())
    tiled = frames.from_tiles(filters.spatial_filter(f, kind, 3, tile=5), 5).first()
    assert np.allclose(image(tiled), whole)


def test_spectral_filters_keep_lattices(spark):
    y, x = np.mgrid[0:32, 0:32]
    clean = np.cos(2 * np.pi * x / 8) + np.cos(2 * np.pi * y / 8)
    f = stack(spark, [clean + rng(6).normal(size=clean.shape)])
    for out in (filters.wiener(f), filters.absf(f), filters.band_filter(f, 3.5, 4.5)):
        assert np.corrcoef(image(out.first()).ravel(), clean.ravel())[0, 1] > 0.8
    soft = filters.band_filter(f, 3, 5, soft=1.0).first()
    assert len(soft.px) == 32 * 32


def test_temporal_denoise_over_a_gap(spark):
    f = stack(spark, [np.full((2, 2), v) if v is not None else None for v in (1.0, 3.0, None, 8.0)])
    got = {r.frame: r.px[0] for r in filters.temporal_denoise(f, 1).collect()}
    assert got == {0: 2.0, 1: 2.0, 3: 8.0}


@pytest.mark.parametrize(("chunk", "tile"), [(1, None), (4, 3), (16, None), (5, 50)])
@pytest.mark.parametrize("stat", ["mean", "median"])
def test_temporal_denoise_by_chunks_and_tiles(spark, stat, chunk, tile):
    """Gaps, NaN, ties, infinite values, other sizes, negative numbers."""
    r = rng(41)
    images = [r.integers(0, 4, (7, 5)).astype(float) for _ in range(11)]
    for a in images:
        a[r.random((7, 5)) < 0.3] = np.nan
    images[2][0, 0] = images[3][0, 0] = images[4][0, 0] = np.inf
    images[5], images[8], images[9] = None, None, r.random((3, 4))
    df = stack(spark, images, first=-3).union(stack(spark, [r.random((2, 2))], 2)).repartition(3)
    got = {(x.stack_id, x.frame): np.array(x.px, float).reshape(x.height, x.width) for x in filters.temporal_denoise(df, 2, stat, chunk, tile).collect()}  # nulls: no number
    assert len(got) == 10
    for k, a in enumerate(images):
        if a is not None:
            near = np.stack([b for b in images[max(0, k - 2) : k + 3] if b is not None and b.shape == a.shape])
            with np.errstate(all="ignore"):
                want = np.nanmean(near, 0) if stat == "mean" else np.nanmedian(near, 0)
            assert np.allclose(got[1, k - 3], want, equal_nan=True)


def test_delocalisation_is_undone(spark):
    a = rng(7).normal(size=(24, 24)) + 5
    c = filters.ctf(24, 24, 0.5, 3.0, 20.0)
    blurred = np.fft.ifft2(np.fft.fft2(a - a.mean()) * c).real + a.mean()
    out = image(filters.delocalisation_correct(stack(spark, [blurred]), 0.5, 3.0, 20.0, 1e6).first())
    strong = np.abs(c) > 0.2
    assert np.allclose(np.fft.fft2(out)[strong], np.fft.fft2(a)[strong], atol=1e-2)


def test_stretch_of_a_constant_frame(spark):
    assert set(filters.stretch(stack(spark, [np.full((3, 3), 7.0)]), 0.1, 0.9).first().px) == {0.0}


# ---------------------------------------------------------------- atoms and strain


def test_peaks_by_definition_and_tiles(spark):
    a = rng(8).integers(0, 6, (17, 19)).astype(float)
    f = stack(spark, [a])
    want = set()
    for y in range(17):
        for x in range(19):
            others = [(a[j, i], (j, i)) for j in range(max(0, y - 2), min(17, y + 3)) for i in range(max(0, x - 2), min(19, x + 3)) if (j, i) != (y, x)]
            if a[y, x] > 3 and all(v < a[y, x] or (v == a[y, x] and at > (y, x)) for v, at in others):
                want.add((y, x))
    for tile in (None, 4, 7):
        assert {(r.y, r.x) for r in atoms.detect_peaks(f, 2, 3.0, tile=tile).collect()} == want


@pytest.mark.parametrize("tile", [None, 5, 64])
def test_windows_of_points_with_and_without_tiles(spark, tile):
    """Each point by itself: near and beyond edges, over tile borders, between pixels, with NaN."""
    r = rng(31)
    images = [r.random((17, 23)), r.random((17, 23)), r.random((6, 4))]
    images[1][4:9, 6:14] = np.nan
    frames_ = stack(spark, images[:2]).union(stack(spark, images[2:], 2))
    of = {(1, 0): images[0], (1, 1): images[1], (2, 0): images[2]}
    pts = [(s, f, k, float(y), float(x), float(k)) for (s, f), a in of.items() for k, (y, x) in enumerate([*r.uniform(-3, 26, (60, 2)), (0.5, 4.5), (4.5, 5.0), (-9.0, 3.0), (6.0, 9.0)])]
    points = spark.createDataFrame([*pts, (9, 9, 1, 1.0, 1.0, 1.0)], schema.POINTS).repartition(3)
    refined = {(x.stack_id, x.frame, x.point_id): (x.y, x.x, x.intensity) for x in atoms.refine_centroids(points, frames_, 2, tile).collect()}
    summed = {(x.stack_id, x.frame, x.point_id): (x.sum, x.mean, x.max, x.n) for x in atoms.atom_intensity(points, frames_, 2.5, tile).collect()}
    assert len(refined) == len(pts)
    for s, f, k, y, x, v in pts:
        a = of[s, f]
        cy, cx = int(np.floor(y + 0.5)), int(np.floor(x + 0.5))
        box = {(p, q): a[p, q] for p in range(max(0, cy - 2), min(a.shape[0], cy + 3)) for q in range(max(0, cx - 2), min(a.shape[1], cx + 3)) if not np.isnan(a[p, q])}
        low = min(box.values(), default=0)
        total = sum(w - low for w in box.values())
        want = (sum(p * (w - low) for (p, _), w in box.items()) / total, sum(q * (w - low) for (_, q), w in box.items()) / total) if total > 0 else (y, x)
        assert np.allclose(refined[s, f, k], (*want, v))
        disk = [a[p, q] for p in range(a.shape[0]) for q in range(a.shape[1]) if (p - y) ** 2 + (q - x) ** 2 <= 6.25 and not np.isnan(a[p, q])]
        found = summed.pop((s, f, k), None)
        assert (found is None) == (not disk) and (not disk or np.allclose(found, (sum(disk), np.mean(disk), max(disk), len(disk))))
    assert not summed


def test_strain_of_a_sheared_lattice(spark):
    e = np.array([[0.02, 0.01], [0.03, -0.01]])  # d(y, x) by (y, x)
    rows = []
    for i in range(8):
        for j in range(8):
            rows.append((1, 0, i * 8 + j, 10.0 * i, 10.0 * j, 1.0))
            d = (np.eye(2) + e) @ np.array([10.0 * i, 10.0 * j])
            rows.append((2, 0, i * 8 + j, *map(float, d), 1.0))
    pts = spark.createDataFrame(rows, schema.POINTS)
    pairs = strain.peak_pairs(pts, (10.0, 0.0), (0.0, 10.0), 3.0)
    ref = strain.fit_lattice(pts.where("stack_id = 1"), pairs.where("stack_id = 1"))
    both = ref.union(ref.withColumn("stack_id", F.lit(2).cast("long")))
    for r in strain.pair_strain(pairs, both, pts).where("stack_id = 2").collect():
        assert np.allclose([r.eyy, r.exx, r.exy, r.rot], [e[0, 0], e[1, 1], (e[0, 1] + e[1, 0]) / 2, (e[0, 1] - e[1, 0]) / 2])


def test_gpa_finds_uniform_strain(spark):
    y, x = np.mgrid[0:64, 0:64].astype(float)
    exx = 0.02
    a = np.cos(2 * np.pi * x / 8 * (1 - exx)) + np.cos(2 * np.pi * y / 8)
    g1, g2 = (0.0, 1 / 8), (1 / 8, 0.0)
    f = stack(spark, [a])
    row = strain.gpa_strain(strain.gpa_phase(f, g1, 4.0), strain.gpa_phase(f, g2, 4.0), g1, g2).first()
    inner = lambda c: np.array(c).reshape(64, 64)[20:44, 20:44].mean()
    assert abs(inner(row.exx) - exx) < 0.003 and abs(inner(row.eyy)) < 0.003 and abs(inner(row.exy)) < 0.003


def test_detections_are_matched_one_to_one(spark):
    t = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 1.0), (1, 0, 2, 10.0, 0.0, 1.0)], schema.POINTS)
    p = spark.createDataFrame([(1, 0, 1, 0.5, 0.0, 1.0), (1, 0, 2, 0.7, 0.0, 1.0), (1, 0, 3, 30.0, 0.0, 1.0)], schema.POINTS)
    r = atoms.score_detections(p, t, 2.0).first()
    assert (r.tp, r.fp, r.fn, r.mean_error) == (1, 2, 1, 0.5)


def test_a_stub_model_on_tiles(spark):
    a = rng(9).normal(size=(10, 12))
    f = stack(spark, [a])
    find = lambda images: [np.column_stack([yx, i[yx[:, 0], yx[:, 1]]]) for i in images for yx in [np.argwhere(i > 1)]]
    got = sorted((r.y, r.x) for r in atoms.predict_atoms(frames.to_tiles(f, 4, 2), find, 1.0, 4).collect())
    assert got == sorted(map(tuple, np.argwhere(a > 1).astype(float)))


# ---------------------------------------------------------------- regions


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [None, 3])
def test_labels_by_flood_fill(spark, connectivity, tile):
    m = rng(10).random((11, 9)) < 0.55
    want, todo = np.full(m.shape, -1), []
    for y in range(11):
        for x in range(9):
            if m[y, x] and want[y, x] < 0:
                todo, want[y, x] = [(y, x)], y * 9 + x
                while todo:
                    j, i = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            if (connectivity == 8 or not dy * dx) and 0 <= j + dy < 11 and 0 <= i + dx < 9 and m[j + dy, i + dx] and want[j + dy, i + dx] < 0:
                                want[j + dy, i + dx] = y * 9 + x
                                todo.append((j + dy, i + dx))
    got = regions.label_regions(stack(spark, [m.astype(float)]), connectivity, tile).first()
    assert (image(got) == want).all()


def test_regions_split_and_merge(spark):
    def bars(*spans):
        a = np.zeros((3, 12))
        for s, e in spans:
            a[1, s:e] = 1
        return a

    f = stack(spark, [bars((0, 9)), bars((0, 5), (6, 9)), bars((0, 9)), bars()])
    got = {(r.frame, r.label): (r.event, r.track, r.dies) for r in regions.track_regions(regions.label_regions(f)).collect()}
    assert got == {(0, 12): ("birth", "1:0:12", False), (1, 12): ("continue", "1:0:12", False), (1, 18): ("split", "1:1:18", False), (2, 12): ("merge", "1:0:12", True)} or got[(2, 12)][0] == "merge"


def test_polygons(spark):
    got = {r.roi_id: r for r in regions.polygon_area(fx.rois(spark).union(spark.createDataFrame([(4, 0, 0.0, 0.0), (4, 1, 1.0, 1.0)], schema.ROIS))).collect()}
    assert [got[k].area for k in (1, 2, 3, 4)] == [100.0, 24.0, 12.0, None]


# ---------------------------------------------------------------- scans and spectra


def test_centre_of_mass_of_an_empty_pattern(spark):
    p = spark.createDataFrame([(1, 0, 0, 2, 2, [0.0] * 4), (1, 0, 1, 2, 2, [0.0, 0.0, 0.0, 1.0])], schema.PATTERNS)
    got = {r.sx: r for r in fourd.dpc(p, (0.0, 0.0)).collect()}
    assert got[0].dy is None and (got[1].dy, got[1].dx) == (1.0, 1.0)


def test_side_band_of_a_phase_object(spark):
    n, k = 8, 9
    obj = np.exp(0.05j * np.cos(2 * np.pi * np.arange(n) / n))[None, :].repeat(n, 0)
    f = np.fft.fft2(obj) / n**2
    ky, kx = np.mgrid[0:k, 0:k] - 4
    rows = []
    for sy in range(n):
        for sx in range(n):
            wave = np.zeros((k, k), complex)
            for qx in (-1, 0, 1):
                wave += f[0, qx] * np.exp(2j * np.pi * qx * sx / n) * ((ky**2 + (kx - qx) ** 2) <= 9)
            rows.append((1, sy, sx, k, k, [float(v) for v in (np.abs(wave) ** 2).ravel()]))
    out = fourd.ssb(spark.createDataFrame(rows, schema.PATTERNS), 1.0, 3.0, 1 / n, 1.0, (4.0, 4.0)).where("sy = 0").orderBy("sx").collect()
    phase = np.array([r.phase for r in out])
    assert abs(np.corrcoef(phase, np.angle(obj[0]))[0, 1]) > 0.99


def test_spectra_without_partner_and_singular_references(spark):
    s = spark.createDataFrame([(1, 0, 0, "core", 0.0, 1.0, [1.0, 2.0]), (1, 0, 1, "low", 0.0, 1.0, [1.0, 2.0])], schema.SPECTRA)
    paired, alone = eels.pair_dual(s)
    assert paired.count() == 0 and sorted(r.kind for r in alone.collect()) == ["core", "low"]
    refs = spark.createDataFrame([(1, "a", 0.0, 1.0, [1.0, 1.0, 0.0]), (2, "b", 0.0, 1.0, [1.0, 1.0, 0.0])], schema.REFERENCES)
    y = spark.createDataFrame([(1, 0, 0, "core", 0.0, 1.0, [4.0, 4.0, 0.0])], schema.SPECTRA)
    fit = eels.mlls(y, refs, 0.0, 3.0).first()
    assert np.allclose([fit.coefficients[1], fit.coefficients[2]], [2, 2]) and abs(fit.r2 - 1) < 1e-9
    minus = refs.withColumn("counts", F.when(F.col("ref_id") == 2, F.array(F.lit(-1.0), F.lit(-1.0), F.lit(1.0))).otherwise(F.col("counts")))
    assert min(eels.mlls(y, minus, 0.0, 3.0, non_negative=True).first().coefficients.values()) >= 0


def test_refits_equal_fits_of_resampled_spectra(spark, monkeypatch):
    """Against the least-squares fit of the drawn spectra themselves; on two axes, with missing counts, and handed on in small parts."""
    monkeypatch.setattr(eels, "SUMS", 1)
    r, n = rng(8), 12
    refs = [(k, f"r{k}", 0.0, 1.0, [float(v) for v in r.random(40)]) for k in (3, 5, 9)]
    spectra = []
    for scan in (1, 2):
        for k in range(n if scan == 1 else 2):
            de = 1.0 if k % 2 else 0.5
            e = de * np.arange(30)
            y = sum((k + j + 1) * np.interp(e, np.arange(40), refs[j][4]) for j in range(3)) + r.normal(0, 0.1, 30)
            y[k] = np.nan if k % 3 == 0 else y[k]
            spectra.append((scan, k // 4, k % 4, 0.0, de, [float(v) for v in y]))
    df = spark.createDataFrame(spectra, "scan_id long, sy int, sx int, e0 double, de double, counts array<double>").repartition(3)
    references = spark.createDataFrame(refs, "ref_id int, name string, e0 double, de double, counts array<double>")
    got = {(x.scan_id, x.rep): x.coefficients for x in eels.bootstrap_mlls(df, references, 2.0, 12.0, 5, 42).collect()}
    assert sorted(got) == [(s, k) for s in (1, 2) for k in range(5)]
    for (scan, rep), found in got.items():
        own = [x for x in spectra if x[0] == scan]
        taken = [own[int(hashlib.md5(f"42:{rep}:{scan}:{i}".encode()).hexdigest()[:8], 16) % len(own)] for i in range(len(own))]
        m, y = [], []
        for _, _, _, _, de, counts in taken:
            e = de * np.arange(30)
            ok = (e >= 2) & (e < 12) & ~np.isnan(counts)
            m.append(np.stack([np.interp(e, np.arange(40), ref[4]) for ref in refs], 1)[ok])
            y.append(np.array(counts)[ok])
        want = np.linalg.lstsq(np.concatenate(m), np.concatenate(y), rcond=None)[0]
        assert sorted(found) == [3, 5, 9] and np.allclose([found[k] for k in (3, 5, 9)], want, atol=1e-6)
    assert eels.bootstrap_mlls(df.limit(0), references, 2.0, 12.0, 5, 42).collect() == []
    one = {(x.scan_id, x.sy, x.sx): x for x in eels.mlls(df, references, 2.0, 12.0).collect()}
    e = 0.5 * np.arange(30)
    ok = (e >= 2) & (e < 12) & ~np.isnan(spectra[0][5])
    m = np.stack([np.interp(e, np.arange(40), ref[4]) for ref in refs], 1)[ok]
    assert np.allclose([one[1, 0, 0].coefficients[k] for k in (3, 5, 9)], np.linalg.lstsq(m, np.array(spectra[0][5])[ok], rcond=None)[0])


def test_a_statistic_on_resamples(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "g long, i long, v double")
    means = eels.bootstrap_fit(rows, "g", "i", lambda p: p["v"].mean(), 10, 42).orderBy("rep").collect()
    assert len(means) == 10 and abs(np.mean([r.value for r in means]) - eels.bootstrap(rows, "g", "i", "v", 10, 42).first()["mean"]) < 1e-9


# ---------------------------------------------------------------- streams


def test_frames_on_a_stream(spark, tmp_path):
    f = stack(spark, [np.full((2, 2), float(k)) for k in range(6)])
    f.repartition(1).write.parquet(str(tmp_path / "in"))
    live = frames.convert_depth(streaming.stream_frames(spark, str(tmp_path / "in")), "uint16")
    q = streaming.windowed_contrast(live, "2 seconds", "1 second").writeStream.outputMode("complete").format("memory").queryName("contrast").start()
    q.processAllAvailable()
    q.stop()
    got = {r.start.second: (r.n, r["mean"]) for r in spark.table("contrast").collect()}
    assert got == {0: (8, 128.5), 2: (8, 642.5), 4: (8, 1156.5)}


# ---------------------------------------------------------------- joins and numbers without hot keys


@pytest.mark.parametrize("sent", [0, 200_000])
def test_attach_joins_hot_and_null_keys(spark, monkeypatch, sent):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(storage, "HOT", 3)
    rows = [(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i}") for i in range(200)]
    table = [("hot", 1), (None, 2), *((f"k{i}", i) for i in range(0, 200, 4))]
    want = dict(table)
    left, right = spark.createDataFrame(rows, "i long, k string"), spark.createDataFrame(table, "k string, v long")
    got = {r.i: r.v for r in storage.attach(left, right, ["k"], "left").collect()}
    assert got == {i: want.get(k) for i, k in rows}
    assert {r.i: r.v for r in storage.attach(left, right, ["k"]).collect()} == {i: want[k] for i, k in rows if k in want}


def test_numbers_follow_the_order_over_partitions(spark):
    rows = [(i * 37 % 211, i % 3 if i % 7 else 0) for i in range(200)]
    got = storage.numbered(spark.createDataFrame(rows, "e long, g long"), ["g"], ["e"], "n", 5).collect()
    for g in range(3):
        assert [r.n for r in sorted((r for r in got if r.g == g), key=lambda r: r.e)] == list(range(sum(x[1] == g for x in rows)))


def test_shifts_against_the_first_frame_in_pieces(spark, monkeypatch):
    base = np.random.default_rng(4).integers(0, 99, (16, 16)).astype(float)
    frames = [(s, f, 16, 16, np.roll(base, (f % 3, -(f % 2)), (0, 1)).ravel().tolist()) for s in (1, 2) for f in range(3, 12) if f != 5]
    df = spark.createDataFrame(frames, "stack_id long, frame long, height int, width int, px array<double>")
    want = sorted(map(tuple, drift.pair_shifts(df, 3, against="first").collect()))
    monkeypatch.setattr(drift, "PIECE", 2)
    assert sorted(map(tuple, drift.pair_shifts(df, 3, against="first").collect())) == want and len(want) == 14
    assert {(r[1], r[2], r[3]) for r in want if r[1] in (4, 7)} == {(4, 1.0, 1.0), (7, 1.0, 0.0)}


def test_polygons_over_many_cells(spark, monkeypatch):
    """The same pixels whatever the cells are, sent or shuffled."""
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    px = spark.createDataFrame([(y, x) for y in range(30) for x in range(30)], "y int, x int")
    rois = spark.createDataFrame([(1, 0, 2.5, 3.5), (1, 1, 25.5, 6.5), (1, 2, 11.5, 28.5), (2, 0, 0.0, 0.0), (2, 1, 0.0, 5.0), (2, 2, 5.0, 0.0)], "roi_id long, vertex int, y double, x double")
    found = [sorted((r.roi_id, r.y, r.x) for r in regions.in_roi(px, rois, cell).collect()) for cell in (4, 7, 64)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 200


def even_odd(polygon, y, x):
    inside = False
    for (y1, x1), (y2, x2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            inside = not inside
    return inside


@pytest.mark.parametrize("sent", [0, 200_000])
def test_regions_by_spans_equal_the_even_odd_rule(spark, monkeypatch, sent):
    """Winding, crossing and far polygons; whole pixels and places between them; statistics with NaN, over bands and lists of spans, sent and shuffled."""
    monkeypatch.setattr(storage, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(regions, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(regions, "BAND", 7)
    monkeypatch.setattr(regions, "SPANS", 5)
    r = rng(21)
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    star = [(12 + (4 + 7 * (k % 2)) * np.sin(t), 14 + (5 + 8 * (k % 2)) * np.cos(t)) for k, t in enumerate(turn)]
    polygons = {1: star, 2: [(float(y), float(x)) for y, x in r.uniform(-8, 40, (9, 2))], 3: [(-5.0, -5.0), (-5.0, 50.0), (50.0, 50.0), (50.0, -5.0)], 4: [(100.0, 100.0), (120.0, 100.0), (120.0, 130.0)], 5: [(1.0, 1.0), (9.0, 9.0)]}
    rois = spark.createDataFrame([(k, i, float(y), float(x)) for k, p in polygons.items() for i, (y, x) in enumerate(p)], schema.ROIS)
    real = [(i, float(y), float(x)) for i, (y, x) in enumerate(r.uniform(-3, 33, (150, 2)))]
    got = {(x.i, x.roi_id) for x in regions.in_roi(spark.createDataFrame(real, "i int, y double, x double"), rois, 6).collect()}
    assert got == {(i, k) for i, y, x in real for k, p in polygons.items() if len(p) > 2 and even_odd(p, y, x)}
    images = [r.normal(1000, 3, (23, 31)) for _ in range(3)]
    images[1][3:9, 4:20] = np.nan
    images[2][:] = np.nan
    frames_ = stack(spark, images).union(stack(spark, [r.normal(size=(9, 5))], 2))
    whole = {(x.y, x.x, x.roi_id) for x in regions.in_roi(spark.createDataFrame([(y, x) for y in range(23) for x in range(31)], "y int, x int"), rois, 6).collect()}
    inside = {k: {(y, x) for y in range(23) for x in range(31) if len(p) > 2 and even_odd(p, y, x)} for k, p in polygons.items()}
    assert whole == {(y, x, k) for k, v in inside.items() for y, x in v} and all(inside[k] for k in (1, 2, 3))
    stats = {(x.stack_id, x.frame, x.roi_id): x for x in regions.contrast_stats(frames_, rois).collect()}
    for row in frames_.collect():
        a = image(row)
        for k, places in inside.items():
            v = np.array([a[p] for p in places if p[0] < a.shape[0] and p[1] < a.shape[1]])
            v = v[~np.isnan(v)]
            found = stats.pop((row.stack_id, row.frame, k), None)
            if not len(v):
                assert found is None
                continue
            want = (len(v), v.sum(), v.mean(), v.min(), v.max(), np.median(v))
            assert np.allclose((found.n, found.sum, found.mean, found.min, found.max, found.median), want)
            assert found.std is None if len(v) == 1 else np.isclose(found.std, v.std(ddof=1))
    assert not stats


def test_a_polygon_of_many_vertices_sends_its_spans(spark):
    turn = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    rois = spark.createDataFrame([(1, k, float(500 + 400 * np.sin(t)), float(500 + 400 * np.cos(t))) for k, t in enumerate(turn)], schema.ROIS)
    spans = regions.roi_spans(rois)
    assert 798 <= spans.count() <= 801 and abs(spans.agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] - np.pi * 400**2) < 400


def test_a_winding_region_gets_one_label_over_its_tiles(spark):
    mask = np.zeros((24, 24))
    mask[::2] = 1
    mask[1::4, -1] = mask[3::4, 0] = 1
    df = spark.createDataFrame([(1, 0, 24, 24, "float64", mask.ravel().tolist())], "stack_id long, frame long, height int, width int, dtype string, px array<double>").withColumn("ts", F.lit(None).cast("timestamp"))
    labels = regions.label_regions(df, tile=5).first()["px"]
    assert (np.array(labels).reshape(24, 24) == np.where(mask > 0, 0, -1)).all()


def test_stats_and_stretch_of_odd_frames(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0, 1, 4, [1.0, nan, 3.0, 5.0]), (1, 1, 1, 2, [nan, nan]), (1, 2, 1, 1, [7.0])], "stack_id long, frame long, height int, width int, px array<double>")
    got = {r.frame: r for r in regions.contrast_stats(df).collect()}
    assert sorted(got) == [0, 2] and (got[0].n, got[0].median, got[0].min, got[0].max, got[0].std) == (3, 3.0, 1.0, 5.0, 2.0) and got[2].std is None
    px = {r.frame: r.px for r in filters.stretch(df, 0.0, 1.0).collect()}
    assert sorted(px) == [0, 2] and [px[0][i] for i in (0, 2, 3)] == [0.0, 0.5, 1.0] and px[2] == [0.0]


def test_a_manifest_table_keeps_one_row_a_run(spark, tmp_path):
    path, df = str(tmp_path / "runs"), spark.range(3)
    made = [frames.with_manifest(df, "op", "1", {"k": k}, {"k": "px"})[1] for k in (1, 2)]
    for run in (made[0], made[1], made[0], made[0]):
        frames.append_manifest(run, path)
    rows = frames.read_manifest(spark, path).collect()
    assert sorted(r.params["k"] for r in rows) == ["1", "2"] and len({r.run_id for r in rows}) == 2
    assert {r.params["k"]: r.started for r in rows}["1"] > {r.params["k"]: r.started for r in rows}["2"]
    with pytest.raises(ValueError):
        frames.append_manifest(made[0].drop("params"), path)


def test_the_sink_writes_few_bounded_files(spark, tmp_path, monkeypatch):
    """Files follow the rows, not the tasks or the stacks; a long stack is written by several tasks."""
    rows = [(s, f, datetime(2024, 1, 1), 1, 1, "uint8", [float(f)]) for s in range(40) for f in range(4)] + [(99, f, datetime(2024, 1, 1), 1, 1, "uint8", [0.0]) for f in range(1000)]
    df = spark.createDataFrame(rows, schema.FRAMES).repartition(16)
    monkeypatch.setattr(stacks, "FOLDERS", 4)
    monkeypatch.setattr(stacks, "CHUNK", 250)
    stacks.write_frames(df, str(tmp_path / "out"), rows=200)
    files = list((tmp_path / "out").glob("stacks=*/*.parquet"))
    assert len(files) <= 4 + 4 * 2
    sizes = [spark.read.parquet(str(f)).count() for f in files]
    assert max(sizes) <= 200 and sum(sizes) == len(rows)
    got = stacks.read_frames(spark, str(tmp_path / "out"))
    assert got.columns == df.columns and sorted(got.select("stack_id", "frame").collect()) == sorted(df.select("stack_id", "frame").collect())


def test_large_frames_come_back_from_their_pixels(spark):
    import time

    a = rng(51).random((512, 512))
    px = frames.to_pixels(stack(spark, [a])).where("y <> 5 or x <> 7")
    px = px.union(spark.createDataFrame([(1, 0, 5, 7, 3.0), (1, 0, 5, 7, 9.0), (1, 0, 5, 7, 4.0)], schema.PIXELS)).repartition(4)
    frames.from_pixels(px.limit(10)).collect()
    start = time.time()
    (row,) = frames.from_pixels(px).collect()
    assert time.time() - start < 20
    a[5, 7] = 9.0
    assert np.array_equal(image(row), a)


def test_labels_with_very_many_borders(spark):
    """Tiles of three pixels through stripes and a frame around them: more than 10,000 border labels, one region."""
    a = np.zeros((150, 150))
    a[:, ::2] = 1
    a[0] = a[-1] = 1
    b = np.zeros((150, 150))
    b[::2, ::2] = 1
    f = stack(spark, [a, b])
    whole = {r.frame: image(r) for r in regions.label_regions(f).collect()}
    tiled = {r.frame: image(r) for r in regions.label_regions(f, tile=3).collect()}
    assert all(np.array_equal(whole[k], tiled[k]) for k in (0, 1)) and set(np.unique(whole[0])) == {-1.0, 0.0} and len(np.unique(whole[1])) == 75 * 75 + 1


@pytest.mark.parametrize("factor", [10, 20])
def test_shifts_by_a_factor(spark, factor):
    """A periodic image moved by tenths of a pixel through its spectrum, with noise and NaN; a constant image has no shift to refine."""
    r = rng(61)
    base = np.fft.ifft2(np.fft.fft2(r.normal(size=(32, 40))) * np.exp(-20 * (np.fft.fftfreq(32)[:, None] ** 2 + np.fft.fftfreq(40)[None] ** 2))).real
    planted = [(0.3, -0.6), (1.7, 0.4), (-2.1, 2.9), (0.0, 0.1)]
    images = [base]
    for dy, dx in planted:
        phase = np.exp(-2j * np.pi * (dy * np.fft.fftfreq(32)[:, None] + dx * np.fft.fftfreq(40)[None]))
        images.append(np.fft.ifft2(np.fft.fft2(base) * phase).real + r.normal(0, 1e-4, base.shape))
    images[2][3, 4] = np.nan
    frames_ = stack(spark, images).union(stack(spark, [np.ones((8, 8))] * 2, 2))
    got = {(x.stack_id, x.frame): (x.dy, x.dx, x.ncc) for x in drift.pair_shifts(frames_, 4, upsample=factor, against="first").collect()}
    for k, want in enumerate(planted, 1):
        assert np.allclose(got[1, k][:2], want, atol=1 / factor / 2 + 1e-9)
    assert got[2, 1][2] is None


def test_origin_of_a_stack_near_the_cell_edge(spark):
    """Fractions around 0 and 1 belong together; atoms are displaced, missing and out of order in different frames; the lattice is oblique."""
    a, b = np.array([9.0, 2.0]), np.array([-1.0, 11.0])
    r = rng(71)
    rows, want = [], {}
    for f in range(3):
        for i in range(6):
            for j in range(5):
                if (i, j) == (0, 0) and f != 1 or r.random() < 0.1:
                    continue
                d = r.normal(0, 0.3, 2)
                y, x = np.array([0.02, -0.03]) + (i - 2) * a + (j - 2) * b + d
                k = len(rows)
                rows.append((7, f, k, float(y), float(x), 1.0))
                want[k] = (i, j, *d)
    pts = spark.createDataFrame(rows, schema.POINTS)
    lattice = spark.createDataFrame([(7, *map(float, (*a, *b)))], "stack_id long, ay double, ax double, by double, bx double")
    got = strain.displacement(pts, lattice, origin="stack").collect()
    mean = np.mean([[x.uy - want[x.point_id][2], x.ux - want[x.point_id][3]] for x in got], 0)
    assert len(got) == len(rows) and np.abs(mean).max() < 0.2
    for x in got:
        i, j, dy, dx = want[x.point_id]
        assert (x.ia, x.ib) == (i, j) and np.allclose([x.uy, x.ux], [dy, dx] + mean, atol=1e-9)
    with pytest.raises(ValueError):
        strain.displacement(pts, lattice, origin="frame")


def test_templates_in_blocks_equal_the_whole_bank(spark):
    r = rng(81)
    table = r.normal(size=(23, 9))
    table[11] = table[4]  # a tie between blocks goes to the smaller id
    table[20] = 5.0
    templates = spark.createDataFrame([(k, [float(v) for v in t]) for k, t in enumerate(table)], "template_id int, px array<double>")
    patterns = spark.createDataFrame([(k, [float(v) for v in t]) for k, t in enumerate([*table[[4, 7]], *r.normal(size=(20, 9)), np.ones(9)])], "pos long, px array<double>")
    whole = sorted((x.pos, x.rank, x.template_id, round(x.score, 9)) for x in fourd.orientation(patterns, templates, 3).collect())
    for values in (9, 45, 100):
        assert sorted((x.pos, x.rank, x.template_id, round(x.score, 9)) for x in fourd.orientation(patterns, templates, 3, values=values).collect()) == whole
    assert whole[0][:3] == (0, 1, 4) and whole[1][:3] == (0, 2, 11)


# ---------------------------------------------------------------- joins at size


def sent(df):
    """The number of sides that the plan of a table sends through the driver."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_phase_images_are_not_sent_through_the_driver(spark):
    waves = fx.waves(spark, SF)
    out = strain.gpa_strain(strain.gpa_phase(waves, (0.0, 1 / 6), 3.0), strain.gpa_phase(waves, (1 / 6, 0.0), 3.0), (0.0, 1 / 6), (1 / 6, 0.0))
    assert sent(out) == 0
    assert out.count() == waves.count()


def test_points_and_their_pairs_are_not_sent_through_the_driver(spark):
    pts = fx.points(spark, SF)
    assert sent(atoms.near_pairs(pts, pts, ["stack_id", "frame"], 2.0)) == 0
    assert sent(atoms.score_detections(pts, pts, 2.0)) == 0
    pairs = strain.peak_pairs(pts, (10.0, 0.0), (0.0, 10.0), 2.0)
    lattice = strain.fit_lattice(pts, pairs)
    assert sent(lattice) == 0
    assert sent(strain.displacement(pts, lattice)) == sent(strain.pair_strain(pairs, lattice, pts)) == 1  # the counted table of lattices


def test_frames_and_labels_are_not_sent_through_the_driver(spark):
    lat, mask = fx.lattice(spark, SF), regions.segment(fx.blobs(spark, SF), 100.0)
    for against in ("previous", "first"):
        assert sent(drift.pair_shifts(lat, 2, against=against)) == 0
    assert sent(drift.apply_shift(lat, drift.accumulate(drift.pair_shifts(lat, 2)))) == 0
    assert sent(regions.label_regions(mask, tile=7)) == 0
    labels = regions.label_regions(mask)
    assert sent(regions.measure_regions(labels, fx.blobs(spark, SF))) == 0
    assert sent(regions.label_overlaps(labels)) == 0
    assert sent(regions.track_regions(labels)) == 0


def test_a_kernel_gets_a_bounded_number_of_values_at_once(monkeypatch):
    import pandas as pd

    from framelake.functions import arrays

    monkeypatch.setattr(arrays, "VALUES", 100, raising=False)
    sizes = [(3, 4)] * 50 + [(11, 10)] * 3 + [(0, 5)]
    pdf = pd.DataFrame({"id": range(54), "h": [h for h, _ in sizes], "w": [w for _, w in sizes]})
    parts = list(arrays.by_size(pdf, "h", "w"))
    assert all(len(part) * h * w <= 100 or len(part) == 1 for part, h, w in parts)
    assert sorted(i for part, *_ in parts for i in part["id"]) == list(range(54))


def test_ranges_of_many_small_files_share_partitions(tmp_path):
    for k in range(40):
        np.save(tmp_path / f"{k}.npy", rng(k).integers(0, 9, (6, 5, 4)).astype(np.uint8))
    reader = large.NpyReader({"path": str(tmp_path), "frames": "4", "stack": r"(\d+)\.npy$", "partitions": "3"})
    parts = reader.partitions()
    assert len(parts) <= 4
    assert sorted(r[1:] for p in parts for r in p.ranges) == sorted((k, i, j) for k in range(40) for i, j in ((0, 4), (4, 6)))
    few = large.NpyReader({"path": str(tmp_path), "frames": "4", "bytes": "200", "stack": r"(\d+)\.npy$"}).partitions()
    assert max(sum((r[3] - r[2]) * 20 for r in p.ranges) for p in few) <= 200


def test_small_chunks_share_calls(spark):
    kept = fx.lattice(spark, SF).where("(stack_id + frame) % 5 <> 0")
    plan = filters.temporal_denoise(kept, 2, chunk=3, tile=9)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_histograms_and_profiles_explode_no_pixels(spark):
    blobs = fx.blobs(spark, SF)
    for df in (regions.histogram(blobs, 21, 172, 16), filters.radial_profile(blobs)):
        assert "posexplode" not in df._jdf.queryExecution().executedPlan().toString()
    odd = np.array([[-np.inf, 0.0, 1.0], [np.nan, 2.0, np.inf]])
    got = {r.bin: r.n for r in regions.histogram(stack(spark, [odd]), 0, 2, 2).collect()}
    assert got == {-1: 1, 0: 1, 1: 2, 2: 1}


@pytest.mark.parametrize("name", ["f6_disk_strain", "g4_remove_plural"])
def test_scans_are_dealt_over_tasks_before_their_values_are_made(spark, name):
    """a small file of scans is one partition, whatever is made of its rows."""
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_k_means_takes_equal_intensities_once(spark, monkeypatch):
    """3,000 points of one partition have three intensities, of which the fit gets one row each."""
    seen = []

    class Counted(atoms.KMeans):
        def fit(self, dataset):
            seen.append(dataset.count())
            return super().fit(dataset)

    monkeypatch.setattr(atoms, "KMeans", Counted)
    points = spark.range(3000).coalesce(1).selectExpr("id", "cast(case when id < 10 then 100 when id < 20 then 104 else 200 end as double) as intensity")
    got = atoms.classify_atoms(points, k=2).groupBy("intensity", "class").count().collect()
    assert seen == [3]
    assert sorted(map(tuple, got)) == [(100.0, 0, 10), (104.0, 0, 10), (200.0, 1, 2980)]


def test_patterns_are_added_up_packed(spark):
    """a scan's patterns, of two sizes and with holes, become sums before any pixel is a row."""
    r, rows = rng(4), []
    for k in range(60):
        h, w = ((3, 4), (2, 5))[k % 2]
        a = r.integers(0, 50, (h, w)).astype(float)
        a[r.random((h, w)) < 0.3] = np.nan
        a[0, 0] = np.nan
        rows.append((k % 3, 0, k, h, w, a.ravel().tolist()))
    found = fourd.mean_pattern(spark.createDataFrame(rows, schema.PATTERNS).repartition(7))
    assert "MapInPandas" in found._jdf.queryExecution().toString()
    want = {}
    for scan, _, _, _, w, px in rows:
        for i, v in enumerate(px):
            if not np.isnan(v):
                want.setdefault((scan, i // w, i % w), []).append(v)
    got = {(x.scan_id, x.ky, x.kx): (x.mean, x.max) for x in found.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], (np.mean(v), max(v))) for k, v in want.items())


def test_pixels_are_packed_before_they_meet(spark):
    """pixels of several frames in mixed order, one of them twice, travel as pieces of frames."""
    r = rng(6)
    keys = [(1, 0), (1, 1), (2, 0), (2, 1), (1, None)]
    rows = [(s, f, y, x, 1.0 if f is None else float(100 * s + 10 * f + 4 * y + x)) for s, f in keys for y in range(3) for x in range(4)] + [(1, 0, 1, 1, 999.0)]
    rows = [rows[i] for i in r.permutation(len(rows))]
    found = frames.from_pixels(spark.createDataFrame(rows, schema.PIXELS).repartition(3))
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    got = {(x.stack_id, x.frame): (x.height, x.width, x.px) for x in found.collect()}
    want = {(s, f): (3, 4, [float(100 * s + 10 * f + k) for k in range(12)]) for s in (1, 2) for f in (0, 1)} | {(1, None): (3, 4, [1.0] * 12)}
    want[1, 0][2][5] = 999.0
    assert got == want


def test_spectra_are_fitted_in_bounded_slices(spark, monkeypatch):
    """F16: a batch of any number of spectra is taken by at most VALUES counts, and sums are handed on in small parts, with the same result."""
    monkeypatch.setattr(eels, "VALUES", 40)
    counts = rng(2).random((23, 8))
    pdf = pd.DataFrame({"scan_id": 1, "sy": 0, "sx": np.arange(23), "e0": 0.0, "de": 1.0, "counts": list(counts)})
    parts = list(eels._systems(pdf, np.array([[0.0, 1.0]]), np.ones((1, 8)), 0.0, 8.0))
    assert [len(y) for _, _, y in parts] == [5, 5, 5, 5, 3]
    assert (np.concatenate([y for _, _, y in parts]) == counts).all()
    assert eels.SUMS * 8 <= 1 << 24


@pytest.mark.parametrize("name", ["a7_pixels", "e4_label_regions", "e9_in_roi", "g3_remove_background", "g5_mlls", "g6_edge_ratio", "g7_valence"])
def test_arrays_are_made_once_and_after_they_are_dealt(spark, name):
    """no filter on an array's size makes it where the source is read, in one task for a small file."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "lambda" in line]


def test_null_and_empty_images_have_no_pixels(spark):
    rows = [(1, 0, 2, [1.0, None, float("nan"), 4.0]), (1, 1, 2, []), (1, 2, 2, None)]
    got = frames.to_pixels(spark.createDataFrame(rows, "stack_id long, frame long, width int, px array<double>")).collect()
    assert [(r.frame, r.y, r.x, repr(r.v)) for r in sorted(got)] == [(0, 0, 0, "1.0"), (0, 0, 1, "None"), (0, 1, 0, "nan"), (0, 1, 1, "4.0")]
