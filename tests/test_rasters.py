"""Footprints, windows, legality and alignment against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from terraweft.catalog import Catalog, Layer, literal_rows
from terraweft.functions import geo
from terraweft.operators import align, cube, footprint, resample, screen
from terraweft.operators.footprint import full_grid

BASE = Layer(0, "base", "y", 70, 0.0, 0.0, 1.0, 1.0, -9999.0, 9, 7)
LAYERS = Catalog(
    [
        BASE,
        Layer(1, "fine", "x", 30, -0.25, 0.5, 0.4375, 0.4375, -9999.0, 20, 18),
        Layer(2, "coarse", "x", 700, -3.0, 2.0, 8.0, 4.0, -9999.0, 2, 3),
        Layer(3, "even", "x", 20, 0.0, 0.0, 0.25, 0.25, -9999.0, 36, 28),
    ]
)


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(0)
    out = {}
    for layer in LAYERS:
        values = np.round(rng.uniform(0, 100, (layer.nx, layer.ny)), 3)
        values[rng.uniform(size=values.shape) < 0.01] = np.nan
        out[layer.layer_id] = values
    out[2][:] = 5.0
    return out


@pytest.fixture(scope="module")
def pixels(spark, grids):
    rows = [(k, i, j, float(v)) for k, g in grids.items() for (i, j), v in np.ndenumerate(g)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["layer_id", "ix", "iy", "value"]).astype({"layer_id": "int32", "ix": "int32", "iy": "int32"}))
    return df.selectExpr("layer_id", "ix", "iy", "CASE WHEN NOT isnan(value) THEN value END AS value").cache()


def window(layer, bi, bj):
    size = layer.size_for(BASE)
    half = 0.5 if size % 2 == 0 else 0.0
    ti = ((BASE.ulh + (bi + 0.5) * BASE.psh) - layer.ulh) / layer.psh
    tj = (layer.ulv - (BASE.ulv - (bj + 0.5) * BASE.psv)) / layer.psv
    return math.floor(ti + half) - size // 2, math.floor(tj + half) - size // 2, size


def naive_windows(grids, layers):
    out = {}
    for bi in range(BASE.nx):
        for bj in range(BASE.ny):
            for layer in layers:
                x0, y0, size = window(layer, bi, bj)
                for a in range(size):
                    for b in range(size):
                        if 0 <= x0 + a < layer.nx and 0 <= y0 + b < layer.ny:
                            out[(bi, bj, layer.layer_id, a, b)] = grids[layer.layer_id][x0 + a, y0 + b]
    return out


@pytest.mark.parametrize("fan_out", [footprint.MAX_FAN_OUT, 4, 0])
def test_windows_and_legality(spark, pixels, grids, monkeypatch, fan_out):
    monkeypatch.setattr(footprint, "MAX_FAN_OUT", fan_out)
    others = LAYERS.without([0])
    cells = full_grid(spark, BASE.nx, BASE.ny)
    got = resample.gather_windows(cells, pixels, BASE, others).toPandas()
    want = naive_windows(grids, others)
    mine = {(r.bi, r.bj, r.layer_id, r.wi, r.wj): r.value for r in got.itertuples()}
    assert mine.keys() == want.keys()
    for key, v in want.items():
        assert (math.isnan(v) and mine[key] is None or math.isnan(mine[key])) if math.isnan(v) else mine[key] == v
    legal = set()
    for bi in range(BASE.nx):
        for bj in range(BASE.ny):
            if math.isnan(grids[0][bi, bj]):
                continue
            values = [[v for k, v in want.items() if k[:3] == (bi, bj, layer.layer_id)] for layer in others]
            if all(vs and not any(math.isnan(v) for v in vs) for vs in values):
                legal.add((bi, bj))
    found = resample.legal_samples(pixels, BASE, LAYERS).toPandas()
    assert {(r.bi, r.bj) for r in found.itertuples()} == legal
    ordered = found.sort_values("sample_id")
    assert ordered["sample_id"].tolist() == list(range(len(legal)))
    assert [(r.bi, r.bj) for r in ordered.itertuples()] == sorted(legal)


@pytest.mark.parametrize("n,pad", [(1, 0), (3, 0), (4, 2)])
def test_resample_nearest(spark, pixels, grids, n, pad):
    others = LAYERS.without([0])
    cells = full_grid(spark, BASE.nx, BASE.ny)
    got = resample.resample_nearest(cells, pixels, BASE, others, n, pad).toPandas()
    want = {}
    for bi in range(BASE.nx):
        for bj in range(BASE.ny):
            for si in range(-pad, n + pad):
                for sj in range(-pad, n + pad):
                    cx = BASE.ulh + (bi + (2 * si + 1) / (2 * n)) * BASE.psh
                    cy = BASE.ulv - (bj + (2 * sj + 1) / (2 * n)) * BASE.psv
                    for layer in others:
                        ix, iy = math.floor((cx - layer.ulh) / layer.psh), math.floor((layer.ulv - cy) / layer.psv)
                        if 0 <= ix < layer.nx and 0 <= iy < layer.ny:
                            want[(bi, bj, si, sj, layer.layer_id)] = grids[layer.layer_id][ix, iy]
    mine = {(r.bi, r.bj, r.si, r.sj, r.channel): r.value for r in got.itertuples()}
    assert mine.keys() == want.keys()
    np.testing.assert_array_equal(
        np.array([mine[k] for k in want], dtype=float), np.array(list(want.values()), dtype=float)
    )


@pytest.mark.parametrize("res,step,offsets", [(140, 10, "spread"), (70, 15, "spread"), (140, 10, "floor"), (30, 10, "spread")])
def test_align_mean(pixels, grids, res, step, offsets):
    layer = LAYERS[1]
    target = align.target_grid(BASE, res)
    m, f = align.subsamples(target, layer, step)
    got = align.align_agg(pixels, target, layer, "mean", step, offsets).toPandas()
    mine = {(r.bi, r.bj): r.value for r in got.itertuples()}
    count = 0
    for bi in range(target.nx):
        for bj in range(target.ny):
            fx = (target.ulh + bi * target.psh - layer.ulh) / layer.psh
            fy = (layer.ulv - (target.ulv - bj * target.psv)) / layer.psv
            found = []
            for a in range(m):
                for b in range(m):
                    da, db = (a // f, b // f) if offsets == "floor" else (a / f + 1 / (2 * f), b / f + 1 / (2 * f))
                    ix, iy = math.floor(fx + da), math.floor(fy + db)
                    if 0 <= ix < layer.nx and 0 <= iy < layer.ny and not math.isnan(grids[1][ix, iy]):
                        found.append(grids[1][ix, iy])
            if found:
                count += 1
                assert mine[(bi, bj)] == pytest.approx(np.mean(found), rel=1e-9)
    assert count == len(mine)


def test_weights_cover_the_cell(spark, pixels):
    # away from the edges the covered area of all pixels is the area of the cell
    layer = LAYERS[3]
    ones = pixels.selectExpr("layer_id", "ix", "iy", "1.0D AS value")
    got = align.align_agg(ones, BASE, layer, "mean", weighted=True).toPandas()
    assert len(got) == BASE.nx * BASE.ny and (got["value"] == 1.0).all()


def test_parameter_counts(spark):
    # fixed values: native sizes of a published 20-layer stack and its published totals per sample
    sizes = [34] * 12 + [2] * 6 + [1]
    layers = literal_rows(spark, [{"layer_id": i, "role": "x", "native": s, "sample": 34} for i, s in enumerate(sizes)])
    assert sum(s * s for s in sizes) == 13_897
    assert 19 * 34**2 == 21_964
    adjusted = geo.equalize_params(layers).toPandas()["adjusted"]
    assert adjusted.unique().tolist() == [27]
    assert int((adjusted**2).sum()) == 13_851


def test_buffer_and_halo(pixels):
    layer = LAYERS[1]
    ring = cube.halo_ring(layer, BASE)
    assert ring == 70 // 60 + 1
    padded = cube.buffer_pixels(pixels, layer, BASE)
    assert padded.count() == (layer.nx + 2 * ring) * (layer.ny + 2 * ring)
    assert cube.halo_ring(BASE, BASE) == 0


def test_clip_with_hole_and_overlap(spark):
    layer = Layer(0, "g", "y", 1, 0.0, 0.0, 1.0, 1.0, None, 12, 12)

    def square(poly, ring, x, y, s):
        pts = [(x, -y), (x + s, -y), (x + s, -y - s), (x, -y - s), (x, -y)]
        return [(poly, ring, i, float(a), float(b)) for i, (a, b) in enumerate(pts)]

    rows = square(0, 0, 1, 1, 8) + square(0, 1, 3, 3, 3) + square(1, 0, 4, 4, 6)
    aoi = spark.createDataFrame(rows, "poly_id int, ring int, seq int, x double, y double")
    grid = full_grid(spark, 12, 12).selectExpr("0 AS layer_id", "bi AS ix", "bj AS iy", "1.0D AS value")
    got = screen.clip(grid, layer, aoi, 12).toPandas()
    assert len(got) == 144

    def inside(i, j):
        cx, cy = i + 0.5, j + 0.5
        outer, hole = (1 <= cx < 9 and 1 <= cy < 9), (3 <= cx < 6 and 3 <= cy < 6)
        return (outer and not hole) or (4 <= cx < 10 and 4 <= cy < 10)

    for r in got.itertuples():
        assert (r.value == 1.0) == inside(r.ix, r.iy)
