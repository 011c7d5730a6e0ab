"""Masks, regions, losses and checks against answers worked out by hand or by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.functions import masks
from rasterspark.operators import augment, checks, cleaning, losses, regions


def flood(mask, eight):
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not (i and j))]
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n, todo = n + 1, [start]
        while todo:
            r, c = todo.pop()
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not out[r, c]:
                out[r, c] = n
                todo += [(r + i, c + j) for i, j in steps]
    return out


@pytest.mark.parametrize("eight", [False, True])
def test_components(eight):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.5, 0.7, 1.0):
        mask = rng.random((17, 23)) < share
        assert (masks.components(mask, eight) == flood(mask, eight)).all()


def test_kernels_and_holes():
    assert len(masks.ellipse(1)) == 5
    assert len(masks.ellipse(2)) == 17
    ring = np.ones((5, 5), bool)
    ring[2, 2] = ring[0, 0] = False
    assert np.argwhere(masks.holes(ring)).tolist() == [[2, 2]]
    dot = np.zeros((7, 7), bool)
    dot[3, 3] = True
    assert not masks.dilate(masks.erode(dot, masks.square(3)), masks.square(3)).any()


def cells(spark, grid):
    rows = [(1, r, c, None if v is None else int(v), 0.5) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "patch_id long, r int, c int, class_id int, confidence double")


def classes(df, shape):
    out = np.full(shape, -9)
    for x in df.collect():
        out[x.r, x.c] = -1 if x.class_id is None else x.class_id
    return out


def test_cleaning(spark):
    grid = np.ones((8, 8), int)
    grid[3, 3] = 2
    grid[6:, 6:] = 3
    df = cells(spark, grid)
    filled = classes(cleaning.per_patch(df, cleaning.fill_holes), grid.shape)
    assert filled[3, 3] == 1
    assert filled[7, 7] == 3
    assert classes(cleaning.per_patch(df, cleaning.replace_small(5)), grid.shape).tolist() == np.ones((8, 8), int).tolist()
    assert classes(cleaning.per_patch(df, cleaning.majority(3)), grid.shape)[3, 3] == 1
    assert (classes(cleaning.per_patch(df, cleaning.square_pass("open")), grid.shape) == grid).all()
    small = cleaning.Cleaning(opening=0, closing=0, least_object=3, overrides={3: cleaning.Cleaning(0, 0, 9)})
    assert set(classes(cleaning.per_patch(df, small), grid.shape)[[3, 7], [3, 7]]) == {0}
    with pytest.raises(ValueError):
        cleaning.square_pass("other")
    assert cleaning.per_patch(df.limit(0), cleaning.fill_holes).count() == 0
    unknown = cells(spark, [[1, None], [1, 1]])
    assert classes(cleaning.per_patch(unknown, cleaning.majority(3)), (2, 2)).tolist() == [[1, -1], [1, 1]]


def test_regions(spark):
    grid = [[1, 1, 0, 2, 0], [1, 1, 0, 0, 2], [0, 0, 1, 2, 0], [3, 3, 3, 3, 3]]
    labelled = regions.label(cells(spark, grid))
    found = regions.regions(labelled, "patch_id", least=1)
    rows = {(x.class_id, x.region_id): x for x in found.collect()}
    assert {k: v.area_px for k, v in rows.items()} == {(1, 1): 4, (1, 2): 1, (2, 1): 3, (3, 1): 5}
    assert rows[1, 1].perimeter == 8
    assert rows[1, 1].compactness == pytest.approx(math.pi / 4)
    assert rows[2, 1].perimeter == 12
    assert (rows[3, 1].aspect, rows[3, 1].elongation, rows[3, 1].row_width) == (5.0, 0.8, 5.0)
    told = {x.class_id: x for x in regions.region_metrics(labelled, regions.regions(labelled, "patch_id"), "patch_id").collect()}
    assert (told[1].n_regions, told[1].fragmentation, told[1].width_px) == (1, 0.2, 2.0)
    assert (told[2].n_regions, told[2].largest_px) == (0, 0)


def test_losses(spark):
    rows = [([2.0, 0.0, -1.0], 0), ([0.5, 0.5, 0.0], 2), ([9.0, 9.0, 9.0], 255)]
    df = spark.createDataFrame(rows, "logits array<double>, truth int")
    x, y = np.array([r[0] for r in rows[:2]]), np.array([0, 2])
    lp = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
    own = lp[[0, 1], y]
    assert losses.cross_entropy(df).first().loss == pytest.approx(-own.mean())
    w = np.array([1.0, 2.0, 3.0])
    want = (0.9 * (-own * w[y]).sum() + 0.1 / 3 * (-lp * w).sum()) / w[y].sum()
    assert losses.cross_entropy(df, weights=w, smoothing=0.1).first().loss == pytest.approx(want)
    assert losses.focal(df).first().loss == pytest.approx((0.25 * (1 - np.exp(own)) ** 2 * -own).mean())
    p, hot = np.exp(lp), np.eye(3)[y]
    assert losses.dice(df).first().loss == pytest.approx(1 - ((2 * (p * hot).sum(0) + 1) / (p.sum(0) + hot.sum(0) + 1)).mean())
    assert losses.cross_entropy(df.limit(0)).first().loss == 0


def test_checks(spark):
    grid = [[1, 1, 1, 1, 1], [255, 255, 9, 0, 0]]
    row = checks.label_quality(cells(spark, grid), "patch_id").first()
    assert (row.valid_ratio, row.open_ratio, row.n_classes, row.acceptable) == (0.7, 0.2, 1, True)
    assert row.score == pytest.approx(0.5 + 0.3 * 0.6 + 0.05)
    assert [(x.issue, x.n) for x in checks.cell_issues(cells(spark, grid), ["confidence"], "patch_id").collect()] == [("id outside the classes", 1)]
    df = spark.createDataFrame([(1, 0.9, "a"), (1, 0.9, "a"), (2, 0.1, "b"), (3, None, "a")], "sample_id long, valid_ratio double, crs string")
    assert {(x.sample_id, x.issue) for x in checks.sample_issues(df, crs="crs", expected_crs="a").collect()} == {(1, "repeated id"), (2, "too few valid pixels"), (2, "other reference system"), (3, "too few valid pixels")}


def test_augment(spark):
    grid = np.arange(9).reshape(3, 3)
    df = cells(spark, grid)
    for k in range(5):
        assert (classes(augment.rotate(df, 3, F.lit(k)), (3, 3)) == np.rot90(grid, k)).all()
    assert (classes(augment.flip(df, 3, "c", F.lit(True)), (3, 3)) == grid[:, ::-1]).all()
    assert (classes(augment.flip(df, 3, "r", F.lit(False)), (3, 3)) == grid).all()
    assert (classes(augment.crop(df, F.lit(1), F.lit(0), 2), (2, 2)) == grid[1:, :2]).all()
    wide = spark.range(20000).select("id", F.lit(0.0).alias("x"))
    got = augment.noise(wide, ["x"], 2.0, F.col("id"), 7).agg(F.avg("x"), F.stddev("x")).first()
    assert got[0] == pytest.approx(0, abs=0.06)
    assert got[1] == pytest.approx(2, abs=0.06)
    even = augment.contrast(df.withColumn("v", F.col("class_id").cast("double")), ["v"], F.lit(0.0), "patch_id")
    assert {x.v for x in even.collect()} == {4.0}
    bars = augment.stacked(spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.5), (1, 2, 0.25)], "s int, class_id int, fraction double"), "s")
    assert [x.bottom for x in bars.orderBy("class_id").collect()] == [0.0, 0.25, 0.75]
    tiles = augment.area_tiles(spark.createDataFrame([(0.0, 1.0, 0.0, 2.0, 100, 250)], "min_lon double, max_lon double, min_lat double, max_lat double, width int, height int"), 10000)
    assert [(x.row, x.column) for x in tiles.collect()] == [(0, 0), (1, 0), (2, 0)]
    assert max(x.tile_max_lat for x in tiles.collect()) == 2.0
