"""Patches of one shape go through a step together; results are those of one patch at a time."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterspark.functions import masks, stacks
from rasterspark.operators import augment, cleaning, regions, wide

KIND = "patch_id long, r int, c int, class_id int, confidence double"


def grids(n=40, side=8, seed=5):
    return np.random.default_rng(seed).integers(0, 4, (n, side, side))


def rows_of(many):
    return [(k, r, c, int(v), 0.5) for k, grid in enumerate(many) for (r, c), v in np.ndenumerate(grid)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_helpers_on_a_stack_are_those_of_each_patch():
    many = grids() == 1
    for eight in (False, True):
        named = masks.components(many, eight)
        for one, whole in zip(many, named, strict=True):
            assert (masks.components(one, eight) == np.where(whole > 0, whole - whole[whole > 0].min(initial=whole.max(initial=1)) + 1, 0)).all()
    assert all(((masks.holes(one) > 0) == (whole > 0)).all() for one, whole in zip(~many, masks.holes(~many), strict=True))


def test_tables_are_cut_between_groups_only():
    keys = np.repeat([1, 2, 3, 4, 5], [3, 40, 1, 2, 9])
    table = pa.table({"k": keys, "at": np.arange(len(keys))})
    cut = list(stacks.whole_groups(table.to_batches(max_chunksize=2), ["k"], 5))
    assert pa.concat_tables(cut)["at"].to_pylist() == list(range(len(keys))) and len(cut) > 1
    assert sum(len(set(x["k"].to_pylist())) for x in cut) == 5
    places = [(rows.tolist(), shape) for rows, _, shape in stacks.stacks(np.array([0, 0, 1, 2]), np.zeros(4, int), np.array([0, 1, 0, 1]), np.array([1, 1, 1]), np.array([2, 1, 2]))]
    assert sorted(places) == [([0, 1, 3], (2, 1, 2)), ([2], (1, 1, 1))]


STEPS = [cleaning.Cleaning(least_object=3, least_hole=3), cleaning.fill_holes, cleaning.replace_small(3), cleaning.square_pass("close"), cleaning.majority(3)]


@pytest.mark.parametrize("step", STEPS, ids=str)
def test_a_step_gets_many_patches_at_once(spark, step):
    many, seen = [*grids(), *grids(7, 5)], spark.sparkContext.accumulator(0)

    def counted(grid):
        seen.add(1)
        return step(grid)

    counted.stacked = True
    found = {(x.patch_id, x.r, x.c): x.class_id for x in cleaning.per_patch(spark.createDataFrame(rows_of(many), KIND), counted).collect()}
    assert all(found[k, r, c] == v for k, grid in enumerate(many) for (r, c), v in np.ndenumerate(step(grid.copy())))
    assert seen.value <= 8


def test_regions_take_no_window_and_number_each_patch(spark):
    many = grids()
    labelled = regions.label(spark.createDataFrame(rows_of(many), KIND))
    found = regions.regions(labelled, "patch_id", least=1)
    assert "Window" not in plan(found)
    got = {(x.patch_id, x.class_id, x.region_id): (x.area_px, x.perimeter, x.row_width) for x in found.collect()}
    want = {}
    for p, grid in enumerate(many):
        for k in (1, 2, 3):
            named = masks.components(grid == k, eight=k != 1)
            for one in range(1, named.max() + 1):
                own = named == one
                bare = sum(int((own & ~masks.shift(own, i, j, False)).sum()) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))
                want[p, k, one] = (int(own.sum()), bare, own.sum() / own.any(axis=1).sum())
    assert got == want


def test_rescaled_patches_need_no_join(spark):
    rng = np.random.default_rng(1)
    values = rng.random((30, 4, 4)).round(3)
    cells = [(k, r, c, None if (k, r) == (2, 1) else float(v), int(10 * v)) for k, grid in enumerate(values) for (r, c), v in np.ndenumerate(grid) if (k, r) != (1, 3)]
    df = spark.createDataFrame(cells, "p int, r int, c int, v double, k int")
    found = augment.rescale(df, ["v"], 4, F.when(F.col("p") % 2 == 0, 1.5).otherwise(0.5), "p", class_col="k")
    assert "Join" not in plan(found)
    got = {(x.p, x.r, x.c): (x.v, x.k) for x in found.collect()}
    have, want = {(p, r, c): (v, k) for p, r, c, v, k in cells}, {}
    for p in range(30):
        n = 6 if p % 2 == 0 else 2
        for r, c in np.ndindex(n, n):
            y, x = r * 3 / (n - 1), c * 3 / (n - 1)
            near = [(have[p, i, j], (1 - abs(i - y)) * (1 - abs(j - x))) for i in range(4) for j in range(4) if (p, i, j) in have and abs(i - y) < 1 and abs(j - x) < 1]
            if near:
                known = [v * s for (v, _), s in near if v is not None]
                best = have.get((p, int(y + 0.5), int(x + 0.5)))
                want[p, r, c] = (sum(known) if known else None, best and best[1])
    assert got.keys() == want.keys()
    assert all(got[k][1] == v[1] and got[k][0] == (None if v[0] is None else pytest.approx(v[0])) for k, v in want.items())


SCENE = "scene_id long, row long, col long, class_id int, confidence double"


def ragged(spark):
    """Two scenes of which one lacks a block of cells, so that the rest of it has a stair as its border."""
    many = grids(2, 12, 3)
    there = [x for x in rows_of(many) if not (x[0] == 1 and x[1] >= 8 and x[2] >= 4)]
    return many, {x[:3] for x in there}, spark.createDataFrame(there, SCENE)


def test_cells_without_a_row_have_no_vote(spark):
    many, there, cells = ragged(spark)
    for x in wide.clean(cells, cleaning.majority(3), tile=5).collect():
        near = [(x.scene_id, min(max(x.row + i, 0), 11), min(max(x.col + j, 0), 11)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        votes = np.bincount([many[k] for k in near if k in there])
        assert x.class_id == votes.argmax()


def test_cells_without_a_row_are_outside(spark):
    _, there, cells = ragged(spark)
    plus, near = masks.ellipse(1), lambda k, own, every: every((k[0], k[1] + i, k[2] + j) in own for i, j in plus)
    mask = {(x[0], x[1], x[2]) for x in cells.where("class_id = 1").collect()}
    worn = {k for k in there if all((k[0], k[1] + i, k[2] + j) in mask or (k[0], k[1] + i, k[2] + j) not in there for i, j in plus)}
    want = {k for k in there if near(k, worn, any)}
    only = cells.withColumn("class_id", F.when(F.col("class_id") == 1, 1).otherwise(F.lit(None)))
    got = wide.clean(only, cleaning.Cleaning(opening=1, closing=0), tile=5)
    assert {(x.scene_id, x.row, x.col) for x in got.where("class_id = 1").collect()} == want & mask


def test_a_larger_table_is_dealt_to_more_files(spark, tmp_path, monkeypatch):
    from rasterspark.plans import further

    spark.range(200_000).selectExpr("id AS l_orderkey", "uuid() AS other").coalesce(1).write.option("parquet.block.size", 1 << 18).parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(further.manifests, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert further._stream(spark, str(tmp_path), "lineitem", "l_orderkey").columns == ["l_orderkey"]
        dealt = spark.read.parquet(f"{tmp_path}/arriving")
        assert len(dealt.inputFiles()) > further.BATCHES and dealt.columns == ["l_orderkey"] and dealt.distinct().count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
