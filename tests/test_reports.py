"""Draws, rescaling, checks and figure tables on small inputs."""

import pytest
from pyspark.sql import functions as F

from rasterspark.operators import augment, checks, figures, tiling


def test_weighted_draws_follow_weights(spark):
    samples = spark.createDataFrame([(k, float(k)) for k in range(5)] + [(9, None)], "sample_id int, weight double")
    got = {r[0]: r[1] for r in augment.weighted_draws(samples, 5000, per_slot=700).groupBy("sample_id").count().collect()}
    assert sum(got.values()) == 5000 and set(got) == {1, 2, 3, 4}
    assert all(abs(n / 5000 - k / 10) < 0.03 for k, n in got.items())
    again = augment.weighted_draws(samples, 100).collect()
    assert sorted(again) == sorted(augment.weighted_draws(samples.repartition(3), 100).collect())


def test_weighted_draws_of_nothing(spark):
    assert augment.weighted_draws(spark.createDataFrame([], "sample_id int, weight double"), 10).count() == 0


@pytest.mark.parametrize("scale", [1.0, 0.5, 1.5, 0.1])
def test_rescale_of_a_plane_is_a_plane(spark, scale):
    cells = spark.createDataFrame([(r, c, 2.0 * r + c, r) for r in range(4) for c in range(4)], "r int, c int, v double, k int").withColumn("p", F.lit(1))
    rows = augment.rescale(cells, ["v"], 4, F.lit(scale), "p", class_col="k").collect()
    n = max(1, round(4 * scale))
    assert len(rows) == n * n
    for x in rows:
        y, z = (x.r * 3 / (n - 1), x.c * 3 / (n - 1)) if n > 1 else (0, 0)
        assert x.v == pytest.approx(2 * y + z) and x.k == int(y + 0.5)


def test_stitch_puts_row_zero_last(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 0), (1, 0, 0, 0), (1, 1, 0, 1)], "row_index int, col_index int, r int, c int").withColumn("b", F.lit(1))
    got = {(x.row_index, x.col_index, x.r, x.c): (x.row, x.col) for x in tiling.stitch(cells, "b").collect()}
    assert got == {(0, 0, 0, 0): (1, 0), (0, 0, 1, 0): (2, 0), (1, 0, 0, 0): (0, 0), (1, 1, 0, 1): (0, 2)}


def test_grid_and_band_issues(spark):
    grid = "patch_id int, crs string, transform struct<a: double, b: double>, width int, height int"
    patches = spark.createDataFrame([(1, "x", (1.0, 0.0), 8, 8), (2, "x", (1.0, 0.0), 8, 8)], grid)
    labels = spark.createDataFrame([(1, "x", (1.0 + 1e-8, 0.0), 8, 8), (2, None, (1.1, 0.0), 8, 9)], grid)
    assert {tuple(r) for r in checks.grid_issues(labels, patches).collect()} == {(2, "other reference system"), (2, "other transform"), (2, "other size")}
    seen = spark.createDataFrame([(1, "red"), (1, "odd")], "raster_id int, band string")
    want = spark.createDataFrame([("red",), ("blue",)], "band string")
    assert {tuple(r) for r in checks.band_issues(seen, want).collect()} == {(1, "blue", "missing band"), (1, "odd", "unexpected band")}


def test_prediction_and_prepared_issues(spark):
    samples = spark.createDataFrame([(1, "test"), (2, "test")], "sample_id int, split string")
    cells = spark.createDataFrame([(1, float("nan"))], "sample_id int, confidence double")
    assert {tuple(r) for r in checks.prediction_issues(samples, cells).collect()} == {(2, "no mask"), (1, "confidence is not a number")}
    stats = spark.createDataFrame([("red", 0.0)], "band string, std double")
    assert {tuple(r) for r in checks.prepared_issues(samples, stats, 2).collect()} == {("no training sample", 0), ("other number of bands", 1), ("deviation not above 0", 1)}


def test_figures(spark):
    cells = spark.createDataFrame([(s, 0, c, s + c) for s in (3, 5, 7) for c in (0, 1)], "sample_id int, r int, c int, class_id int")
    assert {tuple(r) for r in figures.side_by_side(cells).collect()} == {(0, 0, 3, 5), (0, 1, 4, 6)}
    change = spark.createDataFrame([("a", "b", 1, 5)], "from_date string, to_date string, class_id int, delta long")
    assert tuple(figures.change_chart(change, (1, 2)).first()) == ("a", "b", 5, 0)
    seasonal = spark.createDataFrame([("winter", 1, 0.5, 0.1)], "season string, class_id int, mean_fraction double, std_fraction double")
    assert tuple(figures.seasonal_chart(seasonal, (1, 2)).first()) == ("winter", 0.5, 0.1, 0.0, 0.0)


def test_band_issues_check_every_expected_band(spark):
    observed = spark.range(1500).where("id <> 1234").select(F.lit(1).alias("raster_id"), F.concat(F.lit("b"), "id").alias("band"))
    expected = spark.range(1500).select(F.concat(F.lit("b"), "id").alias("band"))
    assert [(r.band, r.issue) for r in checks.band_issues(observed, expected).collect()] == [("b1234", "missing band")]
    with pytest.raises(ValueError, match="1500 expected bands"):
        checks.band_issues(observed, expected, most=1000)
