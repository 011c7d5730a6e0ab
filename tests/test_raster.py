"""Small tables with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from rasterspark.functions import calendar, probability, spectral
from rasterspark.operators import analytics, classify, composite, dataset, metrics, tiling


@pytest.mark.parametrize(("width", "size", "stride", "n"), [(16, 8, 8, 4), (16, 8, 4, 9), (16, 8, 1, 81), (16, 4, 8, 4), (17, 8, 8, 4), (16, 32, 32, 0)])
def test_windows(spark, width, size, stride, n):
    found = tiling.windows(spark.createDataFrame([(width, width)], "width int, height int"), size, stride).collect()
    assert len(found) == n
    assert [(r.row_off, r.col_off) for r in found] == sorted((r.row_off, r.col_off) for r in found)


def test_flush_window_ends_with_the_raster(spark):
    found = tiling.windows(spark.createDataFrame([(17, 8)], "width int, height int"), 8, 8, flush=True).collect()
    assert [r.col_off for r in found] == [0, 8, 9]


def test_pixels_meet_every_window_that_covers_them(spark):
    pixels = spark.range(8).select(F.col("id").cast("int").alias("row")).crossJoin(spark.range(8).select(F.col("id").cast("int").alias("col")))
    found = tiling.in_windows(pixels, 4, 2, F.lit(8), F.lit(8)).collect()
    want = {(r, c, i, j) for r in range(8) for c in range(8) for i in range(3) for j in range(3) if 0 <= r - 2 * i < 4 and 0 <= c - 2 * j < 4}
    assert {(x.row, x.col, x.row_index, x.col_index) for x in found} == want


def test_evidence(spark):
    df = spark.createDataFrame([(0.2, None), (0.8, None)], "x double, y double")
    at, far = (r[0] for r in df.select(classify.evidence(F.col("x"), 0.2, 0.3)).collect())
    assert at == pytest.approx(0.5)
    assert far > 0.8
    assert df.select(classify.evidence(F.col("y"), 0.2, 0.3)).first()[0] == 0


def test_rules_and_ties(spark):
    df = spark.createDataFrame([(0.7, 0.5, 0.4, 0.2, -0.1, -0.3, 0.0, 0.1), (None,) * 8], "MNDWI double, NDWI double, AWEI_nsh double, AWEI_sh double, NDVI double, BSI double, SAVI double, NDMI double")
    water, nothing = classify.classify(df).collect()
    assert water.class_id == 1
    assert (nothing.class_id, nothing.nodata) == (0, True)
    same = tuple(classify.Rule(str(k), k, constant=0.5) for k in (2, 1))
    assert classify.classify(df, same).first().class_id == 2
    assert classify.classify(df, same, "priority_order", {1: 0, 2: 1}).first().class_id == 1
    with pytest.raises(ValueError):
        classify.classify(df, same, "priority_order", {1: 0, 2: 0})


def test_missing_values_are_not_invented(spark):
    df = spark.createDataFrame([(None, 0.0, 0.0), (2.0, 1.0, -1.0)], "x double, a double, b double")
    first, second = df.select(spectral.clamp(F.col("x")).alias("x"), spectral.difference(F.col("a"), F.col("b")).alias("d"), spectral.usable(F.col("x").cast("int")).alias("u")).collect()
    assert first.x is None
    assert first.d is None
    assert not first.u
    assert second.x == 1.0


def test_composites(spark):
    rows = [(1, 1, 1, datetime.date(2020, 1, d), str(d), x) for d, x in ((1, 1.0), (2, 5.0), (3, None), (4, 2.0))]
    obs = spark.createDataFrame(rows, "aoi_id int, row int, col int, acq_date date, scene_id string, Red double")
    value = lambda method, **o: composite.composite(obs, method, bands=("Red",), **o).first().Red
    assert value("median") == 2.0
    assert value("mean") == pytest.approx(8 / 3)
    assert value("percentile", p=0) == 1.0
    assert value("mosaic") == 2.0
    assert value("medoid") == 2.0
    with pytest.raises(ValueError):
        composite.composite(obs, "mode")


def test_series_are_sorted_as_columns_not_in_a_table_for_each_pixel(spark):
    value = "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 37 = 5 THEN double('NaN') ELSE pmod(hash(id), 100) / 7 END"
    obs = spark.range(4000).selectExpr("IF(id % 17 = 0, NULL, id % 13) AS aoi_id", "cast(sqrt(id) AS int) AS row", "concat('c', id % 2) AS col", f"{value} AS Red", "IF(id % 3 = 0, NULL, cast(id % 5 AS int)) AS NIR", "cast(NULL AS float) AS Blue")
    bands = ("Red", "NIR", "Blue")
    for method, share, options in (("median", 0.5, {}), ("percentile", 0.25, {"p": 25}), ("percentile", 1.0, {"p": 100})):
        found = composite.composite(obs, method, bands=bands, **options)
        assert "percentile(" not in found._jdf.queryExecution().toString() and "median(" not in found._jdf.queryExecution().toString()
        want = obs.groupBy(*composite.PIXEL).agg(*[F.percentile(b, share).alias(b) for b in bands])
        assert found.dtypes == want.dtypes
        assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 < want.count()
    assert composite.median(obs.where("row < 0"), bands).count() == 0


def test_metrics_of_a_perfect_matrix(spark):
    pairs = spark.createDataFrame([(k % 4, k % 4) for k in range(40)] + [(255, 1), (0, 9)], "truth int, pred int")
    got = metrics.overall(metrics.confusion(pairs, 4)).first().asDict()
    assert set(got) == set(metrics.METRICS)
    assert all(v == pytest.approx(1.0) for v in got.values())


def test_metrics_dice_is_f1_and_iou_is_less(spark):
    pairs = spark.createDataFrame([(k * 7 % 4, k * k % 4) for k in range(200)], "truth int, pred int")
    got = metrics.overall(metrics.confusion(pairs, 4)).first()
    assert got.dice == got.f1 >= got.mean_iou


def test_change(spark):
    rows = [("b", datetime.date(2020, 2, 1), 0, 300, 0.3), ("a", datetime.date(2020, 1, 1), 0, 100, 0.1), ("c", datetime.date(2020, 1, 1), 0, 200, 0.2), ("a", datetime.date(2020, 1, 1), 1, 0, 0.0), ("b", datetime.date(2020, 2, 1), 1, 5, 0.1)]
    got = {r.class_id: r for r in analytics.change(spark.createDataFrame(rows, "sample_id string, acq_date date, class_id int, pixels int, fraction double")).collect()}
    assert (got[0].from_pixels, got[0].delta, got[0].percent) == (150, 150, 100.0)
    assert got[1].percent == 0.0


def test_splits_keep_scenes_together(spark):
    rows = [(k, k // 2, k % 3, datetime.date(2022, 1 + k // 2, 1)) for k in range(20)]
    samples = spark.createDataFrame(rows, "sample_id int, scene_id int, aoi_id int, acq_date date")
    for strategy in ("temporal", "random"):
        done = dataset.split(samples, strategy)
        assert dataset.leakage(done, "sample_id", "scene_id").count() == 0
        assert {r.split for r in done.collect()} == set(dataset.SPLITS)
    assert dataset.leakage(dataset.split(samples, "spatial"), "aoi_id").count() == 0
    with pytest.raises(ValueError):
        dataset.split(samples, ratios=(0.5, 0.1, 0.1))


def test_calendar_and_probability(spark):
    df = spark.createDataFrame([(datetime.date(2020, 5, 31), [1.0, 3.0, 3.0])], "d date, x array<double>")
    got = df.select(calendar.season(F.month("d")), calendar.hydrological_year(F.col("d")), probability.winner(F.col("x")), probability.certainty(F.array(F.lit(0.5), F.lit(0.5)))).first()
    assert tuple(got)[:3] == ("pre_monsoon", 2019, 1)
    assert got[3] == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError):
        calendar.season(F.lit(1), {"a": (1,), "b": (1,)})


def test_masked_queries_see_most_observations(spark, tmp_path):
    from rasterspark.plans import queries
    from rasterspark.sources import views

    rows = [(k // 20, 1 + k, 7, k // 2 % 10, float(k % 50), 100.0 * k, k % 11 / 100, k % 9 / 100, datetime.datetime(2020, 1, 1 + k % 28)) for k in range(990)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = [r for r in rows if r[6] < 0.095 and r[7] < 0.075]
    assert views.bright_masked(spark, str(tmp_path)).where(spectral.usable(F.col("QA"))).count() == len(seen) == 800
    pixels: dict = {}
    for r in seen:
        pixels.setdefault((r[0], r[3]), []).append(r[4] / 50)
    assert sum(len(x) > 1 for x in pixels.values()) > len(pixels) / 2
    got = queries.QUERIES["composite_mean_bright"](spark, str(tmp_path)).collect()
    assert {(r.row, r.col): r.Red for r in got} == {k: pytest.approx(sum(x) / len(x)) for k, x in pixels.items()}
    assert sum(r.pixels for r in queries.QUERIES["area_shares_bright"](spark, str(tmp_path)).collect()) == len(pixels)
