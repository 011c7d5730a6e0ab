"""Harmonising, labels, checks, logs, pictures, manifests, draws and streams on hand-made tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.functions import calendar, geometry, probability, spectral
from rasterspark.operators import analytics, augment, catalog, checks, classify, cleaning, composite, dataset, epochs, harmonise, labels, losses, overlays, reports, tiling
from rasterspark.sources import commitlog, manifests
from rasterspark.streaming import change, running


def test_each_family_has_its_own_bands_scale_and_mask(spark):
    oli = {"SR_B2": 10000.0, "SR_B3": 20000.0, "SR_B4": 1.0, "SR_B5": 2.0, "SR_B6": 3.0, "SR_B7": 4.0, "ST_B10": 100.0, "QA_PIXEL": 64.0}
    tm = {"SR_B1": 10000.0, "SR_B7": 5.0, "ST_B6": 50.0, "QA_PIXEL": 8.0}
    s2 = {"B2": 5000.0, "B12": 6.0, "SCL": 4.0}
    df = spark.createDataFrame([(1, "LANDSAT_8", oli), (2, "LANDSAT_5", tm), (3, "Sentinel-2B", s2), (4, None, tm), (5, "Sentinel-2A", s2 | {"SCL": 9.0})], "id int, spacecraft_id string, bands map<string, double>")
    plain = {r.id: r for r in harmonise.harmonised(df).collect()}
    assert (plain[1].Blue, plain[1].Thermal, plain[1].QA) == (10000, 100, 64)
    assert (plain[2].Blue, plain[2].SWIR2, plain[2].Thermal, plain[2].NIR) == (10000, 5, 50, None)
    assert (plain[3].Blue, plain[3].SWIR2, plain[3].Thermal, plain[3].QA) == (5000, 6, 0, 4)
    assert plain[4].Blue == 10000
    log = []
    done = {r.id: r for r in harmonise.preprocess(df, log=log).collect()}
    assert log == ["harmonise", "scale", "mask"]
    assert done[1].Blue == pytest.approx(10000 * 2.75e-5 - 0.2)
    assert done[3].Blue == pytest.approx(0.5)
    assert [done[2].Blue, done[5].Blue, done[5].QA] == [None] * 3
    assert harmonise.masked(harmonise.harmonised(df), bits=()).where("id = 2 AND Blue IS NOT NULL").count() == 1
    with pytest.raises(ValueError, match="Thermal"):
        harmonise.features(harmonise.harmonised(df).drop("Thermal"), "id")


def test_catalog_errors(spark):
    scenes = spark.createDataFrame([("a", 1)], "collection_id string, scene_id int")
    sensors = spark.createDataFrame([("a", "x")], "collection_id string, sensor string")
    with pytest.raises(ValueError, match="blank"):
        catalog.collection(scenes, " ")
    with pytest.raises(ValueError, match="unknown"):
        catalog.sensors_of(sensors, spark.createDataFrame([("b",)], "collection_id string"))


def test_all_expected_bands_are_checked(spark):
    observed = spark.createDataFrame([(1, "other")], "raster_id int, band string")
    expected = spark.range(1500).select(F.concat(F.lit("b"), "id").alias("band"))
    got = checks.band_issues(observed, expected).groupBy("issue").count().collect()
    assert {r.issue: r["count"] for r in got} == {"missing band": 1500, "unexpected band": 1}


@pytest.mark.parametrize("scale", [1e-15, 1.0, 1e15])
def test_draws_follow_relative_weights(spark, scale):
    samples = spark.createDataFrame([(k, w * scale) for k, w in enumerate([1.0, 2.0, 0.0, 5.0, -1.0, 2.0])] + [(9, None)], "sample_id int, weight double")
    got = {r.sample_id: r["count"] for r in augment.weighted_draws(samples, 20_000).groupBy("sample_id").count().collect()}
    assert sum(got.values()) == 20_000
    assert set(got) == {0, 1, 3, 5}
    assert all(abs(got[k] / 20_000 - w / 10) < 0.015 for k, w in ((0, 1), (1, 2), (3, 5), (5, 2)))


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(0)
    bands = {"a": rng.normal(size=501).round(2), "b": np.full(7, 3.0), "c": np.array([1.0]), "d": rng.exponential(size=1000) ** 4}
    df = spark.createDataFrame([(k, float(x)) for k, v in bands.items() for x in v] + [("a", None)], "band string, x double")
    for r in dataset.band_percentiles(df, (0.02, 0.5, 0.98), bins=16).collect():
        assert [r.q0, r.q1, r.q2] == pytest.approx(np.percentile(bands[r.band], [2, 50, 98]).tolist())


def test_medoid_is_the_nearest_real_observation(spark):
    rng = random.Random(2)
    rows = [(1, k % 7, 0, f"2024-01-{1 + k % 28:02d}", f"s{k}", *[rng.random() if rng.random() > 0.02 else None for _ in range(6)]) for k in range(60)]
    names = ["aoi_id", "row", "col", "acq_date", "scene_id", *spectral.OPTICAL]
    got = {r.row: r for r in composite.medoid(spark.createDataFrame(rows, "aoi_id int, row int, col int, acq_date string, scene_id string, " + ", ".join(f"{b} double" for b in spectral.OPTICAL))).collect()}
    for row in range(7):
        own = [dict(zip(names, r, strict=True)) for r in rows if r[1] == row and None not in r]
        middle = {b: np.median([o[b] for o in own]) for b in spectral.OPTICAL}
        best = min(own, key=lambda o: (round(sum((o[b] - middle[b]) ** 2 for b in spectral.OPTICAL), 12), o["acq_date"], o["scene_id"]))
        assert got[row].scene_id == best["scene_id"]


def test_losses_together_are_the_losses_alone(spark):
    rng = random.Random(3)
    rows = [(k % 5, [rng.random() * 4 for _ in range(3)], rng.choice([0, 1, 2, 255])) for k in range(100)]
    df = spark.createDataFrame(rows, "patch_id int, logits array<double>, truth int")
    all_ = {r.patch_id: r for r in losses.all_losses(df, 3, "patch_id", weights=(1, 2, 3), smoothing=0.1).collect()}
    for name, one in (("cross_entropy", losses.cross_entropy(df, "patch_id", weights=(1, 2, 3), smoothing=0.1)), ("focal", losses.focal(df, "patch_id")), ("dice", losses.dice(df, "patch_id"))):
        for r in one.collect():
            assert all_[r.patch_id][name] == pytest.approx(r.loss)


def test_epoch_logs(spark):
    rng = random.Random(4)
    runs = {r: [round(rng.uniform(-0.2, 3), 2) for _ in range(30)] for r in range(6)}
    log = spark.createDataFrame([(r, k + 1, x) for r, v in runs.items() for k, x in enumerate(v)], "run_id int, epoch int, val_loss double")
    best = {r.run_id: (r.best_epoch, r.best_loss) for r in epochs.best_epochs(log).collect()}
    stops = {(p, m): {r.run_id: r.stopped_at for r in epochs.early_stops(log, p, 0.1, m).collect()} for p in (0, 4) for m in ("min", "max")}
    flags = {(r.run_id, r.epoch): r.is_best for r in epochs.best_flags(log).collect()}
    for run, values in runs.items():
        positive = [(x, k + 1) for k, x in enumerate(values) if x > 0]
        assert best[run] == (min(positive)[1], min(positive)[0])
        for (patience, mode), got in stops.items():
            low, waited, stopped = float("inf"), 0, None
            for k, x in enumerate(x if mode == "min" else -x for x in values):
                low, waited = (x, 0) if x < low - 0.1 else (low, waited + 1)
                if patience and waited >= patience:
                    stopped = k + 1
                    break
            assert got[run] == stopped
        low = float("inf")
        for k, x in enumerate(values):
            assert flags[run, k + 1] == (x < low)
            low = min(low, x)
    none = spark.createDataFrame([(1, 1, -1.0), (1, 2, 0.0)], "run_id int, epoch int, val_loss double")
    assert [tuple(r) for r in epochs.best_epochs(none).collect()] == [(1, 1, float("inf"))]


def test_rules_brightness_and_agreement(spark):
    df = spark.createDataFrame([(1, 0.9, 0.5, False, 0.2, 0.4)], "patch_id int, MNDWI double, NDWI double, nodata boolean, Blue double, Red double")
    assert df.select(labels.brightness(df.columns).alias("b")).first().b == pytest.approx(0.3)
    assert labels.brightness(["x"]) is not None
    assert labels.bands_used() == ["AWEI_nsh", "AWEI_sh", "BSI", "MNDWI", "NDMI", "NDVI", "NDWI", "SAVI"]
    assert [r.name for r in labels.enabled(names=("sand", "water"))] == ["water", "sand"]
    assert labels.class_id("sand") == 2
    with pytest.raises(KeyError):
        labels.class_id("ice")
    cells = classify.classify(df.drop("nodata"))
    assert labels.agreement(cells, "patch_id").first().agreement_score == 0
    twice = (*classify.STANDARD_RULES, classify.Rule("wet", 1, (classify.Term("NDWI", 0.0, 1.0),)))
    assert labels.agreement(cells, "patch_id", rules=twice).first().agreement_score == 1


def test_palette_takes_overrides_then_registered_then_own_then_cycle():
    got = overlays.palette(("water", "ice", "sand", "mud"), {"sand": (1, 1, 1)}, {"water": (0, 0, 0)})
    assert got == [(0, 0, 0), overlays.CYCLE[1], (1, 1, 1), overlays.CYCLE[3]]


def test_stretches_and_background(spark):
    df = spark.createDataFrame([(1, float(k), 2.0, float("nan") if k == 5 else -float(k)) for k in range(101)], "s int, a double, b double, c double")
    got = {r.a0: r for r in overlays.percentile_stretch(df.withColumn("a0", F.col("a")), ["a", "b", "c"], "s").collect()}
    assert (got[0].a, got[2].a, got[98].a, got[100].a, got[0].b, got[5].c) == (0, 0, 255, 255, 0, 0)
    flat = overlays.minmax_stretch(df.select("s", "b"), ["b"], "s").collect()
    assert {r.b for r in flat} == {0}
    bg = overlays.background(spark.createDataFrame([(1, 255.0), (1, 51.0), (2, 0.5), (2, -1.0)], "s int, v double"), ["v"], "s").collect()
    assert sorted((r.s, round(r.bg_red, 3), round(r.bg_blue, 3)) for r in bg) == [(1, 0.2, 0.2), (1, 1.0, 1.0), (2, 0.0, 0.0), (2, 0.5, 0.5)]


def test_geometry(spark):
    df = spark.range(1).select(F.struct(F.lit(0.001).alias("a"), F.lit(0.0).alias("b"), F.lit(87.0).alias("c"), F.lit(0.0).alias("d"), F.lit(-0.001).alias("e"), F.lit(26.5).alias("f")).alias("t"))
    moved = df.select("t", geometry.shifted(F.col("t"), F.lit(10), F.lit(20)).alias("m"))
    r = moved.select(geometry.patch_id(F.lit("s"), F.lit(1), F.lit(12)).alias("id"), geometry.bounds(F.col("m"), F.lit(100), F.lit(50)).alias("b"), geometry.offset(F.col("m"), F.col("t")).alias("o")).first()
    assert r.id == "s_r001_c012"
    assert [round(x, 6) for x in r.b] == [87.02, 26.44, 87.12, 26.49]
    assert tuple(r.o) == (20, -10)
    assert tuple(df.select(geometry.pixel_size(F.struct(F.lit(0.0).alias("min_lon"), F.lit(0.0).alias("min_lat"), F.lit(0.0).alias("max_lon"), F.lit(1.0).alias("max_lat")), 30.0).alias("p")).first().p) == (1, 3700)


def test_steps_of_a_configuration(spark):
    cells = spark.range(64).select(F.lit(1).alias("patch_id"), F.floor(F.col("id") / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"), F.col("id").cast("double").alias("v"))
    steps = augment.chain_of({"rotate90": 1.0, "horizontal_flip": 1.0, "brightness": None}, 8, ["v"], seed=3)
    assert len(steps) == 2
    out = augment.chain(cells, steps, ["v"], {"v": (0.0, 1.0)})
    assert sorted(r.v for r in out.collect()) == list(range(64))
    assert out.select("r", "c").distinct().count() == 64
    with pytest.raises(ValueError, match="shear"):
        augment.chain_of({"shear": 1}, 8, ["v"])
    noisy = augment.noise(cells.crossJoin(spark.range(40).select(F.col("id").alias("k"))), ["v"], 2.0, F.col("r"), F.col("c"), F.col("k")).join(cells.withColumnRenamed("v", "v0"), ["patch_id", "r", "c"])
    moments = noisy.agg(F.avg(F.col("v") - F.col("v0")).alias("m"), F.stddev(F.col("v") - F.col("v0")).alias("s")).first()
    assert abs(moments.m) < 0.15
    assert abs(moments.s - 2) < 0.15


def test_a_failing_step_is_skipped_on_demand(spark):
    cells = spark.createDataFrame([(1, 0, 0, 3)], "patch_id int, r int, c int, class_id int")

    def bad(grid):
        raise ValueError("no")

    assert cleaning.per_patch(cells, bad, lambda g: g + 1, skip_failing=True).first().class_id == 4
    with pytest.raises(Exception, match="no"):
        cleaning.per_patch(cells, bad).collect()


def test_class_weights_by_strategy(spark):
    counts = spark.createDataFrame([(0, 10), (1, 30)], "class_id int, pixels long")
    weights = lambda **o: {r.class_id: r.weight for r in dataset.class_weights(counts, **o).collect()}
    assert weights() == pytest.approx({0: 1.5, 1: 0.5})
    assert weights(strategy="none") == {0: 1.0, 1: 1.0}
    assert weights(strategy="manual", manual={0: 2, 1: 3}) == {0: 2.0, 1: 3.0}
    with pytest.raises(ValueError, match="strategy"):
        dataset.class_weights(counts, strategy="x")


def test_confidence_by_name_or_function(spark):
    df = spark.createDataFrame([([0.5, 0.5],)], "p array<double>")
    r = df.select(probability.confidence(F.col("p")).alias("a"), probability.confidence(F.col("p"), "entropy").alias("b"), probability.confidence(F.col("p"), lambda p: F.size(p)).alias("c")).first()
    assert (r.a, round(r.b, 9), r.c) == (0.5, 0.0, 2)


def test_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "s"), ("p2", "t")], "patch_id string, scene_id string")
    log = commitlog.ManifestLog(spark, f"{tmp_path}/m", "patch_id")
    assert log.append_new(rows) == 0
    more = spark.createDataFrame([("p2", "x"), ("p3", "y"), ("p3", "z")], "patch_id string, scene_id string")
    assert log.append_new(more) == 2
    assert sorted(r.patch_id for r in log.snapshot().collect()) == ["p1", "p2", "p3"]
    spark.createDataFrame([("a", "not a number")], "patch_id string, scene_id string").write.option("header", True).csv(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        from pyspark.sql.types import StructType

        manifests.read_csv(spark, f"{tmp_path}/bad", StructType.fromDDL("patch_id string, scene_id int")).collect()
    meta = '{"schema_version": "1.0", "scene_id": "s1", "aoi": {"min_lon": 1.0, "max_lat": 2.0}, "transform": {"a": 0.1}, "band_names": ["Blue", "Red"], "width": 5}'
    (tmp_path / "meta.json").write_text(meta)
    r = manifests.read_metadata(spark, f"{tmp_path}/meta.json").first()
    assert (r.scene_id, r.aoi.max_lat, r.transform.a, r.band_names, r.width, r.crs) == ("s1", 2.0, 0.1, ["Blue", "Red"], 5, None)
    df = spark.createDataFrame([("a/b",), ("a:b",), ("é.-_",)], "sample_id string")
    assert [tuple(r) for r in manifests.clashing_ids(df).collect()] == [("a_b", 2)]
    stats = spark.createDataFrame([("train", 1, 0.5), ("test", 1, 0.2)], "split string, class_id int, share double")
    manifests.write_split_statistics(stats, f"{tmp_path}/stats")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/stats").collect()) == ['{"split":"test","classes":[{"class_id":1,"share":0.2}]}', '{"split":"train","classes":[{"class_id":1,"share":0.5}]}']


def test_artifacts_and_sections(spark):
    paths = spark.createDataFrame([("figure", "a", 1), ("json", "b", 250_000)], "artifact_type string, path string, ordinal long")
    got = reports.artifacts(paths, spark.createDataFrame([("a", 7)], "path string, length long"), "e")
    assert sorted(tuple(r) for r in got.collect()) == [("e_figure_0001", "figure", "a", 7), ("e_json_0002", "json", "b", -1)]
    assert tuple(reports.artifact_totals(got).first()) == (2, 7)
    told = reports.sections(x=spark.createDataFrame([(1, 0.1234567, "n")], "a int, b double, c string"))
    assert sorted(tuple(r) for r in told.collect()) == [("x", "a", 1.0), ("x", "b", 0.123457)]


def test_file_and_dataset_issues(spark):
    samples = spark.createDataFrame([(1, "p1", "m1", 0.9), (2, "p2", "m2", 0.1)], "sample_id int, patch_path string, mask_path string, valid_ratio double")
    got = checks.file_issues(samples, spark.createDataFrame([("p1",), ("m1",), ("m2",)], "path string"))
    assert [tuple(r) for r in got.collect()] == [(2, "missing patch file")]
    assert tuple(checks.low_ratios(samples).first()) == (1, 0.5)
    assert [tuple(r) for r in checks.too_few(samples, got, 10).collect()] == [("too few samples", 1)]
    assert checks.too_few(samples, got, 1).count() == 0
    issues = analytics.input_issues(samples.limit(0), spark.createDataFrame([], "sample_id int, confidence double"))
    assert [tuple(r) for r in issues.collect()] == [("samples", "no samples")]


def test_flush_windows_cover_the_edge_and_tiles_are_padded(spark):
    pixels = spark.range(25).select(F.floor(F.col("id") / 5).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"))
    dealt = tiling.in_flush_windows(pixels, 3, 3, F.lit(5), F.lit(5))
    assert {(r.row_index, r.col_index) for r in dealt.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert dealt.count() == 36
    assert tiling.padded(spark.createDataFrame([(1, 0, 1, 2.0)], "t int, r int, c int, v double"), ["v"], 2, "t").agg(F.sum("v")).first()[0] == 2.0


def test_temporal_defaults(spark):
    df = spark.createDataFrame([("2024-05-01", "2024-07-01", ["L8", "L9"])], "a string, b string, s array<string>")
    r = df.select(*calendar.temporal_columns(F.col("a").cast("date"), F.col("b").cast("date"), F.col("s"), F.lit(None).cast("double"))).first()
    assert (str(r.acquisition_date), r.season, r.hydrological_year, r.sensor, r.confidence, r.annotator) == ("2024-05-31", "pre_monsoon", 2023, "L8,L9", 1.0, "unknown")


def test_streams_of_several_batches(spark, tmp_path):
    """Files arrive one after another; each is a batch of its own.  A date comes in three of them, others come late."""
    batches = [[("a", "2024-01-01", 5), ("a", "2024-01-05", 2), ("b", "2024-01-02", 1)], [("a", "2024-01-05", 7), ("b", "2023-12-31", 100)], [("a", "2024-01-03", 99), ("a", "2024-01-09", 4), ("a", "2024-01-05", 1), ("b", "2024-01-04", 1), ("a", None, 50), ("a", "2024-01-09", None)]]
    schema = "aoi string, day string, pixels long"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*").select("aoi", F.col("day").cast("date").alias("acq_date"), "pixels")
        with change.rocks(spark):
            changes = running.run_once(change.running_change(stream, "aoi"), f"{tmp_path}/change", "update", lambda out: change.newest(out, "aoi"))
        ids = running.run_once(running.new_patches(stream.where("acq_date IS NOT NULL"), "acq_date"), f"{tmp_path}/ids", "append")
    got = sorted((r.aoi, str(r.from_date), str(r.to_date), r.from_value, r.delta) for r in changes.collect())
    assert got == [("a", "2024-01-01", "2024-01-03", 5, 94), ("a", "2024-01-03", "2024-01-05", 99, -89), ("a", "2024-01-05", "2024-01-09", 10, -6), ("b", "2023-12-31", "2024-01-02", 100, -99), ("b", "2024-01-02", "2024-01-04", 1, 0)]
    assert ids.count() == ids.select("acq_date").distinct().count() == 7


def test_dates_that_cannot_change_any_more_leave_the_state(spark, tmp_path):
    """What lies behind the watermark is dropped when it comes, and of the dates there only the last stays to compare with."""
    batches = [[("2024-01-01", 1), ("2024-01-02", 2)], [("2024-03-01", 5)], [("2024-03-02", 7)], [("2024-01-02", 100), ("2024-03-03", 9)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([("a", d, n) for d, n in rows], "aoi string, day string, pixels long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("aoi string, day string, pixels long").parquet(f"{tmp_path}/in/*").select("aoi", F.col("day").cast("date").alias("acq_date"), "pixels")
        with change.rocks(spark):
            changes = running.run_once(change.running_change(stream, "aoi", late="10 days"), f"{tmp_path}/change", "update", lambda out: change.newest(out, "aoi"))
    got = sorted((str(r.from_date), str(r.to_date), r.delta) for r in changes.collect())
    assert got == [("2024-01-01", "2024-01-02", 1), ("2024-01-02", "2024-03-01", 3), ("2024-03-01", "2024-03-02", 2), ("2024-03-02", "2024-03-03", 2)]


def test_registered_queries_equal_their_sql(spark):
    import duckdb

    from rasterspark.plans import further

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "nation", "region", "events", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    for name in ("preprocessed_bands", "label_statistics", "filled_holes", "coloured_masks", "early_stops", "split_metrics", "manifest_csv", "stream_change"):
        run, sql = further.REGISTERED[name]
        got, want = run(spark, folder), con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        plain = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        one = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
        assert one == sorted((tuple(map(plain, r)) for r in want.select(", ".join(columns)).fetchall()), key=str), name
