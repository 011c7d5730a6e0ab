"""Scenes in tiles against the uncut grid; manifests as logs; documents of many tasks."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.operators import assembly, augment, catalog, cleaning, composite, regions, wide
from rasterspark.sources import commitlog, documents, files, layout, manifests

SCHEMA = "scene_id string, row long, col long, class_id int, confidence double"


def scene(spark, grid, name="s", missing=()):
    rows = [(name, r, c, None if grid[r, c] < 0 else int(grid[r, c]), float(r + c) / 100) for r in range(grid.shape[0]) for c in range(grid.shape[1]) if (r, c) not in missing]
    return spark.createDataFrame(rows, SCHEMA)


def random_grid(seed, shape=(23, 31), classes=3):
    rng = np.random.default_rng(seed)
    return np.where(rng.random(shape) < 0.03, -1, rng.integers(0, classes, shape))


def spiral(n=21):
    """One region that winds through every tile."""
    grid, r, c, dr, dc = np.zeros((n, n), int), 0, 0, 0, 1
    grid[0, 0] = 1
    while True:
        for _ in range(2):
            far = (r + 2 * dr, c + 2 * dc)
            if 0 <= r + dr < n and 0 <= c + dc < n and not grid[r + dr, c + dc] and not (0 <= far[0] < n and 0 <= far[1] < n and grid[far]):
                break
            dr, dc = dc, -dr
        else:
            return grid
        r, c = r + dr, c + dc
        grid[r, c] = 1


@pytest.mark.parametrize("case", ["random", "spiral", "full", "corners"])
def test_regions_of_tiles_are_those_of_the_uncut_grid(spark, case):
    grid = {"random": random_grid(1), "spiral": spiral(), "full": np.ones((17, 19), int), "corners": 2 * np.eye(20, dtype=int)}[case]
    cells = scene(spark, grid)
    whole = regions.label(cells.withColumnsRenamed({"row": "r", "col": "c", "scene_id": "patch_id"}))
    want = regions.regions(whole, "patch_id", least=2).drop("region_id").withColumnRenamed("patch_id", "scene_id")
    found = wide.regions(cells, tile=6, least=2)
    firsts = {(r.class_id, r.region_id) for r in found.collect()}
    assert all(grid[k // wide.WIDE, k % wide.WIDE] == c for c, k in firsts)
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(want.columns)).collect())
    assert plain(found) == plain(want)
    assert (case != "spiral" or found.count() == 1) and (case != "corners" or found.count() == 1)


def test_regions_of_several_scenes_and_of_none(spark):
    cells = scene(spark, np.ones((9, 9), int), "a").unionByName(scene(spark, np.ones((5, 5), int), "b")).unionByName(spark.createDataFrame([(None, 0, 0, 1, 0.1), ("a", None, 0, 1, 0.1), ("b", 0, None, 1, 0.1)], SCHEMA))
    assert {(r.scene_id, r.area_px) for r in wide.regions(cells, tile=4).collect()} == {("a", 81), ("b", 25)}
    assert wide.regions(cells.where("class_id > 5"), tile=4).count() == 0


STEPS = {
    "kernels": cleaning.Cleaning(opening=1, closing=2),
    "sizes": cleaning.Cleaning(opening=0, closing=0, least_object=4, least_hole=3),
    "overrides": cleaning.Cleaning(opening=1, closing=0, overrides={2: cleaning.Cleaning(opening=0, closing=1, least_hole=5)}),
    "majority": cleaning.majority(3), "wide majority": cleaning.majority(4), "small": cleaning.replace_small(5), "open": cleaning.square_pass("open"), "close": cleaning.square_pass("close", 4),
}


@pytest.mark.parametrize("name", STEPS)
def test_cleaning_in_tiles_is_cleaning_of_the_whole(spark, name):
    grid = random_grid(7, (41, 37))
    grid[10:30, 8:25] = np.where(np.random.default_rng(2).random((20, 17)) < 0.9, 1, grid[10:30, 8:25])
    cells = scene(spark, grid)
    want = STEPS[name](grid.copy())
    done = wide.clean(cells, STEPS[name], classes=3, tile=9)
    assert done.count() == grid.size and done.columns == cells.columns
    wrong = [r for r in done.collect() if r.class_id != (None if grid[r.row, r.col] < 0 else want[r.row, r.col])]
    assert wrong == []


def test_a_chain_of_steps_and_rows_without_place(spark):
    grid = random_grid(3, (20, 20))
    lost = spark.createDataFrame([("s", None, 1, 2, 0.5)], SCHEMA)
    done = wide.clean(scene(spark, grid).unionByName(lost), cleaning.majority(3), cleaning.replace_small(3), tile=7)
    want = cleaning.replace_small(3)(cleaning.majority(3)(grid.copy()))
    assert all(r.class_id == (2 if r.row is None else None if grid[r.row, r.col] < 0 else want[r.row, r.col]) for r in done.collect())
    with pytest.raises(ValueError, match="reach"):
        wide.clean(lost, cleaning.fill_holes)


def test_holes_of_any_size(spark):
    grid = random_grid(4, (26, 26))
    grid[2:22, 2:22] = 1
    grid[4:20, 4:20] = 2
    grid[6:18, 6:18] = 0
    want = cleaning.fill_holes(grid)
    done = wide.fill_holes(scene(spark, grid), classes=(0, 1, 2), tile=5)
    assert done.count() == grid.size
    assert all(r.class_id == (None if grid[r.row, r.col] < 0 else want[r.row, r.col]) for r in done.collect())
    assert want[10, 10] == 2


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.range(60).selectExpr("id a", "id + 1 b")
    assert {r.root for r in wide.components(chain).collect()} == {0} and wide.components(chain).count() == 61
    assert wide.components(chain.where("a > 99")).count() == 0


# Manifests as logs


def keyed(spark, *keys):
    return spark.createDataFrame([(k, k.upper()) for k in keys], "patch_id string, told string")


def test_a_failing_read_loses_nothing(spark, tmp_path):
    log = commitlog.ManifestLog(spark, f"{tmp_path}/m", "patch_id")
    assert log.snapshot() is None and log.append_new(keyed(spark, "a", "b", "b")) == 1
    assert log.append_new(keyed(spark, "b", "c")) == 1
    data = sorted((tmp_path / "m" / "data").glob(f"{log.commits()[0]['data']}/part*"))[0]
    held = data.read_bytes()
    data.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        log.append_new(keyed(spark, "z"))
    data.write_bytes(held)
    for crc in (tmp_path / "m").rglob(".*.crc"):
        crc.unlink()
    assert sorted(r.patch_id for r in log.snapshot().collect()) == ["a", "b", "c"] and len(log.commits()) == 2
    assert sorted(r.patch_id for r in log.snapshot(1).collect()) == ["a", "b"]


def test_two_writers_lose_nothing_and_add_nothing_twice(spark, tmp_path):
    one, two = (commitlog.ManifestLog(spark, f"{tmp_path}/m", "patch_id") for _ in range(2))
    one.append_new(keyed(spark, "a"))
    commit, calls = two._commit, []

    def late(version, name, n_rows):
        if not calls:
            calls.append(one.append_new(keyed(spark, "b", "c")))
        return commit(version, name, n_rows)

    two._commit = late
    assert two.append_new(keyed(spark, "a", "c", "d")) == 2
    assert sorted(r.patch_id for r in two.snapshot().collect()) == ["a", "b", "c", "d"]
    assert [c["version"] for c in two.commits()] == [1, 2, 3] and [c["n_rows"] for c in two.commits()] == [1, 2, 1]


def test_a_number_is_given_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assert commitlog.put_if_absent(spark, f"{tmp_path}/log/1.json", "first") and not commitlog.put_if_absent(spark, f"{tmp_path}/log/1.json", "second")
    assert (tmp_path / "log" / "1.json").read_text() == "first"


# Documents


def text_of(path) -> str:
    return "".join(p.read_text() for p in sorted(path.iterdir()) if not p.name.startswith((".", "_")))


def test_a_document_of_many_tasks_is_one_text(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('a,\"', id, '\\n') END AS name").repartition(7)
    documents.write(rows, f"{tmp_path}/d", "1.1")
    told = json.loads(text_of(tmp_path / "d"))
    assert (told["version"], told["entry_count"], len(told["entries"])) == ("1.1", 20_000, 20_000)
    back = documents.read(spark, f"{tmp_path}/d", rows.schema)
    assert documents.head(spark, f"{tmp_path}/d") == {"version": "1.1", "entry_count": 20_000}
    assert back.exceptAll(rows).count() == 0 and back.count() == 20_000
    with pytest.raises(ValueError, match="there already"):
        documents.write(rows, f"{tmp_path}/d")


def test_documents_without_rows_and_with_empty_tasks(spark, tmp_path):
    rows = spark.range(100).where("id = 42 OR id = 7").repartition(20)
    documents.write(rows, f"{tmp_path}/few")
    assert sorted(e["id"] for e in json.loads(text_of(tmp_path / "few"))["entries"]) == [7, 42]
    documents.write(rows.where("id < 0"), f"{tmp_path}/none")
    assert json.loads(text_of(tmp_path / "none")) == {"version": "1.0", "entry_count": 0, "entries": []}
    manifests.write_json(rows, f"{tmp_path}/m")
    assert manifests.read_json(spark, f"{tmp_path}/m", rows.schema).count() == 2


def test_a_failing_task_leaves_no_document(spark, tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        documents.write(spark.range(50).selectExpr("IF(id = 30, raise_error('no'), id) AS x"), f"{tmp_path}/d")
    assert not documents.is_document(spark, f"{tmp_path}/d")


# Layout, boxes, files, products, draws


def test_curve_ranges_cover_the_window_and_little_else():
    rng = np.random.default_rng(5)
    place = lambda r, c: sum(((int(r) >> k & 1) << (2 * k + 1)) | ((int(c) >> k & 1) << (2 * k)) for k in range(12))
    for _ in range(40):
        r, c = np.sort(rng.integers(0, 300, 2)), np.sort(rng.integers(0, 300, 2))
        for most in (1, 8, 32):
            spans = layout.ranges(int(r[0]), int(r[1]) + 1, int(c[0]), int(c[1]) + 1, most)
            assert 0 < len(spans) <= most and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
            for _ in range(20):
                z = place(rng.integers(r[0], r[1] + 1), rng.integers(c[0], c[1] + 1))
                assert any(low <= z <= high for low, high in spans)
        assert sum(h - low + 1 for low, h in layout.ranges(int(r[0]), int(r[1]) + 1, int(c[0]), int(c[1]) + 1)) < 8 * (r[1] - r[0] + 8) * (c[1] - c[0] + 8)
    assert layout.ranges(5, 5, 0, 9) == []


def test_windows_read_few_files_by_pushed_ranges(spark, tmp_path):
    pixels = spark.range(256 * 256).selectExpr("id DIV 256 AS row", "id % 256 AS col", "id AS v")
    layout.write(pixels, f"{tmp_path}/z", rows_a_file=1 << 12, zone=5)
    found = layout.read(spark, f"{tmp_path}/z", 70, 90, 33, 60, zone=5)
    assert found.count() == 20 * 27 and {(r.row, r.col) for r in found.collect()} == {(r, c) for r in range(70, 90) for c in range(33, 60)}
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = layout.read(spark, f"{tmp_path}/z", 70, 90, 33, 60, zone=5)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    folders, pushed = plan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "zone" in folders and "GreaterThanOrEqual(z," in pushed and "LessThanOrEqual(z," in pushed
    read = lambda df: df.selectExpr("input_file_name() AS f").distinct().count()
    small, whole = read(found), read(spark.read.parquet(f"{tmp_path}/z"))
    assert whole >= 16 and small <= whole / 8
    with pytest.raises(Exception, match="outside the grid"):
        layout.write(pixels.selectExpr("row - 1 AS row", "col"), f"{tmp_path}/bad")


def test_boxes_of_any_size_meet_as_all_pairs_do(spark):
    rng = np.random.default_rng(6)

    def boxes(n, name):
        out = []
        for k in range(n):
            side = float(rng.choice([0, 0.003, 0.5, 4, 45, 180, 359]))
            x, y = float(rng.integers(-180, 180)), float(rng.integers(-90, 90))
            out.append((k, x, x + side, y, y + float(rng.choice([0.0, side / 2]))))
        out.append((n, None, None, None, None))
        return out, spark.createDataFrame(out, f"{name} long, min_lon double, max_lon double, min_lat double, max_lat double")

    (a, scenes), (b, areas) = boxes(300, "s"), boxes(120, "a")
    want = sorted((p[0], q[0]) for p in a for q in b if None not in p + q and p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3])
    pairs = catalog.touching(scenes, areas)
    assert sorted((r.scene.s, r.area.a) for r in pairs.collect()) == want and len(want) > 1000
    assert catalog.touching(scenes.where("s < 0"), areas).count() == 0


def test_boxes_are_counted_without_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(catalog, "touching", None)  # no pair is made
    monkeypatch.setattr(catalog, "CUTS", 4)
    rng = np.random.default_rng(8)

    def boxes(n, name, step):
        low, side = rng.integers(-40, 40, (n, 2)) / step, rng.choice([0.0, 0.25, 3.0, 60.0], (n, 2))
        out = [(k, *map(float, (x, x + w, y, y + h))) for k, ((x, y), (w, h)) in enumerate(zip(low, side, strict=True))]
        out += [(n + k, *box) for k, box in enumerate([(0.0, 9.0, 0.0, 9.0)] * 40 + [(None, 1.0, 1.0, 2.0), (5.0, 4.0, 0.0, 1.0), (1e9, 2e9, 0.0, 1.0)])]
        return out, spark.createDataFrame(out, f"{name} long, min_lon double, max_lon double, min_lat double, max_lat double")

    (a, scenes), (b, areas) = boxes(300, "s", 4), boxes(150, "a", 2.5)
    good = lambda rows: [p for p in rows if p[1] is not None and p[1] <= p[2]]
    met = {q[0]: [p[0] for p in good(a) if p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3]] for q in good(b)}
    got = catalog.touch_counts(scenes, areas, ("s",)).select("a", "n_scenes", "sum_s").collect()
    assert sorted(map(tuple, got)) == sorted((k, len(v), sum(v)) for k, v in met.items() if v) and 0 < len(got) < len(b)
    assert catalog.touch_counts(scenes.where("s < 0"), areas).count() == catalog.touch_counts(scenes, areas.where("a < 0")).count() == 0


def test_files_of_a_folder_against_what_is_expected(spark, tmp_path):
    for name, text in (("a/1.bin", b"MAGIC rest"), ("a/b/2.bin", b""), ("a/3.bin", b"MA"), ("4.bin", b"other kind"), ("5.txt", b"x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    found = files.headers(spark, str(tmp_path), "*.bin", n_bytes=5).withColumn("name", files.name_of(F.col("path")))
    expected = spark.createDataFrame([(f"{k}.bin", 5, b"MAGIC") for k in (1, 2, 3, 4, 9)], "name string, least int, head binary")
    assert {tuple(r) for r in files.file_issues(found, expected).collect()} == {("2.bin", "empty"), ("3.bin", "short"), ("4.bin", "other kind"), ("9.bin", "missing")}
    listed = files.listing(spark, str(tmp_path)).withColumn("name", files.name_of(F.col("path")))
    assert {tuple(r) for r in files.file_issues(listed, expected.select("name")).collect()} == {("2.bin", "empty"), ("9.bin", "missing"), ("5.txt", "unexpected")}


def test_folders_are_listed_and_written_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "inputFiles", None)  # no list of files in the driver
    rows = spark.range(300).selectExpr("concat('of=', id % 7, '/scene=', id, '/m.', if(id % 3 = 0, 'json', 'txt')) AS path", "if(id = 0, '', repeat('ä', cast(id AS int))) AS value")
    for _ in range(2):  # written again: the same files
        assert files.write_each(rows, f"file://{tmp_path}") == 300
    for name in (".hidden", "_SUCCESS", "of=1/_x=1/a.json", "top.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == 304
    sizes = {r.path: r.length for r in files.listing(spark, str(tmp_path)).collect()}
    assert len(sizes) == 302 and sizes[f"file:{tmp_path}/of=2/scene=9/m.json"] == 18 and sizes[f"file:{tmp_path}/of=0/scene=0/m.json"] == 0
    assert files.listing(spark, str(tmp_path), "*.json").count() == 101 and files.listing(spark, str(tmp_path), "?.{txt,cs*}").count() == 200
    heads = {r.path: r.head for r in files.headers(spark, str(tmp_path), "m.json", n_bytes=3, most=100).collect()}
    assert heads[f"file:{tmp_path}/of=2/scene=9/m.json"] == "ä".encode() + b"\xc3" and heads[f"file:{tmp_path}/of=0/scene=0/m.json"] is None
    assert sum(h is None for h in heads.values()) == 1 + sum(2 * k > 100 for k in range(0, 300, 3))


def test_scenes_keep_their_reference(spark, tmp_path):
    pixels = spark.range(12).selectExpr("id % 2 AS scene_id", "id DIV 6 AS row", "id DIV 2 % 3 AS col", "IF(id = 0, NULL, id * 1.0D) AS Blue")
    scenes = spark.createDataFrame([(0, "EPSG:1", (2.0, 0.0, 100.0, 0.0, -2.0, 50.0)), (1, None, None)], "scene_id long, crs string, transform struct<a: double, b: double, c: double, d: double, e: double, f: double>")
    with pytest.raises(ValueError, match="without reference"):
        manifests.write_scenes(pixels, scenes, f"{tmp_path}/bad", ("Blue",))
    manifests.write_scenes(pixels.where("scene_id = 0"), scenes, f"{tmp_path}/ok", ("Blue",))
    head = spark.read.parquet(f"{tmp_path}/ok/headers").first()
    assert (head.crs, head.width, head.height, head.band_names, round(head.valid_shares[0], 4), head.transform.e) == ("EPSG:1", 3, 2, ["Blue"], 0.8333, -2.0)
    at = {(r.r, r.c): (r.x, r.y) for r in manifests.read_scenes(spark, f"{tmp_path}/ok").collect()}
    assert at[0, 0] == (101.0, 49.0) and at[1, 2] == (105.0, 47.0) and len(at) == 6


def test_draws_over_many_ranges_and_a_heavy_sample(spark):
    """One sample holds half of all weight; ranges and slots are small, and the draws are those of one line over all."""
    rows = [(k, 1.0 + k % 3) for k in range(300)] + [(1000, 599.0), (5, 2.0), (7, None), (8, -1.0), (9, 0.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "sample_id int, weight double").repartition(3)
    small = augment.weighted_draws(df, 4000, per_slot=50, per_task=40).collect()
    assert sorted(small) == sorted(augment.weighted_draws(df, 4000, per_slot=10**6, per_task=10**6).collect())
    assert sorted(r.draw for r in small) == list(range(4000))
    held = {}
    for k, w in rows:
        if k is not None and w and w > 0:
            held[k] = held.get(k, 0) + w
    line, total, at = sorted(held), sum(held.values()), {r.draw: r.sample_id for r in small}
    ends = np.cumsum([held[k] for k in line]) / total
    digest = lambda k: int(hashlib.md5(f"42|{k}".encode()).hexdigest()[:13], 16) / (1 << 52)
    assert all(at[k] == line[int(np.searchsorted(ends, digest(k), side="right"))] for k in range(4000))


def test_pyramid_levels_are_averages_of_the_base(spark):
    rng = np.random.default_rng(8)
    grid = np.where(rng.random((37, 29)) < 0.2, np.nan, rng.random((37, 29)))
    rows = [(1, r, c, None if np.isnan(grid[r, c]) else float(grid[r, c])) for r in range(37) for c in range(29)]
    found = composite.pyramid(spark.createDataFrame(rows, "aoi_id int, row long, col long, b double"), (2, 4, 8, 32), ("b",))
    for r in found.collect():
        block = grid[r.row * r.factor : (r.row + 1) * r.factor, r.col * r.factor : (r.col + 1) * r.factor]
        assert (r.b is None and np.isnan(block).all()) or abs(r.b - np.nanmean(block)) < 1e-12
    assert found.groupBy("factor").count().count() == 4
    with pytest.raises(ValueError, match="multiple"):
        composite.pyramid(spark.createDataFrame(rows, "aoi_id int, row long, col long, b double"), (2, 3), ("b",))


def test_areas_are_united_but_for_failed_ones(spark):
    patches = spark.createDataFrame([(1, 0.5)], "patch_id int, valid_ratio double")
    told = spark.createDataFrame([(1,)], "patch_id int")
    held, seen, first = assembly.united([assembly.AreaResult("b", patches, told), assembly.AreaResult("a", patches.drop("valid_ratio"))])
    assert sorted((r.patch_id, r.aoi_id, r.valid_ratio) for r in held.collect()) == [("a/1", "a", None), ("b/1", "b", 0.5)]
    assert [r.patch_id for r in seen.collect()] == ["b/1"] and first == "b"
    assert assembly.united([assembly.AreaResult("a")]) == (None, None, "a")
    with pytest.raises(RuntimeError, match="area a: no imagery"):
        assembly.united([assembly.AreaResult("b", patches), assembly.AreaResult("a", failed="no imagery")])
    with pytest.raises(ValueError):
        assembly.united([])


def test_what_an_application_keeps_goes_with_close(spark):
    held = manifests.kept(spark.range(5), "numbers")
    assert held.count() == 5 and f"/rasterspark-{spark.sparkContext.applicationId}/numbers-" in held.inputFiles()[0]
    manifests.close(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.schema("id long").parquet(held.inputFiles()[0]).count()
