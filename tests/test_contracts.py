"""Contracts, manifests, coverage, vector shapes, sinks and the evaluation on small literal tables."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from gridforge.functions import evaluation as E
from gridforge.functions import metrics as M
from gridforge.operators import contracts as C
from gridforge.operators import coverage as G
from gridforge.operators import manifests as X
from gridforge.operators import vector as V
from gridforge.operators.grid import GridSpec
from gridforge.sources import config, sinks


def release(spark, **changed):
    rows = [(1, 2000, 2005, 1, 0), (2, 2000, 2005, 0, 0), (1, 2005, 2010, 0, 0)]
    cell_time = spark.createDataFrame(changed.get("cells", rows), "cell_id long, forecast_origin int, target_year int, target int, built_state int")
    demand = spark.createDataFrame(changed.get("demand", [(2000, 2005, 2, 1, 0.09), (2005, 2010, 1, 0, 0.0)]), "period_start int, period_end int, eligible_nonbuilt_cells long, new_built_cells long, observed_new_built_area_ha double")
    tracks = [(e, 100.0, 0.1, 3, 1.0) for e in (2000, 2005, 2010)]
    metrics = spark.createDataFrame(changed.get("metrics", tracks), "epoch int, tracking_support_area_ha double, pba double, nump long, mps_ha double")
    return cell_time, demand, metrics, [2000, 2005, 2010], ["cell_id", "target"]


def test_final_tables(spark):
    C.validate_final_tables(*release(spark))
    for name, rows in (("cells", [(1, 2000, 2005, 1, 0), (1, 2000, 2005, 1, 0), (1, 2005, 2010, 0, 0)]), ("cells", [(1, 2000, 2006, 1, 0), (2, 2000, 2005, 0, 0), (1, 2005, 2010, 0, 0)]), ("cells", [(1, 2000, 2005, 2, 0), (2, 2000, 2005, 0, 0), (1, 2005, 2010, 0, 0)]), ("cells", [(1, 2000, 2005, 1, 0), (2, 2000, 2005, 0, 1), (1, 2005, 2010, 0, 0)]), ("cells", [(1, 2000, 2005, 1, 0), (2, 2000, 2005, 0, 0)]), ("demand", [(2000, 2005, 2, 1, 0.18), (2005, 2010, 1, 0, 0.0)]), ("demand", [(2000, 2005, 2, 0, 0.0), (2005, 2010, 1, 0, 0.0)]), ("metrics", [(2000, 100.0, 1.2, 3, 1.0), (2005, 100.0, 0.1, 3, 1.0), (2010, 100.0, 0.1, 3, 1.0)]), ("metrics", [(2000, 99.0, 0.2, 3, 1.0), (2005, 100.0, 0.1, 3, 1.0), (2010, 100.0, 0.1, 3, 1.0)])):
        with pytest.raises(ValueError):
            C.validate_final_tables(*release(spark, **{name: rows}))
    with pytest.raises(ValueError, match="lacks"):
        C.validate_final_tables(*release(spark)[:4], ["cell_id", "other"])


def test_schema_and_reference():
    wanted = StructType([StructField("a", StringType()), StructField("b", DateType())])

    class Frame:
        schema = StructType([StructField("a", StringType()), StructField("b", StringType())])

    assert C.schema_faults(Frame, wanted) == ["('b', 'date') wanted, ('b', 'string') there"]
    assert C.reference_faults({"t": [30.0, 0, 1.0 + 1e-12], "n": 2, "crs": "a"}, {"t": [30, 0, 1.0], "n": 3, "crs": "a", "x": 1}) == ["n", "x"]


def test_manifests(spark):
    m = spark.createDataFrame([("state", 2000, None, None, "s0"), ("state", 2005, None, None, "s5"), ("transition", None, 2000, 2005, "t"), ("tracking_support", None, None, None, "u")], "product_type string, epoch int, period_start int, period_end int, asset_id string")
    assert X.asset_map(m) == ({2000: "s0", 2005: "s5"}, {(2000, 2005): "t"}, "u")
    with pytest.raises(ValueError):
        X.asset_map(m.filter("product_type <> 'tracking_support'"))
    assert X.one_row(m.withColumn("state", F.lit("exists")), "state", 2005)["asset_id"] == "s5"
    with pytest.raises(ValueError):
        X.one_row(m.withColumn("state", F.lit("failed")), "state", 2005)
    assert X.sensor_policy({"2000": {"primary": ["LT05"]}}, 2000) == {"primary": ["LT05"], "supplemental": [], "diagnostic_only": []}
    assert {tuple(r) for r in X.policy_frame(spark, {2000: {"primary": ["a"], "diagnostic_only": ["b"]}}, [2000]).collect()} == {(2000, "a", "primary"), (2000, "b", "diagnostic_only")}
    w = {r.window_name: (str(r.window_start), str(r.window_end)) for r in X.windows_frame(spark, [2005], [3], True).collect()}
    assert len(w) == 12 and w["Dec-Feb_3m"] == ("2004-12-01", "2005-03-01") and w["Jan-Mar_3m"] == ("2005-01-01", "2005-04-01")
    assert X.windows_frame(spark, [2005], [3], False).count() == 10
    scenes = spark.createDataFrame([(2005, "a", "2005-01-01", True), (2005, "a", "2005-04-01", True), (2005, "b", "2005-02-01", True), (2005, "a", "2005-02-01", False)], "epoch int, sensor string, acquired string, has_coverage boolean").withColumn("acquired", F.col("acquired").cast("date"))
    chosen = spark.createDataFrame([(2005, "w", "m", "a, c", "2005-01-01", "2005-04-01", "PASS")], "epoch int, window_name string, sensor_mode string, sensor_keys string, window_start string, window_end string, selection_status string").withColumns({c: F.col(c).cast("date") for c in ("window_start", "window_end")})
    assert [str(r.acquired) for r in X.exact_scenes(scenes, chosen).collect()] == ["2005-01-01"]
    with pytest.raises(ValueError):
        X.exact_scenes(scenes.filter("sensor = 'b'"), chosen)
    repeated = spark.createDataFrame([(1, "candidates"), (1, "candidates")], "epoch int, product_type string").withColumns({"state": F.lit("PASS"), "band_names": F.lit("x")})
    with pytest.raises(ValueError):
        X.candidate_epochs(repeated, ["x"])


def test_coverage(spark):
    quality = spark.createDataFrame([(2000, 0.9), (2000, 0.8), (2005, 0.5)], "epoch int, valid_fraction_core double")
    areas = spark.createDataFrame([(2010, 10.0), (2010, 30.0), (2000, 1.0)], "epoch int, valid_area_ha double")
    got = {r.epoch: (round(r.core_coverage_pct, 9), r.coverage_source) for r in G.coverage_table(quality, areas, 40.0, [2000, 2005, 2010]).collect()}
    assert got == {2000: (90.0, "valid_fraction_core"), 2005: (50.0, "valid_fraction_core"), 2010: (50.0, "candidate_valid_area_over_core_area")}
    with pytest.raises(Exception, match="no coverage"):
        G.coverage_table(quality, areas, 40.0, [2000, 2015]).collect()
    values = spark.createDataFrame([(0.5, 0.5, 50.0)], "x_fraction double, covered double, covered_pct double")
    assert tuple(values.select(G.percentage("x_fraction"), G.percentage("covered"), G.percentage("covered_pct")).first()) == (50.0, 50.0, 50.0)
    many = spark.createDataFrame([(e, 50.0 + e - 2000) for e in range(2000, 2010)], "epoch int, core_coverage_pct double")
    got = {r.epoch: r.quality_flag for r in G.anchor_epochs(many, 51.0, 56.0, 3).collect()}
    assert got == {2001: "WARN", 2005: "WARN", 2009: "PASS"}


def test_epoch_samples(spark):
    rng = np.random.default_rng(2)
    cells = [(2000, k, float(k % 40) * 30, float(k // 40) * 30, int(a), int(b), 1, int(rng.random() < 0.95)) for k, (a, b) in enumerate(rng.integers(0, 2, (1600, 2)))]
    df = spark.createDataFrame(cells, "epoch int, cell_id long, x_m double, y_m double, built_a int, built_b int, valid_a int, valid_b int")
    targets = {"unanimous_nonbuilt": 7, "disagreement": 9, "unanimous_built": 2}
    got = G.sample_epoch(df, ["a", "b"], targets, 42, 90.0).toPandas()
    assert got.groupby("stratum_name").size().to_dict() == targets and got.sample_id.is_unique and got.sample_id.str.match(r"^2000_\d{9}$").all()
    valid = [c for c in cells if c[6] == c[7] == 1]
    for name, part in got.groupby("stratum_name"):
        votes = {"unanimous_nonbuilt": 0, "disagreement": 1, "unanimous_built": 2}[name]
        population = sum(c[4] + c[5] == votes for c in valid)
        assert (part.population == population).all() and np.allclose(part.sample_weight, population / targets[name])
        places = part[["x_m", "y_m"]].to_numpy()
        gaps = [math.dist(a, b) for i, a in enumerate(places) for b in places[:i]]
        assert not gaps or min(gaps) >= part.used_distance_m.iloc[0]


def test_shapes(spark):
    square = V.Shape.of([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6)])
    assert square.area() == 96 and square.bounds() == (0, 0, 10, 10) and square.faults() == []
    assert square.contains(np.array([5.0, 1.0, 11.0]), np.array([5.0, 1.0, 1.0])).tolist() == [False, True, False]
    assert np.allclose(square.distance(np.array([13.0, 1.0]), np.array([14.0, 1.0])), [5.0, 0.0])
    bow = V.Shape.of([(0, 0), (2, 2), (2, 0), (0, 2)])
    assert bow.faults() == ["ring 0 crosses itself"] and V.valid_shape(bow).faults() == [] and V.valid_shape(bow).area() == pytest.approx(2.0)
    assert V.valid_shape(None) is None and V.valid_shape(V.Shape(())) == V.Shape(())
    assert set(V.Shape.of([(0, 0), (4, 0), (1, 1), (0, 4)]).hull().rings[0]) == {(0, 0), (4, 0), (0, 4)}
    assert V.Shape.from_geojson(square.to_geojson()) == square
    with pytest.raises(ValueError):
        V.area_ha([])
    units = [({"name": "Yaoundé I", "pcode": "C1", "adm": "Mfoundi"}, square), ({"name": "Other", "pcode": "C2", "adm": "X"}, square)]
    assert V.select_units(units, ["yaounde i"], parent=("adm", "MFOUNDI")) == units[:1] and V.select_units(units, [], ["C2"]) == units[1:]
    for bad in (lambda: V.select_units(units, ["nowhere"]), lambda: V.select_units(units, ["Other"], parent=("adm", "Mfoundi"))):
        with pytest.raises(ValueError):
            bad()
    profile = V.layer_profile([*units, ({"name": "Yaoundé II"}, None), ({}, bow)], "YAOUNDE")
    assert (profile["null"], profile["invalid"], profile["duplicates"], profile["names"]) == (1, 1, 1, ["Yaoundé I", "Yaoundé II"])
    grid = GridSpec(1.0, 20, 20, -5.0, 15.0)
    cells = V.core_and_buffer(spark, grid, [square], 2.0).toPandas()
    assert cells.in_core.sum() == 96
    near = [(x, y) for x in np.arange(-4.5, 15) for y in np.arange(-4.5, 15) if math.hypot(max(-x, 0, x - 10), max(-y, 0, y - 10)) <= 2]
    assert len(cells) == len(near)
    same = V.compare_shapes(spark, grid, [square], [V.Shape.of([(0, 0), (10, 0), (10, 10), (0, 10)])], 1e-3)
    assert same["difference_ha"] == pytest.approx(4 / 10_000) and same["within_tolerance"]
    assert V.buffered_extent(square, 5.0, 4.0, (1.0, 0.0)) == (-7.0, -8.0, 17.0, 16.0)
    assert V.grid_rectangle(grid, 0.25).bounds() == (-4.75, -4.75, 14.75, 14.75)
    with pytest.raises(ValueError):
        V.filter_classes(spark.range(1), "class", ["a"])


def test_config_and_sinks(spark, tmp_path):
    sinks.write_yaml(tmp_path / "c.yaml", {"dataset": {"path": "x"}, "folds": [1], "model": "m", "final_test": {"evaluate": False}})
    assert config.load_experiment_config(str(tmp_path / "c.yaml"), "m")["folds"] == [1]
    sinks.write_yaml(tmp_path / "d.yaml", {"dataset": 1, "folds": 2, "final_test": {"evaluate": True}})
    for path, sections in (("d.yaml", None), ("c.yaml", ["missing"])):
        with pytest.raises(ValueError):
            config.load_experiment_config(str(tmp_path / path)) if sections is None else config.load_yaml(str(tmp_path / path), sections)
    sinks.write_yaml(tmp_path / "l.yaml", [1])
    with pytest.raises(ValueError):
        config.load_yaml(str(tmp_path / "l.yaml"))
    sinks.write_json(tmp_path / "g.json", {"crs": "EPSG:32632", "resolution_m": 30, "transform": [30, 0, 762570, 0, -30, 444150], "width": 946, "height": 1278})
    assert config.load_grid(str(tmp_path / "g.json")) == GridSpec(30.0, 946, 1278, 762570.0, 444150.0)
    sinks.write_json(tmp_path / "h.json", {"crs": "x", "resolution_m": 30, "transform": [30, 0, 1], "width": 1, "height": 1})
    with pytest.raises(ValueError):
        config.load_grid(str(tmp_path / "h.json"))
    square = V.Shape.of([(0, 0), (1, 0), (1, 2), (0, 2)])
    sinks.write_shapes(tmp_path / "s.json", [({"n": 1}, square)], "EPSG:4326")
    assert config.load_shapes(str(tmp_path / "s.json"), one=True) == [({"n": 1}, square)] and config.query_rectangle(str(tmp_path / "s.json")) == (0, 0, 1, 2)
    assert config.snapshot_date({"last-modified": "Wed, 01 Jan 2025 10:00:00 GMT"}) == "2025-01-01"
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "configs").mkdir()
    assert config.find_root(str(tmp_path / "a" / "b")) == tmp_path.resolve()
    seen = []
    step = lambda k: seen.append(k) or [(k, k * k)]
    assert sinks.resumable([1, 2], str(tmp_path / "run"), {"v": 1}, "a int, b int", step) == [(1, 1), (2, 4)]
    assert sinks.resumable([1, 2, 3], str(tmp_path / "run"), {"v": 1}, "a int, b int", step) == [(1, 1), (2, 4), (3, 9)] and seen == [1, 2, 3]
    with pytest.raises(ValueError):
        sinks.resumable([1], str(tmp_path / "run"), {"v": 2}, "a int, b int", step)
    samples = spark.createDataFrame([("b", 1, 0), ("a", 2, 1)], "sample_id string, x int, pred int")
    sinks.write_manual_template(samples, str(tmp_path / "m.csv"), ["sample_id", "x"])
    assert (tmp_path / "m.csv").read_text().split() == ["sample_id,x,manual_label", "a,2,", "b,1,"]
    sinks.write_manual_template(samples, str(tmp_path / "m.csv"), ["sample_id", "x"])
    (tmp_path / "m.csv").write_text("sample_id,x,manual_label\na,2,1\n")
    with pytest.raises(FileExistsError):
        sinks.write_manual_template(samples, str(tmp_path / "m.csv"), ["sample_id", "x"])
    (tmp_path / "p.csv").write_text("d,f,t\n2020-01-02,TRUE,x\nnonsense,no,\n")
    got = sinks.read_checkpoint(spark, str(tmp_path / "p.csv"), StructType([StructField("d", StringType()), StructField("f", StringType()), StructField("t", StringType())]), ("f",), ("d",)).collect()
    assert [(str(r.d), r.f) for r in got] == [("2020-01-02", True), ("None", False)]
    hashes = sinks.write_outputs(spark, str(tmp_path / "out"), {"t": samples, "u": samples.orderBy("x")}, {"p": 1}, {"c": 1})
    assert hashes["t"] == hashes["u"] and json.loads((tmp_path / "out" / "version.json").read_text())["tables"] == hashes
    sinks.write_report(tmp_path / "r.md", "Title", {"Table": samples.orderBy("x"), "Text": "words"})
    assert "| b | 1 | 0 |" in (tmp_path / "r.md").read_text()
    sinks.save_state(tmp_path / "m.npz", {"w": np.arange(3)}, {"v": 1})
    arrays, settings = sinks.load_state(tmp_path / "m.npz")
    assert arrays["w"].tolist() == [0, 1, 2] and settings == {"v": 1}
    assert {r.name: r.status for r in sinks.provenance({"a": str(tmp_path / "g.json"), "b": "/nowhere"}, spark).collect()} == {"a": "PASS", "b": "MISSING"}
    assert sinks.preflight({"a": lambda: True, "b": lambda: None}) == {"a": "PASS", "b": "PASS"}
    with pytest.raises(RuntimeError):
        sinks.preflight({"a": lambda: False})
    assert sinks.write_preflight(tmp_path / "pre.json", {"final_test": {"evaluate": False}}, samples, [{"fold": 1}])["rows"] == 2
    mask = spark.createDataFrame([(0, 1, 1), (1, 0, 0)], "row long, col long, core int")
    sinks.write_mask(mask, str(tmp_path / "mask"), "core")
    assert spark.read.parquet(str(tmp_path / "mask")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_mask(mask.withColumn("core", F.lit(2)), str(tmp_path / "mask2"), "core")


def test_evaluation_and_lines(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.4 + 1.7 * z)))).astype(int)
    p = 1 / (1 + np.exp(-z))
    rows = spark.createDataFrame([(int(a), float(b), int(k % 3)) for k, (a, b) in enumerate(zip(y, p, strict=True))], "y int, probability_raw double, fold int")
    got = E.evaluate({"a": rows, "b": rows.drop("fold")})
    folds = {(r.model, r.fold): r for r in got.folds.collect()}
    assert set(folds) == {("a", "0"), ("a", "1"), ("a", "2"), ("b", "all")}
    x = np.column_stack([np.ones(3000), z])
    w = np.array([0.0, 1.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x.T * (q * (1 - q))) @ x, x.T @ (y - q))
    assert folds["b", "all"].calibration_intercept == pytest.approx(w[0], abs=1e-7) and folds["b", "all"].calibration_slope == pytest.approx(w[1], abs=1e-7)
    summary = {r.model: r for r in got.summary.collect()}
    assert summary["a"].folds == 3 and summary["a"].coverage_folds == 2 and summary["b"].mean_coverage is None
    one = M.ranking(rows.select("y", F.col("probability_raw").alias("p")), []).first()
    order = np.argsort(-p)
    precision = np.cumsum(y[order]) / np.arange(1, 3001)
    assert one.average_precision == pytest.approx(float((precision * y[order]).sum() / y.sum()))
    with pytest.raises(ValueError):
        M.calibration_lines(spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double"), [])
