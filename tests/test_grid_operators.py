"""Literal fixtures and brute force for the grid, index, state, catalogue and metric operators."""

import math
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridforge.functions import metrics as M
from gridforge.functions import text as T
from gridforge.operators import catalog, features, grid, histogram, indices, qa, sampling, states, stencil
from gridforge.plans import queries
from gridforge.sources import tables
from gridforge.streaming.monthly import windowed_summary

GRID = grid.GridSpec(30.0, 946, 1278, 762570.0, 444150.0)


def test_indices(spark):
    names = "blue double, green double, red double, nir double, swir1 double, swir2 double"
    one, zero, negative, missing = indices.with_indices(spark.createDataFrame([(0.1, 0.2, 0.3, 0.5, 0.4, 0.45), (0.1, 0.2, 0.3, 0.5, -0.1, 0.45), (0.1, 0.2, -0.01, 0.5, 0.4, 0.45), (0.1, None, 0.3, 0.5, 0.4, 0.45)], names)).collect()
    want = {"savi": 0.23076923, "mndwi": -0.33333333, "ndbi": -0.11111111, "ibi": 0.36842105, "ibui": -0.00854701, "vbswir1_bi": 0.6, "ndbsui": 0.06442763}
    assert all(one[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())
    assert zero.vbswir1_bi is None and zero.ndbsui is None and negative.ndbsui is None and all(missing[k] is None for k in want)


def otsu(spark, rows):
    df = spark.createDataFrame([("x", float(m), c) for m, c in rows], "g string, bucket_mean double, bucket_count long")
    return histogram.otsu(df, ["g"]).first()


def test_otsu(spark):
    got = otsu(spark, zip([0, 1, 2, 8, 9, 10], [10, 20, 10, 10, 20, 10], strict=True))
    assert (got.status, got.threshold) == ("PASS", 5.0)
    assert otsu(spark, [(1, 0)]).status == "FAIL_NO_VALID_PIXELS"
    for rows in ([(1, 5)], [(1, 5), (1, 4)]):
        got = otsu(spark, rows)
        assert (got.status, got.threshold) == ("FAIL_DEGENERATE_HISTOGRAM", None)


def test_absorbing_state(spark):
    raw, valid = [[0, 1, 0], [1, 0, 0], [0, 0, 1]], [[1, 1, 1], [1, 0, 1], [1, 1, 1]]
    df = spark.createDataFrame([(e, c, raw[e][c], valid[e][c]) for e in range(3) for c in range(3)], "epoch int, cell int, raw int, valid int")
    got = {(r.epoch, r.cell): (-1 if r.final is None else r.final, r.corrected) for r in states.absorbing(df, ["cell"]).collect()}
    assert [[got[e, c][0] for c in range(3)] for e in range(3)] == [[0, 1, 0], [1, -1, 0], [1, 1, 1]]
    assert [[got[e, c][1] for c in range(3)] for e in range(3)] == [[0, 0, 0], [0, 0, 0], [1, 1, 0]]


def test_transitions(spark):
    start, end, ok = [0, 0, 1, 0], [1, 0, 1, 1], [1, 1, 1, 0]
    rows = [(0, c, start[c], ok[c], start[c], 0, 5) for c in range(4)] + [(5, c, end[c], 1, end[c], 0, 5) for c in range(4)] + [(0, 9, 0, 1, 0, 0, 5), (10, 9, 1, 1, 1, 0, 5)]
    df = spark.createDataFrame(rows, "epoch int, cell int, raw int, valid int, final int, corrected int, obs int")
    got = {r.cell: r for r in states.transitions(df, ["cell"], step=5).filter("epoch = 0").collect()}
    assert [got[c].common for c in range(4)] == [1, 1, 1, 0] and [got[c].eligible for c in range(4)] == [1, 1, 0, 0]
    assert [got[c].target for c in range(4)] == [1, 0, None, None] and got[9].common == 0


def test_demand_follows_released_cells(spark):
    cells = spark.createDataFrame([(2005, 2010, y) for y in (1, 0, 1)], "forecast_origin int, target_year int, target_transition_5y int")
    names = "period_start int, period_end int, eligible_nonbuilt_cells long, eligible_nonbuilt_area_ha double, new_built_cells long, observed_new_built_area_ha double, support double"
    got = states.synchronise_demand(spark.createDataFrame([(2005, 2010, 4, 0.36, 1, 0.09, 7.0)], names), cells).first()
    assert (got.eligible_nonbuilt_cells, got.new_built_cells, got.support) == (3, 2, 7.0)
    assert got.eligible_nonbuilt_area_ha == pytest.approx(0.27) and got.observed_new_built_area_ha == pytest.approx(0.18)
    with pytest.raises(Exception, match="no cells"):
        states.synchronise_demand(spark.createDataFrame([(1990, 1995, 4, 0.36, 1, 0.09, 7.0)], names), cells).collect()


def test_coordinate_repair(spark):
    broken = spark.createDataFrame([(328.5, 887.5, 1, 1, 1), (329.5, 887.5, 1, 1, 1)], "x_m double, y_m double, row long, col long, cell_id long")
    got = sorted(GRID.repair(broken).collect(), key=lambda r: r.col)
    assert [(r.col, r.row, r.cell_id) for r in got] == [(328, 887, 887 * 946 + 328), (329, 887, 887 * 946 + 329)]
    assert [r.x_m for r in got] == [772425.0, 772455.0] and got[0].y_m == 417525.0
    fine = GRID.with_coordinates(spark.createDataFrame([(3, 4)], "row long, col long"))
    assert GRID.repair(fine).collect() == fine.collect()
    back = GRID.inverse(fine.select("x_m", "y_m")).first()
    assert (back.row, back.col) == (3, 4)
    with pytest.raises(ValueError):
        GRID.repair(spark.createDataFrame([(-5.0, 1.0, 1, 1, 1)], broken.schema))


def mask_frame(spark, built, valid=None):
    h, w = built.shape
    valid = np.ones_like(built) if valid is None else valid
    return spark.createDataFrame([(0, r, c, int(built[r, c]), int(valid[r, c])) for r in range(h) for c in range(w)], "epoch int, row int, col int, built int, valid int")


def test_patches(spark):
    got = stencil.patches(mask_frame(spark, np.eye(3, dtype=int))).first()
    assert (got.nump, got.mps_ha, got.built_area_ha) == (1, pytest.approx(0.27), pytest.approx(0.27))
    built = (np.random.default_rng(3).random((14, 14)) < 0.4).astype(int)
    seen, count = np.zeros_like(built, bool), 0
    for r, c in zip(*np.nonzero(built), strict=True):
        if not seen[r, c]:
            count += 1
            stack = [(r, c)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 14 and 0 <= b < 14 and built[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert stencil.patches(mask_frame(spark, built)).first().nump == count


def test_neighbourhood_and_distance(spark):
    rng = np.random.default_rng(5)
    built, valid = (rng.random((9, 9)) < 0.2).astype(int), (rng.random((9, 9)) < 0.8).astype(int)
    df = mask_frame(spark, built, valid)
    fractions = {(r.row, r.col): r for r in stencil.built_fraction(df, 3).collect()}
    distances = {(r.row, r.col): r.distance_m for r in stencil.distance_to_built(df, 30.0).collect()}
    at = np.argwhere(built)
    for r in range(9):
        for c in range(9):
            box = np.s_[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2]
            v, b = valid[box].sum(), (built * valid)[box].sum()
            assert fractions[r, c].built_fraction == pytest.approx(b / v if v else 0.0) and fractions[r, c].valid_fraction == pytest.approx(v / 9)
            assert distances[r, c] == pytest.approx(30 * np.sqrt(((at - (r, c)) ** 2).sum(1).min()))
    empty = stencil.distance_to_built(mask_frame(spark, np.zeros((3, 3), int)), 30.0)
    assert {r.distance_m for r in empty.collect()} == {None}


def test_polygons(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (2.5, 2.5)], "x_m double, y_m double")
    rings = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (3, 2), (3, 3), (2, 3)]]
    assert [r.inside for r in stencil.inside_polygons(df, rings).collect()] == [True, False, False]


def test_weighted_f1_and_selection(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 0, 1.0), (0, 1, 1.0), (0, 0, 2.0)], "truth int, pred int, weight double").withColumn("g", F.lit(1))
    assert sampling.weighted_f1(rows, ["g"]).first().f1 == pytest.approx(2 / 3)
    names = "method string, mean_yearly_weighted_f1 double, minimum_yearly_weighted_f1 double, reversal_rate double"
    scores = spark.createDataFrame([("ndbi", 0.80, 0.70, 0.03), ("ibui", 0.79, 0.75, 0.05), ("ndbsui", 0.60, 0.50, 0.01)], names)
    assert sampling.select_method(scores, 0.02) == ("PASS", "ibui")
    tie = spark.createDataFrame([("a", 0.8, 0.7, 0.1), ("b", 0.8, 0.7, 0.1)], names)
    assert sampling.select_method(tie, 0.02) == ("MANUAL_DECISION_REQUIRED", None)


RESULTS = "epoch int, window_name string, number_of_months int, sensor_mode string, coverage_at_least_1_core_pct double, coverage_at_least_3_core_pct double, median_valid_observations_core double, scene_count long"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", 3, "primary_only", 99.8, 84.0), ("b", 6, "primary_only", 100.0, 99.0)], ("a", "primary_only", "PASS_SHORTEST_ACCEPTABLE")),
        ([("a", 3, "primary_only", 96.0, 84.0), ("a", 3, "primary_plus_supplemental", 99.0, 90.0)], ("a", "primary_only", "PASS_SHORTEST_ACCEPTABLE")),
        ([("a", 3, "primary_only", 92.0, 84.0), ("a", 3, "primary_plus_supplemental", 98.0, 90.0)], ("a", "primary_plus_supplemental", "PASS_SHORTEST_ACCEPTABLE")),
        ([("a", 3, "primary_only", 31.0, 1.0), ("b", 12, "primary_only", 91.0, 50.0)], ("b", "primary_only", "FALLBACK_BELOW_95")),
    ],
)
def test_window_selection(spark, rows, want):
    df = spark.createDataFrame([(2000, n, m, s, a, b, 1.0, 5) for n, m, s, a, b in rows], RESULTS)
    got = catalog.select_protocol(df).first()
    assert (got.window_name, got.sensor_mode, got.selection_status) == want
    with pytest.raises(Exception, match="without primary"):
        catalog.select_protocol(spark.createDataFrame([(2000, "a", 3, "primary_plus_supplemental", 99.0, 99.0, 1.0, 5)], RESULTS)).collect()


def scored(spark, y, p, fold=None):
    return spark.createDataFrame(list(zip(y, p, fold or [1] * len(y), strict=True)), "y int, p double, fold int")


def test_conformal(spark):
    s = scored(spark, [0, 1, 0, 1], [0.1, 0.8, 0.6, 0.3]).select(F.round(M.nonconformity(), 9).alias("s")).collect()
    assert [r.s for r in s] == [0.1, 0.2, 0.6, 0.7]
    sets = M.prediction_sets(scored(spark, [0] * 4, [0.1, 0.4, 0.6, 0.9]).withColumn("q_hat", F.lit(0.35))).collect()
    assert [r.prediction_set for r in sets] == ["{0}", "{}", "{}", "{1}"]
    assert M.conformal_quantile(scored(spark, [0] * 5, [0.1, 0.4, 0.2, 0.5, 0.3]), [], 0.2).first().q_hat == 0.5
    folds = M.temporal_coverage(scored(spark, [0, 1] * 3, [0.2, 0.7, 0.1, 0.9, 0.3, 0.8], [1, 1, 2, 2, 3, 3]), 0.8).collect()
    assert sorted(r.fold for r in folds) == [2, 3]


def test_calibration_and_ranking(spark):
    y, p = [0, 0, 0, 1, 1, 1, 1, 0], [0.05, 0.1, 0.25, 0.55, 0.7, 0.8, 0.9, 0.35]
    bins = M.reliability(scored(spark, y, p), [], 4).collect()
    assert sum(r.cell_count for r in bins) == 8 and all(math.isfinite(r.gap) for r in bins)
    y, p = [0, 1, 1, 0, 1, 0], [0.2, 0.2, 0.9, 0.4, 0.4, 0.1]
    got = M.ranking(scored(spark, y, p), []).first()
    pairs = [(a > b) + 0.5 * (a == b) for a, u in zip(p, y, strict=True) if u for b, v in zip(p, y, strict=True) if not v]
    assert got.roc_auc == pytest.approx(sum(pairs) / len(pairs))
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(int)
    a, b = M.calibration_line(scored(spark, y.tolist(), (1 / (1 + np.exp(-x))).tolist()))
    assert a == pytest.approx(0.5, abs=0.2) and b == pytest.approx(2, abs=0.25)
    folds = spark.createDataFrame([("m", 1, 0.3), ("m", 2, 0.4), ("m", 3, 0.8)], "model string, fold int, log_loss double")
    assert M.summarise(folds, ["model"], ["log_loss"], []).first().log_loss_mean == pytest.approx(0.5)
    with pytest.raises(ValueError):
        M.validate(scored(spark, [2], [0.5]))


def reliability_as_in_sql(spark, folder, rows):
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in queries.QUERIES["reliability_quantile"](spark, str(folder)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(queries.SQL["reliability_quantile"]).fetchall(), key=str)


def test_quantile_bins_as_in_sql(spark, tmp_path):
    """Edges between equal probabilities, and at places that round beside a whole number (90 * 0.7)."""
    rng = np.random.default_rng(3)
    sizes = [2, 7, 91, 91, *rng.integers(3, 300, 56).tolist()]
    draw = lambda g, n: rng.permutation(n) / 2 if g == 2 else rng.integers(1, 51, n)
    reliability_as_in_sql(spark, tmp_path, [(g, i, float(q), "RN"[i % 2], datetime(1900 + g, 3, 1)) for g, n in enumerate(sizes) for i, q in enumerate(draw(g, n))])


def test_quantile_bins_with_nulls_as_in_sql(spark, tmp_path):
    rows = [(1, i, None if i % 3 else 7.0 * i, None if i % 2 else "R", datetime(1996, 3, 1)) for i in range(31)]
    reliability_as_in_sql(spark, tmp_path, [*rows, (2, 1, None, "R", datetime(1997, 3, 1)), (3, 1, 5.0, "R", None)])


def test_features(spark):
    df = spark.createDataFrame([(100.0, 0.0, 1.0, 0.2, 0.1), (200.0, 100.0, 2.0, 0.4, 0.3)], "population_density_t double, distance_to_built_m_t double, slope_degrees double, built_fraction_11x11_t double, recent_local_growth_5y_t double")
    rows = features.engineer(df).collect()
    assert all(math.isfinite(r[c]) for r in rows for c in ("log_population", "log_distance", "slope_squared", "built_growth", "built_population"))
    with pytest.raises(Exception, match="not negative"):
        features.engineer(df.withColumn("population_density_t", F.lit(-1.0))).collect()
    with pytest.raises(ValueError):
        features.check_folds([2000], 2005, 2010, evaluate_test=True)
    with pytest.raises(ValueError):
        features.check_no_leakage(["a", "state_target"])
    with pytest.raises(Exception, match="repeated key"):
        features.one_to_one(df, df.unionByName(df), ["slope_degrees"]).collect()


def test_quality_bits(spark):
    df = spark.createDataFrame([(0, 0, "LC08", 1.0), (4, 0, "LC08", 1.0), (4, 0, "LT05", 1.0), (8, 0, "LT05", 1.0), (0, 1, "LT05", 1.0), (0, 0, "LT05", None)], "q int, s int, sensor string, b double")
    got = df.select(qa.valid_mask(F.col("q"), F.col("s"), F.col("sensor"), [F.col("b")]).alias("v")).collect()
    assert [r.v for r in got] == [True, False, True, False, False, False]


def test_text(spark):
    df = spark.createDataFrame([(" Yaoundé ÉTÉ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalise("t")).collect()] == ["yaounde ete", None]
    assert df.select(T.fold_accents(F.col("t"))).first()[0] == "yaounde ete"


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name,state\na,pass\n,PASS\n")
    got = tables.read_manifest(spark, f"file://{tmp_path}/m.csv", "name string, state string", ["name"])
    assert [r.name for r in got.collect()] == ["a", ""]
    df = spark.range(4).withColumn("e", F.col("id") % 2)
    tables.write_release(df, f"file://{tmp_path}/r", "e", {"v": 1})
    assert spark.read.parquet(f"file://{tmp_path}/r/data").count() == 4
    with pytest.raises(FileExistsError):
        tables.write_release(df, f"file://{tmp_path}/r", "e", {"v": 1})
    assert tables.stable_hash({"b": 1, "a": 2}) == tables.stable_hash({"a": 2, "b": 1})


def test_stream_is_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")
    q = windowed_summary(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.window_start, r.event_type, r.n)
    assert sorted(map(key, spark.table("windowed").collect())) == sorted(map(key, windowed_summary(events).collect()))
