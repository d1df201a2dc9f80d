"""Report operators on small fixtures; their queries are also held against SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from gridforge.operators import reports
from gridforge.plans import queries, report_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMES = ["count_percentiles", "count_frequency", "compare_epochs", "dominant_column", "density_audit", "raster_point_lookup", "tracking_metrics", "split_summary", "anchor_epochs", "label_faults", "temporal_kernel", "study_mask"]


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for name in ("lineitem", "orders", "supplier", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(row):
    return tuple(round(float(v), 5) if isinstance(v, int | float) else v for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, base, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = base.execute(f"SELECT {quoted} FROM ({queries.SQL[name]})").fetchall()
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted((plain(r) for r in got.select(*columns).collect()), key=key) == sorted(map(plain, want), key=key)


def test_largest_name_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 3.0), (3, None, None)], "k int, loss_a double, loss_b double")
    assert [r.n for r in df.orderBy("k").select(reports.largest_name(["loss_a", "loss_b"], "loss_").alias("n")).collect()] == ["a", "b", None]


def test_anchor_epochs(spark):
    df = spark.createDataFrame([(2000, 90.0), (2005, 95.0), (2010, 85.0), (2015, 96.0), (2020, 10.0), (2025, 99.0)], "epoch int, coverage double")
    assert {r.anchor: r.epoch for r in reports.anchor_epochs(df, 80.0).collect()} == {"earliest": 2000, "middle": 2015, "latest": 2025}
    assert reports.anchor_epochs(df, 100.0).count() == 0


def test_even_positions():
    assert reports.even_positions(9, 3) == [0, 4, 8] and reports.even_positions(2, 5) == [0, 1] and len(reports.even_positions(7, 6)) == 6


def test_spacing():
    reports.check_spacing([2000, 2005, 2010], 5)
    with pytest.raises(ValueError):
        reports.check_spacing([2000, 2005, 2011], 5)


def test_point_values_keep_every_point(spark):
    raster = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, -9999.0)], "epoch int, row int, col int, v double")
    points = spark.createDataFrame([(1, 10.0, 10.0), (1, 40.0, 10.0), (1, -5.0, 10.0), (2, 10.0, 10.0), (1, None, 1.0)], "epoch int, x double, y double")
    got = reports.point_values(points, raster, ["epoch"], "x", "y", 30.0, "v", -9999.0)
    assert got.count() == 5 and [r.v for r in got.filter("v is not null").collect()] == [5.0]


def test_split_summary_hides_the_test(spark):
    df = spark.createDataFrame([(2000, 1), (2000, 0), (2005, 1), (2010, 1), (1990, 1)], "o int, y int")
    got = {(r.split, r.origin): (r.n_rows, r.positives) for r in reports.split_summary(df, "o", "y", {"train": [2000, 2005], "test": [2010]}, ("train",)).collect()}
    assert got == {("train", 2000): (2, 1), ("train", 2005): (1, 1), ("test", 2010): (1, None)}


def test_label_faults(spark):
    d = dt.date
    labels = spark.createDataFrame([("a", 1, d(2001, 1, 1), 2000), ("a", 0, d(2009, 1, 1), 2000), ("b", 7, None, 2000), ("x", None, None, 2000), ("c", 1, None, 2000)], "id string, label int, date date, epoch int")
    samples = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    assert tuple(reports.label_faults(labels, samples, "id", "label", "date", "epoch").first()) == (1, 1, 1, 1, 2)
    assert tuple(reports.label_faults(labels.limit(0), samples.limit(0), "id", "label", "date", "epoch").first()) == (0, 0, 0, 0, 0)


def test_density_audit(spark):
    coarse = spark.createDataFrame([(1, 8.0), (1, 4.0)], "e int, n double")
    fine = spark.createDataFrame([(1, 8.0 / 3600 * 1e6)] * 4 + [(1, 4.0 / 3600 * 1e6)] * 4, "e int, density double")
    got = reports.density_audit(coarse, fine, ["e"], "n", "density", 900.0).first()
    assert (got.native_total, got.native_maximum) == (12.0, 8.0) and got.fine_total == pytest.approx(12.0) and got.difference_pct == pytest.approx(0.0, abs=1e-9)


def test_tracking_flags_low_support(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, 1), (2, 1, 1)], "epoch int, cell int, final int")
    support = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "cell int, supported int")
    got = {r.epoch: r for r in reports.tracking(df, support, ["cell"], 4).collect()}
    assert (got[1].built_share, got[2].built_share, got[1].support_pct, got[1].status) == (0.5, 1.0, 50.0, "WARNING_LOW_SUPPORT")


def test_compare_epochs(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (2, 5, 1.0), (3, 9, 9.0)], "epoch int, a int, b double")
    assert {r.metric: (r["first"], r["second"], r.difference) for r in reports.compare_epochs(df, ["a", "b"], 1, 2).collect()} == {"a": (2.0, 5.0, 3.0), "b": (3.0, 1.0, -2.0)}
    assert reports.compare_epochs(df, ["a"], 1, 8).first().difference is None


def test_percentiles_count_missing_cells_as_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, 4)], "e int, n long")
    got = reports.count_percentiles(df, ["e"], "n").first()
    assert (got.mean, got.p50, got.covered_p50, got.p100) == (1.5, 1.0, 3.0, 4.0)
    assert {(r.observations, r.cells) for r in reports.frequency(df, ["e"], "n").collect()} == {(0, 2), (2, 1), (4, 1)}
    assert reports.count_percentiles(df.filter(F.lit(False)), ["e"], "n").count() == 0


def test_listed_trims_white_space(spark):
    from gridforge.functions.text import listed

    got = spark.createDataFrame([(" a, ,b 0,1 ,2x",), (None,), ("",)], "c string").select(listed(F.col("c")).alias("c")).collect()
    assert [r.c for r in got] == [["a", "b 0", "1", "2x"], None, []]
