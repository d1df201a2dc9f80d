"""Queries of contracts, manifests, coverage, vector shapes and the evaluation, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evaluation as E
from ..operators import contracts as C
from ..operators import coverage as G
from ..operators import manifests as X
from ..operators import vector
from ..operators.grid import GridSpec
from . import views as V
from .queries import _bins, query, rounded

YEARS = [1995, 1996, 1997, 1998]
CELL_TIME = """cell_time AS (SELECT l_partkey AS cell_id, CAST(year(l_shipdate) AS INT) AS forecast_origin, CAST(year(l_shipdate) + 5 + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS INT) AS target_year,
  CAST(l_linenumber % 3 AS INT) AS target, CASE WHEN l_discount > 0.085E0 THEN 1 ELSE 0 END AS built_state FROM lineitem)"""


def _cell_time(spark, sf):
    year = F.year("l_shipdate")
    return V.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("cell_id"), year.alias("forecast_origin"), (year + 5 + (F.col("l_linenumber") == 7).cast("int")).alias("target_year"), (F.col("l_linenumber") % 3).alias("target"), (F.col("l_discount") > 0.085).cast("int").alias("built_state"))


@query(f"""WITH {CELL_TIME}
  SELECT 'horizon' AS fault, count(*) FILTER (target_year <> forecast_origin + 5) AS "rows" FROM cell_time
  UNION ALL SELECT 'label', count(*) FILTER (target NOT IN (0, 1)) FROM cell_time
  UNION ALL SELECT 'built_at_origin', count(*) FILTER (built_state <> 0) FROM cell_time
  UNION ALL SELECT 'origin', count(*) FILTER (forecast_origin NOT IN (1995, 1996, 1997, 1998)) FROM cell_time
  UNION ALL SELECT 'repeated_key', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM cell_time GROUP BY cell_id, forecast_origin)
  UNION ALL SELECT 'missing_origin', 4 - count(DISTINCT forecast_origin) FILTER (forecast_origin IN (1995, 1996, 1997, 1998)) FROM cell_time""")
def cell_time_contract(spark, sf):
    return C.cell_time_faults(_cell_time(spark, sf), YEARS)


DEMAND = """, demand AS (SELECT forecast_origin AS period_start, forecast_origin + 5 AS period_end, CAST(count(*) AS BIGINT) AS eligible_nonbuilt_cells, CAST(sum(target) + CASE WHEN forecast_origin % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS new_built_cells,
  sum(target) * 0.09E0 AS observed_new_built_area_ha FROM cell_time WHERE target_year = forecast_origin + 5 AND forecast_origin < 1998 GROUP BY forecast_origin)"""


def _demand(cell_time):
    even = F.when(F.col("forecast_origin") % 2 == 0, 1).otherwise(0)
    good = cell_time.filter((F.col("target_year") == F.col("forecast_origin") + 5) & (F.col("forecast_origin") < 1998))
    return good.groupBy("forecast_origin").agg(F.count("*").alias("eligible_nonbuilt_cells"), F.sum("target").alias("s")).select(F.col("forecast_origin").alias("period_start"), (F.col("forecast_origin") + 5).alias("period_end"), "eligible_nonbuilt_cells", (F.col("s") + even).alias("new_built_cells"), (F.col("s") * 0.09).alias("observed_new_built_area_ha"))


@query(f"""WITH {CELL_TIME}{DEMAND}, seen AS (SELECT forecast_origin AS period_start, target_year AS period_end, count(*) AS eligible, sum(target) AS "new" FROM cell_time GROUP BY 1, 2), b AS (SELECT * FROM demand FULL JOIN seen USING (period_start, period_end))
  SELECT 'eligible_count' AS fault, count(*) FILTER (eligible_nonbuilt_cells IS DISTINCT FROM eligible) AS "rows" FROM b UNION ALL SELECT 'new_count', count(*) FILTER (new_built_cells IS DISTINCT FROM "new") FROM b
  UNION ALL SELECT 'area', count(*) FILTER (coalesce(abs(observed_new_built_area_ha - new_built_cells * 0.09E0) > 1E-6 + 1E-5 * abs(new_built_cells * 0.09E0), TRUE)) FROM b""")
def demand_contract(spark, sf):
    cell_time = _cell_time(spark, sf)
    return C.demand_faults(cell_time, _demand(cell_time))


TRACK = """m AS (SELECT CAST(n_nationkey AS INT) AS epoch, 100.0E0 + n_regionkey AS tracking_support_area_ha, n_nationkey / 20.0E0 AS pba, n_nationkey - 2 AS nump, n_regionkey * 1.5E0 AS mps_ha FROM nation)"""


@query(f"""WITH {TRACK} SELECT 'pba' AS fault, count(*) FILTER (NOT pba BETWEEN 0 AND 1) AS "rows" FROM m UNION ALL SELECT 'patches', count(*) FILTER (nump < 0 OR mps_ha < 0) FROM m UNION ALL SELECT 'epoch', count(*) FILTER (epoch > 22) FROM m
  UNION ALL SELECT 'support', abs(count(DISTINCT tracking_support_area_ha) - 1) FROM m UNION ALL SELECT 'missing_epoch', abs(23 - count(DISTINCT epoch)) FROM m UNION ALL SELECT 'repeated_epoch', CAST(0 AS BIGINT)""")
def tracking_contract(spark, sf):
    n = F.col("n_nationkey")
    m = V.read(spark, sf, "nation").select(n.cast("int").alias("epoch"), (F.lit(100.0) + F.col("n_regionkey")).alias("tracking_support_area_ha"), (n / 20.0).alias("pba"), (n - 2).alias("nump"), (F.col("n_regionkey") * 1.5).alias("mps_ha"))
    return C.tracking_faults(m, list(range(23)))


LABELLED = """s AS (SELECT CAST(c_nationkey AS INT) AS epoch, CAST(c_custkey % 7 % 3 - CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS INT) AS label FROM customer WHERE c_acctbal > 0)"""


@query(f"""WITH {LABELLED}, c AS (SELECT * FROM s WHERE label IN (0, 1)), e AS (SELECT epoch, count(*) AS n, count(DISTINCT label) AS k FROM c GROUP BY 1)
  SELECT 'few_labels' AS fault, count(*) FILTER (n < 38) AS "rows" FROM e UNION ALL SELECT 'one_class', count(*) FILTER (k < 2) FROM e
  UNION ALL SELECT 'few_of_class', CAST((count(*) FILTER (label = 0) < 500)::INT + (count(*) FILTER (label = 1) < 500)::INT AS BIGINT) FROM c""")
def evaluation_population(spark, sf):
    c = V.read(spark, sf, "customer").filter("c_acctbal > 0")
    label = (F.col("c_custkey") % 7 % 3).cast("int") - (F.col("c_nationkey") == 3).cast("int")
    return C.evaluation_faults(c.select(F.col("c_nationkey").alias("epoch"), label.alias("label")), 38, 500)


@query("""WITH v AS (SELECT try_cast(nullif(o_orderpriority[1:1], '3') AS DOUBLE) AS a, CASE WHEN o_orderstatus = 'P' THEN 'infinity'::DOUBLE WHEN o_orderstatus = 'O' THEN 'nan'::DOUBLE ELSE o_totalprice END AS b, try_cast(o_orderstatus AS DOUBLE) AS c FROM orders)
  SELECT 'a' AS feature, count(*) FILTER (a IS NULL) AS nulls, count(*) FILTER (isnan(a) OR isinf(a)) AS not_finite FROM v UNION ALL SELECT 'b', count(*) FILTER (b IS NULL), count(*) FILTER (isnan(b) OR isinf(b)) FROM v UNION ALL SELECT 'c', count(*) FILTER (c IS NULL), count(*) FILTER (isnan(c) OR isinf(c)) FROM v""")
def feature_contract(spark, sf):
    s = F.col("o_orderstatus")
    priority = F.substring("o_orderpriority", 1, 1)
    rows = V.read(spark, sf, "orders").select(F.when(priority != "3", priority).alias("a"), F.when(s == "P", F.lit(float("inf"))).when(s == "O", F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("b"), s.alias("c"))
    return C.feature_faults(rows, ["a", "b", "c"])


@query(f"""WITH {V.CELLS} SELECT 'domain' AS fault, count(*) FILTER (obs >= 3 AND obs % 4 NOT IN (0, 1)) AS "rows" FROM cells UNION ALL SELECT 'mask', count(*) FILTER ((obs >= 3) <> (valid = 1 AND epoch <> 1995)) FROM cells""")
def mask_contract(spark, sf):
    c = V.cells(spark, sf)
    return C.mask_faults(c.select(F.when(F.col("obs") >= 3, F.col("obs") % 4).alias("built"), F.when(F.col("epoch") != 1995, F.col("valid")).alias("v")), "built", "v")


PRODUCTS = """p AS (SELECT n_nationkey AS epoch, unnest(['candidates', 'indices', 'composite']) AS product_type, n_name AS asset_id, n_name || '_c' AS source_composite_asset, n_name || '_n' AS source_count_asset, CASE WHEN n_nationkey % 2 = 0 THEN 'pass' ELSE 'Completed' END AS state FROM nation)"""


def _products(spark, sf):
    n = V.read(spark, sf, "nation")
    kind = F.explode(F.array(*[F.lit(k) for k in ("candidates", "indices", "composite")]))
    return n.select(F.col("n_nationkey").alias("epoch"), kind.alias("product_type"), F.col("n_name").alias("asset_id"), F.concat("n_name", F.lit("_c")).alias("source_composite_asset"), F.concat("n_name", F.lit("_n")).alias("source_count_asset"), F.when(F.col("n_nationkey") % 2 == 0, "pass").otherwise("Completed").alias("state"))


@query(f"WITH {PRODUCTS} SELECT a.epoch, a.source_composite_asset, a.source_count_asset, b.asset_id AS index_asset FROM p a JOIN p b ON a.epoch = b.epoch AND a.product_type = 'candidates' AND b.product_type = 'indices'")
def epoch_sources(spark, sf):
    return X.epoch_sources(_products(spark, sf), list(range(25)))


@query("SELECT n_nationkey AS epoch, ['ndbi', 'ibui', n_name] AS band_names, 'PASS' AS state FROM nation")
def candidate_bands(spark, sf):
    n = V.read(spark, sf, "nation").select(F.col("n_nationkey").alias("epoch"), F.lit("candidates").alias("product_type"), F.concat(F.lit(" ndbi, ,ibui,"), F.col("n_name")).alias("band_names"), F.lit("PASS").alias("state"))
    return X.candidate_epochs(n, ["ndbi", "ibui"]).drop("product_type")


@query("SELECT n_nationkey AS epoch, n_name AS asset_id FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey > 2")
def completed_composites(spark, sf):
    status = F.when(F.col("n_regionkey").isin(1, 2), "Pass").otherwise("FAILED")
    n = V.read(spark, sf, "nation").select(F.col("n_nationkey").alias("epoch"), F.col("n_name").alias("asset_id"), status.alias("status"))
    return X.completed_composites(n, list(range(3, 25))).drop("status")


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier")
def manifest_union(spark, sf):
    c = V.read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = V.read(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return X.union_all(c, s)


@query(f"""WITH {V.SCENES} SELECT asset_id, year(acquired) AS acquisition_year, month(acquired) AS acquisition_month, dayofyear(acquired) AS day_of_year, round(CASE WHEN user_id % 9 = 0 THEN 0.0E0 ELSE valid_fraction * 500.0E0 END / 400.0E0, 9) AS valid_fraction_core,
  sensor = 'click' AND acquired >= DATE '2003-05-31' AS slc_off, sensor = 'click' AND acquired >= DATE '2017-02-07' AS orbit_drift, CASE WHEN user_id % 9 = 0 THEN 0.0E0 ELSE valid_fraction END > 0 AS has_positive_core_coverage, sensor <> 'error' AS candidate_for_composite FROM scenes""")
def scene_features(spark, sf):
    s = V.scenes(spark, sf).withColumns({"sensor": F.when(F.col("sensor") == "click", "LE07").otherwise(F.col("sensor")), "role": F.when(F.col("sensor") == "error", "diagnostic_only").otherwise("primary"), "valid_core_m2": F.when(F.col("user_id") % 9 != 0, F.col("valid_fraction") * 500.0), "valid_context_m2": F.lit(1.0)})
    out = X.scene_features(s, 400.0, 900.0)
    return rounded(out, "valid_fraction_core", digits=9).select("asset_id", "acquisition_year", "acquisition_month", "day_of_year", "valid_fraction_core", "slc_off", "orbit_drift", "has_positive_core_coverage", "candidate_for_composite")


WINDOWS = """e AS (SELECT DISTINCT CAST(year(ts) AS INT) AS epoch FROM events), w0 AS (SELECT epoch, CAST(n AS INT) AS months, make_date(CAST(epoch - CASE WHEN s + n - 1 > 12 THEN 1 ELSE 0 END AS INT), CAST(s AS INT), 1) AS window_start, s FROM e, unnest([3, 4, 6, 12]) t(n), range(1, 13) r(s)),
  w AS (SELECT epoch, strftime(window_start, '%b') || '-' || strftime(window_start + to_months(months - 1), '%b') || '_' || months || 'm' AS window_name, months, window_start, CAST(window_start + to_months(months) AS DATE) AS window_end FROM w0)"""


def _windows(spark, sf):
    epochs = sorted(r.epoch for r in V.scenes(spark, sf).select("epoch").distinct().collect())
    return X.windows_frame(spark, epochs, [3, 4, 6, 12])


@query(f"WITH {WINDOWS} SELECT epoch, window_name, months, CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end FROM w")
def window_expansion(spark, sf):
    return _windows(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("window_start", "window_end")})


@query(f"""WITH {V.SCENES}, {WINDOWS}, c AS (SELECT * FROM w WHERE months = 6 AND window_name LIKE 'Jan-%'), k AS (SELECT epoch, window_name, unnest(['click', 'view', 'purchase']) AS sensor, window_start, window_end FROM c)
  SELECT s.asset_id, s.epoch, s.sensor, k.window_name AS selected_window_name, 'primary_only' AS selected_sensor_mode, 'PASS' AS selection_status FROM scenes s JOIN k ON s.epoch = k.epoch AND s.sensor = k.sensor AND s.acquired >= k.window_start AND s.acquired < k.window_end WHERE s.has_coverage""")
def exact_scenes(spark, sf):
    chosen = _windows(spark, sf).filter("months = 6 AND window_name LIKE 'Jan-%'").withColumns({"sensor_keys": F.lit("click,view,purchase"), "sensor_mode": F.lit("primary_only"), "selection_status": F.lit("PASS")})
    return X.exact_scenes(V.scenes(spark, sf), chosen).select("asset_id", "epoch", "sensor", "selected_window_name", "selected_sensor_mode", "selection_status")


@query("SELECT DISTINCT CAST(year(ts) AS INT) AS epoch, CAST(make_date(CAST(year(ts) - 1 AS INT), 1, 1) AS VARCHAR) AS first, CAST(make_date(CAST(year(ts) + 3 AS INT), 1, 1) AS VARCHAR) AS last FROM events")
def diagnostic_ranges(spark, sf):
    low, high = X.diagnostic_range(F.col("epoch"), 1, 2)
    return V.scenes(spark, sf).select("epoch").distinct().select("epoch", low.cast("string").alias("first"), high.cast("string").alias("last"))


@query('SELECT CAST(year(l_shipdate) AS INT) AS epoch, CAST(l_partkey % 40 AS INT) AS "row", CAST(l_suppkey % 40 AS INT) AS col, max(CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END) AS footprint FROM lineitem GROUP BY 1, 2, 3')
def scene_footprint(spark, sf):
    covered = F.when(F.col("l_linenumber") > 4, 1)
    s = V.read(spark, sf, "lineitem").select(F.year("l_shipdate").alias("epoch"), (F.col("l_partkey") % 40).cast("int").alias("row"), (F.col("l_suppkey") % 40).cast("int").alias("col"), covered.alias("covered"))
    return X.scene_footprint(s, ["row", "col"])


COVERAGE = V.CELLS + """, area AS (SELECT epoch, d % 3 AS k, sum(obs) * 1.0E0 AS valid_area_ha, avg(valid) AS f FROM cells GROUP BY 1, 2), cov AS (SELECT epoch, CASE WHEN epoch < 1996 THEN 100 * max(f) ELSE median(valid_area_ha) / 9000.0E0 * 100 END AS core_coverage_pct,
  CASE WHEN epoch < 1996 THEN 'valid_fraction_core' ELSE 'candidate_valid_area_over_core_area' END AS coverage_source FROM area GROUP BY epoch)"""


def _coverage(spark, sf):
    c = V.cells(spark, sf)
    area = c.groupBy("epoch", (F.col("d") % 3).alias("k")).agg((F.sum("obs") * 1.0).alias("valid_area_ha"), F.avg("valid").alias("valid_fraction_core"))
    epochs = sorted(r.epoch for r in c.select("epoch").distinct().collect())
    return G.coverage_table(area.filter("epoch < 1996").select("epoch", "valid_fraction_core"), area, 9000.0, epochs)


@query(f"WITH {COVERAGE} SELECT epoch, round(core_coverage_pct, 6) AS core_coverage_pct, coverage_source FROM cov")
def coverage_by_epoch(spark, sf):
    return rounded(_coverage(spark, sf), "core_coverage_pct")


@query(f"""WITH {COVERAGE}, g AS (SELECT *, row_number() OVER (ORDER BY epoch) - 1 AS place, count(*) OVER () AS n FROM cov WHERE core_coverage_pct >= 10)
  SELECT epoch, coverage_source, CASE WHEN core_coverage_pct < 30 THEN 'WARN' ELSE 'PASS' END AS quality_flag FROM g WHERE n <= 3 OR place IN (0, CAST(round_even((n - 1) / 2.0E0, 0) AS BIGINT), n - 1)""")
def anchor_years(spark, sf):
    return G.anchor_epochs(_coverage(spark, sf), 10.0, 30.0, 3).drop("core_coverage_pct")


@query(f"""WITH {V.CELLS}, t AS (SELECT epoch, valid, sum(obs) + 0.4E0 AS vp, sum(q) * 900.0E0 AS v, sum(d) * 900.0E0 AS b FROM cells GROUP BY 1, 2)
  SELECT epoch, valid, CAST(round(vp) AS BIGINT) AS valid_pixels, round(v / 1E4, 6) AS valid_area_ha, round(b / 1E4, 6) AS built_area_ha, round(b / nullif(v, 0), 6) AS built_fraction, round(b / 1E4 - lag(b / 1E4) OVER (PARTITION BY valid ORDER BY epoch), 6) AS change_from_previous_epoch_ha FROM t""")
def area_change_rows(spark, sf):
    t = V.cells(spark, sf).groupBy("epoch", "valid").agg((F.sum("obs") + 0.4).alias("valid_pixels"), (F.sum("q") * 900.0).alias("valid_area_m2"), (F.sum("d") * 900.0).alias("built_area_m2"), F.lit(None).cast("double").alias("nonbuilt_area_m2"))
    return rounded(G.enrich_area(t, ["valid"]).drop("nonbuilt_area_ha"), "valid_area_ha", "built_area_ha", "built_fraction", "change_from_previous_epoch_ha")


@query(f"""WITH {V.CELLS} SELECT epoch, 144.0E0 AS tracking_support_area_ha, 80.0E0 AS tracking_support_pct_of_core, round(sum(raw) * 0.09E0, 6) AS built_area_ha, round(sum(raw) * 0.09E0 / 144.0E0, 9) AS pba, CASE WHEN epoch > 1993 THEN CAST(sum(valid) AS BIGINT) ELSE 0 END AS nump, CASE WHEN epoch > 1993 THEN 0.5E0 ELSE 0 END AS mps_ha, 'WARN_SUPPORT' AS tracking_quality_flag FROM cells GROUP BY epoch""")
def tracking_table(spark, sf):
    c = V.cells(spark, sf)
    areas = c.groupBy("epoch").agg((F.sum("raw") * 0.09).alias("built_area_ha"))
    patches = c.filter("epoch > 1993").groupBy("epoch").agg(F.sum("valid").alias("nump"), F.lit(0.5).alias("mps_ha"))
    out = G.tracking_table(areas, patches, 144.0, 180.0, 90.0)
    return out.withColumns({"built_area_ha": F.round("built_area_ha", 6), "pba": F.round("pba", 9)})


@query(f"""WITH {V.CELLS} SELECT epoch, count(*) FILTER (col < 20 AND valid = 1) * 900.0E0 AS area_m2, round(100.0E0 * count(*) FILTER (col < 20 AND valid = 1) / nullif(count(*) FILTER (col < 20), 0), 6) AS coverage_pct FROM cells GROUP BY 1""")
def zonal_area(spark, sf):
    c = V.cells(spark, sf).withColumn("zone", (F.col("col") < 20).cast("int"))
    return rounded(G.zonal_area(c, ["epoch"], "valid", "zone"), "coverage_pct")


@query(f"""WITH {V.CELLS} SELECT epoch, valid, round(avg(d % 5), 6) AS mean_obs, round(median(d % 5), 6) AS median_obs, round(100.0E0 * avg((d % 5 > 0)::INT), 6) AS coverage_pct FROM cells GROUP BY 1, 2""")
def sensor_contributions(spark, sf):
    c = V.cells(spark, sf).select("epoch", "valid", (F.col("d") % 5).alias("obs"))
    return rounded(G.sensor_contributions(c, ["epoch", "valid"]), "mean_obs", "median_obs", "coverage_pct")


@query("SELECT c_custkey, CASE WHEN n.n_nationkey IS NOT NULL THEN nullif(n.n_name, 'FRANCE') ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) n ON c_custkey = n_nationkey")
def label_update(spark, sf):
    labels = V.read(spark, sf, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.nullif("n_name", F.lit("FRANCE")).alias("c_mktsegment"))
    return G.update_labels(V.read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), labels, "c_custkey", "c_mktsegment")


@query(f"""WITH {V.CELLS}, c AS (SELECT epoch, 100.0E0 * count(*) / 1600 AS one, 100.0E0 * count(*) FILTER (obs >= 3) / 1600 AS three, 100.0E0 * count(*) FILTER (obs >= 5) / 1600 AS five FROM cells GROUP BY 1),
  d AS (SELECT epoch, CASE WHEN one - three >= three - five THEN 'three' ELSE 'five' END AS dominant_stage, greatest(one - three, three - five) AS loss, five - lag(five) OVER (ORDER BY epoch) AS change FROM c)
  SELECT epoch, dominant_stage, round(loss, 6) AS dominant_loss, 'most is lost at ' || dominant_stage || '; ' || CASE WHEN change IS NULL THEN 'first epoch' WHEN change > 0 THEN 'support grew' WHEN change < 0 THEN 'support fell' ELSE 'support is unchanged' END AS statement FROM d""")
def support_statements(spark, sf):
    part = lambda c: 100.0 * F.count_if(c) / 1600
    chain = V.cells(spark, sf).groupBy("epoch").agg((100.0 * F.count("*") / 1600).alias("one"), part(F.col("obs") >= 3).alias("three"), part(F.col("obs") >= 5).alias("five"))
    return rounded(G.diagnose(chain, ["one", "three", "five"]), "dominant_loss")


STUDY = GridSpec(30.0, 60, 50, 762570.0, 444150.0)
CORE = [vector.Shape.of([(763000, 443000), (763600, 443000), (763600, 443500), (763000, 443500)]), vector.Shape.of([(763600, 443000), (763900, 443000), (763900, 443300), (763600, 443300)])]


@query("""WITH c AS (SELECT CAST(r AS BIGINT) AS "row", CAST(k AS BIGINT) AS col, 762570.0E0 + (k + 0.5E0) * 30 AS x, 444150.0E0 - (r + 0.5E0) * 30 AS y FROM range(50) a(r), range(60) b(k)),
  h(x1, y1, x2, y2) AS (VALUES (763000.0E0, 443000.0E0, 763900.0E0, 443000.0E0), (763900.0E0, 443000.0E0, 763900.0E0, 443300.0E0), (763900.0E0, 443300.0E0, 763600.0E0, 443500.0E0), (763600.0E0, 443500.0E0, 763000.0E0, 443500.0E0), (763000.0E0, 443500.0E0, 763000.0E0, 443000.0E0)),
  t AS (SELECT *, least(1, greatest(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM c, h),
  d AS (SELECT "row", col, x, y, bool_and((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0) AS inside, min(sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1)))) AS far FROM t GROUP BY 1, 2, 3, 4)
  SELECT "row", col, (x > 763000 AND x < 763600 AND y > 443000 AND y < 443500) OR (x > 763600 AND x < 763900 AND y > 443000 AND y < 443300) AS in_core, CAST(floor(x / 30 + 1e-9) AS BIGINT) AS grid_x_index, CAST(floor(y / 30 + 1e-9) AS BIGINT) AS grid_y_index,
         'EPSG32632_30m_' || CAST(floor(x / 30 + 1e-9) AS BIGINT) || '_' || CAST(floor(y / 30 + 1e-9) AS BIGINT) AS cell_id, 900.0E0 AS cell_area_m2 FROM d WHERE inside OR far <= 200""")
def study_cells(spark, sf):
    cells = vector.core_and_buffer(spark, STUDY, CORE, 200.0)
    return vector.cell_table(cells, STUDY, 32632).drop("x_m", "y_m", "in_context")


@query("""WITH p AS (SELECT c_custkey, CAST(c_custkey * 53 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 17 % 1000 AS DOUBLE) AS y FROM customer)
  SELECT c_custkey, '2025-01-01' AS snapshot, 'layer' AS source FROM p WHERE y > 100.3E0 AND (x - 100.2E0) * 600 > (y - 100.3E0) * 400 AND (900.7E0 - x) * 600 > (y - 100.3E0) * 400.5E0""")
def clip_points(spark, sf):
    p = V.read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 53 % 1000).cast("double").alias("x_m"), (F.col("c_custkey") * 17 % 1000).cast("double").alias("y_m"))
    triangle = vector.Shape.of([(100.2, 100.3), (900.7, 100.3), (500.2, 700.3)])
    return vector.clip_and_annotate(p, triangle, {"snapshot": "2025-01-01", "source": "layer"}).drop("x_m", "y_m")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#21')")
def class_filter(spark, sf):
    return vector.filter_classes(V.read(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", ["Brand#11", "Brand#12", "Brand#21"])


@query(f"""WITH {V.CELLS} SELECT epoch, "row", col, coalesce(CASE WHEN valid = 1 THEN q END / (obs * 900.0E0) * 1E6, 0) AS population_density_t, CAST(epoch - epoch % 5 AS INT) AS population_source_year FROM cells""")
def population_density(spark, sf):
    from ..operators.features import population_density as density

    c = V.cells(spark, sf).withColumn("people", F.when(F.col("valid") == 1, F.col("q")))
    return density(c, F.col("people"), F.col("obs") * 900.0, F.col("epoch") - F.col("epoch") % 5).select("epoch", "row", "col", "population_density_t", "population_source_year")


@query(f"""WITH {CELL_TIME}, t AS (SELECT *, forecast_origin - 1992 AS transition_order FROM cell_time WHERE target < 2 AND target_year = forecast_origin + 5), k AS (SELECT transition_order, cell_id, max(target) AS target FROM t GROUP BY 1, 2)
  SELECT transition_order, cell_id, target, row_number() OVER (ORDER BY transition_order, cell_id) AS place FROM k""")
def final_order(spark, sf):
    from ..operators.features import ordered

    t = _cell_time(spark, sf).filter("target < 2 AND target_year = forecast_origin + 5").withColumn("transition_order", F.col("forecast_origin") - 1992)
    return ordered(t.groupBy("transition_order", "cell_id").agg(F.max("target").alias("target")), ["transition_order", "cell_id"])


def _epochs_one_by_one(spark, sf, step):
    """step(epoch) of every epoch, one under the other."""
    epochs = sorted(r.epoch for r in V.cells(spark, sf).select("epoch").distinct().collect())
    return X.union_all(*[step(e) for e in epochs])


@query("""SELECT CAST(year(l_shipdate) AS INT) AS epoch, CAST(l_partkey % 3 AS INT) AS stratum, count(*) AS population, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2""")
def strata_union(spark, sf):
    rows = V.read(spark, sf, "lineitem").select(F.year("l_shipdate").alias("epoch"), (F.col("l_partkey") % 3).cast("int").alias("stratum"), "l_quantity")
    one = lambda k: rows.filter(F.col("stratum") == k).groupBy("epoch", "stratum").agg(F.count("*").alias("population"), F.avg("l_quantity").alias("mean"))
    return rounded(X.union_all(*[one(k) for k in range(3)]), "mean")


@query(f"WITH {V.CELLS} SELECT epoch, epoch + 1 AS target_epoch, count(*) AS cells, CAST(sum(valid) AS BIGINT) AS valid_cells FROM cells GROUP BY 1")
def transitions_union(spark, sf):
    c = V.cells(spark, sf)
    return _epochs_one_by_one(spark, sf, lambda e: c.filter(F.col("epoch") == e).groupBy("epoch").agg((F.max("epoch") + 1).alias("target_epoch"), F.count("*").alias("cells"), F.sum("valid").alias("valid_cells")))


@query(f"""WITH {V.SCORED}, u AS (SELECT fold, y, unnest(['base', 'shrunk']) AS feature_set, unnest([p, 0.5E0 + (p - 0.5E0) / 2]) AS p FROM scored) SELECT feature_set, fold, count(*) AS "rows", round(avg((p - y) * (p - y)), 6) AS brier FROM u GROUP BY 1, 2""")
def feature_set_summary(spark, sf):
    from ..functions.metrics import proper_scores
    from ..models.sparse_gp import compare_feature_sets

    def score(df, features):
        p = F.col("p") if features == ["p"] else 0.5 + (F.col("p") - 0.5) / 2
        return proper_scores(df.withColumn("p", p), ["fold"]).select("fold", "rows", "brier")

    return rounded(compare_feature_sets(V.scored(spark, sf), {"base": ["p"], "shrunk": ["p", "p"]}, score), "brier")


MODELS = """m AS (SELECT unnest(['a', 'b']) AS model, CAST(fold AS VARCHAR) AS fold, y, unnest([p, 1 - p]) AS p FROM scored), s AS (SELECT model, fold, p, sum(y) AS pos, count(*) AS n FROM m GROUP BY 1, 2, 3),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER a AS np, sum(n - pos) OVER a AS nn FROM s WINDOW w AS (PARTITION BY model, fold ORDER BY p DESC), a AS (PARTITION BY model, fold)),
  r AS (SELECT model, fold, sum(pos * tp / k::DOUBLE) / max(np) AS average_precision, sum(pos * ((nn - (k - tp)) + (n - pos) / 2.0E0)) / (max(np) * max(nn)) AS roc_auc FROM c GROUP BY 1, 2),
  b AS (SELECT model, fold, count(*) AS "rows", avg((p - y) * (p - y)) AS brier, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss, abs(avg(p) - avg(y)) AS absolute_bias FROM m GROUP BY 1, 2),
  e AS (SELECT model, fold, list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM m GROUP BY 1, 2),
  i AS (SELECT m.*, len(list_filter(e[2:len(e) - 1], lambda x: x < p)) AS bin FROM m JOIN e USING (model, fold)), t AS (SELECT model, fold, bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM i GROUP BY 1, 2, 3),
  x AS (SELECT model, fold, sum(n * gap) / sum(n) AS ece FROM t GROUP BY 1, 2), f AS (SELECT * FROM b JOIN r USING (model, fold) JOIN x USING (model, fold)),
  q0 AS (SELECT model, fold, CASE WHEN y = 1 THEN 1 - p ELSE p END AS score FROM m), q1 AS (SELECT DISTINCT model, fold AS later FROM m), q2 AS (SELECT q0.model, later, score, row_number() OVER (PARTITION BY q0.model, later ORDER BY score) AS k, count(*) OVER (PARTITION BY q0.model, later) AS n FROM q0 JOIN q1 ON q0.model = q1.model AND q0.fold < q1.later),
  q AS (SELECT model, later AS fold, min(score) AS q_hat FROM q2 WHERE k >= greatest(least(ceil(round((n + 1) * 0.8E0, 9)), n), 1) GROUP BY 1, 2),
  v AS (SELECT model, fold, avg(CASE WHEN (y = 1 AND 1 - p <= q_hat) OR (y = 0 AND p <= q_hat) THEN 1.0E0 ELSE 0 END) AS coverage FROM m JOIN q USING (model, fold) GROUP BY 1, 2)"""


def _evaluated(spark, sf, line=False):
    s = V.scored(spark, sf).select("y", "p", "fold")
    return E.evaluate({"a": s, "b": s.withColumn("p", 1 - F.col("p"))}, line=line)


@query(f'WITH {V.SCORED}, {MODELS} SELECT model, fold, "rows", round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(absolute_bias, 6) AS absolute_bias, round(average_precision, 6) AS average_precision, round(roc_auc, 6) AS roc_auc, round(ece, 6) AS ece FROM f')
def evaluation_folds(spark, sf):
    got = _evaluated(spark, sf).folds.select("model", "fold", "rows", "brier", "log_loss", "absolute_bias", "average_precision", "roc_auc", "ece")
    return rounded(got, "brier", "log_loss", "absolute_bias", "average_precision", "roc_auc", "ece")


@query(f"""WITH {V.SCORED}, {MODELS}, z AS (SELECT model, count(*) AS coverage_folds, avg(coverage) AS c, avg(abs(coverage - 0.8E0)) AS g FROM v GROUP BY 1)
  SELECT f.model, count(*) AS folds, round(avg(brier), 6) AS brier_mean, round(max(brier), 6) AS brier_worst, round(avg(roc_auc), 6) AS roc_auc_mean, round(min(roc_auc), 6) AS roc_auc_worst, round(avg(ece), 6) AS ece_mean, max(z.coverage_folds) AS coverage_folds, round(max(z.c), 6) AS mean_coverage, round(max(z.g), 6) AS mean_absolute_coverage_gap FROM f LEFT JOIN z ON f.model = z.model GROUP BY f.model""")
def evaluation_summary(spark, sf):
    got = _evaluated(spark, sf).summary
    names = ["brier_mean", "brier_worst", "roc_auc_mean", "roc_auc_worst", "ece_mean", "mean_coverage", "mean_absolute_coverage_gap"]
    return rounded(got.select("model", "folds", "coverage_folds", *names), *names)


WIDE = """scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, 0.01E0 + 0.98E0 * l_extendedprice / 120000.0E0 AS p, CAST(year(l_shipdate) - 1994 AS INT) AS fold FROM lineitem)"""


def _wide(spark, sf):
    return V.read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.lit(0.01) + F.lit(0.98) * F.col("l_extendedprice") / 120000.0).alias("p"), (F.year("l_shipdate") - 1994).alias("fold"))


@query(f"""WITH {WIDE}, s AS (SELECT fold, p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER a AS np, sum(n - pos) OVER a AS nn FROM s WINDOW w AS (PARTITION BY fold ORDER BY p DESC), a AS (PARTITION BY fold))
  SELECT fold, round(sum(pos * tp / k::DOUBLE) / max(np), 6) AS average_precision, round(sum(pos * ((nn - (k - tp)) + (n - pos) / 2.0E0)) / (max(np) * max(nn)), 6) AS roc_auc FROM c GROUP BY 1""")
def ranking_distinct_scores(spark, sf):
    from ..functions.metrics import ranking

    return rounded(ranking(_wide(spark, sf), ["fold"]), "average_precision", "roc_auc")


@query(f"WITH {_bins('quantile').replace(V.SCORED, WIDE)} SELECT fold, bin, cell_count, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, round(gap, 6) AS gap FROM t")
def reliability_distinct_scores(spark, sf):
    from ..functions.metrics import reliability

    return rounded(reliability(_wide(spark, sf), ["fold"]), "mean_p", "mean_y", "gap")


@query(f"""WITH {WIDE}, s AS (SELECT fold, CASE WHEN y = 1 THEN 1 - p ELSE p END AS score FROM scored), f AS (SELECT DISTINCT fold AS later FROM scored),
  r AS (SELECT later, score, row_number() OVER (PARTITION BY later ORDER BY score) AS k, count(*) OVER (PARTITION BY later) AS n FROM s JOIN f ON s.fold < f.later),
  q AS (SELECT later AS fold, min(score) AS q_hat, max(n) AS calibration_rows FROM r WHERE k >= greatest(least(ceil(round((n + 1) * 0.9E0, 9)), n), 1) GROUP BY 1)
  SELECT fold, round(max(q_hat), 9) AS q_hat, max(calibration_rows) AS calibration_rows, round(avg(CASE WHEN (y = 1 AND 1 - p <= q_hat) OR (y = 0 AND p <= q_hat) THEN 1.0E0 ELSE 0 END), 6) AS coverage FROM scored JOIN q USING (fold) GROUP BY 1""")
def conformal_distinct_scores(spark, sf):
    from ..functions.metrics import temporal_coverage

    got = temporal_coverage(_wide(spark, sf), 0.9).select("fold", "q_hat", "calibration_rows", "coverage")
    return got.withColumns({"q_hat": F.round("q_hat", 9), "coverage": F.round("coverage", 6)})


@query("SELECT c_custkey, (c_custkey - 1990.0E0) / 5.0E0 AS step FROM customer")
def time_steps(spark, sf):
    from ..operators.features import time_step

    return V.read(spark, sf, "customer").select("c_custkey", time_step(F.col("c_custkey"), 1990, 5).alias("step"))


@query()
def separated_epoch_samples(spark, sf):
    """Greedy picks in key order depend on each other, so there is no SQL; tests check distances, sizes and weights."""
    from .queries import GRID

    c = V.cells(spark, sf)
    c = GRID.with_coordinates(c.withColumns({"built_a": F.col("raw"), "built_b": (F.col("q") > 25 * F.col("obs")).cast("int"), "valid_a": F.col("valid"), "valid_b": F.lit(1)}))
    return G.sample_epoch(c, ["a", "b"], {"unanimous_nonbuilt": 20, "disagreement": 20, "unanimous_built": 20}, 42, 60.0).select("epoch", "stratum_name", "sample_id", "population", "sample_size", "sample_weight", "used_distance_m")


@query(f"""WITH {V.CELLS} SELECT epoch, "row", col, CASE WHEN valid = 1 AND obs > 1 THEN 1 ELSE 0 END AS common_valid, raw + CASE WHEN q > 25 * obs THEN 1 ELSE 0 END AS vote,
  CASE raw + CASE WHEN q > 25 * obs THEN 1 ELSE 0 END WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS stratum FROM cells""")
def vote_strata_map(spark, sf):
    from ..operators.sampling import vote_strata

    c = V.cells(spark, sf).withColumns({"built_a": F.col("raw"), "built_b": (F.col("q") > 25 * F.col("obs")).cast("int"), "valid_a": F.col("valid"), "valid_b": (F.col("obs") > 1).cast("int")})
    return vote_strata(c, ["a", "b"]).select("epoch", "row", "col", "common_valid", "vote", "stratum")


@query("""WITH s AS (SELECT s_nationkey, round(max(s_acctbal) / 1E4, 2) AS m, round(min(s_acctbal) / 1E3, 0) AS f, CAST(count(*) AS DOUBLE) AS r, s_nationkey::VARCHAR AS method FROM supplier GROUP BY s_nationkey),
  a AS (SELECT * FROM s WHERE m >= (SELECT max(m) FROM s) - 0.02E0), b AS (SELECT * FROM a WHERE abs(f - (SELECT max(f) FROM a)) <= 1E-12 + 1E-5 * abs((SELECT max(f) FROM a))), c AS (SELECT * FROM b WHERE abs(r - (SELECT min(r) FROM b)) <= 1E-12 + 1E-5 * abs((SELECT min(r) FROM b)))
  SELECT CASE WHEN count(*) = 1 THEN 'PASS' ELSE 'MANUAL_DECISION_REQUIRED' END AS status, CASE WHEN count(*) = 1 THEN max(method) END AS method FROM c""")
def method_choice(spark, sf):
    from ..operators.sampling import select_method

    s = V.read(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("method"))
    scores = s.agg(F.round(F.max("s_acctbal") / 1e4, 2).alias("mean_yearly_weighted_f1"), F.round(F.min("s_acctbal") / 1e3, 0).alias("minimum_yearly_weighted_f1"), F.count("*").cast("double").alias("reversal_rate"))
    return spark.createDataFrame([select_method(scores, 0.02)], "status string, method string")


@query("""SELECT doc_id, regexp_replace(strip_accents(lower(replace(replace(nfc_normalize(coalesce(source, '') || ' ' || coalesce(lang, '') || ' Éß  '), 'ß', 'ss'), 'ẞ', 'ss'))), '^\\s+|\\s+$', '', 'g') AS name FROM documents""")
def normalised_names(spark, sf):
    from ..functions.text import normalise

    name = F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" Éß  "))
    return V.read(spark, sf, "documents").select("doc_id", normalise(name).alias("name"))
