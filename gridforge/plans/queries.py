"""Queries over whole tables, one for each group of operators, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import catalog, features, grid, histogram, indices, qa, sampling, states, stencil
from ..streaming.monthly import windowed_summary
from . import views as V

GRID = grid.GridSpec(30.0, V.SIDE, V.SIDE, 762570.0, 444150.0)
CELL = ["row", "col"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


STATES = V.CELLS + """, marked AS (
  SELECT *, coalesce(max(CASE WHEN valid = 1 THEN raw END) OVER (PARTITION BY "row", col ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ever FROM cells
), states AS (
  SELECT epoch, "row", col, obs, raw, valid, CASE WHEN valid = 1 THEN greatest(raw, ever) END AS final, CASE WHEN valid = 1 AND raw = 0 AND ever = 1 THEN 1 ELSE 0 END AS corrected FROM marked)"""
PAIRS = STATES + """, pairs AS (
  SELECT a.epoch, a.epoch + 1 AS target_epoch, a."row", a.col, a.raw,
         CASE WHEN a.valid = 1 AND coalesce(b.valid, 0) = 1 THEN 1 ELSE 0 END AS common,
         CASE WHEN a.valid = 1 AND coalesce(b.valid, 0) = 1 AND a.final = 0 THEN 1 ELSE 0 END AS eligible,
         CASE WHEN a.valid = 1 AND coalesce(b.valid, 0) = 1 AND a.final = 0 THEN CASE WHEN b.final = 1 THEN 1 ELSE 0 END END AS target,
         CASE WHEN a.valid = 1 AND coalesce(b.valid, 0) = 1 AND a.raw = 1 AND b.raw = 0 THEN 1 ELSE 0 END AS reversal,
         CASE WHEN NOT (a.valid = 1 AND coalesce(b.valid, 0) = 1) THEN 0 WHEN a.obs >= 5 AND b.obs >= 5 AND b.corrected = 0 THEN 2 ELSE 1 END AS quality
  FROM states a LEFT JOIN states b ON a."row" = b."row" AND a.col = b.col AND b.epoch = a.epoch + 1)"""


def _states(spark, sf):
    return states.absorbing(V.cells(spark, sf), CELL)


def _pairs(spark, sf):
    return states.transitions(_states(spark, sf), CELL, least_count=5)


@query(f'WITH {STATES} SELECT epoch, "row", col, final, corrected FROM states')
def absorbing_state(spark, sf):
    return _states(spark, sf).select("epoch", "row", "col", "final", "corrected")


@query(f'WITH {PAIRS} SELECT epoch, target_epoch, "row", col, common, eligible, target, reversal, quality FROM pairs')
def transition_labels(spark, sf):
    return _pairs(spark, sf).select("epoch", "target_epoch", "row", "col", "common", "eligible", "target", "reversal", "quality")


@query(f"""WITH {PAIRS} SELECT epoch AS period_start, target_epoch AS period_end, CAST(sum(common) AS BIGINT) AS common_valid_cells, CAST(sum(eligible) AS BIGINT) AS eligible_nonbuilt_cells,
  CAST(coalesce(sum(target), 0) AS BIGINT) AS new_built_cells, round(sum(eligible) * 0.09E0, 6) AS eligible_nonbuilt_area_ha, round(coalesce(sum(target), 0) * 0.09E0, 6) AS observed_new_built_area_ha FROM pairs GROUP BY 1, 2""")
def demand_by_transition(spark, sf):
    return rounded(states.demand(_pairs(spark, sf)), "eligible_nonbuilt_area_ha", "observed_new_built_area_ha")


@query(f"WITH {PAIRS} SELECT epoch, CAST(sum(common * raw) AS BIGINT) AS built_cells, CAST(sum(reversal) AS BIGINT) AS reversals, round(sum(reversal) / nullif(sum(common * raw), 0)::DOUBLE, 6) AS reversal_rate FROM pairs GROUP BY 1")
def reversal_rate(spark, sf):
    return rounded(states.reversal_rate(_pairs(spark, sf), ["epoch"]), "reversal_rate").withColumn("built_cells", F.col("built_cells").cast("long"))


@query(f"WITH {STATES} SELECT epoch, CAST(sum(corrected) AS BIGINT) AS corrections, CAST(sum(final) AS BIGINT) AS built_cells FROM states GROUP BY 1")
def state_correction_count(spark, sf):
    return _states(spark, sf).groupBy("epoch").agg(F.sum("corrected").alias("corrections"), F.sum("final").alias("built_cells"))


@query(f'WITH {V.CELLS} SELECT "row", col, CASE WHEN sum(valid) = 7 THEN 1 ELSE 0 END AS supported FROM cells GROUP BY 1, 2')
def tracking_support(spark, sf):
    return states.tracking_support(V.cells(spark, sf), CELL, 7)


@query(f"""WITH {V.CELLS}, keys AS (SELECT DISTINCT "row", col FROM cells) SELECT "row", col, CAST("row" AS BIGINT) * 40 + col AS cell_id, 762570.0E0 + (col + 0.5E0) * 30.0E0 AS x_m, 444150.0E0 - ("row" + 0.5E0) * 30.0E0 AS y_m FROM keys""")
def cell_coordinates(spark, sf):
    return GRID.with_coordinates(V.cells(spark, sf).select("row", "col").distinct())


@query("""SELECT s_suppkey, CAST(floor((s_suppkey % 1200) / 30.0E0) AS BIGINT) AS col, CAST(floor((s_suppkey * 7 % 1200) / 30.0E0) AS BIGINT) AS "row", CAST(floor((s_suppkey * 7 % 1200) / 30.0E0) AS BIGINT) * 40 + CAST(floor((s_suppkey % 1200) / 30.0E0) AS BIGINT) AS cell_id FROM supplier""")
def cell_index_inverse(spark, sf):
    points = V.read(spark, sf, "supplier").select("s_suppkey", (F.lit(762570.0) + F.col("s_suppkey") % 1200).alias("x_m"), (F.lit(444150.0) - (F.col("s_suppkey") * 7) % 1200).alias("y_m"))
    return GRID.inverse(points).select("s_suppkey", "col", "row", "cell_id")


@query(f"""WITH {V.CELLS}, keys AS (SELECT DISTINCT "row", col FROM cells) SELECT CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, CAST("row" AS BIGINT) * 40 + col AS cell_id, 762570.0E0 + (col + 0.5E0) * 30.0E0 AS x_m, 444150.0E0 - ("row" + 0.5E0) * 30.0E0 AS y_m FROM keys""")
def coordinate_repair(spark, sf):
    broken = V.cells(spark, sf).select("row", "col").distinct().select((F.col("col") + 0.5).alias("x_m"), (F.col("row") + 0.5).alias("y_m"), F.lit(-1).cast("long").alias("row"), F.lit(-1).cast("long").alias("col"), F.lit(0).cast("long").alias("cell_id"))
    return GRID.repair(broken).select("row", "col", "cell_id", "x_m", "y_m")


@query("SELECT s_suppkey, floor((s_acctbal - 5.0E0) / 30.0E0) * 30.0E0 + 5.0E0 AS down, ceil((s_acctbal - 5.0E0) / 30.0E0) * 30.0E0 + 5.0E0 AS up FROM supplier")
def snapped_extent(spark, sf):
    return V.read(spark, sf, "supplier").select("s_suppkey", grid.snap_down(F.col("s_acctbal"), 30.0, 5.0).alias("down"), grid.snap_up(F.col("s_acctbal"), 30.0, 5.0).alias("up"))


@query("""SELECT o_orderkey, (o_orderkey & 1) = 0 AND (o_orderkey & 2) = 0 AND (o_orderkey & 8) = 0 AND (o_orderkey & 16) = 0 AND (o_orderkey & 32) = 0
  AND NOT ((o_orderkey & 4) <> 0 AND o_custkey % 3 = 0) AND o_custkey % 5 = 0 AS valid FROM orders""")
def qa_bit_mask(spark, sf):
    o = V.read(spark, sf, "orders")
    sensor = F.when(F.col("o_custkey") % 3 == 0, "LC08").otherwise("LT05")
    return o.select("o_orderkey", qa.valid_mask(F.col("o_orderkey"), F.col("o_custkey") % 5, sensor, [F.col("o_totalprice")]).alias("valid"))


@query(f"""WITH {V.CELLS} SELECT epoch, "row", col, CASE WHEN valid = 1 THEN round(q * 2.75E-5 - 0.2E0, 9) END AS blue, CASE WHEN valid = 1 THEN round(p * 2.75E-5 - 0.2E0, 9) END AS nir FROM cells""")
def surface_reflectance(spark, sf):
    out = qa.surface_reflectance(V.cells(spark, sf), F.col("valid") == 1, {"q": "blue", "p": "nir"})
    return out.select("epoch", "row", "col", F.round("blue", 9).alias("blue"), F.round("nir", 9).alias("nir"))


@query("""SELECT CAST(year(l_shipdate) AS INT) AS epoch, CAST(l_partkey % 40 AS INT) AS "row", round(median(l_quantity), 6) AS blue, round(median(l_extendedprice), 6) AS nir, count(*) AS valid_observation_count FROM lineitem GROUP BY 1, 2""")
def median_composite(spark, sf):
    li = V.read(spark, sf, "lineitem").select(F.year("l_shipdate").alias("epoch"), (F.col("l_partkey") % 40).cast("int").alias("row"), F.col("l_quantity").alias("blue"), F.col("l_extendedprice").alias("nir"))
    return rounded(qa.composite(li, ["epoch", "row"], ("blue", "nir")), "blue", "nir")


_R = "CASE WHEN abs({b}) > 1e-6 THEN ({a}) / ({b}) END"
INDEXED = V.CELLS + ", " + V.BANDS + f""", one AS (
  SELECT epoch, "row", col, red, swir1, swir2, {_R.format(a="(nir - red) * 1.5E0", b="nir + red + 0.5E0")} AS savi, {_R.format(a="green - swir1", b="green + swir1")} AS mndwi,
         {_R.format(a="swir1 - nir", b="swir1 + nir")} AS ndbi, {_R.format(a="swir1 - blue", b="swir1 + blue")} AS vbswir1_bi, sqrt(red * swir1) AS g FROM bands WHERE valid = 1
), indexed AS (
  SELECT epoch, "row", col, savi, mndwi, ndbi, vbswir1_bi, {_R.format(a="ndbi - (savi + mndwi) / 2", b="ndbi + (savi + mndwi) / 2")} AS ibi, ndbi - savi - mndwi AS ibui,
         {_R.format(a="swir2 + g - (red + swir1)", b="swir2 + g + red + swir1")} AS ndbsui FROM one)"""


def _indexed(spark, sf):
    return indices.with_indices(V.bands(spark, sf).filter("valid = 1"), count="obs", least=3)


@query(f'WITH {INDEXED} SELECT epoch, "row", col, ' + ", ".join(f"round({c}, 6) AS {c}" for c in indices.INDICES) + " FROM indexed")
def spectral_indices(spark, sf):
    return rounded(_indexed(spark, sf), *indices.INDICES).select("epoch", "row", "col", *indices.INDICES)


@query(f"WITH {INDEXED} SELECT epoch, count(savi) AS savi, count(ibi) AS ibi, count(ndbsui) AS ndbsui, count(*) AS n_rows FROM indexed GROUP BY 1")
def index_validity(spark, sf):
    return _indexed(spark, sf).groupBy("epoch").agg(*[F.count(c).alias(c) for c in ("savi", "ibi", "ndbsui")], F.count("*").alias("n_rows"))


HIST = INDEXED + """, placed AS (SELECT epoch, ndbi AS value, CAST(least(greatest(floor((ndbi + 1) / (2.0E0 / 64)), 0), 63) AS INT) AS bucket FROM indexed WHERE ndbi IS NOT NULL),
hist AS (SELECT epoch, bucket, avg(value) AS bucket_mean, count(*) AS bucket_count FROM placed GROUP BY 1, 2)"""


def _hist(spark, sf):
    return histogram.histogram(_indexed(spark, sf).select("epoch", F.col("ndbi").alias("value")), ["epoch"], buckets=64, bounds=(-1.0, 1.0))


@query(f"WITH {HIST} SELECT epoch, bucket, round(bucket_mean, 6) AS bucket_mean, bucket_count FROM hist")
def index_histogram(spark, sf):
    return rounded(_hist(spark, sf), "bucket_mean")


OTSU = HIST + """, sums AS (
  SELECT *, sum(bucket_count) OVER w AS w0, sum(bucket_count * bucket_mean) OVER w AS s0, sum(bucket_count) OVER (PARTITION BY epoch) AS n, sum(bucket_count * bucket_mean) OVER (PARTITION BY epoch) AS s,
         lead(bucket_mean) OVER (PARTITION BY epoch ORDER BY bucket_mean) AS nxt FROM hist WINDOW w AS (PARTITION BY epoch ORDER BY bucket_mean)
), split AS (
  SELECT epoch, bucket_mean, nxt, n, round(w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) * (s0 / w0 - (s - s0) / (n - w0)) / (n * n), 12) AS variance FROM sums WHERE nxt IS NOT NULL
), best AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY variance DESC, bucket_mean) AS k FROM split),
otsu AS (SELECT epoch, (bucket_mean + nxt) / 2 AS threshold, n FROM best WHERE k = 1)"""


@query(f"WITH {OTSU} SELECT epoch, 'PASS' AS status, round(threshold, 6) AS threshold, (SELECT count(*) FROM hist h WHERE h.epoch = otsu.epoch) AS bucket_count, CAST(n AS BIGINT) AS valid_pixel_count FROM otsu")
def otsu_threshold(spark, sf):
    return rounded(histogram.otsu(_hist(spark, sf), ["epoch"]), "threshold")


@query(f"WITH {HIST}, c AS (SELECT *, sum(bucket_count) OVER (PARTITION BY epoch ORDER BY bucket_mean) AS upto, sum(bucket_count) OVER (PARTITION BY epoch) AS n FROM hist) SELECT epoch, round(min(bucket_mean), 6) AS quantile FROM c WHERE upto >= 0.98E0 * n GROUP BY 1")
def histogram_quantile(spark, sf):
    return rounded(histogram.histogram_quantile(_hist(spark, sf), ["epoch"], 0.98), "quantile")


def _classified(spark, sf):
    thresholds = histogram.otsu(_hist(spark, sf), ["epoch"]).select("epoch", "threshold")
    return indices.classify(_indexed(spark, sf), thresholds, ["epoch"], "ndbi")


@query(f'WITH {OTSU} SELECT epoch, count(*) AS valid_cells, CAST(sum(CASE WHEN ndbi > threshold THEN 1 ELSE 0 END) AS BIGINT) AS built_cells FROM indexed JOIN otsu USING (epoch) WHERE ndbi IS NOT NULL GROUP BY 1')
def classify_built(spark, sf):
    return _classified(spark, sf).filter("valid = 1").groupBy("epoch").agg(F.count("*").alias("valid_cells"), F.sum("built").alias("built_cells"))


@query(f"""WITH {OTSU}, area AS (SELECT epoch, sum(CASE WHEN ndbi > threshold THEN 1 ELSE 0 END) * 0.09E0 AS ha FROM indexed JOIN otsu USING (epoch) GROUP BY 1)
  SELECT epoch, round(ha, 6) AS built_area_ha, round(ha - lag(ha) OVER (ORDER BY epoch), 6) AS change_from_previous_epoch_ha FROM area""")
def area_change(spark, sf):
    area = _classified(spark, sf).groupBy("epoch").agg((F.sum("built") * 0.09).alias("built_area_ha")).withColumn("index_name", F.lit("ndbi"))
    return rounded(histogram.area_change(area, ["index_name"], "built_area_ha"), "built_area_ha", "change_from_previous_epoch_ha").drop("index_name")


DENSE = STATES + """, dense AS (
  SELECT e.epoch, CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS col, coalesce(s.valid, 0) AS v, CASE WHEN s.valid = 1 THEN coalesce(s.final, 0) ELSE 0 END AS b
  FROM (SELECT DISTINCT epoch FROM cells) e, range(40) r(i), range(40) c(i) LEFT JOIN states s ON s.epoch = e.epoch AND s."row" = r.i AND s.col = c.i)"""


def _dense(spark, sf):
    s = _states(spark, sf).select("epoch", "row", "col", "valid", F.col("final").alias("built"))
    return grid.densify(s, V.SIDE, V.SIDE, s.select("epoch").distinct())


def _box_query(size: int) -> None:
    r = size // 2

    def box(spark, sf):
        out = stencil.built_fraction(_dense(spark, sf), size)
        return rounded(out, "built_fraction", "valid_fraction").select("epoch", "row", "col", "built_fraction", "valid_fraction")

    box.__name__ = f"box_sum_{size}"
    query(f"""WITH {DENSE} SELECT a.epoch, a."row", a.col, round(CASE WHEN sum(n.v) > 0 THEN sum(n.b) / sum(n.v)::DOUBLE ELSE 0 END, 6) AS built_fraction, round(sum(n.v) / {float(size * size)}E0, 6) AS valid_fraction
      FROM dense a JOIN dense n ON n.epoch = a.epoch AND n."row" BETWEEN a."row" - {r} AND a."row" + {r} AND n.col BETWEEN a.col - {r} AND a.col + {r} GROUP BY 1, 2, 3""")(box)


for _size in (3, 5, 11):
    _box_query(_size)


@query(f"""WITH {PAIRS}, grown AS (SELECT target_epoch AS epoch, "row", col, coalesce(target, 0) AS g, common AS c FROM pairs),
  dense AS (SELECT e.epoch, CAST(r.i AS INT) AS "row", CAST(k.i AS INT) AS col, coalesce(s.g, 0) AS g, coalesce(s.c, 0) AS c FROM (SELECT DISTINCT epoch FROM grown) e, range(40) r(i), range(40) k(i) LEFT JOIN grown s ON s.epoch = e.epoch AND s."row" = r.i AND s.col = k.i)
  SELECT a.epoch, a."row", a.col, round(CASE WHEN sum(n.c) > 0 THEN sum(n.g) / sum(n.c)::DOUBLE ELSE 0 END, 6) AS growth, CASE WHEN sum(n.c) > 0 THEN 1 ELSE 0 END AS available
  FROM dense a JOIN dense n ON n.epoch = a.epoch AND n."row" BETWEEN a."row" - 2 AND a."row" + 2 AND n.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2, 3""")
def recent_growth(spark, sf):
    p = _pairs(spark, sf).select(F.col("target_epoch").alias("epoch"), "row", "col", "target", "common")
    return rounded(stencil.recent_growth(grid.densify(p, V.SIDE, V.SIDE, p.select("epoch").distinct()), 5), "growth").select("epoch", "row", "col", "growth", "available")


@query(f"""WITH {DENSE}, built AS (SELECT epoch, "row" AS br, col AS bc FROM dense WHERE b = 1)
  SELECT d.epoch, d."row", d.col, round(min(sqrt((d."row" - br) * (d."row" - br) + (d.col - bc) * (d.col - bc))) * 30.0E0, 6) AS distance_m FROM dense d LEFT JOIN built USING (epoch) GROUP BY 1, 2, 3""")
def distance_to_built(spark, sf):
    return rounded(stencil.distance_to_built(_dense(spark, sf), 30.0), "distance_m")


@query(f"""WITH RECURSIVE {STATES}, built AS (SELECT epoch, "row", col FROM states WHERE final = 1),
  reach AS (SELECT epoch, "row", col, "row" * 40 + col AS root FROM built UNION SELECT b.epoch, b."row", b.col, r.root FROM reach r JOIN built b ON b.epoch = r.epoch AND abs(b."row" - r."row") <= 1 AND abs(b.col - r.col) <= 1),
  lab AS (SELECT epoch, "row", col, min(root) AS root FROM reach GROUP BY 1, 2, 3)
  SELECT epoch, count(DISTINCT root) AS nump, round(count(*) * 0.09E0 / count(DISTINCT root), 6) AS mps_ha, round(count(*) * 0.09E0, 6) AS built_area_ha FROM lab GROUP BY 1""")
def patch_metrics(spark, sf):
    return rounded(stencil.patches(_dense(spark, sf)), "mps_ha", "built_area_ha")


@query(f"""WITH {V.CELLS}, dense AS (SELECT e.epoch, CAST(r.i AS INT) AS "row", CAST(k.i AS INT) AS col, CAST(s.q AS DOUBLE) AS z FROM (SELECT DISTINCT epoch FROM cells) e, range(40) r(i), range(40) k(i) LEFT JOIN cells s ON s.epoch = e.epoch AND s."row" = r.i AND s.col = k.i),
  g AS (SELECT epoch, "row", col, (lead(z) OVER a - lag(z) OVER a) / 60.0E0 AS dx, (lead(z) OVER d - lag(z) OVER d) / 60.0E0 AS dy FROM dense WINDOW a AS (PARTITION BY epoch, "row" ORDER BY col), d AS (PARTITION BY epoch, col ORDER BY "row"))
  SELECT epoch, "row", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope FROM g""")
def terrain_slope(spark, sf):
    c = V.cells(spark, sf).select("epoch", "row", "col", F.col("q").cast("double").alias("z"))
    dense = grid.densify(c, V.SIDE, V.SIDE, c.select("epoch").distinct())
    return rounded(stencil.slope_degrees(dense, "z", 30.0), "slope").select("epoch", "row", "col", "slope")


@query(f"""WITH {V.SCENES} SELECT epoch, "month", sensor, count(asset_id) AS scene_count, CAST(sum(CASE WHEN has_coverage THEN 1 ELSE 0 END) AS BIGINT) AS positive_scenes, round(median(valid_fraction), 6) AS median_valid_fraction, round(max(valid_fraction), 6) AS maximum_valid_fraction, median(cloud) AS median_cloud FROM scenes GROUP BY 1, 2, 3""")
def monthly_summary(spark, sf):
    return rounded(catalog.summary(V.scenes(spark, sf), ["epoch", "month", "sensor"]), "median_valid_fraction", "maximum_valid_fraction")


@query(f"""WITH {V.SCENES} SELECT epoch, count(*) AS scenes, count(*) FILTER (has_coverage) AS covering, string_agg(DISTINCT sensor, ',' ORDER BY sensor) AS sensors, min(acquired) AS first_date, max(acquired) AS last_date FROM scenes GROUP BY 1""")
def scene_inventory(spark, sf):
    return catalog.inventory(V.scenes(spark, sf))


def _windows(spark, sf):
    epochs = tuple(sorted(r.epoch for r in V.scenes(spark, sf).select("epoch").distinct().collect()))
    return catalog.candidate_windows(spark, epochs=epochs)


MODES = {"primary_only": ["click", "view"], "primary_plus_supplemental": ["click", "view", "purchase"]}
WINDOWS = V.SCENES + """, windows AS (
  SELECT epoch, printf('m%02d_%02d', m, n) AS window_name, CAST(n AS INT) AS number_of_months, make_date(epoch - CASE WHEN m + n > 13 THEN 1 ELSE 0 END, CAST(m AS INT), 1) AS window_start,
         CAST(make_date(epoch - CASE WHEN m + n > 13 THEN 1 ELSE 0 END, CAST(m AS INT), 1) + to_months(CAST(n AS INT)) AS DATE) AS window_end
  FROM (SELECT DISTINCT epoch FROM scenes) e, range(1, 13) a(m), (VALUES (3), (4), (6), (12)) b(n)
), modes(sensor_mode, sensor) AS (VALUES ('primary_only', 'click'), ('primary_only', 'view'), ('primary_plus_supplemental', 'click'), ('primary_plus_supplemental', 'view'), ('primary_plus_supplemental', 'purchase')),
observed AS (SELECT w.*, sensor_mode, asset_id, user_id FROM scenes s JOIN windows w ON s.epoch = w.epoch AND acquired >= window_start AND acquired < window_end JOIN modes USING (sensor) WHERE has_coverage)"""
WKEY = ["epoch", "window_name", "number_of_months", "window_start", "window_end", "sensor_mode"]


def _observed(spark, sf):
    return catalog.window_join(V.scenes(spark, sf), _windows(spark, sf), MODES)


@query(f"WITH {WINDOWS} SELECT epoch, window_name, number_of_months, window_start, window_end, sensor_mode, count(*) AS scene_count FROM observed GROUP BY ALL")
def window_range_join(spark, sf):
    return _observed(spark, sf).groupBy(*WKEY).agg(F.count("*").alias("scene_count"))


METRICS = WINDOWS + """, core AS (SELECT count(DISTINCT user_id) AS n FROM events), counts AS (SELECT epoch, window_name, number_of_months, sensor_mode, user_id, count(*) AS n FROM observed GROUP BY ALL),
grid AS (SELECT k.*, u.user_id, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT epoch, window_name, number_of_months, sensor_mode FROM observed) k CROSS JOIN (SELECT DISTINCT user_id FROM events) u LEFT JOIN counts c ON c.epoch = k.epoch AND c.window_name = k.window_name AND c.sensor_mode = k.sensor_mode AND c.user_id = u.user_id),
metrics AS (SELECT epoch, window_name, number_of_months, sensor_mode, 100.0E0 * count(*) FILTER (n >= 1) / count(*) AS c1, 100.0E0 * count(*) FILTER (n >= 3) / count(*) AS c3, avg(n) AS mean_n, median(n) AS median_n, max(n) AS max_n, sum(n) AS scene_count FROM grid GROUP BY ALL)"""


def _metrics(spark, sf):
    observed = _observed(spark, sf).withColumnRenamed("user_id", "cell_id")
    core = V.read(spark, sf, "events").select(F.col("user_id").alias("cell_id")).distinct()
    keys = ["epoch", "window_name", "number_of_months", "sensor_mode"]
    return catalog.observation_metrics(observed, core, keys).withColumnRenamed("observations", "scene_count")


@query(f"WITH {METRICS} SELECT epoch, window_name, number_of_months, sensor_mode, round(c1, 6) AS coverage_at_least_1_core_pct, round(c3, 6) AS coverage_at_least_3_core_pct, round(mean_n, 6) AS mean_valid_observations_core, median_n AS median_valid_observations_core, max_n AS maximum_valid_observations_core, CAST(scene_count AS BIGINT) AS scene_count FROM metrics")
def window_summary(spark, sf):
    return rounded(_metrics(spark, sf), "coverage_at_least_1_core_pct", "coverage_at_least_3_core_pct", "mean_valid_observations_core")


@query(f"""WITH {METRICS}, pair AS (SELECT epoch, window_name, number_of_months, max(c1) FILTER (sensor_mode = 'primary_only') AS p1, max(c1) FILTER (sensor_mode <> 'primary_only') AS s1 FROM metrics GROUP BY ALL),
  one AS (SELECT m.* FROM metrics m JOIN pair USING (epoch, window_name) WHERE m.sensor_mode = CASE WHEN p1 < 95 AND s1 - p1 > 0.5 THEN 'primary_plus_supplemental' ELSE 'primary_only' END),
  good AS (SELECT *, c1 >= 95 AS ok, min(CASE WHEN c1 >= 95 THEN number_of_months END) OVER (PARTITION BY epoch) AS shortest FROM one),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY CASE WHEN shortest IS NULL THEN 0 WHEN ok AND number_of_months = shortest THEN 0 ELSE 1 END,
     CASE WHEN shortest IS NOT NULL THEN CASE WHEN c3 >= 80 THEN 0 ELSE 1 END ELSE -c1 END, -c3, -median_n, CASE WHEN shortest IS NULL THEN number_of_months ELSE -c1 END, scene_count DESC, window_name) AS k FROM good)
  SELECT epoch, window_name, sensor_mode, CASE WHEN shortest IS NULL THEN 'FALLBACK_BELOW_95' ELSE 'PASS_SHORTEST_ACCEPTABLE' END AS selection_status FROM ranked WHERE k = 1""")
def select_window(spark, sf):
    return catalog.select_protocol(_metrics(spark, sf)).select("epoch", "window_name", "sensor_mode", "selection_status")


@query("""WITH o AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 200000), n AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F')
  SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'ADDED' WHEN n.id IS NULL THEN 'REMOVED' ELSE 'UNCHANGED' END AS change FROM o FULL OUTER JOIN n ON o.id = n.id""")
def manifest_full_outer(spark, sf):
    o = V.read(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    return catalog.compare_selections(o.filter("o_totalprice > 200000"), o.filter("o_orderstatus = 'F'"), ["id"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join_check(spark, sf):
    urgent = V.read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return V.read(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dimension_join(spark, sf):
    return V.read(spark, sf, "customer").join(V.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")


@query("SELECT p_partkey, p_name, l.n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON p_partkey = l_partkey")
def one_to_one_join(spark, sf):
    n = V.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return features.one_to_one(V.read(spark, sf, "part").select("p_partkey", "p_name"), n, ["p_partkey"])


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def split_overlap(spark, sf):
    o = V.read(spark, sf, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").intersect(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query(f"WITH {V.SCENES} SELECT epoch, sensor, asset_id, round(valid_fraction, 6) AS valid_fraction FROM (SELECT *, row_number() OVER (PARTITION BY epoch, sensor ORDER BY valid_fraction DESC, asset_id) AS k FROM scenes) WHERE k = 1")
def scene_dedup_distinct_on(spark, sf):
    return rounded(catalog.distinct_on(V.scenes(spark, sf), ["epoch", "sensor"], [F.desc("valid_fraction"), F.asc("asset_id")]), "valid_fraction").select("epoch", "sensor", "asset_id", "valid_fraction")


@query("SELECT CAST(year(ts) AS INT) AS epoch, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS view FROM events GROUP BY 1")
def sensor_crosstab(spark, sf):
    return V.scenes(spark, sf).groupBy("epoch").pivot("sensor", ["click", "view"]).agg(F.count("asset_id")).fillna(0)


SAMPLE = V.CELLS + """, latest AS (SELECT *, CASE WHEN raw = 1 THEN 1 ELSE 0 END + CASE WHEN obs > 5 THEN 1 ELSE 0 END AS stratum, CAST("row" AS BIGINT) * 40 + col AS cell_id FROM cells WHERE valid = 1),
  keyed AS (SELECT epoch, stratum, cell_id, sha256('7:' || epoch || ':' || stratum || ':' || cell_id) AS key, count(*) OVER (PARTITION BY epoch, stratum) AS population FROM latest),
  chosen AS (SELECT *, row_number() OVER (PARTITION BY epoch, stratum ORDER BY key, cell_id) AS place FROM keyed)"""


def _sampled(spark, sf):
    c = V.cells(spark, sf).filter("valid = 1").withColumns({"stratum": F.col("raw") + (F.col("obs") > 5).cast("int"), "cell_id": GRID.cell_id(F.col("row"), F.col("col"))})
    return sampling.stratified_sample(c, ["epoch", "stratum"], "cell_id", 20, 7)


@query(f"WITH {SAMPLE} SELECT epoch, stratum, cell_id, key, population, least(20, population) AS sample_size, round(population / least(20, population)::DOUBLE, 6) AS weight FROM chosen WHERE place <= 20")
def stratified_sample(spark, sf):
    return rounded(_sampled(spark, sf), "weight").select("epoch", "stratum", "cell_id", "key", "population", "sample_size", "weight")


@query()
def separated_sample(spark, sf):
    return sampling.greedy_separation(GRID.with_coordinates(_sampled(spark, sf)).select("epoch", "stratum", "cell_id", "key", "x_m", "y_m"), ["epoch", "stratum"], 5, 300.0)


F1 = V.CELLS + """, m AS (SELECT epoch, valid AS truth, obs AS w, unnest(['d', 'q', 't']) AS method, unnest([CASE WHEN d > 4 * obs THEN 1 ELSE 0 END, CASE WHEN q > 20 * obs THEN 1 ELSE 0 END, CASE WHEN t > 3 * obs THEN 1 ELSE 0 END]) AS pred FROM cells),
  s AS (SELECT method, epoch, sum(w * truth * pred)::DOUBLE AS tp, sum(w * (1 - truth) * pred)::DOUBLE AS fp, sum(w * truth * (1 - pred))::DOUBLE AS fn FROM m GROUP BY 1, 2),
  f AS (SELECT method, epoch, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM s),
  f1 AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM f)"""


def _f1(spark, sf):
    n = F.col("obs")
    pred = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), (F.col(m) > k * n).cast("int").alias("pred")) for m, k in (("d", 4), ("q", 20), ("t", 3))]))
    rows = V.cells(spark, sf).withColumn("m", pred).select("epoch", F.col("valid").alias("truth"), F.col("obs").alias("weight"), "m.*")
    return sampling.weighted_f1(rows, ["method", "epoch"])


@query(f'WITH {F1} SELECT method, epoch, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1')
def weighted_f1(spark, sf):
    return rounded(_f1(spark, sf), "precision", "recall", "f1").select("method", "epoch", "precision", "recall", "f1")


@query(f"""WITH {F1}, y AS (SELECT method, round(avg(f1), 1) AS mean_yearly_weighted_f1, round(min(f1), 0) AS minimum_yearly_weighted_f1 FROM f1 GROUP BY 1), r AS (SELECT unnest(['d', 'q', 't']) AS method, unnest([0.3E0, 0.1E0, 0.2E0]) AS reversal_rate)
  SELECT method, mean_yearly_weighted_f1, reversal_rate, CAST(row_number() OVER (ORDER BY mean_yearly_weighted_f1 DESC, minimum_yearly_weighted_f1 DESC, reversal_rate, method) AS INT) AS rank FROM y JOIN r USING (method)""")
def rank_methods(spark, sf):
    """Coarse scores, so that the reversal rate decides where they tie."""
    rates = spark.createDataFrame([("d", 0.3), ("q", 0.1), ("t", 0.2)], "method string, reversal_rate double")
    scores = _f1(spark, sf).groupBy("method").agg(F.round(F.avg("f1"), 1).alias("mean_yearly_weighted_f1"), F.round(F.min("f1"), 0).alias("minimum_yearly_weighted_f1")).join(rates, "method")
    return sampling.rank_methods(scores).select("method", "mean_yearly_weighted_f1", "reversal_rate", "rank")


@query("""SELECT c_nationkey, count(*) AS n, round(avg(CASE WHEN c_acctbal <= 0 THEN 1.0E0 ELSE 0 END), 6) AS zero_share, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median, round(quantile_cont(c_acctbal, 0.95), 6) AS p95, round(quantile_cont(c_acctbal, 0.99), 6) AS p99, round(max(c_acctbal), 6) AS maximum FROM customer GROUP BY 1""")
def population_qa(spark, sf):
    q = F.percentile("c_acctbal", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = V.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg((F.col("c_acctbal") <= 0).cast("double")).alias("zero_share"), F.avg("c_acctbal").alias("mean"), q.alias("q"), F.max("c_acctbal").alias("maximum"))
    return rounded(out.select("c_nationkey", "n", "zero_share", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "maximum"), "zero_share", "mean", "median", "p95", "p99", "maximum")


@query(f"""WITH {V.SCORED} SELECT fold, count(*) AS "rows", CAST(sum(y) AS BIGINT) AS positives, round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-12), 1 - 1e-12)) ELSE ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) END), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(p) - avg(y), 6) AS bias FROM scored GROUP BY 1""")
def prob_metrics(spark, sf):
    return rounded(M.proper_scores(V.scored(spark, sf), ["fold"]), "log_loss", "brier", "bias")


@query(f"""WITH {V.SCORED}, s AS (SELECT fold, p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1, 2),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER a AS np, sum(n - pos) OVER a AS nn FROM s WINDOW w AS (PARTITION BY fold ORDER BY p DESC), a AS (PARTITION BY fold))
  SELECT fold, round(sum(pos * tp / k::DOUBLE) / max(np), 6) AS average_precision, round(sum(pos * ((nn - (k - tp)) + (n - pos) / 2.0E0)) / (max(np) * max(nn)), 6) AS roc_auc FROM c GROUP BY 1""")
def ranking_metrics(spark, sf):
    return rounded(M.ranking(V.scored(spark, sf), ["fold"]), "average_precision", "roc_auc")


@query(f"WITH {V.SCORED} SELECT fold, round(-(avg(y) * ln(0.33E0) + (1 - avg(y)) * ln(1 - 0.33E0)), 6) AS log_loss, round(avg(y) * (1 - 0.33E0) * (1 - 0.33E0) + (1 - avg(y)) * 0.33E0 * 0.33E0, 6) AS brier FROM scored GROUP BY 1")
def constant_reference(spark, sf):
    return rounded(M.constant_scores(V.scored(spark, sf), ["fold"], 0.33), "log_loss", "brier")


def _bins(strategy: str) -> str:
    edges = "list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))" if strategy == "quantile" else "[0.0E0, 0.1E0, 0.2E0, 0.3E0, 0.4E0, 0.5E0, 0.6E0, 0.7E0, 0.8E0, 0.9E0, 1.0E0]"
    return V.SCORED + f""", e AS (SELECT fold, {edges} AS e FROM scored GROUP BY fold), b AS (SELECT s.*, CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < p)) AS INT) AS bin FROM scored s JOIN e USING (fold)),
      t AS (SELECT fold, bin, count(*) AS cell_count, avg(p) AS mean_p, avg(y) AS mean_y, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY 1, 2)"""


@query(f"WITH {_bins('quantile')} SELECT fold, bin, cell_count, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, round(gap, 6) AS gap FROM t")
def reliability_quantile(spark, sf):
    return rounded(M.reliability(V.scored(spark, sf), ["fold"]), "mean_p", "mean_y", "gap")


@query(f"WITH {_bins('uniform')} SELECT fold, bin, cell_count, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, round(gap, 6) AS gap FROM t")
def reliability_uniform(spark, sf):
    return rounded(M.reliability(V.scored(spark, sf), ["fold"], strategy="uniform"), "mean_p", "mean_y", "gap")


@query(f"WITH {_bins('quantile')} SELECT fold, round(sum(cell_count * gap) / sum(cell_count), 6) AS ece FROM t GROUP BY 1")
def ece(spark, sf):
    return rounded(M.calibration_error(M.reliability(V.scored(spark, sf), ["fold"]), ["fold"]), "ece")


def _newton(steps: int = 12) -> str:
    """The line of y on logit(p) by so many Newton steps, one under the other."""
    parts = [f"{V.SCORED}, x AS (SELECT ln(p / (1 - p)) AS x, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored GROUP BY p), s0 AS (SELECT 0.0E0 AS a, 1.0E0 AS b)"]
    for k in range(steps):
        parts.append(f"""t{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(pos - n * q) AS g0, sum((pos - n * q) * x) AS g1, sum(n * q * (1 - q)) AS h0, sum(n * q * (1 - q) * x) AS h1, sum(n * q * (1 - q) * x * x) AS h2 FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS q FROM x, s{k})),
  s{k + 1} AS (SELECT a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM t{k})""")
    return f"WITH {', '.join(parts)} SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM s{steps}"


@query(_newton())
def calibration_slope(spark, sf):
    a, b = M.calibration_line(V.scored(spark, sf))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


CONFORMAL = V.SCORED + """, s AS (SELECT fold, CASE WHEN y = 1 THEN 1 - p ELSE p END AS score FROM scored), f AS (SELECT DISTINCT fold AS later FROM scored),
  r AS (SELECT later, score, row_number() OVER (PARTITION BY later ORDER BY score) AS k, count(*) OVER (PARTITION BY later) AS n FROM s JOIN f ON s.fold < f.later),
  q AS (SELECT later AS fold, min(score) AS q_hat FROM r WHERE k >= greatest(least(ceil(round((n + 1) * 0.8E0, 9)), n), 1) GROUP BY 1)"""


@query(f"""WITH {CONFORMAL}, c AS (SELECT fold, y, q_hat, p <= q_hat AS z, 1 - p <= q_hat AS o FROM scored JOIN q USING (fold))
  SELECT fold, count(*) AS "rows", round(avg(CASE WHEN (y = 1 AND o) OR (y = 0 AND z) THEN 1.0E0 ELSE 0 END), 6) AS coverage, round(avg(z::INT + o::INT), 6) AS mean_set_size, round(avg((NOT z AND NOT o)::INT), 6) AS empty_rate, round(max(q_hat), 6) AS q_hat FROM c GROUP BY 1""")
def conformal_coverage(spark, sf):
    return rounded(M.temporal_coverage(V.scored(spark, sf), 0.8), "coverage", "mean_set_size", "empty_rate", "q_hat").select("fold", "rows", "coverage", "mean_set_size", "empty_rate", "q_hat")


@query(f"WITH {V.SCORED} SELECT l_orderkey, l_linenumber, (p <= 0.55E0)::INT AS include_0, (1 - p <= 0.55E0)::INT AS include_1, CASE WHEN p <= 0.55E0 AND 1 - p <= 0.55E0 THEN '{{0,1}}' WHEN p <= 0.55E0 THEN '{{0}}' WHEN 1 - p <= 0.55E0 THEN '{{1}}' ELSE '{{}}' END AS prediction_set FROM scored")
def prediction_sets(spark, sf):
    return M.prediction_sets(V.scored(spark, sf).withColumn("q_hat", F.lit(0.55))).select("l_orderkey", "l_linenumber", "include_0", "include_1", "prediction_set")


@query(f"""WITH {V.SCORED}, m AS (SELECT fold, unnest(['a', 'b']) AS model, y, unnest([p, 1 - p]) AS p FROM scored), f AS (SELECT model, fold, avg((p - y) * (p - y)) AS brier, avg(p) - avg(y) AS bias FROM m GROUP BY 1, 2)
  SELECT model, count(DISTINCT fold) AS folds, round(avg(brier), 6) AS brier_mean, round(stddev_samp(brier), 6) AS brier_std, round(max(brier), 6) AS brier_worst FROM f GROUP BY 1""")
def metric_summary_by_model(spark, sf):
    s = V.scored(spark, sf)
    models = s.withColumn("model", F.lit("a")).unionByName(s.withColumns({"model": F.lit("b"), "p": 1 - F.col("p")}))
    return rounded(M.summarise(M.proper_scores(models, ["model", "fold"]), ["model"], ["brier"], []), "brier_mean", "brier_std", "brier_worst")


@query(f"""WITH {V.CELLS} SELECT epoch, "row", col, round(ln(1 + p), 6) AS log_population, round(ln(1 + d), 6) AS log_distance, round(t * t, 6)::DOUBLE AS slope_squared, round(q * t / 100.0E0, 6) AS built_growth, round(q / 10.0E0 * ln(1 + p), 6) AS built_population FROM cells""")
def candidate_features(spark, sf):
    c = V.cells(spark, sf).select("epoch", "row", "col", F.col("p").cast("double").alias("population_density_t"), F.col("d").cast("double").alias("distance_to_built_m_t"), F.col("t").cast("double").alias("slope_degrees"), (F.col("q") / 10.0).alias("built_fraction_11x11_t"), (F.col("t") / 10.0).alias("recent_local_growth_5y_t"))
    names = ["log_population", "log_distance", "slope_squared", "built_growth", "built_population"]
    return rounded(features.engineer(c), *names).select("epoch", "row", "col", *names)


@query(f"""WITH {V.CELLS}, m AS (SELECT avg(q) AS a, stddev_pop(q) AS s FROM cells WHERE epoch < 1999) SELECT epoch, "row", col, round((q - a) / s, 6) AS q FROM cells, m WHERE epoch >= 1999""")
def feature_standardise(spark, sf):
    c = V.cells(spark, sf)
    return rounded(features.standardise(c.filter("epoch >= 1999"), c.filter("epoch < 1999"), ["q"]), "q").select("epoch", "row", "col", "q")


@query("SELECT doc_id, contains(trim(translate(lower(text), 'àâäçéèêëîïôöùûüñáíóú', 'aaaceeeeiioouuunaiou')), 'etre') AS found FROM documents")
def accent_fold_search(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.coalesce(F.contains(T.fold_accents(F.col("text")), F.lit("etre")), F.lit(False)).alias("found"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '') AS parts, sha256('11:' || p_partkey || ':' || p_size) AS key FROM part")
def split_and_key(spark, sf):
    return V.read(spark, sf, "part").select("p_partkey", T.listed(F.replace(F.col("p_name"), F.lit(" "), F.lit(","))).alias("parts"), T.deterministic_key(11, F.col("p_partkey"), F.col("p_size")).alias("key"))


@query(f"""WITH {STATES}, c AS (SELECT epoch, count(*) AS n, 100.0E0 * count(*) FILTER (obs >= 1) / 1600 AS one, 100.0E0 * count(*) FILTER (obs >= 3) / 1600 AS three, 100.0E0 * count(*) FILTER (obs >= 5) / 1600 AS five, 100.0E0 * count(final) / 1600 AS state FROM states GROUP BY 1)
  SELECT epoch, round(one, 6) AS one, round(three, 6) AS three, round(five, 6) AS five, round(state, 6) AS state, round(one - three, 6) AS loss_three, round(three - five, 6) AS loss_five,
         CASE WHEN one - three >= three - five THEN 'three' ELSE 'five' END AS dominant_loss, one >= three AND three >= five AS monotone FROM c""")
def support_chain(spark, sf):
    part = lambda c: 100.0 * F.count_if(c) / 1600
    c = _states(spark, sf).groupBy("epoch").agg(part(F.col("obs") >= 1).alias("one"), part(F.col("obs") >= 3).alias("three"), part(F.col("obs") >= 5).alias("five"), part(F.col("final").isNotNull()).alias("state"))
    c = c.withColumns({"loss_three": F.col("one") - F.col("three"), "loss_five": F.col("three") - F.col("five")})
    c = c.withColumns({"dominant_loss": F.when(F.col("loss_three") >= F.col("loss_five"), "three").otherwise("five"), "monotone": (F.col("one") >= F.col("three")) & (F.col("three") >= F.col("five"))})
    return rounded(c, "one", "three", "five", "state", "loss_three", "loss_five")


@query(f"""WITH {V.CELLS} SELECT "row", col, max(CASE WHEN epoch = 1996 THEN valid ELSE 0 END) + 2 * max(CASE WHEN epoch = 1998 THEN valid ELSE 0 END) AS class FROM cells GROUP BY 1, 2""")
def support_class_map(spark, sf):
    at = lambda e: F.max(F.when(F.col("epoch") == e, F.col("valid")).otherwise(0))
    return V.cells(spark, sf).groupBy("row", "col").agg((at(1996) + 2 * at(1998)).alias("class"))


@query("""WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 1000 AS DOUBLE) AS y FROM supplier), c AS (SELECT CAST(c_custkey * 53 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 17 % 1000 AS DOUBLE) AS y FROM customer)
  SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.x >= s.x - 15 AND c.x <= s.x + 15 AND c.y >= s.y - 15 AND c.y <= s.y + 15) THEN 1 ELSE 0 END AS present FROM s""")
def spatial_presence_join(spark, sf):
    """Square cells against points: an equi-join on 30 m tiles (a square meets up to four), then the exact test."""
    s = V.read(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 1000).cast("double").alias("x"), (F.col("s_suppkey") * 91 % 1000).cast("double").alias("y"))
    c = V.read(spark, sf, "customer").select((F.col("c_custkey") * 53 % 1000).cast("double").alias("px"), (F.col("c_custkey") * 17 % 1000).cast("double").alias("py")).withColumns({"tx": F.floor(F.col("px") / 30), "ty": F.floor(F.col("py") / 30)})
    tiles = s.withColumn("tx", F.explode(F.sequence(F.floor((F.col("x") - 15) / 30), F.floor((F.col("x") + 15) / 30)))).withColumn("ty", F.explode(F.sequence(F.floor((F.col("y") - 15) / 30), F.floor((F.col("y") + 15) / 30))))
    hit = tiles.join(c, ["tx", "ty"]).filter((F.abs(F.col("px") - F.col("x")) <= 15) & (F.abs(F.col("py") - F.col("y")) <= 15)).select("s_suppkey").distinct().withColumn("present", F.lit(1))
    return s.select("s_suppkey").join(hit, "s_suppkey", "left").fillna({"present": 0})


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1, 2")
def windowed_events(spark, sf):
    return rounded(windowed_summary(V.read(spark, sf, "events"), late=None), "total", digits=4)


def entry_query(spark, sf) -> DataFrame:
    return demand_by_transition(spark, sf)
