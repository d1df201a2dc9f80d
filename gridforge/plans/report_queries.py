"""Queries of the report operators, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import state_space
from ..operators import grid, reports, states, stencil
from . import views as V
from .queries import CELL, GRID, STATES, query, rounded

OBS = V.CELLS + """, dense AS (SELECT e.epoch, CAST(r.i AS INT) AS "row", CAST(k.i AS INT) AS col, coalesce(s.obs, 0) AS n FROM (SELECT DISTINCT epoch FROM cells) e, range(40) r(i), range(40) k(i) LEFT JOIN cells s ON s.epoch = e.epoch AND s."row" = r.i AND s.col = k.i)"""


def _dense(spark, sf):
    c = V.cells(spark, sf).select("epoch", "row", "col", "obs", "p")
    return grid.densify(c, V.SIDE, V.SIDE, c.select("epoch").distinct())


_PCT = ", ".join(f"round(quantile_cont(n, {p}), 6)::DOUBLE AS p{round(100 * p)}" for p in (0.0, 0.25, 0.5, 0.75, 0.9, 1.0))
_COV = ", ".join(f"round(quantile_cont(n, {p}) FILTER (n > 0), 6)::DOUBLE AS covered_p{round(100 * p)}" for p in (0.25, 0.5, 0.75))


@query(f"WITH {OBS} SELECT epoch, round(avg(n), 6) AS mean, {_PCT}, {_COV} FROM dense GROUP BY 1")
def count_percentiles(spark, sf):
    out = reports.count_percentiles(_dense(spark, sf), ["epoch"], "obs")
    return rounded(out, *[c for c in out.columns if c != "epoch"])


@query(f"WITH {OBS} SELECT epoch, CAST(n AS BIGINT) AS observations, count(*) AS cells FROM dense GROUP BY 1, 2")
def count_frequency(spark, sf):
    return reports.frequency(_dense(spark, sf), ["epoch"], "obs")


@query(f"""WITH {V.CELLS}, m AS (SELECT epoch, CAST(count(*) AS DOUBLE) AS cells, CAST(sum(valid) AS DOUBLE) AS valid_cells, avg(obs) AS mean_obs FROM cells WHERE epoch IN (1996, 1999) GROUP BY 1),
  l AS (SELECT epoch, unnest(['cells', 'valid_cells', 'mean_obs']) AS metric, unnest([cells, valid_cells, mean_obs]) AS v FROM m)
  SELECT metric, round(max(v) FILTER (epoch = 1996), 6) AS "first", round(max(v) FILTER (epoch = 1999), 6) AS "second", round(max(v) FILTER (epoch = 1999) - max(v) FILTER (epoch = 1996), 6) AS difference FROM l GROUP BY 1""")
def compare_epochs(spark, sf):
    m = V.cells(spark, sf).groupBy("epoch").agg(F.count("*").alias("cells"), F.sum("valid").alias("valid_cells"), F.avg("obs").alias("mean_obs"))
    return rounded(reports.compare_epochs(m, ["cells", "valid_cells", "mean_obs"], 1996, 1999), "first", "second", "difference")


@query(f"""WITH {V.CELLS}, m AS (SELECT "row", col, sum(q) AS loss_q, sum(d) AS loss_d, sum(t) AS loss_t FROM cells GROUP BY 1, 2)
  SELECT "row", col, CASE WHEN loss_q >= loss_d AND loss_q >= loss_t THEN 'q' WHEN loss_d >= loss_t THEN 'd' ELSE 't' END AS dominant FROM m""")
def dominant_column(spark, sf):
    m = V.cells(spark, sf).groupBy("row", "col").agg(*[F.sum(c).alias(f"loss_{c}") for c in ("q", "d", "t")])
    return m.select("row", "col", reports.largest_name(["loss_q", "loss_d", "loss_t"], "loss_").alias("dominant"))


@query(f"""WITH {V.CELLS}, coarse AS (SELECT epoch, "row" // 4 AS r, col // 4 AS c, sum(p)::DOUBLE AS n FROM cells GROUP BY 1, 2, 3),
  fine AS (SELECT e.epoch, coalesce(n, 0) / 14400.0E0 * 1e6 AS density FROM (SELECT DISTINCT epoch FROM cells) e, range(40) a(i), range(40) b(i) LEFT JOIN coarse k ON k.epoch = e.epoch AND r = a.i // 4 AND c = b.i // 4),
  n AS (SELECT epoch, sum(n) AS native_total, max(n) AS native_maximum FROM coarse GROUP BY 1), f AS (SELECT epoch, sum(density) * 900 / 1e6 AS fine_total, max(density) AS maximum_density FROM fine GROUP BY 1)
  SELECT epoch, round(native_total, 3) AS native_total, round(native_maximum, 3) AS native_maximum, round(fine_total, 3) AS fine_total, round(maximum_density, 3) AS maximum_density, abs(fine_total - native_total) < 1e-6 * native_total AS agrees FROM n JOIN f USING (epoch)""")
def density_audit(spark, sf):
    c = V.cells(spark, sf)
    coarse = c.groupBy("epoch", F.floor(F.col("row") / 4).cast("int").alias("r"), F.floor(F.col("col") / 4).cast("int").alias("c")).agg(F.sum("p").alias("n"))
    every = grid.densify(c.select("epoch", "row", "col"), V.SIDE, V.SIDE, c.select("epoch").distinct()).withColumns({"r": F.floor(F.col("row") / 4).cast("int"), "c": F.floor(F.col("col") / 4).cast("int")})
    fine = every.join(coarse, ["epoch", "r", "c"], "left").withColumn("density", F.coalesce(F.col("n"), F.lit(0)) / 14400.0 * 1e6)
    out = reports.density_audit(coarse, fine, ["epoch"], "n", "density", 900.0).withColumn("agrees", F.abs(F.col("fine_total") - F.col("native_total")) < 1e-6 * F.col("native_total"))
    return rounded(out.drop("difference_pct"), "native_total", "native_maximum", "fine_total", "maximum_density", digits=3)


@query(f"""WITH {V.CELLS}, s AS (SELECT s_suppkey, s_suppkey % 1300 AS x, s_suppkey * 7 % 1300 AS y FROM supplier)
  SELECT s_suppkey, CASE WHEN obs <> 1 THEN obs END AS obs FROM s LEFT JOIN cells ON epoch = 1997 AND col = x // 30 AND "row" = y // 30""")
def raster_point_lookup(spark, sf):
    points = V.read(spark, sf, "supplier").select("s_suppkey", F.lit(1997).alias("epoch"), (F.col("s_suppkey") % 1300).alias("x"), (F.col("s_suppkey") * 7 % 1300).alias("y"))
    return reports.point_values(points, V.cells(spark, sf), ["epoch"], "x", "y", 30.0, "obs", 1).select("s_suppkey", "obs")


@query(f"""WITH {STATES}, kept AS (SELECT "row", col FROM states GROUP BY 1, 2 HAVING sum(valid) = 7)
  SELECT epoch, round(sum(final) * 0.09E0, 6) AS built_area_ha, round(sum(final) / count(*)::DOUBLE, 6) AS built_share, round(100.0E0 * count(*) / 1600, 6) AS support_pct, CASE WHEN 100.0E0 * count(*) / 1600 >= 80 THEN 'PASS' ELSE 'WARNING_LOW_SUPPORT' END AS status
  FROM states JOIN kept USING ("row", col) GROUP BY 1""")
def tracking_metrics(spark, sf):
    c = V.cells(spark, sf)
    return rounded(reports.tracking(states.absorbing(c, CELL), states.tracking_support(c, CELL, 7), CELL, 1600), "built_area_ha", "built_share", "support_pct")


@query(f"""WITH {V.SCORED}, s AS (SELECT *, CASE WHEN fold < 3 THEN 'train' WHEN fold < 5 THEN 'validation' ELSE 'test' END AS split FROM scored)
  SELECT split, fold AS origin, count(*) AS n_rows, CASE WHEN split <> 'test' THEN CAST(sum(y) AS BIGINT) END AS positives FROM s GROUP BY 1, 2""")
def split_summary(spark, sf):
    return reports.split_summary(V.scored(spark, sf), "fold", "y", {"train": [1, 2], "validation": [3, 4], "test": [5, 6, 7]}, ("train", "validation"))


@query(f"""WITH {V.CELLS}, c AS (SELECT epoch, 100.0E0 * sum(valid) / 1600 AS coverage FROM cells GROUP BY 1), f AS (SELECT * FROM c WHERE coverage >= 1), b AS (SELECT min(epoch) AS lo, max(epoch) AS hi FROM f),
  m AS (SELECT epoch FROM f, b ORDER BY abs(epoch - (lo + hi) / 2.0E0), coverage DESC, epoch LIMIT 1)
  SELECT 'earliest' AS anchor, lo AS epoch FROM b WHERE lo IS NOT NULL UNION ALL SELECT 'middle', epoch FROM m UNION ALL SELECT 'latest', hi FROM b WHERE hi IS NOT NULL""")
def anchor_epochs(spark, sf):
    return reports.anchor_epochs(V.cells(spark, sf).groupBy("epoch").agg((100.0 * F.sum("valid") / 1600).alias("coverage")), 1.0)


@query("""WITH s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT l_orderkey AS id, l_linenumber % 4 AS label, l_shipdate AS d, 1995 AS epoch FROM lineitem WHERE l_returnflag = 'R')
  SELECT (SELECT count(*) FROM l WHERE id NOT IN (SELECT id FROM s)) AS unknown_ids, (SELECT count(*) FROM s WHERE id NOT IN (SELECT id FROM l)) AS missing_ids, (SELECT count(*) FROM (SELECT id FROM l GROUP BY id HAVING count(*) > 1)) AS repeated_ids,
    (SELECT count(*) FROM l WHERE label NOT IN (0, 1)) AS bad_labels, (SELECT count(*) FROM l WHERE label IN (0, 1) AND abs(year(d) - epoch) > 2) AS bad_dates""")
def label_faults(spark, sf):
    labels = V.read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 4).alias("label"), F.col("l_shipdate").alias("d"), F.lit(1995).alias("epoch"))
    samples = V.read(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return reports.label_faults(labels, samples, "id", "label", "d", "epoch")


@query("""SELECT s_suppkey, round(2.0E0 * (1 + r * d) * exp(-r * d), 9) AS covariance FROM (SELECT s_suppkey, sqrt(3.0E0) / 1.5E0 AS r, abs(s_suppkey % 7 - s_suppkey % 11)::DOUBLE AS d FROM supplier)""")
def temporal_kernel(spark, sf):
    k = state_space.covariance_column((F.col("s_suppkey") % 7).cast("double"), (F.col("s_suppkey") % 11).cast("double"), 1.5, 2.0)
    return V.read(spark, sf, "supplier").select("s_suppkey", F.round(k, 9).alias("covariance"))


#: A triangle with a hole, in the grid's metres.
RINGS = [[(762580.0, 442960.0), (763750.0, 442990.0), (763100.0, 444130.0)], [(762990.0, 443200.0), (763300.0, 443210.0), (763120.0, 443605.0)]]
_EDGES = ", ".join(f"({a[0]}E0, {a[1]}E0, {b[0]}E0, {b[1]}E0)" for ring in RINGS for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))


@query(f"""WITH e(x1, y1, x2, y2) AS (VALUES {_EDGES}), g AS (SELECT CAST(r.i AS INT) AS "row", CAST(k.i AS INT) AS col, 762570.0E0 + (k.i + 0.5E0) * 30 AS x, 444150.0E0 - (r.i + 0.5E0) * 30 AS y FROM range(40) r(i), range(40) k(i))
  SELECT "row", col, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM g, e GROUP BY 1, 2""")
def study_mask(spark, sf):
    every = GRID.with_coordinates(grid.densify(spark.createDataFrame([], "row int, col int"), V.SIDE, V.SIDE))
    return stencil.inside_polygons(every, RINGS).select("row", "col", "inside")
