"""Queries of the models. Most fits have no SQL; tests hold them against dense oracles and finite differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import cdf_column
from ..models import cvi, logistic, space_time, sparse_gp, state_space
from . import views as V
from .queries import query, rounded

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _scored(spark, sf):
    rows = V.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"), (F.col("l_returnflag") == "R").cast("int").alias("y"), *FEATURES)
    years = [r.year for r in rows.select("year").distinct().collect()]
    return logistic.rolling(rows, "year", years, FEATURES, keep=("l_orderkey", "l_linenumber"))


@query()
def logistic_rolling(spark, sf):
    return rounded(_scored(spark, sf), "p", "prevalence", digits=4)


@query()
def logistic_fold_metrics(spark, sf):
    return rounded(logistic.fold_metrics(_scored(spark, sf)), "log_loss", "brier", "bias", "average_precision", "roc_auc", "prevalence", "prevalence_brier", digits=4)


_R2 = "(4.0E0 / 3.0E0)"
_STEP = "exp(-r * d) * (1 + r * d) AS a00, exp(-r * d) * d AS a01, -exp(-r * d) * r * r * d AS a10, exp(-r * d) * (1 - r * d) AS a11"
#: The filter forwards and the smoother backwards for a Matern-3/2 process of lengthscale 1.5, variance 1 and noise 0.15.
KALMAN = V.CELLS + f""", s AS (SELECT "row", col, epoch, raw::DOUBLE AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY "row", col) AS n, (epoch - lag(epoch) OVER w)::DOUBLE AS d, sqrt({_R2}) AS r FROM cells WINDOW w AS (PARTITION BY "row", col ORDER BY epoch)),
  t AS (SELECT *, {_STEP} FROM s),
  f AS (SELECT "row", col, k, 0.0E0 AS e0, 0.0E0 AS e1, 1.0E0 AS q00, 0.0E0 AS q01, {_R2} AS q11, v / 1.15E0 AS m0, 0.0E0 AS m1, 1 - 1 / 1.15E0 AS p00, 0.0E0 AS p01, {_R2} AS p11 FROM t WHERE k = 1
    UNION ALL SELECT "row", col, k, e0, e1, q00, q01, q11, e0 + q00 / (q00 + 0.15E0) * (v - e0), e1 + q01 / (q00 + 0.15E0) * (v - e0), q00 - q00 * q00 / (q00 + 0.15E0), q01 - q00 * q01 / (q00 + 0.15E0), q11 - q01 * q01 / (q00 + 0.15E0)
    FROM (SELECT t."row", t.col, t.k, v, a00 * m0 + a01 * m1 AS e0, a10 * m0 + a11 * m1 AS e1, 1 + a00 * a00 * (p00 - 1) + 2 * a00 * a01 * p01 + a01 * a01 * (p11 - {_R2}) AS q00,
            a00 * a10 * (p00 - 1) + (a00 * a11 + a01 * a10) * p01 + a01 * a11 * (p11 - {_R2}) AS q01, {_R2} + a10 * a10 * (p00 - 1) + 2 * a10 * a11 * p01 + a11 * a11 * (p11 - {_R2}) AS q11
          FROM f JOIN t ON t."row" = f."row" AND t.col = f.col AND t.k = f.k + 1)),
  g AS (SELECT f.*, x.e0 AS y0, x.e1 AS y1, x.q00 AS z00, x.q01 AS z01, x.q11 AS z11, ((f.p00 * a00 + f.p01 * a01) * x.q11 - (f.p00 * a10 + f.p01 * a11) * x.q01) / (x.q00 * x.q11 - x.q01 * x.q01) AS g00, ((f.p00 * a10 + f.p01 * a11) * x.q00 - (f.p00 * a00 + f.p01 * a01) * x.q01) / (x.q00 * x.q11 - x.q01 * x.q01) AS g01,
            ((f.p01 * a00 + f.p11 * a01) * x.q11 - (f.p01 * a10 + f.p11 * a11) * x.q01) / (x.q00 * x.q11 - x.q01 * x.q01) AS g10, ((f.p01 * a10 + f.p11 * a11) * x.q00 - (f.p01 * a00 + f.p11 * a01) * x.q01) / (x.q00 * x.q11 - x.q01 * x.q01) AS g11
          FROM f LEFT JOIN f x ON x."row" = f."row" AND x.col = f.col AND x.k = f.k + 1 LEFT JOIN t ON t."row" = f."row" AND t.col = f.col AND t.k = f.k + 1),
  b AS (SELECT "row", col, k, m0 AS s0, m1 AS s1, p00 AS c00, p01 AS c01, p11 AS c11 FROM g WHERE y0 IS NULL
    UNION ALL SELECT g."row", g.col, g.k, m0 + g00 * (s0 - y0) + g01 * (s1 - y1), m1 + g10 * (s0 - y0) + g11 * (s1 - y1), p00 + g00 * g00 * (c00 - z00) + 2 * g00 * g01 * (c01 - z01) + g01 * g01 * (c11 - z11),
      p01 + g00 * g10 * (c00 - z00) + (g00 * g11 + g01 * g10) * (c01 - z01) + g01 * g11 * (c11 - z11), p11 + g10 * g10 * (c00 - z00) + 2 * g10 * g11 * (c01 - z01) + g11 * g11 * (c11 - z11) FROM b JOIN g ON g."row" = b."row" AND g.col = b.col AND g.k = b.k - 1)"""


@query(f'WITH RECURSIVE {KALMAN} SELECT b."row", b.col, s.epoch::DOUBLE AS epoch, CAST(1 AS BIGINT) AS n, round(s0, 8) AS mean, round(c00, 8) AS variance FROM b JOIN s ON s."row" = b."row" AND s.col = b.col AND s.k = b.k')
def kalman_smoother(spark, sf):
    out = state_space.smooth_series(V.cells(spark, sf), ["row", "col"], "epoch", "raw", 0.15, 1.5, 1.0)
    return rounded(out, "mean", "variance", digits=8)


@query()
def inducing_points(spark, sf):
    c = V.cells(spark, sf)
    centres = space_time.inducing_points(c, "col", "row")
    epochs = sorted(r.epoch for r in c.select("epoch").distinct().collect())
    return spark.createDataFrame([tuple(map(float, r)) for r in space_time.inducing_grid(centres, epochs)], "x double, y double, time double")


@query()
def space_time_forecast(spark, sf):
    """The last epoch's cells, forecast from all earlier ones."""
    c = V.cells(spark, sf).select("epoch", "row", "col", ((F.col("epoch") - 1992) / 1.0).alias("t"), F.col("raw").alias("y"), (F.col("q") / F.col("obs") / 50.0).alias("load"))
    last = c.agg(F.max("epoch")).first()[0]
    train = c.filter(F.col("epoch") < last)
    points = space_time.inducing_points(train, "col", "row")
    model = space_time.fit(train, "t", "col", "row", ["load"], "y", points, lengthscales=(8.0, 8.0))
    return rounded(space_time.predict(c.filter(F.col("epoch") == last), model, "t", "col", "row", ["load"], ["epoch", "row", "col", "y"]), "mean", "variance", "p")


@query()
def cvi_smoother(spark, sf):
    out = cvi.smooth_labels(V.cells(spark, sf), ["row", "col"], "epoch", "raw", 1.5, 1.0)
    return rounded(out, "mean", "variance", "p", digits=6)


@query()
def sparse_gp_forecast(spark, sf):
    """The last epoch's cells, forecast by the gradient-fitted process of all earlier ones."""
    c = V.cells(spark, sf).select("epoch", "row", "col", (F.col("epoch") - 1992).cast("double").alias("t"), F.col("raw").alias("y"), (F.col("q") / F.col("obs") / 50.0).alias("load"))
    last = c.agg(F.max("epoch")).first()[0]
    train = c.filter(F.col("epoch") < last)
    times = sorted(r.t for r in train.select("t").distinct().collect())
    points = space_time.inducing_grid(space_time.inducing_points(train, "col", "row", 12), times)
    model = sparse_gp.fit(train, "col", "row", "t", ["load"], "y", points, steps=8, method="natgrad", gamma=(0.1, 0.5, 4), settings={"space_x": 8.0, "space_y": 8.0, "time": 2.0})
    return rounded(sparse_gp.predict(c.filter(F.col("epoch") == last), model, "col", "row", "t", ["load"], ["epoch", "row", "col", "y"]), "mean", "variance", "p", digits=4)


@query("""WITH RECURSIVE t AS (SELECT c_custkey, c_acctbal / 5000.0E0 AS z, 0 AS k, c_acctbal / 5000.0E0 AS term, c_acctbal / 5000.0E0 AS total FROM customer
  UNION ALL SELECT c_custkey, z, k + 1, term * z * z / (2 * k + 3), total + term * z * z / (2 * k + 3) FROM t WHERE k < 60)
  SELECT c_custkey, round(0.5E0 + exp(-z * z / 2) / sqrt(2 * pi()) * total, 9) AS p FROM t WHERE k = 60""")
def normal_probability(spark, sf):
    return V.read(spark, sf, "customer").select("c_custkey", F.round(cdf_column(F.col("c_acctbal") / 5000.0), 9).alias("p"))
