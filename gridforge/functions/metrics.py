"""Proper scores, ranking, calibration and conformal coverage, grouped by any columns without nulls.

Inputs have y (0/1) and p in [0, 1]. What needs an order first adds up by distinct score and cuts the
scores into slices at approximate quantiles (``slot``), as many as there are shuffle partitions. A
slice's rows are ordered by themselves and the sums of the slices before are added, so no task orders
a whole group, whether scores repeat or not; a quantile is looked for in its slice alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-12


def validate(df: DataFrame) -> None:
    """Labels 0 or 1 and finite probabilities in [0, 1], else ValueError. One pass."""
    bad = (~F.col("y").isin(0, 1)) | F.col("y").isNull() | F.col("p").isNull() | F.isnan("p") | ~F.col("p").between(0, 1)
    if df.agg(F.count_if(bad)).first()[0]:
        raise ValueError("labels must be 0 or 1 and probabilities in [0, 1]")


def proper_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """rows, positives, log loss (clipped at 1e-12), Brier score and bias of each group."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - CLIP)), F.lit(CLIP))
    loss = -F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"), F.avg(loss).alias("log_loss"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), (F.avg("p") - F.avg("y")).alias("bias"))


def constant_scores(df: DataFrame, by: list[str], probability: float) -> DataFrame:
    """Log loss and Brier score of one constant probability, from the class counts alone."""
    q = min(max(probability, CLIP), 1 - CLIP)
    k = F.avg(F.col("y").cast("double"))
    return df.groupBy(*by).agg((-(k * math.log(q) + (1 - k) * math.log(1 - q))).alias("log_loss"), (k * (1 - probability) ** 2 + (1 - k) * probability**2).alias("brier"))


def slot(df: DataFrame, column: str) -> Column:
    """The slice that a value lies in, by edges that the driver gets from one pass over the column."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted(set(df.approxQuantile(column, [k / parts for k in range(1, parts)], 1 / (8 * parts))))

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) <= edges[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(edges))


def running(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds for each column upto_x, its sum over the group's rows up to this one, and all_x, over the
    whole group. ``order`` has no ties in a group."""
    cut = df.withColumn("_slot", slot(df, order))
    parts = cut.groupBy(*by, "_slot").agg(*[F.sum(c).alias(c) for c in columns])  # a row a group and slice
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "_slot", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns], *[F.sum(c).over(whole).alias(f"all_{c}") for c in columns])
    inside = Window.partitionBy(*by, "_slot").orderBy(order)
    out = cut.join(offsets, [*by, "_slot"])
    out = out.withColumns({f"upto_{c}": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in columns})
    return out.drop("_slot", *[f"_before_{c}" for c in columns])


def ranking(df: DataFrame, by: list[str]) -> DataFrame:
    """Average precision (step sum, ties together) and ROC area (ties count half); NULL without both classes."""
    steps = df.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    seen = running(steps, by, "p", ["pos", "n"])
    # from the largest score down: positives and rows up to this score, itself included
    tp = F.col("all_pos") - F.col("upto_pos") + F.col("pos")
    k = F.col("all_n") - F.col("upto_n") + F.col("n")
    below = (F.col("upto_n") - F.col("n")) - (F.col("upto_pos") - F.col("pos"))  # negatives of smaller score
    area = F.sum(F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2.0))
    ones, zeros = F.max("all_pos"), F.max(F.col("all_n") - F.col("all_pos"))
    return seen.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * tp / k), ones).alias("average_precision"), F.try_divide(area, (ones * zeros).cast("double")).alias("roc_auc"))


def quantile_edges(df: DataFrame, by: list[str], bins: int) -> DataFrame:
    """(by, edges): the distinct quantiles of p at 0, 1/bins .. 1, interpolated linearly, in order; nulls
    don't count, and without any p edges is null. Edges decide where equal probabilities go, so they have
    to be DuckDB's quantile_cont to the last bit: the place is (n - 1) times the share, the value low *
    (1 - d) + high * d with one rounding less (fma), which gives x again between x and x; two plain
    products may not."""
    known = df.filter(F.col("p").isNotNull()).groupBy(*by, "p").agg(F.count("*").alias("n"))
    counts = running(known, by, "p", ["n"])
    places = F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("all_n") - 1) * F.lit(k / bins)).alias("at")) for k in range(bins + 1)])
    has = lambda place: (place >= F.col("upto_n") - F.col("n")) & (place < F.col("upto_n"))
    hits = counts.select(*by, "p", "n", "upto_n", F.explode(F.filter(places, lambda w: has(F.floor(w["at"])) | has(F.ceil(w["at"])))).alias("w")).withColumn("at", F.col("w.at"))
    ends = hits.groupBy(*by, "w.k", "at").agg(F.max(F.when(has(F.floor("at")), F.col("p"))).alias("low"), F.max(F.when(has(F.ceil("at")), F.col("p"))).alias("high"))
    share = F.col("at") - F.floor("at")
    between = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.col("low"), 1 - share, F.col("high") * share).cast("double")  # a row a group and place
    valued = ends.select(*by, F.when(share == 0, F.col("low")).otherwise(between).alias("edge"))  # before the groups: Spark takes no reflect inside of a set
    return valued.groupBy(*by).agg(F.when(F.count("edge") > 0, F.array_sort(F.collect_set("edge"))).alias("edges"))


def reliability(df: DataFrame, by: list[str], bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """(by, bin, cell_count, mean_p, mean_y, gap). Quantile edges interpolate linearly and repeated
    edges are one, so equal probabilities never part; bins are closed on the right. Rows without p are
    in the first bin, in none where their whole group has no p. Rows are added up by probability
    before they meet the edges."""
    sums = df.groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    if strategy == "quantile":
        edges = quantile_edges(df, by, bins)
        inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
        placed = sums.filter(reduce(and_, [F.col(c).isNotNull() for c in by])).join(edges, by, "left") if by else sums.join(F.broadcast(edges))  # one row without groups
        placed = placed.withColumn("bin", F.array_size(F.filter(inner, lambda e: e < F.col("p"))))
    elif strategy == "uniform":
        inner = F.array(*[F.lit(k / bins) for k in range(1, bins)])
        placed = sums.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("p"))))
    else:
        raise ValueError("strategy must be 'quantile' or 'uniform'")
    n = F.sum("n")
    out = placed.groupBy(*by, "bin").agg(n.alias("cell_count"), (F.sum(F.col("p") * F.col("n")) / F.sum(F.when(F.col("p").isNotNull(), F.col("n")))).alias("mean_p"), (F.sum("pos") / n).alias("mean_y"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def calibration_error(table: DataFrame, by: list[str]) -> DataFrame:
    return table.groupBy(*by).agg((F.sum(F.col("cell_count") * F.col("gap")) / F.sum("cell_count")).alias("ece"))


def calibration_lines(df: DataFrame, by: list[str], steps: int = 50, tolerance: float = 1e-9) -> dict[tuple, tuple[float, float]]:
    """Intercept and slope of y on logit(p) of each group, unpenalised, by Newton steps that are halved
    where the likelihood falls. Rows are added up by probability once; a step is one pass over these
    sums, and the driver sees six numbers a group. Groups whose logits don't vary, whose labels are all
    alike or whose fit doesn't settle raise ValueError."""
    clipped = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = df.groupBy(*by, F.log(clipped / (1 - clipped)).alias("x")).agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n")).persist()
    try:
        names = [tuple(r) for r in rows.select(*by).distinct().collect()] if by else [()]
        now = {g: (0.0, 1.0) for g in names}
        step = dict.fromkeys(names, (0.0, 0.0))
        best = dict.fromkeys(names, -math.inf)
        open_ = set(names)
        for _ in range(steps):
            lines = df.sparkSession.createDataFrame([(*g, *now[g]) for g in sorted(open_, key=str)], rows.select(*by, F.lit(0.0).alias("_a"), F.lit(0.0).alias("_b")).schema)
            z = F.col("_a") + F.col("_b") * F.col("x")
            q = 1 / (1 + F.exp(-z))
            w, gap = F.col("n") * q * (1 - q), F.col("pos") - F.col("n") * q
            soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))  # log(1 + exp(z))
            x = F.col("x")
            sums = [F.sum(gap), F.sum(gap * x), F.sum(w), F.sum(w * x), F.sum(w * x * x), F.sum(F.col("pos") * z - F.col("n") * soft)]
            joined = rows.join(F.broadcast(lines), by) if by else rows.join(F.broadcast(lines))  # a row a group
            for row in joined.groupBy(*by).agg(*[c.alias(f"_s{k}") for k, c in enumerate(sums)]).collect():
                group, (g0, g1, h00, h01, h11, likelihood) = tuple(row[: len(by)]), row[len(by) :]
                a, b = now[group]
                if likelihood is not None and likelihood < best[group] - 1e-9 * abs(best[group]):
                    step[group] = (step[group][0] / 2, step[group][1] / 2)
                    now[group] = (a - step[group][0], b - step[group][1])
                    continue
                det = 0.0 if h00 is None else h00 * h11 - h01 * h01
                if not det > 1e-12 * max(h00 or 0.0, 1e-300) * max(h11 or 0.0, 1e-300):
                    raise ValueError(f"logits of {group} don't vary or labels are separated")
                best[group] = likelihood
                step[group] = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
                now[group] = (a + step[group][0], b + step[group][1])
                if sum(map(abs, step[group])) < tolerance:
                    open_.discard(group)
            if not open_:
                return now
        raise ValueError(f"no calibration line after {steps} steps for {sorted(open_, key=str)}")
    finally:
        rows.unpersist()


def calibration_line(df: DataFrame, steps: int = 50, tolerance: float = 1e-9) -> tuple[float, float]:
    """calibration_lines() of one group."""
    return calibration_lines(df, [], steps, tolerance)[()]


def nonconformity() -> Column:
    """1 - p of a positive, p of a negative."""
    return F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p"))


def _rank(share: float) -> Callable[[Column], Column]:
    """The rank ceil((n + 1) share), held within 1 to n, of n rows."""
    return lambda n: F.greatest(F.least(F.ceil(F.round((n + 1) * share, 9)), n), F.lit(1))


def conformal_quantile(df: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """Per group the score at rank ceil((n + 1)(1 - alpha)), held within 1 to n."""
    counts = df.groupBy(*by, nonconformity().alias("score")).agg(F.count("*").alias("k"))
    marked = running(counts, by, "score", ["k"])
    rank = _rank(1 - alpha)(F.col("all_k"))
    return marked.filter((F.col("upto_k") - F.col("k") < rank) & (rank <= F.col("upto_k"))).select(*by, F.col("score").alias("q_hat"))


def prediction_sets(df: DataFrame) -> DataFrame:
    """Adds include_0 (p <= q_hat), include_1 (1 - p <= q_hat), set_size and the set's text."""
    zero, one = F.col("p") <= F.col("q_hat"), (1 - F.col("p")) <= F.col("q_hat")
    text = F.when(zero & one, "{0,1}").when(zero, "{0}").when(one, "{1}").otherwise("{}")
    return df.withColumns({"include_0": zero.cast("int"), "include_1": one.cast("int"), "set_size": zero.cast("int") + one.cast("int"), "prediction_set": text})


def coverage(sets: DataFrame, by: list[str], target: float) -> DataFrame:
    """Coverage, gap to the target, mean size, rates of the four sets, coverage of each class."""
    hit = F.when(F.col("y") == 1, F.col("include_1")).otherwise(F.col("include_0")).cast("double")
    rate = lambda t: F.avg((F.col("prediction_set") == t).cast("double"))
    return sets.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(hit).alias("coverage"), (F.avg(hit) - target).alias("coverage_gap"), F.avg("set_size").alias("mean_set_size"), F.avg((F.col("set_size") == 1).cast("double")).alias("singleton_rate"), rate("{0,1}").alias("both_rate"), rate("{}").alias("empty_rate"), F.avg(F.when(F.col("y") == 1, hit)).alias("coverage_1"), F.avg(F.when(F.col("y") == 0, hit)).alias("coverage_0"))


def temporal_coverage(df: DataFrame, target: float, fold: str = "fold", by: tuple[str, ...] = ()) -> DataFrame:
    """Each fold but the first, with sets calibrated on all earlier folds; calibration_rows tells how many
    rows these have. Scores are added up by fold and value; counts of slices tell in which slice a
    later fold's quantile lies, and only that slice of the earlier folds is put together for it."""
    by = list(by)
    sums = df.groupBy(*by, fold, nonconformity().alias("score")).agg(F.count("*").alias("k"))
    sums = sums.withColumn("slot", slot(sums, "score"))
    parts = sums.groupBy(*by, fold, "slot").agg(F.sum("k").alias("k"))  # a row a fold and slice
    folds = parts.groupBy(*by).agg(F.collect_set(fold).alias("folds"))
    met = parts.join(folds, by) if by else parts.join(F.broadcast(folds))  # one row without groups
    met = met.withColumn("later", F.explode(F.filter("folds", lambda f: f > F.col(fold)))).groupBy(*by, "later", "slot").agg(F.sum("k").alias("k"))
    whole = Window.partitionBy(*by, "later")
    met = met.withColumns({"upto": F.sum("k").over(whole.orderBy("slot")), "n": F.sum("k").over(whole)}).withColumn("rank", _rank(target)(F.col("n")))
    wanted = met.filter((F.col("upto") - F.col("k") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select(*by, "later", "slot", "n", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"))
    near = sums.join(wanted, [*by, "slot"]).filter(F.col(fold) < F.col("later")).groupBy(*by, "later", "n", "rank", "score").agg(F.sum("k").alias("k"))
    inside = near.withColumn("upto", F.sum("k").over(Window.partitionBy(*by, "later").orderBy("score")))
    q = inside.filter(F.col("upto") >= F.col("rank")).groupBy(*by, F.col("later").alias(fold)).agg(F.min("score").alias("q_hat"), F.max("n").alias("calibration_rows"))
    keys = [*by, fold]
    return coverage(prediction_sets(df.join(q, keys)), keys, target).join(q, keys)


def summarise(folds: DataFrame, by: list[str], losses: list[str], gains: list[str]) -> DataFrame:
    """Equal-weight mean, sample deviation and worst of each metric over the folds."""
    out = [F.count_distinct("fold").alias("folds")]
    for c in [*losses, *gains]:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), (F.max(c) if c in losses else F.min(c)).alias(f"{c}_worst")]
    return folds.groupBy(*by).agg(*out)
