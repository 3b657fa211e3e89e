"""Parameter grids, sweeps over them, ablations, and what their results say."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .options import DEFAULT, Options, changed

#: Combinations up to which a grid is made whole whatever it is limited to.
WHOLE = 5000


def grid(spark: SparkSession, values: Mapping[str, Sequence[float]], most: int | None = None, seed: int = 42) -> DataFrame:
    """One row for each combination with its number in the order of the values, parameters by name.

    Of more than WHOLE combinations, with `most` given, that many are drawn with a seeded generator, and repeated draws count once.
    """
    keys = sorted(values)
    schema = "number long, " + ", ".join(f"{k} double" for k in keys)
    if most and math.prod(len(values[k]) for k in keys) > max(most, WHOLE):
        rng = random.Random(seed)
        rows = sorted({tuple(float(rng.choice(values[k])) for k in keys) for _ in range(most)})
    else:
        rows = sorted(product(*[[float(v) for v in values[k]] for k in keys]))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def sweep(spark: SparkSession, values: Mapping[str, Sequence[float]], seeds: Sequence[int], run: Callable[[Options, int], Mapping[str, float]], timeout_s: float = 60.0, most: int | None = None) -> DataFrame:
    """(number, parameters..., seed, recall, precision, remediation, p95): run(options, seed) for each configuration and seed; a run that fails has zeros
    and the time limit as its latency."""
    keys, out = sorted(values), []
    for row in grid(spark, values, most).orderBy("number").collect():  # one row for each configuration
        for seed in seeds:
            try:
                got = run(changed({k: int(row[k]) if isinstance(getattr(DEFAULT, k), int) else row[k] for k in keys}), seed)
                measured = [float(got[c]) for c in ("recall", "precision", "remediation", "p95")]
            except Exception:  # a failed run is a result
                measured = [0.0, 0.0, 0.0, timeout_s * 1000]
            out.append((row["number"], *[row[k] for k in keys], int(seed), *measured))
    schema = "number long, " + "".join(f"{k} double, " for k in keys) + "seed long, recall double, precision double, remediation double, p95 double"
    return spark.createDataFrame(out, schema)


# What to try for each metric.
RECOMMENDED = {
    "precision": (("Stronger Stage A threshold", {"stage_a_threshold": 0.70}), ("Lower decoy cap", {"decoy_similarity_cap": 0.35}), ("Combined strict", {"stage_a_threshold": 0.70, "decoy_similarity_cap": 0.35})),
    "recall": (("Weaker Stage A threshold", {"stage_a_threshold": 0.50}), ("Higher decoy cap", {"decoy_similarity_cap": 0.55}), ("Combined permissive", {"stage_a_threshold": 0.50, "decoy_similarity_cap": 0.55})),
    "remediation": (("Increase min history", {"min_history": 3}), ("Higher success prior", {"prior_success_rate": 0.60}), ("Combined", {"min_history": 3, "prior_success_rate": 0.60})),
    "p95": (("Reduce candidates", {"max_results": 3}), ("Faster evidence check", {"stage_b_threshold": 0.60})),
}
OTHERWISE = (("Balanced", {}), ("Aggressive precision", {"stage_a_threshold": 0.65}))


def targeted(spark: SparkSession, metric: str, run: Callable[[Options], Mapping[str, float]]) -> DataFrame:
    """(variant, metric, value) of the recommended changes for a metric, and of the defaults as `baseline`."""
    rows = []
    for name, delta in (("baseline", {}), *RECOMMENDED.get(metric, OTHERWISE)):
        rows += [(name, k, float(v)) for k, v in run(changed(delta)).items()]
    return spark.createDataFrame(rows, "variant string, metric string, value double")


def importance(results: DataFrame, parameters: Sequence[str], score: str = "score") -> DataFrame:
    """(parameter, variance, importance): how much the mean score differs between a parameter's values, and that over the largest."""
    long = results.unpivot([score], list(parameters), "parameter", "value")
    means = long.groupBy("parameter", "value").agg(F.avg(score).alias("m"))
    v = means.groupBy("parameter").agg(F.round(F.var_pop("m"), 8).alias("variance"))
    most = v.agg(F.max("variance").alias("most"))
    return v.crossJoin(F.broadcast(most)).select("parameter", "variance", F.round(F.when(F.col("most") > 0, F.col("variance") / F.col("most")).otherwise(0.0), 6).alias("importance"))


def sweep_scores(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each configuration `by` of runs (recall, precision, remediation, p95): means over its seeds, the worst p95, the weighted
    score, the least and greatest score of a seed, and the rank (best first, ties by configuration)."""
    weighed = lambda r, p, m, late: 0.50 * r + 0.30 * p + 0.15 * m + 0.05 * (1 - F.least(F.lit(1.0), late / 2000))
    own = runs.withColumn("own", weighed(*[F.col(c) for c in ("recall", "precision", "remediation", "p95")]))
    g = own.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "remediation")], F.max("p95").alias("p95"), F.round(F.min("own") + 1e-9, 4).alias("least"), F.round(F.max("own") + 1e-9, 4).alias("most"))
    g = g.withColumn("score", F.round(weighed(*[F.col(c) for c in ("recall", "precision", "remediation", "p95")]) + 1e-9, 4))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), *by))  # a row for each configuration, not for each run
    return g.select(*by, *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("recall", "precision", "remediation")], F.round("p95", 1).alias("p95"), "score", "least", "most", rank.cast("long").alias("rank"))


def ablation(results: DataFrame, baseline: str) -> DataFrame:
    """(variant, metric, delta, improved, magnitude) of each variant's metrics (variant, metric, value) against the baseline's; magnitude is the mean
    size of the variant's deltas."""
    base = results.where(F.col("variant") == baseline).select("metric", F.col("value").alias("base"))
    d = results.where(F.col("variant") != baseline).join(F.broadcast(base), "metric").withColumn("delta", F.round(F.col("value") - F.col("base"), 4))
    magnitude = F.round(F.avg(F.abs("delta")).over(Window.partitionBy("variant")), 6)
    return d.select("variant", "metric", "delta", (F.col("delta") > 0).alias("improved"), magnitude.alias("magnitude"))


def ablation_extremes(deltas: DataFrame, metric: str) -> DataFrame:
    """One row: the variants that change a metric for the better and for the worse most; the first by name of equals."""
    d = deltas.where(F.col("metric") == metric)
    return d.agg(F.min_by("variant", F.struct((-F.col("delta")).alias("d"), "variant")).alias("best"), F.min_by("variant", F.struct("delta", "variant")).alias("worst"))


def extracted_metrics(reports: DataFrame) -> DataFrame:
    """(recall, precision, remediation, p95) of harness reports: quality from score.axes, the latency in milliseconds from aggregated."""
    axis = lambda name: F.coalesce(F.col(f"score.axes.`{name}`").cast("double"), F.lit(0.0))
    return reports.select(axis("recall@5").alias("recall"), axis("precision@5_mean").alias("precision"), axis("remediation_acc").alias("remediation"), F.coalesce(F.col("aggregated.latency_p95_ms").cast("double"), F.lit(0.0)).alias("p95"))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, left_value, right_value) of the keys that differ between two (key, value) tables."""
    j = a.select("key", F.col("value").alias("left_value")).join(b.select("key", F.col("value").alias("right_value")), "key", "full")
    return j.where(~F.col("left_value").eqNullSafe(F.col("right_value")))
