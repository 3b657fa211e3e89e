"""Evaluation of ranked predictions (incident_id, truth, family, similarity, rank): truth is null for decoys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SURE = 0.5
#: Equal parts of a group's range between which exact ranks are sought.
PARTS = 4096


def confusion(p: DataFrame) -> DataFrame:
    return p.where("rank = 1").groupBy(F.col("family").alias("predicted"), "truth").agg(F.count("*").alias("n"))


def contamination(p: DataFrame) -> DataFrame:
    """Wrong families among the five of each true family."""
    return p.where("rank <= 5 and truth is not null and family <> truth").groupBy("truth", "family").agg(F.count("*").alias("n"))


def false_positives(p: DataFrame) -> DataFrame:
    """How often a family comes first wrongly, or for a decoy with enough similarity."""
    wrong = F.col("truth").isNotNull() & (F.col("family") != F.col("truth"))
    decoy = F.col("truth").isNull() & (F.col("similarity") >= SURE)
    return p.where("rank = 1").groupBy("family").agg(F.count_if(wrong).alias("wrong"), F.count_if(decoy).alias("decoys"))


def substitutions(p: DataFrame, k: int = 10) -> DataFrame:
    s = p.where("rank = 1 and truth is not null and family <> truth").groupBy("truth", "family").agg(F.count("*").alias("n"))
    return s.orderBy(F.desc("n"), "truth", "family").limit(k)


def by_incident(p: DataFrame) -> DataFrame:
    """(incident_id, truth, first, similarity, hits, n, outcome)."""
    g = p.groupBy("incident_id").agg(F.first("truth").alias("truth"), F.max(F.when(F.col("rank") == 1, F.col("family"))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("similarity"), F.count_if(F.col("family") == F.col("truth")).alias("hits"), F.count("*").alias("n"))
    decoy = F.when(F.col("similarity") >= SURE, "false_positive_decoy").otherwise("correct_decoy_rejection")
    return g.withColumn("outcome", F.when(F.col("truth").isNull(), decoy).when(F.col("first") == F.col("truth"), "correct_rank1").otherwise("wrong_rank1_recall_miss"))


def precision_by_family(p: DataFrame) -> DataFrame:
    g = by_incident(p).where("truth is not null").groupBy("truth")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("truth")).alias("rank1"), F.count_if(F.col("hits") > 0).alias("found"), F.round(F.avg(F.col("hits") / F.least(F.lit(5), F.col("n"))), 6).alias("precision"), F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("recall"))


def losses(p: DataFrame, remedies: DataFrame | None = None) -> DataFrame:
    """(incident_id, truth, category, loss) of incidents that lose something, each for one reason: its family is not among the five, the first is right
    but the remedy is not the expected one (remedies: incident_id, expected, action), another family is first, or a decoy is taken for real."""
    b = by_incident(p)
    cured = F.lit(True)
    if remedies is not None:
        b = b.join(remedies.select("incident_id", "expected", "action"), "incident_id", "left")
        cured = F.col("expected").isNull() | F.coalesce(F.col("action") == F.col("expected"), F.lit(False))
    decoy = F.when(F.col("similarity") >= SURE, "decoy_false_positive")
    category = F.when(F.col("truth").isNull(), decoy).when(F.col("hits") == 0, "recall_miss").when((F.col("first") == F.col("truth")) & ~cured, "remediation_mismatch").when(F.col("first") != F.col("truth"), "contamination")
    loss = F.when(category == "recall_miss", 0.30).when(category == "contamination", 0.15).otherwise(0.20)
    return b.withColumn("category", category).where("category is not null").select("incident_id", "truth", "category", loss.alias("loss"))


def loss_breakdown(p: DataFrame, remedies: DataFrame | None = None) -> DataFrame:
    return losses(p, remedies).groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("loss"), 6).alias("total"), F.round(F.avg("loss"), 6).alias("mean"))


def loss_by_family(p: DataFrame, remedies: DataFrame | None = None) -> DataFrame:
    """(truth, n, lost, rate, categories): of each true family how many incidents lost something, and why, as category=count by name."""
    every = by_incident(p).groupBy("truth").agg(F.count("*").alias("n"))
    why = losses(p, remedies).groupBy("truth", "category").agg(F.count("*").alias("c"))
    lost = why.groupBy("truth").agg(F.sum("c").alias("lost"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "category", F.col("c").cast("string")))), ",").alias("categories"))
    out = every.alias("e").join(lost.alias("l"), F.col("e.truth").eqNullSafe(F.col("l.truth")), "left")
    return out.select("e.truth", "n", F.coalesce("lost", F.lit(0).cast("long")).alias("lost"), F.round(F.coalesce("lost", F.lit(0)) / F.col("n"), 6).alias("rate"), F.coalesce("categories", F.lit("")).alias("categories"))


def top_failures(p: DataFrame, k: int = 20, remedies: DataFrame | None = None) -> DataFrame:
    return losses(p, remedies).select("incident_id", "category", "loss").orderBy(F.desc("loss"), "incident_id").limit(k)


def calibration(p: DataFrame) -> DataFrame:
    """One row: how many incidents were first wrong with a similarity of SURE or right below it, the mean similarities, 0 without any, and how far these are apart."""
    b = by_incident(p).where("truth is not null").withColumn("right", F.col("first") == F.col("truth"))
    s = F.col("similarity")
    c = b.agg(F.count_if(~F.col("right") & (s >= SURE)).alias("sure_and_wrong"), F.count_if(F.col("right") & (s < SURE)).alias("unsure_and_right"), F.avg(F.when(F.col("right"), s)).alias("r"), F.avg(F.when(~F.col("right"), s)).alias("w"))
    none = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return c.select("sure_and_wrong", "unsure_and_right", none(F.col("r")).alias("mean_right"), none(F.col("w")).alias("mean_wrong"), none(F.col("r") - F.col("w")).alias("separation"))


def decoy_analysis(p: DataFrame) -> DataFrame:
    d = by_incident(p).where("truth is null")
    s = F.col("similarity")
    return d.agg(F.count("*").alias("decoys"), F.count_if(s >= SURE).alias("taken"), F.round(F.count_if(s >= SURE) / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"), F.round(F.avg(F.when(s >= SURE, s)), 6).alias("mean_taken"), F.round(F.avg(F.when(s < SURE, s)), 6).alias("mean_rejected"))


def outcome_counts(p: DataFrame) -> DataFrame:
    return by_incident(p).groupBy("outcome").agg(F.count("*").alias("n"))


def composite(recall, precision, remediation, p95):
    """0.30 recall + 0.15 precision + 0.20 remediation + 0.15 of the latency's share of two seconds."""
    return 0.30 * recall + 0.15 * precision + 0.20 * remediation + 0.15 * F.least(F.lit(1.0), 2000 / F.greatest(p95, F.lit(1e-6)))


def seed_deltas(runs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(seed, old_score, new_score, delta, direction) of seeds that both runs have."""
    s = runs.withColumn("score", F.round(composite(F.col("recall"), F.col("precision"), F.col("remediation"), F.col("p95")), 6))
    a, b = (s.where(F.col("run") == r).select("seed", F.col("score").alias(name)) for r, name in ((old, "old_score"), (new, "new_score")))
    d = a.join(b, "seed").withColumn("delta", F.round(F.col("new_score") - F.col("old_score"), 4))
    return d.withColumn("direction", F.when(F.col("delta") > 0.01, "improved").when(F.col("delta") < -0.01, "regressed").otherwise("unchanged"))


def seed_variance(runs: DataFrame) -> DataFrame:
    """(run, seeds, mean, stdev, stable): sample deviation, 0 for one seed."""
    s = runs.withColumn("score", F.round(composite(F.col("recall"), F.col("precision"), F.col("remediation"), F.col("p95")), 6))
    g = s.groupBy("run").agg(F.count("*").alias("seeds"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("stdev"))
    return g.withColumn("stable", F.col("stdev") < 0.05)


def long_metrics(runs: DataFrame) -> DataFrame:
    return runs.unpivot(["seed", "run"], ["recall", "precision", "remediation", "p95"], "metric", "value")


def diagnostics(p: DataFrame) -> DataFrame:
    """One nested record for each incident: what was true, what was predicted in order, and how it came out."""
    five = p.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("rank", "family", "similarity"))).alias("ranked"))
    b = by_incident(p).join(five, "incident_id")
    return b.select("incident_id", F.struct("truth", F.col("truth").isNull().alias("decoy")).alias("actual"), F.struct("first", "similarity", "ranked").alias("predicted"), "outcome")


def overlap(expected: DataFrame, returned: DataFrame, by: str, item: str) -> DataFrame:
    """(by, precision, recall, f1) of returned against expected items, as sets; 0 where one side is empty."""
    e, r = expected.select(by, item).distinct(), returned.select(by, item).distinct()
    both = e.withColumn("e", F.lit(1)).join(r.withColumn("r", F.lit(1)), [by, item], "full")
    n = both.groupBy(by).agg(F.sum(F.col("e") * F.col("r")).alias("hit"), F.sum("e").alias("e"), F.sum("r").alias("r"))
    hit = F.coalesce("hit", F.lit(0))
    n = n.withColumn("precision", F.coalesce(hit / F.col("r"), F.lit(0.0))).withColumn("recall", F.coalesce(hit / F.col("e"), F.lit(0.0)))
    total = F.col("precision") + F.col("recall")
    return n.select(by, "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f1"))


def improvement(runs: DataFrame, metric: str, old: str = "old", new: str = "new") -> DataFrame:
    """(seed, percent) by which a metric grew from one run to the other; null from 0."""
    a, b = (runs.where(F.col("run") == r).select("seed", F.col(metric).alias(name)) for r, name in ((old, "a"), (new, "b")))
    return a.join(b, "seed").select("seed", F.round((F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0.0)) * 100, 2).alias("percent"))


def failure_stats(p: DataFrame, remedies: DataFrame) -> DataFrame:
    """One row: incidents by what went wrong. remedies (incident_id, expected, action): expected is null where no remedy is known."""
    b = by_incident(p).join(remedies.select("incident_id", "expected", "action"), "incident_id", "left")
    cured = F.col("expected").isNull() | F.coalesce(F.col("action") == F.col("expected"), F.lit(False))
    is_ = lambda name: F.col("outcome") == name
    right = is_("correct_decoy_rejection") | (is_("correct_rank1") & cured)
    g = b.agg(F.count("*").alias("incidents"), F.count_if(right).alias("correct"), F.count_if(is_("wrong_rank1_recall_miss")).alias("recall_miss"), F.count_if(is_("correct_rank1") & ~cured).alias("remedy_mismatch"), F.count_if(is_("false_positive_decoy")).alias("decoy_false_positive"))
    failures = F.col("recall_miss") + F.col("remedy_mismatch") + F.col("decoy_false_positive")
    return g.withColumn("failures", failures).withColumn("success_rate", F.round(F.col("correct") / F.greatest("incidents", F.lit(1)), 6))


def remedy_mismatches(remedies: DataFrame, by: str | None = None, sure: float = 0.5) -> DataFrame:
    """Of the incidents with an expected remedy: how many got one, the right one, a wrong one (with what confidence) or none; by a column or over all."""
    r = remedies.where("expected is not null")
    wrong = F.coalesce(F.col("action") != F.col("expected"), F.lit(False))
    return (r.groupBy(by) if by else r.groupBy()).agg(
        F.count("*").alias("expected"),
        F.count("action").alias("suggested"),
        F.count_if(F.col("action") == F.col("expected")).alias("exact"),
        F.count_if(wrong).alias("wrong"),
        F.count_if(F.col("action").isNull()).alias("missing"),
        F.count_if(wrong & (F.col("confidence") >= sure)).alias("sure_and_wrong"),
    )


def quality(p: DataFrame, remedies: DataFrame) -> DataFrame:
    """One row: recall@5 (the true family is among the five), precision@5 (the mean share of it) and remediation accuracy, over incidents that are no decoys."""
    b = by_incident(p).where("truth is not null").join(remedies.select("incident_id", "expected", "action"), "incident_id", "left")
    right = F.avg(F.when(F.col("expected").isNotNull(), F.coalesce(F.col("action") == F.col("expected"), F.lit(False)).cast("double")))
    return b.agg(F.count("*").alias("incidents"), F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("recall"), F.round(F.avg(F.col("hits") / F.least(F.lit(5), F.col("n"))), 6).alias("precision"), F.round(right, 6).alias("remediation"))


def exclusive_quantile(rows: DataFrame, by: str, value: str, part: int = 95, of: int = 100, least: int = 20) -> DataFrame:
    """(by, n, quantile) of each group's values: the part-th of `of` quantiles of the exclusive kind, interpolated at part * (n + 1) / of; the largest
    value of groups below `least`. Nulls and NaN do not count.

    Exact, but no task gets a whole group: counts in PARTS equal parts of the group's range tell where the two values that are needed lie, and only
    the values there are ranked.
    """
    v = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(by, F.col(value).cast("double").alias("v"))
    span = v.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = F.floor(F.lit(part) * (F.col("n") + 1) / of)
    span = span.withColumn("j", F.least(F.greatest(place, F.lit(1)), F.col("n") - 1)).withColumn("delta", F.lit(part) * (F.col("n") + 1) - F.col("j") * of)
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(PARTS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS))).otherwise(0)
    dealt = v.alias("v").join(span.alias("s"), F.col(f"v.{by}").eqNullSafe(F.col(f"s.{by}"))).select(f"v.{by}", "v", "lo", "hi", "n", "j", "delta").withColumn("cell", cell)
    cells = dealt.groupBy(by, "cell", "j", "n").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).where("before < j + 1 and before + c >= j").select(F.col(by).alias("__of"), F.col("cell").alias("__cell"), "before")
    near = dealt.join(cells, F.col(by).eqNullSafe(F.col("__of")) & (F.col("cell") == F.col("__cell")))
    near = near.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(by, "cell").orderBy("v")))
    low, high = (F.max(F.when(F.col("rank") == F.col("j") + d, F.col("v"))) for d in (0, 1))
    out = near.groupBy(by).agg(F.first("n").alias("n"), F.first("hi").alias("hi"), F.first("delta").alias("delta"), low.alias("low"), high.alias("high"))
    tween = (F.col("low") * (of - F.col("delta")) + F.col("high") * F.col("delta")) / of
    return out.select(by, "n", F.when(F.col("n") < least, F.col("hi")).otherwise(tween).alias("quantile"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row over (success, latency_ms, confidence): pass rate and means, 0 where nothing is known; a null success is a failure."""
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    mean = lambda c, digits: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits)
    n = F.count("*")
    return results.agg(F.round(ok / F.greatest(n, F.lit(1)), 4).alias("pass_rate"), mean("latency_ms", 2).alias("latency_ms"), mean("confidence", 4).alias("confidence"), n.alias("total"), ok.alias("passed"), (n - ok).alias("failed"))


#: What each axis weighs in the harness's score.
AXES = {"recall": 0.30, "precision": 0.15, "remediation": 0.20, "latency": 0.15, "manual_context": 0.10, "manual_explain": 0.10}


def attribution(axes: DataFrame, by: str) -> DataFrame:
    """(by, metric, value, weight, contribution) of each axis of a score; an axis that is absent or null counts 0."""
    have = [c for c in AXES if c in axes.columns]
    wide = axes.select(by, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in AXES])
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in AXES.items() for x in kv]), F.col("metric"))
    long = wide.unpivot([by], list(AXES), "metric", "value").withColumn("weight", weight)
    return long.select(by, "metric", F.round("value", 4).alias("value"), "weight", F.round(F.col("weight") * F.col("value"), 4).alias("contribution"))
