"""What is made of retrieved incidents: families, two stages, decoys, actions.

Matches are rows (signal_id, seq, incident_id, similarity, action, outcome, ...); of equal similarities the smaller seq comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import family_of

from .options import DEFAULT, Options


def _order() -> list[Column]:
    return [F.desc("similarity"), F.col("seq")]


def ranked(matches: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    return matches.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*_order())))


def best_per_incident(matches: DataFrame) -> DataFrame:
    return ranked(matches, ["signal_id", "incident_id"], "__n").where("__n = 1").drop("__n")


def smart_top(matches: DataFrame, k: int = 5, sure: float = 0.5) -> DataFrame:
    """The k best if the best reaches `sure`; else the best of every family first, then the others."""
    m = matches.withColumn("family", F.substring_index("incident_id", "-", -1))
    m = m.withColumn("most", F.max("similarity").over(Window.partitionBy("signal_id"))).withColumn("f", F.row_number().over(Window.partitionBy("signal_id", "family").orderBy(*_order())))
    later = F.when(F.col("most") >= sure, 0).otherwise((F.col("f") > 1).cast("int"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("signal_id").orderBy(later, *_order()))).where(F.col("rank") <= k).drop("most", "f")


def suggested_actions(matches: DataFrame, history: DataFrame, k: int = 3) -> DataFrame:
    """(signal_id, cid, action, seq, rate, confidence, rank): the first match of each action by similarity, times its success rate on the signal's service.

    matches has the signal's cid, history is (cid, action, outcome); an action that the service has no history of has a rate of 0.5.
    """
    first = ranked(matches.where("action <> ''"), ["signal_id", "action"], "n").where("n = 1")
    rate = history.groupBy("cid", "action").agg(F.avg((F.col("outcome") == "resolved").cast("double")).alias("rate"))
    out = first.join(rate, ["cid", "action"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.5)))
    out = out.withColumn("confidence", F.col("similarity") * F.col("rate"))
    order = [F.desc(F.round(F.col("confidence") + 1e-9, 3)), F.desc("similarity"), "seq"]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("signal_id").orderBy(*order))).where(F.col("rank") <= k).select("signal_id", "cid", "action", "seq", "rate", "confidence", "rank")


def family_posteriors(matches: DataFrame) -> DataFrame:
    """(signal_id, family, mean, best, second, n, margin, variance)."""
    m = matches.withColumn("family", family_of(F.col("incident_id")))
    g = m.groupBy("signal_id", "family").agg(F.avg("similarity").alias("mean"), F.max("similarity").alias("best"), F.sort_array(F.collect_list("similarity"), False).alias("s"), F.count("*").alias("n"), F.var_pop("similarity").alias("variance"))
    second = F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))
    return g.select("signal_id", "family", "mean", "best", second.alias("second"), "n", (F.col("best") - second).alias("margin"), "variance")


def family_ranks(matches: DataFrame) -> DataFrame:
    """(signal_id, family, score, rank) by 0.4 mean + 0.4 margin + 0.2 of up to five matches."""
    score = 0.4 * F.col("mean") + 0.4 * F.col("margin") + 0.2 * F.least(F.lit(1.0), F.col("n") / 5)
    p = family_posteriors(matches).withColumn("score", F.round(score, 6))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("score"), "family"))).select("signal_id", "family", "score", "rank")


def diversified(matches: DataFrame, each: int = 2, k: int = 5) -> DataFrame:
    """k matches: up to `each` of every family, in the order of the families' ranks."""
    m = matches.withColumn("family", family_of(F.col("incident_id"))).withColumn("f", F.row_number().over(Window.partitionBy("signal_id", "family").orderBy(*_order()))).where(F.col("f") <= each)
    m = m.join(family_ranks(matches).withColumnRenamed("rank", "family_rank").drop("score"), ["signal_id", "family"])
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("signal_id").orderBy("family_rank", "f"))).where(F.col("rank") <= k)


def family_best(matches: DataFrame, each: int = 1, k: int = 5, by_first: bool = False) -> DataFrame:
    """Up to `each` matches of every family and k of all; families in the order of their best similarity, or (by_first) of their first match by seq."""
    m = ranked(matches.withColumn("family", family_of(F.col("incident_id"))), ["signal_id", "family"], "f")
    whole = Window.partitionBy("signal_id", "family")
    lead = [F.min("seq").over(whole)] if by_first else [-F.max("similarity").over(whole), F.min(F.when(F.col("f") == 1, F.col("seq"))).over(whole)]
    m = m.withColumn("lead", F.struct(*[c.alias(f"l{i}") for i, c in enumerate(lead)])).where(F.col("f") <= each)
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("signal_id").orderBy("lead", "f"))).where(F.col("rank") <= k).drop("lead", "f")


def family_diversity(matches: DataFrame) -> DataFrame:
    """(signal_id, families, n, diversity): distinct families among a signal's matches, and their share."""
    m = matches.withColumn("family", family_of(F.col("incident_id")))
    return m.groupBy("signal_id").agg(F.count_distinct("family").alias("families"), F.count("*").alias("n")).withColumn("diversity", F.round(F.col("families") / F.col("n"), 6))


def same_family(a: Column, b: Column) -> Column:
    return family_of(a) == family_of(b)


def family_safe() -> Column:
    """Whether a match may enter the precise stage."""
    weak = ~(F.col("has_deploy") & F.col("has_metric") & F.col("has_trace_log"))
    s = F.col("similarity")
    return (
        F.when(~F.col("incident_id").startswith("INC-"), False)
        .when(F.col("n_ids") == 0, s >= 0.70)
        .when(F.length("action") < 2, s >= 0.75)
        .when(weak, s >= 0.75)
        .otherwise(True)
    )


def two_stage(matches: DataFrame, precise: float = 0.60, wide: float = 0.50, enough: int = 3, k: int = 5, fast: bool = False) -> DataFrame:
    """Safe matches of `precise` alone if there are `enough`, else with those of `wide` after them; k of them."""
    m = matches.withColumn("a", (F.col("similarity") >= precise) & family_safe())
    m = m.withColumn("n", F.count_if("a").over(Window.partitionBy("signal_id")))
    m = m.where(F.col("a") | ((F.col("similarity") >= wide) & (F.col("n") < enough) & F.lit(not fast)))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("a"), *_order()))).where(F.col("rank") <= k).withColumn("stage", F.when(F.col("a"), "A").otherwise("B")).drop("a", "n")


def evidence_score(deploy: Column, metric: Column, trace_log: Column) -> Column:
    return F.when(deploy, 0.35).otherwise(0.0) + F.when(metric, 0.35).otherwise(0.0) + F.when(trace_log, 0.30).otherwise(0.0)


def boosted(matches: DataFrame) -> DataFrame:
    """Similarity a little higher with strong evidence and lower with weak, ranked anew."""
    e = evidence_score(F.col("has_deploy"), F.col("has_metric"), F.col("has_trace_log"))
    s = F.col("similarity")
    s = F.when(e > 0.8, F.least(F.lit(0.99), s + 0.05)).when(e < 0.4, F.greatest(F.lit(0.0), s - 0.10)).otherwise(s)
    m = matches.withColumn("evidence", F.round(e, 2)).withColumn("similarity", F.round(s, 6))
    return ranked(m, ["signal_id"])


def decoy_policy(evidence: DataFrame) -> DataFrame:
    """(signal_id, has_*, score, decoy, risk, missing, multiplier, cap) from related events (signal_id, kind)."""
    e = evidence.groupBy("signal_id").agg(F.bool_or(F.col("kind") == "deploy").alias("d"), F.bool_or(F.col("kind") == "metric").alias("m"), F.bool_or(F.col("kind").isin("trace", "log")).alias("t"))
    decoy = ~(F.col("d") & F.col("m") & F.col("t"))
    score = (F.col("d").cast("int") + F.col("m").cast("int") + F.col("t").cast("int")) / 3
    missing = F.concat_ws(",", F.when(~F.col("d"), "deploy"), F.when(~F.col("m"), "metric"), F.when(~F.col("t"), "trace_or_log"))
    return e.select("signal_id", F.col("d").alias("has_deploy"), F.col("m").alias("has_metric"), F.col("t").alias("has_trace_log"), F.round(score, 2).alias("score"), decoy.alias("decoy"),
                    F.when(decoy, "high").when(score < 0.8, "medium").otherwise("low").alias("risk"), missing.alias("missing"), F.when(decoy, 0.6).otherwise(1.0).alias("multiplier"), F.when(decoy, 0.45).otherwise(1.0).alias("cap"))


def beta_posterior(s: Column, n: Column, similarity: Column) -> Column:
    raw = (0.4 * s / n + 0.6 * (2 + s) / (4 + n)) * F.least(F.lit(1.0), n / 10) * similarity
    return F.when(n <= 0, 0.05).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.99), raw)))


def action_posteriors(matches: DataFrame, least: int = 2) -> DataFrame:
    """(signal_id, action, successes, total, similarity, posterior, label, target) of actions tried `least` times; target is the commonest one
    (the least of equals), null where matches have none."""
    rows = matches.where("action <> ''")
    g = rows.groupBy("signal_id", "action").agg(F.count_if(F.col("outcome") == "resolved").alias("successes"), F.count("*").alias("total"), F.avg("similarity").alias("similarity"))
    # A nudge before rounding keeps exact halves from going either way by the last bit of a sum.
    p = F.round(beta_posterior(F.col("successes"), F.col("total"), F.col("similarity")) + 1e-9, 6)
    g = g.where(F.col("total") >= least).withColumn("posterior", p).withColumn("similarity", F.round("similarity", 6))
    g = g.withColumn("label", F.when(F.col("posterior") >= 0.6, "resolved").otherwise("uncertain"))
    if "target" not in matches.columns:
        return g.withColumn("target", F.lit(None).cast("string"))
    often = rows.groupBy("signal_id", "action", "target").agg(F.count("*").alias("n")).groupBy("signal_id", "action").agg(F.min_by("target", F.struct((-F.col("n")).alias("n"), "target")).alias("target"))
    return g.join(often, ["signal_id", "action"], "left")


def family_outcomes(matches: DataFrame) -> DataFrame:
    """(family, total, rate, actions): how often a family was resolved, and its actions counted, as action=count in order of the name."""
    m = matches.withColumn("family", family_of(F.col("incident_id")))
    acts = m.where("action <> ''").groupBy("family", "action").agg(F.count("*").alias("n"))
    acts = acts.groupBy("family").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "action", F.col("n").cast("string")))), ",").alias("actions"))
    return m.groupBy("family").agg(F.count("*").alias("total"), F.round(F.avg((F.col("outcome") == "resolved").cast("double")), 6).alias("rate")).join(acts, "family", "left")


def suppressed(matches: DataFrame, policy: DataFrame) -> DataFrame:
    """matches of decoy signals with similarity capped and, if they have it, confidence multiplied, by decoy_policy(); a signal without a policy stays."""
    out = matches.join(policy.select("signal_id", "cap", "multiplier"), "signal_id", "left")
    out = out.withColumn("similarity", F.round(F.least("similarity", F.coalesce("cap", F.lit(1.0))), 3))
    if "confidence" in matches.columns:
        out = out.withColumn("confidence", F.round(F.col("confidence") * F.coalesce("multiplier", F.lit(1.0)) + 1e-9, 3))
    return out.select(matches.columns)


def post_processed(matches: DataFrame, policy: DataFrame, suggested: DataFrame, options: Options = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(matches, actions) of every signal: decoy suppression, two stages, actions ranked by their posteriors, one match of each family.

    suggested (signal_id, action, confidence) is suppressed alike and stands where the matches have no ranked action. The switches of `options` leave
    steps out.
    """
    m, fallback = matches, suggested.select("signal_id", "action", "confidence")
    if options.use_decoy_suppression:
        m, fallback = suppressed(m, policy), suppressed(fallback.withColumn("similarity", F.lit(0.0)), policy).drop("similarity")
    if options.use_two_stage:
        m = two_stage(m, options.stage_a_threshold, options.stage_b_threshold, options.min_stage_a, options.max_results).drop("rank", "stage")
    actions = fallback
    if options.use_remediation_optimizer:
        best = action_posteriors(m, options.min_history).select("signal_id", "action", F.col("posterior").alias("confidence"))
        actions = best.unionByName(fallback.join(best.select("signal_id").distinct(), "signal_id", "left_anti"))
    if options.use_family_rep:
        m = family_best(m, 1, options.max_results)
    return m, actions


def representatives(matches: DataFrame) -> DataFrame:
    """The likest match of each family of a signal, the earlier of equals."""
    return ranked(matches.withColumn("family", family_of(F.col("incident_id"))), ["signal_id", "family"]).where("rank = 1").drop("rank")


def action_score(matches: DataFrame, action: str, least: int = 2) -> DataFrame:
    """(signal_id, score) of one action over a signal's matches: the posterior, 0 if it was taken less than `least` times."""
    taken = matches.groupBy("signal_id").agg(F.count_if(F.col("action") == action).alias("n"))
    return taken.join(action_posteriors(matches.where(F.col("action") == action), least), "signal_id", "left").select("signal_id", F.coalesce("posterior", F.lit(0.0)).alias("score"))
