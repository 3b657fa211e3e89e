"""Whether a kind of event goes before incidents: contingency tables and what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats as S

from .temporal import band_join

ABCD = ("a", "b", "c", "d")


def contingency(events: DataFrame, incidents: DataFrame, window: float, by: str = "kind", on: tuple[str, ...] = ("cid",)) -> DataFrame:
    """(by, a, b, c, d) for each kind of event (by, ts, on...): incidents (incident, t, on...) with one in [t - window, t), other events, other incidents,
    and incidents less those with one, as both margins are counted by incidents."""
    pairs = band_join(incidents.select("incident", "t", *on), events.select(by, F.col("ts").alias("e_ts"), *on), list(on), "t", "e_ts", window, closed="left")
    hit = pairs.groupBy(by).agg(F.count_distinct("incident").alias("a"))
    every = events.groupBy(by).agg(F.count("*").alias("events")).join(hit, by, "left").withColumn("a", F.coalesce("a", F.lit(0)))
    every = every.crossJoin(F.broadcast(incidents.agg(F.count("*").alias("incidents"))))
    none = lambda x: F.greatest(F.lit(0), x)
    return every.select(by, "a", none(F.col("events") - F.col("a")).alias("b"), (F.col("incidents") - F.col("a")).alias("c"), none(F.col("incidents") - F.col("a")).alias("d"))


def analysed(table: DataFrame, by: str = "kind", alpha: float = 0.05, least: int = 5) -> DataFrame:
    """Every measure of a contingency table, one row for each kind: statistics, decision, and whether the incidents are enough to rely on it."""
    a, b, c, d = (F.col(x) for x in ABCD)
    chi = S.chi_squared(a, b, c, d)
    mi, pmi = S.mutual_information(a, b, c, d)
    t = table.withColumn("chi", chi).withColumn("p", S.p_value("chi"))
    v, risk = S.cramers_v(F.col("chi"), a + b + c + d), S.relative_risk(a, b, c, d)
    t = t.select(by, *ABCD, "chi", "p", mi.alias("mi"), pmi.alias("pmi"), *[x.alias(n) for n, x in S.conditionals(a, b, c, d).items()], v.alias("v"), risk.alias("rr"), S.odds_ratio(a, b, c, d).alias("odds"))
    t = t.withColumn("predictive", S.predictive(F.col("p"), F.col("rr"), a, alpha))
    return t.withColumn("confidence", S.confidence(F.col("p"), F.col("v"), F.col("rr"), F.col("predictive"), alpha)).withColumn("enough", a + c >= least)
