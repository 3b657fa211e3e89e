"""Joins in time: bands, as-of with tolerance, look-back windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that count as evidence around a signal.
RELEVANT = ("deploy", "metric", "log", "trace", "incident_signal")
#: Look-back widths in seconds, tried in turn until one holds so many events.
WIDTHS, ENOUGH = (600, 1200, 3600), 5


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, before: float, after: float = 0.0, closed: str = "both") -> DataFrame:
    """Pairs with equal keys and left_ts - before <= right_ts <= left_ts + after; closed="left" leaves the upper end out.

    Time is cut into buckets as wide as the band: a left row meets the two or three buckets that its band touches, so that the join is an
    equi-join on key and bucket, whose groups stay small however many rows a key has. Right columns other than the keys must not clash.
    """
    width = before + after
    lo, hi = F.col(left_ts) - before, F.col(left_ts) + after
    dealt = left.withColumn("__b", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    upper = F.col(right_ts) <= hi if closed == "both" else F.col(right_ts) < hi
    pairs = dealt.join(right.withColumn("__b", F.floor(F.col(right_ts) / width)), [*on, "__b"])
    return pairs.where((F.col(right_ts) >= lo) & upper).drop("__b")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, take: list[str], right_order: list[str], tolerance: float | None = None, width: float = 86400.0) -> DataFrame:
    """Each left row with `take` of the latest right row at or before it, as a struct column `asof` (null if none within tolerance).

    Both sides are unioned and the last right row is carried forward, without pairs, within a key and a bucket of time, so that no task gets a
    whole key. Buckets are as wide as the tolerance, and each right row is dealt to its bucket and the next; without one they are `width` wide, and
    what a bucket begins with comes from a row for each earlier bucket of the key. Of right rows at one time the first in right_order counts.
    """
    first = Window.partitionBy(*on, right_ts).orderBy(*right_order)
    r = right.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    r = r.select(*on, F.col(right_ts).cast("double").alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(right_ts).alias("ts"), *take).alias("__r"), F.lit(None).alias("__l"))
    l = left.select(*on, F.col(left_ts).cast("double").alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__r"), F.struct(*left.columns).alias("__l"))
    wide = float(width if tolerance is None else max(tolerance, 1e-6))
    bucket = F.floor(F.col("__t") / wide)
    inside = Window.partitionBy(*on, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    if tolerance is not None:
        r = r.withColumn("__b", F.explode(F.array(bucket, bucket + 1)))
        out = l.withColumn("__b", bucket).unionByName(r).withColumn("asof", F.last("__r", ignorenulls=True).over(inside)).where("__side = 1").select("__l.*", "asof")
        return out.withColumn("asof", F.when(F.col(left_ts) - F.col("asof.ts") <= tolerance, F.col("asof")))
    both = l.unionByName(r).withColumn("__b", bucket)
    ends = both.groupBy(*on, "__b").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.col("__t"))).alias("__r"))
    earlier = Window.partitionBy(*on).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], F.col("__b").alias("__kb"), F.last("__r", ignorenulls=True).over(earlier).alias("__before"))
    out = both.withColumn("__here", F.last("__r", ignorenulls=True).over(inside)).where("__side = 1")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(on)] + [F.col("__b") == F.col("__kb")]
    out = out.join(ends.where("__before is not null"), reduce(lambda a, b: a & b, same), "left")
    return out.withColumn("asof", F.coalesce("__here", "__before")).select("__l.*", "asof")


def adaptive_window(signals: DataFrame, events: DataFrame, scale: float = 1.0) -> DataFrame:
    """(signal_id, width): the least of WIDTHS with ENOUGH relevant events up to the signal, else the widest; one join, conditional counts."""
    e = events.where(F.col("kind").isin(*RELEVANT)).select("cid", F.col("event_id").alias("e"), F.col("ts").alias("e_ts"))
    near = band_join(signals.select("signal_id", "anchor", "cid"), e, ["cid"], "anchor", "e_ts", WIDTHS[-1] * scale)
    counts = near.groupBy("signal_id").agg(*[F.count_if(F.col("e_ts") >= F.col("anchor") - w * scale).alias(f"n{w}") for w in WIDTHS])
    width = reduce(lambda out, w: F.when(F.coalesce(f"n{w}", F.lit(0)) >= ENOUGH, w).otherwise(out), reversed(WIDTHS[:-1]), F.lit(WIDTHS[-1]))
    return signals.join(counts, "signal_id", "left").select("signal_id", "anchor", "cid", width.cast("long").alias("width"))


def related_events(signals: DataFrame, events: DataFrame, neighbours: DataFrame, scale: float = 1.0, as_of: bool = False) -> DataFrame:
    """(signal_id, anchor, event_id, ts, kind, e_cid, via, ...): events that belong to a signal, each once, with the events' other columns.

    Its service's events in the adaptive window (via 0), events of any service and any time that share a trace with them (1; with `as_of`
    none after the signal), and the window's events on services one edge away (2). neighbours has (cid, near).
    """
    chosen = adaptive_window(signals, events, scale)
    e = events.where(F.col("kind").isin(*RELEVANT)).withColumnRenamed("cid", "e_cid")
    e = e.select([c for c in e.columns if c not in ("user_id", "service")])
    within = F.col("ts") >= F.col("anchor") - F.col("width") * scale
    own = band_join(chosen.select("signal_id", "anchor", "width", F.col("cid").alias("e_cid")), e, ["e_cid"], "anchor", "ts", WIDTHS[-1] * scale).where(within)
    traces = own.where("trace_id is not null").select("signal_id", "anchor", "trace_id").distinct()
    traced = traces.join(e, "trace_id")
    if as_of:
        traced = traced.where("ts <= anchor")
    beside = chosen.join(neighbours, "cid").select("signal_id", "anchor", "width", F.col("near").alias("e_cid")).distinct()
    beside = band_join(beside, e, ["e_cid"], "anchor", "ts", WIDTHS[-1] * scale).where(within)
    cols = ["signal_id", "anchor", *e.columns]
    every = own.select(*cols, F.lit(0).alias("via")).unionByName(traced.select(*cols, F.lit(1).alias("via"))).unionByName(beside.select(*cols, F.lit(2).alias("via")))
    return every.groupBy("signal_id", "event_id").agg(*[F.first(c).alias(c) for c in cols if c not in ("signal_id", "event_id")], F.min("via").alias("via"))
