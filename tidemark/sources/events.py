"""Events on the wire: JSON lines in two dialects, normalised to one schema; the original line is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
WIRE = T.StructType(
    [T.StructField(n, _S) for n in ("event_id", "id", "kind", "service", "ts", "trace_id", "version", "actor", "level", "message", "msg", "metric", "name")]
    + [T.StructField("value", T.DoubleType()), T.StructField("threshold", T.DoubleType())]
    + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("svc", _S), T.StructField("ts", _S), T.StructField("status", _S), T.StructField("dur_ms", T.LongType())])))]
    + [T.StructField("mutation", T.StructType([T.StructField(n, _S) for n in ("kind", "old_name", "new_name", "src", "dst")]))]
    + [T.StructField(n, _S) for n in ("change", "from", "from_", "to", "incident_id", "trigger", "action", "outcome", "target")]
)


def utc(ts: Column) -> Column:
    """ISO time with Z, an offset or none (then UTC), as a timestamp; null if it is none."""
    return F.try_to_timestamp(F.when(ts.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), ts).otherwise(F.concat(ts, F.lit("Z"))))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(raw, e): every line and what it says; a broken line has a null e.kind."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw"), F.from_json("value", WIRE, {"mode": "PERMISSIVE"}).alias("e"))


def normalised(lines: DataFrame) -> DataFrame:
    """One row for each line: both spellings of ids, messages, metrics and renames as one; empty strings count as missing."""
    e = lambda name: F.nullif(F.col(f"e.`{name}`"), F.lit(""))
    renamed = (F.col("e.mutation.kind") == "rename") | (e("change") == "rename")
    return lines.select(
        F.coalesce(e("event_id"), e("id"), F.substring(F.md5("raw"), 1, 16)).alias("event_id"),
        F.when(renamed, "topology").otherwise(e("kind")).alias("kind"),
        F.coalesce(e("service"), F.when(e("kind").isin("incident_signal", "remediation"), e("target"))).alias("service"),
        utc(e("ts")).alias("ts"),
        e("trace_id").alias("trace_id"),
        e("version").alias("version"),
        F.when(e("kind") == "deploy", F.coalesce(e("actor"), F.lit("system"))).otherwise(e("actor")).alias("actor"),
        e("level").alias("level"),
        F.coalesce(e("message"), e("msg"), F.lit("")).alias("message"),
        F.coalesce(e("metric"), e("name")).alias("metric"),
        F.col("e.value").alias("value"),
        F.col("e.threshold").alias("threshold"),
        F.col("e.spans").alias("spans"),
        F.when(renamed, F.coalesce(F.col("e.mutation.old_name"), e("from"), e("from_"))).alias("old_name"),
        F.when(renamed, F.coalesce(F.col("e.mutation.new_name"), e("to"))).alias("new_name"),
        e("incident_id").alias("incident_id"),
        e("trigger").alias("trigger"),
        e("action").alias("action"),
        e("outcome").alias("outcome"),
        e("target").alias("target"),
        "raw",
    )


def to_seconds(events: DataFrame) -> DataFrame:
    """Normalised events as the operators take them: times in seconds."""
    return events.withColumn("at", F.col("ts")).withColumn("ts", F.unix_micros("ts") / 1e6)


def append(events: DataFrame, path: str) -> None:
    """Append to the event log: Parquet by day, ordered by service and time within a file, so that both prune."""
    day = F.to_date("ts")
    events.withColumn("day", day).repartition("day", F.pmod(F.xxhash64("service"), F.lit(16))).sortWithinPartitions("service", "ts").write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")


def window(log: DataFrame, services: list[str], anchor, seconds: int) -> DataFrame:
    """Events of the services from `seconds` before the anchor up to it, both ends included; filters reach the scan."""
    return log.where(F.col("service").isin(services) & F.col("ts").between(F.lit(anchor) - F.make_interval(secs=F.lit(seconds)), F.lit(anchor))).orderBy("ts", "event_id")


def by_trace(log: DataFrame, traces: list[str]) -> DataFrame:
    return log.where(F.col("trace_id").isin(traces)) if traces else log.where("false")


def scenario(spark: SparkSession, seed: str = "s", payment: str = "svc-pay", checkout: str = "svc-chk", renamed: str = "svc-billing") -> DataFrame:
    """Lines of one incident across a rename: deploy, spike, timeout, failing call, signal, fix, then the same again under the new name."""
    base = "2026-01-15T10:%02d:%02dZ"
    rows = [
        {"kind": "deploy", "service": payment, "version": "v2.1.0", "t": 0},
        {"kind": "metric", "service": payment, "metric": "latency_p99", "value": 520.0, "threshold": 500.0, "t": 30},
        {"kind": "log", "service": payment, "level": "error", "msg": "DB timeout", "trace_id": f"{seed}-a", "t": 45},
        {"kind": "trace", "service": checkout, "trace_id": f"{seed}-a", "spans": [{"svc": payment, "status": "error", "dur_ms": 900}], "t": 50},
        {"kind": "incident_signal", "service": payment, "incident_id": f"INC-{seed}-1", "trigger": "latency", "t": 60},
        {"kind": "remediation", "target": payment, "incident_id": f"INC-{seed}-1", "action": "rollback", "outcome": "resolved", "t": 120},
        {"kind": "topology", "change": "rename", "from": payment, "to": renamed, "t": 180},
        {"kind": "metric", "service": renamed, "name": "latency_p99", "value": 610.0, "t": 240},
        {"kind": "incident_signal", "service": renamed, "incident_id": f"INC-{seed}-2", "trigger": "latency", "t": 250},
    ]
    import json

    lines = [json.dumps({"event_id": f"{seed}-{i:03d}", "ts": base % divmod(r["t"], 60), **{k: v for k, v in r.items() if k != "t"}}) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([(x,) for x in lines], "value string").select(F.col("value").alias("raw"), F.from_json("value", WIRE).alias("e"))


def throughput(spark: SparkSession, n: int, services: int = 10) -> DataFrame:
    """n normalised-like events (event_id, kind, service, ts), a tenth of a second apart, over four kinds; made on the executors."""
    kind = F.element_at(F.array(*map(F.lit, ("deploy", "metric", "log", "trace"))), (F.col("id") % 4 + 1).cast("int"))
    at = F.timestamp_micros(F.lit(1_768_471_200_000_000) + F.col("id") * 100_000)
    return spark.range(n).select(F.format_string("t-%d", "id").alias("event_id"), kind.alias("kind"), F.format_string("svc-%d", F.col("id") % services).alias("service"), at.alias("ts"))


#: Kinds of the events of an incident family, fifteen seconds apart, before its signal.
FAMILIES = {
    0: ("deploy", "metric", "log"),
    1: ("metric", "metric", "trace"),
    2: ("log", "log", "trace"),
    3: ("deploy", "trace", "log"),
    4: ("metric", "log", "deploy"),
}


def family_events(spark: SparkSession, incidents: int, hours: int = 1) -> DataFrame:
    """(event_id, kind, service, ts, incident_id) of incidents INC-<i>-<family>, `hours` apart, each with its family's events and a signal."""
    n = len(FAMILIES)
    steps = F.create_map(*[x for k, v in FAMILIES.items() for x in (F.lit(k), F.array(*map(F.lit, (*v, "incident_signal"))))])
    base = spark.range(incidents).withColumn("family", (F.col("id") % n).cast("int"))
    e = base.select("id", "family", F.posexplode(F.element_at(steps, F.col("family"))).alias("step", "kind"))
    at = F.timestamp_seconds(F.lit(1_768_471_200) + F.col("id") * 3600 * hours + F.col("step") * 15)
    return e.select(F.format_string("f-%d-%d", "id", "step").alias("event_id"), "kind", F.format_string("svc-%d", "family").alias("service"), at.alias("ts"), F.format_string("INC-%d-%d", "id", "family").alias("incident_id"))
