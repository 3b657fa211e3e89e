"""The test tables seen as operations telemetry: events of seven kinds whose names are resolved through a rename log, ingested once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import event_token
from tidemark.operators import graph as G
from tidemark.operators import identity as I
from tidemark.operators.temporal import asof_join
from tidemark.session import forget, kept

#: Seconds of these sparse events for each second of the operators' windows.
TIME_SCALE = 144
HOUR = 3600.0 * TIME_SCALE
BASES = ("svc", "payments", "edge-api", "mysql", "worker")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def service_name(user: Column, n: Column) -> Column:
    """A user is a service, named <base>-<user>-v<n> after n renames."""
    base = F.element_at(F.array(*map(F.lit, BASES)), (user % len(BASES) + 1).cast("int"))
    return F.concat(base, F.lit("-"), user.cast("string"), F.lit("-v"), n.cast("string"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, kind, k, trace_id, value, message, metric, version, action, outcome); ts in seconds since the epoch.

    Events of one k within six hours are one trace, across services. Event ids run in time order.
    """
    kind = (
        F.when(F.col("event_type") == "signup", "deploy")
        .when(F.col("event_type") == "view", "metric")
        .when(F.col("event_type") == "error", "log")
        .when(F.col("event_type") == "click", "trace")
        .when(F.col("value") < 50, "incident_signal")
        .otherwise("remediation")
    )
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "user_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    is_ = lambda name: F.col("kind") == name
    k = F.col("k").cast("string")
    return e.select(
        *e.columns,
        (F.floor(F.col("ts") / 21600) * 100 + F.col("k")).alias("trace_id"),
        F.when(is_("log"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("DB timeout after "), k)).when(F.col("k") % 3 == 1, F.concat(F.lit("error code "), k)).otherwise("request slow")).alias("message"),
        F.when(is_("metric"), F.concat(F.lit("latency_"), F.floor(F.col("k") / 10).cast("string"))).alias("metric"),
        F.when(is_("deploy"), F.concat(F.lit("v"), k)).alias("version"),
        F.when(is_("remediation"), F.element_at(F.array(*map(F.lit, ("rollback", "restart", "scale up"))), (F.col("k") % 3 + 1).cast("int"))).alias("action"),
        F.when(is_("remediation"), F.when(F.col("event_id") % 2 == 0, "resolved").otherwise("failed")).alias("outcome"),
    )


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, user_id, old_name, new_name): a user's n-th signup of 100 or more renames its version n - 1 to n; every seventh takes over the next
    user's first name."""
    up = raw(spark, sf_dir).where("kind = 'deploy' and value >= 100")
    up = up.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    new = F.when(F.col("event_id") % 7 == 0, service_name(F.col("user_id") + 1, F.lit(0))).otherwise(service_name(F.col("user_id"), F.col("n")))
    return up.select(F.col("event_id").alias("seq"), "user_id", service_name(F.col("user_id"), F.col("n") - 1).alias("old_name"), new.alias("new_name"))


def rename_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, old_name, new_name, cid): renames with the id that each gives its new name."""
    return kept(spark, sf_dir, "renames", lambda: I.rename_ids(renames(spark, sf_dir)))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw() with service, the name that an event comes under, and cid, what that name means at the time by the rename log."""

    def make() -> DataFrame:
        up = renames(spark, sf_dir).select("user_id", F.col("seq").alias("r_seq"), "new_name")
        e = asof_join(raw(spark, sf_dir), up, ["user_id"], "event_id", "r_seq", ["new_name"], ["new_name"], width=I.SEQ_WIDTH)
        e = e.withColumn("service", F.coalesce("asof.new_name", service_name(F.col("user_id"), F.lit(0)))).drop("asof")
        return I.identified(e, rename_log(spark, sf_dir))

    return kept(spark, sf_dir, "events", make)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, name, seq): all names of every id in order, those that never took part in a rename included."""
    return I.registered(I.aliases_of(rename_log(spark, sf_dir)), ops(spark, sf_dir))


def signals(events: DataFrame) -> DataFrame:
    return events.where("kind = 'incident_signal'").select(F.col("event_id").alias("signal_id"), F.col("ts").alias("anchor"), "cid", "user_id", "service")


def with_token(events: DataFrame) -> DataFrame:
    return events.withColumn("token", event_token(F.col("kind"), F.col("metric"), F.col("message")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, src, dst): each click of user u calls user 7 u + k mod 3 (modulo the users) by its first name, which the rename log resolves."""
    e = ops(spark, sf_dir)
    users = e.agg((F.max("user_id") + 1).alias("users"))
    called = service_name((F.col("user_id") * 7 + F.col("k") % 3) % F.col("users"), F.lit(0))
    calls = e.where("kind = 'trace'").crossJoin(F.broadcast(users)).select("event_id", "ts", called.alias("service"), F.col("cid").alias("src"))
    return I.identified(calls, rename_log(spark, sf_dir)).select("event_id", "ts", "src", F.col("cid").alias("dst"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the three rules of edge synthesis see."""

    def make() -> DataFrame:
        e = ops(spark, sf_dir)
        return G.deploy_edges(e, HOUR).unionByName(G.upstream_edges(spans(spark, sf_dir))).unionByName(G.incident_log_edges(e, HOUR))

    return kept(spark, sf_dir, "observations", make)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal graph as ingestion leaves it."""
    return kept(spark, sf_dir, "edges", lambda: G.roll_up(observations(spark, sf_dir)))


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename log, event log, observations and graph made anew, whatever has been kept; the graph."""
    forget(spark, sf_dir)
    return edges(spark, sf_dir)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate past incidents of a signal: one for each order of a customer."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("signal_id"),
        F.concat(F.when(F.col("o_orderkey") % 11 == 0, "inc-").otherwise("INC-"), F.col("o_orderkey").cast("string"), F.lit("-"), (F.col("o_orderkey") % 5).cast("string")).alias("incident_id"),
        F.col("o_orderkey").alias("seq"),
        ((F.col("o_orderkey") * 7919 % 1000) / 1000).alias("similarity"),
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.element_at(F.array(*map(F.lit, ("rollback", "restart", "scale up", "failover", "drain"))), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("action"),
        F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("failed").alias("outcome"),
        (F.col("o_orderkey") % 3 != 0).alias("has_deploy"),
        (F.col("o_orderkey") % 4 != 0).alias("has_metric"),
        (F.col("o_orderkey") % 5 != 0).alias("has_trace_log"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked families predicted for an incident: a row for each line of an order, by its number; family 5 is a decoy's (null)."""
    li = table(spark, sf_dir, "lineitem")
    truth = F.nullif(F.col("l_orderkey") % 6, F.lit(5))
    rows = li.select(F.col("l_orderkey").alias("incident_id"), truth.alias("truth"), (F.col("l_suppkey") % 5).alias("family"), (F.col("l_quantity") / 50).alias("similarity"), "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.desc("similarity"), "l_partkey", "l_suppkey", "l_extendedprice"]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(*order))).where("rank <= 5").select("incident_id", "truth", "family", "similarity", "rank")


def seed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, run, recall, precision, remediation, p95): metrics of two runs of every seed, from the lines of a supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 50).alias("seed"), F.when(F.col("l_returnflag") == "R", "new").otherwise("old").alias("run")).agg(
        F.round(F.avg("l_discount") * 8, 6).alias("recall"),
        F.round(F.avg("l_tax") * 10, 6).alias("precision"),
        F.round(F.avg("l_quantity") / 60, 6).alias("remediation"),
        (F.max("l_extendedprice") / 20).alias("p95"),
    )


def remedies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(incident_id, truth, expected, action, confidence) of the incidents of predictions(): some expect no remedy, some get none."""
    o = table(spark, sf_dir, "orders")
    name = lambda n: F.element_at(F.array(*map(F.lit, ("rollback", "restart", "scale up"))), (n % 3 + 1).cast("int"))
    key = F.col("o_orderkey")
    return o.select(
        key.alias("incident_id"),
        F.nullif(key % 6, F.lit(5)).alias("truth"),
        F.when(key % 7 != 0, name(key)).alias("expected"),
        F.when(key % 9 != 0, name(F.when(key % 4 == 0, key + 1).otherwise(key))).alias("action"),
        ((key * 7919 % 100) / 100).alias("confidence"),
    )
