"""Incremental state: edges, motif memory and open incidents kept up by micro-batches, equal to the batch result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import service_id
from tidemark.operators import motifs as M
from tidemark.operators.graph import CAP, FIRST, STEP
from tidemark.operators.identity import current_ids, rename_ids

KEYS = ["src", "dst"]


def _fold(observations: DataFrame) -> DataFrame:
    """(src, dst, relation, at, n, first_seen, last_seen): a mergeable summary of observations by relation."""
    o = observations.where("ts_src < ts_dst").withColumn("at", F.struct("ts_dst", "seq", "relation", "ts_src"))
    return o.groupBy(*KEYS, "relation").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.min_by("ts_src", "at").alias("first_seen"), F.max_by("ts_dst", "at").alias("last_seen"))


def merge(state: DataFrame | None, observations: DataFrame) -> DataFrame:
    """The state with a batch's observations: summaries add, whatever the order of batches."""
    new = _fold(observations)
    if state is None:
        return new
    both = state.unionByName(new)
    return both.groupBy(*KEYS, "relation").agg(F.min("at").alias("at"), F.sum("n").alias("n"), F.min_by("first_seen", "at").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def edges(state: DataFrame) -> DataFrame:
    """The edges that a state stands for, as roll_up() would make them."""
    best = state.groupBy(*KEYS).agg(F.min_by(F.struct("relation", "n", "first_seen", "last_seen"), "at").alias("e")).select(*KEYS, "e.*")
    return best.select(*KEYS, "relation", F.col("n").alias("count"), "first_seen", "last_seen", F.least(F.lit(CAP), F.lit(FIRST) + F.lit(STEP) * (F.col("n") - 1)).alias("confidence"))


def keep(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame] = lambda batch: batch, fold: Callable[[DataFrame | None, DataFrame], DataFrame] = merge) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the state fold(state, make(batch)) in versions under path.

    A batch that comes again after a failure changes nothing. The batch before must have left its version: without it the state would silently begin
    anew, so that is an error.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = lambda v: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}/_SUCCESS"))
        if done(batch_id):
            return
        if batch_id and not done(batch_id - 1):
            raise RuntimeError(f"the state of batch {batch_id - 1} is missing under {path}")
        old = spark.read.parquet(f"{path}/v{batch_id - 1}") if batch_id else None
        fold(old, make(batch)).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        if batch_id > 1:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v{batch_id - 2}"), True)

    return run


def last_state(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last batch."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    whole = [int(n[1:]) for n in found if n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if not whole:
        raise RuntimeError(f"no batch was read into {path}")
    return spark.read.parquet(f"{path}/v{max(whole)}")


def drained(spark: SparkSession, source: str, schema, path: str, checkpoint: str, files: int = 1, make: Callable[[DataFrame], DataFrame] = lambda batch: batch, fold: Callable[[DataFrame | None, DataFrame], DataFrame] = merge) -> DataFrame:
    """The state after a folder of Parquet files has been read as a stream until it is drained, `files` at a time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(keep(spark, path, make, fold)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return last_state(spark, path)


def stream_edges(spark: SparkSession, source: str, schema, path: str, checkpoint: str, files: int = 1, make: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Edges from a folder of Parquet observations, read as a stream until it is drained."""
    return edges(drained(spark, source, schema, path, checkpoint, files, make))


def renames_first(batch: DataFrame, log: DataFrame) -> DataFrame:
    """The events of a batch with cid as it is applied: all its renames first, whatever their time, then the rest.

    batch has (event_id, kind, service, old_name, new_name, ...), log what earlier batches renamed (seq, old_name, new_name); renames of the batch come
    after it, in their own order.
    """
    new = batch.where("kind = 'topology' and new_name is not null").select("event_id", "old_name", "new_name")
    top = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top"))
    number = F.row_number().over(Window.orderBy("event_id"))  # the renames of one batch
    new = new.withColumn("n", number).crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).cast("long").alias("seq"), "old_name", "new_name")
    now = current_ids(rename_ids(log.select("seq", "old_name", "new_name").unionByName(new)))
    out = batch.join(now.select(F.col("name").alias("service"), F.col("cid").alias("known")), "service", "left")
    return out.withColumn("cid", F.coalesce("known", service_id(F.col("service")))).drop("known")


def fold_open(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Open incidents (cid, signal_id, opened) after a batch of events (cid, kind, event_id, ts): signals open one, a later remediation of the service
    closes all. Batches come in the order of time."""
    fixed = batch.where("kind = 'remediation'").groupBy("cid").agg(F.max("ts").alias("fixed"))
    new = batch.where("kind = 'incident_signal'").select("cid", F.col("event_id").alias("signal_id"), F.col("ts").alias("opened"))
    every = new if state is None else state.unionByName(new)
    return every.join(fixed, "cid", "left").where("fixed is null or fixed < opened").drop("fixed")


def fold_motifs(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Motif memory (id, created, confidence, successes) after a batch of outcomes (id, at, seq, success): a first success indexes the motif, then its
    confidence goes on from where the state left it."""
    order = F.array_sort(F.collect_list(F.struct("at", "seq", "success")))
    new = batch.groupBy("id").agg(order.alias("o"), F.min("at").alias("first"), F.count_if("success").alias("more"))
    blank = [F.lit(None).cast("double").alias("created"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("successes")]
    old = new.select("id", *blank).where("false") if state is None else state
    step = lambda c, o: F.when(o["success"], F.least(F.lit(M.CAP), c + M.GAIN)).otherwise(F.greatest(F.lit(M.FLOOR), c * M.LOSS))
    both = old.join(new, "id", "full")
    begun = F.coalesce("confidence", F.lit(M.START))
    return both.select(
        "id",
        F.coalesce("created", "first").alias("created"),
        F.when(F.col("o").isNull(), begun).otherwise(F.aggregate("o", begun, step)).alias("confidence"),
        (F.coalesce("successes", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("successes"),
    )


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Streaming counts of signals and fixes by service in hours of event time; the watermark bounds the state."""
    hours = F.window("at", "1 hour")
    return events.withWatermark("at", late).groupBy(hours, "service").agg(F.count_if(F.col("kind") == "incident_signal").alias("signals"), F.count_if(F.col("kind") == "remediation").alias("fixes"))
