"""Reports in and out: nested JSON, flat and long CSV, snapshots of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(seed, incident ...) rows of a nested report: per_seed[].per_incident[]."""
    report = spark.read.option("multiLine", True).json(path)
    seeds = report.select(F.explode("per_seed").alias("s"))
    return seeds.select(F.col("s.seed").alias("seed"), F.explode("s.per_incident").alias("i")).select("seed", "i.*")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, text) of a configuration file, with or without a `config` wrapper: every plain key with its text, and its value where that is a number
    or a truth value."""
    raw = spark.read.option("multiLine", True).json(path)
    body = raw.select("config.*") if "config" in raw.columns else raw
    plain = [c for c, kind in body.dtypes if not kind.startswith(("struct", "array", "map"))]
    numbers = {c for c, kind in body.dtypes if kind in ("double", "bigint", "int", "boolean")}
    cells = [F.struct(F.lit(c).alias("key"), (F.col(f"`{c}`").cast("double") if c in numbers else F.lit(None).cast("double")).alias("value"), F.col(f"`{c}`").cast("string").alias("text")) for c in plain]
    return body.select(F.inline(F.array(*cells)))


def write_config(config: DataFrame, metadata: DataFrame, path: str) -> None:
    """A configuration (key, value) as one JSON object under `config`, beside its metadata (one row)."""
    body = config.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("config"))
    body.crossJoin(metadata.select(F.struct("*").alias("metadata"))).write.mode("overwrite").json(path)


def write_diagnostics(incidents: DataFrame, ranked: DataFrame, path: str) -> None:
    """One CSV row for each incident, its ranked families packed as rank:family;..."""
    packed = ranked.groupBy("incident_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "family"))), lambda r: F.concat_ws(":", r["rank"].cast("string"), r["family"].cast("string"))), ";").alias("ranked"))
    incidents.join(packed, "incident_id", "left").write.mode("overwrite").option("header", True).csv(path)


def write_long(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)


def write_deltas(deltas: DataFrame, path: str) -> None:
    """Seed deltas as CSV in one global order: the most improved first, then by seed."""
    deltas.orderBy(F.desc("delta"), "seed").write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(f"{path}/metadata")
    rows.write.mode("overwrite").json(f"{path}/records")


#: Parts of the engine's state, as a snapshot has them.
PARTS = ("events", "renames", "aliases", "roles", "edges", "deploys", "remediations", "motifs")


def save(tables: dict[str, DataFrame], path: str) -> None:
    """A snapshot of the engine's state: one Parquet table for each part, under a version of its own that counts once all are written."""
    unknown = set(tables) - set(PARTS)
    if unknown:
        raise ValueError(f"no parts of the state: {', '.join(sorted(unknown))}")
    spark = next(iter(tables.values())).sparkSession
    version = max([-1, *_versions(spark, path)]) + 1
    for name, df in tables.items():
        df.write.parquet(f"{path}/v{version}/{name}")
    spark.createDataFrame([(name,) for name in sorted(tables)], "part string").coalesce(1).write.parquet(f"{path}/v{version}/_parts")


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at)]
    return [int(n[1:]) for n in found if n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_parts/_SUCCESS"))]


def reopen(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of the latest whole snapshot under path; none if there is none."""
    versions = _versions(spark, path)
    if not versions:
        return {}
    at = f"{path}/v{max(versions)}"
    return {r[0]: spark.read.parquet(f"{at}/{r[0]}") for r in spark.read.option("recursiveFileLookup", True).parquet(f"{at}/_parts").collect()}


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A table of a small result."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
