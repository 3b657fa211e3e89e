"""Service identity across renames, applied in order: the new name takes over the id that the old name has at that moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import infer_role, service_id
from tidemark.session import cut

from .temporal import asof_join

#: Sequence numbers that one task carries a name's meaning over.
SEQ_WIDTH = float(1 << 16)


def rename_ids(renames: DataFrame) -> DataFrame:
    """(seq, old_name, new_name, cid) for renames (seq, old_name, new_name).

    A rename's parent is the latest earlier rename into its old name; without one the old name is a root with an id of its own. Parents are
    followed by pointer doubling, in as many rounds as the longest chain has binary digits.
    """
    into = renames.select(F.col("new_name").alias("old_name"), F.col("seq").alias("p_seq"))
    before = renames.select("seq", "old_name", "new_name", (F.col("seq") - 1).alias("before"))
    linked = asof_join(before, into, ["old_name"], "before", "p_seq", [], ["p_seq"], width=SEQ_WIDTH)
    rows = cut(linked.select("seq", "old_name", "new_name", F.col("asof.ts").cast("long").alias("parent"), F.col("old_name").alias("root")))
    while rows.where("parent is not null").limit(1).count():
        up = rows.select(F.col("seq").alias("parent"), F.col("parent").alias("grand"), F.col("root").alias("up_root"))
        rows = cut(rows.join(up, "parent", "left").select("seq", "old_name", "new_name", F.col("grand").alias("parent"), F.coalesce("up_root", "root").alias("root")))
    return rows.select("seq", "old_name", "new_name", service_id(F.col("root")).alias("cid"))


def identified(events: DataFrame, log: DataFrame, name: str = "service", at: str = "event_id") -> DataFrame:
    """events with cid: what their name means as of `at` by the log of rename_ids(), the id of the last rename into it so far; a name that no
    rename has touched yet, known or not, has an id of its own. A null name has none."""
    into = log.select(F.col("new_name").alias(name), F.col("seq").alias("r_seq"), F.col("cid").alias("r_cid"))
    out = asof_join(events, into, [name], at, "r_seq", ["r_cid"], ["r_cid"], width=SEQ_WIDTH)
    return out.withColumn("cid", F.coalesce("asof.r_cid", service_id(F.col(name)))).drop("asof")


def rename_history(log: DataFrame, cids: DataFrame | None = None) -> DataFrame:
    """(cid, seq, old_name, new_name) of the renames that an id went through, of all or of some ids (cid)."""
    out = log.select("cid", "seq", "old_name", "new_name")
    return out if cids is None else out.join(cids.select("cid").distinct(), "cid", "left_semi")


def registered(alias: DataFrame, events: DataFrame, name: str = "service") -> DataFrame:
    """alias (cid, name, seq) with the names under which events (cid, name) came, known before any rename where no alias says otherwise."""
    seen = events.where(F.col(name).isNotNull()).select("cid", F.col(name).alias("name")).distinct().where(F.col("cid") == service_id(F.col("name")))
    new = seen.select("cid", "name", F.lit(-1).cast("long").alias("seq"))
    return alias.unionByName(new).groupBy("cid", "name").agg(F.min("seq").alias("seq"))


def current_ids(done: DataFrame) -> DataFrame:
    """(name, cid) of every name in the log of rename_ids(): of the last rename into it, else its own."""
    last = done.groupBy(F.col("new_name").alias("name")).agg(F.max_by("cid", "seq").alias("cid"))
    names = done.select(F.col("old_name").alias("name")).union(done.select("new_name")).distinct()
    return names.join(last, "name", "left").select("name", F.coalesce("cid", service_id(F.col("name"))).alias("cid"))


def aliases_of(done: DataFrame) -> DataFrame:
    """(cid, name, seq) from the log of rename_ids(): names in the order in which they first joined an id; roots come first, with the number -1."""
    roots = done.select(F.col("old_name").alias("name")).distinct().select(service_id(F.col("name")).alias("cid"), "name", F.lit(-1).cast("long").alias("seq"))
    roots = roots.join(done.select("cid").distinct(), "cid", "left_semi")
    every = roots.unionByName(done.select("cid", F.col("new_name").alias("name"), F.col("seq").cast("long").alias("seq")))
    return every.groupBy("cid", "name").agg(F.min("seq").alias("seq"))


def current_names(alias: DataFrame) -> DataFrame:
    """(cid, name): the alias added last."""
    return alias.groupBy("cid").agg(F.max_by("name", F.struct("seq", "name")).alias("name"))


def roles(alias: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(cid, role): an override, else the first alias's role that is not `service`, else `service`."""
    seen = alias.withColumn("role", infer_role(F.col("name")))
    out = seen.groupBy("cid").agg(F.coalesce(F.min_by("role", F.when(F.col("role") != "service", F.struct("seq", "name"))), F.lit("service")).alias("role"))
    if overrides is None:
        return out
    pinned = overrides.select("cid", F.lower(F.trim("role")).alias("pinned"))
    return out.join(pinned, "cid", "full").select("cid", F.coalesce("pinned", "role").alias("role"))


def fingerprints(events: DataFrame, by: str) -> DataFrame:
    """(by, fingerprint, n): a digest of a group's sorted (cid, kind, first 50 characters of the message), each distinct one with its number of
    times, so that a group's array is as long as it has distinct events."""
    part = F.concat_ws("|", F.coalesce("cid", F.lit("")), "kind", F.substring(F.coalesce("message", F.lit("")), 1, 50))
    each = events.groupBy(by, part.alias("part")).agg(F.count("*").alias("n"))
    said = F.concat_ws("|", "part", F.col("n").cast("string"))
    return each.groupBy(by).agg(F.md5(F.array_join(F.array_sort(F.collect_list(said)), ";")).alias("fingerprint"), F.sum("n").alias("n"))
