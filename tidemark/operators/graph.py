"""The causal graph: edge synthesis, roll-up, chains, root causes, comparison, decay and reinforcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import service_id
from tidemark.session import stored

from .temporal import asof_join, band_join

FIRST, STEP, CAP, FLOOR = 0.30, 0.05, 0.95, 0.10
DAY = 86400.0


def deploy_edges(events: DataFrame, tolerance: float) -> DataFrame:
    """Observations (src, dst, relation, evidence, ts_src, ts_dst, seq): a log, metric or trace after the last deploy of its service."""
    seen = events.where("kind in ('log', 'metric', 'trace')").select("cid", "ts", "event_id", "kind")
    deploys = events.where("kind = 'deploy'").select("cid", F.col("ts").alias("d_ts"), F.col("event_id").alias("deploy_id"))
    got = asof_join(seen, deploys, ["cid"], "ts", "d_ts", ["deploy_id"], ["deploy_id"], tolerance).where("asof is not null")
    return got.select(F.col("cid").alias("src"), F.col("cid").alias("dst"), F.concat(F.lit("deploy_to_"), "kind").alias("relation"), F.col("event_id").alias("evidence"), F.col("asof.ts").alias("ts_src"), F.col("ts").alias("ts_dst"), F.col("event_id").alias("seq"))


def upstream_edges(spans: DataFrame) -> DataFrame:
    """Observations of calls: spans (event_id, ts, src, dst) to another service, a second later."""
    return spans.where("src <> dst").select("src", "dst", F.lit("upstream_call").alias("relation"), F.col("event_id").alias("evidence"), F.col("ts").alias("ts_src"), (F.col("ts") + 1).alias("ts_dst"), F.col("event_id").alias("seq"))


def incident_log_edges(events: DataFrame, longest: float) -> DataFrame:
    """Observations of error logs while an incident of the service is open: from its signal until the next remediation, `longest` at most."""
    fixes = events.where("kind = 'remediation'").select("cid", (-F.col("ts")).alias("r_ts"), F.col("event_id").alias("fix"))
    opened = events.where("kind = 'incident_signal'").select("cid", (-F.col("ts")).alias("n_ts"), F.col("event_id").alias("signal"))
    opened = asof_join(opened, fixes, ["cid"], "n_ts", "r_ts", ["fix"], ["fix"])  # times negated: the next at or after
    opened = opened.select("cid", "signal", (-F.col("n_ts")).alias("s_ts"), (-F.col("asof.ts")).alias("until"))
    logs = events.where("kind = 'log'").select("cid", F.col("event_id").alias("log"), F.col("ts").alias("l_ts"))
    got = band_join(opened, logs, ["cid"], "s_ts", "l_ts", 0.0, longest).where("l_ts < coalesce(until, double('Infinity'))")
    return got.select(F.col("cid").alias("src"), F.col("cid").alias("dst"), F.lit("error_log_during_incident").alias("relation"), F.col("log").alias("evidence"), F.col("s_ts").alias("ts_src"), F.col("l_ts").alias("ts_dst"), F.col("log").alias("seq"))


def roll_up(observations: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the first observation's relation wins and only its observations count; confidence grows to a cap.

    Observations that do not run forward in time are dropped. Arrival order is (ts_dst, seq, relation, ts_src).
    """
    order = F.struct("ts_dst", "seq", "relation", "ts_src")
    o = observations.where("ts_src < ts_dst").withColumn("at", order)
    # By relation first, then the relation whose first observation is the earliest: partial aggregates of the observations, and no join back.
    by = o.groupBy("src", "dst", "relation").agg(
        F.count("*").alias("count"),
        F.min_by("ts_src", "at").alias("first_seen"),
        F.max_by("ts_dst", "at").alias("last_seen"),
        F.count_distinct("evidence").alias("evidence_count"),
        F.min("at").alias("at"),
    )
    fields = F.struct("relation", "count", "first_seen", "last_seen", "evidence_count")
    out = by.groupBy("src", "dst").agg(F.min_by(fields, "at").alias("e")).select("src", "dst", "e.*")
    return out.withColumn("confidence", F.least(F.lit(CAP), F.lit(FIRST) + F.lit(STEP) * (F.col("count") - 1)))


def stats(edges: DataFrame, deploys: DataFrame, remediations: DataFrame) -> DataFrame:
    """One row: nodes, edges, deploys, remediations, mean confidence."""
    nodes = edges.select("src").union(edges.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    own = edges.agg(F.count("*").alias("edges"), (F.sum("confidence") / F.greatest(F.count("*"), F.lit(1))).alias("avg_confidence"))
    return nodes.crossJoin(own).crossJoin(deploys.agg(F.count("*").alias("deploys"))).crossJoin(remediations.agg(F.count("*").alias("remediations")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(cid, near): services one edge away, either direction; a self-loop makes a service its own neighbour."""
    return edges.select(F.col("src").alias("cid"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct()


def reach(starts: DataFrame, edges: DataFrame, max_hops: int, min_confidence: float) -> DataFrame:
    """(start, node, hops): nodes within max_hops of each start, undirected, over edges of the confidence. One join a hop."""
    links = neighbours(edges.where(F.col("confidence") >= min_confidence)).where("cid <> near")
    seen = starts.select(F.col("cid").alias("start"), F.col("cid").alias("node")).distinct().withColumn("hops", F.lit(0))
    front = seen
    for h in range(1, max_hops + 1):
        front = front.join(links, front.node == links.cid).select("start", F.col("near").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def causal_chain(starts: DataFrame, edges: DataFrame, max_hops: int = 2, min_confidence: float = 0.3) -> DataFrame:
    """(start, src, dst, relation, confidence, first_seen, times): edges at the reached nodes, as often as an endpoint is one (a loop twice)."""
    near = reach(starts, edges, max_hops, min_confidence).select("start", "node")
    good = edges.where(F.col("confidence") >= min_confidence).select("src", "dst", "relation", "confidence", "first_seen")
    ends = good.select(F.col("src").alias("node"), "src", "dst").union(good.select("dst", "src", "dst"))
    times = near.join(ends, "node").groupBy("start", "src", "dst").agg(F.count("*").alias("times"))
    return times.join(good, ["src", "dst"]).select("start", "src", "dst", "relation", "confidence", "first_seen", "times")


def chain_confidence(chain: DataFrame) -> DataFrame:
    """(start, edges, confidence): the mean over a chain, with multiplicity."""
    return chain.groupBy("start").agg(F.sum("times").alias("edges"), (F.sum(F.col("times") * F.col("confidence")) / F.sum("times")).alias("confidence"))


def ordered_chain(chain: DataFrame) -> DataFrame:
    """A chain with the place of each edge in it: by first sight, then by source and destination."""
    return chain.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy("first_seen", "src", "dst")))


def shown_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges as they are told: ids by their current names (cid, name) where there is one, confidence to three decimals."""
    n = names.select("cid", "name")
    out = edges.join(n.select(F.col("cid").alias("src"), F.col("name").alias("src_name")), "src", "left").join(n.select(F.col("cid").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")
    return out.withColumn("cause", F.coalesce("src_name", "src")).withColumn("effect", F.coalesce("dst_name", "dst")).withColumn("confidence", F.round("confidence", 3)).drop("src_name", "dst_name")


def edge_of(edges: DataFrame, src: str, dst: str, relation: str | None = None) -> DataFrame:
    """The edge between two ids, none if a relation is given and it has another."""
    out = edges.where((F.col("src") == src) & (F.col("dst") == dst))
    return out if relation is None else out.where(F.col("relation") == relation)


def evidence_of(evidence: DataFrame) -> DataFrame:
    """(src, dst, ev): how much distinct evidence (src, dst, evidence) an edge has."""
    return evidence.groupBy("src", "dst").agg(F.count_distinct("evidence").alias("ev"))


def evidence_again(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """(start, cid, again): what the sum over the edges of a path counts too often, as evidence of several edges. Other evidence is not joined."""
    e = evidence.where("src <> dst and evidence is not null").select("src", "dst", "evidence").distinct()
    several = e.groupBy("evidence").agg(F.count("*").alias("n")).where("n > 1").select("evidence")
    shared = stored(e.join(several, "evidence"))
    if shared.isEmpty():
        return found.select("start", "cid", F.lit(0).cast("long").alias("again")).where("false")
    steps = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    of = found.select("start", "cid", F.explode(steps).alias("e")).select("start", "cid", "e.src", "e.dst").join(shared, ["src", "dst"])
    return of.groupBy("start", "cid").agg((F.count("*") - F.count_distinct("evidence")).alias("again"))


def root_nodes(starts: DataFrame, good: DataFrame, known: DataFrame, max_hops: int) -> DataFrame:
    """Those of known (start, cid, ...), nodes with a path to the start, that no edge of the start's graph leads to; of a graph without any such
    node those with one, but the start.

    A reached node has all its edges in the graph; one beyond has those with reached nodes. Whether a graph has a node without an incoming
    edge is answered by a reached one or one of known, where there is any; only for other starts all nodes beyond are looked at.
    """
    links = stored(neighbours(good).where("cid <> near"))
    front = stored(starts.select(F.col("cid").alias("start"), F.col("cid").alias("node")).distinct())
    near = front
    for _ in range(max_hops):
        step = front.join(links, front.node == links.cid).select("start", F.col("near").alias("node")).distinct()
        front = stored(step.join(near, ["start", "node"], "left_anti"))
        near = near.unionByName(front)
    degree = good.groupBy(F.col("dst").alias("cid")).agg(F.count("*").alias("n_all"))
    reached = near.select("start", F.col("node").alias("cid"), F.lit(True).alias("reached"))
    marked = known.join(reached, ["start", "cid"], "left").join(degree, "cid", "left")
    beyond = marked.where("reached is null").select("start", "cid").join(good.select("src", F.col("dst").alias("cid")), "cid").select("start", "cid", "src")
    beyond = beyond.join(near.select("start", F.col("node").alias("src")), ["start", "src"]).groupBy("start", "cid").agg(F.count("*").alias("n_beyond"))
    n = F.coalesce(F.when(F.col("reached"), F.col("n_all")).otherwise(F.col("n_beyond")), F.lit(0))
    marked = stored(marked.join(beyond, ["start", "cid"], "left").withColumn("n", n).where("n <= 1").drop("reached", "n_all", "n_beyond"))
    inner = near.join(degree.withColumnRenamed("cid", "node"), "node", "left_anti").select("start").distinct()
    lone = stored(marked.where("n = 0").select("start").union(inner).distinct())
    # Nodes beyond, of the other starts: seen by an edge to the last ones reached, and by none from these.
    last = front.join(lone, "start", "left_anti")
    into = last.join(good.select("src", F.col("dst").alias("node")), "node").select("start", F.col("src").alias("cid")).distinct()
    out = last.join(good.select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("cid")).distinct()
    more = into.join(out, ["start", "cid"], "left_anti").join(reached.select("start", "cid"), ["start", "cid"], "left_anti").select("start").distinct()
    marked = marked.join(lone.union(more).select("start", F.lit(True).alias("lone")), "start", "left")
    return marked.where("(lone and n = 0) or (lone is null and cid <> start)").drop("n", "lone")


def root_causes(starts: DataFrame, edges: DataFrame, evidence: DataFrame | None = None, deploys: DataFrame | None = None, max_hops: int = 3, min_confidence: float = 0.25) -> DataFrame:
    """(start, cid, hops, confidence, evidence_count, earliest, path, rank): nodes of a start's graph without an incoming edge (else with one, the
    start excepted) that a directed path leads from to the start.

    The shortest path counts, of equally short ones the least in code-point order: the mean of its confidences, the distinct evidence
    (src, dst, evidence) of its edges, and the earliest first sight of one, or the source's latest deploy (cid, ts) if that was earlier.
    Ranked by confidence to three decimals, then by hops and id. Without evidence or deploys the counts are 0 and the times those of the edges.
    """
    # A directed path of h steps to the start leaves no reached node before its last step, so all its edges are in the start's graph: the paths and the
    # degrees come from the edges themselves, and no start's graph is written out.
    good = edges.where(F.col("confidence") >= min_confidence).select("src", "dst", "confidence", "first_seen")
    zero = F.lit(0).cast("long")
    good = stored(good.join(evidence_of(evidence), ["src", "dst"], "left").withColumn("ev", F.coalesce("ev", zero)) if evidence is not None else good.withColumn("ev", zero))
    blank = F.lit(None).cast("double")
    paths = starts.select(F.col("cid").alias("start"), F.col("cid").alias("at"), F.array("cid").alias("path"), F.lit(0).alias("hops"), F.lit(0.0).alias("total"), blank.alias("earliest"), zero.alias("evidence_count")).distinct()
    known = paths
    for h in range(1, max_hops + 2):
        step = paths.join(good.where("src <> dst"), F.col("at") == F.col("dst"))
        step = step.select("start", F.col("src").alias("at"), F.concat(F.array("src"), "path").alias("path"), F.lit(h).alias("hops"), (F.col("total") + F.col("confidence")).alias("total"), F.least("earliest", "first_seen").alias("earliest"), (F.col("evidence_count") + F.col("ev")).alias("evidence_count"))
        step = step.groupBy("start", "at").agg(F.min_by(F.struct("path", "hops", "total", "earliest", "evidence_count"), "path").alias("b")).select("start", "at", "b.*")
        paths = stored(step.join(known.select("start", "at"), ["start", "at"], "left_anti"))
        known = known.unionByName(paths)
    found = root_nodes(starts, good, known.withColumnRenamed("at", "cid"), max_hops)
    if evidence is not None:
        found = found.join(evidence_again(found, evidence), ["start", "cid"], "left").withColumn("evidence_count", F.col("evidence_count") - F.coalesce("again", zero))
    else:
        found = found.withColumn("evidence_count", zero)
    if deploys is not None:
        found = found.join(deploys.groupBy("cid").agg(F.max("ts").alias("deployed")), "cid", "left").withColumn("earliest", F.least("earliest", "deployed"))
    sure = F.when(F.col("hops") > 0, F.col("total") / F.col("hops")).otherwise(0.0)
    found = found.select("start", "cid", F.col("hops").cast("long").alias("hops"), sure.alias("confidence"), F.coalesce("evidence_count", F.lit(0).cast("long")).alias("evidence_count"), "earliest", "path")
    rank = F.row_number().over(Window.partitionBy("start").orderBy(F.desc(F.round(F.col("confidence") + 1e-9, 3)), "hops", "cid"))
    return found.withColumn("rank", rank.cast("long"))


def compare(sides: DataFrame, edges: DataFrame, max_hops: int = 3, min_confidence: float = 0.25) -> DataFrame:
    """(a, b, score) of pairs of services: how alike their graphs are in nodes, edges, mean degree and relations."""
    starts = sides.select(F.col("a").alias("cid")).union(sides.select("b")).distinct()
    graph = causal_chain(starts, edges, max_hops, min_confidence)
    ends = graph.select("start", F.col("src").alias("n")).union(graph.select("start", "dst")).union(starts.select("cid", "cid"))
    nodes = ends.distinct().groupBy("start").agg(F.count("*").alias("nodes"))
    own = graph.groupBy("start").agg(F.count("*").alias("edges"), F.collect_set("relation").alias("relations"))
    one = nodes.join(own, "start", "left").select("start", "nodes", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"), F.coalesce("relations", F.array().cast("array<string>")).alias("relations"))
    pair = sides.join(one.select(F.col("start").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("nodes", "edges", "relations")]), "a").join(one.select(F.col("start").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("nodes", "edges", "relations")]), "b")
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y)
    degree = [2 * F.col(f"edges_{s}") / F.col(f"nodes_{s}") for s in "ab"]
    none = (F.col("edges_a") == 0) | (F.col("edges_b") == 0)
    most = F.greatest(F.size("relations_a"), F.size("relations_b"))
    shared = F.when(most == 0, 0.5).otherwise(F.size(F.array_intersect("relations_a", "relations_b")) / F.greatest(most, F.lit(1)))
    score = 0.35 * ratio(F.col("nodes_a"), F.col("nodes_b")) + F.when(none, 0.0).otherwise(0.35 * ratio(F.col("edges_a"), F.col("edges_b")) + 0.20 * ratio(*degree)) + 0.10 * shared
    return pair.select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def decay_exponential(confidence: Column, last: Column, now: Column) -> Column:
    """0.99 for each full day, FLOOR at least; unchanged within the first day."""
    days = F.floor((now - last) / DAY)
    return F.when(days >= 1, F.greatest(F.lit(FLOOR), confidence * F.pow(F.lit(0.99), days))).otherwise(confidence)


def decay_linear(confidence: Column, last: Column, now: Column) -> Column:
    """A hundredth for each day or part, FLOOR at least."""
    return F.greatest(F.lit(FLOOR), confidence - 0.01 * F.abs(now - last) / DAY)


def decayed_out(edges: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """edges with the linear decay applied to those that go out from the nodes (cid), and whether it changed anything."""
    out = edges.join(nodes.select(F.col("cid").alias("src"), F.lit(True).alias("mine")).distinct(), "src", "left")
    new = F.when(F.col("mine"), decay_linear(F.col("confidence"), F.col("last_seen"), now)).otherwise(F.col("confidence"))
    return out.withColumn("changed", F.coalesce(new != F.col("confidence"), F.lit(False))).withColumn("confidence", new).drop("mine")


def _reached(edges: DataFrame, resolved: DataFrame, max_hops: int) -> DataFrame:
    """(cid, src, dst, ts, n): edges of a service's chain that were there when n of its remediations resolved at ts."""
    by = resolved.groupBy("cid", "ts").agg(F.count("*").alias("n"))
    chain = causal_chain(by.select("cid").distinct(), edges, max_hops, 0.0).select(F.col("start").alias("cid"), "src", "dst", "first_seen")
    return chain.join(by, "cid").where("ts >= first_seen").drop("first_seen")


def reinforced(edges: DataFrame, resolved: DataFrame, max_hops: int = 2) -> DataFrame:
    """edges with `times` and the confidence after every resolved remediation (cid, ts) of a service whose chain has the edge by then."""
    hits = _reached(edges, resolved, max_hops).groupBy("src", "dst").agg(F.sum("n").alias("times"))
    out = edges.join(hits, ["src", "dst"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return out.withColumn("confidence", F.least(F.lit(CAP), F.col("confidence") + F.lit(STEP) * F.col("times")))


def provenance(edges: DataFrame, resolved: DataFrame, max_hops: int = 2) -> DataFrame:
    """(src, dst, cid, ts, old, new): by which service's resolved remediations an edge was reinforced, in order, and from what to what."""
    hits = _reached(edges, resolved, max_hops)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "dst").orderBy("ts", "cid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = hits.withColumn("before", before).join(edges.select("src", "dst", "confidence"), ["src", "dst"])
    at = lambda n: F.least(F.lit(CAP), F.col("confidence") + F.lit(STEP) * n)
    return hits.select("src", "dst", "cid", "ts", at(F.col("before")).alias("old"), at(F.col("before") + F.col("n")).alias("new"))


def deploy_state(events: DataFrame) -> DataFrame:
    """(cid, deploys, last, version): what the deploy tracker holds of each service, the latest by time, then by id."""
    d = events.where("kind = 'deploy'")
    return d.groupBy("cid").agg(F.count("*").alias("deploys"), F.max("ts").alias("last"), F.max_by("version", F.struct("ts", "event_id")).alias("version"))


def remediation_history(events: DataFrame, cids: DataFrame | None = None) -> DataFrame:
    """(cid, event_id, ts, action, outcome) of remediations, of all or of some ids (cid)."""
    out = events.where("kind = 'remediation'").select("cid", "event_id", "ts", "action", "outcome")
    return out if cids is None else out.join(cids.select("cid").distinct(), "cid", "left_semi")


def open_incidents(events: DataFrame) -> DataFrame:
    """(cid, signal_id, opened): signals that no remediation of their service has followed."""
    last = events.where("kind = 'remediation'").groupBy("cid").agg(F.max("ts").alias("fixed"))
    s = events.where("kind = 'incident_signal'").select("cid", F.col("event_id").alias("signal_id"), F.col("ts").alias("opened"))
    return s.join(last, "cid", "left").where("fixed is null or fixed < opened").drop("fixed")


def span_calls(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """(event_id, ts, src, dst) of traces (event_id, ts, cid, spans): each span's service by its name (name, cid), an id of its own if unknown."""
    calls = events.where("kind = 'trace'").select("event_id", "ts", F.col("cid").alias("src"), F.explode("spans").alias("span")).withColumn("name", F.col("span.svc")).where("name is not null")
    return calls.join(resolved.select("name", F.col("cid").alias("known")), "name", "left").select("event_id", "ts", "src", F.coalesce("known", service_id(F.col("name"))).alias("dst")).distinct()


def confidence_histogram(edges: DataFrame, bins: int = 20) -> DataFrame:
    """(relation, bin, n): edges by relation and by equal parts of [0, 1]; 1 itself belongs to the last."""
    part = F.least(F.lit(bins), F.width_bucket("confidence", F.lit(0.0), F.lit(1.0), F.lit(bins)))
    return edges.groupBy("relation", part.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def shown(edges: DataFrame, least: float = 0.0, relations: list[str] | None = None, reinforced_only: bool = False) -> DataFrame:
    """Edges by confidence, relation and whether a fix has reinforced them (edges of reinforced())."""
    out = edges.where(F.col("confidence") >= least)
    if relations:
        out = out.where(F.col("relation").isin(relations))
    return out.where("times > 0") if reinforced_only else out
