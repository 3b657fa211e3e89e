"""Operators on small cases with known answers."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions import text as X
from tidemark.operators import association, context, evaluate, experiments, graph, identity, motifs, options, related, retrieval, temporal
from tidemark.plans import queries
from tidemark.session import cut
from tidemark.sources import events as E
from tidemark.sources import reports
from tidemark.streaming import state


def rows(df):
    return [tuple(r) for r in df.collect()]


# time


def test_band_join_against_loops(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), float(rng.randrange(100))) for i in range(40)]
    right = [(i, rng.choice("ab"), float(rng.randrange(100))) for i in range(60)]
    l = spark.createDataFrame(left, "l long, k string, lt double")
    r = spark.createDataFrame(right, "r long, k string, rt double")
    for closed, last in (("both", lambda x, t: x <= t), ("left", lambda x, t: x < t)):
        got = sorted(rows(temporal.band_join(l, r, ["k"], "lt", "rt", 10.0, closed=closed).select("l", "r")))
        assert got == sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] - 10 <= b[2] and last(b[2], a[2]))


def test_asof_join_against_loops(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), float(rng.randrange(50))) for i in range(40)]
    right = [(i, rng.choice("ab"), float(rng.randrange(50))) for i in range(20)]
    got = temporal.asof_join(spark.createDataFrame(left, "l long, k string, lt double"), spark.createDataFrame(right, "r long, k string, rt double"), ["k"], "lt", "rt", ["r"], ["r"], 8.0)
    any_time = dict(rows(temporal.asof_join(spark.createDataFrame(left, "l long, k string, lt double"), spark.createDataFrame(right, "r long, k string, rt double"), ["k"], "lt", "rt", ["r"], ["r"], width=7.0).select("l", "asof.r")))
    assert any_time == {l: (-max(late)[1] if late else None) for l, late in ((a[0], [(b[2], -b[0]) for b in right if b[1] == a[1] and b[2] <= a[2]]) for a in left)}
    for l, asof in rows(got.select("l", "asof.r")):
        fit = [(b[2], -b[0]) for b in right if b[1] == left[l][1] and left[l][2] - 8 <= b[2] <= left[l][2]]
        late = [(b[2], -b[0]) for b in right if b[1] == left[l][1] and b[2] <= left[l][2]]
        want = -max(late)[1] if late and max(late) in fit else None
        assert asof == want


def test_adaptive_window_bounds(spark):
    e = [(0, 1000.0, 1, "c", "incident_signal", None, 0.0)] + [(i, 1000.0 - 600 - (i > 4), 1, "c", "log", 1, 0.0) for i in range(1, 9)]
    df = spark.createDataFrame(e, "event_id long, ts double, user_id long, cid string, kind string, trace_id long, value double")
    sig = df.where("event_id = 0").select(F.col("event_id").alias("signal_id"), F.col("ts").alias("anchor"), "cid", "user_id")
    assert rows(temporal.adaptive_window(sig, df).select("width")) == [(600,)]
    assert rows(temporal.adaptive_window(sig, df.where("event_id < 4 or event_id > 4")).select("width")) == [(1200,)]
    assert rows(temporal.adaptive_window(sig, df.where("event_id < 3")).select("width")) == [(3600,)]


# identity


def test_renames_in_order(spark):
    log = [(1, "a", "b"), (2, "b", "c"), (3, "x", "b"), (4, "b", "y"), (5, "c", "a")]
    df = spark.createDataFrame(log, "seq long, old_name string, new_name string")
    ids, root = {}, lambda n: __import__("hashlib").md5(n.encode()).hexdigest()[:8]
    for _, old, new in log:
        ids.setdefault(old, root(old))
        ids[new] = ids[old]
    log = identity.rename_ids(df)
    assert dict(rows(identity.current_ids(log))) == ids
    assert dict(rows(identity.current_names(identity.aliases_of(log))))[root("a")] == "c"
    assert sorted(rows(identity.rename_history(log, spark.createDataFrame([(root("x"),)], "cid string")))) == [(root("x"), 3, "x", "b"), (root("x"), 4, "b", "y")]
    # Names mean what they meant at the time: b is a's id from 1 on and x's from 3 on; unknown names are ids of their own, null names none.
    events = [(0, "b"), (1, "b"), (2, "b"), (3, "b"), (9, "b"), (9, "a"), (4, "a"), (5, "new"), (6, None)]
    got = rows(identity.identified(spark.createDataFrame(events, "event_id long, service string"), log))
    want = {(0, "b"): root("b"), (1, "b"): root("a"), (2, "b"): root("a"), (3, "b"): root("x"), (9, "b"): root("x"), (9, "a"): root("a"), (4, "a"): root("a"), (5, "new"): root("new"), (6, None): None}
    assert {r[:2]: r[2] for r in got} == want
    seen = identity.registered(identity.aliases_of(log), spark.createDataFrame([(root("new"), "new"), (root("a"), "b"), (None, None)], "cid string, service string"))
    assert (root("new"), "new", -1) in rows(seen) and seen.count() == identity.aliases_of(log).count() + 1


def test_asof_join_deals_out_a_hot_key(spark):
    """A key with all rows: no window of the plan gets more than a bucket of it, and the result is that of one window."""
    left = spark.range(4000).select(F.lit("k").alias("k"), F.col("id").alias("l"), (F.col("id") * 1.0).alias("t"))
    right = spark.range(0, 4000, 97).select(F.lit("k").alias("k"), F.col("id").alias("r"), (F.col("id") * 1.0).alias("rt"))
    got = dict(rows(temporal.asof_join(left, right, ["k"], "t", "rt", ["r"], ["r"], width=100.0).select("l", "asof.r")))
    assert got == {i: i // 97 * 97 for i in range(4000)}
    near = dict(rows(temporal.asof_join(left, right, ["k"], "t", "rt", ["r"], ["r"], 50.0).select("l", "asof.r")))
    assert near == {i: i // 97 * 97 if i % 97 <= 50 else None for i in range(4000)}


def test_traces_reach_other_services(spark):
    e = [(1, 1000.0, "a", "incident_signal", 7), (2, 990.0, "a", "log", 8), (3, 5.0, "b", "trace", 8), (4, 2000.0, "b", "log", 7), (5, 995.0, "b", "log", 9), (6, 1.0, "b", "remediation", 8)]
    df = spark.createDataFrame(e, "event_id long, ts double, cid string, kind string, trace_id long")
    sig = df.where("event_id = 1").select(F.col("event_id").alias("signal_id"), F.col("ts").alias("anchor"), "cid")
    none = spark.createDataFrame([], "cid string, near string")
    assert sorted((r["event_id"], r["via"]) for r in temporal.related_events(sig, df, none).collect()) == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert sorted(r["event_id"] for r in temporal.related_events(sig, df, none, as_of=True).collect()) == [1, 2, 3]


def test_roles(spark):
    names = ["svc-pay", "api-gateway", "edge.router", "mysql_1", "svc-v2", "worker-42", "zebra-svc", "", None, "checkout"]
    got = [r[0] for r in rows(spark.createDataFrame([(n,) for n in names], "n string").select(X.infer_role(F.col("n"))))]
    assert got == ["payment", "gateway", "gateway", "database", "service", "service", "zebra", "service", "service", "checkout"]
    a = spark.createDataFrame([("1", "svc", 0), ("1", "svc-pay", 1), ("1", "db", 2), ("2", "x", 0)], "cid string, name string, seq long")
    o = spark.createDataFrame([("2", " Cache ")], "cid string, role string")
    assert dict(rows(identity.roles(a, o))) == {"1": "payment", "2": "cache"}


# graph


@pytest.fixture(scope="module")
def incident(spark):
    """Edges of the two-service scenario: a deploy, a spike and a log of P, a call of C to P."""
    o = [("P", "P", "deploy_to_metric", "2", 0.0, 30.0, 2), ("P", "P", "deploy_to_log", "3", 0.0, 45.0, 3), ("C", "P", "upstream_call", "4", 50.0, 51.0, 4), ("P", "P", "deploy_to_metric", "9", 99.0, 98.0, 9)]
    return spark.createDataFrame(o, "src string, dst string, relation string, evidence string, ts_src double, ts_dst double, seq long")


def test_scenario_confidence(spark, incident):
    start = spark.createDataFrame([("P",)], "cid string")
    fix = spark.createDataFrame([("P", 120.0)], "cid string, ts double")
    e = graph.reinforced(graph.roll_up(incident), fix).drop("times", "evidence_count")
    assert sorted((r["src"], round(r["confidence"], 6), r["count"], r["relation"]) for r in e.collect()) == [("C", 0.35, 1, "upstream_call"), ("P", 0.35, 1, "deploy_to_metric")]
    again = spark.createDataFrame([("P", "P", "deploy_to_metric", "8", 0.0, 240.0, 8)], incident.schema)
    e = cut(graph.reinforced(graph.roll_up(incident.unionByName(again)), fix))
    chain = cut(graph.causal_chain(start, e))
    assert rows(graph.chain_confidence(chain))[0][1:] == (4, pytest.approx(0.375))
    roots = graph.root_causes(start, e)
    assert [(r[1], r[2], round(r[3], 6)) for r in rows(roots)] == [("C", 1, 0.35)]
    seen = spark.createDataFrame([("C", "P", "4"), ("C", "P", "4"), ("C", "P", "5"), ("P", "P", "6")], "src string, dst string, evidence string")
    full = graph.root_causes(start, e, seen, spark.createDataFrame([("C", 20.0), ("C", 30.0), ("P", 1.0)], "cid string, ts double")).first()
    assert (full["evidence_count"], full["earliest"], full["path"], full["rank"]) == (2, 30.0, ["C", "P"], 1)
    names = spark.createDataFrame([("P", "svc-billing")], "cid string, name string")
    assert sorted((r["cause"], r["effect"], r["confidence"]) for r in graph.shown_edges(e, names).collect()) == [("C", "svc-billing", 0.35), ("svc-billing", "svc-billing", 0.4)]
    assert graph.edge_of(e, "C", "P").count() == 1 and graph.edge_of(e, "C", "P", "deploy_to_log").count() == 0
    assert [(r["old"], r["new"]) for r in graph.provenance(graph.roll_up(incident.unionByName(again)), fix).where("src = 'C'").collect()] == [(0.3, pytest.approx(0.35))]
    roles = spark.createDataFrame([("P", "payment")], "cid string, role string")
    m = motifs.extracted(chain, roles, e).first()
    assert m["ids"] == ["C", "P"] and m["sequence"] == ["payment", "service"] and len(m["shape"]) == 4 and m["confidence"] == pytest.approx(0.375)
    assert [tuple(t) for t in m["shape"]] == [("payment", "deploy_to_metric", "payment")] * 2 + [("service", "upstream_call", "payment")] * 2
    assert rows(context.confidence(graph.chain_confidence(chain), roots))[0][1] == pytest.approx(0.4275)


def test_decay(spark):
    df = spark.createDataFrame([(0.5, 0.0, 86399.0), (0.5, 0.0, 86400.0), (0.5, 0.0, 2.5 * 86400), (0.11, 0.0, 1e9)], "c double, a double, b double")
    got = rows(df.select(graph.decay_exponential(F.col("c"), F.col("a"), F.col("b")), graph.decay_linear(F.col("c"), F.col("a"), F.col("b"))))
    assert got[0] == (0.5, pytest.approx(0.49, abs=1e-4)) and got[1][0] == pytest.approx(0.495) and got[2] == (pytest.approx(0.5 * 0.99**2), pytest.approx(0.475)) and got[3] == (0.1, 0.1)


def test_compare_is_one_for_equal_graphs(spark):
    e = spark.createDataFrame([("a", "b", "r", 0.5, 0.0), ("x", "y", "r", 0.5, 0.0)], "src string, dst string, relation string, confidence double, first_seen double")
    s = spark.createDataFrame([("a", "x"), ("a", "z")], "a string, b string")
    got = {r[1]: r[2] for r in rows(graph.compare(s, e))}
    assert got["x"] == pytest.approx(1.0) and got["z"] == pytest.approx(0.35 * 0.5)


# motifs and retrieval


def test_memory_over_time(spark):
    """Learning, forgetting and pruning as the memory demonstration tells it."""
    day = 86400.0
    schema = "id string, created double, action string, confidence double, decay_ref double"
    empty = spark.createDataFrame([], schema)
    new = spark.createDataFrame([("a", 0.0, "failover"), ("b", 7 * day, "restart")], "id string, created double, action string")
    memory = motifs.upserted(empty, new)
    assert {r["id"]: r["confidence"] for r in memory.collect()} == {"a": 0.6, "b": 0.6}
    old = motifs.decayed(memory, F.lit(7 * day + 100))
    got = {r["id"]: (r["confidence"], r["decay_ref"]) for r in old.collect()}
    assert got == {"a": (pytest.approx(0.6 * 0.99**7), 7 * day + 100), "b": (0.6, None)}
    # The part of a day is lost, and a motif that comes again keeps its confidence.
    again = {r["id"]: r["confidence"] for r in motifs.decayed(old, F.lit(8 * day)).collect()}
    assert again == {"a": pytest.approx(0.6 * 0.99**7), "b": pytest.approx(0.6 * 0.99)}
    kept = motifs.upserted(old, spark.createDataFrame([("a", 9 * day, "scale")], "id string, created double, action string")).where("id = 'a'").first()
    assert (kept["action"], kept["created"], kept["confidence"]) == ("scale", 9 * day, pytest.approx(0.6 * 0.99**7))
    many = spark.createDataFrame([(f"m{i:03d}", 0.0, "x", 0.2 + i / 1000, None) for i in range(110)] + [("weak", 0.0, "x", 0.1, None)], schema)
    left = motifs.upserted(many, spark.createDataFrame([("n", 0.0, "y")], "id string, created double, action string"))
    assert left.count() == 100 and left.where("id in ('weak', 'm000')").count() == 0
    assert motifs.upserted(many, spark.createDataFrame([("weak", 0.0, "y")], "id string, created double, action string")).count() == 111


def test_shapes_and_words(spark):
    triple = "array<struct<src:string,relation:string,dst:string>>"
    df = spark.createDataFrame([([("a", "r", "b")], [("a", "r", "b"), ("a", "r", "b"), ("b", "r", "c")]), ([], [])], f"x {triple}, y {triple}")
    assert [r[0] for r in rows(df.select(motifs.shape_similarity(F.col("x"), F.col("y"))))] == [0.5, 1.0]
    said = spark.createDataFrame([("log", "DB  Timeout after 9 s", None, None), ("metric", None, "latency", None), ("deploy", None, None, "v2"), ("trace", "long words", "m", "v"), ("log", None, None, None)], "k string, m string, n string, v string")
    assert [r[0] for r in rows(said.select(X.content_words(F.col("k"), F.col("m"), F.col("n"), F.col("v"))))] == [["timeout", "after"], ["latency"], ["v2"], [], []]
    assert [r[0] for r in rows(spark.createDataFrame([(0.125,), (0.135,), (0.0,), (1.0,)], "x double").select(X.percent(F.col("x"))))][:1] == ["12%"]
    t = context.content_tokens(spark.createDataFrame([(1, ["b", "a"]), (1, ["b"]), (2, [])], "signal_id int, words array<string>"), 2)
    assert {r["signal_id"]: r["tokens"] for r in t.collect()} == {1: ["a", "b"], 2: []}


def test_lift_prune(spark):
    e = [(1, 1000.0, i, 995.0, "metric:x") for i in range(3)] + [(1, 1000.0, 10 + i, 995.0, "log:error") for i in range(3)] + [(1, 1000.0, 20 + i, 700.0, "log:error") for i in range(3)] + [(2, 1000.0, 30, 500.0, "trace")]
    df = spark.createDataFrame(e, "signal_id int, anchor double, event_id long, ts double, token string")
    left = context.lift_pruned(df, context.token_lift(df))
    assert sorted(r["event_id"] for r in left.collect()) == [0, 1, 2, 30]  # of the second signal nothing would be left, so it keeps all


def test_open_incidents_and_state_of_services(spark):
    e = [(1, 1.0, "a", "incident_signal", None, None, None), (2, 2.0, "a", "remediation", None, "restart", "resolved"), (3, 3.0, "a", "incident_signal", None, None, None), (4, 1.0, "b", "deploy", "v1", None, None), (5, 2.0, "b", "deploy", "v2", None, None)]
    df = spark.createDataFrame(e, "event_id long, ts double, cid string, kind string, version string, action string, outcome string")
    assert rows(graph.open_incidents(df)) == [("a", 3, 3.0)]
    assert rows(graph.deploy_state(df)) == [("b", 2, 2.0, "v2")]
    assert rows(graph.remediation_history(df, spark.createDataFrame([("a",)], "cid string"))) == [("a", 2, 2.0, "restart", "resolved")]
    # By batches the same stays open.
    held = state.fold_open(state.fold_open(None, df.where("event_id < 3")), df.where("event_id >= 3"))
    assert rows(held) == [("a", 3, 3.0)]
    out = graph.decayed_out(spark.createDataFrame([("a", "b", 0.5, 0.0), ("b", "a", 0.5, 0.0)], "src string, dst string, confidence double, last_seen double"), spark.createDataFrame([("a",)], "cid string"), F.lit(86400.0 * 10))
    assert sorted((r["src"], round(r["confidence"], 6), r["changed"]) for r in out.collect()) == [("a", 0.4, True), ("b", 0.5, False)]


def test_similarity(spark):
    q = [("q", ["i"], ["deploy"], ["t"], "")]
    s = [("same", ["i"], ["deploy"], ["t"], "rollback"), ("bare", [], [], [], ""), ("other", ["j"], ["log"], ["u"], "x")]
    schema = "id string, ids array<string>, sequence array<string>, tokens array<string>, action string"
    asked = spark.createDataFrame(q, schema)
    got = {r["s_id"]: r for r in motifs.with_rationale(motifs.find_similar(asked, spark.createDataFrame(s, schema)), asked).collect()}
    alone = motifs.find_similar(asked, asked, exclude_self=True)
    assert alone.count() == 0 and motifs.find_similar(asked, spark.createDataFrame(s, schema), least=0.99).count() == 1
    assert got["same"]["score"] == pytest.approx(1.0) and "canonical ID overlap: 100%" in got["same"]["rationale"]
    assert got["bare"]["score"] == 0 and got["bare"]["rationale"] == "low structural overlap"
    assert got["other"]["rank"] < got["bare"]["rank"] or got["other"]["score"] == pytest.approx(0.6 / 3)


def test_memory(spark):
    o = [("a", i, i, True) for i in range(5)] + [("b", 0, 0, False), ("b", 1, 1, True), ("c", 0, 0, False)] + [("d", i, i, False) for i in range(20)]
    got = {r["id"]: r["confidence"] for r in motifs.evolved(spark.createDataFrame(o, "id string, at long, seq long, success boolean")).collect()}
    assert got == {"a": 0.95, "b": pytest.approx(0.58), "c": pytest.approx(0.48), "d": 0.1}


def matches(spark, data):
    base = (("has_deploy", True), ("has_metric", True), ("has_trace_log", True), ("n_ids", 1))
    df = spark.createDataFrame([(1, i, *d) for i, d in enumerate(data)], "signal_id long, seq long, incident_id string, similarity double, action string, outcome string")
    return df.select("*", *[F.lit(v).alias(k) for k, v in base])


def test_retrieval(spark):
    m = matches(spark, [("INC-1-0", 0.9, "rollback", "resolved"), ("INC-2-0", 0.8, "rollback", "resolved"), ("INC-3-1", 0.55, "restart", "failed"), ("inc-4-1", 0.95, "restart", "failed"), ("INC-5-2", 0.4, "", "failed"), ("INC-1-0", 0.3, "rollback", "failed")])
    assert [r["incident_id"] for r in retrieval.two_stage(m).orderBy("rank").collect()] == ["INC-1-0", "INC-2-0", "inc-4-1", "INC-3-1"]
    assert [r["incident_id"] for r in retrieval.two_stage(m, fast=True).orderBy("rank").collect()] == ["INC-1-0", "INC-2-0"]
    assert retrieval.best_per_incident(m).count() == 5
    low = m.withColumn("similarity", F.col("similarity") / 2)
    assert [r["incident_id"] for r in retrieval.smart_top(retrieval.best_per_incident(low), 3).orderBy("rank").collect()] == ["inc-4-1", "INC-1-0", "INC-5-2"]
    acts = {r["action"]: r for r in retrieval.action_posteriors(m).collect()}
    assert acts["rollback"]["total"] == 3 and acts["rollback"]["posterior"] == pytest.approx((0.4 * 2 / 3 + 0.6 * 4 / 7) * 0.3 * 2 / 3, abs=1e-5)
    m = m.withColumn("cid", F.lit("a"))
    other = m.withColumn("cid", F.lit("b")).withColumn("outcome", F.lit("resolved"))
    assert [r["rate"] for r in retrieval.suggested_actions(m, other).collect()] == [0.5, 0.5]
    sug = retrieval.suggested_actions(m, m.where("action <> ''").unionByName(other)).orderBy("rank").collect()
    assert [(r["action"], round(r["rate"], 3)) for r in sug] == [("rollback", 0.667), ("restart", 0.0)]


def test_decoy(spark):
    e = spark.createDataFrame([(1, "deploy"), (1, "metric"), (1, "log"), (2, "deploy")], "signal_id long, kind string")
    got = {r["signal_id"]: r for r in retrieval.decoy_policy(e).collect()}
    assert (got[1]["decoy"], got[1]["risk"], got[2]["decoy"], got[2]["missing"], got[2]["cap"]) == (False, "low", True, "metric,trace_or_log", 0.45)


# statistics


def test_association(spark):
    events = spark.createDataFrame([("a", 40.0, "deploy"), ("a", 100.0, "deploy"), ("b", 40.0, "deploy"), ("a", 39.0, "log")], "cid string, ts double, kind string")
    incidents = spark.createDataFrame([(1, 100.0, "a"), (2, 500.0, "a")], "incident long, t double, cid string")
    table = association.contingency(events, incidents, 60.0)
    assert sorted(rows(table)) == [("deploy", 1, 2, 1, 1), ("log", 0, 1, 2, 2)]  # [t - 60, t): 40 counts, 100 and 39 do not
    got = {r["kind"]: r for r in association.analysed(table).collect()}
    assert (got["deploy"]["p_event_given_incident"], got["deploy"]["p_incident"], got["log"]["mi"], got["deploy"]["enough"]) == (0.5, 0.4, 0.0, False)
    df = spark.createDataFrame([(80, 20, 40, 60), (5, 0, 0, 5), (0, 0, 0, 0)], "a long, b long, c long, d long")
    m = S.measures(*map(F.col, "abcd"))
    got = rows(df.select(*[m[k] for k in ("odds_ratio", "relative_risk", "risk_difference", "cramers_v")], S.sample_odds(*map(F.col, "abcd"))))
    assert got[0][:3] == (6.0, pytest.approx(2.0), pytest.approx(0.4)) and math.isinf(got[1][0]) and got[2][1:4] == (0.0, 0.0, 0.0) and got[0][4] == 6.0 and math.isnan(got[2][4])


def test_exclusive_quantile(spark):
    import statistics

    rng = random.Random(4)
    groups = {"a": [rng.random() for _ in range(357)], "b": [float(rng.randrange(5)) for _ in range(40)], "c": [3.0] * 25, "d": [1.0, 9.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan"))], "k string, v double")
    for part in (50, 95, 1, 99):
        got = dict((r[0], r[2]) for r in rows(evaluate.exclusive_quantile(df, "k", "v", part)))
        assert got == {k: pytest.approx(statistics.quantiles(v, n=100)[part - 1] if len(v) >= 20 else max(v)) for k, v in groups.items()}


def test_measures(spark):
    df = spark.createDataFrame([(80, 20, 40, 60), (0, 5, 5, 5), (0, 0, 0, 0), (5, 0, 0, 5)], "a long, b long, c long, d long")
    a, b, c, d = map(F.col, "abcd")
    chi = S.chi_squared(a, b, c, d)
    got = rows(df.select(chi, S.relative_risk(a, b, c, d), S.odds_ratio(a, b, c, d), S.p_value(chi), S.fisher_exact("a", "b", "c", "d"), S.mutual_information(a, b, c, d)[0]))
    assert got[0][0] == pytest.approx(200 * (80 * 60 - 20 * 40) ** 2 / (100 * 100 * 120 * 80)) and got[0][1] == pytest.approx(0.8 / 0.6) and got[0][2] == 6
    assert got[0][3] == pytest.approx(math.erfc(math.sqrt(got[0][0] / 2))) and got[2][0] == 0 and got[2][3] == 1 and math.isinf(got[3][2])
    assert got[3][4] == pytest.approx(2 / 252) and got[3][5] == pytest.approx(1.0) and got[1][5] == 0


def test_order_similarity(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], ["a"]), (["a"], []), (list("abcbdab"), list("bdcaba"))], "x array<string>, y array<string>")
    assert [r[0] for r in rows(df.select(S.order_similarity(F.col("x"), F.col("y"))))] == [pytest.approx(2 / 3), 0.0, 0.0, pytest.approx(4 / 7)]


# evaluation and experiments


def test_evaluation(spark):
    p = [(1, 0, 0, 0.9, 1), (1, 0, 1, 0.5, 2), (2, 1, 0, 0.9, 1), (2, 1, 1, 0.4, 2), (3, None, 2, 0.7, 1), (4, None, 2, 0.3, 1), (5, 3, 0, 0.2, 1)]
    df = spark.createDataFrame(p, "incident_id long, truth long, family long, similarity double, rank int")
    assert dict(rows(evaluate.outcome_counts(df))) == {"correct_rank1": 1, "wrong_rank1_recall_miss": 2, "false_positive_decoy": 1, "correct_decoy_rejection": 1}
    assert {(r[0], r[2]) for r in rows(evaluate.losses(df))} == {(2, "contamination"), (3, "decoy_false_positive"), (5, "recall_miss")}
    assert rows(evaluate.decoy_analysis(df)) == [(2, 1, 0.5, 0.7, 0.3)]
    cure = spark.createDataFrame([(1, "restart", "rollback"), (2, "restart", None)], "incident_id long, expected string, action string")
    assert {(r[0], r[2]) for r in rows(evaluate.losses(df, cure))} == {(1, "remediation_mismatch"), (2, "contamination"), (3, "decoy_false_positive"), (5, "recall_miss")}
    assert {r["truth"]: r["categories"] for r in evaluate.loss_by_family(df, cure).collect()} == {0: "remediation_mismatch=1", 1: "contamination=1", 3: "recall_miss=1", None: "decoy_false_positive=1"}
    assert rows(evaluate.calibration(df)) == [(1, 0, 0.9, 0.55, 0.35)]
    assert rows(evaluate.quality(df, cure)) == [(3, pytest.approx(2 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6), 0.0)]


def test_experiments(spark):
    g = experiments.grid(spark, {"b": (1, 2), "a": (3,)})
    assert g.columns == ["number", "a", "b"] and sorted(rows(g)) == [(0, 3.0, 1.0), (1, 3.0, 2.0)]
    wide = {c: range(10) for c in "abcd"}
    drawn = experiments.grid(spark, wide, 50)
    assert drawn.count() <= 50 and rows(drawn) == rows(experiments.grid(spark, wide, 50)) and rows(drawn)[0][1:] <= rows(drawn)[1][1:]
    assert experiments.grid(spark, {"a": range(10)}, 3).count() == 10  # a small grid is whole

    def run(o, seed):
        if o.stage_a_threshold > 0.65:
            raise ValueError("no run")
        return {"recall": o.stage_a_threshold, "precision": seed / 10, "remediation": 1.0, "p95": 5.0}

    swept = experiments.sweep(spark, {"stage_a_threshold": (0.6, 0.7)}, (1, 2), run, 2.0)
    assert sorted(rows(swept)) == [(0, 0.6, 1, 0.6, 0.1, 1.0, 5.0), (0, 0.6, 2, 0.6, 0.2, 1.0, 5.0), (1, 0.7, 1, 0.0, 0.0, 0.0, 2000.0), (1, 0.7, 2, 0.0, 0.0, 0.0, 2000.0)]
    tried = experiments.targeted(spark, "precision", lambda o: {"recall": o.stage_a_threshold})
    deltas = experiments.ablation(tried, "baseline")
    assert rows(experiments.ablation_extremes(deltas, "recall")) == [("Combined strict", "Lower decoy cap")]
    assert {r["variant"]: r["magnitude"] for r in deltas.collect()} == {"Combined strict": 0.1, "Stronger Stage A threshold": 0.1, "Lower decoy cap": 0.0}
    report = spark.createDataFrame([(({"recall@5": 0.9, "precision@5_mean": 0.5},), (1.86,))], "score struct<axes:map<string,double>>, aggregated struct<latency_p95_ms:double>")
    report = report.select(F.struct(F.struct(F.lit(0.9).alias("recall@5"), F.lit(0.5).alias("precision@5_mean"), F.lit(None).alias("remediation_acc")).alias("axes")).alias("score"), "aggregated")
    assert rows(experiments.extracted_metrics(report)) == [(0.9, 0.5, 0.0, 1.86)]
    r = spark.createDataFrame([(1.0, 1.0, 0.0), (2.0, 1.0, 1.0)], "a double, b double, score double")
    assert {r[0]: r[2] for r in rows(experiments.importance(r, ["a", "b"]))} == {"a": 1.0, "b": 0.0}
    with pytest.raises(ValueError):
        options.changed({"stage_b_threshold": 0.9})
    for bad in ({"unknown": 1}, {"alpha": 2.0}, {"max_results": 0}):
        with pytest.raises(ValueError):
            options.changed(bad)
    assert options.changed({"max_results": 3}).max_results == 3 and options.DEFAULT.max_results == 5


# sources, sinks, streams


def test_wire_events(spark, tmp_path):
    lines = E.scenario(spark)
    lines.select("raw").write.text(f"{tmp_path}/in")
    n = E.normalised(E.read_lines(spark, f"{tmp_path}/in")).orderBy("event_id").collect()
    assert len(n) == 9 and n[6]["old_name"] == "svc-pay" and n[6]["new_name"] == "svc-billing" and n[5]["service"] == "svc-pay"
    assert n[2]["message"] == "DB timeout" and n[7]["metric"] == "latency_p99" and n[0]["actor"] == "system"
    E.append(E.normalised(E.read_lines(spark, f"{tmp_path}/in")), f"{tmp_path}/log")
    log = E.read_log(spark, f"{tmp_path}/log")
    assert log.count() == 9 and E.by_trace(log, ["s-a"]).count() == 2 and E.by_trace(log, []).count() == 0
    spark_anchor = datetime(2026, 1, 15, 10, 1, 0)
    assert [r["event_id"] for r in E.window(log, ["svc-pay"], spark_anchor, 30).collect()] == ["s-002", "s-003", "s-005"]
    bad = spark.createDataFrame([("{broken",), ('{"ts": "2026-01-15T12:00:00+02:00", "kind": "log"}',)], "value string").select(F.col("value").alias("raw"), F.from_json("value", E.WIRE).alias("e"))
    assert sorted(str(r["ts"]) for r in E.normalised(bad).collect()) == ["2026-01-15 10:00:00", "None"]


def test_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"per_seed": [{"seed": 1, "per_incident": [{"id": "a", "recall": 1.0}, {"id": "b", "recall": 0.0}]}]}')
    assert sorted(rows(reports.read_report(spark, str(tmp_path / "r.json")))) == [(1, "a", 1.0), (1, "b", 0.0)]
    (tmp_path / "c.json").write_text('{"config": {"alpha": 0.05, "k": 3, "mode": "fast", "on": true, "deep": {"x": 1}}}')
    config = reports.read_config(spark, str(tmp_path / "c.json"))
    assert {r[0]: r[1:] for r in rows(config)} == {"alpha": (0.05, "0.05"), "k": (3.0, "3"), "mode": (None, "fast"), "on": (1.0, "true")}
    reports.write_config(config.where("value is not null"), spark.createDataFrame([("x",)], "name string"), f"{tmp_path}/w")
    back = spark.read.json(f"{tmp_path}/w").first()
    assert back["config"]["alpha"] == 0.05 and back["metadata"]["name"] == "x"
    reports.write_json(config, config.limit(1), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j/records").count() == 4 and spark.read.json(f"{tmp_path}/j/metadata").count() == 1
    reports.write_long(config, f"{tmp_path}/long")
    assert spark.read.option("header", True).csv(f"{tmp_path}/long").count() == 4
    p = spark.createDataFrame([(1, 2, "f"), (1, 1, "g")], "incident_id long, rank int, family string")
    reports.write_diagnostics(p.select("incident_id").distinct(), p, f"{tmp_path}/csv")
    assert rows(spark.read.option("header", True).csv(f"{tmp_path}/csv")) == [("1", "1:g;2:f")]
    assert "| 1 |" in reports.markdown(p)


def test_state_survives_reopening(spark, incident, tmp_path):
    """Edges, memory and identity are what they were; the latest whole snapshot counts, and one that was broken off does not."""
    path = f"{tmp_path}/engine"
    assert reports.reopen(spark, path) == {}
    e = graph.roll_up(incident)
    alias = spark.createDataFrame([("1", "svc-pay", 0)], "cid string, name string, seq int")
    reports.save({"edges": e, "aliases": alias}, path)
    got = reports.reopen(spark, path)
    assert set(got) == {"edges", "aliases"} and sorted(rows(got["edges"])) == sorted(rows(e))
    more = got["edges"].withColumn("confidence", F.col("confidence") + 0.05)
    reports.save({"edges": more, "aliases": got["aliases"]}, path)
    alias.write.parquet(f"{path}/v9/aliases")
    assert reports.reopen(spark, path)["edges"].agg(F.max("confidence")).first()[0] == pytest.approx(0.40 if e.agg(F.max("count")).first()[0] > 1 else 0.35)
    with pytest.raises(ValueError):
        reports.save({"unknown": alias}, path)


def test_stream_equals_batch(spark, incident, tmp_path):
    rng = random.Random(9)
    o = [(rng.choice("ab"), rng.choice("ab"), rng.choice(("x", "y")), str(i), float(i), float(i + rng.randrange(-1, 3)), i) for i in range(60)]
    df = spark.createDataFrame(o, incident.schema)
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    got = state.stream_edges(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/state", f"{tmp_path}/check")
    cols = ["src", "dst", "relation", "count", "first_seen", "last_seen", "confidence"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, graph.roll_up(df).select(cols).collect()))


def test_stream_needs_the_state_before(spark, incident, tmp_path):
    step = state.keep(spark, f"{tmp_path}/s")
    with pytest.raises(RuntimeError):
        step(incident, 3)
    step(incident, 0)
    step(incident, 1)
    once = rows(state.last_state(spark, f"{tmp_path}/s"))
    step(incident, 1)  # a batch that comes again
    assert rows(state.last_state(spark, f"{tmp_path}/s")) == once
    with pytest.raises(RuntimeError):
        state.last_state(spark, f"{tmp_path}/nothing")


def test_motif_stream_equals_batch(spark, tmp_path):
    rng = random.Random(10)
    o = [(rng.choice("abc"), float(i), i, rng.random() < 0.6) for i in range(60)]
    df = spark.createDataFrame(o, "id string, at double, seq long, success boolean")
    for k in range(3):  # one file a batch, in order
        df.where((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * (k + 1))).coalesce(1).write.parquet(f"{tmp_path}/b{k}")
    held = None
    for k in range(3):
        held = state.fold_motifs(held, spark.read.parquet(f"{tmp_path}/b{k}"))
    want = {r["id"]: (round(r["confidence"], 9), r["successes"]) for r in motifs.evolved(df).collect()}
    assert {r["id"]: (round(r["confidence"], 9), r["successes"]) for r in held.collect()} == want


def test_renames_of_a_batch_come_first(spark):
    log = spark.createDataFrame([(0, "a", "b")], "seq long, old_name string, new_name string")
    batch = spark.createDataFrame([(1, "log", "c", None, None), (2, "topology", None, "b", "c"), (3, "log", "b", None, None)], "event_id long, kind string, service string, old_name string, new_name string")
    got = {r["event_id"]: r["cid"] for r in state.renames_first(batch, log).collect()}
    assert got[1] == got[3] == __import__("hashlib").md5(b"a").hexdigest()[:8]


def test_spans_and_scenario_end_to_end(spark):
    """The scenario of one incident across a rename, from wire lines to the confidence that is told of it."""
    n = E.to_seconds(E.normalised(E.scenario(spark))).withColumn("n", F.substring("event_id", -3, 3).cast("long"))
    log = identity.rename_ids(n.where("kind = 'topology'").select(F.lit(-1).cast("long").alias("seq"), "old_name", "new_name"))
    e = cut(identity.identified(n, log, at="n").withColumn("event_id", F.col("n")))
    assert e.where("service in ('svc-pay', 'svc-billing')").select("cid").distinct().count() == 1
    calls = graph.span_calls(e, identity.current_ids(log))
    seen = graph.deploy_edges(e, 3600.0).unionByName(graph.upstream_edges(calls)).unionByName(graph.incident_log_edges(e, 3600.0))
    fixes = e.where("outcome = 'resolved'").select("cid", "ts")
    edges = cut(graph.reinforced(cut(graph.roll_up(seen)), fixes))
    signal = e.where("incident_id = 'INC-s-2' and kind = 'incident_signal'").select("cid")
    chain = cut(graph.causal_chain(signal, edges))
    sure = context.confidence(graph.chain_confidence(chain), graph.root_causes(signal, edges))
    assert sure.first()["confidence"] == pytest.approx(0.4275) and graph.chain_confidence(chain).first()["edges"] == 4


def test_narrative(spark):
    text = spark.range(1).select(context.narrative(F.lit("t"), F.lit("s"), F.lit(3), F.lit(None), F.lit("r"), F.lit("m"), F.lit("a"), F.lit(0.875))).first()[0]
    assert text.count("## ") == 8 and "## Causal chain\nunknown" in text and text.endswith("88% (high)")


def test_generators_and_explanations(spark):
    assert E.throughput(spark, 100).agg(F.count_distinct("service"), F.max("ts")).first()[0] == 10
    f = E.family_events(spark, 10)
    assert f.count() == 40 and f.where("kind = 'incident_signal'").count() == 10
    assert context.explained({"explanation": "t"}) == "t" and context.explained({"explanation": "t"}, lambda p: "deep") == "deep"
    assert context.explained({"explanation": "t"}, lambda p: 1 / 0) == "t"


def test_post_processing_and_records(spark):
    m = matches(spark, [("INC-1-0", 0.9, "rollback", "resolved"), ("INC-2-1", 0.8, "rollback", "resolved")])
    e = spark.createDataFrame([(1, "deploy")], "signal_id long, kind string")
    plan = spark.createDataFrame([(1, "drain", 0.5)], "signal_id long, action string, confidence double")
    left, actions = retrieval.post_processed(m, retrieval.decoy_policy(e), plan)
    assert left.count() == 0 and rows(actions) == [(1, "drain", 0.3)]  # a decoy's matches are below both stages; its plan is less sure
    left, actions = retrieval.post_processed(m, retrieval.decoy_policy(e), plan, options.changed({"use_decoy_suppression": False}))
    assert [r["incident_id"] for r in left.orderBy("rank").collect()] == ["INC-1-0", "INC-2-1"] and rows(actions.select("action")) == [("rollback",)]
    surer = m.withColumn("confidence", F.lit(0.5))
    assert {r["confidence"] for r in retrieval.suppressed(surer, retrieval.decoy_policy(e)).collect()} == {0.3}
    assert [r["incident_id"] for r in retrieval.family_best(m, 1, 1).collect()] == ["INC-1-0"] and retrieval.family_diversity(m).first()["diversity"] == 1.0
    assert [r["similarity"] for r in retrieval.suppressed(m, retrieval.decoy_policy(e)).collect()] == [0.45, 0.45]
    p = spark.createDataFrame([(1, 0, 0, 0.9, 1), (1, 0, 1, 0.5, 2)], "incident_id long, truth long, family long, similarity double, rank int")
    d = evaluate.diagnostics(p).first()
    assert d["outcome"] == "correct_rank1" and [x["family"] for x in d["predicted"]["ranked"]] == [0, 1]


def test_failure_stats_and_remedies(spark):
    p = spark.createDataFrame([(1, 0, 0, 0.9, 1), (2, 0, 1, 0.9, 1), (3, None, 1, 0.2, 1), (4, 1, 1, 0.7, 1), (5, None, 1, 0.8, 1)], "incident_id long, truth long, family long, similarity double, rank int")
    r = spark.createDataFrame([(1, "a", "a", 0.9), (2, "a", None, None), (4, "a", "b", 0.6), (5, None, "b", 0.9)], "incident_id long, expected string, action string, confidence double")
    got = evaluate.failure_stats(p, r).first().asDict()
    assert got == {"incidents": 5, "correct": 2, "recall_miss": 1, "remedy_mismatch": 1, "decoy_false_positive": 1, "failures": 3, "success_rate": 0.4}
    got = evaluate.remedy_mismatches(r).first().asDict()
    assert got == {"expected": 3, "suggested": 2, "exact": 1, "wrong": 1, "missing": 1, "sure_and_wrong": 1}
    assert evaluate.failure_stats(p.limit(0), r).first()["success_rate"] == 0


def test_run_summary_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([(True, 2.0, None), (None, None, 0.5)], "success boolean, latency_ms double, confidence double")
    assert tuple(evaluate.run_summary(rows).first()) == (0.5, 2.0, 0.5, 2, 1, 1)
    assert tuple(evaluate.run_summary(rows.limit(0)).first()) == (0.0, 0.0, 0.0, 0, 0, 0)


def test_attribution_counts_absent_axes_as_nothing(spark):
    got = evaluate.attribution(spark.createDataFrame([(1, 0.5, None)], "seed int, recall double, precision double"), "seed").collect()
    assert {r["metric"]: r["contribution"] for r in got} == {"recall": 0.15, "precision": 0.0, "remediation": 0.0, "latency": 0.0, "manual_context": 0.0, "manual_explain": 0.0}


def test_sweep_scores_rank_configurations(spark):
    runs = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 0.0), ("a", 0.0, 0.0, 0.0, 4000.0), ("b", 1.0, 1.0, 1.0, 0.0)], "config string, recall double, precision double, remediation double, p95 double")
    got = [tuple(r) for r in experiments.sweep_scores(runs, ["config"]).orderBy("rank").collect()]
    assert got == [("b", 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1), ("a", 0.5, 0.5, 0.5, 4000.0, 0.475, 0.0, 1.0, 2)]


def test_deltas_are_written_most_improved_first(spark, tmp_path):
    reports.write_deltas(spark.createDataFrame([(1, -0.5), (2, 0.5), (3, 0.5)], "seed int, delta double"), f"{tmp_path}/d")
    assert [r["seed"] for r in spark.read.option("header", True).csv(f"{tmp_path}/d").collect()] == ["2", "3", "1"]


def test_representatives_and_action_score(spark):
    m = spark.createDataFrame([(1, 1, "INC-1-0", 1.0, "restart", "resolved"), (1, 2, "INC-2-0", 1.0, "restart", "failed"), (1, 3, "INC-3-1", 0.1, "drain", "failed")], "signal_id int, seq int, incident_id string, similarity double, action string, outcome string")
    assert sorted(r["seq"] for r in retrieval.representatives(m).collect()) == [1, 3]
    assert retrieval.action_score(m, "restart").first()["score"] == 0.1
    assert retrieval.action_score(m, "drain").first()["score"] == 0.0


# related events without pairs


def most_rows(df):
    """The most rows that an operator of the plan made, df being computed."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        below = node.children()
        return max([metric.get().value() if metric.isDefined() else 0, *(walk(below.apply(i)) for i in range(below.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def one_trace(spark, tmp_path_factory):
    """400 services that each signal once, all in one trace."""
    folder = tmp_path_factory.mktemp("one_trace")
    rows = [(i, datetime(2024, 1, 1, 1, i // 60, i % 60), i, "purchase", 10.0, '{"k": 5}') for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def related_cases(spark):
    """Signals and events at random: traces longer than a window, two services each, ties, events of no trace, service or time."""
    rng = random.Random(7)
    e = []
    for i in range(400):
        kind = rng.choice(["deploy", "metric", "log", "trace", "incident_signal", "remediation"])
        e.append((i * 7 % 400, None if rng.random() < 0.03 else float(rng.randrange(6000)), rng.choice(["a", "b", "c", "d", None]), kind, rng.choice([None, *range(12)]), f"{kind}{rng.randrange(2)}"))
    df = spark.createDataFrame(e, "event_id long, ts double, cid string, kind string, trace_id long, token string")
    s = df.where("kind = 'incident_signal' and ts is not null").select(F.col("event_id").alias("signal_id"), F.col("ts").alias("anchor"), "cid")
    near = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("d", "d")], "cid string, near string")
    return s, df, near


@pytest.mark.parametrize("as_of", [False, True])
def test_trace_counts_are_those_of_the_pairs(spark, as_of):
    s, e, near = related_cases(spark)
    pairs = temporal.related_events(s, e, near.where("false"), as_of=as_of).where("via = 1").join(s.select("signal_id", "cid"), "signal_id")
    want = pairs.groupBy("signal_id").agg(F.count("*"), F.count_if(F.col("e_cid") != F.col("cid")), F.max("event_id"))
    own = related.own_events(temporal.adaptive_window(s, e), e)
    got = sorted(rows(related.trace_counts(own, e, as_of=as_of)))
    assert len(got) > 30 and got == sorted(rows(want))


def test_trace_correlation_makes_no_pairs(spark, one_trace):
    got = queries.q_trace_correlation(spark, one_trace)
    assert most_rows(got) <= 10 * 400
    assert {tuple(r)[1:3] for r in got.collect()} == {(399, 399)}


def test_lift_of_related_events_is_that_of_the_pairs(spark):
    s, e, near = related_cases(spark)
    want = context.token_lift(temporal.related_events(s, e, near))
    chosen = temporal.adaptive_window(s, e)
    own = related.own_events(chosen, e)
    loose = related.loose_tokens(own, related.near_events(chosen, e, near, related.traces_of(own)))
    cols = ["signal_id", "token", "near", "back", "lift", "kept"]
    got = sorted(rows(related.related_lift(own, e, loose).select(*cols)))
    assert len(got) > 100 and got == sorted(rows(want.select(*cols)))


def test_trace_ranks_over_batches():
    import pyarrow as pa

    table = pa.table({"trace_id": [1, 1, 1, 2, 2, 3], "signal_id": [9, None, None, None, 8, 7], "token": [None, "x", "x", "y", None, None], "at": [100.0, 90.0, 101.0, 50.0, 50.0, 1.0]})
    want = [(9, "x", 1, 0), (8, "y", 1, 0)]
    for size in (1, 2, 4, 6):
        got = pa.Table.from_batches(list(related._trace_ranks(1.0)(iter(table.to_batches(size))))).to_pylist()
        assert [tuple(r.values()) for r in got] == want


def test_lift_prune_makes_no_pairs(spark, one_trace):
    got = queries.q_lift_prune(spark, one_trace)
    assert most_rows(got) <= 10 * 400
    assert got.agg(F.max("near")).first()[0] == 400


def test_trace_as_of_makes_no_pairs(spark, one_trace):
    got = queries.q_trace_as_of(spark, one_trace)
    assert most_rows(got) <= 10 * 400
    assert sorted(rows(got)) == [(i, i, i, i - 1) for i in range(1, 400)]


def test_pruned_counts_are_those_of_the_pairs(spark):
    s, e, near = related_cases(spark)
    r = cut(temporal.related_events(s, e, near))
    left = context.lift_pruned(r, context.token_lift(r)).groupBy("signal_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))
    want = r.groupBy("signal_id").agg(F.count("*").alias("n_before")).join(left, "signal_id")
    chosen = temporal.adaptive_window(s, e)
    own = related.own_events(chosen, e)
    loose = related.loose_tokens(own, related.near_events(chosen, e, near, related.traces_of(own)))
    kept = related.related_lift(own, e, loose).where("kept")
    assert sorted(rows(related.pruned_counts(own, e, loose, kept))) == sorted(rows(want))


def test_lift_pruned_makes_no_pairs(spark, one_trace, monkeypatch):
    monkeypatch.setattr(temporal, "related_events", None)  # the pairs, whose lineage the query used to cut
    got = queries.q_lift_pruned(spark, one_trace)
    assert most_rows(got) <= 10 * 400
    assert {tuple(r)[1:] for r in got.collect()} == {(400, 400, 400 * 399 // 2)}


def test_related_counts_are_those_of_the_pairs(spark):
    s, e, near = related_cases(spark)
    pairs = temporal.related_events(s, e, near)
    want = pairs.groupBy("signal_id").agg(F.count("*"), *[F.count_if(F.col("via") == v) for v in range(3)], F.sum("event_id"))
    chosen = temporal.adaptive_window(s, e)
    own = related.own_events(chosen, e)
    loose = related.loose_tokens(own, related.near_events(chosen, e, near, related.traces_of(own)))
    assert sorted(rows(related.related_counts(own, e, loose))) == sorted(rows(want))


def test_related_window_makes_no_pairs(spark, one_trace):
    got = queries.q_related_window(spark, one_trace)
    assert most_rows(got) <= 10 * 400
    assert {tuple(r)[1:5] for r in got.collect()} == {(400, 1, 399, 0)}


def test_root_causes_make_no_graph_of_a_start(spark, monkeypatch):
    """Against all graphs by loops: sparse ones without a free node beside dense ones, loops, weak edges, evidence of several edges."""
    monkeypatch.setattr(graph, "causal_chain", None)  # the start's graph, which used to be written for every start
    rng = random.Random(3)
    e, seen = {}, set()
    for part, size, many in (("a", 5, 12), ("b", 9, 14), ("c", 14, 17), ("d", 30, 34), ("e", 6, 6)):
        ring = [(i, (i + 1) % size) for i in range(size)] if part == "e" else []
        for a, b in [*ring, *((rng.randrange(size), rng.randrange(size)) for _ in range(0 if ring else many))]:
            src, dst = f"{part}{a:02d}", f"{part}{b:02d}"
            e[src, dst] = (round(rng.choice([0.2, 0.3, 0.5, 0.95]), 2) if not ring else 0.5, float(rng.randrange(100)))
            seen |= {(src, dst, rng.randrange(40)) for _ in range(rng.randrange(4))}
    deployed = {n: float(rng.randrange(100)) for n in sorted({n for k in e for n in k}) if rng.random() < 0.4}
    nodes = sorted({n for k in e for n in k}) + ["alone"]

    def want(start):
        good = {k: v for k, v in e.items() if v[0] >= 0.25}
        near = {start}
        for _ in range(3):
            near |= {y for k in good for x, y in (k, k[::-1]) if x in near}
        own = {k: v for k, v in good.items() if set(k) & near}
        every = {n for k in own for n in k} | {start}
        n = {x: sum(k[1] == x for k in own) for x in every}
        roots = {x for x in every if n[x] == 0} or {x for x in every if n[x] == 1 and x != start}
        paths, level = {start: (start,)}, {start: (start,)}
        for _ in range(4):
            step = {}
            for x, path in level.items():
                for a, b in own:
                    if b == x and a != b and a not in paths:
                        step[a] = min(step.get(a, ("~",)), (a, *path))
            level = step
            paths |= step
        for x in roots & set(paths):
            steps = list(zip(paths[x], paths[x][1:]))
            times = [own[s][1] for s in steps] + ([deployed[x]] if x in deployed else [])
            sure = sum(own[s][0] for s in steps) / len(steps) if steps else 0.0
            yield start, x, len(steps), round(sure, 9), len({v for s, d, v in seen if (s, d) in steps}), min(times, default=None), paths[x]

    frame = spark.createDataFrame([(*k, "upstream_call", *v) for k, v in e.items()], "src string, dst string, relation string, confidence double, first_seen double")
    got = graph.root_causes(spark.createDataFrame([(n,) for n in nodes], "cid string"), frame, spark.createDataFrame(sorted(seen), "src string, dst string, evidence long"), spark.createDataFrame(sorted(deployed.items()), "cid string, ts double"))
    got = sorted((r["start"], r["cid"], r["hops"], round(r["confidence"], 9), r["evidence_count"], r["earliest"], tuple(r["path"])) for r in got.collect())
    assert got == sorted(w for n in nodes for w in want(n)) and any(r[1] != r[0] and r[4] for r in got)


def test_context_full_makes_no_pairs(spark, one_trace, monkeypatch):
    monkeypatch.setattr(temporal, "related_events", None)  # the pairs, whose lineage the query used to cut
    assert {r["related"] for r in queries.q_context_full(spark, one_trace).collect()} == {400}
