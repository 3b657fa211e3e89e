"""The same questions in plain SQL, for an engine of another kind to answer."""

from __future__ import annotations

_RELEVANT = "('deploy', 'metric', 'log', 'trace', 'incident_signal')"

def _name(user: str, n: str) -> str:
    return f"(['svc', 'payments', 'edge-api', 'mysql', 'worker'][({user}) % 5 + 1] || '-' || ({user}) || '-v' || {n})"


_OPS = f"""raw AS (
    SELECT event_id, epoch_us(ts) / 1e6 AS ts, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        CASE event_type WHEN 'signup' THEN 'deploy' WHEN 'view' THEN 'metric' WHEN 'error' THEN 'log' WHEN 'click' THEN 'trace'
            ELSE CASE WHEN value < 50 THEN 'incident_signal' ELSE 'remediation' END END AS kind
    FROM events
), up AS (
    SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM raw WHERE kind = 'deploy' AND value >= 100
), ren AS (
    SELECT event_id AS seq, user_id, {_name('user_id', '(n - 1)')} AS old_name, CASE WHEN event_id % 7 = 0 THEN {_name('user_id + 1', '0')} ELSE {_name('user_id', 'n')} END AS new_name FROM up
), par AS (
    SELECT r.*, (SELECT max(p.seq) FROM ren p WHERE p.new_name = r.old_name AND p.seq < r.seq) AS parent FROM ren r
), ids AS (
    SELECT seq, old_name, new_name, substr(md5(old_name), 1, 8) AS cid FROM par WHERE parent IS NULL
    UNION ALL SELECT p.seq, p.old_name, p.new_name, i.cid FROM par p JOIN ids i ON p.parent = i.seq
), named AS (
    SELECT e.*, coalesce(r.new_name, {_name('e.user_id', '0')}) AS service FROM raw e ASOF LEFT JOIN ren r ON e.user_id = r.user_id AND e.event_id >= r.seq
), ops AS (
    SELECT e.*, coalesce(i.cid, substr(md5(e.service), 1, 8)) AS cid, CAST(floor(e.ts / 21600) AS BIGINT) * 100 + k AS trace_id,
        CASE WHEN kind = 'remediation' THEN ['rollback', 'restart', 'scale up'][k % 3 + 1] END AS action, CASE WHEN kind = 'remediation' THEN CASE WHEN event_id % 2 = 0 THEN 'resolved' ELSE 'failed' END END AS outcome
    FROM named e ASOF LEFT JOIN ids i ON e.service = i.new_name AND e.event_id >= i.seq
), sig AS (SELECT event_id AS signal_id, ts AS anchor, cid, user_id, service FROM ops WHERE kind = 'incident_signal')"""

_NAMES = """ali AS (
    SELECT cid, name, min(seq) AS seq FROM (
        SELECT substr(md5(old_name), 1, 8) AS cid, old_name AS name, -1 AS seq FROM ren WHERE substr(md5(old_name), 1, 8) IN (SELECT cid FROM ids)
        UNION ALL SELECT cid, new_name, seq FROM ids UNION ALL SELECT cid, service, -1 FROM ops WHERE cid = substr(md5(service), 1, 8)) GROUP BY cid, name
), now_name AS (SELECT DISTINCT ON (cid) cid, name FROM ali ORDER BY cid, seq DESC, name DESC), role AS (
    SELECT cid, coalesce(arg_min(r, (seq, name)) FILTER (r <> 'service'), 'service') AS role FROM (
        SELECT *, CASE WHEN name LIKE 'payments-%' THEN 'payment' WHEN name LIKE 'edge-api-%' THEN 'gateway' WHEN name LIKE 'mysql-%' THEN 'database' ELSE coalesce(nullif(regexp_extract(name, 'v[0-9][0-9]+$'), ''), 'service') END AS r FROM ali) GROUP BY cid
)"""

_DEPLOY = """deploy_obs AS (
    SELECT e.cid AS src, e.cid AS dst, 'deploy_to_' || e.kind AS relation, e.event_id AS evidence, max(d.ts) AS ts_src, e.ts AS ts_dst, e.event_id AS seq
    FROM ops e JOIN ops d ON d.cid = e.cid AND d.kind = 'deploy' AND d.ts <= e.ts AND e.ts - d.ts <= 518400
    WHERE e.kind IN ('log', 'metric', 'trace') GROUP BY e.cid, e.kind, e.event_id, e.ts
)"""
_UPSTREAM = f"""calls AS (
    SELECT event_id, ts, cid AS src, {_name('(user_id * 7 + k % 3) % (SELECT max(user_id) + 1 FROM raw)', '0')} AS called FROM ops WHERE kind = 'trace'
), upstream_obs AS (
    SELECT src, coalesce(i.cid, substr(md5(called), 1, 8)) AS dst, 'upstream_call' AS relation, event_id AS evidence, ts AS ts_src, ts + 1 AS ts_dst, event_id AS seq
    FROM calls c ASOF LEFT JOIN ids i ON c.called = i.new_name AND c.event_id >= i.seq WHERE src <> coalesce(i.cid, substr(md5(called), 1, 8))
)"""
_LOGS = """open_inc AS (
    SELECT s.signal_id, s.cid, s.anchor, min(r.ts) AS until FROM sig s LEFT JOIN ops r ON r.cid = s.cid AND r.kind = 'remediation' AND r.ts >= s.anchor GROUP BY ALL
), log_obs AS (
    SELECT o.cid AS src, o.cid AS dst, 'error_log_during_incident' AS relation, l.event_id AS evidence, o.anchor AS ts_src, l.ts AS ts_dst, l.event_id AS seq
    FROM open_inc o JOIN ops l ON l.cid = o.cid AND l.kind = 'log' AND l.ts BETWEEN o.anchor AND o.anchor + 518400 AND (o.until IS NULL OR l.ts < o.until)
)"""


def _rolled(source: str, name: str = "edges") -> str:
    return f"""{name}_o AS (SELECT * FROM ({source}) WHERE ts_src < ts_dst), {name}_w AS (
    SELECT DISTINCT ON (src, dst) src, dst, relation FROM {name}_o ORDER BY src, dst, ts_dst, seq, relation
), {name} AS (
    SELECT src, dst, relation, count(*) AS "count", arg_min(ts_src, (ts_dst, seq, ts_src)) AS first_seen, max(ts_dst) AS last_seen, count(DISTINCT evidence) AS evidence_count,
        least(95e-2, 3e-1 + 5e-2 * (count(*) - 1)) AS confidence
    FROM {name}_o JOIN {name}_w USING (src, dst, relation) GROUP BY src, dst, relation
)"""


_EVERY = "SELECT * FROM deploy_obs UNION ALL SELECT * FROM upstream_obs UNION ALL SELECT * FROM log_obs"
_EDGES = ", ".join([_OPS, _DEPLOY, _UPSTREAM, _LOGS, _rolled(_EVERY)])
_EDGE_COLUMNS = 'SELECT src, dst, relation, "count", round(confidence, 6) AS confidence, evidence_count FROM edges'
_W = "WITH RECURSIVE "

_TOKENS = """tok AS (
    SELECT *, CASE WHEN kind = 'metric' THEN 'metric:latency_' || CAST(floor(k / 10) AS BIGINT) WHEN kind = 'log' THEN
        CASE k % 3 WHEN 0 THEN 'log:timeout' WHEN 1 THEN 'log:error' ELSE 'log:other' END ELSE kind END AS token FROM ops
)"""

_ADAPTIVE = f"""width AS (
    SELECT s.signal_id, s.anchor, s.cid, CASE WHEN count(e.event_id) FILTER (e.ts >= s.anchor - 86400) >= 5 THEN 600 WHEN count(e.event_id) FILTER (e.ts >= s.anchor - 172800) >= 5 THEN 1200 ELSE 3600 END AS width
    FROM sig s LEFT JOIN ops e ON e.cid = s.cid AND e.kind IN {_RELEVANT} AND e.ts BETWEEN s.anchor - 518400 AND s.anchor GROUP BY ALL
), own AS (
    SELECT w.signal_id, w.anchor, w.cid, e.event_id, e.trace_id FROM width w JOIN ops e ON e.cid = w.cid AND e.kind IN {_RELEVANT} AND e.ts BETWEEN w.anchor - w.width * 144 AND w.anchor
), traced AS (
    SELECT DISTINCT o.signal_id, o.anchor, o.cid, e.event_id, e.ts, e.cid AS e_cid FROM (SELECT DISTINCT signal_id, anchor, cid, trace_id FROM own WHERE trace_id IS NOT NULL) o JOIN ops e ON e.trace_id = o.trace_id AND e.kind IN {_RELEVANT}
)"""
_RELATED = f"""nb AS (SELECT src AS cid, dst AS near FROM edges UNION SELECT dst, src FROM edges), beside AS (
    SELECT DISTINCT w.signal_id, e.event_id FROM width w JOIN nb ON nb.cid = w.cid JOIN ops e ON e.cid = nb.near AND e.kind IN {_RELEVANT} AND e.ts BETWEEN w.anchor - w.width * 144 AND w.anchor
), every AS (SELECT signal_id, event_id, min(via) AS via FROM (SELECT signal_id, event_id, 0 AS via FROM own UNION ALL SELECT signal_id, event_id, 1 FROM traced UNION ALL SELECT signal_id, event_id, 2 FROM beside) GROUP BY ALL)"""
_LIFT = f"""rel AS (SELECT e.signal_id, s.anchor, t.event_id, t.ts, t.token FROM every e JOIN sig s USING (signal_id) JOIN tok t USING (event_id)), c AS (
    SELECT signal_id, token, count(*) FILTER (anchor - ts BETWEEN 0 AND 8640) AS near, count(*) FILTER (anchor - ts BETWEEN 17280 AND 86400) AS back FROM rel GROUP BY ALL
), w AS (SELECT *, sum(near) OVER (PARTITION BY signal_id) AS na, sum(back) OVER (PARTITION BY signal_id) AS ba FROM c), l AS (
    SELECT *, round(CASE WHEN na > 0 THEN near / na::DOUBLE ELSE 0e0 END / greatest(1e-2, CASE WHEN ba > 0 THEN back / ba::DOUBLE ELSE 0e0 END), 6) AS lift FROM w
), lifts AS (SELECT signal_id, token, near, back, lift, near > 0 AND (lift >= 2 OR token IN ('incident_signal', 'deploy', 'trace')) AS kept FROM l)"""


def _chain(hops: int, least: str, starts: str = "SELECT DISTINCT cid FROM sig", p: str = "") -> str:
    """The causal chain of some services, as CTEs whose names begin with p: starts, r0..rn (nodes by hops) and chain."""
    reach = "".join(f", {p}r{h} AS (SELECT * FROM {p}r{h - 1} UNION SELECT start, b FROM {p}r{h - 1} JOIN {p}und ON a = node)" for h in range(1, hops + 1))
    return f"""{p}good AS (SELECT * FROM edges WHERE confidence >= {least}), {p}und AS (SELECT src AS a, dst AS b FROM {p}good UNION SELECT dst, src FROM {p}good), {p}starts AS (SELECT cid AS start FROM ({starts})),
    {p}r0 AS (SELECT start, start AS node FROM {p}starts){reach}, {p}chain AS (
        SELECT start, src, dst, count(*) AS times, any_value(confidence) AS confidence, any_value(relation) AS relation, any_value(first_seen) AS first_seen FROM (
            SELECT n.start, g.* FROM {p}r{hops} n JOIN {p}good g ON g.src = n.node UNION ALL SELECT n.start, g.* FROM {p}r{hops} n JOIN {p}good g ON g.dst = n.node) GROUP BY start, src, dst)"""


_RESOLVED = "fix AS (SELECT cid, ts FROM ops WHERE kind = 'remediation' AND outcome = 'resolved')"
_HITS = ", ".join([_EDGES, _RESOLVED, _chain(2, "0e0", "SELECT DISTINCT cid FROM fix", "f_"), "hits AS (SELECT c.start AS cid, c.src, c.dst, f.ts, f.n FROM f_chain c JOIN (SELECT cid, ts, count(*) AS n FROM fix GROUP BY ALL) f ON f.cid = c.start AND f.ts >= c.first_seen)"])
_REINFORCED = _HITS + ", strong AS (SELECT e.*, coalesce(h.times, 0) AS times FROM edges e LEFT JOIN (SELECT src, dst, CAST(sum(n) AS BIGINT) AS times FROM hits GROUP BY ALL) h USING (src, dst))"


def _paths(hops: int) -> str:
    out = "p0 AS (SELECT start, start AS node, [start] AS path, 0 AS hops, 0e0 AS total, CAST(NULL AS DOUBLE) AS earliest FROM starts)"
    for h in range(1, hops + 1):
        known = " UNION ALL ".join(f"SELECT start, node FROM p{i}" for i in range(h))
        out += f""", p{h} AS (SELECT start, node, unnest(b) FROM (SELECT start, node, arg_min({{'path': path, 'hops': hops, 'total': total, 'earliest': earliest}}, path) AS b FROM (
            SELECT p.start, g.src AS node, list_prepend(g.src, p.path) AS path, {h} AS hops, p.total + g.confidence AS total, least(p.earliest, g.first_seen) AS earliest FROM p{h - 1} p JOIN chain g ON g.start = p.start AND g.dst = p.node WHERE g.src <> g.dst)
            WHERE (start, node) NOT IN ({known}) GROUP BY ALL))"""
    every = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(hops + 1))
    return f"{out}, paths AS ({every})"


_ROOTS = f"""{_EDGES}, {_chain(3, '25e-2')}, {_paths(4)}, ends AS (SELECT start, src AS cid FROM chain UNION SELECT start, dst FROM chain UNION SELECT start, start FROM starts), deg AS (
    SELECT start, cid, count(c.dst) AS n FROM ends LEFT JOIN (SELECT start, dst FROM chain) c ON c.start = ends.start AND c.dst = ends.cid GROUP BY ends.start, cid
), root AS (SELECT start, cid FROM (SELECT *, bool_or(n = 0) OVER (PARTITION BY start) AS lone FROM (SELECT e.start, e.cid, (SELECT count(*) FROM chain c WHERE c.start = e.start AND c.dst = e.cid) AS n FROM ends e)) WHERE (lone AND n = 0) OR (NOT lone AND n <= 1 AND cid <> start)
), found AS (SELECT r.start, r.cid, p.hops, p.path, p.earliest, CASE WHEN p.hops > 0 THEN p.total / p.hops ELSE 0e0 END AS confidence FROM root r JOIN paths p ON p.start = r.start AND p.node = r.cid
), ev AS (SELECT DISTINCT o.src, o.dst, o.evidence FROM ({_EVERY}) o JOIN edges e ON e.src = o.src AND e.dst = o.dst AND e.relation = o.relation WHERE o.ts_src < o.ts_dst
), steps AS (SELECT start, cid, unnest(path[1:len(path) - 1]) AS src, unnest(path[2:]) AS dst FROM found), seen AS (SELECT start, cid, count(DISTINCT evidence) AS n FROM steps JOIN ev USING (src, dst) GROUP BY ALL
), dep AS (SELECT cid, max(ts) AS t FROM ops WHERE kind = 'deploy' GROUP BY cid)""".replace(""", deg AS (
    SELECT start, cid, count(c.dst) AS n FROM ends LEFT JOIN (SELECT start, dst FROM chain) c ON c.start = ends.start AND c.dst = ends.cid GROUP BY ends.start, cid
)""", "")

_MEMORY = """mem AS (
    SELECT cid AS id, list_reduce(list_prepend(6e-1, list((outcome = 'resolved')::INT::DOUBLE ORDER BY ts, event_id)), lambda c, o: CASE WHEN o = 1 THEN least(95e-2, c + 1e-1) ELSE greatest(1e-1, c * 8e-1) END) AS c,
        count(*) FILTER (outcome = 'resolved') AS successes, count(*) FILTER (outcome <> 'resolved') AS failures, min(ts) AS created FROM ops WHERE kind = 'remediation' GROUP BY cid
), memory AS (SELECT id, round(c, 6) AS confidence, successes, failures FROM mem)"""

_SAID = """say AS (
    SELECT cid, ts, CASE kind WHEN 'log' THEN list_filter(string_split(CASE k % 3 WHEN 0 THEN 'db timeout after ' || k WHEN 1 THEN 'error code ' || k ELSE 'request slow' END, ' '), lambda w: length(w) > 3)
        WHEN 'metric' THEN ['latency_' || CAST(floor(k / 10) AS BIGINT)] WHEN 'deploy' THEN ['v' || k] ELSE [] END AS words FROM ops
)"""


def _said(at: str) -> str:
    """Distinct words of the hour before (id, anchor, cid), sorted, twenty at most."""
    return f"SELECT id, coalesce(list_sort(list(DISTINCT w) FILTER (w IS NOT NULL)), [])[1:20] AS tokens FROM (SELECT a.id, s.words FROM ({at}) a JOIN say s ON s.cid = a.cid AND s.ts BETWEEN a.anchor - 518400 AND a.anchor) LEFT JOIN LATERAL (SELECT unnest(words) AS w) ON true GROUP BY id"


_SHAPES = ", ".join([_EDGES, _NAMES, _chain(2, "3e-1", "SELECT DISTINCT cid FROM ops WHERE kind IN ('incident_signal', 'remediation')"), """place AS (
    SELECT c.*, row_number() OVER (PARTITION BY start ORDER BY first_seen, src, dst) AS place, coalesce(a.role, 'service') AS src_role, coalesce(b.role, 'service') AS dst_role FROM chain c LEFT JOIN role a ON a.cid = c.src LEFT JOIN role b ON b.cid = c.dst
), trip AS (SELECT start, string_agg(t, ';' ORDER BY place) AS shape, CAST(sum(times) AS BIGINT) AS n, list(DISTINCT src_role || '>' || relation || '>' || dst_role) AS kinds, sum(times * confidence) / sum(times) AS confidence
    FROM (SELECT *, array_to_string([src_role || '>' || relation || '>' || dst_role for x in range(times)], ';') AS t FROM place) GROUP BY start
), seqs AS (SELECT start, list(role ORDER BY pos) AS sequence FROM (SELECT start, role, min(pos) AS pos FROM (SELECT start, src_role AS role, place * 2 AS pos FROM place UNION ALL SELECT start, dst_role, place * 2 + 1 FROM place) GROUP BY ALL) GROUP BY start
), idl AS (SELECT start, list_sort(list(DISTINCT id)) AS ids FROM (SELECT start, src AS id FROM chain UNION ALL SELECT start, dst FROM chain UNION ALL SELECT DISTINCT start, start FROM chain UNION ALL
    SELECT start, near FROM (SELECT DISTINCT start FROM chain) JOIN (SELECT src AS cid, dst AS near FROM edges UNION SELECT dst, src FROM edges) ON cid = start) GROUP BY start
), shapes AS (SELECT start, ids, sequence, shape, n, kinds, confidence FROM trip JOIN seqs USING (start) JOIN idl USING (start))"""])

_BEHAVIOUR = """CASE WHEN x LIKE '%timeout%' THEN 'TIMEOUT' WHEN x LIKE '%latency%' THEN 'LATENCY' WHEN x LIKE '%error%' THEN 'ERROR' ELSE 'OTHER' END"""
_LAST = "SELECT cid AS id, cid, max(ts) AS anchor, arg_max(action, ts) AS action FROM ops WHERE kind = 'remediation' AND outcome = 'resolved' GROUP BY cid"
_SIMILAR = f"""{_SHAPES}, {_SAID}, {_MEMORY}, last AS ({_LAST}), stored AS (
    SELECT l.id, l.action, coalesce(h.ids, [l.cid]) AS ids, coalesce(h.sequence, []) AS sequence, coalesce(t.tokens, []) AS tokens, m.confidence FROM last l LEFT JOIN shapes h ON h.start = l.cid LEFT JOIN ({_said('SELECT id, anchor, cid FROM last')}) t ON t.id = l.id
        JOIN memory m ON m.id = l.id WHERE m.confidence >= 0.15 ORDER BY m.confidence DESC, l.id LIMIT 100
), asked AS (
    SELECT s.signal_id AS id, coalesce(h.ids, [s.cid]) AS ids, coalesce(h.sequence, []) AS sequence, coalesce(t.tokens, []) AS tokens FROM sig s LEFT JOIN shapes h ON h.start = s.cid LEFT JOIN ({_said('SELECT signal_id AS id, anchor, cid FROM sig')}) t ON t.id = s.signal_id
), sr AS (SELECT *, list_distinct(list_transform(sequence || tokens, lambda x: {_BEHAVIOUR})) AS roles FROM stored), qr AS (SELECT *, list_distinct(list_transform(sequence || tokens, lambda x: {_BEHAVIOUR})) AS roles FROM asked
), pair AS (SELECT q.id AS signal_id, s.id AS motif_id, q.ids AS qi, s.ids AS si, q.sequence AS qs, s.sequence AS ss, q.tokens AS qt, s.tokens AS st,
    CASE WHEN len(q.roles) = 0 OR len(s.roles) = 0 THEN 0e0 ELSE len(list_intersect(q.roles, s.roles)) / len(list_distinct(q.roles || s.roles))::DOUBLE END AS role,
    len(list_intersect(q.ids, s.ids)) / len(list_distinct(q.ids || s.ids))::DOUBLE AS idj,
    CASE WHEN len(q.sequence) = 0 AND len(s.sequence) = 0 THEN 1e0 ELSE len(list_intersect(q.sequence, s.sequence)) / len(list_distinct(q.sequence || s.sequence))::DOUBLE END AS seqj,
    CASE WHEN len(q.tokens) = 0 OR len(s.tokens) = 0 THEN 0e0 ELSE len(list_intersect(q.tokens, s.tokens)) / len(list_distinct(q.tokens || s.tokens))::DOUBLE END AS tokj FROM qr q, sr s
), scored AS (SELECT *, 6e-1 * role + 4e-1 * ((85e-2 * idj + 1e-1 * seqj) + 5e-2 * tokj) AS score FROM pair
), top AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY score DESC, motif_id) AS rank FROM scored)"""

_MATCHES = """m AS (
    SELECT o_custkey AS signal_id, CASE WHEN o_orderkey % 11 = 0 THEN 'inc-' ELSE 'INC-' END || o_orderkey || '-' || (o_orderkey % 5) AS incident_id, o_orderkey AS seq,
        (o_orderkey * 7919 % 1000)::DOUBLE / 1e3 AS similarity,
        CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE ['rollback', 'restart', 'scale up', 'failover', 'drain'][o_orderkey % 5 + 1] END AS action,
        CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'failed' END AS outcome,
        o_orderkey % 3 <> 0 AS has_deploy, o_orderkey % 4 <> 0 AS has_metric, o_orderkey % 5 <> 0 AS has_trace_log, CAST(o_orderkey % 5 AS VARCHAR) AS tail,
        CASE WHEN o_orderkey % 11 = 0 THEN 'inc-' || o_orderkey || '-' || (o_orderkey % 5) ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS family
    FROM orders
), post AS (
    SELECT signal_id, family, avg(similarity) AS mean, max(similarity) AS best, coalesce(list_reverse_sort(list(similarity))[2], 0e0) AS second, count(*) AS n, var_pop(similarity) AS variance FROM m GROUP BY ALL
), fam AS (
    SELECT signal_id, family, round(4e-1 * mean + 4e-1 * (best - second) + 2e-1 * least(1e0, n / 5e0), 6) AS score FROM post
)"""
_M = f"WITH {_MATCHES} "

_PRED = """p AS (
    SELECT * FROM (
        SELECT l_orderkey AS incident_id, nullif(l_orderkey % 6, 5) AS truth, l_suppkey % 5 AS family, l_quantity / 50 AS similarity,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity / 50 DESC, l_partkey, l_suppkey, l_extendedprice) AS rank FROM lineitem) WHERE rank <= 5
), b AS (
    SELECT incident_id, any_value(truth) AS truth, max(CASE WHEN rank = 1 THEN family END) AS first, max(CASE WHEN rank = 1 THEN similarity END) AS similarity, count(*) FILTER (family = truth) AS hits, count(*) AS n FROM p GROUP BY incident_id
)"""
_REMEDY = """rem AS (
    SELECT o_orderkey AS incident_id, nullif(o_orderkey % 6, 5) AS truth, CASE WHEN o_orderkey % 7 <> 0 THEN ['rollback', 'restart', 'scale up'][o_orderkey % 3 + 1] END AS expected,
        CASE WHEN o_orderkey % 9 <> 0 THEN ['rollback', 'restart', 'scale up'][(o_orderkey + (o_orderkey % 4 = 0)::INT) % 3 + 1] END AS action, (o_orderkey * 7919 % 100) / 100 AS confidence FROM orders
)"""
_PRED += f""", {_REMEDY}, loss AS (
    SELECT incident_id, truth, category, CASE category WHEN 'recall_miss' THEN 3e-1 WHEN 'contamination' THEN 15e-2 ELSE 2e-1 END AS loss FROM (
        SELECT b.*, CASE WHEN b.truth IS NULL THEN CASE WHEN similarity >= 0.5 THEN 'decoy_false_positive' END WHEN hits = 0 THEN 'recall_miss' WHEN first = b.truth AND NOT (expected IS NULL OR coalesce(action = expected, false)) THEN 'remediation_mismatch'
            WHEN first <> b.truth THEN 'contamination' END AS category FROM b LEFT JOIN rem USING (incident_id)) WHERE category IS NOT NULL
)"""
_P = f"WITH {_PRED} "

_RUNS = """r AS (
    SELECT l_suppkey % 50 AS seed, CASE WHEN l_returnflag = 'R' THEN 'new' ELSE 'old' END AS run, round(avg(l_discount) * 8, 6) AS recall, round(avg(l_tax) * 10, 6) AS "precision", round(avg(l_quantity) / 60, 6) AS remediation, max(l_extendedprice) / 20 AS p95 FROM lineitem GROUP BY 1, 2
), s AS (
    SELECT *, round(3e-1 * recall + 15e-2 * "precision" + 2e-1 * remediation + 15e-2 * least(1e0, 2000 / greatest(p95, 1e-6)), 6) AS score FROM r
)"""

_ABCD = f"""k AS (SELECT cid, ts, kind FROM ops WHERE kind IN ('deploy', 'metric', 'log', 'trace')), hit AS (
    SELECT k.kind, count(DISTINCT s.signal_id) AS a FROM sig s JOIN k ON k.cid = s.cid AND k.ts >= s.anchor - 86400 AND k.ts < s.anchor GROUP BY 1
), t AS (
    SELECT kind, coalesce(a, 0) AS a, greatest(0, events - coalesce(a, 0)) AS b, (SELECT count(*) FROM sig) - coalesce(a, 0) AS c, greatest(0, (SELECT count(*) FROM sig) - coalesce(a, 0)) AS d
    FROM (SELECT kind, count(*) AS events FROM k GROUP BY 1) LEFT JOIN hit USING (kind)
), chi AS (
    SELECT *, (a + b + c + d)::DOUBLE AS n, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) = 0 THEN 0e0 ELSE (a + b + c + d) * (a * d - b * c)::DOUBLE * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d))::DOUBLE END AS chi,
        (a / (a + b)::DOUBLE) / greatest((a + c)::DOUBLE / (a + b + c + d), 1e-3) AS rr FROM t
)"""

_CASE_TYPES = """CASE WHEN r LIKE '%deploy%' THEN 'DEPLOY' WHEN r LIKE '%metric%' OR r LIKE '%spike%' THEN 'METRIC_SPIKE' WHEN r LIKE '%error%' OR r LIKE '%log%' THEN 'ERROR_BURST'
    WHEN r LIKE '%upstream%' OR r LIKE '%call%' THEN 'UPSTREAM_FAILURE' WHEN r LIKE '%latency%' THEN 'LATENCY_SPIKE' WHEN r LIKE '%trace%' THEN 'TRACE_ERROR' ELSE upper(r) END"""
_CASE_ROLES = """CASE WHEN r LIKE '%deploy%' THEN 'DEPLOY' WHEN r LIKE '%metric%' OR r LIKE '%latency%' OR r LIKE '%spike%' THEN 'METRIC_ANOMALY' WHEN r LIKE '%log%' OR r LIKE '%error%' THEN 'ERROR_LOG'
    WHEN r LIKE '%trace%' OR r LIKE '%upstream%' OR r LIKE '%call%' THEN 'UPSTREAM_CALL' WHEN r LIKE '%incident%' THEN 'INCIDENT' WHEN r LIKE '%remediation%' OR r LIKE '%rollback%' OR r LIKE '%restart%' THEN 'REMEDIATION' ELSE 'SIGNAL' END"""

ORACLES = {
    "q_event_count": _W + f"{_OPS} SELECT kind, count(*) AS n FROM ops GROUP BY kind",
    "q_window_lookback": _W + f"{_OPS} SELECT signal_id, count(*) AS n, min(e.event_id) AS first_event FROM sig s JOIN ops e ON e.cid = s.cid AND e.kind IN {_RELEVANT} AND e.ts BETWEEN s.anchor - 43200 AND s.anchor GROUP BY signal_id",
    "q_adaptive_window": _W + f"{_OPS}, {_ADAPTIVE} SELECT signal_id, CAST(width AS BIGINT) AS width FROM width",
    "q_related_window": _W + f"""{_EDGES}, {_ADAPTIVE}, {_RELATED}
    SELECT signal_id, count(*) AS n, count(*) FILTER (via = 0) AS n_own, count(*) FILTER (via = 1) AS n_trace, count(*) FILTER (via = 2) AS n_near, CAST(sum(event_id) AS BIGINT) AS id_sum FROM every GROUP BY signal_id""",
    "q_trace_correlation": _W + f"{_OPS}, {_ADAPTIVE} SELECT signal_id, count(*) AS n, count(*) FILTER (e_cid <> cid) AS n_other, max(event_id) AS last_event FROM traced WHERE (signal_id, event_id) NOT IN (SELECT (signal_id, event_id) FROM own) GROUP BY signal_id",
    "q_lift_prune": _W + f"{_EDGES}, {_TOKENS}, {_ADAPTIVE}, {_RELATED}, {_LIFT} SELECT * FROM lifts",
    "q_content_tokens": _W + f"{_OPS}, {_SAID}, t AS ({_said('SELECT signal_id AS id, anchor, cid FROM sig')}) SELECT id AS signal_id, array_to_string(tokens, ',') AS tokens FROM t",
    "q_rename_resolve": _W + f"{_OPS} SELECT name, coalesce((SELECT arg_max(cid, seq) FROM ids WHERE new_name = name), substr(md5(name), 1, 8)) AS cid FROM (SELECT old_name AS name FROM ren UNION SELECT new_name FROM ren)",
    "q_alias_history": _W + f"{_OPS}, {_NAMES} SELECT cid, string_agg(name, ',' ORDER BY seq, name) AS names, count(*) AS n FROM ali GROUP BY cid",
    "q_current_name": _W + f"{_OPS}, {_NAMES} SELECT cid, name FROM now_name",
    "q_role_infer": """SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'payment' WHEN 2 THEN 'gateway' WHEN 3 THEN 'database' ELSE (
        CASE WHEN p_name LIKE '%edge%' THEN 'gateway' WHEN p_name LIKE '%db%' THEN 'database' WHEN p_name LIKE '%pay%' OR p_name LIKE '%bil%' THEN 'payment' ELSE
        coalesce(list_filter(string_split(lower(replace(p_name, ' ', '-')), '-'), lambda t: length(t) >= 3)[1], 'service') END) END AS role FROM part""",
    "q_relation_labels": f"WITH x AS (SELECT o_orderkey, o_orderstatus || '_' || ['deploy_to_metric', 'error_log', 'upstream_call', 'latency', 'trace', 'restart', 'x'][o_orderkey % 7 + 1] AS raw, lower(raw) AS r FROM orders) SELECT o_orderkey, {_CASE_TYPES} AS event_type, {_CASE_ROLES} AS role FROM x",
    "q_fingerprint": _W + f"""{_OPS}, g AS (SELECT k, cid || '|' || kind || '|k=' || k AS part, count(*) AS n FROM ops GROUP BY ALL)
    SELECT k, md5(string_agg(part || '|' || n, ';' ORDER BY part || '|' || n)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY k""",
    "q_asof_deploy": _W + f"{_OPS} SELECT e.event_id, (SELECT arg_max(d.event_id, (d.ts, -d.event_id)) FROM ops d WHERE d.cid = e.cid AND d.kind = 'deploy' AND d.ts <= e.ts AND e.ts - d.ts <= 518400) AS deploy_id FROM ops e WHERE kind <> 'deploy'",
    "q_edges_deploy_signal": _W + f"{_OPS}, {_DEPLOY}, {_rolled('SELECT * FROM deploy_obs')} {_EDGE_COLUMNS}",
    "q_edges_upstream": _W + f"{_OPS}, {_UPSTREAM}, {_rolled('SELECT * FROM upstream_obs')} {_EDGE_COLUMNS}",
    "q_edges_incident_log": _W + f"{_OPS}, {_LOGS}, {_rolled('SELECT * FROM log_obs')} {_EDGE_COLUMNS}",
    "q_edges": _W + f"{_EDGES} {_EDGE_COLUMNS}",
    "q_graph_stats": _W + f"{_EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT round(sum(confidence) / count(*), 6) FROM edges) AS avg_confidence, (SELECT count(*) FROM ops WHERE kind = 'deploy') AS deploys, (SELECT count(*) FROM ops WHERE kind = 'remediation') AS remediations",
    "q_causal_chain": _W + f"{_EDGES}, {_chain(2, '3e-1')} SELECT start, CAST(sum(times) AS BIGINT) AS edges, round(sum(times * confidence) / sum(times) + 1e-9, 6) AS confidence FROM chain GROUP BY start",
    "q_graph_compare": _W + f"""{_EDGES}, {_chain(3, '25e-2')}, nodes AS (
        SELECT start, count(DISTINCT n) AS nodes FROM (SELECT start, src AS n FROM chain UNION ALL SELECT start, dst FROM chain UNION ALL SELECT start, start FROM starts) GROUP BY start
    ), one AS (SELECT n.start, nodes, count(c.src) AS edges, coalesce(list(DISTINCT c.relation) FILTER (c.relation IS NOT NULL), []) AS rel FROM nodes n LEFT JOIN chain c USING (start) GROUP BY ALL),
    sides AS (SELECT * FROM (SELECT start AS a, lead(start) OVER (ORDER BY start) AS b FROM starts) WHERE b IS NOT NULL)
    SELECT a, b, round(greatest(0e0, least(1e0, 35e-2 * least(x.nodes, y.nodes) / greatest(x.nodes, y.nodes) + CASE WHEN x.edges = 0 OR y.edges = 0 THEN 0e0 ELSE 35e-2 * least(x.edges, y.edges) / greatest(x.edges, y.edges)
        + 2e-1 * least(2e0 * x.edges / x.nodes, 2e0 * y.edges / y.nodes) / greatest(2e0 * x.edges / x.nodes, 2e0 * y.edges / y.nodes) END
        + 1e-1 * CASE WHEN greatest(len(x.rel), len(y.rel)) = 0 THEN 5e-1 ELSE len(list_intersect(x.rel, y.rel)) / greatest(len(x.rel), len(y.rel))::DOUBLE END)) + 1e-9, 6) AS score
    FROM sides JOIN one x ON x.start = a JOIN one y ON y.start = b""",
    "q_edge_decay_exp": _W + f"{_EDGES}, now AS (SELECT max(ts) AS now FROM ops) SELECT src, dst, round(CASE WHEN floor((now - last_seen) / 86400) >= 1 THEN greatest(1e-1, confidence * pow(99e-2, floor((now - last_seen) / 86400))) ELSE confidence END, 6) AS confidence FROM edges, now",
    "q_edge_decay_linear": _W + f"{_EDGES}, now AS (SELECT max(ts) AS now FROM ops) SELECT src, dst, round(greatest(1e-1, confidence - 1e-2 * abs(now - last_seen) / 86400), 6) AS confidence FROM edges, now",
    "q_reinforce": _W + f"{_REINFORCED} SELECT src, dst, times, round(least(95e-2, confidence + 5e-2 * times), 6) AS confidence FROM strong",
    "q_motif_memory": _W + f"{_OPS}, {_MEMORY} SELECT * FROM memory",
    "q_motif_stats": _W + f"{_OPS}, {_MEMORY} SELECT count(*) AS motifs, round(avg(confidence) + 1e-9, 3) AS mean, round(min(confidence) + 1e-9, 3) AS least, round(max(confidence) + 1e-9, 3) AS most, CAST(sum(successes) AS BIGINT) AS reinforcements, count(*) FILTER (confidence >= 0.9) AS strong, count(*) FILTER (confidence < 0.15) AS weak FROM memory",
    "q_motif_similarity": _W + f"{_SIMILAR} SELECT signal_id, motif_id, round(score + 1e-9, 6) AS score, rank FROM top WHERE rank <= 50",
    "q_fisher": _W + f"""{_OPS}, {_ABCD}, x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM t), w AS (
        SELECT kind, x = a AS own, lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) AS w FROM x)
    SELECT kind, p, round(CASE WHEN b * c > 0 THEN a * d / (b * c)::DOUBLE ELSE 'Infinity'::DOUBLE END + 1e-9, 6) AS odds FROM (SELECT kind, round(least(1e0, sum(exp(w)) FILTER (w <= o + 1e-7)), 6) AS p FROM w JOIN (SELECT kind, w AS o FROM w WHERE own) USING (kind) GROUP BY kind) JOIN t USING (kind)""",
    "q_smart_top5": _M + "SELECT signal_id, incident_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY CASE WHEN most >= 0.5 THEN 0 ELSE (f > 1)::INT END, similarity DESC, seq) AS rank FROM (SELECT *, max(similarity) OVER (PARTITION BY signal_id) AS most, row_number() OVER (PARTITION BY signal_id, tail ORDER BY similarity DESC, seq) AS f FROM m)) WHERE rank <= 5",
    "q_remediation_rank": _M + """, h AS (SELECT *, 'svc-' || signal_id % 50 AS cid FROM m WHERE action <> ''), rate AS (SELECT cid, action, avg((outcome = 'resolved')::INT) AS rate FROM h GROUP BY ALL), f AS (
        SELECT *, row_number() OVER (PARTITION BY signal_id, action ORDER BY similarity DESC, seq) AS n FROM h), g AS (
        SELECT *, similarity * rate AS confidence FROM f JOIN rate USING (cid, action) WHERE n = 1)
    SELECT signal_id, CASE WHEN action IN ('rollback', 'restart') THEN action || ' ' || cid ELSE action END AS action, round(rate, 6) AS rate, round(confidence + 1e-9, 6) AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY round(confidence + 1e-9, 3) DESC, similarity DESC, seq) AS rank FROM g) WHERE rank <= 3""",
    "q_family_ids": _M + "SELECT seq, family, CAST(tail AS INTEGER) AS number FROM m",
    "q_family_posterior": _M + "SELECT signal_id, family, round(mean, 6) AS mean, best, second, n, round(best - second, 6) AS margin, round(variance + 1e-9, 6) AS variance FROM post",
    "q_family_rank": _M + "SELECT signal_id, family, score FROM fam",
    "q_family_diversify": _M + """, fr AS (SELECT signal_id, family, row_number() OVER (PARTITION BY signal_id ORDER BY score DESC, family) AS fr FROM fam), f AS (
        SELECT *, row_number() OVER (PARTITION BY signal_id, family ORDER BY similarity DESC, seq) AS f FROM m)
    SELECT signal_id, incident_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY fr, f) AS rank FROM f JOIN fr USING (signal_id, family) WHERE f <= 2) WHERE rank <= 5""",
    "q_two_stage": _M + """, a AS (SELECT *, similarity >= 0.6 AND CASE WHEN incident_id NOT LIKE 'INC-%' THEN false WHEN seq % 4 = 0 THEN similarity >= 0.7 WHEN length(action) < 2 THEN similarity >= 0.75
        WHEN NOT (has_deploy AND has_metric AND has_trace_log) THEN similarity >= 0.75 ELSE true END AS a FROM m), n AS (SELECT *, count(*) FILTER (a) OVER (PARTITION BY signal_id) AS n FROM a)
    SELECT signal_id, incident_id, CASE WHEN a THEN 'A' ELSE 'B' END AS stage, rank FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY a DESC, similarity DESC, seq) AS rank FROM n WHERE a OR (similarity >= 0.5 AND n < 3)) WHERE rank <= 5""",
    "q_evidence_boost": _M + """, e AS (SELECT *, CASE WHEN has_deploy THEN 35e-2 ELSE 0e0 END + CASE WHEN has_metric THEN 35e-2 ELSE 0e0 END + CASE WHEN has_trace_log THEN 3e-1 ELSE 0e0 END AS ev FROM m), s AS (
        SELECT signal_id, incident_id, seq, round(ev, 2) AS evidence, round(CASE WHEN ev > 8e-1 THEN least(99e-2, similarity + 5e-2) WHEN ev < 4e-1 THEN greatest(0e0, similarity - 1e-1) ELSE similarity END, 6) AS similarity FROM e)
    SELECT signal_id, incident_id, similarity, evidence FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY similarity DESC, seq) AS rank FROM s) WHERE rank <= 5""",
    "q_decoy_policy": _W + f"""{_OPS}, e AS (SELECT signal_id, bool_or(kind = 'deploy') AS d, bool_or(kind = 'metric') AS m, bool_or(kind IN ('trace', 'log')) AS t FROM sig s JOIN (SELECT cid, ts, kind FROM ops) e ON e.cid = s.cid AND e.ts BETWEEN anchor - 86400 AND anchor GROUP BY signal_id)
    SELECT signal_id, d AS has_deploy, m AS has_metric, t AS has_trace_log, round((d::INT + m::INT + t::INT) / 3e0, 2) AS score, NOT (d AND m AND t) AS decoy, CASE WHEN NOT (d AND m AND t) THEN 'high' ELSE 'low' END AS risk,
        concat_ws(',', CASE WHEN NOT d THEN 'deploy' END, CASE WHEN NOT m THEN 'metric' END, CASE WHEN NOT t THEN 'trace_or_log' END) AS missing, CASE WHEN NOT (d AND m AND t) THEN 6e-1 ELSE 1e0 END AS multiplier, CASE WHEN NOT (d AND m AND t) THEN 45e-2 ELSE 1e0 END AS cap FROM e""",
    "q_action_posterior": _M + """, g AS (SELECT signal_id, action, count(*) FILTER (outcome = 'resolved') AS successes, count(*) AS total, avg(similarity) AS s FROM m WHERE action <> '' GROUP BY ALL HAVING count(*) >= 2), q AS (
        SELECT *, round(greatest(5e-2, least(99e-2, (4e-1 * successes / total + 6e-1 * (2 + successes) / (4 + total)) * least(1e0, total / 1e1) * s)) + 1e-9, 6) AS posterior FROM g)
    SELECT signal_id, action, successes, total, round(s, 6) AS similarity, posterior, CASE WHEN posterior >= 0.6 THEN 'resolved' ELSE 'uncertain' END AS label FROM q""",
    "q_contingency": _W + f"{_OPS}, {_ABCD} SELECT * FROM t",
    "q_chi_mi_effects": _W + f"""{_OPS}, {_ABCD} SELECT kind, round(chi + 1e-9, 6) AS chi, round(CASE WHEN a > 0 THEN a / n * log2(a * n / ((a + b) * (a + c))) + CASE WHEN b > 0 THEN b / n * log2(b * n / ((a + b) * (b + d))) ELSE 0 END + CASE WHEN c > 0 THEN c / n * log2(c * n / ((c + d) * (a + c))) ELSE 0 END
        + CASE WHEN d > 0 THEN d / n * log2(d * n / ((c + d) * (b + d))) ELSE 0 END ELSE 0 END + 1e-9, 6) AS mi, round(CASE WHEN a > 0 THEN log2(a * n / ((a + b) * (a + c))) ELSE 0 END + 1e-9, 6) AS pmi, round(a / (a + b)::DOUBLE + 1e-9, 6) AS p_incident_given_event, round(a / (a + c)::DOUBLE + 1e-9, 6) AS p_event_given_incident,
        round((a + b) / n + 1e-9, 6) AS p_event, round((a + c) / n + 1e-9, 6) AS p_incident, round(sqrt(chi / n) + 1e-9, 6) AS v, round(rr + 1e-9, 6) AS rr, round(CASE WHEN b > 0 AND c > 0 THEN a * d / (b * c)::DOUBLE WHEN a * d > 0 THEN 'Infinity'::DOUBLE ELSE 0 END + 1e-9, 6) AS odds FROM chi""",
    "q_confusion": _P + "SELECT family AS predicted, truth, count(*) AS n FROM p WHERE rank = 1 GROUP BY ALL",
    "q_contamination": _P + "SELECT truth, family, count(*) AS n FROM p WHERE truth IS NOT NULL AND family <> truth GROUP BY ALL",
    "q_false_positives": _P + "SELECT family, count(*) FILTER (truth IS NOT NULL AND family <> truth) AS wrong, count(*) FILTER (truth IS NULL AND similarity >= 0.5) AS decoys FROM p WHERE rank = 1 GROUP BY family",
    "q_substitutions": _P + "SELECT truth, family, count(*) AS n FROM p WHERE rank = 1 AND truth IS NOT NULL AND family <> truth GROUP BY ALL ORDER BY n DESC, truth, family LIMIT 10",
    "q_precision_by_family": _P + "SELECT truth, count(*) AS n, count(*) FILTER (first = truth) AS rank1, count(*) FILTER (hits > 0) AS found, round(avg(hits / least(5, n)::DOUBLE), 6) AS \"precision\", round(avg((hits > 0)::INT), 6) AS recall FROM b WHERE truth IS NOT NULL GROUP BY truth",
    "q_outcomes": _P + "SELECT CASE WHEN truth IS NULL THEN CASE WHEN similarity >= 0.5 THEN 'false_positive_decoy' ELSE 'correct_decoy_rejection' END WHEN first = truth THEN 'correct_rank1' ELSE 'wrong_rank1_recall_miss' END AS outcome, count(*) AS n FROM b GROUP BY 1",
    "q_loss_breakdown": _P + "SELECT category, count(*) AS n, round(sum(loss), 6) AS total, round(avg(loss), 6) AS mean FROM loss GROUP BY category",
    "q_loss_by_family": _P + ", e AS (SELECT truth, count(*) AS n FROM b GROUP BY truth), c AS (SELECT truth, category, count(*) AS c FROM loss GROUP BY ALL), l AS (SELECT truth, CAST(sum(c) AS BIGINT) AS lost, string_agg(category || '=' || c, ',' ORDER BY category) AS categories FROM c GROUP BY truth) SELECT e.truth, n, coalesce(lost, 0) AS lost, round(coalesce(lost, 0) / n::DOUBLE, 6) AS rate, coalesce(categories, '') AS categories FROM e LEFT JOIN l ON e.truth IS NOT DISTINCT FROM l.truth",
    "q_top_failures": _P + "SELECT incident_id, category, loss FROM loss ORDER BY loss DESC, incident_id LIMIT 20",
    "q_calibration": _P + ", c AS (SELECT count(*) FILTER (first <> truth AND similarity >= 0.5) AS sure_and_wrong, count(*) FILTER (first = truth AND similarity < 0.5) AS unsure_and_right, avg(similarity) FILTER (first = truth) AS r, avg(similarity) FILTER (first <> truth) AS w FROM b WHERE truth IS NOT NULL) SELECT sure_and_wrong, unsure_and_right, round(coalesce(r, 0), 6) AS mean_right, round(coalesce(w, 0), 6) AS mean_wrong, round(coalesce(r - w, 0), 6) AS separation FROM c",
    "q_decoy_analysis": _P + "SELECT count(*) AS decoys, count(*) FILTER (similarity >= 0.5) AS taken, round(count(*) FILTER (similarity >= 0.5) / count(*)::DOUBLE, 6) AS rate, round(avg(similarity) FILTER (similarity >= 0.5), 6) AS mean_taken, round(avg(similarity) FILTER (similarity < 0.5), 6) AS mean_rejected FROM b WHERE truth IS NULL",
    "q_seed_deltas": f"WITH {_RUNS} SELECT seed, delta, CASE WHEN delta > 0.01 THEN 'improved' WHEN delta < -0.01 THEN 'regressed' ELSE 'unchanged' END AS direction FROM (SELECT a.seed, round(b.score - a.score, 4) AS delta FROM s a JOIN s b ON a.seed = b.seed AND a.run = 'old' AND b.run = 'new')",
    "q_seed_variance": f"WITH {_RUNS} SELECT run, count(*) AS seeds, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS stdev, stddev_samp(score) < 0.05 AS stable FROM s GROUP BY run",
    "q_long_metrics": f"WITH {_RUNS} SELECT seed, run, unnest(['recall', 'precision', 'remediation', 'p95']) AS metric, round(unnest([recall, \"precision\", remediation, p95]), 4) AS value FROM r",
    "q_grid": "SELECT row_number() OVER (ORDER BY alpha, precise, wide) - 1 AS number, alpha, precise, wide FROM (SELECT unnest([1e-2, 5e-2, 1e-1]) AS alpha, precise, wide FROM (SELECT unnest([5e-1, 6e-1, 7e-1]) AS precise, wide FROM (SELECT unnest([3e-1, 4e-1, 5e-1]) AS wide)))",
    "q_param_importance": """WITH r AS (SELECT (o_orderkey % 3)::DOUBLE AS alpha, (o_custkey % 4)::DOUBLE AS precise, ((o_orderkey % 3) * 10 + o_orderkey * 7919 % 100)::DOUBLE AS score FROM orders), l AS (
        SELECT 'alpha' AS parameter, alpha AS value, avg(score) AS m FROM r GROUP BY ALL UNION ALL SELECT 'precise', precise, avg(score) FROM r GROUP BY ALL), v AS (SELECT parameter, round(var_pop(m), 8) AS variance FROM l GROUP BY parameter)
    SELECT parameter, variance, round(variance / (SELECT max(variance) FROM v), 6) AS importance FROM v""",
    "q_latency_p95": _W + f"""{_OPS}, r AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS i, count(*) OVER (PARTITION BY kind) AS n FROM ops WHERE value IS NOT NULL), q AS (
        SELECT kind, n, p, greatest(1, least(n - 1, p * (n + 1) // 100)) AS j FROM (SELECT DISTINCT kind, n, unnest([50, 95]) AS p FROM r)), v AS (
        SELECT q.kind, q.n, p, p * (q.n + 1) - j * 100 AS delta, max(value) FILTER (i = j) AS lo, max(value) FILTER (i = j + 1) AS hi, max(value) AS most FROM q JOIN r USING (kind) GROUP BY q.kind, q.n, p, j), x AS (
        SELECT kind, n, p, CASE WHEN n < 20 THEN most ELSE (lo * (100 - delta) + hi * delta) / 100 END AS q FROM v)
    SELECT kind, n, round(max(q) FILTER (p = 95) + 1e-9, 6) AS p95, round(max(q) FILTER (p = 50) + 1e-9, 6) AS median FROM x GROUP BY ALL""",
    "q_recent_tail": _W + f"{_OPS} SELECT event_id, kind FROM ops ORDER BY ts DESC, event_id DESC LIMIT 50",
    "q_edge_histogram": _W + f"{_EDGES} SELECT relation, least(20, CAST(floor(confidence * 20) AS BIGINT) + 1) AS bin, count(*) AS n FROM edges GROUP BY ALL",
    "q_family_outcomes": _M + ", a AS (SELECT family, action || '=' || count(*) AS x FROM m WHERE action <> '' GROUP BY family, action), b AS (SELECT family, string_agg(x, ',' ORDER BY x) AS actions FROM a GROUP BY family) SELECT family, count(*) AS total, round(avg((outcome = 'resolved')::INT), 6) AS rate, any_value(actions) AS actions FROM m LEFT JOIN b USING (family) GROUP BY family",
    "q_context_quality": _M + """, e AS (SELECT DISTINCT signal_id, incident_id FROM m WHERE similarity >= 0.5 AND outcome = 'resolved'), r AS (
        SELECT DISTINCT signal_id, incident_id FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY similarity DESC, seq) AS rank FROM m) WHERE rank <= 5), n AS (
        SELECT signal_id, count(*) FILTER (e.incident_id IS NOT NULL AND r.incident_id IS NOT NULL) AS hit, count(e.incident_id) AS ne, count(r.incident_id) AS nr FROM e FULL JOIN r USING (signal_id, incident_id) GROUP BY signal_id), q AS (
        SELECT signal_id, CASE WHEN nr > 0 THEN hit / nr::DOUBLE ELSE 0e0 END AS p, CASE WHEN ne > 0 THEN hit / ne::DOUBLE ELSE 0e0 END AS c FROM n)
    SELECT signal_id, round(p, 6) AS "precision", round(c, 6) AS recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0e0 END, 6) AS f1 FROM q""",
    "q_improvement": f"WITH {_RUNS} SELECT a.seed, round((b.recall - a.recall) / nullif(a.recall, 0) * 100, 2) AS percent FROM r a JOIN r b ON a.seed = b.seed AND a.run = 'old' AND b.run = 'new'",
    "q_ablation": """WITH r AS (SELECT o_orderpriority AS variant, round(avg(o_orderkey % 100) / 100, 6) AS recall, count(*) / 1e4 AS share FROM orders GROUP BY 1), l AS (
        SELECT variant, 'recall' AS metric, recall AS value FROM r UNION ALL SELECT variant, 'share', share FROM r), d AS (
        SELECT l.variant, l.metric, round(l.value - b.value, 4) AS delta FROM l JOIN l b ON b.metric = l.metric AND b.variant = '5-LOW' WHERE l.variant <> '5-LOW')
    SELECT *, delta > 0 AS improved, round(avg(abs(delta)) OVER (PARTITION BY variant), 6) AS magnitude FROM d""",
    "q_config_diff": """WITH a AS (SELECT s_name AS key, CASE WHEN s_suppkey % 7 = 1 THEN s_suppkey ELSE s_nationkey END AS value FROM supplier WHERE s_suppkey % 5 <> 1), b AS (
        SELECT s_name AS key, CASE WHEN s_suppkey % 7 = 2 THEN s_suppkey ELSE s_nationkey END AS value FROM supplier WHERE s_suppkey % 5 <> 2)
    SELECT key, a.value AS left_value, b.value AS right_value FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value""",
    "q_failure_stats": _P + """, x AS (SELECT b.*, expected IS NULL OR coalesce(action = expected, false) AS cured FROM b LEFT JOIN (SELECT incident_id, expected, action FROM rem) USING (incident_id)), c AS (
        SELECT count(*) AS incidents, count(*) FILTER ((truth IS NULL AND similarity < 0.5) OR (first = truth AND cured)) AS correct, count(*) FILTER (first <> truth) AS recall_miss,
            count(*) FILTER (first = truth AND NOT cured) AS remedy_mismatch, count(*) FILTER (truth IS NULL AND similarity >= 0.5) AS decoy_false_positive FROM x)
    SELECT *, recall_miss + remedy_mismatch + decoy_false_positive AS failures, round(correct / greatest(incidents, 1)::DOUBLE, 6) AS success_rate FROM c""",
    "q_remedy_mismatches": f"""WITH {_REMEDY} SELECT count(*) AS expected, count(action) AS suggested, count(*) FILTER (action = expected) AS exact, count(*) FILTER (action <> expected) AS wrong,
        count(*) FILTER (action IS NULL) AS missing, count(*) FILTER (action <> expected AND confidence >= 0.5) AS sure_and_wrong FROM rem WHERE expected IS NOT NULL""",
    "q_remedy_mismatches_by_family": f"WITH {_REMEDY} SELECT coalesce(truth::VARCHAR, 'decoy') AS family, count(*) FILTER (action <> expected) AS wrong, count(*) FILTER (action <> expected AND confidence >= 0.5) AS sure_and_wrong FROM rem WHERE expected IS NOT NULL GROUP BY 1",
    "q_run_summary": """WITH c AS (SELECT c_custkey % 4 <> 0 AS ok, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 50 END AS late, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 8) / 8 END AS sure FROM customer)
    SELECT round(count(*) FILTER (ok) / count(*)::DOUBLE, 4) AS pass_rate, round(avg(late), 2) AS latency_ms, round(avg(sure), 4) AS confidence, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM c""",
    "q_score_attribution": f"""WITH {_RUNS}, l AS (
        SELECT seed, unnest(['recall', 'precision', 'remediation', 'latency', 'manual_context', 'manual_explain']) AS metric, unnest([recall, "precision", remediation, least(1e0, 2000 / greatest(p95, 1e-6)), 0e0, 0e0]) AS value,
            unnest([3e-1, 15e-2, 2e-1, 15e-2, 1e-1, 1e-1]) AS weight FROM r WHERE run = 'new') SELECT seed, metric, weight, round(round(weight * value, 4), 3) AS contribution FROM l""",
    "q_sweep_scores": f"""WITH {_RUNS}, o AS (SELECT *, seed % 10 AS config, 5e-1 * recall + 3e-1 * "precision" + 15e-2 * remediation + 5e-2 * (1 - least(1e0, p95 / 2000)) AS own FROM r), g AS (
        SELECT config, avg(recall) AS recall, avg("precision") AS pr, avg(remediation) AS remediation, max(p95) AS p95, min(own) AS least, max(own) AS most FROM o GROUP BY config), q AS (
        SELECT config, round(recall + 1e-9, 4) AS recall, round(pr + 1e-9, 4) AS "precision", round(remediation + 1e-9, 4) AS remediation, round(5e-1 * recall + 3e-1 * pr + 15e-2 * remediation + 5e-2 * (1 - least(1e0, p95 / 2000)) + 1e-9, 4) AS score,
            round(least + 1e-9, 4) AS least, round(most + 1e-9, 4) AS most FROM g)
    SELECT *, row_number() OVER (ORDER BY score DESC, config) AS rank FROM q""",
    "q_representatives": _M + "SELECT signal_id, family, incident_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, family ORDER BY similarity DESC, seq) AS n FROM m) WHERE n = 1",
    "q_action_score": _M + """SELECT signal_id, CASE WHEN n < 2 THEN 0e0 ELSE round(greatest(5e-2, least(99e-2, (4e-1 * k / n + 6e-1 * (2 + k) / (4 + n)) * least(1e0, n / 1e1) * s)) + 1e-9, 6) END AS score FROM (
        SELECT signal_id, count(*) FILTER (action = 'restart') AS n, count(*) FILTER (action = 'restart' AND outcome = 'resolved') AS k, avg(similarity) FILTER (action = 'restart') AS s FROM m GROUP BY signal_id)""",
    "q_evidence_counts": _W + f"""{_OPS} SELECT signal_id, count(*) FILTER (kind = 'deploy') AS n_deploy, count(*) FILTER (kind = 'metric') AS n_metric, count(*) FILTER (kind = 'log') AS n_log, count(*) FILTER (kind = 'trace') AS n_trace,
        count(*) FILTER (kind = 'incident_signal') AS n_incident_signal, count(*) FILTER (kind = 'remediation') AS n_remediation FROM sig s JOIN (SELECT cid, ts, kind FROM ops) e ON e.cid = s.cid AND e.ts BETWEEN anchor - 86400 AND anchor GROUP BY signal_id""",
    "q_trace_as_of": _W + f"{_OPS}, {_ADAPTIVE} SELECT signal_id, count(*) AS n, count(*) FILTER (e_cid <> cid) AS n_other, max(event_id) AS last_event FROM traced WHERE (signal_id, event_id) NOT IN (SELECT (signal_id, event_id) FROM own) AND ts <= anchor GROUP BY signal_id",
    "q_lift_pruned": _W + f"""{_EDGES}, {_TOKENS}, {_ADAPTIVE}, {_RELATED}, {_LIFT}, k AS (SELECT r.*, coalesce(l.kept, false) AS ok, bool_or(coalesce(l.kept, false)) OVER (PARTITION BY r.signal_id) AS anyone FROM rel r LEFT JOIN lifts l USING (signal_id, token))
    SELECT signal_id, count(*) AS n_before, count(*) FILTER (ok OR NOT anyone) AS n, CAST(sum(event_id) FILTER (ok OR NOT anyone) AS BIGINT) AS id_sum FROM k GROUP BY signal_id""",
    "q_identity_events": _W + f"{_OPS} SELECT event_id, service, cid FROM ops",
    "q_rename_history": _W + f"{_OPS} SELECT cid, seq, old_name, new_name FROM ids",
    "q_role_canonical": _W + f"""{_OPS}, {_NAMES}, pin AS (SELECT DISTINCT substr(md5({_name('user_id', '0')}), 1, 8) AS cid FROM events WHERE user_id < 10)
    SELECT cid, CASE WHEN pin.cid IS NOT NULL THEN 'pinned' ELSE role.role END AS role FROM role FULL JOIN pin USING (cid)""",
    "q_asof_deploy_any": _W + f"{_OPS} SELECT e.event_id, (SELECT arg_max(d.event_id, (d.ts, -d.event_id)) FROM ops d WHERE d.cid = e.cid AND d.kind = 'deploy' AND d.ts <= e.ts) AS deploy_id FROM ops e WHERE kind <> 'deploy'",
    "q_stream_edges": _W + f'{_EDGES} SELECT src, dst, relation, "count", round(confidence, 6) AS confidence FROM edges',
    "q_edge_output": _W + f"""{_EDGES}, {_NAMES} SELECT src, dst, coalesce(a.name, src) AS cause, coalesce(b.name, dst) AS effect, relation, round(confidence, 3) AS confidence FROM edges LEFT JOIN now_name a ON a.cid = src LEFT JOIN now_name b ON b.cid = dst""",
    "q_edges_shown": _W + f"{_REINFORCED} SELECT src, dst, relation, times FROM strong WHERE least(95e-2, confidence + 5e-2 * times) >= 0.5 AND relation = 'upstream_call' AND times > 0",
    "q_chain_order": _W + f"{_SHAPES} SELECT start, src, dst, place, times FROM place WHERE place <= 3",
    "q_root_causes": _W + f"""{_ROOTS} SELECT f.start, f.cid, CAST(hops AS BIGINT) AS hops, round(confidence + 1e-9, 6) AS confidence, coalesce(s.n, 0) AS evidence_count, least(earliest, d.t) AS earliest, array_to_string(path, '>') AS path,
        row_number() OVER (PARTITION BY f.start ORDER BY round(confidence + 1e-9, 3) DESC, hops, f.cid) AS rank FROM found f LEFT JOIN seen s ON s.start = f.start AND s.cid = f.cid LEFT JOIN dep d ON d.cid = f.cid""",
    "q_edge_decay_out": _W + f"""{_EDGES}, now AS (SELECT max(ts) AS now FROM ops), d AS (SELECT src, dst, confidence, CASE WHEN src IN (SELECT cid FROM sig) THEN greatest(1e-1, confidence - 1e-2 * abs(now - last_seen) / 86400) ELSE confidence END AS c FROM edges, now)
    SELECT src, dst, round(c, 6) AS confidence, c <> confidence AS changed FROM d""",
    "q_reinforce_log": _W + f"""{_HITS}, h AS (SELECT hits.*, coalesce(sum(n) OVER (PARTITION BY src, dst ORDER BY ts, cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, confidence AS c FROM hits JOIN edges USING (src, dst))
    SELECT src, dst, count(*) AS n, round(min(least(95e-2, c + 5e-2 * b)), 6) AS first_old, round(max(least(95e-2, c + 5e-2 * (b + n))), 6) AS last_new, arg_max(cid, (ts, cid)) AS last_cid FROM h GROUP BY src, dst""",
    "q_deploy_state": _W + f"{_OPS} SELECT cid, count(*) AS deploys, max(ts) AS last, 'v' || arg_max(k, (ts, event_id)) AS version FROM ops WHERE kind = 'deploy' GROUP BY cid",
    "q_remediation_history": _W + f"{_OPS} SELECT cid, event_id, action, outcome FROM ops WHERE kind = 'remediation' AND cid IN (SELECT cid FROM sig)",
    "q_open_incidents": _W + f"{_OPS} SELECT cid, signal_id FROM sig s WHERE NOT EXISTS (SELECT 1 FROM ops r WHERE r.kind = 'remediation' AND r.cid = s.cid AND r.ts >= s.anchor)",
    "q_motif_decay": _W + f"""{_OPS}, {_MEMORY}, n AS (SELECT max(ts) AS now FROM ops), d AS (SELECT mem.id, memory.confidence, floor((now - created) / 86400) AS days FROM mem JOIN memory USING (id), n)
    SELECT id, round(CASE WHEN days >= 1 THEN greatest(1e-1, confidence * pow(99e-2, days)) ELSE confidence END + 1e-9, 6) AS confidence, days >= 1 AS moved FROM d""",
    "q_motif_upsert": _W + f"""{_OPS}, h AS (SELECT max(event_id) / 2 AS half FROM ops), r AS (SELECT ops.*, event_id <= half AS early FROM ops, h WHERE kind = 'remediation'), o AS (
        SELECT cid AS id, arg_max(action, (ts, event_id)) AS action, list_reduce(list_prepend(6e-1, list((outcome = 'resolved')::INT::DOUBLE ORDER BY ts, event_id)), lambda c, o: CASE WHEN o = 1 THEN least(95e-2, c + 1e-1) ELSE greatest(1e-1, c * 8e-1) END) AS c FROM r WHERE early GROUP BY cid
    ), n AS (SELECT cid AS id, arg_max(action, (ts, event_id)) AS action FROM r WHERE NOT early GROUP BY cid), b AS (SELECT id, coalesce(n.action, o.action) AS action, coalesce(c, 6e-1) AS c, o.id IS NULL AS came FROM o FULL JOIN n USING (id)
    ), k AS (SELECT *, count(*) FILTER (came) OVER () AS new, row_number() OVER (ORDER BY c DESC, id) AS rank FROM b) SELECT id, action, round(c, 6) AS confidence FROM k WHERE new = 0 OR (c >= 0.15 AND rank <= 100)""",
    "q_motif_extract": _W + f"{_SHAPES} SELECT start AS cid, array_to_string(ids, ',') AS ids, array_to_string(sequence, ',') AS sequence, md5(shape) AS shape, n, round(confidence + 1e-9, 6) AS confidence FROM shapes",
    "q_shape_similarity": _W + f"""{_SHAPES}, p AS (SELECT start AS a, kinds AS x, lead(start) OVER (ORDER BY start) AS b, lead(kinds) OVER (ORDER BY start) AS y FROM shapes)
    SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(x || y))::DOUBLE, 6) AS score FROM p WHERE b IS NOT NULL""",
    "q_motif_prune": _W + f"{_SIMILAR} SELECT id, action, confidence FROM stored",
    "q_similar_least": _W + f"""{_SIMILAR}, w AS (SELECT *, CAST(round_even(x * 100, 0) AS BIGINT) || '%' AS pct FROM (SELECT *, idj AS x FROM top WHERE rank <= 5 AND score >= 0.5))
    SELECT signal_id, motif_id, coalesce(nullif(concat_ws('; ', CASE WHEN idj > 0 THEN 'canonical ID overlap: ' || pct END, CASE WHEN idj > 0 AND len(list_intersect(qi, si)) > 0 THEN 'shared services: ' || array_to_string(list_sort(list_intersect(qi, si)), ', ') END,
        CASE WHEN seqj > 0 THEN 'shared event types: ' || array_to_string(list_sort(list_intersect(qs, ss)), ', ') END, CASE WHEN tokj > 0 THEN 'content similarity: ' || CAST(round_even(tokj * 100, 0) AS BIGINT) || '%' END), ''), 'low structural overlap') AS rationale FROM w""",
    "q_family_best": _M + """, f AS (SELECT *, row_number() OVER (PARTITION BY signal_id, family ORDER BY similarity DESC, seq) AS f FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY similarity DESC, seq) AS rank FROM f WHERE f = 1)
    SELECT signal_id, incident_id, similarity, rank FROM r WHERE rank <= 5""",
    "q_family_best_by_first": _M + """, f AS (SELECT *, row_number() OVER (PARTITION BY signal_id, family ORDER BY similarity DESC, seq) AS f, min(seq) OVER (PARTITION BY signal_id, family) AS lead FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY lead, f) AS rank FROM f WHERE f <= 2)
    SELECT signal_id, incident_id, rank FROM r WHERE rank <= 5""",
    "q_family_diversity": _M + "SELECT signal_id, count(DISTINCT family) AS families, count(*) AS n, round(count(DISTINCT family) / count(*)::DOUBLE, 6) AS diversity FROM m GROUP BY signal_id",
    "q_action_target": _M + """, g AS (SELECT signal_id, action, 'svc-' || seq % 3 AS target, count(*) AS n FROM m WHERE action <> '' GROUP BY ALL) SELECT signal_id, action, target FROM (
        SELECT *, sum(n) OVER (PARTITION BY signal_id, action) AS total, row_number() OVER (PARTITION BY signal_id, action ORDER BY n DESC, target) AS rank FROM g) WHERE rank = 1 AND total >= 2""",
    "q_decoy_suppressed": _M + "SELECT signal_id, seq, round(least(similarity, CASE WHEN signal_id % 3 = 0 THEN 45e-2 ELSE 1e0 END), 3) AS similarity, round(seq % 100 / 100 * CASE WHEN signal_id % 3 = 0 THEN 6e-1 ELSE 1e0 END + 1e-9, 3) AS confidence FROM m",
    "q_post_processed": _M + """, s AS (SELECT * EXCLUDE (similarity), round(least(similarity, CASE WHEN signal_id % 3 = 0 THEN 45e-2 ELSE 1e0 END), 3) AS similarity FROM m), a AS (SELECT *, similarity >= 0.6 AND CASE WHEN incident_id NOT LIKE 'INC-%' THEN false WHEN seq % 4 = 0 THEN similarity >= 0.7 WHEN length(action) < 2 THEN similarity >= 0.75
        WHEN NOT (has_deploy AND has_metric AND has_trace_log) THEN similarity >= 0.75 ELSE true END AS a FROM s), n AS (SELECT *, count(*) FILTER (a) OVER (PARTITION BY signal_id) AS n FROM a), two AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY a DESC, similarity DESC, seq) AS rk FROM n WHERE a OR (similarity >= 0.5 AND n < 3)) WHERE rk <= 5), f AS (SELECT *, row_number() OVER (PARTITION BY signal_id, family ORDER BY similarity DESC, seq) AS f FROM two)
    SELECT signal_id, incident_id, similarity, row_number() OVER (PARTITION BY signal_id ORDER BY similarity DESC, seq) AS rank FROM f WHERE f = 1""",
    "q_post_actions": _M + """, s AS (SELECT * EXCLUDE (similarity), round(least(similarity, CASE WHEN signal_id % 3 = 0 THEN 45e-2 ELSE 1e0 END), 3) AS similarity FROM m), a AS (SELECT *, similarity >= 0.6 AND CASE WHEN incident_id NOT LIKE 'INC-%' THEN false WHEN seq % 4 = 0 THEN similarity >= 0.7 WHEN length(action) < 2 THEN similarity >= 0.75
        WHEN NOT (has_deploy AND has_metric AND has_trace_log) THEN similarity >= 0.75 ELSE true END AS a FROM s), n AS (SELECT *, count(*) FILTER (a) OVER (PARTITION BY signal_id) AS n FROM a), two AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY a DESC, similarity DESC, seq) AS rk FROM n WHERE a OR (similarity >= 0.5 AND n < 3)) WHERE rk <= 5), g AS (SELECT signal_id, action, count(*) FILTER (outcome = 'resolved') AS k, count(*) AS n, avg(similarity) AS s FROM two WHERE action <> '' GROUP BY ALL HAVING count(*) >= 2), b AS (
        SELECT signal_id, action, round(greatest(5e-2, least(99e-2, (4e-1 * k / n + 6e-1 * (2 + k) / (4 + n)) * least(1e0, n / 1e1) * s)) + 1e-9, 6) AS confidence FROM g), fb AS (SELECT signal_id, min(action) AS action FROM m WHERE action <> '' GROUP BY signal_id)
    SELECT signal_id, action, round(confidence + 1e-9, 6) AS confidence FROM b UNION ALL SELECT signal_id, action, round(round(5e-1 * CASE WHEN signal_id % 3 = 0 THEN 6e-1 ELSE 1e0 END + 1e-9, 3) + 1e-9, 6) FROM fb WHERE signal_id NOT IN (SELECT signal_id FROM b)""",
    "q_assoc_measures": _W + f"""{_OPS}, {_ABCD} SELECT kind, round(CASE WHEN b * c > 0 THEN a * d / (b * c)::DOUBLE ELSE 'Infinity'::DOUBLE END + 1e-9, 6) AS odds_ratio, round(a / (a + b)::DOUBLE / greatest(c / (c + d)::DOUBLE, 1e-3) + 1e-9, 6) AS relative_risk, round(sqrt(chi / n) + 1e-9, 6) AS cramers_v, round(a / (a + b)::DOUBLE - c / (c + d)::DOUBLE + 1e-9, 6) AS risk_difference FROM chi""",
    "q_assoc_predictive": _W + f"{_OPS}, {_ABCD} SELECT kind, chi > 3.841458820694124 AND rr >= 1.5 AND a >= 1 AS predictive, a + c >= 5 AS enough FROM chi",
    "q_order_similarity": _W + f"""{_OPS}, m AS (SELECT trace_id, list(DISTINCT kind) AS kinds FROM ops GROUP BY trace_id) SELECT m.trace_id, round(len(list_intersect(m.kinds, o.kinds)) / greatest(len(m.kinds), len(o.kinds))::DOUBLE, 6) AS similarity FROM m JOIN m o ON o.trace_id = m.trace_id + 1""",
    "q_quality": _P + "SELECT count(*) AS incidents, round(avg((hits > 0)::INT), 6) AS recall, round(avg(hits / least(5, n)::DOUBLE), 6) AS \"precision\", round(avg(CASE WHEN expected IS NOT NULL THEN coalesce(action = expected, false)::INT END), 6) AS remediation FROM b LEFT JOIN (SELECT incident_id, expected, action FROM rem) USING (incident_id) WHERE truth IS NOT NULL",
    "q_ablation_extremes": """WITH r AS (SELECT o_orderpriority AS variant, round(avg(o_orderkey % 100) / 100, 6) AS recall, count(*) / 1e4 AS share FROM orders GROUP BY 1), l AS (
        SELECT variant, 'recall' AS metric, recall AS value FROM r UNION ALL SELECT variant, 'share', share FROM r), d AS (
        SELECT l.variant, l.metric, round(l.value - b.value, 4) AS delta FROM l JOIN l b ON b.metric = l.metric AND b.variant = '5-LOW' WHERE l.variant <> '5-LOW')
    SELECT arg_min(variant, (-delta, variant)) AS best, arg_min(variant, (delta, variant)) AS worst FROM d WHERE metric = 'recall'""",
}
