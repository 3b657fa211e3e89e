"""Column expressions over names, tokens and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles with the substrings that name them, in order; tokens that name no role.
ROLES = (
    ("checkout", ("checkout", "chk")),
    ("payment", ("payment", "payments", "pay", "billing", "bil")),
    ("database", ("database", "postgres", "mysql", "redis", "mongo", "dynamo", "db")),
    ("gateway", ("gateway", "edge", "router")),
    ("auth", ("auth", "oauth", "sso", "identity")),
    ("cache", ("cache", "memcache", "memcached")),
    ("inventory", ("inventory", "stock", "catalog")),
    ("notification", ("notification", "notify", "email", "sms")),
    ("search", ("search", "elastic", "solr")),
    ("order", ("order", "orders", "cart")),
    ("api", ("api",)),
)
GENERIC = ("svc", "service", "app", "application", "system", "platform", "worker", "node", "instance", "prod", "staging", "dev", "v1", "v2", "v3")
# Behavioural roles of event kinds and content tokens, in order.
BEHAVIOURS = (
    ("timeout", "ROLE:TIMEOUT_CALLER"),
    ("latency", "ROLE:LATENCY_PROVIDER"),
    ("error_rate", "ROLE:ERROR_RATE_SOURCE"),
    ("error", "ROLE:ERROR_SOURCE"),
    ("rollback", "ROLE:DEPLOY_ROLLBACK"),
    ("deploy", "ROLE:DEPLOY_TRIGGER"),
    ("remediation", "ROLE:REMEDIATION_ACTION"),
    ("trace", "ROLE:CALL_CHAIN"),
    ("incident_signal", "ROLE:ALERT_TRIGGER"),
)
# Labels of relations by substring, in order.
EVENT_TYPES = (
    (("deploy",), "DEPLOY"),
    (("metric", "spike"), "METRIC_SPIKE"),
    (("error", "log"), "ERROR_BURST"),
    (("upstream", "call"), "UPSTREAM_FAILURE"),
    (("latency",), "LATENCY_SPIKE"),
    (("trace",), "TRACE_ERROR"),
)
RELATION_ROLES = (
    (("deploy",), "DEPLOY"),
    (("metric", "latency", "spike"), "METRIC_ANOMALY"),
    (("log", "error"), "ERROR_LOG"),
    (("trace", "upstream", "call"), "UPSTREAM_CALL"),
    (("incident",), "INCIDENT"),
    (("remediation", "rollback", "restart"), "REMEDIATION"),
)


def _first_of(text: Column, rules, otherwise: Column) -> Column:
    """The label of the first rule of which a keyword is in text."""
    out = F
    for words, label in rules:
        hit = F.lit(False)
        for w in (words,) if isinstance(words, str) else words:
            hit = hit | F.contains(text, F.lit(w))
        out = out.when(hit, F.lit(label))
    return out.otherwise(otherwise)


def infer_role(name: Column) -> Column:
    """The semantic role that a service name gives away; else its first telling token of three letters, else `service`."""
    low = F.lower(F.coalesce(name, F.lit("")))
    tokens = F.filter(F.split(low, "[-_.]+"), lambda t: t != "")
    text = F.concat_ws(" ", F.array_join(tokens, " "), low)
    telling = F.filter(tokens, lambda t: ~t.isin(*GENERIC) & ~t.rlike("^[0-9]+$") & (F.length(t) >= 3))
    return _first_of(text, [(words, role) for role, words in ROLES], F.coalesce(F.try_element_at(telling, F.lit(1)), F.lit("service")))


def event_type_of(relation: Column) -> Column:
    relation = F.coalesce(F.nullif(relation, F.lit("")), F.lit("UNKNOWN"))
    return _first_of(F.lower(relation), EVENT_TYPES, F.upper(relation))


def relation_role(relation: Column) -> Column:
    return _first_of(F.lower(relation), RELATION_ROLES, F.lit("SIGNAL"))


def behaviour_of(token: Column) -> Column:
    return _first_of(F.lower(F.coalesce(token, F.lit(""))), BEHAVIOURS, F.lit("ROLE:OTHER"))


def service_id(name: Column) -> Column:
    """A stable id of a name's first sight."""
    return F.substring(F.md5(name), 1, 8)


def event_token(kind: Column, metric: Column, message: Column) -> Column:
    """metric:<name>, log:timeout, log:error or log:other, else the kind."""
    low = F.lower(F.coalesce(message, F.lit("")))
    log = F.when(F.contains(low, F.lit("timeout")), "log:timeout").when(F.contains(low, F.lit("error")), "log:error").otherwise("log:other")
    return F.when(kind == "metric", F.concat(F.lit("metric:"), F.coalesce(metric, F.lit("")))).when(kind == "log", log).otherwise(kind)


def family_of(incident_id: Column) -> Column:
    """After the INC- prefix the last part, `unknown` if empty; other ids are their own family."""
    suffix = F.substring_index(incident_id, "-", -1)
    return F.when(incident_id.startswith("INC-"), F.when(suffix == "", "unknown").otherwise(suffix)).otherwise(incident_id)


def family_number(incident_id: Column) -> Column:
    return F.substring_index(incident_id, "-", -1).try_cast("int")


def action_label(action: Column, service: Column) -> Column:
    """rollback and restart name their service."""
    bare = action.startswith("rollback") | action.startswith("restart")
    return F.when(bare & ~F.contains(action, service), F.concat_ws(" ", action, service)).otherwise(action)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones, 0 if one is."""
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(share)


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves to the even one."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def content_words(kind: Column, message: Column, metric: Column, version: Column) -> Column:
    """What an event says: the words of more than three letters of a log's message, lower-cased, a metric's name, a deploy's version."""
    words = F.filter(F.split(F.lower(F.coalesce(message, F.lit(""))), r"\s+"), lambda w: F.length(w) > 3)
    one = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.when(kind == "log", words).when(kind == "metric", one(metric)).when(kind == "deploy", one(version)).otherwise(F.array().cast("array<string>"))


def without_repeats(values: Column) -> Column:
    """Equal neighbours once."""
    return F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))
