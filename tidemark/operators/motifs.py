"""Memory of past incidents: similarity of motifs, ranking, and how confidence evolves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import behaviour_of, jaccard, percent, without_repeats

from .graph import decay_exponential, neighbours, ordered_chain

START, GAIN, CAP, LOSS, FLOOR, DROP, KEEP = 0.6, 0.10, 0.95, 0.8, 0.1, 0.15, 100


def extracted(chain: DataFrame, roles: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, ids, sequence, shape, confidence) of each start's causal chain: what stays of it when its services are renamed.

    shape has (source role, relation, destination role) of the chain's edges in order, as often as the chain has them; sequence the roles in
    the order of their first appearance; ids the chain's services, the start and its neighbours by any edge. roles has (cid, role); services
    that it lacks are `service`. A start without a chain has its neighbourhood alone and a confidence of 0.
    """
    role = lambda side: F.coalesce(f"{side}_role", F.lit("service"))
    c = ordered_chain(chain)
    for side in ("src", "dst"):
        c = c.join(roles.select(F.col("cid").alias(side), F.col("role").alias(f"{side}_role")), side, "left")
    triple = F.struct(role("src").alias("src"), F.col("relation"), role("dst").alias("dst"))
    at = F.array_sort(F.collect_list(F.struct("place", "times", triple.alias("t"), "src", "dst")))
    c = c.groupBy("start").agg(at.alias("e"), (F.sum(F.col("times") * F.col("confidence")) / F.sum("times")).alias("confidence"))
    near = neighbours(edges).groupBy(F.col("cid").alias("start")).agg(F.collect_set("near").alias("near"))
    none = F.array().cast("array<string>")
    shape = F.flatten(F.transform("e", lambda x: F.array_repeat(x["t"], x["times"].cast("int"))))
    sequence = F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x["t"]["src"], x["t"]["dst"]))))
    ids = F.array_sort(F.array_distinct(F.concat(F.transform("e", lambda x: x["src"]), F.transform("e", lambda x: x["dst"]), F.array("start"), F.coalesce("near", none))))
    out = c.join(near, "start", "left").select("start", ids.alias("ids"), sequence.alias("sequence"), shape.alias("shape"), "confidence")
    return out


def shape_similarity(x: Column, y: Column) -> Column:
    """Jaccard of two shapes as sets of triples."""
    return jaccard(F.array_distinct(x), F.array_distinct(y))


def fingerprint(sequence: Column, tokens: Column) -> Column:
    """Behavioural roles of a motif's events and tokens, equal neighbours once."""
    return without_repeats(F.transform(F.concat(sequence, tokens), behaviour_of))


def base_similarity(q: str, s: str) -> tuple[Column, Column]:
    """(score, rationale) of motif columns with prefixes q and s: ids, sequence, tokens, action; an action mismatch quarters the score."""
    ids, seq = jaccard(F.col(f"{q}ids"), F.col(f"{s}ids")), jaccard(F.col(f"{q}sequence"), F.col(f"{s}sequence"))
    both = (F.size(f"{q}tokens") > 0) & (F.size(f"{s}tokens") > 0)
    tok = F.when(both, jaccard(F.col(f"{q}tokens"), F.col(f"{s}tokens"))).otherwise(0.0)
    a, b = F.coalesce(f"{q}action", F.lit("")), F.coalesce(f"{s}action", F.lit(""))
    differ = (a != "") & (b != "") & (a != b)
    score = (0.85 * ids + 0.10 * seq + 0.05 * tok) * F.when(differ, 0.25).otherwise(1.0)
    shared = lambda name: F.array_join(F.array_sort(F.array_intersect(f"{q}{name}", f"{s}{name}")), ", ")
    said = F.concat_ws(
        "; ",
        F.when(ids > 0, F.concat(F.lit("canonical ID overlap: "), percent(ids))),
        F.when((ids > 0) & (F.size(F.array_intersect(f"{q}ids", f"{s}ids")) > 0), F.concat(F.lit("shared services: "), shared("ids"))),
        F.when(seq > 0, F.concat(F.lit("shared event types: "), shared("sequence"))),
        F.when(tok > 0, F.concat(F.lit("content similarity: "), percent(tok))),
        F.when(differ, F.concat(F.lit("remediation mismatch (×0.25): "), a, F.lit(" vs "), b)),
    )
    return score, F.when(said == "", "low structural overlap").otherwise(said)


def role_similarity(x: Column, y: Column) -> Column:
    """Of two fingerprints, as sets; 0 if one is empty."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def find_similar(queries: DataFrame, memory: DataFrame, top: int = 50, least: float = 0.0, exclude_self: bool = False) -> DataFrame:
    """Each query's `top` motifs by 0.6 role + 0.4 base similarity, then those of `least`; memory holds KEEP motifs at most, so it is broadcast.

    Ids and sequences are compared once for each different pair of them among the queries, fingerprints are made once for each motif, and the
    rationale for the pairs that are left. With exclude_self a query does not match the motif of its own id.
    """
    sides = []
    for df, p in ((queries, "q_"), (memory.limit(KEEP), "s_")):
        df = df.withColumn("roles", F.array_distinct(fingerprint(F.col("sequence"), F.col("tokens"))))
        sides.append(df.select([F.col(c).alias(f"{p}{c}") for c in df.columns]))
    q, s = sides[0].withColumn("q_shape", F.md5(F.to_json(F.struct("q_ids", "q_sequence")))), F.broadcast(sides[1])
    shapes = q.select("q_shape", "q_ids", "q_sequence").dropDuplicates(["q_shape"]).crossJoin(s.select("s_id", "s_ids", "s_sequence"))
    shapes = shapes.select("q_shape", "s_id", (0.85 * jaccard(F.col("q_ids"), F.col("s_ids")) + 0.10 * jaccard(F.col("q_sequence"), F.col("s_sequence"))).alias("shape"))
    shapes = shapes.groupBy("q_shape").agg(F.map_from_entries(F.collect_list(F.struct("s_id", "shape"))).alias("by"))
    pairs = q.drop("q_ids", "q_sequence").crossJoin(s.drop("s_ids", "s_sequence"))
    if exclude_self:
        pairs = pairs.where(~F.col("q_id").eqNullSafe(F.col("s_id")))
    pairs = pairs.join(shapes, "q_shape").withColumn("base", F.try_element_at("by", F.col("s_id"))).drop("by")
    both = (F.size("q_tokens") > 0) & (F.size("s_tokens") > 0)
    base = F.col("base") + 0.05 * F.when(both, jaccard(F.col("q_tokens"), F.col("s_tokens"))).otherwise(0.0)
    a, b = F.coalesce("q_action", F.lit("")), F.coalesce("s_action", F.lit(""))
    base = base * F.when((a != "") & (b != "") & (a != b), 0.25).otherwise(1.0)
    pairs = pairs.withColumn("score", 0.6 * role_similarity(F.col("q_roles"), F.col("s_roles")) + 0.4 * base).drop("base")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "s_id"))
    best = pairs.withColumn("rank", rank).where((F.col("rank") <= top) & (F.col("score") >= least))
    return best.join(F.broadcast(sides[1].select("s_id", "s_ids", "s_sequence")), "s_id")


def with_rationale(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Matches of find_similar() with the text that says why, made for the rows that are left of them."""
    q = queries.select(F.col("id").alias("q_id"), F.col("ids").alias("q_ids"), F.col("sequence").alias("q_sequence"))
    return found.join(q, "q_id").withColumn("rationale", base_similarity("q_", "s_")[1])


def kept_motifs(motifs: DataFrame) -> DataFrame:
    """The KEEP motifs of most confidence, none below DROP; of equals the smaller id."""
    return motifs.where(F.col("confidence") >= DROP).orderBy(F.desc("confidence"), "id").limit(KEEP)


def evolved(outcomes: DataFrame) -> DataFrame:
    """(id, confidence, successes, failures) of motifs after their outcomes (id, at, seq, success) in order, from START.

    A success adds GAIN up to CAP, a failure multiplies by LOSS down to FLOOR. The fold runs over one motif's sorted outcomes.
    """
    at = F.array_sort(F.collect_list(F.struct("at", "seq", "success")))
    step = lambda c, o: F.when(o["success"], F.least(F.lit(CAP), c + GAIN)).otherwise(F.greatest(F.lit(FLOOR), c * LOSS))
    rows = outcomes.groupBy("id").agg(at.alias("o"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))
    return rows.select("id", F.aggregate("o", F.lit(START), step).alias("confidence"), "successes", "failures")


def decayed(motifs: DataFrame, now: Column) -> DataFrame:
    """motifs (confidence, created, decay_ref) after a decay at `now`: 0.99 for each full day since the last decay, else since creation, FLOOR at least.
    The reference time moves to `now` where a day had passed, and parts of days before it are lost."""
    ref = F.coalesce("decay_ref", "created")
    new = decay_exponential(F.col("confidence"), ref, now)
    return motifs.withColumn("confidence", new).withColumn("decay_ref", F.when(now - ref >= 86400, now).otherwise(F.col("decay_ref")))


def upserted(memory: DataFrame, new: DataFrame) -> DataFrame:
    """memory (id, created, confidence, decay_ref, ...) with new motifs (id, created, ...): one of a known id replaces the motif and its time and keeps
    confidence and decay; others begin at START. The memory is pruned if a new id came."""
    state = ["confidence", "decay_ref"]
    rest = [c for c in memory.columns if c not in ("id", *state)]
    n = new.select("id", *[F.col(c).alias(f"new_{c}") for c in rest], F.lit(True).alias("fresh"))
    both = memory.withColumn("old", F.lit(True)).join(n, "id", "full")
    fields = [F.when(F.col("fresh"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in rest]
    out = both.select("id", *fields, F.coalesce("confidence", F.lit(START)).alias("confidence"), "decay_ref", F.coalesce("old", F.lit(False)).alias("old"))
    grew = out.agg(F.count_if(~F.col("old")).alias("came"))
    rank = F.row_number().over(Window.orderBy(F.desc("confidence"), "id"))  # a memory holds KEEP motifs and what one batch brings
    out = out.crossJoin(F.broadcast(grew)).withColumn("rank", rank)
    return out.where((F.col("came") == 0) | ((F.col("confidence") >= DROP) & (F.col("rank") <= KEEP))).select(memory.columns)


def memory_stats(motifs: DataFrame) -> DataFrame:
    """One row over (confidence, successes): counts, extremes and mean to three decimals, 0 for an empty memory."""
    c = F.col("confidence")
    r = lambda x: F.round(F.coalesce(x, F.lit(0.0)) + 1e-9, 3)
    return motifs.agg(F.count("*").alias("motifs"), r(F.avg(c)).alias("mean"), r(F.min(c)).alias("least"), r(F.max(c)).alias("most"), F.coalesce(F.sum("successes"), F.lit(0).cast("long")).alias("reinforcements"), F.count_if(c >= 0.9).alias("strong"), F.count_if(c < DROP).alias("weak"))
