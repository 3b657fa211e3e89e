"""Around a signal: which related events tell something, what they say, and how sure the whole is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import percent

#: Seconds: near the signal, and the background before it.
NEAR, BACK_FROM, BACK_TO = 60, 600, 120
LIFT = 2.0
ALWAYS = ("incident_signal", "deploy", "trace")


def token_counts(related: DataFrame, scale: float = 1.0, by: list[str] | None = None, *more: Column) -> DataFrame:
    """(signal_id, token, near, back) of related events (signal_id, anchor, ts, token): how many are near the signal and in the background before
    it. Events of unknown time count in neither."""
    ago = F.col("anchor") - F.col("ts")
    near, back = ago.between(0, NEAR * scale), ago.between(BACK_TO * scale, BACK_FROM * scale)
    return related.groupBy(*(by or ["signal_id", "token"])).agg(F.count_if(near).alias("near"), F.count_if(back).alias("back"), *more)


def lifted(counts: DataFrame) -> DataFrame:
    """(signal_id, token, near, back, near_all, back_all, lift, kept) of token_counts(): shares of a token near the signal and in the background."""
    whole = Window.partitionBy("signal_id")
    c = counts.withColumn("near_all", F.sum("near").over(whole)).withColumn("back_all", F.sum("back").over(whole))
    share = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    c = c.withColumn("lift", F.round(share(F.col("near"), F.col("near_all")) / F.greatest(F.lit(0.01), share(F.col("back"), F.col("back_all"))), 6))
    return c.withColumn("kept", (F.col("near") > 0) & ((F.col("lift") >= LIFT) | F.col("token").isin(*ALWAYS)))


def token_lift(related: DataFrame, scale: float = 1.0) -> DataFrame:
    """lifted() of related events (signal_id, anchor, ts, token)."""
    return lifted(token_counts(related, scale))


def lift_pruned(related: DataFrame, lifts: DataFrame) -> DataFrame:
    """related (signal_id, token, ...) with kept tokens only; a signal of which nothing would be left keeps all."""
    r = related.join(lifts.where("kept").select("signal_id", "token", F.lit(True).alias("ok")), ["signal_id", "token"], "left")
    any_ok = F.max(F.coalesce(F.col("ok"), F.lit(False))).over(Window.partitionBy("signal_id"))
    return r.withColumn("any_ok", any_ok).where("ok or not any_ok").drop("ok", "any_ok")


def content_tokens(related: DataFrame, most: int = 20) -> DataFrame:
    """(signal_id, tokens): distinct words of the related events, sorted, the first `most`; related has (signal_id, words array). A signal whose
    events say nothing has an empty array."""
    said = related.select("signal_id", F.explode_outer("words").alias("word")).distinct()
    rank = F.row_number().over(Window.partitionBy("signal_id").orderBy(F.col("word").asc_nulls_last()))
    return said.withColumn("n", rank).where(F.col("n") <= most).groupBy("signal_id").agg(F.array_sort(F.collect_list("word")).alias("tokens"))


def confidence(chain: DataFrame, roots: DataFrame) -> DataFrame:
    """(start, confidence): the chain's mean plus 0.15 of the mean of the two surest root causes, 0.99 at most."""
    top = roots.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("confidence"), "hops", "cid"))).where("n <= 2")
    boost = top.groupBy("start").agg((F.avg("confidence") * 0.15).alias("boost"))
    return chain.join(boost, "start", "left").select("start", F.least(F.lit(0.99), F.col("confidence") + F.coalesce("boost", F.lit(0.0))).alias("confidence"))


# The sentences of an explanation and the headings of a narrative.
def explanation(service, cid, anchor, related, root, root_confidence, best, similarity, action, rate):
    """The template text of a context, from columns; parts whose columns are null are left out."""
    return F.concat_ws(
        " ",
        F.format_string("Incident detected on %s (canonical ID: %s) at %s. %d related events found.", service, cid, anchor, related),
        F.when(root.isNotNull(), F.concat(F.lit("Root cause: "), root, F.lit(" (confidence "), percent(root_confidence), F.lit(")."))),
        F.when(best.isNotNull(), F.concat(F.lit("Matches past incident "), best, F.lit(" (sim="), percent(similarity), F.lit(")."))),
        F.when(action.isNotNull(), F.concat(F.lit("Suggested remediation: "), action, F.lit(" (historical success rate: "), percent(rate), F.lit(")."))).otherwise("No remediation history."),
    )


def sureness(confidence: Column) -> Column:
    """A confidence in a word."""
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.70, "moderate").otherwise("low")


def narrative(title, summary, events, chain, root, similar, action, confidence) -> Column:
    """A report of eight sections from columns; a section without anything to say says so."""
    said = [("Incident", title), ("Summary", summary), ("Related events", events), ("Causal chain", chain), ("Root cause", root), ("Similar incidents", similar), ("Suggested remediation", action)]
    parts = [F.concat(F.lit(f"## {head}\n"), F.coalesce(body.cast("string"), F.lit("unknown"))) for head, body in said]
    sure = F.concat(F.lit("## Confidence\n"), percent(confidence), F.lit(" ("), sureness(confidence), F.lit(")"))
    return F.concat_ws("\n", *parts, sure)


def explained(row: dict, ask=None, seconds: float = 6.0) -> str:
    """The template text of a context row, or what `ask(prompt)` says of it within `seconds`; any failure falls back to the template."""
    text = row["explanation"]
    if ask is None:
        return text
    from concurrent.futures import ThreadPoolExecutor

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(ask, f"Explain this incident to the engineer on call.\n{text}").result(seconds) or text
    except Exception:  # no answer, or none in time
        return text
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
