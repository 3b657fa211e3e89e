"""Mixing sources to target weights by a golden-ratio slot schedule over blocks of equally many words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, numbered, stored, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 2048
SEED = "17"
#: 2 ** 32 over the golden ratio, odd: i times it, modulo 2 ** 32, is the golden-ratio sequence in fixed point.
GOLDEN = 2654435769
CELL_BITS = 20
#: Documents of a source that one task numbers at a time; what a source's buckets begin with meets in one task, a row for each bucket.
BUCKET_ROWS = 1 << 16


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target): share of all words dealt by weight, at most cap times a source's words each.

    sizes has a row for each source. Sources by code point, null last, take the weights in turn. Filled in the order of cap over weight, all
    sources before the first one below its cap are full, and that one's level holds for the rest: what repeated resharing comes to.
    A row for each source meets in one task; that table has the size of the list of sources, not of the corpus.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w.cast("double")).withColumn("most", F.col("source_size") * float(cap))
    order = [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    fill = Window.orderBy(*order)
    everything = Window.partitionBy()
    t = t.withColumn("words", F.sum("source_size").over(everything) * share)
    t = t.withColumn("full", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("words") - F.col("full")) / F.col("rest"))
    t = t.withColumn("open", F.col("most") > F.col("weight") * F.col("level"))
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("most") / F.col("weight"))).over(everything)
    return t.withColumn("level", level).select("source", "source_size", "weight", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("most")).alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(source, block, slot): which slot of the mix takes which block of a source's endless stream.

    Slot i's point falls into a source's part of the cumulated quotas, and the source's j-th slot takes its block j. The sequence gives a
    source its quota of slots but for a few; surplus slots stay empty and missing ones follow at the end.
    """
    spark = targets.sparkSession
    t = targets.withColumn("quota", F.ceil(F.floor("target") / block))
    upto = F.sum("quota").over(Window.orderBy(F.col("source").isNull(), "source"))
    t = t.withColumn("upto", upto).withColumn("n", F.sum("quota").over(Window.partitionBy()))
    t = t.withColumn("hi", F.floor(F.col("upto") / F.col("n") * float(1 << 32))).withColumn("lo", F.floor((F.col("upto") - F.col("quota")) / F.col("n") * float(1 << 32)))
    t = t.where("quota > 0")
    n = t.agg(F.max("n")).first()[0] or 0
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.col("id").bitwiseAND(F.lit((1 << 32) - 1)) * GOLDEN).bitwiseAND(F.lit((1 << 32) - 1)).alias("x"))
    slots = slots.withColumn("cell", F.shiftright("x", CELL_BITS))
    cells = t.select("source", "quota", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell"))
    dealt = slots.join(cells, "cell").where("x >= lo and x < hi").select("slot", "source", "quota")
    dealt = numbered(dealt, ["source"], [F.col("slot")], F.shiftright("slot", 6 if n < 1 << 20 else 12), "block")
    had = dealt.groupBy("source").agg(F.count("*").alias("had"))
    short = t.alias("t").join(had.alias("h"), F.col("t.source").eqNullSafe(F.col("h.source")), "left").select("t.source", "quota", F.coalesce("had", F.lit(0)).alias("had")).where("had < quota")
    tail = short.select("source", F.explode(F.sequence(F.col("had").cast("long"), F.col("quota") - 1)).alias("block"))
    tail = tail.withColumn("slot", n - 1 + F.row_number().over(Window.orderBy("block", F.col("source").isNull(), "source")))
    return dealt.where("block < quota").select("source", "block", "slot").unionByName(tail)


def _twin() -> Column:
    """What tells rows without an id apart: a hash of the text; null for rows with an id."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("source").cast("string")))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK_WORDS, seed: str = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, stream) of documents (doc_id, text, source).

    rows: a row for each document (row, doc_id, twin, source, size), by a row number of its own, so that repeated and null ids stay apart.
    stream: (slot, block, row, start, length), the words of row that the slot takes; slots in order are the mix.
    A source's documents, shuffled by a hash of the id, form a stream that starts over at its end; its blocks of `block` words fill its slots
    and the last is cut at the target. Null or empty texts have no words and are in no slot; a null source is a source of its own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _twin().alias("twin"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = stored(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    n = sizes.agg(F.max("n")).first()[0] or 0
    targets = stored(source_targets(sizes.drop("n"), weights, share, cap), "mix-targets")
    digits = 2
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    keyed = rows.where("size > 0").withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("twin").cast("string"))))
    placed = numbered(keyed, ["source"], [F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")], F.substring("key", 1, digits), "at", F.col("size"))
    placed = placed.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.row", "p.source", "p.size", "p.at", "t.source_size", F.floor("t.target").alias("words"))
    placed = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("at", F.col("at") + F.col("pass") * F.col("source_size")).where("at < words")
    placed = placed.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("words")))
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    lo, hi = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    parts = parts.select("row", "source", "block", (lo - F.col("at")).alias("start"), (hi - lo).alias("length"))
    slots = schedule(targets, block)
    stream = parts.alias("p").join(slots.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block"))).select("s.slot", "p.block", "p.row", "p.start", "p.length")
    return rows, targets, stream


def mixed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, twin) for each row of docs; see mix(). Other columns of docs are not read."""
    rows, targets, stream = mix(docs)
    taken = stream.groupBy("row").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"))
    full = rows.alias("r").join(taken.alias("k"), "row", "left").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    return full.select("r.doc_id", "r.size", "t.source_size", "t.target", F.coalesce("k.taken", F.lit(0).cast("long")).alias("taken"), "k.first_slot", "r.twin")


def repeat_by_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, whole and in part: never, once or twice. Null and empty texts are never taken; an empty table
    gives an empty one.

    A row that repeats an id counts once; of rows without an id those of one text and source count once, the others are told apart.
    """
    twin, times, key = fresh(docs, "__twin", "__times", "__key")
    docs = docs.withColumn(twin, _twin()).dropDuplicates(["doc_id", twin])
    taken = mixed_documents(docs).where("taken > 0").select(F.col("doc_id").alias(key), F.col("twin").alias(f"{key}t"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times))
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(key)) & F.col(twin).eqNullSafe(F.col(f"{key}t")))
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times, twin, key, f"{key}t")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, with production parameters."""
    return mixed_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM s
), f AS (
    SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
    SELECT source, source_size, CASE WHEN most > weight * level THEN weight * (SELECT arg_min(level, most / weight) FROM f WHERE most > weight * level) ELSE most END AS target FROM f
), p AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d
)
SELECT doc_id, size, source_size, target,
    CAST(least(size, greatest(0, floor(target) - ahead)) + least(size, greatest(0, floor(target) - source_size - ahead)) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
