"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

TOP = 5
#: Rows of the fit, at most; everything else covers every row.
SAMPLE = 8000
#: Rows that a partition should have, and partitions at most.
PART_ROWS = 800
PARTS = 256
NEIGHBOURS = 10
#: Share of the sample's own neighbours that routing must reach before it is used.
REACH = 0.975
#: Rows of an index block and queries of a query block: what one task multiplies at a time.
BLOCK = 4096
QUERY_BLOCK = 8192


class Router:
    """A two-layer classifier from a unit vector to its partition, and how many partitions a query visits."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, visits: int = 1):
        self.w1, self.b1, self.w2, self.b2, self.visits = w1, b1, w2, b2, visits

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest rows of each row of unit vectors, by blocks of rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 4, slack: float = 1.15) -> np.ndarray:
    """A part for each row, none above `slack` times the mean: seeds grow to the nearest rows, then rows move to where most neighbours are."""
    room = int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(6):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
    s = x @ centres.T
    part, size = np.full(len(x), -1), np.zeros(parts, dtype=np.int64)
    for i in np.argsort(-s.max(axis=1), kind="stable"):
        for p in np.argsort(-s[i], kind="stable"):
            if size[p] < room:
                part[i] = p
                size[p] += 1
                break
    linked = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            linked[i].append(j)
            linked[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[linked[i]], minlength=parts)
            votes = np.where((size < room) | (np.arange(parts) == part[i]), votes, -1)
            best = int(np.argmax(votes))
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, parts: int, seed: int = 7, hidden: int = 128, epochs: int = 40) -> Router:
    """Partition the neighbour graph of x (unit rows), train the classifier on it, and set how many parts reach enough neighbours."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if parts <= 1 or len(x) <= parts:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x)
    part = balanced_partition(x, graph, parts, rng)
    net = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)) * 3, np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    moment, spread, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    held = rng.random(len(x)) < 0.1
    train = np.flatnonzero(~held)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
            h = np.maximum(x[rows] @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(rows)), part[rows]] -= 1
            z /= len(rows)
            back = (z @ net[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ z, z.sum(axis=0))):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                spread[i] = 0.999 * spread[i] + 0.001 * g * g
                net[i] = net[i] - 0.003 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(spread[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(*net)
    s = router.scores(x)
    home = np.argmax(s, axis=1)
    tries = np.flatnonzero(held)
    rank = np.empty((len(tries), parts), dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-s[tries], axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, home[graph[tries][:, :TOP]], axis=1).ravel())
    router.visits = int(needed[min(len(needed) - 1, int(np.ceil(REACH * len(needed))))]) + 1 if len(needed) else parts
    return router


def _unit(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().cast(pa.float64()))
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def search(vectors: DataFrame, is_query, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `is_query` holds its `top` nearest other rows found, by cosine.

    Every row is indexed, in the partition that the classifier finds most probable. A query visits the `visits` most probable partitions and
    is reranked there against all vectors, as they are, in double precision. Equal vectors are indexed once with their smallest ids, which is all
    that ties leave to be found. Null ids and null, zero or non-finite vectors take no part; vectors of different lengths have no cosine, so there
    is a search for each length. A vec_id that repeats is one row when a query leaves out its own; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = vectors.withColumn("query", is_query).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "query").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    x = x.where(finite).where(norm > 0)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = sorted(r[0] for r in x.select(F.size("embedding")).distinct().collect())  # a table of embeddings has one or a few
    for length in lengths:
        out = out.unionByName(_search(x.where(F.size("embedding") == length), top, sample))
    return out


def _search(x: DataFrame, top: int, sample: int) -> DataFrame:
    """search() over (vec_id, embedding, query) of one length."""
    spark = x.sparkSession
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = x.select("vec_id", "embedding").dropDuplicates(["vec_id", "embedding"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1)
    index = stored(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("node")), "ann-vectors")
    asked = x.where("query").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asked = stored(asked.join(index.select("embedding", "node"), "embedding").select("query_id", "node"), "ann-queries")
    rows = index.count()
    chosen = index.select("node").orderBy(F.xxhash64("node"), "node").limit(sample)
    fit = index.join(F.broadcast(chosen), "node", "left_semi").orderBy("node").select("embedding").toPandas()
    unit = np.array(fit["embedding"].tolist(), dtype=np.float64)
    router = fit_router(unit / np.linalg.norm(unit, axis=1, keepdims=True), min(PARTS, rows // PART_ROWS, len(fit) // 20))
    shared = spark.sparkContext.broadcast(router)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.argmax(shared.value.scores(_unit(b.column("embedding"))), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], names=[*b.schema.names, "part"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            s = r.scores(_unit(b.column("embedding")))
            best = np.argpartition(-s, r.visits - 1, axis=1)[:, : r.visits] if r.visits < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "parts"])

    homed = stored(index.mapInArrow(home, "embedding array<double>, ids array<long>, node long, part int"), "ann-index")
    sizes = homed.groupBy("part").count().select("part", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    left = homed.join(F.broadcast(sizes), "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    q = index.join(asked.select("node").distinct(), "node", "left_semi").select("node", "embedding").mapInArrow(visited, "node long, embedding array<double>, parts array<int>")
    q = q.select("node", "embedding", F.explode("parts").alias("part"))
    deals = q.groupBy("part").count().select("part", F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("deals"))
    q = q.join(F.broadcast(deals.join(F.broadcast(sizes), "part")), "part").withColumn("deal", F.pmod(F.xxhash64("node", F.lit(1)), F.col("deals")).cast("int"))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "embedding", "part", "block", "deal")
    left = left.join(F.broadcast(deals), "part").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")

    def rerank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            a = a.sort_values("node")
            xs = np.array(a["embedding"].tolist(), dtype=np.float64)
            xn, ids = np.linalg.norm(xs, axis=1), a["ids"].tolist()
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo : lo + 1024]
                qs = np.array(part["embedding"].tolist(), dtype=np.float64)
                s = (qs @ xs.T) / (np.linalg.norm(qs, axis=1)[:, None] * xn[None, :])
                k = min(top + 1, s.shape[1])
                floor = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                for node, row, least in zip(part["node"].tolist(), s, floor.tolist()):
                    at = np.flatnonzero(row >= least)
                    at = at[np.argsort(-row[at], kind="stable")][:k]
                    out += [(node, ids[j].tolist(), float(row[j])) for j in at.tolist()]
        return pd.DataFrame(out, columns=["q", "ids", "score"])

    keys = ["part", "block", "deal"]
    found = q.groupBy(*keys)
    found = left.groupBy(*keys).cogroup(found).applyInPandas(rerank, "q long, ids array<long>, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.select("q", F.explode("ids").alias("vec_id"), "score").withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1)
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(found, asked.node == found.q).where("vec_id <> query_id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
