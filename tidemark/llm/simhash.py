"""Near duplicates by SimHash fingerprints, linked with meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, discard, fresh, mixed, release, slices, stored, table, utf8, window_hashes, word_bounds, word_hashes

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A half-word bucket of more fingerprints is not paired; its members emit their whole ball instead.
PAIRED = 256
#: Near copies of the pipeline: words of a shingle, similarity of their sets, and independent tables of fingerprints in which a pair may be close.
STAGE_SHINGLE, SIMILARITY, TABLES = 5, 0.8, 6
_TABLE = 0xA24BAED4963EE407
#: Bucket keys of 16 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        last = ends[lo + shingle - 1 : hi + shingle - 1] if len(words) >= shingle else ends[-1:]
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[lo:hi], last)), np.uint64, hi - lo)
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


_LOWER = bytes(range(256)).lower()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): one row for each row of docs, in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, radius: int) -> list[int]:
    """All words of `bits` bits with at most `radius` set, as signed 64-bit numbers."""
    found = [0]
    ball = {0}
    for _ in range(radius):
        ball = {m ^ (1 << b) for m in ball for b in range(bits) if not m >> b & 1}
        found += sorted(ball)
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _mask_array(bits: int, radius: int):
    return F.array(*[F.lit(m).cast("long") for m in _masks(bits, radius)])


def whole_ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): every fingerprint emits all variants within radius // 2 and links to the least fingerprint on each variant.

    Two fingerprints on one variant differ in at most `radius` bits (radius even), and any two that close share a variant, so that the
    links have exactly the components asked for, with one link for each variant and member: no bucket is ever paired.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    ball = fps.select("fp", F.explode(_mask_array(64, radius // 2)).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    least = ball.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a <> top").select("v", "a")
    return ball.hint("merge").join(least, "v").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


#: True on one of the buckets that a pair shares, for balls of radius 1: on the lower half if that is close enough, else on the upper, and
#: there on the least variant of both. Without it a pair of equal halves would come out of all 33 buckets.
_LEAST_SHARED = """
CASE WHEN bit_count(({lo}) ^ ({lo2})) <= 2 THEN v = CASE bit_count(({lo}) ^ ({lo2}))
    WHEN 2 THEN least(({lo}) ^ ((({lo}) ^ ({lo2})) & -(({lo}) ^ ({lo2}))), ({lo2}) ^ ((({lo}) ^ ({lo2})) & -(({lo}) ^ ({lo2})))) ELSE least({lo}, {lo2}) END
ELSE v = 4294967296 + CASE bit_count(({hi}) ^ ({hi2}))
    WHEN 2 THEN least(({hi}) ^ ((({hi}) ^ ({hi2})) & -(({hi}) ^ ({hi2}))), ({hi2}) ^ ((({hi}) ^ ({hi2})) & -(({hi}) ^ ({hi2})))) ELSE least({hi}, {hi2}) END
END"""


def links(fps: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """(a, b) over distinct fingerprints, with the components of "at most `radius` bits apart".

    Of two 32-bit halves one differs in at most radius // 2 bits, so balls of radius // 4 around the halves meet (33 variants for each half
    instead of 2,081 of the whole). Buckets of two give their pair from one aggregation; larger ones up to `paired` are joined and
    verified; members of still larger ones (clusters of near copies) emit their whole balls, which need no pairs.
    """
    if radius % 4:
        raise ValueError("radius must be a multiple of 4")
    lower, upper = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)
    both = F.array(lower.bitwiseXOR(F.col("m")), upper.bitwiseXOR(F.col("m")).bitwiseOR(F.lit(1 << 32)))
    variants = fps.select("fp", F.explode(_mask_array(32, radius // 4)).alias("m")).select("fp", F.explode(both).alias("v"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    once = F.expr(_LEAST_SHARED.format(lo="a & 4294967295", lo2="b & 4294967295", hi="shiftrightunsigned(a, 32)", hi2="shiftrightunsigned(b, 32)"))
    buckets = variants.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    buckets = stored(buckets, "simhash-buckets")
    twos = buckets.where("n = 2").select("a", "b").where(close)
    many = buckets.where("n > 2").select("v", "n")
    few = many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some = stored(variants.join(F.broadcast(many), "v") if few else variants.hint("merge").join(many, "v"), "simhash-some")
    small = some.where(f"n <= {paired}")
    near = close & (once if radius == 4 else F.lit(True))
    pairs = small.select("v", F.col("fp").alias("a")).hint("merge").join(small.select("v", F.col("fp").alias("b")), "v").where("a < b").where(near).select("a", "b")
    hot = some.where(f"n > {paired}").select("fp").distinct()
    return twos.unionByName(pairs).unionByName(whole_ball_links(stored(hot, "simhash-hot"), radius)).distinct()


def buckets_of(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(v, fp, node, root, pivot_fp, pivot): nodes (fp, node, and root if they have one) in the half-word buckets of links(), with the smallest node there.

    Two nodes at most `radius` bits apart have a bucket in common, and that of _LEAST_SHARED is among them. Left out are buckets of one node, of two
    that are not close, of one root, and those around a half that all members have, but for that half's own. The members come from a sort of the
    variants, so that nothing is joined here and a group costs its members' variants whatever its size.
    """
    if radius % 4:
        raise ValueError("radius must be a multiple of 4")
    rooted = [c for c in nodes.columns if c == "root"]
    halves = F.array(F.struct(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("h")), F.struct(F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)).alias("h")))
    variants = nodes.select("fp", "node", *rooted, F.inline(halves)).withColumn("m", F.explode(_mask_array(32, radius // 4)))
    variants = variants.select(F.col("h").bitwiseXOR(F.col("m")).alias("v"), "h", "fp", "node", *rooted)
    of = Window.partitionBy("v")
    first = of.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = {"n": F.count("*").over(of), "apart": F.bit_count(F.bit_xor("fp").over(of)), "one": F.min("h").over(of) == F.max("h").over(of), "own": F.max(F.col("h") == F.col("v")).over(of)}
    held |= {"pivot_fp": F.first("fp").over(first), "pivot": F.first("node").over(first)}
    several = (F.col("n") > 2) | (F.col("n") == 2) & (F.col("apart") <= radius)
    if rooted:
        held["roots"] = F.min("root").over(of) < F.max("root").over(of)
        several &= F.col("roots")
    return variants.withColumns(held).where(several & (~F.col("one") | F.col("own"))).select("v", "fp", "node", *rooted, "pivot_fp", "pivot")


def pivot_pairs(members: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(x, y): each of buckets_of() with the smallest node of its bucket, if at most `radius` bits apart: as many rows as members, at most."""
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot_fp"))) <= radius
    return members.where("node <> pivot").where(close).select(F.col("pivot").alias("x"), F.col("node").alias("y")).distinct()


def with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with the column root of roots (node, root); a node not in it is its own."""
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def other_pairs(members: DataFrame, roots: DataFrame | None = None, radius: int = RADIUS) -> DataFrame:
    """(x, y): nodes of one bucket at most `radius` bits apart whose root is not the same; roots, if given, has those of members without a column root.

    In a bucket only the members outside its most frequent root are joined with the others, so that a bucket of one root makes no pairs and
    the few beside a large one make few.
    """
    rooted = (members if roots is None else with_roots(members, roots)).select("v", "fp", "node", "root")
    rooted = rooted.withColumn("n", F.count("*").over(Window.partitionBy("v", "root")))
    of = Window.partitionBy("v")
    rooted = rooted.withColumns({"most": F.max(F.struct("n", "root")).over(of), "lo": F.min("root").over(of), "hi": F.max("root").over(of)})
    rooted = stored(rooted.where("lo <> hi").select("v", "fp", "node", "root", (F.col("root") == F.col("most.root")).alias("main")), "dedup-rooted")
    left = rooted.where("not main").select("v", F.col("fp").alias("a"), F.col("node").alias("x"), F.col("root").alias("ra"))
    right = rooted.select("v", F.col("fp").alias("b"), F.col("node").alias("y"), F.col("root").alias("rb"), "main")
    once = F.expr(_LEAST_SHARED.format(lo="a & 4294967295", lo2="b & 4294967295", hi="shiftrightunsigned(a, 32)", hi2="shiftrightunsigned(b, 32)"))
    close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & (once if radius == 4 else F.lit(True))
    pairs = left.hint("merge").join(right, "v").where("ra <> rb and (main or x < y)").where(close)
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): alternating large and small stars, each round written to the shared folder."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, "cc")
        discard(edges)
        edges = new
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, balls: str = "halves") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Null or empty text has fingerprint 0 and links like any other. Repeated rows come back as often. component_id is the smallest doc_id
    reachable; null ids never win and a component of null ids alone has null. An empty table gives an empty one; texts are taken whole. Columns of
    docs other than the two are not read. balls: "halves" emits balls around half words, "whole" around the whole word; the components are the same.
    """
    one = stored(fingerprints(docs, id_col, text_col), "simhash-fp")
    fps = stored(one.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    near = whole_ball_links if balls == "whole" else links
    found = components(near(fps.select("fp"), radius))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(best, "root").select("fp", "component_id")
    return one.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_shingles(texts: pa.Array, shingle: int = STAGE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): of all runs of `shingle` lower-cased words of each text, repeats included; of shorter texts of all their words."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
    words, n = word_hashes(data, starts, ends), np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    h = window_hashes(words, shingle)
    at = np.flatnonzero(row[: len(h)] == row[shingle - 1 : shingle - 1 + len(h)])
    h, of = h[at], row[at]
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        own = np.array([window_hashes(words[first[d] : first[d + 1]], int(n[d]))[0] for d in short], dtype=np.uint64)
        h, of = np.concatenate([h, own]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, np.searchsorted(of, np.arange(len(n) + 1))


def table_fingerprints(h: np.ndarray, first: np.ndarray, tables: int) -> np.ndarray:
    """[texts, tables] fingerprints: majority bits of the shingles' hashes, mixed anew for each table; 0 without shingles."""
    out = np.zeros((len(first) - 1, tables), dtype=np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        n = np.diff(first)[full]
        for t in range(tables):
            bits = np.unpackbits(mixed(h + np.uint64((t + 1) * _TABLE & (1 << 64) - 1)).view(np.uint8), bitorder="little").reshape(-1, 64)
            votes = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
            out[full, t] = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def similar_groups(docs: DataFrame, tables: int = TABLES, radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """(doc_id, group) of the documents with an id: texts linked by SimHash whose sets of word shingles have a Jaccard similarity of `similarity`.

    Candidates are fingerprints of at most `radius` differing bits in one of `tables` independent tables, found by ball hashing; they are checked by
    their shingles: first each member of a bucket with the smallest one there, then those pairs of a bucket that this has not linked, over however many
    steps. So the groups are those of all pairs, and copies of one text are not paired with each other. Texts with the same fingerprint in all tables count as one. group is the smallest doc_id of the linked. Of rows that
    repeat an id the first by its fingerprints counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = table_fingerprints(*text_shingles(part.column(1), shingle), tables).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(fps[:, t])) for t in range(tables)]], names=["doc_id", *names])

    names = [f"f{t}" for t in range(tables)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    one = stored(rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names)), "dedup-fp")
    one = one.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("f")).select("doc_id", "f.*")
    same = stored(one.groupBy(*names).agg(F.min("doc_id").alias("least")), "dedup-distinct")
    first = None
    for c in names:
        got = stored(pivot_pairs(buckets_of(same.select(F.col(c).alias("fp"), F.col("least").alias("node")), radius), radius), "dedup-pairs")
        first = got if first is None else first.unionByName(got)
        release(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = text_shingles(part.column(1), shingle)
                packed = [np.unique(h[lo:hi]).tobytes() for lo, hi in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["doc_id", "s"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                whole = len(a) + len(b) - both
                ok.append(both >= similarity * whole)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of pairs (x, y) whose texts are alike, as (a, b). A text of many pairs is joined in as many copies as it has hundreds of them."""
        pairs = stored(pairs.distinct(), "dedup-candidates")
        wanted = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct()
        shingles = stored(rows.join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, s binary").groupBy("doc_id").agg(F.min("s").alias("s")), "dedup-shingles")
        many = stored(pairs.groupBy("x").count().where("count > 100").select("x", F.ceil(F.col("count") / 100).alias("copies")), "dedup-many")
        if many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            many = F.broadcast(many)
        copies = F.coalesce("copies", F.lit(1).cast("long"))
        dealt = pairs.join(many, "x", "left").select("x", "y", F.pmod(F.xxhash64("y"), copies).alias("copy"))
        side = shingles.select(F.col("doc_id").alias("x"), F.col("s").alias("sx")).join(many, "x", "left")
        side = side.select("x", "sx", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
        sided = dealt.join(side, ["x", "copy"]).select("x", "y", "sx")
        sided = sided.join(shingles.select(F.col("doc_id").alias("y"), F.col("s").alias("sy")), "y").select("x", "y", "sx", "sy")
        return stored(sided.mapInArrow(alike, "a long, b long"), "dedup-alike")

    edges = checked(first)
    rooted = stored(with_roots(same.withColumnRenamed("least", "node"), components(edges)), "dedup-roots")
    others = None
    for c in names:
        got = stored(other_pairs(buckets_of(rooted.select(F.col(c).alias("fp"), "node", "root"), radius), radius=radius), "dedup-others")
        others = got if others is None else others.unionByName(got)
        release(docs.sparkSession)
    found = components(edges.unionByName(checked(others.distinct().join(first.distinct(), ["x", "y"], "left_anti"))))
    rooted = same.join(found, F.col("least") == F.col("node"), "left").select(*names, F.coalesce("root", "least").alias("root"))
    return one.join(rooted, names).select("doc_id", F.col("root").alias("group"))


def drop_near_duplicates(docs: DataFrame, tables: int = TABLES, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar_groups(), that of the smallest doc_id; of rows that repeat an id one stays, rows without an id all stay.
    Null and empty texts are alike; an empty table gives an empty one; other columns stay."""
    (key,) = fresh(docs, "__kept")
    kept = similar_groups(docs, tables, radius, similarity).where("doc_id = group").select(F.col("doc_id").alias(key))
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    return rows.join(kept, F.col("doc_id") == F.col(key), "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
