"""Benchmark decontamination: a broadcast hash set of test n-grams against all token windows of the training texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, fresh, slices, stored, table, utf8, window_hashes, word_bounds, word_hashes

WINDOW = 10
#: Bytes of the built index up to which it goes to every worker; a benchmark with a larger one (or with so much text) is joined instead.
BROADCAST_BYTES = 64 << 20

OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first) of the words of some texts."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    return data, *word_bounds(data, offsets, ALNUM)


def item_windows(texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(hash, item, first word, length) of all windows of items, and the items' words: `window` words, all of a shorter item, none without words."""
    data, starts, ends, first = words = _words_of(texts)
    hashes, n = word_hashes(data, starts, ends), np.diff(first)
    item = np.repeat(np.arange(len(texts)), n)
    out = []
    for length in sorted({min(window, int(x)) for x in n if x}):
        at = np.flatnonzero(np.minimum(window, n)[item] == length)
        at = at[(at + length <= len(item)) & (item[np.minimum(at + length, len(item)) - 1] == item[at])]
        out.append((window_hashes(hashes, length)[at], item[at], at, np.full(len(at), length)))
    return *(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.uint64 if not i else np.int64) for i in range(4)), words


class Index:
    """All windows of the benchmark: hashes by length, a bitmap before them, and where each stands in the items' text, for the exact check."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        h, item, at, length, (data, starts, ends, _) = item_windows(pa.array([text for _, text in items], pa.large_string()), window)
        self.data, self.starts, self.ends = data.tobytes(), starts, ends
        self.sets = {}
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            # Of a window's places in one item the first is enough.
            order = mine[np.lexsort((at[mine], item[mine], h[mine]))]
            order = order[np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (item[order][1:] != item[order][:-1])])]
            known, first = np.unique(h[order], return_index=True)
            bits = min(24, max(12, int(len(known) * 16).bit_length()))
            bitmap = np.zeros(1 << bits, dtype=bool)
            bitmap[known & np.uint64(len(bitmap) - 1)] = True
            self.sets[n] = known, np.append(first, len(order)), item[order].astype(np.int32), at[order], bitmap

    def nbytes(self) -> int:
        return len(self.data) + self.starts.nbytes + self.ends.nbytes + sum(x.nbytes for group in self.sets.values() for x in group)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[set[int]], np.ndarray, tuple]:
        """(words, hit words, items) of each text, the hit mask over all words, and the words' bounds."""
        data, starts, ends, first = words = _words_of(texts)
        n_words = np.diff(first)
        row = np.repeat(np.arange(len(texts)), n_words)
        hashes = word_hashes(data, starts, ends)
        raw = None
        edges = np.zeros(len(starts) + 1, dtype=np.int64)
        items: list[set[int]] = [set() for _ in range(len(texts))]
        for length, (known, upto, owner, place, bitmap) in self.sets.items():
            h = window_hashes(hashes, length)
            at = np.flatnonzero(bitmap[h & np.uint64(len(bitmap) - 1)])
            at = at[row[at] == row[at + length - 1]]
            spot = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            same = known[spot] == h[at]
            for k, s in zip(at[same].tolist(), spot[same].tolist()):
                raw = raw or data.tobytes()
                mine, owners = _joined(raw, starts, ends, k, length), []
                for j in range(int(upto[s]), int(upto[s + 1])):
                    if _joined(self.data, self.starts, self.ends, int(place[j]), length) == mine:
                        owners.append(int(owner[j]))
                if owners:
                    items[row[k]].update(owners)
                    edges[k] += 1
                    edges[k + length] -= 1
        hit = np.cumsum(edges[:-1]) > 0
        return n_words, np.bincount(row[hit], minlength=len(texts)), items, hit, words


def _joined(data: bytes, starts: np.ndarray, ends: np.ndarray, k: int, length: int) -> bytes:
    return b" ".join(data[s:e] for s, e in zip(starts[k : k + length].tolist(), ends[k : k + length].tolist()))


def load_index(benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> Index | None:
    """The index of a benchmark (item_id, text), or None if it takes more than `limit` bytes: with more text it is not even collected.
    Null texts have no windows."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > limit:
        return None
    index = Index([(r[0] or "", r[1]) for r in benchmark.select(F.col("item_id").cast("string"), "text").collect()], window)
    return index if index.nbytes() <= limit else None


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    Null and empty texts have no words and no hits; repeated rows come back as often; an item_id of null counts as the empty string, and of
    equal item_ids each once. Texts are scanned whole; empty tables give no rows and no hits. An index beyond `limit` bytes takes
    hits_by_join(), with the same result.
    """
    index = load_index(benchmark, window, limit)
    if index is None:
        return hits_by_join(docs, benchmark, window)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_hit, items, _, _ = index.scan(part.column(1))
                names = [sorted({index.names[i] for i in found}) for found in items]
                digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                cols = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array(digests), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[c.split()[0] for c in OUT.split(", ")]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {OUT}")


def hit_words(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, n_words, items, at) of rows (row, text) for a benchmark of any size: the sorted ids of items with a window in the text and the numbers of
    the words that such a window covers, by a join of the windows' 64-bit hashes, whose words are then compared."""
    items = stored(benchmark.select(F.monotonically_increasing_id().alias("number"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"), "benchmark-items")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, item, at, length, (data, starts, ends, _) = item_windows(part.column(1), window)
                raw = data.tobytes()
                # Windows repeat within an item; one of each is enough.
                _, one = np.unique(np.stack([h, item.astype(np.uint64), length.astype(np.uint64)]), axis=1, return_index=True)
                said = [_joined(raw, starts, ends, int(at[k]), int(length[k])) for k in one]
                yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(length[one], pa.int32()), part.column(0).take(pa.array(item[one])), pa.array(said, pa.binary())], names=["h", "length", "number", "said"])

    wanted = stored(items.select("number", "text").mapInArrow(of_items, "h long, length int, number long, said binary"), "benchmark-windows")
    lengths = sorted(r[0] for r in wanted.select("length").distinct().collect())  # at most `window`

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, first = _words_of(part.column(1))
                hashes, n = word_hashes(data, starts, ends), np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                for length in lengths:
                    h = window_hashes(hashes, length)
                    at = np.flatnonzero(row[: len(h)] == row[length - 1 : length - 1 + len(h)])
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), length), pa.int32()), part.column(0).take(pa.array(row[at])), pa.array(at - first[:-1][row[at]], pa.int32())], names=["h", "length", "row", "k"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, first = _words_of(part.column(1))
                raw = data.tobytes()
                lists = [[raw[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())] for lo, hi in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), pa.int64()), pa.array(lists, pa.list_(pa.binary()))], names=["row", "n_words", "w"])

    seen = rows.select("row", "text").mapInArrow(of_rows, "h long, length int, row long, k int")
    found = seen.hint("merge").join(wanted.select("h", "length", "number", "said"), ["h", "length"])
    split = stored(rows.select("row", "text").mapInArrow(texts, "row long, n_words long, w array<binary>"), "benchmark-rows")
    same = F.aggregate(F.slice("w", F.col("k") + 1, F.col("length")), F.lit(None).cast("binary"), lambda out, x: F.when(out.isNull(), x).otherwise(F.concat(out, F.lit(b" "), x))) == F.col("said")
    found = found.join(split.select("row", "w"), "row").where(same).join(items.select("number", "item"), "number")
    at = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("k", F.col("k") + F.col("length") - 1)))))
    by = found.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"), at.alias("at"))
    return split.select("row", "n_words").join(by, "row", "left").select("row", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("at", F.array().cast("array<int>")).alias("at"))


def hits_by_join(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """hits() for a benchmark of any size."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "benchmark-docs")
    out = rows.select("row", "doc_id").join(hit_words(rows, benchmark, window), "row")
    return out.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("at") > 0).alias("contaminated"),
    )


def _without(text: str, starts: list[int], ends: list[int]) -> str:
    """text without the words from starts to ends, in bytes."""
    raw, out, at = text.encode(), [], 0
    for lo, hi in zip(starts, ends):
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents", limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs without contaminated rows, or (remove="spans") with the hit words cut out of their texts; the other columns, and null texts, stay.
    The result is the same for a benchmark of any size."""
    index, columns = load_index(benchmark, window, limit), docs.columns

    def cut(part: pa.RecordBatch, hit_of) -> pa.RecordBatch:
        """part with the words of row d that hit_of(d, first) names cut out of its text."""
        k = part.schema.get_field_index("text")
        texts, offsets = part.column(k).to_pylist(), utf8(part.column(k))[1]
        _, starts, ends, first = _words_of(part.column(k))
        for d, text in enumerate(texts):
            at = hit_of(d, first)
            if len(at):
                texts[d] = _without(text, (starts[first[d] + at] - offsets[d]).tolist(), (ends[first[d] + at] - offsets[d]).tolist())
        return part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))

    if index is None:
        # A key of each row: ids may be null or repeat.
        key, at = fresh(docs, "__row", "__at")
        keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "benchmark-docs")
        found = hit_words(keyed.select(F.col(key).alias("row"), "text"), benchmark, window).where(F.size("at") > 0).select(F.col("row").alias(key), F.col("at").alias(at))
        if remove == "documents":
            return keyed.join(found, key, "left_anti").select(columns)

        def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    lists = part.column(at).to_pylist()
                    yield cut(part, lambda d, first: np.array(lists[d] or [], np.int64)).select(columns)

        return keyed.join(found, key, "left").select(*columns, at).mapInArrow(by_join, docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, n_hit, _, hit, _ = shared.value.scan(part.column("text"))
                yield part.filter(pa.array(n_hit == 0)) if remove == "documents" else cut(part, lambda d, first: np.flatnonzero(hit[first[d] : first[d + 1]]))

    return docs.mapInArrow(run, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document has of the benchmark."""
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), iw AS (
    SELECT item, n, array_to_string(w[k : k + n - 1], ' ') AS words
    FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), h AS (
    SELECT DISTINCT doc_id, k, n, item FROM dw JOIN iw USING (n, words)
), p AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id
), t AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
