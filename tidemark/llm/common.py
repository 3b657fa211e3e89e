"""Shared pieces: word splitting over Arrow buffers, hashing, tables in the shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import own_dir, shared_dir  # noqa: F401  (shared_dir is for callers)

SPACE = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20

#: ASCII A-Z to a-z by byte; UTF-8 continuation and lead bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Word bytes of the benchmark contract, after lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column of df, whatever its case, has."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver drop what nothing refers to any more, so that Spark deletes the shuffles of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has stored(), the pipeline's included; results that still read them must have been written by then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Words between ASCII white space, without a regular expression; null counts as 0."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("long")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of text (or other bytes), so that work arrays stay small whatever the batch holds."""
    arr = batch.column(batch.schema.get_field_index(column))
    arr = arr.cast(pa.large_binary() if arr.type in (pa.binary(), pa.large_binary()) else pa.large_string())
    ends = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    return _bytes(column.cast(pa.large_string()).fill_null(""))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; null is empty."""
    return _bytes(column.cast(pa.large_binary()).fill_null(b""))


def _bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte bounds of every word, and first[d] : first[d + 1] are the words of row d. Words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = is_word[data]
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD1342543DE82EF95)
_Q_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums of a polynomial modulo 2 ** 64, in chunks of about a megabyte."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
        part = data[base : ends[hi - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * powers(_P, len(part)), out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * powers(_P_INV, len(part) + 1)[s] + (e - s).astype(np.uint64)
        lo = hi
    return mixed(out)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` words, in order; runs across rows included (callers mask them)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out += words[k : k + n] * powers(_Q, length)[k]
    return mixed(out)


def numbered(df: DataFrame, group: list[str], order: list[Column], bucket: Column, as_name: str = "position", weight: Column | None = None) -> DataFrame:
    """Within each group, rows numbered from 0 by (bucket, order), or with `weight` the sum of the weights before the row.

    No task gets a whole group: sums by (group, bucket) give every bucket's first number, and a second window numbers the rows within a
    bucket. `bucket` must be a cheap deterministic column that deals a group out evenly, and its order comes first.
    """
    each = F.lit(1).cast("long") if weight is None else weight
    cell, total, base, inside = fresh(df, "__bucket", "__sum", "__base", "__inside")
    df = df.withColumn(cell, bucket)
    sums = df.groupBy(*group, cell).agg(F.sum(each).alias(total))
    before = F.sum(total).over(Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn(base, F.coalesce(before, F.lit(0).cast("long"))).drop(total)
    own = F.sum(each).over(Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    left = df.withColumn(inside, F.coalesce(own, F.lit(0).cast("long"))).alias("l")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, cell]]
    out = left.join(sums.alias("r"), on=reduce(lambda a, b: a & b, on))
    return out.select("l.*", f"r.{base}").withColumn(as_name, F.col(base) + F.col(inside)).drop(cell, base, inside)
