"""Language identification by Bayesian fusion of text, declared markup language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, fresh, slices, stored, table, utf8

#: Labelled rows that the text model is fitted on, at most, taken by a hash of the id; counts, priors and results cover all rows.
SAMPLE = 4000
BINS = 1 << 16
#: Trigrams of a text count as so many independent ones at most: neighbouring trigrams repeat each other's evidence.
EVIDENCE = 200
#: Pseudo-counts of a parent in a host's or suffix's prior, and of agreement in what a declaration is worth.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 5.0, 20.0, 20.0
UNKNOWN = "und"
MIN_CONFIDENCE = 0.5
#: Hosts or suffixes whose counts may go to every worker; of more, rows of one are dealt over SALTS keys.
BROADCAST_KEYS, SALTS = 100_000, 64

#: Letters stay, lower-cased; other ASCII becomes a space.
_LETTER = LOWER.copy()
_LETTER[[b for b in range(128) if not 97 <= int(LOWER[b]) <= 122]] = 32


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts in order (none across texts, none with two spaces), and the first of each text."""
    data, offsets = utf8(texts)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    b = _LETTER[data].astype(np.uint32)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    spaces = (b == 32).view(np.uint8)
    good = spaces[:-2] + spaces[1:-1] + spaces[2:] < 2
    for back in (1, 2):
        at = offsets[1:] - back
        good[at[(at >= 0) & (at < len(good))]] = False
    at = np.flatnonzero(good)
    bins = (code[at] * np.uint32(2654435761)) >> np.uint32(16)
    return bins.astype(np.int64), np.searchsorted(at, offsets)


class TextModel:
    """Trigram log likelihoods by language, with a uniform background as the language `und`."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        smooth = (counts + 0.3) / (counts.sum(axis=1, keepdims=True) + 0.3 * BINS)
        self.table = np.vstack([np.log(smooth), np.full((1, BINS), -np.log(BINS))]).astype(np.float32)

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, log likelihoods) of each text, the latter scaled to EVIDENCE trigrams at most."""
        bins, first = _trigrams(texts)
        n = np.diff(first)
        out = np.zeros((len(texts), len(self.languages)))
        for k, row in enumerate(self.table):
            sums = np.concatenate([[0.0], np.cumsum(row[bins], dtype=np.float64)])
            out[:, k] = sums[first[1:]] - sums[first[:-1]]
        return n, out * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]


def fit(rows: DataFrame, sample: int = SAMPLE) -> TextModel:
    """The text model of rows (id, text, declared), from at most `sample` rows with a declared language."""
    rows = rows.where("declared is not null and text is not null")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = rows.select("id").orderBy(*order).limit(sample)
    texts = rows.join(F.broadcast(chosen.distinct()), "id", "left_semi").select("id", "text", "declared")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                bins, first = _trigrams(part.column(0))
                label = np.array(part.column(1).to_pylist(), dtype=object)
                of = np.repeat(label, np.diff(first))
                for lang in set(label.tolist()):
                    found.setdefault(lang, np.zeros(BINS, np.int64))
                    found[lang] += np.bincount(bins[of == lang], minlength=BINS)
        for lang, c in found.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bin", "n"])

    got = texts.select("text", "declared").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((len(languages), BINS))
    for k, lang in enumerate(languages):
        mine = got[got["lang"] == lang]
        counts[k, mine["bin"].to_numpy()] = mine["n"].to_numpy()
    return TextModel(languages, counts)


def identify(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, language, confidence, declared, text_language, kept) for each of rows (id, text, declared, host, suffix).

    Posterior of a language: text likelihood x P(declaration | language) x host prior. Counts of each text's likeliest language, over all
    rows, by declaration, suffix and host, give the last two: a host's prior is smoothed by its suffix's, that by all rows', and a row's own
    count is left out of its host's. `und` stands for text that no language explains better than chance. Null declarations, hosts and suffixes
    bring no evidence; null and empty texts have the prior alone and are not kept; repeated rows come back as often.
    """
    model = fit(rows, sample)
    langs = model.languages
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, ll = shared.value.evidence(part.column(1))
                top = np.where(n > 0, ll.argmax(axis=1), -1)
                cols = [part.column(0), part.column(2), part.column(3), part.column(4), pa.array(n, pa.int64()), pa.array(list(ll), pa.list_(pa.float64())), pa.array(top, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "declared", "host", "suffix", "n", "ll", "top"])

    narrow = rows.select("id", "text", "declared", "host", "suffix").mapInArrow(score, "id long, declared string, host string, suffix string, n long, ll array<double>, top int")
    one = stored(narrow, "language-rows")
    each = range(len(langs))

    def votes(by: str) -> DataFrame:
        seen = one.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.sum((F.col("top") == k).cast("double")).alias(f"c{k}") for k in each])
        return seen.select(by, F.array(*[f"c{k}" for k in each]).alias(f"{by}_votes"))

    total = one.agg(*[F.sum((F.col("top") == k).cast("double")).alias(f"c{k}") for k in each]).first()
    total = [(c or 0.0) + 1.0 for c in total]
    base = [c / sum(total) for c in total]
    # Of rows in language l the share with declaration d, smoothed towards d = l.
    says = {}
    for r in votes("declared").where(F.col("declared").isin(langs)).collect():  # one row for each language of the model
        for k in each:
            says[r[0], langs[k]] = (r[1][k] + DECLARED_WEIGHT * (0.9 if r[0] == langs[k] else 0.1 / len(langs))) / (total[k] + DECLARED_WEIGHT)
    declared = F.create_map(*[x for d in langs if (d, langs[0]) in says for x in (F.lit(d), F.array(*[F.lit(float(np.log(says[d, l]))) for l in langs]))]) if says else None
    flat = F.array(*[F.lit(0.0) for _ in each])
    def with_votes(rows: DataFrame, by: str) -> DataFrame:
        v = stored(votes(by), "language-votes")
        if v.count() <= BROADCAST_KEYS:
            return rows.join(F.broadcast(v), by, "left")
        salt = F.pmod(F.xxhash64("id", "n"), F.lit(SALTS))
        return rows.withColumn("salt", salt).join(v.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")), [by, "salt"], "left").drop("salt")

    out = with_votes(with_votes(one, "suffix"), "host")

    def smoothed(own: Column, parent: Column, weight: float) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda a, c: a + c)
        return F.zip_with(own, parent, lambda c, p: (c + weight * p) / (n + weight))

    mine = F.array(*[F.when(F.col("top") == k, 1.0).otherwise(0.0) for k in each])
    less = lambda v: F.when(v.isNull(), flat).otherwise(F.zip_with(v, mine, lambda c, m: c - m))
    out = out.withColumn("of_suffix", smoothed(less(F.col("suffix_votes")), F.array(*[F.lit(float(b)) for b in base]), SUFFIX_WEIGHT))
    out = out.withColumn("of_host", smoothed(less(F.col("host_votes")), F.col("of_suffix"), HOST_WEIGHT))
    logs = F.zip_with("ll", "of_host", lambda a, p: a + F.log(F.greatest(p, F.lit(1e-12))))
    if declared is not None:
        logs = F.zip_with(logs, F.coalesce(F.element_at(declared, F.col("declared")), flat), lambda a, b: a + b)
    out = out.withColumn("logs", logs).withColumn("best", F.array_max("logs"))
    sure = 1.0 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    out = out.withColumn("confidence", sure).withColumn("language", F.element_at(F.array(*map(F.lit, langs)), F.array_position("logs", F.col("best")).cast("int")))
    text = F.when(F.col("top") >= 0, F.element_at(F.array(*map(F.lit, langs)), F.col("top") + 1))
    kept = (F.col("n") > 0) & (F.col("language") != UNKNOWN) & (F.col("confidence") >= MIN_CONFIDENCE)
    return out.select("id", "language", "confidence", "declared", text.alias("text_language"), kept.alias("kept"))


def document_rows(docs: DataFrame) -> DataFrame:
    """documents as identify() takes them: lang is what the markup declared, source stands for the host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def page_rows(pages: DataFrame) -> DataFrame:
    """pages as identify() takes them: the lang of <html>, the host of the address and the host's last label; text without markup."""
    host = F.nullif(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1), F.lit(""))
    html = F.col("html")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[A-Za-z#0-9]+;", " ")
    lang = F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), lang.alias("declared"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the ids of which every row is rejected; rows without an id are judged one by one, by their texts. An empty table gives an empty one."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.hex(F.xxhash64(F.coalesce("text", F.lit("")))), F.hex(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)))))
    name, bad_name = fresh(docs, "__id", "__bad")
    keyed = docs.withColumn(name, key)
    rows = keyed.select(F.xxhash64(name).alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    bad = identify(rows).groupBy("id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("id").alias(bad_name))
    return keyed.join(bad, F.xxhash64(name) == F.col(bad_name), "left_anti").select(docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(document_rows(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op3_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    return identify(page_rows(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")
