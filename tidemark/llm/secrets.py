"""Secret scans: named patterns, and sliding-window Shannon entropy per character class over long strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: What can follow the name of an ASSIGN match; a text without any of them has none.
ASSIGN_NAMES = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Both kinds above and the entropy windows lie within such a run.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character over a window of 20 from which a run of that class counts as random; such strings drawn at random have about 3.4, 3.9 and 4.1.
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+"), 3.0), ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.5), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7))
#: Without a digit, a window needs so many letters of each case: words and names of words have fewer capitals.
CASED = 6
#: Long strings that look random and are no secrets: UUIDs, dates and times, digits alone, letters of one case, words and short numbers between
#: separators, names made of words and abbreviations.
ALLOW = (
    re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"),
    re.compile(r"[0-9T_/=+-]+"),
    re.compile(r"[a-z_/=+-]+|[A-Z_/=+-]+"),
    re.compile(r"[-_/=+]*+(?:[A-Z]?[a-z]++[0-9]{0,6}+|[A-Z]++[0-9]{0,6}+|[0-9]{1,8}+)(?:[-_/=+]++(?:[A-Z]?[a-z]++[0-9]{0,6}+|[A-Z]++[0-9]{0,6}+|[0-9]{1,8}+))*+[-_/=+]*+"),
    re.compile(r"(?:[A-Z]{2,5}|[A-Z][a-z]{2,}|[a-z]{3,})+[0-9]{0,6}"),
)


def entropy_spans(run: str, window: int = WINDOW, classes: Sequence = CLASSES) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of `run` whose characters are spread as a random string's of their class.

    The sum of c * log2(c) over the counts c is carried along: one character leaves a window and one enters.
    A window counts only with a digit and a letter, or with CASED letters of each case.
    """
    log = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # a character enters before one leaves
    found: list[tuple[int, int]] = []
    for _, pattern, least in classes:
        limit = (math.log2(window) - least) * window
        for m in pattern.finditer(run):
            s = m.group()
            if len(s) < window:
                continue
            counts: dict[str, int] = {}
            total, digits, upper, lower = 0.0, 0, 0, 0
            for i, c in enumerate(s):
                n = counts.get(c, 0)
                counts[c] = n + 1
                total += log[n + 1] - log[n]
                digits += "0" <= c <= "9"
                upper += "A" <= c <= "Z"
                lower += "a" <= c <= "z"
                if i >= window:
                    c = s[i - window]
                    n = counts[c]
                    counts[c] = n - 1
                    total += log[n - 1] - log[n]
                    digits -= "0" <= c <= "9"
                    upper -= "A" <= c <= "Z"
                    lower -= "a" <= c <= "z"
                if i >= window - 1 and total <= limit and ((digits and upper + lower) or (upper >= CASED and lower >= CASED)):
                    a, b = m.start() + i - window + 1, m.start() + i + 1
                    if found and found[-1][0] <= a <= found[-1][1]:
                        found[-1] = (found[-1][0], b)
                    else:
                        found.append((a, b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def scan(text: str | None, allow: Sequence[re.Pattern] = ALLOW) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, kinds as numbered in KINDS, sorted. Entropy spans that touch another span or that the allow-list matches whole are left out."""
    text = text or ""
    spans = []
    low = text.encode().lower()
    if any(name in low for name in ASSIGN_NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    runs = [(m.start(), m.group()) for m in CANDIDATE.finditer(text)]
    for at, run in runs:
        spans += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run) if len(m.group()) >= 20]
        spans += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if len(m.group()) >= 24]
    named = list(spans)
    for at, run in runs:
        if any(p.fullmatch(run) for p in allow):
            continue
        for a, b in entropy_spans(run):
            if not any(s < at + b and at + a < e for s, _, e in named):
                spans.append((at + a, 3, at + b))
    return sorted(spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) for each row of docs; null text is empty, repeated rows come back as often.

    Texts are scanned whole, whatever their length; an empty table gives an empty one. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                found = scan(text.as_py())
                counts = [sum(k == i for _, k, _ in found) for i in range(4)]
                said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                base = ",".join(x for x, (_, k, _) in zip(said, found) if k < 3)
                out.append((*counts[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), counts[3]))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in every document."""
    return find_secrets(table(spark, sf_dir, "documents"))
