"""Personal data by pattern, and terms that give it away by corpus co-occurrence. DataFrame functions only: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")

# The contract's patterns with starts that cannot match inside a run taken out and runs made possessive: the same matches, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Words on each side of a protected value, within so many characters, that count as occurring with it.
NEAR_WORDS, NEAR_CHARS = 5, 120
#: A term gives a value away if it stands by it in so many different texts, names it in this share of all documents with the term, and the
#: value is so many bits likelier there than anywhere.
MIN_TEXTS, DISCLOSURE, MIN_BITS = 3, 0.8, 4.0
#: Terms that may be broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 100_000
_CHUNK = 256
NOT_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _plus(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: Column | str, kind: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points: lengths of the gaps and matches, summed in two levels."""
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("v")))
    pairs = F.slice(pairs, F.lit(1), F.size(found))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _CHUNK).cast("int")), lambda c: F.slice(pairs, c * _CHUNK + 1, F.lit(_CHUNK)))
    whole = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0), lambda a, x: a + x["g"] + x["m"]))

    def placed(ch: Column, c: Column) -> Column:
        base = _plus(F.slice(whole, F.lit(1), c))

        def span(x: Column, i: Column) -> Column:
            start = base + F.aggregate(F.slice(ch, F.lit(1), i), F.lit(0), lambda a, y: a + y["g"] + y["m"]) + x["g"]
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["m"]).alias("end"), x["v"].alias("value"))

        return F.transform(ch, span)

    return F.when(F.size(found) > 0, F.flatten(F.transform(chunks, placed))).otherwise(F.array().cast(SPAN))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Email, ip, card and phone spans of a text, by kind, then start; failing matches are dropped."""
    none = F.array().cast(SPAN)
    email = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, 0)).otherwise(none)
    small = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    ip = F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(matches(text, IP, 1), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(small)))).otherwise(none)
    plain = lambda s: F.translate(s["value"], " -", "")
    card = F.filter(matches(text, CARD, 2), lambda s: F.length(plain(s)).between(13, 19))
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.filter(card, lambda s: _luhn(plain(s)))).otherwise(none)
    phone = F.filter(matches(text, PHONE, 3), lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(9, 15))
    phone = F.when(F.contains(text, F.lit("+")), phone).otherwise(none)
    return F.concat(email, ip, card, phone)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text: Column) -> Column:
    """Words that may give something away: three characters at least, not of digits alone."""
    return F.filter(F.split(_lower(text), NOT_TERM), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]*$"))


def _near(text: Column, spans: Column) -> Column:
    """Distinct (entity, term) pairs of a text. A word that the character limit cuts is left out, as are words of other protected values."""

    def of(s: Column) -> Column:
        left = F.substr(text, F.greatest(s["start"] - NEAR_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR_CHARS)))
        left = F.when(s["start"] > NEAR_CHARS, F.regexp_replace(left, r"^[^\x20\x09-\x0D]*", "")).otherwise(left)
        right = F.substr(text, s["end"] + 1, F.lit(NEAR_CHARS))
        right = F.when(F.length(right) == NEAR_CHARS, F.regexp_replace(right, r"[^\x20\x09-\x0D]*+$", "")).otherwise(right)
        plain = lambda x: _terms(F.regexp_replace(x, r"[^\x20\x09-\x0D]*[@0-9+][^\x20\x09-\x0D]*", " "))
        before, after = F.reverse(F.slice(F.reverse(plain(left)), 1, NEAR_WORDS)), F.slice(plain(right), 1, NEAR_WORDS)
        entity = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), _lower(s["value"]))
        return F.transform(F.array_distinct(F.concat(before, after)), lambda w: F.struct(entity.alias("entity"), w.alias("term")))

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def revealing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, entity, share, bits) of the terms beyond the disclosure thresholds.

    found has (t1, t2, near) for each document. Occurrence with a value is counted in windows around it, per document, and a term's
    documents over the whole corpus; copies of one text count once towards MIN_TEXTS.
    """
    pairs = found.where(F.size("near") > 0).select("t1", "t2", F.explode("near").alias("p")).select("t1", "t2", "p.entity", "p.term")
    texts = pairs.groupBy("term", "entity", "t1", "t2").agg(F.count("*").alias("docs"))
    together = texts.groupBy("term", "entity").agg(F.count("*").alias("texts"), F.sum("docs").alias("docs")).where(F.col("texts") >= MIN_TEXTS)
    # A term by several values of its own documents cannot name one of them often enough, however often it occurs elsewhere.
    beside = found.where(F.size("near") > 0).select(F.explode(F.array_distinct(F.transform("near", lambda p: p["term"]))).alias("term")).groupBy("term").agg(F.count("*").alias("beside"))
    together = together.join(beside, "term").where(F.col("docs") >= DISCLOSURE * F.col("beside")).drop("beside")
    together = stored(together, "pii-together")
    candidates = stored(together.select("term").distinct(), "pii-candidates")
    words = docs.select(F.explode(F.array_distinct(_terms(F.coalesce("text", F.lit(""))))).alias("term"))
    few = candidates.count() <= BROADCAST_TERMS
    of_term = words.join(F.broadcast(candidates), "term", "left_semi").groupBy("term").agg(F.count("*").alias("of_term")) if few else words.groupBy("term").agg(F.count("*").alias("of_term")).hint("merge").join(candidates, "term", "left_semi")
    of_entity = found.select(F.explode(F.array_distinct(F.transform("near", lambda p: p["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("of_entity"))
    n = found.count()
    out = together.join(of_term, "term").join(of_entity, "entity")
    out = out.withColumn("share", F.col("docs") / F.col("of_term")).withColumn("bits", F.log2(F.col("share") / (F.col("of_entity") / F.lit(float(max(n, 1))))))
    return out.where((F.col("share") >= DISCLOSURE) & (F.col("bits") >= MIN_BITS)).select("term", "entity", "share", "bits")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, spans) for each row of docs: base spans by kind and start, then `term` spans of revealing terms wherever they occur.

    Null text is empty; repeated rows come back as often and alike. Term spans never overlap base spans. t1 and t2 are hashes of the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64("text", F.lit(1)))
    spans = rows.select("doc_id", "t1", "t2", "text", base_spans(F.col("text")).alias("spans"))
    near = F.when(F.size("spans") > 0, _near(F.col("text"), F.col("spans"))).otherwise(F.array().cast("array<struct<entity:string,term:string>>"))
    found = stored(spans.select("doc_id", "t1", "t2", "spans", near.alias("near")), "pii-found")
    risky = stored(revealing_terms(rows, found).select("term").distinct(), "pii-risky")
    n = risky.count()
    if not n:
        return found.drop("near")
    words = rows.select("t1", "t2", "text").withColumn("term", F.explode(F.array_distinct(_terms(F.col("text")))))
    if n <= BROADCAST_TERMS:
        hit = words.join(F.broadcast(risky), "term", "left_semi")
    else:
        hit = words.select("t1", "t2", "term").hint("merge").join(risky, "term", "left_semi")
    # Copies of a text have the same terms: one row of it is enough from here on.
    of_text = stored(hit.groupBy("t1", "t2").agg(F.sort_array(F.collect_set("term")).alias("terms")), "pii-texts")
    inside = "[a-z0-9A-Z\\x{80}-\\x{10FFFF}]"
    pattern = F.concat(F.lit(f"(?<!{inside})(?i:"), F.array_join("terms", "|"), F.lit(f")(?!{inside})"))
    small = n <= BROADCAST_TERMS and of_text.count() <= BROADCAST_TERMS
    # Else one copy of each text is taken before anything is shuffled by it, so that no task gets all copies with their texts.
    one = rows.join(F.broadcast(of_text), ["t1", "t2"]).dropDuplicates(["t1", "t2"]) if small else rows.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(of_text, ["t1", "t2"])
    terms = stored(one.select("t1", "t2", matches(F.col("text"), pattern, 4).alias("more")), "pii-terms")
    out = found.join(F.broadcast(terms) if small and terms.agg(F.coalesce(F.sum(F.size("more")), F.lit(0))).first()[0] <= BROADCAST_TERMS else terms, ["t1", "t2"], "left")
    free = F.filter("more", lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return out.select("doc_id", "t1", "t2", F.concat("spans", F.coalesce(free, F.array().cast(SPAN))).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data and revealing terms in `text` generalised to their kind; of overlapping spans the leftmost counts. Null stays null."""
    spans = find_personal_data(docs).where(F.size("spans") > 0).select("t1", "t2", "spans").dropDuplicates(["t1", "t2"])
    keyed = docs.withColumn("t1", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("t2", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)))
    out = keyed.join(spans, ["t1", "t2"], "left")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(a: Column, s: Column) -> Column:
        label = F.element_at(F.array(*map(F.lit, LABELS)), s["kind"] + 1)
        new = F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]), label).alias("out"))
        return F.when(s["start"] >= a["at"], new).otherwise(a)

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, F.length("text"))))
    return out.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done)).select(docs.columns)


def _said(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document, with the terms that give it away."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_said(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        _said(F.col("spans")).alias("spans"),
        count(4).alias("n_term"),
    )
