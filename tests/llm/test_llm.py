"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, decontamination, language, mixing, passages, pii, secrets, sharding, simhash
from tidemark.llm.common import discard, numbered, stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        text = words(rng, rng.choice((0, 1, 3, 20, 60, 120)))
        rows.append((i, text, rng.choice(("en", "fr", None)), rng.choice(("a", "b", "é", None)), len(text)))
    rows += [(80, None, "en", "a", None), (81, "", None, None, 0), (82, " \t\n ", "en", "a", 4), (83, words(rng, 4000), "en", "a", 0)]
    rows += [(84, rows[5][1], "en", "a", 0), (85, rows[5][1], "en", "b", 0), rows[7], (None, "no id here", "en", "a", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in ("size", "target", "taken", "row", "key", "h", "fp", "part", "block", "slot", "shard", "spans", "t1", "words", "n", "bucket")])


# mixing


def brute_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _, _ in rows]
    total = defaultdict(int)
    for r, s in zip(rows, size):
        total[r[3]] += s
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    words_, full = 1.5 * sum(size), set()
    while True:
        rest = words_ - sum(2 * total[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * total[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if target[s] > 2 * total[s]}
        if not over:
            return size, total, target
        full |= over


def test_mixing(spark, docs):
    rows = docs.collect()
    size, total, target = brute_mix(rows)
    got = mixing.mixed_documents(clash(docs)).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(size)
    by_source = defaultdict(int)
    of = {r[0]: r[3] for r in rows}
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source[s] += r["taken"]
    assert all(abs(by_source[s] - target[s]) < 1 for s in total)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(docs).collect()))


def test_mix_keeps_rows_without_an_id_apart(spark):
    docs = spark.createDataFrame([(None, f"a b c {i}", "x", i) for i in range(20)] + [(None, "a b c 0", "x", 99), (1, "d e", "x", 7), (1, "d e", "x", 8)], "doc_id long, text string, source string, __times int")
    got = mixing.repeat_by_mix(docs.drop("__times")).collect()
    assert {r["text"] for r in got} == {f"a b c {i}" for i in range(20)} | {"d e"}
    assert max(Counter(r["text"] for r in got).values()) == 2
    assert mixing.mixed_documents(docs).count() == 23


def test_mix_stream_fills_each_slot_once(docs):
    _, _, stream = mixing.mix(docs, block=64)
    per_slot = stream.groupBy("slot").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in per_slot) <= 64


def test_schedule_is_spread(spark):
    t = spark.createDataFrame([("a", 9000.0), ("b", 3000.0), (None, 1000.0)], "source string, target double")
    rows = mixing.schedule(t, 10).orderBy("slot").collect()
    assert Counter(r["source"] for r in rows) == {"a": 900, "b": 300, None: 100}
    assert len({(r["source"], r["block"]) for r in rows}) == 1300
    head = Counter(r["source"] for r in rows[:130])
    assert abs(head["a"] - 90) <= 4 and abs(head["b"] - 30) <= 4


def test_repeat_by_mix_edges(spark, docs, none):
    extra = clash(docs).withColumns({c: F.lit(1) for c in ("__times", "__twin", "__key", "twin", "first_slot", "__base")})
    got = mixing.repeat_by_mix(extra)
    assert got.columns == extra.columns and 0 < got.count() and got.where("text is null or trim(text) = ''").count() == 0
    assert mixing.repeat_by_mix(none).count() == 0


def test_mixing_empty(none):
    assert mixing.mixed_documents(none).count() == 0


# SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(docs):
    rows = docs.collect()
    got = simhash.near_duplicates(clash(docs)).collect()
    assert len(got) == len(rows)
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    roots = brute_components(set(fps.values()))
    least = defaultdict(list)
    for d, f in fps.items():
        least[roots[f]].append(d)
    for r in got:
        assert int(r["fingerprint"], 16) == fps[r["doc_id"]] and len(r["fingerprint"]) == 16
        assert r["component_id"] == min((d for d in least[roots[fps[r["doc_id"]]]] if d is not None), default=None)


@pytest.mark.parametrize("paired", [256, 2, 1])
def test_links_have_the_components(spark, paired):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:8]:
        for _ in range(12):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    want = brute_components(fps)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = stored(spark.createDataFrame([(f,) for f in signed], "fp long"), "t")
    found = {signed[r["node"]]: signed[r["root"]] for r in simhash.components(simhash.links(df, paired=paired)).collect()}
    groups = lambda m: {frozenset(x for x in m if m[x] == r) for r in set(m.values())}
    full = {f: found.get(f, f) for f in fps}
    assert groups(full) == groups(want)
    if paired == 1:
        whole = {signed[r["node"]]: signed[r["root"]] for r in simhash.components(simhash.whole_ball_links(df)).collect()}
        assert groups({f: whole.get(f, f) for f in fps}) == groups(want)


def brute_similar(rows, similarity=0.8, shingle=5):
    """(id: smallest id) of documents linked by the Jaccard similarity of their word shingles, over all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    return root


def test_similar_groups_against_all_pairs(spark, docs, none):
    rng = random.Random(41)
    base = [words(rng, 120) for _ in range(30)]
    rows = list(enumerate(base)) + [(100 + i, " ".join([*t.split()[:-1], "changed"])) for i, t in enumerate(base)] + [(200 + i, t.upper()) for i, t in enumerate(base[:5])]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "one  Two"), (304, "one three")]
    # Half of the words are others': alike by no measure.
    rows += [(400 + i, " ".join(t.split()[:60] + words(rng, 60).split())) for i, t in enumerate(base[:10])]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("__kept", F.lit(1))
    want = brute_similar(rows)
    assert dict(map(tuple, simhash.similar_groups(df, tables=3).collect())) == want
    kept = simhash.drop_near_duplicates(tables=3, docs=df.unionByName(df.limit(3)).unionByName(df.where("doc_id = 300").withColumn("doc_id", F.lit(None).cast("long"))))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values())) and kept.where("doc_id is null").count() == 1 and kept.columns == df.columns
    assert simhash.drop_near_duplicates(none, tables=1).count() == 0


def test_near_copies_are_not_paired_with_each_other(spark):
    """400 texts with another word each changed: no more candidates than members of buckets, and none between texts that are linked by then."""
    rng = random.Random(28)
    base = words(rng, 400).split()
    rows = [(i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["group"] for r in simhash.similar_groups(df, tables=1).collect()} == {0}
    fps = [(0x0123456789ABCDEF ^ (1 << i % 32) ^ (1 << 32 + i // 32), i) for i in range(400)]
    members = simhash.buckets_of(spark.createDataFrame(fps, "fp long, node long"))
    pairs = simhash.pivot_pairs(members)
    assert {r["y"] for r in pairs.collect()} >= set(range(32, 400)) and pairs.count() <= 66 * 400
    roots = simhash.components(pairs.withColumnsRenamed({"x": "a", "y": "b"}))
    assert simhash.other_pairs(members, roots).count() == 0
    # Nothing linked yet: all pairs of different nodes come out, each once.
    alone = simhash.other_pairs(members, roots.limit(0)).collect()
    close = {(i, j) for a, i in fps for b, j in fps if i < j and (a ^ b).bit_count() <= 4}
    assert len(alone) == len(close) and {tuple(r) for r in alone} == close


def test_buckets_hold_what_may_be_linked_without_a_join(spark):
    """A half that 100 texts share is one bucket and not 33; buckets of one root, and pairs by chance, are none; all close pairs of two roots are found."""
    rng = random.Random(61)
    fps = [(rng.getrandbits(31) << 32 | 0x1234567, i) for i in range(100)]
    df = spark.createDataFrame(fps, "fp long, node long")
    members = simhash.buckets_of(df)
    assert members.where(F.col("v") == 0x1234567).count() == 100 and members.count() <= 120
    assert "Join" not in members._jdf.queryExecution().optimizedPlan().toString()
    assert simhash.buckets_of(df.withColumn("root", F.lit(0).cast("long"))).count() == 0
    seeds = [rng.getrandbits(63) for _ in range(12)]
    near = [(rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(6))), i, rng.randrange(3)) for i in range(300)]
    found = simhash.other_pairs(simhash.buckets_of(spark.createDataFrame(near, "fp long, node long, root long"))).collect()
    want = {(i, j) for a, i, r in near for b, j, q in near if i < j and r != q and (a ^ b).bit_count() <= 4}
    assert len(found) == len(want) > 1000 and {tuple(r) for r in found} == want


def test_simhash_whole_balls_give_the_same(docs):
    a, b = (sorted(map(str, simhash.near_duplicates(docs, balls=x).collect())) for x in ("halves", "whole"))
    assert a == b


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


# language


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(2)
    parts = {"en": "the and ing tion er on st re nd ha".split(), "de": "der und sch ich ung ein keit ver ß ü".split(), "fr": "eau oi eux ment que les é è tion ou".split()}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(60))
        rows.append((i, text, rng.choice(list(parts)) if i % 8 == 0 else None if i % 8 == 1 else lang, "host-" + lang if i % 3 else None, 0, lang))
    return spark.createDataFrame(rows, SCHEMA + ", truth string")


def test_language_accuracy_despite_wrong_declarations(tongues):
    got = {r["id"]: r for r in language.identify(language.document_rows(tongues)).collect()}
    right = [got[r["doc_id"]]["language"] == r["truth"] for r in tongues.collect()]
    assert sum(right) / len(right) > 0.97
    assert all(r["kept"] for r in got.values())


def test_language_prior_decides_without_text(spark, tongues):
    extra = spark.createDataFrame([(900, None, None, "host-de", 0, ""), (901, "", "de", None, 0, ""), (902, "你好世界" * 40, None, None, 0, "")], tongues.schema)
    got = {r["id"]: r for r in language.identify(language.document_rows(tongues.unionByName(extra))).collect() if r["id"] >= 900}
    assert got[900]["language"] == "de" and not got[900]["kept"] and not got[901]["kept"]
    assert got[902]["language"] == language.UNKNOWN and not got[902]["kept"]


def test_language_posterior_by_hand(spark, tongues):
    """The posterior of every row from the model's likelihoods, the votes and the declarations, summed up in Python."""
    some = language.document_rows(tongues.orderBy("doc_id").limit(200)).withColumn("suffix", F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))))
    rows = some.collect()
    df = spark.createDataFrame(rows, some.schema)
    model = language.fit(df)
    langs = model.languages
    texts = lm_array([r["text"] for r in rows])
    n, ll = model.evidence(texts)
    top = np.where(n > 0, ll.argmax(axis=1), -1)
    total = np.array([(top == k).sum() + 1.0 for k in range(len(langs))])
    want = {}
    for i, r in enumerate(rows):
        prior = total / total.sum()
        for by, weight in (("suffix", language.SUFFIX_WEIGHT), ("host", language.HOST_WEIGHT)):
            own = np.array([float(sum(1 for j, x in enumerate(rows) if j != i and x[by] is not None and x[by] == r[by] and top[j] == k)) for k in range(len(langs))])
            prior = (own + weight * prior) / (own.sum() + weight)
        logs = ll[i] + np.log(np.maximum(prior, 1e-12))
        if r["declared"] in langs and any(x["declared"] == r["declared"] for x in rows):
            says = np.array([(sum(1 for j, x in enumerate(rows) if x["declared"] == r["declared"] and top[j] == k) + language.DECLARED_WEIGHT * (0.9 if r["declared"] == l else 0.1 / len(langs))) / (total[k] + language.DECLARED_WEIGHT) for k, l in enumerate(langs)])
            logs = logs + np.log(says)
        p = np.exp(logs - logs.max())
        want[r["id"]] = (langs[int(logs.argmax())], 1 / p.sum())
    for r in language.identify(df).collect():
        assert (r["language"], r["confidence"]) == (want[r["id"]][0], pytest.approx(want[r["id"]][1], rel=1e-6))


def test_keep_identified_edges(spark, docs, none):
    extra = clash(docs).withColumns({c: F.lit(1) for c in ("__id", "__bad", "id", "host", "kept")})
    odd = extra.where("doc_id = 80").withColumn("doc_id", F.lit(None).cast("long"))
    got = language.keep_identified(extra.unionByName(odd))
    assert got.columns == extra.columns and got.where("text is null").count() == 0
    assert language.keep_identified(none).count() == 0


def test_language_edges(spark, docs, none):
    assert language.identify(language.document_rows(none)).count() == 0
    assert language.identify(language.document_rows(clash(docs))).count() == docs.count()
    assert language.keep_identified(docs).columns == docs.columns
    page = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="DE"><script>x</script><p>der und</p></html>'), (2, None, None)], "page_id long, url string, html string")
    row = {r["id"]: r for r in language.page_rows(page).collect()}
    assert (row[1]["declared"], row[1]["host"], row[1]["suffix"]) == ("de", "a.example.de", "de") and "x" not in row[1]["text"]
    assert language.identify(language.page_rows(page)).count() == 2


# personal data

PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(text):
    out = []
    for kind, p in PATTERNS:
        for m in p.finditer(text or ""):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            ok = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if ok else []
    return ",".join(out)


def said(df):
    return {(r["doc_id"]): ",".join(f"{pii.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["spans"]) for r in df.collect()}


def test_pii_against_brute_force(spark):
    rng = random.Random(3)
    fixed = ["a@b.c_x@y.z", "..d@e.f@g.h", "é a.b+c@d-e.f.g. x", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.2.3", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (234) 567-8900 x +12", "+1+234567890", "", None, "@" * 40, "1" * 3000, "9 " * 200, "a@b.c " * 700, "a.b." * 4000 + "@x.y"]
    made = ["".join(rng.choice("ab1 2.34@+-5()é6_7890%\n") for _ in range(rng.randrange(200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(fixed + made)), "doc_id long, text string")
    got = said(pii.find_personal_data(clash(df)))
    for i, t in enumerate(fixed + made):
        assert got[i] == brute_pii(t), t


def test_pii_revealing_terms(spark):
    filler = ["nothing to see here today"] * 200
    texts = [f"text {i} by Zaphod reach bob@x.org soon now" for i in range(5)] + ["Zaphod, was here too"] + filler
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = said(pii.find_personal_data(df))
    assert got[5] == "term:0:6" and "term:10:16" in got[0] and got[10] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "bob@x.org" not in clean[0] and "[EMAIL]" in clean[0] and "Zaphod" not in clean[0] and clean[10] == texts[10]


def test_pii_empty(none, docs):
    assert pii.find_personal_data(none).count() == 0
    assert pii.find_personal_data(docs).count() == docs.count()


# sharding


def test_sharding(spark, docs):
    rows = sharding.shard(clash(docs)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], sharding.SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(rows) == docs.count()


def test_sharding_against_the_law(spark):
    """Shards by the largest hash of key and shard, slots gapless; most rows without an id, with extra columns of the operator's own names."""
    rows = [(i if i % 4 == 0 else None, f"text {i // 2}", "x") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("__key", "__place", "__bucket", "__base", "__inside", "__sum", "shard")})
    got = sharding.shard(df)
    assert set(got.columns) == set(df.columns) | {"slot", "grown_shard"}
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    tops = [F.shiftrightunsigned(F.xxhash64(key, F.lit(j)), 64 - sharding.HASH_BITS).alias(f"u{j}") for j in range(sharding.SHARDS + 1)]
    slots = defaultdict(list)
    for r in got.select("*", *tops).collect():
        u = [r[f"u{j}"] for j in range(sharding.SHARDS + 1)]
        assert r["shard"] == u.index(max(u[:-1])) and r["grown_shard"] == u.index(max(u))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 600
    assert sharding.shard(df.where("false")).count() == 0


def test_hot_rows_without_an_id_are_dealt_out(spark):
    """Nine tenths of the rows have no id: no (shard, bucket) of the numbering gets more than a small share of them."""
    df = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sharding.BUCKETS))
    assert df.withColumn("shard", sharding.shard_of(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), (1.0,) * 40)).groupBy("shard", place.alias("b")).count().agg(F.max("count")).first()[0] < 80


def test_sharding_weights_and_growth(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    n = Counter(r["shard"] for r in sharding.shard(df, (1.0, 2.0, 5.0), 2.0).collect())
    assert abs(n[2] / 20000 - 5 / 8) < 0.02 and abs(n[1] / 20000 - 2 / 8) < 0.02
    moved = sharding.shard(df, (1.0, 2.0, 5.0), 2.0).where("shard <> grown_shard")
    assert {r[0] for r in moved.select("grown_shard").distinct().collect()} == {3} and abs(moved.count() / 20000 - 0.2) < 0.02


def test_op5(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r, t in zip(sharding.op5_sharding(spark, str(tmp_path)).join(docs.select("doc_id", "text").distinct(), "doc_id").collect(), iter(int, 1)):
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")


def test_numbered_is_gapless_for_one_hot_group(spark):
    df = spark.range(3000).select("id", F.lit(None).cast("string").alias("g"))
    got = sorted(r["position"] for r in numbered(df, ["g"], [F.col("id")], F.col("id") % 37).collect())
    assert got == list(range(3000))


# repeated passages


def test_passages(spark):
    rng = random.Random(5)
    passage = words(rng, 70).split()
    fuzzy = list(passage)
    for k in (20, 45):
        fuzzy[k] = "changed"
    del fuzzy[33]
    rows = [(i, words(rng, 150)) for i in range(30)]
    put = lambda p: f"{words(rng, 40)} {' '.join(p)} {words(rng, 30)}"
    rows += [(100, put(passage)), (101, put(passage)), (102, put(fuzzy).upper()), (103, put(passage[:40])), (104, None), (105, ""), (None, put(passage)), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["first_doc_id"]): r for r in passages.repeated_passages(clash(df)).collect()}
    assert set(got) == {(101, 100), (102, 100), (102, 101)}
    assert got[101, 100]["start"] == 40 and got[101, 100]["end"] == 110 and got[101, 100]["identity"] == 1
    assert abs(got[102, 100]["start"] - 40) <= 1 and got[102, 100]["identity"] >= 0.9
    left = {r["doc_id"]: r["text"] for r in passages.remove_passages(df.where("doc_id > 99")).collect()}
    assert len(left[101].split()) == 70 and len(left[100].split()) == 140 and left[104] is None


@pytest.mark.parametrize("period", [1, 5, 10, 14, 16, 25])
def test_passages_of_periodic_texts(spark, period):
    rng = random.Random(period)
    text = " ".join((words(rng, period).split() * 400)[:400])
    df = spark.createDataFrame([(1, text), (2, text), (3, words(rng, 400))], "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in got} == {(2, 1)}
    assert {k for r in got for k in range(r["start"], r["end"])} == set(range(400))


def test_passages_whose_halves_are_in_smaller_documents(spark):
    rng = random.Random(12)
    passage = words(rng, 60).split()
    put = lambda p: f"{words(rng, 40)} {' '.join(p)} {words(rng, 30)}"
    rows = [(1, put(passage[:30])), (2, put(passage[30:])), (3, put(passage)), (4, put(passage))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["first_doc_id"], r["start"], r["end"]) for r in got] == [(4, 3, 40, 100)]


def test_passages_with_edits(spark):
    rng, rows = random.Random(13), []
    for k in range(100):
        passage = words(rng, 60).split()
        edited = [y for w in passage for y in ([w] if rng.random() >= 0.05 else rng.choice((["changed"], [], [w, "added"])))]
        rows += [(2 * k + i, f"{words(rng, 40)} {' '.join(p)} {words(rng, 30)}") for i, p in enumerate((passage, edited))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r["doc_id"], r["first_doc_id"]) for r in got}
    assert all(a == b + 1 and b % 2 == 0 for a, b in pairs) and len(pairs) >= 80


def test_passages_with_fragments_in_smaller_documents(spark):
    """Passages of 60 words, each also quoted in three smaller documents as fragments of 24 words: the two whole ones are linked."""
    rng, rows, want = random.Random(21), [], set()
    put = lambda p: f"{words(rng, 40)} {' '.join(p)} {words(rng, 30)}"
    for k in range(30):
        passage, base = words(rng, 60).split(), 10 * k
        rows += [(base + i, put(passage[18 * i : 18 * i + 24])) for i in range(3)] + [(base + 3, put(passage)), (base + 4, put(passage))]
        want.add((base + 4, base + 3))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in got} == want


@pytest.mark.parametrize("changed, every", [(False, False), (True, True)])
def test_passages_with_fragments_between_their_documents(spark, changed, every):
    """Of a passage every seed is in fragments in the smallest documents and in those just before the last: the two whole ones are linked."""
    rng, rows, want = random.Random(25), [], set()
    put = lambda p: f"{words(rng, 40)} {' '.join(p)} {words(rng, 30)}"
    for k in range(20):
        passage, base = words(rng, 60).split(), 100 * k
        other = [*passage[:30], "changed", *passage[31:]] if changed else passage
        for lo in (0, 10, 20):
            for n, of in ((0, passage), (20, passage), (30, passage), (40, other), (50, other)):
                rows.append((base + n + lo // 10, put(of[lo : lo + 40])))
        rows += [(base + 10, put(passage)), (base + 90, put(other))]
        want.add((base + 90, base + 10))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), every=every).collect()
    assert sorted((r["doc_id"], r["first_doc_id"]) for r in got) == sorted(want)
    assert all(r["end"] - r["start"] >= 60 for r in got)


def test_passages_of_one_repeated_word(spark):
    """A run of one word within other words, longer than that of the smaller document: all of it is covered."""
    rng = random.Random(27)
    rows = [(d, f"{words(rng, 20 + d)} {'and ' * n}{words(rng, 20)}") for d, n in enumerate((70, 60, 65, 300, 173, 419))]
    found = defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].update(range(r["start"], r["end"]))
    for d, n in ((1, 60), (2, 65), (3, 300), (4, 173), (5, 419)):
        assert set(range(20 + d, 20 + d + n)) <= found[d], d


def test_passages_keep_equal_words_among_unlike_ones(spark):
    """55 equal words between words of which two in seven are changed: with those the two are not alike by 0.8, the equal ones are found."""
    rng, rows = random.Random(26), []
    for k in range(3):
        left, passage, right = words(rng, 120).split(), words(rng, 55).split(), words(rng, 120).split()
        other = [w if i % 7 not in (5, 6) else "changed" for i, w in enumerate(right)]
        back = [w if i % 7 not in (5, 6) else "changed" for i, w in enumerate(left[::-1])][::-1]
        rows += [(2 * k, " ".join(left + passage + right)), (2 * k + 1, " ".join(back + passage + other))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), identity=0.85).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in got} == {(2 * k + 1, 2 * k) for k in range(3)}
    assert all(r["start"] <= 120 and r["end"] >= 175 for r in got)


def local_alignment(a, b):
    """Best local alignment of two word lists, +1 for equal words and -2 for a change, an insertion or a deletion: (score, a start, a end)."""
    best, row = (0, 0, 0), [(0, 0)] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [(0, i + 1)]
        for j, y in enumerate(b):
            s, at = max((row[j][0] + (1 if x == y else -2), row[j][1]), (row[j + 1][0] - 2, row[j + 1][1]), (new[j][0] - 2, new[j][1]), key=lambda c: c[0])
            new.append((s, at) if s > 0 else (0, i + 1))
            best = max(best, (new[-1][0], new[-1][1], i + 1), key=lambda c: c[0])
        row = new
    return best


def test_passages_against_alignment_of_all_pairs(spark):
    """Of every document the words that align with 50 words or more of a smaller one, by brute force over all pairs, are found."""
    rng, rows = random.Random(22), []
    pool = [words(rng, 80).split() for _ in range(5)]
    for d in range(24):
        text = words(rng, 30).split()
        for p in rng.sample(pool, 2):
            lo = rng.randrange(0, 30)
            text += [w if rng.random() >= 0.04 * (d % 3) else "changed" for w in p[lo : lo + rng.choice((20, 55, 70))]] + words(rng, 20).split()
        rows.append((d, " ".join(text)))
    found = defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].update(range(r["start"], r["end"]))
    split, covered, total = [t.split() for _, t in rows], 0, 0
    for d in range(24):
        want = set()
        for e in range(d):
            score, lo, hi = local_alignment(split[d], split[e])
            if hi - lo >= 50 and score >= 0.5 * (hi - lo):
                want.update(range(lo, hi))
        total, covered = total + len(want), covered + len(want & found[d])
    assert total > 300 and covered >= 0.97 * total


def test_no_seed_brings_many_rows_of_a_slice_together(spark):
    """A passage that 300 documents share: rows of one seed that leave a slice are few, and every document is linked."""
    rng = random.Random(23)
    passage = words(rng, 60)
    df = spark.createDataFrame([(i, f"{words(rng, 20)} {passage} {words(rng, 20)}") for i in range(300)], "doc_id long, text string").coalesce(2)
    places = passages.seeds(df.withColumnRenamed("doc_id", "doc")).where(F.col("q") == passages.PLACE)
    assert places.groupBy("h").count().agg(F.max("count")).first()[0] <= 2 * passages.MEET
    got = passages.repeated_passages(df).groupBy("doc_id").agg(F.min("first_doc_id").alias("first")).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 300)) and all(r["first"] < r["doc_id"] for r in got)


def test_passages_of_very_long_texts(spark):
    rng = random.Random(24)
    passage = words(rng, 60)
    rows = [(1, f"{words(rng, 60000)} {passage} {words(rng, 100)}"), (2, f"{words(rng, 50)} {passage} {words(rng, 40000)}")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in got] == [(2, 50, 110)]


def test_chains_against_all_pairs():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 25)
        pts = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(n)})
        p, q = (np.array(x) for x in zip(*pts))
        best = []
        for i in range(len(pts)):
            best.append(1 + max([0] + [best[j] - passages.GAP_COST * (p[i] - p[j] + q[i] - q[j]) for j in range(i) if p[j] < p[i] and q[j] < q[i]]))
        found = passages.chains(p, q)
        assert sorted(k for c in found for k in c.tolist()) == list(range(len(pts)))
        c = found[0]
        score = len(c) - passages.GAP_COST * (p[c[-1]] - p[c[0]] + q[c[-1]] - q[c[0]])
        assert score == pytest.approx(max(best)) and np.all(np.diff(p[c]) > 0) and np.all(np.diff(q[c]) > 0)


def test_passages_empty(none):
    assert passages.repeated_passages(none).count() == 0


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.5, (6000, 16))).astype(np.float32)
    x[1000:3000] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(6000, None), (6050, [0.0] * 16), (6100, [float("nan")] * 16), (6150, [None] * 16), (6200, [1.0] * 3), (None, x[1].tolist()), (6250, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("rank", F.lit("x"))
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, sample=3000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x.astype(np.float64)
    norms = np.linalg.norm(unit, axis=1)
    hits = 0
    assert set(got) == set(range(0, 6000, 50))
    for q in range(0, 6000, 50):
        s = unit @ unit[q] / (norms * norms[q])
        order = [i for i in np.lexsort((np.arange(6000), -np.round(s, 12))) if i != q][:5]
        assert len(got[q]) == 5 and all(abs(s[i] - v) < 1e-12 for i, v in got[q])
        hits += len({i for i, _ in got[q]} & set(order))
        if q < 1000 and q or q >= 3000:
            continue
        assert [i for i, _ in got[q]] == order
    assert hits / 600 >= 0.9


def test_neighbours_of_doubles_and_of_other_lengths(spark):
    """Scores are of the vectors as they are, and each length has its own neighbours."""
    rng = np.random.default_rng(8)
    wide, slim = rng.normal(0, 1, (30, 8)), rng.normal(0, 1, (5, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(wide)] + [(100 + i, v.tolist()) for i, v in enumerate(slim)]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()}
    vectors = dict((i, np.array(v)) for i, v in rows)
    assert len(got) == 5 + 4
    for (q, v), score in got.items():
        a, b = vectors[q], vectors[v]
        assert len(a) == len(b) and score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-15)


def test_neighbours_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# decontamination


def brute_hits(text, items, window=10):
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, names = split(text), set(), set()
    for name, t in items:
        i = split(t)
        n = min(window, len(i))
        grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if i else set()
        for k in range(len(w) - n + 1):
            if grams and tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                names.add(str(name) if name is not None else "")
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_decontamination(spark, docs, limit):
    rows = docs.collect()
    items = [(2, rows[3][1]), (10, " ".join((rows[83][1]).split()[100:140]).upper()), (3, "alpha1"), (4, "Éa, b-c"), (5, None), (6, "..."), (None, "no ID-here"), (2, "no id here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.hits(clash(docs), bench, limit=limit).collect()
    want = [(r[0], *brute_hits(r[1], items)) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_decontamination_removes(spark, docs, none, limit):
    bench = spark.createDataFrame([(1, "no id here"), (2, "alpha1 alpha2 beta3 beta4"), (3, docs.where("doc_id = 83").first()["text"][:200])], "item_id long, text string")
    extra = clash(docs).withColumns({c: F.lit("y") for c in ("__row", "__at", "at", "items", "k", "length")})
    kept = decontamination.decontaminate(extra, bench, limit=limit)
    rows, items = docs.collect(), [tuple(r) for r in bench.collect()]
    want = sorted(str(r["doc_id"]) for r in rows if not brute_hits(r["text"], items)[-1])
    assert kept.columns == extra.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == want and len(want) < len(rows)
    cut = decontamination.decontaminate(extra, bench, remove="spans", limit=limit)
    assert cut.columns == extra.columns and cut.count() == len(rows) and cut.where("doc_id is null").first()["text"].strip() == ""
    for r in cut.where("doc_id is not null").collect():
        before = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        assert (r["text"] is None) == (before is None) and (before is None or len(r["text"].split()) == len(before.split()) - brute_hits(before, items)[1])
    for empty in (decontamination.decontaminate(none, bench, limit=limit), decontamination.hits(none, bench, limit=limit)):
        assert empty.count() == 0
    assert decontamination.decontaminate(docs, bench.where("false"), limit=limit).count() == len(rows)
    assert decontamination.hits(none, bench).count() == 0
    assert decontamination.hits(docs, bench.where("false")).where("contaminated").count() == 0


def test_index_of_a_long_item_is_built_in_linear_time():
    import time

    text = words(random.Random(31), 700_000)
    began = time.time()
    index = decontamination.Index([("a", text), ("b", text[:5000])])
    assert len(text) > 4_000_000 and time.time() - began < 20 and index.nbytes() < 12 * len(text)
    n_words, n_hit, items, _, _ = index.scan(lm_array([text[:3000], "nothing of it at all in here, whatever one may look for"]))
    assert n_hit[0] >= n_words[0] - 1 and items[0] == {0, 1} and not n_hit[1]


def lm_array(texts):
    import pyarrow as pa

    return pa.array(texts, pa.large_string())


def test_decontamination_by_join_removes_rows(spark):
    rows = [(None, "no id here"), (None, "another text"), (1, "no id here"), (1, "clean"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "no id here")], "item_id long, text string")
    want = sorted(map(str, (tuple(r) for r in decontamination.decontaminate(docs, bench).collect())))
    assert want == sorted(map(str, (rows[1], rows[3], rows[4])))
    assert sorted(map(str, (tuple(r) for r in decontamination.decontaminate(docs, bench, limit=0).collect()))) == want


# secrets


def brute_secrets(text):
    text, out = text or "", []
    name = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m.group(2)) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(7)
    fixed = [None, "", "token: abcdef", "TOKEN='abc'", "api_key = \"x.y-z/1+2=\" apikey=123456", "passſword=abcdefg", "AKIA" + "Z" * 16, "xAKIA" + "0" * 15 + "AKIA" + "1" * 30, "g" + "ab12" * 8 + "G", "secret=" * 300]
    made = ["".join(rng.choice(("token", "=", " ", ":", "AKIA", "0Z", "ab1", "deadbeef", "'", "x", "é", "Secret", "api", "key")) for _ in range(40)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(fixed + made)), "doc_id long, text string")
    for r in secrets.find_secrets(clash(df)).collect():
        want = brute_secrets((fixed + made)[r["doc_id"]])
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))


def test_entropy_windows():
    rng = random.Random(8)
    for _ in range(30):
        s = "".join(rng.choice("abcdEFGH0123456789+/") for _ in range(rng.randrange(20, 80)))
        want = set()
        for name, pattern, least in secrets.CLASSES:
            for m in pattern.finditer(s):
                for i in range(m.start(), m.end() - 19):
                    w = s[i : i + 20]
                    h = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
                    upper, lower, digits = (sum(x <= c <= y for c in w) for x, y in ("AZ", "az", "09"))
                    if h >= least - 1e-12 and ((digits and upper + lower) or (upper >= secrets.CASED and lower >= secrets.CASED)):
                        want.update(range(i, i + 20))
        assert {k for a, b in secrets.entropy_spans(s) for k in range(a, b)} == want
    found = secrets.scan("key Zk3J9xQ1vT7bN5mW2cR8pL4y and 123e4567-e89b-12d3-a456-426614174000 2024-01-01T00-00-00-000000 thequickbrownfoxjumpsover")
    assert [(k, s) for s, k, _ in found] == [(3, 4)]


def test_entropy_finds_random_strings_of_any_alphabet():
    rng = random.Random(9)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for alphabet, least in ((letters + letters.upper() + digits, 0.98), (letters + letters.upper() + digits + "+/", 0.95), (letters.upper() + "234567", 0.88), (letters + letters.upper(), 0.88), (digits + "abcdef", 0.95)):
        assert sum(bool(secrets.scan("is " + "".join(rng.choice(alphabet) for _ in range(20)) + ", or")) for _ in range(300)) >= least * 300
    for name in ("getUserNameFromDatabase", "HTTPServerURLHandlerFactory", "thequickbrownfoxjumpsoverthelazydog", "/usr/local/lib/python3/site-packages", "some-long-title-2024-01-02-of-things", "SHOUTING_CONSTANT_NAME_2", "Donaudampfschifffahrtsgesellschaft"):
        assert not secrets.scan(name)


def test_secrets_in_very_long_texts():
    text = "word " * 200_000 + "token: abc1234567 " + "Zk3J9xQ1vT7bN5mW2cR8pL4y"
    assert [secrets.KINDS[k] for _, k, _ in secrets.scan(text)] == ["assign", "entropy"]
    assert len(secrets.entropy_spans("Zk3J9xQ1vT7bN5mW2cR8pL4y" * 4000)) == 1


def test_secrets_empty(none):
    assert secrets.find_secrets(none).count() == 0


def test_stored_and_discard(spark):
    t = stored(spark.range(3).toDF("a"), "x")
    assert t.count() == 3
    discard(t)
    with pytest.raises(Exception):
        spark.read.parquet(t.stored_path)
