"""The language model against loops, its shares, what it trains on, and edges."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_llm import SCHEMA, clash, docs, none, words  # noqa: F401
from tidemark.llm import lm


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


@pytest.fixture(scope="module")
def small(spark, docs):  # noqa: F811
    """The documents prepared twice: all counts on every worker, and 30 of them, the others joined."""
    return {most: lm.prepare(clash(docs), frequent=most) for most in (lm.FREQUENT, 30)}


def test_base_and_held_out(docs, small):  # noqa: F811
    rows = docs.collect()
    got = lm.scored(small[30]).collect()
    assert len(got) == len(rows)
    counts = Counter()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    for r in rows:
        if not held(r[0]):
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        t = tokens(text[r["doc_id"]])
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert r["base_score"] == pytest.approx(want, abs=1e-6)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(counts[w] > 0 for w in t), n, held(r["doc_id"]))
        assert r["score"] < 0


def loop_attention(model, own, offset):
    """Class shares at every token of one text that begins `offset` tokens into its slice."""
    w, vocab = model.w, model.vocab
    x = w["E"][vocab.row[np.concatenate([[len(vocab.row) - 1], own[:-1]])]]
    out = []
    for t in range(len(own)):
        lo = max(0, (offset + t) // lm.STRIDE * lm.STRIDE - (lm.WINDOW - lm.STRIDE) - offset)
        keys = x[lo : t + 1]
        s = (x[t] @ w["Q"]) @ (keys @ w["K"]).T / np.sqrt(lm.WIDTH) + w["R"][t - np.arange(lo, t + 1)]
        p = np.exp(s - s.max())
        h = np.tanh(x[t] @ w["O"] + w["b"] + p / p.sum() @ (keys @ w["V"]))
        z = np.exp(h @ w["U"] + w["c"])
        out.append(z / z.sum())
    return np.array(out)


def test_windows_equal_one_window_a_token(small):
    vocab, enc = small[30].model.vocab, lm.encoder(small[30].ranks.value)
    rng = np.random.default_rng(0)
    w = lm.first_weights()
    w["R"] = rng.normal(0, 1, lm.WINDOW).astype(np.float32)
    model = lm.Model(w, vocab)
    texts = [words(random.Random(n), n) for n in (0, 2, 40, 17, 8)]
    text = small[30].lexicon.value.texts(enc, *lm._words(lm.pa.array(texts, lm.pa.large_string())))
    found, opening = model.attention(text, block=3)
    ask, some = lm.asked(text), Counter()
    for d in range(len(texts)):
        lo, hi = text.first[d : d + 2]
        own, z = text.ids[lo:hi], loop_attention(model, text.ids[lo:hi], lo)
        share = z[:, : lm.OPENING].sum(axis=1)
        for t in range(hi - lo):
            some[ask[lo + t]] += 1
            mine = z[t, vocab.classes[own[t]]]
            want = {0: (1, 1), 1: (mine, share[t]), 2: (mine / share[t], 1)}[ask[lo + t]]
            assert (found[lo + t], opening[lo + t]) == pytest.approx(want, rel=1e-3)
    assert len(some) == 3


def test_scores_against_loops(docs, small):  # noqa: F811
    """Every text word by word from the formula, exactly for a text that begins its slice; where it lies in one decides how far attention looks back."""
    enc, model = lm.encoder(small[30].ranks.value), small[30].model
    v, counts, ends = model.vocab, Counter(), 0
    for r in docs.collect():
        if not held(r[0]):
            counts.update((r[1] or "").lower().split())
            ends += 1
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.scored(small[30]).collect()}
    for r in docs.collect():
        spelled = [enc.words([w])[0].tolist() for w in (r[1] or "").lower().split()]
        own = np.array([i for w in spelled for i in w] + [enc.end])
        z, at, total = loop_attention(model, own, 0), 0, 0.0
        for word, ids in zip([*(r[1] or "").lower().split(), None], [*spelled, [enc.end]]):
            c, k = (ends if word is None else counts[word]), int(v.classes[ids[0]])
            share = max(c - lm.DISCOUNT, 0) / v.total[k]
            if word is not None:
                spell = v.unseen[k] * v.first[ids[0]] * z[at + len(ids), : lm.OPENING].sum()
                for j in range(1, len(ids)):
                    spell *= z[at + j, v.classes[ids[j]]] * v.later[v.classes[ids[j - 1]], v.column[ids[j]]]
                share += spell if c <= lm.SPELLED or word is None else 0
            total += math.log10(z[at, k] / z[at, : lm.OPENING].sum()) + math.log10(share)
            at += len(ids)
        assert got[r[0], len(spelled) + 1] == pytest.approx(total, rel=1e-2)
        alone = small[lm.FREQUENT].lexicon.value.texts(enc, *lm._words(lm._lower(lm.pa.array([r[1] or ""]))))
        group, spell = model.words(alone)
        assert (group + np.log10(10 ** model.known(alone, np.maximum(alone.count, 0)) + 10**spell)).sum() == pytest.approx(total, rel=1e-4)


def test_joined_counts_give_the_same(small):
    """However many counts go to the workers: the scores of one model are the same."""
    p = small[lm.FREQUENT]
    few = lm.Prepared(**{**p.__dict__, "least": small[30].least, "lexicon": small[30].lexicon})
    assert small[30].least > p.least == 0
    want, got = ({(r["doc_id"], r["n_tokens"]): (r["score"], r["n_known"], r["base_score"]) for r in lm.scored(x).collect()} for x in (p, few))
    for key, x in want.items():
        assert got[key] == pytest.approx(x, rel=1e-5)


def test_shares_sum_to_one(docs, small):  # noqa: F811
    v, enc = small[30].model.vocab, lm.encoder(small[30].ranks.value)
    opening, going = np.unique(v.classes[enc.opens]), np.unique(v.classes[~enc.opens])
    assert opening.max() < lm.OPENING <= going.min()
    assert np.allclose(np.bincount(v.classes[enc.opens], weights=v.first[enc.opens])[opening], 1)
    for left in range(lm.CLASSES):
        assert np.allclose(np.bincount(v.classes[~enc.opens], weights=v.later[left])[going], 1, atol=1e-4)
    kept, counts = np.zeros(lm.CLASSES), Counter()
    for r in docs.collect():
        if not held(r[0]):
            counts.update([*(r[1] or "").lower().split(), None])
    for word, c in counts.items():
        kept[v.classes[enc.end if word is None else enc.words([word])[0][0]]] += (c - lm.DISCOUNT) / v.total[v.classes[enc.end if word is None else enc.words([word])[0][0]]]
    assert np.allclose(kept + v.unseen, 1)


def test_runs_cover_every_word_once():
    texts = [[f"w{d}-{k}" for k in range(n)] for d, n in enumerate((0, 1, 5, lm.EVERY, 40, 101))]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen, ends = Counter(), 0
    for turn in range(lm.EVERY):
        got, at, silent = lm.runs(lm.pa.array(sum(texts, []), lm.pa.large_string()), first, turn)
        got = got.to_pylist()
        for k in range(len(at) - 1):
            run, mute = got[at[k] : at[k + 1]], silent[at[k] + k : at[k + 1] + k + 1]
            assert len(mute) == len(run) + 1 and not any(x < y for x, y in zip(mute[:-1], mute[1:-1]))
            own = texts[int(run[0].split("-")[0][1:])] if run else []
            assert sum(mute[:-1]) <= lm.LEAD and run == own[own.index(run[0]) :][: len(run)] if run else True
            assert mute[-1] == (bool(run) and run[-1] != own[-1])
            seen.update(x for x, m in zip(run, mute) if not m)
            ends += not mute[-1]
    assert seen == Counter(sum(texts, [])) and ends == len(texts)


def test_learner_is_silent_where_told(small):
    enc, own = lm.encoder(small[30].ranks.value), small[30].lexicon.value
    text = own.texts(enc, *lm._words(lm.pa.array([words(random.Random(k), 40) for k in range(3)], lm.pa.large_string())))
    learner = lm.Learner(lm.first_weights())
    learner.learn(small[30].model.vocab, text)
    assert learner.learnt == (lm.asked(text) > 0).sum()
    before = {k: v.copy() for k, v in learner.w.items()}
    learner.learn(small[30].model.vocab, text, np.ones(len(text.count), dtype=bool), 0.0)
    assert learner.learnt == (lm.asked(text) > 0).sum() and all(np.array_equal(before[k], v) for k, v in learner.w.items())


def test_learner_follows_the_slope_of_what_is_scored(small):
    enc, own, vocab = lm.encoder(small[30].ranks.value), small[30].lexicon.value, small[30].model.vocab
    text = own.texts(enc, *lm._words(lm.pa.array([words(random.Random(k), 40) for k in range(6)], lm.pa.large_string())))
    assert len(text.ids) <= lm.BATCH * lm.STRIDE
    learner, ask = lm.Learner(lm.first_weights()), lm.asked(text) > 0
    learner.learn(vocab, text, rate=0.0)
    for name in lm.NAMES:
        slope = learner.m[name] / 0.1
        size = float(np.sqrt((slope.astype(np.float64) ** 2).sum()))
        loss = []
        for step in (0.02, -0.02):
            moved = {k: x + np.float32(step / size) * slope if k == name else x for k, x in learner.w.items()}
            loss.append(-np.log(lm.Model(moved, vocab).attention(text)[0][ask]).mean())
        assert abs((loss[0] - loss[1]) / 0.04 / size - 1) < 0.05, name


def test_asked():
    text = lm.Tokens(np.arange(8), np.array([0, 5, 8]), np.array([0, 2, 4, 5, 7, 8]), np.array([1.0, 9.0, 20.0, -1.0, 20.0]), np.array([0, 3, 5]))
    # Words: seen once (two tokens), known (two), end; new text: unseen (two), end.
    assert lm.asked(text).tolist() == [2, 1, 1, 0, 2, 2, 1, 1]


def test_learns_context(spark):
    """Two tongues in texts of their own: after some words the model knows which one it reads, a word unigram does not."""
    rng = random.Random(3)
    tongues = [["".join(rng.choice(x) for _ in range(6)) for _ in range(300)] for x in ("abcde", "stuvw")]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(60)), "en", "a", 0) for i in range(400)]
    got = [r for r in lm.score_texts(spark.createDataFrame(rows, SCHEMA)).collect() if r["held_out"]]
    assert len(got) > 30
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.2  # knowing the tongue for sure is worth log10(2) = 0.30


def test_encoder_lexicon_and_averages():
    enc = lm.encoder(open(lm.TOKENIZER, "rb").read())
    lexicon = lm.Lexicon(lm.pa.array(["cat", "the"], lm.pa.large_string()), np.array([3, 5]), 7, enc)
    for text in ("the cat sat.", "a b c", "", "x" * 5000, "cat\u00a0the \u00a0 the"):
        w, first = lm._words(lm._lower(lm.pa.array([text])))
        got = lexicon.texts(enc, w, first)
        assert got.first.tolist() == [0, len(got.ids)] and got.ids[-1] == enc.end
        assert enc.tokens.decode(got.ids[:-1].tolist()) == "".join(" " + x for x in w.to_pylist())
        assert got.count.tolist() == [{"cat": 3, "the": 5}.get(x, -1) for x in w.to_pylist()] + [7]
        assert got.starts().sum() == len(w) + 1
    a, b = lm.first_weights(1), lm.first_weights(2)
    row = next(lm.averaged(iter([lm._pack(a, 1.0), lm._pack(b, 3.0)])))
    assert np.allclose(np.frombuffer(row.column("U")[0].as_py(), np.float32).reshape(a["U"].shape), a["U"] / 4 + b["U"] * 0.75, atol=1e-6)


def test_empty(spark, none):  # noqa: F811
    assert lm.score_texts(none).count() == 0
    alone = spark.createDataFrame([(next(i for i in range(99) if held(i)), "never trained", "en", "a", 0)], SCHEMA)
    got = lm.score_texts(alone).first()
    assert got["held_out"] and got["train_tokens"] == got["n_known"] == 0 and got["n_tokens"] == 3 and math.isfinite(got["score"])


def test_very_long_text(spark):
    rows = [(0, "kappa " * 400_000 + "y" * 100_000, "en", "a", 0), (1, "kappa", "en", "a", 0)]
    got = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["n_tokens"] == 400_002 and math.isfinite(got[0]["score"]) and got[0]["score"] < got[1]["score"] < 0


def test_rounds_train_on_every_word():
    text = [f"w{k}" for k in range(101)]
    asked = []
    for turn in range(lm.ROUNDS):
        got, at, silent = lm.runs(lm.pa.array(text, lm.pa.large_string()), np.array([0, len(text)]), turn)
        asked += [w for w, quiet in zip(got.to_pylist(), silent) if not quiet]
    assert sorted(asked) == sorted(text)


def test_codes_read_back_as_the_texts(spark, docs, small):  # noqa: F811
    """Words are split and looked up once; what the later passes read gives the same tokens as the texts do."""
    p, enc = small[30], lm.encoder(small[30].ranks.value)
    text = {}
    for r in p.rows.collect():
        text.setdefault(r["doc_id"], []).append(r["text"])
    rows = p.codes[1].collect()
    assert p.codes[0] is p.lexicon and len(rows) == docs.count() == sum(map(len, text.values()))
    table = lm.pa.table({"codes": lm.pa.array([bytes(r["codes"]) for r in rows], lm.pa.binary()), "new": lm.pa.array([r["new"] for r in rows], lm.pa.list_(lm.pa.string()))})
    seen = 0
    for part, codes, new, first in lm.read_codes(table.combine_chunks().to_batches()[0], p.lexicon.value, 1000):
        got = p.lexicon.value.tokens(enc, codes, new, first)
        for d in range(part.num_rows):
            own = [lm._lower(lm.pa.array([t]))[0].as_py().encode().split() for t in text[rows[seen]["doc_id"]]]
            lo, hi = first[d : d + 2]
            names = [*p.lexicon.value.words.to_pylist(), *new.to_pylist()]
            mine = [names[c] for c in codes[lo:hi]]
            assert [w.encode() for w in mine] in own
            spelled = [i for w in mine for i in enc.words([w])[0].tolist()]
            assert got.ids[got.first[d] : got.first[d + 1]].tolist() == [*spelled, enc.end]
            assert [w for w in mine if w not in p.lexicon.value.words.to_pylist()] == rows[seen]["new"]
            seen += 1
    assert seen == len(rows) and any(r["new"] for r in rows)
