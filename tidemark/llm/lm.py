"""Language-model scores: a causal self-attention model over subword ids, and the word unigram base."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, binary, slices, stored, table, utf8

#: Rank file of the public tokenizer, and the pattern that splits text before its merges.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HELD_OUT, FOLDS = 2, 7

#: Width of the model; classes of the next subword, of which the first OPENING are of subwords that open a word.
WIDTH, CLASSES, OPENING = 32, 128, 80
#: Keys of a window, and tokens that it scores: windows start STRIDE tokens apart, and each token is scored in one of them.
WINDOW, STRIDE = 32, 16
#: Ids with an embedding of their own, by frequency; the others share OTHERS rows.
OWN, OTHERS = 4096, 1024
#: Ids that get their class from their neighbours, and hash bins of the neighbours on each side.
CLUSTERED, BINS = 8192, 64
#: Texts for the first weights, at most; the rounds then train on every text: in each round on another run of one word in EVERY, read after
#: LEAD words that are only context. There are as many rounds, so that every word of every text is trained on once; classes come from all words.
WARM_TEXTS = 800
ROUNDS, EVERY, LEAD, BATCH = 2, 2, 6, 128
RATE, SLOWER = 0.02, 150
#: Windows in a row that a batch takes together, so that their common keys are worked out once.
TOGETHER = 8
#: Words whose counts go to every worker; the counts of rarer words are joined.
FREQUENT = 200_000
#: Bytes of text, and words, that are worked on at a time.
SLICE, WORDS = 1 << 21, 1 << 18
#: Taken off the count of every word that has been seen, for words that have not; and how many subwords of any class before weigh as much
#: as those seen after one class.
DISCOUNT, PRIOR = 0.75, 20.0
#: Words seen more often are never spelled: neither is that learnt, nor does it add to their probability.
SPELLED = 2

_encoders: dict[int, Encoder] = {}


class Encoder:
    """A tokenizer for words between white space: a word's subwords are those of the word after one space."""

    def __init__(self, ranks: bytes):
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.tokens = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        #: Ids run from 0; the next free one ends a text, as a word of its own.
        self.end = self.tokens.max_token_value + 1
        self.opens = np.zeros(self.end + 1, dtype=bool)
        self.opens[[i for b, i in merges.items() if b.startswith(b" ")]] = True
        self.opens[self.end] = True

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of each of some words: in one call, cut where a token opens with a space, unless a word has other Unicode space in it."""
        ids = self.tokens.encode_to_numpy(" " + " ".join(words), disallowed_special=()).astype(np.int32) if words else np.zeros(0, np.int32)
        first = np.flatnonzero(self.opens[ids])
        if len(first) != len(words):
            parts = [self.tokens.encode_to_numpy(" " + w, disallowed_special=()) for w in words]
            first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])[:-1].astype(np.int64)
            ids = np.concatenate(parts).astype(np.int32)
        return ids, np.append(first, len(ids))


def encoder(ranks: bytes) -> Encoder:
    """The tokenizer of a rank file, once for each process."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


@dataclass
class Tokens:
    """Texts as subword ids: text i is ids[first[i] : first[i + 1]], its end id included; word j, ends of texts included, begins at begin[j].

    count[j] is how often training has the word, -1 if that is not known here. word[i] : word[i + 1] are the words of text i, its end last.
    """

    ids: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    word: np.ndarray

    def starts(self) -> np.ndarray:
        out = np.zeros(len(self.ids), dtype=bool)
        out[self.begin[:-1]] = True
        return out


class Lexicon:
    """Frequent words with their counts and subword ids."""

    def __init__(self, words: pa.Array, counts: np.ndarray, ends: int, enc: Encoder):
        self.words, self.counts, self.ends = words, counts.astype(np.float64), ends
        self.ids, at = enc.words(words.to_pylist())
        self.at, self.size = at[:-1], np.diff(at)

    def code(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(codes, new): the place of each word in here, or -1 for those that are not; these, in order."""
        coded = words.dictionary_encode()
        here = np.asarray(pc.index_in(coded.dictionary, value_set=self.words).fill_null(-1)).astype(np.int32)
        codes = here[np.asarray(coded.indices)]
        return codes, words.filter(pa.array(codes < 0))

    def numbered(self, codes: np.ndarray, new: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(codes, distinct new words): new words count on from the words in here."""
        coded, codes = new.dictionary_encode(), codes.copy()
        codes[codes < 0] = len(self.size) + np.asarray(coded.indices)
        return codes, coded.dictionary

    def tokens(self, enc: Encoder, codes: np.ndarray, new: pa.Array, first: np.ndarray) -> Tokens:
        """Tokens of texts given by their words' numbers, see numbered(). New words among them are encoded once each."""
        n = len(self.size)
        used = np.unique(codes[codes >= n]) - n
        ids, at = enc.words(new.take(pa.array(used)).to_pylist())
        begin, size, count = np.zeros(n + len(new) + 1, np.int64), np.zeros(n + len(new) + 1, np.int64), np.full(n + len(new) + 1, -1.0)
        begin[:n], size[:n], count[:n] = self.at, self.size, self.counts
        begin[n + used], size[n + used] = at[:-1] + len(self.ids), np.diff(at)
        begin[-1], size[-1], count[-1] = len(self.ids) + len(ids), 1, self.ends
        flat = np.concatenate([self.ids, ids, [np.int32(enc.end)]])
        index = np.insert(codes, first[1:], len(begin) - 1)
        sizes = size[index]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        spot = np.repeat(begin[index] - upto[:-1], sizes)
        spot += np.arange(upto[-1])
        word = first + np.arange(len(first))
        return Tokens(flat[spot], upto[word], upto, count[index], word)

    def texts(self, enc: Encoder, words: pa.Array, first: np.ndarray) -> Tokens:
        """Tokens of texts given by their words."""
        return self.tokens(enc, *self.numbered(*self.code(words)), first)


def runs(words: pa.Array, first: np.ndarray, turn: int, every: int = EVERY) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, first, silent) of a run of words of each text: of its `every` runs that one which is in turn, after at most LEAD words before it.

    Over all turns each word is in one run. silent tells of each word, ends included, whether it is context only; the end counts with the last.
    """
    n = np.diff(first)
    each = -(-n // every)
    lo = np.minimum((turn + np.arange(len(n))) % every * each, n)
    hi = np.minimum(lo + each, n)
    mine = np.flatnonzero((hi > lo) | ((n == 0) & ((turn + np.arange(len(n))) % every == 0)))
    lo, hi, n, base = lo[mine], hi[mine], n[mine], first[:-1][mine]
    lead = np.minimum(lo, LEAD)
    upto = np.concatenate([[0], np.cumsum(hi - lo + lead)])
    at = np.repeat(base + lo - lead - upto[:-1], np.diff(upto)) + np.arange(upto[-1])
    word = upto + np.arange(len(upto))
    silent = np.arange(word[-1]) < np.repeat(word[:-1] + lead, np.diff(word))
    silent[word[1:] - 1] = hi < n
    return words.take(pa.array(at)), upto, silent


class Vocabulary:
    """What is known of ids and words before attention: embedding row and class of every id, and shares within the classes from the counts.

    A word's class is that of its first id. Of a class's occurrences a word that has been seen c times has max(c - DISCOUNT, 0) / total, and
    `unseen` is left for spelling. A spelled word's first id has `first` of its class; a later id has `later` of its class, by the class of
    the id before. The shares of spelled words count every distinct word once, as a word that is still to be seen is most like a rare one.
    """

    def __init__(self, counts: np.ndarray, classes: np.ndarray, opens: np.ndarray, total: np.ndarray, kept: np.ndarray, firsts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]):
        n = len(counts)
        self.row = (OWN + np.arange(n) % OTHERS).astype(np.int32)
        top = np.argsort(-counts, kind="stable")[:OWN]
        self.row[top] = np.arange(len(top))
        self.classes = classes.astype(np.int16)
        self.total = np.maximum(total, 1.0)
        self.unseen = np.where(total > 0, 1 - kept / self.total, 1.0)
        firsts = np.where(opens, firsts + 0.5, 0.0)
        self.first = firsts / np.maximum(np.bincount(classes, weights=firsts, minlength=CLASSES)[classes], 1e-9)
        left, ids, seen = pairs
        later = np.where(opens, 0.0, np.bincount(ids, weights=seen, minlength=n) + 0.5)
        later /= np.maximum(np.bincount(classes, weights=later, minlength=CLASSES)[classes], 1e-9)
        #: Column of every id that goes on with a word in the table `later`, of a row for each class before.
        self.column = np.where(opens, 0, np.cumsum(~opens) - 1)
        going = np.flatnonzero(~opens)
        table = np.zeros((CLASSES, len(going)))
        table[left, self.column[ids]] = seen
        whole = np.zeros((CLASSES, CLASSES))
        np.add.at(whole, (left, classes[ids]), seen)
        self.later = ((table + PRIOR * later[going]) / (whole[:, classes[going]] + PRIOR)).astype(np.float32)


def neighbour_counts(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashed counts of what stands before and after each clustered id; place[id] is its row, -1 for the others."""
    rows = int(place.max()) + 1
    bins = ((np.arange(len(place)) * 2654435761 % (1 << 32)) >> 20) % BINS
    out = np.zeros(rows * 2 * BINS)
    for mid, other, at in ((ids[1:], ids[:-1], 0), (ids[:-1], ids[1:], BINS)):
        ok = place[mid] >= 0
        out += np.bincount(place[mid[ok]] * 2 * BINS + at + bins[other[ok]], minlength=len(out))
    return out.reshape(rows, 2 * BINS)


def token_classes(neighbours: np.ndarray, clustered: np.ndarray, counts: np.ndarray, opens: np.ndarray, seed: int = 3) -> np.ndarray:
    """A class for each id: k-means on the neighbours of clustered ids, apart for ids that open a word and ids that go on; others by number."""
    rng = np.random.default_rng(seed)
    number = np.arange(len(opens))
    out = np.where(opens, number % OPENING, OPENING + number % (CLASSES - OPENING))
    for mine, base, size in ((opens[clustered], 0, OPENING), (~opens[clustered], OPENING, CLASSES - OPENING)):
        ids, x = clustered[mine], neighbours[mine]
        if not len(ids):
            continue
        x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
        weight = np.sqrt(counts[ids])
        centres = x[:size] + rng.normal(0, 1e-6, x[:size].shape)
        for _ in range(15):
            near = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
            mass = np.bincount(near, weights=weight, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x * weight[:, None])
            centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres)
        out[ids] = base + near
    return out


NAMES = ("E", "Q", "K", "V", "O", "b", "U", "c", "R")


def first_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = WIDTH
    shapes = {"E": (OWN + OTHERS, d), "Q": (d, d), "K": (d, d), "V": (d, d), "O": (d, d), "b": (d,), "U": (d, CLASSES), "c": (CLASSES,), "R": (WINDOW,)}
    scale = {"E": 0.5, "Q": 0.3, "K": 0.3, "V": 0.3, "O": 0.5, "U": 0.3}
    return {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}


_back = np.arange(STRIDE)[:, None] + (WINDOW - STRIDE) - np.arange(WINDOW)[None, :]
_causal = np.where(_back >= 0, 0.0, -1e4).astype(np.float32)
_lag = np.clip(_back, 0, WINDOW - 1)
#: Sums are products with ones, which is faster.
_ones = np.ones(max(BATCH * STRIDE, CLASSES, WINDOW, WIDTH), np.float32)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, texts' starts, windows at a border) for n tokens: window i has the keys of places[i], its last STRIDE are scored."""
    n = int(first[-1])
    count = -(-n // STRIDE)
    places = np.arange(count)[:, None] * STRIDE - (WINDOW - STRIDE) + np.arange(WINDOW)[None, :]
    begin = np.repeat(first[:-1], np.diff(first))
    begin = np.concatenate([begin, np.full(count * STRIDE - n, n)])
    # A window needs the mask of its texts if one of its queries' texts begins within it or its keys run off an end.
    border = np.flatnonzero((begin.reshape(-1, STRIDE)[:, -1] > places[:, 0]) | (places[:, 0] < 0) | (places[:, -1] >= n))
    return places, begin, border


def _inputs(ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """What is read before each token: the token before it, or the end id at a text's start."""
    out = np.concatenate([[end], ids[:-1]])
    out[first[:-1][first[:-1] < len(out)]] = end
    return out


def asked(text: Tokens) -> np.ndarray:
    """What the model is asked at each token: 2 which opening class comes, as the word before is known whole; 1 which class at all, after and
    within words that may be spelled; 0 nothing, within words that are known."""
    spelled = text.count <= SPELLED
    spelled[text.word[1:] - 1] = False
    out = np.repeat(spelled, np.diff(text.begin)).astype(np.int8)
    out[text.begin[:-1]] = 2
    after = text.begin[1:-1][spelled[:-1]]
    out[after] = 1
    out[text.first[:-1]] = 2
    return out


class Learner:
    """Adam on the class cross-entropy, over windows of texts as they come.

    All weights but the embeddings lie in one array, and so do their moments. Embeddings that a batch does not read still move by their decaying
    moments; a row makes up for those steps when it is read next, or at the end of learn().
    """

    def __init__(self, w: dict[str, np.ndarray]):
        (self.flat, self.w), (self.flat_m, self.m), (self.flat_v, self.v), (self.flat_g, self.g) = (self._parts() for _ in range(4))
        for name in NAMES:
            self.w[name][...] = w[name]
        self.step = self.learnt = 0
        #: Of each row: the step up to which its moments are, how a step without it shrinks m / sqrt(v) since, and the paces of those steps, so weighed.
        self.last, self.shrunk, self.owed = np.zeros(OWN + OTHERS, np.int64), np.ones(OWN + OTHERS), np.zeros(OWN + OTHERS)

    @staticmethod
    def _parts() -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(array, weights by name that are views of it, but for E)."""
        d = WIDTH
        flat = np.zeros(4 * d * d + d * CLASSES + d + CLASSES + WINDOW, np.float32)
        q, k, o, v, u, b, c, r = np.split(flat, np.cumsum([d * d] * 4 + [d * CLASSES, d, CLASSES]))
        square = {name: x.reshape(d, d) for name, x in zip("QKOV", (q, k, o, v))}
        return flat, {"E": np.zeros((OWN + OTHERS, d), np.float32), **square, "U": u.reshape(d, CLASSES), "b": b, "c": c, "R": r}

    def _current(self, read: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(embeddings, m, v) of some rows as they are after all steps up to now."""
        gone = (self.step - self.last[read])[:, None]
        e, m, v = self.w["E"][read], self.m["E"][read], self.v["E"][read]
        by = np.sqrt(v)
        by += np.float32(1e-7)
        np.divide(m, by, out=by)
        by *= self.owed[read].astype(np.float32)[:, None]
        e -= by
        m *= np.power(0.9, gone).astype(np.float32)
        v *= np.power(0.99, gone).astype(np.float32)
        self.last[read], self.shrunk[read], self.owed[read] = self.step, 1.0, 0.0
        return e, m, v

    def _update(self, read: np.ndarray, e: np.ndarray, m: np.ndarray, v: np.ndarray, sums: np.ndarray, rate: float) -> None:
        """One step of Adam: of the rows that were read, given as they are now with their gradients, and of all weights but the embeddings."""
        self.step += 1
        pace = rate / (1 + self.step / SLOWER)
        fast, slow = pace / (1 - 0.9**self.step), 1 / (1 - 0.99**self.step)
        self.shrunk *= 0.9 / 0.99**0.5
        self.owed += self.shrunk * (fast / slow**0.5)
        self.last[read], self.shrunk[read], self.owed[read] = self.step, 1.0, 0.0
        for w, m, v, got in ((e, m, v, sums), (self.flat, self.flat_m, self.flat_v, self.flat_g)):  # noqa: B020
            m *= np.float32(0.9)
            v *= np.float32(0.99)
            by = got * got
            by *= np.float32(0.01)
            v += by
            got *= np.float32(0.1)
            m += got
            np.multiply(v, np.float32(slow), out=by)
            np.sqrt(by, out=by)
            by += np.float32(1e-7)
            np.divide(m, by, out=by)
            by *= np.float32(fast)
            w -= by

    def learn(self, vocab: Vocabulary, text: Tokens, silent: np.ndarray | None = None, rate: float = RATE) -> None:
        """One pass over the windows of some texts; of `silent` words nothing is asked."""
        ids, w, g, d = text.ids, self.w, self.g, WIDTH
        if not len(ids):
            return
        rows, ask = vocab.row[_inputs(ids, text.first, len(vocab.row) - 1)], asked(text)
        if silent is not None:
            ask[np.repeat(silent, np.diff(text.begin))] = 0
        self.learnt += int((ask > 0).sum())
        places, begin, border = windows(text.first)
        # Runs of TOGETHER windows with the STRIDE tokens before them; what lies outside is not asked.
        size, lead = TOGETHER * STRIDE, WINDOW - STRIDE
        count = -(-len(places) // TOGETHER)
        after = count * size - len(ids)
        rows = np.concatenate([np.zeros(lead, rows.dtype), rows, np.zeros(after, rows.dtype)]).astype(np.uint16 if OWN + OTHERS <= 1 << 16 else np.int32)
        ask, target = (np.concatenate([x, np.zeros(after, x.dtype)]).reshape(count, size) for x in (ask, vocab.classes[ids].astype(np.int64)))
        crossed = np.zeros(count * TOGETHER, dtype=bool)
        crossed[border] = True
        crossed = crossed.reshape(count, TOGETHER)
        order = np.random.default_rng(len(ids)).permutation(count)
        scale = np.float32(d**-0.5)
        for lo in range(0, count, BATCH // TOGETHER):
            batch = order[lo : lo + BATCH // TOGETHER]
            n = len(batch)
            at = rows[(batch[:, None] * size + np.arange(size + lead)).ravel()]
            by = np.argsort(at, kind="stable")
            sorted_at = at[by]
            heads = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
            #: Embeddings that the batch reads; the gradient of the others is 0.
            read = sorted_at[heads]
            e, m, v = self._current(read)
            w["E"][read] = e
            x = w["E"][at].reshape(n, size + lead, d)
            near = np.lib.stride_tricks.as_strided(x, (n, TOGETHER, WINDOW, d), (x.strides[0], STRIDE * x.strides[1], *x.strides[1:]), writeable=False)
            what = ask[batch].ravel()
            kinds = [np.flatnonzero(what == kind) for kind in (1, 2)]
            some = np.concatenate(kinds)
            mine = some + (some // size + 1) * lead
            own = x.reshape(-1, d)[mine]
            # Only queries are multiplied by matrices: q K' x' = (x Q K') x', and p (x V) = (p x) V.
            qk = w["Q"] @ w["K"].T * scale
            q = np.zeros((n, TOGETHER, STRIDE, d), np.float32)
            q.reshape(-1, d)[some] = own @ qk
            p = q @ near.transpose(0, 1, 3, 2)
            p += w["R"][_lag] + _causal
            run, window = np.nonzero(crossed[batch])
            if len(run):
                edge = batch[run] * TOGETHER + window
                p[run, window] += np.where(places[edge][:, None, :] >= begin.reshape(-1, STRIDE)[edge][:, :, None], 0.0, -1e4).astype(np.float32)
            np.minimum(p, 60, out=p)  # sums of 32 such exponentials are finite
            np.exp(p, out=p)
            whole = (p.reshape(-1, WINDOW) @ _ones[:WINDOW])[some][:, None]
            seen = (p @ near).reshape(-1, d)[some]
            seen /= whole
            h = seen @ w["V"]
            h += own @ w["O"]
            h += w["b"]
            np.tanh(h, out=h)
            self.flat_g[:] = 0
            y, dz, share = target[batch].ravel(), np.empty_like(h), np.float32(1 / max(1, len(some)))
            for kind, first, width in zip(kinds, (0, len(kinds[0])), (CLASSES, OPENING)):
                part = slice(first, first + len(kind))
                dl = h[part] @ w["U"][:, :width]
                dl += w["c"][:width]
                np.minimum(dl, 60, out=dl)
                np.exp(dl, out=dl)
                dl *= (share / (dl @ _ones[:width]))[:, None]
                dl[np.arange(len(kind)), y[kind]] -= share
                g["U"][:, :width] += h[part].T @ dl
                g["c"][:width] += _ones[: len(kind)] @ dl
                np.matmul(dl, w["U"][:, :width].T, out=dz[part])
            h *= h
            np.subtract(1, h, out=h)
            dz *= h
            np.matmul(_ones[: len(some)], dz, out=g["b"])
            np.matmul(own.T, dz, out=g["O"])
            np.matmul(seen.T, dz, out=g["V"])
            down = dz @ w["V"].T
            down /= whole
            seen *= down
            both, ahead = np.zeros((n, TOGETHER, 2 * STRIDE, d), np.float32), np.zeros(n * size, np.float32)
            both[:, :, :STRIDE] = q
            spot = some + (some // STRIDE + 1) * STRIDE
            both.reshape(-1, d)[spot], ahead[some] = down, seen @ _ones[:d]
            # Of both, by what they are multiplied with: of the scores, then of the weights.
            back = np.empty((n, TOGETHER, 2 * STRIDE, WINDOW), np.float32)
            ds = back[:, :, :STRIDE]
            np.matmul(both[:, :, STRIDE:], near.transpose(0, 1, 3, 2), out=ds)
            ds -= ahead.reshape(n, TOGETHER, STRIDE, 1)
            ds *= p
            back[:, :, STRIDE:] = p
            g["R"][:] = np.bincount(_lag.ravel(), weights=_ones[: n * TOGETHER] @ ds.reshape(n * TOGETHER, -1), minlength=WINDOW)
            dq = (ds @ near).reshape(-1, d)[some]
            dqk = own.T @ dq
            dqk *= scale
            np.matmul(dqk, w["K"], out=g["Q"])
            np.matmul(dqk.T, w["Q"], out=g["K"])
            # A window's first half are the keys before its STRIDE tokens, which also get what comes to them as queries.
            spread = back.transpose(0, 1, 3, 2) @ both
            dx = np.zeros((n, TOGETHER + 1, STRIDE, d), np.float32)
            dq = dq @ qk.T
            dq += dz @ w["O"].T
            dx.reshape(-1, d)[mine] = dq
            dx[:, :-1] += spread[:, :, :STRIDE]
            dx[:, 1:] += spread[:, :, STRIDE:]
            dx = dx.reshape(-1, d)
            self._update(read, e, m, v, np.add.reduceat(dx[by], heads, axis=0), rate)
            w["E"][read], self.m["E"][read], self.v["E"][read] = e, m, v
        every = np.arange(OWN + OTHERS)
        w["E"][:], self.m["E"][:], self.v["E"][:] = self._current(every)


class Model:
    """The trained model with the tables that scoring gathers from."""

    def __init__(self, w: dict[str, np.ndarray], vocab: Vocabulary):
        self.vocab, self.w = vocab, w
        #: What each embedding gives as a query, of the keys as they are, and on its own: x Q (x' K)' = (x Q K') x'.
        self.query, self.own = w["E"] @ (w["Q"] @ w["K"].T * np.float32(WIDTH**-0.5)), w["E"] @ w["O"] + w["b"]
        self.bias = np.where(_back >= 0, w["R"][np.clip(_back, 0, WINDOW - 1)], 0).astype(np.float32) + _causal

    def attention(self, text: Tokens, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(share of each token's class, share of all opening classes), by masked attention: every token once, in blocks of windows.

        Where asked() is 2 the first is the share among the opening classes and the second 1; where it is 0 both are 1.
        """
        ids, first, ask = text.ids, text.first, asked(text)
        w, rows, target = self.w, self.vocab.row[_inputs(ids, first, len(self.vocab.row) - 1)], self.vocab.classes[ids].astype(np.int64)
        places, begin, border = windows(first)
        begin = begin.reshape(-1, STRIDE)
        n, lead = len(places) * STRIDE, WINDOW - STRIDE
        rows = np.concatenate([np.zeros(lead, rows.dtype), rows, np.zeros(n - len(rows), rows.dtype)])
        found, opening = np.ones(len(ids)), np.ones(len(ids))
        # The last row of a kind's matrix is its bias. Hidden values are within 1, so that few models need a limit before exp().
        kinds = [(np.flatnonzero(ask == kind), np.vstack([w["U"][:, :width], w["c"][:width]])) for kind, width in ((1, CLASSES), (2, OPENING))]
        high = float(np.abs(kinds[0][1]).sum(axis=0).max()) > 60
        sums = np.ones((CLASSES, 2), np.float32)
        sums[OPENING:, 1] = 0
        for lo in range(0, len(places), block):
            hi = min(len(places), lo + block)
            at = rows[lo * STRIDE : hi * STRIDE + lead]
            # Windows overlap: each token is looked up once, and the windows are views of that.
            x, at = w["E"][at], at[lead:]
            near = np.lib.stride_tricks.as_strided(x, (hi - lo, WINDOW, WIDTH), (STRIDE * x.strides[0], *x.strides), writeable=False)
            s = self.query[at].reshape(-1, STRIDE, WIDTH) @ near.transpose(0, 2, 1)
            s += self.bias
            edge = border[np.searchsorted(border, lo) : np.searchsorted(border, hi)]
            if len(edge):
                s[edge - lo] += np.where(places[edge][:, None, :] >= begin[edge][:, :, None], 0.0, -1e4).astype(np.float32)
            np.minimum(s, 60, out=s)  # sums of 32 such exponentials are finite
            np.exp(s, out=s)
            seen, whole = (s @ near).reshape(-1, WIDTH), s.reshape(-1, WINDOW) @ _ones[:WINDOW]
            for spots, u in kinds:
                mine = spots[np.searchsorted(spots, lo * STRIDE) : np.searchsorted(spots, hi * STRIDE)]
                own = mine - lo * STRIDE
                h = seen[own]
                h /= whole[own][:, None]
                h = h @ w["V"]
                h += self.own[at[own]]
                hidden = np.ones((len(mine), WIDTH + 1), np.float32)
                np.tanh(h, out=hidden[:, :WIDTH])
                z = hidden @ u
                if high:
                    np.minimum(z, 60, out=z)
                np.exp(z, out=z)
                every, some = (z @ sums[: z.shape[1]]).T
                found[mine] = z[np.arange(len(z)), target[mine]] / every
                if z.shape[1] > OPENING:
                    opening[mine] = some / every
        return np.maximum(found, 1e-30), np.maximum(opening, 1e-30)

    def words(self, text: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(class, spell) of each word, in log10: the share of its class at its start, and the share of the class that spelling gives it, which
        is -inf for words known to be seen more than SPELLED times.

        What the counts give a word comes on top, see known(): log10(10 ** known + 10 ** spell).
        """
        v, ids, at = self.vocab, text.ids, text.begin[:-1]
        if not len(ids):
            return np.zeros(0), np.zeros(0)
        found, opening = self.attention(text)
        later = np.log10(found * v.later[v.classes[np.concatenate([ids[:1], ids[:-1]])], v.column[ids]])
        later[at] = 0
        sums = np.concatenate([[0.0], np.cumsum(later)])
        stop = np.append(np.log10(opening), 0.0)[text.begin[1:]]
        ends = text.word[1:] - 1
        stop[ends] = 0  # nothing goes on after an end
        first, of = ids[at], v.classes[ids[at]]
        spell = np.log10(v.unseen[of] * v.first[first]) + sums[text.begin[1:]] - sums[at] + stop
        known = text.count > SPELLED
        known[ends] = False
        spell[known] = -np.inf
        return np.log10(found[at]) - np.log10(opening[at]), spell

    def known(self, text: Tokens, count: np.ndarray) -> np.ndarray:
        """log10 of the share of its class that its count gives each word; -inf for 0."""
        of = self.vocab.classes[text.ids[text.begin[:-1]]]
        with np.errstate(divide="ignore"):
            return np.log10(np.maximum(count - DISCOUNT, 0) / self.vocab.total[of])


def _lower(column: pa.Array) -> pa.Array:
    data, offsets = utf8(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(LOWER[data]))


def _words(lower: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, first word of each text)."""
    lists = pc.ascii_split_whitespace(lower)
    words = lists.flatten()
    keep = np.asarray(pc.not_equal(words, ""))
    bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    return words.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[bounds]


def coded(rows: DataFrame, lexicon) -> DataFrame:
    """rows (doc_id, text, held_out) with their words instead of the text, split and looked up once for all passes to come: `codes` of
    Lexicon.code(), four bytes each, and `new`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, first = _words(_lower(part.column(1)))
                codes, new = lexicon.value.code(words)
                upto = np.concatenate([[0], np.cumsum(codes < 0)])[first]
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first * 4), pa.py_buffer(codes)])
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), new.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), packed.cast(pa.binary()), lists], names=["doc_id", "held_out", "codes", "new"])

    out = rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, codes binary, new array<string>")
    return stored(out, "lm-codes")


def read_codes(batch: pa.RecordBatch, lexicon: Lexicon, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray]]:
    """(rows, codes, new words, first word of each text), see Lexicon.numbered(), of runs of rows with about `limit` words."""
    for part in slices(batch, "codes", 4 * limit):
        packed, lists = (part.column(part.schema.get_field_index(name)) for name in ("codes", "new"))
        data, offsets = binary(packed)
        yield part, *lexicon.numbered(data.view(np.int32), lists.flatten().cast(pa.large_string())), offsets // 4


def gathered(train_rows: DataFrame) -> DataFrame:
    """(word, c): counts of the words over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [pc.value_counts(_words(_lower(part.column(0)))[0]) for part in slices(batch, "text", 1 << 20)]
            got = pa.table({"word": pa.chunked_array([h.field(0) for h in held], pa.large_string()), "c": pa.chunked_array([h.field(1) for h in held], pa.int64())})
            got = got.group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])
            yield from got.set_column(0, "word", got.column("word").cast(pa.string())).to_batches(1 << 16)

    return train_rows.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _size(count: str) -> Column:
    return F.floor(F.log(F.greatest(F.col(count), F.lit(1))) * 20)


def _least(rows: DataFrame, count: str, most: int) -> int:
    """The smallest _size(count) such that at most `most` rows reach it."""
    least, held = 0, 0
    for r in sorted(rows.groupBy(_size(count).alias("b")).count().collect(), key=lambda r: -r["b"]):  # some hundred rows, whatever the corpus
        if held + r["count"] > most:
            return r["b"] + 1
        held += r["count"]
    return least


def _merged(rows: DataFrame, merge, schema: str, name: str) -> list:
    """The one row (or none) that merge(batches) makes of all rows, in a tree: 16 rows meet in a task at most, and one comes to the driver."""
    rows = stored(rows, name)
    parts = rows.count()
    while parts > 1:
        parts = -(-parts // 16)
        rows = stored(rows.repartition(parts).mapInArrow(merge, schema), name)
    return rows.collect()


def neighbours(train_codes: DataFrame, place: np.ndarray, lexicon, ranks) -> np.ndarray:
    """neighbour_counts() over every training text."""
    spark = train_codes.sparkSession
    shared = spark.sparkContext.broadcast(place)
    size = (int(place.max()) + 1, 2 * BINS)

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.astype(np.float32).tobytes(), 1)], pa.binary())], names=["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoder(ranks.value), np.zeros(size)
        for batch in batches:
            for _, *words in read_codes(batch, lexicon.value, WORDS // 4):
                total += neighbour_counts(lexicon.value.tokens(enc, *words).ids, shared.value)
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.float32).reshape(size)
        yield packed(total)

    got = _merged(train_codes.select("codes", "new").mapInArrow(run, "n binary"), add, "n binary", "lm-neighbours")
    return np.frombuffer(zlib.decompress(got[0][0]), np.float32).reshape(size).astype(np.float64) if got else np.zeros(size)


def word_shares(words: DataFrame, classes: np.ndarray, ranks) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sums over all distinct words (word, c) by class or id, as (cell, sum): `total` and `kept` occurrences by class, `firsts` distinct words by
    first id, `pairs` distinct words by later id and the class before it (cell: class * ids + id). At most CLASSES cells for each id."""
    shared = words.sparkSession.sparkContext.broadcast(classes)
    names = ("total", "kept", "firsts", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, classes = encoder(ranks.value), shared.value
        for batch in batches:
            ids, first = enc.words(batch.column(0).to_pylist())
            c, start = np.asarray(batch.column(1)).astype(np.float64), first[:-1]
            of = classes[ids[start]]
            inner = np.ones(len(ids), dtype=bool)
            inner[start] = False
            at = np.flatnonzero(inner)
            pair, seen = np.unique(classes[ids[at - 1]].astype(np.int64) * len(classes) + ids[at], return_counts=True)
            sums = [np.bincount(of, weights=c, minlength=CLASSES), np.bincount(of, weights=np.maximum(c - DISCOUNT, 0), minlength=CLASSES), np.bincount(ids[start], minlength=len(classes))]
            cells = [(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in sums] + [(pair, seen)]
            what = np.repeat(np.arange(4), [len(x[0]) for x in cells])
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), pa.array(np.concatenate([x[0] for x in cells]), pa.int64()), pa.array(np.concatenate([x[1] for x in cells]), pa.float64())], names=["what", "cell", "n"])

    got = words.select("word", "c").mapInArrow(run, "what int, cell long, n double").groupBy("what", "cell").agg(F.sum("n").alias("n")).toPandas()
    return {name: (got.loc[got["what"] == k, "cell"].to_numpy(), got.loc[got["what"] == k, "n"].to_numpy()) for k, name in enumerate(names)}


def vocabulary(train_codes: DataFrame, words: DataFrame, lexicon, ends: int, ranks) -> Vocabulary:
    """Classes from the neighbours of subwords in every training text, shares within them from all distinct words."""
    enc, own = encoder(ranks.value), lexicon.value
    counts = np.bincount(own.ids, weights=np.repeat(own.counts, own.size), minlength=enc.end + 1)
    counts[enc.end] = ends
    clustered = np.argsort(-counts, kind="stable")[:CLUSTERED]
    clustered = clustered[counts[clustered] > 0]
    classes = np.where(enc.opens, 0, OPENING)
    if len(clustered):
        place = np.full(enc.end + 1, -1)
        place[clustered] = np.arange(len(clustered))
        classes = token_classes(neighbours(train_codes, place, lexicon, ranks), clustered, counts, enc.opens)
    got = word_shares(words, classes, ranks)
    dense = lambda name, size: np.bincount(got[name][0], weights=got[name][1], minlength=size)
    total, kept = dense("total", CLASSES), dense("kept", CLASSES)
    total[classes[enc.end]] += ends
    kept[classes[enc.end]] += max(ends - DISCOUNT, 0)
    pair, seen = got["pairs"]
    return Vocabulary(counts, classes, enc.opens, total, kept, dense("firsts", enc.end + 1), (pair // len(classes), pair % len(classes), seen))


def _pack(w: dict[str, np.ndarray], weight: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([weight]), *[pa.array([w[k].tobytes()], pa.binary()) for k in NAMES]], names=["weight", *NAMES])


_PACKED = "weight double, " + ", ".join(f"{k} binary" for k in NAMES)


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the mean of the weights of all rows, by how much each was trained on."""
    total, sums, like = 0.0, None, first_weights()
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("weight")[i].as_py()
            if n:
                w = [np.frombuffer(batch.column(k)[i].as_py(), np.float32).astype(np.float64) * n for k in NAMES]
                total, sums = total + n, w if sums is None else [a + b for a, b in zip(sums, w)]
    if sums is not None:
        yield _pack({k: (s / total).astype(np.float32).reshape(like[k].shape) for k, s in zip(NAMES, sums)}, total)


def fit(train_rows: DataFrame, train_codes: DataFrame, vocab: Vocabulary, lexicon, ranks) -> Model:
    """The model of training texts (key, text), which are the same as train_codes: first weights from WARM_TEXTS texts, then ROUNDS rounds in which every partition trains on
    runs of all its texts, others in each round, and the weights are averaged by what was asked."""
    spark, enc = train_rows.sparkSession, encoder(ranks.value)
    warm = train_rows.where("text is not null").select("key").orderBy(F.xxhash64("key"), "key").limit(WARM_TEXTS)
    texts = train_rows.join(F.broadcast(warm.distinct()), "key", "left_semi").select("key", "text").limit(2 * WARM_TEXTS).collect()
    texts = [r["text"] for r in sorted(texts, key=lambda r: (r["key"], r["text"]))]
    first = Learner(first_weights())
    for lo in range(0, len(texts), 100):
        first.learn(vocab, lexicon.value.texts(enc, *_words(_lower(pa.array(texts[lo : lo + 100], pa.large_string())))))
    w = first.w
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((w, vocab))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            enc, (w, vocab) = encoder(ranks.value), shared.value
            own = Learner(w)
            for batch in batches:
                for _, codes, new, first in read_codes(batch, lexicon.value, EVERY * WORDS // 4):
                    codes, first, silent = runs(pa.array(codes), first, turn)
                    own.learn(vocab, lexicon.value.tokens(enc, np.asarray(codes), new, first), silent, RATE / (2 << turn))
            if own.learnt:
                yield _pack(own.w, float(own.learnt))

        for last in _merged(train_codes.select("codes", "new").mapInArrow(learn, _PACKED), averaged, _PACKED, "lm-round"):
            w = {k: np.frombuffer(last[k], np.float32).reshape(w[k].shape) for k in NAMES}
    return Model(w, vocab)


@dataclass
class Prepared:
    """What scoring needs: rows to score, the same in the codes of a lexicon, counts of all training words, the size below which they are joined,
    and the broadcast parts."""

    rows: DataFrame
    codes: tuple[object, DataFrame]
    words: DataFrame
    least: int
    ends: int
    tokens: int
    distinct: int
    ranks: object
    lexicon: object
    model: Model


def prepare(docs: DataFrame, tokenizer: str = TOKENIZER, frequent: int = FREQUENT) -> Prepared:
    """Everything that is gathered and trained from the training texts of docs."""
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"), (F.crc32(key) % FOLDS == HELD_OUT).alias("held_out"))
    train_rows = rows.where("not held_out").select("key", "text")
    words = stored(gathered(train_rows), "lm-words")
    ends = train_rows.count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = _least(words, "c", frequent)
    often = words.where(_size("c") >= least).orderBy("word").toPandas()
    lexicon = spark.sparkContext.broadcast(Lexicon(pa.array(often["word"], pa.large_string()), often["c"].to_numpy(), ends, encoder(ranks.value)))
    codes = coded(rows, lexicon)
    train_codes = codes.where("not held_out")
    vocab = vocabulary(train_codes, words, lexicon, ends, ranks)
    model = fit(train_rows, train_codes, vocab, lexicon, ranks)
    return Prepared(rows, (lexicon, codes), words, least, ends, total + ends, distinct + (ends > 0), ranks, lexicon, model)


def scored(p: Prepared) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; see score_texts()."""
    ranks, lexicon, model = p.ranks, p.lexicon, p.rows.sparkSession.sparkContext.broadcast(p.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, own, m = encoder(ranks.value), lexicon.value, model.value
        for batch in batches:
            for part, *words in read_codes(batch, own, WORDS):
                text = own.tokens(enc, *words)
                group, spell = m.words(text)
                rare = text.count < 0
                logs = group + np.where(rare, spell, np.logaddexp(m.known(text, text.count) * _LN, spell * _LN) / _LN)
                base = np.log10(np.maximum(text.count, 0) + 1)
                base[text.word[1:] - 1] = 0
                sums, bases = (np.concatenate([[0.0], np.cumsum(x)])[text.word] for x in (logs, base))
                upto = np.concatenate([[0], np.cumsum(rare)])[text.word]
                # What a rare word's count will make of its spelling: times 1 + (c - DISCOUNT) * 10 ** gain, or without the 1 above SPELLED.
                gain = -spell[rare] - np.log10(m.vocab.total[m.vocab.classes[text.ids[text.begin[:-1][rare]]]])
                lists = pa.StructArray.from_arrays([part.column(3).flatten().cast(pa.string()), pa.array(gain)], names=["word", "gain"])
                n = np.diff(text.word) - 1
                cols = [part.column(0), part.column(1), pa.array(n), pa.array(n - np.diff(upto)), pa.array(np.diff(bases)), pa.array(np.diff(sums)), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), lists)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "words", "often", "logs", "score", "rare"])

    mine, codes = p.codes
    codes = codes if mine is lexicon else coded(p.rows, lexicon)
    out = codes.select("doc_id", "held_out", "codes", "new").mapInArrow(run, "doc_id long, held_out boolean, words long, often long, logs double, score double, rare array<struct<word:string,gain:double>>")
    out = stored(out.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    few = out.where(F.size("rare") > 0).select("row", F.inline("rare"))
    few = few.hint("merge").join(p.words.where(_size("c") < p.least), "word")
    x = F.log10(F.col("c") - DISCOUNT) + F.col("gain")
    more = F.when(F.col("c") > SPELLED, x).otherwise(F.greatest(x, F.lit(0.0)) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(x))))
    few = few.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"), F.sum(more).alias("more_score"))
    out = out.drop("rare").join(few, "row", "left")
    tokens = F.col("words") + 1
    return out.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("often") + F.coalesce("more", F.lit(0).cast("long")) + int(p.ends > 0)).alias("n_known"),
        F.lit(p.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + float(np.log10(p.ends + 1)) - tokens * float(np.log10(p.tokens + p.distinct + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


_LN = float(np.log(10.0))


def score_texts(docs: DataFrame, tokenizer: str = TOKENIZER, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; see op6.

    The model: attention over the subwords before gives the class of the next word (by its first subword); within the class a word seen in
    training has the share of its discounted count, and one seen at most SPELLED times may be spelled, each subword and the word's end by
    attention. Counts, classes and shares are gathered from all training texts. All probabilities sum to one at most.

    Null text is empty and still has its end; a null doc_id counts as an empty string and so trains; repeated rows come back as often and train
    as often. Texts of any length are scored whole, in slices of rows of 2 MB (or one row). Without training texts all words are unknown and the
    model is what it is before training; an empty table gives an empty one.
    """
    return scored(prepare(docs, tokenizer, frequent))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document, held out or not, with production parameters."""
    return score_texts(table(spark, sf_dir, "documents"))
