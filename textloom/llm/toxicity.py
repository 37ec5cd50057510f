"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A document's words go through overlapping windows (64 words, a new one each 48, so all
words are scored and each border lies inside a window). A word's input vector joins a
word part (learned embedding, log-odds of the word among toxic documents) and a
character part (mean learned embedding of its hashed 3-, 5- and 7-grams of bytes with word borders,
largest log-odds among them), so unseen words are read by their letters. Two gated
recurrent layers run over the window in both directions, attention pools their states,
and the document's score is that of its most toxic window.

Training uses a bounded sample of labelled rows (``SAMPLE``: so many toxic and other
documents on average at most), picked by hash of doc_id from the labels outside the
held-out fold, with their whole texts, which the driver holds as word numbers. Log-odds
are cross-fitted: a training document is described by those of the other half of the
sample. A fifth of the sample sets the decision threshold, by the scores of whole texts
and with either label weighted to its share among all labels. All randomness is seeded.

Defined results: null and empty texts have no words and score the network's answer to an
empty window; with no labels of both kinds the score is the share of toxic labels (0
without labels); repeated rows repeat; a null doc_id is not held out; a doc_id with both
labels counts as toxic, and of several texts with one doc_id the least is learned from;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import WORD_BYTES, map_whole, parts_of, read_table, with_fields

WINDOW, STRIDE = 64, 48
#: Documents of each label in the training sample, on average at most.
SAMPLE = 2000
VOCABULARY, BUCKETS, CHAR_ROWS = 20_000, 1 << 19, 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 12, 12
EPOCHS, MIN_STEPS, BATCH, RATE, SEED = 4, 200, 128, 0.01, 7
#: Words that a worker remembers by their part of the recurrence, and words for which that is made at once.
CACHE_WORDS, AT_ONCE = 40_000, 4_000

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(WORD_BYTES).split()


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every hashed 3-, 5- and 7-gram; a space stands at a word's borders."""
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    space = buf == 32
    number = np.cumsum(space) - 1  # of the word that a position or the space before it belongs to
    where, grams = [], []
    for n in (3, 5, 7):
        m = len(buf) - n + 1
        if m <= 0:
            continue
        h, inner = np.full(m, n, dtype=np.int64), np.zeros(m, dtype=bool)
        for k in range(n):
            h = (h * 1_000_003 + buf[k : k + m]) & 0x7FFFFFFFFFFF
            if 0 < k < n - 1:
                inner |= space[k : k + m]
        ok = np.flatnonzero(~inner)
        where.append(number[ok])
        grams.append((h[ok] ^ h[ok] >> 17) % BUCKETS)
    return np.concatenate(where), np.concatenate(grams)


@dataclass
class Statistics:
    """Smoothed log-odds that a word or n-gram stands in a toxic document."""

    words: dict[bytes, float]
    grams: np.ndarray

    PRIOR = 5.0

    @classmethod
    def of(cls, counts: Counts) -> Statistics:
        n0, n1 = counts.docs
        base = n1 / max(1, n1 + n0)

        def odds(a, b):
            # Seen in a toxic and b other documents, beside PRIOR documents of the usual mix.
            share1, share0 = (a + cls.PRIOR * base) / (n1 + cls.PRIOR), (b + cls.PRIOR * (1 - base)) / (n0 + cls.PRIOR)
            return np.clip(np.log(share1 / share0), -2, 6)

        other, toxic = counts.words
        return cls({w: float(odds(a, other[w])) for w, a in toxic.items() if a >= 2}, odds(*counts.grams[::-1].astype(np.float32)))


class Counts:
    """In how many documents of either label each word and n-gram stands; holds no documents."""

    def __init__(self):
        self.docs = [0, 0]
        self.words: tuple[Counter, Counter] = (Counter(), Counter())
        self.grams = np.zeros((2, BUCKETS), dtype=np.int32)

    def add(self, words: set[bytes], label: int) -> None:
        self.docs[label] += 1
        self.words[label].update(words)
        if words:
            self.grams[label, np.unique(ngrams(sorted(words))[1])] += 1

    def merged(self, other: Counts) -> Counts:
        out = Counts()
        out.docs = [a + b for a, b in zip(self.docs, other.docs, strict=True)]
        out.words = tuple(a + b for a, b in zip(self.words, other.words, strict=True))
        out.grams = self.grams + other.grams
        return out


class Inputs:
    """Word input vectors, made once for each word and kept while they are few."""

    def __init__(self, params: dict[str, np.ndarray], vocabulary: dict[bytes, int], stats: Statistics):
        self.p, self.vocabulary, self.stats = params, vocabulary, stats

    def parts(self, words: list[bytes]):
        ids = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        odds = np.array([self.stats.words.get(w, 0.0) for w in words])
        where, grams = ngrams(words)
        order = np.argsort(where, kind="stable")
        return ids, odds, where[order], grams[order]

    def vectors(self, words: list[bytes], parts=None) -> np.ndarray:
        ids, odds, where, grams = parts or self.parts(words)
        starts = np.flatnonzero(np.diff(where, prepend=-1))  # every word has a 3-gram
        best = np.maximum.reduceat(self.stats.grams[grams], starts)
        mean = np.add.reduceat(self.p["chars"][grams % CHAR_ROWS], starts, axis=0) / np.diff(np.append(starts, len(where)))[:, None]
        return np.concatenate([odds[:, None], best[:, None], self.p["words"][ids], mean], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(rng: np.random.Generator, words: int) -> dict[str, np.ndarray]:
    x, h = 2 + WORD_DIM + CHAR_DIM, HIDDEN
    made = {
        "words": rng.normal(0, 0.1, (words + 1, WORD_DIM)),
        "chars": rng.normal(0, 0.1, (CHAR_ROWS, CHAR_DIM)),
        "win": rng.normal(0, x**-0.5, (x, 6 * h)),
        "bin": np.zeros(6 * h),
        "u0": rng.normal(0, h**-0.5, (h, 3 * h)),
        "u1": rng.normal(0, h**-0.5, (h, 3 * h)),
        "watt": rng.normal(0, (2 * h) ** -0.5, (2 * h, ATTENTION)),
        "batt": np.zeros(ATTENTION),
        "vatt": rng.normal(0, ATTENTION**-0.5, ATTENTION),
        "wout": rng.normal(0, (2 * h) ** -0.5, 2 * h),
        "bout": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in made.items()}


def recur(pre: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, windows, hidden) of one direction; pre (steps, windows, 3 hidden) in running order."""
    h = u.shape[0]
    state = np.zeros((pre.shape[1], h), dtype=np.float32)
    out = np.empty((len(pre), pre.shape[1], h), dtype=np.float32)
    for t in range(len(pre)):
        ug = state @ u
        gates = sigmoid(pre[t, :, : 2 * h] + ug[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(pre[t, :, 2 * h :] + r * ug[:, 2 * h :])
        m = mask[t][:, None]
        if keep is not None:
            keep.append((state, z, r, new, ug[:, 2 * h :]))
        state = state + m * (1 - z) * (new - state)
        out[t] = state
    return out


def recur_back(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by pre and u from those by the states."""
    h = u.shape[0]
    d_pre = np.empty((*d_out.shape[:2], 3 * h), dtype=np.float32)
    d_u = np.zeros_like(u)
    d = np.zeros(d_out.shape[1:], dtype=np.float32)
    for t in range(len(d_out) - 1, -1, -1):
        state, z, r, new, un = keep[t]
        d = d + d_out[t]
        m = mask[t][:, None]
        d_new = d * m * (1 - z) * (1 - new * new)
        d_z = -d * m * (new - state) * z * (1 - z)
        d_r = d_new * un * r * (1 - r)
        d_pre[t] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_gate = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_u += state.T @ d_gate
        d = d * (1 - m * (1 - z)) + d_gate @ u.T
    return d_pre, d_u


def forward(p: dict[str, np.ndarray], pre: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows from pre (steps, windows, 6 hidden) and mask (steps, windows)."""
    h = HIDDEN
    kept: list[list | None] = [[], []] if keep is not None else [None, None]
    there = recur(pre[:, :, : 3 * h], mask, p["u0"], kept[0])
    back = recur(pre[::-1, :, 3 * h :], mask[::-1], p["u1"], kept[1])[::-1]
    states = np.concatenate([there, back], axis=2)
    hidden = np.tanh(states @ p["watt"] + p["batt"])
    score = np.where(mask > 0, hidden @ p["vatt"], -30).astype(np.float32)
    weight = np.exp(score - score.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    if keep is not None:
        keep.update(kept=kept, states=states, hidden=hidden, weight=weight, pooled=pooled)
    return pooled @ p["wout"] + p["bout"][0]


def gradients(p: dict[str, np.ndarray], pre: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Mean cross-entropy, gradients by the network's parameters, and by pre."""
    k: dict = {}
    logits = forward(p, pre, mask, k)
    prob = sigmoid(logits)
    loss = -np.mean(labels * np.log(prob + 1e-9) + (1 - labels) * np.log(1 - prob + 1e-9))
    d = ((prob - labels) / len(labels)).astype(np.float32)
    g = {"wout": k["pooled"].T @ d, "bout": np.array([d.sum()], dtype=np.float32)}
    d_pooled = d[:, None] * p["wout"]
    d_states = k["weight"][:, :, None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", k["states"], d_pooled)
    d_score = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(axis=0))
    g["vatt"] = np.einsum("tb,tba->a", d_score, k["hidden"])
    d_hidden = d_score[:, :, None] * p["vatt"] * (1 - k["hidden"] ** 2)
    g["watt"] = np.einsum("tbh,tba->ha", k["states"], d_hidden)
    g["batt"] = d_hidden.sum(axis=(0, 1))
    d_states = d_states + d_hidden @ p["watt"].T
    h = HIDDEN
    d0, g["u0"] = recur_back(d_states[:, :, :h], mask, p["u0"], k["kept"][0])
    d1, g["u1"] = recur_back(d_states[::-1, :, h:], mask[::-1], p["u1"], k["kept"][1])
    return float(loss), g, np.concatenate([d0, d1[::-1]], axis=2)


def windows_of(n: int) -> list[tuple[int, int]]:
    """The windows over n words; a text without words has one empty window."""
    if n <= WINDOW:
        return [(0, n)]
    return [(a, min(n, a + WINDOW)) for a in range(0, n - WINDOW + STRIDE, STRIDE)]


class Network:
    def __init__(self, params: dict[str, np.ndarray], vocabulary: dict[bytes, int], stats: Statistics, shift: float = 0.0):
        self.p, self.shift = params, np.float32(shift)
        self.inputs = Inputs(params, vocabulary, stats)
        self._reset()

    def __getstate__(self) -> dict:
        return {"p": self.p, "shift": self.shift, "inputs": self.inputs}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), dtype=np.float32)

    def rows(self, docs: list[list[bytes]]) -> list[list[int]]:
        """The words' rows in self.table, which is filled with what it lacks; row 0 stands for no word.

        Words are forgotten only where those of docs would be too many with them, so the
        table holds CACHE_WORDS or the words of docs, whichever are more.
        """
        known, words = self.known, {w for words in docs for w in words}
        fresh_words = words - known.keys()
        if len(known) + len(fresh_words) > CACHE_WORDS:
            self._reset()
            known, fresh_words = self.known, words
        if fresh_words:
            fresh_words = sorted(fresh_words)
            at = len(known) + 1
            if (needed := at + len(fresh_words)) > len(self.table):
                # Twice as many rows, so that the table is seldom copied.
                grown = np.zeros((max(needed, min(2 * len(self.table), CACHE_WORDS + 1)), 6 * HIDDEN), dtype=np.float32)
                grown[:at] = self.table[:at]
                self.table = grown
            for k in range(0, len(fresh_words), AT_ONCE):
                some = fresh_words[k : k + AT_ONCE]
                self.table[at + k : at + k + len(some)] = self.inputs.vectors(some) @ self.p["win"] + self.p["bin"]
            known.update(zip(fresh_words, range(at, needed), strict=True))
        return [[known[w] for w in words] for words in docs]

    def logits(self, docs: list[list[bytes]], at_once: int = 1024) -> np.ndarray:
        """The largest logit over each document's windows."""
        out = np.full(len(docs), -np.inf, dtype=np.float32)
        owner: list[int] = []
        spans: list[np.ndarray] = []
        for i, ids in enumerate(self.rows(docs)):
            ids = np.array(ids, dtype=np.int64)
            for a, b in windows_of(len(ids)):
                owner.append(i)
                spans.append(ids[a:b])
        # Windows of like length together: short ones need few steps.
        order = sorted(range(len(spans)), key=lambda k: len(spans[k]))
        for k in range(0, len(order), at_once):
            some = order[k : k + at_once]
            steps = max(1, len(spans[some[-1]]))
            index = np.zeros((steps, len(some)), dtype=np.int64)
            for c, s in enumerate(some):
                index[: len(spans[s]), c] = spans[s]
            found = forward(self.p, self.table[index], (index > 0).astype(np.float32))
            np.maximum.at(out, [owner[s] for s in some], found)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        # In groups, so that very long texts take bounded memory together.
        out, held, size = [], [], 0
        for text in texts:
            held.append(words_of(text))
            size += len(held[-1])
            if size > 200_000:
                out.append(self.logits(held))
                held, size = [], 0
        if held:
            out.append(self.logits(held))
        return sigmoid((np.concatenate(out) - self.shift).astype(np.float64)) if out else np.zeros(0)


def train(texts: Iterable[str], labels: list[int], seed: int = SEED, natural: tuple[int, int] | None = None) -> Network:
    """EPOCHS passes over the sample, or as many as give MIN_STEPS steps.

    natural: how many of all labelled documents have label 0 and 1, for the threshold; as
    in the sample if none.
    """
    rng = np.random.default_rng(seed)
    # A document is an array of word numbers.
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int32) for t in texts]
    names = list(number)
    del number
    y = np.array(labels, dtype=np.int64)
    order = rng.permutation(len(docs))
    tune, fit = order[: len(order) // 5], order[len(order) // 5 :]
    if len(set(y[fit].tolist())) < 2:
        tune, fit = order, order
    # Two halves of the training documents; each is described by what the other one counts.
    halves, counted = [fit[0::2], fit[1::2]], [Counts(), Counts()]
    for half, counts in zip(halves, counted, strict=True):
        for i in half:
            counts.add({names[w] for w in np.unique(docs[i])}, int(y[i]))
    both = counted[0].merged(counted[1])
    total = both.words[0] + both.words[1]
    vocabulary = {w: k + 1 for k, (w, _) in enumerate(sorted(((w, c) for w, c in total.items() if c >= 3), key=lambda x: (-x[1], x[0]))[:VOCABULARY])}
    params = fresh(rng, len(vocabulary))
    whole = Statistics.of(both)
    sources = [Inputs(params, vocabulary, Statistics.of(counted[1 - k])) for k in (0, 1)]
    del counted, both, total

    # Of each training document the window with the most log-odds, and another.
    windows: list[tuple[list[bytes], int, int]] = []
    for k, half in enumerate(halves):
        for i in half:
            if not len(docs[i]):
                continue
            own, where = np.unique(docs[i], return_inverse=True)
            vector = sources[k].vectors([names[w] for w in own])
            weight = np.maximum(0, vector[:, 0] + vector[:, 1] - 1)[where]
            spans = windows_of(len(docs[i]))
            best = int(np.argmax([weight[a:b].sum(dtype=np.float64) for a, b in spans]))
            chosen = [best] if y[i] or len(spans) == 1 else [best, int(rng.integers(len(spans)))]
            windows += [([names[w] for w in docs[i][slice(*spans[s])]], int(y[i]), k) for s in chosen]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    step = 0
    pos = max(1, sum(w[1] for w in windows))
    lift = min(4.0, max(1.0, len(windows) / pos / 2))
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // max(1, len(windows))))):
        turn = rng.permutation(len(windows))
        for a in range(0, len(turn), BATCH):
            some = [windows[i] for i in turn[a : a + BATCH]]
            step += 1
            _step(params, moments, sources, some, step, lift)
    made = Network(params, vocabulary, whole)
    share = np.bincount(y[tune], minlength=2) / len(tune)
    mix = np.array(natural or share, dtype=float)
    weights = (mix / mix.sum() / np.maximum(share, 1e-9))[y[tune]]
    found = [made.logits([[names[w] for w in docs[i]] for i in tune[k : k + 50]]) for k in range(0, len(tune), 50)]
    made.shift = np.float32(_threshold(np.concatenate(found), y[tune], weights))
    return made


def summed(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the sums of the rows that go to each place."""
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    if len(to):
        order = np.argsort(to, kind="stable")
        starts = np.flatnonzero(np.diff(to[order], prepend=-1))
        out[to[order[starts]]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def _step(params: dict, moments: dict, sources: list[Inputs], some: list, step: int, lift: float) -> None:
    steps = max(len(w) for w, _, _ in some)
    index = np.zeros((steps, len(some)), dtype=np.int64)
    vectors, parts, at = [np.zeros((1, 2 + WORD_DIM + CHAR_DIM), dtype=np.float32)], [], 1
    for k in (0, 1):
        own = sorted({w for words, _, half in some if half == k for w in words})
        if not own:
            continue
        found = sources[k].parts(own)
        parts.append((at, found))
        vectors.append(sources[k].vectors(own, found))
        number = {w: i + at for i, w in enumerate(own)}
        at += len(own)
        for c, (words, _, half) in enumerate(some):
            if half == k:
                index[: len(words), c] = [number[w] for w in words]
    x = np.concatenate(vectors)
    mask = (index > 0).astype(np.float32)
    labels = np.array([y for _, y, _ in some], dtype=np.float32)
    _, g, d_pre = gradients(params, (x @ params["win"] + params["bin"])[index], mask, labels)
    d_pre *= (1 + (lift - 1) * labels)[None, :, None] * mask[:, :, None]
    d_rows = summed(d_pre.reshape(-1, d_pre.shape[2]), index.ravel(), len(x))
    g["win"], g["bin"] = x.T @ d_rows, d_rows.sum(axis=0)
    d_x = d_rows @ params["win"].T
    d_words, d_chars = np.zeros_like(params["words"]), np.zeros_like(params["chars"])
    for at, (ids, _, where, grams) in parts:
        d_words += summed(d_x[at : at + len(ids), 2 : 2 + WORD_DIM], ids, len(d_words))
        share = d_x[at : at + len(ids), 2 + WORD_DIM :] / np.bincount(where, minlength=len(ids))[:, None]
        d_chars += summed(share[where], grams % CHAR_ROWS, CHAR_ROWS)
    g["words"], g["chars"] = d_words, d_chars
    for k, d in g.items():
        m, v = moments[k]
        m += 0.1 * (d - m)
        v += 0.001 * (d * d - v)
        params[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The middle of the widest gap among the cuts with the best weighted F1; 0 where the labels have one kind."""
    if len(set(labels.tolist())) < 2:
        return 0.0
    order = np.argsort(-logits, kind="stable")
    weights = np.ones(len(labels)) if weights is None else weights
    hit = np.cumsum((labels * weights)[order])
    f1 = 2 * hit / (np.cumsum(weights[order]) + hit[-1])
    value = logits[order]
    gap = np.append(-np.diff(value), 0)
    f1[gap <= 0] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    at = best[np.argmax(gap[best])]
    return float((value[at] + value[min(at + 1, len(value) - 1)]) / 2)


def fold(column: str = "doc_id", folds: int = 5):
    """crc32 of doc_id as text, modulo folds; null for a null doc_id."""
    return F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list, tuple[int, int]]:
    """(doc_id, label, text) of about most documents of either label outside fold 0 at most, by hash of doc_id, and how many there are of each label."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    want = [F.when(F.col("toxic") == k, mark < int(min(1.0, most / n) * (1 << 30))) for k, n in sorted(counts.items())]
    if not want:
        return [], (0, 0)
    picked = known.filter(F.coalesce(*want))
    # About 2 * most documents, whatever the input.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return sorted((r["doc_id"], r["toxic"], r["text"]) for r in rows), (counts.get(0, 0), counts.get(1, 0))


def model_for(docs: DataFrame, labels: DataFrame) -> Network | float:
    rows, natural = labelled_sample(docs, labels)
    y = [r[1] for r in rows]
    if len(set(y)) < 2:
        return float(np.mean(y)) if y else 0.0
    return train((r[2] for r in rows), y, natural=natural)


def score_documents(docs: DataFrame, model: Network | float, name: str = "tox_score") -> DataFrame:
    """docs with all its columns and the score (double), under a name that docs does not have, after them; moves no rows."""
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 512):
                texts = part.column(at).to_pylist()
                got = np.full(len(texts), held.value) if isinstance(held.value, float) else held.value.scores(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, name])

    return map_whole(docs, run, with_fields(docs, **{name: "double"}))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = model_for(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(fold() == 0, F.lit(False)).alias("held_out"),
        F.col("tox_score").alias("score"),
        F.when(F.col("tox_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
