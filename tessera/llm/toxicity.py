"""Toxicity scoring with a bidirectional gated recurrent network and attention pooling, trained in numpy.

A word's input is an embedding of the word, of its 4-grams and of its 7-grams of bytes (all hashed). Texts are
read in overlapping windows of WINDOW words, STRIDE apart, all of them; a window's states are pooled by
attention, and a text's score is that of its most toxic window. Training has two phases: all windows bear
their text's label, then only each text's highest windows do (multiple-instance learning). Some labelled texts
are kept out of both: on them the scores are calibrated, so that a score is about the chance of the label 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE, HIDDEN, EMBED, BUCKETS = 32, 16, 8, 8, 1 << 14
GRAMS = (4, 7)
#: Labelled rows that training takes at most, by the hash of their ids.
MAX_POSITIVE, MAX_NEGATIVE = 1500, 4500
#: Words whose inputs a worker keeps; windows that are scored at once.
CACHE_WORDS, BLOCK = 150_000, 512
#: Training texts that must hold a word or gram before it is told apart; share of words left out at random in training.
MIN_TEXTS, DROPOUT = 3, 0.25
INPUT = EMBED * (1 + len(GRAMS))
#: Share of the training texts that calibrate the scores, and the toxic ones there must be among all for that.
CALIBRATE, LEAST_TOXIC = 0.15, 40
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters in lower case: everything else in ASCII parts words."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split()


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each word's bucket, and for each gram size the buckets of all words' grams with the starts of each word's."""
    own = np.array([zlib.crc32(w) for w in words], dtype=np.int64) % BUCKETS
    out = []
    for size in GRAMS:
        padded = [b"<" + w + b">" * max(1, size - 1 - len(w)) for w in words]
        buf = np.frombuffer(b"".join(padded), dtype=np.uint8).astype(np.uint32)
        lens = np.array([len(p) for p in padded])
        h = np.zeros(max(0, len(buf) - size + 1), dtype=np.uint32)
        for k in range(size):
            h = h * np.uint32(0x01000193) + buf[k : k + len(h)]
        h ^= h >> np.uint32(15)
        counts = lens - size + 1
        starts = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(np.cumsum(lens) - lens - starts, counts)
        out.append(((h[at] % np.uint32(BUCKETS)).astype(np.int64), starts))
    return own, out


def _mean(table: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(table[grams], starts, axis=0)
    return sums / np.diff(np.append(starts, len(grams)))[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)  # of a text's logit: factor and shift

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale=1.0: (rng.standard_normal(s) * scale).astype(np.float32)
        p = {"word": draw(BUCKETS, EMBED, scale=0.1), "pad": draw(INPUT, scale=0.1)}
        p |= {f"gram{g}": draw(BUCKETS, EMBED, scale=0.1) for g in GRAMS}
        p |= {"w": draw(2, INPUT, 3 * HIDDEN, scale=INPUT**-0.5), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "u": draw(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)}
        p |= {"attend": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.full(1, -2.0, np.float32)}
        return cls(p)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        own, grams = gram_buckets(words)
        return np.concatenate([self.p["word"][own], *(_mean(self.p[f"gram{g}"], *x) for g, x in zip(GRAMS, grams, strict=True))], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """[n, 2, 3 h]: what both directions' gates get from inputs."""
        return (np.matmul(x[None], self.p["w"]) + self.p["b"]).transpose(1, 0, 2)

    def run(self, proj: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows idx [B, T] into the rows of proj; with keep, also what the backward pass needs."""
        n, t = idx.shape
        h = HIDDEN
        steps = np.empty((t, 2, n, 3 * h), np.float32)
        steps[:, 0] = proj[idx.T, 0]
        steps[:, 1] = proj[idx.T[::-1], 1]
        u, state = self.p["u"], np.zeros((2, n, h), np.float32)
        states = np.empty((t, 2, n, h), np.float32)
        saved = []
        for k in range(t):
            s = steps[k]
            hu = np.matmul(state, u)
            gates = np.tanh(0.5 * (s[..., : 2 * h] + hu[..., : 2 * h]))
            gates *= 0.5
            gates += 0.5
            z, r = gates[..., :h], gates[..., h:]
            new = np.tanh(s[..., 2 * h :] + r * hu[..., 2 * h :])
            if keep:
                saved.append((state, hu[..., 2 * h :], gates, new))
            state = new + z * (state - new)
            states[k] = state
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # [T, B, 2 h]
        score = np.where(mask.T, both @ self.p["attend"], -1e9)
        score = np.exp(score - score.max(axis=0))
        alpha = score / score.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", alpha, both)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, (both, alpha, pooled, saved)) if keep else logit

    def backward(self, idx: np.ndarray, kept, d_logit: np.ndarray, rows: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights, and of the projected inputs [rows, 2, 3 h]."""
        both, alpha, pooled, saved = kept
        h, (n, t) = HIDDEN, idx.shape
        g = {"bias": d_logit.sum(keepdims=True), "out": d_logit @ pooled}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_both = alpha[..., None] * d_pooled[None]
        d_alpha = np.einsum("tbh,bh->tb", both, d_pooled)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", d_score, both)
        d_both += d_score[..., None] * self.p["attend"]
        d_state = np.zeros((2, n, h), np.float32)
        g["u"] = np.zeros_like(self.p["u"])
        d_proj = np.zeros((rows, 2, 3 * h), np.float32)
        ut = self.p["u"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            before, hn, gates, new = saved[k]
            z, r = gates[..., :h], gates[..., h:]
            d_state[0] += d_both[k, :, :h]
            d_state[1] += d_both[t - 1 - k, :, h:]
            d_new = d_state * (1 - z) * (1 - new * new)
            d_z = d_state * (before - new) * z * (1 - z)
            d_r = d_new * hn * r * (1 - r)
            d_step = np.concatenate([d_z, d_r, d_new], axis=2)
            d_hu = np.concatenate([d_z, d_r, d_new * r], axis=2)
            g["u"] += np.matmul(before.transpose(0, 2, 1), d_hu)
            d_state = d_state * z + np.matmul(d_hu, ut)
            np.add.at(d_proj[:, 0], idx[:, k], d_step[0])
            np.add.at(d_proj[:, 1], idx[:, t - 1 - k], d_step[1])
        return g, d_proj


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            rows: np.ndarray | slice = slice(None)
            if isinstance(g, tuple):  # some rows of a table
                rows, g = g
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            v = self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * g * g
            self.p[k][rows] -= rate * m / (np.sqrt(v) + 1e-6)


def windows(n: int) -> np.ndarray:
    """Starts of the windows of n words; one even if there are none."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else np.zeros(1, dtype=np.int64)


def _spread(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window rows [k, WINDOW] of a text's word numbers (0 is padding) and their masks."""
    at = windows(len(ids))[:, None] + np.arange(WINDOW)
    inside = at < len(ids)
    idx = np.where(inside, ids[np.minimum(at, len(ids) - 1)] if len(ids) else 0, 0)
    if not len(ids):
        inside[:, 0] = True
    return idx, inside


def train(texts: list[str], labels: list[int], seed: int = 0, rate: float = 0.01, steps: int = 260, share: float | None = None) -> Network:
    """A network fitted on whole texts and calibrated to the share of toxic texts (as among the texts, if none is
    given); without both labels, it only knows their rate."""
    if sum(labels) >= LEAST_TOXIC and len(labels) - sum(labels) >= LEAST_TOXIC:
        order = np.random.default_rng(seed + 1).random(len(labels))
        aside = order < CALIBRATE
        net = _fit([t for t, k in zip(texts, aside, strict=True) if not k], [y for y, k in zip(labels, aside, strict=True) if not k], seed, rate, steps)
        own = np.array([y for y, k in zip(labels, aside, strict=True) if k], dtype=np.float64)
        found = Scorer(net).logits([t for t, k in zip(texts, aside, strict=True) if k])
        net.scale = calibrate(found, own, float(np.mean(labels)) if share is None else share)
        return net
    return _fit(texts, labels, seed, rate, steps)


def calibrate(logits: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """Factor and shift that make the logits those of the label's chance, by weighted logistic regression with softened
    targets; each label weighs as much as it is common."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, share / n1, (1 - share) / n0) * len(y)
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    w, middle = np.array([0.5, 0.0]), np.array([0.5, 0.0])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (p - target)) + 0.1 * (w - middle)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        w = w - np.clip(step, -1, 1)
    return max(0.05, float(w[0])), float(w[1])


def _fit(texts: list[str], labels: list[int], seed: int, rate: float, steps: int) -> Network:
    net = Network.fresh(seed)
    y = np.array(labels, dtype=np.float32)
    if len(set(labels)) < 2:
        net.p["out"][:] = 0
        net.p["bias"][:] = 4.0 if len(y) and y[0] else -4.0
        return net
    rng, number = np.random.default_rng(seed), {}
    docs = [np.array([number.setdefault(w, len(number) + 1) for w in words_of(t)], dtype=np.int64) for t in texts]
    own, grams = gram_buckets([b"", *number])
    spread = [_spread(d) for d in docs]
    first = np.concatenate([[0], np.cumsum([len(s[0]) for s in spread])])
    all_idx, all_mask = np.concatenate([s[0] for s in spread]), np.concatenate([s[1] for s in spread])
    known = _frequent([np.unique(d) for d in docs], own, grams)
    for name, kept in known.items():
        net.p[name][~kept] = 0
    opt = Adam(net.p, rate)
    bounds = [np.append(s, len(g)) for g, s in grams]

    def vectors(u: np.ndarray) -> np.ndarray:
        parts = [net.p["word"][own[u]]]
        for (g, _), s, size in zip(grams, bounds, GRAMS, strict=True):
            where, starts = _ranges(s, u)
            parts.append(_mean(net.p[f"gram{size}"], g[where], starts))
        x = np.concatenate(parts, axis=1)
        x[u == 0] = net.p["pad"]
        return x

    def fit(rows: np.ndarray, target: np.ndarray) -> None:
        u, local = np.unique(all_idx[rows], return_inverse=True)
        local = local.reshape(len(rows), WINDOW)
        x = vectors(u)
        drop = rng.random(len(u)) < DROPOUT  # words are left out at random, so that no text is learnt by heart
        x[drop] = 0
        logit, kept = net.run(net.project(x), local, all_mask[rows], keep=True)
        d = ((_sigmoid(logit) - target) / len(rows)).astype(np.float32)
        g, d_proj = net.backward(local, kept, d, len(u))
        g["w"] = np.matmul(x.T[None], d_proj.transpose(1, 0, 2))
        g["b"] = d_proj.sum(axis=0)[:, None]
        dx = np.einsum("nkg,kig->ni", d_proj, net.p["w"])
        g["pad"] = dx[u == 0].sum(axis=0)
        real = (u > 0) & ~drop
        ur, dr = u[real], dx[real]
        g["word"] = _sparse(own[ur], dr[:, :EMBED] * known["word"][own[ur], None])
        for j, ((gr, _), s, size) in enumerate(zip(grams, bounds, GRAMS, strict=True)):
            where, starts = _ranges(s, ur)
            counts = np.diff(np.append(starts, len(where)))
            part = dr[:, EMBED * (j + 1) : EMBED * (j + 2)] / counts[:, None]
            g[f"gram{size}"] = _sparse(gr[where], np.repeat(part, counts, axis=0) * known[f"gram{size}"][gr[where], None])
        opt.step(g)

    label_of = np.repeat(y, np.diff(first))
    pos, neg = np.flatnonzero(label_of > 0), np.flatnonzero(label_of == 0)
    for _ in range(steps):  # phase 1: every window has its text's label
        rows = np.concatenate([rng.choice(pos, 64), rng.choice(neg, 64)])
        fit(rows, label_of[rows])
    for phase in range(4):  # phase 2: the highest window of toxic texts, the two highest of others
        opt.rate = rate / (2 + phase)
        logits = _all_logits(net, vectors, all_idx, all_mask, len(number) + 1)
        top = [first[k] + np.argsort(-logits[first[k] : first[k + 1]])[: 1 if y[k] else 2] for k in range(len(docs))]
        p_top = np.array([t[0] for t, v in zip(top, y, strict=True) if v])
        n_top = np.concatenate([t for t, v in zip(top, y, strict=True) if not v])
        n_hard = n_top[np.argsort(-logits[n_top])[: max(64, len(n_top) // 4)]]
        for _ in range(steps // 4):
            rows = np.concatenate([rng.choice(p_top, 40), rng.choice(n_top, 44), rng.choice(n_hard, 44)])
            fit(rows, label_of[rows])
    return net


def _frequent(docs: list[np.ndarray], own: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """For each table the buckets that MIN_TEXTS training texts hold; the others stay zero, as for words never seen."""
    counts = {name: np.zeros(BUCKETS, np.int64) for name in ("word", *(f"gram{g}" for g in GRAMS))}
    bounds = [np.append(s, len(g)) for g, s in grams]
    for d in docs:
        counts["word"][np.unique(own[d])] += 1
        for (g, _), s, size in zip(grams, bounds, GRAMS, strict=True):
            counts[f"gram{size}"][np.unique(g[_ranges(s, d)[0]])] += 1
    return {name: c >= MIN_TEXTS for name, c in counts.items()}


def _ranges(bounds: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = bounds[u + 1] - bounds[u]
    starts = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(bounds[u] - starts, counts), starts


def _sparse(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(rows, return_inverse=True)
    out = np.zeros((len(u), grads.shape[1]), np.float32)
    np.add.at(out, inv, grads)
    return u, out


def _all_logits(net: Network, vectors, idx: np.ndarray, mask: np.ndarray, words: int) -> np.ndarray:
    proj = np.concatenate([net.project(vectors(np.arange(a, min(words, a + 20_000)))) for a in range(0, words, 20_000)])
    return np.concatenate([net.run(proj, idx[a : a + BLOCK], mask[a : a + BLOCK]) for a in range(0, len(idx), BLOCK)])


class Scorer:
    """A network with the projected inputs of the words seen lately."""

    def __init__(self, net: Network):
        self.net = net
        self.number: dict[bytes, int] = {}
        self.proj = np.empty((CACHE_WORDS + 1, 2, 3 * HIDDEN), np.float32)
        self.proj[0] = net.project(net.p["pad"][None])[0]

    def _numbers(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        seen = set().union(*docs)
        new = [w for w in seen if w not in self.number]
        if len(self.number) + len(new) > CACHE_WORDS:
            self.number, new = {}, list(seen)
        at = len(self.number) + 1
        if at + len(new) > len(self.proj):  # one text alone has more words than the cache
            self.proj = np.concatenate([self.proj, np.empty((at + len(new) - len(self.proj), 2, 3 * HIDDEN), np.float32)])
        for k in range(0, len(new), 20_000):
            own = new[k : k + 20_000]
            self.proj[at + k : at + k + len(own)] = self.net.project(self.net.inputs(own))
        self.number.update(zip(new, range(at, at + len(new)), strict=True))
        get = self.number.__getitem__
        return [np.fromiter(map(get, d), dtype=np.int64, count=len(d)) for d in docs]

    def scores(self, texts: list[str]) -> list[float]:
        """The score of each text, 0 to 1: its most toxic window's, calibrated; all windows are read."""
        factor, shift = self.net.scale
        return _sigmoid(factor * self.logits(texts) + shift).tolist()

    def logits(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for a in range(0, len(texts), 64):
            spread = [_spread(ids) for ids in self._numbers([words_of(t) for t in texts[a : a + 64]])]
            counts = [len(s[0]) for s in spread]
            idx, mask = np.concatenate([s[0] for s in spread]), np.concatenate([s[1] for s in spread])
            logits = np.concatenate([self.net.run(self.proj, idx[k : k + BLOCK], mask[k : k + BLOCK]) for k in range(0, len(idx), BLOCK)])
            out.append(np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(np.float64))
        return np.concatenate(out)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most: tuple[int, int] = (MAX_NEGATIVE, MAX_POSITIVE)) -> list[tuple[str, int]]:
    """At most that many labelled texts of each label, outside the held-out fold, by the hash of their ids."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(common.crc_mod_col(F.col("doc_id"), folds) != held)
    out: list[tuple[str, int]] = []
    for label in (0, 1):
        own = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[label]).select("doc_id")
        out.extend((r["text"], label) for r in rows.join(F.broadcast(own), "doc_id").orderBy("doc_id", "text").toLocalIterator())
    return out


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Network:
    """The network of the labelled rows outside the held-out fold, calibrated to how common the labels are among all of them."""
    rows = training_rows(docs, labels, folds, held)
    marks = labels.where("toxic is not null and doc_id is not null").where(common.crc_mod_col(F.col("doc_id"), folds) != held)
    share = marks.agg(F.avg(F.when(F.col("toxic") > 0, 1.0).otherwise(0.0)).alias("s")).first()["s"]
    return train([t for t, _ in rows], [y for _, y in rows], share=share)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of each row's whole text. Null and empty texts score as one window of padding; repeated rows
    stay; an empty table gives an empty result; extra columns, labels among them, are no input."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = scorer.scores([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, type=pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.freeing(run), f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a network trained on labelled rows outside the held-out fold."""
    common.prepare(docs.sparkSession)
    net = fitted(docs, labels, folds, held)
    held_out = common.crc_mod_col(F.col("doc_id"), folds) == held
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with the columns as they came; null texts count as empty, repeated
    rows share their fate, and without labels of both kinds nothing or all is dropped, as the only label says."""
    net = fitted(docs, labels)
    common.prepare(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = np.array(scorer.scores([t or "" for t in b.column(names.index("text")).to_pylist()]))
                yield b.filter(pa.array(found < threshold))

    return docs.mapInArrow(common.freeing(run), docs.schema)
