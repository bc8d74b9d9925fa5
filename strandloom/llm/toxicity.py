"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs per word: an embedding of the word and the mean of embeddings of its
characters' trigrams, both hashed into fixed tables. Two gated recurrent layers read
a window in both directions, attention pools their states, and a logistic unit
gives the window's score. Training is plain numpy (Adam) on windows of a bounded
sample of labelled documents; a positive document teaches with its most suspicious
windows, first by word odds, then by the model itself. A text's score is the largest
over all its overlapping windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table
from .words import LOWER, SPACE, forget, mix, pieces, row_of, scan

WORDS, CHARS, WIDTH, HIDDEN = 8192, 8192, 16, 12
WINDOW, STRIDE = 32, 24
#: Stride of scoring. It divides STRIDE, so every window laid as in training is scored, and words up to 20 apart share a window.
FINE = 12
_BYTE = np.arange(256, dtype=np.uint64)[LOWER] + np.uint64(1)
#: Bytes of a word, without the marks around it.
_LETTER = np.ones(256, bool)
_LETTER[[b for b in range(128) if not chr(b).isalnum()]] = False


def fold_case(buf: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the upper-case letters U+00C0 to U+00DE in lower case; A to Z fold later."""
    if len(buf) < 2:
        return buf
    tail = buf[1:]
    upper = (buf[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
    if not upper.any():
        return buf
    out = buf.copy()
    out[1:][upper] += 0x20
    return out


class Lexicon:
    """Distinct words of a piece: word bucket, trigram buckets (flat, with firsts), and each word's index."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        buf = fold_case(buf)
        starts, ends, self.firsts, h = scan(buf, offsets, lower=True, word=SPACE & _LETTER)
        names, at, self.index = np.unique(h, return_index=True, return_inverse=True)
        self.word = (names % np.uint64(WORDS)).astype(np.int64)
        a, b = starts[at], ends[at]
        # trigrams over ^word$: positions a-1 .. b, ends read as 0
        n = b - a
        self.first = np.concatenate([[0], np.cumsum(n)])
        p = np.arange(self.first[-1]) - np.repeat(self.first[:-1], n) + np.repeat(a, n)
        low, high = np.repeat(a, n), np.repeat(b, n)
        pad = np.concatenate([buf, np.zeros(1, np.uint8)])
        before = np.where(p > low, _BYTE[pad[p - 1]], 0).astype(np.uint64)
        after = np.where(p + 1 < high, _BYTE[pad[np.minimum(p + 1, len(buf))]], 0).astype(np.uint64)
        self.gram = (mix((before * np.uint64(512) + _BYTE[pad[p]]) * np.uint64(512) + after) % np.uint64(CHARS)).astype(np.int64)


def window_starts(firsts: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of every window: each `stride` words, the last flush with the end."""
    n = np.diff(firsts)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // stride), 0) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * stride, np.maximum(n[row] - WINDOW, 0))
    return row, firsts[:-1][row] + start, np.minimum(n[row], WINDOW)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters: word and char tables; per direction Win, U, b; attention; output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.1: (r.normal(size=s) * scale).astype(np.float32)
        self.p = {"word": f(WORDS, WIDTH), "char": f(CHARS, WIDTH, scale=0.3), "wa": f(2 * HIDDEN), "wo": f(2 * HIDDEN, scale=0.3), "bo": np.float32([-1.0])}
        for d in "fb":
            self.p |= {f"W{d}": f(WIDTH, 3 * HIDDEN, scale=0.3), f"U{d}": f(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def embed(self, lex: Lexicon) -> np.ndarray:
        x = self.p["word"][lex.word]
        n = np.diff(lex.first)
        if len(lex.gram):
            x = x + np.add.reduceat(self.p["char"][lex.gram], lex.first[:-1], axis=0) / np.sqrt(n)[:, None].astype(np.float32)
        return x

    def forward(self, gates: dict, mask: np.ndarray, keep: bool = False):
        """gates[d]: (rows, time, 3 HIDDEN) input parts. Returns logits, and what backward needs."""
        rows, time = mask.shape
        states = np.zeros((rows, time, 2 * HIDDEN), np.float32)
        cache = {}
        full = bool(mask.all())
        for k, d in enumerate("fb"):
            h = np.zeros((rows, HIDDEN), np.float32)
            U, held = self.p[f"U{d}"], []
            for t in range(time) if d == "f" else range(time - 1, -1, -1):
                g = gates[d][:, t]
                rec = h @ U
                zr = _sigmoid(g[:, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                if not full:
                    m = mask[:, t, None]
                    new = np.where(m, new, h)
                if keep:
                    held.append((t, h, z, r, c, rec[:, 2 * HIDDEN :]))
                h = new
                states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
            cache[d] = held
        score = states @ self.p["wa"]
        score = np.where(mask, score, -1e9)
        e = np.exp(score - score.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        pooled = np.einsum("rt,rth->rh", alpha, states)
        return pooled @ self.p["wo"] + self.p["bo"][0], (states, alpha, pooled, cache)

    def backward(self, down: np.ndarray, mask: np.ndarray, kept) -> tuple[dict, dict]:
        """Gradients of parameters and of the gates' input parts, for logit gradients `down`."""
        states, alpha, pooled, cache = kept
        g = {"wo": pooled.T @ down, "bo": np.array([down.sum()], np.float32)}
        dp = down[:, None] * self.p["wo"]
        da = np.einsum("rh,rth->rt", dp, states)
        ds = alpha * (da - (alpha * da).sum(1, keepdims=True))
        g["wa"] = np.einsum("rt,rth->h", ds, states)
        dstates = alpha[:, :, None] * dp[:, None] + ds[:, :, None] * self.p["wa"]
        dgates = {}
        for k, d in enumerate("fb"):
            U, gU = self.p[f"U{d}"], np.zeros_like(self.p[f"U{d}"])
            dg = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
            dh = np.zeros((len(mask), HIDDEN), np.float32)
            for t, h, z, r, c, rc in reversed(cache[d]):
                dh = dh + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[:, t, None]
                dn = np.where(m, dh, 0)
                dz, dc = dn * (c - h) * z * (1 - z), dn * z * (1 - c * c)
                dr = dc * rc * r * (1 - r)
                dg[:, t] = np.concatenate([dz, dr, dc], 1)
                drec = np.concatenate([dz, dr, dc * r], 1)
                gU += h.T @ drec
                dh = np.where(m, dn * (1 - z), dh) + drec @ U.T
            g[f"U{d}"], dgates[d] = gU, dg
        return g, dgates

    def gates(self, x: np.ndarray) -> dict:
        return {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}


class Windows:
    """Windows of texts with the features that training gathers from."""

    def __init__(self, texts: list[str]):
        parts = []
        column = pa.array(texts, pa.large_string())
        base = 0
        for i, j, buf, offsets in pieces(column):
            lex = Lexicon(buf, offsets)
            row, start, size = window_starts(lex.firsts)
            parts.append((lex, row + i, start, size, base))
            base += 1
        self.parts = parts
        self.row = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        self.part = np.concatenate([np.full(len(p[1]), k) for k, p in enumerate(parts)]) if parts else np.zeros(0, np.int64)
        self.local = np.concatenate([np.arange(len(p[1])) for p in parts]) if parts else np.zeros(0, np.int64)


def _batch(lex: Lexicon, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word of each place, mask) of windows."""
    time = int(size.max())
    place = start[:, None] + np.arange(time)
    mask = np.arange(time) < size[:, None]
    return lex.index[np.where(mask, place, start[:, None])], mask


def score_windows(net: Network, lex: Lexicon, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.float32)
    gates = net.gates(net.embed(lex))
    whole = size == WINDOW
    for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
        for at in range(0, len(group), 512):
            some = group[at : at + 512]
            word, mask = _batch(lex, start[some], size[some])
            out[some] = net.forward({d: gates[d][word] for d in "fb"}, mask)[0]
    return out


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            self.p[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)


def _odds(windows: Windows, toxic: np.ndarray) -> np.ndarray:
    """A first suspicion per window: the largest log odds of a word or trigram bucket by document."""
    counts = np.ones((2, 2, max(WORDS, CHARS)))
    for lex, row, start, size, _ in windows.parts:
        owner = row_of(lex.firsts)
        i = row.min() if len(row) else 0
        base = i - (np.flatnonzero(np.diff(lex.firsts) > 0)[0] if len(row) else 0)
        w = np.unique(np.stack([owner + base, lex.word[lex.index]]), axis=1)
        for y in (0, 1):
            counts[0, y] += np.bincount(w[1][toxic[w[0]] == y], minlength=counts.shape[2])
    total = np.array([(toxic == 0).sum() + 2, (toxic == 1).sum() + 2])
    log = np.log(counts[0, 1] / total[1]) - np.log(counts[0, 0] / total[0])
    out = []
    for lex, row, start, size, _ in windows.parts:
        if len(start):
            word, mask = _batch(lex, start, size)
            out.append(np.where(mask, log[lex.word[word]], -9).max(1))
    return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[str], toxic: np.ndarray, passes: int = 6, rounds: int = 3, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Train on labelled texts. Without both labels, the untrained network says "not toxic"."""
    net = Network()
    if len(set(toxic.tolist())) < 2:
        net.p["bo"][:] = -4
        net.p["wo"][:] = 0
        return net
    rng, windows = np.random.default_rng(seed), Windows(texts)
    suspicion = _odds(windows, toxic)
    adam = Adam(net.p, rate)
    for turn in range(rounds):
        chosen, label = [], []
        order = np.lexsort((-suspicion, windows.row))
        rank = np.arange(len(order)) - np.searchsorted(windows.row[order], windows.row[order])
        top = order[rank == 0]
        for y in (0, 1):
            own = top[toxic[windows.row[top]] == y]
            chosen.append(own)
            label.append(np.full(len(own), y))
        other = np.flatnonzero(toxic[windows.row] == 0)  # plain windows beside the most suspicious
        extra = rng.choice(other, min(len(other), len(top)), replace=False) if len(other) else other
        chosen.append(extra)
        label.append(np.zeros(len(extra), np.int64))
        chosen, label = np.concatenate(chosen), np.concatenate(label).astype(np.float32)
        weight = np.where(label == 1, (label == 0).sum() / max(1, (label == 1).sum()), 1.0) ** 0.5
        steps = max(passes, min(60, 1500 // max(1, len(chosen) // batch)) if turn == 0 else passes)
        for _ in range(steps if len(chosen) < 2000 else passes):
            for some in _by_part(windows, rng, len(chosen), chosen, batch):
                _learn(net, adam, windows, chosen[some], label[some], weight[some].astype(np.float32))
        suspicion = np.concatenate([score_windows(net, lex, start, size) for lex, _, start, size, _ in windows.parts])
    return net


def _by_part(windows: Windows, rng, n: int, chosen: np.ndarray, batch: int) -> list[np.ndarray]:
    """Shuffled batches whose windows share a piece, so that a batch has one lexicon."""
    order = rng.permutation(n)
    order = order[np.argsort(windows.part[chosen[order]], kind="stable")]
    cuts = np.flatnonzero(np.diff(windows.part[chosen[order]])) + 1
    out = [g[i : i + batch] for g in np.split(order, cuts) for i in range(0, len(g), batch)]
    return [out[i] for i in rng.permutation(len(out))]


def _learn(net: Network, adam: Adam, windows: Windows, some: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
    lex, _, start, size, _ = windows.parts[windows.part[some[0]]]
    word, mask = _batch(lex, start[windows.local[some]], size[windows.local[some]])
    used, word = np.unique(word, return_inverse=True)
    word = word.reshape(mask.shape)
    n = np.diff(lex.first)[used]
    gram = np.concatenate([lex.gram[lex.first[u] : lex.first[u + 1]] for u in used])
    owner = np.repeat(np.arange(len(used)), n)
    root = np.sqrt(n).astype(np.float32)
    x = net.p["word"][lex.word[used]].copy()
    np.add.at(x, owner, net.p["char"][gram] / root[owner, None])
    gates = net.gates(x)
    logit, kept = net.forward({d: gates[d][word] for d in "fb"}, mask, keep=True)
    down = (weight * (_sigmoid(logit) - label) / len(some)).astype(np.float32)
    g, dgates = net.backward(down, mask, kept)
    dx = np.zeros_like(x)
    for d in "fb":
        per = np.zeros((len(used), 3 * HIDDEN), np.float32)
        np.add.at(per, word.ravel(), dgates[d].reshape(-1, 3 * HIDDEN))
        g[f"W{d}"], g[f"b{d}"] = x.T @ per, per.sum(0)
        dx += per @ net.p[f"W{d}"].T
    g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
    np.add.at(g["word"], lex.word[used], dx)
    np.add.at(g["char"], gram, dx[owner] / root[owner, None])
    adam.step(g)


def train(documents: DataFrame, labels: DataFrame, sample: int = 1500, max_chars: int = 20_000) -> Network:
    """Fit on at most `sample` labelled documents of each label with up to `max_chars` characters.

    The sample is that of the least hashes of doc_id. Training keeps to it; scoring
    has no bound. Only rows whose crc32(doc_id as text) mod 3 is not 1 are read.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", F.col("toxic").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sized = known.join(documents.filter("text is not null").select("doc_id", F.length("text").alias("n")).filter(F.col("n") <= max_chars).groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    ids = [sized.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y") for y in (0, 1)]
    picked = F.broadcast(ids[0].union(ids[1]))
    rows = documents.filter(F.length("text") <= max_chars).select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "y").dropDuplicates(["doc_id"]).toPandas()
    rows = rows.sort_values("doc_id")
    return fit(rows["text"].tolist(), rows["y"].to_numpy().astype(np.int64))


def _scores(params: dict):
    """A function of a text column: scores, as an Arrow function that sees the texts alone."""
    net = Network()
    net.p = params
    blank = float(_sigmoid(params["bo"][0]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = np.full(len(column), min(blank, 0.5))
            for i, j, buf, offsets in pieces(column):
                lex = Lexicon(buf, offsets)
                row, start, size = window_starts(lex.firsts, FINE)
                if len(row):
                    logit = score_windows(net, lex, start, size).astype(np.float64)
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    out[i + row[first]] = _sigmoid(np.maximum.reduceat(logit, first))
            forget()
            yield pa.array(out)

    return F.arrow_udf(run, "double").asNondeterministic()  # so that the planner never scores a text twice


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """`documents` with score (0 to 1) and predicted (1 from `threshold` on) for every whole text.

    A null, empty or blank text has no window and gets the network's resting score,
    0.5 at most. Rows are scored one by one, so repeated rows score alike; a column
    already called score or predicted is replaced (`drop_toxic` keeps it). No usable
    labels: every text scores low. An empty table gives no rows.
    """
    net = train(documents, labels)
    bound_batches(documents.sparkSession)
    scored = documents.drop("score", "predicted").withColumn("score", _scores(net.p)("text"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `documents`, all columns as they are, that score under `threshold`."""
    net = train(documents, labels)
    bound_batches(documents.sparkSession)
    return documents.filter(_scores(net.p)("text") < threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", held.alias("held_out"), "score", "predicted")
