"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled documents. It reads slices of
bytes in both directions, labels every position, and a document's probabilities are the mean over its positions.
Every byte of every text is read.

Training sample (documented bound): of every label, the documents with the smallest hashes of ``BUCKETS`` buckets (of fewer, down to 8, where there are so many labels that
this would be more than ``SAMPLE`` documents), of which a stretch of ``STRETCH`` characters at a place given by a hash.

Defined results: a text that is null or holds no letter is ``und`` with score 0; a null label is never learned from;
without any labelled document every text is ``und``; a null id counts as an empty one for the choice of held-out rows; labelled rows that share an id and a label give one sample; ties
between labels go to the first in code-point order; repeated rows give repeated results; very long texts are read whole, in slices; an empty table gives an empty result; columns other
than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_column, map_batches, table, text_bytes

BUCKETS, SAMPLE, STRETCH = 192, 12_288, 2000
HIDDEN, SLICE, BATCH, STEPS, RATE = 10, 48, 192, 160, 0.03
#: Bytes in a slice when documents are labelled, and slices that are worked on together.
READ, TOGETHER = 128, 1024
LETTER = regex.compile(r"\p{L}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer over bytes; gates are update, reset and candidate."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.w = (rng.normal(size=(256, 3 * hidden)) * 0.3).astype(np.float32)  # of each byte
        self.u = (rng.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, n, h) for bytes x (T, n); ``keep`` collects what backward() needs."""
        h, n = self.h, x.shape[1]
        state = np.zeros((n, h), np.float32)
        out = np.empty((len(x), n, h), np.float32)
        table = self.w + self.b
        for t in range(len(x)):
            a = table[x[t]]
            m = state @ self.u
            g = sigmoid(a[:, : 2 * h] + m[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * m[:, 2 * h :])
            if keep is not None:
                keep.append((state, z, r, c, m[:, 2 * h :]))
            state = c + z * (state - c)
            out[t] = state
        return out

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of w, u and b through all time steps, for gradients d_out of the states."""
        h = self.h
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        d = np.zeros_like(d_out[0])
        gates = np.empty((len(x), x.shape[1], 3 * h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            state, z, r, c, mc = kept[t]
            d = d + d_out[t]
            da_c = d * (1 - z) * (1 - c * c)
            da_z = d * (state - c) * z * (1 - z)
            da_r = da_c * mc * r * (1 - r)
            dm = np.concatenate([da_z, da_r, da_c * r], axis=1)
            gates[t] = np.concatenate([da_z, da_r, da_c], axis=1)
            du += state.T @ dm
            d = d * z + dm @ self.u.T
        flat = gates.reshape(-1, 3 * h)
        order = np.argsort(x.ravel(), kind="stable")
        values, first = np.unique(x.ravel()[order], return_index=True)
        dw[values] = np.add.reduceat(flat[order], first, axis=0)
        return [dw, du, flat.sum(0)]


class ByteTagger:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Direction(hidden, rng), Direction(hidden, rng)
        self.o = (rng.normal(size=(2 * hidden, len(labels))) * 0.3).astype(np.float32)
        self.c = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.o, self.c]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, n, labels) for every position of bytes x (T, n)."""
        s = self.ahead.forward(x) @ self.o[: self.ahead.h]
        s += self.back.forward(x[::-1])[::-1] @ self.o[self.ahead.h :]
        s += self.c
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(-1, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients; x (T, n), y (n)."""
        kept_a: list = []
        kept_b: list = []
        a, b = self.ahead.forward(x, kept_a), self.back.forward(x[::-1], kept_b)
        s = np.concatenate([a, b[::-1]], axis=2)
        p = s @ self.o + self.c
        p -= p.max(-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(-1, keepdims=True)
        at = (slice(None), np.arange(len(y)), y)
        loss = float(-np.log(np.maximum(p[at], 1e-30)).mean())
        p[at] -= 1
        p /= x.size
        h = self.ahead.h
        ds = p @ self.o.T
        go = np.tensordot(s, p, axes=([0, 1], [0, 1]))
        return loss, [*self.ahead.backward(x, kept_a, ds[..., :h]), *self.back.backward(x[::-1], kept_b, ds[::-1, :, h:]), go, p.sum((0, 1))]

    def fit(self, texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 5) -> float:
        """Train on random slices, as many of each label, with Adam; the last loss."""
        rng = np.random.default_rng(seed)
        by = [[t for t, k in zip(texts, labels) if k == name] for name in self.labels]
        # Longer texts are drawn more often.
        odds = [np.array([len(t) + 1 for t in b], float) for b in by]
        odds = [o / o.sum() for o in odds]
        m, v = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        loss = 0.0
        for step in range(1, steps + 1):
            y = rng.integers(len(self.labels), size=BATCH)
            x = np.full((SLICE, BATCH), 32, np.uint8)
            for n, k in enumerate(y):
                t = by[k][rng.choice(len(by[k]), p=odds[k])]
                at = rng.integers(max(1, len(t) - SLICE + 1))
                part = np.frombuffer(t[at : at + SLICE], np.uint8)
                x[: len(part), n] = part
            loss, grads = self.gradients(x, y)
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for p, g, a, b in zip(self.parameters(), grads, m, v):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability of each label over all positions of each text."""
        total = np.zeros((len(texts), len(self.labels)))
        parts = [(i, t[a : a + READ]) for i, t in enumerate(texts) for a in range(0, len(t), READ)]
        for at in range(0, len(parts), TOGETHER):
            group = parts[at : at + TOGETHER]
            size = np.array([len(p) for _, p in group])
            # Always filled up to the same length, so a text's result does not depend on its neighbours.
            x = np.frombuffer(b"".join(p.ljust(READ, b" ") for _, p in group), np.uint8).reshape(len(group), READ).T
            p = self.probabilities(np.ascontiguousarray(x))
            p *= (np.arange(READ)[:, None] < size)[:, :, None]
            np.add.at(total, [i for i, _ in group], p.sum(0, dtype=np.float64))
        return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def training_sample(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """Texts and labels of a bounded sample of labelled documents."""
    h = F.xxhash64("doc_id", F.lit(11))
    named = docs.where("lang is not null and text is not null").select("lang", "text", h.alias("h"))
    labels = named.select("lang").distinct().count()
    buckets = max(8, min(BUCKETS, SAMPLE // max(1, labels)))
    picked = named.groupBy("lang", F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h")
    size = F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1
    part = F.substring("text", F.pmod("h", size).cast("int") + 1, F.lit(STRETCH))
    rows = named.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min(part).alias("text")).orderBy("lang", "h").collect()
    return [r["text"].encode() for r in rows], [r["lang"] for r in rows]


def train(docs: DataFrame, steps: int = STEPS) -> ByteTagger | None:
    texts, labels = training_sample(docs)
    if not texts:
        return None
    model = ByteTagger(sorted(set(labels)))
    model.fit(texts, labels, steps)
    return model


def predict(docs: DataFrame, model: ByteTagger | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = text_bytes(b.column("text"))
        read = [i for i, t in enumerate(raw) if model is not None and LETTER.search(t.decode("utf-8", "replace"))]
        name, score = ["und"] * len(raw), np.zeros(len(raw))
        at = 0
        while at < len(read):  # bounded memory for very long texts
            to, size = at, 0
            while to < len(read) and (to == at or size + len(raw[read[to]]) < 8_000_000):
                size += len(raw[read[to]])
                to += 1
            p = model.pooled([raw[i] for i in read[at:to]])
            for i, row in zip(read[at:to], p):
                name[i], score[i] = model.labels[int(row.argmax())], min(1.0, float(row.max()))
            at = to
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(name), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (crc_column("doc_id") % 3 == 1).alias("held_out"), "text")
    return map_batches(own, batch, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs.where(crc_column("doc_id") % 3 != 1)))
