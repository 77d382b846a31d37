"""Language of documents by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled windows, then labels every byte of every text. Position
probabilities are pooled over the letters of the whole document. Long texts are
laid side by side as windows, so that one step serves thousands of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.common import add_columns, body_bytes, remainder

UNKNOWN = "und"
#: Training rows: at most this many for each language, spread by hash, whatever the corpus.
SAMPLE_PER_LANGUAGE = 384
SAMPLE_BYTES = 384
LETTER = re.compile(r"[^\W\d_]")
LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[65:91] = LETTER_BYTE[97:123] = LETTER_BYTE[128:] = True


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    window: int = 64
    batch: int = 128
    steps: int = 500
    rate: float = 0.01
    seed: int = 7
    #: Bytes of a window at prediction.
    span: int = 256


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer. ``table`` has the input part of the three gates for each byte."""

    NAMES = ("table", "mix", "bias")

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.mix = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.bias = np.zeros(hidden, np.float32)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state, and what the backward pass needs."""
        size = self.hidden
        given, own = self.table[x], h @ self.mix
        gates = sigmoid(given[:, : 2 * size] + own[:, : 2 * size])
        update, reset = gates[:, :size], gates[:, size:]
        inner = own[:, 2 * size :] + self.bias
        new = np.tanh(given[:, 2 * size :] + reset * inner)
        return new + update * (h - new), update, reset, inner, new

    def run(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """States [time, window, hidden] for bytes [time, window]."""
        h = np.zeros((x.shape[1], self.hidden), np.float32)
        states, kept = np.empty((*x.shape, self.hidden), np.float32), []
        for t in range(len(x)):
            before = h
            h, *parts = self.step(x[t], h)
            states[t] = h
            kept.append((before, *parts))
        return states, kept

    def back(self, x: np.ndarray, kept: list[tuple[np.ndarray, ...]], d_states: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients through time, from those of the states."""
        size = self.hidden
        grads = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        d_next = np.zeros_like(d_states[0])
        for t in reversed(range(len(x))):
            h, update, reset, inner, new = kept[t]
            d = d_states[t] + d_next
            d_new = d * (1 - update) * (1 - new * new)
            d_update = d * (h - new) * update * (1 - update)
            d_reset = d_new * inner * reset * (1 - reset)
            d_inner = d_new * reset
            d_own = np.concatenate([d_update, d_reset, d_inner], 1)
            np.add.at(grads["table"], x[t], np.concatenate([d_update, d_reset, d_new], 1))
            grads["mix"] += h.T @ d_own
            grads["bias"] += d_inner.sum(0)
            d_next = d * update + d_own @ self.mix.T
        return grads


class Network:
    """Two directions and a softmax over the languages at every position."""

    def __init__(self, languages: list[str], settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.languages, self.settings = languages, settings
        self.forth, self.rear = Direction(settings.hidden, rng), Direction(settings.hidden, rng)
        self.out = rng.normal(0, 0.2, (2 * settings.hidden, len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[tuple[object, str, np.ndarray]]]:
        """Mean loss over all positions of bytes [time, window] and every parameter's gradient."""
        size = self.settings.hidden
        ahead, kept_ahead = self.forth.run(x)
        behind, kept_behind = self.rear.run(x[::-1])
        states = np.concatenate([ahead, behind[::-1]], 2)
        logits = states @ self.out + self.offset
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        windows = np.arange(x.shape[1])
        loss = -np.log(p[:, windows, label] + 1e-9).mean()
        d = p
        d[:, windows, label] -= 1
        d /= x.size
        d_states = d @ self.out.T
        grads = [(self, "out", np.einsum("tnh,tnk->hk", states, d)), (self, "offset", d.sum((0, 1)))]
        for layer, bytes_, kept, part in (
            (self.forth, x, kept_ahead, d_states[:, :, :size]),
            (self.rear, x[::-1], kept_behind, d_states[::-1, :, size:]),
        ):
            grads += [(layer, name, g) for name, g in layer.back(bytes_, kept, part).items()]
        return float(loss), grads

    def train(self, texts: list[np.ndarray], labels: np.ndarray) -> list[float]:
        """Adam over random windows, languages drawn evenly. Returns the losses."""
        s = self.settings
        rng = np.random.default_rng(s.seed + 1)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        moments: dict[tuple[int, str], list[np.ndarray]] = {}
        losses = []
        for step in range(1, s.steps + 1):
            drawn = rng.integers(0, len(self.languages), s.batch)
            rows = [rng.choice(by_label[k]) for k in drawn]
            x = np.full((s.batch, s.window), 32, np.uint8)
            for n, row in enumerate(rows):
                text = texts[row]
                start = rng.integers(0, max(1, len(text) - s.window + 1))
                part = text[start : start + s.window]
                x[n, : len(part)] = part
            loss, grads = self.gradients(np.ascontiguousarray(x.T), drawn)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for *_, g in grads))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            rate = s.rate * (1 - 0.9 * step / s.steps)
            for owner, name, g in grads:
                m, v = moments.setdefault((id(owner), name), [np.zeros_like(g), np.zeros_like(g)])
                g = g * scale
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(owner, name, (getattr(owner, name) - change).astype(np.float32))
        return losses

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean language probabilities over the letters of each text [text, language]; zeros without letters."""
        s = self.settings
        sizes = np.diff(offsets)
        windows = -(-sizes // s.span)
        owner = np.repeat(np.arange(len(sizes)), windows)
        total = np.zeros((len(sizes), len(self.languages)))
        if not len(owner):
            return total
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = offsets[owner] + inside * s.span
        at = start + np.arange(s.span)[:, None]
        valid = at < offsets[owner + 1]
        x = np.where(valid, data[np.minimum(at, len(data) - 1)], 32).astype(np.uint8)
        counted = (valid & LETTER_BYTE[x]).astype(np.float32)
        ahead = np.empty((s.span, len(owner), len(self.languages)), np.float32)
        h = np.zeros((len(owner), s.hidden), np.float32)
        for t in range(s.span):
            h = self.forth.step(x[t], h)[0]
            ahead[t] = h @ self.out[: s.hidden]
        h = np.zeros_like(h)
        sums = np.zeros((len(owner), len(self.languages)), np.float32)
        for t in reversed(range(s.span)):
            h = self.rear.step(x[t], h)[0]
            p = np.exp(ahead[t] + (h @ self.out[s.hidden :] + self.offset))
            p *= (counted[t] / p.sum(1))[:, None]
            sums += p
        np.add.at(total, owner, sums)
        return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def training_windows(docs: DataFrame, settings: Settings) -> list[tuple[str, bytes]]:
    """Bounded sample of labelled training text: one window for each language and bucket of ids."""
    size = F.octet_length("body")
    order = F.xxhash64("doc_id", "body")
    start = F.pmod(F.shiftright(order, 7), F.greatest(size - SAMPLE_BYTES + 1, F.lit(1))).cast("int") + 1
    labelled = docs.filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 5) != 0) & F.col("text").rlike(r"\p{L}"))
    windows = labelled.select("lang", F.col("text").cast("binary").alias("body"), "doc_id").select(
        "lang", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PER_LANGUAGE)).alias("bucket"), order.alias("order"),
        F.substr("body", start, F.lit(SAMPLE_BYTES)).alias("window"),
    )
    rows = windows.groupBy("lang", "bucket").agg(F.min_by("window", "order").alias("window")).orderBy("lang", "bucket").collect()
    return [(r["lang"], bytes(r["window"])) for r in rows]


def train(docs: DataFrame, settings: Settings = Settings()) -> Network | None:
    """Network fitted to the bounded sample of ``docs`` (doc_id, text, lang); None without labelled text."""
    sample = training_windows(docs, settings)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    network = Network(languages, settings)
    network.train([np.frombuffer(t, np.uint8) for _, t in sample], np.array([languages.index(lang) for lang, _ in sample]))
    return network


def label(bodies: pa.Array, network: Network | None) -> dict[str, object]:
    lettered = [bool(LETTER.search(body.as_py().decode())) for body in bodies]
    if network is None:
        return {"lang_pred": [UNKNOWN] * len(bodies), "score": np.zeros(len(bodies))}
    p = network.pooled(*body_bytes(bodies))
    best = p.argmax(1)
    return {
        "lang_pred": [network.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)],
        "score": np.where(lettered, np.minimum(p.max(1), 1.0), 0.0),
    }


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """Every input row as ``row`` with ``lang_pred`` and ``score``.

    Null texts and texts without letters are ``und`` with score 0, and so is
    everything if nothing was learned. Equal probabilities go to the language
    first in order. Repeated rows are labelled one by one, extra columns stay
    inside ``row``, an empty table gives an empty result; texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return add_columns(docs, "lang_pred string, score double", lambda bodies: label(bodies, shared.value))
