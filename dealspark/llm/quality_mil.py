"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, held_out, labelled_sample, map_texts, typed

PASSAGE, BUCKETS, HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 64, 256, 24, 12, 8, 32, 3e-3
PER_CLASS, MAX_CHARS, PREDICT_AT, PART = 1500, 40_000, 0.3, 1 << 20
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)], dtype=np.int8)
#: Kinds of bytes: lower, upper, digit, each printable ASCII mark, other.
KIND = np.array([1 if 97 <= c < 123 else 2 if 65 <= c < 91 else 3 if 48 <= c < 58 else 4 + c - 33 if 33 <= c < 48 else 19 + c - 58 if 58 <= c < 65 else 26 + c - 91 if 91 <= c < 97 else 32 + c - 123 if 123 <= c < 127 else 0 for c in range(256)])
N_KINDS = 36
FEATURES = BUCKETS + N_KINDS + 4


def passages(text: bytes) -> np.ndarray:
    """A row of features for every PASSAGE words; a text without words is one row of zeros.

    Shares of byte kinds, root shares of hashed byte pairs, mean word length, shares of repeated and of neighbouring
    equal words, and the passage's fullness.
    """
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES), dtype=np.float32)
    first = np.arange(0, len(words), PASSAGE)
    k = len(first)
    data = np.frombuffer(text, dtype=np.uint8)
    begins = np.flatnonzero(np.diff(SPACE[data], prepend=1) == -1)
    place = np.zeros(len(data), dtype=np.int64)
    place[begins[first[1:]]] = 1
    place = np.cumsum(place)
    out = np.zeros((k, FEATURES), dtype=np.float32)
    pair = data[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + data[1:].astype(np.uint32) * np.uint32(0x85EBCA6B)
    pair = (pair >> np.uint32(13)) % np.uint32(BUCKETS)
    length = np.bincount(place, minlength=k)[:, None].astype(np.float32)
    out[:, :BUCKETS] = np.sqrt(np.bincount(place[:-1] * BUCKETS + pair, minlength=k * BUCKETS).reshape(k, BUCKETS) / length)
    out[:, BUCKETS : BUCKETS + N_KINDS] = 4 * np.bincount(place * N_KINDS + KIND[data], minlength=k * N_KINDS).reshape(k, N_KINDS) / length
    size = np.diff([*first, len(words)])
    out[:, -4] = np.add.reduceat(np.fromiter(map(len, words), np.int64, len(words)), first) / size / 10
    out[:, -3] = [1 - len(set(words[i : i + n])) / n for i, n in zip(first, size, strict=True)]
    same = np.fromiter(map(operator.eq, words, [b"", *words]), np.float32, len(words))
    out[:, -2] = np.add.reduceat(same, first) / size
    out[:, -1] = size / PASSAGE
    return out


def parts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """The text in parts of about `size` bytes, each of whole passages, so that the passages are those of the whole text."""
    at, reach = 0, size
    while len(text) - at > reach:
        begins = np.flatnonzero(np.diff(SPACE[np.frombuffer(text, dtype=np.uint8, count=reach, offset=at)], prepend=1) == -1)
        full = (len(begins) - 1) // PASSAGE * PASSAGE  # the last word may go on
        if full > 0:
            yield text[at : at + begins[full]]
            at, reach = at + int(begins[full]), size
        else:
            reach *= 2
    yield text[at:]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    p: dict[str, np.ndarray]

    def score(self, text: bytes) -> float:
        """Of all passages of the text. It is read in parts, whose softmax sums are brought to the greatest attention so far."""
        top, total, z = -np.inf, 0.0, np.zeros(len(self.p["c"]))
        for part in parts(text):
            h, a = self.attend(passages(part))
            new = max(top, float(a.max()))
            old, e = np.exp(top - new), np.exp(a - new)
            top, total, z = new, old * total + e.sum(), old * z + e @ h
        return float(sigmoid(z / total @ self.p["c"] + self.p["b"]))

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages' encodings and attention logits."""
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        return h, (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """bag: each passage's text, ascending. Gated attention: softmax of w (tanh(V h) * sigmoid(U h)) within a text."""
        p, f = self.p, {}
        f["h"] = np.tanh(x @ p["E"] + p["e"])
        f["t"], f["g"] = np.tanh(f["h"] @ p["V"]), sigmoid(f["h"] @ p["U"])
        a = (f["t"] * f["g"]) @ p["w"]
        start = np.searchsorted(bag, np.arange(n))
        a = np.exp(a - np.maximum.reduceat(a, start)[bag])
        f["a"] = a / np.add.reduceat(a, start)[bag]
        f["z"] = np.add.reduceat(f["a"][:, None] * f["h"], start, axis=0)
        f["logit"] = f["z"] @ p["c"] + p["b"]
        return f


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> Model:
    """Adam on the log loss of the texts' labels, the classes weighed alike; gradients by hand."""
    rng = np.random.default_rng(seed)
    mk = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"E": mk(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": mk(HIDDEN, ATTENTION), "U": mk(HIDDEN, ATTENTION), "w": mk(ATTENTION), "c": mk(HIDDEN), "b": np.zeros(())}
    model = Model(p)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = {c: len(y) / (2 * max(1, (y == c).sum())) for c in (0, 1)}
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in own]).astype(np.float64)
            bag = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
            f = model.forward(x, bag, len(own))
            d = (sigmoid(f["logit"]) - y[own]) * np.array([weight[c] for c in y[own]]) / len(own)
            g = {"b": d.sum(), "c": f["z"].T @ d}
            dz = np.outer(d, p["c"])[bag]
            dh = f["a"][:, None] * dz
            da = (dz * f["h"]).sum(axis=1)
            da = f["a"] * (da - np.bincount(bag, f["a"] * da, len(own))[bag])
            tg = f["t"] * f["g"]
            g["w"] = tg.T @ da
            dt, dg = np.outer(da, p["w"]) * f["g"] * (1 - f["t"] ** 2), np.outer(da, p["w"]) * tg * (1 - f["g"])
            g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ dg
            dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            g["E"], g["e"] = x.T @ dh, dh.sum(axis=0)
            step += 1
            for k in p:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.p = {k: np.asarray(x, dtype=np.float32) for k, x in p.items()}
    return model


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model | None:
    """Fit on at most per_class labelled texts of each class, none of a held-out id; None without both classes."""
    rows = labelled_sample(documents, labels, "quality", per_class, max_chars)
    y = np.array([c for _, c in rows])
    return fit([passages(t.encode()) for t, _ in rows], y) if len(set(y.tolist())) == 2 else None


def score_quality(documents: DataFrame, model: Model | None, at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from the text alone.

    Null and empty texts are one passage of zeros. Without a model every score is 0.5. Null or repeated ids: a row each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            s = [shared.value.score(t) if shared.value else 0.5 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= at) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    own = documents.select("doc_id", held_out().alias("held_out"), "text")
    return map_texts(own, run, typed(own.drop("text"), "score double, predicted int"))
