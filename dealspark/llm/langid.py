"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, map_texts, stored, typed

BUCKETS, DIM, LONGEST, EPOCHS, RATE, SEGMENT = 1 << 16, 16, 3, 4, 0.5, 240
#: Of each language a passage of at most so many characters of about so many documents is fetched for fitting, and of all
#: languages together of so many; with more languages there are fewer of each.
PER_LANG, PASSAGE_CHARS, FIT_DOCS, REJECT = 800, 1_000, 40_000, 0.5
MAX_BROADCAST_LANGS = 100_000
OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    """A letter by Unicode; superscripts, fractions and numerals are none."""
    return any(map(str.isalpha, text))


def subwords(text: str) -> np.ndarray:
    """Buckets of all n-grams of bytes inside the words of the text, words marked by a space on either side."""
    data = np.frombuffer((" " + OTHER.sub(" ", text.lower()) + " ").encode(), dtype=np.uint8)
    space = np.concatenate([[0], np.cumsum(data == 32, dtype=np.int32)])
    out, h = [], np.zeros(len(data), dtype=np.uint32)
    for n in range(1, LONGEST + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
        x = h if n == 2 else h[data != 32] if n == 1 else h[space[n - 1 : n - 1 + m] <= space[1 : m + 1]]
        x = x * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        out.append((x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embedding times weights: logits per bucket
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        ids, total = subwords(text), self.bias.copy()
        z = np.zeros(len(self.langs))
        for start in range(0, len(ids), 1 << 18):
            z += np.take(self.table, ids[start : start + (1 << 18)], axis=0).sum(axis=0)
        p = softmax((total + z / len(ids)) / self.temperature)
        return self.langs[int(p.argmax())], float(min(1.0, p.max()))


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Stochastic gradient descent over segments of the texts; a tenth is kept to choose the softmax's temperature."""
    langs = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    segments = []
    for text, lang in rows:
        for _ in range(3):
            n = int(rng.integers(20, SEGMENT))
            at = int(rng.integers(0, max(1, len(text) - n)))
            if has_letter(text[at : at + n]):
                segments.append((subwords(text[at : at + n]), number[lang]))
    if not segments:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    E, W, b = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    order = rng.permutation(len(segments))
    check, learn = order[: len(order) // 10], order[len(order) // 10 :]
    steps, step = EPOCHS * max(1, len(learn)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            ids, y = segments[i]
            rate = RATE * (1 - step / steps)
            h = E[ids].mean(axis=0)
            g = softmax(h @ W + b)
            g[y] -= 1
            back = W @ g
            W -= rate * np.outer(h, g)
            b -= 0.05 * rate * g
            np.subtract.at(E, ids, rate * back / len(ids) * 8)
            step += 1
    table = (E @ W).astype(np.float32)
    model = Model(langs, table, b)
    if len(check):
        z = np.array([b + table[segments[i][0]].mean(axis=0) for i in check])
        y = np.array([segments[i][1] for i in check])

        def loss(t: float) -> float:
            return -sum(np.log(softmax(z[k] / t)[y[k]] + 1e-12) for k in range(len(y)))

        model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    return model


def training_rows(documents: DataFrame, per_lang: int = PER_LANG, fit_docs: int = FIT_DOCS, chars: int = PASSAGE_CHARS) -> list[tuple[str, str]]:
    """(passage, lang) of about per_lang documents of each language, all languages alike, by a threshold on a hash of id
    and text; held-out and null-lang rows never. A longer text gives a passage of `chars` characters from a hashed place."""
    part = F.xxhash64("doc_id", "text", F.lit("langid"))
    own = documents.where(F.col("lang").isNotNull() & ~held_out() & (F.length("text") > 0)).select("doc_id", "text", "lang", part.alias("_h"))
    counts = stored(own.groupBy("lang").agg(F.count("*").alias("_n")).withColumnRenamed("lang", "_lang"), "langs")
    n = counts.count()
    each = max(8, min(per_lang, fit_docs // max(1, n)))  # so that hardly any language goes without
    counts = F.broadcast(counts) if n <= MAX_BROADCAST_LANGS else counts.hint("merge")
    some = own.join(counts, own["lang"] == counts["_lang"]).where(F.pmod("_h", F.lit(1 << 40)) <= F.lit(1 << 40) / F.col("_n") * each)
    at = F.pmod(F.shiftright("_h", 20), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    got = some.select("doc_id", "lang", F.substring(F.col("text"), at.cast("int"), F.lit(chars)).alias("text")).distinct().collect()
    return [(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["lang"], r["text"]))]


def identify(documents: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row; rejected where the calibrated score is under `reject`.

    Null texts and texts without a letter: `und`, 0, rejected. Null or repeated ids: a row each. lang and source are not
    read here.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            got = [shared.value.predict(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), pa.array([s < reject for _, s in got])], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    own = documents.select("doc_id", held_out().alias("held_out"), "text")
    return map_texts(own, run, typed(own.drop("text"), "lang_pred string, score double, rejected boolean"))
