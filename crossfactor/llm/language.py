"""Language of a text: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.tables import class_sample, fold, table

#: Buckets of subwords, size of an embedding, lengths of subwords.
BITS, DIM, LENGTHS = 15, 16, (2, 3, 4)
#: Code points scored at once.
SLICE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords: runs of 2 to 4 letters of lower-cased words, word ends included; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64)
    c = np.where(_letters()[codes], codes, np.uint32(32))
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)])).astype(np.uint32)
    gap = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    c = c[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    gap = c == 32
    out, h, inner = [], c, None
    for k in range(2, max(LENGTHS) + 1):
        if len(c) < k:
            break
        h = h[:-1] * np.uint32(0x01000193) + c[k - 1 :]
        if k > 2:
            mid = gap[k - 2 : len(c) - 1]
            inner = mid if inner is None else inner[:-1] | mid
        if k in LENGTHS:
            b = (h ^ np.uint32(k * 0x3D4D51CB & 0xFFFFFFFF)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
            out.append(b if inner is None else b[~inner])
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """``table``: the embeddings times the softmax weights, so a score is a mean of rows."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        """Of a whole text, slice by slice; None without letters."""
        total, n = np.zeros(len(self.labels)), 0
        for at in range(0, len(text), SLICE):
            b = subwords(text[at : at + SLICE])
            if len(b) * 8 < len(self.table):
                total += self.table[b].sum(axis=0, dtype=np.float64)
            else:
                total += np.bincount(b, minlength=len(self.table)) @ self.table
            n += len(b)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, calibrated probability, and whether that is too low to be relied on."""
        z = self.logits(text) if text and self.labels else None
        if z is None:
            return UNKNOWN, 0.0, True
        p = _softmax(z[None, :] / self.temperature)[0]
        i = int(p.argmax())
        return self.labels[i], float(p[i]), bool(p[i] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], owner: list[int] | None = None, epochs: int = 4, rate: float = 4.0, seed: int = 3, target: float = 0.99) -> Model:
    """Stochastic gradient descent over the texts; those of a fifth of their owners (by default each its own) are held
    back to calibrate the probabilities.

    The temperature is the one of the least log loss on that fifth; a prediction is rejected below the least
    probability from which at least ``target`` of that fifth's predictions are right.
    """
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    bags = [subwords(t) for t in texts]
    y = np.array([labels.index(x) for x in langs])
    use = np.array([len(b) > 0 for b in bags])
    order = rng.permutation(len(bags))
    order = order[use[order]]
    owner = np.arange(len(texts)) if owner is None else np.array(owner)
    whose = rng.permutation(np.unique(owner[order]))
    back = np.isin(owner[order], whose[: len(whose) // 5])
    held, rest = order[back], order[~back]
    size = 1 << BITS
    e = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    w = rng.uniform(-1 / DIM, 1 / DIM, (DIM, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    epochs = max(epochs, -(-20_000 // max(1, len(rest))))  # a small sample is read oftener
    steps, done = max(1, epochs * -(-len(rest) // 32)), 0
    for _ in range(epochs):
        rest = rng.permutation(rest)
        for at in range(0, len(rest), 32):
            batch = rest[at : at + 32]
            # only the rows of buckets that occur in the batch are read and written
            ids, back = np.unique(np.concatenate([bags[i] for i in batch]), return_inverse=True)
            lens = np.array([len(bags[i]) for i in batch])
            flat = np.repeat(np.arange(len(batch)), lens) * len(ids) + back
            x = (np.bincount(flat, minlength=len(batch) * len(ids)).reshape(len(batch), -1) / lens[:, None]).astype(np.float32)
            mean = x @ e[ids]
            g = _softmax(mean @ w + bias)
            g[np.arange(len(batch)), y[batch]] -= 1
            step = np.float32(rate * (1 - done / steps) / len(batch))
            back_e = x.T @ (g @ w.T)
            w -= step * (mean.T @ g)
            bias -= step * g.sum(axis=0)
            e[ids] -= step * len(batch) * back_e
            done += 1
    model = Model(labels, (e @ w).astype(np.float32), bias.astype(np.float64))
    if len(held) and len(labels) > 1:
        z, truth = np.array([model.logits(texts[i]) for i in held]), y[held]
        grid = np.geomspace(0.05, 20, 81)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), truth], 1e-300)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        down = np.argsort(-best)
        good = np.flatnonzero(np.cumsum(right[down]) >= target * np.arange(1, len(down) + 1))
        model.threshold = float(best[down[good[-1]]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, per_class: int = 1500, chars: int = 600, most: int = 150_000, **options) -> Model:
    """Learns from ``text`` and ``lang`` of ``docs``, every language that occurs.

    The fit is bounded: about ``per_class`` documents of each language (fewer, but 20 at least, where there are so many
    languages that these exceed ``most``), ``chars`` code points from the middle of each, and a short cut of those."""
    known = docs.where(F.col("lang").isNotNull() & F.coalesce(F.length("text") > 0, F.lit(False)))
    start = F.greatest(F.lit(1), ((F.length("text") - chars) / 2).cast("int"))
    rows = class_sample(known.select("doc_id", "lang", "text"), "lang", "doc_id", per_class, most)
    rows = rows.select("doc_id", "lang", F.col("text").substr(start, F.lit(chars)).alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    texts = [r["text"] for r in rows] + [r["text"][: 20 + 10 * (i % 10)] for i, r in enumerate(rows)]
    return train(texts, [r["lang"] for r in rows] * 2, [*range(len(rows))] * 2, **options)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``, one row per row of ``docs``; only the text decides.

    A null text and one without a letter are ``und`` with score 0, as is everything when nothing could be learned.
    ``rejected`` marks predictions below the calibrated threshold. Ids may be null or repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).alias("doc_id"), guess(F.col(text)).alias("g")).select("doc_id", "g.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(parts=5) != 0))
    held = F.coalesce(fold(parts=5) == 0, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score", "rejected")
