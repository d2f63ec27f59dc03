"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.tables import class_sample, fold, table

#: A word, or a mark that ends a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
MARKS = frozenset(".!?\n")
BITS, LONGEST = 16, 48
#: Tokens scored at once, characters split at once, entries after which a worker's cache of words starts anew, chains in a matrix.
TOKENS, SLICE, CACHE, CHAINS = 200_000, 1 << 20, 500_000, 8192


def parts(word: str) -> list[str]:
    """What may mark a word: itself and its beginnings."""
    w = word.lower()
    return ["w:" + w] + ["p:" + w[:n] for n in (4, 5, 6, 7, 8) if len(w) > n]


def features(word: str) -> list[int]:
    w = word.lower()
    return [xxhash.xxh32_intdigest(p.encode()) >> (32 - BITS) for p in [*parts(word), "s:" + w[-3:]]]


def segments(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chain number and place of every token that is no mark: sentences, cut after ``LONGEST`` tokens."""
    sentence = np.cumsum(mark)[~mark]
    n = len(sentence)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    fresh = place % LONGEST == 0
    return np.cumsum(fresh) - 1, place % LONGEST


def chains(chain: np.ndarray, place: np.ndarray):
    """Index matrices ``[chains, steps]`` of some chains of about the same length, -1 where a chain has ended."""
    if not len(chain):
        return
    first = np.flatnonzero(place == 0)
    length = np.diff(np.r_[first, len(chain)])
    for low, high in ((0, 4), (4, 8), (8, 16), (16, 32), (32, LONGEST)):
        same = np.flatnonzero((length > low) & (length <= high))
        for i in range(0, len(same), CHAINS):
            own, steps = same[i : i + CHAINS], np.arange(high, dtype=np.int32)[None, :]
            at = first[own].astype(np.int32)[:, None] + steps
            at[steps >= length[own][:, None]] = -1
            yield at


def marginals(score: np.ndarray, at: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains with two states, kept as ratios toxic : clean.

    ``score``: log ratio of a token alone; ``move``: log weights of the four moves. Returns the probability of toxic at
    every place (0 where the chain has ended) and both passes' ratios.
    """
    n, steps = at.shape
    a = np.exp(move)
    e = np.where(at >= 0, np.exp(np.clip(score[at], -30, 30)), 1.0)
    ahead, back = np.empty((n, steps)), np.ones((n, steps))
    ahead[:, 0] = e[:, 0]
    for t in range(1, steps):
        r = ahead[:, t - 1]
        ahead[:, t] = e[:, t] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
    for t in range(steps - 2, -1, -1):
        b = e[:, t + 1] * back[:, t + 1]
        step = (a[1, 0] + a[1, 1] * b) / (a[0, 0] + a[0, 1] * b)
        back[:, t] = np.where(at[:, t + 1] >= 0, step, 1.0)
    odds = ahead * back
    return np.where(at >= 0, odds / (1 + odds), 0.0), ahead, back


class _Scores(dict):
    """Token -> log ratio, filled on demand."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) > CACHE:
            self.clear()
        s = self[token] = np.nan if token in MARKS else float(self.weights[features(token)].sum() + self.weights[-1])
        return s


@dataclass
class Model:
    """Weights of hashed word parts, of the four moves, and of the four figures that make a document's score."""

    weights: np.ndarray
    move: np.ndarray
    document: np.ndarray
    span: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self):
        self.cache = _Scores(self.weights)

    def __getstate__(self):
        return {"weights": self.weights, "move": self.move, "document": self.document, "span": self.span}

    def __setstate__(self, state):
        self.__init__(**state)

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        """Log ratio of every token, not a number for a mark."""
        return np.fromiter(map(self.cache.__getitem__, tokens), np.float64, len(tokens))

    def tag(self, score: np.ndarray) -> np.ndarray:
        """Probability of toxic for every token, 0 for marks."""
        mark = np.isnan(score)
        inner = score[~mark]
        chain, place = segments(mark)
        p = np.zeros(len(inner))
        for at in chains(chain, place):
            m, _, _ = marginals(inner, at, self.move)
            p[at[at >= 0]] = m[at >= 0]
        out = np.zeros(len(score))
        out[~mark] = p
        return out


def words_of(text: str):
    """``(start, stop, tokens)`` of slices of a text that end between words."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + SLICE)
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        yield at, stop, TOKEN.findall(text, at, stop)
        at = stop


def figures(most: np.ndarray, total: np.ndarray, n: np.ndarray, span: tuple[float, float]) -> np.ndarray:
    """What a document is scored by; lengths outside the span that was learned from count as its ends."""
    return np.stack([most, np.log1p(total), np.log1p(np.clip(n, *span)), np.ones(len(n))], axis=1)


@dataclass
class Sample:
    """Documents as arrays of word numbers, and the table of their words: a few integers a word, however often it occurs."""

    docs: list[np.ndarray]
    words: list[str]
    mark: np.ndarray
    features: np.ndarray  # hashed, padded by 1 << BITS

    @classmethod
    def of(cls, texts: list[str]) -> Sample:
        """From texts whose tokens are joined by tabs."""
        place: dict[str, int] = {"\n": 0}
        docs = [np.array([place.setdefault(w, len(place)) for w in t.split("\t") if w], np.int32) for t in texts]
        words = list(place)
        mark = np.array([w in MARKS for w in words])
        table = np.full((len(words), 8), 1 << BITS, np.int32)
        for i, w in enumerate(words):
            if not mark[i]:
                f = features(w)
                table[i, : len(f)] = f
        return cls(docs, words, mark, table)

    def marked(self, toxic: np.ndarray, least: float = 20.0, precision: float = 0.8) -> np.ndarray:
        """The words with a part that marks toxic documents: far more often in those than chance allows, and seldom
        elsewhere. Each document counts a part once."""
        own = np.zeros((len(self.words), 6), np.uint64)  # 64 bits of each part, 0 where a word has fewer
        for i, w in enumerate(self.words):
            if not self.mark[i]:
                p = [xxhash.xxh64_intdigest(x.encode()) for x in parts(w)]
                own[i, : len(p)] = p
        number, own = np.unique(own, return_inverse=True)
        own = own.reshape(len(self.words), 6).astype(np.int32)
        seen = np.zeros((2, len(number)))
        for d, y in zip(self.docs, toxic.tolist()):
            seen[y, np.unique(own[np.unique(d)])] += 1
        seen[:, number == 0] = 0
        base = min(max(float(toxic.mean()), 1e-9), 1 - 1e-9)
        n0, n1 = seen
        share = n1 / np.maximum(n0 + n1, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = n1 * np.log(share / base) + np.where(n0 > 0, n0 * np.log((1 - share) / (1 - base)), 0.0)
        telling = (n1 >= 3) & (share >= max(precision, base)) & (2 * gain >= least)
        return telling[own].any(axis=1)


def train_tagger(sample: Sample, labels: list[np.ndarray], epochs: int = 6, rate: float = 0.5, l2: float = 1e-4, seed: int = 5, most: int = 40_000) -> tuple[np.ndarray, np.ndarray]:
    """Fits the field to labelled tokens by stochastic gradient: expected minus observed features and moves.

    All chains with a toxic token are used and, up to ``most`` in all, others.
    """
    flat = np.concatenate([np.append(d, 0) for d in sample.docs])
    y = np.concatenate([np.append(x, False) for x in labels])
    mark = sample.mark[flat]
    flat, y = flat[~mark], y[~mark]
    size, width = 1 << BITS, sample.features.shape[1]
    w, square = np.zeros(size + 2), np.full(size + 2, 1e-2)  # the last is the constant, the one before it stays 0
    move, move_square = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    rng = np.random.default_rng(seed)
    chain, place = segments(mark)
    n_all, kept = max(1, int((place == 0).sum())), []
    for g in chains(chain, place):
        hot = ((g >= 0) & y[g]).any(axis=1) | (rng.random(len(g)) < most / n_all)
        kept += [g[hot][i : i + 256] for i in range(0, int(hot.sum()), 256)]
    del chain, place
    score = np.zeros(len(y))
    for _ in range(epochs):
        for k in rng.permutation(len(kept)):
            at = kept[k]
            on = at >= 0
            tok = at[on]
            f = sample.features[flat[tok]]
            score[tok] = w[f].sum(axis=1) + w[-1]
            p, ahead, back = marginals(score, at, move)
            g = (p[on] - y[tok].astype(float)) / len(at)
            grad = np.bincount(f.ravel(), weights=np.repeat(g, width), minlength=size + 2)
            grad[-1] = g.sum()
            grad[size] = 0.0
            grad += l2 * w
            square += grad * grad
            w -= rate * grad / np.sqrt(square)
            # moves: expected from both passes' ratios, observed from the labels
            a = np.exp(move)
            both = on[:, 1:]
            r, b = ahead[:, :-1][both], (np.where(on, np.exp(np.clip(score[at], -30, 30)), 1.0) * back)[:, 1:][both]
            cell = np.stack([np.full(len(r), a[0, 0]), a[0, 1] * b, a[1, 0] * r, a[1, 1] * r * b])
            want = (cell / cell.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(r) else np.zeros((2, 2))
            have = np.zeros((2, 2))
            np.add.at(have, (y[at[:, :-1][both]].astype(int), y[at[:, 1:][both]].astype(int)), 1)
            grad = (want - have) / len(at) + l2 * move
            move_square += grad * grad
            move = move - 0.2 * rate * grad / np.sqrt(move_square)
    return np.r_[w[:size], w[-1]], move


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, **options) -> Model:
    """From documents as tokens joined by tabs, their labels, and the number of documents that each stands for.

    Token labels: in a toxic document, the words with a part in the lexicon are toxic; all other words are clean. The
    document score is a logistic function of the highest marginal, the sum of marginals and the length.
    """
    if not len(toxic):
        return Model(np.zeros((1 << BITS) + 1), np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, -20.0]))
    sample = Sample.of(texts)
    marked = sample.marked(toxic)
    w, move = train_tagger(sample, [marked[d] & bool(y) for d, y in zip(sample.docs, toxic)], **options)
    n = np.array([len(d) for d in sample.docs], float)
    model = Model(w, move, np.zeros(4), (float(n.min()), float(n.max())))
    score = model.token_scores(sample.words)
    p = [model.tag(score[d]) for d in sample.docs]
    x = figures(np.array([q.max(initial=0) for q in p]), np.array([q.sum() for q in p]), n, model.span)
    beta = np.zeros(4)
    for _ in range(50):  # Newton steps of a weighted, slightly damped logistic fit
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(4)
        step = np.linalg.solve(h, x.T @ (weight * (toxic - q)) - 0.5 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.document = beta
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_tokens: int = 1500, **options) -> Model:
    """Learns from ``labels`` (``doc_id``, ``toxic`` 0 or 1; others and nulls are left out) and the texts they name.

    The fit is bounded: about ``per_class`` documents of each label, ``most_tokens`` tokens from the middle of each.
    The share of toxic documents, which the score is calibrated to, comes from all labels.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = class_sample(known, "toxic", "doc_id", per_class)

    @F.pandas_udf("string")
    def middle(texts: pd.Series) -> pd.Series:
        room = most_tokens * 12
        at = [max(0, (len(t) - room) // 2) for t in texts]
        return pd.Series(["\t".join(TOKEN.findall(t, a, a + room)[:most_tokens]) for t, a in zip(texts, at)], dtype=object)

    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most twice per_class ids
    rows = texts.select("doc_id", "toxic", middle("text").alias("t")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["t"]))
    y = np.array([r["toxic"] for r in rows], np.int64)
    got = np.bincount(y, minlength=2)
    weight = np.array([counts.get(int(v), 0) / max(1, got[int(v)]) for v in y])
    return train([r["t"] for r in rows], y, weight, **options)


def score_column(spark: SparkSession, model: Model, text: str = "text"):
    """A column ``(score, spans)``: the document's score, and where words are toxic with probability above a half.

    Spans are ``(start, end)`` in code points of the whole text, neighbours apart. A null or empty text has the score
    that its missing evidence gives and no spans.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int>>")
    def score(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        top, total, count = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        spans: list[list] = [[] for _ in range(len(texts))]
        held: list = []
        rows = 0

        def flush() -> None:
            # a mark after each slice: documents and slices do not share a chain
            p = m.tag(np.concatenate([np.append(s, np.nan) for *_, s in held]))
            at = 0
            for i, t, start, stop, s in held:
                q = p[at : at + len(s)]
                at += len(s) + 1
                top[i] = max(top[i], q.max(initial=0))
                total[i] += q.sum()
                hit = set(np.flatnonzero(q > 0.5).tolist())
                if hit:
                    spans[i] += [list(x.span()) for k, x in enumerate(TOKEN.finditer(t, start, stop)) if k in hit]
            held.clear()

        for i, t in enumerate(texts):
            for start, stop, tokens in words_of(t or ""):
                s = m.token_scores(tokens)
                count[i] += len(s)
                held.append((i, t, start, stop, s))
                rows += len(s)
                if rows >= TOKENS:
                    flush()
                    rows = 0
        if held:
            flush()
        z = figures(top, total, count, m.span) @ m.document
        return pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "spans": spans})

    return score(F.col(text))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, spans)``, one row per row of ``docs``; only the text decides. Ids may be null or repeat."""
    out = docs.select(F.col(doc_id).alias("doc_id"), score_column(docs.sparkSession, model, text).alias("s"))
    return out.select("doc_id", "s.score", "s.spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.3, held: int = 2) -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, all columns kept; learned from labels outside fold ``held``."""
    model = fit(docs, labels.where(fold(parts=4) != held))
    name = "_toxic"
    while name in docs.columns:
        name += "_"
    scored = docs.withColumn(name, score_column(docs.sparkSession, model).getField("score"))
    return scored.where(F.col(name) < reject).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(parts=4) != 2))
    held = F.coalesce(fold(parts=4) == 2, F.lit(False)).alias("held_out")
    return score_documents(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
