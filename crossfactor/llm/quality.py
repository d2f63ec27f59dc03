"""Quality of a text: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.tables import class_sample, fold, table

#: A word of letters, one of digits, or a run of other signs that stand together.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BLANK = re.compile(r"\s")
#: Buckets of n-grams; characters split at once; entries after which a worker's cache of tokens starts anew.
BITS, SLICE, CACHE = 18, 1 << 20, 500_000
#: Code points of the texts whose words are looked up together, and tokens whose runs are made together.
GROUP, BLOCK = 1 << 23, 1 << 16
#: The shape of a token that repeats the one before it; odd multipliers that tell n-grams of one length from another.
AGAIN = np.uint64(0x27D4EB2F165667C5)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shape(word: str) -> str:
    """How a word is written: capitals, one capital first, small letters, another mixture; digits and signs as they are."""
    if not word[0].isalpha():
        return "9" if word[0].isdigit() else word[:4]
    if word.islower():
        return "a"
    return "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() and word[1:] == word[1:].lower() else "aA"


@lru_cache(1 << 12)
def shape_code(form: str) -> int:
    return xxhash.xxh64_intdigest(form, seed=1)


class _Codes(dict):
    """Token -> place in two arrays of 64-bit codes, of its lower-cased form and of its shape; filled on demand."""

    def __init__(self):
        super().__init__()
        self.word, self.shape = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        if at >= len(self.word):
            self.word, self.shape = np.resize(self.word, 2 * at), np.resize(self.shape, 2 * at)
        self.word[at] = xxhash.xxh64_intdigest(token.lower())
        self.shape[at] = shape_code(shape(token))
        return at

    def each(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE:
            self.__init__()
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.word[at], self.shape[at]

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        word, form = self.each(tokens)
        form[1:][word[1:] == word[:-1]] = AGAIN
        return word, form


def _runs(codes: np.ndarray, n: int) -> list[np.ndarray]:
    """Buckets of all runs of 1 to ``n`` neighbouring codes."""
    out = []
    h = np.zeros(len(codes), np.uint64)
    for k in range(1, n + 1):
        if len(codes) < k:
            break
        h = (h[: len(codes) - k + 1] * MIX[0] + codes[k - 1 :]) * MIX[1]
        x = h + MIX[2] * np.uint64(k)
        x ^= x >> np.uint64(31)
        out.append(((x * MIX[0]) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def buckets(text: str, cache: _Codes, words: int = 2, shapes: int = 3):
    """Arrays of buckets of all n-grams of a whole text, slice by slice: runs of up to ``words`` tokens, and of up to
    ``shapes`` shapes. A slice starts with the last tokens of the one before it, whose runs are not counted twice."""
    at, held = 0, []
    carry = max(words, shapes)  # one more than a run needs, to tell whether its first token repeats another
    while at < len(text):
        gap = BLANK.search(text, at + SLICE)
        stop = gap.end() if gap else len(text)
        tokens = TOKEN.findall(text, at, stop)
        at = stop
        if not tokens:
            continue
        word, form = cache.of(held + tokens)
        fresh = len(held)
        out = []
        for codes, n in ((word, words), (form, shapes)):
            # a run is new when its last token is
            out += [r[max(0, fresh - k) :] for k, r in enumerate(_runs(codes, n))]
        held = (held + tokens)[-carry:]
        yield np.concatenate(out)


def _blocks(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``most`` at most, or that are one alone."""
    end, a = np.r_[0, np.cumsum(size)], 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(end, end[a] + most, "right")) - 1)
        yield a, b
        a = b


@dataclass
class Tokens:
    """Tokens of some texts: how many each text has, their numbers text after text, and both codes of each number."""

    size: np.ndarray
    number: np.ndarray
    word: np.ndarray
    shape: np.ndarray

    @classmethod
    def of(cls, texts: list[str], cache: _Codes) -> Tokens:
        """No token holds white space, so Arrow splits the texts there and each distinct piece is taken apart once.

        A blank between a letter and a sign is where one token ends anyway, and leaves fewer pieces that are distinct.
        """
        spaced = pc.replace_substring_regex(pa.array(texts, pa.string()), "([A-Za-z])([.,])", r"\1 \2")
        pieces = pc.ascii_split_whitespace(spaced)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        whole = np.fromiter(map(str.isalpha, distinct), bool, len(distinct))  # these are one token each
        found = list(map(TOKEN.findall, distinct[~whole]))
        words, parts = distinct[whole], list(chain.from_iterable(found))
        word, form = cache.each(parts)  # signs and numbers, most of them again and again
        word = np.r_[np.fromiter(map(xxhash.xxh64_intdigest, map(str.lower, words)), np.uint64, len(words)), word]
        form = np.r_[np.fromiter(map(shape_code, map(shape, words)), np.uint64, len(words)), form]

        held = np.ones(len(distinct), np.int64)
        held[~whole] = np.fromiter(map(len, found), np.int64, len(found))
        order = np.argsort(~whole, kind="stable")  # as their tokens stand
        first = np.empty(len(distinct), np.int64)
        first[order] = np.cumsum(held[order]) - held[order]

        # from a number for each piece of the texts to one for each token
        piece = coded.indices.to_numpy()
        n = held[piece]
        end = np.r_[0, np.cumsum(n)]
        number = np.repeat(first[piece] - end[:-1], n) + np.arange(end[-1])
        return cls(np.diff(end[pieces.offsets.to_numpy()]), number, word, form)


@dataclass
class Model:
    """Weights of the buckets and the constant; a score is the logistic value of their mean over a text's n-grams."""

    weights: np.ndarray
    bias: float
    scale: float
    cache: _Codes = field(default_factory=_Codes, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "scale": self.scale}

    def __setstate__(self, state):
        self.__init__(**state)

    def logistic(self, total, n):
        """Scores of texts from the sum of weights and the number of their n-grams; without any there is the constant alone."""
        z = self.bias + self.scale * total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        """The sparse dot product of shares of n-grams and weights, slice by slice of the text."""
        total, n = 0.0, 0
        for b in buckets(text or "", self.cache):
            total += float(self.weights[b].sum(dtype=np.float64))
            n += len(b)
        return float(self.logistic(total, n))

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """``score`` of each text; those of one slice are scored together, longer ones alone."""
        texts = [t or "" for t in texts]
        size = np.array([len(t) for t in texts], np.int64)
        out = np.zeros(len(texts))
        for i in np.flatnonzero(size > SLICE):
            out[i] = self.score(texts[i])
        short = np.flatnonzero(size <= SLICE)
        for a, b in _blocks(size[short], GROUP):
            out[short[a:b]] = self._together([texts[i] for i in short[a:b]])
        return out

    def _together(self, texts: list[str], words: int = 2, shapes: int = 3) -> np.ndarray:
        """Scores of a group of texts, the runs of a block of them in one array."""
        t = Tokens.of(texts, self.cache)
        total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        end = np.r_[0, np.cumsum(t.size)]
        for a, b in _blocks(t.size, BLOCK):
            number, size = t.number[end[a] : end[b]], t.size[a:b]
            text = np.repeat(np.arange(b - a), size)
            word, form = t.word[number], t.shape[number]
            form[1:][(word[1:] == word[:-1]) & (text[1:] == text[:-1])] = AGAIN
            for codes, n in ((word, words), (form, shapes)):
                for k, run in enumerate(_runs(codes, n)):
                    # a run belongs to the text of its last token, if its first one is there too
                    weight = np.where(text[k:] == text[: len(run)], self.weights[run], 0)
                    total[a:b] += np.bincount(text[k:], weight, b - a)
                    count[a:b] += np.maximum(size - k, 0)
        return self.logistic(total, count)


def train(bags: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, weight: np.ndarray, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0,
          l1: float = 1.0, l2: float = 0.2, scale: float = 20.0, seed: int = 13) -> Model:
    """Follow-the-regularised-leader, one document at a time, each bucket at its own rate.

    ``bags``: distinct buckets of a document and their counts; ``weight``: how many documents each stands for (their mean
    is made 1). The constant is not regularised, and the class that stands for more documents than it has rows pulls as
    much harder, so scores are shares of the whole corpus.
    """
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    bz, bn = 0.0, 0.0
    rng = np.random.default_rng(seed)
    weight = weight / weight.mean() if len(weight) else weight
    unit = [(i, scale * c / max(1, c.sum())) for i, c in bags]

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for d in rng.permutation(len(unit)):
            i, x = unit[d]
            zi, ni = z[i], n[i]
            w = leader(zi, ni)
            b = -bz / ((beta + np.sqrt(bn)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30)))
            pull = weight[d] * (p - good[d])
            g = pull * x
            square = ni + g * g
            z[i] = zi + g - (np.sqrt(square) - np.sqrt(ni)) / alpha * w
            n[i] = square
            bz += pull - (np.sqrt(bn + pull * pull) - np.sqrt(bn)) / alpha * b
            bn += pull * pull
    return Model(leader(z, n).astype(np.float32), float(-bz / ((beta + np.sqrt(bn)) / alpha)), scale)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, most_tokens: int = 4000, **options) -> Model:
    """Learns from ``labels`` (``doc_id``, ``quality`` 0 or 1; others and nulls are left out) and the texts they name.

    The fit is bounded: about ``per_class`` documents of each label, and ``most_tokens`` times 8 code points of each, from
    its middle. The share of good documents, which the score is calibrated to, comes from all labels.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0)
    chosen = class_sample(known, "quality", "doc_id", per_class)
    room = 8 * most_tokens

    @F.pandas_udf("at array<int>, n array<int>")
    def bag(texts: pd.Series) -> pd.DataFrame:
        cache, out = _Codes(), []
        for t in texts:
            start = max(0, (len(t) - room) // 2)
            got = list(buckets(t[start : start + room], cache))
            out.append([x.astype(np.int32) for x in np.unique(np.concatenate(got), return_counts=True)] if got else [[], []])
        return pd.DataFrame({"at": [x[0] for x in out], "n": [x[1] for x in out]})

    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most twice per_class ids
    rows = texts.select("doc_id", "quality", bag("text").alias("b")).select("doc_id", "quality", "b.*").collect()
    bags = [(np.asarray(r["at"], np.int64), np.asarray(r["n"], np.float64)) for r in rows]
    y = np.array([r["quality"] for r in rows], np.int64)
    # one order of documents whatever the order of reading
    order = sorted(range(len(y)), key=lambda k: (rows[k]["doc_id"], y[k], len(bags[k][0]), bags[k][0].tobytes(), bags[k][1].tobytes()))
    y, bags = y[order], [bags[k] for k in order]
    got = np.bincount(y, minlength=2)
    weight = np.array([counts.get(int(v), 0) / max(1, got[int(v)]) for v in y])
    return train(bags, y, weight, **options)


def score_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """A column with the score of a whole text; a null, an empty one and one without a token have the constant's score."""
    shared = spark.sparkContext.broadcast(model)  # 1 << BITS weights

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    return score(F.col(text))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``, one row per row of ``docs``, none for an empty table; only the text decides.

    Ids may be null or repeat, equal texts have equal scores, and other columns are not read, whatever their names.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), score_column(docs.sparkSession, model, text).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(parts=5) != 0))
    held = F.coalesce(fold(parts=5) == 0, F.lit(False)).alias("held_out")
    return score_documents(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
