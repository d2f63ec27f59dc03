"""Importance resampling towards a target: n-grams counted in hashed buckets, their CRCs taken from running CRCs of a text."""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.tables import positions, table
from crossfactor.session import cut

#: Capitals become small letters; all bytes but digits, small letters and those of other code points become a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
APART = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text normalised at once, and words whose n-grams are hashed at once.
SLICE, WORDS = 1 << 20, 200_000
BUCKETS, LONGEST = 10_000, 2
ONES = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _byte_step() -> np.ndarray:
    """What a register of zlib's CRC becomes by one zero byte, by its last byte (the other three move down)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


@lru_cache(maxsize=48)
def _shift_tables(j: int) -> np.ndarray:
    """The linear map over GF(2) that appends ``2**j`` zero bytes, as four tables by the bytes of the register."""
    own = np.arange(256, dtype=np.uint32)
    out = np.stack([own << np.uint32(8 * b) for b in range(4)])
    if j == 0:
        return _byte_step()[out & np.uint32(255)] ^ (out >> np.uint32(8))
    return _mapped(_mapped(out, _shift_tables(j - 1)), _shift_tables(j - 1))


def _mapped(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return t[0][x & m] ^ t[1][x >> np.uint32(8) & m] ^ t[2][x >> np.uint32(16) & m] ^ t[3][x >> np.uint32(24)]


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs followed by ``n`` zero bytes: one map for each bit of ``n``."""
    out, j = crc.astype(np.uint32), 0
    most = int(n.max(initial=0))
    while most >> j:
        at = np.flatnonzero(n >> j & 1)
        out[at] = _mapped(out[at], _shift_tables(j))
        j += 1
    return out


class Prefixes:
    """Words of stretches of texts, with the CRC of the normalised text (words joined by one space) before and up to each.

    A stretch is a slice of a text; all but the first begin with the last words of the slice before, which complete the
    runs that cross and are not ``fresh``.
    """

    def __init__(self):
        self.crc_end: list[int] = []
        self.length: list[int] = []
        self.stretches: list[tuple[int, int, int, int]] = []  # text, words, words that are not fresh, CRC before the first

    def scan(self, row: int, words: list[bytes], crc: int, stale: int) -> int:
        """Adds a stretch behind a prefix with ``crc`` and returns the CRC up to its end and a space."""
        self.stretches.append((row, len(words), stale, crc))
        for w in words:
            crc = crc32(w, crc)
            self.crc_end.append(crc)
            crc = crc32(b" ", crc)
        self.length += map(len, words)
        return crc

    def ngrams(self, longest: int, buckets: int, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and bucket of every run of 1 to ``longest`` words whose last is fresh, and fresh words by text."""
        end, length = np.array(self.crc_end, np.uint32), np.array(self.length, np.int64)
        row, n, stale, crc = (np.array(x) for x in zip(*self.stretches))
        first = np.cumsum(n) - n
        stretch = np.repeat(np.arange(len(n)), n)
        fresh = np.arange(len(end)) >= (first + stale)[stretch]
        # the CRC before a word is the one up to the word before it, and a space
        reg = end ^ ONES
        start = np.roll((_byte_step()[(reg ^ np.uint32(32)) & np.uint32(255)] ^ (reg >> np.uint32(8))) ^ ONES, 1)
        start[first] = crc.astype(np.uint32)
        stop = np.cumsum(length + 1) - 1
        rows, found = [], []
        for k in range(1, longest + 1):
            tail = np.flatnonzero(fresh[k - 1 :] & (stretch[k - 1 :] == stretch[: len(end) - k + 1])) + k - 1
            head = tail - k + 1
            whole = end[tail] ^ shifted(start[head], stop[tail] - stop[head] + length[head])
            rows.append(row[stretch[tail]])
            found.append((whole % np.uint32(buckets)).astype(np.int64))
        return np.concatenate(rows), np.concatenate(found), np.bincount(row[stretch[fresh]], minlength=n_rows)


def ngram_buckets(texts: list[bytes | None], longest: int = LONGEST, buckets: int = BUCKETS):
    """``(row, bucket, n_words)`` in batches: every run of 1 to ``longest`` words of whole texts, repeats included.

    Each text is normalised and scanned once, slice by slice; the CRC of a run is that of the prefix up to its end less that
    of the prefix before it, moved by the run's length. ``n_words`` counts a batch's words by text.
    """
    batch = Prefixes()
    for row, text in enumerate(texts):
        at, crc, held = 0, 0, []  # held: the last words with the CRC before each
        while text is not None and at < len(text):
            gap = APART.search(text, at + SLICE)
            stop = gap.end() if gap else len(text)
            words = text[at:stop].translate(FOLD).split()
            at = stop
            if not words:
                continue
            stale = len(held)
            words = [w for w, _ in held] + words
            base = len(batch.crc_end)
            before = held[0][1] if held else crc
            crc = batch.scan(row, words, before, stale)
            keep = max(0, len(words) - longest + 1)
            before = crc32(b" ", batch.crc_end[base + keep - 1]) if keep else before
            held = []
            for w in words[keep:]:
                held.append((w, before))
                before = crc32(b" ", crc32(w, before))
            if len(batch.crc_end) >= WORDS:
                yield batch.ngrams(longest, buckets, len(texts))
                batch = Prefixes()
    if batch.stretches:
        yield batch.ngrams(longest, buckets, len(texts))


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows of a binary column ``text`` by bucket: one array of ``buckets`` sums, whatever the table's size."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for _, b, _ in ngram_buckets(list(pdf["text"]), longest, buckets):
                total += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the corpus, floored."""
    n = len(s)
    s, t, total, wanted = s.astype(float), t.astype(float), float(s.sum()), float(t.sum())
    return np.floor(1000 * np.log((t + 1) * (total + n) / ((s + 1) * (wanted + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, n_features, n_words, weight)``, one row per row of ``docs``; the mean gain of a text's features, floored."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    @F.pandas_udf("n_features long, n_words long, weight long")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        g = shared.value
        n, words, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for row, bucket, w in ngram_buckets(list(texts), longest, len(g)):
            n += np.bincount(row, minlength=len(texts))
            words += w
            total += np.bincount(row, weights=g[bucket], minlength=len(texts)).astype(np.int64)
        return pd.DataFrame({"n_features": n, "n_words": words, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)})

    return docs.select("doc_id", weigh(F.col("text").cast("binary")).alias("w")).select("doc_id", "w.*")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``: ``share`` percent of the documents with ``least_words`` words, drawn
    without replacement with odds that grow with their weights (the highest of weight plus Gumbel noise).

    The noise is a function of seed and id, so a draw repeats on any layout; rank counts from 1 down the scores, ties to
    smaller ids, and is null for what is not drawn. A null text has no features and weight 0; a null id has the noise of
    an empty one and comes last among ties; rows equal in id and score follow their features and weight. An empty table
    gives no rows, an empty target leaves the corpus' own shares. Other columns are not read.
    """
    text = F.col("text").cast("binary").alias("text")
    gain = gains(bucket_counts(docs.select(text), longest, buckets), bucket_counts(target.select(text), longest, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(weights(docs.select("doc_id", "text"), gain, longest).withColumn("score", (F.col("weight") + noise).cast("long")))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = share * able.count() // 100
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    ranked = positions(able, by, [], "_at").withColumn("rank", F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("long"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("_at").unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
