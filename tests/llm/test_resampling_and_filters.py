"""Filter audit, importance resampling and the quality classifier: against SQL, brute force and held-out labels."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import check  # noqa: E402

from crossfactor.llm import filter_audit, importance, quality, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


# ---- filter audit


@given
def test_audit_equals_sql(spark):
    query, sql = queries.ENTRIES["op11_filter_audit"]
    assert check.compare(query(spark, SF), check.duck(SF), sql) == ""


def plain_audit(docs, labels):
    """Runs all orders document by document."""
    mark = {}
    for i, q, t in labels:
        old = mark.get(i, (0, 0))
        mark[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    rows, total = Counter(), Counter()
    parts = {d[3] or "" for d in docs}
    fails = []
    for i, text, _, source, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)
        fails.append((source or "", f, *(mark.get(i, (0, 0)) if i is not None else (0, 0))))
    for order in permutations("ABCDE"):
        for part, f, good, toxic in fails:
            gone = False
            for k, x in enumerate(order):
                key = (part, "".join(order), k + 1)
                here = f[x] and not gone
                rows[key, "removed"] += here
                rows[key, "redundant"] += f[x] and gone
                rows[key, "unique_fails"] += f[x] and sum(f.values()) == 1
                rows[key, "good_lost"] += here * good
                rows[key, "toxic_lost"] += here * toxic
                gone = gone or f[x]
                rows[key, "kept"] += not gone
                total[part, x] += here
    out = []
    for part in parts:
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                key = (part, "".join(order), k + 1)
                out.append((*key, *(rows[key, c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), total[part, x]))
    return sorted(out)


def test_audit_of_edge_cases_equals_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(300))
    docs = [
        (1, long, "en", "a", 1), (2, long, "en", "b", 1), (2, long, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "", 0), (None, long, "en", "a", 1),
        (None, None, None, "a", None), (5, "same " * 250, "en", "a", 1), (6, "SHOUT " * 250 + "#", "en", "a", 1), (7, long + " $", "en", "b", 1),
        (8, "é x " * 220, "fr", "b", 1), (-9, "same " * 250, "en", "b", 1),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (5, 0, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1)]
    counts = filter_audit.failures(spark.createDataFrame(docs, DOCS).withColumn("part", F.lit("clash")).withColumn("fails", F.lit(7)), spark.createDataFrame(labels, LABELS))
    got = filter_audit.audit(counts).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)


def test_audit_of_no_documents(spark):
    counts = filter_audit.failures(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert filter_audit.audit(counts).count() == 0


def test_shapley_weights_are_those_of_the_definition():
    for n in (2, 3, 5):
        w = filter_audit.shapley_weights(n)
        for i in range(n):
            for s in range(1, 1 << n):
                k = s.bit_count()
                inside = math.factorial(k - 1) * math.factorial(n - k)
                outside = math.factorial(k) * math.factorial(n - k - 1) if k < n else 0
                assert w[i][s] == (inside if s >> i & 1 else -outside)
            assert w[i][0] == 0
    assert all(isinstance(x, int) for x in filter_audit.shapley_weights(4)[0]) and Fraction(1)


def test_failures_of_long_texts_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" \t\n".join("abé#Q"[rng.integers(5)] * int(rng.integers(1, 9)) for _ in range(400)).encode() for _ in range(20)] + [b"x" * 500, b" " * 90]
    whole = [filter_audit.text_failures(t) for t in texts]
    monkeypatch.setattr(filter_audit, "SLICE", 7)
    assert whole == [filter_audit.text_failures(t) for t in texts]


# ---- importance resampling


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text, longest=2, buckets=10_000):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, share=25, least=20, seed=7, buckets=10_000):
    s, t = Counter(b for _, x in docs for b in plain_features(x)), Counter(b for x in target for b in plain_features(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        f = plain_features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    n = share * len(able) // 100
    rest = [(*r[:4], None) for r in able[n:]] + [(*r[:4], None) for r in out if r[4] < least]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(able[:n])] + rest, key=str)


def test_crcs_of_runs_from_prefixes(monkeypatch):
    rng = np.random.default_rng(1)
    alphabet = list("abZ9 \n.-é中")
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 300)))) for _ in range(60)] + ["", None, "x" * 5000, "one", ". . ."]
    want = [sorted(plain_features(t, 4)) for t in texts]
    for size, words in ((1 << 20, 200_000), (11, 5), (1, 1), (64, 40)):
        monkeypatch.setattr(importance, "SLICE", size)
        monkeypatch.setattr(importance, "WORDS", words)
        got, n = [[] for _ in texts], np.zeros(len(texts), int)
        for row, bucket, w in importance.ngram_buckets([None if t is None else t.encode() for t in texts], 4):
            n += w
            for r, b in zip(row.tolist(), bucket.tolist()):
                got[r].append(b)
        assert [sorted(x) for x in got] == want
        assert n.tolist() == [len(plain_words(t)) for t in texts]


def test_shift_appends_zero_bytes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 255, 4096, 70_001):
        a, b = rng.bytes(13), rng.bytes(n)
        moved = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_resample_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(int(i), " ".join(rng.choice(vocab, int(rng.integers(0, 60))))) for i in rng.permutation(300)]
    docs += [(None, docs[5][1]), (7, docs[5][1]), (7, docs[5][1]), (1000, None), (1001, ""), (1002, "..."), (1003, "A " * 3000)]
    target = [" ".join(rng.choice(vocab[:20], 30)) for _ in range(30)] + [None, ""]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("_at", F.lit(0)).repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    assert sorted(map(tuple, importance.resample(d, t).collect()), key=str) == plain_resample(docs, target)


def test_resample_of_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b c " * 10) for i in range(8)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs, none).where("rank IS NOT NULL").count() == 2
    assert importance.resample(docs.limit(0), none).count() == 0


@given
def test_importance_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    target = pd.read_parquet(f"{SF}/benchmark.parquet").text
    got = queries.ENTRIES["op12_importance"][0](spark, SF)
    want = plain_resample(list(zip(docs.doc_id.tolist(), docs.text.tolist())), target.tolist())
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == want


# ---- quality


def plain_buckets(tokens, words=2, shapes=3):
    c = quality._Codes()
    w, s = c.of(tokens)
    return sorted(np.concatenate(quality._runs(w, words) + quality._runs(s, shapes)).tolist())


def test_ngrams_of_long_texts_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(4)
    text = " ".join(rng.choice(["ab", "Cd,", "12", "!!", "XY", "e_f", "ab"], 500))
    want = plain_buckets(quality.TOKEN.findall(text))
    for size in (1 << 20, 400, 30, 1):
        monkeypatch.setattr(quality, "SLICE", size)
        assert sorted(np.concatenate(list(quality.buckets(text, quality._Codes()))).tolist()) == want


def test_follow_the_leader_learns_and_keeps_few_weights():
    rng = np.random.default_rng(5)
    bags = [(np.unique(np.r_[rng.integers(10, 4000, 30), 1 + (i % 2)]), None) for i in range(600)]
    bags = [(b, np.ones(len(b))) for b, _ in bags]
    y = np.arange(600) % 2
    m = quality.train(bags, y, np.ones(600))
    z = np.array([m.weights[b].mean() * m.scale + m.bias for b, _ in bags])
    assert ((z > 0) == y).mean() > 0.99 and (m.weights != 0).sum() < 400
    again = quality.train(bags, y, np.ones(600))
    assert (again.weights == m.weights).all() and again.bias == m.bias


@pytest.mark.parametrize("slice_, group, block", [(1 << 20, 1 << 23, 1 << 16), (60, 200, 16), (60, 1, 1)])
def test_texts_scored_together_equal_one_by_one(monkeypatch, slice_, group, block):
    rng = np.random.default_rng(6)
    words = ["ab", "AB", "Cd,", "12", "!!", "(x)", "e_f", "__", "ä1é", "ſΣ.", "²a", "’s", "z.,;", "..y", "语言", "a\u0301b"]
    blanks = [" ", "\n", "  ", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "\u200b", ""]
    some = ["".join(w + b for w, b in zip(rng.choice(words, n), rng.choice(blanks, n))) for n in rng.integers(0, 40, 150)]
    some += [None, "", " \n ", "ab", "ab", "ab ab", " ab", "x", *["".join(rng.permutation(list("aB1 ,_\u00a0")).tolist()) for _ in range(50)]]
    # eighths add up exactly in any order
    m = quality.Model(np.round(rng.normal(size=1 << quality.BITS) * 8).astype(np.float32) / 8, 0.5, 2.0)
    one = [m.score(t) for t in some]
    for name, value in (("SLICE", slice_), ("GROUP", group), ("BLOCK", block)):
        monkeypatch.setattr(quality, name, value)
    assert m.scores(some).tolist() == one and len(m.scores([])) == 0


def test_a_word_of_many_texts_is_taken_apart_once(monkeypatch):
    seen = []

    class Seen:
        def findall(self, *where, pattern=quality.TOKEN):
            seen.append(where[0])
            return pattern.findall(*where)

    monkeypatch.setattr(quality, "TOKEN", Seen())
    m = quality.Model(np.ones(1 << quality.BITS, np.float32), 0.0, 1.0)
    m.scores([f"some words, and more words, {i % 3}." for i in range(500)])
    assert sorted(seen) == [",", "0.", "1.", "2."]


def test_score_of_edge_cases(spark):
    docs = spark.createDataFrame([(i, "plain words of a text that reads well" if i % 2 else "bad### words$$$ of%%% a&&& text***") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0), (500, 1, 0)], LABELS)
    m = quality.fit(docs, labels)
    odd = [(None, "good words"), (1, None), (2, ""), (2, ""), (3, " \n"), (4, "w " * 300_000), (5, "bad### words$$$")]
    got = quality.score_documents(spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("clash")), m).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    base = [r["score"] for r in got if r["doc_id"] in (1, 2, 3)]
    assert len(set(base)) == 1
    assert quality.score_documents(docs.limit(0), m).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert quality.score_documents(docs, none).count() == 60


@given
def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.ENTRIES["op13_quality"][0](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert len(got) == len(pd.read_parquet(f"{sf}/documents.parquet")) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert held.predicted[held.quality == 1].mean() > 0.97
    assert held.predicted[held.quality == 0].mean() < 0.2
