"""SimHash groups, vector groups, components and decontamination against brute force."""

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from crossfactor.llm import decontaminate, simhash, tiles, vector_lsh
from crossfactor.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_groups(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), 4))
    out = [None, "", " \t\n", "one two", "One\x0bTWO", "x" * 50_000, "É é Ä a b"]
    while len(out) < n:
        base = [word() for _ in range(int(rng.integers(30, 300)))]
        out.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            copy = list(base)
            copy[int(rng.integers(len(copy)))] = word()
            out.append("  ".join(copy) if rng.random() < 0.5 else " ".join(copy))
    return out[:n]


def test_fingerprint_is_the_contracts(monkeypatch):
    for t in [*texts(1, 60), "the quick brown fox " * 30]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    monkeypatch.setattr(simhash, "CHUNK", 37)
    for t in texts(2, 40)[7:]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_fingerprint_agrees_with_the_built_in_hash(spark):
    got = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("A b C d") == got % (1 << 64)


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_planes_find_every_pair(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fp = np.concatenate([base ^ np.bitwise_or.reduce(1 << rng.integers(0, 63, (40, k)), axis=1) for k in (1, 2, 4, 8)])
    tile = np.sort(rng.integers(0, 3, len(fp)))
    side = rng.integers(0, 2, len(fp)).astype(bool)
    split = tile == 1
    i, j = simhash.near_pairs(fp, tile, side & split, split, radius)
    want = {
        (a, b) for a in range(len(fp)) for b in range(a + 1, len(fp))
        if tile[a] == tile[b] and (not split[a] or side[a] != side[b]) and int(fp[a] ^ fp[b]).bit_count() <= radius
    }
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


@pytest.mark.parametrize("n", [10, 10**7, 10**9, 10**12, 10**15])
def test_masks_miss_no_pair(n):
    keys = simhash.masks(n, 4)
    rng = np.random.default_rng(0)
    for _ in range(300):
        d = 0
        for b in rng.integers(0, 64, 4):
            d |= 1 << int(b)
        assert any(d & m == 0 for m in keys)


@pytest.mark.parametrize("piece", [4, 1024])
def test_simhash_groups_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    t = texts(3, 120)
    ids = list(np.random.default_rng(1).permutation(len(t)) + 10)
    rows = [(int(i), x, "en", "s", 1) for i, x in zip(ids, t)] + [(None, t[8], None, None, None), (int(ids[9]), t[9], "en", "s", 1), (None, "no such text at all here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit("clash"), "rep": F.lit(1), "node": F.lit(2), "_row": F.lit(3)})
    got = simhash.near_duplicates(docs).toPandas()
    fp = [plain_fingerprint(x) for x in t]
    label = brute_groups(len(t), [(a, b) for a in range(len(t)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    least = {}
    for k, i in enumerate(ids):
        least[label[k]] = min(least.get(label[k], 1 << 60), int(i))
    want = sorted([(int(i), f"{fp[k]:016x}", least[label[k]]) for k, i in enumerate(ids)] + [(int(ids[9]), f"{fp[9]:016x}", least[label[9]])])
    named = got[got.doc_id.notna()]
    assert sorted(zip(named.doc_id.astype(int), named.fingerprint, named.component_id.astype(int))) == want
    null = got[got.doc_id.isna()]
    assert len(null) == 2 and sorted(null.component_id.fillna(-1).astype(int)) == sorted([-1, least[label[8]]])

    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    kept = kept.toPandas()
    assert sorted(kept.doc_id.dropna().astype(int)) == sorted(set(least.values())) and kept.doc_id.isna().sum() == 1


def test_no_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0
    assert vector_lsh.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, items, "doc_id").count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1)], DOCS)
    assert decontaminate.drop_contaminated(docs, items).count() == 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 7), (7001, 7000), (7000, 7001)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {7000: 7000, 7001: 7000}
    assert got == want


def test_tiles_bring_every_pair_together_once(spark):
    rows = spark.range(60).select((F.col("id") % 2).alias("k"), "id")
    tiled = tiles.tile_rows(rows, ["k"], "id", 7).toPandas()
    seen = {}
    for _, g in tiled.groupby(["k", "_a", "_b"]):
        assert len(g) <= 40
        for x in g.itertuples():
            for y in g.itertuples():
                if x.id < y.id and (x._4 if False else True) and (g._a.iloc[0] == g._b.iloc[0] or x[g.columns.get_loc("_own") + 1] != y[g.columns.get_loc("_own") + 1]):
                    seen[x.id, y.id] = seen.get((x.id, y.id), 0) + 1
    assert seen == {(i, j): 1 for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2}


@pytest.mark.parametrize("piece", [8, 512])
def test_vector_links_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(vector_lsh, "PIECE", piece)
    rng = np.random.default_rng(5)
    v = [rng.standard_normal(16) for _ in range(30)]
    v += [v[i % 10] + 0.07 * rng.standard_normal(16) for i in range(60)]
    v += [v[0].copy(), v[0].copy(), 2 * v[0]]
    rows = [(i, x.astype("float32").tolist(), int(i % 3 == 0)) for i, x in enumerate(v)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, v[0].astype("float32").tolist(), None), (204, [], 1), (205, [1.0, None] + [1.0] * 14, 0), (206, [1.0, 2.0], 0), (207, [float("inf")] * 16, 0), (None, v[0].astype("float32").tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "rep": F.lit("x"), "key": F.lit(2), "n": F.lit(0)})
    got = vector_lsh.link_vectors(frame, recall=0.9999).toPandas()
    n = len(v)
    x = np.array([r[1] for r in rows[:n]], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows[:n]])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :]) & ~np.eye(n, dtype=bool)
    label = brute_groups(n, list(zip(*np.nonzero(near))))
    ok = got[got.vec_id.notna()].set_index("vec_id").sort_index()
    assert ok.n_links.loc[: n - 1].tolist() == near.sum(axis=1).tolist()
    assert ok.component_id.loc[: n - 1].astype(int).tolist() == label
    assert (ok.loc[200:].n_links == 0).all() and ok.loc[200:].kept.all() and (ok.loc[200:].component_id == ok.loc[200:].index).all()
    assert len(got) == len(rows)


ITEM = "Mary Jones sold 12 apples for 3 dollars each and then she bought 12 more apples at the market near Paris before noon. How much did Jones spend?"


def test_contamination_exact_partial_and_with_other_values(spark):
    other = ITEM.replace("Mary Jones", "Anna Smith").replace("Jones", "Smith").replace("12", "40").replace("3 dollars", "7 euros").replace("Paris", "Berlin")
    torn = other.replace("bought 40", "bought 41")
    pad = "the sun rose over quiet hills while nothing much happened there at all. " * 3
    rows = [
        (1, pad + ITEM + " " + pad), (2, ITEM.upper()), (3, pad + other), (4, pad), (5, None), (6, ""), (7, pad + ITEM[:110]),
        (8, "apples for 3 dollars each"), (9, pad * 400 + ITEM), (10, torn), (None, ITEM), (1, pad),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumns({"item": F.lit(1), "h": F.lit(2), "_key": F.lit(0), "item_id": F.lit(9)})
    items = spark.createDataFrame([(77, ITEM, 1), (78, None, 1), (79, "too short", 1), (77, ITEM, 1)], "item_id long, text string, h int")
    got = decontaminate.matches(docs, items, "doc_id").toPandas()
    kinds = {(i, k) for i, k in zip(got.doc_id.fillna(-1).astype(int), got.kind)}
    assert {i for i, _ in kinds} >= {1, 2, 3, 7, 9, -1} and {i for i, _ in kinds} <= {1, 2, 3, 7, 9, 10, -1}
    assert (1, "exact") in kinds and (3, "reparameterised") in kinds
    assert set(got.item_id) == {77}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert 4 in ids and 5 in ids and 6 in ids and 8 in ids and ids.count(1) == 1 and not {2, 3, 7, 9} & set(ids)


def test_slot_values_must_agree(spark):
    # the item has one value twice; a document with two different ones there keeps only windows without placeholders
    item = "he paid 5 then later on he paid 5 again"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("5", "8")), (2, "he paid 8 then later on he paid 9 again"), (3, item)], "doc_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in decontaminate.matches(docs, items, "doc_id").collect()}
    assert got == {1: "reparameterised", 3: "exact"}


def test_windows_survive_slices(monkeypatch):
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(["Alpha", "beta", "12", "km", "gamma.", "delta", "Eps!", "zeta\n"], 4000))
    whole = {h for h, _, _ in decontaminate.windows_of(text, decontaminate.Codes())}
    monkeypatch.setattr(decontaminate, "SLICE", 97)
    cut = {h for h, _, _ in decontaminate.windows_of(text, decontaminate.Codes())}
    assert whole <= cut


def test_decontamination_equals_brute_force_on_given_tables(spark):
    """Plain containment of word windows, over all documents and items."""
    sf = "/root/testdata/sf0.001"
    try:
        docs, items = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    except OSError:
        pytest.skip("no test data here")
    import re

    grams = lambda t: [tuple(w[i : i + 5]) for w in [re.findall(r"[^\W\d_]+|\d+", (t or "").lower())] for i in range(len(w) - 4)]
    have = {i: set(grams(t)) for i, t in zip(items.item_id, items.text)}
    want = set()
    for d, t in zip(docs.doc_id, docs.text):
        g = set(grams(t))
        want |= {(int(d), int(i)) for i, h in have.items() if h and len(h & g) >= 0.9 * len(h)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.query(spark, sf).collect()}
    assert want <= got and len(got - want) <= 0.02 * len(docs)
