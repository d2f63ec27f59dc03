"""Language, main text, URL lists, toxicity, mixing, shards and token counts on small cases."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossfactor.llm import html_text, language, mixing, sharding, token_prefix, toxicity, url_lists
from crossfactor.llm.tables import class_sample, fold, positions

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def speak(rng, kind, n):
    parts = {"en": "the and ing th er on re".split(), "de": "der sch ung ei und ich".split(), "fr": "eau oui le que é eux".split()}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


# --- shared pieces


def test_fold_and_sample(spark):
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"))
    for r in d.select("doc_id", fold(parts=5).alias("f")).limit(50).collect():
        assert r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5
    got = {r["lang"]: r["count"] for r in class_sample(d, "lang", "doc_id", 150).groupBy("lang").count().collect()}
    assert 100 < got["a"] < 200 and 110 < got["b"] < 190
    assert class_sample(d.limit(0), "lang", "doc_id", 5).count() == 0


def test_positions_are_gapless_for_hot_null_and_equal_keys(spark):
    d = spark.range(500).select(F.when(F.col("id") < 300, None).otherwise(F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("x"))
    got = positions(d, [F.col("x")], ["g"], "at").toPandas()
    for _, g in got.groupby("g", dropna=False):
        g = g.sort_values("at")
        assert g["at"].tolist() == list(range(len(g))) and g["x"].is_monotonic_increasing
    assert len(got) == 500


# --- language


def test_language_is_learned_and_rejected(spark):
    rng = random.Random(1)
    rows = [(i, speak(rng, k, rng.randint(3, 60)), k, "s", 1) for i in range(900) for k in [("en", "de", "fr")[i % 3]]]
    rows += [(2000, None, "en", None, None), (2001, "", None, None, 0), (2002, "123 !? 45", "de", None, 9), (None, rows[0][1], "en", "s", 1), (5, rows[5][1], "fr", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("clash"), "lang_pred": F.lit(1)})
    model = language.fit(docs.where(fold(parts=5) != 0), epochs=4)
    got = language.predict(docs, model).toPandas()
    truth = {r[0]: r[2] for r in rows[:900]}
    held = [r for r in got.itertuples() if r.doc_id in truth and zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert got.score.between(0, 1).all() and len(got) == len(rows)
    odd = got[got.doc_id.isin([2000, 2001, 2002])]
    assert (odd.lang_pred == "und").all() and (odd.score == 0).all()
    assert model.temperature > 0 and 0 <= model.threshold <= 1
    again = language.fit(docs.where(fold(parts=5) != 0), epochs=4)
    assert np.array_equal(again.table, model.table)


def test_seventy_languages_are_all_learned(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(70):
        letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyzäöüéñ"))[:7]
        rows += [(100 * k + i, " ".join("".join(rng.choice(letters, 5)) for _ in range(40)), f"l{k}") for i in range(8)]
    docs = spark.createDataFrame(rows + [(9999, "no language", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.labels) == 70
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert np.mean([got[i] == x for i, _, x in rows]) > 0.95


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 3)], DOCS)
    assert [tuple(r) for r in language.predict(docs, language.fit(docs)).collect()] == [(1, "und", 0.0, True)]
    assert language.predict(docs.limit(0), language.fit(docs.limit(0))).count() == 0


def test_subwords_stay_within_words():
    assert len(language.subwords("123 ..")) == 0
    assert np.array_equal(np.sort(language.subwords("ab1cd")), np.sort(language.subwords("AB  cd!")))
    assert len(language.subwords("a")) == 3  # the two ends and the whole
    model = language.Model(["x", "y"], np.random.default_rng(0).random((1 << language.BITS, 2)).astype("float32"), np.zeros(2))
    long = "some words here " * 20_000
    by_rows = model.table[language.subwords(long)].mean(axis=0, dtype=np.float64)
    assert np.allclose(model.logits(long), by_rows, atol=1e-4)


# --- main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">One</a></li></ul></nav><!-- ad > 0 --><div class="ad">Buy this now, it is cheap today.</div>
<article><h1>Caf&eacute; &amp; bar</h1><p><b>First  line
here<br><p>Second &lt;tag&gt; &#x41;&#66;</p><p>Short.</p><ul><li>An item</li><li>Another</li></ul>
<aside>Beside</aside><div class="share-buttons">Share me</div><form><input value="x">Send</form></article>
<section id="comments"><article class="comment"><p>I liked this a lot and want to say so at length.</p></article></section>
<footer>&copy; site</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Café & bar\nFirst line here\nSecond <tag> AB\nShort.\nAn item\nAnother"


def test_main_text_without_semantic_tags():
    long = "This is a paragraph of running text that goes on for quite a while, as articles do, and tells about the world at large. " * 2
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div><div><h1>Title words</h1><p>{long}</p><p>{long}</p></div><div><a href=4>Terms</a> <a href=5>Privacy</a></div></body>"
    assert html_text.main_text(page) == f"Title words\n{long.strip()}\n{long.strip()}"


def test_blocks_of_broken_and_odd_markup():
    assert html_text.blocks(None) == [] and html_text.blocks("") == [] and html_text.blocks("<!-- open") == []
    assert [b.text for b in html_text.blocks("a < b <p title='x>y'>c</p")] == ["a < b", "c </p"] or [b.text for b in html_text.blocks("a < b <p title='x>y'>c</p")][:1] == ["a < b"]
    assert html_text.main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 3) == "deep"
    assert html_text.main_text("<script>never closed <article><p>x</p></article>") == ""


def test_scripts_that_hold_signs_do_not_end_a_page():
    for inner in ("for(i=0;i<n;i++){x()}", "if(a<b&&c>d){document.write('<p>')}", "x='</scripts>'<y"):
        page = f"<article><h1>T</h1><p>before</p><script>{inner}</script><p>after</p><SCRIPT src=x></SCRIPT ><p>end</p></article><footer>f</footer>"
        assert html_text.main_text(page) == "T\nbefore\nafter\nend"
    assert html_text.main_text("<article><p>a</p><style>p<b{}</style><p>b</p></article>") == "a\nb"


def test_formulae_hidden_blocks_and_fallbacks_stay():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p><p hidden>kept</p><p style='display:none'>too</p><video>Fallback.</video></article>"
    assert html_text.main_text(page) == "Let x=2 hold\nkept\ntoo\nFallback."


def test_class_names_count_as_whole_names():
    long = "a long text of many words that nobody would take for a menu, as it goes on and on for a while"
    for name in ("related-work", "discussion", "notice-of-meeting", "share_price"):
        assert html_text.main_text(f"<article class='{name}'><p>{long}</p></article>") == long
        assert html_text.main_text(f"<div class='{name}'><p>{long}</p></div>") == long
    for name in ("related-posts", "cookie-notice", "site-sidebar", "comments-list", "ad ad-300"):
        assert html_text.main_text(f"<article><p>{long}</p><div class='{name}'><p>{long}</p></div></article>") == long


def test_long_paragraph_before_a_menu_stays_and_its_short_title_goes():
    menu = "<ul><li><a href='/a'>Home page</a></li><li><a href='/b'>Other news</a></li></ul>"
    long = "one more text about the river and the boats that came back late in the year with all of their goods"
    tree = html_text.fitted()
    used = set()
    stack = [tree]
    while stack:
        n = stack.pop()
        if n.figure >= 0:
            used.add(html_text.FIGURES[n.figure])
            stack += [n.low, n.high]
    assert {"words", "words_before", "words_after"} & used
    assert html_text.main_text(f"<div>{menu}</div><div><p>{long}</p><p>{long}</p></div><div>More</div><div>{menu}</div>") == f"{long}\n{long}"


def test_tree_fits_its_table():
    x, y = html_text.labelled()
    assert (html_text.fitted().predict(x) == (y == 1)).all()
    assert x.shape[1] == len(html_text.FIGURES)


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).toPandas()
    assert len(got) == 4 and got.text.tolist()[1:3] == ["", ""] and got.n_chars.tolist() == [len(got.text[0]), 0, 0, len(got.text[0])]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- URL lists


def test_entries_hold_from_their_day_until_the_next(spark):
    e = [("b.com", "block", 10, "add"), ("b.com", "block", 20, "remove"), ("b.com", "block", 20, "remove"), ("b.com", "block", 30, "add"), ("x.com", "block", 5, "add"), ("x.com", "block", 5, "remove"), (None, "block", 1, "add"), ("a.b.com", "allow", 12, "add"), ("b.com/p/q", "block", 0, "add")]
    c = [
        (1, "http://b.com/", 9), (2, "https://U:p@B.com.:80/z", 10), (3, "http://b.com", 19), (4, "http://b.com", 20), (5, "http://b.com", 99), (6, "http://x.com", 5),
        (7, "http://a.b.com/k", 13), (8, "http://notb.com", 50), (9, None, 50), (10, "no host", 50), (11, "http://b.com//p/q/r?x#y", 25), (12, "http://b.com/p", 25), (13, "http://b.com", None), (1, "http://b.com/", 9),
    ]
    entries = spark.createDataFrame(e, "pattern string, action string, day int, verb string").withColumn("start", F.lit("clash"))
    captures = spark.createDataFrame(c, "page_id long, url string, fetched int").withColumns({"pattern": F.lit(1), "_row": F.lit(2), "blocked": F.lit("x")})
    got = url_lists.evaluate(captures, entries).collect()
    blocked = sorted(r["page_id"] for r in got if r["blocked"])
    assert blocked == [2, 3, 5, 11] and len(got) == len(c)
    seven = next(r for r in got if r["page_id"] == 7)
    assert (seven["n_active"], seven["pattern"], seven["action"]) == (2, "a.b.com", "allow")
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0
    assert url_lists.evaluate(captures, entries.limit(0)).where("blocked").count() == 0


# --- toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    score, move = rng.standard_normal(6), rng.standard_normal((2, 2))
    for n in (1, 2, 5):
        at = np.array([[*range(n), *[-1] * (6 - n)]])
        p, _, _ = toxicity.marginals(score, at, move)
        total, hot = 0.0, np.zeros(n)
        for y in np.ndindex(*[2] * n):
            w = np.exp(sum(score[i] for i in range(n) if y[i]) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            hot += w * np.array(y)
        assert np.allclose(p[0, :n], hot / total) and (p[0, n:] == 0).all()


def test_segments_and_chains_cover_every_word():
    mark = np.random.default_rng(1).random(3000) < 0.03
    chain, place = toxicity.segments(mark)
    seen = np.concatenate([a[a >= 0] for a in toxicity.chains(chain, place)])
    assert np.array_equal(np.sort(seen), np.arange((~mark).sum())) and place.max() < toxicity.LONGEST


def test_toxic_documents_are_found(spark):
    rng = random.Random(2)
    bad = ["idiot", "scumbag", "scumlord", "moron"]
    rows, labels = [], []
    for i in range(800):
        words = speak(rng, "en", rng.randint(10, 80)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    labels += [(900, 1, 1), (None, 1, 1), (3, 1, None), (0, 1, 1)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "you idiot", "en", "s", 1), (1002, "fine words here. " * 90_000 + "moron idiot scumbag", "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("clash"), "spans": F.lit(1), "toxic": F.lit(7), "_toxic": F.lit(0)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab.where(fold(parts=4) != 2))
    got = toxicity.score_documents(docs, model).toPandas()
    assert got.score.between(0, 1).all() and len(got) == len(rows)
    held = [r for r in got.itertuples() if r.doc_id < 800 and zlib.crc32(str(int(r.doc_id)).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held]) > 0.97
    text = {r[0]: r[1] for r in rows}
    spans = [text[r.doc_id][s["start"] : s["end"]] for r in held for s in r.spans]
    assert len(spans) > 20 and np.mean([s.lower() in bad for s in spans]) > 0.95
    by = {r.doc_id: r.score for r in got.itertuples()}
    assert by[1000] < 0.3 and by[1001] == by[1000] and by[1002] > 0.3
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {1000, 1001, 1} <= ids and 1002 not in ids and None not in ids
    assert toxicity.drop_toxic(docs, lab.limit(0)).count() == len(rows)
    assert toxicity.drop_toxic(docs.limit(0), lab).count() == 0


# --- mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        t = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: most * sizes[s] if s in capped else t[s] for s in names}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_its_targets(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "B", "é", "\U0001f600", "", None, "zz"]
    share = rng.dirichlet(np.full(len(names), 0.4))
    rows = [(int(i), str(i), "x", names[int(rng.choice(len(names), p=share))], int(rng.geometric(0.02))) for i in range(600)]
    rows += [(1, "1", "x", "empty", 0), (None, "n", "x", None, 5), (7, "7", "x", "a", 9), (7, "7", "x", "a", 9)]
    d = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "size").withColumns({"target": F.lit("x")}).drop("target")
    got = mixing.mix(d, seed=seed).toPandas()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + r[4]
    want = brute_targets(sizes)
    assert len(got) == len(rows) and got.copies.between(0, 3).all()
    for s, g in got.groupby(got.source.fillna("~null"), dropna=False):
        s = None if s == "~null" else s
        assert np.isclose(g.target.iloc[0], want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs((g.copies * g["size"]).sum() - want[s]) <= g["size"].max() + 1e-6
    assert got.sort_values(["doc_id", "size"]).copies.tolist() == mixing.mix(d, seed=seed).toPandas().sort_values(["doc_id", "size"]).copies.tolist()


def test_mixed_rows(spark):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 3}", i) for i in range(90)] + [(None, None, None, None, None), (3, "w", "en", "s0", 3), (3, "w", "en", "s0", 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"copies": F.lit(1), "_copies": F.lit(2), "size": F.lit(3)}).drop("_copies")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    plan = mixing.mix(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "b", 0)], DOCS)
    assert mixing.mix_documents(blank).count() == 0


# --- shards


def brute_capacity(sizes, shards):
    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= shards

    return next(c for c in range(sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_minimax(seed):
    rng = np.random.default_rng(seed)
    sizes = np.where(rng.random(60) < 0.3, 0, rng.geometric(0.05, 60))
    if seed == 5:
        sizes[30] = 900
    starts, capacity = sharding.minimax_cuts(sizes, 7)
    assert capacity == brute_capacity(sizes.tolist(), 7) and starts[0] == 0 and len(starts) == 7
    assert starts == sorted(starts)
    assert max(sizes[a:b].sum() for a, b in zip(starts, [*starts[1:], 60])) <= capacity
    assert sharding.minimax_cuts(np.zeros(5, int), 3)[1] == 0


def test_shards_of_documents(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["same", "other é", None, "", speak(rng, "en", rng.randint(1, 40))]), "en", "s", i) for i in range(700)] + [(5, "same", "en", "s", 1), (None, "same", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit("clash"), "size": F.lit(1)})
    got = sharding.shard_documents(docs, 8).toPandas()
    assert len(got) == len(rows) and set(docs.columns) <= set(got.columns)
    assert got.shard.between(0, 7).all() and (got.law == "bytes").all() and got.grown_shard.isna().all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for t, g in got.groupby(got.text.fillna("~")):
        assert g.shard.nunique() == 1
        text = g.text.iloc[0]
        raw = (text or "").encode()
        assert (g["size"] == len(raw) + 16).all() and (text is None or (g.text_crc32 == zlib.crc32(raw)).all())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_shards_are_near_equal_on_given_tables(spark):
    try:
        got = sharding.query(spark, "/root/testdata/sf0.01").toPandas()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            pytest.skip("no test data here")
        raise
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 40 and by.max() <= by.mean() + got["size"].max() and by.min() >= by.mean() - got["size"].max()


# --- tokens


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json")), token_prefix.counter("byte_bpe_50k.json")


POOL = ["a", "b", " ", "  ", "\n", "\n\n", "'re", "'s", "'", "the", " Hello", "12", "3", "é", "日本", "!", "...", "<|endoftext|>", "<|end", "\t", "ß", "xxxxx", "\x1c", "\xa0", "👍", "'ll", "don't", "²", "½", "_", "a_b", "ǅ", "　", "Ⅷ", "\x85"]


def test_counts_at_every_prefix_are_the_librarys(library):
    tok, c = library
    n = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
    rng = random.Random(9)
    for _ in range(250):
        s = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 14)))
        assert c.at_prefixes(s).tolist() == [n(s[:i]) for i in range(len(s) + 1)], s
        assert c.count(s) == n(s), s


def test_budgets(library):
    tok, c = library
    text = "Some longer thandore words, and 12 numbers 3456!\n\nNext <|endoftext|> paragraph don't " * 5
    counts = c.at_prefixes(text)
    for limit in (0, 1, 7, 30, 60):
        k = c.longest_prefix(text, limit)
        assert counts[k] <= limit and (k == len(text) or counts[k + 1 : k + 12].max() > limit)


def test_long_texts_in_slices(library, monkeypatch):
    tok, c = library
    rng = random.Random(4)
    text = "".join(rng.choice(POOL) for _ in range(4000)) + "z" * 3000 + " " * 700 + "end"
    monkeypatch.setattr(token_prefix, "SLICE", 50)
    assert c.count(text) == len(tok.encode(text, add_special_tokens=False).ids)


def test_token_rows(spark, library):
    tok, _ = library
    rows = [(1, "the cat é", "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "word " * 3000, "en", "s", 1), (1, "the cat é", "en", "s", 9)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n_tokens": F.lit("clash"), "m": F.lit(1)})
    got = token_prefix.token_counts(docs).toPandas()
    want = [len(tok.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert got.n_tokens.tolist() == want and got.n_bytes.tolist() == [len((r[1] or "").encode()) for r in rows]
    assert got.over_limit.tolist() == [x > 1024 for x in want] and got.keep_chars[0] == 9 and got.keep_chars[3] < 15_000
    assert token_prefix.token_counts(docs.limit(0)).count() == 0
