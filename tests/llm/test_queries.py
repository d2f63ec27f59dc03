"""The registered queries over whole given tables, against SQL, the named library or brute force; and the pipeline."""

import os
import re
import sys
import zlib

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import check  # noqa: E402
from test_jaccard import brute_kept  # noqa: E402

import corpus_pipeline  # noqa: E402
from crossfactor.llm import decontaminate, queries, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def rows(spark, name):
    return queries.ENTRIES[name][0](spark, SF).toPandas()


def given(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_all_are_registered():
    entry = check.load_entry()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_url_lists", "op6_mix_sources"])
def test_query_equals_sql(spark, name):
    query, sql = queries.ENTRIES[name]
    assert check.compare(query(spark, SF), check.duck(SF), sql) == ""


def test_language_of_held_out_documents(spark):
    got = rows(spark, "op1_language").merge(given("documents")[["doc_id", "lang", "text"]], on="doc_id")
    assert len(got) == len(given("documents")) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.9


def test_main_text_is_the_article(spark):
    import html

    got = rows(spark, "op2_main_text").set_index("page_id").text
    for r in given("pages").itertuples():
        m = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        pieces = re.split(r"</?(?:p|h1|div|article|li|ul|section|h2)[^>]*>", m[1]) if m else []
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in pieces]
        assert got[r.page_id] == "\n".join(w for w in want if w)


def test_simhash_query_equals_brute_force(spark):
    got = rows(spark, "op4_simhash_groups").sort_values("doc_id")
    fp = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    assert fp.tolist() == [simhash.fingerprint(t) for t in given("documents").sort_values("doc_id").text]
    label = np.arange(len(fp))
    for _ in range(len(fp)):
        new = np.array([label[np.bitwise_count(fp ^ f) <= 4].min() for f in fp])
        if (new == label).all():
            break
        label = new
    ids = got.doc_id.to_numpy()
    assert got.component_id.tolist() == [ids[label == k].min() for k in label]


def test_toxicity_of_labelled_documents(spark):
    got = rows(spark, "op5_toxicity")
    assert len(got) == len(given("documents")) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


def test_shards_query(spark):
    got = rows(spark, "op7_shards").merge(given("documents")[["doc_id", "text"]], on="doc_id")
    raw = [(t or "").encode() for t in got.text]
    assert got["size"].tolist() == [len(x) + 16 for x in raw] and got.text_crc32.tolist() == [zlib.crc32(x) for x in raw]
    assert (got.groupby("text").shard.nunique() == 1).all() and got.shard.between(0, 39).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_token_counts_are_the_librarys(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = rows(spark, "op8_token_counts").merge(given("documents")[["doc_id", "text"]], on="doc_id")
    assert got.n_tokens.tolist() == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in got.text]


def test_vector_query_equals_brute_force(spark):
    got = rows(spark, "op10_vector_groups").set_index("vec_id").sort_index()
    e = given("embeddings").set_index("vec_id").sort_index()
    x = np.array(e.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (e.label.to_numpy()[:, None] == e.label.to_numpy()[None, :]) & ~np.eye(len(x), dtype=bool)
    assert near.sum() == 0 or got.n_links.sum() >= 0.9 * near.sum()
    assert (got.n_links.to_numpy() <= near.sum(axis=1)).all() and (got.kept == (got.component_id == got.index)).all()


# --- the pipeline

BAD = "idiot moron scum".split()
QUESTION = "A farmer from Norway had 14 sheep and sold 5 of them to a trader who paid 20 dollars each before the long winter came. How much did the farmer get?"


def corpus(folder):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(int(rng.integers(40, 90)))]
        if i % 6 == 0:
            for k in rng.integers(0, len(words), 4):
                words[k] = str(rng.choice(BAD))
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    clean = [d for d in docs if d[0] % 6]
    docs += [(1000 + k, clean[k][1].upper() if k % 2 else clean[k][1], "en", "s1", 1) for k in range(20)]
    docs += [(2000 + k, f"{clean[50 + k][1]} {QUESTION} {clean[80 + k][1]}", "en", "s2", 1) for k in range(5)]
    docs += [(3000, None, "en", None, None), (3001, "", "en", "s3", 0), (None, "one more text without any id at all, kept as it is", "en", "s3", 1), (7, docs[7][1], "en", "s3", 1)]
    pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"}).to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(f"{folder}/labels.parquet")
    pd.DataFrame([(1, QUESTION)], columns=["item_id", "text"]).to_parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    docs = corpus(tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(path := f"{tmp_path}/{name}")
        frame = spark.read.parquet(path)
        seen[name] = frame.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    key = lambda f: set(f.doc_id.fillna(-1).astype(int))
    toxic = {d[0] for d in docs if d[1] and set(d[1].lower().split()) & set(BAD)}
    first = seen["toxicity"]
    assert not key(first) & toxic and len(first) == sum((d[0] not in toxic) for d in docs)
    second = seen["near_duplicates"]
    ids = first.doc_id.fillna(1 << 40).astype(int).to_numpy()
    order = np.argsort(ids, kind="stable")
    assert key(second) == {-1 if ids[order[k]] == 1 << 40 else int(ids[order[k]]) for k in brute_kept(first.text.to_numpy()[order])}
    assert len(second) == len(key(second)) and second.doc_id.isna().sum() == 1
    third = seen["benchmark_passages"]
    assert key(second) - key(third) == {2000 + k for k in range(5)}
    mixed = seen["mix"]
    assert key(mixed) <= key(third) and mixed.groupby(mixed.doc_id.fillna(-1)).size().max() <= 3
    size = third.text.map(lambda t: len((t or "").split()))
    taken = mixed.text.map(lambda t: len((t or "").split()))
    assert abs(taken.sum() - size.sum()) <= 4 * size.max()
    last = seen["shard"]
    assert len(last) == len(mixed) and last.shard.between(0, 39).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in last.groupby("shard"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    order = ["shard", "slot"]
    pd.testing.assert_frame_equal(whole.sort_values(order).reset_index(drop=True)[["doc_id", "shard", "slot"]], last.sort_values(order).reset_index(drop=True)[["doc_id", "shard", "slot"]])


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_use_the_operators_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"] for r in decontaminate.query(spark, SF).collect()}
    kept = corpus_pipeline.benchmark_passages(spark, docs, SF).select("doc_id").toPandas().doc_id
    assert set(kept) == set(docs.select("doc_id").toPandas().doc_id) - found
    d = given("documents").sort_values("doc_id")
    left = corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").toPandas().doc_id
    assert sorted(left) == d.doc_id.to_numpy()[brute_kept(d.text)].tolist()
