"""Benchmark passages whose windows also stand elsewhere, or that have few plain words."""

import numpy as np

from crossfactor.llm import decontaminate
from test_queries import QUESTION


def found(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.matches(d, i, "doc_id").collect()}


def test_a_template_with_other_values_before_the_item_hides_nothing(spark):
    early = "A farmer from Sweden had 9 sheep and lost most. "
    other = QUESTION.replace("14", "31").replace("Norway", "Poland").replace("20", "60")
    docs = [early + QUESTION, early + other, early + "Nothing else was said.", early * 20 + other + " " + early + QUESTION]
    assert found(spark, docs, [QUESTION]) == {(0, 0): "exact", (1, 0): "reparameterised", (3, 0): "exact"}


def test_parts_with_different_values_do_not_add_up(spark):
    item = "he paid 5 then later on he paid 5 again"
    assert found(spark, ["he paid 8 then later on he smiled. Yes, later on he paid 9 again", item.replace("5", "6") + " " + item.replace("5", "7")], [item]) == {(1, 0): "reparameterised"}


def test_items_of_names_and_numbers_in_any_case(spark):
    names = "Anna Berg, Carl Dahl, Eva Falk, Georg Holm, Ida Jung"
    sums = "12 + 7 = 19, 3 * 5 = 15, 8 - 2 = 6"
    german = "Der Hund trug gestern einen Korb voller Birnen durch die Stadt zum Markt am alten Hafen"
    pad = "nothing much happened there at all, and the sun rose over quiet hills "
    docs = [pad + names + " " + pad, (pad + names).upper(), pad + sums, pad + german.lower() + " " + pad, german.upper(), pad, names.replace("Anna", "Olga").replace("Falk", "Lind")]
    assert found(spark, docs, [names, sums, german]) == {(0, 0): "exact", (1, 0): "exact", (2, 1): "exact", (3, 2): "exact", (4, 2): "exact"}


def test_items_under_five_words(spark):
    docs = ["they asked: Who wrote Faust? Nobody knew", "WHO WROTE FAUST", "who then wrote faust", "", "12"]
    assert found(spark, docs, ["Who wrote Faust?", "12", "", "?"]) == {(0, 0): "exact", (1, 0): "exact", (4, 1): "exact"}


def test_common_openings_do_not_multiply(spark):
    opening = "which one of the following answers is the best one here "  # eleven words
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items = [opening + " ".join(word() for _ in range(20)) for _ in range(60)]
    docs = [opening + " ".join(word() for _ in range(60)) for _ in range(60)] + [f"{word()} {items[k]} {word()}" for k in (3, 59)]
    d = spark.createDataFrame(list(enumerate(docs)), "_key long, text string")
    known = decontaminate.item_windows(spark.createDataFrame(list(enumerate(items)), "item long, text string"))
    codes = decontaminate.Codes()
    held = [(i, h) for i, t in enumerate(docs) for h, *_ in decontaminate.windows_of(t, codes)]
    seen = spark.createDataFrame(held, "_key long, h long").distinct()
    joined = seen.join(decontaminate.anchors(known, seen), "h").count()
    assert joined < 100 * 2  # where all windows would give more than 60 * 60 * 7
    assert found(spark, docs, items) == {(60, 3): "exact", (61, 59): "exact"}
    assert d.count() == 62


def test_windows_set_aside_reach_nothing():
    rng = np.random.default_rng(1)
    for _ in range(300):
        size = int(rng.integers(5, 60))
        pos = [p for p in range(size - 4) for _ in range(int(rng.integers(1, 3)))]
        cost = rng.integers(0, 50, len(pos)).tolist()
        keep = decontaminate.telling_windows(pos, cost, size)
        aside = {p for p, k in zip(pos, keep) if not k}
        assert not aside & {p for p, k in zip(pos, keep) if k}
        covered, run = decontaminate._extent(aside, size) if aside else (0, 0)
        assert covered < decontaminate.COVER and run < min(decontaminate.RUN, size)
        # and no further one could be set aside
        for p in {p for p, k in zip(pos, keep) if k}:
            c, r = decontaminate._extent(aside | {p}, size)
            assert c >= decontaminate.COVER or r >= min(decontaminate.RUN, size)


def test_least_item_length_is_a_parameter(spark):
    d = spark.createDataFrame([(1, "yes of course"), (2, "the answer was forty two")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "yes"), (2, "answer was forty")], "item_id long, text string")
    assert decontaminate.drop_contaminated(d, i).count() == 1
    assert decontaminate.drop_contaminated(d, i, least_words=1).count() == 0
