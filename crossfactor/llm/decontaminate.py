"""Benchmark passages in documents, also with other numbers, names and units: template windows joined by hash."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.tables import join_small, numbered, table
from crossfactor.session import cut

#: A word, a number, a sign that stands for a unit, or a mark that ends a sentence.
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:]\d+)*|[%$€£°]|[.!?\n]")
#: Words that count as a unit right after a number, and words that count as a number.
UNITS = frozenset(
    "% $ € £ ° mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent "
    "degree degrees meter meters metre metres kilometer kilometers gram grams kilogram kilograms mph kmh watt watts volt volts joule joules".split()
)
NUMBERS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty "
    "sixty seventy eighty ninety hundred thousand million billion".split()
)
PLAIN, TITLE, NUMBER, UNIT, MARK = range(5)
#: Words of a window, how many of them must be no placeholder, share of an item and run of words from which it is found.
WINDOW, LEAST_PLAIN, COVER, RUN = 5, 3, 0.8, 13
#: The query and the pipeline do not look for items of fewer words: a word or two stand in too many texts.
LEAST_WORDS = 3
#: Bits of the filter that spares documents' windows the join, characters read at once, entries of a worker's cache.
FILTER_BITS, SLICE, CACHE = 24, 1 << 20, 1_000_000
#: Keeps hashes of windows as they stand apart from those of templates.
EXACT = np.uint64(0xD6E8FEB86659FD93)


def _code(token: str) -> int:
    """60 bits of the lower-cased token and its kind."""
    low = token.lower()
    if token in ".!?\n":
        kind = MARK
    elif token[0].isdigit() or low in NUMBERS:
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif token[0].isupper() and (len(token) == 1 or token[1:].islower()):
        kind = TITLE
    else:
        kind = PLAIN
    return xxhash.xxh64_intdigest(low.encode()) >> 4 << 3 | kind


class Codes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        c = self[token] = _code(token)
        return c


def templates(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical tokens, whether each is a placeholder, and the values they hide, without marks.

    A number is a placeholder; a unit after a number; and a capitalised word that does not open a sentence, as a name.
    Each type of placeholder is one canonical token.
    """
    kind = codes & np.uint64(7)
    opens = np.ones(len(codes), bool)
    opens[1:] = kind[:-1] == MARK
    after_number = np.zeros(len(codes), bool)
    after_number[1:] = kind[:-1] == NUMBER
    slot = (kind == NUMBER) | ((kind == TITLE) & ~opens) | ((kind == UNIT) & after_number)
    value = codes >> np.uint64(3)
    token = np.where(slot, kind, value)
    inner = kind != MARK
    return token[inner], slot[inner], codes[inner]


def _hashes(token: np.ndarray, length: int) -> np.ndarray:
    n = max(0, len(token) - length + 1)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + token[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def window_hashes(token: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the template at every place, and whether it hides a value and has enough plain words to tell anything."""
    h = _hashes(token, WINDOW)
    if not len(h):
        return h, np.zeros(0, bool)
    plain = np.r_[0, np.cumsum(~slot)]
    plain = plain[WINDOW:] - plain[:-WINDOW]
    return h, (plain >= LEAST_PLAIN) & (plain < WINDOW)


def _slots(slot: np.ndarray, value: np.ndarray, at: int) -> list[int]:
    own = slice(at, at + WINDOW)
    return value[own][slot[own]].view(np.int64).tolist()


def windows_of(text: str, codes: Codes, bits: np.ndarray | None = None, short: tuple[int, ...] = ()):
    """``(hash, place, slots)`` of a text's windows that pass the filter; those where slices meet may come twice.

    Every window as it stands, lower-cased (no slots, whatever its words are), those of the lengths ``short`` as well,
    and every telling template.
    """
    at, carry, done = 0, np.zeros(0, np.uint64), 0

    def passed(h: np.ndarray) -> np.ndarray:
        if bits is None:
            return np.ones(len(h), bool)
        word = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
        return (word >> (h >> np.uint64(58)) & np.uint64(1)).astype(bool)

    while at < len(text):
        stop = min(len(text), at + SLICE)
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        found = TOKEN.findall(text, at, stop)
        at = stop
        c = np.concatenate([carry, np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))])
        token, slot, value = templates(c)
        h, telling = window_hashes(token, slot)
        for i in np.flatnonzero(telling & passed(h)).tolist():
            yield int(h[i].view(np.int64)), done + i, _slots(slot, value, i)
        for length in (*short, WINDOW):
            h = _hashes(value >> np.uint64(3), length) ^ EXACT
            for i in np.flatnonzero(passed(h)).tolist():
                yield int(h[i].view(np.int64)), done + i, []
        # the next slice begins with the last tokens of this one (a mark before them tells how a sentence opens)
        keep = c[-4 * WINDOW :]
        carry = keep if at < len(text) else carry
        done += len(token) - int((keep & np.uint64(7) != MARK).sum())


def item_windows(items: DataFrame) -> DataFrame:
    """``(h, item, pos, slots, size)`` of all windows of the items, whose row numbers are ``item``.

    An item of fewer words than a window is one window of its own length.
    """

    @F.pandas_udf("size int, w array<struct<h:long,pos:int,slots:array<long>>>")
    def split(texts: pd.Series) -> pd.DataFrame:
        codes, rows = Codes(), []
        for t in texts:
            t = t or ""
            size = sum(1 for x in TOKEN.finditer(t) if x.group() not in ".!?\n")
            got = {(pos, bool(slots)): (h, pos, slots) for h, pos, slots in windows_of(t, codes, None, (size,) if 0 < size < WINDOW else ())}
            rows.append((size, [got[k] for k in sorted(got)]))
        return pd.DataFrame(rows, columns=["size", "w"])

    out = items.select("item", split("text").alias("s")).select("item", "s.size", F.explode("s.w").alias("w"))
    return out.select("w.h", "item", F.col("w.pos").alias("pos"), F.col("w.slots").alias("slots"), "size")


def hash_filter(windows: DataFrame) -> np.ndarray:
    """One bit for each hash, as 64-bit words: bounded whatever the number of windows; it only ever lets too much pass."""
    n = 1 << (FILTER_BITS - 6)
    word = F.col("h").bitwiseAND(F.lit(n - 1))
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(h, 58) AS INT))")
    rows = windows.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect()
    bits = np.zeros(n, np.int64)
    for r in rows:
        bits[r["w"]] = r["b"]
    return bits.view(np.uint64)


def telling_windows(pos: list[int], cost: list[int], size: int) -> np.ndarray:
    """Which windows of an item must be looked up so that no match can be missed: all but those met most often.

    Windows are set aside from the most common on, as long as those set aside together reach neither ``COVER`` of the
    item's words nor a run of ``RUN``. A document that reaches either shares a window that is not set aside. Windows at
    one place stand or fall together.
    """
    places = np.unique(pos)
    total = np.zeros(int(places.max()) + 1, np.int64)
    np.maximum.at(total, pos, cost)
    aside = np.zeros(len(total) + 2 * WINDOW, bool)  # shifted by WINDOW, so that neighbours always exist
    first, last = np.arange(len(aside)), np.arange(len(aside))  # of each run, kept at its two ends
    covered = np.zeros(len(total) + WINDOW, bool)
    words = 0
    need = min(RUN, size)
    for p in sorted(places.tolist(), key=lambda p: (-total[p], p)):
        at = p + WINDOW
        lo = first[at - 1] if aside[at - 1] else at
        hi = last[at + 1] if aside[at + 1] else at
        more = int((~covered[p : p + WINDOW]).sum())
        if (words + more) / size >= COVER or hi - lo + WINDOW >= need:
            continue
        aside[at], first[hi], last[lo] = True, lo, hi
        covered[p : p + WINDOW] = True
        words += more
    return ~aside[np.asarray(pos, np.int64) + WINDOW]


def anchors(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``(h, item)`` of the windows of ``known`` that find the items, given how often ``seen`` and the items hold each."""
    often = seen.groupBy("h").agg(F.count(F.lit(1)).alias("d"))
    cost = cut(known.groupBy("h").agg(F.count(F.lit(1)).alias("i")).join(often, "h").select("h", (F.col("i") * F.col("d")).alias("cost")))
    # a window that no document holds costs nothing and finds nothing
    held = join_small(known.select("h", "item", "pos", "size"), cost, "h", "left")
    items = held.groupBy("item").agg(F.first("size").alias("size"), F.collect_list(F.struct("h", "pos", F.coalesce("cost", F.lit(0)).alias("cost"))).alias("w"))

    @F.pandas_udf("array<long>")
    def kept(windows: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for w, n in zip(windows, sizes):
            keep = telling_windows([x["pos"] for x in w], [x["cost"] for x in w], n)
            out.append(sorted({x["h"] for x, k in zip(w, keep) if k and x["cost"]}))
        return pd.Series(out)

    return items.select("item", F.explode(kept("w", "size")).alias("h"))


def _reach(places: str):
    """Of sorted window places: words covered and longest run of words, as a struct."""
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("covered"))

    def step(acc, p):
        run = F.when(p == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(WINDOW))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"), (acc["covered"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("covered"))

    return F.aggregate(F.array_sort(places), zero, step)


def _extent(places: set[int], size: int) -> tuple[float, int]:
    """What ``_reach`` tells of window places: share of the item's words, longest run of words."""
    last, run, best, covered = -WINDOW, 0, 0, 0
    for p in sorted(places):
        run = run + 1 if p == last + 1 else WINDOW
        best, covered, last = max(best, run), covered + min(WINDOW, p - last), p
    return min(covered, size) / size, min(best, size)


def _mapping(windows, known: dict[int, int]) -> dict[int, int] | None:
    """The item's values and those that stand for them in the document, none if one has two."""
    out = dict(known)
    for w in windows:
        for mine, theirs in zip(w["slots"], w["theirs"]):
            if out.setdefault(mine, theirs) != theirs:
                return None
    return out


def judge(windows, size: int) -> tuple[float, int, bool]:
    """``(covered, run, exact)`` of an item in a document, from all windows they share, at their best.

    A window with the item's own values always counts. Others count by alignment (document place minus item place): those
    of one alignment if their values agree, and those of further alignments whose values agree with the larger ones.
    """
    equal, by = set(), {}
    for w in windows:
        if list(w["slots"]) == list(w["theirs"]):
            equal.add(w["pos"])
        for place in w["places"] if len(w["slots"]) else ():
            by.setdefault(place - w["pos"], []).append(w)
    sets, merged, known = [equal], set(equal), {}
    for own in sorted(by.values(), key=len, reverse=True):
        if _mapping(own, {}) is None:
            continue
        places = {w["pos"] for w in own}
        if not places <= equal:
            sets.append(equal | places)
        if (wider := _mapping(own, known)) is not None:
            merged, known = merged | places, wider
    sets.append(merged)
    found = lambda e: e[0] >= COVER or e[1] >= RUN
    best = max(sets, key=lambda x: (found(e := _extent(x, size)), *e))
    return *_extent(best, size), best <= equal


def matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str = "text", least_words: int = 1) -> DataFrame:
    """``(key, item_id, covered, run, kind)``: which benchmark items stand in which rows of ``docs``.

    Windows of five words are joined by hash: all of them lower-cased as they stand, and those with at least three plain
    words also as templates (numbers, names, and units after numbers as typed placeholders). An item is
    found in a document when the windows they share cover 0.8 of its words or a run of 13 of them. Windows with the item's
    own values always count. Where values differ they must agree by alignment: wherever an item has the same value, the
    document must have one and the same. ``kind``: ``exact`` if all values are equal, else ``reparameterised``.
    An item of fewer than five words is found where these stand in a row; items of fewer than ``least_words`` (a "yes") are
    not looked for. Texts without words match nothing; repeated rows and items repeat, null ids are ids like others, and
    no documents or no items give no rows. Only windows that pass a filter of bounded size leave a document, each of the
    same values once with its places.

    Common windows do not multiply: documents first meet items by each item's rarest windows, as many as no match can
    do without (``telling_windows``), and all windows are joined for the pairs that so met.
    """
    items, row = numbered(benchmark.select("item_id", "text"))
    items = cut(items.withColumnRenamed(row, "item"))
    known = cut(item_windows(items).where(F.col("size") >= least_words))
    short = tuple(r["size"] for r in known.where(F.col("size") < WINDOW).select("size").distinct().collect())  # four at most
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(known))  # FILTER_BITS bits

    @F.pandas_udf("array<struct<h:long,slots:array<long>,places:array<int>>>")
    def passing(texts: pd.Series) -> pd.Series:
        codes, out = Codes(), []
        for t in texts:
            held: dict[tuple, set[int]] = {}
            for h, place, slots in windows_of(t or "", codes, bits.value, short):
                at = held.setdefault((h, *slots), set())
                if slots:
                    at.add(place)
            out.append([(h, slots, sorted(at)) for (h, *slots), at in held.items()])
        return pd.Series(out)

    seen = docs.select(F.col(key).alias("_key"), F.explode(passing(F.col(text))).alias("w"))
    seen = seen.select("_key", F.col("w.h").alias("h"), F.col("w.slots").alias("theirs"), F.col("w.places").alias("places"))
    seen = cut(seen)
    met = join_small(seen.select("_key", "h"), anchors(known, seen), "h").select("_key", "item").distinct()
    met = met.withColumnRenamed("_key", "_met")
    pairs = join_small(seen, met, F.col("_key").eqNullSafe(F.col("_met"))).join(known, ["item", "h"])
    groups = pairs.groupBy("_key", "item").agg(
        F.first("size").alias("size"), F.collect_set("pos").alias("all"), F.collect_list(F.struct("pos", "slots", "theirs", "places")).alias("w")
    )
    # what all windows together do not reach, no part of them does
    groups = groups.withColumn("_r", _reach("all")).where((F.col("_r.covered") / F.col("size") >= COVER) | (F.col("_r.best") >= RUN))

    @F.pandas_udf("covered double, run long, exact boolean")
    def judged(windows: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(w, n) for w, n in zip(windows, sizes)], columns=["covered", "run", "exact"])

    out = groups.select("_key", "item", judged("w", "size").alias("_r"))
    out = out.select("_key", "item", "_r.covered", "_r.run", F.when(F.col("_r.exact"), F.lit("exact")).otherwise(F.lit("reparameterised")).alias("kind"))
    out = out.where((F.col("covered") >= COVER) | (F.col("run") >= RUN))
    out = join_small(out, items.select("item", "item_id"), "item")
    return out.select(F.col("_key").alias(key), "item_id", "covered", "run", "kind")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, all columns kept, told apart by their place.

    Rows with a null or empty text stay, as do all when there are no items; equal rows stay or go together.
    """
    d, row = numbered(docs)
    found = matches(d.select(row, "text"), benchmark, row, least_words=least_words).select(row).distinct()
    return join_small(d, found, row, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "doc_id", least_words=LEAST_WORDS)
