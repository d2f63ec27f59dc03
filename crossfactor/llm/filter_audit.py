"""How filters interact: every removal by a coalition of filters, the steps of every order, and exact Shapley shares."""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.tables import table
from crossfactor.session import cut

#: Bytes that count: capitals, the signs of filter D, and bytes that continue a code point.
CAPITALS, SIGNS, CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text split at once.
SLICE = 1 << 22
NAMES = "ABCDE"


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: whether filters A to D fail on a whole text."""
    words, distinct, at = 0, set(), 0
    while at < len(text):
        gap = BLANK.search(text, at + SLICE)  # a slice ends behind a blank
        stop = gap.end() if gap else len(text)
        found = text[at:stop].split()
        words += len(found)
        distinct.update(found)
        at = stop
    n = len(text)
    capitals, points = n - len(text.translate(None, CAPITALS)), len(text.translate(None, CONTINUED))
    return (words < 200) | (100 * len(distinct) < 50 * words) << 1 | (100 * capitals > 2 * points) << 2 | (len(text.translate(None, SIGNS)) < n) << 3


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, fails, documents, good, toxic)``: documents counted by source and by the bits of the five filters they fail.

    Texts are read once; what is stored of a document is its id, its part, four bits and a digest. Filter E fails where the
    least id of the text's digest is another one: rows meet that least id by digest and id together, so a group of copies of
    any size is spread. A null id is neither smaller nor larger than another and never fails E, and has no label; of
    rows of labels with one id, any that says 1 counts.
    """

    @F.pandas_udf("fails int, digest binary")
    def looked_at(texts: pd.Series) -> pd.DataFrame:
        known = [b"" if t is None else bytes(t) for t in texts]
        return pd.DataFrame({"fails": [text_failures(t) for t in known], "digest": [hashlib.sha256(t).digest() for t in known]})

    seen = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), looked_at(F.col("text").cast("binary")).alias("x"))
    seen = cut(seen.select("doc_id", "part", "x.fails", "x.digest"))
    named = seen.where("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = named.join(first, ["digest", "doc_id"], "left").withColumn("fails", F.col("fails") + F.when(F.col("_first"), 0).otherwise(16))
    known = known.join(marks, "doc_id", "left").select("part", "fails", "good", "toxic")
    nameless = seen.where("doc_id IS NULL").select("part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    counted = known.unionByName(nameless).groupBy("part", "fails")
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in ("good", "toxic")]
    return counted.agg(F.count(F.lit(1)).alias("documents"), *sums)


def shapley_weights(n: int) -> list[list[int]]:
    """For each of ``n`` filters the weights of the ``2**n`` coalition removals that give its Shapley value times ``n!``.

    Least squares over all coalitions but the empty and the full one, weighted by the Shapley kernel, under the constraint
    that the shares add up to the removal of all filters. The normal equations do not depend on the removals, so they are
    solved once, in rationals, for every right-hand side at the same time.
    """
    size, full = 1 << n, (1 << n) - 1
    a = [[Fraction(0)] * (n + 1) + [Fraction(0)] * size for _ in range(n + 1)]
    for s in range(1, full):
        k = s.bit_count()
        w = Fraction(n - 1, comb(n, k) * k * (n - k))
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            for j in inside:
                a[i][j] += w
            a[i][n + 1 + s] += w
    for i in range(n):
        a[i][n] = a[n][i] = Fraction(1)
    a[n][n + 1 + full] = Fraction(1)
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if a[r][c])
        a[c], a[pivot] = a[pivot], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(n + 1):
            if r != c and a[r][c]:
                a[r] = [x - a[r][c] * y for x, y in zip(a[r], a[c])]
    out = [[x * factorial(n) for x in row[n + 1 :]] for row in a[:n]]
    if any(x.denominator != 1 for row in out for x in row):
        raise ArithmeticError("Shapley weights times n! must be whole")
    return [[int(x) for x in row] for row in out]


def _steps(names: str) -> Column:
    """All orders and their steps: the filter, the coalitions before and after it."""
    out = []
    for order in permutations(range(len(names))):
        before = 0
        for k, f in enumerate(order):
            after = before | 1 << f
            out.append((("".join(names[i] for i in order)), k + 1, f, before, after))
            before = after
    cells = [f"named_struct('filter_order', '{o}', 'step', {k}, 'f', {f}, 'before', {b}, 'after', {a})" for o, k, f, b, a in out]
    return F.expr(f"array({', '.join(cells)})")


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """Every step of every order of the filters, for each ``part`` of ``(part, fails, documents, good, toxic)``.

    A part's cells (one for each set of failing filters, at most ``2**n``) become one array of all coalition removals; a
    step is the difference of two of them. No rows give no rows; parts are strings as they are, and a null one is a part.
    """
    n = len(names)
    full = (1 << n) - 1
    cells = F.array_agg(F.struct("fails", "documents", "good", "toxic")).alias("cells")
    # rows of one set of filters may come more than once: sums do not mind
    parts = counts.groupBy("part", "fails").agg(*[F.sum(c).alias(c) for c in ("documents", "good", "toxic")]).groupBy("part").agg(cells)
    for c in ("documents", "good", "toxic"):
        gone = f"aggregate(cells, 0L, (t, c) -> t + IF((c.fails & s) != 0, c.{c}, 0L))"
        parts = parts.withColumn(f"v_{c}", F.expr(f"transform(sequence(0, {full}), s -> {gone})"))
    rows = ", ".join("array(" + ", ".join(f"{x}L" for x in row) + ")" for row in shapley_weights(n))
    value = f"transform(array({rows}), w -> aggregate(zip_with(w, v_documents, (x, y) -> x * y), 0L, (t, x) -> t + x))"
    parts = parts.withColumn("total", F.expr("aggregate(cells, 0L, (t, c) -> t + c.documents)")).withColumn("shapley", F.expr(value))
    steps = parts.drop("cells").withColumn("s", F.explode(_steps(names)))

    def v(c: str, coalition: str) -> Column:
        return F.expr(f"v_{c}[{coalition}]")

    after, removed = v("documents", "s.after"), v("documents", "s.after") - v("documents", "s.before")
    return steps.select(
        "part", "s.filter_order", "s.step", (F.col("total") - after).alias("kept"), removed.alias("removed"),
        (v("documents", "shiftleft(1, s.f)") - removed).alias("redundant"),
        (v("documents", f"{full}") - v("documents", f"{full} - shiftleft(1, s.f)")).alias("unique_fails"),
        (v("good", "s.after") - v("good", "s.before")).alias("good_lost"), (v("toxic", "s.after") - v("toxic", "s.before")).alias("toxic_lost"),
        F.expr("shapley[s.f]").alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(failures(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic")))


SQL = r"""
WITH words AS (
  SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, MAX((quality = 1)::INT) AS good, MAX((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), tested AS (
  SELECT part, len(w) < 200 AS a, 100 * list_unique(w) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, COALESCE(words.doc_id > MIN(words.doc_id) OVER (PARTITION BY t), FALSE) AS e,
    COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic
  FROM words LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, a, b, c, d, e, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM tested GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5
), steps AS (SELECT filter_order, k::INT AS step FROM orders, range(1, 6) AS x(k)),
failing AS (
  SELECT part, n, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
    || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS f FROM cells
), placed AS (
  SELECT part, filter_order, step, n, good, toxic, f, contains(f, substr(filter_order, step, 1)) AS here,
    f <> translate(f, substr(filter_order, 1, step - 1), '') AS earlier
  FROM failing, steps
), counted AS (
  SELECT part, filter_order, step, SUM(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept,
    SUM(CASE WHEN here AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed, SUM(CASE WHEN here AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
    SUM(CASE WHEN here AND len(f) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    SUM(CASE WHEN here AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, SUM(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM placed GROUP BY ALL
)
SELECT *, SUM(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM counted
"""
