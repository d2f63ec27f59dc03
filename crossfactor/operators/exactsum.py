"""Sums of doubles that come out the same, bit for bit, however the rows are laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crossfactor.functions.scalars import finite

#: Addends are cut into whole multiples of 2^(32 b); three cuts hold all 53 bits of a double.
BITS, CUTS = 32, 3
#: Lowest and highest ``b`` of a first cut; what lies below 2^-992 counts as zero.
LOW, HIGH = -29, 31


def _unit(b: Column) -> Column:
    return F.pow(F.lit(2.0), b * BITS)


def _cut_off(d: DataFrame) -> DataFrame:
    """Adds the place ``_b`` of the first cut of ``_x`` and the whole numbers ``_q0``, ``_q1``, ... at ``_b``, ``_b - 1``, ...

    Plain arithmetic, a column at a time: it runs once for each addend.
    """
    x = F.col("_x")
    place = F.when(x == 0, F.lit(LOW)).otherwise(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.floor(F.log2(F.abs(x)) / BITS))))
    d = d.withColumn("_b", F.when(x.isNotNull(), place.cast("int"))).withColumn("_u", _unit(F.col("_b")))
    for i in range(CUTS):
        d = d.withColumn(f"_q{i}", (F.col("_x") / F.col("_u")).cast("long"))  # towards zero
        d = d.withColumn("_x", F.col("_x") - F.col(f"_q{i}") * F.col("_u")).withColumn("_u", F.col("_u") / 2.0**BITS)
    return d


def _joined(parts: Column) -> Column:
    """One double from ``(b, total)``: carries from the lowest place up leave digits that depend on the exact sum alone,
    and these are added in that order."""
    known = F.map_from_entries(parts)
    low, high = F.array_min(F.map_keys(known)), F.array_max(F.map_keys(known))
    base = F.lit(2**BITS).cast("decimal(38,0)")

    def carry(state: Column, b: Column) -> Column:
        t = (F.coalesce(known[b], F.lit(0).cast("decimal(30,0)")).cast("decimal(38,0)") + state["c"]).cast("decimal(38,0)")
        c = F.floor(t / base).cast("decimal(38,0)")
        digit = (t - (c * base).cast("decimal(38,0)")).cast("double")
        return F.struct(c.alias("c"), (state["v"] + digit * _unit(b)).alias("v"))

    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("c"), F.lit(0.0).alias("v"))
    return F.aggregate(F.sequence(low, high), start, carry, lambda s: s["v"] + s["c"].cast("double") * _unit(high + 1))


def exact_sums(df: DataFrame, by: list[str], sums: dict[str, Column | list[Column]], counts: bool = False) -> DataFrame:
    """Per group one double for each name: the sum of a column, or of several that are added without rounding between them.

    Whole numbers per place of 32 bits are what is added, so partial sums combine before the shuffle in any order and a
    group of any size is at most 64 rows an addend after it. Nulls are left out, a group without any number gives null, and
    infinities or NaN give what a plain sum gives. Group keys may be null. With ``counts`` a second column ``<name>_n`` holds
    how many rows have a number, finite or not, in the (first) column.
    """
    names = [n for n, xs in sums.items() for _ in (xs if isinstance(xs, list) else [xs])]
    first = [k for k, n in enumerate(names) if n not in names[:k]]
    addends = [x.cast("double") for xs in sums.values() for x in (xs if isinstance(xs, list) else [xs])]
    d = df.select(*by, F.posexplode(F.array(*addends)).alias("_k", "_x"))
    known = F.col("_x").isNotNull()
    d = d.withColumn("_odd", F.when(known & ~finite(F.col("_x")), F.col("_x"))).withColumn("_given", known)
    d = _cut_off(d.withColumn("_x", F.when(finite(F.col("_x")), F.col("_x"))))
    # halves of 16 bits, so that no number of rows overflows the sums of whole numbers
    halves = [f(f"_q{i}").alias(f"{n}{i}") for i in range(CUTS) for n, f in (("_h", _high), ("_l", _low))]
    d = d.groupBy(*by, "_k", "_b").agg(*halves, F.sum("_odd").alias("_odd"), F.count_if("_given").alias("_n"))
    # what is left has a row for each place: whole numbers of any size, names in place of addends
    total = [(F.col(f"_h{i}").cast("decimal(20,0)") * F.lit(65536).cast("decimal(6,0)") + F.col(f"_l{i}").cast("decimal(20,0)")).cast("decimal(28,0)") for i in range(CUTS)]
    places = F.array(*[F.struct((F.col("_b") - i).alias("b"), t.alias("q")) for i, t in enumerate(total)])
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_k") + 1)
    n = F.when(F.col("_k").isin(first), F.col("_n")).otherwise(0)
    once = F.array(F.struct(F.lit(None).cast("int").alias("b"), F.lit(None).cast("decimal(28,0)").alias("q"), F.col("_odd").alias("odd"), n.cast("long").alias("n")))
    rest = F.transform(F.when(F.col("_b").isNull(), F.array().cast("array<struct<b:int,q:decimal(28,0)>>")).otherwise(places), lambda p: F.struct(
        p["b"].alias("b"), p["q"].alias("q"), F.lit(None).cast("double").alias("odd"), F.lit(0).cast("long").alias("n")))
    d = d.select(*by, name.alias("_name"), F.inline(F.concat(once, rest)).alias("_b", "_q", "_odd", "_n"))
    d = d.groupBy(*by, "_name", "_b").agg(F.sum("_q").alias("_q"), F.sum("_odd").alias("_odd"), F.sum("_n").alias("_n"))
    parts = F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_q")))
    d = d.groupBy(*by, "_name").agg(parts.alias("_p"), F.sum("_odd").alias("_odd"), F.sum("_n").alias("_n"))
    value = F.coalesce(F.col("_odd"), F.when(F.size("_p") > 0, _joined(F.col("_p"))))
    d = d.select(*by, "_name", value.alias("_v"), "_n")
    pick = lambda n, c: F.max(F.when(F.col("_name") == n, F.col(c)))
    return d.groupBy(*by).agg(*[pick(n, "_v").alias(n) for n in sums], *[pick(n, "_n").alias(f"{n}_n") for n in sums if counts])


def _high(q: str) -> Column:
    return F.sum(F.shiftright(q, 16))


def _low(q: str) -> Column:
    return F.sum(F.col(q).bitwiseAND(65535))


def _squared(df: DataFrame, x: str) -> tuple[DataFrame, list[Column]]:
    """The square of a column as two doubles whose sum is exact (splitting by 2^27 + 1); only the first where the split
    overflows. Column by column, so that no term is worked out twice."""
    x_, sq, hi, lo = F.col(x), F.col("_sq"), F.col("_hi"), F.col("_lo")
    df = df.withColumn("_sq", x_ * x_).withColumn("_c", x_ * 134217729.0)
    df = df.withColumn("_hi", F.col("_c") - (F.col("_c") - x_)).withColumn("_lo", x_ - hi)
    df = df.withColumn("_rest", ((hi * hi - sq) + 2.0 * hi * lo) + lo * lo)
    return df, [sq, F.when(finite(F.col("_rest")), F.col("_rest"))]


def exact_moments(df: DataFrame, by: list[str], value: Column, about: Column | None = None) -> DataFrame:
    """``(n, mean, m2)`` as ``cells.moments`` gives them, the same on any layout. Squares are taken about ``about`` (a
    constant near the values, zero by default): the nearer, the more digits of ``m2`` are left."""
    about = about if about is not None else F.lit(0.0)
    d, square = _squared(df.select(*by, (value - about).cast("double").alias("_off")), "_off")
    s = exact_sums(d, by, {"_s": F.col("_off"), "_ss": square}, counts=True)
    n, total = F.col("_s_n"), F.col("_s")
    m2 = F.greatest(F.lit(0.0), F.col("_ss") - total * total / n)
    return s.select(*by, "_s_n", F.when(n > 0, total / n + about).alias("mean"), F.when(n > 0, m2).alias("m2")).withColumnRenamed("_s_n", "n")


def exact_chi2(residuals: DataFrame, by: list[str], predicted: str = "pred1") -> DataFrame:
    """Chi-square of predictions per group, the same on any layout; ``n_cells`` counts what it adds."""
    r = (F.col("value") - F.col(predicted)) / F.col("total_err")
    d, square = _squared(residuals.select(*by, r.alias("_r")), "_r")
    s = exact_sums(d, by, {"chi2": square}, counts=True)
    return s.select(*by, F.col("chi2_n").alias("n_cells"), "chi2")
