"""Validation: spot checks against known values, run-to-run comparison, calibration of p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crossfactor.functions.special import kolmogorov_pvalue
from crossfactor.operators.ordered import value_positions
from crossfactor.session import cut


# ---------------------------------------------------------------- spot checks
def _grams(text: str, n: Column) -> Column:
    """All pieces of ``n`` characters."""
    first = F.sequence(F.lit(1), F.char_length(text) - n + 1)
    return F.when(F.char_length(text) >= n, F.transform(first, lambda i: F.substr(F.col(text), i, n)))


def containing(labels: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern, label)`` for every distinct label that contains a pattern, by an inverted index.

    Labels post their pieces of one to three characters that some pattern has. A pattern meets the labels under its rarest
    piece (of three characters, or whole when shorter), so nothing is compared that shares none; then it is verified. An
    empty pattern is in every label; null ones are in none.
    """
    width = lambda c: F.least(F.lit(3), F.char_length(c))
    labels = labels.select("label").distinct().filter(F.col("label").isNotNull())
    parts = patterns.select("pattern").distinct().filter(F.char_length("pattern") > 0)
    parts = parts.select("pattern", F.explode(F.array_distinct(_grams("pattern", width("pattern")))).alias("gram"))
    posted = F.array_distinct(F.flatten(F.array_compact(F.array(*[_grams("label", F.lit(n)) for n in (1, 2, 3)]))))
    index = labels.select("label", F.explode(posted).alias("gram")).join(parts.select("gram").distinct(), "gram", "left_semi")
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a piece without a posting is the rarest one: the pattern is then in no label
    rarest = parts.join(often, "gram", "left").groupBy("pattern").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram")
    )
    found = rarest.join(index, "gram").filter(F.contains("label", "pattern")).select("pattern", "label")
    return found.unionByName(labels.select(F.lit("").alias("pattern"), "label"))


def spot_checks(cells: DataFrame, checks: DataFrame, log_tolerance: float = 0.5) -> DataFrame:
    """Look up ``checks(check_id, row_label, col_label, expected, tolerance, is_log)`` among the cells and compare.

    Three tiers: equal labels, labels containing the wanted ones, labels containing a piece of each (rows split at '_',
    columns at '='); inside a tier the first cell by ``seq`` wins. Every step is an equality join: what checks that have
    no exact hit ask for is collapsed to distinct pairs of patterns, patterns meet distinct labels through an inverted
    index, and each pair of patterns keeps its first cell only.
    """
    known = cells.groupBy("row_label", "col_label").agg(
        F.min("seq").alias("first_seq"), F.max_by(F.struct("value", "total_err"), F.col("seq")).alias("last")
    ).select("row_label", "col_label", "first_seq", "last.value", "last.total_err")
    known = cut(known)
    want = checks.select("check_id", F.col("row_label").alias("wr"), F.col("col_label").alias("wc"))
    cell = F.struct("row_label", "col_label", "value", "total_err")
    exact = want.join(known, (F.col("wr") == F.col("row_label")) & (F.col("wc") == F.col("col_label")))
    exact = exact.select("check_id", F.lit(0).alias("tier"), "first_seq", cell.alias("c"))
    rest = want.join(exact.select("check_id"), "check_id", "left_anti")
    whole = rest.select("check_id", F.lit(1).alias("tier"), F.col("wr").alias("pr"), F.col("wc").alias("pc"))
    split = rest.select("check_id", F.lit(2).alias("tier"), F.explode(F.array_distinct(F.split("wr", "_"))).alias("pr"), "wc")
    split = split.select("check_id", "tier", "pr", F.explode(F.array_distinct(F.split("wc", "="))).alias("pc"))
    asked = cut(whole.unionByName(split))
    rows = containing(known.select(F.col("row_label").alias("label")), asked.select(F.col("pr").alias("pattern")))
    cols = containing(known.select(F.col("col_label").alias("label")), asked.select(F.col("pc").alias("pattern")))
    met = asked.select("pr", "pc").distinct().join(rows.select(F.col("pattern").alias("pr"), F.col("label").alias("row_label")), "pr")
    met = met.join(known, "row_label").join(cols.select(F.col("pattern").alias("pc"), F.col("label").alias("col_label")), ["pc", "col_label"])
    first = met.groupBy("pr", "pc").agg(F.min("first_seq").alias("first_seq"), F.min_by(cell, F.col("first_seq")).alias("c"))
    near = asked.join(first, ["pr", "pc"]).select("check_id", "tier", "first_seq", "c")
    pick = F.min_by(F.struct("c.row_label", "c.col_label", "c.value", "c.total_err", "tier"), F.struct("tier", "first_seq"))
    best = exact.unionByName(near).groupBy("check_id").agg(pick.alias("m"))
    j = checks.join(best, "check_id", "left")
    actual, expected = F.col("m.value"), F.col("expected")
    log_ok = F.col("is_log") & (expected > 0)
    target = F.when(log_ok, F.log(expected)).when(~F.col("is_log"), expected)
    rel = F.abs(actual - target) / F.abs(target)
    passed = F.when(F.col("is_log"), rel < log_tolerance).otherwise(rel <= F.col("tolerance"))
    message = (
        F.when(actual.isNull(), F.format_string("%s / %s was not found", F.col("row_label"), F.col("col_label")))
        .when(F.col("is_log") & ~(expected > 0), "no logarithm of the expected value")
        .when(F.col("is_log"), F.format_string("logarithms: got %.3f, want %.3f", actual, target))
        .when(~passed, F.format_string("got %.4f, want %.4f", actual, expected))
        .otherwise("")
    )
    return j.select(
        "check_id", F.col("m.row_label").alias("matched_row"), F.col("m.col_label").alias("matched_col"), F.col("m.tier").alias("tier"),
        actual.alias("actual"), F.col("m.total_err").alias("actual_err"), rel.alias("relative_diff"),
        F.coalesce(passed, F.lit(False)).alias("passed"), message.alias("message"),
    )


def identity_report(results: DataFrame, warnings: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """All checks passed and no provenance warning. ``warnings`` has one row per warning (``by`` columns, text)."""
    by = by or []
    g = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed"))
    if warnings is not None:
        w = warnings.groupBy(*by).agg(F.count(F.lit(1)).alias("n_warnings"))
        g = g.join(w, by, "left") if by else g.withColumn("n_warnings", w.scalar())
    else:
        g = g.withColumn("n_warnings", F.lit(0))
    g = g.fillna({"n_warnings": 0})
    return g.withColumn("all_passed", (F.col("n_passed") == F.col("n_checks")) & (F.col("n_warnings") == 0))


# ------------------------------------------------------------------ run vs run
def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-10, atol: float = 1e-10) -> DataFrame:
    """Rows that differ between two result tables: missing on one side, or any column beyond the tolerance.

    A missing result is a difference.
    """
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*values).alias("l"))
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*values).alias("r"))
    on = None
    for k in keys:
        cond = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = cond if on is None else on & cond
    j = left.join(right, on, "full_outer")
    tests = []
    for c in values:
        x, y = F.col(f"l.{c}"), F.col(f"r.{c}")
        if dict(a.dtypes)[c] in ("double", "float"):
            same = F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), x.eqNullSafe(y))
        else:
            same = x.eqNullSafe(y)
        tests.append(F.when(~same, F.lit(c)))
    diff = F.when(F.col("l").isNull(), F.array(F.lit("missing in first"))).when(
        F.col("r").isNull(), F.array(F.lit("missing in second"))
    ).otherwise(F.array_compact(F.array(*tests)))
    return j.select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys], diff.alias("mismatches"))


def reproducible(diff: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return diff.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("mismatches") > 0).alias("n_different")
    ).withColumn("passed", (F.col("n_different") == 0) & (F.col("n_rows") > 0))


def result_hash(df: DataFrame, keys: list[str], digits: int = 10) -> DataFrame:
    """Short content hash of each row, doubles rounded first."""
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c not in keys]
    return df.select(*keys, F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 16).alias("hash"))


# ----------------------------------------------------------------- calibration
def ks_uniform(p: DataFrame, by: list[str], col: str = "p", buckets: int = 1024) -> DataFrame:
    """Kolmogorov-Smirnov distance of each group from the uniform distribution, with its asymptotic p-value.

    Equal p-values collapse first and each group is sorted in 1024 slices of (0, 1), so its size does not matter.
    """
    pos = value_positions(p.filter(F.col(col).isNotNull() & ~F.isnan(col)), by, col, F.floor(F.col(col) * buckets))
    x, n = F.col(col), F.col("n")
    dist = F.greatest(F.col("n_le") / n - x, x - (F.col("n_le") - F.col("n_eq")) / n)
    g = pos.groupBy(*by).agg(F.max(dist).alias("ks_statistic"), F.max("n").alias("n"))
    return g.withColumn("ks_pvalue", kolmogorov_pvalue("ks_statistic", "n"))


def rejection_rate(p: DataFrame, by: list[str], alpha: float = 0.05, col: str = "p") -> DataFrame:
    """Share of p-values below alpha, its binomial error under the null, and whether it is within three of them."""
    ok = p.filter(F.col(col).isNotNull() & ~F.isnan(col))
    g = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(col) < alpha).cast("double")).alias("rejection_rate"))
    se = F.sqrt(F.lit(alpha * (1 - alpha)) / F.col("n"))
    return g.withColumn("rate_se", se).withColumn("rate_calibrated", F.abs(F.col("rejection_rate") - alpha) < 3 * F.col("rate_se"))


def power_curve(p: DataFrame, by: list[str], alpha: float = 0.05, col: str = "p", moderate: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Power and its error per ``strength``, and per group whether it exceeds one half at the strength nearest 0.3."""
    ok = p.filter(F.col(col).isNotNull() & ~F.isnan(col))
    g = ok.groupBy(*by, "strength").agg(
        F.count(F.lit(1)).alias("n_successful"), F.avg((F.col(col) < alpha).cast("double")).alias("power")
    )
    g = g.withColumn("power_se", F.sqrt(F.col("power") * (1 - F.col("power")) / F.col("n_successful")))
    near = F.min_by(F.col("power"), F.struct(F.abs(F.col("strength") - moderate), F.col("strength")))
    return g, g.groupBy(*by).agg((near > 0.5).alias("power_adequate"))


def calibration_report(p: DataFrame, by: list[str], n_expected: int, alpha: float = 0.05, col: str = "p") -> DataFrame:
    """Uniformity and rejection rate together; fewer than half the expected p-values fail the group."""
    r = ks_uniform(p, by, col).join(rejection_rate(p, by, alpha, col).drop("n"), by)
    enough = F.col("n") >= n_expected // 2
    return r.withColumn("null_passed", enough & (F.col("ks_pvalue") > 0.01) & F.col("rate_calibrated"))
