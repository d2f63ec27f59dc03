"""The residual mode: sign, norm, where it is concentrated, what it explains and how stable it is.

Mode vectors are long: ``(keys, axis, idx, val)`` with axis 'row' or 'col'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crossfactor.functions.scalars import finite, pull
from crossfactor.operators.fit import FitTables, predict
from crossfactor.operators.ordered import modal_value, running
from crossfactor.schemas import key_columns
from crossfactor.session import cut


# ------------------------------------------------------------- sign and norm
def sign_of(v: DataFrame, keys: list[str], convention: str = "max_positive", val: str = "val", idx: str = "idx") -> DataFrame:
    """+1 or -1 per key: make the largest entry, the sum or the first non-zero entry of the column vector positive."""
    x = F.col(val)
    if convention == "max_positive":
        probe = F.max_by(x, F.struct(F.abs(x), -F.col(idx)))
    elif convention == "dot_positive":
        probe = F.sum(x)
    elif convention == "first_positive":
        probe = F.min_by(F.when(F.abs(x) > 1e-10, x), F.when(F.abs(x) > 1e-10, F.col(idx)))
    else:
        raise ValueError(f"unknown sign convention {convention}")
    return v.groupBy(*keys).agg(F.when(probe < 0, -1.0).otherwise(1.0).alias("sign"))


def _norms(v: DataFrame, keys: list[str], val: str = "val") -> DataFrame:
    return v.groupBy(*keys).agg(F.sqrt(F.sum(F.col(val) * F.col(val))).alias("norm"))


def signed_normalised(modes: DataFrame, convention: str = "max_positive") -> DataFrame:
    """Fix the sign by the column vector, give it unit length and move the length into the row vector.

    A column vector shorter than 1e-12 is left as it is and its scale is 0.
    """
    keys = [k for k in key_columns(modes)]
    clean = modes.withColumn("val", F.when(finite(F.col("val")), F.col("val")).otherwise(0.0))
    cols = clean.filter(F.col("axis") == "col")
    facts = sign_of(cols, keys, convention).join(_norms(cols, keys), keys)
    flat = F.col("norm") < 1e-12
    out = clean.join(facts, keys)
    val = F.col("val") * F.col("sign")
    scaled = F.when(flat, val).when(F.col("axis") == "col", val / F.col("norm")).otherwise(val * F.col("norm"))
    return out.select(*keys, "axis", "idx", scaled.alias("val"), F.when(flat, 0.0).otherwise(F.col("norm")).alias("scale"))


def residual_modes(tables: FitTables) -> DataFrame:
    """The second component of every rank-two fit as signed, normalised row and column vectors."""
    keys = key_columns(tables.rows)
    rows = tables.rows.select(*keys, F.lit("row").alias("axis"), F.col("row_idx").alias("idx"), F.col("u2").alias("val"))
    cols = tables.cols.select(*keys, F.lit("col").alias("axis"), F.col("col_idx").alias("idx"), F.col("v2").alias("val"))
    return cut(signed_normalised(rows.unionByName(cols)))


# -------------------------------------------------------------- localisation
def _by(v: DataFrame) -> list[str]:
    return [*key_columns(v), *(["axis"] if "axis" in v.columns else [])]


def energy(v: DataFrame) -> DataFrame:
    """Squared entries with the group's size and total; groups without energy are left out."""
    by = _by(v)
    x = F.col("val") * F.col("val")
    tot = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"))
    return v.withColumn("sq", x).join(tot.filter(F.col("total") >= 1e-12), by)


def top_k_mass(e: DataFrame, k_values: list[int] | None = None, spread: bool = False) -> DataFrame:
    """Share of the k largest squares, as rows (k, mass). Default k: 1, 2, 3, min(5, n) and n/4."""
    by = _by(e)
    r = running(e.select(*by, "idx", "sq", "n", "total"), by, [F.desc("sq"), F.col("idx")], {"cum": F.col("sq")}, spread)
    n = F.col("n")
    if k_values is None:
        wanted = (F.col("rn") <= 3) | (F.col("rn") == F.least(F.lit(5), n)) | (F.col("rn") == F.floor(n / 4))
    else:
        wanted = F.col("rn").isin(*k_values)
    return r.filter(wanted).select(*by, F.col("rn").cast("int").alias("k"), (F.col("cum") / F.col("total")).alias("mass"))


def gini(e: DataFrame, spread: bool = False) -> DataFrame:
    """Gini coefficient of the squared shares, clamped to [0, 1]."""
    by = _by(e)
    r = running(e.select(*by, "idx", "sq", "n", "total"), by, [F.col("sq"), F.col("idx")], spread=spread)
    g = r.groupBy(*by).agg(
        F.sum(F.col("rn") * F.col("sq") / F.col("total")).alias("ip"), F.max("n").alias("n"), F.sum(F.col("sq") / F.col("total")).alias("p")
    )
    raw = (2 * F.col("ip") - (F.col("n") + 1) * F.col("p")) / (F.col("n") * F.col("p"))
    return g.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("gini"))


def entropy(e: DataFrame) -> DataFrame:
    """Entropy of the squared shares, its maximum and their ratio (1 for a single entry)."""
    by = _by(e)
    p = F.col("sq") / F.col("total")
    g = e.groupBy(*by).agg(
        F.coalesce(-F.sum(F.when(p > 1e-12, p * F.log(p))), F.lit(0.0)).alias("entropy"), F.max("n").alias("n")
    )
    top = F.log(F.col("n").cast("double"))
    return g.select(
        *by, "entropy", top.alias("max_entropy"),
        F.when(top > 0, F.col("entropy") / top).otherwise(1.0).alias("normalized_entropy"),
    )


def window_share(e: DataFrame, sizes: list[int] | None = None, spread: bool = False) -> DataFrame:
    """Best share of any w contiguous entries, as rows (w, share). Default w: 1, 2, 3, n/4 and n/2 (at least 1).

    From running sums: the energy of a window is the difference of two of them, found by an equi-join on position.
    """
    by = _by(e)
    r = running(e.select(*by, "idx", "sq", "n", "total"), by, [F.col("idx")], {"cum": F.col("sq")}, spread)
    n = F.col("n")
    if sizes is None:
        quarter, half = F.greatest(F.lit(1), F.floor(n / 4)), F.greatest(F.lit(1), F.floor(n / 2))
        w = F.array_distinct(F.array(*[x.cast("int") for x in (F.lit(1), F.lit(2), F.lit(3), quarter, half)]))
    else:
        w = F.array(*[F.lit(x).cast("int") for x in sizes])
    ends = r.select(*by, "rn", "n", "total", "cum", F.explode(F.filter(w, lambda x: x <= n)).alias("w"))
    ends = ends.filter(F.col("rn") >= F.col("w")).withColumn("_at", F.col("rn") - F.col("w"))
    begin = r.select(*by, F.col("rn").alias("_at"), F.col("cum").alias("_before"))
    j = ends.join(begin, [*by, "_at"], "left")
    share = (F.col("cum") - F.coalesce(F.col("_before"), F.lit(0.0))) / F.col("total")
    return j.groupBy(*by, "w").agg(F.max(share).alias("share"))


def peak(v: DataFrame) -> DataFrame:
    """Entry of largest magnitude, lowest index on ties."""
    by = _by(v)
    best = F.max_by(F.struct("idx", "val"), F.struct(F.abs("val"), -F.col("idx")))
    return v.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.idx").alias("peak_index"), F.col("b.val").alias("peak_value")
    )


def localization(v: DataFrame, spread: bool = False) -> DataFrame:
    """All concentration measures of each vector in one row; a vector without energy gets the neutral row."""
    by = _by(v)
    e = energy(v)
    as_map = lambda df, k, x, name: df.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(k, x)))).alias(name)
    )
    out = v.select(*by).distinct()
    for part in (
        gini(e, spread), entropy(e), peak(e), as_map(top_k_mass(e, spread=spread), "k", "mass", "top_k_mass"),
        as_map(window_share(e, spread=spread), "w", "share", "window_concentration"),
    ):
        out = out.join(part, by, "left")
    zero = {"gini": 0.0, "entropy": 0.0, "max_entropy": 0.0, "normalized_entropy": 0.0, "peak_index": 0, "peak_value": 0.0}
    return out.fillna(zero)


# ------------------------------------------------------------ residual maps
def residual_map(obs: DataFrame, tables: FitTables) -> DataFrame:
    """Pulls under both ranks, the standardised correction and the chi-square gain of every observation."""
    p = predict(obs, tables, rank=2)
    y, e = F.col("value"), F.col("total_err")
    p = p.withColumn("pull1", pull(y, F.col("pred1"), e)).withColumn("pull2", pull(y, F.col("pred2"), e))
    return p.withColumn("correction", (F.col("pred2") - F.col("pred1")) / e).withColumn(
        "chi2_gain", F.col("pull1") * F.col("pull1") - F.col("pull2") * F.col("pull2")
    )


def explained_variance(residuals: DataFrame, threshold: float = 0.8) -> DataFrame:
    """1 - var(residual)/var(value) of the rank-one fit per matrix."""
    keys = [k for k in key_columns(residuals) if k != "replicate"]
    r = F.col("value") - F.col("pred1")
    g = residuals.groupBy(*keys).agg(F.var_pop(r).alias("_r"), F.var_pop("value").alias("_t"))
    share = F.when(F.col("_t") > 0, 1 - F.col("_r") / F.col("_t")).otherwise(0.0)
    return g.select(*keys, share.alias("fraction_explained"), (share > threshold).alias("passed"))


# ---------------------------------------------------------------- stability
def _cosines(ref: DataFrame, modes: DataFrame, runs: list[str]) -> DataFrame:
    """|cosine| of each run against the reference of its matrix, per axis."""
    keys = [k for k in key_columns(ref) if k in modes.columns and k not in runs]
    j = modes.join(ref.select(*keys, "axis", "idx", F.col("val").alias("ref")), [*keys, "axis", "idx"])
    g = j.groupBy(*keys, *runs, "axis").agg(
        F.sum(F.col("val") * F.col("ref")).alias("d"), F.sum(F.col("val") * F.col("val")).alias("a"),
        F.sum(F.col("ref") * F.col("ref")).alias("b"),
    )
    cos = F.abs("d") / (F.sqrt("a") * F.sqrt("b") + 1e-12)
    wide = g.groupBy(*keys, *runs).agg(
        F.max(F.when(F.col("axis") == "col", cos)).alias("v2_cos"), F.max(F.when(F.col("axis") == "row", cos)).alias("u2_cos")
    )
    return wide


def stability_grade(n: Column, v_mean: Column, v_std: Column, u_mean: Column, u_std: Column) -> Column:
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "unknown")
        .when((v_mean > 0.9) & (v_std < 0.1) & (u_mean > 0.9) & (u_std < 0.1), "high")
        .when((v_mean > 0.8) & (u_mean > 0.8), "medium")
        .when(v_mean > 0.6, "low")
        .otherwise("unstable")
    )


def stability(reference: DataFrame, starts: DataFrame | None = None, replicates: DataFrame | None = None) -> DataFrame:
    """Agreement of the mode over random starts and over replicates, with a grade.

    ``reference`` has one mode per matrix; ``starts`` and ``replicates`` carry a ``start`` / ``replicate`` key. The
    reference is joined in every case, so replicates can be judged without starts.
    """
    keys = [k for k in key_columns(reference) if k not in ("start", "replicate")]
    out = reference.select(*keys).distinct()
    if starts is not None:
        c = _cosines(reference.drop("start", "replicate"), starts.drop("replicate"), ["start"])
        agg = c.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_starts"),
            F.avg("v2_cos").alias("v2_cosine_mean"), F.stddev_pop("v2_cos").alias("v2_cosine_std"),
            F.avg("u2_cos").alias("u2_cosine_mean"), F.stddev_pop("u2_cos").alias("u2_cosine_std"),
        )
        pk = peak(starts.drop("replicate").filter(F.col("axis") == "col"))
        mode = modal_value(pk, keys, "peak_index", "start").select(
            *keys, F.col("mode").alias("peak_index_mode"), F.col("share").alias("peak_index_consistency")
        )
        out = out.join(agg, keys, "left").join(mode, keys, "left")
    else:
        for c in ("v2_cosine_mean", "v2_cosine_std", "u2_cosine_mean", "u2_cosine_std"):
            out = out.withColumn(c, F.lit(0.0))
        out = out.withColumn("n_starts", F.lit(0).cast("long"))
    if replicates is not None:
        c = _cosines(reference.drop("start", "replicate"), replicates.drop("start"), ["replicate"])
        agg = c.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_bootstrap"),
            F.avg("v2_cos").alias("v2_bootstrap_cosine_mean"), F.stddev_pop("v2_cos").alias("v2_bootstrap_cosine_std"),
            F.avg("u2_cos").alias("u2_bootstrap_cosine_mean"), F.stddev_pop("u2_cos").alias("u2_bootstrap_cosine_std"),
        )
        out = out.join(agg, keys, "left")
    out = out.withColumn("n_starts", F.coalesce("n_starts", F.lit(0)))
    grade = stability_grade(
        F.col("n_starts"), F.col("v2_cosine_mean"), F.col("v2_cosine_std"), F.col("u2_cosine_mean"), F.col("u2_cosine_std")
    )
    return out.withColumn("stability_grade", grade).withColumn("is_stable", F.col("stability_grade").isin("high", "medium"))


# ------------------------------------------------------------- mode verdict
def mode_verdict(df: DataFrame) -> DataFrame:
    """Tiered verdict with reasons from ``p_local, p_global, gini, normalized_entropy, is_stable, stability_grade,
    all_replicate, mean_replication_score, fit_healthy``; a null input means the measure was not taken."""
    pl, pg = F.col("p_local"), F.col("p_global")
    localized = F.coalesce((F.col("gini") > 0.3) | (F.col("normalized_entropy") < 0.8), F.lit(False))
    significant = F.coalesce(pg < 0.05, F.lit(False))
    replicates = F.coalesce(F.col("all_replicate"), F.lit(False))
    unstable = F.coalesce(~F.col("is_stable"), F.lit(False))
    healthy = F.coalesce(F.col("fit_healthy"), F.lit(False))
    strong, moderate = pl < 0.01, (pl >= 0.01) & (pl < 0.05)
    structured = (strong & significant & (localized | replicates)) | (strong & replicates & localized) | (
        moderate & significant & localized & replicates
    )
    word = (
        F.when(~healthy | unstable | pl.isNull(), "inconclusive")
        .when(pl > 0.1, "consistent_with_null")
        .when(structured, "structured_deviation")
        .when(strong | moderate, "likely_artifact")
        .otherwise("consistent_with_null")
    )
    go = healthy & ~unstable & (pl <= 0.1)
    reasons = F.array_compact(
        F.array(
            F.when(pl.isNull(), F.lit("no p-value could be formed")),
            F.when(~healthy, F.lit("the fit itself is not sound")),
            F.when(healthy & unstable, F.concat(F.lit("mode moves between runs: "), F.col("stability_grade"))),
            F.when(healthy & ~unstable & (pl > 0.1), F.format_string("p here %.3f, above 0.1", pl)),
            F.when(healthy & ~unstable & (pl > 0.1), F.lit("one component explains the table")),
            F.when(go & strong, F.format_string("p here %.4f, below 0.01", pl)),
            F.when(go & moderate, F.format_string("p here %.4f, below 0.05", pl)),
            F.when(go & (pl >= 0.05), F.format_string("p here %.4f, at most 0.1", pl)),
            F.when(go & localized, F.format_string("mode sits in few places, Gini %.2f", F.col("gini"))),
            F.when(go & ~localized & F.col("gini").isNotNull(), F.format_string("mode is spread out, Gini %.2f", F.col("gini"))),
            F.when(go & significant, F.format_string("p over all slices %.4f, below 0.05", pg)),
            F.when(go & ~significant & pg.isNotNull(), F.format_string("p over all slices %.4f, not below 0.05", pg)),
            F.when(go & replicates, F.lit("all slices show the same mode")),
            F.when(
                go & ~replicates & F.col("mean_replication_score").isNotNull(),
                F.format_string("slices agree to %.2f", F.col("mean_replication_score")),
            ),
            F.when(go & strong & significant & ~structured, F.lit("neither in few places nor in all slices")),
            F.when(
                go & strong & ~significant & structured, F.lit("taken for real on place and slices alone")
            ),
            F.when(
                go & strong & ~significant & ~structured, F.lit("chance, or many looks, would do")
            ),
            F.when(go & moderate & ~structured, F.lit("too little for a real structure")),
        )
    )
    return df.withColumn("mode_verdict", word).withColumn("reasons", reasons)
