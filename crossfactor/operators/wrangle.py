"""Table preparation: cuts with counts, tagging, role mapping, reshaping, source priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from crossfactor.functions.scalars import default_error, finite, total_error


# ----------------------------------------------------------------------- cuts
def range_cuts(cuts: dict[str, tuple[float | None, float | None]]) -> Column:
    """Inclusive ranges on several columns as one predicate that the scan can push down."""
    keep = F.lit(True)
    for name, (lo, hi) in cuts.items():
        if lo is not None:
            keep = keep & (F.col(name) >= lo)
        if hi is not None:
            keep = keep & (F.col(name) <= hi)
    return keep


def cut_counted(df: DataFrame, cuts: dict[str, tuple[float | None, float | None]], by: list[str]) -> DataFrame:
    """How many rows each group has before and after the cuts, in one pass."""
    keep = F.coalesce(range_cuts(cuts), F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before"), F.count_if(keep).alias("n_after"))


def apply_cuts(df: DataFrame, cuts: dict[str, tuple[float | None, float | None]], name: str = "range_cuts") -> tuple[DataFrame, Observation]:
    """The cut frame and an observation that holds n_before and n_after once an action has run on it."""
    seen = Observation(name)
    keep = F.coalesce(range_cuts(cuts), F.lit(False))
    watched = df.observe(seen, F.count(F.lit(1)).alias("n_before"), F.count_if(keep).alias("n_after"))
    return watched.filter(keep), seen


def require_rows(seen: Observation, name: str = "cuts") -> dict:
    """The counts, or an error when nothing is left."""
    counts = seen.get
    if not counts["n_after"]:
        raise ValueError(f"{name}: none of {counts['n_before']} rows left")
    return counts


# -------------------------------------------------------------------- tagging
# Category words of the signal-strength tables, first match wins.
ROW_MODES = [("ggf", "ggF"), ("vbf", "VBF"), ("wh", "WH"), ("zh", "ZH"), ("tth", "ttH"), ("th", "tH")]
ROW_MODE_PHRASES = [
    ("gluon fusion", "ggF"), ("vector boson fusion", "VBF"), ("associated production", "WH"), ("tth", "ttH"),
]
COLUMN_MODES = [
    ("gamma", "gamgam"), ("γγ", "gamgam"), ("diphoton", "gamgam"), ("zz", "ZZ"), ("4l", "ZZ"), ("ww", "WW"), ("tau", "tautau"),
    ("ττ", "tautau"), ("bb", "bb"), ("mu", "mumu"), ("μμ", "mumu"),
]
COLUMN_HEADER_MODES = [("gamma", "gamgam"), ("zz", "ZZ"), ("ww", "WW"), ("tau", "tautau"), ("bb", "bb"), ("mu", "mumu")]
DISPLAY_NAMES = {"gamgam": "γγ", "ZZ": "ZZ*", "WW": "WW*", "tautau": "ττ", "bb": "bb̄", "mumu": "μμ"}
ROW_ORDER = ["ggF", "VBF", "WH", "ZH", "ttH", "tH"]
COLUMN_ORDER = ["gamgam", "ZZ", "WW", "tautau", "bb", "mumu"]


def tag_first_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The tag of the first pattern contained in the lower-cased text, null when none is."""
    low, tag = F.lower(text), None
    for needle, value in patterns:
        hit = F.contains(low, F.lit(needle))
        tag = F.when(hit, value) if tag is None else tag.when(hit, value)
    return tag


def has_keywords(name: Column, description: Column) -> Column:
    """Tables that carry signal strengths, by words in name or description."""
    n, d = F.lower(name), F.lower(description)
    has = lambda c, w: F.contains(c, F.lit(w))
    return (
        has(d, "signal strength") | has(n, "mu_") | has(name, "μ") | (has(d, "prod") & has(d, "decay")) | has(d, "coupling")
    )


# --------------------------------------------------------------- role mapping
# The words by which a column shows its role.
#: Role, words of which a name has one, words it must not have, words of which one must come with them.
_VALUE = ("sigma", "f2d", "xsec", "cross", "sig(c=reduced")
_SPREAD = ("err", "unc")
TABLE_RULES = [
    ("Q2", ("q2", "q^2", "q**2", "name=q"), (), ()),
    ("beta", ("beta", "β", "name=beta"), (), ()),
    ("xP", ("xp", "x_p", "xpom", "x_pom", "xi", "x(name=pomeron)", "name=pomeron"), (), ()),
    ("value", _VALUE, _SPREAD, ()),
    ("stat_err", ("stat",), (), _VALUE),
    ("sys_err", ("sys",), ("stat",), _VALUE),
    ("total_err", _SPREAD, ("stat", "sys"), _VALUE),
]
CURVE_RULES = [
    ("t", ("|t|", "t_abs", "=t="), (), ()),
    ("stat_err", ("stat",), ("|t|", "t_abs"), ("dsig", *_SPREAD)),
    ("sys_err", ("sys",), ("|t|", "t_abs", "stat"), ("dsig", *_SPREAD)),
    ("total_err", _SPREAD, ("|t|", "t_abs", "stat", "sys"), ()),
    ("dsigma_dt", ("dsig",), ("|t|", "t_abs", "stat", "sys", *_SPREAD), ()),
]
REQUIRED_ROLES = ("Q2", "beta", "xP", "value")


def missing_columns(present: list[str], required: tuple[str, ...] | list[str]) -> list[str]:
    return sorted(set(required) - set(present))


def match_roles(columns: list[str], rules: list[tuple], last: tuple[str, ...] = ()) -> dict[str, str]:
    """First column that satisfies each rule (the last one for the roles in ``last``); a name plays no role twice among
    the rules before it. Names are matched in lower case, and as a whole between equals signs."""
    out: dict[str, str] = {}
    for role, any_of, none_of, along in rules:
        fit = [
            c for c in columns for low in [c.lower()] for whole in [f"={low}="]
            if any(w in low or w == whole for w in any_of) and not any(w in low for w in none_of) and (not along or any(w in low for w in along))
        ]
        fit = [c for c in fit if c not in out.values()]
        if fit:
            out[role] = fit[-1 if role in last else 0]
    return out


def resolve_roles(columns: list[str]) -> dict[str, str]:
    """Which column plays which role, from names alone; raises with the roles nobody plays."""
    roles = match_roles(columns, TABLE_RULES, last=("stat_err", "sys_err", "total_err"))
    missing = missing_columns(list(roles), REQUIRED_ROLES)
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {columns}")
    return roles


def _num(name: str) -> Column:
    return F.col(f"`{name}`").try_cast("double")


def map_roles(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Role columns as doubles, with the total error completed and non-positive values dropped."""
    roles = resolve_roles([c for c in df.columns if c not in (keep or [])])
    cols = [_num(src).alias(role) for role, src in roles.items()]
    errors = [F.lit(None).cast("double").alias(e) for e in ("stat_err", "sys_err", "total_err") if e not in roles]
    return complete_roles(df.select(*(keep or []), *cols, *errors))


def complete_roles(out: DataFrame) -> DataFrame:
    """Missing parts of the error as zero, the total completed (else a tenth of the value), unusable rows dropped."""
    out = out.fillna(0.0, ["stat_err", "sys_err"])
    total = total_error(F.col("stat_err"), F.col("sys_err"), F.col("total_err"))
    out = out.withColumn("total_err", default_error(total, F.col("value"), 0.1))
    complete = F.col("Q2").isNotNull() & F.col("beta").isNotNull() & F.col("xP").isNotNull()
    return out.filter(complete & (F.col("value") > 0))


def curve_roles(columns: list[str]) -> dict[str, str]:
    """Roles of a curve table; the axis and the value fall back to the first and second column."""
    roles = match_roles(columns, CURVE_RULES)
    for place, role in enumerate(("t", "dsigma_dt")):
        if role not in roles and place < len(columns):
            roles[role] = columns[place]
    return roles


def looks_like_curve(columns: list[str], numeric: int) -> bool:
    joined = " ".join(columns).lower()
    return "t" in joined or "sigma" in joined or "mb" in joined or numeric >= 2


def normalise_curve(df: DataFrame) -> DataFrame:
    """A curve table with standard names and numbers; whatever is not a number becomes null."""
    roles = curve_roles(df.columns)
    col = lambda r, d=None: _num(roles[r]) if r in roles else F.lit(d).cast("double")
    out = df.select(
        col("t").alias("t"), col("dsigma_dt").alias("dsigma_dt"), col("stat_err", 0.0).alias("stat_err"),
        col("sys_err", 0.0).alias("sys_err"),
        (col("total_err") if "total_err" in roles else F.hypot(col("stat_err", 0.0), col("sys_err", 0.0))).alias("total_err"),
    )
    return out


# ------------------------------------------------------------------- reshaping
def wide_to_cells(
    df: DataFrame, label: str, columns: list[str], row_tag: list[tuple[str, str]], col_tag: list[tuple[str, str]], share: float = 0.1
) -> DataFrame:
    """Unpivot a labelled wide table into tagged cells with a relative error; untagged rows and columns fall out."""
    long = df.select(label, *[_num(c).alias(c) for c in columns]).unpivot([label], columns, "column", "value")
    return long.select(
        tag_first_match(F.trim(F.col(label)), row_tag).alias("row_label"),
        tag_first_match(F.col("column"), col_tag).alias("col_label"),
        "value", (share * F.abs("value")).alias("total_err"),
    ).filter(F.col("row_label").isNotNull() & F.col("col_label").isNotNull() & finite(F.col("value")))


def single_measurement(df: DataFrame, by: str, pos: str, share: float = 0.1) -> DataFrame:
    """First value-like and first error-like column of the first row of each table."""
    names = [c for c in df.columns if c not in (by, pos)]
    value = next((c for c in names if any(w in c.lower() for w in ("mu", "signal", "strength"))), None)
    if value is None:
        raise ValueError(f"no value-like column among {names}")
    err = next((c for c in names if "err" in c.lower() or "unc" in c.lower()), None)
    e = _num(err) if err else share * F.abs(_num(value))
    first = F.min_by(F.struct(_num(value).alias("value"), e.alias("total_err")), F.col(pos))
    return df.groupBy(by).agg(first.alias("r")).select(by, "r.value", "r.total_err")


def binned_cells(df: DataFrame, row_label: Column, col_label: Column) -> DataFrame:
    return df.withColumn("row_label", row_label).withColumn("col_label", col_label)


def dis_labels(df: DataFrame) -> DataFrame:
    """Row labels from (Q2, beta), column labels from xP."""
    return binned_cells(
        df, F.format_string("Q2=%.1f_beta=%.3f", F.col("Q2"), F.col("beta")), F.format_string("xP=%.5f", F.col("xP"))
    )


# ------------------------------------------------------------ sources and union
def tagged_union(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Sources with differing columns under one tag."""
    out = None
    for name, df in sources.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def source_priority(df: DataFrame, by: list[str], min_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of several sources per group keep the first (lowest ``priority``) with more than ``min_rows`` rows.

    Also returns one fallback row for every better-placed source that was passed over.
    """
    n = df.groupBy(*by, "priority", "source").agg(F.count(F.lit(1)).alias("n_rows"))
    win = n.filter(F.col("n_rows") > min_rows).groupBy(*by).agg(
        F.min("priority").alias("_p"), F.min_by("source", "priority").alias("_s")
    )
    kept = df.join(win, by).filter(F.col("priority") == F.col("_p")).drop("_p", "_s")
    lost = n.join(win, by, "left").filter(F.col("_p").isNull() | (F.col("priority") < F.col("_p")))
    lost = lost.select(
        *by, F.concat(F.lit("load_"), F.concat_ws("_", *by)).alias("step"),
        F.format_string("source %s has %d rows", F.col("source"), F.col("n_rows")).alias("reason"),
        F.coalesce("_s", F.lit("none")).alias("fallback_to"), F.col("source").alias("original_source"),
    )
    return kept, lost


def included(df: DataFrame, by: list[str], what: str) -> DataFrame:
    """Sorted list of the distinct values per group (experiments, energies)."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_set(what)).alias("included"))


def ordered_labels(spark: SparkSession, labels: list[str]) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, ord int")


def source_cells(
    sources: dict[str, DataFrame], cuts: dict, row_label: Column, col_label: Column, matrix_id: str = "all", share: float = 0.1
) -> DataFrame:
    """Cells of several tagged sources: appended, cut to ranges, errors completed by a share of the value, binned by labels
    printed from their numbers. Positions are left to ``index_labels``, after any aggregation."""
    u = tagged_union(sources).filter(range_cuts(cuts))
    u = u.withColumn("total_err", default_error(F.col("stat_err"), F.col("value"), share)).withColumn("matrix_id", F.lit(matrix_id))
    return binned_cells(u, row_label, col_label)


def evenly_spaced(df: DataFrame, by: list[str], idx: str, k: int) -> DataFrame:
    """Rows whose index is one of ``k`` evenly spaced positions of their group."""
    n = df.groupBy(*by).agg((F.max(idx) + 1).alias("_n"))
    pos = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n")).cast("int") - 1), lambda i: F.floor(
        i * (F.col("_n") - 1) / F.greatest(F.least(F.lit(k), F.col("_n")) - 1, F.lit(1))
    ).cast("int"))
    return df.join(n, by).filter(F.array_contains(pos, F.col(idx).cast("int"))).drop("_n")
