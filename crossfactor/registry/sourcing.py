"""Queries on sources, sinks, provenance and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossfactor.operators import checks, fit as fitops, presets, ranktest, report, validate, wrangle

from crossfactor.plans import analysis, cellsets
from crossfactor.plans.flagship import order_value_test
from crossfactor.registry import sqltext as s
from crossfactor.registry.fits import FIXED, _null_sql
from crossfactor.schemas import FILE_RECORD, PUBLISHED_RECORD, PUBLISHED_TABLE
from crossfactor.sources import files, observations, provenance, published


# --------------------------------------------------------- published tables
def _published(spark, sf):
    """One published table per (priority, nation), written as JSON text from the cells and parsed back."""
    c = cellsets.priority_cells(spark, sf)
    yr, none = F.element_at(F.split("col_label", "="), -1), F.lit(None).cast("double")
    err = F.array(
        F.struct(F.lit("stat").alias("label"), (F.col("total_err") / 1000).alias("symerror"), F.lit(None).cast("struct<plus:double,minus:double>").alias("asymerror")),
        F.struct(
            F.lit("sys,scale").alias("label"), F.lit(None).cast("double").alias("symerror"),
            F.struct((F.col("value") / 50000).alias("plus"), (-F.col("value") / 100000).alias("minus")).alias("asymerror"),
        ),
        F.struct(F.lit("other").alias("label"), F.lit(0.5).alias("symerror"), F.lit(None).cast("struct<plus:double,minus:double>").alias("asymerror")),
    )
    item = F.struct(
        "col_idx", F.struct(yr.alias("value"), none.alias("low"), none.alias("high")).alias("x"),
        F.struct(F.lit(None).cast("string").alias("value"), (F.col("col_idx") * 10.0).alias("low"), (F.col("col_idx") * 10.0 + 10.0).alias("high")).alias("b"),
        F.struct((F.col("value") / 1000).cast("string").alias("value"), err.alias("errors")).alias("y"),
    )
    t = c.groupBy("matrix_id", "row_label").agg(F.array_sort(F.collect_list(item)).alias("v"))
    var = lambda name, field: F.struct(F.struct(F.lit(name).alias("name")).alias("header"), F.col(f"v.{field}").alias("values"))
    rows = F.transform("v", lambda i: F.struct(F.array(i["x"]).alias("x"), F.array(i["y"]).alias("y")))
    json = F.to_json(
        F.struct(
            F.concat_ws(" ", F.lit("Table"), "row_label").alias("name"), F.concat(F.lit("signal strength "), F.col("matrix_id")).alias("description"),
            F.array(F.struct(F.lit("YEAR").alias("name")), F.struct(F.lit("PRICE").alias("name"))).alias("headers"), rows.alias("values"),
            F.array(var("YEAR", "x"), var("BIN", "b")).alias("independent_variables"), F.array(var("PRICE", "y")).alias("dependent_variables"),
        )
    )
    return t.select("matrix_id", "row_label", json.alias("json"))


def _tables(spark, sf):
    d = _published(spark, sf).select("matrix_id", "row_label", F.from_json("json", PUBLISHED_TABLE).alias("t"))
    return d.select("matrix_id", "row_label", "t.*")


def nested_errors(spark, sf):
    flat = published.flat_table(_tables(spark, sf), ["matrix_id", "row_label"])
    y = F.col("y")["PRICE"]
    return flat.select(
        "matrix_id", "row_label", F.col("x")["YEAR"]["centre"].alias("yr"), F.col("x")["BIN"]["centre"].alias("bin_centre"),
        F.round(F.log(y["value"]), 9).alias("log_value"), *[F.round(y[e], 7).alias(e) for e in ("stat_err", "sys_err", "total_err")],
    )


_SYS = "sqrt(power(1.5 * value / 100000, 2) + 0.25)"
NESTED = s.with_(s.CC) + f"""
SELECT matrix_id, row_label, CAST(string_split(col_label, '=')[-1] AS DOUBLE) AS yr, col_idx * 10.0::DOUBLE + 5 AS bin_centre, round(ln(value / 1000), 9) AS log_value,
 round(total_err / 1000, 7) AS stat_err, round({_SYS}, 7) AS sys_err, round(sqrt(power(total_err / 1000, 2) + {_SYS} * {_SYS}), 7) AS total_err FROM cc"""


def row_style_tables(spark, sf):
    long = published.row_style(_tables(spark, sf), ["matrix_id", "row_label"])
    return long.groupBy("matrix_id", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


ROW_STYLE = s.with_(s.CC) + """
SELECT matrix_id, 'YEAR' AS name, count(*) AS n, round(sum(CAST(string_split(col_label, '=')[-1] AS DOUBLE)), 4) AS total FROM cc GROUP BY 1
UNION ALL SELECT matrix_id, 'PRICE', count(*), round(sum(value / 1000), 4) FROM cc GROUP BY 1
UNION ALL SELECT matrix_id, 'PRICE_stat', count(*), round(sum(total_err / 1000), 4) FROM cc GROUP BY 1
UNION ALL SELECT matrix_id, 'PRICE_sys,scale', count(*), round(sum(1.5 * value / 100000), 4) FROM cc GROUP BY 1
UNION ALL SELECT matrix_id, 'PRICE_other', count(*), round(0.5 * count(*), 4) FROM cc GROUP BY 1"""


def first_xy(spark, sf):
    out = published.first_xy(_tables(spark, sf), ["matrix_id", "row_label"])
    return out.select("matrix_id", "row_label", "t", F.round(F.log("y"), 9).alias("log_y"), F.round("stat_err", 7).alias("stat_err"), "sys_err")


FIRST_XY = s.with_(s.CC) + """
SELECT matrix_id, row_label, CAST(string_split(col_label, '=')[-1] AS DOUBLE) AS t, round(ln(value / 1000), 9) AS log_y, round(total_err / 1000, 7) AS stat_err, 0.0::DOUBLE AS sys_err FROM cc"""


def _records(spark, sf):
    """One record per priority, as JSON text, holding its tables."""
    t = _tables(spark, sf).groupBy("matrix_id").agg(F.array_sort(F.collect_list(F.struct("name", "description", "headers", "values", "independent_variables", "dependent_variables"))).alias("tables"))
    json = F.to_json(F.struct(F.substring("matrix_id", 1, 1).cast("long").alias("record_id"), F.col("matrix_id").alias("title"), "tables"))
    return t.select(F.from_json(json, PUBLISHED_RECORD).alias("r")).select("r.*")


def record_tables(spark, sf):
    t = published.record_tables(_records(spark, sf))
    named = published.table_named(t, "Table NATION_3").select("record_id", F.size("values").alias("n_values"))
    names = published.table_names(t).groupBy("record_id").agg(F.count(F.lit(1)).alias("n_tables"), F.min("name").alias("first_name"))
    return names.join(named, "record_id")


RECORDS = s.with_(s.CC) + """
SELECT CAST(substr(matrix_id, 1, 1) AS BIGINT) AS record_id, count(DISTINCT row_label) AS n_tables, min('Table ' || row_label) AS first_name,
 CAST(count(*) FILTER (row_label = 'NATION_3') AS INTEGER) AS n_values FROM cc GROUP BY matrix_id"""


def usable_tables(spark, sf):
    """Every order line as a row-style table: roles found from header names, tables without the roles left out."""
    line = cellsets.table(spark, sf, "lineitem")
    v = lambda c: F.struct(F.col(c).cast("string").alias("value"))
    err = F.struct(
        F.lit("stat").alias("label"), (F.col("l_extendedprice") * 0.02).alias("symerror"),
        F.lit(None).cast("struct<plus:double,minus:double>").alias("asymerror"),
    )
    y = F.struct(F.col("l_extendedprice").cast("string").alias("value"), F.array(err).alias("errors"))
    names = lambda *n: F.array(*[F.struct(F.lit(x).alias("name")) for x in n])
    good, bad = names("Q**2", "BETA", "X(NAME=POMERON)", "SIG(C=REDUCED)"), names("A", "B", "C", "D")
    by = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    t = line.select(
        *by, F.array(F.struct(F.array(v("l_quantity"), v("l_discount"), v("l_tax")).alias("x"), F.array(y).alias("y"))).alias("values"),
        F.when(F.col("l_suppkey") % 4 == 0, bad).otherwise(good).alias("headers"),
    )
    out = published.usable_tables(t, by, ["stat", "sys"])
    return out.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("Q2"), 2).alias("q2"), F.round(F.sum("beta"), 4).alias("beta"), F.round(F.sum("xP"), 4).alias("xp"), F.round(F.sum("total_err"), 3).alias("err")
    )


USABLE = """SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q2, round(sum(l_discount), 4) AS beta, round(sum(l_tax), 4) AS xp, round(sum(0.02 * l_extendedprice), 3) AS err
FROM lineitem
WHERE l_suppkey % 4 <> 0 AND l_extendedprice > 0 GROUP BY l_suppkey"""


def curve_columns(spark, sf):
    """A curve table with loose headers and text numbers, normalised."""
    cv = cellsets.event_curves(spark, sf)
    loose = cv.select(F.col("t").cast("string").alias("|t| [GeV2]"), F.when(F.col("t") == 7, "n/a").otherwise(F.col("y").cast("string")).alias("dsigma/dt"), F.col("total_err").alias("stat_uncertainty"))
    out = wrangle.normalise_curve(loose)
    return out.groupBy("t").agg(
        F.count("dsigma_dt").alias("n_values"), F.round(F.sum("dsigma_dt"), 6).alias("total"), F.round(F.sum("total_err"), 6).alias("err")
    )


CURVE_COLS = s.with_(s.CV) + """
SELECT t, count(*) FILTER (t <> 7) AS n_values, round(sum(y) FILTER (t <> 7), 6) AS total, round(sum(total_err), 6) AS err FROM cv GROUP BY t"""


def histogram_source(spark, sf):
    """Quantity histogram per return flag: centre, content and root of the variance."""
    line = cellsets.table(spark, sf, "lineitem")
    h = line.groupBy(F.col("l_returnflag").alias("matrix_id"), (F.floor(F.col("l_quantity") / 4) * 4.0 + 2.0).alias("centre")).agg(
        F.count(F.lit(1)).cast("double").alias("value"), F.count(F.lit(1)).cast("double").alias("variance")
    )
    return observations.histogram_curve(h).select("matrix_id", "t", "y", F.round("total_err", 9).alias("total_err"))


HISTOGRAM = """WITH h AS (SELECT l_returnflag AS matrix_id, floor(l_quantity / 4) * 4.0 + 2.0 AS t, CAST(count(*) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2)
SELECT matrix_id, CAST(t AS DOUBLE) AS t, y, round(sqrt(y), 9) AS total_err FROM h QUALIFY count(*) OVER (PARTITION BY matrix_id) > 10"""


def observation_json(spark, sf):
    """Matrices as JSON documents with a covariance of their columns, parsed back."""
    c = cellsets.priority_cells(spark, sf).withColumn("seq", F.row_number().over(_order()) - 1)
    obs = observations.complete(c)
    e = c.groupBy("matrix_id", "col_idx").agg(F.max("total_err").alias("e"))
    a = e.select("matrix_id", F.col("col_idx").cast("long").alias("i"), F.col("e").alias("ei"))
    b = e.select("matrix_id", F.col("col_idx").cast("long").alias("j"), F.col("e").alias("ej"))
    rho = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.1)
    cov = a.join(b, "matrix_id").select("matrix_id", "i", "j", (rho * F.col("ei") * F.col("ej")).alias("c"))
    obs2, cov2 = observations.parse_documents(observations.documents_json(obs, cov))
    n = obs2.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.log("value")), 6).alias("log_total"), F.max("seq").alias("last_seq"))
    m = cov2.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n_cov"), F.round(F.sum(F.col("c") / 1e6), 4).alias("cov_total"))
    return n.join(m, "matrix_id")


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("matrix_id").orderBy("row_idx", "col_idx")


OBS_JSON = s.with_(s.CC) + """, a AS (SELECT matrix_id, count(*) AS n, round(sum(ln(value)), 6) AS log_total, count(*) - 1 AS last_seq FROM cc GROUP BY 1),
e AS (SELECT matrix_id, col_idx, max(total_err) AS e FROM cc GROUP BY 1, 2),
b AS (SELECT x.matrix_id, count(*) AS n_cov, round(sum(CASE WHEN x.col_idx = y.col_idx THEN 1.0 ELSE 0.1 END * x.e * y.e / 1e6), 4) AS cov_total FROM e x JOIN e y USING (matrix_id) GROUP BY 1)
SELECT * FROM a JOIN b USING (matrix_id)"""


def observation_roundtrip(spark, sf):
    """Observations through the completed schema: defaults for missing errors and labels."""
    line = cellsets.table(spark, sf, "lineitem")
    obs = observations.complete(
        line.select(
            F.col("l_returnflag").alias("matrix_id"), F.col("l_orderkey").alias("seq"), F.col("l_linestatus").alias("row_label"),
            F.col("l_linenumber").alias("col_idx"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("stat_err"),
        )
    )
    return obs.groupBy("matrix_id", "row_label", "col_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("stat_err"), 4).alias("stat"), F.sum("total_err").alias("tot"))


ROUNDTRIP = """SELECT l_returnflag AS matrix_id, l_linestatus AS row_label, '' AS col_label, count(*) AS n, round(sum(CASE WHEN l_tax > 0.04 THEN l_tax ELSE 0 END), 4) AS stat, 0.0::DOUBLE AS tot
FROM lineitem GROUP BY 1, 2"""


# --------------------------------------------------------------------- files
def _page_files(spark, sf):
    p = cellsets.table(spark, sf, "pages")
    return files.content_manifest(p, F.concat(F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))


def manifest_sha256(spark, sf):
    """SHA-256 and size of every page as a file."""
    return _page_files(spark, sf).select("file", "sha256", "size_bytes")


MANIFEST = "SELECT page_id || '.html' AS file, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes FROM pages"


def checksum_verify(spark, sf):
    """Every page against a published sum: of its text in two notations, of its address (wrong), one kind that is not
    recomputed, and every tenth under a name that is not there."""
    p = cellsets.table(spark, sf, "pages")
    kind = F.col("page_id") % 4
    wanted = (
        F.when(kind == 0, F.concat(F.lit("MD5:"), F.md5("html"))).when(kind == 1, F.sha2("html", 256))
        .when(kind == 2, F.concat(F.lit("md5:"), F.md5("url"))).otherwise(F.lit("adler32:0"))
    )
    name = F.when(F.col("page_id") % 10 == 9, F.lit("lost-")).otherwise(F.lit(""))
    e = p.select(F.concat(name, F.col("page_id").cast("string"), F.lit(".html")).alias("file"), wanted.alias("checksum"))
    return files.verify_checksums(_page_files(spark, sf), e).groupBy("algorithm", "status").agg(F.count(F.lit(1)).alias("n"))


CHECKSUMS = """SELECT CASE page_id % 4 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha256' WHEN 2 THEN 'md5' ELSE 'adler32' END AS algorithm,
 CASE WHEN page_id % 10 = 9 THEN 'missing' WHEN page_id % 4 = 3 THEN 'skipped' WHEN page_id % 4 = 2 AND md5(url) <> md5(html) THEN 'mismatch' ELSE 'ok' END AS status,
 count(*) AS n FROM pages GROUP BY 1, 2"""


def page_records(spark, sf):
    """Every page as a portal record with one file: extension filter and total size per host."""
    p = cellsets.table(spark, sf, "pages")
    f = F.struct(
        F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("key"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.length("html").cast("long").alias("size"), F.concat(F.lit("md5:"), F.md5("html")).alias("checksum"), F.col("url").alias("uri"), F.lit("HTML").alias("type"),
    )
    host = F.regexp_extract("url", "://([^/]+)", 1)
    rec = p.select(F.concat_ws("#", host, F.col("page_id").cast("string")).alias("id"), F.array(f).alias("files"))
    json = F.to_json(F.struct("id", F.struct("files", F.struct(F.array(F.lit("web")).alias("primary"), F.array(F.lit("raw")).alias("secondary")).alias("categories")).alias("metadata")))
    parsed = rec.select(F.from_json(json, FILE_RECORD).alias("r")).select("r.*")
    all_files = files.record_files(parsed).withColumn("record_id", F.substring_index("record_id", "#", 1))
    a = files.total_size(files.files_of_type(all_files, "html"), ["record_id"])
    b = files.files_with_extension(all_files, "html").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_html"))
    return a.join(b, "record_id", "left").fillna({"n_html": 0})


PAGES = """WITH p AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS record_id, CASE WHEN page_id % 2 = 0 THEN url ELSE page_id || '.html' END AS file, length(html) AS size FROM pages)
SELECT record_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (ends_with(lower(file), '.html')) AS n_html FROM p GROUP BY 1"""


# ---------------------------------------------------------------- provenance
def provenance_flags(spark, sf):
    """Provenance of the priority matrices from a source race, its cuts and its fallbacks."""
    o = cellsets.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("matrix_id"), F.year("o_orderdate").alias("priority"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("source"), "o_totalprice"
    )
    _, lost = wrangle.source_priority(o, ["matrix_id"], 430)
    cut = wrangle.cut_counted(o, {"o_totalprice": (100000.0, 400000.0)}, ["matrix_id"]).withColumn("name", F.lit("price_cut"))
    src = o.select("matrix_id", F.concat(F.lit("10.1/"), F.col("source")).alias("doi"), F.col("source").alias("identifier")).distinct()
    prov = provenance.build(o, F.when(F.col("matrix_id") == "5-LOW", "placeholder").otherwise("api"), "orders", src, cut, lost, stamp=False)
    flags = provenance.flags(prov)
    warn = provenance.warnings(prov).groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n_warnings"))
    dois = provenance.distinct_dois(prov).agg(F.count(F.lit(1)).alias("n_dois"))
    out = flags.join(warn, "matrix_id", "left").withColumn("n_dois", dois.scalar())
    return out.select(
        "matrix_id", "origin", "has_fallbacks", "is_placeholder", F.size("sources").cast("long").alias("n_sources"),
        F.col("selection_filters")[0]["n_before"].alias("n_before"), F.col("selection_filters")[0]["n_after"].alias("n_after"), F.coalesce("n_warnings", F.lit(0)).cast("long").alias("n_warnings"), "n_dois",
    )


PROVENANCE = """WITH c AS (SELECT o_orderpriority AS matrix_id, year(o_orderdate) AS p, count(*) AS n FROM orders GROUP BY 1, 2),
w AS (SELECT matrix_id, min(p) AS wp FROM c WHERE n > 430 GROUP BY 1),
l AS (SELECT matrix_id, count(*) FILTER (wp IS NULL OR p < wp) AS lost, count(*) AS n_sources FROM c LEFT JOIN w USING (matrix_id) GROUP BY 1),
o AS (SELECT o_orderpriority AS matrix_id, count(*) AS n_before, count(*) FILTER (o_totalprice >= 100000 AND o_totalprice <= 400000) AS n_after FROM orders GROUP BY 1)
SELECT matrix_id, CASE WHEN matrix_id = '5-LOW' THEN 'placeholder' ELSE 'api' END AS origin, lost > 0 AS has_fallbacks, matrix_id = '5-LOW' AS is_placeholder, n_sources, n_before, n_after,
 lost + CASE WHEN matrix_id = '5-LOW' THEN 1 ELSE 0 END AS n_warnings, (SELECT count(DISTINCT p) FROM c) AS n_dois FROM l JOIN o USING (matrix_id)"""


def content_hash(spark, sf):
    """Short content hash of every order's result row."""
    o = cellsets.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    return validate.result_hash(o, ["o_orderkey"])


HASH = """SELECT o_orderkey, substr(sha256('{"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '","o_custkey":' || o_custkey || '}'), 1, 16) AS hash
FROM orders"""


def reproducible(spark, sf):
    """The null distribution drawn twice, the second time from cells in another layout, compared row by row, with the
    first run's total; every third replicate of the second run is spoilt."""
    c = cellsets.order_value_cells(spark, sf)
    runs = []
    for cells in (c, c.repartition(5, "col_idx")):
        t = fitops.fit(cells, FIXED, unique=True)
        runs.append(ranktest.null_distribution(cells, t, 20, 42, FIXED).select("matrix_id", "replicate", "lambda_stat"))
    spoilt = runs[1].withColumn("lambda_stat", F.col("lambda_stat") + F.when(F.col("replicate") % 3 == 0, 1.0).otherwise(0.0))
    d = validate.compare_runs(runs[0], spoilt, ["matrix_id", "replicate"], 1e-9, 1e-9)
    total = runs[0].groupBy("matrix_id").agg(F.round(F.sum("lambda_stat"), 3).alias("total"))
    return validate.reproducible(d, ["matrix_id"]).join(total, "matrix_id")


REPRODUCIBLE = _null_sql(20) + """
SELECT matrix_id, count(*) AS n_rows, count(*) FILTER (replicate % 3 = 0) AS n_different, count(*) FILTER (replicate % 3 = 0) = 0 AS passed,
 round(sum(lambda_stat), 3) AS total FROM b_lam GROUP BY matrix_id"""


# ------------------------------------------------------------------- reports
def _result(spark, sf):
    cells = cellsets.priority_cells(spark, sf)
    t = fitops.fit(cells, FIXED, unique=True)
    p = ranktest.p_values(t.summary, ranktest.null_distribution(cells, t, 20, 42, FIXED))
    # the exact interval has queries of its own; here a band that SQL can follow
    p = p.withColumn("p_lower", F.col("p_value") / 2).withColumn("p_upper", F.least(F.lit(1.0), F.col("p_value") * 2))
    return t, t.summary.drop("replicate").join(p, "matrix_id")


def summary_table(spark, sf):
    return report.summary_table(_result(spark, sf)[1])


_LAM = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6), s.lambdas(["matrix_id"]))
SUMMARY = s.with_(
    s.CC, s.als("cc", ["matrix_id"], 2, 6), s.lambdas(["matrix_id"]), s.pseudo("cc", ["matrix_id"], 20, 42),
    s.als("ps", ["matrix_id", "replicate"], 2, 6, p="b"), s.lambdas(["matrix_id", "replicate"], p="b"),
) + """, p AS (SELECT matrix_id, (count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) + 1.0) / (count(*) + 1.0) AS p FROM b_lam JOIN f_lam USING (matrix_id) GROUP BY matrix_id)
SELECT matrix_id AS dataset, n_rows || '×' || n_cols AS matrix_size, n_obs, printf('%.2f', chi2_rank1) AS chi2_r1, printf('%.2f', chi2_rank2) AS chi2_r2,
 printf('%.2f', lambda_stat) AS lambda, printf('%.4f', p) AS p_value, '[' || printf('%.4f', p / 2) || ', ' || printf('%.4f', least(1.0, p * 2)) || ']' AS ci95,
 CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM f_lam JOIN p USING (matrix_id)"""


def chi2_table(spark, sf):
    out = report.chi2_table(_result(spark, sf)[1])
    return out.select("dataset", "ndof_rank1", "ndof_rank2", *[F.round(c, 5).alias(c) for c in ("chi2_rank1", "chi2_ndof_rank1", "chi2_rank2", "chi2_ndof_rank2", "delta_chi2")])


CHI2 = _LAM + """, n AS (SELECT *, n_obs - (n_rows + n_cols - 1) AS a, n_obs - 2 * (n_rows + n_cols) AS b FROM f_lam)
SELECT matrix_id AS dataset, a AS ndof_rank1, b AS ndof_rank2, round(chi2_rank1, 5) AS chi2_rank1, round(chi2_rank1 / greatest(1, a), 5) AS chi2_ndof_rank1, round(chi2_rank2, 5) AS chi2_rank2,
 round(chi2_rank2 / greatest(1, b), 5) AS chi2_ndof_rank2, round(lambda_stat, 5) AS delta_chi2 FROM n"""


def check_table(spark, sf):
    return report.check_table(checks.coverage(cellsets.priority_cells(spark, sf)))


CHECK = s.with_(s.CC) + """, a AS (SELECT matrix_id, count(*) AS n, count(DISTINCT row_idx) AS r, count(DISTINCT col_idx) AS c FROM cc GROUP BY matrix_id)
SELECT matrix_id AS dataset, 'data_coverage' AS check, CASE WHEN n >= 20 THEN '✓' ELSE '✗' END AS passed, printf('%d observations, %dx%d matrix', n, r, c) AS message FROM a
UNION ALL SELECT matrix_id, 'matrix_completeness', CASE WHEN n / (r * c) > 0.5 THEN '✓' ELSE '✗' END, printf('%.4f of all cells are filled', n / (r * c)) FROM a
UNION ALL SELECT matrix_id, 'row_coverage', CASE WHEN r >= 2 THEN '✓' ELSE '✗' END, printf('%d rows with data', r) FROM a"""


def overall_checks(spark, sf):
    cv = cellsets.event_curves(spark, sf)
    frames = [checks.window_coverage(cv, 1.0, 25.0), checks.bounds_check(cv, ["matrix_id"], {"y": (0.0, 1000.0), "t": (0.0, 29.0)})]
    return checks.overall(checks.run_checks(frames), ["matrix_id"])


OVERALL = s.with_(s.CV) + """, a AS (SELECT matrix_id, (min(t) <= 1 AND max(t) >= 25)::INT AS w, (min(y) > 0 AND max(y) < 1000 AND min(t) > 0 AND max(t) < 29)::INT AS b FROM cv GROUP BY 1)
SELECT matrix_id, CAST(2 AS BIGINT) AS n_checks, CAST(w + b AS BIGINT) AS n_passed, w + b = 2 AS all_passed FROM a"""


def verdict_counts(spark, sf):
    """Verdicts of every supplier's matrix from its own fit quality, and how many there are of each."""
    t = fitops.fit(cellsets.supplier_cells(spark, sf), FIXED, unique=True)
    r = t.summary.withColumn("p_value", F.when(F.col("lambda_stat") > 30, 0.01).otherwise(0.5)).withColumn("converged_rank1", F.lit(True)).withColumn("converged_rank2", F.lit(True))
    return report.verdict_counts(ranktest.verdict(r))


VERDICTS = s.with_(s.CS, s.als("cs", ["matrix_id"], 2, 6), s.lambdas(["matrix_id"])) + """
SELECT CASE WHEN n_obs - 2 * (n_rows + n_cols) <= 0 OR n_obs - (n_rows + n_cols - 1) <= 0 OR lambda_stat < -1 THEN 'INCONCLUSIVE' WHEN lambda_stat > 30 THEN 'REJECTED' ELSE 'NOT_REJECTED' END AS verdict,
 count(*) AS n, count(*) FILTER (lambda_stat > 30) AS n_significant FROM f_lam GROUP BY 1"""


def first_rows(spark, sf):
    c = cellsets.priority_cells(spark, sf)
    return report.first_rows(c, ["matrix_id"], [F.desc("n_obs"), F.col("row_idx"), F.col("col_idx")]).select("matrix_id", "row_idx", "col_idx", "n_obs", "place")


FIRST = s.with_(s.CC) + """
SELECT matrix_id, row_idx, col_idx, n_obs, CAST(row_number() OVER (PARTITION BY matrix_id ORDER BY n_obs DESC, row_idx, col_idx) AS INTEGER) AS place FROM cc
QUALIFY row_number() OVER (PARTITION BY matrix_id ORDER BY n_obs DESC, row_idx, col_idx) <= 10"""


def shape_over_factor(spark, sf):
    c = cellsets.priority_cells(spark, sf)
    t, _ = _result(spark, sf)
    out = report.shapes_over_row_factor(c, t.rows)
    return out.select("matrix_id", "row_idx", "col_idx", F.round("shape", 6).alias("shape"), F.round("shape_err", 6).alias("shape_err"))


SHAPES = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6, 1)) + """
SELECT matrix_id, row_idx, col_idx, round(value / (u * s), 6) AS shape, round(total_err / abs(u * s), 6) AS shape_err FROM cc JOIN f_u USING (matrix_id, row_idx) JOIN f_s USING (matrix_id)"""


def factor_curves(spark, sf):
    t, _ = _result(spark, sf)
    out = report.factor_curves(t.rows.withColumn("u", F.col("u") / 1000), t.cols)
    return out.groupBy("matrix_id", "axis").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 5).alias("total"))


FACTOR_CURVES = s.with_(s.CC, s.als("cc", ["matrix_id"], 2, 6, 1)) + """
SELECT matrix_id, 'col' AS axis, count(*) AS n, round(sum(v), 5) AS total FROM f_v GROUP BY 1
UNION ALL SELECT matrix_id, 'row', count(*), round(sum(u * s / 1000), 5) FROM f_u JOIN f_s USING (matrix_id) GROUP BY 1"""


def preset_catalogue(spark, sf):
    """Presets written to JSON, read back and matched with the cells they keep."""
    from crossfactor.registry.modes import _SLICES

    table = presets.preset_from_json(presets.preset_json(presets.preset_table(spark, _SLICES)))
    kept = presets.apply_presets(cellsets.order_value_cells(spark, sf), _SLICES).groupBy("preset").agg(F.count(F.lit(1)).alias("n_cells"))
    return table.join(kept, "preset", "left").select("preset", "ord", "sweep_type", "is_fast", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


CATALOGUE = s.with_(s.CA) + """
SELECT 'baseline' AS preset, 0 AS ord, 'baseline' AS sweep_type, TRUE AS is_fast, count(*) AS n_cells FROM ca
UNION ALL SELECT 'loo_building', 1, 'leave_one_out', FALSE, count(*) FROM ca WHERE col_label <> 'BUILDING'
UNION ALL SELECT 'first_rows', 2, 'data_subset', FALSE, count(*) FROM ca WHERE row_label IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4')
UNION ALL SELECT 'well_filled', 3, 'kinematic_cut', FALSE, count(*) FROM ca WHERE n_obs >= 100"""


# ------------------------------------------------------------------ end to end
def baseline_analysis(spark, sf):
    """Every priority matrix through the whole baseline test with the default stopping rule."""
    out = analysis.baseline(cellsets.priority_cells(spark, sf), n_bootstrap=50, injection_bootstrap=20)
    n = checks.overall(out.checks, ["matrix_id"])
    return out.result.select("matrix_id", "n_obs", "chi2_rank1", "chi2_rank2", "lambda_stat", "p_value", "p_lower", "p_upper", "verdict").join(n, "matrix_id")


def mode_analysis(spark, sf):
    """The order-value matrix through the whole mode analysis."""
    from crossfactor.registry.modes import _SLICES

    out = analysis.mode_analysis(cellsets.order_value_cells(spark, sf), _SLICES, n_bootstrap=50, n_starts=3, n_stability=20)
    return out.result.select("matrix_id", "p_local", "p_global", "gini", "normalized_entropy", "stability_grade", "mean_replication_score", "mode_verdict", "reasons")


def flagship(spark, sf):
    """The order-value test end to end, gates and reason included; the rounds are fixed, so the first gate speaks."""
    out = order_value_test(spark, sf, n_bootstrap=20, opt=FIXED)
    return out.select(
        "matrix_id", "n_obs", F.round("chi2_rank1", 4).alias("chi2_rank1"), F.round("chi2_rank2", 4).alias("chi2_rank2"), "k", "n_used", "n_failed",
        F.round("p_value", 9).alias("p_value"), "is_significant", "verdict", "verdict_reason",
    )


FLAGSHIP = _null_sql(20) + """, p AS (SELECT matrix_id, count(*) FILTER (b_lam.lambda_stat >= f_lam.lambda_stat) AS k, count(*) AS n FROM b_lam JOIN f_lam USING (matrix_id) GROUP BY matrix_id)
SELECT matrix_id, n_obs, round(chi2_rank1, 4) AS chi2_rank1, round(chi2_rank2, 4) AS chi2_rank2, k, n AS n_used, CAST(0 AS BIGINT) AS n_failed,
 round((k + 1.0) / (n + 1.0), 9) AS p_value, (k + 1.0) / (n + 1.0) < 0.05 AS is_significant, 'INCONCLUSIVE' AS verdict, 'one component: round limit reached' AS verdict_reason
FROM f_lam JOIN p USING (matrix_id)"""


ENTRIES = {
    "nested_errors": (nested_errors, NESTED),
    "row_style_tables": (row_style_tables, ROW_STYLE),
    "first_xy": (first_xy, FIRST_XY),
    "record_tables": (record_tables, RECORDS),
    "usable_tables": (usable_tables, USABLE),
    "curve_columns": (curve_columns, CURVE_COLS),
    "histogram_source": (histogram_source, HISTOGRAM),
    "observation_json": (observation_json, OBS_JSON),
    "observation_roundtrip": (observation_roundtrip, ROUNDTRIP),
    "manifest_sha256": (manifest_sha256, MANIFEST),
    "checksum_verify": (checksum_verify, CHECKSUMS),
    "page_records": (page_records, PAGES),
    "provenance_flags": (provenance_flags, PROVENANCE),
    "content_hash": (content_hash, HASH),
    "reproducible": (reproducible, REPRODUCIBLE),
    "summary_table": (summary_table, SUMMARY),
    "chi2_table": (chi2_table, CHI2),
    "check_table": (check_table, CHECK),
    "overall_checks": (overall_checks, OVERALL),
    "verdict_counts": (verdict_counts, VERDICTS),
    "first_rows": (first_rows, FIRST),
    "shape_over_factor": (shape_over_factor, SHAPES),
    "factor_curves": (factor_curves, FACTOR_CURVES),
    "preset_catalogue": (preset_catalogue, CATALOGUE),
    "baseline_analysis": (baseline_analysis, None),
    "mode_analysis": (mode_analysis, None),
    "flagship": (flagship, FLAGSHIP),
}
