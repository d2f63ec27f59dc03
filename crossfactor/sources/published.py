"""Published tables in JSON, variable style and row style, as flat rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crossfactor.schemas import PUBLISHED_RECORD, PUBLISHED_TABLE
from crossfactor.session import cut


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PUBLISHED_RECORD).option("multiLine", True).json(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PUBLISHED_TABLE).option("multiLine", True).json(path)


def record_tables(records: DataFrame) -> DataFrame:
    """Record to its tables: ``data_tables`` where present, else ``tables``."""
    chosen = F.coalesce(F.when(F.size("data_tables") > 0, F.col("data_tables")), F.col("tables"))
    return records.select("record_id", F.posexplode(chosen).alias("table_no", "t")).select("record_id", "table_no", "t.*")


def record_resources(records: DataFrame) -> DataFrame:
    return records.select("record_id", F.explode("resources").alias("r")).select("record_id", "r.*")


def table_names(tables: DataFrame) -> DataFrame:
    return tables.select("record_id", "table_no", "name")


def table_named(tables: DataFrame, name: str) -> DataFrame:
    return tables.filter(F.col("name") == name)


# --------------------------------------------------------------------- errors
def _size(e: Column) -> Column:
    """Magnitude of an error: symmetric, or the mean of the absolute plus and minus."""
    asym = e["asymerror"]
    both = (F.abs(F.coalesce(asym["plus"], F.lit(0.0))) + F.abs(F.coalesce(asym["minus"], F.lit(0.0)))) / 2
    return F.when(asym.isNotNull(), both).otherwise(F.abs(F.coalesce(e["symerror"], F.lit(0.0))))


def split_errors(errors: Column) -> tuple[Column, Column, Column]:
    """Statistical, systematic and total error of one value. Errors that are neither join the systematic one in quadrature."""
    label = lambda e: F.lower(F.coalesce(e["label"], F.lit("")))
    start = F.struct(F.lit(0.0).alias("stat"), F.lit(0.0).alias("sys"))

    def step(acc: Column, e: Column) -> Column:
        x = _size(e)
        is_stat, is_sys = label(e).contains("stat"), label(e).contains("sys")
        return F.struct(
            F.when(is_stat, x).otherwise(acc["stat"]).alias("stat"),
            F.when(is_stat, acc["sys"]).when(is_sys, x).otherwise(F.hypot(acc["sys"], x)).alias("sys"),
        )

    both = F.aggregate(F.coalesce(errors, F.array()), start, step)
    return both["stat"], both["sys"], F.hypot(both["stat"], both["sys"])


# ------------------------------------------------------------- variable style
def variable_rows(tables: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Independent variables ``(by, pos, name, centre, low, high)`` and dependent ones ``(by, pos, name, value, *_err)``."""
    number = lambda c: c.try_cast("double")

    def values(column: str, default: str) -> DataFrame:
        v = tables.select(*by, F.posexplode(column).alias("var_no", "v"))
        name = F.coalesce(F.col("v.header.name"), F.concat(F.lit(default), F.col("var_no")))
        return v.select(*by, "var_no", name.alias("name"), F.posexplode("v.values").alias("pos", "x"))

    x = values("independent_variables", "x")
    point = number(F.col("x.value"))
    centre = F.coalesce(point, (F.col("x.low") + F.col("x.high")) / 2)
    ind = x.filter(centre.isNotNull()).select(
        *by, "var_no", "pos", "name", centre.alias("centre"), F.coalesce("x.low", point).alias("low"), F.coalesce("x.high", point).alias("high")
    )
    y = values("dependent_variables", "y")
    stat, sys, tot = split_errors(F.col("x.errors"))
    dep = y.select(*by, "var_no", "pos", "name", number(F.col("x.value")).alias("value"), stat.alias("stat_err"), sys.alias("sys_err"), tot.alias("total_err"))
    return ind, dep


def flat_table(tables: DataFrame, by: list[str]) -> DataFrame:
    """One row per (table, position) with every independent value and every dependent value as maps by name.

    Both lists sit in the same row, so positions are exploded once and nothing is grouped or joined.
    """
    number = lambda c: c.try_cast("double")
    longest = lambda c: F.coalesce(F.array_max(F.transform(c, lambda v: F.size(v["values"]))), F.lit(0))
    n = F.least(longest("independent_variables"), longest("dependent_variables"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    t = tables.select(*by, "independent_variables", "dependent_variables", F.explode(places).alias("pos"))
    name = lambda v, i, d: F.coalesce(v["header"]["name"], F.concat(F.lit(d), i.cast("string")))
    at = lambda v: F.get(v["values"], F.col("pos"))

    def x_entry(v: Column, i: Column) -> Column:
        point = number(at(v)["value"])
        centre = F.coalesce(point, (at(v)["low"] + at(v)["high"]) / 2)
        low, high = F.coalesce(at(v)["low"], point), F.coalesce(at(v)["high"], point)
        return F.when(centre.isNotNull(), F.struct(name(v, i, "x").alias("name"), F.struct(centre.alias("centre"), low.alias("low"), high.alias("high")).alias("v")))

    def y_entry(v: Column, i: Column) -> Column:
        stat, sys, tot = split_errors(at(v)["errors"])
        got = F.struct(number(at(v)["value"]).alias("value"), stat.alias("stat_err"), sys.alias("sys_err"), tot.alias("total_err"))
        return F.when(at(v).isNotNull(), F.struct(name(v, i, "y").alias("name"), got.alias("v")))

    maps = lambda c, entry: F.map_from_entries(F.array_compact(F.transform(c, entry)))
    out = t.select(*by, "pos", maps("independent_variables", x_entry).alias("x"), maps("dependent_variables", y_entry).alias("y"))
    return out.filter((F.size("x") > 0) & (F.size("y") > 0))


# ------------------------------------------------------------------ row style
def row_style(tables: DataFrame, by: list[str]) -> DataFrame:
    """Row-style tables as long rows ``(by, pos, name, value)``: x columns, y columns and ``<y>_<label>`` errors.

    Headers are split by how many x entries the rows carry, so tables with several x columns keep their names.
    """
    number = lambda c: c.try_cast("double")
    r = tables.select(*by, "headers", F.posexplode("values").alias("pos", "v"))
    nx = F.size("v.x")
    header = lambda i, d: F.coalesce(F.try_element_at(F.col("headers.name"), i + 1), F.concat(F.lit(d), (i).cast("string")))
    xs = r.select(*by, "pos", F.col("headers"), F.posexplode("v.x").alias("i", "c")).select(
        *by, "pos", header(F.col("i"), "x").alias("name"), number(F.col("c.value")).alias("value")
    )
    y = r.select(*by, "pos", "headers", nx.alias("nx"), F.posexplode("v.y").alias("i", "c"))
    y = y.select(*by, "pos", F.coalesce(F.try_element_at(F.col("headers.name"), F.col("nx") + F.col("i") + 1), F.concat(F.lit("y"), F.col("i"))).alias("name"), "c")
    vals = y.select(*by, "pos", "name", number(F.col("c.value")).alias("value"))
    errs = y.select(*by, "pos", "name", F.explode("c.errors").alias("e")).select(
        *by, "pos", F.concat(F.col("name"), F.lit("_"), F.coalesce("e.label", F.lit("err"))).alias("name"), _size(F.col("e")).alias("value")
    )
    return xs.unionByName(vals).unionByName(errs)


def row_style_wide(tables: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """The same as columns, for known names."""
    return row_style(tables, by).groupBy(*by, "pos").pivot("name", names).agg(F.first("value"))


def header_sets(tables: DataFrame, by: list[str]) -> DataFrame:
    """Distinct header lists and which tables share them; few, whatever the number of tables."""
    return tables.groupBy(F.col("headers.name").alias("names")).agg(F.count(F.lit(1)).alias("n_tables"))


def first_xy(tables: DataFrame, by: list[str]) -> DataFrame:
    """Row style with the first x and the first y only; errors labelled exactly 'stat' and 'sys'."""
    r = tables.select(*by, F.posexplode("values").alias("pos", "v"))
    y = F.col("v.y")[0]
    err = lambda name: F.aggregate(
        F.filter(F.coalesce(y["errors"], F.array()), lambda e: e["label"] == name), F.lit(0.0), lambda acc, e: _size(e)
    )
    out = r.select(
        *by, "pos", F.col("v.x")[0]["value"].try_cast("double").alias("t"), y["value"].try_cast("double").alias("y"), err("stat").alias("stat_err"), err("sys").alias("sys_err")
    )
    return out.withColumn("total_err", F.hypot("stat_err", "sys_err"))


#: Distinct header lists that may travel to every task.
FEW_LISTS = 20_000
_ROLES = ["Q2", "beta", "xP", "value", "stat_err", "sys_err", "total_err"]


def header_roles(names: Column, labels: list[str]) -> Column:
    """Where each role stands in a header list: ``role -> (pos, label)``, the label naming an error of that column; null
    when a required role is missing. Lists repeat, so each is resolved once a task. Not deterministic to the optimizer, so
    that filters on the outcome stay above it."""

    @F.pandas_udf("array<struct<role:string,pos:int,label:string>>")
    def resolve(lists: pd.Series) -> pd.Series:
        from crossfactor.operators.wrangle import resolve_roles

        known: dict[tuple, list | None] = {}

        def one(names) -> list | None:
            names = tuple(names) if names is not None else ()
            if names not in known:
                place = {n: (i, None) for i, n in reversed(list(enumerate(names))) if n}
                place |= {f"{n}_{e}": (i, e) for n, (i, _) in list(place.items()) for e in labels}
                try:
                    known[names] = [(role, *place[c]) for role, c in resolve_roles(list(place)).items()]
                except ValueError:
                    known[names] = None
            return known[names]

        return pd.Series([one(x) for x in lists], dtype=object)

    return F.map_from_entries(F.transform(resolve.asNondeterministic()(names), lambda r: F.struct(r["role"], F.struct(r["pos"], r["label"]))))


def _with_roles(tables: DataFrame, keep_names: list[str]) -> DataFrame:
    """Tables with ``_roles``, null where a required role is missing. Roles are found once for each distinct header list;
    the lists come from a pass over the header column alone, are stored and counted, and meet the tables again by equality:
    broadcast up to ``FEW_LISTS``, so that tables are not shuffled by the few lists they share, and beyond that as Spark
    sees fit."""
    lists = tables.select(F.coalesce("headers.name", F.array()).alias("_names")).distinct()
    roles = header_roles(F.col("_names"), keep_names)
    lists = lists.withColumn("_r", roles).select(
        F.col("_names"), F.when(F.col("_r").isNotNull(), F.struct(*[F.col("_r")[r].alias(r) for r in _ROLES])).alias("_roles")
    )
    lists = cut(lists)
    if lists.count() <= FEW_LISTS:
        lists = F.broadcast(lists)
    return tables.withColumn("_names", F.coalesce("headers.name", F.array())).join(lists, "_names")


def usable_tables(tables: DataFrame, by: list[str], keep_names: list[str]) -> DataFrame:
    """All tables of the records whose columns can play the required roles, mapped and appended: values are read by their
    position, and no table row goes through Python. ``unusable_tables`` lists the others.

    The roles are read before the rows are exploded, so that no later filter evaluates them again.
    """

    def value(v: Column, role: str) -> Column:
        pos, label = F.col("_roles")[role]["pos"], F.col("_roles")[role]["label"]
        own = F.get(v["y"], pos - F.size(v["x"]))
        error = F.get(F.transform(F.filter(own["errors"], lambda e: e["label"] == label), _size), F.lit(0))
        plain = F.when(pos < F.size(v["x"]), F.get(v["x"], pos)["value"]).otherwise(own["value"]).try_cast("double")
        return F.when(label.isNotNull(), error).otherwise(plain).alias(role)

    t = _with_roles(tables, keep_names).filter(F.col("_roles").isNotNull())
    rows = F.transform("values", lambda v: F.struct(*[value(v, r) for r in _ROLES]))
    t = t.select(*by, F.posexplode(rows).alias("pos", "v")).select(*by, "pos", "v.*")

    from crossfactor.operators.wrangle import complete_roles

    return complete_roles(t)


def unusable_tables(tables: DataFrame, by: list[str], keep_names: list[str]) -> DataFrame:
    """The tables that ``usable_tables`` leaves out, with their header lists."""
    return _with_roles(tables, keep_names).filter(F.col("_roles").isNull()).select(*by, F.col("headers.name").alias("names"))


def correlation_file(spark: SparkSession, path: str, matrix_id: str) -> DataFrame:
    """A correlation matrix from a JSON file, a list of rows or an object with the list under 'correlation'."""
    body = F.col("value")
    rows = F.coalesce(F.from_json(F.get_json_object(body, "$.correlation"), "array<array<double>>"), F.from_json(body, "array<array<double>>"))
    d = spark.read.text(path, wholetext=True).select(F.posexplode(rows).alias("i", "row"))
    return d.select(F.lit(matrix_id).alias("matrix_id"), F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "c")).withColumn("j", F.col("j").cast("long"))


def correlation_csv(spark: SparkSession, path: str, matrix_id: str) -> DataFrame:
    """A correlation matrix from a headerless CSV file; the line number comes from the position inside the file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\R")).alias("i", "line"))
    lines = lines.filter(F.length(F.trim("line")) > 0)
    cells = lines.select(F.col("i").cast("long").alias("i"), F.posexplode(F.split("line", ",")).alias("j", "s"))
    return cells.select(F.lit(matrix_id).alias("matrix_id"), "i", F.col("j").cast("long").alias("j"), F.trim("s").try_cast("double").alias("c"))
