"""URL filters with a history: dated list entries as validity intervals, met by every capture as of its fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossfactor.llm.tables import join_small, numbered, table


def host(url: Column) -> Column:
    """Lower-case host of an address without user, port and closing dot; null without one."""
    got = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(F.lower(got), F.lit(".")), F.lit(""))


def path_parts(url: Column) -> Column:
    """Parts of the path, without query and fragment and without empty parts."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, action, start, stop)`` in which an entry holds, from dated ``(pattern, action, day, verb)``.

    A verb (``add`` or ``remove``) holds from its day until the next one of the same pattern and action; on one day
    ``remove`` comes last. ``stop`` is null for what still holds. Null fields are left out and repeats collapse, so
    a window holds at most two rows a day.
    """
    own = Window.partitionBy("pattern", "action").orderBy("day", "verb")
    e = entries.select("pattern", "action", "day", "verb").dropna().distinct()
    e = e.withColumn("stop", F.lead("day").over(own)).where((F.col("verb") == "add") & (F.col("stop").isNull() | (F.col("stop") > F.col("day"))))
    return e.select("pattern", "action", F.col("day").alias("start"), "stop")


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``(key, url, fetched, n_active, pattern, action, blocked)``, one row per row of ``captures``.

    A pattern is a host, which also stands for its subdomains, or a host and leading path parts (``host/a/b``). Of the
    entries active when the capture was fetched, the longest pattern decides, ``allow`` before ``block`` on a tie;
    ``blocked`` is false when none is active. Addresses that are null or have no host, and captures without a time, match
    nothing. The join is on the pattern with the interval as a range; its result is folded within the task before it moves.
    """
    held = intervals(entries).withColumn("_depth", F.size(F.split("pattern", "/")) - 1)
    deepest = held.agg(F.max("_depth")).first()[0] or 0
    c, row = numbered(captures.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(fetched).alias("_fetched")))
    labels, parts = F.split(host(F.col("_url")), r"\."), path_parts(F.col("_url"))
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    depth = F.least(F.size(parts), F.lit(deepest))
    paths = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(host(F.col("_url")), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    keys = F.when(host(F.col("_url")).isNotNull(), F.concat(hosts, F.coalesce(paths, F.array().cast("array<string>"))))
    k = c.withColumn("_k", F.explode_outer(keys))
    on = (F.col("_k") == F.col("pattern")) & (F.col("start") <= F.col("_fetched")) & (F.col("stop").isNull() | (F.col("_fetched") < F.col("stop")))
    met = join_small(k, held.drop("_depth"), on, "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern"), (F.col("action") == "allow").alias("allow"), "action", "pattern")))
    out = met.groupBy(row).agg(
        F.first("_key").alias(key), F.first("_url").alias(url), F.first("_fetched").alias(fetched), F.count("pattern").alias("n_active"), best.alias("_b")
    )
    return out.select(
        key, url, fetched, "n_active", F.col("_b.pattern").alias("pattern"), F.col("_b.action").alias("action"),
        F.coalesce(F.col("_b.action") == "block", F.lit(False)).alias("blocked"),
    )


def _part(text: Column, nth: int) -> Column:
    """Four hexadecimal digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1 + 4 * nth, 4), 16, 10).cast("int")


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date in 2024 that follows from their id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _part(F.col("page_id").cast("string"), 0) % 365).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, domains and first path parts; which and when follows from their MD5."""
    h, parts = host(F.col("url")), path_parts(F.col("url"))
    labels = F.split(h, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), F.lit(3)), ".")
    first = F.when(F.size(parts) > 0, F.concat(h, F.lit("/"), F.element_at(parts, 1)))
    p = pages.where(h.isNotNull()).select(F.explode(F.array(h, domain, first)).alias("pattern")).dropna().distinct()
    a, b, c = (_part(F.col("pattern"), i) for i in range(3))
    listed = a % 3 == 0
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    entry = lambda when, action, n, verb: F.when(when, F.struct(F.lit(action).alias("action"), day(n).alias("day"), F.lit(verb).alias("verb")))
    rows = F.array(
        entry(listed, "block", a % 365, "add"), entry(listed & (b % 2 == 0), "block", a % 365 + 1 + b % 120, "remove"),
        entry(listed & (b % 4 == 0), "block", a % 365 + 150 + c % 100, "add"), entry(c % 7 == 0, "allow", c % 365, "add"),
    )
    return p.withColumn("e", F.explode(rows)).where("e IS NOT NULL").select("pattern", "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(dated_captures(pages), derived_entries(pages))


SQL = r"""
WITH c0 AS (SELECT page_id, url, DATE '2024-01-01' + (('0x' || SUBSTR(MD5(page_id::VARCHAR), 1, 4))::INT % 365) AS fetched, ROW_NUMBER() OVER () AS r,
    NULLIF(RTRIM(LOWER(REGEXP_EXTRACT(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
    LIST_FILTER(STRING_SPLIT(REGEXP_EXTRACT(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
c AS (SELECT *, STRING_SPLIT(host, '.') AS labels FROM c0),
p AS (SELECT DISTINCT UNNEST([host, ARRAY_TO_STRING(labels[GREATEST(1, LEN(labels) - 2):], '.'), CASE WHEN LEN(parts) > 0 THEN host || '/' || parts[1] END]) AS pattern
    FROM c WHERE host IS NOT NULL),
q AS (SELECT pattern, ('0x' || SUBSTR(MD5(pattern), 1, 4))::INT AS a, ('0x' || SUBSTR(MD5(pattern), 5, 4))::INT AS b, ('0x' || SUBSTR(MD5(pattern), 9, 4))::INT AS c
    FROM p WHERE pattern IS NOT NULL),
e AS (SELECT pattern, 'block' AS action, a % 365 AS n, 'add' AS verb FROM q WHERE a % 3 = 0
    UNION SELECT pattern, 'block', a % 365 + 1 + b % 120, 'remove' FROM q WHERE a % 3 = 0 AND b % 2 = 0
    UNION SELECT pattern, 'block', a % 365 + 150 + c % 100, 'add' FROM q WHERE a % 3 = 0 AND b % 4 = 0
    UNION SELECT pattern, 'allow', c % 365, 'add' FROM q WHERE c % 7 = 0),
d AS (SELECT *, DATE '2024-01-01' + n AS start, DATE '2024-01-01' + LEAD(n) OVER (PARTITION BY pattern, action ORDER BY n, verb) AS stop FROM e),
v AS (SELECT * FROM d WHERE verb = 'add' AND (stop IS NULL OR stop > start)),
m AS (SELECT c.r, v.pattern, v.action FROM c JOIN v ON c.fetched >= v.start AND (v.stop IS NULL OR c.fetched < v.stop)
    AND (c.host = v.pattern OR ENDS_WITH(c.host, '.' || v.pattern) OR (LEN(c.parts) > 0 AND c.host || '/' || c.parts[1] = v.pattern))),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY r ORDER BY LENGTH(pattern) DESC, action = 'allow' DESC, pattern DESC) AS nth, COUNT(*) OVER (PARTITION BY r) AS n FROM m)
SELECT page_id, url, fetched, COALESCE(n, 0)::BIGINT AS n_active, pattern, action, COALESCE(action = 'block', FALSE) AS blocked
FROM c LEFT JOIN b ON c.r = b.r AND b.nth = 1
"""
