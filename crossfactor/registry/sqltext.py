"""SQL for the check engine: base cells, noise and chained rounds, written from the definitions and not from the plans."""

from __future__ import annotations

RIDGE = "1e-8"

CELL_INDEX = """
SELECT *, CAST(dense_rank() OVER (PARTITION BY matrix_id ORDER BY row_label) - 1 AS INTEGER) AS row_idx,
       CAST(dense_rank() OVER (PARTITION BY matrix_id ORDER BY col_label) - 1 AS INTEGER) AS col_idx
FROM ({inner})"""

_CA = """
SELECT 'orders' AS matrix_id, n_name AS row_label, c_mktsegment AS col_label, avg(o_totalprice) AS value,
       stddev_samp(o_totalprice) / sqrt(count(*)) AS total_err, count(*) AS n_obs
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, c_mktsegment HAVING count(*) >= 2"""

_CB = """
SELECT 'lines' AS matrix_id, n_name AS row_label, p_brand AS col_label,
       avg(l_extendedprice * (1 - l_discount)) AS value,
       stddev_samp(l_extendedprice * (1 - l_discount)) / sqrt(count(*)) AS total_err, count(*) AS n_obs
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, p_brand HAVING count(*) >= 2"""

_CC = """
SELECT o_orderpriority AS matrix_id, n_name AS row_label, 'year=' || CAST(year(o_orderdate) AS VARCHAR) AS col_label,
       avg(o_totalprice) AS value, stddev_samp(o_totalprice) / sqrt(count(*)) AS total_err, count(*) AS n_obs
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY o_orderpriority, n_name, year(o_orderdate) HAVING count(*) >= 2"""

_CS = """
SELECT CAST(l_suppkey AS VARCHAR) AS matrix_id, l_returnflag || '/' || l_linestatus AS row_label,
       'year=' || CAST(year(l_shipdate) AS VARCHAR) AS col_label, avg(l_extendedprice * (1 - l_discount)) AS value,
       stddev_samp(l_extendedprice * (1 - l_discount)) / sqrt(count(*)) AS total_err, count(*) AS n_obs
FROM lineitem GROUP BY l_suppkey, l_returnflag || '/' || l_linestatus, year(l_shipdate) HAVING count(*) >= 2"""

_CP = """
SELECT 'unit_price' AS matrix_id, CAST(l_partkey AS INTEGER) AS row_idx, s_nationkey AS col_idx,
       l_extendedprice / l_quantity AS value, 0.1 * abs(l_extendedprice / l_quantity) AS total_err
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""

_CV = """
SELECT event_type AS matrix_id, CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS DOUBLE) AS t,
       avg(value) AS y, stddev_samp(value) / sqrt(count(*)) AS total_err, count(*) AS n_obs
FROM events GROUP BY event_type, CAST(ts AS DATE) HAVING count(*) >= 2"""

_EM = """
SELECT CAST(vec_id AS VARCHAR) AS matrix_id, label, unnest(range(len(embedding))) AS idx,
       CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings"""


def cte(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED ({body})"


CA = cte("ca", CELL_INDEX.format(inner=_CA))
CB = cte("cb", CELL_INDEX.format(inner=_CB))
CC = cte("cc", CELL_INDEX.format(inner=_CC))
CS = cte("cs", CELL_INDEX.format(inner=_CS))
CP = cte("cp", _CP)
CV = cte("cv", _CV)
EM = cte("em", _EM)


def with_(*ctes: str | list[str]) -> str:
    flat: list[str] = []
    for c in ctes:
        flat.extend(c if isinstance(c, list) else [c])
    return "WITH " + ",\n".join(flat) + "\n"


def uniform(key: str, start: int = 1) -> str:
    return f"(CAST(('0x' || substr(md5({key}), {start}, 8)) AS BIGINT) + 0.5) / 4294967296.0"


def normal(key: str) -> str:
    return f"sqrt(-2.0 * ln({uniform(key, 1)})) * cos(2.0 * pi() * {uniform(key, 9)})"


def als(src: str, keys: list[str], power: int, rounds: int, rank: int = 2, p: str = "f") -> list[str]:
    """Chained rounds over ``src(keys, row_idx, col_idx, value, total_err)``.

    Leaves ``{p}_r1`` (cells with rank-one residual ``r`` and ``y, w, wc``), ``{p}_u``, ``{p}_v`` and for rank two
    ``{p}_r2``, ``{p}_uu``, ``{p}_vv``; values are in units of the matrix RMS ``{p}_s.s``.
    """
    k = ", ".join(keys)
    on_row, on_col = f"USING ({k}, row_idx)", f"USING ({k}, col_idx)"
    unit = f"sqrt(sum({{x}} * {{x}}) OVER (PARTITION BY {k}))"
    out = [
        cte(f"{p}_s", f"SELECT {k}, sqrt(avg(value * value)) AS s FROM {src} GROUP BY {k}"),
        cte(
            f"{p}_c",
            f"SELECT {k}, row_idx, col_idx, value / s AS y, 1.0 / ((total_err / s) * (total_err / s) + {RIDGE}) AS w, "
            f"1.0 / ((total_err / s) * (total_err / s)) AS wc FROM {src} JOIN {p}_s USING ({k})",
        ),
        cte(f"{p}_p0", f"SELECT DISTINCT {k}, col_idx, 1.0 AS v FROM {p}_c"),
    ]

    def powers(prefix: str, cells: str, value: str) -> str:
        last = f"{prefix}0"
        for i in range(1, power + 1):
            out.append(
                cte(f"{prefix}u{i}", f"SELECT {k}, row_idx, sum({value} * v) AS u FROM {cells} JOIN {last} {on_col} GROUP BY {k}, row_idx")
            )
            out.append(
                cte(
                    f"{prefix}{i}",
                    f"SELECT {k}, col_idx, x / {unit.format(x='x')} AS v FROM (SELECT {k}, col_idx, sum({value} * u) AS x "
                    f"FROM {cells} JOIN {prefix}u{i} {on_row} GROUP BY {k}, col_idx)",
                )
            )
            last = f"{prefix}{i}"
        return last

    last = powers(f"{p}_p", f"{p}_c", "y")
    for i in range(1, rounds + 1):
        out.append(
            cte(f"{p}_u{i}", f"SELECT {k}, row_idx, sum(w * v * y) / (sum(w * v * v) + {RIDGE}) AS u FROM {p}_c JOIN {last} {on_col} GROUP BY {k}, row_idx")
        )
        out.append(
            cte(f"{p}_v{i}", f"SELECT {k}, col_idx, sum(w * u * y) / (sum(w * u * u) + {RIDGE}) AS v FROM {p}_c JOIN {p}_u{i} {on_row} GROUP BY {k}, col_idx")
        )
        last = f"{p}_v{i}"
    out += [
        cte(f"{p}_n", f"SELECT {k}, sqrt(sum(v * v)) AS nv FROM {last} GROUP BY {k}"),
        cte(f"{p}_u", f"SELECT {k}, row_idx, u * nv AS u FROM {p}_u{rounds} JOIN {p}_n USING ({k})"),
        cte(f"{p}_v", f"SELECT {k}, col_idx, v / nv AS v FROM {last} JOIN {p}_n USING ({k})"),
        cte(f"{p}_r1", f"SELECT {k}, row_idx, col_idx, y, w, wc, u * v AS p1, y - u * v AS r FROM {p}_c JOIN {p}_u {on_row} JOIN {p}_v {on_col}"),
    ]
    if rank == 1:
        return out
    out.append(cte(f"{p}_q0", f"SELECT DISTINCT {k}, col_idx, sin(1.0 + col_idx) AS v FROM {p}_c"))
    last = powers(f"{p}_q", f"{p}_r1", "r")
    out.append(cte(f"{p}_vv0", f"SELECT {k}, col_idx, a.v AS v1, b.v AS v2 FROM {p}_v a JOIN {last} b {on_col}"))

    def two(src_: str, wanted: str, known: str, x: str, z: str) -> str:
        det = f"((a + {RIDGE}) * (d + {RIDGE}) - c * c)"
        return (
            f"SELECT {k}, {wanted}, (p * (d + {RIDGE}) - q * c) / {det} AS {z}1, (q * (a + {RIDGE}) - p * c) / {det} AS {z}2 "
            f"FROM (SELECT {k}, {wanted}, sum(w * {x}1 * {x}1) AS a, sum(w * {x}1 * {x}2) AS c, sum(w * {x}2 * {x}2) AS d, "
            f"sum(w * {x}1 * y) AS p, sum(w * {x}2 * y) AS q FROM {p}_c JOIN {src_} USING ({k}, {known}) GROUP BY {k}, {wanted})"
        )

    for i in range(1, rounds + 1):
        out.append(cte(f"{p}_uu{i}", two(f"{p}_vv{i - 1}", "row_idx", "col_idx", "v", "u")))
        out.append(cte(f"{p}_vv{i}", two(f"{p}_uu{i}", "col_idx", "row_idx", "u", "v")))
    out.append(
        cte(
            f"{p}_r2",
            f"SELECT {k}, row_idx, col_idx, y, w, wc, u1 * v1 + u2 * v2 AS p2, y - u1 * v1 - u2 * v2 AS r "
            f"FROM {p}_c JOIN {p}_uu{rounds} {on_row} JOIN {p}_vv{rounds} {on_col}",
        )
    )
    # singular order: Gram-Schmidt on v, then the rotation that diagonalises u'u, then a fixed sign
    out += [
        cte(f"{p}_g", f"SELECT {k}, sqrt(g11) AS r11, g12 / sqrt(g11) AS r12, sqrt(g22 - g12 * g12 / g11) AS r22 FROM (SELECT {k}, sum(v1*v1) AS g11, sum(v1*v2) AS g12, sum(v2*v2) AS g22 FROM {p}_vv{rounds} GROUP BY {k})"),
        cte(f"{p}_qv", f"SELECT {k}, col_idx, v1 / r11 AS q1, (v2 - r12 * v1 / r11) / r22 AS q2 FROM {p}_vv{rounds} JOIN {p}_g USING ({k})"),
        cte(f"{p}_bu", f"SELECT {k}, row_idx, u1 * r11 + u2 * r12 AS b1, u2 * r22 AS b2 FROM {p}_uu{rounds} JOIN {p}_g USING ({k})"),
        cte(f"{p}_h", f"SELECT {k}, 0.5 * atan2(2 * sum(b1 * b2), sum(b1 * b1) - sum(b2 * b2)) AS th FROM {p}_bu GROUP BY {k}"),
        cte(f"{p}_rv", f"SELECT {k}, col_idx, cos(th) * q1 + sin(th) * q2 AS v1, cos(th) * q2 - sin(th) * q1 AS v2 FROM {p}_qv JOIN {p}_h USING ({k})"),
        cte(f"{p}_ru", f"SELECT {k}, row_idx, cos(th) * b1 + sin(th) * b2 AS u1, cos(th) * b2 - sin(th) * b1 AS u2 FROM {p}_bu JOIN {p}_h USING ({k})"),
        cte(f"{p}_sg", f"SELECT {k}, CASE WHEN arg_max(v1, abs(v1)) < 0 THEN -1.0 ELSE 1.0 END AS s1, CASE WHEN arg_max(v2, abs(v2)) < 0 THEN -1.0 ELSE 1.0 END AS s2 FROM {p}_rv GROUP BY {k}"),
        cte(f"{p}_uu", f"SELECT {k}, row_idx, u1 * s1 AS u1, u2 * s2 AS u2 FROM {p}_ru JOIN {p}_sg USING ({k})"),
        cte(f"{p}_vv", f"SELECT {k}, col_idx, v1 * s1 AS v1, v2 * s2 AS v2 FROM {p}_rv JOIN {p}_sg USING ({k})"),
    ]
    return out


def lambdas(keys: list[str], p: str = "f") -> list[str]:
    """``{p}_lam(keys, chi2_rank1, chi2_rank2, lambda_stat)``."""
    k = ", ".join(keys)
    return [
        cte(f"{p}_x1", f"SELECT {k}, sum(wc * r * r) AS chi2_rank1, count(*) AS n_obs, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols FROM {p}_r1 GROUP BY {k}"),
        cte(f"{p}_x2", f"SELECT {k}, sum(wc * r * r) AS chi2_rank2 FROM {p}_r2 GROUP BY {k}"),
        cte(f"{p}_lam", f"SELECT *, chi2_rank1 - chi2_rank2 AS lambda_stat FROM {p}_x1 JOIN {p}_x2 USING ({k})"),
    ]


def pseudo(src: str, key: list[str], n: int, seed: int, stream: str = "null", p: str = "f", name: str = "ps") -> str:
    """Pseudo-tables from the rank-one fit of ``src``: prediction back in units of the values plus hashed noise."""
    k = ", ".join(key)
    parts = " || '|' || ".join([f"'{seed}'", *key, "CAST(replicate AS VARCHAR)", "CAST(row_idx AS VARCHAR)", "CAST(col_idx AS VARCHAR)", f"'{stream}'"])
    return cte(
        name,
        f"SELECT {k}, replicate, row_idx, col_idx, p1 * s + total_err * ({normal(parts)}) AS value, total_err "
        f"FROM {src} JOIN {p}_r1 USING ({k}, row_idx, col_idx) JOIN {p}_s USING ({k}), (SELECT unnest(range({n})) AS replicate)",
    )
