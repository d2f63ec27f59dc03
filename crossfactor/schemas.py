"""Explicit schemas; nothing in the library relies on inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

#: Columns that may identify one fit; any subset may be present on a frame.
KEY_COLUMNS = ["matrix_id", "preset", "replicate", "start"]

OBS = T.StructType(
    [
        T.StructField("matrix_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("row_label", T.StringType()),
        T.StructField("col_label", T.StringType()),
        T.StructField("row_idx", T.IntegerType()),
        T.StructField("col_idx", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("stat_err", T.DoubleType()),
        T.StructField("sys_err", T.DoubleType()),
        T.StructField("total_err", T.DoubleType()),
    ]
)

COV = T.StructType(
    [
        T.StructField("matrix_id", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("j", T.LongType()),
        T.StructField("c", T.DoubleType()),
    ]
)

_ERRORS = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("symerror", T.DoubleType()),
            T.StructField(
                "asymerror",
                T.StructType([T.StructField("plus", T.DoubleType()), T.StructField("minus", T.DoubleType())]),
            ),
        ]
    )
)
_VALUE = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("errors", _ERRORS),
    ]
)
_HEADER = T.StructType([T.StructField("name", T.StringType())])
_VARIABLE = T.StructType([T.StructField("header", _HEADER), T.StructField("values", T.ArrayType(_VALUE))])
_ROW = T.StructType(
    [T.StructField("x", T.ArrayType(_VALUE)), T.StructField("y", T.ArrayType(_VALUE))]
)

#: One published table: variable style, row style, or both.
PUBLISHED_TABLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("headers", T.ArrayType(_HEADER)),
        T.StructField("values", T.ArrayType(_ROW)),
        T.StructField("independent_variables", T.ArrayType(_VARIABLE)),
        T.StructField("dependent_variables", T.ArrayType(_VARIABLE)),
    ]
)

PUBLISHED_RECORD = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("inspire_id", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("collaboration", T.StringType()),
        T.StructField("data_tables", T.ArrayType(PUBLISHED_TABLE)),
        T.StructField("tables", T.ArrayType(PUBLISHED_TABLE)),
        T.StructField(
            "resources",
            T.ArrayType(
                T.StructType(
                    [T.StructField("description", T.StringType()), T.StructField("location", T.StringType())]
                )
            ),
        ),
    ]
)

_FILE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)

#: A data-portal record with its file manifest.
FILE_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("doi", T.StringType()),
                    T.StructField("title", T.StringType()),
                    T.StructField("files", T.ArrayType(_FILE)),
                    T.StructField(
                        "categories",
                        T.StructType(
                            [
                                T.StructField("primary", T.ArrayType(T.StringType())),
                                T.StructField("secondary", T.ArrayType(T.StringType())),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)

PROVENANCE = T.StructType(
    [
        T.StructField("matrix_id", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("origin_details", T.StringType()),
        T.StructField(
            "sources",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source_type", T.StringType()),
                        T.StructField("identifier", T.StringType()),
                        T.StructField("doi", T.StringType()),
                        T.StructField("url", T.StringType()),
                        T.StructField("table_names", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField(
            "input_files",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("path", T.StringType()),
                        T.StructField("sha256", T.StringType()),
                        T.StructField("size_bytes", T.LongType()),
                        T.StructField("modified_time", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "selection_filters",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("description", T.StringType()),
                        T.StructField("n_before", T.LongType()),
                        T.StructField("n_after", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "fallbacks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("step", T.StringType()),
                        T.StructField("reason", T.StringType()),
                        T.StructField("fallback_to", T.StringType()),
                        T.StructField("original_source", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("build_timestamp", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


def key_columns(df: DataFrame) -> list[str]:
    """The identifying columns present on ``df``, in canonical order."""
    return [c for c in KEY_COLUMNS if c in df.columns]
