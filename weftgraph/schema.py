"""Column layouts of the two entity tables.

Dynamic attributes are real columns, not a JSON text: they are pruned and
pushed down like any other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The symbol and edge kinds, with their fallback.
SYMBOL_TYPES = ("function", "method", "class", "interface", "endpoint", "variable", "type_alias")
EDGE_TYPES = ("calls", "imports", "inherits", "consumes_api", "defines")

NODE_ATTRIBUTES = T.StructType([
    T.StructField("endpoint_route", T.StringType()),
    T.StructField("http_method", T.StringType()),
    T.StructField("consumes_endpoint", T.StringType()),
    T.StructField("consumes_http_method", T.StringType()),
    T.StructField("target_base_url", T.StringType()),
    T.StructField("file_imports", T.ArrayType(T.StringType())),
    T.StructField("parent_class", T.StringType()),
    T.StructField("bases", T.ArrayType(T.StringType())),
    T.StructField("receiver", T.StringType()),
    T.StructField("is_documentation_repo", T.BooleanType()),
])

NODES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("symbol_name", T.StringType()),
    T.StructField("symbol_type", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("signature", T.StringType()),
    T.StructField("docstring", T.StringType()),
    T.StructField("code_content", T.StringType()),
    *NODE_ATTRIBUTES.fields,
])

EDGES = T.StructType([
    T.StructField("caller_id", T.StringType()),
    T.StructField("callee_id", T.StringType()),
    T.StructField("edge_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("route", T.StringType()),
    T.StructField("target_endpoint_route", T.StringType()),
    T.StructField("http_method", T.StringType()),
    T.StructField("caller_repo", T.StringType()),
    T.StructField("target_repo", T.StringType()),
    T.StructField("import_text", T.StringType()),
    T.StructField("symbol", T.StringType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema`` from ``df``, adding typed nulls for missing columns."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def node_id(repo: Column, path: Column, name: Column, line: Column) -> Column:
    """``repo:path:name:line`` with forward slashes and no outer slash."""
    clean = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    return F.concat_ws(":", repo, clean, name, line.cast("string"))


def known_symbol_type(kind: Column) -> Column:
    return F.when(kind.isin(*SYMBOL_TYPES), kind).otherwise(F.lit("function"))


def known_edge_type(kind: Column) -> Column:
    return F.when(kind.isin(*EDGE_TYPES), kind).otherwise(F.lit("calls"))
