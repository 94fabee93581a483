"""The write path: files → symbols and edges → stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.operators.extract import defines_edges, extract_symbols, intra_file_calls
from weftgraph.operators.link import link_repositories
from weftgraph.session import materialise


def with_ordinal(nodes: DataFrame) -> DataFrame:
    """Input order as an explicit column: repository, path, line, then name."""
    return nodes.withColumn("ordinal", F.struct("repo", "file_path", "start_line", "symbol_name"))


def index_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``files(repo, file_path, content)`` → nodes, internal edges, cross edges.

    The symbols are written once; both edge sets read them from there.
    """
    symbols = materialise(extract_symbols(files), "symbols")
    internal = defines_edges(symbols).unionByName(intra_file_calls(symbols))
    return symbols, internal, link_repositories(with_ordinal(symbols))
