"""Rows of a graph that a parser on the driver makes: of files, statements and system tables, not of data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import EDGES, NODES


class Rows:
    def __init__(self) -> None:
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []

    def node(self, id_: str, kind: str, name: str, path=None, parent=None, data_type=None, primary_key=None, owner=None, description=None) -> str:
        self.nodes.append((id_, kind, name, path, parent, data_type, primary_key, owner, description, len(self.nodes)))
        return id_

    def edge(self, src: str, dst: str, kind: str, via=None, provenance="extracted") -> None:
        self.edges.append((src, dst, kind, provenance, via, len(self.edges)))

    def column(self, table: str, name: str, data_type=None, primary_key=None) -> str:
        """A column of a table, and that the table has it."""
        id_ = f"column:{table.split(':', 1)[1]}.{name.lower()}"
        self.node(id_, "COLUMN", name.lower(), parent=table, data_type=data_type, primary_key=primary_key)
        self.edge(table, id_, "CONTAINS")
        return id_

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges), as written, before any upsert."""
        return spark.createDataFrame(self.nodes, NODES), spark.createDataFrame(self.edges, EDGES)
