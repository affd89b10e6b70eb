"""Nodes and edges from the schemas of Parquet tables and declared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import EDGES, NODES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
)


def catalog_graph(spark: SparkSession, sf_dir: str, tables=TABLES, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): tables contain columns; a foreign key makes both its column and its table depend on the other side."""
    nodes, edges = [], []
    for t in tables:
        nodes.append((f"table:{t}", "TABLE", t, None, None, None, None, None, None))
        for f in spark.read.parquet(f"{sf_dir}/{t}.parquet").schema:
            id_ = f"column:{t}.{f.name.lower()}"
            nodes.append((id_, "COLUMN", f.name.lower(), None, f"table:{t}", f.dataType.simpleString(), None, None, None))
            edges.append((f"table:{t}", id_, "CONTAINS", "extracted", None))
    for child, column, parent, key in keys:
        edges.append((f"column:{child}.{column}", f"column:{parent}.{key}", "DEPENDS_ON", "extracted", "foreign_key"))
        if child != parent:
            edges.append((f"table:{child}", f"table:{parent}", "DEPENDS_ON", "extracted", "foreign_key"))
    number = lambda rows: [(*r, i) for i, r in enumerate(dict.fromkeys(rows))]
    return spark.createDataFrame(number(nodes), NODES), spark.createDataFrame(number(edges), EDGES)
