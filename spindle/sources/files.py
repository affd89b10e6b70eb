"""Small documents: saved graphs, lineage files, governance documents. JSON, and YAML where its library is there."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGES, NODES
from .builder import Rows

# Ids and types of the entities of lineage files.
ENTITY_PREFIX = {"dataset": "table", "datajob": "job", "job": "job", "dashboard": "exposure", "chart": "exposure"}
ENTITY_TYPE = {"dataset": "TABLE", "datajob": "DAG", "job": "DAG", "dashboard": "DASHBOARD", "chart": "REPORT"}


def load_document(path: str) -> dict:
    """A mapping from a JSON or YAML file."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} has to hold a mapping")
    return found


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a saved graph; ``seq`` is the place in the file."""
    whole = spark.read.schema(f"nodes array<struct<{_fields(NODES)}>>, edges array<struct<{_fields(EDGES)}>>").option("multiLine", True).json(path)

    def rows(section: str, schema: str) -> DataFrame:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        return whole.select(F.posexplode(section).alias("at", "x")).select(*[F.col("at").cast("long").alias("seq") if n == "seq" else F.col(f"x.{n}").alias(n) for n in names])

    return rows("nodes", NODES), rows("edges", EDGES)


def _fields(schema: str) -> str:
    return ",".join(f.replace(" ", ":", 1) for f in schema.split(", "))


def _entity(rows: Rows, entity, owner=None) -> str | None:
    """The id of an entity (a mapping, or a table's name), which becomes a node."""
    if not isinstance(entity, dict):
        return rows.node(f"table:{str(entity).lower()}", "TABLE", str(entity)) if entity else None
    name, kind = entity.get("name"), str(entity.get("type", "dataset")).lower()
    if not name:
        return None
    return rows.node(f"{ENTITY_PREFIX.get(kind, 'table')}:{str(name).lower()}", ENTITY_TYPE.get(kind, "TABLE"), str(name), owner=owner)


def _spelled(rows: Rows, ref: str, default: str | None) -> str | None:
    """The column of ``dataset.column``, or of the default dataset."""
    dataset, _, column = ref.rpartition(".")
    if dataset:
        return rows.column(rows.node(f"table:{dataset.lower()}", "TABLE", dataset.lower()), column)
    return rows.column(default, column) if default else None


def lineage_document(spark: SparkSession, document: dict) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a lineage document: upstream entities, ``columns``, and ``fineGrainedLineages``."""
    rows = Rows()
    for item in document.get("lineage") or []:
        own = _entity(rows, item.get("entity") or {}, item.get("owner"))
        if own is None:
            continue
        for up in item.get("upstream") or item.get("upstreams") or []:
            other = _entity(rows, up["entity"] if isinstance(up, dict) and "entity" in up else up)
            if other and other != own:
                rows.edge(own, other, "DEPENDS_ON", "lineage-file")
        for column, sources in (item.get("columns") or {}).items():
            made = rows.column(own, str(column))
            for source in sources or []:
                other = _entity(rows, source.get("entity") or {})
                if other and source.get("column"):
                    rows.edge(made, rows.column(other, str(source["column"])), "DEPENDS_ON", "lineage-file")
        for fine in item.get("fineGrainedLineages") or []:
            ups = [x for u in fine.get("upstreams") or [] if (x := _spelled(rows, str(u), None))]
            for down in fine.get("downstreams") or []:
                made = _spelled(rows, str(down), own)
                for up in ups:
                    rows.edge(made, up, "DEPENDS_ON", "lineage-file")
    return rows.frames(spark)
