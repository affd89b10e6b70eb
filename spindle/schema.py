"""The typed property graph: node and edge frames, and their dimension values."""

from __future__ import annotations

NODES = "id string, type string, name string, path string, parent string, data_type string, primary_key boolean, owner string, description string, seq long"
EDGES = "src string, dst string, type string, provenance string, via string, seq long"

# What one affected node of each type adds to a risk score.
WEIGHTS = {
    "DASHBOARD": 8, "REPORT": 8, "EXPOSURE": 8, "API": 6, "LAMBDA": 4, "TABLE": 3, "VIEW": 3, "DBT_MODEL": 3, "DBT_SNAPSHOT": 3,
    "DBT_SEED": 2, "DBT_SOURCE": 2, "DAG": 3, "TASK": 2, "FUNCTION": 1, "CLASS": 1, "COLUMN": 1, "MODULE": 1, "FILE": 1,
}
#: Edge types along which a change of the source reaches the target; along the others it goes the other way.
FORWARD = ("CONTAINS", "WRITES_TO", "EXPOSES")
#: Node types that an id's prefix tells.
PREFIXES = {"column": "COLUMN", "file": "FILE", "func": "FUNCTION", "class": "CLASS", "module": "MODULE", "exposure": "EXPOSURE", "dbt": "DBT_MODEL", "source": "DBT_SOURCE", "job": "TASK", "task": "TASK", "dag": "DAG", "lambda": "LAMBDA", "api": "API", "dashboard": "DASHBOARD", "table": "TABLE"}
EXPOSED = ("DASHBOARD", "REPORT", "EXPOSURE", "API", "LAMBDA")
