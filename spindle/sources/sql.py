"""Graphs of SQL text: statements of files, and view definitions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import Lineage, lineage
from .builder import Rows


def read_files(spark: SparkSession, folder: str, pattern: str = "*.sql") -> DataFrame:
    """path (from the folder on, sorted), text of every such file below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/") + "/"
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.select(F.substring_index("path", root, -1).alias("path"), text.alias("text")).orderBy("path")


def split_statements(text: str) -> list[str]:
    """Statements between semicolons that aren't in quotes or comments."""
    out, part, i, n = [], [], 0, len(text)
    while i < n:
        c = text[i]
        if c in "'\"`":
            end = text.find(c, i + 1)
            end = n if end < 0 else end + 1
        elif text.startswith("--", i):
            end = text.find("\n", i)
            part.append(" ")
            i = n if end < 0 else end
            continue
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            part.append(" ")
            i = n if end < 0 else end + 2
            continue
        else:
            end = i + 1
        if c == ";":
            out.append("".join(part))
            part = []
        else:
            part.append(text[i:end])
        i = end
    return [s.strip() for s in [*out, "".join(part)] if s.strip()]


def _add(rows: Rows, target: str, found: Lineage, via: str | None, known: set[str] | None = None) -> None:
    """A statement's table and column lineage below ``target``; tables outside ``known`` (where given) are dropped."""
    name = target.split(":", 1)[1]
    for source in found.sources:
        if source != name and (known is None or source in known):
            rows.edge(target, f"table:{source}", "DEPENDS_ON", via)
    for column, leaves in found.columns.items():
        own = rows.column(target, column)
        for table, source in sorted(leaves):
            if known is None or table in known:
                rows.edge(own, rows.column(f"table:{table}", source), "DEPENDS_ON", "sql")


def statements_graph(spark: SparkSession, files: Iterable[tuple[str, str]], schema: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unparsed) of (path, text) files. A CREATE's table is contained in its file, an INSERT's is not; columns of tables
    made so far are known to later statements. ``unparsed``: path, sql, error of what Spark's parser doesn't take; the rest goes on."""
    rows, known, failed = Rows(), {t.lower(): list(c) for t, c in (schema or {}).items()}, []
    for path, text in files:
        file = rows.node(f"file:{path}", "FILE", path, path=path)
        for statement in split_statements(text):
            try:
                found = lineage(spark, statement, known)
            except Exception as error:  # whatever the parser raises: the statement is reported, the others go on
                failed.append((path, statement, str(error)[:200]))
                continue
            if found.target is None:
                continue
            target = rows.node(f"table:{found.target}", "VIEW" if found.kind == "VIEW" else "TABLE", found.target)
            if found.kind != "INSERT":
                rows.edge(file, target, "CONTAINS")
            _add(rows, target, found, None)
            if found.kind != "INSERT" and found.columns:
                known[found.target] = list(found.columns)
    return *rows.frames(spark), spark.createDataFrame(failed, "path string, sql string, error string")


def folder_graph(spark: SparkSession, folder: str, schema: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """statements_graph() of all SQL files below a folder."""
    return statements_graph(spark, ((r["path"], r["text"]) for r in read_files(spark, folder).toLocalIterator()), schema)


def views_graph(spark: SparkSession, views: Iterable[tuple[str, str]], schema: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (table id, definition) views: what they read (via view_definition), and their columns' lineage. Names of common
    table expressions are not tables. Definitions that can't be parsed add nothing."""
    rows = Rows()
    for id_, definition in views:
        try:
            found = lineage(spark, definition, schema)
        except Exception:  # as above; a view in another dialect leaves its tables and columns alone
            continue
        rows.node(id_, "VIEW", id_.split(":", 1)[1])
        _add(rows, id_, found, "view_definition")
    return rows.frames(spark)
