"""What a graph is written as: JSON, GraphML, DOT, Cypher, Mermaid. Lines are made by expressions, and ordered by ``seq``."""

from __future__ import annotations

import json
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _escaped(text: Column, quote: str) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit(quote), F.lit("\\" + quote)), F.lit("\n"), F.lit(" "))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, seq, line of a DOT graph; what is not extracted is dashed."""
    e = lambda c: _escaped(F.col(c), '"')
    node = F.format_string('  "%s" [label="%s\\n(%s)"];', e("id"), e("name"), F.lower("type"))
    style = F.when(F.coalesce("provenance", F.lit("extracted")) != "extracted", ", style=dashed").otherwise("")
    edge = F.format_string('  "%s" -> "%s" [label="%s"%s];', e("src"), e("dst"), F.lower("type"), style)
    return nodes.select(F.lit(0).alias("part"), "seq", node.alias("line")).union(edges.select(F.lit(1), "seq", edge))


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, seq, line of a Cypher script that merges the graph; labels are the types in camel case."""
    e = lambda c: _escaped(F.col(c), "'")
    label = F.replace(F.initcap(F.replace(F.lower("type"), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    path = F.when(F.col("path").isNotNull() & (F.col("path") != ""), F.concat(F.lit(", n.path = '"), e("path"), F.lit("'"))).otherwise("")
    node = F.concat(F.lit("MERGE (n:"), label, F.lit(" {id: '"), e("id"), F.lit("'}) SET n.name = '"), e("name"), F.lit("'"), path, F.lit(";"))
    edge = F.concat(F.lit("MATCH (a {id: '"), e("src"), F.lit("'}), (b {id: '"), e("dst"), F.lit("'}) MERGE (a)-[:"), F.upper("type"), F.lit(" {provenance: '"), F.coalesce("provenance", F.lit("extracted")), F.lit("'}]->(b);"))
    return nodes.select(F.lit(0).alias("part"), "seq", node.alias("line")).union(edges.select(F.lit(1), "seq", edge))


def plain_edges(edges: DataFrame) -> DataFrame:
    """src, dst, type, provenance: parallel edges collapsed to the last one."""
    last = F.max_by(F.struct("type", "provenance"), "seq")
    return edges.groupBy("src", "dst").agg(last.alias("e"), F.min("seq").alias("seq")).select("src", "dst", "e.type", "e.provenance", "seq")


def _ordered(lines: DataFrame):
    return (r["line"] for r in lines.orderBy("part", "seq").toLocalIterator())


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("digraph spindle {\n  rankdir=LR;\n  node [shape=box, fontname=Helvetica];\n")
        f.writelines(line + "\n" for line in _ordered(dot_lines(nodes, edges)))
        f.write("}\n")


def write_cypher(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in _ordered(cypher_lines(nodes, edges)))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    keys = [("d0", "node", "name"), ("d1", "node", "type"), ("d2", "node", "path"), ("d3", "edge", "type"), ("d4", "edge", "provenance")]
    data = lambda key, value: f'<data key="{key}">{escape(value or "")}</data>'
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        f.writelines(f'  <key id="{k}" for="{of}" attr.name="{name}" attr.type="string"/>\n' for k, of, name in keys)
        f.write('  <graph edgedefault="directed">\n')
        for n in nodes.orderBy("seq").toLocalIterator():
            f.write(f"    <node id={quoteattr(n['id'])}>{data('d0', n['name'])}{data('d1', n['type'].lower())}{data('d2', n['path'])}</node>\n")
        for e in plain_edges(edges).orderBy("seq").toLocalIterator():
            f.write(f"    <edge source={quoteattr(e['src'])} target={quoteattr(e['dst'])}>{data('d3', e['type'].lower())}{data('d4', e['provenance'])}</edge>\n")
        f.write("  </graph>\n</graphml>\n")


def save_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One document with sorted keys, that sources.files.load_graph reads back."""
    def rows(df: DataFrame) -> list[dict]:
        return [{k: v for k, v in r.asDict().items() if v is not None and k != "seq"} for r in df.orderBy("seq").toLocalIterator()]

    Path(path).write_text(json.dumps({"version": 2, "nodes": rows(nodes), "edges": rows(edges)}, indent=2, sort_keys=True), encoding="utf-8")


def save_parquet(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The store for large graphs."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def mermaid_lines(columns: DataFrame, links: DataFrame) -> DataFrame:
    """part, seq, line of an entity diagram: a block a table with its columns by role, a line a key link."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, "^[^:]*:", ""), "[^A-Za-z0-9_]", "_")
    kind = F.coalesce(F.nullif(F.regexp_replace("data_type", "[^A-Za-z0-9_]", "_"), F.lit("")), F.lit("unknown"))
    mark = F.when(F.col("role") == "pk", " PK").when(F.col("role") == "fk", " FK").otherwise("")
    entry = F.concat(F.lit("    "), kind, F.lit(" "), safe(F.col("name")), mark)
    block = columns.groupBy("parent").agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("body")).select(F.lit(0).alias("part"), F.col("parent").alias("seq"), F.concat(F.lit("  "), safe(F.col("parent")), F.lit(" {\n"), "body", F.lit("\n  }")).alias("line"))
    arrow = F.when(F.col("provenance") == "inferred", " }o..|| ").otherwise(" }o--|| ")
    link = links.select(F.lit(1), F.concat_ws(" ", "from_table", "from_column", "to_table"), F.concat(F.lit("  "), safe(F.col("from_table")), arrow, safe(F.col("to_table")), F.lit(" : "), F.col("from_column")))
    return block.union(link)
