"""The command line: build a graph from sources into a folder, and ask it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import report, sinks
from .maintenance import run_source
from .operators import analysis, impact, store, traverse
from .sources import code, dbt, files, sql, warehouse


def _session() -> SparkSession:
    return SparkSession.builder.appName("spindle").getOrCreate()


def _load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def _numbered(df: DataFrame, like: str) -> DataFrame:
    """``df`` with all columns of a schema, and a place for each row if it has none."""
    from pyspark.sql import functions as F

    have = {f.split(" ")[0]: f.split(" ")[1] for f in like.split(", ")}
    return df.select(*[F.col(c) if c in df.columns else (F.monotonically_increasing_id() if c == "seq" else F.lit(None).cast(t)).alias(c) for c, t in have.items()])


def build(spark: SparkSession, args) -> None:
    from .schema import EDGES, NODES

    parts = []
    for folder in args.sql or ():
        parts.append(sql.folder_graph(spark, folder)[:2])
    for path in args.dbt or ():
        parts.append(dbt.graph(dbt.read(spark, path, dbt.MANIFEST)))
    for path in args.sqlite or ():
        parts.append(warehouse.sqlite_graph(spark, path))
    for folder in args.python or ():
        parts.append(code.graph(sql.read_files(spark, folder, "*.py")))
    for path in args.lineage or ():
        parts.append(files.lineage_document(spark, files.load_document(path)))
    for name in args.source or ():
        parts.append(run_source(spark, name))
    if not parts:
        raise SystemExit("nothing to build from")
    nodes, edges = (_numbered(x, y) for x, y in zip(parts[0], (NODES, EDGES)))
    for more in parts[1:]:
        nodes, edges = store.merge((nodes, edges), tuple(_numbered(x, y) for x, y in zip(more, (NODES, EDGES))))
    nodes, edges = store.upsert_nodes(nodes), store.upsert_edges(edges)
    sinks.save_parquet(_numbered(store.with_missing_endpoints(nodes, edges), NODES), _numbered(edges, EDGES), args.graph)


def _show(df: DataFrame) -> None:
    print(report.markdown_table(df, 200), end="")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spindle")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options) -> None:
        c = commands.add_parser(name)
        c.add_argument("graph")
        for names, settings in arguments:
            c.add_argument(*names, **settings)

    many = {"action": "append"}
    command("build", *[((f"--{s}",), many) for s in ("sql", "dbt", "sqlite", "python", "lineage", "source")])
    command("impact", (("changed",), {"nargs": "+"}), (("--depth",), {"type": int}), (("--extracted-only",), {"action": "store_true"}))
    command("lineage", (("node",), {}), (("--up",), {"action": "store_true"}), (("--ascii",), {"action": "store_true"}))
    command("paths", (("source",), {}), (("target",), {}))
    command("hotspots", (("--top",), {"type": int, "default": 10}))
    command("nodes", (("--type",), {}))
    command("search", (("text",), {}), (("--type",), {}))
    command("relationships"), command("pii"), command("report")
    command("context", (("node",), {}))
    command("diff", (("other",), {}))
    command("export", (("format",), {"choices": ["json", "dot", "cypher", "graphml", "html", "wiki"]}), (("path",), {}))
    args = parser.parse_args(argv)
    spark = _session()
    if args.command == "build":
        build(spark, args)
        return 0
    n, e = _load(spark, args.graph)
    if args.command == "impact":
        print(report.impact_text(impact.analyse(spark, n, e, args.changed, args.depth, not args.extracted_only)))
    elif args.command == "lineage":
        print(report.tree_text(traverse.tree(e, args.node, "up" if args.up else "down"), args.node, args.ascii))
    elif args.command == "export":
        writers = {"json": sinks.save_json, "dot": sinks.write_dot, "cypher": sinks.write_cypher, "graphml": sinks.write_graphml, "html": report.write_html, "wiki": report.write_wiki}
        writers[args.format](n, e, args.path)
    elif args.command == "context":
        print(report.context(n, e, args.node))
    elif args.command == "report":
        for name, df in report.sections(n, e).items():
            print(f"## {name}\n")
            _show(df)
    else:
        _show({
            "paths": lambda: traverse.paths(e, args.source, args.target), "hotspots": lambda: traverse.hotspots(n, e, args.top), "nodes": lambda: (store.of_type(n, args.type.upper()) if args.type else n).select("id", "type", "name").orderBy("id"),
            "search": lambda: analysis.search(n, args.text, 50, kind=args.type), "relationships": lambda: analysis.relationships(n, e).orderBy("id"), "pii": lambda: analysis.exposure(n, e), "diff": lambda: store.drift((n, e), _load(spark, args.other)).orderBy("kind", "change", "key"),
        }[args.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
