"""A viewer on the loopback interface and a set of tools, both over a graph folder that is read again when it was written anew."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from tempfile import TemporaryDirectory
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from . import report
from .operators import analysis, impact, model, store, traverse

#: Rows that an answer holds at most; it says if there are more.
MOST = 500


class Graph:
    """(nodes, edges) of a folder, opened again once its success marker is newer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._stamp, self._frames, self._lock = spark, folder, None, None, threading.Lock()

    def frames(self) -> tuple[DataFrame, DataFrame]:
        with self._lock:
            stamp = tuple((Path(self.folder) / part / "_SUCCESS").stat().st_mtime_ns for part in ("nodes", "edges"))
            if stamp != self._stamp:
                self._frames, self._stamp = tuple(self.spark.read.parquet(f"{self.folder}/{part}") for part in ("nodes", "edges")), stamp
            return self._frames


def rows(df: DataFrame) -> dict:
    found = df.limit(MOST + 1).collect()
    return {"rows": [r.asDict(True) for r in found[:MOST]], "more": len(found) > MOST}


def tools(graph: Graph) -> dict[str, Callable[..., object]]:
    """Named functions of plain arguments to plain answers, for a tool server of any protocol."""
    spark = graph.spark
    one = lambda id_: spark.createDataFrame([(id_,)], "root string")

    def on(f):
        return lambda *a, **k: (lambda out: rows(out) if isinstance(out, DataFrame) else out)(f(*graph.frames(), *a, **k))

    def classes(n: DataFrame, e: DataFrame) -> DataFrame:
        tables, columns = model.without_alias_nodes(n.where("type <> 'COLUMN'"), n.where("type = 'COLUMN'"), e), n.where("type = 'COLUMN'")
        links = model.key_links(tables, columns, e)
        return model.table_roles(tables, model.column_roles(columns, tables), links)

    return {
        "impact": on(lambda n, e, changed, depth=None: report.impact_text(impact.analyse(spark, n, e, changed if isinstance(changed, list) else [changed], depth))),
        "lineage": on(lambda n, e, node, depth=None: traverse.lineage(n, e, one(node), depth, depth)),
        "upstream": on(lambda n, e, node, depth=None: traverse.upstream(e, one(node), depth)),
        "paths": on(lambda n, e, source, target: traverse.paths(e, source, target)),
        "search": on(lambda n, e, text, kind=None: analysis.search(n, text, 50, kind=kind)),
        "find": on(lambda n, e, text: store.find(n, text)),
        "node": on(lambda n, e, node: store.lookup(n, [node])),
        "context": on(lambda n, e, node: report.context(n, e, node)),
        "hotspots": on(lambda n, e, top=10: traverse.hotspots(n, e, top)),
        "relationships": on(lambda n, e: analysis.relationships(n, e)),
        "personal_data": on(lambda n, e: analysis.exposure(n, e)),
        "model": on(classes),
    }


def _handler(graph: Graph) -> type[BaseHTTPRequestHandler]:
    known = tools(graph)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # the only method there is
            url = urlsplit(self.path)
            query = {k: v[0] for k, v in parse_qs(url.query).items()}
            path = unquote(url.path)
            try:
                if path == "/":
                    self.answer("<!doctype html><title>spindle</title><form action='/api/search'><input name='q'><button>Search</button></form><a href='/graph'>graph</a> <a href='/api/report'>report</a> <a href='/api/model'>model</a>", "text/html")
                elif path == "/api/search":
                    self.answer(known["search"](query.get("q", ""), query.get("type")))
                elif path == "/api/report":
                    self.answer({name: rows(df) for name, df in report.sections(*graph.frames()).items()})
                elif path == "/api/model":
                    self.answer(known["model"]())
                elif path.startswith("/api/node/"):
                    found = known["node"](path[len("/api/node/") :])
                    self.answer(found["rows"][0]) if found["rows"] else self.send_error(404)
                elif path == "/graph" or path.startswith("/lineage/"):
                    self.page(None if path == "/graph" else path[len("/lineage/") :])
                else:
                    self.send_error(404)
            except (ValueError, KeyError) as error:
                self.send_error(400, str(error)[:100])

        def page(self, node: str | None) -> None:
            n, e = graph.frames()
            if node is not None:
                near = traverse.lineage(n, e, graph.spark.createDataFrame([(node,)], "root string")).select("node")
                n, e = store.subgraph(n, e, near.union(graph.spark.createDataFrame([(node,)], "node string")).distinct().withColumnRenamed("node", "id"))
            with TemporaryDirectory() as folder:  # a page on its way to the reader, on the driver
                report.write_html(n, e, f"{folder}/page.html", node or "Graph")
                self.answer(Path(f"{folder}/page.html").read_text(encoding="utf-8"), "text/html")

        def answer(self, body, kind: str = "application/json") -> None:
            raw = (body if isinstance(body, str) else json.dumps(body, default=str)).encode()
            self.send_response(200)
            for name, value in (("Content-Type", f"{kind}; charset=utf-8"), ("Content-Length", str(len(raw))), ("X-Content-Type-Options", "nosniff")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_) -> None:
            """Requests are not logged."""

    return Handler


def server(graph: Graph, port: int = 0) -> ThreadingHTTPServer:
    """A server on 127.0.0.1 (port 0: any free one); ``serve_forever`` runs it."""
    return ThreadingHTTPServer(("127.0.0.1", port), _handler(graph))
