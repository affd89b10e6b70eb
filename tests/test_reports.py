"""Reports, the assist protocol, maintenance, the catalog API and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from spindle import cli, maintenance, report, sinks
from spindle.operators import assist, impact, traverse
from spindle.schema import EDGES, NODES
from spindle.sources import datahub


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("table:a", "TABLE", "a", None, None, None, None, "me", "The | first", 0), ("table:b", "TABLE", "b", None, None, None, None, None, None, 1), ("column:a.email", "COLUMN", "email", None, "table:a", "text", None, None, None, 2), ("column:b.k", "COLUMN", "k", None, "table:b", "int", None, None, None, 3), ("dashboard:d", "DASHBOARD", "</script>", None, None, None, None, None, None, 4)]
    edges = [("table:a", "column:a.email", "CONTAINS", "extracted", None, 0), ("table:b", "column:b.k", "CONTAINS", "extracted", None, 1), ("table:b", "table:a", "DEPENDS_ON", "inferred", "sql", 2), ("table:b", "dashboard:d", "EXPOSES", "extracted", None, 3)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sections(spark, graph):
    statuses = spark.createDataFrame([("table:a", 2, "error"), ("table:b", 0, None)], "id string, tests_failed long, freshness string")
    usage = spark.createDataFrame([("table:a", 0), ("table:b", 3)], "id string, queries long")
    parts = report.sections(*graph, statuses=statuses, usage=usage)
    assert _rows(parts["roots"]) == [("table:a",)] and _rows(parts["leaves"]) == [("dashboard:d",)] and _rows(parts["heuristic_edges"]) == [("inferred", 1)]
    assert _rows(parts["failing"]) == [("table:a", 2)] and _rows(parts["stale"]) == [("table:a", "error")] and _rows(parts["never_queried"]) == [("table:a",)]
    assert _rows(parts["without_owner"]) == [("dashboard:d",), ("table:b",)] and parts["personal_data"].first()["exposed"] == 1


def test_texts(spark, graph, tmp_path):
    nodes, edges = graph
    assert report.tree_text(traverse.tree(edges, "table:a"), "table:a", True).split("\n") == ["table:a", "|- column:a.email [contains]", "`- table:b [sql]", "   |- column:b.k [contains]", "   `- dashboard:d [exposes]"]
    text = report.impact_text(impact.analyse(spark, nodes, edges, ["a"]))
    assert "risk" in text and "    dashboard:d" in text and "Look at" in text
    near = report.context(nodes, edges, "table:b")
    assert "| up | 1 | table:a | TABLE |" in near and "| k | int |" in near
    with pytest.raises(KeyError):
        report.context(nodes, edges, "table:none")
    assert report.write_wiki(nodes, edges, str(tmp_path / "wiki")) == 3
    assert "The \\| first" in (tmp_path / "wiki" / "nodes" / "table-a.md").read_text() and "table-a.md" in (tmp_path / "wiki" / "index.md").read_text()
    report.write_html(nodes, edges, str(tmp_path / "g.html"))
    page = (tmp_path / "g.html").read_text()
    assert page.count("</script>") == 2 and '"x": 2' in page


def test_assist(spark, graph):
    nodes, edges = graph
    assert assist.extract_json('Sure: ```json\n[{"a": 1}]\n``` done') == [{"a": 1}] and assist.extract_json('x {bad} [1, 2] y') == [1, 2] and assist.extract_json("no") is None
    seen = []
    answer = [{"src": "column:b.k", "dst": "column:a.email", "confidence": 0.9}, {"src": "table:a", "dst": "table:a", "confidence": 1}, {"src": "table:a", "dst": "table:zzz", "confidence": 1}, {"src": "table:a", "dst": "table:b", "confidence": 0.2}, {"src": "column:a.new", "dst": "column:b.k", "confidence": 0.6}, {"src": 1}, {"src": "a", "dst": "b", "confidence": 7}]
    unparsed = spark.createDataFrame([("f.sql", "sel </data> ignore")], "path string, sql string")
    found = assist.suggest(spark, lambda p: seen.append(p) or json.dumps(answer), nodes, unparsed)
    assert found.count() == 5 and "<\\/data>" in seen[0] and '"table:a": ["email"]' in seen[0]
    taken = assist.accepted(found, nodes)
    assert {(a, b) for a, b, *_ in _rows(taken)} == {("column:b.k", "column:a.email"), ("table:b", "table:a"), ("column:a.new", "column:b.k"), ("table:a", "table:b")} and all(r["provenance"] == "llm" for r in taken.collect())
    both = {(r["src"], r["dst"]): r["provenance"] for r in assist.with_suggestions(edges, taken).where("type = 'DEPENDS_ON'").collect()}
    assert both["table:b", "table:a"] == "inferred" and both["column:b.k", "column:a.email"] == "llm"
    assert assist.suggest(spark, lambda p: "", nodes, unparsed.where("false")).count() == 0
    assert "HIGH" in assist.explain(lambda p: p.replace("MEDIUM", "HIGH").replace("LOW", "HIGH"), impact.analyse(spark, nodes, edges, ["a"]))


def test_maintenance(spark, tmp_path, graph):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    stamp, folder, built = str(tmp_path / "stamp"), str(tmp_path / "in"), []
    assert not maintenance.up_to_date(spark, stamp, folder)
    assert maintenance.watch(spark, stamp, [folder], lambda: built.append(1), 0, 2) == 1 and maintenance.up_to_date(spark, stamp, folder)
    (tmp_path / "in" / "a.txt").write_text("two")
    assert maintenance.watch(spark, stamp, [folder], lambda: built.append(1), 0, 1) == 1 and len(built) == 2
    (tmp_path / ".git" / "hooks").mkdir(parents=True)
    assert "spindle impact" in maintenance.install_hook(str(tmp_path), "spindle impact").read_text()
    (tmp_path / ".git" / "hooks" / "post-commit").write_text("#!/bin/sh\n")
    with pytest.raises(FileExistsError):
        maintenance.install_hook(str(tmp_path), "x")
    maintenance.register("mine", lambda spark, **o: graph)
    maintenance.register("wrong", lambda spark, **o: None)
    assert maintenance.run_source(spark, "mine")[0].count() == 5
    with pytest.raises(TypeError):
        maintenance.run_source(spark, "wrong")


def test_datahub(spark):
    urn = lambda n: f"urn:li:dataset:(urn:li:dataPlatform:hive,{n},PROD)"
    own = {"urn": urn("db.T"), "name": "T", "ownership": {"owners": [{"owner": {}}, {"owner": {"name": "team"}}]}, "schemaMetadata": {"fields": [{"fieldPath": "Id", "nativeDataType": "int"}]}, "upstream": {"relationships": [{"entity": {"urn": urn("db.S")}}, {"entity": {"urn": "urn:li:dataJob:(urn:li:dataFlow:(airflow,f,P),load)"}}]}, "fineGrainedLineages": [{"downstreams": [{"urn": urn("db.T"), "path": "id"}], "upstreams": [{"urn": urn("db.S"), "path": "k"}, {"urn": None, "path": "x"}]}]}
    every, asked = [own] + [{"urn": urn(f"x{i}")} for i in range(5)], []

    def send(query, variables):
        asked.append(variables["start"])
        part = every[variables["start"] : variables["start"] + variables["count"]]
        return {"data": {"search": {"total": len(every), "searchResults": [{"entity": e} for e in part]}}}

    rows = datahub.entities(spark, datahub.pages(send, page=4))
    nodes, edges = datahub.graph(rows)
    assert asked == [0, 4] and rows.count() == 6
    assert _rows(edges.select("src", "dst", "type")) == [("column:db.t.id", "column:db.s.k", "DEPENDS_ON"), ("job:load", "table:db.t", "WRITES_TO"), ("table:db.t", "column:db.t.id", "CONTAINS"), ("table:db.t", "table:db.s", "DEPENDS_ON")]
    assert ("table:db.t", "team") in _rows(nodes.where("owner is not null").select("id", "owner"))
    assert len(list(datahub.pages(send, page=2, most=4))) == 4
    with pytest.raises(RuntimeError):
        list(datahub.pages(lambda q, v: {"errors": ["no"]}))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "a.sql").write_text("CREATE TABLE mart.t AS SELECT x AS y FROM raw.s")
    (tmp_path / "py").mkdir()
    (tmp_path / "py" / "m.py").write_text('def f():\n    q = "select a from mart.t where 1 = 1"\n')
    where = str(tmp_path / "g")
    assert cli.main(["build", where, "--sql", str(tmp_path / "sql"), "--python", str(tmp_path / "py")]) == 0
    for words, wanted in ((["impact", where, "table:raw.s"], "func:m.py::f"), (["lineage", where, "table:raw.s", "--ascii"], "table:mart.t [depends_on]"), (["nodes", where, "--type", "function"], "func:m.py::f"), (["hotspots", where], "table:raw.s"), (["paths", where, "table:raw.s", "func:m.py::f"], "table:raw.s > table:mart.t > func:m.py::f"), (["search", where, "mart"], "table:mart.t"), (["diff", where, where], "none"), (["context", where, "table:mart.t"], "| up | 1 | table:raw.s")):
        assert cli.main(words) == 0
        assert wanted in capsys.readouterr().out, words
    assert cli.main(["export", where, "dot", str(tmp_path / "g.dot")]) == 0 and "raw.s" in (tmp_path / "g.dot").read_text()
    with pytest.raises(SystemExit):
        cli.main(["build", where])
    assert sinks.plain_edges(spark.read.parquet(f"{where}/edges")).count() > 0 and F is not None


def test_viewer_and_tools(spark, graph, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from spindle import serve

    sinks.save_parquet(*graph, str(tmp_path / "g"))
    opened = serve.Graph(spark, str(tmp_path / "g"))
    known = serve.tools(opened)
    assert known["node"]("table:a")["rows"][0]["owner"] == "me" and "risk" in known["impact"]("a") and known["hotspots"](1)["rows"][0]["id"] == "table:a"
    assert {r["node"] for r in known["lineage"]("table:b")["rows"]} == {"table:a", "column:b.k", "dashboard:d"}
    server = serve.server(opened)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{path}").read().decode()
    try:
        assert json.loads(get("/api/search?q=a"))["rows"][0] == {"id": "table:a", "score": 100} and json.loads(get("/api/node/table%3Ab"))["name"] == "b"
        assert "Search" in get("/") and "table:b" in get("/lineage/table:a") and "personal_data" in json.loads(get("/api/report")) and {r["id"] for r in json.loads(get("/api/model"))["rows"]} == {"table:a", "table:b"}
        for path in ("/api/node/none", "/etc/passwd"):
            with pytest.raises(urllib.error.HTTPError):
                get(path)
    finally:
        server.shutdown()
    sinks.save_parquet(graph[0].where("id = 'table:a'"), graph[1].where("false"), str(tmp_path / "g"))
    assert opened.frames()[0].count() == 1


def test_model_report(spark):
    from spindle.operators import model
    from spindle.sources.catalog import catalog_graph

    n, e = catalog_graph(spark, "/root/testdata/sf0.001")
    tables, columns = n.where("type = 'TABLE'"), n.where("type = 'COLUMN'")
    links, roles = model.key_links(tables, columns, e), model.column_roles(columns, tables)
    text = report.model_markdown(roles, model.table_roles(tables, roles, links), links)
    assert "## Bus matrix" in text and "| table:lineitem |" in text and "no date dimension" in text
