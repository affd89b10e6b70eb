"""Reports on a graph: sections as frames, and the texts and pages made of them."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.text import slug
from .operators import analysis, traverse
from .operators.impact import Impact


def sections(nodes: DataFrame, edges: DataFrame, statuses: DataFrame | None = None, usage: DataFrame | None = None, tested: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a report on the whole graph shows, a frame a section. ``statuses``: id, tests_failed, freshness; ``usage``: id, queries; ``tested``: id."""
    assets = nodes.where(~F.col("type").isin("COLUMN", "FILE", "FUNCTION", "CLASS", "MODULE"))
    out = {
        "by_type": nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type"),
        "hotspots": traverse.hotspots(nodes, edges, 15),
        "without_owner": assets.where("coalesce(owner, '') = ''").select("id").orderBy("id"),
        "roots": traverse.ends(nodes, edges, "roots").join(assets.select("id"), "id", "left_semi").orderBy("id"),
        "leaves": traverse.ends(nodes, edges, "leaves").join(assets.select("id"), "id", "left_semi").orderBy("id"),
        "personal_data": analysis.exposure(nodes, edges),
        "heuristic_edges": edges.groupBy(F.coalesce("provenance", F.lit("extracted")).alias("provenance")).agg(F.count(F.lit(1)).alias("n")).where("provenance <> 'extracted'"),
    }
    if statuses is not None:
        out["failing"] = statuses.where("tests_failed > 0").select("id", "tests_failed").orderBy("id")
        out["stale"] = statuses.where("freshness in ('warn', 'error')").select("id", "freshness").orderBy("id")
    if usage is not None:
        out["never_queried"] = usage.where("queries = 0").select("id").orderBy("id")
    if tested is not None:
        models = nodes.where("type = 'DBT_MODEL'").select("id").join(tested, "id", "left_anti")
        reached = traverse.reach(traverse.impact_edges(edges).select("from_id", "to_id"), models.withColumnRenamed("id", "root"))
        out["untested"] = reached.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("radius")).where("radius >= 3").orderBy(F.desc("radius"), "id")
    return out


def _cell(value) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, most: int = 50) -> str:
    """The first rows as a Markdown table, and how many more there are."""
    rows = df.limit(most + 1).collect()
    if not rows:
        return "none\n"
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows[:most])]
    return "\n".join(lines) + ("\n\nand more\n" if len(rows) > most else "\n")


def write_wiki(nodes: DataFrame, edges: DataFrame, folder: str, **known: DataFrame) -> int:
    """An index, a report and a page a node other than columns; returns the number of pages. Pages are written as they stream in."""
    root = Path(folder)
    (root / "nodes").mkdir(parents=True, exist_ok=True)
    parts = sections(nodes, edges, **known)
    (root / "REPORT.md").write_text("# Report\n\n" + "\n".join(f"## {name.replace('_', ' ')}\n\n{markdown_table(df)}" for name, df in parts.items()), encoding="utf-8")
    links = traverse.impact_edges(edges)
    side = lambda own, other: links.groupBy(F.col(own).alias("id")).agg(F.sort_array(F.collect_set(other)).alias(other))
    columns = nodes.where("type = 'COLUMN'").groupBy(F.col("parent").alias("id")).agg(F.sort_array(F.collect_list(F.concat_ws(" ", "name", "data_type"))).alias("columns"))
    pages = nodes.where("type <> 'COLUMN'").select("id", "type", "name", "owner", "description", slug(F.col("id")).alias("slug"))
    pages = pages.join(side("to_id", "from_id"), "id", "left").join(side("from_id", "to_id"), "id", "left").join(columns, "id", "left").orderBy("id")
    index, n = ["# Index", ""], 0
    for r in pages.toLocalIterator():
        listed = lambda title, items: f"\n## {title}\n\n" + "".join(f"- {_cell(x)}\n" for x in items) if items else ""
        body = f"# {_cell(r['name'])}\n\n{r['type'].lower()} `{r['id']}`, owner: {_cell(r['owner']) or 'none'}\n\n{_cell(r['description'])}\n" + listed("Columns", r["columns"]) + listed("Comes from", r["from_id"]) + listed("Reaches", [x for x in r["to_id"] or [] if not x.startswith("column:")])
        (root / "nodes" / f"{r['slug']}.md").write_text(body, encoding="utf-8")
        index.append(f"- [{_cell(r['name'])}](nodes/{r['slug']}.md) {r['type'].lower()}")
        n += 1
    (root / "index.md").write_text("\n".join(index) + "\n", encoding="utf-8")
    (root / "llms.txt").write_text(f"# {n} assets\nindex.md: all of them\nREPORT.md: what stands out\n", encoding="utf-8")
    return n


def context(nodes: DataFrame, edges: DataFrame, id_: str, depth: int = 2, most: int = 40) -> str:
    """All that is known of one node and what is near it, as Markdown."""
    own = nodes.where(F.col("id") == id_).first()
    if own is None:
        raise KeyError(id_)
    root = edges.sparkSession.createDataFrame([(id_,)], "root string")
    near = traverse.lineage(nodes, edges, root, depth, depth).join(nodes.select(F.col("id").alias("node"), "type"), "node").where("type <> 'COLUMN'")
    rank = F.row_number().over(Window.partitionBy("direction").orderBy("depth", "node"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("direction", "rank").select("direction", "depth", "node", "type")
    columns = nodes.where((F.col("type") == "COLUMN") & (F.col("parent") == id_)).select("name", "data_type").orderBy("name")
    return f"# {own['name']}\n\n{own['type'].lower()} `{id_}`, owner: {own['owner'] or 'none'}\n\n{own['description'] or ''}\n\n## Columns\n\n{markdown_table(columns, most)}\n## Near\n\n{markdown_table(near, 2 * most)}"


def impact_text(impact: Impact, most: int = 40) -> str:
    """An analysis for a terminal."""
    risk = impact.risk.first()
    lines = [f"risk {risk['level']} ({risk['score']}), {risk['affected']} affected"]
    lines += [f"  {'  ' * (r['depth'] - 1)}{r['node']}" for r in impact.affected.orderBy("depth", "node").limit(most).collect()]
    for title, rows in (("tests", [r["test"] for r in impact.tests.orderBy("place", "test").limit(most).collect()]), ("owners", [f"{r['owner']}: {', '.join(r['assets'])}" for r in impact.owners.orderBy("owner").collect()]), ("warnings", [r["warning"] for r in impact.warnings.orderBy("id").limit(most).collect()])):
        lines += [f"{title}:", *(f"  {x}" for x in rows)] if rows else []
    return "\n".join(lines)


def tree_text(tree: DataFrame, root: str, plain: bool = False) -> str:
    """A tree of traverse.tree() with lines drawn; ``plain``: in ASCII."""
    below: dict[str, list[tuple[str, str]]] = {}
    for r in tree.orderBy("depth", "node").collect():  # the tree of one node
        below.setdefault(r["parent"], []).append((r["node"], r["via"]))
    tee, last, bar = ("|- ", "`- ", "|  ") if plain else ("├─ ", "└─ ", "│  ")
    out, stack = [root], [(x, "", i == len(below.get(root, ())) - 1) for i, x in enumerate(below.get(root, ()))][::-1]
    while stack:
        (node, via), indent, end = stack.pop()
        out.append(f"{indent}{last if end else tee}{node} [{via}]")
        own = below.get(node, [])
        stack += [(x, indent + ("   " if end else bar), i == len(own) - 1) for i, x in enumerate(own)][::-1]
    return "\n".join(out)


def layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, type, x, y: layers from left to right, a place in each by id."""
    placed = nodes.where("type <> 'COLUMN'").join(traverse.layers(nodes, edges), "id")
    return placed.select("id", "name", "type", F.col("layer").alias("x"), (F.row_number().over(Window.partitionBy("layer").orderBy("id")) - 1).alias("y"))


def write_html(nodes: DataFrame, edges: DataFrame, path: str, title: str = "Lineage", most: int = 2000) -> None:
    """A page that draws the first nodes of a graph; data go in as JSON that can't end its script."""
    boxes = layout(nodes, edges).orderBy("x", "y").limit(most)
    places = {r["id"]: r.asDict() for r in boxes.collect()}
    lines = [(r["from_id"], r["to_id"]) for r in traverse.impact_edges(edges).select("from_id", "to_id").distinct().join(boxes.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(boxes.select(F.col("id").alias("to_id")), "to_id", "left_semi").collect()]
    data = json.dumps({"nodes": list(places.values()), "edges": lines}).replace("</", "<\\/").replace("<!--", "<\\!--")
    page = f"""<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><style>body{{font:13px sans-serif}}rect{{fill:#eef;stroke:#447}}path{{fill:none;stroke:#999}}</style><h1>{html.escape(title)}</h1><svg id="s"></svg>
<script type="application/json" id="d">{data}</script><script>
const d=JSON.parse(document.getElementById("d").textContent),s=document.getElementById("s"),n="http://www.w3.org/2000/svg",at={{}};
const add=(k,a,t)=>{{const e=document.createElementNS(n,k);for(const x in a)e.setAttribute(x,a[x]);if(t)e.textContent=t;s.appendChild(e)}};
let w=0,h=0;d.nodes.forEach(o=>{{at[o.id]=[o.x*260+10,o.y*40+10];w=Math.max(w,o.x*260+250);h=Math.max(h,o.y*40+50)}});s.setAttribute("width",w);s.setAttribute("height",h);
d.edges.forEach(([a,b])=>{{const p=at[a],q=at[b];add("path",{{d:`M${{p[0]+220}} ${{p[1]+14}} C${{p[0]+250}} ${{p[1]+14}} ${{q[0]-30}} ${{q[1]+14}} ${{q[0]}} ${{q[1]+14}}`}})}});
d.nodes.forEach(o=>{{const p=at[o.id];add("rect",{{x:p[0],y:p[1],width:220,height:28,rx:4}});add("text",{{x:p[0]+8,y:p[1]+18}},o.name.slice(0,30)+" ("+o.type.toLowerCase()+")")}});
</script>"""
    Path(path).write_text(page, encoding="utf-8")


def model_markdown(roles: DataFrame, classes: DataFrame, links: DataFrame) -> str:
    """The dimensional model as Markdown: facts, dimensions, the bus matrix and what to mend."""
    from .operators import model

    joined = lambda df: df.select(*[F.array_join(c, ", ").alias(c) if t.startswith("array") else c for c, t in df.dtypes])
    facts = model.facts(roles, classes, links)
    parts = {"Facts": joined(facts), "Additivity": model.additivity(facts), "Dimensions": joined(model.dimensions(roles, classes, links)), "Bus matrix": model.bus_matrix(links, facts), "To mend": model.issues(roles, classes, links)}
    return "# Model\n\n" + "\n".join(f"## {title}\n\n{markdown_table(df.orderBy(*df.columns[:1]), 200)}" for title, df in parts.items())
