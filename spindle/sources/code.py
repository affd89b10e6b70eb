"""Graphs of source code: functions, imports, calls and SQL strings of Python and JavaScript files.

A file is read on an executor, and gives rows (path, kind, owner, name, text, first_line, last_line); which file, function
or table they mean is worked out by joins over all files' rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import looks_like_sql
from .sql import read_files

FOUND = "path string, kind string, owner string, name string, text string, first_line long, last_line long"
_NAMES = [f.split(" ")[0] for f in FOUND.split(", ")]

# How reads, writes and placeholders of SQL text look, and words that are no tables.
READS = r'(?i)\b(?:from|join)\s+([\w\.\"`\[\]]+)'
WRITES = r'(?i)\b(?:insert\s+into|merge\s+into|update|create\s+(?:or\s+replace\s+)?(?:table|view)(?:\s+if\s+not\s+exists)?|copy\s+into|truncate\s+table|delete\s+from)\s+([\w\.\"`\[\]]+)'
PLACEHOLDER = r"\{[^}]*\}|%s|%\(\w+\)s|:\w+|\?|\$\d+"
NO_TABLES = ("select", "where", "values", "set", "on", "as", "and", "or", "not", "null", "dual", "lateral", "unnest")
CTE = r'(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)([\w\"`]+)\s+as\s*\('


class _Python(ast.NodeVisitor):
    """Definitions, calls, imports and strings of one module, each with the function around it."""

    def __init__(self, path: str):
        self.path, self.around, self.rows = path, [], []

    def add(self, kind: str, name: str, text: str | None = None, node: ast.AST | None = None) -> None:
        self.rows.append((self.path, kind, ".".join(self.around), name, text, getattr(node, "lineno", None), getattr(node, "end_lineno", None)))

    def _definition(self, node) -> None:
        self.add("class" if isinstance(node, ast.ClassDef) else "function", ".".join([*self.around, node.name]), None, node)
        self.around.append(node.name)
        self.generic_visit(node)
        self.around.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _definition

    def visit_Import(self, node: ast.Import) -> None:
        for name in node.names:
            self.add("import", name.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        package = self.path.removesuffix(".py").split("/")[: -node.level] if node.level else []
        for name in node.names:
            self.add("import", ".".join([*package, *filter(None, [node.module]), name.name]))

    def visit_Call(self, node: ast.Call) -> None:
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if name:
            self.add("call", name)
        self.generic_visit(node)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str):
            self.add("string", "", node.value, node)

    def visit_JoinedStr(self, node: ast.JoinedStr) -> None:
        self.add("string", "", "".join(v.value if isinstance(v, ast.Constant) else "{}" for v in node.values), node)
        for v in node.values:
            if isinstance(v, ast.FormattedValue):
                self.visit(v.value)


def python_rows(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as error:
        return [(path, "unparsed", "", "", str(error)[:200], None, None)]
    found = _Python(path)
    try:
        found.visit(tree)
    except RecursionError:
        return [(path, "unparsed", "", "", "nested too deeply", None, None)]
    return found.rows


_JS_FUNCTION = re.compile(r"(?:^|\s)(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)", re.M)
_JS_IMPORT = re.compile(r"""(?:\bfrom\s*|\bimport\s*|\brequire\(\s*|\bimport\(\s*)["']([^"']+)["']""")
_JS_CALL = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\(")
_JS_STRING = re.compile(r"`((?:[^`\\]|\\.)*)`|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'", re.S)
_JS_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "require", "import", "super", "await", "new"}


def javascript_rows(path: str, text: str) -> list[tuple]:
    """A function's lines go on to the line before the next function."""
    line = lambda at: text.count("\n", 0, at) + 1
    starts = [(m.start(1) if m.group(1) else m.start(2), m.group(1) or m.group(2)) for m in _JS_FUNCTION.finditer(text)]
    ends = [at for at, _ in starts[1:]] + [len(text) + 1]
    owner = lambda at: next((n for (s, n), e in zip(starts, ends) if s <= at < e), "")
    rows = [(path, "function", "", n, None, line(s), max(line(s), line(min(e, len(text))) - (e <= len(text)))) for (s, n), e in zip(starts, ends)]
    rows += [(path, "import", "", m.group(1), None, line(m.start()), None) for m in _JS_IMPORT.finditer(text)]
    rows += [(path, "call", owner(m.start()), m.group(1), None, line(m.start()), None) for m in _JS_CALL.finditer(text) if m.group(1) not in _JS_WORDS and m.start(1) not in {s for s, _ in starts}]
    for m in _JS_STRING.finditer(text):
        rows.append((path, "string", owner(m.start()), "", re.sub(r"\$\{[^}]*\}", "{}", next(g for g in m.groups() if g is not None)), line(m.start()), line(m.end())))
    return rows


def _scanned(read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in read(path, text or "")]
            columns = list(zip(*rows)) or [[]] * len(_NAMES)
            kinds = [pa.int64() if n.endswith("_line") else pa.string() for n in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=_NAMES)

    return run


def scan(files: DataFrame, language: str = "python") -> DataFrame:
    """What each (path, text) file holds; files that can't be parsed give one row of kind ``unparsed``."""
    return files.select("path", "text").mapInArrow(_scanned(python_rows if language == "python" else javascript_rows), FOUND)


def scan_folder(spark: SparkSession, folder: str, language: str = "python") -> DataFrame:
    return scan(read_files(spark, folder, "*.py" if language == "python" else "*.{js,jsx,ts,tsx,mjs,cjs}"), language)


def sql_tables(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with reads, writes and certain of the SQL in column ``text``; names of common table expressions are not tables."""
    def names(pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        clean = F.transform(found, lambda n: F.lower(F.trim(F.regexp_replace(n, r'["`\[\];,()]', ""))))
        return F.array_distinct(F.filter(clean, lambda n: (n != "") & ~n.isin(*NO_TABLES) & ~n.startswith("placeholder") & ~n.rlike("^[.]|[.]$")))

    out = rows.withColumns({"writes": names(WRITES), "ctes": names(CTE)})
    out = out.withColumn("reads", F.array_except(F.array_except(names(READS), F.col("writes")), F.col("ctes"))).drop("ctes")
    return out.withColumn("certain", ~F.col(text).rlike(PLACEHOLDER))


def _owner() -> Column:
    return F.when(F.col("owner") == "", F.concat(F.lit("file:"), "path")).otherwise(F.concat(F.lit("func:"), "path", F.lit("::"), "owner"))


def _edges(df: DataFrame, src: Column, dst: Column, kind: str, via: str | None, provenance: Column) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), provenance.alias("provenance"), F.lit(via).cast("string").alias("via"))


def calls(rows: DataFrame) -> DataFrame:
    """src, dst: functions by the name that is called, all of that name but the caller itself; inferred, as a name is no proof."""
    known = rows.where("kind = 'function'").select(F.substring_index("name", ".", -1).alias("name"), F.concat(F.lit("func:"), "path", F.lit("::"), "name").alias("dst"))
    return rows.where("kind = 'call'").select(_owner().alias("src"), "name").join(known, "name").where("src <> dst").select("src", "dst").distinct()


def python_imports(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """path, target: the file that an import means, by the longest prefix of its dotted name that is a module, or the tail of one."""
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/", ".")
    own = paths.select(F.col("path").alias("target"), module.alias("module"))
    parts = F.split("module", "[.]")
    tails = own.select("target", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("cut", "prefix"))
    names = F.split("name", "[.]")
    heads = rows.where("kind = 'import'").select("path", "name", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "."))).alias("n", "prefix"))
    best = heads.join(tails, "prefix").where("path <> target").groupBy("path", "name").agg(F.min_by("target", F.struct(-F.col("n"), "cut", "target")).alias("target"))
    return best.select("path", "target").distinct()


def javascript_imports(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """path, target: the file that a relative import means: as written, with an extension, or an index file, in that order."""
    asked = rows.where("kind = 'import' and name like '.%'").select("path", "name")
    folder = F.when(F.contains("path", F.lit("/")), F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"), "name")).otherwise(F.col("name"))
    step = lambda done, p: F.when(p.isin("", "."), done).when((p == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    plain = F.array_join(F.aggregate(F.split(folder, "/"), F.array().cast("array<string>"), step), "/")
    endings = ["", *(f".{e}" for e in ("ts", "tsx", "js", "jsx", "mjs", "cjs")), *(f"/index.{e}" for e in ("ts", "tsx", "js", "jsx"))]
    tried = asked.withColumn("plain", plain).select("path", "name", F.posexplode(F.array(*[F.concat("plain", F.lit(e)) for e in endings])).alias("place", "target"))
    return tried.join(paths.select(F.col("path").alias("target")), "target").groupBy("path", "name").agg(F.min_by("target", "place").alias("target")).select("path", "target").distinct()


def graph(files: DataFrame, language: str = "python") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): files, what they define, what they import and call, and the tables that their SQL reads and writes."""
    rows, paths = scan(files, language), files.select("path")
    sure, guess = F.lit("extracted"), F.lit("inferred")
    made = rows.where("kind in ('function', 'class')").withColumn("id", F.concat(F.when(F.col("kind") == "class", "class:").otherwise("func:"), "path", F.lit("::"), "name"))
    nodes = paths.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("FILE").alias("type"), F.col("path").alias("name"), "path", F.lit(None).cast("long").alias("first_line"), F.lit(None).cast("long").alias("last_line"))
    nodes = nodes.union(made.select("id", F.upper("kind"), "name", "path", "first_line", "last_line"))
    sql = sql_tables(rows.where("kind = 'string'").where(looks_like_sql(F.col("text"))), "text").withColumn("provenance", F.when(F.col("certain"), "extracted").otherwise("inferred"))
    of = lambda c: sql.select(_owner().alias("src"), F.explode(F.transform(c, lambda t: F.concat(F.lit("table:"), t))).alias("dst"), "provenance")
    targets = (python_imports if language == "python" else javascript_imports)(rows, paths)
    parts = [
        _edges(made, F.concat(F.lit("file:"), "path"), F.col("id"), "CONTAINS", None, sure), _edges(targets, F.concat(F.lit("file:"), "path"), F.concat(F.lit("file:"), "target"), "IMPORTS", None, sure),
        _edges(calls(rows), F.col("src"), F.col("dst"), "CALLS", None, guess),
        _edges(of("reads"), F.col("src"), F.col("dst"), "DEPENDS_ON", "sql-in-code", F.col("provenance")), _edges(of("writes"), F.col("src"), F.col("dst"), "WRITES_TO", "sql-in-code", F.col("provenance")),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.union(p)
    return nodes, edges.groupBy("src", "dst", "type", "via").agg(F.min("provenance").alias("provenance")).select("src", "dst", "type", "provenance", "via")
