"""Table and column lineage of SQL text, read off the logical plan that Spark's own parser makes.

Only projections carry column lineage; predicates, join and sort keys don't. Names of common table expressions shadow tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Lineage:
    target: str | None = None
    kind: str | None = None
    sources: list[str] = field(default_factory=list)
    columns: dict[str, set[tuple[str, str]]] = field(default_factory=dict)


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _last(attribute) -> str:
    return (_seq(attribute.nameParts())[-1] if hasattr(attribute, "nameParts") and _kind(attribute) == "UnresolvedAttribute" else attribute.name()).lower()


def _parts(ids) -> str:
    return ".".join(_seq(ids)).lower()


class _Reader:
    def __init__(self, schema: dict[str, list[str]]):
        self.schema = schema
        self.tables: dict[str, None] = {}

    def sources(self, plan, ctes: frozenset = frozenset()) -> None:
        kind = _kind(plan)
        if kind == "UnresolvedRelation":
            name = _parts(plan.multipartIdentifier())
            if name not in ctes:
                self.tables[name] = None
            return
        if kind == "UnresolvedWith":
            for pair in _seq(plan.cteRelations()):
                self.sources(pair._2(), ctes)
                ctes |= {pair._1().lower()}
        for e in _seq(plan.expressions()):
            self._in_expression(e, ctes)
        for child in _seq(plan.children()):
            self.sources(child, ctes)

    def _in_expression(self, e, ctes: frozenset) -> None:
        if _kind(e) in ("ScalarSubquery", "ListQuery", "Exists", "InSubquery"):
            if hasattr(e, "plan") and _kind(e) != "InSubquery":
                self.sources(e.plan(), ctes)
        for child in _seq(e.children()):
            self._in_expression(child, ctes)

    # a relation in scope: alias -> {column -> leaves} or, for a table of unknown columns, its name
    def output(self, plan, ctes: dict) -> tuple[dict, list]:
        """(columns in order -> leaves, scope) of a plan."""
        kind = _kind(plan)
        if kind == "UnresolvedRelation":
            name = _parts(plan.multipartIdentifier())
            if name in ctes:
                return ctes[name], [(name, ctes[name], None)]
            own = {c: {(name, c)} for c in self.schema.get(name, [])}
            return own, [(name.rsplit(".", 1)[-1], own, None if own else name)]
        if kind == "SubqueryAlias":
            own, scope = self.output(plan.child(), ctes)
            base = scope[0][2] if len(scope) == 1 else None
            return own, [(plan.alias().lower(), own, base)]
        if kind == "UnresolvedWith":
            ctes = dict(ctes)
            for pair in _seq(plan.cteRelations()):
                ctes[pair._1().lower()] = self.output(pair._2(), ctes)[0]
            return self.output(plan.child(), ctes)
        if kind in ("Project", "Aggregate"):
            _, scope = self.output(plan.child(), ctes)
            items = plan.projectList() if kind == "Project" else plan.aggregateExpressions()
            own: dict = {}
            for e in _seq(items):
                own |= self.item(e, scope, ctes)
            return own, [("", own, None)]
        children = _seq(plan.children())
        if kind in ("Union", "Intersect", "Except"):
            each = [self.output(c, ctes)[0] for c in children]
            own = {c: set().union(*(list(x.values())[i] for x in each if i < len(x))) for i, c in enumerate(each[0])}
            return own, [("", own, None)]
        if kind == "Generate":
            own, scope = self.output(plan.child(), ctes)
            leaves = set().union(*(self.leaves(e, scope, ctes) for e in _seq(plan.generator().children())), set())
            made = {_last(a): set(leaves) for a in _seq(plan.generatorOutput())}
            alias = plan.qualifier().get().lower() if plan.qualifier().isDefined() else ""
            return {**own, **made}, [*scope, (alias, made, None)]
        if kind == "Pivot":
            return self.pivoted(plan, ctes)
        if kind == "Unpivot":
            return self.unpivoted(plan, ctes)
        own, scope = {}, []
        for c in children:
            o, s = self.output(c, ctes)
            own, scope = {**o, **own}, scope + s
        if kind == "Join" and _kind(plan.joinType()) == "UsingJoin":
            # an unqualified column of the list is both sides' one
            shared = [c.lower() for c in _seq(plan.joinType().usingColumns())]
            both = {c: set().union(*(self.named(c, [s]) for s in scope)) for c in shared}
            return {**own, **both}, [("", both, None), *scope]
        return own, scope

    def pivoted(self, plan, ctes: dict) -> tuple[dict, list]:
        """The columns that are neither aggregated nor pivoted, and one a value (and aggregate)."""
        own, scope = self.output(plan.child(), ctes)
        measures = [(self.alias(a), self.leaves(a, scope, ctes)) for a in _seq(plan.aggregates())]
        used = {_last(x) for e in (*_seq(plan.aggregates()), plan.pivotColumn()) for x in self.attributes(e)}
        out = {c: v for c, v in own.items() if c not in used}
        for value in _seq(plan.pivotValues()):
            name = self.alias(value) or re.sub(r"'", "", value.toString()).lower()
            for alias, leaves in measures:
                out[name if len(measures) == 1 else f"{name}_{alias}"] = set(leaves)
        return out, [("", out, None)]

    def unpivoted(self, plan, ctes: dict) -> tuple[dict, list]:
        """The columns kept, the one of names (from nothing), and those of values (from all that are turned)."""
        own, scope = self.output(plan.child(), ctes)
        groups = [g for section in _seq(plan.values().get()) for g in _seq(section)] if plan.values().isDefined() else []
        turned = {_last(x) for e in groups for x in self.attributes(e)}
        leaves = set().union(*(own.get(c) or self.named(c, scope) for c in turned), set())
        out = {c: v for c, v in own.items() if c not in turned}
        out[plan.variableColumnName().lower()] = set()
        out |= {c.lower(): set(leaves) for c in _seq(plan.valueColumnNames())}
        return out, [("", out, None)]

    def attributes(self, e) -> list:
        return [e] if _kind(e) == "UnresolvedAttribute" else [x for c in _seq(e.children()) for x in self.attributes(c)]

    @staticmethod
    def alias(e) -> str:
        return e.name().lower() if _kind(e) == "Alias" else ""

    @staticmethod
    def named(name: str, near: list) -> set:
        """The leaves of a column of these relations; of one table of unknown columns, its column of that name."""
        for _, own, _ in near:
            if name in own:
                return set(own[name])
        bases = [b for _, _, b in near if b]
        return {(bases[0], name)} if len(near) == 1 and bases else set()

    def item(self, e, scope: list, ctes: dict) -> dict:
        kind = _kind(e)
        if kind == "UnresolvedStar":
            target = e.target()
            only = _seq(target.get())[-1].lower() if target.isDefined() else None
            out: dict = {}
            for alias, own, _ in scope:  # the first relation that has a name gives it
                if only in (None, alias):
                    out |= {c: set(v) for c, v in own.items() if c not in out}
            return out
        if kind == "Alias":
            return {e.name().lower(): self.leaves(e.child(), scope, ctes)}
        if kind == "UnresolvedAlias":
            return self.item(e.child(), scope, ctes)
        if kind == "UnresolvedAttribute":
            return {_seq(e.nameParts())[-1].lower(): self.leaves(e, scope, ctes)}
        return {re.sub(r"'", "", e.toString()).lower(): self.leaves(e, scope, ctes)}

    def leaves(self, e, scope: list, ctes: dict) -> set:
        kind = _kind(e)
        if kind == "UnresolvedAttribute":
            *qualifier, name = [p.lower() for p in _seq(e.nameParts())]
            return self.named(name, [s for s in scope if not qualifier or s[0] == qualifier[-1]])
        if kind == "ScalarSubquery":
            return set().union(*self.output(e.plan(), ctes)[0].values())
        if kind == "WindowExpression":
            return self.leaves(e.windowFunction(), scope, ctes)
        if kind == "UnresolvedWindowExpression":
            return self.leaves(e.child(), scope, ctes)
        return set().union(*(self.leaves(c, scope, ctes) for c in _seq(e.children())), set())


def _parse(spark: SparkSession, sql: str):
    """The plan; where Spark's own quoting can't be it, double quotes outside of strings are read as those of names."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        return parser.parsePlan(sql)
    except Exception:
        quoted = re.sub(r"'(?:[^']|'')*'|\"((?:[^\"]|\"\")*)\"", lambda m: m.group() if m.group(1) is None else "`" + m.group(1).replace('""', '"') + "`", sql)
        if quoted == sql:
            raise
        return parser.parsePlan(quoted)


def lineage(spark: SparkSession, sql: str, schema: dict[str, list[str]] | None = None) -> Lineage:
    """What a statement reads and writes, and where each output column comes from. Raises if Spark can't parse it."""
    plan = _parse(spark, sql)
    kind = _kind(plan)
    out, query = Lineage(), plan
    if kind in ("CreateTableAsSelect", "ReplaceTableAsSelect"):
        out.kind, query = "TABLE", plan.query()
        out.target = _parts(plan.name().nameParts())
    elif kind in ("CreateView", "CreateViewCommand"):
        out.kind, query = "VIEW", plan.query() if kind == "CreateView" else plan.plan()
        out.target = _parts(plan.child().nameParts()) if kind == "CreateView" else plan.name().table().lower()
    elif kind == "InsertIntoStatement":
        out.kind, query = "INSERT", plan.query()
        out.target = _parts(plan.table().multipartIdentifier())
    reader = _Reader({t.lower(): [c.lower() for c in cs] for t, cs in (schema or {}).items()})
    reader.sources(query)
    out.sources = list(reader.tables)
    out.columns = reader.output(query, {})[0]
    return out
