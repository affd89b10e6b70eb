"""Graphs of function templates: Serverless Framework, SAM and CloudFormation documents."""

from __future__ import annotations

import json
import re
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from .builder import Rows

# Kinds of events, and resource types.
HTTP, QUEUES = ("http", "httpapi", "api", "alb"), ("sqs", "sns", "kinesis", "stream", "dynamodb")
FUNCTIONS = ("AWS::Serverless::Function", "AWS::Lambda::Function")
QUEUE_KEYS = ("arn", "Queue", "Topic", "Stream", "topicName")


def load_template(path: str) -> dict:
    """A JSON or YAML template; short forms of intrinsic functions become their long ones."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.lower().endswith(".json"):
        return json.loads(text)
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def intrinsic(loader, suffix, node):
        build = {yaml.ScalarNode: loader.construct_scalar, yaml.SequenceNode: loader.construct_sequence}.get(type(node), loader.construct_mapping)
        value = build(node)
        return {"Ref": value} if suffix == "Ref" else {f"Fn::{suffix}": value.split(".") if suffix == "GetAtt" and isinstance(value, str) else value}

    Loader.add_multi_constructor("!", intrinsic)
    return yaml.load(text, Loader=Loader) or {}


def referred(value) -> str | None:
    """The name that a literal, a reference, an attribute, a substitution or an import means."""
    if isinstance(value, list):
        return referred(value[0]) if value else None
    if isinstance(value, dict):
        for key in ("Ref", "Fn::ImportValue"):
            if key in value:
                return str(value[key])
        if "Fn::GetAtt" in value:
            found = value["Fn::GetAtt"]
            return str(found[0] if isinstance(found, list) else found).split(".")[0]
        return referred(value["Fn::Sub"]) if "Fn::Sub" in value else None
    if not isinstance(value, str):
        return None
    if short := re.match(r"\s*!?(?:Ref|GetAtt)\s+([\w.]+)", value):
        return short.group(1).split(".")[0]
    holes = re.findall(r"\$\{([^}]+)\}", value)
    return re.split(r"[:.]", holes[-1])[-1] if holes else value


def handler_function(handler, code_uri=None, root: Path | None = None) -> str | None:
    """The id of the function that a handler names: in a module, or else in a package that is there."""
    if not isinstance(handler, str) or "." not in handler:
        return None
    module, _, name = handler.rpartition(".")
    base = PurePosixPath(code_uri if isinstance(code_uri, str) and not code_uri.startswith("s3://") else ".")
    paths = [str(base / (module.replace(".", "/") + end)) for end in (".py", "/__init__.py")]
    there = next((p for p in paths if root is not None and (root / p).exists()), paths[0])
    return f"func:{there}::{name}"


class _Template:
    def __init__(self, file: str, root: Path | None):
        self.rows, self.file, self.root = Rows(), file, root
        self.rows.node(f"file:{file}", "FILE", file, path=file)

    def table(self, name: str, scheme: str = "") -> str:
        shown = f"{scheme}://{name}" if scheme else name
        return self.rows.node(f"table:{shown.lower()}", "TABLE", shown)

    def function(self, name: str, handler, code_uri=None) -> str:
        id_ = self.rows.node(f"lambda:{name}", "LAMBDA", str(name), path=self.file)
        self.rows.edge(f"file:{self.file}", id_, "CONTAINS")
        if target := handler_function(handler, code_uri, self.root):
            self.rows.edge(id_, target, "DEPENDS_ON", "handler")
        return id_

    def event(self, id_: str, kind: str, spec) -> None:
        kind, fields = kind.lower(), spec if isinstance(spec, dict) else {}
        if kind in HTTP:
            if isinstance(spec, str) and " " in spec:
                method, path = spec.split(" ", 1)
            else:
                method, path = (next((fields[k] for k in keys if fields.get(k)), default) for keys, default in ((("method", "Method"), "ANY"), (("path", "Path"), "/")))
            name = f"{str(method).upper()} {path}"
            self.rows.edge(id_, self.rows.node(f"api:{name}", "API", name), "EXPOSES")
        elif kind == "s3":
            if bucket := referred(fields.get("bucket") or fields.get("Bucket") or (spec if isinstance(spec, str) else None)):
                self.rows.edge(id_, self.table(bucket, "s3"), "DEPENDS_ON", "event:s3")
        elif kind in QUEUES:
            if arn := referred(next((fields[k] for k in QUEUE_KEYS if fields.get(k)), spec)):
                self.rows.edge(id_, self.table(re.split(r"[:/]", arn)[-1], kind), "DEPENDS_ON", f"event:{kind}")

    def environment(self, id_: str, variables: dict) -> None:
        for key, value in (variables or {}).items():
            name, key = referred(value), str(key).upper()
            if name and key.endswith(("TABLE", "_TABLE_NAME")):
                self.rows.edge(id_, self.table(name), "DEPENDS_ON", "env")
            elif name and key.endswith("BUCKET"):
                self.rows.edge(id_, self.table(name, "s3"), "DEPENDS_ON", "env")

    def resources(self, found: dict) -> None:
        for name, resource in (found or {}).items():
            kind, properties = str((resource or {}).get("Type", "")), (resource or {}).get("Properties") or {}
            if kind == "AWS::DynamoDB::Table":
                for spelling in dict.fromkeys((referred(properties.get("TableName")) or name, name)):
                    self.table(spelling)
            elif kind == "AWS::S3::Bucket":
                self.table(referred(properties.get("BucketName")) or name, "s3")


def template_graph(spark: SparkSession, document: dict, file: str = "template.yaml", root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): functions, their handlers, the interfaces they serve, and the tables, buckets and queues they use."""
    t = _Template(file, Path(root) if root else None)
    everywhere = ((document.get("provider") or {}).get("environment")) or {}
    for name, f in (document.get("functions") or {}).items():
        id_ = t.function(name, f.get("handler"))
        for event in f.get("events") or []:
            for kind, spec in event.items() if isinstance(event, dict) else ():
                t.event(id_, kind, spec)
        t.environment(id_, everywhere | (f.get("environment") or {}))
    t.resources((document.get("resources") or {}).get("Resources"))
    t.resources(document.get("Resources"))
    for name, resource in (document.get("Resources") or {}).items():
        if (resource or {}).get("Type") not in FUNCTIONS:
            continue
        p = resource.get("Properties") or {}
        id_ = t.function(name, p.get("Handler"), p.get("CodeUri"))
        for event in (p.get("Events") or {}).values():
            t.event(id_, str(event.get("Type", "")), event.get("Properties") or {})
        t.environment(id_, (p.get("Environment") or {}).get("Variables"))
        for policy in p.get("Policies") or []:
            for rule in policy.values() if isinstance(policy, dict) else ():
                if isinstance(rule, dict) and (used := referred(rule.get("TableName"))):
                    t.rows.edge(id_, f"table:{used.lower()}", "DEPENDS_ON", "policy")
    return t.rows.frames(spark)
