"""Export of a schema as JSON Schema, as an OpenAPI component, or for inspection."""

from __future__ import annotations

from pyspark.sql import types as T

from ..functions.typesys import InvalidRule
from ..operators.registry import Rule

VENDOR = "x-gatehouse"
#: Formats by rule.
FORMATS = {"email": "email", "uuid": "uuid", "url": "uri", "active_url": "uri", "date": "date-time", "ip": "ip"}


def _type(rules: list[Rule]) -> str:
    names = {r.name for r in rules}
    for wanted, kind in (({"array", "is_list"}, "array"), ({"integer"}, "integer"), ({"numeric", "decimal"}, "number"), ({"boolean"}, "boolean")):
        if names & wanted:
            return kind
    return "string"


def _number(raw: str):
    value = float(raw)
    return int(value) if value.is_integer() and "." not in raw else value


def _bounds(kind: str) -> tuple[str, str]:
    return {"string": ("minLength", "maxLength"), "array": ("minItems", "maxItems")}.get(kind, ("minimum", "maximum"))


def property_of(rules: list[Rule]) -> dict:
    kind = _type(rules)
    out: dict = {"type": kind}
    low, high = _bounds(kind)
    for r in rules:
        p = r.raw_params
        if r.name == "date_format":
            out["format"] = "date" if p[0] == "Y-m-d" else "date-time"
        elif r.name in FORMATS:
            out.setdefault("format", f"ipv{p[0][1]}" if r.name == "ip" and p and p[0] in ("v4", "v6") else FORMATS[r.name])
        elif r.name in ("min", "max", "between", "size"):
            if r.name in ("min", "between", "size"):
                out[low] = _number(p[0])
            if r.name in ("max", "between", "size"):
                out[high] = _number(p[-1])
        elif r.name in ("in", "not_in"):
            out |= {"enum": list(p)} if r.name == "in" else {"not": {"enum": list(p)}}
        elif r.name == "digits":
            out["pattern"] = f"^\\d{{{p[0]}}}$"
        elif r.name == "digits_between":
            out["pattern"] = f"^\\d{{{p[0]},{p[1]}}}$"
        elif r.name in ("min_digits", "max_digits"):
            out["pattern"] = f"^\\d{{{p[0]},}}$" if r.name == "min_digits" else f"^\\d{{0,{p[0]}}}$"
        elif r.name == "multiple_of":
            out["multipleOf"] = _number(p[0])
        elif r.name == "distinct":
            out["uniqueItems"] = True
        elif r.name == "regex":
            end = p[0].rfind({"(": ")", "[": "]", "{": "}", "<": ">"}.get(p[0][0], p[0][0]))
            out["pattern"] = p[0][1:end]
    if any(r.name == "nullable" for r in rules):
        out["type"] = [kind, "null"]
    return out


def json_schema(validator) -> dict:
    root: dict = {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": {}}
    for name, rules in validator.schema.items():
        prop = property_of(rules)
        for key, table in (("sanitizers", validator.sanitizers), ("cast", validator.casts)):
            if name in table:
                prop[f"{VENDOR}-{key}"] = table[name]
        required = any(r.name == "required" for r in rules)
        node, parts = root, name.split(".")
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part == "*":
                node["type"] = "array"
                node.pop("properties", None)
                node = node.setdefault("items", {"type": "object"}) if not last else node
                if last:
                    node["items"] = prop
                continue
            node.setdefault("type", "object")
            if required and part not in node.setdefault("required", []):
                node["required"].append(part)
            properties = node.setdefault("properties", {})
            if last:
                properties[part] = {**properties.get(part, {}), **prop}
            else:
                node = properties.setdefault(part, {"type": "object"})
    return root


def struct_type(validator) -> T.StructType:
    """The Spark schema that a schema of rules implies, for reading untyped sources."""
    kinds = {"array": T.ArrayType(T.StringType()), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}

    def build(tree: dict) -> T.StructType:
        return T.StructType([T.StructField(n, build(v) if isinstance(v, dict) and "*" not in v else T.ArrayType(build(v["*"]) if isinstance(v["*"], dict) else v["*"]) if isinstance(v, dict) else v) for n, v in tree.items()])

    tree: dict = {}
    for name, rules in validator.schema.items():
        *path, leaf = name.split(".")
        node = tree
        for part in path:
            if not isinstance(node.get(part), dict):
                node[part] = {}
            node = node[part]
        if not isinstance(node.get(leaf), dict):
            node[leaf] = kinds[_type(rules)]
    return build(tree)


def export(validator, kind: str) -> dict:
    if kind == "json_schema":
        return json_schema(validator)
    if kind == "openapi":
        schema = json_schema(validator)
        schema.pop("$schema")
        return {"openapi": "3.1.0", "components": {"schemas": {"Payload": schema}}}
    if kind == "introspection":
        return validator.introspection()
    raise InvalidRule(f"unknown schema format {kind!r}")
