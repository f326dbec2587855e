"""Rule text to rules: ``required|in:a,b|regex:/x|y/``."""

from __future__ import annotations

import re
from collections.abc import Mapping

from ..functions.typesys import InvalidRule
from ..operators import checks, lookup, presence, uploads  # noqa: F401  (registers the rules)
from ..operators.registry import RULES, Rule, RuleDef, make_rule

_RAW_TAIL = ("regex", "not_regex", "date_format")


def split_rules(text: str) -> list[str]:
    """Parts between bars, except bars inside a pattern's delimiters."""
    out, at = [], 0
    while at <= len(text):
        head = re.compile(r"\s*(not_regex|regex):").match(text, at)
        if head and head.end() < len(text):
            opening = text[head.end()]
            close = {"(": ")", "[": "]", "{": "}", "<": ">"}.get(opening, opening)
            k = head.end() + 1
            while k < len(text) and text[k] != close:
                k += 2 if text[k] == "\\" else 1
            end = text.find("|", k + 1)
        else:
            end = text.find("|", at)
        end = len(text) if end < 0 else end
        if part := text[at:end].strip():
            out.append(part)
        at = end + 1
    return out


def parse_rule(text: str) -> Rule:
    name, _, tail = text.partition(":")
    name = name.strip()
    if name in _RAW_TAIL:
        return make_rule(name, (tail,) if tail else ())
    params = [p.strip() for p in tail.split(",")] if tail else []
    if name != "unique":
        params = [p for p in params if p != ""]
    return make_rule(name, params)


def parse_rules(rules) -> list[Rule]:
    """Rules of a pipe string, a list of strings and Rule objects, or one Rule."""
    if isinstance(rules, str):
        return [parse_rule(p) for p in split_rules(rules)]
    if isinstance(rules, Rule):
        return [rules]
    if isinstance(rules, (list, tuple)):
        out: list[Rule] = []
        for r in rules:
            if isinstance(r, (list, tuple)):
                out.append(make_rule(r[0], r[1:]))
            else:
                out += parse_rules(r)
        return out
    raise InvalidRule(f"rules must be text or a list, not {type(rules).__name__}")


def register_rule(name: str, build, cost: int = 50, message: str = "The {field} field is invalid.", **more) -> None:
    """Add a rule of one's own: a function of a context and parameters that gives a boolean Column."""
    RULES[name] = RuleDef(name, cost, message.replace(":field", "{field}"), build, **more)


def rule_names() -> list[str]:
    return sorted(RULES)


_FRAGMENTS: dict[str, dict] = {}


def define_fragment(name: str, rules: Mapping) -> None:
    _FRAGMENTS[name] = dict(rules)


def fragment(name: str, prefix: str = "") -> dict:
    if name not in _FRAGMENTS:
        raise InvalidRule(f"no fragment {name!r}")
    return {(f"{prefix.rstrip('.')}.{k}" if prefix else k): v for k, v in _FRAGMENTS[name].items()}


def has_fragment(name: str) -> bool:
    return name in _FRAGMENTS


def compose_schemas(*schemas: Mapping) -> dict:
    """Schemas merged field by field; the rules of a field are appended."""
    out: dict = {}
    for schema in schemas:
        for f, rules in schema.items():
            if f not in out:
                out[f] = rules
            elif isinstance(rules, Mapping) or isinstance(out[f], Mapping):
                a, b = (x if isinstance(x, Mapping) else {"rules": x} for x in (out[f], rules))
                out[f] = {**a, **b, "rules": [*_as_list(a.get("rules", [])), *_as_list(b.get("rules", []))]}
            else:
                out[f] = [*_as_list(out[f]), *_as_list(rules)]
    return out


def _as_list(rules) -> list:
    return split_rules(rules) if isinstance(rules, str) else list(rules) if isinstance(rules, (list, tuple)) else [rules]
