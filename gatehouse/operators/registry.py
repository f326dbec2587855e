"""The table of rules: name, cost, message, parameters and the function that builds the predicate."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typesys import InvalidRule, Value, cast_param



def missing() -> Value:
    """A field that no row has."""
    return Value(F.lit(None), T.NullType(), F.lit(False))


@dataclass(frozen=True)
class Context:
    """What a rule sees: its field, the field's value and every other field."""

    name: str
    value: Value
    other: Callable[[str], Value]
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class RuleDef:
    name: str
    cost: int
    message: str
    build: Callable[..., Column]
    text_params: bool = False  # parameters are text; what reads as a number or boolean is a schema error
    raw: bool = False  # the whole tail is one parameter
    kind: str = "check"  # check, exclude or lookup

    def check_arity(self, params: tuple) -> None:
        try:
            inspect.signature(self.build).bind(None, *params)
        except TypeError as error:
            raise InvalidRule(f"rule {self.name}: {error}") from None


RULES: dict[str, RuleDef] = {}


def rule(name: str, cost: int, message: str, **more):
    """Register a function of a context and parameters as a rule."""

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        RULES[name] = RuleDef(name, cost, message, build, **more)
        return build

    return add


@dataclass(frozen=True)
class Rule:
    """A rule with its parameters, ready to build."""

    definition: RuleDef
    raw_params: tuple[str, ...]
    params: tuple

    @property
    def name(self) -> str:
        return self.definition.name

    @property
    def cost(self) -> int:
        return self.params[1] if self.name == "callback" and len(self.params) > 1 else self.definition.cost

    @property
    def template(self) -> str:
        return self.params[2].replace(":field", "{field}") if self.name == "callback" and len(self.params) > 2 else self.definition.message

    def predicate(self, context: Context) -> Column:
        return self.definition.build(context, *self.params)

    def default_message(self, label: str) -> str:
        shown = [*map(str, self.raw_params), "", "", "", ""]
        return self.template.format(*shown, field=label, all=", ".join(self.raw_params))


def make_rule(name: str, raw_params: tuple[str, ...] | list = ()) -> Rule:
    """Look up a rule, cast its parameters by their shape and check their number and types."""
    if name not in RULES:
        raise InvalidRule(f"unknown rule {name!r}")
    definition = RULES[name]
    raw_params = tuple(raw_params)
    if definition.raw:
        params = raw_params
    else:
        params = tuple(cast_param(p) if isinstance(p, str) else p for p in raw_params)
        if definition.text_params and any(not isinstance(p, str) for p in params):
            raise InvalidRule(f"rule {name} takes text, not {raw_params}")
    definition.check_arity(params)
    return Rule(definition, tuple(p if isinstance(p, str) else str(p) for p in raw_params), params)
