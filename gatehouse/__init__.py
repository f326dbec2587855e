"""Declarative row validation and sanitisation on Spark, and operators for training-data corpora (``gatehouse.llm``).

Names are imported when they are first used: a Python worker that runs a text operator never loads the validator.
"""

from importlib import import_module

_HOME = {
    "api": ("fails", "passes", "sanitize", "validate", "validator"), "functions.typesys": ("InvalidRule",), "plans.engine": ("Validator",),
    "plans.rulespec": ("compose_schemas", "define_fragment", "fragment", "has_fragment", "register_rule"),
    "results": ("MessageBag", "RecordResult", "ValidatedFrame", "ValidationException"),
}
_MODULE = {name: module for module, names in _HOME.items() for name in names}
_PARTS = frozenset({"api", "catalog", "functions", "operators", "plans", "results", "sources", "streaming"})

__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name in _MODULE:
        found = getattr(import_module(f".{_MODULE[name]}", __name__), name)
    elif name in _PARTS:
        import_module(".api", __name__)  # which loads the rules
        found = import_module(f".{name}", __name__)
    else:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    globals()[name] = found
    return found


def __dir__() -> list[str]:
    return [*__all__, *_PARTS]
