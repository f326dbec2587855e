"""Results: a lazily annotated DataFrame, the failures of one record, and the exception."""

from __future__ import annotations

import dataclasses
import html
import json
import re
from collections.abc import Callable, Iterator, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .plans.engine import Validator


class ValidationException(Exception):
    """Raised when rows fail and failures must raise. Code 422, like the HTTP status."""

    code = 422

    def __init__(self, errors: Mapping[str, list[str]], message: str = "The given data was invalid.") -> None:
        super().__init__(message)
        self.errors = {k: list(v) for k, v in errors.items()}

    def __str__(self) -> str:
        return "\n".join([self.args[0], *(f"{k}: {m}" for k, ms in self.errors.items() for m in ms)])

    def all_messages(self) -> list[str]:
        return [m for ms in self.errors.values() for m in ms]

    def error_count(self) -> int:
        return len(self.errors)

    def field_errors(self, name: str) -> list[str]:
        return self.errors.get(name, [])

    def first_field_error(self, name: str) -> str | None:
        return next(iter(self.errors.get(name, [])), None)

    def has_field_error(self, name: str) -> bool:
        return bool(self.errors.get(name))


class MessageBag(Mapping):
    """Messages by key, in order; changes give back the bag itself, selections a new one."""

    def __init__(self, messages: Mapping[str, list[str] | str] | None = None) -> None:
        self._own: dict[str, list[str]] = {}
        for k, v in (messages or {}).items():
            self.add_many(k, [v] if isinstance(v, str) else v)

    make = classmethod(lambda cls, messages: cls(messages))

    @classmethod
    def from_flat(cls, messages, default_key: str = "error") -> MessageBag:
        pairs = messages.items() if isinstance(messages, Mapping) else ((default_key, m) for m in messages)
        bag = cls()
        for k, m in pairs:
            bag.add(k, m)
        return bag

    def __getitem__(self, key: str) -> list[str]:
        return self._own.get(key, [])

    def __setitem__(self, key: str, messages) -> None:
        self.set(key, [messages] if isinstance(messages, str) else messages)

    def __delitem__(self, key: str) -> None:
        self.remove(key)

    def __contains__(self, key: object) -> bool:
        return bool(self._own.get(key))

    def __iter__(self) -> Iterator[str]:
        return iter(self._own)

    def __len__(self) -> int:
        return len(self._own)

    def __str__(self) -> str:
        return self.to_string()

    def add(self, key: str, message: str) -> MessageBag:
        self._own.setdefault(key, []).append(message)
        return self

    def add_many(self, key: str, messages) -> MessageBag:
        for m in messages:
            self.add(key, m)
        return self

    def set(self, key: str, messages) -> MessageBag:
        self._own[key] = list(messages)
        return self

    def remove(self, key: str) -> MessageBag:
        self._own.pop(key, None)
        return self

    def clear(self) -> MessageBag:
        self._own.clear()
        return self

    def merge(self, other: Mapping[str, list[str]]) -> MessageBag:
        for k, v in other.items():
            self.add_many(k, v)
        return self

    def all(self) -> dict[str, list[str]]:
        return {k: list(v) for k, v in self._own.items()}

    to_array = all

    def any(self) -> bool:
        return bool(self._own)

    is_not_empty = any

    def is_empty(self) -> bool:
        return not self._own

    def count(self) -> int:
        return len(self._own)

    def has(self, key: str) -> bool:
        return key in self

    def get(self, key: str, default=None) -> list[str]:
        return self._own.get(key, default or [])

    def first(self, key: str | None = None) -> str | None:
        return next(iter(self[key] if key is not None else self.flatten()), None)

    def last(self, key: str | None = None) -> str | None:
        return next(reversed(self[key] if key is not None else self.flatten()), None)

    def flatten(self) -> list[str]:
        return [m for v in self._own.values() for m in v]

    def message_count(self) -> int:
        return len(self.flatten())

    def only(self, keys) -> MessageBag:
        return MessageBag({k: v for k, v in self._own.items() if k in set(keys)})

    def without(self, keys) -> MessageBag:
        return MessageBag({k: v for k, v in self._own.items() if k not in set(keys)})

    def filter(self, keep: Callable[[str, str], bool]) -> MessageBag:
        kept = {k: [m for m in v if keep(m, k)] for k, v in self._own.items()}
        return MessageBag({k: v for k, v in kept.items() if v})

    def map(self, fn: Callable[[str, str], str]) -> MessageBag:
        return MessageBag({k: [fn(m, k) for m in v] for k, v in self._own.items()})

    def unique(self) -> MessageBag:
        return MessageBag({k: list(dict.fromkeys(v)) for k, v in self._own.items()})

    def to_simple(self) -> dict[str, str]:
        return {k: v[0] for k, v in self._own.items() if v}

    def to_json(self) -> str:
        return json.dumps(self._own, ensure_ascii=False)

    def to_string(self, fmt: str = "- :message", separator: str = "\n") -> str:
        return separator.join(fmt.replace(":message", m).replace(":key", k) for k, v in self._own.items() for m in v)

    def to_grouped_string(self, key_format: str = ":key:", message_format: str = " - :message", separator: str = "\n") -> str:
        lines = []
        for k, v in self._own.items():
            lines += [key_format.replace(":key", k), *(message_format.replace(":message", m).replace(":key", k) for m in v)]
        return separator.join(lines)

    def to_html(self, list_type: str = "ul") -> str:
        tag = "ol" if list_type == "ol" else "ul"
        return f"<{tag}>" + "".join(f"<li>{html.escape(m)}</li>" for m in self.flatten()) + f"</{tag}>"


class RecordResult:
    """One row's outcome, for inspection on the driver. Validated values are attributes too."""

    _OWN = frozenset({"failures", "errors", "validated", "typed"})

    def __init__(self, row: Row) -> None:
        self.failures = [f.asDict() for f in row["_failures"]]
        self.errors: dict[str, list[str]] = {}
        for f in self.failures:
            self.errors.setdefault(f["field"], []).append(f["message"])
        fields = row["_validated_fields"]
        self.validated = {k: v for k, v in row["validated"].asDict(recursive=True).items() if k in fields} if "validated" in row else {}
        self.typed = {k: v for k, v in row["typed"].asDict(recursive=True).items() if k in fields} if "typed" in row else {}

    def __getattr__(self, name: str):
        """A validated value as an attribute, None if there is none."""
        if name.startswith("__") or name in self._OWN:
            raise AttributeError(name)
        return self.get(name)

    def __setattr__(self, name: str, value) -> None:
        if name in self._OWN:
            super().__setattr__(name, value)
        else:
            self.validated[name] = value

    def __contains__(self, name: str) -> bool:
        return self.has(name)

    def passes(self) -> bool:
        return not self.errors

    def fails(self) -> bool:
        return bool(self.errors)

    def error_count(self) -> int:
        return len(self.errors)

    def all_errors(self) -> list[str]:
        return [m for v in self.errors.values() for m in v]

    def errors_for(self, name: str) -> list[str]:
        return self.errors.get(name, [])

    def failures_for(self, name: str) -> list[dict]:
        return [f for f in self.failures if f["field"] == name]

    def has_error(self, name: str) -> bool:
        return name in self.errors

    def first(self, name: str) -> str | None:
        return next(iter(self.errors_for(name)), None)

    def first_error(self, name: str | None = None) -> str | None:
        return self.first(name) if name else next(iter(self.all_errors()), None)

    def messages(self) -> MessageBag:
        return MessageBag(self.errors)

    def has(self, name: str) -> bool:
        return name in self.validated

    def get(self, name: str, default=None):
        return self.validated.get(name, default)

    def only(self, names) -> dict:
        return {k: v for k, v in self.validated.items() if k in set(names)}

    def without(self, names) -> dict:
        return {k: v for k, v in self.validated.items() if k not in set(names)}

    def safe(self, more=()) -> dict:
        return {**{k: None for k in more}, **self.validated}

    def map(self, fn) -> dict:
        return {k: fn(v, k) for k, v in self.validated.items()}

    def filter(self, keep) -> dict:
        return {k: v for k, v in self.validated.items() if keep(v, k)}

    def merge(self, other: RecordResult) -> RecordResult:
        for k, v in other.errors.items():
            self.errors.setdefault(k, []).extend(v)
        self.failures += other.failures
        self.validated |= other.validated
        self.typed |= other.typed
        return self

    def when_passes(self, fn) -> RecordResult:
        if self.passes():
            fn(self.typed)
        return self

    def when_fails(self, fn) -> RecordResult:
        if self.fails():
            fn(self.errors)
        return self

    def throw(self) -> RecordResult:
        if self.fails():
            raise ValidationException(self.errors)
        return self

    def to_dict(self) -> dict:
        return {"valid": self.passes(), "errors": self.errors, "failures": self.failures, "validated": self.validated, "typed": self.typed}

    def to_json(self) -> str:
        return json.dumps(self.errors, ensure_ascii=False)

    def to_dto(self, cls: type):
        """An object of the class, its fields filled by name in snake or camel case."""
        by_name = {re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", k).lower(): v for k, v in (self.typed or self.validated).items()}
        names = [f.name for f in dataclasses.fields(cls)] if dataclasses.is_dataclass(cls) else list(cls.__init__.__annotations__)
        return cls(**{n: by_name[key] for n in names if (key := re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", n).lower()) in by_name})


class ValidatedFrame:
    """The annotated rows. Everything stays lazy but what reads single records or raises."""

    def __init__(self, df: DataFrame, validator: Validator) -> None:
        self.df, self._validator = df, validator

    @property
    def _columns(self) -> list[str]:
        own = {"_failures", "_errors", "_valid", "_validated_fields", "validated", "typed"}
        return [c for c in self.df.columns if c not in own]

    def valid(self) -> DataFrame:
        """Rows that pass, with their own columns."""
        return self.df.where("_valid").select(*self._columns)

    def invalid(self) -> DataFrame:
        """Rows that fail, with their failures: the quarantine."""
        return self.df.where("NOT _valid").select(*self._columns, "_failures", "_errors")

    def typed(self) -> DataFrame:
        return self.df.where("_valid").select("typed.*")

    def validated(self) -> DataFrame:
        return self.df.where("_valid").select("validated.*")

    def failures(self, keys: list[str]) -> DataFrame:
        """One row for each failure."""
        return self.df.select(*keys, F.explode("_failures").alias("f")).select(*keys, "f.*")

    def errors_json(self, keys: list[str]) -> DataFrame:
        return self.df.select(*keys, F.to_json("_errors").alias("errors"))

    def report(self) -> DataFrame:
        """Failures counted by field and rule, with subtotals by field and in all."""
        flat = self.df.select(F.explode("_failures").alias("f")).select("f.field", "f.rule")
        return flat.rollup("field", "rule").agg(F.count("*").alias("failures"))

    def passes(self) -> bool:
        return self.df.where("NOT _valid").isEmpty()

    def fails(self) -> bool:
        return not self.passes()

    def records(self) -> Iterator[RecordResult]:
        """Outcomes one by one, a partition at a time."""
        return map(RecordResult, self.df.toLocalIterator())

    def dtos(self, cls: type | None = None) -> Iterator[object]:
        return (r.to_dto(cls or self._validator.dto) for r in self.records() if r.passes())

    def throw(self) -> ValidatedFrame:
        """Raise with the first failing row's errors if there is one."""
        for row in self.df.where("NOT _valid").limit(1).collect():
            raise ValidationException(RecordResult(row).errors)
        return self
