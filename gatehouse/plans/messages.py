"""Field labels, message templates and locales; only a row's own value makes a message a Column expression."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.registry import Rule


def normalize_index(field: str) -> str:
    """``a.0.b`` as ``a.*.b``."""
    return re.sub(r"\.\d+(?=\.|$)", ".*", field)


def wildcard_regex(pattern: str) -> re.Pattern:
    return re.compile("[^.]+".join(map(re.escape, pattern.split("*"))) + r"\Z")


def humanize(field: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in re.split(r"[_\-. ]+", field) if w)


class FieldAlias:
    """Labels of fields: exact, by normalised index, by wildcard, or made from the name."""

    def __init__(self, aliases: dict[str, str] | None = None) -> None:
        self._own: dict[str, str] = dict(aliases or {})

    def all(self) -> dict[str, str]:
        return dict(self._own)

    def clear(self) -> None:
        self._own.clear()

    def get(self, field: str) -> str:
        for key in (field, normalize_index(field)):
            if key in self._own:
                return self._own[key]
        return next((v for k, v in self._own.items() if "*" in k and wildcard_regex(k).match(field)), None) or humanize(field)

    def get_many(self, fields) -> dict[str, str]:
        return {f: self.get(f) for f in fields}

    def has(self, field: str) -> bool:
        return field in self._own

    def remove(self, field: str) -> None:
        self._own.pop(field, None)

    def remove_many(self, fields) -> None:
        for f in fields:
            self.remove(f)

    def set(self, field, alias: str | None = None) -> None:
        self._own.update(field if isinstance(field, dict) else {field: alias})

    def set_batch(self, aliases: dict[str, str], replace: bool = False) -> None:
        self._own = dict(aliases) if replace else self._own | aliases


#: The default English templates, used once a locale is chosen.
ENGLISH = {
    "required": "The :field field is required.", "string": "The :field must be a string.", "integer": "The :field must be an integer.",
    "numeric": "The :field must be a number.", "array": "The :field must be an array.", "boolean": "The :field field must be true or false.",
    "email": "The :field must be a valid email address.", "min": "The :field must be at least :min.", "max": "The :field may not be greater than :max.",
    "between": "The :field must be between :min and :max.", "size": "The :field must be :size.", "digits": "The :field must be :digits digits.",
    "digits_between": "The :field must be between :min and :max digits.", "same": "The :field and :other must match.",
    "different": "The :field and :other must be different.", "in": "The selected :field is invalid.", "not_in": "The selected :field is invalid.",
    "unique": "The :field has already been taken.", "exists": "The selected :field is invalid.", "*": "The :field field is invalid.",
}

#: Names of the parameters of each rule in templates.
PLACEHOLDERS = {
    "min": ("min",), "max": ("max",), "between": ("min", "max"), "size": ("size",), "digits": ("digits",), "digits_between": ("min", "max"), "min_digits": ("min",),
    "max_digits": ("max",), "decimal": ("min", "max"), "multiple_of": ("multiple",), "date_equals": ("date",), "before": ("date",), "before_or_equal": ("date",),
    "after": ("date",), "after_or_equal": ("date",), "date_format": ("format",), "regex": ("pattern",), "not_regex": ("pattern",), "unique": ("table", "column", "ignore"),
    "exists": ("table", "column"),
} | {r: ("other",) for r in ("same", "different", "gt", "gte", "lt", "lte", "in_array", "required_if_accepted", "required_if_declined", "exclude_with", "exclude_without")} | {
    r: ("other", "value")
    for r in (
        "required_if", "required_unless", "present_if", "present_unless", "missing_if", "missing_unless", "prohibited_if", "prohibited_unless", "exclude_if",
        "exclude_unless", "accepted_if", "declined_if",
    )
}


class Messages:
    """Templates by field and rule, and locale packs."""

    def __init__(self) -> None:
        self.custom: dict[str, str] = {}
        self.packs: dict[str, dict[str, str]] = {"en": ENGLISH}
        self.locale: str | None = None
        self.aliases = FieldAlias()

    def template(self, field: str, rule: Rule) -> str | None:
        plain = normalize_index(field)
        for key in (f"{field}.{rule.name}", f"{field}.*", f"*.{rule.name}", f"{plain}.{rule.name}", f"{plain}.*", field, plain, rule.name):
            if key in self.custom:
                return self.custom[key]
        for key in (f"{field}.{rule.name}", field):
            for pattern, text in self.custom.items():
                if "*" in pattern and wildcard_regex(pattern).match(key):
                    return text
        if self.locale is None:
            return None
        chain = [self.locale, self.locale.replace("-", "_"), self.locale.replace("_", "-"), re.split("[-_]", self.locale)[0], "en"]
        for pack in (self.packs[p] for p in dict.fromkeys(chain) if p in self.packs):
            for key in (rule.name, "*"):
                if key in pack:
                    return pack[key]
        return None

    def tokens(self, field: str, rule: Rule) -> dict[str, str]:
        out = {":key": field, ":rule": rule.name, ":values": ", ".join(rule.raw_params)}
        out |= {f":param{k}": p for k, p in enumerate(rule.raw_params, 1)}
        for name, p in zip(PLACEHOLDERS.get(rule.name, ()), rule.raw_params):
            out[f":{name}"] = self.aliases.get(p) if name == "other" else p
        return out

    def column(self, field: str, rule: Rule, label: Column | None, value: Column, key: Column | None = None) -> Column:
        """The message of a failure. ``label`` and ``key`` are given where they depend on an index."""
        text = self.template(field, rule)
        if text is None:
            text = rule.default_message(":field")
        tokens: dict[str, str | Column] = dict(self.tokens(field, rule))
        shown: str | Column = self.aliases.get(field) if label is None else label
        shown_value = F.coalesce(value, F.lit(""))
        tokens |= {":field": shown, ":attribute": shown, ":input": shown_value}
        tokens.setdefault(":value", shown_value)
        if key is not None:
            tokens[":key"] = key
        pattern = re.compile("|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True)))
        parts: list[str | Column] = []
        at = 0
        for m in pattern.finditer(text):
            parts += [text[at : m.start()], tokens[m[0]]]
            at = m.end()
        parts.append(text[at:])
        merged = reduce(lambda a, p: [*a[:-1], a[-1] + p] if a and isinstance(a[-1], str) and isinstance(p, str) else [*a, p], parts, [])
        columns = [F.lit(p) if isinstance(p, str) else p for p in merged if not isinstance(p, str) or p]
        return columns[0] if len(columns) == 1 else F.concat(*columns) if columns else F.lit("")
