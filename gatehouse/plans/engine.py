"""The validator: a schema of rules compiled into projections over a DataFrame, batch or streaming."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, sanitizers
from ..functions.typesys import WS, InvalidRule, Value, any_of, empty
from ..operators.lookup import Lookup, flag
from ..operators.registry import Context, Rule, missing
from ..results import ValidatedFrame
from .messages import Messages
from .rulespec import compose_schemas, fragment, parse_rules

FAILURE = "array<struct<field:string,rule:string,message:string,value:string>>"


@dataclass(frozen=True)
class Guarded:
    """A rule and, if it holds for some rows only, the condition: a function of the record."""

    rule: Rule
    condition: Callable[[Record], Column] | None = None


@dataclass
class FieldPlan:
    """What is to be done with one field: its rules in order of cost, and what their names imply."""

    name: str
    rules: list[Guarded] = field(default_factory=list)
    sanitizers: list = field(default_factory=list)
    cast: object = None

    def ordered(self) -> list[Guarded]:
        return sorted((g for g in self.rules if g.rule.definition.kind == "check" and g.rule.name not in ("nullable", "bail")), key=lambda g: g.rule.cost)

    def of_kind(self, kind: str) -> list[Guarded]:
        return [g for g in self.rules if g.rule.definition.kind == kind]

    def has(self, *names: str) -> bool:
        return any(g.rule.name in names for g in self.rules)

    @property
    def bails(self) -> bool:
        return self.has("bail")

    def forced(self) -> list[Guarded]:
        """Rules by whose names an absent or empty field is evaluated all the same."""
        return [g for g in self.rules if g.rule.name.startswith(("required", "present", "missing", "prohibit"))]

    def stats(self) -> dict:
        names = [g.rule.name for g in self.rules]
        return {
            "rules": len(names), "names": names, "optional": not any(n.startswith("required") for n in names), "bail": self.bails,
            "cheap": sum(g.rule.cost < 50 for g in self.rules), "medium": sum(50 <= g.rule.cost < 100 for g in self.rules),
            "expensive": sum(g.rule.cost >= 100 for g in self.rules),
        }


class Record:
    """Access to the fields of every row: columns, dotted paths into structs and maps, or a JSON payload."""

    def __init__(self, df: DataFrame, null_is_missing: bool = False, payload: str | None = None, types: Mapping[str, str] | None = None) -> None:
        self.schema, self.null_is_missing, self.payload, self.types = df.schema, null_is_missing, payload, dict(types or {})

    def __call__(self, name: str) -> Value:
        if self.payload is not None:
            return self._from_payload(name)
        if name in self.schema.names:
            return self._seen(F.col(f"`{name}`"), self.schema[name].dataType)
        head, _, rest = name.partition(".")
        if not rest or head not in self.schema.names:
            return missing()
        value = self._seen(F.col(f"`{head}`"), self.schema[head].dataType)
        return self.walk(value, rest)

    def walk(self, value: Value, path: str) -> Value:
        for part in path.split("."):
            if value.kind == "STRUCT" and part in value.dtype.names:
                value = self._seen(value.col[part], value.dtype[part].dataType, value.col.isNotNull())
            elif value.kind == "MAP":
                inside = F.coalesce(F.map_contains_key(value.col, part), F.lit(False))
                value = Value(F.try_element_at(value.col, F.lit(part)), value.dtype.valueType, inside)
            elif value.kind == "ARR" and part.isdigit():
                value = Value(F.get(value.col, F.lit(int(part))), value.dtype.elementType, F.coalesce(F.size(value.col) > int(part), F.lit(False)))
            else:
                return missing()
        return value

    def _seen(self, col: Column, dtype: T.DataType, parent: Column | None = None) -> Value:
        present = col.isNotNull() if self.null_is_missing else F.lit(True) if parent is None else parent
        return Value(col, dtype, present)

    def _from_payload(self, name: str) -> Value:
        column = F.col(self.payload)
        kind = self.schema[self.payload].dataType
        if isinstance(kind, T.MapType):
            return Value(F.try_element_at(column, F.lit(name)), kind.valueType, F.coalesce(F.map_contains_key(column, name), F.lit(False)))
        ddl = self.types.get(name, "string")
        parsed = F.try_parse_json(column)
        keys = parsed.try_cast("map<string,variant>")
        head, *rest = name.split(".")
        present = F.coalesce(F.map_contains_key(keys, head), F.lit(False))
        value = F.try_variant_get(parsed, "$." + ".".join([head, *rest]), ddl)
        return Value(value, T._parse_datatype_string(ddl), present if not rest else value.isNotNull())


class Validator:
    """A schema of rules over the rows of a DataFrame.

    ``rules`` maps fields to rule text, lists of rules, or definitions with ``rules``, ``sanitize``, ``cast`` and ``alias``.
    ``tables`` are the DataFrames that lookup rules ask by name.
    """

    def __init__(self, rules: Mapping, tables: Mapping[str, DataFrame] | None = None) -> None:
        if not rules:
            raise InvalidRule("a schema needs rules")
        self.schema: dict = {}
        self.tables = dict(tables or {})
        self.messages = Messages()
        self.sanitizers: dict[str, object] = {}
        self.casts: dict[str, object] = {}
        self.fail_fast, self.stop_on_first, self.raises, self.dto = True, False, False, None
        self.options: dict = {}
        self.single_wildcard = False
        self.null_is_missing, self.payload, self.payload_types = False, None, {}
        self._conditional: list[tuple[str, list[Rule], Callable[[Record], Column]]] = []
        self._add(rules)

    make = classmethod(lambda cls, rules, tables=None: cls(rules, tables))

    def _add(self, rules: Mapping) -> None:
        for name, given in rules.items():
            if not isinstance(name, str) or not isinstance(given, (str, list, tuple, Mapping, Rule)):
                raise InvalidRule(f"field {name!r} needs rules as text, a list or a definition")
            if isinstance(given, Mapping):
                if alias := given.get("alias"):
                    self.messages.aliases.set(name, alias)
                if "cast" in given:
                    self.casts[name] = given["cast"]
                if "sanitize" in given or "sanitizers" in given:
                    self.sanitizers[name] = given.get("sanitize", given.get("sanitizers"))
                given = given.get("rules", [])
            self.schema[name] = [*self.schema.get(name, []), *parse_rules(given)]

    # -- the builder

    def add_locale_pack(self, locale: str, messages: Mapping[str, str]) -> Validator:
        """A pack replaces the one of the same locale, and turns locale messages on."""
        self.messages.packs[locale] = dict(messages)
        self.messages.locale = self.messages.locale or "en"
        return self

    def set_locale_packs(self, packs: Mapping[str, Mapping[str, str]]) -> Validator:
        """All packs at once; turns locale messages on."""
        self.messages.packs = {k: dict(v) for k, v in packs.items()}
        self.messages.locale = self.messages.locale or "en"
        return self

    def set_locale(self, locale: str) -> Validator:
        self.messages.locale = locale
        return self

    def set_custom_messages(self, messages: Mapping[str, str]) -> Validator:
        self.messages.custom.update(messages)
        return self

    def set_field_aliases(self, aliases: Mapping[str, str]) -> Validator:
        self.messages.aliases.set(dict(aliases))
        return self

    def set_casts(self, new: Mapping) -> Validator:
        self.casts = dict(new)
        return self

    def set_sanitizers(self, new: Mapping) -> Validator:
        for name, pipeline in new.items():
            own = self.sanitizers.get(name)
            self.sanitizers[name] = pipeline if own is None else [*sanitizers.pipeline(own), *sanitizers.pipeline(pipeline)]
        return self

    def set_dto_class(self, dto: type | None) -> Validator:
        self.dto = dto
        return self

    def set_fail_fast(self, on: bool) -> Validator:
        self.fail_fast = on
        return self

    def set_stop_on_first_error(self, on: bool) -> Validator:
        self.stop_on_first = on
        return self

    def throw_on_failure(self, on: bool = True) -> Validator:
        self.raises = on
        return self

    def set_resolver(self, resolver: Callable[[str], bool]) -> Validator:
        self.options["resolver"] = resolver
        return self

    def set_input(self, null_is_missing: bool = False, payload: str | None = None, types: Mapping[str, str] | None = None) -> Validator:
        """How absence shows: never in typed columns unless null means missing, or by the keys of a map or JSON column."""
        self.null_is_missing, self.payload, self.payload_types = null_is_missing, payload, dict(types or {})
        return self

    def enable_nested_validation(self, flatten_all: bool = True) -> Validator:
        return self  # paths are always resolved against the schema; column pruning makes both modes alike

    def set_nested_flatten_mode(self, mode: str) -> Validator:
        if mode not in ("all", "required"):
            raise InvalidRule(f"invalid nested flatten mode: {mode}")
        return self  # column pruning makes both modes alike

    def set_compat_single_wildcard(self, on: bool = True) -> Validator:
        """Expand the first star of a path alone; what a further star names is then absent at every index."""
        self.single_wildcard = on
        return self

    def use_fragment(self, name: str, prefix: str = "") -> Validator:
        self._add(fragment(name, prefix))
        return self

    def register_rule(self, name: str, build, **more) -> Validator:
        from .rulespec import register_rule

        register_rule(name, build, **more)
        return self

    def sometimes(self, name: str, rules, condition: Callable[[Record], Column]) -> Validator:
        """More rules for a field in the rows where the condition, a Column of the record, holds."""
        self._conditional.append((name, parse_rules(rules), condition))
        return self

    def when(self, condition, then: Mapping | Callable[[], Mapping | None], otherwise: Mapping | Callable[[], Mapping | None] | None = None) -> Validator:
        """More rules by a condition: at once if it is a bool, else for the rows where it holds, and others for the rest."""
        branches = [(then, False), (otherwise, True)]
        for rules, negated in branches:
            rules = rules() if callable(rules) else rules
            if rules is None:
                continue
            if not isinstance(rules, Mapping):
                raise InvalidRule("a branch must give rules")
            if isinstance(condition, bool):
                if condition != negated:
                    self._add(rules)
                continue
            for name, given in rules.items():
                self.sometimes(name, given, (lambda r, n=negated: ~F.coalesce(condition(r), F.lit(False)) if n else condition(r)))
        return self

    # -- plans

    def plans(self) -> list[FieldPlan]:
        out = {n: FieldPlan(n, [Guarded(r) for r in rules], sanitizers.pipeline(self.sanitizers.get(n, [])), self.casts.get(n)) for n, rules in self.schema.items()}
        for name, rules, condition in self._conditional:
            out.setdefault(name, FieldPlan(name)).rules += [Guarded(r, condition) for r in rules]
        return list(out.values())

    def stats(self) -> dict:
        return {p.name: p.stats() for p in self.plans()}

    def introspection(self) -> dict:
        return {
            p.name: {"rules": [g.rule.name for g in p.rules], "optional": p.stats()["optional"], "implicit": bool(p.forced()),
                     "sanitizers": [str(s) for s in p.sanitizers], "cast": p.cast}
            for p in self.plans()
        }

    def export_schema(self, kind: str = "json_schema") -> dict:
        from .export import export

        return export(self, kind)

    # -- execution

    def sanitize(self, df: DataFrame) -> DataFrame:
        """The fields with their sanitizers applied, in one projection."""
        new = {}
        for name, steps in self.sanitizers.items():
            if name in df.columns:
                new[name] = sanitizers.apply(F.col(f"`{name}`"), df.schema[name].dataType, steps)
                continue
            head, _, rest = name.partition(".")
            if rest and head in df.columns:
                new[head] = sanitizers.apply_at(new.get(head, F.col(f"`{head}`")), df.schema[head].dataType, rest.split("."), steps)
        return df.withColumns(new) if new else df

    def validate(self, df: DataFrame) -> ValidatedFrame:
        """Rows with ``_failures``, ``_errors``, ``_valid``, ``_validated_fields``, ``validated`` and ``typed``. Lazy, unless failures must raise."""
        out = self._annotate(df)
        frame = ValidatedFrame(out, self)
        return frame.throw() if self.raises else frame

    def violations(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """One row for each failure, with the key columns. Where every rule can be pushed into the scan, rows that can't fail
        are filtered there first."""
        condition = self._pushable(df)
        out = self._annotate(df if condition is None else df.where(condition))
        # an inner explode would repeat the failures' whole expression in a filter of its own
        return out.select(*keys, F.explode_outer("_failures").alias("f")).where("f IS NOT NULL").select(*keys, "f.*")

    def _record(self, df: DataFrame) -> Record:
        return Record(df, self.null_is_missing, self.payload, self.payload_types)

    def _annotate(self, df: DataFrame) -> DataFrame:
        source = self.sanitize(df)
        record = self._record(source)
        plans = self.plans()
        flags: dict[tuple[str, Lookup], str] = {}
        for p in plans:
            for g in p.of_kind("lookup"):
                if g.rule.params[0] not in self.tables:
                    if self.tables:
                        raise InvalidRule(f"no lookup table {g.rule.params[0]!r}")
                    continue  # without lookup tables these rules pass
                if "*" in p.name:
                    raise InvalidRule(f"rule {g.rule.name} can't look up the elements of {p.name}")
                key = (p.name, Lookup.of(g.rule, p.name))
                if key not in flags:
                    flags[key] = f"__lookup{len(flags)}"
                    held = f"__value{len(flags)}"
                    source = flag(source.withColumn(held, record(p.name).col), held, key[1], self.tables, flags[key]).drop(held)
        steps: dict[str, Column] = {}
        kept: dict[str, tuple[Column, Value]] = {}
        for k, p in enumerate(plans):
            if "*" in p.name:
                steps[f"__f{k}"] = self._wildcard(record, p)
                continue
            failures, included = self._field(record, p, flags)
            steps[f"__f{k}"] = failures
            kept[p.name] = (included & (F.size(F.col(f"__f{k}")) == 0), record(p.name))
        source = source.withColumns(steps)
        arrays = [F.col(f"__f{k}") for k in range(len(plans))]
        none = F.expr(f"cast(array() as {FAILURE})")
        if self.stop_on_first:
            chain = F.when(F.size(arrays[0]) > 0, arrays[0])
            for a in arrays[1:]:
                chain = chain.when(F.size(a) > 0, a)
            merged = chain.otherwise(none)
        else:
            merged = F.concat(*arrays)
        source = source.withColumn("_failures", merged)
        failures = F.col("_failures")
        fields = F.array_distinct(F.transform(failures, lambda x: x["field"]))
        by_field = F.transform(fields, lambda f: F.transform(F.filter(failures, lambda x: x["field"] == f), lambda x: x["message"]))
        columns = {"_errors": F.map_from_arrays(fields, by_field), "_valid": F.size(failures) == 0}
        columns["_validated_fields"] = F.array_compact(F.array(*(F.when(ok, F.lit(n)) for n, (ok, _) in kept.items()))) if kept else F.expr("cast(array() as array<string>)")
        if kept:
            columns["validated"] = F.struct(*(F.when(ok, v.col).alias(n) for n, (ok, v) in kept.items()))
            columns["typed"] = F.struct(*(F.when(ok, casts.apply(v, self.casts[n])[0] if n in self.casts else v.col).alias(n) for n, (ok, v) in kept.items()))
        return source.withColumns(columns).drop(*(f"__f{k}" for k in range(len(plans))), *flags.values())

    def _failure(self, name: str, g: Guarded, value: Value, label: Column | None = None, key: Column | None = None) -> Column:
        shown = F.to_json(value.col) if value.kind in ("ARR", "MAP", "STRUCT") else value.col.cast("string")
        message = self.messages.column(name, g.rule, label, shown, key)
        parts = (F.lit(name) if key is None else key).alias("field"), F.lit(g.rule.name).alias("rule"), message.alias("message"), shown.alias("value")
        return F.struct(*parts)

    def _skipped(self, record: Record, p: FieldPlan, value: Value) -> Column:
        """Optional and absent or empty: no rule runs and the field is not validated."""
        forced = p.forced()
        if any(g.condition is None for g in forced):
            return F.lit(False)
        skip = ~value.present | empty(value)
        if p.has("filled"):
            skip = ~value.present
        return skip & ~any_of(g.condition(record) for g in forced) if forced else skip

    def _chain(self, p: FieldPlan, tests: list[tuple[Column, Column]]) -> Column:
        """Failures of the tests (does it fail, the failure): the first, or all without fail-fast."""
        none = F.expr(f"cast(array() as {FAILURE})")
        if not tests:
            return none
        if not (self.fail_fast or p.bails):
            return F.array_compact(F.array(*(F.when(fails, f) for fails, f in tests))).cast(FAILURE)
        chain = None
        for fails, f in tests:
            chain = F.when(fails, F.array(f)) if chain is None else chain.when(fails, F.array(f))
        return chain.otherwise(none).cast(FAILURE)

    def _tests(self, record: Record, p: FieldPlan, context: Context, label=None, key=None) -> list[tuple[Column, Column]]:
        out = []
        for g in p.ordered():
            fails = ~g.rule.predicate(context)
            if g.condition is not None:
                fails = F.coalesce(g.condition(record), F.lit(False)) & fails
            out.append((fails, self._failure(p.name, g, context.value, label, key)))
        return out

    def _field(self, record: Record, p: FieldPlan, flags: dict) -> tuple[Column, Column]:
        value = record(p.name)
        context = Context(p.name, value, record, self.options)
        tests = self._tests(record, p, context)
        lookups = sorted(p.of_kind("lookup"), key=lambda g: g.rule.name != "unique")
        late = []
        for g in lookups:
            column = flags.get((p.name, Lookup.of(g.rule, p.name)))
            if column is not None:
                fails = F.col(column) if g.rule.name == "unique" else ~F.col(column)
                late.append((fails if g.condition is None else F.coalesce(g.condition(record), F.lit(False)) & fails, self._failure(p.name, g, value)))
        excluded = any_of(~g.rule.predicate(context) & (F.lit(True) if g.condition is None else g.condition(record)) for g in p.of_kind("exclude"))
        skipped = self._skipped(record, p, value)
        none = F.expr(f"cast(array() as {FAILURE})")
        failures = self._chain(p, tests + late)
        return F.when(excluded | skipped, none).otherwise(failures), ~excluded & ~skipped

    def _wildcard(self, record: Record, p: FieldPlan) -> Column:
        """Failures at every index of a path with stars: nested transforms, each naming its index."""
        head, rest = p.name.split(".*", 1)
        root = record(head)
        none = F.expr(f"cast(array() as {FAILURE})")

        def at(value: Value, key: Column, label: Column, rest: str) -> Column:
            rest = rest.lstrip(".")
            before, star, after = rest.partition("*")
            inner = before.rstrip(".")
            if inner:
                parent = value.col.isNotNull()
                value = record.walk(value, inner)
                value = replace(value, present=value.present & parent)
                key = F.concat(key, F.lit(f".{inner}"))
                label = F.concat(label, F.lit(f" {self._human(inner)}"))
            if star and not self.single_wildcard:
                return over(value, key, label, after)
            if star:
                value, key, label = missing(), F.concat(key, F.lit(f".*{after}")), F.concat(label, F.lit(f" *{after}"))
            exact = self.messages.aliases.get(p.name) if self.messages.aliases.has(p.name) else None
            shown = F.lit(exact) if exact else label
            context = Context(p.name, value, lambda n: record(n), self.options)
            return F.when(self._skipped(record, p, value), none).otherwise(self._chain(p, self._tests(record, p, context, shown, key)))

        def over(value: Value, key: Column, label: Column, rest: str) -> Column:
            if value.kind != "ARR":
                return none
            element = value.dtype.elementType

            def one(x: Column, i: Column) -> Column:
                k = i.cast("string")
                return at(Value(x, element, F.lit(True)), F.concat(key, F.lit("."), k), F.concat(label, F.lit(" "), k), rest)

            return F.coalesce(F.flatten(F.transform(value.col, one)), none)

        return over(root, F.lit(head), F.lit(self._human(head)), rest)

    @staticmethod
    def _human(path: str) -> str:
        from .messages import humanize

        return humanize(path)

    def _pushable(self, df: DataFrame) -> Column | None:
        """A disjunction that holds for every row that can fail, in terms that scans understand; None if some rule has none."""
        if self._conditional or self.sanitizers or self.payload or self.stop_on_first:
            return None
        out: list[Column] = []
        for p in self.plans():
            if p.name not in df.columns:
                return None
            c, v = F.col(f"`{p.name}`"), Value(F.col(f"`{p.name}`"), df.schema[p.name].dataType, F.lit(True))
            for g in p.rules:
                name, params = g.rule.name, g.rule.params
                if name in ("nullable", "bail") or name == "numeric" and v.kind in ("INT", "FLT") or name == "integer" and v.kind == "INT" or name == "string" and v.kind == "STR":
                    continue
                if name == "required":  # a text fails if it is blank, so what may be blank must pass the filter
                    out += [c.isNull(), *((c == "", *(c.startswith(x) for x in WS)) if v.kind == "STR" else ())]
                elif name == "min" and v.kind in ("INT", "FLT"):
                    out.append(c < F.lit(params[0]))
                elif name == "max" and v.kind in ("INT", "FLT"):
                    out.append(c > F.lit(params[0]))
                elif name == "between" and v.kind in ("INT", "FLT"):
                    out += [c < F.lit(params[0]), c > F.lit(params[1])]
                elif name == "in" and v.kind in ("INT", "STR") and all(isinstance(x, int if v.kind == "INT" else str) for x in params):
                    out.append(~c.isin(list(params)))
                elif name == "regex" and v.kind == "STR" and (starts := beginnings(params[0])):
                    out.append(~reduce(lambda a, b: a | b, (c.startswith(x) for x in starts)))
                else:
                    return None
            if p.has("required"):
                out.append(c.isNull())
        return reduce(lambda a, b: a | b, out) if out else None


def beginnings(pattern: str, most: int = 64) -> list[str] | None:
    """The beginnings that an expression amounts to if it is an anchor and then letters, digits, marks or classes of these; else None."""
    body = re.fullmatch(r"/\^((?:\[(?:\w-\w|\w)+\]|[\w :,@#%&=!~-])+)/", pattern, re.A)
    if body is None:
        return None
    out = [""]
    for part in re.findall(r"\[[^\]]+\]|.", body[1]):
        chars = [part]
        if len(part) > 1:
            ranges = re.findall(r"(\w)-(\w)|(\w)", part[1:-1], re.A)
            chars = [chr(c) for a, b, one in ranges for c in (range(ord(a), ord(b) + 1) if a else [ord(one)])]
        if len(out) * len(chars) > most:
            return None
        out = [x + c for x in out for c in chars]
    return out


__all__ = ["FieldPlan", "Record", "Validator", "compose_schemas"]
