"""Queries of the validator's operators over the sample tables, each with its SQL.

An entry applies one rule or sanitizer to columns derived from a table; the derived columns and the expected
outcome are plain SQL, so the same definitions run on either engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import casts, sanitizers
from .functions.typesys import Value
from .operators.lookup import composite_exists
from .operators.registry import Context, make_rule
from .plans import paths
from .plans.engine import Record, Validator
from .plans.rulespec import parse_rule

Sql = str | tuple[str, str]  # one text for both engines, or one for Spark and one for DuckDB


def _pick(sql: Sql, which: int) -> str:
    return sql if isinstance(sql, str) else sql[which]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class RuleCase:
    """A rule on the column ``v``, beside other columns; ``ok`` is SQL for whether it passes (None: SQL can't say)."""

    rule: str
    table: str
    key: str
    v: Sql
    ok: str | None
    others: dict[str, Sql] = field(default_factory=dict)
    null_is_missing: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = [f"{_pick(x, 0)} AS {n}" for n, x in {"v": self.v, **self.others}.items()]
        df = _table(spark, sf_dir, self.table).selectExpr(*self.key.split(", "), *(c.replace("{sf_dir}", sf_dir) for c in columns))
        record = Record(df, self.null_is_missing)
        options = {"resolver": lambda host: host.endswith(".com")}
        return df.select(*self.key.split(", "), parse_rule(self.rule).predicate(Context("v", record("v"), record, options)).alias("ok"))

    def sql(self) -> str | None:
        if self.ok is None:
            return None
        columns = ", ".join(f"{_pick(x, 1)} AS {n}" for n, x in {"v": self.v, **self.others}.items())
        return f"SELECT {self.key}, coalesce(CAST(({self.ok}) AS BOOLEAN), false) AS ok FROM (SELECT {self.key}, {columns} FROM {self.table})"


_MAYBE = "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN ' ' ELSE o_orderpriority END"
_MAYBE2 = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE o_orderstatus END"
_EMPTY = "(v IS NULL OR trim(v) = '')"
_FULL = f"NOT {_EMPTY}"


def _empty(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def _orders(rule: str, v: Sql, ok: str | None, missing: bool = False, **others: Sql) -> RuleCase:
    return RuleCase(rule, "orders", "o_orderkey", v, ok, others, missing)


def _maybe(rule: str, ok: str) -> RuleCase:
    return _orders(rule, _MAYBE, ok, True, o="o_orderstatus", a=_MAYBE2, b="CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END")


def _parts(rule: str, ok: str, v: Sql = "p_name") -> RuleCase:
    return RuleCase(rule, "part", "p_partkey", v, ok)


_DAY: Sql = (
    "CASE WHEN o_orderkey % 7 = 0 THEN 'not a day' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'not a day' ELSE strftime(o_orderdate, '%Y-%m-%d') END",
)
_NUMBER: Sql = "CASE o_orderkey % 6 WHEN 0 THEN '12.50' WHEN 1 THEN '-123' WHEN 2 THEN ' 42 ' WHEN 3 THEN '1e3' WHEN 4 THEN 'x17' ELSE cast(o_orderkey AS STRING) END"
_IS_NUMBER = r"regexp_matches(v, '^[ \t\n]*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t\n]*$')"
_SIZE = f"(CASE WHEN {_IS_NUMBER} THEN CAST(trim(v) AS DOUBLE) ELSE length(v) END)"
_IP: Sql = "concat_ws('.', cast(o_orderkey % 300 AS STRING), '168', cast(o_orderkey % 256 AS STRING), '7')"
_UPLOAD: Sql = (
    "named_struct('name', if(o_orderkey % 4 = 0, '../evil.php', 'avatar.png'), 'type', if(o_orderkey % 3 = 0, 'text/plain', 'image/png'), 'size', o_orderkey * 100, "
    "'tmp_name', if(o_orderkey % 2 = 0, '{sf_dir}/region.parquet', '/nowhere/at/all'), 'error', cast(o_orderkey % 5 % 2 AS INT))",
    "struct_pack(name := if(o_orderkey % 4 = 0, '../evil.php', 'avatar.png'), \"type\" := if(o_orderkey % 3 = 0, 'text/plain', 'image/png'), size := o_orderkey * 100, "
    "tmp_name := if(o_orderkey % 2 = 0, 'there', 'not there'), error := o_orderkey % 5 % 2)",
)
# uploads with content: pictures of many sizes in three formats, texts, other files, empty files, and none at all
_LOW, _HIGH = "o_orderkey % 600", "o_custkey % 400"
_BYTES = (
    "CASE o_orderkey % 7 "
    f"WHEN 0 THEN unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex({_LOW}), 8, '0'), lpad(hex({_HIGH}), 8, '0'), '0806000000')) "
    f"WHEN 1 THEN unhex(concat('474946383961', lpad(hex({_LOW} % 256), 2, '0'), '01', lpad(hex({_HIGH} % 256), 2, '0'), '00F70000')) "
    f"WHEN 2 THEN unhex(concat('FFD8FFE000104A46494600010100000100010000FFC0001108', lpad(hex({_HIGH}), 4, '0'), lpad(hex({_LOW}), 4, '0'), '03012200')) "
    "WHEN 3 THEN cast(o_comment_like AS BINARY) WHEN 4 THEN unhex('255044462D312E34') WHEN 5 THEN unhex('') ELSE NULL END"
).replace("o_comment_like", "concat('a text of ', o_orderpriority)")
_WIDTH = f"(CASE o_orderkey % 7 WHEN 0 THEN {_LOW} WHEN 1 THEN {_LOW} % 256 + 256 WHEN 2 THEN {_LOW} END)"
_HEIGHT = f"(CASE o_orderkey % 7 WHEN 0 THEN {_HIGH} WHEN 1 THEN {_HIGH} % 256 WHEN 2 THEN {_HIGH} END)"
_SHOWN = "(CASE o_orderkey % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'text/plain' WHEN 4 THEN 'application/pdf' ELSE if(o_orderkey % 3 = 0, 'text/plain', 'image/png') END)"
_FILE: Sql = (
    f"named_struct('name', if(o_orderkey % 4 = 0, 'a.TXT', if(o_orderkey % 5 = 0, 'b.exe', 'avatar.png')), 'type', if(o_orderkey % 3 = 0, 'text/plain', 'image/png'), 'size', o_orderkey * 100, 'error', 0, 'content', {_BYTES})",
    f"struct_pack(name := if(o_orderkey % 4 = 0, 'a.TXT', if(o_orderkey % 5 = 0, 'b.exe', 'avatar.png')), kind := {_SHOWN}, w := {_WIDTH}, h := {_HEIGHT})",
)
_SOME_WORDS: Sql = ("if(p_partkey % 3 = 0, NULL, split(p_name, ' '))", "if(p_partkey % 3 = 0, NULL, string_split(p_name, ' '))")
_WORDS: Sql = ("split(p_name, ' ')", "string_split(p_name, ' ')")

RULE_CASES = [
    _maybe("required", _FULL), _maybe("filled", _FULL), _maybe("string", "v IS NOT NULL"), _maybe("nullable", "true"), _maybe("bail", "true"),
    _maybe("present", "v IS NOT NULL"), _orders("integer", _NUMBER, r"regexp_matches(v, '^[ \t\n]*[+-]?(0|[1-9][0-9]*)[ \t\n]*$')"), _orders("numeric", _NUMBER, _IS_NUMBER),
    _orders("boolean", "cast(o_orderkey % 3 AS INT)", "v IN (0, 1)"), _parts("array", "v IS NOT NULL", _SOME_WORDS),
    _orders("email", "CASE WHEN o_orderkey % 3 = 0 THEN concat('user', cast(o_orderkey AS STRING), '@example.com') WHEN o_orderkey % 3 = 1 THEN 'a..b@example.com' ELSE 'no at' END", "v LIKE 'user%'"),
    RuleCase("url", "pages", "page_id", "CASE WHEN page_id % 3 = 0 THEN 'not a url' ELSE url END", "v <> 'not a url'"),
    RuleCase("active_url", "pages", "page_id", "url", "regexp_extract(v, '^[a-z]+://([^/:?#]+)', 1) LIKE '%.com'"),
    _orders("ip", _IP, "o_orderkey % 300 < 256"), _orders("ip:v4,private", "CASE WHEN o_orderkey % 2 = 0 THEN concat('10.0.0.', cast(o_orderkey % 256 AS STRING)) ELSE '8.8.8.8' END", "v LIKE '10.%'"),
    RuleCase("json", "events", "event_id", "CASE WHEN event_id % 4 = 0 THEN concat(props, ' x') ELSE props END", "event_id % 4 <> 0"),
    _orders("uuid", "concat('550e8400-e29b-', cast(o_orderkey % 10 AS STRING), '1d4-a716-', lpad(cast(o_orderkey AS STRING), 12, '0'))", "o_orderkey % 10 BETWEEN 1 AND 9"),
    _orders("ulid", "concat(CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '8' END, lpad(cast(o_orderkey AS STRING), 25, '0'))", "v LIKE '0%'"),
    _orders("mac", "concat(CASE WHEN o_orderkey % 2 = 0 THEN '00:1B:44:11:3A:' ELSE '00:1B-44:11:3A:' END, lpad(cast(o_orderkey % 100 AS STRING), 2, '0'))", "v LIKE '00:1B:%'"),
    _orders("hex_color", "concat(CASE WHEN o_orderkey % 2 = 0 THEN '#' ELSE '' END, cast(o_orderkey % 10000 AS STRING), 'FF')", "length(replace(v, '#', '')) IN (3, 6)"),
    _orders("timezone", "CASE WHEN o_orderkey % 2 = 0 THEN 'Europe/Paris' ELSE 'Mars/Base' END", "v = 'Europe/Paris'"),
    _parts("alpha", "regexp_matches(v, '^[a-zA-Z]+$')", "CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '') ELSE p_name END"),
    _parts("alpha_num", "regexp_matches(v, '^[a-zA-Z0-9]+$')", "replace(p_brand, '#', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-' END)"),
    _parts("alpha_dash", "regexp_matches(v, '^[a-zA-Z0-9_-]+$')", "replace(p_brand, '#', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '.' END)"),
    RuleCase("ascii", "documents", "doc_id", "text", "strlen(v) = length(v)"), _parts("lowercase", "v = lower(v)"),
    RuleCase("uppercase", "customer", "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END", "v = upper(v)"),
    RuleCase("starts_with:BUILD,AUTO", "customer", "c_custkey", "c_mktsegment", "starts_with(v, 'BUILD') OR starts_with(v, 'AUTO')"),
    RuleCase("ends_with:ING,URE", "customer", "c_custkey", "c_mktsegment", "v LIKE '%ING' OR v LIKE '%URE'"), RuleCase("contains:MACH", "customer", "c_custkey", "c_mktsegment", "contains(v, 'MACH')"),
    RuleCase("doesnt_contain:HOLD,MACH", "customer", "c_custkey", "c_mktsegment", "NOT contains(v, 'HOLD') AND NOT contains(v, 'MACH')"),
    RuleCase("doesnt_start_with:BUILD", "customer", "c_custkey", "c_mktsegment", "NOT starts_with(v, 'BUILD')"),
    RuleCase("doesnt_end_with:ING", "customer", "c_custkey", "c_mktsegment", "v NOT LIKE '%ING'"),
    _orders("min:10", _NUMBER, f"{_SIZE} >= 10"), _orders("max:100", _NUMBER, f"{_SIZE} <= 100"), _orders("between:5,500", _NUMBER, f"{_SIZE} BETWEEN 5 AND 500"),
    _orders("size:3", _NUMBER, f"NOT {_IS_NUMBER} AND length(v) = 3"), _orders("digits:4", _NUMBER, f"{_IS_NUMBER} AND strlen(v) = 4"),
    _orders("digits_between:3,4", _NUMBER, f"{_IS_NUMBER} AND strlen(v) BETWEEN 3 AND 4"), _orders("min_digits:4", _NUMBER, f"{_IS_NUMBER} AND strlen(v) >= 4"),
    _orders("max_digits:3", _NUMBER, f"{_IS_NUMBER} AND strlen(v) <= 3"), _orders("decimal:2,4", _NUMBER, f"{_IS_NUMBER} AND contains(v, '.') AND strlen(split_part(v, '.', 2)) BETWEEN 2 AND 4"),
    _orders("multiple_of:5", "o_orderkey", "v % 5 = 0"),
    *(RuleCase(f"{n}:o", "lineitem", "l_orderkey, l_linenumber", "l_discount", f"v {op} o", {"o": "l_tax"}) for n, op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="))),
    _orders("date", _DAY, "try_cast(v AS DATE) IS NOT NULL"),
    _orders("date_format:Y-m-d", "CASE WHEN o_orderkey % 5 = 0 THEN '2024-02-30' WHEN o_orderkey % 5 = 1 THEN '2024-2-3' ELSE '2024-02-03' END", "v = '2024-02-03'"),
    _orders("date_equals:1995-03-15", _DAY, "try_cast(v AS DATE) = DATE '1995-03-15'"), _orders("before:1995-06-01", _DAY, "try_cast(v AS DATE) < DATE '1995-06-01'"),
    _orders("before_or_equal:1995-06-01", _DAY, "try_cast(v AS DATE) <= DATE '1995-06-01'"), _orders("after:1995-06-01", _DAY, "try_cast(v AS DATE) > DATE '1995-06-01'"),
    _orders("after_or_equal:1995-06-01", _DAY, "try_cast(v AS DATE) >= DATE '1995-06-01'"),
    _maybe("required_if:o,F", f"NOT (o IS NOT NULL AND o = 'F') OR {_FULL}"), _maybe("required_unless:o,F", f"o = 'F' OR {_FULL}"),
    _maybe("required_with:a,b", f"({_empty('a')} AND {_empty('b')}) OR {_FULL}"), _maybe("required_with_all:a,b", f"{_empty('a')} OR {_empty('b')} OR {_FULL}"),
    _maybe("required_without:a,b", f"(NOT {_empty('a')} AND NOT {_empty('b')}) OR {_FULL}"), _maybe("required_without_all:a,b", f"NOT {_empty('a')} OR NOT {_empty('b')} OR {_FULL}"),
    RuleCase("required_array_keys:k", "events", "event_id", ("from_json(props, 'map<string,int>')", "json_keys(props)"), "list_contains(v, 'k')"),
    _orders("required_if_accepted:o", _MAYBE, f"o NOT IN ('yes') OR {_FULL}", o="CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END"),
    _orders("required_if_declined:o", _MAYBE, f"o NOT IN ('no') OR {_FULL}", o="CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END"),
    _maybe("present_if:o,F", "o <> 'F' OR v IS NOT NULL"), _maybe("present_unless:o,F", "o = 'F' OR v IS NOT NULL"), _maybe("present_with:a,b", "(a IS NULL AND b IS NULL) OR v IS NOT NULL"),
    _maybe("present_with_all:a,b", "a IS NULL OR b IS NULL OR v IS NOT NULL"), _maybe("missing", _EMPTY), _maybe("missing_if:o,F", f"o <> 'F' OR {_EMPTY}"),
    _maybe("missing_unless:o,F", f"o = 'F' OR {_EMPTY}"), _maybe("prohibited", _EMPTY), _maybe("prohibited_if:o,F", f"o <> 'F' OR {_EMPTY}"),
    _maybe("prohibited_unless:o,F", f"o = 'F' OR {_EMPTY}"), _maybe("prohibits:a,b", f"{_EMPTY} OR ({_empty('a')} AND {_empty('b')})"), _maybe("exclude", "false"),
    _maybe("exclude_if:o,F", "o <> 'F'"), _maybe("exclude_unless:o,F", "o = 'F'"), _maybe("exclude_with:a", "a IS NULL"), _maybe("exclude_without:a", "a IS NOT NULL"),
    _orders("file", _UPLOAD, "o_orderkey % 5 % 2 = 0 AND o_orderkey % 2 = 0"),
    _orders("path:absolute", "CASE WHEN o_orderkey % 3 = 0 THEN '/var/www' WHEN o_orderkey % 3 = 1 THEN 'C:/x' ELSE 'a/b' END", "v <> 'a/b'"), _orders("image", _FILE, "v.w IS NOT NULL"),
    _orders("mimes:png,jpg", _FILE, "v.kind IN ('image/png', 'image/jpeg')"), _orders("mimetypes:text/plain,application/pdf", _FILE, "v.kind IN ('text/plain', 'application/pdf')"),
    _orders("extensions:png,txt", _FILE, "v.name <> 'b.exe'"), _orders("dimensions:100,50,500,300", _FILE, "v.w BETWEEN 100 AND 500 AND v.h BETWEEN 50 AND 300"), _orders("secure_file", _UPLOAD, "o_orderkey % 5 % 2 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0"),
    _orders("safe_filename", "CASE WHEN o_orderkey % 3 = 0 THEN 'a/b.png' WHEN o_orderkey % 3 = 1 THEN '..' ELSE 'a b.png' END", "v = 'a b.png'"),
    _orders("upload_meta", _UPLOAD, "o_orderkey % 4 <> 0"), _orders("upload_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'session_1-a' ELSE 'a/../b' END", "v = 'session_1-a'"),
    _orders("in:O,F", "o_orderstatus", "v IN ('O', 'F')"), _orders("not_in:O,F", "o_orderstatus", "v NOT IN ('O', 'F')"),
    RuleCase("in_array:o", "part", "p_partkey", "substr(p_name, 1, 4)", "list_contains(o, v)", {"o": ("split(p_name, ' ')", "string_split(p_name, ' ')")}),
    _parts("distinct", "len(list_distinct(v)) = len(v)", ("split(concat(p_brand, ' ', p_name, if(p_partkey % 2 = 0, concat(' ', p_brand), '')), ' ')", "string_split(concat(p_brand, ' ', p_name, if(p_partkey % 2 = 0, concat(' ', p_brand), '')), ' ')")),
    _parts("is_list", "v IS NOT NULL", _SOME_WORDS), RuleCase("same:o", "lineitem", "l_orderkey, l_linenumber", "l_returnflag", "v = o", {"o": "l_linestatus"}),
    RuleCase("different:o", "lineitem", "l_orderkey, l_linenumber", "l_returnflag", "v <> o", {"o": "l_linestatus"}),
    _orders("confirmed", "o_orderpriority", "v = v_confirmation", v_confirmation="CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END"),
    _orders("regex:/^[1-3]-/", "o_orderpriority", "regexp_matches(v, '^[1-3]-')"), _orders("not_regex:/^(1|2)-/i", "o_orderpriority", "NOT regexp_matches(v, '^(1|2)-')"),
    _orders("accepted", "CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN '1' ELSE 'no' END", "v IN ('yes', '1')"),
    _orders("accepted_if:o,F", "CASE WHEN o_orderkey % 2 = 0 THEN 'on' ELSE '' END", "o <> 'F' OR v = 'on'", o="o_orderstatus"),
    _orders("declined", "CASE o_orderkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN '0' ELSE 'yes' END", "v IN ('no', '0')"),
    _orders("declined_if:o,F", "CASE WHEN o_orderkey % 2 = 0 THEN 'off' ELSE '' END", "o <> 'F' OR v = 'off'", o="o_orderstatus"),
]


@dataclass(frozen=True)
class ValueCase:
    """A sanitizer or cast of the column ``v``, and its outcome in SQL."""

    steps: str
    v: Sql
    out: str | None
    table: str = "customer"
    key: str = "c_custkey"
    cast: bool = False
    shown: str = "out"  # what is compared, as Spark has it: an engine's own types are shown as text

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, self.table).selectExpr(self.key, f"{_pick(self.v, 0)} AS v")
        dtype = df.schema["v"].dataType
        out = casts.apply(Value(F.col("v"), dtype, F.lit(True)), self.steps)[0] if self.cast else sanitizers.apply(F.col("v"), dtype, self.steps)
        return df.select(self.key, out.alias("out")).select(self.key, F.expr(self.shown).alias("out"))

    def sql(self) -> str | None:
        return self.out and f"SELECT {self.key}, {self.out} AS out FROM (SELECT {self.key}, {_pick(self.v, 1)} AS v FROM {self.table})"


_MESSY = "concat('  ', c_name, ' & Co. #', cast(c_custkey AS STRING), '_x-', c_mktsegment, ' ')"
_SUM = "CASE c_custkey % 4 WHEN 0 THEN '$1,234.56' WHEN 1 THEN '-500.75' WHEN 2 THEN ' 12 ' ELSE 'abc7' END"
_EURO = "CASE c_custkey % 2 WHEN 0 THEN '1.234,56 EUR' ELSE '-500,75' END"
_TAGS = "concat('<p onclick=\"x()\">', c_name, '</p><script>alert(', cast(c_custkey AS STRING), ')</script><b>b</b>')"
_CLEAN = "regexp_replace(v, '[^a-zA-Z0-9\\s]', '', 'g')"


def _re(pattern: str, to: str = "", of: str = "v") -> str:
    return f"regexp_replace({of}, '{pattern}', '{to}', 'g')"


SANITIZER_CASES = [
    ValueCase("alpha", _MESSY, _re("[^a-zA-Z]")), ValueCase("alphaDash", _MESSY, _re("[^a-zA-Z0-9_-]")), ValueCase("alphanumeric", _MESSY, _re("[^a-zA-Z0-9]")),
    ValueCase("alphanumericSpace", _MESSY, _CLEAN), ValueCase("numeric", _MESSY, _re("[^0-9]")), ValueCase("phone", "concat('+1 (', cast(c_custkey AS STRING), ') 555-0', c_name)", _re("[^0-9+]")),
    ValueCase("email", "concat(' <', c_name, '@x.org> ')", _re("[^A-Za-z0-9!#$%&''*+=?^_`{|}~@.\\[\\]-]")), ValueCase("url", "concat('https://x.org/ ', c_name, 'é')", _re("[ é]")),
    ValueCase("trim", _MESSY, "trim(v)"), ValueCase("lowercase", _MESSY, "lower(v)"), ValueCase("uppercase", _MESSY, "upper(v)"), ValueCase("stripWhitespace", _MESSY, _re("\\s+")),
    ValueCase("normalizeWhitespace", "concat(' ', c_name, '   ', c_mktsegment, ' ')", _re("\\s+", " ", "trim(v)")),
    ValueCase("removeLineBreaks", ("concat(c_name, '\\r\\n', c_mktsegment, '\\n', 'x')", "concat(c_name, chr(13), chr(10), c_mktsegment, chr(10), 'x')"), "regexp_replace(v, '\\r\\n|\\r|\\n', ' ', 'g')"),
    ValueCase("escapeLike", "concat('50% ', c_name, '_x')", "replace(replace(v, '%', '\\%'), '_', '\\_')"), ValueCase("base64Encode", "c_name", "base64(encode(v))"),
    ValueCase("base64Decode", ("base64(cast(c_name AS BINARY))", "base64(encode(c_name))"), "decode(from_base64(v))"),
    ValueCase("sentenceCase", "c_mktsegment", "concat(upper(left(v, 1)), lower(substr(v, 2)))"), ValueCase("domain", "concat('https://', c_name, '.Example.com/path')", "lower(split_part(regexp_replace(v, '^https?://', ''), '/', 1))"),
    ValueCase("filename", "concat('../etc/', c_name, '.t x')", _re("[^a-zA-Z0-9._-]", "_", "regexp_extract(v, '([^/]*)/*$', 1)")),
    ValueCase("titleCase", "concat(lower(c_mktsegment), '-', 'word two')", "concat(upper(left(v, 1)), substr(split_part(v, '-', 1), 2), '-Word Two')"),
    ValueCase("camelCase", "concat('hello ', lower(c_mktsegment))", "concat('hello', upper(substr(v, 7, 1)), substr(v, 8))"),
    ValueCase("pascalCase", "concat('hello ', lower(c_mktsegment))", "concat('Hello', upper(substr(v, 7, 1)), substr(v, 8))"),
    ValueCase("snakeCase", _MESSY, _re("\\s+", "_", f"lower({_CLEAN})")), ValueCase("kebabCase", _MESSY, _re("\\s+", "-", f"lower({_CLEAN})")),
    ValueCase("htmlEncode", _TAGS, "replace(replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"),
    ValueCase("htmlDecode", "concat('&lt;p&gt;', c_name, '&amp;lt;')", "concat('<p>', split_part(split_part(v, '&gt;', 2), '&amp;', 1), '&lt;')"),
    ValueCase("removeSqlPatterns", "concat('SELECT * FROM ', c_name, '; -- comment')", "concat('* FROM ', split_part(split_part(v, 'FROM ', 2), ';', 1), ';')"),
    ValueCase("removeXss", _TAGS, "concat('<p>', regexp_extract(v, '>(Customer[^<]*)<', 1), '</p><b>b</b>')"),
    ValueCase("stripTags", _TAGS, "concat(regexp_extract(v, '>(Customer[^<]*)<', 1), 'alert(', cast(c_custkey AS STRING), ')b')"),
    ValueCase("stripUnsafeTags", _TAGS, "concat('<p onclick=\"x()\">', regexp_extract(v, '>(Customer[^<]*)<', 1), '</p>b')"),
    ValueCase("string", "concat('  <b>', c_name, '</b> ')", "regexp_replace(trim(v), '</?b>', '', 'g')"), ValueCase("slug", _MESSY, "trim(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '-')"),
    ValueCase("truncate:10", _MESSY, "CASE WHEN length(v) <= 10 THEN v ELSE concat(left(v, 10), '...') END"),
    ValueCase("truncateWords:2", "concat(c_name, ' a b ', c_mktsegment)", "concat(split_part(v, ' ', 1), ' ', split_part(v, ' ', 2), '...')"),
    ValueCase("integer", _SUM, "CASE c_custkey % 4 WHEN 0 THEN 123456 WHEN 1 THEN -500 WHEN 2 THEN 12 ELSE 7 END::BIGINT"),
    ValueCase("float", _SUM, "CASE c_custkey % 4 WHEN 0 THEN 1234.56 WHEN 1 THEN -500.75 WHEN 2 THEN 12 ELSE 7 END::DOUBLE"),
    ValueCase("boolean", "CASE c_custkey % 3 WHEN 0 THEN ' YES ' WHEN 1 THEN 'off' ELSE '2' END", "trim(lower(v)) = 'yes'"),
    ValueCase("currency", _SUM, "CASE c_custkey % 4 WHEN 0 THEN 1234.56 WHEN 1 THEN -500.75 WHEN 2 THEN 12 ELSE 7 END::DOUBLE"),
    ValueCase("currency:EUR", _EURO, "CASE c_custkey % 2 WHEN 0 THEN 1234.56 ELSE -500.75 END::DOUBLE"),
    ValueCase("formatCurrency", "cast(c_custkey AS DOUBLE) + 0.5", "concat('$', format('{:,.2f}', v))"),
    ValueCase("jsonEncode", "c_name", "concat('\"', v, '\"')"), ValueCase("jsonDecode:k INT", "if(event_id % 3 = 0, concat(props, 'x'), props)", "CASE WHEN event_id % 3 <> 0 THEN coalesce(json_extract_string(v, '$.k'), 'none') ELSE 'no json' END", "events", "event_id", shown="CASE WHEN event_id % 3 = 0 AND out.k IS NULL THEN 'no json' ELSE coalesce(cast(out.k AS STRING), 'none') END"),
    ValueCase("array", _WORDS, "array_to_string(v, '|')", "part", "p_partkey", shown="concat_ws('|', out)"),
    ValueCase("trim|lowercase|slug", _MESSY, "trim(regexp_replace(lower(v), '[^a-z0-9]+', '-', 'g'), '-')"),
]

CAST_CASES = [
    ValueCase("int", _SUM, "CASE c_custkey % 4 WHEN 1 THEN -500 WHEN 2 THEN 12 ELSE 0 END::BIGINT", cast=True), ValueCase("float", _SUM, "CASE c_custkey % 4 WHEN 1 THEN -500.75 WHEN 2 THEN 12 ELSE 0 END::DOUBLE", cast=True),
    ValueCase("bool", "CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'off' ELSE 'x' END", "v <> 'off'", cast=True), ValueCase("string", "c_custkey", "cast(v AS VARCHAR)", cast=True),
    ValueCase("date", _DAY, "coalesce(strftime(try_cast(v AS DATE), '%Y-%m-%d 00:00:00'), 'none')", "orders", "o_orderkey", True, "coalesce(date_format(out, 'yyyy-MM-dd HH:mm:ss'), 'none')"),
    ValueCase("json", "if(event_id % 3 = 0, concat('{{', props), props)", "CASE WHEN event_id % 3 = 0 THEN 'none' ELSE json_extract_string(v, '$.k') END", "events", "event_id", True, "coalesce(try_variant_get(out, '$.k', 'string'), 'none')"),
    ValueCase("array", "CASE c_custkey % 4 WHEN 0 THEN concat('[\"', c_name, '\", \"b\"]') WHEN 1 THEN concat('{\"x\": \"', c_name, '\"}') WHEN 2 THEN '[]' ELSE c_name END", "CASE c_custkey % 4 WHEN 0 THEN concat(json_extract_string(v, '$[0]'), '|b') WHEN 1 THEN json_extract_string(v, '$.x') ELSE v END", cast=True, shown="concat_ws('|', out)"),
    ValueCase("object", "c_name", "concat('{\"value\":\"', v, '\"}')", cast=True, shown="to_json(out)"),
]


# -- whole validators


def _orders_schema() -> Validator:
    return Validator({"o_orderstatus": "required|in:O,F", "o_totalprice": "required|numeric|min:1000|max:200000", "o_orderpriority": "regex:/^[1-5]-/"})


def orders_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: failures of a schema over orders, one row each."""
    return _orders_schema().violations(_table(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_orderkey", "field", "rule", "message")


_VIOLATIONS_SQL = """
SELECT o_orderkey, 'o_orderstatus' AS field, 'in' AS rule, 'The selected O Orderstatus is invalid.' AS message FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'o_totalprice', 'min', 'The O Totalprice must be at least 1000.' FROM orders WHERE o_totalprice < 1000
UNION ALL SELECT o_orderkey, 'o_totalprice', 'max', 'The O Totalprice must not exceed 200000.' FROM orders WHERE o_totalprice > 200000
"""


def flat_fast_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine cheap rules on each line item, fail-fast."""
    schema = {
        "l_orderkey": "required|integer|min:0", "l_partkey": "required|integer", "l_suppkey": "required|integer", "l_quantity": "required|numeric|between:1,45",
        "l_extendedprice": "required|numeric|min:0", "l_discount": "required|numeric|max:0.09", "l_tax": "numeric|max:0.08", "l_returnflag": "required|in:A,N,R", "l_linestatus": "required|in:O,F",
    }
    out = Validator(schema).validate(_table(spark, sf_dir, "lineitem")).df
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("_valid").cast("long")).alias("n_valid"), F.sum(F.size("_failures")).cast("long").alias("n_failures"))


_FLAT_SQL = """
SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN f = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, CAST(sum(f) AS BIGINT) AS n_failures FROM (
  SELECT l_returnflag, (CASE WHEN l_quantity BETWEEN 1 AND 45 THEN 0 ELSE 1 END) + (CASE WHEN l_extendedprice >= 0 THEN 0 ELSE 1 END)
    + (CASE WHEN l_discount <= CAST(0.09 AS DOUBLE) THEN 0 ELSE 1 END) + (CASE WHEN l_tax <= CAST(0.08 AS DOUBLE) THEN 0 ELSE 1 END) + (CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN 0 ELSE 1 END)
    + (CASE WHEN l_linestatus IN ('O', 'F') THEN 0 ELSE 1 END) AS f FROM lineitem) GROUP BY l_returnflag
"""


def nested_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on every turn of every conversation, by a wildcard path."""
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    schema = {"turns.*.role": "required|in:user,assistant", "turns.*.text": "required|string|max:400", "turns.*.turn": "integer|max:6"}
    return Validator(schema).validate(rows).failures(["conv_id"]).select("conv_id", "field", "rule")


_NESTED_SQL = """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, concat('turns.', i, '.role') AS field, 'in' AS rule FROM t WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT conv_id, concat('turns.', i, '.text'), 'max' FROM t WHERE length(text) > 400
UNION ALL SELECT conv_id, concat('turns.', i, '.turn'), 'max' FROM t WHERE turn > 6
"""


def lookups_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two existence checks and a uniqueness check over orders, by existence joins."""
    customers = _table(spark, sf_dir, "customer")
    tables = {"customer": customers.where("c_custkey % 10 <> 0"), "building": customers.where("c_mktsegment = 'BUILDING'"), "blocked": customers.where("c_custkey % 4 = 0")}
    orders = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_custkey AS buyer", "o_custkey AS payer")
    schema = {"o_custkey": "required|exists:customer,c_custkey", "buyer": "exists:building,c_custkey", "payer": "unique:blocked,c_custkey"}
    return Validator(schema, tables).validate(orders).failures(["o_orderkey"]).select("o_orderkey", "field", "rule")


_LOOKUP_SQL = """
SELECT o_orderkey, 'o_custkey' AS field, 'exists' AS rule FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT o_orderkey, 'buyer', 'exists' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT o_orderkey, 'payer', 'unique' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)
"""


def rule_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"part": _table(spark, sf_dir, "part").where("p_size > 10")}
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return Validator({"l_partkey": "exists:part,p_partkey"}, tables).validate(lines).df.select("l_orderkey", "l_linenumber", F.col("_valid").alias("ok"))


def rule_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-deleted rows and the ignored row do not count."""
    table = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey AS code", "if(s_suppkey % 2 = 0, timestamp '2024-01-01', null) AS deleted_at")
    rows = _table(spark, sf_dir, "customer").select("c_custkey")
    return Validator({"c_custkey": "unique:s,code,7"}, {"s": table}).validate(rows).df.select("c_custkey", F.col("_valid").alias("ok"))


def composite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    side = _table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return composite_exists(lines, side, {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey"}).select("l_orderkey", "l_linenumber")


def conditional_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rules for the rows where a condition holds."""
    v = Validator({"o_totalprice": "numeric"}).sometimes("o_orderpriority", "in:1-URGENT", lambda r: r("o_orderstatus").col == "P")
    v.when(lambda r: r("o_orderstatus").col == "F", {"o_totalprice": "max:100000"}, {"o_totalprice": "min:50000"})
    return v.validate(_table(spark, sf_dir, "orders")).failures(["o_orderkey"]).select("o_orderkey", "field", "rule")


_CONDITIONAL_SQL = """
SELECT o_orderkey, 'o_orderpriority' AS field, 'in' AS rule FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, 'o_totalprice', 'max' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
UNION ALL SELECT o_orderkey, 'o_totalprice', 'min' FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice < 50000
"""


def collect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failures of a field, not the first alone, with custom messages."""
    v = Validator({"c_name": "max:5|lowercase|contains:9"}).set_fail_fast(False).set_custom_messages({"c_name.max": ":field has over :max characters: :value"})
    return v.validate(_table(spark, sf_dir, "customer")).failures(["c_custkey"]).select("c_custkey", "rule", "message")


_COLLECT_SQL = """
SELECT c_custkey, 'max' AS rule, concat('C Name has over 5 characters: ', c_name) AS message FROM customer WHERE length(c_name) > 5
UNION ALL SELECT c_custkey, 'lowercase', 'The C Name must be lowercase.' FROM customer WHERE c_name <> lower(c_name)
UNION ALL SELECT c_custkey, 'contains', 'The C Name must contain the specified value.' FROM customer WHERE c_name NOT LIKE '%9%'
"""


def stop_on_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _orders_schema().set_stop_on_first_error(True)
    return v.validate(_table(spark, sf_dir, "orders")).failures(["o_orderkey"]).select("o_orderkey", "field", "rule")


_STOP_SQL = """
SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'o_orderstatus' ELSE 'o_totalprice' END AS field,
  CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'in' WHEN o_totalprice < 1000 THEN 'min' ELSE 'max' END AS rule
FROM orders WHERE o_orderstatus NOT IN ('O', 'F') OR o_totalprice < 1000 OR o_totalprice > 200000
"""


def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_schema().validate(_table(spark, sf_dir, "orders")).report().select(F.coalesce("field", F.lit("")).alias("field"), F.coalesce("rule", F.lit("")).alias("rule"), "failures")


_REPORT_SQL = f"SELECT coalesce(field, '') AS field, coalesce(rule, '') AS rule, count(*) AS failures FROM ({_VIOLATIONS_SQL}) GROUP BY ROLLUP (field, rule)"


def sanitize_then_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('  ', c_mktsegment, ' ') AS segment")
    frame = Validator({"segment": {"rules": "required|in:building,machinery", "sanitize": ["trim", "lowercase"]}}).validate(rows)
    return frame.df.select("c_custkey", "segment", F.col("_valid").alias("ok"))


def typed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS STRING) AS id", "if(o_orderkey % 2 = 0, 'yes', 'no') AS flag")
    return Validator({"id": {"rules": "required|integer", "cast": "int"}, "flag": {"rules": "required", "cast": "bool"}}).validate(rows).typed()


def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence by the keys of a JSON column."""
    v = Validator({"k": "required|integer|max:50", "j": "missing"}).set_input(payload="props", types={"k": "bigint"})
    return v.validate(_table(spark, sf_dir, "events").select("event_id", "props")).df.select("event_id", F.col("_valid").alias("ok"))


def callback_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = make_rule("callback", (lambda v: v > 30, 50, "The :field is too small."))
    return Validator({"l_quantity": [rule]}).validate(_table(spark, sf_dir, "lineitem")).df.select("l_orderkey", "l_linenumber", F.col("_valid").alias("ok"))


def current_password_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = make_rule("current_password", (lambda v: F.sha2(v, 256) == F.sha2(F.lit("BUILDING"), 256),))
    return Validator({"c_mktsegment": [rule]}).validate(_table(spark, sf_dir, "customer")).df.select("c_custkey", F.col("_valid").alias("ok"))


def _nested_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.length("text").alias("size")).alias("said")))).alias("turns"))


def expand_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concrete path of a starred one, with its value."""
    return paths.expand(_nested_turns(spark, sf_dir), ["conv_id"], "turns.*.said.role")


def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows as dotted columns and back."""
    nested = _table(spark, sf_dir, "nation").select(F.struct("n_nationkey", F.struct("n_name", "n_regionkey").alias("place")).alias("nation"))
    flat = paths.flatten(nested)
    back = paths.set_value(paths.unflatten(flat), "nation.place.code", F.lit("x"))
    return back.select("nation.n_nationkey", "nation.place.n_name", "nation.place.n_regionkey", "nation.place.code")


def shape_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shapes the JSON payloads have."""
    events = _table(spark, sf_dir, "events").withColumn("payload", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": [1], "b": '), "props", F.lit("}"))).otherwise(F.col("props")))
    return events.groupBy(paths.shape_signature(F.col("payload")).alias("shape")).count().select(F.col("count").alias("n"))


WHOLE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "orders_violations": (orders_violations, _VIOLATIONS_SQL), "flat_fast_rules": (flat_fast_rules, _FLAT_SQL), "nested_wildcard": (nested_wildcard, _NESTED_SQL),
    "lookups_batched": (lookups_batched, _LOOKUP_SQL), "conditional_rules": (conditional_rules, _CONDITIONAL_SQL), "collect_all": (collect_all, _COLLECT_SQL),
    "stop_on_first_error": (stop_on_first_error, _STOP_SQL), "failure_report": (failure_report, _REPORT_SQL),
    "rule_exists": (rule_exists, "SELECT l_orderkey, l_linenumber, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AS ok FROM lineitem"),
    "rule_unique": (rule_unique, "SELECT c_custkey, c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 <> 0 AND s_suppkey <> 7) AS ok FROM customer"),
    "composite_lookup": (composite_lookup, "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem s WHERE s.l_quantity > 45 AND s.l_partkey = l.l_partkey AND s.l_suppkey = l.l_suppkey)"),
    "sanitize_then_validate": (sanitize_then_validate, "SELECT c_custkey, lower(c_mktsegment) AS segment, lower(c_mktsegment) IN ('building', 'machinery') AS ok FROM customer"),
    "typed_output": (typed_output, "SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS flag FROM orders"),
    "json_payload": (json_payload, "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) <= 50, false) AS ok FROM events"),
    "expand_wildcard": (expand_wildcard, "SELECT conv_id, concat('turns.', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, '.said.role') AS path, role AS value FROM conversations"),
    "flatten_nested": (flatten_nested, "SELECT n_nationkey, n_name, n_regionkey, 'x' AS code FROM nation"),
    "shape_signatures": (shape_signatures, "SELECT count(*) AS n FROM events GROUP BY event_id % 3 = 0"),
    "rule_callback": (callback_rule, "SELECT l_orderkey, l_linenumber, l_quantity > 30 AS ok FROM lineitem"),
    "rule_current_password": (current_password_rule, "SELECT c_custkey, c_mktsegment = 'BUILDING' AS ok FROM customer"),
}


def _named() -> dict[str, RuleCase | ValueCase]:
    out: dict[str, RuleCase | ValueCase] = {}
    for prefix, cases, label in (("rule", RULE_CASES, lambda c: c.rule), ("san", SANITIZER_CASES, lambda c: c.steps), ("cast", CAST_CASES, lambda c: c.steps)):
        for case in cases:
            name = f"{prefix}_{label(case).split(':')[0].replace('|', '_')}"
            out[name if name not in out else f"{name}_2"] = case
    return out


CASES = _named()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: case.run for name, case in CASES.items()} | {name: q for name, (q, _) in WHOLE.items()}


def oracles() -> dict[str, str]:
    out = {name: sql for name, case in CASES.items() if (sql := case.sql())}
    return out | {name: sql for name, (_, sql) in WHOLE.items() if sql}
