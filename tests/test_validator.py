"""Rules on golden pairs, engine behaviour, messages, results and export."""

import json

import pytest
from pyspark.sql import functions as F

import gatehouse as g
from gatehouse.functions import sanitizers, typesys, udfs
from gatehouse.operators.registry import make_rule
from gatehouse.plans import mime
from gatehouse.plans.export import struct_type
from gatehouse.plans.messages import FieldAlias, humanize
from gatehouse.plans.rulespec import parse_rules, split_rules
from gatehouse.sources.tables import LookupTables, read_files

PAIRS = [
    ("alpha", ["Heron", "qQ"], ["heron7", "", "heron\n\n"]), ("alpha_num", ["bay42", "Z"], ["bay 42"]), ("alpha_dash", ["low-tide_7"], ["low tide"]), ("ascii", ["Reed"], ["Röhricht"]),
    ("lowercase", ["marsh", "77"], ["mArsh"]), ("uppercase", ["OTTER"], ["OTTEr"]), ("starts_with:sftp://,git://", ["git://depot/x"], ["svn://depot/x"]),
    ("ends_with:.csv,.tsv", ["tides.tsv"], ["tides.xls"]), ("contains:ebb", ["the ebb begins"], ["the flood begins"]), ("doesnt_start_with:tmp,bak", ["gauge_1"], ["bak_gauge"]),
    ("doesnt_end_with:.swp,.lock", ["gauge.log"], ["gauge.lock"]), ("doesnt_contain:drift,wreck", ["calm water"], ["a wreck below"]),
    ("digits:6", ["204417", "-20441", "3.1415"], ["20441", "sixsix"]), ("digits_between:2,4", ["707"], ["7"]), ("min_digits:7", ["5550199"], ["555019"]), ("max_digits:3", ["808"], ["8080"]),
    ("decimal:3", ["2.718", "1.4142"], ["2.71", "31"]), ("size:4", ["reef"], ["reefs", "1000"]), ("max:12", ["sandbar", "11"], ["73301", "a sandbar too far"]), ("size:7", ["estuary"], ["7"]),
    ("numeric", ["7.", ".25", " 3 ", "2e3", "-0"], ["4f", "INF", "0b11", "", "7 7"]), ("integer", ["64", " -9 ", "+8"], ["007", "6.5", "18446744073709551616", ""]),
    ("date", ["2031-07-09", "2031-02-30", "07/09/2031", "now", "yesterday", "+3 days", "9 July 2031"], ["high tide", "2031-14-02"]), ("date_format:d.m.Y", ["09.07.2031"], ["2031-07-09", "31.02.2031"]),
    ("date_equals:2031-07-09", ["2031-07-09", "2031-07-09 18:30:00"], ["2031-07-10"]), ("before:2032-05-01", ["2032-04-30"], ["2032-05-02", "soon"]), ("before_or_equal:2032-04-30", ["2032-04-30", "2032-04-29"], ["2032-05-01"]),
    ("after:2032-05-01", ["2032-05-02"], ["2032-04-30"]), ("after_or_equal:2032-05-01", ["2032-05-01", "2032-06-11"], ["2032-04-30"]),
    ("email", ["keeper@light.example"], ["keeper at light", "k@l", "k..r@light.example", "ö@light.example"]), ("url", ["https://light.example", "ftp://light.example:21/logs?y=1#z"], ["light example", "https://"]),
    ("ip", ["172.20.14.3", "fe80::1ff:fe23:4567:890a"], ["172.20.14.256", "172.20"]), ("ip:v4", ["172.20.14.3"], ["fe80::1"]), ("ip:v6", ["fe80:0000::1ff:fe23:4567:890a"], ["172.20.14.3"]),
    ("ip:public", ["9.9.9.9"], ["172.16.0.9", "127.0.0.8"]), ("json", ['{"depth": [3, 4]}', "-2.5", '{"d":1,"d":2}'], ["{depth: 3}", "[1] 2", "Infinity"]),
    ("uuid", ["6fa459ea-ee8a-3ca4-894e-db77e160355e"], ["6fa459ea"]), ("uuid:!3", ["886313e1-3b8a-5372-9b90-0c9aee199e5d"], ["6fa459ea-ee8a-3ca4-894e-db77e160355e"]), ("ulid", ["01HZX3KQ9W8V7T6S5R4P3N2M1K"], ["01HZX3KQ"]),
    ("mac", ["3c:22:FB:90:01:7e", "3C22.fb90.017e"], ["3c22fb90017", "3c:22-fb:90:01:7e"]), ("hex_color", ["#0a7E4c", "#09c", "09C"], ["#0a7E"]), ("timezone", ["Asia/Tokyo", "Europe/Lisbon"], ["Sea/Bottom"]),
    ("path", ["charts/2031/north.map"], [" "]), ("path:absolute", ["/srv/charts/north.map", "D:\\charts"], ["charts/2031"]), ("path:relative", ["charts/2031"], ["/srv/charts"]),
    ("regex:/^[a-f]{2}:\\d{3}$/", ["be:507"], ["zz:507"]), ("required|regex:/^(ebb|flow)$/", ["flow"], ["slack"]), ("not_regex:/^(rock|shoal)$/i", ["harbour"], ["Shoal"]),
    ("in:port,starboard", ["port"], ["astern"]), ("in:3,4", [], ["3"]), ("not_in:sunk,lost", ["afloat"], ["lost"]), ("accepted", ["yes", "on", "1", "true"], ["maybe"]), ("declined", ["off"], ["yes"]),
    ("boolean", ["0", "1"], ["no"]), ("safe_filename", ["north map.png"], ["../../north.map", ".", "n\x00m"]), ("upload_id", ["tide-2031_07"], ["tide/2031"]), ("required", ["-", "00"], ["", " \t ", None]),
]


@pytest.mark.parametrize(("rules", "good", "bad"), PAIRS, ids=[p[0] for p in PAIRS])
def test_golden_pairs(spark, rules, good, bad):
    df = spark.createDataFrame([(v,) for v in [*good, *bad]], "v string")
    rule = [r for r in parse_rules(rules)]
    ctx = g.plans.engine.Record(df)
    ok = F.lit(True)
    for r in rule:
        ok = ok & r.predicate(g.operators.registry.Context("v", ctx("v"), ctx))
    assert [x[0] for x in df.select(ok).collect()] == [True] * len(good) + [False] * len(bad)


SANITIZED = [
    ("string", "  <i>kelp</i>  ", "kelp"), ("integer", "88.90", 88), ("float", "88.90", 88.9), ("boolean", "on", True), ("boolean", "no", False), ("email", " KEEPER@light.example  ", "KEEPER@light.example"),
    ("camelCase", "rising salt tide", "risingSaltTide"), ("pascalCase", "rising tide", "RisingTide"), ("titleCase", "rising tide", "Rising Tide"), ("snakeCase", "Rising Tide", "rising_tide"),
    ("kebabCase", "Rising Tide", "rising-tide"), ("sentenceCase", "low water. then high.", "Low water. then high."), ("slug", "Low Water, Again?", "low-water-again"), ("slug", "Žofín Über Öresund", "zofin-uber-oresund"),
    ("truncate:9", "Harbour master", "Harbour m..."), ("truncateWords:2", "Harbour master, on duty.", "Harbour master,..."), ("normalizeWhitespace", "salt \n and \t sand", "salt and sand"),
    ("removeLineBreaks", "salt\r\nsand", "salt sand"), ("phone", "+44 (0)20 7946-0018", "+4402079460018"), ("currency", "$7,008.09", 7008.09), ("currency", "-$16.20", -16.2),
    ("currency:EUR", "7.008,09€", 7008.09), ("currency:EUR", "-16,20", -16.2), ("filename", "../../srv/charts/north.map", "north.map"), ("domain", "https://charts.Light.example/2031", "charts.light.example"),
    ("htmlEncode", "<em>\"salt\"</em>", "&lt;em&gt;&quot;salt&quot;&lt;/em&gt;"), ("htmlDecode", "&lt;em&gt;salt&lt;/em&gt;", "<em>salt</em>"), ("alpha", "Buoy 9, bell_4-b.", "Buoybellb"),
    ("alphanumeric", "Buoy 9, bell_4-b.", "Buoy9bell4b"), ("alphaDash", "Buoy 9, bell_4-b.", "Buoy9bell_4-b"), ("alphanumericSpace", "Buoy 9, bell_4-b.", "Buoy 9 bell4b"),
    ("numeric", "b9uoy40", "940"), ("base64Encode", "ebb & flow", "ZWJiICYgZmxvdw=="), ("base64Decode", "ZWJiICYgZmxvdw==", "ebb & flow"), ("base64Decode", "!?!", ""),
    ("string|lowercase", "  <i>KELP</i>  ", "kelp"), ("escapeLike", "7% of salt_water", "7\\% of salt\\_water"), ("removeSqlPatterns", "DELETE kelp; -- now", "kelp;"),
    ("removeXss", '<script>sink()</script><em onmouseover="sink()">ok</em>', "<em>ok</em>"), ("stripTags:<em><u>", "<em>Salt</em> <div>Sand</div> <u>Silt</u>", "<em>Salt</em> Sand <u>Silt</u>"),
    ("stripUnsafeTags", "<script>sink</script><p>calm</p><em>sea</em>", "<p>calm</p><em>sea</em>"), ("stripWhitespace", "salt \n sand.", "saltsand."),
    ("url", "https://light.example/ north map", "https://light.example/northmap"), ("formatCurrency", "7008.09", "$7,008.09"), ("formatCurrency:EUR", "7008.09", "€7.008,09"), ("jsonEncode", 'b"ø', '"b\\"ø"'),
    ("trim", "\n y\0\x0b", "y"), ("unheard", "stays", "stays"), ("lowercase", None, ""), ("uppercase", "ø", "Ø"), ("stripTags", "3 < 4 and <", "3 < 4 and <"), ("stripTags", "no markup here", "no markup here"),
]


def test_sanitizers(spark):
    df = spark.createDataFrame([tuple(v for _, v, _ in SANITIZED)], ", ".join(f"c{k} string" for k in range(len(SANITIZED))))
    out = df.select(*(sanitizers.apply(F.col(f"c{k}"), df.schema[f"c{k}"].dataType, s).alias(f"c{k}") for k, (s, _, _) in enumerate(SANITIZED))).first()
    assert [(s, out[k]) for k, (s, _, _) in enumerate(SANITIZED)] == [(s, want) for s, _, want in SANITIZED]


def test_array_sanitizers(spark):
    df = spark.createDataFrame([(["  key1  ", "<b>key2</b>"], 5)], "a array<string>, n int")
    assert df.select(sanitizers.apply(F.col("a"), df.schema["a"].dataType, "array")).first()[0] == ["key1", "key2"]
    assert df.select(sanitizers.batch(F.col("a"), df.schema["a"].dataType, "uppercase")).first()[0] == ["  KEY1  ", "<B>KEY2</B>"]
    assert df.select(sanitizers.apply(F.col("n"), df.schema["n"].dataType, "numeric")).first()[0] == ""
    assert len(sanitizers.SANITIZERS) == 43


def result(spark, schema, row, ddl, tables=None, setup=lambda v: v):
    df = spark.createDataFrame([row], ddl)
    return next(setup(g.Validator(schema, tables)).validate(df).records())


def test_registration(spark):
    ddl = "email string, username string, age int, password string, password_confirmation string, terms string"
    schema = {"email": "required|email|max:255", "username": "required|string|min:3|max:50|alpha_dash", "age": "required|integer|min:18|max:120", "password": "required|min:8|confirmed", "password_confirmation": "required|same:password", "terms": "required|accepted"}
    good = result(spark, schema, ("test@example.com", "john_doe", 25, "SecurePass123", "SecurePass123", "on"), ddl)
    assert good.passes() and set(good.validated) == set(schema)
    bad = result(spark, schema, ("nope", "jo", 12, "secret123", "other", ""), ddl)
    assert set(bad.errors) == set(schema) and bad.error_count() == 6 and not bad.validated


def test_cost_order_bail_and_collect(spark):
    schema = {"email": "email|max:10"}
    assert result(spark, schema, ("not-an-email-at-all",), "email string").errors["email"] == ["The Email must not exceed 10."]
    both = result(spark, schema, ("not-an-email-at-all",), "email string", setup=lambda v: v.set_fail_fast(False))
    assert len(both.errors["email"]) == 2 and "email" not in both.validated
    assert len(result(spark, {"email": "bail|email|max:10"}, ("not-an-email-at-all",), "email string", setup=lambda v: v.set_fail_fast(False)).errors["email"]) == 1
    two = {"a": "required", "b": "required"}
    assert result(spark, two, ("", None), "a string, b string").error_count() == 2
    assert result(spark, two, ("", None), "a string, b string", setup=lambda v: v.set_stop_on_first_error(True)).error_count() == 1


def test_optional_fields_are_skipped(spark):
    r = result(spark, {"a": "accepted", "b": "filled", "c": "min:3"}, ("", "", None), "a string, b string, c string")
    assert r.errors == {"b": ["The B must be filled when present."]} and "a" not in r.validated
    assert result(spark, {"x": "prohibited_if:y,1|string"}, (5,), "y int").errors == {"x": ["The X must be a string."]}


def test_messages_and_locale(spark):
    def spanish(v):
        return v.add_locale_pack("es", {"required": "El campo :field es obligatorio."}).set_locale("es")

    assert result(spark, {"email": "required"}, (None,), "email string", setup=spanish).errors == {"email": ["El campo Email es obligatorio."]}
    custom = lambda v: v.set_custom_messages({"name.min": "The :field needs :min chars (:rule), not :value."}).set_field_aliases({"name": "Full Name"})
    assert result(spark, {"name": "min:3"}, ("ab",), "name string", setup=custom).errors["name"] == ["The Full Name needs 3 chars (min), not ab."]
    alias = FieldAlias({"contacts.*.email": "E-mail"})
    assert alias.get("contacts.3.email") == "E-mail" and humanize("contacts.0.email") == "Contacts 0 Email"


def test_nested_paths(spark):
    ddl = "user struct<email:string,profile:struct<age:int>>, contacts array<struct<email:string,tags:array<string>>>"
    schema = {"user.email": "required|email", "user.profile.age": "required|min:18", "contacts.*.email": "required|email", "contacts.*.tags.*": "min:2"}
    r = result(spark, schema, (("bad", (15,)), [("x@example.com", ["ok", "n"]), (None, [])]), ddl)
    assert set(r.errors) == {"user.email", "user.profile.age", "contacts.1.email", "contacts.0.tags.1"}
    assert result(spark, schema, (("a@example.com", (20,)), None), ddl).passes()


def test_single_wildcard_compatibility(spark):
    r = result(spark, {"a.*.b.*": "required"}, ([(["x"],), ([],)],), "a array<struct<b:array<string>>>", setup=lambda v: v.set_compat_single_wildcard())
    assert set(r.errors) == {"a.0.b.*", "a.1.b.*"}
    assert mime.mime_types("php", compat=True) == mime.mime_types("php") and mime.mime_types("fbx", compat=True) == (mime.FALLBACK,) and not mime.has_extension("jar", compat=True)
    assert mime.mime_types("numbers") == ("application/vnd.apple.numbers",) and not mime.has_extension("numbers", compat=True)


def test_presence_modes(spark):
    df = spark.createDataFrame([('{"draft": null, "kind": "a"}',), ('{"kind": "b"}',), ("[1]",)], "props string")
    v = g.Validator({"draft": "present_if:kind,a", "kind": "required"}).set_input(payload="props")
    assert [r.passes() for r in v.validate(df).records()] == [True, True, False]
    maps = spark.createDataFrame([({"a": "x", "b": ""},), ({"b": "y"},)], "m map<string,string>")
    assert [r.passes() for r in g.Validator({"a": "required_without:b", "c": "missing"}).set_input(payload="m").validate(maps).records()] == [True, True]
    assert [r.passes() for r in g.Validator({"a": "present"}).set_input(payload="m").validate(maps).records()] == [True, False]


def test_exclusion(spark):
    r = result(spark, {"a": "exclude_if:kind,x|integer", "kind": "required"}, ("not a number", "x"), "a string, kind string")
    assert r.passes() and list(r.validated) == ["kind"]


def test_lookups(spark):
    tables = LookupTables(spark).add_rows("users", [{"id": 1, "email": "used@example.com", "deleted_at": None}, {"id": 2, "email": "gone@example.com", "deleted_at": "2024-01-01"}], "id int, email string, deleted_at string")
    ddl = "email string"
    errors = lambda rule, value: result(spark, {"email": rule}, (value,), ddl, tables).errors
    assert errors("unique:users,email", "used@example.com") == {"email": ["The Email has already been taken."]}
    assert not errors("unique:users,email", "gone@example.com") and errors("unique:users,email,,id,true", "gone@example.com")
    assert not errors("unique:users,email,1", "used@example.com") and not errors("exists:users,email", "gone@example.com") and errors("exists:users,email", "x")
    assert tables.exists("users", "email", "used@example.com") and not tables.exists("users", "email", "used@example.com", ignore=1)
    assert not tables.composite_unique("users", {"id": 1, "email": "used@example.com"}) and tables.composite_unique("users", {"id": 2, "email": "used@example.com"})
    assert tables.query("SELECT count(*) AS n FROM users").first().n == 2
    with pytest.raises(g.InvalidRule):
        errors("exists:nowhere,x", "y")


def test_lookup_plans_join_without_exploding(spark):
    tables = {"t": spark.range(5).withColumnRenamed("id", "k")}
    frame = g.Validator({"a": "exists:t,k", "b": "unique:t,k"}, tables).validate(spark.range(9).selectExpr("id AS a", "id + 3 AS b"))
    assert frame.df.count() == 9 and frame.df.where("_valid").count() == 3


def test_null_keys(spark):
    from gatehouse.operators.lookup import Lookup, flag

    rows = spark.createDataFrame([(k, None if k % 3 else k) for k in range(30)], "n int, v int")
    for held, nulls in (([0, 6, None], True), ([0, 6], False), ([], False)):
        tables = {"t": spark.createDataFrame([(x,) for x in held], "k int")}
        got = {r.n: r.f for r in flag(rows, "v", Lookup("t", "k"), tables, "f").collect()}
        assert got == {k: (nulls if k % 3 else k in held) for k in range(30)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = flag(rows, "v", Lookup("t", "k"), {"t": spark.range(9).withColumnRenamed("id", "k").selectExpr("cast(k AS INT) AS k")}, "f")
        assert out.where("f").count() == 3 and out.columns == ["n", "v", "f"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inline_rules_need_no_exchange(spark):
    plan = g.Validator({"id": "required|integer|min:3|in:4,5"}).validate(spark.range(5)).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_violations_are_pushed_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id AS double) AS price").write.parquet(str(tmp_path / "t"))
    out = g.Validator({"price": "required|numeric|min:10|max:90"}).violations(spark.read.parquet(str(tmp_path / "t")), ["id"])
    assert "PushedFilters: [Or" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 19


def test_an_anchored_expression_is_pushed_down_too(spark, tmp_path):
    from gatehouse.plans.engine import beginnings

    assert beginnings("/^[1-3]-/") == ["1-", "2-", "3-"] and beginnings("/^ab/") == ["ab"] and beginnings("/^[ac]x/") == ["ax", "cx"]
    assert all(beginnings(x) is None for x in ("/ab/", "/^a$/", "/^a*/", "/^a/i", "/^[^a]/", "/^.b/", "/^(a|b)/", "/^[a-z][a-z]/", r"/^\\d/"))
    spark.sql("SELECT id, concat(id % 7, '-', id) AS code FROM range(70)").write.parquet(str(tmp_path / "t"))
    out = g.Validator({"code": "regex:/^[1-5]-/"}).violations(spark.read.parquet(str(tmp_path / "t")), ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "StringStartsWith(code,1-)" in plan and out.count() == 20


def test_the_flagship_is_pushed_down(spark, tmp_path):
    from gatehouse import catalog

    rows = [(1, "O", 2000.0, "1-x"), (2, "", 2000.0, "2-x"), (3, "\t ", 2000.0, "2-x"), (4, None, 2000.0, "9-x"), (5, "P", 1.0, None), (6, "F", None, " "), (7, "F", 5e6, "5-")]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    out = catalog.orders_violations(spark, str(tmp_path))
    assert "PushedFilters: [Or" in out._jdf.queryExecution().executedPlan().toString()
    whole = catalog._orders_schema().validate(spark.read.parquet(f"{tmp_path}/orders.parquet")).failures(["o_orderkey"]).collect()
    assert sorted((r.o_orderkey, r.field, r.rule) for r in out.collect()) == sorted((r.o_orderkey, r.field, r.rule) for r in whole)


def test_callables_of_values(spark):
    import functools
    import operator

    class Longer:
        def __call__(self, value, name):
            return len(value) > len(name)

    df = spark.createDataFrame([("tide",), ("t",)], "name string")
    for fn in (lambda v: len(v) > 2, functools.partial(lambda n, v: len(v) > n, 2), operator.methodcaller("startswith", "ti"), lambda v: v in {"tide"}):
        assert [r.passes() for r in g.Validator({"name": [make_rule("callback", (fn,))]}).validate(df).records()] == [True, False]
        assert [r.passes() for r in g.Validator({"name": [make_rule("current_password", (fn,))]}).validate(df).records()] == [True, False]
    assert [r.passes() for r in g.Validator({"name": [make_rule("callback", (Longer(),))]}).validate(df).records()] == [False, False]
    assert [r.passes() for r in g.Validator({"name": [make_rule("callback", (lambda v, c: F.length(v) >= len(c.name),))]}).validate(df).records()] == [True, False]


def test_locale_packs_as_a_whole(spark):
    def packs(v):
        return v.set_locale_packs({"en": {"required": "Fill in :field."}, "de": {"required": "Bitte :field."}})

    assert result(spark, {"a": "required"}, (None,), "a string", setup=packs).errors == {"a": ["Fill in A."]}
    replaced = lambda v: packs(v).add_locale_pack("de", {"email": "Keine Adresse."}).set_locale("de")
    assert result(spark, {"a": "required"}, (None,), "a string", setup=replaced).errors == {"a": ["Fill in A."]}
    with pytest.raises(g.InvalidRule):
        g.Validator({"a": "required"}).set_nested_flatten_mode("some")
    assert g.Validator({"a": "required"}).set_nested_flatten_mode("all")


def test_casts_in_a_row(spark):
    v = g.Validator({"a": {"rules": "required", "cast": [lambda c: F.length(c), "string"]}, "b": {"rules": "required", "cast": "array"}})
    rows = v.validate(spark.createDataFrame([("tide", '{"x": "ebb", "y": "flow"}'), ("t", "ebb")], "a string, b string")).typed().collect()
    assert [(r.a, r.b) for r in rows] == [("4", ["ebb", "flow"]), ("1", ["ebb"])]


def test_results_give_values_as_attributes(spark):
    r = result(spark, {"depth": "required", "name": "required"}, (7, None), "depth int, name string")
    assert r.depth == 7 and r.name is None and "depth" in r and "name" not in r
    r.name = "buoy"
    assert r.get("name") == "buoy" and "name" in r


def test_schema_errors():
    for bad in ("nosuchrule", "starts_with:1", "ip:4", "before:2024x", "min", "uuid:x", "regex:abc"):
        with pytest.raises(g.InvalidRule):
            for r in parse_rules(bad):
                from pyspark.sql import types as T

                value = typesys.Value(F.lit("x"), T.StringType(), F.lit(True))
                r.predicate(g.operators.registry.Context("f", value, lambda n: value))
    with pytest.raises(g.InvalidRule):
        g.Validator({})
    assert split_rules("required|regex:/a|b/i|max:5") == ["required", "regex:/a|b/i", "max:5"]


def test_conditions_and_fragments(spark):
    g.define_fragment("address", {"line1": "required", "zip": "required|digits:5"})
    v = g.Validator({"kind": "required"}).use_fragment("address", "billing")
    assert set(v.schema) == {"kind", "billing.line1", "billing.zip"} and g.has_fragment("address") and not g.has_fragment("x")
    assert [r.name for r in parse_rules(g.compose_schemas({"a": "required"}, {"a": ["min:3"]})["a"])] == ["required", "min"]
    some = g.Validator({"kind": "required"}).sometimes("company", "required", lambda r: r("kind").col == "business")
    df = spark.createDataFrame([("business", None), ("personal", None)], "kind string, company string")
    assert [x.passes() for x in some.validate(df).records()] == [False, True]
    assert "zip" in g.Validator({"a": "required"}).when(True, {"zip": "required"}).schema


def test_results_and_exception(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "n int, s string")
    frame = g.validate(df, {"n": {"rules": "required", "cast": "string"}, "s": "string"})
    assert frame.valid().count() == 1 and frame.invalid().count() == 1 and frame.fails() and frame.typed().first().n == "1"
    assert not g.passes(df, {"n": "required"}) and g.fails(df, {"n": "required"}) and g.passes(df, {"s": "required"})
    with pytest.raises(g.ValidationException) as caught:
        g.validator({"n": "required"}).throw_on_failure().validate(df)
    assert caught.value.code == 422 and caught.value.first_field_error("n") == "The N field is required." and caught.value.error_count() == 1
    assert {(r.field, r.rule): r.failures for r in frame.report().collect()} == {("n", "required"): 1, ("n", None): 1, (None, None): 1}
    assert g.sanitize(df, "s", "uppercase").first().s == "X"
    import dataclasses

    @dataclasses.dataclass
    class Dto:
        n: str
        s: str

    assert list(frame.dtos(Dto)) == [Dto("1", "x")]


def test_message_bag():
    bag = g.MessageBag({"a": ["one", "one"], "b": "two"})
    assert bag.first() == "one" and bag.last() == "two" and bag.count() == 2 and bag.message_count() == 3 and bag.unique().message_count() == 2
    assert bag.only(["a"]).all() == {"a": ["one", "one"]} and list(bag.without(["a"])) == ["b"] and "c" not in bag and bag["c"] == []
    assert bag.to_string() == "- one\n- one\n- two" and bag.to_grouped_string().startswith("a:\n - one") and bag.to_html() == "<ul><li>one</li><li>one</li><li>two</li></ul>"
    assert json.loads(bag.to_json()) == bag.all() and bag.merge({"b": ["three"]}).get("b") == ["two", "three"] and g.MessageBag.from_flat(["x"]).all() == {"error": ["x"]}


def test_export():
    v = g.Validator({"email": "required|email|max:50", "age": "nullable|integer|between:1,9", "tags.*": "string|min:2", "a.b": "required|in:x,y", "code": "regex:/^a+$/|digits:4"})
    schema = v.export_schema()
    assert schema["required"] == ["email", "a"] and schema["properties"]["age"] == {"type": ["integer", "null"], "minimum": 1, "maximum": 9}
    assert schema["properties"]["tags"]["items"]["minLength"] == 2 and schema["properties"]["a"]["required"] == ["b"] and schema["properties"]["email"]["format"] == "email"
    assert "openapi" in v.export_schema("openapi") and v.export_schema("introspection")["email"]["optional"] is False
    assert struct_type(v).simpleString() == "struct<email:string,age:bigint,tags:array<string>,a:struct<b:string>,code:string>"
    with pytest.raises(g.InvalidRule):
        v.export_schema("xml")


def test_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (3).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"\x08\x02"
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.txt").write_text("plain")
    files = read_files(spark, str(tmp_path)).orderBy("path")
    rules = {"upload": "file|image|mimes:png|dimensions:3,2,3,2|extensions:png|secure_file|max:1"}
    assert [r.passes() for r in g.Validator(rules).validate(files).records()] == [True, False]
    assert g.Validator({"upload": "mimetypes:text/plain"}).validate(files).df.where("_valid").count() == 1
    assert udfs.image_size(b"GIF89a\x05\0\x06\0") == (5, 6) and udfs.image_size(b"nothing") is None and mime.primary_mime_type("JPG") == "image/jpeg" and not mime.has_extension("nope")


def test_callbacks_and_custom_rules(spark):
    g.register_rule("even", lambda c: typesys.true(c.value.col % 2 == 0), message="The :field must be even.")
    df = spark.createDataFrame([(2,), (3,)], "n int")
    assert [r.all_errors() for r in g.Validator({"n": "even"}).validate(df).records()] == [[], ["The N must be even."]]
    assert [r.passes() for r in g.Validator({"n": [make_rule("callback", (lambda v: v > 2,))]}).validate(df).records()] == [False, True]
    del g.operators.registry.RULES["even"]


def test_streaming(spark, tmp_path):
    from gatehouse.streaming.validate import split_stream, validate_stream

    source = tmp_path / "in"
    spark.range(10).write.parquet(str(source))
    stream = spark.readStream.schema("id long").parquet(str(source))
    v = g.Validator({"id": "required|max:6|exists:t,k"}, {"t": spark.range(5).withColumnRenamed("id", "k")})
    query = validate_stream(stream, v).writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT count(*) AS n FROM checked WHERE _valid").first().n == 5
    split_stream(stream, v, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 5 and spark.read.parquet(str(tmp_path / "bad")).count() == 5
