import pytest
from frames import rows

from pyspark.sql import functions as F

from runmetrics.functions import digest, maps, status, template, text, times
from runmetrics.operators import retry


def value(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_helpers(spark):
    assert value(spark, text.base64_encode(F.lit("hello world"))) == "aGVsbG8gd29ybGQ="
    assert value(spark, text.base64_decode(F.lit("aGVsbG8gd29ybGQ="))) == "hello world"
    assert value(spark, text.default_if_empty(F.lit(""), "fallback")) == "fallback"
    assert value(spark, text.sanitize_filename(F.lit("a b/c:é_1-2.txt"))) == "a_b_c_é_1-2.txt"
    assert value(spark, text.base64_encode(F.lit("x" * 100))).count("\n") == 0


def test_time_formats(spark):
    assert value(spark, times.format_time(F.lit("1704"), "%Y")) == "1970"
    assert value(spark, times.format_time(F.lit("2024-02-03T04:05:06.5+01:00"))) == "2024-02-03 03:05:06"
    assert value(spark, times.format_time(F.lit("soon"))) is None
    assert times.java_pattern("%Y year at %H%%") == "yyyy' year at 'HH'%'"
    with pytest.raises(ValueError):
        times.java_pattern("%Q")


@pytest.mark.parametrize("given, ms", [
    ("30s", 30_000), ("5m", 300_000), ("1h 30m", 5_400_000), ("1h30min", 5_400_000), ("2days", 172_800_000), ("500ms", 500),
    ("1M", 2_630_016_000), ("", None), ("5", None), ("5 lightyears", None),
])
def test_duration_text(spark, given, ms):
    assert value(spark, times.duration_text_ms(F.lit(given))) == ms


@pytest.mark.parametrize("number, digits, out", [(6.25, 1, "6.2"), (18.75, 1, "18.8"), (0.15, 1, "0.1"), (2.675, 2, "2.67"), (1234567.0, 1, "1234567.0")])
def test_fixed_decimals_round_the_exact_value_half_to_even(spark, number, digits, out):
    assert value(spark, times.fixed_text(F.lit(number), digits)) == out


@pytest.mark.parametrize("given, problem", [
    ("plain", None), ("{{ x }}", None), ("{a}", None), ("{{ a {{ b }} }}", "nested template expressions not allowed"),
    ("x }", "unmatched closing brace"), ("{{ x", "unmatched template braces"), ("{{ x }} {{ y }}", None), ("{{a}{b}}", None),
])
def test_braces(spark, given, problem):
    assert value(spark, text.brace_error(F.lit(given))) == problem


def test_many_braces(spark):
    assert value(spark, text.brace_error(F.lit("{{ x }} " * 20_000))) is None


def test_key_value_lists(spark):
    got = value(spark, text.key_value_map(F.array(F.lit("a=1"), F.lit("b=x=y"), F.lit("a=2"))))
    assert got == {"a": "2", "b": "x=y"}
    with pytest.raises(Exception, match="Invalid variable format"):
        value(spark, text.key_value_map(F.array(F.lit("novalue"))))


def test_later_maps_win(spark):
    merged = maps.merge_maps(maps.literal_map({"a": "1", "b": "1"}), maps.literal_map({"b": "2"}), maps.literal_map({}), maps.literal_map({"c": "3"}))
    assert value(spark, merged) == {"a": "1", "b": "2", "c": "3"}


@pytest.mark.parametrize("pattern, path, hit", [
    ("*.log", "/a/b/x.log", True), ("*.log", "/a/x.txt", False), ("/a/**/x", "/a/b/c/x", True), ("/a/**/x", "/a/x", True),
    ("/a/*/x", "/a/b/c/x", False), ("f?.t[!a]t", "/d/f1.txt", True), ("*.{gz,bz2}", "x.bz2", True), ("a+b", "a+b", True),
])
def test_globs(spark, pattern, path, hit):
    assert value(spark, text.glob_match(F.lit(path), [pattern])) is hit


def test_destination(spark):
    scheme, host = text.destination_parts(F.lit("s3:///key"))
    assert (value(spark, scheme), value(spark, host)) == ("s3", "")


def test_statuses(spark):
    names = ["Success", "PartialSuccess", "partial_success", "Timeout"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r.x for r in df.select(status.normalize_status("s").alias("x")).collect()] == ["success", "partial_success", "partial_success", "timeout"]
    assert value(spark, status.utilization(F.lit(2), F.lit(4))) == 50.0
    assert value(spark, status.utilization(F.lit(0), F.lit(0))) == 0.0


def test_digests(spark):
    assert value(spark, digest.digest(F.lit("abc"), "md5")) == "900150983cd24fb0d6963f7d28e17f72"
    assert value(spark, digest.digest(F.lit("abc"), "md5", as_base64=True)) == "kAFQmDzST7DWlj99KOF/cg=="
    assert len(value(spark, digest.digest(F.lit("abc"), "sha512"))) == 128
    with pytest.raises(ValueError):
        digest.digest(F.lit("abc"), "crc")


def test_backoff(spark):
    delay = lambda i, ms, cap: value(spark, times.backoff_delay(F.lit(i), F.lit(ms), F.lit(2.0), cap))
    assert [delay(i, 100, 1000) for i in range(3)] == [100, 200, 400]
    assert delay(2, 500, 600) == 600
    assert delay(5000, 500, 600) == 600


def test_retry_defaults(spark):
    defs = spark.createDataFrame([("w", "none", None, None, None), ("w", "partial", None, 50, None), ("w", "full", 3, 100, 2.0)],
                                 "workflow_name string, task_id string, max_attempts int, initial_delay_ms long, backoff_multiplier double")
    got = rows(retry.retry_schedule(defs), "task_id", "attempt", "delay_ms", "total_wait_ms")
    assert got == [("full", 0, 100, 100), ("full", 1, 200, 300), ("none", 0, 1000, 1000), ("none", 1, 2000, 3000)]


def test_templates(spark):
    df = spark.createDataFrame([({"a": "1"}, "N", None)], "vars map<string,string>, name string, gone string")
    out = df.select(template.render(df, "{{name}}|{{vars.a}}|{{vars.b}}|{{gone}}|{{none.at.all}}|{{{name}}}|{{upper 'x y'}}|{{default gone \"d\"}}").alias("x"))
    assert out.first().x == "N|1||||N|X Y|d"
    with pytest.raises(ValueError):
        template.render(df, "{{mystery name}}")
    assert df.select(template.render_data(F.lit("{{a}} {{ a }} {{zz}}"), "vars").alias("x")).first().x == "1 1 "


def test_period_bounds(spark):
    as_of = times.utc("2024-03-06T10:30:00Z")
    expected = {"hourly": ("2024-03-06 09", "2024-03-06 10"), "daily": ("2024-03-05 00", "2024-03-06 00"),
                "weekly": ("2024-02-26 00", "2024-03-04 00"), "monthly": ("2024-02-01 00", "2024-03-01 00")}
    for period, bounds in expected.items():
        got = [value(spark, F.date_format(b, "yyyy-MM-dd HH")) for b in times.period_bounds(period, as_of)]
        assert tuple(got) == bounds
    approx, _ = times.period_bounds("monthly", as_of, approx_month=True)
    assert value(spark, F.date_format(approx, "yyyy-MM-dd")) == "2024-01-31"


def test_json_templates_stay_json(spark):
    import json

    document = {"{{k}}": ["{{v}}", {"deep": {"x": "a {{ v }} {{none}}"}}, 1, None, True], "open": "{{ v", "close": "}}", "plain": "{v}"}
    values = {"k": 'ke"y', "v": 'l1\n\\ "q" {{k}} ß'}
    row = spark.createDataFrame([(json.dumps(document), values), (None, values), ("{}", {})], "d string, v map<string,string>")
    out = [r.o for r in row.select(template.render_json("d", "v").alias("o")).collect()]
    v = values["v"]
    assert json.loads(out[0]) == {'ke"y': [v, {"deep": {"x": f"a {v} "}}, 1, None, True], "open": "{{ v", "close": "}}", "plain": "{v}"}
    assert out[1:] == [None, "{}"]


def test_uuids_are_unique(spark):
    made = spark.range(5000).select(F.uuid().alias("u"))
    assert made.distinct().count() == 5000


def test_sha512_of_whole_texts(spark):
    import hashlib

    texts = ["", "abc", "ß" * 70_000]
    made = spark.createDataFrame([(x,) for x in texts], "t string").select(digest.digest("t", "sha512").alias("d"))
    assert [r.d for r in made.collect()] == [hashlib.sha512(x.encode()).hexdigest() for x in texts]
