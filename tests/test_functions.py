import pytest
from pyspark.sql import functions as F
from tidemark import functions as X
from tidemark import lsn
from tidemark.errors import PlanError
from tidemark.plans import CapturePlan, Stream, parse_pattern


def one(spark, column, **values):
    types = {int: "long", str: "string", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,number", [("0/0", 0), ("1/0", 1 << 32), ("FFFFFFFF/FFFFFFFF", (1 << 64) - 1), ("0/zz", None), ("12", None), ("", None), ("1/2/3", None)])
def test_lsn(spark, text, number):
    got = one(spark, X.parse_lsn(F.col("t")), t=text)
    assert (None if got is None else int(got)) == number == lsn.position(text)


def test_lsn_order(spark):
    f = lambda a, b: one(spark, X.lsn_is_at_or_before(F.col("a"), F.col("b")), a=a, b=b)
    for a, b, want in (("0/10", "0/F", False), ("0/F", "0/10", True), ("1/0", "0/FFFFFFFF", False), ("x", "x", True), ("x", "0/1", False)):
        assert f(a, b) is want is lsn.at_or_before(a, b)


def test_clock_truncates_toward_zero(spark):
    for micros, ms in ((1999, 1), (-1999, -1), (-2000, -2), (0, 0)):
        assert one(spark, X.pg_time_to_unix_ms(F.col("m")), m=micros) == X.EPOCH_2000_MS + ms


def test_markers_are_unambiguous(spark):
    assert one(spark, X.marker(F.col("s"), F.col("l")), s="é:1", l="0/8") == "tx-v1:4:é:1:0/8"


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1536, "1.5 KiB"), (5 << 30, "5.0 GiB"), (3 << 40, "3.0 TiB")])
def test_human_bytes(spark, n, want):
    assert one(spark, X.human_bytes(F.col("n")), n=n) == want


def test_shorten(spark):
    for width, want in ((10, "é234567"), (7, "é234567"), (6, "é23..."), (3, "..."), (2, "..")):
        assert one(spark, X.shorten(F.col("t"), width), t="é234567") == want


@pytest.mark.parametrize(
    "message,state,again",
    [("x (SQLSTATE 08006)", "08006", True), ("(SQLSTATE 53300)", "53300", True), ("(SQLSTATE 55006)", "55006", True), ("(SQLSTATE 57P02)", "57P02", True),
     ("(SQLSTATE 57P04)", "57P04", False), ("(SQLSTATE 42601)", "42601", False), ("(SQLSTATE 08006) more", None, False), ("none", None, False)],
)
def test_sqlstate(spark, message, state, again):
    assert one(spark, X.sqlstate(F.col("m")), m=message) == state
    assert one(spark, X.retryable_sqlstate(X.sqlstate(F.col("m"))), m=message) is again


def test_backoff(spark):
    got = [r["x"] for r in spark.range(20).select(X.reconnect_delay_ms(F.col("id")).alias("x")).collect()]
    assert got[:7] == [250, 500, 1000, 2000, 4000, 8000, 15000] and set(got[7:]) == {15000}


def test_key_templates(spark):
    f = lambda t, image: one(spark, X.render_key(t, F.col("i")), i=image)
    assert f("tenant:{a}:row:{b}", '{"a":"x","b":7}') == "tenant:x:row:7"
    assert f("{a}", '{"a":true}') == "true"
    assert f("a}b{id}", '{"id":"1"}') == "a}b1"
    for image in ('{"a":null}', '{"a":[1]}', '{"a":{"b":1}}', "{}", "[1]", "no json", None):
        assert f("{a}", image) is None
    for bad in ("{", "{}", "x{id", "{id}y}", "{a{b}}"):
        with pytest.raises(ValueError):
            X.compile_template(bad)


def test_unchanged_values(spark):
    f = lambda image: one(spark, X.contains_unchanged(F.col("i")), i=image)
    assert f('{"a":{"__unchanged_toast":true}}') and f('{"a":{"__unchanged_toast": true},"b":"x"}')
    assert not any(map(f, ('{"a":{"__unchanged_toast":false}}', '{"a":{"__unchanged_toast":"true"}}', '{"a":"x"}', '{"a":null}', None)))


def test_is_object(spark):
    f = lambda image: one(spark, X.is_object(F.col("i")), i=image)
    assert [f(x) for x in ('{"a":1}', "{}", "[1]", "1", "bad{", None)] == [True, True, False, False, False, None]


def test_zero_safe_and_saturating(spark):
    assert one(spark, X.divide(F.lit(5), F.lit(0))) == 0.0 and one(spark, X.divide(F.lit(5), F.lit(2))) == 2.5
    assert one(spark, X.saturating_sub(F.lit(3), F.lit(5))) == 0


@pytest.mark.parametrize("text", ["", "a", "a.", ".b", "a.b.c", " a.b", "a.b ", "a. b", "**"])
def test_bad_patterns(text):
    assert parse_pattern(text) is None


def test_patterns_match():
    assert parse_pattern("*").matches("x", "y") and parse_pattern("a.*").matches("a", "z") and not parse_pattern("a.*").matches("A", "z")
    assert parse_pattern("a.b").matches("a", "b") and not parse_pattern("a.b").matches("a", "c")
    assert parse_pattern("*.t").schema == "*" and not parse_pattern("*.t").matches("a", "t")


def test_plans():
    ok = Stream("s", "p", ("public.a", "x.*"))
    for bad in ([], [Stream(" ", "p", ("*",))], [ok, ok], [Stream("s", "q", ("*",))], [Stream("s", "p", ())], [Stream("s", "p", ("a",))]):
        with pytest.raises(PlanError):
            CapturePlan.of("p", bad)
    plan = CapturePlan.of("p", [ok, Stream("t", "p", ("public.a",))])
    assert len(plan.patterns) == 2 and plan.matches("x", "q") and not plan.matches("public", "b")


def test_stream_predicates_skip_what_is_no_pattern(spark):
    df = spark.createDataFrame([("public", "a"), ("public", "b"), ("x", "a")], "schema string, table string")
    assert df.filter(Stream("s", "p", ("nonsense", "public.a")).column()).count() == 1
    assert df.filter(Stream("s", "p", ("nonsense",)).column()).count() == 0
    assert df.filter(Stream("s", "p", ("*",)).column()).count() == 3
