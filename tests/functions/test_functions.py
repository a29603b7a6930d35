import datetime as dt
import uuid
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tessera.functions import clock, identity, scalars
from tessera.functions.arithmetic import compile_arithmetic


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()[0]


def test_casts(spark):
    cast = lambda v, k, t="string": one(spark, lambda c: scalars.cast_soft(c, k), v, t)
    assert [cast(v, "int") for v in ("7", " -3 ", "12.7", "x", None)] == [7, -3, None, None, None]
    assert cast(-2.7, "int", "double") == -2 and cast("1e3", "float") == 1000.0
    assert [cast(v, "bool") for v in ("YES", "t", "0", "", "maybe")] == [True, True, False, False, None]
    with pytest.raises(ValueError):
        scalars.cast_soft(F.lit(1), "date")


def test_lookup_keys(spark):
    look = lambda v, t, how="raw": one(spark, lambda c: scalars.lookup(c, {1: "one", "True": "yes", "x": None}, how, spark.createDataFrame([], f"v {t}").schema["v"].dataType), v, t)
    assert look(1, "long") == look(1.0, "double") == look("1", "string") == "one"
    assert look(True, "boolean") == "yes" and look("z", "string") == "z" and look("z", "string", "null") is None and look("x", "string") is None
    with pytest.raises(Exception, match="no entry"):
        look("z", "string", "error")


def test_regex_and_split(spark):
    got = lambda v, p, g: one(spark, lambda c: scalars.regex_group(c, p, g), v)
    assert got("38.4 - -0.45", r"(?P<lat>[-\d.]+) - (?P<lon>[-\d.]+)", "lon") == "-0.45"
    assert got("none", r"(?P<lat>\d+)", "lat") is None
    assert one(spark, lambda c: scalars.split_part(c, ".", -1), "a.b.c") == "c" and one(spark, lambda c: scalars.split_part(c, "/", 0), "a/b") == "a"
    assert one(spark, lambda c: scalars.split_part(c, "."), "a.b") == ["a", "b"] and one(spark, lambda c: scalars.split_part(c, ".", 5), "a.b") is None


@pytest.mark.parametrize("expression", ["value // 3", "value % 3", "-value ** 2", "round(value / 4, 1)", "1 if value > 2 else -1", "abs(value) + int(value / 2)", "value * 3.6 - 1"])
def test_arithmetic_is_pythons(spark, expression):
    fn = compile_arithmetic(expression)
    for v in (-7.0, -1.5, 0.0, 2.5, 9.0):
        assert one(spark, fn, v, "double") == pytest.approx(eval(expression, {"value": v}))  # noqa: S307


def test_arithmetic_lets_nothing_else_through(spark):
    for bad in ("__import__('os')", "value.real", "open('x')", "[1]", "lambda: 1", "other + 1"):
        with pytest.raises(ValueError):
            compile_arithmetic(bad)(F.lit(1.0))
    assert one(spark, compile_arithmetic("1 / value"), 0.0, "double") is None


def test_epochs_and_formats(spark):
    us = lambda v, e, t="double": one(spark, lambda c: clock.epoch_us(c, e), v, t)
    assert us(1.5, "unix_s") == 1_500_000 and us(0.0, "cocoa") == 978307200000000 and us(11644473600e6, "webkit") == 0 and us(1500.0, "unix_ns") == 2 and us("2.5", "unix_ms", "string") == 2500
    wall = one(spark, lambda c: clock.strptime_us(c, "%d.%m.%Y %H:%M:%S.%f")[0], "06.12.2025 13:00:00.5")
    assert wall == 1765026000500000
    at = one(spark, lambda c: F.array(*[x.cast("double") for x in clock.strptime_us(c, "%Y-%m-%dT%H:%M:%S%z")]), "2025-12-06T13:00:00+0530")
    assert at == [1765026000000000.0, 5.5]
    with pytest.raises(Exception):
        one(spark, lambda c: clock.strptime_us(c, "%Y-%m-%d")[0], "junk")


def test_iso8601(spark):
    iso = lambda v: one(spark, lambda c: F.array(*[x.cast("double") for x in clock.iso_us(c)]), v)
    assert iso("2025-12-05T10:19:15.073+00:00") == [1764929955073000.0, 0.0]
    assert iso("2025-12-05T10:19:15Z") == [1764929955000000.0, 0.0] and iso("2025-12-05 10:19:15-05:30")[1] == -5.5
    assert iso("2025-12-05T10:19:15") == [1764929955000000.0, None] and iso("2025-12-05") == [1764892800000000.0, None]
    assert iso("junk") == iso("") == [None, None]


def test_zones(spark):
    hours = lambda v: one(spark, clock.zone_offset, v)
    assert [hours(v) for v in ("UTC+02:00", "UTC-3", "GMT", "Z", "5.5", "UTC+01:00[DST]", "local", "", None)] == [2.0, -3.0, 0.0, 0.0, 5.5, 1.0, None, None, None]
    local = lambda v: one(spark, clock.zone_is_local, v)
    assert [local(v) for v in ("UTC+01:00[DST]", "local", "UTC", None)] == [True, True, False, False]


@pytest.mark.parametrize("wall", ["2025-10-26 02:30", "2025-03-30 02:30", "2025-12-06 13:00", "2025-07-06 13:00"])
def test_local_time_is_zoneinfos(spark, wall):
    naive = dt.datetime.fromisoformat(wall)
    zone = ZoneInfo("Europe/Paris")
    want = int(naive.replace(tzinfo=zone, fold=0).timestamp() * 1e6)
    us = int(naive.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    got = spark.range(1).select(clock.local_to_utc_us(F.lit(us), "Europe/Paris").alias("u"), clock.wall_clock_anomaly(F.lit(us), F.lit("Europe/Paris")).alias("a")).first()
    assert got.u == want and got.a == {"2025-10-26 02:30": "overlap", "2025-03-30 02:30": "gap"}.get(wall)
    assert spark.range(1).select(clock.offset_at(F.lit(want), "Europe/Paris")).first()[0] == dt.datetime.fromtimestamp(want / 1e6, zone).utcoffset().total_seconds() / 3600


def test_uuid5(spark):
    for name in ("", "a|b|1", "é€😀"):
        assert one(spark, lambda c: identity.uuid5(identity.ROW_SPACE, c), name) == str(uuid.uuid5(identity.ROW_SPACE, name))
