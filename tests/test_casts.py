"""Cast corpora: expected values are worked out from the ECMAScript rules."""

import math
import random
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from tableferry.functions.casts import cast_lenient, cast_strict, lenient_kind

NAN, INF = float("nan"), float("inf")


def run(spark, values, ddl, tag, cast=cast_strict, as_text=False, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    out = cast(F.col("v"), df.schema["v"].dataType, tag, **options)
    if as_text:
        out = F.date_format(out, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return [r[1] for r in df.select("i", out).orderBy("i").collect()]


NUMBERS = [
    ("", 0.0), ("   ", 0.0), ("\t\n", 0.0), ("\u00a0\ufeff", 0.0), (" 12 ", 12.0), ("\u00a012\u2003", 12.0),
    ("1e3", 1000.0), ("1E-2", 0.01), ("0x10", 16.0), ("0XfF", 255.0), ("0b11", 3.0), ("0o17", 15.0),
    ("-0x10", None), ("0x", None), ("0b2", None), ("0o8", None), ("Infinity", INF), ("-Infinity", -INF),
    ("inf", None), ("infinity", None), ("NaN", None), ("1,000", None), ("1.", 1.0), (".5", 0.5),
    (".", None), ("+3", 3.0), ("-3", -3.0), ("--3", None), ("12abc", None), ("1d", None), ("1f", None),
    ("1_000", None), ("1 2", None), ("1e", None), ("1e400", INF), ("true", None), (None, None),
    ("9007199254740993", 9007199254740992.0), ("0x20000000000001", 9007199254740992.0),
    ("0x1fffffffffffffffffff", float(0x1FFFFFFFFFFFFFFFFFFF)),
    ("0b" + "1" * 80, float(2**80)), ("0b1" + "0" * 90, float(2**90)),
    ("0o" + "7" * 30, float(8**30)), ("0o1" + "0" * 25 + "1", float(8**26)), ("0b000", 0.0),
]


def test_number_text(spark):
    got = run(spark, [a for a, _ in NUMBERS], "string", "NUMBER")
    assert list(zip([a for a, _ in NUMBERS], got)) == NUMBERS


def test_number_blank_as_null(spark):
    assert run(spark, ["", " ", "7"], "string", "NUMBER", blank_as_null=True) == [None, None, 7.0]


def test_number_of_other_types(spark):
    assert run(spark, [True, False, None], "boolean", "NUMBER") == [1.0, 0.0, None]
    assert run(spark, [5, None], "bigint", "NUMBER") == [5.0, None]
    assert run(spark, [1.1], "float", "NUMBER") == [1.1]
    assert run(spark, [datetime(1970, 1, 2)], "timestamp", "NUMBER") == [86400000.0]
    assert run(spark, [datetime(1970, 1, 2)], "timestamp_ntz", "NUMBER") == [86400000.0]
    assert run(spark, [[1]], "array<int>", "NUMBER") == [None]


TEXTS = [
    (1.0, "1"), (1e7, "10000000"), (123456789.25, "123456789.25"), (0.0001, "0.0001"),
    (1e-6, "0.000001"), (1.5e-6, "0.0000015"), (1e-7, "1e-7"), (1.25e-7, "1.25e-7"),
    (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (-0.0, "0"),
    (-1.5, "-1.5"), (NAN, "NaN"), (INF, "Infinity"), (-INF, "-Infinity"), (0.1 + 0.2, "0.30000000000000004"),
    (2.502303250895032e18, "2502303250895032000"), (4.82024e21, "4.82024e+21"), (9.7e21, "9.7e+21"),
    (-2.4066780722364163e17, "-240667807223641630"), (1.7976931348623157e308, "1.7976931348623157e+308"),
    (None, None), (1e-10, "1e-10"), (12345678.5, "12345678.5"), (-0.00012, "-0.00012"),
]


def test_text_of_doubles(spark):
    got = run(spark, [a for a, _ in TEXTS], "double", "STRING")
    assert got == [b for _, b in TEXTS]


def js_text(v: float) -> str:
    """ECMAScript Number::toString from Python's shortest digits."""
    if v == 0:
        return "0"
    sign, (mantissa, _, exp) = ("-" if v < 0 else ""), f"{abs(v)!r}".partition("e")
    whole, _, frac = mantissa.partition(".")
    digits = (whole + frac).lstrip("0")
    n = len(whole.lstrip("0")) if whole.strip("0") else -(len(frac) - len(frac.lstrip("0")))
    n += int(exp or 0)
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= n <= 21:
        return sign + digits + "0" * (n - k)
    if 0 < n <= 21:
        return sign + digits[:n] + "." + digits[n:]
    if -6 < n <= 0:
        return sign + "0." + "0" * -n + digits
    e = f"e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return sign + digits[0] + ("." + digits[1:] if k > 1 else "") + e


def test_text_of_random_doubles(spark):
    rng = random.Random(7)
    values = [rng.uniform(0, 1e6) for _ in range(2000)]
    values += [round(rng.uniform(0, 1e6), 2) * 10.0 ** rng.randint(-12, 22) for _ in range(6000)]
    values += [float(rng.randint(1, 2**62)) for _ in range(2000)]
    bits = (struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(4000))
    values += [v for v in bits if math.isfinite(v) and abs(v) > 1e-300]
    got = run(spark, values, "double", "STRING")
    wrong = [(v, g) for v, g in zip(values, got) if g != js_text(v)]
    assert not wrong, (len(wrong), wrong[:5], js_text(wrong[0][0]))


def test_text_of_other_types(spark):
    assert run(spark, [True, False], "boolean", "STRING") == ["true", "false"]
    assert run(spark, [2**62], "bigint", "STRING") == [str(2**62)]
    assert run(spark, [1.1, 3.0, 1e10, -0.0], "float", "STRING") == ["1.1", "3", "10000000000", "0"]
    moments = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 123456)]
    want = ["2024-01-02T03:04:05.000Z", "2024-01-02T03:04:05.123456Z"]
    assert run(spark, moments, "timestamp_ntz", "STRING") == want
    assert run(spark, [{"a": 1}], "map<string,int>", "STRING") == ['{"a":1}']


BOOLEANS = [
    ("true", True), (" T ", True), ("1", True), ("YES", True), ("y\n", True), ("false", False),
    ("F", False), ("0", False), ("No", False), ("\u00a0n", False), ("on", None), ("2", None),
    ("", None), ("1.0", None), (None, None),
]


def test_boolean(spark):
    got = run(spark, [a for a, _ in BOOLEANS], "string", "BOOLEAN")
    assert got == [b for _, b in BOOLEANS]
    assert run(spark, [0.0, -0.0, -1.0, NAN, None], "double", "BOOLEAN") == [False, False, True, True, None]
    assert run(spark, [0, 7], "int", "BOOLEAN") == [False, True]
    assert run(spark, [datetime(2024, 1, 1)], "timestamp", "BOOLEAN") == [None]


DATES = [
    ("2024-01-02", "2024-01-02T00:00:00.000000"), ("2024", "2024-01-01T00:00:00.000000"),
    ("2024-03", "2024-03-01T00:00:00.000000"), ("2024-01-02T03:04Z", "2024-01-02T03:04:00.000000"),
    ("2024-01-02T03:04:05.678+02:00", "2024-01-02T01:04:05.678000"),
    ("2024-01-02T03:04:05+0530", "2024-01-01T21:34:05.000000"),
    ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000000"), (" 2024-01-02 ", "2024-01-02T00:00:00.000000"),
    ("2024-01-02 03:04:05", "2024-01-02T03:04:05.000000"), ("01/02/2024", "2024-01-02T00:00:00.000000"),
    ("1/2/2024", "2024-01-02T00:00:00.000000"), ("Jan 2 2024", "2024-01-02T00:00:00.000000"),
    ("Jan 2, 2024", "2024-01-02T00:00:00.000000"), ("10:00", None), ("2024-02-30", None), ("", None),
    ("13/40/2024", None), ("Foo 2 2024", None), ("now", None), ("2024-1", None), (None, None),
]


def test_date(spark):
    got = run(spark, [a for a, _ in DATES], "string", "DATE", as_text=True)
    assert list(zip([a for a, _ in DATES], got)) == DATES


def test_date_of_numbers(spark):
    day = "1970-01-02T00:00:00.000000"
    assert run(spark, [86400000, 9 * 10**15], "bigint", "DATE", as_text=True) == [day, None]
    values = [86400000.9, NAN, INF, 9e15]
    assert run(spark, values, "double", "DATE", as_text=True) == [day, None, None, None]
    assert run(spark, [True], "boolean", "DATE", as_text=True) == ["1970-01-01T00:00:00.001000"]


def test_date_formats_can_be_added(spark):
    formats = [(r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy")]
    got = run(spark, ["31.12.2023"], "string", "DATE", as_text=True, date_formats=formats)
    assert got == ["2023-12-31T00:00:00.000000"]


@pytest.mark.parametrize("tag", [None, "", "string", "INTEGER"])
def test_unknown_strict_tag_keeps_the_value(spark, tag):
    assert run(spark, [1.5], "double", tag) == [1.5]


INTS = [
    ("5-LOW", 5), ("1e3", 1), ("1.9", 1), ("0x1F", 31), ("-0x1f", -31), ("  42px", 42), ("-7", -7),
    ("+7", 7), ("px", None), ("", None), ("0x", 0), ("99999999999999999999", None), (None, None),
]


def test_lenient_int(spark):
    got = run(spark, [a for a, _ in INTS], "string", "INT", cast_lenient)
    assert got == [b for _, b in INTS]
    values = [1.9, -1.9, 1e21, 2.5e-7, 0.5, -0.0, NAN, INF, 5e18]
    assert run(spark, values, "double", "bigint", cast_lenient) == [1, -1, 1, 2, 0, 0, None, None, 5 * 10**18]
    assert run(spark, [True], "boolean", "INT", cast_lenient) == [None]


def test_lenient_number(spark):
    got = run(spark, ["1.5", "x", "", None], "string", "FLOAT8", cast_lenient)
    assert got[0] == 1.5 and math.isnan(got[1]) and got[2] == 0.0 and got[3] is None


def test_lenient_bool(spark):
    values = ["TRUE", "true ", "1", "1.0", "0x1", "yes", "", None]
    want = [True, False, True, True, True, False, False, None]
    assert run(spark, values, "string", "boolean", cast_lenient) == want
    assert run(spark, [1.0, 2.0, NAN], "double", "BOOL", cast_lenient) == [True, False, False]


def test_lenient_date_and_text(spark):
    assert run(spark, ["2024", "x"], "string", "datetime", cast_lenient, as_text=True)[1] is None
    assert run(spark, [1.0], "double", "numeric", cast_lenient) == ["1"]
    assert run(spark, [1.0], "double", "", cast_lenient) == [1.0]


def test_lenient_tag_order():
    tags = ["POINT", "interval", "Decimal(3)", "double", "boolean", "datetime", "TIME", "NUMERIC", "real"]
    kinds = ["int", "int", "number", "number", "bool", "date", "date", "text", "text"]
    assert [lenient_kind(t) for t in tags] == kinds


def test_bad_cells_do_not_fail_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    for tag in ("NUMBER", "BOOLEAN", "DATE"):
        assert run(spark, ["\u0000", "é", "9" * 400 + "x"], "string", tag) == [None, None, None]


def test_types_are_stable(spark):
    df = spark.createDataFrame([("1",)], "v string")
    for tag, dt in [("STRING", T.StringType()), ("NUMBER", T.DoubleType()), ("BOOLEAN", T.BooleanType()), ("DATE", T.TimestampType())]:
        assert df.select(cast_strict(F.col("v"), T.StringType(), tag).alias("v")).schema["v"].dataType == dt


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024/01/02", "2024-01-02T00:00:00"), ("January 2, 2024", "2024-01-02T00:00:00"),
        ("2 Jan 2024", "2024-01-02T00:00:00"), ("Tue, 02 Jan 2024 10:00:00 GMT", "2024-01-02T10:00:00"),
        ("01/02/2024 10:00", "2024-01-02T10:00:00"), ("2024-1-5", "2024-01-05T00:00:00"),
        ("Tue Jan 02 2024 10:00:00 GMT+0000 (Coordinated Universal Time)", "2024-01-02T10:00:00"),
        ("Tue Jan 02 2024 10:00:00 GMT+0530 (India Standard Time)", "2024-01-02T04:30:00"),
        ("Jan 2 2024", "2024-01-02T00:00:00"), ("sept 3, 2024", "2024-09-03T00:00:00"), ("10:00", None), ("2024-02-30", None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_date_spellings_in_any_session(spark, text, want, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(text,)], "v string")
        cast = cast_strict(F.col("v"), T.StringType(), "DATE")
        (row,) = df.select(cast_strict(cast, T.TimestampType(), "STRING").alias("t")).collect()
        assert row.t == (want and want + ".000Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
