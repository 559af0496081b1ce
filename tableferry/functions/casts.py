"""The strict and the lenient cast dialects as native Spark expressions.

Every function takes a ``Column`` and its Spark type and returns a ``Column``;
nothing here leaves the JVM, so a mapping stays inside one code-generated
projection.  A bad cell becomes NULL (or NaN in the lenient number cast), it
never fails the job, also under ANSI mode.

Instants are read and printed in UTC, whatever the time zone of the session is.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tableferry import fixed

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FLOATING + (T.DecimalType,)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

# ISO text: year, optional month and day, optional time and zone.  A leading
# year is required, because Spark reads a bare '10:00' as today at ten.
_ISO = r"^(\d{4}(?:-\d{2}(?:-\d{2})?)?)(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"

# Other spellings read by DATE.  A weekday before and a zone's name in brackets after it
# do not count; time and zone are optional; a date without a zone is in UTC.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_NAME = r"((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)\.?"
_WEEKDAY = r"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?"
_CLOCK = r"(?:,?[T ]+(\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?)?(?: ?(?:gmt|utc|z))?([+-]\d{2}:?\d{2})?(?: \([^)]*\))?$"
# Pattern of the date, and which of its groups are year, month and day.
DATE_SPELLINGS = (
    (r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", (1, 2, 3)),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    (_NAME + r" +(\d{1,2}),? +(\d{4})", (3, 1, 2)),
    (r"(\d{1,2})[ -]" + _NAME + r",?[ -](\d{4})", (3, 2, 1)),
)
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
DAY_MICROS = 86_400_000_000


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.JS_WHITESPACE))


# --- text ------------------------------------------------------------------


def _shortest(v: Column, text: Column) -> Column:
    """Scientific text with the fewest digits that read back as ``v``.

    Java prints some doubles beyond 2**53 with more digits than they need, and
    then always with 16 digits or more.
    """
    formats = [F.lit(f"%.{p}e") for p in (14, 15)]
    fit = [F.printf(f, v).try_cast("double") == v for f in formats]
    best = F.when(fit[0], formats[0]).when(fit[1], formats[1]).otherwise("%.16e")
    return F.when(F.length(text) < 19, text).otherwise(F.printf(best, v))


def _integer_text(v: Column) -> Column:
    """Whole doubles from 2**53 up to 9.2e18: the fewest leading digits, then zeros.

    Neighbours lie at most 1024 apart there, so only the last four digits can be
    zeros that the exact integer does not have.
    """
    n = v.cast("bigint")
    fewer = [F.when(F.bround(n, -k).cast("double") == v, F.bround(n, -k)) for k in (4, 3, 2, 1)]
    return F.coalesce(*fewer, n).cast("string")


def _plain(text: Column, scale: int) -> Column:
    """Scientific text written out in full, without zeros at the end."""
    full = text.try_cast(T.DecimalType(38, scale)).cast("string")
    return F.rtrim(F.rtrim(full, F.lit("0")), F.lit("."))


def _scientific(text: Column, size: Column) -> Column:
    """``1.0E21`` as ``1e+21`` and ``2.50e-08`` as ``2.5e-8``."""
    bare = F.regexp_replace(F.lower(text), r"\.?0*e\+?(-?)0*", "e$1")
    return F.when(size >= 1, F.replace(bare, F.lit("e"), F.lit("e+"))).otherwise(bare)


def _double_text(v: Column) -> Column:
    """Full digits from 1e-6 up to 1e21, and an exponent beyond.

    Below 2**53 a double that is not whole has at most 16 digits before the point
    and, from 1e-6 on, 22 after it.
    """
    text, size = v.cast("string"), F.abs(v)
    return (
        F.when((size < 9007199254740992.0) & (v == F.floor(v)), v.cast("bigint").cast("string"))
        .when(~text.contains("E"), text)
        .when((size >= 1e-6) & (size < 9007199254740992.0), _plain(text, 22))
        .when((size >= 1e-6) & (size < 9.2e18), _integer_text(v))
        .when((size >= 1e-6) & (size < 1e21), _plain(_shortest(v, text), 15))
        .when((size < 1e-6) | (size >= 1e21), _scientific(_shortest(v, text), size))
    )


def _float_text(v: Column) -> Column:
    """The same for floats, which have nine digits at most."""
    text, size = v.cast("string"), F.abs(v)
    return (
        F.when((size < 16777216.0) & (v == F.floor(v)), v.cast("bigint").cast("string"))
        .when(~text.contains("E"), text)
        .when((size >= 1e-6) & (size < 1e21), _plain(text, 15))
        .when((size < 1e-6) | (size >= 1e21), _scientific(text, size))
    )


def epoch_micros(c: Column, dt: T.DataType) -> Column:
    """Microseconds since 1970 of an instant, a wall-clock time in UTC or a date."""
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("bigint") * DAY_MICROS
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), c)
    return F.unix_micros(c)


def _instant(c: Column, dt: T.DataType) -> Column:
    return c if isinstance(dt, T.TimestampType) else F.timestamp_micros(epoch_micros(c, dt))


def _timestamp_text(micros: Column) -> Column:
    """ISO-8601 UTC text; microseconds are shown only where there are any."""
    day = F.date_from_unix_date(F.floor(micros / DAY_MICROS).cast("int")).cast("string")
    rest = F.pmod(micros, F.lit(DAY_MICROS))

    def part(unit: int, of: int, width: int = 2) -> Column:
        value = F.floor(rest / unit).cast("bigint") % of
        return F.lpad(value.cast("string"), width, "0")

    fraction = F.when(micros % 1000 == 0, part(1000, 1000, 3)).otherwise(part(1, 1_000_000, 6))
    clock = [part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60)]
    return F.concat(day, F.lit("T"), *clock, F.lit("."), fraction, F.lit("Z"))


def js_text(c: Column, dt: T.DataType) -> Column:
    """Text form of a value: numbers as ECMAScript prints them, instants as ISO."""
    if is_string(dt):
        return c
    if isinstance(dt, T.DoubleType):
        return _double_text(c)
    if isinstance(dt, T.FloatType):
        return _float_text(c)
    if isinstance(dt, TEMPORAL):
        return _timestamp_text(epoch_micros(c, dt))
    if isinstance(dt, NESTED):
        return F.to_json(c)
    return c.cast("string")


# --- numbers ---------------------------------------------------------------


def _radix_number(s: Column) -> Column:
    """``0b`` and ``0o`` digits, rounded once to a double.

    The leading 60 bits go through ``conv``; whatever follows only matters for
    rounding, so it is folded into the lowest bit and the rest is a power of two.
    """
    digits = F.regexp_replace(s, "^0[bBoO]0*", "")
    binary = F.lower(F.substring(s, 2, 1)) == "b"
    radix, bits, room = (F.when(binary, x).otherwise(y) for x, y in ((2, 8), (1, 3), (60, 20)))
    head = F.call_function("conv", F.substring(digits, F.lit(1), room), radix, F.lit(10))
    rest = F.rtrim(F.substring(digits, room + 1, F.length(digits)), F.lit("0"))
    odd = F.when(F.length(rest) > 0, 1).otherwise(0).cast("bigint")
    scale = F.pow(F.lit(2.0), bits * F.greatest(F.length(digits) - room, F.lit(0)))
    return F.when(F.length(digits) == 0, 0.0).otherwise(
        head.cast("bigint").bitwiseOR(odd).cast("double") * scale
    )


def _number_from_text(c: Column, blank_as_null: bool) -> Column:
    s = js_trim(c)
    blank = F.lit(None).cast("double") if blank_as_null else F.lit(0.0)
    return (
        F.when(c.rlike(fixed.JS_DECIMAL), c.try_cast("double"))
        .when(s == "", blank)
        .when(s.rlike(fixed.JS_DECIMAL), s.try_cast("double"))
        # Java reads hexadecimal doubles, which end in a binary exponent
        .when(s.rlike("^0[xX][0-9a-fA-F]+$"), F.concat(s, F.lit("p0")).try_cast("double"))
        .when(s.rlike("^0([bB][01]+|[oO][0-7]+)$"), _radix_number(s))
    )


def js_number(c: Column, dt: T.DataType, blank_as_null: bool = False) -> Column:
    """A double, or NULL where the value does not read as a number.

    Blank text is 0 unless ``blank_as_null``; an instant is its epoch in
    milliseconds; integers above 2**53 lose digits, as doubles do.
    """
    if is_string(dt):
        return _number_from_text(c, blank_as_null)
    if isinstance(dt, T.FloatType):
        return c.cast("string").try_cast("double")
    if isinstance(dt, NUMERIC):
        return c.cast("double")
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dt, TEMPORAL):
        return F.floor(epoch_micros(c, dt) / 1000).cast("double")
    return F.lit(None).cast("double")


# --- booleans --------------------------------------------------------------


def _boolean(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.BooleanType):
        return c
    if isinstance(dt, NUMERIC):
        return c != 0
    if is_string(dt):
        word = F.lower(js_trim(c))
        return F.when(word.isin(*fixed.TRUE_WORDS), True).when(
            word.isin(*fixed.FALSE_WORDS), False
        )
    return F.lit(None).cast("boolean")


# --- dates -----------------------------------------------------------------


def _groups(s: Column, pattern: str, places: tuple[int, ...]) -> list[Column]:
    """Groups of a whole match, '' for those that took no part; one pass over the text."""
    found = F.split(F.regexp_replace(s, pattern, ";".join(f"${i}" for i in places)), ";", -1)
    return [F.get(found, F.lit(k)) for k in range(len(places))]


def _spelled(s: Column, pattern: str, places: tuple[int, int, int]) -> Column:
    """The instant of a date spelled by ``pattern``, with optional time and zone."""
    whole = "(?i)" + _WEEKDAY + pattern + _CLOCK
    year, month, day, hour, minute, second, fraction, zone = _groups(s, whole, (*places, 4, 5, 6, 7, 8))
    named = F.floor((F.call_function("locate", F.lower(F.substring(month, 1, 3)), F.lit(_MONTHS)) + 2) / 3).cast("string")
    two = lambda c: F.lpad(c, 2, "0")
    month = F.when(month.rlike("^[0-9]"), month).otherwise(named)
    iso = F.concat(
        year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit("T"), two(hour), F.lit(":"), two(minute),
        F.lit(":"), two(second), fraction, F.when(zone == "", "Z").otherwise(zone),
    )
    return F.when(s.rlike(whole), iso.try_cast("timestamp"))


def _iso_date(s: Column) -> Column:
    """ISO text; without a zone it is in UTC."""
    day, minute, second, zone = _groups(s, _ISO, (1, 2, 3, 4))
    full = F.when(F.length(day) == 4, F.concat(day, F.lit("-01-01"))).when(
        F.length(day) == 7, F.concat(day, F.lit("-01"))
    )
    clock = F.concat(
        F.when(minute == "", "00:00").otherwise(minute), F.when(second == "", ":00").otherwise(second),
        F.when(zone == "", "Z").otherwise(zone),
    )
    return F.concat(F.coalesce(full, day), F.lit("T"), clock).try_cast("timestamp")


def _date(c: Column, dt: T.DataType, formats=()) -> Column:
    """``formats`` are further (pattern, format) pairs, tried after the spellings known here."""
    if isinstance(dt, TEMPORAL):
        return _instant(c, dt)
    if isinstance(dt, T.BooleanType):
        return F.timestamp_millis(c.cast("bigint"))
    if isinstance(dt, INTEGRAL):
        n = c.cast("bigint")
        limit = int(fixed.JS_MAX_DATE_MILLIS)
        return F.when(n.between(-limit, limit), F.timestamp_millis(n))
    if isinstance(dt, NUMERIC):
        n = c.cast("double")
        ok = F.abs(n) <= fixed.JS_MAX_DATE_MILLIS  # NaN sorts above, so it is out
        return F.when(ok, F.timestamp_millis(F.when(ok, n).cast("bigint")))
    if is_string(dt):
        s = js_trim(c)
        spelled = [_spelled(s, pattern, places) for pattern, places in DATE_SPELLINGS]
        more = [F.try_to_timestamp(F.when(s.rlike(guard), s), F.lit(fmt)) for guard, fmt in formats]
        return F.when(s.rlike(_ISO), _iso_date(s)).otherwise(F.coalesce(*spelled, *more))
    return F.lit(None).cast("timestamp")


# --- the two dialects ------------------------------------------------------


def cast_strict(
    c: Column,
    dt: T.DataType,
    tag: str | None,
    *,
    blank_as_null: bool = False,
    date_formats=(),
) -> Column:
    """STRING, NUMBER, BOOLEAN or DATE; any other tag leaves the value alone."""
    if tag == "STRING":
        return js_text(c, dt)
    if tag == "NUMBER":
        return js_number(c, dt, blank_as_null)
    if tag == "BOOLEAN":
        return _boolean(c, dt)
    if tag == "DATE":
        return _date(c, dt, date_formats)
    return c


def lenient_kind(tag: str) -> str:
    """Which lenient cast a type name asks for; the first fragment found wins."""
    name = tag.upper()
    return next((kind for part, kind in fixed.LENIENT_FRAGMENTS if part in name), "text")


def _leading_int_of_double(v: Column) -> Column:
    """The integer at the start of a double's text, which may be ``1e+21`` or ``5e-7``."""
    size, bigint = F.abs(v), "bigint"
    first_digit = F.regexp_extract(_shortest(v, v.cast("string")), r"^-?\d", 0)
    return (
        F.when(size == 0, F.lit(0).cast(bigint))
        .when((size >= 1e-6) & (size < 1e21), F.when(size < 2.0**63, v).cast(bigint))
        .when(size < float("inf"), first_digit.try_cast(bigint))
    )


def _leading_int(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, INTEGRAL):
        return c.cast("bigint")
    if isinstance(dt, T.DecimalType):
        return c.try_cast("bigint")
    if isinstance(dt, FLOATING):
        return _leading_int_of_double(c.cast("double"))
    if not is_string(dt):
        return F.lit(None).cast("bigint")
    s = js_trim(c)
    sign = F.when(s.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    hexa = F.ltrim(F.regexp_extract(s, r"^[+-]?0[xX]([0-9a-fA-F]+)", 1), F.lit("0"))
    from_hex = F.when(F.length(hexa) == 0, F.lit(0).cast("bigint")).when(
        F.length(hexa) <= 15, sign * F.conv(hexa, 16, 10).try_cast("bigint")
    )
    plain = F.regexp_extract(s, r"^[+-]?[0-9]+", 0)
    return (
        F.when(s.rlike(r"^[+-]?0[xX][0-9a-fA-F]"), from_hex)
        .when(F.length(plain) > 0, plain.try_cast("bigint"))
    )


def cast_lenient(c: Column, dt: T.DataType, tag: str | None, *, date_formats=()) -> Column:
    """Casts by type-name fragment: ``INTEGER``, ``DOUBLE``, ``BOOL``, ``DATETIME`` ..."""
    if not tag:
        return c
    kind = lenient_kind(tag)
    if kind == "int":
        return _leading_int(c, dt)
    if kind == "number":
        return F.when(c.isNotNull(), F.coalesce(js_number(c, dt), F.lit(float("nan"))))
    if kind == "bool":
        if isinstance(dt, T.BooleanType):
            return c
        is_one = F.coalesce(js_number(c, dt) == 1.0, F.lit(False))
        says_true = F.lower(c) == "true" if is_string(dt) else F.lit(False)
        return F.when(c.isNotNull(), says_true | is_one)
    if kind == "date":
        return _date(c, dt, date_formats)
    return js_text(c, dt)


def result_type(dt: T.DataType, tag: str | None, dialect: str = "strict") -> T.DataType:
    """Spark type a cast gives; used for columns the source does not have."""
    if not tag:
        return dt
    if dialect == "lenient":
        kind = lenient_kind(tag)
    else:
        kind = {"STRING": "text", "NUMBER": "number", "BOOLEAN": "bool", "DATE": "date"}.get(tag)
    return {
        "text": T.StringType(),
        "number": T.DoubleType(),
        "bool": T.BooleanType(),
        "date": T.TimestampType(),
        "int": T.LongType(),
    }.get(kind, dt)
