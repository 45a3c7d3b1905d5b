"""Measures written as text, to numbers; what can't be read is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
INCH_PER_M, NBI_INCH_PER_M = 39.3700787402, 39.3700787
POUNDS = {
    "t": 2204.62262185, "tonne": 2204.62262185, "tonnes": 2204.62262185, "mt": 2204.62262185, "kg": 2.20462262185, "kgs": 2.20462262185,
    "lb": 1.0, "lbs": 1.0, "pound": 1.0, "pounds": 1.0, "st": 2000.0, "lt": 2240.0,
}
UNLIMITED_M = 99.99
_NUM = r"(\d[\d.,]*)"
FEET_INCHES = rf"(?i)^{_NUM}\s*(?:'|′|ft\.?|feet|foot)\s*(?:{_NUM}\s*(?:\"|''|″|in\.?|inches|inch)?)?$"
INCHES = rf"(?i)^{_NUM}\s*(?:\"|''|″|in\.?|inches|inch)$"
METRES = rf"(?i)^{_NUM}\s*(?:m|meter|meters|metre|metres)$"
CENTIMETRES = rf"(?i)^{_NUM}\s*(?:cm|centimeters?|centimetres?)$"
BARE = rf"^{_NUM}$"
WEIGHT = rf"(?i)^{_NUM}\s*([a-z]+)\.?$"


def number(c: Column) -> Column:
    """26,000 and 4,1 and 4.1 are read; a comma of any other kind makes null."""
    thousands = c.rlike(r"^\d{1,3}(?:,\d{3})+(?:\.\d+)?$")
    decimal = c.rlike(r"^\d+,\d+$")
    s = F.when(thousands, F.regexp_replace(c, ",", "")).when(decimal, F.regexp_replace(c, ",", ".")).when(~c.contains(","), c)
    return s.try_cast("double")


def _group(c: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def _fits(value: Column, places: int, limit: float) -> Column:
    v = F.round(value, places)
    return F.when((v > 0) & (v < limit), v)


def length_in(c: Column) -> Column:
    """A length tag in inches: feet and inches, inches, cm, m; a bare number is metres.  One decimal; null beyond 99999.9."""
    s = F.trim(c)
    inches = F.when(_group(s, FEET_INCHES, 2).isNull(), F.lit(0.0)).otherwise(number(_group(s, FEET_INCHES, 2)))
    value = (
        F.when(s.rlike(FEET_INCHES), number(_group(s, FEET_INCHES)) * 12.0 + inches)
        .when(s.rlike(INCHES), number(_group(s, INCHES)))
        .when(s.rlike(CENTIMETRES), number(_group(s, CENTIMETRES)) / 100.0 * INCH_PER_M)
        .when(s.rlike(METRES), number(_group(s, METRES)) * INCH_PER_M)
        .when(s.rlike(BARE), number(_group(s, BARE)) * INCH_PER_M)
    )
    return _fits(value, 1, 1e5)


def weight_lb(c: Column) -> Column:
    """A weight tag in pounds; a bare number is tonnes.  Whole; null from a thousand million on."""
    s = F.trim(c)
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in POUNDS.items() for x in kv]), F.lower(F.regexp_extract(s, WEIGHT, 2)))
    value = F.when(s.rlike(BARE), number(_group(s, BARE)) * POUNDS["t"]).when(s.rlike(WEIGHT), number(_group(s, WEIGHT)) * factor)
    v = F.bround(value, 0)
    return F.when((v > 0) & (v < 1e9), v)


def clearance_in(c: Column) -> Column:
    """Metres of a bridge record as inches; the code for unlimited, zero and junk are null."""
    m = F.when(c.rlike(r"^[0-9.]+$"), c.try_cast("double"))
    return F.when((m > 0) & (m != UNLIMITED_M), F.round(m * NBI_INCH_PER_M, 1))


def packed_dms(c: Column, degree_digits: int) -> Column:
    """Degrees, minutes and hundredths of seconds in one digit string to decimal degrees; null unless minutes and
    seconds are below 60 and the value is not zero."""
    width = degree_digits + 6
    s = F.lpad(F.trim(c), width, "0")
    part = lambda a, n: F.substring(s, a, n).try_cast("double")
    deg, minute, sec = part(1, degree_digits), part(degree_digits + 1, 2), part(degree_digits + 3, 4) / 100.0
    ok = F.trim(c).rlike(rf"^\d{{1,{width}}}$") & (minute < 60) & (sec < 60)
    value = deg + minute / 60.0 + sec / 3600.0
    return F.when(ok & (value > 0), value)


def feet_inches(c: Column) -> Column:
    """162 reads 13'6"; halves round to even; null reads unknown."""
    n = F.bround(c, 0).cast("bigint")
    return F.coalesce(F.concat((F.floor(n / 12)).cast("string"), F.lit("'"), F.pmod(n, F.lit(12)).cast("string"), F.lit('"')), F.lit("unknown"))


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def percent(c: Column) -> Column:
    """0..1 to 0..100, halves up."""
    return F.floor(c * 100.0 + 0.5).cast("int")
