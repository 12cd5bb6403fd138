"""Column functions with Oracle's semantics, composed of built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "add_months", "concat_null_safe", "date_diff_days", "decode", "desc_nulls_default", "greatest_strict", "initcap", "instr", "last_day", "least_strict",
    "lob_from_hex", "lob_to_hex", "months_between", "nvl", "nvl2", "plus_days", "ratio_to_report", "round_date", "strip_nul", "substr", "to_anydata", "trunc_date", "trunc_number",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat_null_safe(*cols: Column | str) -> Column:
    """``||``: null counts as the empty string."""
    return F.concat(*[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols])


def nvl(a: Column | str, b: Column) -> Column:
    return F.coalesce(_col(a), b)


def nvl2(a: Column | str, b: Column, c: Column) -> Column:
    return F.when(_col(a).isNotNull(), b).otherwise(c)


def decode(value: Column | str, *pairs: Column) -> Column:
    """search, result, ... and perhaps a default; null matches null."""
    v, out = _col(value), None
    for s, r in zip(pairs[::2], pairs[1::2], strict=False):
        out = F.when(v.eqNullSafe(s), r) if out is None else out.when(v.eqNullSafe(s), r)
    assert out is not None
    return out.otherwise(pairs[-1]) if len(pairs) % 2 else out


def _strict(fn, cols) -> Column:
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | _col(c).isNull()
    return F.when(~any_null, fn(*[_col(c) for c in cols]))


def greatest_strict(*cols: Column | str) -> Column:
    """Null if any argument is."""
    return _strict(F.greatest, cols)


def least_strict(*cols: Column | str) -> Column:
    return _strict(F.least, cols)


def substr(s: Column | str, start: int, length: int | None = None) -> Column:
    """From the end where ``start`` is negative; 0 counts as 1."""
    return F.substring(_col(s), start, length if length is not None else 2**31 - 1)


def instr(s: Column | str, sub: str, start: int = 1, occurrence: int = 1) -> Column:
    """The place of an occurrence, overlaps counted; searched backwards where ``start`` is negative; 0 if there is none."""
    s = _col(s)
    text, needle, begin = (s, sub, F.lit(start)) if start > 0 else (F.reverse(s), sub[::-1], F.lit(max(1, -start - len(sub) + 1)))
    if start == 0:
        return F.lit(0)

    at = begin - 1
    for _ in range(occurrence):
        found = F.call_function("locate", F.lit(needle), text, at + 1)
        at = F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(found)
    place = F.greatest(at, F.lit(0))
    return place if start > 0 else F.when(place == 0, F.lit(0)).otherwise(F.length(s) - place - len(sub) + 2)


def initcap(s: Column | str) -> Column:
    """A word starts behind anything that is neither letter nor digit."""
    words = F.split(F.lower(_col(s)), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 2**31 - 1))), "")


def trunc_number(x: Column | str, digits: int = 0) -> Column:
    x = _col(x)
    scaled = F.abs(x).cast("decimal(30,10)") * F.lit(10**digits if digits >= 0 else 1).cast("decimal(20,0)")
    if digits < 0:
        scaled = scaled / F.lit(10**-digits)
    return F.signum(x) * F.floor(scaled).cast("double") / F.lit(10.0**digits)


def trunc_date(d: Column | str, unit: str = "DAY") -> Column:
    return F.date_trunc(unit, _col(d)).cast("timestamp_ntz")


def round_date(d: Column | str, unit: str = "DAY") -> Column:
    """Half a day, the 16th, July, the 16th of a quarter's second month, half an hour or minute round up."""
    c = _col(d)
    up = {
        "DAY": F.hour(c) >= 12, "MONTH": F.day(c) >= 16, "YEAR": F.month(c) >= 7, "HOUR": F.minute(c) >= 30, "MINUTE": F.second(c) >= 30,
        "QUARTER": (F.month(c) % 3 == 0) | ((F.month(c) % 3 == 2) & (F.day(c) >= 16)),
    }[unit]
    step = F.expr({"YEAR": "INTERVAL 1 YEAR", "QUARTER": "INTERVAL 3 MONTH", "MONTH": "INTERVAL 1 MONTH"}.get(unit, f"INTERVAL 1 {unit}"))
    return F.when(up, trunc_date(c, unit) + step).otherwise(trunc_date(c, unit))


def _with_time(date: Column, value: Column) -> Column:
    return date.cast("timestamp_ntz") + (value - trunc_date(value))


def add_months(d: Column | str, n: Column | int) -> Column:
    """The last day of a month stays one; the time of day stays."""
    c = _col(d).cast("timestamp_ntz")
    moved = F.add_months(c.cast("date"), n)
    return F.when(F.day(c) == F.day(F.last_day(c)), _with_time(F.last_day(moved), c)).otherwise(_with_time(moved, c))


def last_day(d: Column | str) -> Column:
    c = _col(d).cast("timestamp_ntz")
    return _with_time(F.last_day(c), c)


def months_between(a: Column | str, b: Column | str, whole: bool = False) -> Column:
    """Fractional, in 31sts; ``whole`` cuts towards zero."""
    m = F.months_between(_col(a), _col(b))
    return F.signum(m) * F.floor(F.abs(m)) if whole else m


def date_diff_days(a: Column | str, b: Column | str) -> Column:
    """``a - b`` in days and fractions of them."""
    micros = lambda c: F.unix_micros(_col(c).cast("timestamp"))
    return (micros(a) - micros(b)) / F.lit(86_400_000_000.0)


def plus_days(d: Column | str, n: Column | float) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return _col(d).cast("timestamp_ntz") + n * F.expr("INTERVAL '1' DAY")


def ratio_to_report(x: Column | str, window: WindowSpec) -> Column:
    return _col(x) / F.sum(_col(x)).over(window)


def desc_nulls_default(c: Column | str) -> Column:
    """DESC with nulls first, the default where nulls are the largest."""
    return _col(c).desc_nulls_first()


# values in transfer


def strip_nul(c: Column | str) -> Column:
    """Text without NUL characters."""
    return F.translate(_col(c), "\u0000", "")


def lob_to_hex(c: Column | str, most: int = 20 << 20) -> Column:
    """A LOB as upper-case hex; null beyond ``most`` bytes."""
    value = _col(c).cast("binary")
    return F.when(F.octet_length(value) <= most, F.hex(value))


def lob_from_hex(c: Column | str) -> Column:
    return F.unhex(_col(c))


def to_anydata(c: Column | str, oracle_type: str) -> Column:
    """{"oracleType", "value"} as JSON text; null stays null."""
    value = _col(c)
    return F.when(value.isNotNull(), F.to_json(F.struct(F.lit(oracle_type).alias("oracleType"), value.cast("string").alias("value"))))


def typed_json(c: Column | str, oracle_type: str) -> Column:
    """{"oracleType", "value"} as JSON text, the value being the whole object (a message, a geometry); null stays null."""
    value = _col(c)
    return F.when(value.isNotNull(), F.to_json(F.struct(F.lit(oracle_type).alias("oracleType"), value.alias("value"))))


def _field_text(c: Column, kind: T.DataType) -> Column:
    """One field of a row literal: null is nothing; text, dates and nested rows are quoted where they hold what has a meaning."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"'))
    if isinstance(kind, T.StructType):
        return F.coalesce(quoted(row_literal(c, kind)), F.lit(""))
    text = c.cast("string")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(quoted(text), F.lit(""))
    if isinstance(kind, T.StringType):
        text = strip_nul(text)
        return F.coalesce(F.when((text == "") | text.rlike(r'[ ,"\\()\n\r\t]'), quoted(text)).otherwise(text), F.lit(""))
    return F.coalesce(text, F.lit(""))


def row_literal(c: Column | str, kind: T.StructType) -> Column:
    """An object as the literal of a composite value, ``(a,"b c",)``; null stays null."""
    value = _col(c)
    fields = [_field_text(value[f.name], f.dataType) for f in kind]
    return F.when(value.isNotNull(), F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")")))
