"""Functions of the dialect: what each lowers to, and the kind of its value."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from ..errors import SqlSyntaxError, UnsupportedFeature
from . import ast as A
from .formats import date_to_text, java_pattern, number_to_text, quote

if TYPE_CHECKING:
    from .lowering import Lowering

Lower = Callable[["Lowering", A.Call], str]


@dataclass
class Function:
    lower: Lower
    kind: str | None | Callable[["Lowering", list[A.Node]], str | None]


FUNCTIONS: dict[str, Function] = {}
AGGREGATES: set[str] = set()


def first_kind(low: Lowering, args: list[A.Node]) -> str | None:
    return next((k for a in args if (k := low.kind(a))), None)


def define(kind, *names: str):
    def keep(f: Lower) -> Lower:
        for n in names:
            FUNCTIONS[n] = Function(f, kind)
        return f

    return keep


def same(kind, spark: str | None = None, *names: str) -> None:
    """Functions that Spark has with the same meaning and order of arguments."""
    for n in names:
        target = spark or n.lower()
        FUNCTIONS[n] = Function(lambda low, c, target=target: f"{target}({', '.join(low.all(c.args))})", kind)


def text(e: A.Node) -> str:
    """The value of a literal argument that must be known when lowering."""
    if isinstance(e, A.Literal) and e.kind in ("string", "number"):
        return e.value
    raise UnsupportedFeature("a computed value where a literal is needed")


def count_of(e: A.Node | None, default: int) -> int:
    if e is None:
        return default
    if isinstance(e, A.Unary) and e.op == "-":
        return -int(text(e.value))
    return int(text(e))


# conditional

same(first_kind, "coalesce", "NVL", "COALESCE")
same(first_kind, None, "NULLIF")
same(lambda low, a: first_kind(low, a[1:]), None, "NVL2")


@define(lambda low, a: first_kind(low, [*a[2::2], *a[-1:]]), "DECODE")
def _decode(low: Lowering, c: A.Call) -> str:
    value, *rest = low.all(c.args)
    whens = "".join(f" WHEN {value} <=> {s} THEN {r}" for s, r in zip(rest[::2], rest[1::2], strict=False))
    return f"CASE{whens}" + (f" ELSE {rest[-1]}" if len(rest) % 2 else "") + " END"


def _strict(spark: str) -> Lower:
    def lower(low: Lowering, c: A.Call) -> str:
        args = low.all(c.args)
        return f"CASE WHEN {' OR '.join(f'{a} IS NULL' for a in args)} THEN NULL ELSE {spark}({', '.join(args)}) END" if len(args) > 1 else args[0]

    return lower


FUNCTIONS["GREATEST"] = Function(_strict("greatest"), first_kind)
FUNCTIONS["LEAST"] = Function(_strict("least"), first_kind)

# numbers

same("N", None, "ABS", "FLOOR", "POWER", "SQRT", "EXP", "LN", "SIGN", "SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "ATAN2", "SINH", "COSH", "TANH")
same("N", "ceil", "CEIL", "CEILING")
FUNCTIONS["BITAND"] = Function(lambda low, c: f"(cast({low.emit(c.args[0])} as bigint) & cast({low.emit(c.args[1])} as bigint))", "N")
same("N", "nanvl", "NANVL")


@define("N", "LOG")
def _log(low: Lowering, c: A.Call) -> str:
    return f"log({', '.join(low.all(c.args))})"


@define("N", "MOD")
def _mod(low: Lowering, c: A.Call) -> str:
    a, b = low.all(c.args)
    if isinstance(c.args[1], A.Literal) and float(c.args[1].value):
        return f"({a} % {b})"
    return f"CASE WHEN {b} = 0 THEN {a} ELSE {a} % {b} END"


@define("N", "REMAINDER")
def _remainder(low: Lowering, c: A.Call) -> str:
    a, b = low.all(c.args)
    return f"({a} - {b} * rint({a} / {b}))"


@define("N", "WIDTH_BUCKET")
def _bucket(low: Lowering, c: A.Call) -> str:
    return f"width_bucket({', '.join(low.all(c.args))})"


def truncated(value: str, digits: int) -> str:
    """Towards zero, on decimals, so that 1.15 keeps both digits."""
    power = f"1e{digits}BD" if digits >= 0 else f"(1 / 1e{-digits}BD)"
    if digits == 0:
        return f"cast(sign({value}) * floor(abs({value})) as double)"
    return f"cast(sign({value}) * floor(cast(abs({value}) as decimal(30, 10)) * {power}) as double) / cast({power} as double)"


UNITS = {
    "CC": None, "SYYYY": "YEAR", "YYYY": "YEAR", "YEAR": "YEAR", "SYEAR": "YEAR", "YYY": "YEAR", "YY": "YEAR", "Y": "YEAR", "RR": "YEAR", "RRRR": "YEAR",
    "Q": "QUARTER", "MONTH": "MONTH", "MON": "MONTH", "MM": "MONTH", "RM": "MONTH", "DDD": "DAY", "DD": "DAY", "J": "DAY", "IW": "WEEK",
    "HH": "HOUR", "HH12": "HOUR", "HH24": "HOUR", "MI": "MINUTE", "SS": "SECOND",
}


def date_floor(value: str, unit: str) -> str:
    return f"cast(date_trunc('{unit}', {value}) as timestamp_ntz)"


def _unit(model: A.Node | None) -> str:
    word = text(model).upper() if model is not None else "DD"
    if word in ("DAY", "DY", "D"):
        return "SUNDAY"
    if UNITS.get(word) is None:
        raise UnsupportedFeature(f"date unit {word}")
    return UNITS[word]


def _is_model(low: Lowering, args: list[A.Node]) -> bool:
    return len(args) > 1 and isinstance(args[1], A.Literal) and args[1].kind == "string"


def _date_or_number(low: Lowering, args: list[A.Node]) -> str:
    return "D" if low.kind(args[0]) == "D" or _is_model(low, args) else "N"


@define(_date_or_number, "TRUNC")
def _trunc(low: Lowering, c: A.Call) -> str:
    value = low.emit(c.args[0])
    if _date_or_number(low, c.args) == "N":
        return truncated(value, count_of(c.args[1] if len(c.args) > 1 else None, 0))
    unit = _unit(c.args[1] if len(c.args) > 1 else None)
    if unit == "SUNDAY":
        day = date_floor(value, "DAY")
        return f"({day} - (dayofweek({value}) - 1) * INTERVAL '1' DAY)"
    return date_floor(value, unit)


@define(_date_or_number, "ROUND")
def _round(low: Lowering, c: A.Call) -> str:
    value = low.emit(c.args[0])
    if _date_or_number(low, c.args) == "N":
        return f"round({', '.join([value, *low.all(c.args[1:])])})"
    unit = _unit(c.args[1] if len(c.args) > 1 else None)
    up = {
        "DAY": f"hour({value}) >= 12", "MONTH": f"day({value}) >= 16", "YEAR": f"month({value}) >= 7", "HOUR": f"minute({value}) >= 30", "MINUTE": f"second({value}) >= 30",
        "QUARTER": f"(month({value}) % 3 = 0 OR (month({value}) % 3 = 2 AND day({value}) >= 16))", "WEEK": f"(weekday({value}) > 3 OR (weekday({value}) = 3 AND hour({value}) >= 12))",
    }.get(unit)
    if up is None:
        raise UnsupportedFeature(f"ROUND to {unit}")
    step = {"YEAR": "INTERVAL '1' YEAR", "QUARTER": "INTERVAL '3' MONTH", "MONTH": "INTERVAL '1' MONTH", "WEEK": "INTERVAL '7' DAY"}.get(unit, f"INTERVAL '1' {unit}")
    floor = date_floor(value, unit)
    return f"CASE WHEN {up} THEN {floor} + {step} ELSE {floor} END"


# strings

same("T", None, "UPPER", "LOWER", "LPAD", "RPAD", "TRANSLATE", "SOUNDEX", "REVERSE")
same("N", None, "ASCII")
same("N", "char_length", "LENGTH", "LENGTHC")
same("N", "octet_length", "LENGTHB")
same("T", "chr", "CHR")
same("T", "hex", "RAWTOHEX")
same(None, "unhex", "HEXTORAW")


@define("T", "CONCAT")
def _concat(low: Lowering, c: A.Call) -> str:
    return f"concat({', '.join(f"coalesce(cast({a} as string), '')" for a in low.all(c.args))})"


@define("T", "INITCAP")
def _initcap(low: Lowering, c: A.Call) -> str:
    """A word starts behind anything that is neither letter nor digit."""
    value = low.emit(c.args[0])
    return f"array_join(transform(split(lower({value}), '(?<=[^\\\\p{{L}}\\\\p{{N}}])'), w -> concat(upper(left(w, 1)), substr(w, 2))), '')"


@define("T", "SUBSTR", "SUBSTRB", "SUBSTRC")
def _substr(low: Lowering, c: A.Call) -> str:
    args = low.all(c.args)
    return f"substring({', '.join([args[0], *(f'cast({a} as int)' if not isinstance(x, A.Literal) else a for a, x in zip(args[1:], c.args[1:], strict=True))])})"


@define("T", "REPLACE")
def _replace(low: Lowering, c: A.Call) -> str:
    args = low.all(c.args)
    return f"replace({args[0]}, {args[1]}, {args[2] if len(args) > 2 else quote('')})"


def _trimmed(side: str) -> Lower:
    def lower(low: Lowering, c: A.Call) -> str:
        args = low.all(c.args)
        return f"trim({side} {args[1] if len(args) > 1 else quote(' ')} FROM {args[0]})"

    return lower


FUNCTIONS["LTRIM"] = Function(_trimmed("LEADING"), "T")
FUNCTIONS["RTRIM"] = Function(_trimmed("TRAILING"), "T")


def nth_place(value: str, sub: str, start: str, n: str) -> str:
    """The place of the n-th occurrence from ``start`` on, overlaps counted; 0 if there is none."""
    step = f"locate({sub}, {value}, p + 1)"
    return f"aggregate(sequence(1, {n}), {start} - 1, (p, i) -> CASE WHEN p < 0 OR {step} = 0 THEN -1 ELSE {step} END, p -> greatest(p, 0))"


@define("N", "INSTR", "INSTRB")
def _instr(low: Lowering, c: A.Call) -> str:
    args = low.all(c.args)
    if len(args) == 2:
        return f"instr({args[0]}, {args[1]})"
    n = args[3] if len(args) > 3 else "1"
    start = count_of(c.args[2], 1) if isinstance(c.args[2], (A.Literal, A.Unary)) else None
    if start is None or start > 0:
        return f"locate({args[1]}, {args[0]}, {args[2]})" if n == "1" else nth_place(args[0], args[1], args[2], n)
    if start == 0:
        return "0"
    back = nth_place(f"reverse({args[0]})", f"reverse({args[1]})", f"greatest(1, {-start} - length({args[1]}) + 1)", n)
    return f"CASE WHEN {back} = 0 THEN 0 ELSE length({args[0]}) - {back} - length({args[1]}) + 2 END"


# regular expressions

CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "blank": r"\h", "graph": r"\p{Graph}"}


def java_regex(pattern: A.Node, flags: A.Node | None) -> str:
    out = re.sub(r"\[:(\w+):\]", lambda m: CLASSES[m[1]], text(pattern))
    marks = {"i": "i", "n": "s", "m": "m", "x": "x", "c": ""}
    mode = "".join(marks[f] for f in (text(flags) if flags is not None else ""))
    return quote(f"(?{mode})" * bool(mode) + out)


def _from(value: str, start: str) -> str:
    return value if start == "1" else f"substring({value}, {start})"


def _arg(c: A.Call, k: int) -> A.Node | None:
    return c.args[k] if len(c.args) > k else None


def _before(value: str, pattern: str, n: int) -> str:
    """How many characters stand before the n-th match."""
    if n == 1:
        return f"(regexp_instr({value}, {pattern}) - 1)"
    pieces, found = f"slice(split({value}, {pattern}, {n + 1}), 1, {n})", f"slice(regexp_extract_all({value}, {pattern}, 0), 1, {n - 1})"
    return f"(length(array_join({pieces}, '')) + length(array_join({found}, '')))"


@define("T", "REGEXP_REPLACE")
def _regexp_replace(low: Lowering, c: A.Call) -> str:
    value, pattern = low.emit(c.args[0]), java_regex(c.args[1], _arg(c, 5))
    new = quote(re.sub(r"\\(\d)", r"$\1", text(c.args[2]).replace("$", r"\$"))) if len(c.args) > 2 else quote("")
    start, occurrence = low.emit(c.args[3]) if len(c.args) > 3 else "1", count_of(_arg(c, 4), 0)
    if occurrence == 0:
        return f"regexp_replace({value}, {pattern}, {new}{'' if start == '1' else ', ' + start})"
    part = _from(value, start)
    match = f"get(regexp_extract_all({part}, {pattern}, 0), {occurrence - 1})"
    before = _before(part, pattern, occurrence)
    head = "" if start == "1" else f"substring({value}, 1, {start} - 1), "
    return f"CASE WHEN {match} IS NULL THEN {value} ELSE concat({head}substring({part}, 1, {before}), regexp_replace({match}, {pattern}, {new}), substring({part}, {before} + length({match}) + 1)) END"


@define("T", "REGEXP_SUBSTR")
def _regexp_substr(low: Lowering, c: A.Call) -> str:
    part = _from(low.emit(c.args[0]), low.emit(c.args[2]) if len(c.args) > 2 else "1")
    return f"get(regexp_extract_all({part}, {java_regex(c.args[1], _arg(c, 4))}, {count_of(_arg(c, 5), 0)}), {count_of(_arg(c, 3), 1) - 1})"


@define("N", "REGEXP_INSTR")
def _regexp_instr(low: Lowering, c: A.Call) -> str:
    start, n, behind = low.emit(c.args[2]) if len(c.args) > 2 else "1", count_of(_arg(c, 3), 1), count_of(_arg(c, 4), 0)
    part, pattern = _from(low.emit(c.args[0]), start), java_regex(c.args[1], _arg(c, 5))
    match = f"get(regexp_extract_all({part}, {pattern}, 0), {n - 1})"
    end = f" + length({match})" if behind else ""
    return f"CASE WHEN {match} IS NULL THEN 0 ELSE {_before(part, pattern, n)} + {start}{end} END"


@define("N", "REGEXP_COUNT")
def _regexp_count(low: Lowering, c: A.Call) -> str:
    part = _from(low.emit(c.args[0]), low.emit(c.args[2]) if len(c.args) > 2 else "1")
    return f"regexp_count({part}, {java_regex(c.args[1], _arg(c, 3))})"


@define("B", "REGEXP_LIKE")
def _regexp_like(low: Lowering, c: A.Call) -> str:
    return f"regexp_like({low.emit(c.args[0])}, {java_regex(c.args[1], _arg(c, 2))})"


# conversion


@define("T", "TO_CHAR", "TO_NCHAR")
def _to_char(low: Lowering, c: A.Call) -> str:
    value, kind = low.emit(c.args[0]), low.kind(c.args[0])
    if len(c.args) == 1:
        if kind == "N":
            return f"regexp_replace(cast({value} as string), '[.]0+$', '')"
        return date_to_text(value, "DD-MON-RR") if kind == "D" else f"cast({value} as string)"
    model = text(c.args[1])
    if kind == "N" or (kind != "D" and not re.search("[A-CE-FH-RT-Za-z]", model.upper().replace("FM", "").replace("MI", "").replace("D", ""))):
        return number_to_text(value, model)
    return date_to_text(value, model)


@define("D", "TO_DATE")
def _to_date(low: Lowering, c: A.Call) -> str:
    value = low.emit(c.args[0])
    return f"to_timestamp_ntz({value}, {quote(java_pattern(text(c.args[1])))})" if len(c.args) > 1 else f"cast({value} as timestamp_ntz)"


FUNCTIONS["TO_TIMESTAMP"] = FUNCTIONS["TO_DATE"]


@define("D", "TO_TIMESTAMP_TZ")
def _to_timestamp_tz(low: Lowering, c: A.Call) -> str:
    value = low.emit(c.args[0])
    return f"to_timestamp({value}, {quote(java_pattern(text(c.args[1])))})" if len(c.args) > 1 else f"cast({value} as timestamp)"


@define("N", "TO_NUMBER")
def _to_number(low: Lowering, c: A.Call) -> str:
    value = low.emit(c.args[0])
    return f"cast(regexp_replace({value}, '[, $]', '') as double)" if len(c.args) > 1 else f"cast({value} as double)"


same("T", "string", "TO_CLOB", "TO_NCLOB")
same(None, None, "STRUCT", "NAMED_STRUCT", "ARRAY", "MAP")
same("T", "get_json_object", "JSON_VALUE", "JSON_QUERY", "GET_JSON_OBJECT")

# dates


def _with_time(date: str, value: str) -> str:
    return f"(cast({date} as timestamp_ntz) + ({value} - {date_floor(value, 'DAY')}))"


@define("D", "ADD_MONTHS")
def _add_months(low: Lowering, c: A.Call) -> str:
    """The last day of a month stays one."""
    value, n = f"cast({low.emit(c.args[0])} as timestamp_ntz)", f"cast({low.emit(c.args[1])} as int)"
    moved = f"add_months(cast({value} as date), {n})"
    return f"CASE WHEN day({value}) = day(last_day({value})) THEN {_with_time(f'last_day({moved})', value)} ELSE {_with_time(moved, value)} END"


same("N", None, "MONTHS_BETWEEN")


@define("D", "LAST_DAY")
def _last_day(low: Lowering, c: A.Call) -> str:
    value = f"cast({low.emit(c.args[0])} as timestamp_ntz)"
    return _with_time(f"last_day({value})", value)


@define("D", "NEXT_DAY")
def _next_day(low: Lowering, c: A.Call) -> str:
    value = f"cast({low.emit(c.args[0])} as timestamp_ntz)"
    return _with_time(f"next_day({value}, {low.emit(c.args[1])})", value)


@define("D", "SYSDATE")
def _sysdate(low: Lowering, c: A.Call) -> str:
    return low.emit(A.Column(("sysdate",)))


@define("D", "FROM_TZ")
def _from_tz(low: Lowering, c: A.Call) -> str:
    value, zone = low.all(c.args)
    return f"to_utc_timestamp({value}, {zone})"


@define(None, "NUMTODSINTERVAL")
def _day_interval(low: Lowering, c: A.Call) -> str:
    return f"({low.emit(c.args[0])} * INTERVAL '1' {text(c.args[1]).upper()})"


FUNCTIONS["NUMTOYMINTERVAL"] = FUNCTIONS["NUMTODSINTERVAL"]
same("T", "current_timezone", "SESSIONTIMEZONE")

# collections


@define("N", ".COUNT", "CARDINALITY")
def _count(low: Lowering, c: A.Call) -> str:
    return f"size({low.emit(c.args[0])})"


@define("N", ".FIRST")
def _first(low: Lowering, c: A.Call) -> str:
    return f"CASE WHEN size({low.emit(c.args[0])}) > 0 THEN 1 END"


@define("N", ".LAST")
def _last(low: Lowering, c: A.Call) -> str:
    return f"nullif(size({low.emit(c.args[0])}), 0)"


@define("B", ".EXISTS")
def _exists(low: Lowering, c: A.Call) -> str:
    value, at = low.all(c.args)
    return f"(coalesce({at} BETWEEN 1 AND size({value}), false))"


@define(None, ".DELETE")
def _delete(low: Lowering, c: A.Call) -> str:
    value, at = low.all(c.args)
    return f"filter({value}, (x, i) -> i + 1 <> {at})"


@define(None, "ELEMENT")
def _element(low: Lowering, c: A.Call) -> str:
    value, at = low.all(c.args)
    return f"try_element_at({value}, {at})"


@define(None, ".FIELD")
def _field(low: Lowering, c: A.Call) -> str:
    return f"{low.emit(c.args[0])}.`{text(c.args[1])}`"


# aggregates and windows


def _over(low: Lowering, c: A.Call, call: str) -> str:
    return call + (f" OVER {low.emit(c.over)}" if c.over else "")


def aggregate(spark: str, kind, *names: str) -> None:
    def lower(low: Lowering, c: A.Call) -> str:
        if c.keep:
            return kept(low, c)
        return _over(low, c, f"{spark}({'DISTINCT ' * c.distinct}{', '.join(low.all(c.args))})")

    for n in names:
        FUNCTIONS[n] = Function(lower, kind)
        AGGREGATES.add(n)


def kept(low: Lowering, c: A.Call) -> str:
    """The least or greatest value among the rows that come first or last."""
    which, orders = c.keep
    if len(orders) != 1 or c.name not in ("MIN", "MAX"):
        raise UnsupportedFeature(f"KEEP with {c.name}")
    value, by = low.emit(c.args[0]), low.emit(orders[0].value)
    edge = "max" if (which == "LAST") != orders[0].descending else "min"
    inner = value if edge.upper() == c.name else f"-({value})"  # the other end of the ties, by sign
    if inner != value and low.kind(c.args[0]) != "N":
        raise UnsupportedFeature(f"{c.name} KEEP {which} of anything but numbers")
    got = _over(low, c, f"{edge}(struct({by} AS o, {inner} AS v))") + ".v"
    return got if inner == value else f"(-({got}))"


aggregate("count", "N", "COUNT")
aggregate("sum", "N", "SUM")
aggregate("avg", "N", "AVG")
aggregate("min", first_kind, "MIN")
aggregate("max", first_kind, "MAX")
aggregate("median", "N", "MEDIAN")
aggregate("var_pop", "N", "VAR_POP")
aggregate("var_samp", "N", "VAR_SAMP")
aggregate("stddev_pop", "N", "STDDEV_POP")
aggregate("stddev_samp", "N", "STDDEV_SAMP")
aggregate("approx_count_distinct", "N", "APPROX_COUNT_DISTINCT")
aggregate("collect_list", None, "COLLECT")
aggregate("any_value", first_kind, "ANY_VALUE")
aggregate("mode", first_kind, "STATS_MODE")
aggregate("kurtosis", "N", "KURTOSIS_POP")
for _n in ("COVAR_POP", "COVAR_SAMP", "CORR", "REGR_SLOPE", "REGR_INTERCEPT", "REGR_COUNT", "REGR_R2", "REGR_AVGX", "REGR_AVGY", "REGR_SXX", "REGR_SYY", "REGR_SXY"):
    aggregate(_n.lower(), "N", _n)


def _single_is_zero(spark: str) -> Lower:
    """Of one value, Oracle's is zero."""

    def lower(low: Lowering, c: A.Call) -> str:
        arg = ("DISTINCT " * c.distinct) + low.emit(c.args[0])
        return f"CASE WHEN {_over(low, c, f'count({arg})')} = 1 THEN 0D ELSE {_over(low, c, f'{spark}({arg})')} END"

    return lower


FUNCTIONS["STDDEV"] = Function(_single_is_zero("stddev_samp"), "N")
FUNCTIONS["VARIANCE"] = Function(_single_is_zero("var_samp"), "N")
AGGREGATES |= {"STDDEV", "VARIANCE", "LISTAGG", "WM_CONCAT", "PERCENTILE_CONT", "PERCENTILE_DISC", "GROUPING", "GROUPING_ID", "RATIO_TO_REPORT"}


@define("T", "LISTAGG", "WM_CONCAT")
def _listagg(low: Lowering, c: A.Call) -> str:
    separator = low.emit(c.args[1]) if len(c.args) > 1 else quote("," if c.name == "WM_CONCAT" else "")
    within = f" WITHIN GROUP (ORDER BY {low.ordering(c.within)})" if c.within else ""
    return _over(low, c, f"listagg({'DISTINCT ' * c.distinct}cast({low.emit(c.args[0])} as string), {separator}){within}")


@define("N", "PERCENTILE_CONT", "PERCENTILE_DISC")
def _percentile(low: Lowering, c: A.Call) -> str:
    o = c.within[0]
    return _over(low, c, f"{c.name.lower()}({low.emit(c.args[0])}) WITHIN GROUP (ORDER BY {low.emit(o.value)}{' DESC' * o.descending})")


def _ranking(low: Lowering, c: A.Call) -> str:
    if c.within is None:
        if c.over is None:
            raise SqlSyntaxError(f"{c.name} needs OVER or WITHIN GROUP")
        return _over(low, c, f"{c.name.lower()}()")
    # hypothetical: where the given value would rank in the group
    if len(c.within) != 1:
        raise UnsupportedFeature(f"{c.name} WITHIN GROUP of several keys")
    o = c.within[0]
    key, value = low.emit(o.value), low.emit(c.args[0])
    before = f"{key} {'>' if o.descending else '<'} {value}"
    nulls_before = (o.nulls or ("FIRST" if o.descending else "LAST")) == "FIRST"
    if nulls_before:
        before = f"({before} OR {key} IS NULL)"
    if c.name == "RANK":
        return f"(count_if({before}) + 1)"
    if c.name == "DENSE_RANK":
        return f"(count(DISTINCT CASE WHEN {before} THEN {key} END){' + max(CASE WHEN ' + key + ' IS NULL THEN 1 ELSE 0 END)' if nulls_before else ''} + 1)"
    if c.name == "PERCENT_RANK":
        return f"(count_if({before}) / count(*))"
    return f"((count_if({before} OR {key} = {value}) + 1) / (count(*) + 1))"


for _n in ("RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST"):
    FUNCTIONS[_n] = Function(_ranking, "N")


@define("N", "RATIO_TO_REPORT")
def _ratio(low: Lowering, c: A.Call) -> str:
    value = low.emit(c.args[0])
    return f"({value} / {_over(low, c, f'sum({value})')})"


@define("N", "ROW_NUMBER", "NTILE")
def _numbering(low: Lowering, c: A.Call) -> str:
    if c.over is None:
        raise SqlSyntaxError(f"{c.name} needs OVER")
    return _over(low, c, f"{c.name.lower()}({', '.join(low.all(c.args))})")


@define(first_kind, "LEAD", "LAG", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE")
def _neighbour(low: Lowering, c: A.Call) -> str:
    nulls = f" {c.nulls} NULLS" if c.nulls else ""
    return _over(low, c, f"{c.name.lower()}({', '.join(low.all(c.args))}){nulls}")


same("N", None, "GROUPING", "GROUPING_ID")
