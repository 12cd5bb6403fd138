"""Oracle format models: dates to pieces of Java patterns, numbers to widths."""

from __future__ import annotations

import re

from ..errors import UnsupportedFeature


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Date format elements and what they are in Java's patterns.
JAVA = {
    "YYYY": "yyyy", "RRRR": "yyyy", "SYYYY": "yyyy", "YYY": "yyy", "YY": "yy", "RR": "yy", "Y": "y",
    "MM": "MM", "MON": "MMM", "MONTH": "MMMM", "DD": "dd", "DDD": "DDD", "DY": "EEE", "DAY": "EEEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "AM": "a", "PM": "a", "A.M.": "a", "P.M.": "a",
    "FF": "SSSSSS", "FF1": "S", "FF2": "SS", "FF3": "SSS", "FF6": "SSSSSS", "FF9": "SSSSSSSSS", "TZH": "XXX", "TZR": "VV", "TZD": "z",
}
ELEMENT = re.compile(r'"[^"]*"|FM|FX|' + "|".join(sorted([*JAVA, "IYYY", "IYY", "IY", "IW", "WW", "SSSSS", "Q", "J", "D", "W", "CC", "TH", "SP"], key=len, reverse=True)) + r"|.", re.IGNORECASE | re.DOTALL)
#: Longest month and day names, to which the full names are padded.
PADDED = {"MONTH": 9, "DAY": 9}


def _cased(sample: str, expression: str) -> str:
    if sample.isupper():
        return f"upper({expression})"
    if sample[0].isupper():
        return expression
    return f"lower({expression})"


def date_to_text(value: str, model: str) -> str:
    """The expression that formats the timestamp ``value`` by ``model``."""
    pieces: list[str] = []
    fill = True
    for m in ELEMENT.finditer(model):
        got, word = m[0], m[0].upper()
        if word == "FM":
            fill = not fill
        elif word == "FX":
            continue
        elif got[0] == '"' and len(got) > 1:
            pieces.append(quote(got[1:-1]))
        elif word in ("MON", "MONTH", "DY", "DAY", "AM", "PM", "A.M.", "P.M."):
            piece = _cased(got, f"date_format({value}, '{JAVA[word]}')")
            pieces.append(f"rpad({piece}, {PADDED[word]}, ' ')" if fill and word in PADDED else piece)
        elif word in ("IYYY", "IYY", "IY"):
            pieces.append(f"right(lpad(extract(YEAROFWEEK FROM {value}), 4, '0'), {len(word)})")
        elif word in JAVA:
            java = f"date_format({value}, '{JAVA[word]}')"
            pieces.append(java if fill or not word[0] in "MDH" else f"cast(cast({java} as int) as string)")
        elif word == "IW":
            pieces.append(f"lpad(weekofyear({value}), 2, '0')")
        elif word == "WW":
            pieces.append(f"lpad(floor((dayofyear({value}) - 1) / 7) + 1, 2, '0')")
        elif word == "W":
            pieces.append(f"cast(floor((day({value}) - 1) / 7) + 1 as string)")
        elif word == "Q":
            pieces.append(f"cast(quarter({value}) as string)")
        elif word == "D":
            pieces.append(f"cast(dayofweek({value}) as string)")
        elif word == "J":
            pieces.append(f"cast(datediff(cast({value} as date), date'1970-01-01') + 2440588 as string)")
        elif word == "SSSSS":
            pieces.append(f"lpad(hour({value}) * 3600 + minute({value}) * 60 + second({value}), 5, '0')")
        elif word in ("CC", "TH", "SP"):
            raise UnsupportedFeature(f"format element {word}")
        else:
            pieces.append(quote(got))
    return f"concat({', '.join(pieces)})" if pieces else "''"


def java_pattern(model: str) -> str:
    """The Java pattern that parses texts of a date format model."""
    out = []
    for m in ELEMENT.finditer(model):
        got, word = m[0], m[0].upper()
        if word in ("FM", "FX"):
            continue
        if got[0] == '"' and len(got) > 1:
            out.append("'" + got[1:-1] + "'")
        elif word in JAVA:
            out.append(JAVA[word])
        elif word.isalpha() and word != "T":
            raise UnsupportedFeature(f"format element {word} when parsing")
        else:
            out.append("'T'" if word == "T" else got)
    return "".join(out)


NUMBER = re.compile(r"^(FM)?([$L]?)(S?)([09,G]*)(?:([.D])([09]*))?(S|MI|PR)?$", re.IGNORECASE)


def number_to_text(value: str, model: str) -> str:
    """The expression that formats the number ``value`` by ``model``: a place for the sign, blanks to the left, # on overflow."""
    m = NUMBER.match(model.strip())
    if not m or (m[7] or "").upper() == "PR" or (m[2] or "").upper() == "L":
        raise UnsupportedFeature(f"number format {model}")
    trim, dollar, sign, whole, point, part, behind = m[1], m[2], m[3], m[4].upper().replace("G", ","), m[5], m[6] or "", (m[7] or "").upper()
    digits = len(whole.replace(",", ""))
    width = len(whole) + (1 + len(part) if point else 0) + len(dollar) + 1
    number = f"cast(round(abs({value}), {len(part)}) as decimal(38, {max(len(part), 1)}))"
    spark = whole + ("." + part if point else "")
    text = f"ltrim(to_char({number}, '{spark}'))" if spark.strip(",") else "''"
    if point and not whole.replace(",", "").count("0"):
        text = f"regexp_replace({text}, '^0+(?=[.])', '')"
    if trim and "9" in part:
        text = f"regexp_replace({text}, '(?<=[.][0-9]{{{len(part.rstrip('9'))}}})([0-9]*?)0+$', '$1')"
    if dollar:
        text = f"concat('$', {text})"
    if behind == "MI":
        text = f"concat({text}, CASE WHEN {value} < 0 THEN '-' ELSE ' ' END)"
    elif behind == "S":
        text = f"concat({text}, CASE WHEN {value} < 0 THEN '-' ELSE '+' END)"
    else:
        text = f"concat(CASE WHEN {value} < 0 THEN '-' ELSE '{'+' if sign else ''}' END, {text})"
    text = f"trim({text})" if trim else f"lpad({text}, {width}, ' ')"
    return f"CASE WHEN round(abs({value}), {len(part)}) >= 1e{digits} THEN repeat('#', {width}) ELSE {text} END"
