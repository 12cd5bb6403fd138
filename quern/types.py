"""Oracle types as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import UnsupportedFeature

#: Oracle type names that map to one Spark type whatever their precision.
PLAIN: dict[str, T.DataType] = {
    "VARCHAR2": T.StringType(), "NVARCHAR2": T.StringType(), "CHAR": T.StringType(), "NCHAR": T.StringType(), "VARCHAR": T.StringType(),
    "CHARACTER": T.StringType(), "LONG": T.StringType(), "STRING": T.StringType(), "CLOB": T.StringType(), "NCLOB": T.StringType(), "BFILE": T.StringType(),
    "RAW": T.BinaryType(), "LONG RAW": T.BinaryType(), "BLOB": T.BinaryType(),
    "DATE": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP WITH TIME ZONE": T.TimestampType(), "TIMESTAMP WITH LOCAL TIME ZONE": T.TimestampType(),
    "PLS_INTEGER": T.IntegerType(), "BINARY_INTEGER": T.IntegerType(), "NATURAL": T.IntegerType(), "NATURALN": T.IntegerType(), "POSITIVE": T.IntegerType(),
    "POSITIVEN": T.IntegerType(), "SIMPLE_INTEGER": T.IntegerType(), "INTEGER": T.LongType(), "INT": T.LongType(), "SMALLINT": T.ShortType(), "SIGNTYPE": T.ShortType(),
    "FLOAT": T.DoubleType(), "REAL": T.FloatType(), "BINARY_FLOAT": T.FloatType(), "DOUBLE PRECISION": T.DoubleType(), "BINARY_DOUBLE": T.DoubleType(), "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "ROWID": T.StringType(), "UROWID": T.StringType(), "MLSLABEL": T.StringType(),
    "XMLTYPE": T.StringType(), "JSON": T.StringType(), "ANYDATA": T.StringType(), "ANYTYPE": T.StringType(), "SDO_GEOMETRY": T.StringType(),
    "HTTPURITYPE": T.StringType(), "DBURITYPE": T.StringType(), "XDBURITYPE": T.StringType(), "URITYPE": T.StringType(),
    "AQ$_JMS_TEXT_MESSAGE": T.StringType(), "AQ$_SIG_PROP": T.StringType(), "AQ$_RECIPIENTS": T.StringType(),
}
DECIMALS = {"NUMBER", "NUMERIC", "DECIMAL", "DEC"}
NAME = re.compile(r"^\s*([A-Z_$][A-Z0-9_$ ]*?)\s*(?:\(\s*(\*|\d+)\s*(?:BYTE|CHAR)?\s*(?:,\s*(-?\d+)\s*)?\))?\s*((?:WITH|TO)\b.*|UNSIGNED)?$")


def spark_type(oracle: str, objects: dict[str, T.DataType] | None = None) -> T.DataType:
    """The Spark type of an Oracle type; ``objects`` has user-defined ones by lower-case name."""
    text = re.sub(r"\s+", " ", oracle.upper().strip())
    if objects and oracle.strip().lower() in objects:
        return objects[oracle.strip().lower()]
    if text.startswith("INTERVAL YEAR"):
        return T.YearMonthIntervalType()
    if text.startswith("INTERVAL DAY"):
        return T.DayTimeIntervalType()
    if text.startswith("TIMESTAMP"):
        return PLAIN["TIMESTAMP WITH TIME ZONE"] if "TIME ZONE" in text else PLAIN["TIMESTAMP"]
    m = NAME.match(text)
    name = m[1] if m else text
    if name in DECIMALS:
        if not m or m[2] in (None, "*"):
            return T.DecimalType(38, 0) if m and m[3] == "0" else T.DecimalType(38, 10)
        precision, scale = int(m[2]), int(m[3] or 0)
        if scale < 0:
            return T.DecimalType(min(38, precision - scale), 0)
        return T.DecimalType(min(38, max(precision, scale)), scale)
    if name in PLAIN:
        return PLAIN[name]
    raise UnsupportedFeature(f"type {oracle}")


def kind(data_type: T.DataType) -> str | None:
    """D, N, T or B: date, number, text, boolean; None for others."""
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "D"
    if isinstance(data_type, T.NumericType):
        return "N"
    if isinstance(data_type, T.StringType):
        return "T"
    if isinstance(data_type, T.BooleanType):
        return "B"
    return None
