"""Logical types, their Spark types, and lenient coercion as Column expressions.

Coercion never fails: what can't be read as the type is null. Integers are cut toward zero and
held in range; unsigned types live in the next wider signed Spark type and are held in their range.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidArgumentError

INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class DataType:
    """A logical type: its name, the Spark type that stores it, and what coercion needs."""

    name: str
    spark: Any
    low: int | None = None
    high: int | None = None
    unit: str | None = None
    zone: str | None = None
    inner: Any = None
    fields: tuple = field(default=())

    def is_integer(self) -> bool:
        return self.low is not None

    def is_float(self) -> bool:
        return self.name in ("Float32", "Float64", "Decimal")

    def is_numeric(self) -> bool:
        return self.is_integer() or self.is_float()

    def is_signed(self) -> bool:
        return self.is_float() or self.is_integer() and self.low < 0

    def is_unsigned(self) -> bool:
        return self.is_integer() and self.low == 0

    def is_temporal(self) -> bool:
        return self.name in ("Date", "Datetime", "Time", "Duration")

    def is_nested(self) -> bool:
        return self.name in ("Array", "Struct")

    def matches(self, other: Any) -> bool:
        """Whether a column of Spark type `other` is of this type, in a selector's sense."""
        if self.name == "Array":
            return isinstance(other, T.ArrayType)
        if self.name == "Struct":
            return isinstance(other, T.StructType)
        if self.name == "Datetime":
            return isinstance(other, (T.TimestampType, T.TimestampNTZType))
        if self.name == "Decimal":
            return isinstance(other, T.DecimalType)
        return type(self.spark) is type(other)


def _int(name: str, spark: T.DataType, bits: int, signed: bool = True) -> DataType:
    return DataType(name, spark, -(1 << bits - 1) if signed else 0, (1 << bits - 1) - 1 if signed else (1 << bits) - 1)


Int8, Int16, Int32, Int64 = (_int(f"Int{b}", t, b) for b, t in ((8, T.ByteType()), (16, T.ShortType()), (32, T.IntegerType()), (64, T.LongType())))
UInt8, UInt16, UInt32, UInt64 = (_int(f"UInt{b}", t, b, False) for b, t in ((8, T.ShortType()), (16, T.IntegerType()), (32, T.LongType()), (64, T.DecimalType(20, 0))))
Float32, Float64 = DataType("Float32", T.FloatType()), DataType("Float64", T.DoubleType())
Boolean, Utf8, Binary = DataType("Boolean", T.BooleanType()), DataType("Utf8", T.StringType()), DataType("Binary", T.BinaryType())
Null, Object = DataType("Null", T.NullType()), DataType("Object", T.StringType())
Date, Time = DataType("Date", T.DateType()), DataType("Time", T.StringType())


def Decimal(precision: int | None = None, scale: int = 0) -> DataType:
    """A decimal held to precision and scale; without a precision a double."""
    if precision is None:
        return DataType("Decimal", T.DoubleType())
    if not 1 <= precision <= 38 or not 0 <= scale <= precision:
        raise InvalidArgumentError(f"no decimal has precision {precision} and scale {scale}")
    return DataType("Decimal", T.DecimalType(precision, scale))


def Datetime(unit: str = "ms", zone: str | None = None) -> DataType:
    return DataType("Datetime", T.TimestampNTZType(), unit=unit, zone=zone)


def Duration(unit: str = "ms") -> DataType:
    return DataType("Duration", T.DoubleType(), unit=unit)


def Array(inner: DataType = Utf8) -> DataType:
    return DataType("Array", T.ArrayType(as_type(inner).spark), inner=as_type(inner))


def Struct(fields: dict[str, DataType]) -> DataType:
    named = tuple((k, as_type(v)) for k, v in fields.items())
    return DataType("Struct", T.StructType([T.StructField(k, v.spark) for k, v in named]), fields=named)


List = Array
REGISTRY = {t.name: t for t in (Int8, Int16, Int32, Int64, UInt8, UInt16, UInt32, UInt64, Float32, Float64, Boolean, Utf8, Binary, Null, Object, Date, Time)}
REGISTRY |= {"Datetime": Datetime(), "Duration": Duration(), "Decimal": Decimal()}


def as_type(t: Any) -> DataType:
    """A logical type from itself, its name, a factory, or a Spark type."""
    if isinstance(t, DataType):
        return t
    if isinstance(t, str) and t in REGISTRY:
        return REGISTRY[t]
    if t in (Datetime, Duration, Decimal, Array):
        return t()
    for python, known in ((int, Int64), (float, Float64), (bool, Boolean), (str, Utf8), (bytes, Binary)):
        if t is python:
            return known
    if isinstance(t, T.DataType):
        return of_spark(t)
    raise InvalidArgumentError(f"{t!r} is no data type")


def of_spark(t: T.DataType) -> DataType:
    """The logical type that a Spark type stands for."""
    if isinstance(t, T.ArrayType):
        return Array(of_spark(t.elementType))
    if isinstance(t, T.StructType):
        return Struct({f.name: of_spark(f.dataType) for f in t.fields})
    if isinstance(t, T.DecimalType):
        return UInt64 if (t.precision, t.scale) == (20, 0) else Decimal(t.precision, t.scale)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Datetime("us", "UTC" if isinstance(t, T.TimestampType) else None)
    if isinstance(t, T.DayTimeIntervalType):
        return Duration()
    for known in (Int8, Int16, Int32, Int64, Float32, Float64, Boolean, Utf8, Binary, Null, Date):
        if type(known.spark) is type(t):
            return known
    return Object


def is_float(t: T.DataType) -> bool:
    return isinstance(t, FLOAT_TYPES)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (*INT_TYPES, *FLOAT_TYPES, T.DecimalType))


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def nan_null(c: Column, t: T.DataType) -> Column:
    """c with NaN as null, where it can hold NaN."""
    return F.when(~F.isnan(c), c) if is_float(t) else c


def millis(c: Column, t: T.DataType) -> Column:
    """Epoch milliseconds of a date or timestamp, as long."""
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000
    return F.floor(micros(c, t) / 1000).cast("long") if not isinstance(t, T.TimestampType) else F.unix_millis(c)


def micros(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000_000
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c.cast("long")).cast("timestamp_ntz")


#: A number once signs, brackets, spaces and group marks are dealt with.
PLAIN_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c: Column) -> Column:
    """A double from text as people write numbers, else null.

    Accepts spaces and underscores between digits, (1.5) and 1.5- as negative, groups of three
    marked by comma or point, a comma as decimal mark where it is no group mark, exponents, and NaN or Infinity.
    """
    s = F.btrim(c, F.lit(" \t\n\r\f\x0b\xa0"))
    s = F.when(s.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(s, r"^\(\s*|\s*\)$", ""))).otherwise(s)
    s = F.regexp_replace(s, r"^(.+?)\s*([+-])$", "$2$1")
    s = F.regexp_replace(s, r"[\s_]+", "")
    groups_comma = s.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?([eE][+-]?[0-9]+)?$")
    groups_point = s.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]*([eE][+-]?[0-9]+)?$") | s.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3}){2,}$")
    mark_comma = s.rlike(r"^[+-]?[0-9]*,[0-9]+([eE][+-]?[0-9]+)?$") & ~s.rlike(r",[0-9]{3}$") | s.rlike(r"^[+-]?[0-9]+,$")
    plain = F.when(groups_comma, F.replace(s, F.lit(","), F.lit(""))).when(groups_point, F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".")).when(mark_comma, F.translate(s, ",", ".")).when(s.rlike(PLAIN_NUMBER), s)
    low = F.lower(s)
    special = F.when(low.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(low.rlike(r"^\+?infinity$"), F.lit(float("inf"))).when(low == "-infinity", F.lit(float("-inf")))
    return F.coalesce(plain.try_cast("double"), special)


def number(c: Column, t: T.DataType) -> Column:
    """A number from any type: text leniently, booleans as 0 and 1, dates as epoch milliseconds."""
    if is_number(t):
        return c
    if isinstance(t, T.BooleanType):
        return c.cast("int")
    if isinstance(t, T.StringType):
        return parse_number(c)
    if is_time(t):
        return millis(c, t)
    return F.lit(None).cast("double")


#: Formats that text is tried in, in order, when no format is given.
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm[:ss]", "yyyy/MM/dd[ HH:mm:ss]", "MM/dd/yyyy[ HH:mm:ss]", "yyyy-MM-dd", "EEE, dd MMM yyyy HH:mm:ss")


def parse_timestamp(c: Column, t: T.DataType) -> Column:
    """A timestamp (UTC, without zone) from text, a date, or a number whose size tells its unit (s, ms, us, ns)."""
    if is_time(t):
        return c.cast("timestamp_ntz") if not isinstance(t, T.TimestampType) else F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")
    if is_number(t):
        n, size = c.cast("double"), F.abs(c.cast("double"))
        us = F.when(size < 1e11, n * 1e6).when(size < 1e14, n * 1e3).when(size < 1e17, n).otherwise(n / 1e3)
        return from_micros(us)
    if isinstance(t, T.StringType):
        zoned = F.when(c.rlike(r"[0-9][zZ]$|[+-][0-9]{2}:?[0-9]{2}$"), F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"))
        plain = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in TIMESTAMP_FORMATS[3:5]]
        return F.coalesce(zoned, c.try_cast("timestamp_ntz"), *plain)
    return F.lit(None).cast("timestamp_ntz")


def lenient(c: Column, source: T.DataType, to: DataType) -> Column:
    """c as the logical type `to`; null where it can't be."""
    name = to.name
    if isinstance(source, T.NullType):
        return c.cast(to.spark)
    if to.is_integer():
        n = number(c, source)
        if to.name in ("Int64", "UInt64"):
            if isinstance(source, INT_TYPES):
                return F.when(F.lit(True) if to.low < 0 else c >= 0, c.cast(to.spark))
            exact = F.btrim(c).try_cast("decimal(38,0)") if isinstance(source, T.StringType) else None
            d = n.cast("double")
            whole = F.when(F.abs(d) < float(1 << 63), F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))).cast("decimal(38,0)")
            value = F.coalesce(F.when(F.btrim(c).rlike(r"^[+-]?[0-9]+$"), exact), whole) if exact is not None else whole
            ok = (value >= F.lit(to.low).cast("decimal(38,0)")) & (value <= F.lit(to.high).cast("decimal(38,0)"))
            return F.when(ok, value.try_cast(to.spark))
        d = n.cast("double")
        cut = F.when(d < 0, F.greatest(F.lit(float(to.low)), F.ceil(d).cast("double"))).otherwise(F.least(F.lit(float(to.high)), F.floor(d).cast("double")))
        cut = F.when(d >= to.high, F.lit(float(to.high))).when(d <= to.low, F.lit(float(to.low))).otherwise(cut)
        return F.when(d.isNotNull() & ~F.isnan(d), cut).cast(to.spark)
    if name in ("Float32", "Float64", "Duration") or name == "Decimal" and isinstance(to.spark, T.DoubleType):
        return number(c, source).cast(to.spark)
    if name == "Decimal":
        p, s = to.spark.precision, to.spark.scale
        most = F.lit(("9" * (p - s) or "0") + ("." + "9" * s if s else "")).cast(to.spark)
        d = number(c, source)
        rounded = F.round(d.try_cast(T.DecimalType(38, min(s + 6, 18))), s)
        return F.when(rounded.isNull(), F.when(d.cast("double") > 0, most).when(d.cast("double") < 0, -most)).when(rounded > most, most).when(rounded < -most, -most).otherwise(rounded).try_cast(to.spark)
    if name == "Boolean":
        if isinstance(source, T.BooleanType):
            return c
        return (c != 0) if is_number(source) else c.try_cast("boolean") if isinstance(source, T.StringType) else c.isNotNull()
    if name in ("Utf8", "Object"):
        if isinstance(source, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c)
        if is_float(source):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
        return c.cast("string")
    if name == "Binary":
        return c if isinstance(source, T.BinaryType) else F.encode(c.cast("string"), "UTF-8")
    if name == "Date":
        return c if isinstance(source, T.DateType) else parse_timestamp(c, source).cast("date")
    if name == "Datetime":
        return parse_timestamp(c, source)
    if name == "Time":
        clock = F.when(c.rlike(r"^[0-9]{1,2}:[0-9]{2}"), F.concat(F.lit("1970-01-01 "), c)) if isinstance(source, T.StringType) else None
        ts = parse_timestamp(c, source) if clock is None else F.coalesce(clock.try_cast("timestamp_ntz"), parse_timestamp(c, source))
        return F.date_format(ts, "HH:mm:ss.SSS")
    if name == "Array":
        if isinstance(source, T.ArrayType):
            return F.transform(c, lambda e: lenient(e, source.elementType, to.inner))
        return F.when(c.isNotNull(), F.array(lenient(c, source, to.inner)))
    if name == "Struct":
        have = {f.name: f.dataType for f in source.fields} if isinstance(source, T.StructType) else {}
        parts = [(lenient(c.getField(k), have[k], v) if k in have else F.lit(None).cast(v.spark)).alias(k) for k, v in to.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    return c.cast(to.spark)
