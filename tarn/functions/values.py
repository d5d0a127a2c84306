"""Partition values and statistics as the log spells them, and schemas."""

from __future__ import annotations

import base64
import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = dt.datetime(1970, 1, 1)


def partition_text(c: Column, t: T.DataType) -> Column:
    """A partition value as text; null and the empty string are null."""
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(t, T.BinaryType):
        c = F.decode(c, "UTF-8")
    return F.nullif(c.cast("string"), F.lit(""))


def from_partition(text: str | None, t: T.DataType):
    """The Python value of a partition value's text."""
    if text is None or text == "":
        return None
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(text)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float(text)
    if isinstance(t, T.BooleanType):
        return text.lower() == "true"
    if isinstance(t, T.DecimalType):
        return Decimal(text)
    if isinstance(t, T.DateType):
        return dt.date.fromisoformat(text)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        if isinstance(t, T.TimestampType) and out.tzinfo is None:
            out = out.replace(tzinfo=dt.UTC)
        return out
    return text.encode() if isinstance(t, T.BinaryType) else text


def comparable(v, t: T.DataType):
    """A value of statistics, partitions or literals as something that compares as SQL does; None if it can't."""
    if v is None:
        return None
    if isinstance(t, T.DateType):
        if isinstance(v, int):
            return v
        return (v if isinstance(v, dt.date) else dt.date.fromisoformat(str(v)[:10])).toordinal() - EPOCH.toordinal()
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        if isinstance(v, int):
            return v
        d = v if isinstance(v, dt.datetime) else dt.datetime.fromisoformat(str(v).replace("Z", "+00:00"))
        d = d.astimezone(dt.UTC).replace(tzinfo=None) if d.tzinfo else d
        return (d - EPOCH) // dt.timedelta(microseconds=1)
    if isinstance(t, T.DecimalType):
        return Decimal(str(v))
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(v)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float(v)
    if isinstance(t, T.BooleanType):
        return v if isinstance(v, bool) else str(v).lower() == "true"
    return str(v) if isinstance(t, T.StringType) else None


def stat_value(v, t: T.DataType):
    """A footer's minimum or maximum as JSON; None for types that have none."""
    if v is None or isinstance(t, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        return None
    if isinstance(v, (bytes, bytearray)):
        try:
            return v.decode()
        except UnicodeDecodeError:
            return base64.b64encode(v).decode()
    if isinstance(t, T.TimestampType) and isinstance(v, dt.datetime):
        v = v.astimezone(dt.UTC).replace(tzinfo=None) if v.tzinfo else v
        return v.isoformat(timespec="microseconds") + "Z"
    if isinstance(v, dt.datetime):
        return v.isoformat(timespec="microseconds")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, Decimal):
        return float(v) if abs(v) < 10**15 else None
    if isinstance(v, float) and v != v:
        return None
    return v


class SchemaError(Exception):
    """Schemas don't go together."""


def merge_schema(table: T.StructType, new: T.StructType, strict: bool = False) -> T.StructType:
    """The table's fields, its types winning, and new's other fields after them; nested structs alike.

    With ``strict``, differing types are an error; else they are only between nested and simple ones, and for decimals
    that don't fit.
    """

    def merged(a: T.DataType, b: T.DataType, name: str) -> T.DataType:
        if isinstance(a, T.StructType) and isinstance(b, T.StructType):
            return merge_schema(a, b, strict)
        if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
            return T.ArrayType(merged(a.elementType, b.elementType, name), a.containsNull or b.containsNull)
        if isinstance(a, T.MapType) and isinstance(b, T.MapType):
            return T.MapType(merged(a.keyType, b.keyType, name), merged(a.valueType, b.valueType, name), a.valueContainsNull or b.valueContainsNull)
        nested = (T.StructType, T.ArrayType, T.MapType)
        if isinstance(a, nested) != isinstance(b, nested) or strict and a != b:
            raise SchemaError(f"field {name}: {a.simpleString()} and {b.simpleString()} can't be merged")
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType) and (b.precision > a.precision or b.scale > a.scale):
            raise SchemaError(f"field {name}: {b.simpleString()} doesn't fit {a.simpleString()}")
        return a

    theirs = {f.name: f for f in new}
    out = []
    for f in table:
        g = theirs.get(f.name)
        if g is None:
            out.append(f)
            continue
        if "delta.generationExpression" in g.metadata and g.metadata["delta.generationExpression"] != f.metadata.get("delta.generationExpression"):
            raise SchemaError(f"field {f.name} exists: it can't become a generated column")
        out.append(T.StructField(f.name, merged(f.dataType, g.dataType, f.name), f.nullable or g.nullable, f.metadata or g.metadata))
    names = {f.name for f in table}
    return T.StructType(out + [T.StructField(f.name, f.dataType, True, f.metadata) for f in new if f.name not in names])


def cast_to(c: Column, source: T.DataType, target: T.DataType, safe: bool = False) -> Column:
    """A column cast to the target type, struct fields by name: missing ones null; strict casts raise, safe ones give null."""
    if source == target:
        return c
    if isinstance(source, T.StructType) and isinstance(target, T.StructType):
        have = {f.name: f.dataType for f in source}
        parts = [(cast_to(c.getField(f.name), have[f.name], f.dataType, safe) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(source, T.ArrayType) and isinstance(target, T.ArrayType):
        return F.transform(c, lambda x: cast_to(x, source.elementType, target.elementType, safe))
    return c.try_cast(target) if safe and not isinstance(target, (T.StructType, T.MapType, T.ArrayType)) else c.cast(target)
