"""Flatten a result for export: the same reduction the serving mirrors apply to arrays and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(field: T.StructField) -> Column:
    c, t = F.col(f"`{field.name}`"), field.dataType
    if isinstance(t, T.DecimalType):
        c = c.cast("double")
    elif isinstance(t, T.DateType):
        c = c.cast("string")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        c = F.array_join(c, ",")
    elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
        c = c.cast("bigint")
    return c.alias(field.name)


def present(df: DataFrame) -> DataFrame:
    """Decimals to double, dates and times to text, string arrays to comma text, ints to bigint."""
    return df.select(*[_flat(f) for f in df.schema.fields])
