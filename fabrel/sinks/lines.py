"""Formats of one row a line, written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import Value, display, kind_of


def plain(c: Column, t: T.DataType) -> Column:
    """What JSON can say: bytes as hex, tuples as arrays of their parts' text, times in ISO form."""
    if isinstance(t, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(t, T.StructType) and t.names and all(n == f"_{i + 1}" for i, n in enumerate(t.names)):
        kinds = {f.dataType for f in t.fields}
        if len(kinds) == 1:
            return F.when(c.isNotNull(), F.array(*[c[n] for n in t.names]))
    return c


def dated(df: DataFrame) -> DataFrame:
    """df with dates and times as texts where their column's metadata name a format."""
    formats = {f.name: f.metadata["date_format"] for f in df.schema.fields if "date_format" in f.metadata and isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType))}
    return df.withColumns({n: F.date_format(F.col(f"`{n}`"), x) for n, x in formats.items()}) if formats else df


def ndjson_rows(df: DataFrame) -> DataFrame:
    """(line): a JSON object for each row, nulls kept, fields in the order of the columns."""
    df = dated(df)
    row = F.struct(*[plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))


def write_ndjson(df: DataFrame, path: str) -> None:
    ndjson_rows(df).write.mode("overwrite").text(path)


def text_of(c: Column, t: T.DataType) -> Column:
    """The display text of a value; lists in [], maps in {}, tuples in ()."""
    if isinstance(t, T.BinaryType):
        return F.coalesce(F.lower(F.hex(c)), F.lit(""))
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: text_of(x, t.elementType)), ", "), F.lit("]")), F.lit(""))
    if isinstance(t, T.MapType):
        return F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(text_of(e["key"], t.keyType), F.lit(": "), text_of(e["value"], t.valueType))), ", "), F.lit("}")), F.lit(""))
    if isinstance(t, T.StructType):
        return F.when(c.isNull(), "").otherwise(F.concat(F.lit("("), F.concat_ws(", ", *[text_of(c[f.name], f.dataType) for f in t.fields]), F.lit(")")))
    return display(Value(c, kind_of(t)))


def display_rows(df: DataFrame) -> DataFrame:
    """df with every column as its display text."""
    df = dated(df)
    return df.select(*[text_of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def csv_rows(df: DataFrame) -> DataFrame:
    """(line): the display texts of a row, quoted where they hold commas, quotes or line ends."""
    shown = display_rows(df)
    cell = lambda n: F.when(F.col(f"`{n}`").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(f"`{n}`"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(f"`{n}`"))
    return shown.select(F.concat_ws(",", *[cell(n) for n in shown.columns]).alias("line"))


def write_csv(df: DataFrame, path: str, *, header: bool = True) -> None:
    display_rows(df).write.mode("overwrite").option("header", header).option("emptyValue", "").option("escape", '"').csv(path)
