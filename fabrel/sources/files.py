"""Readers of data files: parquet, delimited and fixed-width text, JSON, XML, archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.publish import manifest
from ..storage import written
from .archives import archive_lines


def tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The parquet tables of a folder, by name; Spark prunes columns and pushes filters into them."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def delimited(spark: SparkSession, path: str, schema: str, *, sep: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """CSV, TSV and the like, compressed (gz, bz2) or not. Rows that do not fit the schema are left out; `rejected` tells them."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, quote=quote, mode="DROPMALFORMED")


def rejected(spark: SparkSession, path: str, schema: str, *, sep: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """The rows that `delimited` leaves out, as a written table: the fields that could be read, and the line in `_line`."""
    read = spark.read.csv(path, schema=f"{schema}, _line string", sep=sep, header=header, quote=quote, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    return written(read.where("_line IS NOT NULL"), "rejected")


def fixed_width(spark: SparkSession, path: str, fields: Sequence[tuple[str, int, int, str]]) -> DataFrame:
    """Columns by place: (name, first character from 1, length, type)."""
    return spark.read.text(path).select(*[F.trim(F.substring("value", a, n)).try_cast(t).alias(name) for name, a, n, t in fields])


def whitespace(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns parted by blanks: (name, type) in order."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, i).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def json_document(spark: SparkSession, path: str, schema: str, pointer: Sequence[str] = ()) -> DataFrame:
    """The elements of an array inside JSON documents: pointer leads from the top to it."""
    df = spark.read.json(path, schema=schema, multiLine=True)
    if not pointer:
        return df
    at: Column = F.col(pointer[0])
    for name in pointer[1:]:
        at = at[name]
    return df.select(F.explode(at).alias("item")).select("item.*")


def json_map(spark: SparkSession, path: str, schema: str, column: str) -> DataFrame:
    """(key, value) of an object whose names are data."""
    df = spark.read.json(path, schema=schema, multiLine=True)
    return df.select(F.explode(column).alias("key", "value"))


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def zipped(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, line): the text lines of the members of zip and tar archives whose names end in suffix (`archives`)."""
    return archive_lines(spark, path, suffix=suffix)


def prepared_lists(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Prepared JSON lists of a folder, by name: what is published there, else a file `<name>.json` that holds an array of objects.
    Lists that are missing or cannot be read are left out, so a caller falls back to the built-in ones."""
    out, versions = {}, manifest(spark, folder)
    for name in names:
        try:
            df = spark.read.json(f"{folder}/{versions.get(name, f'{name}.json')}", multiLine=True, mode="PERMISSIVE")
        except AnalysisException:  # no such file
            continue
        if set(df.columns) - {"_corrupt_record"}:
            out[name] = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record") if "_corrupt_record" in df.columns else df
    return out
