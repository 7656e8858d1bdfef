"""CREATE TABLE and multi-row INSERT statements for PostgreSQL, MySQL and SQLite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OutputError

BATCH = 100
# Column types by dialect.
TYPES = {
    "postgres": {"bool": "BOOLEAN", "int": "BIGINT", "float": "DOUBLE PRECISION", "text": "TEXT", "datetime": "TIMESTAMP", "date": "DATE", "bytes": "BYTEA", "nested": "JSONB"},
    "mysql": {"bool": "BOOLEAN", "int": "BIGINT", "float": "DOUBLE", "text": "TEXT", "datetime": "DATETIME", "date": "DATE", "bytes": "BLOB", "nested": "TEXT"},
    "sqlite": {"bool": "BOOLEAN", "int": "INTEGER", "float": "REAL", "text": "TEXT", "datetime": "TEXT", "date": "DATE", "bytes": "BLOB", "nested": "TEXT"},
}


def _kind(t: T.DataType) -> str:
    for kind, classes in (("bool", T.BooleanType), ("int", T.IntegralType), ("float", (T.FractionalType, T.DecimalType)), ("datetime", (T.TimestampType, T.TimestampNTZType)), ("date", T.DateType), ("bytes", T.BinaryType), ("nested", (T.ArrayType, T.MapType, T.StructType, T.VariantType))):
        if isinstance(t, classes):
            return kind
    return "text"


def _types(dialect: str) -> dict[str, str]:
    if dialect not in TYPES:
        raise OutputError(f"unknown dialect: {dialect}")
    return TYPES[dialect]


def quoted(name: str, dialect: str) -> str:
    mark = "`" if dialect == "mysql" else '"'
    return mark + name.replace(mark, mark * 2) + mark


def create_table(schema: T.StructType, table: str, dialect: str = "postgres") -> str:
    kinds = _types(dialect)
    lines = ",\n".join(f"  {quoted(f.name, dialect)} {kinds[_kind(f.dataType)]}" for f in schema.fields)
    return f"CREATE TABLE {quoted(table, dialect)} (\n{lines}\n);"


def sql_literal(c: Column, t: T.DataType) -> Column:
    """NULL, a number, TRUE / FALSE, or a quoted text with its quotes doubled; bytes as '\\x..', nested values as JSON."""
    kind = _kind(t)
    text = {
        "bool": lambda: F.when(c, "TRUE").otherwise("FALSE"),
        "int": lambda: c.cast("string"),
        "float": lambda: c.cast("string"),
        "datetime": lambda: F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("'")),
        "date": lambda: F.concat(F.lit("'"), c.cast("string"), F.lit("'")),
        "bytes": lambda: F.concat(F.lit("'\\x"), F.lower(F.hex(c)), F.lit("'")),
        "nested": lambda: F.concat(F.lit("'"), F.replace(F.to_json(c), F.lit("'"), F.lit("''")), F.lit("'")),
        "text": lambda: F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")),
    }[kind]()
    return F.when(c.isNull(), "NULL").otherwise(text)


def insert_batches(df: DataFrame, table: str, order: list[str], *, dialect: str = "postgres", batch: int = BATCH) -> DataFrame:
    """(batch, statement): one INSERT for each `batch` rows in the given order, whose columns must not tie.

    Rows are numbered by range partition (counts of the parts before, plus the place within), so no task sees all rows.
    """
    _types(dialect)
    row = F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]), F.lit(")"))
    made = df.select(*[F.col(f"`{c}`") for c in order], row.alias("__row")).orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    from ..storage import written

    made = written(made, "sql-rows")
    part = F.shiftright("__at", 33).cast("int")
    sizes = sorted(map(tuple, made.groupBy(part.alias("p")).count().collect()))
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    begin = df.sparkSession.createDataFrame(starts, "__part int, __begin long")
    numbered = made.withColumn("__part", part).join(F.broadcast(begin), "__part").withColumn("__n", F.col("__begin") + F.col("__at").bitwiseAND((1 << 33) - 1))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("__n", "__row"))), lambda x: x["__row"])  # `batch` rows
    names = ", ".join(quoted(c, dialect) for c in df.columns)
    head = f"INSERT INTO {quoted(table, dialect)} ({names}) VALUES\n"
    placed = numbered.select(F.expr(f"__n div {batch}").alias("batch"), "__n", "__row").repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch")
    return placed.groupBy("batch").agg(F.concat(F.lit(head), F.array_join(rows, ",\n"), F.lit(";")).alias("statement"))


def row_order(schema: T.StructType) -> list[str]:
    """The columns that order a table's rows: its primary key, if the columns' metadata tell one, else all that can be ordered."""
    key = [f.name for f in schema.fields if f.metadata.get("primary")]
    return key or [f.name for f in schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def write_sql(df: DataFrame, table: str, path: str, *, dialect: str = "postgres", batch: int = BATCH) -> None:
    """A folder with the CREATE TABLE statement first, then the INSERT statements in order. Rows are shuffled by their key, and by
    ranges of batches, which stay in order."""
    spark = df.sparkSession
    numbered = insert_batches(df, table, row_order(df.schema), dialect=dialect, batch=batch).sortWithinPartitions("batch")
    first = spark.createDataFrame([(-1, create_table(df.schema, table, dialect))], "batch long, statement string").coalesce(1)
    first.unionByName(numbered).select("statement").write.mode("overwrite").text(path)
