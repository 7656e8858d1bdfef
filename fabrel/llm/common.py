"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Scratch, written  # noqa: F401

#: Whitespace of the word rule `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; a longer document is handled alone.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch of texts, at most.
BATCH_ROWS = 1000
#: Column of the key of a row.
ROW = "__row"
#: Keys of many rows that a join broadcasts, at most; and how many rows a key has for that, at least.
HOT_KEYS, HOT_ROWS = 200_000, 1000
#: Bits of a filter of keys: 2**FILTER_BITS.
FILTER_BITS = 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(docs with `__row`, a number of its own for each row; whether that is the id). It is the id, where ids are unique and
    none is null; else the number of the row's file and its place there, where docs are read from Parquet; else it is made
    once, on a written table. So each later read of a row finds the same number."""
    rows, ids = docs.agg(F.count("*"), F.count_distinct(F.col("doc_id").cast("long"))).first()
    if rows == ids:
        return docs.withColumn(ROW, F.col("doc_id").cast("long")), True
    try:
        placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__index"))
    except AnalysisException:  # not a scan of Parquet files
        return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "row-keys"), False
    files = placed.select("__path").distinct().withColumn("__file", F.row_number().over(Window.orderBy("__path")))  # a row for each file
    keyed = placed.join(written(files, "row-files"), "__path").withColumn(ROW, F.shiftleft(F.col("__file").cast("long"), 36) + F.col("__index"))
    return keyed.drop("__path", "__index", "__file"), False


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Holds the session's Arrow batches at `rows` rows at most: texts are long, and a batch stands in the executor and in
    Python several times over. It stays set, as lazy results are planned later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def width(spark: SparkSession) -> int:
    """Partitions for an explicit repartitioning: the session's own number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole Arrow column and its row offsets; null counts as empty."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents of about `limit` bytes."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def filter_places(column: str) -> list[Column]:
    """The two places of a key in a filter, as columns __b1 and __b2."""
    return [F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << FILTER_BITS)).alias(f"__b{seed}") for seed in (1, 2)]


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column of numbers, or-ed together by Spark: 2**FILTER_BITS bits arrive, whatever the keys."""
    rows = keys.select(F.explode(F.array(*filter_places(column))).alias("bit"))
    rows = rows.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def held(bits: np.ndarray, one: pa.Array, two: pa.Array) -> np.ndarray:
    """Whether a filter has both places of each key."""
    on = lambda c: (bits[c >> 6] >> (c & 63).astype(np.uint64)) & np.uint64(1) == 1
    return on(one.to_numpy()) & on(two.to_numpy())


def met(df: DataFrame, column: str, bits: np.ndarray, *, want: bool = True) -> DataFrame:
    """The rows of df whose key the filter holds, or (want=False) those whose key is surely not among its keys.

    Before a join on the key this keeps most other rows from being shuffled; a full filter lets all rows through.
    """
    sent = df.sparkSession.sparkContext.broadcast(bits)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(names).filter(pa.array(held(sent.value, b.column(len(names)), b.column(len(names) + 1)) == want))

    return df.select(*names, *filter_places(column)).mapInArrow(run, df.schema)


def looked_up(rows: DataFrame, facts: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has one row for each key `on` and `__n`, how many of the `total` rows have it.

    Keys of more than a 200,000th of the rows (HOT_ROWS at least) are broadcast: there are below HOT_KEYS of them, whatever
    the input, and their rows stay where they are. The others have few rows each, 5 in a million of all at most, less than a
    task's share, and are joined by a shuffle. Both tables are read twice, so they should be written ones.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = facts.where(F.col("__n") > most).drop("__n")
    cold = facts.where(F.col("__n") <= most).drop("__n")
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
