"""Names that stand in texts: the longest name of a list in each text, by an equality join of word runs."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that executors need no copy of the package

#: Words of a name, at most; longer names are told apart by an error.
WORDS = 8
#: Bits of the filter of names: 16 for each name, within these powers of two.
LEAST_BITS, MOST_BITS = 16, 27
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(words: Column) -> list[Column]:
    """Two hashes of each word."""
    return [F.transform(words, lambda w: F.xxhash64(F.lit(seed), w)).alias(f"__h{seed}") for seed in (1, 2)]


def _joined(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The identifiers of runs of n words from their hashes."""
    x = np.full(len(starts), n, np.uint64)
    for j in range(n):
        x = (x ^ (x >> np.uint64(31))) * _A + hashes[starts + j] * _B
        x ^= x >> np.uint64(29)
    return x


def _lists(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets from 0 and the numbers of two columns of lists of equal lengths."""
    columns = [b.column(at), b.column(at + 1)]
    offsets = columns[0].offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], [c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in columns]


def _identified(names: DataFrame) -> DataFrame:
    """names (__words, __size) with one and two, which tell names apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, hashes = _lists(b, 2)
            size, both = np.diff(offsets), [np.zeros(b.num_rows, np.uint64) for _ in hashes]
            for n in np.unique(size):
                some = np.flatnonzero(size == n)
                for out, h in zip(both, hashes, strict=True):
                    out[some] = _joined(h, offsets[some], int(n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x.view(np.int64)) for x in both]], names=["__words", "__size", "one", "two"])

    return names.select("__words", "__size", *_hashes(F.split("__words", " "))).mapInArrow(run, "__words string, __size int, one long, two long")


def _filter(names: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the names by both their identifiers, or-ed together by Spark: 2**bits bits arrive, whatever the names."""
    rows = names.select(F.explode(F.array("one", "two")).alias("id")).select(F.col("id").bitwiseAND((1 << bits) - 1).alias("bit"))
    rows = rows.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _runs(texts: DataFrame, sizes: list[int], names: np.ndarray) -> DataFrame:
    """(__key, n, at, one, two): the first place of each run of words in a text that may be a name."""
    sent, mask = texts.sparkSession.sparkContext.broadcast(names), np.uint64(64 * len(names) - 1)
    schema = T.StructType([T.StructField("__key", texts.schema["__key"].dataType), T.StructField("n", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType())])

    def held(x: np.ndarray) -> np.ndarray:
        x = x & mask
        return (sent.value[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, (first, second) = _lists(b, 1)
            of = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            for n in sizes:
                starts = np.arange(max(len(of) - n + 1, 0))
                starts = starts[of[starts] == of[starts + n - 1]]
                one = _joined(first, starts, n)
                starts, one = starts[some := held(one)], one[some]
                two = _joined(second, starts, n)
                starts, one, two = starts[some := held(two)], one[some], two[some]
                order = np.lexsort((starts, two, one, of[starts]))
                new = np.ones(len(order), bool)
                new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in (of[starts], one, two)])
                kept = order[new]
                rows = of[starts[kept]]
                at = (starts[kept] - offsets[rows] + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.full(len(kept), n, np.int32)), pa.array(at), pa.array(one[kept].view(np.int64)), pa.array(two[kept].view(np.int64))], names=schema.names)

    return texts.select("__key", *_hashes(F.col("__all"))).mapInArrow(run, schema)


def longest_name(df: DataFrame, key: str, text: str, places: DataFrame, name: str, *, weight: str | None = None, into: str = "place") -> DataFrame:
    """df with `into`, the row of places whose name is the longest that stands in the text as whole words; null without any.

    Case and signs between words do not count. Longest by words, then by characters; then the first in the text. Of places with
    the same words the one of most weight stands for all, else the first by all its columns. key tells the rows of df apart.
    Runs of words of the lengths that names have are numbers of 128 bits, made of their words' hashes. Those that a filter of
    all names lets through meet the names by equality; others are not shuffled. Texts are read once, whatever the number of names.
    """
    scratch = Scratch(df.sparkSession, "names")
    columns = [F.col(f"`{c}`") for c in places.columns]
    listed = places.select(F.array_join(words_of(F.col(name)), " ").alias("__words"), F.struct(*columns).alias("__row"), (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(0.0)).alias("__weight"))
    best = F.min(F.struct(-F.col("__weight"), "__row"))["__row"]
    listed = listed.where("__words <> ''").groupBy("__words").agg(best.alias("__row")).withColumn("__size", F.size(F.split("__words", " ")))
    listed = scratch.written(listed, "listed")
    counts = {r["__size"]: r["count"] for r in listed.groupBy("__size").count().orderBy("__size").limit(WORDS + 1).collect()}  # a few small numbers
    sizes = sorted(counts)
    if sizes and (longest := listed.agg(F.max("__size")).first()[0]) > WORDS:
        raise ValueError(f"a name of {longest} words; the most are {WORDS}")
    if not sizes:
        return df.withColumn(into, F.lit(None).cast(listed.schema["__row"].dataType))
    names = scratch.written(_identified(listed), "names")
    bits = min(max((16 * sum(counts.values())).bit_length(), LEAST_BITS), MOST_BITS)
    texts = df.select(F.col(key).alias("__key"), words_of(F.col(text)).alias("__all"))
    found = _runs(texts, sizes, _filter(names, bits)).join(names.select("one", "two", F.length("__words").alias("chars")), ["one", "two"])
    # Of a text, size and place tell a run, so these decide; as one number they are compared without sorting rows.
    order = (F.lit(WORDS) - F.col("n")).cast("long") * (1 << 59) + (F.lit((1 << 28) - 1) - F.col("chars")).cast("long") * (1 << 31) + F.col("at")
    chosen = found.select("__key", "one", "two", order.alias("order")).groupBy("__key").agg(F.min_by("one", "order").alias("one"), F.min_by("two", "order").alias("two"))
    chosen = chosen.join(names.select("one", "two", "__words"), ["one", "two"]).join(listed.select("__words", "__row"), "__words").select("__key", F.col("__row").alias(into))
    return df.join(chosen, F.col(key) == F.col("__key"), "left").drop("__key")
