"""Sharding by Hilbert-curve order of several metadata dimensions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, Scratch, looked_up, row_keys, width


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of `points` (n x d integers below 2**bits), d * bits <= 62.

    Gray-code construction: from the top bit down, each axis either reflects or swaps with the first one.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(d):
            on = (x[i] & step) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        turn = np.where((x[d - 1] & step) != 0, turn ^ (step - 1), turn)
        step >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def size_level(size: Column) -> Column:
    """A quarter of an octave of a size, from 16 bytes to a megabyte in 64 levels: integers only, so alike on all machines."""
    bits = F.length(F.bin(size))
    level = 4 * (bits - 1) + F.expr("shiftright(size * 4, length(bin(size)) - 1)") % 4 - 16
    return F.greatest(F.lit(0), F.least(F.lit(63), level)).cast("long")


def ranked(df: DataFrame, order: Sequence[Column], scratch: Scratch, label: str) -> tuple[DataFrame, int]:
    """df as a written table with `__part`, `__at` and `__rank`, its exact position from 0 in an order; and the row count.
    Ranges are sorted by themselves; a number for each of them reaches the driver."""
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(width(spark), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_ = scratch.written(sorted_, label)
    part = F.shiftright("__at", 33).cast("int")
    begin, n = begins(sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "__begin")
    out = sorted_.withColumn("__part", part).join(F.broadcast(begin), "__part")
    return out.withColumn("__rank", F.col("__begin") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__begin"), n


def begins(sizes: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(`__part`, name: the sum of n of the parts before) of sizes (part, n), which has a row for each partition; and the sum."""
    rows = sorted(map(tuple, sizes.collect()))
    starts = np.concatenate([[0], np.cumsum([n for _, n in rows])]).astype(int).tolist()
    return sizes.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(rows, starts, strict=False)], f"__part int, {name} long"), starts[-1]


def value_level(rows: DataFrame, name: str, n_rows: int, bits: int, scratch: Scratch) -> DataFrame:
    """rows with `__level_<name>`: the place of a text column's value among its distinct values in order of code points (null
    first), in 2**bits levels of equally many values."""
    values = rows.groupBy(name).agg(F.count("*").alias("__n"))
    values, n = ranked(values, [F.col(name).asc_nulls_first()], scratch, f"values-{name}")
    level = F.expr(f"__rank * {min(n, 1 << bits)} div {max(n, 1)}")
    values = values.select(F.coalesce(name, F.lit("")).alias("__value"), F.col(name).isNull().alias("__null"), level.alias(f"__level_{name}"), "__n")
    rows = rows.withColumns({"__value": F.coalesce(name, F.lit("")), "__null": F.col(name).isNull()})
    return scratch.written(looked_up(rows, values, ["__value", "__null"], n_rows).drop("__value", "__null"), f"with-{name}")


def hilbert_column(levels: Sequence[str], bits: int) -> Column:
    @F.arrow_udf("long")
    def index(*cols: pa.Array) -> pa.Array:
        return pa.array(hilbert_index(np.stack([c.to_numpy() for c in cols], axis=1), bits))

    return index(*levels)


def cut_runs(ranks: DataFrame, n: int, shards: int, scratch: Scratch) -> DataFrame:
    """Adds `shard` and `slot`: runs of the order, with row counts at most one apart; slots are gapless from 0.

    ranks has `__rank`, `__part`, `__at`, `__single` (no other row is equal to it) and `__group`. Where a cut would fall into a
    group of equal rows, as many single rows as stand in it before the cut are drawn forward from behind the group, so that
    the group begins at the cut; it stays cut only if there are too few of them before the next cut.
    """
    before = F.sum(F.col("__single").cast("long")).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    ranks = ranks.withColumn("__before", F.coalesce(before, F.lit(0)))
    begin, _ = begins(ranks.groupBy(F.col("__part").alias("part")).agg(F.sum(F.col("__single").cast("long")).alias("n")), "__base")
    ranks = scratch.written(ranks.join(F.broadcast(begin), "__part").withColumn("__before", F.col("__before") + F.col("__base")).drop("__base"), "ranks")
    cuts = [-(-i * n // shards) for i in range(1, shards) if 0 < -(-i * n // shards) < n]
    at = ranks.where(F.col("__rank").isin([c - 1 for c in cuts] + cuts)).select("__rank", "__group").collect()  # two rows a cut
    group = {r["__rank"]: r["__group"] for r in at}
    split = [c for c in cuts if group[c - 1] == group[c]]
    spans = {r["__group"]: r for r in ranks.where(F.col("__group").isin([group[c] for c in split])).groupBy("__group").agg(F.min("__rank").alias("s"), (F.max("__rank") + 1).alias("e"), F.max("__before").alias("singles")).collect()} if split else {}
    moves = [(c, g["s"], g["e"], g["singles"]) for c in split for g in [spans[group[c]]] if g["e"] - g["s"] <= n // shards]
    lasts = ranks.where(F.col("__single") & F.col("__before").isin([singles + c - s - 1 for c, s, _, singles in moves])).select("__before", "__rank").collect() if moves else []
    last = {r["__before"]: r["__rank"] for r in lasts}  # the single that is the last to be drawn forward
    rank = F.col("__rank")
    done = 0
    new = rank
    for c, s, e, singles in moves:
        k, t = c - s, last.get(singles + c - s - 1)
        if t is None or s < done or t >= min([x for x in cuts if x >= e] or [n]):
            continue
        done, drawn = t + 1, F.col("__before") - singles
        here = F.when(rank < e, rank + k).when(F.col("__single"), s + drawn).otherwise(rank + k - drawn)
        new = F.when((rank >= s) & (rank <= t), here).otherwise(new)
    shard = F.expr(f"__rank * {shards} div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return ranks.withColumn("__rank", new).withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__rank") - start)


def shard_documents(docs: DataFrame, *, shards: int = 16, bits: int = 6, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Shards of `documents` by Hilbert order of (lang, source, text size).

    Returns the columns of `carry` with size (UTF-8 bytes of the text plus 1; null: 1), text_crc32 (null text: that
    of the empty one), hilbert, shard and slot. Shard row counts differ by one at most. Rows of equal text stand together, at
    the place of the smallest id among them, and in one shard, as far as the row counts allow: a group that outgrows a shard
    is cut. Null ids, languages and sources sort first; columns of the same names are replaced.

    All is found on narrow rows: texts are read once for them, and once more to meet their places, if `carry` asks for more
    than ids; each is shuffled once at most. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    keyed, _ = row_keys(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = keyed.select(ROW, F.col("doc_id").alias("__id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("__text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    meta = scratch.written(meta, "meta")
    n = meta.count()
    equal = ["__text", "text_crc32", "size"]
    groups = meta.groupBy(*equal).agg(F.count("*").alias("__n"), F.min(F.struct("__id", "lang", "source")).alias("__first")).where("__n > 1")
    rows = looked_up(meta, scratch.written(groups, "groups"), equal, n, "left")
    single = F.col("__first").isNull()
    rows = rows.select(ROW, "__id", *equal, single.alias("__single"), *[F.when(single, F.col(c)).otherwise(F.col(f"__first.{c}")).alias(c) for c in ("lang", "source")])
    for c in ("lang", "source"):
        rows = value_level(rows, c, n, bits, scratch)
    rows = rows.withColumn("__level_size", F.shiftright(size_level(F.col("size")), 6 - bits))
    rows = rows.withColumn("hilbert", hilbert_column(["__level_lang", "__level_source", "__level_size"], bits)).withColumn("__group", F.xxhash64("hilbert", *equal))
    order = [F.col("hilbert"), *map(F.col, equal), F.col("__id").asc_nulls_first(), F.col(ROW)]
    ranks, _ = ranked(rows.select(ROW, "__id", *equal, "__single", "hilbert", "__group"), order, scratch, "order")
    out = cut_runs(ranks, n, shards, scratch)
    scratch.drop("meta", "groups", "values-lang", "values-source", "with-lang", "with-source", "order")
    made = ["size", "text_crc32", "hilbert", "shard", "slot"]
    if tuple(carry) == ("doc_id",):
        return out.select(F.col("__id").alias("doc_id"), *made)
    kept = [F.col(f"`{c}`") for c in carry if c not in made]
    return keyed.select(ROW, *kept).join(out.select(ROW, *made), ROW).drop(ROW)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; each holds a run of the curve, so file statistics prune on every dimension."""
    sharded.repartitionByRange(width(sharded.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
