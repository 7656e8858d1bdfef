"""Exact top-k inner-product search over an impact-ordered index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of an index block, queries of a broadcast block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Survivors, as a share of a block, below which rescoring beats further segments.
RESCORE = 0.02


def quantised(v: Column) -> Column:
    """floor(256 x) of each component; null for a vector that is null or holds a null or non-finite component."""
    x = F.transform(v, lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(sound, F.transform(x, lambda c: F.floor(F.lit(256.0) * c).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, the short ones filled up with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def build_index(vectors: DataFrame) -> DataFrame:
    """A row for each block of vectors: its ids, and its postings in segments of falling impact.

    A posting is (row, dimension, component); its quantised impact is the power of two below the component's size, and a
    segment holds all postings of one impact. tails has, for each segment and row, the length of what comes after it.
    """
    schema = "ids array<long>, dims int, impacts array<int>, starts array<long>, post_row array<int>, post_dim array<int>, post_value array<long>, tails array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(at, BLOCK_ROWS)
                v = _matrix(b.column(1))
                row, dim = np.nonzero(v)
                value = v[row, dim]
                impact = np.frexp(np.abs(value).astype(float))[1] - 1
                order = np.argsort(-impact, kind="stable")
                row, dim, value, impact = row[order], dim[order], value[order], impact[order]
                levels = -np.unique(-impact)
                starts = np.searchsorted(-impact, -levels, "left")
                rest, tails = (v.astype(float) ** 2).sum(1), []
                for i, s in enumerate(starts):
                    e = starts[i + 1] if i + 1 < len(starts) else len(row)
                    rest = rest - np.bincount(row[s:e], value[s:e].astype(float) ** 2, len(v))
                    tails.append(np.sqrt(np.maximum(rest, 0)))
                lists = [b.column(0).to_pylist(), v.shape[1], levels, [*starts, len(row)], row, dim, value, np.concatenate(tails) if tails else np.zeros(0)]
                types = [pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([x if np.isscalar(x) else np.asarray(x)], t) for x, t in zip(lists, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return vectors.mapInArrow(run, schema)


def blocks_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch, with views of its arrays."""
    for r in range(batch.num_rows):
        block = {name: batch.column(k)[r] for k, name in enumerate(batch.schema.names)}
        yield {n: v.values.to_numpy() if isinstance(v, pa.ListScalar) else v.as_py() for n, v in block.items()}


def search_block(q: np.ndarray, qid: np.ndarray, block: dict, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vec_id, score) of all rows of a block that may be among the k best, with exact scores.

    floor: for each query a score that k known vectors reach. Segments are added to all scores in order of impact. What
    is still to come for a row is at most |query| * |rest of the row|, so a row is out once its score plus that is below
    the k-th score minus that; the loop stops when few enough are left, which are rescored exactly.
    """
    ids, dims = np.asarray(block["ids"], np.int64), max(block["dims"], q.shape[1])
    q = np.pad(q, ((0, 0), (0, dims - q.shape[1]))).astype(float)
    row, dim, value = (np.asarray(block[c]) for c in ("post_row", "post_dim", "post_value"))
    starts = block["starts"]
    tails = np.asarray(block["tails"], float).reshape(-1, len(ids))
    v = np.zeros((len(ids), dims))
    v[row, dim] = value
    small = dims * max(np.abs(q).max(initial=1), 1) * max(np.abs(v).max(initial=1), 1) < 2**24  # then float32 is exact
    kind = np.float32 if small else np.float64
    score, own = np.zeros((len(q), len(ids)), kind), qid[:, None] == ids[None, :]
    norm, qk = np.sqrt((q**2).sum(1)).astype(kind), q.astype(kind)
    alive = ~own
    for i in range(len(starts) - 1):
        s, e = starts[i], starts[i + 1]
        touched = np.unique(row[s:e])
        part = np.zeros((len(touched), dims), kind)
        part[np.searchsorted(touched, row[s:e]), dim[s:e]] = value[s:e]
        score[:, touched] += qk @ part.T
        if i + 2 >= len(starts):
            break
        rest = norm[:, None] * (tails[i].astype(kind) * kind(1.0001))[None, :] + kind(1)
        least = np.where(own, -np.inf, score - rest)
        known = np.partition(least, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
        alive = (score + rest >= np.maximum(known, floor)[:, None]) & ~own
        if alive.mean() < RESCORE:
            break
    else:
        i = len(starts) - 2
    a, b = np.nonzero(alive)
    exact = np.zeros(len(a), np.int64)
    whole, ints = v.astype(np.int64), q.astype(np.int64)
    for at in range(0, len(a), 1 << 16):
        exact[at : at + (1 << 16)] = np.einsum("ij,ij->i", ints[a[at : at + (1 << 16)]], whole[b[at : at + (1 << 16)]])
    return a, ids[b], exact


def best(a: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, a))
    a, ids, score = a[order], ids[order], score[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a, "left")
    return a[rank < k], ids[rank < k], score[rank < k]


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with the rows of another id.

    Both tables have vec_id and embedding; vectors that are null or hold null or non-finite components and rows with a
    null id take no part, shorter ones count as filled up with zeros. Ties go to the smaller id. Every block of queries
    meets every block of the index: that is the stated query set against all rows; each task keeps only k rows a query.
    """
    spark = vectors.sparkSession
    sound = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    index = written(build_index(sound(vectors)), "topk-index")
    asked = written(sound(queries).withColumn("n", F.monotonically_increasing_id()), "topk-queries")
    count = asked.count()
    blocks = max(1, -(-count // BLOCK_QUERIES))

    def search(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value
        found = (np.zeros(0, np.int64),) * 3
        floor = np.full(len(qid), -np.inf)
        for batch in batches:
            for block in blocks_of(batch):
                if len(block["ids"]):
                    new = search_block(q, qid, block, k, floor)
                    found = best(*(np.concatenate([x, y]) for x, y in zip(found, new, strict=True)), k)
                    full = np.flatnonzero(np.bincount(found[0], minlength=len(qid)) == k)
                    last = np.searchsorted(found[0], full, "right") - 1
                    floor[full] = found[2][last]
        yield pa.RecordBatch.from_arrays([pa.array(qid[found[0]], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=["query_id", "vec_id", "score"])

    parts = []
    for i in range(blocks):
        rows = asked.where(F.pmod(F.shiftright("n", 33) + F.col("n").bitwiseAND((1 << 33) - 1), F.lit(blocks)) == i).select("vec_id", "v").toArrow()
        v = rows.column("v").combine_chunks()
        sent = spark.sparkContext.broadcast((rows.column("vec_id").to_numpy(), _matrix(v if isinstance(v, pa.Array) else v.chunk(0)) if rows.num_rows else np.zeros((0, 1), np.int64)))
        part = index.mapInArrow(lambda it, sent=sent: search(it, sent), "query_id long, vec_id long, score long")
        parts.append(part if blocks == 1 else written(part, "topk-part"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
