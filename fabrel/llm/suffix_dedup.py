"""Removal of repeated long byte strings by bucket-pointer refinement of a sparse suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, key_filter, met, mix, small_batches, text_bytes, text_chunks, written

#: Bytes of a repeated string, and of the q-gram that an initial bucket stands for.
LENGTH, Q = 100, 20
#: Stretches around an anchor by which the firsts of a bucket are compared; they divide LENGTH - Q.
QUARTERS = 4
#: Bits of the way from a start to its anchor, and of the number of further starts, in a row's place: length - q stays below 2**WAY.
WAY = 11
#: Bytes of a long document that are looked at together.
PIECE = 1 << 20
#: Counters of bucket sizes: ROWS of 2**SKETCH_BITS; the least of a bucket's counters bounds its size. A bucket of more suffixes
#: than HOT, and than 4 times the mean counter, is split; so one that is not has 2**(2 - SKETCH_BITS) of all suffixes at most
#: (0.003 %), whatever the input.
SKETCH_BITS, ROWS, HOT = 17, 3, 20_000
#: Rows of whole buckets that are sorted at once; a bucket of more is sorted by itself.
GATHERED = 1 << 16

_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The identifier of two neighbouring strings from theirs."""
    z = x * _A
    z += (y ^ (y >> np.uint64(32))) * _B
    z ^= z >> np.uint64(29)
    return z


class Refinement:
    """Bucket identifiers of all offsets of some bytes, by refinement: those of 2m bytes are pairs of those of m bytes
    at an offset and m further on, and every level is kept for the next ones. Equal identifiers are equal strings."""

    def __init__(self, data: np.ndarray) -> None:
        self.level = {1: _SYMBOL[data]}

    def of(self, m: int) -> np.ndarray:
        if m not in self.level:
            p = 1 << ((m - 1).bit_length() - 1)
            x, y = self.of(p), self.of(m - p)
            n = max(len(x) - (m - p), 0)
            self.level[m] = _join(x[:n], y[p : p + n])
        return self.level[m]


def _least(x: np.ndarray, m: int) -> np.ndarray:
    """The least of each m neighbours."""
    done = 1
    while done < m:
        step = min(done, m - done)
        x = np.minimum(x[: max(len(x) - step, 0)], x[step:])
        done += step
    return x


def anchors(r: Refinement, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor) of runs of starts: the strings of `length` bytes from those starts all have the
    same anchor, the first of the q-grams in them of least identifier. Equal strings have their anchor at the same place,
    so only anchors need to stand for suffixes; one byte in about (length - q) / 2 is one. Strings do not leave documents.
    """
    n = int(offsets[-1])
    bits = np.uint64(max(24, n.bit_length()))
    gram = r.of(q)
    key = _least((mix(gram) >> bits << bits) | np.arange(len(gram), dtype=np.uint64), length - q + 1)
    size = np.diff(offsets)
    valid = np.zeros(n + 1, np.int8)
    long = size >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    anchor = (key[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return start[first], start[last], anchor[first]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes, offsets): some documents at once, or one long document in pieces that share length - 1 bytes, so
    that each of its strings is in one piece in full."""
    if len(data) <= PIECE or len(offsets) > 2:
        yield 0, data, offsets
        return
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + length - 1]
        yield at, part, np.array([0, len(part)])


def _counters(bucket: np.ndarray) -> list[np.ndarray]:
    """The counter of each bucket in each row. Anchors are least identifiers, so buckets are small numbers: they are mixed again."""
    return [(mix(bucket + c) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) for c in np.arange(1, ROWS + 1, dtype=np.uint64) * _A]


def size_bounds(sizes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """How many anchors each bucket has at most: what other buckets add differs from row to row."""
    return np.minimum.reduce([row[c] for row, c in zip(sizes, _counters(bucket), strict=True)])


def bucket_sizes(docs: DataFrame, length: int, q: int) -> np.ndarray:
    """How many anchors each counter of each row holds, over all documents; summed by Spark, ROWS * 2**SKETCH_BITS numbers arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, 1 << SKETCH_BITS), np.int64)
        for b in batches:
            for _, _, whole, bounds in text_chunks(b.column(0)):
                for _, data, offsets in _pieces(whole, bounds, length):
                    r = Refinement(data)
                    _, _, at = anchors(r, offsets, length, q)
                    for row, c in zip(total, _counters(mix(r.of(q)[at])), strict=True):
                        row += np.bincount(c, minlength=1 << SKETCH_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used], pa.int64())], names=["counter", "n"])

    sums = docs.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ROWS << SKETCH_BITS, np.int64)
    out[sums["counter"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(ROWS, -1)


def suffixes(docs: DataFrame, length: int, q: int, sizes) -> DataFrame:
    """(bucket, refined, sides, key, place): a row for each anchor. bucket is that of its q-gram, refined that of all
    bytes that its strings cover; sides has those (16 bits each) of the QUARTERS stretches of which each string with the
    anchor has one in full: the q-gram with three quarters of the rest of a string around it. place packs the first start, the way to the anchor, the number of
    further starts and whether the bucket is so large that it is split by document."""
    names = ["bucket", "refined", "sides", "key", "place"]
    step = (length - q) // QUARTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sizes.value
        hot = max(HOT, 4 * int(counts.mean()))
        for b in batches:
            keys = b.column(0).to_numpy()
            pieces = ((row, *piece) for row, _, texts, bounds in text_chunks(b.column(1)) for piece in _pieces(texts, bounds, length))
            for row, base, data, offsets in pieces:
                r = Refinement(data)
                lo, hi, at = anchors(r, offsets, length, q)
                whole, part_ids = r.of(length), r.of(length - step)
                shape = ((at - lo) << 16 | (hi - lo)).astype(np.uint64)
                refined = mix(_join(_join(whole[lo], whole[hi]), mix(shape + _A)))
                sides = np.zeros(len(at), np.uint64)
                for k in range(QUARTERS):
                    side = mix(part_ids[np.clip(at - k * step, 0, max(len(part_ids) - 1, 0))])
                    sides |= side >> np.uint64(48) << np.uint64(16 * k)
                bucket = mix(r.of(q)[at])
                doc = np.searchsorted(offsets, lo, "right") - 1
                key = keys[row + doc]
                parts = np.maximum(-(-size_bounds(counts, bucket) // hot), 1)
                part = (mix(key.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % parts
                split = (parts > 1).astype(np.int64)
                bucket = bucket ^ mix(part.astype(np.uint64) * _B) * split.astype(np.uint64)
                place = (base + lo - offsets[doc]) << (2 * WAY + 1) | (at - lo) << (WAY + 1) | (hi - lo) << 1 | split
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (bucket.view(np.int64), refined.view(np.int64), sides.view(np.int64), key, place)], names=names)

    return docs.select("__key", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def strings_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(string, key, rest) for each string of the anchors in wanted (key, runs: first and last start). string is its
    identifier; rest packs 31 more bits of it, whether the batch at hand has an earlier equal one, and the start.

    A string that is met again in a batch is a repeat already: it gets an identifier of its own, so that the occurrences
    of one string come together a batch each at most, however many documents have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            keys, runs = b.column(0).to_numpy(), b.column(2)
            ends = runs.offsets.to_numpy()
            flat = runs.flatten()
            lo, hi = (flat.field(i).to_numpy() for i in range(2))
            of = np.repeat(np.arange(len(keys)), np.diff(ends))
            for c in range(0, len(lo), 50_000):
                o, s, more = of[c : c + 50_000], lo[c : c + 50_000], (hi - lo)[c : c + 50_000]
                size = more + length
                begin = np.concatenate([[0], np.cumsum(size)])
                inner = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
                ids = Refinement(data[np.repeat(offsets[o] + s, size) + inner]).of(length)
                on = np.flatnonzero(inner <= np.repeat(more, size))
                each = np.repeat(np.arange(len(o)), size)[on]
                string, key, start = mix(ids[on]), keys[o[each]], s[each] + inner[on]
                extra = (mix(ids[on] ^ _B) >> np.uint64(33)).astype(np.int64)
                order = np.lexsort((start, key, string))
                again = np.zeros(len(order), bool)
                again[order[1:]] = string[order[1:]] == string[order[:-1]]
                string[again] = mix(mix(key[again].view(np.uint64)) + start[again].astype(np.uint64) * _A)
                rest = extra << 32 | again.astype(np.int64) << 31 | start
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (string.view(np.int64), key, rest)], names=["string", "key", "rest"])

    some = met(docs.select("__key", "text"), "__key", key_filter(wanted, "key"))
    joined = some.join(wanted, some["__key"] == wanted["key"]).select("__key", "text", "runs")
    return joined.mapInArrow(run, "string long, key long, rest long")


def ordered_keys(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `__key`, a number in the order of doc_id: the id itself, where ids are unique; else the
    place in the order of id (null first), then text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs.withColumn("__key", F.col("doc_id"))
    return written(docs.orderBy("doc_id", "text").withColumn("__key", F.monotonically_increasing_id()), "suffix-keys")


def whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[dict[str, np.ndarray]]:
    """Columns of consecutive whole buckets, about `rows` rows at once, of batches that are in order of bucket."""
    kept: list[pa.RecordBatch] = []
    held, enough = 0, rows

    def columns(part: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        return {n: np.concatenate([b.column(n).to_numpy() for b in part]) for n in part[0].schema.names}

    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        held += b.num_rows
        if held < enough:
            continue
        last = kept[-1].column("bucket")[-1].as_py()
        begin = [int(np.searchsorted(x.column("bucket").to_numpy(), last)) for x in kept]  # where the last bucket begins, which may go on
        done = [x.slice(0, n) for x, n in zip(kept, begin, strict=True) if n]
        kept = [x.slice(n) for x, n in zip(kept, begin, strict=True) if n < x.num_rows]
        held = sum(x.num_rows for x in kept)
        enough = max(rows, 2 * held)
        if done:
            yield columns(done)
    if kept:
        yield columns(kept)


def pointers(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, pointer): the order of rows by the keys, and for each row the place in it where its bucket of equal keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for i, k in enumerate(keys):
        at = k[order]
        new[1:] = at[1:] != at[:-1] if not i else new[1:] | (at[1:] != at[:-1])
    begin = np.flatnonzero(new)
    pointer = np.empty(len(order), np.int64)
    pointer[order] = np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order, pointer


def _survivors(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """(key, repeat, first, last): runs of starts whose strings all repeat an earlier one, or may. Each bucket of q-grams is sorted on
    the identifiers of all bytes around its anchors, then its firsts, by the bucket's pointer, on those of each stretch."""
    few = (1 << WAY) - 1
    for c in whole_buckets(batches):
        n, place = len(c["key"]), c["place"]
        lo, way, more, split = place >> (2 * WAY + 1), (place >> (WAY + 1)) & few, (place >> 1) & few, (place & 1) == 1
        _, bucket = pointers(c["bucket"])
        _, fine = pointers(bucket, c["refined"])
        order = np.lexsort((place, c["key"], fine))
        first = np.zeros(n, bool)
        first[order[np.flatnonzero(np.diff(fine[order], prepend=-1))]] = True
        open_ = np.flatnonzero((np.bincount(bucket[first], minlength=n)[bucket] > 1) | split)
        begin, end = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        for k in range(QUARTERS):
            _, side = pointers(bucket[open_], (c["sides"][open_] >> (16 * k)) & 65535)
            shared = open_[split[open_] | (np.bincount(side[first[open_]], minlength=len(open_))[side] > 1)]
            # Strings that start k to k + 1 steps before the anchor have stretch k in them.
            begin[shared] = np.minimum(begin[shared], (lo + way - (k + 1) * step)[shared])
            end[shared] = np.maximum(end[shared], (lo + way - k * step)[shared])
        begin, end = np.where(first, np.maximum(begin, lo), lo), np.where(first, np.minimum(end, lo + more), lo + more)
        left = np.flatnonzero(begin <= end)
        yield pa.RecordBatch.from_arrays([pa.array(x[left]) for x in (c["key"], ~first, begin, end)], names=["key", "repeat", "first", "last"])


def repeated_strings(docs: DataFrame, scratch: Scratch, *, length: int = LENGTH, q: int = Q) -> DataFrame:
    """(key, spans: array of first start and end): bytes covered by a string of `length` bytes that also starts earlier.

    docs has __key, in the order that makes a document earlier, and text. Initial buckets hold the anchors of one q-gram;
    a bucket of one is done. Others are refined by the identifiers of the bytes around: a suffix with an earlier one in
    its refined bucket is a repeat as a whole. The firsts of the refined buckets are refined by the stretches around the
    anchor: each string with the anchor has one of them in full, so only strings of a stretch that two firsts share can
    repeat, and they are compared one by one; a string with an earlier equal is a repeat. Very large buckets are split by document: each part refers to its own first, and those firsts meet at the last level, where
    every batch has dropped its own repeats before the shuffle.
    """
    spark = docs.sparkSession
    sizes = spark.sparkContext.broadcast(bucket_sizes(docs, length, q))
    rows = suffixes(docs, length, q, sizes).repartition("bucket").sortWithinPartitions("bucket")
    rows = rows.mapInArrow(lambda it: _survivors(it, (length - q) // QUARTERS), "key long, repeat boolean, first long, last long")
    rows = scratch.written(rows, "buckets")

    whole = rows.where("repeat").select("key", F.struct(F.col("first").alias("lo"), (F.col("last") + length).alias("hi")).alias("span"))
    open_ = rows.where("NOT repeat").groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # of one document
    open_ = scratch.written(open_, "open")
    strings = strings_of(docs, open_, length)
    start = F.col("rest").bitwiseAND((1 << 31) - 1)
    same = Window.partitionBy("string", F.shiftright("rest", 32)).orderBy("key", start)
    single = strings.withColumn("turn", F.row_number().over(same)).where((F.col("turn") > 1) | (F.col("rest").bitwiseAND(1 << 31) != 0))
    single = single.select("key", F.struct(start.alias("lo"), (start + length).alias("hi")).alias("span"))
    return whole.unionByName(single).groupBy("key").agg(F.collect_list("span").alias("spans"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that some spans cover."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    return lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]


def deduplicate_strings(docs: DataFrame, *, length: int = LENGTH, q: int = Q, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, with texts, kept as binary) for every row of docs.

    Bytes covered by a `length`-byte string that also starts earlier (smaller doc_id, or earlier in the document) go.
    Null and empty texts have no bytes. Rows that share an id, or have none, rank by id (null first), then text. Other
    columns are not read. length - q is a multiple of `QUARTERS` from 1 to 2**WAY - 1; a text has below 2**31 bytes.
    """
    if q < 1 or (length - q) % QUARTERS or not 0 < length - q < 1 << WAY:
        raise ValueError(f"length - q must be a multiple of {QUARTERS} from {QUARTERS} to {(1 << WAY) - QUARTERS}: length={length}, q={q}")
    small_batches(docs.sparkSession)
    keyed = ordered_keys(docs)
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = scratch.written(repeated_strings(keyed, scratch, length=length, q=q), "spans")
    scratch.drop("buckets", "open")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            lists, out = b.column(2), []
            for i, doc in enumerate(b.column(0).to_pylist()):
                text, gone, n = data[offsets[i] : offsets[i + 1]], 0, 0
                if lists[i].is_valid:
                    x = lists[i].values
                    lo, hi = merged(x.field(0).to_numpy(), x.field(1).to_numpy())
                    change = np.zeros(len(text) + 1, np.int32)
                    change[lo] += 1
                    change[hi] -= 1
                    total, text = len(text), text[np.cumsum(change[:-1]) == 0]
                    gone, n = total - len(text), len(lo)
                raw = text.tobytes()
                out.append((doc, len(raw) + gone, gone, n, hashlib.sha256(raw).hexdigest(), *[raw] * texts))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    bits = key_filter(spans, "key")
    some, rest = met(keyed, "__key", bits), met(keyed, "__key", bits, want=False)  # most documents lose nothing and stay where they are
    made = some.join(spans, some["__key"] == spans["key"], "left").select("doc_id", "text", "spans")
    made = made.unionByName(rest.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    return made.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
