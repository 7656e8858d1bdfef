"""Benchmark decontamination by the q-gram lemma over diagonal bands, with banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, row_keys, small_batches, text_chunks, written

#: Bytes of a q-gram; a q-gram is one 64-bit number, so equal numbers are equal q-grams.
Q = 8
#: Edits allowed, as a share of the item's length.
EDIT_RATE = 0.08
#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 2 << 20

#: Shared q-grams of a text and the items that are looked at together.
ENTRIES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def fold(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased and runs of blanks as one, and where each stands in the input."""
    t = _FOLD[text]
    blank = t == 32
    keep = np.ones(len(t), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.flatnonzero(keep)
    return t[at], at


def qgrams(t: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each byte, as a number."""
    n = len(t) - Q + 1
    out = np.empty(max(n, 0), np.uint64)
    raw = t.tobytes()
    for r in range(min(Q, max(n, 0))):
        out[r::Q] = np.frombuffer(raw, "<u8", count=(n - r + Q - 1) // Q, offset=r)
    return out


@dataclass
class Index:
    """Q-grams of a block of items: sorted, with item and position; need and budget are those of the q-gram lemma."""

    ids: list
    texts: list[np.ndarray]
    length: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    bits: int
    step: int


def build_index(items: list[tuple[int, str | None]], *, rate: float = EDIT_RATE) -> Index:
    """Items of fewer than Q bytes are left out. An occurrence with at most k edits of an item of m bytes shares
    m - Q + 1 - k Q q-grams with it; k falls where that would be below 1."""
    ids, texts = [], []
    for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0)):
        t = fold(np.frombuffer((text or "").strip().encode("utf-8", "replace"), np.uint8))[0]
        if len(t) >= Q:
            ids.append(i)
            texts.append(t)
    length = np.array([len(t) for t in texts], np.int64)
    budget = np.minimum((length * rate).astype(np.int64), (length - Q) // Q)
    grams = [qgrams(t) for t in texts]
    item = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
    flat = np.concatenate(grams or [np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    unique, first = np.unique(flat[order], return_index=True)
    bits = max(16, int(np.ceil(np.log2(len(unique) + 1))) + 5)
    seen = np.zeros(1 << bits, bool)
    seen[(unique * _SPREAD) >> np.uint64(64 - bits)] = True
    step = 1 << max(6, int(budget.max(initial=0)).bit_length())
    return Index(ids, texts, length, budget, length - Q + 1 - budget * Q, unique, np.append(first, len(flat)), item[order], place[order], seen, bits, step)


def candidates(ix: Index, t: np.ndarray, doc_of: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows (doc, item, band): bands of diagonals in which a document shares enough q-grams with an item.

    A band holds `step` diagonals and, overlapping the next band, as many more as the largest budget; whatever an
    occurrence's edits do, its diagonals lie in one band.
    """
    g = qgrams(t)
    pos = np.flatnonzero(ix.seen[(g * _SPREAD) >> np.uint64(64 - ix.bits)])
    at = np.minimum(np.searchsorted(ix.grams, g[pos]), max(len(ix.grams) - 1, 0))
    hit = (ix.grams[at] == g[pos]) & (doc_of[pos] == doc_of[pos + Q - 1])
    pos, at = pos[hit], at[hit]
    many, n_item = ix.first[at + 1] - ix.first[at], max(len(ix.ids), 1)
    shift = int(ix.length.max(initial=0)) + ix.step
    n_band = (len(t) + 2 * shift) // ix.step + 2

    def entries() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, entry of the index) of all shared q-grams, some at a time: a run of one q-gram has very many."""
        cut = np.searchsorted(np.cumsum(many), np.arange(ENTRIES, int(many.sum()), ENTRIES), "left") + 1
        for a, b in zip([0, *cut], [*cut, len(pos)], strict=True):
            n = many[a:b]
            entry = np.repeat(ix.first[at[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(pos[a:b], n), entry

    def counted(keys: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and how often they come, in memory of the distinct ones."""
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in keys:
            new, n = np.unique(k, return_counts=True)
            key, where = np.unique(np.concatenate([key, new]), return_inverse=True)
            count = np.bincount(where, np.concatenate([count, n]), minlength=len(key)).astype(np.int64)
        return key, count

    pair, n = counted(doc_of[p] * n_item + ix.item[e] for p, e in entries())
    pair = pair[n >= ix.need[pair % n_item]]  # few pairs share enough at all

    def banded() -> Iterator[np.ndarray]:
        for p, e in entries():
            key = doc_of[p] * n_item + ix.item[e]
            near = np.searchsorted(pair, key)
            enough = near < len(pair)
            enough[enough] = pair[near[enough]] == key[enough]
            p, e, key = p[enough], e[enough], key[enough]
            diagonal = p - start[doc_of[p]] - ix.place[e] + shift
            band = diagonal // ix.step
            also = (diagonal - band * ix.step) < int(ix.budget.max(initial=0)) + 1
            yield np.concatenate([key, key[also]]) * n_band + np.concatenate([band, band[also] - 1])

    key, n = counted(banded())
    key = key[n >= ix.need[key // n_band % n_item]]
    return np.stack([key // n_band // n_item, key // n_band % n_item, (key % n_band) * ix.step - shift], axis=1)


def align(ix: Index, t: np.ndarray, start: np.ndarray, end: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least edits, end in the document) of each candidate: its item against any stretch of the document in its band.

    Edit distance, free at both ends of the document, row by row over the item, all candidates at once.
    """
    doc, item, low = found.T
    k = int(ix.budget.max(initial=0))
    lanes, n = ix.step + 2 * k + 2, len(found)
    low = low - k  # the band's first diagonal and room for edits on either side
    lane = np.arange(lanes, dtype=np.int32)
    length = ix.length[item]
    best, where = np.full(n, 1 << 20), np.zeros(n, np.int64)
    # D[j]: edits of the item's first i bytes, ending before document byte low + i + j.
    inside = lambda i: (low[:, None] + i + lane >= 0) & (low[:, None] + i + lane <= (end - start)[doc][:, None])
    far = np.int32(1 << 20)
    d = np.where(inside(0), 0, far).astype(np.int32)
    size = len(t)
    for i in range(1, int(length.max(initial=0)) + 1):
        on = np.flatnonzero(length >= i)
        letter = np.array([ix.texts[x][i - 1] for x in item[on]], np.uint8)
        at = start[doc[on]][:, None] + low[on][:, None] + i - 1 + lane
        same = t[np.clip(at, 0, size - 1)] == letter[:, None]
        old = d[on]
        new = old + ~same
        new[:, :-1] = np.minimum(new[:, :-1], old[:, 1:] + 1)  # the item has a byte more
        ok = (at >= start[doc[on]][:, None] - 1) & (at < end[doc[on]][:, None])
        new[:, 0] = np.where(at[:, 0] < start[doc[on]], np.where(at[:, 0] == start[doc[on]] - 1, np.int32(i), far), new[:, 0])
        new = np.where(ok, new, far)
        new = np.where(at == start[doc[on]][:, None] - 1, np.int32(i), new)
        new = np.minimum.accumulate(new - lane, axis=1) + lane  # the document has bytes more
        new = np.where(ok, np.minimum(new, far), far)
        d[on] = new
        done = on[length[on] == i]
        if len(done):
            j = d[done].argmin(1)
            best[done], where[done] = d[done, j], low[done] + i + j
    return best, where


def matches(ix: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document's place, item's place, edits, end in bytes) of the verified occurrences in some documents."""
    t, at = fold(data)
    edge = np.searchsorted(at, offsets)
    doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(edge))
    found = candidates(ix, t, doc_of, edge[:-1]) if len(t) >= Q and len(ix.ids) else np.zeros((0, 3), np.int64)
    out = set()
    for c in range(0, len(found), 256):
        part = found[c : c + 256]
        edits, end = align(ix, t, edge[:-1], edge[1:], part)
        for (d, i, _), e, z in zip(part.tolist(), edits.tolist(), end.tolist(), strict=True):
            if e <= ix.budget[i]:
                last = at[edge[d] + z - 1] + 1 if z else offsets[d]
                out.add((d, i, e, int(last - offsets[d])))
    return sorted(out)


def contaminations(docs: DataFrame, benchmark: DataFrame, *, rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, item_id, edits, n_places, end: a row for each document and item that stands in it.

    An item stands where some stretch of the text is within rate * length edits of it (bytes; A-Z as a-z, runs of
    blanks as one). edits is the least of all places, end the byte of the text behind the first of those. Null and
    empty texts hold nothing; null and short (under Q bytes) items stand nowhere. Rows that share an id count together.
    Repeated rows of the benchmark count once. It goes out in blocks of bounded size, so it may grow; documents are never
    shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.octet_length("text") >= Q)
    items = written(items.distinct(), "items")  # else copies of a row would share a block
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("end", pa.int64())])
    parts = []
    for i in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        sent = spark.sparkContext.broadcast(vars(build_index([(r["item_id"], r["text"]) for r in mine.toLocalIterator()], rate=rate)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ix = Index(**sent.value)
            for b in batches:
                ids, rows = b.column(0).to_pylist(), []
                for first, _, data, offsets in text_chunks(b.column(1)):
                    rows += [(ids[first + d], ix.ids[x], e, z) for d, x, e, z in matches(ix, data, offsets)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, edits int, end long")
        parts.append(part if blocks == 1 else written(part, "leaks"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    least = F.min(F.struct("edits", "end"))
    return found.groupBy("doc_id", "item_id").agg(least["edits"].alias("edits"), F.count("*").alias("n_places"), least["end"].alias("end"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, rate: float = EDIT_RATE, by_row: bool = False) -> DataFrame:
    """docs without the documents in which an item stands. Rows that share an id go together and rows with a null id stay;
    by_row judges each row by its own text, whatever its id."""
    keyed = row_keys(docs)[0] if by_row else docs.withColumn(ROW, F.col("doc_id"))
    bad = contaminations(keyed.select(F.col(ROW).alias("doc_id"), "text"), benchmark, rate=rate).select(F.col("doc_id").alias("__id")).distinct()
    bad = written(bad, "leaky-ids")  # so that Spark knows its size when it chooses the join
    return keyed.join(bad, keyed[ROW] == bad["__id"], "left_anti").select(*docs.columns)
