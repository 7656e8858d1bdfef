"""Exact n-gram Jaccard join: a blocked sparse product of documents by n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, Scratch, filter_places, held, key_filter, looked_up, mix, row_keys, small_batches, text_chunks
from .graph import components

N, PERCENT = 5, 75
#: Counters of shingle frequency: 2**SKETCH_BITS.
SKETCH_BITS = 17
#: A shingle of more postings than this, and than 4 times the mean counter, is dealt over several partial buckets.
HOT = 20_000
#: Bytes of a long document that are hashed at once.
PIECE = 1 << 20
#: Into how many buckets a shingle is dealt, at most, and what mixes the number into a bucket's name.
SALTS, MIX = 1000, 0x1D8E4E27C47D
#: Sets of more shingles than this are multiplied in 2**BLOCK_BITS blocks of shingles, so that no row holds a long set.
WHOLE, BLOCK_BITS = 2048, 6
#: Rows of one size band of a shingle that a task compares with each other, about.
CELL = 2000
#: Stands for a null id inside.
NO_ID = -(1 << 63)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))
_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word and the document that it is in."""
    t = _FOLD[data]
    blank = _BLANK[t]
    first, last = np.ones(len(t), bool), np.ones(len(t), bool)
    first[1:], last[:-1] = blank[:-1], blank[1:]
    inner = offsets[(offsets > 0) & (offsets < len(t))]
    first[inner], last[inner - 1] = True, True
    start, end = np.flatnonzero(~blank & first), np.flatnonzero(~blank & last) + 1
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOL[t] * _powers(_BASE, len(t)))])
    word = mix((run[end] - run[start]) * _powers(_UNBASE, len(t) + 1)[start] + (end - start).astype(np.uint64) * _K1)
    return word, np.searchsorted(offsets, start, "right") - 1


def _words_of_long(data: np.ndarray) -> np.ndarray:
    """The word hashes of one long document, piece by piece between blanks, in memory of a few times its words."""
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not (blanks := np.flatnonzero(_BLANK[data[at:end]])).size:
            end += PIECE
        end = len(data) if end >= len(data) else at + int(blanks[-1]) + 1
        parts.append(_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(parts)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """For each document the sorted 64-bit hashes of its distinct n-word shingles; of all its words, if it has fewer."""
    count = len(offsets) - 1
    if count == 1 and len(data) > PIECE:
        word = _words_of_long(data)
        doc = np.zeros(len(word), np.int64)
    else:
        word, doc = _words(data, offsets)
    words = np.bincount(doc, minlength=count)
    begin = np.concatenate([[0], np.cumsum(words)])
    full = word[: max(len(word) - n + 1, 0)].copy()
    for k in range(1, n):
        full = full * _K2 + word[k : k + len(full)]
    full = mix(full)
    out = []
    for d in range(count):
        w = int(words[d])
        if w >= n:
            out.append(np.unique(full[begin[d] : begin[d] + w - n + 1]))
        elif w:
            h = np.uint64(w)
            with np.errstate(over="ignore"):
                for x in word[begin[d] : begin[d] + w]:
                    h = h * _K2 + x
            out.append(mix(np.array([h ^ _K1])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _print(s: np.ndarray, key: np.uint64) -> int:
    return int(mix(s ^ key).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0


def _marks(s: np.ndarray) -> bytes:
    """A bitmap of at least twice as many bits as s has shingles: bit (shingle mod size) for each."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    on = np.zeros(bits, bool)
    on[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Shingles that stand in one of two sets only, at least: bits of one bitmap only, the larger folded to the smaller."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _node(s: np.ndarray, twice: set) -> int:
    """A set's name: the first half of its print, or the second where another set has the same first."""
    node = _print(s, _K1)
    return _print(s, _K2) if node in twice else node


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


class Seen:
    """Prints that a task has met, so that copies give postings once a task; it may forget, which costs repeats only."""

    def __init__(self, most: int = 200_000) -> None:
        self.most, self.prints = most, set()

    def new(self, x: int) -> bool:
        if x in self.prints:
            return False
        if len(self.prints) >= self.most:
            self.prints.clear()
        self.prints.add(x)
        return True


def facts(docs: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, f1, f2, marks) for each document: n its set's size, f1 and f2 a 128-bit print of the set, marks a
    bitmap of it; and how often the shingles of each counter stand in all documents. The counters are summed by Spark;
    2**SKETCH_BITS numbers arrive."""
    schema = pa.schema([("counter", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("marks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << SKETCH_BITS, np.int64), Seen()
        for b in batches:
            size, f1, f2, marks = [], [], [], []
            for _, _, data, offsets in text_chunks(b.column(1)):
                sets = shingle_sets(data, offsets, n)
                size += map(len, sets)
                mine = [_print(s, _K1) for s in sets]
                f1 += mine
                f2 += [_print(s, _K2) for s in sets]
                marks += map(_marks, sets)
                new = [s for s, x in zip(sets, mine, strict=True) if seen.new(x)]
                if new:
                    total += np.bincount(_counter(np.concatenate(new)), minlength=1 << SKETCH_BITS)
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(size), pa.bool_()), b.column(0), *(pa.array(x, pa.int64()) for x in (size, f1, f2)), pa.array(marks, pa.binary())], schema=schema)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([True] * len(used), pa.bool_()), pa.array(used, pa.int64()), pa.array(total[used], pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary())], schema=schema)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "counter boolean, doc_id long, n long, f1 long, f2 long, marks binary")
    made = scratch.written(made, "facts")
    sums = made.where("counter").groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[sums["doc_id"].to_numpy()] = sums["n"].to_numpy()
    return made.where("NOT counter").drop("counter"), sketch


def postings(docs: DataFrame, n: int, percent: int, sketch, doubled) -> DataFrame:
    """(bucket, node, info) for each shingle of each set's prefix: its shingles in order of (counter, hash), rare ones first.

    Sets that overlap by percent share a shingle of their first n - ceil(percent n / 100) + 1. Any order that is the same
    for all sets gives this; the counters only keep common shingles out of prefixes. A set is named by its print, so
    copies are one node. info packs the set's size, the shingle's place and, for a very common shingle, a salt from 1
    on by node, which is mixed into the bucket: such a shingle is dealt over many buckets.
    """
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("info", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, twice = sketch.value, doubled.value
        hot, seen = max(HOT, 4 * int(counts.mean())), Seen()
        for b in batches:
            for _, _, data, offsets in text_chunks(b.column(0)):
                parts = []
                for s in shingle_sets(data, offsets, n):
                    node = _node(s, twice)
                    if not len(s) or not seen.new(node):
                        continue
                    size, c = len(s), counts[_counter(s)]
                    p = size - (percent * size + 99) // 100 + 1
                    order = np.lexsort((s, c))[:p]
                    salts = np.minimum(-(-c[order] // hot), SALTS)
                    salt = np.where(salts > 1, 1 + (node % (1 << 31)) % np.maximum(salts, 1), 0)
                    parts.append((s[order].view(np.int64) ^ (salt * MIX), np.full(p, node), (size << 36) | (np.arange(p) << 10) | salt))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)], schema=schema)

    return docs.select("text").mapInArrow(run, "bucket long, node long, info long")


def unpacked(rows: DataFrame) -> DataFrame:
    """(shingle, salt, x: (node, n, pos)) of postings."""
    salt = F.col("info").bitwiseAND(1023)
    n, pos = F.shiftright("info", 36).cast("int"), F.shiftright("info", 10).bitwiseAND((1 << 26) - 1).cast("int")
    return rows.withColumns({"salt": salt, "shingle": F.col("bucket").bitwiseXOR(salt * F.lit(MIX)), "x": F.struct("node", n.alias("n"), pos.alias("pos"))})


def _need(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of two sets of sizes a and b that reaches percent."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - 1e-9)


def _fits(na: Column, ia: Column, nb: Column, ib: Column, percent: int) -> Column:
    """Whether sizes and the places of a shared shingle leave room for the least overlap, if it is the first shared one."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - ia, nb - ib) >= _need(na, nb, percent))


def _pairs(rows: DataFrame) -> DataFrame:
    """Rows (x, y: structs of node, n, pos) as (a, na, ia, b, nb, ib) with a below b."""
    a, b = F.least("x", "y"), F.greatest("x", "y")
    rows = rows.where(F.col("x.node") != F.col("y.node")).select(a.alias("l"), b.alias("h"))
    return rows.select(F.col("l.node").alias("a"), F.col("l.n").alias("na"), F.col("l.pos").alias("ia"), F.col("h.node").alias("b"), F.col("h.n").alias("nb"), F.col("h.pos").alias("ib"))


def _bounded(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): the pairs of rows (a, na, ia, b, nb, ib: a shared shingle at places ia and ib) that size allows.

    Overlap counts accumulate by pair; what follows the last counted place bounds the rest. Both bounds are exact: they
    discard no pair that reaches percent.
    """
    na, nb, ia, ib = (F.col(c) for c in ("na", "nb", "ia", "ib"))
    summed = rows.where(_fits(na, ia, nb, ib, percent)).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    return summed.where(F.col("c") + F.least(na - ia - 1, nb - ib - 1) >= _need(na, nb, percent)).select("a", "b", "na", "nb")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, percent: int, doubled) -> DataFrame:
    """(node, block, set) for wanted (node, doc_id), and maybe others: the rows of the incidence matrix, cut into blocks of
    shingles. Block -1 is a whole set; a long set has blocks by the top bits of its shingles, and sets whose partner may
    be on the other side of `WHOLE` have both. The texts are read again but not shuffled: a filter of bounded size
    keeps most other documents from giving rows; what it lets through meets no pair later. The filter is asked where the
    sets are made, so a task has one Python worker."""
    names = ["node", "block", "set"]
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = doubled.value
        for b in batches:
            texts = b.column(0).filter(pa.array(held(sent.value, b.column(1), b.column(2))))
            for _, _, data, offsets in text_chunks(texts):
                nodes, blocks, parts = [], [], []
                for s in shingle_sets(data, offsets, n):
                    node = _node(s, twice)
                    if len(s) <= WHOLE:
                        nodes.append(node), blocks.append(-1), parts.append(s)
                    if 100 * len(s) > percent * WHOLE:
                        at = np.searchsorted(s >> np.uint64(64 - BLOCK_BITS), np.arange((1 << BLOCK_BITS) + 1, dtype=np.uint64))
                        nodes += [node] * (1 << BLOCK_BITS)
                        blocks += range(1 << BLOCK_BITS)
                        parts += [s[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blocks, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=names)

    return docs.select("text", *filter_places("doc_id")).mapInArrow(run, "node long, block int, set array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap by percent: the entries of the product of the incidence matrix with its transpose
    at the pairs, their counts accumulated block by block."""
    longest = F.greatest("na", "nb")
    blocks = F.when(longest > WHOLE, F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1))).otherwise(F.array(F.lit(-1)))
    one, two = (sets.select(F.col("node").alias(c), "block", F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.withColumn("block", F.explode(blocks)).join(one, ["a", "block"]).join(two, ["b", "block"])
    counted = both.select("a", "b", "na", "nb", F.size(F.array_intersect("set_a", "set_b")).alias("c")).groupBy("a", "b").agg(F.sum("c").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return counted.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _sifted(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps do not prove that they overlap too little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(k).to_numpy() for k in (2, 3))
            apart = np.array([_apart(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], dtype=np.int64)
            most = (na + nb - apart) // 2
            yield b.select([0, 1, 2, 3]).filter(pa.array(100 * most >= percent * (na + nb - most)))

    one, two = (nodes.select(F.col("node").alias(c), F.col("marks").alias(f"marks_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "marks_a", "marks_b")
    return both.mapInArrow(run, "a long, b long, na int, nb int")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, percent: int, doubled, scratch: Scratch, turn: str) -> DataFrame:
    """The links (u, v) among pairs, as a written table."""
    left = scratch.written(_sifted(pairs, nodes, percent), f"sifted-{turn}")
    if left.isEmpty():
        return left.select(F.col("a").alias("u"), F.col("b").alias("v"))
    wanted = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "doc_id")
    sets = scratch.written(sets_of(docs, wanted, n, percent, doubled), f"sets-{turn}")
    links = scratch.written(linked(left, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), f"links-{turn}")
    scratch.drop(f"sifted-{turn}", f"sets-{turn}")
    return links


def across(rest: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(x, y) for rows of rest (shingle, component, x: node, n, pos) of one shingle and two components, where sizes and
    places leave room for the least overlap.

    Sets that can link are of one size band or of neighbouring ones (a band is a factor of 100 / percent), so only those
    meet. The rows of a band of a shingle, if they are more than `CELL`, are dealt into g parts and meet in g * g cells:
    no task compares more than a cell's rows, and no pair is made twice.
    """
    band = F.floor(F.log(F.col("x.n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rest = scratch.written(rest.withColumn("band", band), "rest")
    sizes = rest.groupBy("shingle", "band").agg(F.count("*").alias("n"))
    large = sizes.select("shingle", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "n").groupBy("shingle", "band").agg(F.sum("n").alias("n"))
    large = scratch.written(large.where(F.col("n") > CELL).select("shingle", "band", F.ceil(F.col("n") / CELL).cast("int").alias("g"), F.col("n").alias("__n")), "cells")
    # Bands a factor of 100 / percent apart at most, with room for rounding at the edges of a band.
    sides = rest.withColumns({"own": F.col("band"), "band": F.explode(F.array("band", F.col("band") - 1))})
    if large.isEmpty():
        sides = sides.withColumn("g", F.lit(1))
    else:
        sides = scratch.written(sides, "sides")
        sides = looked_up(sides, large, ["shingle", "band"], sides.count(), "left").withColumn("g", F.coalesce("g", F.lit(1)))
    part, every = F.pmod(F.xxhash64("x.node"), F.col("g")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    one = sides.where("own = band").select("shingle", "band", part.alias("i"), every.alias("j"), F.col("component").alias("cx"), "x")
    two = sides.select("shingle", "band", part.alias("j"), every.alias("i"), F.col("component").alias("cy"), F.col("x").alias("y"), "own")
    once = F.when(F.col("own") == F.col("band"), F.col("cx") < F.col("cy")).otherwise(F.col("cx") != F.col("cy"))
    return one.join(two, ["shingle", "band", "i", "j"]).where(once & _fits(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)).select("x", "y")


def near_duplicates(docs: DataFrame, *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies for every row of docs: groups of documents linked by shingle overlap.

    Two documents link when 100 * intersection >= percent * union of their sets; component_id is the smallest doc_id
    reachable. Null and wordless texts have the empty set and stand alone. Rows with a null id take part, but lend no
    id. Equal sets are one node from the start (n_copies counts its rows). Other columns of docs are not read.

    First every set is held against the most central set of each of its buckets (a star, so a group of copies gives as
    many pairs as members, not their square); then, only between what those links left apart, all pairs of a bucket
    that the bounds allow. Pairs inside a component can add nothing and are never made.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    known, sketch = facts(docs, n, scratch)
    clash = known.where("n > 0").groupBy("f1").agg(F.min("f2").alias("x"), F.max("f2").alias("y")).where("x <> y")
    doubled = {r["f1"] for r in clash.toLocalIterator()}  # 64-bit prints that two sets share: none below a billion sets
    node = F.when(F.col("f1").isin(list(doubled)), F.col("f2")).otherwise(F.col("f1")) if doubled else F.col("f1")
    known = known.withColumn("node", node)
    nodes = scratch.written(known.where("n > 0").groupBy("node").agg(F.coalesce(F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))), F.lit(NO_ID)).alias("doc_id"), F.count("*").alias("copies"), F.first("marks").alias("marks")), "nodes")
    known = scratch.written(known.select("doc_id", "n", "node"), "rows")
    scratch.drop("facts")

    sc = spark.sparkContext
    twice = sc.broadcast(doubled)
    made = postings(docs, n, percent, sc.broadcast(sketch), twice)
    bucket = Window.partitionBy("bucket")
    made = made.withColumns({"low": F.min("node").over(bucket), "high": F.max("node").over(bucket), "mid": F.min(F.struct(F.shiftright("info", 10).bitwiseAND((1 << 26) - 1).alias("pos"), "node", "info")).over(bucket)})
    kept = scratch.written(made.where("low <> high OR info & 1023 > 0").select("bucket", "node", "info", F.col("mid.node").alias("mid"), F.col("mid.info").alias("mid_info")), "buckets")

    members = unpacked(kept).select("shingle", "salt", "x", F.struct(F.col("mid").alias("node"), F.shiftright("mid_info", 36).cast("int").alias("n"), F.shiftright("mid_info", 10).bitwiseAND((1 << 26) - 1).cast("int").alias("pos")).alias("y"))
    heads = members.where("salt > 0").select("shingle", "y").distinct()
    tops = heads.groupBy("shingle").agg(F.min(F.struct("y.pos", "y.node", "y.n")).alias("top"))
    heads = heads.join(tops, "shingle").select(F.col("y").alias("x"), F.struct("top.node", "top.n", "top.pos").alias("y"))
    members = members.select("x", "y")
    stars = scratch.written(_bounded(_pairs(members.unionByName(heads)), percent), "stars")
    links = _verified(docs, stars, nodes, n, percent, twice, scratch, "one")

    parts = components(links)
    labelled = unpacked(kept).select("shingle", "node", "x").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).distinct()
    labelled = scratch.written(labelled.select("shingle", "component", "x"), "labelled")
    scratch.drop("buckets")
    apart = labelled.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("__n")).where("lo <> hi").select("shingle", "__n")
    rest = looked_up(labelled, scratch.written(apart, "apart"), ["shingle"], labelled.count())
    found = _bounded(_pairs(across(rest, percent, scratch)), percent)
    found = scratch.written(found.join(stars.select("a", "b"), ["a", "b"], "left_anti"), "across")
    scratch.drop("labelled", "apart", "rest", "cells", "sides", "stars")
    if not found.isEmpty():
        links = links.unionByName(_verified(docs, found, nodes, n, percent, twice, scratch, "two"))
        parts = components(links)

    # Only nodes with a link need another id than their own.
    member = scratch.written(nodes.select("node", "doc_id").join(parts, "node"), "members")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    least = scratch.written(member.groupBy("component").agg(F.min(real("doc_id")).alias("least"), F.count("*").alias("__n")), "least")
    named = looked_up(member.select("node", "component"), least, ["component"], member.count()).select("node", "least")
    named = nodes.select("node", "doc_id", "copies").join(named, "node", "left").select("node", F.coalesce("least", real("doc_id")).alias("component_id"), "copies", F.col("copies").alias("__n"))
    named = scratch.written(named, "named")
    scratch.drop("nodes", "members", "least", "across", "links-one", "links-two")
    some = scratch.written(known.where("n > 0"), "some")
    out = looked_up(some, named, ["node"], some.count()).unionByName(known.where("n = 0").withColumns({"component_id": real("doc_id"), "copies": F.lit(1).cast("long")}))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("copies").alias("n_copies"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id. A row without an id comes after those
    with one; of rows that share it, or have none, one stays. Columns stay as they are."""
    keyed, unique = row_keys(docs)
    scratch = Scratch(docs.sparkSession, "jaccard-one")
    groups = scratch.written(near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("__id"), "component_id"), "groups")
    gone = groups.where("__id <> component_id").select("__id")
    if not unique:  # the smallest row number is not that of the smallest id
        ranks = keyed.select(F.col(ROW), F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.xxhash64("text"), F.col(ROW)).alias("__rank"))
        best = groups.join(ranks, groups["__id"] == ranks[ROW]).groupBy("component_id").agg(F.min("__rank").alias("__rank"))
        gone = groups.select("__id").join(best.select(F.col(f"__rank.{ROW}").alias("__id")), "__id", "left_anti")
    gone = scratch.written(gone, "gone")
    scratch.drop("groups")
    return keyed.join(gone, keyed[ROW] == gone["__id"], "left_anti").select(*docs.columns)
