"""SimHash near-duplicates by deletion variants: halves that differ by one bit at most meet in an equality join."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, looked_up, small_batches, text_bytes, width
from .graph import components

#: Bits that two linked fingerprints may differ by. Of two halves one then differs by one bit at most.
DISTANCE = 2
N, SEED = 3, 42
#: Fingerprints of one index key that a task compares; those of larger groups go through `wide_variants`.
GROUP = 16_384
#: Fingerprints of one variant that are compared pair by pair in a task; a longer run is sorted under two wildcards instead.
RUN = 1024
#: Rows of the index that one numpy step handles, about.
STEP = 1 << 16
#: Bytes of a long text that are cut into words at once.
PIECE = 1 << 22

_ONE = np.uint64(1)
_BLANK = re.compile(rb"[ \t-\r]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in pieces, so that a very long text is never held as one list."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE)
        end = blank.start() if blank else len(text)
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, n: int = N) -> int:
    """64 bits; bit k is 1 if it is in more than half of the hashes of the text's n-word shingles, repeats included."""
    ones, total, last = np.zeros(64, np.int64), 0, []
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    for words in _pieces(text.lower()):  # of bytes, lower() turns A-Z only and split() cuts at ASCII blanks only
        words = last + words
        if len(words) >= n:
            hashes = np.fromiter(map(digest, map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))), np.uint64, len(words) - n + 1)
            total += len(hashes)
            for k in range(0, len(hashes), STEP):
                ones += np.unpackbits(hashes[k : k + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        last = words[-(n - 1) :] if n > 1 else []
    if not total:
        return digest(b" ".join(last)) if last else 0
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > total))


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, print: the fingerprint as a signed long) of each row. A null text counts as empty; without words it is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            prints = np.fromiter((fingerprint(data[x:y].tobytes(), n) for x, y in pairwise(offsets)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, print long")


def index_keys(prints: DataFrame) -> DataFrame:
    """(key, print): each print under 8 keys, one for each byte of its two halves: the byte's place and the half without it.

    The one-wildcard variants of a half whose wildcard is in that byte stay together under this key, so that a row is
    shuffled for each byte and the task that gets it makes the variants of the byte's 8 bits.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("at")
    half = F.expr("shiftrightunsigned(print, cast(at div 4 as int) * 32) & 4294967295L")
    key = F.expr("shiftleft(cast(at as bigint), 32)").bitwiseOR(half.bitwiseAND(F.expr("~shiftleft(255L, cast(at % 4 as int) * 8)")))
    return prints.select("print", at).select(key.alias("key"), "print")


def _close(prints: np.ndarray, order: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose prints differ by DISTANCE bits at most, within the runs of `order` that stop at `ends`."""
    i, d, sorted_ = np.arange(len(order)), 1, prints[order]
    while (i := i[i + d < ends[i]]).size:
        hit = np.bitwise_count(sorted_[i] ^ sorted_[i + d]) <= DISTANCE
        yield order[i[hit]], order[i[hit] + d]
        d += 1


def _same(prints: np.ndarray, at: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours among the places `at` whose prints are equal under the mask."""
    under = prints[at] & mask
    order = np.argsort(under, kind="stable")
    hit = np.flatnonzero(under[order][1:] == under[order][:-1])
    return at[order[hit]], at[order[hit + 1]]


def _long_run(prints: np.ndarray, at: np.ndarray, bit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that connect what _close would pair in one long run (a half without `bit` is equal), without comparing all:
    prints that are equal but for the wildcard and one bit of the other half, or for two bits of the other half."""
    other = range(32, 64) if bit < 32 else range(32)
    for j in other:
        yield _same(prints, at, ~(_ONE << np.uint64(bit) | _ONE << np.uint64(j)))
    if bit % 32 == 0:  # two bits of the other half: the same for each wildcard of the half, so once
        for j, k in combinations(other, 2):
            yield _same(prints, at, ~(_ONE << np.uint64(j) | _ONE << np.uint64(k)))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the pairs (a, b) connect it to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        while (up := new[new]).tobytes() != new.tobytes():
            new = up
        if (new == root).all():
            return root
        root = new


def links_of(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect what is within DISTANCE bits among prints of whole keys: a star for each component."""
    found = []
    shift = ((keys >> 32) & 7) * 8  # of the byte, as half 0 has bytes 0 to 3
    byte = (prints >> shift.astype(np.uint64)).astype(np.int64) & 255
    for t in range(8):
        variant = keys << 8 | byte & ~(1 << t)
        order = np.argsort(variant, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], variant[order][1:] != variant[order][:-1]]))
        sizes = np.diff(np.append(starts, len(order)))
        ends = np.repeat(starts + np.where(sizes > RUN, 0, sizes), sizes)  # a long run has no pairs here
        found += _close(prints, order, ends)
        for s, size in zip(starts[sizes > RUN], sizes[sizes > RUN], strict=True):
            at = order[s : s + size]
            found += _long_run(prints, at, int(shift[at[0]]) + t)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # A print stands under several keys; places of equal prints are one node.
    nodes, place = np.unique(prints, return_inverse=True)
    root = forest(len(nodes), place[np.concatenate([x for x, _ in found])], place[np.concatenate([y for _, y in found])])
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def linked_in_tasks(rows: DataFrame) -> DataFrame:
    """Links (u, v) among the rows (key, print) of each key; a task gets whole keys in order and holds a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, held = [], [], 0

        def settled(final: bool) -> Iterator[pa.RecordBatch]:
            k, p = np.concatenate(keys), np.concatenate(prints)
            end = len(k) if final else int(np.searchsorted(k, k[-1]))  # the last key may go on
            u, v = links_of(k[:end], p[:end].view(np.uint64))
            keys[:], prints[:] = [k[end:]], [p[end:]]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            keys.append(b.column(0).to_numpy())
            prints.append(b.column(1).to_numpy())
            held += b.num_rows
            if held >= STEP:
                yield from settled(False)
                held = len(keys[0])
        if held:
            yield from settled(True)

    return rows.repartition(width(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def wide_variants(rows: DataFrame) -> DataFrame:
    """Links (u, v) among rows (key, print) of keys that are too large for a task: by two wildcards, one in the key's byte and
    one in the other half, or both in the other half. At most four prints are equal but for two bits, so no group is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, prints = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for byte in range(8):
                mine = prints[(keys >> 32) == byte]
                other = range(32, 64) if byte < 4 else range(32)
                pairs = [(i, j) for i in range(8 * byte, 8 * byte + 8) for j in other] + (list(combinations(other, 2)) if byte % 4 == 0 else [])
                for i, j in pairs if len(mine) else []:
                    masked = mine & ~(_ONE << np.uint64(i) | _ONE << np.uint64(j))
                    wild = pa.array(np.full(len(mine), min(i, j) << 6 | max(i, j), np.int32))
                    yield pa.RecordBatch.from_arrays([wild, pa.array(masked.view(np.int64)), pa.array(mine.view(np.int64))], names=["wild", "masked", "print"])

    made = rows.mapInArrow(run, "wild int, masked long, print long").groupBy("wild", "masked").agg(F.collect_set("print").alias("prints"))
    return made.where("size(prints) > 1").select(F.explode("prints").alias("u"), F.array_min("prints").alias("v")).where("u <> v").distinct()


def simhash_groups(docs: DataFrame, *, n: int = N) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies) of each row of docs: groups of documents whose fingerprints are linked
    by steps of DISTANCE bits or fewer; n_copies counts the rows of the same fingerprint.

    Null and wordless texts have fingerprint 0 and are linked like any other. component_id is the smallest doc_id that is
    reachable; rows with a null id take part but lend no id, and repeated ids count row by row. Other columns of docs are not
    read; an empty table gives no rows. Equal fingerprints are one from the start. The others meet where a half of them is
    equal but for a wildcard bit, and are verified by their bits; the links of a task are reduced to a star for each
    component, so a large group gives rows by its members, not by their pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "simhash")
    rows = scratch.written(fingerprints(docs, n), "rows")
    prints = scratch.written(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "prints")

    keyed = index_keys(prints)
    large = scratch.written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"), "large")
    if large.isEmpty():
        links = linked_in_tasks(keyed)
    else:
        links = linked_in_tasks(keyed.join(large, "key", "left_anti")).unionByName(wide_variants(keyed.join(large, "key", "left_semi")))
    parts = components(scratch.written(links, "links"))

    member = scratch.written(prints.join(parts, prints["print"] == parts["node"]).select("print", "least", "component"), "members")
    named = scratch.written(member.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("__n")), "named")
    found = looked_up(member.select("print", "component"), named, ["component"], member.count()).select("print", "component_id")
    groups = prints.join(found, "print", "left").select("print", F.coalesce("component_id", "least").alias("component_id"), "n_copies", F.col("n_copies").alias("__n"))
    groups = scratch.written(groups, "groups")
    scratch.drop("prints", "large", "links", "members", "named")
    out = looked_up(rows, groups, ["print"], rows.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "n_copies")
