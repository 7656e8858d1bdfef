"""Alignment of the tokens of two tokenizers over the same bytes, by elementary intervals."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

FILES, BYTE_LEVEL, PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are encoded and aligned at once; a longer text is handled alone.
CHUNK = 1 << 18
#: Links that are expanded at once; a group of more is expanded by its distinct ids.
EXPANDED = 1 << 20
#: Distinct id pairs whose counts a task holds before it hands them on, and of one row of them.
HELD, ROW_PAIRS = 1 << 19, 1 << 14
#: Id pairs, those of the most documents, whose counts go to all tasks; the others meet their links by a shuffle.
SENT = 1 << 21

#: Segments, and characters of them, that a worker remembers before it starts anew.
KNOWN, KNOWN_CHARS = 1 << 18, 1 << 23
#: What may be or join white space for one encoder or another; a text is cut at no space beside it.
_ODD = r"\s\x00-\x1f\x7f-\xa0\u180e\u200b-\u200f\u2028-\u202f\u205f-\u206f\u2581\ufeff"
PROBE = " two  spaces, a ligature \ufb01, e\u0301 and a blank "
CUT = re.compile(f"(?<=[^{_ODD}]) (?=[^{_ODD}])")
WHOLE = re.compile(f"(?=[^{_ODD}]).*[^{_ODD}]", re.DOTALL)

_CODES = pa.schema([("counts", pa.bool_()), ("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, model: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        # A space goes with the word behind it, so that no token reaches over a single space between words.
        self.cuts = json.loads(model)["pre_tokenizer"].get("type") == "ByteLevel" and not any(CUT.search(x.decode(errors="replace")) for x in self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model with byte fallback; it puts a space before the text itself."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # Merges stay between spaces where no piece has one behind another character, and nothing rewrites the text.
        self.cuts = not any("▁" in p.lstrip("▁") for p in names) and self.model.decode(self.model.encode(PROBE)) == PROBE
        self.bytes = [bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for p in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Aligns texts under two encoders; made once in each Python worker.

    A text is cut at single spaces between other characters (`CUT`). No token of either encoder reaches over such a cut, so both
    have an end there and groups do not cross it; what stands between two cuts is encoded and aligned once and remembered.
    """

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b
        self.length_a, self.length_b = (np.array([len(x) for x in e.bytes], np.int64) for e in (a, b))
        self.width = len(b.bytes)
        self.span = len(a.bytes) * self.width
        # What a token adds to the text of groups: its id and what stands behind it.
        self.text = [f"{i}{sep}".encode() for e, seps in ((a, ",|"), (b, ",;")) for sep in seps for i in range(len(e.bytes))]
        self.length_text = np.array([len(x) for x in self.text], np.int64)
        self.cuts = a.cuts and b.cuts
        self.forget()

    def forget(self) -> None:
        self.place, self.chars, self.groups = {}, 0, []
        self.good, self.numbers = np.zeros(0, bool), np.zeros((0, 4), np.int64)
        self.ends, self.pair, self.times = (np.zeros(0, np.int64) for _ in range(3))

    def learn(self, segments: list[str]) -> None:
        """Remembers segments; those that may stand between two cuts are encoded as one text."""
        plain = [s for s in segments if self.cuts and WHOLE.fullmatch(s)]
        rest = segments if not plain else [s for s in segments if not WHOLE.fullmatch(s)]
        for some, joined in ((plain, True), (rest, False)):
            for x, y in chunks(some):
                good, numbers, groups, link, times = self.align(some[x:y], joined)
                self.place.update(zip(some[x:y], range(len(self.groups), len(self.groups) + y - x), strict=True))
                self.groups += groups
                ends = np.cumsum(np.bincount(link // self.span, minlength=y - x)) + len(self.pair)
                self.good, self.numbers, self.ends = np.append(self.good, good), np.concatenate([self.numbers, numbers]), np.append(self.ends, ends)
                self.pair, self.times = np.append(self.pair, link % self.span), np.append(self.times, times)
        self.chars += sum(map(len, segments))

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(numbers: a row of n_a, n_b, n_groups, n_links for each text; the digests of groups; and the links, each distinct
        one once for each text: place of the text, id pair (a * width + b), times it is there)."""
        parts = [(CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        if len(self.place) > KNOWN or self.chars > KNOWN_CHARS:
            self.forget()
        self.learn(list(dict.fromkeys(s for s in flat if s not in self.place)))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum([len(p) for p in parts])
        doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        good = np.array([bool(t) for t in texts])
        good[doc[~self.good[at]]] = False
        numbers = np.stack([np.bincount(doc, self.numbers[at, k], len(texts)) for k in range(4)], axis=1).astype(np.int64) * good[:, None]
        digests = [hashlib.sha256(b";".join(map(self.groups.__getitem__, at[x:y].tolist()))).hexdigest() if g else "" for g, (x, y) in zip(good, pairwise([0, *ends.tolist()]), strict=True)]
        # Segments of a text with how often they stand there, then their links.
        key, n = np.unique((doc * len(self.groups) + at)[good[doc]], return_counts=True)
        doc, at = key // max(len(self.groups), 1), key % max(len(self.groups), 1)
        size = np.diff(self.ends, prepend=0)[at]
        link = np.repeat(self.ends[at] - np.cumsum(size), size) + np.arange(size.sum())
        key, times = summed([(np.repeat(doc, size) * self.span + self.pair[link], np.repeat(n, size) * self.times[link])])
        return numbers, digests, key // self.span, key % self.span, times

    def encoded(self, texts: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the places of the texts that both encoders give back; the tokens of those, of A and of B; where the bytes of each end)."""
        if joined:
            text = " ".join(texts)
            a, b = (e.encode([text])[0] for e in (self.a, self.b))
            if b"".join(map(self.a.bytes.__getitem__, a)) == b"".join(map(self.b.bytes.__getitem__, b)) == b" " + text.encode():
                size = np.array([len(t.encode()) for t in texts])
                return np.arange(len(texts)), np.array(a, np.int64), np.array(b, np.int64), np.cumsum(size + 1)
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        goals = [b" " + t.encode() for t in texts]
        good = [i for i, g in enumerate(goals) if b"".join(map(self.a.bytes.__getitem__, ids_a[i])) == b"".join(map(self.b.bytes.__getitem__, ids_b[i])) == g]
        a, b = (np.fromiter(chain.from_iterable(ids[i] for i in good), np.int64) for ids in (ids_a, ids_b))
        return np.array(good, np.int64), a, b, np.cumsum([len(goals[i]) for i in good])

    def align(self, texts: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(whether both encoders give a text back; n_a, n_b, n_groups, n_links; the text of its groups; and the links, each
        distinct one once for each text, as place of the text * span + id pair, with the times it is there)."""
        good, a, b, last = self.encoded(texts, joined)
        same = np.zeros(len(texts), bool)
        same[good] = True
        numbers, groups = np.zeros((len(texts), 4), np.int64), [b""] * len(texts)
        if not len(good):
            return same, numbers, groups, np.zeros(0, np.int64), np.zeros(0, np.int64)
        # The texts stand one behind the other; where one ends, both have an end.
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        cuts = np.union1d(ends_a, ends_b)  # an elementary interval ends at each cut
        owner_a, owner_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        closes = (ends_a[owner_a] == cuts) & (ends_b[owner_b] == cuts)
        group = np.cumsum(closes) - closes
        group_a, group_b = group[np.searchsorted(cuts, ends_a)], group[np.searchsorted(cuts, ends_b)]
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        doc_a, doc_b = np.searchsorted(last, ends_a), np.searchsorted(last, ends_b)
        count = np.bincount(doc_a, minlength=len(good)) + np.bincount(doc_b, minlength=len(good))
        doc = good[doc_a[np.cumsum(in_a) - in_a]]  # of each group
        numbers[good, 0] = np.bincount(doc_a, minlength=len(good))
        numbers[good, 1] = count - numbers[good, 0]
        numbers[:, 2], numbers[:, 3] = np.bincount(doc, minlength=len(texts)), np.bincount(doc, in_a * in_b, len(texts))

        # Text of groups: a group's tokens of A, then those of B; the last of each has another sign behind it.
        before_b, through_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        code = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        code[np.arange(len(a)) + before_b[group_a]] = a + len(self.length_a) * last_a
        code[np.arange(len(b)) + through_a[group_b]] = b + 2 * len(self.length_a) + self.width * last_b
        text = b"".join(map(self.text.__getitem__, code.tolist()))
        ends = np.cumsum(self.length_text[code])[np.cumsum(count) - 1]
        for i, (x, y) in zip(good.tolist(), pairwise([0, *ends.tolist()]), strict=True):
            groups[i] = text[x : y - 1]
        return same, numbers, groups, *self.links(a, b, in_a, in_b, doc)

    def links(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct links of groups that have in_a and in_b of the tokens a and b, in order, as (doc, a, b) in one number,
        and how often each is there: the product of each group, expanded some groups at a time."""
        from_a, from_b, size = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, in_a * in_b
        parts = []
        base = (doc * len(self.length_a)).astype(np.int64)
        some = np.flatnonzero(size <= EXPANDED)
        for x, y in pairwise(np.unique(np.concatenate([[0, len(some)], np.searchsorted(np.cumsum(size[some]), np.arange(EXPANDED, size[some].sum() + 1, EXPANDED))]))):
            g = some[x:y]
            each = np.repeat(g, size[g])
            at = np.arange(len(each)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
            parts.append(np.unique((base[each] + a[from_a[each] + at // in_b[each]]) * self.width + b[from_b[each] + at % in_b[each]], return_counts=True))
        for g in np.flatnonzero(size > EXPANDED):
            (ua, ca), (ub, cb) = (np.unique(t[s : s + n], return_counts=True) for t, s, n in ((a, from_a[g], in_a[g]), (b, from_b[g], in_b[g])))
            parts.append((((base[g] + ua)[:, None] * self.width + ub).ravel(), (ca[:, None] * cb).ravel()))
        return summed(parts)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of parts (key, n), in order, with the sums of n."""
    key, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about CHUNK characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _steps(pairs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each list of ascending pairs as its first one and the differences, which are stored in fewer bytes."""
    out = np.diff(pairs, prepend=0)
    starts = np.concatenate([[0], ends])[:-1]
    starts = starts[starts < ends]
    out[starts] = pairs[starts]
    return out


def _from_steps(steps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    return total[1:] - np.repeat(total[np.concatenate([[0], ends])[:-1]], np.diff(ends, prepend=0))


def aligned(docs: DataFrame, encoders: Callable) -> DataFrame:
    """A row for each row of docs: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the
    distinct links as pairs (in steps) and times. Rows with `counts` hold id pairs and in how many documents a part of a task has
    them linked, as pairs and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = Aligner(*encoders())
        row, counts, held = TaskContext.get().partitionId() << 33, [], 0

        def handed() -> Iterator[pa.RecordBatch]:
            key, n = summed(counts)
            for k in range(0, len(key), ROW_PAIRS):
                one = [None, None, None, None, None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([True]), *(pa.array([x], f.type) for x, f in zip(one, list(_CODES)[1:8], strict=True)), *(_lists(x[k : k + ROW_PAIRS], [len(x[k : k + ROW_PAIRS])]) for x in (key, n))], schema=_CODES)

        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for x, y in chunks(texts):
                numbers, digests, place, pair, times = aligner.documents([t or "" for t in texts[x:y]])
                ends = np.cumsum(np.bincount(place, minlength=y - x))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(y - x, bool)), pa.array(np.arange(row, row + y - x)), ids.slice(x, y - x), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(digests, pa.string()), _lists(_steps(pair, ends), ends), _lists(times, ends)], schema=_CODES)
                row += y - x
                if len(pair):
                    key, n = np.unique(pair, return_counts=True)
                    counts.append((key, n))
                    held += len(key)
                if held > 2 * HELD:
                    counts[:] = [summed(counts)]
                    held = len(counts[0][0])
                if held > HELD:
                    yield from handed()
                    counts[:], held = [], 0
        if counts:
            yield from handed()

    kind = "counts boolean, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def with_known(rows: DataFrame, pairs: np.ndarray, values: np.ndarray) -> DataFrame:
    """rows with n_best and count_sum over the links whose pair is among `pairs`, in order; the others stay in pairs and times.
    A value is twice the count of a pair's documents, plus 1 if it is the highest of its A id."""
    sent = rows.sparkSession.sparkContext.broadcast((pairs, values))
    names = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = sent.value
        for b in batches:
            ends = np.cumsum(b.column("pairs").value_lengths().to_numpy())
            pair, times = _from_steps(b.column("pairs").flatten().to_numpy(), ends), b.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            v = np.where(hit, value[at] if len(known) else 0, 0)
            sums = [np.diff(np.concatenate([[0], x])[np.concatenate([[0], ends])]) for x in (np.cumsum((v & 1) * times), np.cumsum((v >> 1) * times))]
            left = np.concatenate([[0], np.cumsum(~hit)])[ends]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(_lists(x[~hit], left) for x in (pair, times)), *map(pa.array, sums)], names=[*names, "pairs", "times", "n_best", "count_sum"])

    return rows.select(*names, "pairs", "times").mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes if c in names)}, pairs array<int>, times array<int>, n_best long, count_sum long")


def align_tokens(docs: DataFrame, *, encoders: Callable | None = None, files: str = FILES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs: how the tokens of two
    tokenizers over the same text align.

    A space and the text are cut where a token of either ends; where both end, a group ends too. Links are all pairs of an A
    and a B token of one group, occurrence by occurrence. The count of an id pair is in how many rows of docs it is linked;
    n_best is how many links have the highest count of their A id, ties included, count_sum the sum of the counts of all links.

    Texts that are null, empty or not given back byte for byte by both tokenizers have no tokens: zeros and ''. Null and
    repeated ids are rows of their own; other columns are not read; an empty table gives no rows. `encoders` makes the two
    encoders in a worker (`bytes` of each id, `encode`); without it they are read from two files in `files`, by the driver.

    A task counts the id pairs of its documents before they are shuffled. The SENT pairs of most documents then go to all
    tasks, a bounded number however many there are; the links of rarer pairs, few in each text, meet their counts by a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "align")
    if encoders is None:
        with open(f"{files}/{BYTE_LEVEL}", "rb") as f, open(f"{files}/{PIECES}", "rb") as g:
            models = spark.sparkContext.broadcast((f.read(), g.read()))
        encoders = lambda: (ByteLevel(models.value[0]), Pieces(models.value[1]))
    vocabularies = [len(e.bytes) for e in encoders()]
    width = vocabularies[1]
    if vocabularies[0] * width > 1 << 31:
        raise ValueError("id pairs of these vocabularies do not fit into 31 bits")
    made = scratch.written(aligned(docs, encoders), "aligned")

    some = made.where("counts").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    totals = scratch.written(some.groupBy(F.col("x.pairs").cast("long").alias("pair")).agg(F.sum("x.times").alias("n")), "totals")
    of_a = F.expr(f"pair div {width}")
    most = totals.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the A vocabulary at most
    valued = totals.withColumn("a", of_a).join(F.broadcast(most), "a").select("pair", "n", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    valued = scratch.written(valued, "valued")

    sizes = sorted(valued.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True)  # 64 rows at most
    least, sent = None, 0
    for level, n in sizes:
        if sent + n > SENT:
            break
        least, sent = level, sent + n
    known = valued.where(F.col("n") >= F.lit(1 << least)).select("pair", "value").toArrow().sort_by("pair") if sent else None
    pairs, values = (known[c].to_numpy() for c in ("pair", "value")) if known else (np.zeros(0, np.int64),) * 2
    rows = with_known(made.where("NOT counts").drop("counts"), pairs, values)
    if sent < sum(n for _, n in sizes):
        rows = scratch.written(rows, "rows")
        rare = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").cast("long").alias("pair"), F.col("x.times").alias("times"))
        cold = valued.where(F.col("n") < F.lit(1 << least)) if sent else valued
        met = rare.join(cold, "pair").groupBy("row").agg(F.sum(F.expr("(value & 1) * times")).alias("best"), F.sum(F.expr("shiftright(value, 1) * times")).alias("more"))
        rows = rows.join(met, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    scratch.drop("totals")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
