"""Removal of repeated lines by global hashing of normalised units."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Scratch, looked_up, row_keys, small_batches

#: How a text is cut: into lines, or into the sentences of its lines. A unit keeps what separates it from the next.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*(?:[.!?]+(?:\s+|$)|\n|$|[.!?])", "paragraph": r"(?:[^\n]|\n(?!\n))*(?:\n{2,}|$)"}
#: Units of fewer words are too common by nature to judge by themselves.
MIN_WORDS = 5
#: Words of a stretch of repeated units, at least, for the query: half of a passage of 50 words, whose ends may lie within units.
MIN_RUN = 25
#: Words of a whole line, at least, that goes for the query whatever its neighbours: shorter lines are often common by nature.
MIN_LINE = 15

#: What is told of a unit that goes.
SHOWN = ("start", "end", "kept_doc_id", "kept_start")
_UNIT_SCHEMA = pa.schema([(c, pa.int64()) for c in ("d1", "d2", "doc_id", "row", "start", "end", "seq", "words", "whole")])


def runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of what is judged of consecutive units of so many words: each unit of `least` words or more, and for each
    shorter one the shortest run of `least` words that begins with it and the shortest that ends with it.

    Every unit of a stretch of whole units that has `least` words in all lies in a run inside that stretch, so a repeated
    line, paragraph or passage of short sentences is met as a whole.
    """
    full = [k for k, n in enumerate(words) if n]
    out = set()
    for at, k in enumerate(full):
        if words[k] >= least:
            out.add((k, k))
            continue
        n, z = words[k], at
        while n < least and (z := z + 1) < len(full):
            n += words[full[z]]
        if n >= least:
            out.add((k, full[z]))
        n, z = words[k], at
        while n < least and (z := z - 1) >= 0:
            n += words[full[z]]
        if n >= least:
            out.add((full[z], k))
    return sorted(out)


def whole_lines(found: list[tuple[int, int, list[str]]], text: str, least: int) -> list[tuple[int, int]]:
    """(first, last) of the units with words that make up each line of `least` words or more."""
    out, line, n = [], [], 0
    for k, (start, end, words) in enumerate(found):
        if words:
            line.append(k)
            n += len(words)
        if k + 1 == len(found) or "\n" in text[start:end]:
            if line and n >= least:
                out.append((line[0], line[-1]))
            line, n = [], 0
    return out


def units(docs: DataFrame, *, unit: str = "sentence", min_words: int = MIN_WORDS, join_short: bool = False, min_line: int = 0) -> DataFrame:
    """d1, d2 (a 128-bit digest), doc_id, row, start, end, seq, words, whole of each unit of min_words words or more; with
    join_short also of the runs of units that `runs` joins; with min_line also of each whole line of so many words.

    whole is 1 for a unit that is such a line, 2 for a line of several units, else 0. Normalised: lower case, single blanks, no punctuation at the ends. start and end are characters of the text as it is;
    seq numbers the text's units that have words. row is the row's number, if docs have one (`row_keys`), or 0.
    """
    cut = re.compile(UNITS[unit])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _UNIT_SCHEMA]
            for doc, text, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = [(m.start(), m.end(), m[0].lower().split()) for m in cut.finditer(text or "")]
                counts = [len(w) for _, _, w in found]
                seq = np.cumsum(np.array([0, *counts]) > 0).tolist()
                whole = {ij: 1 if ij[0] == ij[1] else 2 for ij in whole_lines(found, text or "", min_line)} if min_line else {}
                cuts = runs(counts, min_words) if join_short else [(k, k) for k, n in enumerate(counts) if n >= min_words]
                for i, j in dict.fromkeys([*cuts, *whole]):
                    start, end = found[i][0], found[j][1]
                    words = found[i][2] if i == j else text[start:end].lower().split()
                    key = hashlib.blake2b(" ".join(words).strip(".,;:!?\"'()").encode("utf-8", "replace"), digest_size=16).digest()
                    row = (int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), doc, at, start, end, seq[i], sum(counts[i : j + 1]), whole.get((i, j), 0))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                if len(out[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _UNIT_SCHEMA, strict=True)], schema=_UNIT_SCHEMA)
                    out = [[] for _ in _UNIT_SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _UNIT_SCHEMA, strict=True)], schema=_UNIT_SCHEMA)

    number = F.col(ROW) if ROW in docs.columns else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "text", number).mapInArrow(run, ", ".join(f"{f.name} long" for f in _UNIT_SCHEMA))


def repeated_units(docs: DataFrame, **how) -> DataFrame:
    """One row for each unit that also stands earlier (smaller doc_id, or earlier in the document), as a written table:
    doc_id, row, start, end, seq, words, whole of what goes and kept_doc_id, kept_start of the occurrence that stays.

    Null and empty texts have no units; a null id ranks before all others, and rows that share an id rank by row. A run of
    units that overlaps the occurrence that stays is no repeat. Texts are cut once. Digests are counted before the shuffle;
    the few that a thousandth of all units have are met by broadcast, so a line of a third of all documents is in no one task.
    """
    scratch = Scratch(docs.sparkSession, "units")
    cut = scratch.written(units(docs, **how), "units")
    first = cut.groupBy("d1", "d2").agg(F.count("*").alias("__n"), F.min(F.struct("doc_id", "row", "start", "end")).alias("kept")).where("__n > 1")
    first = scratch.written(first.select("d1", "d2", "__n", *(F.col(f"kept.{c}").alias(f"kept_{c}") for c in ("doc_id", "row", "start", "end"))), "firsts")
    stays = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("row") == F.col("kept_row")) & (F.col("start") < F.col("kept_end"))
    found = looked_up(cut, first, ["d1", "d2"], cut.count()).where(~stays)
    found = scratch.written(found.select("doc_id", "row", "start", "end", "seq", "words", "whole", "kept_doc_id", "kept_start"), "repeats")
    scratch.drop("units", "firsts")
    return found


def _long_runs(row: np.ndarray, seq: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Which of some units, in order of row and seq, lie in stretches of neighbours that have `least` words in all."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (seq[1:] > seq[:-1] + 1)
    run = np.cumsum(new) - 1
    return np.bincount(run, words, minlength=1)[run] >= least


def _outer(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, spans) as (doc_id, row, n_removed, removed_chars, removed): spans that lie in another one are left out, and
    so are stretches of fewer than `least` words in which no whole line repeats."""
    for b in batches:
        spans = b.column(2)
        flat, size = spans.flatten(), spans.value_lengths().to_numpy()
        start, end, seq, words, whole = (flat.field(k).to_numpy() for k in ("start", "end", "seq", "words", "whole"))
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((-end, start, row))
        if least:
            goes, part = whole > 0, order[whole[order] < 2]
            goes[part] |= _long_runs(row[part], seq[part], words[part], least)
            order = order[goes[order]]
        start, end, row = start[order], end[order], row[order]
        base = row * (int(end.max(initial=0)) + 1)  # the farthest end so far does not pass from one document to the next
        before = np.concatenate([[0], np.maximum.accumulate(base + end)[:-1]])[: len(end)] - base
        keep = end > before
        n = np.bincount(row[keep], minlength=len(size))
        chars = np.zeros(len(size), np.int64)
        np.add.at(chars, row[keep], (end - np.maximum(start, before))[keep])
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        kept = flat.take(pa.array(order[keep]))
        shown = pa.StructArray.from_arrays([kept.field(k) for k in SHOWN], names=list(SHOWN))
        out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(chars), pa.ListArray.from_arrays(ends, shown)], names=["doc_id", "row", "n_removed", "removed_chars", "removed"])
        yield out.filter(pa.array(n > 0))


def _losses(docs: DataFrame, min_run: int = 0, **how) -> DataFrame:
    rows = repeated_units(docs, **how).groupBy("doc_id", "row").agg(F.collect_list(F.struct(*SHOWN, "seq", "words", "whole")).alias("spans"))
    return rows.mapInArrow(lambda it: _outer(it, min_run), "doc_id long, row long, n_removed long, removed_chars long, removed array<struct<start: long, end: long, kept_doc_id: long, kept_start: long>>")


def deduplicate_units(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_removed (units), removed_chars and removed (sorted array of start, end, kept_doc_id, kept_start),
    a row for each row of docs that loses something, whether or not others share its id. Other documents stay as they are.

    how: unit, min_words, join_short and min_line of `units`, and min_run: repeated units go only in stretches of neighbours that
    have that many words in all, so that single common sentences stay; whole lines of min_line words go by themselves. Runs that are joined may overlap: none lies
    in another, and removed_chars counts each character once. Of rows that share an id, the first by row number stays
    whole; null ids rank first. Null and empty texts and an empty table lose nothing; other columns are not read.
    """
    keyed, unique = row_keys(docs)
    return _losses(docs if unique else keyed, **how).drop("row")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs with the repeated units cut out of text; n_chars, if there, follows."""
    keyed, _ = row_keys(docs)
    spans = _losses(keyed, **how).select(F.col("row").alias("__id"), F.col("removed").alias("__cut"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cut", lambda s: s["end"]))
    starts = F.concat(F.transform("__cut", lambda s: s["start"]), F.array(F.length("text").cast("long")))
    keep = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring("text", (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(keep, ""))
    out = keyed.join(spans, F.col(ROW) == F.col("__id"), "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
