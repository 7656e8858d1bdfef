"""Line, string and near-duplicate removal against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fabrel.llm import common, jaccard, suffix_dedup
from fabrel.llm.jaccard import near_duplicates, one_of_each
from fabrel.llm.line_dedup import deduplicate_units, runs, without_repeats
from fabrel.llm.suffix_dedup import deduplicate_strings

SCHEMA = "doc_id long, text string"


def corpus(seed: int) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, runs of one byte, words beyond ASCII, empty and null texts."""
    r = random.Random(seed)
    words = ["of", "the", "and", *("".join(r.choice("aeioubcdé") for _ in range(r.randint(2, 7))) for _ in range(60))]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base, docs = some(60), some(150), []
    for _ in range(120):
        kind = r.random()
        if kind < 0.2 and docs:
            docs.append(r.choice(docs))
        elif kind < 0.45:
            w = base.split(" ")
            for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append(" ".join(w))
        elif kind < 0.65:
            docs.append(f"{some(r.randint(0, 40))}\n{passage}. {some(r.randint(0, 40))}")
        else:
            docs.append(some(r.choice([0, 1, 3, 5, 6, 40, 300])))
    docs += [None, "", " \t\n", "-" * 700, "ab" * 200, "x" * 99, "x" * 100, "Ab cD", "ab cd"]
    return list(enumerate(docs))


def brute_strings(docs, length):
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "hot", "piece"), [(1, 20_000, 4 << 20), (2, 3, 4 << 20), (5, 20_000, 150)])
def test_strings(spark, monkeypatch, seed, hot, piece):
    """hot: at 3 nearly all buckets are split; piece: at 150 bytes most documents are long ones."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    if piece < 1000:
        monkeypatch.setattr(suffix_dedup, "text_chunks", lambda c: common.text_chunks(c, 1))
    docs = corpus(seed)
    got = {r[0]: tuple(r)[1:] for r in deduplicate_strings(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    assert got == brute_strings(docs, 100)


def test_strings_rank_rows_of_one_id_by_text(spark):
    r = random.Random(3)
    t = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(5, t), (5, t), (None, t), (4, None)]
    out = deduplicate_strings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in out) == [(-1, 0), (4, 0), (5, 300), (5, 300)]
    assert deduplicate_strings(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("seed", "hot", "piece"), [(1, 20_000, 4 << 20), (2, 20_000, 40), (3, 2, 4 << 20)])
def test_components(spark, monkeypatch, seed, hot, piece):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "PIECE", piece)
    if piece < 1000:
        monkeypatch.setattr(jaccard, "text_chunks", lambda c: common.text_chunks(c, 1))
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    assert got == brute_components(docs)


def test_components_in_small_cells_and_blocks(spark, monkeypatch):
    """Texts of one template, of which most do not link: their bands are dealt over cells, long sets over blocks."""
    monkeypatch.setattr(jaccard, "CELL", 3)
    monkeypatch.setattr(jaccard, "WHOLE", 40)
    r = random.Random(8)
    template = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join([*template[: r.choice([38, 40, 44, 60])], *(f"own{i}_{k}" for k in range(r.choice([2, 6, 9, 14])))])) for i in range(60)]
    docs += [(60 + i, t) for i, t in corpus(9)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    assert got == brute_components(docs)


def test_hubs_are_joined_by_broadcast(spark, monkeypatch):
    from fabrel.llm import graph

    monkeypatch.setattr(graph, "looked_up", lambda rows, facts, on, total: common.looked_up(rows, facts.withColumn("__n", F.when(F.col("__n") > 3, F.lit(1_000_000)).otherwise(F.col("__n"))), on, total))
    r = random.Random(2)
    edges = [(5, 10 + i) for i in range(40)] + [(r.randrange(100, 140), r.randrange(100, 140)) for _ in range(25)] + [(200 + i, 201 + i) for i in range(9)]
    parent = {x: x for e in edges for x in e}
    for _ in range(50):
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    out = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {x: c for x, c in parent.items() if x in out} and set(out) == {x for u, v in edges if u != v for x in (u, v)}


def test_chain_of_near_copies(spark):
    """Neighbours link, ends do not: the component is found over all steps."""
    words = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join([*(f"n{i}_{k}" for k in range(0)), *words[i * 4 : i * 4 + 60]])) for i in range(5)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(docs).items()} == dict.fromkeys(range(5), 0)


def test_components_of_odd_tables(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "one two three four five six"
    rows = [(None, text), (3, text), (3, text), (7, "ONE two  three\tfour five six"), (None, None), (9, "")]
    out = near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", component_id int")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out) == [(-1, 0, -1), (-1, 2, 3), (3, 2, 3), (3, 2, 3), (7, 2, 3), (9, 0, 9)]
    kept = one_of_each(spark.createDataFrame([(1, text, "a"), (2, text, "b"), (4, "x y", "c")], SCHEMA + ", lang string"))
    assert sorted(map(tuple, kept.collect())) == [(1, text, "a"), (4, "x y", "c")]


def test_one_row_stays_of_copies_that_share_an_id(spark):
    text, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, text, 0), (8, text, 1), (8, text, 2), (3, text, 3), (None, other, 4), (None, other, 5), (8, "x y z", 6), (None, None, 7), (None, "", 8)]
    kept = one_of_each(spark.createDataFrame(rows, SCHEMA + ", at int").repartition(3)).collect()
    assert len(kept) == 5 and {r.at for r in kept} - {4, 5} == {3, 6, 7, 8} and all(tuple(r) == rows[r.at] for r in kept)


def brute_units(docs, min_words=5):
    seen, out = {}, defaultdict(list)
    for i, t in docs:
        for m in re.finditer(r"[^\n.!?]*(?:[.!?]+(?:\s+|$)|\n|$|[.!?])", t or ""):
            w = m[0].lower().split()
            if len(w) >= min_words:
                key = " ".join(w).strip(".,;:!?\"'()")
                if key in seen:
                    out[i].append((m.start(), m.end(), *seen[key]))
                else:
                    seen[key] = (i, m.start())
    return dict(out)


def test_units(spark):
    docs = corpus(4)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in deduplicate_units(df).collect()}
    assert got == brute_units(docs)
    kept = {r.doc_id: r.text for r in without_repeats(df).collect()}
    for i, t in docs:
        spans = [(a, b) for a, b, *_ in got.get(i, [])]
        want = None if t is None else "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in spans))
        assert kept[i] == want


def test_units_of_odd_tables(spark):
    assert deduplicate_units(spark.createDataFrame([], SCHEMA)).count() == 0
    line = "a line of more than five words"
    out = deduplicate_units(spark.createDataFrame([(1, f"{line}\n{line}\n"), (1, line), (None, line), (2, None), (3, "short one\nshort one")], SCHEMA)).collect()
    assert sum(r.n_removed for r in out) == 3 and all(r.doc_id == 1 for r in out)


def test_passages_of_short_units(spark):
    """A passage whose sentences are all short goes as a whole; what stays of it stays whole."""
    words = [f"w{i}" for i in range(60)]
    short = " ".join(f"{w}." for w in words)
    pairs = " ".join(f"{a} {b}." for a, b in zip(words[::2], words[1::2], strict=True))
    docs = [(1, f"Start here.\n{short}\nEnd."), (2, short), (3, f"x y. {short} z."), (4, pairs), (5, f"q r.\n{pairs}\ns t."), (6, "No. " * 12), (7, "one two. three.")]
    rows = {r.doc_id: r for r in deduplicate_units(spark.createDataFrame(docs, SCHEMA), join_short=True).collect()}
    kept = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(docs, SCHEMA), join_short=True).collect()}
    assert kept == {1: docs[0][1], 2: "", 3: "x y. z.", 4: pairs, 5: "q r.\ns t.", 6: "No. " * 5, 7: docs[6][1]}
    for i, t in docs:
        assert len(t) - len(kept[i]) == (rows[i].removed_chars if i in rows else 0)
    assert all((a.start, a.end) < (b.start, b.end) and a.end < b.end for r in rows.values() for a, b in zip(r.removed, r.removed[1:]))


def test_copies_that_share_an_id_lose_their_units(spark):
    line = "a line of more than five words"
    rows = [(None, line), (None, line), (4, line), (4, line), (4, f"{line}\nand another one of five words")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id or 0, r.n_removed, r.removed_chars) for r in deduplicate_units(df).collect()) == [(0, 1, 30), (4, 1, 30), (4, 1, 30), (4, 1, 31)]
    assert sorted(r.text for r in without_repeats(df).collect()) == ["", "", "", line, "and another one of five words"]


def test_every_stretch_of_units_is_met_as_a_whole():
    r = random.Random(8)
    for _ in range(300):
        counts = [r.choice([0, 1, 1, 2, 3, 4, 5, 9]) for _ in range(r.randint(1, 14))]
        found = runs(counts, 5)
        for i in range(len(counts)):
            for j in range(i, len(counts)):
                inside = {k for a, b in found if i <= a and b <= j for k in range(a, b + 1)}
                assert sum(counts[i : j + 1]) < 5 or inside >= {k for k in range(i, j + 1) if counts[k]}


def brute_runs(docs, min_run):
    """doc_id: [(start, end)] of repeated sentences, of one word or more, in stretches of min_run words."""
    seen, out = set(), {}
    for i, t in docs:
        run, spans = [], []
        found = [(m.start(), m.end(), m[0].lower().split()) for m in re.finditer(r"[^\n.!?]*(?:[.!?]+(?:\s+|$)|\n|$|[.!?])", t or "")]
        for start, end, w in [*((a, b, w) for a, b, w in found if w), (0, 0, None)]:
            key = w and " ".join(w).strip(".,;:!?\"'()")
            if w and key in seen:
                run.append((start, end, len(w)))
                continue
            if sum(n for *_, n in run) >= min_run:
                spans += [x[:2] for x in run]
            run = []
            seen.add(key)
        if spans:
            out[i] = spans
    return out


def test_only_long_stretches_of_repeated_units_go(spark):
    """Single common lines stay; passages of short sentences go; long texts and further columns of clashing names are met."""
    r = random.Random(12)
    sentence = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(n)) + "."
    common, passages, docs = sentence(9), [[sentence(r.choice([1, 2, 3, 8, 15])) for _ in range(9)] for _ in range(4)], []
    for i in range(60):
        parts = [sentence(r.randint(1, 12)) for _ in range(r.randint(0, 6))]
        if r.random() < 0.5:
            p, a = r.choice(passages), r.randrange(4)
            at = r.randrange(len(parts) + 1)
            parts[at:at] = p[a : a + r.randint(1, 9)]
        if r.random() < 0.5:
            parts.insert(r.randrange(len(parts) + 1), common)
        docs.append((i, r.choice([" ", "\n", "\n\n"]).join(parts)))
    docs += [(60, " ".join(sentence(7) for _ in range(20_000))), (61, None), (62, ""), (63, docs[5][1])]
    df = spark.createDataFrame([(*d, 0, 0, 0) for d in docs], SCHEMA + ", start int, __n int, kept int").repartition(3)
    out = {x.doc_id: [(s.start, s.end) for s in x.removed] for x in deduplicate_units(df, min_words=1, min_run=25).collect()}
    assert out == brute_runs(docs, 25) and 0 < len(out) < 60


def brute_lines(docs, min_run, min_line):
    """doc_id: places of characters, no blanks, of repeated lines of min_line words and of repeated sentences in stretches of min_run."""
    norm = lambda t: " ".join(t.lower().split()).strip(".,;:!?\"'()")
    found = {}
    for i, t in docs:
        cuts = [[(m.start(), m.end()) for m in re.finditer(p, t or "") if m[0].split()] for p in (r"[^\n.!?]*(?:[.!?]+(?:\s+|$)|\n|$|[.!?])", r"[^\n]+")]
        found[i] = [cuts[0], [(a, b) for a, b in cuts[1] if len(t[a:b].split()) >= min_line]]
    first = {}
    for i, t in docs:
        for a, b in sorted(x for part in found[i] for x in part):
            first.setdefault(norm(t[a:b]), (i, a, b))
    out = {}
    for i, t in docs:
        again = lambda a, b: not (first[norm(t[a:b])][0] == i and a < first[norm(t[a:b])][2])  # noqa: B023, E731
        gone = [x for x in found[i][1] if again(*x)]
        run = []
        for x in [*found[i][0], None]:
            if x and again(*x):
                run.append(x)
                continue
            if sum(len(t[a:b].split()) for a, b in run) >= min_run:
                gone += run
            run = []
        if gone:
            out[i] = {k for a, b in gone for k in range(a, b) if not t[k].isspace()}
    return out


def test_repeated_lines_go_whatever_their_neighbours(spark):
    """Lines of min_line words go alone, whether of one sentence or of several; shorter ones stay, but in long stretches."""
    r = random.Random(21)
    sentence = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(n)) + "."
    common = [sentence(20), f"{sentence(8)} {sentence(9)}", sentence(9), f"{sentence(3)} {sentence(4)}", sentence(15)]
    docs = []
    for i in range(60):
        lines = [" ".join(sentence(r.randint(2, 9)) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 5))]
        for line in r.sample(common, r.randint(0, 3)):
            lines.insert(r.randrange(len(lines) + 1), line)
        docs.append((i, r.choice(["\n", "\n\n"]).join(lines)))
    docs += [(60, "\n".join([common[0]] * 3)), (61, None), (62, ""), (63, common[1].replace(". ", "; ")), (64, " \n \n"), (65, f"{common[1]} {sentence(4)}"), (66, "\n".join(sentence(16) for _ in range(5000)))]
    df = spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", whole int").repartition(3)
    rows = {x.doc_id: x for x in deduplicate_units(df, min_words=1, min_run=25, min_line=15).collect()}
    text = dict(docs)
    out = {i: {k for s in x.removed for k in range(s.start, s.end) if not text[i][k].isspace()} for i, x in rows.items()}
    assert out == brute_lines(docs, 25, 15) and 0 < len(out) < 60
    assert rows[60].n_removed >= 2 and 66 not in rows and 65 not in rows
    line = sentence(15)
    five = spark.createDataFrame([(i, f"{sentence(20)}\n{line}\n{sentence(20)}") for i in range(5)], SCHEMA)
    assert sorted(x.doc_id for x in deduplicate_units(five, min_words=1, min_run=25, min_line=15).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("rows", [1, 7, 40, 1000])
def test_buckets_are_gathered_whole(rows):
    r = np.random.default_rng(rows)
    values = np.sort(np.concatenate([r.integers(-50, 50, 300), np.full(200, 3)]))
    batches, at = [], 0
    while at < len(values):
        n = int(r.integers(0, 30))
        batches.append(pa.RecordBatch.from_arrays([pa.array(values[at : at + n]), pa.array(np.arange(at, min(at + n, len(values))))], names=["bucket", "key"]))
        at += n
    parts = list(suffix_dedup.whole_buckets(iter(batches), rows))
    assert np.concatenate([p["key"] for p in parts]).tolist() == list(range(len(values)))
    assert all(a["bucket"][-1] < b["bucket"][0] for a, b in zip(parts, parts[1:]))
    assert list(suffix_dedup.whole_buckets(iter(batches[:0]), rows)) == []


@pytest.mark.parametrize(("length", "q"), [(24, 8), (60, 20), (420, 20), (1020, 20)])
def test_strings_of_other_lengths(spark, length, q):
    r = random.Random(length)
    base = "".join(r.choice("abcdefgh ") for _ in range(4000))
    docs = [(i, base[a : a + r.randint(0, 1500)] + "".join(r.choice("xyz ") for _ in range(r.randint(0, 300))) + base[:a][-400:]) for i in range(14) for a in [r.randrange(2500)]]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], SCHEMA + ", key string, place int")
    got = {x[0]: tuple(x)[1:] for x in deduplicate_strings(df, length=length, q=q).collect()}
    assert got == brute_strings(docs, length)


@pytest.mark.parametrize(("length", "q"), [(20, 20), (101, 20), (3000, 20), (100, 0)])
def test_lengths_that_cannot_be_packed_are_refused(spark, length, q):
    with pytest.raises(ValueError, match="length"):
        deduplicate_strings(spark.createDataFrame([(1, "a")], SCHEMA), length=length, q=q)


def test_small_buckets_are_not_split_with_large_ones(spark, monkeypatch):
    """Counters tell a large bucket from small ones: of texts without repeats no bucket is split."""
    monkeypatch.setattr(suffix_dedup, "HOT", 10)
    r = random.Random(5)
    docs = spark.createDataFrame([(i, "".join(r.choices("abcdefghijklmnop ", k=20_000))) for i in range(40)], "__key long, text string")
    sizes = spark.sparkContext.broadcast(suffix_dedup.bucket_sizes(docs, 100, 20))
    rows = suffix_dedup.suffixes(docs, 100, 20, sizes)
    assert rows.count() > 15_000 and rows.where("place & 1 = 1").isEmpty()
    same = spark.createDataFrame([(i, "".join(r.choices("abcdefgh", k=100)) + "a passage that many texts have, of a hundred bytes or more, so that its anchors are the same in each of them") for i in range(50)], "__key long, text string")
    sizes = spark.sparkContext.broadcast(suffix_dedup.bucket_sizes(same, 100, 20))
    assert not suffix_dedup.suffixes(same, 100, 20, sizes).where("place & 1 = 1").isEmpty()
