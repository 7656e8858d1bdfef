"""Search, mixing, sharding and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fabrel.llm import mixing, queries, topk
from fabrel.llm.mixing import mix_sources, mixed
from fabrel.llm.shard import hilbert_index, shard_documents, write_shards
from fabrel.llm.topk import top_k


def brute_top(rows, k):
    sound = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sound:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in sound if j != i)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("rows", "queries_"), [(8192, 2048), (37, 3)])
def test_top_k(spark, monkeypatch, rows, queries_):
    monkeypatch.setattr(topk, "BLOCK_ROWS", rows)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", queries_)
    r = np.random.default_rng(4)
    data = [(i, [float(np.float32(x)) for x in r.normal(0, 0.2, 16)]) for i in range(400)]
    data += [(450, data[0][1]), (451, data[0][1]), (500, None), (501, [0.1, None]), (550, [float("nan")] * 16), (551, [float("inf")] * 16), (600, []), (601, [0.5, -0.5]), (None, data[1][1]), (650, [0.0] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(x) for x in top_k(df, df.where("vec_id % 50 = 0")).collect())
    assert got == brute_top(data, 5)


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], schema)
    assert sorted(map(tuple, top_k(few, few.where("vec_id = 0")).collect())) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert top_k(few.limit(0), few.limit(0)).count() == 0 and top_k(few.where("vec_id = 0"), few.where("vec_id = 0")).count() == 0


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        free = {s: left * w[s] / sum(w[x] for x in sizes if x not in capped) for s in sizes if s not in capped}
        over = [s for s, t in free.items() if t >= 2 * sizes[s]]
        if not over:
            return capped | free
        capped |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("buckets", [4096, 2])
def test_mix(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    r = random.Random(3)
    docs = [(i, r.choice(["a", "b", "c", "d", None]) if i % 3 else "a", " ".join(["w"] * r.choice([0, 1, 3, 9, 40, 200]))) for i in range(700)] + [(9000, "e", None), (9001, "\u00e9", "x\u00a0y z")]
    out = mix_sources(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in docs}
    sizes, taken = Counter(), Counter()
    for x in out:
        assert x.size == words[x.doc_id] and x.taken in (0, x.size, 2 * x.size)
        sizes[x.source] += x.size
        taken[x.source] += x.taken
    want = expected_targets(sizes)
    for x in out:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
    assert len(out) == len(docs) and all(abs(taken[s] - want[s]) <= 100 for s in sizes)


def test_mix_is_the_same_again_and_in_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted(map(tuple, queries.op8_mixing(spark, sf).collect())) for _ in range(2))
    d = duckdb.connect()
    d.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert one == two == sorted(d.sql(queries.ORACLE_SQL["op8_mixing"]).fetchall())
    copies = {x.doc_id: x.copies for x in mix_sources(docs).collect()}
    rows = Counter(x.doc_id for x in mixed(docs).select("doc_id").collect())
    assert rows == Counter({i: n for i, n in copies.items() if n})


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, source string, text string, taken long, target int"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    out = mix_sources(spark.createDataFrame([(1, None, None, 1, 1), (None, None, "", 1, 1), (1, "s", "", 1, 1)], schema)).collect()
    assert [(x.size, x.taken, x.target) for x in out] == [(0, 0, 0.0)] * 3


def test_mixed_takes_rows_that_share_an_id_twice_at_most(spark):
    schema = "doc_id long, source string, text string, at int"
    r = random.Random(6)
    docs = [(r.choice([None, 7, 7, 100 + i]), r.choice("ab"), " ".join(["w"] * r.choice([1, 5, 30])), i) for i in range(120)]
    df = spark.createDataFrame(docs, schema).repartition(3)
    rows = mixed(df).collect()
    copies = Counter(x.at for x in rows)
    assert max(copies.values()) == 2 and all(tuple(x) == docs[x.at] for x in rows)
    taken = sum(x.taken for x in mix_sources(df).collect())
    assert sum(len(x.text.split()) for x in rows) == taken


def test_top_k_in_sql(spark, sf):
    d = duckdb.connect()
    d.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op3_topk_search(spark, sf).collect())) == sorted(d.sql(queries.ORACLE_SQL["op3_topk_search"]).fetchall())


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3)])
def test_hilbert_curve_goes_step_by_step(d, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    index = hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def check_shards(rows, n):
    slots = defaultdict(list)
    for x in rows:
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    counts = [len(slots[s]) for s in range(16)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1


def test_shards(spark, sf, tmp_path):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = shard_documents(docs, carry=docs.columns)
    rows = out.collect()
    check_shards(rows, docs.count())
    assert all(x.size == len(x.text.encode()) + 1 and x.text_crc32 == zlib.crc32(x.text.encode()) for x in rows)
    again = {(x.doc_id, x.shard, x.slot) for x in shard_documents(docs.repartition(5)).collect()}
    assert again == {(x.doc_id, x.shard, x.slot) for x in rows}
    write_shards(out, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)


def test_shards_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, shard int"
    assert shard_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(i % 3 or None, None if i % 2 else "same", None, "s", 99) for i in range(50)]
    out = shard_documents(spark.createDataFrame(rows, schema)).collect()
    check_shards(out, 50)
    assert {x.size for x in out} == {1, 5}


def brute_shards(docs, shards=16):
    """{row number: (shard, slot)} of (doc_id, text, lang, source), unique by id, by sorting in one list."""
    import zlib

    import xxhash

    by = defaultdict(list)
    for row in docs:
        by[row[1]].append(row)
    level = {}
    place = {r[0]: min(by[r[1]], key=lambda x: x[0]) for r in docs}
    for c in (2, 3):
        values = sorted({p[c] for p in place.values()}, key=lambda v: (v is not None, v))
        level |= {(c, v): i * min(len(values), 64) // len(values) for i, v in enumerate(values)}
    seq = []
    for i, text, *_ in docs:
        b = text.encode()
        size = len(b) + 1
        bits = size.bit_length()
        small = max(0, min(63, 4 * (bits - 1) + ((size * 4) >> (bits - 1)) % 4 - 16))
        p = place[i]
        h = int(hilbert_index(np.array([[level[2, p[2]], level[3, p[3]], small]]), 6)[0])
        x = xxhash.xxh64(b, seed=42).intdigest()
        seq.append(((h, x - (1 << 64) if x >> 63 else x, zlib.crc32(b), size), i))
    seq.sort()
    n, done = len(seq), 0
    cuts = [-(-k * n // shards) for k in range(1, shards)]
    for c in cuts:
        if seq[c - 1][0] != seq[c][0]:
            continue
        same = [k for k in range(n) if seq[k][0] == seq[c][0]]
        s, e = same[0], same[-1] + 1
        lone = [k for k in range(e, n) if len(by[next(d[1] for d in docs if d[0] == seq[k][1])]) == 1][: c - s]
        if len(lone) < c - s or s < done or lone[-1] >= min([x for x in cuts if x >= e] or [n]) or e - s > n // shards:
            continue
        done = lone[-1] + 1
        seq = seq[:s] + [seq[k] for k in lone] + seq[s:e] + [seq[k] for k in range(e, done) if k not in lone] + seq[done:]
    return {i: (r * shards // n, r - -(-(r * shards // n) * n // shards)) for r, (_, i) in enumerate(seq)}


def test_shards_against_one_sorted_list_and_equal_texts_together(spark, sf):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    r = random.Random(4)
    docs += [(10_000 + i, f"copy {r.randrange(12)}", r.choice(["en", "de", None]), r.choice(["src1", "src1_a", "src1_b", None])) for i in range(90)]
    schema = "doc_id long, text string, lang string, source string"
    out = {x.doc_id: (x.shard, x.slot) for x in shard_documents(spark.createDataFrame(docs, schema).repartition(3)).collect()}
    assert out == brute_shards(docs)
    shards = defaultdict(set)
    for i, text, *_ in docs:
        shards[text].add(out[i][0])
    assert sum(len(s) > 1 for s in shards.values()) <= 2  # those with too few single rows before the next cut


def test_a_group_larger_than_a_shard_is_cut(spark):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(i, "same" if i % 3 else f"text {i}", "en", "s") for i in range(300)]
    check_shards(shard_documents(spark.createDataFrame(rows, schema)).collect(), 300)


def test_pipeline_keeps_columns_and_meets_odd_rows(spark, sf, tmp_path):
    """Null and empty texts, null and repeated ids, a further column named like one that a stage makes, an empty table."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id as size", "'x' as copies", "1 as __n")
    odd = spark.createDataFrame([(None, None, None, None, 0, 1, "y", 2), (None, "", "en", "s", 0, 2, "y", 2), (1, "", "en", "s", 0, 3, "y", 2), (1, "One short text.", "en", "s", 15, 4, "y", 2)], docs.schema)
    for name, rows in (("odd", docs.unionByName(odd)), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{other}.parquet").write.parquet(f"{tmp_path}/{name}/{other}.parquet")
        out = p.run(spark, f"{tmp_path}/{name}")
        assert set(docs.columns) | {"shard", "slot", "hilbert", "text_crc32"} == set(out.columns)
        got = out.collect()
        assert bool(got) == (name == "odd")
        if got:
            check_shards(got, len(got))


def test_pipeline(spark, sf):
    """Each stage on what the one before it kept."""
    import corpus_pipeline as p
    from fabrel.llm.common import written
    from fabrel.llm.quality import ACCEPT, score_documents, train

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = {r.doc_id for r in score_documents(docs, train(docs, labels)).collect() if r.score >= ACCEPT}
    kept = [docs]
    for name, stage in p.STAGES:
        kept.append(written(stage(spark, kept[-1], sf), name))
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    assert set(ids[1]) == good and all(k.columns == docs.columns for k in kept[:-1])
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i in ids[1] for w in [re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]).split()]}
    left, gone = set(ids[2]), set(ids[1]) - set(ids[2])
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in left for b in left if a < b)
    assert all(any(near(a, b) for b in ids[1] if b < a) for a in gone)
    fold = lambda t: " ".join(t.lower().split())
    leaky = {i for i in ids[2] if any(fold(b) in fold(texts[i]) for b in bench)}
    assert leaky and not leaky & set(ids[3]) and len(set(ids[2]) - leaky - set(ids[3])) == 0
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) == 2 and Counter(ids[4]) == Counter(ids[5])
    rows = kept[5].collect()
    check_shards(rows, len(ids[4]))
    assert sorted(map(tuple, p.run(spark, sf).collect())) == sorted(map(tuple, rows))
