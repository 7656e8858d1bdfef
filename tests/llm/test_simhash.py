"""SimHash groups against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fabrel.llm import simhash
from fabrel.llm.simhash import fingerprint, forest, simhash_groups

SCHEMA = "doc_id long, text string"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def expected(docs):
    prints = [brute_print(t) for _, t in docs]
    groups = brute_groups(prints)
    least = {g: min([d for (d, _), h in zip(docs, groups, strict=True) if h == g and d is not None], default=None) for g in set(groups)}
    return sorted([(d, f"{p:016x}", least[g], prints.count(p)) for (d, _), p, g in zip(docs, prints, groups, strict=True)], key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus(seed):
    """Copies, long texts with few words changed (prints some bits apart), unrelated texts, odd ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioubcdéÀß") for _ in range(r.randint(1, 7))) for _ in range(80)] + ["The", "OF", " x y"]
    base, docs = [r.choice(words) for _ in range(400)], []
    for _ in range(110):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append(r.choice([" ", "\n", "\x0b "]).join(w) if r.random() < 0.7 else " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 30]))))
    return list(enumerate([*docs, None, "", " \t\n", docs[0].upper(), "a b", "A  b"]))


def test_shingles_match_spark_and_long_texts_are_cut_into_pieces(spark, monkeypatch):
    assert fingerprint(b"Ab cD eF") == brute_print("ab cd ef") == spark.sql("select xxhash64('ab cd ef')").first()[0] % (1 << 64)
    text = corpus(3)[0][1] * 3
    whole = fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert fingerprint(text.encode()) == whole == brute_print(text)
    assert fingerprint(b"x" * 500 + b" y") == brute_print("x" * 500 + " y")


@pytest.mark.parametrize(("group", "run"), [(16_384, 1024), (16_384, 2), (4, 1024)])
def test_groups(spark, monkeypatch, group, run):
    """run: at 2 most runs are sorted under two wildcards; group: at 4 large keys are met by variants of whole prints."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "RUN", run)
    docs = corpus(1)
    assert found(simhash_groups(spark.createDataFrame(docs, SCHEMA))) == expected(docs)


def near_prints(seed, n):
    """Prints a few bits from one centre, spread over both halves, and others."""
    r = np.random.default_rng(seed)
    out = r.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(0, n, 2):
        out[i] = out[0]
        for k in r.integers(0, 64, r.integers(0, 7)):
            out[i] ^= np.uint64(1) << np.uint64(k)
    return np.unique(out)


@pytest.mark.parametrize(("group", "run", "step"), [(16_384, 1024, 1 << 16), (16_384, 2, 1 << 16), (16_384, 40, 100), (3, 1024, 1 << 16), (30, 5, 1 << 16)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, group, run, step):
    for name, value in (("GROUP", group), ("RUN", run), ("STEP", step)):
        monkeypatch.setattr(simhash, name, value)
    prints = near_prints(group + run, 500)
    keyed = simhash.index_keys(spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long"))
    large = keyed.groupBy("key").count().where(F.col("count") > group).select("key")
    links = simhash.linked_in_tasks(keyed.join(large, "key", "left_anti")).unionByName(simhash.wide_variants(keyed.join(large, "key", "left_semi")))
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    pairs = np.array([(place[u], place[v]) for u, v in links.collect()])
    assert forest(len(prints), pairs[:, 0], pairs[:, 1]).tolist() == brute_groups([int(p) for p in prints])


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    docs = [(None, "a b c d"), (None, "A b c d"), (3, "a b c d"), (3, "e"), (1, None), (2, ""), (None, "z y")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as print", "'x' as fingerprint", "2 as component_id", "3 as n_copies", "4 as key", "5 as u")
    assert found(simhash_groups(df)) == expected(docs)
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []
