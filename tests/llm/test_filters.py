"""Decontamination, quality, licenses and URLs."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabrel.llm import common, decontaminate, license_scan, quality
from fabrel.llm.decontaminate import contaminations, decontaminated, fold
from fabrel.llm.license_scan import PHRASES, scan_licenses, signature_rules
from fabrel.llm.quality import ACCEPT, score_documents, train
from fabrel.llm.url_filter import RULES, filter_urls, mine_rules

SCHEMA = "doc_id long, text string"


def edited(r, text, k):
    s = list(text)
    for _ in range(k):
        p, kind = r.randrange(len(s)), r.random()
        if kind < 0.34:
            s[p] = r.choice("abcdefgh ")
        elif kind < 0.67:
            s.insert(p, r.choice("abcdefgh "))
        elif len(s) > 1:
            s.pop(p)
    return "".join(s)


def least_edits(text: np.ndarray, item: np.ndarray) -> int:
    row = np.zeros(len(text) + 1, int)
    lane = np.arange(len(row))
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0], new[1:] = i, np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - lane) + lane
    return int(row.min())


@pytest.mark.parametrize("block", [1 << 21, 600])
def test_contaminations(spark, monkeypatch, block):
    """Against plain edit distance; with blocks of 600 bytes the benchmark goes out in several."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    items = [(i, text(r.randint(20, 240))) for i in range(25)] + [(90, None), (91, "short"), (92, "")]
    docs = [(i, text(r.randint(0, 300)) + (edited(r, t := r.choice(items[:25])[1], r.randint(0, int(len(t) * 0.11))) if r.random() < 0.7 else "").upper() + text(r.choice([0, 50]))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\t\n")]
    got = {(x.doc_id, x.item_id): x.edits for x in contaminations(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        t = fold(np.frombuffer((t or "").encode(), np.uint8))[0]
        for k, p in items[:25]:
            p = fold(np.frombuffer(p.strip().encode(), np.uint8))[0]
            e = least_edits(t, p)
            if e <= min(int(len(p) * decontaminate.EDIT_RATE), (len(p) - 8) // 8):
                want[i, k] = e
    assert got == want and len(want) > 40


def test_decontaminated_keeps_the_rest(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(1, f"xx {item.title()} yy", 1), (2, "clean text", 2), (None, item, 3), (3, None, 4)], SCHEMA + ", edits int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(x.edits for x in decontaminated(docs, bench).collect()) == [2, 3, 4]
    assert contaminations(docs, bench.limit(0)).isEmpty() and contaminations(docs.limit(0), bench).isEmpty()


def test_pipeline_drops_leaks_of_rows_without_an_id_of_their_own(spark, tmp_path):
    import corpus_pipeline

    item = "the quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(None, item, 1), (None, "clean text", 2), (5, f"{item} yy", 3), (5, "more clean text", 4), (6, item, 5)], SCHEMA + ", at int")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(x["at"] for x in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == [2, 4]


def test_quality_on_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = score_documents(docs, train(docs, labels))
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= ACCEPT) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())
    # Held-out labels teach nothing.
    turned = labels.withColumn("quality", F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert score_documents(docs, train(docs, turned)).exceptAll(out).isEmpty()


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (None, "a b", 0.2), (4, "x " * 60_000, 0.3), (4, "x", 0.3)], SCHEMA + ", score double")
    none = spark.createDataFrame([(9, None, 0)], "doc_id long, quality int, toxic int")
    out = score_documents(docs, train(docs, none)).collect()
    assert len(out) == 5 and {r.score for r in out} == {1.0}
    both = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in score_documents(docs, train(docs, both)).collect())
    assert score_documents(docs.limit(0), train(docs.limit(0), both)).count() == 0
    assert quality.keep_quality(docs, train(docs, none)).columns == docs.columns


LICENSES = [
    (1, "Licensed under the Apache License, Version 2.0."), (2, "MIT License\nmit LICENSE mit license"), (3, "GNU General Public License v3 and CC BY 4.0"), (4, "no such thing: permit license, mit licenses"),
    (5, None), (6, ""), (7, "cc by cc by CC-BY-SA 3.0"), (8, "SPDX-License-Identifier: BSD-3-Clause"), (9, "GNU Lesser General Public License version 2.1"), (10, "é mit license İ apache license"), (10, "all rights reserved"),
    (11, "the quick " * 9000 + "gnu general public license"), (12, "Kelvin \u212a mit license"),
]


def base_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    out = scan_licenses(spark.createDataFrame([(*r, "x") for r in LICENSES], SCHEMA + ", labels string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out if r.doc_id != 10) == sorted((i, *base_of(t)) for i, t in LICENSES if i != 10)
    by = {r.doc_id: r for r in out}
    assert by[1].labels == "apache,apache-2.0" and by[8].labels == "bsd-3-clause" and by[9].labels == "lgpl-2.1" and by[4].labels == "" and by[4].score == 0
    assert by[3].labels == "cc-by,cc-by-4.0,gpl,gpl-3.0" and by[7].labels == "cc-by,cc-by-sa-3.0"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licenses_against_brute_force(spark):
    """Every rule on every text, without the keyword prefilter."""
    r = random.Random(2)
    bits = [t for _, t in LICENSES if t and len(t) < 300] + ["creative commons attribution share alike 4.0 international", "gplv2 or later", "the software is", "Eclipse Public License v 2.0", "redistribution and use in source and binary forms with or without modification are permitted"]
    docs = [(i, " ".join(r.choice(bits) for _ in range(r.randint(1, 5)))) for i in range(40)]
    rules = signature_rules()
    assert len(rules) >= 200 and [(w, x) for _, _, _, w, x, _ in rules if not re.search(rf"(?<![a-z0-9]){w}(?![a-z0-9?])", x)] == []
    got = {x.doc_id: (x.labels, x.n_found) for x in scan_licenses(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i, t in docs:
        words = re.sub(license_scan.SEPARATORS, " ", f" {t} ")
        found = [(p, m.start() - m.end(), k, m.start(), m.end(), label) for k, label, p, _, x, _ in rules for m in re.finditer(f"(?i) (?:{x})(?= )", words)]
        stand = [a for a in found if not any(b[3] <= a[3] and a[4] <= b[4] and b[:3] < a[:3] for b in found)]
        labels = {a[5] for a in stand} | set(filter(None, base_of(t)[4].split(",")))
        assert got[i] == (",".join(sorted(labels)), len(stand)), t


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(r, v) for r, v in RULES for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_urls(spark, sf):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7x?q#f", "x://example.com/en/8", "http://com/en/", "http://xcom/en/1", "http://b.net/de/1", "http://example.net/de/89#a", "http://é.org/es/\n1?x", "a://b://c.com/en/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(1, "http://a.org/es/1", "z"), (None, "http://a.org/es/1", "z")], "page_id long, url string, verdict string")
    out = [((r.page_id if r.page_id is not None else -1), r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages).collect()]
    want = [(i, *judged(u)) for i, u in [*enumerate(urls), (1, "http://a.org/es/1"), (-1, "http://a.org/es/1")]]
    place = lambda x: (x[0], x[1], x[2])
    assert [o[:4] for o in sorted(out, key=place)] == [w[:4] for w in sorted(want, key=place)]
    rules = {(o[0], o[1], o[2]): (o[3], o[4]) for o in out}
    for i, host, path, rule, verdict in want:
        got = rules[i, host, path]
        assert got[0] == rule and (rule is None or got[1] == verdict) and got[1] in ("allow", "block")
    assert filter_urls(pages.limit(0)).count() == 0


def test_mined_rules_judge_other_urls(spark):
    rows = [(i, f"http://bad{i % 3}.example.com/en/{i % 9}") for i in range(60) if i % 9 != 7] + [(100 + i, f"http://good.net/de/{i}") for i in range(60)]
    rows += [(900, "http://bad1.example.org/fr/1"), (901, "http://good.org/de/3"), (902, "http://other.xyz/a")]
    out = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (out[900], out[901], out[902]) == ("block", "allow", "allow")


def brute_rules(rows, least, confidence):
    """{(tokens, verdict): (confidence, support)} of the minimal rules, from all subsets of all rows' tokens."""
    import itertools

    at = {}
    for k, (tokens, _) in enumerate(rows):
        for t in tokens:
            at.setdefault(t, set()).add(k)
    first = {}
    for t in sorted(at):
        first.setdefault(frozenset(at[t]), t)
    found = {}
    alone = [(t,) for t in at]
    joint = {c for tokens, _ in rows for n in range(2, 9) for c in itertools.combinations(sorted(set(tokens) & set(first.values())), n)}
    for c in [*alone, *joint]:
        having = set.intersection(*(at[t] for t in c))
        for v in {v for _, v in rows}:
            n = sum(rows[k][1] == v for k in having)
            if n >= least and n / len(having) >= confidence and all(len(at[t]) >= least for t in c):
                found[c, v] = (n / len(having), n / len(rows))
    parts = lambda c: (p for n in range(1, len(c)) for p in itertools.combinations(c, n))
    return {k: x for k, x in found.items() if not any((p, k[1]) in found and found[p, k[1]][0] >= x[0] for p in parts(k[0]))}


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_against_all_subsets(spark, seed):
    r = random.Random(seed)
    rows = [(sorted({r.choice("abcdefg") for _ in range(r.randint(1, 6))} | {"z", "y"}), r.choice(["allow", "block", "block"])) for _ in range(90)]
    rows = [(t, "allow" if {"a", "b"} <= set(t) and r.random() < 0.9 else v) for t, v in rows]
    out = mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.05, min_confidence=0.6, combined=9).collect()
    got = {(tuple(x.tokens), x.verdict): (round(x.confidence, 9), round(x.support, 9)) for x in out}
    want = {k: (round(c, 9), round(s, 9)) for k, (c, s) in brute_rules(rows, 5, 0.6).items()}
    assert got == want and any(len(t) > 1 for t, _ in got) and len(got) == len(out)


def test_mining_ends_on_deep_urls_that_share_their_segments(spark):
    r = random.Random(3)
    deep = [f"s{i}" for i in range(20)]
    rows = []
    for i in range(50):
        kept = [s for s in deep if r.random() < 0.95]
        rows.append((i, f"http://{r.choice(['example.com/en/', 'x.net/de/'])}{'/'.join(kept)}/{i}"))
    rows += [(100, "http://other.xyz/" + "/".join(deep)), (101, None), (101, "no url")] + [(200 + i, "http://same.xyz/a") for i in range(2000)]
    out = {x.page_id: x.verdict for x in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(out) == 50 + 2 + 2000 and out[101] == "allow" and len({out[200 + i] for i in range(2000)}) == 1


def test_bradley_terry_against_gradient_descent():
    """The weights are those that plain gradient descent on the pairs' logistic loss comes to; the threshold errs least."""
    r = np.random.default_rng(4)
    label = (r.random(300) < 0.6).astype(int)
    x = r.normal(size=(300, 6)) + label[:, None] * np.array([1.0, 0.5, 0, 0, -0.7, 0])
    m = quality.fit_bradley_terry(x, label, pairs=2000, penalty=0.01)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    d, w = quality.preferences(z, label, 2000, 5), np.zeros(6)
    for _ in range(4000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 0.01 * w)
    assert np.abs(w - m["w"]).max() < 1e-3
    s = z @ m["w"]
    wrong = lambda cut: ((s >= cut) != (label == 1)).sum()
    assert wrong(m["cut"]) == min(wrong(c) for c in [*s, s.max() + 1])
    assert ((quality.predict(m, x) >= quality.ACCEPT) == (s >= m["cut"])).all()


def test_quality_model_is_the_same_in_reruns_with_repeated_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").selectExpr("doc_id", "concat(text, ' !!') as text")).unionByName(docs.selectExpr("1L as doc_id", "text"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one, two = quality.train(docs.repartition(3), labels), quality.train(docs.repartition(5), labels.repartition(2))
    assert np.array_equal(one["w"], two["w"]) and one["cut"] == two["cut"]


def test_license_scan_of_a_text_of_thousands_of_hits(spark):
    """Hits in one text are found and suppressed in time that grows with their number, at any density."""
    r = random.Random(6)
    bits = ["mit license", "gnu general public license version 2", "gplv2 or later", "apache license version 2 0", "cc by sa 4 0", "word", "spdx license identifier mit"]
    text = " ".join(r.choice(bits) for _ in range(6000))
    few = text[:3000]
    rules = signature_rules()
    out = {x.doc_id: (x.labels, x.n_found) for x in scan_licenses(spark.createDataFrame([(1, text), (2, few), (3, "mit " * 300_000)], SCHEMA + "")).collect()}
    for i, t in ((1, text), (2, few)):
        words = re.sub(license_scan.SEPARATORS, " ", f" {t} ")
        found = sorted((m.start(), m.start() - m.end(), p, k, m.end(), label) for k, label, p, _, x, _ in rules for m in re.finditer(f"(?i) (?:{x})(?= )", words))
        stand = [a for n, a in enumerate(found) if not any(b[0] <= a[0] and a[4] <= b[4] and (b[2], b[1], b[3]) < (a[2], a[1], a[3]) for b in found[max(0, n - 400) : n])]
        assert out[i] == (",".join(sorted({a[5] for a in stand} | set(filter(None, base_of(t)[4].split(","))))), len(stand))
    assert out[3] == ("", 0)


def test_hand_written_signatures():
    lines = license_scan.SIGNATURES.strip().splitlines()
    assert len(lines) == len(set(lines)) >= 200 and len({x.split("|")[0] for x in lines}) > 120


def test_leaks_of_items_and_texts_of_one_repeated_letter(spark):
    """Runs of one q-gram and many short items stay within memory; very long texts are searched whole."""
    items = [(1, "a" * 900), (2, "the quick brown fox jumps over it"), *((10 + i, f"item number {i:05d}") for i in range(3000))]
    docs = [(1, "a" * 60_000), (2, "b" * 50_000), (3, "x " * 400_000 + "the quick brown fox jumps over it"), (4, "item number 00077"), (5, None)]
    out = contaminations(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), rate=0.0).collect()
    assert sorted((x.doc_id, x.item_id) for x in out) == [(1, 1), (3, 2), (4, 87)]


def test_repeated_benchmark_rows_are_one_item_of_one_block(spark, monkeypatch):
    """Copies of an item neither fill a block nor count again."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    item = "the quick brown fox jumps over the lazy dog once more"
    items = spark.createDataFrame([(1, item)] * 50 + [(2, item), (3, "an unrelated sentence of the benchmark")], "item_id long, text string")
    built = []
    make = decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda rows, **how: built.append(len(rows)) or make(rows, **how))
    found = decontaminate.contaminations(spark.createDataFrame([(7, f"Well, {item}!")], "doc_id long, text string"), items)
    assert sorted((r["doc_id"], r["item_id"], r["edits"], r["n_places"]) for r in found.collect()) == [(7, 1, 0, 1), (7, 2, 0, 1)]
    assert sum(built) == 3


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_hot_keys_of_a_join(spark, monkeypatch, most):
    """Keys above the bound are met by broadcast, the others by a shuffle, with equal rows; few keys are broadcast."""
    monkeypatch.setattr(common, "HOT_ROWS", most)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = spark.createDataFrame([(k, i) for k in range(12) for i in range(k)], "k long, i long")
    facts = spark.createDataFrame([(k, k, k * k) for k in range(1, 12)], "k long, __n long, sq long")
    found = sorted(tuple(r) for r in common.looked_up(rows, facts, ["k"], 66).select("k", "i", "sq").collect())
    assert found == sorted((k, i, k * k) for k in range(12) for i in range(k))


def test_all_tokens_of_a_url_combine_where_asked(spark):
    """Ten tokens of a url combine, of which the two that decide say least by themselves."""
    r = random.Random(9)
    rows = []
    for _ in range(400):
        a, b = r.random() < 0.5, r.random() < 0.5
        block = a != b if a or b else r.random() < 0.5
        rest = [f"s{i}" for i in range(8) if r.random() < (0.97 if block else 0.9)]
        rows.append(([*["a"] * a, *["b"] * b, *rest], "block" if block else "allow"))
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    for n in (None, 3):
        out = mine_rules(df, min_support=0.05, min_confidence=0.9, combined=n).collect()
        assert n == 3 or ("a", "b") in {tuple(x.tokens) for x in out}
        for x in out:  # confidence and support are those over whole urls, whatever combines
            having = [v for t, v in rows if set(x.tokens) <= set(t)]
            assert x.confidence == pytest.approx(having.count(x.verdict) / len(having)) and x.support == pytest.approx(having.count(x.verdict) / len(rows))
