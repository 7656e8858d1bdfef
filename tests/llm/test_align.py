"""Token alignment against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from fabrel.llm import align
from fabrel.llm.align import BYTE_LEVEL, FILES, PIECES, Aligner, ByteLevel, Pieces, align_tokens

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def encoders():
    with open(f"{FILES}/{BYTE_LEVEL}", "rb") as f, open(f"{FILES}/{PIECES}", "rb") as g:
        return ByteLevel(f.read()), Pieces(g.read())


def brute(docs, a, b):
    rows, links, holders = [], [], defaultdict(set)
    for k, (doc, text) in enumerate(docs):
        ids_a, ids_b = (e.encode([text])[0] if text else [] for e in (a, b))
        goal = b" " + (text or "").encode()
        if not text or b"".join(a.bytes[i] for i in ids_a) != goal or b"".join(b.bytes[i] for i in ids_b) != goal:
            rows.append((doc, 0, 0, 0, "")), links.append(Counter())
            continue
        groups, one, two, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b and i < len(ids_a):
                one.append(ids_a[i]), (at_a := at_a + len(a.bytes[ids_a[i]])), (i := i + 1)
            else:
                two.append(ids_b[j]), (at_b := at_b + len(b.bytes[ids_b[j]])), (j := j + 1)
            if at_a == at_b:
                groups.append((one, two))
                one, two = [], []
        c = Counter((x, y) for g, h in groups for x in g for y in h)
        for p in c:
            holders[p].add(k)
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((doc, len(ids_a), len(ids_b), len(groups), hashlib.sha256(text.encode()).hexdigest())), links.append(c)
    most = defaultdict(int)
    for (x, _), d in holders.items():
        most[x] = max(most[x], len(d))
    out = []
    for (doc, n_a, n_b, n_g, sha), c in zip(rows, links, strict=True):
        best = sum(m for p, m in c.items() if len(holders[p]) == most[p[0]])
        out.append((doc, n_a, n_b, n_g, sum(c.values()), best, sum(m * len(holders[p]) for p, m in c.items()), sha))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "Straße", "naïve", "日本語", "\U0001f600\U0001f468‍\U0001f469", "foo_bar", "1234567", "antidisestablish", "\t", "\n\n", "   ", "<|endoftext|>", "<s>", "</s>", "<0x41>", "ﬁ", "é", " ", "\x00\x01"]
    docs = ["".join(r.choice(words) + r.choice([" ", "", ", "]) for _ in range(r.choice([1, 2, 8, 60]))) for _ in range(60)]
    return list(enumerate([*docs, docs[0], None, "", " ", "▁ under", "x" * 3000, " " * 700, "".join(r.choice("abcdef0189+/") for _ in range(5000))]))


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("chunk", "expanded", "held", "sent", "known"), [(1 << 18, 1 << 20, 1 << 19, 1 << 21, 1 << 17), (100, 50, 40, 1 << 21, 9), (1 << 18, 5, 1 << 19, 300, 1 << 17), (1 << 18, 1 << 20, 1 << 19, 0, 1 << 17)])
def test_alignment(spark, monkeypatch, encoders, chunk, expanded, held, sent, known):
    """expanded: small, groups are expanded by distinct ids; held: small, counts are handed on in parts; sent: small or 0, some
    or all links meet their counts by a shuffle."""
    for name, value in (("CHUNK", chunk), ("EXPANDED", expanded), ("HELD", held), ("SENT", sent), ("KNOWN", known)):
        monkeypatch.setattr(align, name, value)
    docs = corpus(1)
    assert found(align_tokens(spark.createDataFrame(docs, SCHEMA).repartition(3))) == brute(docs, *encoders)


def test_cutting_at_spaces_changes_nothing(encoders):
    r = random.Random(5)
    whole, cut = Aligner(*encoders), Aligner(*encoders)
    whole.cuts = False
    signs = ["a", "Zu", "é", "9", "!", "'s", " ", "  ", "\n", "\t ", "\u00a0", "\u3000", "\u200b", "\x1c", "\u0301", "日", "\U0001f600", "\u1c89", "▁"]
    for _ in range(20):
        texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 12))) for _ in range(200)]
        for x, y in zip(whole.documents(texts), cut.documents(texts), strict=True):
            assert list(x) == list(y) if isinstance(x, list) else (x == y).all()
    assert cut.place.keys() != whole.place.keys()


def test_special_strings_are_plain_text(encoders):
    a, b = encoders
    assert 50256 not in a.encode(["<|endoftext|>"])[0]
    assert a.cuts and b.cuts  # texts are cut at spaces
    numbers, digests, *_ = Aligner(a, b).documents(["<|endoftext|>", "▁", "", "ok"])
    assert numbers[:, 0].astype(bool).tolist() == [True, False, False, True]  # U+2581 comes back as a space
    assert [bool(d) for d in digests] == [True, False, False, True]


def test_a_group_of_many_tokens(spark):
    """Tokens of two letters against tokens of three, shifted, never end together before the text does."""

    class Every:
        def __init__(self, n):
            self.n, self.cuts, self.bytes = n, False, [bytes([c]) * k for k in range(1, 4) for c in b" ab"]

        def encode(self, texts):
            return [self.cut(f" {t}".encode()) for t in texts]

        def cut(self, text):
            out, at = [0], 1
            while at < len(text):
                k = self.n if text[at : at + self.n] == text[at : at + 1] * self.n and at + self.n < len(text) else 1
                out.append(3 * (k - 1) + b" ab".index(text[at]))
                at += k
            return out

    docs = [(1, "a" * 601), (2, "ab" * 50), (3, "a" * 7)]
    assert found(align_tokens(spark.createDataFrame(docs, SCHEMA), encoders=lambda: (Every(2), Every(3)))) == brute(docs, Every(2), Every(3))


def test_nulls_repeats_clashing_names_and_empty_tables(spark, encoders):
    docs = [(None, "a b"), (None, "a b"), (4, "a b"), (4, "c"), (5, None)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as row", "2 as pairs", "3 as pair", "4 as n_a", "true as counts")
    assert found(align_tokens(df)) == brute(docs, *encoders)
    assert align_tokens(spark.createDataFrame([], SCHEMA)).collect() == []
