"""The trie of conversation prefixes against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fabrel.llm import prefix_trie
from fabrel.llm.prefix_trie import shared_prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + t[h:])
    nodes = defaultdict(list)
    for c, t in sorted(built.items()):
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = [str(c) for c in members if len(built[c]) == len(p)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), kids(p), sum(kids(q) == 0 for q in below), saved, hashlib.sha256(",".join(ends).encode()).hexdigest(), len(ends)))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def conversations(seed, groups=3, longest=11):
    """Conversations of a few hundreds, which share turns by chance and by copies; one conversation is much longer."""
    r = random.Random(seed)
    rows = []
    for c in sorted({*r.sample(range(100 * groups), 25), *range(5)}):
        for t in range(40 if c == 3 else r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "é\U0001f600", "bb"])))
    return rows


@pytest.mark.parametrize(("seed", "piece"), [(1, 1 << 14), (2, 2)])
def test_nodes(spark, monkeypatch, seed, piece):
    """piece: at 2 ids the list of a node's ends is joined from several pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = conversations(seed)
    if seed == 2:  # copies of one conversation, in groups of their own
        rows = [x for x in rows if x[0] < 100] + [(c, t, "user", str(t)) for c in range(300, 9000, 300) for t in range(7)]
    r = random.Random(seed)
    r.shuffle(rows)
    assert found(shared_prefixes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(None, 1, "user", "x"), (200, None, None, "late"), (200, 0, "user", None), (200, 0, "assistant", "tie"), (200, 0, "assistant", "tie"), (205, 1, "user", "only"), (317, 1, "user", "alone"), (318, 2, None, None)]
    rows += [(200, 5, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "'k' as key", "2 as n", "3 as depth", "4 as name", "5 as __n")
    assert found(shared_prefixes(df)) == brute(rows)
    assert any(n[3] > 1 and n[8] for n in found(shared_prefixes(df)) if n[1] == 0)  # a rebuilt conversation without turns ends at the root
    assert shared_prefixes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_node_of_all(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 3000, 100)]
    assert found(shared_prefixes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
