"""Fields that wait for other tables, keys known late, counts, shares, lists and texts of regexes."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fabrel.errors import ConstraintViolation, CycleError, GenerationError, ParseError, UniquenessExhausted
from fabrel.functions.regexes import LARGE, Regex, is_regex
from fabrel.operators import totals
from fabrel.operators.constraints import DRAWS, unique_values
from fabrel.operators.dimensions import dimension, list_of
from fabrel.plans.generate import generate
from fabrel.plans.stages import Stages
from fabrel.sources.ddl import parse_document


def doc(text, **volume):
    d = parse_document(f"domain: x\nseed: 5\n{text}")
    d.volume |= volume
    return d


TOTALS = """
entities:
  P: {id: int @primary, cs: "[C]", total: int @derived(sum(cs.v)), twice: int @derived(total * 2), best: int @derived(max(cs.left))}
  C: {id: int @primary, p: ->P, v: int @range(1..9), of: int @derived(p.total), left: int @derived(of - v)}
"""


def test_stages_follow_edges_between_rows():
    s = Stages(doc(TOTALS), lambda e: False).stage
    assert {n[1]: k for n, k in s.items()} == {"total": 1, "twice": 1, "of": 2, "left": 2, "best": 3}


def test_only_what_is_needed_is_made(spark):
    out = generate(spark, doc(TOTALS, P=3, C=9), entity="P")
    assert list(out) == ["P"] and out["P"].where("twice <> 2 * total").isEmpty()
    assert out["P"].columns == ["id", "total", "twice", "best"]


def test_cycles():
    with pytest.raises(CycleError, match=r"P.t, C.v"):
        Stages(doc("entities:\n  P: {id: int @primary, cs: '[C]', t: int @derived(sum(cs.v))}\n  C: {id: int @primary, p: ->P, v: int @derived(p.t)}"), lambda e: False)


def test_own_rows_are_read_late(spark):
    a = generate(spark, doc("entities: {A: {id: int @primary, up: '->self?', v: int @range(1..9), above: {type: int, default_chain: [up.v], fallback: '0'}}}", A=60))["A"]
    met = a.alias("a").join(a.alias("b"), F.expr("a.up = b.id"), "left").where("a.above <> coalesce(b.v, 0)")
    assert met.isEmpty() and a.where("up is not null").count() > 3


CROSS = """
entities:
  P: {id: int @primary, mixed: int @range(0..0), after: int @derived(mixed + 1)}
  C: {id: int @primary, p: ->P, v: "enum(a, b)", seen: int @derived(p.mixed)}
rules:
  - cross_row: {entity: C, group_by: p, check: all_equal(v), on_violation: {set: {P.mixed: "1"}}}
"""


def test_rules_on_what_a_rule_sets(spark):
    out = generate(spark, doc(CROSS, P=5, C=40))
    assert out["P"].where("after <> mixed + 1").isEmpty() and out["C"].where("seen = 1").count() > 10
    with pytest.raises(ConstraintViolation, match="mixed == 0"):
        generate(spark, doc(CROSS + "  - P.mixed == 0 @strict", P=5, C=40))


def test_conflicting_sets_in_one_field_come_in_order(spark):
    more = '  - cross_row: {entity: C, group_by: p, check: all_equal(v), on_violation: {set: {P.mixed: "mixed + 5"}}}'
    assert {r["mixed"] for r in generate(spark, doc(CROSS + more, P=5, C=60))["P"].collect()} <= {0, 6}


def test_counts(spark):
    text = "entities:\n  P: {id: int @primary, cs: '[C] @count(2..3)'}\n  C: {id: int @primary, p: ->P}\n"
    sizes = lambda out: Counter(r["count"] for r in out["C"].groupBy("p").count().collect())
    assert set(sizes(generate(spark, doc(text, P=30)))) == {2, 3}
    given_ = generate(spark, doc(text, P=30, C=71))
    assert sizes(given_) == {2: 19, 3: 11} and given_["C"].count() == 71
    with pytest.raises(ConstraintViolation, match="91 rows"):
        generate(spark, doc(text, P=30, C=91))
    with pytest.raises(GenerationError, match="no number"):
        generate(spark, doc(text + "rules: ['count(P.cs) >= 4 @strict']", P=3))
    some = generate(spark, doc(text.replace(" @count(2..3)", "") + "rules: ['count(P.cs) in 3..3 @probability(0.5)']", P=60))
    assert 20 < sizes(some)[3] < 60 and len(sizes(some)) > 2
    with pytest.raises(ConstraintViolation):
        generate(spark, doc(text.replace(" @count(2..3)", "") + "rules: ['sum(P.cs.id) <= 3 @strict']", P=2, C=9))


def test_shares_sum_up(spark):
    text = "entities:\n  O: {id: int @primary, items: '[I] @count(1..5)', total: 'decimal(9,3) @range(0..90)'}\n  I: {id: int @primary, o: ->O, x: 'decimal(9,3) @range(0..4)'}\nrules: ['O.total == sum(O.items.x) @strict']"
    out = generate(spark, doc(text, O=25))
    assert out["O"].join(out["I"].groupBy("o").agg(F.sum("x").alias("s")), F.col("o") == F.col("id")).where("s = total").count() == 25
    derived = text.replace("total: 'decimal(9,3) @range(0..90)'", "total: 'decimal(9,3) @derived(sum(items.x))'")
    assert generate(spark, doc(derived, O=5))["O"].count() == 5  # it holds by itself


def test_shares_by_largest_remainder(spark):
    r = random.Random(2)
    rows = [(i, r.choice("ab"), r.choice([0, 1, 1, 5, 7])) for i in range(60)] + [(90, "c", 0), (91, "c", 0), (92, "c", 0)]
    totals_ = {"a": 1001, "b": 7, "c": 100}
    df = spark.createDataFrame([(*x, totals_[x[1]]) for x in rows], "_rid long, g string, w long, t long")
    found = {x["_rid"]: x["n"] for x in totals.apportioned(df, "g", F.col("w"), F.col("t"), "n").collect()}
    for g, t in totals_.items():
        mine = [x for x in rows if x[1] == g]
        w = [x[2] for x in mine] if sum(x[2] for x in mine) else [1] * len(mine)
        base = [t * x // sum(w) for x in w]
        order = sorted(range(len(w)), key=lambda i: (-(t * w[i] % sum(w)), mine[i][0]))
        for i in order[: t - sum(base)]:
            base[i] += 1
        assert [found[x[0]] for x in mine] == base


def test_running_sums(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).alias("v"))
    out, total = totals.running_sum(df, [F.desc("k")], F.col("v"), "s")
    v = [k * 7 % 13 for k in range(500)]
    assert total == sum(v) and {r["k"]: r["s"] for r in out.collect()} == {k: sum(v[k + 1 :]) for k in range(500)}


LATE = """
entities:
  A: {k: "int @range(1000..9000) @unique @dist(uniform)", pal: "->self?"}
  P: {id: int @primary, name: string}
  S: {name: "string @unique", other: int}
  B: {id: int @primary, x: "->A | ->P", y: "->A | ->S", as: "[->A] @len(0..3)", a: '->A?', friends: "<->A @count(1..2)"}
"""


def test_late_keys(spark):
    out = generate(spark, doc(LATE, A=20, P=5, S=6, B=50))
    a, b = out["A"], out["B"].cache()
    keys = {r["k"] for r in a.collect()}
    assert len(keys) == 20 and all(1000 <= k <= 9000 for k in keys)
    assert {r["pal"] for r in a.collect()} <= keys | {None}
    assert {r["x"]["id"] for r in b.where("x.type = 'A'").collect()} <= keys and {r["x"]["id"] for r in b.where("x.type = 'P'").collect()} <= set(range(1, 6))
    assert {int(r["y"]["id"]) for r in b.where("y.type = 'A'").collect()} <= keys
    assert {r["y"]["id"] for r in b.where("y.type = 'S'").collect()} <= {r["name"] for r in out["S"].collect()}
    lists = [r["as"] for r in b.collect()]
    assert {k for x in lists for k in x} <= keys and {len(x) for x in lists} == {0, 1, 2, 3}
    assert {r["a"] for r in b.collect()} <= keys | {None} and {r["a_id"] for r in out["B.friends"].collect()} <= keys


@pytest.mark.parametrize("pattern", ["[A-Z]{3}-[0-9]+", "^(ab|c)d?[xyz]{2}$", r"\d{2,4}(-\w)?", "[^a-y]b*", "x|yy|[a-c]{0,2}", r"v\.\d+\.(alpha|beta)\d?", "(a|b)(c|d){2}.", r"[\w.]+@ex\.(com|org)"])
def test_regex_texts_match(spark, pattern):
    df = generate(spark, doc(f"entities: {{A: {{id: int @primary, s: 'string @pattern(\"{pattern}\")'}}}}", A=300))["A"]
    texts = [r["s"] for r in df.collect()]
    assert all(re.fullmatch(pattern, t) for t in texts) and len(set(texts)) > 5
    assert df.where(~F.col("s").rlike(f"^(?:{pattern})$")).isEmpty()


@settings(max_examples=25, deadline=None)
@given(st.recursive(st.sampled_from(["a", "b", "[ab]", "[a-c]"]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda p: f"({p[0]}|{p[1]})"), x.map(lambda p: f"({p})?"), x.map(lambda p: f"({p}){{0,2}}")), max_leaves=5))
def test_automaton_counts_texts(pattern):
    """Counted against all texts over the alphabet up to the longest."""
    from itertools import product

    from fabrel.functions.regexes import languages_size

    found = languages_size(Regex(pattern).node)
    if Regex(pattern).count < 2000:
        texts = {"".join(t) for k in range(9) for t in product("abc", repeat=k)} if Regex(pattern).count else set()
        longest = max((len(t) for t in texts if re.fullmatch(pattern, t)), default=0)
        if longest < 8:
            assert found == sum(bool(re.fullmatch(pattern, t)) for t in texts)


def test_regexes_are_enumerated_and_told_from_templates(spark):
    r = Regex("[ab]{1,2}(x|yz)?")
    assert r.spread == r.count == 18
    texts = [x[0] for x in spark.range(18).select(r.text(F.col("id"))).collect()]
    assert len(set(texts)) == 18 and all(re.fullmatch("[ab]{1,2}(x|yz)?", t) for t in texts)
    assert Regex("a?a?").spread is None and Regex(r"\w{30}").spread is None and Regex(r"\w{30}").count > LARGE
    assert [is_regex(p) for p in ("T-{00}", "{AA}{word}", "plain-1.0", "{unknown}", "[A-Z]{2}", "a+", "^x$", "x{3}")] == [False] * 4 + [True] * 4
    for bad in ("(?=a)b", "(", r"(a)\1"):
        with pytest.raises(ParseError):
            Regex(bad)


def test_unique_values_of_finite_spaces(spark):
    text = "entities: {A: {id: int @primary, n: 'int @range(3..52) @unique', e: 'enum(p, q, r) @unique', s: 'string @pattern(\"[ab]{3}[0-9]\") @unique'}}"
    rows = generate(spark, doc(text.replace("e: 'enum(p, q, r) @unique', ", ""), A=50))["A"].collect()
    assert {r["n"] for r in rows} == set(range(3, 53)) and len({r["s"] for r in rows}) == 50
    with pytest.raises(UniquenessExhausted, match="A.e: 4 rows, 3 values"):
        generate(spark, doc(text, A=4))
    with pytest.raises(UniquenessExhausted, match="A.n: 41 rows, 40 values"):  # at once, though a rule makes it go by rounds
        generate(spark, doc("entities: {A: {id: int @primary, n: 'int @range(1..40) @unique'}}\nrules: [A.n > 0 @strict]", A=41))
    bound = generate(spark, doc("entities: {A: {id: int @primary, n: 'int @range(1..400) @unique'}}\nrules: [A.n > 100 @strict]", A=20))["A"].collect()
    assert len({r["n"] for r in bound}) == 20 and all(r["n"] > 100 for r in bound)


def test_unique_values_of_rounds_take_a_whole_space(spark):
    """What draws do not find is dealt, so keys that are known late are whole too."""
    text = "entities:\n  A: {n: 'int @range(3..322) @unique', up: '->self?'}\n  B: {id: int @primary, a: ->A}\nrules: [A.n > 0 @strict]"
    out = generate(spark, doc(text, A=320, B=900))
    rows = out["A"].collect()
    assert sorted(r["n"] for r in rows) == list(range(3, 323)) and {r["up"] for r in rows} <= set(range(3, 323)) | {None}
    assert out["B"].count() == 900 and out["B"].where("a is null or a not between 3 and 322").isEmpty()


def test_draws_go_on_where_a_deal_has_too_few_values(spark):
    """Draws of 1 for all rows until the attempt after the deal, then null."""
    rows = spark.range(5).select(F.col("id").alias("_rid"))
    made = unique_values(rows, lambda a: F.when(a <= DRAWS, F.lit(1)), "c", space=spark.createDataFrame([(1,), (2,)], "c int"))
    assert {r["_rid"]: r["c"] for r in made.collect()} == {0: 1, 1: 2, 2: None, 3: None, 4: None}


def test_narrow_integers(spark):
    out = generate(spark, doc("entities: {A: {id: int @primary, a: int(8) @range(100..300), b: int(16) @range(-99999..5)}}", A=40))["A"]
    assert out.where("a not between 100 and 127 or b not between -32768 and 5").isEmpty()
    with pytest.raises(GenerationError):
        generate(spark, doc("entities: {A: {id: int @primary, a: int(8) @range(200..300)}}", A=4))


def exact_shares(d):
    """The weight of each row of an alias table, times its slots: what the table draws, summed up exactly."""
    out = Counter()
    for r in d.table.collect():
        out[tuple(r["own"])] += r["keep"]
        out[tuple(r["other"])] += d.total - r["keep"]
        assert 0 <= r["keep"] <= d.total
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("weights", [[1] * 7, [1, 2, 3, 4, 5], [100, 1, 1, 1], [1, 1, 1, 1, 100, 100], [7], [3, 0, None, -2, 5], list(range(1, 60)), [1] * 30 + [2, 1000, 3, 999, 50]])
def test_alias_tables_are_exact(spark, weights):
    d = dimension(spark.createDataFrame([(f"v{i:02}", w) for i, w in enumerate(weights)], "v string, weight long"))
    kept = {(f"v{i:02}",): w for i, w in enumerate(weights) if w and w > 0}
    assert d.n == len(kept) and d.total == sum(kept.values())
    assert exact_shares(d) == {k: w * d.n for k, w in kept.items()}


def test_alias_tables_of_random_weights_and_empty_lists(spark):
    r = np.random.default_rng(4)
    w = [int(x) for x in r.zipf(1.4, 300).clip(1, 100_000)]
    d = dimension(spark.createDataFrame([(i, x) for i, x in enumerate(w)], "v long, weight long"))
    assert exact_shares(d) == {(i,): x * 300 for i, x in enumerate(w)}
    assert dimension(spark.createDataFrame([], "v long, weight long")) is None
    even = dimension(spark.range(5).toDF("v"))
    assert exact_shares(even) == {(i,): 5 for i in range(5)}


def test_lists_fit_types():
    lists = {"given_names": ["name", "sex", "weight"], "product_color": ["weight", "value"], "naics": ["code", "name"]}
    assert list_of("person.first", lists) == ("given_names", "name") and list_of("product.color", lists) == ("product_color", "value")
    assert list_of("naics.code", lists) == ("naics", "code") and list_of("naics.level", lists) is None and list_of("person.last", lists) is None


def test_lists_from_a_folder(spark, tmp_path):
    from fabrel.operators.lists import prepare_lists

    folder = f"file://{tmp_path}/lists"
    prepare_lists({"given_names": lambda: spark.createDataFrame([("Zoe", "f", 9), ("Yan", "m", 1)], "name string, sex string, weight long")}, folder)
    text = "entities: {A: {id: int @primary, f: person.first, g: 'person.first @unique', l: person.last, o: 'person.first?'}}"
    rows = generate(spark, doc(text, A=20), lists=folder)["A"].collect()
    assert {r["f"] for r in rows} <= {"Zoe", "Yan"} and {r["o"] for r in rows} <= {"Zoe", "Yan", None} and not {r["g"] for r in rows} <= {"Zoe", "Yan"}


def test_time_zones_of_listed_cities(spark):
    cities = spark.createDataFrame([("Albany", "Europe/Own", 5), ("Austin", "Europe/Other", 3), ("Boston Heights", "Europe/None", 1)], "name string, timezone string, population long")
    text = "entities: {A: {id: int @primary, where: address.full, timezone: 'string @from(where)', zone: 'string @from(where)'}}"
    df = generate(spark, doc(text, A=300), lists={"cities": cities})["A"]
    odd = df.where("timezone <> case when where like '%Albany%' then 'Europe/Own' when where like '%Austin%' then 'Europe/Other' else 'America/New_York' end")
    assert odd.isEmpty() and df.where("timezone like 'Europe%'").count() > 5 and df.columns == ["id", "where", "timezone", "zone"]
