import pytest
from pyspark.sql import functions as F

from fabrel.errors import ConstraintViolation, UniquenessExhausted
from fabrel.operators.references import orphans
from fabrel.plans.generate import generate, warnings
from fabrel.sources.ddl import parse_document
from fabrel.streaming import entity_rows

SHOP = """
domain: shop
seed: 42
volume: {Team: 5, User: 60, Order: 200, Tag: 12}
enums:
  Status: [open, shipped, closed]
types:
  Address: {street: address.street, city: address.city}
entities:
  Team: {id: 'string @primary @pattern("T-{00}")', name: company.name @unique}
  User:
    _coherence: {location: [city, state, zip, timezone]}
    _meta: "@timestamps @versioned"
    id: uuid @primary
    team: ->Team
    boss: "->self?"
    name: person.full
    email: email @from(name)
    age: int @range(18..65)
    home: Address
    city: string
    state: string
    zip: string
    timezone: string
    orders: "[Order]"
    tags: "<->Tag @count(1..3)"
    n_orders: int @derived(count(orders))
  Tag: {id: uuid @primary, label: string @unique}
  Order:
    id: uuid @primary
    user: ->User
    status: Status @dist(20, 50, 30)
    amount: float @range(0<..500) @dist(normal, mu=100, sigma=60)
    step: float @range(1..50) @multiple_of(0.25)
    codes: "[int] @unique_items @len(1..3)"
    placed: datetime
    shipped: datetime @after(placed)
    fee: float @derived(round(amount * 0.1, 2))
    buyer: string @derived(user.name)
    label: string @derived(if(status == "open", "todo", concat(status, "!")))
    team_name: {type: string, default_chain: [user.team.name], fallback: "'none'"}
    days: {type: int, compute: [{when: "starts_with(status, 'open')", value: "5"}, {else: "9"}]}
rules:
  - Order.amount > 20 @strict
  - if Order.status == "open" then Order.amount < 400
  - User.age >= 30 @warn
"""


@pytest.fixture(scope="module")
def shop(spark):
    return {n: df.cache() for n, df in generate(spark, parse_document(SHOP)).items()}


def test_counts_and_links(shop):
    assert {n: shop[n].count() for n in ("Team", "User", "Order", "Tag")} == {"Team": 5, "User": 60, "Order": 200, "Tag": 12}
    assert orphans(shop["Order"], shop["User"], "user", "id").isEmpty() and orphans(shop["User"], shop["Team"], "team", "id").isEmpty()
    assert orphans(shop["User"], shop["User"], "boss", "id").isEmpty() and shop["User"].where("boss is not null").count() > 0
    links = shop["User.tags"].groupBy("user_id").count()
    assert links.where("count not between 1 and 3").isEmpty() and links.count() == 60


def test_values(shop):
    o, u = shop["Order"], shop["User"]
    assert o.where("amount <= 20 or amount > 500 or abs(step * 4 - round(step * 4)) > 1e-9 or step not between 1 and 50").isEmpty()
    assert o.where("status = 'open' and amount >= 400").isEmpty()
    assert o.where("shipped <= placed or size(codes) not between 1 and 3 or size(codes) <> size(array_distinct(codes))").isEmpty()
    assert o.where("abs(fee - amount * 0.1) > 0.0051 or label <> if(status = 'open', 'todo', status || '!') or days <> if(status = 'open', 5, 9)").isEmpty()
    assert u.where("age not between 18 and 65 or email not like '%@%' or version <> 1 or created_at is null or home.city is null").isEmpty()
    assert u.select("id").distinct().count() == 60 and shop["Tag"].select("label").distinct().count() == 12


def test_derived_over_tables(shop):
    o, u, t = (shop[n] for n in ("Order", "User", "Team"))
    joined = o.join(u.select(F.col("id").alias("uid"), "name", "team"), F.col("user") == F.col("uid")).join(t.select(F.col("id").alias("tid"), F.col("name").alias("tname")), F.col("team") == F.col("tid"))
    assert joined.count() == 200 and joined.where("buyer <> name or team_name <> tname").isEmpty()
    assert u.agg(F.sum("n_orders")).first()[0] == 200


def test_same_seed_same_data_whatever_the_partitions(spark, shop):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = generate(spark, parse_document(SHOP))["Order"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again.exceptAll(shop["Order"]).isEmpty()
    other = generate(spark, parse_document(SHOP), seed=7)["User"].select("name")
    assert other.exceptAll(shop["User"].select("name")).count() > 0


def test_stream_rows_are_batch_rows(spark):
    doc = parse_document("domain: x\nseed: 3\nvolume: {A: 20}\nentities: {A: {id: uuid @primary, n: int @range(1..9), w: person.full}}")
    rows = entity_rows(spark, doc, "A", spark.range(20).select(F.col("id").alias("_rid"))).drop("_rid")
    assert rows.exceptAll(generate(spark, doc)["A"]).isEmpty()


def test_projection_and_volume(spark):
    out = generate(spark, parse_document(SHOP), entity="Tag", volume={"Tag": 4})
    assert list(out) == ["Tag"] and out["Tag"].count() == 4


def test_failures(spark):
    small = parse_document("domain: x\nvolume: {A: 9}\nentities: {A: {id: uuid @primary, c: 'int @range(1..3) @unique'}}")
    with pytest.raises(UniquenessExhausted):
        from fabrel.operators import constraints

        constraints.UNIQUE_ATTEMPTS, keep = 4, constraints.UNIQUE_ATTEMPTS
        try:
            constraints.unique_values(spark.range(9).select(F.col("id").alias("_rid")), lambda a: F.lit(1) + a * 0, "c", attempts=3)
        finally:
            constraints.UNIQUE_ATTEMPTS = keep
    assert small.entities["A"].key.name == "id"
    impossible = parse_document("domain: x\nvolume: {A: 3}\nentities: {A: {id: uuid @primary, c: int @range(1..3)}}\nrules: [A.c > 5 @strict]")
    with pytest.raises(ConstraintViolation):
        generate(spark, impossible)


def test_warnings(shop):
    n = warnings(shop, parse_document(SHOP))
    assert n == {"User.age >= 30": shop["User"].where("age < 30").count()}


def doc(text):
    return parse_document("domain: x\nseed: 5\n" + text)


def test_rules_see_unique_and_derived_values(spark):
    rows = generate(spark, doc("volume: {A: 40}\nentities: {A: {id: uuid @primary, n: 'int @range(1..60) @unique', m: int @range(1..90), twice: int @derived(n * 2)}}\nrules: [A.n < A.m @strict]"))["A"].collect()
    assert len({r.n for r in rows}) == 40 and all(r.n < r.m and r.twice == 2 * r.n for r in rows)


def test_unique_rule_that_cannot_hold(spark):
    with pytest.raises(ConstraintViolation):
        generate(spark, doc("volume: {A: 40}\nentities: {A: {id: uuid @primary, k: int @range(1..2), v: int @range(1..2)}}\nrules: ['unique(A.k, A.v) @strict']"))
    rows = generate(spark, doc("volume: {A: 30}\nentities: {A: {id: uuid @primary, k: int @range(1..20), v: int @range(1..20)}}\nrules: ['unique(A.k, A.v)', A.k <= A.v]"))["A"].collect()
    assert len({(r.k, r.v) for r in rows}) == 30 and all(r.k <= r.v for r in rows)


PAIRS = "volume: {A: %d}\nentities: {A: {id: int @primary, k: int @range(1..6), v: int @range(4..9), w: int @range(1..9), e: 'enum(p, q, r)', s: 'string @pattern(\"[ab]{2}\")'}}\n"


def test_unique_rule_that_takes_all_combinations(spark):
    """What draws do not find is dealt; the first row that draws a combination keeps it."""
    rows = generate(spark, doc(PAIRS % 36 + "rules: ['unique(A.k, A.v) @strict']"))["A"].collect()
    assert sorted(r.id for r in rows) == list(range(1, 37)) and {(r.k, r.v) for r in rows} == {(k, v) for k in range(1, 7) for v in range(4, 10)}
    drawn = {}
    for r in sorted(generate(spark, doc(PAIRS % 36))["A"].collect()):
        drawn.setdefault((r.k, r.v), r.id)
    assert drawn.items() <= {(r.k, r.v): r.id for r in rows}.items() and len(drawn) < 36
    texts = generate(spark, doc(PAIRS % 12 + "rules: ['unique(A.e, A.s) @strict']"))["A"].collect()
    assert {(r.e, r.s) for r in texts} == {(e, a + b) for e in "pqr" for a in "ab" for b in "ab"} and len(texts) == 12


def test_dealt_rows_keep_the_other_rules(spark):
    """21 pairs keep the first rule, which is on them alone; the second is on another field; two sets of fields bind at once."""
    text = PAIRS % 21 + "rules: ['unique(A.k, A.v) @strict', A.k + 3 <= A.v @strict, A.w > A.k @strict, 'unique(A.v, A.w, A.e, A.s) @strict']"
    rows = generate(spark, doc(text))["A"].collect()
    assert sorted((r.k, r.v) for r in rows) == [(k, v) for k in range(1, 7) for v in range(k + 3, 10)]
    assert all(r.w > r.k for r in rows) and len({(r.v, r.w, r.e, r.s) for r in rows}) == 21


def test_unique_rule_with_more_rows_than_combinations(spark):
    with pytest.raises(ConstraintViolation, match="A: 37 rows, 36 combinations"):
        generate(spark, doc(PAIRS % 37 + "rules: ['unique(A.k, A.v) @strict']"))


def test_parents_known_by_any_first_field(spark):
    """A text, a unique number (known only once rows are made), and rules that make parents again."""
    out = generate(spark, doc("volume: {A: 8, U: 9, B: 30}\nentities:\n  A: {name: string, n: int @range(1..9), up: '->self?'}\n  U: {n: 'int @range(1..40) @unique', t: string}\n  B: {id: uuid @primary, a: ->A, u: ->U, t: string @derived(u.t)}\nrules: [A.n > 3 @strict]"))
    assert out["A"].where("n <= 3").isEmpty() and out["B"].count() == 30
    assert orphans(out["B"], out["A"], "a", "name").isEmpty() and orphans(out["B"], out["U"], "u", "n").isEmpty() and orphans(out["A"], out["A"], "up", "name").isEmpty()
    assert out["B"].where("a is null or u is null or t is null").isEmpty()


def test_count_rules_and_all_kinds_of_warnings(spark):
    text = "volume: {P: 6, C: 30}\nentities:\n  P: {id: int @primary, cs: '[C]', n: int @derived(count(cs))}\n  C: {id: int @primary, p: ->P, k: int @range(1..3), v: 'enum(a, b)'}\nrules: ['count(P.cs) > {} @strict', 'unique(C.k) @warn', 'C.p.n >= 3 @warn', 'count(P.cs) in 0..4 @warn']"
    out = generate(spark, doc(text.replace("{}", "0")))
    n = warnings(out, doc(text.replace("{}", "0")))
    assert n == {"unique(C.k)": 3, "C.p.n >= 3": out["P"].where("n < 3").selectExpr("sum(n)").first()[0] or 0, "count(P.cs) in 0..4": out["P"].where("n > 4").count()}
    with pytest.raises(ConstraintViolation):
        generate(spark, doc(text.replace("{}", "20")))


def test_rule_across_rows_sets_fields_of_its_own_groups(spark):
    out = generate(spark, doc("volume: {A: 60}\nentities: {A: {id: uuid @primary, g: int @range(1..9), v: 'enum(a, b)'}}\nrules: [{cross_row: {entity: A, group_by: g, check: all_equal(v), probability: 1.0, on_violation: {set: {A.v: \"'x'\"}}}}]"))["A"]
    assert out.groupBy("g").agg(F.count_distinct("v").alias("n")).where("n > 1").isEmpty() and not out.where("v = 'x'").isEmpty()
