import pytest

from fabrel.errors import CycleError, ParseError
from fabrel.model import Type
from fabrel.plans.order import closure, describe, entity_order, validate, volumes
from fabrel.sources.ddl import parse_document, parse_field, parse_rule, parse_type, split_decorators


@pytest.mark.parametrize(
    ("text", "kind", "name"),
    [("string(50)", "prim", "string"), ("decimal(10, 2)", "prim", "decimal"), ("enum(a, b)", "enum", ""), ("[string]", "list", ""), ("{string: int}", "map", ""), ("(float, float)", "tuple", ""),
     ("string?", "optional", ""), ("string | int", "union", ""), ("->User", "ref", "User"), ("->self?", "ref", "self"), ("<->Tag", "ref", "Tag"), ("->A | ->B", "poly", ""), ("person.full", "semantic", "person.full"),
     ('accounting.group("ES")', "semantic", "accounting.group"), ("Priority", "named", "Priority")],
)
def test_types(text, kind, name):
    t = parse_type(text)
    assert (t.kind, t.name) == (kind, name)


def test_optional_and_many_references():
    assert parse_type("->User?").optional and parse_type("->[Post]").many and parse_type("<->Tag").many
    assert parse_type("[Post]") == Type("list", items=(Type("named", "Post"),))


def test_decorators():
    kind, ds = split_decorators('string @unique @pattern("AB-{00}@x") @len(3..9) @dist(normal, mu=5, sigma=2)')
    assert kind == "string" and [d.name for d in ds] == ["unique", "pattern", "len", "dist"]
    assert ds[1].args == ("AB-{00}@x",) and ds[3].option("mu") == "5" and ds[3].args == ("normal",)
    assert split_decorators("int @dist(bimodal, peaks=20,80)")[1][0].named == (("peaks", "20"), ("peaks", "80"))
    assert split_decorators("float @derived(if(a > 1, b, c))")[1][0].args == ("if(a > 1, b, c)",)


def test_rules():
    r = parse_rule('if Order.status == "shipped" then Order.at != null @probability(0.8)')
    assert (r.entity, r.mode, r.probability, r.when) == ("Order", "probability", 0.8, 'Order.status == "shipped"')
    assert parse_rule("unique(A.x, A.y)").kind == "unique"
    assert parse_rule({"when": "A.x == 1", "assert": "A.y > 2", "severity": "warn"}).mode == "warn"


def test_document_errors():
    for text in ("entities: {}", "- a", "domain: [", "domain: x\nvolume: {A: much}", "domain: x\nentities: {A: {tags: [Post]}}"):
        with pytest.raises(ParseError):
            parse_document(text)


DOC = """
domain: d
volume: {A: 10, B: "4..8", C: ~}
entities:
  C: {id: uuid @primary, b: ->B}
  B: {id: uuid @primary, a: "->A?"}
  A: {id: uuid @primary, self_: "->self?"}
  D: {id: uuid @primary}
"""


def test_order_and_volume():
    doc = parse_document(DOC)
    assert entity_order(doc) == ["A", "B", "C", "D"]
    assert volumes(doc, {"D": 3}) == {"C": 100, "B": 6, "A": 10, "D": 3}
    assert closure(doc, "C") == {"A", "B", "C"}
    assert validate(doc) == [] and describe(doc)[0][:2] == ("A", 10)


def test_cycles_and_unknowns():
    doc = parse_document("domain: d\nentities: {A: {b: ->B}, B: {a: ->A}}")
    with pytest.raises(CycleError):
        entity_order(doc)
    assert any("unknown" in m for m in validate(parse_document("domain: d\nentities: {A: {b: ->X, t: Nope}}")))


def test_field_mapping():
    f = parse_field("x", {"type": "float @min(0)", "label": "X", "default_chain": ["a.b"], "fallback": "0.0"})
    assert f.label == "X" and f.default_chain == ("a.b",) and f.is_derived and f.has("min")
