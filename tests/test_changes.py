"""Change sets against what they say."""

from datetime import datetime

import pytest

from fabrel.errors import ConstraintViolation, ValidationError
from fabrel.operators.changes import Change, apply_changes
from fabrel.sources.ddl import parse_document

DOC = parse_document("""
domain: x
entities:
  Team:
    _triggers: [{on: people, recompute: [n, pay]}]
    id: int @primary
    name: string
    people: "[Person]"
    n: int @derived(count(people))
    pay: float @derived(sum(people.pay))
  Person:
    _meta: "@versioned @timestamps"
    _triggers: [{on: pay, recompute: [level, note], validate: [pay]}, {on: level, recompute: [note]}]
    id: int @primary
    team: ->Team @cascade
    boss: "->self? @cascade"
    pay: float
    born: int @immutable
    city: string @default(Bonn)
    level: {type: string, compute: [{when: "pay > 10", value: "'high'"}, {else: "'low'"}]}
    note: string @derived(concat(level, "!"))
    tags: "<->Tag"
  Tag: {id: int @primary, label: string}
  Badge: {id: int @primary, person: ->Person}
  Log: {_meta: "@readonly", id: int @primary, team: "->Team?"}
  Soft: {_meta: "@soft_delete", id: int @primary, team: "->Team?"}
rules: [Person.pay < 100 @strict]
""")
WHEN = datetime(2024, 2, 2)


@pytest.fixture
def tables(spark):
    stamp = "timestamp_ntz'2020-01-01 00:00:00'"
    return {
        "Team": spark.createDataFrame([(1, "a", 2, 9.0), (2, "b", 3, 9.0), (3, "c", 0, 0.0)], "id long, name string, n long, pay double"),
        "Person": spark.createDataFrame([(1, 1, None, 5.0, 70, "x", "?", "?"), (2, 1, 1, 4.0, 71, "x", "?", "?"), (3, 2, None, 3.0, 72, "x", "?", "?"), (4, 2, 2, 3.0, 73, "x", "?", "?"), (5, 2, 4, 3.0, 74, "x", "?", "?")], "id long, team long, boss long, pay double, born long, city string, level string, note string").selectExpr("*", f"{stamp} as created_at", f"{stamp} as updated_at", "1L as version"),
        "Tag": spark.createDataFrame([(1, "t")], "id long, label string"),
        "Person.tags": spark.createDataFrame([(1, 1), (3, 1)], "person_id long, tag_id long"),
        "Badge": spark.createDataFrame([(1, 3)], "id long, person long"),
        "Log": spark.createDataFrame([(1, 1), (2, 3)], "id long, team long"),
        "Soft": spark.createDataFrame([(1, 1), (2, 2)], "id long, team long").selectExpr("*", "cast(null as timestamp_ntz) as deleted_at"),
    }


def ids(df, *more):
    return sorted(tuple(r) for r in df.select("id", *more).collect())


def test_delete_closes_over_references(spark, tables):
    out = apply_changes(tables, DOC, [Change("Team", "delete", spark.createDataFrame([(1,)], "id long"))])
    assert ids(out["Team"], "n", "pay") == [(2, 1, 3.0), (3, 0, 0.0)]  # 2 and its boss go, and by chains of bosses 4 and 5
    assert ids(out["Person"]) == [(3,)] and out["Person.tags"].collect() == [(3, 1)]
    assert ids(out["Log"], "team") == [(1, None), (2, 3)] and ids(out["Soft"], "team") == [(1, None), (2, 2)]
    assert ids(tables["Person"])[0] == (1,)
    with pytest.raises(ConstraintViolation, match="rows of Badge refer to it by person"):
        apply_changes(tables, DOC, [Change("Team", "delete", spark.createDataFrame([(2,)], "id long"))])
    both = [Change("Badge", "delete", spark.createDataFrame([(1,)], "id long")), Change("Team", "delete", spark.createDataFrame([(2,), (9,)], "id long"))]
    assert ids(apply_changes(tables, DOC, both)["Person"]) == [(1,), (2,)]


def test_soft_delete_keeps_the_row(spark, tables):
    out = apply_changes(tables, DOC, [Change("Soft", "delete", spark.createDataFrame([(2,)], "id long"))], now=WHEN)
    assert ids(out["Soft"], "deleted_at") == [(1, None), (2, WHEN)]


def test_update_runs_triggers_on_touched_rows(spark, tables):
    rows = spark.createDataFrame([(1, 20.0), (3, 3.0), (99, 1.0)], "id long, pay double")
    out = apply_changes(tables, DOC, [Change("Person", "update", rows)], now=WHEN)
    assert ids(out["Person"], "pay", "level", "note", "version")[:3] == [(1, 20.0, "high", "high!", 2), (2, 4.0, "?", "?", 1), (3, 3.0, "?", "?", 1)]
    assert ids(out["Team"], "n", "pay") == [(1, 2, 24.0), (2, 3, 9.0), (3, 0, 0.0)]
    assert {r["updated_at"] for r in out["Person"].where("id = 1").collect()} == {WHEN}
    moved = apply_changes(tables, DOC, [Change("Person", "update", spark.createDataFrame([(3, 3)], "id long, team long"))])
    assert ids(moved["Team"], "n", "pay") == [(1, 2, 9.0), (2, 2, 6.0), (3, 1, 3.0)]  # the parent before and the one after


def test_create_fills_and_counts(spark, tables):
    rows = spark.createDataFrame([(3, 50.0, 80), (3, 1.0, 81)], "team long, pay double, born long")
    out = apply_changes(tables, DOC, [Change("Person", "create", rows)], now=WHEN)
    assert ids(out["Person"].where("id > 5"), "pay", "city", "level", "note", "version", "created_at", "boss") == [(6, 1.0, "Bonn", "low", "low!", 1, WHEN, None), (7, 50.0, "Bonn", "high", "high!", 1, WHEN, None)]
    assert ids(out["Team"], "n", "pay")[2] == (3, 2, 51.0)


@pytest.mark.parametrize(
    ("entity", "kind", "rows", "schema", "error", "match"),
    [
        ("Log", "update", [(1, 2)], "id long, team long", ValidationError, "Log has no update"), ("Nope", "update", [(1,)], "id long", ValidationError, "unknown entity"),
        ("Person", "update", [(1, 2)], "id long, born long", ValidationError, "born cannot be changed"), ("Person", "update", [(1, 200.0)], "id long, pay double", ConstraintViolation, "pay < 100"),
        ("Person", "update", [(1, 2.0), (1, 3.0)], "id long, pay double", ConstraintViolation, "more than once"), ("Person", "create", [(1, 2.0)], "id long, pay double", ValidationError, "team, born must be given"),
        ("Team", "create", [(1, "z")], "id long, name string", ConstraintViolation, "there already"), ("Team", "create", [("z", 4)], "name string, n long", ValidationError, "n cannot be given"),
    ],
)
def test_what_is_refused(spark, tables, entity, kind, rows, schema, error, match):
    with pytest.raises(error, match=match):
        apply_changes(tables, DOC, [Change(entity, kind, spark.createDataFrame(rows, schema))])
