"""What the generation and tools sections change, unions as variants, published datasets, names in texts, taxonomies."""

import re

import pytest
from pyspark.sql import functions as F

from fabrel.errors import CycleError, ParseError
from fabrel.operators.gazetteer import longest_name
from fabrel.operators.lists import Registry, prepare_lists
from fabrel.operators.taxonomy import lineage, named_nodes
from fabrel.operators.tools import infer
from fabrel.plans.generate import generate
from fabrel.sinks import csv_rows, ndjson_rows, write
from fabrel.sinks.publish import manifest, publish, publish_tables, published_tables
from fabrel.sources.ddl import parse_document
from fabrel.sources.files import prepared_lists


def rows(spark, text, n=60):
    return generate(spark, parse_document("domain: x\nseed: 2\n" + text), volume={"A": n})["A"]


def test_null_strategies(spark):
    text = "generation: {null_strategy: %s}\nentities: {A: {id: int @primary, a: 'int?', b: int @range(5..9) @null_rate(0.5), c: string @optional, up: '->self?', g: 'int? @null_rate(0.1)'}}"
    nulls = lambda s: [rows(spark, text % s, 200).where(f"{c} is null").count() for c in ("a", "b", "c", "up", "g")]
    assert nulls("never") == [0, 0, 0, 1, 0]
    a, b, c, up, g = nulls("realistic")
    assert 15 < a < 70 and 60 < b < 140 and 10 < c < 60 and up > 100 and 5 < g < 45
    a, b, c, up, g = nulls("sparse")
    assert 90 < a < 150 and 60 < b < 140 and 90 < c < 150 and 90 < up < 150 and 5 < g < 45


@pytest.mark.parametrize(("kind", "pattern"), [("uuid", "[0-9a-f]{8}-.*"), ("sequential", "[0-9]+"), ("cuid", "c[0-9a-z]{24}"), ("ulid", "01JH[0-9A-HJKMNP-TV-Z]{22}")])
def test_id_formats(spark, kind, pattern):
    text = f"generation: {{id_format: {kind}}}\nentities:\n  A: {{id: uuid @primary}}\n  B: {{id: uuid @primary, a: ->A}}"
    out = generate(spark, parse_document("domain: x\n" + text), volume={"A": 30, "B": 30})
    ids = [r["id"] for r in out["A"].collect()]
    assert len(set(ids)) == 30 and all(re.fullmatch(pattern, i) for i in ids)
    assert {r["a"] for r in out["B"].collect()} <= set(ids)


def test_money_and_dates(spark):
    text = "generation: {currency_format: integer_cents, date_format: dd.MM.yyyy}\nentities: {A: {id: int @primary, m: currency, n: 'currency @range(1..2)', d: date}}"
    df = rows(spark, text)
    assert dict(df.dtypes)["m"] == "bigint" and df.where("n not between 100 and 200 or m > 1000000").isEmpty()
    assert all(re.search(r'"d":"\d\d\.\d\d\.20\d\d"', r["line"]) for r in ndjson_rows(df).collect()) and all(re.search(r",\d\d\.\d\d\.20\d\d$", r["line"]) for r in csv_rows(df).collect())
    with pytest.raises(ParseError, match="unknown id_format"):
        parse_document("domain: x\ngeneration: {id_format: oid}")


def test_lists_that_are_not_empty_and_ibans(spark):
    df = rows(spark, "entities: {A: {id: int @primary, l: '[int] @len(0..2) @not_empty', i: iban}}")
    assert df.where("size(l) = 0").isEmpty() and not df.where("l = array(cast(null as bigint)) or l[0] is null").isEmpty()
    assert all(int(r["i"][4:] + "1314" + r["i"][2:4]) % 97 == 1 for r in df.collect())


def test_unions_are_variants(spark, tmp_path):
    df = rows(spark, "entities: {A: {id: int @primary, u: 'int @range(1..9) | enum(x, y) | [bool]', w: any, o: '(int|bool)?'}}".replace("int @range(1..9)", "int").replace(", o: '(int|bool)?'", ""))
    kinds = {r[0] for r in df.select(F.schema_of_variant("u")).collect()}
    assert kinds == {"BIGINT", "STRING", "ARRAY<BOOLEAN>", "ARRAY<VOID>"} or kinds == {"BIGINT", "STRING", "ARRAY<BOOLEAN>"}
    assert {r[0] for r in df.select(F.schema_of_variant("w")).collect()} == {"BIGINT", "STRING"}
    for fmt in ("ndjson", "csv", "json", "sql", "yaml"):
        write({"A": df}, f"{tmp_path}/{fmt}", fmt)
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/ndjson/A").collect()]
    assert any(re.search(r'"u":-?\d+', x) for x in lines) and any('"u":"x"' in x for x in lines) and any('"u":[' in x for x in lines)


def test_tool_overrides():
    doc = parse_document("""
domain: x
entities: {C: {id: int @primary, name: string, email: email, tier: "enum(free, paid)", phone: "string?", made: date}, O: {id: int @primary, s: string}}
tools:
  C: {list: {filters: [tier], sorts: [name], page_size: 10, max_page_size: 50}, create: {required: [name], optional: [phone], defaults: {tier: free}}, update: {mutable: [name, phone], immutable: [phone]}, delete: {strategy: soft}}
  O: {create: disabled, delete: {strategy: disabled}, update: {mutable: [s]}}
""")
    c, o = (infer(doc, doc.entities[n]) for n in "CO")
    assert (c.filters, c.sorts, c.page, c.max_page, c.required, c.optional, c.defaults, c.mutable, c.delete) == (["tier"], ["name"], 10, 50, ["name"], ["phone", "tier"], {"tier": "free"}, ["name"], "soft")
    assert o.operations == ["list", "get", "update"] and o.delete is None and o.mutable == ["s"]


def test_publishing_is_all_or_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/data"
    publish_tables({"a": spark.range(3), "b": spark.range(4)}, folder)
    old = published_tables(spark, folder)["a"]

    def broken(path):
        spark.range(9).write.parquet(path)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        publish(spark, folder, {"a": spark.range(7).write.parquet, "b": broken})
    assert {n: df.count() for n, df in published_tables(spark, folder).items()} == {"a": 3, "b": 4}
    publish_tables({"a": spark.range(8)}, folder)
    assert {n: df.count() for n, df in published_tables(spark, folder).items()} == {"a": 8, "b": 4}
    assert old.count() == 3  # a reader of the version before still has it
    for n in range(3):
        publish_tables({"a": spark.range(n)}, folder)
    assert len(list((tmp_path / "data/versions/a").iterdir())) == 2 and manifest(spark, f"{folder}/none") == {}


def test_registry_and_lists(spark, tmp_path):
    folder, names = f"file://{tmp_path}/lists", spark.createDataFrame([("b", 1), ("a", 2)], "name string, weight long")
    r = Registry()
    r.add("names", lambda: names, group="people", description="given names")
    r.add("bad", lambda: names.select("nope"), group="people")
    r.add("other", lambda: names.limit(1), group="misc")
    assert r.names() == ["names", "bad", "other"] and r.names("misc") == ["other"]
    assert list(r.update(folder, group="people")) == ["bad"]
    assert sorted((x["name"], x["rows"]) for x in r.info(spark, folder).collect()) == [("bad", None), ("names", 2), ("other", None)]
    with pytest.raises(ValueError, match="unknown: z"):
        r.update(folder, names=["z"])
    with pytest.raises(ValueError, match="no list"):
        prepare_lists({"names": lambda: names.select("nope")}, folder)
    assert [x["name"] for x in prepared_lists(spark, folder, ["names", "other"])["names"].orderBy("name").collect()] == ["a", "b"]


def test_longest_names(spark):
    places = spark.createDataFrame([("New York", 8), ("York", 2), ("New York City", 1), ("São Paulo", 9), ("york!", 5), ("", 3), (None, 3)], "name string, n long")
    texts = spark.createDataFrame([(1, "in new york, city hall"), (2, "Yorkshire"), (3, "from YORK to SÃO  Paulo"), (4, None), (5, "new-york (city)"), (6, "York york")], "k long, t string")
    found = {r["k"]: r["place"] and (r["place"]["name"], r["place"]["n"]) for r in longest_name(texts, "k", "t", places, "name", weight="n").collect()}
    assert found == {1: ("New York City", 1), 2: None, 3: ("São Paulo", 9), 4: None, 5: ("New York City", 1), 6: ("york!", 5)}
    assert longest_name(texts, "k", "t", places.where("false"), "name").where("place is not null").isEmpty()
    many = spark.range(100_000).selectExpr("concat('place ', id) as name", "id as n")
    some = spark.range(50).selectExpr("id as k", "concat('x place ', id * 1999, ' y') as t")
    assert longest_name(some, "k", "t", many, "name").where("place.n = k * 1999").count() == 50


def test_lineage(spark):
    chain = [(i, i - 1) for i in range(1, 70)] + [(0, None), (100, 100), (101, 100), (200, 999)]
    found = {r["id"]: list(r["line"]) for r in lineage(spark.createDataFrame(chain, "id long, parent long")).collect()}
    assert found[69] == list(range(70)) and found[0] == [0] and found[101] == [100, 101] and found[200] == [200] and len(found) == 73
    with pytest.raises(CycleError):
        lineage(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, parent long"))
    assert lineage(spark.createDataFrame([], "id long, parent long")).isEmpty()
    names = spark.createDataFrame([(1, "b", "scientific name"), (1, "a", "scientific name"), (2, "c", "synonym"), (3, "d", "scientific name")], "id long, name string, kind string")
    assert [tuple(r) for r in named_nodes(spark.createDataFrame([(1,), (2,), (3,)], "id long"), names, limit=2).collect()] == [(1, "a"), (3, "d")]


def test_sql_statements_stand_in_order_of_the_key(spark, tmp_path):
    df = rows(spark, "entities: {A: {id: int @primary, t: text.paragraph}}", 450).repartition(5)
    write({"A": df}, str(tmp_path), "sql")
    files = sorted(x for x in (tmp_path / "A").iterdir() if x.name.startswith("part"))
    text = "".join(x.read_text() for x in files)
    assert text.startswith("CREATE TABLE") and text.count("INSERT INTO") == 5
    assert [int(x) for x in re.findall(r"^\((\d+), '", text, re.M)] == list(range(1, 451))


@pytest.mark.parametrize("bits", [6, 27])
def test_only_runs_that_may_be_names_are_shuffled(spark, monkeypatch, bits):
    """Results are those of a walk over each text, also where the filter of names is full (64 bits)."""
    import random

    from fabrel.operators import gazetteer

    monkeypatch.setattr(gazetteer, "LEAST_BITS", min(bits, 16))
    monkeypatch.setattr(gazetteer, "MOST_BITS", bits)
    r = random.Random(4)
    some = lambda n: " ".join(r.choice("ab abc ça d E".split()) for _ in range(n))
    names = sorted({some(r.randint(1, 8)).lower() for _ in range(60)})
    texts = [(f"k{i}", some(r.randint(0, 40)) + " zz" * 300) for i in range(80)]
    df = spark.createDataFrame(texts, "k string, t string").repartition(3)
    places = spark.createDataFrame([(n,) for n in names], "name string")
    met, kept, runs = {}, [], gazetteer._runs
    monkeypatch.setattr(gazetteer, "_runs", lambda *a: kept.append(runs(*a)) or kept[-1])
    for row in longest_name(df, "k", "t", places, "name").collect():
        met[row["k"]] = row["place"] and row["place"]["name"]
    for k, t in texts:
        w = t.lower().split()
        found = [(-n, -len(x), i, x) for n in range(1, 9) for i in range(len(w) - n + 1) if (x := " ".join(w[i : i + n])) in names]
        assert met[k] == (min(found)[3] if found else None)
    if bits == 27:
        assert all(row.n for row in kept[0].collect()) and kept[0].count() < sum(min(len(t.split()), 40) * 8 for _, t in texts) / 2
