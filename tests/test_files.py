import gzip
import json
import zipfile

import pytest
import yaml

from fabrel import sinks
from fabrel.errors import OutputError
from fabrel.operators import tools
from fabrel.sources import files
from fabrel.sources.ddl import parse_document


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a'b,c", 1.005, [1, 2], None), (2, None, 2.0, [], True)], "id long, s string, x double, l array<int>, b boolean")


def test_writers(spark, rows, tmp_path):
    sinks.write({"T": rows}, f"{tmp_path}/t.json", "json")
    got = json.load(open(f"{tmp_path}/t.json"))["T"]
    assert got[0] == {"id": 1, "s": "a'b,c", "x": 1.005, "l": [1, 2], "b": None} and list(got[0]) == ["id", "s", "x", "l", "b"]
    sinks.write({"T": rows}, f"{tmp_path}/t.yaml", "yml")
    assert yaml.safe_load(open(f"{tmp_path}/t.yaml"))["T"][1]["b"] is True
    sinks.write({"T": rows}, f"{tmp_path}/nd", "jsonl")
    assert [json.loads(r.value)["id"] for r in spark.read.text(f"{tmp_path}/nd/T").collect()] == [1, 2]
    sinks.write({"T": rows}, f"{tmp_path}/csv", "csv")
    assert spark.read.csv(f"{tmp_path}/csv/T", header=True).select("s", "l").collect()[0] == ("a'b,c", "[1, 2]")
    assert [r.line for r in sinks.csv_rows(rows).collect()] == ["1,\"a'b,c\",1.00,\"[1, 2]\",", "2,,2.00,[],true"]
    sinks.write({"T": rows}, f"{tmp_path}/sql", "sql", dialect="mysql")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/sql/T").collect())
    assert "CREATE TABLE `T`" in text and "'a''b,c'" in text and "NULL" in text
    for bad in (lambda: sinks.write({}, "x", "xls"), lambda: sinks.create_table(rows.schema, "t", "oracle")):
        with pytest.raises(OutputError):
            bad()


def test_insert_batches(spark):
    out = sinks.insert_batches(spark.range(250), "n", ["id"]).orderBy("batch").collect()
    assert [r.statement.count("(") for r in out] == [101, 101, 51] and "(99)" in out[0].statement and "(100)" in out[1].statement


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write("k\tv\n1\tx\n2\ty\n")
    assert files.delimited(spark, f"{tmp_path}/a.tsv.gz", "k int, v string", sep="\t").collect() == [(1, "x"), (2, "y")]
    (tmp_path / "w.txt").write_text("MARY   2.6  1\n\nANNA  1.0 2\n")
    assert files.whitespace(spark, f"{tmp_path}/w.txt", [("name", "string"), ("freq", "double"), ("rank", "int")]).collect()[1] == ("ANNA", 1.0, 2)
    (tmp_path / "f.txt").write_text("ab12\ncd 3\n")
    assert files.fixed_width(spark, f"{tmp_path}/f.txt", [("s", 1, 2, "string"), ("n", 3, 2, "int")]).collect() == [("ab", 12), ("cd", 3)]
    (tmp_path / "d.json").write_text('{"a": {"items": [{"x": 1}, {"x": 2}]}, "m": {"k1": 5}}')
    assert [r.x for r in files.json_document(spark, f"{tmp_path}/d.json", "a struct<items: array<struct<x: int>>>", ["a", "items"]).collect()] == [1, 2]
    assert files.json_map(spark, f"{tmp_path}/d.json", "m map<string, int>", "m").collect() == [("k1", 5)]
    (tmp_path / "x.xml").write_text("<l><r><c>EUR</c></r><r><c>USD</c></r></l>")
    assert [r.c for r in files.xml(spark, f"{tmp_path}/x.xml", "r", "c string").collect()] == ["EUR", "USD"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.txt", "one\ntwo\n")
        z.writestr("no.bin", "x")
    assert [r.line for r in files.zipped(spark, f"{tmp_path}/z.zip", ".txt").collect()] == ["one", "two"]


DOC = """
domain: d
entities:
  A: {_meta: "@soft_delete @paginated(10)", id: uuid @primary, n: string @searchable, k: "enum(a, b)", at: datetime, s: string @sensitive, h: string @hidden, w: string @write_only, c: string @immutable, d: "string @derived(upper(n))"}
  B: {_meta: "@readonly", id: uuid @primary, a: ->A}
tools:
  B: {get: false}
"""


def test_tools(spark):
    doc = parse_document(DOC)
    t = tools.infer(doc, doc.entities["A"])
    assert t.operations == ["list", "get", "create", "update", "delete"] and t.delete == "soft" and t.page == 10
    assert t.filters == ["k", "at", "at_after", "at_before"] and t.sorts == ["id", "at"] and t.search == ["n"]
    assert "d" not in t.required and "c" not in t.mutable and "id" not in t.required and t.children == [("B", "a")]
    assert tools.infer(doc, doc.entities["B"]).operations == ["list"]
    df = spark.createDataFrame([("1", "x", "q"), ("2", None, "q")], "id string, s string, h string")
    assert tools.masked(df, doc.entities["A"]).collect() == [("1", "***"), ("2", None)]
    with pytest.raises(ValueError, match="no such filter"):
        tools.condition({"zz": 1}, ["a"])


def test_rows_that_do_not_fit_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\noops,y\n3,z\n")
    path = f"{tmp_path}/a.csv"
    assert files.delimited(spark, path, "k int, v string").collect() == [(1, "x"), (3, "z")]
    assert [r._line for r in files.rejected(spark, path, "k int, v string").collect()] == ["oops,y"]
    assert files.rejected(spark, path, "k int, v string").count() == 1


def test_tar_members_and_prepared_lists(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name, text in (("in.dmp", b"1|a\n2|b\n"), ("no.bin", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    assert [(r.member, r.line) for r in files.zipped(spark, f"{tmp_path}/t.tar.gz", ".dmp").collect()] == [("in.dmp", "1|a"), ("in.dmp", "2|b")]
    (tmp_path / "names.json").write_text('[{"name": "Ada", "weight": 3}, {"name": "Bo", "weight": 1}]')
    (tmp_path / "bad.json").write_text("[[[ no")
    lists = files.prepared_lists(spark, str(tmp_path), ["names", "bad", "absent"])
    assert list(lists) == ["names"] and sorted(lists["names"].collect()) == [("Ada", 3), ("Bo", 1)]


def test_links_area_codes_and_metadata(spark):
    from pyspark.sql import functions as F

    from fabrel.functions.semantic import area_code
    from fabrel.plans.generate import generate

    b = spark.createDataFrame([("1", "x"), ("2", "y")], "a_id string, b_id string")
    assert sorted(tools.link(b, "1", "x").collect()) == [("1", "x"), ("2", "y")] and tools.link(b, "1", "y").count() == 3
    assert tools.unlink(b, "1", "x").collect() == [("2", "y")]
    zips = spark.createDataFrame([("10001",), ("02108",), ("99999",), (None,)], "z string")
    assert [r[0] for r in zips.select(area_code(F.col("z"))).collect()] == ["212", "617", "555", "555"]
    a = generate(spark, parse_document("domain: d\nvolume: {A: 3}\nentities: {A: {id: uuid @primary, zip: address.zip, phone: phone @from(zip), n: {type: 'int @range(1..3) @searchable', label: Number, description: A number}}}"))["A"]
    assert a.schema["n"].metadata == {"label": "Number", "description": "A number", "decorators": ["searchable"]} and a.schema["zip"].metadata == {}
