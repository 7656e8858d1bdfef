import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from fabrel import sinks
from fabrel.operators import lists
from fabrel.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_columns_are_found_by_header(spark):
    df = spark.createDataFrame([(1, "a")], "ID int, Label string")
    assert rows(lists.probed(df, {"code": ["code", "id"], "name": ["name", "label"]})) == [(1, "a")]
    with pytest.raises(ValueError, match="year"):
        lists.probed(df, {"year": ["year"]})


def test_names(spark):
    df = spark.createDataFrame([("MARY", "F", 3), ("mary ", "f", 2), ("", "F", 9), (None, "M", 1), ("JOHN", "M", 0), (r"\N", "M", 5)], "name string, sex string, n int")
    assert rows(lists.given_names(df)) == [("Mary", "f", 5)]
    assert lists.surnames(spark.createDataFrame([("B", 2), ("A", 2), ("C", 1)], "name string, n int"), 2).collect() == [("A", 2), ("B", 2)]


def test_joins_with_defaults(spark):
    t = spark.createDataFrame([("11-1", "Chief"), ("99-1", "Odd")], "code string, title string")
    alt = spark.createDataFrame([("11-1", "Head"), ("11-1", "Chief"), ("11-1", None)], "code string, title string")
    g = spark.createDataFrame([("11", "Management")], "prefix string, name string")
    assert rows(lists.occupations(t, alt, g)) == [("11-1", "Chief", "Management"), ("11-1", "Head", "Management"), ("99-1", "Odd", "Other")]
    codes = spark.createDataFrame([("EUR", "Euro", 2), ("JPY", "Yen", 0), ("XXX", "None", None)], "code string, name string, digits int")
    assert rows(lists.currencies(codes, spark.createDataFrame([("EUR", "€")], "code string, symbol string"))) == [("EUR", "Euro", 2, "€"), ("JPY", "Yen", 0, "JPY"), ("XXX", "None", 2, "XXX")]
    foods = spark.createDataFrame([(1, "Fig", 7), (2, "Rye", 8)], "food_id int, name string, group_id int")
    assert rows(lists.foods(foods, spark.createDataFrame([(7, "Fruit")], "group_id int, name string"))) == [(1, "Fig", "Fruit"), (2, "Rye", "Other")]


def test_filters(spark):
    z = spark.createDataFrame([("# zones",), ("Europe/Oslo",), ("Europe/Oslo",), (None,)], "zone string")
    assert rows(lists.timezones(z)) == [("Europe/Oslo",)]
    a = spark.createDataFrame([("SK", "Scand", "Y"), (r"\N", "None", "Y"), ("ZZ", "Old", "N")], "code string, name string, active string")
    assert rows(lists.airlines(a)) == [("SK", "Scand")]
    p = spark.createDataFrame([("OSL", "Oslo", "large", "Oslo", "NO"), ("", "Strip", "large", "x", "NO"), ("ABC", "Pad", "heliport", "x", "NO")], "code string, name string, kind string, city string, country string")
    assert rows(lists.airports(p, ["large"])) == [("OSL", "Oslo", "Oslo", "NO")]
    c = spark.createDataFrame([("411111", "VISA", "b"), ("41", "visa", "b"), ("511111", "other", "b")], "prefix string, brand string, issuer string")
    assert rows(lists.card_prefixes(c, ["visa"], 5)) == [("411111", "visa", "b")]
    assert rows(lists.languages(spark.createDataFrame([("en", "English"), ("", "x"), ("eng", "y")], "code string, name string"))) == [("en", "English")]
    v = spark.createDataFrame([("B", "2", 2001), ("A", "1", 2001), ("A", "1", 2002), ("C", "3", 1990)], "make string, model string, year int")
    assert lists.vehicles(v, 2000, 2).collect() == [("A", "1"), ("B", "2")]
    t = spark.createDataFrame([("t2", "movie", "B", "1990"), ("t1", "movie", "A", r"\N"), ("t3", "short", "C", "1991")], "title_id string, kind string, title string, year string")
    assert rows(lists.titles(t, ["movie"], 9)) == [("t2", "B", 1990)]
    c = spark.createDataFrame([("Oslo", "NO", "3", 700000, 59.9, 10.7), ("Inn", "NO", "4", 10, 60.0, 9.0)], "name string, country string, region string, population long, latitude double, longitude double")
    assert [r.name for r in lists.cities(c, 1000).collect()] == ["Oslo"]


def test_shapes_of_sources(spark, tmp_path):
    assert rows(lists.diagnoses(spark.createDataFrame([("A000    Cholera due to x",), ("A00 Cholera",), ("bare",)], "value string"))) == [("A00", "Cholera"), ("A00.0", "Cholera due to x")]
    (tmp_path / "t.json").write_text('{"fields": ["a", "b"], "data": [["1", "X"], ["oops", "Y"], ["2"]]}')
    read = spark.read.json(f"{tmp_path}/t.json", schema="data array<array<string>>", multiLine=True)
    assert lists.arrays_of_fields(read, [("id", "int"), ("name", "string")]).collect() == [(1, "X"), (None, "Y"), (2, None)]
    (tmp_path / "r.xml").write_text('<o><record id="a" model="tax"><field name="name">VAT</field><field name="rate">20</field></record><record id="b" model="unit"><field name="name">kg</field></record></o>')
    read = files.xml(spark, f"{tmp_path}/r.xml", "record", "_id string, _model string, field array<struct<_name: string, _VALUE: string>>")
    assert lists.records(read, "tax", ["name", "rate", "kind"]).collect() == [("a", "VAT", "20", None)]


def test_lists_are_written_and_failures_told(spark, tmp_path):
    bad = lambda: spark.read.csv(f"{tmp_path}/absent.csv")
    failed = lists.prepare_lists({"zones": lambda: spark.createDataFrame([("b",), ("a",), (None,)], "zone string"), "bad": bad}, str(tmp_path / "out"))
    assert list(failed) == ["bad"] and "absent" in failed["bad"]
    got = files.prepared_lists(spark, str(tmp_path / "out"), ["zones", "bad"])
    assert list(got) == ["zones"] and sorted(str(r.zone) for r in got["zones"].collect()) == ["None", "a", "b"]
    lists.prepare_lists({"zones": lambda: spark.range(1).select(F.raise_error(F.lit("broken")).alias("zone")), "more": lambda: spark.range(1)}, str(tmp_path / "out"))
    assert files.prepared_lists(spark, str(tmp_path / "out"), ["zones"])["zones"].count() == 3
    with pytest.raises(ValueError, match="no list"):
        lists.prepare_lists({"bad": bad}, str(tmp_path / "out"))


@pytest.mark.parametrize("n", [0, 1, 2500])
def test_documents_in_parts(spark, tmp_path, n):
    df = spark.range(0, n, 1, 3).select("id", F.when(F.col("id") % 2 == 0, F.lit('a "b", ü\nc')).alias("s"))
    sinks.write({"T": df}, f"{tmp_path}/j", "json")
    sinks.write({"T": df}, f"{tmp_path}/y", "yaml")
    read = lambda d: [open(f"{tmp_path}/{d}/T/{f}", encoding="utf-8").read() for f in sorted(os.listdir(f"{tmp_path}/{d}/T")) if f.startswith("part-")]
    want = [{"id": i, "s": 'a "b", ü\nc' if i % 2 == 0 else None} for i in range(n)]
    assert sum((json.loads(t) for t in read("j") if t or n), []) == want  # no rows: the part may be empty
    assert (yaml.safe_load("".join(read("y"))) or []) == want
    assert spark.read.json(f"{tmp_path}/j/T", schema="id long, s string", multiLine=True).where("id is not null").count() == n


def test_countries_and_postal_codes(spark):
    rows = [("GB", "GBR", "Britain", "London", "EU", "GBP", "+44 ", "en-GB,cy-GB"), ("#x", "", "", "", "", "", "", ""), ("AQ", "ATA", "Antarctica", None, "AN", None, None, ""), ("XX", "XXX", None, "", "", "", "", "")]
    df = spark.createDataFrame(rows, "code string, code3 string, name string, capital string, continent string, currency string, phone string, languages string")
    assert [tuple(r) for r in lists.countries(df).orderBy("code").collect()] == [("AQ", "ATA", "Antarctica", None, "AN", None, None, "en"), ("GB", "GBR", "Britain", "London", "EU", "GBP", "44", "en")]
    codes = spark.createDataFrame([("DE", "10115", "Mitte", "BE", 1.0, 2.0), ("DE", "10115", "Berlin", "BE", 3.0, 4.0), ("FR", "75001", "Paris", "", 5.0, 6.0), ("DE", "", "x", "", 0.0, 0.0)], "country string, code string, place string, region string, latitude double, longitude double")
    assert [tuple(r) for r in lists.postal_codes(codes, ["DE"]).collect()] == [("DE", "10115", "Berlin", "BE", 3.0, 4.0)] and lists.postal_codes(codes).count() == 2


def test_phone_formats(spark, tmp_path):
    (tmp_path / "p.xml").write_text("""<t><territory id="GB" countryCode="44" internationalPrefix="00"><availableFormats><numberFormat pattern="(\\d{2})(\\d{4})"><format>$1 $2</format></numberFormat><numberFormat pattern="(\\d{3})"><format>$1</format></numberFormat></availableFormats><fixedLine><exampleNumber>121</exampleNumber></fixedLine><mobile><exampleNumber>740</exampleNumber></mobile></territory><territory id="AC" countryCode="247"/><territory id="001" countryCode="800"/></t>""")
    schema = "_id string, _countryCode string, _internationalPrefix string, mobile struct<exampleNumber: string>, fixedLine struct<exampleNumber: string>, availableFormats struct<numberFormat: array<struct<_pattern: string, format: string>>>"
    got = [tuple(r) for r in lists.phone_formats(files.xml(spark, f"file://{tmp_path}/p.xml", "territory", schema)).orderBy("country", "place").collect()]
    assert got == [("AC", "247", None, None, None, 0, None, None), ("GB", "44", "00", "740", "121", 0, r"(\d{2})(\d{4})", "$1 $2"), ("GB", "44", "00", "740", "121", 1, r"(\d{3})", "$1")]


def test_lists_of_codes(spark):
    lines = spark.createDataFrame([("# Version 1",), ("COM",), ("de",), ("XN--P1AI",), ("com",), ("",)], "value string")
    assert sorted(tuple(r) for r in lists.domains(lines).collect()) == [("com", "generic"), ("de", "country"), ("xn--p1ai", "generic")]
    types = spark.createDataFrame([("image/png", ["png"]), ("image/jpeg", ["jpg", "JPEG"]), ("image/a", ["jpg"]), ("font/otf", ["otf"]), ("text/x", None)], "type string, extensions array<string>")
    assert sorted(tuple(r) for r in lists.mime_types(types, ["image", "text"]).collect()) == [("jpeg", "image/jpeg"), ("jpg", "image/a"), ("png", "image/png")]
    colleges = spark.createDataFrame([(1, " A ", "c", "r", 1), (2, "B", "c", "r", 9), (3, "", "c", "r", 2)], "id long, name string, city string, region string, control int")
    assert [tuple(r) for r in lists.institutions(colleges).orderBy("id").collect()] == [(1, "A", "c", "r", "public"), (2, "B", "c", "r", "unknown")]
    makers = spark.createDataFrame([("00-1b-63", "Apple"), ("001B63", "Zeta"), ("aabbcc", "B"), ("zz", "C"), ("ddeeff", "")], "prefix string, maker string")
    assert [tuple(r) for r in lists.device_prefixes(makers, 9).orderBy("prefix").collect()] == [("00:1B:63", "Apple"), ("AA:BB:CC", "B")] and lists.device_prefixes(makers, 1).count() == 1
    exchange = spark.createDataFrame([(["cik", "name", "ticker", "exchange"], [["1", "One", "ONE", "N"], ["2", "Two", "TWO", None], ["3", "Uno", "ONE", "Q"]])], "fields array<string>, data array<array<string>>")
    assert sorted(tuple(r) for r in lists.tickers(exchange).collect()) == [("ONE", "One", "N"), ("TWO", "Two", None)]
    names = spark.createDataFrame([("de", {"FR": "Frankreich", "XX": ""}), ("en", {"FR": "France"})], "locale string, names map<string, string>")
    assert sorted(tuple(r) for r in lists.translations(names).collect()) == [("de", "FR", "Frankreich"), ("en", "FR", "France")]
    goods = spark.createDataFrame([("Pen ", ["Office", "Pens"], "$1.50"), ("Pen", ["Office", "Pens"], "1.2"), ("Cup", [], "2"), ("Ink", ["A"], "?")], "title string, categories array<string>, price string")
    assert [tuple(r) for r in lists.products(goods, 5).orderBy("title").collect()] == [("Ink", "A", None), ("Pen", "Pens", 1.2)]
