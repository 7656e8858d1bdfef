from datetime import date

import pytest
from pyspark.sql import functions as F

from fabrel.errors import ParseError
from fabrel.functions.expressions import Compiler, columns_of, with_expressions


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(7, 2.5, "Ab C!", True, [1, 2, 2], date(2000, 2, 29)), (None, 0.0, "", None, [], None)], "i long, x double, s string, b boolean, l array<int>, d date")


@pytest.mark.parametrize(
    ("text", "first", "second"),
    [("i / 2", 3, None), ("-i % 3", -1, None), ("i + x", 9.5, None), ("i / 0", None, None), ("x * 2 >= 5", True, False), ("i == null", False, True), ("i != 7", False, True),
     ("if(s, 'y', 'n')", "y", "n"), ("not i", False, True), ("b and x", True, False), ("b or s", True, False), ("s in ['Ab C!', 'z']", True, False), ("slug(s)", "ab-c", ""),
     ("concat(i, '-', x, '-', b)", "7-2.50-true", "-0.00-"), ("round(x)", 3.0, 0.0), ("round(1.005, 2)", 1.0, 1.0), ("upper(s)", "AB C!", ""), ("starts_with(s, 'Ab')", True, False),
     ("count(l)", 3, 0), ("sum(l)", 5.0, 0.0), ("avg(l)", 5 / 3, 0.0), ("max(l)", 2, None), ("all_equal(l)", False, True), ("count(i)", 1, 1), ("years_since(d)", 24, 0), ("days_between(d, '2000-03-05')", 5, 0), ("1 < i <= 7", True, False)],
)
def test_expression(rows, text, first, second):
    got = [r[0] for r in with_expressions(rows, {"v": text}).select("v").collect()]
    assert got == [pytest.approx(first) if isinstance(first, float) else first, second]


def test_errors(rows):
    c = Compiler(columns_of(rows.schema))
    for text in ("i +", "nope(i)", "lambda: 1", "i ** 2"):
        with pytest.raises(ParseError):
            c.compile(text)
    with pytest.raises(KeyError):
        c.compile("missing")


def test_distributions_have_their_moments(spark):
    from fabrel.functions.distributions import sample
    from fabrel.functions.rng import Draw
    from fabrel.model import Decorator

    d = Draw(1, "E", "f", F.col("id"))
    spec = lambda n, **k: Decorator("dist", (n,), tuple((a, str(b)) for a, b in k.items()))
    df = spark.range(20_000).select(
        sample(spec("normal", mu=50, sigma=10), d, None, None).alias("normal"), sample(spec("exponential", **{"lambda": 2}), d, None, None).alias("exponential"),
        sample(spec("geometric", p=0.25), d, None, None).alias("geometric"), sample(spec("uniform"), d, 0, 10).alias("uniform"), d.weighted(["a", "b"], [3, 1]).alias("w"),
    )
    r = df.agg(*[F.avg(c).alias(c) for c in df.columns[:4]], F.stddev("normal").alias("sd"), F.avg((F.col("w") == "a").cast("int")).alias("a")).first()
    assert abs(r["normal"] - 50) < 0.5 and abs(r["sd"] - 10) < 0.5 and abs(r["exponential"] - 0.5) < 0.02 and abs(r["geometric"] - 3) < 0.15 and abs(r["uniform"] - 5) < 0.1 and abs(r["a"] - 0.75) < 0.02


@pytest.mark.parametrize("name", ["expr_concat", "write_csv_display", "write_display_rows"])
def test_displayed_numbers_are_those_of_the_sql(spark, tmp_path, name):
    """A negative number that rounds to zero prints its sign, as do negative zeros."""
    import duckdb

    from fabrel.catalog import ORACLE_SQL, QUERIES

    values = [-0.0, 0.0, -0.001, 0.001, -0.005, 0.005, -0.0049999, 1.005, -1.005, 2.675, 999999.995, -999.85, 9999.8, float("inf"), float("-inf"), float("nan")]
    rows = [(i, f"Customer#{i}", 1, v, "A") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.sql(ORACLE_SQL[name]).fetchall())


def test_displayed_nulls_are_empty(spark):
    from fabrel.sinks import display_rows

    assert [r.x for r in display_rows(spark.createDataFrame([(None,), (1.0,), (-0.0,)], "x double")).collect()] == ["", "1.00", "-0.00"]
