"""Registered queries of the library's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import OutputError
from .functions.distributions import sample, zipf
from .functions.expressions import Compiler, Value, columns_of, compute, default_chain, scaled_round, two_places, with_expressions
from .functions.patterns import WORDS, expand, uuid_of
from .functions.rng import Draw
from .functions.semantic import AREA_CODES, CHARTS, CITIES, DOMAINS, FIRST, LAST, LISTS, LOREM, TAXONOMIES, email_of, luhn_card, person
from .model import Decorator, Field, Rule, Type
from .operators import changes, gazetteer, lists, prepare, references, rules, taxonomy, tools
from .operators.constraints import decorated, fitted, snapped, within
from .sinks import csv_rows, display_rows, insert_batches, ndjson_rows, write_json_parts, write_yaml_parts
from .sinks.publish import publish, publish_tables, published_tables
from .sources import files
from .sources.archives import archive_lines
from .sources.ddl import parse_document, parse_field
from .storage import Scratch

SEED = 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- generation: a row for each customer, its key as the row number -------------------------------------------------


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"))


def draw(name: str, rid: Column | None = None) -> Draw:
    return Draw(SEED, "G", name, F.col("rid") if rid is None else rid)


def h(name: str, salt: str = "", rid: str = "rid", entity: str = "G", attempt: int = 0) -> str:
    """SQL of Draw.h."""
    return f"('0x' || substr(md5(concat_ws('|', '{SEED}|{entity}|{name}', ({rid})::VARCHAR, '{salt}', '{attempt}')), 1, 13))::BIGINT"


def rows_of(spark: SparkSession, sf_dir: str, fields: str, *, types: str = "") -> DataFrame:
    """Rows of an entity G of these fields, for the customers' keys as row numbers."""
    from .streaming import entity_rows

    doc = parse_document(f"domain: x\nseed: {SEED}\ntypes: {{{types}}}\nentities: {{G: {{{fields}}}}}")
    return entity_rows(spark, doc, "G", people(spark, sf_dir).withColumnRenamed("rid", "_rid")).withColumnRenamed("_rid", "rid")


def u(name: str, salt: str = "", rid: str = "rid", entity: str = "G") -> str:
    return f"(({h(name, salt, rid, entity)})::DOUBLE / 4503599627370496.0)"


def u_open(name: str, salt: str = "") -> str:
    return f"((({h(name, salt)})::DOUBLE + 0.5) / 4503599627370496.0)"


def pick(values, name: str, salt: str = "", rid: str = "rid") -> str:
    items = ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{items}])[({h(name, salt, rid)}) % {len(values)} + 1]"


FROM = " from (select c_custkey as rid from customer)"


def spread(text: str, total: int, rid: str = "rid") -> tuple[str, int]:
    from math import gcd

    step = next(s for s in range(int(total * 0.618) | 1, 2 * total + 3) if gcd(s, total) == 1)
    return f"(({rid}::HUGEINT * {step} + {SEED % total}) % {total})::BIGINT", step


@query(f"select rid, 18 + ({h('a', 'v')}) % 48 as age" + FROM)
def gen_int_range(spark, sf_dir):
    return rows_of(spark, sf_dir, "a: int @range(18..65)").select("rid", F.col("a").alias("age"))


@query(f"select rid, round((1.0::DOUBLE + {u('f', 'v')} * 499.0::DOUBLE) * 100) / 100.0::DOUBLE as price" + FROM)
def gen_float_range(spark, sf_dir):
    return rows_of(spark, sf_dir, "f: float @range(1..500)").select("rid", F.col("f").alias("price"))


@query(f"select rid, (round({u('d', 'v')} * 5.0::DOUBLE * 10) / 10.0::DOUBLE)::DECIMAL(3,1)::VARCHAR as rating" + FROM)
def gen_decimal(spark, sf_dir):
    return rows_of(spark, sf_dir, "d: 'decimal(3,1) @range(0..5)'").select("rid", F.col("d").cast("string").alias("rating"))


@query(f"select rid, {u('b', 'v')} < 0.5 as flag" + FROM)
def gen_bool(spark, sf_dir):
    return rows_of(spark, sf_dir, "b: bool").select("rid", F.col("b").alias("flag"))


@query(f"select rid, date '2020-01-01' + (({h('day', 'v')}) % 2190)::INTEGER as day" + FROM)
def gen_date(spark, sf_dir):
    return rows_of(spark, sf_dir, "day: date").select("rid", "day")


@query(f"select rid, timestamp '2020-01-01 00:00:00' + to_seconds(({h('ts', 'v')}) % 189388800) as moment" + FROM)
def gen_datetime(spark, sf_dir):
    return rows_of(spark, sf_dir, "ts: datetime").select("rid", F.col("ts").alias("moment"))


@query("select rid, " + " || ':' || ".join(f"lpad((({h('tm', s)}) % {n})::VARCHAR, 2, '0')" for s, n in (("h", 24), ("m", 60), ("s", 60))) + " as clock" + FROM)
def gen_time(spark, sf_dir):
    return rows_of(spark, sf_dir, "tm: time").select("rid", F.col("tm").alias("clock"))


@query(f"select rid, 'PT' || (({h('du', 'h')}) % 72)::VARCHAR || 'H' || (({h('du', 'm')}) % 60)::VARCHAR || 'M' as lasting" + FROM)
def gen_duration(spark, sf_dir):
    return rows_of(spark, sf_dir, "du: duration").select("rid", F.col("du").alias("lasting"))


@query(f"select rid, {pick(('red', 'green', 'blue', 'yellow'), 'c', 'v')} as color" + FROM)
def gen_enum_uniform(spark, sf_dir):
    return rows_of(spark, sf_dir, "c: 'enum(red, green, blue, yellow)'").select("rid", F.col("c").alias("color"))


@query(f"select rid, case when {u('t', 'v')} < 0.7 then 'free' when {u('t', 'v')} < 0.95 then 'pro' else 'enterprise' end as tier" + FROM)
def gen_enum_weighted(spark, sf_dir):
    return people(spark, sf_dir).select("rid", draw("t").weighted(("free", "pro", "enterprise"), (70, 25, 5), "v").alias("tier"))


def _dist(name: str, **options: float) -> Decorator:
    return Decorator("dist", (name,), tuple((k, str(v)) for k, v in options.items()))


def _normal(salt: str, mean: float, sd: float) -> str:
    return f"({float(mean)}::DOUBLE + {float(sd)}::DOUBLE * sqrt(-2.0::DOUBLE * ln({u_open('n', salt + '1')})) * cos({2 * pi!r}::DOUBLE * {u('n', salt + '2')}))"


def _rounded(x: str, digits: int = 3) -> str:
    return f"round(({x}) * {10**digits}.0::DOUBLE) / {10**digits}.0::DOUBLE"


def _clamped(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {float(lo)}::DOUBLE), {float(hi)}::DOUBLE)"


@query(f"select rid, {_rounded('10.0::DOUBLE + ' + u('n', 'd') + ' * 90.0::DOUBLE')} as x" + FROM)
def gen_dist_uniform(spark, sf_dir):
    return people(spark, sf_dir).select("rid", scaled_round(sample(_dist("uniform"), draw("n"), 10, 100), 3).alias("x"))


@query(f"select rid, {_rounded(_clamped(_normal('n', 50, 15), 0, 100))} as x" + FROM)
def gen_dist_normal(spark, sf_dir):
    return people(spark, sf_dir).select("rid", scaled_round(sample(_dist("normal", mu=50, sigma=15), draw("n"), 0, 100), 3).alias("x"))


@query(f"select rid, {_rounded(_clamped('exp(' + _normal('n', 1, 0.5) + ')', 0, 500))} as x" + FROM)
def gen_dist_lognormal(spark, sf_dir):
    return people(spark, sf_dir).select("rid", scaled_round(sample(_dist("lognormal", mu=1, sigma=0.5), draw("n"), 0, 500), 3).alias("x"))


@query(f"select rid, {_rounded(_clamped('-ln(' + u_open('n', 'd') + ') / 2.0::DOUBLE', 0, 3600))} as x" + FROM)
def gen_dist_exponential(spark, sf_dir):
    return people(spark, sf_dir).select("rid", scaled_round(sample(_dist("exponential", **{"lambda": 2}), draw("n"), 0, 3600), 3).alias("x"))


@query(f"select rid, {_clamped('floor(ln(' + u_open('n', 'd') + ') / ln(0.7::DOUBLE))', 0, 50)} as x" + FROM)
def gen_dist_geometric(spark, sf_dir):
    return people(spark, sf_dir).select("rid", sample(_dist("geometric", p=0.3), draw("n"), 0, 50).alias("x"))


def _zipf_sql(s: float, n: int) -> str:
    return f"""with w as (select k, 1.0::DOUBLE / (k::DOUBLE ** {s}::DOUBLE) as m from range(1, {n + 1}) t(k)),
    c as (select k, sum(m) over (order by k) / sum(m) over () as hi from w)
    select rid, (select count(*) from c where k < {n} and hi <= x)::INTEGER + 1 as rank
    from (select c_custkey as rid, {u('n', 'z', 'c_custkey')} as x from customer)"""


@query(_zipf_sql(1.5, 50))
def gen_dist_zipf(spark, sf_dir):
    return people(spark, sf_dir).select("rid", zipf(draw("n"), 1.5, 50).cast("int").alias("rank"))


@query(f"select rid, {_rounded(_clamped('case when ' + u('n', 'side') + ' < 0.5 then ' + _normal('l', 20, 10) + ' else ' + _normal('r', 80, 10) + ' end', 0, 100))} as x" + FROM)
def gen_dist_bimodal(spark, sf_dir):
    spec = Decorator("dist", ("bimodal",), (("peaks", "20"), ("peaks", "80")))
    return people(spark, sf_dir).select("rid", scaled_round(sample(spec, draw("n"), 0, 100), 3).alias("x"))


def _letters_sql(value: str, alphabet: str, n: int) -> str:
    return " || ".join(f"substr('{alphabet}', (({value}) // {len(alphabet) ** (n - 1 - k)} % {len(alphabet)} + 1)::INTEGER, 1)" for k in range(n))


AZ, DIGITS, HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789ABCDEF"


@query(f"select rid, 'SKU-' || {_letters_sql('(' + h('s', 'p0') + ') % 676', AZ, 2)} || '-' || {_letters_sql('(' + h('s', 'p1') + ') % 10000', DIGITS, 4)} as sku" + FROM)
def gen_pattern_sku(spark, sf_dir):
    return people(spark, sf_dir).select("rid", expand("SKU-{AA}-{0000}", draw("s")).alias("sku"))


@query(f"select rid, 'SN-' || (rid + 1)::VARCHAR || '-' || {_letters_sql('(' + h('q', 'p1') + ') % 676', AZ, 2)} as serial" + FROM)
def gen_pattern_seq(spark, sf_dir):
    return people(spark, sf_dir).select("rid", expand("SN-{seq}-{AA}", draw("q")).alias("serial"))


@query(f"select rid, {_letters_sql('(' + h('x', 'p0') + ') % 4294967296', HEX, 8)} as token" + FROM)
def gen_pattern_hex(spark, sf_dir):
    return people(spark, sf_dir).select("rid", expand("{########}", draw("x")).alias("token"))


@query(f"select rid, {pick(WORDS, 'w', 'p0')} || '-' || {pick([w.upper() for w in WORDS], 'w', 'p1')} as label" + FROM)
def gen_pattern_words(spark, sf_dir):
    return people(spark, sf_dir).select("rid", expand("{word}-{WORD}", draw("w")).alias("label"))


_M = "md5('42|G|id|' || rid::VARCHAR)"


@query(f"select rid, substr({_M},1,8) || '-' || substr({_M},9,4) || '-4' || substr({_M},14,3) || '-' || (['8','9','a','b'])[(('0x' || substr({_M},17,1))::INTEGER) % 4 + 1] || substr({_M},18,3) || '-' || substr({_M},21,12) as id" + FROM)
def gen_uuid(spark, sf_dir):
    return people(spark, sf_dir).select("rid", uuid_of(F.concat(F.lit("42|G|id|"), F.col("rid").cast("string"))).alias("id"))


_PLACE, _STEP = spread("", 26 * 26 * 10000)


@query(f"select rid, 'U-' || {_letters_sql(f'{_PLACE} % 676', AZ, 2)} || '-' || {_letters_sql(f'{_PLACE} // 676 % 10000', DIGITS, 4)} as code" + FROM)
def gen_unique_pattern(spark, sf_dir):
    return people(spark, sf_dir).select("rid", expand("U-{AA}-{0000}", draw("u"), distinct=True).alias("code"))


@query(f"select rid, case when {u('o', 'null')} < 0.3 then null else ({h('o', 'v')}) % 100 end as score" + FROM)
def gen_null_rate(spark, sf_dir):
    return rows_of(spark, sf_dir, "o: int @range(0..99) @null_rate(0.3)").select("rid", F.col("o").alias("score"))


@query(f"select rid, coalesce(case when {u('df', 'null')} < 0.3 then null else {pick(('active', 'disabled'), 'df', 'v')} end, 'pending') as status" + FROM)
def gen_default(spark, sf_dir):
    return rows_of(spark, sf_dir, "df: 'enum(active, disabled) @null_rate(0.3) @default(pending)'").select("rid", F.col("df").alias("status"))


@query(f"select rid, {pick(('electronics', 'clothing', 'food'), 'va', 'values')} as category" + FROM)
def gen_values(spark, sf_dir):
    return people(spark, sf_dir).select("rid", decorated(F.lit(None).cast("string"), parse_field("category", "string @values(electronics, clothing, food)"), draw("va"), "string").alias("category"))


@query("select c_custkey as rid, substr(case when length(c_mktsegment) < 9 then rpad(c_mktsegment, 9, 'x') else c_mktsegment end, 1, 10) as name from customer")
def gen_len(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), fitted(F.col("c_mktsegment"), 9, 10).alias("name"))


@query("select c_custkey as rid, (least(greatest(round(c_acctbal / 250.0), ceil(-500.0 / 250.0)), floor(5000.0 / 250.0)) * 250.0)::DOUBLE + 0.0::DOUBLE as balance from customer")
def gen_multiple_of(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), snapped(F.col("c_acctbal"), 250, -500, 5000).alias("balance"))


@query("select c_custkey as rid, least(greatest(c_acctbal, 0.0), 5000.0) as balance, least(greatest(c_custkey, 11), 499) as key from customer")
def gen_min_max(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("rid"), within(F.col("c_acctbal"), 0, 5000).alias("balance"), within(F.col("c_custkey"), 11, 499, whole=True).alias("key"))


@query(f"select rid, ({h('fk', 'ref')}) % 25 as parent" + FROM)
def gen_fk(spark, sf_dir):
    return people(spark, sf_dir).select("rid", references.parent_index(draw("fk"), 25).alias("parent"))


@query(f"select rid, case when {u('fk', 'null')} < 0.2 then null else ({h('fk', 'ref')}) % 25 end as parent" + FROM)
def gen_fk_optional(spark, sf_dir):
    d = draw("fk")
    return people(spark, sf_dir).select("rid", F.when(d.chance(0.2, "null"), F.lit(None)).otherwise(references.parent_index(d, 25)).alias("parent"))


@query(f"select rid, case when rid > 0 then ({h('self', 'ref')}) % rid end as parent" + FROM)
def gen_self_ref(spark, sf_dir):
    return people(spark, sf_dir).select("rid", references.earlier_index(draw("self")).alias("parent"))


@query(f"select rid, case when ({h('po', 'type')}) % 2 = 0 then 'Post' else 'Photo' end as kind, case when ({h('po', 'type')}) % 2 = 0 then ({h('po', 'Post.ref')}) % 10 else ({h('po', 'Photo.ref')}) % 20 end as target" + FROM)
def gen_polymorphic(spark, sf_dir):
    d = draw("po")
    post = d.h("type") % 2 == 0
    target = F.when(post, references.parent_index(d.sub("Post"), 10)).otherwise(references.parent_index(d.sub("Photo"), 20))
    return people(spark, sf_dir).select("rid", F.when(post, "Post").otherwise("Photo").alias("kind"), target.alias("target"))


@query(f"""select distinct l as "left", ({h('mm', 'to', 'l * 4 + i')}) % 30 as "right"
    from (select rid as l, unnest(range(1, ((({h('mm', 'n')}) % 4) + 1 + 1))) as i from (select c_custkey as rid from customer))""")
def gen_m2m_bridge(spark, sf_dir):
    return references.bridge(people(spark, sf_dir).withColumnRenamed("rid", "_rid"), Draw(SEED, "G", "mm", F.col("_rid")), 30, 1, 4)


_FIRST = f"case when {u('pf', 'g')} < 0.5 then {pick(FIRST['female'], 'pf', 'f')} else {pick(FIRST['male'], 'pf', 'f')} end"


@query(f"select rid, {_FIRST} || ' ' || {pick(LAST, 'pf', 'l')} as name" + FROM)
def gen_person_full(spark, sf_dir):
    return people(spark, sf_dir).select("rid", F.concat_ws(" ", *person(draw("pf"))).alias("name"))


@query(f"select rid, regexp_replace(lower({_FIRST} || ' ' || {pick(LAST, 'pf', 'l')}), '[^a-z0-9]+', '.', 'g') || '@' || {pick(DOMAINS, 'pf', 'dom')} as email" + FROM)
def gen_email_from_name(spark, sf_dir):
    d = draw("pf")
    return people(spark, sf_dir).select("rid", email_of(F.concat_ws(" ", *person(d)), d).alias("email"))


@query("select rid, " + ", ".join(f"{pick([c[i] for c in CITIES], 'group:loc', 'row')} as {n}" for i, n in ((0, "city"), (1, "state"), (2, "zip"), (3, "timezone"))) + FROM)
def gen_location_bundle(spark, sf_dir):
    return rows_of(spark, sf_dir, "_coherence: {loc: [city, state, zip, timezone]}, city: string, state: string, zip: string, timezone: string").select("rid", "city", "state", "zip", "timezone")


_LOC = ", ".join(f"{pick([c[i] for c in CITIES], 'group:loc', 'row')} as {n}" for i, n in ((0, "city"), (2, "zip")))
_AREA = "case substr(zip, 1, 2) " + " ".join(f"when '{k}' then '{v}'" for k, v in AREA_CODES.items()) + " else '555' end"


@query(f"select rid, zip, '+1-' || {_AREA} || '-' || lpad((({h('phone', 'p1')}) % 1000)::VARCHAR, 3, '0') || '-' || lpad((({h('phone', 'p2')}) % 10000)::VARCHAR, 4, '0') as phone from (select rid, {_LOC}{FROM})")
def gen_phone_of_zip(spark, sf_dir):
    """A phone whose area code is that of the row's zip code."""
    return rows_of(spark, sf_dir, "_coherence: {loc: [city, zip]}, city: string, zip: string, phone: 'string @from(zip)'").select("rid", "zip", "phone")


_TOWNS = ("Buffalo NY", "Plano TX", "AUSTIN", "near boise", "OKLAHOMA", "Springfield XX / IL", "Nowhere")
_STATES = {c[1]: c[3] for c in reversed(CITIES)}


def _zone(c: str) -> str:
    """SQL of the time zone of a place: of the first city that it names, or of the first state whose code stands in it."""
    city = " ".join(f"when contains(lower({c}), '{x[0].lower()}') then '{x[3]}'" for x in CITIES)
    state = " ".join(f"when s = '{k}' then '{v}'" for k, v in _STATES.items())
    known = f"list_filter(list_transform(regexp_extract_all({c}, '\\b([A-Z]{{2}})\\b', 1), lambda s: case {state} end), lambda z: z is not null)"
    return f"case {city} else coalesce({known}[1], 'America/New_York') end"


@query(f"select rid, city, {_zone('city')} as home_timezone, town, {_zone('town')} as town_timezone from (select rid, {_LOC}, {pick(_TOWNS, 'town', 'v')} as town{FROM})")
def gen_timezone_of_city(spark, sf_dir):
    """The time zone of the city, in any case, or of the state that the row names."""
    towns = ", ".join(_TOWNS)
    made = rows_of(spark, sf_dir, f"_coherence: {{loc: [city, zip]}}, city: string, zip: string, home_timezone: 'string @from(city)', town: 'enum({towns})', town_timezone: 'string @from(town)'")
    return made.select("rid", "city", "home_timezone", "town", "town_timezone")


@query(f"select rid, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:n], ',') as items from (select rid, ({h('l', 'len')}) % 3 + 1 as n, [{', '.join(pick('abcd', 'l', f'{i}.v') for i in range(9))}] as l{FROM})")
def gen_unique_items(spark, sf_dir):
    """Lists whose items differ, in the order in which they were drawn."""
    return rows_of(spark, sf_dir, "l: '[enum(a, b, c, d)] @len(1..3) @unique_items'").select("rid", F.array_join("l", ",").alias("items"))


@query(f"select rid, case when {u('n', 'opt')} < 0.15 then null else ({h('n', 'v')}) % 100 end as n, 1::BIGINT as version, null::VARCHAR as note, '2025-01-15 10:30:00' as created_at, '2025-01-15 10:30:00' as updated_at{FROM}")
def gen_optional_auto(spark, sf_dir):
    """@optional leaves out 15 %; @auto fields and @timestamps are told by the time of the run."""
    made = rows_of(spark, sf_dir, "n: 'int @range(0..99) @optional', version: int @auto, note: string @auto, created_at: datetime @auto, updated_at: datetime @auto")
    return made.select("rid", "n", "version", "note", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "updated_at")])


@query(f"""select rid, x, least(1000.0::DOUBLE, greatest(0.0::DOUBLE, round(500.0::DOUBLE + (0.8::DOUBLE * ((x::DOUBLE - 49.5::DOUBLE) / {99 / 12**0.5!r}::DOUBLE) + {(1 - 0.8 * 0.8) ** 0.5!r}::DOUBLE * (({u('y', 'corr')} - 0.5::DOUBLE) * {12**0.5!r}::DOUBLE)) * {1000 / 12**0.5!r}::DOUBLE)))::BIGINT as y
    from (select rid, ({h('x', 'v')}) % 100 as x{FROM})""")
def gen_correlated(spark, sf_dir):
    """A number that goes with another one of the row, kept in its range."""
    return rows_of(spark, sf_dir, "x: int @range(0..99), y: 'int @range(0..1000) @correlated(x, 0.8)'").select("rid", "x", "y")


# ---- semantic families: types of one family as the fields of a row ----------------------------------------------------------


def _text(t: str) -> str:
    """The field that holds a type, as its name in SQL."""
    return t.replace(".", "_")


def _family(prefixes: tuple[str, ...]) -> dict[str, str]:
    """The types with a list behind them, with the SQL of their draw."""
    return {t: pick(values, _text(t), "v") for t, values in LISTS.items() if t.split(".")[0] in prefixes}


def _sentence(name: str, salt: str, n: int = 8) -> str:
    text = " || ' ' || ".join(pick(LOREM, name, f"{salt}{i}") for i in range(n))
    return f"upper(substr({text}, 1, 1)) || substr({text}, 2) || '.'"


def _hex(name: str, salt: str, digits: int) -> str:
    return f"lower(lpad(to_hex(({h(name, salt)}) % {16**digits}), {digits}, '0'))"


def _below(name: str, salt: str, low: int, high: int) -> str:
    return f"({low} + ({h(name, salt)}) % {high - low + 1})::VARCHAR"


def semantic_query(name: str, types: dict[str, str], doc: str) -> None:
    """Registers a query whose rows hold a value of each type, in fields named after them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows_of(spark, sf_dir, ", ".join(f"{_text(t)}: {t}" for t in types)).select("rid", *[_text(t) for t in types])

    run.__name__, run.__doc__ = name, doc
    query("select rid, " + ", ".join(f"{sql} as {_text(t)}" for t, sql in types.items()) + FROM)(run)


_ACCOUNTS = {(low, high): [r for _, chart in sorted(CHARTS.items()) for r in chart if low <= len(r[0]) <= high] for low, high in ((1, 1), (2, 2), (3, 4))}
semantic_query("gen_family_erp", _family(("erp",)), "Terms, units, taxes and kinds of accounts.")
semantic_query("gen_family_ecommerce", _family(("ecommerce",)), "States, methods, carriers and departments of orders.")
semantic_query("gen_family_product", _family(("product", "company", "job", "person", "file", "color")) | {
    "product.title": pick(LISTS["product.adjective"], "product_title", "a") + " || ' ' || " + pick(LISTS["product.noun"], "product_title", "n"),
    "company.name": pick(LAST, "company_name", "c") + " || ' ' || " + pick(["Ltd", "Inc", "GmbH", "SA", "Group", "Partners"], "company_name", "k"),
    "file.name": pick(LOREM, "file_name", "n") + " || '.' || " + pick(LISTS["file.extension"], "file_name", "e"),
}, "Products, companies, jobs and files.")
semantic_query("gen_family_text", {
    "text.word": pick(LOREM, "text_word", "w"),
    "text.sentence": _sentence("text_sentence", "s"),
    "text.paragraph": " || ' ' || ".join(_sentence("text_paragraph", f"par{i}") for i in range(3)),
    "text.slug": " || '-' || ".join(pick(LOREM, "text_slug", f"w{i}") for i in range(3)),
    "text.html": "'<p>' || " + " || ' ' || ".join(_sentence("text_html", f"par{i}") for i in range(3)) + " || '</p>'",
}, "Words, sentences, paragraphs and marked-up text.")
semantic_query("gen_family_ids", {
    "color.hex": f"'#' || {_hex('color_hex', 'c', 6)}",
    "color.rgb": "'rgb(' || " + " || ', ' || ".join(_below("color_rgb", c, 0, 255) for c in "rgb") + " || ')'",
    "hash.md5": f"md5(({h('hash_md5', 'x')})::VARCHAR)",
    "hash.sha256": f"sha256(({h('hash_sha256', 'x')})::VARCHAR)",
    "mac": " || ':' || ".join(_hex("mac", f"o{i}", 2) for i in range(6)),
    "ipv6": " || ':' || ".join(_hex("ipv6", f"o{i}", 4) for i in range(8)),
    "ipv4": " || '.' || ".join(_below("ipv4", f"o{i}", 1, 254) for i in range(4)),
    "url": f"'https://' || {pick(DOMAINS, 'url', 'dom')} || '/' || {pick(WORDS, 'url', 'path')}",
}, "Colours, hashes and addresses of networks.")
semantic_query("gen_family_finance", {
    "iban": f"'DE' || lpad((98 - (({h('iban', 'p1')}) % 97 * {10**6 % 97} + 131400) % 97)::VARCHAR, 2, '0') || lpad(({h('iban', 'p1')})::VARCHAR, 18, '0')",
    "swift": pick(LISTS["swift"], "swift", "v"),
    "credit_card.type": pick(LISTS["credit_card.type"], "credit_card_type", "v"),
}, "Account numbers whose check digits hold, banks and cards.")
semantic_query("gen_family_accounting", {
    f"accounting.{name}{suffix}": pick([r[part] for r in _ACCOUNTS[size]], f"accounting_{name}{suffix}", "row")
    for name, size in (("group", (1, 1)), ("subgroup", (2, 2)), ("account", (3, 4)))
    for suffix, part in (("", 0), ("_name", 1), ("_name_en", 2))
}, "Charts of accounts, by the length of their codes.")
semantic_query("gen_family_taxonomy", {
    f"taxonomy.{name}_{suffix}": pick([r[part] for r in rows], f"taxonomy_{name}_{suffix}", "row") for name, rows in TAXONOMIES.items() for suffix, part in (("code", 0), ("description", 1))
}, "Codes of public classifications and their titles.")


def _luhn_sql() -> str:
    """Sixteen digits: a 4, fourteen draws, and what makes the sum of Luhn a multiple of ten."""
    body = ["4", *[f"({h('cc', f'c{i}')}) % 10" for i in range(14)]]
    part = lambda i: f"(list_sum(list_transform(str_split(({body[i]} * {2 - i % 2})::VARCHAR, ''), lambda c: c::INTEGER)))"
    total = " + ".join(part(i) for i in range(15))
    return f"select rid, {' || '.join(f'({x})::VARCHAR' for x in body)} || ((10 - ({total}) % 10) % 10)::INTEGER::VARCHAR as card, true as valid" + FROM


@query(_luhn_sql())
def gen_credit_card_luhn(spark, sf_dir):
    card = luhn_card(draw("cc"))
    return people(spark, sf_dir).select("rid", card.alias("card"), F.call_function("luhn_check", card).alias("valid"))


# Documents, end to end. Row n of an entity has the draws of (seed, entity, field, n); `numbered` is the table of those n.

numbered = "(select unnest(range((select count(*) from customer))) as rid)"


def made(spark: SparkSession, sf_dir: str, text: str, *names: str) -> dict[str, DataFrame]:
    """The entities of a document, with as many rows as there are customers in those named, by default G."""
    from .plans.generate import generate

    n = read(spark, sf_dir, "customer").count()
    return generate(spark, parse_document(f"domain: x\nseed: {SEED}\n{text}"), volume=dict.fromkeys(names or ("G",), n))


@query(f"""with d as (select rid, timestamp '2004-01-01 00:00:00' + to_seconds(({h('placed', 'v')}) % (epoch(timestamp '2024-01-01 00:00:00') - epoch(timestamp '2004-01-01 00:00:00') + 1)::BIGINT) as placed from {numbered})
    select rid + 1 as id, placed, placed + to_seconds(({h('shipped', 'gap')}) % 2592000 + 1) as shipped, placed - to_seconds(({h('asked', 'gap')}) % 2592000 + 1) as asked, placed + to_seconds(({h('paid', 'gap')}) % 604800 + 1) as paid from d""")
def gen_temporal_after(spark, sf_dir):
    """Moments after, before and within days of another field."""
    return made(spark, sf_dir, """
entities:
  G: {id: int @primary, placed: 'datetime @range(2004-01-01..2024-01-01)', shipped: datetime @after(placed), asked: datetime @before(placed), paid: 'datetime @within(7d, placed)'}
""")["G"]


@query(f"""with u as (select rid, 18 + ({h('age', 'v', 'rid', 'User')}) % 48 as age from {numbered}),
    o as (select rid, ({h('user', 'ref', 'rid', 'Order')}) % (select count(*) from customer) as parent, round((1.0::DOUBLE + (({h('amount', 'v', 'rid', 'Order')})::DOUBLE / 4503599627370496.0) * 499.0::DOUBLE) * 100) / 100.0::DOUBLE as amount from {numbered})
    select o.rid + 1 as id, parent + 1 as "user", amount, u.age as buyer_age, round((amount * 0.1::DOUBLE) * 100) / 100.0::DOUBLE as fee,
        case when u.age >= 40 then 'senior' else 'junior' end as class from o join u on u.rid = o.parent""")
def gen_document(spark, sf_dir):
    """A document end to end: references, dereferenced, computed and derived fields and a strict rule."""
    return made(spark, sf_dir, """
entities:
  User: {id: int @primary, name: person.full, email: email @from(name), age: int @range(18..65)}
  Order:
    id: int @primary
    user: ->User
    amount: float @range(1..500)
    buyer_age: int @derived(user.age)
    fee: float @derived(round(amount * 0.1, 2))
    class: {type: string, compute: [{when: "user.age >= 40", value: "'senior'"}, {else: "'junior'"}]}
rules: [Order.amount > 0 @strict]
""", "User", "Order")["Order"]


def _rounds(value: str, attempts: int = 4) -> str:
    """CTEs r0, r1, ...: rows that take their value at attempt k, the first by rid of those that ask for a free one."""
    out, before = [], []
    for k in range(attempts):
        open_ = " ".join(f"and rid not in (select rid from r{j})" for j in before)
        free = " ".join(f"and v not in (select v from r{j})" for j in before)
        out.append(f"t{k} as (select rid, {value.replace('ATTEMPT', str(k))} as v from {numbered} where true {open_})")
        out.append(f"r{k} as (select min(rid) as rid, v from t{k} where true {free} group by v)")
        before.append(k)
    return ", ".join(out) + ", won as (" + " union all ".join(f"select * from r{k}" for k in before) + ")"


@query(f"with {_rounds('1 + (' + h('n', 'v').replace(chr(39) + '0' + chr(39), chr(39) + 'ATTEMPT' + chr(39)) + ') % 100000')} select rid + 1 as id, v as n, 2 * v as twice from won")
def doc_unique_derived(spark, sf_dir):
    """Uniqueness is resolved before derived fields and rules, which see the final values."""
    return made(spark, sf_dir, "entities: {G: {id: int @primary, n: 'int @range(1..100000) @unique', twice: int @derived(n * 2)}}\nrules: [G.twice > G.n @strict]")["G"]


@query(f"with {_rounds('1000 * (1 + (' + h('k', 'v').replace(chr(39) + '0' + chr(39), chr(39) + 'ATTEMPT' + chr(39)) + ') % 300) + (1 + (' + h('v', 'v').replace(chr(39) + '0' + chr(39), chr(39) + 'ATTEMPT' + chr(39)) + ') % 300)')} select rid + 1 as id, v // 1000 as k, v % 1000 as v from won")
def doc_rule_unique(spark, sf_dir):
    """No two rows agree on both fields: those that do are made again."""
    return made(spark, sf_dir, "entities: {G: {id: int @primary, k: int @range(1..300), v: int @range(1..300)}}\nrules: ['unique(G.k, G.v) @strict']")["G"]


@query(f"""with p as (select rid, 0::BIGINT as mixed from (select unnest(range((select count(*) from customer))) as rid)),
    c as (select rid, ({h('p', 'ref', 'rid', 'C')}) % (select count(*) from customer) as p, (['a', 'b'])[({h('v', 'v', 'rid', 'C')}) % 2 + 1] as v from {numbered}),
    hit as (select p from c group by p having count(*) >= 2 and min(v) <> max(v) and (('0x' || substr(md5(concat_ws('|', '{SEED}|C|rule0', (p + 1)::VARCHAR, 'bind', '0')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) < 0.6)
    select rid + 1 as id, case when rid in (select p from hit) then 1 else 0 end::BIGINT as mixed from p""")
def doc_rule_cross_row(spark, sf_dir):
    """Parents whose children do not agree are marked, with a probability."""
    return made(spark, sf_dir, """
entities:
  P: {id: int @primary, mixed: int @range(0..0)}
  C: {id: int @primary, p: ->P, v: "enum(a, b)"}
rules:
  - cross_row: {entity: C, group_by: p, check: all_equal(v), probability: 0.6, on_violation: {set: {P.mixed: "1"}}}
""", "P", "C")["P"]


@query(f"""select rid + 1 as id, 1 + ({h('label', 'v', '(' + h('a', 'ref', 'rid', 'B') + ') % (select count(*) from customer)', 'A')}) % 900000 as a,
    (['red', 'green', 'blue'])[({h('name', 'v', '(' + h('c', 'ref', 'rid', 'B') + ') % (select count(*) from customer)', 'C')}) % 3 + 1] as c from {numbered}""")
def doc_string_key(spark, sf_dir):
    """Parents without a primary key are known by their first field, whatever its type."""
    return made(spark, sf_dir, """
entities:
  A: {label: int @range(1..900000), other: int}
  C: {name: "enum(red, green, blue)"}
  B: {id: int @primary, a: ->A, c: ->C}
""", "A", "B", "C")["B"]


@query(f"""with g as (select rid, 1 + ({h('v', 'v')}) % 500 as v from {numbered}), t as (select sum(v)::BIGINT as total, count(*) as n, avg(v) as mean, max(v) as top from g)
    select rid + 1 as id, total, n, round(mean * 1000) / 1000.0::DOUBLE as mean, 2 * top as twice, n > 10 and total > 0 as many from t, range(3) r(rid)""")
def doc_agg_sum(spark, sf_dir):
    """Derived fields over all rows of another entity."""
    return made(spark, sf_dir, """
volume: {T: 3}
entities:
  G: {id: int @primary, v: int @range(1..500)}
  T: {id: int @primary, total: int @derived(sum(G.v)), n: int @derived(count(G)), mean: "float @derived(round(avg(G.v), 3))", twice: int @derived(max(G.v) * 2), many: bool @derived(count(G) > 10 and sum(G.v) > 0)}
""")["T"]


@query(f"""with p as (select rid, ({h('at', 'v', 'rid', 'C')}) % 40 as at, 1 + ({h('v', 'v', 'rid', 'C')}) % 500 as v, ({h('p', 'ref', 'rid', 'C')}) % (select count(*) from customer) as p from {numbered})
    select g.rid + 1 as id, coalesce(sum(v), 0)::BIGINT as total, count(v) as n, coalesce(sum(v), 0)::BIGINT * 2 + count(v) as both from {numbered} g left join p on p.p = g.rid group by 1""")
def doc_agg_children(spark, sf_dir):
    """Derived fields over the children of each row, also within larger expressions."""
    return made(spark, sf_dir, """
entities:
  P: {id: int @primary, cs: "[C]", total: int @derived(sum(cs.v)), n: int @derived(count(cs)), both: int @derived(sum(cs.v) * 2 + count(cs))}
  C: {id: int @primary, p: ->P, at: int @range(0..39), v: int @range(1..500)}
rules: ["P.n >= 0 @strict", "count(P.cs) >= 0 @strict"]
""", "P", "C")["P"]


@query(f"""with g as (select rid, 1 + ({h('v', 'v')}) % 500 as v from {numbered}), l as (select max_by(v, rid) as last from g), t as (select rid, 1 + ({h('x', 'v', 'rid', 'T')}) % 9 as x from {numbered})
    select rid + 1 as id, x, last, x + last as both from t, l""")
def doc_cross_entity(spark, sf_dir):
    """A path that begins with another entity leads to its last row."""
    return made(spark, sf_dir, """
entities:
  G: {id: int @primary, v: int @range(1..500)}
  T: {id: int @primary, x: int @range(1..9), last: int @derived(G.v), both: int @derived(x + G.v)}
rules: ["T.x <= 9 @strict"]
""", "G", "T")["T"]


_kids = f"""c as (select rid, ({h('p', 'ref', 'rid', 'C')}) % (select count(*) from customer) as p, 1 + ({h('v', 'v', 'rid', 'C')}) % 500 as v from {numbered}),
    t as (select p, sum(v)::BIGINT as total, count(*) as n from c group by p)"""
KIDS = """
entities:
  P: {id: int @primary, cs: "[C]", size: {type: string, compute: [{when: "count(cs) > 1", value: "'many'"}, {else: "'few'"}]}, total: int @derived(sum(cs.v)), twice: int @derived(total * 2), best: int @derived(max(cs.share))}
  C: {id: int @primary, p: ->P, v: int @range(1..500), ptotal: int @derived(p.total), share: int @derived(ptotal - v), shown: {type: int, default_chain: [share]}}
rules: ["sum(P.cs.v) >= 0 @strict", "C.share >= 0 @strict"]
"""


@query(f"with {_kids} select g.rid + 1 as id, case when n > 1 then 'many' else 'few' end as size, coalesce(total, 0)::BIGINT as total, coalesce(total, 0)::BIGINT * 2 as twice, (select max(total - v) from c where c.p = g.rid)::BIGINT as best from {numbered} g left join t on t.p = g.rid")
def doc_derived_over_children(spark, sf_dir):
    """What builds on a sum over children, in the same row and, over the children, in it again."""
    return made(spark, sf_dir, KIDS, "P", "C")["P"]


@query(f"with {_kids} select rid + 1 as id, c.p + 1 as p, v, total as ptotal, (total - v)::BIGINT as share, (total - v)::BIGINT as shown from c join t on t.p = c.p")
def doc_child_reads_total(spark, sf_dir):
    """Children read the sum over themselves and their siblings from their parent, and build on it."""
    return made(spark, sf_dir, KIDS, "P", "C")["C"]


@query(f"""with c as (select rid, ({h('p', 'ref', 'rid', 'C')}) % (select count(*) from customer) as p, (['a', 'b'])[({h('v', 'v', 'rid', 'C')}) % 2 + 1] as v from {numbered}),
    hit as (select p from c group by p having count(*) >= 2 and min(v) <> max(v) and (('0x' || substr(md5(concat_ws('|', '{SEED}|C|rule0', (p + 1)::VARCHAR, 'bind', '0')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) < 0.6)
    select rid + 1 as id, p + 1 as p, v, case when p in (select p from hit) then 7 else 0 end::BIGINT as seen, case when p in (select p from hit) then 8 else 1 end::BIGINT as after from c""")
def doc_cross_row_rederived(spark, sf_dir):
    """What reads a field that a rule across rows sets sees what is set, in its own row and from others."""
    return made(spark, sf_dir, """
entities:
  P: {id: int @primary, mixed: int @range(0..0), after: int @derived(mixed + 1)}
  C: {id: int @primary, p: ->P, v: "enum(a, b)", seen: int @derived(p.mixed), after: int @derived(p.after)}
rules:
  - cross_row: {entity: C, group_by: p, check: all_equal(v), probability: 0.6, on_violation: {set: {P.mixed: "7"}}}
  - P.after > P.mixed @strict
""", "P", "C")["C"]


_late = _rounds("1 + (" + h("k", "v", "rid", "A").replace(chr(39) + "0" + chr(39), chr(39) + "ATTEMPT" + chr(39)) + ") % 100000")
LATE = """
entities:
  A: {k: "int @range(1..100000) @unique", pal: "->self?"}
  P: {id: int @primary, name: string}
  B: {id: int @primary, x: "->A | ->P", as: "[->A] @len(0..2)", friends: "<->A @count(1..3)"}
rules: [A.k > 0 @strict]
"""


@query(f"""with {_late}, b as (select rid, ({h('x', 'type', 'rid', 'B')}) % 2 as type, ({h('x', 'A.ref', 'rid', 'B')}) % (select count(*) from customer) as a, ({h('x', 'P.ref', 'rid', 'B')}) % (select count(*) from customer) as p,
        ({h('as', 'len', 'rid', 'B')}) % 3 as n, ({h('as', '0.ref', 'rid', 'B')}) % (select count(*) from customer) as a0, ({h('as', '1.ref', 'rid', 'B')}) % (select count(*) from customer) as a1 from {numbered})
    select b.rid + 1 as id, case when type = 0 then 'A' else 'P' end as type, case when type = 0 then w.v else b.p + 1 end as key, case n when 0 then '' when 1 then w0.v::VARCHAR else concat_ws(',', w0.v, w1.v) end as keys
    from b join won w on w.rid = b.a join won w0 on w0.rid = b.a0 join won w1 on w1.rid = b.a1""")
def doc_poly_key(spark, sf_dir):
    """Polymorphic references and lists of references hold keys that are known only once their rows are made."""
    b = made(spark, sf_dir, LATE, "A", "P", "B")["B"]
    return b.select("id", F.col("x.type").alias("type"), F.col("x.id").alias("key"), F.array_join(F.col("as").cast("array<string>"), ",").alias("keys"))


@query(f"""with {_late}, a as (select rid, case when {u('pal', 'null', 'rid', 'A')} < 0.7::DOUBLE or rid = 0 then null else ({h('pal', 'ref', 'rid', 'A')}) % greatest(rid, 1) end as pal from {numbered}),
    b as (select rid, ({h('friends', 'n', 'rid', 'B')}) % 3 + 1 as n from {numbered}),
    l as (select distinct rid, ({h('friends', 'to', '(rid * 3 + i)', 'B')}) % (select count(*) from customer) as a from (select rid, unnest(range(1, n + 1)) as i from b))
    select l.rid + 1 as b_id, w.v as a_id, p.v as pal from l join a on a.rid = l.a join won w on w.rid = l.a left join won p on p.rid = a.pal""")
def doc_m2m_key(spark, sf_dir):
    """Many-to-many links, and references to rows of the same entity, hold keys that are known late."""
    out = made(spark, sf_dir, LATE, "A", "P", "B")
    return out["B.friends"].join(out["A"].select(F.col("k").alias("a_id"), "pal"), "a_id")


_dealt = f"""p as (select rid, 2 + ({h('children:C.p', 'n', 'rid', 'P')}) % 3 as n from {numbered}),
    placed as (select rid, n, coalesce(sum(n) over (order by rid rows between unbounded preceding and 1 preceding), 0)::BIGINT as start from p),
    c as (select start + i as rid, rid as p from (select rid, start, unnest(range(n)) as i from placed))"""


@query(f"with {_dealt} select rid + 1 as id, p + 1 as p, 1 + ({h('v', 'v', 'rid', 'C')}) % 500 as v from c")
def doc_count_rule(spark, sf_dir):
    """Parents draw how many children they have, within what @count and a rule allow; children are made from parents."""
    return made(spark, sf_dir, """
entities:
  P: {id: int @primary, cs: "[C] @count(2..6)"}
  C: {id: int @primary, p: ->P, v: int @range(1..500)}
rules: ["count(P.cs) in 1..4 @strict", "C.v > 0 @strict"]
""", "P")["C"]


_dealt_items = f"""p as (select rid, 1 + ({h('children:I.o', 'n', 'rid', 'O')}) % 4 as n, round((10.0::DOUBLE + {u('total', 'v', 'rid', 'O')} * 490.0::DOUBLE) * 100)::HUGEINT as t from {numbered}),
    placed as (select rid, n, t, coalesce(sum(n) over (order by rid rows between unbounded preceding and 1 preceding), 0)::BIGINT as start from p),
    i as (select start + i as rid, o, t from (select rid as o, t, start, unnest(range(n)) as i from placed)),
    s as (select rid, o, t, round((1.0::DOUBLE + {u('price', 'v', 'rid', 'I')} * 49.0::DOUBLE) * 100)::HUGEINT as w from i)"""


def _shares(rows: str, group: str) -> str:
    """CTEs q and r of rows (rid, group, t, w): t dealt out by w, as cents."""
    return f"""q as (select *, (t * w) // sum(w) over (partition by {group}) as share, (t * w) % sum(w) over (partition by {group}) as rest from {rows}),
    r as (select *, (share + case when row_number() over (partition by {group} order by rest desc, rid) <= t - sum(share) over (partition by {group}) then 1 else 0 end)::DOUBLE as cents from q)"""


@query(f"with {_dealt_items}, {_shares('s', 'o')} select rid + 1 as id, o + 1 as o, cents / 100.0::DOUBLE as price, round(cents / 100.0::DOUBLE * 2.0::DOUBLE * 100) / 100.0::DOUBLE as fee from r")
def doc_sum_rule(spark, sf_dir):
    """A rule on a sum over children deals the parent's total out to them by largest remainders, and what builds on it follows."""
    return made(spark, sf_dir, """
entities:
  O: {id: int @primary, items: "[I] @count(1..4)", total: float @range(10..500)}
  I: {id: int @primary, o: ->O, price: float @range(1..50), fee: {type: float, compute: [{else: "round(price * 2.0, 2)"}]}}
rules: ["sum(O.items.price) == O.total @strict"]
""", "O")["I"]


@query(f"""with p as (select rid, 1 + ({h('children:Claim.policy', 'n', 'rid', 'Policy')}) % 3 as n, ({h('holder', 'ref', 'rid', 'Policy')}) % (select count(*) from customer) as holder from {numbered}),
    pat as (select *, coalesce(sum(n) over (order by rid rows between unbounded preceding and 1 preceding), 0)::BIGINT as start from p),
    c0 as (select start + i as rid, policy, holder from (select rid as policy, holder, start, unnest(range(n)) as i from pat)),
    c as (select c0.*, (['open', 'closed'])[({h('status', 'v', 'rid', 'Claim')}) % 2 + 1] as status, round((10.0::DOUBLE + {u('amount', 'v', 'rid', 'Claim')} * 390.0::DOUBLE) * 100)::HUGEINT as t,
                 (['N', 'S', 'E', 'W'])[({h('code', 'v', '(' + h('region', 'ref', 'holder', 'Holder') + ') % 7', 'Region')}) % 4 + 1] as gl, 1 + ({h('children:Line.claim', 'n', 'rid', 'Claim')}) % 4 as n from c0),
    cat as (select *, coalesce(sum(n) over (order by rid rows between unbounded preceding and 1 preceding), 0)::BIGINT as start from c),
    l as (select start + i as rid, claim, policy, t, gl, status from (select rid as claim, policy, t, gl, status, start, unnest(range(n)) as i from cat)),
    s as (select l.*, round((1.0::DOUBLE + {u('cost', 'v', 'rid', 'Line')} * 49.0::DOUBLE) * 100)::HUGEINT as w from l), {_shares('s', 'claim')},
    pol as (select policy, sum(case when status = 'closed' then t else 0 end)::DOUBLE / 100.0::DOUBLE as paid, count(*) >= 2 and min(status) <> max(status) as mixed from c group by 1)
    select r.rid + 1 as id, claim + 1 as claim, cents / 100.0::DOUBLE as cost, concat(gl, '-', case when paid > 300 then 'high' when mixed then 'mixed' else 'low' end) as posted from r join pol using (policy)""")
def doc_gl_scenario(spark, sf_dir):
    """Claims of policies end to end: children by counts, lines that sum up to their claim, a chain over three hops, a rule across
    the claims of a policy, sums and classes of policies, and lines that read them all."""
    return made(spark, sf_dir, """
volume: {Region: 7}
entities:
  Region: {id: int @primary, code: "enum(N, S, E, W)"}
  Holder: {id: int @primary, region: ->Region, name: person.full}
  Policy:
    id: int @primary
    holder: ->Holder
    claims: "[Claim] @count(1..3)"
    mixed: int @range(0..0)
    paid: float @derived(sum(claims.paid))
    class: {type: string, compute: [{when: "paid > 300", value: "'high'"}, {when: "mixed == 1", value: "'mixed'"}, {else: "'low'"}]}
  Claim:
    id: int @primary
    policy: ->Policy
    lines: "[Line]"
    status: "enum(open, closed)"
    amount: float @range(10..400)
    paid: {type: float, compute: [{when: "status == 'closed'", value: "amount"}, {else: "0.0"}]}
    gl: {type: string, default_chain: [policy.holder.region.code], fallback: "'none'"}
  Line: {id: int @primary, claim: ->Claim, cost: float @range(1..50), posted: 'string @derived(concat(claim.gl, "-", claim.policy.class))'}
rules:
  - count(Claim.lines) in 1..4 @strict
  - sum(Claim.lines.cost) == Claim.amount @strict
  - Claim.amount >= 10 @strict
  - cross_row: {entity: Claim, group_by: policy, check: all_equal(status), on_violation: {set: {Policy.mixed: "1"}}}
""", "Holder", "Policy")["Line"]


_n = f"(({h('code', 'regex')}) % 2028000)"


@query(f"""with g as (select rid, {_n} as n, {spread('code2', 676000)[0]} as m, {spread('k', 50000)[0]} as k from {numbered}),
    t as (select *, n // 3 % 1000 as digits, n // 3000 as letters from g)
    select rid + 1 as id, concat(chr((65 + letters // 26)::INTEGER), chr((65 + letters % 26)::INTEGER), '-', lpad(digits::VARCHAR, 3, '0'), (['', 'x', 'yz'])[n % 3 + 1]) as code,
        concat(chr((65 + m // 26000)::INTEGER), chr((65 + m // 1000 % 26)::INTEGER), lpad((m % 1000)::VARCHAR, 3, '0')) as code2, k + 10 as k from t""")
def gen_pattern_regex(spark, sf_dir):
    """Texts of regular expressions, drawn or, where they must be unique, spread over all texts; and unique whole numbers."""
    return made(spark, sf_dir, """
entities:
  G: {id: int @primary, code: 'string @pattern("[A-Z]{2}-[0-9]{3}(x|yz)?")', code2: 'string @pattern("^[A-Z]{2}[0-9]{3}$") @unique', k: 'int @range(10..50009) @unique'}
""")["G"]


@query(f"select rid + 1 as id, {spread('n', 20000)[0]} + 1 as n from {numbered}")
def gen_unique_finite(spark, sf_dir):
    """A unique field of a space of little more than its rows: a bijection, no rounds."""
    return made(spark, sf_dir, "entities: {G: {id: int @primary, n: 'int @range(1..20000) @unique'}}")["G"]


_alias = """
    l as (select row_number() over (order by code, price, p_size) - 1 as slot, * from (select p_name as code, p_retailprice as price, p_size from part where p_size > 0)),
    z as (select count(*) as n, sum(p_size)::BIGINT as total from l),
    light as (select slot, gap, coalesce(sum(gap) over (order by slot rows between unbounded preceding and 1 preceding), 0)::BIGINT as low from (select slot, total - p_size::BIGINT * n as gap from l, z) where gap > 0),
    heavy as (select slot, more, coalesce(sum(more) over (order by slot rows between unbounded preceding and 1 preceding), 0)::BIGINT as low, lead(slot) over (order by slot) as following from (select slot, p_size::BIGINT * n - total as more from l, z) where more > 0),
    al as (select light.slot, total - gap as keep, heavy.slot as alias from z, light asof join heavy on light.low >= heavy.low
           union all select h.slot, total + h.last + 1 - (light.low + light.gap), h.following from z, (select *, low + more - 1 as last from heavy) h asof join light on h.last >= light.low),
    d as (select l.slot, coalesce(keep, total) as keep, l.code, l.price, coalesce(o.code, l.code) as other_code, coalesce(o.price, l.price) as other_price, n, total
          from z, l left join al using (slot) left join l o on o.slot = al.alias)"""


def _drawn(column: str, name: str) -> str:
    return f"(select case when ({h(name, 'coin', 'g.rid')}) % total < keep then {column} else other_{column} end from d where d.slot = ({h(name, 'slot', 'g.rid')}) % n)"


def _parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"product": read(spark, sf_dir, "part").select(F.col("p_name").alias("code"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("weight"))}


@query(f"with {_alias} select rid + 1 as id, {_drawn('code', 'item.product')} as item from {numbered} g")
def gen_list_weighted(spark, sf_dir):
    """A semantic type that draws rows of a prepared list by their weights, through an alias table."""
    from .plans.generate import generate

    doc = parse_document(f"domain: x\nseed: {SEED}\nentities: {{G: {{id: int @primary, item: product.code}}}}")
    return generate(spark, doc, volume={"G": read(spark, sf_dir, "customer").count()}, lists=_parts(spark, sf_dir))["G"]


@query(f"with {_alias} select rid + 1 as id, {_drawn('code', 'bought.product')} as item, {_drawn('price', 'bought.product')} as price, {_drawn('code', 'gift.product')} as gift from {numbered} g")
def gen_list_coherent(spark, sf_dir):
    """The fields of a coherence group come from one row of a list; another field draws for itself."""
    from .plans.generate import generate

    doc = parse_document(f"domain: x\nseed: {SEED}\nentities: {{G: {{_coherence: {{bought: [item, price]}}, id: int @primary, item: product.code, price: product.price, gift: product.code}}}}")
    return generate(spark, doc, volume={"G": read(spark, sf_dir, "customer").count()}, lists=_parts(spark, sf_dir))["G"]


TREE = """
domain: x
entities:
  Region: {r_regionkey: int @primary, r_name: string}
  Nation:
    _triggers: [{on: customers.c_acctbal, recompute: [total]}]
    n_nationkey: int @primary
    n_name: string
    n_regionkey: ->Region @cascade
    customers: "[Customer]"
    total: float @derived(round(sum(customers.c_acctbal), 2))
  Customer:
    _triggers: [{on: c_acctbal, recompute: [tier], validate: [c_acctbal]}]
    c_custkey: int @primary
    c_nationkey: ->Nation @cascade
    c_acctbal: float
    tier: {type: string, compute: [{when: "c_acctbal > 5000", value: "'gold'"}, {else: "'plain'"}]}
  Supplier: {s_suppkey: int @primary, s_nationkey: "->Nation? @set_null"}
  Orders: {o_orderkey: int @primary, o_custkey: ->Customer @cascade}
rules: [Customer.c_acctbal < 1000000 @strict]
"""


def _tree(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    take = lambda n, *c: read(spark, sf_dir, n.lower()).select(*c)
    return {
        "Region": take("Region", "r_regionkey", "r_name"), "Supplier": take("Supplier", "s_suppkey", "s_nationkey"), "Orders": take("Orders", "o_orderkey", "o_custkey"),
        "Nation": take("Nation", "n_nationkey", "n_name", "n_regionkey", F.lit(0.5).alias("total")), "Customer": take("Customer", "c_custkey", "c_nationkey", "c_acctbal", F.lit("old").alias("tier")),
    }


_left_nations = "(select n_nationkey from nation where n_regionkey <> 1)"


@query(f"select 'order' as kind, o_orderkey as key, o_custkey as of from orders where o_custkey in (select c_custkey from customer where c_nationkey in {_left_nations}) union all select 'supplier', s_suppkey, case when s_nationkey in {_left_nations} then s_nationkey end from supplier")
def tool_delete_cascade(spark, sf_dir):
    """A region is deleted; nations, their customers and their orders go with it, suppliers lose their nation."""
    tables = _tree(spark, sf_dir)
    out = changes.apply_changes(tables, parse_document(TREE), [changes.Change("Region", "delete", tables["Region"].where("r_regionkey = 1"))])
    orders = out["Orders"].select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("of"))
    return orders.unionByName(out["Supplier"].select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("long").alias("of")))


def _updated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = _tree(spark, sf_dir)
    more = tables["Customer"].where("c_custkey % 7 = 0 and c_nationkey < 12").select("c_custkey", (F.round(F.col("c_acctbal") + 1000, 2)).alias("c_acctbal"))
    return changes.apply_changes(tables, parse_document(TREE), [changes.Change("Customer", "update", more)])


@query("select c_custkey, case when hit then round(c_acctbal + 1000, 2) else c_acctbal end as c_acctbal, case when not hit then 'old' when round(c_acctbal + 1000, 2) > 5000 then 'gold' else 'plain' end as tier from (select *, c_custkey % 7 = 0 and c_nationkey < 12 as hit from customer)")
def tool_update_trigger(spark, sf_dir):
    """An update computes the fields anew that its triggers name, in the touched rows only."""
    return _updated(spark, sf_dir)["Customer"].select("c_custkey", "c_acctbal", "tier")


@query("""with t as (select c_nationkey, sum(case when c_custkey % 7 = 0 and c_nationkey < 12 then round(c_acctbal + 1000, 2) else c_acctbal end) as total, bool_or(c_custkey % 7 = 0 and c_nationkey < 12) as hit from customer group by 1)
    select n_nationkey, round(case when hit then round(total, 2) else 0.5 end, 2) as total from nation left join t on c_nationkey = n_nationkey""")
def tool_update_parents(spark, sf_dir):
    """Parents of touched rows sum up their children anew; the others keep what they have."""
    return _updated(spark, sf_dir)["Nation"].select("n_nationkey", F.round("total", 2).alias("total"))


_int = lambda salt, name: f"(({h(name, salt)}) % 2000001 - 1000000)"


@query(f"""select rid, case ({h('l', 'len')}) % 3 + 1 when 1 then [{_int('0.v', 'l')}] when 2 then [{_int('0.v', 'l')}, {_int('1.v', 'l')}] else [{_int('0.v', 'l')}, {_int('1.v', 'l')}, {_int('2.v', 'l')}] end::VARCHAR as items,
    {_int('0.v', 't')} as first, {u('t', '1.v')} < 0.5 as second, case when ({h('x', 'branch')}) % 2 = 0 then {_int('0.v', 'x')} end as number, case when ({h('x', 'branch')}) % 2 = 1 then {u('x', '1.v')} < 0.5 end as flag, {pick(('a', 'b'), 's', 'part.v')} as part""" + FROM)
def gen_compound(spark, sf_dir):
    """Lists, tuples, named structures, and unions, which are variants: each branch reads back as its own type."""
    made = rows_of(spark, sf_dir, "l: '[int] @len(1..3)', t: '(int, bool)', x: 'int | bool', s: Inner", types="Inner: {part: 'enum(a, b)'}")
    kind, shown = F.schema_of_variant("x"), F.concat(F.lit("["), F.array_join(F.col("l").cast("array<string>"), ", "), F.lit("]"))
    of = lambda t, k: F.when(kind == k, F.try_variant_get("x", "$", t))
    return made.select("rid", shown.alias("items"), F.col("t._1").alias("first"), F.col("t._2").alias("second"), of("bigint", "BIGINT").alias("number"), of("boolean", "BOOLEAN").alias("flag"), F.col("s.part").alias("part"))


@query("""with k as (select o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_orderkey % 7 = 0)
    select distinct o_orderkey as "order", day, case when c_nationkey < 20 then n_name else 'unknown' end as city, case when p_size > 5 then p_name else 'unknown' end as name, l_quantity as quantity, l_extendedprice as price
    from k join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join part on p_partkey = l_partkey""")
def list_sales(spark, sf_dir):
    """Items of a modular sample of orders with looked-up places and names, each row once."""
    take = lambda n: read(spark, sf_dir, n)
    orders = take("orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderkey").alias("number"))
    items = take("lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("product"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    places = take("customer").where("c_nationkey < 20").join(take("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), F.col("n_name").alias("city"))
    return lists.sales(orders, items, places, take("part").where("p_size > 5").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name")), 7)


@query("select lang as country, source as code, min(doc_id) as place from documents where lang in ('de', 'fr') and source is not null and source <> '' group by 1, 2")
def list_postal_codes(spark, sf_dir):
    """Codes of the wanted countries, each once with its first place."""
    df = read(spark, sf_dir, "documents").select(F.col("lang").alias("country"), F.col("source").alias("code"), F.format_string("%09d", "doc_id").alias("place"), F.lit("r").alias("region"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"))
    return lists.postal_codes(df, ("de", "fr")).select("country", "code", F.col("place").cast("long").alias("place"))


# ---- names in texts, taxonomies ----------------------------------------------------------------------------------------


@query("""with t as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from documents),
    p as (select words, min(doc_id) as place from (select doc_id, array_to_string(w[1:n], ' ') as words from t, (values (2), (3)) v(n) where len(w) >= n) group by 1),
    r as (select doc_id, unnest(range(1, len(w) - n + 2)) as pos, n, w from t, (values (2), (3)) v(n) where len(w) >= n),
    m as (select r.doc_id, p.place, row_number() over (partition by r.doc_id order by n desc, length(words) desc, pos, words) as k from r join p on p.words = array_to_string(w[pos:pos + n - 1], ' '))
    select t.doc_id, place from t left join m on m.doc_id = t.doc_id and k = 1""")
def text_longest_name(spark, sf_dir):
    """The longest of many names in each text; names are the first two and three words of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = gazetteer.words_of(F.col("text"))
    names = docs.select("doc_id", F.explode(F.array(*[F.when(F.size(words) >= n, F.array_join(F.slice(words, 1, n), " ")) for n in (2, 3)])).alias("name")).where("name IS NOT NULL")
    return gazetteer.longest_name(docs, "doc_id", "text", names.select("doc_id", "name"), "name").select("doc_id", F.col("place.doc_id").alias("place"))


@query("""with recursive n as (select c_custkey as id, case when c_custkey >= 3 and c_custkey % 40 <> 7 then c_custkey // 3 end as up from customer),
    l as (select id, up, id::VARCHAR as line, 0 as depth from n where up is null or up not in (select id from n)
          union all select n.id, n.up, l.line || '>' || n.id, depth + 1 from n join l on n.up = l.id)
    select id, depth, split_part(line, '>', 1)::BIGINT as root, line from l""")
def taxonomy_lineage(spark, sf_dir):
    """The line of ancestors of each node of a tree, by doubling."""
    nodes = read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "case when c_custkey >= 3 and c_custkey % 40 <> 7 then c_custkey div 3 end as parent")
    return taxonomy.lineage(nodes).select("id", "depth", "root", F.array_join(F.col("line").cast("array<string>"), ">").alias("line"))


@query("select n.n_nationkey as id, r_name as name from nation n join region on r_regionkey = n.n_regionkey where n_regionkey < 4 order by 1 limit 12")
def taxonomy_names_nodes(spark, sf_dir):
    """Nodes with their names of one kind, up to a number of them."""
    nodes = read(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "n_regionkey")
    names = nodes.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("id", F.col("r_name").alias("name"), F.when(F.col("n_regionkey") < 4, "scientific name").otherwise("synonym").alias("kind"))
    return taxonomy.named_nodes(nodes, names, limit=12).select("id", "name")


# ---- expressions over the tables ---------------------------------------------------------------------------------------


def _li(*cols: str) -> str:
    return "l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(cols) + " from lineitem"


KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _expr(spark, sf_dir, table: str, keys, made: dict[str, str]) -> DataFrame:
    return with_expressions(read(spark, sf_dir, table), made).select(*keys, *made)


@query("select " + _li("l_extendedprice * (1.0 - l_discount) as net", "l_linenumber * 2 + 1 as odd"))
def expr_arith(spark, sf_dir):
    return _expr(spark, sf_dir, "lineitem", KEYS, {"net": "l_extendedprice * (1.0 - l_discount)", "odd": "l_linenumber * 2 + 1"}).withColumn("odd", F.col("odd").cast("int"))


@query("select o_orderkey, (o_custkey // 7)::BIGINT as part, o_custkey % 7 as rest, o_custkey // nullif(o_orderkey % 2, 0) as maybe from orders")
def expr_intdiv_mod(spark, sf_dir):
    return _expr(spark, sf_dir, "orders", ["o_orderkey"], {"part": "o_custkey / 7", "rest": "o_custkey % 7", "maybe": "o_custkey / (o_orderkey % 2)"})


@query("select " + _li("round((l_extendedprice * l_discount) * 100.0::DOUBLE) / 100.0::DOUBLE as cut"))
def expr_round(spark, sf_dir):
    return _expr(spark, sf_dir, "lineitem", KEYS, {"cut": "round(l_extendedprice * l_discount, 2)"})


@query("select c_custkey, concat(c_name, ' in ', c_mktsegment, ': ', printf('%.2f', round(c_acctbal * 100) / 100.0::DOUBLE)) as text from customer")
def expr_concat(spark, sf_dir):
    return _expr(spark, sf_dir, "customer", ["c_custkey"], {"text": "concat(c_name, ' in ', c_mktsegment, ': ', c_acctbal)"})


@query("select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def expr_slug(spark, sf_dir):
    return _expr(spark, sf_dir, "part", ["p_partkey"], {"slug": "slug(concat(p_name, ' ', p_type))"})


@query("select c_custkey, lower(c_mktsegment) as low, upper(c_name) as up from customer")
def expr_case(spark, sf_dir):
    return _expr(spark, sf_dir, "customer", ["c_custkey"], {"low": "lower(c_mktsegment)", "up": "upper(c_name)"})


@query("select o_orderkey, starts_with(o_orderpriority, '1') as urgent, ends_with(o_orderpriority, 'LOW') as low from orders")
def expr_starts_ends(spark, sf_dir):
    return _expr(spark, sf_dir, "orders", ["o_orderkey"], {"urgent": "starts_with(o_orderpriority, '1')", "low": "ends_with(o_orderpriority, 'LOW')"})


@query("select o_orderkey, case when o_totalprice > 100000 then 'large' when o_orderstatus = 'F' then 'done' else 'small' end as size from orders")
def expr_if(spark, sf_dir):
    return _expr(spark, sf_dir, "orders", ["o_orderkey"], {"size": "if(o_totalprice > 100000, 'large', if(o_orderstatus == 'F', 'done', 'small'))"})


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE))::BIGINT as days from lineitem join orders on l_orderkey = o_orderkey")
def expr_days_between(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return with_expressions(df, {"days": "days_between(o_orderdate, l_shipdate)"}).select(*KEYS, "days")


@query("select o_orderkey, greatest(2025 - year(o_orderdate) - case when strftime(o_orderdate, '%m%d') > '0115' then 1 else 0 end, 0)::BIGINT as years from orders")
def expr_years_since(spark, sf_dir):
    return _expr(spark, sf_dir, "orders", ["o_orderkey"], {"years": "years_since(o_orderdate)"})


@query("select o_orderkey, o_orderstatus in ('F', 'P') as settled, not (o_orderpriority in ('1-URGENT')) as calm from orders")
def expr_in_list(spark, sf_dir):
    return _expr(spark, sf_dir, "orders", ["o_orderkey"], {"settled": "o_orderstatus in [F, P]", "calm": "o_orderpriority not in ['1-URGENT']"})


@query("select c_custkey, (c_acctbal <> 0 and c_mktsegment = 'BUILDING') or not (c_nationkey <> 0) as chosen from customer")
def expr_logic(spark, sf_dir):
    return _expr(spark, sf_dir, "customer", ["c_custkey"], {"chosen": "(c_acctbal and c_mktsegment == 'BUILDING') or not c_nationkey"})


@query("select c_custkey, c_acctbal < 0 as debt, c_nationkey >= 12 as far, c_name is distinct from c_mktsegment as differ, -c_nationkey as minus from customer")
def expr_compare(spark, sf_dir):
    return _expr(spark, sf_dir, "customer", ["c_custkey"], {"debt": "c_acctbal < 0", "far": "c_nationkey >= 12", "differ": "c_name != c_mktsegment", "minus": "-c_nationkey"})


# ---- references ----------------------------------------------------------------------------------------------------------


@query("select o_orderkey, c_name as customer from orders left join customer on o_custkey = c_custkey")
def deref_one_hop(spark, sf_dir):
    return references.dereference(read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), "o_custkey", "c_custkey", {"c_name": "customer"}).select("o_orderkey", "customer")


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, n_name as nation, r_name as region from lineitem left join orders on l_orderkey = o_orderkey
    left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def deref_multi_hop(spark, sf_dir):
    t = {n: read(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    chain = [
        (t["orders"], "l_orderkey", "o_orderkey", {"o_custkey": "cust"}),
        (t["customer"], "cust", "c_custkey", {"c_nationkey": "nat"}),
        (t["nation"], "nat", "n_nationkey", {"n_name": "nation", "n_regionkey": "reg"}),
        (t["region"], "reg", "r_regionkey", {"r_name": "region"}),
    ]
    return references.hops(read(spark, sf_dir, "lineitem").select(*KEYS), chain).select(*KEYS, "nation", "region")


@query("select n_nationkey, (select max_by(c_name, c_custkey) from customer) as newest from nation")
def deref_cross_entity_last(spark, sf_dir):
    last = references.last_row(read(spark, sf_dir, "customer"), "c_name", "c_custkey").withColumnRenamed("c_name", "newest")
    return read(spark, sf_dir, "nation").crossJoin(F.broadcast(last)).select("n_nationkey", "newest")  # one row


@query("select count(*) as orphans from orders where o_custkey not in (select c_custkey from customer)")
def ref_integrity(spark, sf_dir):
    return references.orphans(read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), "o_custkey", "c_custkey").agg(F.count("*").alias("orphans"))


def _columns(df: DataFrame) -> Callable[[str], Value]:
    return Compiler(columns_of(df.schema)).compile


@query("select c_custkey, coalesce(case when c_acctbal < 0 then null else c_mktsegment end, n_name, 'none') as label from customer left join nation on c_nationkey = n_nationkey")
def default_chain_fields(spark, sf_dir):
    df = read(spark, sf_dir, "customer").withColumn("segment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    df = references.dereference(df, read(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", {"n_name": "nation"})
    v = _columns(df)
    return df.select("c_custkey", default_chain([v("segment"), v("nation")], None, v("'none'")).alias("label"))


@query("select c_custkey, case when starts_with(c_mktsegment, 'AUTO') then coalesce(n_name, 'none') end as label from customer left join nation on c_nationkey = n_nationkey")
def default_chain_when(spark, sf_dir):
    df = references.dereference(read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", {"n_name": "nation"})
    v = _columns(df)
    return df.select("c_custkey", default_chain([v("nation")], v("starts_with(c_mktsegment, 'AUTO')"), v("'none'")).alias("label"))


@query("select o_orderkey, case when starts_with(o_orderstatus, 'F') then 0.85 when starts_with(o_orderstatus, 'P') then 0.6 else 0.0 end::DOUBLE as payout from orders")
def compute_branches(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    v = _columns(df)
    return df.select("o_orderkey", compute([(v("starts_with(o_orderstatus, 'F')"), v("0.85")), (v("starts_with(o_orderstatus, 'P')"), v("0.6")), (None, v("0.0"))]).alias("payout"))


@query("select " + _li("l_extendedprice * l_tax as tax", "l_extendedprice + l_extendedprice * l_tax as total"))
def derived_order(spark, sf_dir):
    return _expr(spark, sf_dir, "lineitem", KEYS, {"tax": "l_extendedprice * l_tax", "total": "l_extendedprice + tax"})


# ---- aggregates ----------------------------------------------------------------------------------------------------------


@query("select c_custkey, (select count(*) from orders) as orders from customer")
def agg_count_global(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").crossJoin(F.broadcast(read(spark, sf_dir, "orders").agg(F.count("*").alias("orders"))))  # one row


@query("select c_custkey, coalesce(n, 0)::BIGINT as n, coalesce(cents, 0)::BIGINT as cents from customer left join (select o_custkey, count(*) as n, sum(round(o_totalprice * 100)::BIGINT) as cents from orders group by 1) on c_custkey = o_custkey")
def agg_sum_per_parent(spark, sf_dir):
    made = {"n": F.count("*"), "cents": F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))}
    out = references.per_parent(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey", made, {"n": F.lit(0), "cents": F.lit(0)})
    return out.select("c_custkey", "n", "cents")


@query("select c_custkey, round(coalesce(a, 0.0) * 100) / 100.0::DOUBLE as mean from customer left join (select o_custkey, avg(o_totalprice) as a from orders where o_orderstatus = 'P' group by 1) on c_custkey = o_custkey")
def agg_avg_empty_zero(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    out = references.per_parent(read(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey", {"mean": F.avg("o_totalprice")}, {"mean": F.lit(0.0)})
    return out.select("c_custkey", scaled_round(F.col("mean"), 2).alias("mean"))


@query("select c_custkey, lo, hi from customer left join (select o_custkey, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by 1) on c_custkey = o_custkey")
def agg_min_max(spark, sf_dir):
    return references.per_parent(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey", {"lo": F.min("o_totalprice"), "hi": F.max("o_totalprice")})


@query("select c_custkey, coalesce(same, true) as same from customer left join (select o_custkey, count(distinct o_orderstatus) + (count(*) > count(o_orderstatus))::INTEGER <= 1 as same from orders group by 1) on c_custkey = o_custkey")
def agg_all_equal(spark, sf_dir):
    status = F.struct("o_orderstatus")  # in a struct a null is a value: it differs from others and equals itself
    same = F.min(status) == F.max(status)
    return references.per_parent(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey", {"same": same}, {"same": F.lit(True)})


@query("select o_custkey, count(*) as n, sum(x)::DOUBLE as total, max(x)::DOUBLE as most from (select o_custkey, round(o_totalprice) as x from orders) group by 1")
def agg_list(spark, sf_dir):
    """Aggregates of a list value, here of an order's prices (a customer's list is bounded by its orders)."""
    df = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.round("o_totalprice")).alias("prices"))
    return with_expressions(df, {"n": "count(prices)", "total": "sum(prices)", "most": "max(prices)"}).select("o_custkey", "n", "total", "most")


# ---- rules ---------------------------------------------------------------------------------------------------------------


@query("select o_orderkey from orders where not (o_totalprice >= 50000)")
def rule_comparison(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return rules.violations(df, Rule("orders", "o_totalprice >= 50000"), Compiler(columns_of(df.schema))).select("o_orderkey")


@query("select o_orderkey from orders where o_orderstatus = 'F' and not (o_totalprice < 200000)")
def rule_conditional(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return rules.violations(df, Rule("orders", "o_totalprice < 200000", "o_orderstatus == 'F'"), Compiler(columns_of(df.schema))).select("o_orderkey")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey where not (l_shipdate >= o_orderdate)")
def rule_deref(spark, sf_dir):
    df = references.dereference(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", {"o_orderdate": "ordered"})
    return rules.violations(df, Rule("lineitem", "l_shipdate >= ordered"), Compiler(columns_of(df.schema))).select(*KEYS)


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def rule_unique_composite(spark, sf_dir):
    return rules.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select c_custkey, coalesce(n, 0)::BIGINT as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey where coalesce(n, 0) not between 5 and 15")
def rule_count_range(spark, sf_dir):
    return rules.cardinality(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey", 5, 15)


@query("select o_orderkey from orders left join (select l_orderkey, sum(round(l_extendedprice * 100)::BIGINT) as cents from lineitem group by 1) on o_orderkey = l_orderkey where coalesce(cents, 0) <> round(o_totalprice * 100)::BIGINT")
def rule_aggregate_equals(spark, sf_dir):
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    df = references.per_parent(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", {"cents": cents}, {"cents": F.lit(0)})
    return df.where(F.col("cents") != F.round(F.col("o_totalprice") * 100).cast("long")).select("o_orderkey")


@query('select o_custkey::VARCHAR as "group", count(*) as n, count(distinct o_orderstatus) = 1 as ok from orders group by 1 having count(*) >= 2')
def rule_cross_row(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    v = _columns(df)
    return rules.cross_row(df, v("o_custkey"), "all_equal(o_orderstatus)", {"o_orderstatus": v("o_orderstatus")})


@query(f"select o_orderkey, ({u('rule', 'rule', 'o_orderkey')} < 0.8) as bound from orders")
def rule_probability_mask(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.enforced(Rule("o", "x", mode="probability", probability=0.8), draw("rule", F.col("o_orderkey"))).alias("bound"))


@query("select count(*) filter (where not (o_totalprice > 5000)) as cheap, count(*) filter (where not (o_orderstatus <> 'P')) as pending from orders")
def rule_warn_counts(spark, sf_dir):
    return rules.count_violations(read(spark, sf_dir, "orders"), [("cheap", F.col("o_totalprice") > 5000), ("pending", F.col("o_orderstatus") != "P")])


# ---- list tools ----------------------------------------------------------------------------------------------------------


@query("select * from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT' order by o_orderkey limit 1000000000")
def tool_list_filter(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(tools.condition({"o_orderstatus": "P", "o_orderpriority": "1-URGENT"}, ["o_orderstatus", "o_orderpriority"]))


@query("select * from orders where o_orderdate > timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'")
def tool_list_date_range(spark, sf_dir):
    from datetime import datetime

    df = read(spark, sf_dir, "orders")
    return df.where(tools.condition({"o_orderdate_after": datetime(1997, 1, 1), "o_orderdate_before": datetime(1998, 1, 1)}, df.columns))


@query("select * from part where lower(p_name) like '%lt%' or lower(p_type) like '%lt%'")
def tool_search(spark, sf_dir):
    return read(spark, sf_dir, "part").where(tools.searched("LT", ["p_name", "p_type"]))


@query("select * from customer order by c_acctbal desc, c_custkey limit 25 offset 25")
def tool_sort_page(spark, sf_dir):
    return tools.list_rows(read(spark, sf_dir, "customer"), "c_custkey", sort=[("c_acctbal", True)], page=2)


@query("select * from customer where c_custkey = 42")
def tool_get(spark, sf_dir):
    return tools.get_row(read(spark, sf_dir, "customer"), "c_custkey", 42)


@query("select * from orders where o_custkey = 42")
def tool_subcollection(spark, sf_dir):
    return tools.children_of(read(spark, sf_dir, "orders"), "o_custkey", 42)


# ---- preparation of source tables ------------------------------------------------------------------------------------------


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 50")
def etl_topk(spark, sf_dir):
    return prepare.top(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 50, F.desc("p_retailprice"), F.col("p_partkey"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id) as k from events) where k = 1")
def etl_first_wins(spark, sf_dir):
    return prepare.first_wins(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("select distinct p_brand, p_size from part")
def etl_distinct(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_brand", "p_size").distinct()


@query("select d.doc_id, coalesce(l.quality, 2) as quality from documents d left join labels l on d.doc_id = l.doc_id")
def etl_lookup_default(spark, sf_dir):
    return prepare.lookup(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), {"doc_id": "doc_id"}, {"quality": ("quality", F.lit(2))})


@query("select prefix, min_by(p_name, struct_pack(a := p_partkey, b := p_name)) as name from (select unnest([substr(p_type, 1, 1), substr(p_type, 1, 2)]) as prefix, p_name, p_partkey from part) group by 1")
def etl_prefix_rollup(spark, sf_dir):
    return prepare.prefix_rollup(read(spark, sf_dir, "part"), "p_type", "p_name", "p_partkey")


@query("select event_id, event_type from events where event_id % 10 = 0")
def etl_modular_sample(spark, sf_dir):
    return prepare.every(read(spark, sf_dir, "events"), "event_id", 10).select("event_id", "event_type")


@query("select 'customer' as origin, c_name as name, c_nationkey as nation from customer union all select 'supplier', s_name, s_nationkey from supplier")
def etl_union(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("select n_regionkey, n_name, n_nationkey from nation order by 1, 2")
def etl_multikey_sort(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey").orderBy("n_regionkey", "n_name")


@query("select p_partkey, p_brand from part where p_brand in ('Brand#11', 'Brand#12', 'Brand#21') and p_size >= 15")
def etl_filter_in_set(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#21") & (F.col("p_size") >= 15)).select("p_partkey", "p_brand")


@query("select page_id, string_split(url, '/')[-1] as name from pages")
def etl_path_last_segment(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", prepare.last_segment(F.col("url")).alias("name"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'other' end as label from orders")
def etl_code_label_case(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", prepare.label_of(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "other").alias("label"))


@query(f"""with c as (select n_name as v, sum(n_nationkey + 1) over (order by n_name)::DOUBLE as hi, sum(n_nationkey + 1) over ()::DOUBLE as total, (n_nationkey + 1)::DOUBLE as w from nation),
    r as (select c_custkey as rid, {u('pk', 'pick', 'c_custkey')} as x from customer)
    select rid, v as nation from r join c on x * total >= hi - w and x * total < hi""")
def weighted_pick_cdf(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") + 1).alias("w"))
    return prepare.weighted_pick(people(spark, sf_dir), nations, "n_name", "w", draw("pk"), "nation")


@query("select event_type, count(value) as n, round(avg(value) * 10000) / 10000.0::DOUBLE as mean, round(stddev_samp(value) * 10000) / 10000.0::DOUBLE as sd, min(value) as least, max(value) as largest from events group by 1")
def profile_moments(spark, sf_dir):
    df = prepare.moments(read(spark, sf_dir, "events"), "value", "event_type")
    return df.withColumns({"mean": scaled_round(F.col("mean"), 4), "sd": scaled_round(F.col("sd"), 4)})


@query("select event_type as value, count(*) as n, count(*)::DOUBLE / (select count(*) from events) as share from events group by 1")
def profile_frequencies(spark, sf_dir):
    return prepare.frequencies(read(spark, sf_dir, "events"), "event_type")


# ---- prepared lists ------------------------------------------------------------------------------------------------------


@query("select upper(left(w, 1)) || lower(substr(w, 2)) as name, sum(n)::BIGINT as weight from (select event_type as w, count(*) as n from events group by 1) group by 1 order by weight desc, name limit 3")
def list_surnames(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy(F.upper("event_type").alias("name")).agg(F.count("*").alias("n"))
    return lists.surnames(counts, 3)


@query("select url as path, trim(string_split(url, '/')[-1]) as name, len(string_split(url, '/'))::INTEGER as depth from pages where url is not null and trim(url) <> '' and trim(url) <> '\\N'")
def list_categories(spark, sf_dir):
    return lists.categories(read(spark, sf_dir, "pages").select(F.col("url").alias("path")), "/")


@query("select n_name as code, min(n_comment_) as name, 2 as digits, coalesce(min(r_name), n_name) as symbol from (select n_name, 'n' || n_nationkey::VARCHAR as n_comment_, r_name from nation left join (select * from region where r_regionkey < 3) on n_regionkey = r_regionkey) group by n_name")
def list_currencies(spark, sf_dir):
    nations, places = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").where("r_regionkey < 3")
    codes = nations.select(F.col("n_name").alias("code"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(None).cast("int").alias("digits"))
    symbols = references.dereference(nations, places, "n_regionkey", "r_regionkey", {"r_name": "symbol"}).where("symbol is not null")
    return lists.currencies(codes, symbols.select(F.col("n_name").alias("code"), "symbol"))


@query("select n_regionkey::VARCHAR as country, 'r' || n_nationkey::VARCHAR as region, n_name as name from nation")
def list_regions(spark, sf_dir):
    return lists.regions(read(spark, sf_dir, "nation").select(F.concat_ws(".", F.col("n_regionkey").cast("string"), F.concat(F.lit("r"), F.col("n_nationkey").cast("string"))).alias("code"), F.col("n_name").alias("name")))


@query("""with c as (select p_brand as code, p_name as name from part union all select s_name, s_name from supplier)
    select prefix, min_by(name, struct_pack(a := code, b := name)) as name from (select unnest([substr(code, 1, 1), substr(code, 1, 2)]) as prefix, * from c) group by 1""")
def list_accounts(spark, sf_dir):
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    return lists.accounts(part.select(F.col("p_brand").alias("code"), F.col("p_name").alias("name")), supplier.select(F.col("s_name").alias("code"), F.col("s_name").alias("name")))


@query("""select upper(n[1]) || lower(n[2:]) as name, lower(p_type) as sex, sum(p_size)::BIGINT as weight
    from (select split_part(p_name, ' ', 1) as n, p_type, p_size from part where p_size > 0) group by 1, 2""")
def list_given_names(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return lists.given_names(part.select(F.concat(F.lit(" "), F.upper(F.split("p_name", " ")[0])).alias("name"), F.col("p_type").alias("sex"), F.col("p_size").alias("n")))


@query("select c_name as name, n_name as country, c_mktsegment as region, floor(c_acctbal)::BIGINT as population, c_custkey::BIGINT as latitude, -c_custkey::BIGINT as longitude from customer join nation on c_nationkey = n_nationkey where floor(c_acctbal) >= 1000")
def list_cities(spark, sf_dir):
    df = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lists.cities(df.select(F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("region"), F.floor("c_acctbal").alias("population"), F.col("c_custkey").alias("latitude"), (-F.col("c_custkey")).alias("longitude")), 1000)


@query("""select distinct code, title, coalesce(n_name, 'Other') as "group" from (select lpad((p_partkey % 40)::VARCHAR, 2, '0') || '-' || p_size as code, unnest([p_name, p_type]) as title from part)
    left join nation on lpad(n_nationkey::VARCHAR, 2, '0') = substr(code, 1, 2)""")
def list_occupations(spark, sf_dir):
    """Titles and alternate titles with the group of their code's prefix."""
    part = read(spark, sf_dir, "part").withColumn("code", F.format_string("%02d-%d", F.col("p_partkey") % 40, F.col("p_size")))
    groups = read(spark, sf_dir, "nation").select(F.format_string("%02d", F.col("n_nationkey").cast("int")).alias("prefix"), F.col("n_name").alias("name"))
    return lists.occupations(part.select("code", F.col("p_name").alias("title")), part.select("code", F.col("p_type").alias("title")), groups)


@query("select distinct p_brand as make, p_name as model from part where p_size + 1990 >= 2015 order by 1, 2 limit 50")
def list_vehicles(spark, sf_dir):
    return lists.vehicles(read(spark, sf_dir, "part").select(F.col("p_brand").alias("make"), F.col("p_name").alias("model"), (F.col("p_size") + 1990).alias("year")), 2015, 50)


@query("""select p_partkey as food_id, p_name as name, coalesce(n_name, 'Other') as "group" from part left join nation on p_size = n_nationkey""")
def list_foods(spark, sf_dir):
    groups = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    return lists.foods(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"), F.col("p_name").alias("name"), F.col("p_size").alias("group_id")), groups)


@query("""select case when len(c) > 3 then c[1:3] || '.' || c[4:] else c end as code, o_orderpriority || ' ' || o_orderstatus as name
    from (select 'D' || o_orderkey as c, o_orderpriority, o_orderstatus from orders)""")
def list_diagnoses(spark, sf_dir):
    return lists.diagnoses(read(spark, sf_dir, "orders").select(F.concat(F.lit(" D"), F.col("o_orderkey").cast("string"), F.lit("   "), "o_orderpriority", F.lit(" "), "o_orderstatus").alias("value")))


@query("""select p[1:2] || ':' || p[3:4] || ':' || p[5:6] as prefix, min(c_name) as maker
    from (select upper(substr(md5((c_custkey % 500)::VARCHAR), 1, 6)) as p, c_name from customer) group by 1 order by 1 limit 100""")
def list_device_prefixes(spark, sf_dir):
    """Prefixes in two spellings, each once."""
    key = F.md5((F.col("c_custkey") % 500).cast("string"))
    shown = F.when(F.col("c_custkey") % 2 == 0, F.substring(key, 1, 6)).otherwise(F.concat_ws("-", *[F.upper(F.substring(key, i, 2)) for i in (1, 3, 5)]))
    return lists.device_prefixes(read(spark, sf_dir, "customer").select(shown.alias("prefix"), F.concat(F.lit(" "), "c_name").alias("maker")), 100)


@query("select p_name as title, min(p_brand) as category, min(p_retailprice) as price from part where p_size > 3 group by 1 order by 1 limit 40")
def list_products(spark, sf_dir):
    """The last of nested categories and the least of prices that are texts."""
    part = read(spark, sf_dir, "part")
    return lists.products(part.select(F.concat("p_name", F.lit(" ")).alias("title"), F.when(F.col("p_size") > 3, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>")).alias("categories"), F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("price")), 40)


@query("select lpad(event_id::VARCHAR, 12, '0') as title_id, props as title, year(ts)::INTEGER as year from events where event_type in ('purchase', 'error') and event_id % 5 <> 0 and event_id % 7 <> 0 order by 1 limit 200")
def list_titles(spark, sf_dir):
    """Null marks of dumps count as nothing said."""
    marked = lambda c, n: F.when(F.col("event_id") % n == 0, r"\N").otherwise(c)
    df = read(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("title_id"), F.col("event_type").alias("kind"), marked(F.col("props"), 5).alias("title"), marked(F.year("ts").cast("string"), 7).alias("year"))
    return lists.titles(df, ("purchase", "error"), 200)


@query("select s_suppkey as id, s_name as name, s_nationkey as city, 'r' as region, case s_nationkey % 4 when 1 then 'public' when 2 then 'private nonprofit' when 3 then 'private for-profit' else 'unknown' end as control from supplier")
def list_institutions(spark, sf_dir):
    df = read(spark, sf_dir, "supplier")
    return lists.institutions(df.select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" ")).alias("name"), F.col("s_nationkey").alias("city"), F.lit("r").alias("region"), (F.col("s_nationkey") % 4).alias("control")))


@query("select upper(substr(md5(s_suppkey::VARCHAR), 1, 2)) as code, s_name as name from supplier where s_suppkey % 3 <> 0")
def list_airlines(spark, sf_dir):
    active = F.when(F.col("s_suppkey") % 3 == 0, r"\N").when(F.col("s_suppkey") % 3 == 1, "y").otherwise("Y")
    return lists.airlines(read(spark, sf_dir, "supplier").select(F.upper(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 2)).alias("code"), F.col("s_name").alias("name"), active.alias("active")))


@query("""select locale, code, name from (select c_mktsegment as locale, unnest(['n' || c_custkey, 's' || c_custkey]) as code, unnest([c_name, case when c_custkey % 4 = 0 then ' ' else c_mktsegment end]) as name from customer) where trim(name) <> ''""")
def list_translations(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    names = F.create_map(F.concat(F.lit("n"), key), F.col("c_name"), F.concat(F.lit("s"), key), F.expr("if(c_custkey % 4 = 0, ' ', c_mktsegment)"))
    return lists.translations(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("locale"), names.alias("names")))


@query("select o_orderkey::VARCHAR as id, o_orderpriority as priority, case when o_orderkey % 3 = 0 then o_custkey::VARCHAR end as customer from orders where o_orderstatus = 'O'")
def list_erp_records(spark, sf_dir):
    """Records of one model with their fields by name; of a field that comes twice the first."""
    field = lambda n, v: F.struct(F.lit(n).alias("_name"), v.cast("string").alias("_VALUE"))
    some = F.array(field("priority", F.col("o_orderpriority")), field("priority", F.lit("x")), field("customer", F.col("o_custkey")))
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), F.col("o_orderstatus").alias("_model"), F.when(F.col("o_orderkey") % 3 == 0, some).otherwise(F.slice(some, 1, 2)).alias("field"))
    return lists.records(df, "O", ("priority", "customer"))


@query("select 'S' || (o_custkey % 900) as symbol, min(o_orderpriority) as name, min(o_orderstatus) as exchange from orders group by 1")
def list_tickers(spark, sf_dir):
    """Arrays of arrays whose places are named beside them."""
    symbol = F.concat(F.lit("S"), (F.col("o_custkey") % 900).cast("string"))
    df = read(spark, sf_dir, "orders").select(F.array(*map(F.lit, ("cik", "name", "ticker", "exchange"))).alias("fields"), F.array(F.array(F.lit("0"), "o_orderpriority", symbol, "o_orderstatus")).alias("data"))
    return lists.tickers(df)


@query("select lower(e) as extension, min(t) as type from (select case when p_size % 2 = 0 then 'text/' else 'font/' end || p_type as t, unnest([p_brand, replace(p_name, ' ', '_')]) as e, p_size from part) where p_size % 2 = 0 group by 1")
def list_mime_types(spark, sf_dir):
    kind = F.concat(F.expr("if(p_size % 2 = 0, 'text/', 'font/')"), "p_type")
    return lists.mime_types(read(spark, sf_dir, "part").select(kind.alias("type"), F.array("p_brand", F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" ")).alias("extensions")), ("text",))


# ---- writers -------------------------------------------------------------------------------------------------------------


@query("""select b as batch, 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES' || chr(10) || string_agg(t, ',' || chr(10) order by n_nationkey) || ';' as statement
    from (select n_nationkey, (row_number() over (order by n_nationkey) - 1) // 10 as b, '(' || n_nationkey::VARCHAR || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey::VARCHAR || ')' as t from nation) group by 1""")
def write_sql_batches(spark, sf_dir):
    return insert_batches(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation", ["n_nationkey"], batch=10)


@query("""select '{"n_nationkey":' || n_nationkey::VARCHAR || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey::VARCHAR || '}' as line from nation""")
def write_ndjson_rows(spark, sf_dir):
    return ndjson_rows(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("select c_custkey::VARCHAR || ',' || c_name || ',' || printf('%.2f', round(c_acctbal * 100) / 100.0::DOUBLE) as line from customer")
def write_csv_display(spark, sf_dir):
    return csv_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"))


@query("select c_custkey::VARCHAR as c_custkey, printf('%.2f', round(c_acctbal * 100) / 100.0::DOUBLE) as c_acctbal from customer")
def write_display_rows(spark, sf_dir):
    return display_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))


# ---- files: what the executors write of a table, read by the library's readers ------------------------------------------


def folder(spark: SparkSession, name: str) -> str:
    return f"{Scratch(spark, 'files').folder}/{name}"


@query("select c_custkey as key, c_name as name, round(c_acctbal * 100)::BIGINT as cents from customer where c_custkey % 97 <> 0")
def read_delimited(spark, sf_dir):
    """Quoted, compressed text with a header; rows that do not fit the schema are left out."""
    path = folder(spark, "piped")
    rows = read(spark, sf_dir, "customer").select(F.expr("if(c_custkey % 97 = 0, 'n/a', cast(c_custkey as string))").alias("key"), F.concat(F.col("c_name"), F.lit(" | x")).alias("name"), F.expr("cast(round(c_acctbal * 100) as long)").alias("cents"))
    rows.write.csv(path, sep="|", header=True, compression="gzip")
    back = files.delimited(spark, path, "key long, name string, cents long", sep="|")
    return back.withColumn("name", F.replace("name", F.lit(" | x"), F.lit("")))


@query("select 'n/a|' || c_name as line from customer where c_custkey % 97 = 0")
def read_rejected(spark, sf_dir):
    """The lines of the rows that do not fit the schema."""
    path = folder(spark, "rejects")
    read(spark, sf_dir, "customer").select(F.expr("if(c_custkey % 97 = 0, 'n/a', cast(c_custkey as string))").alias("key"), "c_name").write.csv(path, sep="|", header=True)
    return files.rejected(spark, path, "key long, name string", sep="|").select(F.col("_line").alias("line"))


@query("select o_orderkey, o_orderstatus, case when o_orderkey % 50 <> 0 then o_custkey end as o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def read_fixed_width(spark, sf_dir):
    """Columns by place; what is no number there is null."""
    path = folder(spark, "fixed")
    customer = F.expr("if(o_orderkey % 50 = 0, '-', cast(o_custkey as string))")
    read(spark, sf_dir, "orders").select(F.format_string("%-12d%-3s%12s%s", F.col("o_orderkey").cast("long"), "o_orderstatus", customer, F.date_format("o_orderdate", "yyyy-MM-dd"))).write.text(path)
    back = files.fixed_width(spark, path, [("o_orderkey", 1, 12, "long"), ("o_orderstatus", 13, 3, "string"), ("o_custkey", 16, 12, "long"), ("day", 28, 10, "date")])
    return back.withColumn("day", F.col("day").cast("string"))


@query("select l_orderkey, l_linenumber::INTEGER as l_linenumber, l_partkey from lineitem")
def read_whitespace(spark, sf_dir):
    """Columns parted by any number of blanks."""
    path = folder(spark, "blanks")
    read(spark, sf_dir, "lineitem").select(F.format_string("  %d \t %d    %d ", *[F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber", "l_partkey")])).write.text(path)
    return files.whitespace(spark, path, [("l_orderkey", "long"), ("l_linenumber", "int"), ("l_partkey", "long")])


@query("select doc_id, text, source from documents")
def write_json_documents(spark, sf_dir):
    """Whole texts as arrays of JSON objects, a part file for each task, and back."""
    path = folder(spark, "json")
    write_json_parts(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    return files.json_document(spark, path, "doc_id long, text string, source string")


@query("""select unnest(['- s_suppkey: ' || s_suppkey::VARCHAR, '  s_name: ' || s_name, '  s_nationkey: ' || s_nationkey::VARCHAR]) as line from supplier""")
def write_yaml_lines(spark, sf_dir):
    """Rows as sequences of YAML mappings, keys in the order of the columns."""
    path = folder(spark, "yaml")
    write_yaml_parts(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("select p_partkey, p_name || ' <&> \"' as p_name, case when p_size > 5 then p_size end::INTEGER as p_size from part")
def read_xml(spark, sf_dir):
    """Records by their tag; marks in texts come back, what is missing is null."""
    path = folder(spark, "xml")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(' <&> "')).alias("p_name"), F.expr("if(p_size > 5, p_size, null)").alias("p_size"))
    rows.write.format("xml").option("rowTag", "part").option("rootTag", "parts").save(path)
    return files.xml(spark, path, "part", "p_partkey long, p_name string, p_size int")


@query("select o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || o_orderpriority as line from orders where o_orderstatus = 'F'")
def read_dump_lines(spark, sf_dir):
    """The lines of compressed dumps that hold a pattern, each dump read as a stream by a task."""
    path = folder(spark, "dumps")
    read(spark, sf_dir, "orders").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")).write.text(path, compression="gzip")
    return archive_lines(spark, path, pattern=r"\|F\|").select("line")


@query("select o_orderkey, o_totalprice from orders where o_orderkey % 2 = 0")
def publish_keeps_versions(spark, sf_dir):
    """A second version takes the place of the first; a third, which fails as it is written, changes nothing that readers see."""
    path, rows = folder(spark, "published"), read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    publish_tables({"orders": rows, "other": rows.where("o_orderkey < 0")}, path)
    publish_tables({"orders": rows.where("o_orderkey % 2 = 0")}, path)

    def fails(at: str) -> None:
        rows.write.parquet(at)
        raise OutputError("the disk is full")

    try:
        publish(spark, path, {"orders": fails})
    except OutputError:
        return published_tables(spark, path)["orders"]
    raise AssertionError("the failed write was published")


__all__ = ["ORACLE_SQL", "QUERIES", "Field", "Type", "two_places"]
