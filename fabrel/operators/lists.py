"""Jobs that make prepared lists of public source tables.

A job takes tables that `sources.files` has read and returns the list; its docstring names the columns that it reads. `probed`
finds them where sources name them differently. `prepare_lists` runs jobs and publishes the lists where `prepared_lists` reads
them; a `Registry` names them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.documents import write_json_parts
from ..sinks.publish import manifest, publish
from ..storage import Scratch
from .prepare import every, label_of, last_segment, lookup, prefix_rollup, top


def probed(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """df under the names of wanted: for each the first of its candidates that is a header, in any case. None: ValueError."""
    headers = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {name: next((headers[c.lower()] for c in cs if c.lower() in headers), None) for name, cs in wanted.items()}
    missing = [n for n, c in found.items() if c is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items()])


def filled(c: Column) -> Column:
    """Whether a text says something: not null, blank or the null mark of dumps."""
    return c.isNotNull() & ~F.trim(c).isin("", r"\N")


def without_marks(df: DataFrame) -> DataFrame:
    """df with the null mark of dumps as an empty text in every text column."""
    return df.select(*[(F.when(F.col(f"`{n}`") == r"\N", "").otherwise(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`")) for n, t in df.dtypes])


def given_names(df: DataFrame) -> DataFrame:
    """(name, sex, n) in; each name once for a sex, in title case, with its summed count as weight."""
    named = df.where(filled(F.col("name")) & (F.col("n") > 0))
    return named.groupBy(F.initcap(F.trim("name")).alias("name"), F.lower("sex").alias("sex")).agg(F.sum("n").alias("weight"))


def surnames(df: DataFrame, k: int = 5000) -> DataFrame:
    """(name, n) in; the k most frequent names in title case with their counts as weights."""
    named = df.where(filled(F.col("name")) & (F.col("n") > 0)).groupBy(F.initcap(F.trim("name")).alias("name")).agg(F.sum("n").alias("weight"))
    return top(named, k, F.desc("weight"), F.col("name"))


def cities(df: DataFrame, least: int = 0) -> DataFrame:
    """(name, country, region, population, latitude, longitude) in; places of at least so many people."""
    return df.where(filled(F.col("name")) & (F.col("population") >= least)).select("name", "country", "region", "population", "latitude", "longitude")


def occupations(titles: DataFrame, alternates: DataFrame, groups: DataFrame) -> DataFrame:
    """titles (code, title), alternates (code, title), groups (prefix, name) in; every title with the name of the group that
    its code's first two characters tell, `Other` where there is none."""
    every = titles.select("code", "title").unionByName(alternates.select("code", "title")).where(filled(F.col("title"))).distinct()
    keyed = every.withColumn("prefix", F.substring("code", 1, 2))
    return lookup(keyed, groups, {"prefix": "prefix"}, {"group": ("name", F.lit("Other"))}).select("code", "title", "group")


def timezones(df: DataFrame) -> DataFrame:
    """(zone) in, with comment lines; each zone once."""
    return df.where(filled(F.col("zone")) & ~F.col("zone").startswith("#")).select("zone").distinct()


def regions(df: DataFrame) -> DataFrame:
    """(code, name) in, codes as `country.region`; (country, region, name)."""
    parts = F.split("code", r"\.", 2)
    return df.where(F.contains("code", F.lit("."))).select(parts[0].alias("country"), parts[1].alias("region"), "name")


def categories(df: DataFrame, sep: str = ">") -> DataFrame:
    """(path) in; (path, name, depth): the last part of each path and the number of its parts."""
    used = df.where(filled(F.col("path")))
    return used.select("path", F.trim(last_segment(F.col("path"), sep)).alias("name"), F.size(F.split("path", f"\\Q{sep}\\E")).alias("depth"))


def card_prefixes(df: DataFrame, brands: Sequence[str], k: int) -> DataFrame:
    """(prefix, brand, issuer) in; the first k prefixes of six digits of the brands."""
    kept = df.where(F.lower("brand").isin([b.lower() for b in brands]) & F.col("prefix").rlike("^[0-9]{6}$"))
    return top(kept.select("prefix", F.lower("brand").alias("brand"), "issuer"), k, F.col("prefix"), F.col("issuer"))


def currencies(codes: DataFrame, symbols: DataFrame) -> DataFrame:
    """codes (code, name, digits), symbols (code, symbol) in; each code once, its own text where it has no symbol, 2 digits where
    none are told."""
    once = codes.where(filled(F.col("code"))).groupBy("code").agg(F.min("name").alias("name"), F.coalesce(F.max("digits"), F.lit(2)).alias("digits"))
    return lookup(once, symbols.groupBy("code").agg(F.min("symbol").alias("symbol")), {"code": "code"}, {"symbol": ("symbol", F.col("code"))})


def languages(df: DataFrame) -> DataFrame:
    """(code, name) in; the languages that have a code of two letters."""
    return df.where(F.col("code").rlike("^[a-z]{2}$")).select("code", "name")


def airports(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(code, name, kind, city, country) in; those of the kinds that have a code of three letters."""
    return df.where(F.col("kind").isin(list(kinds)) & F.col("code").rlike("^[A-Z]{3}$")).select("code", "name", "city", "country")


def airlines(df: DataFrame) -> DataFrame:
    """(code, name, active) in; those that fly and have a code of two characters."""
    return without_marks(df).where((F.upper("active") == "Y") & F.col("code").rlike("^[A-Z0-9]{2}$")).select("code", "name")


def vehicles(df: DataFrame, since: int, k: int) -> DataFrame:
    """(make, model, year) in; k pairs of make and model since a year, each once, in order."""
    pairs = df.where((F.col("year") >= since) & filled(F.col("make")) & filled(F.col("model"))).select("make", "model").distinct()
    return top(pairs, k, F.col("make"), F.col("model"))


def foods(items: DataFrame, groups: DataFrame) -> DataFrame:
    """items (food_id, name, group_id), groups (group_id, name) in; each food with its group's name, `Other` where there is none."""
    return lookup(items.where(filled(F.col("name"))), groups, {"group_id": "group_id"}, {"group": ("name", F.lit("Other"))}).select("food_id", "name", "group")


def diagnoses(df: DataFrame) -> DataFrame:
    """(value) in, a code, blanks and its description in a line; (code, name), a point behind the third character of longer codes."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    code = F.when(F.length(parts[0]) > 3, F.concat(F.substring(parts[0], 1, 3), F.lit("."), F.substring(parts[0], 4, 10))).otherwise(parts[0])
    return df.where(F.trim("value").rlike(r"^\S+\s+\S")).select(code.alias("code"), parts[1].alias("name"))


def arrays_of_fields(df: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(data: array of arrays of text) in; a row for each inner array, its places named and typed by fields."""
    rows = df.select(F.explode("data").alias("row"))
    return rows.select(*[F.get("row", i).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def records(df: DataFrame, model: str, fields: Sequence[str]) -> DataFrame:
    """Rows of XML records in (`_id`, `_model`, `field`: array of `_name`, `_VALUE`); (id, *fields) of those of a model, null
    where a record lacks a field. Of a field that comes twice the first counts."""
    value = lambda n: F.get(F.filter("field", lambda f: f["_name"] == n), 0)["_VALUE"]
    return df.where(F.col("_model") == model).select(F.col("_id").alias("id"), *[value(n).alias(n) for n in fields])


def accounts(*charts: DataFrame) -> DataFrame:
    """Charts (code, name) in; (prefix, name): all codes of all charts rolled up to their first one and two digits."""
    every = charts[0].select("code", "name")
    for c in charts[1:]:
        every = every.unionByName(c.select("code", "name"))
    return prefix_rollup(every.where(filled(F.col("code"))).withColumn("__order", F.col("code")), "code", "name", "__order")


def titles(df: DataFrame, kinds: Sequence[str], k: int) -> DataFrame:
    """(title_id, kind, title, year) in; the first k titles of the kinds that have a year, by id."""
    kept = without_marks(df).where(F.col("kind").isin(list(kinds)) & filled(F.col("title")) & F.col("year").rlike("^[0-9]{4}$"))
    return top(kept.select("title_id", "title", F.col("year").cast("int").alias("year")), k, F.col("title_id"))


def countries(df: DataFrame) -> DataFrame:
    """(code, code3, name, capital, continent, currency, phone, languages) in, with comment lines, languages as `en-GB,cy`; each
    country that has a code of two letters, with its first language."""
    kept = df.where(F.col("code").rlike("^[A-Z]{2}$") & filled(F.col("name")))
    language = F.split(F.split("languages", ",")[0], "-")[0]
    return kept.select("code", "code3", "name", "capital", "continent", "currency", F.regexp_replace("phone", r"[^0-9]", "").alias("phone"), F.coalesce(F.when(language != "", language), F.lit("en")).alias("language"))


def postal_codes(df: DataFrame, wanted: Sequence[str] = ()) -> DataFrame:
    """(country, code, place, region, latitude, longitude) in; each code of the wanted countries (all, if none are named) once, with
    its first place by name."""
    kept = df.where(filled(F.col("code")) & filled(F.col("place")) & (F.col("country").isin(list(wanted)) if wanted else F.lit(True)))
    first = F.min(F.struct("place", "region", "latitude", "longitude"))
    return kept.groupBy("country", "code").agg(first.alias("x")).select("country", "code", "x.*")


def phone_formats(territories: DataFrame) -> DataFrame:
    """Rows of an XML file of territories (_id, _countryCode, _internationalPrefix, mobile and fixedLine with exampleNumber,
    availableFormats.numberFormat with _pattern and format) in; a row for each format of each territory, at least one, in order."""
    formats = F.coalesce(F.col("availableFormats.numberFormat"), F.array().cast("array<struct<_pattern:string,format:string>>"))
    rows = territories.where(F.col("_id").rlike("^[A-Z]{2}$")).select(F.col("_id").alias("country"), F.col("_countryCode").alias("code"), F.col("_internationalPrefix").alias("prefix"), F.col("mobile.exampleNumber").alias("mobile"), F.col("fixedLine.exampleNumber").alias("landline"), F.posexplode_outer(formats).alias("place", "f"))
    return rows.select("country", "code", "prefix", "mobile", "landline", F.coalesce("place", F.lit(0)).alias("place"), F.col("f._pattern").alias("pattern"), F.col("f.format").alias("format"))


def domains(df: DataFrame) -> DataFrame:
    """(value) in, a line each, with comment lines; top-level domains in lower case."""
    return df.where(F.trim("value").rlike("^[A-Za-z0-9-]+$")).select(F.lower(F.trim("value")).alias("domain"), F.when(F.length(F.trim("value")) == 2, "country").otherwise("generic").alias("kind")).distinct()


def mime_types(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(type, extensions: array) in; a row for each extension of the types whose first part is among kinds, an extension once."""
    rows = df.where(F.split("type", "/")[0].isin(list(kinds))).select("type", F.explode("extensions").alias("extension")).where(filled(F.col("extension")))
    return rows.groupBy(F.lower("extension").alias("extension")).agg(F.min("type").alias("type"))


#: What the codes of control of a college stand for.
CONTROL = {"1": "public", "2": "private nonprofit", "3": "private for-profit"}


def institutions(df: DataFrame) -> DataFrame:
    """(id, name, city, region, control: a code) in; those that have a name, with what their control means."""
    return df.where(filled(F.col("name"))).select("id", F.trim("name").alias("name"), "city", "region", label_of(F.col("control").cast("string"), CONTROL, "unknown").alias("control"))


def device_prefixes(df: DataFrame, k: int) -> DataFrame:
    """(prefix, maker) in, prefixes of six hex digits in any spelling; the first k as `AA:BB:CC`, each once."""
    hex_ = F.upper(F.regexp_replace("prefix", "[^0-9A-Fa-f]", ""))
    shown = F.concat_ws(":", *[F.substring(hex_, i, 2) for i in (1, 3, 5)])
    kept = df.where((F.length(hex_) == 6) & filled(F.col("maker"))).groupBy(shown.alias("prefix")).agg(F.min(F.trim("maker")).alias("maker"))
    return top(kept, k, F.col("prefix"))


def tickers(df: DataFrame) -> DataFrame:
    """(fields: array of text, data: array of arrays of text) in, as exchanges publish them; (symbol, name, exchange), a symbol once."""
    at = lambda n: F.get("row", F.array_position("fields", n).cast("int") - 1)
    rows = df.select("fields", F.explode("data").alias("row")).select(at("ticker").alias("symbol"), at("name").alias("name"), at("exchange").alias("exchange"))
    return rows.where(filled(F.col("symbol"))).groupBy("symbol").agg(F.min("name").alias("name"), F.min("exchange").alias("exchange"))


def translations(df: DataFrame) -> DataFrame:
    """(locale, names: map of code to name) in; a row for each code and locale."""
    return df.select("locale", F.explode("names").alias("code", "name")).where(filled(F.col("name")))


def products(df: DataFrame, k: int) -> DataFrame:
    """(title, categories: array, price: text) in; the first k titles, each once, with the last of their categories and the least price."""
    price = F.regexp_replace("price", r"[^0-9.]", "").try_cast("double")
    kept = df.where(filled(F.col("title")) & (F.size("categories") > 0)).select(F.trim("title").alias("title"), F.element_at("categories", -1).alias("category"), price.alias("price"))
    return top(kept.groupBy("title").agg(F.min("category").alias("category"), F.min("price").alias("price")), k, F.col("title"))


def sales(orders: DataFrame, items: DataFrame, customers: DataFrame, goods: DataFrame, step: int, number: str = "number") -> DataFrame:
    """orders (order, customer, day), items (order, product, quantity, price), customers (customer, city), goods (product, name) in; an
    item of every step-th order by number, with where it went and what it was; `unknown` where either is not listed. Repeated
    rows once."""
    kept = every(orders, number, step).join(items, "order")
    where = lookup(kept, customers, {"customer": "customer"}, {"city": ("city", F.lit("unknown"))})
    return lookup(where, goods, {"product": "product"}, {"name": ("name", F.lit("unknown"))}).select("order", "day", "city", "name", "quantity", "price").distinct()


def prepare_lists(jobs: Mapping[str, Callable[[], DataFrame]], folder: str) -> dict[str, str]:
    """Runs jobs one after another and publishes each list, sorted by its columns, in the folder (`sinks.publish`).

    Returns {name: error} of the jobs that failed; their older lists stay, as readers see a list only once it is written whole. If
    every job fails, ValueError tells all errors.
    """
    failed: dict[str, str] = {}
    for name, job in jobs.items():
        try:
            df = job()
            made = Scratch(df.sparkSession, f"list-{name}")
            rows = made.written(df, "rows").orderBy(*[f"`{c}`" for c in df.columns])
            publish(df.sparkSession, folder, {name: lambda path, rows=rows: write_json_parts(rows, path)})
            made.drop("rows")
        except Exception as e:  # noqa: BLE001 - one source's failure must not stop the others
            failed[name] = f"{type(e).__name__}: {e}"
    if jobs and len(failed) == len(jobs):
        raise ValueError(f"no list could be prepared: {failed}")
    return failed


class Registry:
    """Named jobs with the lists that they make: what there is, what is there, and a run of some of them."""

    def __init__(self) -> None:
        self.jobs: dict[str, tuple[str, str, Callable[[], DataFrame]]] = {}

    def add(self, name: str, job: Callable[[], DataFrame], *, group: str = "", description: str = "") -> None:
        if name in self.jobs:
            raise ValueError(f"{name} is there already")
        self.jobs[name] = (group, description or (job.__doc__ or "").strip().split("\n")[0], job)

    def names(self, group: str | None = None) -> list[str]:
        return [n for n, (g, _, _) in self.jobs.items() if group in (None, g)]

    def info(self, spark: SparkSession, folder: str) -> DataFrame:
        """(name, group, description, rows, columns) of each job; rows and columns are null where its list is not in the folder."""
        there = manifest(spark, folder)
        told = []
        for name, (group, description, _) in self.jobs.items():
            rows = columns = None
            if name in there:
                df = spark.read.json(f"{folder}/{there[name]}", multiLine=True)
                rows, columns = df.count(), ", ".join(df.columns)
            told.append((name, group, description, rows, columns))
        return spark.createDataFrame(told, "name string, group string, description string, rows long, columns string")

    def update(self, folder: str, *, names: Sequence[str] | None = None, group: str | None = None) -> dict[str, str]:
        """Runs the named jobs, those of a group, or all; the errors of those that failed."""
        if unknown := set(names or ()) - self.jobs.keys():
            raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
        return prepare_lists({n: self.jobs[n][2] for n in (names or self.names(group))}, folder)
