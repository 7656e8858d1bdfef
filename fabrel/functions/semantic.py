"""Semantic values (person.full, finance.iban, ...) as columns drawn from small public word lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import WORDS, expand, uuid_of
from .rng import Draw

# Word lists of our own choice and public codes.
FIRST = {
    "female": "Ada Alice Amara Beatriz Chloe Clara Dalia Elena Emma Farah Grace Hana Ines Iris Julia Karin Lena Maya Nadia Olga Priya Rosa Sara Yuki Zoe".split(),
    "male": "Aaron Ahmed Bruno Carlos Daniel Erik Felix George Hugo Ivan James Kofi Liam Marco Noah Omar Pablo Quinn Rafael Sven Tariq Umar Victor Wei Yusuf".split(),
}
LAST = "Abbott Becker Castillo Dubois Eriksen Fischer Garcia Hansen Ivanova Jensen Kowalski Lopez Martin Nakamura Okafor Patel Quist Rossi Schmidt Tanaka Ueda Vargas Weber Xu Young Zhang Almeida Brennan Costa Dietrich Engel Fontaine Grant Hoffman Iyer Jansen Khan Lindgren Moreau Novak".split()
DOMAINS = ("example.com", "example.org", "example.net", "mail.example.com", "post.example.org")
CITIES = (
    ("Albany", "NY", "12207", "America/New_York", "518", "US", 99000), ("Austin", "TX", "78701", "America/Chicago", "512", "US", 962000),
    ("Boise", "ID", "83702", "America/Boise", "208", "US", 236000), ("Boston", "MA", "02108", "America/New_York", "617", "US", 654000),
    ("Chicago", "IL", "60601", "America/Chicago", "312", "US", 2697000), ("Dallas", "TX", "75201", "America/Chicago", "214", "US", 1304000),
    ("Denver", "CO", "80202", "America/Denver", "303", "US", 716000), ("Detroit", "MI", "48226", "America/Detroit", "313", "US", 639000),
    ("Fresno", "CA", "93721", "America/Los_Angeles", "559", "US", 542000), ("Honolulu", "HI", "96813", "Pacific/Honolulu", "808", "US", 351000),
    ("Houston", "TX", "77002", "America/Chicago", "713", "US", 2304000), ("Memphis", "TN", "38103", "America/Chicago", "901", "US", 633000),
    ("Miami", "FL", "33130", "America/New_York", "305", "US", 442000), ("Omaha", "NE", "68102", "America/Chicago", "402", "US", 486000),
    ("Phoenix", "AZ", "85003", "America/Phoenix", "602", "US", 1608000), ("Portland", "OR", "97204", "America/Los_Angeles", "503", "US", 652000),
    ("Raleigh", "NC", "27601", "America/New_York", "919", "US", 468000), ("Seattle", "WA", "98101", "America/Los_Angeles", "206", "US", 737000),
    ("Tampa", "FL", "33602", "America/New_York", "813", "US", 385000), ("Tucson", "AZ", "85701", "America/Phoenix", "520", "US", 543000),
)
# The area code that a US zip code stands for, by its first two digits; 555 for all others.
AREA_CODES = {
    "10": "212", "11": "212", "12": "212", "90": "213", "91": "213", "92": "213", "60": "312", "61": "312", "77": "214", "78": "214",
    "73": "214", "75": "214", "76": "214", "85": "480", "19": "215", "15": "215", "94": "415", "95": "415", "98": "206", "80": "303",
    "37": "615", "97": "503", "89": "702", "38": "901", "40": "502", "21": "410", "53": "414", "87": "505", "93": "559", "30": "404",
    "64": "816", "68": "402", "27": "919", "33": "305", "55": "612", "44": "216", "45": "216", "32": "904", "46": "317", "48": "313",
    "02": "617", "96": "808", "84": "801", "23": "804", "70": "504", "63": "314",
}
STREETS = "Maple Oak Cedar Pine Elm Lake Hill Park River Sunset Church Spring Mill Ridge Prairie".split()
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation".split()
COUNTRIES = (("US", "United States"), ("CA", "Canada"), ("MX", "Mexico"), ("BR", "Brazil"), ("GB", "United Kingdom"), ("DE", "Germany"), ("FR", "France"), ("ES", "Spain"), ("IT", "Italy"), ("JP", "Japan"), ("IN", "India"), ("AU", "Australia"))
CHARTS = {
    "ES": (("1", "Financiación básica", "Basic financing"), ("10", "Capital", "Capital"), ("100", "Capital social", "Share capital"), ("4300", "Clientes", "Customers"), ("57200", "Bancos", "Banks")),
    "DE": (("1", "Umlaufvermögen", "Current assets"), ("12", "Forderungen", "Receivables"), ("120", "Forderungen aus Lieferungen", "Trade receivables"), ("1800", "Bank", "Bank"), ("18100", "Bank Hauptkonto", "Main bank account")),
    "FR": (("4", "Comptes de tiers", "Third-party accounts"), ("41", "Clients", "Customers"), ("411", "Clients ordinaires", "Trade customers"), ("5120", "Banques", "Banks"), ("51210", "Compte courant", "Current account")),
    "IT": (("1", "Immobilizzazioni", "Fixed assets"), ("12", "Crediti", "Receivables"), ("120", "Crediti verso clienti", "Trade receivables"), ("1300", "Banche", "Banks"), ("13010", "Conto corrente", "Current account")),
    "PT": (("2", "Contas a receber", "Receivables"), ("21", "Clientes", "Customers"), ("211", "Clientes gerais", "General customers"), ("1200", "Depósitos à ordem", "Demand deposits"), ("12010", "Banco principal", "Main bank")),
    "US": (("1", "Assets", "Assets"), ("11", "Current assets", "Current assets"), ("110", "Cash", "Cash"), ("1200", "Accounts receivable", "Accounts receivable"), ("12010", "Trade receivables", "Trade receivables")),
}
LISTS: dict[str, tuple[str, ...]] = {
    "person.prefix": ("Mr.", "Ms.", "Mrs.", "Dr.", "Prof."), "person.suffix": ("Jr.", "Sr.", "II", "III", "PhD"), "person.gender": ("female", "male", "nonbinary"),
    "company.industry": ("Agriculture", "Education", "Energy", "Finance", "Health", "Logistics", "Manufacturing", "Media", "Retail", "Software"),
    "company.catch_phrase": ("Better every day", "Built to last", "Made for people", "Simple by design", "Work that travels"),
    "job.title": ("Accountant", "Analyst", "Architect", "Designer", "Engineer", "Manager", "Nurse", "Researcher", "Teacher", "Writer"),
    "job.department": ("Engineering", "Finance", "Human Resources", "Legal", "Marketing", "Operations", "Sales", "Support"),
    "color.name": ("amber", "black", "blue", "coral", "cyan", "green", "indigo", "lime", "magenta", "navy", "olive", "orange", "red", "teal", "white"),
    "file.extension": ("csv", "docx", "jpg", "json", "md", "pdf", "png", "txt", "xlsx", "zip"),
    "file.mime": ("application/json", "application/pdf", "image/jpeg", "image/png", "text/csv", "text/html", "text/plain"),
    "credit_card.type": ("Visa", "Mastercard", "American Express", "Discover"),
    "swift": ("DEUTDEFF", "BNPAFRPP", "CHASUS33", "BARCGB22", "BBVAESMM"),
    "erp.payment_term": ("Immediate", "15 Days", "30 Days", "45 Days", "60 Days", "End of Following Month"),
    "erp.incoterm": ("EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP"),
    "erp.uom": ("Units", "Dozens", "kg", "g", "L", "m", "km", "Hours", "Days"),
    "erp.tax_rate": ("0%", "4%", "5%", "10%", "19%", "20%", "21%"),
    "erp.account_type": ("Receivable", "Payable", "Bank and Cash", "Fixed Assets", "Equity", "Income", "Expenses"),
    "ecommerce.order_status": ("pending", "processing", "shipped", "delivered", "cancelled", "refunded"),
    "ecommerce.payment_method": ("credit_card", "debit_card", "bank_transfer", "wallet", "cash_on_delivery"),
    "ecommerce.shipping_carrier": ("UPS", "FedEx", "DHL", "USPS", "GLS"),
    "ecommerce.return_reason": ("damaged", "wrong_item", "not_as_described", "changed_mind", "late_delivery"),
    "ecommerce.discount_type": ("percentage", "fixed_amount", "free_shipping", "buy_x_get_y"),
    "ecommerce.fulfillment_status": ("unfulfilled", "partial", "fulfilled", "returned"),
    "ecommerce.department": ("bakery", "beverages", "dairy", "frozen", "household", "pantry", "produce", "snacks"),
    "ecommerce.aisle": ("bread", "cereal", "cheese", "coffee", "fresh fruits", "milk", "pasta", "soap", "tea", "yogurt"),
    "ecommerce.product_category": ("Apparel", "Books", "Electronics", "Furniture", "Garden", "Sports", "Toys"),
    "geo.timezone": ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "Europe/London", "Europe/Madrid", "Europe/Berlin", "Asia/Tokyo", "Asia/Kolkata", "Australia/Sydney"),
    "product.adjective": ("Compact", "Durable", "Elegant", "Foldable", "Light", "Modern", "Portable", "Quiet", "Rugged", "Smart"),
    "product.noun": ("Backpack", "Bottle", "Camera", "Chair", "Desk", "Headset", "Keyboard", "Lamp", "Speaker", "Watch"),
}
#: Public classification codes with their titles: a few of each system.
TAXONOMIES: dict[str, tuple[tuple[str, str], ...]] = {
    "naics": (("111110", "Soybean Farming"), ("236115", "New Single-Family Housing Construction"), ("541511", "Custom Computer Programming Services"), ("722511", "Full-Service Restaurants")),
    "isic": (("0111", "Growing of cereals"), ("4711", "Retail sale in non-specialized stores"), ("6201", "Computer programming activities"), ("8610", "Hospital activities")),
    "sic": (("0111", "Wheat"), ("2834", "Pharmaceutical Preparations"), ("7372", "Prepackaged Software"), ("8062", "General Medical Hospitals")),
    "unspsc": (("43211503", "Notebook computers"), ("44121706", "Wooden pencils"), ("50161509", "Natural sugars"), ("81111500", "Software engineering")),
    "hs": (("010121", "Pure-bred breeding horses"), ("090111", "Coffee, not roasted"), ("847130", "Portable computers"), ("870323", "Motor cars")),
    "mcc": (("5411", "Grocery Stores"), ("5812", "Restaurants"), ("5999", "Specialty Retail"), ("7011", "Hotels")),
    "cip": (("11.0701", "Computer Science"), ("14.0801", "Civil Engineering"), ("26.0101", "Biology"), ("52.0301", "Accounting")),
    "isced": (("0", "Early childhood education"), ("3", "Upper secondary education"), ("6", "Bachelor's or equivalent"), ("8", "Doctoral or equivalent")),
    "elf": (("2HBR", "Gesellschaft mit beschränkter Haftung"), ("5RDO", "Sociedad limitada"), ("XTIQ", "Corporation"), ("H0PO", "Private limited company")),
    "lei": (("529900T8BM49AURSDO55", "Example Bank AG"), ("5493001KJTIIGC8Y1R12", "Example Holdings"), ("213800D1EI4B9WTWWD28", "Example Plc"), ("969500UP76J52A9OXU27", "Example SA")),
    "cofog": (("01", "General public services"), ("04", "Economic affairs"), ("07", "Health"), ("09", "Education")),
    "cpv": (("03111000", "Seeds"), ("30213100", "Portable computers"), ("45210000", "Building construction work"), ("72000000", "IT services")),
    "dewey": (("004", "Computer science"), ("100", "Philosophy"), ("510", "Mathematics"), ("900", "History")),
    "atc": (("A10BA02", "metformin"), ("C07AB02", "metoprolol"), ("J01CA04", "amoxicillin"), ("N02BE01", "paracetamol")),
    "mesh": (("D000818", "Animals"), ("D003920", "Diabetes Mellitus"), ("D006801", "Humans"), ("D009369", "Neoplasms")),
    "unm49": (("002", "Africa"), ("019", "Americas"), ("142", "Asia"), ("150", "Europe")),
    "iso3166_2": (("US-CA", "California"), ("DE-BY", "Bayern"), ("ES-MD", "Madrid"), ("FR-IDF", "Île-de-France")),
    "ncbi": (("9606", "Homo sapiens"), ("10090", "Mus musculus"), ("7227", "Drosophila melanogaster"), ("562", "Escherichia coli")),
    "ipcc": (("1A1", "Energy industries"), ("2A1", "Cement production"), ("3A", "Livestock"), ("4A", "Solid waste disposal")),
}


def person(d: Draw, salt: str = "") -> tuple[Column, Column]:
    """First and last name; the first name by a coin for the list it comes from."""
    first = F.when(d.chance(0.5, salt + "g"), d.pick(FIRST["female"], salt + "f")).otherwise(d.pick(FIRST["male"], salt + "f"))
    return first, d.pick(LAST, salt + "l")


def words(d: Draw, n: int, salt: str = "w") -> Column:
    return F.array_join(F.array(*[d.pick(LOREM, f"{salt}{i}") for i in range(n)]), " ")


def sentence(d: Draw, salt: str = "s", n: int = 8) -> Column:
    text = words(d, n, salt)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 10_000), F.lit("."))


def phone(d: Draw, area: Column | None = None) -> Column:
    digits = lambda n, s: F.lpad((d.h(s) % 10**n).cast("string"), n, "0")
    return F.concat(F.lit("+1-"), d.integer(201, 989, "area").cast("string") if area is None else area, F.lit("-"), digits(3, "p1"), F.lit("-"), digits(4, "p2"))


def luhn_card(d: Draw) -> Column:
    """Sixteen digits that start with 4; the last makes the sum of Luhn a multiple of ten."""
    body = [F.lit(4), *[(d.h(f"c{i}") % 10).cast("int") for i in range(14)]]
    total = F.lit(0)
    for i, x in enumerate(body):
        twice = x * 2
        total = total + (F.when(twice > 9, twice - 9).otherwise(twice) if i % 2 == 0 else x)
    return F.concat(*[x.cast("string") for x in body], ((10 - total % 10) % 10).cast("string"))


def iban(d: Draw) -> Column:
    """A German IBAN: 18 digits behind check digits that make the number, with `DE` as 1314, 1 modulo 97."""
    digits = d.h("p1") % 10**18
    check = 98 - (digits % 97 * (10**6 % 97) + 131400) % 97
    return F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), F.lpad(digits.cast("string"), 18, "0"))


def account(d: Draw, params: tuple[str, ...], low: int, high: int, part: int) -> Column:
    """A code (part 0), name (1) or English name (2) among the accounts of low to high digits, of one country or all."""
    rows = [r for c, chart in sorted(CHARTS.items()) if not params or c == params[0] for r in chart if low <= len(r[0]) <= high]
    return d.pick([r[part] for r in rows], "row")


def area_code(zip_code: Column) -> Column:
    """The area code of a US zip code; 555 where it is null or not listed."""
    listed = F.create_map(*[F.lit(x) for pair in AREA_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, F.substring(zip_code, 1, 2)), F.lit("555"))


def timezone_of_state(text: Column) -> Column:
    """The time zone of the first known state whose code is a word of a text; New York's where there is none."""
    first = {c[1]: c[3] for c in reversed(CITIES)}  # of a state the first city counts
    zones = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    known = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2})\b")), lambda code: F.try_element_at(zones, code)), lambda z: z.isNotNull())
    return F.coalesce(F.get(known, 0), F.lit("America/New_York"))


def city_row(d: Draw, i: int, salt: str = "city") -> Column:
    """Field i of a city drawn by population: the same city for the same draw."""
    return d.weighted([c[i] for c in CITIES], [c[6] for c in CITIES], salt)


def street(d: Draw) -> Column:
    return F.concat(d.integer(1, 9999, "no").cast("string"), F.lit(" "), d.pick(STREETS, "st"), F.lit(" "), d.pick(["St", "Ave", "Rd", "Blvd"], "kind"))


def email_of(name: Column, d: Draw) -> Column:
    """first.last@domain of a name."""
    plain = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", ".")
    return F.concat(plain, F.lit("@"), d.pick(DOMAINS, "dom"))


def username_of(name: Column, d: Draw) -> Column:
    return F.concat(F.regexp_replace(F.lower(F.split(F.trim(name), " ")[0]), "[^a-z0-9]", ""), d.integer(1, 999, "un").cast("string"))


Maker = Callable[[Draw, tuple[str, ...]], Column]


def _full(d: Draw) -> Column:
    return F.concat_ws(" ", *person(d))


def _country(d: Draw, part: int) -> Column:
    return d.pick([c[part] for c in COUNTRIES], "country")


def _paragraph(d: Draw, salt: str = "par") -> Column:
    return F.concat_ws(" ", *[sentence(d, f"{salt}{i}") for i in range(3)])


MAKERS: dict[str, Maker] = {
    "person.full": lambda d, p: _full(d),
    "person.first": lambda d, p: person(d)[0],
    "person.last": lambda d, p: person(d)[1],
    "person.username": lambda d, p: username_of(_full(d), d),
    "person.dob": lambda d, p: F.date_add(F.lit("1945-01-01").cast("date"), d.integer(0, 22_000, "dob").cast("int")),
    "person.age": lambda d, p: d.integer(18, 80, "age"),
    "person.bio": lambda d, p: F.concat_ws(" ", sentence(d, "b1"), sentence(d, "b2")),
    "person.avatar": lambda d, p: F.concat(F.lit("https://img.example.com/avatar/"), d.integer(1, 9999, "av").cast("string"), F.lit(".png")),
    "person.ssn": lambda d, p: expand("9{00}-{00}-{0000}", d),
    "email": lambda d, p: email_of(_full(d), d),
    "phone": lambda d, p: phone(d),
    "url": lambda d, p: F.concat(F.lit("https://"), d.pick(DOMAINS, "dom"), F.lit("/"), d.pick(WORDS, "path")),
    "url.image": lambda d, p: F.concat(F.lit("https://img.example.com/"), d.integer(1, 9999, "i").cast("string"), F.lit(".jpg")),
    "url.avatar": lambda d, p: F.concat(F.lit("https://img.example.com/avatar/"), d.integer(1, 9999, "i").cast("string"), F.lit(".png")),
    "ipv4": lambda d, p: F.concat_ws(".", *[d.integer(1, 254, f"o{i}").cast("string") for i in range(4)]),
    "ipv6": lambda d, p: F.concat_ws(":", *[F.lpad(F.lower(F.hex(d.h(f"o{i}") % 65536)), 4, "0") for i in range(8)]),
    "mac": lambda d, p: F.concat_ws(":", *[F.lpad(F.lower(F.hex(d.h(f"o{i}") % 256)), 2, "0") for i in range(6)]),
    "address.full": lambda d, p: F.concat(street(d), F.lit(", "), city_row(d, 0), F.lit(", "), city_row(d, 1), F.lit(" "), city_row(d, 2)),
    "address.street": lambda d, p: street(d),
    "address.city": lambda d, p: city_row(d, 0),
    "address.state": lambda d, p: city_row(d, 1),
    "address.zip": lambda d, p: city_row(d, 2),
    "address.country": lambda d, p: _country(d, 1),
    "geo.lat": lambda d, p: F.round(d.u("lat") * 180 - 90, 6),
    "geo.lng": lambda d, p: F.round(d.u("lng") * 360 - 180, 6),
    "geo.point": lambda d, p: F.format_string("%.6f,%.6f", d.u("lat") * 180 - 90, d.u("lng") * 360 - 180),
    "currency": lambda d, p: F.round(d.u("amount") * 10_000, 2),
    "credit_card": lambda d, p: luhn_card(d),
    "iban": lambda d, p: iban(d),
    "text.word": lambda d, p: d.pick(LOREM, "w"),
    "text.sentence": lambda d, p: sentence(d),
    "text.paragraph": lambda d, p: _paragraph(d),
    "text.paragraphs": lambda d, p: F.concat_ws("\n\n", *[_paragraph(d, f"par{i}_") for i in range(int(p[0]) if p else 3)]),
    "text.slug": lambda d, p: F.replace(words(d, 3), F.lit(" "), F.lit("-")),
    "text.markdown": lambda d, p: F.concat(F.lit("# "), sentence(d, "h", 3), F.lit("\n\n"), _paragraph(d)),
    "text.html": lambda d, p: F.concat(F.lit("<p>"), _paragraph(d), F.lit("</p>")),
    "text.lorem": lambda d, p: words(d, int(p[0]) if p else 20),
    "product.title": lambda d, p: F.concat_ws(" ", d.pick(LISTS["product.adjective"], "a"), d.pick(LISTS["product.noun"], "n")),
    "product.description": lambda d, p: _paragraph(d),
    "sku": lambda d, p: expand("{AAA}-{00000}", d),
    "company.name": lambda d, p: F.concat(d.pick(LAST, "c"), F.lit(" "), d.pick(["Ltd", "Inc", "GmbH", "SA", "Group", "Partners"], "k")),
    "color.hex": lambda d, p: F.concat(F.lit("#"), F.lower(F.lpad(F.hex(d.h("c") % (1 << 24)), 6, "0"))),
    "color.rgb": lambda d, p: F.concat(F.lit("rgb("), F.concat_ws(", ", *[d.integer(0, 255, c).cast("string") for c in "rgb"]), F.lit(")")),
    "file.name": lambda d, p: F.concat(d.pick(LOREM, "n"), F.lit("."), d.pick(LISTS["file.extension"], "e")),
    "slug": lambda d, p: F.replace(words(d, 3), F.lit(" "), F.lit("-")),
    "code": lambda d, p: expand(p[0] if p else "{AA}{0000}", d),
    "hash.md5": lambda d, p: F.md5(d.h("x").cast("string")),
    "hash.sha256": lambda d, p: F.sha2(d.h("x").cast("string"), 256),
    "ecommerce.tracking_number": lambda d, p: expand("1Z{AA}{00000000}", d),
    "accounting.country": lambda d, p: d.pick(sorted(CHARTS), "country"),
}
for _name, _low, _high in (("group", 1, 1), ("subgroup", 2, 2), ("account", 3, 4), ("account_full", 5, 5)):
    for _suffix, _part in (("", 0), ("_name", 1), ("_name_en", 2)):
        MAKERS[f"accounting.{_name}{_suffix}"] = lambda d, p, a=_low, b=_high, k=_part: account(d, p, a, b, k)
for _name, _rows in TAXONOMIES.items():
    for _suffix, _part in (("code", 0), ("description", 1), ("name", 1), ("bank", 1)):
        MAKERS[f"{_name}.{_suffix}"] = MAKERS[f"taxonomy.{_name}_{_suffix}"] = lambda d, p, r=_rows, k=_part: d.pick([x[k] for x in r], "row")
    MAKERS[_name] = MAKERS[f"taxonomy.{_name}"] = MAKERS[f"{_name}.code"]
for _name, _values in LISTS.items():
    MAKERS.setdefault(_name, lambda d, p, v=_values: d.pick(v, "v"))
# Other names of the same makers.
ALIASES = {
    "contact.email": "email", "contact.phone": "phone", "phone.mobile": "phone", "phone.landline": "phone", "contact.url": "url", "geo.city": "address.city", "geo.country": "address.country",
    "address.lat": "geo.lat", "address.lng": "geo.lng", "address.timezone": "geo.timezone", "currency.usd": "currency", "currency.eur": "currency", "finance.iban": "iban", "finance.swift": "swift",
    "finance.credit_card": "credit_card", "finance.currency": "currency", "product.sku": "sku", "file.ext": "file.extension", "taxonomy.swift": "swift",
}
for _name, _of in ALIASES.items():
    MAKERS[_name] = MAKERS[_of]


def register(name: str, maker: Maker) -> None:
    """Adds a semantic type of one's own."""
    MAKERS[name] = maker


def semantic(name: str, params: tuple[str, ...], d: Draw) -> Column:
    """A value of the type; unknown ones give `name_<n>`."""
    if name in MAKERS:
        return MAKERS[name](d, params)
    if name.split(".")[0] == "currency":
        return MAKERS["currency"](d, params)
    return F.concat(F.lit(f"{name}_"), d.integer(1, 9999, "any").cast("string"))


__all__ = ["CITIES", "MAKERS", "city_row", "email_of", "person", "phone", "register", "semantic", "sentence", "street", "username_of", "uuid_of", "words"]
