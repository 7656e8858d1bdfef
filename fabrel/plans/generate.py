"""Generates the entities of a document as lazy DataFrames.

Every value is a pure function of seed, entity, field and row number, so datasets do not depend on partitioning and
parents' keys are known without a join. Fields come in this order: unique ones, coherence groups, plain fields,
dependent_required, derived ones after what they read, timestamps; then rules, on the row as it is then. Fields that need rows
of other tables which are not there yet, and rules that set fields, come after all rows, stage by stage (`stages`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, GenerationError, UniquenessExhausted
from ..functions.distributions import sample
from ..functions.expressions import Compiler, Value, columns_of, compute, default_chain, display, kind_of, parsed
from ..functions.patterns import cuid_of, expand, is_template, spread, ulid_of, uuid_of
from ..functions.regexes import Regex, is_regex
from ..functions.rng import Draw
from ..functions.semantic import CITIES, area_code, email_of, person, phone, semantic, street, timezone_of_state, username_of, words
from ..model import Document, Entity, Field, Rule, Type
from ..operators.constraints import UNIQUE_ATTEMPTS, bounds_of, decorated, length_of, unique_values
from ..operators.dimensions import LISTED, Dimension, dimension, list_of
from ..operators.gazetteer import longest_name
from ..operators.references import bridge, dereference, earlier_index, parent_index, with_keys
from ..operators.rules import cardinality, count_bounds, cross_row, duplicates, fields_of, first_of_each
from ..operators.totals import apportioned, numbered, running_sum
from ..sources.files import prepared_lists
from ..storage import written
from .order import closure, entity_order, targets, volumes
from .stages import Read, Stages, child_of, is_collection, names_in, own, share_rule, text_reads

NOW = datetime(2025, 1, 15, 10, 30)
RULE_ATTEMPTS = 10
#: Combinations of values that a deal looks at, where there are as many; more, if the entity has more rows.
DEALT = 1 << 20
LOCATION = ("city", "state", "zip", "timezone", "phone", "address", "street", "country")
#: Decorators that describe a field and leave its values as they are.
DESCRIBING = frozenset("index immutable sortable filterable searchable hidden sensitive readonly deprecated write_only examples cacheable cascade restrict set_null eager lazy domain locale".split())
#: Children that a collection has at most above its least number, if nothing says how many.
SPAN = 4


def as_variant(c: Column, t: Type) -> Column:
    """A value as a variant, which keeps its own type."""
    return F.to_variant_object(c) if t.kind in ("list", "map", "tuple", "poly") else c.cast("variant")


def spark_type(t: Type) -> str:
    if t.kind == "union" or (t.kind == "prim" and t.name == "any"):
        return "variant"
    if t.kind == "prim":
        bits = {"8": "tinyint", "16": "smallint", "32": "int"}
        if t.name == "int":
            return bits.get(t.items[0], "long") if t.items else "long"
        if t.name == "float":
            return "float" if t.items[:1] == ("32",) else "double"
        if t.name == "decimal":
            p, s = (*t.items, "0")[:2] if t.items else ("10", "2")
            return f"decimal({p},{s})"
        return {"bool": "boolean", "datetime": "timestamp_ntz", "date": "date", "bytes": "binary"}.get(t.name, "string")
    if t.kind == "optional":
        return spark_type(t.items[0])
    if t.kind == "semantic":
        return {"person.age": "long", "person.dob": "date", "geo.lat": "double", "geo.lng": "double", "address.lat": "double", "address.lng": "double"}.get(t.name, "double" if t.name.startswith("currency") else "string")
    return "string"


@dataclass
class Generator:
    """Makes one document's entities; `frames` holds those made so far, with `_rid`."""

    spark: SparkSession
    doc: Document
    seed: int
    rows: dict[str, int]
    now: datetime = NOW
    frames: dict[str, DataFrame] = field(default_factory=dict)
    bridges: dict[str, DataFrame] = field(default_factory=dict)
    fixed: set[str] = field(default_factory=set)  # entities whose number of rows is given
    owners: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)  # (reference, rows with __parent) of entities that are made as children
    even: set[tuple[str, str]] = field(default_factory=set)  # references that give each parent as many children, or one more

    lists: dict[str, DataFrame] = field(default_factory=dict)  # prepared lists that semantic types draw from
    dimensions: dict[str, Dimension | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.stages = Stages(self.doc, self.late_key)

    def draw(self, entity: str, name: str, rid: Column, attempt: Column | None = None) -> Draw:
        return Draw(self.seed, entity, name, rid, attempt)

    # -- values ------------------------------------------------------------------------------------------------

    def key(self, entity: Entity, rid: Column) -> Column:
        """The key of row rid. A primary key is a pattern spread over its texts, a number or a UUID; another key is the
        value of its field, which is drawn once for a row."""
        f = entity.key
        if self.late_key(entity):
            raise GenerationError(f"{entity.name}.{f.name} is known only once the rows are made")
        d = self.draw(entity.name, f.name, rid)
        if not f.has("primary"):
            return self.field(entity, f, d)
        if p := f.get("pattern"):
            return expand(p.args[0], d, distinct=True)
        if spark_type(f.type) in ("long", "int", "smallint", "tinyint"):
            return (rid + 1).cast(spark_type(f.type))
        text = F.concat_ws("|", F.lit(f"{self.seed}|{entity.name}|{f.name}"), rid.cast("string"))
        kind = self.doc.generation.get("id_format", "uuid")
        if kind == "sequential":
            return (rid + 1).cast("string")
        return {"ulid": lambda: ulid_of(text, self.now), "cuid": lambda: cuid_of(text)}.get(kind, lambda: uuid_of(text))()

    def null_share(self, usual: float, f: Field) -> float:
        """The share of nulls: what the field says, else the usual one; `null_strategy` never: none, sparse: 0.6 unless given."""
        strategy, share = self.doc.generation.get("null_strategy", "realistic"), f.get("null_rate")
        if strategy == "never":
            return 0.0
        return float(share.args[0]) if share else 0.6 if strategy == "sparse" and usual else usual

    def resolved_unique(self, entity: Entity) -> list[Field]:
        """Unique fields whose values are made unique in rounds."""
        apart = lambda f: f.has("primary") or (f.get("pattern") and is_template(f.get("pattern").args[0])) or self.values_of(entity, f)
        return [f for f in self.stored(entity) if f.has("unique") and not apart(f) and not f.has("from") and not f.is_derived and all(f.name not in g for _, g in entity.coherence)]

    def values_of(self, entity: Entity, f: Field) -> int | None:
        """The size of a unique field's space, if row numbers can be spread over it: not if a rule may ask for other values."""
        size = self.space(entity, f) if f.has("unique") else None
        asked = (Read(entity.name, f.name, True) in text_reads(self.doc, entity, x) for r in self.doc.rules if r.entity == entity.name and r.kind in ("row", "unique") for x in (r.check, r.when) if x)
        return None if size is None or any(asked) else size

    def space(self, entity: Entity, f: Field) -> int | None:
        """How many values a field can take: a range of whole numbers, an enum or a regex that makes each of its texts in one way."""
        if f.has("dist", "values", "multiple_of", "len", "not_empty", "default", "emin", "emax") or f.type.kind not in ("prim", "enum", "named"):
            return None
        if (p := f.get("pattern")) and f.type.name == "string":
            return Regex(p.args[0]).spread if is_regex(p.args[0]) else None
        if f.type.kind == "prim" and f.type.name == "int":
            low, high = bounds_of(f).closed(True)
            return None if low is None or high is None else int(high) - int(low) + 1
        if f.type.kind == "enum":
            return len(set(f.type.items))
        return len(self.doc.enums[f.type.name]) if f.type.kind == "named" and f.type.name in self.doc.enums else None

    def distinct(self, entity: Entity, f: Field, d: Draw, size: int) -> Column:
        """The value of a row in a space of `size` values over which row numbers are spread by a bijection."""
        if self.rows[entity.name] > size:
            raise UniquenessExhausted(f"{entity.name}.{f.name}: {self.rows[entity.name]} rows, {size} values")
        return self.value_at(f, spread(d, size))

    def value_at(self, f: Field, place: Column) -> Column:
        """The value at a place in the space of a field."""
        if p := f.get("pattern"):
            return Regex(p.args[0]).text(place)
        if f.type.kind == "prim":
            return (place + F.lit(int(bounds_of(f).closed(True)[0]))).cast(spark_type(f.type))
        values = list(dict.fromkeys(f.type.items)) if f.type.kind == "enum" else [v for v, _ in self.doc.enums[f.type.name]]
        return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))

    def late_key(self, entity: Entity) -> bool:
        """Whether keys are no function of the row's number, so that a reference to them is a join."""
        f = entity.key
        return not f.has("primary") and (f in self.resolved_unique(entity) or f.is_derived or f.has("from", "after", "before", "within", "correlated") or any(f.name in g for _, g in entity.coherence))

    def referred_to(self, entity: Entity) -> bool:
        return any(entity.name in targets(f.type) or (e is entity and "self" in targets(f.type)) for e in self.doc.entities.values() for f in e.fields)

    def primitive(self, t: Type, f: Field, d: Draw) -> Column:
        b = bounds_of(f)
        if t.name in ("int", "float", "decimal"):
            low, high = b.closed(t.name == "int")
            if dist := f.get("dist"):
                x = sample(dist, d, low, high)
            elif t.name == "int":
                width = {"8": 127, "16": 32767, "32": (1 << 31) - 1}.get(t.items[0] if t.items else "", (1 << 63) - 1)
                top = min(width, 1_000_000)
                lo = -top if low is None else max(int(low), -width - 1)
                if lo > width:
                    raise GenerationError(f"{f.name}: no int({t.items[0]}) is {lo} or more")
                x = d.integer(lo, max(lo, (top if high is None else min(int(high), width))), "v")
            else:
                p, s = (int(i) for i in (*t.items, "2")[:2]) if t.name == "decimal" and t.items else (6, 2)
                lo, hi = 0.0 if low is None else low, (float(10 ** (p - s)) - 10.0**-s if t.name == "decimal" else 1e6) if high is None else high
                x = F.lit(float(lo)) + d.u("v") * F.lit(float(hi) - float(lo))
            if t.name == "int":
                return F.round(x).cast(spark_type(t))
            scale = int(t.items[1]) if t.name == "decimal" and len(t.items) > 1 else 2
            digits = max(scale, 4) if b.open_low or b.open_high else scale
            return (F.round(x * 10**digits) / F.lit(float(10**digits))).cast(spark_type(t))
        if t.name == "string":
            most = min(int(t.items[0]), 200) if t.items else 30
            text = F.initcap(words(d, 5))
            return F.trim(F.substring(text, 1, most))
        low, high = (str(b.low) if b.low is not None else None, str(b.high) if b.high is not None else None)
        if t.name == "date":
            start, end = self._day(low, "2020-01-01"), self._day(high, "2025-12-29")
            return F.date_add(start, (d.h("v") % (F.datediff(end, start) + 1)).cast("int"))
        if t.name == "datetime":
            start, end = self._moment(low, "2020-01-01 00:00:00"), self._moment(high, "2025-12-31 23:59:59")
            span = F.timestamp_diff("SECOND", start, end) + 1
            return F.timestamp_add("SECOND", (d.h("v") % span).cast("int"), start)
        if t.name == "time":
            two = lambda n, s: F.lpad((d.h(s) % n).cast("string"), 2, "0")
            return F.concat_ws(":", two(24, "h"), two(60, "m"), two(60, "s"))
        made = {
            "bool": lambda: d.chance(0.5, "v"),
            "duration": lambda: F.concat(F.lit("PT"), (d.h("h") % 72).cast("string"), F.lit("H"), (d.h("m") % 60).cast("string"), F.lit("M")),
            "uuid": lambda: uuid_of(d.h("v").cast("string")),
            "bytes": lambda: F.unhex(F.substring(F.concat(*[F.sha2(d.h(f"v{i}").cast("string"), 256) for i in range(8)]), 1, 2 * min(int(t.items[0]) if t.items else 16, 256))),
            "null": lambda: F.lit(None).cast("string"),
            "any": lambda: F.when(d.chance(0.5, "k"), d.integer(0, 1000, "v").cast("variant")).otherwise(F.concat(F.lit("val_"), d.integer(0, 1000, "v").cast("string")).cast("variant")),
        }
        return made[t.name]()

    def _moment(self, text: str | None, default: str) -> Column:
        if text is None:
            return F.lit(default).cast("timestamp_ntz")
        if m := re.fullmatch(r"now(?:([+-]\d+)d)?", text):
            return F.lit(self.now).cast("timestamp_ntz") + F.make_interval(days=F.lit(int(m[1] or 0)))
        return F.lit(text).cast("timestamp_ntz")

    def _day(self, text: str | None, default: str) -> Column:
        return F.lit(default).cast("date") if text is None else self._moment(text, default).cast("date")

    def typed(self, t: Type, f: Field, d: Draw, entity: Entity) -> Column:
        if t.kind == "prim":
            return self.primitive(t, f, d)
        if t.kind == "semantic":
            found = self.list_of(entity, f)
            x = semantic(t.name, t.items, d) if found is None else F.col(f"`{found[0]}`")[found[2]]
            b = bounds_of(f)
            if t.name.startswith("currency") and (b.low is not None or b.high is not None or f.has("dist")):
                return self.primitive(Type("prim", "float"), f, d)
            return x
        if t.kind == "enum" or (t.kind == "named" and t.name in self.doc.enums):
            values = list(t.items) if t.kind == "enum" else [v for v, _ in self.doc.enums[t.name]]
            weights = [1.0] * len(values) if t.kind == "enum" else [w for _, w in self.doc.enums[t.name]]
            if dist := f.get("dist"):
                given = dict(dist.named)
                numbers = [a for a in dist.args if a not in ("categorical", "weighted")]
                weights = [float(given.get(v, 0)) for v in values] if given else [float(n) for n in numbers] if len(numbers) == len(values) else weights
            return d.pick(values, "v") if len(set(weights)) == 1 else d.weighted(values, weights, "v")
        if t.kind == "named" and t.name in self.doc.types:
            parts = [self.field(entity, g, d.sub(g.name)).alias(g.name) for g in self.doc.types[t.name]]
            return F.struct(*parts)
        if t.kind == "optional":
            p, x = self.null_share(0.2, f), self.typed(t.items[0], f, d, entity)
            return F.when(d.chance(p, "null"), F.lit(None)).otherwise(x) if p else x
        if t.kind == "list":
            low, high = length_of(f) or (0, 4)
            inner = Field(f.name, t.items[0])
            many = 3 * high if f.has("unique_items") else high
            items = F.array(*[self.typed(t.items[0], inner, d.sub(str(i)), entity) for i in range(max(many, 1))])
            items = F.array_distinct(items) if f.has("unique_items") else items
            return F.slice(items, F.lit(1), d.integer(low, high, "len").cast("int"))
        if t.kind == "map":
            entries = [F.struct(self.typed(t.items[0], Field(f.name, t.items[0]), d.sub(f"k{i}"), entity).cast("string").alias("key"), self.typed(t.items[1], Field(f.name, t.items[1]), d.sub(f"v{i}"), entity).alias("value")) for i in range(4)]
            chosen = F.slice(F.array(*entries), F.lit(1), d.integer(1, 4, "len").cast("int"))
            first = F.filter(chosen, lambda x, i: F.array_position(F.transform(chosen, lambda y: y["key"]), x["key"]) == i + 1)
            return F.map_from_entries(first)
        if t.kind == "tuple":
            return F.struct(*[self.typed(i, Field(f.name, i), d.sub(str(k)), entity).alias(f"_{k + 1}") for k, i in enumerate(t.items)])
        if t.kind == "union":
            n = d.h("branch") % len(t.items)
            out = None
            for k, i in enumerate(t.items):
                v = as_variant(self.typed(i, Field(f.name, i), d.sub(str(k)), entity), i)
                out = F.when(n == k, v) if out is None else out.when(n == k, v)
            return out
        if t.kind == "ref":
            return self.reference(t, f, d, entity)
        if t.kind == "poly":
            n, out = d.h("type") % len(t.items), None
            for k, i in enumerate(t.items):
                v = F.struct(F.lit(i.name).alias("type"), self.reference(i, f, d.sub(i.name), entity).cast(self.poly_id(t, entity)).alias("id"))
                out = F.when(n == k, v) if out is None else out.when(n == k, v)
            return out
        return F.trim(F.initcap(words(d, 3)))

    def target(self, t: Type, entity: Entity) -> Entity:
        return entity if t.name == "self" else self.doc.entities[t.name]

    def poly_id(self, t: Type, entity: Entity, *, final: bool = False) -> str:
        """The type of the ids of a polymorphic reference; numbers of rows whose keys come later stand in it as texts."""
        kinds = {spark_type(self.target(i, entity).key.type) for i in t.items}
        late = any(self.late_key(self.target(i, entity)) for i in t.items)
        return "string" if len(kinds) > 1 or (late and not final) else kinds.pop()

    def reference(self, t: Type, f: Field, d: Draw, entity: Entity) -> Column:
        """A parent's key, each parent as likely; of the same entity only earlier rows. No join: keys are functions of rows. Where
        they are not, it is the row's number, and `keyed` joins the key."""
        own = t.name in ("self", entity.name)
        target = entity if own else self.doc.entities.get(t.name)
        if target is None:
            raise GenerationError(f"{entity.name}.{f.name} refers to unknown entity {t.name}")
        if not own and self.rows[target.name] == 0:
            if t.optional:
                return F.lit(None).cast(spark_type(target.key.type))
            raise GenerationError(f"{entity.name}.{f.name}: {t.name} has no rows")
        known = lambda index: index if self.late_key(target) else F.when(index.isNotNull(), self.key(target, index))
        if self.owners.get(entity.name, ("",))[0] == f.name:
            return known(F.col("__parent"))
        if (entity.name, f.name) in self.even:
            n = self.rows[entity.name]
            return known(F.call_function("div", spread(d, n) * F.lit(self.rows[target.name]).cast("long"), F.lit(n).cast("long")))
        found = known(earlier_index(d) if own else parent_index(d, self.rows[target.name]))
        p = self.null_share(0.7 if own and t.optional else 0.2 if t.optional else 0, f)
        return F.when(d.chance(p, "null"), F.lit(None)).otherwise(found) if p else found

    def keyed(self, entity: Entity, df: DataFrame, *, own: bool) -> DataFrame:
        """df with keys where references are numbers of rows: of other entities, or (own) of its own, once all its rows are there."""
        for f in self.stored(entity):
            inner = f.type.items[0] if f.type.kind in ("list", "optional") else f.type
            for t in inner.items if inner.kind == "poly" else [inner] if inner.kind == "ref" else []:
                target = self.target(t, entity)
                if f.name in df.columns and (target is entity) == own and self.late_key(target):
                    df = df if not own else written(df, f"gen-{entity.name}")
                    keys = (df if own else self.frames[target.name]).select(F.col("_rid").alias("__at"), F.col(target.key.name).alias("__key"))
                    df = with_keys(df, f.name, keys, branch=t.name if inner.kind == "poly" else None)
            if inner.kind == "poly" and f.name in df.columns and self.poly_id(inner, entity) != self.poly_id(inner, entity, final=True) and own == any(self.target(t, entity) is entity for t in inner.items):
                df = df.withColumn(f.name, F.col(f.name).withField("id", F.col(f"{f.name}.id").cast(self.poly_id(inner, entity, final=True))))
        return df

    def field(self, entity: Entity, f: Field, d: Draw) -> Column:
        """A plain field with its decorators."""
        if f.name == entity.key.name and f.has("primary"):
            return self.key(entity, d.rid)
        kind = spark_type(f.type)
        if f.has("auto"):
            made = {"created_at": F.lit(self.now).cast("timestamp_ntz"), "updated_at": F.lit(self.now).cast("timestamp_ntz"), "version": F.lit(1).cast("long")}
            return made.get(f.name, F.lit(self.now).cast("timestamp_ntz") if kind == "timestamp_ntz" else F.lit(None).cast(kind))
        if size := self.values_of(entity, f) if entity.field(f.name) is f else None:
            x = self.distinct(entity, f, d, size)
        elif (p := f.get("pattern")) and is_regex(p.args[0]):
            x = Regex(p.args[0]).drawn(d)
        elif (p := f.get("pattern")) and is_template(p.args[0]):
            x = expand(p.args[0], d, distinct=f.has("unique"))
        else:
            x = self.typed(f.type, f, d, entity)
        if f.type.kind not in ("optional", "ref", "poly"):
            if f.has("null_rate") and (p := self.null_share(0, f)):
                x = F.when(d.chance(p, "null"), F.lit(None)).otherwise(x)
            if f.has("optional") and (p := 0.15 if f.has("null_rate") and self.null_share(1, f) else self.null_share(0.15, f)):
                x = F.when(d.chance(p, "opt"), F.lit(None)).otherwise(x)
        if f.type.kind == "list" and f.has("not_empty"):
            x = F.when(F.size(x) == 0, F.array(F.lit(None))).otherwise(x)
        if f.type.kind in ("prim", "enum", "semantic", "named", "optional") and not (f.type.kind == "named" and f.type.name in self.doc.types):
            x = decorated(x, f, d, kind)
            inner = f.type.items[0] if f.type.kind == "optional" else f.type
            if inner.kind == "semantic" and inner.name.startswith("currency") and self.doc.generation.get("currency_format") == "integer_cents":
                x = F.round(x * 100).cast("long")
        return x

    def bundle(self, entity: Entity, group: str, names: tuple[str, ...], rid: Column, attempt: Column) -> dict[str, Column]:
        """The fields of a coherence group from one draw: a place, a person, or plain fields in the listed order."""
        d = self.draw(entity.name, f"group:{group}", rid, attempt)
        place = any(w in group.lower() for w in ("location", "address", "geo")) or sum(n in LOCATION for n in names) >= 2
        out = {}
        if place:
            row = lambda i: d.pick([c[i] for c in CITIES], "row")
            made = {"city": row(0), "state": row(1), "zip": row(2), "zip_code": row(2), "postal_code": row(2), "timezone": row(3), "phone": phone(d, row(4)), "country": row(5)}
            made["street"] = street(d)
            made["address"] = F.concat(street(d), F.lit(", "), row(0), F.lit(", "), row(1), F.lit(" "), row(2))
        else:
            first, last = person(d)
            name = F.concat_ws(" ", first, last)
            made = {"first_name": first, "first": first, "last_name": last, "last": last, "name": name, "full_name": name, "email": email_of(name, d), "username": username_of(name, d)}
        for n in names:
            f = entity.field(n)
            if f is not None:
                own = self.field(entity, f, self.draw(entity.name, n, rid, attempt))
                out[n] = own if self.list_of(entity, f) else made.get(n, own)
        return out

    def copied(self, f: Field, source: Column, d: Draw) -> Column:
        """@from(source): an e-mail, time zone, phone or user name that fits it, else a copy. A city is met in any
        case; where a text names none, a time zone is that of the first state whose code stands in it."""
        name = f.name.lower()
        if "email" in name:
            return email_of(source, d)
        if "username" in name or "user_name" in name:
            return username_of(source, d)
        if "timezone" in name or "phone" in name:
            out, text = None, F.lower(source)
            for c in CITIES:
                v = F.lit(c[3]) if "timezone" in name else phone(d, F.lit(c[4]))
                out = F.when(text.contains(c[0].lower()), v) if out is None else out.when(text.contains(c[0].lower()), v)
            return out.otherwise(timezone_of_state(source) if "timezone" in name else phone(d, F.lit("555")))
        return source

    # -- entities ----------------------------------------------------------------------------------------------

    def stored(self, entity: Entity) -> list[Field]:
        """Fields that are columns: has-many and many-to-many ones live on the other side."""
        return [f for f in entity.fields if not is_collection(self.doc, f)]

    def list_of(self, entity: Entity, f: Field) -> tuple[str, str, str] | None:
        """(draw, list, column) of a semantic field that draws from a prepared list; the fields of a coherence group share a draw.
        Fields within others, and unique ones, take the built-in values."""
        t = f.type.items[0] if f.type.kind == "optional" else f.type
        if not self.lists or entity.field(f.name) is not f or t.kind != "semantic" or f.has("unique", "primary", "dist"):
            return None
        found = list_of(t.name, {n: df.columns for n, df in self.lists.items()})
        if found is None:
            return None
        if found[0] not in self.dimensions:
            self.dimensions[found[0]] = dimension(self.lists[found[0]])
        group = next((g for g, names in entity.coherence if f.name in names), None)
        return None if self.dimensions[found[0]] is None else (f"__list.{group or f.name}.{found[0]}", *found)

    def gazetteer(self, f: Field) -> bool:
        """Whether a field @from an address takes its time zone from the list of cities: that of the longest name in the address."""
        return "timezone" in f.name.lower() and {"name", "timezone"} <= set(self.lists["cities"].columns if "cities" in self.lists else ())

    def listed(self, entity: Entity, rows: DataFrame, attempt: Column) -> DataFrame:
        """rows with the rows of prepared lists that their fields draw: a join for each draw."""
        for f in self.stored(entity):
            found = self.list_of(entity, f)
            if found and found[0] not in rows.columns and f.name not in rows.columns:
                rows = self.dimensions[found[1]].drawn(rows, self.draw(entity.name, found[0].removeprefix("__list."), F.col("_rid"), attempt), found[0])
        return rows

    def plain(self, entity: Entity, rows: DataFrame, attempt: Column) -> DataFrame:
        rid = F.col("_rid")
        made: dict[str, Column] = {}
        given = [n for n in rows.columns if n != "_rid"]
        rows = self.listed(entity, rows, attempt)
        for group, names in entity.coherence:
            made |= self.bundle(entity, group, names, rid, attempt)
        made |= {n: F.col(n) for n in given}
        fixed = entity.key.name if self.referred_to(entity) else None  # others know it by the row's number
        for f in self.stored(entity):
            if f.name not in made and not f.is_derived and not f.has("from") and (entity.name, f.name) not in self.stages.late:
                made[f.name] = self.field(entity, f, self.draw(entity.name, f.name, rid, None if f.name == fixed else attempt))
        placed = [f for f in self.stored(entity) if f.has("from") and f.name not in made and self.gazetteer(f)]
        for f in self.stored(entity):
            if (s := f.get("from")) and f.name not in made and f not in placed:
                source = made.get(s.args[0])
                if source is None:
                    raise GenerationError(f"{entity.name}.{f.name}: no field {s.args[0]}")
                d = self.draw(entity.name, f.name, rid, attempt)
                by_zip = "phone" in f.name.lower() and any(w in s.args[0].lower() for w in ("zip", "postal"))
                made[f.name] = phone(d, area_code(source)) if by_zip else self.copied(f, source, d)
        df = rows.select("_rid", *[c.alias(n) for n, c in made.items()])
        for f in placed:
            if f.get("from").args[0] not in df.columns:
                raise GenerationError(f"{entity.name}.{f.name}: no field {f.get('from').args[0]}")
            df = longest_name(df, "_rid", f.get("from").args[0], self.lists["cities"], "name", weight="population" if "population" in self.lists["cities"].columns else None, into="__place")
            df = df.withColumn(f.name, F.coalesce("__place.timezone", F.lit("America/New_York"))).drop("__place")
        df = self.keyed(entity, df, own=False)
        return self.temporal(entity, df, attempt)

    def temporal(self, entity: Entity, df: DataFrame, attempt: Column, only: Field | None = None) -> DataFrame:
        """@after, @before, @within and @correlated, which need other fields of the row or of a parent."""
        for f in [only] if only else [f for f in self.stored(entity) if (entity.name, f.name) not in self.stages.late]:
            d = self.draw(entity.name, f.name, F.col("_rid"), attempt)
            for deco in f.decorators:
                if deco.name in ("after", "before", "within"):
                    path = tuple(deco.args[-1].split("."))
                    df, at = self.path(entity, df, path)
                    days = int(m[1]) if deco.name == "within" and (m := re.match(r"(\d+)", deco.args[0])) else 30
                    seconds = (d.h("gap") % (days * 86_400) + 1).cast("int")
                    df = df.withColumn(f.name, F.timestamp_add("SECOND", -seconds if deco.name == "before" else seconds, at.col.cast("timestamp_ntz")).cast(spark_type(f.type)))
                elif deco.name == "correlated":
                    r = float(deco.option("r", default=deco.args[1] if len(deco.args) > 1 else "0.8"))
                    other, b = entity.field(deco.args[0]), bounds_of(f)
                    if other is None:
                        raise GenerationError(f"{entity.name}.{f.name}: no field {deco.args[0]}")
                    ob = bounds_of(other)
                    (lo, hi), (olo, ohi) = (tuple(0.0 if x is None else float(x) for x in (y.low, y.high)) for y in (b, ob))
                    z = (F.col(other.name).cast("double") - (olo + ohi) / 2) / F.lit(max((ohi - olo) / 12**0.5, 1e-9))
                    own = (d.u("corr") - 0.5) * F.lit(12**0.5)
                    x = F.lit((lo + hi) / 2) + (F.lit(r) * z + F.lit((1 - r * r) ** 0.5) * own) * F.lit((hi - lo) / 12**0.5)
                    x = F.greatest(F.lit(lo), F.least(F.lit(hi), x))
                    whole = spark_type(f.type) in ("long", "int")
                    df = df.withColumn(f.name, (F.round(x) if whole else F.round(x, 2)).cast(spark_type(f.type)))
        return df

    def path(self, entity: Entity, df: DataFrame, path: tuple[str, ...]) -> tuple[DataFrame, Value]:
        """df with what a dotted path leads to; each hop is joined once. A path that begins with another entity's name leads to
        its last row."""
        at, prefix = entity, ""
        if len(path) == 2 and entity.field(path[0]) is None and path[0] in self.doc.entities:
            source = self.made(path[0])
            if path[1] not in source.columns:
                raise GenerationError(f"no field {'.'.join(path)}")
            return df, Value(source.agg(F.max_by(path[1], "_rid")).scalar(), kind_of(source.schema[path[1]].dataType))
        for hop in path[:-1]:
            f = at.field(hop)
            if f is None or f.type.kind != "ref":
                raise GenerationError(f"{entity.name}: {'.'.join(path)} does not lead to a field")
            target = at if f.type.name == "self" else self.doc.entities[f.type.name]
            source = self.made(target.name)
            mark = f"{prefix}{hop}."
            if f"__has.{mark}" not in df.columns:
                fields = {c: f"{mark}{c}" for c in source.columns if c != "_rid"}
                df = dereference(df.withColumn("__ref", F.col(f"`{prefix}{hop}`")), source, "__ref", target.key.name, fields).drop("__ref").withColumn(f"__has.{mark}", F.lit(True))
            at, prefix = target, mark
        name = f"{prefix}{path[-1]}"
        if name not in df.columns:
            raise GenerationError(f"{entity.name}: no field {'.'.join(path)}")
        return df, Value(F.col(f"`{name}`"), kind_of(df.schema[name].dataType))

    def made(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise GenerationError(f"{name} is not made yet")
        return self.frames[name]

    def over_entity(self, function: str, path: tuple[str, ...]) -> Value | None:
        """An aggregate over all rows of another entity, `count(E)` or `sum(E.f)`: one value, found by a subquery."""
        if path[0] not in self.doc.entities or len(path) > 2 or (len(path) == 1 and function != "count"):
            return None
        rows = self.made(path[0])
        if function == "count":
            return Value(rows.agg(F.count("*")).scalar(), "int")
        value = columns_of(rows.schema)(path[1:])
        number = value.col if value.kind == "int" else value.col.cast("double")
        found = {"sum": F.sum(number), "avg": F.avg(number), "min": F.min(value.col), "max": F.max(value.col), "all_equal": F.count_distinct(value.col) + F.max(value.col.isNull().cast("int")) <= 1}[function]
        kind = {"avg": "float", "all_equal": "bool"}.get(function, value.kind if function in ("min", "max") or value.kind == "int" else "float")
        empty = {"sum": F.lit(0).cast("long" if value.kind == "int" else "double"), "avg": F.lit(0.0), "all_equal": F.lit(True)}.get(function)
        one = rows.agg(found.alias("x")).scalar()
        return Value(one if empty is None else F.coalesce(one, empty), kind)

    def over_children(self, entity: Entity, df: DataFrame, function: str, path: tuple[str, ...]) -> tuple[DataFrame, Value]:
        """df with an aggregate over each row's children: one aggregation of the child table, summed up before the shuffle."""
        child, ref = child_of(self.doc, entity, path[0])
        rows, name = self.made(child.name), f"__of.{function}.{'.'.join(path)}"
        if len(path) > 2 or (len(path) == 2 and path[1] not in rows.columns) or (len(path) == 1 and function != "count"):
            raise GenerationError(f"{entity.name}: {function}({'.'.join(path)}) is no aggregate of a child's field")
        value = columns_of(rows.schema)(path[1:]) if len(path) == 2 else Value(F.lit(1), "int")
        x, kind = value.col, {"count": "int", "avg": "float", "all_equal": "bool"}.get(function, value.kind)
        made = {"count": lambda: F.count("*"), "sum": lambda: F.round(F.sum(x), 9) if value.kind == "float" else F.sum(x), "avg": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "all_equal": lambda: F.min(x).eqNullSafe(F.max(x)) & F.count(x).isin(0, F.count("*"))}
        if name not in df.columns:
            sums = rows.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("__ref")).agg(made[function]().alias(name))
            df = df.join(sums, df[entity.key.name] == sums["__ref"], "left").drop("__ref")
        empty = {"count": F.lit(0), "avg": F.lit(0.0), "sum": F.lit(0), "all_equal": F.lit(True)}.get(function)
        found = F.col(f"`{name}`")
        return df, Value(found if empty is None else F.coalesce(found, empty), kind)

    def compiled(self, entity: Entity, df: DataFrame, text: str) -> tuple[DataFrame, Value]:
        """df with all joins that an expression needs, and its value."""
        text = own(entity, text)
        paths, calls = names_in(parsed(text))
        found, over = {}, {}
        for p in paths:
            try:
                df, found[p] = self.path(entity, df, p)
            except GenerationError:
                if len(p) > 1:
                    raise
        for function, p in calls:
            if is_collection(self.doc, entity.field(p[0])):
                df, over[function, p] = self.over_children(entity, df, function, p)
            elif p[0] in self.doc.entities and entity.field(p[0]) is None:
                over[function, p] = self.over_entity(function, p)
            else:
                df, found[p] = self.path(entity, df, p)

        def known(p: tuple[str, ...]) -> Value:
            if p not in found:
                raise GenerationError(f"{entity.name}: no field {'.'.join(p)}")
            return found[p]

        return df, Compiler(known, aggregate=lambda function, p: over.get((function, p)), today=self.now.date()).compile(text)

    def derive(self, entity: Entity, df: DataFrame, f: Field) -> DataFrame:
        """df with one field by its default_chain, its compute branches or its expression."""
        if f.default_chain:
            values, when, fallback = [], None, None
            for p in f.default_chain:
                df, v = self.path(entity, df, tuple(p.split(".")))
                values.append(v)
            if f.chain_when:
                df, when = self.compiled(entity, df, f.chain_when)
            if f.fallback is not None:
                df, fallback = self.compiled(entity, df, f.fallback)
            made = default_chain(values, when, fallback)
        elif f.compute:
            branches = []
            for b in f.compute:
                test = None
                if b.when is not None:
                    df, test = self.compiled(entity, df, b.when)
                df, value = self.compiled(entity, df, b.value)
                branches.append((test, value))
            made = compute(branches)
        else:
            df, v = self.compiled(entity, df, f.get("derived").args[0])
            made = v.col
        return df.withColumn(f.name, made.cast(spark_type(f.type)))

    def derive_all(self, entity: Entity, df: DataFrame, left: list[Field]) -> DataFrame:
        """df with derived fields, those first whose inputs in the row are there, else in the order of the document."""
        left = list(left)
        while left:
            names = {f.name for f in left}
            ready = next((f for f in left if not {r.field for r in self.stages.reads.get((entity.name, f.name), ()) if r.local} & (names - {f.name})), None)
            if ready is None:
                raise GenerationError(f"{entity.name}: derived fields refer to each other: " + ", ".join(sorted(names)))
            left.remove(ready)
            df = self.derive(entity, df, ready)
        return df

    def derived(self, entity: Entity, df: DataFrame, attempt: Column) -> DataFrame:
        for f in self.stored(entity):
            if dep := f.get("dependent_required"):
                for name in dep.args:
                    g = entity.field(name)
                    kind = spark_type(g.type)
                    again = self.typed(g.type.items[0] if g.type.kind == "optional" else g.type, g, self.draw(entity.name, name, F.col("_rid"), attempt).sub("again"), entity)
                    df = df.withColumn(name, F.when(F.col(f.name).isNotNull(), F.coalesce(F.col(name), again.cast(kind))).otherwise(F.col(name)))
        df = self.derive_all(entity, df, [f for f in self.stored(entity) if f.is_derived and (entity.name, f.name) not in self.stages.late])
        if entity.has("timestamps"):
            df = df.withColumns({c: F.lit(self.now).cast("timestamp_ntz") for c in ("created_at", "updated_at")})
        if entity.has("soft_delete"):
            df = df.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
        if entity.has("versioned"):
            df = df.withColumn("version", F.lit(1).cast("long"))
        return df

    def columns(self, entity: Entity, *, early: bool = False) -> list[str]:
        """The columns of an entity in order; those that are made with its rows, or all."""
        extra = [c for flag, cs in (("timestamps", ("created_at", "updated_at")), ("soft_delete", ("deleted_at",)), ("versioned", ("version",))) if entity.has(flag) for c in cs]
        names = [f.name for f in self.stored(entity) if not (early and (entity.name, f.name) in self.stages.late)]
        return [*names, *[c for c in extra if c not in names]]

    def rules_of(self, entity: Entity, kind: str) -> list[tuple[int, Rule]]:
        """The rules of a kind that bind while rows are made, with their numbers; those on late fields, or that see to it
        themselves that they hold, are checked at the end."""
        early = lambda i, r: (r.entity, i) not in self.stages.sets and not any(self.stages.waits(entity.name, x) for t in (r.check, r.when) if t for x in text_reads(self.doc, entity, t))
        return [(i, r) for i, r in enumerate(self.doc.rules) if r.entity == entity.name and r.kind == kind and r.mode in ("strict", "probability") and early(i, r)]

    def verdict(self, entity: Entity, df: DataFrame, rule: Rule) -> tuple[DataFrame, Column]:
        """df with all joins that a rule needs, and whether a row keeps it; true where its `when` does not hold."""
        df, check = self.compiled(entity, df, rule.check)
        test = F.coalesce(check.col.cast("boolean"), F.lit(False))
        if rule.when:
            df, when = self.compiled(entity, df, rule.when)
            test = F.when(F.coalesce(when.col.cast("boolean"), F.lit(False)), test).otherwise(F.lit(True))
        return df, test

    def rows_of(self, entity: Entity, left: DataFrame, attempt: int, accepted: DataFrame | None) -> DataFrame:
        """The rows of left at an attempt; unique fields first, apart from the values of the rows that are accepted."""
        rows, number = left, F.lit(attempt)
        for f in self.resolved_unique(entity):
            if (size := self.space(entity, f)) is not None and size < self.rows[entity.name] and not f.has("null_rate", "optional"):
                raise UniquenessExhausted(f"{entity.name}.{f.name}: {self.rows[entity.name]} rows, {size} values")
            make = lambda a, f=f: self.field(entity, f, self.draw(entity.name, f.name, F.col("_rid"), a + F.lit(attempt * UNIQUE_ATTEMPTS)))
            own = self.own_space(entity, f)
            space = self.combinations(entity, {f.name: own}, attempt) if own and own < 1 << 62 else None  # draws do not run out of more
            values = unique_values(left.select("_rid"), make, f.name, taken=None if accepted is None else accepted.select("_rid", f.name), space=space, turn=attempt)
            rows = rows.join(values, "_rid")
        return self.derived(entity, self.plain(entity, rows, number), number)

    def own_space(self, entity: Entity, f: Field) -> int | None:
        """The size of a field's space, if it is drawn from a finite space on its own, so that a row may be given any of the values;
        a field that may be null, hangs on others or is a reference is not."""
        if f.is_derived or f.has("primary", "auto", "null_rate", "optional", "from", "after", "before", "within", "correlated"):
            return None
        if any(f.name in g for _, g in entity.coherence) or (entity.name, f.name) in self.stages.late or spark_type(f.type) not in ("long", "string") or (f.has("pattern") and f.type.name != "string"):
            return None
        if f.type.kind == "named" and any(w <= 0 for _, w in self.doc.enums.get(f.type.name, ())):
            return None
        size = self.space(entity, f)
        return None if size is None or size < 1 else size

    def combined(self, entity: Entity, rule: Rule) -> dict[str, int] | None:
        """The fields that a unique rule names, with the sizes of their spaces, if each has a finite space of its own."""
        found = {}
        for path in fields_of(rule.check):
            f = entity.field(path[-1]) if len(path) == 2 else None
            if f is None or f.has("unique") or (f is entity.key and self.referred_to(entity)):
                return None
            size = self.own_space(entity, f)
            if size is None:
                return None
            found[f.name] = size
        return found or None

    def combinations(self, entity: Entity, sizes: dict[str, int], turn: int) -> DataFrame:
        """Combinations of values of the fields in sizes: as many as the entity has rows (DEALT, if those are fewer), or all. The next
        turn gives the next ones."""
        size = prod(sizes.values())
        window = min(size, max(self.rows[entity.name], DEALT))
        index = (F.col("id") + turn * window % size) % size
        places = self.spark.range(window).select(spread(self.draw(entity.name, "", index), size).alias("__place"))
        values, below = [], 1
        for name, n in sizes.items():
            values.append(self.value_at(entity.field(name), F.call_function("div", F.col("__place"), F.lit(below).cast("long")) % n).alias(name))
            below *= n
        return places.select(*values).distinct()

    def dealt(self, entity: Entity, left: DataFrame, accepted: DataFrame, sizes: dict[str, int], rules: list[Rule], turn: int) -> DataFrame:
        """left with values of the fields in sizes: each row gets a combination of its own that no accepted row has, or nulls if none
        is left. Strict rules that read nothing else sort combinations out beforehand.

        A turn looks at as many combinations as the entity has rows (at DEALT, if those are fewer), the next turn at the next ones.
        Accepted rows and those left are as many together, so there is one for each row unless rules sort it out."""
        cells = self.combinations(entity, sizes, turn).join(accepted.select(*sizes), list(sizes), "left_anti")
        for r in rules:
            reads = [x for text in (r.check, r.when) if text for x in text_reads(self.doc, entity, text)]
            if r.mode == "strict" and all(x.local and x.field in sizes for x in reads):
                cells, test = self.verdict(entity, cells, r)
                cells = cells.where(test)
        mixed = numbered(cells.select(*sizes), [F.xxhash64(F.lit(turn), *sizes), *sizes], "__n")
        return numbered(left, ["_rid"], "__n").join(mixed, "__n", "left").select(*left.columns, *sizes)

    def make(self, entity: Entity) -> DataFrame:
        """All rows of an entity. Rows that break a rule on rows or repeat what `unique(...)` names are made again, with the
        next attempt; the others stay as they are. Rows that no attempt settles are dealt combinations that are still free."""
        self.count_children(entity)
        _, left = self.owners.get(entity.name) or ("", self.spark.range(self.rows[entity.name]).select(F.col("id").alias("_rid")))
        columns, numbers = self.columns(entity, early=True), left.columns
        rules, sets = self.rules_of(entity, "row"), self.rules_of(entity, "unique")
        if not rules and not sets:
            return self.keyed(entity, self.rows_of(entity, left, 0, None).select("_rid", *columns), own=True)
        accepted, spaces = None, []
        for _, r in sets:
            if r.mode == "strict" and (sizes := self.combined(entity, r)):
                spaces.append(sizes)
                if self.rows[entity.name] > prod(sizes.values()):
                    raise ConstraintViolation(f"{entity.name}: {self.rows[entity.name]} rows, {prod(sizes.values())} combinations: {r.error or r.check}")
        tight = min(spaces, key=lambda s: prod(s.values()), default=None)
        if tight and prod(tight.values()) >= 1 << 62:  # places are whole numbers of 64 bits; draws do not run out of so many
            tight = None
        for attempt in range(RULE_ATTEMPTS + 1 + (RULE_ATTEMPTS if tight else 0)):
            if attempt <= RULE_ATTEMPTS:
                df, ok = self.rows_of(entity, left, attempt, accepted), F.lit(True)
            else:
                dealt = self.dealt(entity, left, accepted, tight, [r for _, r in rules], attempt - RULE_ATTEMPTS - 1)
                df, ok = self.rows_of(entity, dealt, attempt, accepted), F.col(next(iter(tight))).isNotNull()
            for i, r in rules:
                df, test = self.verdict(entity, df, r)
                if r.mode == "probability":
                    test = test | ~self.draw(entity.name, f"rule{i}", F.col("_rid")).chance(r.probability, "bind")
                ok = ok & test
            df = written(df.select(*numbers, *columns, ok.alias("__ok")), f"gen-{entity.name}")
            good = df.where("__ok").select("_rid", *columns)
            for i, r in sets:
                free = ~self.draw(entity.name, f"rule{i}", F.col("_rid")).chance(r.probability, "bind") if r.mode == "probability" else F.lit(False)
                good = first_of_each(good, [p[-1] for p in fields_of(r.check)], accepted, free)
            if sets:
                good = written(good, f"gen-{entity.name}")
            accepted = good if accepted is None else accepted.unionByName(good)
            left = df.select(*numbers).join(good.select("_rid"), "_rid", "left_anti") if sets else df.where("NOT __ok").select(*numbers)
            if left.isEmpty():
                return self.keyed(entity, accepted, own=True)
        broken = "; ".join(r.error or r.check for _, r in [*rules, *sets])
        raise ConstraintViolation(f"{entity.name}: rows still break a rule after {attempt} attempts: {broken}")

    def counts(self, child: Entity) -> list[tuple[Entity, str, int, int | None, float]]:
        """(parent, reference, least, most, share) for each collection of an entity that says how many children there are, by
        @count or a rule on the count; the rule binds a share of the parents."""
        out = []
        for parent in self.doc.entities.values():
            for f in parent.fields:
                if f.type.kind != "list" or not is_collection(self.doc, f) or child_of(self.doc, parent, f.name)[0] is not child:
                    continue
                low, high, share = (*length_of(f), 1.0) if length_of(f) else (None, None, 1.0)
                for r in self.doc.rules:
                    if r.kind == "count" and r.entity == parent.name and r.mode != "warn":
                        path, a, b = count_bounds(r.check)
                        if path[-1] == f.name:
                            share = r.probability if r.mode == "probability" and low is None else share
                            low, high = max(low or 0, a or 0), b if high is None else high if b is None else min(b, high)
                if low is None:
                    continue
                if high is not None and low > high:
                    raise GenerationError(f"{parent.name}.{f.name}: no number is in {low}..{high}")
                if low or high is not None:
                    out.append((parent, child_of(self.doc, parent, f.name)[1], low, high, share))
        return out

    def count_children(self, entity: Entity) -> None:
        """How an entity's rows are dealt to parents that say how many children they have.

        If nothing says how many rows there are, each parent draws its number; a running sum over the parents gives each of them
        its children's row numbers, so children are made from parents. Otherwise row numbers are spread and cut evenly.
        """
        for parent, ref, low, high, share in self.counts(entity):
            n, parents = self.rows[entity.name], self.rows[parent.name]
            if entity.name not in self.fixed and entity.name not in self.owners:
                most = low + SPAN if high is None else high
                d = self.draw(parent.name, f"children:{entity.name}.{ref}", F.col("_rid"))
                drawn = d.integer(low, most, "n")
                if share < 1:
                    drawn = F.when(d.chance(share, "bind"), drawn).otherwise(d.integer(0, 2 * most, "free"))
                rows, total = running_sum(self.spark.range(parents).select(F.col("id").alias("_rid")).withColumn("__n", drawn), ["_rid"], F.col("__n"), "__from")
                made = rows.where("__n > 0").select(F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("__n") - 1)).alias("__rid"), F.col("_rid").alias("__parent"))
                self.owners[entity.name], self.rows[entity.name] = (ref, made.withColumnRenamed("__rid", "_rid")), total
            elif low * parents <= n and (high is None or n <= high * parents):
                self.even.add((entity.name, ref))
            elif share == 1:
                raise ConstraintViolation(f"{entity.name}: {n} rows cannot give each of {parents} rows of {parent.name} from {low} to {'any number' if high is None else high}")

    def shared(self, rule: Rule) -> None:
        """A rule `sum(E.children.f) == total`: f of the children becomes their share of the total, in proportion to what it was."""
        entity = self.doc.entities[rule.entity]
        collection, name, text = share_rule(self.doc, rule)
        child, ref = child_of(self.doc, entity, collection)
        df, total = self.compiled(entity, self.made(entity.name), text)
        rows = self.made(child.name)
        kind = spark_type(child.field(name).type)
        unit = F.lit(10 ** (int(m[1]) if (m := re.search(r",(\d+)", kind)) else 0 if kind in ("long", "int", "smallint", "tinyint") else 2))
        scaled = lambda x: F.round(x * unit).cast("long")
        sums = df.select(F.col(entity.key.name).alias("__parent"), F.coalesce(scaled(total.col), F.lit(0)).alias("__sum"))
        met = rows.join(sums, F.col(ref) == F.col("__parent"))
        met = apportioned(met, ref, F.greatest(scaled(F.col(name)), F.lit(0)), F.col("__sum"), "__new")
        met = met.withColumn(name, (F.col("__new") / unit).cast(kind)).select(*rows.columns)
        self.frames[child.name] = written(met.unionByName(rows.where(F.col(ref).isNull())), f"gen-{child.name}")

    def crossed(self, rule: Rule, number: int) -> None:
        """A rule across rows: groups of two rows or more that do not agree get, with the rule's probability, what `set` says;
        in the rows of the group itself or in the row of the parent by whose key they are grouped."""
        entity, df = self.doc.entities[rule.entity], self.made(rule.entity)
        columns = {c: Value(F.col(f"`{c}`"), kind_of(df.schema[c].dataType)) for c in df.columns}
        group = columns[rule.group_by] if rule.group_by else Value(F.lit("all"), "str")
        chosen = Draw(self.seed, rule.entity, f"rule{number}", F.col("group")).chance(rule.probability, "bind")
        hit = cross_row(df, group, rule.check, columns).where(~F.col("ok") & chosen).select(F.col("group").alias("__group"))
        for path, text in rule.set_values:
            name, field_name = path.split(".")
            target = self.doc.entities.get(name)
            if target is None or field_name not in self.made(name).columns:
                raise GenerationError(f"a rule across rows sets unknown field {path}")
            rows = self.made(name)
            key = group if target is entity else Value(F.col(target.key.name), kind_of(rows.schema[target.key.name].dataType))
            value = Compiler(columns_of(rows.schema), today=self.now.date()).compile(text).col.cast(rows.schema[field_name].dataType)
            met = rows.join(hit, display(key) == hit["__group"], "left").withColumn(field_name, F.when(F.col("__group").isNotNull(), value).otherwise(F.col(field_name)))
            self.frames[name] = met.select(*rows.columns)

    def links(self, entity: Entity) -> None:
        """A bridge table `Entity.field` for each many-to-many field."""
        for f in entity.fields:
            if f.type.kind == "ref" and f.type.many:
                low, high = length_of(f) or (0, 4)
                target = self.doc.entities[f.type.name]
                rows = self.spark.range(self.rows[entity.name]).select(F.col("id").alias("_rid"))
                b = bridge(rows, self.draw(entity.name, f.name, F.col("_rid")), self.rows[target.name], low, high)
                for side, e in (("left", entity), ("right", target)):
                    if self.late_key(e):
                        b = with_keys(b, side, self.made(e.name).select(F.col("_rid").alias("__at"), F.col(e.key.name).alias("__key")))
                    else:
                        b = b.withColumn(side, self.key(e, F.col(side)))
                self.bridges[f"{entity.name}.{f.name}"] = b.select(F.col("left").alias(f"{entity.name}_id".lower()), F.col("right").alias(f"{target.name}_id".lower()))

    def run(self, only: set[str] | None = None) -> dict[str, DataFrame]:
        wanted = set(self.doc.entities) if only is None else only
        needed = self.stages.needed(wanted, lambda e: closure(self.doc, e))
        for name in entity_order(self.doc):
            if name in needed:
                self.frames[name] = self.make(self.doc.entities[name])
        self.staged()
        self.check()
        for n in wanted:
            self.links(self.doc.entities[n])
        return {n: self.described(self.doc.entities[n], self.frames[n].drop("_rid")) for n in self.doc.entities if n in wanted} | self.bridges

    def staged(self) -> None:
        """Late fields and the rules that set fields, stage by stage. A stage sees what the stages before left; a table that
        later ones may read is written, so that each stage is planned and run once."""
        last = max(self.stages.stage.values(), default=0)
        for k in range(1, last + 1):
            nodes = [n for n, at in self.stages.stage.items() if at == k and (n[0] in self.frames)]
            before = dict(self.frames)
            made = {}
            for name in dict.fromkeys(e for e, n in nodes if isinstance(n, str)):
                entity, df = self.doc.entities[name], before[name]
                fields = [entity.field(n) for e, n in nodes if e == name and isinstance(n, str)]
                for f in [f for f in fields if not f.is_derived]:
                    df = self.temporal(entity, self.base(entity, df, f), F.lit(0), f)
                df = self.derive_all(entity, df, [f for f in fields if f.is_derived])
                kept = [c for c in self.columns(entity) if c in df.columns]
                made[name] = df.select("_rid", *kept)
                if k < last or self.late_rules():
                    made[name] = written(made[name], f"gen-{name}")
            self.frames |= made
            for _, i in sorted((n for n in nodes if isinstance(n[1], int)), key=lambda n: n[1]):
                rule = self.doc.rules[i]
                if all(e in self.frames for e, _ in self.stages.sets[rule.entity, i]):
                    self.crossed(rule, i) if rule.kind == "cross_row" else self.shared(rule)
        for n in self.frames:
            self.frames[n] = self.frames[n].select("_rid", *self.columns(self.doc.entities[n]))

    def base(self, entity: Entity, df: DataFrame, f: Field) -> DataFrame:
        """df with a moment that is late only by what it comes after or before."""
        return df.withColumn(f.name, self.field(entity, f, self.draw(entity.name, f.name, F.col("_rid"))))

    def described(self, entity: Entity, df: DataFrame) -> DataFrame:
        """df with what the document says of its fields (label, description, decorators without an effect on values) as the
        columns' metadata."""
        def told(name: str) -> dict:
            f = entity.field(name)
            if f is None:
                return {}
            dated = self.doc.generation.get("date_format", "iso8601") if spark_type(f.type) in ("date", "timestamp_ntz") else "iso8601"
            found = {"primary": f.has("primary"), "date_format": None if dated == "iso8601" else dated, "label": f.label, "description": f.description, "decorators": [d.name for d in f.decorators if d.name in DESCRIBING]}
            return {k: v for k, v in found.items() if v}

        return df.select(*[F.col(c).alias(c, metadata=m) if (m := told(c)) else F.col(c) for c in df.columns])

    def broken(self, rule: Rule) -> DataFrame:
        """The rows (of a unique rule the groups, of a count rule the parents) that break a rule; across rows: the groups."""
        entity, df = self.doc.entities[rule.entity], self.made(rule.entity)
        if rule.kind == "unique":
            return duplicates(df, [p[-1] for p in fields_of(rule.check)])
        if rule.kind == "count":
            path, low, high = count_bounds(rule.check)
            child, ref = child_of(self.doc, entity, path[-1])
            return cardinality(df, self.made(child.name), entity.key.name, ref, low, high)
        if rule.kind == "cross_row":
            columns = {c: Value(F.col(f"`{c}`"), kind_of(df.schema[c].dataType)) for c in df.columns}
            return cross_row(df, columns[rule.group_by] if rule.group_by else Value(F.lit("all"), "str"), rule.check, columns).where("NOT ok")
        df, ok = self.verdict(entity, df, rule)
        return df.where(~ok)

    def late_rules(self) -> list[Rule]:
        """Strict rules that bind once all fields are there."""
        bound = {i for e in self.frames for kind in ("row", "unique") for i, _ in self.rules_of(self.doc.entities[e], kind)}
        return [r for i, r in enumerate(self.doc.rules) if r.mode == "strict" and r.kind in ("row", "unique", "count") and i not in bound and r.entity in self.frames]

    def check(self) -> None:
        for r in self.late_rules():
            if all(e in self.frames for e in self.read_by(r)) and not self.broken(r).isEmpty():
                raise ConstraintViolation(f"{r.entity}: {r.error or r.check}")

    def read_by(self, rule: Rule) -> set[str]:
        entity = self.doc.entities[rule.entity]
        if rule.kind == "count":
            return {rule.entity, child_of(self.doc, entity, count_bounds(rule.check)[0][-1])[0].name}
        return {rule.entity} | {x.entity for t in (rule.check, rule.when) if t for x in text_reads(self.doc, entity, t)}


def lists_for(spark: SparkSession, doc: Document, folder: str) -> dict[str, DataFrame]:
    """The prepared lists of a folder that the document's semantic types may draw from."""
    types = {t.name for e in doc.entities.values() for f in e.fields for t in (f.type, *f.type.items) if isinstance(t, Type) and t.kind == "semantic"}
    names = {"cities"} | {n for t in types for n in (LISTED.get(t, ("",))[0], t, t.replace(".", "_"), t.partition(".")[0]) if n}
    return prepared_lists(spark, folder, sorted(names))


def generate(
    spark: SparkSession, doc: Document, *, seed: int | None = None, volume: dict[str, int] | None = None, entity: str | None = None, now: datetime = NOW, lists: str | dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """The entities of doc (or one of them with all that it refers to), by name, in the document's order. Semantic types draw from
    `lists` (prepared lists by name, or the folder where they are) where a list fits them (`operators.dimensions.list_of`)."""
    g = Generator(spark, doc, doc.seed if seed is None else seed, volumes(doc, volume), now, fixed={*doc.volume, *(volume or {})}, lists=lists_for(spark, doc, lists) if isinstance(lists, str) else dict(lists or {}))
    return g.run(closure(doc, entity) if entity else None)


def warnings(data: dict[str, DataFrame], doc: Document) -> dict[str, int]:
    """How many rows (groups, parents) break each warn rule; rules that need rows' numbers count nothing."""
    frames = {n: df for n, df in data.items() if n in doc.entities}
    g = Generator(next(iter(data.values())).sparkSession, doc, doc.seed, volumes(doc), frames=frames)
    return {r.check: g.broken(r).count() for r in doc.rules if r.mode == "warn" and r.entity in frames}
