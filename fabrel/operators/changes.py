"""Create, update and delete as transitions of tables: change sets, referential actions, triggers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, ValidationError
from ..model import Document, Entity, Field
from ..plans.generate import NOW, Generator, spark_type
from ..plans.order import volumes
from ..plans.stages import child_of, is_collection, text_reads
from ..storage import written
from .tools import infer
from .totals import numbered

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Change:
    """rows of a kind: `create` (values of new rows), `update` (keys and the values to set) or `delete` (keys)."""

    entity: str
    kind: str
    rows: DataFrame


def apply_changes(tables: Tables, doc: Document, changes: Sequence[Change], *, now: datetime = NOW) -> Tables:
    """The tables after changes, one change set after the other; tables given stay as they are.

    Entities allow what `tools.infer` says. A hard delete is closed over the references to what goes: `@cascade` takes the
    referring rows along, `@set_null` clears the reference, `@restrict` forbids it; without any of them an optional
    reference is cleared and another forbids. Links of many-to-many bridges (`Entity.field`) go with either side. Triggers
    of changed fields compute their fields anew for the touched rows only, those of parents (`on: collection.field`) for
    the parents of touched rows, and so on; what they validate is checked by the rules that read it.
    """
    state = dict(tables)
    for c in changes:
        if c.entity not in doc.entities:
            raise ValidationError(f"unknown entity: {c.entity}")
        entity = doc.entities[c.entity]
        if c.kind not in infer(doc, entity).operations or c.kind not in ("create", "update", "delete"):
            raise ValidationError(f"{c.entity} has no {c.kind}")
        {"create": _create, "update": _update, "delete": _delete}[c.kind](state, doc, entity, c.rows, now)
    return state


def _once(rows: DataFrame, key: str, what: str) -> None:
    if not rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ConstraintViolation(f"{what}: a key comes more than once")


def _references(doc: Document, entity: Entity) -> list[tuple[Entity, Field]]:
    """The single reference fields of all entities that lead to an entity."""
    return [(e, f) for e in doc.entities.values() for f in e.fields if f.type.kind == "ref" and not f.type.many and (f.type.name == entity.name or (f.type.name == "self" and e is entity))]


def _action(f: Field) -> str:
    return next((a for a in ("cascade", "restrict", "set_null") if f.has(a)), "set_null" if f.type.optional else "restrict")


def _create(state: Tables, doc: Document, entity: Entity, rows: DataFrame, now: datetime) -> None:
    tools, old, key = infer(doc, entity), state[entity.name], entity.key.name
    if missing := [n for n in tools.required if n not in rows.columns and n in old.columns and n != key]:
        raise ValidationError(f"{entity.name}: {', '.join(missing)} must be given")
    if odd := [n for n in rows.columns if n != key and n not in (*tools.required, *tools.optional)]:
        raise ValidationError(f"{entity.name}: {', '.join(odd)} cannot be given")
    if key not in rows.columns:
        if spark_type(entity.key.type) not in ("long", "int", "smallint", "tinyint"):
            raise ValidationError(f"{entity.name}: keys must be given")
        top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("x")).scalar()  # one value
        rows = numbered(rows, rows.columns, "__place").withColumn(key, (top + 1 + F.col("__place")).cast(old.schema[key].dataType)).drop("__place")
    stamps = {"created_at": F.lit(now).cast("timestamp_ntz"), "updated_at": F.lit(now).cast("timestamp_ntz"), "version": F.lit(1)}
    made = []
    for c in old.columns:
        f = entity.field(c)
        given = F.lit(tools.defaults[c]) if c in tools.defaults else F.lit(f.get("default").args[0]) if f and f.has("default") else stamps.get(c, F.lit(None))
        made.append((F.col(f"`{c}`") if c in rows.columns else given).cast(old.schema[c].dataType).alias(c))
    new = written(rows.select(*made), f"create-{entity.name}")
    _once(new, key, f"create {entity.name}")
    if not new.join(old.select(key), key, "left_semi").isEmpty():
        raise ConstraintViolation(f"create {entity.name}: a key is there already")
    g = _generator(state, doc)
    filled = g.derive_all(entity, new, [f for f in g.stored(entity) if f.is_derived and f.name in old.columns])
    state[entity.name] = old.unionByName(filled.select(*old.columns))
    _settle(state, doc, entity, new.select(key), set(old.columns), new, now)


def _update(state: Tables, doc: Document, entity: Entity, rows: DataFrame, now: datetime) -> None:
    tools, old, key = infer(doc, entity), state[entity.name], entity.key.name
    names = [c for c in rows.columns if c != key]
    if odd := [n for n in names if n not in tools.mutable]:
        raise ValidationError(f"{entity.name}: {', '.join(odd)} cannot be changed")
    rows = written(rows, f"update-{entity.name}")
    _once(rows, key, f"update {entity.name}")
    given = rows.select(F.col(key).alias("__key"), *[F.col(f"`{n}`").cast(old.schema[n].dataType).alias(f"__new_{n}") for n in names])
    met = old.join(given, old[key] == given["__key"])
    differs = F.lit(False)
    for n in names:
        differs = differs | ~F.col(n).eqNullSafe(F.col(f"__new_{n}"))
    before = written(met.where(differs).select(*old.columns, *[f"__new_{n}" for n in names]), f"update-{entity.name}")
    stamps = {"updated_at": F.lit(now).cast("timestamp_ntz"), "version": F.col("version") + 1} if names else {}
    after = before.withColumns({n: F.col(f"__new_{n}") for n in names} | {c: x for c, x in stamps.items() if c in old.columns and c not in names})
    state[entity.name] = old.join(before.select(key), key, "left_anti").unionByName(after.select(*old.columns))
    _settle(state, doc, entity, before.select(key), set(names), before.unionByName(after, allowMissingColumns=True), now)


def _delete(state: Tables, doc: Document, entity: Entity, rows: DataFrame, now: datetime) -> None:
    key = entity.key.name
    keys = rows.select(key).distinct()
    old = state[entity.name]
    if infer(doc, entity).delete == "soft" and "deleted_at" in old.columns:
        hit = keys.select(F.col(key).alias("__key"))
        met = old.join(hit, old[key] == hit["__key"], "left")
        gone = F.when(F.col("__key").isNotNull(), F.coalesce("deleted_at", F.lit(now).cast("timestamp_ntz"))).otherwise(F.col("deleted_at"))
        state[entity.name] = met.withColumn("deleted_at", gone).drop("__key")
        return
    went = closure_of(state, doc, entity, keys)
    for name, gone in went.items():
        for child, f in _references(doc, doc.entities[name]):
            if child.name not in state or _action(f) == "cascade":
                continue
            table, ref = state[child.name], gone.select(F.col(doc.entities[name].key.name).alias("__gone"))
            left = table.join(went[child.name], child.key.name, "left_anti") if child.name in went else table
            if _action(f) == "restrict":
                if not left.join(ref, left[f.name] == ref["__gone"], "left_semi").isEmpty():
                    raise ConstraintViolation(f"delete {entity.name}: rows of {child.name} refer to it by {f.name}")
            else:
                met = table.join(ref, table[f.name] == ref["__gone"], "left")
                state[child.name] = met.withColumn(f.name, F.when(F.col("__gone").isNull(), F.col(f.name))).drop("__gone").select(*table.columns)
    for name, gone in went.items():
        table, own = state[name], doc.entities[name].key.name
        lost = table.join(gone, own, "left_semi")
        state[name] = table.join(gone, own, "left_anti")
        for bridge in [b for b in state if "." in b]:
            left, f = bridge.split(".")
            for side, at in zip(state[bridge].columns, (left, doc.entities[left].field(f).type.name), strict=True):
                if at == name:
                    state[bridge] = state[bridge].join(gone.select(F.col(own).alias(side)), side, "left_anti")
        _parents(state, doc, doc.entities[name], set(table.columns), lost, now, {})


def closure_of(state: Tables, doc: Document, entity: Entity, keys: DataFrame) -> dict[str, DataFrame]:
    """The keys that a delete takes, by entity: those given, then by semi-joins, round after round, those of rows that refer to
    what a round before took by a `@cascade` reference. Each round reads its new keys only, from a written table."""
    there = state[entity.name].select(entity.key.name)
    went = {entity.name: written(there.join(keys, entity.key.name, "left_semi"), f"gone-{entity.name}")}
    new = dict(went)
    while new:
        found: dict[str, DataFrame] = {}
        for name, gone in new.items():
            target = doc.entities[name]
            for child, f in _references(doc, target):
                if child.name in state and _action(f) == "cascade":
                    rows = state[child.name].select(F.col(child.key.name), F.col(f.name).alias("__ref"))
                    hit = rows.join(gone.select(F.col(target.key.name).alias("__ref")), "__ref", "left_semi").select(child.key.name)
                    found[child.name] = hit if child.name not in found else found[child.name].unionByName(hit)
        new = {}
        for name, hit in found.items():
            key = doc.entities[name].key.name
            hit = hit.distinct() if name not in went else hit.distinct().join(went[name], key, "left_anti")
            hit = written(hit, f"gone-{name}")
            if not hit.isEmpty():
                new[name] = hit
                went[name] = hit if name not in went else went[name].unionByName(hit)
    return went


def _generator(state: Tables, doc: Document) -> Generator:
    spark = next(iter(state.values())).sparkSession
    return Generator(spark, doc, doc.seed, volumes(doc), frames={n: df for n, df in state.items() if n in doc.entities})


def _stale(entity: Entity, changed: set[str]) -> tuple[list[str], set[str]]:
    """The fields that changes make stale, by triggers and the triggers of what these compute, and what they validate."""
    stale: list[str] = []
    checked: set[str] = set()
    todo, seen = list(changed), set()
    while todo:
        name = todo.pop()
        for i, t in enumerate(entity.triggers):
            if t.on == name and i not in seen:
                seen.add(i)
                checked |= set(t.validate)
                more = [n for n in t.recompute if n not in stale]
                stale += more
                todo += more
    return stale, checked


def _settle(state: Tables, doc: Document, entity: Entity, touched: DataFrame, changed: set[str], rows: DataFrame, now: datetime, done: dict | None = None) -> None:
    """Triggers of an entity's touched rows (keys), then those of their parents. rows: touched ones as they were and are."""
    done = {} if done is None else done
    stale, checked = _stale(entity, changed)
    fields = [f for f in entity.fields if f.name in stale and f.is_derived and f.name in state[entity.name].columns]
    if fields or checked:
        table, key = state[entity.name], entity.key.name
        g = _generator(state, doc)
        part = table.join(touched, key, "left_semi")
        part = g.derive_all(entity, part, fields).select(*table.columns) if fields else part
        part = written(part, f"touched-{entity.name}")
        for r in doc.rules:
            if r.entity == entity.name and r.kind == "row" and r.mode == "strict" and checked & {x.field for t in (r.check, r.when) if t for x in text_reads(doc, entity, t) if x.local}:
                seen, ok = g.verdict(entity, part, r)
                if not seen.where(~ok).isEmpty():
                    raise ConstraintViolation(f"{entity.name}: {r.error or r.check}")
        if fields:
            state[entity.name] = table.join(touched, key, "left_anti").unionByName(part)
            rows = rows.unionByName(part, allowMissingColumns=True)
    _parents(state, doc, entity, changed | {f.name for f in fields}, rows, now, done)


def _parents(state: Tables, doc: Document, entity: Entity, changed: set[str], rows: DataFrame, now: datetime, done: dict) -> None:
    for parent in doc.entities.values():
        for t in parent.triggers:
            collection, _, name = t.on.partition(".")
            if parent.name not in state or not is_collection(doc, parent.field(collection)) or (parent.name, t.on) in done:
                continue
            child, ref = child_of(doc, parent, collection)
            if child is not entity or (name and name not in changed and ref not in changed):
                continue
            done[parent.name, t.on] = True
            touched = written(rows.select(F.col(ref).alias(parent.key.name)).where(F.col(parent.key.name).isNotNull()).distinct(), f"touched-{parent.name}")
            _settle(state, doc, parent, touched, {t.on}, state[parent.name].join(touched, parent.key.name, "left_semi"), now, done)
