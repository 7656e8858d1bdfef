"""List tools of an entity, inferred from its declaration and run as queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Document, Entity, Field

PAGE = 25


@dataclass
class Tools:
    """What can be done with an entity."""

    entity: str
    operations: list[str]
    filters: list[str] = field(default_factory=list)
    sorts: list[str] = field(default_factory=list)
    search: list[str] = field(default_factory=list)
    page: int = PAGE
    max_page: int | None = None
    defaults: dict[str, Any] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    mutable: list[str] = field(default_factory=list)
    delete: str | None = None
    children: list[tuple[str, str]] = field(default_factory=list)


def _is_date(f: Field) -> bool:
    t = f.type.items[0] if f.type.kind == "optional" else f.type
    return t.kind == "prim" and t.name in ("date", "datetime")


def _base(f: Field) -> str:
    t = f.type.items[0] if f.type.kind == "optional" else f.type
    return t.name if t.kind == "prim" else t.kind


def infer(doc: Document, entity: Entity) -> Tools:
    """Tools from types and decorators; the document's `tools` section overrides single entries."""
    readonly = entity.has("readonly")
    immutable = readonly or entity.has("immutable")
    operations = ["list", "get"] + ["create"] * (not readonly) + ["update"] * (not immutable) + ["delete"] * (not immutable and not entity.has("no_delete"))
    page = next((int(d.args[0]) for d in entity.meta if d.name == "paginated" and d.args), PAGE)
    t = Tools(entity.name, operations, page=page, delete=("soft" if entity.has("soft_delete") else "hard") if "delete" in operations else None)
    for f in entity.fields:
        if f.has("write_only"):
            pass
        else:
            kind = _base(f)
            if f.has("filterable", "index") or kind in ("enum", "ref", "bool") or (kind == "named" and f.type.name in doc.enums) or _is_date(f):
                t.filters += [f.name, f"{f.name}_after", f"{f.name}_before"] if _is_date(f) else [f.name]
            if f.has("sortable", "primary") or _is_date(f) or (f.has("index") and kind in ("int", "float", "decimal")):
                t.sorts.append(f.name)
            if f.has("searchable"):
                t.search.append(f.name)
        if f.has("auto", "primary") or f.is_derived:
            continue
        (t.optional if f.type.kind == "optional" or f.type.optional or f.has("default", "optional") else t.required).append(f.name)
        if not f.has("immutable"):
            t.mutable.append(f.name)
    t.children = [(e.name, f.name) for e in doc.entities.values() for f in e.fields if f.type.kind == "ref" and f.type.name == entity.name]
    for key, value in (doc.tools.get(entity.name) or {}).items():
        spec = value if isinstance(value, dict) else {}
        if value in (False, "disabled") or spec.get("strategy") == "disabled":
            t.operations = [o for o in t.operations if o != key]
            t.delete = None if key == "delete" else t.delete
        elif key == "list":
            t.filters, t.sorts, t.search = list(spec.get("filters", t.filters)), list(spec.get("sorts", spec.get("sort", t.sorts))), list(spec.get("search", t.search))
            t.page, t.max_page = int(spec.get("page_size", t.page)), spec.get("max_page_size")
        elif key == "create":
            t.defaults = dict(spec.get("defaults", {}))
            t.required = [n for n in spec.get("required", t.required) if n not in t.defaults]
            known = [*t.optional, *t.defaults, *(n for n in t.mutable if n not in t.required)]
            t.optional = [n for n in dict.fromkeys(spec.get("optional", known)) if n not in t.required] + [n for n in t.defaults if n not in spec.get("optional", known)]
        elif key == "update":
            t.mutable = [n for n in spec.get("mutable", t.mutable) if n not in spec.get("immutable", ())]
        elif key == "delete":
            t.delete = spec.get("strategy", t.delete)
    return t


def condition(filters: Mapping[str, Any], columns: Sequence[str]) -> Column:
    """Equality, or after / before for `<date>_after` and `<date>_before`."""
    out = F.lit(True)
    for name, value in filters.items():
        if name in columns:
            out = out & F.col(name).eqNullSafe(F.lit(value))
        elif name.endswith("_after") and name.removesuffix("_after") in columns:
            out = out & (F.col(name.removesuffix("_after")) > F.lit(value))
        elif name.endswith("_before") and name.removesuffix("_before") in columns:
            out = out & (F.col(name.removesuffix("_before")) < F.lit(value))
        else:
            raise ValueError(f"no such filter: {name}")
    return out


def searched(text: str, columns: Sequence[str]) -> Column:
    """Whether one of the columns holds the text, whatever its case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return out


def list_rows(df: DataFrame, key: str, *, filters: Mapping[str, Any] | None = None, search: tuple[str, Sequence[str]] | None = None, sort: Sequence[tuple[str, bool]] = (), page: int = 1, size: int = PAGE, hidden: Sequence[str] = ()) -> DataFrame:
    """A page of the rows that pass filters and search, in order of sort ((column, descending)), then of the key."""
    out = df.where(condition(filters or {}, df.columns))
    if search:
        out = out.where(searched(*search))
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in sort]
    return out.orderBy(*order, F.col(key)).offset((page - 1) * size).limit(size).drop(*hidden)


def get_row(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def children_of(child: DataFrame, ref: str, value: Any) -> DataFrame:
    return child.where(F.col(ref) == F.lit(value))


def link(bridge: DataFrame, left: Any, right: Any) -> DataFrame:
    """A many-to-many bridge (its first two columns) with one more link; a link that is there stays one."""
    one = bridge.sparkSession.range(1).select(*[F.lit(v).cast(bridge.schema[c].dataType).alias(c) for c, v in zip(bridge.columns, (left, right), strict=True)])
    return unlink(bridge, left, right).unionByName(one)


def unlink(bridge: DataFrame, left: Any, right: Any) -> DataFrame:
    a, b = bridge.columns
    return bridge.where(~(F.col(a).eqNullSafe(F.lit(left)) & F.col(b).eqNullSafe(F.lit(right))))


def masked(df: DataFrame, entity: Entity) -> DataFrame:
    """df without hidden and write-only fields, and with sensitive ones masked."""
    out = df.drop(*[f.name for f in entity.fields if f.has("hidden", "write_only")])
    return out.withColumns({f.name: F.when(F.col(f.name).isNotNull(), F.lit("***")) for f in entity.fields if f.has("sensitive") and f.name in out.columns})


def recompute(trigger_on: Sequence[str], entity: Entity) -> list[str]:
    """The fields that a change of the given ones makes stale."""
    return list(dict.fromkeys(n for t in entity.triggers if t.on in trigger_on for n in t.recompute))
