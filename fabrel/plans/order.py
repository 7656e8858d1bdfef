"""Which entities come first, and which are needed at all."""

from __future__ import annotations

from ..errors import CycleError, ValidationError
from ..model import Document, Entity, Type

DEFAULT_VOLUME = 100


def targets(t: Type) -> list[str]:
    if t.kind == "ref":
        return [t.name]
    return [x for i in t.items if isinstance(i, Type) for x in targets(i)] if t.kind in ("poly", "optional", "list") else []


def parents(entity: Entity) -> set[str]:
    """The other entities that a row of this one refers to; many-to-many targets too."""
    return {n for f in entity.fields for n in targets(f.type) if n not in ("self", entity.name)}


def entity_order(doc: Document) -> list[str]:
    """Parents before children, else as in the document."""
    left, out = dict.fromkeys(doc.entities), []
    while left:
        ready = next((n for n in left if not parents(doc.entities[n]) & left.keys()), None)
        if ready is None:
            raise CycleError("entities refer to each other: " + ", ".join(left))
        out.append(ready)
        del left[ready]
    return out


def closure(doc: Document, entity: str) -> set[str]:
    """An entity and all that it refers to, directly or not."""
    if entity not in doc.entities:
        raise ValidationError(f"unknown entity: {entity}")
    seen, todo = set(), [entity]
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo += parents(doc.entities[name])
    return seen


def volumes(doc: Document, override: dict[str, int] | None = None) -> dict[str, int]:
    out = {n: doc.volume.get(n, DEFAULT_VOLUME) for n in doc.entities}
    for name, n in (override or {}).items():
        if name not in out or n < 0:
            raise ValidationError(f"bad volume: {name}={n}")
        out[name] = n
    return out


def validate(doc: Document) -> list[str]:
    """What does not hold together, as messages; none if all is well."""
    found = []
    for e in doc.entities.values():
        for f in e.fields:
            found += [f"{e.name}.{f.name} refers to unknown entity {n}" for n in targets(f.type) if n != "self" and n not in doc.entities]
            t = f.type.items[0] if f.type.kind in ("optional", "list") else f.type
            if t.kind == "named" and t.name not in doc.enums and t.name not in doc.types and t.name not in doc.entities:
                found.append(f"{e.name}.{f.name} has unknown type {t.name}")
    found += [f"rule on unknown entity {r.entity}" for r in doc.rules if r.entity not in doc.entities]
    found += [f"volume of unknown entity {n}" for n in doc.volume if n not in doc.entities]
    try:
        entity_order(doc)
    except CycleError as e:
        found.append(str(e))
    return found


def describe(doc: Document, override: dict[str, int] | None = None) -> list[tuple[str, int, list[str], list[str]]]:
    """(entity, rows, parents, fields) in the order of generation: a dry run."""
    n = volumes(doc, override)
    return [(name, n[name], sorted(parents(doc.entities[name])), [f.name for f in doc.entities[name].fields]) for name in entity_order(doc)]
