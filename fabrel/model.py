"""The declared data model: documents, entities, fields, types, decorators and rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Type:
    """kind: prim, enum, semantic, named, ref, poly, list, map, tuple, optional or union."""

    kind: str
    name: str = ""
    items: tuple[Any, ...] = ()  # parameters, enum values or inner types
    optional: bool = False  # a reference that may be null
    many: bool = False  # ->[E] and <->E


@dataclass(frozen=True)
class Decorator:
    name: str
    args: tuple[str, ...] = ()
    named: tuple[tuple[str, str], ...] = ()

    def option(self, *names: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.named if k in names), default)


@dataclass(frozen=True)
class Branch:
    """A branch of `compute`; when is None for `else`."""

    when: str | None
    value: str


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    decorators: tuple[Decorator, ...] = ()
    label: str | None = None
    description: str | None = None
    default_chain: tuple[str, ...] = ()
    chain_when: str | None = None
    fallback: str | None = None
    compute: tuple[Branch, ...] = ()

    def get(self, name: str) -> Decorator | None:
        return next((d for d in self.decorators if d.name == name), None)

    def has(self, *names: str) -> bool:
        return any(d.name in names for d in self.decorators)

    @property
    def is_derived(self) -> bool:
        return bool(self.default_chain or self.compute or self.has("derived"))


@dataclass(frozen=True)
class Trigger:
    on: str
    recompute: tuple[str, ...] = ()
    validate: tuple[str, ...] = ()


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...]
    meta: tuple[Decorator, ...] = ()
    coherence: tuple[tuple[str, tuple[str, ...]], ...] = ()
    triggers: tuple[Trigger, ...] = ()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def has(self, name: str) -> bool:
        return any(d.name == name for d in self.meta)

    @property
    def key(self) -> Field:
        """The declared primary key, else the first field."""
        return next((f for f in self.fields if f.has("primary")), self.fields[0])


@dataclass(frozen=True)
class Rule:
    """entity's rows must satisfy check (where `when` holds). mode: strict, warn or probability."""

    entity: str
    check: str
    when: str | None = None
    mode: str = "strict"
    probability: float = 1.0
    error: str | None = None
    kind: str = "row"  # row, unique, count or cross_row
    group_by: str | None = None
    set_values: tuple[tuple[str, str], ...] = ()


@dataclass
class Document:
    domain: str
    version: str | None = None
    description: str | None = None
    locale: str = "en-US"
    seed: int = 0
    volume: dict[str, int] = field(default_factory=dict)
    generation: dict[str, Any] = field(default_factory=dict)
    enums: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict)
    types: dict[str, tuple[Field, ...]] = field(default_factory=dict)
    entities: dict[str, Entity] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    tools: dict[str, Any] = field(default_factory=dict)
    mcp_tools: dict[str, Any] = field(default_factory=dict)
