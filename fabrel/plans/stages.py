"""Which fields wait for others: a graph of fields over entities, cut into stages.

Most fields come with their rows. A field is late if it reads what is there only once all rows are: aggregates over
children, another row of its own entity, an entity that comes later, a field that a rule sets, or a late field. Late fields
and the rules that set fields are nodes of one graph; an edge within a row stays in a stage, any other begins a new one.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..errors import CycleError, GenerationError
from ..functions.expressions import Compiler, parsed
from ..model import Document, Entity, Field, Rule
from .order import entity_order

#: (entity, field), or (rule's entity, rule's number).
Node = tuple[str, str | int]


@dataclass(frozen=True)
class Read:
    """A field that is read; local if it is of the same row."""

    entity: str
    field: str
    local: bool = False


def is_collection(doc: Document, f: Field | None) -> bool:
    """Whether a field stands for rows of another entity that refer back."""
    return f is not None and (f.type.many or (f.type.kind == "list" and f.type.items[0].kind == "named" and f.type.items[0].name in doc.entities))


def child_of(doc: Document, entity: Entity, collection: str) -> tuple[Entity, str]:
    """The entity that a has-many field holds, and its field that refers back."""
    g = entity.field(collection)
    inner = None if not is_collection(doc, g) else g.type.name if g.type.many else g.type.items[0].name
    if inner not in doc.entities:
        raise GenerationError(f"{entity.name}.{collection} is no collection of an entity")
    child = doc.entities[inner]
    ref = next((c.name for c in child.fields if c.type.kind == "ref" and c.type.name == entity.name and not c.type.many), None)
    if ref is None:
        raise GenerationError(f"{inner} has no reference to {entity.name}")
    return child, ref


def own(entity: Entity, text: str) -> str:
    """`Entity.a` is field a of the entity's own row."""
    return re.sub(rf"\b{entity.name}\.", "", text)


def names_in(tree: ast.AST) -> tuple[list[tuple[str, ...]], list[tuple[str, tuple[str, ...]]]]:
    """The dotted paths of an expression, and the (function, path) of calls that aggregate a path."""
    reader = Compiler(lambda _: None)
    paths, calls = [], []

    def visit(node: ast.AST) -> None:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            if node.func.id in Compiler.AGGREGATES and len(node.args) == 1 and (p := reader.path(node.args[0])):
                calls.append((node.func.id, p))
                return
            for a in node.args:
                visit(a)
        elif isinstance(node, (ast.Name, ast.Attribute)) and (p := reader.path(node)):
            paths.append(p)
        else:
            for c in ast.iter_child_nodes(node):
                visit(c)

    visit(tree)
    return list(dict.fromkeys(paths)), list(dict.fromkeys(calls))


def path_reads(doc: Document, entity: Entity, path: tuple[str, ...]) -> Iterator[Read]:
    if len(path) == 2 and entity.field(path[0]) is None and path[0] in doc.entities:
        yield Read(path[0], path[1])
        return
    at, local = entity, True
    for hop in path[:-1]:
        f = at.field(hop)
        if f is None or f.type.kind != "ref":
            return
        yield Read(at.name, hop, local)
        at, local = at if f.type.name == "self" else doc.entities.get(f.type.name, at), False
    if at.field(path[-1]) is not None:
        yield Read(at.name, path[-1], local)


def text_reads(doc: Document, entity: Entity, text: str) -> Iterator[Read]:
    paths, calls = names_in(parsed(own(entity, text)))
    for p in paths:
        yield from path_reads(doc, entity, p)
    for _, p in calls:
        if is_collection(doc, entity.field(p[0])):
            child, ref = child_of(doc, entity, p[0])
            yield from (Read(child.name, n) for n in (ref, *p[1:]))
        elif p[0] in doc.entities and entity.field(p[0]) is None:
            yield Read(p[0], p[1] if len(p) > 1 else doc.entities[p[0]].key.name)
        else:
            yield from path_reads(doc, entity, p)


def field_reads(doc: Document, entity: Entity, f: Field) -> list[Read]:
    """What a derived field reads, and a moment after, before or within another one."""
    out = [r for p in f.default_chain for r in path_reads(doc, entity, tuple(p.split(".")))]
    texts = [f.chain_when, f.fallback, *[x for b in f.compute for x in (b.when, b.value)], f.get("derived") and f.get("derived").args[0]]
    out += [r for t in texts if t for r in text_reads(doc, entity, t)]
    return out + [r for d in f.decorators if d.name in ("after", "before", "within") and "." in d.args[-1] for r in path_reads(doc, entity, tuple(d.args[-1].split(".")))]


def share_rule(doc: Document, rule: Rule) -> tuple[str, str, str] | None:
    """(collection, child's field, expression) of a strict rule `sum(E.collection.field) == expression`, either way round."""
    if rule.kind != "row" or rule.mode != "strict" or rule.when:
        return None
    entity = doc.entities[rule.entity]
    tree = parsed(own(entity, rule.check))
    if not (isinstance(tree, ast.Compare) and len(tree.ops) == 1 and isinstance(tree.ops[0], ast.Eq)):
        return None
    for side, other in ((tree.left, tree.comparators[0]), (tree.comparators[0], tree.left)):
        if isinstance(side, ast.Call) and getattr(side.func, "id", "") == "sum" and not names_in(other)[1]:
            path = Compiler(lambda _: None).path(side.args[0])
            if path and len(path) == 2 and is_collection(doc, entity.field(path[0])):
                child, _ = child_of(doc, entity, path[0])
                f = child.field(path[1])
                return (*path, ast.unparse(other)) if f is not None and not f.is_derived else None
    return None


class Stages:
    """The late fields of a document, the rules that set fields, and in which order they come."""

    def __init__(self, doc: Document, late_key: Callable[[Entity], bool]) -> None:
        self.doc = doc
        self.place = {n: i for i, n in enumerate(entity_order(doc))}
        self.reads: dict[Node, list[Read]] = {}
        for e in doc.entities.values():
            for f in e.fields:
                if not is_collection(doc, f) and (found := field_reads(doc, e, f)):
                    self.reads[e.name, f.name] = found
        #: Fields that are row numbers of their own entity until its rows are made.
        self.numbers = {(e.name, f.name) for e in doc.entities.values() for f in e.fields if f.type.kind == "ref" and not f.type.many and f.type.name in ("self", e.name) and late_key(e)}
        self.sets: dict[Node, list[tuple[str, str]]] = {}
        for i, r in enumerate(doc.rules):
            if r.entity in doc.entities:
                self._rule(i, r)
        self.late = self._late()
        for i, r in enumerate(doc.rules):  # shares of what depends on the shares themselves are left to that
            if (r.entity, i) in self.sets and share_rule(doc, r) and self._reached((r.entity, i)):
                del self.sets[r.entity, i], self.reads[r.entity, i]
                self.late = self._late()
        self.stage = self._cut()

    def _rule(self, i: int, r: Rule) -> None:
        entity = self.doc.entities[r.entity]
        if r.kind == "cross_row" and r.set_values:
            names = [n for n in (r.group_by, *re.findall(r"\((\w+)\)", r.check)) if n]
            self.reads[r.entity, i] = [Read(r.entity, n) for n in names if entity.field(n)]
            self.sets[r.entity, i] = [tuple(p.split(".")) for p, _ in r.set_values]
        elif share := share_rule(self.doc, r):
            child, ref = child_of(self.doc, entity, share[0])
            self.reads[r.entity, i] = [*text_reads(self.doc, entity, share[2]), Read(child.name, ref), Read(child.name, share[1])]
            self.sets[r.entity, i] = [(child.name, share[1])]

    def writers(self, entity: str, name: str) -> list[Node]:
        return [n for n, fields in self.sets.items() if (entity, name) in fields]

    def waits(self, entity: str, r: Read) -> bool:
        """Whether a row of entity, when it is made, has to wait for what it reads."""
        there = r.local or (r.entity != entity and self.place.get(r.entity, 0) < self.place.get(entity, 0))
        return not there or (r.entity, r.field) in self.late or bool(self.writers(r.entity, r.field)) or ((r.entity, r.field) in self.numbers and r.entity == entity)

    def _late(self) -> set[Node]:
        self.late: set[Node] = set()
        while True:
            more = {n for n, reads in self.reads.items() if isinstance(n[1], str) and n not in self.late and any(self.waits(n[0], r) for r in reads)}
            if not more:
                return self.late
            self.late = self.late | more

    def inputs(self, node: Node) -> list[tuple[Node, bool]]:
        """The nodes that a node waits for, and whether within a row."""
        out = []
        for r in self.reads[node]:
            field = (r.entity, r.field)
            if field in self.late and (field != node or isinstance(node[1], str)):
                out.append((field, r.local and isinstance(node[1], str)))
            if isinstance(node[1], int) and field in self.sets[node]:  # it sees what rules before it set
                out += [(w, False) for w in self.writers(*field) if w[1] < node[1]]
            else:
                out += [(w, False) for w in self.writers(*field) if w != node]
        for field in self.sets.get(node, ()):
            out += [(field, False)] * (field in self.late) + [(w, False) for w in self.writers(*field) if w[1] < node[1]]
        return list(dict.fromkeys(out))

    def _reached(self, node: Node) -> bool:
        """Whether what a rule reads, but for the fields that it sets, depends on the rule."""
        todo, seen = [(r.entity, r.field) for r in self.reads[node] if (r.entity, r.field) not in self.sets[node]], set()
        while todo:
            at = todo.pop()
            if at in self.sets[node]:
                return True
            if at not in seen:
                seen.add(at)
                todo += [(r.entity, r.field) for n in (at, *self.writers(*at)) if n != node for r in self.reads.get(n, ())]
        return False

    def _cut(self) -> dict[Node, int]:
        stage: dict[Node, int] = {}
        path: list[Node] = []

        def visit(node: Node) -> int:
            if node in path:
                raise CycleError("fields refer to each other: " + ", ".join(f"{e}.{n}" if isinstance(n, str) else f"rule {n}" for e, n in path[path.index(node) :]))
            if node not in stage:
                path.append(node)
                stage[node] = max([1, *(visit(n) + (not within) for n, within in self.inputs(node))])
                path.pop()
            return stage[node]

        for node in [n for n in self.reads if n in self.late or n in self.sets]:
            visit(node)
        return stage  # nodes stand in it after what they wait for

    def needed(self, entities: set[str], closure: Callable[[str], set[str]]) -> set[str]:
        """The entities whose rows the late fields of some entities, and rules that set their fields, need too."""
        out = set(entities)
        while True:
            used = {n for n in self.stage if n[0] in out and isinstance(n[1], str)} | {n for n, fields in self.sets.items() if any(e in out for e, _ in fields)}
            more = {x for n in used for e in (n[0], *(r.entity for r in self.reads[n])) for x in closure(e)} - out
            if not more:
                return out
            out |= more
