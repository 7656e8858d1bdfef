"""Reads a YAML model document into fabrel.model."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

import yaml

from ..errors import ParseError
from ..model import Branch, Decorator, Document, Entity, Field, Rule, Trigger, Type

PRIMITIVES = ("string", "int", "float", "decimal", "bool", "datetime", "date", "time", "duration", "uuid", "bytes", "null", "any")

# Namespaces of the semantic types.
SEMANTIC = (
    "person email phone url username ipv4 ipv6 mac contact address geo currency credit_card iban swift finance text "
    "product company job color file sku slug code hash accounting erp ecommerce naics isic sic unspsc hs mcc cip isced "
    "elf lei cofog cpv dewey atc mesh unm49 iso3166_2 ncbi ipcc taxonomy"
).split()

RULE_TAIL = re.compile(r"\s*@(strict|warn|probability)(?:\(([^)]*)\))?\s*$")


def split_top(text: str, separator: str) -> list[str]:
    """text cut at separators that stand outside brackets and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == separator and not depth and not (separator == "|" and text[i - 1 : i] == "-"):
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def unquoted(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def parse_decorator(text: str) -> Decorator:
    """`name`, `name(a, b)` or `name(a, k=v)`; the argument of derived is one expression."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", text, re.DOTALL)
    if not m:
        raise ParseError(f"not a decorator: @{text}")
    name, inner = m[1], m[2]
    if inner is None:
        return Decorator(name)
    if name in ("derived", "pattern", "range", "len", "count"):
        return Decorator(name, (unquoted(inner) if name == "pattern" else inner.strip(),))
    args, named = [], []
    last = None
    for part in split_top(inner.replace("{", " ").replace("}", " ") if name == "dist" else inner, ","):
        if m := re.fullmatch(r"\s*([^\W\d]\w*)\s*[=:]\s*(.+)", part, re.DOTALL):
            last = m[1]
            named.append((last, unquoted(m[2])))
        elif last == "peaks" and part.strip():
            named.append((last, unquoted(part)))
        elif part.strip():
            args.append(unquoted(part))
    return Decorator(name, tuple(args), tuple(named))


def split_decorators(text: str) -> tuple[str, tuple[Decorator, ...]]:
    head, *rest = split_top(text, "@")
    return head.strip(), tuple(parse_decorator(r) for r in rest)


def parse_type(text: str) -> Type:
    """What is not known becomes a named type; only the empty text is an error."""
    t = text.strip()
    if not t:
        raise ParseError("empty type")
    branches = split_top(t, "|")
    if len(branches) > 1:
        inner = tuple(parse_type(b) for b in branches)
        return Type("poly" if all(i.kind == "ref" for i in inner) else "union", items=inner)
    if t.startswith("<->"):
        return Type("ref", t[3:].strip(), many=True)
    if t.startswith("->"):
        name, optional = t[2:].strip().removesuffix("?"), t.endswith("?")
        return Type("ref", name.strip("[]"), optional=optional, many=name.startswith("["))
    if t.endswith("?"):
        return Type("optional", items=(parse_type(t[:-1]),))
    if t[0] == "[" and t[-1] == "]":
        return Type("list", items=(parse_type(t[1:-1]),))
    if t[0] == "{" and t[-1] == "}":
        key, value = split_top(t[1:-1], ":")
        return Type("map", items=(parse_type(key), parse_type(value)))
    if t[0] == "(" and t[-1] == ")":
        return Type("tuple", items=tuple(parse_type(p) for p in split_top(t[1:-1], ",")))
    m = re.fullmatch(r"([\w.]+)\s*(?:\((.*)\))?", t, re.DOTALL)
    if not m:
        return Type("named", t)
    name, params = m[1], tuple(unquoted(p) for p in split_top(m[2], ",")) if m[2] is not None else ()
    if name == "enum":
        return Type("enum", items=params)
    if name in PRIMITIVES:
        return Type("prim", name, params)
    return Type("semantic" if name.split(".")[0] in SEMANTIC else "named", name, params)


def parse_field(name: str, spec: Any) -> Field:
    if isinstance(spec, str):
        kind, decorators = split_decorators(spec)
        return Field(name, parse_type(kind), decorators)
    if not isinstance(spec, dict) or "type" not in spec:
        raise ParseError(f"field {name}: a string or a mapping with `type` is needed; quote compound types")
    kind, decorators = split_decorators(str(spec["type"]))
    branches = tuple(Branch(None, str(b["else"])) if "else" in b else Branch(str(b["when"]), str(b["value"])) for b in spec.get("compute", ()))
    text = lambda k: None if spec.get(k) is None else str(spec[k])
    return Field(name, parse_type(kind), decorators, text("label"), text("description"), tuple(map(str, spec.get("default_chain", ()))), text("when"), text("fallback"), branches)


def parse_entity(name: str, spec: dict[str, Any]) -> Entity:
    fields, meta, coherence, triggers = [], (), (), ()
    for key, value in spec.items():
        if key == "_meta":
            meta = split_decorators(str(value))[1]
        elif key == "_coherence":
            coherence = tuple((k, tuple(v)) for k, v in value.items())
        elif key == "_triggers":
            triggers = tuple(Trigger(t.get("on", t.get(True)), tuple(t.get("recompute", ())), tuple(t.get("validate", ()))) for t in value)
        else:
            fields.append(parse_field(key, value))
    if not fields:
        raise ParseError(f"entity {name} has no fields")
    return Entity(name, tuple(fields), meta, coherence, triggers)


def parse_volume(spec: Any) -> int | None:
    """A number, the middle of `lo..hi`, or None for `~`."""
    if spec is None or spec == "~":
        return None
    if m := re.fullmatch(r"\s*(\d+)\s*\.\.\s*(\d+)\s*", str(spec)):
        return (int(m[1]) + int(m[2])) // 2
    try:
        return int(spec)
    except ValueError:
        raise ParseError(f"not a volume: {spec}") from None


def _entity_of(expression: str) -> str:
    m = re.search(r"\b([A-Z]\w*)\.\w", expression)
    if not m:
        raise ParseError(f"a rule names no entity: {expression}")
    return m[1]


def parse_rule(spec: Any) -> Rule:
    """`C`, `if C then T`, `unique(E.a, E.b)` or `count(E.x) op n` with @strict, @warn or @probability(p); or a mapping."""
    if isinstance(spec, dict) and "cross_row" in spec:
        c = spec["cross_row"]
        on = c.get("on_violation", {}) or {}
        return Rule(c["entity"], c["check"], mode="probability", probability=float(c.get("probability", 1.0)), error=on.get("error"), kind="cross_row", group_by=c.get("group_by"), set_values=tuple((k, str(v)) for k, v in (on.get("set") or {}).items()))
    if isinstance(spec, dict):
        when = None if spec.get("when") is None else str(spec["when"])
        return Rule(_entity_of(when or str(spec["assert"])), str(spec["assert"]), when, spec.get("severity", "strict"), error=spec.get("error"))
    text, mode, p = str(spec).strip(), "strict", 1.0
    if m := RULE_TAIL.search(text):
        text, mode = text[: m.start()], m[1]
        p = float(m[2]) if m[2] else 1.0
    if m := re.fullmatch(r"if\s+(.+?)\s+then\s+(.+)", text, re.DOTALL):
        return Rule(_entity_of(m[1]), m[2], m[1], mode, p)
    kind = next((k for k in ("unique", "count") if re.match(rf"{k}\s*\(", text)), "row")
    return Rule(_entity_of(text), text, None, mode, p, kind=kind)


def parse_enum(values: Any) -> tuple[tuple[str, float], ...]:
    return tuple((str(v["value"]), float(v.get("weight", 1))) if isinstance(v, dict) else (str(v), 1.0) for v in values)


# What the generation section may say.
CHOICES = {"null_strategy": ("realistic", "never", "sparse"), "id_format": ("uuid", "sequential", "cuid", "ulid"), "currency_format": ("decimal", "integer_cents")}


def parse_document(text: str) -> Document:
    """A document from YAML text; `domain` is mandatory."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ParseError(str(e)) from e
    if not isinstance(raw, dict) or not raw.get("domain"):
        raise ParseError("a document is a mapping with `domain`")
    generation = raw.get("generation") or {}
    for name, known in CHOICES.items():
        if generation.get(name, known[0]) not in known:
            raise ParseError(f"unknown {name}: {generation[name]}")
    seed = raw.get("seed", generation.get("seed", 0))
    doc = Document(str(raw["domain"]), raw.get("version") and str(raw["version"]), raw.get("description"), str(raw.get("locale", generation.get("locale", "en-US"))), int(seed or 0))
    doc.generation = dict(generation)
    doc.volume = {k: n for k, v in (raw.get("volume") or {}).items() if (n := parse_volume(v)) is not None}
    doc.enums = {k: parse_enum(v) for k, v in (raw.get("enums") or {}).items()}
    doc.types = {k: tuple(parse_field(n, s) for n, s in v.items()) for k, v in (raw.get("types") or {}).items()}
    doc.entities = {k: parse_entity(k, v) for k, v in (raw.get("entities") or {}).items()}
    doc.rules = [parse_rule(r) for r in raw.get("rules") or ()]
    doc.tools, doc.mcp_tools = dict(raw.get("tools") or {}), dict(raw.get("mcp_tools") or {})
    return doc


def load_document(path: str) -> Document:
    return parse_document(Path(path).read_text())
