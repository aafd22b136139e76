"""Correlation rules: sources, fiber types, attributes, patterns; compiled on the driver to column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

_PLACEHOLDER = re.compile(r"\$\{(\w+)\}")
_UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def parse_duration(text: str) -> int | None:
    """``<int>(ms|s|m|h)`` in microseconds; ``infinite`` is None."""
    if text == "infinite":
        return None
    m = re.fullmatch(r"(\d+)(ms|s|m|h)", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


@dataclass(frozen=True)
class Regex:
    """A pattern with named groups, as the JVM takes it: groups by number, ``$`` and ``.`` by line feed only."""

    text: str

    @property
    def python(self) -> re.Pattern:
        return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", self.text))

    @property
    def jvm(self) -> str:
        return "(?d)" + re.sub(r"\(\?P?<(?![=!])\w+>", "(", self.text)

    @property
    def groups(self) -> dict[str, int]:
        return dict(self.python.groupindex)

    @property
    def optional(self) -> bool:
        """Whether a match may leave a named group out."""
        from re import _parser as parser

        def skipped(items, inside: bool) -> bool:
            for op, arg in items:
                name = str(op)
                if name == "SUBPATTERN":
                    if inside and arg[0] in named or skipped(arg[3], inside):
                        return True
                elif name == "BRANCH":
                    if any(skipped(x, True) for x in arg[1]):
                        return True
                elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                    if skipped(arg[2], inside or arg[0] == 0):
                        return True
            return False

        named = set(self.groups.values())
        return skipped(parser.parse(self.python.pattern), False)


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "string"
    key: bool = False
    derived: str | None = None

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(_PLACEHOLDER.findall(self.derived or "")))

    def parts(self) -> list[tuple[bool, str]]:
        """The template as (is an attribute, text) pieces."""
        found, at = [], 0
        for m in _PLACEHOLDER.finditer(self.derived or ""):
            if m.start() > at:
                found.append((False, self.derived[at : m.start()]))
            found.append((True, m[1]))
            at = m.end()
        if at < len(self.derived or ""):
            found.append((False, self.derived[at:]))
        return found


@dataclass(frozen=True)
class Pattern:
    regex: str
    release_peer: tuple[str, ...] = ()
    release_self: tuple[str, ...] = ()
    close: bool = False


@dataclass(frozen=True)
class FiberType:
    name: str
    attributes: tuple[Attribute, ...]
    sources: dict[str, tuple[Pattern, ...]]
    max_gap: str = "infinite"
    gap_mode: str = "session"
    is_source: bool = False

    def __post_init__(self):
        names = [a.name for a in self.attributes]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: an attribute comes twice")
        if self.gap_mode not in ("session", "from_start"):
            raise ValueError(f"{self.name}: gap mode {self.gap_mode!r}")
        parse_duration(self.max_gap)
        self.derived_order()
        for patterns in self.sources.values():
            for p in patterns:
                Regex(p.regex).python  # noqa: B018  raises on bad patterns
                if unknown := {*p.release_peer, *p.release_self} - {a.name for a in self.attributes if a.key}:
                    raise ValueError(f"{self.name}: releases {sorted(unknown)}, which are no keys")

    @property
    def gap(self) -> int | None:
        return parse_duration(self.max_gap)

    @property
    def keys(self) -> list[str]:
        return [a.name for a in self.attributes if a.key]

    def derived_order(self) -> list[Attribute]:
        """Derived attributes, each after those it is made of."""
        by_name = {a.name: a for a in self.attributes}
        for a in self.attributes:
            if missing := set(a.inputs) - by_name.keys():
                raise ValueError(f"{self.name}: {a.name} needs {sorted(missing)}")
        try:
            order = list(TopologicalSorter({a.name: a.inputs for a in self.attributes}).static_order())
        except CycleError as e:
            raise ValueError(f"{self.name}: derived attributes need each other: {e.args[1]}") from e
        return [by_name[n] for n in order if by_name[n].derived is not None]


@dataclass(frozen=True)
class Source:
    """A text source: where it lies and how its lines tell the time."""

    source_id: str
    path: str
    pattern: str
    format: str = "iso8601"


@dataclass(frozen=True)
class Rules:
    types: tuple[FiberType, ...]
    sources: tuple[Source, ...] = field(default=())
    version: str = "1"

    def named(self, name: str) -> FiberType:
        return next(t for t in self.types if t.name == name)

    @classmethod
    def from_dict(cls, config: dict) -> Rules:
        """From the shape of a rules file: ``fiber_types`` and ``sources`` by name."""
        types = []
        for name, body in config.get("fiber_types", {}).items():
            temporal = body.get("temporal", {})
            attributes = tuple(Attribute(a["name"], a.get("type", "string"), bool(a.get("key")), a.get("derived")) for a in body.get("attributes", []))
            sources = {
                s: tuple(
                    Pattern(p["regex"], tuple(p.get("release_matching_peer_keys", ())), tuple(p.get("release_self_keys", ())), bool(p.get("close")))
                    for p in entry.get("patterns", [])
                )
                for s, entry in body.get("sources", {}).items()
            }
            types.append(FiberType(name, attributes, sources, temporal.get("max_gap", "infinite"), temporal.get("gap_mode", "session")))
        sources = tuple(Source(s, b["path"], b["timestamp"]["pattern"], b["timestamp"].get("format", "iso8601")) for s, b in config.get("sources", {}).items())
        return cls(tuple(types), sources, str(config.get("version", "1")))


def source_type(source_id: str) -> FiberType:
    """The type that holds a whole source: it never closes and has one constant key."""
    return FiberType(source_id, (Attribute("source", key=True, derived=source_id),), {source_id: (Pattern(".+"),)}, is_source=True)


def with_source_types(rules: Rules, source_ids: list[str]) -> Rules:
    """Adds a source type for each source, unless a type of that name exists."""
    known = {t.name for t in rules.types}
    return Rules(rules.types + tuple(source_type(s) for s in sorted(set(source_ids) - known)), rules.sources, rules.version)
