"""Typed configuration: codecs of values, fields, schemas, resolution and binding.

A codec reads text and JSON values, checks them and writes the canonical JSON value. A
schema has fields in order; resolving goes from defaults over a preset to an explicit
patch, fills defaults that depend on other values, normalizes, checks everything, and
tells where each value came from.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

from .diagnostics import Item, Problems, check

# ---- codecs


@dataclass(frozen=True)
class Codec:
    """A scalar: `kind`, with an optional range, step and unit."""

    kind: type = str
    low: float | None = None
    high: float | None = None
    step: float | None = None
    unit: str = ""

    def range(self, low: float | None = None, high: float | None = None) -> Codec:
        if low is not None and high is not None and low > high:
            raise ValueError("an empty range")
        return replace(self, low=low, high=high)

    def steps(self, step: float) -> Codec:
        if not step > 0:
            raise ValueError("steps are above 0")
        return replace(self, step=step)

    def units(self, unit: str) -> Codec:
        return replace(self, unit=unit)

    @property
    def name(self) -> str:
        return {bool: "bool", int: "int", float: "float", str: "text"}[self.kind]

    def parse(self, text: str) -> Any:
        raw = text.strip() if self.kind is not str else text
        if self.unit and raw.lower().endswith(self.unit.lower()):
            raw = raw[: -len(self.unit)].strip()
        if self.kind is bool:
            try:
                return {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}[raw.lower()]
            except KeyError:
                raise Problems([Item("bad-value", f"{text!r} is no bool")]) from None
        try:
            return self.kind(raw)
        except ValueError:
            raise Problems([Item("bad-value", f"{text!r} is no {self.name}")]) from None

    def decode(self, value: Any) -> Any:
        """From a JSON value; a whole number serves as a float, a bool as nothing else."""
        if self.kind is float and isinstance(value, int) and not isinstance(value, bool):
            return float(value)
        if self.kind is int and isinstance(value, float) and value.is_integer():
            return int(value)
        if type(value) is not self.kind:
            raise Problems([Item("bad-type", f"{value!r} is no {self.name}")])
        return value

    def encode(self, value: Any) -> Any:
        return value

    def check(self, value: Any) -> Iterator[Item]:
        if type(value) is not self.kind:
            yield Item("bad-type", f"{value!r} is no {self.name}")
            return
        if self.kind in (int, float):
            if self.kind is float and not math.isfinite(value):
                yield Item("not-finite", "must be finite")
                return
            if self.low is not None and value < self.low:
                yield Item("below-range", f"{value} is below {self.low}")
            if self.high is not None and value > self.high:
                yield Item("above-range", f"{value} is above {self.high}")
            if self.step:
                n = (value - (self.low or 0)) / self.step
                if abs(n - round(n)) > 1e-9:
                    yield Item("off-step", f"{value} is no step of {self.step}")

    def describe(self) -> dict[str, Any]:
        own = {"type": self.name, "min": self.low, "max": self.high, "step": self.step, "unit": self.unit or None}
        return {k: v for k, v in own.items() if v is not None}


BOOL, INT, FLOAT, TEXT = Codec(bool), Codec(int), Codec(float), Codec(str)
#: Seconds in each unit of a duration.
SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
PART = re.compile(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)")


@dataclass(frozen=True)
class Duration(Codec):
    """Seconds; in text one or more numbers with units, "1m30s"."""

    kind: type = float

    @property
    def name(self) -> str:
        return "duration"

    def parse(self, text: str) -> float:
        raw = text.strip()
        sign, raw = (-1, raw[1:]) if raw.startswith("-") else (1, raw)
        if raw == "0":
            return 0.0
        parts = PART.findall(raw)
        if not parts or "".join(n + u for n, u in parts) != raw:
            raise Problems([Item("bad-value", f"{text!r} is no duration")])
        return sign * sum(float(n) * SECONDS[u] for n, u in parts)


@dataclass(frozen=True)
class Choice:
    """One of some words; aliases stand for them."""

    words: tuple[str, ...]
    aliases: tuple[tuple[str, str], ...] = ()
    name = "choice"

    def parse(self, text: str) -> str:
        return self.decode(text.strip().lower())

    def decode(self, value: Any) -> str:
        value = dict(self.aliases).get(value, value)
        check(self.check(value))
        return value

    def encode(self, value: str) -> str:
        return value

    def check(self, value: Any) -> Iterator[Item]:
        if value not in self.words:
            yield Item("unknown-choice", f"{value!r} is none of {', '.join(self.words)}")

    def describe(self) -> dict[str, Any]:
        return {"type": self.name, "values": list(self.words)}


@dataclass(frozen=True)
class List:
    """Values of one codec, between `least` and `most` of them; in text by commas."""

    of: Any
    least: int = 0
    most: int | None = None
    name = "list"

    def parse(self, text: str) -> tuple:
        return tuple(_each((str(i), lambda x=x: self.of.parse(x)) for i, x in enumerate(text.split(",") if text.strip() else [])))

    def decode(self, value: Any) -> tuple:
        if not isinstance(value, list | tuple):
            raise Problems([Item("bad-type", f"{value!r} is no list")])
        return tuple(_each((str(i), lambda x=x: self.of.decode(x)) for i, x in enumerate(value)))

    def encode(self, value: tuple) -> list:
        return [self.of.encode(x) for x in value]

    def check(self, value: Any) -> Iterator[Item]:
        if len(value) < self.least:
            yield Item("too-few", f"{len(value)} values, {self.least} at least")
        if self.most is not None and len(value) > self.most:
            yield Item("too-many", f"{len(value)} values, {self.most} at most")
        for i, x in enumerate(value):
            yield from (p.under(str(i)) for p in self.of.check(x))

    def describe(self) -> dict[str, Any]:
        return {"type": self.name, "of": self.of.describe(), "min": self.least, "max": self.most}


@dataclass(frozen=True)
class Table:
    """Values of one codec by name; in text k=v by commas."""

    of: Any
    name = "map"

    def parse(self, text: str) -> dict:
        out: dict[str, Any] = {}
        for part in text.split(",") if text.strip() else []:
            key, eq, value = part.partition("=")
            if not eq or not key.strip() or key.strip() in out:
                raise Problems([Item("bad-value", f"{part!r} is no new key=value")])
            out[key.strip()] = self.of.parse(value)
        return out

    def decode(self, value: Any) -> dict:
        if not isinstance(value, Mapping):
            raise Problems([Item("bad-type", f"{value!r} is no map")])
        return dict(zip(value, _each((str(k), lambda x=x: self.of.decode(x)) for k, x in value.items()), strict=True))

    def encode(self, value: dict) -> dict:
        return {k: self.of.encode(value[k]) for k in sorted(value)}

    def check(self, value: Any) -> Iterator[Item]:
        for k, x in value.items():
            yield from (p.under(k) for p in self.of.check(x))

    def describe(self) -> dict[str, Any]:
        return {"type": self.name, "of": self.of.describe()}


@dataclass(frozen=True)
class Union:
    """One of several shapes, told apart by the field `tag`."""

    shapes: tuple[tuple[str, Schema], ...]
    tag: str = "type"
    name = "union"

    def parse(self, text: str) -> dict:
        try:
            return self.decode(json.loads(text))
        except json.JSONDecodeError as e:
            raise Problems([Item("bad-json", str(e))]) from None

    def decode(self, value: Any) -> dict:
        if not isinstance(value, Mapping) or value.get(self.tag) not in dict(self.shapes):
            raise Problems([Item("unknown-choice", f"{self.tag} must be one of {', '.join(n for n, _ in self.shapes)}", (self.tag,))])
        own = dict(self.shapes)[value[self.tag]]
        return {self.tag: value[self.tag], **own.resolve({k: v for k, v in value.items() if k != self.tag}).values}

    def encode(self, value: dict) -> dict:
        own = dict(self.shapes)[value[self.tag]]
        return {self.tag: value[self.tag], **own.encode({k: v for k, v in value.items() if k != self.tag})}

    def check(self, value: Any) -> Iterator[Item]:
        own = dict(self.shapes).get(value.get(self.tag))
        if own is None:
            yield Item("unknown-choice", f"no shape {value.get(self.tag)!r}", (self.tag,))
        else:
            yield from own.problems({k: v for k, v in value.items() if k != self.tag})

    def describe(self) -> dict[str, Any]:
        return {"type": self.name, "tag": self.tag, "shapes": {n: s.describe() for n, s in self.shapes}}


@dataclass(frozen=True)
class Nested:
    """A schema as a value."""

    schema: Schema
    name = "object"

    def parse(self, text: str) -> dict:
        try:
            return self.decode(json.loads(text))
        except json.JSONDecodeError as e:
            raise Problems([Item("bad-json", str(e))]) from None

    def decode(self, value: Any) -> dict:
        if not isinstance(value, Mapping):
            raise Problems([Item("bad-type", f"{value!r} is no object")])
        return self.schema.resolve(value).values

    def encode(self, value: dict) -> dict:
        return self.schema.encode(value)

    def check(self, value: Any) -> Iterator[Item]:
        yield from self.schema.problems(value)

    def describe(self) -> dict[str, Any]:
        return {"type": self.name, "fields": self.schema.describe()}


def _each(parts: Iterator[tuple[str, Callable[[], Any]]]) -> Iterator[Any]:
    """Values of a collection, or the problems of all its members."""
    out, bad = [], []
    for path, f in parts:
        try:
            out.append(f())
        except Problems as e:
            bad += [i.under(path) for i in e.items]
    check(bad)
    return iter(out)


# ---- fields and schemas


@dataclass(frozen=True)
class Field:
    """`default` is a value, or a function of the values before it; a field without one is
    required. `active` tells by the other values whether it counts, `needs` names fields
    that must be set with it, `rule` gives further problems."""

    name: str
    codec: Any
    default: Any = None
    required: bool = False
    active: Callable[[dict], bool] | None = None
    needs: tuple[str, ...] = ()
    normal: Callable[[Any], Any] | None = None
    help: str = ""


@dataclass(frozen=True)
class Resolved:
    values: dict[str, Any]
    origin: dict[str, str]
    canonical: str
    inactive: tuple[str, ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.canonical.encode()).hexdigest()


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    presets: tuple[tuple[str, tuple[tuple[str, Any], ...]], ...] = ()
    rule: Callable[[dict], Iterator[Item]] | None = None

    def __post_init__(self) -> None:
        check(self.definition_problems())

    def definition_problems(self) -> Iterator[Item]:
        """Names twice, defaults that don't fit, needs that lead nowhere or in a circle,
        presets with unknown fields."""
        names = [f.name for f in self.fields]
        for n in sorted({n for n in names if names.count(n) > 1}):
            yield Item("duplicate-field", "is defined twice", (n,))
        for f in self.fields:
            if f.default is not None and not callable(f.default):
                yield from (i.under(f.name) for i in f.codec.check(f.default))
            for other in f.needs:
                if other not in names:
                    yield Item("unknown-field", f"needs {other!r}, which there is not", (f.name,))
        for name, values in self.presets:
            for k, _ in values:
                if k not in names:
                    yield Item("unknown-field", f"is in preset {name!r} only", (k,))
        if (ring := self.ring()) is not None:
            yield Item("cycle", f"needs go round: {' -> '.join(ring)}", (ring[0],))

    def ring(self) -> list[str] | None:
        needs = {f.name: f.needs for f in self.fields}
        done: set[str] = set()

        def visit(n: str, path: list[str]) -> list[str] | None:
            if n in path:
                return [*path[path.index(n) :], n]
            if n in done:
                return None
            for m in needs.get(n, ()):
                if found := visit(m, [*path, n]):
                    return found
            done.add(n)
            return None

        return next((r for n in needs if (r := visit(n, []))), None)

    def resolve(self, explicit: Mapping[str, Any] | None = None, preset: str | None = None, *, text: bool = False) -> Resolved:
        """explicit: JSON values by name, or strings with text=True."""
        explicit, chosen = dict(explicit or {}), {}
        known = {f.name: f for f in self.fields}
        bad = [Item("unknown-field", "there is no such field", (k,)) for k in explicit if k not in known]
        if preset is not None:
            if preset not in dict(self.presets):
                bad.append(Item("unknown-preset", f"no preset {preset!r}"))
            chosen = dict(dict(self.presets).get(preset, ()))
        values, origin = {}, {}
        for f in self.fields:
            where = "explicit" if explicit.get(f.name) is not None else "preset" if chosen.get(f.name) is not None else "default"
            try:
                if where == "explicit":
                    v = f.codec.parse(explicit[f.name]) if text and isinstance(explicit[f.name], str) else f.codec.decode(explicit[f.name])
                else:
                    v = chosen[f.name] if where == "preset" else f.default(dict(values)) if callable(f.default) else f.default
            except Problems as e:
                bad += [i.under(f.name) for i in e.items]
                continue
            if v is None:
                if f.required:
                    bad.append(Item("missing", "is required", (f.name,)))
                continue
            values[f.name], origin[f.name] = f.normal(v) if f.normal else v, where
        off = tuple(f.name for f in self.fields if f.active and not f.active(values))
        for f in self.fields:
            if origin.get(f.name) == "explicit":
                bad += [Item("missing", f"is needed by {f.name!r}", (n,)) for n in f.needs if n not in values]
                if f.name in off:
                    bad.append(Item("inactive", "has no effect with these settings", (f.name,)))
        for n in off:
            values.pop(n, None)
            origin.pop(n, None)
        bad += self.problems(values)
        check(bad)
        return Resolved(values, origin, json.dumps(self.encode(values), sort_keys=True, separators=(",", ":"), ensure_ascii=False), off)

    def problems(self, values: Mapping[str, Any]) -> list[Item]:
        out = [i.under(f.name) for f in self.fields if f.name in values for i in f.codec.check(values[f.name])]
        return out + (list(self.rule(dict(values))) if self.rule and not out else [])

    def encode(self, values: Mapping[str, Any]) -> dict[str, Any]:
        return {f.name: f.codec.encode(values[f.name]) for f in self.fields if f.name in values}

    def to_json(self, values: Mapping[str, Any]) -> str:
        return json.dumps(self.encode(values), separators=(",", ":"), ensure_ascii=False)

    def from_json(self, text: str) -> Resolved:
        try:
            raw = json.loads(text)
        except json.JSONDecodeError as e:
            raise Problems([Item("bad-json", str(e))]) from None
        if not isinstance(raw, dict):
            raise Problems([Item("bad-type", "an object is expected")])
        return self.resolve(raw)

    def describe(self) -> list[dict[str, Any]]:
        return [{"name": f.name, **f.codec.describe(), "default": None if callable(f.default) or f.default is None else f.codec.encode(f.default), "required": f.required, "help": f.help} for f in self.fields]


def schema_of(defaults: Mapping[str, Any]) -> Schema:
    """A schema whose codecs follow from the types of the defaults."""
    kinds = {bool: BOOL, int: INT, float: FLOAT, str: TEXT}
    return Schema(tuple(Field(k, kinds[type(v)], v) for k, v in defaults.items()))


# ---- binding to dataclasses


def bind(cls: type) -> Schema:
    """The schema of a dataclass: a codec in each field's metadata, or by its type;
    `check` (low, high), `needs`, `active` and `help` there too."""
    kinds = {"bool": BOOL, "int": INT, "float": FLOAT, "str": TEXT}
    out = []
    for f in dataclasses.fields(cls):
        m = f.metadata
        codec = m.get("codec") or kinds[f.type if isinstance(f.type, str) else f.type.__name__]
        if "check" in m:
            codec = codec.range(*m["check"])
        none = f.default is dataclasses.MISSING
        out.append(Field(f.name.replace("_", "-"), codec, None if none else f.default, none, m.get("active"), tuple(n.replace("_", "-") for n in m.get("needs", ())), None, m.get("help", "")))
    return Schema(tuple(out))


def decode(cls: type, flags: Mapping[str, str]) -> Any:
    """An instance from flags as text."""
    values = bind(cls).resolve(flags, text=True).values
    return cls(**{k.replace("-", "_"): v for k, v in values.items()})


def flags(value: Any) -> list[str]:
    """What decode() would need to give this instance: name=text, without the defaults."""
    schema = bind(type(value))
    own = {f.name: getattr(value, f.name.replace("-", "_")) for f in schema.fields}
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return [f"--{f.name}={text(own[f.name])}" for f in schema.fields if own[f.name] != f.default]
