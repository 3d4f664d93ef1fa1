"""Plugins, their components, registries that resolve them, and the catalog.

A plugin is a class; its identity is the qualified name. Components are what it offers:
demuxers, decoders, filters, bridges, encoders, muxers and probers, each with a typed
schema and a capability. Sets of plugins are immutable.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, negotiate
from .diagnostics import Item, check

KINDS = ("prober", "demuxer", "decoder", "filter", "bridge", "encoder", "muxer")
ALIAS = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*")
BUILDS = ("builtin", "static", "dynamic")


def identity(cls: type) -> str:
    """What tells plugins and components apart, wherever they are made."""
    return f"{cls.__module__}.{cls.__qualname__}"


@dataclass(frozen=True)
class Port:
    """An input or output; `matches_main` asks for the rate of the main input."""

    name: str
    capability: negotiate.Capability = negotiate.Capability()
    matches_main: bool = False


@dataclass(frozen=True)
class Component:
    """`ports` may be a function of the component's parameters; `make` builds the engine
    from resolved settings."""

    kind: str
    name: str
    make: Callable[..., Any]
    schema: config.Schema = config.Schema(())
    capability: negotiate.Capability = negotiate.Capability()
    codecs: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    priority: int = 0
    parameters: config.Schema | None = None
    ports: Callable[[dict], tuple[tuple[Port, ...], tuple[Port, ...]]] | None = None
    probe: Callable[[bytes], int] | None = None
    bridges: Callable[[negotiate.Stream, negotiate.Capability], list] | None = None

    def manifest(self, parameters: dict[str, Any] | None = None) -> tuple[tuple[Port, ...], tuple[Port, ...]]:
        """Inputs and outputs with these parameters."""
        if self.ports is None:
            if parameters:
                check([Item("no-parameters", f"{self.name} takes no parameters")])
            return (Port("in", self.capability),), (Port("out"),)
        resolved = self.parameters.resolve(parameters or {}, text=True).values if self.parameters else {}
        return self.ports(resolved)


@dataclass(frozen=True)
class Descriptor:
    identity: str
    alias: str
    version: str = "0"
    source: str = ""
    build: str = "builtin"

    def problems(self) -> Iterator[Item]:
        if not self.identity:
            yield Item("no-identity", "a plugin needs an identity")
        if not ALIAS.fullmatch(self.alias):
            yield Item("bad-alias", f"{self.alias!r} isn't words of a-z and 0-9 joined by hyphens")
        if self.build not in BUILDS:
            yield Item("bad-build", f"{self.build!r} is none of {', '.join(BUILDS)}")
        if self.build != "builtin" and not self.source:
            yield Item("no-source", "plugins from elsewhere name their source")


@dataclass(frozen=True)
class Plugin:
    descriptor: Descriptor
    components: tuple[Component, ...]

    @property
    def identity(self) -> str:
        return self.descriptor.identity


def plugin(alias: str, *components: Component, **about: str) -> Callable[[type], Plugin]:
    """Decorates a class: the plugin of that identity."""

    def define(cls: type) -> Plugin:
        d = Descriptor(identity(cls), alias, **about)
        check(d.problems())
        return Plugin(d, components)

    return define


@dataclass(frozen=True)
class PluginSet:
    plugins: tuple[Plugin, ...] = ()

    def add(self, p: Plugin) -> PluginSet:
        have = {(c.kind, c.name) for q in self.plugins for c in q.components}
        own = [(c.kind, c.name) for c in p.components]
        bad = [Item("duplicate-plugin", p.identity)] if p.identity in {q.identity for q in self.plugins} else []
        bad += [Item("duplicate-component", f"{k} {n}", (p.identity,)) for k, n in own if (k, n) in have or own.count((k, n)) > 1]
        check(bad)
        return PluginSet((*self.plugins, p))

    def remove(self, identity_: str) -> PluginSet:
        if identity_ not in {p.identity for p in self.plugins}:
            check([Item("missing-plugin", identity_)])
        return PluginSet(tuple(p for p in self.plugins if p.identity != identity_))

    def remove_component(self, kind: str, name: str) -> PluginSet:
        """A plugin that is left without components goes too."""
        rest = tuple(replace(p, components=tuple(c for c in p.components if (c.kind, c.name) != (kind, name))) for p in self.plugins)
        if rest == self.plugins:
            check([Item("missing-component", f"{kind} {name}")])
        return PluginSet(tuple(p for p in rest if p.components))

    def override(self, p: Plugin) -> PluginSet:
        """Another definition of a plugin that is there, in its place."""
        if p.identity not in {q.identity for q in self.plugins}:
            check([Item("missing-plugin", p.identity)])
        rest = self.remove(p.identity)
        rest.add(p)  # its components may not be another's
        return PluginSet(tuple(p if q.identity == p.identity else q for q in self.plugins))

    def override_component(self, c: Component) -> PluginSet:
        if (c.kind, c.name) not in {(d.kind, d.name) for q in self.plugins for d in q.components}:
            check([Item("missing-component", f"{c.kind} {c.name}")])
        swap = lambda d: c if (d.kind, d.name) == (c.kind, c.name) else d
        return PluginSet(tuple(replace(q, components=tuple(map(swap, q.components))) for q in self.plugins))


@dataclass
class Registry:
    """Components by kind and name; priorities can be overridden per name."""

    components: dict[tuple[str, str], Component] = field(default_factory=dict)
    priorities: dict[tuple[str, str], int] = field(default_factory=dict)

    def register(self, c: Component) -> None:
        if c.kind not in KINDS:
            check([Item("unknown-kind", c.kind)])
        if (c.kind, c.name) in self.components:
            check([Item("duplicate-component", f"{c.kind} {c.name}")])
        self.components[c.kind, c.name] = c

    def lookup(self, kind: str, name: str) -> Component:
        if (kind, name) not in self.components:
            known = ", ".join(c.name for c in self.enumerate(kind))
            check([Item(f"unknown-{kind}", f"no {kind} {name!r}; there are {known}")])
        return self.components[kind, name]

    def enumerate(self, kind: str | None = None) -> list[Component]:
        return [c for (k, _), c in sorted(self.components.items()) if kind in (None, k)]

    def with_priority(self, kind: str, name: str, priority: int) -> Registry:
        self.lookup(kind, name)
        return Registry(self.components, self.priorities | {(kind, name): priority})

    def priority(self, c: Component) -> int:
        return self.priorities.get((c.kind, c.name), c.priority)

    def best(self, found: Iterable[Component], what: str) -> Component:
        """The highest priority, then the first name."""
        ranked = sorted(found, key=lambda c: (-self.priority(c), c.name))
        if not ranked:
            check([Item("nothing-fits", what)])
        return ranked[0]

    def decoder(self, s: negotiate.Stream) -> Component:
        return self.best((c for c in self.enumerate("decoder") if s.codec in c.codecs and not replace(c.capability, codecs=()).reason(s)), f"no decoder for {s.signature}")

    def encoder(self, codec: str) -> Component:
        return self.best((c for c in self.enumerate("encoder") if codec in c.codecs), f"no encoder for {codec}")

    def muxer(self, codec: str, extension: str | None = None) -> Component:
        fits = lambda c: codec in c.codecs and extension in (None, *c.extensions)
        return self.best(filter(fits, self.enumerate("muxer")), f"no muxer for {codec}{' in ' + extension if extension else ''}")

    def filter(self, name: str) -> Component:
        return self.lookup("filter", name)

    def demuxer(self, head: bytes) -> Component:
        """The prober with the highest score above 0 names the demuxer."""
        scores = [(p.probe(head), self.priority(p), p.name) for p in self.enumerate("prober")]
        top = max(scores, key=lambda x: (x[0], x[1]), default=(0, 0, ""))
        if top[0] <= 0:
            check([Item("unsupported-format", "no prober knows this input")])
        return self.lookup("demuxer", top[2])

    def bridges(self, s: negotiate.Stream, want: negotiate.Capability) -> list:
        own = [x for c in self.enumerate("bridge") for x in c.bridges(s, want)]
        return own or negotiate.bridges(s, want)


# ---- negotiation


@dataclass(frozen=True)
class Route:
    """Decoder, conversions in front of the encoder, encoder, muxer, and what they carry."""

    decoder: Component
    conversions: tuple[tuple[str, negotiate.Stream], ...]
    encoder: Component
    muxer: Component
    source: negotiate.Stream
    result: negotiate.Stream


def negotiate_route(registry: Registry, source: negotiate.Stream, decoded: negotiate.Stream, codec: str, extension: str | None) -> Route:
    """source: as stored; decoded: behind the filters. The encoder's constraints are met
    by the cheapest conversions, and the muxer must take its codec."""
    decoder, encoder = registry.decoder(source), registry.encoder(codec)
    muxer = registry.muxer(codec, extension)
    steps = negotiate.bridged(decoded, [encoder.capability], registry.bridges)
    if steps is None:
        check([Item("no-bridge", f"{decoded.signature} can't be brought to {encoder.name}: {encoder.capability.reason(decoded)}")])
    last = steps[-1][1] if steps else decoded
    return Route(decoder, tuple(steps), encoder, muxer, source, replace(last, codec=codec))


# ---- catalogs


@dataclass
class Catalog:
    """Every component of a set, sorted; duplicates and conflicts are problems."""

    registry: Registry
    owners: dict[tuple[str, str], str]

    @classmethod
    def build(cls, plugins: Iterable[Plugin]) -> Catalog:
        registry, owners, bad, seen, aliases = Registry(), {}, [], set(), {}
        for p in sorted(plugins, key=lambda p: p.identity):
            bad += [i.under(p.identity) for i in p.descriptor.problems()]
            if p.identity in seen:
                bad.append(Item("duplicate-plugin", p.identity))
                continue
            if (other := aliases.get(p.descriptor.alias)) is not None:
                bad.append(Item("alias-conflict", f"{p.descriptor.alias} is {other}'s", (p.identity,)))
            seen.add(p.identity)
            aliases[p.descriptor.alias] = p.identity
            for c in p.components:
                if (c.kind, c.name) in owners:
                    bad.append(Item("component-conflict", f"{c.kind} {c.name} is {owners[c.kind, c.name]}'s", (p.identity,)))
                else:
                    registry.register(c)
                    owners[c.kind, c.name] = p.identity
        check(bad)
        return cls(registry, owners)

    def describe(self, kind: str, name: str) -> dict[str, Any]:
        c = self.registry.lookup(kind, name)
        return {"kind": kind, "name": name, "plugin": self.owners[kind, name], "priority": self.registry.priority(c), "codecs": list(c.codecs), "fields": c.schema.describe()}

    def resolve(self, kind: str, name: str, explicit: dict[str, Any], preset: str | None = None, *, text: bool = False) -> config.Resolved:
        return self.registry.lookup(kind, name).schema.resolve(explicit, preset, text=text)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.kind, c.name, self.owners[c.kind, c.name], self.registry.priority(c), list(c.codecs)) for c in self.registry.enumerate()]
        return spark.createDataFrame(rows, "kind string, name string, plugin string, priority int, codecs array<string>")


# ---- the same decisions for tables of streams


def reason(want: negotiate.Capability, codec: Column, rate: Column, channels: Column, fmt: Column, layout: Column | None = None) -> Column:
    """Why a stream doesn't fit, as Capability.reason(): an expression."""

    def inside(r: negotiate.Range, c: Column) -> Column:
        ok = c.isin(*r.values) if r.values else F.lit(True)
        ok = ok & (c >= r.low) if r.low else ok
        return ok & (c <= r.high) if r.high else ok

    tests = [("codec", codec.isin(*want.codecs) if want.codecs else None), ("rate", inside(want.rate, rate)), ("channels", inside(want.channels, channels)), ("format", fmt.isin(*want.formats) if want.formats else None)]
    if layout is not None and want.layouts:
        tests.append(("layout", layout.isin(*want.layouts)))
    out = F.lit("")
    for name, ok in reversed([t for t in tests if t[1] is not None]):
        out = F.when(~ok, F.lit(name)).otherwise(out)
    return out


def matches(streams: DataFrame, wants: dict[str, negotiate.Capability], codec: Column, rate: Column, channels: Column, fmt: Column) -> DataFrame:
    """Every stream with every capability (a list of the plan, not a table): columns of the
    stream, capability, reason. No join: the reasons are one array of a row."""
    each = F.array(*[F.struct(F.lit(n).alias("capability"), reason(w, codec, rate, channels, fmt).alias("reason")) for n, w in wants.items()])
    return streams.select("*", F.inline(each))


def resolved(streams: DataFrame, codec: str, registry: Registry, kind: str = "decoder") -> DataFrame:
    """The name of the component that takes each stream's codec (null if none does), by
    priority and then name, as Registry.best()."""
    found = [(k, registry.best([c for c in registry.enumerate(kind) if k in c.codecs], k).name) for k in sorted({k for c in registry.enumerate(kind) for k in c.codecs})]
    table = F.create_map(*[F.lit(x) for pair in found for x in pair]) if found else F.lit(None).cast("map<string,string>")
    return streams.withColumn(kind, table[F.col(codec)])


def default_port(streams: DataFrame, key: str, port: str, is_default: Column, channels: Column, rate: Column) -> DataFrame:
    """Per input the port that counts most: marked as default, then channels times rate,
    then the lowest number."""
    score = F.when(is_default, F.lit(1 << 48)).otherwise(F.lit(0)) + channels * rate
    return streams.groupBy(key).agg(F.max_by(port, F.struct(score.alias("score"), (-F.col(port)).alias("place"))).alias(port))
