"""Source manifests, the engine's configuration and the manifest of a digested store: strict, small, driver side."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, field, fields
from typing import Any

import yaml

from . import log
from .matcher import NOISE, Matcher

SOURCE_FILE, CONFIG_FILE = "corpus.yaml", "papyrix.yaml"


def _strict(cls, data: Any, where: str):
    """A dataclass from a mapping; unknown keys are an error."""
    data = data or {}
    if not isinstance(data, dict):
        raise ValueError(f"{where}: not a mapping")
    known = {f.name: f for f in fields(cls)}
    if unknown := sorted(set(data) - set(known)):
        raise ValueError(f"{where}: unknown field {', '.join(unknown)}")
    return cls(**data)


def _read(path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


@dataclass
class SourceManifest:
    type: str = ""
    name: str = ""
    author: str = ""
    title: str = ""
    notes: str = ""
    priority: int = 0
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def validate(self, known_types: list[str]) -> None:
        if not re.fullmatch(r"[a-z0-9_-]{1,64}", self.name):
            raise ValueError(f"bad source name {self.name!r}: 1 to 64 of a-z, 0-9, _ and -")
        if self.type not in known_types:
            raise ValueError(f"unknown source type {self.type!r}: one of {', '.join(sorted(known_types))}")

    def matcher(self) -> Matcher:
        return Matcher([*self.exclude, *NOISE])


def load_source(folder: str, known_types: list[str]) -> SourceManifest:
    path = os.path.join(folder, SOURCE_FILE)
    made = _strict(SourceManifest, _read(path), path)
    made.validate(known_types)
    return made


def discover(root: str) -> list[str]:
    """Folders that hold a source manifest, sorted; what lies below one is its own."""
    found = []
    for folder, below, files in os.walk(root):
        if SOURCE_FILE in files:
            found.append(folder)
            below.clear()
    return sorted(found)


def suggest_name(folder: str) -> str:
    name = re.sub(r"[^a-z0-9_-]+", "-", os.path.basename(os.path.abspath(folder)).lower()).strip("-")[:64]
    return name or "source"


def _write_new(path: str, text: str) -> None:
    with open(path, "x", encoding="utf-8") as f:  # never over an existing file
        f.write(text)


def write_source_starter(folder: str, name: str, kind: str) -> None:
    _write_new(os.path.join(folder, SOURCE_FILE), f"type: {kind}\nname: {name}\nauthor: ''\ntitle: ''\nnotes: ''\npriority: 0\ninclude: []\nexclude: []\n")


@dataclass
class Defaults:
    source: str = "."
    digested: str = "digested"
    hits: int = 10
    workers: int = 0
    verbose: bool = False


@dataclass
class EmbedConfig:
    """Without ``base_url`` texts are embedded by hashing, which finds equal texts and no like ones."""

    base_url: str = ""
    model: str = "hash-embedder"


@dataclass
class Config:
    defaults: Defaults = field(default_factory=Defaults)
    embed: EmbedConfig = field(default_factory=EmbedConfig)


def load_config(explicit: str | None = None, default: str = CONFIG_FILE) -> Config:
    """The named file, which must exist, or the default one, which may be absent."""
    if explicit is None and not os.path.exists(default):
        return Config()
    path = explicit or default
    raw = _read(path) or {}
    if unknown := sorted(set(raw) - {"defaults", "embed"}):
        raise ValueError(f"{path}: unknown field {', '.join(unknown)}")
    return Config(_strict(Defaults, raw.get("defaults"), path), _strict(EmbedConfig, raw.get("embed"), path))


def write_config_starter(path: str = CONFIG_FILE) -> None:
    _write_new(path, yaml.safe_dump(asdict(Config()), sort_keys=False))


@dataclass
class StoredSource:
    name: str
    type: str
    priority: int = 0
    documents: int = 0
    chunks: int = 0
    source_dir: str = ""
    digested_at: str = ""
    version: int = 0
    tokens: int = 0
    #: Versions that count beside ``version``: what a stream has added. ``stream`` and ``batch`` tell how far it has come.
    segments: list = field(default_factory=list)
    stream: str = ""
    batch: int = -1

    @property
    def versions(self) -> list[int]:
        return [self.version, *self.segments]


@dataclass
class StoreManifest:
    version: int = 1
    embed: dict = field(default_factory=dict)
    chunking: dict = field(default_factory=dict)
    sources: list = field(default_factory=list)

    def set_source(self, source: StoredSource) -> None:
        kept = [s for s in self.sources if s["name"] != source.name]
        self.sources = sorted([*kept, asdict(source)], key=lambda s: s["name"])

    def version_of(self, name: str) -> int:
        """The last version of a source that counts, or 0."""
        return max((v for s in self.entries(name) for v in s.versions), default=0)

    def entries(self, name: str | None = None) -> list[StoredSource]:
        """Sources as stored, all or the one named."""
        return [StoredSource(**s) for s in self.sources if name in (None, s["name"])]

    def sizes(self, source: str | None = None) -> tuple[int, int]:
        """Passages and their tokens, of one source or all: what ranking needs to know of a corpus."""
        some = [s for s in self.sources if source is None or s["name"] == source]
        return sum(s["chunks"] for s in some), sum(s.get("tokens", 0) for s in some)

    def check_embed(self, model: str, dimensions: int, digest: str) -> None:
        """Vectors of different models never meet in one store."""
        want = {"model": model, "dimensions": dimensions, "digest": digest}
        if self.sources and self.embed and self.embed != want:
            raise ValueError(f"the store was embedded with {self.embed}, not {want}")
        self.embed = want

    def check_chunking(self, target: int, longest: int, shortest: int) -> None:
        want = {"target": target, "max": longest, "min": shortest}
        if self.sources and self.chunking and self.chunking != want:
            raise ValueError(f"the store was chunked with {self.chunking}, not {want}")
        self.chunking = want

    def priorities(self) -> dict[str, int]:
        return {s["name"]: s.get("priority", 0) for s in self.sources}


class Conflict(ValueError):
    """Another digest of the same source was committed meanwhile."""


def load_store_manifest(base: str, at: int | None = None) -> StoreManifest:
    """The store's last state, or the one numbered ``at``; an empty one if there is none."""
    held = log.states(base)
    if at is not None and at not in held:
        raise ValueError(f"{base} has no state {at}")
    if not held:
        return StoreManifest()
    number = held[-1] if at is None else at
    return _strict(StoreManifest, yaml.safe_load(log.read(base, number)), f"{base} at {number}")


def commit_source(base: str, began: StoreManifest, source: StoredSource) -> StoreManifest:
    """Put ``source`` into the store's last state, in place of what ``began`` has of it, and return the state written.

    What other digests have committed since ``began`` stays, as the state is read anew until no one else is first. If the same
    source is among it, or vectors or passages of another kind, nothing is written and this is a Conflict.
    """
    entry = lambda m: next((s for s in m.sources if s["name"] == source.name), None)
    while True:
        held = log.states(base)
        now = load_store_manifest(base, held[-1]) if held else StoreManifest()
        if entry(now) != entry(began):
            raise Conflict(f"{source.name} was digested by someone else meanwhile")
        for kind in ("embed", "chunking"):
            if now.sources and getattr(now, kind) != getattr(began, kind):
                raise Conflict(f"the store was begun with other settings meanwhile: {kind} {getattr(now, kind)}")
            setattr(now, kind, getattr(began, kind))
        now.set_source(source)
        if log.create(base, (held[-1] if held else 0) + 1, yaml.safe_dump(asdict(now), sort_keys=False)):
            return now
