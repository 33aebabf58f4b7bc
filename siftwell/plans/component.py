"""Named, configured, fingerprinted components, and the registry that finds them."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import logging
from enum import Enum
from importlib import metadata
from typing import Any

from siftwell.errors import ConfigError, DuplicateComponent, UnknownComponent

log = logging.getLogger(__name__)

#: fixed values: what a secret's name contains; counts such as max_tokens are no secrets
SECRET = ("api_key", "apikey", "access_key", "secret", "password", "credential", "authorization", "auth_token", "access_token", "bearer")
HIDDEN = "<redacted>"

KINDS = (
    "parser", "ocr", "chunker", "enricher", "embedder", "sparse_encoder", "vector_store", "lexical_index", "blob_store", "corpus", "representation", "retriever", "refiner", "generator", "evaluator", "tuner",
)


def is_secret(name: Any) -> bool:
    lower = str(name).lower()
    return lower in ("key", "token") or any(mark in lower for mark in SECRET)


def plain(value: Any, name: Any = "") -> Any:
    """A value as JSON has it, without what a secret's name holds."""
    if is_secret(name):
        return HIDDEN
    match value:
        case Enum():
            return value.value
        case dict():
            return {k: plain(v, k) for k, v in value.items()}
        case list() | tuple() | set():
            return [plain(v) for v in value]
        case Component():
            return value.describe()
    return value


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, default=str)


def digest16(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:16]


class Component:
    """Base of all components: kind, name, version and a Config dataclass (or none)."""

    kind = ""
    name = ""
    version = "0.1.0"
    Config: Any = None

    def __init__(self, config: Any = None, **fields: Any):
        label = type(self).__name__
        if self.Config is None:
            if config is not None or fields:
                raise ConfigError(f"{label} has no configuration")
            self.config = None
            return
        if config is not None and not isinstance(config, self.Config):
            raise ConfigError(f"{label} needs a {label}.Config, not {type(config).__name__}")
        known = {f.name for f in dataclasses.fields(self.Config)}
        if extra := sorted(set(fields) - known):
            raise ConfigError(f"{label} has no field {', '.join(extra)}; it has {', '.join(sorted(known)) or 'none'}")
        try:
            self.config = dataclasses.replace(config, **fields) if config is not None else self.Config(**fields)
        except TypeError as error:
            raise ConfigError(f"{label}: {error}") from error

    def describe(self) -> dict:
        config = {} if self.config is None else {f.name: plain(getattr(self.config, f.name), f.name) for f in dataclasses.fields(self.config)}
        return {"kind": self.kind, "name": self.name, "version": self.version, "config": config}

    def fingerprint(self) -> str:
        return digest16(self.describe())


class Registry:
    """Classes by kind and name; plugins of an entry-point group are loaded when first asked for."""

    def __init__(self, group: str | None = "siftwell.components"):
        self._classes: dict[tuple[str, str], type] = {}
        self._group, self._loaded = group, False

    def register(self, cls: type) -> type:
        key = (cls.kind, cls.name)
        if not all(key):
            raise ConfigError(f"{cls.__name__} needs a kind and a name")
        if self._classes.get(key, cls) is not cls:
            raise DuplicateComponent(f"{key[0]} {key[1]!r} is registered already")
        self._classes[key] = cls
        return cls

    def _plugins(self) -> None:
        if self._loaded or not self._group:
            return
        self._loaded = True
        for point in metadata.entry_points(group=self._group):
            try:
                point.load()
            except Exception:  # a broken plugin must not take the others along
                log.exception("plugin %s was not loaded", point.name)

    def get(self, kind: str, name: str) -> type:
        if (kind, name) not in self._classes:
            self._plugins()
        try:
            return self._classes[kind, name]
        except KeyError:
            raise UnknownComponent(f"no {kind} {name!r}; there are {', '.join(self.available(kind)) or 'none'}") from None

    def create(self, kind: str, name: str, /, *args: Any, **fields: Any) -> Any:
        return self.get(kind, name)(*args, **fields)

    def available(self, kind: str | None = None) -> list[str]:
        self._plugins()
        return sorted(n for k, n in self._classes if kind in (None, k))

    def manifest(self) -> dict[str, list[dict]]:
        """Every component with its configuration fields, for a builder's interface."""
        self._plugins()
        out: dict[str, list[dict]] = {}
        for (kind, name), cls in sorted(self._classes.items()):
            fields = [] if cls.Config is None else [{"name": f.name, "type": str(f.type), "default": None if f.default is dataclasses.MISSING else plain(f.default, f.name), "secret": is_secret(f.name)} for f in dataclasses.fields(cls.Config)]
            out.setdefault(kind, []).append({"name": name, "version": cls.version, "doc": (cls.__doc__ or "").strip().split("\n")[0], "fields": fields})
        return out


registry = Registry()
