"""Search spaces of pipeline configurations, and the specs that they expand to."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from siftwell.errors import ConfigError

#: fixed values: the stages of a spec in pipeline order, their kinds, and which are chains
STAGES = {"parser": "parser", "chunker": "chunker", "enrich": "enricher", "representations": "representation", "retriever": "retriever", "refine": "refiner", "generator": "generator"}
GIVEN = {"vector_store": "vector_store", "blob_store": "blob_store"}
CHAINS = ("enrich", "representations", "refine")


@dataclass(frozen=True)
class Choice:
    """A component and its parameters; a list is an axis, a tuple one value, a nested choice its own expansions."""

    name: str
    params: Mapping[str, Any] = field(default_factory=dict)

    def expand(self) -> Iterator[dict]:
        return alternatives(self)


def alternatives(value: Any) -> Iterator[Any]:
    """What a parameter may be: each entry of a list, each spec of a choice, or the value itself."""
    return (picked(value, i) for i in range(counted(value)))


def counted(value: Any) -> int:
    """How many alternatives there are, without listing them."""
    return sum(math.prod(map(counted, v.params.values())) if isinstance(v, Choice) else 1 for v in (value if isinstance(value, list) else [value]))


def picked(value: Any, i: int) -> Any:
    """The i-th alternative; of a choice's parameters, in the order of their names, the last varies fastest."""
    for item in value if isinstance(value, list) else [value]:
        n = counted([item])
        if i >= n:
            i -= n
        elif not isinstance(item, Choice):
            return item
        else:
            names = sorted(item.params)
            digits = digits_of(i, [counted(item.params[k]) for k in names])
            return {"name": item.name, "params": {k: picked(item.params[k], d) for k, d in zip(names, digits, strict=True)}}
    raise IndexError("there are fewer alternatives")


def digits_of(i: int, sizes: Sequence[int]) -> list[int]:
    """i as digits of the bases sizes, the last of them varying fastest."""
    out = []
    for n in reversed(sizes):
        i, digit = divmod(i, n)
        out.append(digit)
    return out[::-1]


def choice(name: str, **params: Any) -> Choice:
    if not isinstance(name, str) or not name:
        raise ConfigError(f"a choice needs a component's name, not {name!r}")
    if empty := [k for k, v in params.items() if isinstance(v, list) and not v]:
        raise ConfigError(f"choice {name!r}: nothing to try for {', '.join(empty)}")
    return Choice(name, params)


class SearchSpace:
    """Options for each stage; expands with the earliest stage varying slowest, so that trials share their beginnings."""

    def __init__(self, **stages: Any):
        if unknown := sorted(set(stages) - set(STAGES)):
            raise ConfigError(f"no stage {', '.join(unknown)}; there are {', '.join(STAGES)}")
        for stage, options in stages.items():
            if not isinstance(options, (list, tuple)) or not options:
                raise ConfigError(f"{stage} needs a list of options")
            for option in options:
                links = option if stage in CHAINS else [option]
                if not isinstance(links, (list, tuple)):
                    raise ConfigError(f"an option of {stage} is a list of choices")
                if not all(isinstance(link, Choice) for link in links):
                    raise ConfigError(f"{stage} takes choice(...) options")
        self.stages = {s: list(stages[s]) for s in STAGES if s in stages}

    def dimensions(self) -> list[str]:
        return list(self.stages)

    def _sizes(self, stage: str) -> list[int]:
        """Of each option of a stage, how many values it expands to."""
        return [math.prod(map(counted, option)) if stage in CHAINS else counted(option) for option in self.stages[stage]]

    def option(self, stage: str, i: int) -> Any:
        """The i-th value of a stage."""
        for given, n in zip(self.stages[stage], self._sizes(stage), strict=True):
            if i < n:
                return [picked(link, d) for link, d in zip(given, digits_of(i, list(map(counted, given))), strict=True)] if stage in CHAINS else picked(given, i)
            i -= n
        raise IndexError(f"{stage} has fewer options")

    def options(self, stage: str) -> list:
        return [self.option(stage, i) for i in range(sum(self._sizes(stage)))]

    def size(self) -> int:
        return math.prod(sum(self._sizes(s)) for s in self.stages)

    def at(self, i: int) -> dict:
        """The i-th spec of the expansion, made from its number alone."""
        if not 0 <= i < self.size():
            raise IndexError(f"there are {self.size()} specs")
        digits = digits_of(i, [sum(self._sizes(s)) for s in self.stages])
        return {s: self.option(s, d) for s, d in zip(self.stages, digits, strict=True)}

    def expand(self) -> Iterator[dict]:
        return (self.at(i) for i in range(self.size()))

    def __len__(self) -> int:
        return self.size()


def validate_spec(spec: Mapping[str, Any]) -> None:
    """Raises ConfigError unless spec maps stages to {name, params} (a chain to a list of them)."""
    if not isinstance(spec, Mapping):
        raise ConfigError("a spec is a mapping of stages")
    for stage, entry in spec.items():
        if stage not in STAGES and stage not in GIVEN:
            raise ConfigError(f"no stage {stage!r}; there are {', '.join([*STAGES, *GIVEN])}")
        if stage in CHAINS and not isinstance(entry, (list, tuple)):
            raise ConfigError(f"{stage} is a list")
        for link in entry if stage in CHAINS else [entry]:
            if not isinstance(link, Mapping) or not isinstance(link.get("name"), str) or not link["name"]:
                raise ConfigError(f"{stage}: an entry needs a name")
            if extra := sorted(set(link) - {"name", "params"}):
                raise ConfigError(f"{stage}: unknown {', '.join(extra)}")
            if not isinstance(link.get("params", {}), Mapping):
                raise ConfigError(f"{stage}: params is a mapping")


def save_spec(spec: Mapping[str, Any], path: str) -> None:
    validate_spec(spec)
    Path(path).write_text(json.dumps(spec, indent=2, sort_keys=True) + "\n")


def load_spec(path: str) -> dict:
    try:
        spec = json.loads(Path(path).read_text())
    except (OSError, ValueError) as error:
        raise ConfigError(f"{path} is no spec: {error}") from error
    validate_spec(spec)
    return spec
