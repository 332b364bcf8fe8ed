"""Settings: a table of keys with their kinds and defaults, read from YAML and checked.

A key stands with its kind, its default and its bounds; what several keys of a section have
to keep to stands in the section's Group. Settings are read-only and give access by
attribute: ``load(path).sws.quality.gamma``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isfinite
from pathlib import Path
from typing import Any

from fastaxis.operators.windows import FILTER_BANK


class ConfigError(ValueError):
    """A configuration that can't be used."""


Kind = Callable[[Any], bool]
number: Kind = lambda v: type(v) in (int, float) and isfinite(v)
whole: Kind = lambda v: type(v) is int
text: Kind = lambda v: type(v) is str
flag: Kind = lambda v: type(v) is bool


def optional(kind: Kind) -> Kind:
    return lambda v: v is None or kind(v)


def list_of(kind: Kind) -> Kind:
    return lambda v: type(v) is list and all(map(kind, v))


@dataclass(frozen=True)
class Bound:
    """What a value keeps to, in words and as a test; ``broken`` is a value of the right kind that doesn't."""

    says: str
    holds: Callable[[Any], bool]
    broken: Any


def at_least(low: float) -> Bound:
    return Bound(f"at least {low}", lambda v: v >= low, low - 1)


def above(low: float) -> Bound:
    return Bound(f"above {low}", lambda v: v > low, low)


def at_most(high: float) -> Bound:
    return Bound(f"at most {high}", lambda v: v <= high, high + 1)


def one_of(*values: str, folded: bool = False) -> Bound:
    return Bound("one of " + ", ".join(values), lambda v: (v.upper() if folded else v) in values, "".join(values))


@dataclass(frozen=True)
class Key:
    """A setting: its kind, its default and its bounds."""

    kind: Kind
    default: Any
    bounds: tuple[Bound, ...] = ()


@dataclass(frozen=True)
class Group:
    """A section whose settings also depend on each other: (which, what holds of their values, in words)."""

    keys: dict[str, Any]
    together: tuple[tuple[tuple[str, ...], Callable[..., bool], str], ...]


#: Each entry of a filter bank is a pair of corner frequencies, the lower one first.
_BANDS = Bound("pairs of a lower and a higher frequency", lambda bank: all(len(b) == 2 and b[0] < b[1] for b in bank), [[8, 2]])
_ORDERED = (lambda a, b: a <= b, "must not fall")

#: Section, key: a Key. Nested sections are nested mappings, or a Group of one.
KEYS: dict[str, Any] = {
    "seiscomp": {"host": Key(optional(text), None), "database": Key(optional(text), None), "wait_time": Key(whole, 300, (at_least(0),)), "reprocess": Key(flag, False)},
    "sds": {"archive": Key(text, "/data/archive")},
    "velocity_model": {"path": Key(text, "velocity_models/local.nd")},
    "waveform": {"t_before": Key(number, 10.0), "t_after": Key(number, 60.0), "target_sampling_rate": Key(number, 100.0, (above(0),)), "decimate": Key(flag, True), "min_gap": Key(number, 1.0, (above(0),))},
    "sws": {
        "blacklist_stations": Key(list_of(text), []),
        "max_ain": Key(number, 60.0),
        "min_tkf": Key(number, 90.0),
        "max_delay_ms": Key(number, 400.0, (above(0),)),
        "snr_min": Key(number, 3.0, (at_least(0),)),
        "rotation_mode": Key(text, "ZRT", (one_of("ZRT", "LQT"),)),
        "filter_bank": Key(list_of(list_of(number)), [list(b) for b in FILTER_BANK], (_BANDS,)),
        "windows": Group(
            {"tbeg0": Key(number, -0.5), "tbeg1": Key(number, -0.1, (at_most(0),)), "tend0": Key(number, 0.1, (at_least(0),)), "tend1": Key(number, 0.4), "dtbeg": Key(number, 0.05, (above(0),)), "dtend": Key(number, 0.01, (above(0),)), "nbeg": Key(whole, 10, (above(0),)), "nend": Key(whole, 20, (above(0),))},
            ((("tbeg0", "tbeg1"), *_ORDERED), (("tend0", "tend1"), *_ORDERED)),
        ),
        "cluster": {"linkage": Key(text, "ward", (one_of("ward", "single", "complete", "average"),)), "k_max": Key(whole, 20, (at_least(2),)), "n_min": Key(whole, 10, (at_least(1),)), "ccrit": Key(number, 3.2)},
        "consensus": {"enabled": Key(flag, False), "n_best_filters": Key(whole, 1, (at_least(1),)), "phi_tolerance": Key(number, 15.0), "dt_tolerance": Key(number, 0.02)},
        "quality": Group(
            {"gamma": Key(number, 0.75, (above(0), at_most(1))), "omega1": Key(number, 1 / 3), "omega2": Key(number, 2 / 3)},
            ((("omega1", "omega2"), lambda a, b: abs(a + b - 1) <= 1e-9, "must add up to 1"),),
        ),
    },
    "logging": {"level": Key(text, "DEBUG", (one_of("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", folded=True),)), "file": Key(optional(text), None)},
    "processing": {"n_cores": Key(whole, -1, (Bound("-1 or above 0", lambda v: v == -1 or v > 0, 0),))},
}


class Settings:
    """A read-only section."""

    def __init__(self, values: dict[str, Any]):
        self.__dict__.update(values)

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("settings are read-only")

    def __iter__(self) -> Iterator[tuple[str, Any]]:
        return iter(self.__dict__.items())

    def to_dict(self) -> dict[str, Any]:
        return {k: v.to_dict() if isinstance(v, Settings) else v for k, v in self}


def keys(node: Any = None, where: str = "") -> Iterator[tuple[str, Key]]:
    """Every setting's dotted path and Key."""
    node = KEYS if node is None else node
    for name, entry in (node.keys if isinstance(node, Group) else node).items():
        path = f"{where}.{name}" if where else name
        if isinstance(entry, Key):
            yield path, entry
        else:
            yield from keys(entry, path)


def _checked(key: Key, value: Any, path: str) -> Any:
    if not key.kind(value):
        raise ConfigError(f"{path} has a value of the wrong kind")
    for bound in key.bounds:
        if not bound.holds(value):
            raise ConfigError(f"{path} must be {bound.says}")
    return list(value) if isinstance(value, list) else value


def _merged(node: Any, given: Any, where: str) -> Settings:
    if not isinstance(given, dict):
        raise ConfigError(f"{where or 'the configuration'} is no mapping")
    own = node.keys if isinstance(node, Group) else node
    if unknown := sorted(map(str, set(given) - set(own))):
        raise ConfigError(f"unknown in {where or 'the configuration'}: {', '.join(unknown)}")
    out: dict[str, Any] = {}
    for name, entry in own.items():
        path = f"{where}.{name}" if where else name
        if isinstance(entry, Key):
            out[name] = _checked(entry, given.get(name, entry.default), path)
        else:
            out[name] = _merged(entry, given.get(name, {}), path)
    for names, holds, says in node.together if isinstance(node, Group) else ():
        if not holds(*(out[n] for n in names)):
            raise ConfigError(f"{where}: {' and '.join(names)} {says}")
    return Settings(out)


def build(given: dict[str, Any] | None = None) -> Settings:
    """Settings from a nested mapping; what it lacks has its default."""
    return _merged(KEYS, {} if given is None else given, "")


def load(path: str | Path) -> Settings:
    """Settings from a YAML file; an empty file gives the defaults."""
    import yaml

    try:
        return build(yaml.safe_load(Path(path).read_text()))
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e.strerror}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML") from e
