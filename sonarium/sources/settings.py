"""Typed settings from the environment, checked before any job runs."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


class SettingsError(ValueError):
    """What is wrong with the settings, all of it."""


@dataclass(frozen=True)
class Settings:
    """S-19: every value has a default and is read from ``SONARIUM_<NAME>``."""

    min_field_confidence: float = 0.6
    min_write_confidence: float = 0.8
    required: tuple[str, ...] = ("title", "artist", "album", "year", "genre")
    providers: tuple[str, ...] = ("local_cleanup", "rules_inference")
    enabled: tuple[str, ...] = ("local_cleanup", "rules_inference")
    paid: tuple[str, ...] = ()
    paid_only_if_missing: bool = True
    paid_cap: int = 0
    cache_days: float = 14.0
    weights: dict = field(default_factory=dict)


def _parse(kind, text: str):
    if kind in ("bool", bool):
        low = text.strip().lower()
        if low not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(text)
        return low in ("1", "true", "yes", "on")
    if kind in ("float", float):
        return float(text)
    if kind in ("int", int):
        return int(text)
    if str(kind).startswith("tuple"):
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return {k.strip(): float(v) for k, v in (x.split("=") for x in text.split(",") if x.strip())}


def load(env: dict[str, str] | None = None) -> Settings:
    """Settings from an environment; unreadable values are reported together."""
    env, found, wrong = os.environ if env is None else env, {}, []
    for f in fields(Settings):
        text = env.get("SONARIUM_" + f.name.upper())
        if text is not None:
            try:
                found[f.name] = _parse(f.type, text)
            except ValueError:
                wrong.append(f"{f.name}: {text!r}")
    if wrong:
        raise SettingsError("; ".join(wrong))
    settings = Settings(**found)
    check(settings)
    return settings


def heads(text: str) -> list[dict[str, str]]:
    """G-05: further heads of a model from ``model|labels[|output]`` entries between semicolons; incomplete ones are an error."""
    found = []
    for entry in filter(None, (x.strip() for x in text.split(";"))):
        parts = [x.strip() for x in entry.split("|")]
        if len(parts) not in (2, 3) or not all(parts[:2]):
            raise SettingsError(f"not model|labels[|output]: {entry!r}")
        found.append({"model": parts[0], "labels": parts[1], "output": parts[2] if len(parts) == 3 else ""})
    return found


def check(s: Settings) -> list[str]:
    """S-20, U-04: range errors raise together; dropped providers are returned as warnings."""
    wrong = [f"{n} must be between 0 and 1" for n in ("min_field_confidence", "min_write_confidence") if not 0 <= getattr(s, n) <= 1]
    wrong += [f"{n} must not be negative" for n in ("paid_cap", "cache_days") if getattr(s, n) < 0]
    wrong += [f"weight of {k} must be between 0 and 1" for k, v in s.weights.items() if not 0 <= v <= 1]
    if wrong:
        raise SettingsError("; ".join(wrong))
    return [f"not enabled: {p}" for p in s.providers if p not in s.enabled]
