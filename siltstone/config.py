"""Configuration: a TOML file, options, and what follows from them. Driver only."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from siltstone.functions.scalars import COLLECTORS, PROFILES
from siltstone.sources.files import toml


@dataclass
class Context:
    """What a run is asked to do."""

    root: str = "."
    output: str = "quality"
    profile: str = "full"
    disabled: tuple[str, ...] = ()
    #: Limits by rule (size:..., complexity:...), the longest line, and absolute thresholds.
    limits: dict[str, int] = field(default_factory=dict)
    max_line: int = 120
    absolute: dict[str, float] = field(default_factory=dict)


def _kebab(section: dict) -> dict:
    """Keys in either spelling."""
    return {k.replace("_", "-"): v for k, v in section.items()}


def load(path: str | None) -> dict:
    """A configuration; one that can't be read is warned about and left out."""
    if not path:
        return {}
    try:
        return toml(path)
    except FileNotFoundError:
        return {}
    except (OSError, ValueError) as e:
        print(f"warning: {path}: {e}", file=sys.stderr)
        return {}


def section(config: dict, name: str) -> dict:
    """[gate.NAME] in place of [gate.defaults] as a whole, not key by key."""
    gate = config.get("gate", {})
    return _kebab(gate[name] if name in gate else gate.get("defaults", {}))


def context(config: dict, *, root: str = ".", output: str | None = None, profile: str | None = None, disabled: str = "") -> Context:
    """Options go before the file, the file before defaults. Unknown names are warned
    about and ignored."""
    asked = (profile or config.get("profile", {}).get("default") or "full").lower()
    if asked not in PROFILES:
        print(f"warning: unknown profile {asked}, using full", file=sys.stderr)
        asked = "full"
    off = [x.strip().lower() for x in disabled.split(",") if x.strip()]
    off += [k for k, v in _kebab(config.get("collectors", {})).items() if v is False]
    for name in off:
        if name not in COLLECTORS:
            print(f"warning: unknown collector {name}", file=sys.stderr)
    size, complexity, loc = section(config, "size"), section(config, "complexity"), section(config, "loc")
    keys = {f"size:{k}": size.get(k) for k in ("max-lines-per-file", "max-code-lines-per-file", "max-lines-per-function", "max-parameters-per-function")}
    keys |= {f"complexity:{k}": complexity.get(k) for k in ("max-cyclomatic-per-function", "max-nesting-depth")}
    limits = {k: int(v) for k, v in keys.items() if v is not None}
    absolute = {k.split(":")[1].replace("-", "_"): float(v) for k, v in limits.items()}
    own = _kebab(config.get("gate", {}).get("absolute", {}))
    absolute |= {k.replace("-", "_"): float(v) for k, v in own.items()}
    if "min-line-percent" in (cover := _kebab(config.get("gate", {}).get("coverage", {}))):
        absolute.setdefault("min_coverage_percent", float(cover["min-line-percent"]))
    return Context(root, output or config.get("output", {}).get("dir", "quality"), asked, tuple(x for x in off if x in COLLECTORS), limits, int(loc.get("max-line-length", 120)), absolute)
