"""Settings: an immutable record, read from and written to a small JSON file on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, replace
from pathlib import Path

# What the settings cycle through (intervals in nanoseconds).
INTERVALS = (500_000_000, 1_000_000_000, 2_000_000_000, 5_000_000_000)
MAX_PROCESSES = (20, 50, 100, 200)


def cycled(choices: tuple, current, step: int = 1):
    """The choice after (or before) the current one; an unknown current value counts as the first choice."""
    at = choices.index(current) if current in choices else 0
    return choices[(at + step) % len(choices)]


@dataclass(frozen=True)
class Settings:
    update_interval: int = 1_000_000_000
    temperature_unit: str = "C"
    show_system_processes: bool = False
    max_processes: int = 50
    mouse_enabled: bool = True

    @classmethod
    def parse(cls, text: str | None) -> Settings:
        """Missing or malformed text: all defaults. In a valid object, zero and missing numbers and texts take defaults and missing flags are false."""
        try:
            got = json.loads(text) if text else None
        except ValueError:
            got = None
        if not isinstance(got, dict):
            return cls()
        base = cls()
        return cls(got.get("update_interval") or base.update_interval, got.get("temperature_unit") or base.temperature_unit, bool(got.get("show_system_processes")), got.get("max_processes") or base.max_processes, bool(got.get("mouse_enabled")))

    @classmethod
    def load(cls, path: str | os.PathLike) -> Settings:
        path = Path(path)
        return cls.parse(path.read_text() if path.exists() else None)

    def save(self, path: str | os.PathLike) -> None:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(asdict(self), indent=2))
        path.chmod(0o644)

    def changed(self, field: str, step: int = 1) -> Settings:
        """The settings with one field moved to its next (or, with step -1, previous) value."""
        moves = {
            "update_interval": lambda v: cycled(INTERVALS, v, step), "temperature_unit": lambda v: "F" if v == "C" else "C",
            "max_processes": lambda v: cycled(MAX_PROCESSES, v, step), "show_system_processes": lambda v: not v, "mouse_enabled": lambda v: not v,
        }
        return replace(self, **{field: moves[field](getattr(self, field))})


def default_path(home: str | None = None) -> Path:
    """Where settings are kept: a JSON file in the user's configuration folder."""
    return Path(home or Path.home()) / ".config" / "tidegauge" / "settings.json"
