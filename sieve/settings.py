"""Driver-side settings: environment files, flags and lists, JSON configuration with fallbacks."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, MutableMapping
from dataclasses import dataclass, field
from pathlib import Path

from sieve.functions.places import canonical_places

TRUE = ("1", "true", "yes", "on")
PREFIX = "SIEVE_"


def load_env(path: str | os.PathLike, env: MutableMapping[str, str]) -> None:
    """NAME=value lines, quotes dropped; what the environment has already stays.  A missing file is none."""
    if not Path(path).is_file():
        return
    for line in Path(path).read_text("utf-8-sig").splitlines():
        name, mark, value = line.strip().partition("=")
        if mark and name.strip() and not name.startswith("#"):
            env.setdefault(name.strip(), value.strip().strip("\"'"))


def flag(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    text = env.get(name, "").strip().lower()
    return text in TRUE if text else default


def listed(env: Mapping[str, str], name: str) -> list[str]:
    return [x.strip() for x in env.get(name, "").split(",") if x.strip()]


def load_json(*candidates: str | os.PathLike | None) -> dict:
    """The first candidate that is a file; a byte-order mark is tolerated."""
    for c in candidates:
        if c and Path(c).is_file():
            return json.loads(Path(c).read_text("utf-8-sig"))
    raise FileNotFoundError(", ".join(str(c) for c in candidates if c))


@dataclass(frozen=True)
class Settings:
    # The defaults of a run.
    zone: str = "America/Edmonton"
    weekday: int = 0
    hour: int = 9
    provider: str = "twilio_whatsapp"
    recipients: tuple[str, ...] = ()
    most_jobs: int = 30
    least_jobs: int = 15
    most_per_company: int = 2
    cities: tuple[str, ...] = field(default_factory=lambda: tuple(canonical_places([])))
    remote_ok: bool = False
    rank_without_model: bool = False
    send_empty: bool = False

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Settings:
        """Settings from variables with the prefix; the defaults above where one is blank."""
        base = cls()

        def text(name: str, default: str) -> str:
            return env.get(PREFIX + name, "").strip() or default

        return cls(
            zone=text("ZONE", base.zone), weekday=int(text("WEEKDAY", str(base.weekday))), hour=int(text("HOUR", str(base.hour))), provider=text("PROVIDER", base.provider),
            recipients=tuple(listed(env, PREFIX + "RECIPIENTS")), most_jobs=max(1, int(text("MOST_JOBS", str(base.most_jobs)))), least_jobs=max(0, int(text("LEAST_JOBS", str(base.least_jobs)))),
            most_per_company=max(1, int(text("MOST_PER_COMPANY", str(base.most_per_company)))), cities=tuple(canonical_places(listed(env, PREFIX + "CITIES"))),
            remote_ok=flag(env, PREFIX + "REMOTE_OK"), rank_without_model=flag(env, PREFIX + "RANK_WITHOUT_MODEL"), send_empty=flag(env, PREFIX + "SEND_EMPTY"),
        )
