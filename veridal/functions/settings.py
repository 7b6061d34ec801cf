"""Settings of the driver: where a value comes from, its kind, and its bounds."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")

_PAIR = re.compile(r"([^=#][^=]*)=(.*)")

Value = str | int | float | bool


class SettingsError(ValueError):
    """A setting that is absent or out of bounds."""


@dataclass(frozen=True)
class Bound:
    """The least and the greatest value, and one that is too small already; None where there is none."""

    least: float | None = None
    most: float | None = None
    above: float | None = None

    def check(self, name: str, value: float) -> float:
        if self.above is not None and value <= self.above:
            raise SettingsError(f"{name} must be above {self.above}")
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise SettingsError(f"{name} must lie between {self.least} and {self.most}")
        return value


@dataclass(frozen=True)
class Setting:
    """A name, what it is without a source, and what it may be: ``text``, ``url``, ``whole``, ``real`` or ``flag``."""

    name: str
    default: str = ""
    kind: str = "text"
    bound: Bound = Bound()


def dotenv(text: str) -> dict[str, str]:
    """Pairs of a settings file. Blank lines and comments say nothing, any other line must be a pair; the last one of a name counts."""
    out = {}
    for number, line in enumerate(map(str.strip, text.splitlines()), 1):
        if not line or line.startswith("#"):
            continue
        pair = _PAIR.fullmatch(line)
        if pair is None:
            raise SettingsError(f"line {number} of the settings file is no pair")
        out[pair[1].strip()] = pair[2].strip().strip('"').strip("'")
    return out


def resolved(name: str, override: object, environment: Mapping[str, str], file: Mapping[str, str], default: str = "") -> str:
    """An override, else the environment, else the file, else the default, trimmed; a blank one hides those behind it."""
    if override is not None:
        return str(override).strip()
    return next((source[name].strip() for source in (environment, file) if name in source), default)


def number(name: str, text: str, bound: Bound = Bound(), whole: bool = False) -> float:
    try:
        value = int(text) if whole else float(text)
    except ValueError:
        raise SettingsError(f"{name} is not a number") from None
    if value != value:
        raise SettingsError(f"{name} is not a number")
    return bound.check(name, value)


def boolean(name: str, text: str) -> bool:
    low = text.strip().lower()
    if low not in TRUE + FALSE:
        raise SettingsError(f"{name} is neither true nor false")
    return low in TRUE


def value_of(setting: Setting, text: str) -> Value:
    """The value that a text gives; text must not be empty, an address starts with its protocol."""
    if setting.kind == "flag":
        return boolean(setting.name, text)
    if setting.kind in ("whole", "real"):
        return number(setting.name, text, setting.bound, setting.kind == "whole")
    if not text:
        raise SettingsError(f"{setting.name} is not set")
    if setting.kind == "url" and not text.startswith(("https://", "http://")):
        raise SettingsError(f"{setting.name} must begin with https:// or http://")
    return text


def load(profile: Sequence[Setting], environment: Mapping[str, str], file: str = "", overrides: Mapping[str, object] | None = None) -> dict[str, Value]:
    """All settings of a profile by name, checked."""
    pairs, overrides = dotenv(file), overrides or {}
    return {s.name: value_of(s, resolved(s.name, overrides.get(s.name), environment, pairs, s.default)) for s in profile}


def generator(flow: str, model: str) -> list[Setting]:
    """The settings of a generator; ``model`` is its default, and the shared model's name is never asked for."""
    return [  # fixed values: names, defaults and bounds
        Setting("VLLM_BASE_URL", kind="url"),
        Setting("VLLM_CLIENT_ID"),
        Setting("VLLM_CLIENT_SECRET"),
        Setting("VLLM_PROJECT_ID"),
        Setting(f"{flow}_MODEL", model),
        Setting("VLLM_TIMEOUT_SECONDS", "120", "real", Bound(above=0)),
        Setting("VLLM_MAX_TOKENS", "1024", "whole", Bound(least=64)),
        Setting("VLLM_MAX_RETRIES", "3", "whole", Bound(least=1)),
        Setting("VLLM_MAX_REQUESTS_PER_MINUTE", "150", "whole", Bound(least=1)),
        Setting("VLLM_ENABLE_THINKING", "true", "flag"),
    ]


#: The settings of the judge; fixed values as above.
JUDGE = [
    Setting("GEMINI_API_KEY"),
    Setting("GEMINI_MODEL", "gemini-2.5-pro"),
    Setting("GEMINI_TIMEOUT_SECONDS", "120", "real", Bound(above=0)),
    Setting("GEMINI_MAX_TOKENS", "4096", "whole", Bound(least=256)),
    Setting("GEMINI_MAX_RETRIES", "5", "whole", Bound(least=0)),
]
