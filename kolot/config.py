"""Settings of a reading, with a strict parser for their JSON and key=value forms."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from enum import Enum


class NormalizerError(RuntimeError):
    """A call that is refused."""


class ConfigError(NormalizerError, ValueError):
    """Unknown key, wrong value or malformed text."""


class Clock(str, Enum):
    H12 = "12"
    H24 = "24"


class DateOrder(str, Enum):
    DMY = "dmy"
    MDY = "mdy"


class HebrewDateStyle(str, Enum):
    LETTERS = "letters"
    NUMBERS = "numbers"


class Gender(str, Enum):
    MASC = "m"
    FEM = "f"


@dataclass(frozen=True)
class Config:
    """How to read. `default_currency` is accepted and has no effect."""

    clock: Clock = Clock.H12
    date_order: DateOrder = DateOrder.DMY
    hebrew_date_style: HebrewDateStyle = HebrewDateStyle.LETTERS
    default_currency: str = "ILS"
    read_minor_currency: bool = True
    decimal_word: str = "נקודה"
    expand_units: bool = True
    expand_abbreviations: bool = True
    strip_markdown: bool = True
    clean_whitespace: bool = True
    gender_overrides: dict[str, Gender] = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Config:
        """From plain values; an unknown key or a value of another kind is an error."""
        defaults = cls()
        known = {f.name for f in fields(cls)}
        out = {}
        for key, value in values.items():
            if key not in known:
                raise ConfigError(f"unknown setting {key!r}")
            like = getattr(defaults, key)
            try:
                if key == "gender_overrides":
                    out[key] = {str(w): Gender(g) for w, g in dict(value).items()}
                elif isinstance(like, Enum):
                    out[key] = type(like)(value)
                elif type(value) is type(like):
                    out[key] = value
                else:
                    raise ValueError(value)
            except (TypeError, ValueError) as e:
                raise ConfigError(f"{key}: {value!r} is not allowed") from e
        return cls(**out)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Blank text gives the defaults; so do missing keys."""
        if not text.strip():
            return cls()
        try:
            values = json.loads(text)
        except json.JSONDecodeError as e:
            raise ConfigError(str(e)) from e
        if not isinstance(values, dict):
            raise ConfigError("settings must be an object")
        return cls.of(values)

    def to_json(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self)}, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_spec(cls, spec: str) -> Config:
        """From ``key=value;key=value``; gender_overrides is ``word:m,word:f``. A key given twice is an error."""
        yes_no = {w: True for w in ("true", "yes", "on", "1")} | {w: False for w in ("false", "no", "off", "0")}
        values: dict = {}
        for part in filter(None, map(str.strip, spec.split(";"))):
            key, eq, raw = (x.strip() for x in part.partition("="))
            if not eq or key in values:
                raise ConfigError(f"{part!r}: given twice, or without a value")
            if key == "gender_overrides":
                pairs = [p.partition(":") for p in raw.split(",") if p.strip()]
                values[key] = {w.strip(): g.strip() for w, _, g in pairs}
            elif isinstance(getattr(cls(), key, None), bool):
                if raw.lower() not in yes_no:
                    raise ConfigError(f"{key}: {raw!r} is neither true nor false")
                values[key] = yes_no[raw.lower()]
            else:
                values[key] = raw
        return cls.of(values)


SCHEMA = "clock STRING, date_order STRING, hebrew_date_style STRING, default_currency STRING, read_minor_currency BOOLEAN, decimal_word STRING, expand_units BOOLEAN, expand_abbreviations BOOLEAN, strip_markdown BOOLEAN, clean_whitespace BOOLEAN, gender_overrides MAP<STRING, STRING>"
