"""Dates of both calendars. What looks like a date and is none is claimed and kept, so that no other rule reads it."""

from __future__ import annotations

import calendar
import re

from kolot import lexicon as L
from kolot.config import Config, DateOrder, HebrewDateStyle
from kolot.operators import spoken as S
from kolot.operators.scanner import DATE, WHITE, Rule

# Patterns, the window of two-digit years, the most days of a Hebrew month and of the Omer.
BEFORE = r"(?<![\d./])"
AFTER = r"(?!\d)(?![./-]\d)"
NUMERIC = rf"{BEFORE}(\d{{1,2}})([./-])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){AFTER}"
ISO = rf"{BEFORE}(\d{{4}})-(\d{{2}})-(\d{{2}}){AFTER}"
NAMED = rf"{BEFORE}(\d{{1,2}})\s+ב[־-]?({L.longest_first(L.MONTH_NUMBERS)})(?:\s+(\d{{4}})(?!\d))?"
MONTH_YEAR = rf"{BEFORE}(\d{{1,2}})/(\d{{4}}){AFTER}"
HEBREW_NAMES = L.longest_first([*L.HEBREW_MONTHS, *L.HEBREW_MONTH_SPELLINGS, L.OMER]).replace("\\ ", " ")
HEBREW = rf"(?<![א-ת])(?P<day>[א-ת]״[א-ת]|[א-ת]׳)\s+(?P<prep>[בל]?)(?P<month>{HEBREW_NAMES})(?![א-ת])(?:\s+(?P<year>(?:ה[׳'])?[א-ת]{{1,3}}״[א-ת]))?"
LAST_OF_2000S = 29
DAYS_OF_MONTH, DAYS_OF_OMER = 30, 49


def exists(day: int, month: int, year: int) -> bool:
    return 1 <= year <= 9999 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]


def day_words(day: int) -> str:
    return S.ordinal(1, "m", definite=True) if day == 1 else S.cardinal(day, "m")


def say(day: int | None, month: int, year: int | None) -> str:
    name = L.MONTHS[month - 1]
    said = [name if day is None else f"{day_words(day)} ב{name}"]
    return " ".join(said + ([] if year is None else [S.cardinal(year)]))


def number(digits: str) -> int:
    return S.whole(digits) or 0


def full_year(digits: str) -> int:
    year = number(digits)
    return year if len(digits) == 4 else year + (2000 if year <= LAST_OF_2000S else 1900)


def numeric(m: re.Match[str], cfg: Config) -> str:
    """The order that settings prefer, or the other where that can't be."""
    year, two = full_year(m[4]), (number(m[1]), number(m[3]))
    for day, month in (two, two[::-1])[:: -1 if cfg.date_order == DateOrder.MDY else 1]:
        if exists(day, month, year):
            return say(day, month, year)
    return m[0]


def iso(m: re.Match[str], cfg: Config) -> str:
    year, month, day = map(number, m.groups())
    return say(day, month, year) if exists(day, month, year) else m[0]


def named(m: re.Match[str], cfg: Config) -> str:
    """Without a year, February may have 29 days."""
    day, month, year = number(m[1]), L.MONTH_NUMBERS[m[2]], S.whole(m[3]) if m[3] else None
    return say(day, month, year) if exists(day, month, 2024 if year is None else year) else m[0]


def month_year(m: re.Match[str], cfg: Config) -> str:
    month = number(m[1])
    return say(None, month, number(m[2])) if 1 <= month <= 12 else m[0]


def hebrew(m: re.Match[str], cfg: Config) -> str:
    """A day behind another letter numeral is this rule's own output and is kept."""
    day, month = S.gematria(m["day"]), L.HEBREW_MONTH_SPELLINGS.get(m["month"], m["month"])
    follows = m.string[: m.start()].rstrip(" ").endswith((L.GERESH, L.GERSHAYIM))
    if follows or not 1 <= day <= (DAYS_OF_OMER if month == L.OMER else DAYS_OF_MONTH):
        return m[0]
    if cfg.hebrew_date_style == HebrewDateStyle.LETTERS:
        number_said = " ".join(c + L.GERESH for c in m["day"] if c in L.LETTER_VALUES)
    else:
        number_said = S.cardinal(day, "m")
    said = L.NAMED_DAYS.get((day, month)) or f"{number_said} {m['prep'] or 'ב'}{month}"
    return f"{said} {re.sub('[״׳' + chr(39) + ']', '', m['year'])}" if m["year"] else said


RULES = [
    Rule("date-numeric", DATE, re.compile(NUMERIC), numeric, needs=("./-",), least=6),
    Rule("date-iso", DATE, re.compile(ISO), iso, needs=("-",), least=10),
    Rule("date-textual", DATE, re.compile(NAMED), named, needs=("ב", WHITE)),
    Rule("date-month-year", DATE, re.compile(MONTH_YEAR), month_year, needs=("/",), least=6),
    Rule("date-hebrew", DATE, re.compile(HEBREW), hebrew, needs_digit=False, needs=(L.GERESH + L.GERSHAYIM,)),
]
