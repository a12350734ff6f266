"""The built-in span rules, in one order that settles ties."""

from __future__ import annotations

from functools import cache

from kolot.operators.rules import abbreviations, amounts, calendar, clock, numbers, phones, protect
from kolot.operators.scanner import Rule


@cache
def built_in() -> tuple[Rule, ...]:
    rules = [*protect.RULES, *calendar.RULES, *clock.RULES, *phones.RULES, *amounts.MONEY, *amounts.PERCENTAGES, *amounts.RANGES, *amounts.MEASURES, *abbreviations.RULES, *numbers.RULES]
    return tuple(sorted(rules, key=lambda r: -r.priority))
