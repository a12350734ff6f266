"""Numbers that carry a currency, a percent sign, a unit or a second end."""

from __future__ import annotations

import re

from kolot import lexicon as L
from kolot.config import Config
from kolot.operators import spoken as S
from kolot.operators.scanner import CURRENCY, PERCENT, RANGE, UNIT, WHITE, Rule

# Patterns and the most digits of money and percentages.
AMOUNT = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
NO_WORD_AFTER = rf"(?![{L.HEBREW_BLOCK}0-9A-Za-z׳״])"
MOST_DIGITS = 15
MONEY_SCALE = rf"(?:\s(?P<scale>{'|'.join(L.MONEY_SCALES)}))?"
MONEY_AFTER = rf"(?<![\d,.:/])(?P<amount>{AMOUNT}){MONEY_SCALE}\s?(?P<cur>{L.longest_first(L.CURRENCY_OF)}){NO_WORD_AFTER}"
FOREIGN = [s for s in L.CURRENCY_OF if not re.search(f"[{L.HEBREW_BLOCK}]", s)]
MONEY_BEFORE = rf"(?<![0-9A-Za-z])(?P<cur>{L.longest_first(FOREIGN)})\s?(?P<amount>{AMOUNT}){MONEY_SCALE}{NO_WORD_AFTER}"
PERCENT_SIGN = rf"(?<![\d,.])(?P<amount>{AMOUNT})\s?(?P<sign>[%‰])"
PERCENT_NOUNS = [L.PERCENTS, L.PERCENT, L.PERMILLES, L.PERMILLE]
PERCENT_WORD = rf"(?<![\d,.])(?P<amount>{AMOUNT})\s(?P<noun>{L.longest_first(PERCENT_NOUNS)}){NO_WORD_AFTER}"
SIGN = rf"(?:(?<![{L.HEBREW_BLOCK}\d])(?P<sign>[-−]) ?)?"
MEASURE = rf"{SIGN}(?<![\d.,])(?P<num>{AMOUNT})[ \t]?(?P<unit>{L.longest_first(L.UNIT_OF)})(?![{L.HEBREW_BLOCK}A-Za-z0-9׳״])"
TEMPERATURE = rf"{SIGN}(?<![\d.,])(?P<num>{AMOUNT})[ \t]?°[ \t]?(?P<scale>{'|'.join(L.DEGREE_SCALES)})?(?![{L.HEBREW_BLOCK}A-Za-z0-9])"
END = r"\d+(?:\.\d+)?"
BOTH_ENDS = rf"(?<!\d)(?<![:/])(?P<a>{END})[ ]?[{L.HYPHENS}][ ]?(?P<b>{END})(?!\d)(?![:/]\d)"
WITH_TAIL = rf"{BOTH_ENDS}[ ](?P<tail>[{L.HEBREW_LETTER}]+(?:[״׳][{L.HEBREW_LETTER}]*)?)(?![{L.HEBREW_LETTER}])"


def split(number: str) -> tuple[int | None, str, str]:
    """Whole part (None past 64 bits or of other digits), its digits, and the fraction's digits."""
    head, _, fraction = number.replace(",", "").partition(".")
    return S.whole(head), head, fraction


def money(m: re.Match[str], cfg: Config) -> str | None:
    _, one, many, gender, cent, cents, cent_gender, _ = L.CURRENCY_OF[m["cur"]]
    n, head, fraction = split(m["amount"])
    if n is None or len(head) > MOST_DIGITS:
        return None
    if m["scale"]:
        if fraction:
            said = f"{S.decimal(n, fraction, cfg, 'm')} {m['scale']}"
        else:
            said = m["scale"] if n == 1 else f"{S.cardinal(n, 'm', bound=n == 2)} {m['scale']}"
        return f"{said} {many}"
    if len(fraction) > 2 or (fraction and not cfg.read_minor_currency):
        return f"{S.decimal(n, fraction, cfg, gender)} {many}"
    minor = S.whole(fraction.ljust(2, "0"))
    if minor is None:
        return None
    said = [S.amount(n, one, many, gender)] if n or not minor else []
    return S.glued(said + ([S.amount(minor, cent, cents, cent_gender)] if minor else []))


def percentage(m: re.Match[str], cfg: Config) -> str | None:
    n, head, fraction = split(m["amount"])
    if n is None or len(head) > MOST_DIGITS:
        return None
    groups = m.groupdict()
    if "noun" in groups:
        noun = groups["noun"]
    elif m["sign"] == "‰":
        noun = L.PERMILLE
    else:
        noun = L.PERCENT if n == 1 and not fraction else L.PERCENTS
    return f"{S.decimal(n, fraction, cfg, 'm')} {noun}" if fraction else S.amount(n, noun, noun, "m")


def _measured(m: re.Match[str], cfg: Config, one: str, many: str, gender: str, after_fraction: str) -> str | None:
    n, _, fraction = split(m["num"])
    if n is None:
        return None
    said = f"{S.decimal(n, fraction, cfg)} {after_fraction}" if fraction else S.amount(n, one, many, gender)
    return f"{L.MINUS} {said}" if m["sign"] else said


def measure(m: re.Match[str], cfg: Config) -> str | None:
    """Whole numbers count the unit; after a fraction its singular stands."""
    if not cfg.expand_units:
        return None
    one, many, gender = L.UNIT_OF[m["unit"]]
    return _measured(m, cfg, one, many, gender, one)


def temperature(m: re.Match[str], cfg: Config) -> str | None:
    """Degrees keep the plural after a fraction."""
    said = _measured(m, cfg, L.DEGREE, L.DEGREES, "f", L.DEGREES)
    return said and " ".join(filter(None, [said, L.DEGREE_SCALES.get(m["scale"])]))


def _ends(m: re.Match[str], gender: str, cfg: Config) -> str:
    said = []
    for end in (m["a"], m["b"]):
        n, _, fraction = split(end)
        said.append(end if n is None else S.decimal(n, fraction, cfg, gender) if fraction else S.cardinal(n, gender))
    return f" {L.UNTIL} ".join(said)


def range_of(m: re.Match[str], cfg: Config) -> str | None:
    """Both ends agree with the noun or unit behind them."""
    tail = m["tail"]
    if tail in L.UNIT_OF:
        _, many, gender = L.UNIT_OF[tail]
        return f"{_ends(m, gender, cfg)} {many}" if cfg.expand_units else None
    if L.GERESH in tail or L.GERSHAYIM in tail or len(tail) < 2 or tail in L.NOT_IN_RANGE:
        return None
    return f"{_ends(m, S.noun_gender(tail, cfg), cfg)} {tail}"


MONEY = [Rule("currency-suffix", CURRENCY, re.compile(MONEY_AFTER), money, needs=L.ends(L.CURRENCY_OF)), Rule("currency-prefix", CURRENCY, re.compile(MONEY_BEFORE), money, needs=L.ends(FOREIGN))]
PERCENTAGES = [Rule("percent-sign", PERCENT, re.compile(PERCENT_SIGN), percentage, needs=("%‰",)), Rule("percent-word", PERCENT, re.compile(PERCENT_WORD), percentage, needs=(*L.ends(PERCENT_NOUNS), WHITE))]
RANGES = [Rule("range-with-tail", RANGE, re.compile(WITH_TAIL), range_of, needs=(L.HYPHENS, " ")), Rule("range", RANGE, re.compile(BOTH_ENDS), lambda m, cfg: _ends(m, "f", cfg), needs=(L.HYPHENS,))]
MEASURES = [Rule("unit", UNIT, re.compile(MEASURE), measure, needs=L.ends(L.UNIT_OF)), Rule("degree", UNIT, re.compile(TEMPERATURE), temperature, needs=("°",))]
