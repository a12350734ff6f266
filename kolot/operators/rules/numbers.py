"""Bare numbers: counts with their noun, signs and decimals, ordinals, and prefixes joined by a hyphen."""

from __future__ import annotations

import re

from kolot import lexicon as L
from kolot.config import Config
from kolot.operators import spoken as S
from kolot.operators.scanner import NUMBER, ORDINAL, Rule

# Patterns.
INTEGER = r"(?P<num>\d{1,3}(?:,\d{3})+|\d+)"
BEFORE = r"(?<!\d)(?<![:/])(?!(?<=,)\d{3}(?!\d))"
AFTER = r"(?!\d)(?![:/]\d)"
COUNT = rf"{BEFORE}{INTEGER}(?!\.?\d){AFTER}[ ](?P<noun>[{L.HEBREW_LETTER}]{{2,}})(?![{L.HEBREW_LETTER}])"
PLAIN = rf"{BEFORE}(?P<sign>[-+])?{INTEGER}(?:\.(?P<frac>\d+))?{AFTER}"
NTH = rf"ה[{L.HYPHENS}](?P<num>\d{{1,3}}){AFTER}"
PREFIX = rf"(?<![{L.HEBREW_LETTER}])(?P<pre>[בוכלמש]{{1,2}})(?<!של)[{L.HYPHENS}](?=[\d₪$€£])"

LAST_WORD = re.compile(rf"(?<![{L.HEBREW_LETTER}])([{L.HEBREW_LETTER}]*)\s+\Z")
SIGN_IS_HYPHEN = re.compile(rf"[{L.HEBREW_LETTER}{L.HYPHENS}]\Z")
NOT_COUNTED, SCALES = frozenset(L.NOT_COUNTED), frozenset(L.COUNTED_SCALES)


def after_times(m: re.Match[str]) -> bool:
    """The word before, cut off by white space, is the idiom "times"; the window holds that word, a letter before it and blanks."""
    if not m.string[m.start() - 1 : m.start()].isspace():
        return False
    head = m.string[: m.start()]
    word = LAST_WORD.search(head, max(0, len(head.rstrip()) - len(L.TIMES) - 1))
    return word is not None and word[1] == L.TIMES


def is_countable(noun: str, n: int, cfg: Config) -> bool:
    """A caution more than a grammar: one is put behind known nouns only, others must look like a plural."""
    if len(noun) < 2 or noun in NOT_COUNTED:
        return False
    if noun in cfg.gender_overrides or noun in SCALES:
        return True
    if n == 1:
        return noun in L.NOUNS
    return noun.endswith(("ים", "ות")) or (noun.endswith("י") and len(noun) > 2)


def count(m: re.Match[str], cfg: Config) -> str | None:
    n = S.whole(m["num"])
    if n is None:
        return None
    if after_times(m):
        return f"{S.cardinal(n, 'm')} {m['noun']}"
    return S.count_phrase(n, m["noun"], cfg) if is_countable(m["noun"], n, cfg) else None


def plain(m: re.Match[str], cfg: Config) -> str | None:
    sign = {"-": L.MINUS + " ", "+": L.PLUS + " ", None: ""}[m["sign"]]
    if sign and SIGN_IS_HYPHEN.search(m.string, max(0, m.start() - 1), m.start()):
        return None
    n, gender = S.whole(m["num"]), "m" if after_times(m) else "f"
    if n is None:
        return sign + m["num"]
    return sign + (S.cardinal(n, gender) if m["frac"] is None else S.decimal(n, m["frac"], cfg, gender))


def nth(m: re.Match[str], cfg: Config) -> str | None:
    n = S.whole(m["num"])
    return None if n is None else S.ordinal(n, "m", definite=True)


RULES = [
    Rule("count", NUMBER, re.compile(COUNT), count, needs=(" ",)),
    Rule("number", NUMBER, re.compile(PLAIN), plain),
    Rule("ordinal", ORDINAL, re.compile(NTH), nth, needs=("ה", L.HYPHENS)),
    Rule("number-prefix", NUMBER, re.compile(PREFIX), lambda m, cfg: m["pre"], needs=("בוכלמש", L.HYPHENS)),
]
