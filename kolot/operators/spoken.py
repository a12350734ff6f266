"""Numerals and agreement for single values, as the rules need them inside the scan.

`kolot.functions.numerals` says the same over columns; tests compare the two.
"""

from __future__ import annotations

from functools import cache, lru_cache

from kolot import lexicon as L
from kolot.config import Config

MOST = 2**63 - 1


def whole(digits: str) -> int | None:
    """A 64-bit integer from ASCII digits and commas; None for anything else."""
    plain = digits.replace(",", "")
    if not (plain.isascii() and plain.isdigit()):
        return None
    value = int(plain)
    return value if value <= MOST else None


def glued(parts: list[str]) -> str:
    """Parts in a row, the last of several with "and"."""
    return " ".join([*parts[:-1], (L.AND if len(parts) > 1 else "") + parts[-1]])


@cache
def _below_thousand(n: int, gender: str) -> tuple[str, ...]:
    hundreds, rest = divmod(n, 100)
    parts = [L.HUNDREDS[hundreds - 1]] if hundreds else []
    if 10 <= rest < 20:
        return *parts, L.TEENS[gender][rest - 10]
    tens, ones = divmod(rest, 10)
    return *parts, *([L.TENS[tens - 2]] if tens else []), *([L.ONES[gender][ones]] if ones else [])


def scaled(count: int, one: str, two: str, few: str | None) -> str:
    """A number of thousands or more: one and two have forms of their own, and so, of thousands, have three to ten."""
    if count <= 2:
        return one if count == 1 else two
    if few and count <= 10:
        return f"{L.BOUND['m'][count]} {few}"
    return f"{cardinal(count, 'm')} {one}"


@lru_cache(maxsize=1 << 14)
def cardinal(n: int, gender: str = "f", bound: bool = False) -> str:
    if n < 0:
        return f"{L.MINUS} {cardinal(-n, gender, bound)}"
    if bound and n in L.BOUND[gender]:
        return L.BOUND[gender][n]
    if n == 0:
        return L.ONES[gender][0]
    parts = []
    two = L.BOUND["m"][2]
    for size, one, dual, few in ((10**9, L.MILLIARD, f"{two} {L.MILLIARD}", None), (10**6, L.MILLION, f"{two} {L.MILLION}", None), (1000, L.THOUSAND, L.TWO_THOUSAND, L.THOUSANDS)):
        count, n = divmod(n, size)
        if count:
            parts.append(scaled(count, one, dual, few))
    return glued([*parts, *_below_thousand(n, gender)])


def digits(text: str) -> str:
    """Each ASCII digit in the counting series; other characters are dropped."""
    return " ".join(L.ONES["f"][ord(c) - 48] for c in text if "0" <= c <= "9")


def decimal(n: int, fraction: str, cfg: Config, gender: str = "f") -> str:
    return f"{cardinal(n, gender)} {cfg.decimal_word} {digits(fraction)}"


def ordinal(n: int, gender: str = "m", definite: bool = False) -> str:
    word = L.ORDINALS[gender][n - 1] if 1 <= n <= 10 else cardinal(n, gender)
    return (L.THE if definite else "") + word


def amount(n: int, one: str, many: str, gender: str) -> str:
    """A counted thing: one follows its noun, two is bound, others stand before."""
    if n == 1:
        return f"{one} {cardinal(1, gender)}"
    return f"{cardinal(n, gender, bound=n == 2)} {many}"


def forms(word: str) -> list[str]:
    """A word, and without one and two attached letters while more than two letters are left to look at."""
    out = [word]
    while len(out) < 3 and len(out[-1]) > 2 and out[-1][0] in L.CLITICS:
        out.append(out[-1][1:])
    return out


def by_ending(word: str) -> str:
    if word.endswith("ים"):
        return "m"
    return "f" if word.endswith(("ה", "ת")) else "m"


def noun_gender(word: str, cfg: Config = Config()) -> str:
    """Settings first, then known nouns, then misleading endings, then the ending."""
    tried = forms(word)
    for table in (cfg.gender_overrides, L.NOUNS, L.ENDINGS):
        for form in tried:
            if form in table:
                return getattr(table[form], "value", table[form])
    return by_ending(word)


def is_definite(noun: str) -> bool:
    return len(noun) > 2 and noun.startswith(L.THE)


def count_phrase(n: int, noun: str, cfg: Config = Config()) -> str:
    """Number and noun in agreement; a definite noun takes the bound form up to ten."""
    gender = noun_gender(noun, cfg)
    if is_definite(noun) and 3 <= n <= 10:
        return f"{cardinal(n, gender, bound=True)} {noun}"
    return amount(n, noun, noun, gender)


def gematria(letters: str) -> int:
    return sum(L.LETTER_VALUES.get(c, 0) for c in letters)
