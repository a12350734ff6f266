"""Abbreviations that are read out, and acronyms that only lose their marks."""

from __future__ import annotations

import re

from kolot import lexicon as L
from kolot.config import Config
from kolot.operators.scanner import ABBREV, Rule

# Pattern.
EDGE = f"[{L.HEBREW_BLOCK}׳״]"
PATTERN = f"(?<!{EDGE})([{L.ABBREVIATION_PREFIXES}]?)({L.longest_first([*L.EXPANSIONS, *L.READ_AS_WORDS])})(?!{EDGE})"


def read(m: re.Match[str], cfg: Config) -> str | None:
    word = L.READ_AS_WORDS.get(m[2]) or (L.EXPANSIONS[m[2]] if cfg.expand_abbreviations else None)
    return word and m[1] + word


RULES = [Rule("abbrev", ABBREV, re.compile(PATTERN), read, needs_digit=False, needs=(L.GERESH + L.GERSHAYIM,))]
