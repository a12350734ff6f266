"""Digit runs that are dictated: telephone, card, address and identity numbers."""

from __future__ import annotations

import re

from kolot import lexicon as L
from kolot.config import Config
from kolot.operators import spoken as S
from kolot.operators.scanner import PHONE, Rule

# Patterns, cue words and how far before a number they are looked for.
SEP = r"[-–—. ]"
SUBSCRIBER = rf"{SEP}?\d{{3}}{SEP}?\d{{4}}"
INTERNATIONAL = rf"\+972{SEP}?0?(?:5\d|7\d|[23489]){SUBSCRIBER}(?!\d)"
LOCAL = rf"(?<!\d)0(?:(?:5\d|7\d){SUBSCRIBER}|[23489]{SUBSCRIBER})(?!\d)"
SERVICE = rf"(?<!\d)1{SEP}?(?:800|700|900|599){SEP}?\d{{3}}{SEP}?\d{{3}}(?!\d)"
STAR = r"\*(\d{3,5})(?!\d)"
CARD = r"(?<!\d)(?:\d{4}[-– ]\d{4}[-– ]\d{4}[-– ]\d{4}|\d{4}[-– ]\d{6}[-– ]\d{5})(?!\d)"
ADDRESS = r"(?<!\d)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\d)"
IDENTITY = r"(?<!\d)\d{9}(?!\d)"
EMERGENCY = r"(?<!\d)1[01]\d(?!\d)"
DIAL_CUE = re.compile(r"(?:חייג|חייגו|חייגי|חייגה|התקשר|התקשרו|התקשרי|טלפון|טל[׳']?|נייד|פקס|מוקד|למוקד|משטרה|למשטרה|מד״א|כבאות|אמבולנס|חירום|שלוחה|מספר)[\s:,\-–]*\Z")
IDENTITY_CUE = re.compile(r"(?:תעודת\s+זהות|מספר\s+זהות|ת״ז|ת\.ז\.?|ח״פ|ח\.פ\.?|ע״ר|ע״מ|עוסק\s+מורשה)[\s:,\-–]*\Z")
CUE_WINDOW = 24
COUNTRY = "972"


def dictated(m: re.Match[str], cfg: Config) -> str:
    return S.digits(m[0])


def after(cue: re.Pattern[str]):
    """Dictation where the cue ends the text just before."""
    return lambda m, cfg: S.digits(m[0]) if cue.search(m.string[max(0, m.start() - CUE_WINDOW) : m.start()]) else None


def international(m: re.Match[str], cfg: Config) -> str:
    """Plus, the country's digits, and the national number without a leading zero."""
    national = re.sub(r"\D", "", m[0])[len(COUNTRY) :].removeprefix("0")
    return f"{L.PLUS} {S.digits(COUNTRY)} {S.digits(national)}"


def address(m: re.Match[str], cfg: Config) -> str | None:
    octets = [S.whole(g) for g in m.groups()]
    if any(o is None or o > 255 for o in octets):
        return None
    return f" {cfg.decimal_word} ".join(map(S.digits, m.groups()))


RULES = [
    Rule("phone-intl", PHONE, re.compile(INTERNATIONAL), international, needs=("+",), least=12),
    Rule("phone-local", PHONE, re.compile(LOCAL), dictated, needs=("0",), least=9),
    Rule("phone-service", PHONE, re.compile(SERVICE), dictated, needs=("1",), least=10),
    Rule("phone-star", PHONE, re.compile(STAR), lambda m, cfg: f"{L.STAR} {S.digits(m[1])}", needs=("*",)),
    Rule("phone-card", PHONE, re.compile(CARD), dictated, needs=("-– ",), least=17),
    Rule("phone-ip", PHONE, re.compile(ADDRESS), address, needs=(".",), least=7),
    Rule("phone-id", PHONE, re.compile(IDENTITY), after(IDENTITY_CUE), least=9),
    Rule("phone-emergency", PHONE, re.compile(EMERGENCY), after(DIAL_CUE), needs=("1",)),
]
