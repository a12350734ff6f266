"""Times of day."""

from __future__ import annotations

import re

from kolot import lexicon as L
from kolot.config import Clock, Config
from kolot.operators import spoken as S
from kolot.operators.scanner import TIME, WHITE, Rule

# Patterns.
CLOCK = r"(?<![\d:.])(\d{1,2}):(\d{2})(?::(\d{2}))?(?![\d:])"
SPOKEN = rf"(?<![\d:.])(\d{{1,2}})\s+({'|'.join(L.DAYPARTS)})(?![א-ת])"
DAYPART_FOLLOWS = re.compile(rf"\s+(?:{'|'.join(L.DAYPARTS + L.MORE_DAYPARTS)})(?![א-ת])")


def daypart(hour: int) -> str:
    if hour == 12:
        return L.NOON
    return L.NIGHT if hour < 5 or hour > 20 else L.MORNING if hour < 12 else L.AFTERNOON if hour < 17 else L.EVENING


def face(hour: int) -> str:
    """The hour on a clock's face, 1 to 12."""
    return S.cardinal((hour - 1) % 12 + 1)


def as_written(value: str) -> str:
    """A number of two digits; below ten its zero is read."""
    return S.digits(value) if int(value) < 10 else S.cardinal(int(value))


def idiom(hour: int, minute: int, part: str) -> str:
    """Quarters and halves as people say them; a quarter to is still in its own hour's part of the day."""
    if hour == minute == 0:
        return L.MIDNIGHT
    if minute == 45:
        said = L.QUARTER_TO + face(hour + 1)
    else:
        minutes = {0: "", 15: L.QUARTER, 30: L.HALF}.get(minute, S.cardinal(minute))
        said = face(hour) + (f" {L.AND}{minutes}" if minutes else "")
    return f"{said} {part}".rstrip()


def clock(m: re.Match[str], cfg: Config) -> str | None:
    parts = [S.whole(g) for g in m.groups() if g is not None]
    if None in parts or any(p > most for p, most in zip(parts, (23, 59, 59), strict=False)):
        return None
    if m[3] or cfg.clock == Clock.H24:
        return " ".join([S.cardinal(parts[0]), *map(as_written, filter(None, m.groups()[1:]))])
    return idiom(parts[0], parts[1], "" if DAYPART_FOLLOWS.match(m.string, m.end()) else daypart(parts[0]))


def spoken_hour(m: re.Match[str], cfg: Config) -> str | None:
    hour = S.whole(m[1])
    return f"{S.cardinal(hour)} {m[2]}" if hour is not None and 1 <= hour <= 12 else None


RULES = [Rule("time-clock", TIME, re.compile(CLOCK), clock, needs=(":",)), Rule("time-spoken-hour", TIME, re.compile(SPOKEN), spoken_hour, needs=(*L.ends(L.DAYPARTS), WHITE))]
