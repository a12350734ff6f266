"""The ordered rule scan: the one step that columns of built-in functions can't express."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from kolot.config import Config

PROTECT, DATE, TIME, PHONE, CURRENCY, PERCENT, RANGE, UNIT, ABBREV, ORDINAL, NUMBER = 100, 90, 85, 80, 70, 65, 62, 60, 55, 50, 40


@dataclass(frozen=True)
class Rule:
    """A pattern with a reading; `read` returns None to decline a match.

    `needs_digit`: not tried in a text without an ASCII digit. `needs`: any text with a match
    holds one of the characters of each of these, and `least` characters at all, so that other
    texts need not be searched.
    """

    name: str
    priority: int
    pattern: re.Pattern[str]
    read: Callable[[re.Match[str], Config], str | None]
    needs_digit: bool = True
    needs: tuple[str, ...] = ()
    least: int = 0


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    rule: str
    matched: str
    spoken: str


#: What `\s` matches.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
HAS_DIGIT = re.compile("[0-9]")
MOST_CHOICES = 4096


class Rules(list[Rule]):
    """Rules that stay as they are, and for each set of characters and each length which of them can match: `MOST_CHOICES` of these are kept."""

    def __init__(self, rules: Sequence[Rule]):
        super().__init__(rules)
        self.needs = [tuple(map(frozenset, r.needs)) for r in self]
        self.asked = frozenset().union(*(one for needs in self.needs for one in needs))
        self.longest = max((r.least for r in self), default=0)
        self.choices: dict[tuple[bool, int, frozenset[str]], list[Rule]] = {}

    def live(self, text: str) -> list[Rule]:
        key = HAS_DIGIT.search(text) is not None, min(len(text), self.longest), self.asked.intersection(text)
        out = self.choices.get(key)
        if out is None:
            if len(self.choices) >= MOST_CHOICES:
                self.choices.clear()
            digit, size, there = key
            out = self.choices[key] = [r for r, needs in zip(self, self.needs, strict=True) if (digit or not r.needs_digit) and size >= r.least and not any(map(there.isdisjoint, needs))]
        return out


def found(text: str, rules: Sequence[Rule], cfg: Config, declined: Callable[[Span], None] | None = None) -> Iterator[tuple[int, int, Rule, str]]:
    """(start, end, rule, what is said) from left to right, none overlapping.

    Each rule keeps its next match on a heap ordered by start, then by higher priority, longer
    match and rule order. A match that begins before what has been rewritten is searched for
    again from there, in the original text, so look-behind sees that; a declined or empty one
    from the next character. `declined` is told of matches that a rule gave back.
    """
    live = (rules if isinstance(rules, Rules) else Rules(rules)).live(text)
    size = len(text)
    heap = [(m.start(), -rule.priority, -m.end(), order, m) for order, rule in enumerate(live) if (m := rule.pattern.search(text))]
    heapq.heapify(heap)

    def search(order: int, at: int) -> None:
        if at < size and (m := live[order].pattern.search(text, at)):  # at the end only empty matches are left
            heapq.heappush(heap, (m.start(), -live[order].priority, -m.end(), order, m))

    done = 0
    while heap:
        start, _, end, order, m = heapq.heappop(heap)
        if start < done:
            search(order, done)
            continue
        said = live[order].read(m, cfg) if -end > start else None
        if said is None:
            if declined and -end > start:
                declined(Span(start, -end, live[order].name, m[0], ""))
            search(order, start + 1)
            continue
        done = -end
        yield start, done, live[order], said
        if done == size:
            return
        search(order, done)


def spans(text: str, rules: Sequence[Rule], cfg: Config, declined: Callable[[Span], None] | None = None) -> Iterator[Span]:
    """Spans to rewrite, from left to right, none overlapping; see `found`."""
    for start, end, rule, said in found(text, rules, cfg, declined):
        yield Span(start, end, rule.name, text[start:end], said)


def scan(text: str, rules: Sequence[Rule], cfg: Config) -> str:
    """The text with its spans as they are said."""
    out, at = [], 0
    for start, end, _, said in found(text, rules, cfg):
        out += [text[at:start], said]
        at = end
    return "".join(out) + text[at:] if out else text
